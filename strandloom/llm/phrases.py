"""Phrases mined from FM-indexes of shards, their counts summed across shards.

A shard is what a task gathers of one language, up to WORDS words; no text is shuffled. Its words get
local numbers, 0 standing between pieces. Its index is the Burrows-Wheeler transform of the numbers
and that of the reversed numbers, suffixes sorted by their first DEPTH words only: intervals of
patterns of up to DEPTH words need no more. Each phrase has an interval in both transforms. The words
before it are those inside its interval of the first one; with the last-to-first map they give the
intervals of all left extensions at once, and the number of smaller words there moves the interval in
the other one. Right extensions are the same with both exchanged.

Phrases grow by one word a round. A shard extends what may reach the threshold as a whole: all shorter
phrases inside must. Sums of a round become a table of bits of fixed size, which lets more through as
it fills up and changes no sum. A phrase is a 64-bit hash of its language and words until the end,
when the first shard that has it (the sums carry it along) gives its words. Nothing is cut off below
the threshold inside a shard, so sums are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.jaccard_join import mixed
from strandloom.llm.memory import in_few_bytes
from strandloom.llm.suffix_index import in_slots, slot_of, slots_of
from strandloom.plans.session import table, written

DEPTH, LEAST, TOP = 4, 30, 2000
SHARE = 80
SCALE = 2_000_000
#: Words of a shard, words that are numbered at a time, and places of an index that are extended at a time.
WORDS, NUMBERED, PLACES = 1 << 20, 1 << 16, 1 << 18
#: What stands between pieces, which no word can be.
END = b"."
Passes = Callable[[np.ndarray], np.ndarray]
#: Ends of pieces become line feeds at first, tabs spaces, A-Z lower case.
_PLAIN = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09" + bytes(range(65, 91)), b"\x0a" * 10 + b"\x20" + bytes(range(97, 123)))
_COUNTS = "hash long, n long, shard long"


def tokens_of(text: str | None) -> list[bytes]:
    """Words of a text, and END after each piece."""
    return (text or "").encode().translate(_PLAIN).replace(b"\n", b" . ").split()


def numbered(tokens: list[bytes], ids: dict[bytes, int]) -> np.ndarray:
    """The numbers of some words; new ones are added to `ids`."""
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    return np.array([ids.setdefault(w, len(ids)) for w in coded.dictionary.to_pylist()], np.int32)[coded.indices.to_numpy()]


def packed(a: np.ndarray) -> bytes:
    """Numbers as bytes, compressed, their size first."""
    raw = a.astype("<i4").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd"), "<i4")


def in_order(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys (up to `most`) sorted, and where they stood; equal ones in their order."""
    bits = max(len(key) - 1, 1).bit_length()
    if most.bit_length() + bits > 63:
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = key << bits
    both |= np.arange(len(key))
    both.sort()
    order = both & ((1 << bits) - 1)
    both >>= bits
    return both, order


def transform(a: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The word before each suffix, suffixes sorted by their first `depth` words. The numbers are a ring that begins with 0."""
    rank, span, top = a, 1, int(a.max())
    key, order = in_order(rank, top)
    while span < depth:
        step = min(span, depth - span)
        key = rank * (top + 1)
        key += np.roll(rank, -step)
        key, order = in_order(key, top * (top + 2))
        span += step
        rank = np.empty(len(a), np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        top = int(rank[order[-1]])
    return a[order - 1]


class Shard:
    """An FM-index in both directions."""

    def __init__(self, words: list[bytes], forward: np.ndarray, backward: np.ndarray, salt: int) -> None:
        self.words, self.sides = words, (forward, backward)
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        self.salt = np.uint64(salt)
        self.back = tuple(self.last_to_first(x) for x in self.sides)
        self.sizes = np.bincount(forward, minlength=len(words))
        self.first = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))

    @staticmethod
    def last_to_first(bwt: np.ndarray) -> np.ndarray:
        """Where the suffix stands that begins with the word before each suffix."""
        out = np.empty(len(bwt), np.int32)
        out[in_order(bwt.astype(np.int64), int(bwt.max()))[1]] = np.arange(len(bwt))
        return out

    def hash_of(self, grams: np.ndarray) -> np.ndarray:
        """The hashes of phrases, a row of numbers each."""
        total = np.full(len(grams), self.salt, np.uint64)
        for j in range(grams.shape[1]):
            total = mixed(total * np.uint64(31) + self.hashes[grams[:, j]])
        return total

    def single(self, passes: Passes) -> dict[str, np.ndarray]:
        """The words of the shard that `passes` lets through, as phrases: grams, size, and begin in both transforms."""
        grams = np.flatnonzero(self.sizes[1:])[:, None] + 1
        grams = grams[passes(self.hash_of(grams))].astype(np.int32)
        begin = self.first[grams[:, 0]].astype(np.int32)
        return {"grams": grams, "size": self.sizes[grams[:, 0]].astype(np.int32), "begin": np.stack([begin, begin])}

    def extended(self, now: dict[str, np.ndarray], side: int, passes: Passes) -> Iterator[dict[str, np.ndarray]]:
        """All phrases of `now` with one more word in front (side 0) or behind (side 1), as far as their parts pass; some phrases' extensions at a time."""
        upto = np.cumsum(now["size"], dtype=np.int64)
        begin = 0
        while begin < len(upto):
            done = int(upto[begin - 1]) if begin else 0
            stop = max(int(np.searchsorted(upto, done + PLACES, side="right")), begin + 1)
            yield self._extended({"grams": now["grams"][begin:stop], "size": now["size"][begin:stop].astype(np.int64), "begin": now["begin"][:, begin:stop]}, side, passes)
            begin = stop

    def _extended(self, now: dict[str, np.ndarray], side: int, passes: Passes) -> dict[str, np.ndarray]:
        size = now["size"]
        parent = np.repeat(np.arange(len(size)), size)
        start = np.cumsum(size) - size
        at = np.arange(len(parent)) - start[parent] + now["begin"][side][parent]
        key, order = in_order(parent * len(self.words) + self.sides[side][at], len(size) * len(self.words))  # by phrase and word, then by place
        group = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
        n = np.diff(np.append(group, len(key)))
        of, word = np.divmod(key[group], len(self.words))
        whole = np.concatenate([word[:, None], now["grams"][of]] if side == 0 else [now["grams"][of], word[:, None]], axis=1).astype(np.int32)
        keep = word > 0
        part = whole[:, :-1] if side == 0 else whole[:, 1:]
        keep[keep] = passes(self.hash_of(part[keep]))
        here = self.back[side][at[order[group[keep]]]]
        there = now["begin"][1 - side][of[keep]] + (group[keep] - start[of[keep]])  # smaller words stand before
        both = [here, there] if side == 0 else [there, here]
        return {"grams": whole[keep], "size": n[keep].astype(np.int32), "begin": np.stack(both).astype(np.int32)}

    def levels(self, depth: int, filters: list[np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        """The phrases of 1 to `depth` words, some at a time, whose shorter parts the filters (of 1, 2, ... words) let through; what a filter of their own length there is lets through, too."""
        passes = [lambda h, bits=bits: in_slots(bits, slot_of(h)) for bits in filters] + [lambda h: np.ones(len(h), bool)]
        now = self.single(passes[0])
        yield now
        for k in range(1, depth):
            parts = []
            for x in self.extended(now, (k + 1) % 2, passes[k - 1]):
                if k < len(filters):
                    keep = passes[k](self.hash_of(x["grams"]))
                    x = {"grams": x["grams"][keep], "size": x["size"][keep], "begin": x["begin"][:, keep]}
                if k < depth - 1:
                    parts.append(x)
                yield x
            if k < depth - 1:
                if not parts:
                    return
                now = {c: np.concatenate([x[c] for x in parts], axis=-1 if c == "begin" else 0) for c in now}


def salt_of(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode(), seed=13)


def indexes(docs: DataFrame, words: int = WORDS, depth: int = DEPTH) -> DataFrame:
    """(shard, lang, n, words, forward, backward): the FM-indexes of shards of `words` words or one document. docs: (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = 0, {}  # lang -> word numbers, arrays of them, tokens to be numbered, tokens so far
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal made
            ids, arrays, rest, _ = held.pop(lang)
            a = np.concatenate([np.zeros(1, np.int64), *arrays, numbered(rest, ids)])
            names = b" ".join(list(ids)[1:])
            columns = [pa.array([base + made], pa.int64()), pa.array([lang]), pa.array([int((a > 0).sum())], pa.int64()), *(pa.array([x], pa.binary()) for x in (names, packed(transform(a, depth)), packed(transform(np.concatenate((a[:1], a[:0:-1])), depth))))]
            made += 1
            return pa.RecordBatch.from_arrays(columns, names=["shard", "lang", "n", "words", "forward", "backward"])

        for batch in batches:
            for lang, said in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = tokens_of(said.as_py())
                if not tokens:
                    continue
                if lang in held and held[lang][3] + len(tokens) > words:
                    yield flush(lang)
                one = held.setdefault(lang, [{END: 0}, [], [], 0])
                one[2] += tokens
                one[2].append(END)
                one[3] += len(tokens) + 1
                if len(one[2]) > NUMBERED:
                    one[1].append(numbered(one[2], one[0]))
                    one[2] = []
                if sum(x[3] for x in held.values()) > 2 * words:  # many languages: the largest goes
                    yield flush(max(held, key=lambda k: held[k][3]))
        for lang in list(held):
            yield flush(lang)

    return docs.select("lang", "text").mapInArrow(run, "shard long, lang string, n long, words binary, forward binary, backward binary")


def shard_of(row: dict) -> Shard:
    return Shard([END, *(row["words"].split(b" ") if row["words"] else [])], unpacked(row["forward"]), unpacked(row["backward"]), salt_of(row["lang"]))


def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in ("shard", "lang", "words", "forward", "backward")}


def level_counts(shards: DataFrame, length: int, filters: list[np.ndarray]) -> DataFrame:
    """(hash, n, shard) of every shard's phrases of `length` words that may be frequent."""
    shared = shards.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_in(batches):
            number, shard = row["shard"], shard_of(row)
            for found in shard.levels(length, shared.value):
                if found["grams"].shape[1] < length:
                    continue
                h = shard.hash_of(found["grams"]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(found["size"].astype(np.int64)), pa.repeat(pa.scalar(number, pa.int64()), len(h))], names=["hash", "n", "shard"])
            del row, shard, found  # a task holds one index

    return shards.select("shard", "lang", "words", "forward", "backward").mapInArrow(run, _COUNTS)


def frequent(counts: DataFrame, least: int) -> DataFrame:
    """(hash, a, shard) of the phrases that all shards together have `least` times; shard is the first one that has it.

    A shard has each phrase once, so there is nothing to sum before the exchange.
    """
    return counts.repartition("hash").groupBy("hash").agg(F.sum("n").alias("a"), F.min("shard").alias("shard")).filter(F.col("a") >= least)


def named(shards: DataFrame, wanted: np.ndarray, filters: list[np.ndarray], depth: int = DEPTH) -> DataFrame:
    """(hash, shard, lang, phrase, length, cuts) of the phrases that `wanted`, bits of hash and shard, has in their shard; cuts has the hashes (k, first, rest) of both parts of every cut."""
    shared = shards.sparkSession.sparkContext.broadcast((wanted, filters))
    cuts_kind = pa.list_(pa.struct([("k", pa.int32()), ("first", pa.int64()), ("rest", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, filters = shared.value
        for row in rows_in(batches):
            number, lang, shard = row["shard"], row["lang"], shard_of(row)
            for found in shard.levels(depth, filters):
                length = found["grams"].shape[1]
                if length < 2:
                    continue
                hashes = shard.hash_of(found["grams"])
                keep = in_slots(wanted, slot_of(hashes, np.full(len(hashes), number, np.uint64)))
                grams, hashes = found["grams"][keep], hashes[keep].view(np.int64)
                n = len(hashes)
                said = [b" ".join(shard.words[w] for w in g).decode() for g in grams.tolist()]
                parts = [(shard.hash_of(grams[:, :k]).view(np.int64).tolist(), shard.hash_of(grams[:, k:]).view(np.int64).tolist()) for k in range(1, length)]
                cuts = [[{"k": k + 1, "first": a[r], "rest": b[r]} for k, (a, b) in enumerate(parts)] for r in range(n)]
                columns = [pa.array(hashes), pa.repeat(pa.scalar(number, pa.int64()), n), pa.repeat(lang, n), pa.array(said, pa.string()), pa.repeat(pa.scalar(length, pa.int32()), n), pa.array(cuts, cuts_kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["hash", "shard", "lang", "phrase", "length", "cuts"])
            del row, shard, found

    return shards.select("shard", "lang", "words", "forward", "backward").mapInArrow(run, "hash long, shard long, lang string, phrase string, length int, cuts array<struct<k:int,first:long,rest:long>>")


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, depth: int = DEPTH, share: int = SHARE, words: int = WORDS) -> DataFrame:
    """(lang, phrase, length, a, l, r, k, n, score, longest, kept) of every phrase of 2 to `depth` words that a language has `least` times.

    a counts the phrase, l and r the parts at the cut k of the lowest score floor(2,000,000 a / (l + r)),
    the first of several; n counts the language's words. longest is the count of the most frequent
    phrase with one more word in front or behind (null if none is frequent); kept is false if that has
    at least `share` per cent of a. All counts are of whole texts. Null and empty texts have no words,
    a null language is `und`, repeated rows count each, other columns are ignored, an empty table
    gives no rows. A language may hold all rows: shards are parts of it.
    """
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in (lang, text)]
    shards = written(indexes(in_few_bytes(docs.select(F.coalesce(quoted[0].cast("string"), F.lit("und")).alias("lang"), quoted[1].alias("text"))), words, depth), "phrase-shards")
    filters, levels = [], []
    for length in range(1, depth + 1):
        levels.append(written(frequent(level_counts(shards, length, filters), least), f"phrases-{length}"))
        if length < depth:
            filters.append(slots_of(levels[-1].select("hash")))
    counts, candidates = levels[0], levels[1]
    for x in levels[1:]:
        counts = counts.union(x)
    for x in levels[2:]:
        candidates = candidates.union(x)
    names = named(shards, slots_of(candidates.select("hash", "shard")), filters, depth)
    found = written(names.join(candidates.select("hash", "shard", "a"), ["hash", "shard"]).drop("shard"), "phrases-named")
    cuts = found.select("hash", "a", F.explode("cuts").alias("cut")).select("hash", "a", F.col("cut.k").alias("k"), F.col("cut.first").alias("first"), F.col("cut.rest").alias("rest"))
    left, right = counts.select(F.col("hash").alias("first"), F.col("a").alias("l")), counts.select(F.col("hash").alias("rest"), F.col("a").alias("r"))
    score = F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = cuts.join(left, "first").join(right, "rest").groupBy("hash").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    longer = found.filter("length > 2").select("a", F.explode(F.array(F.expr("cuts[length - 2].first"), F.expr("cuts[0].rest"))).alias("hash")).groupBy("hash").agg(F.max("a").alias("longest"))
    totals = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    out = found.join(lowest, "hash").join(longer, "hash", "left").join(totals, "lang")
    dropped = F.expr(f"coalesce(cast(longest as decimal(20,0)) * 100 >= cast(a as decimal(20,0)) * {share}, false)")
    return out.select("lang", "phrase", "length", "a", "cut.l", "cut.r", "cut.k", "n", "cut.score", "longest", (~dropped).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first TOP phrases of every language."""
    kept = phrases(table(spark, sf_dir, "documents").select("lang", "text")).filter("kept")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= TOP)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM documents),
g AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM p, (SELECT unnest(range(1, {DEPTH + 1})) AS size) WHERE len(w) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= {LEAST}),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:size], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
scored AS (SELECT cut.lang, cut.phrase, cut.a, k, x.a AS l, y.a AS r, (({SCALE}::HUGEINT * cut.a) // (x.a + y.a))::BIGINT AS score
    FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first JOIN f y ON y.lang = cut.lang AND y.phrase = rest),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT DISTINCT c.lang, array_to_string(c.w[i:i + s - 1], ' ') AS phrase, c.a AS longer FROM c, (SELECT unnest(range(2, {DEPTH})) AS s), (SELECT unnest(range(1, {DEPTH})) AS i) WHERE s < c.size AND i + s - 1 <= c.size),
gone AS (SELECT DISTINCT low.lang, low.phrase FROM low JOIN inner_ USING (lang, phrase) WHERE 100 * longer::HUGEINT >= {SHARE} * a::HUGEINT)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM low JOIN n USING (lang) WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.lang = low.lang AND gone.phrase = low.phrase) QUALIFY rank <= {TOP}
"""
