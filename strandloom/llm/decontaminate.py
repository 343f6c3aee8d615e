"""Benchmark decontamination by a prefix-filtered containment join.

An item's window is a run of WINDOW words, or all words of a shorter item; its tokens are its
shingles of SHINGLE words, or the window itself where that is shorter. A document contains a window
only if it has every shingle of it, so of the shingles ordered by rarity in the corpus a prefix of
one, the rarest, is necessary. Windows and documents are joined on that shingle alone. Length and
position bound the candidates: the document must have room for the whole window around the shingle.
What remains is compared word by word over the item-sized window.

Two passes over the documents. The first counts how often the benchmark's shingles occur in all
documents. The second keeps, around each shingle that is a window's rarest, its neighbourhood. Both
skip words that no item has, and other shingles, by tables of hash slots of a fixed size; the joins
settle what they let through wrongly. Shingles are joined by 64-bit hashes, windows by their words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.jaccard_join import mixed
from strandloom.llm.memory import in_small_batches
from strandloom.plans.session import table, written

WINDOW, SHINGLE = 10, 3
#: Slots of a table of hashes, one byte each: the sum of the lengths (1 to SHINGLE as bits) of what hashes there.
SLOTS = 1 << 22
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
NEAR = pa.list_(pa.struct([("shingle", pa.int64()), ("at", pa.int64()), ("from", pa.int64()), ("words", pa.list_(pa.string()))]))
NEAR_DDL = "array<struct<shingle:bigint,at:bigint,from:bigint,words:array<string>>>"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: runs of ASCII letters, digits and everything beyond ASCII, A-Z in lower case."""
    return WORD.findall((text or "").encode().lower())


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of `size` words, from the words' hashes."""
    n = max(len(hashes) - size + 1, 0)
    total = np.full(n, size, np.uint64)
    for j in range(size):
        total = mixed(total * np.uint64(31) + hashes[j : n + j])
    return total


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def item_windows(items: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, at, words, shingles) for every window of every item.

    Null and empty texts, and others without words, have none; repeated rows have theirs each; null ids
    stay null; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, said in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = words_of(said)
                n = max(1, len(words) - window + 1) if words else 0
                if n:
                    size = min(SHINGLE, window, len(words))
                    hashes, said = shingle_hashes(word_hashes(words), size).view(np.int64), [w.decode() for w in words]
                    rows = [pa.array(range(n), pa.int64()), pa.array([said[k : k + window] for k in range(n)], pa.list_(pa.string())), pa.array([hashes[k : k + window - size + 1] for k in range(n)], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([pa.repeat(key, n), *rows], names=["item", "at", "words", "shingles"])

    kind = dict(items.dtypes)[item]
    return items.select(F.col(item).alias("item"), text).mapInArrow(run, f"item {kind}, at bigint, words array<string>, shingles array<bigint>")


def slot_table(hashes: DataFrame) -> np.ndarray:
    """One byte for each slot, the sum of 2^size over the sizes of what hashes there. hashes: (hash, size). At most 8 * SLOTS small rows reach the driver."""
    slots = hashes.select(F.expr(f"cast(pmod(hash, {SLOTS}) as int)").alias("slot"), "size").groupBy("slot").agg(F.expr("cast(bit_or(shiftleft(1, cast(size as int))) as int)").alias("sizes"))
    found = np.zeros(SLOTS, np.uint8)
    for row in slots.toLocalIterator():
        found[row[0]] = row[1]
    return found


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def shingles_in(words: list[bytes], known: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, places, hashes) of the shingles of some words that `wanted` has and whose words `known` has all."""
    hashes = word_hashes(words)
    ours = known[slot(hashes)] > 0
    if not ours.any():
        return
    for size in range(1, SHINGLE + 1):
        n = len(words) - size + 1
        if n > 0:
            at = np.flatnonzero(np.logical_and.reduce([ours[j : n + j] for j in range(size)]))
            if len(at):
                total = np.full(len(at), size, np.uint64)
                for j in range(size):
                    total = mixed(total * np.uint64(31) + hashes[at + j])
                keep = wanted[slot(total)] >> size & 1 == 1
                if keep.any():
                    yield size, at[keep], total[keep]


def shingle_counts(docs: DataFrame, known: np.ndarray, wanted: np.ndarray, text: str = "text") -> DataFrame:
    """(shingle, n) over all documents for the shingles that the tables let through, summed in each task first."""
    shared = docs.sparkSession.sparkContext.broadcast((known, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = shared.value
        for batch in batches:
            found = [h for said in batch.column(0) for _, _, h in shingles_in(words_of(said.as_py()), known, wanted)]
            if found:
                hashes, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n, pa.int64())], names=["shingle", "n"])

    return docs.select(text).mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))


def prefix_index(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(shingle, skip, size, words): each distinct window under its rarest shingle, which stands `skip` words from its beginning."""
    distinct = windows.groupBy("words").agg(F.first("shingles").alias("shingles"))
    tokens = distinct.select("words", F.posexplode("shingles").alias("skip", "shingle"))
    ranked = tokens.join(counts, "shingle", "left").select("words", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "skip").alias("rank"))
    return ranked.groupBy("words").agg(F.min("rank").alias("rank")).select(F.col("rank.shingle").alias("shingle"), F.col("rank.skip").cast("bigint").alias("skip"), F.size("words").cast("bigint").alias("size"), "words")


def neighbourhoods(docs: DataFrame, known: np.ndarray, wanted: np.ndarray, keys: list[str], window: int = WINDOW, text: str = "text") -> DataFrame:
    """`keys` of every document, its number of words, and the words around each shingle that the tables let through."""
    shared = docs.sparkSession.sparkContext.broadcast((known, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, wanted), reach = shared.value, window - 1
        for batch in batches:
            sizes, near = [], []
            for said in batch.column(len(keys)):
                words = words_of(said.as_py())
                sizes.append(len(words))
                near.append([
                    {"shingle": h, "at": i, "from": max(0, i - reach), "words": [w.decode() for w in words[max(0, i - reach) : i + window]]}
                    for i, h in chain.from_iterable(zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True) for _, at, hashes in shingles_in(words, known, wanted))
                ])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(sizes, pa.int64()), pa.array(near, NEAR)], names=[*keys, "n_words", "near"])

    chosen = docs.select(*keys, text)
    return chosen.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in chosen.select(*keys).dtypes) + f", n_words bigint, near {NEAR_DDL}")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text_key, n_words, n_hit, item_ids) of every row of `docs`; text_key is xxhash64 of the text.

    n_hit counts the words inside any occurrence of any window, item_ids are the ids, sorted as
    strings, of the items whose windows occur. Texts that are null or empty have no words. Repeated
    rows stay rows; equal texts are looked at once. Items with null ids count words as hit and give no
    id. Without items or documents nothing is hit. Other columns are ignored. A very long text is one
    row of its task and gives a small row for each rare shingle.
    """
    windows = written(item_windows(in_small_batches(items), window), "item-windows")
    words = windows.select(F.explode("words").alias("word")).distinct()
    known = slot_table(hashed_words(words))
    sized = windows.select(F.explode("shingles").alias("hash"), F.least(F.size("words"), F.lit(SHINGLE)).alias("size"))
    index = written(prefix_index(windows, shingle_counts(docs, known, slot_table(sized), text)), "prefix-index")
    keyed = docs.select(F.col(doc), F.col(text).alias("__text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"))
    wanted = slot_table(index.select(F.col("shingle").alias("hash"), F.least("size", F.lit(SHINGLE)).alias("size")))
    scan = written(neighbourhoods(keyed, known, wanted, [doc, "text_key"], window, "__text"), "decontaminate-scan")
    near = scan.filter(F.size("near") > 0).select("text_key", "n_words", F.explode("near").alias("near"))
    near = near.select("text_key", "n_words", "near.shingle", "near.at", F.col("near.from").alias("begin"), F.col("near.words").alias("around"))
    # the index is small or large as the benchmark is: Spark chooses by its size on disk how to join
    start = F.col("at") - F.col("skip")
    found = (
        near.join(index.withColumnRenamed("words", "wanted"), "shingle")
        .filter((start >= 0) & (start + F.col("size") <= F.col("n_words")))
        .filter(F.slice("around", (start - F.col("begin") + 1).cast("int"), F.col("size").cast("int")) == F.col("wanted"))
        .select("text_key", start.alias("start"), "size", "wanted")
        .distinct()
    )
    found = written(found, "hit-windows")
    runs = found.groupBy("text_key").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("stop")))).alias("runs"))
    covered = "aggregate(runs, struct(0L AS n, 0L AS seen), (a, r) -> struct(a.n + greatest(r.stop - greatest(r.start, a.seen), 0L) AS n, greatest(a.seen, r.stop) AS seen), a -> a.n)"
    runs = runs.select("text_key", F.expr(covered).alias("n_hit"))
    hit_items = (
        found.select("text_key", "wanted").distinct()
        .join(windows.select(F.col("words").alias("wanted"), F.col("item").cast("string").alias("item")).distinct(), "wanted")
        .groupBy("text_key").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    )
    hits = written(runs.join(hit_items, "text_key", "left"), "hits")
    return scan.select(doc, "text_key", "n_words").join(hits, "text_key", "left").select(
        doc, "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")
    )


def hashed_words(words: DataFrame) -> DataFrame:
    """(hash, size) of the words of the column `word`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [x.encode() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(word_hashes(said).view(np.int64)), pa.repeat(pa.scalar(1, pa.int32()), len(said))], names=["hash", "size"])

    return words.select("word").mapInArrow(run, "hash bigint, size int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document has of the benchmark's items."""
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT item_id, least(len(w), {WINDOW}) AS size, unnest(list_transform(range(1, greatest(len(w) - {WINDOW - 2}, 2)), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS win FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
hit AS (SELECT DISTINCT doc_id, i, dw.size, item_id FROM dw JOIN iw ON dw.size = iw.size AND array_to_string(w[i:i + dw.size - 1], ' ') = win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
