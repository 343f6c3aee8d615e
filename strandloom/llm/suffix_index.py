"""Removal of long repeated substrings with a logarithmic family of suffix arrays.

A suffix array over every byte isn't needed to find matches of LENGTH bytes: of the suffixes that
begin inside any LENGTH bytes, the one whose first KEY bytes have the smallest hash is kept, so that
equal strings keep the same suffix. About one suffix in seventy remains, ordered by the hash of its
first KEY bytes.

Batches of documents enter an index of levels one after another. A batch's sorted suffixes are
merge-scanned against each level for equal keys; a level as large as what comes in is merged with
it, as in a binary counter, so that n batches leave at most log2(n) + 1 levels and every suffix is
rewritten log2(n) times.

Suffixes with equal keys are then extended to both sides over all of the LENGTH bytes that could
hold them. Equal extensions are one class, and a class of two covers its whole extension. A class of
one is compared with the other classes of its key over each LENGTH-byte string around the key. The
covered bytes of a text are merged, and removed.

Strings are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.jaccard_join import CHUNKS, fixed_table, mixed
from strandloom.llm.memory import in_small_batches
from strandloom.plans.session import table, written

SQL = None
LENGTH, KEY = 200, 64
REACH = LENGTH - KEY
BATCHES = 4
BITS = 1 << 25
SEGMENT = 1 << 19
#: Texts of fewer bytes are hashed together, about so many bytes at a time.
GROUPED = 1 << 17
#: Classes of one key that a task compares in memory; keys with more are compared by Spark string by string.
MOST_CLASSES = 20_000
_MARGIN = 2 * LENGTH
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(8).integers(1, 2**63, 256, dtype=np.uint64)
_SHIFTS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, mod 2^64: n of the first, n or more of the second."""
    if not _SHIFTS or len(_SHIFTS[0]) < n:
        size = max(SEGMENT + 2 * _MARGIN + LENGTH, n)  # a segment with its last string and both margins
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _SHIFTS[:] = made
    return _SHIFTS[0][:n], _SHIFTS[1]


def window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours."""
    span, low = 1, x
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def kept_suffixes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(at, key, extension, left, right) of a text's kept suffixes; left and right are the bytes that extend to each side of `at`."""
    a, n = np.frombuffer(data, np.uint8), len(data)
    found = []
    for begin in range(0, max(n - LENGTH + 1, 0), SEGMENT):
        last = min(begin + SEGMENT - 1, n - LENGTH)  # the last string that begins in this segment
        low = max(begin - _MARGIN, 0)
        part = a[low : min(last + LENGTH + _MARGIN, n)]
        up, down = _powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * up, out=sums[1:])
        first = begin - low
        starts = np.arange(first, last - low + REACH + 1)
        keys = mixed((sums[starts + KEY] - sums[starts]) * down[starts])
        # ties go to the first: the place stands in the low bits
        placed = (keys & ~np.uint64((1 << 21) - 1)) | np.arange(len(keys), dtype=np.uint64)
        chosen = np.unique((window_minimum(placed, REACH + 1) & np.uint64((1 << 21) - 1)).astype(np.int64))
        at = chosen + first
        lo, hi = np.maximum(at - REACH, 0), np.minimum(at + LENGTH, len(part))
        lo = np.where(low == 0, lo, at - REACH)
        whole = mixed((sums[hi] - sums[lo]) * down[lo] + ((hi - lo).astype(np.uint64) << np.uint64(40)) + ((at - lo).astype(np.uint64) << np.uint64(52)))
        found.append((at + low, keys[chosen], whole, at - lo, hi - at))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    joined = [np.concatenate(x) for x in zip(*found, strict=True)]
    _, once = np.unique(joined[0], return_index=True)
    return tuple(x[once] for x in joined)


def suffixes_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, at, key, extension, left, right) of all texts' kept suffixes; text counts from 0. Short texts are hashed together."""
    out, group, size = [], [], 0
    for number, data in enumerate(texts):
        if len(data) < LENGTH:
            continue
        if len(data) > GROUPED:
            found = kept_suffixes(data)
            out.append((np.full(len(found[0]), number), *found))
            continue
        group.append(number)
        size += len(data)
        if size > GROUPED:
            out.append(_together(texts, group))
            group, size = [], 0
    if group:
        out.append(_together(texts, group))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _together(texts: list[bytes], group: list[int]) -> tuple[np.ndarray, ...]:
    """The same as kept_suffixes for each text, in one pass over all of their bytes; strings across a border are left out."""
    ends = np.cumsum([len(texts[k]) for k in group])
    part = np.frombuffer(b"".join(texts[k] for k in group), np.uint8)
    up, down = _powers(len(part))
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_BYTES[part] * up, out=sums[1:])
    n = len(part) - KEY + 1
    keys = mixed((sums[KEY:] - sums[:n]) * down[:n])
    placed = (keys & ~np.uint64((1 << 21) - 1)) | np.arange(n, dtype=np.uint64)
    least = (window_minimum(placed, REACH + 1) & np.uint64((1 << 21) - 1)).astype(np.int64)
    inside = np.zeros(len(least), bool)
    begin = 0
    for end in ends.tolist():
        inside[begin : end - LENGTH + 1] = True
        begin = end
    at = least[inside]  # never falls from one string to the next
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    which = np.searchsorted(ends, at, side="right")
    starts = np.concatenate(([0], ends[:-1]))[which]
    lo, hi = np.maximum(at - REACH, starts), np.minimum(at + LENGTH, ends[which])
    whole = mixed((sums[hi] - sums[lo]) * down[lo] + ((hi - lo).astype(np.uint64) << np.uint64(40)) + ((at - lo).astype(np.uint64) << np.uint64(52)))
    return np.array(group)[which], at - starts, keys[at], whole, at - lo, hi - at


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that a task holds few texts and their hashes at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _bytes(column: pa.Array) -> list[bytes]:
    return [x.encode() for x in column.to_pylist()]


def batch_keys(docs: DataFrame, text: str, batches: int) -> DataFrame:
    """(batch, key): keys of the suffixes of each batch of documents. What a task finds several times it gives twice."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(rows):
            found = suffixes_of(_bytes(batch.column(1)))
            numbers = batch.column(0).to_numpy()[found[0]]
            for number in np.unique(numbers):
                key, n = np.unique(found[2][numbers == number], return_counts=True)
                key = np.repeat(key, np.minimum(n, 2))
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(int(number), pa.int32()), len(key)), pa.array(key.view(np.int64))], names=["batch", "key"])

    numbered = docs.select(F.pmod(F.xxhash64(text), F.lit(batches)).cast("int").alias("batch"), text)
    return numbered.mapInArrow(run, "batch int, key long")


class SuffixLevels:
    """The levels of sorted suffix keys, each in a table of the shared folder."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes the keys of a batch in; returns those that it has twice or shares with a level."""
        rank, coming, shared = 0, batch, []
        others = [level for _, level in self.levels]
        if not self.levels or self.levels[-1][0] != 0:
            coming = self._sorted(batch)
            shared.append(coming.filter("n > 1"))
        fresh = coming
        while self.levels and self.levels[-1][0] == rank:
            _, level = self.levels.pop()
            others.remove(level)
            coming = self._sorted(level.select("key").union(coming.select("key")))
            shared.append(coming.filter("n > 1"))
            rank += 1
        shared += [fresh.join(level.select("key"), "key", "left_semi") for level in others]
        self.levels.append((rank, coming))
        out = shared[0].select("key")
        for x in shared[1:]:
            out = out.union(x.select("key"))
        return written(out.distinct(), "shared-keys")

    @staticmethod
    def _sorted(rows: DataFrame) -> DataFrame:
        """(key, n) in order; only the keys move."""
        return written(rows.select("key").repartition("key").groupBy("key").agg(F.count("*").alias("n")).sortWithinPartitions("key"), "suffix-level")


def slots_of(keys: DataFrame) -> np.ndarray:
    """A filter of BITS bits over the long columns of `keys`, packed."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BITS, bool)
        for batch in rows:
            found[slot_of(*(batch.column(k).to_numpy().view(np.uint64) for k in range(batch.num_columns)))] = True
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in np.split(np.packbits(found), CHUNKS)], pa.binary())], names=["chunk", "data"])

    bits = fixed_table(keys.mapInArrow(run, "chunk int, data binary"), np.dtype(np.uint8), np.bitwise_or)
    return bits if len(bits) else np.zeros(BITS // 8, np.uint8)


def slot_of(*columns: np.ndarray) -> np.ndarray:
    total = np.zeros(len(columns[0]), np.uint64)
    for x in columns:
        total = mixed(total + x)
    return (total % np.uint64(BITS)).astype(np.int64)


def in_slots(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1


def shared_suffixes(docs: DataFrame, bits: np.ndarray, text: str) -> DataFrame:
    """(text_key, at, key, extension, left, right) of the suffixes whose key the filter has."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(rows):
            found = suffixes_of(_bytes(batch.column(1)))
            keep = in_slots(shared.value, slot_of(found[2]))
            number, at, key, whole, left, right = (x[keep] for x in found)
            columns = [batch.column(0).to_numpy()[number], at, key.view(np.int64), whole.view(np.int64), left.astype(np.int32), right.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["text_key", "at", "key", "extension", "left", "right"])

    return docs.select(F.xxhash64(text).alias("text_key"), text).mapInArrow(run, "text_key long, at long, key long, extension long, left int, right int")


def extensions(docs: DataFrame, classes: DataFrame, text: str) -> DataFrame:
    """(key, extension, before, after, n_classes): the bytes around the key, once for each of `classes` (key, extension, n_classes)."""
    shared = docs.sparkSession.sparkContext.broadcast(slots_of(classes.select("key", "extension")))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _parts(rows):
            out, texts = [], _bytes(batch.column(0))
            number, at, key, whole, left, right = suffixes_of(texts)
            names = whole ^ key
            for k in np.flatnonzero(in_slots(shared.value, slot_of(key, whole))):
                if (name := int(names[k])) not in seen:
                    seen.add(name)
                    data, p = texts[number[k]], int(at[k])
                    out.append((int(np.int64(key[k])), int(np.int64(whole[k])), data[p - int(left[k]) : p], data[p + KEY : p + int(right[k])]))
            if len(seen) > 2_000_000:
                seen.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["key", "extension", "before", "after"])

    found = docs.select(text).mapInArrow(run, "key long, extension long, before binary, after binary")
    return found.dropDuplicates(["key", "extension"]).join(classes, ["key", "extension"])


def strings_around(before: list[bytes], after: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the LENGTH-byte strings around each key, by the bytes taken before it (0 to REACH); and which of them there are."""
    n = len(before)
    data = np.zeros((n, 2 * REACH), np.uint8)
    for k, (b, a) in enumerate(zip(before, after, strict=True)):
        data[k, REACH - len(b) : REACH] = np.frombuffer(b, np.uint8)
        data[k, REACH : REACH + len(a)] = np.frombuffer(a, np.uint8)
    up, down = _powers(2 * REACH)
    sums = np.zeros((n, 2 * REACH + 1), np.uint64)
    np.cumsum(_BYTES[data] * up, axis=1, out=sums[:, 1:])
    j = np.arange(REACH + 1)
    hashes = mixed((sums[:, 2 * REACH - j] - sums[:, REACH - j]) * down[REACH - j] + mixed(keys)[:, None] + mixed(j.astype(np.uint64) + np.uint64(1)))
    lb, la = np.array([len(b) for b in before]), np.array([len(a) for a in after])
    return hashes, (j <= lb[:, None]) & (REACH - j <= la[:, None])


def _own(hashes: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Where a string is found again among all of these."""
    flat = hashes[there]
    order = np.argsort(flat, kind="stable")
    same = flat[order][1:] == flat[order][:-1]
    again = np.zeros(len(flat), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    out = np.zeros(there.shape, bool)
    out[there] = again
    return out


def class_reach(found: DataFrame) -> DataFrame:
    """(key, extension, most, least): the most and the least bytes before the key of a string that another class of the key has too."""
    schema = "key long, extension long, most int, least int"

    def rows_of(keys: np.ndarray, whole: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(again.any(axis=1))
        most = REACH - again[some][:, ::-1].argmax(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(whole[some]), pa.array(most.astype(np.int32)), pa.array(again[some].argmax(axis=1).astype(np.int32))], names=["key", "extension", "most", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def flush(data: pa.Table) -> pa.RecordBatch:
            keys, whole = data.column("key").to_numpy(), data.column("extension").to_numpy()
            hashes, there = strings_around(data.column("before").to_pylist(), data.column("after").to_pylist(), keys.view(np.uint64))
            return rows_of(keys, whole, _own(hashes, there))

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 8192:
                data = pa.Table.from_batches(held)
                keys = data.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))  # rows come sorted: the last key may go on
                if cut:
                    yield flush(data.slice(0, cut))
                held, n = data.slice(cut).to_batches(), n - cut
        if n:
            yield flush(pa.Table.from_batches(held))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                keys, whole = part.column(0).to_numpy(), part.column(1).to_numpy()
                hashes, there = strings_around(part.column(2).to_pylist(), part.column(3).to_pylist(), keys.view(np.uint64))
                i, j = np.nonzero(there)
                yield pa.RecordBatch.from_arrays([pa.array(keys[i]), pa.array(whole[i]), pa.array(hashes[there].view(np.int64)), pa.array(j.astype(np.int32))], names=["key", "extension", "string", "j"])

    columns = ["key", "extension", "before", "after"]
    few = found.filter(F.col("n_classes") <= MOST_CLASSES).select(*columns).repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)
    many = found.filter(F.col("n_classes") > MOST_CLASSES).select(*columns).mapInArrow(spread, "key long, extension long, string long, j int")
    twice = many.groupBy("string").agg(F.count("*").alias("n")).filter("n > 1").select("string")
    return few.union(many.join(twice, "string", "left_semi").groupBy("key", "extension").agg(F.max("j").alias("most"), F.min("j").alias("least")))


def repeated_spans(docs: DataFrame, text: str = "text", batches: int = BATCHES) -> DataFrame:
    """(text_key, spans): of every text with repeats the covered spans of bytes, unmerged; text_key is xxhash64 of the text."""
    docs = in_small_batches(docs.select(F.coalesce(text, F.lit("")).alias("text")))
    keys = batch_keys(docs, "text", batches)
    keys = written(keys, "suffix-keys")
    index, shared = SuffixLevels(docs.sparkSession), []
    for number in range(batches):
        shared.append(index.add(keys.filter(F.col("batch") == number).select("key")))
    every = shared[0]
    for x in shared[1:]:
        every = every.union(x)
    found = written(shared_suffixes(docs, slots_of(every), "text"), "shared-suffixes")
    classes = found.groupBy("key", "extension").agg(F.count("*").alias("n"), F.min(F.struct("text_key", "at")).alias("where"))
    classes = written(classes, "classes")
    per_key = classes.groupBy("key").agg(F.count("*").alias("n_classes"), F.min("n").alias("fewest")).filter("n_classes > 1 AND fewest = 1")
    open_classes = classes.select("key", "extension").join(per_key.select("key", "n_classes"), "key")
    reach = class_reach(extensions(docs, open_classes, "text"))
    single = classes.filter("n = 1").join(reach, ["key", "extension"]).select(F.col("where.text_key").alias("text_key"), (F.col("where.at") - F.col("most")).alias("start"), (F.col("where.at") - F.col("least") + LENGTH).alias("stop"))
    several = found.join(classes.filter("n > 1").select("key", "extension"), ["key", "extension"], "left_semi").filter(F.col("left") + F.col("right") >= LENGTH)
    several = several.select("text_key", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("stop"))
    return single.union(several).groupBy("text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((x["start"], x["stop"]) for x in spans or []):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame, text: str = "text", batches: int = BATCHES, texts: bool = True) -> DataFrame:
    """`docs` without `text`, with n_bytes, n_removed, n_spans, kept_sha256 and, if `texts`, kept (the remaining bytes).

    Removed is each byte covered by a LENGTH-byte string that begins anywhere else too, in this or
    another document, overlaps included. Null texts are empty, repeated rows are copies of each other,
    columns with the new names are replaced, an empty table gives no rows. A document's spans, some
    per cent of its bytes in number, are gathered in one row.
    """
    new = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    carried = [c for c in docs.columns if c != text and c.lower() not in new]
    spans = repeated_spans(docs, text, batches)
    keyed = docs.select(*[f"`{c}`" for c in carried], F.coalesce(text, F.lit("")).alias("__text")).withColumn("text_key", F.xxhash64("__text"))
    joined = keyed.join(spans, "text_key", "left").select(*[f"`{c}`" for c in carried], "__text", "spans")
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for said, covered in zip(batch.column(len(carried)), batch.column(len(carried) + 1).to_pylist(), strict=True):
                data, runs = said.as_py().encode(), merged(covered)
                kept, at = [], 0
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                rows.append((len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest if texts else None))
            kept_columns = zip(*rows, strict=True) if rows else [[]] * 5
            made = [pa.array(c, t) for c, t in zip(kept_columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(carried))), *made], names=[*carried, *new])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carried] + ["n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"])
    out = joined.mapInArrow(run, schema)
    return out if texts else out.drop("kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, texts=False)
