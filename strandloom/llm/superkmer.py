"""Removal of passages that repeat an earlier document, by super-k-mer partitioning of word windows.

A window is WINDOW consecutive words of one document; its minimiser is the smallest hash of the runs
of MINIMISER words in it. Equal windows have equal minimisers, so a minimiser names the bucket in
which all of its windows meet. Consecutive windows with the same minimiser travel there as one packed
string, their words joined by one space, which holds each word once instead of once for each window.

Only minimisers that two documents have are of use. A first pass over the texts finds them, and its
outcome, a table of bits of fixed size, lets the second pass keep the others at home. The table lets
more through as it fills up and loses nothing.

Equal strings are pre-aggregated to the smallest and the largest document that has them, so that
copies travel once for each task. In its bucket, all windows of the strings are sorted: ranks of runs
of 1, 2, 4, 8, ... words are made by sorting pairs of ranks, up to the whole window. Words are compared
by themselves, not by hashes. A window's first document is the smallest one of its equals. A bucket
with more than SPLIT different strings is split by the windows themselves (128 bits of their hash),
pre-aggregated too; there as well each window finds its smallest document.

What a string learns goes back to every place where it stands, and places whose document is larger
than a window's first one lose the window's words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.decontaminate import shingle_hashes
from strandloom.llm.memory import in_small_batches
from strandloom.llm.suffix_index import in_slots, merged, slot_of, slots_of, window_minimum
from strandloom.plans.session import table, written

WINDOW, MINIMISER = 50, 10
#: Different strings of a bucket that a task sorts in memory; larger buckets are split by their windows.
SPLIT = 500
#: Words that a task sorts at a time, besides a whole bucket's.
SORTED = 1 << 19
LAST = np.iinfo(np.int64).max
_RUNS = "array<struct<k:int,stop:int,first:long>>"
_RUNS_ARROW = pa.list_(pa.struct([("k", pa.int32()), ("stop", pa.int32()), ("first", pa.int64())]))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: runs of anything but space, tab, line feed, vertical tab, form feed and carriage return."""
    return (text or "").encode().split()


def minimisers(texts: list[list[bytes]], window: int, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, minimiser, first window, windows) of the super-k-mers of each text that has a window; all words are hashed together."""
    sizes = [len(w) for w in texts]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(texts)), np.uint64, sum(sizes))
    runs = shingle_hashes(hashes, size)
    begin = 0
    for k, n in enumerate(sizes):
        if n >= window:
            low = window_minimum(runs[begin : begin + n - size + 1], window - size + 1)
            first = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
            yield k, low[first].view(np.int64), first, np.diff(np.append(first, len(low)))
        begin += n


def _pieces(batch: pa.RecordBatch, column: int, words: int = 1 << 18) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The row where some texts begin, and their words: so many words at a time, or one text."""
    begin, held, n = 0, [], 0
    for k in range(batch.num_rows):
        held.append(words_of(batch.column(column)[k].as_py()))
        n += len(held[-1])
        if n >= words:
            yield begin, held
            begin, held, n = k + 1, [], 0
    if held:
        yield begin, held


def shared_minimisers(docs: DataFrame, window: int, size: int) -> DataFrame:
    """(minimiser) of those that two documents have. docs: (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for begin, texts in _pieces(batch, 1):
                found = [(np.unique(m), ids[begin + k]) for k, m, _, _ in minimisers(texts, window, size)]
                if found:
                    owner = np.repeat(np.array([d for _, d in found], np.int64), [len(m) for m, _ in found])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([m for m, _ in found])), pa.array(owner)], names=["minimiser", "id"])

    owners = docs.select("id", "text").mapInArrow(run, "minimiser long, id long")
    return owners.groupBy("minimiser").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("minimiser")


def super_kmers(docs: DataFrame, bits: np.ndarray, window: int, size: int) -> DataFrame:
    """(id, text_key, start, windows, minimiser, packed) of the super-k-mers whose minimiser the filter has. docs: (id, text_key, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _pieces(batch, 2):
                row, starts, counts, names, packed = [], [], [], [], []
                for k, low, first, n in minimisers(texts, window, size):
                    keep = np.flatnonzero(in_slots(shared.value, slot_of(low.view(np.uint64))))
                    for a, c in zip(first[keep].tolist(), n[keep].tolist(), strict=True):
                        packed.append(b" ".join(texts[k][a : a + c + window - 1]))
                    row += [begin + k] * len(keep)
                    starts.append(first[keep])
                    counts.append(n[keep])
                    names.append(low[keep])
                if row:
                    place = pa.array(row)
                    made = [pa.array(np.concatenate(starts)), pa.array(np.concatenate(counts)), pa.array(np.concatenate(names)), pa.array(packed, pa.binary())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), *made], names=["id", "text_key", "start", "windows", "minimiser", "packed"])

    return docs.select("id", "text_key", "text").mapInArrow(run, "id long, text_key long, start long, windows long, minimiser long, packed binary")


def sorted_windows(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, class) of every window of the strings, in order; equal windows have equal classes. Sorting only, no hashes."""
    said = [s.split(b" ") for s in strings]
    sizes = np.array([len(w) for w in said])
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in chain.from_iterable(said)), np.int64, int(sizes.sum()))
    span = 1
    while span < window:
        step = min(span, window - span)  # the last pair overlaps
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        span += step
    ends = np.cumsum(sizes)
    inside = np.zeros(len(rank), bool)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(rank)]
    inside[:] = np.arange(len(rank)) + window <= ends[owner]
    return owner[inside], rank[inside]


def runs_of(owner: np.ndarray, first: np.ndarray, n: int) -> list[list[tuple[int, int, int]]]:
    """For each of n strings its windows' first documents, as runs (window, stop, first)."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    if len(owner):
        begin = np.concatenate(([0], np.flatnonzero((owner[1:] != owner[:-1]) | (first[1:] != first[:-1])) + 1))
        stop = np.append(begin[1:], len(owner))
        base = np.searchsorted(owner, np.arange(n))
        for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
            k = int(owner[a])
            out[k].append((a - int(base[k]), b - int(base[k]), int(first[a])))
    return out


def bucket_firsts(strings: DataFrame, window: int) -> DataFrame:
    """(minimiser, name, runs): the smallest document of each window of each string, bucket by bucket. strings: (minimiser, name, packed, least, most).

    Strings all of whose places are at their windows' first documents are left out.
    """

    def work(data: pa.Table) -> pa.RecordBatch:
        owner, rank = sorted_windows(data.column("packed").to_pylist(), window)
        least, most = data.column("least").to_numpy(), data.column("most").to_numpy()
        first = np.full(int(rank.max(initial=-1)) + 1, LAST, np.int64)
        np.minimum.at(first, rank, least[owner])
        late = np.zeros(data.num_rows, bool)
        np.logical_or.at(late, owner, first[rank] < most[owner])
        runs = runs_of(owner, first[rank], data.num_rows)
        keep = np.flatnonzero(late)
        return pa.RecordBatch.from_arrays(
            [*(data.column(c).take(pa.array(keep)).combine_chunks() for c in ("minimiser", "name")), pa.array([runs[k] for k in keep], _RUNS_ARROW)], names=["minimiser", "name", "runs"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:  # rows come sorted by minimiser
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                held.append(part)
                n += sum(x.as_py().count(b" ") + 1 for x in part.column(2))
                if n >= SORTED:
                    data = pa.Table.from_batches(held)
                    keys = data.column("minimiser").to_numpy()
                    cut = int(np.searchsorted(keys, keys[-1]))
                    if cut:
                        yield work(data.slice(0, cut))
                        held = data.slice(cut).to_batches()
                        n = sum(x.as_py().count(b" ") + 1 for b in held for x in b.column(2))
        if held:
            yield work(pa.Table.from_batches(held))

    return strings.select("minimiser", "name", "packed", "least", "most").repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(run, f"minimiser long, name long, runs {_RUNS}")


def split_firsts(strings: DataFrame, window: int) -> DataFrame:
    """What bucket_firsts gives, for buckets of any size: windows go to places of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                owner, k, digests = [], [], []
                for row, packed in enumerate(part.column(2)):
                    words = packed.as_py().split(b" ")
                    for j in range(len(words) - window + 1):
                        digests.append(xxhash.xxh3_128_digest(b" ".join(words[j : j + window])))
                        k.append(j)
                        owner.append(row)
                place = pa.array(owner, pa.int64())
                columns = [part.column(c).take(place) for c in (0, 1, 3, 4)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(k, pa.int32()), pa.array(digests, pa.binary())], names=["minimiser", "name", "least", "most", "k", "window"])

    windows = strings.select("minimiser", "name", "packed", "least", "most").mapInArrow(run, "minimiser long, name long, least long, most long, k int, window binary")
    windows = written(windows, "split-windows")
    # written, so that a window of many strings is no more than one large key of a join that Spark splits
    firsts = written(windows.groupBy("window").agg(F.min("least").alias("first"), F.max("most").alias("last")).filter("first < last").select("window", "first"), "split-firsts")
    found = windows.join(firsts, "window").filter("first < most").select("minimiser", "name", "k", "first")
    string = Window.partitionBy("minimiser", "name", "first").orderBy("k")
    runs = found.withColumn("run", F.col("k") - F.row_number().over(string)).groupBy("minimiser", "name", "first", "run").agg(F.min("k").alias("k"), (F.max("k") + 1).alias("stop"))
    return runs.groupBy("minimiser", "name").agg(F.sort_array(F.collect_list(F.struct("k", "stop", "first"))).cast(_RUNS).alias("runs"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, size: int = MINIMISER, split: int = SPLIT) -> DataFrame:
    """(id, text_key, spans): of every document with words to remove, the spans of words, unmerged. docs: (id, text_key, text)."""
    bits = slots_of(shared_minimisers(docs, window, size))
    places = written(super_kmers(docs, bits, window, size), "super-kmers")
    name = F.xxhash64("packed")
    strings = places.groupBy("minimiser", "packed").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    strings = written(strings.withColumn("name", name), "super-kmer-strings")
    sizes = strings.groupBy("minimiser").agg(F.count("*").alias("n"), F.min("least").alias("low"), F.max("most").alias("high"))
    sizes = written(sizes.filter("low < high").select("minimiser", "n"), "super-kmer-buckets")
    few, many = (strings.join(sizes.filter(c).select("minimiser"), "minimiser", "left_semi") for c in (f"n <= {split}", f"n > {split}"))
    firsts = written(bucket_firsts(few, window).union(split_firsts(many, window)), "window-firsts")
    known = places.select("id", "text_key", "start", "minimiser", name.alias("name"))
    joined = known.join(firsts, ["minimiser", "name"])
    late = F.filter("runs", lambda r: r["first"] < F.col("id"))
    spans = F.transform(late, lambda r: F.struct((F.col("start") + r["k"]).alias("start"), (F.col("start") + r["stop"] + (window - 1)).alias("stop")))
    return joined.select("id", "text_key", F.explode(spans).alias("span")).groupBy("id", "text_key").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW, size: int = MINIMISER, split: int = SPLIT) -> DataFrame:
    """`docs` without `text`, with n_words, n_removed and kept (the remaining words, joined by one space).

    Removed is each word covered by a window whose words also begin in a document with a smaller id;
    all windows are judged on the input. Ids are whole numbers; rows without an id come after all
    others, and neither they nor rows with the same id take words from each other. Null and empty
    texts have no words, texts of fewer than `window` words lose none, repeated rows stay and lose the
    same. Columns with the new names are replaced, others stay, an empty table gives no rows. A very
    long text is one row of its task, and its spans are gathered in one row.
    """
    new = ("n_words", "n_removed", "kept")
    carried = [c for c in docs.columns if c != text and c.lower() not in new]
    quoted = ["`" + c.replace("`", "``") + "`" for c in carried]
    keyed = in_small_batches(docs).select(
        F.struct(*quoted).alias("row"), F.coalesce(F.col(f"`{doc}`").cast("long"), F.lit(int(LAST))).alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    spans = repeated_spans(keyed, window, size, split)
    joined = keyed.join(spans, ["id", "text_key"], "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, lost, kept = [], [], []
            for said, covered in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = words_of(said.as_py())
                rest, at = [], 0
                for a, b in merged(covered):
                    rest += words[at:a]
                    at = b
                rest += words[at:]
                sizes.append(len(words))
                lost.append(len(words) - len(rest))
                kept.append(b" ".join(rest).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], names=["row", *new])

    schema = T.StructType([joined.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return joined.mapInArrow(run, schema).select("row.*", *new)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to passages of earlier ones."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT id, doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS s FROM (SELECT id, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
first AS (SELECT s, min(coalesce(doc_id, {LAST})) AS least FROM win GROUP BY s),
hit AS (SELECT DISTINCT id, unnest(range(i, i + {WINDOW})) AS p FROM win JOIN first USING (s) WHERE least < coalesce(doc_id, {LAST})),
lost AS (SELECT id, list(p) AS gone FROM hit GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
    sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]), ' ') END) AS kept_sha256
FROM d LEFT JOIN lost USING (id)
"""
