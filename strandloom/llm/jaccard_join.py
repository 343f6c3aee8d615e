"""Exact near-duplicate join in the metric space of Jaccard distances over word shingles.

Whole documents make bad pivots: nearly all distances are 1, so every boundary window would hold
everything. The pivots of the first level are therefore sets of one shingle. A document is at the
same distance from each of its own shingles and at distance 1 from all others; ties go to the
rarest, which is its Voronoi region. A partner within the threshold may lie in another region only
as far as the triangle inequality lets it miss the document's first shingles, so the document is
replicated to that window of regions: its rarest n - ceil(t n) + 1 shingles. Rarity is by a table
of counts over all documents with a fixed number of slots; any order gives the same links.

Inside a region the pivots are documents, the most central first (those with the fewest shingles
that are rarer than the region's). A pivot is compared with the region's later members, sizes and
positions bounding what an exact comparison could give; what is linked already isn't compared.
A region is split again and again, with four times the pivots each time, until it is one component
or every member has been a pivot. So a group of thousands of copies costs a comparison each with
one pivot, not all pairs.

Sets are identified by 64 bits of their hash, shingles by 64 bits. Two of n different ones collide
with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.memory import in_small_batches
from strandloom.plans.session import shared_dir, table, written

SQL = None
SHINGLE = 5
PERCENT = 80
#: Slots of the table of counts, and bits of the filter of sets that have candidates.
SLOTS, CHUNKS, BITS = 1 << 22, 64, 1 << 23
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles_of(texts: pa.Array, k: int) -> Iterator[list[np.ndarray]]:
    """The sorted distinct shingle hashes of each text, some texts after another; words are hashed one by one, shingles all at once."""
    for begin in range(0, len(texts), 500):
        words = [(x.as_py() or "").encode().lower().split() for x in texts.slice(begin, 500)]
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(ends[-1]))
        whole = max(len(hashes) - k + 1, 0)
        total = np.zeros(whole, np.uint64)
        for j in range(k):
            total = mixed(total + hashes[j : whole + j] + _MIX)
        found = []
        for n, end in zip(sizes.tolist(), ends.tolist(), strict=True):
            if n >= k:
                s = total[end - n : end - k + 1]
                s.sort()
                keep = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                found.append(s[keep])
            else:  # a short text is one shingle of all its words
                one = np.zeros(min(n, 1), np.uint64)
                for h in hashes[end - n : end]:
                    one = mixed(one + h + _MIX)
                found.append(one)
        yield found


def set_key(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


def fixed_table(parts: DataFrame, kind: np.dtype, join: np.ufunc, given: np.dtype | None = None) -> np.ndarray:
    """One table from the tasks' tables: parts has (chunk, data), CHUNKS chunks each, of numbers of kind `given`. The driver gets one table, of fixed size.

    Tables are joined some partitions' at a time, then those, so that no task holds a row of every task.
    """

    def joined(of: np.dtype):
        def run(data: pa.Table) -> pa.Table:
            total = None
            for x in data.column("data"):
                y = np.frombuffer(x.as_py(), of).astype(kind)
                total = y if total is None else join(total, y)
            return pa.table({"chunk": data.column("chunk")[:1], "data": pa.array([total.tobytes()], pa.binary())})

        return run

    some = parts.select("chunk", "data", (F.spark_partition_id() % 16).alias("some")).groupBy("chunk", "some").applyInArrow(joined(given or kind), "chunk int, data binary")
    rows = {r.chunk: r.data for r in some.groupBy("chunk").applyInArrow(joined(kind), "chunk int, data binary").collect()}
    return np.concatenate([np.frombuffer(rows[k], kind) for k in sorted(rows)]) if rows else np.zeros(0, kind)


def sets_and_counts(docs: DataFrame, k: int, doc: str, text: str) -> DataFrame:
    """(doc, set, n) of every document; behind each task's rows those of its table of counts, as (chunk, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.uint32)  # travel as one byte each, 255 for more
        names = [doc, "set", "n", "chunk", "data"]
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            keys, sizes = [], []
            for found in shingles_of(batch.column(1), k):
                keys += map(set_key, found)
                sizes += map(len, found)
                np.add.at(counts, (np.concatenate(found) & np.uint64(SLOTS - 1)).astype(np.int64), np.uint32(1))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if kind is not None:
            parts = np.split(np.minimum(counts, 255).astype(np.uint8), CHUNKS)
            yield pa.RecordBatch.from_arrays([pa.nulls(CHUNKS, kind), pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.int64()), pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    return docs.select(doc, text).mapInArrow(run, f"`{doc}` {dict(docs.dtypes)[doc]}, set long, n long, chunk int, data binary")


def region_members(docs: DataFrame, shared: Broadcast, k: int, percent: int, text: str) -> DataFrame:
    """(region, set, at, n): each set in the window of its rarest shingles; `at` of its shingles are rarer. Each task gives a set once. shared: the frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, often = set(), shared.value
        for batch in batches:
            regions, sets, at, sizes = [], [], [], []
            for s in chain.from_iterable(shingles_of(batch.column(0), k)):
                n = len(s)
                if not n or (key := set_key(s)) in seen:
                    continue
                seen.add(key)
                first = window_of(s, often, percent)
                regions.append(first)
                sets.append(np.full(len(first), key, np.int64))
                at.append(np.arange(len(first), dtype=np.int32))
                sizes.append(np.full(len(first), n, np.int32))
            if regions:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(regions).view(np.int64)), pa.array(np.concatenate(sets)), pa.array(np.concatenate(at)), pa.array(np.concatenate(sizes))], names=["region", "set", "at", "n"])

    return docs.select(text).mapInArrow(run, "region long, set long, at int, n int")


def frequencies(counts: np.ndarray) -> np.ndarray:
    """The logarithms of the counts in 16 bits."""
    return np.round(np.log2(1.0 + counts) * 2000).astype(np.uint16)


def window_of(s: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """The shingles whose regions the set enters: its rarest, in order."""
    return s[np.lexsort((s, often[(s & np.uint64(SLOTS - 1)).astype(np.int64)]))[: len(s) - -(-percent * len(s) // 100) + 1]]


def shingle_sets(docs: DataFrame, wanted: DataFrame, rarity: Broadcast, k: int, percent: int, text: str) -> DataFrame:
    """(set, n, sketch, shingles): the sets of `wanted`, once each. A filter of BITS bits keeps most others from travelling.

    sketch has 16 bits of each shingle of the set's window, sorted.
    """

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BITS, bool)
        for batch in batches:
            found[batch.column(0).to_numpy().view(np.uint64) % np.uint64(BITS)] = True
        parts = np.split(np.packbits(found), CHUNKS)
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "data"])

    shared = docs.sparkSession.sparkContext.broadcast(fixed_table(wanted.mapInArrow(bits, "chunk int, data binary"), np.dtype(np.uint8), np.bitwise_or))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, has = set(), np.unpackbits(shared.value)
        for batch in batches:
            keys, data, sizes, sketches = [], [], [], []
            for s in chain.from_iterable(shingles_of(batch.column(0), k)):
                key = set_key(s)
                if len(s) and key not in seen and len(has) and has[np.uint64(key & (2**64 - 1)) % np.uint64(BITS)]:
                    seen.add(key)
                    keys.append(key)
                    data.append(s.tobytes())
                    sizes.append(len(s))
                    sketches.append(np.sort((window_of(s, rarity.value, percent) >> np.uint64(48)).astype(np.uint16)).tobytes())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(data, pa.binary())], names=["set", "n", "sketch", "shingles"])

    found = docs.select(text).mapInArrow(run, "set long, n long, sketch binary, shingles binary").dropDuplicates(["set"])
    return found.join(wanted, "set", "left_semi")


def in_common(x: np.ndarray, y: np.ndarray) -> int:
    """How many numbers two sorted lists share; where numbers repeat, no fewer than that."""
    both = np.sort(np.concatenate((x, y)), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def compared(pairs: DataFrame, sets: DataFrame, column: str, kind: type, test: Callable[[int, int, int, int, int], bool]) -> DataFrame:
    """The pairs (a, b) that pass test(shared, n of a, n of b, length of a, length of b) of the lists in `column`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n, m in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                p, q = np.frombuffer(x.as_py(), kind), np.frombuffer(y.as_py(), kind)
                keep.append(test(in_common(p, q), n, m, len(p), len(q)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("set").alias("a"), F.col(column).alias("p"), F.col("n").alias("n"))
    right = sets.select(F.col("set").alias("b"), F.col(column).alias("q"), F.col("n").alias("m"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "p", "q", "n", "m").mapInArrow(run, "a long, b long")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold.

    Two sets that are similar share `least` shingles. Of the first n - least + l of each, in one
    order, they share l at least; so windows that share fewer can't be similar, and only the other
    pairs are compared whole.
    """

    def may(shared: int, n: int, m: int, w: int, v: int) -> bool:
        least = -(-percent * (n + m) // (100 + percent))
        return shared >= min(w - (n - least), v - (m - least))

    def are(shared: int, n: int, m: int, w: int, v: int) -> bool:
        return 100 * shared >= percent * (n + m - shared)

    return compared(compared(pairs, sets, "sketch", np.uint16, may), sets, "shingles", np.uint64, are)


def bucketed(rows: DataFrame, key: str) -> tuple[DataFrame, Callable[[], object]]:
    """`rows` as a table in the shared folder in buckets of `key`, so that joins on it don't move it again; and what forgets the table's name."""
    spark = rows.sparkSession
    name = f"strandloom_{uuid.uuid4().hex}"
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name), lambda: spark.sql(f"DROP TABLE IF EXISTS {name}")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a, b): label is the smallest node that can be reached."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        stepped = labels.join(near, labels.node == near.a).select("node", F.least("label", "m").alias("next"), "label")
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("over"))
        moved = written(stepped.join(jump, "next").select("node", F.least("next", "over").alias("label"), F.col("label").alias("was")), "labels")
        labels = moved.select("node", "label")
        if moved.filter("label <> was").isEmpty():
            return labels


def possible(members: DataFrame, percent: int) -> DataFrame:
    """The rows of `members` (region, set, at, n) that could still stand for a similar pair; no row of such a pair's first common region is lost.

    A partner's size is bounded by the place that the region has among the set's shingles, and the two
    windows must share a number of regions that follows from both sizes (see `similar`). A region's
    partner is known exactly where it has two members, and by the least and largest size otherwise.
    """
    whole = Window.partitionBy("region")
    over = 100 + percent
    n, at, c = F.col("n").cast("long"), F.col("at"), F.col("c")
    lo, hi = F.ceil(percent * n / 100), F.least(F.floor(100 * n / percent), F.floor(over * (n - at) / percent - n))
    rows = members.withColumn("__n", F.count("*").over(whole)).withColumn("__lo", F.greatest(lo, F.min("n").over(whole))).withColumn("__hi", F.least(hi, F.max("n").over(whole)))
    other = (F.sum("n").over(whole) - n).cast("long")
    two = F.col("__n") == 2
    rows = rows.withColumn("__lo", F.when(two, F.greatest(lo, other)).otherwise(F.col("__lo"))).withColumn("__hi", F.when(two, F.least(hi, other)).otherwise(F.col("__hi")))
    rows = rows.filter("__n > 1")
    counts = rows.groupBy("set").agg(F.count("*").alias("c"))
    rows = rows.filter("__lo <= __hi").join(counts, "set")
    window = lambda k: k - F.ceil(percent * k / 100) + 1
    least = lambda m: F.ceil(percent * (n + m) / over)
    shared = lambda m: F.least(window(n) - (n - least(m)), window(m) - (m - least(m)))
    # between the ends the bound is no lower, but for what rounding up takes
    needed = F.least(shared(F.col("__lo")), shared(F.col("__hi"))) - 2
    return rows.filter(c >= needed).select("region", "set", "at", "n")


def joined_components(members: DataFrame, sets: DataFrame, percent: int, growth: int = 4) -> DataFrame:
    """(set, label) of every set with a link, after all regions are joined. members: (region, set, at, n, rank), written."""
    spark = members.sparkSession
    labels = None
    low, high = 0, 1
    while not members.isEmpty():
        x, y = members.alias("x"), members.alias("y")
        total = F.col("x.n") + F.col("y.n")
        fits = ((100 + percent) * (F.col("x.n") - F.col("x.at")) >= percent * total) & ((100 + percent) * (F.col("y.n") - F.col("y.at")) >= percent * total)
        pairs = (
            x.filter((F.col("rank") > low) & (F.col("rank") <= high))
            .join(y, (F.col("x.region") == F.col("y.region")) & (F.col("x.rank") < F.col("y.rank")) & (F.col("x.label") != F.col("y.label")) & fits)
            .select(F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b"))
            .distinct()
        )
        links = written(similar(pairs, sets, percent), "links")
        rest = members.filter(F.col("rank") > high)
        if not links.isEmpty():
            new = links
            if labels is not None:
                la, lb = labels.select(F.col("set").alias("a"), F.col("label").alias("la")), labels.select(F.col("set").alias("b"), F.col("label").alias("lb"))
                new = links.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b")
            found = components(new)
            if labels is None:
                labels = found.select(F.col("node").alias("set"), "label")
            else:
                old = labels.join(found.withColumnRenamed("label", "to"), labels.label == found.node, "left").select("set", F.coalesce("to", "label").alias("label"))
                fresh = found.join(labels, found.node == labels.set, "left_anti").select(F.col("node").alias("set"), "label")
                labels = written(old.union(fresh), "labels")
            rest = rest.drop("label").join(labels, "set", "left").withColumn("label", F.coalesce("label", "set"))
        # a region in which all that is left has one label needs no more
        open_regions = rest.groupBy("region").agg(F.min("label").alias("l"), F.max("label").alias("m")).filter("l <> m").select("region")
        members = written(rest.join(open_regions, "region", "left_semi"), "members")
        low, high = high, high * growth + 1
    return labels if labels is not None else spark.createDataFrame([], "set long, label long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_shingles, set, component_id) per row of `docs`; component_id is the smallest id that links reach.

    Words are what lies between ASCII white space, A-Z in lower case. Documents with equal sets are
    one; fewer than k words make one shingle; a document without words has no shingle and is linked
    with nothing. Repeated rows are kept, null ids never become a component's name unless all are
    null, other columns are ignored, an empty table gives no rows.
    """
    docs = in_small_batches(docs.select(doc, text))
    both = written(sets_and_counts(docs, k, doc, text), "sets")
    counts = fixed_table(both.filter("chunk IS NOT NULL"), np.dtype(np.uint32), np.add, np.dtype(np.uint8))
    known = both.filter("chunk IS NULL").select(doc, "set", "n")
    order = Window.partitionBy("region").orderBy(F.col("at") / F.col("n"), "set")
    counts = counts if len(counts) else np.zeros(SLOTS, np.uint32)
    often = docs.sparkSession.sparkContext.broadcast(frequencies(counts))
    members = region_members(docs, often, k, percent, text)
    members = members.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("set").over(order))
    shared = written(members.filter("rank > 1 OR next IS NOT NULL").drop("rank", "next"), "shared-regions").dropDuplicates(["region", "set"])
    shared = possible(shared, percent)
    shared = shared.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("set").over(order))
    shared = written(shared.filter("rank > 1 OR next IS NOT NULL").drop("next").withColumn("label", F.col("set")), "members")
    sets, dropped = bucketed(shingle_sets(docs, shared.select("set").distinct(), often, k, percent, text), "set")
    labels = joined_components(shared, sets, percent)
    dropped()
    named = known.join(labels, "set", "left").withColumn("label", F.coalesce("label", "set"))
    named = written(named, "labelled")
    least = named.filter("n > 0").groupBy("label").agg(F.min(doc).alias("component_id"))
    some = named.filter("n > 0").join(least, "label")
    none = named.filter("n = 0").withColumn("component_id", F.col(doc))
    return some.unionByName(none).select(doc, F.col("n").alias("n_shingles"), "set", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
