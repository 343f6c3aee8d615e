"""Window files as a stream in any order: what can't be written yet waits as state, and a marker says when all is there.

Windows of a record come in whatever order their files do. One that isn't next waits in the state, which
is kept by groups of records, and is let out as soon as those before it have come; so files in any order give what
one batch gives. A record of which too many windows wait gives up on those that are missing, says so,
and goes on. maxFilesPerTrigger bounds what a trigger takes in, and the number that may wait bounds the
state; a task holds the state of one group. (Timers by the clock would do too, but with them a
run over what is available never ends.)
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandloom.sources.files import Violation

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = T.StructType([T.StructField("chrom_id", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("chrom_window_index", "write_start", "write_end")], T.StructField("problem", T.StringType())])
_AT = T.StructType([T.StructField("chrom_id", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("reached", "next", "last", "n")]])
_WINDOW = T.StructType([T.StructField("chrom_id", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("i", "center_start", "center_end", "chrom_length")]])
#: Groups of records; a group's state is read and written at once, not window by window.
BUCKETS = 1024


class InOrder(StatefulProcessor):
    """State of a group of records: how far each is written, which window is next, the largest one that came, how many wait, and the windows that wait."""

    def __init__(self, most_waiting: int) -> None:
        self.most_waiting = most_waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getListState("at", _AT)
        self.waiting = handle.getListState("waiting", _WINDOW)

    def _released(self, name: str, held: dict, reached: int, following: int) -> tuple[list[Row], int, int]:
        """Windows that are next, one after another, and where that leads to."""
        out = []
        while following in held:
            start, stop, length = held.pop(following)
            begin, end = max(start, reached), min(stop, length)
            out.append(Row(chrom_id=name, chrom_window_index=following, write_start=begin, write_end=end, problem="gap" if start > reached else None))
            reached, following = max(reached, end), following + 1
        return out, reached, following

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at = {name: tuple(rest) for name, *rest in self.at.get()} if self.at.exists() else {}
        waiting: dict[str, dict] = {}
        for name, i, *window in self.waiting.get() if self.waiting.exists() else ():
            waiting.setdefault(name, {})[i] = tuple(window)
        changed = set()
        for r in rows:
            name, i = r.chrom_id, r.chrom_window_index
            reached, following, last, n = at.get(name, (0, 0, -1, 0))
            held = waiting.setdefault(name, {})
            if i < following or i in held:
                yield Row(chrom_id=name, chrom_window_index=i, write_start=r.center_start, write_end=min(r.center_end, r.chrom_length), problem="came before or too late")
                continue
            held[i] = (r.center_start, r.center_end, r.chrom_length)
            at[name] = (reached, following, max(last, i), n + 1)
            changed.add(name)
        for name in changed:
            (reached, following, last, n), held = at[name], waiting[name]
            out, reached, following = self._released(name, held, reached, following)
            yield from out
            n -= len(out)
            while n > self.most_waiting:
                while following not in held:
                    yield Row(chrom_id=name, chrom_window_index=following, write_start=reached, write_end=reached, problem="missing")
                    following += 1
                out, reached, following = self._released(name, held, reached, following)
                yield from out
                n -= len(out)
            at[name] = (reached, following, last, n)
        for state, found in ((self.at, [(name, *x) for name, x in at.items()]), (self.waiting, [(name, i, *x) for name, held in waiting.items() for i, x in held.items()])):
            if found:
                state.put(found)
            else:
                state.clear()

    def close(self) -> None:
        pass


def in_order(windows: DataFrame, most_waiting: int = 100_000) -> DataFrame:
    """A stream of windows (chrom_id, chrom_length, chrom_window_index, center_start, center_end) to what each one writes, or what is wrong with it.

    A window that comes twice or after it was given up is told and changes nothing. The session must
    keep state in RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    chosen = windows.select(F.pmod(F.xxhash64("chrom_id"), F.lit(BUCKETS)).alias("bucket"), "chrom_id", "chrom_length", "chrom_window_index", "center_start", "center_end")
    return chosen.groupBy("bucket").transformWithState(InOrder(most_waiting), OUT, "Append", "None")


def ingest(spark: SparkSession, source: str, target: str, marks: str, listed: DataFrame, files_per_trigger: int = 100, most_waiting: int = 100_000) -> None:
    """Takes the window files of `source` in, as many a trigger as said, writes what they cover below `target`, and marks it complete once all listed windows (chrom_id, num_windows) are written.

    Each trigger's rows are a folder of their own, written over if the trigger is repeated. What is
    missing or wrong in the end is an error, and the marker stays away; the next call goes on from the
    checkpoint `marks`.
    """
    conf, kept = spark.conf, {}
    for name, value in (("spark.sql.streaming.stateStore.providerClass", PROVIDER), ("spark.sql.shuffle.partitions", str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)))):
        kept[name] = conf.get(name, None)
        conf.set(name, value)
    try:
        schema = spark.read.parquet(source).schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)

        def write(rows: DataFrame, batch: int) -> None:
            rows.write.mode("overwrite").parquet(f"{target}/written/batch={batch}")

        in_order(stream, most_waiting).writeStream.foreachBatch(write).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in kept.items():
            conf.unset(name) if value is None else conf.set(name, value)
    rows = read(spark, target)
    held = rows.groupBy("chrom_id").agg(F.count_if(F.col("problem").isNull()).alias("n"), F.max("problem").alias("problem"))
    wrong = listed.join(held, "chrom_id", "full").filter("problem IS NOT NULL OR n IS NULL OR num_windows IS NULL OR n <> num_windows").select("chrom_id", "num_windows", "n", "problem").limit(3).collect()
    if wrong:
        raise Violation(f"{target} is incomplete: {[r.asDict() for r in wrong]}")
    rows.groupBy("chrom_id").agg(F.count("*").alias("num_windows")).write.mode("overwrite").parquet(f"{target}/complete")


def read(spark: SparkSession, target: str) -> DataFrame:
    """What has been written so far below `target`."""
    return spark.read.schema(OUT).parquet(f"{target}/written").select(*OUT.fieldNames())
