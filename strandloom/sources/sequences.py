"""FASTA of any size: files are read in byte ranges, records come as blocks of bases.

Spark reads the lines, so a file is split wherever its blocks are, and any path that Spark opens will do.
A task turns the lines of its range into segments, one for each record that it sees a part of, without
looking at single lines. Which record a range goes on with, and how far that record has come, follows
from the lengths of all segments. A record has no length limit; no row holds more than a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.operators.quality import BLOCK, looked_up
from strandloom.plans.session import written
from strandloom.sources.files import FASTA, Violation, require

MAGIC = b"\x1f\x8b"
_SPACE = b" \t\r\n\x0b\x0c"
_SEGMENT = "file string, start long, segment int, header string, at long, piece string"
_NAMES = [c.split()[0] for c in _SEGMENT.split(", ")]


def _files(spark: SparkSession, path: str) -> list[tuple[str, bytes]]:
    """Every FASTA file of `path` and its first two bytes: a file, the files of a folder with a FASTA name, or those with FASTA names below another folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, listed = [], fs.listFiles(where, True)
    while listed.hasNext():
        status = listed.next()
        name = status.getPath().getName().lower()
        named = path.rstrip("/").lower().removesuffix(".gz").endswith(FASTA) and not name.startswith((".", "_"))
        if named or name.removesuffix(".gz").endswith(FASTA):
            stream = fs.open(status.getPath())
            head = bytes(x for x in (stream.read(), stream.read()) if x >= 0)
            stream.close()
            found.append((status.getPath().toString(), head))
    return found


class _Segments:
    """Lines of one range of a file, put together to pieces of segments."""

    def __init__(self, file: str, start: int, size: int) -> None:
        self.file, self.start, self.size = file, start, size
        self.segment, self.header, self.at, self.held, self.fresh = 0, None, 0, bytearray(), False

    def record(self, header: str) -> list[tuple]:
        done = self.flush()
        self.segment, self.header, self.at, self.fresh = self.segment + 1, header, 0, True
        return done

    def bases(self, data: bytes) -> list[tuple]:
        self.held += data.translate(None, _SPACE).upper()
        out = []
        while len(self.held) >= self.size:
            out.append(self._row(self.size))
        return out

    def _row(self, n: int) -> tuple:
        row = (self.file, self.start, self.segment, self.header, self.at, bytes(self.held[:n]).decode())
        self.at, self.fresh = self.at + n, False
        del self.held[:n]
        return row

    def flush(self) -> list[tuple]:
        """What is left; of a record without bases an empty piece."""
        return [self._row(len(self.held))] if self.held or self.fresh else []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def segments(lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """(file, start, segment, header, at, piece) of lines (value, file, start) in the order of their files: pieces of at most `size` bases. Segment 0 goes on with what an earlier range began."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Segments | None = None
        for batch in batches:
            files, starts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            cuts = [0, *(k for k in range(1, batch.num_rows) if starts[k] != starts[k - 1] or files[k] != files[k - 1]), batch.num_rows]
            rows: list[tuple] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if now is None or (now.file, now.start) != (files[a], starts[a]):
                    rows += now.flush() if now else []
                    now = _Segments(files[a], starts[a], size)
                values = batch.column(0).slice(a, b - a)
                heads = np.flatnonzero(pc.starts_with(values, ">").to_numpy(zero_copy_only=False)).tolist()
                begin = 0
                for k in [*heads, len(values)]:
                    if k > begin:  # the lines' bytes lie next to each other
                        rows += now.bases("".join(values.slice(begin, k - begin).to_pylist()).encode())
                    if k < len(values):
                        rows += now.record(values[k].as_py()[1:])
                    begin = k + 1
            if rows:
                yield _batch(rows)
        if now and (rest := now.flush()):
            yield _batch(rest)

    return lines.select("value", "file", "start").mapInArrow(run, _SEGMENT)


def _unsuffixed(spark: SparkSession, paths: list[str], size: int) -> DataFrame:
    """Segments of gzip files that aren't named so; each is one range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                now, rest, line = _Segments(file, 0, size), memoryview(content.as_buffer()), b""
                while len(rest):
                    member, used = zlib.decompressobj(31), 0
                    while not member.eof:
                        part = rest[used : used + (1 << 20)]
                        if not len(part):
                            raise ValueError(f"{file} ends inside a gzip member")
                        used += len(part)
                        *whole, line = (line + member.decompress(part)).split(b"\n")
                        rows = [r for x in whole for r in (now.record(x[1:].decode()) if x.startswith(b">") else now.bases(x))]
                        if rows:
                            yield _batch(rows)
                    rest = rest[used - len(member.unused_data) :]
                rows = [*(now.record(line[1:].decode()) if line.startswith(b">") else now.bases(line)), *now.flush()]
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, _SEGMENT)


def blocks(spark: SparkSession, path: str, size: int = BLOCK, strict: bool = True) -> DataFrame:
    """(chrom_id, block, piece, length) of all records below `path`: pieces of `size` bases in upper case, the last one shorter; length is the record's.

    Compression is told by the files' first bytes; a .gz that isn't gzip is an error. If `strict`, so are
    bases before a file's first header, headers without a name, and names that stand twice. A record
    without bases has one empty piece; an empty file has none.
    """
    found = _files(spark, path)
    false = [name for name, head in found if name.lower().endswith(".gz") and head != MAGIC]
    if false:
        raise Violation(f"not gzip data: {false}")
    hidden = [name for name, head in found if head == MAGIC and not name.lower().endswith(".gz")]
    plain = [name for name, _ in found if name not in hidden]
    if not found:
        raise Violation(f"no FASTA files in {path}")
    parts = []
    if plain:
        lines = spark.read.text(plain).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        parts.append(segments(lines, size))
    if hidden:
        parts.append(_unsuffixed(spark, hidden, size))
    pieces = written(parts[0] if len(parts) == 1 else parts[0].union(parts[1]), "segments")
    listed = written(placed(pieces), "records")
    if strict:
        require(violations(listed), path)
    lengths = listed.groupBy("chrom_id").agg(F.sum("n").alias("length"))
    begin = F.col("offset") + F.col("at")
    cut = pieces.join(listed.select("file", "start", "segment", "chrom_id", "offset"), ["file", "start", "segment"]).select("chrom_id", begin.alias("s"), "piece")
    cut = cut.withColumn("block", F.explode(F.expr(f"sequence(s div {size}, (s + greatest(length(piece) - 1, 0)) div {size})")))
    first = F.greatest(F.col("block") * size - F.col("s"), F.lit(0))
    part = F.substr("piece", (first + 1).cast("int"), F.least((F.col("block") + 1) * size - F.greatest(F.col("s"), F.col("block") * size), F.length("piece").cast("long")).cast("int"))
    # an empty piece behind others says nothing
    held = cut.groupBy("chrom_id", "block").agg(F.array_sort(F.collect_list(F.struct("s", part.alias("piece")))).alias("x"))
    whole = held.select("chrom_id", "block", F.array_join(F.transform("x", lambda v: v["piece"]), "").alias("piece"))
    return whole.join(lengths, "chrom_id").filter((F.col("piece") != "") | (F.col("length") == 0))


def placed(pieces: DataFrame) -> DataFrame:
    """(file, start, segment, record, chrom_id, n, offset): whose segment it is, its bases, and the bases of its record before it. The record of bases before the first header is 0."""
    held = pieces.groupBy("file", "start", "segment").agg(F.max("header").alias("header"), F.sum(F.length("piece")).alias("n"))
    order = Window.partitionBy("file").orderBy("start", "segment").rowsBetween(Window.unboundedPreceding, 0)
    named = held.withColumn("record", F.count("header").over(order)).withColumn("said", F.last("header", ignorenulls=True).over(order))
    own = Window.partitionBy("file", "record").orderBy("start", "segment").rowsBetween(Window.unboundedPreceding, -1)
    return named.select("file", "start", "segment", "record", F.regexp_extract("said", r"^[ \t]*(\S*)", 1).alias("chrom_id"), "n", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("offset"))


def violations(listed: DataFrame) -> DataFrame:
    """(chrom_id, problem) of what `placed` found: bases before the first header, headers without a name, names that stand twice."""
    records = listed.groupBy("file", "record").agg(F.max("chrom_id").alias("chrom_id"), F.sum("n").alias("n"))
    before = records.filter("record = 0 AND n > 0").select(F.col("file").alias("chrom_id"), F.lit("sequence before the first header").alias("problem"))
    names = records.filter("record > 0").groupBy("chrom_id").agg(F.count("*").alias("n"))
    problem = F.when(F.col("chrom_id") == "", "empty header").when(F.col("n") > 1, "duplicate id")
    return before.unionByName(names.select("chrom_id", problem.alias("problem")).filter("problem IS NOT NULL"))


def records(held: DataFrame) -> DataFrame:
    """(chrom_id, chrom_length, seq) of blocks, for records that fit in a row."""
    whole = held.groupBy("chrom_id").agg(F.max("length").alias("chrom_length"), F.array_sort(F.collect_list(F.struct("block", "piece"))).alias("x"))
    return whole.select("chrom_id", "chrom_length", F.array_join(F.transform("x", lambda v: v["piece"]), "").alias("seq"))


def fetched(ranges: DataFrame, held: DataFrame, keys: list[str], size: int = BLOCK) -> DataFrame:
    """`keys` and seq of ranges (keys, seqid, s, e). A range of an unknown record, or one that isn't inside its record, is an error."""
    lengths = held.filter("block = 0").select(F.col("chrom_id").alias("seqid"), "length")
    met = ranges.join(lengths, "seqid", "left")
    problem = F.when(F.col("length").isNull(), "no such record").when((F.col("s") < 0) | (F.col("e") < F.col("s")) | (F.col("e") > F.col("length")), "not inside the record")
    require(met.select(*keys, "seqid", problem.alias("problem")).filter("problem IS NOT NULL"), "ranges")
    found = looked_up(ranges, held, keys, size)
    return ranges.select(*keys).join(found, keys, "left").withColumn("seq", F.coalesce("seq", F.lit("")))
