"""WARC archives as a Spark data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Reading plans one partition per file. Of every record the headers are parsed first; a record whose
type or headers fail a pushed predicate is skipped by its length, and so is the payload where it
isn't asked for. Compressed files hold one gzip member per record, whose header tells its length
(subfield "sl"), so that skipping needs no inflating; members without it are inflated.

Writing makes files of about ROLL bytes for each task. They count once the job commits: a manifest
lists them, and files of failed or repeated attempts are never read.

Options: path; compression (gzip or none); payload (read payloads, true by default); verify (check
each payload against its digest); types (comma list, as a pushed predicate on record_type).
Paths are opened by pyarrow.fs, so file, hdfs, s3 and gs work where their libraries are there.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from strandloom.plans.session import shared_dir, table

ROLL = 64 << 20
CHUNK = 16 << 10
MANIFEST = "_committed-"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DDL = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary, payload_ok boolean"
ARROW = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary()), ("payload_ok", pa.bool_())])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    found, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else "file://" + path[5:])
    return found, inner


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str | None, refers_to: str | None, digest: str, length: int, payload: bytes, date: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, whose Content-Length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {quote(uri, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    return ("WARC/1.1\r\n" + "\r\n".join([*head, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose header holds its own length and that of the data."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    raw = z.compress(data) + z.flush()
    extra = struct.pack("<2sHII", b"sl", 8, 24 + len(raw) + 8, len(data))
    return struct.pack("<4BIBBH", 0x1F, 0x8B, 8, 4, 0, 0, 255, len(extra)) + extra + raw + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Files(ds.WriterCommitMessage):
    names: list[str]


class WarcWriter(ds.DataSourceArrowWriter):
    """Writes rows of (record_type, record_id, target_uri, refers_to, sha1 in hex, payload)."""

    def __init__(self, path: str, gzip: bool, date: str) -> None:
        self.path, self.gzip, self.date = path, gzip, date

    def write(self, batches: Iterator[pa.RecordBatch]) -> Files:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        names: list[str] = []
        out = None
        for batch in batches:
            for kind, key, uri, refers, sha1, payload in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                    out = store.open_output_stream(f"{root}/{names[-1]}", compression=None)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                data = record(kind, key, uri, refers, digest, len(payload), payload, self.date)
                out.write(member(data) if self.gzip else data)
                if out.tell() >= ROLL:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Files(names)

    def commit(self, messages: list) -> None:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}") as out:
            out.write(json.dumps([x for m in messages if m for x in m.names]).encode())


@dataclass
class FilePart(ds.InputPartition):
    path: str


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.tests: list[tuple[str, str, Any]] = []
        if options.get("types"):
            self.tests.append(("record_type", "in", tuple(x.strip() for x in options["types"].split(","))))

    def pushFilters(self, filters: list) -> Iterator:
        """Takes equality, membership, prefix and length predicates on what the headers hold; Spark keeps the rest."""
        for x in filters:
            column = x.attribute[0] if getattr(x, "attribute", None) and len(x.attribute) == 1 else None
            kind = {ds.EqualTo: "=", ds.In: "in", ds.StringStartsWith: "starts", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<=", ds.IsNotNull: "set"}.get(type(x))
            if kind is None or column not in ("record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_length"):
                yield x
            else:
                self.tests.append((column, kind, tuple(x.value) if kind == "in" else getattr(x, "value", None)))

    def partitions(self) -> list[FilePart]:
        """The committed files, or every archive below the path where no manifest is."""
        store, root = opened(self.path)
        infos = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        host = self.path[len(scheme) :].split("/")[0] if scheme and scheme != "file://" else ""
        full = (lambda p: f"file://{p}") if scheme in ("", "file://") else (lambda p: f"{scheme}{host}/{p.lstrip('/')}" if host and not p.startswith(host) else f"{scheme}{p}")
        listed = [i.path for i in infos if i.is_file and i.base_name.startswith(MANIFEST)]
        if listed:
            kept = []
            for p in sorted(listed):
                with store.open_input_stream(p) as f:
                    kept += [f"{p.rpartition('/')[0]}/{x}" for x in json.loads(f.read())]
        else:
            kept = sorted(i.path for i in infos if i.is_file and i.base_name.endswith((".warc", ".warc.gz")))
        return [FilePart(full(p)) for p in kept]

    def accepts(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            x = row[column]
            if x is None or not {"=": lambda: x == value, "in": lambda: x in value, "starts": lambda: x.startswith(value), ">": lambda: x > value, ">=": lambda: x >= value, "<": lambda: x < value, "<=": lambda: x <= value, "set": lambda: True}[kind]():
                return False
        return True

    def read(self, part: FilePart | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        store, path = opened(part.path)
        rows, held = [], 0
        with store.open_input_file(path) as f:
            for head, body in (gzip_records if path.endswith(".gz") else plain_records)(f):
                row = parsed(head)
                if row is None:
                    continue
                if row["payload_length"] is None:
                    row["payload_length"] = http_length(body(False))
                if not self.accepts(row):
                    continue
                payload = None
                if (self.payload or self.verify) and row["record_type"] == "response":
                    payload = body(True).partition(b"\r\n\r\n")[2]
                    row["payload_ok"] = base32_sha1(payload) == row["payload_digest"] if self.verify else None
                row["payload"] = payload if self.payload else None
                rows.append(row)
                held += len(payload or b"") if self.payload else 0
                if len(rows) >= 4096 or held >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


def parsed(head: bytes) -> dict | None:
    """The row that a record's headers give; None for warcinfo and other records without an id."""
    lines = head.decode(errors="replace").split("\r\n")
    found = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if "warc-record-id" not in found:
        return None
    return {
        "record_type": found.get("warc-type"), "record_id": found["warc-record-id"].strip("<>"), "target_uri": found.get("warc-target-uri"),
        "refers_to": found["warc-refers-to"].strip("<>") if "warc-refers-to" in found else None,
        "payload_digest": found["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in found else None,
        "payload_length": None, "payload": None, "payload_ok": None,
    }


def http_length(block: bytes) -> int | None:
    head = block.partition(b"\r\n\r\n")[0].lower()
    at = head.find(b"content-length:")
    return int(head[at + 15 :].split(b"\r\n")[0]) if at >= 0 else None


def content_length(head: bytes) -> int:
    at = head.lower().find(b"\r\ncontent-length:")
    return int(head[at + 17 :].split(b"\r\n")[0]) if at >= 0 else 0


def plain_records(f: pa.NativeFile) -> Iterator[tuple]:
    """(headers, body) of each record; body(True) is the whole block, body(False) its beginning."""
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        data = f.read(CHUNK)
        while (end := data.find(b"\r\n\r\n")) < 0:
            more = f.read(CHUNK)
            if not more:
                return
            data += more
        n, begins = content_length(data[:end]), end + 4

        def body(whole: bool, at: int = at, data: bytes = data, begins: int = begins, n: int = n) -> bytes:
            if not whole or begins + n <= len(data):
                return data[begins : begins + n]
            f.seek(at + begins)
            return f.read(n)

        yield data[:end], body
        at += begins + n + 4


def gzip_records(f: pa.NativeFile) -> Iterator[tuple]:
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        data = f.read(CHUNK)
        length = struct.unpack("<I", data[16:20])[0] if data[3:4] == b"\x04" and data[12:14] == b"sl" else None
        z = zlib.decompressobj(31)
        text = z.decompress(data, CHUNK)
        while text.find(b"\r\n\r\n") < 0 and not z.eof:
            more = z.unconsumed_tail or f.read(CHUNK)
            if not more:
                return
            text += z.decompress(more, CHUNK)
        end = text.find(b"\r\n\r\n")
        n, state = content_length(text[:end]), {"text": text}

        def inflate(z: Any = z, state: dict = state) -> None:
            rest = [state["text"]]
            while not z.eof:
                more = z.unconsumed_tail or f.read(CHUNK)
                if not more:
                    break
                rest.append(z.decompress(more))
            state["text"], state["end"] = b"".join(rest), f.tell() - len(z.unused_data)

        def body(whole: bool, begins: int = end + 4, n: int = n, state: dict = state, inflate: Any = inflate) -> bytes:
            if whole and "end" not in state:
                inflate()
            return state["text"][begins : begins + n]

        yield text[:end], body
        if length is None and "end" not in state:
            inflate()
        at = at + length if length else state["end"]


class WarcSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return DDL

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("compression", "gzip") == "gzip", self.options.get("date", "2020-01-01T00:00:00Z"))


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The rows that the writer takes, with one response for equal payloads of at least `least_bytes`, and revisits.

    The response is the one with the largest page_id; rows that tie for it, repeated rows among them,
    are responses all. Null html is an empty payload, a null url gives no target, a null page_id
    is below every other. Only digests and ids are grouped; the payload moves in one join, which Spark
    splits where many pages share a payload.
    """
    known = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    known = known.withColumn("sha1", F.sha1("payload"))
    small = F.octet_length("payload") < least_bytes
    chosen = known.filter(~small).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = known.join(chosen, "sha1", "left")
    revisit = ~small & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), name(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"),
        F.when(revisit, name(F.col("first"))).alias("refers_to"), "sha1", "payload",
    )


def write_pages(pages: DataFrame, path: str, compression: str = "gzip", least_bytes: int = 0) -> None:
    """Archives of `pages` (page_id, url, html) below `path`."""
    pages.sparkSession.dataSource.register(WarcSource)
    page_records(pages, least_bytes).write.format("warc").option("compression", compression).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The records below `path`. Pushing predicates into Python sources is off by default in a session; this turns it on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives in the shared folder and read back, payloads checked against their digests."""
    path = f"{shared_dir(spark)}/strandloom-warc-{uuid.uuid4().hex}"
    write_pages(table(spark, sf_dir, "pages"), path)
    back = read_warc(spark, path, payload="false", verify="true")
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as long)")
    return back.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"), "payload_ok")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, html, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
    translate(array_to_string(list_transform(range(0, 8), lambda i: to_base(('0x' || substr(h, (5 * i + 1)::INT, 5))::BIGINT, 32, 4)), ''),
        '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to,
    CASE WHEN page_id = first THEN true END AS payload_ok
FROM q
"""
