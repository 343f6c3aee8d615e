"""Packing by Karmarkar-Karp multiway differencing.

Documents become token ids and an end mark. A document longer than a sequence is cut into full
sequences and a rest; so every piece but full ones is a whole document or a rest. The pieces are
dealt at random into groups of a bounded size, and each group is partitioned into windows of nearly
equal sums: every piece begins as a partial partition of its own, and again and again the two
partial partitions of the largest imbalance merge with their windows in opposite order. A group
begins with as few windows as its tokens need, and gets more whenever a window is over capacity.

Tokens are made once, in one pass without a shuffle; only lengths and checksums travel.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from typing import Any
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.memory import Remembered, in_small_batches
from strandloom.plans.session import table, written

SQL = None
CAPACITY = 4096
END = 2
#: Pieces of a group, on average.
GROUP = 1000
#: Bytes of chunks, letters without marks among them, whose ids a worker remembers.
KNOWN = 108 << 20
PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


class Chunks:
    """chunk between spaces -> its ids as bytes: letters with marks behind them in two steps, all else by the tokenizer."""

    #: Letters, then ASCII marks that the tokenizer always cuts off them; an apostrophe may begin a suffix and isn't one.
    LETTERS = re.compile(r"([^\W\d_]+)([.,!?;:#$%&*|]*)")

    def __init__(self, model: Any) -> None:
        self.model, self.bpe, self.marks = model, model.model, str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})
        self.known = Remembered(self.made, KNOWN)

    def core(self, letters: str) -> bytes:
        """By the model alone, for letters that the normalizer and the splitter would leave as they are."""
        if not letters.isascii():  # ASCII letters stand for themselves
            letters = letters.encode().decode("latin-1").translate(self.marks)
        return self.packed([x.id for x in self.bpe.tokenize(letters)])

    def made(self, chunk: str) -> bytes:
        if chunk.isalpha() and chunk.islower():
            return self.core(chunk)
        found = self.LETTERS.fullmatch(chunk)
        if found and found[2] and found[1].isalpha() and found[1].islower():
            return self.known[found[1]] + self.known[found[2]]
        return self.packed(self.model.encode(chunk, add_special_tokens=False).ids)

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)


def byte_letters() -> list[str]:
    """The printable letter that byte-level tokenizers write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


#: The normalizer and splitter of vocabularies that fold case and never look across white space.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class Encoder:
    """The ids of texts. Where the vocabulary's own rules are WORDWISE, a chunk between spaces is cut once and remembered; by other rules texts are cut whole."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True  # their strings in a text are text
        rules = json.loads(model.to_str())
        self.wordwise = all(rules[k] == v for k, v in WORDWISE.items())
        self.model, self.chunks = model, Chunks(model).known

    def encode(self, text: str, end: int) -> bytes:
        """Ids and the end mark as little-endian unsigned 32-bit numbers."""
        last = np.array([end], "<u4").tobytes()
        low = text.lower()
        if not self.wordwise or not (is_normalized("NFC", text) and is_normalized("NFC", low)) or "\u03a3" in text:
            return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + last
        return b"".join([*map(self.chunks.__getitem__, low.split()), last])


@cache
def encoder(path: str) -> Encoder:
    """A worker keeps its encoder for the next task."""
    return Encoder(path)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, start, length, ids_crc32, doc_tokens) of every piece of every document; null and empty texts have the end mark alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cut = encoder(vocabulary).encode
        for batch in batches:
            at, rows = [], []
            for k, said in enumerate(batch.column(1)):
                ids = cut(said.as_py() or "", end)
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    at.append(k)
                    rows.append((start, len(part) // 4, zlib.crc32(part), n))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=[doc, "start", "length", "ids_crc32", "doc_tokens"])

    return in_small_batches(docs.select(doc, text)).mapInArrow(run, f"`{doc}` {dict(docs.dtypes)[doc]}, {PIECES}")


def differencing(lengths: np.ndarray, windows: int) -> list[list[int]]:
    """Indexes of `lengths` in at most `windows` parts, by multiway differencing.

    A partial partition holds the sums of its windows less the smallest, in falling order, and a node
    for what lies in each, -1 for nothing; windows behind the last that has something are left out.
    Of two merged ones the largest window of one meets the smallest of the other. A node is an item
    or the union of two.
    """
    n = len(lengths)
    if windows <= 1:
        return [list(range(n))]
    first, second, nodes = np.zeros(n, np.int64), np.zeros(n, np.int64), n
    heap = [(-int(x), k, np.array([x], np.int64), np.array([k])) for k, x in enumerate(lengths)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, ga = heapq.heappop(heap)
        _, key, b, gb = heapq.heappop(heap)
        spare = windows - len(a) - len(b)
        if spare >= 0:
            sums, groups = np.concatenate((a, b)), np.concatenate((ga, gb))
        else:
            sums, groups = np.zeros(windows, np.int64), np.full(windows, -1)
            sums[: len(a)], groups[: len(a)] = a, ga
            at = slice(windows - len(b), None)
            sums[at] += b[::-1]
            other, mine = gb[::-1], groups[at]
            both = np.flatnonzero((other >= 0) & (mine >= 0))
            new = np.arange(nodes, nodes + len(both))
            first[new - n], second[new - n] = mine[both], other[both]
            nodes += len(both)
            mine = np.where(mine < 0, other, mine)
            mine[both] = new
            groups[at] = mine
        order = np.argsort(-sums, kind="stable")
        sums, groups = sums[order], groups[order]
        if spare <= 0:
            sums = sums - sums[-1]
        filled = len(groups) - int((groups[::-1] >= 0).argmax())
        heapq.heappush(heap, (-int(sums[0]), key, sums[:filled], groups[:filled]))
    return [_items(int(g), n, first, second) for g in heap[0][3] if g >= 0]


def _items(node: int, n: int, first: np.ndarray, second: np.ndarray) -> list[int]:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if x < n:
            out.append(x)
        else:
            todo += (int(first[x - n]), int(second[x - n]))
    return out


def packed(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Parts of `lengths` whose sums are at most `capacity`, as few as differencing reaches."""
    windows = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        parts = differencing(lengths, windows)
        most = max(int(lengths[p].sum()) for p in parts)
        if most <= capacity or windows >= len(lengths):
            return parts
        windows += max(1, windows * (most - capacity) // (4 * capacity))


def pack(found: DataFrame, capacity: int = CAPACITY, group: int = GROUP, seed: int = 3, n: int | None = None) -> DataFrame:
    """`found` with sequence_id and offset. found: pieces, read twice; columns of these names are replaced.

    A full piece is a sequence. The others are dealt into groups of about `group` pieces by a hash of
    all their columns and of the place they were read from, which spreads repeated rows too.
    """
    own = [c for c in found.columns if c not in ("sequence_id", "offset")]
    found = found.select(*own).withColumn("__id", F.monotonically_increasing_id())
    full = found.filter(F.col("length") >= capacity)
    rest = found.filter(F.col("length") < capacity)
    n_groups = max(1, (rest.count() if n is None else n) // group)
    rest = rest.withColumn("__group", F.pmod(F.xxhash64(F.lit(seed), "__id"), F.lit(n_groups)))
    schema = ", ".join(f"`{c}` {t}" for c, t in rest.drop("__id").dtypes) + ", __part long, offset long"

    def run(data: pa.Table) -> pa.Table:
        data = data.sort_by([("length", "descending"), ("__id", "ascending")])
        lengths = data.column("length").to_numpy()
        part, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, members in enumerate(packed(lengths, capacity)):
            part[members] = k
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        return data.drop_columns(["__id"]).append_column("__part", pa.array(part)).append_column("offset", pa.array(offset))

    windows = rest.groupBy("__group").applyInArrow(run, schema)
    # full pieces take odd ids, windows of groups even ones: a group has fewer than 2^24 windows
    return full.select(*own, (F.col("__id") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).unionByName(
        windows.select(*own, ((F.col("__group") * (1 << 24) + F.col("__part")) * 2).alias("sequence_id"), "offset")
    )


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    cut = written(pieces(table(spark, sf_dir, "documents"), vocabulary_path()), "pieces")
    return pack(cut)
