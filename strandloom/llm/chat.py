"""Prefix-target expansion of conversations.

Every assistant turn becomes an example of its own: the turns before it are context, and only that
reply is trainable. The loss mask is a list of code point spans of the example's text. Turns after
the last reply, or a conversation without one, make a last record without a trainable span, so that
no turn is lost.

A turn reads <|turn|>role, a line feed, the text, <|end|> and a line feed. Inside roles and texts
every character that could begin a control string is escaped; `unescaped` undoes it exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.plans.session import table

#: Escapes, in the order in which they are made; undone in the opposite order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
TURN, END = "<|turn|>", "<|end|>\n"
BATCH_BYTES = 4 << 20
SCHEMA = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("n_turns", pa.int64()), ("text", pa.large_string()), ("loss_from", pa.int64()), ("loss_to", pa.int64()), ("whole", pa.bool_())])
DDL = "conv_id long, example long, n_turns long, text string, loss_from long, loss_to long, whole boolean"


def escaped(text: str) -> str:
    for a, b in ESCAPES:
        text = text.replace(a, b)
    return text


def unescaped(text: str) -> str:
    for a, b in reversed(ESCAPES):
        text = text.replace(b, a)
    return text


def segment(role: str, text: str) -> tuple[str, int]:
    """A formatted turn, and where its text begins in it."""
    head = f"{TURN}{escaped(role).replace(chr(10), '&#10;')}\n"
    return f"{head}{escaped(text)}{END}", len(head)


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, read back from a formatted conversation."""
    for part in text.split(TURN)[1:]:
        role, _, body = part.partition("\n")
        yield unescaped(role.replace("&#10;", "\n")), unescaped(body[: -len(END)])


def _examples(conv_id: int | None, turns: Iterable[tuple[str, str]]) -> Iterator[tuple]:
    """One record for each reply, and one for what follows the last of them; the last record is whole."""
    parts: list[str] = []
    chars = made = 0
    held = None
    for role, text in turns:
        if held:
            yield (*held, False)
            held = None
        part, begins = segment(role, text)
        parts.append(part)
        if role == "assistant":
            held = conv_id, made, len(parts), "".join(parts), chars + begins, chars + len(part) - len(END)
            made += 1
        chars += len(part)
    if held:
        yield (*held, True)
    else:
        yield conv_id, made, len(parts), "".join(parts), None, None, True


def expand_prefix_targets(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, text, loss_from, loss_to, whole), in order inside each partition.

    Turns are sorted by turn, then role and text; repeated rows are turns of their own. Null roles
    and texts are empty, a null conv_id is a conversation like any other, further columns are
    ignored, an empty table gives no rows. One shuffle by conv_id; the rows of a conversation are
    streamed from the sort, so that a task holds one conversation's text and not its examples.
    `whole` marks a conversation's last record, which has all of its turns.
    """
    cols = [F.col("conv_id").cast("long"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")]
    ordered = conversations.select(*cols).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((c, r, t) for b in batches for c, r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
        out, size = [], 0
        for example in (x for conv, turns in _runs(rows) for x in _examples(conv, turns)):
            out.append(example)
            size += len(example[3])
            if size >= BATCH_BYTES:
                yield _batch(out, SCHEMA)
                out, size = [], 0
        if out:
            yield _batch(out, SCHEMA)

    return ordered.mapInArrow(run, DDL)


def _runs(rows: Iterator[tuple]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """Groups of neighbouring rows that have the same first value, each read as it comes."""
    from itertools import groupby

    for key, group in groupby(rows, key=lambda r: r[0]):
        yield key, (r[1:] for r in group)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, what its records hold when they are read back: turns from the whole record, trainable text from every mask.

    Reads the records as expand_prefix_targets leaves them, in order, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, chars = hashlib.sha256(), 0
        for batch in batches:
            out = []
            for conv, _, _, text, start, end, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if start is not None:
                    reply = unescaped(text[start:end])
                    loss.update(reply.encode())
                    chars += len(reply)
                if whole:
                    turns, n = hashlib.sha256(), 0
                    for role, said in turns_of(text):
                        turns.update(f"{role}\n{said}\n".encode())
                        n += 1
                    out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), len(text)))
                    loss, chars = hashlib.sha256(), 0
            if out:
                yield _batch(out, DIGESTS)

    return examples.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold control strings, formatted, expanded and read back."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.explode(F.arrays_zip(F.array(F.lit(0), F.lit(1)).alias("turn"), F.array(F.lit("user"), F.lit("assistant")).alias("role"))).alias("t"),
    ).select("conv_id", F.col("t.turn").cast("long").alias("turn"), "t.role", F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digests(expand_prefix_targets(own.unionByName(hard)))


SQL = """
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
    SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) AS text_chars,
        length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;')) AS role_chars
    FROM t
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(8 + role_chars + 1 + text_chars + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
