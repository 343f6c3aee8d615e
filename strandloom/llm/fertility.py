"""Quality rules from how public tokenizers cut a text.

A vocabulary made for natural text cuts it into few, varied pieces; noise, shouting, glued symbols
and endless repetition give short pieces, bytes, or the same pieces again and again. Each vocabulary
measures characters per token, the share of tokens that are bytes of a cut character, and the
entropy of the tokens as a share of what so many tokens could have.

The rejection bands aren't set by hand: for each language, and for each script where a language is
not given or too rare, the quartiles of every measure over all documents that pass the base rules
give Tukey fences, and a document outside one of them is rejected. Quartiles stand a quarter of noise.

Both public vocabularies never look across a space between words, so the distinct words of some
documents are cut once and their ids dealt to the documents; other vocabularies get whole texts.

Two passes: the measures are made once without a shuffle and written, then quartiles are aggregated
(partial ones first, so a common language is no hot key) and joined back by language and script.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.memory import in_small_batches
from strandloom.plans.session import table, written

SQL = None
SPACE, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Words of the documents that are measured together, and words that a tokenizer gets at a time.
WORDS, TOGETHER = 1 << 16, 1 << 10
#: Fixed value: a splitting pattern whose parts hold a space only as their first character, or among white space.
WORDWISE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that isn't between words, and what stands for a space in pieces; a text with them is cut whole.
ODD = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u2581]")
#: Documents that a language or script must have for bands of its own.
LEAST_GROUP = 50
#: Quartile distances from the quartiles to the fences, below and above, and the least distance as a share of the median.
BELOW, ABOVE, LEAST_WIDTH = 3.0, 6.0, 0.05
#: Steps of a unit of a measure in which the quartiles are counted.
STEPS = 1000
#: Limits of every document, in whatever language: measure -> from, to.
LIMITS = {"chars": (0.25, 16.0), "bytes": (0.0, 0.6), "entropy": (0.2, 1.0)}
#: A share of bytes up to this is never too much.
BYTES_FREE = 0.05
BASE = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "script": pa.string()}
BASE_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string"
#: The first code point of each range, and the script of its letters (others have none).
SCRIPTS = [
    (0x00, None), (0x41, "Latin"), (0x5B, None), (0x61, "Latin"), (0x7B, None), (0xAA, "Latin"), (0x250, None), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x780, None),
    (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Indic"), (0xE00, "Thai"), (0xE80, None), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, None), (0x1780, "Khmer"), (0x1800, None), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, None), (0x3040, "Kana"), (0x3100, None), (0x3400, "Han"), (0xA000, None), (0xAC00, "Hangul"), (0xD7B0, None), (0xF900, "Han"), (0xFB00, None), (0x20000, "Han"), (0x323B0, None),
]
_STARTS = [x for x, _ in SCRIPTS]


class Vocabulary(NamedTuple):
    """A public vocabulary: its short name, the path of a .model or .tiktoken file, and the splitting pattern of the latter."""

    name: str
    path: str
    pattern: str | None = None


def vocabularies() -> list[Vocabulary]:
    """One of pieces with byte fallback, and one of bytes for many languages."""
    import public_tokenizers as public

    return [Vocabulary("piece", str(public.path("piece_bpe_32k.model"))), Vocabulary("byte", str(public.path("byte_bpe_multi_50k.tiktoken")), public.PATTERN)]


def measures_of(names: list[str]) -> list[str]:
    return [f"{name}_{m}" for name in names for m in ("chars", "bytes", "entropy")]


class Cutter(NamedTuple):
    """A vocabulary's encoder, for each id whether it stands for bytes and no whole characters and whether it begins with a space, whether a text's ids are those of its words, each with a space in front, and whether the first has one, too."""

    encode: Callable[[str], list[int]]
    partial: np.ndarray
    spaced: np.ndarray
    wordwise: bool
    first: bool

    def whole(self, words: list[bytes]) -> np.ndarray:
        """The ids of the words, one space between them."""
        return np.array(self.encode(b" ".join(words).decode()), np.int64)

    def each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, each with a space in front, and where each word's begin: an id begins with a space there only."""
        found = [np.zeros(0, np.int64)]
        for k in range(0, len(words), TOGETHER):
            part = words[k : k + TOGETHER]
            found.append(self.whole(part if self.first else [b"", *part]))
        ids = np.concatenate(found)
        return ids, np.flatnonzero(self.spaced[ids])


@cache
def loaded(vocabulary: Vocabulary) -> Cutter:
    if vocabulary.path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model, proto = SentencePieceProcessor(model_file=vocabulary.path), sentencepiece_model_pb2.ModelProto()
        with open(vocabulary.path, "rb") as said:
            proto.ParseFromString(said.read())
        rules, trained, kinds = proto.normalizer_spec, proto.trainer_spec, proto.SentencePiece
        wordwise = trained.model_type == trained.BPE and not trained.treat_whitespace_as_suffix and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.precompiled_charsmap
        # a piece with a space behind its first character would lie in two words, but for those of spaces alone
        wordwise = wordwise and not any(p.type == kinds.USER_DEFINED or "\u2581" in p.piece[1:] and p.piece.strip("\u2581") for p in proto.pieces) and "\u2581" in {p.piece for p in proto.pieces}
        return Cutter((lambda text: model.encode(text, num_threads=1)), np.array([model.is_byte(k) for k in range(model.get_piece_size())]), np.array([p.piece.startswith("\u2581") for p in proto.pieces]), wordwise, True)
    import tiktoken

    with open(vocabulary.path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    partial, spaced = np.zeros((2, max(ranks.values()) + 1), bool)
    for piece, rank in ranks.items():
        spaced[rank] = piece.startswith(b" ")
        try:
            piece.decode()
        except UnicodeDecodeError:
            partial[rank] = True
    return Cutter(tiktoken.Encoding(vocabulary.name, pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, partial, spaced, vocabulary.pattern == WORDWISE and b" " in ranks, False)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more."""
    number = dict(zip(dict.fromkeys(words), range(len(words)), strict=False))
    return repeated(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), len(number))


def repeated(ids: np.ndarray, distinct: int) -> int:
    """`repeated_words` of words given as numbers below `distinct`."""
    if len(ids) < 4:
        return 0
    if distinct < 1 << 21:
        windows = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
        inorder = np.sort(windows)
        again = inorder[1:][inorder[1:] == inorder[:-1]]
        if not len(again):
            return 0
        twice = again[np.minimum(np.searchsorted(again, windows), len(again) - 1)] == windows
    else:
        twice = twice_of_many(ids, distinct)
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k : len(ids) - 2 + k] |= twice
    return int(inside.sum())


def twice_of_many(ids: np.ndarray, distinct: int) -> np.ndarray:
    """Whether the 3-word window at each place is found twice or more, where three numbers don't fit in 63 bits."""
    pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, at, times = np.unique(pairs[:-1] * distinct + ids[2:], return_inverse=True, return_counts=True)
    return times[at] > 1


def script_of(text: str) -> str | None:
    """The script of most letters; of two with as many the first in the alphabet."""
    if text.isascii():
        return "Latin" if any(map(str.isalpha, text)) else None
    found: Counter[str] = Counter()
    for letter, n in Counter(text).items():
        if (script := SCRIPTS[bisect_right(_STARTS, ord(letter)) - 1][1]) and letter.isalpha():
            found[script] += n
    return min(found, key=lambda s: (-found[s], s)) if found else None


def token_measures(ids: np.ndarray, word_chars: int, partial: np.ndarray) -> tuple[float, float, float]:
    """(characters per token, share of byte tokens, entropy as a share of the most that so many tokens can have)."""
    every, each = np.unique(ids, return_counts=True)
    n = max(len(ids), 1)
    share = each / n
    entropy = float(-(share * np.log2(share)).sum()) / max(float(np.log2(n)), 1.0)
    return word_chars / n, float(share[partial[every]].sum()), entropy


def numbered(words: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of some texts, the number of every word among them, and where each text's numbers begin, the end last."""
    coded = pa.array([w for text in words for w in text], pa.binary()).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.concatenate(([0], np.cumsum([len(text) for text in words], dtype=np.int64)))


def text_ids(words: list[list[bytes]], distinct: list[bytes], numbers: np.ndarray, begins: np.ndarray, cutter: Cutter) -> Iterator[np.ndarray]:
    """The ids of each text, whose words are `numbered`."""
    if not cutter.wordwise:
        yield from map(cutter.whole, words)
        return
    ids, start = cutter.each(distinct)
    size = np.diff(start, append=len(ids))
    for k, text in enumerate(words):
        at = numbers[begins[k] + (not cutter.first) : begins[k + 1]]
        n = size[at]
        dealt = ids[np.arange(n.sum()) + np.repeat(start[at] - np.cumsum(n) + n, n)]
        yield dealt if cutter.first else np.concatenate((cutter.whole(text[:1]), dealt))


def measured(texts: list[str | None], using: list[Cutter]) -> list[tuple]:
    """The base counts of each text in the order of BASE, then the measures of each vocabulary; a text without words has none."""
    texts = [text or "" for text in texts]
    words = [text.encode().split() for text in texts]
    plain = [k for k, text in enumerate(texts) if words[k] and (text.isascii() or not ODD.search(text))]
    of = [words[k] for k in plain]
    distinct, numbers, begins = numbered(of)
    ids = {k: each for k, *each in zip(plain, *(text_ids(of, distinct, numbers, begins, c) for c in using), strict=True)}
    repeats = {k: repeated(numbers[begins[j] : begins[j + 1]].astype(np.int64), len(distinct)) for j, k in enumerate(plain)}
    out = []
    for k, (text, said) in enumerate(zip(texts, words, strict=True)):
        n, n_symbols = len(said), sum(map(text.count, SYMBOLS))
        if not n:
            out.append((0, 0, n_symbols, 0, 0, True, None, *[None] * (3 * len(using))))
            continue
        word_chars = len(text) - sum(map(text.count, SPACE))
        lines = [x for x in text.split("\n") if x.strip(SPACE)]
        n_repeat = repeats[k] if k in repeats else repeated_words(said)
        failed = n < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED * n
        cut = ids.pop(k) if k in ids else [c.whole(said) for c in using]
        out.append((n, word_chars, n_symbols, len(lines) - len(set(lines)), n_repeat, failed, script_of(text), *[m for x, c in zip(cut, using, strict=True) for m in token_measures(x, word_chars, c.partial)]))
    return out


def in_groups(texts: pa.Array) -> Iterator[slice]:
    """Slices of the texts, in order, of up to WORDS words by their bytes, or of one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) // 6
    begin, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > begin and held + n > WORDS:
            yield slice(begin, k)
            begin, held = k, 0
        held += n
    if len(sizes):
        yield slice(begin, len(sizes))


def measures(docs: DataFrame, using: list[Vocabulary], text: str = "text", carried: list[str] | None = None) -> DataFrame:
    """The columns `carried` of docs (all by default) and a struct __m with the base counts and measures of every row."""
    carried = docs.columns if carried is None else carried
    names = measures_of([v.name for v in using])
    inner = pa.struct([*BASE.items(), *((m, pa.float64()) for m in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = [loaded(v) for v in using]
        for batch in batches:
            for at in in_groups(batch.column(len(carried))):
                part = batch.slice(at.start, at.stop - at.start)
                rows = [dict(zip(inner.names, row, strict=True)) for row in measured(part.column(len(carried)).to_pylist(), cut)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(carried))), pa.array(rows, inner)], names=[*carried, "__m"])

    chosen = in_small_batches(docs).select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in chosen.drop("__text").dtypes)
    fields = BASE_DDL.replace(" ", ":").replace(",:", ", ") + "".join(f", {m}:double" for m in names)
    return chosen.mapInArrow(run, f"{schema}, `__m` struct<{fields}>" if schema else f"`__m` struct<{fields}>")


def bands(found: DataFrame, group: Column, names: list[str], least: int = LEAST_GROUP) -> DataFrame:
    """(grp, low, high) for each group of at least `least` rows of `found` that pass the base rules: the fences of every measure, as structs.

    Measures are counted in steps of 1/STEPS first, so the quartiles are exact, the same in every run,
    and come from a bounded number of counts.
    """
    sound = found.filter(~F.col("__m.base_failed")).select(group.alias("grp"), "__m").filter("grp IS NOT NULL")
    each = sound.select("grp", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.floor(F.col(f"__m.{m}") * STEPS).alias("x")) for m in names])).alias("s"))
    counts = each.groupBy("grp", F.col("s.m").alias("m"), F.col("s.x").alias("x")).agg(F.count("*").alias("n"))
    q = counts.groupBy("grp", "m").agg(F.sum("n").alias("n"), F.percentile("x", [0.25, 0.5, 0.75], F.col("n")).alias("q")).filter(F.col("n") >= least)
    q = q.groupBy("grp").agg(*[F.max(F.when(F.col("m") == m, F.transform("q", lambda x: x / STEPS))).alias(m) for m in names])
    width = {m: F.greatest(F.col(m)[2] - F.col(m)[0], F.lit(LEAST_WIDTH / BELOW) * F.col(m)[1]) for m in names}
    low = [(F.col(m)[0] - BELOW * width[m]).alias(m) for m in names]
    high = [F.greatest(F.col(m)[2] + ABOVE * width[m], F.lit(BYTES_FREE if m.endswith("_bytes") else 0.0)).alias(m) for m in names]
    return q.select("grp", F.struct(*low).alias("low"), F.struct(*high).alias("high"))


def judged(docs: DataFrame, using: list[Vocabulary] | None = None, text: str = "text", lang: str = "lang", carried: list[str] | None = None, least: int = LEAST_GROUP) -> DataFrame:
    """The columns `carried` of docs (all by default), __m, and __kept: whether base rules, limits and the bands of language or script are met.

    A null or empty text has no words, fails and is not kept. A null language, one without `least`
    sound documents, or docs without a column `lang`: the script's bands; where that is too rare also,
    LIMITS alone. Repeated rows stay rows and count as rows in the quartiles; columns that docs has
    besides are carried whatever their names (but __m, __kept, __text and __lang); an empty table gives no rows.
    """
    using = using or vocabularies()
    names = measures_of([v.name for v in using])
    carried = docs.columns if carried is None else carried
    keyed = docs.withColumn("__lang", F.col(f"`{lang}`").cast("string") if lang in docs.columns else F.lit(None).cast("string"))
    found = written(measures(keyed, using, text, [*carried, "__lang"]), "fertility-measures")
    by_lang = written(bands(found, F.col("__lang"), names, least), "language-bands")
    by_script = written(bands(found, F.col("__m.script"), names, least), "script-bands")
    # the written bands have a row for each language; Spark sees their size and picks the join
    joined = found.join(by_lang.select(F.col("grp").alias("__lang"), F.col("low").alias("__low"), F.col("high").alias("__high")), "__lang", "left")
    joined = joined.join(by_script.select(F.col("grp").alias("__script"), F.col("low").alias("__low2"), F.col("high").alias("__high2")), F.col("__m.script") == F.col("__script"), "left")
    good = ~F.col("__m.base_failed")
    for m in names:
        x, (least_x, most_x) = F.col(f"__m.{m}"), LIMITS[m.rsplit("_", 1)[1]]
        low, high = F.coalesce(F.col(f"__low.{m}"), F.col(f"__low2.{m}"), F.lit(least_x)), F.coalesce(F.col(f"__high.{m}"), F.col(f"__high2.{m}"), F.lit(most_x))
        good = good & (x >= F.greatest(low, F.lit(least_x))) & (x <= F.least(high, F.lit(most_x)))
    return joined.select(*[F.col(f"`{c}`") for c in carried], "__m", F.coalesce(good, F.lit(False)).alias("__kept"))


def fertility(docs: DataFrame, using: list[Vocabulary] | None = None, text: str = "text", lang: str = "lang", carried: list[str] | None = None, least: int = LEAST_GROUP) -> DataFrame:
    """`judged` with the counts, the measures and `kept` as columns; columns of docs with these names are replaced."""
    using = using or vocabularies()
    new = [*BASE, *measures_of([v.name for v in using])]
    carried = [c for c in (docs.columns if carried is None else carried) if c.lower() not in (*new, "kept")]
    out = judged(docs, using, text, lang, carried, least)
    return out.select(*[F.col(f"`{c}`") for c in carried], *[F.col(f"__m.{c}").alias(c) for c in new], F.col("__kept").alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts, the measures and the verdict on every document."""
    return fertility(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), carried=["doc_id"])
