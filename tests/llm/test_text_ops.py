"""Quality rules, decontamination, personal data and repeats against plain versions."""

import collections
import hashlib
import math
import random
import re
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import decontaminate, fertility, pii, suffix_index


def plain_fertility(rows, least, limits=fertility.LIMITS):
    """kept of each (text, lang), by a plain version: whole texts cut at once, quartiles by sorting."""
    import base64

    import public_tokenizers as public
    import tiktoken
    from sentencepiece import SentencePieceProcessor

    piece = SentencePieceProcessor(model_file=str(public.path("piece_bpe_32k.model")))
    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    multi = tiktoken.Encoding("plain", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = {v: k for k, v in ranks.items()}

    def valid(b):
        try:
            return bool(b.decode()) or True
        except UnicodeDecodeError:
            return False

    def measures(words):
        out = []
        for ids, is_byte in ((piece.encode(" ".join(words)), piece.is_byte), (multi.encode_ordinary(" ".join(words)), lambda i: not valid(whole[i]))):
            n = len(ids)
            entropy = -sum(c / n * math.log2(c / n) for c in collections.Counter(ids).values())
            out += [sum(map(len, words)) / n, sum(map(is_byte, ids)) / n, entropy / max(math.log2(n), 1)]
        return out

    seen = []
    for text, lang in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        three = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        marked = {k + j for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if three[w] > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
        scripts = collections.Counter(s for c in text or "" if c.isalpha() for s in [unicodedata.name(c).split()[0]])
        scripts = {"CJK": scripts["CJK"], "LATIN": scripts["LATIN"]}
        seen.append((failed, None if failed else measures(words), lang, max(scripts, key=scripts.get)))

    def fences(values, k):
        q1, q2, q3 = np.percentile([math.floor(x * 1000) for x in values], [25, 50, 75]) / 1000
        width = max(q3 - q1, 0.05 / 3 * q2)
        return q1 - 3 * width, max(q3 + 6 * width, 0.05 if k % 3 == 1 else 0)

    groups = collections.defaultdict(list)
    for failed, m, lang, script in seen:
        if not failed:
            groups["script", script].append(m)
            if lang is not None:
                groups["lang", lang].append(m)
    bands = {g: [fences([m[k] for m in ms], k) for k in range(6)] for g, ms in groups.items() if len(ms) >= least}
    kept = []
    for failed, m, lang, script in seen:
        band = bands.get(("lang", lang)) or bands.get(("script", script)) or [(-math.inf, math.inf)] * 6
        outer = list(limits.values()) * 2
        kept.append(not failed and all(max(a, c) <= x <= min(b, d) for x, (a, b), (c, d) in zip(m, band, outer, strict=True)))
    return kept


def test_fertility_counts(docs, texts, empty):
    got = fertility.fertility(docs, least=20).collect()
    assert len(got) == len(texts)
    for row, (doc, text) in zip(sorted(got, key=lambda r: (r.doc_id, r.n_words)), sorted(texts, key=lambda t: (t[0], len((t[1] or "").split()))), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        three = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        marked = {k + j for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if three[w] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)), doc
        assert row.base_failed == (len(words) < 50 or 100 * len(marked) > 50 * len(words))
        assert not (row.kept and row.base_failed)
    lang = lambda d: "en" if d % 2 else None
    assert collections.Counter((r.doc_id, r.kept) for r in got) == collections.Counter((d, k) for (d, _), k in zip(texts, plain_fertility([(t, lang(d)) for d, t in texts], 20), strict=True))
    assert fertility.fertility(empty).count() == 0


def test_fertility_bands(spark):
    """Shouted and symbol-ridden texts and noise go, clean ones stay, in a language, without one, and in another script."""
    rng = random.Random(2)
    english = "the quick report of this morning says that rain will come from the north and people should take care on their way home because roads may be wet for some hours until evening when it gets dry again".split()
    german = "der neue bericht von heute morgen sagt dass regen aus dem norden kommt und die leute sollten auf dem weg nach hause vorsichtig sein weil straßen einige stunden lang nass bleiben".split()
    han = list("今天早上的報告說北方會下雨人們回家的路上應該小心因為道路可能潮濕幾個小時直到晚上再次乾燥")
    text = lambda words: " ".join(rng.choice(words) for _ in range(90))
    rows = [(k, text(w), lang, 1) for k in range(80) for w, lang in ((english, "en"), (german, "de"), (han, None))]
    odd = [(1000, " ".join(f"{w}{rng.choice(['###', '$$$', '%%%'])}" for w in text(english).split()), "en"), (1001, text(english).upper().replace(" ", "!! "), "en"), (1002, " ".join("".join(rng.choices("bcdfgxq0123", k=7)) for _ in range(90)), "de")]
    odd += [(1003, " ".join(f"{w}&&&" for w in text(han).split()), None), (1004, text(english), "xx"), (1005, " ".join("\u1234\u2d5f" for _ in range(20)) + " " + text(german), "de")]
    frame = spark.createDataFrame([*rows, *((d, t, g, 0) for d, t, g in odd)], "doc_id long, text string, lang string, kept int")
    out = fertility.judged(frame)
    assert out.columns == [*frame.columns, "__m", "__kept"]
    got = [(r.doc_id, r["__kept"]) for r in out.collect()]
    assert all(k for d, k in got if d < 1000) and {d: k for d, k in got if d >= 1000} == {1000: False, 1001: False, 1002: False, 1003: False, 1004: True, 1005: False}
    plain = [(r.text, r.lang) for r in frame.collect()]
    assert collections.Counter(got) == collections.Counter(zip((r.doc_id for r in frame.collect()), plain_fertility(plain, fertility.LEAST_GROUP), strict=True))


def test_repeated_words_of_many_kinds():
    """More distinct words than 21 bits number."""
    n = (1 << 21) + 10
    words = [b"%x" % k for k in range(n)]
    assert fertility.repeated_words(words) == 0
    assert fertility.repeated_words([*words, *words[-3:]]) == 6


def test_fertility_ids_of_whole_texts():
    """Ids dealt by distinct words are those of whole texts, of long ones and ones with odd white space too, and a repeated word is cut once."""
    rng = random.Random(4)
    letters, plain = list("aA b   \u2581'sé\u0301中\u3000\u00a0\u2028\n\t1.,<s>\x00\x1c\x85\u200b\U0001f600K"), list("aA b  'sé\u0301中\n1.,<s>\x1c\u200b\U0001f600K")
    texts = ["".join(rng.choice(x) for _ in range(rng.randint(0, 60))) for x in (letters, plain) for _ in range(400)]
    texts += [None, "", " \n", "one", "ab cd " * 20_000]
    using = [fertility.loaded(v) for v in fertility.vocabularies()]
    got = fertility.measured(texts, using)
    for text, row in zip(texts, got, strict=True):
        if words := (text or "").encode().split():
            want = [m for c in using for m in fertility.token_measures(c.whole(words), row[1], c.partial)]
            assert list(row[7:]) == want, text
    cut = []
    counting = [c._replace(encode=lambda text, c=c: cut.append(len(text)) or c.encode(text)) for c in using]
    assert fertility.measured(["some words again " * 30] * 50, counting) == fertility.measured(["some words again " * 30] * 50, using)
    assert sum(cut) < 50 * 20


def contaminated(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = [(i, tuple(w[k : k + 10])) for i, t in items if (w := low(t)) for k in range(max(1, len(w) - 9))]
    out = {}
    for d, t in texts:
        w, hit, ids = low(t), set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    ids.add(str(i))
        out[d] = (len(w), len(hit), sorted(ids))
    return out


def test_decontamination(spark, docs, texts, empty):
    long = dict(texts)[306].split()
    items = [(1, " ".join(long[50:75])), (2, " ".join(long[60:64])), (3, None), (4, "..."), (20, dict(texts)[303]), (5, "never seen words"), (6, " ".join(long[50:75]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == contaminated(texts, items)
    assert all(not r.n_hit for r in decontaminate.contamination(docs, bench.limit(0)).collect())
    assert decontaminate.contamination(empty, bench).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(x) if i % 2 == 0 else 2 * int(x) - 9 * (int(x) > 4) for i, x in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), n, kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


HARD = [
    "a@b.c_d@e.f x@y a.b@c-d.e.f.", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 " + "9" * 30, "+1 (988) 555-2485. +49-30-1234567 +1 2", "é 4111111111111111 ünï +1 (988) 555-2485 q@r.st",
    "a" * 5000 + "@" + "b" * 5000 + ".c", "1" * 20000, "+" * 300 + "1 2 3", "a@b@c.d 1.1.1.1.1", None, "",
]


def test_personal_data_base(spark, docs, texts, empty):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(1000 + d, t) for d, t in texts]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in pii.personal_data(frame).collect():
        got[r.doc_id].append([f"{s.kind}:{s.start}:{s.stop}" for s in r.base])
        assert {(s.kind, s.start, s.stop) for s in r.base} <= {(s.kind, s.start, s.stop) for s in r.spans}
    for d, t in rows:
        assert got[d][0] == base_spans(t), (d, (t or "")[:60])
    assert pii.personal_data(empty).count() == 0


def test_personal_data_discovers(spark):
    known = [(i, f"please mail user{i}x@mail.example for help") for i in range(12)]
    rows = [*known, (50, "please mail ab12cd34ef for help"), (51, "built in 20190203 or so"), (52, "see 2019-02-03 here"), (53, "please mail 4111111111111112 for help")]
    got = {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == [("id", "ab12cd34ef")] and got[51] == got[52] == got[53] == []
    clean = {r.doc_id: r.text for r in pii.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[0] == "please mail <email> for help" and clean[50] == "please mail <id> for help" and clean[51] == "built in 20190203 or so"


def test_personal_data_discovers_in_several_rounds(spark):
    rows = [(i, f"please mail user{i}x@mail.example for help") for i in range(24)]
    rows += [(100 + i, f"please mail zz{i:02}yy{i:02}ww code now") for i in range(8)]  # found by what stands before them ...
    rows += [(200, "xx einlass qq11rr22ss code now"), (201, "xx einlass 33445566 weg")]  # ... and then by what stands behind
    key = "0123456789abcdef0123456789abcdef01234567"
    rows += [(300, f'token = "{key}" x'), (301, "see Ab1cD2eF3gH4iJ5kL6mN7 there"), (302, f"mail {key}@mail.example now"), (303, "1234567890123456 " + key.replace("a", "1"))]
    rows += [(400, f"please mail {'x' * 90}7 for help"), (401, "please mail AB12 CD34 EF56 for help"), (402, "Version-of-2019-for-Windows-Server-10 here")]
    rows += [(500 + i, f"user{i}y@mail.example 5") for i in range(12)] + [(550, "98765432 5")]
    got = {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[100 + i] for i in range(8)] == [[("id", f"zz{i:02}yy{i:02}ww")] for i in range(8)]
    assert got[200] == [("id", "qq11rr22ss")] and got[201] == []
    assert got[300] == [("key", key)] and got[301] == [("key", "Ab1cD2eF3gH4iJ5kL6mN7")] and got[302] == [("email", f"{key}@mail.example")]
    assert ("key", key.replace("a", "1")) in got[303]
    assert got[400] == [("id", "x" * 90 + "7")] and got[401] == [("id", "AB12 CD34 EF56")] and got[402] == got[550] == []


def plain_scores(instances):
    """Scores and what is found, by a plain version of the rounds."""
    seed, edges = {}, collections.defaultdict(set)
    for value, s, pattern in instances:
        if re.search(r"[^\W\d_]", pattern):
            seed[value] = max(s, seed.get(value, -1))
            edges[value].add(pattern)
    score, found = {v: float(s == 1) for v, s in seed.items()}, set()
    while True:
        of = collections.defaultdict(list)
        for v, ps in edges.items():
            for p in ps:
                of[p].append(v)
        worth = {p: sum(score[v] for v in vs) / (len(vs) + 1) for p, vs in of.items()}
        strong = {p for p, vs in of.items() if worth[p] >= pii.LEAST_PATTERN and sum(seed[v] == 1 or v in found for v in vs) >= pii.LEAST_SEEDS}
        new, more = {}, set(found)
        for v in seed:
            together = 1 - math.prod(max(1 - worth[p], 1e-9) for p in edges[v])
            if seed[v] == 0 and together >= pii.LEAST_INSTANCE and edges[v] & strong:
                more.add(v)
            new[v] = 1.0 if seed[v] == 1 or v in more else 0.0 if seed[v] == -1 else together
        still = more == found and all(new[v] - score[v] < pii.STILL for v in seed)
        score, found = new, more
        if still:
            return score, found


def test_pattern_scores(spark):
    rng = random.Random(4)
    rows = []
    for v in range(120):
        s = rng.choice([1, 1, 0, 0, 0, -1])
        rows += [(f"v{v}", s, rng.choice(["< ", "> ", *(f"< w{chr(97 + k)} " for k in range(1 + v % 9))])) for _ in range(rng.randint(1, 4))]
    want, found = plain_scores(rows)
    values, _ = pii.pattern_scores(spark.createDataFrame(rows, "value string, seed int, pattern string"))
    got = {r.value: r for r in values.collect()}
    assert set(got) == set(want) and all(abs(got[v].score - want[v]) < 1e-6 for v in want)
    assert found and {v for v, r in got.items() if r.found} == found


def test_redaction_of_clashing_names(spark):
    rows = [(1, "mail a@b.cd now", "s", 7, "k"), (None, "mail a@b.cd now", None, 8, "k"), (2, None, "s", 9, "k"), (2, "", "s", 9, "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans string, text_key int, base string")
    out = pii.redacted(frame)
    assert out.columns == frame.columns
    assert collections.Counter(map(tuple, out.collect())) == collections.Counter((d, t and t.replace("a@b.cd", "<email>"), s, k, b) for d, t, s, k, b in rows)


@pytest.mark.parametrize("long", ["a" * 200_000, "a" * 200_000 + "1", "a1 " * 100_000, "a1" * 100_000, "-" * 200_000, "aa " * 100_000, "1a " * 100_000])
def test_identifiers_of_long_texts_take_linear_time(spark, long):
    begun = time.monotonic()
    spark.createDataFrame([(1, long)], "doc_id long, text string").select(pii.spans_of("id", pii.CANDIDATE, "text"), pii.spans_of("id", pii.SPACED, "text"), F.col("text").rlike(pii.KEY)).collect()
    assert time.monotonic() - begun < 30


def without_repeats(texts):
    data = [(d, (t or "").encode()) for d, t in texts]
    n = suffix_index.LENGTH
    count = collections.Counter(b[i : i + n] for _, b in data for i in range(len(b) - n + 1))
    out = collections.Counter()
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[(d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("most", [20_000, 2])
def test_repeats(docs, texts, empty, most, monkeypatch):
    monkeypatch.setattr(suffix_index, "MOST_CLASSES", most)
    got = collections.Counter(tuple(r) for r in suffix_index.remove_repeats(docs, batches=5).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == without_repeats(texts)
    assert suffix_index.remove_repeats(empty).count() == 0


def test_suffixes_of_long_texts_do_not_depend_on_segments(monkeypatch):
    import random

    rng = random.Random(2)
    data = bytes(rng.choice(b"abc ") for _ in range(9000))
    whole = [x.tolist() for x in suffix_index.kept_suffixes(data)]
    monkeypatch.setattr(suffix_index, "SEGMENT", 1000)
    assert [x.tolist() for x in suffix_index.kept_suffixes(data)] == whole


def test_suffixes_of_texts_of_several_real_segments(monkeypatch):
    import numpy as np

    monkeypatch.setattr(suffix_index, "_SHIFTS", [])
    for n in (2 * suffix_index.SEGMENT + 400, 2 * suffix_index.SEGMENT + 401, 2 * suffix_index.SEGMENT + 1500, 3 * suffix_index.SEGMENT + 700):
        data = np.random.default_rng(n).integers(97, 101, n, np.uint8).tobytes()
        got = [x.tolist() for x in suffix_index.kept_suffixes(data)]
        with monkeypatch.context() as patch:
            patch.setattr(suffix_index, "SEGMENT", 1 << 21)
            assert [x.tolist() for x in suffix_index.kept_suffixes(data)] == got
        suffix_index._SHIFTS.clear()


def test_repeats_of_a_very_long_text(spark):
    import random

    rng = random.Random(5)
    long = "".join(rng.choices("abcdefgh ", k=2 * suffix_index.SEGMENT + 5000))
    at = suffix_index.SEGMENT - 150  # over the border of two segments
    docs = spark.createDataFrame([(1, long), (2, "x" * 20 + long[at : at + 300])], "doc_id long, text string")
    got = sorted(tuple(r) for r in suffix_index.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans").collect())
    assert got == [(1, len(long), 300, 1), (2, 320, 300, 1)]


def test_suffixes_of_texts_together(texts):
    data = [(t or "").encode() for _, t in texts] * 3
    got = suffix_index.suffixes_of(data)
    order = got[0].argsort(kind="stable")
    want = [(k, *row) for k, d in enumerate(data) for row in zip(*(x.tolist() for x in suffix_index.kept_suffixes(d)), strict=True)]
    assert list(zip(*(x[order].tolist() for x in got), strict=True)) == want
