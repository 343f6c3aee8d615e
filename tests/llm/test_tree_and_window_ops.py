"""Merkle manifests, repeated windows and phrases against plain versions that hold everything in memory."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import merkle, phrases, superkmer


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, ways):
    """The root of some digests and each one's proof."""
    proofs, level, of = [[] for _ in leaves], list(leaves), [[k] for k in range(len(leaves))]
    while len(level) > 1:
        up, over = [], []
        for b in range(0, len(level), ways):
            run = level[b : b + ways]
            for k, members in enumerate(of[b : b + ways]):
                for m in members:
                    proofs[m].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha(*run))
            over.append([m for members in of[b : b + ways] for m in members])
        level, of = up, over
    return level[0], proofs


def plain_manifest(rows, ways):
    """rows: (tree, order, leaf) -> counter of (tree, order, leaf, subroot, root, proof)."""
    trees = collections.defaultdict(list)
    for t, o, leaf in rows:
        trees[t].append((o is not None, o or 0, leaf))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    below = {t: (sorted(trees[t]), *plain_tree([x[2] for x in sorted(trees[t])], ways)) for t in names}
    root, upper = plain_tree([below[t][1] for t in names], ways)
    out = collections.Counter()
    for t, own in zip(names, upper, strict=True):
        for (there, o, leaf), proof in zip(below[t][0], below[t][2], strict=True):
            out[(t, o if there else None, leaf, below[t][1], root, tuple([*proof, *own]))] += 1
    return out


@pytest.mark.parametrize(("ways", "levels"), [(2, 3), (3, 2), (2, 10)])
def test_manifest(spark, ways, levels):
    rng = random.Random(ways * 10 + levels)
    rows = [("b", rng.randrange(60), sha(str(rng.randrange(200)))) for _ in range(95)]
    rows += [("a", k, sha(str(k))) for k in range(ways**levels if levels < 10 else 9)] + [(None, None, sha("n")), (None, 3, sha("m")), ("é", 1, sha("x")), ("", 1, sha("y")), ("Z", 5, sha("z")), ("Z", 4, sha("z"))]
    rows += [("a", 7, sha("same"))] * 30  # copies take a place each
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "lang string, k long, leaf string, root int, at int, `a.b` int").repartition(5)
    out = merkle.manifest(frame, "leaf", "lang", "k", ways, levels)
    assert out.columns == ["lang", "k", "leaf", "at", "a.b", "subroot", "root", "proof"]
    checked = out.withColumn("folds", merkle.folded(F.col("leaf"), F.col("proof"))).withColumn("said", merkle.proof_digest(F.col("proof"))).collect()
    assert collections.Counter((r.lang, r.k, r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.proof)) for r in checked) == plain_manifest(rows, ways)
    assert all(r.folds == r.root and r.said == sha(*(s.before + s.after for s in r.proof)) for r in checked)
    wrong = out.select(merkle.folded(F.lit(sha("other")), F.col("proof")).alias("h"), "root", "leaf").filter(F.col("leaf") != sha("other"))
    assert wrong.filter("h = root").count() == 0
    assert merkle.manifest(frame.limit(0), "leaf", "lang", "k", ways, levels).count() == 0


def test_manifest_of_one(spark):
    row = merkle.manifest(spark.createDataFrame([(None, None, sha("a"))], "lang string, k long, leaf string"), "leaf", "lang", "k").first()
    assert (row.subroot, row.root, row.proof) == (sha("a"), sha("a"), [])


def test_leaf_digest(spark):
    rows = [(1, "é", None), (None, "", "x:y"), (-5, None, "-")]
    got = [r.h for r in spark.createDataFrame(rows, "a long, b string, c string").coalesce(1).select(merkle.leaf_digest(F.col("a"), F.col("b"), F.col("c")).alias("h")).collect()]
    assert got == [sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r)) for r in rows]


def test_manifest_query_with_nulls(spark, tmp_path):
    rows = [(k, f"text {k}" if k % 5 else None, ("en", "de", None)[k % 3], "s", k if k % 4 else None) for k in range(40)] + [(None, "t", "en", None, 2**63 - 1), (3, "text 3", "en", "s", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for r in merkle.query(spark, f"file://{tmp_path}").collect():
        bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        assert r.verified == (not bad or r.doc_id % 4 == 0)


def plain_repeats(rows, window):
    """rows: (id, text) -> counter of (id, n_words, n_removed, kept)."""
    split = re.compile(r"[^\x20\x09-\x0D]+")
    words = [(d, split.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, float("inf")), float("inf") if d is None else d)
    out = collections.Counter()
    for d, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (float("inf") if d is None else d):
                gone.update(range(k, k + window))
        rest = [x for k, x in enumerate(w) if k not in gone]
        out[(d, len(w), len(gone), " ".join(rest))] += 1
    return out


@pytest.mark.parametrize(("window", "size", "split"), [(50, 10, 5000), (50, 10, 2), (6, 2, 5000), (6, 2, 1), (7, 7, 3), (2, 1, 5000)])
def test_repeated_windows(spark, docs, texts, empty, window, size, split):
    out = superkmer.remove_repeats(docs, window=window, size=size, split=split)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_words", "n_removed", "kept"]
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()) == plain_repeats(texts, window)
    assert superkmer.remove_repeats(empty).count() == 0


def test_repeated_windows_of_odd_rows(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(None, passage), (None, passage), (5, passage), (5, passage), (5, f"x {passage} y"), (3, f"a\tb\n{passage} c"), (-7, " ".join(f"p{k}" for k in range(49))), (9, passage.upper()), (10, "w " * 500), (11, "w " * 300), (12, f"{passage} {passage}"), (2, None), (1, "")]
    frame = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], "doc_id int, text string, `a.b` int, id int, n_words int")
    out = superkmer.remove_repeats(frame)
    assert out.columns == ["doc_id", "a.b", "id", "n_words", "n_removed", "kept"]
    got = collections.Counter((r[0], r[3], r[4], r[5]) for r in out.collect())
    assert got == plain_repeats(rows, 50)
    assert sum(n for (_, _, lost, _), n in got.items() if lost) == 7


def test_group_of_copies_and_common_passage(spark):
    """A bucket with many different strings and a group of many equal ones."""
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(70)]
    rows = [(k, " ".join([f"a{rng.randrange(10**6)}" for _ in range(40)] + passage + [f"b{rng.randrange(10**6)}" for _ in range(40)])) for k in range(150)]
    rows += [(1000 + k, rows[7][1]) for k in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    for split in (5000, 20):
        got = collections.Counter(tuple(r) for r in superkmer.remove_repeats(frame, split=split).select("doc_id", "n_words", "n_removed", "kept").collect())
        assert got == plain_repeats(rows, 50)


def test_sorted_windows():
    rng = np.random.default_rng(4)
    strings = [b" ".join(bytes([97 + x]) for x in rng.integers(0, 2, n)) for n in (9, 5, 30, 5, 12)]
    for window in (1, 2, 3, 5):
        owner, rank = superkmer.sorted_windows(strings, window)
        want = [(k, tuple(s.split(b" ")[j : j + window])) for k, s in enumerate(strings) for j in range(len(s.split(b" ")) - window + 1)]
        assert owner.tolist() == [k for k, _ in want]
        assert len(set(zip(rank.tolist(), (w for _, w in want), strict=True))) == len(set(rank.tolist())) == len({w for _, w in want})


def plain_phrases(rows, least, share, depth=4):
    """rows: (lang, text) -> {(lang, phrase): (a, l, r, k, n, score, longest, kept)}."""
    f = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, depth + 1):
                for k in range(len(w) - size + 1):
                    f[lang or "und"][tuple(w[k : k + size])] += 1
    out = {}
    for lang, count in f.items():
        n = sum(c for g, c in count.items() if len(g) == 1)
        candidates = {g: a for g, a in count.items() if len(g) > 1 and a >= least}
        for g, a in candidates.items():
            score, k = min((2_000_000 * a // (count[g[:k]] + count[g[k:]]), k) for k in range(1, len(g)))
            longer = [b for h, b in candidates.items() if len(h) > len(g) and any(h[j : j + len(g)] == g for j in range(len(h) - len(g) + 1))]
            out[(lang, " ".join(g))] = (a, count[g[:k]], count[g[k:]], k, n, score, max(longer, default=None), not any(100 * b >= share * a for b in longer))
    return out


@pytest.mark.parametrize("words", [1 << 22, 300, 40])
def test_phrases(spark, texts, empty, words):
    rng = random.Random(words)
    said = [(("en", "de", None, "und")[k % 4], "".join(rng.choice("ab AB\tc.\n,é! ") for _ in range(rng.randint(0, 90)))) for k in range(60)]
    said += [("en", None), ("xx", ""), ("yy", ".,;\n"), ("zz", "one"), ("en", "x y z " * 60), ("en", "x y z " * 60), ("de", "Öl  öl " * 9)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in said], "lang string, text string, n int, hash int").repartition(3)
    out = phrases.phrases(frame, least=4, share=70, words=words)
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.k, r.n, r.score, r.longest, r.kept) for r in out.collect()}
    assert got == plain_phrases(said, 4, 70)
    assert out.count() == len(got)
    if words == 40:
        assert phrases.phrases(empty).count() == 0


def test_shards_reach_python_one_at_a_time(spark, docs):
    """Rows as large as indexes are no batch of many, which workers and executors would hold whole."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert phrases.phrases(docs.limit(3)).count() == 0
    rows = spark.range(6, numPartitions=1).select(F.expr("repeat('x', 3000000)").alias("x"))
    assert [r.n for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long").collect()] == [1] * 6


def test_index_intervals(monkeypatch):
    rng = np.random.default_rng(2)
    a = np.concatenate(([0], rng.integers(0, 5, 400), [0]))
    for depth in (3, 4, 6):
        shard = phrases.Shard([b"\n", *(bytes([97 + k]) for k in range(4))], phrases.transform(a, depth), phrases.transform(np.concatenate((a[:1], a[:0:-1])), depth), 1)
        for length in range(1, depth + 1):
            now = shard.single(lambda h: np.ones(len(h), bool))
            for side in [1, 0, 0, 1, 0][: length - 1]:  # any order of extensions gives the same phrases
                monkeypatch.setattr(phrases, "PLACES", 1 << (3 * side + 4))
                parts = list(shard.extended(now, side, lambda h: np.ones(len(h), bool)))
                now = {c: np.concatenate([x[c] for x in parts], axis=-1 if c == "begin" else 0) for c in now}
            want = collections.Counter(tuple(a[k : k + length].tolist()) for k in range(len(a) - length + 1) if (a[k : k + length] > 0).all())
            assert {tuple(g): n for g, n in zip(now["grams"].tolist(), now["size"].tolist(), strict=True)} == dict(want)


def test_score_is_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    expr = f"(cast(a as decimal(20,0)) * {phrases.SCALE}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"
    row = spark.createDataFrame([(big, big, big + 1)], "a long, l long, r long").select(F.expr(expr).alias("s")).first()
    assert row.s == 2_000_000 * big // (2 * big + 1)
