"""Conversations, archives, pages, near-duplicates, shards and packing against plain versions, and the pipeline."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import chat, html_text, jaccard_join, packing, sharding, warc


def test_chat_round_trip(spark):
    said = ["", "hi", "</s>[INST] ok [/INST]", "<|turn|>user\n&lt;|end|>\n", "&amp;&#91;[[<<", "é\n漢"]
    rows = [(c, t, r, said[(c + t) % 6]) for c in range(6) for t, r in enumerate(("user", "assistant", "user", "assistant", "user")[: c + 1])]
    rows += [(9, 0, None, None), (9, 0, "user\nx", "a"), (None, 1, "assistant", "b"), (7, 3, "assistant", "same"), (7, 3, "assistant", "same")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, example int")
    examples = chat.expand_prefix_targets(frame)
    got = {r.conv_id: r for r in chat.digests(examples).collect()}
    want = collections.defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t, r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for e in examples.collect():
        assert e.text.count(chat.TURN) == e.n_turns == e.text.count(chat.END)
        assert "[INST]" not in e.text and "</s>" not in e.text
        if e.loss_from is not None:
            assert e.text[e.loss_to :] == chat.END
    replies = sum(1 for r in rows if r[2] == "assistant")
    assert examples.filter("loss_from IS NOT NULL").count() == replies
    assert chat.digests(chat.expand_prefix_targets(frame.limit(0))).count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc(spark, tmp_path, compression):
    big = "<p>WARC/1.1\r\n\r\n" + "x" * 70_000
    rows = [(1, "http://a/1 é", "<p>one"), (2, None, "<p>one"), (3, "http://a/3", None), (4, "u", ""), (5, "v", big), (6, "w", "<p>ünï"), (6, "w", "<p>ünï"), (None, "n", "<p>one")]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, sha1 int")
    path = f"file://{tmp_path}/{compression}"
    warc.write_pages(frame, path, compression)
    got = warc.read_warc(spark, path, verify="true").collect()
    assert collections.Counter((r.record_type, r.record_id, r.refers_to) for r in got) == collections.Counter([
        ("revisit", "urn:page:1", "urn:page:2"), ("response", "urn:page:2", None), ("revisit", "urn:page:3", "urn:page:4"), ("response", "urn:page:4", None),
        ("response", "urn:page:5", None), ("response", "urn:page:6", None), ("response", "urn:page:6", None), ("revisit", "urn:page:none", "urn:page:2"),
    ])
    text = {f"urn:page:{'none' if p is None else p}": (h or "").encode() for p, _, h in rows}
    for r in got:
        assert r.payload_length == len(text[r.record_id]) and r.payload_digest == warc.base32_sha1(text[r.record_id])
        assert (r.payload_ok, r.payload) == ((True, text[r.record_id]) if r.record_type == "response" else (None, None))
    some = warc.read_warc(spark, path, payload="false").filter("record_type = 'revisit' AND payload_length > 0")
    assert ") Filter (" not in some._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.record_id for r in some.collect()) == ["urn:page:1", "urn:page:none"]
    assert warc.read_warc(spark, path, types="response").count() == 5
    warc.write_pages(frame.limit(0), path + "-empty", compression)
    assert warc.read_warc(spark, path + "-empty").count() == 0


def test_foreign_gzip_members(tmp_path):
    import gzip

    data = [warc.record("response", f"id{k}", None, None, warc.base32_sha1(b"x" * k), k, b"x" * k, "2020-01-01T00:00:00Z") for k in (0, 5, 50_000, 7)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in data))
    reader = warc.WarcReader({"path": f"file://{tmp_path}", "verify": "true"})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["record_id"], r["payload_length"], r["payload_ok"]) for r in rows] == [("id0", 0, True), ("id5", 5, True), ("id50000", 50_000, True), ("id7", 7, True)]


PAGES = [
    ("<html><body><header>Site</header><div class='cookie-notice'>We use</div><article><header><h2>Title &eacute;</h2></header><p>foo<b>bar</b> \n baz<br>qux<div class=ad>buy</div><section id=comments><p>nice</section><form>x</form></article><footer>f", "Title é foobar baz qux"),
    ("<main><p>a &lt;b&gt; &amp</main>tail", "a <b> &"), (None, ""), ("", ""), ("<script>var t='</p>'</script>", ""), ("just words &amp; more", "just words & more"), ("<!-- <article> -->x", "x"), ("<script>'<article>'</script>y <math>z</math>", "y z"),
    ("<main><p>The story of the day is long and goes on.</p><article><p>Teaser</p></article><p>It ends here.</p></main>", "The story of the day is long and goes on. It ends here."),
]


def test_main_text(spark):
    rows = [(k, "http://h/", h, "t") for k, (h, _) in enumerate(PAGES)]
    frame = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, text string")
    got = collections.Counter((r.page_id, r.text, r.n_chars) for r in html_text.main_text(frame).collect())
    want = collections.Counter((k, t, len(t)) for k, (_, t) in enumerate(PAGES))
    want[(0, PAGES[0][1], len(PAGES[0][1]))] += 1
    assert got == want
    assert html_text.main_text(frame.limit(0)).count() == 0


def test_host_boilerplate(spark):
    menu = "home news sport weather travel culture about us"
    own = [" ".join(f"{w}{k}" for w in "alpha beta gamma delta epsilon zeta eta".split()) for k in range(4)]
    pages = [(k, f"http://h.example/{k}", f"<body><div>{menu}</div><div>{own[k]}</div><div>legal note all rights reserved by them</div></body>") for k in range(3)]
    pages += [(3, "http://other.example/", f"<body><div>{menu}</div><div>{own[3]}</div>"), (4, None, f"<body><div>{menu}</div>"), (5, "http://h.example/2", pages[2][2])]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {0: own[0], 1: own[1], 2: own[2], 3: f"{menu} {own[3]}", 4: menu, 5: own[2]}


def test_runs_in_the_middle_of_blocks(spark):
    """Runs of 12 to 26 tokens that other words surround, each on three pages of a host."""
    pages, want = [], {}
    for n in range(12, 27):
        run = " ".join(f"r{n}x{k}" for k in range(n))
        for k in range(3):
            own = [" ".join(f"w{n}p{k}{side}{j}" for j in range(14 + 3 * k)) for side in "ab"]
            pages.append((100 * n + k, f"http://h{n}.example/{k}", f"<body><p>{own[0]} {run} {own[1]}</p></body>"))
            want[100 * n + k] = f"{own[0]} {own[1]}"
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want


def plain_main_text(pages, free, inside):
    """Text by page, by a plain version: every run of LONG tokens and every shorter block of every stream is counted."""
    import re

    streams = {p: ((re.findall("//([^/]*)", u) or [""])[0], *html_text.main_blocks(h)) for p, u, h in pages}
    distinct = {(host, tuple(blocks)) for host, _, blocks in streams.values()}

    def runs(blocks):
        tokens = [w for b in blocks for w in b.split()]
        out, at = [], 0
        for b in blocks:
            n = len(b.split())
            out += [(at, n, ("block", b))] if n < html_text.LONG else []
            at += n
        return tokens, out + [(k, html_text.LONG, tuple(tokens[k : k + html_text.LONG])) for k in range(len(tokens) - html_text.LONG + 1)]

    n = collections.Counter((host, key) for host, blocks in distinct for key in {k for _, _, k in runs(blocks)[1]})
    size = collections.Counter(host for host, _ in distinct)
    out = {}
    for p, (host, main, blocks) in streams.items():
        least, share = inside if main else free
        tokens, every = runs(blocks)
        gone = set()
        for at, k, key in every:
            if n[host, key] >= least and n[host, key] >= share * size[host]:
                gone |= set(range(at, at + k))
        kept, at = [], 0
        for b in blocks:
            own = range(at, at + len(b.split()))
            at = own.stop
            if not main or not gone.issuperset(own):
                kept += [tokens[i] for i in own if main or i not in gone]
        out[p] = " ".join(kept)
    return out


def test_host_suffixes_against_all_runs(spark):
    """Pages with and without articles: menus, notes inside most articles, articles that quote, a page within a page."""
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    text = lambda n: " ".join(word() for _ in range(n))
    menu, note, quote = text(30), text(6), text(40)
    pages = []
    for k in range(60):
        host, body = f"h{k % 2}", f"<p>{text(rng.randint(3, 60))}</p>" * rng.randint(1, 3)
        quoted = f"<p>{quote if k % 5 == 0 else text(20)}</p>"
        if k % 2:
            page = f"<div>{menu}</div><div>{text(9)}</div>{body}<div>{note}</div>"
        else:
            page = f"<nav>{menu}</nav><article>{body}{quoted}<p>{note}</p><p>{text(4)} {menu} {text(5)}</p></article>"
        pages.append((k, f"http://{host}/{k}", page))
    pages += [(100, "http://h0/again", pages[0][2]), (101, "http://h1/again", pages[1][2]), (102, None, f"<div>{menu}</div>"), (103, "http://h1/x", None)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = plain_main_text([(p, u or "", h or "") for p, u, h in pages], html_text.FREE, html_text.INSIDE)
    got = {r.page_id: r.text for r in html_text.main_text(frame).collect()}
    assert got == want
    assert menu not in got[1] and note not in got[1] and note not in got[0] and quote in got[0] and menu in got[0]


def test_marked_wrappers():
    body = "<article><h1>Title</h1><p>Some text</p></article>"
    for page in (
        f"<body class='has-sidebar'>{body}", f"<body class=menu>{body}", f"<div id=page class='no-sidebar'>{body}</div>", f"<div class='nav-open'>{body}</div>", f"<div class='cookie-banner-closed'>{body}</div>",
        f"<div class='widget'><div class='content comments-open'>{body}</div></div>", f"<form id=all>{body}</form>", f"<div style='overflow:hidden' class='text-hidden'>{body}</div>",
        f"{body}<div class=comments><article>me too</article></div>", f"{body}<aside><article>next</article></aside>",
        "<article class='post comments-open'><h1>Title</h1><div class='content comments-open'>Some text</div><div class='cookie-notice'>ok</div><ul class='comment-list'>me too</ul><div class='x ad'>buy</div></article>",
        "<main class='content sidebar'><h1>Title</h1><p>Some text</main>", "<div role=main class=widget><h1>Title</h1><p>Some text</div>",
    ):
        assert html_text.main_blocks(page) == (True, ["Title", "Some text"]), page
    assert html_text.blocks_of("<body class='has-sidebar'><div class='nav-open'>a</div><div class='nav'>b</div><div class='site-header'>c</div>")[1] == ["a"]
    assert html_text.blocks_of("<aside><article>next</article></aside>x") == ([], ["x"])


def test_raw_elements_without_an_end():
    for name in ("svg", "iframe", "object"):
        for tag in (f"<{name} a='b' />", f"<{name}/>", f"<{name} hidden/>", f"<{name} src=http://x/>y</{name}>", f"<{name}>y</{name}>"):
            assert html_text.blocks_of(f"<article><p>a</p>{tag}<p>b</p></article>")[0] == ["a", "b"], tag
    assert html_text.blocks_of("<article><p>a</p><svg><path d=x><p>b</p><svg><p>c</p></article>")[0] == ["a", "b", "c"]
    assert html_text.blocks_of("<article><p>a</p><script>b")[0] == ["a"]


def components(texts):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    ids = [d for d, _ in texts]
    sets = [shingles(t) for _, t in texts]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter((d, len(s), least[find(i)] if s else d) for i, (d, s) in enumerate(zip(ids, sets, strict=True)))


def test_near_duplicates(docs, texts, empty):
    got = collections.Counter(tuple(r) for r in jaccard_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == components(texts)
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_chains_of_near_duplicates(spark):
    """Neighbours are linked and ends aren't, so that one pivot can't see the whole group."""
    import random

    rng = random.Random(11)
    rows = []
    for g in range(3):
        w = [f"g{g}x{k}" for k in range(90)]
        for k in range(14):
            rows.append((1000 * g + (k * 5) % 14, " ".join(w)))
            for _ in range(1 + k % 2):
                w[rng.randrange(90)] = f"n{rng.random()}"
    got = collections.Counter(tuple(r) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect())
    assert got == components(rows)


def test_shards(docs, texts, empty):
    out = sharding.hypergeometric_shards(docs.select("doc_id", "n_chars", F.lit(1).alias("slot")), n_shards=7, least_blocks=5)
    rows = out.collect()
    sizes = collections.Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(d for d, _ in texts)
    assert sharding.hypergeometric_shards(empty.select("doc_id")).count() == 0


def test_hypergeometric_law(spark):
    pool, marked, drawn, n = 60, 25, 18, 20_000
    expr = sharding.hypergeometric("60L", "25L", "18L", "u")
    got = {r.k: r["count"] for r in spark.range(n).withColumn("u", (F.col("id") + 0.5) / n).withColumn("k", F.expr(expr)).groupBy("k").count().collect()}
    for k in range(19):
        p = math.comb(marked, k) * math.comb(pool - marked, drawn - k) / math.comb(pool, drawn)
        assert abs(got.get(k, 0) - n * p) <= 2
    big = spark.range(200).withColumn("u", (F.col("id") + 0.5) / 200).withColumn("k", F.expr(sharding.hypergeometric("1000000000L", "400000000L", "90000000L", "u")))
    mean, sd = big.agg(F.avg("k"), F.stddev("k")).first()
    assert abs(mean - 36_000_000) < 1500 and abs(sd / math.sqrt(90e6 * 0.4 * 0.6 * 0.91) - 1) < 0.2


def test_packing(docs, texts, empty):
    path = packing.vocabulary_path()
    cut = packing.pieces(docs, path, capacity=256).cache()
    rows = packing.pack(cut, capacity=256, group=20).collect()
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    want = collections.Counter()
    for d, t in texts:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), 256):
            want[(d, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes()), len(ids))] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= 1.15 * sum(r.length for r in rows) / 256 + 4
    assert packing.pack(packing.pieces(empty, path)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 60, 300])
def test_differencing(n):
    lengths = np.sort(np.random.default_rng(n).integers(1, 4096, n))[::-1].copy()
    parts = packing.packed(lengths, 4096)
    assert sorted(i for p in parts for i in p) == list(range(n))
    sums = [int(lengths[p].sum()) for p in parts]
    assert max(sums) <= 4096
    if n == 300:
        assert sum(sums) / 4096 / len(parts) > 0.95


def test_pipeline(spark, tmp_path, docs, texts):
    import corpus_pipeline
    from strandloom.llm import fertility
    from tests.llm.test_text_ops import plain_fertility

    root = f"file://{tmp_path}"
    long = dict(texts)[306].split()
    spark.createDataFrame([(1, " ".join(long[50:75]))], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{root}/documents.parquet")
    frame, seen = spark.read.parquet(f"{root}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = spark.createDataFrame(stage(spark, frame, root).collect(), plain.schema)
        assert frame.columns == plain.columns
        seen[name] = {(r.doc_id, r.text) for r in frame.collect()}
    lang = {r.doc_id: r.lang for r in plain.collect()}
    kept = [x for x, good in zip(texts, plain_fertility([(t, lang[d]) for d, t in texts], fertility.LEAST_GROUP), strict=True) if good]
    assert seen["quality_rules"] == set(kept)
    alone = {(d, t) for d, t in kept if d in {c for _, _, c in components(kept)}}
    assert seen["near_duplicates"] == alone
    assert seen["decontamination"] == {(d, t) for d, t in alone if d != 306} == seen["personal_data"]
    out = corpus_pipeline.run(spark, root)
    assert {r.doc_id for r in out.collect()} == {d for d, _ in seen["personal_data"]}


def test_near_duplicates_of_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    text = {c: " ".join(f"{c}{k}" for k in range(60)) for c in "abcdefg"}
    rows = [(None, "a"), (None, "b"), (None, "b"), (None, "c"), (5, "c"), (7, "d"), (7, "e"), (2, "f"), (7, "f"), (7, "g"), (7, "g")]
    frame = spark.createDataFrame([(d, text[c] + (" end" if d == 5 else ""), "en", "src", 0) for d, c in rows] + [(None, None, "en", "src", 0), (9, " ", "en", "src", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, frame, str(tmp_path))
    assert out.columns == frame.columns
    got = collections.Counter((r.doc_id, (r.text or " ")[0]) for r in out.collect())
    assert got == collections.Counter([(None, "a"), (None, "b"), (5, "c"), (7, "d"), (7, "e"), (2, "f"), (7, "g"), (None, " "), (9, " ")])


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    more = ["a.b", "__row", "__text_key", "__key", "__m", "text_key", "document", "row", "spans", "rejected"]
    rows = [(d, t, "en", "src", len(t or ""), *range(k, k + len(more))) for k, (d, t) in enumerate([(1, "mail me@here.org or call " + " ".join(f"w{j}" for j in range(60))), (2, " ".join(f"v{j}" for j in range(70))), (None, " ".join(f"u{j}" for j in range(70)))])]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in more)
    frame = spark.createDataFrame(rows, ddl)
    root = f"file://{tmp_path}"
    spark.createDataFrame([(1, " ".join(f"v{j}" for j in range(10)))], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    want = {r[0]: r[5:] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, root)
        assert out.columns == frame.columns, name
        got = {r[0]: tuple(r[5:]) for r in out.collect()}
        assert set(got.items()) <= set(want.items()) and (1 in got or name == "quality_rules")
        if name == "personal_data":
            assert any("<email>" in r.text for r in out.collect()) and got == want
        if name == "decontamination":
            assert set(got) == {1, None}
    assert stage is not None and corpus_pipeline.pack_sequences(spark, frame, root).count() >= 3
