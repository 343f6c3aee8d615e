"""The registered queries of the corpus operators on the smallest tables: against their SQL twins, or plain versions."""

import collections
import glob
import os

import duckdb
import pytest

from strandloom.llm import html_text, queries
from tests.llm.test_other_ops import components, plain_main_text
from tests.llm.test_text_ops import base_spans, plain_fertility, without_repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts_of(spark):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def rows_of(spark, name):
    return queries.QUERIES[name](spark, SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_twins(spark, tmp_path, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    frame = rows_of(spark, name)
    frame.write.parquet(f"{tmp_path}/out")
    con.execute(f"CREATE TABLE want AS {queries.ORACLE[name]}")
    columns = sorted(frame.columns)
    assert columns == sorted(r[0] for r in con.execute("DESCRIBE want").fetchall())
    listed = ", ".join(f'"{c}"' for c in columns)
    got = f"SELECT {listed} FROM '{tmp_path}/out/*.parquet'"
    for a, b in ((got, f"SELECT {listed} FROM want"), (f"SELECT {listed} FROM want", got)):
        assert con.execute(f"{a} EXCEPT ALL {b} LIMIT 3").fetchall() == []


def test_main_text_query(spark):
    pages = [(r.page_id, r.url or "", r.html or "") for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = {r.page_id: (r.text, r.n_chars) for r in rows_of(spark, "op4_host_suffix_text").collect()}
    assert got == {p: (t, len(t)) for p, t in plain_main_text(pages, html_text.FREE, html_text.INSIDE).items()}


def test_fertility_query(spark, texts_of):
    got = collections.Counter((r.doc_id, r.kept) for r in rows_of(spark, "op5_tokenizer_fertility").collect())
    kept = plain_fertility([(t, g) for _, t, g in texts_of], 50)
    assert got == collections.Counter((d, k) for (d, _, _), k in zip(texts_of, kept, strict=True))


def test_personal_data_query(spark, texts_of):
    import hashlib

    got = {r.doc_id: r for r in rows_of(spark, "op6_bootstrapped_pii").collect()}
    assert len(got) == len(texts_of)
    for d, t, _ in texts_of:
        spans = base_spans(t)
        assert got[d].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(got[d].spans.split(",")) and got[d].n_email == sum(s.startswith("email") for s in spans)


def test_near_duplicates_query(spark, texts_of):
    got = collections.Counter(tuple(r) for r in rows_of(spark, "op7_jaccard_join").select("doc_id", "n_shingles", "component_id").collect())
    assert got == components([(d, t) for d, t, _ in texts_of])


def test_repeats_query(spark, texts_of):
    got = collections.Counter(tuple(r) for r in rows_of(spark, "op8_suffix_levels").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == without_repeats([(d, t) for d, t, _ in texts_of])


def test_shards_query(spark, texts_of):
    import zlib

    rows = rows_of(spark, "op9_hypergeometric_shards").collect()
    want = collections.Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in texts_of)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    sizes = collections.Counter(r.shard for r in rows)
    assert {r.law for r in rows} == {"rows"} and set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s])) for s in sizes)


def test_packing_query(spark, texts_of):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    model.encode_special_tokens = True
    rows = rows_of(spark, "op10_differencing").collect()
    want = collections.Counter()
    for d, t, _ in texts_of:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), 4096):
            want[(d, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()), len(ids))] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r.length for r in rows) / 4096 / len(by) > 0.9


def test_packing_with_another_vocabulary(spark):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from strandloom.llm import packing

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Hello  World\n it's", "ÜBER  ß", "", None]
    got = {r.k: (r.doc_tokens, r.ids_crc32) for r in packing.pieces(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), path, doc="k").collect()}
    model = Tokenizer.from_file(path)
    for k, t in enumerate(texts):
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[k] == (len(ids), zlib.crc32(ids.tobytes()))


def test_letters_are_remembered_once(spark):
    """A chunk's letters are held where they stand alone too, ASCII ones aren't mapped, and ids are the tokenizer's own."""
    import numpy as np
    import public_tokenizers

    from strandloom.llm import packing

    encoder = packing.Encoder(str(public_tokenizers.path("word_bpe_49k.json")))
    chunks = encoder.chunks.make.__self__
    made = []
    core = chunks.core
    chunks.core = lambda letters: made.append(letters) or core(letters)
    for chunk in ["over", "over,", "over.", "flußes;", "flußes", "it's", "don't,", "x1", "éa", "１", "a_b", "_", "ǆ", "ﬁx", "ʰ"]:
        assert chunks.known[chunk] == np.array(encoder.model.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
    assert made.count("over") == made.count("flußes") == 1 and {"over", "flußes"} <= set(chunks.known)
    chunks.marks = None
    assert core("plain") == np.array(encoder.model.encode("plain", add_special_tokens=False).ids, "<u4").tobytes()
