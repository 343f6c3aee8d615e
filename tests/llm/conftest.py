"""Small documents with what documents may hold."""

import random

import pytest

WORDS = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(9)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): nulls, empties, copies, near copies, repeats, odd characters, a long text."""
    rng = random.Random(5)
    out = [(i, prose(rng, rng.randint(3, 120))) for i in range(40)]
    base = prose(rng, 100)
    for k in range(12):
        w = base.split()
        for _ in range(k // 3):
            w[rng.randrange(100)] = "zz"
        out.append((100 + k, " ".join(w)))
    shared = prose(rng, 60)
    out += [(200 + k, f"{prose(rng, 40)} {shared} {prose(rng, 30)}") for k in range(5)]
    out += [(300, None), (301, ""), (302, " \n\t "), (303, "one two"), (304, "ab " * 400), (305, "Ünï çødé ﬁ 漢字   x" * 30), (306, prose(rng, 6000)), (307, base.upper()), (308, base), (308, base), (309, "one two")]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with the columns of documents, and some whose names clash with the operators' own."""
    rows = [(d, t, "en" if d % 2 else None, "src", len(t or ""), 7, "x") for d, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
