"""The decoder against worked examples and against all legal paths of short regions."""

import itertools
import math
import random

import numpy as np
import pytest

from strandloom.functions.track import MOVES
from strandloom.operators.decode import decode_arrays, decode_region

POSITIVE: list[bool] = []
TRUE, OTHER = math.log(90.0), 0.0


def odds(path):
    return [[0.0] + [TRUE if s == k else OTHER for k in range(1, 15)] for s in path]


def arrays(seq, o, *options):
    return decode_arrays(seq, np.array(o), *options)


def test_one_exon():
    seq, path = "ATGAAATAA", [7, 5, 6, 4, 5, 6, 4, 5, 14]
    for decode in (decode_region, arrays):
        [(score, exons)] = decode(seq, odds(path), 9, 20)
        assert exons == [(0, 9)] and score == pytest.approx(9 * TRUE)
        assert decode(seq, odds(path), 10, 20) == []


def test_two_exons():
    seq = "ATGAA" + "GT" + "C" * 16 + "AG" + "ATAA"
    path = [7, 5, 6, 4, 9] + [2] * 20 + [13, 4, 5, 14]
    for decode in (decode_region, arrays):
        [(score, exons)] = decode(seq, odds(path), 9, 20)
        assert exons == [(0, 5), (25, 29)] and score == pytest.approx(29 * TRUE)
        assert decode(seq, odds(path), 9, 21) == []


def legal(seq, path, min_cds, min_intron):
    """Whether a label path is a sequence of complete genes over `seq`."""
    if path[0] not in (0, 7) or path[-1] not in (0, 14):
        return False
    if any(b not in MOVES[a] for a, b in itertools.pairwise(path)):
        return False
    coding, intron, motif = "", 0, None
    for i, s in enumerate(path):
        if s == 7:
            if seq[i : i + 3] != "ATG":
                return False
            coding = ""
        if s >= 4:
            coding += seq[i]
        if s in (8, 9, 10):
            motif, intron = seq[i + 1 : i + 3], 0
            if motif not in ("GT", "GC", "AT"):
                return False
        if s in (1, 2, 3):
            intron += 1
        if s in (11, 12, 13) and (intron < min_intron or seq[i - 2 : i] != {"GT": "AG", "GC": "AG", "AT": "AC"}[motif]):
            return False
        if s == 14:
            codons = [coding[k : k + 3] for k in range(0, len(coding), 3)]
            if len(coding) % 3 or len(coding) < min_cds or codons[-1] not in ("TAA", "TAG", "TGA") or any(c in ("TAA", "TAG", "TGA") for c in codons[:-1]):
                return False
    return True


def paths(n):
    todo = [[s] for s in (0, 7)]
    while todo:
        p = todo.pop()
        if len(p) == n:
            yield p
        else:
            todo += [[*p, s] for s in MOVES[p[-1]]]


@pytest.mark.parametrize("seed", range(12))
def test_best_of_all_paths(seed):
    rng = random.Random(seed)
    n, cds, intron = 15, 6, 4
    seq = list("".join(rng.choice("ACGT") for _ in range(n)))
    seq[seed % 3 : seed % 3 + 3] = "ATG"
    seq[n - 3 :] = rng.choice(("TAA", "TAG", "TGA"))
    if seed % 2:
        seq[4:6], seq[8:10] = "GT", "AG"
    seq = "".join(seq)
    o = [[0.0] + [rng.uniform(-1, 1.5) for _ in range(14)] for _ in range(n)]
    best = max((sum(o[i][s] for i, s in enumerate(p)) for p in paths(n) if legal(seq, p, cds, intron)), default=0.0)
    POSITIVE.append(best > 0)
    for decode in (decode_region, arrays):
        assert sum(s for s, _ in decode(seq, o, cds, intron)) == pytest.approx(max(best, 0.0))


def test_some_paths_had_genes():
    assert not POSITIVE or any(POSITIVE)


@pytest.mark.parametrize("seed", range(40))
def test_arrays_find_the_same_paths(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 400)) if seed else 0
    s = list(rng.choice(list("ACGTN"), n, p=[0.25, 0.2, 0.22, 0.32, 0.01]))
    for _ in range(n // 15):
        k, m = int(rng.integers(0, max(n - 3, 1))), str(rng.choice(["ATG", "TAA", "TGA", "GT", "AG", "GC", "AC", "AT"]))
        s[k : k + len(m)] = list(m)
    seq = "".join(s)[:n]
    o = rng.normal(0.3 if seed % 2 else -0.05, 1.0, (n, 15))
    o[:, 0] = 0
    cds, intron, intercept = int(rng.choice([3, 6, 9, 30, 60])), int(rng.choice([1, 2, 4, 20])), float(rng.choice([0, -3]))
    want, got = decode_region(seq, o.tolist(), cds, intron, intercept), decode_arrays(seq, o, cds, intron, intercept)
    assert [e for _, e in got] == [e for _, e in want]
    assert [x for x, _ in got] == pytest.approx([x for x, _ in want])
