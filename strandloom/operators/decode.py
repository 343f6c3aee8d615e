"""Best legal gene paths in candidate regions: one region a group, decoded with Arrow in a task.

Scores are sums of log odds against the background, which itself scores 0. A path outside genes
waits; a gene begins at ATG, reads codons, may leave at a donor and come back at an acceptor of the
same phase that its motif allows, and ends at a stop codon in frame. States carry the number of
coding bases, capped at the least that a gene must have, and the base or bases of a codon that an
intron has split. Equal scores keep the first path found.

`decode_arrays` is what regions are decoded with; `decode_region` finds the same paths state by state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.bases import STOPS
from strandloom.functions.track import N_STATES, Calibration

# Which frame follows which state, the phase of a donor behind a frame, and the motifs of donors and acceptors.
FOLLOWS = {7: 5, 4: 5, 11: 5, 5: 6, 12: 6, 6: 4, 13: 4}
PHASE = {6: 0, 4: 1, 5: 2}
DONOR, ACCEPTOR = {0: 8, 1: 9, 2: 10}, {0: 12, 1: 13, 2: 11}
PAIRS = {"GT": "AG", "GC": "AG", "AT": "AC"}
GENE = "chrom_id string, strand string, region long, gene int, score double, exons array<struct<s:bigint,e:bigint>>"


def decode_region(seq: str, odds: list[list[float]], min_cds: int = 60, min_intron: int = 20, intercept: float = 0.0) -> list[tuple[float, list[tuple[int, int]]]]:
    """(score, exons in transcript order) of the genes on the best path through an oriented region.

    seq: its bases; odds[i][state]: log odds against the background at base i.

    A donor closes its exon at its own base, an acceptor opens one at its own. Introns score by prefix
    sums, so a donor waits in a bucket of its phase, motif, split bases and count with its score less
    the prefix, and the best of a bucket serves every later acceptor.
    """
    n = len(seq)
    prefix = [[0.0] * (n + 1) for _ in range(3)]
    for k in range(3):
        for i in range(n):
            prefix[k][i + 1] = prefix[k][i] + odds[i][k + 1]
    outside, done = 0.0, None  # the best score outside genes with a base since the last stop, and its genes
    stopped: tuple[float, tuple | None] | None = None
    active: dict[tuple, tuple] = {}  # (state, count, split bases) -> (score, score before the gene, exons, start of exon, genes before)
    waiting: dict[int, list] = {}
    buckets: dict[tuple, tuple] = {}
    for i in range(n):
        for key, value in waiting.pop(i, ()):
            if key not in buckets or value[0] > buckets[key][0]:
                buckets[key] = value
        fresh: dict[tuple, tuple] = {}

        def offer(key: tuple, value: tuple, into: dict[tuple, tuple] = fresh) -> None:
            if key not in into or value[0] > into[key][0]:
                into[key] = value

        ended: tuple[float, tuple] | None = None
        two = seq[i - 1 : i] if i else ""
        for (state, count, split), (score, before, exons, begin, genes) in active.items():
            to = FOLLOWS.get(state)
            if to is None:
                continue
            more = min(count + 1, min_cds)
            # a stop codon may end the gene where its third base would be read
            codon = (split + two + seq[i]) if split else seq[i - 2 : i + 1]
            if state == 5 and not split and codon in STOPS:
                if more >= min_cds:
                    total = score + odds[i][14]
                    if ended is None or total > ended[0]:
                        ended = (total, (genes, total - before, (*exons, (begin, i + 1))))
                continue
            if to == 6 and codon in STOPS:
                continue
            value = (score + odds[i][to], before, exons, begin, genes)
            offer((to, more, ""), value)
            phase = PHASE.get(state)
            motif = seq[i + 1 : i + 3]
            if phase is not None and motif in PAIRS:
                held = {4: seq[i], 5: seq[i - 1 : i + 1], 6: ""}[to]
                at = i + 1 + min_intron
                if at < n:
                    score_out = score + odds[i][DONOR[phase]]
                    waiting.setdefault(at, []).append(((phase, motif, held, more), (score_out - prefix[phase][i + 1], before, (*exons, (begin, i + 1)), genes)))
        if i >= 2:
            end = seq[i - 2 : i]
            for (phase, motif, held, count), (score, before, exons, genes) in buckets.items():
                if PAIRS[motif] != end:
                    continue
                state = ACCEPTOR[phase]
                if state == 13 and held + seq[i] in STOPS:
                    continue
                value = (score + prefix[phase][i] + odds[i][state], before, exons, i, genes)
                offer((state, min(count + 1, min_cds), held if state == 12 else ""), value)
        if seq[i : i + 3] == "ATG":
            offer((7, min(1, min_cds), ""), (outside + intercept + odds[i][7], outside, (), i, done))
        if stopped is not None and stopped[0] > outside:
            outside, done = stopped
        stopped = ended
        active = fresh
    if stopped is not None and stopped[0] > outside:
        outside, done = stopped
    out = []
    while done is not None:
        done, score, exons = done
        out.append((score, list(exons)))
    return out[::-1]


_NONE = -np.inf
#: Phases of the rows of waiting introns: phase 0 without a split T, and any; phase 1 without split TA and TG, without TA, and any; phase 2.
_ROWS = np.array([0, 0, 1, 1, 1, 2])


def decode_arrays(seq: str, odds: np.ndarray, min_cds: int = 60, min_intron: int = 20, intercept: float = 0.0) -> list[tuple[float, list[tuple[int, int]]]]:
    """What decode_region gives, with all coding counts at once; odds: (bases, states).

    A path inside an exon scores as a prefix sum of its reading frame says, so it is kept as its score
    less that sum, in the row of its frame, at the place of (base less coding count). There it stays
    valid without any step: behind base i the counts below min_cds are a slice of the row, and the
    place before the slice gathers those that have reached it. Work is done only where a codon or a
    motif asks for it: donors send the slices of all frames to the waiting introns, acceptors put the
    best of each count back, shifted by their own base. Introns keep the best of each count by motif
    and by the stop codons that they can't become.
    """
    n, cap = len(seq), min_cds
    if n == 0:
        return []
    places = np.arange(n)
    frames = np.stack([np.concatenate(([0.0], np.cumsum(odds[places, 4 + (places - r) % 3]))) for r in range(3)])
    introns = np.concatenate((np.zeros((1, 3)), np.cumsum(odds[:, 1:4], axis=0))).T
    # what a donor and an acceptor at a base add in each frame: its own score, and the sums of what it leaves and enters
    phases = (places - np.arange(3)[:, None]) % 3
    leaving = frames[:, :-1] + odds[places, np.array([DONOR[k] for k in range(3)])[phases]] - introns[phases, places + 1]
    behind = (phases - 1) % 3
    arriving = introns[behind, places] + odds[places, np.array([ACCEPTOR[k] for k in range(3)])[behind]] - frames[:, 1:]
    # which rows a donor goes to, and which row an acceptor takes in each frame: those whose split bases it can't make a stop codon of
    bases = np.frombuffer(f"-{seq}-".encode(), np.uint8)
    last, here, ahead = (tuple(bases[k : k + n] == ord(x) for x in "AGT") for k in range(3))
    ta, tg = last[2] & here[0], last[2] & here[1]
    every = np.ones(n, bool)
    kept = np.stack([~here[2], every, ~(ta | tg), ~ta, every, every])
    sending = np.where(kept, leaving[(places - _ROWS[:, None]) % 3, places], _NONE)
    sources = [(i - _ROWS) % 3 for i in range(3)]
    split_t = (here[0] & (ahead[0] | ahead[1])) | (here[1] & ahead[0])
    takes = np.stack([np.where(split_t, 0, 1), np.where(here[0], 2, np.where(here[1], 3, 4)), np.full(n, 5)])[behind, places]
    shift = cap + 2
    best, node = np.full((3, n + shift + 1), _NONE), np.full((3, n + shift + 1), -1, np.int64)  # a node's number stands in the high bits
    read = [memoryview(best[r]) for r in range(3)]
    held, links = np.full((2, len(_ROWS), cap), _NONE), np.full((2, len(_ROWS), cap), -1, np.int64)  # links: node and end of exon
    numbers = np.arange(3 * cap, dtype=np.int64).reshape(3, cap) << 32
    nodes: list[tuple] = []  # (base, links by frame and count), or of a start (base, None, score before, genes before)
    waiting: dict[int, tuple] = {}
    entering: list[tuple[int, np.ndarray, np.ndarray]] = []
    stopped: list[tuple[int, float, tuple]] = []
    outside, done = 0.0, None
    for i in range(n):
        low, high = i - cap + shift, i + shift  # places of the counts min_cds (and more) to 1 behind base i
        for r, row in enumerate(read):
            if row[low - 1] > row[low]:
                row[low] = row[low - 1]
                node[r, low] = node[r, low - 1]
        if i in waiting:
            k, score, link = waiting.pop(i)
            better = score > held[k]
            np.copyto(held[k], score, where=better)
            np.copyto(links[k], link, where=better)
        if seq[i - 2 : i + 1] in STOPS:
            r = (i - 2) % 3
            if read[r][low] > _NONE:
                stopped.append((i, read[r][low] + frames[r, i] + odds[i, 14], (int(node[r, low]) + i + 1)))
            best[r, low - 2 : high] = _NONE
        motif = PAIRS.get(seq[i + 1 : i + 3])
        if motif and i + 1 + min_intron < n:
            frame = sources[i % 3]
            waiting[i + 1 + min_intron] = (int(motif == "AC"), best[:, low:high].take(frame, axis=0) + sending[:, i, None], node[:, low:high].take(frame, axis=0) + (i + 1))
        for a, score, who in entering:
            place = slice(a - cap - 1 + shift, a - 1 + shift)
            better = score > best[:, place]
            np.copyto(best[:, place], score, where=better)
            np.copyto(node[:, place], who, where=better)
            for r, row in enumerate(read):  # what has the least count or more by now
                for x in (low - 1, low):
                    if row[x - 1] > row[x]:
                        row[x] = row[x - 1]
                        node[r, x] = node[r, x - 1]
        entering.clear()
        end = seq[i - 2 : i]
        if end == "AG" or end == "AC":
            k, rows = int(end == "AC"), takes[:, i]
            entering.append((i, held[k].take(rows, axis=0) + arriving[:, i, None], numbers + (3 * cap * len(nodes) << 32)))
            nodes.append((i, links[k].take(rows, axis=0)))
        if seq[i : i + 3] == "ATG":
            while stopped and stopped[0][0] + 2 <= i:
                _, score, gene = stopped.pop(0)
                if score > outside:
                    outside, done = score, (score, gene)
            score = np.full((3, cap), _NONE)
            score[i % 3, -1] = outside + intercept + odds[i, 7] - frames[i % 3, i + 1]
            # a start has no base before its own: one place further than behind an acceptor
            entering.append((i + 1, score, np.full((3, cap), 3 * cap * len(nodes) << 32)))
            nodes.append((i, None, outside, done))
    for _, score, gene in stopped:
        if score > outside:
            outside, done = score, (score, gene)
    out = []
    while done is not None:
        total, link = done
        exons = []
        while True:
            block, own = divmod(link >> 32, 3 * cap)
            made = nodes[block]
            exons.append((made[0], link & 0xFFFFFFFF))
            if made[1] is None:
                break
            link = int(made[1].flat[own])
        out.append((float(total - made[2]), exons[::-1]))
        done = made[3]
    return out[::-1]


def label_odds(p: list[list[float]], calibration: Calibration) -> np.ndarray:
    """Scores of each base's states against the background; probabilities must be 15 finite values of 0 or more a base."""
    if not len(p):
        return np.zeros((0, N_STATES))
    values = np.asarray(p, dtype=np.float64)
    if values.shape != (len(p), N_STATES) or not np.isfinite(values).all() or (values < 0).any():
        raise ValueError(f"probabilities must be {N_STATES} finite values of 0 or more")
    logs = np.log(np.maximum(values, calibration.epsilon))
    return (logs - logs[:, :1]) * calibration.scale + calibration.bias


def decode_regions(regions: DataFrame, min_cds: int = 60, min_intron: int = 20, least_mean: float = 0.5, intercept: float = 0.0, calibration: Calibration | None = None) -> DataFrame:
    """Genes of `regions` (chrom_id, strand, region, start, stop, seq, p): bases and state probabilities of each region in forward coordinates.

    A region on the other strand is turned before and its exons are mapped back; exons stay in
    transcript order. Genes whose mean score over their span is under `least_mean` are left out. A
    calibration gives the factor, constant and floor of each state and replaces `intercept` by its own.
    """
    if min_cds < 3 or min_intron < 1:
        raise ValueError("min_cds must be 3 or more, min_intron 1 or more")
    known = calibration or Calibration(gene_intercept=intercept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = str.maketrans("ACGTN", "TGCAN")
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                seq, p = r["seq"], r["p"]
                if r["strand"] == "-":
                    seq, p = seq.translate(turn)[::-1], p[::-1]
                for k, (score, exons) in enumerate(decode_arrays(seq, label_odds(p, known), min_cds, min_intron, known.gene_intercept)):
                    if r["strand"] == "-":
                        exons = [(len(seq) - e, len(seq) - s) for s, e in exons]
                    exons = [{"s": r["start"] + s, "e": r["start"] + e} for s, e in exons]
                    if score >= least_mean * (max(x["e"] for x in exons) - min(x["s"] for x in exons)):
                        rows.append({"chrom_id": r["chrom_id"], "strand": r["strand"], "region": r["region"], "gene": k, "score": score, "exons": exons})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("chrom_id", pa.string()), ("strand", pa.string()), ("region", pa.int64()), ("gene", pa.int32()), ("score", pa.float64()), ("exons", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))]))

    chosen = regions.select("chrom_id", "strand", "region", "start", "seq", "p")
    return chosen.repartition("chrom_id", "strand", "region").mapInArrow(run, GENE)


def region_views(positions: DataFrame, regions: DataFrame) -> DataFrame:
    """`regions` (chrom_id, strand, region, start, stop) with the bases and probabilities of their positions (chrom_id, strand, pos, base, p)."""
    from strandloom.operators.intervals import overlapping

    points = positions.select("chrom_id", "strand", F.col("pos").alias("rs"), (F.col("pos") + 1).alias("re"), "base", "p")
    met = overlapping(regions.withColumnRenamed("start", "s").withColumnRenamed("stop", "e"), points, ["chrom_id", "strand"])
    grouped = met.groupBy("chrom_id", "strand", "region", F.col("s").alias("start")).agg(F.array_sort(F.collect_list(F.struct("rs", "base", "p"))).alias("x"))
    return grouped.select("chrom_id", "strand", "region", "start", F.array_join(F.transform("x", lambda x: x["base"]), "").alias("seq"), F.transform("x", lambda x: x["p"]).alias("p"))
