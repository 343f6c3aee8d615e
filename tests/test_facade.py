"""Whole dataflows on small records, and labels against a base-by-base version."""

import random


from strandloom.operators import training
from strandloom.plans import config, facade
from strandloom.sources import files


def plain_labels(blocks, strand):
    """{position: label} of a transcript, base by base. blocks: (start, end, annotated phase)."""
    ordered = sorted(blocks, reverse=strand == "-")
    bases = [(k, p) for k, (s, e, _) in enumerate(ordered) for p in (range(s, e) if strand == "+" else range(e - 1, s - 1, -1))]
    sizes = [e - s for s, e, _ in ordered]
    out, phase, left = {}, 0, {}
    for i, (k, p) in enumerate(bases):
        at = i - sum(sizes[:k])
        many, raw = len(ordered) > 1, ordered[0][2] or 0
        if i == 0:
            x = 7
        elif i == len(bases) - 1:
            x = 14
        elif many and k == len(ordered) - 1 and sizes[k] == 2 and at == 0:
            x = 5
        elif many and k == 0 and sizes[0] == 2 and at == 1:
            x = {0: 9, 1: 10, 2: 8}[raw]
        elif at == 0 and k:
            x = 11 + phase
        elif at == sizes[k] - 1 and k < len(ordered) - 1:
            x = 8 + phase
        else:
            x = 4 + phase
        out[p] = x
        if many and k == 0 and sizes[0] < 3 and at == sizes[0] - 1:
            left[k], phase = (raw + 1) % 3, (raw + 2) % 3
        else:
            left[k], phase = phase, (phase + 1) % 3
    for k, (a, b) in enumerate(zip(ordered, ordered[1:], strict=False)):
        lo, hi = (a[1], b[0]) if strand == "+" else (b[1], a[0])
        out |= dict.fromkeys(range(lo, hi), 1 + left[k])
    return out


def test_labels_of_windows(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for t in range(14):
        strand, at, blocks = "+-"[t % 2], 5, []
        for _ in range(rng.randint(1, 4)):
            size = rng.choice((1, 2, 3, 7, 12))
            blocks.append((at, at + size, rng.randrange(3)))
            at += size + rng.randint(1, 9)
        want[t] = (strand, plain_labels(blocks, strand))
        rows += [(f"c{t}", "t%d" % t, strand, s, e, p) for s, e, p in blocks]
    frame = spark.createDataFrame(rows, "chrom_id string, tid string, strand string, s long, e long, raw int")
    windows = spark.createDataFrame([(f"c{t}", -10, 90, f"c{t}", 80, "A" * 100) for t in range(14)], "chrom_id string, window_start long, window_end long, window_id string, chrom_length long, sequence string")
    got = {r.chrom_id: r for r in training.labelled_windows(windows, frame, flank=10).collect()}
    for t, (strand, labels) in want.items():
        row = 0 if strand == "+" else 1
        assert list(got[f"c{t}"].labels[row]) == [labels.get(p, 0) for p in range(-10, 90)], (t, strand)
        assert list(got[f"c{t}"].weights[0]) == [0] * 10 + [1] * 80 + [0] * 10


def test_masks(spark):
    frame = spark.createDataFrame([("c", "t", "+", 5, 14, 0)], "chrom_id string, tid string, strand string, s long, e long, raw int")
    windows = spark.createDataFrame([("c", 0, 40, "w", 40, "A" * 40)], "chrom_id string, window_start long, window_end long, window_id string, chrom_length long, sequence string")
    masks = lambda *m: spark.createDataFrame([("c", *x) for x in m], "chrom_id string, strand string, s long, e long, weight double")
    [r] = training.labelled_windows(windows, frame, masks(("+", 0, 9, 0.5), ("+", 5, 7, 0.0)), flank=0).collect()
    assert list(r.weights[0][:10]) == [0.5] * 5 + [0] * 2 + [0.5] * 2 + [1] and list(r.labels[0][:9]) == [0] * 7 + [6, 4]
    assert training.labelled_windows(windows, frame, masks((".", 0, 40, 0.0)), flank=0).count() == 0


GENE = "ATG" + "GCA" * 30 + "TAA"


def gene_scorer(gene):
    """A scorer that is sure of one gene on the + strand, and of background elsewhere; made here, so that tasks get it by value."""

    def scorer(sequences):
        out = []
        for s in sequences:
            z = [[8.0] + [0.0] * 14 + [8.0] + [0.0] * 14 for _ in s]
            at = s.find(gene)
            if at >= 0:
                for k in range(len(gene)):
                    state = 7 if k == 0 else 14 if k == len(gene) - 1 else 4 + k % 3
                    z[at + k][0], z[at + k][state] = 0.0, 8.0
            out.append(z)
        return out

    return scorer


def test_prediction_to_gff3(spark, tmp_path):
    rng = random.Random(1)
    seq = "".join(rng.choice("CT") for _ in range(700)) + GENE + "".join(rng.choice("CT") for _ in range(900))
    records = spark.createDataFrame([("c1", 0, seq)], "chrom_id string, chrom_index long, seq string")
    track = facade.predict(records, gene_scorer(GENE), window=600, flank=150)
    assert track.count() == 2 * len(seq)
    lines = facade.annotate(track.cache(), records)
    files.write_gff3(lines, f"{tmp_path}/out")
    back = files.gff(spark, f"{tmp_path}/out").filter("type = 'cds'").collect()
    assert [(r.seqid, r.s, r.e, r.strand, r.phase) for r in back] == [("c1", 700, 700 + len(GENE), "+", 0)]


def test_preparation(spark):
    seq = "C" * 300 + GENE + "C" * 300
    records = spark.createDataFrame([("c1", seq)], "chrom_id string, seq string")
    text = [f"c1\ts\tgene\t301\t{300 + len(GENE)}\t.\t+\t.\tID=g", f"c1\ts\tmRNA\t301\t{300 + len(GENE)}\t.\t+\t.\tID=t;Parent=g", f"c1\ts\tCDS\t301\t{300 + len(GENE)}\t.\t+\t0\tParent=t"]
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "line_no long, value string")
    got = facade.prepare(records, files.features(lines), window=400, flank=50, overlap=100, most_ambiguous=50)
    assert got["quality"].first().mask == 1.0 and got["quality"].first().tid == "t" and got["genes"].first().tid == "t"
    other = spark.createDataFrame([("c1", seq.replace("ATG", "ATC", 1))], "chrom_id string, seq string")
    lost = facade.prepare(other, files.features(lines), window=400, flank=50, overlap=100, most_ambiguous=50)["quality"].first()
    assert lost.mask == 0.0 and lost.zero_reasons == ["noncanonical_start_codon"]
    rows = got["windows"].collect()
    assert rows and sum(sum(1 for x in r.labels[0] if x == 7) for r in rows) >= 1 and all(len(r.input_ids) == 402 for r in rows)




def test_preparation_of_several_genes(spark, tmp_path):
    """A rejected gene is in nobody's way, genes without transcripts or coding blocks are told, and quality stays as it was where labels collide."""
    seq = "C" * 200 + GENE + "C" * 100 + GENE + "C" * 200
    first, second = (seq.index(GENE), seq.rindex(GENE))
    n = len(GENE)

    def lines(name, s, e, strand="+", cds=True, tx=True, extra=""):
        out = [f"c1\ts\tgene\t{s + 1}\t{e}\t.\t{strand}\t.\tID={name};gene_biotype=protein_coding{extra}"]
        out += [f"c1\ts\tmRNA\t{s + 1}\t{e}\t.\t{strand}\t.\tID=t{name};Parent={name}"] * tx
        return out + [f"c1\ts\tCDS\t{s + 1}\t{e}\t.\t{strand}\t0\tParent=t{name}"] * (cds and tx)

    text = [
        *lines("good", first, first + n), *lines("broken", first + 3, first + 63), *lines("same", second, second + n), *lines("twin", second, second + n),
        *lines("bare", 10, 90, tx=False), *lines("blank", 100, 190, cds=False), "c1\ts\tgene\t1\t50\t.\t+\t.\tID=rna;gene_biotype=lncRNA",
    ]
    features = files.features(spark.createDataFrame(list(enumerate(text)), "line_no long, value string"))
    records = spark.createDataFrame([("c1", seq)], "chrom_id string, seq string")
    settings = config.Preparation(window=400, flank=50, overlap=100, most_ambiguous=50)
    got = facade.prepare(records, features, settings.window, settings.flank, settings.overlap, settings.most_ambiguous, settings.rules())
    quality = {r.gid: r for r in got["quality"].collect()}
    assert {g: r.mask for g, r in quality.items()} == {"good": 1.0, "broken": 0.0, "same": 1.0, "twin": 1.0, "bare": 0.0, "blank": 0.0}
    assert quality["bare"].zero_reasons == ["no_transcript"] and quality["bare"].tid == "" and "no_CDS" in quality["blank"].zero_reasons
    safe = {r.gid: (r.mask, r.selected, "same_strand_label_overlap" in r.zero_reasons) for r in got["labelling"].collect()}
    assert safe["good"] == (1.0, True, False) and safe["same"] == safe["twin"] == (0.0, False, True) and safe["broken"][2] is False
    every = {r.gid: (r.tid, r.mask, r.judged) for r in got["genes"].collect()}
    assert every["rna"] == (None, 1.0, False) and every["bare"] == (None, 0.0, True) and every["good"] == ("tgood", 1.0, True)
    facade.write_prepared(got, records, f"{tmp_path}/out", settings)
    [summary] = spark.read.json(f"{tmp_path}/out/qc/summary").collect()
    assert summary.genes_with_protein_coding_transcripts == 6 and summary.gene_mask_counts.asDict() == {"0.0": 3, "0.5": 0, "1.0": 3}
    [manifest] = spark.read.json(f"{tmp_path}/out/manifest").collect()
    assert (manifest.fasta_records, manifest.parsed_genes, manifest.rows) == (1, 7, spark.read.parquet(f"{tmp_path}/out/dataset").count())
    assert spark.read.option("sep", "\t").option("header", "true").csv(f"{tmp_path}/out/qc/masked").count() == 3
    assert '"policy": "longest_cds"' in spark.read.json(f"{tmp_path}/out/settings").first().settings
