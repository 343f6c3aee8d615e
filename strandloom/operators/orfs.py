"""Complete open reading frames of one exon, and genes as GFF3 lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import bases
from strandloom.operators import ranks

#: A start codon and what follows it up to the first stop codon in frame; codons are parted by a space.
ORF = r"ATG (?:(?!TAA|TAG|TGA)[A-Z]{3} )*+(?:TAA|TAG|TGA)"


def open_reading_frames(records: DataFrame, least: int = 60) -> DataFrame:
    """(chrom_id, chrom_index, strand, s, e): from the first start codon behind a stop codon to the next stop codon, in forward coordinates. Records have different ids."""
    both = records.select("chrom_id", "chrom_index", F.length("seq").alias("n"), F.explode(F.create_map(F.lit("+"), F.col("seq"), F.lit("-"), F.expr(bases.reverse_complement("seq")))).alias("strand", "seq"))
    frames = both.withColumn("frame", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    frames = frames.withColumn("codons", F.expr("regexp_replace(substr(seq, frame + 1), '(...)', '$1 ')"))
    lengths = f"zip_with(regexp_extract_all(codons, r'{ORF}', 0), split(codons, r'{ORF}', -1), (x, g) -> struct(length(g) + length(x) AS step, length(x) AS x))"
    steps = frames.select("chrom_id", "chrom_index", "strand", "n", "frame", F.posexplode(F.expr(lengths)).alias("i", "o")).filter("o.x IS NOT NULL")
    # only lengths are shuffled; a frame's are added up in order, so that no array grows by one match at a time
    order = Window.partitionBy("chrom_index", "chrom_id", "strand", "frame").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    orfs = steps.withColumn("end", F.sum(F.col("o.step").cast("long")).over(order))
    a, b = F.expr("(end - o.x) div 4 * 3 + frame"), F.expr("(end + 1) div 4 * 3 + frame")
    plus = F.col("strand") == "+"
    return orfs.filter(b - a >= least).select("chrom_id", "chrom_index", "strand", F.when(plus, a).otherwise(F.col("n") - b).cast("long").alias("s"), F.when(plus, b).otherwise(F.col("n") - a).cast("long").alias("e"))


def ranked(genes: DataFrame) -> DataFrame:
    """`genes` (chrom_id, chrom_index, strand, s, e) with their number over the whole file: + by (start, end), then - by (-end, end).

    Ranks are taken inside each record, and records are numbered by ranges.
    """
    plus = F.col("strand") == "+"
    order = Window.partitionBy("chrom_id").orderBy("strand", F.when(plus, F.col("s")).otherwise(-F.col("e")), "e", "s")
    counts = genes.groupBy("chrom_index").agg(F.count("*").alias("n"))
    counts = ranks.sums_before(counts, "chrom_index", "n", "first").drop("n")
    return genes.withColumn("rank", F.row_number().over(order)).join(counts, "chrom_index").withColumn("number", F.col("first") + F.col("rank")).drop("first")


def gff3_lines(genes: DataFrame, source: str = "strandloom") -> DataFrame:
    """(number, line_rank, line) of genes with exons: (chrom_id, strand, number, exons array<struct<s,e>> by coordinate). Phases count in transcript direction."""
    done = "aggregate(filter(exons, (x, j) -> CASE WHEN strand = '+' THEN j < k ELSE j > k END), 0L, (a, x) -> a + x.e - x.s)"
    phase = f"cast({bases.first_phase(done)} as string)"
    span = "concat_ws('\\t', cast(exons[0].s + 1 as string), cast(element_at(exons, -1).e as string), '.', strand, '.')"
    gid = "concat('geneid-', number)"
    head = f"array(concat_ws('\\t', chrom_id, '{source}', 'gene', {span}, concat('ID=', {gid}, ';Name=', {gid}, ';biotype=protein_coding')), concat_ws('\\t', chrom_id, '{source}', 'mRNA', {span}, concat('ID=', {gid}, '.t;Parent=', {gid})))"
    part = lambda kind, mark, ph: f"concat_ws('\\t', chrom_id, '{source}', '{kind}', cast(x.s + 1 as string), cast(x.e as string), '.', strand, {ph}, concat('ID=', {gid}, '.{mark}', k + 1, ';Parent=', {gid}, '.t'))"
    body = f"flatten(transform(exons, (x, k) -> array({part('exon', 'e', chr(39) + '.' + chr(39))}, {part('CDS', 'c', phase)})))"
    return genes.select("chrom_id", "number", F.posexplode(F.expr(f"concat({head}, {body})")).alias("line_rank", "line"))
