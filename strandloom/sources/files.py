"""Readers of FASTA, GFF and window files as DataFrames, and the checks that they must pass.

Readers give rows lazily; a check is a DataFrame of violations, and `require` raises if it has any.
Gzip files are read as such by their suffix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import bases
from strandloom.operators import ranks
from strandloom.plans.session import written

WINDOW_DDL = "global_window_index bigint, chrom_id string, chrom_length bigint, chrom_index bigint, chrom_window_index bigint, center_start bigint, center_end bigint, chunk_id bigint, chunk_local_index bigint, sequence string"
FASTA, GFF = (".fa", ".fna", ".fasta"), (".gff", ".gff3", ".gtf")
GENES = ("gene", "pseudogene")
TRANSCRIPTS = ("mrna", "transcript", "primary_transcript", "ncrna", "lnc_rna")
CHILDREN = ("cds", "exon", "intron", "start_codon", "stop_codon")


class Violation(ValueError):
    """A check found rows that mustn't be."""


def require(violations: DataFrame, what: str) -> None:
    found = violations.limit(3).collect()
    if found:
        raise Violation(f"{what}: {[r.asDict() for r in found]}")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom_id, chrom_length, seq): records, each up to the next '>' at the beginning of a line; sequences in upper case, blank lines skipped."""
    parts = spark.read.option("lineSep", "\n>").text(path).withColumn("value", F.regexp_replace("value", "\r", ""))
    body = F.regexp_replace(F.col("value"), "^>", "")
    named = parts.filter(F.trim("value") != "").select(F.regexp_extract(body, r"^[ \t]*(\S*)", 1).alias("chrom_id"), F.upper(F.regexp_replace(F.when(F.instr(body, "\n") > 0, F.expr("substr(regexp_replace(value, '^>', ''), instr(regexp_replace(value, '^>', ''), '\n') + 1)")).otherwise(""), r"\s", "")).alias("seq"))
    return named.withColumn("chrom_length", F.length("seq").cast("long")).select("chrom_id", "chrom_length", "seq")


def fasta_problems(spark: SparkSession, path: str) -> DataFrame:
    """(chrom_id, problem) where a file has sequence before its first header."""
    first = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("chrom_id"), "value", F.col("_metadata.file_block_start").alias("at")).withColumn("n", F.monotonically_increasing_id())
    least = first.groupBy("chrom_id").agg(F.min_by("value", F.struct("at", "n")).alias("value"))
    return least.filter("trim(value) <> '' AND NOT startswith(ltrim(regexp_replace(value, '[\\r\\n]', ' ')), '>')").select("chrom_id", F.lit("sequence before the first header").alias("problem"))


def fasta_violations(records: DataFrame) -> DataFrame:
    """(chrom_id, problem) of records without a name or with one that another has."""
    return records.groupBy("chrom_id").agg(F.count("*").alias("n")).withColumn("problem", F.when(F.col("chrom_id") == "", "empty header").when(F.col("n") > 1, "duplicate id")).filter("problem IS NOT NULL").select("chrom_id", "problem")


def gff(spark: SparkSession, path: str) -> DataFrame:
    """Features of a GFF3 or GTF file; see `features`. Lines are numbered in the order of the file within each partition's place."""
    return features(spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()))


def features(lines: DataFrame) -> DataFrame:
    """(line_no, seqid, type, s, e, strand, phase, attributes) of the lines (line_no, value) that hold a feature.

    Blank lines, comments, lines without nine columns or with coordinates that aren't numbers, begin
    below 1 or end before they begin are left out. Starts become 0-based.
    """
    # exploded, so that filters on columns don't cut the line anew
    cut = lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#")).select("line_no", F.explode(F.array(F.split("value", "\t"))).alias("c")).filter(F.size("c") == 9)
    cut = cut.withColumn("a", F.expr("try_cast(get(c, 3) as bigint)")).withColumn("b", F.expr("try_cast(get(c, 4) as bigint)")).filter("a IS NOT NULL AND b IS NOT NULL AND a >= 1 AND b >= a")
    return cut.select("line_no", F.expr("get(c, 0)").alias("seqid"), F.lower(F.expr("get(c, 2)")).alias("type"), (F.col("a") - 1).alias("s"), F.col("b").alias("e"), F.expr("get(c, 6)").alias("strand"), F.expr("CASE WHEN get(c, 7) IN ('0', '1', '2') THEN cast(get(c, 7) as int) END").alias("phase"), F.expr(bases.attributes("get(c, 8)")).alias("attributes"))


def identified(found: DataFrame) -> DataFrame:
    """Features with `id` (the first of ID, transcript_id, gene_id and Name, or one made of the line) and `parents`."""
    a = lambda k: f"nullif(attributes['{k}'], '')"
    listed = lambda kinds: ", ".join(map(repr, kinds))
    made = f"concat(CASE WHEN type IN ({listed(GENES)}) THEN 'gene' WHEN type IN ({listed(TRANSCRIPTS)}) THEN 'transcript' ELSE type END, '@', line_no)"
    return found.withColumn("id", F.expr(f"coalesce({a('ID')}, {a('transcript_id')}, {a('gene_id')}, {a('Name')}, {made})")).withColumn(
        "parents", F.expr(f"array_remove(split(coalesce({a('Parent')}, {a('parent')}, CASE WHEN type IN ({listed(CHILDREN)}) THEN {a('transcript_id')} END, ''), ','), '')")
    )


def hierarchy(found: DataFrame) -> dict[str, DataFrame]:
    """genes (gid, seqid, strand, s, e, attributes, parse_index), transcripts (tid, gid, seqid, strand, s, e, attributes, parse_index, children: how many) and children (tid, type, s, e, phase, attributes) of identified features.

    A transcript belongs to its first parent, else to its gene_id, else to a gene named after it. A
    child goes to each of its parents: to a transcript, to the implicit transcript of a gene, which
    begins with the gene's span, or to a new transcript and gene named after an unknown parent. Genes
    that only transcripts or children name are made with the span of the first of them. Of several
    lines with one id the last counts; children without a parent are dropped. A transcript's span
    reaches over its children.

    What lines say of one name, as its own or as a parent's, meets in one aggregation, which is
    written. `children` goes through `found` again: write it first if they are wanted.
    """
    names = written(_by_name(found), "names")
    of_gene = F.expr("tx IS NULL AND gene IS NOT NULL")
    implicit = ".implicit_transcript"
    none = F.expr("cast(map() as map<string,string>)")
    begin = lambda gid, at, line: F.struct(gid.alias("gid"), *[at[c].alias(c) for c in ("seqid", "strand", "s", "e")], none.alias("attributes"), line.alias("line_no"))
    # what an implicit transcript begins with: its gene's span, or its first child's
    first = F.col("first")
    made = F.when(of_gene, begin(F.col("name"), F.col("gene"), first["line_no"])).otherwise(begin(F.concat(F.lit("gene_for_"), "name"), first, first["line_no"]))
    held = names.filter("tx IS NOT NULL OR n > 0").select(
        F.when(of_gene, F.concat("name", F.lit(implicit))).otherwise(F.col("name")).alias("tid"), F.coalesce("tx", made).alias("x"), F.col("tx").isNull().alias("new"), "cs", "ce", "n"
    )
    # where a gene's implicit transcript has the name of a line's, the line's counts, and children of both are its own
    both = held.filter(F.col("tid").endswith(implicit)).groupBy("tid").agg(F.min_by("x", F.struct("new", "x.line_no")).alias("x"), F.min("cs").alias("cs"), F.max("ce").alias("ce"), F.sum("n").alias("n"))
    begun = held.filter(~F.col("tid").endswith(implicit)).select(*both.columns).unionByName(both)
    spans = begun.select("tid", "x.gid", "x.seqid", "x.strand", F.least("x.s", "cs").alias("s"), F.greatest("x.e", "ce").alias("e"), "x.attributes", F.col("x.line_no").alias("parse_index"), F.col("n").alias("children"))
    genes = names.filter("gene IS NOT NULL").select(F.col("name").alias("gid"), "gene.seqid", "gene.strand", "gene.s", "gene.e", "gene.attributes", F.col("gene.line_no").alias("parse_index"))
    unknown = begun.select("x.gid", "x.seqid", "x.strand", "x.s", "x.e", "x.line_no").join(genes.select("gid"), "gid", "left_anti")
    unknown = unknown.groupBy("gid").agg(F.min_by(F.struct("seqid", "strand", "s", "e", "line_no"), "line_no").alias("x"))
    after = F.lit(1 << 62)  # made genes come behind those of the file
    every = genes.unionByName(unknown.select("gid", "x.seqid", "x.strand", "x.s", "x.e", none.alias("attributes"), (after + F.col("x.line_no")).alias("parse_index")))
    renamed = names.filter(of_gene & (F.col("n") > 0)).select(F.col("name").alias("parent"), F.concat("name", F.lit(implicit)).alias("renamed"))
    child = found.filter(F.col("type").isin(*CHILDREN)).select("type", "s", "e", "phase", "attributes", F.explode("parents").alias("parent")).join(renamed, "parent", "left")
    return {"genes": every, "transcripts": spans, "children": child.select(F.coalesce("renamed", "parent").alias("tid"), "type", "s", "e", "phase", "attributes")}


def _by_name(found: DataFrame) -> DataFrame:
    """(name, gene, tx, first, cs, ce, n) of every id of a gene or transcript and every parent of a child: its last gene and transcript line, and first line, span and number of its children."""
    of = {k: F.col("type").isin(*kinds) for k, kinds in (("gene", GENES), ("tx", TRANSCRIPTS), ("child", CHILDREN))}
    own = F.expr("coalesce(try_element_at(parents, 1), attributes['gene_id'], concat('gene_for_', id))")
    role = F.when(of["gene"], "gene").when(of["tx"], "tx").when(of["child"], "child").alias("role")
    at = ["seqid", "strand", "s", "e"]
    lines = found.filter(F.col("type").isin(*GENES, *TRANSCRIPTS, *CHILDREN)).select(
        role, F.when(of["tx"], own).alias("gid"), *at, F.when(~of["child"], F.col("attributes")).alias("attributes"), "line_no", F.explode(F.when(of["child"], F.col("parents")).otherwise(F.array("id"))).alias("name")
    )
    if_ = lambda role, c: F.when(F.col("role") == role, F.col(c))
    return lines.groupBy("name").agg(
        F.max_by(F.struct(*at, "attributes", "line_no"), if_("gene", "line_no")).alias("gene"), F.max_by(F.struct("gid", *at, "attributes", "line_no"), if_("tx", "line_no")).alias("tx"),
        F.min_by(F.struct(*at, "line_no"), if_("child", "line_no")).alias("first"), F.min(if_("child", "s")).alias("cs"), F.max(if_("child", "e")).alias("ce"), F.count(if_("child", "line_no")).alias("n"),
    )


def windows_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Window rows of tab-separated files; nothing is inferred, and NA is a name like any other."""
    return spark.read.schema(WINDOW_DDL).option("sep", "\t").option("nullValue", "\u0000").option("emptyValue", "").csv(path)


def species(spark: SparkSession, root: str) -> DataFrame:
    """(name, fasta, gff, problem) of each folder below `root`: one file of each kind, or what is wrong."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    inner = files.select("path", F.regexp_replace(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), "%20", " ").alias("name"), F.regexp_replace(F.lower("path"), r"\.gz$", "").alias("p"))
    ends = lambda kinds: F.expr(" OR ".join(f"endswith(p, '{k}')" for k in kinds))
    found = inner.groupBy("name").agg(F.sort_array(F.collect_list(F.when(ends(FASTA), F.col("path")))).alias("f"), F.sort_array(F.collect_list(F.when(ends(GFF), F.col("path")))).alias("g"))
    problem = F.when(F.size("f") != 1, F.format_string("%d FASTA files", F.size("f"))).when(F.size("g") != 1, F.format_string("%d GFF files", F.size("g")))
    return found.select("name", F.expr("try_element_at(f, 1)").alias("fasta"), F.expr("try_element_at(g, 1)").alias("gff"), problem.alias("problem"))


def manifest_order_violations(manifest: DataFrame) -> DataFrame:
    """(chrom_id, problem) of records whose chrom_index doesn't count on from 0, or whose id isn't unique."""
    numbered = ranks.sums_before(manifest.groupBy("chrom_index").agg(F.count("*").alias("n"), F.min("chrom_id").alias("chrom_id")), "chrom_index", "n", "r")
    order = numbered.filter("r <> chrom_index OR n > 1").select("chrom_id", F.lit("index isn't consecutive").alias("problem"))
    return order.unionByName(manifest.groupBy("chrom_id").agg(F.count("*").alias("n")).filter("n > 1").select("chrom_id", F.lit("id isn't unique").alias("problem")))


def manifest_violations(manifest: DataFrame, track: DataFrame) -> DataFrame:
    """(chrom_id, problem): what differs between a manifest (chrom_id, chrom_length, chrom_index, num_windows) and a track (chrom_id, pos)."""
    held = track.groupBy("chrom_id").agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    joined = manifest.join(held, "chrom_id", "full")
    cover = joined.filter("chrom_length IS NULL OR n IS NULL OR n <> chrom_length OR lo <> 0 OR hi <> chrom_length - 1").select("chrom_id", F.lit("positions don't cover the record").alias("problem"))
    return manifest_order_violations(manifest).unionByName(cover)


def folder(spark: SparkSession, path: str):
    """The file system of `path` and the path in it, as Hadoop knows them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_gff3(lines: DataFrame, path: str, records: DataFrame | None = None) -> None:
    """(chrom_id, number, line_rank, line) as GFF3 text in order, in files whose names follow the order.

    The version comes first. With records (chrom_id, chrom_index, chrom_length) each record begins with
    its sequence-region, those without genes too, and its genes follow; numbers go up with chrom_index.
    Genes of a record are parted by ###.
    """
    head = F.lit("##gff-version 3")
    if records is None:
        own = lines.select(F.lit(0).cast("long").alias("of"), "number", "line_rank", F.when(F.col("line_rank") == 0, F.when(F.col("number") == 1, F.concat(head, F.lit("\n"), "line")).otherwise(F.concat(F.lit("###\n"), "line"))).otherwise(F.col("line")).alias("value"))
    else:
        region = F.concat(F.lit("##sequence-region "), "chrom_id", F.lit(" 1 "), F.col("chrom_length").cast("string"))
        first = F.when(F.col("chrom_index") == 0, F.concat(head, F.lit("\n"), region)).otherwise(region)
        regions = records.select(F.col("chrom_index").cast("long").alias("of"), F.lit(0).cast("long").alias("number"), F.lit(-1).alias("line_rank"), first.alias("value"))
        placed = lines.join(records.select("chrom_id", F.col("chrom_index").cast("long").alias("of")), "chrom_id")
        parted = F.when((F.col("line_rank") == 0) & (F.col("number") > 1), F.concat(F.lit("###\n"), "line")).otherwise(F.col("line"))
        own = regions.unionByName(placed.select("of", F.col("number").cast("long").alias("number"), F.col("line_rank").cast("int").alias("line_rank"), parted.alias("value")))
    own = written(own, "gff3-lines")  # ranges are drawn from what is written
    own.repartitionByRange("of", "number").sortWithinPartitions("of", "number", "line_rank").select("value").write.text(path)


def write_dataset(rows: DataFrame, path: str, shard_rows: int = 50_000, overwrite: bool = False) -> None:
    """Rows as Parquet in shards, written under a staged name and given theirs once they are whole.

    An existing whole dataset is kept unless `overwrite`. One that isn't whole is an error, and so is a
    dataset without rows.
    """
    spark, staged = rows.sparkSession, f"{path.rstrip('/')}.staged"
    fs, where = folder(spark, path)
    if fs.exists(where) and not overwrite:
        if fs.exists(folder(spark, f"{path}/_SUCCESS")[1]):
            return
        raise Violation(f"{path} is there but incomplete")
    rows.write.option("maxRecordsPerFile", shard_rows).mode("overwrite").parquet(staged)
    if spark.read.schema(rows.schema).parquet(staged).isEmpty():
        fs.delete(folder(spark, staged)[1], True)
        raise Violation(f"{path} would have no rows")
    fs.delete(where, True)
    if not fs.rename(folder(spark, staged)[1], where):
        raise Violation(f"{staged} can't be renamed to {path}")
