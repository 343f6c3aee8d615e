"""Personal data by bootstrapped contextual extraction, in DataFrame and SQL functions only.

Fixed patterns find e-mail addresses, network addresses, card numbers and telephone numbers, and
strings that are keys by their form alone (long hexadecimal runs, long runs that change between
letters and digits again and again). These are the seeds. What stands around a seed, the last word before it with its punctuation and the word
behind it, is a lexical pattern; without a word it is none. Other strings that look like identifiers
(long runs of letters and digits, or of digits, or several groups of them with blanks between) are
instances too, of unknown worth. Patterns and instances form a graph that
is scored in rounds: a pattern by the mean score of the distinct instances that it extracts, an
unknown instance by the patterns that extract it, together (noisy or). What has a seed's form but fails its check (a
card number without the right check digit) is a counter-example, which counts against its patterns.
Patterns that many seeds support and that score high discover the unknown instances around which
they stand, and what is discovered is a seed of the next round, until a round changes nothing.

Texts are read once. The graph has an edge for each distinct pair of instance and pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.plans.session import table, written

SQL = None
KINDS = ("email", "ip", "card", "phone")
#: The kinds' patterns. \G or a look-behind keeps a match from being tried at every place of a long run, which
#: couldn't give another match; possessive repeats keep it from being tried again in a shorter form.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be looked for.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Strings that may be identifiers: eight or more letters, digits, dashes and underlines, with a digit.
CANDIDATE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{8,}+"
#: The same in groups of two or more with a digit each, one blank between; all of eight letters and digits or more.
_GROUP = r"(?=[A-Za-z0-9]{2})[A-Za-z]*+[0-9][A-Za-z0-9]*+"
SPACED = rf"(?<![A-Za-z0-9_-]){_GROUP}(?:\x20{_GROUP})++(?![A-Za-z0-9_-])"
#: Those that need no context: hexadecimal with letters, or four changes from letters to digits.
KEY = r"^(?=[0-9]*+[A-Fa-f])[0-9A-Fa-f]{32,}+$|^(?=.{20})[0-9_-]*+(?:[A-Za-z_-]++[0-9][0-9_-]*+){4}"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
#: The word before a string and its punctuation, the word behind it, each within REACH letters of the text between two matches.
BEFORE, AFTER, REACH = r"\p{L}+[^\p{L}0-9]{0,8}$", r"^[^\p{L}0-9]{0,8}\p{L}+", 40
#: Matches whose places are added up at a time.
CHUNK = 256
LEAST_SEEDS, LEAST_PATTERN, LEAST_INSTANCE = 3, 0.5, 0.75
#: A score that rises by less has not changed.
STILL = 0.01
SPAN = "array<struct<kind:string,start:int,stop:int,value:string,left:string,right:string>>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def spans_of(kind: str, pattern: str, text: str = "__text") -> Column:
    """All matches of `pattern` as (kind, start, stop, value, left, right), in code points; left and right are the words around it.

    The places are the added up lengths of matches and of the texts between them, CHUNK matches at a
    time and then the chunks, so the work is nearly linear in a text's matches.
    """
    gaps, found = f"split({text}, {_quoted(pattern)}, -1)", f"regexp_extract_all({text}, {_quoted(pattern)}, 0)"
    left = f"concat('< ', regexp_extract(lower(right(z.g, {REACH})), {_quoted(BEFORE)}, 0))"
    right = f"concat('> ', regexp_extract(lower(left(z.h, {REACH})), {_quoted(AFTER)}, 0))"
    none = f"cast(array() as {SPAN})"
    rows = f"""transform(array(struct({found} AS f, {gaps} AS g)), v -> transform(zip_with(zip_with(v.f, slice(v.g, 1, size(v.f)), (x, g) -> struct(x AS x, g AS g)), slice(v.g, 2, size(v.f)), (a, h) -> struct(a.x AS x, a.g AS g, h AS h)),
        z -> struct(z.x AS x, length(z.g) AS g, {left} AS l, {right} AS r)))[0]"""
    placed = f"""aggregate(part, struct(0 AS at, {none} AS out), (a, z) -> struct(a.at + z.g + length(z.x) AS at,
        concat(a.out, array(struct('{kind}' AS kind, a.at + z.g AS start, a.at + z.g + length(z.x) AS stop, z.x AS value, z.l AS left, z.r AS right))) AS out))"""
    parts = f"transform(array({rows}), v -> CASE WHEN size(v) > 0 THEN transform(sequence(0, (size(v) - 1) div {CHUNK}), c -> slice(v, cast(c * {CHUNK} + 1 as int), {CHUNK})) END)[0]"
    begins = "aggregate(p, struct(0 AS at, cast(array() as array<int>) AS out), (a, z) -> struct(a.at + z.at AS at, concat(a.out, array(a.at)) AS out)).out"
    moved = "struct(s.kind AS kind, s.start + b AS start, s.stop + b AS stop, s.value AS value, s.left AS left, s.right AS right)"
    return F.expr(f"coalesce(transform(array(transform({parts}, part -> {placed})), p -> flatten(zip_with(p, {begins}, (z, b) -> transform(z.out, s -> {moved}))))[0], {none})")


_DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
_LUHN = """aggregate(sequence(1, length(d)), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN cast(substr(d, length(d) - i + 1, 1) as int)
    ELSE 2 * cast(substr(d, length(d) - i + 1, 1) as int) - CASE WHEN cast(substr(d, length(d) - i + 1, 1) as int) > 4 THEN 9 ELSE 0 END END) % 10 = 0"""
#: Which matches of a kind hold.
HOLDS = {
    "email": "true",
    "ip": r"s.value rlike r'^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$'",
    "card": f"exists(array({_DIGITS}), d -> length(d) BETWEEN 12 AND 19 AND {_LUHN})",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}


#: Which other matches are counter-examples: those of the right length that fail the check itself.
FAILS = {"ip": "true", "card": f"length({_DIGITS}) BETWEEN 12 AND 19"}


def scanned(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, text_key, base, keys, around): base spans, keys, and every instance with its patterns, of each row."""
    out = docs.select(doc, F.coalesce(text, F.lit("")).alias("__text")).withColumn("text_key", F.xxhash64("__text"))
    digits = F.col("__text").rlike("[0-9]")
    none = F.expr(f"cast(array() as {SPAN})")
    for kind in KINDS:
        needed = (F.lit(True) if kind == "email" else digits) & (F.instr("__text", NEEDS[kind]) > 0 if NEEDS[kind] else F.lit(True))
        out = out.withColumn(f"__{kind}", F.when(needed, spans_of(kind, PATTERNS[kind])).otherwise(none))
        if kind in FAILS:
            out = out.withColumn(f"__no_{kind}", F.expr(f"transform(filter(__{kind}, s -> {FAILS[kind]} AND NOT ({HOLDS[kind]})), s -> struct('no' AS kind, s.start AS start, s.stop AS stop, s.value AS value, s.left AS left, s.right AS right))"))
        out = out.withColumn(f"__{kind}", F.expr(f"filter(__{kind}, s -> {HOLDS[kind]})"))
    out = out.withColumn("__no", F.expr(f"filter(concat({', '.join(f'__no_{k}' for k in FAILS)}), s -> NOT exists(__phone, b -> b.start < s.stop AND s.start < b.stop))"))
    out = out.withColumn("base", F.concat(*[f"__{k}" for k in KINDS]))
    out = out.withColumn("__run", F.when(digits, spans_of("id", CANDIDATE)).otherwise(none))
    out = out.withColumn("keys", F.expr(f"transform(filter(__run, s -> s.value rlike {_quoted(KEY)} AND NOT exists(base, b -> b.start <= s.start AND s.stop <= b.stop)), s -> struct('key' AS kind, s.start AS start, s.stop AS stop, s.value AS value, s.left AS left, s.right AS right))"))
    out = out.withColumn("__no", F.expr("filter(__no, s -> NOT exists(keys, b -> b.start < s.stop AND s.start < b.stop))"))
    spaced = F.when(digits, spans_of("id", SPACED)).otherwise(none)
    out = out.withColumn("__spaced", spaced).withColumn("__other", F.expr("concat(__run, filter(__spaced, s -> length(replace(s.value, ' ', '')) >= 8))"))
    out = out.withColumn("__other", F.expr(f"filter(__other, s -> NOT (s.value rlike r'{DATE}') AND NOT exists(concat(base, keys, __no), b -> b.start < s.stop AND s.start < b.stop))"))
    around = F.concat("base", "keys", "__no", "__other")
    return out.withColumn("around", around).select(doc, "text_key", "base", "keys", "around")


def pattern_scores(instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value, seed, score, found) and (pattern, worth, seeds, strong) when a round changes nothing.

    instances: (value, seed, pattern), any number of times; seed is 1, 0 for unknown or -1 for a
    counter-example. Patterns without a word are left out. found: discovered, and a seed from then on.
    Scores never fall and what is found stays found, so the rounds come to an end.
    """
    worded = instances.filter(F.col("pattern").rlike(r"\p{L}"))
    edges = written(worded.groupBy("value", "pattern").agg(F.max("seed").alias("seed")), "pattern-edges")
    values = edges.groupBy("value").agg(F.max("seed").alias("seed"), (F.max("seed") == 1).cast("double").alias("score")).withColumn("found", F.lit(False))
    values, edges = written(values, "instances"), edges.drop("seed")
    while True:
        worth = (F.sum("score") / (F.count("*") + 1)).alias("worth")
        patterns = edges.join(values, "value").groupBy("pattern").agg(worth, F.sum(((F.col("seed") == 1) | F.col("found")).cast("long")).alias("seeds"))
        patterns = written(patterns.withColumn("strong", (F.col("seeds") >= LEAST_SEEDS) & (F.col("worth") >= LEAST_PATTERN)), "patterns")
        together = (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("worth"), F.lit(1e-9)))))).alias("together")
        lifted = edges.join(patterns, "pattern").groupBy("value").agg(together, F.max("strong").alias("strong"))
        found = F.col("found") | ((F.col("seed") == 0) & F.col("strong") & (F.col("together") >= LEAST_INSTANCE))
        after = values.join(lifted, "value").withColumn("now", found).withColumn("new", F.when((F.col("seed") == 1) | F.col("now"), 1.0).when(F.col("seed") == -1, 0.0).otherwise(F.col("together")))
        after = written(after.select("value", "seed", F.col("new").alias("score"), F.col("now").alias("found"), ((F.col("new") - F.col("score") >= STILL) | (F.col("now") != F.col("found"))).alias("changed")), "instances")
        values = after.drop("changed")
        if after.filter("changed").isEmpty():
            return values, patterns


def personal_data(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text_key, base, spans) of every row: base spans, and with keys and the discovered ones (kind "id") all spans, each (kind, start, stop, value, left, right) by start.

    Null and empty texts have no spans. Rows that repeat both id and text have the same spans and stay
    rows. An empty table gives no rows; other columns are ignored.
    """
    found = written(scanned(docs, doc, text), "pii-scan")
    rows = found.select(doc, "text_key", F.explode("around").alias("a")).select(doc, "text_key", "a.*").withColumn("seed", F.when(F.col("kind") == "id", 0).when(F.col("kind") == "no", -1).otherwise(1))
    pairs = rows.select("value", "seed", F.explode(F.array("left", "right")).alias("pattern"))
    values, patterns = pattern_scores(pairs)
    strong, likely = patterns.filter("strong").select("pattern"), values.filter("found").select("value")
    unseen = rows.filter("seed = 0").join(likely, "value", "left_semi")
    unseen = unseen.withColumn("pattern", F.explode(F.array("left", "right"))).join(strong, "pattern", "left_semi")
    new = unseen.select("text_key", F.struct("kind", "start", "stop", "value", "left", "right").alias("s")).groupBy("text_key").agg(F.collect_set("s").alias("new"))
    rank = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))
    order = f"(x, y) -> CASE WHEN x.start <> y.start THEN x.start - y.start ELSE 100 * ((CASE x.kind {rank} ELSE 9 END) - (CASE y.kind {rank} ELSE 9 END)) + cast(sign(y.stop - x.stop) as int) END"
    joined = found.select(doc, "text_key", "base", "keys").join(new, "text_key", "left")
    every = f"concat(base, keys, coalesce(new, cast(array() as {SPAN})))"
    return joined.select(doc, "text_key", F.expr(f"array_sort(base, {order})").alias("base"), F.expr(f"array_sort({every}, {order})").alias("spans"))


def redacted(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with every span of its text replaced by <kind>; overlapping spans by the first one's.

    Null and empty texts stay as they are, repeated rows stay rows, other columns are carried whatever their names.
    """
    found = personal_data(docs, doc, text).filter(F.size("spans") > 0).select(F.col("text_key").alias("__text_key"), F.col("spans").alias("__spans")).dropDuplicates(["__text_key"])
    keyed = docs.withColumn("__text_key", F.xxhash64(F.coalesce(text, F.lit(""))))
    masked = f"""aggregate(__spans, struct(1 AS at, '' AS out), (a, s) -> CASE WHEN s.start + 1 < a.at THEN struct(greatest(a.at, s.stop + 1) AS at, a.out AS out)
        ELSE struct(s.stop + 1 AS at, concat(a.out, substr(`{text}`, a.at, s.start + 1 - a.at), '<', s.kind, '>') AS out) END,
        a -> concat(a.out, substr(`{text}`, a.at)))"""
    joined = keyed.join(found, "__text_key", "left").withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(F.expr(masked)))
    return joined.select(*[f"`{c}`" for c in docs.columns])


def _line(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.stop)), ',')"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of every document; n_key counts keys by form, n_id discovered identifiers, n_spans all."""
    out = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    more = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in ("key", "id")] + [F.size("spans").cast("long").alias("n_spans")]
    return out.select("doc_id", *counts, F.expr(f"sha2({_line('base')}, 256)").alias("base_sha256"), F.expr(_line("spans")).alias("spans"), *more)
