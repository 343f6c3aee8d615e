"""Merkle manifest of a dataset, built and proved by time-forward processing.

Leaves are ordered inside their tree, and every WAYS consecutive nodes become their parent. Nodes are
labelled by level and place. Digests travel as messages that wait in a priority queue for the label of
the parent: the parent is made when its label is the smallest one, from what then stands in front.
The queue is external. Between blocks of WAYS ** LEVELS leaves it is Spark's sorted exchange, which
spills and is split over tasks; inside a block it is a heap of as many entries. So a tree of n leaves
takes log(n) / log(WAYS ** LEVELS) exchanges instead of one for each level.

The reversed sweep sends each node the suffix of its proof (what stands beside the path from there to
the root) through the same exchanges, a block's message sorted before its members. A verifier needs a
leaf and its proof only; `folded` is such a verifier as a plain expression.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.memory import in_small_batches
from strandloom.plans.session import table, written

WAYS, LEVELS = 2, 10
#: One step of a proof: what stands before and after the path's own digest in its run.
STEP = T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())])
PROOF = T.ArrayType(STEP)
_PROOF = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
_PART = 1 << 33


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """The leaf of a record: for each value `-` if it is null, else its length in UTF-8 bytes, `:` and itself; their SHA-256 in lowercase hex."""
    fields = []
    for value in values:
        said = value.cast("string")
        fields.append(F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-")))
    return F.sha2(F.concat(*fields), 256)


def climb(members: list[str], height: int, ways: int) -> list[list[str]]:
    """The nodes of each level from the members up to `height` levels above, made in the order of their labels."""
    made: list[list[str]] = [members] + [[] for _ in range(height)]
    queue = [(1, k // ways, k % ways, d) for k, d in enumerate(members)] if height else []
    while queue:  # members come in order, so the list is a heap already
        level, at, _, first = heapq.heappop(queue)
        children = [first]
        while queue and queue[0][:2] == (level, at):
            children.append(heapq.heappop(queue)[3])
        node = digest(*children)
        made[level].append(node)
        if level < height:
            heapq.heappush(queue, (level + 1, at // ways, at % ways, node))
    return made


def descend(made: list[list[str]], suffix: list[dict], ways: int) -> list[list[dict]]:
    """The proof of every member, where `suffix` is that of the node on top: labels in falling order, each node sending its proof on to its children."""
    proofs: list[list[dict]] = [[] for _ in made[0]]
    queue = [(1 - len(made), 0, suffix)]
    while queue:
        low, at, own = heapq.heappop(queue)
        level = -low
        if level == 0:
            proofs[-at] = own
            continue
        begin = -at * ways
        run = made[level - 1][begin : begin + ways]
        for k in range(len(run)):
            heapq.heappush(queue, (1 - level, -begin - k, [{"before": "".join(run[:k]), "after": "".join(run[k + 1 :])}, *own]))
    return proofs


def heights(n: int, ways: int, levels: int) -> int:
    """Levels from a block's members to its top: all of them if the tree goes on above, else until one node remains."""
    h = 0
    while h < levels and ways**h < n:
        h += 1
    return h


def whole_blocks(batches: Iterator[pa.RecordBatch], most: int = 20_000) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole blocks and where each begins and ends; rows come sorted by (tree, block)."""
    held: list[pa.RecordBatch] = []
    n = 0

    def cuts(data: pa.Table) -> list[int]:
        keys = list(zip(data.column("tree").to_pylist(), data.column("block").to_pylist(), strict=True))
        return [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= most:
            data = pa.Table.from_batches(held)
            at = cuts(data)
            if len(at) > 2:
                yield data.slice(0, at[-2]), list(zip(at[:-2], at[1:-1], strict=True))
                data = data.slice(at[-2])
            held, n = data.to_batches(), data.num_rows
    if n:
        data = pa.Table.from_batches(held)
        at = cuts(data)
        yield data, list(zip(at[:-1], at[1:], strict=True))


def climbed(nodes: DataFrame, ways: int, levels: int) -> DataFrame:
    """(tree, at, n, digest) of the nodes on top of the blocks of `nodes` (tree, at, n, digest)."""
    size = ways**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, blocks in whole_blocks(batches):
            trees, at, n, digests = (data.column(c).to_pylist() for c in ("tree", "block", "n", "digest"))
            tops = [climb(digests[a:b], heights(n[a], ways, levels), ways)[-1][0] for a, b in blocks]
            first = [a for a, _ in blocks]
            columns = [pa.array([trees[a] for a in first]), pa.array([at[a] for a in first], pa.int64()), pa.array([-(-n[a] // size) for a in first], pa.int64()), pa.array(tops)]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "at", "n", "digest"])

    blocks = nodes.select("tree", F.expr(f"at div {size}").alias("block"), "at", "n", "digest")
    return blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "at").mapInArrow(run, "tree string, at long, n long, digest string")


def proved(nodes: DataFrame, suffixes: DataFrame, ways: int, levels: int) -> DataFrame:
    """(tree, at, row, top, proof) of `nodes` (tree, at, n, digest, row), from what their blocks' tops were sent: suffixes (tree, at, top, proof)."""
    size = ways**levels
    kind = nodes.schema["row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, blocks in whole_blocks(batches):
            n, digests, tops, sent = (data.column(c).to_pylist() for c in ("n", "digest", "top", "sent"))
            proofs, named, keep = [], [], []
            for a, b in blocks:  # the message comes first
                made = climb(digests[a + 1 : b], heights(n[a + 1], ways, levels), ways)
                proofs += descend(made, sent[a], ways)
                named += [tops[a]] * (b - a - 1)
                keep += range(a + 1, b)
            out = data.select(["tree", "at", "row"]).take(pa.array(keep, pa.int64())).combine_chunks()
            for k in range(0, out.num_rows, 1000):
                part = out.slice(k, 1000).to_batches()[0]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(named[k : k + 1000]), pa.array(proofs[k : k + 1000], _PROOF)], names=["tree", "at", "row", "top", "proof"])

    def none(kind: T.DataType, name: str) -> Column:
        return F.lit(None).cast(kind).alias(name)

    members = nodes.select("tree", F.expr(f"at div {size}").alias("block"), "at", "n", "digest", "row", none(T.StringType(), "top"), none(PROOF, "sent"))
    messages = suffixes.select(
        "tree", F.col("at").alias("block"), none(T.LongType(), "at"), none(T.LongType(), "n"), none(T.StringType(), "digest"), none(kind, "row"), "top", F.col("proof").alias("sent")
    )
    schema = T.StructType([T.StructField("tree", T.StringType()), T.StructField("at", T.LongType()), T.StructField("row", kind), T.StructField("top", T.StringType()), T.StructField("proof", PROOF)])
    return members.union(messages).repartition("tree", "block").sortWithinPartitions("tree", "block", F.col("at").asc_nulls_first()).mapInArrow(run, schema)


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """(tree, at, n, digest, row): each leaf's place in its tree, from 0, and the leaves of its tree.

    rows: (tree, digest, row, tie), tie being different in all rows. Leaves are dealt out in ranges of
    their order, equal ones too, and only counts of ranges are added up.
    """
    keys = [F.col("tree"), *order, F.col("digest"), F.col("tie")]
    ordered = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("tree", "digest", "row", F.monotonically_increasing_id().alias("id")), "merkle-leaves")
    part = F.expr(f"id div {_PART}")
    counts = ordered.groupBy("tree", part.alias("part")).agg(F.min("id").alias("first"), F.count("*").alias("own"))
    every = Window.partitionBy("tree")
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("tree").alias("of"), "part", "first", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"), F.sum("own").over(every).alias("n"))
    joined = ordered.join(counts, (F.col("tree") == F.col("of")) & (part == F.col("part")))
    return joined.select("tree", (F.col("id") - F.col("first") + F.col("before")).alias("at"), "n", "digest", "row")


def grown(leaves: DataFrame, ways: int, levels: int, label: str) -> list[DataFrame]:
    """The written nodes of all blocks' bottoms, from the leaves to the one node of each tree."""
    own = [written(leaves, f"{label}-0")]
    while (own[-1].agg(F.max("n")).first()[0] or 0) > 1:
        own.append(written(climbed(own[-1], ways, levels), f"{label}-{len(own)}"))
    return own


def swept(below: list[DataFrame], sent: DataFrame, ways: int, levels: int, label: str) -> DataFrame:
    """(tree, at, row, top, proof) of the leaves, from what the trees' tops are sent: (tree, at, top, proof)."""
    if len(below) == 1:
        return below[0].select("tree", "at", "row").join(sent.select("tree", "top", "proof"), "tree")
    for k in range(len(below) - 2, -1, -1):
        nodes = below[k] if k == 0 else below[k].withColumn("row", F.lit(None).cast("boolean"))
        sent = proved(nodes, sent, ways, levels)
        if k:
            sent = written(sent, f"{label}-proofs-{k}")
    return sent


def manifest(rows: DataFrame, leaf: str, tree: str, order: str, ways: int = WAYS, levels: int = LEVELS) -> DataFrame:
    """`rows` with subroot, root and proof, an array of (before, after) from the leaf's own run up to the root's.

    leaf: the column of the leaves' digests, without nulls. Trees are by the column `tree`, null being
    one of them and the first; a tree's leaves ascend by `order`, nulls first, then by digest, and equal
    rows take a place each. Subroots, in the order of `tree` (UTF-8 bytes), make the tree of the root. A
    lone node is its own root. An empty table gives no rows. Other columns stay, but for those with the
    new names, which are replaced. A task holds one block of `ways ** levels` leaves, whatever the trees'
    sizes.
    """
    rows = in_small_batches(rows)
    new = ("subroot", "root", "proof")
    own = [c for c in rows.columns if c.lower() not in new]
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in rows.columns}
    key = F.coalesce(F.concat(F.lit("="), quoted[tree].cast("string")), F.lit("-"))
    packed = rows.select(key.alias("tree"), quoted[leaf].alias("digest"), quoted[order].alias("order"), F.struct(*[quoted[c] for c in own]).alias("row"), F.monotonically_increasing_id().alias("tie"))
    below = grown(placed(written(packed, "merkle-rows"), [F.col("order")]), ways, levels, "merkle-node")
    subroots = below[-1].select(F.lit("").alias("tree"), "digest", F.struct(F.col("tree").alias("name"), F.col("digest").alias("subroot")).alias("row"), F.col("tree").alias("tie"))
    above = grown(placed(written(subroots, "merkle-subroots"), [F.col("tie")]), ways, levels, "merkle-upper")
    root = (above[-1].select("digest").first() or [None])[0]
    start = above[-1].select("tree", "at", F.lit(root).alias("top"), F.array().cast(PROOF).alias("proof"))
    upper = swept(above, start, ways, levels, "merkle-upper").select(F.col("row.name").alias("tree"), F.lit(0).cast("long").alias("at"), F.col("row.subroot").alias("top"), "proof")
    out = swept(below, written(upper, "merkle-upper-proofs"), ways, levels, "merkle-node")
    return out.select("row.*", F.col("top").alias("subroot"), F.lit(root).cast("string").alias("root"), "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, one after another."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and what a verifier says of each of them where some were tampered with."""
    docs = table(spark, sf_dir, "documents")
    record = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = leaf_digest(*record[:3], F.col("n_chars").cast("decimal(20,0)") + F.lit(1), record[4])
    leaves = docs.select("doc_id", "lang", leaf_digest(*record).alias("leaf"), F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, tampered).alias("tampered"))
    out = manifest(leaves, "leaf", "lang", "doc_id")
    out = out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _up(name: str, leaves: str) -> str:
    """SQL for all nodes (lvl, tree, pos, n, h) over `leaves` (tree, pos, n, h)."""
    return f"""{name} AS (SELECT 0 AS lvl, tree, pos, n, h FROM {leaves}
    UNION ALL SELECT lvl + 1, tree, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY lvl, tree, pos // 2)"""


_FIELD = "coalesce(strlen({0})::VARCHAR || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id::VARCHAR", "source", "lang", "{0}::VARCHAR", "text")) + ")"
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""
SQL = f"""
WITH RECURSIVE named AS (SELECT row_number() OVER (ORDER BY coalesce('=' || lang, '-'), doc_id) AS id, doc_id, coalesce('=' || lang, '-') AS tree,
    {_LEAF.format("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF.format("(n_chars::HUGEINT + 1)")} END AS tampered FROM documents),
leaves AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM named),
{_up("low", "leaves")},
tops AS (SELECT '' AS tree, tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
{_up("high", "tops")},
path AS (SELECT id, l.lvl AS step, l.lvl AS lvl, s.h, (leaves.pos >> l.lvl) % 2 = 0 AS own_first FROM leaves
    JOIN (SELECT DISTINCT tree, lvl FROM low WHERE n > 1) l ON l.tree = leaves.tree LEFT JOIN low s ON s.tree = leaves.tree AND s.lvl = l.lvl AND s.pos = xor(leaves.pos >> l.lvl, 1)
    UNION ALL SELECT id, l.lvl + 1000, l.lvl, s.h, (tops.pos >> l.lvl) % 2 = 0 FROM leaves JOIN tops ON tops.name = leaves.tree
    JOIN (SELECT DISTINCT lvl FROM high WHERE n > 1) l ON true LEFT JOIN high s ON s.lvl = l.lvl AND s.pos = xor(tops.pos >> l.lvl, 1)),
steps AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY step) AS k FROM path),
fold AS (SELECT id, 0::BIGINT AS k, coalesce(tampered, leaf) AS h FROM leaves
    UNION ALL SELECT fold.id, steps.k, sha256(CASE WHEN own_first THEN fold.h || coalesce(steps.h, '') ELSE steps.h || fold.h END) FROM fold JOIN steps ON steps.id = fold.id AND steps.k = fold.k + 1),
ended AS (SELECT id, arg_max(h, k) AS folded_root FROM fold GROUP BY id),
proofs AS (SELECT id, sha256(coalesce(string_agg(h, '' ORDER BY k), '')) AS proof_sha256 FROM steps GROUP BY id)
SELECT doc_id, leaf, tops.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = (SELECT h FROM high WHERE n = 1) AS verified
FROM leaves JOIN tops ON tops.name = leaves.tree JOIN ended USING (id) LEFT JOIN proofs USING (id)
"""
