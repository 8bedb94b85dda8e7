"""A Merkle manifest of a dataset, and what tampering with single rows would change in it.

Every source is a tree over its rows in order of doc_id, a node the hash of up
to FANOUT consecutive ones below it; the trees' roots are the leaves of one
more tree. Trees are built in blocks of FANOUT**LEVELS aligned nodes: one row
of Spark holds a block with all its levels, and the blocks' roots are the nodes
of the next round. The trees are persistent: a tampered leaf makes a version
that copies only its own ancestors, first inside its block, then along the path
that the block has in the blocks above, and shares every other node.

Rows with a null id come first in their source, rows without a source are a
tree of their own. Rows alike in every column are leaves of their own, side by
side. A null or empty cell is a value like any other; an empty table has no
root and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listinglens.llm.common import fresh_path, remove, stage_table

FANOUT = 3
#: Levels of one block: 729 nodes at its foot.
LEVELS = 6
#: The cells of a leaf, in order.
CELLS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the sources' roots.
TOP = "top"
#: No siblings.
NO_PATH = "cast(array() as array<struct<left:string,right:string>>)"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def _cell(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The hash of a row's cells."""
    return digest(*[_cell(changed.get(c, F.col(c))) for c in CELLS])


def _depth(n: Column) -> Column:
    """Levels above the nodes of a block in a tree of n: those to its root, LEVELS at most."""
    out = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        out = F.when(n <= FANOUT**k, k).otherwise(out)
    return out


def _above(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(level, i * FANOUT + 1, FANOUT), ""), 256))


def _levels(nodes: Column, depth: Column) -> Column:
    """nodes and the levels above them, `depth` of these."""
    steps = F.slice(F.array(*map(F.lit, range(LEVELS))), 1, depth)
    return F.aggregate(steps, F.array(nodes), lambda done, _: F.concat(done, F.array(_above(F.element_at(done, -1)))))


def _siblings(levels: Column, at: Column, depth: Column) -> Column:
    """Up the tree from place `at` of a block: what stands left and right of the node in its run, level by level."""

    def of(k: Column) -> Column:
        level, place = F.get(levels, k), F.floor(at / F.pow(F.lit(float(FANOUT)), k)).cast("int")
        first = place - place % FANOUT
        left = F.array_join(F.slice(level, first + 1, place % FANOUT), "")
        return F.struct(left.alias("left"), F.array_join(F.slice(level, place + 2, first + FANOUT - 1 - place), "").alias("right"))

    return F.transform(F.slice(F.array(*map(F.lit, range(LEVELS))), 1, depth), of)


def copied(node: Column, path: Column) -> Column:
    """A version's copied nodes: the node itself and its ancestors along a path of siblings, the root last."""
    return F.aggregate(path, F.array(node), lambda done, s: F.concat(done, F.array(digest(s["left"], F.element_at(done, -1), s["right"]))))


def _placed(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """rows with `at`, the place in its tree by the given columns, and `n`, the tree's size.

    The rows are sorted over all partitions; a place is the one inside the
    partition and the number of rows in earlier ones, so a large tree is no
    large task. A row number comes last in the order: like rows are no hot key.
    """
    spark = rows.sparkSession
    numbered, path = fresh_path(spark, "merkle-rows"), fresh_path(spark, "merkle-sorted")
    staged = stage_table(rows.withColumn("_row", F.monotonically_increasing_id()), "", numbered)
    by = [tree, *order, "_row"]
    ordered = stage_table(staged.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "", path)
    remove(spark, numbered)
    counts = ordered.groupBy(tree, "_part").agg(F.count("*").alias("_here"))
    earlier = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that the tree is in
    starts = counts.select(tree, "_part", F.coalesce(F.sum("_here").over(earlier), F.lit(0)).alias("_start"), F.sum("_here").over(Window.partitionBy(tree)).alias("n"))
    place = F.row_number().over(Window.partitionBy(tree, "_part").orderBy(*order, "_row")) - 1
    return ordered.withColumn("_place", place).join(starts, [tree, "_part"]).withColumn("at", F.col("_start") + F.col("_place")).drop("_part", "_row", "_place", "_start")


def _blocks(nodes: DataFrame, *carried: str) -> DataFrame:
    """Rows (tree, block, n, depth, items, levels) of nodes (tree, at, n, node): the aligned blocks, whole."""
    items = F.array_sort(F.collect_list(F.struct("at", "node", *carried)))  # FANOUT**LEVELS at most
    block = F.floor(F.col("at") / FANOUT**LEVELS).alias("block")
    out = nodes.groupBy("tree", block, "n").agg(items.alias("items")).withColumn("depth", _depth(F.col("n")))
    return out.withColumn("levels", _levels(F.transform("items", lambda x: x["node"]), F.col("depth")))


def _roots(blocks: DataFrame) -> DataFrame:
    """The blocks' roots as nodes of the next round."""
    n = F.ceil(F.col("n") / FANOUT**LEVELS).alias("n")
    return blocks.select("tree", F.col("block").alias("at"), n, F.get(F.element_at("levels", -1), 0).alias("node"))


def _grown(nodes: DataFrame, name: str, *carried: str) -> list[DataFrame]:
    """Rounds of staged blocks, from the given nodes up to one root for each tree."""
    rounds = [stage_table(_blocks(nodes, *carried), name)]
    while not _roots(rounds[-1]).where("n > 1").isEmpty():
        rounds.append(stage_table(_blocks(_roots(rounds[-1])), name))
    return rounds


def _descended(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Rows (item, path) and further columns of `above` for the nodes of the first round: path is theirs up to the tree's root.

    above has one row for each tree. The way goes down round by round: a block
    hands the path it has above itself to the nodes at its foot, so no join has
    more than a block of rows for a key.
    """
    keys, given = ["tree"], above.withColumn("path", F.expr(NO_PATH))
    for blocks in reversed(rounds):
        carried = [c for c in given.columns if c not in ("tree", "block", "path")]
        met = blocks.join(given.withColumnRenamed("path", "_rest"), keys)
        own = F.transform("items", lambda x, i: F.struct(x.alias("item"), F.concat(_siblings(F.col("levels"), i, F.col("depth")), F.col("_rest")).alias("path")))
        given = met.select("tree", *carried, F.explode(own).alias("_x"))
        given = given.select("tree", F.col("_x.item.at").alias("block"), F.col("_x.path").alias("path"), F.col("_x.item").alias("item"), *[c for c in carried if c != "item"])
        keys = ["tree", "block"]
    return given.drop("tree", "block")


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text without line feeds where 2 divides the crc32 of the id; else, and for a null id, the text."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Rows (doc_id, leaf, subroot, root, path, subpath, version) of documents.

    path holds the siblings (left, right) level by level up to the source's
    root, subpath those from there to the root of all. version holds the nodes
    that the leaf's version copies, the leaf first and the root of all last:
    the leaf is the row's own with `tampered` in place of its text. All other
    nodes of a version are the manifest's.
    """
    text = F.col("text") if tampered is None else tampered
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))  # no source comes first
    leaves = docs.select("doc_id", tree.alias("tree"), leaf().alias("node"), leaf(text=text).alias("forged"))
    rounds = _grown(_placed(leaves, "tree", "doc_id", "node"), "merkle-blocks", "doc_id", "forged")
    subroots = _roots(rounds[-1]).select(F.lit(TOP).alias("tree"), F.col("tree").alias("source"), "node")
    upper = _grown(_placed(subroots, "tree", "source"), "merkle-top", "source")
    top = _roots(upper[-1]).select("tree", F.col("node").alias("root"))
    sources = _descended(upper, top).select(F.col("item.source").alias("tree"), F.col("item.node").alias("subroot"), "root", F.col("path").alias("subpath"))
    rows = _descended(rounds, sources)
    version = copied(F.col("item.forged"), F.concat("path", "subpath"))
    return rows.select(F.col("item.doc_id").alias("doc_id"), F.col("item.node").alias("leaf"), "subroot", "root", "path", "subpath", version.alias("version"))


def verified(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of manifest rows."""
    siblings = F.transform(F.concat("path", "subpath"), lambda s: F.concat(s["left"], s["right"]))
    folded = F.element_at("version", -1)
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == F.col("root")).alias("verified"),
    )


#: Levels that the SQL twin has of a source's tree and of the one over the sources.
SQL_LEVELS, SQL_TOP_LEVELS = 12, 8


def _climbed(name: str, key: str, levels: int) -> tuple[str, str]:
    """Common table expressions that climb `levels` levels from <name>0 (key, pos, n, node) and <name>v0 (rid, key, pos, n, folded, proof), and the suffix of the last."""
    out = []
    for k in range(levels):
        out.append(f"{name}r{k} AS (SELECT {key}, pos // 3 AS run, list(node ORDER BY pos) AS nodes, max(n) AS n FROM {name}{k} GROUP BY ALL)")
        out.append(f"{name}{k + 1} AS (SELECT {key}, run AS pos, (n + 2) // 3 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(nodes, '')) ELSE nodes[1] END AS node FROM {name}r{k})")
        left, right = "array_to_string(nodes[1 : pos % 3], '')", "array_to_string(nodes[pos % 3 + 2 :], '')"
        out.append(
            f"{name}v{k + 1} AS (SELECT v.rid, v.{key}, pos // 3 AS pos, (v.n + 2) // 3 AS n, CASE WHEN v.n > 1 THEN sha256({left} || folded || {right}) ELSE folded END AS folded, "
            f"CASE WHEN v.n > 1 THEN proof || {left} || {right} ELSE proof END AS proof FROM {name}v{k} v JOIN {name}r{k} r ON v.{key} = r.{key} AND pos // 3 = r.run)"
        )
    return ", ".join(out), str(levels)


def oracle() -> str:
    """The rows of op11 in DuckDB's SQL, level by level; crc32 is a fold over the id's digits."""

    def cells(text: str) -> str:
        each = [f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(each)})"

    steps = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
    forged = f"CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
    lower, at = _climbed("s", "tree", SQL_LEVELS)
    upper, top = _climbed("t", "tree", SQL_TOP_LEVELS)
    return (
        f"WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('1' || source, '0') AS tree, {cells('text')} AS leaf, "
        f"{cells(forged)} AS forged FROM documents), "
        "p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d), "
        "s0 AS (SELECT tree, pos, n, leaf AS node FROM p), sv0 AS (SELECT rid, tree, pos, n, forged AS folded, '' AS proof FROM p), "
        f"{lower}, "
        f"u AS (SELECT tree AS source, node, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM s{at}), "
        f"t0 AS (SELECT 0 AS tree, pos, n, node FROM u), tv0 AS (SELECT v.rid, 0 AS tree, u.pos, u.n, v.folded, v.proof FROM sv{at} v JOIN u ON v.tree = u.source), "
        f"{upper} "
        f"SELECT p.doc_id, p.leaf, u.node AS subroot, t.node AS root, sha256(v.proof) AS proof_sha256, v.folded AS folded_root, v.folded = t.node AS verified "
        f"FROM p JOIN tv{top} v USING (rid) JOIN u ON p.tree = u.source CROSS JOIN t{top} t"
    )
