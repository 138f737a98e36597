"""Merkle manifest of a dataset: a digest of every row, trees of digests for each source, one root, a proof for each row.

Leaves of a source stand in the order of their ids, 16 neighbours have one parent, and the tops of the sources, in
their order, are the leaves of one more tree. The levels are built with grouped aggregates and stored as node rows,
each linked to its parent by key and place. A recursive query then climbs from the leaves to the root: each step joins
the next node, puts the digests of its other children around the one that the climb carries, folds them, and appends
the siblings to the proof.

The leaves under one parent share all of the path but its first step, so a row of the climb is a run of up to 16
leaves with a carried digest each. Paths meet at the top, where one node would be the key of all rows. Nodes over more
than a 1,024th of all leaves, of which each level has fewer than 1,024, are therefore sent to every task, in a second
recursive query; the first one, which shuffles, ends below them, where no node has more than that share of the rows.

Defined results: rows with equal source and doc_id are ordered by their digest; null ids come first; a null value
is digested as ``-``; a null source is a source of its own, first of all; null ids are never tampered with; the only
leaf of a source is its top, the only source's top the root; an empty table gives an empty table. Other columns of the
input take no part. Source, level and place of a node are its key, so nothing depends on hashes being distinct.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.shared import new_path, plain_unions, remove, shuffle_partitions, table, written_at

#: Children of a node.
FAN = 16
#: Nodes over more than this part of all leaves are sent to every task.
HEAVY = 1_024
#: The tree of the sources' tops; trees of sources are numbered from 0.
TOP = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OUT = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one behind the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the value's length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return digest(*map(framed, (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)))


def in_order(rows: DataFrame, group: str, *order: str) -> tuple[DataFrame, str]:
    """(``rows`` with ``number``, from 0 within each ``group``, and ``n``, the rows of the group; the path that holds them).

    Rows are sorted into ranges and written. A range counts its rows of each group, so that only a row for each group and
    range meets in a window; the rows themselves are numbered by their place. Equal rows are cut like others.
    """
    spark = rows.sparkSession
    path = new_path(spark, "ordered")
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    sort = [F.asc_nulls_first(c) for c in (group, *order, "tie")]
    ranged = tied.repartitionByRange(shuffle_partitions(spark), *sort).sortWithinPartitions(*sort).drop("tie")
    stored = written_at(ranged.withColumn("place", F.monotonically_increasing_id()), path).withColumn("range", F.shiftright("place", 33))
    counts = stored.groupBy(group, "range").agg(F.count("*").alias("in_range"), F.min("place").alias("first"))
    before = W.partitionBy(group).orderBy("range")
    counts = counts.withColumns({"before": F.sum("in_range").over(before) - F.col("in_range"), "n": F.sum("in_range").over(W.partitionBy(group))})
    counts = counts.select(F.col(group).alias("__group"), F.col("range").alias("__range"), "first", "before", "n")
    joined = stored.join(counts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("range") == F.col("__range")))
    return joined.withColumn("number", F.col("before") + F.col("place") - F.col("first")).drop("__group", "__range", "range", "place", "first", "before"), path


def parents(children: DataFrame) -> DataFrame:
    """Node rows of the next level, of trees that have more than one node left: (tree, level, number, n, covered, children, digest)."""
    own = F.array_sort(F.collect_list(F.struct("number", "digest")))
    up = children.where("n > 1").groupBy("tree", "level", F.expr(f"number div {FAN}").alias("up"), "n")
    up = up.agg(F.transform(own, lambda x: x["digest"]).alias("children"), F.sum("covered").alias("covered"))
    next_level = up.select("tree", (F.col("level") + 1).alias("level"), F.col("up").alias("number"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), "covered", "children")
    return next_level.withColumn("digest", F.sha2(F.array_join("children", "").cast("binary"), 256))


def levels(n: int) -> int:
    """Levels over ``n`` leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def key(tree: str, level: str, number: str) -> Column:
    return F.concat_ws("/", F.col(tree), F.col(level), F.col(number))


@contextmanager
def any_rows(spark: SparkSession):
    """Recursive queries may give any number of rows; Spark's own limit is set back after."""
    name = "spark.sql.cteRecursionRowLimit"
    known = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.unset(name) if known is None else spark.conf.set(name, known)


#: One step folds the carried digests into the next node: its children before the place, the digest, those behind it.
#: The first step has a place of its own for each leaf (``place`` is null), and its siblings stay with the leaves.
CLIMB = """
WITH RECURSIVE climb(run, carried, siblings, subroot, root, next, place, heavy) AS (
    SELECT run, carried, siblings, subroot, root, next, place, heavy FROM {start}
    UNION ALL
    SELECT {hint} c.run,
        transform(c.carried, (x, i) -> sha2(concat(
            array_join(slice(n.children, 1, coalesce(c.place, i)), ''), x,
            array_join(slice(n.children, coalesce(c.place, i) + 2, {fan}), '')), 256)),
        CASE WHEN c.place IS NULL THEN c.siblings ELSE concat(c.siblings,
            array_join(slice(n.children, 1, c.place), ''), array_join(slice(n.children, c.place + 2, {fan}), '')) END,
        CASE WHEN n.is_subroot THEN n.digest ELSE c.subroot END,
        CASE WHEN n.parent IS NULL THEN n.digest ELSE c.root END,
        n.parent, n.place, n.parent_heavy
    FROM climb c JOIN {nodes} n ON n.node = c.next
)
SELECT run, carried, siblings, subroot, root, next, place, heavy FROM climb WHERE {done}
"""


def climbed(spark: SparkSession, start: DataFrame, nodes: DataFrame, heavy: bool) -> tuple[DataFrame, str]:
    """Rows of the climb where they stop: at the root, or below the first heavy node."""
    hint = "/*+ BROADCAST(n) */" if heavy else ""
    done = "next IS NULL" if heavy else "next IS NULL OR heavy"
    query = CLIMB.format(start="{start}", nodes="{nodes}", hint=hint, fan=FAN, done=done)
    path = new_path(spark, "climb")
    with any_rows(spark):
        return written_at(spark.sql(query, start=start, nodes=nodes), path), path


def manifest(docs: DataFrame, tampered: Column | None = None, tampered_text: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), a row for each row of ``docs``.

    Rows where ``tampered`` holds are folded with the digest they have with ``tampered_text``; by default none is.
    """
    spark = docs.sparkSession
    plain_unions(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", "n_chars", "text")
    other = F.when(tampered, leaf_digest(tampered_text)) if tampered is not None else F.lit(None).cast("string")
    leaf_path = new_path(spark, "leaves")
    leaves = written_at(rows.select("doc_id", "source", leaf_digest(F.col("text")).alias("leaf"), other.alias("tampered")), leaf_path)
    ordered, ordered_path = in_order(leaves, "source", "doc_id", "leaf")

    # Trees are numbered in the order of their sources.
    sources, sources_path = in_order(leaves.select("source").distinct().withColumn("all", F.lit(0)), "all", "source")
    sources = sources.select(F.col("source").alias("__source"), F.col("number").alias("tree"), F.col("n").alias("trees"))
    run = ordered.groupBy("source", F.expr(f"number div {FAN}").alias("number"), "n").agg(F.array_sort(F.collect_list(F.struct("number", "doc_id", "leaf", "tampered"))).alias("leaves"))
    run = run.withColumn("place", F.pmod("number", F.lit(FAN)).cast("int"))
    run = run.join(sources, F.col("source").eqNullSafe(F.col("__source"))).drop("source", "__source")
    runs_path, node_path = new_path(spark, "runs"), new_path(spark, "nodes")
    runs = written_at(run.withColumn("run", F.concat_ws("/", "tree", "number")), runs_path)
    for path in (leaf_path, ordered_path, sources_path):
        remove(spark, path)
    sizes = runs.agg(F.sum(F.size("leaves")), F.max("n"), F.max("trees")).first()
    if sizes[0] is None:
        return spark.createDataFrame([], OUT)

    # Levels of the sources' trees: the runs are their first nodes, but where a source has one leaf.
    digests = F.transform("leaves", lambda x: x["leaf"])
    level = runs.where("n > 1").select("tree", F.lit(1).alias("level"), "number", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.size("leaves").cast("bigint").alias("covered"), digests.alias("children"))
    level = level.withColumn("digest", F.sha2(F.array_join("children", "").cast("binary"), 256))
    parts: list[str] = []

    def stored(level: DataFrame) -> DataFrame:
        parts.append(f"{node_path}/{len(parts)}")
        return written_at(level, parts[-1])

    level = stored(level)
    for _ in range(1, levels(sizes[1])):
        level = stored(parents(level))
    built = spark.read.schema(level.schema).parquet(*parts)
    one_leaf = runs.where("n = 1").select("tree", digests[0].alias("digest"), F.lit(1).cast("bigint").alias("covered"), "trees")
    tops = built.where("n = 1").select("tree", "digest", "covered").join(runs.where("number = 0").select("tree", "trees"), "tree")
    tops = one_leaf.unionByName(tops)
    top = tops.select(F.lit(TOP).cast("bigint").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("number"), F.col("trees").alias("n"), "covered", "digest")
    for _ in range(levels(sizes[2])):
        top = stored(parents(top))
    built = spark.read.schema(level.schema).parquet(*parts)

    # Links: the parent of a tree's last node is in the tree of tops, at the tree's own number.
    many = sizes[2] > 1
    last = F.col("n") == 1
    in_top = F.col("tree") == TOP
    up = key("tree", "up_level", "up")
    over = F.concat_ws("/", F.lit(TOP), F.lit(1), F.expr(f"tree div {FAN}"))
    parent = F.when(~last, up).when(~in_top & F.lit(many), over)
    place = F.when(last & ~in_top, F.pmod("tree", F.lit(FAN))).otherwise(F.pmod("number", F.lit(FAN))).cast("int")
    nodes = built.withColumns({"up": F.expr(f"number div {FAN}"), "up_level": F.col("level") + 1})
    nodes = nodes.select(key("tree", "level", "number").alias("node"), parent.alias("parent"), place.alias("place"), "digest", "children", "covered", (last & ~in_top).alias("is_subroot"))
    bound = sizes[0] // HEAVY
    heavy = nodes.where(F.col("covered") > bound)
    known = F.broadcast(heavy.select(F.col("node").alias("__heavy")))
    nodes = nodes.join(known, F.col("parent") == F.col("__heavy"), "left").withColumn("parent_heavy", F.col("__heavy").isNotNull()).drop("__heavy")
    links = [new_path(spark, "light"), new_path(spark, "heavy")]
    light = written_at(nodes.where(F.col("covered") <= bound).drop("covered"), links[0])
    heavy = written_at(nodes.where(F.col("covered") > bound).drop("covered").repartition(1), links[1])

    # The climb: the carried digests start as the leaves', tampered ones as those of the tampered rows.
    alone = F.col("n") == 1
    above = F.when(~alone, F.concat_ws("/", "tree", F.lit(1), "number")).when(F.lit(many), over)
    only = F.when(alone, F.col("leaves")[0]["leaf"])
    start = runs.select(
        "run", F.transform("leaves", lambda x: F.coalesce(x["tampered"], x["leaf"])).alias("carried"), F.lit("").alias("siblings"), only.alias("subroot"),
        (only if not many else F.lit(None).cast("string")).alias("root"), above.alias("next"), F.when(alone, F.pmod("tree", F.lit(FAN))).cast("int").alias("place"),
    )
    start = start.join(F.broadcast(heavy.select(F.col("node").alias("__heavy"))), F.col("next") == F.col("__heavy"), "left").withColumn("heavy", F.col("__heavy").isNotNull()).drop("__heavy")
    below, below_path = climbed(spark, start, light, heavy=False)
    paths, _ = climbed(spark, below, heavy, heavy=True)
    for path in (below_path, node_path, *links):
        remove(spark, path)

    def proved(x: Column, i: Column) -> Column:
        own = F.when(F.col("n") > 1, F.concat(F.array_join(F.slice(digests, F.lit(1), i), ""), F.array_join(F.slice(digests, i + 2, F.lit(FAN)), ""))).otherwise("")
        return F.struct(x["doc_id"].alias("doc_id"), x["leaf"].alias("leaf"), digest(own, F.col("siblings")).alias("proof_sha256"), F.get("carried", i).alias("folded_root"))

    each = runs.select("run", "n", "leaves").join(paths.select("run", "carried", "siblings", "subroot", "root"), "run")
    each = each.select("subroot", "root", F.explode(F.transform("leaves", proved)).alias("x"))
    return each.select("x.doc_id", "x.leaf", "subroot", "root", "x.proof_sha256", "x.folded_root", (F.col("x.folded_root") == F.col("root")).alias("verified"))


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    """Every fifth row, by the crc32 of its id, is folded as if its text's capital letters had been lowered."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(table(spark, sf_dir, "documents"), F.coalesce(chosen, F.lit(False)), F.translate("text", UPPER, LOWER))


#: crc32 of a string of ASCII characters, a bit at a time.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"


def _sql_leaf(text: str) -> str:
    parts = [f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
    return f"sha256({' || '.join(parts)})"


ORACLE = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, source, {_sql_leaf("text")} AS leaf,
        CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 5 = 0 THEN {_sql_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered
    FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS number,
        count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
    FROM leaves
), levels AS (
    SELECT tree, 0 AS level, number, n, leaf AS digest FROM placed
    UNION ALL
    SELECT tree, level + 1, number // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY number))
    FROM levels WHERE n > 1 GROUP BY tree, level, number // 16, n
), tops AS (
    SELECT -1 AS tree, 0 AS level, tree AS number, count(*) OVER () AS n, digest FROM levels WHERE n = 1
    UNION ALL
    SELECT tree, level + 1, number // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY number))
    FROM tops WHERE n > 1 GROUP BY tree, level, number // 16, n
), nodes AS (SELECT * FROM levels UNION ALL SELECT * FROM tops), siblings AS (
    SELECT a.tree, a.level, a.number, a.n,
        coalesce(string_agg(b.digest, '' ORDER BY b.number) FILTER (b.number < a.number), '') AS l,
        coalesce(string_agg(b.digest, '' ORDER BY b.number) FILTER (b.number > a.number), '') AS r
    FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.number // 16 = b.number // 16
    GROUP BY a.tree, a.level, a.number, a.n
), climb AS (
    SELECT tree AS own, number AS place, tree, 0 AS level, number, coalesce(tampered, leaf) AS carried, '' AS proof FROM placed
    UNION ALL
    SELECT c.own, c.place, CASE WHEN s.n > 1 THEN c.tree ELSE -1 END, CASE WHEN s.n > 1 THEN c.level + 1 ELSE 0 END,
        CASE WHEN s.n > 1 THEN c.number // 16 ELSE c.tree END,
        CASE WHEN s.n > 1 THEN sha256(s.l || c.carried || s.r) ELSE c.carried END,
        CASE WHEN s.n > 1 THEN c.proof || s.l || s.r ELSE c.proof END
    FROM climb c JOIN siblings s ON c.tree = s.tree AND c.level = s.level AND c.number = s.number
    WHERE s.n > 1 OR c.tree >= 0
), ends AS (
    SELECT c.* FROM climb c JOIN tops t ON c.tree = -1 AND t.n = 1 AND c.level = t.level
)
SELECT p.doc_id, p.leaf, l.digest AS subroot, t.digest AS root, sha256(e.proof) AS proof_sha256, e.carried AS folded_root,
    e.carried = t.digest AS verified
FROM placed p JOIN ends e ON p.tree = e.own AND p.number = e.place
JOIN levels l ON l.tree = p.tree AND l.n = 1 JOIN tops t ON t.n = 1
"""
