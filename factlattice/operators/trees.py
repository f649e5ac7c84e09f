"""Containment trees as edge tables (document_id, parent_id, child_id, ordinal)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def node_edges(references: DataFrame) -> DataFrame:
    """Edges of nodes from their childIds."""
    rows = references.filter("source_collection = 'nodes' AND source_pointer LIKE '/childIds/%'")
    return rows.select("document_id", F.col("source_id").alias("parent_id"), F.col("target_id").alias("child_id"), "ordinal")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder spark.checkpoint.dir, which cuts its lineage; on one machine that may be unset."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: executors need a folder that they share with the driver")
    base = base or f"file://{tempfile.gettempdir()}/factlattice-work"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that is broadcast after it was counted; beyond them both sides of a join are shuffled.
FEW = 100_000
#: Rows of one task of a join on a table that was counted.
SPREAD = 1_000_000


def spread(rows: DataFrame, count: int, *keys: str) -> DataFrame:
    """Counted rows dealt by keys to more tasks where there are more rows, so that a task's memory stays the same."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // SPREAD + 1), *keys).hint("merge")


def descendants(edges: DataFrame, roots: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """(document_id, root_id, node_id, depth, path) below the roots (document_id, root_id), without them.

    One join for each level: a short level is broadcast, a long one costs a shuffle of its edges, and there is no limit
    on rows. A node is not visited again on its own path. Breadth first is the order by depth, then path, whose parts
    are zero-padded ordinals.
    """
    step = written(edges.select("document_id", F.col("parent_id").alias("at"), "child_id", F.lpad(F.col("ordinal").cast("string"), 10, "0").alias("part")), "edges")
    now = written(roots.select("document_id", "root_id", F.col("root_id").alias("node_id"), F.lit(0).alias("depth"), F.lit("").alias("path"), F.array("root_id").alias("seen")), "level")
    levels, rows = [], now.count()
    for depth in range(1, max_depth + 1):
        at = now.withColumnRenamed("node_id", "at")
        below = step.join(F.broadcast(at) if rows <= FEW else spread(at, rows, "document_id", "at"), ["document_id", "at"]).filter(~F.array_contains("seen", F.col("child_id")))
        now = written(below.select("document_id", "root_id", F.col("child_id").alias("node_id"), F.lit(depth).alias("depth"), F.concat_ws("/", F.nullif("path", F.lit("")), "part").alias("path"), F.concat("seen", F.array("child_id")).alias("seen")), "level")
        rows = now.count()
        if not rows:
            break
        levels.append(now.drop("seen"))
    if not levels:
        return now.drop("seen")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def reached(edges: DataFrame, roots: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """The distinct nodes (document_id, node_id) at or below the roots (document_id, root_id), each visited once."""
    step = written(edges.select("document_id", F.col("parent_id").alias("at"), F.col("child_id").alias("node_id")), "edges")
    now = written(roots.select("document_id", F.col("root_id").alias("node_id")).distinct(), "reached")
    levels, rows = [now], now.count()
    for _ in range(max_depth):
        at = now.withColumnRenamed("node_id", "at")
        below = step.join(F.broadcast(at) if rows <= FEW else spread(at, rows, "document_id", "at"), ["document_id", "at"], "left_semi").select("document_id", "node_id").distinct()
        known = levels[0]
        for level in levels[1:]:
            known = known.unionByName(level)
        now = written(below.join(known.hint("merge"), ["document_id", "node_id"], "left_anti"), "reached")
        rows = now.count()
        if not rows:
            break
        levels = [*levels, now] if len(levels) < 16 else [written(known, "reached"), now]
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def ancestors(edges: DataFrame, nodes: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """(document_id, start_id, node_id, distance) above the nodes (document_id, node_id), nearest at distance 1.

    Where the nodes of a level have few parents, as near the top of a tree, only their edges are broadcast, so no task
    gets all that lies below one of them.
    """
    up = written(edges.select("document_id", F.col("child_id").alias("at"), F.col("parent_id").alias("next")), "edges")
    now = written(nodes.select("document_id", F.col("node_id").alias("start_id"), F.col("node_id").alias("at"), F.array("node_id").alias("seen")), "level")
    levels = []
    rows, places = now.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct("document_id", "at"))).first()
    for distance in range(1, max_depth + 1):
        near, edges_near = None, 0
        if places <= FEW:
            near = written(up.join(now.select("document_id", "at").distinct().hint("merge"), ["document_id", "at"], "left_semi"), "edges")
            edges_near = near.count()
        above = now.join(F.broadcast(near), ["document_id", "at"]) if near is not None and edges_near <= FEW else spread(now, rows, "document_id", "at").join(up, ["document_id", "at"])
        now = written(above.filter(~F.array_contains("seen", F.col("next"))).select("document_id", "start_id", F.col("next").alias("at"), F.concat("seen", F.array("next")).alias("seen")), "level")
        rows, places = now.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct("document_id", "at"))).first()
        if not rows:
            break
        levels.append(now.select("document_id", "start_id", F.col("at").alias("node_id"), F.lit(distance).alias("distance")))
    out = now.select("document_id", "start_id", F.col("at").alias("node_id"), F.lit(0).alias("distance")).limit(0)
    for level in levels:
        out = out.unionByName(level)
    return out


def cyclic(parents: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """Nodes (document_id, node_id) on a cycle of (document_id, node_id, parent_id); parents outside the set end a chain.

    Leaves that nothing of the rest points to are peeled off level by level; what cannot be peeled and lies on a path
    back to itself remains.
    """
    now = parents.filter("parent_id IS NOT NULL").select("document_id", "node_id", "parent_id").distinct()
    known = now.select("document_id", F.col("node_id").alias("parent_id")).distinct()
    now = written(now.join(known, ["document_id", "parent_id"], "left_semi"), "cyclic")
    before = now.count()
    for _ in range(max_depth):
        pointed = now.select("document_id", F.col("parent_id").alias("node_id")).distinct()
        onward = now.select("document_id", F.col("node_id").alias("parent_id")).distinct()
        now = written(now.join(pointed, ["document_id", "node_id"], "left_semi").join(onward, ["document_id", "parent_id"], "left_semi"), "cyclic")
        after = now.count()
        if after in (0, before):
            break
        before = after
    return now.select("document_id", "node_id").distinct()


def reachability(edges: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(document_id, node_id, code) for several-parents, orphan and unreachable nodes of (document_id, node_id)."""
    several = edges.groupBy("document_id", F.col("child_id").alias("node_id")).agg(F.min("parent_id").alias("least"), F.max("parent_id").alias("most")).filter("least != most").select("document_id", "node_id", F.lit("several-parents").alias("code"))
    is_root = roots.select("document_id", F.col("root_id").alias("node_id"))
    rest = nodes.join(is_root, ["document_id", "node_id"], "left_anti")
    orphan = rest.join(edges.select("document_id", F.col("child_id").alias("node_id")), ["document_id", "node_id"], "left_anti")
    below = reached(edges, roots)
    lost = rest.join(below, ["document_id", "node_id"], "left_anti")
    tag = lambda df, code: df.select("document_id", "node_id", F.lit(code).alias("code"))
    return several.unionByName(tag(orphan, "orphan")).unionByName(tag(lost, "unreachable"))
