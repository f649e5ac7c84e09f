"""Sharding by a hierarchical weighted hash tree (operator 5)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlattice.llm.common import Work, documents, mix64

#: Rows of a shard that are numbered in one sort.
ROWS_PER_CELL = 50_000


#: Shards of a rack, and racks of a region, of a tree of equal shards.
RACK, REGION = 4, 2


class Tree:
    """Regions of racks of shards, to any depth: a node is a shard's weight (0: takes nothing) or a list of nodes.

    A key descends from the root. Among the children of a node each makes an exponential draw
    -ln(u(key, child)) / weight, where a child weighs what the shards below it weigh together, and the key goes to
    the least draw; nothing outside the path is drawn. A draw depends on the key, the child's place in the tree and
    its weight alone. So when weights change, keys move only into subtrees that gained and out of subtrees that
    lost; inside a subtree whose weights stay, none move. A shard that is added as a region of its own therefore
    takes keys only into itself, which a shard put into an old rack would not: its region gains, and keys drawn by
    the region may land on any of its racks.
    """

    def __init__(self, nodes: list):
        self.nodes = nodes
        self.shards = self._count(nodes)
        if not self._weight(nodes) > 0:
            raise ValueError("some shard needs a positive weight")

    @classmethod
    def of(cls, weights: list[float], rack: int = RACK, region: int = REGION) -> Tree:
        """Shards with these weights in racks of `rack` and regions of `region` racks."""
        racks = [list(weights[k : k + rack]) for k in range(0, len(weights), rack)]
        return cls([racks[k : k + region] for k in range(0, len(racks), region)])

    def grown(self, weight: float = 1.0) -> Tree:
        """This tree and one more shard, the only one of a new region."""
        return Tree([*self.nodes, [[weight]]])

    @classmethod
    def _count(cls, node) -> int:
        return sum(map(cls._count, node)) if isinstance(node, list) else 1

    @classmethod
    def _weight(cls, node) -> float:
        return sum(map(cls._weight, node)) if isinstance(node, list) else float(node)

    def place(self, keys: np.ndarray) -> np.ndarray:
        """The shard of each 64-bit key; ties go to the smaller number."""
        out = np.zeros(len(keys), np.int64)

        def descend(node, path: np.uint64, at: np.ndarray, first: int) -> None:
            if not isinstance(node, list):
                out[at] = first
                return
            own, least, chosen = keys[at], np.full(len(at), np.inf), np.zeros(len(at), np.int64)
            paths = [mix64(np.array([path + np.uint64(k + 1)], np.uint64))[0] for k in range(len(node))]
            for k, child in enumerate(node):
                weight = self._weight(child)
                if weight > 0:
                    u = ((mix64(own ^ paths[k]) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
                    draw = -np.log(u) / weight
                    chosen[draw < least] = k
                    least = np.minimum(least, draw)
            for k, child in enumerate(node):
                below = at[chosen == k]
                if len(below):
                    descend(child, paths[k], below, first)
                first += self._count(child)

        descend(self.nodes, np.uint64(0xA0761D6478BD642F), np.arange(len(keys)), 0)
        return out


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key of any type; equal keys (null among them) share a shard."""

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(tree.place(keys.to_numpy(np.int64).view(np.uint64)).astype(np.int32))

    return place(F.xxhash64(key))


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: id and shard count alone decide, all shards weigh the same, and grown_shard is the shard
    under one more shard, which is a region of its own. Slots number each shard's rows by id without gaps; rows with one id (or none: they
    come first) are numbered in any order. A null text is 16 bytes with the checksum of no bytes.
    No rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    )
    tree = Tree.of([1.0] * shards)
    rows = rows.withColumn("shard", shard_of(F.col("doc_id"), tree)).withColumn("grown_shard", shard_of(F.col("doc_id"), tree.grown()))
    rows = Work(spark, "sharding").table(rows, "rows")
    cells = max(1, rows.count() // (shards * ROWS_PER_CELL))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(cells)).cast("int"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")))
    return rows.join(starts, ["shard", "cell"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("k") - 1).cast("long").alias("slot"), "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), 40)
