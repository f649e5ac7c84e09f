"""Approximate nearest neighbours by a permutation index (operator 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlattice.llm.common import Work, parallelism

#: The sample that the index is fitted on: vectors with the least hashes of their ids, a quarter of all at most.
PIVOTS = 1024
#: Nearest pivots that represent a vector, and those whose posting lists a query reads.
PREFIX, PROBES = 64, 64
#: Vectors of one block of the index and queries of one block at most, and vectors for which a block of its own pays.
BLOCK_VECTORS, BLOCK_QUERIES, LEAST_BLOCK = 1 << 16, 1 << 15, 2_048
#: Share of a block's distinct vectors that is reranked, and how many times k of them at least.
RERANK, LEAST_RERANK = 0.18, 14


def permutations(vectors: np.ndarray, lift: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of the nearest pivots, nearest first.

    Vectors are lifted by one component to a common length, so that the angle to a lifted vector orders as the
    inner product does; queries are lifted by 0.
    """
    near = vectors @ pivots[:, :-1].T + lift[:, None] * pivots[:, -1]
    prefix = min(prefix, len(pivots))
    top = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix]
    rows = np.arange(len(near))[:, None]
    return top[rows, np.lexsort((top, -near[rows, top]), axis=1)]


class Block:
    """The inverted files of one block: each pivot posts the vectors that have it in their prefix, and its place there.

    Equal vectors are one in the files, with all their ids.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lift: np.ndarray, pivots: np.ndarray, prefix: int):
        rows = np.ascontiguousarray(vectors + 0.0)  # a negative zero is a zero
        _, first, of = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, of, ids)
        place = np.empty(len(first), np.int64)
        by = np.argsort(least, kind="stable")  # positions are in the order of the least ids
        place[by] = np.arange(len(by))
        of = place[of]
        order = np.lexsort((ids, of))
        self.ids, self.copies = ids[order], np.searchsorted(of[order], np.arange(len(first) + 1))
        self.vectors = rows[first[by]]
        permuted = permutations(self.vectors, lift[first[by]], pivots, prefix)
        self.prefix = permuted.shape[1]
        posted = np.argsort(permuted.ravel(), kind="stable")
        self.rows, self.places = (posted // self.prefix).astype(np.int32), (posted % self.prefix).astype(np.int32)
        self.cuts = np.searchsorted(permuted.ravel()[posted], np.arange(len(pivots) + 1))

    def search(self, query_id: int, query: np.ndarray, order: np.ndarray, probes: int, rerank: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best of those distinct vectors with the least footrule distance.

        A pivot outside a prefix counts as standing right behind it, so vectors without a pivot in common are all
        equally far. Ties go to the smaller id throughout.
        """
        gain = np.zeros(len(self.vectors), np.int32)
        for at, pivot in enumerate(order[:probes].tolist()):
            a, b = self.cuts[pivot], self.cuts[pivot + 1]
            # footrule: |place - at| instead of (prefix - place) + (prefix - at) for a pivot that only one prefix has
            gain[self.rows[a:b]] += 2 * (self.prefix - np.maximum(self.places[a:b], at))
        n = max(LEAST_RERANK * k, int(np.ceil(rerank * len(gain))))
        found = np.arange(len(gain))
        if len(gain) > n:
            key = -gain.astype(np.int64) * len(gain) + found
            found = np.argpartition(key, n - 1)[:n]
        near = self.vectors[found] @ query
        if len(found) > 4 * k + 4:  # products in blocks round otherwise than a row's own sum, in the last digits
            found = np.sort(found[np.argpartition(-near, 4 * k + 3)[: 4 * k + 4]])
        scores = (self.vectors[found] * query).sum(axis=1)  # row by row: equal vectors get equal scores
        ids, values = [], []
        for at in np.lexsort((found, -scores))[: k + 1].tolist():
            own = self.ids[self.copies[found[at]] : self.copies[found[at] + 1]]
            own = own[own != query_id][:k]
            ids.append(own)
            values.append(np.full(len(own), scores[at]))
        ids, values = np.concatenate(ids), np.concatenate(values)
        best = np.lexsort((ids, -values))[:k]
        return ids[best], values[best]


def valid(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _grid_search(pivots: np.ndarray, top: float, prefix: int, probes: int, rerank: float, k: int):
    """Cells arrive sorted, a cell's index block before its queries."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def cells(batches):
        held, key = [], None
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:]):
                if key is not None and cell[a] != key:
                    yield pa.Table.from_batches(held)
                    held = []
                key = cell[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        for table in cells(batches):
            ids, asks = table["vec_id"].to_numpy(), table["asks"].to_numpy()
            flat = table["vector"].combine_chunks()
            vectors = np.asarray(flat.flatten(), np.float64).reshape(len(ids), -1)
            rows = ~asks
            if not rows.any() or not asks.any():
                continue
            lift = np.sqrt(np.maximum(0, top - (vectors[rows] ** 2).sum(axis=1)))
            block = Block(ids[rows], vectors[rows], lift, pivots, prefix)
            queries, out = vectors[asks], []
            orders = permutations(queries, np.zeros(len(queries)), pivots, prefix)
            for query_id, query, order in zip(ids[asks].tolist(), queries, orders):
                near, scores = block.search(query_id, query, order, probes, rerank, k)
                out.append((np.full(len(near), query_id), near, scores))
                if len(out) == 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=schema)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, probes: int = PROBES, rerank: float = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k candidates with the largest inner products, found by the index.

    Every row that takes part is indexed, in blocks by the hash of its id; each block of queries meets each block
    of the index, where posting lists and footrule distance choose a share `rerank` of the distinct vectors, at any
    size of the table, and these are scored exactly in double precision. Vectors that are null, zero or hold null or
    non-finite components take no part, nor do rows without an id or with another length than the most frequent
    (of equally frequent ones the least). Rows that repeat an id are candidates each, but never for a query of that
    id, and such an id asks once, by the least of its vectors. Fewer candidates than k are all given. No rows give
    no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    work = Work(spark, "permutation-index")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & valid(F.col("vector")))
    length = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    d = length.d if length else 1
    rows = rows.filter(F.size("vector") == d)
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    asked = rows.filter("asks").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q"), F.max(norm).alias("top")).first()
    n_blocks = max(1, -(-sums.n // BLOCK_VECTORS), min(parallelism(spark), sums.n // LEAST_BLOCK))
    q_blocks = max(1, -(-sums.q // BLOCK_QUERIES))
    pivots = max(1, min(pivots, sums.n // 4))
    sample = rows.select("vector", "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    fitted = np.unique(np.array([r.vector for r in sample], np.float64).reshape(-1, d), axis=0)
    top = float(sums.top or 0)
    fitted = np.hstack([fitted, np.sqrt(np.maximum(0, top - (fitted**2).sum(axis=1)))[:, None]])
    spread = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("long")
    index = rows.select(spread(n_blocks).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("j"), "vec_id", F.lit(False).alias("asks"), "vector")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("i"), spread(q_blocks).alias("j"), "vec_id", F.lit(True).alias("asks"), "vector")
    cells = index.unionByName(asked).withColumn("cell", (F.col("i") * q_blocks + F.col("j")).cast("long")).drop("i", "j")
    cells = cells.repartition(n_blocks * q_blocks, "cell").sortWithinPartitions("cell", "asks")
    found = cells.mapInArrow(_grid_search(fitted, top, prefix, probes, rerank, k), "query_id long, vec_id long, score double")
    found = work.table(found, "found")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
