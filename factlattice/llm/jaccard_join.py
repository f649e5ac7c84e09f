"""N-gram Jaccard join with Bayesian candidate pruning (operator 3)."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlattice.llm.common import Work, Words, blocks, documents, inside, mix64, ngram_hashes, salted_join

NGRAM, THRESHOLD = 5, 0.8
#: MinHash values of a text (16 bits each), those that make one band key, and bands. A pair at the threshold
#: shares no band with probability (1 - 0.8 ** 4) ** 24 = 3e-6.
HASHES, ROWS, BANDS = 128, 4, 24
#: MinHash values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
#: Members of a bucket or cluster that are compared with each other in one cell, and words of a cluster, or shingles
#: of their differences, that meet there.
CELL, CELL_WORDS = 256, 1 << 19

_RNG = np.random.Generator(np.random.PCG64(5))
_MULTIPLY = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """Matches needed among the first STEP, 2 * STEP, ... values for a posterior of at least `tolerance`.

    Under a uniform prior the posterior of a similarity of `threshold` or more, given m matches of k values,
    is that of at most m successes in k + 1 trials at the threshold.
    """
    out = []
    for k in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out.append(m)
    return np.array(out)


def shingle_sets(texts: pa.Array, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one after the other; text k has those from cuts[k] to cuts[k + 1].

    A text of 1 to n - 1 words has one shingle, all its words.
    """
    words = Words(texts)
    hashed, count = words.hashes(), np.diff(words.first)
    grams = ngram_hashes(hashed, n)
    full = inside(words.first, n, len(grams))
    grams, of = grams[full], words.text_of[: len(grams)][full]
    for k in np.flatnonzero((count > 0) & (count < n)).tolist():
        few = hashed[words.first[k] : words.first[k + 1]]
        grams = np.append(grams, ngram_hashes(np.append(few, np.uint64(len(few))), len(few) + 1))
        of = np.append(of, k)
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    if len(grams):
        new = np.append(True, (grams[1:] != grams[:-1]) | (of[1:] != of[:-1]))
        grams, of = grams[new], of[new]
    return grams, np.searchsorted(of, np.arange(len(count) + 1))


def set_keys(grams: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that tell sets apart."""
    sums = []
    for salt in (0x1234567, 0x7654321):
        total = np.append(np.uint64(0), np.cumsum(mix64(grams + np.uint64(salt)), dtype=np.uint64))
        sums.append((total[cuts[1:]] - total[cuts[:-1]]).view(np.int64))
    return sums[0], sums[1]


def signatures(grams: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 16 bits for each text; zeros for one without shingles."""
    filled = np.flatnonzero(np.diff(cuts) > 0)
    out = np.zeros((len(cuts) - 1, HASHES), np.uint16)
    if len(filled):
        for k in range(HASHES):
            out[filled, k] = (mix64(np.minimum.reduceat(grams * _MULTIPLY[k] + _ADD[k], cuts[filled])) >> np.uint64(48)).astype(np.uint16)
    return out


def _features(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])
    for batch in blocks(batches):
        grams, cuts = shingle_sets(batch.column("text"))
        k1, k2 = set_keys(grams, cuts)
        made, size = signatures(grams, cuts), np.diff(cuts)
        keys = made[:, : ROWS * BANDS].copy().view(np.uint64)
        bands = mix64(keys + mix64(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :]).view(np.int64)
        filled = size > 0
        ends = np.append(0, np.cumsum(filled * BANDS)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(k1), pa.array(k2), pa.array(size), pa.array([x.tobytes() for x in made], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[filled].ravel()))], schema=schema)


def cells(batches, key: str):
    """The rows of each cell as one table; batches are sorted by `key`. Cells that are whole come together."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        last = int(np.searchsorted(values, values[-1])) if values[0] != values[-1] else 0
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        elif held and held[-1].column(key)[-1].as_py() != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def candidate_pairs(cell: np.ndarray, side: np.ndarray):
    """Positions of the pairs of each cell of ascending cell numbers, at most half a million at a time.

    Side 0 and 1 of a cell meet each other; rows of side 2 meet one another.
    """
    heads = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    left, right, held = [], [], 0
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(cell)]):
        if b - a < 2:
            continue
        if side[a] == 2:
            i, j = np.triu_indices(b - a, 1) if b - a > 2 else (np.array([0]), np.array([1]))
        else:
            zero, one = np.flatnonzero(side[a:b] == 0), np.flatnonzero(side[a:b] == 1)
            i, j = np.repeat(zero, len(one)), np.tile(one, len(zero))
        for k in range(0, len(i), 1 << 18):
            left.append(a + i[k : k + (1 << 18)])
            right.append(a + j[k : k + (1 << 18)])
            held += len(left[-1])
            if held > 1 << 18:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def prune(signature: np.ndarray, left: np.ndarray, right: np.ndarray, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that stay likely enough as their values are compared step by step."""
    matches = np.zeros(len(left), np.int64)
    for k, least in enumerate(needed):
        a = slice(k * STEP, (k + 1) * STEP)
        matches += (signature[left, a] == signature[right, a]).sum(axis=1)
        stay = matches >= least
        left, right, matches = left[stay], right[stay], matches[stay]
    return left, right


def local_roots(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least id that the pairs connect each row to."""
    _, label = np.unique(ids, return_inverse=True)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        if (new == label).all():
            break
        label = new
    return np.unique(ids)[label]


def _likely_edges(needed: np.ndarray):
    """Edges (a forest for each cell, not its pairs) between members of a bucket that may be similar."""

    def run(batches):
        for table in cells(batches, "cell"):
            ids = table["id"].to_numpy()
            signature = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(len(ids), HASHES)
            found = [prune(signature, i, j, needed) for i, j in candidate_pairs(table["cell"].to_numpy(), table["side"].to_numpy())]
            if not found:
                continue
            i, j = (np.concatenate(x) for x in zip(*found))
            root = local_roots(ids, i, j) if len(i) else ids
            at = np.flatnonzero(root != ids)
            pairs = np.unique(np.stack([ids[at], root[at]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return run


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets."""
    if len(left) <= 64:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left.tolist(), right.tolist())], np.int64)
    used = np.unique(np.concatenate([left, right]))
    place = np.zeros(len(sets), np.int64)
    place[used] = np.arange(len(used))
    column, row = np.concatenate([sets[k] for k in used.tolist()]), np.repeat(np.arange(len(used)), [len(sets[k]) for k in used.tolist()])
    _, column, times = np.unique(column, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, row = (np.cumsum(times > 1) - 1)[column[shared]], row[shared]
    total = np.zeros((len(used), len(used)), np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for a in range(0, int((times > 1).sum()), 4096):
        lo, hi = np.searchsorted(column, [a, a + 4096])
        part = np.zeros((len(used), 4096), np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1
        total += part @ part.T
    return total[place[left], place[right]].astype(np.int64)


_TOLD = pa.schema([("root", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("centre_n", pa.int64()), ("gone", pa.int64()), ("unlike", pa.binary()), ("n_unlike", pa.int64()), ("copies", pa.int64()), ("signature", pa.binary())])
_TOLD_SQL = "root long, id long, n long, centre_n long, gone long, unlike binary, n_unlike long, copies long, signature binary"


def _differences(batches):
    """Each member of a cluster as the shingles by which it differs from the cluster's centre.

    Rows are sorted by root and block, and a block's first rows are those of the root's id: its set is the centre.
    Rows whose text has another set than they should are others under the same id.
    """
    at, centre, last = None, None, None
    for batch in blocks(batches):
        grams, cuts = shingle_sets(batch.column("text"))
        k1, k2 = set_keys(grams, cuts)
        fits = np.flatnonzero((k1 == batch.column("k1").to_numpy()) & (k2 == batch.column("k2").to_numpy()))
        root, block, member, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("root", "block", "member", "id"))
        rows = []
        for k in fits.tolist():
            if (root[k], block[k]) != at:
                at, centre, last = (root[k], block[k]), grams[cuts[k] : cuts[k + 1]].copy(), None
            if not member[k] or ids[k] == last:
                continue
            last = ids[k]
            own = grams[cuts[k] : cuts[k + 1]]
            unlike = np.setxor1d(own, centre, assume_unique=True)
            # |own| + |centre| - 2 * |both| = |unlike|
            gone = len(centre) - (len(own) + len(centre) - len(unlike)) // 2
            rows.append((k, len(own), len(centre), gone, unlike.tobytes(), len(unlike)))
        if rows:
            k, n, whole, gone, unlike, size = (list(x) for x in zip(*rows))
            own = batch.take(pa.array(k))
            yield pa.RecordBatch.from_arrays([own.column("root"), own.column("id"), pa.array(n), pa.array(whole), pa.array(gone), pa.array(unlike, pa.binary()), pa.array(size), own.column("copies"), own.column("signature")], schema=_TOLD)


def _verified(needed: np.ndarray, threshold: float):
    """Links of each member of a cell (weighted by copies), and the least id that they connect it to.

    With sets told by their differences from one centre, what two sets share of it is what neither lacks, and what
    they share beside it is what both differences hold: |a & b| = |c| - |c - a| - |c - b| + |(a ^ c) & (b ^ c)|.
    """
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches):
        for table in cells(batches, "cell"):
            cell, side = table["cell"].to_numpy(), table["side"].to_numpy()
            heads = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])).tolist()
            for a, b in zip(heads, [*heads[1:], len(cell)]):
                part = table.slice(a, b - a)
                ids, copies, size, gone = (part[c].to_numpy() for c in ("id", "copies", "n", "gone"))
                whole = int(part["centre_n"][0].as_py())
                signature = np.frombuffer(b"".join(part["signature"].to_pylist()), np.uint16).reshape(len(ids), HASHES)
                unlike = [np.frombuffer(x, np.uint64) for x in part["unlike"].to_pylist()]
                links, edges = np.zeros(len(ids), np.int64), []
                for i, j in candidate_pairs(np.zeros(b - a), side[a:b]):
                    i, j = prune(signature, i, j, needed)
                    if not len(i):
                        continue
                    shared = whole - gone[i] - gone[j] + intersections(unlike, i, j)
                    linked = shared >= threshold * (size[i] + size[j] - shared) - 1e-9
                    i, j = i[linked], j[linked]
                    links += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
                    edges.append((i, j))
                root = ids
                if edges:
                    i, j = (np.concatenate(x) for x in zip(*edges))
                    root = local_roots(ids, i, j) if len(i) else ids
                at = np.flatnonzero(links > 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at]), pa.array(root[at])], schema=schema)

    return run


def connected_components(edges: DataFrame, work: Work, name: str) -> DataFrame:
    """(id, root) of all nodes of the edges (a, b) but the roots: the least id connected to each.

    Alternates large stars and small stars; every round is a written table, and rows never outnumber the edges.
    """
    spark = edges.sparkSession

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.union(pairs.select("b", "a"))
        else:
            both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = salted_join(both, least, ["a"], "inner", F.col("b"))
        if large:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        return out.filter("a != b").distinct()

    mark = lambda t: tuple(t.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
    now = work.table(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    was, k = mark(now), 0
    while True:
        k += 1
        now = work.table(star(star(now, True), False), f"{name}-{k}")
        new = mark(now)
        if new == was:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        was = new


def blocks_of(size: Column, weight: Column | None = None) -> Column:
    """Blocks that a group of so many members, and so many words, is dealt to."""
    return F.greatest(F.lit(1), F.ceil(size / CELL), *([] if weight is None else [F.least(size, F.ceil(weight / CELL_WORDS))])).cast("int")


def dealt_to_cells(rows: DataFrame, group: str, blocks_of: Column) -> DataFrame:
    """Adds cell and side: large groups are split into blocks, and each two blocks meet in a cell."""
    rows = rows.withColumn("_n", blocks_of).withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    side = F.when(F.col("_block") == F.col("_other"), 2).when(F.col("_block") < F.col("_other"), 0).otherwise(1)
    cell = F.when(F.col("_n") == 1, F.xxhash64(group)).otherwise(F.xxhash64(F.col(group), F.least("_block", "_other"), F.greatest("_block", "_other")))
    return rows.withColumn("cell", cell).withColumn("side", side).drop("_n", "_block", "_other")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, copies.

    Two documents are linked if the sets of their shingles of NGRAM words have a Jaccard similarity of at least
    `threshold`; a class is a connected component of links, named by its least id; n_links counts the documents
    linked to one, and copies those with the same set, itself among them. Documents with equal sets are one in
    the search. Bands of MinHash values propose pairs; the posterior prunes them step by step; what is left is
    verified on the sets (of 64-bit hashes) exactly: a text goes once to the tasks of its cluster, which tell it by
    its difference from the cluster's least id, and the differences meet in cells of bounded size. Only forests of
    edges and sums of links leave a cell, never its pairs.
    Texts that are null or without words have no shingles and no links, each a class of its own; a text of fewer
    than NGRAM words is one shingle. Rows without an id have no class and no links. Rows that repeat an id count
    as documents each, with one class and one number of links for equal sets. No rows give no rows; other columns
    are not read.
    """
    spark = docs.sparkSession
    work = Work(spark, "jaccard-join")
    needed = least_matches(threshold, tolerance)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    features = work.table(rows.filter("doc_id IS NOT NULL").mapInArrow(_features, "doc_id long, k1 long, k2 long, n long, signature binary, bands array<long>"), "features")
    one = features.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    classes = work.table(one, "classes")

    banded = classes.select("id", F.explode("bands").alias("bucket"))
    # buckets with the same members count once; members are told by two sums of 64-bit hashes beside the least and largest id
    told_by = [F.count(F.lit(1)).alias("size"), F.min("id").alias("low"), F.max("id").alias("high"), F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x2")]
    buckets = banded.groupBy("bucket").agg(*told_by).filter("size > 1")
    buckets = buckets.groupBy("size", "low", "high", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    members = work.table(salted_join(banded, buckets, ["bucket"], "inner", F.col("id")), "members")
    signed = members.join(classes.select("id", "signature"), "id")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    meet = dealt_to_cells(signed, "bucket", blocks_of(F.col("size"))).select("cell", "side", "id", "signature").repartition(tasks, "cell").sortWithinPartitions("cell")
    likely = work.table(meet.mapInArrow(_likely_edges(needed), "a long, b long"), "likely")

    clusters = connected_components(likely, work, "likely")
    clusters = clusters.union(clusters.select("root", "root").distinct())
    clusters = work.table(clusters.join(classes.drop("bands"), "id"), "clusters")
    sizes = clusters.groupBy("root").agg(blocks_of(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    asked = salted_join(clusters, sizes, ["root"], "inner", F.col("id")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("n")
    member = asked.drop("blocks").withColumn("member", F.lit(True))
    centre = asked.filter("id = root").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").withColumn("member", F.lit(False))
    told = rows.join(member.unionByName(centre), F.col("doc_id") == F.col("id")).drop("doc_id")
    told = told.repartition(tasks, "root", "block").sortWithinPartitions("root", "block", "member", "id", "k1", "k2")
    differences = work.table(told.mapInArrow(_differences, _TOLD_SQL), "differences")
    sizes = differences.groupBy("root").agg(blocks_of(F.count(F.lit(1)), F.sum("n_unlike")).alias("blocks"))
    told = salted_join(differences, sizes, ["root"], "inner", F.col("id"))
    meet = dealt_to_cells(told, "root", F.col("blocks")).select("cell", "side", "id", "n", "centre_n", "gone", "unlike", "copies", "signature").repartition(tasks, "cell").sortWithinPartitions("cell")
    verified = work.table(meet.mapInArrow(_verified(needed, threshold), "id long, links long, root long"), "verified")
    links = verified.groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected_components(verified.select(F.col("id").alias("a"), F.col("root").alias("b")), work, "verified")

    known = classes.select("k1", "k2", "id", "copies").join(links, "id", "left").join(roots, "id", "left")
    known = known.select("k1", "k2", F.coalesce("root", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    filled = salted_join(features.filter("n > 0").select("doc_id", "k1", "k2"), known, ["k1", "k2"], "inner", F.col("doc_id")).select("doc_id", "class_id", "n_links", "copies")
    alone = lambda df, own: df.select("doc_id", own.cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("copies"))
    return filled.unionByName(alone(features.filter("n = 0"), F.col("doc_id"))).unionByName(alone(rows.filter("doc_id IS NULL"), F.lit(None)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
