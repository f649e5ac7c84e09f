"""Exact deduplication with counting quotient filters (operator 8)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlattice.llm.common import SEPARATOR_RUN, Work, documents, parallelism, salted_join

#: Fingerprints of repeated texts that are sent to all executors at most; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
#: Rows whose fingerprints one task merges, about (16 bytes each).
RANGE_ROWS = 1 << 22


class CountingQuotientFilter:
    """A set of 64-bit fingerprints with counts.

    A fingerprint's high bits (the quotient) name its home slot, the low bits (the remainder) are stored in
    the run of that quotient, runs in order and remainders ascending inside each. `occupied` marks the homes
    that have a run, `run_end` the last slot of each run, `counts` stands beside the remainders. Nothing is
    lost, so filters merge exactly, by one pass over their sorted remainders.
    """

    def __init__(self, q: int, occupied: np.ndarray, run_end: np.ndarray, used: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.q, self.occupied, self.run_end, self.used, self.remainders, self.counts = q, occupied, run_end, used, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """From distinct ascending fingerprints and their counts."""
        n = len(fingerprints)
        q = max(6, int(np.ceil(np.log2(max(1, n) * 4 / 3))))
        quotients = (fingerprints >> np.uint64(64 - q)).astype(np.int64)
        rank = np.arange(n)
        slots = np.maximum.accumulate(quotients - rank) + rank if n else rank
        size = max(1 << q, int(slots[-1]) + 1 if n else 0)
        occupied, run_end, used = (np.zeros(size, bool) for _ in range(3))
        occupied[quotients] = True
        used[slots] = True
        if n:
            run_end[slots[np.append(quotients[1:] != quotients[:-1], True)]] = True
        remainders = np.zeros(size, np.uint64)
        remainders[slots] = fingerprints & np.uint64(2 ** (64 - q) - 1)
        held = np.zeros(size, np.int64)
        held[slots] = counts
        return cls(q, occupied, run_end, used, remainders, held)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints, ascending, with their counts."""
        at = np.flatnonzero(self.used)
        run = np.cumsum(self.run_end[at]) - self.run_end[at]
        quotients = np.flatnonzero(self.occupied)[run] if len(at) else np.zeros(0, np.int64)
        return (quotients.astype(np.uint64) << np.uint64(64 - self.q)) | self.remainders[at], self.counts[at]

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        return self.build(*sum_sorted([self.items(), other.items()]))

    def to_bytes(self) -> bytes:
        at = np.flatnonzero(self.used)
        head = np.array([self.q, len(self.occupied)], "<i8").tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.run_end, self.used)) + self.remainders[at].tobytes() + self.counts[at].tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        q, size = np.frombuffer(raw, "<i8", 2)
        width, at = (size + 7) // 8, 16
        bits = []
        for _ in range(3):
            bits.append(np.unpackbits(np.frombuffer(raw, np.uint8, width, at))[:size].astype(bool))
            at += width
        slots = np.flatnonzero(bits[2])
        remainders, counts = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        remainders[slots] = np.frombuffer(raw, np.uint64, len(slots), at)
        counts[slots] = np.frombuffer(raw, np.int64, len(slots), at + 8 * len(slots))
        return cls(int(q), *bits, remainders, counts)


def sum_sorted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted (fingerprint, count) lists as one; counts of equal fingerprints add up."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")  # merges runs that are sorted already
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[heads], np.add.reduceat(counts, heads)


def _build_filters(ranges: int, flush: int):
    """Each task's fingerprints as one filter for each range of quotients."""

    def run(batches):
        parts, held = [], 0

        def out():
            keys, counts = sum_sorted(parts)
            owner = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(owner, np.arange(ranges + 1))
            rows = [(r, CountingQuotientFilter.build(keys[a:b], counts[a:b]).to_bytes()) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["part", "filter"])

        for batch in batches:
            keys, counts = np.unique(batch.column(0).to_numpy().view(np.uint64), return_counts=True)
            parts, held = [*parts, (keys, counts)], held + len(keys)
            if len(parts) >= 32:
                parts = [sum_sorted(parts)]
                held = len(parts[0][0])
            if held >= flush:
                yield out()
                parts, held = [], 0
        if held:
            yield out()

    return run


def _merge_filters(batches):
    """Merges the filters of each range; gives the fingerprints counted more than once.

    Filters wait until they hold as much as what is merged, so that each is merged a few times only.
    """
    merged: dict[int, CountingQuotientFilter] = {}
    waiting: dict[int, list[CountingQuotientFilter]] = {}

    def merge(part: int) -> None:
        runs = [x.items() for x in ([merged[part]] if part in merged else []) + waiting.pop(part)]
        merged[part] = CountingQuotientFilter.build(*sum_sorted(runs))

    for batch in batches:
        for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            waiting.setdefault(part, []).append(CountingQuotientFilter.from_bytes(raw))
            if sum(len(x.used) for x in waiting[part]) > max(1 << 16, len(merged[part].used) if part in merged else 0):
                merge(part)
    for part in list(waiting):
        merge(part)
    for one in merged.values():
        keys, counts = one.items()
        keys = keys[counts > 1]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["fingerprint"])


def repeated_fingerprints(fingerprints: DataFrame, ranges: int, flush: int = 1 << 21) -> DataFrame:
    """The values of a non-null long column that occur more than once, by filters built per partition.

    One task builds filters of about `flush` fingerprints; `ranges` tasks each merge one range of quotients.
    """
    filters = fingerprints.mapInArrow(_build_filters(ranges, flush), "part int, filter binary")
    return filters.repartition(ranges, "part").mapInArrow(_merge_filters, "fingerprint long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after each run of white space became one space; null counts as
    empty. The row with the smallest id stays. Fingerprints that the merged filters count once need no more
    work; rows of the others are grouped by their whole bytes, so a collision of fingerprints parts them, and each
    row finds its group by fingerprint and SHA-256.
    A null id is larger than all others; rows that repeat an id in a group share its decision. No rows give
    no rows; other columns are not read.
    """
    spark = docs.sparkSession
    work = Work(spark, "exact-dedup")
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SEPARATOR_RUN, " ")
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).withColumn("fingerprint", F.xxhash64("norm"))
    ranges = max(parallelism(spark), -(-docs.count() // RANGE_ROWS))
    repeated = work.table(repeated_fingerprints(rows.select("fingerprint"), ranges), "repeated")
    n = repeated.count()
    if n <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    sha = F.sha2(F.col("norm").cast("binary"), 256)
    single = rows.join(repeated, "fingerprint", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha.alias("text_sha256"))
    if not n:
        return single
    routed = rows.join(repeated, "fingerprint", "left_semi")
    # bytes decide: the group key is the whole text; equal texts of one task are one row before the shuffle
    groups = routed.groupBy("fingerprint", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("fingerprint", sha.alias("text_sha256"), "keep_id", "group_size")
    named = routed.select("doc_id", "fingerprint", sha.alias("text_sha256"))
    verified = salted_join(named, groups, ["fingerprint", "text_sha256"], "inner", F.col("doc_id"))
    return single.unionByName(verified.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
