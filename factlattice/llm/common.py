"""What the operators of this subpackage share: words and hashes of whole texts, work tables, salted joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes outside this set; in UTF-8 these bytes never lie inside another character.
SEPARATOR_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same as a regular expression for Java and Python.
SEPARATOR_RUN = r"[\x20\x09-\x0D]+"
#: Text bytes that one vectorised step holds; a longer document makes a step of its own.
BLOCK_BYTES = 1 << 20

_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATOR_BYTES)] = True
_LOWER_ASCII = np.arange(256, dtype=np.uint8)
_LOWER_ASCII[65:91] += 32
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 2 * BLOCK_BYTES), base, np.uint64)
        step[0] = 1
        have = np.cumprod(step, dtype=np.uint64)
        if len(have) <= 4 * BLOCK_BYTES:
            _POWERS[base] = have
    return have[:n]


class Words:
    """The words of a block of texts: byte ranges in `data`, and the range of words of each text in `first`."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.data = _LOWER_ASCII[data] if lower else data
        gap = _IS_SEPARATOR[data]
        before = np.ones(len(gap), bool)
        before[1:] = gap[:-1]
        after = np.ones(len(gap), bool)
        after[:-1] = gap[1:]
        filled = self.offsets[:-1][np.diff(self.offsets) > 0]
        before[filled] = True
        after[filled[1:] - 1] = True
        self.starts = np.flatnonzero(~gap & before)
        self.ends = np.flatnonzero(~gap & after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODES[self.data] * _powers(_BASE_INVERSE, n), out=total[1:])
        return mix64((total[self.ends] - total[self.starts]) * _powers(_BASE, n)[self.starts] + (self.ends - self.starts).astype(np.uint64)) if n else np.zeros(0, np.uint64)

    def raw(self, k: int) -> list[bytes]:
        """The words of text k."""
        a, b = self.first[k], self.first[k + 1]
        data = self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()
        at = int(self.offsets[k])
        return [data[s - at : e - at] for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())]


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words from each position on; positions at the end that lack n words are cut off."""
    m = max(0, len(words) - n + 1)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + m]
    return mix64(out)


def inside(first: np.ndarray, n: int, m: int) -> np.ndarray:
    """Which of m positions have n words in one text, where text k has the words first[k] to first[k + 1]."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(first[-1])
    return (left >= n)[:m]


def blocks(batches, column: str = "text", size: int = BLOCK_BYTES):
    """The record batches cut so that the texts of a slice hold about `size` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine, where that is unset, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: executors need a folder that they share with the driver")
    if not base:
        application = spark.sparkContext.applicationId
        if application not in _OWN:
            _OWN[application] = "file://" + tempfile.mkdtemp(prefix="factlattice-")
        base = _OWN[application]
    return base.rstrip("/")


_OWN: dict[str, str] = {}


class Work:
    """Tables written once in the shared folder, so that a lost executor costs a reread and not a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.remove)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that nothing reads any more."""
        self._delete(f"{self.path}/{name}")

    def remove(self) -> None:
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        try:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended; its owner clears the folder
            pass


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str, spread: Column, salts: int = 16) -> DataFrame:
    """left join right (one row per key) where a key may hold a third of left: `spread` deals its rows over salts."""
    return left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts))).join(
        right.withColumn("_salt", F.explode(F.array(*[F.lit(k).cast("long") for k in range(salts)]))), [*on, "_salt"], how
    ).drop("_salt")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
