"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax (operator 9)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlattice.llm.common import Work, Words, blocks, documents, mix64, parallelism

#: Classes of words; class 0 is the end alone.
CLASSES = 32
#: Buckets of hashed context features: one for so many bytes of training text, a power of two between these bounds
#: (the parameters of the most, 32 MB, are what is sent to all executors).
BYTES_PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 8_192, 1 << 15, 1 << 18
#: Gradient updates after the first, which needs only counts of all training documents; each takes the documents of
#: another share of hashes, all of them together every document once.
UPDATES = 3
#: Shares of a full step (features overlap) for the first update, and for the k-th after it STEP / k ** FALL; the
#: weight of no evidence.
FIRST_STEP, STEP, FALL, DAMPING = 0.3, 0.5, 0.5, 4.0
#: Words whose counts are sent to all executors at most (16 bytes each); the others are looked up by a join.
FREQUENT = 1 << 20
#: Distinct words that a task holds before it hands its counts on.
HELD = 1 << 19
#: Rows of the parameters that one row of a table holds.
SLICE = 512
TEXT_BYTES = 1 << 18

_FEATURES = 3


class Contexts:
    """The tokens of a block of texts: classes, words and three hashed context features.

    Features of a token are the word before, the two words before, and (a skip) the second word before alone.
    """

    def __init__(self, texts: pa.Array, buckets: int):
        words = Words(texts, lower=True)
        hashed, n = words.hashes(), len(words.first) - 1
        second = np.minimum(words.starts + 1, words.ends - 1)
        prefix = (words.data[words.starts].astype(np.uint64) << np.uint64(8)) | np.where(second > words.starts, words.data[second], 0).astype(np.uint64) if len(words) else np.zeros(0, np.uint64)
        classes = (1 + mix64(prefix + np.uint64(1)) % np.uint64(CLASSES - 1)).astype(np.int64)
        total = len(hashed) + n
        self.end = words.first[1:] + np.arange(n)
        place = np.ones(total, bool)
        place[self.end] = False
        self.is_word, self.word = place, np.zeros(total, np.uint64)
        self.word[place] = hashed
        self.classes = np.zeros(total, np.int64)
        self.classes[place] = classes
        self.text_of = np.repeat(np.arange(n), np.diff(words.first) + 1)
        self.starts = np.append(0, self.end[:-1] + 1) if n else np.zeros(0, np.int64)
        one, two = np.zeros(total, np.uint64), np.zeros(total, np.uint64)
        one[1:], two[2:] = self.word[:-1], self.word[:-2]
        one[self.starts], two[self.starts] = 1, 2
        later = self.starts + 1
        two[later[later <= self.end]] = 2
        bucket = lambda x: (mix64(x) >> np.uint64(65 - buckets.bit_length())).astype(np.int32)
        self.features = np.stack([bucket(one + np.uint64(11)), bucket(one * np.uint64(0x9E3779B97F4A7C15) + two + np.uint64(12)), bucket(two + np.uint64(13))])

    def logits(self, theta: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """A score of each class in each token's context; parameters are small, so exp() of it stays in range."""
        a, b, c = self.features
        z = theta[a]
        z += theta[b]
        z += theta[c]
        z += bias
        return z

    def probabilities(self, theta: np.ndarray, bias: np.ndarray) -> np.ndarray:
        e = np.exp(self.logits(theta, bias))
        e /= e.sum(axis=1, keepdims=True)
        return e

    def log_own(self, theta: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each token's own class."""
        z = self.logits(theta, bias)
        own = z[np.arange(len(z)), self.classes].astype(np.float64)
        return own - np.log(np.exp(z, out=z).sum(axis=1))


def bucket_number(text_bytes: int) -> int:
    """Buckets for so many bytes of training text."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (max(1, -(-text_bytes // BYTES_PER_BUCKET)) - 1).bit_length()))


def _blobs(kind: int, table: np.ndarray) -> pa.RecordBatch:
    """The slices of a table that hold anything."""
    slices = table.reshape(-1, SLICE * table.shape[1])
    at = np.flatnonzero(slices.any(axis=1))
    n = len(at)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(at), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int64)), pa.array([slices[k].astype(np.float32, copy=False).tobytes() for k in at.tolist()], pa.binary())], schema=_GATHERED)


_GATHERED = pa.schema([("kind", pa.int32()), ("word", pa.int64()), ("class", pa.int32()), ("n", pa.int64()), ("values", pa.binary())])
_GATHERED_SQL = "kind int, word long, class int, n long, values binary"


def add_counts(table: np.ndarray, keys: list[np.ndarray]) -> None:
    """Counts keys into a table, a part of it at a time."""
    keys = np.concatenate(keys)
    step = 1 << 21
    if len(table) <= step:
        table += np.bincount(keys, minlength=len(table)).astype(table.dtype)
        return
    keys.sort()
    cuts = np.searchsorted(keys, np.arange(0, len(table) + step, step))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = table[k * step : (k + 1) * step]
        part += np.bincount(keys[a:b] - np.int32(k * step), minlength=len(part)).astype(table.dtype)


def _gather(buckets: int):
    """Counts of words and of (feature, class) pairs in a task's training texts. kind 0: words, 1: pairs, 2: the ends."""

    def run(batches):
        yield from _gathered(batches, buckets)

    return run


def _gathered(batches, buckets: int):
    pairs, flat, held, texts = np.zeros(buckets * CLASSES, np.uint32), [], [], 0

    def merge(parts):
        key, n, of = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key, kind="stable")
        key, n, of = key[order], n[order], of[order]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key[heads], np.add.reduceat(n, heads), of[heads]

    def words_out(key, n, of):
        m = len(key)
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.array(key.view(np.int64)), pa.array(of.astype(np.int32)), pa.array(n), pa.nulls(m, pa.binary())], schema=_GATHERED)

    for batch in blocks(batches, size=TEXT_BYTES):
        c = Contexts(batch.column("text"), buckets)
        texts += batch.num_rows
        key, at, n = np.unique(c.word[c.is_word], return_index=True, return_counts=True)
        if len(key):
            held.append((key, n, c.classes[c.is_word][at]))
        flat.append((c.features * np.int32(CLASSES) + c.classes.astype(np.int32)).ravel())
        if sum(map(len, flat)) > 1 << 21:
            add_counts(pairs, flat)
            flat = []
        if len(held) > 15:
            held = [merge(held)]
            if len(held[0][0]) >= HELD:
                yield words_out(*held[0])
                held = []
    if texts:
        if held:
            yield words_out(*merge(held))
        if flat:
            add_counts(pairs, flat)
        yield _blobs(1, pairs.reshape(buckets, CLASSES))
        yield pa.RecordBatch.from_pylist([{"kind": 2, "word": 0, "class": 0, "n": texts, "values": None}], _GATHERED)


def add_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """table[at] += rows, where places repeat."""
    low = at.astype(np.uint16)  # numbers of 16 bits are sorted by their digits, in linear time
    order = np.argsort(low, kind="stable")
    if len(table) > 1 << 16:
        order = order[np.argsort((at[order] >> 16).astype(np.uint16), kind="stable")]
    at = at[order]
    heads = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    table[at[heads]] += np.add.reduceat(rows[order], heads, axis=0)


def _gradient(model):
    """The gradient of a task's log likelihood by each parameter. kind 1: slices of it, 3: the log likelihood itself."""

    def run(batches):
        theta, bias = model.value
        total, likelihood, seen = np.zeros(theta.shape, np.float32), 0.0, False
        for batch in blocks(batches, size=TEXT_BYTES):
            c = Contexts(batch.column("text"), len(theta))
            p = c.probabilities(theta, bias)
            own = np.arange(len(p)), c.classes
            likelihood += float(np.log(p[own].astype(np.float64)).sum())
            np.negative(p, out=p)
            p[own] += 1
            for feature in c.features:
                add_rows(total, feature, p)
            seen = True
        if seen:
            yield _blobs(1, total)
            yield pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), pa.array([0]), pa.array([0], pa.int32()), pa.array([0]), pa.array([np.float64(likelihood).tobytes()], pa.binary())], schema=_GATHERED)

    return run


def _sum_blobs(batches):
    """Adds up the slices of one number as they arrive."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column("word").to_pylist(), batch.column("values").to_pylist()):
            new = np.frombuffer(raw, np.float32)
            if k in sums:
                sums[k] += new
            else:
                sums[k] = new.astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], ["word", "values"])


def _collect_table(blobs: DataFrame, buckets: int) -> np.ndarray:
    """The sum over all tasks of a table, which has at most MOST_BUCKETS rows."""
    tasks = max(1, min(buckets // SLICE, parallelism(blobs.sparkSession)))
    table = np.zeros((buckets // SLICE, SLICE * CLASSES), np.float32)
    for r in blobs.filter("kind = 1").select("word", "values").repartition(tasks, "word").mapInArrow(_sum_blobs, "word long, values binary").toLocalIterator():
        table[r["word"]] = np.frombuffer(r["values"], np.float32)
    return table.reshape(buckets, CLASSES)


def first_update(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parameters and bias after the update from zero, where a context's expectation is its count times the classes' shares."""
    shares = (pairs.sum(axis=0, dtype=np.float64) / _FEATURES + 0.5) / (pairs.sum(dtype=np.float64) / _FEATURES + 0.5 * pairs.shape[1])
    shares = shares.astype(np.float32)
    theta = np.empty_like(pairs, np.float32)
    for k in range(0, len(pairs), 1 << 14):
        part = pairs[k : k + (1 << 14)].astype(np.float32)
        seen = part.sum(axis=1, keepdims=True)
        theta[k : k + len(part)] = FIRST_STEP * np.log((part + DAMPING * shares) / ((seen + DAMPING) * shares))
    return theta, np.log(shares)


def next_update(theta: np.ndarray, gradient: np.ndarray, pairs: np.ndarray, part: float, step: float) -> np.ndarray:
    """A gradient step from a `part` of the documents, scaled by each parameter's own curvature."""
    out = np.empty_like(theta)
    for k in range(0, len(pairs), 1 << 14):
        at = slice(k, k + (1 << 14))
        seen = pairs[at].sum(axis=1, keepdims=True)
        share = (pairs[at] + 0.5) / (seen + 0.5 * pairs.shape[1])
        out[at] = theta[at] + step * np.clip(gradient[at] / (part * seen * share * (1 - share) + DAMPING), -1, 1)
    return out


def log_likelihood(found: DataFrame) -> float:
    """Of the classes of all tokens that a table of gradients was made from."""
    return float(sum(np.frombuffer(r["values"])[0] for r in found.filter("kind = 3").select("values").collect()))


def few_tasks(df: DataFrame) -> DataFrame:
    """As many tasks as run at a time, each of which hands a whole table on: their tables don't grow with the input."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def train(training: DataFrame, pairs: np.ndarray, updates: int) -> tuple[np.ndarray, np.ndarray]:
    """Parameters and bias, after updates whose gradients are summed over all tasks."""
    spark = training.sparkSession
    theta, bias = first_update(pairs)
    for k in range(updates):
        model = spark.sparkContext.broadcast((theta, bias))
        own = training.filter(F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(5)), F.lit(updates)) == k)
        gradient = _collect_table(few_tasks(own).mapInArrow(_gradient(model), _GATHERED_SQL), len(pairs))
        theta = next_update(theta, gradient, pairs, 1 / updates, STEP / (k + 1) ** FALL)
        model.destroy()
    return theta, bias


_SCORED = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("counts", pa.float64()), ("ends", pa.float64()), ("classes", pa.float64()), ("word", pa.int64()), ("n", pa.int64())])
_SCORED_SQL = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, counts double, ends double, classes double, word long, n long"


def _score(model, log_sizes: np.ndarray, end_count: int):
    """A row for each text with the sums over its frequent words, and a row for each other word of it."""
    log10 = np.log(10.0)

    def run(batches):
        theta, bias, words, counts = model.value
        uid = TaskContext.get().partitionId() << 40
        for batch in blocks(batches, size=TEXT_BYTES):
            n = batch.num_rows
            c = Contexts(batch.column("text"), len(theta))
            p = c.log_own(theta, bias) / log10 - log_sizes[c.classes]
            key, back = np.unique(c.word[c.is_word], return_inverse=True)
            at = np.minimum(np.searchsorted(words, key), max(0, len(words) - 1))
            hit = words[at] == key if len(words) else np.zeros(len(key), bool)
            got = np.where(hit, counts[at], 0) if len(words) else np.zeros(len(key))
            value = np.where(hit, np.log10(got + 0.5), 0.0)
            of = c.text_of[c.is_word]
            sums = lambda x: np.bincount(of, x, n)
            known = sums(hit[back].astype(float)).astype(np.int64) + (end_count > 0)
            ids = uid + np.arange(n)
            uid += n
            yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(np.append(c.starts, len(c.word)))), pa.array(known), pa.array(sums(value[back])), pa.array(np.full(n, np.log10(end_count + 0.5))), pa.array(np.bincount(c.text_of, p, n)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=_SCORED)
            rare = np.flatnonzero(~hit[back])
            if len(rare):
                pair, times = np.unique(of[rare] * len(key) + back[rare], return_counts=True)
                m = len(pair)
                none = [pa.nulls(m, f.type) for f in _SCORED]
                none[0], none[8], none[9] = pa.array(ids[pair // len(key)]), pa.array(key[pair % len(key)].view(np.int64)), pa.array(times)
                yield pa.RecordBatch.from_arrays(none, schema=_SCORED)

    return run


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", updates: int = UPDATES, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A word's probability is that of its class (the end, or a hash of its first two bytes) in the context of the
    words before it, by the model, times its smoothed share of the class's training tokens; each class reserves
    the share of one more word for all words never seen. The model learns from every document that is not held
    out (one without an id is not): a first update from counts and `updates` more by gradients, which take
    every document once together, with steps that fall; its buckets grow with the training text up to MOST_BUCKETS, its word counts without
    a bound. Words are told apart by 64-bit hashes. A null text is empty: its end is its only token. Rows that
    repeat an id count and are scored each. Without training documents all counts are 0. No rows give no rows;
    other columns are not read.
    """
    spark = docs.sparkSession
    work = Work(spark, "maxent-lm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    training = rows.filter(~F.col("held_out")).select("text")
    buckets = bucket_number(training.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    gathered = work.table(few_tasks(training).mapInArrow(_gather(buckets), _GATHERED_SQL), "gathered")
    counts = work.table(gathered.filter("kind = 0").groupBy("word", "class").agg(F.sum("n").alias("n")), "counts")
    by_class = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    end_count = gathered.filter("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tokens = sum(r["n"] for r in by_class) + end_count
    vocabulary = sum(r["v"] for r in by_class) + (end_count > 0)
    sizes = np.full(CLASSES, 0.5)
    for r in by_class:
        sizes[r["class"]] = r["n"] + 0.5 * (r["v"] + 1)
    log_sizes = np.log10(sizes)
    log_sizes[0] = 0.0  # the end is its whole class

    pairs = _collect_table(gathered, buckets)
    theta, bias = train(training, pairs, updates)
    del pairs

    # the least count of which at most `frequent` words have that or more, by counts of counts on a fine scale
    scale = F.floor(F.log2("n") * 16).cast("int")
    steps, least, held = counts.groupBy(scale.alias("s")).count().orderBy(F.desc("s")).collect(), None, 0
    for r in steps:
        held += r["count"]
        if held > frequent:
            break
        least = r["s"]
    chosen = counts.filter(scale >= least).select("word", "n").toArrow() if least is not None else pa.table({"word": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    words, ns = chosen["word"].to_numpy().view(np.uint64), chosen["n"].to_numpy()
    order = np.argsort(words)
    model = spark.sparkContext.broadcast((theta, bias, words[order], ns[order]))
    scored = work.table(rows.mapInArrow(_score(model, log_sizes, end_count), _SCORED_SQL), "scored")
    looked_up = scored.filter("word IS NOT NULL").select("uid", "word", F.col("n").alias("times")).join(counts.select("word", "n"), "word", "left")
    rest = looked_up.groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"))
    out = scored.filter("word IS NULL").drop("word", "n").join(rest, "uid", "left")
    own = F.col("counts") + F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (own + F.col("ends") - F.col("n_tokens") * float(np.log10(tokens + 0.5 * (vocabulary + 1)))).alias("base_score"), (own + F.col("classes")).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
