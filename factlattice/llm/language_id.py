"""Language identification with string kernels (operator 7)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlattice.llm.common import blocks, documents

#: The sample that the classifier is fitted on: labelled documents of a language at most, those with the least hashes,
#: and windows of them. Windows and landmarks are shared out evenly over the languages, with at least so many of each.
PER_LANGUAGE = 400
FITTED_WINDOWS, LEAST_WINDOWS = 4_000, 24
LANDMARKS, LEAST_LANDMARKS = 256, 1
#: Spectra of 1 to N_MAX bytes share one hashed space; a long text is scored in windows of this many bytes.
N_MAX, SPACE, WINDOW = 4, 1 << 15, 2_048
RIDGE = 1e-2

_CASE = np.arange(256, dtype=np.uint32)
_CASE[65:91] += 32


def presence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row for each window of each text, 1 where an n-gram is present; and the text of each row.

    Windows overlap by N_MAX - 1 bytes, so that no n-gram of a text is left out.
    """
    spans = [(k, a, min(len(t), a + WINDOW + N_MAX - 1)) for k, t in enumerate(texts) for a in range(0, max(1, len(t) - N_MAX + 1), WINDOW)]
    rows = np.zeros((len(spans), SPACE), np.float32)
    for row, (k, a, b) in zip(rows, spans):
        raw = _CASE[np.frombuffer(texts[k], np.uint8)[a:b]]
        code = np.zeros(len(raw), np.uint32)
        for n in range(1, N_MAX + 1):
            if len(raw) < n:
                break
            code = code[: len(raw) - n + 1] * np.uint32(257) + raw[n - 1 :] + np.uint32(1)
            row[(code * np.uint32(2654435761)) >> np.uint32(17)] = 1
    return rows, np.array([k for k, _, _ in spans])


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Shared n-grams over the geometric mean of both counts."""
    size = lambda x: np.sqrt(np.maximum(1, x.sum(axis=1)))
    return rows @ landmarks.T / size(rows)[:, None] / size(landmarks)[None, :]


class Classifier:
    """One-versus-rest kernel ridge regression on Nyström features of the blended-spectrum presence kernel."""

    def __init__(self, windows: list[bytes], langs: list[str], seed: int = 7):
        """From windows of texts and their languages; of each language the first windows, in an order by `seed`, are landmarks."""
        self.langs = sorted(set(langs))
        order = np.random.Generator(np.random.PCG64(seed)).permutation(len(windows)).tolist()
        windows, langs = [windows[k] for k in order], [langs[k] for k in order]
        number = {x: k for k, x in enumerate(self.langs)}
        label = np.array([number[x] for x in langs])
        place = np.empty(len(label), np.int64)  # of a window among those of its language
        by = np.argsort(label, kind="stable")
        place[by] = np.arange(len(label)) - np.searchsorted(label[by], label[by])
        chosen = np.flatnonzero(place < max(LEAST_LANDMARKS, -(-LANDMARKS // len(self.langs))))
        landmarks = presence([windows[k] for k in chosen.tolist()])[0]
        between = kernel(landmarks, landmarks)
        values, vectors = np.linalg.eigh(between.astype(np.float64))
        keep = values > 1e-6 * values[-1]
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        features = np.concatenate([kernel(presence(windows[k : k + 200])[0], landmarks) @ whiten for k in range(0, len(windows), 200)])
        features = np.hstack([features, np.ones((len(features), 1))])
        target = np.where(label[:, None] == np.arange(len(self.langs))[None, :], 1.0, 0.0)
        share = np.bincount(label, minlength=len(self.langs))
        weight = (1.0 / share[label])[:, None] * len(label) / len(self.langs)
        solved = np.linalg.solve(features.T @ (features * weight) + RIDGE * np.eye(features.shape[1]), features.T @ (target * weight))
        # scores are linear in a row's presence: landmarks, whitening and regression make one matrix
        size = np.sqrt(np.maximum(1, landmarks.sum(axis=1)))
        self.matrix = np.ascontiguousarray(((landmarks / size[:, None]).T @ (whiten @ solved[:-1])).astype(np.float32))
        self.matrix = np.hstack([self.matrix, np.ones((SPACE, 1), np.float32)])  # the last product is a row's size
        self.bias = solved[-1]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """One row per text: the mean over its windows of the regression of each language."""
        total, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        step = 0
        while step < len(texts):
            upto, held = step, 0
            while upto < len(texts) and (held == 0 or held + len(texts[upto]) // WINDOW + 1 <= 64):
                held += len(texts[upto]) // WINDOW + 1
                upto += 1
            if upto == step + 1 and held > 64:  # one long text, in parts that overlap as windows do
                text = texts[step]
                parts = [text[a : a + 64 * WINDOW + N_MAX - 1] for a in range(0, max(1, len(text) - N_MAX + 1), 64 * WINDOW)]
            else:
                parts = None
            for part in parts or [None]:
                rows, owner = presence([part] if parts else texts[step:upto])
                product = rows @ self.matrix
                got = product[:, :-1] / np.sqrt(np.maximum(1, product[:, -1:])) + self.bias
                np.add.at(total, step + owner, got)
                np.add.at(count, step + owner, 1)
            step = upto
        return total / np.maximum(1, count)[:, None]


def _predict(model: Classifier | None, undetermined: str):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in blocks(batches):
            texts = [t.encode() if t else b"" for t in batch.column("text").to_pylist()]
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            lang, score = [undetermined] * len(texts), np.zeros(len(texts))
            if model is not None and letters.any():
                at = np.flatnonzero(letters)
                got = model.scores([texts[k] for k in at])
                for k, best in zip(at.tolist(), got.argmax(axis=1).tolist()):
                    lang[k] = model.langs[best]
                score[at] = np.clip(got.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], schema=schema)

    return run


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Classifier | None:
    """A classifier from (text, lang, doc_id), of every language that occurs.

    It is fitted on windows of `per_language` documents of each language, those with the least hashes; counts of
    languages bound the hashes first, so that only about twice that many rows are sorted. Windows are cut on the
    executors; LEAST_WINDOWS or more of each language come to the driver, a share of FITTED_WINDOWS where that is more.
    """
    with_letters = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = [(r["lang"], min(1.0, (2.0 * per_language + 50.0) / r["count"])) for r in with_letters.groupBy("lang").count().collect()]
    if not counts:
        return None
    shares = F.broadcast(docs.sparkSession.createDataFrame(counts, "lang string, share double"))
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = with_letters.withColumn("u", u).join(shares, "lang").filter("u <= share").drop("share")
    best = Window.partitionBy("lang").orderBy("u", "doc_id")
    sample = near.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= per_language)
    raw = F.col("text").cast("binary")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.octet_length(raw) - N_MAX), F.lit(WINDOW))
    cut = sample.select("lang", "u", F.posexplode(F.transform(starts, lambda a: F.substring(raw, a + 1, F.lit(WINDOW)))).alias("k", "window"))
    n = max(LEAST_WINDOWS, -(-FITTED_WINDOWS // len(counts)))
    best = Window.partitionBy("lang").orderBy(F.xxhash64("u", "k"), "window")
    windows = cut.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n).select("lang", "window").collect()
    windows = sorted((r["lang"], bytes(r["window"])) for r in windows)
    return Classifier([w for _, w in windows], [lang for lang, _ in windows])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", undetermined: str = "und") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Learned from documents that are not held out and have a language; a document without an id is not held out.
    Windows of the whole text are scored and averaged; the score is the regression's value, between 0 and 1.
    A text that is null or has no letters is `und` with score 0, and so is every text if no language is learned.
    Rows that repeat an id are predicted each. No rows give no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(rows.filter(~F.col("held_out")))
    asked = rows.select("doc_id", "held_out", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return asked.mapInArrow(_predict(model, undetermined), "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
