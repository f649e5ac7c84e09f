"""Removal of repeated passages with phrase automata (operator 10)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlattice.llm.common import Work, Words, blocks, documents, inside, mix64, ngram_hashes, parallelism, salted_join

#: Words of a window, and of the phrases that propose windows.
WINDOW, PHRASE = 20, 8
#: Bits of the filter of recurring phrases: 16 for each, in 64 slices, this many at most (32 MB).
MAX_BITS, SLICES = 1 << 28, 64
#: Repeated texts that are sent to all executors at most (about 100 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1 << 18
#: Distinct phrases that a task holds before it hands its counts on.
HELD = 1 << 20


def _sliding(values: np.ndarray, n: int, least: bool) -> np.ndarray:
    """The least (or largest) of n values from each position on, by doubling."""
    pick = np.minimum if least else np.maximum
    out, width = values, 1
    while width * 2 <= n:
        out, width = pick(out[:-width], out[width:]), width * 2
    return pick(out[: len(out) - (n - width)], out[n - width :]) if n > width else out


class Phrases:
    """The phrases of a block of texts that winnowing selects: those with the least hash in some window.

    A window holds WINDOW - PHRASE + 1 phrases; equal windows select equal phrases wherever they stand, and each
    window selects one at least.
    """

    def __init__(self, texts: pa.Array, window: int, phrase: int):
        self.words = words = Words(texts)
        self.hashes = words.hashes()
        self.all = ngram_hashes(self.hashes, phrase)
        n = window - phrase + 1
        self.windows = inside(words.first, window, max(0, len(words) - window + 1))  # where a window of one text begins
        self.at = np.zeros(0, np.int64)
        if len(self.all) >= n and self.windows.any():
            least = np.where(self.windows, _sliding(self.all, n, True), np.uint64(0))
            edge = np.zeros(n - 1, np.uint64)
            self.at = np.flatnonzero((_sliding(np.concatenate([edge, least, edge]), n, False) == self.all) & (self.all > 0))

    def covering(self, at: np.ndarray, window: int, phrase: int) -> np.ndarray:
        """Where the windows begin that hold a phrase at one of these positions."""
        mark = np.zeros(len(self.windows) + 1, np.int32)
        if not len(self.windows):
            return np.zeros(0, np.int64)
        np.add.at(mark, np.clip(at - (window - phrase), 0, len(self.windows)), 1)
        np.add.at(mark, np.clip(at + 1, 0, len(self.windows)), -1)
        return np.flatnonzero((np.cumsum(mark[:-1]) > 0) & self.windows)


def _count_phrases(window: int, phrase: int):
    def run(batches):
        parts, held = [], 0

        def merged():
            key, n = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            return key[heads], np.minimum(2, np.add.reduceat(n, heads)).astype(np.int32)

        def out(key, n):
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["phrase", "n"])

        for batch in blocks(batches):
            p = Phrases(batch.column("text"), window, phrase)
            if len(p.at):
                parts.append(np.unique(p.all[p.at], return_counts=True))
            if len(parts) > 15:
                parts = [merged()]
                held = len(parts[0][0])
                if held >= HELD:
                    yield out(*parts[0])
                    parts = []
        if parts:
            yield out(*merged())

    return run


def _bits(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slice of each hash, and its two bits there; slices hold `width` bits.

    Winnowing keeps the least hashes, so their own high bits are mostly zero: all bits are taken from a mix of them.
    """
    spread = mix64(hashes ^ np.uint64(0x5851F42D4C957F2D))
    low = np.uint64(width - 1)
    return (spread >> np.uint64(58)).astype(np.int64), (spread & low).astype(np.int64), ((spread >> np.uint64(29)) & low).astype(np.int64)


def _dealt(batches):
    """Phrases with the slice that each belongs to."""
    for batch in batches:
        part, _, _ = _bits(batch.column(0).to_numpy().view(np.uint64), 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part.astype(np.int32))], ["phrase", "part"])


def _fill_slices(width: int):
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            part, one, two = _bits(batch.column(0).to_numpy().view(np.uint64), width)
            for k in np.unique(part).tolist():
                bits = held.setdefault(k, np.zeros(width, bool))
                bits[one[part == k]] = True
                bits[two[part == k]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], ["part", "bits"])

    return run


class PhraseFilter:
    """Which phrases may recur: never wrong about one that does."""

    def __init__(self, width: int, slices: dict[int, bytes]):
        self.width = width
        self.bits = np.zeros(SLICES * width // 8, np.uint8)
        for k, raw in slices.items():
            self.bits[k * width // 8 : (k + 1) * width // 8] = np.frombuffer(raw, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        part, one, two = _bits(hashes, self.width)
        bit = lambda x: (self.bits[(part * self.width + x) >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1
        return (bit(one) & bit(two)).astype(bool)


def automaton(symbols: np.ndarray, at: np.ndarray, phrase: int):
    """An Aho-Corasick automaton over words as symbols, of the phrases at these positions."""
    import ahocorasick

    made = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for k in at.tolist():
        made.add_word(as_string(symbols[k : k + phrase]))
    made.make_automaton()
    return made


def as_string(symbols: np.ndarray) -> str:
    """Numbers as characters, around the surrogates."""
    return (symbols + np.where(symbols >= 0xD800, 0x800, 0)).astype("<u4").tobytes().decode("utf-32-le")


def _locate(model, window: int, phrase: int):
    """For each document the windows that hold a recurring phrase, each occurrence located by an automaton."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("starts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("hashes", pa.list_(pa.list_(pa.int64())))])

    def run(batches):
        recurring = model.value
        for batch in blocks(batches):
            p = Phrases(batch.column("text"), window, phrase)
            words, n = p.words, batch.num_rows
            first = p.at[recurring.has(p.all[p.at])] if len(p.at) else p.at
            _, once = np.unique(p.all[first], return_index=True)
            begins = np.zeros(0, np.int64)
            if len(once):
                distinct, symbols = np.unique(p.hashes, return_inverse=True)
                shard = automaton(symbols + 1, first[once], phrase)  # of the phrases that this block can hold
                ends = np.fromiter((end for end, _ in shard.iter(as_string(symbols + 1))), np.int64)
                begins = p.covering(ends - (phrase - 1), window, phrase)
            spans = ngram_hashes(p.hashes, window)[begins].view(np.int64) if len(begins) else begins
            text_of = words.text_of[begins] if len(begins) else begins
            # runs: windows that begin one word after the other in one text
            heads = np.flatnonzero(np.append(True, (np.diff(begins) != 1) | (np.diff(text_of) != 0))) if len(begins) else begins
            lengths = np.diff(np.append(heads, len(begins)))
            cuts = np.searchsorted(text_of[heads], np.arange(n + 1)).astype(np.int32)
            listed = lambda values: pa.ListArray.from_arrays(pa.array(cuts), values)
            sha = [None if h else hashlib.sha256(b" ".join(words.raw(k))).hexdigest() for k, h in enumerate((np.diff(cuts) > 0).tolist())]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("digest"), pa.array(np.diff(words.first)), pa.array(sha, pa.string()),
                listed(pa.array((begins[heads] - words.first[text_of[heads]]).astype(np.int32))), listed(pa.array(lengths.astype(np.int32))),
                listed(pa.ListArray.from_arrays(pa.array(np.append(heads, len(begins)).astype(np.int32)), pa.array(spans, pa.int64()))),
            ], schema=schema)

    return run


def _remove(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def run(batches):
        for batch in blocks(batches):
            words, rows = Words(batch.column("text")), []
            for k, (doc_id, starts, lengths, stay) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "starts", "lengths", "stay")))):
                own = words.raw(k)
                mark = np.zeros(len(own) + window, np.int32)
                begins = np.concatenate([np.arange(a, a + n) for a, n in zip(starts, lengths)])
                gone = np.setdiff1d(begins, np.array(stay or [], np.int64))
                mark[gone] += 1
                mark[gone + window] -= 1
                removed = np.cumsum(mark)[: len(own)] > 0
                kept = b" ".join([w for w, r in zip(own, removed.tolist()) if not r])
                rows.append({"doc_id": doc_id, "n_words": len(own), "n_removed": int(removed.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept_text": kept.decode()})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _whole_copies(window: int):
    """Rows for texts that begin in an earlier document already: all words go, if they fill a window."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def run(batches):
        for batch in blocks(batches):
            words = Words(batch.column("text"))
            n = np.diff(words.first)
            kept = [None if m >= window else b" ".join(words.raw(k)) for k, m in enumerate(n.tolist())]
            sha = [hashlib.sha256(x or b"").hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(np.where(n >= window, n, 0)), pa.array(sha), pa.array(["" if x is None else None for x in kept], pa.string())], schema=schema)

    return run


def split_copies(rows: DataFrame, work: Work) -> tuple[DataFrame, DataFrame]:
    """The rows whose text no document with a smaller id has, and the others. Texts are told by their SHA-256."""
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    sha = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    groups = rows.groupBy(sha.alias("sha")).agg(F.min(key).alias("least"), F.max(key).alias("most")).filter("least < most").select("sha", "least")
    groups = work.table(groups, "copied")
    n = groups.count()
    if not n:
        return rows, rows.limit(0)
    hashed = rows.withColumn("sha", sha)
    known = hashed.join(F.broadcast(groups), "sha", "left") if n <= BROADCAST_ROWS else salted_join(hashed, groups, ["sha"], "left", F.col("doc_id"))
    later = F.col("least").isNotNull() & (F.col("least") < key)
    return known.filter(~later).select(*rows.columns), known.filter(later).select(*rows.columns)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, kept_text (null where all of the text stays).

    A window is `window` consecutive words of one document. Each word goes that a window covers whose words also
    begin earlier: in a document with a smaller id, or before in the same one. A text that a document with a smaller
    id has goes whole, and since all its windows begin there earlier, the others are judged without it. In these,
    phrases that recur anywhere propose windows: winnowing gives each window one of its phrases, counted over all documents; automata of the recurring
    ones, one for each block of documents, locate every occurrence there; the windows around them are grouped by
    their whole word sequence (a 64-bit hash of 64-bit word hashes), and all but the first of a group are removed.
    A null text has no words; a document of fewer words than a window stays. A null id comes before all others;
    windows at one start in rows that repeat an id count as one, so neither makes the other a repeat.
    No rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    work = Work(spark, "substring-dedup")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("digest", F.xxhash64("text"))
    rows, copies = split_copies(rows, work)
    counted = rows.select("text").mapInArrow(_count_phrases(window, phrase), "phrase long, n int")
    recurring = work.table(counted.groupBy("phrase").agg(F.sum("n").alias("n")).filter("n > 1").select("phrase"), "phrases")
    n = recurring.count()
    width = max(64, min(MAX_BITS, 1 << int(16 * max(1, n) - 1).bit_length()) // SLICES)
    tasks = max(1, min(SLICES, parallelism(spark)))
    filled = recurring.mapInArrow(_dealt, "phrase long, part int").repartition(tasks, "part").mapInArrow(_fill_slices(width), "part int, bits binary")
    slices: dict[int, bytes] = {}
    for r in filled.collect():  # SLICES slices of a bounded size, each from one task
        slices[r["part"]] = bytes(r["bits"])
    model = spark.sparkContext.broadcast(PhraseFilter(width, slices))
    located = work.table(rows.mapInArrow(_locate(model, window, phrase), "doc_id long, digest long, n_words long, kept_sha256 string, starts array<int>, lengths array<int>, hashes array<array<long>>"), "located")

    span = located.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("n_words").alias("words")).first()
    low, high = span.low or 0, span.high or 0
    bits = max(1, int(span.words or 0).bit_length())
    runs = located.select("doc_id", F.explode(F.arrays_zip("starts", "hashes")).alias("run"))
    windows = runs.select("doc_id", F.col("run.starts").alias("head"), F.posexplode("run.hashes").alias("k", "window")).select("doc_id", (F.col("head") + F.col("k")).alias("start"), "window")
    # `of` is a document as a key without nulls, and `place` orders windows by document and start
    if high - low + 2 < 1 << (62 - bits):
        of = F.coalesce(F.col("doc_id") - low + 1, F.lit(0)).cast("long")
        place = F.shiftleft(of, bits) + F.col("start")
        back = [F.shiftright("place", bits).alias("of"), F.col("place").bitwiseAND((1 << bits) - 1).cast("int").alias("start")]
    else:
        of = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
        place = F.struct("doc_id", "start")
        back = [F.coalesce(F.col("place.doc_id").cast("string"), F.lit("")).alias("of"), F.col("place.start").alias("start")]
    firsts = windows.select("window", place.alias("place")).groupBy("window").agg(F.min("place").alias("place")).select(*back)
    # dealt by document first: lists gathered before a shuffle would be many and short
    stay = firsts.repartition("of").groupBy("of").agg(F.collect_list("start").alias("stay"))  # at most the windows of one document
    touched = located.filter("size(starts) > 0").select(of.alias("of"), F.col("digest").alias("own_digest"), "starts", "lengths")
    if not touched.groupBy("of", "own_digest").count().filter("count > 1").isEmpty():
        touched = touched.dropDuplicates(["of", "own_digest"])  # rows that repeat an id and its text propose the same windows
    same = F.col("digest").bitwiseXOR(F.col("own_digest")) == 0  # no join key, so that the right side stays where it is
    cleaned = rows.withColumn("of", of).join(touched.join(stay, "of", "left"), "of").filter(same).select("doc_id", "text", "starts", "lengths", "stay")
    cleaned = cleaned.mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    whole = located.filter("size(starts) = 0").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept_text"))
    return cleaned.unionByName(whole).unionByName(copies.select("doc_id", "text").mapInArrow(_whole_copies(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept_text")
