"""Packing of token sequences by Karmarkar-Karp multiway differencing (operator 6)."""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlattice.llm.common import Work, blocks, documents

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
CAPACITY = 4096
#: What is left of a document after its full windows is cut into pieces of at most this length.
PIECE = 1024
#: Pieces that are partitioned together.
GROUP = 512
#: Bytes of words and their ids that a worker keeps, about; beyond them the half that is older goes.
CACHED_BYTES = 160 << 20
#: What an entry of the cache takes beside its word and ids.
ENTRY_BYTES = 200

#: The normaliser and pre-tokeniser of the tokenizers whose words are encoded one by one. Fixed values.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Recent(dict):
    """A dictionary of bounded size that makes what it lacks; as it fills up it becomes `old`, from which what is asked again returns."""

    def __init__(self, make, size: int):
        self.make, self.size, self.held, self.old = make, size // 2, 0, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        self[key] = got
        self.held += len(key) + len(got) + ENTRY_BYTES
        return got

    def trim(self) -> None:
        if self.held > self.size:
            self.old, self.held = dict(self), 0
            self.clear()


class WordTokenizer:
    """Ids of whole texts, equal to encode(text, add_special_tokens=False), for any tokenizer file.

    If the file's normaliser and pre-tokenizer are those of WORDWISE, which never look across white space, words
    that consist of printable ASCII and Latin-1 letters are encoded once and kept. A text with anything else that
    the normaliser might treat by context (other scripts, combining marks, unusual spaces, special tokens) is
    encoded whole, as are all texts under other tokenizers.
    """

    def __init__(self, path: str, cached_bytes: int = CACHED_BYTES):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.wordwise = all(told.get(k) == v for k, v in WORDWISE.items()) and told["model"]["type"] == "BPE" and not told["model"].get("dropout")
        self.wordwise &= all(t["content"].startswith("<|") for t in told.get("added_tokens", []))
        self.words = Recent(self._word, cached_bytes)
        self.plain = regex.compile(r"[\t\n\v\f\r -~\xA1-\xFF]*+").fullmatch
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.bytes_as = {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}

    def _ids(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.bytes_as)
        ids = [t.id for t in self.model.tokenize(shown)]
        return pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self._ids(word)
        if word[:-1].isalpha() and not word[-1].isalnum():
            return self.words[word[:-1]] + self.words[word[-1]]
        pieces = self.pieces(word)
        return b"".join(map(self.words.__getitem__, pieces)) if len(pieces) != 1 else self._ids(pieces[0])

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if not self.wordwise or not self.plain(text) or "<|" in text:
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return pack(f"<{len(ids)}I", *ids)
        self.words.trim()
        return b"".join(map(self.words.__getitem__, text.lower().split()))


_LOADED: dict[str, WordTokenizer] = {}


def loaded(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a worker."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def cut(n: int, capacity: int, piece: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full windows first, then near-equal pieces of the rest."""
    start = n - n % capacity
    for k in range(0, start, capacity):
        yield k, capacity
    rest = n - start
    parts = -(-rest // piece)
    for k in range(parts):
        a, b = rest * k // parts, rest * (k + 1) // parts
        yield start + a, b - a


def _tokenise(path: str, capacity: int, piece: int, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches):
        encode, end = loaded(path).encode, pack("<I", end_id)
        for batch in blocks(batches):
            rows = ([], [], [], [], [])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                raw = encode(text or "") + end
                n = len(raw) // 4
                for start, length in cut(n, capacity, piece):
                    for column, value in zip(rows, (doc_id, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], schema=schema)

    return run


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window (0 to windows - 1) of each size, by the multiway differencing of Karmarkar and Karp.

    Each size begins as a partial partition with all else empty. The two partial partitions with the largest
    spread merge until one is left: the fullest window of one joins the emptiest of the other. Ties go to the
    partition made first.
    """
    n = len(sizes)
    left, right = [-1] * n, [-1] * n  # merged bundles of sizes, as a binary forest
    heap = []
    for k, size in enumerate(sizes.tolist()):
        sums, held = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], held[0] = size, k
        heap.append((-size, k, sums, held))
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums, low = a + b[::-1], y[::-1]
        held = np.where(x < 0, low, x)
        both = np.flatnonzero((x >= 0) & (low >= 0))
        held[both] = np.arange(len(left), len(left) + len(both))
        left += x[both].tolist()
        right += low[both].tolist()
        order = np.argsort(-sums, kind="stable")
        sums, held = sums[order], held[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), made, sums, held))
        made += 1
    window = np.zeros(n, np.int64)
    if heap:
        stack = [(bundle, k) for k, bundle in enumerate(heap[0][3].tolist()) if bundle >= 0]
        while stack:
            bundle, k = stack.pop()
            if bundle < n:
                window[bundle] = k
            else:
                stack += [(left[bundle], k), (right[bundle], k)]
    return window


def near_equal_windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A window for each size, as few as differencing can fill without exceeding the capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(sizes, windows)
        if np.bincount(window, sizes, windows).max(initial=0) <= capacity:
            return window
        windows += 1


def _pack(capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def groups(batches):
        held = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            group = table.column("packed_with").to_numpy()
            last = int(np.searchsorted(group, group[-1]))
            cuts = [0, *(np.flatnonzero(np.diff(group[:last])) + 1).tolist()] if last else []
            for a, b in zip(cuts, [*cuts[1:], last]):
                yield table.slice(a, b - a)
            held = table.slice(last).to_batches()
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        for table in groups(b for b in batches if b.num_rows):
            sizes = table.column("length").to_numpy()
            window = near_equal_windows(sizes, capacity)
            order = np.argsort(window, kind="stable")
            before = np.cumsum(sizes[order]) - sizes[order]
            window = window[order]
            head = np.searchsorted(window, window)
            taken = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).take(pa.array(order)).combine_chunks()
            sequence = (table.column("packed_with")[0].as_py() << 20) + window
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in taken.columns), pa.array(sequence), pa.array(before - before[head])], schema=schema)

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids and an end id are cut into full windows, which make sequences of their own, and pieces of
    at most `piece` ids; about `group` pieces, chosen by a hash, are differenced into near-equal windows at a time.
    A null text is empty: its end id alone is a piece. Strings of special tokens in a text count as these tokens.
    Documents that repeat an id, or have none, are packed each. No rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    work = Work(spark, "packing")
    pieces = work.table(rows.mapInArrow(_tokenise(tokenizer or tokenizer_path(TOKENIZER), capacity, piece, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    n = pieces.agg(F.count_if(F.col("length") < capacity)).first()[0]
    groups = max(1, round(n / group))
    whole = F.col("length") == capacity
    # full windows need no partner: each is a sequence, with a negative number made from its row's place in the table
    full = pieces.filter(whole).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    full = work.table(full, "full")
    rest = pieces.filter(~whole).withColumn("packed_with", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    tasks = max(1, min(groups, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    packed = rest.repartition(tasks, "packed_with").sortWithinPartitions("packed_with", "doc_id", "start", "ids_crc32").mapInArrow(_pack(capacity), full.schema.simpleString()[7:-1].replace(":", " "))
    return packed.unionByName(full)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
