import base64
import gzip
import hashlib
import io
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlattice.llm import permutation_index, sharding, warc


def test_warc_round_trip(spark):
    pages = [(1, "http://a", "x"), (2, "http://b\r\nEvil: 1", "x"), (3, None, None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n"), (6, "u", "y" * 3_000_000), (7, "u", "x"), (7, "u", "x"), (None, "u", "x"), (None, "u", "z")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha1", F.lit("clash")).withColumn("bytes", F.lit(1)).repartition(3)
    groups = defaultdict(list)
    for page_id, _, html in pages:
        if page_id is not None:
            groups[html or ""].append(page_id)
    expected = []
    for page_id, _, html in pages:
        raw = (html or "").encode()
        top = max(groups[html or ""], default=None)
        revisit = top is not None and page_id != top
        expected.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    got = warc.round_trip(df).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(expected, key=str)
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"}[5] == pages[4][2]
    assert all("\n" not in (r["url"] or "") for r in got)
    assert warc.round_trip(df.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.round_trip(df, min_payload_bytes=2).collect() if r["payload_bytes"] == 1} == {"response"}


def test_normaliser_makes_a_member_of_each_record_and_stops_at_faults():
    records = [warc.record_head(k, "u", "response", "D", 3, None) + b"abc\r\n\r\n" for k in range(5)]
    for whole in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        sink = io.BytesIO()
        index, faults = warc.normalise_stream(io.BytesIO(whole), sink)
        assert faults == 0 and [r[3] for r in index] == [f"<urn:page:{k}>" for k in range(5)]
        assert [gzip.decompress(sink.getvalue()[a : a + n]) for a, n, *_ in index] == records
    for broken, n in ((gzip.compress(b"".join(records)[:-9]), 4), (gzip.compress(b"".join(records[:2]) + b"junk\r\n\r\n"), 2)):
        index, faults = warc.normalise_stream(io.BytesIO(broken), io.BytesIO())
        assert (len(index), faults) == (n, 1)


def test_archives_that_break_off_are_told(spark):
    whole = gzip.compress(b"".join(warc.record_head(k, "u", "response", "D", 3, None) + b"abc\r\n\r\n" for k in range(50)))
    for broken in (whole[:60], whole[:40] + b"\0" * 40, gzip.compress(b"x" * (3 * warc.HEAD_BYTES))):
        index, faults = warc.normalise_stream(io.BytesIO(broken), io.BytesIO())
        assert len(index) < 50 and faults == 1
    written = spark.createDataFrame([("a", 5), ("b", 7)], "archive string, records long")
    warc.check_whole(written, spark.createDataFrame([(12, 0)], "records long, faults long"))
    for told in ((11, 0), (12, 1)):
        with pytest.raises(ValueError, match="12 records"):
            warc.check_whole(written, spark.createDataFrame([told], "records long, faults long"))


def brute(rows, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 8]
    out = {}
    for q, x in fine:
        if q % 20 == 0:
            scores = sorted((-float((x * y).sum()), i) for i, y in fine if i != q)[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


def neighbours(df, is_query, **more):
    got = defaultdict(list)
    for r in permutation_index.nearest(df, is_query, **more).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_odd_vectors_ties_and_repeated_ids(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist()) for k in range(300)]
    rows += [(k, rows[5][1]) for k in range(300, 330)]
    rows += [(340, None), (360, [0.0] * 8), (380, [1.0, None] + [0.0] * 6), (400, [float("nan")] * 8), (420, [float("inf")] * 8), (440, [1.0] * 3), (None, [1.0] * 8)]
    rows += [(460, [1.0] * 3000), (7, rows[7][1]), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    expected = brute(rows, 20)
    for blocks in (2_048, 40):  # ties lie in one block, or in several
        monkeypatch.setattr(permutation_index, "LEAST_BLOCK", blocks)
        got = neighbours(df, F.col("vec_id") % 20 == 0, rerank=1.0)
        assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in expected.items()}
        assert all(np.allclose([s for _, s in got[q]], [s for _, s in v]) for q, v in expected.items())
    assert permutation_index.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert len(neighbours(df.filter("vec_id < 4"), F.col("vec_id") == 0)[0]) == 3
    other = spark.createDataFrame([*rows, (20, [0.5] * 8)], "vec_id long, embedding array<float>")
    assert len(neighbours(other, F.col("vec_id") == 20, rerank=1.0)[20]) == 20


def recall(got, x, asked):
    scores = x[asked].astype(float) @ x.T.astype(float)
    scores[np.arange(len(asked)), asked] = -9
    return sum(len({i for i, _ in got[q]} & set(row[:20].tolist())) for q, row in zip(asked, np.argsort(-scores, axis=1))) / 20 / len(asked)


def test_recall_at_the_settings_of_the_query(spark):
    """On vectors without structure, on those of a table, and beside many copies of one vector."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    copies = x.copy()
    copies[2000:4000] = x[3]
    copies[4001:4600] = x[3] + 0.3 * x[4001:4600]
    table = np.array([r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()])
    for vectors in (x, table):
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
        assert recall(neighbours(df, F.col("vec_id") % 20 == 0), vectors, list(range(0, len(vectors), 20))) >= 0.95
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(copies)], "vec_id long, embedding array<float>")
    asked = [k for k in range(0, 6000, 20) if not 2000 <= k < 4600]
    assert recall(neighbours(df, F.col("vec_id") % 20 == 0), copies, asked) >= 0.9


def test_shards_slots_and_growth(spark, docs, empty, texts):
    import zlib

    rows = sharding.shard_documents(docs, 40).collect()
    assert len(rows) == len(texts)
    sizes = {}
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 40)
        sizes[r["doc_id"], r["size"], r["text_crc32"]] = True
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(sizes) == {(a, len((b or "").encode()) + 16, zlib.crc32((b or "").encode())) for a, b, *_ in texts}
    assert sharding.shard_documents(empty, 40).count() == 0


def test_slots_over_several_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_CELL", 5)
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    slots = defaultdict(list)
    for r in sharding.shard_documents(df, 7).collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(slots) == 7


def brute_place(node, key, path=0xA0761D6478BD642F):
    """One key's way down, draw by draw."""
    low = 2**64 - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & low
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & low
        return x ^ (x >> 31)

    weight = lambda n: sum(map(weight, n)) if isinstance(n, list) else n
    way = []
    while isinstance(node, list):
        paths = [mix((path + k + 1) & low) for k in range(len(node))]
        draws = [-math.log(((mix(key ^ p) >> 11) + 0.5) / 2**53) / weight(c) if weight(c) > 0 else math.inf for p, c in zip(paths, node)]
        k = draws.index(min(draws))
        way.append(k)
        node, path = node[k], paths[k]
    return way


def test_keys_descend_by_their_own_draws():
    tree = sharding.Tree.of([1.0, 2.0, 0.0, 1.5] * 5)
    flat, ways = 0, {}
    for region, racks in enumerate(tree.nodes):
        for rack, shards in enumerate(racks):
            for shard in range(len(shards)):
                ways[region, rack, shard] = flat
                flat += 1
    keys = np.random.default_rng(4).integers(0, 2**63, 2_000).astype(np.uint64)
    assert tree.place(keys).tolist() == [ways[tuple(brute_place(tree.nodes, int(k)))] for k in keys]
    assert sharding.Tree([1.0, [2.0, [1.0, 3.0]]]).place(keys).max() == 3


def test_keys_move_only_into_what_gained():
    keys = np.random.default_rng(3).integers(0, 2**63, 40_000).astype(np.uint64)
    base = sharding.Tree.of([1.0] * 40)
    was = base.place(keys)
    assert np.abs(np.bincount(was, minlength=40) / len(keys) - 1 / 40).max() < 0.01
    now = base.grown().place(keys)
    assert set(now[now != was]) == {40} and abs((now == 40).mean() - 1 / 41) < 0.01
    again = base.grown().grown(2.0).place(keys)
    assert set(again[again != now]) == {41}
    more = sharding.Tree.of([1.0] * 9 + [2.5] + [1.0] * 30).place(keys)  # shard 9: rack 2, region 1
    assert set(more[more != was]) <= set(range(8, 16)) and abs((more == 9).mean() - 2.5 / 41.5) < 0.01
    stayed = (was // 4 == 2) & (more // 4 == 2) & (more != was)
    assert set(more[stayed]) == {9}
    less = sharding.Tree.of([1.0] * 9 + [0.0] + [1.0] * 30).place(keys)
    assert not (less == 9).any() and set(was[less != was]) <= set(range(8, 16))
