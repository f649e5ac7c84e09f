import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factlattice.llm import exact_dedup, jaccard_join, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_exact_duplicates_against_brute_force(docs, empty, texts):
    groups = defaultdict(list)
    for doc_id, text, *_ in texts:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    expected = Counter()
    for norm, ids in groups.items():
        keep = min((x for x in ids if x is not None), default=None)
        for x in ids:
            expected[x, keep, len(ids), x == keep, hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in exact_dedup.exact_duplicates(docs).collect()) == expected
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_fingerprints_that_collide_are_parted_by_their_bytes(spark, monkeypatch, docs):
    from pyspark.sql import functions as F

    expected = sorted(map(tuple, exact_dedup.exact_duplicates(docs).collect()), key=str)
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    assert sorted(map(tuple, exact_dedup.exact_duplicates(docs).collect()), key=str) == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50), max_size=300), st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50), max_size=300))
def test_filters_round_trip_and_merge_without_loss(left, right):
    made = [exact_dedup.CountingQuotientFilter.build(*np.unique(np.array(x, np.uint64), return_counts=True)) for x in (left, right)]
    for one, values in zip(made, (left, right)):
        keys, counts = exact_dedup.CountingQuotientFilter.from_bytes(one.to_bytes()).items()
        assert dict(zip(keys.tolist(), counts.tolist())) == Counter(values)
    keys, counts = made[0].merge(made[1]).items()
    assert dict(zip(keys.tolist(), counts.tolist())) == Counter(left + right)
    assert (np.diff(keys.astype(object)) > 0).all() if len(keys) > 1 else True


def test_filters_of_many_tasks_and_ranges(spark):
    from pyspark.sql import functions as F

    values = spark.range(60_000, numPartitions=40).select((F.xxhash64(F.col("id") % 40_000)).alias("fingerprint"))
    got = exact_dedup.repeated_fingerprints(values, 7, flush=300)
    expected = spark.range(20_000).select(F.xxhash64("id").alias("fingerprint"))
    assert got.count() == 20_000 and got.subtract(expected).isEmpty()


def brute_links(rows, threshold=0.8):
    sets = []
    for doc_id, text, *_ in rows:
        w = WORD.findall(text or "")
        sets.append((doc_id, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])))
    parent = {x: x for x, _ in sets if x is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = [0] * len(sets)
    for i, (a, s) in enumerate(sets):
        for j in range(i):
            b, t = sets[j]
            if a is None or b is None or not s or not t:
                continue
            if len(s & t) >= threshold * len(s | t):
                links[i] += 1
                links[j] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return Counter((a, None if a is None else find(a), n) for (a, _), n in zip(sets, links))


def test_near_duplicates_against_brute_force(docs, empty, texts):
    got = jaccard_join.near_duplicates(docs).select("doc_id", "class_id", "n_links").collect()
    assert Counter(map(tuple, got)) == brute_links(texts)
    assert jaccard_join.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("members, words", [(8, 1 << 19), (256, 400)])
def test_groups_larger_than_a_cell(spark, monkeypatch, members, words):
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base[: k % 55], f"x{k}", *base[k % 55 + 1 :]])) for k in range(50)]
    monkeypatch.setattr(jaccard_join, "CELL", members)
    monkeypatch.setattr(jaccard_join, "CELL_WORDS", words)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard_join.near_duplicates(df).select("doc_id", "class_id", "n_links").collect())) == brute_links(rows)


def test_pruning_keeps_what_may_reach_the_threshold():
    needed = jaccard_join.least_matches()
    assert len(needed) == jaccard_join.HASHES // jaccard_join.STEP and (np.diff(needed) > 0).all()
    rng = np.random.default_rng(1)
    pairs = rng.random((20_000, jaccard_join.HASHES)) < 0.8
    seen = pairs.reshape(len(pairs), -1, jaccard_join.STEP).sum(axis=2).cumsum(axis=1)
    assert (seen < needed).any(axis=1).mean() < 1e-3
    unlike = (rng.random((20_000, jaccard_join.HASHES)) < 0.4).reshape(20_000, -1, jaccard_join.STEP).sum(axis=2).cumsum(axis=1)
    assert (unlike < needed).any(axis=1).mean() > 0.999


def test_connected_components_of_a_long_chain(spark):
    from factlattice.llm.common import Work

    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["id"]: r["root"] for r in jaccard_join.connected_components(edges, Work(spark, "test"), "chain").collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100}


def test_substring_dedup_against_brute_force(docs, empty, texts):
    seen, expected = {}, {}
    rows = [r for r in texts if r[0] != 3 and not (r[0] is None and r[1] == "no id here")] + [texts[3]]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for doc_id, text, *_ in ordered:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (doc_id, k)) != (doc_id, k):
                gone[k : k + 20] = [True] * 20
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        expected[doc_id] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = substring_dedup.remove_repeats(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        if not (r["doc_id"] is None and r["n_words"] == 3):
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == expected[r["doc_id"]], r["doc_id"]
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_winnowing_selects_a_phrase_of_every_window():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    texts = [" ".join(map(str, rng.integers(0, 5, n))) for n in (0, 5, 19, 20, 21, 300)]
    p = substring_dedup.Phrases(pa.array(texts), 20, 8)
    assert p.windows.sum() == sum(max(0, len(t.split()) - 19) for t in texts)
    assert set(p.covering(p.at, 20, 8)) == set(np.flatnonzero(p.windows))


def test_slices_of_the_phrase_filter_fill_evenly():
    rng = np.random.default_rng(3)
    least = rng.integers(0, 2**64, (13, 40_000), dtype=np.uint64).min(axis=0)  # as winnowing picks them
    part, one, two = substring_dedup._bits(least, 1 << 16)
    share = np.bincount(part, minlength=substring_dedup.SLICES) / len(least) * substring_dedup.SLICES
    assert 0.8 < share.min() and share.max() < 1.2
    assert abs(np.mean(one) / (1 << 15) - 1) < 0.02 and abs(np.mean(two) / (1 << 15) - 1) < 0.02
