import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlattice.llm import language_id, maxent_lm, mixing, packing

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_of_odd_rows(docs, empty, texts):
    got = language_id.identify(docs).collect()
    assert len(got) == len(texts)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[k]["lang_pred"] == "und" for k in (100, 101, 102, 103, 105))
    assert by_id[104]["lang_pred"] in ("aa", "bb")
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert language_id.identify(empty).count() == 0
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_scores_are_those_of_kernel_ridge_regression():
    """Against the dual form, with every window a landmark and kernels of sets of n-grams."""
    rng = np.random.default_rng(6)
    windows = [bytes(rng.choice(np.frombuffer(a, np.uint8), 60)) for a in (b"abcde ", b"cdefg ", b"efghi ") for _ in range(12)]
    langs = [x for x in ("a", "c", "e") for _ in range(12)]
    model = language_id.Classifier(windows, langs)
    code = lambda w: {int(x) for x in np.flatnonzero(language_id.presence([w])[0][0])}
    sets = [code(w) for w in windows]
    k = lambda s, t: len(s & t) / math.sqrt(len(s) * len(t))
    gram = np.array([[k(s, t) for t in sets] for s in sets])
    # primal on whitened features equals the dual with a bias as one more, unit feature
    target = np.array([[float(x == y) for y in "ace"] for x in langs])
    dual = np.linalg.solve(gram + 1 + language_id.RIDGE * np.eye(len(gram)), target)
    asked = [bytes(rng.choice(np.frombuffer(b"bcdefgh ", np.uint8), 60)) for _ in range(10)]
    expected = np.array([[k(code(w), s) + 1 for s in sets] for w in asked]) @ dual
    assert np.allclose(model.scores(asked), expected, atol=2e-3)


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(7)
    rows, k = [], 0
    for lang in range(200):
        letters = rng.permutation([chr(97 + x) for x in range(26)])[:8]
        for _ in range(4 if lang else 400):
            rows.append((k, " ".join("".join(rng.choice(letters, 5)) for _ in range(60)), f"l{lang:03}"))
            k += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    learned = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2}
    assert len({r["lang_pred"] for r in got}) >= 0.97 * len(learned)
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.9


def test_windows_cover_every_ngram():
    text = bytes(np.random.default_rng(0).integers(97, 123, 5000).astype(np.uint8))
    rows, _ = language_id.presence([text])
    one = language_id.WINDOW
    language_id.WINDOW = 1 << 20
    try:
        whole, _ = language_id.presence([text])
    finally:
        language_id.WINDOW = one
    assert (rows.max(axis=0) == whole[0]).all() and len(rows) == 3


@pytest.mark.parametrize("frequent", [1 << 20, 50])
def test_lm_base_against_brute_force(docs, empty, texts, frequent):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    rows = [(a, [*WORD.findall(low(b or "")), None], a is not None and zlib.crc32(str(a).encode()) % 5 == 1) for a, b, *_ in texts]
    counts = Counter(w for _, t, held in rows if not held for w in t)
    n, v = sum(counts.values()), len(counts)
    expected = Counter((a, held, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for a, t, held in rows)
    got = maxent_lm.score_documents(docs, frequent=frequent).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expected
    assert all(r["score"] < 0 for r in got)
    if frequent == 50:
        assert maxent_lm.score_documents(empty).count() == 0


def test_lm_beats_its_base_on_held_out_documents(spark):
    rows = maxent_lm.score_documents(spark.read.parquet(f"{SF}/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_class_probabilities_sum_to_one():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    theta = rng.normal(size=(maxent_lm.LEAST_BUCKETS, maxent_lm.CLASSES)).astype(np.float32)
    c = maxent_lm.Contexts(pa.array(["a b c", "", "d", None]), maxent_lm.LEAST_BUCKETS)
    p = c.probabilities(theta, np.zeros(maxent_lm.CLASSES, np.float32))
    assert p.shape == (8, maxent_lm.CLASSES) and np.allclose(p.sum(axis=1), 1, atol=1e-5)
    assert np.allclose(np.log(p[np.arange(8), c.classes]), c.log_own(theta, np.zeros(maxent_lm.CLASSES, np.float32)), atol=1e-4)
    assert c.classes[[3, 4, 6, 7]].tolist() == [0, 0, 0, 0]


def test_updates_raise_the_likelihood(spark):
    """One by all documents, or two or three by a share of them each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    buckets = 1 << 15
    gathered = docs.mapInArrow(maxent_lm._gather(buckets), maxent_lm._GATHERED_SQL).cache()
    pairs = maxent_lm._collect_table(gathered, buckets)
    tokens = sum(len(WORD.findall(r["text"] or "")) + 1 for r in docs.collect())
    assert pairs.sum() == 3 * tokens
    told = []
    for updates in range(4):
        model = spark.sparkContext.broadcast(maxent_lm.train(docs, pairs, updates))
        told.append(maxent_lm.log_likelihood(docs.mapInArrow(maxent_lm._gradient(model), maxent_lm._GATHERED_SQL)))
    shares = pairs.sum(axis=0) / pairs.sum()
    assert told[0] > tokens * float((shares * np.log(shares)).sum()) and min(told[1:]) > told[0]


def test_counts_of_a_large_table():
    rng = np.random.default_rng(9)
    keys = [rng.integers(0, 5 << 20, 1000).astype(np.int32) for _ in range(3)]
    table = np.zeros(5 << 20, np.uint32)
    maxent_lm.add_counts(table, list(keys))
    assert (table == np.bincount(np.concatenate(keys), minlength=5 << 20)).all()


def test_gradients_and_scores_against_plain_loops():
    """The gradient against differences of the likelihood, and a text's classes against a softmax by hand."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    texts = pa.array(["a b a c", "", "b b", None, "the cat the"])
    buckets = maxent_lm.LEAST_BUCKETS
    theta, bias = rng.normal(size=(buckets, maxent_lm.CLASSES)).astype(np.float32), rng.normal(size=maxent_lm.CLASSES).astype(np.float32)
    c = maxent_lm.Contexts(texts, buckets)

    def plain(theta):
        total = []
        for own, features in zip(c.classes.tolist(), c.features.T.tolist()):
            z = [float(bias[k]) + sum(float(theta[f, k]) for f in features) for k in range(maxent_lm.CLASSES)]
            total.append(z[own] - math.log(sum(math.exp(x) for x in z)))
        return total

    assert np.allclose(c.log_own(theta, bias), plain(theta), atol=1e-4)

    class Held:
        value = theta, bias

    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    out = list(maxent_lm._gradient(Held)([batch]))
    table = np.zeros((buckets // maxent_lm.SLICE, maxent_lm.SLICE * maxent_lm.CLASSES), np.float32)
    for at, raw in zip(out[0].column("word").to_pylist(), out[0].column("values").to_pylist()):
        table[at] = np.frombuffer(raw, np.float32)
    table = table.reshape(buckets, maxent_lm.CLASSES)
    assert np.isclose(np.frombuffer(out[1].column("values")[0].as_py())[0], sum(plain(theta)), rtol=1e-5)
    for f, k in [(int(c.features[0, 1]), 3), (int(c.features[1, 2]), int(c.classes[2])), (int(c.features[2, 0]), 7)]:
        up = theta.astype(np.float64)
        up[f, k] += 1e-4
        assert abs((sum(plain(up)) - sum(plain(theta.astype(np.float64)))) / 1e-4 - table[f, k]) < 1e-2


def brute_rake(cells, tokens, targets, budget, rounds=3000):
    """The same by plain loops: goals by bisection of a level, probabilities by alternate scaling and cutting."""
    chance = [budget / sum(tokens)] * len(cells)
    goals = []
    for axis, target in enumerate(targets):
        have = [sum(n for c, n in zip(cells, tokens) if c[axis] == v) for v in range(len(target))]
        low, high = 0.0, 1e12
        for _ in range(300):
            level = (low + high) / 2
            low, high = (level, high) if sum(min(h, level * g) for h, g in zip(have, target) if h and g) < budget else (low, level)
        goals.append([min(h, high * g) if h and g else 0.0 for h, g in zip(have, target)])
    for _ in range(rounds):
        for axis, goal in enumerate(goals):
            now = [sum(p * n for c, n, p in zip(cells, tokens, chance) if c[axis] == v) for v in range(len(goal))]
            chance = [min(1.0, p * goal[c[axis]] / now[c[axis]]) if now[c[axis]] else 0.0 for c, p in zip(cells, chance)]
    return chance, goals


@pytest.mark.parametrize("fraction, strong", [(0.2, 1.0), (0.6, 1.0), (0.7, 20.0), (0.95, 1.0)])
def test_raking_meets_all_marginals_below_one(fraction, strong):
    rng = np.random.default_rng(4)
    cells = np.array([(i, j, k) for i in range(4) for j in range(3) for k in range(2)])
    tokens = rng.integers(1, 1000, len(cells)).astype(float)
    targets = [0.5 + rng.random(n) for n in (4, 3, 2)]
    targets[0][1] *= strong  # with 20, more than this value has
    budget = fraction * tokens.sum()
    chance, goals = mixing.rake(cells, tokens, targets, budget)
    plain, goal = brute_rake([tuple(c) for c in cells.tolist()], tokens.tolist(), [t.tolist() for t in targets], budget)
    assert all(np.allclose(g, h, rtol=1e-6) for g, h in zip(goals, goal))
    assert (chance <= 1).all() and np.allclose(chance, plain, atol=1e-3)
    if fraction < 0.7:
        for axis, g in enumerate(goals):
            assert np.allclose(np.bincount(cells[:, axis], chance * tokens), g, rtol=1e-3)
        assert np.isclose((chance * tokens).sum(), budget, rtol=1e-6)


def test_mixing_draws_near_its_targets(spark, docs, empty, texts):
    many = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    goal = {f"src{k}": 1.0 for k in range(10)}
    told = mixing.shares(mixing.mix(many, mixing.form_topic(F.col("text")), fraction=0.2, targets={"source": goal})).collect()
    assert {r["value"] for r in told if r["axis"] == "source" and r["drawn"] > 0} == set(goal)
    assert all(abs(r["expected"] - r["target"]) < 1e-6 and abs(r["drawn"] - r["target"]) < 0.03 for r in told)
    assert all(abs(r["target"] - 0.1) < 1e-9 for r in told if r["value"] in goal)
    whole = mixing.shares(mixing.mix(many, mixing.form_topic(F.col("text")))).collect()
    assert all(abs(r["expected"] - r["target"]) < 1e-3 for r in whole)
    odd = mixing.mix(docs, mixing.form_topic(F.col("text")), fraction=1.0).collect()
    assert len(odd) == len(texts) and all(r["tokens"] >= 1 and r["drawn"] for r in odd)
    topics = {r["doc_id"]: r["topic"] for r in odd}
    assert topics[101] == "(none)" and topics[100] == topics[103] == "short"
    part = mixing.mix(docs, mixing.form_topic(F.col("text")), fraction=0.5).collect()
    assert len(part) == len(texts) and {"(none)"} < {r["source"] for r in part} and {"(none)"} < {r["lang"] for r in part}
    assert all(r["probability"] > 0 for r in part if r["source"] == "(none)" or r["lang"] == "(none)")
    assert mixing.mix(empty, mixing.form_topic(F.col("text"))).count() == 0


@pytest.mark.parametrize("held", [1 << 17, 0])
def test_mixing_rakes_every_source_to_its_own_share(spark, monkeypatch, held):
    monkeypatch.setattr(mixing, "CELLS", held)
    sizes = {f"s{k:03}": 1 + k % 7 for k in range(200)}
    many = spark.createDataFrame([(k, "w " * n, "aa", s) for k, (s, n) in enumerate(sizes.items())], "doc_id long, text string, lang string, source string")
    got = mixing.mix(many, F.lit("t"), fraction=0.3).collect()
    total, roots = sum(sizes.values()), sum(n**0.5 for n in sizes.values())
    assert len(got) == len(sizes)
    for r in got:
        share = sizes[r["source"]] ** 0.5 / roots
        assert abs(r["source_target"] - share) < 1e-9 and abs(r["probability"] * r["tokens"] / total / 0.3 - share) < 1e-8


def test_mixing_as_a_table_equals_mixing_in_the_driver(spark, monkeypatch, docs, texts):
    found = []
    monkeypatch.setattr(mixing, "ROUNDS", 2)
    for held in (1 << 17, 0):
        monkeypatch.setattr(mixing, "CELLS", held)
        rows = mixing.mix(docs, mixing.form_topic(F.col("text")), fraction=0.4, targets={"source": {"s0": 2.0, "s1": 1.0, "absent": 5.0}}).collect()
        found.append(sorted((*(str(r[c]) for c in ("doc_id", "source", "lang", "topic", "tokens")), r["probability"], r["source_target"], r["topic_target"]) for r in rows))
    assert len(found[0]) == len(texts) and [x[:5] for x in found[0]] == [x[:5] for x in found[1]]
    assert np.allclose([x[5:] for x in found[0]], [x[5:] for x in found[1]], rtol=1e-6)


def test_packing_is_whole_and_tight(spark, docs, empty, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    got = packing.pack_documents(docs).collect()
    ids = {a: [*tokenizer.encode(b or "", add_special_tokens=False).ids, 2] for a, b, *_ in texts if a not in (3, None)}
    pieces, sequences = {}, {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["doc_id"] in ids:
            pieces.setdefault(r["doc_id"], []).append(r)
    for doc_id, own in ids.items():
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            part = np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(own), zlib.crc32(part))
            at += r["length"]
        assert at == len(own)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(empty).count() == 0
    total = sum(r["length"] for r in got)
    assert total / (4096 * len(sequences)) > 0.9


def test_words_give_the_ids_of_the_whole_text():
    for name, size in ((packing.TOKENIZER, 600), (packing.TOKENIZER, packing.CACHED_BYTES), ("byte_bpe_50k.json", 600)):
        made = packing.WordTokenizer(packing.tokenizer_path(name), size)
        assert made.wordwise == (name == packing.TOKENIZER)
        for text in ("", " ", "Don't we'll IT'S 's s' x's", "naïve ß ÿ × a× ×a", "日本 語", "ΣΑΣ İ ŉ", "<|endoftext|> a", "a\x1cb", "x² ½ª 12_3 __", "é a b", 'word... (w) "q" a,b'):
            assert np.frombuffer(made.encode(text), "<u4").tolist() == made.whole.encode(text, add_special_tokens=False).ids, text
        assert made.words.held <= 4000 or size > 600


def test_differencing_is_near_equal():
    rng = np.random.default_rng(5)
    for n, k in ((1, 1), (1, 3), (50, 4), (400, 60)):
        sizes = rng.integers(1, 1000, n)
        window = packing.difference(sizes, k)
        sums = np.bincount(window, sizes, k)
        assert sums.sum() == sizes.sum() and len(window) == n
        if n >= 10 * k:
            assert sums.max() - sums.min() <= 100
    assert np.bincount(packing.near_equal_windows(np.array([600, 600, 600]), 1000)).max() == 1
