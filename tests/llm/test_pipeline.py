import random
from collections import Counter

import corpus_pipeline
from factlattice.llm import jaccard_join


def test_stages_follow_one_another(spark, docs, texts):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and names[-1] == "packing"
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], "/root/testdata/sf0.001")
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(spark.createDataFrame(out.collect(), out.schema))
    ids = [{r["doc_id"] for r in k.collect()} for k in kept]
    assert ids[1] == {a for a, b, *_ in texts if a is not None and b and any(c.isalpha() for c in b)}
    seen = {}
    for a, b, *_ in sorted((r for r in texts if r[0] in ids[1]), key=lambda r: r[0]):
        seen.setdefault(" ".join(b.split()), a)
    assert ids[2] == set(seen.values()) and kept[2].count() == len(ids[2])
    classes = jaccard_join.near_duplicates(kept[2]).collect()
    assert ids[3] == {r["class_id"] for r in classes}
    assert ids[4] <= ids[3] and len(ids[4]) > 0.3 * len(ids[3])
    packed = corpus_pipeline.STAGES[4][1](spark, kept[4], "")
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids[4]


def test_rows_without_an_id_of_their_own_stay(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(40))
    rows = [(k, text()) for k in range(30)] + [(5, text()), (5, text()), (5, "1 2 !!"), (None, text()), (None, text()), (None, None)]
    rows += [(30, rows[0][1]), (None, rows[-2][1]), (7, rows[7][1])]  # copies
    table = spark.createDataFrame([(a, b, "aa", "s0", len(b or "")) for a, b in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in corpus_pipeline.STAGES if s[0] != "mixing"])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert Counter(r["doc_id"] for r in got.filter("start = 0").collect()) == Counter({**dict.fromkeys(range(30), 1), 5: 3, None: 2})


def test_an_empty_table_gives_no_pieces(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_rows_without_labels_are_rejected_by_the_first_stage_alone(spark, tmp_path):
    """Without any language to learn every text is undetermined, and nothing is left to pack."""
    rows = [(k, f"words of text {k}", None, "s0", 10) for k in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
