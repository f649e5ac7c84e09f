import re

import duckdb
import pytest
from test_queries import TABLES, rows

from factlattice import registry

SF = "/root/testdata/sf0.01"
@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_reachability_of_the_whole_tree(spark, duck):
    edges = duck.sql("SELECT 'r-' || n_regionkey, 'n-' || n_nationkey FROM nation UNION ALL SELECT 'n-' || c_nationkey, 'c-' || c_custkey FROM customer UNION ALL SELECT 'c-' || o_custkey, 'o-' || o_orderkey FROM orders UNION ALL SELECT 'o-' || l_orderkey, 'l-' || l_orderkey || '-' || l_linenumber FROM lineitem").fetchall()
    below, level = {}, {"r-0", "r-1"}
    for parent, child in edges:
        below.setdefault(parent, set()).add(child)
    reached = set()
    while level:
        level = {c for p in level for c in below.get(p, ())}
        reached |= level
    got = registry.queries()["reachability"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted((c, "unreachable") for c in {c for _, c in edges} - reached)
    assert any(r["node_id"].startswith("l-") for r in got)


def test_addresses_of_four_letters(spark, tmp_path):
    spark.createDataFrame([(1, 3), (18278, 4), (18279, 5), (19999, 6)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = registry.queries()["a1_address"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, "A3", 1, 3), (18278, "ZZZ4", 18278, 4), (18279, "AAAA5", 18279, 5), (19999, "ACOE6", 19999, 6)]


def test_lines_and_cells_of_all_documents(spark, tmp_path):
    texts = ["a\rbé\r\nc\n", "", "x\n\r\ry", r"| a \| b | c |", "a | b\r| \\| |\rno", r"d | e \|", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spans, cells = [], []
    for k, text in enumerate(texts):
        at, whole = 0, text or ""
        for n, line in enumerate(re.split("\r\n|\n|\r", text) if text is not None else []):
            at = whole.index(line, at) if not n else at
            a, b = at, at + len(line)
            spans.append((k, n + 1, a, b, len(whole[:a].encode()), len(whole[:b].encode())))
            at = b + (2 if whole[b : b + 2] == "\r\n" else 1)
            if "|" in line:
                bare = line.strip(" ").replace("\\|", "#")
                cells.append((k, n + 1, len(bare.removeprefix("|").removesuffix("|").split("|"))))
    found = lambda name, columns: sorted(tuple(r[c] for c in columns) for r in registry.queries()[name](spark, str(tmp_path)).collect())
    assert found("line_spans", ["doc_id", "line", "char_start", "char_end", "byte_start", "byte_end"]) == spans
    assert found("pipe_table_rows", ["doc_id", "line", "cells"]) == cells
