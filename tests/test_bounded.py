"""Passes over documents: what leaves them, in batches of what size, and how often they are made."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factlattice.operators import canonical, facts
from factlattice.sources import convert


def document(key: int, nodes: int = 20) -> str:
    return json.dumps({"documentId": f"d{key}", "nodes": [{"nodeId": f"n{k}", "kind": "run", "value": {"a": [k, None]}} for k in range(nodes)], "texts": [{"textId": "t", "value": "é\U0001f600"}]})


def test_batches_out_are_bounded_however_many_documents_come_in():
    batch = pa.RecordBatch.from_arrays([pa.array([document(k) for k in range(3000)])], ["ir_json"])
    out = list(facts._entities(None)(iter([batch])))
    assert sum(b.num_rows for b in out) == 3000 * 22 and max(b.num_rows for b in out) < 11_000
    out = list(facts._flatten(None)(iter([pa.RecordBatch.from_arrays([b.column(k) for k in (0, 1, 2, 6)], ["document_id", "collection", "entity_id", "payload"]) for b in out])))
    assert max(b.num_rows for b in out) < 11_000


def test_long_payloads_leave_in_more_batches():
    batch = pa.RecordBatch.from_arrays([pa.array([json.dumps({"documentId": f"d{k}", "x": "y" * 1_000_000}) for k in range(40)])], ["ir_json"])
    assert max(b.nbytes for b in facts._entities(None)(iter([batch]))) < 6_000_000


@pytest.mark.parametrize("value", [{"b": 1, "a": [True, None, 1.5]}, {"～": 1, "\U0001f600": 2}, [{"": {"\U00010000": "x", "a": "é"}}], "\ud800", {"\ud800": 1, "￿": 2}, 10**400, "", {}, None, True, 0])
def test_fast_json_is_that_in_the_order_of_code_units(value):
    assert facts.canonical_json(value) == facts._json_by_units(value)


def test_faults_tell_their_place_in_left_out_parts_too():
    for wrong, told in (({"diagnostics": [{"diagnosticId": "d", "x": 1.5}]}, "/diagnostics/0/x: a fractional"), ({"a": {"predicate": 1}}, "/a: forbidden key predicate")):
        with pytest.raises(ValueError, match=told):
            canonical.canonical_text({"documentId": "d", **wrong}, "content")


def test_entities_and_fields_of_some_collections(spark):
    docs = spark.createDataFrame([("d1", document(1)), ("d2", document(2))], "document_id string, ir_json string")
    every = facts.entities(docs)
    some = facts.entities(docs, ["texts", facts.DOCUMENT])
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.filter(F.col("collection").isin("texts", facts.DOCUMENT)).collect()))
    fields = facts.document_fields(docs, ["nodes"], r"^/value/a")
    assert sorted(map(tuple, fields.collect()), key=str) == sorted(map(tuple, facts.flatten(every).filter("collection = 'nodes' AND pointer LIKE '/value/a%'").collect()), key=str)


def test_entities_of_files_are_those_of_their_documents(spark):
    files = spark.createDataFrame([("a.md", b"# one *two*\n\n- x\n"), ("b.pdf", b"no pdf"), ("c.txt", b"x")], "path string, content binary")
    got = convert.convert_entities(files)
    whole = convert.convert_files(files)
    expected = facts.entities(whole.select("document_id", "ir_json")).join(whole.select("document_id", "path", "outcome"), "document_id").select(got.columns)
    assert got.count() > 10 and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)


def plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, passes", [("claim_faults", 2), ("node_faults", 2), ("typed_value_faults", 1), ("parent_faults", 1), ("reference_faults", 2), ("collection_counts", 1), ("document_field", 1)])
def test_rules_pass_over_the_documents_once_for_each_table(spark, name, passes):
    from factlattice import registry

    assert plan(registry.queries()[name](spark, "/root/testdata/sf0.001")).count("MapInArrow") == passes


@pytest.mark.parametrize("name, broadcasts", [("payload_references", 1), ("reference_faults", 1), ("claim_faults", 0), ("table_faults", 0)])
def test_only_rules_are_broadcast(spark, name, broadcasts):
    """What comes of a small table of documents may be large, which no estimate tells."""
    from factlattice import registry

    assert plan(registry.queries()[name](spark, "/root/testdata/sf0.001")).count("BroadcastExchange") == broadcasts


def test_an_edge_stated_twice_is_two_faults(spark):
    from factlattice.operators import validation

    e = spark.createDataFrame([("d", "nodes", "a", "run", None, 0, '{"childIds":["b","b","c"]}'), ("d", "nodes", "c", "run", None, 1, '{"parentId":"a"}'), ("d", "nodes", "e", "run", None, 2, '{"parentId":"a"}')], facts.ENTITY_SCHEMA)
    found = validation.reciprocity(facts.flatten(e)).select("entity_id", "detail").collect()
    assert sorted(map(tuple, found)) == [("b", "a has no parentId back"), ("b", "a has no parentId back"), ("e", "a does not list it")]


def test_templates_are_those_of_the_fields(spark):
    e = spark.createDataFrame([("d", "x", "1", "k", None, 0, '{"a":[1,{"b":2}],"7":0}'), ("d", "x", "2", "k", None, 0, '{"a":[3]}'), ("d", "x", "3", "k", None, 0, None)], facts.ENTITY_SCHEMA)
    whole = facts.flatten(e, with_root=False).groupBy("collection", F.regexp_replace("pointer", "/[0-9]+(?=/|$)", "/*").alias("template")).count()
    assert sorted(map(tuple, facts.templates(e).collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("template", ["", "/a", "/a/*", "/a/1", "/a/01", "/a/*/b", "/**", "/a/**", "/x~1y/*", "/x~2y", "/none/*", "/*/*", "/a/9"])
def test_a_template_visits_what_the_walk_would_find(template):
    from factlattice.functions.pointers import segments, template_matches

    value = {"a": [1, {"b": [2], "c": None}], "x/y": {"~": 1, "0": []}, "x~2y": 3}
    expected = [row for row in facts.walk(value) if template_matches(segments(template), segments(row[0]))]
    assert list(facts.walk_template(value, segments(template))) == expected


def test_levels_of_a_tree_near_its_top_are_broadcast(spark):
    """All nodes lie below one root: their join with its edge must not gather them in one task."""
    from factlattice.operators import trees

    edges = spark.range(2000).selectExpr("'d' AS document_id", "concat('p', id % 3) AS parent_id", "concat('n', id) AS child_id", "0 AS ordinal").unionByName(spark.sql("SELECT 'd' AS document_id, 'root' AS parent_id, concat('p', id) AS child_id, 0 AS ordinal FROM range(3)"))
    nodes = spark.range(2000).selectExpr("'d' AS document_id", "concat('n', id) AS node_id")
    found = trees.ancestors(edges, nodes).groupBy("node_id", "distance").count().collect()
    assert sorted(map(tuple, found)) == [("p0", 1, 667), ("p1", 1, 667), ("p2", 1, 666), ("root", 2, 2000)]


def test_a_cycle_is_walked_once(spark):
    from factlattice.operators import trees

    edges = spark.createDataFrame([("d", "r", "a", 0), ("d", "a", "b", 0), ("d", "b", "a", 0), ("d", "b", "r", 1), ("d", "x", "y", 0)], "document_id string, parent_id string, child_id string, ordinal int")
    roots = spark.createDataFrame([("d", "r")], "document_id string, root_id string")
    assert sorted(r.node_id for r in trees.reached(edges, roots).collect()) == ["a", "b", "r"]
    nodes = spark.createDataFrame([("d", k) for k in "rabxy"], "document_id string, node_id string")
    assert sorted((r.node_id, r.code) for r in trees.reachability(edges, nodes, roots).collect()) == [("a", "several-parents"), ("x", "orphan"), ("x", "unreachable"), ("y", "unreachable")]


def test_rules_meet_cells_without_a_row_for_each_hit(spark):
    """Cells given twice, a rule by two ranges, a stop and a later block."""
    from factlattice.operators import styles

    cells = spark.createDataFrame([("s", 1, 1, "5"), ("s", 1, 1, "50"), ("s", 2, 1, "5"), ("s", 3, 9, "5")], "sheet string, row int, column int, raw_value string")
    rules = spark.createDataFrame(
        [("s", 1, "A1:A9 A1:B2", 1, "greaterThan", "=40", "stop", True), ("s", 1, "A1:A9", 2, "lessThan", "9", "low", False), ("s", 2, "A2", 1, "", "5", "own", False), ("s", 1, "A1:Z9", 0, "equal", "5", "gone", True)],
        "sheet string, block int, sqref string, priority int, operator string, operand string, style_id string, stop boolean",
    )
    declared = spark.createDataFrame([("stop", "color", "red"), ("low", "color", "blue"), ("low", "bold", "1"), ("own", "color", "green")], "style_id string, property string, value string")
    found = styles.conditional_winners(cells, rules, declared)
    assert sorted(map(tuple, found.select("row", "property", "value", "priority").collect())) == [(1, "color", "red", 1), (2, "bold", "1", 2), (2, "color", "green", 1)]
    assert "Window" not in plan(found)


def test_columns_of_any_number_of_letters(spark):
    from factlattice.functions import values

    numbers = [1, 26, 27, 702, 703, 18278, 18279, 475254, 475255, 1_200_000, 12356630, 12356631, 2**31, 2**63 - 1, 0, -1, None]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", values.column_letters(F.col("n")).alias("a")).collect()

    def letters(n):
        out = ""
        while n and n > 0:
            n, rest = divmod(n - 1, 26)
            out = chr(65 + rest) + out
        return out

    assert [(r.n, r.a) for r in rows] == [(n, letters(n)) for n in numbers]
    far = spark.range(475_000, 1_200_000, 999).select("id", values.parse_a1(values.a1(F.lit(1), F.col("id")))["column"].alias("back"))
    assert far.filter("NOT back <=> id").count() == 0
