import json

import pytest
from pyspark.sql import functions as F

from factlattice import cli
from factlattice.operators import extensions, facts, intervals
from factlattice.plans import schema
from factlattice.sources import sinks


def found(value, s, **definitions):
    return list(schema.violations(value, s, definitions))


def test_schema_subset():
    assert found(True, {"type": "integer"}) == [("", "type")] and found(1, {"const": True}) == [("", "const")] and found(1, {"enum": [1.0]}) == [("", "enum")]
    s = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "items": {"$ref": "#/n"}, "uniqueItems": True, "minItems": 1}}, "patternProperties": {"^x": {"type": "null"}}, "additionalProperties": False, "dependentRequired": {"a": ["b"]}}
    assert sorted(found({"a": [1, -1, 1], "xx": 1, "c/d": 0}, s, n={"minimum": 0})) == sorted([("/a", "uniqueItems"), ("/a/1", "minimum"), ("/xx", "type"), ("/c~1d", "additionalProperties"), ("", "dependentRequired")])
    assert found({}, s) == [("", "required")]
    assert found("ab", {"anyOf": [{"maxLength": 1}, {"pattern": "b$"}], "not": {"minLength": 3}}) == [] and found(5, {"oneOf": [{"minimum": 1}, {"minimum": 2}]}) == [("", "oneOf")]
    assert found(1, {"if": {"type": "integer"}, "then": {"minimum": 2}, "else": {"minLength": 9}}) == [("", "minimum")] and found([1], {"contains": {"type": "string"}}) == [("", "contains")]


def test_schema_over_rows(spark):
    df = spark.createDataFrame([("a", '{"n": 1}'), ("b", '{"n": "1"}'), ("c", None)], "document_id string, ir_json string")
    assert [tuple(r) for r in schema.check(df, {"properties": {"n": {"type": "integer"}}}).collect()] == [("b", "/n", "type")]


ENTRY = extensions.Entry("f", "t", "1.2.0", {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}}, accepts=("exact", "patch", "minor"), required=("k",))


def test_extension_lanes_and_verdicts(spark):
    registry = extensions.Registry([ENTRY, extensions.Entry("f", "t", "1.0.0")])
    df = spark.createDataFrame([("f", "t", v, c) for v, c in (("1.2.0", None), ("1.0.0", None), ("1.2.7", None), ("1.9.0", None), ("2.0.0", None), ("2.0.0", "critical"), ("x", None))] + [("f", "u", "1.0.0", None)], "namespace string, type string, schema_version string, criticality string")
    got = sorted((r["type"], r["schema_version"], r["criticality"] or "", r["lane"], r["verdict"]) for r in extensions.classify(df, registry).collect())
    assert got == sorted([("t", "1.2.0", "", "exact", "known"), ("t", "1.0.0", "", "exact", "known"), ("t", "1.2.7", "", "patch", "compatible"), ("t", "1.9.0", "", "minor", "compatible"), ("t", "2.0.0", "", "major", "opaque"), ("t", "2.0.0", "critical", "major", "rejected"), ("t", "x", "", "unknown", "opaque"), ("u", "1.0.0", "", "unknown", "opaque")])
    p = spark.createDataFrame([("1", "f", "t", "1.2.0", '{"k": 1}'), ("2", "f", "t", "1.2.0", '{"k": "1"}')], "extension_id string, namespace string, type string, schema_version string, payload string")
    assert [tuple(r) for r in extensions.payload_violations(p, registry).collect()] == [("2", "/k", "type")]
    assert registry.build("e", "n", "f", "t", {"k": 1})["schemaVersion"] == "1.2.0"
    for bad in ([ENTRY, ENTRY], [extensions.Entry("f", "t", "1")], [extensions.Entry("f", "t", "1.0.0", {}, digest="x")], [extensions.Entry("f", "t", "1.0.0", {}, required=("k",))]):
        with pytest.raises(extensions.RegistryError):
            extensions.Registry(bad)
    with pytest.raises(extensions.RegistryError):
        registry.build("e", "n", "f", "t", {})


def test_payload_references_and_profiles(spark):
    document = {"documentId": "d", "sourceFormat": {"name": "docx", "version": "1"}, "conversion": {"capabilityProfile": "p"}, "nodes": [{"nodeId": "n1", "kind": "run"}], "extensions": [{"extensionId": f"e{k}", "namespace": "f", "type": "t", "payload": {"to": to}} for k, to in enumerate(("n1", "none", "e0"))]}
    entities = facts.entities(spark.createDataFrame([("d", json.dumps(document))], "document_id string, ir_json string"))
    fields = facts.flatten(entities)
    got = {(r["entity_id"], r["fault"]) for r in extensions.payload_references(fields, entities, [("f", "t", "/to", ("nodes",), ("cell",))]).collect()}
    assert got == {("e0", "kind"), ("e1", "dangling"), ("e2", "collection")}
    profiles = lambda *rows: spark.createDataFrame(list(rows), "profile string, format string, version string")
    fault = lambda p: [r["fault"] for r in extensions.profile_violations(fields, p).collect()]
    assert fault(profiles(("p", "docx", "1"))) == [] and fault(profiles(("q", "docx", "1"))) == ["unknown profile"] and fault(profiles(("p", "pdf", "1"))) == ["another format"] and fault(profiles(("p", "docx", "2"))) == ["another version"]


def test_spans_and_mappings(spark):
    points = spark.createDataFrame([("a", k) for k in (0, 5, 9, 10, 70_000)], "doc string, at long")
    spans = spark.createDataFrame([("a", 5, 10, "x"), ("a", 0, 100_000, "y"), ("b", 0, 9, "z"), ("a", 5, 5, "none")], "doc string, start long, end long, name string")
    assert sorted((r["at"], r["name"]) for r in intervals.points_in_spans(points, spans, ["doc"]).collect()) == [(0, "y"), (5, "x"), (5, "y"), (9, "x"), (9, "y"), (10, "y"), (70_000, "y")]
    df = intervals.with_normal_form(spark.createDataFrame([("plain",), ("éa",), (None,)], "value string"))
    got = [(r["normalized"], r["mapping"]) for r in df.collect()]
    assert got[0] == ("plain", None) and got[2] == (None, None) and got[1][0] == "éa"
    assert [tuple(m) for m in got[1][1]][-1] == ("equal", 3, 4, 2, 3)


def test_sinks_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Title\n\nSome *text*.\n")
    assert cli.run(spark, ["convert", str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    documents = str(tmp_path / "out" / "documents")
    assert cli.run(spark, ["check", documents]) == 0
    capsys.readouterr()
    assert cli.run(spark, ["list", documents, "--collection", "nodes", "--kind", "heading"]) == 0
    node = json.loads(capsys.readouterr().out.splitlines()[0])["entity_id"]
    assert cli.run(spark, ["text", documents, "--node", node]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["value"] == "Title"
    assert cli.run(spark, ["field", documents, "--collection", "nodes", "--id", node, "--pointer", "/kind"]) == 0
    assert json.loads(capsys.readouterr().out)["value_string"] == "heading"
    good, _ = facts.load_documents(spark.read.text(documents))
    assert sinks.check_canonical(good).filter("is_canonical").count() in (0, 1)
    assert sinks.write_canonical(good, str(tmp_path / "canonical")).filter(F.col("error").isNotNull()).count() == 0
    assert sinks.check_canonical(facts.load_documents(spark.read.text(str(tmp_path / "canonical")))[0]).filter("is_canonical").count() == 1
    with pytest.raises(ValueError, match="replace"):
        sinks.write_json(good, documents, documents)
    (tmp_path / "in" / "b.pdf").write_text("none")
    assert cli.run(spark, ["convert", str(tmp_path / "in"), str(tmp_path / "out2")]) == 2


def test_pages_over_several_documents(spark):
    from factlattice.operators import query
    from factlattice.plans.contract import Contract

    rows = [(d, "nodes", n, "p", None, k, None) for d in ("A", "B", "C") for k, n in enumerate(("n1", "n2", "n3"))]
    entities = spark.createDataFrame(rows, "document_id string, collection string, entity_id string, kind string, status string, ordinal int, payload string")
    contract = Contract.from_types({"nodes": {"/name": "string"}}, version="v")
    for size in (1, 2, 4, 9):
        seen, cursor = [], None
        while True:
            page, cursor = query.list_entities_page(entities, contract, "d", "nodes", limit=size, cursor=cursor)
            seen += [(r["entity_id"], r["document_id"]) for r in page]
            if cursor is None:
                break
        assert seen == sorted((n, d) for d, _, n, *_ in rows)


def test_integers_of_any_length_are_ordered(spark):
    from factlattice.operators import facts, query

    numbers = [0, 7, -7, 10, -10, 2**53, 2**53 + 1, -(2**53) - 1, 10**400, -(10**400), 10**400 + 1]
    payloads = [("d", "things", str(k), "t", None, 0, facts.canonical_json({"v": n})) for k, n in enumerate(numbers)]
    fields = facts.flatten(spark.createDataFrame(payloads, "document_id string, collection string, entity_id string, kind string, status string, ordinal int, payload string"), with_root=False).cache()
    assert fields.count() == len(numbers)
    for bound in (0, -7, 2**53, 10**400):
        for operator, holds in (("lt", int.__lt__), ("lte", int.__le__), ("gt", int.__gt__), ("gte", int.__ge__)):
            got = {int(r["value_json"]) for r in fields.filter(query.compare(operator, bound)).collect()}
            assert got == {n for n in numbers if holds(n, bound)}, (operator, bound)


def test_deep_documents_are_quarantined(spark):
    from factlattice.operators import facts

    deep = lambda n: '{"documentId":"d%d","x":' % n + "[" * n + "]" * n + "}"
    fine, rest = facts.load_documents(spark.createDataFrame([(deep(n),) for n in (5, 150, 300, 1500, 100_000)], "value string"))
    assert {r["document_id"] for r in fine.collect()} == {"d5", "d150"} and rest.count() == 3
    assert facts.entities(fine).count() == 2
