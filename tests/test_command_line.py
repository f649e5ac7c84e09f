import json

import pytest

from factlattice import cli
from factlattice.operators import facts, validation
from factlattice.plans import document as format
from factlattice.plans import schema
from factlattice.sources import convert, pdf
from factlattice.sources.ir import Limits, to_json
from tests import test_markdown_links, test_pdf_files, test_sheet_styles, test_word_formats
from tests.test_documents import SOURCES


def all_documents():
    kinds = {"md": "markdown"}
    made = [convert.convert_bytes(raw, kinds.get(name[2:], name[2:]), Limits())[0] for name, raw in SOURCES.items()]
    made += [m.converted()[0] for m in (test_markdown_links, test_sheet_styles, test_word_formats)]
    return [*made, pdf.convert(test_pdf_files.with_table(test_pdf_files.OBJECTS), Limits()), convert.convert_bytes(b"x", "pdf", Limits())[0]]


def test_documents_have_the_format():
    for document in all_documents():
        assert list(schema.violations(document, format.document_schema(), format.DEFINITIONS)) == []
    document = all_documents()[0]
    faults = lambda: list(schema.violations(document, format.document_schema(), format.DEFINITIONS))
    document["nodes"][0]["status"] = "fine"
    assert faults() == [("/nodes/0/status", "enum")]
    document["nodes"][0]["status"], document["nodes"][0]["colour"] = "preserved", 1
    assert [k for _, k in faults()] == ["additionalProperties"]
    del document["nodes"][0]["colour"], document["texts"][0]["value"]
    assert [k for _, k in faults()] == ["required"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("documents")
    (path / "documents.jsonl").write_text("\n".join(to_json(d) for d in all_documents()[:2]) + "\n")
    return str(path)


def test_rules_of_schema_and_profile(spark):
    document = all_documents()[0]
    document["nodes"][1]["ordinal"], document["conversion"]["capabilityProfile"] = 1, "pdf-1"
    documents = spark.createDataFrame([(document["documentId"], to_json(document))], "document_id string, ir_json string")
    entities = facts.entities(documents).cache()
    fields = facts.flatten(entities).cache()
    found = validation.violations(entities, fields, facts.references(fields, entities), documents).collect()
    assert {(r["code"], r["detail"]) for r in found} == {("SCHEMA", "/nodes/1/ordinal additionalProperties"), ("PROFILE", "another format")}


def test_verbs(spark, folder, tmp_path, capsys):
    def run(*arguments, code=0):
        capsys.readouterr()
        assert cli.run(spark, [arguments[0], folder, *arguments[1:]]) == code
        return [json.loads(line) for line in capsys.readouterr().out.splitlines()]

    assert run("check") == []
    assert all(r["registered"] for r in run("coverage"))
    headings = run("list-nodes", "--kind", "heading")
    node, document = headings[0]["entity_id"], headings[0]["document_id"]
    assert run("entity", "--collection", "nodes", "--id", node, "--document", document)[0]["kind"] == "heading"
    assert run("document-field", "--document", document, "--pointer", "/conversion/status")[0]["value_string"] == "complete"
    assert {r["entity_id"] for r in run("query-fields", "--pointer", "/kind", "--value", "heading", "--collection", "nodes")} == {h["entity_id"] for h in headings}
    assert run("query-fields", "--pointer", "/kind", "--value", "heading", "--collection", "nodes", "--profile", "xlsx-1") == []
    assert {r["pointer"] for r in run("query-fields", "--pointer", "/address/row", "--value", "2", "--operator", "gte", "--collection", "nodes")} == {"/address/row"}
    assert [r["document_id"] for r in run("list", "--collection", "nodes", "--kind", "document", "--profile", "markdown-1")] == [document]
    assert run("ancestors", "--node", node) and run("descendants", "--node", "node-00001")
    assert run("text", "--node", node, "--scope", "direct") == [] and run("text", "--node", node)
    assert run("relations", "--kind", "links") and run("extensions", "--type", "conditional-formatting") and run("observations", "--kind", "measurement") and run("references", "--pointer", "/formulaId")
    first = run("page", "--collection", "tables", "--limit", "1")[0]
    second = run("page", "--collection", "tables", "--limit", "1", "--cursor", first["cursor"])[0]
    assert first["entities"] != second["entities"] and len(second["entities"]) == 1
    manifest = run("build-index", "--index", str(tmp_path / "index"))[0]
    assert run("check-index", "--index", str(tmp_path / "index"), "--version", manifest["version"])[0] == manifest
    run("check-index", "--index", str(tmp_path / "index"), "--version", "none", code=2)
    for refused in (("query-fields", "--pointer", "/none", "--value", "1"), ("list", "--profile", "none"), ("page", "--collection", "nodes", "--cursor", "x"), ("entity", "--collection", "nodes", "--id", "none"), ("query-fields", "--pointer", "/kind", "--value", "a", "--profile", "none")):
        run(*refused, code=1)
