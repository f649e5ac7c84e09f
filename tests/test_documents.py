import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from factlattice.operators import canonical, facts, index, query, trees, validation
from factlattice.plans.contract import Contract, QueryError
from factlattice.sources import convert, markdown, pdf
from factlattice.sources.containers import Package, bounded_xml, member_name
from factlattice.sources.ir import Limits, SourceError, plain_decimal, safe_id

MD = """---
title: A test
---
# Head *one* #

Text with `code | x`, **strong** and [a link](http://x.example "t"), [ref] &amp; \\*

- a
  - b
- [x] done

> quoted

| a | b\\|c |
|---|:-:|
| 1 | `x|y` |

```py
# not a heading
```

[ref]: http://r.example
Setext
===
""".encode()


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
TYPE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
XLSX = {
    "xl/workbook.xml": f'<workbook {X}><workbookPr/><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships {RELS}><Relationship Id="rId1" Type="{TYPE}worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {X}><si><t>shared</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>",
    "xl/styles.xml": f'<styleSheet {X}><numFmts><numFmt numFmtId="164" formatCode="#,##0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="46"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": f"""<worksheet {X}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>9</v></c></row>
      <row r="2" hidden="1"><c r="A2" s="1"><v>60</v></c><c r="B2" s="2"><v>1234.5</v><f>A1*2</f></c><c r="C2" t="b"><v>1</v></c><c r="D2" s="3"><v>1.5</v></c></row></sheetData>
      <mergeCells><mergeCell ref="A1:B1"/></mergeCells><conditionalFormatting sqref="A1:B2"><cfRule type="cellIs" priority="1" operator="greaterThan" dxfId="0"><formula>5</formula></cfRule></conditionalFormatting></worksheet>""",
}
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = {
    "_rels/.rels": f'<Relationships {RELS}><Relationship Id="r1" Type="{TYPE}officeDocument" Target="word/document.xml"/></Relationships>',
    "word/_rels/document.xml.rels": f'<Relationships {RELS}><Relationship Id="r1" Type="{TYPE}styles" Target="styles.xml"/></Relationships>',
    "word/styles.xml": f'<w:styles {W}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="22"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:styleId="Base"><w:rPr><w:b/></w:rPr></w:style><w:style w:styleId="Own"><w:basedOn w:val="Base"/><w:rPr><w:i/><w:b w:val="0"/></w:rPr></w:style><w:style w:styleId="Lost"><w:basedOn w:val="Gone"/></w:style></w:styles>',
    "word/document.xml": f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Own"/></w:pPr><w:r><w:t>Hello</w:t><w:tab/><w:t>World</w:t></w:r></w:p>
      <w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> PAGE </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>7</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>
      <w:tbl><w:tblGrid><w:gridCol w:w="100"/><w:gridCol w:w="100"/></w:tblGrid><w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>""",
}


def make_pdf() -> bytes:
    content = b"q 1 0 0 1 10 20 cm BT /F1 12 Tf 5 6 Td (Hi) Tj /F2 10 Tf <0041> Tj <0099> Tj ET 0 0 10 20 re f Q"
    cmap = b"1 beginbfrange <0041> <0043> <0061> endbfrange"
    stream = lambda d, b: b"<<%s/Length %d>>\nstream\n%s\nendstream" % (d, len(b), b)
    objects = [
        b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 200 100]/Resources<</Font<</F1 5 0 R/F2 6 0 R>>>>>>", b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Annots[8 0 R]>>",
        stream(b"/Filter/FlateDecode", zlib.compress(content)), b"<</Type/Font>>", b"<</Type/Font/ToUnicode 7 0 R>>", stream(b"", cmap), b"<</Subtype/Link/Rect[1 2 30 40]/A<</S/URI/URI(http://x.example)>>>>",
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k + 1, o) for k, o in enumerate(objects)) + b"trailer <</Root 1 0 R>>\n%%EOF"


SOURCES = {"a.md": MD, "b.xlsx": package(XLSX), "c.docx": package(DOCX), "d.pdf": make_pdf()}


@pytest.fixture(scope="module")
def converted(spark):
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in SOURCES.items()] + [("bad.pdf", bytearray(b"no")), ("bad.xlsx", bytearray(b"PK")), ("skip.txt", bytearray(b"x"))], "path string, content binary")
    return convert.convert_files(files).cache()


@pytest.fixture(scope="module")
def tables(converted):
    documents = converted.select("document_id", "ir_json")
    entities = facts.entities(documents).cache()
    fields = facts.flatten(entities).cache()
    return documents, entities, fields, facts.references(fields, entities).cache()


def test_each_source_converts(converted):
    got = {r["path"]: r for r in converted.collect()}
    assert set(got) == {*SOURCES, "bad.pdf", "bad.xlsx"}
    assert {p: got[p]["outcome"] for p in got} == {"a.md": "complete", "b.xlsx": "partial", "c.docx": "partial", "d.pdf": "partial", "bad.pdf": "failed", "bad.xlsx": "failed"}
    values = {p: [t["value"] for t in json.loads(got[p]["ir_json"]).get("texts", [])] for p in got}
    assert {"code | x", "strong", "a link", "ref", "x|y", "# not a heading", "Setext", "done"} <= set(values["a.md"])
    assert {"shared", "rich", "02-29-00", "1,234.50", "36:00:00", "TRUE"} <= set(values["b.xlsx"])
    assert {"Hello\tWorld", "PAGE", "7", "a"} <= set(values["c.docx"])
    assert {"Hi", "a"} <= set(values["d.pdf"])


def test_converted_documents_have_no_violations(tables):
    _, entities, fields, references = tables
    assert validation.violations(entities, fields, references).collect() == []


def test_word_styles_fields_and_merges(converted):
    document = json.loads(converted.filter("path = 'c.docx'").first()["ir_json"])
    resolved = {tuple(sorted(s["resolved"].items())): s["status"] for s in document["styles"] if s["origin"] == "resolved"}
    assert resolved[(("bold", "false"), ("italic", "true"), ("size", "11"))] == "normalized"
    assert resolved[(("size", "11"),)] == "ambiguous"
    cells = [n.get("mergeRole") for n in document["nodes"] if n["kind"] == "cell"]
    assert cells == ["master", None, "follower", None]
    assert len(document["fields"]) == 1


def test_pdf_geometry_and_partial_maps(converted):
    document = json.loads(converted.filter("path = 'd.pdf'").first()["ir_json"])
    glyphs = [n for n in document["nodes"] if n["kind"] == "glyph"]
    assert [n["status"] for n in glyphs] == ["approximated", "approximated", "ambiguous"]
    first = next(g for g in document["geometries"] if g["geometryId"] == glyphs[0]["geometryId"])["primitives"][0]
    assert (first["x"], first["y"]) == ("15", "26")
    assert document["annotations"][0]["body"] == "http://x.example"
    assert pdf.decode(b"\0A\0\x99", {b"\0A": "a"}) is None


MUTATIONS = {
    "ID-DUPLICATE": lambda d: d["texts"].append(dict(d["texts"][0])),
    "STATUS-INVALID": lambda d: d["texts"][0].update(status="fine"),
    "FORBIDDEN-KEY": lambda d: d["texts"][0].update(predicate=1),
    "FRACTIONAL-NUMBER": lambda d: d["texts"][0].update(score=1.5),
    "ROOT-MISSING": lambda d: d.update(rootNodeId="none"),
    "NODE-KIND": lambda d: d["nodes"][1].update(kind="thing"),
    "REFERENCE-DANGLING": lambda d: d["nodes"][2]["textIds"].append("none"),
    "REFERENCE-COLLECTION": lambda d: d["nodes"][2]["textIds"].append(d["parts"][0]["partId"]),
    "RECIPROCITY": lambda d: d["nodes"][1]["childIds"].pop(),
    "DUPLICATE-MEMBER": lambda d: d["nodes"][2]["textIds"].append(d["nodes"][2]["textIds"][0]),
    "RUN-TEXT-MISSING": lambda d: d["nodes"][2].pop("textIds"),
    "NODE-VARIANT": lambda d: d["nodes"][0].update(address={}),
    "TABLE-CONTAINMENT": lambda d: d["tables"][0]["rowIds"].append(d["nodes"][1]["nodeId"]),
    "COMPLETE-CLAIM": lambda d: d["nodes"][1].update(status="unsupported"),
    "INVENTORY-MISMATCH": lambda d: d["conversion"]["featureInventory"][0].update(occurrences=99),
    "WARNING-STATUS": lambda d: d["conversion"].update(status="complete-with-warnings"),
    "FAILED-NO-ERROR": lambda d: d["conversion"].update(status="failed"),
    "CONVERSION-STATUS": lambda d: d["conversion"].update(status="done"),
    "TYPED-VALUE": lambda d: d["nodes"][1].update(value={"type": "decimal", "value": "1.50"}),
    "GEOMETRY-MISSING": lambda d: d["nodes"][1].update(kind="shape"),
    "DISCRIMINATOR-REQUIRED": lambda d: d["nodes"][1].update(fill={"kind": "rgb", "r": 1, "g": 2}),
    "DISCRIMINATOR-FORBIDDEN": lambda d: d["nodes"][1].update(fill={"kind": "gray", "gray": 1, "r": 2}),
    "PART-CYCLE": lambda d: d["parts"][0].update(parentPartId=d["parts"][0]["partId"]),
}


def test_each_mutation_is_detected(spark, converted):
    base = json.loads(converted.filter("path = 'a.md'").first()["ir_json"])
    rows = []
    for code, change in MUTATIONS.items():
        document = json.loads(json.dumps(base))
        document["documentId"] = code
        change(document)
        rows.append((code, json.dumps(document)))
    documents = spark.createDataFrame(rows, "document_id string, ir_json string")
    entities = facts.entities(documents).cache()
    fields = facts.flatten(entities).cache()
    found = {(r["document_id"], r["code"]) for r in validation.violations(entities, fields, facts.references(fields, entities)).collect()}
    assert {c for c in MUTATIONS if (c, c) not in found} == set()


def test_strict_json_and_quarantine(spark):
    good, bad = facts.load_documents(spark.createDataFrame([('{"documentId": "a"}',), ('{"documentId": "a", "documentId": "b"}',), ('{"documentId": "a", "x": NaN}',), ("[1]",), ("{",)], "value string"))
    assert [r["document_id"] for r in good.collect()] == ["a"] and bad.count() == 4


def test_lanes_null_and_missing(spark):
    contract = Contract.from_types({"nodes": {"/a": "integer", "/l": "list", "/l/*": "any", "/s": "string"}})
    entity = lambda k, payload: ("d", "nodes", k, None, None, 0, json.dumps(payload))
    e = spark.createDataFrame([entity("1", {"a": 1}), entity("2", {"a": True}), entity("3", {"a": "1"}), entity("4", {"a": None}), entity("5", {"l": [1, "x"]}), entity("6", {"s": "10"}), entity("7", {"s": "9"})], facts.ENTITY_SCHEMA)
    f = facts.flatten(e)
    ask = lambda *a, **k: {r["entity_id"] for r in query.query_fields(f, e, contract, *a, collection="nodes", **k).collect()}
    assert ask("/a", 1) == {"1"} and ask("/a", True) == {"2"} and ask("/a", "1") == {"3"}
    assert ask("/a", 1, operator="neq") == {"2", "3", "4"}
    assert ask("/a", operator="exists") == {"1", "2", "3", "4"} and ask("/a", operator="is-null") == {"4"} and ask("/a", operator="is-missing") == {"5", "6", "7"}
    assert ask("/l", "x", operator="contains") == {"5"} and ask("/l", 2, operator="contains") == set()
    with pytest.raises(Exception, match="cannot order"):
        ask("/a", 0, operator="gt")
    with pytest.raises(QueryError):
        ask("/b", 1)
    with pytest.raises(QueryError):
        ask("/s", "a", operator="lt")


def test_paging_is_bound_to_its_query(spark):
    contract = Contract.from_types({"nodes": {"/a": "integer"}})
    e = spark.createDataFrame([("d", "nodes", f"n{k:02d}", "p", None, k, "{}") for k in range(25)], facts.ENTITY_SCHEMA)
    seen, cursor = [], None
    while True:
        page, cursor = query.list_entities_page(e, contract, "D", "nodes", kind="p", limit=10, cursor=cursor)
        seen += [r["entity_id"] for r in page]
        if cursor is None:
            break
        kept = cursor
    assert seen == [f"n{k:02d}" for k in range(25)]
    for changed in ({"kind": None}, {"kind": "p", "digest": "E"}):
        with pytest.raises(QueryError):
            query.list_entities_page(e, contract, changed.pop("digest", "D"), "nodes", limit=10, cursor=kept, **changed)
    with pytest.raises(QueryError):
        query.list_entities_page(e, contract, "D", "nodes", limit=1001)


def test_canonical_form(spark):
    one = {"documentId": "a", "nodes": [{"nodeId": "b", "x": [2, 1]}, {"nodeId": "a"}], "z": "\uff5e", "orders": [{"orderId": "o", "items": [{"id": "q", "ordinal": 1}, {"id": "p", "ordinal": 0}]}]}
    two = {"orders": [{"items": [{"ordinal": 0, "id": "p"}, {"ordinal": 1, "id": "q"}], "orderId": "o"}], "z": "\uff5e", "nodes": [{"nodeId": "a"}, {"x": [2, 1], "nodeId": "b"}], "documentId": "other"}
    assert canonical.canonical_text(one, "content") == canonical.canonical_text(two, "content")
    assert canonical.canonical_text(one) != canonical.canonical_text(two)
    assert facts.canonical_json({"\uff5e": 1, "\U0001f600": 2, "a": 3}) == '{"a":3,"\U0001f600":2,"\uff5e":1}'
    with pytest.raises(ValueError):
        canonical.canonical_text({"documentId": "a", "x": 1.0})
    df = spark.createDataFrame([("a", json.dumps(one)), ("b", json.dumps({"documentId": "b", "predicate": 1}))], "document_id string, ir_json string")
    got = {r["document_id"]: r for r in canonical.canonical_documents(df, "content").collect()}
    assert got["a"]["digest"] and got["b"]["digest"] is None and "forbidden" in got["b"]["error"]


def test_migrations(spark):
    df = spark.createDataFrame([("a", '{"schema": {"version": "0.9.0"}, "legacyField": 1}'), ("b", '{"schema": {"version": "1.0.0"}}'), ("c", '{"schema": {"version": "3.0.0"}}')], "document_id string, ir_json string")
    got = {r["document_id"]: (r["status"], r["dropped"]) for r in canonical.migrate_documents(df).collect()}
    assert got == {"a": ("migrated", "/legacyField"), "b": ("identity", None), "c": ("failed", None)}
    x = spark.createDataFrame([("1.0.0", True), ("1.0.0", False), ("2.0.0", False)], "schema_version string, has_legacy_range boolean")
    assert sorted(map(tuple, canonical.migrate_extensions(x, "2.0.0").select("migration", "new_version", "loss").collect()), key=str) == sorted([("loss-declared", "2.0.0", "/payload/legacyRange"), ("preserved", "2.0.0", None), ("preserved", "2.0.0", None)], key=str)


def test_index_is_verified_on_opening(spark, tables, tmp_path):
    documents = tables[0]
    contract = Contract.from_types({"nodes": {"/kind": "string"}}, version="7")
    path = f"file://{tmp_path}"
    manifest = index.build_index(documents, path, contract)
    opened = index.open_index(spark, path, manifest["version"], contract, documents)
    assert opened.entities.count() == tables[1].count()
    with pytest.raises(index.StaleIndex):
        index.open_index(spark, path, manifest["version"], Contract([], version="8"))
    with pytest.raises(index.StaleIndex):
        index.open_index(spark, path, manifest["version"], contract, documents.limit(2))
    with pytest.raises(index.StaleIndex):
        index.open_index(spark, path, "none", contract)
    opened.entities.filter("collection != 'texts'").write.parquet(f"{path}/{manifest['version']}/changed")
    import shutil

    shutil.rmtree(tmp_path / manifest["version"] / "entities")
    shutil.move(tmp_path / manifest["version"] / "changed", tmp_path / manifest["version"] / "entities")
    with pytest.raises(index.StaleIndex):
        index.open_index(spark, path, manifest["version"], contract)


def test_text_of_a_subtree(tables):
    _, entities, fields, references = tables
    edges = trees.node_edges(references)
    root = entities.filter("collection = 'nodes' AND kind = 'heading'").select("document_id", F.col("entity_id").alias("root_id"))
    below = trees.descendants(edges, root)
    got = query.get_text(entities, query.node_texts(references), below.select("document_id", "node_id"), "source").collect()
    assert [r["value"] for r in got] == ["Head ", "*one*", "Setext"]
    with pytest.raises(QueryError):
        query.get_text(entities, query.node_texts(references), below, "shown")


def test_cycles_and_reachability(spark):
    parents = spark.createDataFrame([("d", "a", "b"), ("d", "b", "c"), ("d", "c", "b"), ("d", "x", "y"), ("d", "y", None)], "document_id string, node_id string, parent_id string")
    assert {r["node_id"] for r in trees.cyclic(parents).collect()} == {"b", "c"}


def test_limits_and_unsafe_packages():
    for name in ("/a", "../a", "a/../b", "a\\b", "C:/a", "a\0b", ""):
        with pytest.raises(SourceError):
            member_name(name)
    with pytest.raises(SourceError):
        Package(package({"a": "x" * 100}), Limits(zip_entry=50))
    with pytest.raises(SourceError):
        Package(package({f"a{k}": "" for k in range(5)}), Limits(zip_entries=4))
    for text in ('<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>', "<a>" * 300 + "</a>" * 300, "<a>"):
        with pytest.raises(SourceError):
            bounded_xml(text.encode(), Limits())
    document, outcome, error = convert.convert_bytes(MD, "markdown", Limits(input_bytes=10))
    assert outcome == "failed" and document["conversion"]["status"] == "failed" and "longer" in error


def test_markdown_machine():
    kinds = lambda text, d="gfm": [(b.kind, b.status) for b in markdown.Blocks(markdown.DIALECTS[d]).parse(markdown.split_lines(text))]
    assert kinds("# a\n***\n- x\n\n    code\n\n> q\n\n<div>\n\n:::d\n\n[^1]: n") == [("heading", "preserved"), ("break", "preserved"), ("list", "preserved"), ("code", "unsupported"), ("quote", "preserved"), ("html", "unsupported"), ("directive", "unsupported"), ("footnote", "preserved")]
    assert kinds("| a |\n|---|\n| b |", "commonmark") == [("paragraph", "preserved")]
    assert kinds("~~~\nx") == [("code", "unsupported")]
    for text in ("a *b", "`c", "[d](e", "![f", "a_b_c", "**x *y***", "<http://u> <b>z</b>", "\\*not\\*"):
        tokens = markdown.scan_inlines(text)
        assert "".join(t.raw for t in tokens) == text
    assert markdown.normal_text("\\*a\\* **b** `c` &lt; [d](e) ~~f~~ ![g](h)") == "*a* b c < d f g"
    deep = "> " * 40 + "x"
    with pytest.raises(SourceError):
        markdown.convert(deep.encode(), Limits())


def test_ids_and_decimals():
    assert plain_decimal("+1.500e2") == "150" and plain_decimal("-0.0") == "0" and plain_decimal(".5") == "0.5"
    with pytest.raises(SourceError):
        plain_decimal("1,5")
    long = safe_id("doc", "x" * 200)
    assert len(long) <= 96 and safe_id("doc", "9 a") == "doc-x-9-a" and long != safe_id("doc", "x" * 201)


def test_manifest_and_streaming(spark, tmp_path):
    from factlattice.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    for name, raw in SOURCES.items():
        (tmp_path / "in" / name).write_bytes(raw)
    files = convert.read_files(spark, str(tmp_path / "in"))
    manifest = files.select("path", F.sha2("content", 256).alias("sha256"))
    assert convert.check_manifest(files, manifest).count() == 0
    assert {r["fault"] for r in convert.check_manifest(files, manifest.filter("path NOT LIKE '%a.md'").withColumn("sha256", F.lit("x"))).collect()} == {"changed", "unlisted"}
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert {r["units"] for r in convert.inspect_files(files).filter("format = 'pdf'").collect()} == {1}
