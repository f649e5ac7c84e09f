from factlattice.sources import word
from factlattice.sources.ir import Limits, to_json
from tests.test_documents import RELS, TYPE, W, package

NS = W + ' xmlns:wp="http://wp" xmlns:a="http://a" xmlns:r="http://r"'
COLOUR = '<w:color w:val="112233" w:themeColor="{}" w:themeTint="{}" w:themeShade="{}"/>'


def drawing(number: int, inner: str, wrap: str = "<wp:wrapSquare/>", position: str = '<wp:positionH relativeFrom="page"><wp:posOffset>5</wp:posOffset></wp:positionH>', transform: str = "") -> str:
    return f'<w:r><w:drawing><wp:anchor relativeHeight="7">{position}<wp:extent cx="10" cy="20"/>{wrap}<wp:docPr id="{number}"/><a:graphic><a:xfrm {transform}/>{inner}</a:graphic></wp:anchor></w:drawing></w:r>'


SOURCE = {
    "_rels/.rels": f'<Relationships {RELS}><Relationship Id="r1" Type="{TYPE}officeDocument" Target="word/document.xml"/></Relationships>',
    "word/_rels/document.xml.rels": f'<Relationships {RELS}><Relationship Id="r1" Type="{TYPE}styles" Target="styles.xml"/><Relationship Id="r2" Type="{TYPE}theme" Target="theme/theme1.xml"/></Relationships>',
    "word/theme/theme1.xml": '<a:theme xmlns:a="http://a"><a:clrScheme><a:dk1><a:sysClr val="windowText" lastClr="000000"/></a:dk1><a:accent1><a:srgbClr val="4F81BD"/></a:accent1></a:clrScheme></a:theme>',
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="Own"><w:rPr><w:b/><w:color w:val="FF0000"/></w:rPr></w:style><w:style w:type="character" w:styleId="Char"><w:rPr><w:i/></w:rPr></w:style></w:styles>',
    "word/document.xml": f"""<w:document {NS}><w:body>
      <w:p><w:pPr><w:pStyle w:val="Own"/><w:jc w:val="both"/></w:pPr><w:r><w:rPr>{COLOUR.format("accent1", "99", "")}</w:rPr><w:t>one</w:t></w:r><w:r><w:rPr>{COLOUR.format("accent1", "99", "")}</w:rPr><w:t>two</w:t></w:r><w:r><w:t>three</w:t></w:r></w:p>
      <w:p><w:r><w:rPr><w:rStyle w:val="Char"/>{COLOUR.format("text1", "", "80")}</w:rPr><w:t>four</w:t></w:r><w:r><w:rPr><w:color w:themeColor="accent6"/></w:rPr><w:t>five</w:t></w:r><w:r><w:rPr><w:color w:val="auto"/></w:rPr><w:t>six</w:t></w:r></w:p>
      <w:p><w:pPr><w:sectPr><w:pgSz w:w="100" w:h="200"/><w:cols w:num="2"/></w:sectPr></w:pPr>{drawing(1, "<a:cxnSp><a:stCxn id='2'/><a:endCxn id='9'/></a:cxnSp>")}</w:p>
      <w:p>{drawing(2, "<a:pic><a:srcRect l='10000' b='25000'/></a:pic>", transform='rot="5400000"')}{drawing(3, "<a:wsp/>", wrap="", position='<wp:positionV relativeFrom="margin"><wp:posOffset>8</wp:posOffset></wp:positionV>', transform='rot="60000"')}</w:p>
      <w:sectPr><w:pgSz w:w="200" w:h="100" w:orient="landscape"/><w:pgMar w:top="9"/><w:lnNumType w:countBy="5"/></w:sectPr></w:body></w:document>""",
}


def converted():
    document = word.convert(package(SOURCE), Limits())
    by_id = {e[k]: e for rows, k in ((document["styles"], "styleId"), (document["texts"], "textId"), (document["geometries"], "geometryId"), (document["layouts"], "layoutId")) for e in rows}
    runs = {by_id[n["textIds"][0]]["value"]: n for n in document["nodes"] if n["kind"] == "run"}
    return document, by_id, runs


def test_direct_formats_over_styles_and_themes():
    document, by_id, runs = converted()
    paragraph = next(n for n in document["nodes"] if n["kind"] == "paragraph")
    own = by_id[paragraph["resolvedStyleId"]]
    assert own["resolved"] == {"bold": "true", "color": {"kind": "rgb", "r": 255, "g": 0, "b": 0, "a": 1}, "align": "justify"} and by_id[paragraph["directStyleId"]]["direct"] == {"align": "justify"}
    one = by_id[runs["one"]["resolvedStyleId"]]
    assert one["basedOn"] == own["styleId"] and one["resolved"]["bold"] == "true" and one["resolved"]["align"] == "justify"
    assert one["resolved"]["color"] == {"kind": "rgb", "r": 185, "g": 205, "b": 229, "a": 1}  # a tint of 0x99 / 255
    assert by_id[runs["one"]["directStyleId"]]["declaration"]["color"] == {"kind": "theme", "slot": "accent1"}
    trace = {t["property"]: (t["source"], t["action"]) for t in one["cascadeTrace"]}
    assert trace["color"] == (runs["one"]["directStyleId"], "direct") and trace["align"] == (paragraph["directStyleId"], "inherit")
    assert runs["two"]["resolvedStyleId"] == runs["one"]["resolvedStyleId"] and runs["three"]["resolvedStyleId"] == own["styleId"] and "directStyleId" not in runs["three"]
    four = by_id[runs["four"]["resolvedStyleId"]]
    assert four["resolved"] == {"italic": "true", "color": {"kind": "rgb", "r": 0, "g": 0, "b": 0, "a": 1}} and four["status"] == "normalized"
    assert [by_id[runs[x]["resolvedStyleId"]]["status"] for x in ("five", "six")] == ["ambiguous"] * 2


def test_sections_and_drawings():
    document, by_id, _ = converted()
    pages = [s for s in document["surfaces"] if s["kind"] == "page"]
    assert [p["sectionBoundary"] for p in pages] == ["section-1", "section-2"] and document["parts"][0]["surfaceIds"] == [p["surfaceId"] for p in pages]
    sections = [e["payload"] for e in document["extensions"] if e["type"] == "section-page-properties"]
    assert [s["surfaceId"] for s in sections] == [p["surfaceId"] for p in pages]
    assert sections[0]["columns"] == {"num": "2"} and sections[0]["pgSz"] == {"orient": "portrait", "w": "100", "h": "200"} and sections[1]["pgSz"]["orient"] == "landscape" and sections[1]["pgMar"] == {"top": "9"} and sections[1]["lineNumbering"] == {"countBy": "5"}
    connector, picture, shape = (next(n for n in document["nodes"] if n["kind"] == k) for k in ("connector", "image", "shape"))
    layout = [by_id[n["layoutIds"][0]] for n in (connector, picture, shape)]
    assert layout[0]["anchor"] == {"kind": "page", "surfaceId": pages[0]["surfaceId"]} and layout[0]["wrap"] == "square" and layout[0]["zIndex"] == 7
    assert layout[1]["anchor"]["surfaceId"] == pages[1]["surfaceId"] and layout[1]["transform"] == {"a": "0", "b": "1", "c": "-1", "d": "0", "e": "0", "f": "0"}
    assert by_id[picture["geometryId"]]["primitives"][0]["rotation"] == {"value": "90", "unit": "deg"}
    crop = by_id[layout[1]["clipGeometryIds"][0]]["primitives"][0]
    assert (crop["x"], crop["width"]["value"], crop["height"]["value"]) == ("10", "90", "75")
    assert layout[2]["anchor"]["kind"] == "floating" and layout[2]["anchor"]["offset"] == "h:0;v:8" and shape["status"] == "ambiguous" and "transform" not in layout[2]
    assert [(r["kind"], r["fromId"], r["toId"], r["endpoint"]) for r in document["relations"]] == [("connectorTarget", connector["nodeId"], picture["nodeId"], "start")]
    assert any("no drawing 9" in d["message"] for d in document["diagnostics"])


def test_formatted_documents_have_no_violations(spark):
    from factlattice.operators import facts, validation

    document, _, _ = converted()
    entities = facts.entities(spark.createDataFrame([(document["documentId"], to_json(document))], "document_id string, ir_json string")).cache()
    fields = facts.flatten(entities).cache()
    assert validation.violations(entities, fields, facts.references(fields, entities)).collect() == []
