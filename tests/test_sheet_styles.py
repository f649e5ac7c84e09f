import json

from factlattice.sources import sheet_styles, spreadsheet
from factlattice.sources.colours import theme_colours
from factlattice.sources.containers import bounded_xml
from factlattice.sources.ir import Limits
from tests.test_documents import RELS, TYPE, XLSX, X, package

STYLES = f"""<styleSheet {X}><numFmts><numFmt numFmtId="164" formatCode="0.000"/></numFmts>
<fonts><font><name val="Calibri"/><sz val="11"/><color theme="1"/></font><font><b/><i val="0"/><u/><strike/><sz val="x"/><color theme="4" tint="-0.5"/></font><font><color auto="1"/><u val="double"/></font></fonts>
<fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor rgb="80FF0000"/></patternFill></fill><fill><patternFill patternType="gray125"><bgColor indexed="64"/></patternFill></fill><fill><gradientFill/></fill></fills>
<borders><border><left/></border><border><left style="thin"><color indexed="10"/></left><top style="dashed"/><diagonal style="thin"/></border></borders>
<cellStyleXfs><xf numFmtId="164" fontId="0" fillId="1"/></cellStyleXfs><cellStyles><cellStyle name="Own" xfId="0"/></cellStyles>
<cellXfs><xf numFmtId="164" xfId="0" applyFill="0"/><xf numFmtId="0" xfId="0" fontId="1" fillId="0" borderId="1"><alignment horizontal="center"/></xf><xf xfId="7"/><xf fontId="2" fillId="2"/><xf fillId="3" borderId="9" applyFont="0"><alignment horizontal="fill"/></xf></cellXfs>
<dxfs><dxf><font><b/></font><fill><patternFill patternType="solid"><bgColor rgb="FF00FF00"/></patternFill></fill></dxf><dxf><font><i/><b/></font></dxf></dxfs></styleSheet>"""
THEME = '<a:theme xmlns:a="http://a"><a:themeElements><a:clrScheme><a:dk1><a:sysClr val="windowText" lastClr="101010"/></a:dk1><a:lt1><a:srgbClr val="FFFFFF"/></a:lt1><a:accent1><a:srgbClr val="0000FF"/></a:accent1></a:clrScheme></a:themeElements></a:theme>'
RULE = '<cfRule type="cellIs" priority="{}" operator="{}" dxfId="{}" {}><formula>{}</formula></cfRule>'
SHEET = f"""<worksheet {X}><dimension ref="A1:D2"/><sheetViews><sheetView workbookViewId="0"><pane xSplit="1" state="frozen"/><selection activeCell="B2" sqref="B2:C3"/></sheetView></sheetViews>
<cols><col min="2" max="3" hidden="1"/><col min="4" max="4"/></cols><sheetData><row r="1"><c r="A1" s="0"><v>10</v></c><c r="B1" s="1"><v>20</v></c><c r="C1" s="2"><v>x</v></c></row><row r="2"><c r="A2" s="3"><v>1</v></c><c r="B2" s="4"><v>30</v></c><c r="D2" s="9"><v>2</v></c></row></sheetData>
<conditionalFormatting sqref="A1:B2 junk">{RULE.format(2, "greaterThan", 1, "", "=15")}{RULE.format(1, "greaterThan", 0, 'stopIfTrue="1"', 25)}{RULE.format(3, "", 9, "", 10)}</conditionalFormatting>
<conditionalFormatting sqref="B2">{RULE.format(4, "equal", 1, "", 30)}</conditionalFormatting>
<dataValidations><dataValidation type="whole" sqref="A1" allowBlank="1"><formula1>1</formula1><formula2>9</formula2></dataValidation></dataValidations>
<hyperlinks><hyperlink ref="Z9" location="S!A1" display="far"/></hyperlinks><pageSetup orientation="landscape"/><headerFooter><oddHeader>&amp;P</oddHeader></headerFooter></worksheet>"""
SOURCE = XLSX | {
    "xl/styles.xml": STYLES, "xl/theme/theme1.xml": THEME, "xl/worksheets/sheet1.xml": SHEET,
    "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships {RELS}><Relationship Id="r1" Type="{TYPE}comments" Target="../comments1.xml"/><Relationship Id="r2" Type="http://x/threadedComment" Target="../threads1.xml"/></Relationships>',
    "xl/comments1.xml": f'<comments {X}><commentList><comment ref="A1"><text><t>note</t></text></comment></commentList></comments>',
    "xl/threads1.xml": '<ThreadedComments><threadedComment ref="B1"><text>reply</text></threadedComment><threadedComment ref="Q7"><text>lost</text></threadedComment></ThreadedComments>',
}


def converted():
    document = spreadsheet.convert(package(SOURCE), Limits())
    return document, {s["styleId"]: s for s in document["styles"]}, {(n["address"]["row"], n["address"]["column"]): n for n in document["nodes"] if n["kind"] == "cell"}


def source_of(styles, style, name):
    own = next(p for p in style["propertyProvenance"] if p["property"] == name)
    return styles[own["source"]]


def test_cell_formats_cascade():
    _, styles, cells = converted()
    first, second, third, fourth, fifth = (styles[cells[p]["directStyleId"]] for p in ((1, 1), (1, 2), (1, 3), (2, 1), (2, 2)))
    named = styles[first["basedOn"]]
    assert named["origin"] == "named" and named["name"] == "Own" and first["status"] == "normalized"
    assert first["resolved"]["fill"] == {"kind": "solid", "color": {"kind": "rgb", "r": 255, "g": 0, "b": 0, "a": "0.5019607843137254901960784314"}}
    assert source_of(styles, first, "fill") is named and source_of(styles, first, "numberFormat") is named and source_of(styles, first, "fontFamily")["origin"] == "component"
    assert first["resolved"]["numberFormat"]["code"] == "0.000" and second["resolved"]["numberFormat"]["code"] == "General"
    assert second["resolved"]["foreground"] == {"kind": "rgb", "r": 0, "g": 0, "b": 128, "a": 1} and second["declaration"]["foreground"] == {"kind": "theme", "slot": "theme:4"}
    assert second["resolved"]["weight"] == 700 and "italic" not in second["resolved"] and second["resolved"]["underline"] == "single" and second["resolved"]["strike"] is True
    assert second["resolved"]["fontSize"] == {"value": "11", "unit": "pt"} and source_of(styles, second, "fontSize") is styles[second["basedOn"]] and second["status"] == "ambiguous"
    assert second["resolved"]["borders"] == {"left": {"dash": "thin", "width": {"value": "0.5", "unit": "pt"}, "color": {"kind": "rgb", "r": 255, "g": 0, "b": 0, "a": 1}}, "top": {"dash": "dashed"}}
    assert second["resolved"]["paragraphAlignment"] == "center" and second["resolved"]["fill"] == {"kind": "none"}
    assert third["status"] == "ambiguous" and "basedOn" not in third
    assert fourth["declaration"]["fill"] == {"kind": "pattern", "color": {"kind": "theme", "slot": "indexed:64"}} and "fill" not in fourth["resolved"] and fourth["status"] == "ambiguous"
    assert fifth["status"] == "ambiguous" and set(fifth["resolved"]) == {"numberFormat"}
    assert "directStyleId" not in cells[2, 4]


def test_conditional_overlays():
    _, styles, cells = converted()
    overlay = {p: styles[n["resolvedStyleId"]] for p, n in cells.items() if n.get("resolvedStyleId") != n.get("directStyleId")}
    assert set(overlay) == {(1, 2), (2, 2)}  # A1 holds for a rule without a style only
    assert overlay[1, 2]["basedOn"] == cells[1, 2]["directStyleId"] and overlay[1, 2]["resolved"]["italic"] is True and [r["priority"] for r in overlay[1, 2]["conditional"]] == [2]
    last = overlay[2, 2]  # priority 1 stops its block; the later block overrides
    assert [r["priority"] for r in last["conditional"]] == [1, 4] and last["resolved"]["italic"] is True and last["resolved"]["fill"]["color"]["g"] == 255
    by = {p["property"]: p["source"] for p in last["propertyProvenance"]}
    assert by["weight"] == last["conditional"][1]["ruleId"] and by["fill"] == last["conditional"][0]["ruleId"] and cells[2, 2]["styleIds"] == [last["basedOn"], last["styleId"]]


def test_sheet_facts_and_comments():
    document, _, cells = converted()
    facts = {e["type"]: e["payload"] for e in document["extensions"]}
    assert facts["view"] == {"viewId": "0", "pane": {"xSplit": "1", "state": "frozen"}, "selection": [{"pane": "topLeft", "activeCell": "B2", "sqref": "B2:C3"}]}
    assert facts["data-validation"]["formulas"] == ["1", "9"] and facts["data-validation"]["allowBlank"] and facts["data-validation"]["operator"] == "between"
    assert facts["print-setup"] == {"pageSetup": {"orientation": "landscape"}, "headerFooter": {"oddHeader": "&P"}}
    assert [n["visibility"] for n in document["nodes"] if n["kind"] == "column"] == ["visible", "hidden", "hidden", "visible"]
    notes = {(a["kind"], a["body"]): a for a in document["annotations"]}
    assert notes["comment", "note"]["targetIds"] == [cells[1, 1]["nodeId"]] and notes["comment", "reply"]["targetIds"] == [cells[1, 2]["nodeId"]]
    assert notes["comment", "lost"]["targetIds"] == [] and notes["comment", "lost"]["place"] == {"address": "Q7", "resolved": False}
    assert notes["hyperlink", "#S!A1"]["displayText"] == "far"


def test_styled_documents_have_no_violations(spark):
    from factlattice.operators import facts, validation
    from factlattice.sources.ir import to_json

    document, _, _ = converted()
    entities = facts.entities(spark.createDataFrame([(document["documentId"], to_json(document))], "document_id string, ir_json string")).cache()
    fields = facts.flatten(entities).cache()
    assert validation.violations(entities, fields, facts.references(fields, entities)).collect() == []


def test_colours():
    theme = theme_colours(bounded_xml(THEME.encode(), Limits()))
    element = lambda text: bounded_xml(f"<color {text}/>".encode(), Limits())
    of = lambda text: sheet_styles.colour(element(text), theme)
    assert of('theme="1"')[1] == {"kind": "rgb", "r": 16, "g": 16, "b": 16, "a": 1} and of('theme="0"')[1]["r"] == 255
    assert of('rgb="12345"')[1] is None and of('rgb="12345"')[2] and of('theme="9"')[2] and of('auto="1"')[2] and of("")[:2] == (None, None)
    assert of('indexed="12"')[1] == of('rgb="0000FF"')[1] and json.dumps(of('indexed="16"')[0]) == '{"kind": "theme", "slot": "indexed:16"}'
