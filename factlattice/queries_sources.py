"""Driver queries over files made of the table of parts: one Markdown, XLSX, DOCX and PDF file for each, converted by the library."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlattice.operators import facts
from factlattice.operators.trees import written
from factlattice.queries import _query, _read
from factlattice.sources.convert import convert_entities

_SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:wp="http://wp" xmlns:a="http://a"'
_KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


def _package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def _relations(*rows: tuple[str, str, str]) -> str:
    listed = "".join(f'<Relationship Id="{i}" Type="{_KIND}{kind}" Target="{target}"/>' for i, kind, target in rows)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{listed}</Relationships>'


def _markdown(key: int, name: str, brand: str, size: int, price: float) -> bytes:
    return (
        f"---\ntitle: {name}\nsize: {size}\n---\n# {brand} *{name}*\n\nset {size}\n{('=' if size % 2 else '-') * 3}\n\n- one {size}\n  - [{'x' if size % 3 else ' '}] two\n\n```py\nx = {size}\n```\n\n"
        f"| a | b | c |\n|:-|-:|:-:|\n| {size} | [l](http://x.example/{key}) | `p|q` |\n\n> see [ref] and ![i](i{key}.png)\n\n***\n\n[ref]: b{key}.md\n[Ref]: c.md\n" + ("~~~\nopen\n" if size % 5 == 0 else "")
    ).encode()


def _xlsx(key: int, name: str, brand: str, size: int, price: float) -> bytes:
    styles = f"""<styleSheet {_SHEET}><fonts><font><sz val="11"/></font><font><b/><color theme="4" tint="-0.5"/></font></fonts><fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor indexed="10"/></patternFill></fill></fills>
      <borders><border/></borders><cellStyleXfs><xf numFmtId="0" fillId="1"/></cellStyleXfs><cellXfs><xf/><xf numFmtId="14" xfId="0" fontId="1" applyFill="0"/><xf numFmtId="4"/></cellXfs><dxfs><dxf><font><i/></font></dxf></dxfs></styleSheet>"""
    rule = '<conditionalFormatting sqref="B1:C1"><cfRule type="cellIs" priority="1" operator="greaterThan" dxfId="0"><formula>25</formula></cfRule></conditionalFormatting>'
    sheet = f"""<worksheet {_SHEET}><cols><col min="2" max="2" hidden="{size % 2}"/></cols><sheetData><row r="1"><c r="A1" t="s"><v>{size % 3}</v></c><c r="B1"><v>{size}</v></c><c r="C1" s="1"><v>{size * 100}</v></c><c r="D1" s="2"><f>B1*2</f><v>{price:.2f}</v></c></row>
      <row r="2" hidden="1"><c r="A2" t="b"><v>{size % 2}</v></c><c r="B2" t="e"><v>#N/A</v></c></row></sheetData><mergeCells><mergeCell ref="A2:B2"/></mergeCells>{rule}</worksheet>"""
    return _package({
        "xl/workbook.xml": f'<workbook {_SHEET}><sheets><sheet name="{escape(name)}" sheetId="1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": _relations(("r1", "worksheet", "worksheets/s.xml")),
        "xl/sharedStrings.xml": f"<sst {_SHEET}><si><t>{escape(name)}</t></si><si><r><t>{escape(brand)}</t></r><r><t>!</t></r></si></sst>", "xl/styles.xml": styles,
        "xl/theme/theme1.xml": '<a:theme xmlns:a="http://a"><a:clrScheme><a:accent1><a:srgbClr val="0000FF"/></a:accent1></a:clrScheme></a:theme>', "xl/worksheets/s.xml": sheet,
        "xl/worksheets/_rels/s.xml.rels": _relations(("r1", "comments", "../comments.xml")), "xl/comments.xml": f'<comments {_SHEET}><commentList><comment ref="{"A1" if size % 2 else "Z9"}"><text><t>{escape(brand)}</t></text></comment></commentList></comments>',
    })


def _docx(key: int, name: str, brand: str, size: int, price: float) -> bytes:
    styles = f'<w:styles {_WORD}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="20"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:styleId="Base"><w:rPr><w:b/></w:rPr></w:style><w:style w:styleId="Own"><w:basedOn w:val="{"Base" if size % 3 else "Gone"}"/><w:rPr><w:i/></w:rPr></w:style></w:styles>'
    field = '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> PAGE </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>{}</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r>'
    merge = lambda kind: f'<w:tc><w:tcPr><w:vMerge w:val="{kind}"/></w:tcPr><w:p/></w:tc>'
    drawing = f'<w:r><w:drawing><wp:anchor relativeHeight="{size}"><wp:positionH relativeFrom="{"page" if size % 2 else "character"}"><wp:posOffset>{size}</wp:posOffset></wp:positionH><wp:extent cx="{size}" cy="2"/><wp:wrapNone/><a:pic><a:xfrm rot="5400000"/></a:pic></wp:anchor></w:drawing></w:r>'
    body = f"""<w:p><w:pPr><w:pStyle w:val="Own"/><w:jc w:val="center"/></w:pPr><w:r><w:rPr><w:b w:val="0"/><w:color w:val="0000{size:02X}"/></w:rPr><w:t>{escape(name)}</w:t></w:r></w:p><w:p>{field.format(size)}{drawing}</w:p>
      <w:p><w:ins w:author="x"><w:r><w:t>new</w:t></w:r></w:ins><w:pPr><w:sectPr><w:pgSz w:w="{size}" w:h="9"/></w:sectPr></w:pPr></w:p>
      <w:tbl><w:tblGrid><w:gridCol w:w="5"/></w:tblGrid><w:tr>{merge("restart")}</w:tr><w:tr>{merge("continue" if size % 2 else "restart")}</w:tr></w:tbl><w:sectPr><w:pgSz w:orient="landscape"/></w:sectPr>"""
    return _package({
        "_rels/.rels": _relations(("r1", "officeDocument", "word/document.xml")), "word/_rels/document.xml.rels": _relations(("r1", "styles", "styles.xml"), ("r2", "comments", "comments.xml")), "word/styles.xml": styles,
        "word/comments.xml": f'<w:comments {_WORD}><w:comment w:id="1"><w:p><w:r><w:t>{escape(brand)}</w:t></w:r></w:p></w:comment></w:comments>', "word/document.xml": f"<w:document {_WORD}><w:body>{body}</w:body></w:document>",
    })


def _pdf(key: int, name: str, brand: str, size: int, price: float) -> bytes:
    drawn = f"q 1 0 0 1 {size} 0 cm 0 0 {size} 5 re 0 0 1 rg f Q 2 w 0 0 m 3 4 l S BT /F1 {size + 1} Tf {key} 7 Td ({name}) Tj /F2 2 Tf <0{size % 2 + 1}> Tj ET".encode()
    cmap, target = b"1 beginbfchar <01> <0041> endbfchar", b"/Dest[3 0 R/Fit]" if size % 3 else b"/A<</S/URI/URI(http://x.example/%d)>>" % key
    stream = lambda b: b"<</Length %d>>\nstream\n%s\nendstream" % (len(b), b)
    objects = [
        b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R%s]/Count 1/MediaBox[0 0 %d 9]/Resources<</Font<</F1 5 0 R/F2 6 0 R>>>>>>" % (b" 9 0 R" if size % 2 else b"", size),
        b"<</Type/Page/Contents 4 0 R/Annots[8 0 R]>>", stream(drawn), b"<</Type/Font/BaseFont/One>>", b"<</Type/Font/BaseFont/Two/ToUnicode 7 0 R>>", stream(cmap), b"<</Type/Annot/Subtype/Link/Rect[9 8 %d 6]%s>>" % (size, target), b"<</Type/Page>>",
    ]
    out, places = bytearray(b"%PDF-1.4\n"), []
    for k, o in enumerate(objects):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k + 1, o)
    at = len(out)
    rows = b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"xref\n0 %d\n0000000000 65535 f \n%strailer <</Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, rows, at if key % 10 else 0))


MAKERS = {"md": _markdown, "xlsx": _xlsx, "docx": _docx, "pdf": _pdf}


def made_files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(path, content): the file of each part; its path begins with the part's key."""

    def run(batches):
        for batch in facts.sliced(batches, 256):
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            yield pa.RecordBatch.from_arrays([pa.array([f"{r[0]}.{kind}" for r in rows], pa.string()), pa.array([MAKERS[kind](*r) for r in rows], pa.binary())], ["path", "content"])

    parts = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    return parts.repartition(spark.sparkContext.defaultParallelism, "p_partkey").mapInArrow(run, "path string, content binary")  # a small table that much work is done for each row of


def made_entities(spark: SparkSession, sf_dir: str, kind: str, *collections: str) -> DataFrame:
    """Entities of the collections (all if none is named) with the part that they come from, each file converted once.

    Documents are named by their part, as equal files would be one document.
    """
    found = convert_entities(made_files(spark, sf_dir, kind), list(collections) or None)
    key = F.regexp_extract("path", "^[0-9]+", 0)
    payload = F.when(F.col("collection") == facts.DOCUMENT, F.regexp_replace("payload", '"documentId":"[^"]*"', F.concat(F.lit('"documentId":"'), key, F.lit('"')))).otherwise(F.col("payload"))
    return written(found.select(key.cast("long").alias("p_partkey"), "outcome", key.alias("document_id"), "collection", "entity_id", "kind", "status", "ordinal", payload.alias("payload")), "made")


def _at(path: str) -> Column:
    return F.get_json_object("payload", f"$.{path}")


def _extensions(spark: SparkSession, sf_dir: str, kind: str, name: str) -> DataFrame:
    return made_entities(spark, sf_dir, kind, "extensions").filter(_at("type") == name)


def _texts_of(entities: DataFrame, kind: str, representation: str = "source") -> DataFrame:
    """(p_partkey, ordinal, payload, value): nodes of a kind with their own text of a representation."""
    nodes = entities.filter((F.col("collection") == "nodes") & (F.col("kind") == kind)).select("p_partkey", "ordinal", "payload", F.explode(F.from_json(_at("textIds"), "array<string>")).alias("entity_id"))
    texts = entities.filter(F.col("collection") == "texts").filter(_at("representation") == representation).select("p_partkey", "entity_id", _at("value").alias("value"))
    return nodes.join(texts, ["p_partkey", "entity_id"])


# ---- Markdown ----


@_query("markdown_outcomes", "SELECT p_partkey, 'partial' AS outcome FROM part")
def _(spark, sf_dir):
    return made_entities(spark, sf_dir, "md", facts.DOCUMENT).select("p_partkey", "outcome")


@_query("markdown_front_matter", "SELECT p_partkey, unnest(['title', 'size']) AS key, unnest([p_name, p_size::VARCHAR]) AS value FROM part")
def _(spark, sf_dir):
    rows = _extensions(spark, sf_dir, "md", "front-matter")
    return rows.select("p_partkey", F.inline(F.from_json(_at("payload.entries"), "array<struct<key:string,value:string>>")))


@_query("markdown_headings", "SELECT p_partkey, 1 AS level, 'atx' AS style FROM part UNION ALL SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN 1 ELSE 2 END, 'setext' FROM part")
def _(spark, sf_dir):
    return _extensions(spark, sf_dir, "md", "heading-authoring").select("p_partkey", _at("payload.level").cast("int").alias("level"), _at("payload.style").alias("style"))


@_query("markdown_list_items", "SELECT p_partkey, '-' AS marker, 1 AS level, NULL::BOOLEAN AS checked FROM part UNION ALL SELECT p_partkey, '-', 2, p_size % 3 <> 0 FROM part")
def _(spark, sf_dir):
    return _extensions(spark, sf_dir, "md", "list-marker").select("p_partkey", _at("payload.marker").alias("marker"), _at("payload.level").cast("int").alias("level"), _at("payload.checked").cast("boolean").alias("checked"))


@_query("markdown_table_cells", "SELECT p_partkey, 2 AS row, unnest([1, 2, 3]) AS col, unnest([p_size::VARCHAR, '[l](http://x.example/' || p_partkey || ')', '`p|q`']) AS value FROM part UNION ALL SELECT p_partkey, 1, unnest([1, 2, 3]), unnest(['a', 'b', 'c']) FROM part")
def _(spark, sf_dir):
    e = made_entities(spark, sf_dir, "md", "nodes", "texts")
    cells = e.filter("kind = 'cell'").select("p_partkey", F.col("entity_id").alias("cell"), _at("address.row").cast("int").alias("row"), _at("address.column").cast("int").alias("col"))
    runs = _texts_of(e, "run").select("p_partkey", _at("parentId").alias("cell"), "value")
    return cells.join(runs, ["p_partkey", "cell"]).select("p_partkey", "row", "col", "value")


@_query("markdown_links", "SELECT p_partkey, unnest(['md-inline-external', 'md-reference-link', 'md-local-image']) AS occurrence, unnest(['http://x.example/' || p_partkey, 'b' || p_partkey || '.md', 'i' || p_partkey || '.png']) AS target, unnest(['external', 'internal', 'internal']) AS mode FROM part")
def _(spark, sf_dir):
    return made_entities(spark, sf_dir, "md", "relations").select("p_partkey", _at("sourceOccurrenceId").alias("occurrence"), _at("target").alias("target"), _at("targetMode").alias("mode"))


@_query("markdown_normalized", "SELECT p_partkey, p_name AS value FROM part UNION ALL SELECT p_partkey, unnest(['l', 'p|q', 'ref', 'i']) FROM part")
def _(spark, sf_dir):
    return _texts_of(made_entities(spark, sf_dir, "md", "nodes", "texts"), "run", "normalized").select("p_partkey", "value")


@_query("markdown_lost", "SELECT p_partkey, 'definition' AS feature, 'ambiguous' AS status FROM part UNION ALL SELECT p_partkey, 'code', 'unsupported' FROM part WHERE p_size % 5 = 0")
def _(spark, sf_dir):
    rows = made_entities(spark, sf_dir, "md", facts.DOCUMENT)
    found = rows.select("p_partkey", F.inline(F.from_json(_at("conversion.features"), "array<struct<feature:string,status:string>>")))
    return found.filter("status != 'preserved'")


# ---- XLSX ----


@_query("xlsx_cells", """SELECT p_partkey, 'A1' AS cell, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand || '!' END AS value, CASE WHEN p_size % 3 < 2 THEN 'string' ELSE 'blank' END AS type FROM part UNION ALL SELECT p_partkey, 'B1', p_size::VARCHAR, 'integer' FROM part
UNION ALL SELECT p_partkey, 'C1', ((DATE '1899-12-30' + p_size * 100 + CASE WHEN p_size * 100 < 60 THEN 1 ELSE 0 END)::DATE)::VARCHAR, 'date' FROM part UNION ALL SELECT p_partkey, 'A2', CASE WHEN p_size % 2 = 1 THEN 'true' ELSE 'false' END, 'boolean' FROM part UNION ALL SELECT p_partkey, 'B2', '#N/A', 'error' FROM part""")
def _(spark, sf_dir):
    cells = made_entities(spark, sf_dir, "xlsx", "nodes").filter("kind = 'cell'")
    cell = F.concat(F.element_at(F.array(*map(F.lit, "ABCD")), _at("address.column").cast("int")), _at("address.row"))
    return cells.select("p_partkey", cell.alias("cell"), _at("value.value").alias("value"), _at("value.type").alias("type")).filter("cell != 'D1'")


@_query("xlsx_formulas", "SELECT p_partkey, 'B1*2' AS source, 'unavailable' AS computed, replace(format('{:,.2f}', p_retailprice), '_', '') AS displayed FROM part")
def _(spark, sf_dir):
    return made_entities(spark, sf_dir, "xlsx", "formulas").select("p_partkey", _at("expression.source").alias("source"), _at("values.computed.status").alias("computed"), _at("values.displayed.text").alias("displayed"))


@_query("xlsx_conditional_styles", "SELECT p_partkey, 'B' AS col, 'true' AS italic FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 'C', 'true' FROM part WHERE p_size * 100 > 25")
def _(spark, sf_dir):
    e = made_entities(spark, sf_dir, "xlsx", "nodes", "styles")
    styles = e.filter("collection = 'styles'").filter((_at("origin") == "conditional") & _at("basedOn").isNotNull()).select("p_partkey", F.col("entity_id").alias("style"), _at("resolved.italic").alias("italic"))
    cells = e.filter("kind = 'cell'").select("p_partkey", F.element_at(F.array(*map(F.lit, "ABCD")), _at("address.column").cast("int")).alias("col"), _at("resolvedStyleId").alias("style"))
    return cells.join(styles, ["p_partkey", "style"]).select("p_partkey", "col", "italic")


@_query("xlsx_cell_styles", "SELECT p_partkey, 700 AS weight, 128 AS blue, 'mm-dd-yy' AS code, 255 AS red FROM part")
def _(spark, sf_dir):
    """The format of dates: its own font with a tinted theme colour, the fill of the named format that it is based on."""
    rows = made_entities(spark, sf_dir, "xlsx", "styles").filter((_at("origin") == "resolved") & (_at("resolved.numberFormat.code") == "mm-dd-yy"))
    whole = lambda path: _at(f"resolved.{path}").cast("int")
    return rows.select("p_partkey", whole("weight").alias("weight"), whole("foreground.b").alias("blue"), _at("resolved.numberFormat.code").alias("code"), whole("fill.color.r").alias("red"))


@_query("xlsx_grid", "SELECT p_partkey, 'row' AS kind, unnest(['visible', 'hidden']) AS visibility FROM part UNION ALL SELECT p_partkey, 'column', unnest(['visible', CASE WHEN p_size % 2 = 1 THEN 'hidden' ELSE 'visible' END, 'visible', 'visible']) FROM part")
def _(spark, sf_dir):
    return made_entities(spark, sf_dir, "xlsx", "nodes").filter("kind IN ('row', 'column')").select("p_partkey", "kind", _at("visibility").alias("visibility"))


@_query("xlsx_merges", "SELECT p_partkey, unnest(['1', '2']) AS col, unnest(['master', 'follower']) AS role FROM part")
def _(spark, sf_dir):
    return made_entities(spark, sf_dir, "xlsx", "nodes").filter(_at("mergeRole").isNotNull()).select("p_partkey", _at("address.column").alias("col"), _at("mergeRole").alias("role"))


@_query("xlsx_comments", "SELECT p_partkey, p_brand AS body, CASE WHEN p_size % 2 = 1 THEN 'A1' ELSE 'Z9' END AS address, p_size % 2 = 1 AS resolved FROM part")
def _(spark, sf_dir):
    return made_entities(spark, sf_dir, "xlsx", "annotations").select("p_partkey", _at("body").alias("body"), _at("place.address").alias("address"), _at("place.resolved").cast("boolean").alias("resolved"))


# ---- DOCX ----


@_query("docx_texts", "SELECT p_partkey, p_name AS value FROM part UNION ALL SELECT p_partkey, p_size::VARCHAR FROM part UNION ALL SELECT p_partkey, 'new' FROM part UNION ALL SELECT p_partkey, p_brand FROM part")
def _(spark, sf_dir):
    return _texts_of(made_entities(spark, sf_dir, "docx", "nodes", "texts"), "run").select("p_partkey", "value")


@_query("docx_run_styles", "SELECT p_partkey, 'false' AS bold, 'true' AS italic, 'center' AS align, '10' AS size, p_size AS blue, CASE WHEN p_size % 3 = 0 THEN 'ambiguous' ELSE 'normalized' END AS status FROM part")
def _(spark, sf_dir):
    """The run of the first paragraph: its own format over that of the paragraph, over the chain of styles, over the defaults."""
    rows = made_entities(spark, sf_dir, "docx", "styles").filter((_at("role") == "run") & (_at("origin") == "resolved"))
    return rows.select("p_partkey", *(_at(f"resolved.{k}").alias(k) for k in ("bold", "italic", "align", "size")), _at("resolved.color.b").cast("int").alias("blue"), "status")


@_query("docx_fields", "SELECT p_partkey, 'PAGE' AS instruction, p_size::VARCHAR AS result FROM part")
def _(spark, sf_dir):
    e = made_entities(spark, sf_dir, "docx", "fields", "texts")
    text = lambda name: e.filter("collection = 'texts'").select("p_partkey", F.col("entity_id").alias(f"{name}_id"), _at("value").alias(name))
    fields = e.filter("collection = 'fields'").select("p_partkey", _at("instructionTextId").alias("instruction_id"), _at("resultTextId").alias("result_id"))
    return fields.join(text("instruction"), ["p_partkey", "instruction_id"]).join(text("result"), ["p_partkey", "result_id"]).select("p_partkey", "instruction", "result")


@_query("docx_vertical_merges", "SELECT p_partkey, unnest(['1', '2']) AS row, unnest(['master', CASE WHEN p_size % 2 = 1 THEN 'follower' ELSE 'master' END]) AS role FROM part")
def _(spark, sf_dir):
    return made_entities(spark, sf_dir, "docx", "nodes").filter("kind = 'cell'").select("p_partkey", _at("address.row").alias("row"), _at("mergeRole").alias("role"))


@_query("docx_drawings", "SELECT p_partkey, p_size AS z, CASE WHEN p_size % 2 = 1 THEN 'page' ELSE 'paragraph' END AS anchor, 'none' AS wrap, '1' AS b FROM part")
def _(spark, sf_dir):
    return made_entities(spark, sf_dir, "docx", "layouts").select("p_partkey", _at("zIndex").cast("int").alias("z"), _at("anchor.kind").alias("anchor"), _at("wrap").alias("wrap"), _at("transform.b").alias("b"))


@_query("docx_sections", "SELECT p_partkey, 'portrait' AS orient, p_size::VARCHAR AS w FROM part UNION ALL SELECT p_partkey, 'landscape', NULL FROM part")
def _(spark, sf_dir):
    return _extensions(spark, sf_dir, "docx", "section-page-properties").select("p_partkey", _at("payload.pgSz.orient").alias("orient"), _at("payload.pgSz.w").alias("w"))


@_query("docx_annotations", "SELECT p_partkey, 'comment' AS kind, 1 AS n FROM part")
def _(spark, sf_dir):
    return made_entities(spark, sf_dir, "docx", "annotations").groupBy("p_partkey", "kind").agg(F.count(F.lit(1)).cast("int").alias("n"))


# ---- PDF ----


@_query("pdf_glyphs", "SELECT p_partkey, p_name AS value, 'approximated' AS status, p_partkey::VARCHAR AS x FROM part UNION ALL SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'A' END, CASE WHEN p_size % 2 = 0 THEN 'approximated' ELSE 'ambiguous' END, p_partkey::VARCHAR FROM part")
def _(spark, sf_dir):
    """The second string is mapped for codes of even sizes only; an unmapped one has no text at all."""
    e = made_entities(spark, sf_dir, "pdf", "nodes", "texts", "geometries")
    glyphs = e.filter("kind = 'glyph'").select("p_partkey", "status", _at("geometryId").alias("geometry"), F.from_json(_at("textIds"), "array<string>")[0].alias("text"))
    boxes = e.filter("collection = 'geometries'").select("p_partkey", F.col("entity_id").alias("geometry"), _at("primitives[0].x").alias("x"))
    texts = e.filter("collection = 'texts'").select("p_partkey", F.col("entity_id").alias("text"), _at("value").alias("value"))
    return glyphs.join(boxes, ["p_partkey", "geometry"]).join(texts, ["p_partkey", "text"], "left").select("p_partkey", "value", "status", "x")


@_query("pdf_paint", "SELECT p_partkey, 'f' AS operator, '[\"0\",\"0\",\"1\"]' AS fill, '1' AS width FROM part UNION ALL SELECT p_partkey, 'S', '[\"0\"]', '2' FROM part")
def _(spark, sf_dir):
    return _extensions(spark, sf_dir, "pdf", "paint").select("p_partkey", _at("payload.operator").alias("operator"), _at("payload.state.fillColor").alias("fill"), _at("payload.state.lineWidth").alias("width"))


@_query("pdf_pages", "SELECT p_partkey, i::INTEGER AS ordinal, p_size::VARCHAR AS width FROM part, range(2) AS t(i) WHERE i = 0 OR p_size % 2 = 1")
def _(spark, sf_dir):
    return made_entities(spark, sf_dir, "pdf", "surfaces").select("p_partkey", F.col("ordinal"), _at("box[2]").alias("width"))


@_query("pdf_links", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'http://x.example/' || p_partkey ELSE '' END AS body, CASE WHEN p_size % 3 <> 0 THEN 'Fit' END AS view FROM part")
def _(spark, sf_dir):
    return made_entities(spark, sf_dir, "pdf", "annotations").select("p_partkey", _at("body").alias("body"), _at("destination.view").alias("view"))


@_query("pdf_cross_references", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'ambiguous' ELSE 'preserved' END AS status FROM part")
def _(spark, sf_dir):
    rows = made_entities(spark, sf_dir, "pdf", facts.DOCUMENT).select("p_partkey", F.inline(F.from_json(_at("conversion.features"), "array<struct<feature:string,status:string>>")))
    return rows.filter("feature = 'cross-reference'").drop("feature")


@_query("pdf_object_graph", "SELECT p_partkey, 9::BIGINT AS objects, (7 + CASE WHEN p_size % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN p_size % 3 <> 0 THEN 1 ELSE 0 END)::BIGINT AS refs FROM part")
def _(spark, sf_dir):
    e = made_entities(spark, sf_dir, "pdf", "parts", "relations")
    return e.groupBy("p_partkey").agg(F.count_if(F.col("kind") == "object").alias("objects"), F.count_if(F.col("kind") == "references").alias("refs"))
