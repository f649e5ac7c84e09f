import zlib

import pytest

from factlattice.sources import pdf
from factlattice.sources.ir import Limits, SourceError, to_json

DRAWN = b"q 1 0 0 rg 0.5 G 2 w 1 J [3 1] 0 d 0 0 10 10 re B Q 5 5 m 9 9 l S 1 0 0 RG /X cs"


def stream(head: bytes, body: bytes) -> bytes:
    return b"<<%s/Length %d>>\nstream\n%s\nendstream" % (head, len(body), body)


OBJECTS = {
    1: b"<</Type/Catalog/Pages 2 0 R/Names<</Dests<</Names[(two)[7 0 R/XYZ 1 2 null]]>>>>>>", 2: b"<</Type/Pages/Kids[3 0 R 7 0 R]/Count 2/MediaBox[0 0 9 9]/Resources<</Font<</F1 5 0 R>>/XObject<</Im 99 0 R>>>>>>",
    3: b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Annots[6 0 R 8 0 R 9 0 R]>>", 4: stream(b"", DRAWN + b" % 3 0 obj <</Lost 1>>"), 5: b"<</Type/Font/Subtype/Type1/BaseFont/Own/Encoding/WinAnsiEncoding>>",
    6: b"<</Type/Annot/Subtype/Link/Rect[1 1 2 2]/QuadPoints[1 2 3 4 5 6 7 8]/Dest(two)>>", 7: b"<</Type/Page/Parent 2 0 R>>",
    8: b"<</Type/Annot/Subtype/Link/Rect[1 1 2 2]/A<</S/GoTo/D[3 0 R/Fit]>>>>", 9: b"<</Type/Annot/Subtype/Link/Rect[1 1 2 2]/Dest/nowhere>>",
}


def with_table(objects: dict[int, bytes], before: bytes = b"%PDF-1.4\n", previous: int | None = None, freed=(), more: bytes = b"") -> bytes:
    out, places = bytearray(before), {}
    for number, body in objects.items():
        places[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    at = len(out)
    out += b"xref\n"
    for number in sorted({*places, *freed, *(() if previous is not None else (0,))}):
        out += b"%d 1\n%010d %05d %s \n" % (number, places.get(number, 0), 0 if number in places else 65535, b"n" if number in places else b"f")
    prev = b"/Prev %d" % previous if previous is not None else b""
    return bytes(out + b"trailer <</Root 1 0 R/Size 20%s%s>>\nstartxref\n%d\n%%%%EOF\n" % (prev, more, at))


def test_tables_of_references():
    raw = with_table(OBJECTS)
    file = pdf.File(raw, Limits())
    assert file.authentic and sorted(file.objects) == list(range(1, 10)) and "Lost" not in file.objects[3]
    newer = with_table({5: b"<</Type/Font/BaseFont/Newer>>"}, raw, int(raw.rpartition(b"startxref\n")[2].split()[0]), freed=(9,))
    file = pdf.File(newer, Limits())
    assert file.authentic and file.objects[5]["BaseFont"] == "Newer" and 9 not in file.objects
    loop = raw.replace(b"/Size 20", b"/Prev %d/Size 20" % int(raw.rpartition(b"startxref\n")[2].split()[0]))
    for broken in (raw.replace(b"startxref", b"startxxxx"), raw.replace(b"%PDF-1.4\n", b"%PDF-1.4\n\n"), loop, raw[: raw.index(b"xref\n")]):
        file = pdf.File(broken, Limits())
        assert not file.authentic and sorted(file.objects) == list(range(1, 10)) and "Lost" not in file.objects[3]
    with pytest.raises(SourceError, match="encrypted"):
        pdf.File(with_table(OBJECTS, more=b"/Encrypt 5 0 R"), Limits())


@pytest.mark.parametrize("predictor", [1, 12])
def test_streams_of_references_and_objects(predictor):
    held = {5: OBJECTS[5], 6: OBJECTS[6]}
    heads, bodies = b"", b""
    for number, body in held.items():
        heads += b"%d %d " % (number, len(bodies))
        bodies += body + b" "
    packed = zlib.compress(heads + bodies)
    objects = {k: v for k, v in OBJECTS.items() if k not in held} | {10: stream(b"/Type/ObjStm/N 2/First %d/Filter/FlateDecode" % len(heads), packed)}
    out, places = bytearray(b"%PDF-1.5\n5 0 obj <</Old 1>> endobj\n"), {}
    for number, body in objects.items():
        places[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    at, rows = len(out), []
    for number in range(12):
        kind, where, place = (2, 10, list(held).index(number)) if number in held else (1, at if number == 11 else places[number], 0) if number else (0, 0, 0)
        rows.append(bytes([kind]) + where.to_bytes(2) + bytes([place]))
    if predictor == 12:
        rows = [b"\2" + bytes((a - b) & 255 for a, b in zip(row, above)) for row, above in zip(rows, [bytes(4), *rows])]
    out += b"11 0 obj\n" + stream(b"/Type/XRef/Size 12/Root 1 0 R/W[1 2 1]/Filter/FlateDecode/DecodeParms<</Predictor %d/Columns 4>>" % predictor, zlib.compress(b"".join(rows))) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % at
    file = pdf.File(bytes(out), Limits())
    assert file.authentic and file.objects[5]["BaseFont"] == "Own" and len(file.pages()) == 2
    scanned = pdf.File(bytes(out).replace(b"startxref", b"startxxxx"), Limits())
    assert not scanned.authentic and scanned.objects[5]["BaseFont"] == "Own"


def test_row_filters():
    rows = [bytes([7, 1, 2, 9]), bytes([3, 250, 0, 5]), bytes([8, 8, 1, 1])]
    for kind in range(5):
        coded, above = b"", bytes(4)
        for row in rows:
            line = []
            for i, x in enumerate(row):
                a, b, c = row[i - 1] if i else 0, above[i], above[i - 1] if i else 0
                p = a + b - c
                paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                line.append((x - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
            coded, above = coded + bytes([kind, *line]), row
        assert pdf.unpredicted(coded, {"Predictor": 15, "Columns": 4}) == b"".join(rows)
    assert pdf.unpredicted(b"\0abc", {"Predictor": 15, "Columns": 4}) is None and pdf.unpredicted(b"", {"Predictor": 2}) is None


def test_paint_fonts_destinations_and_graph(spark):
    document = pdf.convert(with_table(OBJECTS), Limits())
    paint = [e["payload"] for e in document["extensions"] if e["type"] == "paint"]
    first, second = paint[0]["state"], paint[1]["state"]
    assert paint[0]["operator"] == "B" and first["fillColor"] == ["1", "0", "0"] and first["strokeColor"] == ["0.5"] and first["lineWidth"] == "2" and first["lineCap"] == 1 and first["dashPattern"] == {"array": ["3", "1"], "phase": "0"}
    assert second["fillColor"] == ["0"] and second["lineWidth"] == "1"  # as before q
    assert any("operator cs" in d["message"] for d in document["diagnostics"])
    fonts = [r for r in document["resources"] if r["kind"] == "font"]
    assert [(f["name"], f["subtype"], f["encoding"], f["availability"]) for f in fonts] == [("Own", "Type1", "WinAnsiEncoding", "missing")]
    pages = [e["payload"] for e in document["extensions"] if e["type"] == "page-resources"]
    assert pages[0] == pages[1] == {"fonts": [{"name": "F1", "resourceId": fonts[0]["resourceId"]}], "names": {"XObject": ["Im"]}}
    surfaces = [s["surfaceId"] for s in document["surfaces"]]
    assert [a["destination"] for a in document["annotations"]] == [{"name": "two", "surfaceId": surfaces[1], "view": "XYZ", "position": ["1", "2", None]}, {"surfaceId": surfaces[0], "view": "Fit", "position": []}, {"name": "nowhere"}]
    assert document["annotations"][0]["quadPoints"] == list("12345678") and [a["status"] for a in document["annotations"]] == ["preserved", "preserved", "ambiguous"]
    names = {p["partId"]: p["name"] for p in document["parts"] if p["kind"] == "object"} | {r["resourceId"]: r["derivedHandle"] for r in document["resources"] if r["kind"] == "embeddedObject"}
    edges = {(names[r["fromId"]], names[r["toId"]], r["status"]) for r in document["relations"]}
    assert ("3 0 obj", "4 0 obj", "preserved") in edges and ("2 0 obj", "99 0 R", "unavailable") in edges and len(edges) == len(document["relations"])
    assert any(f["feature"] == "cross-reference" and f["status"] == "preserved" for f in document["conversion"]["features"])

    from factlattice.operators import facts, validation

    entities = facts.entities(spark.createDataFrame([(document["documentId"], to_json(document))], "document_id string, ir_json string")).cache()
    fields = facts.flatten(entities).cache()
    assert validation.violations(entities, fields, facts.references(fields, entities)).collect() == []
