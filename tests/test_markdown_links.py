from factlattice.sources import markdown
from factlattice.sources.ir import Limits, to_json

TEXT = "# Ünï *head*\r\n\r\n> see [one](http://x.example/a) and\r\n> [two](b.md), [one again](http://x.example/a)\r\n\r\n| a | ![p](pic.png) |\r\n|---|---|\r\n| <http://auto.example> | [r] |\r\n\r\n[r]: ftp://host/file\r\n\r\n![d](data:image/png;base64,AAAA) [r] [none]\r\n"


def converted(raw: bytes = TEXT.encode()):
    document = markdown.convert(raw, Limits())
    texts = {t["textId"]: t["value"] for t in document["texts"]}
    return document, {n["nodeId"]: texts[n["textIds"][0]] for n in document["nodes"] if n["kind"] == "run"}


def test_links_are_resources_and_relations():
    document, runs = converted()
    resources = {r["resourceId"]: r for r in document["resources"]}
    found = [(runs[r["fromId"]], r["sourceOccurrenceId"], r["targetMode"], resources[r["toId"]]["derivedHandle"]) for r in document["relations"]]
    assert found == [
        ("[one](http://x.example/a)", "md-inline-external", "external", "http://x.example/a"), ("[two](b.md)", "md-inline-internal", "internal", "b.md"),
        ("[one again](http://x.example/a)", "md-inline-external-2", "external", "http://x.example/a"), ("![p](pic.png)", "md-local-image", "internal", "pic.png"),
        ("<http://auto.example>", "md-autolink", "external", "http://auto.example"), ("[r]", "md-reference-link", "external", "ftp://host/file"),
        ("![d](data:image/png;base64,AAAA)", "md-external-image", "external", "data:image/png"), ("[r]", "md-reference-link-2", "external", "ftp://host/file"),
    ]
    assert len(resources) == 6 and len(document["observations"]) == 6
    media = {r["derivedHandle"]: (r["kind"], r["mediaType"]) for r in resources.values()}
    assert media["pic.png"] == ("image", "image/png") and media["data:image/png"] == ("image", "image/png") and media["b.md"] == ("link", "application/octet-stream")


def test_runs_have_spans():
    for raw in (TEXT.encode(), b"\xef\xbb\xbf" + TEXT.encode(), TEXT.replace("\r\n", "\n").encode(), TEXT.replace("\r\n", "\r").encode()):
        document, runs = converted(raw)
        text, spans = raw.decode("utf-8-sig"), {m["targetId"]: m["locator"] for m in document["sourceMaps"] if m["targetId"] in runs}
        assert set(spans) == set(runs)
        same = lambda x: x.replace("\r\n", "\n").replace("\r", "\n").replace("\n> ", "\n")
        for run, at in spans.items():
            assert same(text[at["start"] : at["end"]]) == runs[run] and raw[at["byteStart"] : at["byteEnd"]].decode() == text[at["start"] : at["end"]]
        places = [spans[n["nodeId"]]["start"] for n in document["nodes"] if n["nodeId"] in runs]
        assert places == sorted(places)


def test_linked_documents_have_no_violations(spark):
    from factlattice.operators import facts, validation

    document, _ = converted()
    entities = facts.entities(spark.createDataFrame([(document["documentId"], to_json(document))], "document_id string, ir_json string")).cache()
    fields = facts.flatten(entities).cache()
    assert validation.violations(entities, fields, facts.references(fields, entities)).collect() == []
