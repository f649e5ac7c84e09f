"""A thin command line over folders of files, of documents (JSON lines) and of indexes; rows are printed as JSON."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from factlattice.operators import facts, index, query, trees, validation
from factlattice.operators.canonical import PROJECTIONS, canonical_documents
from factlattice.plans.contract import DEFAULT_PAGE, OPERATORS, QueryError
from factlattice.plans.document import coverage, document_contract, document_profiles
from factlattice.sources import sinks
from factlattice.sources.convert import convert_files, inspect_files, read_files

#: Verbs on documents, with the options that each takes; those with an equals sign have a default.
VERBS = {
    "check": "", "digest": "projection=full", "list": "collection kind status id offset limit profile", "list-nodes": "kind part-id status", "page": "collection kind status profile limit cursor",
    "entity": "collection id document", "field": "collection id pointer document", "document-field": "document pointer",
    "query-fields": "pointer value operator=eq collection kind status profile namespace extension-type schema-version", "coverage": "",
    "text": "node representation=source scope=descendants", "descendants": "node", "ancestors": "node", "references": "target source collection pointer", "relations": "kind from to",
    "extensions": "namespace type target schema-version", "observations": "target kind", "build-index": "index", "check-index": "index version",
}
CHOICES = {"projection": PROJECTIONS, "representation": query.REPRESENTATIONS, "scope": ("direct", "descendants"), "operator": OPERATORS}
NEEDED = {
    "page": "collection", "entity": "collection id", "field": "collection id pointer", "document-field": "document pointer", "query-fields": "pointer", "text": "node", "descendants": "node", "ancestors": "node",
    "build-index": "index", "check-index": "index version",
}


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="factlattice", description=__doc__)
    verbs = main.add_subparsers(dest="verb", required=True)
    convert = verbs.add_parser("convert", help="files to documents and evidence")
    convert.add_argument("source")
    convert.add_argument("target")
    verbs.add_parser("inspect", help="what files hold").add_argument("source")
    for name, options in VERBS.items():
        verb = verbs.add_parser(name)
        verb.add_argument("documents", help="a folder of JSON lines")
        for option in options.split():
            key, _, default = option.partition("=")
            verb.add_argument(f"--{key}", choices=CHOICES.get(key), default=default or None, type=int if key in ("offset", "limit") else str, required=key in NEEDED.get(name, "").split())
    return main


def _value(text: str | None):
    """A value of the command line: JSON, or else the text itself."""
    try:
        return json.loads(text)
    except ValueError:
        return text


class Tables:
    """The tables of a folder of documents, made when they are asked for."""

    def __init__(self, spark: SparkSession, path: str):
        self.documents, self.quarantined = facts.load_documents(spark.read.text(path))
        self.entities = facts.entities(self.documents)
        self.fields = facts.flatten(self.entities)
        self.references = facts.references(self.fields, self.entities)
        self.profiles = document_profiles(self.fields)

    def below(self, node: str) -> tuple[DataFrame, DataFrame]:
        """The node itself in each document that has it, and everything below it."""
        roots = self.entities.filter((self.entities.collection == "nodes") & (self.entities.entity_id == node)).selectExpr("document_id", "entity_id AS root_id")
        return roots, trees.descendants(trees.node_edges(self.references), roots).orderBy("document_id", "depth", "path")


def answer(t: Tables, a: argparse.Namespace) -> DataFrame:
    """The rows of a verb that only reads."""
    contract = document_contract()
    known = {"profile": getattr(a, "profile", None), "profiles": t.profiles}
    if a.verb == "list":
        return query.list_entities(t.entities, a.collection, a.kind, a.status, a.id, a.offset or 0, a.limit, contract=contract, **known)
    if a.verb == "list-nodes":
        return query.list_nodes(t.entities, a.kind, a.status, a.part_id)
    if a.verb == "entity":
        return query.get_entity(t.entities, a.collection, a.id, a.document)
    if a.verb == "field":
        return query.get_field(t.fields, contract, a.collection, a.id, a.pointer, a.document)
    if a.verb == "document-field":
        return query.get_document_field(t.fields, contract, a.document, a.pointer)
    if a.verb == "query-fields":
        more = {"collection": a.collection, "kind": a.kind, "status": a.status, "namespace": a.namespace, "extension_type": a.extension_type, "schema_version": a.schema_version}
        value = {} if a.value is None else {"value": _value(a.value)}
        return query.query_fields(t.fields, t.entities, contract, a.pointer, operator=a.operator, **value, **more, **known).orderBy("document_id", "collection", "entity_id", "pointer")
    if a.verb == "coverage":
        return coverage(t.fields, contract).orderBy("collection", "template")
    if a.verb == "references":
        return query.find_references(t.references, a.target, a.source, a.collection, a.pointer)
    if a.verb == "relations":
        return query.find_relations(t.entities, a.kind, getattr(a, "from"), a.to)
    if a.verb == "extensions":
        return query.find_extensions(t.entities, a.namespace, a.type, a.target, a.schema_version)
    if a.verb == "observations":
        return query.find_observations(t.entities, a.target, a.kind)
    if a.verb == "digest":
        return canonical_documents(t.documents, a.projection).drop("canonical")
    if a.verb == "ancestors":
        nodes = t.entities.filter((t.entities.collection == "nodes") & (t.entities.entity_id == a.node)).selectExpr("document_id", "entity_id AS node_id")
        return trees.ancestors(trees.node_edges(t.references), nodes).orderBy("document_id", "distance")
    roots, rows = t.below(a.node)
    if a.verb == "descendants":
        return rows
    nodes = roots.selectExpr("document_id", "root_id AS node_id")
    nodes = nodes if a.scope == "direct" else rows.select("document_id", "node_id").unionByName(nodes)
    return query.get_text(t.entities, query.node_texts(t.references), nodes, a.representation)


def run(spark: SparkSession, arguments: list[str]) -> int:
    """Prints rows as JSON; 1 if a query is refused, 2 if a conversion failed or a document or an index is invalid."""
    a = parser().parse_args(arguments)
    show = lambda rows: [print(line) for line in rows.toJSON().toLocalIterator()]
    if a.verb == "convert":
        made = convert_files(read_files(spark, a.source)).cache()
        sinks.write_json(made, f"{a.target}/documents", a.source)
        sinks.write_evidence(made, f"{a.target}/evidence", "1")
        show(made.drop("ir_json"))
        bad = not made.filter("outcome = 'failed'").isEmpty()
        made.unpersist()  # a later run over the same folder must see its files anew
        return 2 if bad else 0
    if a.verb == "inspect":
        show(inspect_files(read_files(spark, a.source)))
        return 0
    t = Tables(spark, a.documents)
    try:
        if a.verb == "check":
            rows = validation.violations(t.entities, t.fields, t.references, t.documents)
            show(rows)
            return 0 if rows.isEmpty() and t.quarantined.isEmpty() else 2
        if a.verb == "build-index":
            print(json.dumps(index.build_index(t.documents, a.index, document_contract()), sort_keys=True))
        elif a.verb == "check-index":
            print(json.dumps(index.open_index(spark, a.index, a.version, document_contract(), t.documents).manifest, sort_keys=True))
        elif a.verb == "page":
            page, cursor = query.list_entities_page(t.entities, document_contract(), index.source_digest(t.documents), a.collection, a.kind, a.status, a.profile, a.limit or DEFAULT_PAGE, a.cursor, t.profiles)
            print(json.dumps({"entities": [r.asDict() for r in page], "cursor": cursor}))
        else:
            show(answer(t, a))
    except QueryError as error:
        print(f"refused: {error}", file=sys.stderr)
        return 1
    except index.StaleIndex as error:
        print(f"invalid: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.getOrCreate(), sys.argv[1:]))
