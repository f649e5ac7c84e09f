"""Driver queries over the star schema, over whole tables, each with the same result as its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlattice.functions import values
from factlattice.operators import canonical, facts, markdown_lines, query, status, styles, trees, validation
from factlattice.plans.contract import Contract

QUERIES: dict = {}
SQL: dict[str, str] = {}

CONTRACT = Contract.from_types(
    {
        "orders": {"/status": "string", "/priority": "string", "/price": "number", "/customer": "id-string"},
        "parts": {"/name": "string", "/brand": "string", "/size": "integer", "/comment": "string"},
        "events": {"/k": "integer", "/type": "string", "/value": "number", "/user": "integer"},
        "baskets": {"/lines/*/quantity": "number", "/lines/*/flag": "string", "/lines": "list", "/flags/*": "string", "/flags": "list", "/open/**": "any"},
    },
    version="star-1",
)


def _query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def order_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    payload = F.lit(None).cast("string")
    return o.select(F.lit("tables").alias("document_id"), F.lit("orders").alias("collection"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("entity_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("ordinal"), payload.alias("payload"))


def event_fields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as entities whose payload is their props, flattened; null props have no fields."""
    e = _read(spark, sf_dir, "events").select(F.lit("tables").alias("document_id"), F.lit("events").alias("collection"), F.col("event_id").cast("string").alias("entity_id"), F.col("event_type").alias("kind"), F.lit(None).cast("string").alias("status"), F.lit(0).alias("ordinal"), F.col("props").alias("payload"))
    return e, facts.flatten(e, with_root=False)


def part_fields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts with a comment that is null for even sizes and missing for sizes over 40."""
    p = _read(spark, sf_dir, "part")
    e = p.select(F.lit("tables").alias("document_id"), F.lit("parts").alias("collection"), F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_brand").alias("kind"), F.lit(None).cast("string").alias("status"), F.lit(0).alias("ordinal"), F.lit(None).cast("string").alias("payload"))
    comment = F.when(F.col("p_size") % 2 == 1, F.concat(F.lit("size "), F.col("p_size").cast("string")))
    f = facts.fields_of_columns(p, "parts", "p_partkey", {"/name": ("string", F.col("p_name")), "/brand": ("string", F.col("p_brand")), "/size": ("integer", F.col("p_size"))})
    return e, f.unionByName(facts.fields_of_columns(p.filter("p_size <= 40"), "parts", "p_partkey", {"/comment": ("string", comment)}))


def order_fields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = _read(spark, sf_dir, "orders").withColumn("id", F.lpad(F.col("o_orderkey").cast("string"), 10, "0"))
    return order_entities(spark, sf_dir), facts.fields_of_columns(o, "orders", "id", {"/status": ("string", F.col("o_orderstatus")), "/priority": ("string", F.col("o_orderpriority")), "/customer": ("string", F.col("o_custkey"))})


def basket_fields(spark: SparkSession, sf_dir: str, template: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Orders with their lines as nested JSON, and their fields, those that a template names if one is given."""
    li = _read(spark, sf_dir, "lineitem")
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("quantity"), F.col("l_returnflag").alias("flag"))
    b = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    b = b.select("l_orderkey", F.to_json(F.struct("lines", F.array_sort(F.array_distinct(F.col("lines.flag"))).alias("flags"))).alias("payload"))
    e = b.select(F.lit("tables").alias("document_id"), F.lit("baskets").alias("collection"), F.col("l_orderkey").cast("string").alias("entity_id"), F.lit("basket").alias("kind"), F.lit(None).cast("string").alias("status"), F.lit(0).alias("ordinal"), "payload")
    return e, facts.flatten(e, with_root=False, template=template)


def _hits(df: DataFrame) -> DataFrame:
    return df.select("entity_id", "pointer", "presence", "value_json")


# ---- entities, paging, fields ----


@_query("list_entities_filtered", "SELECT lpad(o_orderkey::VARCHAR, 10, '0') AS entity_id, o_orderpriority AS kind, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def _(spark, sf_dir):
    return query.list_entities(order_entities(spark, sf_dir), "orders", kind="1-URGENT", status="O").select("entity_id", "kind", "status")


@_query("entity_offset_limit", "SELECT lpad(o_orderkey::VARCHAR, 10, '0') AS entity_id FROM orders WHERE o_orderstatus = 'F' ORDER BY 1 LIMIT 25 OFFSET 50")
def _(spark, sf_dir):
    return query.list_entities(order_entities(spark, sf_dir), "orders", status="F", offset=50, limit=25).select("entity_id")


@_query("list_entities_paged", "SELECT lpad(o_orderkey::VARCHAR, 10, '0') AS entity_id, 2 AS page FROM orders WHERE o_orderstatus = 'O' ORDER BY 1 LIMIT 40 OFFSET 40")
def _(spark, sf_dir):
    e = order_entities(spark, sf_dir)
    _, cursor = query.list_entities_page(e, CONTRACT, "digest", "orders", status="O", limit=40)
    page, _ = query.list_entities_page(e, CONTRACT, "digest", "orders", status="O", limit=40, cursor=cursor)
    return spark.createDataFrame([(r["entity_id"], 2) for r in page], "entity_id string, page int")


@_query("get_entity", "SELECT lpad(o_orderkey::VARCHAR, 10, '0') AS entity_id, o_orderpriority AS kind, o_orderstatus AS status FROM orders WHERE o_orderkey = 7")
def _(spark, sf_dir):
    return query.get_entity(order_entities(spark, sf_dir), "orders", "0000000007").select("entity_id", "kind", "status")


@_query("get_field", "SELECT event_id::VARCHAR AS entity_id, '/k' AS pointer, (props->>'$.k') AS value_json FROM events WHERE event_id = 3")
def _(spark, sf_dir):
    _, f = event_fields(spark, sf_dir)
    return query.get_field(f, CONTRACT, "events", "3", "/k").select("entity_id", "pointer", "value_json")


@_query("json_flatten_props", "SELECT event_id::VARCHAR AS entity_id, '/k' AS pointer, 1 AS depth, 'integer' AS value_type, (props->>'$.k') AS value_json FROM events WHERE props IS NOT NULL")
def _(spark, sf_dir):
    return event_fields(spark, sf_dir)[1].select("entity_id", "pointer", "depth", "value_type", "value_json")


@_query("field_coverage", "SELECT 'events' AS collection, '/k' AS template, count(*) AS n FROM events WHERE props IS NOT NULL")
def _(spark, sf_dir):
    _, f = event_fields(spark, sf_dir)
    known = CONTRACT.table(spark).select("collection", "pointer")
    return f.join(known, ["collection", "pointer"], "left_semi").groupBy("collection", F.col("pointer").alias("template")).agg(F.count(F.lit(1)).alias("n"))


@_query("coverage_anti", "SELECT 'baskets' AS collection, '/lines/*/n' AS template UNION ALL SELECT 'baskets', '/lines/*'")
def coverage_anti(spark, sf_dir):
    from factlattice.operators.index import uncovered

    return uncovered(facts.templates(basket_fields(spark, sf_dir)[0]), CONTRACT)



# ---- typed predicates ----

_EVENT = "SELECT event_id::VARCHAR AS entity_id, '/k' AS pointer, 'value' AS presence, (props->>'$.k') AS value_json FROM events WHERE (props->>'$.k')::INTEGER "
for _name, _operator, _sign in (("eq", "eq", "= 29"), ("neq", "neq", "<> 29"), ("lt", "lt", "< 29"), ("lte", "lte", "<= 29"), ("gt", "gt", "> 29"), ("gte", "gte", ">= 29")):

    @_query(f"query_fields_{_name}", _EVENT + _sign)
    def _(spark, sf_dir, operator=_operator):
        e, f = event_fields(spark, sf_dir)
        return _hits(query.query_fields(f, e, CONTRACT, "/k", 29, operator, collection="events"))


@_query("query_fields_eq_string_lane", "SELECT event_id::VARCHAR AS entity_id, '/k' AS pointer, 'value' AS presence, (props->>'$.k') AS value_json FROM events WHERE false")
def _(spark, sf_dir):
    e, f = event_fields(spark, sf_dir)
    return _hits(query.query_fields(f, e, CONTRACT, "/k", "29", "eq", collection="events"))


@_query("query_fields_prefix", "SELECT p_partkey::VARCHAR AS entity_id, '/brand' AS pointer, 'value' AS presence, '\"' || p_brand || '\"' AS value_json FROM part WHERE starts_with(p_brand, 'Brand#1')")
def _(spark, sf_dir):
    e, f = part_fields(spark, sf_dir)
    return _hits(query.query_fields(f, e, CONTRACT, "/brand", "Brand#1", "prefix", collection="parts"))


@_query("query_fields_contains", "SELECT p_partkey::VARCHAR AS entity_id, '/name' AS pointer, 'value' AS presence, '\"' || p_name || '\"' AS value_json FROM part WHERE contains(p_name, 'e')")
def _(spark, sf_dir):
    e, f = part_fields(spark, sf_dir)
    return _hits(query.query_fields(f, e, CONTRACT, "/name", "e", "contains", collection="parts"))


@_query("query_fields_contains_list", "SELECT l_orderkey::VARCHAR AS entity_id, '/flags' AS pointer, 'value' AS presence, '[' || string_agg(DISTINCT '\"' || l_returnflag || '\"', ',' ORDER BY '\"' || l_returnflag || '\"') || ']' AS value_json FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'R')")
def query_fields_contains_list(spark, sf_dir):
    e, f = basket_fields(spark, sf_dir, "/flags/**")
    f = trees.written(f, "baskets")  # lists and their members are read apart
    return _hits(query.query_fields(f, e, CONTRACT, "/flags", "R", "contains", collection="baskets"))



@_query("query_fields_exists", "SELECT p_partkey::VARCHAR AS entity_id, '/comment' AS pointer, CASE WHEN p_size % 2 = 1 THEN 'value' ELSE 'null' END AS presence, CASE WHEN p_size % 2 = 1 THEN '\"size ' || p_size || '\"' ELSE 'null' END AS value_json FROM part WHERE p_size <= 40")
def _(spark, sf_dir):
    e, f = part_fields(spark, sf_dir)
    return _hits(query.query_fields(f, e, CONTRACT, "/comment", operator="exists", collection="parts"))


@_query("query_fields_is_null", "SELECT p_partkey::VARCHAR AS entity_id, '/comment' AS pointer, 'null' AS presence, 'null' AS value_json FROM part WHERE p_size <= 40 AND p_size % 2 = 0")
def _(spark, sf_dir):
    e, f = part_fields(spark, sf_dir)
    return _hits(query.query_fields(f, e, CONTRACT, "/comment", operator="is-null", collection="parts"))


@_query("query_fields_is_missing", "SELECT p_partkey::VARCHAR AS entity_id, '/comment' AS pointer, 'missing' AS presence, NULL::VARCHAR AS value_json FROM part WHERE p_size > 40")
def _(spark, sf_dir):
    e, f = part_fields(spark, sf_dir)
    return _hits(query.query_fields(f, e, CONTRACT, "/comment", operator="is-missing", collection="parts"))


@_query("query_fields_template", """
WITH l AS (SELECT l_orderkey, l_quantity::INTEGER AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity::INTEGER, l_returnflag) - 1 AS k FROM lineitem)
SELECT l_orderkey::VARCHAR AS entity_id, '/lines/' || k || '/quantity' AS pointer, 'value' AS presence, q::VARCHAR AS value_json FROM l WHERE q >= 45""")
def query_fields_template(spark, sf_dir):
    e, f = basket_fields(spark, sf_dir, "/lines/*/quantity")
    return _hits(query.query_fields(f, e, CONTRACT, "/lines/*/quantity", 45, "gte", collection="baskets"))



@_query("query_fields_kind_status", "SELECT lpad(o_orderkey::VARCHAR, 10, '0') AS entity_id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'")
def _(spark, sf_dir):
    e, f = order_fields(spark, sf_dir)
    return query.query_fields(f, e, CONTRACT, "/priority", operator="exists", collection="orders", kind="5-LOW", status="P").select("entity_id", "status")


@_query("find_field_equals", "SELECT lpad(o_orderkey::VARCHAR, 10, '0') AS entity_id FROM orders WHERE o_custkey = 11")
def _(spark, sf_dir):
    e, f = order_fields(spark, sf_dir)
    return query.find_field_equals(f, e, CONTRACT, "/customer", "11", collection="orders").select("entity_id")


@_query("decimal_string_order", "SELECT p_partkey::VARCHAR AS entity_id FROM part WHERE p_size::VARCHAR < '3'")
def _(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    f = facts.fields_of_columns(p, "parts", "p_partkey", {"/length": ("string", F.col("p_size"))})
    return f.filter(query.compare("lt", "3")).select("entity_id")


@_query("decimal_value_order", "SELECT p_partkey::VARCHAR AS entity_id FROM part WHERE p_size < 3")
def _(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    f = facts.fields_of_columns(p, "parts", "p_partkey", {"/length": ("string", F.col("p_size"))})
    return f.filter(query.compare_decimal("lt", "3")).select("entity_id")


# ---- references and integrity ----


def star_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders")
    line = F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber")
    edge = lambda df, source, pointer, target, owner: df.select(F.lit("tables").alias("document_id"), source.alias("source_id"), F.lit(pointer).alias("source_pointer"), F.concat_ws("-", F.lit(owner), target).alias("target_id"), F.lit("tables").alias("source_collection"), F.lit(None).cast("int").alias("ordinal"))
    return (
        edge(li, line, "/orderId", F.col("l_orderkey"), "o").unionByName(edge(li, line, "/partId", F.col("l_partkey"), "p"))
        .unionByName(edge(li, line, "/supplierId", F.col("l_suppkey"), "s")).unionByName(edge(o, F.concat_ws("-", F.lit("o"), "o_orderkey"), "/customerId", F.col("o_custkey"), "c"))
    )


@_query("find_references", "SELECT 'l-' || l_orderkey || '-' || l_linenumber AS source_id, '/partId' AS source_pointer, 'p-5' AS target_id FROM lineitem WHERE l_partkey = 5")
def _(spark, sf_dir):
    return query.find_references(star_references(spark, sf_dir), target_id="p-5", pointer="/partId").select("source_id", "source_pointer", "target_id")


@_query("reference_counts", "SELECT '/orderId' AS source_pointer, count(*) AS n, count(DISTINCT l_orderkey) AS targets FROM lineitem UNION ALL SELECT '/partId', count(*), count(DISTINCT l_partkey) FROM lineitem UNION ALL SELECT '/supplierId', count(*), count(DISTINCT l_suppkey) FROM lineitem UNION ALL SELECT '/customerId', count(*), count(DISTINCT o_custkey) FROM orders")
def _(spark, sf_dir):
    return star_references(spark, sf_dir).groupBy("source_pointer").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target_id").alias("targets"))


@_query("dangling_refs", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def _(spark, sf_dir):
    owners = _read(spark, sf_dir, "orders").filter("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return _read(spark, sf_dir, "lineitem").join(owners, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@_query("duplicate_ids", "SELECT c_nationkey::VARCHAR AS entity_id, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf_dir):
    named = _read(spark, sf_dir, "customer").select(F.lit("tables").alias("document_id"), F.lit("nodes").alias("collection"), F.col("c_nationkey").cast("string").alias("entity_id"))
    return validation.duplicate_ids(named).select("entity_id", F.col("detail").cast("long").alias("n"))


@_query("reciprocity", "SELECT 'o-' || o_orderkey AS child, 'c-' || o_custkey || ' does not list it' AS detail FROM orders WHERE o_totalprice <= 1000 OR o_orderkey % 7 = 0")
def _(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    child, parent = F.concat_ws("-", F.lit("o"), "o_orderkey"), F.concat_ws("-", F.lit("c"), "o_custkey")
    fact = lambda df, owner, pointer, value: df.select(F.lit("tables").alias("document_id"), F.lit("nodes").alias("collection"), F.lit("string").alias("value_type"), owner.alias("entity_id"), F.lit(pointer).alias("pointer"), value.alias("value_string"))
    listed = o.filter("NOT (o_totalprice <= 1000 OR o_orderkey % 7 = 0)")
    fields = fact(o, child, "/parentId", parent).unionByName(fact(listed, parent, "/childIds/0", child))
    return validation.reciprocity(fields).select(F.col("entity_id").alias("child"), "detail")


# ---- trees ----


def region_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region - nation - customer - order - line, ordered by key below each parent."""
    r = lambda t: _read(spark, sf_dir, t)
    name = lambda kind, *keys: F.concat_ws("-", F.lit(kind), *keys)
    edge = lambda df, parent, child, ordinal: df.select(F.lit("tables").alias("document_id"), parent.alias("parent_id"), child.alias("child_id"), ordinal.alias("ordinal"))
    return (
        edge(r("nation"), name("r", "n_regionkey"), name("n", "n_nationkey"), F.col("n_nationkey"))
        .unionByName(edge(r("customer"), name("n", "c_nationkey"), name("c", "c_custkey"), F.col("c_custkey")))
        .unionByName(edge(r("orders"), name("c", "o_custkey"), name("o", "o_orderkey"), F.col("o_orderkey")))
        .unionByName(edge(r("lineitem"), name("o", "l_orderkey"), name("l", "l_orderkey", "l_linenumber"), F.col("l_linenumber")))
    )


_TREE = """WITH RECURSIVE e AS (
  SELECT 'r-' || n_regionkey AS parent, 'n-' || n_nationkey AS child, n_nationkey::BIGINT AS k FROM nation
  UNION ALL SELECT 'n-' || c_nationkey, 'c-' || c_custkey, c_custkey FROM customer
  UNION ALL SELECT 'c-' || o_custkey, 'o-' || o_orderkey, o_orderkey FROM orders
  UNION ALL SELECT 'o-' || l_orderkey, 'l-' || l_orderkey || '-' || l_linenumber, l_linenumber FROM lineitem),
"""


@_query("descendants_of_region", _TREE + "d AS (SELECT child AS node_id, 1 AS depth, lpad(k::VARCHAR, 10, '0') AS path FROM e WHERE parent = 'r-1' UNION ALL SELECT e.child, d.depth + 1, d.path || '/' || lpad(e.k::VARCHAR, 10, '0') FROM d JOIN e ON e.parent = d.node_id) SELECT node_id, depth, path FROM d")
def _(spark, sf_dir):
    roots = spark.createDataFrame([("tables", "r-1")], "document_id string, root_id string")
    return trees.descendants(region_edges(spark, sf_dir), roots).select("node_id", "depth", "path")


@_query("tree_depth_stats", _TREE + "d AS (SELECT child AS node_id, 1 AS depth FROM e WHERE parent LIKE 'r-%' UNION ALL SELECT e.child, d.depth + 1 FROM d JOIN e ON e.parent = d.node_id) SELECT depth, count(*) AS nodes FROM d GROUP BY depth")
def _(spark, sf_dir):
    roots = _read(spark, sf_dir, "region").select(F.lit("tables").alias("document_id"), F.concat_ws("-", F.lit("r"), "r_regionkey").alias("root_id"))
    return trees.descendants(region_edges(spark, sf_dir), roots).groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"))


@_query("ancestors_of_lineitem", _TREE + "a AS (SELECT DISTINCT 'l-' || l_orderkey || '-' || l_linenumber AS start_id, 'o-' || l_orderkey AS node_id, 1 AS distance FROM lineitem UNION ALL SELECT a.start_id, e.parent, a.distance + 1 FROM a JOIN e ON e.child = a.node_id) SELECT start_id, node_id, distance FROM a")
def ancestors_of_lineitem(spark, sf_dir):
    start = _read(spark, sf_dir, "lineitem").select(F.lit("tables").alias("document_id"), F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber").alias("node_id")).distinct()
    return trees.ancestors(region_edges(spark, sf_dir).distinct(), start).select("start_id", "node_id", "distance")



@_query("reachability", """
WITH r AS (SELECT 'n-' || n_nationkey AS node_id, n_regionkey AS region FROM nation
  UNION ALL SELECT 'c-' || c_custkey, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'o-' || o_orderkey, n_regionkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'l-' || l_orderkey || '-' || l_linenumber, n_regionkey FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)
SELECT node_id, 'unreachable' AS code FROM r GROUP BY node_id HAVING min(coalesce(region, 9)) > 1""")
def reachability(spark, sf_dir):
    e = region_edges(spark, sf_dir)
    nodes = e.select("document_id", F.col("child_id").alias("node_id")).distinct()
    roots = spark.createDataFrame([("tables", "r-0"), ("tables", "r-1")], "document_id string, root_id string")
    return trees.reachability(e, nodes, roots).select("node_id", "code")



@_query("subtree_text", "SELECT 'conv-' || conv_id AS conversation, turn, text FROM conversations")
def subtree_text(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").withColumn("conversation", F.concat_ws("-", F.lit("conv"), "conv_id")).withColumn("node", F.concat_ws("-", "conversation", "turn"))
    edges = c.select(F.lit("tables").alias("document_id"), F.col("conversation").alias("parent_id"), F.col("node").alias("child_id"), F.col("turn").alias("ordinal"))
    below = trees.descendants(edges, edges.select("document_id", F.col("parent_id").alias("root_id")).distinct())
    return c.join(below.select(F.col("node_id").alias("node")), "node", "left_semi").select("conversation", "turn", "text")



# ---- status, canonical form, digests ----


@_query("status_rollup", """
WITH f AS (SELECT user_id, event_type, value FROM events)
SELECT user_id::VARCHAR AS document_id, CASE WHEN bool_or(value > 95 AND event_type = 'error') THEN 'failed' WHEN bool_or(value > 90) THEN 'partial' WHEN bool_or(value < 10) THEN 'complete-with-warnings' ELSE 'complete' END AS conversion_status
FROM f GROUP BY user_id""")
def _(spark, sf_dir):
    e = _read(spark, sf_dir, "events").withColumn("document_id", F.col("user_id").cast("string"))
    features = e.select("document_id", F.when(F.col("value") > 90, "unsupported").otherwise("preserved").alias("status"))
    severity = F.when((F.col("value") > 95) & (F.col("event_type") == "error"), "error").when(F.col("value") < 10, "warning")
    diagnostics = e.select("document_id", severity.alias("severity")).filter("severity IS NOT NULL")
    return status.conversion_status(features, diagnostics, e.select("document_id").distinct())


@_query("feature_inventory", "SELECT user_id::VARCHAR AS document_id, event_type AS feature, CASE WHEN value > 90 THEN 'unsupported' ELSE 'preserved' END AS status, count(*) AS occurrences, CASE WHEN value > 90 THEN 'unsupported' ELSE 'represented' END AS disposition FROM events GROUP BY ALL")
def _(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    f = e.select(F.col("user_id").cast("string").alias("document_id"), F.col("event_type").alias("feature"), F.when(F.col("value") > 90, "unsupported").otherwise("preserved").alias("status"), F.col("event_id").alias("ordinal"), F.array(F.col("event_id").cast("string")).alias("diagnostic_ids"))
    return status.feature_inventory(f).drop("diagnostic_ids")


@_query("inventory_reconcile", "SELECT event_type AS feature, count(*) AS stated, count(*) FILTER (value > 5) AS counted FROM events GROUP BY 1 HAVING count(*) <> count(*) FILTER (value > 5)")
def _(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select(F.col("event_type").alias("feature"), "value", F.lit(1).alias("occurrences"))
    return status.reconcile(e, e.filter("value > 5"), ["feature"])


_NATION = """'{"key":' || n_nationkey || ',"name":"' || n_name || '","region":' || n_regionkey || '}'"""


@_query("canonical_entity_digest", f"SELECT n_nationkey, {_NATION} AS canonical, sha256({_NATION}) AS digest FROM nation")
def _(spark, sf_dir):
    body = canonical.canonical_row({"name": ("string", "n_name"), "key": ("integer", "n_nationkey"), "region": ("integer", "n_regionkey")})
    return _read(spark, sf_dir, "nation").withColumn("canonical", body).select("n_nationkey", "canonical", canonical.value_digest(F.col("canonical")).alias("digest"))


@_query("records_digest", f"""WITH a AS (SELECT sha256({_NATION}) AS h FROM nation),
b AS (SELECT substr(h, 1, 5) AS k, sha256(string_agg(h, chr(10) ORDER BY h)) AS d, count(*) AS n FROM a GROUP BY 1),
c AS (SELECT substr(k, 1, 2) AS k, sha256(string_agg(d, chr(10) ORDER BY b.k)) AS d, sum(n) AS n FROM b GROUP BY 1)
SELECT sum(n)::BIGINT AS records, sha256(string_agg(d, chr(10) ORDER BY k)) AS records_digest FROM c""")
def _(spark, sf_dir):
    body = canonical.canonical_row({"name": ("string", "n_name"), "key": ("integer", "n_nationkey"), "region": ("integer", "n_regionkey")})
    return canonical.records_digest(_read(spark, sf_dir, "nation").withColumn("h", canonical.value_digest(body)), "h")


@_query("index_parity", "SELECT 'left' AS side, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice <= 1000 UNION ALL SELECT 'right', count(*) FROM orders WHERE o_orderstatus = 'P'")
def _(spark, sf_dir):
    from factlattice.operators.index import parity

    o = _read(spark, sf_dir, "orders")
    return parity(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P' OR o_orderstatus = 'F' AND o_totalprice > 1000").repartition(3, "o_orderkey"), ["o_orderkey", "o_orderstatus"])


@_query("observation_pairs", "SELECT u.conv_id, u.turn, u.text = a.text AS equal FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'")
def _(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", "text")
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("seen"))
    return u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", (F.col("text") == F.col("seen")).alias("equal"))


# ---- Markdown lines ----


@_query("text_lines", "SELECT doc_id, unnest(generate_series(1, len(string_split_regex(text, '\\r\\n|\\n|\\r')))) AS line, unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS text FROM documents")
def _(spark, sf_dir):
    return markdown_lines.lines(_read(spark, sf_dir, "documents")).select("doc_id", F.col("line").cast("long").alias("line"), "text")


@_query("line_spans")
def line_spans(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    return markdown_lines.lines(d).select("doc_id", F.col("line").cast("long").alias("line"), "char_start", F.col("char_end").cast("long").alias("char_end"), "byte_start", F.col("byte_end").cast("long").alias("byte_end"))



_LINES = "WITH l AS (SELECT doc_id, unnest(generate_series(1, len(string_split_regex(text, '\\r\\n|\\n|\\r')))) AS line, unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS t FROM documents) "


@_query("heading_rows", """
WITH d AS (SELECT p_partkey AS doc_id, 'about' || chr(10) || repeat(' ', p_size % 5) || repeat('#', p_size % 8) || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' ' END || p_name AS text FROM part),
l AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS t FROM d)
SELECT doc_id, line, length(regexp_extract(t, '^ {0,3}(#{1,6})', 1)) AS level FROM l WHERE regexp_matches(t, '^ {0,3}#{1,6}(?:[ \\t]|$)')""")
def _(spark, sf_dir):
    gap = F.when(F.col("p_size") % 3 == 0, "").otherwise(" ")
    made = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("about\n"), F.expr("repeat(' ', p_size % 5)"), F.expr("repeat('#', p_size % 8)"), gap, "p_name").alias("text"))
    rows = markdown_lines.lines(made)
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), markdown_lines.heading_level(F.col("text")).cast("long").alias("level")).filter("level IS NOT NULL")


@_query("block_kinds", _LINES + r"""SELECT kind, count(*) AS n FROM (SELECT CASE
  WHEN regexp_matches(t, '^ {0,3}:::') THEN 'directive' WHEN regexp_matches(t, '^ {0,3}(?:```+[^`]*|~~~+.*)$') THEN 'fence'
  WHEN regexp_matches(t, '^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$') THEN 'break' WHEN regexp_matches(t, '^ {0,3}#{1,6}(?:[ \t]|$)') THEN 'heading'
  WHEN regexp_matches(t, '^[ \t\x0B\f]*$') THEN 'blank' WHEN regexp_matches(t, '^[ \t\x0B\f]*(?:[-*+]|[0-9]{1,9}[.)])(?:[ \t]|$)') THEN 'list' WHEN regexp_matches(t, '^(?:    |\t)') THEN 'code'
  WHEN regexp_matches(t, '^ {0,3}>') THEN 'quote' WHEN contains(t, '|') THEN 'table' ELSE 'text' END AS kind FROM l) GROUP BY kind""")
def _(spark, sf_dir):
    rows = markdown_lines.lines(_read(spark, sf_dir, "documents"))
    return rows.groupBy(markdown_lines.line_kind(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@_query("pipe_table_rows")
def pipe_table_rows(spark, sf_dir):
    rows = markdown_lines.lines(_read(spark, sf_dir, "documents")).filter(markdown_lines.is_pipe_row(F.col("text")))
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), F.size(markdown_lines.table_cells(F.col("text"))).cast("long").alias("cells"))



# ---- cells, values, styles ----


@_query("a1_address", "SELECT p_partkey, CASE WHEN p_partkey >= 1 AND p_size >= 1 THEN CASE WHEN p_partkey > 18278 THEN chr((64 + ((p_partkey - 18279) // 17576) % 26 + 1)::INTEGER) ELSE '' END || CASE WHEN p_partkey > 702 THEN chr((64 + ((p_partkey - 703) // 676) % 26 + 1)::INTEGER) ELSE '' END || CASE WHEN p_partkey > 26 THEN chr((64 + ((p_partkey - 27) // 26) % 26 + 1)::INTEGER) ELSE '' END || chr((64 + (p_partkey - 1) % 26 + 1)::INTEGER) || p_size END AS address, CASE WHEN p_partkey >= 1 AND p_size >= 1 THEN p_partkey END AS column_number, CASE WHEN p_partkey >= 1 AND p_size >= 1 THEN p_size::BIGINT END AS row_number FROM part")
def a1_address(spark, sf_dir):
    p = _read(spark, sf_dir, "part").withColumn("address", values.a1(F.col("p_size"), F.col("p_partkey")))
    parsed = values.parse_a1(F.col("address"))
    return p.select("p_partkey", "address", parsed["column"].alias("column_number"), parsed["row"].alias("row_number"))



@_query("range_membership", "SELECT 'B2:D40' AS sqref, l_orderkey AS row, l_linenumber::BIGINT AS col FROM lineitem WHERE l_orderkey BETWEEN 2 AND 40 AND l_linenumber BETWEEN 2 AND 4 UNION ALL SELECT 'A100:A3000', l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey BETWEEN 100 AND 3000 AND l_linenumber = 1")
def _(spark, sf_dir):
    cells = _read(spark, sf_dir, "lineitem").select(F.lit("s").alias("sheet"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").cast("long").alias("column"))
    placed = styles.ranges(spark.createDataFrame([("s", "B2:D40"), ("s", "A100:A3000")], "sheet string, sqref string"))
    return styles.cells_in_ranges(cells, placed, ["sheet"]).select("sqref", "row", F.col("column").alias("col"))


@_query("range_expand", "SELECT p_partkey, r AS row, c AS col FROM part, generate_series(1, p_size % 4) AS a(r), generate_series(2, 3) AS b(c) WHERE p_size % 4 > 0")
def range_expand(spark, sf_dir):
    p = _read(spark, sf_dir, "part").withColumn("bounds", values.parse_range(F.concat(F.lit("B1:C"), F.greatest(F.lit(1), F.col("p_size") % 4).cast("string"))))
    return p.filter("p_size % 4 > 0").select("p_partkey", F.explode(values.expand_range(F.col("bounds"))).alias("x")).select("p_partkey", "x.row", F.col("x.column").alias("col"))



@_query("serial_to_date", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS iso, o_orderdate::DATE::VARCHAR AS iso_1904 FROM orders")
def _(spark, sf_dir):
    """Serial numbers of dates in both systems, read back as dates."""
    days = lambda first: F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit(first)))
    o = _read(spark, sf_dir, "orders")
    return o.select("o_orderkey", values.serial_date(days("1899-12-31") + 1, F.lit("1900"), F.lit(False)).alias("iso"), values.serial_date(days("1904-01-01"), F.lit("1904"), F.lit(False)).alias("iso_1904"))


@_query("duration_display", "SELECT p_partkey, lpad((p_size * 4321 // 3600)::VARCHAR, 2, '0') || ':' || lpad((p_size * 4321 // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((p_size * 4321 % 60)::VARCHAR, 2, '0') AS shown FROM part")
def _(spark, sf_dir):
    days = (F.col("p_size") * 4321).cast("decimal(20,10)") / F.lit(86400).cast("decimal(20,10)")
    return _read(spark, sf_dir, "part").select("p_partkey", values.duration_text(days).alias("shown"))


@_query("number_display", "SELECT l_orderkey, l_linenumber, format('{:,}', l_quantity::INTEGER * 1000) || '.00 kg' AS shown, (l_quantity::INTEGER) || '00%' AS percent FROM lineitem")
def number_display(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem")
    show = lambda value, code: values.displayed(value.cast("string"), F.lit(code), F.lit("1900"))
    return li.select("l_orderkey", "l_linenumber", show(F.col("l_quantity").cast("int") * 1000, '#,##0.00" kg"').alias("shown"), show(F.col("l_quantity").cast("int"), "0%").alias("percent"))



@_query("cell_typing", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'decimal' WHEN 2 THEN 'boolean' ELSE 'string' END AS type, CASE p_size % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || '.5' WHEN 2 THEN 'true' ELSE p_brand END AS value, CASE WHEN p_size % 4 = 3 THEN 'unsupported' ELSE 'preserved' END AS status FROM part")
def _(spark, sf_dir):
    m = F.col("p_size") % 4
    raw = F.when(m == 0, F.col("p_size").cast("string")).when(m == 1, F.concat(F.col("p_size").cast("string"), F.lit(".50"))).when(m == 2, "1").otherwise(F.col("p_brand"))
    typed = values.typed_cell(raw, F.when(m == 2, "b").otherwise("n"), F.lit("General"), F.lit("1900"))
    return _read(spark, sf_dir, "part").withColumn("t", typed).select("p_partkey", "t.type", "t.value", "t.status")


@_query("style_cascade", """
WITH own AS (SELECT p_partkey, p_brand, p_size FROM part)
SELECT 'part-' || p_partkey AS style_id, 'size' AS property, p_size::VARCHAR AS value, 'part-' || p_partkey AS source_id, 'direct' AS action FROM own
UNION ALL SELECT 'part-' || p_partkey, 'color', p_brand, p_brand, 'inherit' FROM own
UNION ALL SELECT DISTINCT p_brand, 'color', p_brand, p_brand, 'direct' FROM own
UNION ALL SELECT 'part-' || p_partkey, 'font', 'plain', 'defaults', 'default' FROM own
UNION ALL SELECT DISTINCT p_brand, 'font', 'plain', 'defaults', 'default' FROM own""")
def style_cascade(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    name, doc = F.concat_ws("-", F.lit("part"), "p_partkey"), F.lit("tables").alias("document_id")
    brands = p.select(doc, F.col("p_brand").alias("style_id")).distinct()
    own = p.select(doc, name.alias("style_id"), F.col("p_brand").alias("based_on")).unionByName(brands.withColumn("based_on", F.lit(None).cast("string")))
    declared = p.select(doc, name.alias("style_id"), F.lit("size").alias("property"), F.col("p_size").cast("string").alias("value")).unionByName(brands.select("document_id", "style_id", F.lit("color").alias("property"), F.col("style_id").alias("value")))
    defaults = spark.createDataFrame([("tables", "font", "plain", "defaults")], "document_id string, property string, value string, source_id string")
    return styles.resolve_styles(own, declared.withColumn("source_id", F.lit(None).cast("string")), defaults).select("style_id", "property", "value", "source_id", "action")



@_query("conditional_format_winner", """
SELECT l_orderkey AS row, l_linenumber::BIGINT AS col, 'color' AS property, CASE WHEN l_quantity > 40 AND l_linenumber <= 3 THEN 'blue' WHEN l_quantity > 30 THEN 'red' ELSE 'grey' END AS value
FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) WHERE l_orderkey >= 1 AND (l_quantity > 30 OR l_quantity < 5)""")
def _(spark, sf_dir):
    cells = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity")).select(F.lit("s").alias("sheet"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").cast("long").alias("column"), F.col("l_quantity").cast("string").alias("raw_value"))
    rules = spark.createDataFrame(
        [("s", 1, "A1:G9999999", 1, "greaterThan", "30", "red", True), ("s", 1, "A1:G9999999", 2, "greaterThan", "20", "none", True), ("s", 1, "A1:G9999999", 3, "lessThan", "5", "grey", False), ("s", 1, "A1:G9999999", 4, "greaterThan", "35", "grey", False), ("s", 2, "A1:C9999999", 1, "greaterThan", "40", "blue", False)],
        "sheet string, block int, sqref string, priority int, operator string, operand string, style_id string, stop boolean",
    )
    declared = spark.createDataFrame([("red", "color", "red"), ("grey", "color", "grey"), ("blue", "color", "blue")], "style_id string, property string, value string")
    return styles.conditional_winners(cells, rules, declared).select("row", F.col("column").alias("col"), "property", "value")


@_query("first_definition_wins", "SELECT source, arg_min(doc_id, doc_id) AS doc_id, count(*) - 1 AS later FROM documents GROUP BY source")
def _(spark, sf_dir):
    w = Window.partitionBy("source").orderBy("doc_id")
    d = _read(spark, sf_dir, "documents").select("source", "doc_id").withColumn("k", F.row_number().over(w)).withColumn("later", F.count(F.lit(1)).over(Window.partitionBy("source")) - 1)
    return d.filter("k = 1").drop("k")


@_query("page_links", "SELECT page_id, count(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY page_id")
def _(spark, sf_dir):
    p = _read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))
    return p.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))


# ---- documents made of tables ----


def nation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per region: its nations as nodes below a root, every third with a text, nations of odd keys with a part that does not exist."""
    n = _read(spark, sf_dir, "nation").withColumn("id", F.concat(F.lit("n"), F.col("n_nationkey")))
    third = F.col("n_nationkey") % 3 == 0
    node = F.struct(
        F.col("id").alias("nodeId"), F.lit("paragraph").alias("kind"), F.lit("root").alias("parentId"), F.when(F.col("n_nationkey") % 2 == 1, "none").otherwise("part").alias("partId"),
        F.when(third, F.array(F.concat(F.lit("t"), F.col("n_nationkey")))).alias("textIds"), F.lit("preserved").alias("status"),
    )
    text = F.when(third, F.struct(F.concat(F.lit("t"), F.col("n_nationkey")).alias("textId"), F.lit("source").alias("representation"), F.col("n_name").alias("value")))
    g = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(node)).alias("nations"), F.array_sort(F.collect_list(text)).alias("texts"), F.array_sort(F.collect_list("id")).alias("ids"))
    root = F.struct(F.lit("root").alias("nodeId"), F.lit("document").alias("kind"), F.col("ids").alias("childIds"))
    body = F.concat(
        F.lit('{"documentId":"r'), F.col("n_regionkey"), F.lit('","rootNodeId":"root","parts":[{"partId":"part","kind":"body"}],"nodes":'),
        F.concat(F.lit("["), F.to_json(root), F.lit(","), F.substring(F.to_json("nations"), 2, 1 << 30), F.lit(',"texts":'), F.to_json("texts"), F.lit("}")),
    )
    return g.select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("document_id"), body.alias("ir_json"))


@_query("document_entities", "SELECT 'r' || n_regionkey AS document_id, 'nodes' AS collection, count(*) + 1 AS n FROM nation GROUP BY 1 UNION ALL SELECT 'r' || n_regionkey, 'texts', count(*) FROM nation WHERE n_nationkey % 3 = 0 GROUP BY 1 UNION ALL SELECT DISTINCT 'r' || n_regionkey, 'parts', 1 FROM nation UNION ALL SELECT DISTINCT 'r' || n_regionkey, '__document__', 1 FROM nation")
def _(spark, sf_dir):
    return facts.entities(nation_documents(spark, sf_dir)).groupBy("document_id", "collection").agg(F.count(F.lit(1)).alias("n"))


@_query("document_references", "SELECT 'r' || n_regionkey AS document_id, 'root' AS source_id, '/childIds/' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY 'n' || n_nationkey) - 1) AS source_pointer, 'n' || n_nationkey AS target_id, 'id-list' AS reference_kind FROM nation UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, '/parentId', 'root', 'id-field' FROM nation UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, '/partId', 'part', 'id-field' FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, '/textIds/0', 't' || n_nationkey, 'id-list' FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT DISTINCT 'r' || n_regionkey, 'r' || n_regionkey, '/rootNodeId', 'root', 'id-field' FROM nation")
def _(spark, sf_dir):
    e = facts.entities(nation_documents(spark, sf_dir))
    return facts.references(facts.flatten(e), e).select("document_id", "source_id", "source_pointer", "target_id", "reference_kind")


@_query("document_violations", "SELECT 'r' || n_regionkey AS document_id, 'REFERENCE-DANGLING' AS code, 'n' || n_nationkey AS entity_id, '/partId none' AS detail FROM nation WHERE n_nationkey % 2 = 1")
def _(spark, sf_dir):
    from factlattice.operators import validation

    e = facts.entities(nation_documents(spark, sf_dir))
    return validation.broken_references(facts.flatten(e), e).select("document_id", "code", "entity_id", "detail")


@_query("document_text", "SELECT 'r' || n_regionkey AS document_id, 't' || n_nationkey AS entity_id, n_name AS value FROM nation WHERE n_nationkey % 3 = 0")
def _(spark, sf_dir):
    e = facts.entities(nation_documents(spark, sf_dir))
    r = facts.references(facts.flatten(e), e)
    roots = e.filter("entity_id = 'root'").select("document_id", F.col("entity_id").alias("root_id"))
    below = trees.descendants(trees.node_edges(r), roots).select("document_id", "node_id")
    return query.get_text(e, query.node_texts(r), below).select("document_id", "entity_id", "value")


@_query("document_nodes", "SELECT 'r' || n_regionkey AS document_id, 'n' || n_nationkey AS entity_id, 'paragraph' AS kind FROM nation WHERE n_nationkey % 2 = 0")
def _(spark, sf_dir):
    e = facts.entities(nation_documents(spark, sf_dir))
    return query.list_nodes(e, kind="paragraph", status="preserved", part_id="part").select("document_id", "entity_id", "kind")


@_query("extension_verdicts", "SELECT p_partkey::VARCHAR AS extension_id, CASE p_size % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'patch' WHEN 2 THEN 'minor' WHEN 3 THEN 'major' ELSE 'unknown' END AS lane, CASE WHEN p_size % 5 = 0 THEN 'known' WHEN p_size % 5 = 1 THEN 'compatible' WHEN p_size > 25 THEN 'rejected' ELSE 'opaque' END AS verdict FROM part")
def _(spark, sf_dir):
    from factlattice.operators.extensions import Entry, Registry, classify

    m = F.col("p_size") % 5
    version = F.when(m == 0, "1.2.0").when(m == 1, "1.2.5").when(m == 2, "1.3.0").when(m == 3, "2.0.0").otherwise("later")
    x = _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("extension_id"), F.lit("f").alias("namespace"), F.lit("t").alias("type"), version.alias("schema_version"), F.when(F.col("p_size") > 25, "critical").alias("criticality"))
    return classify(x, Registry([Entry("f", "t", "1.2.0"), Entry("f", "t", "1.1.0")])).select("extension_id", "lane", "verdict")


@_query("extension_migrations", "SELECT p_partkey::VARCHAR AS extension_id, CASE WHEN p_size % 2 = 1 THEN 'preserved' WHEN p_size % 3 = 0 THEN 'loss-declared' ELSE 'preserved' END AS migration, '2.0.0' AS new_version, CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN '/payload/legacyRange' END AS loss FROM part")
def _(spark, sf_dir):
    x = _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("extension_id"), F.when(F.col("p_size") % 2 == 0, "1.0.0").otherwise("2.0.0").alias("schema_version"), (F.col("p_size") % 3 == 0).alias("has_legacy_range"))
    return canonical.migrate_extensions(x, "2.0.0").select("extension_id", "migration", "new_version", "loss")


@_query("points_in_spans", "SELECT e.event_id, p.p_partkey FROM events e JOIN part p ON e.event_id >= p.p_partkey * 40 AND e.event_id < p.p_partkey * 40 + p.p_size")
def _(spark, sf_dir):
    from factlattice.operators.intervals import points_in_spans

    points = _read(spark, sf_dir, "events").select(F.lit("d").alias("doc"), F.col("event_id").alias("at"))
    spans = _read(spark, sf_dir, "part").select(F.lit("d").alias("doc"), (F.col("p_partkey") * 40).alias("start"), (F.col("p_partkey") * 40 + F.col("p_size")).alias("end"), "p_partkey")
    return points_in_spans(points, spans, ["doc"], band=256).select(F.col("at").alias("event_id"), "p_partkey")


@_query("canonical_decimals", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE NOT regexp_matches((l_extendedprice::DECIMAL(12,2))::VARCHAR, '\\.[0-9]*0$') GROUP BY ALL")
def _(spark, sf_dir):
    from factlattice.operators.validation import canonical_decimal

    li = _read(spark, sf_dir, "lineitem").withColumn("text", F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))
    return li.filter(canonical_decimal(F.col("text"))).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@_query("schema_violations", "SELECT event_id::VARCHAR AS event_id, '/k' AS pointer, 'maximum' AS keyword FROM events WHERE (props->>'$.k')::INTEGER > 90")
def _(spark, sf_dir):
    from factlattice.plans.schema import check

    return check(_read(spark, sf_dir, "events"), {"type": "object", "properties": {"k": {"type": "integer", "maximum": 90}}, "additionalProperties": False}, key="event_id", text="props")
