from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factlattice.functions import pointers, values
from factlattice.plans.contract import Contract


@pytest.mark.parametrize(
    ("raw", "code", "shown"),
    [
        ("1234.5", "#,##0.00", "1,234.50"), ("-3", "0.0", "-3.0"), ("-3", "0.0;(0.0)", "(3.0)"), ("0", "0;-0;zero0", "zero0"), ("0.125", "0%", "13%"), ("0.5", "0", "1"), ("2.5", "0", "3"),
        ("1.5", "[h]:mm:ss", "36:00:00"), ("-0.5", "[h]:mm", "-12:00:00"), ("60", "yyyy-mm-dd", "1900-02-29"), ("61", "yyyy-mm-dd", "1900-03-01"), ("1", "d mmm yy", "1 Jan 00"), ("45292.75", "hh:mm AM/PM", "18:00 PM"),
        ("45292.5", "m/d/yy h:mm", "1/1/24 12:00"), ("5", "0.00E+00", None), ("5", "# ?/?", None), ("5", "[>3]0", None), ("5", "_(0", None), ("5", '0" kg"', "5 kg"), ("5", "General", "5"), ("x", "0", None), ("7", "[Red]0", "7"), ("1.10", "0.##", "1.1 "),
        (None, "0", None), ("5", "@", "5"), ("3", "000", "003"),
    ],
)
def test_displayed_values(raw, code, shown):
    assert values.displayed_value(raw, code) == shown


def test_serial_systems(spark):
    df = spark.createDataFrame([("60", "1900", False), ("61", "1900", True), ("0", "1904", False), ("1.9999999", "1900", True), ("59", "1900", False)], "s string, d string, t boolean")
    got = [r[0] for r in df.select(values.serial_date(F.col("s"), F.col("d"), F.col("t"))).collect()]
    assert got == ["1900-02-29", "1900-03-01T00:00:00", "1904-01-01", "1900-01-02T00:00:00", "1900-02-28"]


def test_addresses(spark):
    df = spark.createDataFrame([(1,), (26,), (27,), (702,), (703,), (16384,)], "n long").withColumn("a", values.column_letters(F.col("n")))
    got = df.select("n", "a", values.column_number(F.col("a")).alias("back")).collect()
    assert [r["a"] for r in got] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"] and all(r["n"] == r["back"] for r in got)
    odd = spark.createDataFrame([("B3:A1",), ("A1:B2",), ("x",)], "t string").withColumn("b", values.parse_range(F.col("t")))
    assert [r["n"] for r in odd.select(F.size(values.expand_range(F.col("b"))).alias("n")).collect()][:2] == [0, 4]


def test_typed_cells(spark):
    rows = [("1", "b", None), ("2", "b", None), ("#N/A", "e", None), ("2024-01-02T00:00:00Z", "d", None), ("2024-01-02T03:04:05", "d", None), ("late", "d", None), ("", "n", None), ("1e3", "n", None), ("1.50", "n", None), ("NaN", "n", None), ("45292", "n", "yyyy"), ("0.5", "n", "[h]:mm"), ("-1", "n", "yyyy"), (None, "n", None)]
    df = spark.createDataFrame(rows, "r string, t string, f string").select(values.typed_cell(F.col("r"), F.col("t"), F.col("f"), F.lit("1900")).alias("x")).select("x.*")
    assert [tuple(r) for r in df.collect()] == [
        ("boolean", "true", "preserved"), ("string", "2", "unsupported"), ("error", "#N/A", "preserved"), ("date", "2024-01-02", "preserved"), ("datetime", "2024-01-02T03:04:05", "preserved"), ("string", "late", "unsupported"),
        ("blank", None, "preserved"), ("integer", "1000", "preserved"), ("decimal", "1.5", "preserved"), ("string", "NaN", "unsupported"), ("date", "2024-01-01", "preserved"), ("duration", "43200", "preserved"), ("date", "1899-12-30", "normalized"), ("blank", None, "preserved"),
    ]


def test_colours(spark):
    df = spark.createDataFrame([("FF8000",), ("#80FF0000",), ("12",)], "c string").select(values.rgb(F.col("c")).alias("x"))
    got = [r["x"] for r in df.collect()]
    assert (got[0]["r"], got[0]["g"], got[0]["b"], got[0]["a"]) == (255, 128, 0, 1.0) and abs(got[1]["a"] - 128 / 255) < 1e-9 and got[2] is None
    assert values.sheet_tint(100, 100, 100, 1.0) == (255, 255, 255) and values.sheet_tint(100, 100, 100, -1.0) == (0, 0, 0)
    assert values.show_number(Decimal("1"), '0"a;b";0') == "1a;b"


def test_templates(spark):
    cases = [("/a/*/c", "/a/1/c", True), ("/a/*/c", "/a/1/2/c", False), ("/a/**", "/a", True), ("/a/**", "/a/b/c", True), ("/a/**", "/ab", False), ("/a~1b", "/a~1b", True), ("/a.b/*", "/axb/1", False)]
    df = spark.createDataFrame([(p,) for _, p, _ in cases], "p string")
    for template, pointer, fits in cases:
        assert pointers.template_matches(pointers.segments(template), pointers.segments(pointer)) == fits
        assert (df.filter(F.col("p") == pointer).filter(pointers.template_condition(F.col("p"), template)).count() > 0) == fits
    assert pointers.unescape(pointers.escape("a~/b~1")) == "a~/b~1"


def test_contract_from_a_schema():
    definitions = {"id": {"type": "string"}, "decimal": {"type": "string"}, "tree": {"properties": {"kids": {"type": "array", "items": {"$ref": "#/d/tree"}}}}}
    schema = {"properties": {"nodeId": {"$ref": "#/d/id"}, "size": {"$ref": "#/d/decimal"}, "n": {"type": ["integer", "null"]}, "bag": {"additionalProperties": {"type": "string"}}, "open": {"additionalProperties": True, "properties": {}}, "tree": {"$ref": "#/d/tree"}, "either": {"oneOf": [{"properties": {"a": {"type": "string"}}}, {"properties": {"b": {"type": "boolean"}}}]}}}
    contract = Contract.from_schemas({"nodes": schema}, definitions)
    found = {f.pointer: f.query_type for f in contract.fields}
    assert found["/nodeId"] == "id-string" and found["/size"] == "decimal-string" and found["/n"] == "integer" and found["/bag"] == "map" and found["/bag/*"] == "string" and "/open/**" in found and found["/tree/kids"] == "list" and found["/either/b"] == "boolean"
    assert "lt" in contract.admit("nodes", "/size", "lt")[0].operators
    assert contract.matching("nodes", "/open/x/y") and not contract.matching("nodes", "/none")


def test_cells_of_files_and_of_columns_have_one_typing(spark):
    from pyspark.sql import functions as F

    from factlattice.sources.spreadsheet import cell_value

    cells = [("1", "b", None), ("TRUE", "b", None), ("2", "b", None), ("#N/A", "e", None), ("2024-01-02", "d", None), ("2024-01-02T03:04:05", "d", None), ("late", "d", None), ("", "n", None), ("", "s", None), ("x", "str", "yyyy"), ("-7", "n", None), ("1.50", "n", "0.00"), ("NaN", "n", None)]
    cells += [(raw, "n", code) for raw in ("45292", "0", "59", "60", "61", "45292.75", "-1", "-2") for code in ("yyyy", 'd "h"', "h:mm", "[h]:mm", "[Red]0", "\\y0")]
    cells = [(k, *c, system) for k, (c, system) in enumerate((c, system) for c in cells for system in ("1900", "1904"))]
    df = spark.createDataFrame(cells, "k int, raw string, kind string, code string, system string")
    got = df.select("k", values.typed_cell(F.col("raw"), F.col("kind"), F.col("code"), F.col("system")).alias("v")).collect()
    for r in got:
        _, raw, kind, code, system = cells[r["k"]]
        own, v = cell_value(raw, kind, code, system), r["v"]
        value = None if own["value"] is None else str(own["value"]).lower() if isinstance(own["value"], bool) else own["value"]
        assert (own["type"], value, own["status"]) == (v["type"], v["value"], v["status"]), (raw, kind, code, system)
