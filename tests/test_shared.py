import pytest
from pyspark.sql import functions as F

from textledger.sources import shared

WIDE = {
    "string": "repeat('x', 1000)",
    "binary": "CAST(repeat('x', 1000) AS BINARY)",
    "numbers": "array_repeat(1L, 125)",
    "strings": "array_repeat(repeat('x', 100), 10)",
    "struct": "struct(1 AS one, repeat('x', 1000) AS text)",
    "structs": "array_repeat(struct(repeat('x', 100) AS text, array(1) AS more), 10)",
    "map": "map('key', repeat('x', 1000))",
}


@pytest.mark.parametrize("name", WIDE)
def test_what_is_broadcast_is_measured_for_every_type(spark, tmp_path, monkeypatch, name):
    rows = spark.range(200).select("id", F.expr(WIDE[name]).alias("a b.c"))
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 150_000)
    table, number = shared.stored_for_join(rows, "wide")
    assert number == 200 and "broadcast" not in table._jdf.queryExecution().logical().toString()
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 400_000)
    table, _ = shared.stored_for_join(rows, "wide")
    assert "broadcast" in table._jdf.queryExecution().logical().toString()


def test_nothing_is_small(spark):
    kinds = "a string, b binary, c array<string>, d struct<x: string>, e map<string, int>, f array<long>, g int"
    table, number = shared.stored_for_join(spark.createDataFrame([(None,) * 7], kinds), "nulls")
    assert number == 1 and "broadcast" in table._jdf.queryExecution().logical().toString()
    assert shared.stored_for_join(spark.createDataFrame([], kinds), "none")[1] == 0
