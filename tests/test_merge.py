from pyspark.sql import functions as F

from dimforge.functions.merge import map_merge, merge_entries
from dimforge.queries import warehouse


def test_entries_merge_as_maps_do(spark):
    rows = [(1, 1, {"a": "1", "b": "2"}), (1, 2, {"a": "3"}), (1, 3, {"b": None}), (1, 4, None), (2, 1, {}), (3, 1, None), (None, 2, {"c": "4"}), (None, None, {"c": "5", "d": "6"})]
    df = spark.createDataFrame(rows, "u int, o int, m map<string,string>")
    got = {r.u: r.m for r in merge_entries(df, ["u"], F.col("m"), F.col("o"), "m").collect()}
    assert got == {r.u: r.m for r in df.groupBy("u").agg(map_merge(F.col("m"), F.col("o")).alias("m")).collect()}
    assert got == {1: {"a": "3", "b": None}, 2: {}, 3: {}, None: {"c": "4", "d": "6"}}


def test_no_group_is_gathered_before_its_entries_are_decided(spark, data):
    """The events of a user are combined entry by entry before they meet in one row."""
    plan = warehouse.key_value_merge(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "max_by" in plan and "array_sort" not in plan
