import pytest

from dimforge.operators.timestamps import normalise
from tests.brute import read_time

CASES = [
    (None, "UTC"), ("", "UTC"), ("   ", "UTC"), ("x" * 50_000, "UTC"), ("1706746155", None), ("1706746155.0669999", None), ("1706753452907", None), ("1706753452907123", None), ("1706753452907123456", None), ("12345", None),
    ("2024-02-30T00:00:00Z", None), ("2024-02-29T00:00:00Z", None), ("2023-02-29 00:00:00", "UTC"), ("2024-13-01 10:00:00", "UTC"), ("2024-02-01 24:00:00", "UTC"), ("2024-02-01 23:60:00", "UTC"), ("2024-02-01T09:", "UTC"),
    ("2024-03-31 02:30:00", "Europe/Berlin"), ("2024-10-27 02:30:00", "Europe/Berlin"), ("2024-10-27 01:59:59", "Europe/Berlin"), ("2024-10-27 03:00:00", "Europe/Berlin"), ("2024-04-07 01:45:00", "Australia/Lord_Howe"), ("2024-10-06 02:15:00", "Australia/Lord_Howe"),
    ("2024-02-01 10:00:00", None), ("2024-02-01 10:00:00", "Nowhere/Land"), ("2024-02-01 10:00:00 Europe/Berlin", None), ("2024-02-01T10:00:00+01:00[Europe/Berlin]", "UTC"), ("Feb 1, 2024 12:05:00 AM CET", None), ("Feb 1, 2024 13:05:00 PM", "UTC"),
    ("10 February 2024 00:36", "Asia/Kolkata"), ("Thu, 01 Feb 2024 04:37:56 GMT", None), ("01/Feb/2024:02:04:25 +0100", None), ("31/Nov/2024:08:07:36 +0000", None), ("20240201T084231Z", None), ("yesterday", "UTC"), ("2024-W08", "UTC"), ("07:21", "UTC"), ("N/A", "UTC"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, v, z) for i, (v, z) in enumerate(CASES)], "id int, v string, z string")
    got = {r["id"]: (r["readable"], r["epoch_us"]) for r in normalise(df, "v", "z").collect()}
    for i, (v, z) in enumerate(CASES):
        zone = None if z == "Nowhere/Land" else z
        assert got[i] == read_time(v, zone), (v, z, got[i])


def test_wrong_weekday_and_clashing_names(spark):
    df = spark.createDataFrame([("Fri, 01 Feb 2024 04:37:56 GMT", 1, 2)], "v string, __time int, __parts int")
    row = normalise(df, "v", plain="plain").first()
    assert not row.readable and row["__time"] == 1 and row["__parts"] == 2 and row.plain is False
    with pytest.raises(ValueError):
        normalise(df.withColumnRenamed("__time", "readable"), "v")


def test_empty(spark):
    assert normalise(spark.createDataFrame([], "v string, z string"), "v", "z").count() == 0


def test_all_values_of_a_table(spark, data):
    s = spark.read.parquet(f"{data}/visits_file_fact_stage.parquet")
    t = spark.read.parquet(f"{data}/tenant_dimension.parquet").groupBy("tenant_id").agg({"time_zone": "max"}).toDF("tenant_id", "tz")
    j = s.join(t, s.tenant_dimension_tenant_id == t.tenant_id, "left").select("line_id", "time_key", "tz")
    for r in normalise(j, "time_key", "tz").collect():
        assert (r.readable, r.epoch_us) == read_time(r.time_key, r.tz), r
