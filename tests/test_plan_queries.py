from dimforge.queries import warehouse


def test_plans_cover_all_days_of_the_tables(spark, data):
    """Their SQL is compared in test_queries."""
    ends = spark.read.parquet(f"{data}/orders.parquet").selectExpr("date(o_orderdate) as d").union(spark.read.parquet(f"{data}/lineitem.parquet").selectExpr("date(l_shipdate)"))
    lo, hi = ends.selectExpr("min(d)", "max(d)").first()
    days = warehouse.plan_generate(spark, data).selectExpr("date(at) as d").collect()
    assert len(days) == len({r.d for r in days}) == (hi - lo).days + 1 > 366
    assert {r.d.year for r in warehouse.plan_actionable(spark, data).selectExpr("date(at) as d").collect()} > {1996}
