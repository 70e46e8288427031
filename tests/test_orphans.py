from datetime import datetime

from dimforge.operators import orphans

T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1)


def test_no_parent_is_lost(spark):
    keys = spark.range(0, 30_000, 3).withColumnRenamed("id", "k")
    refs = spark.range(0, 30_000).withColumnRenamed("id", "r")
    f = orphans.bloom(keys, "k")
    tested = f.test(refs, "r", "maybe")
    assert tested.count() == 30_000
    yes = {r[0] for r in tested.where("maybe").collect()}
    assert set(range(0, 30_000, 3)) <= yes
    assert len(yes) < 10_000 + 600  # a few false positives in a hundred at most


def test_saturated_filter_changes_nothing(spark):
    keys = spark.range(0, 5000, 2).withColumnRenamed("id", "k")
    refs = spark.range(0, 5000).selectExpr("id as r", "id % 7 as period")
    for words in (1, orphans.MAX_WORDS):
        f = orphans.bloom(keys, "k", max_words=words)
        assert f.test(refs, "r", "maybe").where("r % 2 = 0 and not maybe").count() == 0
    got = orphans.find(refs, ref="r", keep=["r", "period"], parents=keys, parent_key="k")
    assert {r.r for r in got.collect()} == set(range(1, 5000, 2))


def test_kinds_nulls_ties_and_repeats(spark):
    refs = spark.createDataFrame([(1, 5, T1), (2, 6, T1), (3, None, T1), (4, 7, T1), (5, 5, None), (6, 8, T2), (6, 8, T2)], "id int, ref long, at timestamp_ntz")
    parents = spark.createDataFrame([(5, T1), (7, T2), (7, T1), (8, T1), (None, T1)], "id long, at timestamp_ntz")
    got = orphans.find(refs, ref="ref", keep=["id"], parents=parents, parent_key="id", changed="at", parent_changed="at")
    assert sorted((r.id, r.kind) for r in got.collect()) == [(2, "missing")]
    late = orphans.find(refs, ref="ref", keep=["id"], parents=parents.where("at > '2024-01-15' or id = 5"), parent_key="id", changed="at", parent_changed="at")
    assert sorted((r.id, r.kind) for r in late.collect()) == [(2, "missing"), (4, "late"), (6, "missing"), (6, "missing")]


def test_names_and_empty_tables(spark):
    refs = spark.createDataFrame([(1, " Search\t"), (2, "  "), (3, ""), (4, "nope"), (5, None), (6, "x" * 100_000)], "id int, name string")
    parents = spark.createDataFrame([("search",)], "name string")
    find = lambda r, p: sorted((x.id, x.kind) for x in orphans.find(r, ref="name", keep=["id"], parents=p, parent_key="name", text=True).collect())
    assert find(refs, parents) == [(4, "missing"), (6, "missing")]
    assert find(refs, parents.limit(0)) == [(1, "missing"), (4, "missing"), (6, "missing")]
    assert find(refs.limit(0), parents) == []
    assert orphans.report(orphans.find(refs, ref="name", keep=["id"], parents=parents, parent_key="name", text=True), ["id"]).count() == 2
