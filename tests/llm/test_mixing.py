import random

import pytest

from dimforge.llm import mixing

T = "mix_name string, source string, target_share double, max_repeats int"
ARGS = {"doc_id": "doc_id", "source": "source", "language": "language", "size": "n"}


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, language string, n long")


def test_siblings_take_up_shortages_before_others():
    root = mixing.Node()
    root.add(("a", "a1"), 0.3, 10)
    root.add(("a", "a2"), 0.3, 1000)
    root.add(("b", "b1"), 0.4, 1000)
    root.give(100)
    a, b = root.children["a"], root.children["b"]
    assert (a.budget, b.budget) == pytest.approx((60, 40))
    assert a.children["a1"].budget == pytest.approx(10) and a.children["a2"].budget == pytest.approx(50)
    root.give(3000)  # more than there is
    assert root.budget == pytest.approx(2010)


def test_mix(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["Wiki_Main", "wiki-main", " wiki_main"]), rnd.choice(["en", "de", None]), rnd.randrange(1, 40)) for i in range(3000)]
    rows += [(10_000 + i, "wiki_small", "en", rnd.randrange(1, 40)) for i in range(60)]
    rows += [(20_000, None, "en", 5), (20_001, "other", "en", 5), (20_002, "wiki_main", "en", 0), (20_003, "wiki_main", "en", None)]
    targets = spark.createDataFrame([("m", "wiki_main", 0.6, 1), ("m", "wiki_small", 0.3, 3), ("m", "wiki_none", 0.1, 2), ("n", "wiki_main", 1.0, 2)], T)
    mixed = mixing.mix(docs(spark, rows), targets, **ARGS)
    got = mixed.collect()
    sizes = {r[0]: r[3] for r in rows}
    assert all(r.n_tokens == sizes[r.doc_id] for r in got)
    assert len({(r.mix_name, r.doc_id, r.epoch) for r in got}) == len(got)
    assert max(r.epoch for r in got if r.mix_name == "m" and r.source == "wiki_small") <= 3
    assert max(r.epoch for r in got if r.mix_name == "m" and r.source == "wiki_main") == 1
    shares = {(r.mix_name, r.source): r for r in mixing.shares(mixed, targets).collect()}
    assert shares["m", "wiki_main"].actual_share == pytest.approx(0.6 / 0.9, abs=0.01)
    assert shares["m", "wiki_small"].actual_share == pytest.approx(0.3 / 0.9, abs=0.01)
    assert shares["m", "wiki_none"].n_tokens == 0
    assert sum(r.n_tokens for r in got if r.mix_name == "n") == pytest.approx(2 * sum(r[3] for r in rows[:3000]), rel=0.001)
    again = mixing.mix(docs(spark, rows).repartition(6), targets, **ARGS).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_total_and_short_sources(spark):
    rows = [(i, "wiki_a", "en", 10) for i in range(100)] + [(1000 + i, "wiki_b", "en", 10) for i in range(10)]
    targets = spark.createDataFrame([("m", "wiki_a", 0.5, 5), ("m", "wiki_b", 0.25, 2), ("m", "wiki_b", 0.25, 2)], T)
    s = {r.source: r for r in mixing.shares(mixing.mix(docs(spark, rows), targets, **ARGS, total=1000), targets).collect()}
    assert (s["wiki_b"].n_tokens, s["wiki_b"].repeats, s["wiki_a"].n_tokens) == (200, 2, 800)


def test_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 20)
    rows = [(i, "wiki_a", "en", 1 + i % 9) for i in range(1000)]
    targets = spark.createDataFrame([("m", "wiki_a", 1.0, 1)], T)
    got = mixing.mix(docs(spark, rows), targets, **ARGS, total=2000).collect()
    assert abs(sum(r.n_tokens for r in got) - 2000) <= 1


def test_nothing(spark):
    targets = spark.createDataFrame([("m", "wiki_a", 1.0, 1)], T)
    assert mixing.mix(docs(spark, []), targets, **ARGS).count() == 0
    assert mixing.mix(docs(spark, [(1, "wiki_a", "en", 5)]), targets.limit(0), **ARGS).count() == 0


def test_shortages_go_to_siblings_then_to_ancestors():
    targets = [("a1", 0.3, 1), ("a2", 0.3, 1), ("b1", 0.4, 1)]
    domains = {"a1": "a", "a2": "a", "b1": "b"}
    leaves = [("a1", "en", 10), ("a2", "en", 20), ("a2", "de", 50), ("b1", "en", 1000)]
    root = mixing.tree(targets, leaves, domains)
    total = lambda s: sum(v for (x, _), v in mixing.budgets(root).items() if x == s)
    root.give(10)
    assert (total("a1"), total("a2"), total("b1")) == pytest.approx((3, 3, 4))
    root.give(60)  # a1 lacks 8: a2 in English takes what it has left, German the rest; b1 nothing
    got = mixing.budgets(root)
    assert got["a1", "en"] == pytest.approx(10) and total("a2") == pytest.approx(26) and total("b1") == pytest.approx(24)
    assert got["a2", "en"] > 60 * 0.3 * 20 / 70  # more than its own part
    root.give(200)  # the domain has 80 in all; the rest is made up for by the other one
    assert total("a1") + total("a2") == pytest.approx(80) and total("b1") == pytest.approx(120)
    root = mixing.tree([*targets, ("a3", 0.2, 3)], leaves, {**domains, "a3": "a"})  # of a3 there is nothing
    size = mixing.largest_total(root)
    root.give(size)
    assert total("b1") == pytest.approx(size * 0.4 / 1.2) and total("a1") == pytest.approx(10)
