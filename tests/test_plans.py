import datetime as dt

import pytest

from dimforge.plans import dates
from dimforge.plans.pattern import Pattern, cut, move
from dimforge.plans.planner import Planner

D = dt.datetime


@pytest.mark.parametrize(
    "text,step,instance,time",
    [
        ("/raw/%Y/%m-%d.*.gz", "day", "/raw/2021/06-09.eu.gz", D(2021, 6, 9)), ("/clean/day=%Y%m%d", "day", "/clean/day=20210609", D(2021, 6, 9)), ("/sums/%Y/%m", "month", "/sums/2021/07", D(2021, 7, 1)),
        ("/h/%Y-%-m-%-d/%-k", "hour", "/h/2021-6-9/3", D(2021, 6, 9, 3)), ("/s/%H-s", "hour", "/s/1623196800", D(2021, 6, 9)), ("/s/%d-s", "day", "/s/1623196800", D(2021, 6, 9)), ("visits_y%Ym%m", "month", "visits_y2022m12", D(2022, 12, 1)),
    ],
)
def test_patterns(spark, text, step, instance, time):
    p = Pattern(text)
    assert p.step == step and p.matches(instance) and p.time(instance) == time
    assert not p.matches(instance + "/more") and p.matches(instance + "/*") and not p.matches("x" + instance)
    assert p.covers(instance + "/more") or "*" in text
    glob = p.match(instance).get("glob")
    assert p.render(time, glob) == instance
    df = spark.createDataFrame([(instance,), ("nothing",), (None,)], "path string")
    assert [r.t for r in df.select(p.time_column(df.path).alias("t")).collect()] == [time, None, None]


def test_rounding_and_steps():
    p = Pattern("/clean/%Y/%m/day=%d")
    assert p.rounded("month").text == "/clean/%Y/%m"
    with pytest.raises(ValueError):
        p.rounded("hour")
    assert move(D(2024, 1, 31), "month") == D(2024, 2, 29) and move(D(2024, 3, 1), "month", -1) == D(2024, 2, 1) and cut(D(2024, 5, 6, 7, 8), "year") == D(2024, 1, 1)


def planner(spark, files, log=None):
    """Raw logs of several sites a day, a cleaned folder per day, and two tables of sums built on these."""
    stamp = lambda s: D(1970, 1, 1) + dt.timedelta(seconds=s)
    p = Planner(spark, lambda pattern: spark.createDataFrame([(f, stamp(m)) for f, m in files.items()], "path string, mtime timestamp_ntz"))

    def run(planner, rule, todo):
        if log is not None:
            log.append((rule.name, todo))
        for t in todo:
            files[f"{t}/made" if "/" in t else t] = 9_000_000

    p.rule("clean", "/raw/%Y/%m-%d.*.gz", "/clean/day=%Y%m%d", run)
    p.rule("sums", "/clean/day=%Y%m%d", "/sums/%Y/%m", run)
    p.rule("weekly", "/clean/day=%Y%m%d", "weekly_%Y%m%d", run, window=3)
    return p


def test_sets(spark):
    p = planner(spark, {"/raw/2021/06-09.eu.gz": 60, "/raw/2021/06-09.us.gz": 600, "/raw/2021/06-11.eu.gz": 60, "/clean/day=20210609/part-0": 300, "/clean/day=20210611/part-0": 300, "/clean/day=20210611x/part-0": 300})
    t = p.for_range("clean", D(2021, 6, 9), D(2021, 6, 11))
    assert t.texts() == [f"/clean/day=2021060{i}" if i < 10 else f"/clean/day=202106{i}" for i in (9, 10, 11)] == t.latest_first()[::-1] and t.first() == "/clean/day=20210609"
    assert t.missing().texts() == ["/clean/day=20210610"] == t.incomplete().texts()
    assert sorted(r.path for r in t.existing().collect()) == ["/clean/day=20210609/part-0", "/clean/day=20210611/part-0"]
    assert t.stale().texts() == ["/clean/day=20210609"] == t.updateable().texts()
    assert t.actionable().texts() == ["/clean/day=20210609", "/clean/day=20210610"]
    assert t.sources().texts() == ["/raw/2021/06-09.*.gz", "/raw/2021/06-10.*.gz", "/raw/2021/06-11.*.gz"]
    assert t.sources().targets().texts() == t.texts() and not t.targets() and not t.sources().sources() and not t.sources().stale()
    assert t.has("/clean/day=20210610") and not t.has("/clean/day=20220610")
    assert (t | p.of("clean", "target", ["/clean/day=20210630", "/clean/day=20210609"])).texts()[-1] == "/clean/day=20210630"
    m = p.for_range("sums", D(2021, 6, 30), D(2021, 6, 30))
    assert m.texts() == ["/sums/2021/06"] and len(m.sources().times()) == 30 and m.incomplete()
    days = p.for_range("sums", D(2021, 6, 9), D(2021, 7, 1), "source")
    assert days.targets().texts() == ["/sums/2021/06", "/sums/2021/07"]
    assert m.with_grain("year").texts() == ["/sums/2021"]
    assert not p.periods("clean", "target", []).actionable() and p.periods("clean", "target", []).first() is None


def test_a_gap_in_one_folder_is_seen(spark):
    p = planner(spark, {"/clean/day=20210609/part-0": 60})
    assert p.for_range("weekly", D(2021, 6, 9), D(2021, 6, 9)).missing().texts() == ["weekly_20210609"]
    p.prepare("weekly", targets=["weekly_20210610"])
    assert p.sources("weekly").texts() == [f"/clean/day=202106{i:02d}" for i in range(7, 14)]
    with pytest.raises(ValueError):
        p.prepare("weekly", targets=["weakly_20210610"])


def test_execute(spark):
    ran = []
    p = planner(spark, {"/raw/2021/06-09.eu.gz": 60}, ran)
    p.prepare("weekly", targets=["weekly_20210609"])
    assert p.order().index("clean") < p.order().index("weekly")
    assert p.execute("weekly") == ["clean", "weekly"]
    assert ran[0] == ("clean", [f"/clean/day=202106{i:02d}" for i in range(6, 13)]) and ran[1] == ("weekly", ["weekly_20210609"])
    assert p.execute("weekly") == []
    alone = planner(spark, {"/clean/day=20210609/p": 60}, ran)
    alone.prepare("weekly", sources=["/clean/day=20210609"])
    assert alone.execute("weekly", resolve=False) == ["weekly"]
    assert p.rule_for("/raw/2021/06-09.eu.gz") is None and p.rule_for("/clean/day=20210609/part-1") == "clean"
    with pytest.raises(LookupError):
        p.rule_for("/unheard/of")


def test_cycles_and_ambiguity(spark, caplog):
    p = planner(spark, {})
    p.rule("again", None, "/clean/day=%Y%m%d")
    assert p.rule_for("/clean/day=20210609") == "clean" and "several rules" in caplog.text
    loop = planner(spark, {})
    loop.rule("back", "/sums/%Y/%m", "/raw/%Y/%m-%d.*.gz")
    with pytest.raises(RecursionError):
        loop.execute("sums")


def test_files_and_commands(spark, tmp_path):
    p = Planner(spark)
    made = []

    @p.command(f"{tmp_path}/in/%Y-%m-%d.txt", f"{tmp_path}/out/d=%Y-%m-%d")
    def copy(planner, rule, todo):
        for t in todo:
            made.append(t)
            (tmp_path / "out" / t.rsplit("/", 1)[1]).mkdir(parents=True)
            (tmp_path / "out" / t.rsplit("/", 1)[1] / "part").write_text("x")

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "2021-06-09.txt").write_text("x")
    (tmp_path / "out" / "d=2021-06-09").mkdir(parents=True)  # an empty folder is nothing
    p.prepare("copy", sources=[f"{tmp_path}/in/2021-06-09.txt"])
    (tmp_path / "out" / "d=2021-06-09").rmdir()
    assert p.execute("copy") == ["copy"] and made == [f"{tmp_path}/out/d=2021-06-09"]
    assert p.execute("copy") == []


def test_dates():
    now = D(2024, 3, 31, 12, 30)
    for text, want in {"today": D(2024, 3, 31), "yesterday": D(2024, 3, 30), "1 month ago": D(2024, 2, 29, 12, 30), "two days from now": D(2024, 4, 2, 12, 30), "2024-02-03": D(2024, 2, 3), "20240203": D(2024, 2, 3), "2024-02": D(2024, 2, 1), "2024-02-03T04:05:06+01:00": D(2024, 2, 3, 3, 5, 6), "last monday": D(2024, 3, 25), "next sunday": D(2024, 4, 7), "last sunday": D(2024, 3, 24)}.items():
        assert dates.parse(text, now) == want, text
    with pytest.raises(ValueError):
        dates.parse("whenever", now)
