"""Which targets are missing, incomplete or stale, and making them in the order of dependence.

A rule says that files or tables of one time pattern are made from those of another. The rules form a
graph, worked out once from their patterns and sorted topologically. Plans are sets of periods
(:class:`Periods`), DataFrames with the beginning of each, and every question about them is one of
:mod:`dimforge.plans.frames` against listings of what is there: one listing per pattern and round,
however many periods a plan has. Only the instances that a command is to make reach the driver.
"""

from __future__ import annotations

import datetime as dt
import graphlib
import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimforge.plans import frames
from dimforge.plans.pattern import Pattern, cut
from dimforge.sources import fs

log = logging.getLogger(__name__)
#: Gives the files (or tables) there are of a pattern: `path` and `mtime`.
Lister = Callable[[Pattern], DataFrame]


class FileLister:
    """Files through Hadoop: one recursive listing below the part of a pattern that is the same for all its instances.

    Answers are kept until :meth:`forget`. `tables`, with columns `path` (a table's name) and `mtime`, stands
    for patterns without a slash.
    """

    def __init__(self, spark: SparkSession, tables: Callable[[], DataFrame] | None = None):
        self.spark, self.tables, self._seen = spark, tables, {}

    def __call__(self, pattern: Pattern) -> DataFrame:
        root = pattern.root
        if root not in self._seen:
            if "/" in pattern.text:
                found = fs.listing(self.spark, root).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
            elif self.tables is not None:
                found = self.tables()
            else:
                found = self.spark.createDataFrame([], "path string, mtime timestamp")
            self._seen[root] = found.cache()
        return self._seen[root]

    def forget(self) -> None:
        for df in self._seen.values():
            df.unpersist()
        self._seen.clear()


@dataclass(eq=False)
class Rule:
    """`run` (given the planner, the rule and the instances to make) makes `target` from `source`.

    `window` is how many source periods before and after belong to a target as well. Only `primary`
    rules make what other rules need.
    """

    name: str
    source: Pattern | None
    target: Pattern
    run: Callable[[Planner, Rule, list[str]], None]
    window: int = 0
    primary: bool = True
    asked: dict[str, set[dt.datetime]] = field(default_factory=lambda: {"source": set(), "target": set()})

    def side(self, which: str) -> Pattern:
        p = self.source if which == "source" else self.target
        if p is None:
            raise ValueError(f"{self.name} has no source")
        return p


class Periods:
    """A set of periods of one side of a rule: `frame` has the beginning of each, once, as `at`."""

    def __init__(self, planner: Planner, rule: Rule, side: str, frame: DataFrame, pattern: Pattern | None = None):
        self.planner, self.rule, self.side, self.frame = planner, rule, side, frame.select("at").distinct()
        self.pattern = pattern or rule.side(side)

    def _with(self, frame: DataFrame) -> Periods:
        return Periods(self.planner, self.rule, self.side, frame, self.pattern)

    def _other(self) -> tuple[str, str, DataFrame]:
        """Steps of this side and the other, and what is there of the other."""
        other = "source" if self.side == "target" else "target"
        p = self.rule.side(other)
        return self.pattern.step, p.step, self.planner.have(p)

    def _judged(self, what: Callable[[DataFrame, DataFrame, str, str, DataFrame], DataFrame]) -> Periods:
        """Only targets with a source are judged by it; of others there is nothing to say."""
        if self.side == "source" or self.rule.source is None:
            return self._with(self.frame.limit(0))
        mine, theirs, have = self._other()
        return self._with(what(self.frame, self.planner.have(self.pattern), mine, theirs, have))

    def times(self) -> list[dt.datetime]:
        """The beginnings in order, on the driver."""
        return sorted(r[0] for r in self.frame.collect())

    def texts(self) -> list[str]:
        return [self.pattern.render(t) for t in self.times()]

    def latest_first(self) -> list[str]:
        return self.texts()[::-1]

    def first(self) -> str | None:
        t = self.frame.agg(F.min("at")).first()[0]
        return None if t is None else self.pattern.render(t)

    def has(self, text: str) -> bool:
        return bool(self.frame.where(F.col("at") == F.lit(cut(self.pattern.time(text), self.pattern.step)).cast("timestamp_ntz")).take(1))

    def __bool__(self) -> bool:
        return bool(self.frame.take(1))

    def __or__(self, other: Periods) -> Periods:
        return self._with(self.frame.union(other.frame))

    def missing(self) -> Periods:
        """Those of which no file is there; an empty folder is nothing."""
        return self._with(frames.missing(self.frame, self.planner.have(self.pattern)))

    def existing(self) -> DataFrame:
        """The files of each: `at`, `path`, `mtime`."""
        return frames.existing(self.frame, self.planner.have(self.pattern))

    def adjacent(self) -> Periods:
        return self._with(frames.adjacent(self.frame, self.pattern.step, self.rule.window))

    def stale(self) -> Periods:
        return self._judged(lambda want, have, mine, theirs, sources: frames.stale(frames.existing(want, have), mine, theirs, sources))

    def incomplete(self) -> Periods:
        return self._judged(lambda want, have, mine, theirs, sources: frames.incomplete(want, mine, theirs, sources))

    def actionable(self) -> Periods:
        return self._judged(frames.actionable)

    def updateable(self) -> Periods:
        return self._judged(frames.updateable)

    def with_grain(self, grain: str) -> Periods:
        return Periods(self.planner, self.rule, self.side, frames.with_grain(self.frame, grain), self.pattern.rounded(grain))

    def sources(self) -> Periods:
        """What targets are made from, windows aside; nothing for sources."""
        return self._across("target", "source")

    def targets(self) -> Periods:
        """What is made from sources; nothing for targets."""
        return self._across("source", "target")

    def _across(self, here: str, there: str) -> Periods:
        to = self.rule.side(there)
        if self.side != here:
            return Periods(self.planner, self.rule, there, self.frame.limit(0))
        return Periods(self.planner, self.rule, there, frames.sources_of(self.frame, self.pattern.step, to.step))


class Planner:
    """Rules by name, what is asked of them, and what is there."""

    def __init__(self, spark: SparkSession, lister: Lister | None = None):
        self.spark, self.lister, self.rules = spark, lister or FileLister(spark), {}
        self._have: dict[tuple[str, str], DataFrame] = {}

    # ------------------------------------------------------------------------------ declaring, asking

    def rule(self, name: str, source: str | None, target: str, run: Callable[[Planner, Rule, list[str]], None] = lambda p, r, t: None, *, window: int = 0, primary: bool = True, zone: str = "UTC") -> Rule:
        self.rules[name] = Rule(name, Pattern(source, zone) if source else None, Pattern(target, zone), run, window, primary)
        return self.rules[name]

    def command(self, source: str | None, target: str, **options) -> Callable:
        """Decorator: the function makes the targets of a rule named after it."""

        def mark(f: Callable[[Planner, Rule, list[str]], None]) -> Callable:
            self.rule(f.__name__, source, target, f, **options)
            return f

        return mark

    def periods(self, name: str, side: str, times: Iterable[dt.datetime]) -> Periods:
        rows = [(t,) for t in sorted(set(times))]
        return Periods(self, self.rules[name], side, self.spark.createDataFrame(rows, "at timestamp_ntz"))

    def for_range(self, name: str, start: dt.datetime, stop: dt.datetime, side: str = "target") -> Periods:
        """All periods from `start` to `stop`, both included and given in UTC."""
        p = self.rules[name].side(side)
        lo, hi = (p.local(t).isoformat() for t in (start, stop))
        return Periods(self, self.rules[name], side, frames.generate(self.spark, lo, hi, p.step))

    def of(self, name: str, side: str, texts: Iterable[str]) -> Periods:
        """The periods that instances of a rule's pattern are for; a text that is none is an error."""
        p = self.rules[name].side(side)
        return self.periods(name, side, [cut(p.time(x), p.step) for x in texts])

    def prepare(self, name: str, *, targets: Iterable[str] = (), sources: Iterable[str] = ()) -> None:
        """Ask for targets of a rule, or for those that come from some sources."""
        r = self.rules[name]
        r.asked["target"] |= {cut(r.target.time(x), r.target.step) for x in targets}
        r.asked["source"] |= {cut(r.side("source").time(x), r.side("source").step) for x in sources}

    # -------------------------------------------------------------------------------------- the graph

    def makers(self, pattern: Pattern) -> list[str]:
        """Primary rules whose target an instance of `pattern` is."""
        probe = pattern.render(dt.datetime(2001, 2, 3, 4))
        return [n for n, r in self.rules.items() if r.primary and r.target.covers(probe)]

    def rule_for(self, text: str) -> str | None:
        """The rule that makes `text`; None if it is only ever read. A text that no rule knows is an error."""
        makes = [n for n, r in self.rules.items() if r.primary and r.target.covers(text)]
        if len(makes) > 1:
            log.error("several rules make %s: %s", text, ", ".join(makes))
        if not makes and not any(r.source and r.source.covers(text) for r in self.rules.values()):
            raise LookupError(f"no rule knows {text}")
        return makes[0] if makes else None

    def upstream(self) -> dict[str, str | None]:
        """Of each rule, the rule that makes its source, if one does."""
        return {n: next(iter(self.makers(r.source)), None) if r.source else None for n, r in self.rules.items()}

    def order(self) -> list[str]:
        """All rules, each after what it needs; a cycle is an error."""
        try:
            return list(graphlib.TopologicalSorter({n: [u] if u else [] for n, u in self.upstream().items()}).static_order())
        except graphlib.CycleError as e:
            raise RecursionError(f"rules depend on each other: {' <- '.join(e.args[1])}") from None

    # ------------------------------------------------------------------------------------ what to make

    def have(self, pattern: Pattern) -> DataFrame:
        """What is there of `pattern`: `path`, `mtime`, `at`."""
        key = (pattern.text, pattern.zone)
        if key not in self._have:
            self._have[key] = frames.bind(self.lister(pattern), pattern, below=True).withColumn("mtime", F.col("mtime").cast("timestamp_ntz"))
        return self._have[key]

    def forget(self) -> None:
        """List anew at the next question."""
        self._have.clear()
        if hasattr(self.lister, "forget"):
            self.lister.forget()

    def sources(self, name: str) -> Periods:
        """What a rule reads for all that is wanted of it, its window included."""
        return self.wanted(name).sources().adjacent()

    def wanted(self, name: str, resolve: bool = True) -> Periods:
        """Targets asked of a rule, and with `resolve` those that rules which build on it need."""
        r = self.rules[name]
        out = self.periods(name, "target", r.asked["target"])
        if r.source:
            out = out | self.periods(name, "source", r.asked["source"]).targets()
        if resolve:
            self.order()  # no cycles from here on
            for n in [n for n, u in self.upstream().items() if u == name]:
                needed = self.sources(n)
                out = out | Periods(self, r, "target", frames.with_grain(needed.frame, r.target.step))
        return out

    def execute(self, name: str, *, resolve: bool = True) -> list[str]:
        """Make what has to be made for rule `name`, first what it needs; the names of the rules that ran.

        Where nothing wanted of a rule is actionable, neither it nor, for its sake, anything upstream runs.
        """
        chain, up = [], self.upstream()
        self.order()
        at: str | None = name
        while at is not None and self.wanted(at, resolve).actionable():
            chain.append(at)
            at = up[at] if resolve else None
        ran = []
        for n in reversed(chain):
            todo = self.wanted(n, resolve).actionable().texts()
            if todo:
                self.rules[n].run(self, self.rules[n], todo)
                self.forget()
                ran.append(n)
        return ran
