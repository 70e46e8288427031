"""Records of several sources mixed so that each has its target share of all tokens.

Weights are propagated down a tree of domains, languages and sources: a source's weight is dealt over its
languages in proportion to what it has of them. What a source can't supply in a language is taken up by other
sources of that language and domain, then by the domain's other languages, and only then by other
domains. Each leaf then gives whole epochs and, of one more, the prefix in a
seeded order that brings it to its budget.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dimforge.functions.names import col, require
from dimforge.session import materialise

#: Documents per bucket of the seeded order; only the bucket in which a leaf's budget ends is sorted.
BUCKET_DOCS = 10_000


def source_key(c: Column) -> Column:
    """Source names without regard to letter case, surrounding blanks, and `-` or a blank for `_`."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[-\s]+", "_")


def source_name(name: str) -> str:
    """:func:`source_key` of a name given on the driver."""
    return re.sub(r"[-\s]+", "_", name.strip().lower())


@dataclass
class Node:
    """A node of the tree: what it should weigh, what its leaves can supply, and what it is given."""

    weight: float = 0.0
    supply: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)
    budget: float = 0.0

    def add(self, path: tuple[str, ...], weight: float, supply: float) -> None:
        self.weight += weight
        self.supply += supply
        if path:
            self.children.setdefault(path[0], Node()).add(path[1:], weight, supply)

    def give(self, budget: float) -> None:
        """Share `budget` among the children by weight; those that can't take their part leave it to the others."""
        self.budget = min(budget, self.supply)
        left, open_ = self.budget, dict(self.children)
        while open_ and left > 1e-9:
            total = sum(c.weight for c in open_.values())
            part = {k: left * (c.weight / total if total > 0 else 1 / len(open_)) for k, c in open_.items()}
            full = [k for k, c in open_.items() if part[k] >= c.supply]
            if not full:
                for k, c in open_.items():
                    c.give(part[k])
                return
            for k in full:
                c = open_.pop(k)
                c.give(c.supply)
                left -= c.supply


def tree(targets: list[tuple[str, float, int]], leaves: list[tuple[str, str, int]], domains: dict[str, str]) -> Node:
    """The tree of one mix, from (source, weight, repeats) and (source, language, tokens); sources without a domain share one."""
    root = Node()
    for s, w, r in targets:
        mine = [(lang, n) for x, lang, n in leaves if x == s]
        total = sum(n for _, n in mine)
        for lang, n in mine:
            root.add((domains.get(s, ""), lang, s), w * n / total, n * r)
        if not mine:
            root.add((domains.get(s, ""), "", s), w, 0)  # in no language, so all of the domain make up for it
    return root


def budgets(root: Node) -> dict[tuple[str, str], float]:
    """What :meth:`Node.give` has given each (source, language)."""
    return {(s, lang): leaf.budget for d in root.children.values() for lang, n in d.children.items() for s, leaf in n.children.items() if leaf.budget > 0}


def largest_total(root: Node) -> float:
    """The largest mix in which nothing runs short but sources without any texts, whose parts their siblings take up."""
    leaves = {(s, lang): leaf for d in root.children.values() for lang, n in d.children.items() for s, leaf in n.children.items() if leaf.supply > 0 and leaf.weight > 0}
    if not leaves:
        return 0.0
    # So little that no leaf with any supply is full: how it is dealt out is how any mix of this size or less is.
    little = min(leaf.supply for leaf in leaves.values()) / 2
    root.give(little)
    return min(leaf.supply * little / leaf.budget for leaf in leaves.values() if leaf.budget > 0)


def fit_edge(bucket: pd.DataFrame) -> pd.DataFrame:
    """Of the bucket in which a leaf's budget ends, the documents in seeded order that still fit.

    One that is too long for the room left is passed over; last, the shortest of those is taken if that
    comes closer to the budget than leaving the room empty.
    """
    rows = bucket.sort_values(["h", "doc_id"], kind="stable")
    room, taken, short = float(rows["room"].iloc[0]), [], None
    for i, n in zip(rows.index, rows["n_tokens"].tolist()):
        if n <= room:
            taken.append(i)
            room -= n
        elif short is None or n < short[1]:
            short = (i, n)
    if short is not None and short[1] - room < room:
        taken.append(short[0])
    return rows.loc[taken]


def mix(documents: DataFrame, targets: DataFrame, *, doc_id: str, source: str, language: str, size: str, mix_name: str = "mix_name", share: str = "target_share", repeats: str = "max_repeats", domains: dict[str, str] | None = None, total: float | None = None, fraction: float | None = None, seed: int = 7) -> DataFrame:
    """The documents of every mix: `mix_name`, `source`, `doc_id`, `epoch` (which repetition, from 1), `n_tokens`.

    `documents` has one row per document with its `size` in tokens, its `source` as it is spelled and
    a `language` code or null; `targets` the share and largest number of repeats of each source in
    each mix; `domains` says which domain a source belongs to (names as :func:`source_key` gives them). A mix is `total`
    tokens large, or `fraction` of all tokens of its sources; by default as large as it can be with every source that
    has texts at its share. No document is in a mix more often than its source's repeats allow. Only
    whole documents are taken, so a leaf's budget is met to within half a short document. Documents of size 0 or of sources
    in no mix aren't taken, sources without documents give nothing, and repeated rows of `targets` count as one with
    their shares added.
    """
    require(documents, doc_id, source, language, size)
    require(targets, mix_name, source, share, repeats)
    spark = documents.sparkSession
    wanted = targets.where(col(source).isNotNull() & (col(share) > 0)).groupBy(col(mix_name).alias("mix"), source_key(col(source)).alias("source")).agg(F.sum(col(share)).alias("w"), F.max(col(repeats)).alias("r"))
    # The targets are a small table that people write; all of it is needed on the driver.
    rows = wanted.orderBy("mix", "source").collect()
    names = sorted({r["source"] for r in rows})
    out = "mix_name string, source string, doc_id long, epoch int, n_tokens long"
    docs = documents.select(col(doc_id).cast("long").alias("doc_id"), source_key(col(source)).alias("source"), F.coalesce(col(language), F.lit("und")).alias("language"), col(size).cast("long").alias("n_tokens"))
    docs = materialise(docs.where(F.col("source").isin(names) & (F.col("n_tokens") > 0)), "mix")
    # At most one leaf per named source and two-letter code.
    leaves = docs.groupBy("source", "language").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()
    tokens = {(x["source"], x["language"]): x["tokens"] for x in leaves}
    of = {source_name(k): v for k, v in (domains or {}).items()}
    plan = []
    for m in sorted({r["mix"] for r in rows}):
        own = [(r["source"], r["w"], r["r"]) for r in rows if r["mix"] == m]
        root = tree(own, [(s, lang, n) for (s, lang), n in tokens.items()], of)
        size = total if total is not None else fraction * sum(n for (s, _), n in tokens.items() if s in {x[0] for x in own}) if fraction is not None else largest_total(root)
        root.give(size)
        for (s, lang), budget in sorted(budgets(root).items()):
            full = int(budget / tokens[s, lang] + 1e-9)
            plan.append((m, s, lang, full, max(0.0, budget - full * tokens[s, lang])))
    if not plan:
        return spark.createDataFrame([], out)
    most = max(x["docs"] for x in leaves)
    buckets = max(1, -(-most // BUCKET_DOCS))
    step = 2**63 // buckets + 1  # of the hash without its sign
    parts = F.broadcast(spark.createDataFrame(plan, "mix string, source string, language string, full int, rest double"))
    drawn = docs.join(parts, ["source", "language"])
    whole = drawn.where("full > 0").select("mix", "source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("full"))).alias("epoch"), "n_tokens")

    place = F.xxhash64(F.lit(seed), F.col("mix"), F.col("full"), F.col("doc_id")).bitwiseAND(F.lit(2**63 - 1))
    order = drawn.where("rest > 0").withColumn("h", place).withColumn("bucket", F.lit(0).cast("long") if buckets == 1 else F.expr(f"h div {step}"))
    key = ["mix", "source", "language"]
    sums = order.groupBy(*key, "bucket", "rest").agg(F.sum("n_tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") >= F.col("rest")))
    # One row per leaf and mix.
    ends = F.broadcast(ends.select(*key, F.col("bucket").alias("end"), "before"))
    placed = order.join(ends, key, "left")
    inside = placed.where(F.col("end").isNull() | (F.col("bucket") < F.col("end")))
    edge = placed.where(F.col("bucket") == F.col("end")).select(*key, "doc_id", "h", "full", (F.col("rest") - F.col("before")).alias("room"), "n_tokens")
    edge = edge.groupBy(*key).applyInPandas(fit_edge, edge.schema)
    cols = ["mix", "source", "doc_id", (F.col("full") + 1).alias("epoch"), "n_tokens"]
    return whole.unionByName(inside.select(*cols)).unionByName(edge.select(*cols)).select(F.col("mix").alias("mix_name"), "source", "doc_id", F.col("epoch").cast("int").alias("epoch"), "n_tokens")


def shares(mixed: DataFrame, targets: DataFrame, *, mix_name: str = "mix_name", source: str = "source", share: str = "target_share") -> DataFrame:
    """Per mix and source: target and actual share of all tokens, tokens, documents, and the most repeats of one document's source."""
    got = mixed.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("epoch").alias("repeats"))
    want = targets.groupBy(col(mix_name).alias("mix_name"), source_key(col(source)).alias("source")).agg(F.sum(col(share)).alias("target_share"))
    j = want.join(got, ["mix_name", "source"], "left").na.fill(0, ["n_tokens", "n_docs", "repeats"])
    total = F.sum("n_tokens").over(Window.partitionBy("mix_name"))
    return j.select("mix_name", "source", "target_share", F.when(total > 0, F.col("n_tokens") / total).otherwise(0.0).alias("actual_share"), "n_tokens", "n_docs", "repeats")
