"""Queries of the data problems over texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimforge.llm import langid, mixing, packing, tokens
from dimforge.session import materialise


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Every text in a container of each capacity."""
    docs = _table(spark, sf, "documents")
    kinds = tokens.with_capacity(_table(spark, sf, "container_size"), "container_name", "capacity_tokens")
    sized = tokens.lengths(docs.where("text is not null"), text="text", keep=["doc_id"])
    packed = packing.pack(sized, kinds, item="doc_id", size="n_tokens", expected=docs.count())
    return packed.withColumnsRenamed({"item": "doc_id", "start": "start_token"})


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How well the containers are filled."""
    return packing.fill_report(p8_packed(spark, sf), _table(spark, sf, "container_size"), "container_name", "capacity_tokens")


#: Where texts are written, and where they are copied to.
DOMAINS = {"wiki_main": "live", "wiki_regional": "live", "wiki_sister": "live", "wiki_lab": "live", "wiki_archive": "copies", "wiki_mirror": "copies", "wiki_offline": "copies"}


def _mix(spark: SparkSession, sf: str, **size: float) -> DataFrame:
    docs = _table(spark, sf, "documents").where("text is not null")
    docs = docs.select("doc_id", "source", langid.label_code(F.col("lang")).alias("language"), "text")
    sized = tokens.lengths(docs, text="text", keep=["doc_id", "source", "language"])
    return mixing.mix(sized, _table(spark, sf, "mix_target"), doc_id="doc_id", source="source", language="language", size="n_tokens", domains=DOMAINS, **size)


def p9_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of each mix."""
    return _mix(spark, sf)


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual shares."""
    return mixing.shares(p9_mixed(spark, sf), _table(spark, sf, "mix_target"))


def p9_scarce(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of mixes of half of all tokens, for which some sources have too few: siblings make up for them first."""
    return mixing.shares(_mix(spark, sf, fraction=0.5), _table(spark, sf, "mix_target"))


def p8_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Of each kind of container: texts packed, and how often a rule of packing is broken."""
    kinds = _table(spark, sf, "container_size").groupBy("container_name").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    packed = materialise(p8_packed(spark, sf), "packed")
    bins = packed.groupBy("container_name", "bin_id").agg(F.sum("n_tokens").alias("n"))
    over = bins.join(kinds, "container_name").groupBy("container_name").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("n_overfull"))
    # Pieces lie end to end if each begins at the sum of those before it; equal counts and sums say so without an order.
    docs = packed.groupBy("container_name", "doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.count(F.lit(1)).alias("pieces"), F.max("piece_no").alias("last"), F.countDistinct("start_token").alias("starts"))
    torn = (F.col("n") != F.col("end")) | (F.col("pieces") != F.col("last")) | (F.col("starts") != F.col("pieces"))
    split = (F.col("pieces") > 1) & (F.col("n") <= F.col("capacity_tokens"))
    checked = docs.join(kinds, "container_name").groupBy("container_name", "capacity_tokens").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(torn).alias("n_torn"), F.count_if(split).alias("n_split_needlessly"))
    return checked.join(over, "container_name")


P8_KEPT = "select container_name, max(capacity_tokens) as capacity_tokens, (select count(*) from documents where text is not null) as n_docs, 0::bigint as n_torn, 0::bigint as n_split_needlessly, 0::bigint as n_overfull from container_size group by 1"


def p9_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Of each mix and source: whether anything was taken, and how often a rule of mixing is broken."""
    wanted = _table(spark, sf, "mix_target").groupBy("mix_name", mixing.source_key(F.col("source")).alias("source")).agg(F.max("max_repeats").alias("r"))
    mixed = materialise(p9_mixed(spark, sf), "mixed")
    own = _table(spark, sf, "documents").where("text is not null").select("doc_id", mixing.source_key(F.col("source")).alias("s"))
    taken = mixed.groupBy("mix_name", "source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("epoch").alias("last"), F.countDistinct("epoch").alias("epochs")).join(own, "doc_id", "left")
    bad = taken.join(wanted, ["mix_name", "source"]).groupBy("mix_name", "source").agg(
        F.count_if((F.col("last") > F.col("r")) | (F.col("n") > F.col("r"))).alias("over"), F.count_if(F.col("n") != F.col("epochs")).alias("twice"), F.count_if(~F.col("s").eqNullSafe(F.col("source"))).alias("strange"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(f"n_{c}")
    return wanted.join(bad, ["mix_name", "source"], "left").select("mix_name", "source", F.col("over").isNotNull().alias("taken"), zero("over"), zero("twice"), zero("strange"))


_SOURCE = "regexp_replace(lower(trim(source)), '[-\\s]+', '_', 'g')"
P9_KEPT = f"""
select mix_name, {_SOURCE} as source, {_SOURCE} in (select {_SOURCE} from documents where length(text) > 0) as taken, 0::bigint as n_over, 0::bigint as n_twice, 0::bigint as n_strange from mix_target group by all
"""


def _model(spark: SparkSession, sf: str) -> langid.Model:
    return langid.fit(_table(spark, sf, "documents"), doc_id="doc_id", text="text", label="lang")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return langid.mislabelled(docs, _model(spark, sf), doc_id="doc_id", text="text", label="lang").select("doc_id", "segment_no", "lang")


def p10_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Language and confidence of every document and piece."""
    return langid.identify(_table(spark, sf, "documents"), _model(spark, sf), doc_id="doc_id", text="text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p8_packed, p8_fill, p8_kept, p9_mixed, p9_shares, p9_scarce, p9_kept, p10_found, p10_languages)}


def oracle_sql() -> dict[str, str]:
    """Tokenizers, packing, seeded order and compression have no SQL; the rules of packing and mixing have."""
    return {"p8_kept": P8_KEPT, "p9_kept": P9_KEPT}
