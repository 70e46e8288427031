"""References to records that don't exist, or came later than what refers to them.

A Bloom filter of the parent keys is built where they are, combined word by word and broadcast, its
size bounded. A reference whose bits aren't all set is a definite orphan;
only the rest are looked up, by an exact join. The filter never decides that a parent exists,
so its size affects cost, not results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dimforge.functions.names import col, free, require

HASHES = 5
#: Upper bound of a filter: 4 Mi words are 32 MB, good for some 27 million keys at one false positive in a hundred.
MAX_WORDS = 1 << 22


BITS_PER_KEY = 10
#: Words of a block; some 1600 keys share one.
BLOCK_WORDS = 256


def _block(c: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(2)), F.lit(blocks)).cast("int")


def _positions(c: Column) -> list[Column]:
    """Bit numbers of a key within its block, by double hashing."""
    bits = BLOCK_WORDS * 64
    h = F.pmod(F.xxhash64(c), F.lit(bits))
    g = F.pmod(F.xxhash64(c, F.lit(1)), F.lit(bits - 1)) + 1
    return [F.pmod(h + g * i, F.lit(bits)) for i in range(HASHES)]


@dataclass(frozen=True)
class Bloom:
    """A filter cut into blocks, one row each (`block`, `words`), to be broadcast; a key's bits are all in one block."""

    blocks: int
    rows: DataFrame

    def test(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """`df` with boolean `name`: false where `key` is certainly not among the keys. Rows with a null key are lost."""
        block, words = free([*df.columns, name], "__block", "__words")
        found = df.withColumn(block, _block(col(key), self.blocks))
        # At most MAX_WORDS words in all: that bounds the broadcast.
        found = found.join(F.broadcast(self.rows.withColumnsRenamed({"block": block, "words": words})), block)
        out = F.lit(True)
        for p in _positions(col(key)):
            word = F.get(F.col(words), F.call_function("shiftright", p, F.lit(6)).cast("int"))
            out = out & (F.call_function("shiftright", word, F.pmod(p, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return found.select(*[col(c) for c in df.columns], out.alias(name))


def bloom(keys: DataFrame, key: str, expected: int | None = None, max_words: int = MAX_WORDS) -> Bloom:
    """A filter of column `key`, sized for `expected` keys (counted if not given; Parquet knows) up to `max_words`.

    Every block is built where its keys meet, and bits are combined before the shuffle.
    """
    n = max(1, keys.count() if expected is None else expected)
    blocks = max(1, math.ceil(min(max_words, n * BITS_PER_KEY / 64) / BLOCK_WORDS))
    c = col(key)
    spots = keys.where(c.isNotNull()).select(_block(c, blocks).alias("block"), F.explode(F.array(*_positions(c))).alias("p"))
    set_bits = spots.select("block", F.call_function("shiftright", F.col("p"), F.lit(6)).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int")).alias("b"))
    one = set_bits.groupBy("block", "w").agg(F.bit_or("b").alias("b"))
    by_word = one.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"))
    every = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))
    zero = F.lit(0).cast("long")
    words = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_WORDS - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), zero))
    filled = every.join(by_word, "block", "left").select("block", F.when(F.col("m").isNull(), F.array_repeat(zero, BLOCK_WORDS)).otherwise(words).alias("words"))
    return Bloom(blocks, filled)


def text_key(c: Column) -> Column:
    """Names to be compared without regard to letter case and surrounding blanks."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def find(refs: DataFrame, *, ref: str, keep: Sequence[str], parents: DataFrame, parent_key: str, changed: str | None = None, parent_changed: str | None = None, text: bool = False, expected: int | None = None) -> DataFrame:
    """Rows of `refs` whose `ref` is an orphan: the `keep` columns and `kind`, missing or late.

    Null references (and, with `text`, blank ones) refer to nothing and are no orphans. `missing`: no
    parent has the key. `late`: a parent has it, but all rows of it were changed after the referring
    row (`parent_changed` later than `changed`). Repeated parents don't repeat rows. Every row is
    judged; with no parents at all every reference is missing.
    """
    require(refs, ref, *keep)
    require(parents, parent_key)
    if "kind" in keep:
        raise ValueError("`kind` is a result column")
    norm = text_key if text else (lambda c: c)
    key, at, parent, since, maybe = free(keep, "__ref", "__changed", "__key", "__since", "__maybe")
    none = F.lit(None).cast("timestamp_ntz")
    r = refs.select(*[col(k) for k in keep], norm(col(ref)).alias(key), (col(changed) if changed else none).alias(at))
    r = r.where(F.col(key).isNotNull() & (F.col(key) != "" if text else F.lit(True)))
    keys = parents.select(norm(col(parent_key)).alias(parent), (col(parent_changed) if parent_changed else none).alias(since)).where(F.col(parent).isNotNull())
    tested = bloom(keys, parent, expected).test(r, key, maybe)
    one = keys.groupBy(parent).agg(F.min(since).alias(since))
    # One pass: references the filter has ruled out stay in it, but nothing is looked up for them.
    checked = tested.join(one, (F.col(key) == F.col(parent)) & F.col(maybe), "left")
    kind = F.when(F.col(parent).isNull(), "missing").when(F.col(since) > F.col(at), "late")
    return checked.select(*[col(k) for k in keep], kind.alias("kind")).where("kind is not null")


def report(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Orphans counted per `by` and kind; counted on the map side first."""
    return found.groupBy(*[col(c) for c in by], "kind").agg(F.count(F.lit(1)).alias("n_refs"))
