"""Items of varying length into containers of fixed capacity, by best-two-fit.

A container is filled greedily with the largest item that fits. Then its smallest item is taken out
again if two unpacked items fill the gap this leaves more tightly. Items are dealt into shards of
bounded size by a hash, and every shard is packed by itself: no task sees more than a shard, and the
only loss against packing everything together is one not quite full container per shard.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimforge.functions.names import col, require

SHARD_ITEMS = 20_000


class Pool:
    """Unpacked items by size."""

    def __init__(self, sizes: Sequence[int]):
        self.of: dict[int, list[int]] = {}
        for i in range(len(sizes) - 1, -1, -1):
            self.of.setdefault(sizes[i], []).append(i)
        self.sizes = sorted(self.of)

    def take(self, size: int) -> int:
        own = self.of[size]
        i = own.pop()
        if not own:
            del self.of[size]
            self.sizes.pop(bisect_left(self.sizes, size))
        return i

    def put(self, size: int, i: int) -> None:
        if size not in self.of:
            self.of[size] = []
            self.sizes.insert(bisect_left(self.sizes, size), size)
        self.of[size].append(i)

    def largest(self, most: int) -> int | None:
        k = bisect_right(self.sizes, most)
        return self.sizes[k - 1] if k else None

    def best_two(self, most: int, more_than: int) -> tuple[int, int] | None:
        """Two sizes with the greatest sum up to `most`, if that is more than `more_than`."""
        s = self.sizes
        if not s:
            return None
        low, high, best, pair = 0, bisect_right(s, most - s[0]) - 1, more_than, None
        while low <= high:
            total = s[low] + s[high]
            if total > most:
                high -= 1
                continue
            if total > best and (low < high or len(self.of[s[low]]) > 1):
                best, pair = total, (s[low], s[high])
                if total == most:
                    break
            low += 1
        return pair


def best_two_fit(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Indexes of `sizes` (each from 1 to `capacity`) by container; every index is in exactly one."""
    pool, bins = Pool(sizes), []
    while pool.sizes:
        gap, own = capacity, []
        while (s := pool.largest(gap)) is not None:
            own.append((s, pool.take(s)))
            gap -= s
        while gap and len(own) > 1:
            small, index = own[-1]  # filled in falling order of size, so the last is the smallest
            pair = pool.best_two(gap + small, small)
            if pair is None:
                break
            own.pop()
            own += sorted(((s, pool.take(s)) for s in pair), reverse=True)
            own.sort(reverse=True)
            gap -= sum(pair) - small
            pool.put(small, index)
        bins.append([i for _, i in own])
    return bins


def pack(items: DataFrame, containers: list[tuple[str, int]], *, item: str, size: str, shard_items: int = SHARD_ITEMS, expected: int | None = None, most_tasks: int = 4096) -> DataFrame:
    """Every item in a container of every kind: `container_name`, `bin_id`, `item`, `piece_no`, `start`, `n_tokens`.

    `items` has one row per item; `item` identifies it (bigint) and `size` is its length. An item longer than the capacity
    is split, and only then: into pieces of exactly the capacity, each a container of its own, and a
    rest that is packed like other items; `start` is where a piece begins, `piece_no` counts from 1.
    Items of size 0 take no space and go into the shard's first container. Rows with a null id or size are left
    out. The result depends on the ids and sizes only, not on the layout of the table. `expected` is the number
    of items if known; it sets the number of shards. At most `most_tasks` tasks pack them, several shards one after another
    where there are more; that changes no result.
    """
    require(items, item, size)
    n = items.count() if expected is None else expected
    shards = max(1, -(-n // shard_items))
    rows = items.select(col(item).cast("long").alias("item"), col(size).cast("long").alias("size")).where("item is not null and size is not null")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    # A given number of partitions isn't coalesced: items are few bytes, but packing them takes time.
    rows = rows.repartition(min(shards, most_tasks), "shard")
    kinds = tuple(containers)

    def work(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["size", "item"], kind="stable")
        ids, sizes = g["item"].tolist(), g["size"].tolist()
        out: list[tuple] = []
        first = int(key[0]) << 40
        for name, capacity in kinds:
            b, rests, empty = first, [], []
            for i, n in zip(ids, sizes):
                whole, rest = divmod(n, capacity)
                for k in range(whole):
                    out.append((name, b, i, k + 1, k * capacity, capacity))
                    b += 1
                if rest:
                    rests.append((rest, i, whole))
                elif not n:
                    empty.append(i)
            rests.sort()
            for own in best_two_fit([r[0] for r in rests], capacity):
                for j in own:
                    rest, i, whole = rests[j]
                    out.append((name, b, i, whole + 1, whole * capacity, rest))
                b += 1
            out += [(name, first, i, 1, 0, 0) for i in empty]
        return pd.DataFrame(out, columns=["container_name", "bin_id", "item", "piece_no", "start", "n_tokens"])

    schema = "container_name string, bin_id long, item long, piece_no long, start long, n_tokens long"
    return rows.groupBy("shard").applyInPandas(work, schema)


def fill_report(packed: DataFrame, containers: DataFrame, name: str, capacity: str) -> DataFrame:
    """Per kind of container: how many, tokens in them, and the share of their space that is unused."""
    bins = packed.groupBy("container_name").agg(F.countDistinct("bin_id").alias("n_bins"), F.sum("n_tokens").alias("n_tokens"))
    c = containers.groupBy(col(name).alias("container_name")).agg(F.max(col(capacity)).alias("capacity_tokens"))
    return bins.join(c, "container_name").select("container_name", "capacity_tokens", "n_bins", "n_tokens", (1 - F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens"))).alias("unused_share"))
