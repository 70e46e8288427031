"""Column naming helpers: internal columns never clash with the caller's."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def q(name: str) -> str:
    """`name` quoted, so that dots and odd characters are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def free(taken: Iterable[str], *wanted: str) -> list[str]:
    """`wanted` names, each prefixed with underscores until no column has it (letter case aside)."""
    have = {c.lower() for c in taken}
    out = []
    for w in wanted:
        while w.lower() in have:
            w = "_" + w
        have.add(w.lower())
        out.append(w)
    return out


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt out by `keys`, for plans that read it more than once; see :func:`all_columns`."""
    return df.repartition(*[col(k) for k in keys])


def all_columns(df: DataFrame) -> Column:
    """True for every row, but only known by reading all columns.

    Branches of a plan share an exchange if they ask the same of it. A branch that needs few columns is
    otherwise pruned below the exchange, becomes another plan, and all that is upstream runs once more.
    """
    parts = [F.coalesce(F.size(col(c)), F.lit(0)) if kind.startswith("map<") else col(c) for c, kind in df.dtypes]
    return F.xxhash64(*parts) >= F.lit(-(2**63))


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
