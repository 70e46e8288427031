"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimforge.functions.names import col, require

#: Vocabulary file, as ranks; it must be on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of 50k ranks part a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def lengths(documents: DataFrame, *, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """The `keep` columns and `n_tokens` of every row; 0 for a null or empty text. Whole texts, no shuffle."""
    require(documents, text, *keep)
    n = len(keep)
    source = documents.select(*[col(k) for k in keep], col(text).alias("__text"))
    schema = source.select(*[col(k) for k in keep]).schema.add("n_tokens", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(vocabulary).encode_ordinary
        for b in batches:
            sizes = pa.array([len(count(t)) if (t := x.as_py()) else 0 for x in b.column(n)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), sizes], names=[*keep, "n_tokens"])

    return source.mapInArrow(work, schema)


def with_capacity(containers: DataFrame, name: str, capacity: str, most: int = 1000) -> list[tuple[str, int]]:
    """Names and capacities on the driver; more than `most` kinds of containers is an error, not a cut."""
    rows = containers.where(col(name).isNotNull() & (col(capacity) > 0)).groupBy(col(name).alias("n")).agg(F.max(col(capacity)).alias("c")).orderBy("n").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} kinds of containers")
    return [(r[0], int(r[1])) for r in rows]
