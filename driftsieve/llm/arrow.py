"""Small helpers for Arrow batches in mapInArrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that one numpy pass takes, so that its arrays stay in the processor's cache.
CHUNK = 200


def hash128(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The two signed halves of a 128-bit hash of each text."""
    raw = b"".join(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts)
    both = np.frombuffer(raw, "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Only these columns, under these names, whatever else the table has and however it writes them."""
    return df.select(*(F.col(f"`{c}`").alias(n) for n, c in columns.items()))


def integer(c: Column) -> Column:
    return c.cast("long")


def partitions(df: DataFrame, least: int = 1) -> int:
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
