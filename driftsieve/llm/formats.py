"""Duplicates hidden by formatting differences.

Canonical records are range-partitioned by (key, id) and sorted by Spark's
external sort; adjacent runs are then scanned comparing full keys. As the id
is part of the range, a hot key spreads over several partitions; a run that
crosses partitions is settled by the heads of the partitions' first and last
runs, at most two per partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftsieve.llm.arrow import chunks, hash128, named, partitions
from driftsieve.llm.textforms import canonical_batch, plain_batch, record_key
from driftsieve.storage import Workspace, spread

LEAST_LETTERS = 20


def copy_keys(plain: list[str], canonical: list[str]) -> list[str]:
    """Keys that are equal for copies: a field record's sorted fields, else the letters and digits in order."""
    return [record_key(p) or c.replace(" ", "") for p, c in zip(plain, canonical)]


def _keys(df: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    def run(batches):
        for b in chunks(batches, 1000):
            plain = plain_batch(b.column(1).to_pylist())
            canon = canonical_batch(plain)
            at = [i for i, c in enumerate(canon) if len(c) - c.count(" ") >= least]
            keys = copy_keys([plain[i] for i in at], [canon[i] for i in at])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.string())], names=["id", "key"])

    source = spread(named(df, id=id_col, text=text_col).where("id is not null and text is not null").withColumn("id", F.col("id").cast("long")))
    return source.mapInArrow(run, "id long, key string")


_SCAN = "kind int, k1 long, k2 long, head long, id long"


def _scan(batches):
    """Rows of kind 0: (head, id) of a run that began in this partition. Kind 1: all rows of the partition's first run,
    which may have begun before. Kind 2: the head of its last run, which may go on."""
    key = head = last_id = None
    first_run, first_key = True, None
    none = np.empty(0, np.int64)
    for b in batches:
        ids, keys = b.column(0).to_numpy(), b.column(1)
        n = len(ids)
        if not n:
            continue
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = ~pc.equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        goes_on = key is not None and keys[0].as_py() == key
        if key is None:
            first_key = keys[0].as_py()
        new[0] = not goes_on
        at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        heads = np.where(at >= 0, ids[np.maximum(at, 0)], head if head is not None else 0)
        repeated = np.zeros(n, bool)
        repeated[1:] = (ids[1:] == ids[:-1]) & ~new[1:]
        repeated[0] = goes_on and ids[0] == last_id
        starts = np.flatnonzero(new)
        if first_run:
            end = n if key is None and len(starts) == 1 or key is not None and not len(starts) else int(starts[1 if key is None else 0])
            first = np.zeros(n, bool)
            first[:end] = True
            first_run = end == n
        else:
            first = np.zeros(n, bool)
        take = ~repeated & (first | (heads != ids))
        kinds = first[take].astype(np.int32)
        k1, k2 = hash128([first_key]) if kinds.any() else (np.zeros(1, np.int64), np.zeros(1, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.where(kinds, k1[0], 0)), pa.array(np.where(kinds, k2[0], 0)), pa.array(heads[take]), pa.array(ids[take])], names=["kind", "k1", "k2", "head", "id"])
        key, head, last_id = keys[n - 1].as_py(), int(heads[-1]), int(ids[-1])
    if key is not None:
        k1, k2 = hash128([key])
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array(k1), pa.array(k2), pa.array([head], pa.int64()), pa.array([head], pa.int64())], names=["kind", "k1", "k2", "head", "id"])
    else:
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int32()), *[pa.array(none)] * 4], names=["kind", "k1", "k2", "head", "id"])


def format_copies(df: DataFrame, id_col: str = "id", text_col: str = "text", least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(first_id, id): each row that is a copy of an earlier one but for format, with its group's least id.

    Null ids and texts, and texts with fewer than `least_letters` letters and digits, are in no group. A row that comes
    twice counts once. An empty table gives an empty result.
    """
    spark = df.sparkSession
    work = Workspace(spark, "formats")
    # Kept, as the sampling for the ranges would else make all keys a second time.
    keys = work.keep(_keys(df, id_col, text_col, least_letters), "keys")
    n = partitions(keys)
    runs = work.keep(keys.repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id").mapInArrow(_scan, _SCAN), "runs")
    edges = runs.where("kind > 0").groupBy("k1", "k2").agg(F.min("head").alias("true_head"))  # at most two a partition
    first = runs.where("kind = 1").join(F.broadcast(edges), ["k1", "k2"]).select(F.col("true_head").alias("first_id"), "id")
    return first.where("first_id <> id").unionByName(runs.where("kind = 0").select(F.col("head").alias("first_id"), "id"))


def copy_counts(df: DataFrame, id_col: str = "id", text_col: str = "text", least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(first_id, copies): each group of two or more, its representative and the exact number of its rows."""
    return format_copies(df, id_col, text_col, least_letters).groupBy("first_id").agg((F.count("*") + 1).alias("copies"))
