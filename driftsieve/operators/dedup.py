"""What is removed and what stays: within a release, against earlier ones, and what the index gains.

Tables here have one row per (row, band, key), with the row's position in columns named by `ids`; positions order rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _position(ids: list[str]):
    return F.struct(*ids)


def within_removals(banded: DataFrame, ids: list[str]) -> DataFrame:
    """(ids): rows that aren't the first of their (band, key) group in some band.

    Each band is judged over all rows, removed or not. Only a group's first position is needed, so hot keys are
    aggregated before the shuffle, and groups of one are dropped before rows meet them.
    """
    firsts = banded.groupBy("band", "key").agg(F.min(_position(ids)).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return banded.join(firsts, ["band", "key"]).where(_position(ids) != F.col("_first")).select(*ids).distinct()


def cross_removals(banded: DataFrame, within: DataFrame, history: DataFrame, ids: list[str]) -> DataFrame:
    """(ids): rows not removed within, any of whose keys the history (band, key) has in that band."""
    return banded.join(within, ids, "left_anti").join(history.select("band", "key"), ["band", "key"], "left_semi").select(*ids).distinct()


def removals(within: DataFrame, cross: DataFrame) -> DataFrame:
    """(ids, reason)."""
    return within.withColumn("reason", F.lit("within")).unionByName(cross.withColumn("reason", F.lit("cross")))


def survivors(rows: DataFrame, removed: DataFrame, ids: list[str]) -> DataFrame:
    return rows.join(removed.select(*ids), ids, "left_anti")


def keep_first_pairs(banded: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, band, kept ids as first_*): each row that isn't the first of a group, with the group's first."""
    firsts = banded.groupBy("band", "key").agg(F.min(_position(ids)).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    pairs = banded.join(firsts, ["band", "key"]).where(_position(ids) != F.col("_first"))
    return pairs.select(*ids, "band", *(F.col(f"_first.{c}").alias(f"first_{c}") for c in ids))


def collision_groups(banded: DataFrame) -> DataFrame:
    """(band, key, n): groups of two or more."""
    return banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")


def index_delta(banded: DataFrame) -> DataFrame:
    """(band, key): the distinct keys of every presented row, removed ones too."""
    return banded.select("band", "key").distinct()


def union_distinct(*runs: DataFrame) -> DataFrame:
    """The distinct rows of any number of runs; Spark sorts or hashes them with spill, so none needs to fit in memory."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.distinct()


def run_stats(keys: DataFrame, by: list[str]) -> DataFrame:
    """Count, least and greatest key of each run."""
    return keys.groupBy(*by).agg(F.count("*").alias("count"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def active_history(ledger: DataFrame) -> DataFrame:
    """(dataset, source): for each ingest of `ledger` (event_no, op, dataset), the other releases in the index at that time."""
    at = ledger.where("op = 'ingest'").select(F.col("event_no").alias("at"), "dataset")
    before = ledger.select("event_no", "op", F.col("dataset").alias("source"))
    last = at.join(before, F.col("event_no") < F.col("at")).groupBy("at", "dataset", "source").agg(F.max_by("op", "event_no").alias("last"))
    return last.where("last = 'ingest' and dataset <> source").select("dataset", "source").distinct()


def classify_releases(banded: DataFrame, ledger: DataFrame, base: DataFrame | None, ids: list[str], without: str | None = None) -> DataFrame:
    """(dataset, ids, reason): every release of banded (dataset, ids, band, key), as if ingested in the ledger's order.

    A release's result needs only the keys that earlier releases presented, not what was removed of them, so all
    releases are done at once. `base` (band, key) is in the index throughout; `without` leaves one release out.
    """
    if without is not None:
        banded, ledger = banded.where(F.col("dataset") != without), ledger.where(F.col("dataset") != without)
    banded = banded.join(ledger.where("op = 'ingest'").select("dataset").distinct(), "dataset", "left_semi")
    ids = ["dataset", *ids]
    firsts = banded.groupBy("dataset", "band", "key").agg(F.min(_position(ids)).alias("_first"))
    within = banded.join(firsts, ["dataset", "band", "key"]).where(_position(ids) != F.col("_first")).select(*ids).distinct()
    # keys of a release that some earlier one has: on distinct keys, not rows
    keys = firsts.select("dataset", "band", "key")
    theirs = keys.withColumnRenamed("dataset", "source")
    held = keys.join(active_history(ledger), "dataset").join(theirs, ["source", "band", "key"], "left_semi").select("dataset", "band", "key")
    if base is not None:
        held = held.unionByName(keys.join(base.select("band", "key"), ["band", "key"], "left_semi").select("dataset", "band", "key"))
    cross = banded.join(held.distinct(), ["dataset", "band", "key"], "left_semi").select(*ids).distinct().join(within, ids, "left_anti")
    return removals(within, cross)
