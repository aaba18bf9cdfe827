"""Releases from a stream of files: each micro-batch is a release of its own. An addition; the engine itself is batch."""

from __future__ import annotations

import shutil
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from driftsieve.plans.engine import Sieve


def ingest_stream(sieve: Sieve, rows: DataFrame, prefix: str, landing: str | Path, output_root: str | Path, checkpoint: str | Path, once: bool = True) -> StreamingQuery:
    """Writes each micro-batch to `landing` and ingests it as `prefix`-batch number.

    The number makes it idempotent: a batch that Spark delivers again after a failure is written again, and the engine
    knows a release that it has finished.
    """

    def each(batch: DataFrame, number: int) -> None:
        tag, place = f"{prefix}-{number:08d}", Path(landing).resolve() / f"{prefix}-{number:08d}.parquet"
        if sieve.meta(tag) is None:
            shutil.rmtree(place, ignore_errors=True)
            batch.write.parquet(str(place))
        sieve.ingest([str(place / "*.parquet")], tag, Path(output_root) / tag)

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", str(checkpoint))
    return (writer.trigger(availableNow=True) if once else writer).start()
