"""Visually identical text with different characters.

Script-aware repair: the dominant script is that of the letters which only one
alphabet has, and letters of other alphabets that look like its letters are
put back, together with widths, accents, invisible characters and spaces.
See textforms.plain_form.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftsieve.llm.arrow import chunks, hash128, named
from driftsieve.llm.textforms import canonical_batch, plain_batch
from driftsieve.storage import Workspace, spread

LEAST_LETTERS = 20


def plain_texts(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, plain, changed): each row's plain form, and whether it differs from the text.

    A null text gives the empty plain form and is not changed. Rows are neither dropped nor merged.
    """

    def run(batches):
        for b in chunks(batches, 1000):
            texts = b.column(1).to_pylist()
            plain = plain_batch(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(plain, pa.string()), pa.array([p != (t or "") for p, t in zip(plain, texts)])], names=["id", "plain", "changed"])

    kind = named(df, id=id_col).schema[0].dataType.simpleString()
    return named(df, id=id_col, text=text_col).mapInArrow(run, f"id {kind}, plain string, changed boolean")


def _forms(df: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    def run(batches):
        for b in chunks(batches, 1000):
            texts = b.column(1).to_pylist()
            plain = plain_batch(texts)
            letters = np.array([len(c) - c.count(" ") for c in canonical_batch(plain)])
            at = np.flatnonzero(letters >= least)
            hi, lo = hash128([plain[i] for i in at])
            t1, t2 = hash128([texts[i] for i in at])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *map(pa.array, (hi, lo, t1, t2))], names=["id", "p1", "p2", "t1", "t2"])

    source = spread(named(df, id=id_col, text=text_col).where("id is not null and text is not null").withColumn("id", F.col("id").cast("long")))
    return source.mapInArrow(run, "id long, p1 long, p2 long, t1 long, t2 long")


def same_looking_pairs(df: DataFrame, id_col: str = "id", text_col: str = "text", least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose texts differ but whose plain forms are equal.

    Null ids, null texts and texts with fewer than `least_letters` letters and digits are in no pair. A row that comes
    twice counts once. An empty table gives an empty result. Groups meet as classes of equal texts, so copies of one
    text never pair up among themselves; the joins' rows grow as the result does.
    """
    rows = Workspace(df.sparkSession, "visual").keep(_forms(df, id_col, text_col, least_letters), "forms")
    plain, text = ["p1", "p2"], ["t1", "t2"]
    # Groups with several texts; the aggregate combines before the shuffle, so a hot text costs nothing.
    mixed = rows.groupBy(*plain).agg(F.min(F.struct(*text)).alias("a"), F.max(F.struct(*text)).alias("b")).where("a <> b").select(*plain)
    rows = rows.join(mixed, plain, "left_semi")
    classes = rows.select(*plain, F.col("t1").alias("u1"), F.col("t2").alias("u2")).distinct()
    sought = rows.join(classes, plain).where("t1 <> u1 or t2 <> u2").select(F.col("id").alias("id_a"), *plain, "u1", "u2")
    members = rows.select(F.col("id").alias("id_b"), *plain, F.col("t1").alias("u1"), F.col("t2").alias("u2"))
    return sought.join(members, [*plain, "u1", "u2"]).where("id_a < id_b").select("id_a", "id_b").distinct()
