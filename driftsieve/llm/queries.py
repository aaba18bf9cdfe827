"""The pN_ queries: each callable takes (spark, folder of the tables)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftsieve.llm.formats import copy_counts, format_copies
from driftsieve.llm.history import duplicates_of_history, release_by_release
from driftsieve.llm.leaks import leaked_items, paraphrased_items
from driftsieve.llm.mixing import Mixture
from driftsieve.llm.near import near_groups
from driftsieve.llm.seen import SeenIndex, error_rates, seen_before
from driftsieve.llm.subjects import Subjects
from driftsieve.llm.visual import same_looking_pairs
from driftsieve.storage import shared_folder


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _expected(spark, d) -> int:
    """The keys that the manifest lists: one number of a small, fixed table."""
    return int(_t(spark, d, "shards").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0])


def _p1_release_by_release(spark, d):
    path = f"{shared_folder(spark)}/history-{uuid.uuid4().hex[:12]}"
    return release_by_release(_t(spark, d, "input_parquet"), _t(spark, d, "ledger"), path)


def _p2_found(spark, d):
    return seen_before(_t(spark, d, "row_band_keys"), _t(spark, d, "index_keys"), _expected(spark, d))


def _p2_error_rates(spark, d):
    return error_rates(_t(spark, d, "row_band_keys"), _t(spark, d, "index_keys"), _expected(spark, d), bits=24)


def _p2_in_two_batches(spark, d):
    """The earlier half of the rows makes an index on disk, the later half is held against it."""
    rows = _t(spark, d, "row_band_keys")
    middle = rows.agg(F.percentile_approx("sig_id", 0.5, 10_000)).first()[0] or 0
    index = SeenIndex(spark, f"{shared_folder(spark)}/seen-index-{uuid.uuid4().hex[:12]}", _expected(spark, d))
    first = index.add(rows.where(F.col("sig_id") <= middle))
    return first.union(index.add(rows.where(F.col("sig_id") > middle)))


def _p6_found(spark, d):
    return leaked_items(_t(spark, d, "documents"), _t(spark, d, "benchmark")).select("doc_id", "item_id")


def _p6_paraphrases(spark, d):
    items = _t(spark, d, "benchmark")  # as generated it has no answers; they are checked where it has
    answer = "answer" if "answer" in items.columns else None
    return paraphrased_items(_t(spark, d, "documents"), items, answer_col=answer).select("doc_id", "item_id")


def _mixture(spark, d) -> Mixture:
    return Mixture(_t(spark, d, "documents"), _t(spark, d, "source_weights"))


def _subjects(spark, d) -> Subjects:
    return Subjects(_t(spark, d, "documents"), _t(spark, d, "subject_labels"), _t(spark, d, "subject_areas"))


def queries() -> dict:
    return {
        "p1_found": lambda s, d: duplicates_of_history(_t(s, d, "input_parquet"), _t(s, d, "ledger")),
        "p1_release_by_release": _p1_release_by_release,
        "p2_found": _p2_found,
        "p2_in_two_batches": _p2_in_two_batches,
        "p2_error_rates": _p2_error_rates,
        "p3_found": lambda s, d: near_groups(_t(s, d, "input_parquet")),
        "p4_found": lambda s, d: format_copies(_t(s, d, "input_parquet")),
        "p4_copy_counts": lambda s, d: copy_counts(_t(s, d, "input_parquet")),
        "p5_found": lambda s, d: same_looking_pairs(_t(s, d, "input_parquet")),
        "p6_found": _p6_found,
        "p6_paraphrases": _p6_paraphrases,
        "p7_found": lambda s, d: _mixture(s, d).short_sources(),
        "p7_mix": lambda s, d: _mixture(s, d).mix(),
        "p8_found": lambda s, d: _subjects(s, d).assign().select("doc_id", "subject"),
        "p7_shares": lambda s, d: _mixture(s, d).shares(),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
            WITH k AS (SELECT sig_id, unnest(band_keys) AS key, CAST(generate_subscripts(band_keys, 1) - 1 AS INTEGER) AS band FROM row_band_keys),
                 m AS (SELECT sig_id, band, key, min(sig_id) OVER (PARTITION BY band, key) AS earliest FROM k)
            SELECT sig_id, band FROM m
            WHERE sig_id > earliest OR EXISTS (SELECT 1 FROM index_keys i WHERE i.band = m.band AND i.band_key = m.key)""",
        "p2_in_two_batches": """
            WITH k AS (SELECT sig_id, unnest(band_keys) AS key, CAST(generate_subscripts(band_keys, 1) - 1 AS INTEGER) AS band FROM row_band_keys)
            SELECT sig_id, band FROM (SELECT sig_id, band, min(sig_id) OVER (PARTITION BY band, key) AS earliest FROM k) WHERE sig_id > earliest""",
        # Sizes in characters: which sources fall short is the same for any usual measure.
        "p7_found": r"""
            WITH w AS (SELECT lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS source, target_share, max_repeats FROM source_weights),
                 t AS (SELECT lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS source, sum(length(text)) AS n FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1)
            SELECT w.source FROM w LEFT JOIN t USING (source)
            WHERE target_share * (SELECT coalesce(sum(n), 0) FROM t SEMI JOIN w USING (source)) > max_repeats * coalesce(n, 0)""",
    }
