"""Queries of the engine's operators on the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftsieve.config import SieveConfig
from driftsieve.functions.shingles import normalized, sanitized, shingles
from driftsieve.functions.signatures import PRIME, band_keys, by_band, minhash, permutations
from driftsieve.operators import dedup
from driftsieve.storage import spread

CONFIG = SieveConfig()
LEFT_OUT = "crawl_alder"  # the release of the faithful withdrawal
TAG = "crawl_elm"  # the release whose contributors are listed


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _documents(spark, d) -> DataFrame:
    return spread(_t(spark, d, "documents").select("doc_id", "text"))


def _banded(spark, d) -> DataFrame:
    return by_band(_t(spark, d, "row_band_keys").select("dataset", "sig_id", F.col("band_keys").alias("keys")))


def _base(spark, d) -> DataFrame:
    return _t(spark, d, "index_keys").select("band", F.col("band_key").alias("key"))


def _removed(spark, d, without=None) -> DataFrame:
    return dedup.classify_releases(_banded(spark, d), _t(spark, d, "ledger"), _base(spark, d), ["sig_id"], without)


def _normalize_text(spark, d):
    return _documents(spark, d).select("doc_id", normalized(F.col("text")).alias("norm"))


def _shingle_counts(kind, size):
    def query(spark, d):
        s = shingles(F.col("text"), kind, size)
        return _documents(spark, d).select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.size(F.array_distinct("s")).cast("long").alias("n_distinct"))

    return query


def _minhash(spark, d):
    return minhash(_documents(spark, d), ["doc_id"], "text", CONFIG)


def _band_keys(spark, d):
    return by_band(band_keys(_documents(spark, d), ["doc_id"], "text", CONFIG)).select("doc_id", "band", "key")


def _survivors(spark, d):
    rows = _documents(spark, d)
    within = dedup.within_removals(by_band(band_keys(rows, ["doc_id"], "text", CONFIG)), ["doc_id"])
    return dedup.survivors(_t(spark, d, "documents"), within, ["doc_id"]).select("doc_id", "lang", "source", "n_chars")


def _ingest_report(spark, d):
    known = _t(spark, d, "ledger").where("op = 'ingest'").select("dataset").distinct()
    rows = _t(spark, d, "row_band_keys").join(known, "dataset", "left_semi").groupBy("dataset").agg(F.count("*").alias("n_input"))
    by = _removed(spark, d).groupBy("dataset").agg(F.count_if(F.col("reason") == "within").alias("n_within"), F.count_if(F.col("reason") == "cross").alias("n_cross"))
    out = rows.join(by, "dataset", "left").na.fill(0)
    return out.withColumn("n_output", F.col("n_input") - F.col("n_within") - F.col("n_cross"))


def _kept(spark, d, without=None):
    rows = _t(spark, d, "row_band_keys").select("dataset", "sig_id")
    if without:
        rows = rows.where(F.col("dataset") != without)
    return dedup.survivors(rows, _removed(spark, d, without), ["dataset", "sig_id"])


def _active(spark, d):
    last = _t(spark, d, "ledger").groupBy("dataset").agg(F.max_by("op", "event_no").alias("op"), F.max("event_no").alias("event_no"))
    return last.where("op = 'ingest'").select("dataset", F.col("event_no").cast("long").alias("event_no"))


def _after_withdrawals(spark, d):
    held = _banded(spark, d).join(_active(spark, d), "dataset", "left_semi")
    return dedup.union_distinct(held.select("band", "key"), _base(spark, d)).groupBy("band").agg(F.count("*").alias("n_keys"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def _contributors(spark, d):
    runs = _t(spark, d, "shards").where("dataset is null").groupBy("band").agg(
        F.max(F.col("source_datasets").isNull()).alias("unknown"),
        F.flatten(F.collect_list(F.when(F.array_contains("source_datasets", TAG), F.col("source_datasets")))).alias("all"),
    )
    others = F.array_join(F.array_sort(F.array_except(F.array_distinct("all"), F.array(F.lit(TAG)))), ",")
    return runs.select("band", F.when(~F.col("unknown"), others).alias("contributors"))


def _compaction_candidates(spark, d):
    w = Window.partitionBy("band", "lsm_level").orderBy("count", "shard_file")
    return _t(spark, d, "shards").withColumn("place", F.row_number().over(w)).where(F.col("place") <= CONFIG.tier_fanout).select("band", "lsm_level", "shard_file", "count")


def _probe_order(spark, d):
    w = Window.partitionBy("band").orderBy(F.desc("count"), "shard_file")
    return _t(spark, d, "shards").select("band", "shard_file", F.row_number().over(w).cast("long").alias("place"))


def _probes_scheduled(spark, d):
    rows = _t(spark, d, "row_band_keys").groupBy("dataset").agg(F.count("*").alias("n"))
    total = _t(spark, d, "shards").agg(F.count("*").alias("runs"))
    own = _t(spark, d, "shards").where("dataset is not null").groupBy("dataset").agg(F.count("*").alias("own"))
    return rows.join(F.broadcast(total)).join(own, "dataset", "left").select("dataset", (F.col("n") * (F.col("runs") - F.coalesce("own", F.lit(0)))).alias("probes_scheduled"))  # one row


def _file_offsets(spark, d):
    files = _t(spark, d, "input_parquet").groupBy("dataset", "source_file").agg(F.count("*").alias("n"))
    w = Window.partitionBy("dataset").orderBy("source_file")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.select("dataset", "source_file", F.dense_rank().over(w).cast("long").alias("file_rank"), before.alias("first_row"), "n")


def _path_ids(spark, d):
    return _t(spark, d, "paths").groupBy("uri", F.coalesce("digest", F.lit("")).alias("digest")).agg(F.min("id").alias("path_id"), F.max("size").alias("size"))


def _rewritten(spark, d):
    latest = Window.partitionBy("uri").orderBy(F.desc("id"))
    p = _t(spark, d, "paths")
    now = p.withColumn("k", F.row_number().over(latest)).where("k = 1").select("uri", F.col("digest").alias("now"))
    return p.join(now, "uri").where("digest is not null and now is not null and digest <> now").select("id", "uri", F.lit("digest_mismatch").alias("reason"))


def _removals_table(spark, d):
    rows = _t(spark, d, "row_band_keys").select("dataset", "sig_id", "source_file", "source_row")
    return rows.join(_removed(spark, d), ["dataset", "sig_id"]).select("sig_id", "source_file", "source_row", "reason")


def queries() -> dict:
    return {
        "normalize_text": _normalize_text,
        "char_shingles_count": _shingle_counts("char", 20),
        "word_shingles_count": _shingle_counts("word", 5),
        "minhash_signature": _minhash,
        "band_keys": _band_keys,
        "survivors": _survivors,
        "band_collision_groups": lambda s, d: dedup.collision_groups(_banded(s, d)),
        "within_removals": lambda s, d: _removed(s, d).where("reason = 'within'").select("dataset", "sig_id"),
        "cross_removals": lambda s, d: _removed(s, d).where("reason = 'cross'").select("dataset", "sig_id"),
        "classify": _removed,
        "keep_first_pairs": lambda s, d: dedup.keep_first_pairs(_banded(s, d).select("sig_id", "band", "key"), ["sig_id"]),
        "release_survivors": _kept,
        "ingest_report": _ingest_report,
        "removals_by_reason": lambda s, d: _removed(s, d).groupBy("reason").agg(F.count("*").alias("n")),
        "removals_table": _removals_table,
        "index_distinct_keys": lambda s, d: dedup.index_delta(_banded(s, d)),
        "index_union_keys": lambda s, d: dedup.union_distinct(_banded(s, d).select("band", "key"), _base(s, d)),
        "shard_stats": lambda s, d: dedup.run_stats(_banded(s, d).select("dataset", "band", "key").distinct(), ["dataset", "band"]),
        "band_stats": lambda s, d: _t(s, d, "shards").groupBy("band").agg(F.count("*").alias("n_shards"), F.sum("count").alias("total_keys")),
        "index_after_withdraw": _after_withdrawals,
        "provenance_contributors": _contributors,
        "compaction_topk": _compaction_candidates,
        "probe_order": _probe_order,
        "probes_scheduled": _probes_scheduled,
        "file_rank_offsets": _file_offsets,
        "faithful_withdraw_output": lambda s, d: _kept(s, d, LEFT_OUT),
        "active_datasets": _active,
        "active_history": lambda s, d: dedup.active_history(_t(s, d, "ledger")),
        "path_ids": _path_ids,
        "rewritten_paths": _rewritten,
        "sanitize_tags": lambda s, d: _t(s, d, "paths").select("id", sanitized(F.col("uri")).alias("tag")),
    }


# ------------------------------------------------------------------- SQL

_WHITE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NORM = f"trim(regexp_replace(replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), 'ς', 'σ'), '{_WHITE}', ' ', 'g'), ' ')"
_DOCS = f"docs AS (SELECT doc_id, {_NORM} AS t FROM documents)"
_CHARS = "CASE WHEN length(t) <= 20 THEN [t] ELSE list_transform(range(1, length(t) - 18), lambda i: substr(t, i, 20)) END"
_WORDS = "CASE WHEN len(w) <= 5 THEN [t] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END"
_BANDED = "banded AS (SELECT dataset, sig_id, CAST(generate_subscripts(band_keys, 1) - 1 AS INTEGER) AS band, unnest(band_keys) AS key FROM row_band_keys)"


def _minhash_sql() -> str:
    mins = ", ".join(f"min((x * {a} + {b}) % {PRIME}) AS m{i}" for i, (a, b) in enumerate(permutations(CONFIG.num_perm, CONFIG.seed)))
    return f"""{_DOCS}, one AS (SELECT doc_id, unnest({_CHARS}) AS s FROM docs),
        hashed AS (SELECT doc_id, CAST(('0x' || substr(md5(s), 1, 8)) AS BIGINT) % {PRIME} AS x FROM one),
        mins AS (SELECT doc_id, {mins} FROM hashed GROUP BY doc_id)"""


def _band_sql() -> str:
    r = CONFIG.rows_per_band
    each = " UNION ALL ".join(f"SELECT doc_id, {b} AS band, CAST(('0x' || substr(md5(concat_ws(',', {', '.join(f'm{i}' for i in range(b * r, b * r + r))})), 1, 15)) AS BIGINT) AS key FROM mins" for b in range(CONFIG.num_bands))
    return f"{_minhash_sql()}, keyed AS ({each})"


def _history_sql(ledger: str) -> str:
    return f"""state AS (SELECT i.event_no AS at, i.dataset, l.dataset AS source, arg_max(l.op, l.event_no) AS last
            FROM {ledger} i JOIN {ledger} l ON l.event_no < i.event_no WHERE i.op = 'ingest' GROUP BY ALL),
        history AS (SELECT DISTINCT dataset, source FROM state WHERE last = 'ingest' AND dataset <> source)"""


def _removed_sql(without: str | None = None) -> str:
    ledger = "ledger" if without is None else f"(SELECT * FROM ledger WHERE dataset <> '{without}')"
    rows = "" if without is None else f" AND dataset <> '{without}'"
    return f"""{_BANDED}, {_history_sql(ledger)},
        b AS (SELECT * FROM banded WHERE dataset IN (SELECT dataset FROM ledger WHERE op = 'ingest'){rows}),
        within AS (SELECT DISTINCT dataset, sig_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset, band, key ORDER BY sig_id) AS rn FROM b) WHERE rn > 1),
        hit AS (SELECT b.dataset, b.sig_id FROM b JOIN history h ON h.dataset = b.dataset JOIN (SELECT DISTINCT dataset, band, key FROM b) p ON p.dataset = h.source AND p.band = b.band AND p.key = b.key
            UNION ALL SELECT b.dataset, b.sig_id FROM b JOIN index_keys i ON i.band = b.band AND i.band_key = b.key),
        crossed AS (SELECT DISTINCT dataset, sig_id FROM hit ANTI JOIN within USING (dataset, sig_id)),
        removed AS (SELECT dataset, sig_id, 'within' AS reason FROM within UNION ALL SELECT dataset, sig_id, 'cross' FROM crossed)"""


def oracle_sql() -> dict[str, str]:
    removed = _removed_sql()
    active = "active AS (SELECT dataset, arg_max(op, event_no) AS op, CAST(max(event_no) AS BIGINT) AS event_no FROM ledger GROUP BY dataset HAVING arg_max(op, event_no) = 'ingest')"
    return {
        "normalize_text": f"WITH {_DOCS} SELECT doc_id, t AS norm FROM docs",
        "char_shingles_count": f"WITH {_DOCS}, s AS (SELECT doc_id, {_CHARS} AS s FROM docs) SELECT doc_id, len(s) AS n, len(list_distinct(s)) AS n_distinct FROM s",
        "word_shingles_count": f"WITH {_DOCS}, w AS (SELECT doc_id, t, string_split(t, ' ') AS w FROM docs), s AS (SELECT doc_id, {_WORDS} AS s FROM w) SELECT doc_id, len(s) AS n, len(list_distinct(s)) AS n_distinct FROM s",
        "minhash_signature": f"WITH {_minhash_sql()} SELECT * FROM mins",
        "band_keys": f"WITH {_band_sql()} SELECT doc_id, band, key FROM keyed",
        "survivors": f"""WITH {_band_sql()}, within AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY band, key ORDER BY doc_id) AS rn FROM keyed) WHERE rn > 1)
            SELECT doc_id, lang, source, n_chars FROM documents ANTI JOIN within USING (doc_id)""",
        "band_collision_groups": f"WITH {_BANDED} SELECT band, key, count(*) AS n FROM banded GROUP BY band, key HAVING count(*) > 1",
        "within_removals": f"WITH {removed} SELECT dataset, sig_id FROM within",
        "cross_removals": f"WITH {removed} SELECT dataset, sig_id FROM crossed",
        "classify": f"WITH {removed} SELECT dataset, sig_id, reason FROM removed",
        "keep_first_pairs": f"WITH {_BANDED} SELECT sig_id, band, first_sig_id FROM (SELECT sig_id, band, min(sig_id) OVER (PARTITION BY band, key) AS first_sig_id FROM banded) WHERE sig_id <> first_sig_id",
        "release_survivors": f"WITH {removed} SELECT dataset, sig_id FROM row_band_keys ANTI JOIN removed USING (dataset, sig_id)",
        "ingest_report": f"""WITH {removed}, n AS (SELECT dataset, count(*) AS n_input FROM row_band_keys WHERE dataset IN (SELECT dataset FROM ledger WHERE op = 'ingest') GROUP BY dataset),
            r AS (SELECT dataset, count(*) FILTER (reason = 'within') AS w, count(*) FILTER (reason = 'cross') AS c FROM removed GROUP BY dataset)
            SELECT dataset, n_input, coalesce(w, 0) AS n_within, coalesce(c, 0) AS n_cross, n_input - coalesce(w, 0) - coalesce(c, 0) AS n_output FROM n LEFT JOIN r USING (dataset)""",
        "removals_by_reason": f"WITH {removed} SELECT reason, count(*) AS n FROM removed GROUP BY reason",
        "removals_table": f"WITH {removed} SELECT sig_id, source_file, source_row, reason FROM row_band_keys JOIN removed USING (dataset, sig_id)",
        "index_distinct_keys": f"WITH {_BANDED} SELECT DISTINCT band, key FROM banded",
        "index_union_keys": f"WITH {_BANDED} SELECT band, key FROM banded UNION SELECT band, band_key FROM index_keys",
        "shard_stats": f"WITH {_BANDED} SELECT dataset, band, count(DISTINCT key) AS count, min(key) AS min_key, max(key) AS max_key FROM banded GROUP BY dataset, band",
        "band_stats": "SELECT band, count(*) AS n_shards, CAST(sum(count) AS BIGINT) AS total_keys FROM shards GROUP BY band",
        "index_after_withdraw": f"""WITH {_BANDED}, {active}, u AS (SELECT band, key FROM banded SEMI JOIN active USING (dataset) UNION SELECT band, band_key FROM index_keys)
            SELECT band, count(*) AS n_keys, min(key) AS min_key, max(key) AS max_key FROM u GROUP BY band""",
        "provenance_contributors": f"""WITH m AS (SELECT band, source_datasets FROM shards WHERE dataset IS NULL),
            names AS (SELECT DISTINCT band, s FROM (SELECT band, unnest(source_datasets) AS s FROM m WHERE list_contains(source_datasets, '{TAG}')) WHERE s <> '{TAG}'),
            joined AS (SELECT band, string_agg(s, ',' ORDER BY s) AS names FROM names GROUP BY band)
            SELECT b.band, CASE WHEN NOT b.unknown THEN coalesce(names, '') END AS contributors FROM (SELECT band, bool_or(source_datasets IS NULL) AS unknown FROM m GROUP BY band) b LEFT JOIN joined USING (band)""",
        "compaction_topk": f"SELECT band, lsm_level, shard_file, count FROM shards QUALIFY row_number() OVER (PARTITION BY band, lsm_level ORDER BY count, shard_file) <= {CONFIG.tier_fanout}",
        "probe_order": "SELECT band, shard_file, row_number() OVER (PARTITION BY band ORDER BY count DESC, shard_file) AS place FROM shards",
        "probes_scheduled": """WITH n AS (SELECT dataset, count(*) AS n FROM row_band_keys GROUP BY dataset), own AS (SELECT dataset, count(*) AS own FROM shards WHERE dataset IS NOT NULL GROUP BY dataset)
            SELECT n.dataset, n * ((SELECT count(*) FROM shards) - coalesce(own, 0)) AS probes_scheduled FROM n LEFT JOIN own USING (dataset)""",
        "file_rank_offsets": """SELECT dataset, source_file, dense_rank() OVER w AS file_rank, CAST(coalesce(sum(n) OVER (PARTITION BY dataset ORDER BY source_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_row, n
            FROM (SELECT dataset, source_file, count(*) AS n FROM input_parquet GROUP BY ALL) WINDOW w AS (PARTITION BY dataset ORDER BY source_file)""",
        "faithful_withdraw_output": f"WITH {_removed_sql(LEFT_OUT)} SELECT dataset, sig_id FROM row_band_keys ANTI JOIN removed USING (dataset, sig_id) WHERE dataset <> '{LEFT_OUT}'",
        "active_datasets": f"WITH {active} SELECT dataset, event_no FROM active",
        "active_history": f"WITH {_history_sql('ledger')} SELECT dataset, source FROM history",
        "path_ids": "SELECT uri, coalesce(digest, '') AS digest, min(id) AS path_id, max(size) AS size FROM paths GROUP BY uri, coalesce(digest, '')",
        "rewritten_paths": "WITH n AS (SELECT uri, digest AS now FROM paths QUALIFY row_number() OVER (PARTITION BY uri ORDER BY id DESC) = 1) SELECT id, uri, 'digest_mismatch' AS reason FROM paths JOIN n USING (uri) WHERE digest <> now",
        "sanitize_tags": "SELECT id, CASE WHEN t = '' THEN 'shard' ELSE t END AS tag FROM (SELECT id, regexp_replace(trim(uri), '[^A-Za-z0-9_.=-]', '_', 'g') AS t FROM paths)",
    }
