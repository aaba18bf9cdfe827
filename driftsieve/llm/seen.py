"""Has this key been seen before? Elias-Fano encoding of sorted hash partitions.

Keys of a band are spread over hash partitions by a bijection on 64 bits. A partition takes its keys in order of
arrival, batch by batch: each batch is sorted, probed against the encoding by successor search, and merged into it.
The encoding is exact for whole 64-bit keys; with fewer bits it is smaller and sometimes wrong, and error_rates
measures how often.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftsieve.llm.arrow import partitions
from driftsieve.llm.elias_fano import EliasFano, mix64
from driftsieve.storage import Workspace, delete

#: Keys that a hash partition is meant for, and probes that are merged at a time.
PARTITION_KEYS, BATCH_KEYS = 1 << 20, 1 << 17
#: Rows of which the first stage drops repeats at a time.
STAGE_ROWS = 1 << 16

_MOVED = "pid int, band int, key long, seq long, kind int"
_OLD, _PROBE, _REPEAT = 0, 1, 2


def _parts(expected: int, bands: int) -> int:
    """Hash partitions for each band, a power of two."""
    return 1 << max(0, math.ceil(math.log2(max(1, expected / max(1, bands) / PARTITION_KEYS))))


def _spread(parts: int, bands: int, at_least: int) -> int:
    while parts * bands < at_least:
        parts *= 2
    return parts


def _flatten(parts: int):
    """Rows (seq, keys) to one row per key. Of a key that comes several times, all but the earliest are repeats of it
    whatever else there is; they are sent on spread out, without the key, so a hot key reaches its partition once a stage."""
    shift = np.uint64(64 - int(math.log2(parts)))

    def flush(held):
        seq = np.concatenate([h[0] for h in held])
        band = np.concatenate([h[1] for h in held])
        key = np.concatenate([h[2] for h in held])
        mixed = mix64(key.view(np.uint64))
        pid = band * parts + ((mixed >> shift).astype(np.int32) if parts > 1 else 0)
        order = np.lexsort((seq, mixed, band))
        seq, band, mixed, pid = seq[order], band[order], mixed[order], pid[order]
        again = np.zeros(len(seq), bool)
        again[1:] = (mixed[1:] == mixed[:-1]) & (band[1:] == band[:-1])
        pid = np.where(again, (seq * 31 + band) % (1 << 20), pid).astype(np.int32)
        kind = np.where(again, _REPEAT, _PROBE).astype(np.int32)
        mixed = np.where(again, np.uint64(0), mixed)
        return pa.RecordBatch.from_arrays([pa.array(pid), pa.array(band.astype(np.int32)), pa.array(mixed.view(np.int64)), pa.array(seq), pa.array(kind)], names=["pid", "band", "key", "seq", "kind"])

    def run(batches):
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            values = lists.flatten()
            ok = ~np.asarray(values.is_null())
            seq = np.repeat(b.column(0).to_numpy(), lengths)
            band = np.arange(len(seq)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            held.append((seq[ok], band[ok], values.fill_null(0).to_numpy()[ok]))
            rows += b.num_rows
            if rows >= STAGE_ROWS:
                yield flush(held)
                held, rows = [], 0
        if held:
            yield flush(held)

    return run


def _old(parts: int):
    shift = np.uint64(64 - int(math.log2(parts)))

    def run(batches):
        for b in batches:
            band, mixed = b.column(0).to_numpy(), mix64(b.column(1).to_numpy().view(np.uint64))
            pid = band * parts + ((mixed >> shift).astype(np.int32) if parts > 1 else 0)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(pid.astype(np.int32)), pa.array(band.astype(np.int32)), pa.array(mixed.view(np.int64)), pa.array(np.full(n, -(1 << 63))), pa.array(np.full(n, _OLD, np.int32))], names=["pid", "band", "key", "seq", "kind"])

    return run


def _probe(parts: int, bits: int | None):
    """Sorted by arrival, a partition's keys; gives (seq, band) of those seen before, or with bits the error counts."""
    below = 64 - int(math.log2(parts))  # a partition's keys agree in the bits above

    def run(batches):
        exact: dict[int, EliasFano] = {}
        short: dict[int, EliasFano] = {}
        counts: dict[int, np.ndarray] = {}
        held: list = []

        def flush():
            band, key, seq, kind = (np.concatenate([h[k] for h in held]) for k in range(4))
            held.clear()
            seen_seq, seen_band = [seq[kind == _REPEAT]], [band[kind == _REPEAT]]
            for one in np.unique(band[kind != _REPEAT]).tolist():
                at = np.flatnonzero((band == one) & (kind != _REPEAT))
                rest = key[at].view(np.uint64) & np.uint64((1 << below) - 1)
                order = np.lexsort((seq[at], rest))
                at, rest = at[order], rest[order]
                before = exact.get(one) or EliasFano(np.empty(0, np.uint64), below)
                known = before.contains(rest)
                again = np.zeros(len(at), bool)
                again[1:] = rest[1:] == rest[:-1]
                probes = kind[at] == _PROBE
                hits = probes & (known | again)
                exact[one] = before.merged(rest[~known & ~again])
                if bits is not None:
                    cut = rest >> np.uint64(max(0, below - bits))
                    old = short.get(one) or EliasFano(np.empty(0, np.uint64), min(bits, below))
                    said = old.contains(cut)
                    twice = np.zeros(len(at), bool)
                    twice[1:] = cut[1:] == cut[:-1]
                    wrong = probes & (said | twice) & ~(known | again)
                    short[one] = old.merged(cut[~said & ~twice])
                    counts[one] = counts.get(one, np.zeros(3, np.int64)) + [probes.sum(), (probes & ~hits).sum(), wrong.sum()]
                else:
                    seen_seq.append(seq[at][hits])
                    seen_band.append(band[at][hits])
            return np.concatenate(seen_seq), np.concatenate(seen_band)

        def batch(result):
            return pa.RecordBatch.from_arrays([pa.array(result[0]), pa.array(result[1])], names=["sig_id", "band"])

        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(tuple(b.column(k).to_numpy() for k in range(4)))
            size += b.num_rows
            if size >= BATCH_KEYS:
                result, size = flush(), 0
                if bits is None:
                    yield batch(result)
        if held:
            result = flush()
            if bits is None:
                yield batch(result)
        if bits is not None:
            for one, (probes, new, wrong) in counts.items():
                yield pa.RecordBatch.from_pydict({"band": pa.array([one], pa.int32()), "probes": [int(probes)], "new_keys": [int(new)], "wrong": [int(wrong)], "keys": [exact[one].n], "encoded_bits": [short[one].size_bits()], "exact_bits": [exact[one].size_bits()]})

    return run


def _moved(rows: DataFrame, index: DataFrame | None, expected: int, bands: int) -> tuple[DataFrame, int]:
    parts = _spread(_parts(expected, bands), bands, partitions(rows))
    moved = rows.where("seq is not null and keys is not null").mapInArrow(_flatten(parts), _MOVED)
    if index is not None:
        moved = moved.unionByName(index.where("band is not null and key is not null").mapInArrow(_old(parts), _MOVED))
    n = parts * bands
    return moved.repartitionById(n, F.col("pid") % n).sortWithinPartitions("kind", "seq").select("band", "key", "seq", "kind"), parts


def rows_of(df: DataFrame, id_col: str, keys_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").cast("long").alias("seq"), F.col(f"`{keys_col}`").cast("array<long>").alias("keys"))


def index_of(df: DataFrame, band_col: str, key_col: str) -> DataFrame:
    return df.select(F.col(f"`{band_col}`").cast("int").alias("band"), F.col(f"`{key_col}`").cast("long").alias("key"))


def seen_before(df: DataFrame, index: DataFrame | None, expected: int, bands: int = 8, id_col: str = "sig_id", keys_col: str = "band_keys", band_col: str = "band", key_col: str = "band_key") -> DataFrame:
    """(sig_id, band): the keys of `df`, by position, that the index has in that band or an earlier row at that position.

    Rows are in order of `id_col`. `expected` keys size the partitions; a wrong guess costs time or memory, not
    answers. Null arrays, null elements and null ids hold no key; an index row with a null is ignored; elements beyond
    `bands` are refused. Of rows with the same id at the same key, the first that a task meets counts as the earlier.
    """
    moved, parts = _moved(rows_of(df, id_col, keys_col).withColumn("keys", _no_more(F.col("keys"), bands)), index_of(index, band_col, key_col) if index is not None else None, expected, bands)
    return moved.mapInArrow(_probe(parts, None), "sig_id long, band int")


def _no_more(keys: Column, bands: int) -> Column:
    return F.when(F.size(keys) <= bands, keys).when(keys.isNotNull(), F.raise_error(F.lit(f"more than {bands} keys in a row")).cast("array<long>"))


def error_rates(df: DataFrame, index: DataFrame | None, expected: int, bits: int, bands: int = 8, id_col: str = "sig_id", keys_col: str = "band_keys", band_col: str = "band", key_col: str = "band_key") -> DataFrame:
    """(band, probes, new_keys, wrong, rate, keys, bits_a_key, exact_bits_a_key): how often an encoding of `bits` bits of
    each partition's keys says seen of a key that isn't, counted against the exact one over all probes that reach a partition."""
    moved, parts = _moved(rows_of(df, id_col, keys_col).withColumn("keys", _no_more(F.col("keys"), bands)), index_of(index, band_col, key_col) if index is not None else None, expected, bands)
    each = moved.mapInArrow(_probe(parts, bits), "band int, probes long, new_keys long, wrong long, keys long, encoded_bits long, exact_bits long")
    total = each.groupBy("band").agg(*(F.sum(c).alias(c) for c in ("probes", "new_keys", "wrong", "keys", "encoded_bits", "exact_bits")))
    return total.select("band", "probes", "new_keys", "wrong", (F.col("wrong") / F.greatest("new_keys", F.lit(1))).alias("rate"), "keys", (F.col("encoded_bits") / F.greatest("keys", F.lit(1))).alias("bits_a_key"), (F.col("exact_bits") / F.greatest("keys", F.lit(1))).alias("exact_bits_a_key"))


# ---------------------------------------------------------------- kept index

_STATE = -1


def _advance(parts: int):
    """Of a partition's encoding, if there is one, and a batch's keys, sorted by arrival: (seq, band) of keys seen before,
    and last the encoding with the new keys."""
    below = 64 - int(math.log2(parts))

    def run(batches):
        held, known, band, place = [], None, None, None

        def flush():
            nonlocal known
            key, seq, kind = (np.concatenate([h[k] for h in held]) for k in range(3))
            held.clear()
            at = np.flatnonzero(kind != _REPEAT)
            rest = key[at].view(np.uint64) & np.uint64((1 << below) - 1)
            order = np.lexsort((seq[at], rest))
            at, rest = at[order], rest[order]
            old = known or EliasFano(np.empty(0, np.uint64), below)
            there, again = old.contains(rest), np.r_[False, rest[1:] == rest[:-1]][: len(rest)]
            known = old.merged(rest[~there & ~again])
            return seq[at][(kind[at] == _PROBE) & (there | again)]

        def out(seq, band, place=None, data=None):
            n = len(seq)
            return pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(band, pa.int32()), pa.array([place] * n, pa.int32()), pa.array([data] * n, pa.binary())], names=["sig_id", "band", "place", "data"])

        size = 0
        for b in batches:
            pid, bands, key, seq, kind = (b.column(k).to_numpy() for k in range(5))
            for i in np.flatnonzero(kind == _STATE):
                known, band, place = EliasFano.from_bytes(b.column(5)[int(i)].as_py()), int(bands[i]), int(pid[i])
            again = kind == _REPEAT
            if again.any():
                yield out(seq[again], bands[again])
            own = (kind == _OLD) | (kind == _PROBE)
            if own.any():
                band, place = int(bands[own][0]), int(pid[own][0])
                held.append((key[own], seq[own], kind[own]))
                size += int(own.sum())
            if size >= BATCH_KEYS:
                found, size = flush(), 0
                yield out(found, np.full(len(found), band, np.int32))
        if held:
            found = flush()
            yield out(found, np.full(len(found), band, np.int32))
        if known is not None:
            yield out([None], [band], place, known.to_bytes())

    return run


class SeenIndex:
    """An index of keys on disk: the Elias-Fano encoding of each hash partition, and no keys beside it.

    A batch's keys meet the encoding of their partition, which is read, probed, merged with the new keys and written as the next
    version; earlier keys are never read again. A version counts once it is whole, so an add that was cut off is done
    again from the one before; the one before that is deleted. `expected` keys fix the number of partitions for good.
    """

    def __init__(self, spark: SparkSession, path: str, expected: int = 0, bands: int = 8):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._file = lambda name: hadoop.Path(f"{self.path}/{name}")
        self._fs = self._file("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not self._fs.exists(self._file("layout/_SUCCESS")):
            spark.createDataFrame([(_spread(_parts(expected, bands), bands, 1), bands)], "parts int, bands int").write.mode("overwrite").parquet(f"{self.path}/layout")
        self.parts, self.bands = spark.read.parquet(f"{self.path}/layout").first()

    def version(self) -> int:
        """The last whole version, 0 if there is none."""
        if not self._fs.exists(self._file("")):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._file(""))]
        return max((int(n[2:]) for n in names if n.startswith("v-") and self._fs.exists(self._file(f"{n}/_SUCCESS"))), default=0)

    def add(self, df: DataFrame, id_col: str = "sig_id", keys_col: str = "band_keys") -> DataFrame:
        """(sig_id, band): the keys of a batch that an earlier batch had in that band, or an earlier row of its own at that
        position; then the batch is in the index. Nulls, ids and repeats are as in seen_before."""
        now, n = self.version(), self.parts * self.bands
        work = Workspace(self.spark, "seen")
        rows = rows_of(df, id_col, keys_col).withColumn("keys", _no_more(F.col("keys"), self.bands))
        moved = rows.where("seq is not null and keys is not null").mapInArrow(_flatten(self.parts), _MOVED).withColumn("data", F.lit(None).cast("binary"))
        if now:
            state = self.spark.read.parquet(f"{self.path}/v-{now:08d}")
            moved = moved.unionByName(state.select(F.col("place").alias("pid"), "band", F.lit(0).cast("long").alias("key"), F.lit(-(1 << 63)).cast("long").alias("seq"), F.lit(_STATE).alias("kind"), "data"))
        moved = moved.repartitionById(n, F.col("pid") % n).sortWithinPartitions("kind", "seq").select("pid", "band", "key", "seq", "kind", "data")
        got = work.keep(moved.mapInArrow(_advance(self.parts), "sig_id long, band int, place int, data binary"), "advanced")
        got.where("data is not null").select("place", "band", "data").write.mode("overwrite").parquet(f"{self.path}/v-{now + 1:08d}")
        if now > 1:
            delete(self.spark, f"{self.path}/v-{now - 1:08d}")
        return got.where("data is null").select("sig_id", "band")
