"""The engine: releases in, survivors out, a key index between, and withdrawal of a release.

A state folder on a file system that the driver and all executors share holds settings, ledger, paths, manifest, keys, removals and
outputs' places. An ingest writes keys, then outputs and removals, then the release's record, and the ledger's event
last; only the ledger says which releases count, so what an interrupted ingest left is overwritten by the next try and
seen by nobody in between.
"""

from __future__ import annotations

import dataclasses
import logging
import os
import shutil
import time
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftsieve.config import SieveConfig, read_json, write_json
from driftsieve.functions.signatures import band_keys, by_band
from driftsieve.operators import dedup
from driftsieve.operators.index import KeyIndex, folder_name
from driftsieve.sources import releases as src
from driftsieve.storage import Workspace, spread

log = logging.getLogger("driftsieve")
PLACE = ["file_rank", "row_index"]
#: Removed places that are sent to all executors, about 100 MB; see Sieve._write_outputs.
MOST_SENT = 2_000_000


@dataclass
class IngestReport:
    dataset: str
    n_input: int
    n_within_removed: int
    n_cross_removed: int
    n_output: int
    output_files: list[str]
    #: Runs that a screening of each row's keys would look through, and those done: a join looks at each key once.
    probes_done: int
    probes_scheduled: int
    elapsed_s: float
    replayed: bool = False


@dataclass
class WithdrawReport:
    dataset: str
    bands_o1: int
    bands_rebuilt: int
    outputs_retained: list[str]
    outputs_purged: bool
    elapsed_s: float


@dataclass
class _Phase:
    name: str
    began: float = field(default_factory=time.monotonic)

    def done(self, **facts) -> None:
        log.info("%s: %.1f s %s", self.name, time.monotonic() - self.began, " ".join(f"{k}={v}" for k, v in facts.items()))


class Sieve:
    """ingest, withdraw, datasets, stats. Without settings, those of the state folder are taken."""

    def __init__(self, spark: SparkSession, state_dir: str | Path, config: SieveConfig | None = None):
        self.spark, self.state = spark, Path(state_dir).resolve()
        if config is None:
            config = SieveConfig.load(self.state) if SieveConfig.file(self.state).exists() else SieveConfig()
        self.config = config
        self.index = KeyIndex(spark, self.state, config.num_bands, config.tier_fanout)
        self.paths = src.PathTable(self.state, spark)

    # ------------------------------------------------------------ ledger

    @property
    def _ledger_file(self) -> Path:
        return self.state / "ledger.json"

    def ledger(self) -> list[dict]:
        return read_json(self._ledger_file, [])

    def _record(self, event: dict) -> None:
        write_json(self._ledger_file, [*self.ledger(), {"event_no": len(self.ledger()) + 1, "utc": datetime.now(timezone.utc).isoformat(), **event}])

    def datasets(self) -> list[str]:
        """Releases in the index, in the order of their last ingest."""
        out: dict[str, None] = {}
        for e in self.ledger():
            out.pop(e["dataset"], None)
            if e["op"] == "ingest":
                out[e["dataset"]] = None
        return list(out)

    def ledger_table(self) -> DataFrame:
        return self.spark.createDataFrame([(e["event_no"], e["op"], e["dataset"]) for e in self.ledger()], "event_no int, op string, dataset string")

    def _meta_file(self, tag: str) -> Path:
        return self.state / "datasets" / folder_name(tag) / "meta.json"

    def meta(self, tag: str) -> dict | None:
        return read_json(self._meta_file(tag), {}) or None if tag in self.datasets() else None

    def removals_path(self, tag: str) -> Path:
        return self.state / "removals" / folder_name(tag)

    def removals(self, tag: str) -> DataFrame:
        """(file_id or source_file, source_row, reason)."""
        return self.spark.read.parquet(str(self.removals_path(tag)))

    def row_keys_path(self, tag: str) -> Path:
        return self.state / "datasets" / folder_name(tag) / "row_keys"

    # ------------------------------------------------------------ ingest

    def ingest(self, inputs, dataset: str, output_dir: str | Path, text_column: str | None = None) -> IngestReport:
        """Removes a release's rows that are like earlier ones and writes the rest, file by file.

        A release that was ingested is not done again: its recorded counts come back and its inputs aren't looked at.
        No input files make an empty release. A file without the text column is refused before anything is written.
        """
        self.config.validate_against(self.state)
        if not dataset or not dataset.strip():
            raise ValueError("a release needs a name")
        known = self.meta(dataset)
        if known is not None:
            return self._replayed(known)
        if not SieveConfig.file(self.state).exists():
            self.config.save(self.state)
        return self._ingest(src.resolve(inputs), dataset, Path(output_dir).resolve(), text_column or self.config.text_column)

    def _replayed(self, meta: dict) -> IngestReport:
        began = time.monotonic()
        by = {r["reason"]: r["n"] for r in self.removals(meta["dataset"]).groupBy("reason").agg(F.count("*").alias("n")).collect()}
        within, cross = by.get("within", 0), by.get("cross", 0)
        return IngestReport(meta["dataset"], meta["n_docs"], within, cross, meta["n_docs"] - within - cross, meta["output_files"], 0, 0, time.monotonic() - began, True)

    def _rows(self, files: list[Path], column: str) -> DataFrame | None:
        out = None
        for group in src.grouped_by_schema(files, column):
            df = src.read_rows(self.spark, group, files, [column]).select(F.col(f"`{column}`").cast("string").alias("text"), *PLACE)
            out = df if out is None else out.unionByName(df)
        return out

    def _ingest(self, files: list[Path], dataset: str, output_dir: Path, column: str, row_keys: Path | None = None) -> IngestReport:
        with Workspace(self.spark, "ingest") as work:
            return self._ingested(work, files, dataset, output_dir, column, row_keys)

    def _ingested(self, work: Workspace, files: list[Path], dataset: str, output_dir: Path, column: str, row_keys: Path | None) -> IngestReport:
        began, config = time.monotonic(), self.config
        active = [t for t in self.datasets() if t != dataset]
        groups = src.grouped_by_schema(files, column)
        phase = _Phase("paths")
        ids = self.paths.intern(files) if config.record_replay_manifest else [None] * len(files)
        phase.done(files=len(files))

        phase = _Phase("signatures")
        if row_keys is not None:
            keyed = self.spark.read.parquet(str(row_keys))
        elif files:
            keyed = work.keep(band_keys(spread(self._rows(files, column)), PLACE, "text", config), "keys")
        else:
            keyed = self.spark.createDataFrame([], "file_rank int, row_index long, keys array<long>")
        n_input = keyed.count()
        phase.done(rows=n_input)
        banded = by_band(keyed)

        phase = _Phase("removals")
        within = work.keep(dedup.within_removals(banded, PLACE), "within")
        scheduled = (n_input) * sum(len(self.index.probe_sequence(b, config.probe_order, dataset)) for b in range(config.num_bands))
        cross = dedup.cross_removals(banded, within, self.index.keys(active), PLACE) if active else within.limit(0)
        removed = work.keep(dedup.removals(within, cross), "removed")
        by = {r["reason"]: r["n"] for r in removed.groupBy("reason").agg(F.count("*").alias("n")).collect()}
        phase.done(**by)

        phase = _Phase("index")
        counts = self.index.append(banded, dataset, n_input)
        if config.record_row_signatures:
            keyed.write.mode("overwrite").parquet(str(self.row_keys_path(dataset)))
        phase.done(keys=sum(counts.values()))

        phase = _Phase("outputs")
        outputs = self._write_outputs(groups, files, removed, sum(by.values()), output_dir)
        self._write_removals(removed, files, ids, dataset)
        phase.done(files=len(outputs))

        self.index.record(dataset, counts)
        merges = self.index.compact(protect=dataset)
        meta = {"dataset": dataset, "n_docs": n_input, "output_dir": str(output_dir), "output_files": outputs, "signature_source": "row_keys" if row_keys else "text", "merges": merges}
        write_json(self._meta_file(dataset), meta)
        event = {"op": "ingest", "dataset": dataset, "n_docs": n_input, "output_dir": str(output_dir), "column": column}
        self._record(event | ({"inputs": ids} if config.record_replay_manifest else {}))
        n_within, n_cross = by.get("within", 0), by.get("cross", 0)
        return IngestReport(dataset, n_input, n_within, n_cross, n_input - n_within - n_cross, outputs, scheduled, scheduled, time.monotonic() - began)

    def _write_outputs(self, groups: list[list[Path]], files: list[Path], removed: DataFrame, n_removed: int, output_dir: Path) -> list[str]:
        """A parquet folder for each input file, under its name, with its own columns, rows in order over its parts.
        Of files with the same name, later ones get a number. A file of which nothing is left still gets its columns.

        Up to MOST_SENT removed places go to all executors and the rows stay where they are scanned, so an output has as
        many parts as its input has splits. More are joined, and the rows then put in ranges of (file, row), so that all
        outputs together have hardly more parts than there are ranges.
        """
        output_dir.mkdir(parents=True, exist_ok=True)
        rank, names, taken = src.ranks(files), {}, set()
        for f in files:
            name, k = f.name, 1
            while name in taken:
                k, name = k + 1, f"{f.stem}-{k + 1}{f.suffix}"
            taken.add(name)
            names[f] = name
        for k, group in enumerate(groups):
            rows = src.read_rows(self.spark, group, files)
            columns = [c for c in rows.columns if c not in PLACE]
            gone = removed.select(*PLACE)
            kept = rows.join(F.broadcast(gone) if n_removed <= MOST_SENT else gone.hint("merge"), PLACE, "left_anti")  # size checked
            if n_removed > MOST_SENT:
                kept = kept.repartitionByRange(*PLACE)
            kept = kept.sortWithinPartitions(*PLACE)
            fresh = output_dir / f".writing-{k}"
            kept.select(*(F.col(f"`{c}`") for c in columns), F.col("file_rank").alias("_of_file")).write.mode("overwrite").partitionBy("_of_file").parquet(str(fresh))
            for f in group:
                to, part = output_dir / names[f], fresh / f"_of_file={rank[f]}"
                shutil.rmtree(to, ignore_errors=True)
                if part.exists():
                    part.rename(to)
                else:
                    self.spark.read.parquet(str(f)).limit(0).write.parquet(str(to))
            shutil.rmtree(fresh, ignore_errors=True)
        return [str(output_dir / names[f]) for f in files]

    def _write_removals(self, removed: DataFrame, files: list[Path], ids: list[int], dataset: str) -> None:
        rank = src.ranks(files)
        of = self.spark.createDataFrame([(rank[f], i, f.as_uri()) for f, i in zip(files, ids)], "file_rank int, file_id int, source_file string")
        name = "file_id" if self.config.record_replay_manifest else "source_file"
        removed.join(of, "file_rank").select(name, F.col("row_index").alias("source_row"), "reason").write.mode("overwrite").parquet(str(self.removals_path(dataset)))

    # ---------------------------------------------------------- withdraw

    def withdraw(self, dataset: str, purge_outputs: bool = False) -> WithdrawReport:
        """Forgets a release: later ones are screened as if it weren't there. Its outputs stay unless they are purged, and then
        only what was recorded goes, and the folder if nothing else is in it. An unknown release is an error.

        The ledger's event comes when all else is done, and each step can be done again, so a withdrawal that was cut off is
        finished by calling it once more; until then the release still counts as there."""
        began = time.monotonic()
        meta = self.meta(dataset)
        if meta is None:
            raise KeyError(f"no release {dataset!r} is in the index")
        others = [t for t in self.datasets() if t != dataset]
        alone, anew = self.index.withdraw(dataset, others)
        outputs = meta["output_files"]
        if purge_outputs:
            for f in map(Path, outputs):
                shutil.rmtree(f, ignore_errors=True) if f.is_dir() else f.unlink(missing_ok=True)
            folder = Path(meta["output_dir"])
            if folder.is_dir() and not any(folder.iterdir()):
                folder.rmdir()
        shutil.rmtree(self.removals_path(dataset), ignore_errors=True)
        self._record({"op": "withdraw", "dataset": dataset})
        shutil.rmtree(self._meta_file(dataset).parent, ignore_errors=True)
        return WithdrawReport(dataset, alone, anew, [] if purge_outputs else outputs, purge_outputs, time.monotonic() - began)

    def stats(self) -> dict:
        return {"datasets": self.datasets(), "bands": self.index.stats(), "config": dataclasses.asdict(self.config), "state_dir": str(self.state)}


# ------------------------------------------------------- faithful withdrawal


def _survivors(sieve: Sieve, tag: str) -> list[dict]:
    """The ingests that still count, in order, without the tag's; each needs its list of inputs."""
    active, last = sieve.datasets(), {}
    for e in sieve.ledger():
        if e["op"] == "ingest":
            last[e["dataset"]] = e
    if tag not in last:
        raise KeyError(f"no release {tag!r} was ever ingested")
    events = [last[t] for t in active if t != tag]
    for e in events:
        if "inputs" not in e:
            raise ValueError(f"the ledger has no inputs of {e['dataset']!r}")
    return events


def _checked(sieve: Sieve, events: list[dict], dest: Path, config: SieveConfig | None) -> SieveConfig:
    config = config or sieve.config
    config.validate_against(sieve.state)
    drift = [d for e in events for d in sieve.paths.drift(e["inputs"])]
    if drift:
        raise ValueError("inputs are not what they were: " + "; ".join(f"{uri}: {why}" for _, uri, why in drift))
    if dest.exists() and any(dest.iterdir()):
        raise ValueError(f"{dest} is not empty")
    return config


def _link(a: str, b: str) -> None:
    """Parts of outputs are never changed, so the same bytes serve both; a copy where links can't be made."""
    try:
        os.link(a, b)
    except OSError:
        shutil.copy2(a, b)


def _replay(fresh: Sieve, old: Sieve, event: dict, output_root: Path, row_keys: Path | None = None) -> IngestReport:
    files = [src.uri_path(e.uri) for e in old.paths.resolve(event["inputs"])]
    return fresh._ingest(files, event["dataset"], output_root / folder_name(event["dataset"]), event["column"], row_keys)


def rebuild_survivors(spark: SparkSession, state_dir: str | Path, tag: str, dest: str | Path, config: SieveConfig | None = None, *, output_root: str | Path) -> list[IngestReport]:
    """Ingests all releases but `tag`, in order, into a new state folder. Releases withdrawn by now stay out."""
    old, dest = Sieve(spark, state_dir), Path(dest).resolve()
    events = _survivors(old, tag)
    config = dataclasses.replace(_checked(old, events, dest, config), record_replay_manifest=True)
    config.save(dest)
    fresh = Sieve(spark, dest, config)
    return [_replay(fresh, old, e, Path(output_root).resolve()) for e in events]


def rebuild_survivors_suffix(spark: SparkSession, state_dir: str | Path, tag: str, dest: str | Path, config: SieveConfig | None = None, *, output_root: str | Path) -> list[IngestReport]:
    """The same result, but releases ingested before `tag` are taken over as they are, as nothing of it reached them.
    Later ones are done again, from their row keys where those were kept, else from their texts."""
    old, dest, output_root = Sieve(spark, state_dir), Path(dest).resolve(), Path(output_root).resolve()
    events = _survivors(old, tag)
    at = min(e["event_no"] for e in old.ledger() if e["op"] == "ingest" and e["dataset"] == tag)
    # A release that was screened against one withdrawn since must be done again as well.
    gone = [e["event_no"] for e in old.ledger() if e["op"] == "ingest" and e["dataset"] not in old.datasets()]
    at = min([at, *gone])
    prefix, suffix = [e for e in events if e["event_no"] < at], [e for e in events if e["event_no"] >= at]
    config = dataclasses.replace(_checked(old, events, dest, config), record_replay_manifest=True, record_row_signatures=True)
    for e in prefix:
        missing = [f for f in old.meta(e["dataset"])["output_files"] if not Path(f).exists()]
        if missing:
            raise ValueError(f"outputs of {e['dataset']!r} are gone: {missing}")
    for e in suffix:
        kept = old.row_keys_path(e["dataset"])
        if kept.exists() and spark.read.parquet(str(kept)).count() != e["n_docs"]:
            raise ValueError(f"the row keys of {e['dataset']!r} are not as many as its rows")
    config.save(dest)
    fresh = Sieve(spark, dest, config)
    if old.paths.file.exists():
        shutil.copy(old.paths.file, fresh.paths.file)
    reports = []
    for e in prefix:
        name, meta = e["dataset"], old.meta(e["dataset"])
        for a, b in ((old.index.folder(name), fresh.index.folder(name)), (old.removals_path(name), fresh.removals_path(name)), (old.row_keys_path(name), fresh.row_keys_path(name))):
            if a.exists():
                shutil.copytree(a, b)
        folder = output_root / folder_name(name)
        outputs = []
        for f in map(Path, meta["output_files"]):
            shutil.copytree(f, folder / f.name, copy_function=_link)
            outputs.append(str(folder / f.name))
        write_json(fresh._meta_file(name), meta | {"output_dir": str(folder), "output_files": outputs})
        fresh.index.record(name, {r["band"]: r["n"] for r in fresh.index.keys([name]).groupBy("band").agg(F.count("*").alias("n")).collect()})
        fresh.index.compact(protect=name)
        fresh._record({k: v for k, v in e.items() if k not in ("event_no", "utc")} | {"output_dir": str(folder)})
        reports.append(fresh._replayed(fresh.meta(name)))
    for e in suffix:
        kept = old.row_keys_path(e["dataset"])
        reports.append(_replay(fresh, old, e, output_root, kept if kept.exists() else None))
    return reports
