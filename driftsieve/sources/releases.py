"""Input files of releases: resolving patterns, reading rows with their place, and the table of paths."""

from __future__ import annotations

import fcntl
import glob
import hashlib
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftsieve.config import read_json, write_json


def resolve(inputs: list[str] | str) -> list[Path]:
    """Files of each pattern, in the patterns' order and sorted within one; each real file once. A pattern that matches
    nothing and is no file gives nothing."""
    out: dict[str, None] = {}
    for pattern in [inputs] if isinstance(inputs, (str, Path)) else inputs:
        found = sorted(glob.glob(str(pattern), recursive=True)) or ([str(pattern)] if Path(pattern).exists() else [])
        out.update(dict.fromkeys(str(Path(f).resolve()) for f in found))
    return [Path(f) for f in out]


def ranks(files: list[Path]) -> dict[Path, int]:
    """Files by their path as a string: which row of a group is first goes by this, not by the order of input."""
    return {f: k for k, f in enumerate(sorted(files, key=str))}


def _leaf_schema(file: Path):
    part = next(iter(sorted(file.rglob("*.parquet"))), None) if file.is_dir() else file
    return pq.read_schema(part) if part else None


def grouped_by_schema(files: list[Path], column: str) -> list[list[Path]]:
    """Files that one scan can read, as their footers say. A file without the column is an error."""
    groups: dict[str, list[Path]] = {}
    for f in files:
        schema = _leaf_schema(f)
        if schema is None or column not in schema.names:
            raise ValueError(f"{f} has no column {column!r}")
        groups.setdefault(str(schema.remove_metadata()), []).append(f)
    return list(groups.values())


def place(spark: SparkSession, files: list[Path]) -> DataFrame:
    """(file_uri, file_rank), as scans name the files."""
    by = ranks(files)
    return spark.createDataFrame([(f.as_uri(), by[f]) for f in files], "file_uri string, file_rank int")


def read_rows(spark: SparkSession, group: list[Path], files: list[Path], columns: list[str] | None = None) -> DataFrame:
    """Rows of one group with (file_rank, row_index), the 0-based place within the file. The place comes from the scan
    itself, so it doesn't depend on how the file is split."""
    df = spark.read.parquet(*map(str, group))
    kept = [F.col(f"`{c}`") for c in (columns or df.columns)]
    df = df.select(*kept, F.col("_metadata.file_path").alias("_uri"), F.col("_metadata.row_index").alias("row_index"))
    at = place(spark, files)
    # Scans write file:///x, Path.as_uri file:///x with escapes alike; only the number of slashes may differ.
    df = df.withColumn("_uri", F.regexp_replace("_uri", "^file:/+", "file:///"))
    return df.join(at, df["_uri"] == at["file_uri"]).drop("_uri", "file_uri")


# ------------------------------------------------------------ table of paths


@dataclass(frozen=True)
class PathEntry:
    id: int
    uri: str
    digest: str
    size: int


def digest(file: Path) -> tuple[str, int]:
    h, size = hashlib.sha256(), 0
    for part in sorted(file.rglob("*.parquet")) if file.is_dir() else [file]:
        with open(part, "rb") as f:
            while block := f.read(1 << 20):
                h.update(block)
                size += len(block)
    return h.hexdigest(), size


def digests(spark: SparkSession, files: list[Path]) -> dict[Path, tuple[str, int]]:
    """The digest and size of each file, read in pieces on the executors; one task a file."""

    def run(batches):
        for pdf in batches:
            found = [digest(Path(f)) for f in pdf["file"]]
            yield pdf.assign(digest=[d for d, _ in found], size=[n for _, n in found])

    if not files:
        return {}
    names = spark.createDataFrame([(str(f),) for f in files], "file string").repartition(len(files), "file")
    return {Path(f): (d, n) for f, d, n in names.mapInPandas(run, "file string, digest string, size long").collect()}


class PathTable:
    """With a session, contents are hashed on the executors, else here. An append-only list of (id, uri, digest, size); an id is its place. The same file with the same content has one id;
    with other content it gets another. A table that can't be read or whose ids are not their places is an error."""

    def __init__(self, state_dir: str | Path, spark: SparkSession | None = None):
        self.spark = spark
        self.file = Path(state_dir) / "paths.json"

    @contextmanager
    def _locked(self):
        self.file.parent.mkdir(parents=True, exist_ok=True)
        with open(self.file.with_suffix(".lock"), "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            yield

    def entries(self) -> list[PathEntry]:
        try:
            out = [PathEntry(**e) for e in read_json(self.file, [])]
        except (TypeError, ValueError) as e:
            raise ValueError(f"the table of paths can't be read: {self.file}") from e
        if [e.id for e in out] != list(range(len(out))):
            raise ValueError(f"ids of the table of paths are not their places: {self.file}")
        return out

    def _digests(self, files: list[Path]) -> dict[Path, tuple[str, int]]:
        return digests(self.spark, files) if self.spark else {f: digest(f) for f in files}

    def intern(self, files: list[Path]) -> list[int]:
        found = self._digests(files)
        content = [(f.as_uri(), *found[f]) for f in files]
        with self._locked():
            table = self.entries()
            known = {(e.uri, e.digest): e.id for e in table}
            ids = []
            for uri, d, size in content:
                if (uri, d) not in known:
                    known[uri, d] = len(table)
                    table.append(PathEntry(len(table), uri, d, size))
                ids.append(known[uri, d])
            write_json(self.file, [asdict(e) for e in table])
        return ids

    def resolve(self, ids: list[int]) -> list[PathEntry]:
        table = self.entries()
        for i in ids:
            if not 0 <= i < len(table):
                raise KeyError(f"no path has the id {i}")
        return [table[i] for i in ids]

    def drift(self, ids: list[int]) -> list[tuple[int, str, str]]:
        """(id, uri, reason) of files that are gone or have other content by now."""
        out, entries = [], self.resolve(ids)
        now = self._digests(list(dict.fromkeys(f for e in entries if (f := uri_path(e.uri)).exists())))
        for e in entries:
            file = uri_path(e.uri)
            if file not in now:
                out.append((e.id, e.uri, "missing"))
            elif now[file][0] != e.digest:
                out.append((e.id, e.uri, "digest_mismatch"))
        return out


def uri_path(uri: str) -> Path:
    from urllib.parse import unquote, urlparse

    return Path(unquote(urlparse(uri).path))
