"""The key index of a state folder: one parquet partition a release and band, and a manifest of runs.

A release's keys stay in its own partition for good, so membership of any set of releases is a choice of folders, and a
withdrawal drops one folder. The manifest follows the size-tiered policy over runs of keys (a level with `fanout`
unprotected runs merges its smallest into the next), as it says which runs a screening would look through; it holds no keys.
"""

from __future__ import annotations

import hashlib
import re
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftsieve.config import PROBE_ORDERS, read_json, write_json


#: Keys that one task sorts and writes.
KEYS_A_TASK = 1 << 22


def safe_name(tag: str) -> str:
    clean = re.sub(r"[^A-Za-z0-9_.=-]", "_", tag.strip())
    return clean or "shard"


def folder_name(tag: str) -> str:
    """A name of its own for each tag: one that had to be changed carries a hash."""
    clean = safe_name(tag)
    return clean if clean == tag and clean.strip(".") else f"{clean}-{hashlib.sha1(tag.encode()).hexdigest()[:8]}"


class KeyIndex:
    def __init__(self, spark: SparkSession, state_dir: str | Path, bands: int, fanout: int = 4):
        self.spark, self.path, self.bands, self.fanout = spark, Path(state_dir) / "index", bands, fanout

    # -------------------------------------------------------------- keys

    def folder(self, tag: str) -> Path:
        return self.path / f"dataset={folder_name(tag)}"

    def append(self, keys: DataFrame, tag: str, rows: int = 0) -> dict[int, int]:
        """Writes a release's distinct (band, key); replaces what an earlier try left. Gives the count of each band.

        Ranges of (band, key) are the tasks, as many as a release of so many rows needs, so a band is spread over files, each
        sorted and of a range of its own, which readers skip by its least and greatest key.
        """
        out, n = self.folder(tag), max(1, -(-rows * self.bands // KEYS_A_TASK))
        keys.select("band", "key").distinct().repartitionByRange(n, "band", "key").sortWithinPartitions("band", "key").write.mode("overwrite").partitionBy("band").parquet(str(out))
        return {r["band"]: r["n"] for r in self.keys([tag]).groupBy("band").agg(F.count("*").alias("n")).collect()}

    def keys(self, tags: list[str], band: int | None = None) -> DataFrame:
        """(dataset, band, key) of these releases; other folders, and other bands if one is given, are not read."""
        schema = "key long, dataset string, band int"
        frames = [self.spark.read.schema("key long, band int").parquet(str(self.folder(t))).withColumn("dataset", F.lit(t)).select("dataset", "band", "key") for t in tags if any(self.folder(t).glob("band=*"))]
        if not frames:
            return self.spark.createDataFrame([], schema).select("dataset", "band", "key")
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out if band is None else out.where(F.col("band") == band)

    def union(self, tags: list[str], band: int) -> DataFrame:
        return self.keys(tags, band).select("key").distinct()

    def drop(self, tag: str) -> None:
        shutil.rmtree(self.folder(tag), ignore_errors=True)

    # ---------------------------------------------------------- manifest

    @property
    def _manifest(self) -> Path:
        return self.path.parent / "manifest.json"

    def manifest(self) -> dict:
        m = read_json(self._manifest, {"fanout": None, "protected": [], "seq": 0, "bands": {}})
        for b in range(self.bands):
            m["bands"].setdefault(str(b), [])
        return m

    def protected(self) -> list[str]:
        return sorted(self.manifest()["protected"])

    def protect(self, tags: list[str]) -> None:
        m = self.manifest()
        m["protected"] = sorted(set(tags))
        write_json(self._manifest, m)

    def runs(self, band: int, without: str | None = None) -> list[dict]:
        return [r for r in self.manifest()["bands"][str(band)] if without is None or r["dataset"] != without]

    def record(self, tag: str, counts: dict[int, int]) -> None:
        """A run of level 0 for each band with keys; takes the place of the tag's own run."""
        m = self.manifest()
        for b in range(self.bands):
            runs = m["bands"][str(b)] = [r for r in m["bands"][str(b)] if r["dataset"] != tag]
            if counts.get(b):
                runs.append({"run": m["seq"], "level": 0, "dataset": tag, "sources": [tag], "count": counts[b]})
                m["seq"] += 1
        write_json(self._manifest, m)

    def compact(self, protect: str | None = None) -> int:
        """Merges runs while a level has `fanout` unprotected ones; gives how many merges. Another fanout than before is refused."""
        m = self.manifest()
        if m["fanout"] not in (None, self.fanout):
            raise ValueError(f"runs were merged {m['fanout']} at a time, not {self.fanout}")
        kept, merges = {*m["protected"], protect}, 0
        for b in range(self.bands):
            while True:
                runs = m["bands"][str(b)]
                levels: dict[int, list[dict]] = {}
                for r in runs:
                    if not kept & set(r["sources"] or [r["dataset"]]):
                        levels.setdefault(r["level"], []).append(r)
                full = [k for k, v in sorted(levels.items()) if len(v) >= self.fanout]
                if not full:
                    break
                part = sorted(levels[full[0]], key=lambda r: r["count"])[: self.fanout]
                sources = sorted({s for r in part for s in r["sources"]}) if all(r["sources"] for r in part) else None
                count = self.keys(sources, b).select("key").distinct().count() if sources else sum(r["count"] for r in part)
                m["bands"][str(b)] = [r for r in runs if r not in part] + [{"run": m["seq"], "level": full[0] + 1, "dataset": None, "sources": sources, "count": count}]
                m["seq"] += 1
                m["fanout"] = self.fanout
                merges += 1
        write_json(self._manifest, m)
        return merges

    def probe_sequence(self, band: int, order: str, without: str | None = None) -> list[dict]:
        """The runs of a band in the order in which a screening would look; the order never changes its result."""
        if order not in PROBE_ORDERS:
            raise ValueError(f"probe_order must be one of {PROBE_ORDERS}")
        runs = self.runs(band, without)
        return runs[::-1] if order == "newest_first" else sorted(runs, key=lambda r: r["count"], reverse=order == "largest_first")

    def plan_withdrawal(self, tag: str) -> dict[int, dict]:
        """For each band: runs of the tag alone, merged runs that hold it, and the other releases in those."""
        out = {}
        for b in range(self.bands):
            own = [r for r in self.runs(b) if r["dataset"] == tag]
            merged = [r for r in self.runs(b) if r["dataset"] is None and (r["sources"] is None or tag in r["sources"])]
            others = None if any(r["sources"] is None for r in merged) else sorted({s for r in merged for s in r["sources"]} - {tag})
            out[b] = {"own": own, "merged": merged, "contributors": others}
        return out

    def withdraw(self, tag: str, active: list[str]) -> tuple[int, int]:
        """Drops a release; gives how many bands lost a run of their own only, and how many had merged runs made anew."""
        plan, m, alone, anew = self.plan_withdrawal(tag), self.manifest(), 0, 0
        for b, p in plan.items():
            runs = [r for r in m["bands"][str(b)] if r not in p["own"] and r not in p["merged"]]
            if p["merged"]:
                others = p["contributors"] if p["contributors"] is not None else [t for t in active if t != tag]
                count = self.keys(others, b).select("key").distinct().count() if others else 0
                if count:
                    runs.append({"run": m["seq"], "level": max(r["level"] for r in p["merged"]), "dataset": None, "sources": others, "count": count})
                    m["seq"] += 1
                anew += 1
            elif p["own"]:
                alone += 1
            m["bands"][str(b)] = runs
        write_json(self._manifest, m)
        self.drop(tag)
        return alone, anew

    def stats(self) -> dict[int, dict]:
        m = self.manifest()
        return {b: {"n_shards": len(self.runs(b)), "total_keys": sum(r["count"] for r in self.runs(b)), "fanout": m["fanout"]} for b in range(self.bands)}
