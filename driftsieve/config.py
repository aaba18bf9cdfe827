"""Settings of an engine's state folder."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass
from pathlib import Path

#: Settings that decide which rows collide; they stay as they are for the life of a state folder.
FIXED = ("num_perm", "num_bands", "ngram_type", "ngram_size", "seed", "tier_fanout", "hash_name", "exact_fold")
PROBE_ORDERS = ("largest_first", "smallest_first", "newest_first")


@dataclass(frozen=True)
class SieveConfig:
    """num_perm minima in num_bands bands, over character or word n-grams.

    tier_fanout runs of a level make one of the next in the index's manifest. The settings on memory, workers, chunks and
    windows are accepted so that existing calls go on working; Spark sizes its own tasks. hash_name is "md5" (the keys
    can be worked out in SQL elsewhere) or "xxhash64" (about a third faster). exact_fold folds the letters that become several
    (ligatures and the like; sharp s is folded in any case) as Unicode has it, in Python.
    """

    num_perm: int = 64
    num_bands: int = 8
    ngram_type: str = "char"
    ngram_size: int = 20
    seed: int = 42
    tier_fanout: int = 4
    ram_budget_bytes: int = 4 << 30
    probe_order: str = "largest_first"
    n_workers: int = 0
    text_column: str = "text"
    sig_chunk_rows: int = 20_000
    ray_max_in_flight: int = 0
    screen_batch_bytes: int = 256 << 20
    record_replay_manifest: bool = True
    record_row_signatures: bool = False
    hash_name: str = "md5"
    exact_fold: bool = False

    def __post_init__(self):
        rules = {
            "num_bands must divide num_perm": self.num_bands >= 1 and self.num_perm >= 1 and self.num_perm % self.num_bands == 0,
            "ngram_type must be char or word": self.ngram_type in ("char", "word"),
            "ngram_size must be at least 1": self.ngram_size >= 1,
            "tier_fanout must be at least 2": self.tier_fanout >= 2,
            f"probe_order must be one of {PROBE_ORDERS}": self.probe_order in PROBE_ORDERS,
            "sig_chunk_rows must be at least 1": self.sig_chunk_rows >= 1,
            "screen_batch_bytes must be at least 1": self.screen_batch_bytes >= 1,
            "ray_max_in_flight must not be negative": self.ray_max_in_flight >= 0,
            "hash_name must be md5 or xxhash64": self.hash_name in ("md5", "xxhash64"),
        }
        broken = [text for text, ok in rules.items() if not ok]
        if broken:
            raise ValueError("; ".join(broken))

    @property
    def rows_per_band(self) -> int:
        return self.num_perm // self.num_bands

    @property
    def effective_workers(self) -> int:
        return self.n_workers or os.cpu_count() or 1

    @property
    def screen_batch_rows(self) -> int:
        return max(1, self.screen_batch_bytes // (8 * self.num_bands))

    @staticmethod
    def file(state_dir: str | Path) -> Path:
        return Path(state_dir) / "config.json"

    def save(self, state_dir: str | Path) -> None:
        write_json(self.file(state_dir), dataclasses.asdict(self))

    @classmethod
    def load(cls, state_dir: str | Path) -> "SieveConfig":
        known = {f.name for f in dataclasses.fields(cls)}
        return cls(**{k: v for k, v in read_json(cls.file(state_dir)).items() if k in known})

    def validate_against(self, state_dir: str | Path) -> None:
        """Refuses a fixed setting that differs from the state folder's; names each."""
        if not self.file(state_dir).exists():
            return
        kept = self.load(state_dir)
        differ = [f"{f}: {getattr(kept, f)!r} is kept, {getattr(self, f)!r} was given" for f in FIXED if getattr(kept, f) != getattr(self, f)]
        if differ:
            raise ValueError("settings differ from those of the state folder: " + "; ".join(differ))


def write_json(path: Path, value) -> None:
    """Whole or not at all: the new file takes the old one's place in one step."""
    path.parent.mkdir(parents=True, exist_ok=True)
    fresh = path.with_name(f".{path.name}.{os.getpid()}")
    fresh.write_text(json.dumps(value, indent=1))
    os.replace(fresh, path)


def read_json(path: Path, missing=None):
    """A file that is there but can't be read is an error, never an empty value."""
    if missing is not None and not path.exists():
        return missing
    return json.loads(path.read_text())
