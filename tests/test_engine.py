import json
import random
import string
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from driftsieve.cli import main
from driftsieve.config import SieveConfig
from driftsieve.operators.index import KeyIndex
from driftsieve.plans.engine import Sieve, rebuild_survivors, rebuild_survivors_suffix
from driftsieve.sources.releases import PathTable, resolve

SMALL = SieveConfig(num_perm=16, num_bands=4, ngram_size=8, tier_fanout=2, hash_name="xxhash64")


def text(seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices(string.ascii_lowercase, k=7)) for _ in range(25))


def write(path: Path, texts, **more) -> str:
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table({"id": list(range(len(texts))), "text": texts} | more), path)
    return str(path)


def ids(spark, report):
    return sorted(r["text"] for f in report.output_files for r in spark.read.parquet(f).select("text").collect())


@pytest.fixture
def releases(tmp_path):
    shared = text(900)
    return {
        "a": write(tmp_path / "in/a.parquet", [text(i) for i in range(6)] + [text(0), shared]),
        "b": write(tmp_path / "in/b.parquet", [text(i) for i in range(3, 9)] + [shared]),
        "c": write(tmp_path / "in/c.parquet", [text(i) for i in range(8, 12)] + [text(10), shared]),
        "d": write(tmp_path / "in/d.parquet", [text(4), text(20), text(21)]),
    }


def run(spark, state, releases, names, out, config=SMALL):
    s = Sieve(spark, state, config)
    return s, {n: s.ingest([releases[n]], n, out / n) for n in names}


def test_ingest(spark, tmp_path, releases):
    s, r = run(spark, tmp_path / "s", releases, "ab", tmp_path / "o")
    assert (r["a"].n_input, r["a"].n_within_removed, r["a"].n_cross_removed, r["a"].n_output) == (8, 1, 0, 7)
    assert (r["b"].n_within_removed, r["b"].n_cross_removed, r["b"].n_output) == (0, 4, 3)
    assert ids(spark, r["b"]) == sorted(text(i) for i in range(6, 9))
    assert spark.read.parquet(r["a"].output_files[0]).columns == ["id", "text"]
    assert sorted((x["source_row"], x["reason"]) for x in s.removals("b").collect()) == [(0, "cross"), (1, "cross"), (2, "cross"), (6, "cross")]
    again = s.ingest(["/nowhere"], "b", tmp_path / "o2")
    assert again.replayed and (again.n_output, again.probes_done, again.probes_scheduled) == (3, 0, 0)
    assert s.datasets() == ["a", "b"] and s.stats()["bands"][0]["n_shards"] >= 1
    with pytest.raises(ValueError, match="seed"):
        Sieve(spark, tmp_path / "s", SieveConfig(num_perm=16, num_bands=4, ngram_size=8, tier_fanout=2, hash_name="xxhash64", seed=1)).ingest([], "x", tmp_path / "o")


def test_within_is_not_components(spark):
    """B meets A in band 0, C meets B in band 1: both go, and an all-null row has no key."""
    from driftsieve.functions.signatures import by_band
    from driftsieve.operators.dedup import keep_first_pairs, within_removals

    rows = spark.createDataFrame([(1, [5, 1]), (2, [5, 7]), (3, [9, 7]), (4, None)], "i int, keys array<long>")
    banded = by_band(rows)
    assert sorted(r[0] for r in within_removals(banded, ["i"]).collect()) == [2, 3]
    assert sorted(map(tuple, keep_first_pairs(banded, ["i"]).collect())) == [(2, 0, 1), (3, 1, 2)]


def test_order_is_by_path_then_row(spark, tmp_path):
    b, a = write(tmp_path / "b.parquet", [text(1), text(2)]), write(tmp_path / "a.parquet", [text(3), text(1)])
    s = Sieve(spark, tmp_path / "s", SMALL)
    s.ingest([b, a], "r", tmp_path / "o")
    gone = s.removals("r").collect()
    assert [(s.paths.entries()[r["file_id"]].uri.endswith("b.parquet"), r["source_row"]) for r in gone] == [(True, 0)]


def test_same_names_nulls_and_other_schemas(spark, tmp_path):
    x = write(tmp_path / "x/p.parquet", [text(1), None, ""], weight=[1.0, None, 2.0])
    y = write(tmp_path / "y/p.parquet", [text(2), ""])
    r = Sieve(spark, tmp_path / "s", SMALL).ingest([x, y], "r", tmp_path / "o")
    assert (r.n_input, r.n_within_removed, r.n_output) == (5, 2, 3)
    assert [Path(f).name for f in r.output_files] == ["p.parquet", "p-2.parquet"]
    assert [spark.read.parquet(f).columns for f in r.output_files] == [["id", "text", "weight"], ["id", "text"]]


def test_empty_releases_and_wrong_ones(spark, tmp_path):
    s = Sieve(spark, tmp_path / "s", SMALL)
    assert s.ingest([str(tmp_path / "none*.parquet")], "none", tmp_path / "o").n_input == 0
    empty = tmp_path / "e.parquet"
    pq.write_table(pa.table({"text": pa.array([], pa.string())}), empty)
    r = s.ingest([str(empty)], "empty", tmp_path / "o")
    assert r.n_output == 0 and spark.read.parquet(r.output_files[0]).columns == ["text"]
    with pytest.raises(ValueError, match="no column"):
        s.ingest([write(tmp_path / "w.parquet", ["x"])], "w", tmp_path / "o", text_column="body")
    assert s.datasets() == ["none", "empty"]
    with pytest.raises(KeyError):
        s.withdraw("never")


def test_withdraw(spark, tmp_path, releases):
    s, r = run(spark, tmp_path / "s", releases, "ab", tmp_path / "o")
    w = s.withdraw("a", purge_outputs=True)
    assert w.outputs_purged and not Path(r["a"].output_files[0]).exists() and not (tmp_path / "o/a").exists()
    assert (w.bands_o1, w.bands_rebuilt) == (4, 0) and s.datasets() == ["b"]
    kept = s.index.keys(["b"]).select("band", "key").distinct().count()
    assert sum(b["total_keys"] for b in s.stats()["bands"].values()) == kept
    assert s.ingest([releases["d"]], "d", tmp_path / "o/d").n_cross_removed == 1  # b still holds text 4
    s.withdraw("b")
    assert s.ingest([releases["a"]], "a", tmp_path / "o/a2").n_cross_removed == 1  # d's text 4
    assert s.datasets() == ["d", "a"]


def test_withdrawal_can_be_finished(spark, tmp_path, releases, monkeypatch):
    """Cut off at any step, it is finished by another call."""
    for step in ("_record", "index", "removals_path"):
        s, _ = run(spark, tmp_path / step, releases, "ab", tmp_path / step / "o")
        with monkeypatch.context() as m:
            boom = lambda *_: (_ for _ in ()).throw(OSError("cut off"))
            m.setattr(KeyIndex if step == "index" else Sieve, "withdraw" if step == "index" else step, boom)
            with pytest.raises(OSError):
                s.withdraw("a")
        assert s.datasets() == ["a", "b"]
        s.withdraw("a")
        assert s.datasets() == ["b"] and s.meta("a") is None and not s.index.folder("a").exists()
        assert {r["dataset"] for band in range(4) for r in s.index.runs(band)} == {"b"}


@pytest.mark.parametrize("most", [0, 100])
def test_outputs_keep_order_and_few_parts(spark, tmp_path, monkeypatch, most):
    """Three inputs and many shuffle partitions: parts don't multiply, and rows stay in order over a file's parts."""
    from driftsieve.plans import engine

    monkeypatch.setattr(engine, "MOST_SENT", most)
    files = [write(tmp_path / f"in/{k}.parquet", [text(100 * k + i % 40) for i in range(60)]) for k in range(3)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        r = Sieve(spark, tmp_path / "s", SMALL).ingest(files, "r", tmp_path / "o")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    parts = [sorted(Path(f).glob("part-*.parquet")) for f in r.output_files]
    assert r.n_output == 120 and sum(map(len, parts)) <= (3 if most else 12 + 2)
    for p in parts:
        assert [i for f in p for i in pq.read_table(f, columns=["id"])["id"].to_pylist()] == list(range(40))


def test_index_tasks_grow_with_keys(spark, tmp_path, monkeypatch):
    from driftsieve.operators import index as module

    monkeypatch.setattr(module, "KEYS_A_TASK", 100)
    index = KeyIndex(spark, tmp_path, 2, 2)
    counts = index.append(spark.range(1000).selectExpr("CAST(id % 2 AS INT) AS band", "id * 7919 % 1009 AS key"), "r", 500)
    files = list(index.folder("r").rglob("part-*.parquet"))
    ranges = sorted((int(f.parent.name[5:]), min(k), max(k)) for f in files if (k := pq.ParquetFile(f).read()["key"].to_pylist()))
    assert counts == {0: 500, 1: 500} and len(files) >= 10
    assert all(a[0] < b[0] or a[2] < b[1] for a, b in zip(ranges, ranges[1:]))


def test_no_hashing_without_a_manifest(spark, tmp_path, releases, monkeypatch):
    monkeypatch.setattr("driftsieve.sources.releases.digests", None)
    s, r = run(spark, tmp_path / "s", releases, "a", tmp_path / "o", SieveConfig(**{**SMALL.__dict__, "record_replay_manifest": False}))
    assert r["a"].n_output == 7 and s.removals("a").columns == ["source_file", "source_row", "reason"] and s.paths.entries() == []


def test_digests_on_executors(spark, tmp_path):
    from driftsieve.sources.releases import digest, digests

    files = [Path(write(tmp_path / f"{k}.parquet", [text(k)])) for k in range(3)]
    assert digests(spark, files) == {f: digest(f) for f in files} and digests(spark, []) == {}


def test_workspaces_go(spark, tmp_path, releases):
    from driftsieve.storage import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file://"))
    run(spark, tmp_path / "s", releases, "a", tmp_path / "o")
    assert not list(folder.glob("ingest-*"))


def test_rebuilds_equal_a_fresh_run(spark, tmp_path, releases):
    config = SieveConfig(**{**SMALL.__dict__, "record_row_signatures": True})
    run(spark, tmp_path / "s", releases, "abcd", tmp_path / "o", config)
    fresh, want = run(spark, tmp_path / "f", releases, "acd", tmp_path / "of", config)
    for name, rebuild in (("full", rebuild_survivors), ("suffix", rebuild_survivors_suffix)):
        got = rebuild(spark, tmp_path / "s", "b", tmp_path / name, output_root=tmp_path / f"o_{name}")
        assert [(g.dataset, g.n_within_removed, g.n_cross_removed, ids(spark, g)) for g in got] == [(n, w.n_within_removed, w.n_cross_removed, ids(spark, w)) for n, w in want.items()]
        rows = lambda s: sorted(map(tuple, s.index.keys(["a", "c", "d"]).collect()))
        assert rows(Sieve(spark, tmp_path / name)) == rows(fresh)
    with pytest.raises(ValueError, match="not empty"):
        rebuild_survivors(spark, tmp_path / "s", "b", tmp_path / "full", output_root=tmp_path / "x")
    with pytest.raises(KeyError):
        rebuild_survivors(spark, tmp_path / "s", "zz", tmp_path / "n", output_root=tmp_path / "x")
    write(Path(releases["c"]), [text(77)])
    with pytest.raises(ValueError, match="digest_mismatch"):
        rebuild_survivors_suffix(spark, tmp_path / "s", "b", tmp_path / "n", output_root=tmp_path / "x")
    assert not (tmp_path / "n").exists()


def test_compaction_is_a_counter(spark, tmp_path):
    index = KeyIndex(spark, tmp_path, 1, 2)
    for k in range(8):
        index.record(f"r{k}", index.append(spark.createDataFrame([(0, k), (0, 99)], "band int, key long"), f"r{k}"))
        index.compact()
    assert [(r["level"], r["count"], len(r["sources"])) for r in index.runs(0)] == [(3, 9, 8)]
    with pytest.raises(ValueError):
        KeyIndex(spark, tmp_path, 1, 3).compact()
    assert index.plan_withdrawal("r3")[0]["contributors"] == [f"r{k}" for k in range(8) if k != 3]
    assert index.withdraw("r3", []) == (0, 1) and index.withdraw("r3", []) == (0, 0)
    assert index.runs(0)[0]["count"] == 8
    with pytest.raises(ValueError):
        index.probe_sequence(0, "any")


def test_protected_runs_stay(spark, tmp_path):
    index = KeyIndex(spark, tmp_path, 1, 2)
    index.protect(["r0", "r1"])
    for k in range(3):
        index.record(f"r{k}", index.append(spark.createDataFrame([(0, k)], "band int, key long"), f"r{k}"))
    assert index.compact() == 0 and index.protected() == ["r0", "r1"]
    index.protect([])
    assert index.compact(protect="r2") == 1


def test_paths(tmp_path):
    f = Path(write(tmp_path / "x.parquet", ["a"]))
    table = PathTable(tmp_path / "s")
    assert table.intern([f]) == [0] and table.intern([f]) == [0]
    write(f, ["b"])
    assert table.intern([f]) == [1] and [d[2] for d in table.drift([0, 1])] == ["digest_mismatch"]
    f.unlink()
    assert [d[2] for d in table.drift([1])] == ["missing"]
    with pytest.raises(KeyError):
        table.resolve([5])
    table.file.write_text("[")
    with pytest.raises(ValueError):
        table.entries()


def test_resolve(tmp_path):
    a, b = write(tmp_path / "a.parquet", ["x"]), write(tmp_path / "b.parquet", ["x"])
    assert list(map(str, resolve([str(tmp_path / "b*"), str(tmp_path / "*.parquet"), "/nowhere/*"]))) == [b, a]


def test_broken_state_is_an_error(spark, tmp_path):
    (tmp_path / "ledger.json").write_text("{")
    with pytest.raises(ValueError):
        Sieve(spark, tmp_path, SMALL).datasets()


def test_cli(spark, tmp_path, releases, capsys):
    base = ["--state-dir", str(tmp_path / "s")]
    SMALL.save(tmp_path / "s")
    assert main([*base, "ingest", releases["a"], "--dataset", "a", "--output-dir", str(tmp_path / "o")], spark) == 0
    assert json.loads(capsys.readouterr().out)["n_output"] == 7
    main([*base, "stats"], spark)
    assert json.loads(capsys.readouterr().out)["datasets"] == ["a"]
    main([*base, "withdraw", "--dataset", "a", "--purge-outputs"], spark)
    assert json.loads(capsys.readouterr().out)["outputs_purged"]


def test_stream(spark, tmp_path):
    from driftsieve.streaming.ingest import ingest_stream

    s = Sieve(spark, tmp_path / "s", SMALL)
    landing = tmp_path / "in"
    write(landing / "1.parquet", [text(1), text(2), text(1)])
    for k in range(2):
        rows = spark.readStream.schema("id long, text string").parquet(str(landing))
        ingest_stream(s, rows, "feed", tmp_path / "land", tmp_path / "out", tmp_path / "cp").awaitTermination(120)
        write(landing / "2.parquet", [text(2), text(3)])
    assert s.datasets() == ["feed-00000000", "feed-00000001"]
    assert [s.removals(t).count() for t in s.datasets()] == [1, 1]
