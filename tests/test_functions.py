import pytest
from pyspark.sql import functions as F

from driftsieve.config import SieveConfig
from driftsieve.functions.shingles import casefold, normalized, sanitized, shingles
from driftsieve.functions.signatures import band_keys, minhash
from driftsieve.operators.index import folder_name


def values(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_normalized(spark):
    texts = ["  Ab\t\nCd   Ef ", None, "", " \t ", "STRASSE Straße", "a　b c", "ΣΑΣ", "x\x1cy"]
    assert values(spark, normalized, texts) == [" ".join((t or "").casefold().split()) for t in texts]


def test_exact_fold(spark):
    texts = ["ﬁn ΐ ŉ", "Straße", "ǰ"]
    assert values(spark, lambda c: casefold(c, True), texts) == [t.casefold() for t in texts]


@pytest.mark.parametrize("text", ["", "hi", "  hi  ", "a" * 19, "b" * 20, "abcdefghijklmnopqrstu", "😀" * 22, "A b  c\nd", None, "a\nb" * 10])
def test_char_shingles(spark, text):
    t = " ".join((text or "").casefold().split())
    assert values(spark, lambda c: shingles(c, "char", 20), [text]) == [[t[i : i + 20] for i in range(max(1, len(t) - 19))]]


@pytest.mark.parametrize("text", ["", "one", "one two  three", "a b c d e", "a b c d e f\tg", None])
def test_word_shingles(spark, text):
    w = (text or "").casefold().split()
    assert values(spark, lambda c: shingles(c, "word", 5), [text]) == [[" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))]]


def test_unknown_kind():
    with pytest.raises(ValueError):
        shingles(F, "byte", 3)


def test_long_text_is_not_quadratic(spark):
    assert values(spark, lambda c: F.size(shingles(c, "char", 20)), ["ab cd " * 60_000]) == [359_999 - 19]


def keys(spark, texts, **settings):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return {r["i"]: r["keys"] for r in band_keys(df, ["i"], "t", SieveConfig(**settings)).collect()}


@pytest.mark.parametrize("hash_name", ["md5", "xxhash64"])
def test_band_keys(spark, hash_name):
    base = "the quick brown fox jumps over the lazy dog while seven judges box with five jovial wizards on quartz " * 3
    k = keys(spark, [base, base[:150] + "X" + base[151:], "entirely other words that share nothing with what came before them at all, not one", None, ""], hash_name=hash_name)
    assert all(len(x) == 8 for x in k.values())
    assert any(a == b for a, b in zip(k[0], k[1])) and not any(a == b for a, b in zip(k[0], k[2]))
    assert k[3] == k[4]
    assert keys(spark, [base], hash_name=hash_name, seed=7)[0] != k[0]


def test_keys_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, f"text number {i} " * 9) for i in range(40)], "i int, t string")
    one, many = (sorted(map(tuple, minhash(d, ["i"], "t").collect())) for d in (df.coalesce(1), df.repartition(7)))
    assert one == many


def test_exact_fold_is_a_setting(spark):
    pair = ["an oﬃce of ﬁne works", "an OFFICE of FINE works"]
    a, b = keys(spark, pair, exact_fold=True).values()
    assert a == b and len(set(map(tuple, keys(spark, pair).values()))) == 2


def test_config():
    for wrong in ({"num_bands": 7}, {"ngram_type": "byte"}, {"ngram_size": 0}, {"tier_fanout": 1}, {"probe_order": "x"}, {"sig_chunk_rows": 0}, {"screen_batch_bytes": 0}, {"ray_max_in_flight": -1}, {"hash_name": "x"}):
        with pytest.raises(ValueError):
            SieveConfig(**wrong)
    assert SieveConfig().rows_per_band == 8 and SieveConfig().screen_batch_rows == (256 << 20) // 64


def test_config_is_kept(tmp_path):
    SieveConfig(seed=1).save(tmp_path)
    assert SieveConfig.load(tmp_path).seed == 1
    with pytest.raises(ValueError, match="seed.*num_perm|num_perm.*seed"):
        SieveConfig(num_perm=32, seed=2).validate_against(tmp_path)


def test_names(spark):
    tags = [" a b/c ", "", "ok-1.x=2_", "ü"]
    assert values(spark, sanitized, tags) == ["a_b_c", "shard", "ok-1.x=2_", "_"]
    assert folder_name("ok") == "ok" and folder_name("a b") != folder_name("a_b") and folder_name("a b") != folder_name("a/b")
