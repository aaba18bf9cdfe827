"""MinHash signatures and band keys, as DataFrame transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftsieve.config import SieveConfig
from driftsieve.functions.shingles import normalized, shingles_of_normal

#: A Mersenne prime; products of two numbers below it fit a signed 64-bit integer.
PRIME = (1 << 31) - 1


def permutations(count: int, seed: int) -> list[tuple[int, int]]:
    """Pairs (a, b) with 0 < a < PRIME and 0 <= b < PRIME, from a linear congruential generator."""
    state, out = seed % PRIME, []
    for _ in range(count):
        a = state = (48271 * state + 11) % PRIME
        b = state = (48271 * state + 11) % PRIME
        out.append((a or 1, b))
    return out


def shingle_hash(c: Column, hash_name: str = "md5") -> Column:
    if hash_name == "md5":
        return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long") % PRIME
    return F.pmod(F.xxhash64(c), F.lit(PRIME))


def minhash(df: DataFrame, ids: list[str], text: str, config: SieveConfig = SieveConfig(), exact_fold: bool | None = None) -> DataFrame:
    """(ids, m0, m1, ...): for each permutation the least permuted hash of a row's shingles.

    Shingles are exploded and their minima combine before the shuffle, so what moves is a row's ids and its minima.
    """
    normal = df.select(*ids, normalized(F.col(f"`{text}`"), config.exact_fold if exact_fold is None else exact_fold).alias("_text"))  # a step of its own, so it is worked out once a row
    one = normal.select(*ids, F.explode(shingles_of_normal(F.col("_text"), config.ngram_type, config.ngram_size)).alias("_shingle"))
    hashed = one.select(*ids, shingle_hash(F.col("_shingle"), config.hash_name).alias("_x"))
    return hashed.groupBy(*ids).agg(*(F.min((F.col("_x") * a + b) % PRIME).alias(f"m{i}") for i, (a, b) in enumerate(permutations(config.num_perm, config.seed))))


def band_hash(columns: list[Column], hash_name: str = "md5") -> Column:
    if hash_name == "md5":
        return F.conv(F.substring(F.md5(F.concat_ws(",", *(c.cast("string") for c in columns))), 1, 15), 16, 10).cast("long")
    return F.xxhash64(*columns)


def band_keys(df: DataFrame, ids: list[str], text: str, config: SieveConfig = SieveConfig(), exact_fold: bool | None = None) -> DataFrame:
    """(ids, keys): each row's band keys, in order of bands. A row that comes twice under the same ids counts once."""
    r = config.rows_per_band
    keys = F.array(*(band_hash([F.col(f"m{i}") for i in range(b * r, (b + 1) * r)], config.hash_name) for b in range(config.num_bands)))
    return minhash(df, ids, text, config, exact_fold).select(*ids, keys.alias("keys"))


def by_band(df: DataFrame, keys: str = "keys") -> DataFrame:
    """One row per band and key; other columns are kept. Null arrays have none."""
    return df.select(*(c for c in df.columns if c != keys), F.posexplode(keys).alias("band", "key"))
