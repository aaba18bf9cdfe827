"""Mixing sources to target weights.

Tokens are packed into blocks of a fixed length, source by source, in a pseudorandom order of documents. Each output
shard draws its slots' sources from a multinomial with the target shares; a source's slots are numbered over all
shards and mapped through a pseudorandom permutation of its blocks, one for each repetition; slots and blocks are
joined by block. No block is used more often than its source allows, so no document is.
"""

from __future__ import annotations

import base64
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftsieve.llm.arrow import chunks, named
from driftsieve.storage import Workspace

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that byte-level BPE cuts text by before merging.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK, SHARD_SLOTS = 1024, 4096
#: Pieces whose token counts a task remembers; it forgets all of them beyond that.
REMEMBERED = 1 << 19
#: Sources that a table of weights may have, as it is read to the driver.
MOST_SOURCES = 100_000
#: Standard deviations of a multinomial draw within which a source's blocks count as used up.
EXHAUSTED = 6.0
_DOCS_A_BUCKET = 20_000

_loaded: dict = {}


def _tokenizer(path: str):
    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}), {}, regex.compile(PIECES)
    return _loaded[path]


def token_counts(texts: list[str], path: str = TOKENIZER) -> list[int]:
    """Tokens of each text. Merging stays within a piece of the pattern, so each different piece is encoded once."""
    encoding, known, pattern = _tokenizer(path)
    out = []
    for t in texts:
        n = 0
        for piece in pattern.findall(t):
            c = known.get(piece)
            if c is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                c = known[piece] = len(encoding.encode_ordinary(piece))
            n += c
        out.append(n)
    return out


def normal(source):
    """Sources are compared without regard to case and outer blanks."""
    return F.lower(F.regexp_replace(source.cast("string"), r"^\s+|\s+$", ""))


def sized(documents: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str) -> DataFrame:
    """(id, source, n): tokens of each document of a listed source; nulls of id, text or source are left out."""

    def run(batches):
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(token_counts(b.column(2).to_pylist(), tokenizer), pa.int64())], names=["id", "source", "n"])

    rows = named(documents, id=id_col, source=source_col, text=text_col).where("id is not null and text is not null and source is not null")
    return rows.select(F.col("id").cast("long"), normal(F.col("source")).alias("source"), "text").mapInArrow(run, "id long, source string, n long")


@dataclass(frozen=True)
class Source:
    source: str
    share: float
    repeats: int
    tokens: int
    blocks: int

    @property
    def capacity(self) -> int:
        return self.tokens * self.repeats


class Mixture:
    """A plan for a mix as large as all documents of the listed sources together, and the mix itself.

    weights: (source, target_share, max_repeats). A source listed twice, with a null, or with a negative number is refused.
    Documents of null or unlisted sources are left out; empty documents take no place; a row that comes twice is two
    documents. Without tokens, the mix is empty and every source with a share falls short of nothing.
    """

    def __init__(self, documents: DataFrame, weights: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = TOKENIZER, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 11):
        self.spark: SparkSession = documents.sparkSession
        self.block, self.shard_slots, self.seed = block, shard_slots, seed
        listed = named(weights, source="source", share="target_share", repeats="max_repeats").select(normal(F.col("source")), F.col("share").cast("double"), F.col("repeats").cast("long")).limit(MOST_SOURCES + 1).collect()
        if len(listed) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        if any(None in tuple(r) or r[1] < 0 or r[2] < 0 for r in listed) or len({r[0] for r in listed}) < len(listed):
            raise ValueError("each source needs one row with a share and a number of repeats, neither negative")
        self.work = Workspace(self.spark, "mixing")
        known = self.spark.createDataFrame([(r[0],) for r in listed], "source string")
        rows = named(documents, id=id_col, source=source_col, text=text_col).withColumn("s", normal(F.col("source")))
        rows = rows.join(F.broadcast(known.withColumnRenamed("source", "s")), "s", "left_semi")  # at most MOST_SOURCES names
        self.sized = self.work.keep(sized(rows, "id", "text", "source", tokenizer).where("n > 0"), "sized")
        self.documents = 0
        sums = {}
        for s, tokens, docs in self.sized.groupBy("source").agg(F.sum("n"), F.count("*")).collect():
            sums[s] = tokens
            self.documents += docs
        self.sources = [Source(s, share, repeats, sums.get(s, 0), -(-sums.get(s, 0) // block)) for s, share, repeats in sorted(listed)]
        self.total = sum(sums.values())

    def short_sources(self) -> DataFrame:
        """(source): sources that can't fill their share even with each of their documents used as often as allowed.

        They are those whose slots use up their blocks in the mix as drawn, or come within EXHAUSTED standard deviations of
        it; the sums of tokens then say which of them fall short whatever the draw.
        """
        used, empty = F.coalesce("slots", F.lit(0)), F.col("most") == 0
        spent = self._sources().join(self.used(), "source", "left").where(empty | (used + EXHAUSTED * F.sqrt(used) + EXHAUSTED >= F.col("most")))
        return spent.where("short").select("source")

    def _sources(self) -> DataFrame:
        rows = [(s.source, s.share, s.tokens, s.repeats, s.blocks * s.repeats, s.share * self.total > s.capacity) for s in self.sources]
        return self.spark.createDataFrame(rows, "source string, target_share double, tokens long, max_repeats long, most long, short boolean")

    def used(self) -> DataFrame:
        """(source, slots, used_tokens): the slots of the mix that hold a block, and the tokens in them."""
        sizes = self.blocks().groupBy("source", "block").agg(F.sum("length").alias("length"))
        return self.slots().join(sizes, ["source", "block"]).groupBy("source").agg(F.count("*").alias("slots"), F.sum("length").alias("used_tokens"))

    def blocks(self) -> DataFrame:
        """(source, block, doc_id, start, length): the pieces of documents that make up each block."""
        buckets = max(1, -(-self.documents // _DOCS_A_BUCKET))
        rows = self.sized.withColumn("h", F.xxhash64("id", F.lit(self.seed))).withColumn("bucket", F.pmod("h", F.lit(buckets)))
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = rows.groupBy("source", "bucket").agg(F.sum("n").alias("size")).select("source", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
        inside = Window.partitionBy("source", "bucket").orderBy("h", "id", "n").rowsBetween(Window.unboundedPreceding, -1)
        placed = rows.withColumn("offset", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["source", "bucket"]).withColumn("offset", F.col("offset") + F.col("base"))
        size = F.lit(self.block)
        cut = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / size), F.floor((F.col("offset") + F.col("n") - 1) / size))))
        start = F.greatest(F.lit(0), F.col("block") * size - F.col("offset"))
        end = F.least(F.col("n"), (F.col("block") + 1) * size - F.col("offset"))
        return cut.select("source", "block", F.col("id").alias("doc_id"), start.alias("start"), (end - start).alias("length"))

    def slots(self) -> DataFrame:
        """(shard, source, repeat, block): what each slot of each shard takes; slots beyond a source's capacity are left out."""
        shares = np.array([s.share for s in self.sources])
        if not self.total or not shares.sum():
            return self.spark.createDataFrame([], "shard long, source string, repeat long, block long")
        total, each, seed, names = -(-self.total // self.block), self.shard_slots, self.seed, [s.source for s in self.sources]
        n_blocks, repeats = (np.array([getattr(s, a) for s in self.sources], np.int64) for a in ("blocks", "repeats"))

        def draw(batches):
            for b in batches:
                shard = b.column(0).to_numpy()
                counts = [np.random.default_rng([seed, int(k)]).multinomial(min(each, total - int(k) * each), shares / shares.sum()) for k in shard]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(shard, len(names))), pa.array(np.tile(np.arange(len(names), dtype=np.int32), len(shard))), pa.array(np.concatenate(counts))], names=["shard", "s", "count"])

        def permute(batches):
            for b in batches:
                shard, s, j = (b.column(k).to_numpy() for k in range(3))
                n = n_blocks[s]
                ok = j < n * repeats[s]
                shard, s, j, n = shard[ok], s[ok], j[ok], n[ok]
                block = permuted(j % np.maximum(n, 1), n, (np.uint64(seed) << np.uint64(40)) ^ (s.astype(np.uint64) << np.uint64(20)) ^ (j // np.maximum(n, 1)).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array([names[k] for k in s], pa.string()), pa.array(j // np.maximum(n, 1)), pa.array(block)], names=["shard", "source", "repeat", "block"])

        draws = self.spark.range(-(-total // each)).mapInArrow(draw, "shard long, s int, count long")
        before = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        numbered = draws.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).where("count > 0")
        return numbered.select("shard", "s", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("j")).mapInArrow(permute, "shard long, source string, repeat long, block long")

    def mix(self) -> DataFrame:
        """(shard, source, repeat, block, doc_id, start, length): the mix, as ranges of the documents' tokens."""
        return self.slots().join(self.blocks(), ["source", "block"]).select("shard", "source", "repeat", "block", "doc_id", "start", "length")

    def shares(self) -> DataFrame:
        """(source, target_share, actual_share, tokens, used_tokens, max_repeats, short): the mix as it came out."""
        used = self._sources().join(self.used(), "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
        all_used = F.sum("used_tokens").over(Window.partitionBy())  # a row for each source
        return used.select("source", "target_share", (F.col("used_tokens") / F.greatest(all_used, F.lit(1))).alias("actual_share"), "tokens", "used_tokens", "max_repeats", "short")


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of 0..size-1, one for each key, puts each index: a Feistel network on the least
    even number of bits that holds the size, applied until the value is within it."""
    half = np.array([max(1, math.ceil(math.log2(max(2, int(n))) / 2)) for n in np.unique(size)], np.uint64)[np.unique(size, return_inverse=True)[1]] if len(size) else np.empty(0, np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    value = index.astype(np.uint64)
    open_ = np.arange(len(value))
    while len(open_):
        h, m, k = half[open_], mask[open_], key[open_]
        left, right = value[open_] >> h, value[open_] & m
        for r in range(4):
            f = (right ^ (k * np.uint64(0x9E3779B97F4A7C15) + np.uint64((r + 1) * 0xBF58476D1CE4E5B9 % (1 << 64)))) * np.uint64(0x94D049BB133111EB)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f >> np.uint64(32)) & m)
        value[open_] = (left << h) | right
        open_ = open_[value[open_] >= size[open_].astype(np.uint64)]
    return value.astype(np.int64)
