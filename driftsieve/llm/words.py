"""Hashed words of texts, sentence by sentence, and sums of arrays over all partitions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftsieve.llm.arrow import chunks, named
from driftsieve.llm.textforms import canonical_batch, mix, plain_batch
from driftsieve.storage import spread

_B = 0xD1342543DE82EF95
_BINV = pow(_B, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _B), ("down", _BINV)):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _tables[name] = np.cumprod(p, dtype=np.uint64)
    return _tables["up"][:n], _tables["down"]


def word_hashes(canonical: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes (as int32) of the words of canonical texts, end to end, and each text's number of words."""
    counts = np.array([t.count(" ") + 1 if t else 0 for t in canonical], np.int64)
    joined = " ".join(t for t in canonical if t)
    if not joined:
        return np.empty(0, np.int32), counts
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    up, down = _powers(len(codes))
    space = np.flatnonzero(codes == 32)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(codes + np.uint64(7)) * up, dtype=np.uint64)))
    start, end = np.r_[0, space + 1], np.r_[space, len(codes)]
    h = mix((total[end] - total[start]) * down[start])
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32), counts


#: A sentence ends with one of these marks and what closes a quotation, before white space, or with its line.
_MARKS = ".!?…。"
SENTENCE_END = re.compile(r"[.!?…。][\"»”’')\]_*]*\s+")


def _lists(counts: np.ndarray, values: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values, kind))


#: Lines that are no sentences by their form: headings, prompts of a shell, and what brackets hold whole.
_NO_PROSE = re.compile(r"#|\$ |\[.*\]$|\{.*\}$")
_FENCE = "```"
_MARKED = re.compile(r"[.!?…。][\"»”’')\]_*]*$")


def sentences(plain: str) -> list[str]:
    """The sentences of a text in plain form. Headings, fenced code, shell lines and bracketed lines are none, by their
    form; nothing else is left out, whatever its length."""
    out, fenced = [], False
    for line in re.split(r"[\r\n]+", plain):
        line = line.strip()
        if line.startswith(_FENCE):
            fenced = not fenced
        elif line and not fenced and not _NO_PROSE.match(line):
            at = 0
            for end in SENTENCE_END.finditer(line):
                out.append(line[at : end.start() + 1])
                at = end.end()
            if at < len(line):
                out.append(line[at:])
    return out


def sentence_words(text: list[str], counts: list[int]) -> list[int]:
    """Words of each sentence of a text, given its pieces' words. A piece without an end mark that is over twice as long
    as the middle one of the text's marked sentences has lost its marks: it counts as so many sentences as it is
    longer, in even parts."""
    has = [s[-1] in _MARKS or _MARKED.search(s) is not None for s in text]
    marked = sorted(n for m, n in zip(has, counts) if m and n)
    if not marked:
        return [n for n in counts if n]
    usual, out = marked[len(marked) // 2], []
    for m, n in zip(has, counts):
        if n > 2 * usual and not m:
            k = round(n / usual)
            out += [n * (i + 1) // k - n * i // k for i in range(k)]
        elif n:
            out.append(n)
    return out


def flat(batch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, end to end, and their numbers."""
    lists = batch.column(column)
    return lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())


def words_of(df: DataFrame, id_col: str, text_col: str, by_sentence: bool = False) -> DataFrame:
    """(id, words): hashed words of the whole canonical text. By sentence, (id, words, sizes): the words of its sentences,
    and the numbers of words of each that has any."""

    def run(batches):
        for b in chunks(batches):
            plain = plain_batch(b.column(1).to_pylist())
            if not by_sentence:
                h, n = word_hashes(canonical_batch(plain))
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(n, h, pa.int32())], names=["id", "words"])
                continue
            texts = [sentences(p) for p in plain]
            h, n = word_hashes(canonical_batch([s for t in texts for s in t]))
            ends = np.cumsum([0, *map(len, texts)])
            sizes = [sentence_words(t, n[i:j].tolist()) for t, i, j in zip(texts, ends, ends[1:])]
            words = [sum(s) for s in sizes]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(words, h, pa.int32()), _lists([len(s) for s in sizes], [n for s in sizes for n in s], pa.int32())], names=["id", "words", "sizes"])

    source = spread(named(df, id=id_col, text=text_col).where("id is not null and text is not null").withColumn("id", F.col("id").cast("long")))
    return source.mapInArrow(run, "id long, words array<int>" + (", sizes array<int>" if by_sentence else ""))


#: Arrays are cut into pieces of at least so many numbers, and so many arrays are added by one task, or by the driver at last.
PIECES, LEAST_PIECE, FAN = 32, 1 << 14, 64


def summed(df: DataFrame, function, shape: tuple[int, ...], dtype=np.float64) -> np.ndarray:
    """The sum of function(batches), an array of a fixed shape, over all partitions of df, a scan.

    Arrays are cut into pieces and added on the executors in as many steps as there are partitions for, so neither a task nor
    the driver ever gets more than the pieces of FAN arrays, the driver of a quarter of those.
    """
    size = int(np.prod(shape))
    pieces = max(1, min(PIECES, size // LEAST_PIECE))
    each = -(-size // pieces)

    def run(batches):
        flat = np.zeros(each * pieces, dtype)
        flat[:size] = np.asarray(function(batches), dtype).reshape(-1)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([task] * pieces, pa.int32()), pa.array([p.tobytes() for p in flat.reshape(pieces, each)], pa.binary())], names=["piece", "part", "data"])

    def add(pdf):
        total = np.zeros(each, dtype)
        for d in pdf["data"]:
            total += np.frombuffer(d, dtype)
        return pdf.head(1).assign(data=[total.tobytes()])

    kind = "piece int, part int, data binary"
    parts, n = df.mapInArrow(run, kind), df.rdd.getNumPartitions()
    while n > FAN // 4:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("piece", "part").applyInPandas(add, kind)
        n = -(-n // FAN)
    out, got = np.zeros((pieces, each), dtype), parts.toArrow()
    for piece, data in zip(got.column("piece").to_pylist(), got.column("data")):
        out[piece] += np.frombuffer(data.as_buffer(), dtype)
    return out.reshape(-1)[:size].reshape(shape)
