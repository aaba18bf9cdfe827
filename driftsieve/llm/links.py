"""Row forms, block pairs, exact verification and components: what p1 and p3 share.

Texts with the same canonical form are one class; only classes are compared, so copies never pair up. Rows with the
same copy key (see formats.copy_keys) are copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftsieve.llm.arrow import chunks, hash128, named, partitions
from driftsieve.llm.formats import copy_keys
from driftsieve.llm.textforms import canonical_batch, mix, plain_batch, window_hashes
from driftsieve.storage import Workspace, spread

LEAST_LETTERS = 20
WIDTH = 20
THRESHOLD = 0.6
#: Members of a block that are paired in full; see linked_in_blocks for larger ones.
SPLIT_AT = 128
#: Pieces that a larger block's members are dealt into where others are held against all of them.
PIECES = 16


def check_threshold(threshold: float) -> None:
    """Signatures, sketches and prefixes are made for texts that share THRESHOLD of their windows or more."""
    if not THRESHOLD <= threshold <= 1:
        raise ValueError(f"the threshold must be from {THRESHOLD} to 1")


def forms(batches, least: int, extra):
    """For chunks of (id, text, tag): ids, tags, copy keys, classes, canonical texts, and extra(texts) of new classes.

    extra gets the canonical texts of classes not seen before in the batch, and gives (name, array) pairs of their values;
    other rows hold nulls there.
    """
    for b in batches:
        seen: set = set()
        for c in chunks([b]):
            plain = plain_batch(c.column(1).to_pylist())
            canon = canonical_batch(plain)
            at = [i for i, t in enumerate(canon) if len(t) - t.count(" ") >= least]
            texts = [canon[i] for i in at]
            k1, k2 = hash128(copy_keys([plain[i] for i in at], texts))
            c1, c2 = hash128(texts)
            new = []
            for i, k in enumerate(zip(c1.tolist(), c2.tolist())):
                if k not in seen:
                    seen.add(k)
                    new.append(i)
            back = np.full(len(at), -1)
            back[new] = np.arange(len(new))
            where = pa.array(back, pa.int64(), mask=back < 0)
            rows = pa.array(at, pa.int64())
            columns = {"id": c.column(0).take(rows)} | ({"tag": c.column(2).take(rows)} if c.num_columns > 2 else {})
            columns |= {"k1": pa.array(k1), "k2": pa.array(k2), "c1": pa.array(c1), "c2": pa.array(c2)}
            columns |= {n: v.take(where) for n, v in extra([texts[i] for i in new])}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def source(df: DataFrame, id_col: str, text_col: str, tag_col: str | None = None) -> DataFrame:
    columns = {"id": id_col, "text": text_col} | ({"tag": tag_col} if tag_col else {})
    return spread(named(df, **columns).where("id is not null and text is not null").withColumn("id", F.col("id").cast("long")))


# ------------------------------------------------------------------ blocks


#: A sized key is a key of so many bits under the logarithm of its member's size, in steps of 1/64 of an octave.
KEY_BITS, SIZE_STEPS = 40, 64
KEY, KEY_BYTES = (1 << KEY_BITS) - 1, KEY_BITS // 8


def sized(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return keys | np.minimum(np.log2(np.maximum(sizes, 1)) * SIZE_STEPS, (1 << 15) - 1).astype(np.int64) << KEY_BITS


#: Parts that a partition's postings are dealt into by key; a task sorts one part at a time.
PARTS = 64


def packed(lists: DataFrame, n: int) -> DataFrame:
    """(part, data) of (member, keys), with sized keys, dealt into n partitions by key: what goes there from a batch is one row,
    in which each member is written once, and keys in the KEY_BYTES that they have. There they are dealt into parts, see _in_order."""

    def pack(batches):
        for b in batches:
            values, owner = b.column(1).flatten().to_numpy(), np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
            place = (mix((values & KEY).view(np.uint64)) % np.uint64(n)).astype(np.int32)
            order = np.lexsort((owner, place))
            values, owner, place = values[order], owner[order], place[order]
            at = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.empty(0, np.int64)
            members, data = b.column(0).to_numpy(), []
            for i, j in zip(at, np.r_[at[1:], len(place)]):
                who, count = np.unique(owner[i:j], return_counts=True)
                key = values[i:j].view(np.uint8).reshape(-1, 8)
                size = values[i:j][np.cumsum(count) - count] >> KEY_BITS
                data.append(b"".join(x.tobytes() for x in (np.array([len(who)]), members[who], size.astype(np.int16), count.astype(np.int32), np.ascontiguousarray(key[:, :KEY_BYTES]))))
            yield pa.RecordBatch.from_arrays([pa.array(place[at]), pa.array(data, pa.binary())], names=["place", "data"])

    def unpacked(batches):
        for b in batches:
            for d in b.column(1):
                raw = np.frombuffer(d.as_buffer(), np.uint8)
                m = int(raw[:8].view(np.int64)[0])
                members, size, count = raw[8 : 8 + 8 * m].view(np.int64), raw[8 + 8 * m : 8 + 10 * m].view(np.int16), raw[8 + 10 * m : 8 + 14 * m].copy().view(np.int32)
                low = raw[8 + 14 * m :].reshape(-1, KEY_BYTES)
                key = np.zeros((len(low), 8), np.uint8)
                key[:, :KEY_BYTES] = low
                yield key.view(np.int64)[:, 0] | np.repeat(size.astype(np.int64), count) << KEY_BITS, np.repeat(members, count)

    def part(batches):
        def flush():
            keys, members = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            of = (mix((keys & KEY).view(np.uint64)) >> np.uint64(40)).astype(np.uint32) % np.uint32(PARTS)
            order = np.argsort(of.astype(np.uint8), kind="stable")
            keys, members, ends = keys[order], members[order], np.cumsum(np.bincount(of, minlength=PARTS)).tolist()
            data = [keys[i:j].tobytes() + members[i:j].tobytes() for i, j in zip([0, *ends], ends)]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS), pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])

        held, size = [], 0
        for h in unpacked(batches):
            held.append(h)
            size += len(h[0])
            if size >= 1 << 20:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return lists.mapInArrow(pack, "place int, data binary").repartitionById(n, "place").mapInArrow(part, "part int, data binary").sortWithinPartitions("part")


def _runs_of(batches):
    """Lists of the data of equal places or parts, of rows in their order."""
    held, last = [], None
    for b in batches:
        for at, d in zip(b.column(0).to_pylist(), b.column(1)):
            if held and at != last:
                yield held
                held = []
            held.append(d)
            last = at
    if held:
        yield held


def _in_order(batches):
    """(key, member) in order of keys without sizes, and of members, a part at a time; all of a key are in one part."""
    for blobs in _runs_of(batches):
        both = [np.frombuffer(d.as_buffer(), np.int64).reshape(2, -1) for d in blobs]
        keys, members = np.concatenate(both, axis=1)
        order = np.lexsort((members, keys & KEY))
        yield pa.RecordBatch.from_arrays([pa.array(keys[order]), pa.array(members[order])], names=["key", "member"])


#: Places at least that pairs are dealt into by their lesser member; a task adds up one place at a time.
PAIR_PLACES = 96


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of integers, all first ones, all second ones and so on, so that what is always 0 lies together."""
    return values.astype(np.int64).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(raw: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = raw.reshape(width, -1).T
    return out.view(np.int64)[:, 0]


def _added(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (a, b) as one with the sum of their n, or their number, in order."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)
    return a[at], b[at], np.diff(np.r_[at, len(a)]) if n is None else np.add.reduceat(n[order], at) if len(at) else n


def _dealt(places: int):
    """(place, data) of (key, a, b, n): equal (a, b) of many batches as one, and what goes to a place as one row, in which each a
    is written once. Members of hot blocks, whose b is null, go along with their keys."""

    def flush(held, hot):
        a, b, n = _added(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
        keys, members = (np.concatenate([h[k] for h in hot]) for k in (0, 1))
        place, place_hot = ((mix(x.astype(np.uint64)) % np.uint64(places)).astype(np.int32) for x in (a, members))
        order, order_hot = np.argsort(place, kind="stable"), np.argsort(place_hot, kind="stable")
        a, b, n, keys, members = a[order], b[order], n[order], keys[order_hot], members[order_hot]
        used = np.union1d(place, place_hot)
        ends, ends_hot = (np.searchsorted(np.sort(x), np.stack([used, used + 1])).T.tolist() for x in (place, place_hot))
        data = []
        for (i, j), (k, m) in zip(ends, ends_hot):
            at = i + np.flatnonzero(np.r_[True, a[i + 1 : j] != a[i : j - 1]]) if j > i else np.empty(0, np.int64)
            runs = np.diff(np.r_[at, j])
            data.append(b"".join((np.array([len(at), j - i, m - k]).tobytes(), _planes(a[at], 8), _planes(runs, 4), b[i:j].tobytes(), _planes(n[i:j], 4), keys[k:m].tobytes(), members[k:m].tobytes())))
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(data, pa.binary())], names=["place", "data"])

    def run(batches):
        none = (np.empty(0, np.int64),) * 2
        held, hot, size = [none], [none], 0
        for b in batches:
            to, x, y = (hot, 0, 1) if b.column(2).null_count else (held, 1, 2)
            to.append((b.column(x).to_numpy(), b.column(y).to_numpy()))
            size += b.num_rows
            if size >= 1 << 20:
                yield flush(held, hot)
                held, hot, size = [none], [none], 0
        if size:
            yield flush(held, hot)

    return run


def _united(least: int):
    """(key, a, b, shared) of rows (place, data) in order of places: pairs that share so many keys, and members of hot blocks."""

    def unite(blobs):
        pairs, hot = [], []
        for d in blobs:
            raw = np.frombuffer(d.as_buffer(), np.uint8)
            runs, size, n_hot = raw[:24].view(np.int64).tolist()
            a, count, b, n, keys, members = np.split(raw[24:], np.cumsum([8 * runs, 4 * runs, 8 * size, 4 * size, 8 * n_hot]))
            pairs.append((np.repeat(_from_planes(a, 8), _from_planes(count, 4)), b.copy().view(np.int64), _from_planes(n, 4)))
            hot.append((keys.copy().view(np.int64), members.copy().view(np.int64)))
        a, b, n = _added(*(np.concatenate(x) for x in zip(*pairs)))
        enough = n >= least
        a, b, n = a[enough], b[enough], n[enough]
        keys, members = (np.concatenate(x) for x in zip(*hot))
        none = lambda x: pa.nulls(len(x), pa.int64())
        columns = [pa.concat_arrays(x) for x in ((none(a), pa.array(keys)), (pa.array(a), pa.array(members)), (pa.array(b), none(keys)), (pa.array(n.astype(np.int32)), pa.array(np.ones(len(keys), np.int32))))]
        return pa.RecordBatch.from_arrays(columns, names=["key", "a", "b", "shared"])

    return lambda batches: map(unite, _runs_of(batches))


def _block_pairs(limit: int, threshold: float | None = None):
    """Pairs (key, a, b, n) of members that share a key, from rows (key, member) in order of their keys. With a threshold, keys are
    sized, and members of which one's size is under that part of the other's are no pair."""
    apart = None if threshold is None else int(np.log2(1 / threshold) * SIZE_STEPS) + 1

    def run(batches):
        held: list[np.ndarray] = []
        tail_key = None

        def out(a, b, key):
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=b == a), pa.array(np.ones(len(a), np.int32))], names=["key", "a", "b", "n"])

        def emit(keys, members, sizes):
            """Pairs of each run of equal keys up to the limit; members of longer runs, with themselves."""
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (members[1:] != members[:-1])
            keys, members, sizes_of = keys[new], members[new], sizes[new]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            rank = np.arange(len(keys)) - np.repeat(starts, sizes)
            size = np.repeat(sizes, sizes)
            large = size > limit
            if large.any():
                yield out(members[large], members[large], keys[large])
            small = np.flatnonzero(~large & (size > 1))
            step = 1
            while len(small):
                small = small[rank[small] + step < size[small]]
                pair = small if apart is None else small[np.abs(sizes_of[small] - sizes_of[small + step]) <= apart]
                if len(pair):
                    yield out(members[pair], members[pair + step], keys[pair])
                step += 1

        for b in batches:
            if not b.num_rows:
                continue
            keys, members = b.column(0).to_numpy(), b.column(1).to_numpy()
            sizes = keys >> KEY_BITS
            if apart is not None:
                keys = keys & KEY
            # Rows come sorted by key; the last key of a batch may go on in the next.
            last = keys[-1]
            cut = int(np.searchsorted(keys, last, "left"))
            if tail_key is not None and keys[0] != tail_key or cut > 0:
                done = np.concatenate([*held, np.stack([keys[:cut], members[:cut], sizes[:cut]])], axis=1)
                held = []
                if done.shape[1]:
                    yield from emit(*done)
            held.append(np.stack([keys[cut:], members[cut:], sizes[cut:]]))
            tail_key = last
            if sum(h.shape[1] for h in held) > 1 << 20:  # one key with a million rows: equal members count once
                done = np.concatenate(held, axis=1)
                held = [done[:, np.unique(done[1], return_index=True)[1]]]
        if held:
            yield from emit(*np.concatenate(held, axis=1))

    return run


def linked_in_blocks(blocks: DataFrame, keys_of: DataFrame, work: Workspace, verify, least: int = 1, groups: DataFrame | None = None, split_at: int = SPLIT_AT, threshold: float | None = None) -> DataFrame:
    """Links (id_a, id_b) of members that share at least `least` keys of `blocks` (key, member).

    verify takes pairs (a, b) of members and gives (a, b, id_a, id_b) of those that are linked. A block of over `split_at`
    members isn't paired in full: each of its members is held against the least member of each group in the block
    (`groups`: member, grp; one group if none are given). A member that is linked to it needs no other of that group: it is
    in one component with it, and has a link into the group. The others are held against all members of the group
    in the block; where a pair needs more than one key, against those that share another with them (`keys_of`: member, keys).

    With `threshold` `blocks` has (member, keys), whose keys, not those of `keys_of`, are sized (see sized), and pairs whose sizes rule a link out
    are left out before they are counted.
    """
    n = partitions(blocks)
    pairs_of = _block_pairs(split_at, threshold)
    if threshold is None:
        got = blocks.select("key", "member").repartition(n, "key").sortWithinPartitions("key", "member").mapInArrow(pairs_of, "key long, a long, b long, n int")
        got = got.groupBy("a", "b", F.when(F.col("b").isNull(), F.col("key")).alias("key")).agg(F.sum("n").alias("shared"))
        got = got.where(F.col("b").isNull() | (F.col("shared") >= least))
    else:
        deal = _dealt(n * -(-PAIR_PLACES // n))
        dealt = packed(blocks, n).mapInArrow(lambda batches: deal(pairs_of(_in_order(batches))), "place int, data binary")
        dealt = dealt.repartitionById(n, (F.col("place") % n).cast("int")).sortWithinPartitions("place")
        got = dealt.mapInArrow(_united(least), "key long, a long, b long, shared int")
    got = work.keep(got, "pairs")
    small = got.where("b is not null").select("a", "b")
    hot = got.where("b is null").select("key", F.col("a").alias("member"))
    if hot.isEmpty():
        return verify(small).select("id_a", "id_b")

    hot = work.keep(hot.join(groups, "member") if groups is not None else hot.withColumn("grp", F.lit(0)), "hot")
    first_of = hot.groupBy("key", "grp").agg(F.min("member").alias("first"))
    star = work.keep(hot.select("key", "member").distinct().join(first_of, "key").where("member <> first"), "star")
    pairs = work.keep(small.union(star.select(F.least("member", "first"), F.greatest("member", "first"))).distinct(), "first_pairs")
    linked = work.keep(verify(pairs), "first_links")
    done = linked.select(F.col("a").alias("member"), F.col("b").alias("first")).union(linked.select("b", "a")).distinct()
    left = work.keep(star.join(done, ["member", "first"], "left_anti").select("key", "member", "grp"), "left")
    out = linked.select("id_a", "id_b")
    if not left.isEmpty():
        if least > 1:
            other = keys_of.select("member", F.explode("keys").alias("other"))
            mine, theirs, on = left.join(other, "member").where("key <> other"), hot.join(other, "member"), ["key", "other", "grp"]
        else:  # a pair may share this block alone: the whole block, in pieces, so no task holds it
            mine = left.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
            theirs, on = hot.withColumn("piece", F.pmod(F.xxhash64("member"), F.lit(PIECES)).cast("int")), ["key", "piece", "grp"]
        mine, theirs = mine.withColumnRenamed("member", "u"), theirs.withColumnRenamed("member", "v")
        more = mine.join(theirs, on).where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        out = out.union(verify(more.join(pairs, ["a", "b"], "left_anti")).select("id_a", "id_b"))
    return out.distinct()


# ------------------------------------------------------------ verification


def distinct_windows(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """The distinct window hashes of each text, ascending."""
    hashes, starts, counts = window_hashes(texts, width)
    out = []
    for s, n in zip(starts.tolist(), counts.tolist()):
        h = np.sort(hashes[s : s + n])
        out.append(h[np.r_[True, h[1:] != h[:-1]]])
    return out


def shared_windows(x: np.ndarray, y: np.ndarray) -> float:
    """The distinct windows two texts share, as a part of all their distinct windows."""
    h = np.concatenate((x, y))
    h.sort()
    both = int(np.count_nonzero(h[1:] == h[:-1]))
    return both / (len(h) - both)


def _verify(threshold: float):
    def run(batches):
        for b in batches:
            sets: dict = {}
            keep, at = [], 0
            for c in chunks([b]):
                x, y = c.column(2).to_pylist(), c.column(3).to_pylist()
                if len(sets) > 2000:
                    sets.clear()
                new = list({t for t in (*x, *y) if t not in sets})
                sets.update(zip(new, distinct_windows(new)))
                keep += [at + i for i, (s, t) in enumerate(zip(x, y)) if shared_windows(sets[s], sets[t]) >= threshold]
                at += len(x)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows)], names=["id_a", "id_b"])

    return run


#: Bits of a bitmap for each window at least, and at most twice as many.
BITS = 2


def bitmaps(texts: list[str], width: int = WIDTH) -> tuple[list[int], list[bytes]]:
    """For each text, its number of distinct windows and a bitmap of their hashes, of a power of two of bits."""
    sets = distinct_windows(texts, width)
    out = []
    for h in sets:
        size = 1 << max(6, (BITS * len(h) - 1).bit_length())
        bits = np.zeros(size, bool)
        bits[(h >> np.uint64(32)) & np.uint64(size - 1)] = True
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return [len(h) for h in sets], out


def most_shared(n_a: np.ndarray, n_b: np.ndarray, bits_a: list[bytes], bits_b: list[bytes]) -> np.ndarray:
    """No two texts with these bitmaps share a larger part of their windows: a bit that only one of them has is a window, at
    least one, that the other lacks. The longer bitmap is folded to the shorter."""
    lack_a, lack_b = np.zeros(len(n_a), np.int64), np.zeros(len(n_a), np.int64)
    sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (bits_a, bits_b)]
    kind = sizes[0] << 32 | sizes[1]
    for k in np.unique(kind).tolist():
        at = np.flatnonzero(kind == k)
        width = min(k >> 32, k & 0xFFFFFFFF)
        a, b = (np.bitwise_or.reduce(np.frombuffer(b"".join(x[i] for i in at.tolist()), np.uint64).reshape(len(at), -1, width // 8), axis=1) for x in (bits_a, bits_b))
        lack_a[at] = np.bitwise_count(a & ~b).sum(1)
        lack_b[at] = np.bitwise_count(b & ~a).sum(1)
    both = np.minimum(n_a - lack_a, n_b - lack_b)
    return both / np.maximum(n_a + n_b - both, 1)


def _may_reach(threshold: float):
    """Of (id_a, id_b, n_a, n_b, bits_a, bits_b), the pairs that the bitmaps don't rule out."""

    def run(batches):
        for c in chunks(batches, 4000):
            n_a, n_b = (c.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            rows = pa.array(np.flatnonzero(most_shared(n_a, n_b, c.column(4).to_pylist(), c.column(5).to_pylist()) >= threshold))
            yield pa.RecordBatch.from_arrays([c.column(0).take(rows), c.column(1).take(rows)], names=["id_a", "id_b"])

    return run


#: Places of a filter at most; it is sent to all executors, 8 MB.
PLACES = 1 << 26


def _places(ids: np.ndarray, size: int) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(size - 1)


def filter_of(ids: DataFrame, most: int = PLACES) -> np.ndarray:
    """Bits at the places of all ids (id): eight places an id, as far as `most` goes. What isn't an id is found at a place now and
    then, an id always."""
    size = min(most, 1 << max(6, (8 * ids.count() - 1).bit_length()))

    def run(batches):
        for b in batches:
            at = _places(b.column(0).to_numpy(), size)
            bits = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    words = ids.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # size / 64 rows at most
    out = np.zeros(size // 64, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out.view(np.uint64)


def may_hold(places: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _places(ids, len(places) * 64)
    return places[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) > 0


def verified(pairs: DataFrame, rows: DataFrame, work: Workspace, threshold: float = THRESHOLD, bounded: bool = False) -> DataFrame:
    """Of (id_a, id_b), the pairs whose whole canonical texts share windows to at least the threshold.

    rows: (id, text). Only the texts of rows in pairs are read into canonical form. Where many pairs are expected to fail,
    `bounded` first holds bitmaps of their windows against each other, which rules out most of them and none that are linked, so
    only the texts of the others move. A filter of the ids wanted then goes to where texts are read, so that few others are
    shuffled to find those that are wanted.
    """
    pairs = work.keep(pairs, "candidates")
    wanted = pairs.select(F.col("id_a").alias("id")).union(pairs.select("id_b")).distinct()
    places = None
    if bounded:
        wanted = work.keep(wanted, "wanted")
        places = rows.sparkSession.sparkContext.broadcast(filter_of(wanted))

    def run(batches):
        for b in chunks(batches):
            if places is not None:
                b = b.take(pa.array(np.flatnonzero(may_hold(places.value, b.column(0).to_numpy()))))
            canon = canonical_batch(plain_batch(b.column(1).to_pylist()))
            columns = {"id": b.column(0), "canon": pa.array(canon, pa.string())}
            if bounded:
                n, bits = bitmaps(canon)
                columns |= {"n": pa.array(n, pa.int32()), "bits": pa.array(bits, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = "id long, canon string" + (", n int, bits binary" if bounded else "")
    if bounded:
        texts = work.keep(rows.select("id", "text").mapInArrow(run, kind).join(wanted, "id", "left_semi").dropDuplicates(["id"]), "canonical")
        a, b = (texts.select(F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
        held = pairs.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", "n_a", "n_b", "bits_a", "bits_b")
        pairs = work.keep(held.mapInArrow(_may_reach(threshold), "id_a long, id_b long"), "near_enough")
    else:
        texts = work.keep(rows.select("id", "text").join(wanted, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(run, kind), "canonical")
    a, b = (texts.select(F.col("id").alias(f"id_{x}"), F.col("canon").alias(f"canon_{x}")) for x in "ab")
    return pairs.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", "canon_a", "canon_b").mapInArrow(_verify(threshold), "id_a long, id_b long")


# -------------------------------------------------------------- components


def components(edges: DataFrame, work: Workspace, rounds: int = 40) -> DataFrame:
    """(node, label): the least node of each connected component of (u, v), for nodes that have an edge.

    Alternating large-star and small-star steps. Each takes minima by a combining aggregate and a join, so no task holds
    a node's neighbours; the tables between rounds are written.
    """
    edges = work.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    last = None
    for k in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u's smaller neighbours and u itself meet their least
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = work.keep(small, f"round{k}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def grouped(table: DataFrame, linked: DataFrame, work: Workspace) -> DataFrame:
    """(first_id, id) of rows (id, k1, k2), joined by equal keys and by links (id_a, id_b)."""
    firsts = table.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    ends = linked.select(F.col("id_a").alias("id")).union(linked.select("id_b")).distinct().withColumn("end", F.lit(True))
    copies = firsts.where("n > 1").select("k1", "k2", "first")
    # Rows alone with their key and without a link are their own group and need no row.
    row = table.select("id", "k1", "k2").join(copies, ["k1", "k2"], "left").join(ends, "id", "left").where("first is not null or end")
    row = work.keep(row.select("id", F.coalesce("first", "id").alias("first")).distinct(), "firsts")
    a, b = (row.select(F.col("id").alias(f"id_{x}"), F.col("first").alias(to)) for x, to in (("a", "u"), ("b", "v")))
    labels = components(linked.join(a, "id_a").join(b, "id_b").select("u", "v"), work)
    return row.join(labels, row["first"] == labels["node"], "left").select(F.coalesce("label", "first").alias("first_id"), "id").where("first_id <> id")
