"""Evaluation texts leaking into training text: latent semantic retrieval.

1. Passages of all documents give TF-IDF vectors over hashed words; a randomised SVD, with every pass distributed,
   gives the latent space.
2. Windows of the documents, at a stride, and windows of the items, at every word, are placed in that space. Windows of
   7 words at every sixth word are chosen such that any run of 12 words holds a whole one: where a document repeats
   12 words of an item, one of its windows equals an item's window, so the cosine is 1 and the search can't miss it.
   The item windows are in lists by nearest centre; each document window looks through its nearest lists.
3. Candidates over the least cosine are checked on the words themselves: the run they share is followed both ways,
   and for paraphrases the longest common subsequence of the passages around them is taken.
4. Reworded passages have no run of 12 words, so no equal window either: paraphrased_items takes windows of whole passages
   and a lower cosine, the longest common subsequence decides, and where items have answers, the document must hold
   the answer too.

A document is one row, so its candidates are checked where they are found and nothing of the corpus is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftsieve.llm import latent
from driftsieve.llm.arrow import named
from driftsieve.llm.textforms import canonical_batch, plain_batch
from driftsieve.llm.words import flat, word_hashes, words_of
from driftsieve.storage import Workspace

RUN = 12
WINDOW, STRIDE = 7, 6  # WINDOW + STRIDE - 1 is RUN
FEATURES = 1 << 14
RANK, SPARE = 32, 8
LEAST_COSINE = 0.95
LISTS, LOOKED_AT = 128, 2
#: Item windows in the index at a time, 128 bytes each and their words; more items are taken in several blocks.
BLOCK_WINDOWS = 200_000
_PASSAGE = 12  # words of the passages that the space is fitted on
#: Paraphrases: words of a passage, steps of its windows in documents and items, the words around a window that may hold the
#: rest of it, the least share of its words in common, the cosine under which no window is looked at, and lists looked at.
PASSAGE, PASSAGE_STRIDE, AROUND = 24, 6, 8
LEAST_COMMON = 0.7
PASSAGE_COSINE, PASSAGE_LOOKED_AT = 0.6, 48


class LatentSpace:
    """Weights of hashed words, and the latent vectors of words: FEATURES x RANK numbers, whatever the corpus."""

    def __init__(self, idf: np.ndarray, vectors: np.ndarray):
        self.idf, self.vectors = idf.astype(np.float32), vectors.astype(np.float32)
        self.scaled = self.vectors * self.idf[:, None]

    def windows(self, words: np.ndarray, starts: np.ndarray, window: int = WINDOW, end: np.ndarray | None = None) -> np.ndarray:
        """Unit vectors of the windows at these places. end: of each word's text, where windows may be longer than texts."""
        features = words & (FEATURES - 1)
        out = np.zeros((len(starts), self.scaled.shape[1]), np.float32)
        for k in range(window):
            if end is None:
                out += self.scaled[features[starts + k]]
            else:
                at = np.flatnonzero(starts + k < end[starts])
                out[at] += self.scaled[features[starts[at] + k]]
        norm = np.sqrt((out * out).sum(1))
        out[norm == 0, 0] = 1  # windows of words without weight are alike
        norm[norm == 0] = 1
        return out / norm[:, None]


def fit(words: DataFrame) -> LatentSpace:
    """The space of the passages of all documents, words: (words array<int>)."""
    seen = latent.frequencies(words, FEATURES, _PASSAGE)
    return LatentSpace(latent.weights(seen), latent.fit(words, seen, RANK, SPARE, _PASSAGE))


def passages(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where the passages of texts start: every PASSAGE_STRIDE words and at the end; of a text that is shorter, the whole. Texts of
    fewer than RUN words have none."""
    place = np.arange(len(begin))
    at = ((place - begin) % PASSAGE_STRIDE == 0) & (place + PASSAGE <= end) | (place == np.maximum(begin, end - PASSAGE))
    return np.flatnonzero(at & (end - begin >= RUN))


class ItemWindows:
    """The windows of a block of items, at every word, in lists by nearest centre; or their passages."""

    def __init__(self, items: list[tuple[int, str]], space: LatentSpace, seed: int = 3, whole: bool = False):
        self.space, self.whole = space, whole
        canon = canonical_batch(plain_batch([t for _, t in items]))
        self.words, sizes = word_hashes(canon)
        ends = np.cumsum(sizes)
        self.item = np.repeat(np.array([i for i, _ in items], np.int64), sizes)
        self.end = np.repeat(ends, sizes)
        self.begin = np.repeat(ends - sizes, sizes)
        place = np.arange(len(self.words))
        self.starts = passages(self.begin, self.end) if whole else place[place + WINDOW <= self.end] if len(place) else place
        vectors = self._vectors(self.words, self.starts, self.end) if len(self.starts) else np.zeros((0, RANK), np.float32)
        lists = min(LISTS, max(1, len(self.starts)))
        rng = np.random.default_rng(seed)
        self.centres = vectors[rng.permutation(len(vectors))[:lists]] if len(vectors) else np.zeros((0, RANK), np.float32)
        for _ in range(5):
            if not len(vectors):
                break
            near = (vectors @ self.centres.T).argmax(1)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, near, vectors)
            norm = np.linalg.norm(sums, axis=1)
            self.centres = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-9)[:, None], self.centres)
        near = (vectors @ self.centres.T).argmax(1) if len(vectors) else np.empty(0, np.int64)
        self.lists = [np.flatnonzero(near == k) for k in range(len(self.centres))]
        self.vectors = vectors

    def _vectors(self, words, starts, end) -> np.ndarray:
        return self.space.windows(words, starts, PASSAGE, end) if self.whole else self.space.windows(words, starts)

    def search(self, words: np.ndarray, sizes: np.ndarray, least: float, lists: int = LOOKED_AT):
        """(place in words, place in the items' words) of windows with at least that cosine."""
        ends = np.cumsum(sizes)
        begin, end = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        place = np.arange(len(words))
        starts = passages(begin, end) if self.whole else place[((place - begin) % STRIDE == 0) & (place + WINDOW <= end)]
        if not len(starts) or not len(self.starts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        vectors = self._vectors(words, starts, end)
        score = vectors @ self.centres.T
        looked = min(lists, score.shape[1])
        top = np.argpartition(-score, looked - 1, axis=1)[:, :looked]
        a, b = [], []
        flat = top.ravel()
        order = np.argsort(flat, kind="stable")
        bounds = np.searchsorted(flat[order], np.arange(len(self.centres) + 1))
        for k in range(len(self.centres)):
            rows = order[bounds[k] : bounds[k + 1]] // looked
            if len(rows) and len(self.lists[k]):
                x, y = np.nonzero(vectors[rows] @ self.vectors[self.lists[k]].T >= least)
                a.append(starts[rows[x]])
                b.append(self.starts[self.lists[k][y]])
        return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _runs(words, begin, end, index: ItemWindows, a: np.ndarray, b: np.ndarray):
    """The lengths of the equal runs through candidate windows; 0 where the windows differ."""
    same = np.ones(len(a), bool)
    for k in range(WINDOW):
        same &= words[a + k] == index.words[b + k]
    length = np.where(same, WINDOW, 0)
    for step, edge_a, edge_b in ((1, end, index.end), (-1, begin, index.begin)):
        at = np.flatnonzero(same)
        x, y = (a[at] + WINDOW - 1, b[at] + WINDOW - 1) if step > 0 else (a[at], b[at])
        lim_a, lim_b = edge_a[a[at]], edge_b[b[at]]
        while len(at):
            x, y = x + step, y + step
            ok = (x < lim_a) & (y < lim_b) if step > 0 else (x >= lim_a) & (y >= lim_b)
            at, x, y, lim_a, lim_b = at[ok], x[ok], y[ok], lim_a[ok], lim_b[ok]
            ok = words[x] == index.words[y]
            at, x, y, lim_a, lim_b = at[ok], x[ok], y[ok], lim_a[ok], lim_b[ok]
            length[at] += 1
    return length


def common_subsequence(x: np.ndarray, y: np.ndarray) -> int:
    """The length of the longest common subsequence."""
    row = np.zeros(len(y) + 1, np.int64)
    for w in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == w, row[:-1] + 1, 0)))
    return int(row[-1])


def common_subsequences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The lengths of the longest common subsequences of the rows of x and y, all at once."""
    row = np.zeros((len(y), y.shape[1] + 1), np.int16)
    for k in range(x.shape[1]):
        hit = np.where(y == x[:, k, None], row[:, :-1] + 1, 0)
        row[:, 1:] = np.maximum.accumulate(np.maximum(row[:, 1:], hit), axis=1)
    return row[:, -1]


def _stretch(words: np.ndarray, first: np.ndarray, last: np.ndarray, width: int, none: int) -> np.ndarray:
    """The words from first up to last, a row each of that width; `none` where there are fewer."""
    at = first[:, None] + np.arange(width)
    ok = at < last[:, None]
    return np.where(ok, words[np.where(ok, at, 0)].astype(np.int64), none)


def _bits(words: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """256 bits for the words from first up to last, one bit a word."""
    out, row = np.zeros((len(first), 4), np.uint64), np.arange(len(first))
    for k in range(width):
        ok = first + k < last
        h = words[first[ok] + k].view(np.uint32) >> np.uint32(8)
        out[row[ok], (h >> np.uint32(6)) & np.uint32(3)] |= np.uint64(1) << (h & np.uint32(63)).astype(np.uint64)
    return out


def common_shares(words, begin, end, index: ItemWindows, a: np.ndarray, b: np.ndarray, least: float):
    """Of candidate passages (a, b), those of which the item passage's words have a share of `least` in common, in order, with the
    document's words at the candidate and AROUND it; and that share.

    A bit that only the item passage has is a word, at least one, that the document lacks there; so most candidates that don't
    have enough in common, and none that has, are left out before subsequences are taken.
    """
    span = PASSAGE + 2 * AROUND
    stretch = lambda i: (np.maximum(i - AROUND, begin[i]), np.minimum(i + PASSAGE + AROUND, end[i]))
    size = np.minimum(PASSAGE, index.end - np.arange(len(index.end)))  # of the passage that starts at each word
    (theirs, of_a), (mine, of_b) = (np.unique(v, return_inverse=True) for v in (a, b))
    bits_a, bits_b = _bits(words, *stretch(theirs), span), _bits(index.words, mine, mine + size[mine], PASSAGE)
    keep, shares = [np.empty(0, np.int64)], [np.empty(0)]
    for at in range(0, len(a), 50_000):
        part = slice(at, at + 50_000)
        lack = np.bitwise_count(bits_b[of_b[part]] & ~bits_a[of_a[part]]).sum(1)
        left = at + np.flatnonzero(size[b[part]] - lack >= least * size[b[part]] - 1e-9)
        i, j = a[left], b[left]
        common = common_subsequences(_stretch(index.words, j, j + size[j], PASSAGE, 1 << 40), _stretch(words, *stretch(i), span, 1 << 41))
        ok = common >= least * size[j] - 1e-9
        keep.append(left[ok])
        shares.append(common[ok] / size[j[ok]])
    keep = np.concatenate(keep)
    return a[keep], b[keep], np.concatenate(shares)


def holds(words: np.ndarray, answer: np.ndarray) -> bool:
    """Whether the answer's words are in these, one after the other; no words are in any."""
    if len(words) < len(answer):
        return False
    return not len(answer) or bool((np.lib.stride_tricks.sliding_window_view(words, len(answer)) == answer).all(1).any())


def paraphrased_items(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", doc_text: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, least_common: float = LEAST_COMMON, least_cosine: float = PASSAGE_COSINE) -> DataFrame:
    """(doc_id, item_id, common): documents that hold a passage of an item, reworded or not.

    An item's passages have PASSAGE words (all, if it is shorter) and start at every PASSAGE_STRIDE words; a document's passage whose
    cosine with it in the latent space is `least_cosine` or more is a candidate. `common` is the greatest share of an item passage's
    words that are in order in the document around a candidate; rows have `least_common` or more. With `answer_col`, the
    document must also hold the item's answer, anywhere and word for word in canonical form; items with a null or blank answer
    are not asked for one. Null ids and texts and items of fewer than RUN words are in no row.
    """
    work = Workspace(documents.sparkSession, "paraphrases")
    words = work.keep(words_of(documents, doc_col, doc_text), "words")
    space = fit(words.select("words"))

    def searching(block):
        index = ItemWindows([r[:2] for r in block], space, whole=True)
        h, n = word_hashes(canonical_batch(plain_batch([r[2] or "" for r in block])))
        ends = np.cumsum(n)
        answers: dict = {}  # an item that comes twice may have two answers, either of which will do
        for r, i, j in zip(block, ends - n, ends):
            answers.setdefault(r[0], []).append(h[i:j])

        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 50):
                    part = b.slice(at, 50)
                    w, n = flat(part, 1)
                    x, y = index.search(w, n, least_cosine, PASSAGE_LOOKED_AT)
                    ends = np.cumsum(n)
                    ids, begin, end = (np.repeat(v, n) for v in (part.column(0).to_numpy(), ends - n, ends))
                    x, y, share = common_shares(w, begin, end, index, x, y, least_common)
                    best: dict = {}
                    for k in range(len(x)):
                        key = (int(ids[x[k]]), int(index.item[y[k]]), int(begin[x[k]]), int(end[x[k]]))
                        best[key] = max(float(share[k]), best.get(key, 0.0))
                    if answer_col:
                        best = {k: s for k, s in best.items() if any(holds(w[k[2] : k[3]], a) for a in answers[k[1]])}
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in best], pa.int64()), pa.array([k[1] for k in best], pa.int64()), pa.array(best.values(), pa.float64())], names=["doc_id", "item_id", "common"])

        return run

    listed = named(items, id=item_col, text=item_text, **({"answer": answer_col} if answer_col else {})).where("id is not null and text is not null")
    listed = listed.select(F.col("id").cast("long"), "text", "answer" if answer_col else F.lit(None).cast("string").alias("answer")).distinct()
    out, block, size = None, [], 0

    def add(block):
        found = words.mapInArrow(searching(block), "doc_id long, item_id long, common double")
        return found if out is None else out.unionByName(found)

    for r in listed.toLocalIterator():
        block.append(tuple(r))
        size += r[1].count(" ") + 1
        if size >= BLOCK_WINDOWS:
            out, block, size = add(block), [], 0
    if block or out is None:
        out = add(block)
    return out.groupBy("doc_id", "item_id").agg(F.max("common").alias("common"))


def leaked_items(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", doc_text: str = "text", item_col: str = "item_id", item_text: str = "text", least_run: int = RUN, least_cosine: float = LEAST_COSINE, paraphrase: float | None = None) -> DataFrame:
    """(doc_id, item_id, run, common): documents that share a run of at least `least_run` words with an item.

    Words are compared in canonical form. `run` is the longest run. With `paraphrase`, also documents of which some passage
    as long as the item, around a candidate, has that share of the item's words as a common subsequence; `common` is the
    share (null where it is not asked for); reworded passages are for paraphrased_items. Null ids and texts are in no row; a row that comes twice counts once; empty
    tables give an empty result. `least_run` must be at least 12, the run for which the windows can't miss any.
    """
    if least_run < RUN:
        raise ValueError(f"runs under {RUN} words are not found by windows of {WINDOW} at a stride of {STRIDE}")
    schema = "doc_id long, item_id long, run int, common double"
    work = Workspace(documents.sparkSession, "leaks")
    words = work.keep(words_of(documents, doc_col, doc_text), "words")
    space = fit(words.select("words"))

    def searching(index: ItemWindows):
        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 200):
                    part = b.slice(at, 200)
                    w, n = flat(part, 1)
                    ids = np.repeat(part.column(0).to_numpy(), n)
                    x, y = index.search(w, n, least_cosine)
                    ends = np.cumsum(n)
                    begin, end = np.repeat(ends - n, n), np.repeat(ends, n)
                    length = _runs(w, begin, end, index, x, y)
                    best: dict = {}
                    for k in np.flatnonzero(length >= least_run).tolist():
                        key = (int(ids[x[k]]), int(index.item[y[k]]))
                        best[key] = (max(int(length[k]), best.get(key, (0, None))[0]), None)
                    if paraphrase is not None:
                        close: dict = {}
                        for k in range(len(x)):
                            close.setdefault((int(ids[x[k]]), int(index.item[y[k]])), set()).add((int(x[k]) - (int(y[k]) - int(index.begin[y[k]])), int(index.begin[y[k]]), int(index.end[y[k]]), int(begin[x[k]]), int(end[x[k]])))
                        for key, places in close.items():
                            share = 0.0
                            for place, i0, i1, d0, d1 in places:
                                span = i1 - i0
                                passage = w[max(d0, place - span // 4) : min(d1, place + span + span // 4)]
                                share = max(share, common_subsequence(index.words[i0:i1], passage) / span)
                            if share >= paraphrase or key in best:
                                best[key] = (best.get(key, (0, None))[0], share)
                    keys = list(best)
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([best[k][0] for k in keys], pa.int32()), pa.array([best[k][1] for k in keys], pa.float64())], names=["doc_id", "item_id", "run", "common"])

        return run

    out, block, size = None, [], 0

    def add(block):
        found = words.mapInArrow(searching(ItemWindows(block, space)), schema)
        return found if out is None else out.unionByName(found)

    listed = named(items, id=item_col, text=item_text).where("id is not null and text is not null").select(F.col("id").cast("long"), "text").distinct()
    for i, t in listed.toLocalIterator():
        block.append((i, t))
        size += t.count(" ") + 1
        if size >= BLOCK_WINDOWS:
            out, block, size = add(block), [], 0
    if block or out is None:
        out = add(block)
    return out.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.max("common").alias("common"))
