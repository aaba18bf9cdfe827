"""Subject area of each document: bisecting k-means, leaves labelled by discriminative terms, leaf mixtures.

1. Every document gets a normalised vector of all its words (TF-IDF in a latent space of the whole corpus), and all
   vectors are clustered by bisecting k-means; each pass splits all leaves of a level at once, on the executors.
2. A leaf's discriminative terms are those that its documents hold far more often than chance would have it. Each
   sentence of the corpus is placed in a leaf by the discriminative terms it holds and by the leaves of its document's other
   sentences, and the leaves' terms are taken again from the sentences placed there. No label is used up to here.
3. Hand labels of a bounded sample of documents name the leaves: a leaf's mixture is the part of its sentences that belongs
   to each subject, or, as far as its labels are as mixed as all are, to none.
4. Through the leaves' mixtures each discriminative term speaks for subjects, those in leaves without labels by the company
   they keep. A sentence belongs to the likeliest subject, or to none, by its terms and its document's mixture, which
   is that of the leaves of its sentences. A document gets each subject of at least a quarter of its sentences.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftsieve.llm import latent
from driftsieve.llm.arrow import named
from driftsieve.llm.latent import cells, row_sums, runs
from driftsieve.llm.words import flat, summed, words_of
from driftsieve.storage import Workspace

#: Hashed words, of the latent space and of the terms.
SPACE, FEATURES = 1 << 14, 1 << 16
#: Labelled documents that the leaves are named by.
MOST_LABELLED = 20_000
#: Subjects, each a bit of a signed 64-bit number.
MOST_SUBJECTS = 62
#: The latent space; levels of splits, passes for each, and documents that a leaf has at least.
DIMENSIONS, LEVELS, ROUNDS, LEAST_LEAF = 56, 8, 2, 8
#: Discriminative terms of leaves: standard deviations over chance, in one leaf or over all; documents; and how many times
#: likelier than everywhere one leaf's documents hold them.
SURE, LEAST_DOCS, LIFT = 5.0, 5, 2.0
#: Discriminative terms of subjects: standard deviations over chance, and the part of its sentences that one subject has.
SUBJECT_SURE, SHARE = 5.0, 0.45
#: Times that the subjects' terms are taken from the sentences.
SUBJECT_PASSES = 4
#: Sentences that a term's rates are smoothed by; those that a document's own mixture is smoothed by, in leaves and in subjects.
SMOOTH, LEAF_PRIOR, SUBJECT_PRIOR = 2.0, 0.5, 1.0
#: What is left for subjects that a labelled document's labels don't name, as labels are wrong or incomplete at times.
UNNAMED = 0.05
#: Sentences that one of a labelled document counts as while no term of it speaks for a subject: it knows what others of its
#: leaf don't.
LABELLED = 5.0
LEAST_PART = 0.25
_DOCS_AT_ONCE = 64


def labelled_subjects(labels: DataFrame, areas: DataFrame, doc_col: str, subject_col: str, name_col: str) -> tuple[list[str], dict[int, int]]:
    """The subjects, and a bit for each subject of each document in the sample: labels are compared without regard to
    case and blanks, those of no listed subject are left out, and of a document's labels each different one counts once."""
    subjects = sorted({r[0] for r in named(areas, s=name_col).where("s is not null").distinct().limit(MOST_SUBJECTS + 1).collect()})
    if len(subjects) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    known = areas.sparkSession.createDataFrame([(s.strip().lower(), 1 << k) for k, s in enumerate(subjects)], "name string, bit long")
    bits = named(labels, doc=doc_col, subject=subject_col).withColumn("name", norm(F.col("subject"))).join(F.broadcast(known), "name")  # at most MOST_SUBJECTS rows
    each = bits.where("doc is not null").groupBy(F.col("doc").cast("long").alias("doc")).agg(F.bit_or("bit").alias("bits"))
    return subjects, {d: b for d, b in each.orderBy(F.xxhash64("doc"), "doc").limit(MOST_LABELLED).collect()}


# -------------------------------------------------------------- clustering


class Tree:
    """A binary tree of splits. A vector goes left where its product with a node's direction reaches the node's bound."""

    def __init__(self):
        self.left, self.right = [-1], [-1]
        self.direction, self.bound = [np.zeros(DIMENSIONS, np.float32)], [0.0]

    def split(self, node: int, direction: np.ndarray, bound: float) -> tuple[int, int]:
        new = len(self.left)
        self.left[node], self.right[node], self.direction[node], self.bound[node] = new, new + 1, direction.astype(np.float32), float(bound)
        for _ in range(2):
            self.left.append(-1), self.right.append(-1), self.direction.append(np.zeros(DIMENSIONS, np.float32)), self.bound.append(0.0)
        return new, new + 1

    def node(self, x: np.ndarray) -> np.ndarray:
        left, right, direction, bound = (np.array(a) for a in (self.left, self.right, self.direction, self.bound))
        out = np.zeros(len(x), np.int64)
        open_ = np.flatnonzero(left[out] >= 0)
        while len(open_):
            at = out[open_]
            side = np.einsum("ij,ij->i", x[open_], direction[at]) >= bound[at]
            out[open_] = np.where(side, left[at], right[at])
            open_ = open_[left[out[open_]] >= 0]
        return out

    def leaves(self) -> np.ndarray:
        """For each node its place among the leaves, -1 for inner nodes."""
        leaf = np.array(self.left) < 0
        return np.where(leaf, np.cumsum(leaf) - 1, -1)


def _read(b, column: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(column).to_pylist()), np.float16).reshape(-1, DIMENSIONS).astype(np.float32)


def _principal(count: float, total: np.ndarray, moments: np.ndarray) -> tuple[np.ndarray, float]:
    mean = total / count
    direction = np.linalg.eigh(moments / count - np.outer(mean, mean))[1][:, -1]
    direction *= np.sign(direction[np.abs(direction).argmax()])
    return direction, direction @ mean


def cluster(vectors: DataFrame, levels: int = LEVELS, rounds: int = ROUNDS, least: int = LEAST_LEAF) -> Tree:
    """Bisecting k-means with cosine over all vectors (vector): a leaf is first cut across its principal direction, then between the
    centres of its parts, and a level's leaves are split in the same passes. Leaves of fewer than twice `least`
    documents stay, as do those of which a part would be empty. Documents without words (zero vectors) stay out."""
    tree = Tree()

    def sums(rules: dict, full: bool):
        """Of both sides of each node: numbers, sums, and with `full` second moments."""
        order = sorted(rules)
        width = 1 + DIMENSIONS + (DIMENSIONS * DIMENSIONS if full else 0)

        def run(batches):
            out = np.zeros((len(order), 2, width), np.float32)
            place = {node: k for k, node in enumerate(order)}
            for b in batches:
                if not b.num_rows:
                    continue
                x = _read(b, 0)
                x = x[np.abs(x).sum(1) > 0]
                node = tree.node(x)
                by = np.argsort(node, kind="stable")
                x, node = x[by], node[by]
                at = runs(node)
                for i, j in zip(at, np.r_[at[1:], len(node)]):
                    k = place.get(int(node[i]))
                    if k is None:
                        continue
                    direction, bound = rules[order[k]]
                    left = x[i:j] @ direction >= bound
                    for side, own in ((0, x[i:j][left]), (1, x[i:j][~left])):
                        out[k, side, 0] += len(own)
                        out[k, side, 1 : 1 + DIMENSIONS] += own.sum(0)
                        if full:
                            out[k, side, 1 + DIMENSIONS :] += (own.T @ own).ravel()
            return out

        got = summed(vectors, run, (len(order), 2, width))
        return {node: [(s[0], s[1 : 1 + DIMENSIONS], s[1 + DIMENSIONS :].reshape(DIMENSIONS, DIMENSIONS) if full else None) for s in got[k]] for k, node in enumerate(order)}

    whole = sums({0: (np.zeros(DIMENSIONS, np.float32), 0.0)}, True)[0][0]
    pending = {0: _principal(*whole)} if whole[0] >= 2 * least else {}
    for level in range(levels):
        if not pending:
            break
        for r in range(rounds):
            last = r == rounds - 1
            got = sums({n: (d.astype(np.float32), b) for n, (d, b) in pending.items()}, last and level < levels - 1)
            if not last:
                for node, ((n0, a, _), (n1, b, _)) in got.items():
                    if n0 and n1 and np.linalg.norm(a) and np.linalg.norm(b):
                        pending[node] = a / np.linalg.norm(a) - b / np.linalg.norm(b), 0.0
        following: dict = {}
        for node, sides in got.items():
            if min(s[0] for s in sides) < 1:
                continue
            for child, (n, total, moments) in zip(tree.split(node, *pending[node]), sides):
                if n >= 2 * least and moments is not None:
                    following[child] = _principal(n, total, moments)
        pending = following
    return tree


def _with_vectors(words: DataFrame, seen: np.ndarray, basis: np.ndarray) -> DataFrame:
    """words with the vector of each document."""
    shared = words.sparkSession.sparkContext.broadcast((latent.weights(seen).astype(np.float32), basis.astype(np.float32)))  # SPACE x DIMENSIONS numbers

    def run(batches):
        idf, basis = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                p = b.slice(at, 500)
                text, feature, tf, texts = cells(*flat(p, 1), SPACE)
                out = np.zeros((texts, DIMENSIONS), np.float32)
                latent.placed(out, text, feature, tf, idf, basis, texts)
                out /= np.maximum(np.linalg.norm(out, axis=1), 1e-9)[:, None]
                yield pa.RecordBatch.from_arrays([*p.columns, pa.array([r.tobytes() for r in out.astype(np.float16)], pa.binary())], names=[*p.schema.names, "vector"])

    return words.mapInArrow(run, "id long, words array<int>, sizes array<int>, vector binary")


# ------------------------------------------------------------------- terms

_KEY = "key long, n long"


def _emit(keys: list):
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])


def _added(df: DataFrame) -> DataFrame:
    return df.groupBy("key").agg(F.sum("n").alias("n"))


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = df.toArrow()
    return got.column(0).to_numpy(), got.column(1).to_numpy()


def leaf_terms(rows: DataFrame, tree: Tree, work: Workspace) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The discriminative terms, the documents of each that each leaf has (terms x leaves), and the documents of the leaves.

    What comes to the driver is at most FEATURES x 2^LEVELS numbers, whatever the corpus; terms without a leaf of their
    own are left out where the sums are.
    """
    leaves = tree.leaves()
    k = int(leaves.max()) + 1

    def count(batches):
        keys, size = [], 0
        for b in batches:
            for at in range(0, b.num_rows, 500):
                p = b.slice(at, 500)
                leaf = leaves[tree.node(_read(p, 1))]
                text, feature, _, texts = cells(*flat(p, 0), FEATURES)
                keys += [feature * k + leaf[text], FEATURES * k + leaf]  # the last feature is of the documents
                size += len(text) + texts
                if size > 1 << 21:
                    yield _emit(keys)
                    keys, size = [], 0
        if keys:
            yield _emit(keys)

    table = work.keep(_added(rows.select("words", "vector").mapInArrow(count, _KEY)), "leaf_terms")
    key, n = _arrays(table.where(F.col("key") >= FEATURES * k))
    docs = np.zeros(k)
    docs[key - FEATURES * k] = n
    part = np.maximum(docs, 1e-9) / max(docs.sum(), 1)
    by_term = table.where(F.col("key") < FEATURES * k).select(F.floor(F.col("key") / k).alias("term"), (F.col("key") % k).cast("int").alias("leaf"), "n")
    parts = table.sparkSession.createDataFrame([(i, float(p)) for i, p in enumerate(part)], "leaf int, part double")
    seen = by_term.groupBy("term").agg(F.sum("n").alias("seen")).where(F.col("seen") >= LEAST_DOCS)
    expected = F.col("seen") * F.col("part")
    off = (F.col("n") - expected) / F.sqrt(expected * (1 - F.col("part")) + F.lit(1e-9))
    # Of one leaf, or of all together: leaves that hold none of a term's documents add what is expected of them.
    together = F.sum(off * off) + F.first("seen") * (1 - F.sum("part")) - k
    sure = F.greatest(F.max(off), together / math.sqrt(2 * k))
    found = by_term.join(seen, "term").join(F.broadcast(parts), "leaf").groupBy("term").agg(sure.alias("sure"), F.max(F.col("n") / expected).alias("lift"))  # parts: 2^LEVELS rows
    found = found.where((F.col("sure") >= SURE) & (F.col("lift") >= LIFT)).select("term")
    got = by_term.join(found, "term", "left_semi").toArrow()
    term, leaf, n = (got.column(c).to_numpy() for c in (0, 1, 2))
    terms, at = np.unique(term, return_inverse=True)
    counts = np.zeros((len(terms), k), np.float32)
    counts[at, leaf] = n
    return terms, counts, docs


def _odds(counts: np.ndarray, whole: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Log odds of each term in each group, against all groups: counts (terms x groups), the groups' sizes, all terms' rates."""
    return np.log((counts + SMOOTH * base[:, None]) / (whole[None] + SMOOTH) / base[:, None]).astype(np.float32)


def _posterior(score: np.ndarray, prior: np.ndarray) -> np.ndarray:
    p = score + prior
    p -= p.max(1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(1, keepdims=True)
    return p


class _Sentences:
    """The sentences of some documents and the discriminative terms that they hold: in one row a document, its terms' places end
    to end, the numbers of them in each sentence, and each sentence's leaf once it is placed."""

    def __init__(self, term: np.ndarray, hits: np.ndarray, per: np.ndarray, leaf: np.ndarray | None = None):
        self.count, self.docs, self.leaf, self.term = len(hits), len(per), leaf, term
        self.doc = np.repeat(np.arange(len(per)), per)
        self.sentence = np.repeat(np.arange(len(hits)), hits)
        self.starts, self.doc_starts = runs(self.sentence), runs(self.doc)

    @classmethod
    def read(cls, b) -> "_Sentences":
        hits, per = flat(b, 2)
        return cls(flat(b, 1)[0], hits, per, flat(b, 3)[0])

    def scores(self, odds: np.ndarray) -> np.ndarray:
        out = np.zeros((self.count, odds.shape[1]), np.float32)
        if len(self.term):
            out[self.sentence[self.starts]] = row_sums(odds, self.term, self.starts)
        return out

    def known(self, use: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros(self.count, bool)
        out[self.sentence if use is None else self.sentence[use[self.term]]] = True
        return out

    def of_docs(self, p: np.ndarray, groups: int) -> np.ndarray:
        out = np.zeros((self.docs, groups), np.float32)
        if self.count:
            out[self.doc[self.doc_starts]] = np.add.reduceat(p, self.doc_starts, axis=0)
        return out

    def prior(self, of_docs: np.ndarray, base: np.ndarray, weight: float) -> np.ndarray:
        return np.log((of_docs + weight * base) / (of_docs.sum(1, keepdims=True) + weight) + 1e-12)[self.doc]


def _pieces(batches, size: int = 500):
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


class Leaves:
    """The discriminative terms' log odds for each leaf, and the leaves' parts of all documents."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray):
        self.terms, self.size = terms, len(sizes)
        self.place = np.full(FEATURES, -1, np.int32)
        self.place[terms] = np.arange(len(terms))
        self.odds = _odds(counts, sizes, np.maximum(counts.sum(1), 1e-6) / max(sizes.sum(), 1))
        self.part = ((sizes + 1) / (sizes.sum() + self.size)).astype(np.float32)

    def likeliest(self, s: _Sentences) -> np.ndarray:
        """Each sentence's leaf, by its terms and by the leaves that the terms of its document's sentences say; -1 without terms."""
        score, known = s.scores(self.odds), s.known()
        score += np.log(self.part)
        first = s.doc * self.size + score.argmax(1)
        of_docs = np.bincount(first[known], minlength=s.docs * self.size).reshape(s.docs, self.size)
        # The leaves' parts are in both priors, so they are taken off again.
        score += (np.log((of_docs + LEAF_PRIOR * self.part) / (of_docs.sum(1, keepdims=True) + LEAF_PRIOR)) - np.log(self.part)).astype(np.float32)[s.doc]
        return np.where(known, score.argmax(1), -1).astype(np.int32)


def placed(rows: DataFrame, leaves: Leaves) -> DataFrame:
    """(id, terms, hits, leaf) of documents (id, words, sizes): what _Sentences.read reads."""
    shared = rows.sparkSession.sparkContext.broadcast(leaves)  # at most FEATURES x 2^LEVELS numbers

    def lists(counts, values):
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values.astype(np.int32)))

    def run(batches):
        model = shared.value
        for b in _pieces(batches, _DOCS_AT_ONCE):
            words, _ = flat(b, 1)
            sizes, per = flat(b, 2)
            term = model.place[words & (FEATURES - 1)]
            at = np.flatnonzero(term >= 0)
            sentence = np.repeat(np.arange(len(sizes)), sizes)[at]
            hits = np.bincount(sentence, minlength=len(sizes))
            s = _Sentences(term[at], hits, per)
            of_doc = np.bincount(s.doc, hits, minlength=len(per)) if s.count else np.zeros(len(per))
            yield pa.RecordBatch.from_arrays([b.column(0), lists(of_doc, s.term), lists(per, hits), lists(per, model.likeliest(s) if s.count else np.empty(0))], names=["id", "terms", "hits", "leaf"])

    return rows.select("id", "words", "sizes").mapInArrow(run, "id long, terms array<int>, hits array<int>, leaf array<int>")


def leaf_sentences(sentences: DataFrame, terms: int, leaves: int, labelled: np.ndarray) -> tuple[np.ndarray, ...]:
    """Counts of terms and of sentences by leaf, and (document, leaf, sentences) of the labelled documents, whose places in
    `labelled` (ascending ids) stand for them."""
    shared = sentences.sparkSession.sparkContext.broadcast(labelled)  # at most MOST_LABELLED ids

    def run(batches):
        ids, keys, size = shared.value, [], 0
        for b in _pieces(batches):
            s = _Sentences.read(b)
            known = s.leaf >= 0
            keys += [s.term.astype(np.int64) * leaves + s.leaf[s.sentence], terms * leaves + s.leaf[known]]
            if len(ids):
                mine = b.column(0).to_numpy()
                at = np.minimum(np.searchsorted(ids, mine), len(ids) - 1)
                has = known & (ids[at] == mine)[s.doc]
                keys.append((terms + 1 + at[s.doc[has]]) * leaves + s.leaf[has])
            size += len(s.term)
            if size > 1 << 21:
                yield _emit(keys)
                keys, size = [], 0
        if keys:
            yield _emit(keys)

    key, n = _arrays(_added(sentences.mapInArrow(run, _KEY)))
    row, leaf = key // leaves, key % leaves
    counts, sizes = np.zeros((terms, leaves), np.float32), np.zeros(leaves)
    at = row < terms
    counts[row[at], leaf[at]] = n[at]
    sizes[leaf[row == terms]] = n[row == terms]
    at = row > terms
    return counts, sizes, row[at] - terms - 1, leaf[at], n[at]


def mixtures(doc: np.ndarray, leaf: np.ndarray, part: np.ndarray, has: np.ndarray, leaves: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """leaves x (subjects and none), and the labelled sentences of each leaf. has: for each labelled document and subject
    whether it is named.

    A labelled document's sentences in a leaf are shared out over its subjects by the leaf's mixture, in turns. What a
    mixture has of a subject beyond what all labels have is the leaf's; the rest is of none.
    """
    has = has.astype(float)
    base = np.maximum(has.sum(0), 1e-9) / max(has.sum(), 1e-9)
    mix = np.tile(base, (leaves, 1))
    for _ in range(rounds):
        w = has[doc] * mix[leaf]
        w *= (part / np.maximum(w.sum(1), 1e-12))[:, None]
        count = np.stack([np.bincount(leaf, w[:, s], minlength=leaves) for s in range(has.shape[1])], 1)
        mix = (count + base) / (count.sum(1, keepdims=True) + 1)
    own = np.maximum(0, (mix - base) / np.maximum(1 - base, 1e-9))
    return np.hstack([own, np.maximum(0, 1 - own.sum(1, keepdims=True))]), count.sum(1)


class Model:
    """Subjects of leaves and, through them, of terms. counts: sentences of terms by leaf; sizes: of leaves; labelled: of
    leaves, in labelled documents."""

    def __init__(self, subjects: list[str], counts: np.ndarray, sizes: np.ndarray, mixture: np.ndarray, labelled: np.ndarray):
        self.subjects, self.mixture = subjects, mixture.astype(np.float32)
        self.told = (labelled / (labelled + 1)).astype(np.float32)  # how far labels say what a leaf is
        self.learn(counts.astype(float) @ (mixture * self.told[:, None]), sizes @ mixture)

    def learn(self, counts: np.ndarray, sizes: np.ndarray) -> None:
        """From counts of terms and sentences by subject (the last is none). Terms spread over subjects say nothing."""
        n = counts.sum(1)
        base = sizes / max(sizes.sum(), 1e-9)
        share = counts / np.maximum(n, 1e-9)[:, None]
        sure = (counts - n[:, None] * base) / np.sqrt(np.maximum(n[:, None] * base * (1 - base), 1e-9))
        self.use = ((share >= SHARE) & (sure >= SUBJECT_SURE)).any(1)
        self.odds = _odds(counts, sizes, np.maximum(n, 1e-6) / max(sizes.sum(), 1e-9)) * self.use[:, None].astype(np.float32)
        self.part = ((sizes + 1e-3) / (sizes + 1e-3).sum()).astype(np.float32)

    def posterior(self, s: _Sentences, learning: bool = False) -> np.ndarray:
        """Each sentence's subject, the last being none: by its terms and by the mixture of its document's leaves, and
        once more by its terms and by what that gives its document's sentences.

        A sentence of which no term speaks for a subject is of none. While learning, it is of its leaf's subjects, or, as
        far as no label says what its leaf is, of those of the company it keeps in its document.
        """
        n, none = len(self.part), np.eye(1, len(self.part), len(self.part) - 1, dtype=np.float32)
        known, score, silent = s.leaf >= 0, s.scores(self.odds), ~s.known(self.use)
        p = mixed = np.where(known[:, None], self.mixture[s.leaf], none)
        for _ in range(2):
            p = _posterior(score, s.prior(s.of_docs(p, n), self.part, SUBJECT_PRIOR))
            p[silent] = none
        if learning and silent.any():
            company = np.exp(s.prior(s.of_docs(p * ~silent[:, None], n), self.part, SUBJECT_PRIOR)[silent])
            told = self.told[s.leaf[silent], None]
            p[silent] = np.where(known[silent, None], told * mixed[silent] + (1 - told) * company, none)
        return p


def _by_subject(sentences: DataFrame, model: Model, bits: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of terms and of sentences by subject; a labelled document's sentences go to its subjects or to none but for UNNAMED."""
    t, n = len(model.odds), len(model.part)
    shared = sentences.sparkSession.sparkContext.broadcast((model, bits))  # at most FEATURES x subjects numbers and MOST_LABELLED labels

    def run(batches):
        model, bits = shared.value
        total = np.zeros((t + 1, n))
        for b in _pieces(batches):
            s = _Sentences.read(b)
            if not s.count:
                continue
            p = model.posterior(s, learning=True)
            said = [bits.get(i, 0) for i in b.column(0).to_pylist()]
            if any(said):
                allowed = np.array([[not d or d >> k & 1 for k in range(n - 1)] + [True] for d in said], np.float32)[s.doc]
                p *= allowed * (1 - UNNAMED) + UNNAMED
                p /= p.sum(1, keepdims=True)
                p[(np.array(said) != 0)[s.doc] & ~s.known(model.use)] *= LABELLED
            for k in range(n):
                total[:t, k] += np.bincount(s.term, p[s.sentence, k], minlength=t)
            total[t] += p.sum(0)
        return total

    out = summed(sentences, run, (t + 1, n), np.float32).astype(float)
    return out[:t], out[t]


def _assign(shared, least: float):
    def run(batches):
        model = shared.value
        n = len(model.part)
        for b in _pieces(batches):
            s = _Sentences.read(b)
            if not s.count:
                continue
            count = np.bincount(s.doc * n + model.posterior(s).argmax(1), minlength=s.docs * n).reshape(-1, n)
            sentences = count.sum(1)
            d, k = np.nonzero((count[:, :-1] >= least * sentences[:, None]) & (count[:, :-1] > 0))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), pa.array([model.subjects[j] for j in k], pa.string()), pa.array(count[d, k] / sentences[d])], names=["doc_id", "subject", "part"])

    return run


class Subjects:
    """A fitted model of a corpus. documents: (id, text); labels: (doc, subject); areas: (subject)."""

    def __init__(self, documents: DataFrame, labels: DataFrame, areas: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_doc: str = "doc_id", label_subject: str = "subject", area_subject: str = "subject"):
        self.work = Workspace(documents.sparkSession, "subjects")
        self.subjects, bits = labelled_subjects(labels, areas, label_doc, label_subject, area_subject)
        self.model = self.rows = None
        if not self.subjects or not bits:
            return
        words = self.work.keep(words_of(documents, id_col, text_col, by_sentence=True), "words")
        seen = latent.frequencies(words.select("words"), SPACE)
        basis = latent.fit(words.select("words"), seen, DIMENSIONS, spare=0)
        rows = self.work.keep(_with_vectors(words, seen, basis), "vectors")
        tree = cluster(rows.select("vector"))
        terms, counts, sizes = leaf_terms(rows, tree, self.work)
        if not len(terms):
            return
        self.rows = self.work.keep(placed(rows, Leaves(terms, counts, sizes)), "placed")
        labelled = np.array(sorted(bits), np.int64)
        counts, sizes, doc, leaf, part = leaf_sentences(self.rows, len(terms), len(sizes), labelled)
        has = np.array([[bits[i] >> k & 1 for k in range(len(self.subjects))] for i in labelled.tolist()])
        self.model = Model(self.subjects, counts, sizes, *mixtures(doc, leaf, part, has, len(sizes)))
        for _ in range(SUBJECT_PASSES - 1):
            self.model.learn(*_by_subject(self.rows, self.model, bits))

    def assign(self, least: float = LEAST_PART) -> DataFrame:
        """(doc_id, subject, part): subjects of at least that part of a document's sentences.

        Null ids and texts, and texts without a sentence, get no row; a row that comes twice counts once; without labels,
        subjects or discriminative terms nothing is assigned. See words.sentences for what is a sentence.
        """
        if not self.model:
            return self.work.spark.createDataFrame([], "doc_id long, subject string, part double")
        shared = self.work.spark.sparkContext.broadcast(self.model)  # at most FEATURES x subjects numbers
        found = self.rows.mapInArrow(_assign(shared, least), "doc_id long, subject string, part double")
        return found.groupBy("doc_id", "subject").agg(F.max("part").alias("part"))
