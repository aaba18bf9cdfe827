"""Latent semantic vectors of hashed words: a randomised SVD of TF-IDF texts, every pass of it distributed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from driftsieve.llm.words import flat, summed


def cells(words: np.ndarray, sizes: np.ndarray, features: int, passage: int | None = None):
    """(text, feature, count), one for each pair, and the number of texts: whole texts of these sizes, or their
    consecutive passages of so many words."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    count = len(sizes)
    if passage:
        place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first = np.concatenate(([0], np.cumsum(-(-sizes // passage))))
        doc, count = first[doc] + place // passage, int(first[-1])
    cell, n = np.unique(doc * features + (words & (features - 1)), return_counts=True)
    return cell // features, cell % features, n, count


def parts(batches, column: int = 0, size: int = 500):
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield flat(b.slice(at, size), column)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.empty(0, np.int64)


def row_sums(table: np.ndarray, index: np.ndarray, starts: np.ndarray, scale: np.ndarray | None = None) -> np.ndarray:
    """The sums of table[index] (times scale) over runs that begin at `starts`: the k-th row of all runs at a time, which for
    wide rows is several times as fast as numpy's own sums over runs; what is left of a few long runs at once."""
    counts = np.diff(np.r_[starts, len(index)])

    def rows(at):
        return table[index[at]] if scale is None else table[index[at]] * scale[at, None]

    out, k = rows(starts), 1
    open_ = np.flatnonzero(counts > 1)
    while len(open_) > 8:
        out[open_] += rows(starts[open_] + k)
        k += 1
        open_ = open_[counts[open_] > k]
    for i in open_.tolist():
        out[i] += rows(np.arange(starts[i] + k, starts[i] + counts[i])).sum(0)
    return out


def frequencies(words: DataFrame, features: int, passage: int | None = None) -> np.ndarray:
    """Texts that hold each feature; the last number is of all texts. words: (words array<int>)."""

    def count(batches):
        total = np.zeros(features + 1)
        for w, n in parts(batches):
            if len(w):
                _, feature, _, texts = cells(w, n, features, passage)
                total[:features] += np.bincount(feature, minlength=features)
                total[features] += texts
        return total

    return summed(words, count, (features + 1,))


def weights(seen: np.ndarray) -> np.ndarray:
    """Inverse document frequencies."""
    return np.log((seen[-1] + 1) / (seen[:-1] + 1))


def placed(values: np.ndarray, text: np.ndarray, feature: np.ndarray, tf: np.ndarray, idf: np.ndarray, basis: np.ndarray, texts: int):
    """Each text's unit TF-IDF vector times the basis, and the cells' values in those unit vectors."""
    value = (np.sqrt(tf) * idf[feature]).astype(np.float32)
    norm = np.sqrt(np.bincount(text, value * value, minlength=texts))
    value /= np.maximum(norm, 1e-9)[text].astype(np.float32)
    at = runs(text)
    if len(at):
        values[text[at]] = row_sums(basis, feature, at, value)
    return value


def fit(words: DataFrame, seen: np.ndarray, rank: int, spare: int = 8, passage: int | None = None, seed: int = 7) -> np.ndarray:
    """The first right singular vectors, features x rank, of the texts' unit TF-IDF vectors; two passes. Without spare
    columns, a basis of the space that they span but for the last of them, in one pass.

    seen: frequencies(words). What moves and what the driver holds is features x (rank + spare), whatever the corpus.
    """
    features, idf = len(seen) - 1, weights(seen).astype(np.float32)

    def multiply(basis: np.ndarray) -> np.ndarray:
        wide, m = basis.astype(np.float32), basis.shape[1]

        def run(batches):
            total = np.zeros((features, m), np.float32)
            for w, n in parts(batches):
                if not len(w):
                    continue
                text, feature, tf, texts = cells(w, n, features, passage)
                down = np.zeros((texts, m), np.float32)
                value = placed(down, text, feature, tf, idf, wide, texts)
                order = np.argsort(feature, kind="stable")
                f = feature[order]
                at = runs(f)
                total[f[at]] += row_sums(down, text[order], at, value[order])
            return total

        return summed(words, run, (features, m), np.float32).astype(np.float64)

    start = np.random.default_rng(seed).standard_normal((features, rank + spare))
    q, _ = np.linalg.qr(multiply(start))
    if not spare:
        return q
    again = multiply(q)
    _, turn = np.linalg.eigh((q.T @ again + again.T @ q) / 2)
    return (q @ turn)[:, ::-1][:, :rank]
