import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftsieve.llm.elias_fano import EliasFano, mix64
from driftsieve.llm.signatures import band_keys, fingerprints, minima, pivot_distances
from driftsieve.llm.textforms import canonical, plain_form, record_key, window_hashes
from driftsieve.llm.words import word_hashes


@pytest.mark.parametrize(
    "disguised, plain",
    [
        ("Ｆｕｌｌ　ｗｉｄｔｈ！", "Full width!"),
        ("café niño", "café niño"),
        ("zero​width⁠ so­ft﻿", "zerowidth soft"),
        ("a b c d", "a b c d"),
        ("Ρаul ѕаw оnе bіg сat nеаr Lоndоn", "Paul saw one big cat near London"),
        ("Еn 2044, Мօnttօurném օbѕеrvа l'étuԁе", "En 2044, Monttourném observa l'étude"),
        ("собака и кoшкa живyт в дoмe", "собака и кошка живут в доме"),
        ("йод ёлка большой", "йод ёлка большой"),
        ("tabs\tand\nlines  stay", "tabs\tand\nlines  stay"),
        ("", ""),
        (None, ""),
        ("123 — !?", "123 — !?"),
    ],
)
def test_plain_form(disguised, plain):
    assert plain_form(disguised) == plain
    assert plain_form(plain) == plain


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_plain_form_settles(text):
    once = plain_form(text)
    assert plain_form(plain_form(once)) == plain_form(once)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_canonical(text):
    want = " ".join("".join(c if c.isalnum() else " " if c.isspace() else "" for c in text.casefold()).split())
    assert canonical(text.replace("\U0010ffff", "")) == want


def test_records():
    a = "title: X y | place: Z | year: 1"
    assert record_key(a) == record_key("Year: 1;\nPLACE: z;\ntitle: x-Y") != record_key("title: Z | place: X y | year: 1")
    assert record_key("no record; only: prose, he said: well") is None and record_key("a: b | c: d") is None


def test_windows():
    texts = ["abcdefghijklmnopqrstuvwxyz" * 2, "short", "x" * 20]
    h, starts, counts = window_hashes(texts, 20)
    assert counts.tolist() == [33, 1, 1]
    for t, s, n in zip(texts, starts, counts):
        for i in range(n):
            one, _, _ = window_hashes([t[i : i + 20]], 20)
            assert one[0] == h[s + i]
    for width in (1, 2, 3, 7, 20, 33):
        h, starts, counts = window_hashes(["abcabcabcabcabcabcabcabcabcabcabcabcabcabc"], width)
        assert len(set(h[: counts[0]].tolist())) == min(3, counts[0])


def test_word_hashes():
    h, n = word_hashes(["a bb a", "", "bb"])
    assert n.tolist() == [3, 0, 1] and h[0] == h[2] and h[1] == h[3] != h[0]


def test_signatures_follow_similarity():
    rng = np.random.default_rng(1)
    base = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 4000))
    texts = [base, base[:2000] + "X" + base[2001:], "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 4000))]
    m = minima(texts)
    assert (m[0] == m[1]).mean() > 0.9 and (m[0] == m[2]).mean() < 0.1
    k = band_keys(m)
    assert (k[0] == k[1]).any() and not (k[0] == k[2]).any()
    d = pivot_distances(fingerprints(m)).astype(int)
    bits = fingerprints(m)
    for a in range(3):
        for b in range(3):
            assert abs(d[a] - d[b]).max() <= (bits[a] != bits[b]).sum()


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, (1 << 64) - 1), max_size=300), st.sets(st.integers(0, (1 << 64) - 1), max_size=100))
def test_elias_fano(keys, more):
    k, q = np.array(sorted(keys), np.uint64), np.array(sorted(keys | more | {0, (1 << 64) - 1}), np.uint64)
    e = EliasFano(k)
    assert (e.decode() == k).all()
    again = EliasFano.from_bytes(e.to_bytes())
    assert (again.decode() == k).all() and (again.contains(q) == np.isin(q, k)).all()
    assert (e.contains(q) == np.isin(q, k)).all() and (e.rank(q) == np.searchsorted(k, q)).all()
    new = np.setdiff1d(q, k)
    assert (e.merged(new).decode() == np.union1d(k, q)).all()


def test_mix64_is_a_bijection():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(mix64(x))) == len(x)
