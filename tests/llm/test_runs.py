"""Periodic runs against a walk over every period and start."""

import random

import numpy as np
import pytest
from framelens.llm import runs


def brute(words, least=6, exponent=4):
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, exponent * q) and not any(a <= i and a + m >= i + length for a, m, p in out if p < q):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(8))
def test_random_words(seed):
    rng = random.Random(seed)
    docs = [[], [b"a"], [b"a"] * 500, [b"a", b"b"] * 3, [b"a", b"b", b"c", b"d"] * 9 + [b"a"]]
    for _ in range(40):
        d = []
        while len(d) < rng.randrange(1, 160):
            unit = [bytes([97 + rng.randrange(rng.choice((1, 2, 3, 20)))]) for _ in range(rng.randrange(1, 14))]
            d += unit * rng.choice((1, 1, 1, 3, 4, 5, 9))
            d = d[:len(d) - rng.randrange(0, 3)]
        docs.append(d)
    for d, found in zip(docs, runs.runs_of(docs)):
        assert [tuple(r) for r in found.tolist()] == brute(d)


def test_long_document_of_one_word_and_of_a_long_period():
    one, = runs.runs_of([[b"x"] * 200_000])
    assert one.tolist() == [[0, 200_000, 1]]
    unit = [str(i).encode() for i in range(5_000)]
    far, = runs.runs_of([[b"start", *unit * 5, b"end"]])
    assert far.tolist() == [[1, 25_000, 5_000]]


def test_rows_of_every_kind(spark):
    rows = [(1, None, "k", 1), (2, "", "k", 2), (2, "go " * 9 + "home", "k", 3), (2, "go " * 9 + "home", "k", 3), (None, "a b a b a b a b\tz", None, 4), (5, "no\truns  here", "k", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, h_ int")
    got = {tuple(r) for r in runs.collapsed(docs).collect()}
    assert got == {(1, None, "k", 1), (2, "", "k", 2), (2, "go home", "k", 3), (None, "a b z", None, 4), (5, "no\truns  here", "k", 5)}
    assert runs.collapsed(docs).count() == 6 and runs.collapsed(docs).columns == docs.columns
    assert runs.with_runs(docs.limit(0)).collect() == []
    listed = {r.row.h_: [tuple(x) for x in r.runs] for r in runs.with_runs(docs).collect()}
    assert listed == {1: [], 2: [], 3: [(0, 9, 1)], 4: [(0, 8, 2)], 5: []}


def test_tandem_tail():
    words = [str(i).encode() for i in range(40)]
    h = next(h for h in range(0, 10_000, 10) if h // 10 == 47)
    tail = runs._tandem(words, h)
    p = 1 + 33 // (3 + 7)
    assert tail[:7] == words[:7] and tail[7:] == [words[7 + i % p] for i in range(33)]
    assert runs._tandem(words, h + 1) == words and runs._tandem([], h) == []
    assert np.array_equal(runs.runs_of([tail])[0], [[7, 33, 4]])
