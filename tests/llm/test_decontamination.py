"""Benchmark windows against comparisons at every place."""

import random

import pytest
from framelens.llm import decontamination as dc


def brute(words, items, window):
    hit, names = set(), set()
    for item, own in items:
        n = min(window, len(own))
        for a in range(len(own) - n + 1 if own else 0):
            for i in range(len(words) - n + 1):
                if words[i:i + n] == own[a:a + n]:
                    hit |= set(range(i, i + n))
                    names.add(item)
    return hit, names - {None}


@pytest.mark.parametrize("seed", range(6))
def test_random_words(seed):
    rng = random.Random(seed)
    word = lambda k: bytes([97 + rng.randrange(k)])
    items = [(str(i), [word(3) for _ in range(rng.randrange(0, 14))]) for i in range(12)] + [(None, [word(3) for _ in range(6)])]
    automaton = dc.SuffixAutomaton([(i, True, w) for i, w in items], 5)
    for _ in range(60):
        words = [word(rng.choice((3, 4))) for _ in range(rng.randrange(0, 60))]
        spans, names = automaton.occurrences(words)
        hit, expected = brute(words, items, 5)
        assert {x for a, b in spans for x in range(a, b + 1)} == hit and names == expected
        assert all(y[0] > x[1] + 1 for x, y in zip(spans, spans[1:]))


def test_many_blocks_give_the_rows_of_one(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.select("doc_id", "text")
    shape = lambda: sorted(map(str, dc.with_occurrences(docs, items).select("row.doc_id", "n_words", "spans", "items").collect()))
    one = shape()
    assert any("first=" in r for r in one)
    monkeypatch.setattr(dc, "BLOCK", 600)
    monkeypatch.setattr(dc, "PIECE", 16)
    assert shape() == one


def test_rows_of_every_kind(spark):
    items = spark.createDataFrame([(1, "One TWO three four five six seven eight nine ten eleven"), (2, "tiny item"), (2, "tiny item"), (None, "zeta eta"), (3, None), (4, " .,")],
                                  "item_id long, text string")
    text = "x one two three, four five six seven eight nine ten\nend"
    rows = [(1, None, "a"), (2, "", "a"), (3, text, "b"), (3, text, "b"), (None, "A tiny-ITEM, here and nothing else at all", "c"), (5, "zeta eta", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = [(r.row.doc_id, r.n_words, [tuple(s) for s in r.spans], r.items) for r in dc.with_occurrences(docs, items).collect()]
    expected = [(1, 0, [], []), (2, 0, [], []), (3, 12, [(1, 10)], ["1"]), (3, 12, [(1, 10)], ["1"]), (None, 9, [(1, 2)], ["2"]), (5, 2, [(0, 1)], [])]
    assert sorted(got, key=str) == sorted(expected, key=str)
    cut = {tuple(r) for r in dc.decontaminated(docs, items, longest=2, coverage=0.9).collect()}
    assert cut == {(1, None, "a"), (2, "", "a"), (3, "x \nend", "b"), (None, "A , here and nothing else at all", "c")}
    assert {r.doc_id for r in dc.decontaminated(docs, items).collect()} == {1, 2, None}
    assert dc.with_occurrences(docs, items.limit(0)).where("size(spans) > 0").count() == 0
    assert dc.with_occurrences(docs, items.limit(0)).agg({"n_words": "sum"}).first()[0] == 35
    assert dc.with_occurrences(docs.limit(0), items).collect() == []
