"""Counts and base score against plain arithmetic, gradients against differences, proper probabilities, defined cases."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from framelens.llm import gru
from framelens.llm import lm as M


def plain(rows, held):
    toks = {k: (t or "").encode().lower().split() for k, (_, t) in enumerate(rows)}
    c = Counter()
    for k, (i, _) in enumerate(rows):
        if not held(i):
            c.update([*toks[k], None])
    n, v = sum(c.values()), len(c)
    return n, {k: (len(t) + 1, sum(c[w] > 0 for w in [*t, None]), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*t, None])) for k, t in toks.items()}


@pytest.mark.parametrize("head", [M.HEAD, 700])
def test_whole_table(spark, sf, head):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    n, want = plain(rows, held)
    want = {i: w for (i, _), w in zip(rows, want.values())}
    got = M.score(docs, M.held_out_sql(10), head=head).collect()
    assert len(got) == len(rows)
    for r in got:
        a, b, c = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (a, b, n, held(r.doc_id))
        assert math.isclose(r.base_score, c, rel_tol=1e-9)
    held_rows = [r for r in got if r.held_out]
    assert sum(r.score for r in held_rows) > sum(r.base_score for r in held_rows)


def model(seed=0):
    rng = np.random.default_rng(seed)
    p = gru.start(rng, 12, 5, np.log(rng.dirichlet(np.ones(4))), np.log(rng.dirichlet(np.ones(3), 3)))
    return rng, {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in p.items()}


def test_gradients_against_differences():
    rng, p = model()
    x, cls, place = rng.integers(0, 12, (6, 3)), rng.integers(0, 4, (6, 3)), rng.integers(0, 3, (6, 3))
    mask = np.ones((6, 3), bool)
    mask[4:, 1] = mask[2:, 2] = False
    h0 = rng.normal(0, 0.5, (3, 5))
    loss, g, _ = gru.gradients(p, x, cls, place, mask, h0)
    for name, v in p.items():
        for at in {tuple(rng.integers(0, s) for s in v.shape) for _ in range(8)}:
            keep = v[at]
            v[at] = keep + 1e-5
            up = gru.gradients(p, x, cls, place, mask, h0)[0]
            v[at] = keep - 1e-5
            down = gru.gradients(p, x, cls, place, mask, h0)[0]
            v[at] = keep
            assert math.isclose((up - down) / 2e-5, g[name][at], rel_tol=1e-4, abs_tol=1e-6)


def test_probabilities_sum_to_one_and_state_is_carried():
    rng, p = model(1)
    h = rng.normal(0, 1, (1, 5))
    targets = [(c, w) for c in range(3) for w in range(3)] + [(3, 0)]
    total = sum(math.exp(gru.log_probability(p, h, np.array([c]), np.array([w]))[0]) for c, w in targets)
    assert math.isclose(total, 1, rel_tol=1e-9)
    texts = [tuple(rng.integers(0, m, n) for m in (12, 4, 3)) for n in (1, 40, 7, 7, 100)]
    whole = gru.score_texts(p, texts)
    assert np.allclose(whole, gru.score_texts(p, texts, rows=5), rtol=1e-6)
    for t, s in zip(texts, whole):
        state, plain = np.zeros((1, 5)), 0.0
        for a, b, c in zip(*t):
            state = gru.step(p, p["x"][[a]], state)[4]
            plain += gru.log_probability(p, state, np.array([b]), np.array([c]))[0]
        assert math.isclose(plain, s, rel_tol=1e-4)


def test_defined_cases(spark):
    rows = [(1, "a b c a"), (2, None), (3, ""), (None, "a zz"), (4, "tail words here"), (4, "tail words here"), (5, "A B " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS c", "'x' AS word", "2 AS key", "true AS held_out")
    n, want = plain(rows, lambda i: i == 1)
    got = M.score(df, "coalesce(doc_id = 1, false)", head=1).collect()
    for r in got:
        k = next(k for k, (i, _) in enumerate(rows) if i == r.doc_id)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (*want[k][:2], n) and math.isclose(r.base_score, want[k][2], rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert len(got) == 7
    assert M.score(df.where("false"), "false").count() == 0
    assert {r.n_known for r in M.score(df, "true").collect()} == {0}


def test_network_learns_from_every_training_document(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_BYTES", 1500)  # of texts of five bytes
    docs = spark.range(1500).selectExpr("id AS doc_id", "concat('w', id % 7, ' w', id % 5) AS text")
    seen = spark.sparkContext.accumulator(0)
    shards = spark.sparkContext.accumulator(0)
    plain_epoch = gru.train_epoch

    def epoch(p, texts, rate):
        seen.add(len(texts))
        shards.add(1)
        return plain_epoch(p, texts, rate)
    words = [f"w{k}".encode() for k in range(7)]
    vocab = M.Vocabulary(words, np.full(7, 400.0), 1500, np.full(M.RARE, M.ALPHA))
    # the learner's module travels by value, so its name for the pass is set where the task looks it up
    monkeypatch.setattr(M, "gru", type("Gru", (), {"start": staticmethod(gru.start), "train_epoch": staticmethod(epoch)}))
    p = M.train(docs, vocab, rounds=2)
    assert seen.value == 2 * 1500 and shards.value == 2 * 5
    assert all(np.isfinite(v).all() and v.dtype == np.float32 for v in p.values())


def test_texts_read_together_equal_texts_read_alone():
    texts = [b"a b tail".split(), [], b"b unknown b".split(), [], b"a".split()]
    vocab = M.Vocabulary([b"b", b"a", b"tail"], np.array([5.0, 3.0, 1.0]), 4, np.full(M.RARE, 2.0))
    words, head, model, n = vocab.read_texts(texts)
    assert words == sum(texts, []) and n.tolist() == [4, 1, 4, 1, 2] and (head >= 0).tolist() == [w != b"unknown" for w in words]
    parts = zip(*(np.split(x, np.cumsum(n)[:-1]) for x in vocab.sequence(model)))
    for text, got in zip(texts, parts):
        assert all((x == y).all() for x, y in zip(got, vocab.sequence(vocab.read(text)[0])))


def test_rare_classes_of_counts_are_those_of_the_words(spark):
    docs = spark.createDataFrame([("a bc def ghij ä äöü xß a",), (None,)], "text string")
    got = {bytes(r.word): (r.rare, r.c) for r in M.word_counts(docs).collect()}
    assert len(got) == 7 and got == {w: (M.rare_class(w), 2 if w == b"a" else 1) for w in got}
