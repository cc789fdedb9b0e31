"""Removed words against a plain walk, hashes against plain ones, defined cases."""

import hashlib

import numpy as np
from framelens.llm import substrings as P


def plain(rows, window):
    """n_words, n_removed and kept words of each row by looking at every window."""
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k:k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, **kw):
    return sorted(((r.row.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in P.without_spans(df, P.repeated_spans(df, **kw)).collect()), key=str)


def test_small_windows_over_few_words(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), " ".join(rng.choice(list("abc"), rng.integers(0, 40)))) for i in rng.permutation(60)]
    rows += [(100 + k, rows[k][1]) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window, kmer in ((6, 3), (5, 5), (9, 2)):
        assert got(df, window=window, kmer=kmer) == plain(rows, window)


def test_hashes_depend_on_the_words_alone():
    h = P.WindowHashes(4, 2)
    words, counts = h.split([b"a b c d e", b"", b"  x\ta b\nc d e "])
    assert counts.tolist() == [5, 0, 6] and words[:5].tolist() == words[6:].tolist() and len(set(words.tolist())) == 6
    at, low = h.minimisers(words, counts)
    edges = h.edges(words, at)
    assert at.tolist() == [0, 1, 5, 6, 7] and edges[:2].tolist() == edges[3:].tolist() and low[:2].tolist() == low[3:].tolist()


def test_defined_cases(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(5, passage), (7, "start " + passage + " end"), (7, "start " + passage + " end"), (7, passage + " tail"), (None, passage), (9, None), (10, ""), (11, " ".join(["same"] * 30000)), (12, "same " * 60), (3, " ".join(f"w{i}" for i in range(49)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS row", "1 AS first", "2 AS tkey", "3 AS n_words")
    assert got(df) == plain(rows, 50)
    out = P.deduplicated(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert {r.text for r in out.where("doc_id = 7").collect()} == {"start end", "tail"} and {r.text for r in out.where("doc_id IN (5, 9)").collect()} == {passage, None}
    assert P.deduplicated(df.where("false")).count() == 0


def test_ids_that_stand_alone_move_no_text_key(spark, monkeypatch):
    """Texts are told apart by a digest only where rows share a doc_id; profiles are gone before spans are made."""
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, "x " + text), (3, "y " + text), (3, "z " + text), (None, text)], "doc_id long, text string")
    held, keep = [], P.Scratch.keep

    def seen(self, df, rows=None):
        out = keep(self, df, rows)
        held.append((set(out.columns), [set(t.columns) for t, _ in self.paths.values()], out))
        return out

    monkeypatch.setattr(P.Scratch, "keep", seen)
    spans = P.repeated_spans(docs)
    keys = {(r.doc_id, r.tkey) for r in spans.collect()}
    assert {i for i, _ in keys} == {2, 3} and len(keys) == 3 and (2, 0) in keys and (3, 0) not in keys
    assert not any("mins" in t for t in held[-1][1])
    got = {(r.row.doc_id, r.text.split()[0], r.n_removed) for r in P.without_spans(docs, spans).collect()}
    assert got == {(1, "w0", 0), (2, "x", 60), (3, "y", 60), (3, "z", 60), (None, "w0", 0)}
