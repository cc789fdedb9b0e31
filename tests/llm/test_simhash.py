"""SimHash groups against all pairs; bit-sliced distances against counting; defined cases."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from framelens.llm import simhash as S

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    fps = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[k:k + 4]) for k in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        fps[i] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    ids = sorted(fps)
    root = {i: i for i in ids}
    arr = np.array([fps[i] for i in ids], np.uint64)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(arr[k + 1:] ^ arr[k]) <= 4):
            a, b = find(i), find(ids[k + 1 + j])
            root[max(a, b)] = min(a, b)
    return {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def test_whole_table_against_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op2_simhash(spark, sf).collect()}
    assert got == brute(rows)
    assert len({c for _, c in got.values()}) < len(got)


def test_dense_group_of_many_chunks(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = {int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), replace=False)) for b in np.repeat(base, 900)}
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 500, dtype=np.uint64)}
    arr = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(f), n) for n, f in enumerate(arr.view(np.int64))], "fp long, node long")
    from framelens.llm.common import Scratch, components
    scratch = Scratch(spark)
    got = {r.node: r.root for r in components(S.links(df, chunk=100), scratch, df.count()).collect()}
    root = np.arange(len(arr))
    while True:
        new = np.array([root[np.bitwise_count(arr ^ f) <= 4].min() for f in arr])
        if (new == root).all():
            break
        root = new
    assert {i: got.get(i, i) for i in range(len(arr))} == dict(enumerate(root.tolist()))


@pytest.mark.parametrize("radius", [1, 3, 4, 6])
def test_lanes_within_counts_bits(radius):
    rng = np.random.default_rng(radius)
    fps = np.array([sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 12), replace=False)) for _ in range(203)], np.uint64)
    p = S.planes(fps)
    near = S._bits(S.lanes_within(lambda b: p[b].copy(), p.shape[1:], len(fps), radius), len(fps))
    assert near.tolist() == np.flatnonzero(np.bitwise_count(fps) <= radius).tolist()


def test_defined_cases(spark):
    rows = [(3, None), (1, ""), (2, " \t\n"), (4, "one"), (5, "ONE"), (5, "ONE"), (None, "one"), (6, "word " * 30000)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC).selectExpr("*", "'x' AS component_id", "1 AS fp", "2 AS key")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect()), key=str)
    assert [(i, c) for i, _, c in got] == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (6, 6), (None, None)]
    assert all(f == "0" * 16 for i, f, _ in got if i in (1, 2, 3))
    assert sorted(r.doc_id or 0 for r in S.one_per_group(df).collect()) == [0, 1, 4, 6]
    assert S.near_duplicates(df.where("false")).count() == 0


def test_likeness_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for i in range(60):  # copies with more and more words changed: some links at 0.8 lie far beyond four bits
        base = rng.choice(words, 200)
        for share in (0, 1, 2, 4, 6, 12):
            text = base.copy()
            text[rng.choice(200, share, replace=False)] = rng.choice(words, share)
            rows.append((len(rows) + 1, " ".join(text)))
    grams = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    root = {i: i for i in grams}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    direct = 0
    for i in grams:
        for j in range(i + 1, len(rows) + 1):
            if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                direct += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC)
    got = {r.doc_id for r in S.one_per_likeness(docs).collect()}
    assert direct and got == {i for i in grams if find(i) == i}
    assert got < {r.doc_id for r in S.one_per_group(docs).collect()}


def test_family_of_near_copies_gives_few_links(spark, monkeypatch):
    """Texts that are all between 0.8 and 0.9 alike: links grow with the texts, not with their pairs, and fingerprints find some of them."""
    n, rng = 300, random.Random(5)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(150)]
    rows = [(i, " ".join(f"x{i}" if k == 5 + i % 140 else w for k, w in enumerate(base)), None, None, None) for i in range(n)]
    counts, by_fingerprint = [], []
    whole, found = S.components, getattr(S, "fingerprint_links", None)

    def counted(edges, scratch, nodes):
        counts.append(edges.count())
        return whole(edges, scratch, nodes)

    def seen(sets):
        by_fingerprint.append(found(sets).count())
        return found(sets)

    monkeypatch.setattr(S, "components", counted)
    monkeypatch.setattr(S, "fingerprint_links", seen, raising=False)
    assert [r.doc_id for r in S.one_per_likeness(spark.createDataFrame(rows, DOC)).collect()] == [0]
    assert sum(counts) < 30 * n and sum(by_fingerprint) > 0


def test_a_row_meets_one_head_once():
    sig = np.tile(np.arange(S.BANDS * S.BAND, dtype=np.uint8), (4, 1))
    sig[3, :5] = 255  # shares every band but the first
    pairs = [(int(b), int(a)) for band in range(S.BANDS) for a, b in zip(*(np.concatenate(x) for x in S.head_pairs(sig[[0, 1, 2] if band == 0 else [0, 1, 2, 3]], np.arange(4), band, np.arange(4))))]
    assert sorted(pairs) == [(0, 1), (0, 2), (0, 3)]


def test_family_without_links_gives_no_pairs(spark, monkeypatch):
    """Texts that are nearly all at 0.65 to 0.8 of each other: no table of the stage holds their pairs, and the few links are found."""
    n, rng = 300, random.Random(9)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for i in range(n):
        words = base.copy()
        for k in rng.sample(range(200), 3):
            words[k] = f"x{i}"
        texts.append(" ".join(words))
    grams = [{tuple(w[k:k + 5]) for k in range(196)} for w in map(str.split, texts)]
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    written, keep = [], S.Scratch.keep

    def counted(self, df, rows=None):
        out = keep(self, df, rows)
        written.append(out.count())
        return out

    monkeypatch.setattr(S.Scratch, "keep", counted)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOC)
    assert {r.doc_id for r in S.one_per_likeness(docs).collect()} == set(root) and 1 < len(set(root)) < n
    assert max(written) <= S.BANDS * n


def test_workers_give_back_what_they_freed():
    from framelens.llm import common
    size = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGESIZE")

    def batches():
        for _ in range(2):
            held = [np.ones(4000 + k % 7, np.uint8) for k in range(40_000)]  # small arrays come from the heap, not from Arrow
            held = held[-1:]
            yield pa.record_batch([pa.array([len(held[0])])], ["n"])
            if _:
                after.append(size())

    before, after = size(), []
    list(common.tidy(lambda given: given)(batches()))
    assert after[-1] - before < 60e6
