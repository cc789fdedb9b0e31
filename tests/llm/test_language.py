"""Code lengths against a plain escape walk, held-out accuracy, defined cases."""

from collections import Counter
from math import log2

import numpy as np
from framelens.llm import language as L

HELD = "crc32(CAST(doc_id AS STRING)) % 3 = 1"


def plain_length(train: bytes, text: bytes) -> float:
    """Bits of ``text`` after counting ``train``: one byte and one escape at a time."""
    counts: dict[bytes, Counter] = {}
    data = L.PAD + train
    for i in range(3, len(data)):
        for k in range(4):
            counts.setdefault(data[i - k:i], Counter())[data[i]] += 1
    bits, data = 0.0, L.PAD + text
    for i in range(3, len(data)):
        for k in (3, 2, 1, 0):
            seen = counts.get(data[i - k:i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if data[i] in seen:
                bits -= log2(seen[data[i]] / (n + d))
                break
            bits -= log2(d / (n + d))
        else:
            bits += 8
    return bits


def test_code_lengths_against_plain_walk():
    rng = np.random.default_rng(3)
    corpora = [b"the cat sat on the mat. " * 5, "der hübsche hühnerstall ".encode() * 4, bytes(rng.integers(0, 256, 400, dtype=np.uint8))]
    lang, key, n = [], [], []
    for i, c in enumerate(corpora):
        k, m = np.unique(L.grams(c), return_counts=True)
        lang += [i] * len(k)
        key += k.tolist()
        n += m.tolist()
    trees = L.ContextTrees(["a", "b", "c"], np.array(lang), np.array(key), np.array(n))
    texts = [b"the mat", "ein hübsches übel 日".encode(), bytes(rng.integers(0, 256, 90, dtype=np.uint8)), b"\x00", b"zq"]
    want = [[plain_length(c, t) for c in corpora] for t in texts]
    assert np.allclose(trees.code_lengths(texts), want)


def test_slots_find_all_and_only_known():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 32, 5000, dtype=np.uint64)).astype(np.uint32)
    slots = L.Slots(keys)
    assert (slots.find(keys) == np.arange(len(keys))).all()
    assert (slots.find(np.setdiff1d(np.arange(10000, dtype=np.uint32), keys)) == -1).all()


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = L.op8_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and held and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95


def test_labels_of_held_out_rows_do_not_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    other = docs.selectExpr("doc_id", f"IF({HELD}, 'xx', lang) AS lang", "text")
    a = L.predict(docs, L.train(docs, HELD), HELD).collect()
    b = L.predict(docs, L.train(other, HELD), HELD).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_defined_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (4, None, "en"), (5, "", "en"), (None, "12 34 !?", None), (6, "the dog " * 20000, None), (6, "the dog", None), (7, "x", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'x' AS lang_pred", "true AS held_out")
    got = [(r.doc_id, r.lang_pred) for r in L.predict(df, L.train(df, "false"), "false").collect()]
    assert got == [(1, "en"), (2, "de"), (4, "und"), (5, "und"), (None, "und"), (6, "en"), (6, "en"), (7, "en")]
    assert {r.lang_pred for r in L.predict(df, L.train(df.where("false"), "false"), "false").collect()} == {"und"}
    assert L.predict(df.where("false"), None, "false").count() == 0


def test_languages_over_several_tables(spark):
    words = {f"l{k}": [chr(97 + (7 * k + 3 * j) % 26) * (1 + j % 2) for j in range(6)] for k in range(7)}
    df = spark.createDataFrame([(10 * k + n, lang, " ".join(w[(n + i) % 6] for i in range(12))) for k, (lang, w) in enumerate(words.items()) for n in range(6)],
                               "doc_id long, lang string, text string")
    one, many = L.train(df, "false"), L.train(df, "false", languages=2)
    assert len(one) == 1 and len(many) == 4
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in L.predict(df, t, "false").collect()} for t in (one, many))
    truth = {r.doc_id: r.lang for r in df.collect()}
    assert {i: x[0] for i, x in a.items()} == {i: x[0] for i, x in b.items()} == truth
    assert all(0 < b[i][1] <= 1 for i in b)
