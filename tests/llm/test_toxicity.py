"""Nearest examples against all of them, held-out quality, what a score may read, defined cases."""

import numpy as np
import pytest
from framelens.llm import toxicity as T

SF = "/root/testdata/sf0.1"  # smaller tables have too few toxic labels to measure with


def test_nearest_equals_all_examples():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(700):
        terms = sorted(rng.choice(60, rng.integers(1, 6), replace=False).tolist())
        w = rng.integers(1, 4, len(terms)).astype(float)
        vectors.append((terms, w / np.linalg.norm(w)))
    index = T.BlockMaxIndex(vectors, 60, block=16)
    dense = np.zeros((700, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for q in range(0, 700, 7):
        terms, w = vectors[q]
        cos = dense[:, terms] @ w
        want = sorted(((c, i) for i, c in enumerate(cos) if c > 0), key=lambda x: (-round(x[0], 9), x[1]))[:10]
        got = index.nearest(terms, w, 10)
        assert np.allclose([c for c, _ in got], [c for c, _ in want])
        assert {i for c, i in got if c > got[-1][0] + 1e-9} == {i for c, i in want if c > want[-1][0] + 1e-9}


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels, T.score(docs, labels, T.held_out_sql(5)).cache()


def test_held_out_quality(scored):
    docs, labels, got = scored
    rows = got.join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic == 1]
    assert got.count() == docs.count() and toxic
    assert sum(r.predicted for r in toxic) >= 0.75 * len(toxic)
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.02 * len(rows)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert all(len(r.evidence) > 0 and len(r.nearest) > 0 for r in rows if r.predicted)


def test_held_out_labels_and_other_columns_are_not_read(scored):
    docs, labels, got = scored
    other = labels.selectExpr("doc_id", f"IF({T.held_out_sql(5)}, 1 - toxic, toxic) AS toxic")
    again = T.score(docs.selectExpr("doc_id", "text", "'zz' AS lang", "reverse(source) AS source"), other, T.held_out_sql(5))
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


def test_defined_cases(spark):
    docs = spark.createDataFrame([(n, f"clean words number {n} vile" if n % 4 == 0 else f"clean words number {n}") for n in range(1, 200)] + [(None, "vile"), (900, None), (901, ""), (902, "vile " * 50000), (902, "vile")],
                                 "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS terms", "true AS held_out")
    labels = spark.createDataFrame([(n, int(n % 4 == 0)) for n in range(1, 150)] + [(None, 1), (4, 0), (5, None)], "doc_id long, toxic int")
    got = T.score(docs, labels, "false").collect()
    assert len(got) == 204 and all(r.held_out is False for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.predicted)
    assert by[None] == [1] and by[900] == [0] and by[901] == [0] and by[902] == [1, 1] and by[196] == [1] and by[197] == [0]
    assert T.without_toxic(docs, labels, "false").columns == docs.columns
    assert {r.score for r in T.score(docs, labels.where("false"), "false").collect()} == {0.0}
    assert T.score(docs.where("false"), labels, "false").count() == 0
