"""Targets and shares of the mix, training order, defined cases."""

from collections import defaultdict

from framelens.llm import mixing as M


def test_targets_are_met_and_limits_hold(spark, sf):
    rows = M.op7_mixing(spark, sf).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.target <= 3 * r.source_size
        taken[r.target, r.source_size] += r.taken
        target[r.target, r.source_size] = r.target
    assert sum(taken.values()) <= sum(r.size for r in rows)
    # sources of equal size and target fall together here, so compare multiples
    for k, t in taken.items():
        n = sum(r.size for r in rows if (r.target, r.source_size) == k) / k[1]
        assert abs(t - n * target[k]) < n


def test_training_order_follows_the_schedule(spark, sf):
    rows = [r.position for r in M.op7_mixing(spark, sf).collect()]
    known = [p for p in rows if p is not None]
    assert known == sorted(known) and all(0 <= p <= 1 for p in known) and rows[:len(known)] == known


def test_early_sources_come_first(spark):
    df = spark.createDataFrame([(n, "a b c d", None, f"s{n % 3}", 7) for n in range(600)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = M.mix(df).where("position IS NOT NULL").collect()
    mean = lambda s: sum(r.position for r in rows if r.source == s) / sum(r.source == s for r in rows)
    assert mean("s0") < mean("s1") < mean("s2")


def test_defined_cases(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, "a", 0), (2, "", None, None, 0), (3, "x y z", None, None, 5), (None, "p q", None, "b", 3), (4, "w " * 50000, None, "b", 9), (4, "w w", None, "b", 3), (4, "w w", None, "b", 3)]
    df = spark.createDataFrame(rows, kind).selectExpr("*", "1 AS taken", "'x' AS bucket", "2 AS size", "3 AS position")
    got = M.mix(df).collect()
    assert len(got) == 7 and all(r.taken <= 3 * r.size for r in got)
    assert {r.source: r.source_size for r in got} == {"a": 0, None: 3, "b": 50006}
    assert [(r.size, r.taken, r.position) for r in got if r.source == "a"] == [(0, 0, None)]
    out = M.mixed_documents(df)
    assert out.columns == df.columns and sum(len(r.text.split()) for r in out.collect()) > 0
    assert M.mix(df.where("false")).count() == 0 and M.mixed_documents(df.where("false")).count() == 0


def test_columns_named_like_helpers(spark):
    from framelens.llm import simhash, toxicity
    text = "one two three four five six seven eight nine ten"
    names = ["id_", "drop_", "left_", "taken_", "size_", "row_", "root_", "node", "digest"]
    docs = spark.createDataFrame([(i, text if i < 3 else f"{text} {i}", "a", *[f"{n}{i}" for n in names]) for i in range(6)],
                                 f"doc_id long, text string, source string, {', '.join(f'{n} string' for n in names)}")
    given = {r["doc_id"]: r.asDict() for r in docs.collect()}
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    mixed = M.mixed_documents(docs)
    for out in (mixed, simhash.one_per_group(docs), simhash.one_per_likeness(docs), toxicity.without_toxic(docs, labels, toxicity.held_out_sql(5))):
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[c] == given[r["doc_id"]][c] for c in docs.columns if c != "text" or out is not mixed)
