"""Each stage of the pipeline against a plain version on its own input, and the run as a whole."""

from collections import Counter, defaultdict

import corpus_pipeline as C
import duckdb
import pytest
import sentencepiece
from framelens.llm import mixing, pieces, substrings
from framelens.llm.toxicity import score

import __spark_entry__


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"  # smaller tables have too few toxic labels to learn from


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """Input and output of every stage, written and read again."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in C.STAGES:
        path = str(tmp_path_factory.mktemp("step") / name)
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def twin(df, sql):
    """Rows of a SQL twin over ``df`` as ``documents``."""
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "source").toArrow())
    return con.execute(sql).fetchall()


def test_toxic_documents_leave_and_clean_ones_stay(steps, spark, sf):
    before, after = steps[0]
    predicted = {r.doc_id for r in score(before, spark.read.parquet(f"{sf}/labels.parquet"), "crc32(CAST(doc_id AS STRING)) % 5 = 0").where("predicted = 1").collect()}
    assert predicted and sorted(map(str, rows(after))) == sorted(str(r) for r in rows(before) if r["doc_id"] not in predicted)


def test_one_document_of_each_group_stays(steps):
    before, after = steps[1]
    grams = {}
    for r in rows(before):  # five-word shingles; shorter texts are one
        w = (r["text"] or "").encode().lower().split()
        grams[r["doc_id"]] = {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    alike = defaultdict(list)
    by_gram = defaultdict(list)
    for i, g in sorted(grams.items()):
        common = Counter(j for x in g for j in by_gram[x])
        for j, n in common.items():
            if n >= 0.8 * (len(g) + len(grams[j]) - n):
                alike[i].append(j)
                alike[j].append(i)
        for x in g:
            by_gram[x].append(i)
    kept, seen = set(), set()
    for i in sorted(grams):
        if i in seen:
            continue
        if grams[i] or not any(not grams[j] for j in kept):  # texts without words are equal
            kept.add(i)
        walk = [i]
        while walk:
            seen.add(k := walk.pop())
            walk += [j for j in alike[k] if j not in seen]
    assert sorted(map(str, rows(after))) == sorted(str(r) for r in rows(before) if r["doc_id"] in kept)


def test_repeated_passages_leave(steps):
    before, after = steps[2]
    want = {r[0]: r[1:] for r in twin(before, substrings.SQL)}
    got = {r["doc_id"]: r for r in rows(after)}
    assert set(got) == {i for i, (n, gone, _) in want.items() if gone == 0 or gone < n}
    texts = {r["doc_id"]: r["text"] for r in rows(before)}
    for i, r in got.items():
        assert len((r["text"] or "").split()) == want[i][0] - want[i][1] and r["n_chars"] == len(r["text"])
        assert want[i][1] or r["text"] == texts[i]


def test_documents_stand_as_often_as_they_are_taken(steps):
    before, after = steps[3]
    taken = {r[0]: (r[1], r[4]) for r in twin(before, mixing.SQL)}
    words, copies = Counter(), Counter()
    for r in rows(after):
        words[r["doc_id"]] += len(r["text"].split())
        copies[r["doc_id"]] += 1
    assert words == {i: t for i, (_, t) in taken.items() if t}
    assert copies == {i: -(-t // n) for i, (n, t) in taken.items() if t}


def test_pieces_decode_to_the_text(steps):
    before, after = steps[4]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    assert Counter(r["text"] for r in rows(after)) == Counter(r["text"] for r in rows(before))
    assert all(list(r["ids"]) == library.encode(r["text"]) for r in rows(after))
    assert after.columns == [*before.columns, "ids"]


def test_run_equals_the_stages(steps, spark, sf):
    got = __spark_entry__.queries()["pipeline"](spark, sf)
    key = lambda r: (r["doc_id"], r["text"], r["source"], r["n_chars"], list(r["ids"]))
    assert sorted(map(key, rows(got))) == sorted(map(key, rows(steps[-1][1])))
    assert all(a.columns == b.columns for a, b in steps[:-1])


def test_empty_and_odd_tables(spark, sf):
    kind = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
    odd = spark.createDataFrame([(1, None, None, None, None, "x"), (None, "a b", "en", "s", 3, "y"), (2, "", "en", "s", 0, None), (3, "one two", "en", "s", 7, "z"), (3, "one two", "en", "s", 7, "z")], kind)
    for docs in (odd.where("false"), odd):
        for name, stage in C.STAGES:
            after = stage(spark, docs, sf)
            assert after.columns == [*docs.columns, *(["ids"] if name == "pieces" else [])]
            assert (after.count() > 0) == (docs.count() > 0)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_stay_where_they_are_while_toxic_ids_are_few(spark, sf):
    assert "hashpartitioning" not in planned(C.toxic_out(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf))


def test_pieces_take_one_python_worker_a_core(spark, sf):
    assert planned(pieces.with_pieces(spark.read.parquet(f"{sf}/documents.parquet"))).count("MapInArrow") == 1
