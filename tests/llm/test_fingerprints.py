"""Fingerprints: every figure against plain set arithmetic; linear sketches; defined cases."""

import hashlib
import re

from framelens.llm import fingerprints as P


def brute(rows):
    """Rows by id: n_chars, digest of the edited text, both likenesses from paragraph sets."""
    rows = sorted(rows)
    out = {}
    cut = lambda t: set(re.findall(r"[^\n]{1,%d}" % P.PARAGRAPH, t))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t) in enumerate(rows):
        nxt, q = rows[(k + 1) % len(rows)][1], len(t) // 4
        edited = t[:len(t) - q] + nxt[:q]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), like(cut(t), cut(edited)), like(cut(t), cut(nxt)))
    return out


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = brute([(r.doc_id, r.text) for r in rows])
    got = P.op3_fingerprints(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        n, sha, a, b = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert abs(r.near_edited - a) < 1e-12 and abs(r.near_next - b) < 1e-12
    by_text = {}
    texts = {r.doc_id: r.text for r in rows}
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) == len({frozenset(re.findall(r"[^\n]{1,%d}" % P.PARAGRAPH, t)) for t in by_text})


def test_large_differences_are_tried_with_larger_sketches(spark):
    df = spark.sql("SELECT n, transform(sequence(1, n), i -> xxhash64(i, 7)) AS a, transform(sequence(n DIV 3, 2 * n), i -> xxhash64(i, 7)) AS b FROM VALUES (1), (5), (40), (300), (2500) t(n)")
    cells = df.selectExpr("*", f"{P.sketch(P.signed('a'), str(P.CELLS))} AS ca", f"{P.sketch(P.signed('b'), str(P.CELLS))} AS cb")
    got = cells.selectExpr("size(array_except(a, b)) + size(array_except(b, a)) AS want", f"{P.difference('a', 'b', 'ca', 'cb')} AS found", "size(ca) AS m").collect()
    assert all(r.want == r.found and r.m == P.CELLS for r in got)


def test_defined_cases(spark):
    long = "\n".join(f"line {i} of many" for i in range(3000))
    rows = [(5, None), (1, ""), (3, "one line"), (3, "one line"), (9, long), (None, "no id"), (7, "ä\U0001F600" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS head", "1 AS keys", "2 AS prev_id")
    got = {(r.doc_id, r.n_chars): r for r in P.compared(P.versions(df)).collect()}
    assert len(got) == 6 and got[1, 0].near_edited == 1.0 and got[5, 0].near_edited == 1.0 and got[5, 0].near_next == 0.0
    assert got[7, 100].edited_sha256 == hashlib.sha256((("ä\U0001F600" * 50)[:75] + long[:25]).encode()).hexdigest()
    assert got[9, len(long)].edited_sha256 == hashlib.sha256(long[:len(long) - len(long) // 4].encode()).hexdigest()
    assert got[None, 5].near_next == 0.0
    assert P.compared(P.versions(df)).count() == 7
    assert P.compared(P.versions(df.where("false"))).count() == 0
