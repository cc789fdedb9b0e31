"""Piece ids against the library of the format, for both kinds of model; exact round trip; defined cases."""

import struct

import pytest
import sentencepiece
from framelens.llm import pieces as P

TEXTS = ["", " ", "   ", "a", " a", "a ", "Hello  world", "   lead and   gaps ", "tab\tnew\nline\r\n", "Äpfel über naïve façade", "日本語テキスト", "\U0001F600 \U0001F468‍\U0001F469",
         "x" * 3000, "ab" * 2000, "1234567890" * 50, "....!!!???", "\x00\x01\x7f", "́́é", "aaaaaaaaaaaaa aaaaaaa aaa", "        eight", "thethethethe ingingtion"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.model_path())


@pytest.fixture(scope="module")
def coder():
    return P.TrieEncoder(P.PieceModel.read(P.model_path()))


def ids_of(coder, texts):
    words = [P.marked_words(t) for t in texts]
    known = coder.encode({w for ws in words for w in ws})
    return [[i for w in ws for i in known[w]] for ws in words]


def test_ids_equal_the_library(coder, library):
    assert ids_of(coder, TEXTS) == [library.encode(t) for t in TEXTS]


def test_whole_table(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = P.decode(P.encode(spark.read.parquet(f"{sf}/documents.parquet"))).collect()
    assert {r.doc_id: list(r.ids) for r in rows} == {i: library.encode(t) for i, t in texts.items()}
    assert {r.doc_id: r.text for r in rows} == texts


def _field(number, payload):
    n, size = bytearray(), len(payload)
    while size > 127:
        n.append(size & 127 | 128)
        size >>= 7
    n.append(size)
    return bytes([number << 3 | 2]) + bytes(n) + payload


def unigram_file(tmp_path):
    """A unigram model file with the shorter pieces of the public file; their ranks give the scores."""
    source = P.PieceModel.read(P.model_path())
    message = b""
    for p, s, k in zip(source.pieces, source.scores, source.kinds):
        if k == 1 and (s < -20000 or len(p) > 6):
            continue
        body = _field(1, p.encode()) + b"\x15" + struct.pack("<f", s / 3000 - 3 if k == 1 else 0.0)
        message += _field(1, body + (b"\x18" + bytes([k]) if k != 1 else b""))
    message += _field(2, b"\x18\x01\x98\x02\x01") + _field(3, b"\n\x08identity\x18\x01\x20\x00")
    path = tmp_path / "unigram.model"
    path.write_bytes(message)
    return str(path)


def test_unigram_equals_the_library(tmp_path, spark, sf):
    path = unigram_file(tmp_path)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    coder = P.TrieEncoder(P.PieceModel.read(path))
    texts = [t for t in TEXTS if "\x00" not in t] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    score = lambda ids: sum(library.get_score(i) for i in ids)
    for mine, theirs in zip(ids_of(coder, texts), (library.encode(t) for t in texts)):
        assert mine == theirs or (library.decode(mine) == library.decode(theirs) and abs(score(mine) - score(theirs)) < 1e-3 * max(1, abs(score(theirs))))


def test_order_and_company_of_words_do_not_matter(coder):
    words = sorted({w for t in TEXTS[:16] for w in P.marked_words(t)})
    together = coder.encode(words)
    assert all(P.TrieEncoder(coder.model).encode([w]) == {w: together[w]} for w in words)


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b"), (4, "a▁b")], "doc_id long, text string").selectExpr("*", "1 AS ids")
    got = P.decode(P.encode(df)).collect()
    assert [(r.doc_id, r.text, len(r.ids) > 0) for r in got] == [(1, "", False), (2, "", False), (None, "a b", True), (3, "a b", True), (3, "a b", True), (4, "a b", True)]
    assert P.encode(df.where("false")).count() == 0
