"""A training corpus from ``documents``: five stages, each over all rows that the stage before kept.

1. toxicity: documents predicted toxic leave (labels of every fifth id are never read).
2. near-duplicates: one document of each group stays, the smallest id; texts whose sets of five-word shingles have a Jaccard similarity of 0.8 are linked.
3. substring dedup: words of passages that repeat a smaller id leave the text; a text that loses all its words leaves.
4. mixing: sources to target weights; a document stands as often as it is taken.
5. pieces: piece ids and the text they decode to.

Every stage keeps the columns of ``documents``; the last adds ``ids``.  In
stages 3 and 4 the text changes and ``n_chars`` follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.llm import mixing, pieces, simhash, substrings, toxicity
from framelens.llm.common import Scratch, table


def _with_length(before: DataFrame, after: DataFrame) -> DataFrame:
    """``n_chars`` of changed texts, in the column order of ``before``."""
    if "n_chars" not in before.columns:
        return after
    kind = before.schema["n_chars"].dataType
    return after.withColumn("n_chars", F.char_length("text").cast(kind)).select(*before.columns)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), toxicity.held_out_sql(5))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_likeness(docs)


def passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spans = substrings.repeated_spans(docs)
    done = substrings.without_spans(docs, spans).where("n_removed = 0 OR n_removed < n_words")
    return _with_length(docs, done.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(docs, mixing.mixed_documents(docs))


def pieces_of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.with_pieces(docs)


STAGES = [("toxicity", toxic_out), ("simhash", near_copies_out), ("substrings", passages_out), ("mixing", mixed), ("pieces", pieces_of)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next stage."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs)
            if k:
                scratch.free(before)
    return docs
