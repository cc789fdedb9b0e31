"""Mixing sources to target weights by a time-varying curriculum (DataFrame functions only).

Every source gets a target number of words.  Its documents stand in a fixed
pseudo-random order; the words of that order, repeated, are its supply.  Each
source also has a weight schedule over training time 0..1, linear here.  The
integral of the schedule says how many of its words are due by a time; the
inverse of the integral gives each document its training position, and the mix
is range-sorted by position.

Defined cases: null text or text without words has size 0 and takes nothing;
a null source is a source of its own, last in order; rows with one doc_id are
rows of their own; an empty table gives an empty result; other columns of the
input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, global_rank, order_sql, table
from .registry import query

WEIGHTS = (5, 2, 1)
# slope of each weight's schedule: the rate at time t is target * (1 + slope * (2t - 1))
SLOPES = (-0.5, 0.0, 0.5)
MAX_REPEAT = 3
BUCKET_ROWS = 4096


def sizes(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("doc_id", "source", f"CAST(coalesce(regexp_count(text, r'{WORD}'), 0) AS BIGINT) AS size", "md5(CAST(doc_id AS STRING)) AS okey")


def in_buckets(sized: DataFrame, rows: int) -> DataFrame:
    """``bucket`` cuts each source's order into ranges of about ``BUCKET_ROWS`` rows at most: the order key is uniform, so its first digits do."""
    bits = max(0, (rows // BUCKET_ROWS).bit_length())
    return sized.withColumn("bucket", F.expr(f"shiftright(CAST(conv(substring(coalesce(okey, '{'0' * 32}'), 1, 8), 16, 10) AS BIGINT), {32 - min(bits, 32)})"))


def _pick(values) -> str:
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE rank % {len(values)} {cases} END"


def source_targets(sized: DataFrame, rows: int, scratch: Scratch, weights=WEIGHTS, slopes=SLOPES, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``(source, source_size, target, quota, slope)``: shares by weight, none above ``max_repeat`` times its source.

    Each round closes the sources above their limit and shares what they leave
    among the rest; a round is one aggregate over the table of sources, and only
    three totals reach the driver.
    """
    per = scratch.keep(sized.groupBy("source").agg(F.sum("size").alias("source_size")), rows)
    ranked = scratch.keep(global_rank(per, ["source"], scratch, rows).selectExpr(
        "source", "source_size", f"CAST({_pick(weights)} AS BIGINT) AS w", f"CAST({_pick(slopes)} AS DOUBLE) AS slope"), rows)
    total, open_w = ranked.selectExpr("coalesce(sum(source_size), 0)", "coalesce(sum(w), 1)").first()
    rest, closed = total, "false"
    while True:
        closed_next = f"({closed} OR {max_repeat} * source_size * {open_w} < w * {rest})"
        caps, left_w = ranked.selectExpr(f"coalesce(sum(IF({closed_next}, {max_repeat} * source_size, 0)), 0)",
                                         f"coalesce(sum(IF({closed_next}, 0, w)), 0)").first()
        if left_w == open_w or left_w == 0:
            break
        rest, open_w, closed = total - caps, left_w, f"({max_repeat} * source_size * {open_w} < w * {rest})"
    return ranked.selectExpr(
        "source", "source_size", f"IF({closed}, CAST({max_repeat} * source_size AS DOUBLE), CAST(w * {rest} AS DOUBLE) / {open_w}) AS target",
        f"IF({closed}, {max_repeat} * source_size, (w * {rest}) DIV {open_w}) AS quota", "slope")


def mix(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken, and the time ``position`` of its first copy (null if none)."""
    scratch = Scratch(docs.sparkSession)
    sized = scratch.keep(sizes(docs))
    rows = sized.count()
    targets = source_targets(sized, rows, scratch, weights, slopes, max_repeat)
    parts = in_buckets(sized, rows)
    sums = parts.groupBy("source", "bucket").agg(F.sum("size").alias("sum_"))
    offsets = sums.selectExpr("source AS s_", "bucket AS b_",
                              "coalesce(sum(sum_) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base_")
    # words of the source's order before each document
    local = parts.selectExpr("*", f"sum(size) OVER (PARTITION BY source, bucket ORDER BY {order_sql(['okey', 'doc_id', 'size'])} ROWS UNBOUNDED PRECEDING) - size AS before_")
    placed = local.join(offsets, F.expr("source <=> s_ AND bucket = b_")).withColumn("before", F.expr("base_ + before_"))
    t = targets.withColumnRenamed("source", "t_")
    joined = placed.join(t, F.expr("source <=> t_"))
    u = "(CAST(before AS DOUBLE) / quota)"
    return (joined
            .withColumn("epochs", F.expr("IF(source_size > 0, quota DIV source_size, 0)"))
            .withColumn("taken", F.expr("size * epochs + greatest(0, least(size, quota - epochs * source_size - before))"))
            .withColumn("position", F.expr(f"CASE WHEN taken = 0 THEN NULL WHEN slope = 0 THEN {u} "
                                           f"ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * {u}) - (1 - slope)) / (2 * slope) END"))
            .select("doc_id", "source", "size", "source_size", "target", "taken", "position"))


def training_order(mixed: DataFrame) -> DataFrame:
    """Rows in training order: a range sort by position, then doc_id."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last())


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: a document stands as often as it is taken whole.

    The one document of a source that is taken in part stands once more with the
    words taken from it.  Rows that share a doc_id share its words evenly.
    """
    plan = mix(docs, **options).groupBy("doc_id").agg(F.sum("taken").alias("taken_"), F.count("*").alias("rows_"), F.max("size").alias("size_"))
    plan = plan.selectExpr("doc_id AS id_", "taken_ DIV rows_ AS taken_", "size_").where("taken_ > 0")
    others = [f"`{c}`" for c in docs.columns if c != "text"]
    rows = docs.selectExpr(f"struct({', '.join(others)}) AS row_", "doc_id", "text")
    joined = rows.join(plan, F.expr("doc_id <=> id_"))
    part = f"array_join(slice(regexp_extract_all(text, r'{WORD}', 0), 1, CAST(left_ AS INT)), ' ')"
    copies = joined.withColumn("left_", F.expr("explode(transform(sequence(0L, (taken_ - 1) DIV size_), i -> least(size_, taken_ - i * size_)))"))
    text = F.expr(f"IF(left_ < size_, {part}, text)").alias("text")
    return copies.select(*[text if c == "text" else F.col("row_").getField(c).alias(c) for c in docs.columns])


SQL = f"""
WITH d AS (SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS okey,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST) AS j,
    coalesce(sum({MAX_REPEAT} * source_size) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w,
    sum(source_size) OVER () AS total FROM w),
first_open AS (SELECT j AS fj, total - caps AS rest, left_w AS ow FROM r WHERE {MAX_REPEAT} * source_size * left_w >= w * (total - caps) ORDER BY j LIMIT 1),
t AS (SELECT source, source_size, slope,
    CASE WHEN j < fj THEN CAST({MAX_REPEAT} * source_size AS DOUBLE) ELSE CAST(CAST(w * rest AS BIGINT) AS DOUBLE) / CAST(ow AS DOUBLE) END AS target,
    CAST(CASE WHEN j < fj THEN {MAX_REPEAT} * source_size ELSE CAST(w * rest AS BIGINT) // CAST(ow AS BIGINT) END AS BIGINT) AS quota FROM r, first_open),
p AS (SELECT d.*, t.source_size, t.target, t.quota, t.slope,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY okey, doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS epochs, before::DOUBLE / quota AS u FROM p),
k AS (SELECT *, CAST(size * epochs + greatest(0, least(size, quota - epochs * source_size - before)) AS BIGINT) AS taken FROM e)
SELECT doc_id, size, source_size, target, taken,
  round(CASE WHEN taken = 0 THEN NULL WHEN slope = 0 THEN u ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope) END, 6) AS position
FROM k"""


@query("op7_mixing", SQL)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words the mix takes of them, in training order."""
    return training_order(mix(table(spark, sf_dir, "documents"))).selectExpr(
        "doc_id", "size", "source_size", "target", "taken", "round(position, 6) AS position")
