"""Review cards and the merge of human corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lit
from ..sources.naming import unique_targets
from .classify import map_top_n

LEVELS = ("high", "medium", "low")
CORRECTION = "array<struct<frame_idx:bigint,action:string,save_path:string,original_category:string,new_category:string>>"


def read_corrections(df: DataFrame, payload: str, default_dir: str = "") -> DataFrame:
    """Correction payloads as rows, ``seq`` being the place in the payload; a missing output folder takes the session default."""
    parsed = df.selectExpr(f"from_json({payload}, 'struct<video_id:string,output_dir:string,corrections:{CORRECTION}>') AS p")
    rows = parsed.selectExpr("p.video_id", f"coalesce(nullif(p.output_dir, ''), {lit(default_dir)}) AS output_dir", "posexplode(p.corrections) AS (seq, c_)")
    return rows.selectExpr("video_id", "output_dir", "CAST(seq AS BIGINT) AS seq", "c_.*")


def review_cards(records: DataFrame, files: DataFrame, include_high: bool = False) -> DataFrame:
    """Rows to review with their three best categories and an existing image path.

    ``records`` has level, save_path, queue_path, category_scores; ``files`` lists
    the existing paths.  The queue copy stands in for a missing image; rows with
    neither are dropped.
    """
    rows = records if include_high else records.where("level <> 'high'")
    known = files.select(F.col("path")).distinct()
    rows = rows.join(known.selectExpr("path AS save_path", "true AS has_image"), "save_path", "left")
    rows = rows.join(known.selectExpr("path AS queue_path", "true AS has_copy"), "queue_path", "left")
    rows = rows.where("has_image OR has_copy")
    return rows.selectExpr("video_id", "frame_idx", "category", "level", "CASE WHEN has_image THEN save_path ELSE queue_path END AS shown_path",
                           f"{map_top_n('category_scores')} AS top_scores")


def review_stats(cards: DataFrame) -> DataFrame:
    """Counts per category and level, with totals."""
    return cards.groupBy("category").agg(
        *[F.expr(f"count_if(level = '{v}')").alias(v) for v in LEVELS], F.count(F.lit(1)).alias("total"),
        F.expr("count_if(level <> 'high')").alias("to_review"))


def checked_corrections(corrections: DataFrame, files: DataFrame, order: str) -> DataFrame:
    """Corrections with their outcome: moved, missing_file, no_category or ignored.

    ``order`` is the sequence column.  The first move of a path takes the file
    away, so later corrections of that path find none.
    """
    known = files.select("path").distinct().selectExpr("path AS save_path", "true AS exists_")
    would = ("CASE WHEN action IS NULL OR action NOT IN ('reclassify', 'exclude') THEN 'ignored' WHEN exists_ IS NULL THEN 'missing_file' "
             "WHEN action = 'reclassify' AND coalesce(new_category, '') = '' THEN 'no_category' ELSE 'moved' END")
    judged = corrections.join(known, "save_path", "left").withColumn("outcome_", F.expr(would))
    first = judged.where("outcome_ = 'moved'").groupBy("save_path").agg(F.min(order).alias("first_"))
    outcome = f"CASE WHEN outcome_ IN ('moved', 'no_category') AND {order} > coalesce(first_, {order}) THEN 'missing_file' ELSE outcome_ END"
    return judged.join(first, "save_path", "left").selectExpr(*[f"`{c}`" for c in corrections.columns], f"{outcome} AS outcome")


def apply_corrections(records: DataFrame, corrections: DataFrame, files: DataFrame, keys: list[str], order: str, row_order: str | None = None) -> DataFrame:
    """New version of the records: each key's last moved correction sets category and path.

    A moved file goes to ``output_dir/category/name``, or to the first free
    numbered name there.  ``files`` lists the existing paths.  Where a key has
    several records, ``row_order`` names the column by which the last one is
    the one that changes; without it keys are taken to be unique.
    """
    moved = corrections.where("outcome = 'moved'").selectExpr(
        *keys, order, "CASE WHEN action = 'exclude' THEN 'Excluded' ELSE new_category END AS to_",
        "concat_ws('/', output_dir, CASE WHEN action = 'exclude' THEN 'excluded' ELSE new_category END, element_at(split(save_path, '/'), -1)) AS target_")
    placed = unique_targets(moved, "target_", order, files.selectExpr("path AS target_"))
    last = placed.groupBy(*keys).agg(F.expr(f"max_by(struct(to_, unique_target), {order})").alias("c_"))
    if row_order is None:
        joined = records.join(last, keys, "left")
    else:
        newest = records.groupBy(*keys).agg(F.max(row_order).alias("newest_")).join(last, keys)
        joined = records.join(newest.withColumnRenamed("newest_", row_order), [*keys, row_order], "left")
    rest = [f"`{c}`" for c in records.columns if c not in ("category", "save_path")]
    return joined.selectExpr(*rest, "coalesce(c_.to_, category) AS category", "coalesce(c_.unique_target, save_path) AS save_path", "c_ IS NOT NULL AS corrected")


def correction_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.expr("count_if(outcome = 'moved')").alias("moved"), F.expr("count_if(outcome IN ('missing_file', 'no_category'))").alias("skipped"),
                       F.expr("coalesce(bool_or(outcome = 'moved'), false)").alias("updated"))
