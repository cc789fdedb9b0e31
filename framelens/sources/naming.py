"""Names and paths of outputs (SQL text) and numbering of taken names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import position


def safe_short_name(name: str, max_len: int = 52) -> str:
    """File-system safe name; long names are cut and end in a digest of the original."""
    safe = f"""trim(BOTH ' .' FROM regexp_replace(regexp_replace({name}, r'[<>:"/\\\\|?*]+', '_'), r'\\s+', ' '))"""
    safe = f"CASE WHEN {safe} = '' THEN 'video' ELSE {safe} END"
    cut = f"concat(rtrim(substring({safe}, 1, {max_len - 9})), '_', substring(sha1({name}), 1, 8))"
    return f"CASE WHEN length({safe}) <= {max_len} THEN {safe} ELSE {cut} END"


def output_path(root: str, video: str, category: str, prefix: str, frame: str) -> str:
    """``root/video/category/prefix_frame_NNNNNN.jpg``; longer frame numbers keep all digits."""
    number = f"lpad(CAST({frame} AS STRING), greatest(6, length(CAST({frame} AS STRING))), '0')"
    return f"concat_ws('/', {root}, {video}, {category}, concat({prefix}, '_frame_', {number}, '.jpg'))"


_STEM, _EXT = "regexp_extract({}, '^(.*?)([.][^./]*)?$', 1)", "regexp_extract({}, '^(.*?)([.][^./]*)?$', 2)"


def unique_targets(df: DataFrame, target: str, row_id: str, taken: DataFrame) -> DataFrame:
    """Add ``_1``, ``_2``, … where a target repeats or is taken already, passing over numbered names that exist.

    ``row_id`` is a unique integer and gives the order; ``taken`` has one column
    with the name of ``target``.  Plain targets of other rows count as taken for
    numbered names.
    """
    placed = position(df, [target], row_id, "nth_")
    exists = taken.select(target).distinct()
    marks = exists.withColumn("taken_", F.lit(1))
    # numbered names that are in the way, as the numbers of their plain name
    numbered = exists.unionAll(df.select(target)).distinct().selectExpr(
        f"concat(regexp_extract({_STEM.format(target)}, '^(.*)_([1-9][0-9]*)$', 1), {_EXT.format(target)}) AS {target}",
        f"try_cast(nullif(regexp_extract({_STEM.format(target)}, '^(.*)_([1-9][0-9]*)$', 2), '') AS BIGINT) AS used_")
    used = numbered.where("used_ IS NOT NULL").groupBy(target).agg(F.array_sort(F.collect_set("used_")).alias("used_"))
    n = "(nth_ + coalesce(taken_, 0))"
    # the n-th free number: every used number at or below it shifts it by one
    free = f"({n} + size(filter(transform(coalesce(used_, array()), (u, i) -> u - i), v -> v <= {n})))"
    return placed.join(marks, target, "left").join(used, target, "left").selectExpr(
        *[f"`{c}`" for c in df.columns],
        f"CASE WHEN {n} = 0 THEN {target} ELSE concat({_STEM.format(target)}, '_', {free}, {_EXT.format(target)}) END AS unique_target")


def next_number(df: DataFrame, keys: list[str], name: str, prefix: str, label: str) -> DataFrame:
    """1 + the largest number after ``prefix``, 1 when there is none, and the new file name."""
    number = f"try_cast(nullif(regexp_extract({name}, '^{prefix}([0-9]+)', 1), '') AS INT)"
    best = df.groupBy(*keys).agg(F.expr(f"coalesce(max({number}), 0) + 1").alias("next_no"), F.expr(f"max({label})").alias("label"))
    return best.selectExpr(*keys, "next_no", f"concat('{prefix}', lpad(CAST(next_no AS STRING), greatest(3, length(CAST(next_no AS STRING))), '0'), "
                           "CASE WHEN label <> '' THEN concat('_', label) ELSE '' END, '.png') AS new_name")


def upsert_fields(meta: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Overwrite listed fields where the patch has a non-empty different value; ``changed`` reports it."""
    joined = meta.join(patch.selectExpr(key, *[f"{f} AS new_{f}" for f in fields]), key, "left")
    differs = lambda f: f"coalesce(new_{f} <> '' AND new_{f} IS DISTINCT FROM {f}, false)"
    others = [f"`{c}`" for c in meta.columns if c not in fields]
    return joined.selectExpr(*others, *[f"CASE WHEN {differs(f)} THEN new_{f} ELSE {f} END AS {f}" for f in fields],
                             f"({' OR '.join(differs(f) for f in fields)}) AS changed")
