"""Ordered operators that stay parallel when one key holds most of the rows.

A window partitioned by a hot key alone runs in one task.  The helpers here cut
each key's order axis into bounded segments, work inside the segments, and
carry the small per-segment summaries across.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

SEGMENT = 1 << 16


def _csv(names) -> str:
    return ", ".join(names)


def top_k(df: DataFrame, keys: list[str], order: str, k: int | None, rank: str = "rank") -> DataFrame:
    """First k rows per key (None: all rows, ranked); Spark limits each group before the shuffle as well."""
    ranked = df.selectExpr("*", f"row_number() OVER (PARTITION BY {_csv(keys)} ORDER BY {order}) AS {rank}")
    return ranked if k is None else ranked.where(f"{rank} <= {k}")


def gap_groups(df: DataFrame, keys: list[str], pos: str, gap: float, out: str = "grp", width: int = SEGMENT) -> DataFrame:
    """Number the runs of rows whose distance to the row before is at most ``gap``.

    ``pos`` is numeric; groups count from 0 in order of ``pos``.
    """
    k = _csv(keys)
    local = (df.selectExpr("*", f"floor({pos} / {width}) AS seg_")
             .selectExpr("*", f"lag({pos}) OVER (PARTITION BY {k}, seg_ ORDER BY {pos}) AS prev_")
             .selectExpr("*", f"CASE WHEN {pos} - prev_ > {gap} THEN 1 ELSE 0 END AS brk_"))
    spans = local.groupBy(*keys, "seg_").agg(F.min(pos).alias("lo_"), F.max(pos).alias("hi_"), F.sum("brk_").alias("inner_"))
    offsets = (spans.selectExpr("*", f"lag(hi_) OVER (PARTITION BY {k} ORDER BY seg_) AS before_")
               .selectExpr("*", f"CASE WHEN before_ IS NULL OR lo_ - before_ > {gap} THEN 1 ELSE 0 END AS start_")
               .selectExpr(*keys, "seg_", f"sum(start_ + inner_) OVER (PARTITION BY {k} ORDER BY seg_) - inner_ - 1 AS base_"))
    return (local.join(offsets, [*keys, "seg_"])
            .selectExpr(*[f"`{c}`" for c in df.columns],
                        f"base_ + sum(brk_) OVER (PARTITION BY {k}, seg_ ORDER BY {pos}) AS {out}"))


def running(df: DataFrame, keys: list[str], pos: str, value: str, kind: str, out: str, inclusive: bool = True,
            width: int = SEGMENT) -> DataFrame:
    """Running ``sum`` or ``max`` of ``value`` in order of the unique integer ``pos``."""
    k = _csv(keys)
    edge = "CURRENT ROW" if inclusive else "1 PRECEDING"
    local = df.selectExpr("*", f"floor({pos} / {width}) AS seg_", f"{value} AS val_")
    totals = local.groupBy(*keys, "seg_").agg({"val_": kind}).selectExpr(*keys, "seg_", f"`{kind}(val_)` AS tot_")
    offsets = totals.selectExpr(*keys, "seg_", f"{kind}(tot_) OVER (PARTITION BY {k} ORDER BY seg_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base_")
    inner = f"{kind}(val_) OVER (PARTITION BY {k}, seg_ ORDER BY {pos} ROWS BETWEEN UNBOUNDED PRECEDING AND {edge})"
    both = f"coalesce(base_, 0) + coalesce({inner}, 0)" if kind == "sum" else f"greatest(base_, {inner})"
    return local.join(offsets, [*keys, "seg_"]).selectExpr(*[f"`{c}`" for c in df.columns], f"{both} AS {out}")


def position(df: DataFrame, keys: list[str], pos: str, out: str = "position", width: int = SEGMENT) -> DataFrame:
    """Zero-based position of each row in the order of the unique integer ``pos``."""
    return running(df, keys, pos, "1L", "sum", out, inclusive=False, width=width)


def exact_rank(df: DataFrame, keys: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """One-based rank per key for any sort order (``"name"`` or ``"name DESC"``), hot keys included.

    Rows are range-partitioned by key and order, which splits a hot key over
    many tasks.  The partition number is fixed by writing the table once, so
    the counts and the rows agree even when tasks are run again.
    """
    k = _csv(keys)
    sort = [F.col(o[:-5]).desc() if o.endswith(" DESC") else F.col(o) for o in order]
    parts = durable(df.repartitionByRange(*[F.col(c) for c in keys], *sort).withColumn("part_", F.spark_partition_id()))
    counts = parts.groupBy(*keys, "part_").count()
    offsets = counts.selectExpr(*keys, "part_", f"coalesce(sum(count) OVER (PARTITION BY {k} ORDER BY part_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base_")
    local = parts.selectExpr("*", f"row_number() OVER (PARTITION BY {k}, part_ ORDER BY {_csv(order)}) AS rn_")
    return local.join(offsets, [*keys, "part_"]).selectExpr(*[f"`{c}`" for c in df.columns], f"base_ + rn_ AS {out}")


def split_by_size(df: DataFrame, keys: list[str], limit: int, measure: str = "1L") -> tuple[DataFrame, DataFrame | None]:
    """Rows of the keys whose sum of ``measure`` is within ``limit``, and those of the larger keys (None: there are none)."""
    sizes = df.groupBy(*keys).agg(F.expr(f"sum({measure})").alias("size_")).where(f"size_ > {limit}").drop("size_")
    large = durable(sizes.withColumnsRenamed({c: f"large_{c}" for c in keys}))
    if large.isEmpty():
        return df, None
    same = F.expr(" AND ".join(f"{c} <=> large_{c}" for c in keys))
    return df.join(large, same, "left_anti"), df.join(large, same, "left_semi")
