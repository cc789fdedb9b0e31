"""Lists of files or records: first n, priority unions, even samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import position, top_k


def first_n(df: DataFrame, keys: list[str], name: str, n: int) -> DataFrame:
    """At most n rows per key by name."""
    return top_k(df, keys, name, n, "pos")


def union_prefer_first(primary: DataFrame, fallback: DataFrame, group: list[str], key: str, order: str, cap: int | None = None) -> DataFrame:
    """All of the first list, then rows of the second whose key is new; each list capped first."""
    if cap is not None:
        primary = top_k(primary, group, order, cap, "cap_").drop("cap_")
        fallback = top_k(fallback, group, order, cap, "cap_").drop("cap_")
    tagged = primary.withColumn("from_fallback", F.lit(False)).unionByName(fallback.withColumn("from_fallback", F.lit(True)))
    best = F.expr(f"min_by(struct(*), struct(from_fallback, {order})) AS best_")
    return tagged.groupBy(*group, key).agg(best).select("best_.*")


def topup_from_fallback(primary: DataFrame, fallback: DataFrame, group: list[str], order: str, minimum: int = 4, cap: int = 12) -> DataFrame:
    """First list up to ``cap``; groups with fewer than ``minimum`` rows go on with the second list."""
    first = top_k(primary, group, order, cap, "n_")
    counts = first.groupBy(*group).agg(F.max("n_").alias("have_"))
    second = top_k(fallback, group, order, cap, "n_").join(counts, group, "left").fillna(0, ["have_"])
    extra = second.where(f"have_ < {minimum}").withColumn("n_", F.col("n_") + F.col("have_")).drop("have_")
    return first.unionByName(extra).where(f"n_ <= {cap}").withColumnRenamed("n_", "pos")


def even_sample(df: DataFrame, group: list[str], pos: str, n: int, truncate: bool = False) -> DataFrame:
    """Rows at positions ``round(i * (N - 1) / (n - 1))``; all rows when N <= n.

    With ``truncate`` positions are cut instead of rounded; the last row stays in.
    ``pos`` is a unique integer per group and gives the order.
    """
    placed = position(df, group, pos, "position")
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("size_"))
    place = f"i * ((size_ - 1) / {max(n - 1, 1)}D)"
    # the last of several is the end itself, whatever the product comes to
    place = f"IF(i > 0 AND i = {n - 1}, size_ - 1, floor({place}))" if truncate else f"bround({place}, 0)"
    wanted = sizes.where(f"size_ > {n}").selectExpr(
        *group, f"explode(sequence(0, {n - 1})) AS i", "size_").selectExpr(
        *group, f"CAST({place} AS BIGINT) AS position").distinct()
    small = placed.join(sizes.where(f"size_ <= {n}"), group).drop("size_")
    return small.unionByName(placed.join(wanted, [*group, "position"]).select(small.columns))
