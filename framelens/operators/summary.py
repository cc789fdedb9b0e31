"""Per-video summaries: counts, title, tiers, mechanics, lines and flow layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.signals import bigwin_tier_plain
from ..functions.text import lit, normalize_plain, some_term, squeeze
from ..session import durable
from .greedy import join_small
from .windows import position, top_k

# --- fixed values: summary sentences and the words behind them ------------------------
MECHANICS = [
    ("Free game / free spins mode is present.", ["free spin", "free game"], None),
    ("Feature-game progress is shown with remaining/left/last spin UI.", ["remaining", "left", "last free"], None),
    ("Multiplier mechanic is likely part of the feature or base flow.", ["multiplier"], r"x\s*\d+"),
    ("Wild symbols are important to the rules.", ["wild"], None),
    ("Scatter symbols are used as trigger or paytable symbols.", ["scatter"], None),
    ("Feature Buy / Buy Feature entry is present.", ["buy feature", "feature buy"], None),
    ("Help pages include paytable or payout explanation.", ["paytable", "payout"], None),
]


def category_counts(df: DataFrame) -> DataFrame:
    """Count of every summary category per video, zeros included."""
    wide = df.groupBy("video_id").agg(*[F.expr(f"count_if(category = {lit(c)})").alias(f"n{i}") for i, c in enumerate(R.SUMMARY_CATEGORIES)])
    pairs = ", ".join(f"{lit(c)}, n{i}" for i, c in enumerate(R.SUMMARY_CATEGORIES))
    return wide.selectExpr("video_id", f"stack({len(R.SUMMARY_CATEGORIES)}, {pairs}) AS (category, n)")


def infer_title(df: DataFrame, first: int | None = 80, default: str = "Unknown Game") -> DataFrame:
    """Most common plausible text of each video's ``first`` rows (None: all); first seen wins ties."""
    head = top_k(df.select("video_id", "frame_idx", "items"), ["video_id"], "frame_idx", first, "row_no")
    items = head.selectExpr("video_id", "row_no", "posexplode(items) AS (pos, i)").selectExpr("video_id", "row_no", "pos", "trim(i.text) AS raw", "i.score AS score")
    ok = (f"length(raw) >= 3 AND score >= 0.65D AND NOT raw RLIKE '[0-9]' AND NOT {some_term(normalize_plain('raw'), R.IGNORED_TITLE_WORDS)}")
    counts = items.where(ok).groupBy("video_id", "raw").agg(F.count(F.lit(1)).alias("n"), F.expr("min(struct(row_no, pos))").alias("at"))
    best = counts.groupBy("video_id").agg(F.expr("max_by(raw, struct(n, -at.row_no, -at.pos))").alias("title"))
    return df.select("video_id").distinct().join(best, "video_id", "left").fillna(default, ["title"])


def tier_list(df: DataFrame, limit: int | None = 12) -> DataFrame:
    """Tier of the first ``limit`` big-win rows of each video (None: all)."""
    text = squeeze(f"array_join(transform(items, i -> {normalize_plain('i.text')}), ' ')")
    rows = top_k(df.where("category = 'BigWin'").select("video_id", "frame_idx", "items"), ["video_id"], "frame_idx", limit, "pos")
    return rows.selectExpr("video_id", "frame_idx", "pos", f"{bigwin_tier_plain(text)} AS tier")


def infer_mechanics(df: DataFrame) -> DataFrame:
    """Mechanics named by the help and feature text of each video (phrases within one frame)."""
    text = f"array_join(transform(items, i -> {normalize_plain('i.text')}), ' ') AS t"
    rows = df.where("category IN ('Help', 'Feature game')").selectExpr("video_id", text)
    test = lambda words, pattern: some_term("t", words) + (f" OR t RLIKE r'{pattern}'" if pattern else "")
    flags = rows.groupBy("video_id").agg(*[F.expr(f"bool_or({test(w, p)})").alias(f"m{i}") for i, (_, w, p) in enumerate(MECHANICS)])
    pairs = ", ".join(f"{i}, {lit(name)}, m{i}" for i, (name, _, _) in enumerate(MECHANICS))
    return flags.selectExpr("video_id", f"stack({len(MECHANICS)}, {pairs}) AS (pos, mechanic, present)").where("present").drop("present")


def unique_lines(df: DataFrame, group: list[str], order: str, text: str, limit: int | None = 30) -> DataFrame:
    """First ``limit`` lines per group (None: all) that are new by their plain normal form (length >= 4)."""
    parts = df.selectExpr(*group, order, f"posexplode(split({text}, r'[\\n\\r]+| {{2,}}')) AS (pos, part)")
    cleaned = parts.selectExpr(*group, order, "pos", "trim(regexp_replace(part, r'\\s+', ' ')) AS line")
    keyed = cleaned.selectExpr("*", f"{normalize_plain('line')} AS line_key").where("length(line_key) >= 4")
    first = keyed.groupBy(*group, "line_key").agg(F.expr(f"min_by(struct({order}, pos, line), struct({order}, pos))").alias("f"))
    return top_k(first.selectExpr(*group, f"f.{order}", "f.pos", "f.line"), group, f"{order}, pos", limit, "line_no")


def build_analysis(df: DataFrame, text_rows: DataFrame) -> DataFrame:
    """One row per video: title, counts, tiers, lines and mechanics, each list bounded by its limit."""
    counts = category_counts(df).groupBy("video_id").agg(F.expr("map_from_entries(collect_list(struct(category, n)))").alias("category_counts"))
    tiers = tier_list(df).groupBy("video_id").agg(F.expr("transform(array_sort(collect_list(struct(pos, tier))), t -> t.tier)").alias("bigwin_tiers"))
    lines = unique_lines(text_rows, ["video_id"], "frame_idx", "text", 80).groupBy("video_id").agg(
        F.expr("transform(array_sort(collect_list(struct(line_no, line))), t -> t.line)").alias("help_text_lines"))
    mech = infer_mechanics(df).groupBy("video_id").agg(F.expr("transform(array_sort(collect_list(struct(pos, mechanic))), t -> t.mechanic)").alias("mechanics"))
    out = infer_title(df).join(counts, "video_id", "left")
    for part in (tiers, lines, mech):
        out = out.join(part, "video_id", "left")
    return out


def write_analysis(analysis: DataFrame, path: str) -> None:
    """One JSON document per line and video."""
    analysis.selectExpr("to_json(struct(*)) AS value").write.mode("overwrite").text(path)


# --- flow layout -----------------------------------------------------------------------------
def flow_layout(df: DataFrame, tiers: list[str], max_images: int = 6) -> DataFrame:
    """Nodes of the two flow rows of each video by the presence of categories."""
    names = ["loading", "Feature Buy", "Feature game", "Other", "Transition", "BigWin", "Result"]
    flags = df.groupBy("video_id").agg(*[F.expr(f"count_if(category = {lit(c)})").alias(f"c{i}") for i, c in enumerate(names)])
    has = {c: f"c{i} > 0" for i, c in enumerate(names)}
    node = lambda row, node_id, label, category, index, count, optional, trigger: (
        f"named_struct('row', {row}, 'id', {node_id}, 'label', {label}, 'category', {category}, 'img_index', {index}, 'img_count', {count}, "
        f"'optional', {optional}, 'trigger', '{trigger}')")
    when = lambda cond, n: f"CASE WHEN {cond} THEN {n} END"
    shown = f"least({len(tiers)}, greatest(1, least({max_images}, CAST(c5 AS INT))))"
    labels = "array(" + ", ".join(lit(t) for t in tiers) + ")"
    bigwin = (f"transform(sequence(0, {shown} - 1), i -> " + node(0, "concat('bigwin_', i + 1)", f"{labels}[i]", "'BigWin'", "i", 1, "false", "condition") + ")")
    top = ", ".join([when(has["loading"], node(0, "'loading'", "'Loading'", "'loading'", 0, 1, "false", "always")),
                     node(0, "'basegame'", "'Base Game'", "'Basegame'", 0, 2, "false", "always"),
                     when(has["Feature Buy"], node(0, "'feature_buy'", "'Buy Feature'", "'Feature Buy'", 0, 1, "true", "paid"))])
    feature = f"({has['Feature game']} OR {has['Other']})"
    main = node(1, "'featuregame'", f"CASE WHEN {has['Feature game']} THEN 'Free Game' ELSE 'Feature Game' END",
                f"CASE WHEN {has['Feature game']} THEN 'Feature game' ELSE 'Other' END", 0, 2, "false", "always")
    low = ", ".join([when(f"{feature} AND {has['Transition']}", node(1, "'transition'", "'Transition'", "'Transition'", 0, 1, "false", "always")),
                     when(feature, main),
                     when(f"{feature} AND {has['BigWin']}", node(1, "'bigwin_fg'", "'Big Win (FG)'", "'BigWin'", 0, 1, "false", "condition")),
                     when(f"{feature} AND {has['Result']}", node(1, "'result'", "'Total Win'", "'Result'", 0, 1, "false", "always"))])
    nodes = f"concat(array_compact(array({top})), {bigwin}, array_compact(array({low})))"
    return flags.selectExpr("video_id", f"posexplode({nodes}) AS (pos, n)").selectExpr(
        "video_id", "pos", "n.row AS row_no", "n.id AS node_id", "n.label", "n.category", "n.img_index", "n.img_count", "n.optional", "n.trigger",
        "CASE n.row WHEN 0 THEN 'Base Game Path' ELSE 'Free Game Path' END AS row_label")


def node_images(layout: DataFrame, images: DataFrame) -> DataFrame:
    """Images of each node: ``img_count`` from ``img_index`` of the category's list.

    ``images`` has video_id, category, frame_idx and the one-based place ``pos``.
    """
    nodes = layout.selectExpr("video_id", "node_id", "category", "img_index", "img_count")
    return nodes.join(images.withColumnRenamed("pos", "place"), ["video_id", "category"]).where(
        "place > img_index AND place <= img_index + img_count").select("video_id", "node_id", "category", "frame_idx", "place")


# --- cell maps --------------------------------------------------------------------------------
def motion_map(df: DataFrame, keys: list[str], row_id: str, cells: str) -> DataFrame:
    """Mean absolute change of consecutive samples and mean value per cell."""
    placed = position(df.selectExpr(*keys, row_id, f"{cells} AS cells_"), keys, row_id, "at_").drop(row_id)
    before = placed.selectExpr(*keys, "at_ + 1 AS at_", "cells_ AS before_")
    long = placed.join(before, [*keys, "at_"], "left").selectExpr(
        *keys, "posexplode(zip_with(cells_, coalesce(before_, transform(cells_, c -> CAST(NULL AS FLOAT))), (c, b) -> named_struct('c', c, 'b', b))) AS (cell, v)")
    return long.groupBy(*keys, "cell").agg(F.expr("avg(abs(CAST(v.c AS DOUBLE) - CAST(v.b AS DOUBLE)))").alias("motion"),
                                           F.expr("avg(CAST(v.c AS DOUBLE))").alias("average"))


def projection(df: DataFrame, keys: list[str], cells: str, columns: int, axis: str) -> DataFrame:
    """Means per column (``x``) or row (``y``) of cell grids."""
    long = df.selectExpr(*keys, f"posexplode({cells}) AS (cell, v)")
    place = f"cell % {columns}" if axis == "x" else f"CAST(floor(cell / {columns}) AS INT)"
    return long.groupBy(*keys, F.expr(place).alias(axis)).agg(F.expr("avg(CAST(v AS DOUBLE))").alias("mean"))


def order_statistics(df: DataFrame, keys: list[str], value: str, share: float, bins: int = 256) -> DataFrame:
    """Exact percentile per key (between the two nearest ranks in proportion), without sorting a key: ``quantile``, ``peak``.

    Every round counts the values of the open range in ``bins`` equal parts and goes
    on with the part that holds the rank, between the least and the greatest value
    found in it, until that is one value.  All that is shuffled are counts.
    """
    rows = df.selectExpr(*keys, f"CAST({value} AS DOUBLE) AS v_").where("v_ IS NOT NULL")
    ends = durable(rows.groupBy(*keys).agg(F.count("*").alias("n_"), F.min("v_").alias("lo"), F.max("v_").alias("hi")).selectExpr("*", f"{share}D * (n_ - 1) AS at_"))
    k = ", ".join(keys)
    open_ = ends.selectExpr(*keys, "explode(array_distinct(array(CAST(floor(at_) AS BIGINT), CAST(ceil(at_) AS BIGINT)))) AS rank_", "lo", "hi", "0L AS below")
    found = None
    while True:
        open_ = durable(open_)
        settled = open_.where("lo = hi").selectExpr(*keys, "rank_", "lo AS v_")
        found = settled if found is None else found.unionByName(settled)
        rest = open_.where("lo < hi")
        if rest.isEmpty():
            break
        inside = join_small(rows, rest, keys, "v_").where("v_ BETWEEN lo AND hi").selectExpr(
            "*", f"CAST(least(floor((v_ - lo) / (hi - lo) * {bins}), {bins - 1}) AS INT) AS bin")
        parts = inside.groupBy(*keys, "rank_", "below", "bin").agg(F.count("*").alias("c"), F.min("v_").alias("lo"), F.max("v_").alias("hi"))
        upto = parts.selectExpr("*", f"below + sum(c) OVER (PARTITION BY {k}, rank_ ORDER BY bin) AS upto")
        open_ = upto.where("upto > rank_ AND upto - c <= rank_").selectExpr(*keys, "rank_", "lo", "hi", "upto - c AS below")
    pair = found.groupBy(*keys).agg(F.expr("min_by(v_, rank_)").alias("a_"), F.expr("max_by(v_, rank_)").alias("b_"))
    return ends.join(pair, keys).selectExpr(*keys, "a_ + (b_ - a_) * (at_ - floor(at_)) AS quantile", "hi AS peak")


def profile_threshold(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Larger of the 72nd percentile and 0.38 of the maximum of a profile."""
    return order_statistics(df, keys, value, 0.72).selectExpr(*keys, "quantile AS p72", "peak", "greatest(quantile, peak * 0.38D) AS threshold")


def run_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("video_id").agg(F.count(F.lit(1)).alias("saved"), F.expr("count_if(keep)").alias("kept"), F.min("frame_idx").alias("first_frame"),
                                      F.max("frame_idx").alias("last_frame"), F.countDistinct("category").alias("categories"))
