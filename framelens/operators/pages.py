"""Paytable page detection, page choice and box operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scores as V
from ..functions.signals import game_rules_text, reason_count
from ..functions.text import both, either, lit, some_term
from ..functions.vectors import box_area, box_iou
from ..session import durable
from .greedy import greedy_keep, walk_kept
from .windows import SEGMENT, running, split_by_size, top_k


def has_reason(reasons: str, prefix: str) -> str:
    return f"exists({reasons}, r -> startswith(r, {lit(prefix)}))"


def with_page_scores(df: DataFrame) -> DataFrame:
    """Add visual and text page scores with their reasons; needs ``page_text``."""
    visual, text = V.paytable_visual_terms("roi_h"), V.paytable_text_terms("page_text")
    df = df.selectExpr("*", f"round({V.total(visual)}, 6) AS visual_score", f"{V.reasons(visual)} AS visual_reasons",
                       f"round({V.total(text)}, 6) AS text_score", f"{V.reasons(text)} AS text_reasons")
    return df.selectExpr("*", f"{icon_count()} AS icons")


def prefilter() -> str:
    """Cheap visual test in front of text recognition."""
    dark, some = has_reason("visual_reasons", "dark_help_bg"), has_reason("visual_reasons", "some_icon_components")
    return either(["visual_score >= 2.0D", both("visual_score >= 1.6D", "array_contains(visual_reasons, 'yellow_payout_text')", dark),
                   both("visual_score >= 0.5D", some, dark)])


def icon_count() -> str:
    """Icon components named by the visual reasons."""
    codes = "transform(visual_reasons, r -> regexp_replace(r, '^some_', ''))"
    return reason_count(codes, "icon_components")


def is_paytable_page(with_text: bool = True) -> str:
    """Page decision from the two scores and their reasons."""
    if not with_text:
        return both(prefilter(), "visual_score >= 4.6D")
    t = "page_text"
    modal = either([some_term(t, ["buy feature", "feature buy"]), both(f"contains({t}, 'cost')", f"contains({t}, 'quantity')")])
    title, multi = some_term(t, R.PAYOUT_TITLE_TERMS), some_term(t, ["multiplier symbol"])
    word = rf"{t} RLIKE r'\bpay\s*table\b'"
    rules, total, icons = game_rules_text(t), "(text_score + visual_score)", "icons"
    values = either(has_reason("text_reasons", p) for p in ("many_numbers", "payout_pairs", "full_values"))
    symbols = "(array_contains(text_reasons, 'wild_scatter_terms') OR array_contains(text_reasons, 'multiplier_symbols'))"
    strong = both("text_score >= 4.0D", "visual_score >= 3.0D", f"{total} >= 7.0D")
    ways = either([
        both(title, f"{total} >= 5.5D"), both(multi, f"{total} >= 4.8D"), strong,
        both(word, values, f"(({icons} >= 8 AND {total} >= 5.5D) OR ({icons} >= 4 AND {total} >= 4.3D))"),
        both(word, symbols, "array_contains(visual_reasons, 'yellow_payout_text')", f"{total} >= 4.0D"),
        both(f"{icons} >= 4", "visual_score >= 4.0D", f"NOT {rules}")])
    plain_rules = both(rules, f"NOT {either([title, multi, word])}", "visual_score < 4.0D")
    return both(prefilter(), f"NOT {modal}", f"NOT {plain_rules}", ways)


def strong_secondary() -> str:
    """Pages outside the main folder that may enter the choice; reads ``page_score`` and ``page_reasons``."""
    word = "array_contains(page_reasons, 'paytable_word')"
    wild, multi = "array_contains(page_reasons, 'wild_scatter_terms')", "array_contains(page_reasons, 'multiplier_symbols')"
    values = either(has_reason("page_reasons", p) for p in ("many_numbers", "payout_pairs", "full_values"))
    explained = both(wild, "array_contains(page_reasons, 'yellow_payout_text')")
    standard = both("page_score >= 4.0D", word, f"({wild} OR {multi} OR icons >= 4)", f"({values} OR {explained})")
    scrolled = both("page_score >= 3.0D", "icons >= 4", values, f"NOT {word}")
    return either([standard, scrolled])


def strong_symbol_page() -> str:
    values = either(has_reason("page_reasons", p) for p in ("many_numbers", "payout_pairs", "full_values"))
    return both("page_score >= 9.5D", "(array_contains(page_reasons, 'symbol_payout_title') OR array_contains(page_reasons, 'paytable_word'))",
                "(array_contains(page_reasons, 'wild_scatter_terms') OR array_contains(page_reasons, 'multiplier_symbols'))", values)


def select_pages(scored: DataFrame, max_pages: int = 72) -> DataFrame:
    """Pages per video: an even backbone of primary pages plus reserved room for strong secondary ones.

    ``scored`` has video_id, pos (unique integer order), name, secondary, page (decision), page_score, page_reasons, icons.
    """
    # Written once in narrow form: the choice reads it in several branches, and a filter
    # on ``page`` would otherwise be pushed down with all the rules behind it expanded.
    scored = durable(scored.selectExpr("video_id", "pos", "name", "secondary", "page", f"{strong_secondary()} AS strong",
                                       f"{strong_symbol_page()} AS repeatable")).where("page")
    sizes = scored.groupBy("video_id").agg(F.expr("count_if(NOT secondary)").alias("n_primary"), F.expr("count_if(secondary AND strong)").alias("n_strong"))
    room = max(8, max_pages // 3)
    plan = sizes.selectExpr("video_id", f"least(n_strong, {room}) AS take_second",
                            f"CASE WHEN n_primary > 0 THEN {max_pages} - least(n_strong, {room}) ELSE 0 END AS take_first",
                            "n_primary = 0 AND n_strong = 0 AS fallback")
    rows = scored.join(plan, "video_id")

    # every page belongs to one turn: the backbone, the reserved room, or the fallback of videos without either
    turn = "CASE WHEN NOT secondary THEN 0 WHEN strong THEN 1 WHEN fallback THEN 0 END"
    limit = f"CASE WHEN fallback THEN {max_pages} WHEN secondary THEN take_second ELSE take_first END"
    offered = rows.selectExpr("video_id", "pos", "name", "repeatable", f"{turn} AS turn", f"{limit} AS take").where("turn IS NOT NULL")
    picked = even_sample_by(offered, ["video_id", "turn"], "pos", "take")
    first = picked.selectExpr("*", "row_number() OVER (PARTITION BY video_id, name ORDER BY turn, pos) AS seen_")
    unique = first.where("seen_ = 1 OR repeatable")
    return top_k(unique, ["video_id"], "pos", max_pages, "page_rank").select("video_id", "pos", "name", "page_rank")


def even_sample_by(df: DataFrame, group: list[str], pos: str, limit: str) -> DataFrame:
    """Even sample with a per-group limit column (at most a few dozen pages)."""
    placed = running(df, group, pos, "1L", "sum", "position", inclusive=False)
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("size_"), F.expr(f"max({limit})").alias("limit_"))
    wanted = sizes.where("size_ > limit_ AND limit_ > 0").selectExpr(*group, "explode(sequence(0, CAST(limit_ AS INT) - 1)) AS i", "size_", "limit_").selectExpr(
        *group, "CAST(bround(i * CASE WHEN limit_ > 1 THEN (size_ - 1) / CAST(limit_ - 1 AS DOUBLE) ELSE 1.0D END, 0) AS BIGINT) AS position").distinct()
    small = placed.join(sizes.where("size_ <= limit_"), group).drop("size_", "limit_")
    return small.unionByName(placed.join(wanted, [*group, "position"]).select(small.columns)).drop("position")


def page_decisions(scanned: DataFrame, selected: DataFrame) -> DataFrame:
    """Every scanned page with its decision."""
    marks = selected.selectExpr("video_id", "pos", "true AS chosen_")
    return scanned.join(marks, ["video_id", "pos"], "left").selectExpr("video_id", "pos", "chosen_ IS NOT NULL AS selected")


# --- boxes ------------------------------------------------------------------------------------
def suppress_boxes(df: DataFrame, keys: list[str], box_id: str, threshold: float = 0.42, batch: int = 256) -> DataFrame:
    """Boxes kept by area-descending suppression; ``df`` has x1, y1, x2, y2.

    A page's first ``batch`` boxes are walked inside a row.  What they leave of a larger
    page is keyed by the grid cells a box touches: boxes alike at the threshold
    have areas alike as well, so they meet in the grid of the larger one's size.
    """
    rows = df.selectExpr(*keys, box_id, "x1", "y1", "x2", "y2", "greatest(0.0D, x2 - x1) * greatest(0.0D, y2 - y1) AS area")
    # levels apart that areas of ratio ``threshold`` can be
    levels = math.ceil(math.log2(1 / threshold) / 2) + 1

    def cells(part: DataFrame) -> DataFrame:
        """A row for each cell touched, in the grid of the box's own size and those of larger ones; boxes without area overlap nothing."""
        sized = part.where("r.x2 > r.x1 AND r.y2 > r.y1").selectExpr("part", "node", "r", f"CAST(ceil(log2({box_area('r')}) / 2) AS INT) AS own")
        at = sized.selectExpr("*", f"explode(sequence(own, own + {levels})) AS level").selectExpr("*", "pow(2.0D, level) AS side")
        across = at.selectExpr("*", "explode(sequence(CAST(floor(r.x1 / side) AS BIGINT), CAST(floor(r.x2 / side) AS BIGINT))) AS cx")
        return across.selectExpr("*", "explode(sequence(CAST(floor(r.y1 / side) AS BIGINT), CAST(floor(r.y2 / side) AS BIGINT))) AS cy")

    def beyond(part: DataFrame) -> DataFrame:
        touched = durable(cells(part))
        keyed = touched.selectExpr("xxhash64(part, level, cx, cy) AS key", "part", "node")
        met = durable(keyed.join(keyed.groupBy("key").count().where("count > 1").select("key"), "key").distinct())

        def verify(asked: DataFrame) -> DataFrame:
            x, y = (part.selectExpr("part", f"node AS {c}", f"r AS {c}_") for c in "ab")
            return asked.join(x, ["part", "a"]).join(y, ["part", "b"]).where(f"{box_iou('a_', 'b_')} >= {threshold}D").select("part", "a", "b")

        def conflicts(open_: DataFrame) -> DataFrame:
            left = touched.join(open_, ["part", "node"], "left_semi")
            same = " AND ".join(f"a.{c} = b.{c}" for c in ("part", "level", "cx", "cy"))
            # in the grid of the larger box, at the cell of the intersection's corner: once
            once = "a.level = greatest(a.own, b.own) AND a.cx = floor(greatest(a.r.x1, b.r.x1) / a.side) AND a.cy = floor(greatest(a.r.y1, b.r.y1) / a.side)"
            return left.alias("a").join(left.alias("b"), F.expr(f"{same} AND a.node < b.node")).where(f"{once} AND {box_iou('a.r', 'b.r')} >= {threshold}D").selectExpr(
                "a.part AS part", "a.node AS a", "b.node AS b")

        return walk_kept(part, met, verify, conflicts)

    return greedy_keep(rows, keys, box_id, ["area DESC", box_id], ["x1", "y1", "x2", "y2"], f"{box_iou('k', 'r')} >= {threshold}D", batch=batch, beyond=beyond)


def merge_stacked(df: DataFrame, boxes: str, image_w: float, image_h: float) -> DataFrame:
    """Unions of vertically neighbouring boxes of one page row.

    ``boxes`` is the page's array of structs (i, x, y, w, h) in reading order of
    detection; only qualifying pairs leave the row.
    """
    pair = f"""named_struct('i', a.i, 'j', b.i, 't', CASE WHEN a.y <= b.y THEN a ELSE b END, 'u', CASE WHEN a.y <= b.y THEN b ELSE a END)"""
    big = f"filter({boxes}, a -> a.w >= {image_w * 0.16}D AND a.h >= {image_h * 0.055}D)"
    other = f"filter({boxes}, b -> b.i <> a.i AND b.w >= {image_w * 0.16}D AND b.h >= {image_h * 0.045}D)"
    close = ("p.u.y - (p.t.y + p.t.h) <= greatest(10, floor(least(p.t.h, p.u.h) * 0.28D)) AND "
             "greatest(0, least(p.t.x + p.t.w, p.u.x + p.u.w) - greatest(p.t.x, p.u.x)) / greatest(1.0D, least(p.t.w, p.u.w)) >= 0.58D")
    pairs = f"filter(flatten(transform({big}, a -> transform({other}, b -> {pair}))), p -> {close})"
    union = ("transform(%s, p -> named_struct('i', p.i, 'j', p.j, 'x', least(p.t.x, p.u.x), 'y', least(p.t.y, p.u.y), "
             "'w', greatest(p.t.x + p.t.w, p.u.x + p.u.w) - least(p.t.x, p.u.x), 'h', greatest(p.t.y + p.t.h, p.u.y + p.u.h) - least(p.t.y, p.u.y), "
             "'tall', greatest(p.t.h, p.u.h)))") % pairs
    keep = [f"`{c}`" for c in df.columns if c != boxes]
    fits = f"h <= {image_h * 0.34}D AND w <= {image_w * 0.38}D AND h >= tall * 1.10D"
    return df.selectExpr(*keep, f"inline({union})").where(fits).drop("tall")


# --- collection budgets ----------------------------------------------------------------------------
def round_robin(df: DataFrame, group: list[str], page: str, pos: str, cap: int | None = 1200) -> DataFrame:
    """i-th row of every page before the (i+1)-th of any, at most ``cap`` rows per group (None: all)."""
    rows = top_k(df, [*group, page], pos, cap, "turn")
    return top_k(rows, group, f"turn, {page}, {pos}", cap, "collect_rank")


def sequential_budget(df: DataFrame, group: list[str], page: str, pos: str, cap: int | None = 40) -> DataFrame:
    """Whole pages in order until the cap (None: all); pages of an even count of at least 8 go first if there are any."""
    sizes = df.groupBy(*group, page).agg(F.count(F.lit(1)).alias("n_page"))
    any_even = sizes.groupBy(*group).agg(F.expr("bool_or(n_page % 2 = 0 AND n_page >= 8)").alias("has_even"))
    chosen = sizes.join(any_even, group).where("NOT has_even OR (n_page % 2 = 0 AND n_page >= 8)").select(*group, page)
    rows = top_k(df, [*group, page], pos, cap, "on_page").join(chosen, [*group, page], "left_semi")
    return top_k(rows, group, f"{page}, {pos}", cap, "collect_rank").drop("on_page")


# --- profiles (already aggregated: one row per position of a bounded axis) ------------------------------
def longest_active_interval(df: DataFrame, keys: list[str], pos: str, value: str, must_min: int, must_max: int, ratio: float = 0.12,
                            gap: int = 18) -> DataFrame:
    """First and last position of the active part of a profile.

    Active means at least ``ratio`` of the maximum or inside the forced range;
    closing small gaps does not move the ends, so the ends are the extreme
    active positions.
    """
    peaks = df.groupBy(*keys).agg(F.max(value).alias("peak_"), F.max(pos).alias("last_"), F.min(pos).alias("first_"))
    active = f"({value} >= peak_ * {ratio}D OR {pos} BETWEEN greatest({must_min}, first_) AND least({must_max}, last_))"
    return df.join(peaks, keys).groupBy(*keys).agg(
        F.expr(f"CASE WHEN max(peak_) <= 0 THEN min({pos}) ELSE min(CASE WHEN {active} THEN {pos} END) END").alias("interval_start"),
        F.expr(f"CASE WHEN max(peak_) <= 0 THEN max({pos}) ELSE max(CASE WHEN {active} THEN {pos} END) END").alias("interval_end"))


def true_runs(df: DataFrame, keys: list[str], pos: str, flag: str) -> DataFrame:
    """Runs of consecutive positions whose flag holds: start, end and length."""
    hits = df.where(flag).selectExpr(*keys, pos, f"{pos} - row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {pos}) AS run_")
    return hits.groupBy(*keys, "run_").agg(F.min(pos).alias("run_start"), F.max(pos).alias("run_end"), F.count(F.lit(1)).alias("length")).drop("run_")


def largest_true_run(df: DataFrame, keys: list[str], pos: str, flag: str) -> DataFrame:
    """Longest run, first on ties."""
    best = true_runs(df, keys, pos, flag).groupBy(*keys).agg(F.expr("max_by(struct(run_start, run_end), struct(length, -run_start)) AS b"))
    return best.selectExpr(*keys, "b.run_start", "b.run_end")


def moving_average(keys: list[str], pos: str, value: str, k: int) -> str:
    """Centred mean over an odd window with zeros outside (expression)."""
    k = max(3, k) + (1 - max(3, k) % 2)
    h = k // 2
    return f"sum({value}) OVER (PARTITION BY {', '.join(keys)} ORDER BY {pos} ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) / {k}.0D"


def local_maxima(df: DataFrame, keys: list[str], pos: str, value: str, min_height: float) -> DataFrame:
    """Strict local maxima of at least ``min_height``."""
    w = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {pos})"
    return (df.selectExpr(*keys, pos, value, f"lag({value}) {w} AS before_", f"lead({value}) {w} AS after_")
            .where(f"{value} > before_ AND {value} > after_ AND {value} >= {min_height}D").drop("before_", "after_"))


def spaced_peaks(maxima: DataFrame, keys: list[str], pos: str, value: str, min_dist: int, small: int = 1 << 16) -> DataFrame:
    """Left-to-right spacing: a close maximum replaces the last peak when it is taller.

    Profiles of at most ``small`` maxima fold inside a row.  In longer ones every
    maximum gets the one that would follow it as the last peak: the first taller one
    closer than ``min_dist``, else the first that is not closer.  What the walk visits
    is then found by jumps of doubling length, from the maxima with none close before them.
    """
    few, many = split_by_size(maxima, keys, small)
    folded = _folded_peaks(few, keys, pos, value, min_dist)
    return folded if many is None else folded.unionByName(_linked_peaks(many, keys, pos, value, min_dist))


def _linked_peaks(maxima: DataFrame, keys: list[str], pos: str, value: str, min_dist: int, width: int = SEGMENT) -> DataFrame:
    k, far = ", ".join(keys), 2 * min_dist
    rows = maxima.selectExpr(*keys, f"CAST({pos} AS BIGINT) AS p", f"CAST({value} AS DOUBLE) AS v")
    # segments of the axis with what lies within reach on both sides; a window holds at most that reach
    near = rows.selectExpr("*", f"explode(sequence(CAST(floor((p - {far}) / {width}) AS BIGINT), CAST(floor((p + {far}) / {width}) AS BIGINT))) AS seg")
    line = f"OVER (PARTITION BY {k}, seg ORDER BY p RANGE BETWEEN"
    seen = near.selectExpr("*", f"count(*) {line} {min_dist - 1} PRECEDING AND 1 PRECEDING) AS close_", f"collect_list(struct(p, v)) {line} 1 FOLLOWING AND {far} FOLLOWING) AS ahead")
    own = seen.where(f"seg = floor(p / {width})")
    following = f"array_min(transform(filter(ahead, x -> x.v > v OR x.p - p >= {min_dist}), x -> x.p))"
    nodes = durable(own.selectExpr(*keys, "p", "v", "close_ = 0 AS root", f"{following} AS nxt"))
    visited, jumps = nodes.where("root").select(*keys, "p"), nodes.where("nxt IS NOT NULL").select(*keys, "p", "nxt")
    n = visited.count()
    while True:
        visited = durable(visited.unionByName(visited.join(jumps, [*keys, "p"]).select(*keys, F.col("nxt").alias("p"))).distinct())
        before, n = n, visited.count()
        if n == before:
            break
        onward = jumps.select(*keys, F.col("p").alias("nxt"), F.col("nxt").alias("then_"))
        jumps = durable(jumps.join(onward, [*keys, "nxt"]).select(*keys, "p", F.col("then_").alias("nxt")))
    # a visited peak stays unless a close one takes its place
    return nodes.join(visited, [*keys, "p"], "left_semi").where(f"nxt IS NULL OR nxt - p >= {min_dist}").selectExpr(*keys, f"p AS {pos}", f"v AS {value}")


def _folded_peaks(maxima: DataFrame, keys: list[str], pos: str, value: str, min_dist: int) -> DataFrame:
    walk = maxima.groupBy(*keys).agg(F.expr(f"array_sort(collect_list(struct({pos} AS p, CAST({value} AS DOUBLE) AS v))) AS walk"))
    far = f"size(acc) = 0 OR m.p - element_at(acc, -1).p >= {min_dist}"
    swap = "m.v > element_at(acc, -1).v"
    kind = walk.schema["walk"].dataType.simpleString()
    fold = (f"aggregate(walk, CAST(array() AS {kind}), (acc, m) -> CASE WHEN {far} THEN concat(acc, array(m)) "
            f"WHEN {swap} THEN concat(slice(acc, 1, size(acc) - 1), array(m)) ELSE acc END)")
    return walk.selectExpr(*keys, f"inline({fold})").selectExpr(*keys, f"p AS {pos}", f"v AS {value}")


def valleys_between(df: DataFrame, peaks: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """Lowest position between neighbouring peaks, first on ties."""
    spans = peaks.selectExpr(*keys, f"{pos} AS left_", f"lead({pos}) OVER (PARTITION BY {', '.join(keys)} ORDER BY {pos}) AS right_").where("right_ IS NOT NULL")
    inside = df.join(spans, keys).where(f"{pos} BETWEEN left_ AND right_")
    return inside.groupBy(*keys, "left_", "right_").agg(F.expr(f"min_by({pos}, struct({value}, {pos}))").alias("valley")).withColumnsRenamed(
        {"left_": "left_peak", "right_": "right_peak"})
