"""Icon candidates: measured-column rule chains, hashing and grouping."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import icon_quality
from ..functions.text import lit
from ..functions.vectors import hamming, mean_abs_diff
from ..session import durable
from .greedy import hamming_leaders, join_small
from .windows import position


def payout_stack_score(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Longest vertical stack of text-sized parts in the right half, plus text density.

    Counts per 16-pixel column first, so an icon with very many parts is
    pre-aggregated before its maximum is taken.
    """
    right = ((F.col("x") >= F.col("icon_w") * 0.52) & F.col("area").between(4, 300)
             & F.col("w").between(2, 30) & F.col("h").between(4, 36))
    columns = parts.groupBy(*keys, F.floor(F.col("x") / 16).alias("column")).agg(
        F.count_if(right).alias("n"), F.max("density").alias("density"), F.max("icon_w").alias("icon_w"), F.max("icon_h").alias("icon_h"))
    whole = columns.groupBy(*keys).agg(F.sum("n").alias("total"), F.max("n").alias("longest"), F.max("density").alias("density"),
                                       F.max("icon_w").alias("icon_w"), F.max("icon_h").alias("icon_h"))
    shown = (F.col("icon_w") >= 58) & (F.col("icon_h") >= 34) & (F.col("total") >= 2)
    return whole.withColumn("score", F.when(shown, F.col("longest") + F.col("density") * 20.0).otherwise(0.0))


# --- rule chains over measured columns (expressions) -----------------------------------------
def chain(rules: list[tuple[str, str]], default: str = "ok") -> str:
    """Reason of the first rule that holds."""
    return "CASE " + " ".join(f"WHEN {cond} THEN {lit(reason)}" for cond, reason in rules) + f" ELSE {lit(default)} END"


_ASPECT = "(icon_w / greatest(icon_h, 1))"
_COLOURED = "(yellow_fill + white_fill + red_fill)"
_SHORT, _LONG = "least(icon_w, icon_h)", "greatest(icon_w, icon_h)"


def candidate_reason() -> str:
    """Early validity of a crop; ``ok`` or the first failing rule."""
    badge = f"({_SHORT} >= 64 AND {_ASPECT} <= 1.45D AND fg_ratio >= 0.45D AND colourful_ratio >= 0.10D AND white_ratio >= 0.10D)"
    a = _ASPECT
    return chain([
        ("icon_w < 22 OR icon_h < 22", "too_small"),
        (f"{a} < 0.38D OR {a} > 2.25D", "bad_aspect"),
        (f"icon_w < 58 AND icon_h < 44 AND {a} > 1.22D", "flat_symbol_fragment"),
        ("fg_ratio < 0.055D", "empty_or_text_sliver"),
        ("colourful_ratio < 0.010D AND very_bright < 0.020D AND fg_ratio < 0.070D", "low_colour"),
        (f"{a} > 1.42D AND icon_h <= 54 AND fg_ratio < 0.16D AND (yellow_text_ratio > 0.025D OR white_ratio > 0.030D)", "payout_number_strip"),
        (f"NOT {badge} AND art_ratio < 0.040D AND colourful_ratio < 0.28D AND (yellow_text_ratio > 0.045D OR ({a} > 1.55D AND very_bright > 0.035D) "
         f"OR ({a} > 1.35D AND icon_h <= 48 AND very_bright > 0.035D))", "payout_number"),
        ("text_ratio > 0.045D AND art_ratio < 0.050D AND fg_ratio < 0.22D", "payout_text_only"),
        (f"NOT {badge} AND yellow_text_ratio > 0.030D AND art_ratio < 0.030D AND colourful_ratio < 0.18D", "yellow_number_only"),
        (f"{_SHORT} <= 42 AND {_LONG} <= 56 AND art_ratio < 0.045D AND colourful_ratio < 0.18D", "small_payout_text"),
        (f"white_ratio > 0.14D AND colourful_ratio < 0.08D AND (icon_w < 34 OR icon_h < 36 OR {a} > 1.85D)", "white_text_fragment"),
        ("icon_w < 42 AND icon_h < 62 AND colourful_ratio < 0.30D AND (very_bright > 0.08D OR white_ratio > 0.08D OR yellow_text_ratio > 0.035D)", "small_text_fragment"),
        ("fg_ratio > 0.42D AND colourful_ratio < 0.10D AND colour_spread < 18", "text_block"),
        ("icon_h > icon_w * 1.55D AND colourful_ratio < 0.12D", "payout_column"),
        ("icon_w > icon_h * 1.85D AND colourful_ratio < 0.12D", "text_label"),
    ])


def text_only_reason() -> str:
    """Export-time text test; a shorter list with a text-coverage badge."""
    badge = f"({_SHORT} >= 64 AND {_ASPECT} <= 1.45D AND fg_ratio >= 0.45D AND colourful_ratio >= 0.10D AND text_ratio >= 0.10D)"
    return chain([
        ("icon_w < 22 OR icon_h < 22", "too_small"), ("fg_ratio < 0.055D", "empty_or_text_sliver"),
        ("text_ratio > 0.045D AND art_ratio < 0.050D AND fg_ratio < 0.22D", "payout_text_only"),
        (f"NOT {badge} AND yellow_text_ratio > 0.030D AND art_ratio < 0.030D AND colourful_ratio < 0.18D", "yellow_number_only"),
        (f"{_ASPECT} > 1.35D AND icon_h <= 54 AND text_ratio > 0.030D AND art_ratio < 0.045D", "payout_number_strip")])


def quality_reason() -> str:
    """Quality exits in order; reasons that start with ``ok`` accept."""
    edge = "edge_touches >= 3 AND content_ratio < 0.55D"
    return chain([
        ("content_ratio < 0.085D", "low_content_text_scrap"), ("icon_score < 0.52D", "low_quality_fragment"),
        (f"{edge} AND content_ratio >= 0.40D AND {_COLOURED} >= 0.045D AND {_SHORT} >= 70", "ok_coloured_edge_icon"),
        (edge, "clipped_fragment"), (f"{_SHORT} < 42", "too_thin_fragment"),
        ("icon_w < 48 AND icon_h > 70 AND icon_score < 0.86D", "vertical_fragment"),
        (f"icon_h < 46 AND icon_score < 0.86D AND icon_h >= 40 AND content_ratio >= 0.50D AND {_COLOURED} >= 0.045D", "ok_coloured_short_icon"),
        ("icon_h < 46 AND icon_score < 0.86D", "horizontal_fragment")])


def final_reason() -> str:
    """Exits of the final set in order; reasons that start with ``ok`` accept."""
    aspect = "(bbox_w / greatest(1.0D, bbox_h))"
    full = "(red_fill > 0.025D OR yellow_fill > 0.025D OR white_fill > 0.014D)"
    bleed, clipped = f"edge_touches >= 3 AND content_ratio > 0.60D AND NOT {full}", "edge_touches >= 3 AND content_ratio < 0.50D"
    return chain([
        ("icon_score < 0.60D", "final_low_score"),
        (f"{_COLOURED} < 0.012D AND content_ratio < 0.18D AND {_LONG} <= 72", "final_text_number_fragment"),
        (f"content_ratio < 0.105D AND icon_score >= 0.74D AND {_LONG} >= 95 AND {_SHORT} >= 45", "ok_large_low_content_symbol"),
        ("content_ratio < 0.105D", "final_low_content"),
        (f"{_SHORT} < 50 AND {_SHORT} >= 40 AND content_ratio >= 0.45D AND {_COLOURED} >= 0.045D", "ok_coloured_small_icon"),
        (f"{_SHORT} < 50", "final_too_small"), (f"{aspect} < 0.32D OR {aspect} > 2.45D", "final_bad_aspect"),
        ("bbox_x > icon_w * 0.42D OR bbox_y > icon_h * 0.40D", "final_partial_symbol"),
        ("yellow_fill > 0.060D AND white_fill > 0.015D AND red_fill < 0.010D AND content_ratio > 0.50D", "final_question_overlay"),
        (f"{bleed} AND icon_score >= 0.56D AND {_SHORT} >= 42", "ok_full_bleed_symbol"), (bleed, "final_full_rect_fragment"),
        (f"{clipped} AND content_ratio >= 0.40D AND {_COLOURED} >= 0.045D AND {_SHORT} >= 70", "ok_coloured_edge_icon"),
        (clipped, "final_likely_clipped"), (f"edge_touches >= 2 AND icon_score < 0.82D AND NOT {full}", "final_edge_clipped"),
        ("components >= 9 AND content_ratio < 0.22D", "final_noisy_fragment"),
        (f"bbox_h <= 45 AND content_ratio < 0.18D AND {_COLOURED} < 0.022D AND icon_score < 0.92D", "final_thin_symbol_fragment"),
        (f"bbox_h <= 50 AND content_ratio < 0.24D AND {_COLOURED} < 0.018D AND icon_score < 0.90D", "final_low_art_symbol_fragment")])


LARGE_PAGE = "(source_w >= 950 AND source_h >= 780)"
TRUSTED_BOX = ("(NOT is_secondary AND (abs(box_x - 72) <= 16 OR abs(box_x - 232) <= 16 OR abs(box_x - 390) <= 16 OR abs(box_x - 544) <= 16) "
               "AND abs(box_y - 216) <= 10 AND box_w BETWEEN 146 AND 168 AND box_h BETWEEN 100 AND 126)")


def portrait_reason() -> str:
    """Partial logo fragments of portrait pages."""
    page = "source_w BETWEEN 420 AND 700 AND source_h >= 760 AND source_w / greatest(source_h, 1) <= 0.85D"
    return chain([
        (f"{page} AND crop_kind = 'portrait_stacked_logo' AND red_fill >= 0.10D AND icon_h < 95 AND white_fill < 0.004D", "final_portrait_logo_fragment"),
        (f"{page} AND crop_kind = 'legacy_full_page' AND ((red_fill >= 0.05D AND edge_touches >= 2) OR (edge_touches >= 4 AND {_SHORT} >= 60 AND red_fill >= 0.035D))",
         "final_portrait_legacy_fragment")])


def full_page_reason() -> str:
    """Label and payout fragments of full-page crops; ``ok_full_tile_card`` accepts."""
    page = (f"({LARGE_PAGE} OR (source_h >= 850 AND source_h >= source_w * 1.35D) OR (source_w >= 950 AND source_h >= 520 "
            "AND source_w >= source_h * 1.45D AND crop_kind = 'legacy_full_page'))")
    box, crop = "(bbox_w / greatest(1.0D, bbox_h))", "(icon_w / greatest(1.0D, icon_h))"
    tile = (f"{crop} BETWEEN 0.55D AND 1.75D AND fg_ratio >= 0.30D AND white_tile_ratio >= 0.22D AND colourful_ratio >= 0.030D "
            "AND bbox_w >= icon_w * 0.55D AND bbox_h >= icon_h * 0.55D")
    return chain([
        (f"NOT {page}", "ok"),
        (f"bbox_h <= greatest(30, icon_h * 0.45D) AND {box} >= 1.55D AND text_ratio >= 0.035D", "final_full_page_text_row"),
        (f"{box} >= 1.45D AND fg_ratio < 0.09D AND text_ratio >= 0.020D", "final_full_page_sparse_text_row"),
        (f"{crop} >= 1.55D AND text_ratio >= 0.09D AND colourful_ratio < 0.30D", "final_full_page_label_bleed"),
        ("text_ratio >= 0.24D AND colourful_ratio <= 0.12D", "final_full_page_text_dominant_panel"),
        ("text_ratio >= 0.14D AND colourful_ratio <= 0.14D AND text_ratio >= colourful_ratio * 1.25D", "final_full_page_payout_text_panel"),
        (tile, "ok_full_tile_card"), (f"fg_ratio < 0.025D AND {crop} >= 1.25D", "final_full_page_sparse_background_text"),
        (f"fg_ratio < 0.055D AND {_LONG} >= 140", "final_full_page_background_fragment"),
        ("fg_ratio < 0.22D AND text_ratio >= 0.055D AND text_ratio >= colourful_ratio * 0.55D", "final_full_page_text_fragment")])


def payout_bleed(active: str) -> str:
    """Two neighbouring active rows in the lower part; ``active`` is an array of booleans."""
    return (f"(icon_w >= 42 AND icon_h >= 54 AND lower_text >= 0.035D AND upper_art >= 0.045D AND "
            f"exists(zip_with(slice({active}, 1, size({active}) - 1), slice({active}, 2, size({active}) - 1), (a, b) -> a AND b), p -> p))")


def allow_override(reason: str) -> str:
    """Reason that puts a rejected row back, or the reason itself.

    Order: tile crops, trusted boxes, low scores on primary pages, edge contact
    on primary pages, structured portrait crops.
    """
    soft = "'final_low_score', 'final_edge_clipped', 'final_likely_clipped', 'final_full_rect_fragment', 'final_too_small'"
    primary = f"NOT is_secondary AND NOT {LARGE_PAGE}"
    edges = "'clipped_fragment', 'horizontal_fragment', 'vertical_fragment', 'final_likely_clipped', 'final_edge_clipped', 'final_full_rect_fragment'"
    card = f"crop_kind = 'portrait_paytable_card' AND icon_score >= 0.72D AND {_SHORT} >= 42 AND content_ratio >= 0.38D"
    logo = f"crop_kind = 'portrait_stacked_logo' AND icon_score >= 0.48D AND {_SHORT} >= 42 AND content_ratio >= 0.12D AND {_COLOURED} >= 0.018D"
    return ("CASE " + " ".join(f"WHEN {c} THEN {lit(r)}" for c, r in [
        (f"crop_kind = 'mahjong_tile' AND {reason} IN ({soft})", "ok_mahjong_tile_crop"),
        (f"{TRUSTED_BOX} AND {reason} IN ({soft})", "ok_trusted_pp_paytable_crop"),
        (f"{reason} = 'final_low_score' AND {primary} AND icon_score >= 0.56D AND {_SHORT} >= 45 AND content_ratio >= 0.16D AND {_COLOURED} >= 0.035D",
         "ok_primary_paytable_low_score"),
        (f"{reason} IN ({edges}) AND {primary} AND icon_score >= 0.55D AND {_SHORT} >= 50 AND content_ratio >= 0.24D AND {_COLOURED} >= 0.030D",
         "ok_primary_paytable_edge_icon"),
        (f"{reason} IN ({soft}) AND (({card}) OR ({logo}))", "ok_structured_paytable_crop"),
    ]) + f" ELSE {reason} END")


def accepted(reason: str) -> str:
    return f"(({reason}) LIKE 'ok%')"


def quality_rank() -> str:
    """Completeness of a final candidate; ties go on by score, content and id."""
    return ("(least(1.0D, bbox_w / greatest(1.0D, icon_w)) * least(1.0D, bbox_h / greatest(1.0D, icon_h)) * 0.42D"
            f" + least(1.0D, content_ratio / 0.42D) * 0.24D + least(1.0D, {_SHORT} / 82.0D) * 0.20D + icon_score * 0.14D"
            " - least(0.35D, edge_touches * 0.10D) + CASE WHEN crop_kind = 'mahjong_tile' THEN least(1.0D, icon_h / 190.0D) * 0.26D"
            " + least(1.0D, icon_w / 180.0D) * 0.10D - CASE WHEN icon_h < 180 THEN 0.32D ELSE 0.0D END ELSE 0.0D END)")


def pixel_same(a: str, b: str, kind_a: str, kind_b: str, alpha_a: str, alpha_b: str) -> str:
    """Mean colour and alpha difference limits; stricter when both are card crops."""
    rgb, alpha = mean_abs_diff(a, b), mean_abs_diff(alpha_a, alpha_b)
    cards = f"({kind_a} = 'portrait_paytable_card' AND {kind_b} = 'portrait_paytable_card')"
    return f"(({rgb}) <= CASE WHEN {cards} THEN 0.014D ELSE 0.055D END AND ({alpha}) <= 0.018D)"


# --- grouping -------------------------------------------------------------------------------------
def near_duplicate_groups(df: DataFrame, keys: list[str], row_id: str, order: list[str], same: str, max_bits: int = 5) -> DataFrame:
    """Leader groups: in rank order join the first group whose best matches, else open one.

    ``df`` has ``hash`` (BIGINT) and the columns ``same`` reads as ``r.`` and ``k.``.
    """
    names = re.findall(r"\b[rk]\.(\w+)", same)
    payload = list(dict.fromkeys(names))
    return hamming_leaders(df, keys, row_id, order, payload, same, max_bits)


def best_of_group(df: DataFrame, keys: list[str], group: str, row_id: str, order: list[str]) -> DataFrame:
    """Members of every group with its representative, groups numbered by representative order.

    The long form (one row per member) holds groups of any size.
    """
    key = "struct(" + ", ".join(f"-({o[:-5]})" if o.endswith(" DESC") else o for o in order) + f", {row_id})"
    best = df.groupBy(*keys, group).agg(F.expr(f"min({key}) AS key_"), F.expr(f"min_by({row_id}, {key})").alias("best_id"), F.count(F.lit(1)).alias("n_members"))
    numbered = best.selectExpr(*keys, group, "best_id", "n_members", f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY key_) - 1 AS group_no")
    return join_small(df, numbered, [*keys, group], row_id).selectExpr(*keys, group, row_id, "group_no", "best_id", "n_members", f"{row_id} = best_id AS is_best")


def export_icons(df: DataFrame, keys: list[str], row_id: str, same: str) -> DataFrame:
    """Candidate filters, final filters, overrides, then grouping; one row per final member.

    ``df`` has the measured columns, ``hash`` and ``active_rows``.
    """
    kept = dict.fromkeys(re.findall(r"\br\.(\w+)", same))
    rows = df.selectExpr("*", f"{icon_quality()} AS icon_score")
    rows = rows.selectExpr(
        "*", f"{text_only_reason()} AS text_filter", f"{quality_reason()} AS raw_quality", f"{full_page_reason()} AS page_filter",
        f"{portrait_reason()} AS portrait_filter", f"{payout_bleed('active_rows')} AS bleeds", f"{TRUSTED_BOX} AS trusted",
        f"CASE WHEN crop_kind = 'mahjong_tile' AND crop_top <= 1 THEN 'final_mahjong_tile_source_edge_clipped' ELSE {final_reason()} END AS raw_final")
    rows = rows.selectExpr("*", f"{allow_override('raw_quality')} AS quality_filter", f"{allow_override('raw_final')} AS gated",
                           f"CASE WHEN bleeds THEN 'final_payout_text_bleed' WHEN NOT {accepted('page_filter')} THEN page_filter ELSE portrait_filter END AS context")
    # all reasons are columns of one pass; filters come after the narrow table is written,
    # so that they are not pushed below the rules with every rule expanded
    rows = durable(rows.selectExpr(*keys, row_id, "hash", "icon_score", "content_ratio", f"round({quality_rank()}, 9) AS completeness", "crop_kind",
                                   "text_filter", "quality_filter", "gated", "context", "trusted", *kept))
    tile_ok = ("crop_kind = 'mahjong_tile' AND context IN ('final_payout_text_bleed', 'final_full_page_text_dominant_panel', "
               "'final_full_page_payout_text_panel', 'final_full_page_text_fragment')")
    candidates = rows.where(f"text_filter = 'ok' AND ({accepted('quality_filter')} OR trusted) AND NOT (trusted AND icon_score < 0.35D)")
    final = candidates.where(f"{accepted('gated')} AND ({accepted('context')} OR ({tile_ok}))")
    groups = near_duplicate_groups(final, keys, row_id, ["completeness DESC", "icon_score DESC", "content_ratio DESC", f"{row_id} DESC"], same)
    return groups.join(final.select(*keys, row_id, "icon_score"), [*keys, row_id])


def best_by_name(df: DataFrame, name: str, score: str, row_id: str) -> DataFrame:
    """Best crop per lower-cased name of the playable rows; id from the name."""
    rows = df.where(f"playable AND tier <> 'skip' AND trim({name}) NOT IN ('', 'skip')").selectExpr("*", f"lower(trim({name})) AS name_key")
    best = rows.groupBy("name_key").agg(F.expr(f"max_by(struct({row_id}, tier, {score}), struct({score}, -{row_id})) AS b"))
    slug = "trim(BOTH '_' FROM regexp_replace(name_key, '[^a-z0-9]+', '_'))"
    return best.selectExpr("name_key", f"CASE WHEN {slug} = '' THEN concat('sym_', b.{row_id}) ELSE {slug} END AS symbol_id", f"b.{row_id}", "b.tier", f"b.{score}")


# fixed values: order of the symbol tiers
TIER_ORDER = ["scatter", "wild", "M1", "M2", "M3", "M4", "M5", "low"]


def tier_groups(df: DataFrame, tier: str, pos: str, order: list[str] | None = None) -> DataFrame:
    """Symbols in tier order with their place inside the tier; unknown tiers are left out."""
    names = order or TIER_ORDER
    place = "CASE " + tier + " " + " ".join(f"WHEN {lit(t)} THEN {i}" for i, t in enumerate(names)) + " END"
    rows = df.selectExpr("*", f"{place} AS tier_pos").where("tier_pos IS NOT NULL")
    return position(rows, ["tier_pos"], pos, "place")
