"""SQL twins of the icon rule chains, written as separate decisions over named measures.

Each twin lists its decisions in its own way (ranked rules of which the first
that holds is taken, or a nested choice), so that it can disagree with the
engine's expressions.
"""

from __future__ import annotations

# measures shared by the twins, over icons_fx and its quality score
MEASURES = """SELECT *, CASE WHEN icon_w < icon_h THEN icon_w ELSE icon_h END AS short_side, CASE WHEN icon_w > icon_h THEN icon_w ELSE icon_h END AS long_side,
  yellow_fill + white_fill + red_fill AS fills, icon_w::DOUBLE / greatest(icon_h, 1) AS shape, bbox_w::DOUBLE / CASE WHEN bbox_h > 1 THEN bbox_h ELSE 1 END AS bbox_shape,
  red_fill > 0.025 OR yellow_fill > 0.025 OR white_fill > 0.014 AS painted, source_w >= 950 AND source_h >= 780 AS large_page FROM icon_scored"""


def first_of(rules: list[tuple[str, str]], reason: str = "reason") -> str:
    """Reason of the lowest numbered rule that holds, by way of a minimum over numbered rows."""
    numbered = ", ".join(f"CASE WHEN {cond} THEN {n} END" for n, (_, cond) in enumerate(rules))
    names = ", ".join(f"'{name}'" for name, _ in rules)
    return f"coalesce(list_extract([{names}], 1 + list_min(list_filter([{numbered}], lambda v: v IS NOT NULL))), 'ok') AS {reason}"


CANDIDATE = first_of([
    ("too_small", "least(icon_w, icon_h) < 22"),
    ("bad_aspect", "shape NOT BETWEEN 0.38 AND 2.25"),
    ("flat_symbol_fragment", "shape > 1.22 AND icon_w < 58 AND icon_h < 44"),
    ("empty_or_text_sliver", "fg_ratio < 0.055"),
    ("low_colour", "fg_ratio < 0.07 AND colourful_ratio < 0.01 AND very_bright < 0.02"),
    ("payout_number_strip", "icon_h <= 54 AND shape > 1.42 AND fg_ratio < 0.16 AND greatest(yellow_text_ratio - 0.025, white_ratio - 0.03) > 0"),
    ("payout_number", "colourful_ratio < 0.28 AND art_ratio < 0.04 AND (yellow_text_ratio > 0.045 OR very_bright > 0.035 AND (shape > 1.55 OR shape > 1.35 AND icon_h <= 48)) "
                      "AND (short_side < 64 OR shape > 1.45 OR fg_ratio < 0.45 OR colourful_ratio < 0.1 OR white_ratio < 0.1)"),
    ("payout_text_only", "fg_ratio < 0.22 AND art_ratio < 0.05 AND text_ratio > 0.045"),
    ("yellow_number_only", "colourful_ratio < 0.18 AND art_ratio < 0.03 AND yellow_text_ratio > 0.03 "
                           "AND (short_side < 64 OR shape > 1.45 OR fg_ratio < 0.45 OR colourful_ratio < 0.1 OR white_ratio < 0.1)"),
    ("small_payout_text", "long_side <= 56 AND short_side <= 42 AND colourful_ratio < 0.18 AND art_ratio < 0.045"),
    ("white_text_fragment", "colourful_ratio < 0.08 AND white_ratio > 0.14 AND NOT (icon_w >= 34 AND icon_h >= 36 AND shape <= 1.85)"),
    ("small_text_fragment", "icon_h < 62 AND icon_w < 42 AND colourful_ratio < 0.3 AND NOT (very_bright <= 0.08 AND white_ratio <= 0.08 AND yellow_text_ratio <= 0.035)"),
    ("text_block", "colour_spread < 18 AND colourful_ratio < 0.1 AND fg_ratio > 0.42"),
    ("payout_column", "colourful_ratio < 0.12 AND icon_h > 1.55 * icon_w"),
    ("text_label", "colourful_ratio < 0.12 AND icon_w > 1.85 * icon_h")])

TEXT_ONLY = first_of([
    ("too_small", "least(icon_w, icon_h) < 22"), ("empty_or_text_sliver", "fg_ratio < 0.055"),
    ("payout_text_only", "fg_ratio < 0.22 AND art_ratio < 0.05 AND text_ratio > 0.045"),
    ("yellow_number_only", "colourful_ratio < 0.18 AND art_ratio < 0.03 AND yellow_text_ratio > 0.03 "
                           "AND (short_side < 64 OR shape > 1.45 OR fg_ratio < 0.45 OR colourful_ratio < 0.1 OR text_ratio < 0.1)"),
    ("payout_number_strip", "icon_h <= 54 AND shape > 1.35 AND art_ratio < 0.045 AND text_ratio > 0.03")])

QUALITY = """CASE WHEN content_ratio < 0.085 THEN 'low_content_text_scrap' WHEN icon_score < 0.52 THEN 'low_quality_fragment'
  WHEN edge_touches >= 3 AND content_ratio < 0.55 THEN CASE WHEN content_ratio >= 0.4 AND fills >= 0.045 AND short_side >= 70 THEN 'ok_coloured_edge_icon' ELSE 'clipped_fragment' END
  WHEN short_side < 42 THEN 'too_thin_fragment'
  WHEN icon_score >= 0.86 THEN 'ok'
  WHEN icon_w < 48 AND icon_h > 70 THEN 'vertical_fragment'
  WHEN icon_h >= 46 THEN 'ok' WHEN icon_h >= 40 AND content_ratio >= 0.5 AND fills >= 0.045 THEN 'ok_coloured_short_icon' ELSE 'horizontal_fragment' END AS reason"""

FINAL = """CASE WHEN icon_score < 0.6 THEN 'final_low_score'
  WHEN long_side <= 72 AND content_ratio < 0.18 AND fills < 0.012 THEN 'final_text_number_fragment'
  WHEN content_ratio < 0.105 THEN CASE WHEN short_side >= 45 AND long_side >= 95 AND icon_score >= 0.74 THEN 'ok_large_low_content_symbol' ELSE 'final_low_content' END
  WHEN short_side < 50 THEN CASE WHEN short_side >= 40 AND fills >= 0.045 AND content_ratio >= 0.45 THEN 'ok_coloured_small_icon' ELSE 'final_too_small' END
  WHEN NOT bbox_shape BETWEEN 0.32 AND 2.45 THEN 'final_bad_aspect'
  WHEN bbox_y > 0.4 * icon_h OR bbox_x > 0.42 * icon_w THEN 'final_partial_symbol'
  WHEN content_ratio > 0.5 AND red_fill < 0.01 AND white_fill > 0.015 AND yellow_fill > 0.06 THEN 'final_question_overlay'
  WHEN edge_touches >= 3 AND content_ratio > 0.6 AND NOT painted THEN CASE WHEN short_side >= 42 AND icon_score >= 0.56 THEN 'ok_full_bleed_symbol' ELSE 'final_full_rect_fragment' END
  WHEN edge_touches >= 3 AND content_ratio < 0.5 THEN CASE WHEN short_side >= 70 AND content_ratio >= 0.4 AND fills >= 0.045 THEN 'ok_coloured_edge_icon' ELSE 'final_likely_clipped' END
  WHEN NOT painted AND edge_touches >= 2 AND icon_score < 0.82 THEN 'final_edge_clipped'
  WHEN content_ratio < 0.22 AND components >= 9 THEN 'final_noisy_fragment'
  WHEN icon_score < 0.92 AND fills < 0.022 AND content_ratio < 0.18 AND bbox_h <= 45 THEN 'final_thin_symbol_fragment'
  WHEN icon_score < 0.9 AND fills < 0.018 AND content_ratio < 0.24 AND bbox_h <= 50 THEN 'final_low_art_symbol_fragment' ELSE 'ok' END AS reason"""

PORTRAIT = """CASE WHEN source_w < 420 OR source_w > 700 OR source_h < 760 OR source_w > 0.85 * source_h THEN 'ok'
  WHEN crop_kind = 'portrait_stacked_logo' THEN CASE WHEN icon_h < 95 AND white_fill < 0.004 AND red_fill >= 0.1 THEN 'final_portrait_logo_fragment' ELSE 'ok' END
  WHEN crop_kind <> 'legacy_full_page' THEN 'ok' WHEN edge_touches >= 2 AND red_fill >= 0.05 THEN 'final_portrait_legacy_fragment'
  WHEN edge_touches >= 4 AND red_fill >= 0.035 AND short_side >= 60 THEN 'final_portrait_legacy_fragment' ELSE 'ok' END AS reason"""

FULL_PAGE = """CASE WHEN NOT (large_page OR source_h >= greatest(850, 1.35 * source_w) OR (crop_kind = 'legacy_full_page' AND source_h >= 520 AND source_w >= greatest(950, 1.45 * source_h))) THEN 'ok'
  WHEN text_ratio >= 0.035 AND bbox_shape >= 1.55 AND (bbox_h <= 30 OR bbox_h <= 0.45 * icon_h) THEN 'final_full_page_text_row'
  WHEN text_ratio >= 0.02 AND bbox_shape >= 1.45 AND fg_ratio < 0.09 THEN 'final_full_page_sparse_text_row'
  WHEN shape >= 1.55 AND colourful_ratio < 0.3 AND text_ratio >= 0.09 THEN 'final_full_page_label_bleed'
  WHEN colourful_ratio <= 0.12 AND text_ratio >= 0.24 THEN 'final_full_page_text_dominant_panel'
  WHEN colourful_ratio <= 0.14 AND text_ratio >= 0.14 AND text_ratio >= 1.25 * colourful_ratio THEN 'final_full_page_payout_text_panel'
  WHEN shape BETWEEN 0.55 AND 1.75 AND fg_ratio >= 0.3 AND white_tile_ratio >= 0.22 AND colourful_ratio >= 0.03 AND bbox_w >= 0.55 * icon_w AND bbox_h >= 0.55 * icon_h THEN 'ok_full_tile_card'
  WHEN shape >= 1.25 AND fg_ratio < 0.025 THEN 'final_full_page_sparse_background_text'
  WHEN long_side >= 140 AND fg_ratio < 0.055 THEN 'final_full_page_background_fragment'
  WHEN text_ratio >= greatest(0.055, 0.55 * colourful_ratio) AND fg_ratio < 0.22 THEN 'final_full_page_text_fragment' ELSE 'ok' END AS reason"""

# which reasons each way back may lift
_SOFT = "list_contains(['final_too_small', 'final_low_score', 'final_full_rect_fragment', 'final_likely_clipped', 'final_edge_clipped'], raw)"
_EDGE = "list_contains(['clipped_fragment', 'vertical_fragment', 'horizontal_fragment', 'final_full_rect_fragment', 'final_edge_clipped', 'final_likely_clipped'], raw)"
_TRUSTED = ("NOT is_secondary AND len(list_filter([72, 232, 390, 544], lambda x: box_x BETWEEN x - 16 AND x + 16)) > 0 AND box_y BETWEEN 206 AND 226 "
            "AND box_w >= 146 AND box_w <= 168 AND box_h >= 100 AND box_h <= 126")
GATED = f"""CASE WHEN crop_kind = 'mahjong_tile' AND {_SOFT} THEN 'ok_mahjong_tile_crop' WHEN {_SOFT} AND {_TRUSTED} THEN 'ok_trusted_pp_paytable_crop'
  WHEN raw = 'final_low_score' AND NOT (is_secondary OR large_page) AND short_side >= 45 AND icon_score >= 0.56 AND fills >= 0.035 AND content_ratio >= 0.16 THEN 'ok_primary_paytable_low_score'
  WHEN {_EDGE} AND NOT (is_secondary OR large_page) AND short_side >= 50 AND icon_score >= 0.55 AND fills >= 0.03 AND content_ratio >= 0.24 THEN 'ok_primary_paytable_edge_icon'
  WHEN {_SOFT} AND short_side >= 42 AND (crop_kind = 'portrait_paytable_card' AND icon_score >= 0.72 AND content_ratio >= 0.38
    OR crop_kind = 'portrait_stacked_logo' AND icon_score >= 0.48 AND content_ratio >= 0.12 AND fills >= 0.018) THEN 'ok_structured_paytable_crop' ELSE raw END AS gated"""
