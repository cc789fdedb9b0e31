"""Frame sampling and filters."""

from __future__ import annotations

from ..functions import rules as R
from ..functions.text import lit
from .windows import running


def clamp_roi(x: str, y: str, w: str, h: str, frame_w: str, frame_h: str) -> list[str]:
    """ROI clipped to the frame, at least one pixel wide and high."""
    cx = f"greatest(0, least({x}, {frame_w} - 1))"
    cy = f"greatest(0, least({y}, {frame_h} - 1))"
    return [f"{cx} AS x", f"{cy} AS y", f"greatest(1, least({w}, {frame_w} - {cx})) AS w", f"greatest(1, least({h}, {frame_h} - {cy})) AS h"]


def dense_window_sample(df, interval: int = R.FRAME_INTERVAL, step: int = R.DENSE_STEP, lengths: dict[str, int] | None = None):
    """Stride sampling plus every ``step``-th frame inside the windows that categories open.

    One pass over known categories: a window is open while the running maximum
    of ``frame_idx + length`` over the earlier frames reaches the frame.
    """
    lengths = lengths or R.DENSE_AFTER
    opens = "CASE category " + " ".join(f"WHEN {lit(c)} THEN frame_idx + {n}" for c, n in lengths.items()) + " END"
    df = running(df, ["video_id"], "frame_idx", opens, "max", "dense_until", inclusive=False)
    return df.where(f"frame_idx % {interval} = 0 OR (frame_idx <= dense_until AND frame_idx % {step} = 0)")


def exposure_keep(score: str, dense: str) -> str:
    """Washed-out frames go; inside a dense window the limit is two points higher."""
    return f"{score} < {R.EXPOSURE_MAX}D + CASE WHEN {dense} THEN {R.EXPOSURE_DENSE_EXTRA}D ELSE 0.0D END"


def noise_keep() -> str:
    """Noisy frames go unless category or a protective interface score keeps them."""
    margin = R.NOISE_UI_MARGIN
    weak_feature = (f"(category = 'Feature game' AND feature_ui_score < {R.FEATURE_UI_KEEP + margin}D "
                    f"AND feature_active_score < {R.FEATURE_ACTIVE_KEEP}D)")
    weak_base = f"(category = 'Basegame' AND basegame_ui_score < {R.BASEGAME_UI_KEEP + margin}D)"
    return f"NOT (noise_score >= {R.NOISE_MAX}D AND (category = 'Other' OR {weak_feature} OR {weak_base}))"


def _takes_page() -> str:
    """A help frame's crop gives way to the full page when the page is larger and help-like or forced."""
    larger = "(alt_w > w * 1.35D OR alt_h > h * 1.05D) AND frame_w / greatest(1, frame_h) >= 1.25D"
    forced = "(w / greatest(1, h) <= 0.85D AND frame_w / greatest(1, frame_h) >= 1.25D AND alt_quality >= 2.0D)"
    help_like = "(alt_category = 'Help' OR alt_help OR alt_rules)"
    excused = "(alt_category = 'Result' AND alt_rules AND alt_quality >= 6.0D)"
    clear = "alt_category NOT IN ('Feature Buy', 'BigWin', 'Result', 'loading')"
    return f"(category = 'Help' AND {larger} AND ({help_like} OR {forced}) AND ({clear} OR {excused} OR {forced}))"


def choose_crop(primary, alternate, keys: list[str]):
    """Replace a help frame's crop by the full page when the page is larger and help-like or forced.

    ``primary`` has category, w, h, frame_w, frame_h, help_score; ``alternate``
    adds alt_category, alt_w, alt_h, alt_quality, alt_help, alt_rules, alt_help_score.
    """
    take = _takes_page()
    joined = primary.join(alternate, keys, "left").selectExpr("*", f"coalesce({take}, false) AS replaced")
    return joined.selectExpr(*keys, "category", "replaced", "CASE WHEN replaced THEN alt_w ELSE w END AS w", "CASE WHEN replaced THEN alt_h ELSE h END AS h",
                             "CASE WHEN replaced THEN greatest(alt_help_score, 12.0D) ELSE help_score END AS help_score")


def replace_crop(records, pages, keys: list[str]):
    """Classified ``records`` with everything measured on the crop taken from ``pages`` where the full page replaces it; ``replaced`` tells where.

    Both have the same measured columns, among them category, roi_w, roi_h, category_scores,
    matched_keywords, help_quality_score and help_paytable_score; ``records`` adds
    frame_w and frame_h, ``pages`` help_like and rules_like.  Items, scores, hits and
    sizes of a replaced record are those of the page; it stays a help record with a
    help score of 12 or more, and its hits name the replacement.  ``pages`` has at
    most one row per key; a record without a page keeps what it has, as do columns that ``pages`` lacks.
    """
    page = pages.selectExpr(*keys, "struct(*) AS page_", "category AS alt_category", "roi_w AS alt_w", "roi_h AS alt_h",
                            "help_quality_score AS alt_quality", "help_like AS alt_help", "rules_like AS alt_rules")
    joined = records.selectExpr("*", "roi_w AS w", "roi_h AS h").join(page, keys, "left").selectExpr("*", f"coalesce({_takes_page()}, false) AS replaced")
    own = "'Help', 'HelpQuality', 'HelpPaytable'"
    given = {
        "category_scores": f"map_concat(map_filter(page_.category_scores, (k, v) -> k NOT IN ({own})), map('Help', greatest(coalesce(try_element_at(page_.category_scores, 'Help'), 0.0D), 12.0D), "
                           "'HelpQuality', round(page_.help_quality_score, 2), 'HelpPaytable', round(page_.help_paytable_score, 2)))",
        "matched_keywords": "map_concat(map_filter(page_.matched_keywords, (k, v) -> k <> 'Help'), map('Help', "
                            "concat(coalesce(try_element_at(page_.matched_keywords, 'Help'), CAST(array() AS array<string>)), array('web_full_page_crop_forced'))))",
    }
    kept = {*keys, "category"} | (set(records.columns) - set(pages.columns))
    return joined.selectExpr(*[f"`{c}`" if c in kept else f"IF(replaced, {given.get(c, f'page_.`{c}`')}, `{c}`) AS `{c}`" for c in records.columns], "replaced")
