"""Weighted threshold scores over measured columns and text signals, as SQL text.

A score is a list of ``Term``s (condition, weight, reason); ``total`` and
``reasons`` turn the list into two expressions.  Measured columns are named as
in ``plans.fixtures``; text tests read the columns of ``with_text``.
"""

from __future__ import annotations

from collections import namedtuple

from . import rules as R
from .signals import at_least, n_lines, pat, spoken, line_has, some_line, across, down
from .text import any_of, both, count_matches, count_terms, either, lit, regex, some_term

_NOT_EMPTY = "i.norm <> ''"
Term = namedtuple("Term", "when weight reason", defaults=(None,))


def num(value) -> str:
    """Weights are numbers or expressions; numbers become double literals."""
    return value if isinstance(value, str) else f"{float(value)}D"


def coded(name: str, value: str, fmt: str = "%.2f") -> str:
    return f"concat('{name}:', format_string('{fmt}', {value}))"


def counted(name: str, value: str) -> str:
    return f"concat('{name}:', CAST({value} AS STRING))"


def total(terms: list[Term]) -> str:
    return "(" + " + ".join(f"CASE WHEN {t.when} THEN {num(t.weight)} ELSE 0.0D END" for t in terms) + ")"


def present(entries: list[tuple[str, str]], kind: str) -> str:
    """Values of the ``(condition, value)`` entries that hold, in order; values are never null, ``kind`` is their type.

    The parts are put together by compiled code; ``array_compact`` is not compiled
    and evaluates all conditions below it node by node.
    """
    none = f"CAST(array() AS array<{kind}>)"
    return "concat(" + ", ".join([none, *(f"IF({c}, array({v}), {none})" for c, v in entries)]) + ")"


def reasons(terms: list[Term]) -> str:
    """Reason codes of the terms that fired, in order; plain names are literals."""
    entry = lambda t: (f"({t.when}) AND ({t.reason}) IS NOT NULL", t.reason) if "(" in t.reason else (t.when, lit(t.reason))
    return present([entry(t) for t in terms if t.reason is not None], "string")


# --- user-interface scores of a frame --------------------------------------------------
def basegame_ui_terms() -> list[Term]:
    words = count_terms("joined", R.PHRASES["control_word"])
    money = either([pat("joined", "money"), pat("joined", "decimal")])
    signs = both("(contains(compact, '+') OR contains(joined, 'plus'))", "(contains(compact, '-') OR contains(joined, 'minus'))")
    return [
        Term("dark_ratio >= 0.16D", 0.8, coded("dark_control_band", "dark_ratio")),
        Term("edge_ratio BETWEEN 0.035D AND 0.16D", 0.5, coded("lower_ui_edges", "edge_ratio")),
        Term("circle_count >= 2", 1.3, counted("round_buttons", "circle_count")),
        Term("circle_count = 1", 0.6, "round_button:1"),
        Term("center_blocks > 0", 0.7, counted("spin_or_counter_block", "center_blocks")),
        Term("spin_blocks > 0", 1.2, counted("partial_center_spin", "spin_blocks")),
        Term(spoken("control_word"), 0.8, "ocr_control_words"),
        Term(f"{words} >= 2", 0.8, counted("multiple_control_words", words)),
        Term(money, 0.4, "money_or_bet_text"),
        Term(both(spoken("buy_button"), f"NOT {spoken('buy_dialog')}"), 0.9, "persistent_feature_buy_button"),
        Term(both(spoken("auto_turbo"), money), 0.8, "bottom_controls_with_money"),
        Term(signs, 0.4, "plus_minus_controls"),
    ]


def feature_ui_terms() -> list[Term]:
    """Needs ``sig_feature_running``."""
    first, second = pat("joined", "left_number"), pat("joined", "number_left")
    lower = n_lines("i.norm <> ''", "i.cy >= roi_h * 0.48D", "i.h >= roi_h * 0.018D", line_has("lower_terms"))
    return [
        Term("sig_feature_running", 2.5, "feature_running_text"),
        Term(spoken("explicit_remaining"), 2.5, "explicit_remaining_free_spin"),
        Term(first, 1.2, "remaining_number_pattern"),
        Term(both(f"NOT {first}", second), 1.2, "spin_number_remaining_pattern"),
        Term(f"{lower} >= 2", 2.0, counted("lower_feature_ui_terms", lower)),
        Term(f"{lower} = 1", 0.8, "lower_feature_ui_term:1"),
        Term("bottom_dark_ratio >= 0.12D", 0.4, coded("bottom_ui_band", "bottom_dark_ratio")),
        Term(both("joined RLIKE '[0-9]'", spoken("counter_words")), 0.5, "remaining_counter_digits"),
    ]


def reel_board_terms() -> list[Term]:
    return [
        Term("edge_ratio >= 0.050D", 1.2, coded("board_edges", "edge_ratio", "%.3f")),
        Term("lap_var >= 520.0D", 0.9, coded("board_texture", "lap_var", "%.0f")),
        Term("colour_ratio >= 0.30D", 0.7, coded("board_colour", "colour_ratio")),
        Term("vertical_lines >= 3", 1.2, counted("vertical_reel_lines", "vertical_lines")),
        Term("horizontal_lines >= 2", 0.8, counted("horizontal_reel_lines", "horizontal_lines")),
        Term("vertical_lines >= 3 AND horizontal_lines >= 2", 1.0, "reel_grid_geometry"),
    ]


# --- image quality -------------------------------------------------------------------------
def clear_score(scale: float, cap: float) -> str:
    return f"least({cap}D, blur_score / {scale}D)"


def overexposure_terms() -> list[Term]:
    plain = "(edge_ratio <= 0.045D OR lap_var <= 260.0D)"
    judged = f"({plain} OR (flare_ratio >= 0.68D AND largest_ratio >= 0.42D))"
    return [
        Term(f"{judged} AND bright_ratio >= 0.50D", 0.9, coded("bright_area", "bright_ratio")),
        Term(f"{judged} AND very_bright_ratio >= 0.26D", 0.8, coded("very_bright_area", "very_bright_ratio")),
        Term(f"{judged} AND neon_ratio >= 0.40D", 1.2, coded("neon_yellow_green", "neon_ratio")),
        Term(f"{judged} AND flare_ratio >= 0.56D", 0.8, coded("flare_area", "flare_ratio")),
        Term(f"{judged} AND largest_ratio >= 0.32D", 1.3, coded("large_flare_blob", "largest_ratio")),
        Term(f"{plain} AND (flare_ratio >= 0.56D OR largest_ratio >= 0.32D)", 1.5, "low_detail_under_washout"),
    ]


def noise_terms() -> list[Term]:
    return [
        Term("yellow_green_ratio >= 0.24D", 1.0, coded("yellow_green_effect", "yellow_green_ratio")),
        Term("saturated_ratio >= 0.42D", 0.8, coded("high_saturation", "saturated_ratio")),
        Term("bright_ratio >= 0.28D", 0.6, coded("bright_effect", "bright_ratio")),
        Term("mixed_ratio >= 0.38D", 0.8, coded("mixed_effect_area", "mixed_ratio")),
        Term("largest_ratio >= 0.18D", 0.6, coded("large_effect_blob", "largest_ratio")),
        Term("edge_ratio >= 0.085D", 0.9, coded("dense_edges", "edge_ratio", "%.3f")),
        Term("lap_var >= 950.0D", 0.5, coded("high_texture", "lap_var", "%.0f")),
        Term("contrast >= 58.0D", 0.4, coded("high_contrast", "contrast", "%.1f")),
    ]


def noise_score() -> str:
    base = total(noise_terms())
    return (f"({base} + CASE WHEN round({base}, 6) >= 2.4D AND edge_ratio >= 0.070D AND mixed_ratio >= 0.30D "
            "THEN 0.7D ELSE 0.0D END)")


def obstruction_terms() -> list[Term]:
    return [
        Term("largest_ratio >= 0.08D", "least(4.0D, largest_ratio * 28.0D)", coded("large_foreground_component", "largest_ratio")),
        Term("central_ratio >= 0.16D", "least(3.0D, central_ratio * 12.0D)", coded("central_bright_cover", "central_ratio")),
        Term("wide_components >= 1", 2.0, counted("wide_reel_blocker", "wide_components")),
    ]


# --- screen kinds ------------------------------------------------------------------------------
def brand_splash() -> str:
    named = either([spoken("brand"), "compact IN ('fc', 'fclogo')"])
    return both(named, f"NOT {spoken('brand_block')}", f"{n_lines(_NOT_EMPTY)} BETWEEN 1 AND 5",
                "plain_ratio >= 0.65D", "logo_ratio >= 0.04D", "edge_ratio <= 0.09D")


def payout_visual() -> str:
    return ("((gold_blocks >= 2 AND gold_ratio >= 0.014D AND centre_dark_ratio >= 0.12D) "
            "OR (wide_blocks >= 2 AND centre_dark_ratio >= 0.10D))")


def loading_splash() -> str:
    """Needs ``sig_loading_cover``."""
    buttons = n_lines("i.cy >= roi_h * 0.48D", "i.w >= roi_w * 0.18D", line_has("cover_button"))
    footer = f"({buttons} + {n_lines('i.cy >= roi_h * 0.72D', line_has(R.PHRASES['legal'] + ['fair']))})"
    title = some_line(down(0.05, 0.55), "i.w >= roi_w * 0.18D", "i.h >= roi_h * 0.025D", f"NOT {line_has('balance_words')}")
    cover = spoken("cover_like")
    shown = either(["bar_flag", both(some_term("compact", ["ver", "certified"]), f"{footer} >= 4"),
                    both(cover, either([some_term("compact", ["getstarted", "rightreserved", "rightsreserved"]), title, f"{buttons} >= 1"]))])
    return either(["sig_loading_cover", both(f"NOT {both(spoken('jackpot'), spoken('jackpot_pick'))}", spoken("legal"),
                                             either([f"NOT {spoken('real_ui')}", cover]), shown)])


def help_scroll_shell() -> str:
    return "(panel_dark_ratio >= 0.62D AND bottom_dark_ratio >= 0.48D AND button_ratio >= 0.015D)"


# --- help pages ----------------------------------------------------------------------------------
_NUMBER = r"\b\d{1,4}(?:[,.]\d+)?\b"
_PAIR = r"\b\d{1,3}\s*-\s*\d{1,4}(?:[,.]\d+)?\b"


def paytable_signal() -> str:
    """Ladder of counts over the text lines; 0 when no rung holds."""
    title = both(spoken("paytable_title"), some_line(line_has("paytable_title")))
    items = n_lines(r"i.norm RLIKE r'^\d{1,3}$'")
    values = f"aggregate(lines, 0, (a, i) -> a + {count_matches('i.norm', _NUMBER)})"
    pairs = n_lines("i.norm <> ''", f"lower(i.raw) RLIKE {regex(_PAIR)}")
    full = n_lines(r"i.norm RLIKE r'\bfull\b'", f"i.norm RLIKE {regex(_NUMBER)}")
    terms, cont = n_lines(line_has("table_terms")), n_lines(line_has("continuation"))
    wild = some_line(line_has("wild_scatter"))
    paylines = some_line(some_term("i.norm", ["paylines", "pay lines"]))
    rungs = [(both(title, f"({at_least(3, full)} OR {at_least(4, pairs)})"), 3.0),
             (both(title, f"(({values} >= 8 AND {terms} >= 1) OR {values} >= 12)"), 2.5),
             (both(title, at_least(20, items), f"{terms} >= 3"), 3.0),
             (both(title, at_least(10, items), f"{terms} >= 10"), 2.5),
             (both(title, at_least(8, items), f"({terms} >= 2 OR {cont} >= 2)"), 2.0),
             (both(title, f"{cont} >= 3"), 1.5),
             (both(paylines, wild, at_least(4, pairs)), 2.0),
             (both(at_least(6, pairs), f"({wild} OR {terms} >= 1)"), 2.0)]
    return "CASE " + " ".join(f"WHEN {c} THEN {num(v)}" for c, v in rungs) + " ELSE 0.0D END"


def help_quality_terms(paytable: str) -> list[Term]:
    inside = "i.cy >= roi_h * 0.03D AND i.cy <= roi_h * 0.97D AND length(i.norm) >= 3"
    n, long_ = n_lines(inside), n_lines(inside, "length(i.norm) >= 14")
    numeric, ruled = n_lines(inside, r"i.norm RLIKE r'\b\d+\b'"), n_lines(inside, line_has("quality_terms"))
    vivid = f"(saturated_ratio >= 0.34D AND {n} < 10 AND {paytable} < 2.0D)"
    return [
        Term("dark_plain_ratio >= 0.42D", 4.0, coded("dark_plain_bg", "dark_plain_ratio")),
        Term("dark_plain_ratio < 0.42D AND dark_ratio >= 0.48D", 2.0, coded("dark_bg", "dark_ratio")),
        Term(at_least(12, n), f"least(4.0D, {n} / 5.0D)", counted("text_lines", n)),
        Term(both(at_least(7, n), f"{n} <= 11"), 1.2, counted("some_text_lines", n)),
        Term(at_least(4, long_), f"least(3.0D, {long_} * 0.45D)", counted("long_rule_lines", long_)),
        Term(at_least(4, ruled), f"least(3.0D, {ruled} * 0.4D)", counted("rule_terms", ruled)),
        Term(at_least(4, numeric), 0.8, counted("numeric_rule_lines", numeric)),
        Term(f"{paytable} >= 3.0D", 7.0, "symbol_paytable_grid"),
        Term(f"{paytable} >= 2.0D AND {paytable} < 3.0D", 4.5, "symbol_paytable_continuation"),
        Term(f"{paytable} > 0 AND {paytable} < 2.0D", 2.0, "paytable_rule_continuation"),
        Term(vivid, -4.0, coded("colorful_game_area_penalty", "saturated_ratio")),
        Term(f"NOT {vivid} AND saturated_ratio >= 0.46D AND {paytable} < 2.0D", -2.0, coded("colorful_content_penalty", "saturated_ratio")),
        Term("bright_ratio >= 0.24D AND dark_plain_ratio < 0.36D", -1.5, coded("bright_non_help_penalty", "bright_ratio")),
    ]


def paytable_visual_terms(height: str) -> list[Term]:
    return [
        Term("dark_plain_ratio >= 0.30D OR dark_ratio >= 0.42D", 1.0, coded("dark_help_bg", "dark_plain_ratio")),
        Term("component_count >= 6", 3.0, counted("icon_components", "component_count")),
        Term("component_count BETWEEN 3 AND 5", 1.5, counted("some_icon_components", "component_count")),
        Term("yellow_ratio >= 0.012D", 0.8, "yellow_payout_text"),
        Term(f"paragraph_rows >= greatest(24, floor({height} * 0.10D)) AND yellow_ratio < 0.020D AND component_count < 3",
             -2.0, "paragraph_rules_layout"),
    ]


def paytable_text_terms(text: str) -> list[Term]:
    """Page text score over the amount-keeping normal form."""
    numbers, pairs = count_matches(text, _NUMBER), count_matches(text, _PAIR)
    full = count_matches(text, r"\bfull\s+\d{1,4}(?:[,.]\d+)?\b")
    multi = some_term(text, ["multiplier symbol"])
    return [
        Term(some_term(text, R.PAYOUT_TITLE_TERMS), 4.0, "symbol_payout_title"),
        Term(multi, 3.0, "multiplier_symbols"),
        Term(both(f"NOT {multi}", rf"{text} RLIKE r'\bpay\s*table\b'"), 1.0, "paytable_word"),
        Term(some_term(text, ["wild", "scatter"]), 1.5, "wild_scatter_terms"),
        Term(some_term(text, ["paylines", "pay lines", "ways", "full"]), 1.0, "payout_layout_terms"),
        Term(f"{numbers} >= 10", f"least(3.0D, {numbers} / 8.0D)", counted("many_numbers", numbers)),
        Term(f"{pairs} >= 3", 3.0, counted("payout_pairs", pairs)),
        Term(f"{full} >= 2", 2.0, counted("full_values", full)),
    ]


# --- feature, transition and big-win evidence ---------------------------------------------------
def feature_active_terms(help_score: str, loading_score: str, result_score: str, help_quality: str) -> list[Term]:
    """Needs the running, help, loading and cover signals."""
    hits = lambda key: count_terms("joined", [R.normalise_phrase(p) for p in R.PHRASES[key]])
    active, touch = hits("active"), hits("interaction")
    strong = f"{help_quality} >= 6.0D"
    return [
        Term("sig_feature_running", 8.0, "free_spins_running"),
        Term(f"{active} > 0", f"least(10.0D, {active} * 2.0D)", counted("active_terms", active)),
        Term(f"{touch} > 0", f"least(6.0D, {touch} * 2.5D)", counted("interaction", touch)),
        Term(pat("joined", "fraction"), 2.5, "counter_fraction"),
        Term(either([pat("joined", "times_number"), pat("joined", "number_times")]), 2.5, "multiplier_value"),
        Term(pat("joined", "win_colon"), 3.0, "feature_win_value"),
        Term(both("contains(compact, 'tap')", some_term("compact", ["shoot", "pick", "reveal"])), 3.0, "tap_action"),
        Term(f"sig_help_page OR {strong}", f"CASE WHEN {strong} THEN -8.0D ELSE -5.0D END", "help_page_penalty"),
        Term("sig_loading_strong OR sig_loading_cover", -8.0, "loading_penalty"),
        Term("sig_transition_cover", -5.0, "intro_penalty"),
        Term(both(f"{result_score} >= 12.0D", f"NOT {spoken('result_keep')}"), -6.0, "result_penalty"),
        Term(f"{help_score} >= 12.0D", -3.0, "help_score_penalty"),
        Term(f"{loading_score} >= 12.0D", -3.0, "loading_score_penalty"),
    ]


def transition_keep_terms(transition_score: str, base_ui: str) -> list[Term]:
    plain = "NOT sig_transition_cover"
    ui = f"{base_ui} >= {R.BASEGAME_UI_KEEP}D"
    return [
        Term("true", transition_score),
        Term("sig_transition_cover", 30.0, "transition_cover_text_priority"),
        Term(both(spoken("free_spin"), "joined RLIKE '[0-9]'"), 5.0, "free_spins_intro"),
        Term(spoken("rule_intro"), 4.0, "feature_rule_intro"),
        Term(both(spoken("start_overlay"), plain), -4.0, "start_overlay_penalty"),
        Term(both("sig_start_button", plain), -5.0, "large_start_button_penalty"),
        Term(spoken("running_label"), -4.0, "feature_running_ui_penalty"),
        Term(spoken("trigger_or_buy"), -5.0, "basegame_trigger_hint_penalty"),
        Term(ui, -1.5, "basegame_ui_overlay_penalty"),
        Term(both(ui, plain, spoken("buy_or_auto")), -12.0, "persistent_basegame_ui_penalty"),
    ]


def bigwin_keep_rules(bigwin_score: str, visual_amount: str) -> tuple[list[tuple[str, float, str]], list[tuple[str, float, str]]]:
    """Ladder of label and amount evidence, and caps for weaker explanations."""
    label = "(sig_bigwin_strong OR sig_bigwin_title)"
    bare = "NOT (sig_bigwin_strong OR sig_total_win)"
    number = pat("joined", "big_amount")
    amount = f"(sig_center_payout OR {visual_amount})"
    rungs = [(both(label, amount), 14.0, "bigwin_label_with_large_amount"),
             (both(label, number), 12.0, "bigwin_label_with_number_text"),
             (both("sig_total_win", "sig_large_result", number), 11.0, "total_win_result_layout"),
             (both(f"{bigwin_score} >= 12.0D", "sig_bigwin_strong"), 10.0, "bigwin_score_with_label")]
    caps = [(both("sig_jackpot_meter", bare), 2.0, "jackpot_meter_not_bigwin"),
            (both(amount, bare), 4.0, "large_amount_without_win_label"),
            (both(spoken("bigwin_other"), bare), 3.0, "feature_intro_not_bigwin"),
            (both("sig_inline_banner", bare), 2.0, "small_inline_win_not_bigwin"),
            (both(pat("compact", "free_start"), f"NOT {pat('compact', 'tier_win')}"), 6.0, None)]
    return rungs, caps


def bigwin_keep_signal(bigwin_score: str, visual_amount: str) -> str:
    rungs, caps = bigwin_keep_rules(bigwin_score, visual_amount)
    ladder = "CASE " + " ".join(f"WHEN {c} THEN {num(v)}" for c, v, _ in rungs) + " ELSE 0.0D END"
    return "least(" + ", ".join([ladder] + [f"CASE WHEN {c} THEN {num(v)} END" for c, v, _ in caps]) + ")"


# --- keep scores of records -----------------------------------------------------------------------
def basegame_keep_score() -> str:
    return (f"(basegame_ui_score * 2.0D + {clear_score(900.0, 3.0)} - least(3.0D, noise_score * 0.6D)"
            " - least(8.0D, obstruction_score * 1.4D)"
            " - CASE WHEN top_score >= 8.0D THEN least(4.0D, (top_score - 6.0D) * 0.35D) ELSE 0.0D END)")


def feature_keep_score() -> str:
    """Needs ``sig_record_spins_left``."""
    return (f"(feature_ui_score * 2.0D + feature_active_score * 1.6D + {clear_score(1000.0, 2.5)} - least(3.0D, noise_score * 0.55D)"
            f" - CASE WHEN feature_active_score >= {R.FEATURE_ACTIVE_KEEP}D THEN least(3.0D, obstruction_score * 0.45D)"
            " ELSE least(8.0D, obstruction_score * 1.8D) END + top_score * 0.05D"
            " + CASE WHEN sig_record_spins_left THEN 28.0D"
            f" WHEN help_quality_score >= {R.HELP_QUALITY_MIN}D THEN help_quality_score * -2.2D ELSE 0.0D END)")


def bigwin_keep_score() -> str:
    return (f"(bigwin_keep_signal * 2.0D + top_score + {clear_score(1200.0, 3.0)} - least(4.0D, noise_score * 0.45D)"
            f" + CASE WHEN bigwin_keep_signal >= {R.BIGWIN_KEEP_MIN}D THEN 20.0D ELSE 0.0D END)")


def map_score(scores: str, category: str) -> str:
    return f"coalesce(try_element_at({scores}, '{category}'), 0.0D)"


def competing_score(scores: str, base: bool = True) -> str:
    names = ["BigWin", "Transition", "Feature game", "Feature Buy", "Result"] + (["Basegame"] if base else [])
    return "greatest(" + ", ".join(map_score(scores, c) for c in names) + ")"


def loading_keep_score(scores: str, hits: str) -> str:
    """``scores`` maps category to score, ``hits`` lists the loading reasons."""
    words, mine = f"lower(array_join({hits}, ' '))", map_score(scores, "loading")
    return (f"({mine} * 2.0D + CASE WHEN contains({words}, 'loading_splash_visual') THEN 14.0D ELSE 0.0D END"
            f" + CASE WHEN contains({words}, 'cover') OR contains({words}, 'splash') THEN 4.0D ELSE 0.0D END"
            " + CASE WHEN frame_idx <= 900 THEN greatest(0.0D, 9.0D - frame_idx / 120.0D) ELSE 0.0D END"
            f" - greatest(0.0D, {competing_score(scores)} - {mine}) * 0.45D - feature_ui_score * 0.25D"
            " - basegame_ui_score * 0.15D - greatest(0.0D, noise_score - 12.0D) * 0.2D)")


def help_keep_score(stats: str) -> str:
    return (f"(help_quality_score * 1.2D + help_paytable_score * 2.0D + {stats}.line_count * 0.8D + {stats}.token_count * 0.15D"
            f" + {stats}.long_line_count * 1.0D + blur_score * 0.01D - noise_score * 0.6D)")


# --- icons and regions ------------------------------------------------------------------------------
def icon_quality() -> str:
    return ("round(greatest(0.0D, least(1.0D, least(1.0D, least(icon_w, icon_h) / 88.0D) * 0.24D"
            " + greatest(0.0D, 1.0D - edge_touches * 0.24D) * 0.34D + least(1.0D, sharpness / 520.0D) * 0.18D"
            " + (least(1.0D, content_ratio / 0.34D) * 0.55D + least(1.0D, bbox_fill / 0.45D) * 0.45D) * 0.24D"
            " - greatest(0.0D, least(0.22D, (components - 3) * 0.055D)))), 4)")


def icon_completeness() -> str:
    return ("(least(icon_w * icon_h / 9000.0D, 1.4D) + content_ratio + least((x_margin + y_margin) / 18.0D, 1.0D)"
            " - edge_density * 1.8D)")


def box_art_score() -> str:
    return ("(colourful_ratio * 2.25D + greatest(0.0D, 1.0D - abs(icon_w / greatest(icon_h, 1) - 1.0D) / 2.2D) * 0.28D"
            " + least(1.0D, greatest(icon_w, icon_h) / 96.0D) * 0.24D + least(0.55D, icon_w * icon_h / 18000.0D)"
            " - (white_ratio * 0.55D + yellow_text_ratio * 0.45D))")


def motion_region_score(x: str, y: str, w: str, h: str, frame_w: float, frame_h: float) -> str:
    """Area weighted by centring, times a factor for game-shaped regions."""
    wr, hr, aspect = f"({w} / {frame_w}D)", f"({h} / {frame_h}D)", f"({w} / greatest(1.0D, {h}))"
    centre = f"(1.0D - least(0.75D, abs({x} + {w} / 2.0D - {frame_w / 2}D) / {frame_w}D))"
    return (f"({w} * {h} * greatest(0.25D, {centre}) * CASE"
            f" WHEN {wr} BETWEEN 0.18D AND 0.50D AND {hr} >= 0.45D AND {aspect} <= 1.05D THEN 3.0D"
            f" WHEN {wr} BETWEEN 0.42D AND 0.72D AND {hr} <= 0.70D AND {aspect} >= 1.10D THEN 2.2D"
            f" WHEN {wr} >= 0.72D AND {hr} >= 0.55D AND {y} + {h} / 2.0D >= {frame_h * 0.35}D THEN 0.18D ELSE 1.0D END)")
