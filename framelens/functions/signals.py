"""Boolean text and layout signals of a frame, as SQL expression text.

Signals read the text columns of ``with_text`` (``lines``, ``joined``,
``compact``, ``record_*``), the ROI size (``roi_w``, ``roi_h``) and, for
composed signals, the ``sig_`` columns below them.  ``with_signals`` adds the
requested ones level by level, so a shared test is evaluated once per row.
Tests over the lines stand behind the cheaper test over the joined text where
the latter is implied, which skips the array walk for most frames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .rules import (BIGWIN_TIER_LABELS, BIGWIN_TIERS, GAME_RULES_TERMS, HELP_RULE_TERMS, PATTERNS, PLAIN_TIERS,
                    RULES_PAGE_TERMS, TIER_MEGA, TIER_SUPER)
from .text import (any_of, both, count_digits, count_matches, count_terms, either, has_any_pattern, lit, some_term,
                   text_stats_of_lines)

_REGISTRY: dict[str, tuple[tuple[str, ...], str]] = {}


def _signal(name: str, sql: str, *needs: str) -> None:
    _REGISTRY[name] = (needs, sql)


def pat(e: str, key: str) -> str:
    return has_any_pattern(e, key)


def spoken(key) -> str:
    """Phrase test on the joined text of the frame."""
    return any_of("compact", key)


def some_line(*tests: str) -> str:
    return f"exists(lines, i -> {both(*tests)})"


def n_lines(*tests: str) -> str:
    return f"size(filter(lines, i -> {both(*tests)}))"


def at_least(n: int, count: str) -> str:
    """``count`` of lines reaches ``n``; the array is walked only where it is long enough."""
    return f"(size(lines) >= {n} AND {count} >= {n})"


def across(low: float, high: float) -> str:
    """Horizontal centre of line ``i`` within shares of the ROI width."""
    return f"i.cx BETWEEN roi_w * {low}D AND roi_w * {high}D"


def down(low: float, high: float) -> str:
    return f"i.cy BETWEEN roi_h * {low}D AND roi_h * {high}D"


def line_has(key) -> str:
    return any_of("i.compact", key)


# --- joined-text signals ---------------------------------------------------------
_signal("loading_strong", spoken("loading"))
_signal("transition_cover", either([
    spoken("cover"), both(spoken("award"), spoken("free_spin"), pat("joined", "short_number")),
    pat("compact", "cover_compact"), pat("joined", "cover")]))
_LOADING = either(["sig_loading_strong", spoken("download")])
_PLAYING = either([spoken("gameplay"), pat("joined", "win_number"), both(spoken(["multiplier"]), pat("joined", "times_number"))])
_signal("loading_cover", both(
    spoken("vendor"), either([_LOADING, f"NOT {either([_PLAYING, 'sig_transition_cover'])}"]),
    either([_LOADING, spoken("marketing")]), f"NOT {spoken('cover_rules')}"), "loading_strong", "transition_cover")
_signal("feature_running", either([
    both(spoken("remaining"), spoken("free_play")),
    both("contains(compact, 'freespin')", some_term("compact", ["remaining", "last", "left"])),
    pat("joined", "running"), pat("compact", "running_compact")]))
_signal("feature_intro", either([spoken("feature_intro"), pat("joined", "feature_intro")]))
_signal("action_phrase", spoken("action"))
_signal("result_strong", both(spoken("result"), f"NOT {both(spoken('win_multiplier'), 'NOT ' + spoken('won_or_collect'))}"))
_signal("bigwin_strong", either([spoken("bigwin"), pat("compact", "bigwin_compact")]))
_signal("bigwin_title", either(["contains(compact, 'sensational')", both(r"joined RLIKE r'\bnice\b'", "joined RLIKE '[0-9]'")]))
_signal("jackpot_meter", both(spoken("jackpot"), f"{count_matches('joined', PATTERNS['big_amount'][0])} >= 2"))
_signal("total_win", spoken("total_win"))

# --- layout signals ------------------------------------------------------------------
_signal("start_button", both("contains(joined, 'start')", some_line(
    "contains(i.norm, 'start')", "i.cy >= roi_h * 0.5D", across(0.15, 0.85), "(i.h >= 28 OR i.w >= 95)")))
_OVERLAY = both(across(0.10, 0.90), down(0.16, 0.70), "(i.h >= roi_h * 0.038D OR i.w >= roi_w * 0.16D)")
_LABEL = both(spoken("total_win"), some_line(line_has("total_win"), "(i.h >= roi_h * 0.045D OR i.w >= roi_w * 0.30D)"))
_SPLIT = both("contains(joined, 'total')", some_line("i.norm = 'total'", _OVERLAY), some_line("i.norm = 'win'", _OVERLAY))
_NUMBER = some_line(f"{count_digits('i.norm')} >= 3", "i.h >= roi_h * 0.07D", "i.w >= roi_w * 0.25D", down(0.20, 0.82))
_TITLED = either([_LABEL, _SPLIT])
_signal("large_result", either([both(_TITLED, _NUMBER), both("contains(joined, 'collect')", some_line("contains(i.norm, 'collect')"),
                                                             either([_TITLED, _NUMBER]))]))
_signal("collect_button", some_line(
    "i.norm IN ('collect', 'collec', 'colect')", across(0.20, 0.80), down(0.48, 0.90), "i.w >= roi_w * 0.14D", "i.h >= roi_h * 0.030D"))
_signal("blocking_modal", both(spoken("modal"), f"{n_lines(line_has('modal_word'), across(0.15, 0.85), down(0.18, 0.82))} >= 2"))
_AREA = both(across(0.18, 0.82), down(0.16, 0.68), "i.h >= roi_h * 0.030D")
_BUY_TITLE = some_line(line_has("feature_buy"), _AREA, "i.w >= roi_w * 0.22D")
_BUY_SPLIT = both(some_line("i.norm = 'buy'", _AREA, "i.w >= roi_w * 0.10D"),
                  some_line(line_has("buy_title"), _AREA, "i.w >= roi_w * 0.10D"))
_PAIR = "(" + " + ".join(f"CAST({some_line('i.cy >= roi_h * 0.42D', t)} AS INT)" for t in (
    "contains(i.norm, 'cancel')", "contains(i.norm, 'start')", r"i.norm RLIKE r'\bbuy\b'")) + " >= 2)"
_signal("feature_buy", both(spoken("feature_buy"), spoken("purchase"), either([pat("joined", "amount"), _PAIR]),
                            either([_BUY_TITLE, _BUY_SPLIT, _PAIR])))
PAGE_LINES, PAGE_TEXT, _PAGE_GLUED = "page_lines", "page_joined", "page_compact"


def _count(test: str) -> str:
    return f"size(filter({PAGE_LINES}, t -> {test}))"


_OVER_UI = both("contains(compact, 'symbolspay')", spoken("overlay_ui"), f"NOT {spoken('overlay_help')}")
_OVER_UI_LINES = both(f"contains({_PAGE_GLUED}, 'symbolspay')", any_of(_PAGE_GLUED, "overlay_ui_items"),
                      f"NOT {any_of(_PAGE_GLUED, 'overlay_help_items')}")
_RULES = both(f"size({PAGE_LINES}) >= 12", f"NOT {_OVER_UI_LINES}", f"{count_terms(PAGE_TEXT, HELP_RULE_TERMS)} >= 4",
              either([_count(r"t RLIKE r'\b\d+\b'") + " >= 5", _count("length(t) >= 14") + " >= 5"]))
_signal("help_page", both(f"NOT {_OVER_UI}", either([spoken("help"), both("size(lines) >= 12", _RULES)])))


PAGE_LONG, PAGE_TERMS = f"size({PAGE_LINES}) >= 8", count_terms(PAGE_TEXT, RULES_PAGE_TERMS)
PAGE_DENSE = either([_count("length(t) >= 16") + " >= 5", _count(r"t RLIKE r'\b\d+(?:[,.]\d+)?\b'") + " >= 5"])
PAGE_HELP = any_of(_PAGE_GLUED, "help")


def rules_page(help_quality: str, help_score: str, paytable_score: str) -> str:
    """Rule page test; the three scores come from the caller's stage."""
    terms, dense = PAGE_TERMS, PAGE_DENSE
    scored = both(f"({help_quality} >= 6.0D OR ({help_quality} >= 3.0D AND {help_score} >= 3.0D))", f"{terms} >= 2")
    return both("size(lines) >= 8", PAGE_LONG, either([
        PAGE_HELP, f"{paytable_score} >= 2.0D", scored, both(f"{terms} >= 4", dense)]))


def reason_count(reasons: str, prefix: str) -> str:
    """Number after ``prefix…:``; 1 when the reason has none; 0 when absent."""
    first = f"try_element_at(filter({reasons}, r -> startswith(r, {lit(prefix)})), 1)"
    value = f"regexp_extract({first}, r':(\\d+)', 1)"
    return f"CASE WHEN {first} IS NULL THEN 0 WHEN {value} = '' THEN 1 ELSE CAST({value} AS INT) END"


def base_control(reasons: str) -> str:
    """Explicit base-game control, from words or from ``name:value`` reason codes."""
    starts = lambda p: f"exists({reasons}, r -> startswith(r, {lit(p)}))"
    equals = lambda v: f"array_contains({reasons}, {lit(v)})"
    centre = either([starts("spin_or_counter_block"), starts("partial_center_spin")])
    money = either([equals("money_or_bet_text"), pat("joined", "decimal")])
    signs = both("(contains(compact, '+') OR contains(joined, 'plus'))", "(contains(compact, '-') OR contains(joined, 'minus'))")
    support = either([spoken("money_word"), equals("persistent_feature_buy_button"), starts("round_buttons")])
    return either([spoken("control"), equals("plus_minus_controls"), equals("bottom_controls_with_money"), signs,
                   both(centre, either([f"{reason_count(reasons, 'round_buttons')} >= 3", both(money, support)]))])


_signal("transition_strong", "(sig_action_phrase OR (sig_feature_intro AND NOT sig_feature_running) OR sig_start_button)",
        "action_phrase", "feature_intro", "feature_running", "start_button")
_signal("inline_banner", both("contains(joined, 'win')", some_line(
    f"NOT {line_has('banner_block')}", pat("i.norm", "banner"), "i.cy <= roi_h * 0.72D", "i.w >= roi_w * 0.16D")))
_signal("center_payout", both("joined RLIKE '[0-9]'", some_line(
    across(0.12, 0.88), down(0.16, 0.62), "(i.w >= roi_w * 0.22D OR i.h >= roi_h * 0.055D)",
    f"{count_digits('i.norm')} >= 4", pat("i.raw", "payout_text"))))

# --- record signals: text of all items, without the score limit -----------------------
recorded = lambda key: any_of("record_compact", key)
_signal("record_spins_left", either([
    "contains(record_compact, 'freespinsleft')", "contains(record_compact, 'freespinleft')",
    both(recorded("free_spin_any"), "contains(record_text, 'left')", pat("record_text", "short_number"))]))
_signal("record_feature_text", either([recorded("feature_words"), pat("record_text", "feature_text"), pat("record_compact", "counter_of")]))
_signal("record_strong_counter", either([pat("record_compact", "counter_compact"), pat("record_text", "counter")]))
_signal("record_start_intro", recorded("start_intro"))
_signal("record_result_text", either([recorded("result"), both(
    "contains(record_compact, 'total')", "contains(record_compact, 'win')", pat("record_text", "big_amount"))]))
RECORD_COUNTER = both(recorded("free_spin_any"), pat("record_text", "short_number"), f"NOT {recorded('counter_block')}")
_signal("record_counter_over_board", both(
    RECORD_COUNTER, "NOT sig_record_start_intro", "NOT sig_record_result_text", "feature_board_score >= 3.0D"),
    "record_start_intro", "record_result_text")
_signal("record_base_text", recorded("base_words"))
_signal("record_web_chrome", both(recorded("browser"), recorded("browser_page")))
_signal("record_award", both(recorded("award_words"), recorded("free_spin_any")))
_signal("record_settings", recorded("settings_words"))
_signal("record_intro", either([recorded("feature_intro"), pat("record_text", "feature_intro")]))
RULE_LINES = "filter(record_lines, t -> length(t) >= 2)"
RECORD_STATS = text_stats_of_lines(RULE_LINES)
RULE_WORDS = any_of(f"replace(array_join({RULE_LINES}, ' '), ' ', '')", "help")
_signal("plain_rule_help", both(
    "help_quality_score >= 2.5D", f"size({RULE_LINES}) >= 6",
    f"({RECORD_STATS}.token_count >= 22 OR {RECORD_STATS}.long_line_count >= 3)",
    either([RULE_WORDS, "help_paytable_score >= 1.0D",
            f"{RECORD_STATS}.long_line_count >= 4"])))


def game_rules_text(paytable_text: str) -> str:
    return some_term(paytable_text, GAME_RULES_TERMS)


# --- big-win tiers -----------------------------------------------------------------------
def bigwin_tier(compact: str) -> str:
    """Tier key of corrected, space-free text; empty when none applies."""
    great, mega = some_term(compact, TIER_SUPER), some_term(compact, TIER_MEGA)
    has = lambda w: f"contains({compact}, '{w}')"
    rungs = [(f"NOT {has('wi')}", ""), (both(great, mega), "super_mega_win"), (has("jumbo"), "jumbo_win"), (mega, "mega_win"),
             (great, "super_win"), (some_term(compact, ["big", "bis"]), "big_win"), (has("huge"), "huge_win"),
             (has("massive"), "massive_win"), (has("epic"), "epic_win")]
    return "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t in rungs) + " ELSE '' END"


def bigwin_tier_label(tier: str) -> str:
    rows = ", ".join(f"'{t}', '{BIGWIN_TIER_LABELS[t]}'" for t in BIGWIN_TIERS)
    return f"coalesce(try_element_at(map({rows}), {tier}), 'Unlabeled BigWin')"


def bigwin_tier_plain(plain_compact: str) -> str:
    """First of the ordered phrases in uncorrected, space-free text."""
    return "CASE " + " ".join(f"WHEN contains({plain_compact}, {lit(p.replace(' ', ''))}) THEN {lit(name)}"
                              for p, name in PLAIN_TIERS) + " ELSE 'BigWin' END"


SIGNALS = list(_REGISTRY)


def signal(name: str) -> str:
    """The test of a signal; those it rests on are columns."""
    return _REGISTRY[name][1]


def with_signals(df: DataFrame, *names: str, read: Callable[[str], str] = str) -> DataFrame:
    """Add ``sig_<name>`` columns for ``names`` and the signals they rest on; ``read`` puts columns in place of tests that are made."""
    level: dict[str, int] = {}

    def depth(name: str) -> int:
        if name not in level:
            level[name] = 1 + max([depth(n) for n in _REGISTRY[name][0]], default=-1)
        return level[name]

    for name in names or SIGNALS:
        depth(name)
    present = set(df.columns)
    for step in range(max(level.values()) + 1):
        todo = [f"{read(_REGISTRY[n][1])} AS sig_{n}" for n, d in level.items() if d == step and f"sig_{n}" not in present]
        if todo:
            df = df.selectExpr("*", *todo)
    return df
