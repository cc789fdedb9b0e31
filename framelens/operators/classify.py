"""Category scoring and classification of frames.

Everything is row-wise: one scan, no shuffle.  Keyword hits come from one pass
of a literal rule array; signals are columns; bonuses, stages and overrides are
ordered lists whose entries each become a few columns.  The optimiser keeps
projections apart whose columns are used more than once, so the expression tree
stays linear in the number of rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scores as V
from ..functions import signals as S
from ..functions.scores import num
from ..functions.signals import base_control, pat, rules_page, spoken, with_signals
from ..functions.text import both, count_terms, either, line_texts, lit, tokens_of_lines, with_lines, with_text, with_text_of_lines
from ..session import durable

# score columns by category; a null score means that the category has no entry
SLUG = {"loading": "s_loading", "BigWin": "s_bigwin", "Transition": "s_transition", "Feature game": "s_feature",
        "Feature Buy": "s_buy", "Help": "s_help", "Result": "s_result", "Basegame": "s_base", "Other": "s_other"}

TEXT_SIGNALS = ["loading_strong", "transition_cover", "loading_cover", "feature_running", "feature_intro",
                "action_phrase", "result_strong", "bigwin_strong", "bigwin_title", "jackpot_meter", "total_win",
                "start_button", "large_result", "collect_button", "blocking_modal", "feature_buy", "help_page",
                "transition_strong", "inline_banner", "center_payout"]

# signals of the text alone, of lines at or above the score limit and of all lines
PURE_SIGNALS = ["loading_strong", "transition_cover", "loading_cover", "feature_running", "feature_intro", "action_phrase", "result_strong",
                "bigwin_strong", "bigwin_title", "jackpot_meter", "total_win", "help_page"]
RECORD_SIGNALS = ["record_spins_left", "record_feature_text", "record_strong_counter", "record_start_intro", "record_result_text",
                  "record_base_text", "record_web_chrome", "record_award", "record_settings", "record_intro"]
# what the selection reads of a record's text; carried where it is made
RECORD_FACTS = {"record_counter": S.RECORD_COUNTER, "record_stats": S.RECORD_STATS, "record_rule_words": S.RULE_WORDS, "record_tier": S.bigwin_tier("record_compact"),
                "page_tokens": tokens_of_lines("page_lines")}

DIGITS = "joined RLIKE '[0-9]'"
_ENTRY_TYPE = "struct<category:string,reason:string>"


# --- keyword scores ------------------------------------------------------------------------
def keyword_hits(joined: str, pack: R.RulePack = R.DEFAULT_PACK, of: list[str] | None = None) -> str:
    """Rules whose keyword occurs in ``joined``, in rule order; those of the categories ``of``, or all."""
    rows = [f"named_struct('category', {lit(c)}, 'keyword', {lit(k)}, 'norm', {lit(n)}, 'weight', {num(w)})"
            for c, _, k, n, w in pack.keyword_rows() if of is None or c in of]
    if not rows:
        return "CAST(array() AS array<struct<category:string,keyword:string,norm:string,weight:double>>)"
    return f"filter(array({', '.join(rows)}), r -> contains({joined}, r.norm))"


def keyword_score(hits: str, category: str, digits: str) -> str:
    """Sum of hit weights plus 0.5 per hit; Result gains 1.5 when the text has a digit."""
    score = f"aggregate({hits}, 0.0D, (a, r) -> CASE WHEN r.category = {lit(category)} THEN a + r.weight + 0.5D ELSE a END)"
    return f"({score} + CASE WHEN {digits} THEN 1.5D ELSE 0.0D END)" if category == "Result" else score


def keyword_sum(joined: str, category: str, digits: str, pack: R.RulePack = R.DEFAULT_PACK) -> str:
    """The same score straight from the text, as compiled code without the array of rules."""
    score = _keyword_terms(joined, category, pack)
    return f"({score} + CASE WHEN {digits} THEN 1.5D ELSE 0.0D END)" if category == "Result" else score


def _keyword_terms(joined: str, category: str, pack: R.RulePack) -> str:
    terms = [V.Term(f"contains({joined}, {lit(n)})", f"({num(w)} + 0.5D)") for c, _, _, n, w in pack.keyword_rows() if c == category]
    return V.total(terms) if terms else "0.0D"


def add_scores(base: str, extra: str) -> str:
    """Sum of two score maps over all their keys."""
    return f"map_zip_with({base}, {extra}, (k, a, b) -> round(coalesce(a, 0.0D) + coalesce(b, 0.0D), 2))"


# --- texts that many frames share -----------------------------------------------------------------
def text_facts(pack: R.RulePack, of: list[str] | None) -> dict[str, str]:
    """Tests and counts over the text alone that classification uses: expression to the column that holds it."""
    hits = lambda key: count_terms("joined", [R.normalise_phrase(p) for p in R.PHRASES[key]])
    facts = {spoken(key): f"has_{key}" for key in R.PHRASES}
    facts |= {pat(e, key): f"{e}_{key}" for key in R.PATTERNS for e in ("joined", "compact")}
    facts |= {_keyword_terms("joined", c, pack): f"kw_{SLUG[c][2:]}" for c in R.SCORED_CATEGORIES}
    facts |= {f"contains(joined, '{w}')": f"word_{w}" for w in ("start", "win", "total", "collect")}
    facts |= {keyword_hits("joined", pack, of): "kw_hits", DIGITS: "any_digit", V.paytable_signal(): "text_paytable",
              feature_subtype("joined", pack)[0]: "text_subtype", count_terms("joined", R.PHRASES["control_word"]): "n_control_word",
              hits("active"): "n_active", hits("interaction"): "n_interaction", S.PAGE_LONG: "page_long", S.PAGE_TERMS: "page_terms",
              S.PAGE_DENSE: "page_dense", S.PAGE_HELP: "page_help"}
    return {e: c for e, c in facts.items() if e not in ("false", "0.0D")}


def reader(facts: dict[str, str]) -> Callable[[str], str]:
    """Puts columns in place of the expressions they hold, longest first."""
    order = sorted(facts, key=len, reverse=True)

    def read(sql: str) -> str:
        for e in order:
            sql = sql.replace(e, facts[e])
        return sql
    return read


def with_shared_text(frames: DataFrame, pack: R.RulePack = R.DEFAULT_PACK, of: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Frames with the text columns and facts, made once for each distinct list of line texts; and the facts.

    Frames of a still or returning screen show the same lines.  Where most frames have
    texts of their own nothing is gained: they come back as they are, without facts.
    """
    keyed = frames.withColumn("texts_", F.expr(line_texts()))
    texts = durable(keyed.groupBy("texts_").agg(F.count(F.lit(1)).alias("n_frames_")))
    n = texts.selectExpr("count(*) AS texts", "coalesce(sum(n_frames_), 0) AS frames").first()
    if 2 * n.texts > n.frames:
        return frames, {}
    facts = text_facts(pack, of)
    made = with_signals(with_text_of_lines(texts.drop("n_frames_"), "texts_", pack), *PURE_SIGNALS, *RECORD_SIGNALS)
    made = made.selectExpr("xxhash64(texts_) AS hash_", "texts_ AS own_", *[f"`{c}`" for c in made.columns if c not in ("texts_", "lines")],
                           *[f"{e} AS {c}" for e, c in (facts | {e: c for c, e in RECORD_FACTS.items()}).items()])
    made = durable(made)
    joined = keyed.withColumn("key_", F.expr("xxhash64(texts_)")).join(made, F.expr("key_ = hash_ AND texts_ <=> own_"))
    return joined.drop("texts_", "own_", "hash_", "key_"), facts


# --- bonuses -----------------------------------------------------------------------------------
def bonus_table() -> list[tuple[str, str, float, str]]:
    """(condition, category, amount, reason) in the published order of the rules."""
    calm = "NOT sig_loading_strong"
    cover, intro = both(calm, "sig_loading_cover"), both(calm, "sig_transition_cover")
    helped = "(sig_help_page AND NOT sig_loading_cover)"
    multi = both(spoken("multiplier_intro"), "NOT sig_large_result")
    start, teaser = both(calm, "sig_start_button"), "(sig_feature_intro AND NOT sig_feature_running)"
    return [
        ("sig_loading_strong", "loading", 10, "loading_strong"), ("sig_loading_strong", "Transition", -8, "loading_not_transition"),
        (cover, "loading", 14, "loading_cover_text"), (cover, "Help", -10, "loading_cover_not_help"),
        (cover, "Transition", -6, "loading_cover_not_transition"),
        (intro, "Transition", 16, "transition_cover_text"), (intro, "loading", -12, "transition_cover_not_loading"),
        (intro, "Help", -8, "transition_cover_not_help"),
        (helped, "Help", 16, "help_strong"), (helped, "Transition", -8, "help_not_transition"),
        (helped, "Feature game", -6, "help_not_feature_game"),
        ("sig_feature_buy", "Feature Buy", 16, "feature_buy_modal"), ("sig_feature_buy", "Transition", -6, "feature_buy_not_transition"),
        ("sig_feature_buy", "Basegame", -6, "feature_buy_not_basegame"),
        ("sig_bigwin_strong", "BigWin", 12, "bigwin_strong"), ("sig_result_strong", "Result", 8, "result_strong"),
        ("sig_large_result", "Result", 14, "large_result_layout"), ("sig_large_result", "Transition", -6, "result_not_transition"),
        (multi, "Transition", 12, "feature_intro_multiplier"), (multi, "Result", -14, "multiplier_not_result"),
        ("sig_feature_running", "Feature game", 10, "feature_running"),
        (teaser, "Transition", 14, "feature_intro_as_transition"), (teaser, "Feature game", -8, "intro_not_running_penalty"),
        ("sig_action_phrase", "Transition", 10, "transition_action"),
        (start, "Transition", 14, "large_lower_start_button"), (start, "Feature game", -6, "start_button_not_running_penalty"),
        (both("contains(joined, 'start')", "joined RLIKE '[0-9]'", calm), "Transition", 2, "start_digits"),
        (both(spoken("feature_terms"), "NOT sig_feature_running"), "Transition", 6, "feature_intro_terms"),
    ]


def bonus_total(category: str) -> str:
    terms = [V.Term(c, a) for c, cat, a, _ in bonus_table() if cat == category]
    return V.total(terms) if terms else "0.0D"


def _trace(rows: list[tuple[str, str, str]]) -> str:
    """Fired (category, reason) entries; categories and reasons are expressions."""
    return V.present([(cond, f"named_struct('category', {cat}, 'reason', {why})") for cond, cat, why in rows], _ENTRY_TYPE)


# --- text classification -----------------------------------------------------------------------------
def text_scores(df: DataFrame, pack: R.RulePack = R.DEFAULT_PACK, of: list[str] | None = None, read: Callable[[str], str] = str) -> DataFrame:
    """Keyword scores plus bonuses as ``s_*`` columns, hits as ``trace`` (of the categories ``of``, or all); needs the text signals."""
    df = df.selectExpr("*", f"{read(keyword_hits('joined', pack, of))} AS kw", f"{read(DIGITS)} AS digits")
    bonus = {c: read(bonus_total(c)) for c in R.SCORED_CATEGORIES}
    df = df.selectExpr("*", *[f"round({read(keyword_sum('joined', c, 'digits', pack))} + {bonus[c]}, 2) AS {SLUG[c]}" for c in R.SCORED_CATEGORIES],
                       "CASE WHEN sig_feature_buy THEN -6.0D END AS s_base")
    clamp = "(NOT sig_feature_buy AND s_buy > 0)"
    hits = ("transform(kw, r -> named_struct('category', r.category, 'reason', "
            "concat(r.keyword, ':', regexp_replace(CAST(r.weight AS STRING), '[.]0$', ''))))")
    rows = ([("digits AND exists(kw, r -> r.category = 'Result')", "Result", "result_digits:+1.5")]
            + [(c, cat, f"{why}:{a:+g}") for c, cat, a, why in bonus_table()]
            + [(clamp, "Feature Buy", "feature_buy_button_only_clamped")])
    more = _trace([(read(c), lit(cat), lit(why)) for c, cat, why in rows if of is None or cat in of])
    keep = [f"`{c}`" for c in df.columns if c not in ("s_buy", "kw", "digits")]
    return df.selectExpr(*keep, f"CASE WHEN {clamp} THEN least(s_buy, 2.0D) ELSE s_buy END AS s_buy", f"concat({hits}, {more}) AS trace")


def priority_stage() -> str:
    """(category, score, reason) of the first stage that holds; null when none does."""
    claimed = "(sig_result_strong OR sig_large_result)"
    stages = [
        ("loading", both("sig_loading_strong", "s_result < s_loading + 4", "s_bigwin < s_loading + 4"), "priority_loading"),
        ("Help", "sig_help_page", "priority_help"), ("Feature Buy", "sig_feature_buy", "priority_feature_buy"),
        ("BigWin", "sig_bigwin_strong", "priority_bigwin"), ("Feature game", "sig_feature_running", "priority_feature_running"),
        ("Result", both(claimed, "s_result > s_transition + 4"), "priority_result"),
        ("Transition", "sig_transition_strong", "priority_transition"), ("Result", claimed, "priority_result"),
    ]
    return "CASE " + " ".join(
        f"WHEN {cond} AND {SLUG[c]} >= {R.MIN_CATEGORY_SCORE}D THEN named_struct('category', {lit(c)}, 'score', {SLUG[c]}, 'reason', {lit(why)})"
        for c, cond, why in stages) + " END"


def argmax_category(scores: dict[str, str], floor: float = R.MIN_CATEGORY_SCORE, default: str = "Basegame") -> str:
    """Largest positive score, first in order on ties; ``default`` below the floor."""
    best = f"greatest(0.0D, {', '.join(scores.values())})"
    pick = " ".join(f"WHEN {v} = {best} THEN {lit(c)}" for c, v in scores.items())
    return f"named_struct('category', CASE WHEN {best} < {floor}D THEN {lit(default)} {pick} ELSE {lit(default)} END, 'score', {best})"


def classify_text(df: DataFrame, pack: R.RulePack = R.DEFAULT_PACK, of: list[str] | None = None, read: Callable[[str], str] = str) -> DataFrame:
    """Category and score of each frame from its text alone; reasons of the categories ``of``, or all."""
    df = text_scores(with_signals(df, *TEXT_SIGNALS, read=read), pack, of, read)
    keep = [f"`{c}`" for c in df.columns if c != "trace"]
    df = df.selectExpr("*", f"{priority_stage()} AS stage", f"{argmax_category({c: SLUG[c] for c in R.SCORED_CATEGORIES})} AS best")
    return df.selectExpr(*keep, "coalesce(stage.category, best.category) AS category", "coalesce(stage.score, best.score) AS top_score",
                         f"concat(trace, {_trace([('stage IS NOT NULL', 'stage.category', 'stage.reason')])}) AS trace")


def feature_subtype(joined: str, pack: R.RulePack = R.DEFAULT_PACK) -> tuple[str, str]:
    """(subtype, map of hit counts); the first largest count wins."""
    counts = {k: count_terms(joined, [R.normalise_phrase(t, pack.corrections) for t in terms]) for k, terms in pack.subtypes.items()}
    table = "map(" + ", ".join(f"{lit(k)}, {v}" for k, v in counts.items()) + ")"
    best = f"greatest({', '.join(counts.values())})"
    pick = " ".join(f"WHEN {v} = {best} THEN {lit(k)}" for k, v in counts.items())
    return f"CASE WHEN {best} = 0 THEN 'unknown_feature' {pick} END", table


# --- frame classification ----------------------------------------------------------------------------------
def _overrides() -> list[dict]:
    """Ordered rules: condition, new category, values that raise the top score, score floors, reason."""
    base, feat = f"ui_base >= {R.BASEGAME_UI_MIN}D", f"ui_feature >= {R.FEATURE_UI_KEEP}D"
    no_feat = f"ui_feature < {R.FEATURE_UI_KEEP}D"
    real = "(sig_large_result OR sig_collect_button)"
    start = either(["sig_start_button", spoken("start_action")])
    hint, free, act = spoken("trigger_hint"), spoken("free_game_text"), spoken("transition_action_text")
    claim = both("claim", f"({base} OR {feat})")
    counter = both(spoken("free_spin_any"), pat("joined", "short_number"))
    is_ = lambda c: f"category = {lit(c)}"
    no = lambda *xs: " AND ".join(f"NOT {x}" for x in xs)
    tag = lambda name, v="ui_base": V.coded(name, v)
    teaser = f"(sig_feature_intro AND NOT {hint})"
    swap = lambda a, b: f"CASE WHEN {feat} THEN {a} ELSE {b} END"
    text = lit
    return [
        dict(when="sig_blocking_modal", to="'Other'", top=["6.0D"], floors={"s_other": "6.0D"}, why=text("blocking_modal")),
        dict(when="brand_splash", to="'Other'", top=["8.0D"], floors={"s_other": "8.0D"}, why=text("brand_logo_splash")),
        dict(when="jackpot_pick", to="'Feature game'", top=["board", "12.0D"], floors={"s_feature": "12.0D"}, caps={"s_loading": "2.0D"},
             why=tag("jackpot_pick_bonus", "board")),
        dict(when=both("(splash OR sig_loading_cover)", no("sig_transition_cover", "sig_feature_buy", "bigwin_overlay", "jackpot_pick")),
             to="'loading'", top=["12.0D"], floors={"s_loading": "12.0D"},
             why="CASE WHEN sig_loading_cover THEN 'loading_cover_text' ELSE 'loading_splash_visual' END"),
        dict(when=both("sig_transition_cover", no("sig_loading_strong")), to="'Transition'", top=["s_transition", "16.0D"],
             floors={"s_transition": "16.0D"}, why=text("priority_transition_cover_text")),
        dict(when=both("active >= 8.0D", no("sig_help_page", "rules_page", "sig_loading_strong", "sig_loading_cover", "sig_feature_buy", "bigwin_overlay")),
             to="'Feature game'", top=["active"], floors={"s_feature": "active"}, why=text("priority_feature_active")),
        dict(when="bigwin_overlay", to="'BigWin'", top=["s_bigwin", "12.0D"], floors={"s_bigwin": "12.0D"}, why=text("priority_bigwin_overlay")),
        dict(when=both("(sig_help_page OR rules_page)", no("sig_loading_cover")), to="'Help'", top=["s_help", "12.0D"], floors={"s_help": "12.0D"},
             why="CASE WHEN sig_help_page THEN 'priority_help_page' ELSE 'priority_rules_help_page' END"),
        dict(when=both(is_("Help"), base, "paytable < 2.0D", no("rules_page", spoken("help"))), to="'Basegame'",
             set_top="greatest(ui_base, s_base)", floors={"s_base": "ui_base"}, why=tag("basegame_ui_over_weak_help")),
        dict(when=both("sig_feature_buy", "category <> 'Help'"), to="'Feature Buy'", top=["s_buy", "12.0D"], floors={"s_buy": "12.0D"},
             why=text("priority_feature_buy_modal")),
        dict(when=both(claim, is_("Result"), no(real, "sig_total_win")), to=swap("'Feature game'", "'Basegame'"), top=["ui_feature", "ui_base"],
             why="format_string('protected_ui_not_result:base=%.2f,feature=%.2f', ui_base, ui_feature)"),
        dict(when=both(claim, is_("Transition"), no_feat, no("sig_transition_cover", start, "rule_intro", teaser, free, act)), to="'Basegame'",
             top=["ui_base"], why=tag("protected_basegame_ui_not_transition")),
        dict(when=both(claim, is_("Transition"), either(["rule_intro", teaser])), note="'Transition'", why=text("protected_feature_rule_intro")),
        dict(when=both(is_("Transition"), base, "(rule_intro OR sig_feature_intro)", no_feat, no("sig_transition_cover", start), spoken("buy_or_auto")),
             to="'Basegame'", top=["ui_base"], floors={"s_base": "ui_base"}, why=tag("feature_rule_overlay_on_basegame_not_transition")),
        dict(when=both("category IN ('Help', 'Feature Buy', 'Result', 'Transition')", base, no_feat, "top_score <= ui_base + 1.5D",
                       no("sig_help_page", "sig_feature_buy", real, "sig_transition_cover", start, "rule_intro")), to="'Basegame'", top=["ui_base"],
             why=tag("protected_basegame_ui_low_confidence")),
        dict(when=both(is_("Basegame"), "sig_inline_banner"), to="'Other'", top=["4.0D"], floors={"s_other": "4.0D"},
             why=text("inline_win_banner_not_basegame")),
        dict(when=both(is_("Basegame"), f"NOT {base_control('ui_base_reasons')}"), to="'Other'", top=["ui_base"], floors={"s_other": "ui_base"},
             why=tag("basegame_missing_explicit_spin_control")),
        dict(when=both(is_("Basegame"), "sig_center_payout", "NOT sig_total_win",
                       f"NOT ({base} AND sig_jackpot_meter AND NOT (sig_bigwin_strong OR sig_total_win))"), to="'BigWin'", top=["6.0D"],
             floors={"s_bigwin": "6.0D"}, why=text("large_center_payout_text")),
        dict(when=both(is_("Basegame"), base, "sig_jackpot_meter"), note="'Basegame'", why=text("jackpot_meter_protected_as_basegame")),
        dict(when=both(is_("Basegame"), free, f"NOT {hint}", either(["rule_intro", feat, spoken("running_or_won")])),
             to=swap("'Feature game'", "'Transition'"), top=[swap("s_feature", "s_transition"), "ui_feature"], why=text("free_game_text_not_basegame")),
        dict(when=both(is_("Transition"), counter, "board >= 3.0D", no("sig_transition_cover", start, "rule_intro", act, real, "sig_total_win")),
             to="'Feature game'", top=["board", "ui_feature", "10.0D"], floors={"s_feature": "10.0D"},
             why=tag("free_spin_counter_over_reel_board", "board")),
        dict(when=both(is_("Basegame"), base), to="'Basegame'", top=["ui_base"], sets={"s_base": "round(ui_base, 2)"}, why=text("priority_basegame_ui")),
        dict(when=both(is_("Basegame"), f"NOT {base}"), to="'Other'", top=["ui_base"], why=tag("basegame_ui_too_weak")),
    ]


STATE_FREE = 8  # the first rules read signals only, never the category they change


def _note(n: int, rule: dict, fired: str | None = None) -> str:
    return f"CASE WHEN {fired or f'fired_{n}'} THEN named_struct('category', {rule.get('note') or rule['to']}, 'reason', {rule['why']}) END AS note_{n}"


def _scores_after(n: int, rule: dict, current: dict[str, str], fired: str | None = None) -> None:
    """Fold the score writes of one rule into the expressions of the score columns."""
    f = fired or f"fired_{n}"
    for c, v in rule.get("floors", {}).items():
        old = current.get(c, c)
        current[c] = f"CASE WHEN {f} THEN greatest(coalesce({old}, 0.0D), {v}) ELSE {old} END"
    for c, v in rule.get("caps", {}).items():
        old = current.get(c, c)
        current[c] = f"CASE WHEN {f} THEN least({old}, {v}) ELSE {old} END"
    for c, v in rule.get("sets", {}).items():
        current[c] = f"CASE WHEN {f} THEN {v} ELSE {current.get(c, c)} END"


def _select(df: DataFrame, flags: list[str], out: dict[str, str], notes: list[str]) -> DataFrame:
    """One projection: flags first, then the columns that read them."""
    keep = [f"`{c}`" for c in df.columns if c not in out and not c.startswith("fired_")]
    return df.selectExpr(*keep, *flags, *[f"{e} AS {c}" for c, e in out.items()], *notes)


def _apply_block(df: DataFrame, rules: list[tuple[int, dict]]) -> DataFrame:
    """Rules that do not read the category, as one step: the last fired one names it."""
    flags = [f"coalesce({r['when']}, false) AS fired_{n}" for n, r in rules]
    out = {"category": "CASE " + " ".join(f"WHEN fired_{n} THEN {r['to']}" for n, r in reversed(rules)) + " ELSE category END",
           "top_score": "greatest(top_score, " + ", ".join(f"CASE WHEN fired_{n} THEN greatest(top_score, {', '.join(r['top'])}) END" for n, r in rules) + ")"}
    for n, r in rules:
        _scores_after(n, r, out)
    return _select(df, flags, out, [_note(n, r) for n, r in rules])


def _apply(df: DataFrame, n: int, rule: dict) -> DataFrame:
    """One override on the state left by the rules before it.

    The condition stands first in every column that reads it, so it is evaluated
    once a row and needs no projection of its own.
    """
    f, out = f"coalesce({rule['when']}, false)", {}
    if "to" in rule:
        out["category"] = f"CASE WHEN {f} THEN {rule['to']} ELSE category END"
    if "set_top" in rule:
        out["top_score"] = f"CASE WHEN {f} THEN {rule['set_top']} ELSE top_score END"
    elif "top" in rule:
        out["top_score"] = f"CASE WHEN {f} THEN greatest(top_score, {', '.join(rule['top'])}) ELSE top_score END"
    _scores_after(n, rule, out, f)
    return _select(df, [], out, [_note(n, rule, f)])


def _with_columns_read(rule: dict, read: Callable[[str], str]) -> dict:
    part = lambda v: read(v) if isinstance(v, str) else [read(e) for e in v] if isinstance(v, list) else {c: read(e) for c, e in v.items()}
    return {k: part(v) for k, v in rule.items()}


def classify_frames(df: DataFrame, pack: R.RulePack = R.DEFAULT_PACK, rules: list[int] | None = None, reasons_of: list[str] | None = None,
                    facts: dict[str, str] | None = None, also: dict[str, str] | None = None) -> DataFrame:
    """Classify frames with ``items``, ROI size and measured columns.

    Adds ``category``, ``top_score``, ``category_scores``, ``matched_keywords``,
    ``feature_subtype`` with its scores, the interface scores and the text
    columns.  Stored scores of the same frames do not enter.  ``rules`` limits
    the overrides to the given positions.  With ``reasons_of`` frames of these categories alone
    have ``category_scores`` and ``matched_keywords``, with the reasons of these categories; none enters a decision.
    ``facts`` are those of ``with_shared_text`` where ``df`` comes from it.  ``also`` names columns made
    of the text, ``paytable`` and the measured columns: they are made before the
    overrides, which then do not hand on what they are made of.
    """
    also = also or {}
    read = reader(facts or {})
    made = {"forms", "joined", "compact", "page_lines", "page_joined", "page_compact", "record_lines", "record_text", "record_compact", *facts.values(),
            *RECORD_FACTS, *[f"sig_{n}" for n in PURE_SIGNALS + RECORD_SIGNALS]} if facts else set()
    carried = [*RECORD_FACTS, *[f"sig_{n}" for n in RECORD_SIGNALS], *dict.fromkeys(facts.values())] if facts else []
    keep = [f"`{c}`" for c in df.columns if c not in ("category", "top_score") and c not in made]
    df = with_lines(df.drop("category", "top_score")) if facts else with_text(df.selectExpr(*keep), pack)
    df = classify_text(df, pack, reasons_of, read)
    subtype, subtype_scores = feature_subtype("joined", pack)
    subtype = read(subtype)
    base, feature, board = V.basegame_ui_terms(), V.feature_ui_terms(), V.reel_board_terms()
    df = df.selectExpr("*", *map(read, [
        f"{V.total(base)} AS ui_base", f"{V.reasons(base)} AS ui_base_reasons", f"{V.total(feature)} AS ui_feature",
        f"{V.reasons(feature)} AS ui_feature_reasons", f"{V.total(board)} AS board", f"{V.reasons(board)} AS board_reasons",
        f"{V.paytable_signal()} AS paytable", f"{V.loading_splash()} AS splash", f"{V.brand_splash()} AS brand_splash",
        f"{V.payout_visual()} AS payout_visual",
        "category IN ('Result', 'Transition') AS claim", f"{both(spoken('rule_intro'), spoken('free_spin'))} AS rule_intro",
        "CAST(NULL AS DOUBLE) AS s_other"]))
    active = V.feature_active_terms("s_help", "s_loading", "s_result", "0.0D")
    df = df.selectExpr("*", *map(read, [
        f"round(greatest(0.0D, {V.total(active)}), 2) AS active", f"{V.reasons(active)} AS active_reasons",
        f"({rules_page('0.0D', 's_help', 'paytable')} AND NOT sig_feature_buy) AS rules_page",
        "((sig_bigwin_strong OR sig_bigwin_title) AND (sig_center_payout OR payout_visual OR sig_feature_running)) AS bigwin_overlay"]))
    df = df.selectExpr("*", *[f"{read(e)} AS {c}" for c, e in also.items()], read(both("board >= 3.0D", spoken("jackpot"), spoken("jackpot_pick"), "NOT sig_help_page", "NOT rules_page",
                                 f"{subtype} = 'pick'")) + " AS jackpot_pick")
    chain = [_with_columns_read(r, read) for r in _overrides()]
    used = list(range(len(chain))) if rules is None else list(rules)
    block = [(n, chain[n]) for n in used if n < STATE_FREE]
    if block:
        df = _apply_block(df, block)
    for n in used:
        if n >= STATE_FREE:
            df = _apply(df, n, chain[n])
    rungs, caps = V.bigwin_keep_rules("s_bigwin", "payout_visual")
    first_rung = "CASE " + " ".join(f"WHEN {c} THEN {lit(why)}" for c, _, why in rungs) + " END"
    why_keep = V.present([(f"({first_rung}) IS NOT NULL", first_rung), *((c, lit(w)) for c, _, w in caps if w)], "string")
    df = df.selectExpr("*", read(f"round({V.bigwin_keep_signal('s_bigwin', 'payout_visual')}, 2) AS bigwin_keep"), read(f"{why_keep} AS keep_reasons"),
                       f"{subtype} AS feature_subtype", f"{subtype_scores} AS feature_subtype_scores")
    asked = lambda e: e if reasons_of is None else f"CASE WHEN category IN ({', '.join(map(lit, reasons_of))}) THEN {e} END"
    return df.selectExpr(
        *keep, "category", "top_score", f"{asked(_score_map())} AS category_scores", f"{asked(_reason_map(used, reasons_of))} AS matched_keywords",
        "s_transition AS transition_score", *also, "feature_subtype",
        "feature_subtype_scores", "ui_base", "ui_feature", "board", "active", "paytable", "bigwin_keep",
        "joined", "compact", "lines", "page_lines", "record_lines", "record_text", "record_compact", *[f"sig_{n}" for n in TEXT_SIGNALS], *carried)


def _score_map() -> str:
    """Categories and auxiliary scores that have an entry."""
    entries = {**SLUG, "BasegameUI": "round(ui_base, 2)", "FeatureUI": "round(ui_feature, 2)", "FeatureBoard": "round(board, 2)",
               "FeatureActive": "active", "HelpPaytable": "CASE WHEN paytable > 0 THEN round(paytable, 2) END", "BigWinKeep": "bigwin_keep"}
    return "map_filter(map(" + ", ".join(f"{lit(k)}, {v}" for k, v in entries.items()) + "), (k, v) -> v IS NOT NULL)"


def _reason_map(used: list[int], of: list[str] | None = None) -> str:
    """Reasons by category, of the categories ``of`` or all; a note is left out where its rule never names one of them."""
    of, chain = R.CATEGORIES if of is None else of, _overrides()
    used = [n for n in used if any(lit(c) in (chain[n].get("note") or chain[n]["to"]) for c in of)]
    tagged = lambda cat, codes, fmt="r": f"transform({codes}, r -> named_struct('category', {lit(cat)}, 'reason', {fmt}))"
    notes = V.present([(f"note_{n} IS NOT NULL", f"note_{n}") for n in used], _ENTRY_TYPE)
    parts = [
        (None, "trace"), ("Basegame", tagged("Basegame", "ui_base_reasons")), ("Feature game", tagged("Feature game", "ui_feature_reasons")),
        ("Feature game", tagged("Feature game", "board_reasons")), ("Feature game", tagged("Feature game", "active_reasons", "concat('feature_active:', r)")),
        ("Feature game", _trace([("true", "'Feature game'", "concat('feature_subtype:', feature_subtype)")])),
        ("Help", _trace([("paytable > 0", "'Help'", V.coded("paytable_signal", "paytable"))])), (None, notes),
        ("BigWin", tagged("BigWin", "filter(keep_reasons, r -> category = 'BigWin')", "concat(r, format_string(':%.2f', bigwin_keep))"))]
    every = ", ".join(e for c, e in parts if c is None or c in of)
    names = "array(" + ", ".join(lit(c) for c in of) + ")"
    # the entries are bound once; inside the walk over the categories they would be made anew for each
    return f"transform(array(concat({every})), e -> map_from_arrays({names}, transform({names}, c -> transform(filter(e, t -> t.category = c), t -> t.reason))))[0]"


# --- confidence ----------------------------------------------------------------------------------------------
def confidence(category: str, top: str, scores: str, hits: str) -> str:
    """(level, score) from the margin of the two best map values and priority hits."""
    at = lambda n: f"coalesce(try_element_at(v.ranked, {n}), 0.0D)"
    best, margin, ui = at(1), f"({at(1)} - {at(2)})", V.map_score(scores, "BasegameUI")
    priority = "v.priority"
    bound = f"named_struct('ranked', sort_array(map_values({scores}), false), 'priority', exists(flatten(map_values({hits})), r -> contains(r, 'priority_')))"
    high = f"(({top} >= 14.0D AND ({margin} >= 8.0D OR {priority})) OR ({top} >= 10.0D AND {margin} >= 5.0D))"
    medium = f"(({top} >= 7.0D AND {margin} >= 3.0D) OR ({top} >= 10.0D AND {margin} >= 2.0D) OR ({priority} AND {top} >= 5.0D))"
    level = (f"CASE WHEN {category} = 'Basegame' THEN CASE WHEN {ui} >= 4.0D AND {margin} >= 3.0D THEN 'medium' ELSE 'low' END "
             f"WHEN {category} = 'Other' THEN CASE WHEN {best} >= 6.0D THEN 'medium' ELSE 'low' END "
             f"WHEN {high} THEN 'high' WHEN {medium} THEN 'medium' ELSE 'low' END")
    raw = (f"CASE WHEN {category} = 'Basegame' THEN {ui} * 0.1D + {margin} * 0.05D WHEN {category} = 'Other' THEN {best} * 0.05D "
           f"ELSE {top} * 0.04D + {margin} * 0.03D + CASE WHEN {priority} THEN 0.15D ELSE 0.0D END END")
    return f"transform(array({bound}), v -> named_struct('level', {level}, 'score', round(least(1.0D, {raw}), 3)))[0]"


def needs_review(level: str) -> str:
    return f"{level} IN ('medium', 'low')"


# fixed values: order of the categories on review cards
REVIEW_ORDER = ["Basegame", "Feature game", "Feature Buy", "BigWin", "Transition", "Help", "loading", "Result", "Other"]


def map_top_n(scores: str, n: int = 3, allowed: list[str] | None = None) -> str:
    """The n largest of the allowed categories (missing ones count 0), stable in their order."""
    rows = ", ".join(f"named_struct('neg', -{V.map_score(scores, c)}, 'pos', {i}, 'category', {lit(c)})" for i, c in enumerate(allowed or REVIEW_ORDER))
    return f"transform(slice(array_sort(array({rows})), 1, {n}), r -> named_struct('category', r.category, 'score', -r.neg))"
