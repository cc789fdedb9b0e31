"""Queries for category scoring, classification, confidence and metric scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scores as V
from ..functions import signals as S
from ..functions import text as T
from ..operators import classify as K
from . import fixtures as fx
from .registry import query
from .q_text import docs
from .sqlkit import CTES, any_sql, cte, dbl, norm_sql, pat_sql, q, substr_sql, with_sql

KEYS = ["video_id", "frame_idx"]


def text_frames(spark, sf):
    return T.with_text(fx.frames(spark, sf))


def r6(expr, name):
    return f"round({expr}, 6) AS {name}"


# --- SQL twins of the scores ---------------------------------------------------------------
def kw_sql(category: str, col: str = "joined") -> str:
    parts = [f"CASE WHEN contains({col},{q(n)}) THEN {w + 0.5} ELSE 0 END" for c, _, _, n, w in R.DEFAULT_PACK.keyword_rows() if c == category]
    if category == "Result":
        parts.append(f"CASE WHEN regexp_matches({col},'[0-9]') THEN 1.5 ELSE 0 END")
    return dbl("(" + "+".join(parts) + ")")


def whens(*rows) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w in rows) + ")"


_DIG = "regexp_matches(joined,'[0-9]')"
BONUS_SQL = {
    "loading": whens(("loading_strong", 10), ("NOT loading_strong AND loading_cover", 14), ("transition_cover AND NOT loading_strong", -12)),
    "BigWin": whens(("bigwin_strong", 12)),
    "Transition": whens(("loading_strong", -8), ("NOT loading_strong AND loading_cover", -6), ("transition_cover AND NOT loading_strong", 16),
                        ("help_page AND NOT loading_cover", -8), ("feature_buy", -6), ("large_result", -6),
                        (f"{any_sql('joined', 'multiplier_intro')} AND NOT large_result", 12),
                        ("feature_intro AND NOT feature_running", 14), ("action_phrase", 10), ("start_button AND NOT loading_strong", 14),
                        (f"contains(joined,'start') AND {_DIG} AND NOT loading_strong", 2),
                        (f"{any_sql('joined', 'feature_terms')} AND NOT feature_running", 6)),
    "Feature game": whens(("help_page AND NOT loading_cover", -6), ("feature_running", 10), ("feature_intro AND NOT feature_running", -8),
                          ("start_button AND NOT loading_strong", -6)),
    "Feature Buy": whens(("feature_buy", 16)),
    "Help": whens(("NOT loading_strong AND loading_cover", -10), ("transition_cover AND NOT loading_strong", -8), ("help_page AND NOT loading_cover", 16)),
    "Result": whens(("result_strong", 8), ("large_result", 14), (f"{any_sql('joined', 'multiplier_intro')} AND NOT large_result", -14)),
}
cte("kw", "signals", "SELECT *, " + ", ".join(f"{kw_sql(c)} AS k{K.SLUG[c][1:]}" for c in R.SCORED_CATEGORIES) + " FROM signals")
cte("scored", "kw", "SELECT * REPLACE (CASE WHEN NOT feature_buy AND s_buy > 0 THEN least(s_buy, 2.0) ELSE s_buy END AS s_buy) FROM (SELECT *, "
    + ", ".join(f"k{K.SLUG[c][1:]} + {BONUS_SQL[c]} AS {K.SLUG[c]}" for c in R.SCORED_CATEGORIES)
    + ", CASE WHEN feature_buy THEN -6.0::DOUBLE END AS s_base, NULL::DOUBLE AS s_other FROM kw)")
_BEST = "greatest(0.0, s_loading, s_bigwin, s_transition, s_feature, s_buy, s_help, s_result)"
_STAGES = [("loading", "loading_strong AND s_loading >= 3 AND s_result < s_loading + 4 AND s_bigwin < s_loading + 4", "s_loading"),
           ("Help", "help_page AND s_help >= 3", "s_help"), ("Feature Buy", "feature_buy AND s_buy >= 3", "s_buy"),
           ("BigWin", "bigwin_strong AND s_bigwin >= 3", "s_bigwin"), ("Feature game", "feature_running AND s_feature >= 3", "s_feature"),
           ("Result", "(result_strong OR large_result) AND s_result >= 3 AND s_result > s_transition + 4", "s_result"),
           ("Transition", "transition_strong AND s_transition >= 3", "s_transition"),
           ("Result", "(result_strong OR large_result) AND s_result >= 3", "s_result")]
_PICK = (f"CASE WHEN {_BEST} < 3 THEN 'Basegame' " + " ".join(f"WHEN {K.SLUG[c]} = {_BEST} THEN {q(c)}" for c in R.SCORED_CATEGORIES) + " END")
cte("text_class", "scored", "SELECT *, CASE " + " ".join(f"WHEN {c} THEN {q(n)}" for n, c, _ in _STAGES) + f" ELSE {_PICK} END AS category, CASE "
    + " ".join(f"WHEN {c} THEN {v}" for _, c, v in _STAGES) + f" ELSE {_BEST} END AS top_score, CASE "
    + " ".join(f"WHEN {c} THEN {q(n)}" for n, c, _ in _STAGES) + " END AS stage FROM scored")

# metric scores over the fixtures
_MONEY = f"({pat_sql('joined', 'money')} OR {pat_sql('joined', 'decimal')})"
_CTRL = "(" + "+".join(f"contains(joined,{q(w)})::INT" for w in R.PHRASES["control_word"]) + ")"
METRIC_SQL = {
    "ui_base": whens(("dark_ratio >= 0.16", 0.8), ("edge_ratio BETWEEN 0.035 AND 0.16", 0.5), ("circle_count >= 2", 1.3), ("circle_count = 1", 0.6),
                     ("center_blocks > 0", 0.7), ("spin_blocks > 0", 1.2), (any_sql("joined", "control_word"), 0.8), (f"{_CTRL} >= 2", 0.8),
                     (_MONEY, 0.4), (f"{any_sql('joined', 'buy_button')} AND NOT {any_sql('joined', 'buy_dialog')}", 0.9),
                     (f"{any_sql('joined', 'auto_turbo')} AND {_MONEY}", 0.8), ("contains(joined,'plus') AND contains(joined,'minus')", 0.4)),
    "ui_feature": whens(("feature_running", 2.5), (any_sql("joined", "explicit_remaining"), 2.5),
                        (f"{pat_sql('joined', 'left_number')} OR {pat_sql('joined', 'number_left')}", 1.2), ("n_lower >= 2", 2.0), ("n_lower = 1", 0.8),
                        ("bottom_dark_ratio >= 0.12", 0.4), (f"{_DIG} AND {any_sql('joined', 'counter_words')}", 0.5)),
    "board": whens(("edge_ratio >= 0.05", 1.2), ("lap_var >= 520", 0.9), ("colour_ratio >= 0.3", 0.7), ("vertical_lines >= 3", 1.2),
                   ("horizontal_lines >= 2", 0.8), ("vertical_lines >= 3 AND horizontal_lines >= 2", 1.0)),
    "brand_splash": f"(n_text BETWEEN 1 AND 5 AND NOT {any_sql('joined', 'brand_block')} AND ({any_sql('joined', 'brand')} OR compact IN ('fc','fclogo'))"
                    " AND plain_ratio >= 0.65 AND logo_ratio >= 0.04 AND edge_ratio <= 0.09)",
    "payout_visual": "((gold_blocks >= 2 AND gold_ratio >= 0.014 AND centre_dark_ratio >= 0.12) OR (wide_blocks >= 2 AND centre_dark_ratio >= 0.10))",
    "splash": f"(loading_cover OR (NOT ({any_sql('joined', 'jackpot')} AND {any_sql('joined', 'jackpot_pick')}) AND {any_sql('joined', 'legal')} AND "
              f"(NOT {any_sql('joined', 'real_ui')} OR {any_sql('joined', 'cover_like')}) AND (bar_flag OR (n_legal + n_button >= 4 AND "
              f"(contains(compact,'ver') OR contains(compact,'certified'))) OR ({any_sql('joined', 'cover_like')} AND (n_title >= 1 OR n_button >= 1 OR "
              "contains(compact,'getstarted') OR contains(compact,'rightreserved') OR contains(compact,'rightsreserved'))))))",
    "subtype_counts": "list_value(" + ", ".join(
        "(" + "+".join(f"contains(joined,{q(R.normalise_phrase(t))})::INT" for t in terms) + ")" for terms in R.FEATURE_SUBTYPES.values()) + ")",
    "rule_intro": f"({any_sql('joined', 'rule_intro')} AND {any_sql('joined', 'free_spin')})",
    "active_base": whens(("feature_running", 8), (f"{pat_sql('joined', 'fraction')}", 2.5),
                         (f"{pat_sql('joined', 'times_number')} OR {pat_sql('joined', 'number_times')}", 2.5), (pat_sql("joined", "win_colon"), 3),
                         ("contains(compact,'tap') AND regexp_matches(compact,'shoot|pick|reveal')", 3), ("loading_strong OR loading_cover", -8),
                         ("transition_cover", -5))
                   + " + least(10.0, 2.0 * (" + "+".join(f"contains(joined,{q(R.normalise_phrase(t))})::INT" for t in R.PHRASES["active"]) + "))"
                   + " + least(6.0, 2.5 * (" + "+".join(f"contains(joined,{q(R.normalise_phrase(t))})::INT" for t in R.PHRASES["interaction"]) + "))",
}
cte("measured", "text_class metrics_fx", "SELECT * EXCLUDE (m_category) FROM (SELECT t.*, m.* EXCLUDE (video_id, frame_idx, category), m.category AS m_category, "
    + ", ".join(f"{e} AS {n}" for n, e in METRIC_SQL.items()) + " FROM text_class t JOIN metrics_fx m USING (video_id, frame_idx))")

# --- C: scoring ------------------------------------------------------------------------------------


@query("c1_keyword_rules")
def _(spark, sf):
    """Rule rows of the active pack with the number of documents each keyword occurs in."""
    pack = R.DEFAULT_PACK.with_files(spark, keywords_path=f"{sf}/keyword_rules.yaml")
    d = docs(spark, sf).selectExpr(f"{T.normalize_text('text', pack)} AS joined")
    hits = d.selectExpr(f"inline({K.keyword_hits('joined', pack)})").groupBy("category", "keyword").count()
    rules = spark.createDataFrame(pack.keyword_rows(), "category string, ordinal int, keyword string, norm string, weight double")
    return rules.join(hits, ["category", "keyword"], "left").selectExpr(
        "category", "ordinal", "keyword", "weight", "coalesce(count, 0L) AS n_docs")


@query("c2_keyword_score", with_sql("kw", "SELECT video_id, frame_idx, " + ", ".join(f"k{K.SLUG[c][1:]}" for c in R.SCORED_CATEGORIES) + " FROM kw"))
def _(spark, sf):
    df = text_frames(spark, sf).selectExpr(*KEYS, f"{K.keyword_hits('joined')} AS kw", "joined RLIKE '[0-9]' AS digits")
    return df.selectExpr(*KEYS, *[f"{K.keyword_score('kw', c, 'digits')} AS k{K.SLUG[c][1:]}" for c in R.SCORED_CATEGORIES])


@query("c2_keyword_score_documents", "SELECT doc_id, " + ", ".join(f"{kw_sql(c, 'n')} AS k{K.SLUG[c][1:]}" for c in R.SCORED_CATEGORIES)
       + f" FROM (SELECT doc_id, {norm_sql('text')} AS n FROM documents)")
def _(spark, sf):
    df = docs(spark, sf).selectExpr("doc_id", f"{T.normalize_text('text')} AS n")
    df = df.selectExpr("doc_id", f"{K.keyword_hits('n')} AS kw", "n RLIKE '[0-9]' AS digits")
    return df.selectExpr("doc_id", *[f"{K.keyword_score('kw', c, 'digits')} AS k{K.SLUG[c][1:]}" for c in R.SCORED_CATEGORIES])


@query("c3_add_score", with_sql("frames_fx", """SELECT video_id, frame_idx, round(top_score + noise_score, 2) AS help, round(feature_ui_score, 2) AS feature,
  round(-8.0 + noise_score, 2) AS transition FROM frames_fx"""))
def _(spark, sf):
    m = K.add_scores("map('Help', top_score, 'Feature game', feature_ui_score)", "map('Help', noise_score, 'Transition', noise_score - 8.0D)")
    d = fx.scores(spark, sf).selectExpr(*KEYS, f"{m} AS m")
    return d.selectExpr(*KEYS, "m['Help'] AS help", "m['Feature game'] AS feature", "m['Transition'] AS transition")


@query("c4_rule_bonuses", with_sql("signals", "SELECT video_id, frame_idx, " + ", ".join(f"{dbl(BONUS_SQL[c])} AS b{K.SLUG[c][1:]}" for c in R.SCORED_CATEGORIES)
                                   + " FROM signals"))
def _(spark, sf):
    df = S.with_signals(text_frames(spark, sf), *K.TEXT_SIGNALS)
    return df.selectExpr(*KEYS, *[f"{K.bonus_total(c)} AS b{K.SLUG[c][1:]}" for c in R.SCORED_CATEGORIES])


def _scored(spark, sf):
    return K.text_scores(S.with_signals(text_frames(spark, sf), *K.TEXT_SIGNALS))


@query("c5_clamp_category", with_sql("scored", "SELECT video_id, frame_idx, s_buy FROM scored"))
def _(spark, sf):
    return _scored(spark, sf).select(*KEYS, "s_buy")


@query("c6_priority_choice", with_sql("text_class", "SELECT video_id, frame_idx, coalesce(stage,'none') AS stage FROM text_class"))
def _(spark, sf):
    return _scored(spark, sf).selectExpr(*KEYS, f"coalesce(({K.priority_stage()}).category, 'none') AS stage")


@query("c7_argmax_category", with_sql("scored", f"SELECT video_id, frame_idx, {_PICK} AS category, {_BEST}::DOUBLE AS best FROM scored"))
def _(spark, sf):
    b = _scored(spark, sf).selectExpr(*KEYS, f"{K.argmax_category({c: K.SLUG[c] for c in R.SCORED_CATEGORIES})} AS b")
    return b.selectExpr(*KEYS, "b.category", "b.score AS best")


@query("c8_classify_text", with_sql("text_class", "SELECT video_id, frame_idx, category, top_score::DOUBLE AS top_score, s_help, s_transition, s_result FROM text_class"))
def _(spark, sf):
    df = K.classify_text(T.with_text(fx.frames(spark, sf).drop("category", "top_score")))
    return df.select(*KEYS, "category", "top_score", "s_help", "s_transition", "s_result")


# frame classification: the override list as SQL steps on (category, top_score, s_*)
_FREE, _HINT, _ACT = any_sql("joined", "free_game_text"), any_sql("joined", "trigger_hint"), any_sql("joined", "transition_action_text")
_REAL = "(large_result OR collect_button)"
_START = f"(start_button OR {any_sql('joined', 'start_action')})"
_CLAIM = "claim AND (ui_base >= 2.5 OR ui_feature >= 3.5)"
_CONTROL = (f"({any_sql('joined', 'control')} OR (contains(joined,'plus') AND contains(joined,'minus')) OR ({any_sql('joined', 'auto_turbo')} AND {_MONEY})"
            f" OR ((center_blocks > 0 OR spin_blocks > 0) AND (circle_count >= 3 OR ({_MONEY} AND ({any_sql('joined', 'money_word')} OR circle_count >= 2"
            f" OR ({any_sql('joined', 'buy_button')} AND NOT {any_sql('joined', 'buy_dialog')}))))))")
_SUBTYPE = ("CASE WHEN list_max(subtype_counts) = 0 THEN 'unknown_feature' ELSE list_value("
            + ",".join(q(k) for k in R.FEATURE_SUBTYPES) + ")[list_position(subtype_counts, list_max(subtype_counts))] END")


def mx(*vals):
    return "greatest(" + ",".join(vals) + ")::DOUBLE"


def c0(col):
    return f"coalesce({col},0)"


C9_STEPS = [
    ("blocking_modal", "'Other'", mx("top_score", "6"), {"s_other": mx(c0("s_other"), "6")}),
    ("brand_splash", "'Other'", mx("top_score", "8"), {"s_other": mx(c0("s_other"), "8")}),
    ("jackpot_pick", "'Feature game'", mx("top_score", "board", "12"), {"s_feature": mx("s_feature", "12"), "s_loading": "least(s_loading,2)"}),
    ("(splash OR loading_cover) AND NOT transition_cover AND NOT feature_buy AND NOT overlay AND NOT jackpot_pick", "'loading'", mx("top_score", "12"),
     {"s_loading": mx("s_loading", "12")}),
    ("transition_cover AND NOT loading_strong", "'Transition'", mx("top_score", "s_transition", "16"), {"s_transition": mx("s_transition", "16")}),
    ("active >= 8 AND NOT help_page AND NOT rules_page AND NOT loading_strong AND NOT loading_cover AND NOT feature_buy AND NOT overlay", "'Feature game'",
     mx("top_score", "active"), {"s_feature": mx("s_feature", "active")}),
    ("overlay", "'BigWin'", mx("top_score", "s_bigwin", "12"), {"s_bigwin": mx("s_bigwin", "12")}),
    ("(help_page OR rules_page) AND NOT loading_cover", "'Help'", mx("top_score", "s_help", "12"), {"s_help": mx("s_help", "12")}),
    (f"category = 'Help' AND ui_base >= 2.5 AND NOT rules_page AND paytable_signal < 2 AND NOT {any_sql('joined', 'help')}", "'Basegame'",
     mx("ui_base", c0("s_base")), {"s_base": mx(c0("s_base"), "ui_base")}),
    ("feature_buy AND category <> 'Help'", "'Feature Buy'", mx("top_score", "s_buy", "12"), {"s_buy": mx("s_buy", "12")}),
    (f"{_CLAIM} AND category = 'Result' AND NOT {_REAL} AND NOT total_win", "CASE WHEN ui_feature >= 3.5 THEN 'Feature game' ELSE 'Basegame' END",
     mx("top_score", "ui_feature", "ui_base"), {}),
    (f"{_CLAIM} AND category = 'Transition' AND NOT transition_cover AND NOT {_START} AND ui_feature < 3.5 AND NOT rule_intro AND NOT (feature_intro AND NOT {_HINT})"
     f" AND NOT {_FREE} AND NOT {_ACT}", "'Basegame'", mx("top_score", "ui_base"), {}),
    (f"category = 'Transition' AND ui_base >= 2.5 AND (rule_intro OR feature_intro) AND NOT transition_cover AND NOT {_START} AND ui_feature < 3.5 AND "
     f"{any_sql('joined', 'buy_or_auto')}", "'Basegame'", mx("top_score", "ui_base"), {"s_base": mx(c0("s_base"), "ui_base")}),
    (f"category IN ('Help','Feature Buy','Result','Transition') AND ui_base >= 2.5 AND NOT help_page AND NOT feature_buy AND NOT {_REAL} AND NOT transition_cover"
     f" AND NOT {_START} AND ui_feature < 3.5 AND NOT rule_intro AND top_score <= ui_base + 1.5", "'Basegame'", mx("top_score", "ui_base"), {}),
    ("category = 'Basegame' AND inline_banner", "'Other'", mx("top_score", "4"), {"s_other": mx(c0("s_other"), "4")}),
    (f"category = 'Basegame' AND NOT {_CONTROL}", "'Other'", mx("top_score", "ui_base"), {"s_other": mx(c0("s_other"), "ui_base")}),
    ("category = 'Basegame' AND center_payout AND NOT total_win AND NOT (ui_base >= 2.5 AND jackpot_meter AND NOT (bigwin_strong OR total_win))", "'BigWin'",
     mx("top_score", "6"), {"s_bigwin": mx("s_bigwin", "6")}),
    (f"category = 'Basegame' AND {_FREE} AND NOT {_HINT} AND (rule_intro OR ui_feature >= 3.5 OR {any_sql('joined', 'running_or_won')})",
     "CASE WHEN ui_feature >= 3.5 THEN 'Feature game' ELSE 'Transition' END",
     mx("top_score", "CASE WHEN ui_feature >= 3.5 THEN s_feature ELSE s_transition END", "ui_feature"), {}),
    (f"category = 'Transition' AND {any_sql('joined', 'free_spin_any')} AND {pat_sql('joined', 'short_number')} AND board >= 3 AND NOT transition_cover AND NOT {_START}"
     f" AND NOT rule_intro AND NOT {_ACT} AND NOT {_REAL} AND NOT total_win", "'Feature game'", mx("top_score", "board", "ui_feature", "10"),
     {"s_feature": mx("s_feature", "10")}),
    ("category = 'Basegame' AND ui_base >= 2.5", "'Basegame'", mx("top_score", "ui_base"), {"s_base": "round(ui_base,2)::DOUBLE"}),
    ("category = 'Basegame' AND ui_base < 2.5", "'Other'", mx("top_score", "ui_base"), {}),
]
from .q_text import RULES_PAGE_SQL  # noqa: E402

cte("frame_in", "measured", f"""SELECT * REPLACE (ui_base::DOUBLE AS ui_base, ui_feature::DOUBLE AS ui_feature, board::DOUBLE AS board, top_score::DOUBLE AS top_score),
  round(greatest(0, active_base - CASE WHEN help_page THEN 5 ELSE 0 END - CASE WHEN s_result >= 12 AND NOT {any_sql('joined', 'result_keep')} THEN 6 ELSE 0 END
   - CASE WHEN s_help >= 12 THEN 3 ELSE 0 END - CASE WHEN s_loading >= 12 THEN 3 ELSE 0 END), 2)::DOUBLE AS active,
  ({RULES_PAGE_SQL.format(quality='0.0', help='s_help', paytable='paytable_signal')}) AND NOT feature_buy AS rules_page,
  (bigwin_strong OR bigwin_title) AND (center_payout OR payout_visual OR feature_running) AS overlay,
  category IN ('Result','Transition') AS claim, {_SUBTYPE} AS subtype FROM measured""")
cte("frame_0", "frame_in", f"""SELECT *, subtype = 'pick' AND board >= 3 AND {any_sql('joined', 'jackpot')} AND {any_sql('joined', 'jackpot_pick')}
  AND NOT help_page AND NOT rules_page AS jackpot_pick FROM frame_in""")


def _step(n, cond, to, top, sets):
    rep = [f"CASE WHEN {cond} THEN {to} ELSE category END AS category", f"CASE WHEN {cond} THEN {top} ELSE top_score END AS top_score"]
    rep += [f"CASE WHEN {cond} THEN {v} ELSE {c} END AS {c}" for c, v in sets.items()]
    cte(f"frame_{n}", f"frame_{n - 1}", f"SELECT * REPLACE ({', '.join(rep)}) FROM frame_{n - 1}")


for _n, _s in enumerate(C9_STEPS, 1):
    _step(_n, *_s)
_LAST = f"frame_{len(C9_STEPS)}"
_NUMBERS = "regexp_matches(joined,'\\d[\\d,. ]{2,}')"
BIGWIN_KEEP_SQL = f"""least(CASE WHEN (bigwin_strong OR bigwin_title) AND (center_payout OR payout_visual) THEN 14
  WHEN (bigwin_strong OR bigwin_title) AND {_NUMBERS} THEN 12 WHEN total_win AND large_result AND {_NUMBERS} THEN 11
  WHEN s_bigwin >= 12 AND bigwin_strong THEN 10 ELSE 0 END,
  CASE WHEN jackpot_meter AND NOT (bigwin_strong OR total_win) THEN 2 ELSE 99 END,
  CASE WHEN (center_payout OR payout_visual) AND NOT (bigwin_strong OR total_win) THEN 4 ELSE 99 END,
  CASE WHEN {any_sql('joined', 'bigwin_other')} AND NOT (bigwin_strong OR total_win) THEN 3 ELSE 99 END,
  CASE WHEN inline_banner AND NOT (bigwin_strong OR total_win) THEN 2 ELSE 99 END,
  CASE WHEN {pat_sql('compact', 'free_start')} AND NOT {pat_sql('compact', 'tier_win')} THEN 6 ELSE 99 END)::DOUBLE"""
cte("classified", _LAST, f"SELECT *, {BIGWIN_KEEP_SQL} AS bigwin_keep FROM {_LAST}")

_MAP_VALUES = ("list_filter(list_value(s_loading, s_bigwin, s_transition, s_feature, s_buy, s_help, s_result, s_base, s_other, round(ui_base,2), round(ui_feature,2),"
               " round(board,2), active, CASE WHEN paytable_signal > 0 THEN round(paytable_signal,2) END, bigwin_keep), lambda v: v IS NOT NULL)")


@query("c9_classify_frame", with_sql("classified", f"""SELECT video_id, frame_idx, category, round(top_score,6) AS top_score, bigwin_keep, round(ui_base,6) AS ui_base,
  round(ui_feature,6) AS ui_feature, active, subtype AS feature_subtype, len({_MAP_VALUES}) AS n_scores,
  round(list_sum({_MAP_VALUES}),6)::DOUBLE AS score_sum FROM classified"""))
def _(spark, sf):
    df = K.classify_frames(fx.frames(spark, sf))
    return df.selectExpr(*KEYS, "category", r6("top_score", "top_score"), "bigwin_keep", r6("ui_base", "ui_base"), r6("ui_feature", "ui_feature"),
                         "active", "feature_subtype", "CAST(size(category_scores) AS BIGINT) AS n_scores",
                         r6("aggregate(map_values(category_scores), 0.0D, (a, v) -> a + v)", "score_sum"))


@query("c10_feature_subtype", with_sql("measured", f"SELECT video_id, frame_idx, {_SUBTYPE} AS subtype, list_max(subtype_counts)::INTEGER AS hits FROM measured"))
def _(spark, sf):
    sub, counts = K.feature_subtype("joined")
    return text_frames(spark, sf).selectExpr(*KEYS, f"{sub} AS subtype", f"array_max(map_values({counts})) AS hits")


@query("c11_feature_active_score", with_sql("frame_in", "SELECT video_id, frame_idx, active FROM frame_in"))
def _(spark, sf):
    score = V.total(V.feature_active_terms("s_help", "s_loading", "s_result", "0.0D"))
    return _scored(spark, sf).selectExpr(*KEYS, f"round(greatest(0.0D, {score}), 2) AS active")


@query("c12_transition_keep_score", with_sql("scored frames_fx", "SELECT video_id, frame_idx, round(s_transition + " + whens(
    ("transition_cover", 30), (f"{any_sql('joined', 'free_spin')} AND {_DIG}", 5), (any_sql("joined", "rule_intro"), 4),
    (f"{any_sql('joined', 'start_overlay')} AND NOT transition_cover", -4), ("start_button AND NOT transition_cover", -5),
    (any_sql("joined", "running_label"), -4), (any_sql("joined", "trigger_or_buy"), -5), ("basegame_ui_score >= 3.0", -1.5),
    (f"basegame_ui_score >= 3.0 AND NOT transition_cover AND {any_sql('joined', 'buy_or_auto')}", -12)) + """,6)::DOUBLE AS keep_score
  FROM scored JOIN frames_fx USING (video_id, frame_idx)"""))
def _(spark, sf):
    score = V.total(V.transition_keep_terms("s_transition", "basegame_ui_score"))
    return _scored(spark, sf).selectExpr(*KEYS, r6(score, "keep_score"))


@query("c13_bigwin_keep_signal", with_sql("measured", f"SELECT video_id, frame_idx, {BIGWIN_KEEP_SQL} AS keep_signal FROM measured"))
def _(spark, sf):
    return _scored(spark, sf).selectExpr(*KEYS, f"{V.bigwin_keep_signal('s_bigwin', V.payout_visual())} AS keep_signal")


@query("c14_paytable_signal", with_sql("signals", "SELECT video_id, frame_idx, paytable_signal AS score FROM signals"))
def _(spark, sf):
    return text_frames(spark, sf).selectExpr(*KEYS, f"{V.paytable_signal()} AS score")


_PT = r"trim(regexp_replace(regexp_replace(lower(text),'[^a-z0-9.$/%+\-\s]',' ','g'),'\s+',' ','g'))"
cte("page_text", "ocr_fx", f"SELECT video_id, frame_idx, coalesce(string_agg({_PT},' ' ORDER BY line_no) FILTER (ocr_score >= 0.45),'') AS pt FROM ocr_fx GROUP BY 1,2")
cte("page_counts", "page_text", r"""SELECT *, len(regexp_extract_all(pt,'\b\d{1,4}(?:[,.]\d+)?\b')) AS n_num,
  len(regexp_extract_all(pt,'\b\d{1,3}\s*-\s*\d{1,4}(?:[,.]\d+)?\b')) AS n_pair, len(regexp_extract_all(pt,'\bfull\s+\d{1,4}(?:[,.]\d+)?\b')) AS n_full FROM page_text""")
PAGE_TEXT_SQL = whens((substr_sql("pt", R.PAYOUT_TITLE_TERMS), 4), ("contains(pt,'multiplier symbol')", 3),
                      (r"NOT contains(pt,'multiplier symbol') AND regexp_matches(pt,'\bpay\s*table\b|\bpaytable\b')", 1),
                      ("regexp_matches(pt,'wild|scatter')", 1.5), ("regexp_matches(pt,'paylines|pay lines|ways|full')", 1),
                      ("n_num >= 10", "least(3.0, n_num/8.0)"), ("n_pair >= 3", 3), ("n_full >= 2", 2))


def page_text(df):
    """Add the amount-keeping page text of the items at or above 0.45."""
    return df.selectExpr("*", f"array_join(transform({T.keep_scored('items', 0.45)}, t -> {T.normalize_paytable('t.text')}), ' ') AS page_text")


@query("c15_paytable_text_score", with_sql("page_counts", f"SELECT video_id, frame_idx, round({PAGE_TEXT_SQL},6)::DOUBLE AS score FROM page_counts"))
def _(spark, sf):
    return page_text(fx.frames(spark, sf)).selectExpr(*KEYS, r6(V.total(V.paytable_text_terms("page_text")), "score"))


_MARGIN = "(v[1] - v[2])"
_PRIO = "(frame_idx % 3 = 0)"
CONF_LEVEL_SQL = f"""CASE WHEN category = 'Basegame' THEN CASE WHEN basegame_ui_score >= 4 AND {_MARGIN} >= 3 THEN 'medium' ELSE 'low' END
  WHEN category = 'Other' THEN CASE WHEN v[1] >= 6 THEN 'medium' ELSE 'low' END
  WHEN top_score >= 14 AND ({_MARGIN} >= 8 OR {_PRIO}) THEN 'high' WHEN top_score >= 10 AND {_MARGIN} >= 5 THEN 'high'
  WHEN (top_score >= 7 AND {_MARGIN} >= 3) OR (top_score >= 10 AND {_MARGIN} >= 2) OR ({_PRIO} AND top_score >= 5) THEN 'medium' ELSE 'low' END"""
CONF_SCORE_SQL = f"""round(least(1.0, CASE WHEN category = 'Basegame' THEN basegame_ui_score*0.1 + {_MARGIN}*0.05 WHEN category = 'Other' THEN v[1]*0.05
  ELSE top_score*0.04 + {_MARGIN}*0.03 + CASE WHEN {_PRIO} THEN 0.15 ELSE 0 END END), 3)::DOUBLE"""
cte("confident", "frames_fx", f"""SELECT *, {CONF_LEVEL_SQL} AS level, {CONF_SCORE_SQL} AS conf_score FROM (SELECT *, list_reverse_sort(list_value(top_score,
  basegame_ui_score, feature_ui_score, feature_active_score, bigwin_keep_signal)) AS v FROM frames_fx)""")


# score map of the fixture frames: the category's own score and four auxiliary entries
SCORE_MAP = ("map(category, top_score, 'BasegameUI', basegame_ui_score, 'FeatureUI', feature_ui_score, 'FeatureActive', feature_active_score, "
             "'BigWinKeep', bigwin_keep_signal)")


def with_confidence(df):
    df = df.selectExpr("*", f"{SCORE_MAP} AS category_scores",
                       "map(category, array(CASE WHEN frame_idx % 3 = 0 THEN 'priority_rule' ELSE 'kw:1' END)) AS matched_keywords")
    df = df.selectExpr("*", f"{K.confidence('category', 'top_score', 'category_scores', 'matched_keywords')} AS conf")
    return df.selectExpr("*", "conf.level AS level", "conf.score AS conf_score").drop("conf")


@query("c16_confidence", with_sql("confident", "SELECT video_id, frame_idx, level, conf_score FROM confident"))
def _(spark, sf):
    return with_confidence(fx.scores(spark, sf)).selectExpr(*KEYS, "level", "conf_score")


@query("c17_reason_codes", with_sql("metrics_fx signals", """SELECT video_id, frame_idx, concat_ws('|', CASE WHEN feature_running THEN 'running' END,
  CASE WHEN circle_count >= 2 THEN 'round_buttons:' || circle_count END, CASE WHEN bar_flag THEN 'bar' END) AS codes
  FROM metrics_fx JOIN signals USING (video_id, frame_idx)"""))
def _(spark, sf):
    df = S.with_signals(text_frames(spark, sf), "feature_running")
    terms = [V.Term("sig_feature_running", 0, "running"), V.Term("circle_count >= 2", 0, V.counted("round_buttons", "circle_count")), V.Term("bar_flag", 0, "bar")]
    return df.selectExpr(*KEYS, f"array_join({V.reasons(terms)}, '|') AS codes")


@query("c18_reason_count", with_sql("metrics_fx", """SELECT video_id, frame_idx, CASE WHEN component_count >= 3 THEN component_count WHEN circle_count = 1 THEN 1 ELSE 0 END::INTEGER AS n
  FROM metrics_fx"""))
def _(spark, sf):
    codes = """array_compact(array('other:9', CASE WHEN component_count >= 3 THEN concat('icon_components:', component_count)
      WHEN circle_count = 1 THEN 'icon_components' END)) AS codes"""
    return fx.scores(spark, sf).selectExpr(*KEYS, codes).selectExpr(*KEYS, f"{S.reason_count('codes', 'icon_components')} AS n")


@query("c19_map_top_n", with_sql("frames_fx", """SELECT video_id, frame_idx, rnk, name, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY score DESC, pos) AS INTEGER) AS rnk
  FROM (SELECT video_id, frame_idx, p.pos, p.name, CASE WHEN p.name = category THEN top_score WHEN p.name = 'Result' AND category <> 'Result' THEN noise_score ELSE 0.0 END::DOUBLE AS score
   FROM frames_fx JOIN (VALUES """ + ",".join(f"({i},{q(c)})" for i, c in enumerate(K.REVIEW_ORDER)) + """) p(pos, name) ON TRUE)) WHERE rnk <= 3"""))
def _(spark, sf):
    m = "map_concat(map(category, top_score), map(CASE WHEN category = 'Result' THEN 'none' ELSE 'Result' END, noise_score)) AS m"
    top = fx.scores(spark, sf).selectExpr(*KEYS, m).selectExpr(*KEYS, f"posexplode({K.map_top_n('m')}) AS (p, t)")
    return top.selectExpr(*KEYS, "p + 1 AS rnk", "t.category AS name", "abs(t.score) AS score")


# --- V: metric scores -------------------------------------------------------------------------------
def _term_query(name, terms, sql_score, deps, sig_names=()):
    @query(name, with_sql(deps, f"SELECT video_id, frame_idx, round({sql_score},6)::DOUBLE AS score FROM {deps.split()[0]}"))
    def _(spark, sf):
        df = text_frames(spark, sf)
        if sig_names:
            df = S.with_signals(df, *sig_names)
        return df.selectExpr(*KEYS, r6(V.total(terms()), "score"))


_term_query("v1_basegame_ui", V.basegame_ui_terms, "ui_base", "measured")
_term_query("v2_feature_ui", V.feature_ui_terms, "ui_feature", "measured", ("feature_running",))
_term_query("v3_reel_board", V.reel_board_terms, "board", "measured")


@query("v4_clear_score", with_sql("frames_fx", """SELECT video_id, frame_idx, blur_score AS sharpness, round(least(3.0, blur_score/900),6) AS clear_score FROM frames_fx"""))
def _(spark, sf):
    return fx.scores(spark, sf).selectExpr(*KEYS, "blur_score AS sharpness", r6(V.clear_score(900.0, 3.0), "clear_score"))


_PLAIN, _JUDGED = "(edge_ratio <= 0.045 OR lap_var <= 260)", "(edge_ratio <= 0.045 OR lap_var <= 260 OR (flare_ratio >= 0.68 AND largest_ratio >= 0.42))"
_term_query("v5_overexposure", V.overexposure_terms, whens(
    (f"{_JUDGED} AND bright_ratio >= 0.5", 0.9), (f"{_JUDGED} AND very_bright_ratio >= 0.26", 0.8), (f"{_JUDGED} AND neon_ratio >= 0.4", 1.2),
    (f"{_JUDGED} AND flare_ratio >= 0.56", 0.8), (f"{_JUDGED} AND largest_ratio >= 0.32", 1.3),
    (f"{_PLAIN} AND (flare_ratio >= 0.56 OR largest_ratio >= 0.32)", 1.5)), "metrics_fx")
_NOISE = whens(("yellow_green_ratio >= 0.24", 1.0), ("saturated_ratio >= 0.42", 0.8), ("bright_ratio >= 0.28", 0.6), ("mixed_ratio >= 0.38", 0.8),
               ("largest_ratio >= 0.18", 0.6), ("edge_ratio >= 0.085", 0.9), ("lap_var >= 950", 0.5), ("contrast >= 58", 0.4))


@query("v6_transition_noise", with_sql("metrics_fx", f"""SELECT video_id, frame_idx, round(n + CASE WHEN n >= 2.4 AND edge_ratio >= 0.07 AND mixed_ratio >= 0.3 THEN 0.7 ELSE 0 END,6)::DOUBLE AS score
  FROM (SELECT *, {_NOISE} AS n FROM metrics_fx)"""))
def _(spark, sf):
    return fx.scores(spark, sf).selectExpr(*KEYS, r6(V.noise_score(), "score"))


_term_query("v7_board_obstruction", V.obstruction_terms, whens(("largest_ratio >= 0.08", "least(4.0, largest_ratio*28)"),
            ("central_ratio >= 0.16", "least(3.0, central_ratio*12)"), ("wide_components >= 1", 2.0)), "metrics_fx")


def _flag_query(name, expr, sql, deps, sig_names=()):
    @query(name, with_sql(deps, f"SELECT video_id, frame_idx, {sql} AS hit FROM {deps.split()[0]}"))
    def _(spark, sf):
        df = text_frames(spark, sf)
        if sig_names:
            df = S.with_signals(df, *sig_names)
        return df.selectExpr(*KEYS, f"{expr()} AS hit")


_flag_query("v8_brand_splash", V.brand_splash, "brand_splash", "measured")
_flag_query("v9_center_payout_visual", V.payout_visual, "payout_visual", "measured")
_flag_query("v10_loading_splash", V.loading_splash, "splash", "measured", ("loading_cover",))
_flag_query("v11_help_scroll_shell", V.help_scroll_shell, "panel_dark_ratio >= 0.62 AND bottom_dark_ratio >= 0.48 AND button_ratio >= 0.015", "metrics_fx")
QUALITY_SQL = whens(
    ("dark_plain_ratio >= 0.42", 4), ("dark_plain_ratio < 0.42 AND dark_ratio >= 0.48", 2), ("n_q >= 12", "least(4.0, n_q/5.0)"), ("n_q BETWEEN 7 AND 11", 1.2),
    ("n_q_long >= 4", "least(3.0, n_q_long*0.45)"), ("n_q_rules >= 4", "least(3.0, n_q_rules*0.4)"), ("n_q_num >= 4", 0.8), ("paytable_signal >= 3", 7),
    ("paytable_signal >= 2 AND paytable_signal < 3", 4.5), ("paytable_signal > 0 AND paytable_signal < 2", 2),
    ("saturated_ratio >= 0.34 AND n_q < 10 AND paytable_signal < 2", -4),
    ("NOT (saturated_ratio >= 0.34 AND n_q < 10) AND saturated_ratio >= 0.46 AND paytable_signal < 2", -2), ("bright_ratio >= 0.24 AND dark_plain_ratio < 0.36", -1.5))


@query("v12_help_page_quality", with_sql("measured", f"SELECT video_id, frame_idx, round({QUALITY_SQL},2)::DOUBLE AS score FROM measured"))
def _(spark, sf):
    df = text_frames(spark, sf).selectExpr("*", f"{V.paytable_signal()} AS paytable")
    return df.selectExpr(*KEYS, f"round({V.total(V.help_quality_terms('paytable'))}, 2) AS score")


VISUAL_SQL = whens(("dark_plain_ratio >= 0.30 OR dark_ratio >= 0.42", 1), ("component_count >= 6", 3), ("component_count BETWEEN 3 AND 5", 1.5), ("yellow_ratio >= 0.012", 0.8),
                   ("paragraph_rows >= 90 AND yellow_ratio < 0.02 AND component_count < 3", -2))
_term_query("v13_paytable_visual", lambda: V.paytable_visual_terms("roi_h"), VISUAL_SQL, "metrics_fx")


def _icon_query(name, expr, sql):
    @query(name, with_sql("icons_fx", f"SELECT video_id, frame_idx, {sql}::DOUBLE AS score FROM icons_fx"))
    def _(spark, sf):
        return fx.icons(spark, sf).selectExpr(*KEYS, r6(expr(), "score"))


ICON_QUALITY_SQL = """round(greatest(0.0, least(1.0, least(1.0, least(icon_w,icon_h)/88.0)*0.24 + greatest(0.0, 1.0 - edge_touches*0.24)*0.34 + least(1.0, sharpness/520.0)*0.18
  + (least(1.0, content_ratio/0.34)*0.55 + least(1.0, bbox_fill/0.45)*0.45)*0.24 - greatest(0.0, least(0.22, (components-3)*0.055)))),4)"""
_icon_query("v14_icon_quality", V.icon_quality, ICON_QUALITY_SQL)
_icon_query("v15_icon_completeness", V.icon_completeness,
            "round(least(icon_w*icon_h/9000.0,1.4) + content_ratio + least((x_margin+y_margin)/18.0,1.0) - edge_density*1.8,6)")
_icon_query("v16_box_art_score", V.box_art_score,
            "round(colourful_ratio*2.25 + greatest(0.0, 1.0 - abs(icon_w::DOUBLE/greatest(icon_h,1) - 1.0)/2.2)*0.28 + least(1.0, greatest(icon_w,icon_h)/96.0)*0.24"
            " + least(0.55, icon_w*icon_h/18000.0) - (white_ratio*0.55 + yellow_text_ratio*0.45),6)")

_PARTS = "(frame_idx*3 + line_no*17) % 350 AS area, (frame_idx*7 + line_no) % 35 AS pw, (frame_idx*5 + line_no) % 40 AS ph, CAST((frame_idx % 40) AS DOUBLE)/100 AS density"


@query("v17_payout_stack_score", with_sql("ocr_fx", f"""SELECT video_id, frame_idx, round(CASE WHEN sum(n) >= 2 THEN max(n) + max(density)*20.0 ELSE 0 END,6)::DOUBLE AS score FROM (
  SELECT video_id, frame_idx, floor(x1/16) AS b, count(*) FILTER (x1 >= 208 AND area BETWEEN 4 AND 300 AND pw BETWEEN 2 AND 30 AND ph BETWEEN 4 AND 36) AS n, max(density) AS density
  FROM (SELECT *, {_PARTS} FROM ocr_fx) GROUP BY 1,2,3) GROUP BY 1,2"""))
def _(spark, sf):
    from ..operators.icons import payout_stack_score
    parts = fx.ocr_lines(spark, sf).selectExpr(
        *KEYS, "x1 AS x", "(frame_idx * 7 + line_no) % 35 AS w", "(frame_idx * 5 + line_no) % 40 AS h", "(frame_idx * 3 + line_no * 17) % 350 AS area",
        "400 AS icon_w", "900 AS icon_h", "CAST(frame_idx % 40 AS DOUBLE) / 100 AS density")
    return payout_stack_score(parts, KEYS).selectExpr(*KEYS, r6("score", "score"))


_MW, _MH = "(x2-x1)", "(y2-y1)"
_MSCORE = (f"{_MW}*{_MH}*greatest(0.25, 1.0 - least(0.75, abs(x1+{_MW}/2.0-200)/400.0)) * CASE WHEN {_MW}/400.0 BETWEEN 0.18 AND 0.50 AND {_MH}/900.0 >= 0.45 AND {_MW}/{_MH} <= 1.05 THEN 3.0 "
           f"WHEN {_MW}/400.0 BETWEEN 0.42 AND 0.72 AND {_MH}/900.0 <= 0.70 AND {_MW}/{_MH} >= 1.10 THEN 2.2 "
           f"WHEN {_MW}/400.0 >= 0.72 AND {_MH}/900.0 >= 0.55 AND y1+{_MH}/2.0 >= 315 THEN 0.18 ELSE 1.0 END")


@query("v18_motion_region_score", with_sql("ocr_fx", f"""SELECT video_id, frame_idx, line_no, round(s,6)::DOUBLE AS score FROM (SELECT *, {_MSCORE} AS s FROM ocr_fx)
  QUALIFY row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY s DESC, line_no) = 1"""))
def _(spark, sf):
    score = V.motion_region_score("x1", "y1", "(x2 - x1)", "(y2 - y1)", 400.0, 900.0)
    best = fx.ocr_lines(spark, sf).selectExpr(*KEYS, "line_no", f"{score} AS s").groupBy(*KEYS).agg(
        F.expr("max_by(named_struct('line_no', line_no, 's', s), named_struct('s', s, 'first', -line_no)) AS b"))
    return best.selectExpr(*KEYS, "b.line_no", r6("b.s", "score"))