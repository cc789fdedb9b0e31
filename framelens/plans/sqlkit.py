"""Oracle SQL building blocks: named common table expressions over the fixtures.

The SQL works on the long form (one row per text line, ``bool_or`` per frame)
while the engine works on arrays inside the frame row, so the two sides share
the rule tables but not the evaluation.
"""

from __future__ import annotations

from ..functions.rules import (DEFAULT_PACK, GAME_RULES_TERMS, HELP_RULE_TERMS, PATTERNS, PHRASES, PLAIN_TIERS,
                               RULES_PAGE_TERMS, TIER_MEGA, TIER_SUPER, WORD_CORRECTIONS, normalise_phrase)
from . import fixtures as fx


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


CORRECTION_MAP = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in WORD_CORRECTIONS.items()) + "}"


def plain_sql(col: str) -> str:
    return f"trim(regexp_replace(lower({col}), '[^a-z0-9]+', ' ', 'g'))"


def norm_sql(col: str) -> str:
    return (f"array_to_string(list_transform(string_split({plain_sql(col)}, ' '), "
            f"lambda w: coalesce({CORRECTION_MAP}[w], w)), ' ')")


def any_sql(col: str, phrases, compact: str | None = None) -> str:
    """Both forms of the phrase test, spelled out: spaced or space-free."""
    if isinstance(phrases, str):
        phrases = PHRASES[phrases]
    glued = compact or f"replace({col}, ' ', '')"
    tests = []
    for p in phrases:
        n = normalise_phrase(p)
        tests += [f"contains({col}, {q(n)})", f"contains({glued}, {q(n.replace(' ', ''))})"]
    return "(" + " OR ".join(dict.fromkeys(tests)) + ")"


def pat_sql(col: str, key: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, {q(p)})" for p in PATTERNS[key]) + ")"


def terms_sql(col: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, {q(t)}) AS INTEGER)" for t in terms) + ")"


def substr_sql(col: str, terms) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(t)})" for t in terms) + ")"


def some(cond: str) -> str:
    return f"coalesce(bool_or({cond}) FILTER (kept), FALSE)"


def count(cond: str) -> str:
    return f"count(*) FILTER (kept AND ({cond}))"


_A = lambda key: any_sql("norm", key, "cnorm")  # noqa: E731  phrase test on one line
_BOX = "cx BETWEEN (400 * 0.18::DOUBLE) AND (400 * 0.82::DOUBLE) AND cy BETWEEN (900 * 0.16::DOUBLE) AND (900 * 0.68::DOUBLE) AND h >= (900 * 0.030::DOUBLE)"
_OVER = "cx BETWEEN (400 * 0.10::DOUBLE) AND (400 * 0.90::DOUBLE) AND cy BETWEEN (900 * 0.16::DOUBLE) AND (900 * 0.70::DOUBLE) AND (h >= (900 * 0.038::DOUBLE) OR w >= (400 * 0.16::DOUBLE))"

LINE_FLAGS = {
    "f_start": some("contains(norm,'start') AND cy >= (900 * 0.50::DOUBLE) AND cx BETWEEN (400 * 0.15::DOUBLE) AND (400 * 0.85::DOUBLE) AND (h >= 28 OR w >= 95)"),
    "f_result_label": some(f"{_A('total_win')} AND (h >= (900 * 0.045::DOUBLE) OR w >= (400 * 0.30::DOUBLE))"),
    "f_total": some(f"norm = 'total' AND {_OVER}"),
    "f_win": some(f"norm = 'win' AND {_OVER}"),
    "f_number": some("len(regexp_replace(norm,'[^0-9]','','g')) >= 3 AND h >= (900 * 0.07::DOUBLE) AND w >= (400 * 0.25::DOUBLE) AND cy BETWEEN (900 * 0.20::DOUBLE) AND (900 * 0.82::DOUBLE)"),
    "f_collect_word": some("contains(norm,'collect')"),
    "f_collect": some("norm IN ('collect','collec','colect') AND cx BETWEEN (400 * 0.20::DOUBLE) AND (400 * 0.80::DOUBLE) AND cy BETWEEN (900 * 0.48::DOUBLE) AND (900 * 0.90::DOUBLE)"
                      " AND w >= (400 * 0.14::DOUBLE) AND h >= (900 * 0.030::DOUBLE)"),
    "n_modal": count(f"{_A('modal_word')} AND cx BETWEEN (400 * 0.15::DOUBLE) AND (400 * 0.85::DOUBLE) AND cy BETWEEN (900 * 0.18::DOUBLE) AND (900 * 0.82::DOUBLE)"),
    "f_buy_large": some(f"{_A('feature_buy')} AND {_BOX} AND w >= (400 * 0.22::DOUBLE)"),
    "f_buy_word": some(f"norm = 'buy' AND {_BOX} AND w >= (400 * 0.10::DOUBLE)"),
    "f_buy_spins": some(f"{_A('buy_title')} AND {_BOX} AND w >= (400 * 0.10::DOUBLE)"),
    "f_act_cancel": some("cy >= (900 * 0.42::DOUBLE) AND contains(norm,'cancel')"),
    "f_act_start": some("cy >= (900 * 0.42::DOUBLE) AND contains(norm,'start')"),
    "f_act_buy": some("cy >= (900 * 0.42::DOUBLE) AND regexp_matches(norm,'\\bbuy\\b')"),
    "f_banner": some(f"NOT {_A('banner_block')} AND {pat_sql('norm', 'banner')} AND cy <= (900 * 0.72::DOUBLE) AND w >= (400 * 0.16::DOUBLE)"),
    "f_payout": some(f"len(regexp_replace(norm,'[^0-9]','','g')) >= 4 AND {pat_sql('text', 'payout_text')}"
                     " AND cx BETWEEN (400 * 0.12::DOUBLE) AND (400 * 0.88::DOUBLE) AND cy BETWEEN (900 * 0.16::DOUBLE) AND (900 * 0.62::DOUBLE) AND (w >= (400 * 0.22::DOUBLE) OR h >= (900 * 0.055::DOUBLE))"),
    "n_page": count("len(norm) >= 3"),
    "n_page_num": count("len(norm) >= 3 AND regexp_matches(norm,'\\b\\d+\\b')"),
    "n_page_num2": count("len(norm) >= 3 AND regexp_matches(norm,'\\b\\d+(?:[,.]\\d+)?\\b')"),
    "n_page_14": count("len(norm) >= 14"),
    "n_page_16": count("len(norm) >= 16"),
    # page tables
    "f_pt_title": some(_A("paytable_title")),
    "n_pt_items": count("regexp_full_match(norm,'\\d{1,3}')"),
    "n_pt_values": "coalesce(sum(len(regexp_extract_all(norm,'\\b\\d{1,4}(?:[,.]\\d+)?\\b'))) FILTER (kept),0)",
    "n_pt_pairs": count("norm <> '' AND regexp_matches(lower(text),'\\b\\d{1,3}\\s*-\\s*\\d{1,4}(?:[,.]\\d+)?\\b')"),
    "n_pt_full": count("regexp_matches(norm,'\\bfull\\b') AND regexp_matches(norm,'\\b\\d{1,4}(?:[,.]\\d+)?\\b')"),
    "n_pt_terms": count(_A("table_terms")),
    "f_pt_wild": some(_A("wild_scatter")),
    "f_pt_lines": some("contains(norm,'paylines') OR contains(norm,'pay lines')"),
    "n_pt_cont": count(_A("continuation")),
    # lower feature terms, vendor footer, cover titles and buttons
    "n_lower": count(f"norm <> '' AND cy >= (900 * 0.48::DOUBLE) AND h >= (900 * 0.018::DOUBLE) AND {_A('lower_terms')}"),
    "n_legal": count(f"{any_sql('norm', PHRASES['legal'] + ['fair'], 'cnorm')} AND cy >= (900 * 0.72::DOUBLE)"),
    "n_title": count(f"cy BETWEEN (900 * 0.05::DOUBLE) AND (900 * 0.55::DOUBLE) AND w >= (400 * 0.18::DOUBLE) AND h >= (900 * 0.025::DOUBLE)"
                     f" AND NOT {_A('balance_words')}"),
    "n_button": count(f"{_A('cover_button')} AND cy >= (900 * 0.48::DOUBLE) AND w >= (400 * 0.18::DOUBLE)"),
    "n_text": count("norm <> ''"),
    # page quality: lines inside the vertical margins
    "n_q": count("cy >= (900 * 0.03::DOUBLE) AND cy <= (900 * 0.97::DOUBLE) AND len(norm) >= 3"),
    "n_q_long": count("cy >= (900 * 0.03::DOUBLE) AND cy <= (900 * 0.97::DOUBLE) AND len(norm) >= 14"),
    "n_q_num": count("cy >= (900 * 0.03::DOUBLE) AND cy <= (900 * 0.97::DOUBLE) AND len(norm) >= 3 AND regexp_matches(norm,'\\b\\d+\\b')"),
    "n_q_rules": count(f"cy >= (900 * 0.03::DOUBLE) AND cy <= (900 * 0.97::DOUBLE) AND len(norm) >= 3 AND {_A('quality_terms')}"),
}

SIGNALS_A = {
    "loading_strong": any_sql("joined", "loading"),
    "transition_cover": f"({any_sql('joined', 'cover')} OR ({any_sql('joined', 'award')} AND "
                        f"{any_sql('joined', 'free_spin')} AND {pat_sql('joined', 'short_number')}) OR "
                        f"{pat_sql('compact', 'cover_compact')} OR {pat_sql('joined', 'cover')})",
    "feature_running": f"(({any_sql('joined', 'remaining')} AND {any_sql('joined', 'free_play')}) OR "
                       f"{pat_sql('joined', 'running')} OR {pat_sql('compact', 'running_compact')} OR "
                       "(contains(compact,'freespin') AND regexp_matches(compact,'remaining|last|left')))",
    "feature_intro": f"({any_sql('joined', 'feature_intro')} OR {pat_sql('joined', 'feature_intro')})",
    "action_phrase": any_sql("joined", "action"),
    "result_strong": f"({any_sql('joined', 'result')} AND NOT ({any_sql('joined', 'win_multiplier')} AND NOT "
                     f"{any_sql('joined', 'won_or_collect')}))",
    "bigwin_strong": f"({any_sql('joined', 'bigwin')} OR {pat_sql('compact', 'bigwin_compact')})",
    "bigwin_title": "(contains(compact,'sensational') OR (regexp_matches(joined,'\\bnice\\b') AND regexp_matches(joined,'[0-9]')))",
    "jackpot_meter": f"({any_sql('joined', 'jackpot')} AND len(regexp_extract_all(joined,'\\d[\\d,. ]{{2,}}')) >= 2)",
    "total_win": any_sql("joined", "total_win"),
    "start_button": "f_start",
    "large_result": "(((f_result_label OR (f_total AND f_win)) AND f_number) OR (f_collect_word AND "
                    "(f_result_label OR (f_total AND f_win) OR f_number)))",
    "collect_button": "f_collect",
    "blocking_modal": f"({any_sql('joined', 'modal')} AND n_modal >= 2)",
    "feature_buy": f"({any_sql('joined', 'feature_buy')} AND {any_sql('joined', 'purchase')} AND "
                   "(f_act_cancel::INT + f_act_start::INT + f_act_buy::INT >= 2 OR "
                   f"{pat_sql('joined', 'amount')}) AND (f_buy_large OR (f_buy_word AND f_buy_spins) OR "
                   "f_act_cancel::INT + f_act_start::INT + f_act_buy::INT >= 2))",
    "help_page": f"(NOT (contains(compact,'symbolspay') AND {any_sql('joined', 'overlay_ui')} AND NOT "
                 f"{any_sql('joined', 'overlay_help')}) AND ({any_sql('joined', 'help')} OR (n_page >= 12 AND NOT "
                 f"(contains(replace(page_text,' ',''),'symbolspay') AND {any_sql('page_text', 'overlay_ui_items')} "
                 f"AND NOT {any_sql('page_text', 'overlay_help_items')}) AND {terms_sql('page_text', HELP_RULE_TERMS)} >= 4 "
                 "AND (n_page_num >= 5 OR n_page_14 >= 5))))",
    "inline_banner": "f_banner",
    "center_payout": "f_payout",
    "record_spins_left": "(contains(record_compact,'freespinsleft') OR contains(record_compact,'freespinleft') OR ("
                         f"{any_sql('record_text', 'free_spin_any')} AND contains(record_text,'left') AND "
                         f"{pat_sql('record_text', 'short_number')}))",
    "record_feature_text": f"({pat_sql('record_text', 'feature_text')} OR {pat_sql('record_compact', 'counter_of')} OR "
                           f"{any_sql('record_text', 'feature_words')})",
    "record_strong_counter": f"({pat_sql('record_compact', 'counter_compact')} OR {pat_sql('record_text', 'counter')})",
    "record_start_intro": any_sql("record_text", "start_intro"),
    "record_result_text": f"({any_sql('record_text', 'result')} OR (contains(record_compact,'total') AND "
                          f"contains(record_compact,'win') AND {pat_sql('record_text', 'big_amount')}))",
    "record_counter": f"({any_sql('record_text', 'free_spin_any')} AND {pat_sql('record_text', 'short_number')} AND NOT "
                      f"{any_sql('record_text', 'counter_block')})",
    "record_base_text": any_sql("record_text", "base_words"),
    "record_web_chrome": f"({any_sql('record_text', 'browser')} AND {any_sql('record_text', 'browser_page')})",
    "record_award": f"({any_sql('record_text', 'award_words')} AND {any_sql('record_text', 'free_spin_any')})",
    "record_settings": any_sql("record_text", "settings_words"),
    "record_intro": f"({any_sql('record_text', 'feature_intro')} OR {pat_sql('record_text', 'feature_intro')})",
    "tier": ("CASE WHEN NOT contains(record_compact,'wi') THEN '' "
             f"WHEN {substr_sql('record_compact', TIER_SUPER)} AND {substr_sql('record_compact', TIER_MEGA)} THEN 'super_mega_win' "
             "WHEN contains(record_compact,'jumbo') THEN 'jumbo_win' "
             f"WHEN {substr_sql('record_compact', TIER_MEGA)} THEN 'mega_win' "
             f"WHEN {substr_sql('record_compact', TIER_SUPER)} THEN 'super_win' "
             f"WHEN {substr_sql('record_compact', ['bigwin', 'big', 'biswin', 'bis'])} THEN 'big_win' "
             "WHEN contains(record_compact,'huge') THEN 'huge_win' WHEN contains(record_compact,'massive') THEN 'massive_win' "
             "WHEN contains(record_compact,'epic') THEN 'epic_win' ELSE '' END"),
    "tier_plain": "CASE " + " ".join(f"WHEN contains(plain_compact,{q(p.replace(' ', ''))}) THEN {q(l)}"
                                     for p, l in PLAIN_TIERS) + " ELSE 'BigWin' END",
}

SIGNALS_B = {
    "loading_cover": f"({any_sql('joined', 'vendor')} AND NOT (NOT (loading_strong OR {any_sql('joined', 'download')}) AND ("
                     f"{any_sql('joined', 'gameplay')} OR {pat_sql('joined', 'win_number')} OR ("
                     f"{any_sql('joined', ['multiplier'])} AND {pat_sql('joined', 'times_number')}) OR transition_cover)) AND "
                     f"(loading_strong OR {any_sql('joined', 'download')} OR {any_sql('joined', 'marketing')}) AND NOT "
                     f"{any_sql('joined', 'cover_rules')})",
    "transition_strong": "(action_phrase OR (feature_intro AND NOT feature_running) OR start_button)",
    "paytable_signal": """CASE
      WHEN f_pt_title AND (n_pt_full >= 3 OR n_pt_pairs >= 4) THEN 3.0
      WHEN f_pt_title AND ((n_pt_values >= 8 AND n_pt_terms >= 1) OR n_pt_values >= 12) THEN 2.5
      WHEN f_pt_title AND n_pt_items >= 20 AND n_pt_terms >= 3 THEN 3.0
      WHEN f_pt_title AND n_pt_items >= 10 AND n_pt_terms >= 10 THEN 2.5
      WHEN f_pt_title AND n_pt_items >= 8 AND (n_pt_terms >= 2 OR n_pt_cont >= 2) THEN 2.0
      WHEN f_pt_title AND n_pt_cont >= 3 THEN 1.5
      WHEN f_pt_lines AND n_pt_pairs >= 4 AND f_pt_wild THEN 2.0
      WHEN n_pt_pairs >= 6 AND (f_pt_wild OR n_pt_terms >= 1) THEN 2.0
      ELSE 0.0 END::DOUBLE""",
}

_LINES = f"""SELECT o.*, p.norm, replace(p.norm,' ','') AS cnorm, p.plain, o.ocr_score >= 0.6 AS kept,
  greatest(0.0, x2 - x1)::DOUBLE AS w, greatest(0.0, y2 - y1)::DOUBLE AS h, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy
  FROM ocr_fx o JOIN (SELECT text, {norm_sql('text')} AS norm, {plain_sql('text')} AS plain
  FROM (SELECT DISTINCT text FROM ocr_fx)) p USING (text)"""

_TEXT = ("SELECT video_id, frame_idx, coalesce(string_agg(norm,' ' ORDER BY line_no) FILTER (kept),'') AS joined,"
         " coalesce(string_agg(norm,' ' ORDER BY line_no) FILTER (kept AND len(norm)>=3),'') AS page_text,"
         " string_agg(norm,' ' ORDER BY line_no) AS record_text,"
         " replace(string_agg(plain,' ' ORDER BY line_no),' ','') AS plain_compact,"
         " coalesce(string_agg(norm,' ' ORDER BY line_no) FILTER (len(norm)>=2),'') AS rule_text,"
         " count(*) FILTER (len(norm)>=2) AS n_rule, count(*) FILTER (len(norm)>=18) AS n_rule_long, "
         + ", ".join(f"{e} AS {n}" for n, e in LINE_FLAGS.items()) + " FROM lines GROUP BY 1, 2")

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "frames_fx": ((), fx.FRAMES_SQL),
    "metrics_fx": ((), fx.METRICS_SQL),
    "icons_fx": ((), fx.ICONS_SQL),
    "ocr_fx": ((), fx.OCR_SQL),
    "lines": (("ocr_fx",), _LINES),
    "text_raw": (("lines",), _TEXT),
    "text_fx": (("text_raw",), "SELECT *, replace(joined,' ','') AS compact, replace(record_text,' ','') AS record_compact,"
                " len(list_distinct(list_filter(string_split(rule_text,' '), lambda t: t <> ''))) AS n_rule_tokens FROM text_raw"),
    "signals_a": (("text_fx",), "SELECT *, " + ",\n".join(f"{e} AS {n}" for n, e in SIGNALS_A.items()) + " FROM text_fx"),
    "signals": (("signals_a",), "SELECT *, " + ",\n".join(f"{e} AS {n}" for n, e in SIGNALS_B.items()) + " FROM signals_a"),
}


def with_sql(names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind the named fixture expressions and those they rest on."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order]
    parts += [f"{n} AS ({s})" for n, s in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


def cte(name: str, deps: str, sql: str) -> None:
    CTES[name] = (tuple(deps.split()), sql)


def greedy_sql(nodes: str, pairs: str) -> str:
    """The greedy walk spelled out: of ``nodes(part, n)``, n from 1, those without a kept earlier conflict in ``pairs(part, a, b)``, one row of every part a step."""
    return f"""SELECT * FROM (WITH RECURSIVE node_ AS MATERIALIZED ({nodes}), conf_ AS MATERIALIZED (SELECT part, b AS n, list(a) AS before FROM ({pairs}) GROUP BY 1, 2),
  seq_ AS MATERIALIZED (SELECT part, n, coalesce(before, []) AS before FROM node_ LEFT JOIN conf_ USING (part, n)),
  walk_(part, n, ids) AS (SELECT DISTINCT part, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM node_ UNION ALL
    SELECT s.part, s.n, CASE WHEN list_has_any(w.ids, s.before) THEN w.ids ELSE list_append(w.ids, s.n) END FROM walk_ w JOIN seq_ s ON s.part = w.part AND s.n = w.n + 1)
  SELECT part, unnest(ids) AS n, generate_subscripts(ids, 1) AS keep_rank FROM (SELECT part, arg_max(ids, n) AS ids FROM walk_ GROUP BY part))"""
