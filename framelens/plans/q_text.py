"""Queries for text normal forms, tokens, text sampling filters and signals."""

from __future__ import annotations

from ..functions import signals as S
from ..functions import text as T
from ..functions.rules import RULES_PAGE_TERMS
from . import fixtures as fx
from .registry import query
from .sqlkit import any_sql, norm_sql, pat_sql, plain_sql, q, terms_sql, with_sql


KEYS = ["video_id", "frame_idx"]


def docs(spark, sf):
    return fx.spread(fx.table(spark, sf, "documents").select("doc_id", "text"))


@query("t1_normalize_text", f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents")
def _(spark, sf):
    return docs(spark, sf).selectExpr("doc_id", f"{T.normalize_text('text')} AS norm")


@query("t2_normalize_plain", f"SELECT doc_id, {plain_sql('text')} AS norm FROM documents")
def _(spark, sf):
    return docs(spark, sf).selectExpr("doc_id", f"{T.normalize_plain('text')} AS norm")


@query("t3_normalize_paytable", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text),
  '[^a-z0-9.$/%+\-\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM documents""")
def _(spark, sf):
    return docs(spark, sf).selectExpr("doc_id", f"{T.normalize_paytable('text')} AS norm")


@query("t4_load_corrections")
def _(spark, sf):
    """Corrections from a rule file replace the built-in table; a missing file keeps it."""
    from ..functions.rules import DEFAULT_PACK
    pack = DEFAULT_PACK.with_files(spark, corrections_path=f"{sf}/word_corrections.json")
    return docs(spark, sf).selectExpr("doc_id", f"{T.normalize_plain('text')} <> {T.normalize_text('text', pack)} AS corrected")


_NATURAL = ["lettre", "the other", "sch er", "elle ment", "wild symbol"]


@query("t5_has_any", f"SELECT doc_id, {any_sql('n', _NATURAL)} AS hit FROM (SELECT doc_id, {norm_sql('text')} AS n FROM documents)")
def _(spark, sf):
    d = docs(spark, sf).selectExpr("doc_id", f"{T.squeeze(T.normalize_text('text'))} AS n")
    return d.selectExpr("doc_id", f"{T.any_of('n', _NATURAL)} AS hit")


_DOC_PATTERNS = [r"\b\d{4}\b", r"en\s+der", r"\bth\w*ing\b"]


@query("t6_has_any_pattern", "SELECT doc_id, " + " OR ".join(f"regexp_matches(n,{q(p)})" for p in _DOC_PATTERNS)
       + f" AS hit FROM (SELECT doc_id, {plain_sql('text')} AS n FROM documents)")
def _(spark, sf):
    d = docs(spark, sf).selectExpr("doc_id", f"{T.normalize_plain('text')} AS n")
    return d.selectExpr("doc_id", f"{T.has_any_pattern('n', _DOC_PATTERNS)} AS hit")


@query("t7_joined_text", with_sql("text_fx", "SELECT video_id, frame_idx, joined FROM text_fx"))
def _(spark, sf):
    return fx.frames(spark, sf).selectExpr(*KEYS, f"{T.joined_text('items')} AS joined")


@query("t8_box_bounds", with_sql("ocr_fx", """SELECT video_id, frame_idx, line_no, least(x1,x2) AS bx1,
  least(y1,y2) AS by1, greatest(x1,x2) AS bx2, greatest(y1,y2) AS by2 FROM ocr_fx"""))
def _(spark, sf):
    corner = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
    points = f"array({corner('x1', 'y1')}, {corner('x2', 'y1')}, {corner('x2', 'y2')}, {corner('x1', 'y2')})"
    b = fx.ocr_lines(spark, sf).selectExpr(*KEYS, "line_no", f"{T.box_bounds(points)} AS b")
    return b.selectExpr(*KEYS, "line_no", *[f"b.{c} AS b{c}" for c in ("x1", "y1", "x2", "y2")])


@query("t9_token_set", f"""WITH w AS (SELECT DISTINCT doc_id, tok FROM (SELECT doc_id, unnest(string_split({norm_sql('text')},' ')) AS tok,
  len({norm_sql('text')}) AS n FROM documents) WHERE n >= 3 AND len(tok) >= 3 AND NOT regexp_full_match(tok,'[0-9]+'))
  SELECT d.doc_id, count(tok) AS n_tokens, coalesce(string_agg(tok,' ' ORDER BY tok),'') AS tokens
  FROM documents d LEFT JOIN w USING (doc_id) GROUP BY 1""")
def _(spark, sf):
    d = docs(spark, sf).selectExpr("doc_id", f"{T.token_set('array(text)')} AS t")
    return d.selectExpr("doc_id", "CAST(size(t) AS BIGINT) AS n_tokens", "array_join(array_sort(t), ' ') AS tokens")


@query("t10_text_stats", f"""WITH l AS (SELECT doc_id, {norm_sql('line')} AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
  k AS (SELECT * FROM l WHERE len(n) >= 2), t AS (SELECT doc_id, count(DISTINCT tok) AS token_count FROM
   (SELECT doc_id, unnest(string_split(n,' ')) AS tok FROM k) GROUP BY 1)
  SELECT d.doc_id, count(k.n) AS line_count, coalesce(any_value(t.token_count),0) AS token_count,
   count(*) FILTER (len(k.n) >= 18) AS long_line_count
  FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id) GROUP BY 1""")
def _(spark, sf):
    d = docs(spark, sf).selectExpr("doc_id", f"{T.text_stats('split(text, chr(10))')} AS s")
    return d.selectExpr("doc_id", *[f"CAST(s.{c} AS BIGINT) AS {c}" for c in ("line_count", "token_count", "long_line_count")])


@query("t12_row_ocr_items", with_sql("ocr_fx", """SELECT video_id, frame_idx, line_no, trim(text) AS text,
  CASE WHEN frame_idx % 9 = 0 THEN 0.0 ELSE ocr_score END::DOUBLE AS score FROM ocr_fx WHERE NOT (frame_idx % 7 = 0 AND line_no = 2)"""))
def _(spark, sf):
    """Text/score pairs from stored text: empty texts dropped, unreadable scores read as 0."""
    from ..sources.results import row_items
    stored = fx.ocr_lines(spark, sf).selectExpr(*KEYS, "line_no", """format_string("[('%s', '%s')]",
      CASE WHEN frame_idx % 7 = 0 AND line_no = 2 THEN ' ' ELSE concat(' ', text) END,
      CASE WHEN frame_idx % 9 = 0 THEN 'n/a' ELSE CAST(ocr_score AS STRING) END) AS raw_texts""")
    return stored.selectExpr(*KEYS, "line_no", f"inline({row_items('raw_texts')})")


@query("t13_count_digits", """SELECT doc_id, CAST(len(regexp_replace(text,'[^0-9]','','g')) AS BIGINT) AS n_digits,
  regexp_matches(text,'[0-9]') AS has_digit FROM documents""")
def _(spark, sf):
    return docs(spark, sf).selectExpr("doc_id", f"CAST({T.count_digits('text')} AS BIGINT) AS n_digits", "text RLIKE '[0-9]' AS has_digit")


# --- filters over text items -----------------------------------------------------------
@query("f5_roi_clamp", with_sql("ocr_fx", """SELECT video_id, frame_idx, line_no,
  greatest(0, least(x1-50, 399)) AS x, greatest(0, least(y1-50, 899)) AS y,
  greatest(1, least(x2, 400 - greatest(0, least(x1-50, 399)))) AS w,
  greatest(1, least(y2, 900 - greatest(0, least(y1-50, 899)))) AS h FROM ocr_fx"""))
def _(spark, sf):
    from ..operators.sampling import clamp_roi
    return fx.ocr_lines(spark, sf).selectExpr(*KEYS, "line_no", *clamp_roi("x1 - 50", "y1 - 50", "x2", "y2", "400.0D", "900.0D"))


@query("f11_score_threshold", with_sql("ocr_fx", """SELECT video_id, frame_idx, count(*) FILTER (ocr_score >= 0.6) AS n_kept,
  coalesce(round(sum(ocr_score) FILTER (ocr_score >= 0.6), 6), 0.0) AS score_sum FROM ocr_fx GROUP BY 1, 2"""))
def _(spark, sf):
    d = fx.frames(spark, sf).selectExpr(*KEYS, f"{T.keep_scored('items')} AS k")
    return d.selectExpr(*KEYS, "CAST(size(k) AS BIGINT) AS n_kept", "round(aggregate(k, 0.0D, (a, i) -> a + i.score), 6) AS score_sum")


@query("f12_flatten_items", with_sql("ocr_fx", "SELECT video_id, frame_idx, trim(text) AS text, round(ocr_score, 6) AS score FROM ocr_fx WHERE NOT (frame_idx % 5 = 0 AND line_no = 3)"))
def _(spark, sf):
    """Items wrapped in an extra list level, with a malformed score every fifth frame."""
    raw = fx.frames(spark, sf).selectExpr(*KEYS, """array(transform(items, i -> named_struct(
      'box', array(named_struct('x', i.x1, 'y', i.y1), named_struct('x', i.x2, 'y', i.y2)), 'text', concat('  ', i.text, ' '),
      'score', CASE WHEN frame_idx % 5 = 0 AND i.line_no = 3 THEN 'broken' ELSE CAST(i.score AS STRING) END))) AS nested""")
    return raw.selectExpr(*KEYS, f"inline({T.flatten_items('nested')})").selectExpr(*KEYS, "text", "round(score, 6) AS score")


@query("f13_rescale_boxes", with_sql("ocr_fx", """SELECT video_id, frame_idx, line_no, round(x1*1.6,6) AS x1, round(y1*1.6,6) AS y1,
  round(x2*1.6,6) AS x2, round(y2*1.6,6) AS y2 FROM ocr_fx"""))
def _(spark, sf):
    d = fx.frames(spark, sf).selectExpr(*KEYS, f"inline({T.rescale_boxes('items', 1.6)})")
    return d.selectExpr(*KEYS, "line_no", *[f"round({c}, 6) AS {c}" for c in ("x1", "y1", "x2", "y2")])


# --- signals --------------------------------------------------------------------------------
_SIGNAL_QUERIES = {
    "g1_large_lower_start_button": "start_button", "g2_large_result_layout": "large_result",
    "g3_collect_button": "collect_button", "g4_blocking_modal": "blocking_modal",
    "g5_loading_strong": "loading_strong", "g6_loading_cover_text": "loading_cover",
    "g7_transition_cover_text": "transition_cover", "g8_feature_running": "feature_running",
    "g9_feature_intro": "feature_intro", "g10_feature_buy_modal": "feature_buy", "g11_help_page": "help_page",
    "g14_transition_strong": "transition_strong", "g15_result_strong": "result_strong",
    "g16_inline_win_banner": "inline_banner", "g17_large_center_payout_text": "center_payout",
    "g18_bigwin_strong": "bigwin_strong", "g19_bigwin_title": "bigwin_title", "g20_jackpot_meter": "jackpot_meter",
    "g21_record_free_spins_left": "record_spins_left", "g22_record_feature_text": "record_feature_text",
    "g23_record_strong_counter": "record_strong_counter", "g25_record_start_intro": "record_start_intro",
    "g26_record_result_text": "record_result_text", "g27_record_base_text": "record_base_text",
    "g28_record_web_help_chrome": "record_web_chrome",
}


def _register_signal(name: str, sig: str) -> None:
    @query(name, with_sql("signals", f"SELECT video_id, frame_idx, {sig} AS hit FROM signals"))
    def _(spark, sf):
        df = S.with_signals(T.with_text(fx.frames(spark, sf)), sig)
        return df.selectExpr(*KEYS, f"sig_{sig} AS hit")


for _name, _sig in _SIGNAL_QUERIES.items():
    _register_signal(_name, _sig)


RULES_PAGE_SQL = (f"n_page >= 8 AND ({any_sql('page_text', 'help')} OR {{paytable}} >= 2.0 OR ({{quality}} >= 6 AND {terms_sql('page_text', RULES_PAGE_TERMS)} >= 2) OR "
                  f"({{quality}} >= 3 AND {{help}} >= 3 AND {terms_sql('page_text', RULES_PAGE_TERMS)} >= 2) OR ({terms_sql('page_text', RULES_PAGE_TERMS)} >= 4 "
                  "AND (n_page_16 >= 5 OR n_page_num2 >= 5)))")


@query("g12_rules_help_candidate", with_sql("signals frames_fx", f"""SELECT video_id, frame_idx,
  {RULES_PAGE_SQL.format(quality='help_quality_score', help='top_score', paytable='help_paytable_score')} AS hit,
  CAST({terms_sql('page_text', RULES_PAGE_TERMS)} AS BIGINT) AS terms FROM signals JOIN frames_fx USING (video_id, frame_idx)"""))
def _(spark, sf):
    return T.with_text(fx.frames(spark, sf)).selectExpr(
        *KEYS, f"{S.rules_page('help_quality_score', 'top_score', 'help_paytable_score')} AS hit",
        f"CAST({T.count_terms(S.PAGE_TEXT, RULES_PAGE_TERMS)} AS BIGINT) AS terms")


@query("g13_explicit_basegame_control", with_sql("signals", f"""SELECT video_id, frame_idx, {any_sql('joined', 'control')}
  OR frame_idx % 5 >= 3 OR ((frame_idx % 3 = 0 OR {pat_sql('joined', 'decimal')}) AND TRUE)
  OR (contains(joined,'plus') AND contains(joined,'minus')) AS hit FROM signals"""))
def _(spark, sf):
    reasons = """array(concat('round_buttons:', CAST(frame_idx % 5 AS STRING)), 'spin_or_counter_block:1',
      CASE WHEN frame_idx % 3 = 0 THEN 'money_or_bet_text' ELSE 'x' END) AS reasons"""
    df = T.with_text(fx.frames(spark, sf)).selectExpr("*", reasons)
    return df.selectExpr(*KEYS, f"{S.base_control('reasons')} AS hit")


@query("g24_record_counter_over_board", with_sql("signals frames_fx", """SELECT video_id, frame_idx, record_counter AND NOT record_start_intro
  AND NOT record_result_text AND obstruction_score >= 3.0 AS hit FROM signals JOIN frames_fx USING (video_id, frame_idx)"""))
def _(spark, sf):
    df = T.with_text(fx.frames(spark, sf).withColumnRenamed("obstruction_score", "feature_board_score"))
    return S.with_signals(df, "record_counter_over_board").selectExpr(*KEYS, "sig_record_counter_over_board AS hit")


@query("g29_game_rules_text", with_sql("ocr_fx", r"""SELECT video_id, frame_idx, bool_or(regexp_matches(trim(regexp_replace(regexp_replace(lower(text),
  '[^a-z0-9.$/%+\-\s]',' ','g'),'\s+',' ','g')), 'game rules|tap to|wallet balance|bet amount|auto spin|turbo spin|more settings|game history|sound on|sound off')) AS hit
  FROM ocr_fx GROUP BY 1, 2"""))
def _(spark, sf):
    df = fx.frames(spark, sf).selectExpr(*KEYS, f"array_join(transform(items, i -> {T.normalize_paytable('i.text')}), ' ') AS t")
    return df.selectExpr(*KEYS, f"{S.game_rules_text('t')} AS hit")


RULE_HELP_SQL = (f"(n_rule >= 6 AND (n_rule_tokens >= 22 OR n_rule_long >= 3) AND ({any_sql('rule_text', 'help')} OR help_paytable_score >= 1.0 "
                 "OR n_rule_long >= 4) AND help_quality_score >= 2.5)")


@query("g30_plain_rule_help", with_sql("signals frames_fx", f"SELECT video_id, frame_idx, {RULE_HELP_SQL} AS hit FROM signals JOIN frames_fx USING (video_id, frame_idx)"))
def _(spark, sf):
    return S.with_signals(T.with_text(fx.frames(spark, sf)), "plain_rule_help").selectExpr(*KEYS, "sig_plain_rule_help AS hit")


@query("g31_bigwin_tier", with_sql("signals", "SELECT video_id, frame_idx, tier FROM signals"))
def _(spark, sf):
    return T.with_text(fx.frames(spark, sf)).selectExpr(*KEYS, f"{S.bigwin_tier('record_compact')} AS tier")


@query("g32_bigwin_tier_label", with_sql("signals", """SELECT video_id, frame_idx, CASE tier WHEN 'big_win' THEN 'Big Win' WHEN 'super_win' THEN 'Super Win'
  WHEN 'mega_win' THEN 'Mega Win' WHEN 'super_mega_win' THEN 'Super Mega Win' WHEN 'jumbo_win' THEN 'Jumbo Win' WHEN 'huge_win' THEN 'Huge Win'
  WHEN 'massive_win' THEN 'Massive Win' WHEN 'epic_win' THEN 'Epic Win' ELSE 'Unlabeled BigWin' END AS tier_label FROM signals"""))
def _(spark, sf):
    df = T.with_text(fx.frames(spark, sf)).selectExpr(*KEYS, f"{S.bigwin_tier('record_compact')} AS tier")
    return df.selectExpr(*KEYS, f"{S.bigwin_tier_label('tier')} AS tier_label")


@query("g33_bigwin_tier_plain", with_sql("signals", "SELECT video_id, frame_idx, tier_plain AS tier FROM signals"))
def _(spark, sf):
    text = f"replace(array_join(transform(items, i -> {T.normalize_plain('i.text')}), ''), ' ', '') AS t"
    return fx.frames(spark, sf).selectExpr(*KEYS, text).selectExpr(*KEYS, f"{S.bigwin_tier_plain('t')} AS tier")