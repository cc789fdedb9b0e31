"""Queries for sampling, lists, ranking, keep rules and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as V
from ..functions import signals as S
from ..functions import text as T
from ..functions import vectors as X
from ..functions.rules import BIGWIN_TIERS, TOP_K
from ..operators import classify as K
from ..operators import clustering as CL
from ..operators import greedy as G
from ..operators import sampling as SA
from ..operators import select as SE
from ..operators import windows as W
from ..sources import listing as L
from . import fixtures as fx
from .q_classify import KEYS, r6, whens, with_confidence
from .q_text import RULE_HELP_SQL, docs
from .registry import query
from .sqlkit import cte, greedy_sql, norm_sql, with_sql

GAP = 40  # gap limit of the fixture frames


def records(spark, sf, *signals, parallel=True):
    df = fx.frames(spark, sf).selectExpr("*", "diff_score AS transition_keep_score", "obstruction_score AS feature_board_score",
                                         f"{V.total(V.overexposure_terms())} AS exposure_score")
    return S.with_signals(T.with_text(df), *signals) if signals else T.with_text(df)


_EXPOSE = whens(("j AND bright_ratio >= 0.5", 0.9), ("j AND very_bright_ratio >= 0.26", 0.8), ("j AND neon_ratio >= 0.4", 1.2), ("j AND flare_ratio >= 0.56", 0.8),
                ("j AND largest_ratio >= 0.32", 1.3), ("p AND (flare_ratio >= 0.56 OR largest_ratio >= 0.32)", 1.5))
cte("exposed", "metrics_fx", f"""SELECT video_id, frame_idx, round({_EXPOSE},6)::DOUBLE AS exposure_score FROM (SELECT *, (edge_ratio <= 0.045 OR lap_var <= 260) AS p,
  (edge_ratio <= 0.045 OR lap_var <= 260 OR (flare_ratio >= 0.68 AND largest_ratio >= 0.42)) AS j FROM metrics_fx)""")
cte("records", "frames_fx signals exposed", "SELECT f.*, s.* EXCLUDE (video_id, frame_idx), e.exposure_score, diff_score AS transition_keep_score "
    "FROM frames_fx f JOIN signals s USING (video_id, frame_idx) JOIN exposed e USING (video_id, frame_idx)")

# --- F: sampling and filters -----------------------------------------------------------------


@query("f1_stride_sample", with_sql("frames_fx", "SELECT video_id, frame_idx FROM frames_fx WHERE frame_idx % 10 = 0"))
def _(spark, sf):
    return fx.scores(spark, sf).where("frame_idx % 10 = 0").select(*KEYS)


cte("dense", "frames_fx", """SELECT *, max(CASE category WHEN 'Help' THEN frame_idx + 26 WHEN 'Transition' THEN frame_idx + 9 WHEN 'Feature game' THEN frame_idx + 18 END)
  OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dense_until FROM frames_fx""")


@query("f2_dense_window_sample", with_sql("dense", """SELECT video_id, frame_idx, dense_until FROM dense
  WHERE frame_idx % 10 = 0 OR (frame_idx <= dense_until AND frame_idx % 5 = 0)"""))
def _(spark, sf):
    d = fx.scores(spark, sf).select(*KEYS, "category")
    return SA.dense_window_sample(d, 10, 5, {"Help": 26, "Transition": 9, "Feature game": 18}).select(*KEYS, "dense_until")


@query("f4_mean_abs_diff", """SELECT a.vec_id, round(list_avg(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))),6) AS mad
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(spark, sf):
    e = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.selectExpr("vec_id - 1 AS vec_id", "embedding AS other")
    return e.join(nxt, "vec_id").selectExpr("vec_id", r6(X.mean_abs_diff("embedding", "other"), "mad"))


@query("f7_blur_filter", with_sql("frames_fx", "SELECT video_id, frame_idx FROM frames_fx WHERE blur_score >= 45"))
def _(spark, sf):
    return fx.scores(spark, sf).where("blur_score >= 45.0D").select(*KEYS)


@query("f8_exposure_filter", with_sql("exposed dense", """SELECT video_id, frame_idx, exposure_score FROM exposed JOIN dense USING (video_id, frame_idx)
  WHERE exposure_score < 4.0 + CASE WHEN coalesce(frame_idx <= dense_until, FALSE) THEN 2.0 ELSE 0 END"""))
def _(spark, sf):
    d = fx.scores(spark, sf).selectExpr(*KEYS, "category", r6(V.total(V.overexposure_terms()), "exposure_score"))
    opens = "CASE category WHEN 'Help' THEN frame_idx + 26 WHEN 'Transition' THEN frame_idx + 9 WHEN 'Feature game' THEN frame_idx + 18 END"
    d = W.running(d, ["video_id"], "frame_idx", opens, "max", "dense_until", inclusive=False)
    return d.where(SA.exposure_keep("exposure_score", "coalesce(frame_idx <= dense_until, false)")).select(*KEYS, "exposure_score")


@query("f9_noise_filter", with_sql("frames_fx", """SELECT video_id, frame_idx, category FROM frames_fx WHERE noise_score < 3.4 OR NOT (category = 'Other'
  OR (category = 'Feature game' AND feature_ui_score < 5.5 AND feature_active_score < 8) OR (category = 'Basegame' AND basegame_ui_score < 5.0))"""))
def _(spark, sf):
    return fx.scores(spark, sf).where(SA.noise_keep()).select(*KEYS, "category")


@query("f10_needs_review", with_sql("confident", "SELECT video_id, frame_idx, level FROM confident WHERE level <> 'high'"))
def _(spark, sf):
    return with_confidence(fx.scores(spark, sf)).where(K.needs_review("level")).select(*KEYS, "level")


@query("f14_choose_crop", with_sql("frames_fx", """SELECT video_id, frame_idx, category, r AS replaced, CASE WHEN r THEN fw ELSE 400 END::INTEGER AS w, CASE WHEN r THEN 837 ELSE 900 END::INTEGER AS h,
  CASE WHEN r THEN greatest(b_top, 12.0) ELSE top_score END::DOUBLE AS help_score FROM (SELECT *, coalesce(category = 'Help' AND fw / 900.0 >= 1.25 AND fw > 540 AND (b_cat = 'Help' OR b_q >= 8 OR b_p >= 2 OR b_q >= 2)
   AND (b_cat NOT IN ('Feature Buy','BigWin','Result','loading') OR (b_cat = 'Result' AND b_p >= 2 AND b_q >= 6) OR b_q >= 2), FALSE) AS r
  FROM (SELECT a.*, CASE WHEN a.frame_idx % 2 = 0 THEN 1000 ELSE 1600 END AS fw, b.category AS b_cat, b.help_quality_score AS b_q, b.help_paytable_score AS b_p, b.top_score AS b_top
   FROM frames_fx a LEFT JOIN frames_fx b ON b.frame_idx = a.frame_idx + 1))"""))
def _(spark, sf):
    f = fx.scores(spark, sf)
    fw = "CASE WHEN {f} % 2 = 0 THEN 1000 ELSE 1600 END"
    primary = f.selectExpr(*KEYS, "category", "roi_w AS w", "roi_h AS h", f"{fw.format(f='frame_idx')} AS frame_w", "900 AS frame_h", "top_score AS help_score")
    alternate = f.selectExpr("frame_idx - 1 AS frame_idx", "category AS alt_category", f"{fw.format(f='(frame_idx - 1)')} AS alt_w", "837 AS alt_h",
                             "help_quality_score AS alt_quality", "help_quality_score >= 8.0D AS alt_help", "help_paytable_score >= 2.0D AS alt_rules",
                             "top_score AS alt_help_score")
    return SA.choose_crop(primary, alternate, ["frame_idx"]).join(f.select(*KEYS), "frame_idx").select(
        *KEYS, "category", "replaced", "w", "h", "help_score")


@query("f14_replace_crop", with_sql("frames_fx ocr_fx", """SELECT video_id, frame_idx, category, r AS replaced, CASE WHEN r THEN fw ELSE 400 END::INTEGER AS roi_w, CASE WHEN r THEN b_top ELSE top_score END::DOUBLE AS top_score,
  CASE WHEN r THEN greatest(b_top, 12.0) ELSE top_score END::DOUBLE AS help_score, round(CASE WHEN r THEN b_ui ELSE feature_ui_score END, 6)::DOUBLE AS feature_ui, round(CASE WHEN r THEN b_q ELSE help_quality_score END, 2)::DOUBLE AS quality,
  CASE WHEN r THEN b_cat || '|web_full_page_crop_forced' ELSE category END AS hits, (SELECT count(*) FROM ocr_fx o WHERE o.frame_idx = CASE WHEN r THEN p.frame_idx + 1 ELSE p.frame_idx END) AS n_items
  FROM (SELECT *, coalesce(category = 'Help' AND fw / 900.0 >= 1.25 AND fw > 540 AND (b_cat = 'Help' OR b_q >= 8 OR b_p >= 2 OR b_q >= 2)
   AND (b_cat NOT IN ('Feature Buy','BigWin','Result','loading') OR (b_cat = 'Result' AND b_p >= 2 AND b_q >= 6) OR b_q >= 2), FALSE) AS r
  FROM (SELECT a.*, CASE WHEN a.frame_idx % 2 = 0 THEN 1000 ELSE 1600 END AS fw, b.category AS b_cat, b.help_quality_score AS b_q, b.help_paytable_score AS b_p, b.top_score AS b_top, b.feature_ui_score AS b_ui
   FROM frames_fx a LEFT JOIN frames_fx b ON b.frame_idx = a.frame_idx + 1)) p"""))
def _(spark, sf):
    """Records whose crop is replaced by the full page, here the next frame's record, with all that was measured on it."""
    shown = ["category", "roi_w", "roi_h", "top_score", "items", "feature_ui_score", "help_quality_score", "help_paytable_score",
             "map('Help', top_score, 'FeatureUI', feature_ui_score) AS category_scores", "map('Help', array(category)) AS matched_keywords"]
    f = fx.frames(spark, sf)
    fw = "CASE WHEN frame_idx % 2 = 0 THEN 1000 ELSE 1600 END"
    records = f.selectExpr(*KEYS, *shown, f"{fw} AS frame_w", "900 AS frame_h")
    pages = f.withColumn("frame_idx", F.expr("frame_idx - 1")).withColumns({"roi_w": F.expr(fw), "roi_h": F.lit(837)}).selectExpr(
        "frame_idx", *shown, "help_quality_score >= 8.0D AS help_like", "help_paytable_score >= 2.0D AS rules_like")
    return SA.replace_crop(records, pages, ["frame_idx"]).selectExpr(
        *KEYS, "category", "replaced", "roi_w", "top_score", "category_scores['Help'] AS help_score", "round(feature_ui_score, 6) AS feature_ui",
        "round(help_quality_score, 2) AS quality", "array_join(matched_keywords['Help'], '|') AS hits", "CAST(size(items) AS BIGINT) AS n_items")


# --- IO: lists ----------------------------------------------------------------------------------------
@query("io4_first_n_per_category", with_sql("frames_fx", """SELECT video_id, category, frame_idx FROM frames_fx
  QUALIFY row_number() OVER (PARTITION BY video_id, category ORDER BY lpad(frame_idx::VARCHAR, 8, '0')) <= 6"""))
def _(spark, sf):
    d = fx.scores(spark, sf).selectExpr("video_id", "category", "frame_idx", "lpad(CAST(frame_idx AS STRING), 8, '0') AS name")
    return L.first_n(d, ["video_id", "category"], "name", 6).select("video_id", "category", "frame_idx")


@query("io5_union_prefer_first", """WITH p AS (SELECT * FROM documents WHERE lang = 'en' QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 30),
  f AS (SELECT * FROM documents WHERE lang <> 'en' QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 30),
  u AS (SELECT source, n_chars, doc_id, FALSE AS from_fallback FROM p UNION ALL SELECT source, n_chars, doc_id, TRUE FROM f)
  SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY source, n_chars ORDER BY from_fallback, doc_id) = 1""")
def _(spark, sf):
    d = fx.table(spark, sf, "documents").select("source", "n_chars", "doc_id", "lang")
    return L.union_prefer_first(d.where("lang = 'en'").drop("lang"), d.where("lang <> 'en'").drop("lang"), ["source"], "n_chars", "doc_id", 30)


@query("io6_topup_from_fallback", with_sql("frames_fx", """, p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS rn FROM frames_fx WHERE category = CASE WHEN video_id % 3 = 0 THEN 'no such' ELSE 'loading' END
   QUALIFY rn <= 12), c AS (SELECT video_id, count(*) AS n FROM p GROUP BY 1),
  f AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS rn FROM frames_fx WHERE category = 'Other')
  SELECT video_id, frame_idx, category FROM p UNION ALL SELECT video_id, frame_idx, category FROM f LEFT JOIN c USING (video_id) WHERE coalesce(n,0) < 4 AND rn + coalesce(n,0) <= 12""".replace(", p AS", "SELECT * FROM (WITH p AS", 1) + ")"))
def _(spark, sf):
    # every third video has no rows of the first category
    d = fx.scores(spark, sf).select(*KEYS, "category")
    return L.topup_from_fallback(d.where("category = IF(video_id % 3 = 0, 'no such', 'loading')"), d.where("category = 'Other'"), ["video_id"], "frame_idx").select(*KEYS, "category")


@query("io7_even_sample", """WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM documents),
  w AS (SELECT DISTINCT source, CAST(round_even(i * ((n - 1) / 9.0::DOUBLE), 0) AS BIGINT) AS p FROM (SELECT DISTINCT source, n FROM d), range(10) t(i) WHERE n > 10)
  SELECT source, doc_id, p AS position FROM d WHERE n <= 10 UNION ALL SELECT d.source, doc_id, d.p FROM d JOIN w ON d.source = w.source AND d.p = w.p""")
def _(spark, sf):
    d = fx.table(spark, sf, "documents").select("source", "doc_id")
    return L.even_sample(d, ["source"], "doc_id", 10).select("source", "doc_id", "position")


@query("io7_even_sample_truncated", """WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM documents),
  w AS (SELECT DISTINCT source, CASE WHEN i = 7 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 7.0::DOUBLE)) AS BIGINT) END AS p FROM (SELECT DISTINCT source, n FROM d), range(8) t(i) WHERE n > 8)
  SELECT source, doc_id, p AS position FROM d WHERE n <= 8 UNION ALL SELECT d.source, doc_id, d.p FROM d JOIN w ON d.source = w.source AND d.p = w.p""")
def _(spark, sf):
    d = fx.table(spark, sf, "documents").select("source", "doc_id")
    return L.even_sample(d, ["source"], "doc_id", 8, truncate=True).select("source", "doc_id", "position")


@query("io8_all_help", with_sql("frames_fx", "SELECT video_id, frame_idx FROM frames_fx WHERE category = 'Help' ORDER BY video_id, frame_idx"))
def _(spark, sf):
    return fx.scores(spark, sf).where("category = 'Help'").select(*KEYS).orderBy(*KEYS)


# --- K: keep scores ---------------------------------------------------------------------------------------
_CLEAR = "least({cap}, blur_score/{div})"
BASE_KEEP = ("(basegame_ui_score*2.0 + least(3.0, blur_score/900.0) - least(3.0, noise_score*0.6) - least(8.0, obstruction_score*1.4)"
             " - CASE WHEN top_score >= 8 THEN least(4.0, (top_score-6.0)*0.35) ELSE 0 END)")
FEAT_KEEP = ("(feature_ui_score*2.0 + feature_active_score*1.6 + least(2.5, blur_score/1000.0) - least(3.0, noise_score*0.55)"
             " - CASE WHEN feature_active_score >= 8 THEN least(3.0, obstruction_score*0.45) ELSE least(8.0, obstruction_score*1.8) END + top_score*0.05"
             " + CASE WHEN record_spins_left THEN 28.0 WHEN help_quality_score >= 8 THEN -2.2*help_quality_score ELSE 0 END)")
BIG_KEEP = ("(bigwin_keep_signal*2.0 + top_score + least(3.0, blur_score/1200.0) - least(4.0, noise_score*0.45) + CASE WHEN bigwin_keep_signal >= 10 THEN 20.0 ELSE 0 END)")
HELP_KEEP = ("(help_quality_score*1.2 + help_paytable_score*2.0 + n_rule*0.8 + n_rule_tokens*0.15 + n_rule_long*1.0 + blur_score*0.01 - noise_score*0.6)")


@query("k1_basegame_keep_score", with_sql("frames_fx", f"SELECT video_id, frame_idx, round({BASE_KEEP},6) AS score FROM frames_fx"))
def _(spark, sf):
    return fx.scores(spark, sf).selectExpr(*KEYS, r6(V.basegame_keep_score(), "score"))


@query("k2_feature_keep_score", with_sql("records", f"SELECT video_id, frame_idx, round({FEAT_KEEP},6) AS score FROM records"))
def _(spark, sf):
    return records(spark, sf, "record_spins_left").selectExpr(*KEYS, r6(V.feature_keep_score(), "score"))


@query("k3_bigwin_keep_score", with_sql("frames_fx", f"SELECT video_id, frame_idx, round({BIG_KEEP},6) AS score FROM frames_fx"))
def _(spark, sf):
    return fx.scores(spark, sf).selectExpr(*KEYS, r6(V.bigwin_keep_score(), "score"))


# score map and hits of the loading fixtures: five scores, splash words on some frames
LOAD_SCORES = ("map('loading', top_score, 'BigWin', bigwin_keep_signal, 'Transition', diff_score / 4, 'Feature game', feature_active_score, 'Basegame', basegame_ui_score)")
LOAD_HITS = "CASE frame_idx % 4 WHEN 0 THEN array('loading:7', 'loading_splash_visual') WHEN 1 THEN array('loading_cover_text') ELSE array('wait:1') END"
_COMP5 = "greatest(bigwin_keep_signal, diff_score/4, feature_active_score, 0.0)"
LOAD_KEEP = (f"(top_score*2.0 + CASE WHEN frame_idx % 4 = 0 THEN 14 ELSE 0 END + CASE WHEN frame_idx % 4 <= 1 THEN 4 ELSE 0 END + CASE WHEN frame_idx <= 900 THEN greatest(0.0, 9.0 - frame_idx/120.0) ELSE 0 END"
             f" - greatest(0.0, greatest({_COMP5}, basegame_ui_score) - top_score)*0.45 - feature_ui_score*0.25 - basegame_ui_score*0.15 - greatest(0.0, noise_score - 12.0)*0.2)")


@query("k4_loading_keep_score", with_sql("frames_fx", f"SELECT video_id, frame_idx, round({LOAD_KEEP},6)::DOUBLE AS score FROM frames_fx"))
def _(spark, sf):
    d = fx.scores(spark, sf).selectExpr("*", f"{LOAD_SCORES} AS category_scores", f"{LOAD_HITS} AS loading_hits")
    return d.selectExpr(*KEYS, r6(V.loading_keep_score("category_scores", "loading_hits"), "score"))


@query("k5_help_keep_score", with_sql("records", f"SELECT video_id, frame_idx, round({HELP_KEEP},6)::DOUBLE AS score FROM records"))
def _(spark, sf):
    d = records(spark, sf).selectExpr("*", f"{S.RECORD_STATS} AS stats")
    return d.selectExpr(*KEYS, r6(V.help_keep_score("stats"), "score"))


_TOPK = "CASE category " + " ".join(f"WHEN '{c}' THEN {k}" for c, k in TOP_K.items()) + " ELSE 10 END"


@query("k6_top_k_for", with_sql("frames_fx", f"SELECT video_id, frame_idx, {_TOPK} AS k FROM frames_fx"))
def _(spark, sf):
    return fx.scores(spark, sf).selectExpr(*KEYS, f"{SE.top_k_for('category')} AS k")


@query("k7_top_k_per_group", with_sql("frames_fx", f"""SELECT video_id, frame_idx, category, rnk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY video_id, category ORDER BY top_score DESC, frame_idx) AS INTEGER) AS rnk
  FROM frames_fx) WHERE rnk <= {_TOPK}"""))
def _(spark, sf):
    return SE.top_k_per_category(fx.scores(spark, sf).select(*KEYS, "category", "top_score")).selectExpr(*KEYS, "category", "rank AS rnk")


def _islands(part: str, table: str, out: str = "grp") -> str:
    return (f"SELECT * EXCLUDE (b), CAST(sum(b) OVER (PARTITION BY {part} ORDER BY frame_idx) AS BIGINT) AS {out} FROM (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER "
            f"(PARTITION BY {part} ORDER BY frame_idx) > {GAP} THEN 1 ELSE 0 END AS b FROM {table})")


@query("k8_gap_groups", with_sql("frames_fx", "SELECT video_id, category, frame_idx, grp FROM (" + _islands("video_id, category", "frames_fx") + ")"))
def _(spark, sf):
    d = fx.scores(spark, sf).select("video_id", "category", "frame_idx")
    return W.gap_groups(d, ["video_id", "category"], "frame_idx", GAP)


@query("k8_gap_groups_events", """SELECT event_type, CAST(grp AS BIGINT) AS grp, count(*) AS n, min(event_id) AS first_id FROM (SELECT *, sum(b) OVER (PARTITION BY event_type ORDER BY s) AS grp FROM (
  SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY event_type ORDER BY s) > 1800 THEN 1 ELSE 0 END AS b FROM (SELECT *, epoch_us(ts)/1000000.0::DOUBLE AS s FROM events))) GROUP BY 1, 2""")
def _(spark, sf):
    d = fx.table(spark, sf, "events").selectExpr("event_type", "event_id", "unix_micros(CAST(ts AS TIMESTAMP)) / 1000000.0D AS s")
    g = W.gap_groups(d, ["event_type"], "s", 1800, width=86400)
    return g.groupBy("event_type", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("k9_best_per_event", with_sql("frames_fx", "SELECT video_id, grp, frame_idx FROM (" + _islands("video_id", "(SELECT * FROM frames_fx WHERE category = 'BigWin')") + """)
  QUALIFY row_number() OVER (PARTITION BY video_id, grp ORDER BY top_score DESC, noise_score, frame_idx) = 1"""))
def _(spark, sf):
    d = fx.scores(spark, sf).where("category = 'BigWin'").select(*KEYS, "top_score", "noise_score")
    g = W.gap_groups(d, ["video_id"], "frame_idx", GAP)
    return SE.best_per_event(g, ["video_id"], [("top_score", True), ("noise_score", False)]).select("video_id", "grp", "frame_idx")


@query("k10_fill_to_k", with_sql("frames_fx", "SELECT video_id, frame_idx, CAST(row_number() OVER (PARTITION BY video_id ORDER BY win DESC, top_score DESC, frame_idx) AS INTEGER) AS keep_rank FROM (SELECT *, "
       "CASE WHEN row_number() OVER (PARTITION BY video_id, grp ORDER BY top_score DESC, frame_idx) = 1 THEN 1 ELSE 0 END AS win FROM (" + _islands("video_id", "frames_fx") + ")) QUALIFY keep_rank <= 8"))
def _(spark, sf):
    d = fx.scores(spark, sf).select(*KEYS, "top_score")
    order = [("top_score", True)]
    winners = SE.best_per_event(W.gap_groups(d, ["video_id"], "frame_idx", GAP), ["video_id"], order)
    return SE.fill_to_k(d, winners, ["video_id"], order, 8).select(*KEYS, "keep_rank")


_TR_ORDER = "record_award::INT DESC, record_settings::INT, transition_keep_score DESC, noise_score, top_score DESC, frame_idx"


@query("k11_select_transition", with_sql("records", f"SELECT video_id, frame_idx, CAST(row_number() OVER (PARTITION BY video_id ORDER BY win DESC, {_TR_ORDER}) AS INTEGER) AS keep_rank FROM (SELECT *, CASE WHEN "
       f"row_number() OVER (PARTITION BY video_id, grp ORDER BY {_TR_ORDER}) = 1 THEN 1 ELSE 0 END AS win FROM (" + _islands("video_id", "(SELECT * FROM records WHERE category = 'Transition')")
       + ")) QUALIFY keep_rank <= 6"))
def _(spark, sf):
    d = records(spark, sf, "record_award", "record_settings").where("category = 'Transition'")
    d = d.select(*KEYS, "sig_record_award", "sig_record_settings", "transition_keep_score", "noise_score", "top_score")
    return SE.select_transition(d, GAP).select(*KEYS, "keep_rank")


_TIER_POS = "CASE t " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(BIGWIN_TIERS)) + " END"
cte("big", "records", f"""SELECT *, round({BIG_KEEP},9) AS keep, CASE WHEN tier <> '' THEN tier WHEN NOT has_big AND frame_idx < first_label AND (bigwin_keep_signal >= 4 OR top_score >= 6) THEN 'big_win' ELSE '' END AS t FROM (SELECT *,
  min(CASE WHEN tier <> '' THEN frame_idx END) OVER (PARTITION BY video_id) AS first_label, coalesce(bool_or(tier = 'big_win') OVER (PARTITION BY video_id), FALSE) AS has_big FROM records
  WHERE category = 'BigWin' AND (bigwin_keep_signal >= 10 OR top_score >= 6 OR tier <> ''))""")
cte("big_pick", "big", f"SELECT video_id, frame_idx, {_TIER_POS} AS tp FROM (" + _islands("video_id, t", "(SELECT * FROM big WHERE t <> '')")
    + ") QUALIFY row_number() OVER (PARTITION BY video_id, t, grp ORDER BY keep DESC, blur_score DESC, noise_score, top_score DESC, frame_idx) = 1")


@query("k12_select_bigwin", with_sql("big_pick", """SELECT video_id, frame_idx, t AS tier, CAST(row_number() OVER (PARTITION BY video_id ORDER BY tp NULLS LAST, CASE WHEN tp IS NOT NULL THEN frame_idx END, keep DESC,
  blur_score DESC, noise_score, frame_idx) AS INTEGER) AS keep_rank FROM big LEFT JOIN big_pick USING (video_id, frame_idx) QUALIFY keep_rank <= 12"""))
def _(spark, sf):
    d = records(spark, sf).where("category = 'BigWin'").selectExpr(
        *KEYS, "bigwin_keep_signal", "top_score", "blur_score", "noise_score", f"{S.bigwin_tier('record_compact')} AS tier")
    return SE.select_bigwin(d, GAP).select(*KEYS, "tier", "keep_rank")


@query("k13_help_group", with_sql("records", f"""SELECT video_id, frame_idx, grp FROM (SELECT *, max(CASE WHEN best = 1 THEN grp END) OVER (PARTITION BY video_id) AS bg, count(*) FILTER (ok AND record_web_chrome) OVER (PARTITION BY video_id) AS n_web FROM (SELECT *,
  row_number() OVER (PARTITION BY video_id ORDER BY n_ok DESC, round(q, 9) DESC, n DESC, grp, frame_idx) AS best FROM (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY video_id, grp) AS n_ok,
  avg(help_quality_score) OVER (PARTITION BY video_id, grp) AS q, count(*) OVER (PARTITION BY video_id, grp) AS n FROM ({_islands("video_id", f"(SELECT *, {RULE_HELP_SQL} AS ok FROM records WHERE category = 'Help')")})))) WHERE CASE WHEN n_web >= 3 THEN ok AND record_web_chrome ELSE grp = bg END"""))
def _(spark, sf):
    d = records(spark, sf, "plain_rule_help", "record_web_chrome").where("category = 'Help'")
    return SE.help_candidates(d.select(*KEYS, "help_quality_score", "sig_plain_rule_help", "sig_record_web_chrome"), GAP).select(*KEYS, "grp")


def help_rows(spark, sf):
    d = records(spark, sf, "plain_rule_help", "record_web_chrome").where("category = 'Help'").selectExpr("*", f"{S.RECORD_STATS} AS stats")
    return d.selectExpr(*KEYS, "help_quality_score", "help_paytable_score", "blur_score", "noise_score", "top_score", "sig_plain_rule_help", "sig_record_web_chrome",
                        f"{V.help_keep_score('stats')} AS help_score", f"{T.token_set('transform(filter(items, i -> i.score >= 0.6D), i -> i.text)')} AS help_tokens")


@query("k13_select_help")
def _(spark, sf):
    """Help pages kept per video: rule pages, then paytable pages, then fallbacks, without near duplicates."""
    return SE.select_help(help_rows(spark, sf), GAP).select(*KEYS, "keep_rank", "stage")


@query("k14_select_loading", with_sql("frames_fx", f"""SELECT video_id, frame_idx, CAST(row_number() OVER (PARTITION BY video_id ORDER BY sr NULLS LAST, keep DESC, frame_idx) AS INTEGER) AS keep_rank FROM (
  SELECT *, CASE WHEN frame_idx % 4 = 0 THEN (CASE WHEN srn <= 3 THEN srn END) END AS sr FROM (SELECT *, round({LOAD_KEEP},9) AS keep, row_number() OVER (PARTITION BY video_id, frame_idx % 4 = 0 ORDER BY frame_idx, {_COMP5} DESC, noise_score DESC) AS srn
  FROM frames_fx WHERE category = 'loading')) QUALIFY keep_rank <= 6"""))
def _(spark, sf):
    d = fx.scores(spark, sf).where("category = 'loading'").selectExpr("*", f"{LOAD_SCORES} AS category_scores", f"{LOAD_HITS} AS loading_hits")
    return SE.select_loading(d).select(*KEYS, "keep_rank")


CLEAN_SQL = ("NOT (record_feature_text OR (record_intro AND NOT record_base_text) OR record_result_text OR obstruction_score >= 5.5 OR (noise_score >= 4.6 AND obstruction_score >= 2.8)"
             " OR (exposure_score >= 3.6 AND obstruction_score >= 2.8))")
cte("base_pool", "records", f"""SELECT *, count(*) FILTER (clean) OVER v AS n_clean, count(*) FILTER (ui AND clean) OVER v AS n_ui_clean FROM (SELECT *, basegame_ui_score >= 3 AS ui, noise_score < 3.4 AS quiet FROM (
  SELECT *, {CLEAN_SQL} AS clean, row_number() OVER (PARTITION BY video_id ORDER BY basegame_ui_score DESC, round({BASE_KEEP},9) DESC, noise_score, blur_score DESC, top_score, frame_idx) AS pool_rank,
  count(*) OVER (PARTITION BY video_id) AS n FROM records WHERE category = 'Basegame') WHERE pool_rank <= least(n, greatest(9, ceil(n*0.45)))) WINDOW v AS (PARTITION BY video_id)""")
cte("base_fit", "base_pool", "SELECT *, count(*) FILTER (fit AND quiet) OVER v AS n_quiet, count(*) FILTER (fit) OVER v AS n_fit FROM (SELECT *, ui AND (clean OR n_ui_clean = 0) AS fit FROM base_pool) WINDOW v AS (PARTITION BY video_id)")


@query("k15_basegame_pool", with_sql("base_fit", """SELECT video_id, frame_idx, pool_rank FROM (SELECT *, CASE WHEN n_quiet >= 9 THEN fit AND quiet ELSE fit END AS s2, CASE WHEN n_quiet >= 9 THEN n_quiet ELSE n_fit END AS n2 FROM base_fit)
  WHERE CASE WHEN n2 < 9 AND n_clean > 0 THEN clean ELSE s2 END"""))
def _(spark, sf):
    d = records(spark, sf, "record_feature_text", "record_intro", "record_base_text", "record_result_text").where("category = 'Basegame'")
    d = d.select(*KEYS, "basegame_ui_score", "blur_score", "noise_score", "top_score", "obstruction_score", "exposure_score",
                 "sig_record_feature_text", "sig_record_intro", "sig_record_base_text", "sig_record_result_text")
    return SE.basegame_pool(d).selectExpr(*KEYS, "pool_rank")


_SEEN = "(obstruction_score < 2.8 OR feature_active_score >= 8) AND (record_spins_left OR help_quality_score < 8)"
cte("feat_rows", "records", f"SELECT *, round({FEAT_KEEP},9) AS keep, record_spins_left AND obstruction_score < 2.8 AS ctr, count(*) FILTER (record_spins_left AND obstruction_score < 2.8) OVER (PARTITION BY video_id) AS n_ctr FROM records WHERE category = 'Feature game'")
cte("feat_pool", "feat_rows", f"""SELECT *, count(*) FILTER (fl AND quiet) OVER v AS n_fq FROM (SELECT *, feature_ui_score >= 3.5 OR feature_active_score >= 8 AS fl, noise_score < 3.4 AS quiet, {_SEEN} AS seen FROM (SELECT *, row_number() OVER (PARTITION BY video_id
  ORDER BY record_spins_left::INT DESC, feature_active_score DESC, feature_ui_score DESC, keep DESC, noise_score, blur_score DESC, top_score DESC, frame_idx) AS pool_rank, count(*) OVER (PARTITION BY video_id) AS n
  FROM feat_rows WHERE n_ctr < 9) WHERE pool_rank <= least(n, greatest(9, ceil(n*0.70)))) WINDOW v AS (PARTITION BY video_id)""")
cte("feat_fit", "feat_pool", "SELECT *, count(*) FILTER (f2 AND seen) OVER v AS n_v, count(*) FILTER (f2) OVER v AS n_f2 FROM (SELECT *, fl AND (quiet OR n_fq < 9) AS f2 FROM feat_pool) WINDOW v AS (PARTITION BY video_id)")


@query("k16_feature_pool", with_sql("feat_fit", """SELECT video_id, frame_idx, pool_rank, FALSE AS final FROM (SELECT *, f2 AND (seen OR n_v < 9) AS f3, CASE WHEN n_v >= 9 THEN n_v ELSE n_f2 END AS n3 FROM feat_fit) WHERE n3 < 9 OR f3
  UNION ALL SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id ORDER BY keep DESC, frame_idx) AS pool_rank, TRUE FROM feat_rows WHERE n_ctr >= 9 AND ctr QUALIFY pool_rank <= 9"""))
def _(spark, sf):
    d = records(spark, sf, "record_spins_left").where("category = 'Feature game'").select(
        *KEYS, "feature_ui_score", "feature_active_score", "blur_score", "noise_score", "top_score", "obstruction_score", "help_quality_score", "sig_record_spins_left")
    return SE.feature_pool(d).selectExpr(*KEYS, "CAST(pool_rank AS BIGINT) AS pool_rank", "final")


cte("doc_tokens", "", f"""SELECT doc_id, list_distinct(list_filter(string_split(n,' '), lambda t: len(t) >= 3 AND NOT regexp_full_match(t,'[0-9]+'))) AS toks
  FROM (SELECT doc_id, {norm_sql('text')} AS n FROM documents)""")


cte("doc_rank", "doc_tokens", "SELECT lang AS part, doc_id, lang, toks, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM doc_tokens JOIN documents USING (doc_id)")
_K17 = greedy_sql("SELECT part, n FROM doc_rank", """SELECT a.part, a.n AS a, b.n AS b FROM doc_rank a JOIN doc_rank b ON a.part = b.part AND a.n < b.n
  AND len(a.toks) > 0 AND len(b.toks) BETWEEN 0.985 * len(a.toks) AND len(a.toks) / 0.985
  WHERE len(list_intersect(a.toks, b.toks)) >= 0.985 * (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks)))""")


@query("k17_greedy_dedup", with_sql("doc_rank", f"SELECT r.lang, r.doc_id, CAST(k.keep_rank AS INTEGER) AS keep_rank FROM ({_K17}) k JOIN doc_rank r ON r.part = k.part AND r.n = k.n"))
def _(spark, sf):
    """All documents of each language, longest first, that are not near copies of a kept one."""
    d = fx.spread(fx.table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "text")).selectExpr(
        "doc_id", "lang", "n_chars", f"transform({T.token_set('array(text)')}, t -> xxhash64(t)) AS tokens")
    return G.greedy_distinct(d, ["lang"], "doc_id", ["n_chars DESC", "doc_id"], "tokens", 0.985)


@query("k18_jaccard", with_sql("doc_tokens", """SELECT a.doc_id, round(CASE WHEN len(a.toks) = 0 OR len(b.toks) = 0 THEN 0 ELSE len(list_intersect(a.toks,b.toks))::DOUBLE
  / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks,b.toks))) END, 6)::DOUBLE AS jaccard FROM doc_tokens a JOIN doc_tokens b ON b.doc_id = a.doc_id + 1"""))
def _(spark, sf):
    t = docs(spark, sf).selectExpr("doc_id", f"{T.token_set('array(text)')} AS toks")
    nxt = t.selectExpr("doc_id - 1 AS doc_id", "toks AS other")
    return t.join(nxt, "doc_id").selectExpr("doc_id", r6(X.jaccard("toks", "other"), "jaccard"))


@query("k19_visual_similarity", """SELECT vec_id, round(mad,6) AS mad, round(corr,6) AS corr, mad <= 0.006 AND corr >= 0.995 AS same FROM (
  SELECT vec_id, avg(abs(ga::DOUBLE - gb::DOUBLE)) FILTER (i <= 32) AS mad, corr(ga::DOUBLE, gb::DOUBLE) FILTER (i > 32) AS corr FROM (SELECT a.vec_id, unnest(a.embedding) AS ga, unnest(b.embedding) AS gb, unnest(range(1,65)) AS i
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + CASE WHEN a.vec_id % 3 = 0 THEN 0 ELSE 1 END) GROUP BY 1)""")
def _(spark, sf):
    e = fx.table(spark, sf, "embeddings").selectExpr("vec_id", "slice(embedding, 1, 32) AS g", "transform(slice(embedding, 33, 32), v -> CAST(v AS DOUBLE)) AS h")
    # every third with itself
    j = e.withColumn("partner", F.expr("vec_id + IF(vec_id % 3 = 0, 0, 1)")).join(e.selectExpr("vec_id AS partner", "g AS g2", "h AS h2"), "partner")
    return j.selectExpr("vec_id", r6(X.mean_abs_diff("g", "g2"), "mad"), r6(X.correlation("h", "h2"), "corr"), f"{X.visually_same('g', 'g2', 'h', 'h2')} AS same")


def vectors(spark, sf):
    return fx.table(spark, sf, "embeddings").selectExpr("CAST(label AS BIGINT) AS video_id", "vec_id AS frame_idx", "embedding", "CAST(embedding[1] AS DOUBLE) AS score")


@query("k20_cluster_stratified_sample")
def _(spark, sf):
    """k-means strata of each label's vectors: three clusters, three rows each, best score first."""
    d = vectors(spark, sf)
    lab = CL.labels(d, ["video_id"], "frame_idx", "embedding", 3).join(d.select(*KEYS, "score"), KEYS)
    return CL.stratified_sample(lab, ["video_id"], "frame_idx", 3, 3, "score").selectExpr(*KEYS, "cluster", "cluster_order", "cluster_rank", r6("distance", "distance"))


@query("k20_sample_given_clusters", """WITH d AS (SELECT vec_id % 3 AS grp, vec_id, label AS cluster, round(abs(embedding[1]::DOUBLE),9) AS distance, round(embedding[2]::DOUBLE,9) AS score FROM embeddings),
  s AS (SELECT grp, cluster, row_number() OVER (PARTITION BY grp ORDER BY n DESC, cluster) AS cluster_order, sum(n) OVER (PARTITION BY grp) AS total FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN big THEN 0 ELSE 1 END, m, n DESC, cluster) AS low
   FROM (SELECT *, n >= greatest(1, floor(max(n) OVER (PARTITION BY grp)*0.65)) AS big FROM (SELECT grp, cluster, count(*) AS n, round(avg(score),9) AS m FROM d GROUP BY 1,2))) WHERE low <> 1 OR NOT big)
  SELECT grp, vec_id, cluster, CAST(cluster_order AS INTEGER) AS cluster_order, CAST(row_number() OVER (PARTITION BY grp, cluster ORDER BY score DESC, distance, vec_id) AS INTEGER) AS cluster_rank FROM d JOIN s USING (grp, cluster) QUALIFY cluster_rank <= 3""")
def _(spark, sf):
    d = fx.table(spark, sf, "embeddings").selectExpr("vec_id % 3 AS grp", "vec_id", "label AS cluster", "round(abs(CAST(embedding[0] AS DOUBLE)), 9) AS distance",
                                                     "round(CAST(embedding[1] AS DOUBLE), 9) AS score")
    return CL.stratified_sample(d, ["grp"], "vec_id", 10, 3, "score", "score").select("grp", "vec_id", "cluster", "cluster_order", "cluster_rank")


@query("k21_farthest_first_kmeans")
def _(spark, sf):
    d = vectors(spark, sf)
    return CL.labels(d, ["video_id"], "frame_idx", "embedding", 3).selectExpr(*KEYS, "cluster", r6("distance", "distance"))


cte("means", "", "SELECT c, list(m ORDER BY i) AS center FROM (SELECT label % 3 AS c, i, avg(v::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings) GROUP BY 1,2) GROUP BY 1")


@query("k21_assignment_step", with_sql("means", """SELECT vec_id, c AS cluster, round(d,6) AS distance FROM (SELECT vec_id, c, list_distance(embedding::DOUBLE[], center) AS d FROM embeddings JOIN means ON TRUE)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1"""))
def _(spark, sf):
    e = fx.table(spark, sf, "embeddings").selectExpr("0 AS one", "vec_id AS id_", "label % 3 AS c", "transform(embedding, v -> CAST(v AS DOUBLE)) AS vec")
    means = e.groupBy("one", "c").agg(CL.vector_to_array(CL.Summarizer.mean(CL.array_to_vector(F.col("vec")))).alias("m"))
    centers = means.groupBy("one").agg(F.expr("transform(array_sort(collect_list(struct(c, m))), s -> s.m) AS centers"))
    return CL.assign(e.drop("c"), centers, ["one"]).selectExpr("id_ AS vec_id", "cluster", r6("distance", "distance"))


cte("two_means", "", "SELECT c, list(m ORDER BY i) AS center FROM (SELECT label % 2 AS c, i, avg(v::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings) GROUP BY 1,2) GROUP BY 1")


@query("k22_cluster_separation", with_sql("two_means", """SELECT round(list_distance(max(center) FILTER (c = 0), max(center) FILTER (c = 1)) / greatest(1e-6, avg(w) + 1e-6), 6) AS separation FROM (SELECT c, any_value(center) AS center, avg(list_distance(embedding::DOUBLE[], center)) AS w
  FROM embeddings JOIN two_means ON label % 2 = c GROUP BY 1)"""))
def _(spark, sf):
    e = fx.table(spark, sf, "embeddings").selectExpr("0 AS one", "label % 2 AS cluster", "transform(embedding, v -> CAST(v AS DOUBLE)) AS vec", "vec_id")
    means = e.groupBy("one", "cluster").agg(CL.vector_to_array(CL.Summarizer.mean(CL.array_to_vector(F.col("vec")))).alias("m"))
    centers = means.groupBy("one").agg(F.expr("transform(array_sort(collect_list(struct(cluster, m))), s -> s.m) AS centers"))
    d = G.join_small(e, centers, ["one"], "vec_id").selectExpr("one", "cluster", f"sqrt({X.squared_distance('vec', 'centers[cluster]')}) AS distance")
    return CL.separation(d, centers, ["one"]).selectExpr(r6("separation", "separation"))


cte("evidence", "records", """SELECT *, round(5.0*n_ctr + 2.0*n_ft + 1.4*n_fg + 0.8*greatest(0.0, fu - bu),9) AS fe, round(n_bg + 0.4*n_bt + 0.8*greatest(0.0, bu - fu),9) AS be FROM (SELECT video_id, frame_idx % 2 AS cluster, count(*) AS n,
  count(*) FILTER (record_feature_text) AS n_ft, count(*) FILTER (record_strong_counter) AS n_ctr, count(*) FILTER (record_base_text) AS n_bt, count(*) FILTER (category = 'Feature game') AS n_fg,
  count(*) FILTER (category = 'Basegame') AS n_bg, avg(feature_ui_score) AS fu, avg(basegame_ui_score) AS bu FROM records WHERE category IN ('Basegame','Feature game','Transition') GROUP BY 1,2)""")
EVIDENCE_SIGNALS = ("record_feature_text", "record_strong_counter", "record_base_text")


def clustered(spark, sf):
    d = records(spark, sf, *EVIDENCE_SIGNALS).where("category IN ('Basegame', 'Feature game', 'Transition')")
    return d.selectExpr(*KEYS, "category", "frame_idx % 2 AS cluster", "feature_ui_score", "basegame_ui_score", *[f"sig_{s}" for s in EVIDENCE_SIGNALS])


@query("k23_cluster_evidence", with_sql("evidence", "SELECT video_id, cluster, n, round(fe,6)::DOUBLE AS feature_evidence, round(be,6)::DOUBLE AS base_evidence FROM evidence"))
def _(spark, sf):
    return CL.cluster_evidence(clustered(spark, sf), ["video_id"]).selectExpr(
        "video_id", "cluster", "n", r6("feature_evidence", "feature_evidence"), r6("base_evidence", "base_evidence"))


@query("k24_relabel_by_cluster", with_sql("evidence", """SELECT video_id, frame_idx, category, CASE WHEN frame_idx % 2 = fc AND category IN ('Basegame','Transition') AND (record_strong_counter OR feature_ui_score >= 2.625) THEN 'Feature game'
  WHEN frame_idx % 2 = 1 - fc AND category = 'Feature game' AND NOT record_feature_text AND basegame_ui_score >= 3 THEN 'Basegame' ELSE category END AS category_refined FROM records LEFT JOIN (SELECT a.video_id, a.cluster AS fc FROM evidence a JOIN evidence b
   ON a.video_id = b.video_id AND b.cluster = 1 - a.cluster WHERE (a.fe > b.fe OR (a.fe = b.fe AND a.cluster = 0)) AND a.fe >= 2 AND a.fe > b.fe + 0.5) USING (video_id) WHERE category IN ('Basegame','Feature game','Transition')"""))
def _(spark, sf):
    d = clustered(spark, sf)
    choice = CL.evidence_choice(CL.cluster_evidence(d, ["video_id"]), ["video_id"])
    return CL.relabel_by_cluster(d, choice, ["video_id"]).select(*KEYS, "category", "category_refined")


@query("k25_rescue_by_counter", with_sql("records", """SELECT video_id, frame_idx, CASE WHEN h THEN 'Feature game' ELSE category END AS category_refined, CASE WHEN h THEN greatest(top_score, 10.0) ELSE top_score END::DOUBLE AS top_score FROM (SELECT *,
  category = 'Transition' AND (record_strong_counter OR (record_counter AND NOT record_start_intro AND NOT record_result_text AND obstruction_score >= 3)) AND NOT record_start_intro AND NOT record_result_text AS h FROM records)"""))
def _(spark, sf):
    d = records(spark, sf, "record_strong_counter", "record_counter_over_board", "record_start_intro", "record_result_text")
    return SE.rescue_by_counter(d).select(*KEYS, "category_refined", "top_score")


@query("k26_reassign", with_sql("frames_fx", """SELECT video_id, frame_idx, 'out/v' || video_id || '/' || CASE WHEN frame_idx % 3 = 0 THEN 'Other' ELSE category END || '/f_' || lpad(frame_idx::VARCHAR, 6, '0') || '.jpg' AS path FROM frames_fx"""))
def _(spark, sf):
    d = fx.scores(spark, sf).selectExpr(*KEYS, "category", "concat('out/v', video_id, '/', category, '/f_', lpad(CAST(frame_idx AS STRING), 6, '0'), '.jpg') AS path",
                                        "CASE WHEN frame_idx % 3 = 0 THEN 'Other' ELSE category END AS target")
    return d.selectExpr(*KEYS, f"{SE.reassign('path', 'category', 'target')} AS path")


@query("k27_reject_reasons", with_sql("records", f"""SELECT video_id, frame_idx, {CLEAN_SQL} AS clean, concat_ws('|', CASE WHEN record_feature_text THEN 'feature_running_text' END,
  CASE WHEN record_intro AND NOT record_base_text THEN 'feature_intro_text' END, CASE WHEN record_result_text THEN 'result_text' END, CASE WHEN obstruction_score >= 5.5 THEN 'board_obstructed' END,
  CASE WHEN noise_score >= 4.6 AND obstruction_score >= 2.8 THEN 'noisy_overlay' END, CASE WHEN exposure_score >= 3.6 AND obstruction_score >= 2.8 THEN 'overexposed_overlay' END) AS reasons FROM records WHERE category = 'Basegame'"""))
def _(spark, sf):
    d = records(spark, sf, "record_feature_text", "record_intro", "record_base_text", "record_result_text").where("category = 'Basegame'")
    d = d.selectExpr(*KEYS, f"{V.reasons(SE.reject_terms())} AS r")
    return d.selectExpr(*KEYS, "size(r) = 0 AS clean", "array_join(transform(r, x -> split(x, ':')[0]), '|') AS reasons")


@query("k28_keep_selected", with_sql("frames_fx", f"""SELECT video_id, frame_idx, category, rn <= {_TOPK} AS keep FROM (SELECT *, row_number() OVER (PARTITION BY video_id, category ORDER BY top_score DESC, frame_idx) AS rn
  FROM frames_fx WHERE category IN ('Result','Feature Buy','Other'))"""))
def _(spark, sf):
    """Categories without strata: kept rows marked, the rest marked for the low-score folder."""
    d = fx.scores(spark, sf).where("category IN ('Result', 'Feature Buy', 'Other')").select(*KEYS, "category", "top_score")
    kept = SE.top_k_per_category(d).selectExpr(*KEYS, "true AS kept_")
    return d.join(kept, KEYS, "left").selectExpr(*KEYS, "category", "coalesce(kept_, false) AS keep")


@query("k29_anti_keep", with_sql("frames_fx", f"""SELECT video_id, frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY video_id, category ORDER BY top_score DESC, frame_idx) AS rn FROM frames_fx) WHERE rn > {_TOPK}"""))
def _(spark, sf):
    d = fx.scores(spark, sf).select(*KEYS, "category", "top_score")
    return SE.anti_keep(d, SE.top_k_per_category(d)).select(*KEYS)
