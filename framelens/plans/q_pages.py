"""Queries for page detection, boxes, icons and profiles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import scores as V
from ..functions import vectors as X
from ..functions.rules import GAME_RULES_TERMS, PAYOUT_TITLE_TERMS
from ..operators import icons as I
from ..operators import pages as P
from . import fixtures as fx
from . import icon_sql as SQL
from .q_classify import ICON_QUALITY_SQL, KEYS, PAGE_TEXT_SQL, VISUAL_SQL, page_text, r6
from .registry import query
from .sqlkit import cte, greedy_sql, q, substr_sql, with_sql


def pages(spark, sf):
    return P.with_page_scores(page_text(fx.frames(spark, sf)))


cte("page_fx", "page_counts metrics_fx", f"SELECT *, round({VISUAL_SQL},6)::DOUBLE AS vis, round({PAGE_TEXT_SQL},6)::DOUBLE AS txt, CASE WHEN component_count >= 3 THEN component_count ELSE 0 END AS icons, "
    "dark_plain_ratio >= 0.30 OR dark_ratio >= 0.42 AS r_dark, yellow_ratio >= 0.012 AS r_yellow, component_count BETWEEN 3 AND 5 AS r_some, regexp_matches(pt,'wild|scatter') AS r_wild, "
    r"contains(pt,'multiplier symbol') AS r_multi, regexp_matches(pt,'\bpay\s*table\b|\bpaytable\b') AS has_word, "
    f"(n_num >= 10 OR n_pair >= 3 OR n_full >= 2) AS r_values, {substr_sql('pt', PAYOUT_TITLE_TERMS)} AS r_title, {substr_sql('pt', GAME_RULES_TERMS)} AS r_rules "
    "FROM page_counts JOIN metrics_fx USING (video_id, frame_idx)")
PRE_SQL = "(vis >= 2.0 OR (vis >= 1.6 AND r_yellow AND r_dark) OR (vis >= 0.5 AND r_some AND r_dark))"
PAGE_SQL = f"""({PRE_SQL} AND NOT (regexp_matches(pt,'buy feature|feature buy') OR (contains(pt,'cost') AND contains(pt,'quantity'))) AND NOT (r_rules AND NOT (r_title OR r_multi OR has_word) AND vis < 4.0)
  AND ((r_title AND txt+vis >= 5.5) OR (r_multi AND txt+vis >= 4.8) OR (txt >= 4 AND vis >= 3 AND txt+vis >= 7) OR (has_word AND r_values AND icons >= 8 AND txt+vis >= 5.5)
   OR (has_word AND r_values AND icons >= 4 AND txt+vis >= 4.3) OR (has_word AND (r_wild OR r_multi) AND r_yellow AND txt+vis >= 4.0) OR (icons >= 4 AND vis >= 4.0 AND NOT r_rules)))"""


@query("p1_paytable_prefilter", with_sql("page_fx", f"SELECT video_id, frame_idx, vis AS visual_score FROM page_fx WHERE {PRE_SQL}"))
def _(spark, sf):
    return pages(spark, sf).where(P.prefilter()).select(*KEYS, "visual_score")


@query("p2_is_paytable_page", with_sql("page_fx", f"SELECT video_id, frame_idx, {PAGE_SQL} AS page, {PRE_SQL} AND vis >= 4.6 AS page_no_text, icons::INTEGER AS icons FROM page_fx"))
def _(spark, sf):
    return pages(spark, sf).selectExpr(*KEYS, f"{P.is_paytable_page()} AS page", f"{P.is_paytable_page(False)} AS page_no_text", "icons")


def scored_pages(spark, sf):
    return pages(spark, sf).selectExpr(
        f"{P.is_paytable_page()} AS page", "video_id", "frame_idx AS pos", "CAST(frame_idx % 50 AS STRING) AS name", "frame_idx % 3 = 0 AS secondary", "round(text_score + visual_score, 6) AS page_score",
        "concat(text_reasons, visual_reasons) AS page_reasons", "icons")


_WORD = r"(has_word AND NOT r_multi)"
_STRONG = f"((s >= 4 AND {_WORD} AND (r_wild OR r_multi OR icons >= 4) AND (r_values OR (r_wild AND r_yellow))) OR (s >= 3 AND icons >= 4 AND r_values AND NOT {_WORD}))"
cte("page_ok", "page_fx", f"SELECT *, round(txt+vis,6) AS s, frame_idx % 3 = 0 AS sec, frame_idx % 50 AS name FROM page_fx WHERE {PAGE_SQL}")
cte("page_plan", "page_ok", f"""SELECT *, least(n_s, 8) AS t2, CASE WHEN n_p > 0 THEN 20 - least(n_s, 8) ELSE 0 END AS t1 FROM (SELECT *, count(*) FILTER (NOT sec) OVER (PARTITION BY video_id) AS n_p,
  count(*) FILTER (sec AND strong) OVER (PARTITION BY video_id) AS n_s FROM (SELECT *, {_STRONG} AS strong, s >= 9.5 AND (r_title OR {_WORD}) AND (r_wild OR r_multi) AND r_values AS rep FROM page_ok))""")
cte("page_pos", "page_plan", """SELECT *, row_number() OVER (PARTITION BY video_id, turn ORDER BY frame_idx) - 1 AS p, count(*) OVER (PARTITION BY video_id, turn) AS n FROM (
  SELECT *, 0 AS turn, t1 AS lim FROM page_plan WHERE NOT sec UNION ALL SELECT *, 1 AS turn, t2 AS lim FROM page_plan WHERE sec AND strong UNION ALL SELECT *, 0 AS turn, 20 AS lim FROM page_plan WHERE n_p = 0 AND n_s = 0)""")
cte("page_pick", "page_pos", """SELECT * FROM page_pos a WHERE lim > 0 AND (n <= lim OR EXISTS (SELECT 1 FROM range(20) t(i) WHERE i < a.lim AND a.p = CAST(round_even(i * CASE WHEN a.lim > 1 THEN (a.n-1)/(a.lim-1)::DOUBLE ELSE 1.0 END, 0) AS BIGINT)))""")
cte("page_sel", "page_pick", """SELECT video_id, frame_idx AS pos, name::VARCHAR AS name, CAST(row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS INTEGER) AS page_rank FROM (SELECT *,
  row_number() OVER (PARTITION BY video_id, name ORDER BY turn, frame_idx) AS seen FROM page_pick) WHERE seen = 1 OR rep QUALIFY page_rank <= 20""")


@query("p3_select_pages", with_sql("page_sel", "SELECT * FROM page_sel"))
def _(spark, sf):
    return P.select_pages(scored_pages(spark, sf), 20)


@query("p4_page_decisions", with_sql("page_sel frames_fx", "SELECT f.video_id, f.frame_idx AS pos, s.pos IS NOT NULL AS selected FROM frames_fx f LEFT JOIN page_sel s ON s.video_id = f.video_id AND s.pos = f.frame_idx"))
def _(spark, sf):
    scanned = fx.scores(spark, sf).selectExpr("video_id", "frame_idx AS pos")
    return P.page_decisions(scanned, P.select_pages(scored_pages(spark, sf), 20))


@query("p5_scan_counters", with_sql("page_fx", f"SELECT video_id, count(*) FILTER (NOT {PRE_SQL}) AS skipped, count(*) FILTER ({PRE_SQL}) AS scanned, count(*) FILTER ({PAGE_SQL}) AS candidates FROM page_fx GROUP BY 1"))
def _(spark, sf):
    return pages(spark, sf).groupBy("video_id").agg(
        F.expr(f"count_if(NOT {P.prefilter()})").alias("skipped"), F.expr(f"count_if({P.prefilter()})").alias("scanned"),
        F.expr(f"count_if({P.is_paytable_page()})").alias("candidates"))


_INTER = "(greatest(0,least(a.x2,b.x2)-greatest(a.x1,b.x1))*greatest(0,least(a.y2,b.y2)-greatest(a.y1,b.y1)))"
_AA, _AB = "((a.x2-a.x1)*(a.y2-a.y1))", "((b.x2-b.x1)*(b.y2-b.y1))"


# boxes of a frame moved together, so that many overlap
_CROWDED = {"x1": "floor(x1 / 150) * 60", "y1": "floor(y1 / 400) * 30", "x2": "floor(x1 / 150) * 60 + 50 + x1 % 100", "y2": "floor(y1 / 400) * 30 + 40 + y1 % 60"}
cte("box_fx", "ocr_fx", "SELECT video_id, frame_idx, line_no, ocr_score, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _CROWDED.items()) + " FROM ocr_fx")


def crowded(spark, sf):
    return fx.ocr_lines(spark, sf).selectExpr(*KEYS, "line_no", "ocr_score", "text", *[f"CAST({e} AS DOUBLE) AS {c}" for c, e in _CROWDED.items()])


@query("p6_box_iou", with_sql("box_fx", f"""SELECT a.video_id, a.frame_idx, a.line_no, round({_INTER}/({_AA}+{_AB}-{_INTER}),6)::DOUBLE AS iou, round({_INTER}/greatest(1.0,least({_AA},{_AB})),6)::DOUBLE AS overlap
  FROM box_fx a JOIN box_fx b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND b.line_no = a.line_no + 1"""))
def _(spark, sf):
    """Each box against the next one of its frame."""
    of_line = lambda e: re.sub(r"\b([xy][12])\b", r"t.\1", e)
    box = ", ".join(f"'{c}', CAST({of_line(e)} AS DOUBLE)" for c, e in _CROWDED.items())
    boxes = fx.frames(spark, sf).selectExpr(*KEYS, f"transform(items, t -> named_struct('line_no', t.line_no, 'a', named_struct({box}))) AS boxes")
    # the lines of a frame are one array in order, so the next one needs no join
    both = boxes.selectExpr(*KEYS, "inline(transform(slice(boxes, 1, size(boxes) - 1), (b, i) -> named_struct('line_no', b.line_no, 'a', b.a, 'b', boxes[i + 1].a)))")
    return both.selectExpr(*KEYS, "line_no", r6(X.box_iou("a", "b"), "iou"), r6(X.box_overlap_min("a", "b"), "overlap"))


cte("box_rank", "box_fx", "SELECT *, video_id * 1000000000 + frame_idx AS part, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY (x2-x1)*(y2-y1) DESC, line_no) AS n FROM box_fx")
_P7 = greedy_sql("SELECT part, n FROM box_rank", f"SELECT a.part, a.n AS a, b.n AS b FROM box_rank a JOIN box_rank b ON a.part = b.part AND a.n < b.n WHERE {_INTER}/({_AA}+{_AB}-{_INTER}) >= 0.42")


@query("p7_suppress_boxes", with_sql("box_rank", f"SELECT video_id, frame_idx, line_no, CAST(keep_rank AS INTEGER) AS keep_rank FROM ({_P7}) JOIN box_rank USING (part, n)"))
def _(spark, sf):
    return P.suppress_boxes(crowded(spark, sf), KEYS, "line_no").select(*KEYS, "line_no", "keep_rank")


_T = "CASE WHEN a.y <= b.y THEN a.{c} ELSE b.{c} END"
_U = "CASE WHEN a.y <= b.y THEN b.{c} ELSE a.{c} END"


@query("p8_merge_stacked", with_sql("ocr_fx", """, bx AS (SELECT video_id, frame_idx, line_no AS i, CAST(x1 AS INTEGER) AS x, CAST(floor(y1/2) AS INTEGER) AS y, CAST(x2-x1 AS INTEGER) AS w, CAST(y2-y1 AS INTEGER) AS h FROM ocr_fx),
  pr AS (SELECT a.video_id, a.frame_idx, a.i, b.i AS j, """.replace(", bx AS", "SELECT * FROM (WITH bx AS", 1)
  + ", ".join(f"{_T.format(c=c)} AS t{c}, {_U.format(c=c)} AS u{c}" for c in "xywh") + """ FROM bx a JOIN bx b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.i <> b.i
   WHERE a.w >= 64 AND a.h >= 49.5 AND b.w >= 64 AND b.h >= 40.5),
  un AS (SELECT *, least(tx,ux) AS x, least(ty,uy) AS y, greatest(tx+tw,ux+uw)-least(tx,ux) AS w, greatest(ty+th,uy+uh)-least(ty,uy) AS h FROM pr WHERE uy-(ty+th) <= greatest(10, floor(least(th,uh)*0.28))
   AND greatest(0, least(tx+tw,ux+uw)-greatest(tx,ux))/greatest(1,least(tw,uw))::DOUBLE >= 0.58)
  SELECT video_id, frame_idx, i, j, x, y, w, h FROM un WHERE h <= 306 AND w <= 152 AND h >= greatest(th,uh)*1.10)"""))
def _(spark, sf):
    df = fx.frames(spark, sf).selectExpr(*KEYS, "transform(items, b -> named_struct('i', b.line_no, 'x', CAST(b.x1 AS INT), 'y', CAST(floor(b.y1 / 2) AS INT), 'w', CAST(b.x2 - b.x1 AS INT), 'h', CAST(b.y2 - b.y1 AS INT))) AS boxes")
    return P.merge_stacked(df, "boxes", 400, 900).select(*KEYS, "i", "j", "x", "y", "w", "h")


def scored_icons(spark, sf):
    return fx.icons(spark, sf).selectExpr("*", f"{V.icon_quality()} AS icon_score")


cte("icon_scored", "icons_fx", f"SELECT *, {ICON_QUALITY_SQL}::DOUBLE AS icon_score FROM icons_fx")
_NEAR = "(abs(box_x-72) <= 16 OR abs(box_x-232) <= 16 OR abs(box_x-390) <= 16 OR abs(box_x-544) <= 16)"


@query("p9_source_flags", with_sql("icons_fx", f"""SELECT video_id, frame_idx, source_w >= 950 AND source_h >= 780 AS large_page, NOT is_secondary AND {_NEAR} AND box_y BETWEEN 206 AND 226
  AND box_w BETWEEN 146 AND 168 AND box_h BETWEEN 100 AND 126 AS trusted FROM icons_fx"""))
def _(spark, sf):
    return fx.icons(spark, sf).selectExpr(*KEYS, f"{I.LARGE_PAGE} AS large_page", f"{I.TRUSTED_BOX} AS trusted")


cte("icon_measures", "icon_scored", SQL.MEASURES)


def _reason_query(name, expr, sql):
    @query(name, with_sql("icon_measures", f"SELECT video_id, frame_idx, {sql} FROM icon_measures"))
    def _(spark, sf):
        return scored_icons(spark, sf).selectExpr(*KEYS, f"{expr} AS reason")


_reason_query("p10_candidate_validity", I.candidate_reason(), SQL.CANDIDATE)
_reason_query("p10_text_only", I.text_only_reason(), SQL.TEXT_ONLY)
_reason_query("p11_quality_reject", I.quality_reason(), SQL.QUALITY)
_reason_query("p12_final_reject", I.final_reason(), SQL.FINAL)
_reason_query("p13_portrait_fragment", I.portrait_reason(), SQL.PORTRAIT)
_reason_query("p13_full_page_text", I.full_page_reason(), SQL.FULL_PAGE)


@query("p13_payout_bleed", with_sql("icons_fx", """SELECT video_id, frame_idx, icon_w >= 42 AND icon_h >= 54 AND lower_text >= 0.035 AND upper_art >= 0.045 AND coalesce(len2,FALSE) AS bleed FROM icons_fx LEFT JOIN (
  SELECT video_id, frame_idx, bool_or(a AND b) AS len2 FROM (SELECT video_id, frame_idx, a, lead(a) OVER (PARTITION BY video_id, frame_idx ORDER BY r) AS b FROM (SELECT video_id, frame_idx, r, (frame_idx * (r + 3)) % 5 < 2 AS a
   FROM icons_fx, range(12) t(r))) GROUP BY 1,2) USING (video_id, frame_idx)"""))
def _(spark, sf):
    df = scored_icons(spark, sf).selectExpr("*", f"{ACTIVE_ROWS} AS active_rows")
    return df.selectExpr(*KEYS, f"{I.payout_bleed('active_rows')} AS bleed")


ACTIVE_ROWS = "transform(sequence(0, 11), r -> (frame_idx * (r + 3)) % 5 < 2)"


@query("p14_allow_overrides", with_sql("icon_measures", f"SELECT video_id, frame_idx, raw, {SQL.GATED} FROM (SELECT *, reason AS raw FROM (SELECT *, {SQL.FINAL} FROM icon_measures))"))
def _(spark, sf):
    return scored_icons(spark, sf).selectExpr("*", f"{I.final_reason()} AS raw").selectExpr(*KEYS, "raw", f"{I.allow_override('raw')} AS gated")


@query("p15_quality_rank", with_sql("icon_scored", """SELECT video_id, frame_idx, round(least(1.0,bbox_w/greatest(1.0,icon_w))*least(1.0,bbox_h/greatest(1.0,icon_h))*0.42 + least(1.0,content_ratio/0.42)*0.24
  + least(1.0,least(icon_w,icon_h)/82.0)*0.20 + icon_score*0.14 - least(0.35,edge_touches*0.10) + CASE WHEN crop_kind = 'mahjong_tile' THEN least(1.0,icon_h/190.0)*0.26 + least(1.0,icon_w/180.0)*0.10
  - CASE WHEN icon_h < 180 THEN 0.32 ELSE 0 END ELSE 0 END, 6)::DOUBLE AS completeness FROM icon_scored"""))
def _(spark, sf):
    return scored_icons(spark, sf).selectExpr(*KEYS, r6(I.quality_rank(), "completeness"))


cte("hashes", "", """SELECT vec_id, embedding, label, CAST(sum(CASE WHEN v > nx AND (i % 8) < 7 THEN (1::BIGINT << (55 - (i - (i // 8)))) ELSE 0 END) AS BIGINT) AS hash FROM (SELECT vec_id, embedding, label, i, v, lead(v) OVER (PARTITION BY vec_id ORDER BY i) AS nx
  FROM (SELECT vec_id, embedding, label, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings)) WHERE i % 8 < 7 OR TRUE GROUP BY 1,2,3""")


def hashed(spark, sf):
    return fx.table(spark, sf, "embeddings").selectExpr("vec_id", "label", "embedding", f"{X.gradient_hash('embedding', 8, 8)} AS hash")


@query("p16_dhash", with_sql("hashes", "SELECT vec_id, hash FROM hashes"))
def _(spark, sf):
    return hashed(spark, sf).select("vec_id", "hash")


@query("p17_hamming", with_sql("hashes", "SELECT a.vec_id, bit_count(xor(a.hash, b.hash))::INTEGER AS bits FROM hashes a JOIN hashes b ON b.vec_id = a.vec_id + 1"))
def _(spark, sf):
    h = hashed(spark, sf).select("vec_id", "hash")
    return h.join(h.selectExpr("vec_id - 1 AS vec_id", "hash AS other"), "vec_id").selectExpr("vec_id", f"{X.hamming('hash', 'other')} AS bits")


@query("p18_pixel_same", """SELECT vec_id, same FROM (SELECT a.vec_id, list_avg(list_transform(list_zip(a.embedding[1:48], b.embedding[1:48]), lambda p: abs(p[1]::DOUBLE-p[2]::DOUBLE))) <= CASE WHEN a.label % 2 = 0 AND b.label % 2 = 0 THEN 0.014 ELSE 0.055 END
  AND list_avg(list_transform(list_zip(a.embedding[49:64], b.embedding[49:64]), lambda p: abs(p[1]::DOUBLE-p[2]::DOUBLE)))*0.1 <= 0.018 AS same FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + CASE WHEN a.vec_id % 3 = 0 THEN 0 ELSE 1 END)""")
def _(spark, sf):
    e = fx.table(spark, sf, "embeddings").selectExpr("vec_id", "slice(embedding, 1, 48) AS rgb", "transform(slice(embedding, 49, 16), v -> CAST(v AS DOUBLE) * 0.1D) AS alpha",
                                                     "CASE WHEN label % 2 = 0 THEN 'portrait_paytable_card' ELSE 'standard' END AS kind")
    # every third with itself
    j = e.withColumn("partner", F.expr("vec_id + IF(vec_id % 3 = 0, 0, 1)")).join(e.selectExpr("vec_id AS partner", "rgb AS rgb2", "alpha AS alpha2", "kind AS kind2"), "partner")
    return j.selectExpr("vec_id", f"{I.pixel_same('rgb', 'rgb2', 'kind', 'kind2', 'alpha', 'alpha2')} AS same")


NEAR = f"{X.mean_abs_diff('r.embedding', 'k.embedding')} <= 0.11D"


cte("hash_rank", "hashes", "SELECT *, label AS part, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM hashes")
_SAME = """bit_count(xor(a.hash, b.hash)) <= 14 AND list_avg(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))) <= 0.11"""
cte("hash_pairs", "hash_rank", f"SELECT a.part, a.n AS a, b.n AS b FROM hash_rank a JOIN hash_rank b ON a.part = b.part AND a.n < b.n WHERE {_SAME}")
_P19 = greedy_sql("SELECT part, n FROM hash_rank", "SELECT * FROM hash_pairs")


@query("p19_near_dup_groups", with_sql("hash_rank hash_pairs", f""", lead AS MATERIALIZED ({_P19}),
  best AS (SELECT part, b AS n, min(a) AS l FROM hash_pairs JOIN lead ON lead.part = hash_pairs.part AND lead.n = a GROUP BY 1, 2)
  SELECT r.label, r.vec_id, CAST(l.keep_rank - 1 AS INTEGER) AS group_no, x.vec_id AS best_id FROM hash_rank r LEFT JOIN lead own USING (part, n) LEFT JOIN best USING (part, n)
  JOIN lead l ON l.part = r.part AND l.n = CASE WHEN own.n IS NOT NULL THEN r.n ELSE best.l END JOIN hash_rank x ON x.part = l.part AND x.n = l.n""".replace("hash_pairs JOIN lead ON lead.part = hash_pairs.part", "hash_pairs p JOIN lead ON lead.part = p.part").replace("SELECT part, b AS n, min(a)", "SELECT p.part, b AS n, min(a)")))
def _(spark, sf):
    """Leader groups per label: hashes within 14 bits and close vectors."""
    return I.near_duplicate_groups(hashed(spark, sf), ["label"], "vec_id", ["vec_id"], NEAR, max_bits=14)


@query("p20_best_of_group", """SELECT label, vec_id, group_no::INTEGER AS group_no, best_id, n_members, vec_id = best_id AS is_best FROM (SELECT label, vec_id, first_value(vec_id) OVER w AS best_id, count(*) OVER (PARTITION BY label) AS n_members,
  dense_rank() OVER (ORDER BY label) - 1 AS group_no FROM (SELECT *, round(embedding[1]::DOUBLE,9) AS score FROM embeddings) WINDOW w AS (PARTITION BY label ORDER BY score DESC, vec_id)) JOIN (SELECT label, CAST(row_number() OVER (ORDER BY s DESC, v) - 1 AS INTEGER) AS g FROM (SELECT label, max(round(embedding[1]::DOUBLE,9)) AS s,
   arg_min(vec_id, -round(embedding[1]::DOUBLE,9)) AS v FROM embeddings GROUP BY 1)) USING (label)""".replace("dense_rank() OVER (ORDER BY label) - 1 AS group_no", "0 AS zero").replace("group_no::INTEGER AS group_no", "g AS group_no"))
def _(spark, sf):
    d = fx.table(spark, sf, "embeddings").selectExpr("0 AS one", "label", "vec_id", "round(CAST(embedding[0] AS DOUBLE), 9) AS score")
    return I.best_of_group(d, ["one"], "label", "vec_id", ["score DESC"]).drop("one")


@query("p21_export_icons")
def _(spark, sf):
    """Final icons of every video with their group; crops of one event paired with an embedding."""
    e = fx.table(spark, sf, "embeddings").selectExpr("vec_id", "embedding", f"{X.gradient_hash('embedding', 8, 8)} AS hash")
    n = e.count()
    rows = fx.icons(spark, sf).selectExpr("*", f"frame_idx % {n} AS vec_id", f"{ACTIVE_ROWS} AS active_rows").join(e, "vec_id")
    return I.export_icons(rows, ["video_id"], "frame_idx", NEAR).select("video_id", "frame_idx", "group_no", "best_id", "icon_score")


@query("p22_round_robin", with_sql("icons_fx", """SELECT video_id, frame_idx, page_no, CAST(row_number() OVER (PARTITION BY video_id ORDER BY turn, page_no, frame_idx) AS INTEGER) AS collect_rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id, page_no ORDER BY frame_idx) AS turn
  FROM icons_fx) QUALIFY collect_rank <= 120"""))
def _(spark, sf):
    return P.round_robin(fx.icons(spark, sf).select(*KEYS, "page_no"), ["video_id"], "page_no", "frame_idx", 120).select(*KEYS, "page_no", "collect_rank")


# pages of uneven size: an odd event counts for the page after its own
@query("p23_sequential_budget", """WITH i AS (SELECT event_id % 10 AS vid, CAST(floor(event_id/200) AS BIGINT) + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS page_no, event_id FROM events), c AS (SELECT *, count(*) OVER (PARTITION BY vid, page_no) AS n FROM i),
  e AS (SELECT *, bool_or(n % 2 = 0 AND n >= 8) OVER (PARTITION BY vid) AS has_even FROM c)
  SELECT vid, page_no, event_id, CAST(row_number() OVER (PARTITION BY vid ORDER BY page_no, event_id) AS INTEGER) AS collect_rank FROM e WHERE NOT has_even OR (n % 2 = 0 AND n >= 8) QUALIFY collect_rank <= 40""")
def _(spark, sf):
    d = fx.table(spark, sf, "events").selectExpr("event_id % 10 AS vid", "CAST(floor(event_id / 200) AS BIGINT) + IF(event_type = 'error', 1, 0) AS page_no", "event_id")
    return P.sequential_budget(d, ["vid"], "page_no", "event_id", 40)


@query("p24_best_by_name", r"""SELECT name_key, CASE WHEN trim(regexp_replace(name_key,'[^a-z0-9]+','_','g'),'_') = '' THEN 'sym_' || p_partkey ELSE trim(regexp_replace(name_key,'[^a-z0-9]+','_','g'),'_') END AS symbol_id, p_partkey, tier, p_retailprice FROM (
  SELECT lower(trim(p_name)) AS name_key, p_partkey, p_type AS tier, p_retailprice FROM part WHERE p_size > 5 AND p_type <> 'PROMO' AND trim(p_name) NOT IN ('','skip')) QUALIFY row_number() OVER (PARTITION BY name_key ORDER BY p_retailprice DESC, p_partkey) = 1""")
def _(spark, sf):
    d = fx.table(spark, sf, "part").selectExpr("p_partkey", "p_name", "p_retailprice", "CASE WHEN p_type = 'PROMO' THEN 'skip' ELSE p_type END AS tier", "p_size > 5 AS playable")
    return I.best_by_name(d, "p_name", "p_retailprice", "p_partkey")


_BRANDS = ["Brand#3", "Brand#1", "Brand#12", "Brand#7"]


@query("p25_tier_groups", "SELECT p_partkey, p_brand, CASE p_brand " + " ".join(f"WHEN {q(b)} THEN {i}" for i, b in enumerate(_BRANDS)) + """ END::INTEGER AS tier_pos, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place
  FROM part WHERE p_brand IN (""" + ",".join(q(b) for b in _BRANDS) + ")")
def _(spark, sf):
    return I.tier_groups(fx.table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", _BRANDS)


# --- profiles: events per hour and type -----------------------------------------------------------------
cte("hours", "", "SELECT event_type, CAST(floor(epoch_us(ts)/3600000000) AS BIGINT) - 473352 AS hr, count(*) AS n FROM events GROUP BY 1,2")


def hours(spark, sf):
    e = fx.table(spark, sf, "events").selectExpr("event_type", "CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 3600000000) AS BIGINT) - 473352 AS hr")
    return e.groupBy("event_type", "hr").agg(F.count(F.lit(1)).alias("n"))


@query("p26_longest_active_interval", with_sql("hours", """SELECT event_type, min(hr) FILTER (act) AS interval_start, max(hr) FILTER (act) AS interval_end FROM (SELECT *, n >= max(n) OVER (PARTITION BY event_type)*0.6 OR hr BETWEEN greatest(20, min(hr) OVER (PARTITION BY event_type))
  AND least(30, max(hr) OVER (PARTITION BY event_type)) AS act FROM hours) GROUP BY 1"""))
def _(spark, sf):
    return P.longest_active_interval(hours(spark, sf), ["event_type"], "hr", "n", 20, 30, 0.6)


@query("p27_largest_true_run", with_sql("hours", """SELECT event_type, run_start, run_end FROM (SELECT event_type, min(hr) AS run_start, max(hr) AS run_end, count(*) AS len FROM (SELECT event_type, hr, hr - row_number() OVER (PARTITION BY event_type ORDER BY hr) AS g FROM hours WHERE n >= 2) GROUP BY event_type, g)
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY len DESC, run_start) = 1"""))
def _(spark, sf):
    return P.largest_true_run(hours(spark, sf), ["event_type"], "hr", "n >= 2")


@query("p28_moving_average", with_sql("hours", "SELECT event_type, hr, round(sum(n) OVER (PARTITION BY event_type ORDER BY hr ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)/7.0::DOUBLE,6) AS smooth FROM hours"))
def _(spark, sf):
    return hours(spark, sf).selectExpr("event_type", "hr", r6(P.moving_average(["event_type"], "hr", "CAST(n AS DOUBLE)", 7), "smooth"))


@query("p29_local_maxima", with_sql("hours", "SELECT event_type, hr, n FROM hours WINDOW w AS (PARTITION BY event_type ORDER BY hr) QUALIFY n > lag(n) OVER w AND n > lead(n) OVER w AND n >= 2"))
def _(spark, sf):
    return P.local_maxima(hours(spark, sf), ["event_type"], "hr", "n", 2.0)


cte("maxima", "hours", "SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY hr) AS i FROM (SELECT event_type, hr, n FROM hours WINDOW w AS (PARTITION BY event_type ORDER BY hr) QUALIFY n > lag(n) OVER w AND n > lead(n) OVER w AND n >= 2)")
_PEAKS = """SELECT * FROM (WITH RECURSIVE pw(event_type, i, p, v, out) AS (SELECT DISTINCT event_type, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM maxima
    UNION ALL SELECT m.event_type, m.i, CASE WHEN p IS NULL OR m.hr - p >= 6 OR m.n > v THEN m.hr ELSE p END, CASE WHEN p IS NULL OR m.hr - p >= 6 OR m.n > v THEN m.n ELSE v END,
      CASE WHEN m.hr - p >= 6 THEN p END FROM pw JOIN maxima m ON m.event_type = pw.event_type AND m.i = pw.i + 1)
  SELECT event_type, out AS hr FROM pw WHERE out IS NOT NULL UNION ALL SELECT event_type, arg_max(p, i) FROM pw WHERE i > 0 GROUP BY 1)"""


@query("p29_spaced_peaks", with_sql("maxima", f"""SELECT l.event_type, l.hr AS left_peak, l.nx AS right_peak, arg_min(h.hr, (h.n, h.hr)) AS valley
  FROM (SELECT event_type, hr, lead(hr) OVER (PARTITION BY event_type ORDER BY hr) AS nx FROM ({_PEAKS})) l JOIN hours h ON h.event_type = l.event_type AND h.hr BETWEEN l.hr AND l.nx
  WHERE l.nx IS NOT NULL GROUP BY 1, 2, 3"""))
def _(spark, sf):
    h = hours(spark, sf)
    peaks = P.spaced_peaks(P.local_maxima(h, ["event_type"], "hr", "n", 2.0), ["event_type"], "hr", "n", 6)
    return P.valleys_between(h, peaks, ["event_type"], "hr", "n")
