"""Queries for sources and sinks, review, corrections and summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.rules import IGNORED_TITLE_WORDS, SUMMARY_CATEGORIES
from ..operators import review as RV
from ..operators import summary as SU
from ..session import ensure_checkpoint_dir
from ..sources import archive as AR
from ..sources import cache as CA
from ..sources import files as FI
from ..sources import naming as NA
from ..sources import results as RE
from . import fixtures as fx
from .q_classify import KEYS, r6, with_confidence
from .registry import query
from .sqlkit import cte, plain_sql, q, substr_sql, with_sql


def scratch(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/out-{uuid.uuid4().hex}"


# --- file listings -----------------------------------------------------------------------------
@query("io1_discover_inputs")
def _(spark, sf):
    return FI.discover_inputs(spark, sf, (".parquet",)).select("name", "stem", "length")


@query("io2_discover_outputs")
def _(spark, sf):
    return FI.discover_outputs(spark, sf.rstrip("/").rsplit("/", 1)[0], "events.parquet")


@query("io3_scan_category_images")
def _(spark, sf):
    """Files of every scale folder (the folder is the category), joined to the records of this scale."""
    records = FI.list_files(spark, sf).selectExpr("name", "length AS recorded_length")
    return FI.scan_category_images(spark, sf.rstrip("/").rsplit("/", 1)[0], records, (".parquet",)).select("category", "name", "recorded_length")


# --- result tables ---------------------------------------------------------------------------------
def result_rows(spark, sf):
    d = with_confidence(fx.frames(spark, sf))
    hits = "map_from_entries(transform(map_entries(matched_keywords), m -> named_struct('k', m.key, 'v', m.value)))"
    return d.selectExpr(
        "concat('v', video_id) AS video_name", "frame_idx", "category AS final_category", "format_string('%.2f', diff_score) AS diff_score",
        "format_string('%.2f', blur_score) AS blur_score", "format_string('%.2f', top_score) AS top_score", "'' AS feature_subtype", "'{}' AS feature_subtype_scores",
        f"{RE.literal_texts('items')} AS raw_texts", f"{RE.literal_map('category_scores')} AS category_scores", f"{RE.literal_lists(hits)} AS matched_keywords",
        "concat('(0,0,', roi_w, ',', roi_h, ')') AS roi", "concat('out/v', video_id, '/', category, '/f_', frame_idx, '.jpg') AS save_path",
        "level AS confidence_level", "format_string('%.3f', conf_score) AS confidence_score")


@query("io9_read_result_csv", with_sql("confident ocr_fx", """SELECT video_id, frame_idx, category AS final_category, top_score, round(basegame_ui_score,1)::DOUBLE AS basegame_ui, level, conf_score, (SELECT count(*) FROM ocr_fx o WHERE o.video_id = confident.video_id AND o.frame_idx = confident.frame_idx) AS n_texts, 900::INTEGER AS roi_h FROM confident"""))
def _(spark, sf):
    """Result table written as text and read back."""
    path = scratch(spark)
    RE.write_result_csv(result_rows(spark, sf), path)
    d = RE.read_results(spark, path)
    return d.selectExpr("CAST(substring(video_name, 2) AS BIGINT) AS video_id", "frame_idx", "final_category", "top_score", "round(category_scores['BasegameUI'], 1) AS basegame_ui",
                        "confidence_level AS level", "confidence_score AS conf_score", "CAST(size(raw_texts) AS BIGINT) AS n_texts", "roi[3] AS roi_h")


@query("io10_parse_literal", with_sql("frames_fx", """SELECT video_id, frame_idx, CASE WHEN frame_idx % 11 = 0 OR frame_idx % 13 = 0 THEN NULL ELSE top_score END AS help, CASE WHEN frame_idx % 11 = 0 THEN 0 ELSE 2 END::BIGINT AS n,
  CASE WHEN frame_idx % 11 = 0 THEN NULL ELSE noise_score END AS quoted FROM frames_fx"""))
def _(spark, sf):
    """Literal score maps with brackets, quotes and None in them; every eleventh text is malformed and becomes the default."""
    d = fx.scores(spark, sf).selectExpr(*KEYS, r"""CASE WHEN frame_idx % 11 = 0 THEN 'nonsense[' ELSE concat('{\'Help\': ', IF(frame_idx % 13 = 0, 'None', CAST(top_score AS STRING)), ', \'it\\\'s (x2) "None"\': ', noise_score, '}') END AS lit""")
    m = d.selectExpr(*KEYS, f"{RE.parse_literal('lit', 'map<string,double>', 'map()')} AS m")
    return m.selectExpr(*KEYS, "try_element_at(m, 'Help') AS help", "CAST(size(m) AS BIGINT) AS n", """try_element_at(m, 'it\\'s (x2) "None"') AS quoted""")


@query("io11_write_records", with_sql("frames_fx", "SELECT video_id, category, count(*) AS n, max(frame_idx) AS last_frame FROM frames_fx GROUP BY 1, 2"))
def _(spark, sf):
    """Records appended by video and category, read back."""
    path = scratch(spark)
    RE.write_records(fx.scores(spark, sf).select("video_id", "category", "frame_idx", "top_score").repartition("video_id", "category"), path)
    back = spark.read.schema("frame_idx bigint, top_score double, video_id bigint, category string").parquet(path)
    return back.groupBy("video_id", "category").agg(F.count(F.lit(1)).alias("n"), F.max("frame_idx").alias("last_frame"))


@query("io12_cache_split", """SELECT d.doc_id, l.doc_id IS NOT NULL AS cached, coalesce(l.quality, -1)::INTEGER AS quality FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(spark, sf):
    items, cache = fx.table(spark, sf, "documents").select("doc_id"), fx.table(spark, sf, "labels").select("doc_id", "quality")
    hits, misses = CA.cache_split(items, cache, ["doc_id"])
    new = CA.cache_add(cache, misses.selectExpr("doc_id", "-1 AS quality"), ["doc_id"])
    return new.join(hits.selectExpr("doc_id", "true AS hit"), "doc_id", "left").selectExpr("doc_id", "hit IS NOT NULL AS cached", "quality")


@query("io13_cache_stats", """SELECT lang, count(l.doc_id) AS hits, count(*) - count(l.doc_id) AS misses FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def _(spark, sf):
    return CA.cache_stats(fx.table(spark, sf, "documents").select("doc_id", "lang"), fx.table(spark, sf, "labels").select("doc_id"), ["doc_id"], ["lang"])


def payloads(spark, sf):
    """One correction payload per labelled document; every fifth corrects its file a second time.  File names repeat across folders."""
    return fx.table(spark, sf, "labels").join(fx.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").selectExpr(
        """to_json(named_struct('video_id', lang, 'output_dir', CASE WHEN doc_id % 2 = 0 THEN 'out' ELSE '' END, 'corrections', concat(array(named_struct('frame_idx', doc_id,
        'action', CASE WHEN toxic = 1 THEN 'exclude' WHEN quality = 0 THEN 'reclassify' ELSE 'accept' END, 'save_path', concat('out/', lang, '/', doc_id, '/f', doc_id % 50, '.jpg'),
        'original_category', lang, 'new_category', CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'junk' END)), IF(doc_id % 5 = 0, array(named_struct('frame_idx', doc_id, 'action', 'reclassify',
        'save_path', concat('out/', lang, '/', doc_id, '/f', doc_id % 50, '.jpg'), 'original_category', lang, 'new_category', 'late')), array())))) AS payload""")


cte("corr", "", """SELECT doc_id AS frame_idx, lang, seq, CASE WHEN seq = 1 THEN 'reclassify' WHEN toxic = 1 THEN 'exclude' WHEN quality = 0 THEN 'reclassify' ELSE 'accept' END AS action,
  'out/' || lang || '/' || doc_id || '/f' || (doc_id % 50) || '.jpg' AS save_path, 'f' || (doc_id % 50) AS stem,
  CASE WHEN seq = 1 THEN 'late' WHEN doc_id % 13 = 0 THEN '' ELSE 'junk' END AS new_category, CASE WHEN doc_id % 2 = 0 THEN 'out' ELSE 'session' END AS output_dir, doc_id % 7 <> 0 AS has_file
  FROM labels JOIN documents USING (doc_id) JOIN (VALUES (0::BIGINT), (1::BIGINT)) q(seq) ON seq = 0 OR doc_id % 5 = 0""")
cte("outcomes", "corr", """SELECT *, CASE WHEN action = 'accept' THEN 'ignored' WHEN NOT has_file THEN 'missing_file' WHEN seq = 1 AND frame_idx IN
  (SELECT frame_idx FROM corr WHERE seq = 0 AND has_file AND (action = 'exclude' OR action = 'reclassify' AND new_category <> '')) THEN 'missing_file'
  WHEN action = 'reclassify' AND new_category = '' THEN 'no_category' ELSE 'moved' END AS outcome FROM corr""")
# a moved file takes the first free name of its folder; out/junk/f3_1.jpg and out/junk/f4.jpg exist before
cte("moves", "outcomes", """SELECT *, CASE WHEN n = 0 THEN folder || '/' || stem || '.jpg' ELSE folder || '/' || stem || '_' || (n + CASE WHEN folder = 'out/junk' AND stem = 'f3' THEN 1 ELSE 0 END) || '.jpg' END AS new_path FROM (
  SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY frame_idx, seq) - 1 + CASE WHEN folder = 'out/junk' AND stem = 'f4' THEN 1 ELSE 0 END AS n FROM (
  SELECT *, output_dir || '/' || CASE WHEN action = 'exclude' THEN 'excluded' ELSE new_category END AS folder FROM outcomes WHERE outcome = 'moved'))""")


@query("io14_read_corrections", with_sql("corr", "SELECT frame_idx, lang AS video_id, output_dir, seq, action, save_path, new_category FROM corr"))
def _(spark, sf):
    return RV.read_corrections(payloads(spark, sf), "payload", "session").select("frame_idx", "video_id", "output_dir", "seq", "action", "save_path", "new_category")


@query("io15_write_analysis")
def _(spark, sf):
    path = scratch(spark)
    SU.write_analysis(analysis(spark, sf), path)
    return spark.read.json(path).selectExpr("video_id", "title", "size(bigwin_tiers) AS n_tiers", "size(help_text_lines) AS n_lines")


@query("io16_write_icon_metadata")
def _(spark, sf):
    """Counts and the representative list of each video's icon groups."""
    from ..operators.icons import best_of_group
    d = fx.table(spark, sf, "embeddings").selectExpr("vec_id % 3 AS video_id", "label", "vec_id", "round(CAST(embedding[0] AS DOUBLE), 9) AS score")
    g = best_of_group(d, ["video_id"], "label", "vec_id", ["score DESC"])
    finals = g.where("is_best").groupBy("video_id").agg(F.expr("array_sort(collect_list(struct(group_no, best_id, n_members)))").alias("final_icons"))
    counts = g.groupBy("video_id").agg(F.count(F.lit(1)).alias("candidate_count"))
    return counts.join(finals, "video_id").selectExpr("video_id", "candidate_count", "size(final_icons) AS final_count", "to_json(named_struct('final_icons', final_icons)) AS metadata")


@query("io17_safe_short_name", r"""SELECT page_id, CASE WHEN len(s) <= 24 THEN s ELSE rtrim(s[1:15]) || '_' || sha1(url)[1:8] END AS safe FROM (SELECT page_id, url, CASE WHEN t = '' THEN 'video' ELSE t END AS s FROM (SELECT page_id, url,
  trim(regexp_replace(regexp_replace(url, '[<>:"/\\|?*]+', '_', 'g'), '\s+', ' ', 'g'), ' .') AS t FROM pages))""")
def _(spark, sf):
    return fx.table(spark, sf, "pages").selectExpr("page_id", f"{NA.safe_short_name('url', 24)} AS safe")


@query("io18_output_path", with_sql("frames_fx", "SELECT video_id, frame_idx, 'root/v' || video_id || '/' || category || '/clip_frame_' || lpad(frame_idx::VARCHAR, greatest(6, length(frame_idx::VARCHAR))::INTEGER, '0') || '.jpg' AS path FROM frames_fx"))
def _(spark, sf):
    return fx.scores(spark, sf).selectExpr(*KEYS, f"{NA.output_path(chr(39) + 'root' + chr(39), 'concat(' + chr(39) + 'v' + chr(39) + ', video_id)', 'category', chr(39) + 'clip' + chr(39), 'frame_idx')} AS path")


# plain names of en are taken, and the first numbered name of de
@query("io19_unique_target", """SELECT doc_id, CASE WHEN n = 0 THEN b || '.jpg' ELSE b || '_' || (n + CASE WHEN lang = 'de' THEN 1 ELSE 0 END) || '.jpg' END AS unique_target FROM (SELECT doc_id, lang, b, row_number() OVER (PARTITION BY b ORDER BY doc_id) - 1 + CASE WHEN b IN (SELECT DISTINCT 'page_' || source || '_en' FROM documents) THEN 1 ELSE 0 END AS n
  FROM (SELECT doc_id, lang, 'page_' || source || '_' || lang AS b FROM documents))""")
def _(spark, sf):
    d = fx.table(spark, sf, "documents")
    rows = d.selectExpr("doc_id", "concat('page_', source, '_', lang, '.jpg') AS target")
    taken = d.selectExpr("explode(array(concat('page_', source, '_en.jpg'), concat('page_', source, '_de_1.jpg'))) AS target")
    return NA.unique_targets(rows, "target", "doc_id", taken).select("doc_id", "unique_target")


# --- archive ------------------------------------------------------------------------------------------
@query("io20_archive_plan", r"""SELECT page_id, url FROM pages WHERE NOT list_contains(list_transform(regexp_split_to_array(url, '[\\/]+'), lambda s: lower(s)), 'en') AND NOT ends_with(lower(url), 'x')""")
def _(spark, sf):
    return AR.archive_plan(fx.table(spark, sf, "pages").select("page_id", "url"), "url", ("EN",), ("x",))


cte("refs", "", r"""SELECT page_id, ref, min(pos) AS first_pos FROM (SELECT page_id, i - 1 AS pos, split_part(split_part(trim(m[i]),'#',1),'?',1) AS ref, trim(m[i]) AS raw FROM (SELECT page_id, m, unnest(range(1, len(m)+1)) AS i FROM (SELECT page_id,
  regexp_extract_all(html, '(?i)(?:src|href)\s*=\s*["'']([^"'']+)["'']', 1) AS m FROM pages))) WHERE raw <> '' AND NOT regexp_matches(raw, '(?i)^(#|data:|https?:|mailto:|javascript:|file:)') AND ref <> '' AND NOT list_contains(regexp_split_to_array(ref,'[\\/]'),'..') GROUP BY 1,2""")


@query("io21_html_asset_refs", with_sql("refs", "SELECT page_id, url_decode(ref) AS ref, CAST(first_pos AS INTEGER) AS first_pos FROM refs"))
def _(spark, sf):
    return AR.asset_refs(fx.table(spark, sf, "pages").select("page_id", "html"), "page_id", "html", keep_rooted=True)


@query("io22_bundle_assets", with_sql("refs", r"""SELECT page_id, ref, CAST(row_number() OVER (PARTITION BY page_id ORDER BY first_pos) AS INTEGER) AS asset_no, 'report_assets/' || lpad(row_number() OVER (PARTITION BY page_id ORDER BY first_pos)::VARCHAR,4,'0') || '_' || regexp_replace(string_split(ref,'/')[-1],'[\\/:*?"<>|]','_','g') AS bundled FROM refs"""))
def _(spark, sf):
    refs = AR.asset_refs(fx.table(spark, sf, "pages").select("page_id", "html"), "page_id", "html", keep_rooted=True)
    return AR.bundle_assets(refs, "page_id", exts=("",)).select("page_id", "ref", "asset_no", "bundled")


@query("io23_match_sources", """WITH w AS (SELECT p_partkey AS k, p_type AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE replace(p_name,' ',':') END AS name FROM part), v AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE replace(p_name,' ','_') END AS stem FROM part),
  d AS (SELECT w.k, v.stem FROM w JOIN v ON lower(v.stem) = lower(w.id) OR lower(v.stem) = lower(w.name))
  SELECT k, stem, FALSE AS by_cleaned FROM d UNION ALL SELECT w.k, v.stem, TRUE FROM w JOIN v ON lower(v.stem) = lower(replace(w.name,':','_')) WHERE w.k NOT IN (SELECT k FROM d)""")
def _(spark, sf):
    p = fx.table(spark, sf, "part")
    wanted = p.selectExpr("p_partkey AS k", "p_type AS id", "CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE replace(p_name, ' ', ':') END AS name")
    videos = p.selectExpr("CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE replace(p_name, ' ', '_') END AS stem").distinct()
    return AR.match_sources(videos, wanted, "k").select("k", "stem", "by_cleaned")


@query("io24_archive_manifest", r"""SELECT seen, planned, seen - planned AS skipped, '{"seen":' || seen || ',"planned":' || planned || '}' AS record FROM (SELECT count(*) AS seen, count(*) FILTER (NOT list_contains(list_transform(regexp_split_to_array(url, '[\\/]+'), lambda s: lower(s)), 'en') AND NOT ends_with(lower(url), '7')) AS planned FROM pages)""")
def _(spark, sf):
    return AR.manifest(fx.table(spark, sf, "pages").select("page_id", "url"), "url", ("en",), ("7",))


@query("io25_next_number", """SELECT p_brand, CAST(coalesce(max(CASE WHEN p_partkey % 3 = 0 THEN p_partkey END),0) + 1 AS INTEGER) AS next_no, 'symbol_manual_' || lpad((coalesce(max(CASE WHEN p_partkey % 3 = 0 THEN p_partkey END),0)+1)::VARCHAR, greatest(3, len((coalesce(max(CASE WHEN p_partkey % 3 = 0 THEN p_partkey END),0)+1)::VARCHAR))::INTEGER, '0')
  || '_' || max(p_type) || '.png' AS new_name FROM part GROUP BY 1""")
def _(spark, sf):
    d = fx.table(spark, sf, "part").selectExpr("p_brand", "p_type", "CASE WHEN p_partkey % 3 = 0 THEN concat('symbol_manual_', p_partkey, '.png') ELSE p_name END AS file_name")
    return NA.next_number(d, ["p_brand"], "file_name", "symbol_manual_", "p_type")


@query("io26_meta_upsert", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN 'FLEET' ELSE c_mktsegment END AS c_mktsegment, c_custkey % 3 = 0 OR (c_custkey % 5 = 0 AND c_mktsegment <> 'FLEET') AS changed FROM customer""")
def _(spark, sf):
    c = fx.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    patch = c.where("c_custkey % 3 = 0 OR c_custkey % 5 = 0").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE '' END AS c_name", "CASE WHEN c_custkey % 5 = 0 THEN 'FLEET' ELSE c_mktsegment END AS c_mktsegment")
    return NA.upsert_fields(c, patch, "c_custkey", ["c_name", "c_mktsegment"])


# --- review ----------------------------------------------------------------------------------------------
def review_input(spark, sf):
    d = with_confidence(fx.scores(spark, sf)).selectExpr(
        *KEYS, "category", "level", "category_scores", "concat('out/', category, '/', frame_idx) AS save_path", "concat('out/needs_review/', category, '/', frame_idx) AS queue_path")
    files = d.selectExpr("CASE WHEN frame_idx % 5 = 0 THEN queue_path WHEN frame_idx % 5 < 4 THEN save_path END AS path").where("path IS NOT NULL")
    return d, files


cte("cards", "confident", """SELECT video_id, frame_idx, category, level, CASE WHEN frame_idx % 5 = 0 THEN 'out/needs_review/' || category || '/' || frame_idx ELSE 'out/' || category || '/' || frame_idx END AS shown_path FROM confident
  WHERE level <> 'high' AND frame_idx % 5 < 4""")


@query("r1_review_cards", with_sql("cards", "SELECT * FROM cards"))
def _(spark, sf):
    return RV.review_cards(*review_input(spark, sf)).select(*KEYS, "category", "level", "shown_path")


@query("r2_review_stats", with_sql("confident", """SELECT category, count(*) FILTER (level='high') AS high, count(*) FILTER (level='medium') AS medium, count(*) FILTER (level='low') AS low, count(*) AS total, count(*) FILTER (level<>'high') AS to_review FROM confident GROUP BY 1"""))
def _(spark, sf):
    return RV.review_stats(with_confidence(fx.scores(spark, sf)))


@query("r3_queue_categories", with_sql("cards", "SELECT category, count(*) AS queued FROM cards GROUP BY 1 ORDER BY 1"))
def _(spark, sf):
    return RV.review_cards(*review_input(spark, sf)).groupBy("category").agg(F.count(F.lit(1)).alias("queued")).orderBy("category")


def image_files(spark, sf):
    files = fx.table(spark, sf, "documents").where("doc_id % 7 <> 0").selectExpr("concat('out/', lang, '/', doc_id, '/f', doc_id % 50, '.jpg') AS path")
    return files.unionAll(spark.sql("SELECT explode(array('out/junk/f3_1.jpg', 'out/junk/f4.jpg')) AS path"))


def corrections(spark, sf):
    rows = RV.read_corrections(payloads(spark, sf), "payload", "session").withColumn("turn", F.expr("frame_idx * 2 + seq"))
    return RV.checked_corrections(rows, image_files(spark, sf), "turn")


@query("r4_apply_corrections", with_sql("moves", """SELECT d.doc_id AS frame_idx, CASE WHEN o.action = 'exclude' THEN 'Excluded' WHEN o.action = 'reclassify' THEN o.new_category ELSE d.lang END AS category,
  coalesce(o.new_path, 'out/' || d.lang || '/' || d.doc_id || '/f' || (d.doc_id % 50) || '.jpg') AS save_path, o.frame_idx IS NOT NULL AS corrected FROM documents d LEFT JOIN moves o ON o.frame_idx = d.doc_id"""))
def _(spark, sf):
    records = fx.table(spark, sf, "documents").selectExpr("doc_id AS frame_idx", "lang AS category", "concat('out/', lang, '/', doc_id, '/f', doc_id % 50, '.jpg') AS save_path")
    return RV.apply_corrections(records, corrections(spark, sf), image_files(spark, sf), ["frame_idx"], "turn")


@query("r5_correction_summary", with_sql("outcomes", "SELECT count(*) FILTER (outcome='moved') AS moved, count(*) FILTER (outcome IN ('missing_file','no_category')) AS skipped, coalesce(bool_or(outcome='moved'),FALSE) AS updated FROM outcomes"))
def _(spark, sf):
    return RV.correction_summary(corrections(spark, sf))


@query("r5_correction_outcomes", with_sql("outcomes", "SELECT frame_idx, seq, outcome FROM outcomes"))
def _(spark, sf):
    return corrections(spark, sf).select("frame_idx", "seq", "outcome")


# --- summaries -------------------------------------------------------------------------------------------------
@query("a1_category_counts", with_sql("frames_fx", "SELECT v.video_id, c.category, count(f.frame_idx) AS n FROM (SELECT DISTINCT video_id FROM frames_fx) v CROSS JOIN (VALUES "
       + ",".join(f"({q(c)})" for c in SUMMARY_CATEGORIES) + ") c(category) LEFT JOIN frames_fx f ON f.video_id = v.video_id AND f.category = c.category GROUP BY 1, 2"))
def _(spark, sf):
    return SU.category_counts(fx.scores(spark, sf).select("video_id", "category"))


@query("a2_infer_title", with_sql("ocr_fx", f"""SELECT v.video_id, coalesce(t.title,'Unknown Game') AS title FROM (SELECT DISTINCT video_id FROM ocr_fx) v LEFT JOIN (SELECT video_id, text AS title FROM (SELECT video_id, text, count(*) AS n, min(rn*10+line_no) AS first_at FROM (SELECT *, dense_rank() OVER (PARTITION BY video_id ORDER BY frame_idx) AS rn FROM ocr_fx)
  WHERE rn <= 80 AND len(text) >= 3 AND ocr_score >= 0.65 AND NOT regexp_matches(text,'[0-9]') AND NOT {substr_sql(plain_sql('text'), IGNORED_TITLE_WORDS)} GROUP BY 1,2) QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY n DESC, first_at) = 1) t USING (video_id)"""))
def _(spark, sf):
    return SU.infer_title(fx.frames(spark, sf))


@query("a3_tier_list", with_sql("signals frames_fx", """SELECT video_id, frame_idx, CAST(row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS INTEGER) AS pos, tier_plain AS tier FROM signals JOIN frames_fx USING (video_id, frame_idx) WHERE category = 'BigWin' QUALIFY pos <= 12"""))
def _(spark, sf):
    return SU.tier_list(fx.frames(spark, sf))


cte("mech_text", "ocr_fx frames_fx", f"SELECT video_id, frame_idx, string_agg({plain_sql('text')},' ' ORDER BY line_no) AS t FROM ocr_fx JOIN frames_fx USING (video_id, frame_idx) WHERE category IN ('Help','Feature game') GROUP BY 1,2")


@query("a4_infer_mechanics", with_sql("mech_text", " UNION ALL ".join(f"SELECT video_id, {i}::INTEGER AS pos, {q(name)} AS mechanic FROM mech_text GROUP BY 1 HAVING bool_or({substr_sql('t', words)}" + (f" OR regexp_matches(t,{q(p)})" if p else "") + ")"
                                                                      for i, (name, words, p) in enumerate(SU.MECHANICS))))
def _(spark, sf):
    return SU.infer_mechanics(fx.frames(spark, sf))


cte("doc_lines", "", r"""SELECT source, doc_id, pos, line, trim(regexp_replace(lower(line),'[^a-z0-9]+',' ','g')) AS k FROM (SELECT source, doc_id, i - 1 AS pos, trim(regexp_replace(p[i],'\s+',' ','g')) AS line FROM (SELECT source, doc_id, p, unnest(range(1,len(p)+1)) AS i
  FROM (SELECT source, doc_id, regexp_split_to_array(text, '[\n\r]+| {2,}') AS p FROM documents)))""")
_UNIQUE = """SELECT {g}, doc_id, CAST(pos AS INTEGER) AS pos, line, CAST(row_number() OVER (PARTITION BY {g} ORDER BY doc_id, pos) AS INTEGER) AS line_no FROM (SELECT * FROM doc_lines WHERE len(k) >= 4 QUALIFY row_number() OVER (PARTITION BY {g}, k ORDER BY doc_id, pos) = 1) QUALIFY line_no <= {n}"""


@query("t11_unique_lines", with_sql("doc_lines", _UNIQUE.format(g="source", n=30)))
def _(spark, sf):
    return SU.unique_lines(fx.spread(fx.table(spark, sf, "documents").select("source", "doc_id", "text")), ["source"], "doc_id", "text", 30)


@query("a5_help_lines", with_sql("doc_lines", _UNIQUE.format(g="source", n=80)))
def _(spark, sf):
    return SU.unique_lines(fx.spread(fx.table(spark, sf, "documents").select("source", "doc_id", "text")), ["source"], "doc_id", "text", 80)


def analysis(spark, sf):
    d = fx.frames(spark, sf)
    text = d.where("category = 'Help'").selectExpr("video_id", "frame_idx", "array_join(transform(items, i -> i.text), ' ') AS text")
    return SU.build_analysis(d.select(*KEYS, "category", "items"), text)


@query("a6_build_analysis")
def _(spark, sf):
    return analysis(spark, sf).selectExpr("video_id", "title", "to_json(category_counts) AS category_counts", "array_join(bigwin_tiers, '|') AS tiers",
                                          "size(help_text_lines) AS n_lines", "array_join(mechanics, '|') AS mechanics")


_TIERS = ["Big Win", "Mega Win", "Super Win"]


@query("a7_flow_layout", with_sql("frames_fx", """SELECT video_id, node_id, label, category, row_no::INTEGER AS row_no FROM (SELECT video_id, count(*) FILTER (category='loading') AS c_load, count(*) FILTER (category='Feature Buy') AS c_buy, count(*) FILTER (category='Feature game') AS c_feat,
   count(*) FILTER (category='Other') AS c_other, count(*) FILTER (category='Transition') AS c_tr, count(*) FILTER (category='BigWin') AS c_big, count(*) FILTER (category='Result') AS c_res FROM frames_fx GROUP BY 1) f,
  LATERAL (SELECT * FROM (VALUES ('loading','Loading','loading',0,f.c_load > 0), ('basegame','Base Game','Basegame',0,TRUE), ('feature_buy','Buy Feature','Feature Buy',0,f.c_buy > 0),
   ('bigwin_1','Big Win','BigWin',0,TRUE), ('bigwin_2','Mega Win','BigWin',0,f.c_big >= 2), ('bigwin_3','Super Win','BigWin',0,f.c_big >= 3),
   ('transition','Transition','Transition',1,f.c_tr > 0 AND f.c_feat + f.c_other > 0), ('featuregame',CASE WHEN f.c_feat > 0 THEN 'Free Game' ELSE 'Feature Game' END,CASE WHEN f.c_feat > 0 THEN 'Feature game' ELSE 'Other' END,1,f.c_feat + f.c_other > 0),
   ('bigwin_fg','Big Win (FG)','BigWin',1,f.c_big > 0 AND f.c_feat + f.c_other > 0), ('result','Total Win','Result',1,f.c_res > 0 AND f.c_feat + f.c_other > 0)) n(node_id,label,category,row_no,shown) WHERE shown) x"""))
def _(spark, sf):
    return SU.flow_layout(fx.scores(spark, sf).select("video_id", "category"), _TIERS).select("video_id", "node_id", "label", "category", "row_no")


_SHOWN = {"loading": ("loading", 1), "basegame": ("Basegame", 2), "feature_buy": ("Feature Buy", 1), "transition": ("Transition", 1), "bigwin_fg": ("BigWin", 1), "result": ("Result", 1)}


@query("a8_node_images", with_sql("frames_fx", """, place AS (SELECT *, CAST(row_number() OVER (PARTITION BY video_id, category ORDER BY frame_idx) AS INTEGER) AS pos FROM frames_fx),
  has AS (SELECT video_id, bool_or(category = 'Feature game') AS game, bool_or(category IN ('Feature game', 'Other')) AS feature FROM frames_fx GROUP BY 1) """
       + " UNION ALL ".join(f"SELECT p.video_id, '{node}' AS node_id, category, frame_idx, pos AS place FROM place p JOIN has USING (video_id) WHERE category = '{c}' AND pos <= {n}"
                            + (" AND feature" if node in ("transition", "bigwin_fg", "result") else "") for node, (c, n) in _SHOWN.items())
       + " UNION ALL SELECT video_id, 'bigwin_' || pos, category, frame_idx, pos FROM place WHERE category = 'BigWin' AND pos <= 3"
       + " UNION ALL SELECT p.video_id, 'featuregame', category, frame_idx, pos FROM place p JOIN has USING (video_id) WHERE feature AND category = CASE WHEN game THEN 'Feature game' ELSE 'Other' END AND pos <= 2"))
def _(spark, sf):
    from ..sources.listing import first_n
    d = fx.scores(spark, sf).select(*KEYS, "category")
    return SU.node_images(SU.flow_layout(d, _TIERS), first_n(d, ["video_id", "category"], "frame_idx", 6))


@query("a9_motion_map", """SELECT label, CAST(cell AS INTEGER) AS cell, round(avg(abs(v - pv)),6) AS motion, round(avg(v),6) AS average FROM (SELECT label, cell, v, lag(v) OVER (PARTITION BY label, cell ORDER BY vec_id) AS pv FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS cell FROM embeddings)) GROUP BY 1,2""")
def _(spark, sf):
    m = SU.motion_map(fx.table(spark, sf, "embeddings").select("label", "vec_id", "embedding"), ["label"], "vec_id", "embedding")
    return m.selectExpr("label", "cell", r6("motion", "motion"), r6("average", "average"))


@query("a10_projection", """SELECT label, CAST(cell % 8 AS INTEGER) AS x, round(avg(v),6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS cell FROM embeddings) GROUP BY 1,2""")
def _(spark, sf):
    d = SU.projection(fx.table(spark, sf, "embeddings").select("label", "embedding"), ["label"], "embedding", 8, "x")
    return d.selectExpr("label", "x", r6("mean", "mean"))


@query("a11_profile_threshold", with_sql("hours", "SELECT event_type, round(p72,6) AS p72, peak, round(greatest(p72, peak*0.38),6)::DOUBLE AS threshold FROM (SELECT event_type, quantile_cont(m, 0.72)::DOUBLE AS p72, max(m)::DOUBLE AS peak FROM (SELECT event_type, CAST(n * ((hr * 31) % (11 + 13 * length(event_type))) AS DOUBLE) / 8 AS m FROM hours) GROUP BY 1)"))
def _(spark, sf):
    from .q_pages import hours
    # levels of a range of their own for each type
    levels = hours(spark, sf).selectExpr("event_type", "CAST(n * ((hr * 31) % (11 + 13 * length(event_type))) AS DOUBLE) / 8 AS m")
    return SU.profile_threshold(levels, ["event_type"], "m").selectExpr("event_type", r6("p72", "p72"), "peak", r6("threshold", "threshold"))


@query("a12_run_summary", with_sql("frames_fx", "SELECT video_id, count(*) AS saved, count(*) FILTER (top_score >= 6) AS kept, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(DISTINCT category) AS categories FROM frames_fx GROUP BY 1"))
def _(spark, sf):
    return SU.run_summary(fx.scores(spark, sf).selectExpr(*KEYS, "category", "top_score >= 6.0D AS keep"))
