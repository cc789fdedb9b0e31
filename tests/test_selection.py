"""Invariants of the composed selection and of classified records."""

from framelens.functions import rules as R
from framelens.plans import catalog


def test_records_are_graded(spark, sf):
    df = catalog.QUERIES["c9_score_records"](spark, sf)
    seen = df.selectExpr("count_if(confidence_score < 0 OR confidence_score > 1) AS outside", "count_if(in_review <> (confidence_level <> 'high')) AS unlike",
                         "collect_set(category) AS categories").first()
    assert seen.outside == 0 and seen.unlike == 0 and set(seen.categories) <= set(R.CATEGORIES)


def test_kept_and_rest_cover_the_input_once(spark, sf):
    df = catalog.QUERIES["k28_keep_records"](spark, sf).cache()
    total = spark.read.parquet(f"{sf}/events.parquet").count()
    assert df.count() == total == df.select("video_id", "frame_idx").distinct().count()
    limits = {**R.TOP_K, "Help": 32, "Basegame": 9, "Feature game": 9, "Other": R.TOP_K_DEFAULT}
    for r in df.where("keep").groupBy("video_id", "category").count().collect():
        assert r["count"] <= limits[r.category]
    df.unpersist()


def test_help_selection_never_keeps_two_alike(spark, sf):
    from framelens.plans.q_select import help_rows
    kept = catalog.QUERIES["k13_select_help"](spark, sf).join(help_rows(spark, sf).select("video_id", "frame_idx", "help_tokens"), ["video_id", "frame_idx"])
    by_video = {}
    for r in kept.collect():
        by_video.setdefault(r.video_id, []).append(set(r.help_tokens))
    for sets in by_video.values():
        assert len(sets) <= 32
        for i, a in enumerate(sets):
            assert all(not (a and b and len(a & b) / len(a | b) >= 0.985) for b in sets[:i])


def test_stream_sessions_are_batch_sessions(spark, sf):
    batch = {(r.event_type, r.first_id): r.n for r in catalog.QUERIES["st2_event_groups"](spark, sf).collect()}
    stream = {(r.event_type, r.first_id): r.n for r in catalog.QUERIES["st2_stream_event_groups"](spark, sf).collect()}
    assert stream == batch  # those still open at the end come from the state


def test_stream_runs_close_by_timer_and_survive_a_restart(spark, tmp_path):
    """Events in files out of order within the delay, over two runs of the query: closed runs as written, open ones from the state."""
    import random

    from framelens.streaming import jobs as ST
    rnd = random.Random(4)
    times = sorted({rnd.randrange(0, 400_000) for _ in range(900)})
    rows = [(i, "ab"[i % 2], t) for i, t in enumerate(times)]
    table = lambda part: spark.createDataFrame(part, "event_id long, kind string, sec long").selectExpr("event_id", "kind", "timestamp_seconds(sec) AS ts")
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def run(part):
        for k in range(0, len(part), 150):
            near = part[k:k + 150]
            rnd.shuffle(near)
            table(near).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("event_id long, kind string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        ST.stream_append_results(ST.stream_event_groups(stream, "kind", "ts", 900_000_000, "2 hours"), out, check).awaitTermination()

    run(rows[:450])
    run(rows[450:])
    closed = spark.read.schema("kind string, start timestamp, n bigint, first_id bigint").parquet(f"{out}/batch=*")
    left = ST.open_event_groups(spark, check, "kind")
    assert closed.count() and left.count()
    want = sorted(map(str, ST.event_groups(table(rows), "kind", "ts", 900_000_000).select("kind", "start", "n", "first_id").collect()))
    assert sorted(map(str, closed.unionByName(left).collect())) == want


def test_checkpoint_folder_comes_from_the_session(spark):
    from framelens.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir()


def test_limits_can_be_lifted(spark, sf):
    from framelens.operators import pages as P
    from framelens.operators import select as SE
    from framelens.operators import summary as SU
    from framelens.plans import fixtures as fx
    d = fx.scores(spark, sf).selectExpr("*", "false AS sig_record_award", "false AS sig_record_settings", "0.0D AS transition_keep_score").where("category = 'Transition'")
    assert SE.select_transition(d, 50, k=None).count() == d.count() > SE.select_transition(d, 50).count()
    assert SE.top_k_per_category(d, capped=False).count() == d.count()
    e = fx.table(spark, sf, "events").selectExpr("event_id % 2 AS vid", "event_id % 7 AS page", "event_id")
    assert P.round_robin(e, ["vid"], "page", "event_id", None).count() == e.count() > P.round_robin(e, ["vid"], "page", "event_id", 40).count()
    frames = fx.frames(spark, sf)
    assert SU.tier_list(frames, None).count() == frames.where("category = 'BigWin'").count()


def test_help_pages_that_look_alike_are_passed_over(spark):
    from framelens.operators import select as SE
    gray, other = [0.1 * k for k in range(16)], [1.6 - 0.1 * k for k in range(16)]
    # frame, rule page, paytable score, gray, histogram: no page has tokens
    rows = [(1, True, 0.0, gray, gray), (2, True, 0.0, [v + 0.001 for v in gray], gray), (3, True, 0.0, other, other), (4, True, 0.0, None, None), (5, True, 0.0, None, None),
            (6, True, 0.0, gray, other), (7, False, 3.0, gray, gray), (8, False, 3.0, [2 * v for v in gray], gray)]
    df = spark.createDataFrame(rows, "frame_idx long, sig_plain_rule_help boolean, help_paytable_score double, help_gray array<double>, help_hist array<double>").selectExpr(
        "1L AS video_id", "*", "false AS sig_record_web_chrome", "1.0D AS help_score", "3.0D AS help_quality_score", "1.0D AS blur_score", "1.0D AS noise_score", "1.0D AS top_score",
        "CAST(array() AS array<string>) AS help_tokens")
    got = {r.frame_idx: r.stage for r in SE.select_help(df, 40).collect()}
    assert got == {1: "rule", 3: "rule", 4: "rule", 5: "rule", 6: "rule", 8: "paytable"}
    plain = {r.frame_idx for r in SE.select_help(df.drop("help_gray", "help_hist"), 40).collect()}
    assert plain == set(range(1, 9))


def test_texts_are_judged_once_each_with_equal_records(spark, sf):
    """Frames that share their texts get the facts of the distinct texts; records equal those made frame by frame."""
    from pyspark.sql import functions as F

    from framelens.functions import rules as R
    from framelens.operators import classify as K
    from framelens.plans import fixtures as fx
    from framelens.plans.records import score_records
    frames = fx.frames(spark, sf).where("frame_idx < 300").drop(*[c for c in fx.SCORES if c != "blur_score"])
    odd = frames.where("frame_idx < 3").withColumn("frame_idx", F.expr("frame_idx + 1000"))
    kind = frames.schema["items"].dataType.simpleString()
    odd = odd.withColumn("items", F.expr(f"CASE frame_idx WHEN 1000 THEN CAST(NULL AS {kind}) WHEN 1001 THEN CAST(array() AS {kind}) "
                                         f"ELSE CAST(transform(items, i -> named_struct('line_no', i.line_no, 'text', CAST(NULL AS string), 'x1', i.x1, 'y1', i.y1, 'x2', i.x2, 'y2', i.y2, 'score', i.score)) AS {kind}) END"))
    frames = frames.unionByName(odd)
    twice = frames.unionByName(frames.withColumn("frame_idx", F.expr("frame_idx + 10000")))
    columns = ["video_id", "frame_idx", "category", "top_score", "basegame_ui_score", "feature_ui_score", "feature_active_score", "feature_board_score", "bigwin_keep_signal",
               "help_quality_score", "help_paytable_score", "transition_keep_score", "CASE WHEN category = 'loading' THEN sort_array(map_entries(category_scores)) END AS scores",
               "CASE WHEN category = 'loading' THEN matched_keywords['loading'] END AS reasons", "record_lines", "page_lines"]
    assert K.with_shared_text(twice)[1]
    lone = twice.withColumn("items", F.expr("transform(items, i -> named_struct('line_no', i.line_no, 'text', concat(i.text, ' q', frame_idx), 'x1', i.x1, 'y1', i.y1, 'x2', i.x2, 'y2', i.y2, 'score', i.score))"))
    lone = lone.where("size(items) > 0 AND frame_idx % 1000 <> 2")
    assert K.with_shared_text(lone)[1] == {}
    rows = lambda df, **o: [tuple(r) for r in score_records(df, **o).selectExpr(*columns).orderBy("frame_idx").collect()]
    plain = rows(twice)
    assert len(plain) == 606 and rows(twice, reasons_of=["loading"], share_text=True) == plain
    assert rows(lone, reasons_of=["loading"], share_text=True) == rows(lone)
    assert {r[2] for r in plain} <= set(R.CATEGORIES)


def test_refinement_reads_the_rows_that_can_move_alone(spark, sf, monkeypatch):
    from framelens.plans import records as RC
    seen, refine = [], RC.refine

    def watched(rows, bottom=None):
        seen.extend(r.category for r in rows.select("category").distinct().collect())
        return refine(rows, bottom)
    monkeypatch.setattr(RC, "refine", watched)
    df = catalog.QUERIES["k28_keep_records"](spark, sf)
    assert set(seen) <= {"Basegame", "Feature game", "Transition"}
    assert {r.category for r in df.select("category").distinct().collect()} >= {"Help", "BigWin", "Other"}


def test_help_candidates_are_browser_pages_or_the_best_run(spark):
    from framelens.operators import select as SE
    # video 1: three browser rule pages far apart and a longer run; video 2: two browser pages, the run from 100 on has more rule pages
    rows = [(1, 10, True, True), (1, 500, True, True), (1, 900, True, True), (1, 905, False, True), (1, 910, False, True),
            (2, 10, True, True), (2, 100, False, True), (2, 130, True, True), (2, 160, False, True), (2, 400, False, False)]
    df = spark.createDataFrame(rows, "video_id long, frame_idx long, sig_record_web_chrome boolean, sig_plain_rule_help boolean").selectExpr(
        "*", "array(concat('page', frame_idx), concat('v', video_id, 'xx', frame_idx)) AS help_tokens", "1.0D AS help_score", "3.0D AS help_quality_score",
        "0.0D AS help_paytable_score", "1.0D AS blur_score", "1.0D AS noise_score", "1.0D AS top_score")
    want = {(1, 10), (1, 500), (1, 900), (2, 100), (2, 130), (2, 160)}
    assert {(r.video_id, r.frame_idx) for r in SE.help_candidates(df, 40).collect()} == want
    assert {(r.video_id, r.frame_idx) for r in SE.select_help(df, 40).collect()} == want
