"""Keep rules: which records represent a video in each category.

Inputs are records keyed by ``video_id`` and ``frame_idx`` with the score
columns of the fixtures and, where a rule reads text, ``sig_record_*`` columns.
Every order ends with ``frame_idx`` ascending, so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scores as V
from ..functions.text import lit
from ..functions.vectors import jaccard, visually_same
from ..session import durable
from .greedy import greedy_keep
from .windows import exact_rank, gap_groups, top_k

KEY = ["video_id", "frame_idx"]
CLUSTERS, PER_CLUSTER = 3, 3
POOL = CLUSTERS * PER_CLUSTER
# the product's own limits; callers may pass others, None for all rows
HELP_PAGES, PAYTABLE_PAGES, FALLBACK_PAGES, SPLASH_ROWS = 32, 24, 3, 3


def top_k_for(category: str) -> str:
    """Number of rows kept for a category (expression)."""
    return f"CASE {category} " + " ".join(f"WHEN {lit(c)} THEN {k}" for c, k in R.TOP_K.items()) + f" ELSE {R.TOP_K_DEFAULT} END"


def top_k_per_category(df: DataFrame, order: str = "top_score DESC, frame_idx", capped: bool = True) -> DataFrame:
    """Plain top-k by score with the category's own k; all rows, ranked, without caps."""
    if not capped:
        return top_k(df, ["video_id", "category"], order, None)
    most = max([*R.TOP_K.values(), R.TOP_K_DEFAULT])
    return top_k(df, ["video_id", "category"], order, most).where(f"rank <= {top_k_for('category')}")


def rank_struct(order: list[tuple[str, bool]]) -> str:
    """Comparable struct of numeric order keys (expression, descending?); larger is better."""
    parts = [e if desc else f"-({e})" for e, desc in order] + ["-frame_idx"]
    return "struct(" + ", ".join(f"{p} AS o{i}" for i, p in enumerate(parts)) + ")"


def best_per_event(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], group: str = "grp") -> DataFrame:
    """Frame of the best row of each event; merges partial maxima, so long events spread out."""
    return df.groupBy(*keys, group).agg(F.expr(f"max_by(frame_idx, {rank_struct(order)})").alias("frame_idx"))


def fill_to_k(df: DataFrame, winners: DataFrame, keys: list[str], order: list[tuple[str, bool]], k: int | None) -> DataFrame:
    """Event winners by rank, then the remaining rows by rank, k rows per key (None: all)."""
    marks = winners.select(*keys, "frame_idx").withColumn("is_winner", F.lit(1))
    by = ", ".join(["is_winner DESC"] + [f"{e} {'DESC' if desc else 'ASC'}" for e, desc in order] + ["frame_idx"])
    flagged = df.join(marks, [*keys, "frame_idx"], "left").fillna(0, ["is_winner"])
    return top_k(flagged, keys, by, k, "keep_rank")


# --- transition ---------------------------------------------------------------------
TRANSITION_ORDER = [("CAST(sig_record_award AS INT)", True), ("CAST(sig_record_settings AS INT)", False),
                    ("transition_keep_score", True), ("noise_score", False), ("top_score", True)]


def select_transition(df: DataFrame, gap: int = R.EVENT_GAP["Transition"], k: int | None = R.TOP_K["Transition"], written: bool = False) -> DataFrame:
    """Best row of each event, then the best remaining rows; ``written`` rows are a table already and are not written once more."""
    df = df if written else durable(df)
    events = gap_groups(df, ["video_id"], "frame_idx", gap)
    winners = best_per_event(events, ["video_id"], TRANSITION_ORDER)
    return fill_to_k(df, winners, ["video_id"], TRANSITION_ORDER, k)


# --- big win -------------------------------------------------------------------------
def bigwin_tiers(df: DataFrame) -> DataFrame:
    """Qualified rows with their tier; unlabelled rows before the first label can stand for ``big_win``."""
    rows = df.where(f"bigwin_keep_signal >= {R.BIGWIN_KEEP_MIN}D OR top_score >= 6.0D OR tier <> ''")
    labels = rows.groupBy("video_id").agg(F.expr("min(CASE WHEN tier <> '' THEN frame_idx END)").alias("first_label"),
                                          F.expr("coalesce(bool_or(tier = 'big_win'), false)").alias("has_big"))
    return rows.join(labels, "video_id").selectExpr(
        *[f"`{c}`" for c in df.columns if c != "tier"],
        "CASE WHEN tier <> '' THEN tier WHEN NOT has_big AND frame_idx < first_label AND (bigwin_keep_signal >= 4.0D OR top_score >= 6.0D) "
        "THEN 'big_win' ELSE '' END AS tier")


def select_bigwin(df: DataFrame, gap: int = R.EVENT_GAP["BigWin"], k: int | None = R.TOP_K["BigWin"], written: bool = False) -> DataFrame:
    """Best row per tier and event in tier order, then the best remaining rows."""
    # four branches read these rows; writing them once keeps the text rules from running four times
    df = df if written else durable(df)
    rows = bigwin_tiers(df).selectExpr("*", f"{V.bigwin_keep_score()} AS keep_score")
    tiered = gap_groups(rows.where("tier <> ''"), ["video_id", "tier"], "frame_idx", gap)
    picks = best_per_event(tiered, ["video_id", "tier"], [("keep_score", True), ("blur_score", True), ("noise_score", False), ("top_score", True)])
    position = "CASE tier " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(R.BIGWIN_TIERS)) + " END"
    picks = picks.selectExpr("video_id", "frame_idx", f"{position} AS tier_pos")
    by = "tier_pos IS NULL, tier_pos, CASE WHEN tier_pos IS NOT NULL THEN frame_idx END, keep_score DESC, blur_score DESC, noise_score, frame_idx"
    return top_k(rows.join(picks, KEY, "left"), ["video_id"], by, k, "keep_rank")


# --- loading -----------------------------------------------------------------------------
def select_loading(df: DataFrame, scores: str = "category_scores", hits: str = "loading_hits", k: int | None = R.TOP_K["loading"],
                   splash_rows: int | None = SPLASH_ROWS) -> DataFrame:
    """The earliest ``splash_rows`` splash rows, then the best by keep score, ``k`` in all (None: no limit)."""
    rows = df.selectExpr("*", f"{V.loading_keep_score(scores, hits)} AS keep_score", f"{V.competing_score(scores, base=False)} AS competing",
                         f"contains(lower(array_join({hits}, ' ')), 'loading_splash_visual') AS splash")
    first = top_k(rows.where("splash"), ["video_id"], "frame_idx, competing DESC, noise_score DESC", splash_rows, "splash_rank").select(*KEY, "splash_rank")
    return top_k(rows.join(first, KEY, "left"), ["video_id"], "splash_rank IS NULL, splash_rank, keep_score DESC, frame_idx", k, "keep_rank")


# --- base game and feature pools ---------------------------------------------------------------
def reject_terms() -> list[V.Term]:
    """Reasons a base-game row is unfit as a representative."""
    blocked = f"obstruction_score >= {R.OBSTRUCTION_MAX}D"
    return [
        V.Term("sig_record_feature_text", 0, "feature_running_text"),
        V.Term("sig_record_intro AND NOT sig_record_base_text", 0, "feature_intro_text"),
        V.Term("sig_record_result_text", 0, "result_text"),
        V.Term("obstruction_score >= 5.5D", 0, V.coded("board_obstructed", "obstruction_score")),
        V.Term(f"noise_score >= 4.6D AND {blocked}", 0, V.coded("noisy_overlay", "noise_score")),
        V.Term(f"exposure_score >= 3.6D AND {blocked}", 0, V.coded("overexposed_overlay", "exposure_score")),
    ]


def _pool(df: DataFrame, order: list[str], share: float) -> DataFrame:
    """Best ``share`` of each video's rows, at least nine, by exact rank."""
    ranked = exact_rank(df, ["video_id"], order, "pool_rank")
    sizes = ranked.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return ranked.join(sizes, "video_id").where(f"pool_rank <= least(n_rows, greatest({POOL}, ceil(n_rows * {share}D)))")


def _stage(df: DataFrame, counts: dict[str, str], keep: str) -> DataFrame:
    """Keep rows by a condition over the row and per-video counts of row conditions."""
    totals = df.groupBy("video_id").agg(*[F.expr(f"count_if({c})").alias(n) for n, c in counts.items()])
    return df.join(totals, "video_id").where(keep).drop(*counts)


def basegame_pool(df: DataFrame) -> DataFrame:
    """Candidates for the base-game strata: interface floor, clean and quiet rows where enough exist."""
    rows = df.selectExpr("*", f"{V.basegame_keep_score()} AS keep_score", f"size({V.reasons(reject_terms())}) = 0 AS clean")
    pool = _pool(rows, ["basegame_ui_score DESC", "keep_score DESC", "noise_score", "blur_score DESC", "top_score", "frame_idx"], 0.45)
    ui, quiet = f"basegame_ui_score >= {R.BASEGAME_UI_KEEP}D", f"noise_score < {R.NOISE_MAX}D"
    counts = {"n_clean": "clean", "n_ui": ui, "n_ui_clean": f"{ui} AND clean", "n_ui_quiet": f"{ui} AND {quiet}",
              "n_ui_clean_quiet": f"{ui} AND clean AND {quiet}"}
    fit = f"({ui} AND (clean OR n_ui_clean = 0))"
    n_fit = "CASE WHEN n_ui_clean > 0 THEN n_ui_clean ELSE n_ui END"
    n_quiet = "CASE WHEN n_ui_clean > 0 THEN n_ui_clean_quiet ELSE n_ui_quiet END"
    n_now = f"CASE WHEN {n_quiet} >= {POOL} THEN {n_quiet} ELSE {n_fit} END"
    keep = (f"CASE WHEN {n_now} < {POOL} AND n_clean > 0 THEN clean ELSE {fit} AND ({n_quiet} < {POOL} OR {quiet}) END")
    return _stage(pool, counts, keep)


def feature_pool(df: DataFrame) -> DataFrame:
    """Candidates for the feature strata; ``final`` marks rows kept outright by their counter."""
    rows = durable(df.selectExpr("*", f"{V.feature_keep_score()} AS keep_score"))
    counter = f"sig_record_spins_left AND obstruction_score < {R.OBSTRUCTION_MAX}D"
    n_counter = rows.groupBy("video_id").agg(F.expr(f"count_if({counter})").alias("n_counter"))
    rows = rows.join(n_counter, "video_id")
    decided = top_k(rows.where(f"n_counter >= {POOL} AND {counter}"), ["video_id"], "keep_score DESC, frame_idx", POOL, "pool_rank")
    by = ["counter_first DESC", "feature_active_score DESC", "feature_ui_score DESC", "keep_score DESC", "noise_score", "blur_score DESC",
          "top_score DESC", "frame_idx"]
    pool = _pool(rows.where(f"n_counter < {POOL}").withColumn("counter_first", F.col("sig_record_spins_left").cast("int")), by, 0.70)
    floor = f"(feature_ui_score >= {R.FEATURE_UI_KEEP}D OR feature_active_score >= {R.FEATURE_ACTIVE_KEEP}D)"
    quiet = f"noise_score < {R.NOISE_MAX}D"
    seen = (f"((obstruction_score < {R.OBSTRUCTION_MAX}D OR feature_active_score >= {R.FEATURE_ACTIVE_KEEP}D)"
            f" AND (sig_record_spins_left OR help_quality_score < {R.HELP_QUALITY_MIN}D))")
    counts = {"n_f": floor, "n_fq": f"{floor} AND {quiet}", "n_fv": f"{floor} AND {seen}", "n_fqv": f"{floor} AND {quiet} AND {seen}"}
    n_v = f"CASE WHEN n_fq >= {POOL} THEN n_fqv ELSE n_fv END"
    n_now = f"CASE WHEN {n_v} >= {POOL} THEN {n_v} WHEN n_fq >= {POOL} THEN n_fq ELSE n_f END"
    keep = (f"{n_now} < {POOL} OR ({floor} AND (n_fq < {POOL} OR {quiet}) AND ({n_v} < {POOL} OR {seen}))")
    rest = _stage(pool, counts, keep)
    columns = [*df.columns, "keep_score", "pool_rank"]
    return (decided.select(*columns).withColumn("final", F.lit(True))
            .unionByName(rest.select(*columns).withColumn("final", F.lit(False))))


# --- help ------------------------------------------------------------------------------------
HELP_ORDER = ["help_score DESC", "help_quality_score DESC", "blur_score DESC", "noise_score", "top_score DESC", "frame_idx"]


_WEB_RULE = "sig_record_web_chrome AND sig_plain_rule_help"


def _help_spans(grouped: DataFrame) -> DataFrame:
    """Per video the number of browser rule pages (``n_web``) and its ``best`` gap group with first and last frame and rows."""
    stats = grouped.groupBy("video_id", "grp").agg(
        F.expr("count_if(sig_plain_rule_help)").alias("n_rule"), F.avg("help_quality_score").alias("quality"), F.count(F.lit(1)).alias("n"),
        F.expr(f"count_if({_WEB_RULE})").alias("n_web"), F.min("frame_idx").alias("lo"), F.max("frame_idx").alias("hi"))
    return stats.groupBy("video_id").agg(F.sum("n_web").alias("n_web"), F.expr(
        "max_by(struct(grp, lo, hi, n), struct(n_rule, round(quality, 9), n, -grp))").alias("best"))


def help_candidates(df: DataFrame, gap: int = R.EVENT_GAP["Help"]) -> DataFrame:
    """Browser rule pages when a video has three or more; else its best gap group."""
    grouped = gap_groups(durable(df), ["video_id"], "frame_idx", gap)
    return grouped.join(_help_spans(grouped), "video_id").where(f"CASE WHEN n_web >= 3 THEN {_WEB_RULE} ELSE grp = best.grp END").drop("best")


# --- refinement -----------------------------------------------------------------------------
def rescue_by_counter(df: DataFrame) -> DataFrame:
    """Transition rows with a feature counter and no intro or result text become feature rows."""
    hit = ("category = 'Transition' AND (sig_record_strong_counter OR sig_record_counter_over_board) "
           "AND NOT sig_record_start_intro AND NOT sig_record_result_text")
    keep = [f"`{c}`" for c in df.columns if c != "top_score"]
    return df.selectExpr(*keep, f"CASE WHEN {hit} THEN 'Feature game' ELSE category END AS category_refined",
                         f"CASE WHEN {hit} THEN greatest(top_score, 10.0D) ELSE top_score END AS top_score")


def reassign(path: str, category: str, new_category: str) -> str:
    """Path under the folder of the new category; unchanged when the category stays."""
    return (f"CASE WHEN {category} = {new_category} THEN {path} ELSE "
            f"regexp_replace({path}, '^(.*)/[^/]+/([^/]+)$', concat('$1/', {new_category}, '/$2')) END")


def anti_keep(df: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows that were not kept."""
    return df.join(kept.select(*KEY), KEY, "left_anti")


def select_help(df: DataFrame, gap: int = R.EVENT_GAP["Help"], pages: int | None = HELP_PAGES, paytable_pages: int | None = PAYTABLE_PAGES,
                fallback_pages: int | None = FALLBACK_PAGES, written: bool = False) -> DataFrame:
    """Help pages per video: rule pages, up to ``paytable_pages`` paytable pages, else up to ``fallback_pages`` fallback pages.

    At most ``pages`` pages in all; None lifts a limit.  A page that repeats a kept one (token sets alike at
    0.985, or gray and histogram arrays of equal sizes that look the same) is passed over; rows without the
    columns ``help_gray`` and ``help_hist``, or with null or empty arrays, are compared by tokens alone.  The stages are one greedy walk each; a later stage
    starts with the pages kept before it.
    """
    def most(limit: int | None, n: str) -> str:
        return n if limit is None else f"least({limit}, {n})"

    # the gap groups are runs of frames: they are found on keys and flags, and a page's tokens move only if it is a candidate
    rows = df if written else durable(df)
    spans = _help_spans(gap_groups(rows.select(*KEY, "help_quality_score", "sig_plain_rule_help", "sig_record_web_chrome"), ["video_id"], "frame_idx", gap))
    spans = durable(spans.selectExpr("video_id AS span_video_", "n_web", "best.lo AS lo_", "best.hi AS hi_", "CASE WHEN n_web >= 3 THEN n_web ELSE best.n END AS n_rows"))
    rows = rows.join(spans, F.expr("video_id = span_video_")).where(f"CASE WHEN n_web >= 3 THEN {_WEB_RULE} ELSE frame_idx BETWEEN lo_ AND hi_ END")
    rows = durable(rows.drop("span_video_", "lo_", "hi_")).withColumn("k_", F.expr(f"CAST({most(pages, 'n_rows')} AS INT)"))
    looks = {"help_gray", "help_hist"} <= set(df.columns)
    payload = ["help_tokens", *["help_gray", "help_hist"] * looks]

    def alike(a: str, b: str) -> str:
        tokens = f"{jaccard(f'{a}.help_tokens', f'{b}.help_tokens')} >= 0.985D"
        if not looks:
            return f"coalesce({tokens}, false)"
        there = " AND ".join(f"coalesce(size({a}.{c}), 0) > 0 AND size({a}.{c}) = size({b}.{c})" for c in payload[1:])
        seen = visually_same(f"{a}.help_gray", f"{b}.help_gray", f"{a}.help_hist", f"{b}.help_hist")
        return f"(coalesce({tokens}, false) OR coalesce({there} AND {seen}, false))"
    same = alike("r", "k")

    def walk(part: DataFrame, order: list[str], limit: str) -> DataFrame:
        return greedy_keep(part, ["video_id"], "frame_idx", order, payload, same, limit=limit, batch=128)

    rule = durable(walk(rows.where("sig_plain_rule_help"), HELP_ORDER, "k_"))
    n_rule = rule.groupBy("video_id").agg(F.count(F.lit(1)).cast("int").alias("n_rule_"))
    kept = rule.join(rows.select(*KEY, *payload), KEY).groupBy("video_id").agg(F.collect_list(F.struct(*payload)).alias("seen_"))
    # pages that no later stage can take are not compared
    table, none = "(help_paytable_score >= 2.0D AND help_quality_score >= 2.5D AND k_ > n_rule_)", "(n_rule_ = 0 AND help_quality_score >= 2.5D)"
    own = f"named_struct({', '.join(f'{c!r}, {c}' for c in payload)})"
    later = rows.join(n_rule, "video_id", "left").fillna(0, ["n_rule_"]).where(f"{table} OR {none}").join(kept, "video_id", "left")
    later = (later.join(rule.select(*KEY), KEY, "left_anti").withColumn("own_", F.expr(own))
             .where(f"seen_ IS NULL OR NOT exists(seen_, s -> {alike('own_', 's')})").drop("own_"))
    later = durable(later)
    table_order = ["help_paytable_score DESC", *HELP_ORDER[:2], "frame_idx"]
    pay = durable(walk(later.where(table), table_order, most(paytable_pages, "k_ - n_rule_")))
    none = later.where(none).join(pay.select("video_id").distinct(), "video_id", "left_anti")
    rest = walk(none, HELP_ORDER, most(fallback_pages, "k_"))
    staged = [rule.withColumn("stage", F.lit("rule")), pay.join(n_rule, "video_id", "left").fillna(0, ["n_rule_"]).withColumn(
        "keep_rank", F.col("keep_rank") + F.col("n_rule_")).drop("n_rule_").withColumn("stage", F.lit("paytable")), rest.withColumn("stage", F.lit("fallback"))]
    return staged[0].unionByName(staged[1]).unionByName(staged[2])

