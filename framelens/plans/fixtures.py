"""Frame tables derived from the supplied ``events`` table.

Every column is row-wise arithmetic on ``event_id`` and ``user_id``, so the
derived tables grow with the source and need no shuffle.  The expression texts
are valid in Spark SQL and in DuckDB and are shared by queries and oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROI_W, ROI_H = 400, 900

# 37 phrases; a frame's lines step through them by seven, so pairs that a rule needs together stand seven apart
OCR_TEXTS = ["PAYTABLE", "Remaining Free Spins 8", "MEGAWIN", "TOTAL WIN", "12,500.00", "Tap to Start", "PG Soft", "Transaction ID",
             "Loading resource", "Buy Feature", "Sensational", "free spins left 7", "AUTO", "featuring wild", "Transaction ACCEPT", "Turbo",
             "Current Cost 200", "Wild Symbol", "Scatter symbol pays 3 - 50 4 - 100 5 - 200 6 - 300", "Congratulations", "You have won 10 free spins", "free spins 7", "Balance 1000.00", "COLLECT",
             "jackpot grand 5000 major 200", "https www game com", "wild symbol substitutes for all but scatter 5", "win 25", "Super Mega Win", "multiplier x25 of bonus rules", "nice 40", "search all pages of the game in chrome",
             "entertain beyond boundaries", "symbol payout values 1 - 25 2 - 50 3 - 75", "20 paylines full 5 full 8", "wild symbol pays 5 - 10 6 - 20 7 - 30", "huge win"]
# lines per frame: few, the usual six, and enough for the rules about pages
LINES = "CASE frame_idx % 10 WHEN 0 THEN 24 WHEN 1 THEN 9 WHEN 2 THEN 1 ELSE 6 END"

CATEGORY = """CASE event_type WHEN 'view' THEN 'Basegame'
  WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'Feature game' ELSE 'Help' END
  WHEN 'purchase' THEN 'BigWin'
  WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'Transition' ELSE 'Result' END
  ELSE CASE WHEN event_id % 3 = 0 THEN 'loading' WHEN event_id % 3 = 1 THEN 'Other' ELSE 'Feature Buy' END END"""


def ramp(mult: int, mod: int, div: int = 10) -> str:
    return f"CAST((event_id * {mult}) % {mod} AS DOUBLE) / {div}"


SCORES = {
    "top_score": ramp(31, 240), "basegame_ui_score": ramp(17, 80), "feature_ui_score": ramp(19, 90),
    "feature_active_score": ramp(23, 160), "bigwin_keep_signal": ramp(29, 150),
    "help_quality_score": ramp(37, 120), "help_paytable_score": ramp(41, 7, 2),
    "noise_score": ramp(43, 60), "obstruction_score": ramp(47, 90),
    "blur_score": "CAST((event_id * 53) % 2000 AS DOUBLE)", "diff_score": ramp(59, 400),
}

METRICS = {
    "edge_ratio": ramp(43, 60, 400), "dark_ratio": ramp(17, 80, 100), "bright_ratio": ramp(19, 90, 120),
    "flare_ratio": ramp(47, 90, 100), "lap_var": "CAST((event_id * 53) % 2000 AS DOUBLE)",
    "dark_plain_ratio": ramp(61, 100, 100), "very_bright_ratio": ramp(67, 60, 100),
    "neon_ratio": ramp(71, 70, 100), "largest_ratio": ramp(73, 50, 100),
    "saturated_ratio": ramp(79, 80, 100), "yellow_green_ratio": ramp(83, 50, 100),
    "mixed_ratio": ramp(89, 70, 100), "contrast": ramp(97, 90, 1), "colour_ratio": ramp(101, 60, 100),
    "central_ratio": ramp(103, 40, 100), "plain_ratio": ramp(107, 100, 100), "logo_ratio": ramp(109, 50, 100),
    "gold_ratio": ramp(113, 40, 1000), "centre_dark_ratio": ramp(127, 30, 100),
    "panel_dark_ratio": ramp(131, 100, 100), "bottom_dark_ratio": ramp(137, 100, 100),
    "button_ratio": ramp(139, 50, 1000), "yellow_ratio": ramp(149, 40, 1000),
    "circle_count": "event_id % 4", "component_count": "event_id % 11", "center_blocks": "event_id % 3",
    "spin_blocks": "event_id % 5", "vertical_lines": "event_id % 6", "horizontal_lines": "event_id % 4",
    "wide_components": "event_id % 3", "gold_blocks": "(event_id * 7) % 4", "wide_blocks": "(event_id * 3) % 5",
    "paragraph_rows": "(event_id * 11) % 140", "bar_flag": "event_id % 7 = 0",
}

# measured columns of icon crops: one crop per event, pages of 20 crops
ICONS = {
    "icon_w": "20 + (event_id * 7) % 200", "icon_h": "20 + (event_id * 11) % 200",
    "content_ratio": ramp(13, 100, 100), "edge_touches": "event_id % 5", "components": "event_id % 12",
    "bbox_fill": ramp(19, 100, 100), "sharpness": "CAST((event_id * 53) % 900 AS DOUBLE)",
    "bbox_x": "(event_id * 3) % 60", "bbox_y": "(event_id * 5) % 60",
    "bbox_w": "10 + (event_id * 7) % 180", "bbox_h": "10 + (event_id * 13) % 180",
    "yellow_fill": ramp(17, 90, 1000), "white_fill": ramp(23, 50, 1000), "red_fill": ramp(29, 130, 1000),
    "fg_ratio": ramp(31, 100, 100), "colourful_ratio": ramp(37, 40, 100), "text_ratio": ramp(41, 30, 100),
    "white_ratio": ramp(43, 25, 100), "yellow_text_ratio": ramp(47, 60, 1000), "art_ratio": ramp(59, 100, 1000),
    "very_bright": ramp(61, 100, 1000), "colour_spread": ramp(67, 60, 1), "edge_density": ramp(71, 60, 100),
    "white_tile_ratio": ramp(73, 50, 100), "upper_art": ramp(79, 120, 1000), "lower_text": ramp(83, 90, 1000),
    "x_margin": "(event_id * 3) % 20", "y_margin": "(event_id * 7) % 20",
    "source_w": "400 + (event_id * 17) % 900", "source_h": "500 + (event_id * 19) % 700",
    "crop_kind": """CASE event_id % 5 WHEN 0 THEN 'legacy_full_page' WHEN 1 THEN 'portrait_paytable_card'
      WHEN 2 THEN 'portrait_stacked_logo' WHEN 3 THEN 'mahjong_tile' ELSE 'standard' END""",
    "is_secondary": "event_id % 3 = 0", "box_x": "(event_id * 8) % 600", "box_y": "200 + (event_id * 3) % 40",
    "box_w": "140 + event_id % 40", "box_h": "90 + event_id % 50", "crop_top": "event_id % 9",
    "page_no": "CAST(floor(event_id / 20) AS BIGINT)",
}

_KEYS = {"video_id": "user_id % 15", "frame_idx": "event_id"}


def select_sql(*groups: dict[str, str]) -> str:
    cols = {**_KEYS, "category": CATEGORY}
    for g in groups:
        cols.update(g)
    return "SELECT " + ",\n ".join(f"{e} AS {n}" for n, e in cols.items()) + " FROM events"


FRAMES_SQL = select_sql(SCORES)
METRICS_SQL = select_sql(METRICS)
ICONS_SQL = select_sql(ICONS)
OCR_SQL = (
    "SELECT f.video_id, f.frame_idx, o.line_no, p.txt AS text,"
    " CAST((f.frame_idx * 13 + o.line_no * 29) % 100 AS DOUBLE) / 100 AS ocr_score,"
    " CAST((f.frame_idx * 37 + o.line_no * 11) % 300 AS DOUBLE) AS x1,"
    " CAST((f.frame_idx * 53 + o.line_no * 97) % 800 AS DOUBLE) AS y1,"
    " CAST((f.frame_idx * 37 + o.line_no * 11) % 300 + 40 + (f.frame_idx * 7 + o.line_no) % 160 AS DOUBLE) AS x2,"
    " CAST((f.frame_idx * 53 + o.line_no * 97) % 800 + 14 + (f.frame_idx * 5 + o.line_no) % 60 AS DOUBLE) AS y2"
    " FROM (SELECT user_id % 15 AS video_id, event_id AS frame_idx FROM events) f"
    " JOIN (VALUES " + ",".join(f"({n})" for n in range(24)) + f") AS o(line_no) ON o.line_no < {LINES}"
    " JOIN (VALUES " + ",".join(f"({k},'{t}')" for k, t in enumerate(OCR_TEXTS)) + ") AS p(k, txt)"
    " ON p.k = (f.frame_idx * 3 + o.line_no * 7 + f.video_id) % 37")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the scan yields fewer splits than there are.

    Text rules cost far more than moving the rows.  A table of many splits, the
    case on a cluster, passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame, by: str, rows: int = 50_000) -> DataFrame:
    """Deal a narrow table by its unique column ``by`` into tasks of about ``rows`` rows, at least one for each core.

    The number of splits of a scan says nothing about its tasks: a split without
    the start of a row group reads no row.  So the rows are counted, which reads footers only.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), by)


_ITEM = """named_struct('line_no', n,
  'text', array({texts})[CAST((frame_idx * 3 + n * 7 + video_id) % 37 AS INT)],
  'x1', CAST((frame_idx * 37 + n * 11) % 300 AS DOUBLE), 'y1', CAST((frame_idx * 53 + n * 97) % 800 AS DOUBLE),
  'x2', CAST((frame_idx * 37 + n * 11) % 300 + 40 + (frame_idx * 7 + n) % 160 AS DOUBLE),
  'y2', CAST((frame_idx * 53 + n * 97) % 800 + 14 + (frame_idx * 5 + n) % 60 AS DOUBLE),
  'score', CAST((frame_idx * 13 + n * 29) % 100 AS DOUBLE) / 100)""".replace("{texts}", ", ".join(f"'{t}'" for t in OCR_TEXTS))


def frames(spark: SparkSession, sf_dir: str, parallel: bool = True) -> DataFrame:
    """Frames with keys, category, scores, measured metrics, ROI size and text items.

    Unused columns are pruned by the optimiser before they are computed.
    """
    cols = {**_KEYS, "category": CATEGORY, **SCORES, **METRICS, "roi_w": ROI_W, "roi_h": ROI_H}
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    df = (dealt(events, "event_id") if parallel else events).selectExpr(*[f"{e} AS {n}" for n, e in cols.items()])
    return df.selectExpr("*", f"transform(sequence(0, {LINES} - 1), n -> {_ITEM}) AS items")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames without their text items."""
    return frames(spark, sf_dir, parallel=False).drop("items")


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of the text items: one row per line."""
    return frames(spark, sf_dir).selectExpr("video_id", "frame_idx", "inline(items)").withColumnRenamed("score", "ocr_score")


def icons(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {**_KEYS, **ICONS}
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in cols.items()])
