"""Result tables with line ends in cells, read in byte ranges."""

import csv
import random

import duckdb
import oracle
from pyspark.sql import functions as F
from framelens.plans import catalog
from framelens.plans import fixtures as fx
from framelens.sources import results as RE


def write(path, rows, end):
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        csv.writer(f, lineterminator=end).writerows(rows)


def test_records_equal_the_csv_module(spark, tmp_path):
    rng = random.Random(3)
    bits = ["a", "b c", '"', '""', ",", "\n", "\n\n", "é", "'", "x" * 90]
    want = []
    for k, end in enumerate(("\n", "\r\n")):
        rows = [[str(k), str(i), "".join(rng.choices(bits, k=rng.randrange(6))) + "."] for i in range(200)]
        write(tmp_path / f"{k}.csv", [["file", "row", "quoted\nname" if k else "name"], *rows], end)
        want += rows
    write(tmp_path / "head.csv", [["file", "row", "name"]], "\n")
    (tmp_path / "none.csv").write_text("")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for ranges in ("37", "200", "5000", size):
            spark.conf.set("spark.sql.files.maxPartitionBytes", ranges)
            got = RE.csv_records(spark, str(tmp_path)).select(F.from_csv("record", "file string, row string, name string", {"quote": '"', "escape": '"'}).alias("r")).select("r.*")
            assert sorted(map(list, got.collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_cells_with_line_ends(spark, tmp_path):
    row = dict.fromkeys(RE.RESULT_COLUMNS, "")
    row |= {"video_name": "v\n1", "frame_idx": "7", "raw_texts": "[('two\nlines', 0.5)]", "save_path": 'a "b", c', "top_score": "x"}
    write(tmp_path / "r.csv", [RE.RESULT_COLUMNS, [row[c] for c in RE.RESULT_COLUMNS]], "\n")
    (got,) = RE.read_results(spark, str(tmp_path)).collect()
    assert (got.video_name, got.frame_idx, got.save_path, got.top_score) == ("v\n1", 7, 'a "b", c', None)


def test_frame_numbers_of_seven_digits_keep_all_digits(spark, tmp_path):
    spark.sql("SELECT id AS event_id, id % 50 AS user_id, 'view' AS event_type FROM VALUES (7L), (999999L), (1000000L), (1000001L), (12345678L) AS t(id)").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    out = catalog.QUERIES["io18_output_path"](spark, str(tmp_path))
    assert oracle.compare(out, con, catalog.ORACLES["io18_output_path"]) == []
    assert [r.path.rsplit("_", 1)[1] for r in out.orderBy("frame_idx").collect()] == ["000007.jpg", "999999.jpg", "1000000.jpg", "1000001.jpg", "12345678.jpg"]


def test_frames_of_one_row_group_are_dealt_evenly(spark, tmp_path):
    """A file of many splits of which one holds the only row group: no task gets all frames, and grouping frames needs no other shuffle."""
    rows = spark.range(0, 200_000, 1, 1).selectExpr("id AS event_id", "id % 50 AS user_id", "sha2(CAST(id AS STRING), 256) AS event_type")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in before:
            spark.conf.set(c, "200k")
        assert spark.read.parquet(str(tmp_path / "events.parquet")).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = fx.frames(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 60_000 and sum(r["count"] for r in sizes) == 200_000
        plan = catalog.QUERIES["v18_motion_region_score"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
