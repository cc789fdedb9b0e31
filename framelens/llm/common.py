"""Helpers shared by the operators: tables, lineage cuts that can be freed, global ranks, components."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
FILE_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``ids(doc_id)``, whatever their other columns are called; rows without doc_id stay."""
    return docs.join(ids.select("doc_id"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def give_back() -> None:
    """Return to the system what Arrow, numpy and Python objects of this process have freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def tidy(run):
    """``run`` over batches; what is freed goes back after each batch, or a Python worker keeps it through later stages, beside the executor's heap."""
    def tidied(batches):
        def given():
            for b in batches:
                yield b
                del b
                give_back()
        yield from run(given())
        give_back()
    return tidied


class Scratch:
    """Tables in the folder of ``spark.checkpoint.dir``; ``free`` removes those no later step reads."""

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.paths = spark, {}

    def path(self, kind: str = "table") -> str:
        return f"{self.spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """Write ``df`` and continue from the written table; with a bound on its narrow rows, in as few files as they need."""
        path = self.path()
        (df if rows is None else df.coalesce(rows // FILE_ROWS + 1)).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def free(self, *tables: DataFrame) -> None:
        for df in tables:
            _, path = self.paths.pop(id(df))
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def range_parts(df: DataFrame, order: list[str], scratch: Scratch, rows: int) -> DataFrame:
    """``df`` cut into ranges of ``order``; ``part_`` numbers the ranges in that order and is fixed by the written table."""
    return scratch.keep(df.repartitionByRange(*[F.expr(o).asc_nulls_last() for o in order]).withColumn("part_", F.spark_partition_id()), rows)


def order_sql(order: list[str]) -> str:
    return ", ".join(f"{o} NULLS LAST" for o in order)


def global_rank(df: DataFrame, order: list[str], scratch: Scratch, rows: int, out: str = "rank") -> DataFrame:
    """Zero-based rank over the whole table (nulls last), without a window over all of it."""
    parts = range_parts(df, order, scratch, rows)
    offsets = parts.groupBy("part_").count().selectExpr(
        "part_", "coalesce(sum(count) OVER (ORDER BY part_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base_")
    local = parts.selectExpr("*", f"row_number() OVER (PARTITION BY part_ ORDER BY {order_sql(order)}) - 1 AS local_")
    return local.join(offsets, "part_").withColumn(out, F.expr("base_ + local_")).drop("part_", "base_", "local_")


def components(edges: DataFrame, scratch: Scratch, nodes: int) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the smallest node its links reach.

    ``nodes`` is the number of nodes there are at most.  Large-star and small-star
    steps in turn: every step re-links nodes to the smallest neighbour.  A step is
    one pre-aggregated minimum per node and one join, so a node of any degree is
    no single group anywhere.
    """
    def state(df):
        return df.selectExpr("count(*)", "coalesce(bit_xor(xxhash64(hi, lo)), 0)").first()

    star = scratch.keep(edges.where("a <> b").selectExpr("greatest(a, b) AS hi", "least(a, b) AS lo").distinct(), nodes)
    now = state(star)
    while True:
        # large star: every larger neighbour of a node links to the node's smallest neighbour
        both = star.selectExpr("hi AS u", "lo AS v").unionAll(star.selectExpr("lo AS u", "hi AS v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = scratch.keep(both.where("v > u").join(least, "u").selectExpr("v AS hi", "m AS lo").where("hi <> lo").distinct(), now[0])
        # small star: a node and its smaller neighbours link to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        linked = large.join(low, "hi")
        small = scratch.keep(linked.selectExpr("lo AS hi", "m AS lo").unionAll(low.selectExpr("hi", "m AS lo")).where("hi <> lo").distinct(), now[0])
        before, now = now, state(small)
        scratch.free(star, large)
        star = small
        if before == now:
            break
    roots = star.select("lo").distinct()
    return star.selectExpr("hi AS node", "lo AS root").unionAll(roots.selectExpr("lo AS node", "lo AS root"))
