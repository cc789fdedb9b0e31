"""Session helpers: defaults for a run and the durable cut of a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "framelens", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings every job here relies on (UTC, AQE, skew join)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # larger generated methods are not compiled to machine code; beyond this size
        # Spark evaluates operator by operator with small compiled methods instead
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder the cluster names.

    The cluster sets ``spark.checkpoint.dir``.  Only a local master without
    that setting gets a scratch folder; anywhere else a missing setting is an
    error, because a machine-local folder is lost with its executor.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(shared)
        return
    if sc.getCheckpointDir():
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def durable(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and continue from it.

    The written table cuts the lineage, survives lost executors, is read column
    by column, and gives the optimiser real sizes for its join choices.  With ``by``, a
    string column of few values, a filter on it reads the files of the asked values alone.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of its own file system; a failing file system raises."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
