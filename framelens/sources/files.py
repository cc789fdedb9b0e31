"""File listings as DataFrames (metadata only; file contents are never read)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import lit

# --- fixed values: accepted file extensions ---------------------------------
VIDEO_EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".webm")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")


def list_files(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """path, folder, name, stem, length of the files under ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    df = files.selectExpr("path", "element_at(split(path, '/'), -2) AS folder", "element_at(split(path, '/'), -1) AS name", "length")
    return df.selectExpr("*", "regexp_replace(name, '[.][^.]*$', '') AS stem")


def _has_extension(exts) -> str:
    return "(" + " OR ".join(f"endswith(lower(name), {lit(e)})" for e in exts) + ")"


def discover_inputs(spark: SparkSession, root: str, exts=VIDEO_EXTENSIONS, only: str | None = None) -> DataFrame:
    """Input files by extension in name order, or the one named file."""
    files = list_files(spark, root)
    return files.where(f"name = {lit(only)}" if only else _has_extension(exts)).orderBy("name")


def discover_outputs(spark: SparkSession, root: str, marker: str = "classification_result.csv", video: str | None = None) -> DataFrame:
    """Folders under ``root`` that contain the marker file."""
    files = list_files(spark, root, recursive=True)
    marked = files.where(f"name = {lit(marker)}").select("folder").distinct()
    return (marked.where(f"folder = {lit(video)}") if video else marked).orderBy("folder")


def scan_category_images(spark: SparkSession, root: str, records: DataFrame, exts=IMAGE_EXTENSIONS) -> DataFrame:
    """Images with the category of their folder, joined to the records on file name."""
    images = list_files(spark, root, recursive=True).where(_has_extension(exts)).selectExpr("folder AS category", "name", "path")
    return images.join(records, "name", "left").orderBy("category", "name")
