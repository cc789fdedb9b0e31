"""Archive planning: which files go, which assets a page needs, which sources match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lit

# --- fixed values: bundled image types and skipped link kinds ----------------------
BUNDLED = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".bmp")
SKIPPED_LINK = "(?i)^(#|data:|https?:|mailto:|javascript:|file:)"


def _planned(path: str, excluded_dirs, excluded_exts) -> str:
    dirs = ", ".join(lit(d.lower()) for d in excluded_dirs) or "''"
    exts = " OR ".join(f"endswith(lower({path}), {lit(e.lower())})" for e in excluded_exts) or "false"
    return f"(NOT exists(split({path}, r'[\\\\/]+'), s -> lower(s) IN ({dirs})) AND NOT ({exts}))"


def archive_plan(df: DataFrame, path: str, excluded_dirs=(), excluded_exts=()) -> DataFrame:
    """Files without an excluded path segment (any depth, any case) or extension."""
    return df.where(_planned(path, excluded_dirs, excluded_exts))


def asset_refs(df: DataFrame, key: str, html: str, keep_rooted: bool = False) -> DataFrame:
    """Distinct local ``src``/``href`` targets of a page with the position of their first use."""
    links = df.selectExpr(key, f"""posexplode(regexp_extract_all({html}, r'(?i)(?:src|href)\\s*=\\s*["\\x27]([^"\\x27]+)["\\x27]', 1)) AS (pos, raw)""")
    kept = links.selectExpr(key, "pos", "trim(raw) AS ref").where(f"ref <> '' AND NOT ref RLIKE r'{SKIPPED_LINK}'")
    clean = kept.selectExpr(key, "pos", "replace(split_part(split_part(ref, '#', 1), '?', 1), '+', '%2B') AS ref")
    clean = clean.selectExpr(key, "pos", "coalesce(try_url_decode(ref), ref) AS ref").where("ref <> ''")
    clean = clean.where("NOT array_contains(split(ref, r'[\\\\/]'), '..')")
    if not keep_rooted:
        clean = clean.where(r"NOT ref RLIKE r'^([\\/]|[A-Za-z]:)'")
    return clean.groupBy(key, "ref").agg(F.min("pos").alias("first_pos"))


def bundle_assets(refs: DataFrame, key: str, folder: str = "report_assets", exts=BUNDLED) -> DataFrame:
    """Numbered bundle name of every asset in order of first use within its page."""
    kind = " OR ".join(f"endswith(lower(ref), {lit(e)})" for e in exts) or "true"
    numbered = refs.where(kind).selectExpr("*", f"row_number() OVER (PARTITION BY {key} ORDER BY first_pos) AS asset_no")
    name = r"regexp_replace(element_at(split(ref, '/'), -1), r'[\\/:*?\"<>|]', '_')"
    return numbered.selectExpr(key, "ref", "asset_no", f"concat('{folder}/', lpad(CAST(asset_no AS STRING), greatest(4, length(CAST(asset_no AS STRING))), '0'), '_', {name}) AS bundled")


def match_sources(videos: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Videos whose stem equals id or name in any case; only where none does, the cleaned name.

    ``videos`` has stem; ``wanted`` has key, id and name.
    """
    stems = videos.selectExpr("*", "lower(stem) AS stem_key")
    first = wanted.selectExpr(key, "explode(array_distinct(array(lower(id), lower(name)))) AS stem_key")
    direct = first.join(stems, "stem_key")
    rest = wanted.join(direct.select(key).distinct(), key, "left_anti").selectExpr(
        key, r"lower(regexp_replace(name, r'[\\/:*?\"<>|]', '_')) AS stem_key")
    return direct.withColumn("by_cleaned", F.lit(False)).unionByName(rest.join(stems, "stem_key").withColumn("by_cleaned", F.lit(True))).drop("stem_key")


def manifest(df: DataFrame, path: str, excluded_dirs=(), excluded_exts=()) -> DataFrame:
    """One record of what is planned among the files, in one pass."""
    both = df.agg(F.count(F.lit(1)).alias("seen"), F.expr(f"count_if({_planned(path, excluded_dirs, excluded_exts)})").alias("planned"))
    return both.selectExpr("seen", "planned", "seen - planned AS skipped", "to_json(named_struct('seen', seen, 'planned', planned)) AS record")
