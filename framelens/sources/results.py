"""Classification result table: reading the text form and writing records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: column order of the result table ---------------------------
RESULT_COLUMNS = ["video_name", "frame_idx", "final_category", "diff_score", "blur_score", "top_score",
                  "feature_subtype", "feature_subtype_scores", "raw_texts", "category_scores",
                  "matched_keywords", "roi", "save_path", "confidence_level", "confidence_score"]


def _json_text(e: str) -> str:
    """Python literal text as JSON text: brackets, None, True and False change outside quotes only; null for unbalanced quotes."""
    single, double = r"'(?:[^'\\]|\\.)*'", r'"(?:[^"\\]|\\.)*"'
    token = f"{single}|{double}|[^'\"]+".replace("'", "\\x27").replace('"', "\\x22")
    tokens = f"regexp_extract_all({e}, r'{token}', 0)"
    body = "substring(t, 2, length(t) - 2)"
    quoted = f"concat('\"', replace(replace({body}, r'\\\x27', '\\''), '\"', r'\\\"'), '\"')"
    # an escaped quote of either kind: \' has no escape in JSON, \" keeps its own
    quoted = ("concat(chr(34), regexp_replace(replace(" + body + ", concat(chr(92), chr(39)), chr(39)), r'(?<!\\\\)\x22', concat(repeat(chr(92), 3), chr(34))), chr(34))")
    plain = "translate(t, '()', '[]')"
    for word, json_word in (("None", "null"), ("True", "true"), ("False", "false")):
        plain = f"regexp_replace({plain}, r'\\b{word}\\b', '{json_word}')"
    plain = f"regexp_replace({plain}, r',\\s*\\]', ']')"
    turned = f"transform({tokens}, t -> CASE WHEN startswith(t, chr(39)) THEN {quoted} WHEN startswith(t, chr(34)) THEN replace(t, concat(chr(92), chr(39)), chr(39)) ELSE {plain} END)"
    whole = f"aggregate({tokens}, 0, (n, t) -> n + length(t)) = length({e})"
    return f"IF({whole}, array_join({turned}, ''), NULL)"


def parse_literal(e: str, ddl: str, default: str | None = None) -> str:
    """Literal text (maps, lists, tuples) as a typed expression; ``default`` on failure.  Tuples become lists."""
    parsed = f"from_json({_json_text(e)}, '{ddl}', map('mode', 'PERMISSIVE'))"
    return parsed if default is None else f"coalesce({parsed}, {default})"


def row_items(e: str) -> str:
    """Text/score pairs of a stored row: blank texts dropped, unreadable scores 0."""
    pairs = parse_literal(e, "array<array<string>>", "CAST(array() AS array<array<string>>)")
    return (f"filter(transform(filter({pairs}, p -> size(p) >= 2), p -> named_struct('text', trim(p[0]), "
            "'score', coalesce(try_cast(p[1] AS DOUBLE), 0.0D))), i -> i.text <> '')")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(record)``: the text of every record of UTF-8 CSV files but the header of each; cells may hold line ends.

    Files are read as lines in byte ranges, so one large file is many tasks.  A
    line end is inside a cell if an odd number of quotes stands before it; a range
    counts its own quotes and tells its last record start for either parity it can
    be entered with, and these summaries are carried from range to range.  Lines
    that are whole records stay where they are; only the others are put together.

    Empty records are skipped; a last record whose quote is never closed ends with
    its file; no file rows give no records.
    """
    lines = spark.read.text(path, lineSep="\n").selectExpr(
        "_metadata.file_path AS file", "_metadata.file_block_start AS part", "monotonically_increasing_id() AS id", "value",
        "length(value) - length(replace(value, chr(34), '')) AS quotes")
    within = "PARTITION BY file, part ORDER BY id"
    placed = lines.selectExpr(
        "file", "part", f"CAST(row_number() OVER ({within}) AS BIGINT) AS line", "value", "quotes",
        f"pmod(coalesce(sum(quotes) OVER ({within} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS odd")
    parts = placed.groupBy("file", "part").agg(
        F.expr("pmod(sum(quotes), 2)").alias("odd_part"), F.expr("max(line) FILTER (WHERE odd = 0)").alias("start_even"), F.expr("max(line) FILTER (WHERE odd = 1)").alias("start_odd"))
    before = "PARTITION BY file ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    entered = parts.selectExpr("*", f"pmod(coalesce(sum(odd_part) OVER ({before}), 0), 2) AS enter").selectExpr(
        "*", "IF(enter = 0, start_even, start_odd) AS own_start").selectExpr(
        "file", "part", "enter", f"last(IF(own_start IS NULL, NULL, struct(part AS part, own_start AS line)), true) OVER ({before}) AS open")
    known = placed.join(entered, ["file", "part"]).selectExpr("*", "pmod(odd + enter, 2) = 0 AS starts", "pmod(odd + enter + quotes, 2) = 0 AS closes")
    body = known.where("NOT (part = 0 AND line = 1 AND closes)")
    whole = body.where("starts AND closes").selectExpr("value AS record")
    start = "last(IF(starts, struct(part AS part, line AS line), NULL), true) OVER (PARTITION BY file, part ORDER BY line)"
    pieces = known.where("NOT (starts AND closes)").selectExpr("file", "part", "line", "value", f"coalesce({start}, open) AS start")
    joined = pieces.groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("part", "line", "value"))).alias("held")).where(
        "NOT (start.part = 0 AND start.line = 1)").selectExpr("array_join(transform(held, h -> h.value), '\n') AS record")
    return whole.unionAll(joined).selectExpr("regexp_replace(record, '\\r$', '') AS record").where("record <> ''")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result CSV (UTF-8 with byte order mark) with typed scalars and parsed maps and lists."""
    schema = ", ".join(f"{c} STRING" for c in RESULT_COLUMNS)
    options = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    raw = csv_records(spark, path).select(F.from_csv("record", schema, options).alias("r")).select("r.*")
    doubles = ["diff_score", "blur_score", "top_score"]
    return raw.selectExpr(
        "video_name", "try_cast(frame_idx AS BIGINT) AS frame_idx", "final_category", *[f"try_cast({c} AS DOUBLE) AS {c}" for c in doubles],
        "feature_subtype", f"{parse_literal('feature_subtype_scores', 'map<string,double>', 'map()')} AS feature_subtype_scores",
        f"{row_items('raw_texts')} AS raw_texts", f"{parse_literal('category_scores', 'map<string,double>', 'map()')} AS category_scores",
        f"{parse_literal('matched_keywords', 'map<string,array<string>>', 'map()')} AS matched_keywords",
        f"{parse_literal('roi', 'array<int>')} AS roi", "save_path", "confidence_level", "try_cast(confidence_score AS DOUBLE) AS confidence_score")


def write_records(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append records, one folder per video and category so that reads prune."""
    df.write.mode(mode).partitionBy("video_id", "category").parquet(path)


def literal_map(e: str) -> str:
    """Map of numbers as single-quoted literal text, keys in order."""
    return (f"concat('{{', array_join(transform(array_sort(map_entries({e})), m -> concat('\\'', m.key, '\\': ', CAST(m.value AS STRING))), ', '), '}}')")


def _quoted(e: str) -> str:
    """A string as a single-quoted literal; backslashes and quotes are escaped."""
    return f"concat(chr(39), replace(replace({e}, chr(92), concat(chr(92), chr(92))), chr(39), concat(chr(92), chr(39))), chr(39))"


def literal_lists(e: str) -> str:
    """Map of string lists as literal text."""
    items = f"transform(m.value, v -> {_quoted('v')})"
    return (f"concat('{{', array_join(transform(array_sort(map_entries({e})), m -> concat('\\'', m.key, '\\': [', array_join({items}, ', '), ']')), ', '), '}}')")


def literal_texts(items: str) -> str:
    """Text/score pairs as a literal list of tuples."""
    return f"concat('[', array_join(transform({items}, i -> concat('(', {_quoted('i.text')}, ', ', coalesce(CAST(i.score AS STRING), 'None'), ')')), ', '), ']')"


def write_result_csv(df: DataFrame, path: str) -> None:
    """Text export in the published column order; one header per part file."""
    df.select(*RESULT_COLUMNS).write.mode("append").csv(path, header=True, escape='"', quote='"')
