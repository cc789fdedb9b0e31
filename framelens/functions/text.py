"""Text normal forms, phrase tests and per-frame text columns.

Functions take and return Spark SQL expression text, for ``selectExpr`` or
``expr``.  A rule pack with hundreds of phrases then costs one call to build,
and everything stays in built-in, JVM-side expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .rules import DEFAULT_PACK, MIN_TEXT_SCORE, PATTERN_NEEDS, PATTERNS, PHRASES, RulePack, normalise_phrase


def lit(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def regex(pattern: str) -> str:
    return "r'" + pattern + "'"


def either(tests) -> str:
    tests = list(tests)
    return "(" + " OR ".join(tests) + ")" if tests else "false"


def both(*tests: str) -> str:
    return "(" + " AND ".join(tests) + ")"


def normalize_plain(e: str) -> str:
    """Lower case; everything outside a-z and 0-9 becomes one blank."""
    return f"trim(regexp_replace(lower({e}), '[^a-z0-9]+', ' '))"


def normalize_text(e: str, pack: RulePack = DEFAULT_PACK) -> str:
    """Plain normal form with one pass of word corrections.

    The hash set test of ``IN`` keeps the map lookup off the path of the words
    that need no correction, which is nearly all of them.
    """
    table = {k: v for k, v in pack.corrections.items() if k.isalnum()}
    if not table:
        return normalize_plain(e)
    mapping = "map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in table.items()) + ")"
    names = ", ".join(lit(k) for k in table)
    return (f"array_join(transform(split({normalize_plain(e)}, ' '), "
            f"w -> CASE WHEN w IN ({names}) THEN {mapping}[w] ELSE w END), ' ')")


def normalize_paytable(e: str) -> str:
    """Normal form that keeps amounts readable: a-z, digits and ``.$/%+-``."""
    pattern = regex(r"[^a-z0-9.$/%+\-\s]")
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({e}, '')), {pattern}, ' '), r'\\s+', ' '))"


def squeeze(e: str) -> str:
    return f"replace({e}, ' ', '')"


def minimal_needles(phrases, pack: RulePack = DEFAULT_PACK) -> list[str]:
    """Space-free forms of ``phrases`` without those that contain another one.

    A spaced match implies the space-free match, and a match of a longer needle
    implies the match of any needle inside it, so this set decides ``has_any``.
    """
    needles = sorted({normalise_phrase(p, pack.corrections).replace(" ", "") for p in phrases} - {""}, key=lambda n: (len(n), n))
    kept: list[str] = []
    for n in needles:
        if not any(k in n for k in kept):
            kept.append(n)
    return kept


def any_of(compact: str, phrases, pack: RulePack = DEFAULT_PACK) -> str:
    """``has_any`` on a space-free text; ``phrases`` is a list or a rule key."""
    if isinstance(phrases, str):
        phrases = PHRASES[phrases]
    return either(f"contains({compact}, {lit(n)})" for n in minimal_needles(phrases, pack))


def has_any(e: str, phrases, pack: RulePack = DEFAULT_PACK) -> str:
    """True when a phrase occurs in ``e``, spaced or with all blanks removed."""
    return any_of(squeeze(e), phrases, pack)


def has_any_pattern(e: str, patterns) -> str:
    """True when a pattern matches; a named list is tried only where the text has a substring that all its matches need."""
    if isinstance(patterns, str):
        needs, patterns = PATTERN_NEEDS.get(patterns), PATTERNS[patterns]
        if needs:
            return both(some_term(e, needs), either(f"{e} RLIKE {regex(p)}" for p in patterns))
    return either(f"{e} RLIKE {regex(p)}" for p in patterns)


def some_term(e: str, terms) -> str:
    """Any plain substring of ``terms``."""
    return either(f"contains({e}, {lit(t)})" for t in terms)


def count_terms(e: str, terms) -> str:
    """Number of plain substrings of ``terms`` that occur in ``e``."""
    return "(" + " + ".join(f"CAST(contains({e}, {lit(t)}) AS INT)" for t in terms) + ")"


def count_matches(e: str, pattern: str) -> str:
    return f"regexp_count({e}, {regex(pattern)})"


def count_digits(e: str) -> str:
    return count_matches(e, "[0-9]")


def box_bounds(points: str) -> str:
    """Bounds of a polygon of points; zeros when it is missing or empty."""
    edge = lambda fn, f: f"coalesce({fn}(transform({points}, p -> p.{f})), 0.0D)"
    return (f"named_struct('x1', {edge('array_min', 'x')}, 'y1', {edge('array_min', 'y')}, "
            f"'x2', {edge('array_max', 'x')}, 'y2', {edge('array_max', 'y')})")


def keep_scored(items: str, min_score: float = MIN_TEXT_SCORE) -> str:
    return f"filter({items}, i -> i.score >= {min_score}D)"


def flatten_items(nested: str) -> str:
    """One list of well-formed items from a list of item lists; texts trimmed."""
    return (f"filter(transform(flatten({nested}), i -> named_struct('box', i.box, 'text', trim(i.text), "
            "'score', try_cast(i.score AS DOUBLE))), i -> i.text IS NOT NULL AND i.score IS NOT NULL)")


def rescale_boxes(items: str, factor: float) -> str:
    return (f"transform({items}, i -> named_struct('line_no', i.line_no, 'text', i.text, 'x1', i.x1 * {factor}D, "
            f"'y1', i.y1 * {factor}D, 'x2', i.x2 * {factor}D, 'y2', i.y2 * {factor}D, 'score', i.score))")


def joined_text(items: str, min_score: float | None = MIN_TEXT_SCORE, pack: RulePack = DEFAULT_PACK) -> str:
    """Normal forms of the item texts joined by a blank, in item order."""
    kept = items if min_score is None else keep_scored(items, min_score)
    return f"array_join(transform({kept}, t -> {normalize_text('t.text', pack)}), ' ')"


def token_set(texts: str, pack: RulePack = DEFAULT_PACK) -> str:
    """Distinct tokens of length >= 3 that are not numbers, from texts of length >= 3."""
    return tokens_of_lines(f"filter(transform({texts}, t -> {normalize_text('t', pack)}), t -> length(t) >= 3)")


def tokens_of_lines(lines: str) -> str:
    """The same from normal forms of three characters and more, as ``page_lines`` holds them."""
    words = f"flatten(transform({lines}, t -> split(t, ' ')))"
    return f"array_distinct(filter({words}, v -> length(v) >= 3 AND NOT v RLIKE '^[0-9]+$'))"


def text_stats(texts: str, pack: RulePack = DEFAULT_PACK) -> str:
    """Line count (length >= 2), distinct tokens and lines of 18 or more characters."""
    return text_stats_of_lines(f"filter(transform({texts}, t -> {normalize_text('t', pack)}), t -> length(t) >= 2)")


def text_stats_of_lines(lines: str) -> str:
    words = f"filter(flatten(transform({lines}, t -> split(t, ' '))), v -> v <> '')"
    return (f"named_struct('line_count', size({lines}), 'token_count', size(array_distinct({words})), "
            f"'long_line_count', size(filter({lines}, t -> length(t) >= 18)))")


def line_texts(items: str = "items") -> str:
    """What the text columns are made of: each item's text and whether its score reaches the limit."""
    return f"transform({items}, i -> named_struct('raw', i.text, 'read', i.score >= {MIN_TEXT_SCORE}D))"


def with_text_of_lines(df: DataFrame, texts: str, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """Add the text columns that need no geometry, from an array as ``line_texts`` gives it.

    ``forms``  normal form, with blanks and without, of every line
    ``joined`` / ``compact``  normal forms of the lines at or above the score limit, spaced and space-free
    ``page_lines`` / ``page_joined`` / ``page_compact``  those of three characters and more
    ``record_lines`` / ``record_text`` / ``record_compact``  the lines without the score limit
    """
    keep = [f"`{c}`" for c in df.columns]
    df = df.selectExpr(*keep, f"transform({texts}, t -> named_struct('raw', t.raw, 'norm', {normalize_text('t.raw', pack)}, 'read', t.read)) AS shaped_")
    df = df.selectExpr(*keep, "transform(shaped_, t -> named_struct('norm', t.norm, 'compact', replace(t.norm, ' ', ''))) AS forms",
                       "transform(filter(shaped_, t -> t.read), t -> named_struct('raw', t.raw, 'norm', t.norm, 'compact', replace(t.norm, ' ', ''))) AS lines",
                       "transform(shaped_, t -> t.norm) AS record_lines")
    return _joined(df)


def _joined(df: DataFrame) -> DataFrame:
    df = df.selectExpr("*", "array_join(transform(lines, i -> i.norm), ' ') AS joined", "array_join(record_lines, ' ') AS record_text")
    # columns of their own: the tests over a page's text would make it anew for every phrase
    df = df.selectExpr("*", "filter(transform(lines, i -> i.norm), t -> length(t) >= 3) AS page_lines")
    df = df.selectExpr("*", "array_join(page_lines, ' ') AS page_joined")
    return df.selectExpr("*", "replace(joined, ' ', '') AS compact", "replace(record_text, ' ', '') AS record_compact", "replace(page_joined, ' ', '') AS page_compact")


_GEOMETRY = "'cx', (i.x1 + i.x2) / 2.0D, 'cy', (i.y1 + i.y2) / 2.0D, 'w', greatest(0.0D, i.x2 - i.x1), 'h', greatest(0.0D, i.y2 - i.y1)"


def with_lines(df: DataFrame) -> DataFrame:
    """Replace ``lines`` by lines with geometry, from ``items`` and the ``forms`` of their texts."""
    shaped = f"zip_with(items, forms, (i, f) -> named_struct('raw', i.text, 'norm', f.norm, 'compact', f.compact, 'read', i.score >= {MIN_TEXT_SCORE}D, {_GEOMETRY}))"
    return df.selectExpr(*[f"`{c}`" for c in df.columns if c not in ("lines", "forms")], f"filter({shaped}, i -> i.read) AS lines")


def with_text(df: DataFrame, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """Add the text columns the signals read.

    ``lines``  items at or above the score limit with normal form and geometry
    ``joined`` / ``compact``  their joined normal forms, spaced and space-free
    ``page_lines`` / ``page_joined`` / ``page_compact``  the lines of three characters and more
    ``record_lines`` / ``record_text`` / ``record_compact``  the same without the score limit
    """
    shaped = (f"transform(items, i -> named_struct('raw', i.text, 'norm', {normalize_text('i.text', pack)}, 'score', i.score, "
              f"{_GEOMETRY})) AS shaped_items")
    keep = [f"`{c}`" for c in df.columns]
    df = df.selectExpr(*keep, shaped)
    df = df.selectExpr(*keep, f"transform(filter(shaped_items, i -> i.score >= {MIN_TEXT_SCORE}D), i -> named_struct('raw', i.raw, "
                       "'norm', i.norm, 'compact', replace(i.norm, ' ', ''), 'cx', i.cx, 'cy', i.cy, 'w', i.w, 'h', i.h)) AS lines",
                       "transform(shaped_items, i -> i.norm) AS record_lines")
    return _joined(df)
