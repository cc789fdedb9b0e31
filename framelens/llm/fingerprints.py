"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests (DataFrame functions only).

A paragraph is a line, or a piece of ``PARAGRAPH`` code points of a longer one.  A text's sketch has cells in three rows; each
distinct paragraph digest falls into one cell of each row, where the number of
digests, the XOR of the digests and the XOR of their check values are kept.
Subtracting the sketches of two versions cancels what they share.  A cell that
then holds one digest gives it up, which frees others (peeling).  If digests
remain stuck, the pair is tried again with four times as many cells.  The
likeness of two fingerprints is shared / all distinct paragraphs, from the
recovered differences.

Defined cases: null text is the empty text; two texts without paragraphs have
likeness 1; the next document is the one with the next larger doc_id (the
smallest beginning among rows that share it), after the last comes the first; rows
without doc_id are compared with the empty text; equal texts have equal
fingerprints; repeated rows are kept; other columns are not looked at; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, range_parts, table
from .registry import query

PARAGRAPH = 200
CELLS, GROWTH, LEVELS, ROUNDS = 24, 4, 9, 24
_PIECE = rf"[^\n]{{1,{PARAGRAPH}}}"
_EMPTY = "named_struct('n', 0, 'x', 0L, 'c', 0L)"


def let(value: str, name: str, body: str) -> str:
    """SQL text of ``body`` in which ``name`` stands for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def paragraphs(text: str) -> str:
    """Distinct digests of a text's paragraphs, sorted."""
    return f"sort_array(array_distinct(transform(regexp_extract_all({text}, r'{_PIECE}', 0), p -> xxhash64(p))))"


def sketch(signed: str, cells: str) -> str:
    """Dense cells ``(n, x, c)`` of an array of ``(key, sign, c)``: counts, XOR of keys, XOR of checks.

    Each row of the sketch takes its own 21 bits of a digest as the place, cut to
    the row's size, a power of two.  The entries are sorted by cell, so each cell is
    one range of them; the work grows with entries and cells, not with their product.
    """
    row = f"CAST({cells} DIV 3 AS INT)"
    places = [f"(CAST(shiftrightunsigned(e.key, {21 * j}) & ({cells} DIV 3 - 1) AS INT) + {j} * {row})" for j in range(3)]
    placed = ("sort_array(flatten(transform(" + signed + ", e -> array("
              + ", ".join(f"named_struct('p', {p}, 'key', e.key, 'sign', e.sign, 'c', e.c)" for p in places) + "))))")
    cell = f"""aggregate(slice(es, b + 1, IF(k + 1 < size(bs), bs[k + 1], size(es)) - b), {_EMPTY},
      (a, e) -> named_struct('n', a.n + e.sign, 'x', a.x ^ e.key, 'c', a.c ^ e.c))"""
    filled = f"""concat(flatten(transform(bs, (b, k) ->
      concat(array_repeat({_EMPTY}, es[b].p - IF(k = 0, -1, es[bs[k - 1]].p) - 1), array({cell})))),
      array_repeat({_EMPTY}, {cells} - 1 - es[size(es) - 1].p))"""
    bounds = "filter(sequence(0, size(es) - 1), i -> IF(i = 0, true, es[i].p <> es[i - 1].p))"
    return let(placed, "es", f"IF(size(es) = 0, array_repeat({_EMPTY}, {cells}), {let(bounds, 'bs', filled)})")


def subtracted(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'x', x.x ^ y.x, 'c', x.c ^ y.c))"


def peel(difference: str, cells: str) -> str:
    """``(ok, found)``: how many digests peeling a difference sketch recovers, and whether nothing is left.

    A round takes every digest that stands alone in a cell and subtracts their
    sketch; rounds after one that finds nothing only hand the state on.  A sketch
    that needs more than ``ROUNDS`` rounds is nearly full and counts as stuck.
    """
    alone = "filter(s.cells, x -> (x.n = 1 OR x.n = -1) AND x.c = xxhash64(x.x))"
    taken = f"array_distinct(transform({alone}, x -> named_struct('key', x.x, 'sign', x.n, 'c', x.c)))"
    after = f"named_struct('cells', {subtracted('s.cells', sketch('got', cells))}, 'found', s.found + size(got), 'go', true)"
    one = let(taken, "got", f"IF(size(got) = 0, named_struct('cells', s.cells, 'found', s.found, 'go', false), {after})")
    return (f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {difference}, 'found', 0, 'go', true), (s, r) -> IF(s.go, {one}, s),"
            " s -> named_struct('ok', forall(s.cells, x -> x.n = 0 AND x.x = 0 AND x.c = 0), 'found', s.found))")


def signed(keys: str, sign: int = 1) -> str:
    return f"transform({keys}, k -> named_struct('key', k, 'sign', {sign}, 'c', xxhash64(k)))"


def difference(own: str, other: str, own_cells: str, other_cells: str) -> str:
    """Number of digests in which two texts differ: from their fingerprints, else from ever larger sketches."""
    both = f"concat({signed(own)}, {signed(other, -1)})"  # the sketch of both, one negative, is the difference of their sketches
    retry = (f"aggregate(sequence(1, {LEVELS}), named_struct('ok', false, 'found', 0), (t, l) -> IF(t.ok, t, "
             + let(f"CAST({CELLS} * power({GROWTH}, l) AS INT)", "m", peel(sketch(both, "m"), "m"))
             + "), t -> IF(t.ok, t.found, CAST(raise_error('a sketch of the last size does not peel') AS INT)))")
    return let(peel(subtracted(own_cells, other_cells), str(CELLS)), "p", f"IF(p.ok, p.found, {retry})")


def written(cells_of: str) -> str:
    """A sketch as text: count, digests and checks of each cell in hexadecimal."""
    return f"array_join(transform({cells_of}, x -> concat(lower(hex(x.n)), ':', lower(hex(x.x)), ':', lower(hex(x.c)))), ' ')"


def likeness(own: str, other: str, found: str) -> str:
    """Shared over all: with d differences among |a| + |b| digests, twice the shared number is |a| + |b| - d."""
    both = f"(size({own}) + size({other}))"
    return f"IF({both} = 0, 1D, CAST({both} - {found} AS DOUBLE) / CAST({both} + {found} AS DOUBLE))"


def predecessors(ids: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """``(doc_id, prev_id)`` of distinct ids in ring order, by ranges of the ids and the ends of the ranges."""
    parts = range_parts(ids, ["doc_id"], scratch, rows)
    ends = parts.groupBy("part_").agg(F.max("doc_id").alias("hi"))  # one row per range
    before = ends.selectExpr("part_", "coalesce(lag(hi) OVER (ORDER BY part_), max(hi) OVER ()) AS hi_")
    return parts.selectExpr("doc_id", "part_", "lag(doc_id) OVER (PARTITION BY part_ ORDER BY doc_id) AS lag_").join(before, "part_").selectExpr(
        "doc_id", "coalesce(lag_, hi_) AS prev_id")


def versions(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256 and the digests of the text, its edited text and the next text.

    The last quarter of a text is replaced by the first code points of the next
    document.  Ids and lengths alone tell how much a document needs from its
    successor, so only that part of a text and its digests move to the
    predecessor; the whole texts are dealt by doc_id once, for both sides.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.count()
    texts = docs.where("doc_id IS NOT NULL").selectExpr("doc_id", "coalesce(text, '') AS text")
    lengths = scratch.keep(texts.selectExpr("doc_id", "char_length(text) AS n").groupBy("doc_id").agg(F.max("n").alias("n")), rows)
    ring = predecessors(lengths.select("doc_id"), rows, scratch)
    needs = scratch.keep(ring.join(lengths.withColumnRenamed("doc_id", "l_"), F.expr("prev_id = l_")).selectExpr("doc_id AS at_", "prev_id", "n DIV 4 AS quarter"), rows)
    heads = (texts.join(needs, F.expr("doc_id = at_")).selectExpr("prev_id", "substring(text, 1, CAST(quarter AS INT)) AS head", f"{paragraphs('text')} AS next_keys")
             .groupBy("prev_id").agg(F.min(F.struct("head", "next_keys")).alias("next")))
    linked = texts.join(heads, F.expr("doc_id = prev_id"), "left").selectExpr("doc_id", "text", "coalesce(next.head, '') AS head", "coalesce(next.next_keys, array()) AS next_keys")
    alone = docs.where("doc_id IS NULL").selectExpr("doc_id", "coalesce(text, '') AS text", "'' AS head", "CAST(array() AS array<bigint>) AS next_keys")
    whole = linked.unionAll(alone).selectExpr("*", "char_length(text) AS n").selectExpr("*", "concat(substring(text, 1, n - n DIV 4), substring(head, 1, n DIV 4)) AS edited")
    return whole.selectExpr("doc_id", "CAST(n AS BIGINT) AS n_chars", "sha2(edited, 256) AS edited_sha256", f"{paragraphs('text')} AS keys",
                            f"{paragraphs('edited')} AS edited_keys", "next_keys")


def compared(rows: DataFrame) -> DataFrame:
    """``rows`` of ``versions`` with fingerprints and likenesses; no row meets another here."""
    cells = rows.selectExpr("*", *[f"{sketch(signed(k), str(CELLS))} AS c_{k}" for k in ("keys", "edited_keys", "next_keys")])
    found = cells.selectExpr("*", f"{difference('keys', 'edited_keys', 'c_keys', 'c_edited_keys')} AS d_edited", f"{difference('keys', 'next_keys', 'c_keys', 'c_next_keys')} AS d_next")
    return found.selectExpr("doc_id", "n_chars", "edited_sha256", f"{written('c_keys')} AS fingerprint", f"{written('c_edited_keys')} AS edited_fingerprint",
                            f"{likeness('keys', 'edited_keys', 'd_edited')} AS near_edited", f"{likeness('keys', 'next_keys', 'd_next')} AS near_next")


@query("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likenesses."""
    return compared(versions(table(spark, sf_dir, "documents")))
