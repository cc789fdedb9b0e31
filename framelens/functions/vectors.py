"""Expressions over gray arrays, hashes, boxes and token sets (SQL text)."""

from __future__ import annotations


def mean_abs_diff(a: str, b: str) -> str:
    """Mean absolute difference; 0 when one is missing or the sizes differ."""
    total = f"aggregate(zip_with({a}, {b}, (x, y) -> abs(CAST(x AS DOUBLE) - CAST(y AS DOUBLE))), 0.0D, (s, v) -> s + v)"
    return f"CASE WHEN size({a}) = size({b}) AND size({a}) > 0 THEN {total} / size({a}) ELSE 0.0D END"


def squared_distance(a: str, b: str) -> str:
    """Sum of squared differences of two arrays of equal length."""
    return f"aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), 0.0D, (s, v) -> s + v)"


def correlation(a: str, b: str) -> str:
    """Pearson correlation of two arrays of equal length; 1 when either is constant.  Means are taken once, outside the loop."""
    total = lambda e: f"aggregate({e}, 0.0D, (s, v) -> s + v)"
    mean = lambda e: f"({total(f'transform({e}, v -> CAST(v AS DOUBLE))')} / size({e}))"
    cross = total(f"zip_with({a}, {b}, (x, y) -> (x - m.a) * (y - m.b))")
    spread = lambda e, m: total(f"transform({e}, v -> (v - {m}) * (v - {m}))")
    sums = f"named_struct('c', {cross}, 's', {spread(a, 'm.a')} * {spread(b, 'm.b')})"
    return (f"transform(transform(array(named_struct('a', {mean(a)}, 'b', {mean(b)})), m -> {sums}), t -> CASE WHEN t.s > 0 THEN t.c / sqrt(t.s) ELSE 1.0D END)[0]")


def visually_same(gray_a: str, gray_b: str, hist_a: str, hist_b: str) -> str:
    """Gray difference at most 0.006 and histogram correlation at least 0.995."""
    return f"({mean_abs_diff(gray_a, gray_b)} <= 0.006D AND {correlation(hist_a, hist_b)} >= 0.995D)"


def jaccard(a: str, b: str) -> str:
    """Share of common distinct tokens; 0 when either set is empty."""
    common = f"size(array_intersect({a}, {b}))"
    return f"CASE WHEN size({a}) = 0 OR size({b}) = 0 THEN 0.0D ELSE {common} / (size({a}) + size({b}) - {common}) END"


def box_area(b: str) -> str:
    return f"(greatest(0.0D, {b}.x2 - {b}.x1) * greatest(0.0D, {b}.y2 - {b}.y1))"


def box_intersection(a: str, b: str) -> str:
    return (f"(greatest(0.0D, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
            f" * greatest(0.0D, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))")


def box_iou(a: str, b: str) -> str:
    both = box_intersection(a, b)
    union = f"({box_area(a)} + {box_area(b)} - {both})"
    return f"CASE WHEN {union} > 0 THEN {both} / {union} ELSE 0.0D END"


def box_overlap_min(a: str, b: str) -> str:
    """Intersection over the smaller area."""
    return f"({box_intersection(a, b)} / greatest(1.0D, least({box_area(a)}, {box_area(b)})))"


def gradient_hash(gray: str, columns: int, rows: int) -> str:
    """Bits of ``left > right`` over neighbouring cells, row by row, as one BIGINT.

    ``gray`` holds ``columns`` values per row; each row gives ``columns - 1`` bits.
    """
    width = columns - 1
    cell = f"CAST(floor(n / {width}) AS INT) * {columns} + n % {width}"
    bit = f"CASE WHEN {gray}[{cell}] > {gray}[{cell} + 1] THEN 1L ELSE 0L END"
    return f"aggregate(sequence(0, {width * rows - 1}), 0L, (h, n) -> shiftleft(h, 1) | {bit})"


def hamming(a: str, b: str) -> str:
    return f"bit_count({a} ^ {b})"
