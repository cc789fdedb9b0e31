"""Segmented windows against plain Python, with segments far smaller than the data."""

import random

from framelens.operators import windows as W
from framelens.sources import listing as L


def rows(seed, keys=3, n=80):
    rnd = random.Random(seed)
    return [(k, p, rnd.randint(0, 9)) for k in range(keys) for p in sorted(rnd.sample(range(1000), n))]


def frame(spark, data):
    return spark.createDataFrame(data, "k int, pos bigint, v int")


def test_gap_groups_equals_scan_for_any_segment_width(spark):
    data = rows(1)
    want, last, group = {}, {}, {}
    for k, p, _ in data:
        group[k] = group.get(k, 0) + (1 if k in last and p - last[k] > 17 else 0)
        last[k] = p
        want[(k, p)] = group[k]
    for width in (5, 64, 5000):
        got = {(r.k, r.pos): r.grp for r in W.gap_groups(frame(spark, data), ["k"], "pos", 17, width=width).collect()}
        assert got == want


def test_gap_limit_is_strict(spark):
    data = [(0, 0, 0), (0, 10, 0), (0, 21, 0), (0, 30, 0)]
    got = [r.grp for r in W.gap_groups(frame(spark, data), ["k"], "pos", 10, width=8).orderBy("pos").collect()]
    assert got == [0, 0, 1, 1]


def test_running_sum_and_max(spark):
    data = rows(2)
    for width in (7, 10_000):
        for kind, start, op in (("sum", 0, lambda a, b: a + b), ("max", None, lambda a, b: b if a is None else max(a, b))):
            for inclusive in (True, False):
                want, acc = {}, {}
                for k, p, v in data:
                    before = acc.get(k, start)
                    acc[k] = op(before, v)
                    want[(k, p)] = acc[k] if inclusive else before
                d = W.running(frame(spark, data), ["k"], "pos", "v", kind, "out", inclusive, width)
                assert {(r.k, r.pos): r.out for r in d.collect()} == want


def test_exact_rank_with_one_hot_key(spark):
    rnd = random.Random(3)
    data = [(0 if i % 3 else i % 7, i, rnd.randint(0, 4)) for i in range(600)]
    got = {(r.k, r.pos): r["rank"] for r in W.exact_rank(frame(spark, data), ["k"], ["v DESC", "pos"]).collect()}
    for key in {k for k, _, _ in data}:
        mine = sorted([(-v, p) for k, p, v in data if k == key])
        assert [got[(key, p)] for _, p in mine] == list(range(1, len(mine) + 1))


def test_even_sample_takes_ends_and_all_of_small_groups(spark):
    data = [(0, i * 3, 0) for i in range(50)] + [(1, i, 0) for i in range(4)]
    got = L.even_sample(frame(spark, data), ["k"], "pos", 7)
    by_key = {k: sorted(r.position for r in got.where(f"k = {k}").collect()) for k in (0, 1)}
    assert by_key[1] == [0, 1, 2, 3]
    assert by_key[0] == sorted({round(i * 49 / 6) for i in range(7)})
