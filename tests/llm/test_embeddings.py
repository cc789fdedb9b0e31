"""Links and groups against all pairs, recall, blocks within cells, defined cases."""

import numpy as np
from framelens.llm import embeddings as E
from framelens.llm.common import Scratch


def brute(vecs):
    """n_links and component of each usable vector."""
    ids = sorted(vecs)
    x = np.array([vecs[i] for i in ids], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    root = np.arange(len(ids))
    while True:
        new = np.array([root[n].min() for n in near])
        if (new == root).all():
            break
        root = new
    return {i: (int(near[k].sum()) - 1, ids[root[k]]) for k, i in enumerate(ids)}


def clustered(n, dim, seed, noise):
    """Groups of near vectors around random centres, of sizes from one to many."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 20), dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return {i: centres[int(rng.random() ** 3 * len(centres))] + rng.normal(size=dim) * noise / np.sqrt(dim) for i in range(n)}


def frame(spark, vecs):
    return spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in vecs.items()], "vec_id long, embedding array<float>, label int")


def test_recall_against_all_pairs(spark):
    for dim, noise in ((8, 0.2), (64, 0.2)):
        vecs = {i: np.float32(v) for i, v in clustered(3000, dim, dim, noise).items()}
        want = brute(vecs)
        got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(frame(spark, vecs)).collect()}
        found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
        assert all(got[i][0] <= want[i][0] for i in want) and there > 3000
        assert found >= 0.9 * there
        if dim == 8:  # here the margin leaves nothing out
            assert got == want


def test_differences_of_one_direction(spark):
    rng = np.random.default_rng(384)
    base, shift = rng.normal(size=(400, 384)), rng.normal(size=384)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    moved = base + 0.3 * shift / np.linalg.norm(shift)
    vecs = {i: np.float32(v) for i, v in enumerate(np.concatenate([base, moved]))}
    want = brute(vecs)
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(frame(spark, vecs)).collect()}
    assert sum(n for n, _ in want.values()) >= 700 and got == want


def test_small_blocks_give_the_same(spark):
    vecs = {i: np.float32(v) for i, v in clustered(400, 16, 5, 0.2).items()}
    found = Scratch(spark).keep(E.nodes(frame(spark, vecs)))
    centres = E.kmeans(found, 3)
    members = Scratch(spark).keep(E.memberships(found, centres, 0.95, E.SPREAD))
    sizes = {(r.d, r.cell): r["count"] for r in members.groupBy("d", "cell").count().collect()}
    sums = [{r.node: r.n for r in E.cell_links(members, sizes, block=b).groupBy("node").agg({"links": "sum"}).withColumnRenamed("sum(links)", "n").collect()} for b in (1024, 37)]
    assert sums[0] == sums[1]


def test_guests_travel_once_for_a_chunk_at_home(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(1500, 16))
    vecs = {i: np.float32(v) for i, v in enumerate(np.concatenate([base, base[:100] + 0.05]))}
    found = Scratch(spark).keep(E.nodes(frame(spark, vecs)))
    members = Scratch(spark).keep(E.memberships(found, E.kmeans(found, 8), 0.95, None))
    counted = members.groupBy("d", "cell").agg({"*": "count"}).collect()
    sizes = {(r.d, r.cell): r["count(1)"] for r in counted}
    homes = {(r.d, r.cell): r["count"] for r in members.where("home = cell").groupBy("d", "cell").count().collect()}
    rows, block = sum(sizes.values()), 128
    assert rows > 2 * len(vecs)
    chunks = {k: (-(-homes[k] // block), -(-(n - homes[k]) // block)) for k, n in sizes.items()}
    assert E.dealt(members, sizes, homes, block).count() == sum(homes[k] * (h + g) + (sizes[k] - homes[k]) * h for k, (h, g) in chunks.items())
    got = {r.node: r.n for r in E.cell_links(members, sizes, block=block, homes=homes).groupBy("node").agg({"links": "sum"}).withColumnRenamed("sum(links)", "n").collect()}
    want = brute(vecs)
    assert got == {i: n for i, (n, _) in want.items() if n} and len(got) >= 200
    assert len(members.where("visits IS NULL").take(1)) and not members.where("home = cell AND visits IS NULL").take(1)
    assert members.selectExpr("max(length(vec)) AS n").first().n == 16 * 4


def test_defined_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [inf, 1.0]), (7, [nan, 1.0]), (8, [None, 1.0]), (9, []), (10, [1.0, 0.0, 0.0]),
            (11, [0.0, 1.0]), (11, [0.0, 1.0]), (None, [1.0, 0.0]), (12, [3e38, 3e38]), (13, [1e-30, 1e-30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS node", "'x' AS w", "2 AS cell")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), *[(i, 0, i, True) for i in range(4, 11)], (11, 1, 11, True), (11, 1, 11, True),
                          (None, 0, None, False), (12, 1, 12, True), (13, 1, 12, False)], key=str)
    assert E.near_duplicates(df.where("false")).count() == 0
