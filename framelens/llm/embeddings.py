"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells.

Equal vectors are one node with a weight.  k-means gives every node a home
cell; a node near the border of another cell also visits that one, so a pair
on both sides of a border meets.  Two unit vectors at the threshold are
``delta`` apart; a pair is missed only if its difference, measured across the
border, exceeds twice ``margin``.  The margin is ``delta / 2``, where nothing
can be missed.  A ``spread`` narrows it to that many standard deviations of the
measure for a difference of random direction, ``spread * delta / sqrt(dim)``;
that loses pairs whose differences share a direction, so it is off unless asked
for.  A pair meets in the home cell of one of its two rows, so guests are not
compared with each other.  Cells of any size are cut into blocks, and block pairs
are compared in groups of their own.  Without clusters in the data the visits
grow with the number of cells, so cells hold about 2048 rows.

Defined cases: vectors that are null, zero, empty or hold null or non-finite
components link with nothing; vectors of different lengths do not link; rows
without vec_id link with nothing and have no component; repeated rows count as
vectors; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, table
from .registry import query

THRESHOLD = 0.95
CELL_ROWS, MAX_CELLS, STEPS, BLOCK = 2048, 4096, 4, 4096
SPREAD = None
_FINITE = ("embedding IS NOT NULL AND exists(embedding, x -> x <> 0) AND "
           "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; the largest component is divided out first, so squares stay finite."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def units(column: pa.Array) -> list[np.ndarray]:
    """Unit vectors of a column of lists of any lengths."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    start, out = np.cumsum(size) - size, [None] * len(size)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        for i, x in zip(at, _unit(flat[start[at][:, None] + np.arange(d)])):
            out[i] = x
    return out


def _unpacked(rows: pd.DataFrame) -> np.ndarray:
    """Unit vectors of the packed components of ``rows``, as wide as in the table."""
    d = int(rows.d.iloc[0])
    return _unit(np.frombuffer(b"".join(rows.vec), f"<f{len(rows.vec.iloc[0]) // d}").reshape(-1, d))


def nodes(vectors: DataFrame) -> DataFrame:
    """``(embedding, node, w)``: distinct usable vectors with their smallest vec_id and their number."""
    usable = vectors.select("vec_id", "embedding").where(f"vec_id IS NOT NULL AND coalesce({_FINITE}, false)")
    return usable.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("w"))


def _nearest(vecs: list[np.ndarray], centres: dict[int, np.ndarray]):
    """Per dimension: row numbers, unit vectors and their products with the centres."""
    dims = np.array([len(v) for v in vecs])
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        x = np.stack([vecs[i] for i in at])
        c = centres.get(int(d), x[:0])
        yield int(d), at, x, c, x @ c.T


def kmeans(found: DataFrame, cells: int, steps: int = STEPS) -> dict[int, np.ndarray]:
    """Centres per dimension by Lloyd steps over all vectors; a task sends one sum per cell, the driver holds ``cells`` centres."""
    first = found.orderBy(F.xxhash64("node"), "node").limit(cells).select("embedding").toArrow().column(0).combine_chunks()
    vecs = units(first)
    centres = {d: np.stack([v for v in vecs if len(v) == d]) for d in {len(v) for v in vecs}}
    for _ in range(steps):
        def sums(batches, centres=centres):
            total: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                for d, _, x, c, p in _nearest(units(b.column(0)), centres):
                    if not len(c):
                        continue
                    own = p.argmax(axis=1)
                    for k in np.unique(own):
                        s = x[own == k].sum(axis=0)
                        total[d, int(k)] = total.get((d, int(k)), 0) + s
            for (d, k), s in total.items():
                yield pa.record_batch([pa.array(np.full(d, d), pa.int32()), pa.array(np.full(d, k), pa.int32()), pa.array(np.arange(d), pa.int32()), pa.array(s)],
                                      ["d", "cell", "j", "s"])
        rows = (found.select("embedding").mapInArrow(sums, "d int, cell int, j int, s double")
                .groupBy("d", "cell", "j").agg(F.sum("s").alias("s")).toPandas())
        new = {d: c.copy() for d, c in centres.items()}
        for d, part in rows.groupby("d"):
            s = np.zeros_like(new[d])
            s[part.cell, part.j] = part.s
            norm = np.linalg.norm(s, axis=1)
            live = norm > 1e-12
            new[d][live] = s[live] / norm[live, None]
        centres = new
    return centres


def memberships(found: DataFrame, centres: dict[int, np.ndarray], threshold: float, spread: float | None) -> DataFrame:
    """Rows ``(d, cell, home, visits, node, w, vec)``: each node in its home cell, with the list of its cells, and in those it visits."""
    delta = np.sqrt(2 - 2 * threshold)
    kind = "<f4" if found.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"

    def run(batches):
        for b in batches:
            vecs, node, w = units(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()
            packed = [v.values.to_numpy(zero_copy_only=False).astype(kind).tobytes() for v in b.column(0)]
            for d, at, x, c, p in _nearest(vecs, centres):
                if not len(c):
                    p = np.zeros((len(x), 1))
                    gap = np.ones((1, 1))
                else:
                    gap = np.sqrt(np.maximum(2 - 2 * np.clip(c @ c.T, -1, 1), 1e-18))
                own = p.argmax(axis=1)
                margin = (delta / 2 if spread is None else min(delta / 2, spread * delta / np.sqrt(d))) + 1e-9
                near = (p[np.arange(len(x)), own][:, None] - p) <= margin * gap[own]
                near[np.arange(len(x)), own] = True
                i, k = np.nonzero(near)
                visits = np.split(k.astype(np.int32), np.cumsum(near.sum(axis=1))[:-1])
                yield pa.record_batch(
                    [pa.array(np.full(len(i), d), pa.int32()), pa.array(k, pa.int32()), pa.array(own[i], pa.int32()),
                     pa.array([visits[r].tobytes() if k_ == own[r] else None for r, k_ in zip(i, k)], pa.binary()), pa.array(node[at[i]]), pa.array(w[at[i]]),
                     pa.array([packed[r] for r in at[i]], pa.binary())], ["d", "cell", "home", "visits", "node", "w", "vec"])

    node_type = found.schema["node"].dataType.simpleString()
    return found.select("embedding", "node", "w").mapInArrow(run, f"d int, cell int, home int, visits binary, node {node_type}, w long, vec binary")


def _groups(adj: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each row's connected group under a symmetric boolean matrix."""
    root, todo = ids.copy(), adj.any(axis=1)
    while todo.any():
        mask = np.zeros(len(ids), bool)
        mask[np.argmax(todo)] = True
        grown = mask
        while grown.any():
            todo &= ~grown
            grown = adj[grown].any(axis=0) & todo
            mask |= grown
        root[mask] = ids[mask].min()
    return root


def dealt(members: DataFrame, sizes: dict[tuple[int, int], int], homes: dict[tuple[int, int], int] | None = None, block: int = BLOCK) -> DataFrame:
    """Rows of a cell in its block pairs ``(lo, hi)``: a chunk of rows at home with another, or with a chunk of guests.

    Guests are never compared with each other, so a guest travels once for each chunk of rows at home and a row at home
    once for each chunk of the cell.  Without ``homes`` a cell counts as if all its rows were at home.
    """
    chunks = {k: (-(-(homes or sizes)[k] // block), -(-(n - homes[k] if homes else n) // block)) for k, n in sizes.items()}

    def deal(batches):
        for b in batches:
            d, cell, home, node = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("d", "cell", "home", "node"))
            n = np.array([chunks[k] for k in zip(d.tolist(), cell.tolist())], np.int64).reshape(-1, 2)
            mine, key = home == cell, pd.util.hash_array(node)
            own = (key % np.maximum(np.where(mine, n[:, 0], n[:, 1]), 1).astype(np.uint64)).astype(np.int64) + np.where(mine, 0, n[:, 0])
            times = np.where(mine, n.sum(axis=1), n[:, 0])
            row = np.repeat(np.arange(len(n)), times)
            other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            out = b.take(pa.array(row))
            for name, values in (("lo", np.minimum(own[row], other)), ("hi", np.maximum(own[row], other)), ("own", own[row])):
                out = out.append_column(name, pa.array(values.astype(np.int32)))
            yield out

    return members.mapInArrow(deal, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema) + ", lo int, hi int, own int")


def cell_links(members: DataFrame, sizes: dict[tuple[int, int], int], threshold: float = THRESHOLD, block: int = BLOCK,
               homes: dict[tuple[int, int], int] | None = None) -> DataFrame:
    """``(node, links, root)``: links counted for a node in one block pair of one cell, and the smallest node of its local group."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        own, lo, hi, cell = rows.own.to_numpy(), int(rows.lo.iloc[0]), int(rows.hi.iloc[0]), int(rows.cell.iloc[0])
        one, two = (rows[own == k].reset_index(drop=True) for k in (lo, hi))
        if not len(one) or not len(two):
            return pd.DataFrame({"node": one.node[:0], "links": np.zeros(0, np.int64), "root": one.node[:0]})
        near = _unpacked(one) @ _unpacked(two).T >= threshold
        if lo == hi:
            np.fill_diagonal(near, False)
        # a pair that meets in both home cells counts in the smaller one
        home = two.home.to_numpy()
        guest = np.unique(home[home < cell])
        if len(guest):
            for i in np.flatnonzero(near[:, home < cell].any(axis=1)):
                seen = np.intersect1d(np.frombuffer(one.visits[i], np.int32), guest)
                near[i] &= ~np.isin(home, seen)
        a, b = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        sub = near[np.ix_(a, b)]
        if lo == hi:
            ids, links, adj = one.node.to_numpy()[a], sub @ one.w.to_numpy()[a], sub
        else:
            ids = np.concatenate([one.node.to_numpy()[a], two.node.to_numpy()[b]])
            links = np.concatenate([sub @ two.w.to_numpy()[b], sub.T @ one.w.to_numpy()[a]])
            adj = np.zeros((len(ids), len(ids)), bool)
            adj[:len(a), len(a):], adj[len(a):, :len(a)] = sub, sub.T
        return pd.DataFrame({"node": ids, "links": links, "root": _groups(adj, ids)})

    node_type = members.schema["node"].dataType.simpleString()
    return dealt(members, sizes, homes, block).groupBy("d", "cell", "lo", "hi").applyInPandas(compare, f"node {node_type}, links long, root {node_type}")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, spread: float | None = SPREAD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``."""
    scratch = Scratch(vectors.sparkSession)
    found = scratch.keep(nodes(vectors))
    n_nodes = found.count()
    cells = max(1, min(MAX_CELLS, n_nodes // CELL_ROWS))
    members = memberships(found, kmeans(found, cells), threshold, spread)
    # two counts per cell: at most MAX_CELLS for each vector length
    counted = members.groupBy("d", "cell").agg(F.count("*").alias("n"), F.count_if(F.expr("home = cell")).alias("h")).collect()
    linked = scratch.keep(cell_links(members, {(r.d, r.cell): r.n for r in counted}, threshold, homes={(r.d, r.cell): r.h for r in counted}))
    roots = components(linked.selectExpr("node AS a", "root AS b"), scratch, n_nodes).withColumnRenamed("node", "r_")
    totals = linked.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "t_")
    per = (found.join(totals, F.expr("node = t_"), "left").join(roots, F.expr("node = r_"), "left")
           .selectExpr("embedding AS e_", "coalesce(links, 0) + w - 1 AS links_", "coalesce(root, node) AS root_"))
    rows = vectors.select("vec_id", "embedding").withColumn("key_", F.expr(f"IF(vec_id IS NOT NULL AND coalesce({_FINITE}, false), embedding, NULL)"))
    return rows.join(per, F.expr("key_ = e_"), "left").selectExpr(
        "vec_id", "coalesce(links_, 0L) AS n_links", "coalesce(root_, vec_id) AS component_id",
        "coalesce(vec_id = coalesce(root_, vec_id), false) AS kept")


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, min(r.root) AS component_id, v.vec_id = min(r.root) AS kept
FROM v JOIN r ON r.node = v.vec_id GROUP BY v.vec_id"""


@query("op4_embeddings", SQL)
def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every embedding."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
