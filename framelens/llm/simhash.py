"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint's bit is the majority over the hashes of a document's shingles.
Distinct fingerprints are looked up in tables keyed by pairs of their six
segments: two fingerprints that differ in at most four bits leave two segments
untouched, so they meet in a table.  Rows that meet are compared with bit
planes: plane b holds bit b of 64 fingerprints in one word, and carry-save
counters over the planes give all their distances at once.  A block is left as
soon as every distance in it is above the radius.

Large meeting groups are cut into chunks, and chunk pairs are compared in
groups of their own; each comparison returns one link per member (to the
smallest of its local group), never all pairs.

``one_per_likeness`` groups by the Jaccard similarity of the shingle sets.  Rows
meet by their fingerprints first, and every link is checked on the shingle sets
themselves.  No radius of a 64-bit fingerprint covers the similarity (pairs at 0.8
differ in up to 13 bits and more), so texts that share a band of MinHash lanes
meet as well: once with the head of their band, and then with rows that no link
has joined to them yet.  The latter are compared where they meet, shingle set by
shingle set, and a comparison returns the links that join its rows, never all
pairs; so a family whose members are nearly alike gives no rows in the square of
its size.

Defined cases: null text is the empty text, and texts without words have
fingerprint zero; equal fingerprints are linked; a row without doc_id gets a
fingerprint and no component; repeated rows stay; other columns are not looked
at; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.greedy import least_lanes
from .common import Scratch, components, table, tidy, without_ids
from .registry import query

SHINGLE, SEED, RADIUS = 4, 42, 4
SEGMENTS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
CHUNK = 1024
# likeness: BANDS * BAND lanes; a pair at 0.8 shares no band with probability (1 - 0.8 ** 5) ** 25 = 5e-5.
# A lane is a byte: unlike ones agree in 1 of 256.  Estimates under LOW are dropped (0.8 is four deviations away).
LIKE_SHINGLE, LIKE, BANDS, BAND, LOW = 5, 0.8, 25, 5, 0.65
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(data: bytes, k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    words = data.lower().split()
    if len(words) < k:
        grams = [b" ".join(words)] if words else []
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(k))))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), grams), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: bits set in more than half of the hashes."""
    if not len(hashes):
        return 0
    lanes = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    per_byte = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    major = (per_byte @ bits * 2 > len(hashes)).astype(np.uint8).ravel()
    return int(np.packbits(major, bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``(doc_id, fp)`` for every row; fp is the fingerprint as a signed long."""
    def run(batches):
        for b in batches:
            for at in range(0, len(b), 256):  # few texts at a time as Python objects
                part = b.slice(at, 256)
                fps = [majority(shingle_hashes(t or b"", shingle, seed)) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])
    ids = docs.select("doc_id", "text")
    return ids.mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) bit planes: bit r of word w of plane b is bit b of fingerprint 64 w + r."""
    n = -(-len(fps) // 64) * 64
    bits = np.zeros((n, 64), np.uint8)
    bits[:len(fps)] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def lanes_within(plane_of, shape, lanes: int, radius: int) -> np.ndarray:
    """Words whose bits say which lanes count at most ``radius`` set bits over the 64 planes ``plane_of(b)``."""
    counters = [np.zeros(shape, np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(shape, np.uint64)
    if lanes % 64:
        over[..., -1] = ~np.uint64((1 << (lanes % 64)) - 1)  # lanes beyond the last row are out from the start
    for b in range(64):
        carry = plane_of(b)
        for c in counters:
            c ^= carry
            carry = carry & ~c
        over |= carry
        if b % 4 == 3:
            equal, above = np.full(shape, _FULL), np.zeros(shape, np.uint64)
            for k in range(len(counters) - 1, -1, -1):
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    above |= equal & counters[k]
                    equal &= ~counters[k]
            out = over | above
            if (out == _FULL).all():
                break
    return ~out


def _bits(words: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:n])


def block_links(left: np.ndarray, left_ids: np.ndarray, right: np.ndarray, right_ids: np.ndarray, radius: int):
    """Spanning links ``(id, smallest id of its local group)`` among the pairs of left x right within the radius."""
    vertical = planes(right)
    near = np.empty((len(left), vertical.shape[1]), np.uint64)
    for at in range(0, len(left), 256):
        q = left[at:at + 256]
        sign = [np.where(q >> np.uint64(b) & np.uint64(1), _FULL, np.uint64(0))[:, None] for b in range(64)]
        near[at:at + 256] = lanes_within(lambda b: vertical[b] ^ sign[b], (len(q), vertical.shape[1]), len(right), radius)
    waiting = near.any(axis=1)
    out_a, out_b = [], []
    for seed in range(len(left)):
        if not waiting[seed]:
            continue
        mask, grown = near[seed].copy(), np.array([seed])
        rows = []
        while len(grown):
            waiting[grown] = False
            rows.append(grown)
            mask |= np.bitwise_or.reduce(near[grown], axis=0)
            grown = np.flatnonzero(waiting & (near & mask).any(axis=1))
        ids = np.unique(np.concatenate([left_ids[np.concatenate(rows)], right_ids[_bits(mask, len(right))]]))
        out_a.append(ids[1:])
        out_b.append(np.full(len(ids) - 1, ids[0]))
    return out_a, out_b


def small_links(fps: np.ndarray, ids: np.ndarray, group: np.ndarray, radius: int):
    """Links within the small groups of sorted rows: rows that stand d apart are the lanes of one comparison."""
    out_a, out_b, d = [], [], 1
    while d < len(fps):
        at = np.flatnonzero(group[d:] == group[:-d])
        if not len(at):
            break
        for cut in range(0, len(at), 1 << 16):
            i = at[cut:cut + (1 << 16)]
            diff = planes(fps[i] ^ fps[i + d])
            hit = i[_bits(lanes_within(lambda b: diff[b].copy(), diff.shape[1:], len(i), radius), len(i))]
            out_a.append(np.maximum(ids[hit], ids[hit + d]))
            out_b.append(np.minimum(ids[hit], ids[hit + d]))
        d += 1
    return out_a, out_b


def links(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """``(a, b)`` links whose connected groups are those of all pairs of ``fps(fp, node)`` within the radius of at most 4."""
    segs = [f"(shiftrightunsigned(fp, {at}) & {(1 << width) - 1})" for at, width in SEGMENTS]
    keys = ", ".join(f"{c}L * 4194304 + {segs[i]} * 2048 + {segs[j]}" for c, (i, j) in enumerate(combinations(range(len(segs)), 2)))
    rows = fps.selectExpr("fp", "node", f"explode(array({keys})) AS key")
    many = rows.groupBy("key").count().where("count > 1").selectExpr("key", f"CAST(ceil(count / {chunk}) AS INT) AS chunks")
    met = rows.join(many, "key").withColumn("own", F.expr("CAST(pmod(xxhash64(fp, key), chunks) AS INT)"))
    dealt = met.selectExpr("key", "own", "fp", "node", "explode(sequence(0, chunks - 1)) AS other").selectExpr(
        "key", "least(own, other) AS lo", "greatest(own, other) AS hi", "own = least(own, other) AS first_", "fp", "node")

    def run(batches):
        held = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            new = np.flatnonzero(np.any([held[k][1:] != held[k][:-1] for k in range(3)], axis=0)) + 1
            if len(new):  # the last group may go on in the next batch
                yield compared([c[:new[-1]] for c in held], new[:-1])
                held = [c[new[-1]:] for c in held]
        if held is not None:
            new = np.flatnonzero(np.any([held[k][1:] != held[k][:-1] for k in range(3)], axis=0)) + 1
            yield compared(held, new)

    def compared(cols, new):
        key, lo, hi, first, fp, node = cols
        fp = fp.view(np.uint64)
        starts = np.concatenate([[0], new]).astype(np.int64)
        size = np.diff(np.append(starts, len(fp)))
        group = np.repeat(np.arange(len(starts)), size)
        small = (size <= 32) & (lo[starts] == hi[starts])
        pick = small[group]
        a, b = small_links(fp[pick], node[pick], group[pick], radius)
        for g in np.flatnonzero(~small):
            s = slice(starts[g], starts[g] + size[g])
            side = first[s].astype(bool)
            other = side if lo[starts[g]] == hi[starts[g]] else ~side
            if side.any() and other.any():
                x, y = block_links(fp[s][side], node[s][side], fp[s][other], node[s][other], radius)
                a, b = a + x, b + y
        a, b = (np.concatenate(x) if x else np.array([], np.int64) for x in (a, b))
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    own = scratch.keep(with_fingerprints(docs))
    fps = scratch.keep(own.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), own.count())
    roots = components(links(fps, radius), scratch, fps.count()).withColumnRenamed("node", "n_")
    of = fps.join(roots, F.expr("node = n_"), "left").selectExpr("fp", "coalesce(root, node) AS component_")
    return own.join(of, "fp", "left").selectExpr(
        "doc_id", "lower(lpad(hex(fp), 16, '0')) AS fingerprint", "IF(doc_id IS NULL, NULL, component_) AS component_id")


def one_per_group(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stand for their group: the smallest doc_id of each, and rows without doc_id."""
    return without_ids(docs, near_duplicates(docs, radius).where("doc_id <> component_id").select("doc_id").distinct())


def _shingles(docs: DataFrame, shingle: int, kind: str, row) -> DataFrame:
    """``docs(doc_id, text)`` by ``row`` of each text's sorted distinct shingle hashes."""
    def run(batches):
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                sets = [np.unique(shingle_hashes(t or b"", shingle)) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.record_batch([part.column(0), *row(sets)], ["doc_id", *[c.split()[0] for c in kind.split(", ")]])
    return docs.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {kind}")


def _met_before(sig: np.ndarray, one: np.ndarray, band: int) -> np.ndarray:
    """Which of the rows share a band before ``band`` with ``one``."""
    return (sig[:, :band * BAND] == one[:band * BAND]).reshape(len(sig), band, BAND).all(axis=2).any(axis=1)


def head_pairs(sig: np.ndarray, ids: np.ndarray, band: int, root: np.ndarray):
    """Pairs to check of the first row with all rows near it; those that share an earlier band with it have met there."""
    near = 1 + np.flatnonzero((sig[1:] == sig[0]).mean(axis=1) >= LOW)
    near = near[~_met_before(sig[near], sig[0], band)]
    return [ids[near]], [np.full(len(near), ids[0])]


def open_rows(sig: np.ndarray, side: np.ndarray, band: int, root: np.ndarray):
    """Each row ``i`` with the rows near it to be compared with it in ``band``; rows of two sides are compared across.

    A pair that an earlier band brings together is left to that one; rows of one ``root``, which may change on the way, are joined already.
    """
    rows = np.arange(len(sig))
    across = side.min() < side.max()
    for i in rows[side == side.min()] if across else rows:
        at = rows[side != side[i]] if across else rows[i + 1:]
        at = at[root[at] != root[i]]
        at = at[(sig[at] == sig[i]).mean(axis=1) >= LOW]
        at = at[~_met_before(sig[at], sig[i], band)]
        if len(at):
            yield i, at


def set_links(sets: list[np.ndarray], sig: np.ndarray, side: np.ndarray, band: int, root: np.ndarray, least: float = LIKE):
    """Links among the open rows whose ``sets`` are alike at ``least``: as many as join what their pairs join."""
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    places = [place[e - n:e] for e, n in zip(ends, size)]
    root, marked, out = root.copy(), np.zeros(len(values), bool), []
    for i, at in open_rows(sig, side, band, root):
        marked[places[i]] = True
        common = np.array([np.count_nonzero(marked[places[j]]) for j in at])
        marked[places[i]] = False
        for j in at[common >= least * (size[i] + size[at] - common)]:
            if root[j] != root[i]:
                out.append((i, j))
                root[root == root[j]] = root[i]
    return np.array(out, np.int64).reshape(-1, 2)


def band_rows(sets: DataFrame, heads: bool, chunk: int = CHUNK // 2) -> DataFrame:
    """Rows of ``sets(node, sig, root)`` in the groups ``(key, lo, hi)`` of the bands they share with other roots: pairs of chunks, or for ``heads`` chunks alone."""
    keys = ", ".join(f"xxhash64({c}, substring(sig, {1 + BAND * c}, {BAND}))" for c in range(BANDS))
    rows = sets.selectExpr("node", "root", f"posexplode(array({keys})) AS (band, key)")
    # written: most keys stand alone, so the rows need not be dealt by key once more while the others are few
    many = Scratch(sets.sparkSession).keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.expr("min(root) <> max(root)").alias("apart")).where("apart").selectExpr(
        "key", f"CAST(ceil(count / {chunk}) AS INT) AS chunks"))
    met = rows.drop("root").join(many, "key").withColumn("own", F.expr("CAST(pmod(xxhash64(node, key), chunks) AS INT)")).join(sets, "node")
    others = "sequence(own, own)" if heads else "sequence(0, chunks - 1)"
    return met.select("key", "band", "own", "node", "sig", "root", F.expr(f"explode({others}) AS other")).selectExpr(
        "key", "least(own, other) AS lo", "greatest(own, other) AS hi", "band", "own", "node", "sig", "root")


def _column(c: pa.Array) -> list:
    if not pa.types.is_list(c.type):
        return c.to_pylist()
    flat, ends = c.flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy())
    return np.split(flat, ends[:-1])


def grouped(rows: DataFrame, of, kind: str) -> DataFrame:
    """What ``of(key, lo, hi, columns)`` makes of each group of ``band_rows``, by node; columns are band, own, node, sig, root as arrays, and lists of what follows them."""
    names = [c.split()[0] for c in kind.split(", ")]

    def made(at, held):
        band, own, node, sig, root, *more = zip(*held)
        root = np.array(root, np.int64)
        if (root != root[0]).any():
            sig = np.frombuffer(b"".join(sig), np.uint8).reshape(len(node), -1)
            out = of(at, band[0], np.array(own), np.array(node, np.int64), sig, root, *more)
            if len(out[0]):
                yield pa.record_batch([pa.array(c) for c in out], names)

    def run(batches):
        held, at = [], None
        for b in batches:
            for k in range(0, len(b), 256):  # few rows at a time as Python objects
                for key, lo, hi, *row in zip(*(_column(c) for c in b.slice(k, 256).columns)):
                    if (key, lo, hi) != at:
                        if held:
                            yield from made(at, held)
                        held, at = [], (key, lo, hi)
                    held.append(row)
        if held:
            yield from made(at, held)

    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node").mapInArrow(tidy(run), kind)


def head_links(sets: DataFrame) -> DataFrame:
    """``(a, b)`` pairs of ``sets(node, sig, root)``: rows near the first row of a band's chunk, with that row."""
    def of(at, band, own, node, sig, root):
        (a,), (b,) = head_pairs(sig, node, band, root)
        return a, b
    return grouped(band_rows(sets, True), of, "a long, b long").distinct()


def like_rows(sets: DataFrame) -> DataFrame:
    """The rows of ``band_rows`` that have open rows near them in their group."""
    def of(at, band, own, node, sig, root):
        near = np.zeros(len(node), bool)
        for i, rows in open_rows(sig, own, band, root):
            near[i] = near[rows] = True
        n = np.count_nonzero(near)
        return *(np.full(n, x, t) for x, t in zip((*at, band), (np.int64, np.int32, np.int32, np.int32))), own[near].astype(np.int32), node[near], list(map(bytes, sig[near])), root[near]
    return grouped(band_rows(sets, False), of, "key long, lo int, hi int, band int, own int, node long, sig binary, root long")


def like_links(rows: DataFrame, least: float = LIKE) -> DataFrame:
    """``(a, b)`` links among the rows of ``like_rows`` with their ``hashes``: a group gives as many as join its rows."""
    def of(at, band, own, node, sig, root, hashes):
        links = node[set_links(hashes, sig, own, band, root, least)]
        return links.max(axis=1), links.min(axis=1)
    return grouped(rows.select("key", "lo", "hi", "band", "own", "node", "sig", "root", "hashes"), of, "a long, b long").distinct()


def fingerprint_links(sets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b)`` pairs of ``sets(node, fp)``: each row with the first of its fingerprint, and those with the smallest node their fingerprints lead to in a table."""
    first = sets.groupBy("fp").agg(F.min("node").alias("node"))
    same = sets.select("node", "fp").join(first.selectExpr("fp", "node AS b"), "fp").where("node <> b").selectExpr("node AS a", "b")
    return links(first, radius).distinct().unionByName(same)


def one_per_likeness(docs: DataFrame, shingle: int = LIKE_SHINGLE, least: float = LIKE) -> DataFrame:
    """The rows of ``docs`` that stand for their group of texts with shingle sets alike at ``least``: the smallest doc_id of each, and rows without doc_id."""
    if least < LIKE:
        raise ValueError(f"the bands are laid out for similarities from {LIKE}")
    scratch = Scratch(docs.sparkSession)
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    digests = lambda sets: pa.array([xxhash.xxh64_intdigest(s.tobytes(), seed=SEED) for s in sets], pa.uint64()).to_numpy().view(np.int64)
    own = scratch.keep(_shingles(texts, shingle, "digest long, fp long, sig binary", lambda sets: (
        digests(sets), pa.array([majority(s) for s in sets], pa.int64()),
        pa.array([least_lanes(s, BANDS * BAND, SEED).astype(np.uint8).tobytes() for s in sets], pa.binary()))))
    sets = scratch.keep(own.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("fp").alias("fp"), F.first("sig").alias("sig")), own.count())
    count = sets.count()

    def hashes_of(ids: DataFrame) -> DataFrame:
        """``(node, hashes)`` of the nodes ``ids(id_)``."""
        # rows that share an id have texts of their own: a node's set is that of its digest
        asked = scratch.keep(ids.distinct().join(sets.selectExpr("node", "digest"), F.expr("id_ = node")).selectExpr("id_", "digest AS digest_"))
        wanted = texts.join(asked, F.expr("doc_id = id_")).selectExpr("struct(doc_id, digest_) AS doc_id", "text")
        hashes = _shingles(wanted, shingle, "digest long, hashes array<bigint>", lambda sets: (
            digests(sets), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))))
        out = scratch.keep(hashes.where("digest = doc_id.digest_").groupBy(F.expr("doc_id.doc_id AS node")).agg(F.first("hashes").alias("hashes")))
        scratch.free(asked)
        return out

    def checked(found: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` whose shingle sets are alike."""
        pairs = scratch.keep(found)
        hashes = hashes_of(pairs.selectExpr("a AS id_").union(pairs.selectExpr("b AS id_")))
        heads = hashes.join(pairs.selectExpr("b AS head_").distinct(), F.expr("node = head_"), "left_semi")
        both = pairs.join(hashes.selectExpr("node AS a", "hashes AS x"), "a").join(heads.selectExpr("node AS b", "hashes AS y"), "b")
        both = both.selectExpr("a", "b", "size(x) + size(y) AS n", "size(array_intersect(x, y)) AS common")
        out = scratch.keep(both.where(f"common >= {least}D * (n - common)").select("a", "b"))
        scratch.free(pairs, hashes)
        return out

    def compared(joined: DataFrame) -> DataFrame:
        """Links of alike shingle sets among rows that no link has joined."""
        rows = scratch.keep(like_rows(joined.select("node", "sig", "root")))
        hashes = hashes_of(rows.selectExpr("node AS id_"))
        out = scratch.keep(like_links(rows.join(hashes, "node"), least))
        scratch.free(rows, hashes)
        return out

    def rooted(links: DataFrame) -> DataFrame:
        roots = components(links, scratch, count).withColumnRenamed("node", "n_")
        return sets.join(roots, F.expr("node = n_"), "left").selectExpr("node", "digest", "sig", "coalesce(root, node) AS root")

    met = checked(fingerprint_links(sets).unionByName(head_links(sets.selectExpr("node", "sig", "node AS root"))).distinct())
    joined = scratch.keep(rooted(met), count)
    rest = compared(joined)
    of = rooted(joined.selectExpr("node AS a", "root AS b").where("a <> b").unionByName(rest)).select("digest", F.col("root").alias("root_"))
    drop = scratch.keep(own.join(of, "digest").where("doc_id <> root_").select("doc_id").distinct(), own.count())
    scratch.free(own, sets, met, joined, rest)
    return without_ids(docs, drop)


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
