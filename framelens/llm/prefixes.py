"""Prefix trie of rebuilt conversations, from fingerprints that are composed and never from rebuilt texts.

A turn is a residue t modulo three primes, a conversation the products
P(j) = sum of t_i * B^i over its first j turns.  A rebuilt conversation has a
head of another one (its base) and its own turns from a place on, so the
fingerprint of each of its prefixes is P_base(d) or
P_base(h) + B^(h - from) * (P_own(j) - P_own(from)): two stored sums and a power.

1. Turns are put in order by ranges of (conversation, turn), which split a long
   conversation; sums inside a range get those of the ranges before.
2. Every prefix is a row of fingerprint, fingerprint of the prefix before it, and
   the reference (conversation, position) of its last turn, which holds no text.
3. Prefixes with one fingerprint and depth are a node.  A node is verified: all
   its members have one parent fingerprint, and where they refer to several
   turns, the texts at the references are compared.  If any node fails, all
   starts again with other residues.
4. A node belongs to its smallest member, which then owns all below it on its own
   path.  Sums over a subtree are sums, over the members, of what they own below:
   pre-aggregated totals instead of a walk over levels.
5. Ids of the conversations that end at a node are joined to strings range by
   range, and one task digests the strings of a node in order, batch by batch.

Defined cases: null role or text is empty; rows without conv_id belong to no
conversation; equal turn numbers are ordered by role and text; a base that is
absent has no head; a conversation without turns left is a member of the root
and ends there; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import running
from .common import Scratch, table
from .registry import query
from .runs import CRC_TABLE, crc_sql

PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (1103515245, 1220703125, 1664525039)
HEAD = 8
LANES = range(3)
NODE = ["depth", *(f"f{k}" for k in LANES)]
_DIGITS, _DIGIT = 6, 6


def _power(k: int, i: str) -> str:
    """B^i modulo the prime of a lane, by the digits of i in base 2^6."""
    out = "1L"
    for digit in range(_DIGITS):
        step = pow(BASES[k], 1 << (_DIGIT * digit), PRIMES[k])
        powers = ", ".join(f"{pow(step, e, PRIMES[k])}L" for e in range(1 << _DIGIT))
        out = f"({out} * get(array({powers}), CAST(shiftright({i}, {_DIGIT * digit}) & {(1 << _DIGIT) - 1} AS INT)) % {PRIMES[k]}L)"
    return out


def placed_turns(conversations: DataFrame, scratch: Scratch, seed: int = 0) -> DataFrame:
    """``(conv_id, pos, role, text, s0.., t0..)`` from a written table: position, sum of products up to the turn, and the turn's own product."""
    rows = conversations.where("conv_id IS NOT NULL").selectExpr("CAST(conv_id AS BIGINT) AS conv_id", "turn", "coalesce(role, '') AS role", "coalesce(text, '') AS text")
    order = ["conv_id", "turn", "role", "text"]
    parts = scratch.keep(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("part_", F.spark_partition_id()))
    counts = parts.groupBy("conv_id", "part_").count()
    before = "OVER (PARTITION BY conv_id ORDER BY part_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    starts = counts.selectExpr("conv_id", "part_", f"coalesce(sum(count) {before}, 0L) AS base_")
    placed = parts.selectExpr("*", "row_number() OVER (PARTITION BY conv_id, part_ ORDER BY turn NULLS FIRST, role, text) - 1 AS local_").join(starts, ["conv_id", "part_"]).withColumn("pos", F.expr("base_ + local_"))
    # a residue of 1 and more for each lane from two hashes of role and text
    hashed = placed.selectExpr("conv_id", "part_", "pos", "role", "text", f"xxhash64({seed}, role, text) AS a_", f"xxhash64({seed + 1}, text, role) AS b_")
    residue = ["pmod(a_, {p}L - 1) + 1", "pmod(b_, {p}L - 1) + 1", "pmod(a_ ^ shiftrightunsigned(b_, 31), {p}L - 1) + 1"]
    terms = hashed.selectExpr("*", *[f"({residue[k].format(p=PRIMES[k])}) * {_power(k, 'pos')} % {PRIMES[k]}L AS t{k}" for k in LANES])
    local = terms.selectExpr("*", *[f"sum(t{k}) OVER (PARTITION BY conv_id, part_ ORDER BY pos) AS l{k}" for k in LANES])
    sums = terms.groupBy("conv_id", "part_").agg(*[F.sum(f"t{k}").alias(f"n{k}") for k in LANES]).selectExpr(
        "conv_id", "part_", *[f"coalesce(sum(n{k}) {before}, 0L) AS o{k}" for k in LANES])
    done = local.join(sums, ["conv_id", "part_"]).selectExpr(
        "conv_id", "pos", "role", "text", *[f"(l{k} + o{k}) % {PRIMES[k]}L AS s{k}" for k in LANES], *[f"t{k}" for k in LANES])
    out = scratch.keep(done)
    scratch.free(parts)
    return out


def members(turns: DataFrame, base: str, head: str, scratch: Scratch) -> DataFrame:
    """A row for every prefix of every rebuilt conversation: ``conv_id``, node (``depth, f*``), parent's ``g*``, ``(ref_conv, ref_pos)`` and its ``bytes``, ``last``.

    ``base`` and ``head`` are SQL over ``conv_id``: the conversation of the head and the number of turns wanted of it, at most ``HEAD``.
    """
    narrow = turns.selectExpr("conv_id", "pos", "octet_length(text) AS bytes", *[f"s{k}" for k in LANES], *[f"t{k}" for k in LANES])
    heads = narrow.where(f"pos < {HEAD}").groupBy("conv_id").agg(F.expr(f"sort_array(collect_list(struct(pos, bytes, {', '.join(f's{k}' for k in LANES)})))").alias("first_"))
    convs = narrow.groupBy("conv_id").agg(F.count("*").alias("n")).join(heads, "conv_id").selectExpr("*", f"{base} AS base", f"CAST({head} AS INT) AS want")
    of = convs.selectExpr("conv_id AS base", "n AS base_n", "first_ AS base_first")
    at = "IF({n} = 0, 0L, get({rows}, {n} - 1).s{k})"
    inverse = [", ".join(f"{pow(BASES[k], -e, PRIMES[k])}L" for e in range(HEAD + 1)) for k in LANES]
    whole = (convs.join(of, "base", "left")
             .selectExpr("*", "CAST(least(want, coalesce(base_n, 0L)) AS INT) AS took", "CAST(least(want, n) AS INT) AS skipped")
             .selectExpr("*", *[f"{at.format(n='took', rows='base_first', k=k)} AS pb{k}" for k in LANES],
                         *[f"{at.format(n='skipped', rows='first_', k=k)} AS po{k}" for k in LANES],
                         *[f"get(array({inverse[k]}), want - took) AS m{k}" for k in LANES])
             .selectExpr("conv_id", "base", "n", "want", "took", "took + greatest(n - want, 0L) AS length", "base_first", *[f"m{k}" for k in LANES],
                         *[f"pmod(pb{k} - m{k} * po{k} % {PRIMES[k]}L, {PRIMES[k]}L) AS c{k}" for k in LANES]))
    whole = scratch.keep(whole)
    # the root and the head: sums of the base as they are
    up = [f"IF(depth = 0, 0L, get(base_first, depth - 1).s{k}) AS f{k}" for k in LANES] + [f"IF(depth < 2, 0L, get(base_first, depth - 2).s{k}) AS g{k}" for k in LANES]
    front = whole.selectExpr("*", "explode(sequence(0, took)) AS depth").selectExpr(
        "conv_id", "CAST(depth AS BIGINT) AS depth", *up, "base AS ref_conv", "CAST(depth - 1 AS BIGINT) AS ref_pos", "IF(depth = 0, 0, get(base_first, depth - 1).bytes) AS bytes", "depth = length AS last")
    # own turns: c + m * P, with and without the last product
    own = narrow.join(whole.where("n > want").drop("base_first"), "conv_id").where("pos >= want")
    rear = own.selectExpr("conv_id", "took + pos - want + 1 AS depth", *[f"(c{k} + m{k} * s{k}) % {PRIMES[k]}L AS f{k}" for k in LANES],
                          *[f"(c{k} + m{k} * pmod(s{k} - t{k}, {PRIMES[k]}L)) % {PRIMES[k]}L AS g{k}" for k in LANES],
                          "conv_id AS ref_conv", "pos AS ref_pos", "bytes", "took + pos - want + 1 = length AS last")
    out = scratch.keep(front.unionByName(rear))
    scratch.free(whole)
    return out


def _grouped(rows: DataFrame) -> DataFrame:
    same = [F.min(c).alias(f"lo_{c}") for c in ("g0", "g1", "g2", "ref_conv", "ref_pos")] + [F.max(c).alias(f"hi_{c}") for c in ("g0", "g1", "g2", "ref_conv", "ref_pos")]
    return rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), *same)


def differing(rows: DataFrame, nodes: DataFrame, turns: DataFrame) -> int:
    """Number of nodes whose members are not equal: several parents, or references to different turns."""
    parents = nodes.where("depth > 0 AND (lo_g0 <> hi_g0 OR lo_g1 <> hi_g1 OR lo_g2 <> hi_g2)").count()
    several = nodes.where("depth > 0 AND (lo_ref_conv <> hi_ref_conv OR lo_ref_pos <> hi_ref_pos)").select(*NODE)
    refs = rows.select(*NODE, "ref_conv", "ref_pos").distinct().join(several, NODE)
    texts = refs.join(turns.selectExpr("conv_id AS ref_conv", "pos AS ref_pos", "role", "text"), ["ref_conv", "ref_pos"])
    unlike = texts.groupBy(*NODE).agg(F.min("role").alias("r"), F.max("role").alias("r2"), F.min("text").alias("x"), F.max("text").alias("x2")).where("r <> r2 OR x <> x2")
    return parents + unlike.count()


def list_digests(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """SHA-256 of each key's values as decimal text, ascending and comma-joined.

    Ranges of (keys, value) are joined to strings where they lie, a string for a
    key and batch; the strings of a key then pass through one running digest.
    """
    n = len(keys)

    def joined(batches):
        for b in batches:
            if not len(b):
                continue
            of = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[:n]])
            cut = np.concatenate([[0], np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0)) + 1])
            texts = pa.ListArray.from_arrays(pa.array(np.append(cut, len(b)), pa.int32()), b.column(n).cast(pa.string()))
            yield pa.record_batch([*(c.take(pa.array(cut)) for c in b.columns), pc.binary_join(texts, ",")], [*keys, "low_", "joined_"])

    def digested(batches):
        now, state = None, None
        for b in batches:
            done = []
            for *key, _, text in zip(*(c.to_pylist() for c in b.columns)):
                if key != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if done:
                yield pa.record_batch([pa.array(c) for c in zip(*done)], [*keys, "sha256"])
        if now is not None:
            yield pa.record_batch([pa.array([c]) for c in (*now, state.hexdigest())], [*keys, "sha256"])

    kinds = ", ".join(f"{k} bigint" for k in keys)
    narrow = rows.select(*[F.col(c).cast("bigint") for c in [*keys, value]])
    strings = narrow.repartitionByRange(*keys, value).sortWithinPartitions(*keys, value).mapInArrow(joined, f"{kinds}, low_ bigint, joined_ string")
    return strings.repartition(*keys).sortWithinPartitions(*keys, "low_").mapInArrow(digested, f"{kinds}, sha256 string")


def trie(conversations: DataFrame, base: str = "conv_id", head: str = "0", least_seed: int = 0) -> DataFrame:
    """A row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``, and ``ref_conv, ref_pos`` of its last turn."""
    scratch = Scratch(conversations.sparkSession)
    seed = least_seed
    while True:
        turns = placed_turns(conversations, scratch, seed)
        rows = members(turns, base, head, scratch)
        nodes = scratch.keep(_grouped(rows))
        if not differing(rows, nodes, turns):
            break
        scratch.free(turns, rows, nodes)
        seed += 2
    kids = nodes.where("depth > 0").groupBy(F.expr("depth - 1").alias("depth"), *[F.col(f"lo_g{k}").alias(f"f{k}") for k in LANES]).agg(F.count("*").alias("n_children"))
    known = scratch.keep(nodes.join(kids, NODE, "left").selectExpr(
        *NODE, "conv_id", "n_convs", "coalesce(n_children, 0L) AS n_children", "(n_convs - 1) * bytes AS weight", *[f"lo_g{k} AS g{k}" for k in LANES],
        "lo_ref_conv AS ref_conv", "IF(depth = 0, NULL, lo_ref_pos) AS ref_pos"))
    owned = scratch.keep(known.groupBy("conv_id").agg(F.sum("weight").alias("weight"), F.sum(F.expr("IF(n_children = 0, 1L, 0L)")).alias("leaves"), F.min("depth").alias("top")))
    below = rows.select("conv_id", *NODE).join(owned.where("weight > 0 OR leaves > 0").drop("top"), "conv_id").groupBy(*NODE).agg(
        F.sum("weight").alias("all_"), F.sum("leaves").alias("n_leaves"))
    # of the owner's total only what lies at or below the node counts
    spent = running(known, ["conv_id"], "depth", "weight", "sum", "spent_", inclusive=False).join(below, NODE, "left").join(owned.select("conv_id", "top"), "conv_id")
    summed = scratch.keep(spent.selectExpr(*NODE, "conv_id", "n_convs", "n_children", "coalesce(n_leaves, 0L) AS n_leaves", "coalesce(all_, 0L) - spent_ AS saved_tokens",
                                           "top", "g0", "g1", "g2", "ref_conv", "ref_pos"))
    # a node under another owner asks its parent for it; the parent of depth 1 is the one root
    root = known.where("depth = 0").first()
    parents = known.selectExpr("depth + 1 AS depth", *[f"f{k} AS g{k}" for k in LANES], "conv_id AS parent_conv_id").where("depth > 1")
    tops = summed.where("depth = top AND depth > 1").join(parents, ["depth", "g0", "g1", "g2"]).select(*summed.columns, "parent_conv_id")
    rest = summed.where("depth <> top OR depth <= 1").selectExpr(
        "*", f"CASE WHEN depth = 0 THEN NULL WHEN depth = 1 THEN {'NULL' if root is None else root['conv_id']} ELSE conv_id END AS parent_conv_id")
    ends = list_digests(rows.where("last").select(*NODE, "conv_id"), NODE, "conv_id")
    nothing = hashlib.sha256(b"").hexdigest()
    out = scratch.keep(tops.unionByName(rest).join(ends, NODE, "left").selectExpr(
        "conv_id", "depth", "CAST(parent_conv_id AS BIGINT) AS parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        f"coalesce(sha256, '{nothing}') AS ends_sha256", "ref_conv", "ref_pos"))
    scratch.free(turns, rows, nodes, known, owned, summed)
    return out


SQL = f"""
WITH o AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS w
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
g AS (SELECT c, w, {crc_sql('c')} % 9 AS h FROM o, {CRC_TABLE}),
r AS (SELECT a.c, list_concat(coalesce(b.w[1:a.h], []), coalesce(a.w[a.h + 1:], [])) AS s FROM g a LEFT JOIN o b ON b.c = a.c - a.c % 5),
p AS (SELECT c, d, s[1:d] AS k, d = len(s) AS last FROM r, unnest(range(0, len(s) + 1)) t(d)),
n AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '') AS ends FROM p GROUP BY k, d),
kid AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(n.k[n.d].x)) END AS weight FROM n LEFT JOIN kid USING (k, d)),
sub AS (SELECT k[1:e] AS k, e AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(weight) AS saved FROM m, unnest(range(0, d + 1)) t(e) GROUP BY ALL)
SELECT m.conv_id, m.d AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, sub.n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN sub USING (k, d) LEFT JOIN n up ON up.d = m.d - 1 AND up.k = m.k[1:m.d - 1]"""


@query("op13_prefixes", SQL)
def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of conversations rebuilt with heads of others."""
    found = trie(table(spark, sf_dir, "conversations"), base="conv_id - conv_id % 5", head="crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % 9")
    return found.drop("ref_conv", "ref_pos")
