"""Repeated long passages removed: word k-mers as edges, compacted paths, verified source coordinates.

A window of ``WINDOW`` words is an edge of the graph of its word sequences.

1. Every document lists the minimisers of its windows: the smallest hash among
   the shorter k-mers inside a window, which depends on the window's words
   alone, so equal windows list equal minimisers.  About one word in thirteen
   starts a new one.
2. A pre-aggregated minimum and maximum of doc_id tells which minimisers occur in
   two documents; only windows with such a minimiser become edge rows
   ``(h, check, doc_id, pos)``, where check is a digest of the window's words
   themselves.
3. The first source of an edge is the smallest doc_id that has it; a join gives
   every later occurrence its source coordinate, verified by both digests.
   Occurrences whose next edge is also the next edge of the same source lie on
   one nonbranching path and are compacted to one span.
4. The spans are joined to the texts and their words leave.

Documents whose whole word sequence occurs under a smaller doc_id need no edges.

Defined cases: null text has no words; a row without doc_id loses nothing and is
no source; rows that share a doc_id are no sources for each other; a document
shorter than a window loses nothing; other columns are kept as they are; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, tidy
from .registry import query

WINDOW, KMER = 50, 25
SLICE = 128
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    inverse = pow(base, -1, 1 << 64)
    return tuple(np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(max(n - 1, 0), b, np.uint64))])[:n] for b in (base, inverse))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads nearby ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of the slices [start, end) of a sequence from prefix sums of value * base^position."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def hashes(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.up) < len(values) + 1:
            self.up, self.down = _powers(self.base, 2 * len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[:len(values)], out=sums[1:])
        return mixed((sums[end] - sums[start]) * self.down[start])


class WindowHashes:
    """Word, window and minimiser hashes of several texts at a time."""

    def __init__(self, window: int = WINDOW, kmer: int = KMER):
        self.window, self.kmer = window, kmer
        self.bytes, self.words = Rolling(_BYTE_BASE), Rolling(_WORD_BASE)

    def split(self, texts: list[bytes]):
        """Hash of every word, and the number of words of each text."""
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        if not len(data):
            return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
        inside = ~_SPACE[data]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        counts = np.diff(np.searchsorted(start, first))
        return self.bytes.hashes(data.astype(np.uint64) + np.uint64(1), start, end), counts

    def _starts(self, counts: np.ndarray, length: int):
        """Numbers of the words where a run of ``length`` words of one text starts."""
        ends = np.cumsum(counts)
        keep = np.ones(int(counts.sum()), bool)
        for e, c in zip(ends.tolist(), counts.tolist()):
            keep[e - min(c, length - 1):e] = False
        return np.flatnonzero(keep)

    def minimisers(self, words: np.ndarray, counts: np.ndarray):
        """Start of every window (as a word number) and the smallest k-mer hash in it."""
        at = self._starts(counts, self.window)
        if not len(at):
            return at, np.empty(0, np.uint64)
        s = np.arange(len(words) - self.kmer + 1)
        low = self.words.hashes(words, s, s + self.kmer)
        wide, span = 1, self.window - self.kmer + 1
        while 2 * wide <= span:
            low = np.minimum(low[:-wide], low[wide:])
            wide *= 2
        if span > wide:
            low = np.minimum(low[:-(span - wide)], low[span - wide:])
        return at, low[at]

    def edges(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.words.hashes(words, at, at + self.window)


def _keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with ``tkey``, which tells rows that share a doc_id by their text; 0 where the doc_id stands alone, so that it costs nothing to move."""
    # written: next to none, so texts need not be dealt by id for it
    again = scratch.keep(docs.groupBy(F.col("doc_id").alias("again_")).count().where("count > 1 AND again_ IS NOT NULL").select("again_"))
    return docs.join(again, F.expr("doc_id = again_"), "left").withColumn("tkey", F.expr("IF(again_ IS NULL, 0L, xxhash64(coalesce(text, '')))")).drop("again_")


def _profiles(keyed: DataFrame, window: int, kmer: int) -> DataFrame:
    """Per row: doc_id, text key, number of words, digest of the word sequence, distinct minimisers."""
    def run(batches):
        hashes = WindowHashes(window, kmer)
        for b in batches:
            for o in range(0, len(b), SLICE):
                part = b.slice(o, SLICE)
                texts = [t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()]
                words, counts = hashes.split(texts)
                at, low = hashes.minimisers(words, counts)
                cut = np.searchsorted(at, np.cumsum(counts))[:-1]
                mins = [np.unique(x).view(np.int64) for x in np.split(low, cut)]
                digests = [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() for t in texts]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(counts, pa.int32()), pa.array(digests, pa.binary()),
                                       pa.array(mins, pa.list_(pa.int64()))], ["doc_id", "tkey", "n", "digest", "mins"])

    rows = keyed.where("doc_id IS NOT NULL").select("doc_id", "tkey", "text")
    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, tkey long, n int, digest binary, mins array<long>")


def _edges(keyed: DataFrame, wanted: DataFrame, window: int, kmer: int) -> DataFrame:
    """Edge rows of the windows whose minimiser is in the document's ``mins``."""
    def run(batches):
        hashes = WindowHashes(window, kmer)
        for b in batches:
            for o in range(0, len(b), SLICE):
                part = b.slice(o, SLICE)
                texts = [t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()]
                words, counts = hashes.split(texts)
                at, low = hashes.minimisers(words, counts)
                first = np.concatenate([[0], np.cumsum(counts)])
                doc = np.searchsorted(first, at, side="right") - 1
                cut = np.searchsorted(at, first)
                keep = np.zeros(len(at), bool)
                for d, mins in enumerate(part.column(3)):
                    s = slice(cut[d], cut[d + 1])
                    keep[s] = np.isin(low[s], mins.values.to_numpy().view(np.uint64))
                at, doc = at[keep], doc[keep]
                # digests of the words themselves, read from the text with one space between words
                checks = np.empty(len(at), np.uint64)
                k = 0
                for d in np.unique(doc).tolist():
                    own = texts[d].split()
                    joined = b" ".join(own)
                    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
                    starts = np.concatenate([[0], ends[:-1] + 1])
                    pos = at[np.searchsorted(doc, d):np.searchsorted(doc, d, side="right")] - first[d]
                    for x, y in zip(starts[pos].tolist(), ends[pos + window - 1].tolist()):
                        checks[k] = xxhash.xxh64_intdigest(joined[x:y])
                        k += 1
                yield pa.record_batch([pa.array(hashes.edges(words, at).view(np.int64)), pa.array(checks.view(np.int64)), part.column(0).take(pa.array(doc)),
                                       part.column(1).take(pa.array(doc)), pa.array((at - first[doc]).astype(np.int32))], ["h", "check", "doc_id", "tkey", "pos"])

    asked = keyed.where("doc_id IS NOT NULL").select("doc_id", "tkey", "text").join(wanted, ["doc_id", "tkey"])
    return asked.select("doc_id", "tkey", "text", "mins").mapInArrow(
        tidy(run), f"h long, check long, doc_id {asked.schema['doc_id'].dataType.simpleString()}, tkey long, pos int")


def repeated_spans(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """``(doc_id, tkey, first, last)``: arrays of the first and last word of each compacted span that repeats a smaller doc_id."""
    scratch = Scratch(docs.sparkSession)
    keyed = _keyed(docs.select("doc_id", "text"), scratch)
    own = scratch.keep(_profiles(keyed, window, kmer))
    # whole copies: everything is covered
    firsts = own.where(f"n >= {window}").groupBy("digest").agg(F.min("doc_id").alias("first_"), F.count("*").alias("n_")).where("n_ > 1").drop("n_")
    copies = scratch.keep(own.where(f"n >= {window}").select("doc_id", "tkey", "n", "digest").join(firsts, "digest").where("doc_id > first_")
                          .select("doc_id", "tkey", "n").distinct(), own.count())
    left = own.join(copies.select("doc_id", "tkey"), ["doc_id", "tkey"], "left_anti").where("size(mins) > 0")
    listed = left.selectExpr("doc_id", "tkey", "explode(mins) AS m")
    # written, as are the sources below, so that both sides of the join are dealt anew and a hot key can be split
    shared = scratch.keep(listed.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("m"))
    wanted = listed.join(shared, "m").groupBy("doc_id", "tkey").agg(F.collect_list("m").alias("mins"))
    edges = scratch.keep(_edges(keyed, wanted, window, kmer))
    scratch.free(own, shared)
    sources = scratch.keep(edges.groupBy("h", "check").agg(F.min("doc_id").alias("src"), F.max("doc_id").alias("last_"), F.min_by("pos", "doc_id").alias("src_pos"))
                           .where("src < last_").drop("last_"))
    later = edges.join(sources, ["h", "check"]).where("doc_id > src")
    # an occurrence continues the path of the one before it if their source does
    line = "PARTITION BY doc_id, tkey ORDER BY pos"
    steps = later.selectExpr("doc_id", "tkey", "pos", f"IF(lag(pos) OVER ({line}) = pos - 1 AND lag(src) OVER ({line}) = src AND lag(src_pos) OVER ({line}) = src_pos - 1, 0, 1) AS new_")
    paths = steps.selectExpr("doc_id", "tkey", "pos", f"sum(new_) OVER ({line}) AS path").groupBy("doc_id", "tkey", "path").agg(
        F.min("pos").alias("a"), F.expr(f"max(pos) + {window - 1}").alias("b"))
    spans = paths.groupBy("doc_id", "tkey").agg(F.collect_list("a").alias("first"), F.collect_list("b").alias("last"))
    out = scratch.keep(spans.unionByName(copies.selectExpr("doc_id", "tkey", "array(0) AS first", "array(n - 1) AS last")))
    scratch.free(edges, copies, sources)
    return out


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of ``docs`` in a struct ``row`` with their text less the words of the spans, and ``n_words, n_removed, kept_sha256``.

    A text that loses nothing is not altered.
    """
    def run(batches):
        for b in batches:
            row, text, first, last = (b.column(i) for i in range(4))
            out, n_words, n_removed, sha = [], [], [], []
            for t, f, x in zip(text, first, last):
                t = t.as_py()
                words = (t or "").encode().split()
                n = len(words)
                if f.is_valid:
                    cover = np.zeros(n + 1, np.int64)
                    np.add.at(cover, f.values.to_numpy(), 1)
                    np.add.at(cover, x.values.to_numpy() + 1, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:n]) == 0)]
                kept = b" ".join(words)
                out.append(kept.decode() if len(words) < n else t)
                n_words.append(n)
                n_removed.append(n - len(words))
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.record_batch([row, pa.array(out, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())],
                                  ["row", "text", "n_words", "n_removed", "kept_sha256"])

    others = [f"`{c}`" for c in docs.columns if c != "text"]
    keys = _keyed(docs.selectExpr(f"struct({', '.join(others)}) AS row", "doc_id", "text"), Scratch(docs.sparkSession))
    keyed = keys.selectExpr("row", "text", "doc_id AS d_", "tkey AS t_")
    joined = keyed.join(spans, F.expr("d_ = doc_id AND t_ = tkey"), "left").select("row", "text", "first", "last")
    kinds = joined.schema
    return joined.mapInArrow(tidy(run), f"row {kinds['row'].dataType.simpleString()}, text string, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages taken out of ``text``; every row and column stays."""
    done = without_spans(docs, repeated_spans(docs))
    return done.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM d, unnest(range(1, len(w) - {WINDOW - 2})) t(i) WHERE len(w) >= {WINDOW}),
f AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
bad AS (SELECT doc_id, i FROM win JOIN f USING (s) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
cov AS (SELECT word.doc_id, x, k, coalesce(max(bad.i) OVER (PARTITION BY word.doc_id ORDER BY k ROWS UNBOUNDED PRECEDING), -1000) >= k - {WINDOW - 1} AS gone
  FROM word LEFT JOIN bad ON bad.doc_id = word.doc_id AND bad.i = k),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY k) FILTER (NOT gone), '') AS t FROM cov GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


@query("op6_substrings", SQL)
def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document keeps when passages repeated from smaller ids leave."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_spans(docs, repeated_spans(docs)).selectExpr("row.doc_id AS doc_id", "n_words", "n_removed", "kept_sha256")
