"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found with a block-max inverted index.

Terms are words and word beginnings of four to six letters.  Labelled rows (a
bounded sample, ``SAMPLE`` per label) say which terms go with a label; only
these are kept, so that a few telling words in a long text count.  Document
frequencies of the kept terms cover all documents.  The examples are indexed by
term in blocks with the largest weight of each block; blocks whose bound is
below the k-th best cosine are skipped, which loses nothing.  The votes of the
nearest examples, weighted by cosine, are calibrated on the examples themselves,
each without its own vote.

Defined cases: null text is the empty text; a text without kept terms gets the
share of toxic labels as its score; rows without doc_id are scored and not held
out; several labels of one doc_id count as toxic if one does; without labels of
both kinds every score is that share (0 if there are none); repeated rows are
scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, without_ids
from .registry import query

SAMPLE = 4096
MAX_TERMS = 4096
LEAST_DOCS, LEAST_RATIO, LEAST_G2 = 5, 8.0, 25.0
NEIGHBOURS, BLOCK, CALM = 16, 64, 0.5
PREFIXES = (4, 5, 6)
STRIP = ".,;:!?\"'()[]{}<>*_-|"
CACHED_WORDS = 1 << 18


def terms_of(word: str) -> list[str]:
    """A word and its beginnings; a beginning is marked by a star."""
    w = word.strip(STRIP)
    return [w, *(w[:k] + "*" for k in PREFIXES if len(w) > k)] if len(w) > 1 else []


def held_out_sql(parts: int) -> str:
    return f"crc32(CAST(doc_id AS STRING)) % {parts} = 0"


def training_labels(labels: DataFrame, held_out: str, sample: int = SAMPLE) -> tuple[DataFrame, float]:
    """A bounded, repeatable sample of labelled ids (``id_, toxic``), and the share of toxic ones among all."""
    known = labels.where(f"doc_id IS NOT NULL AND toxic IS NOT NULL AND NOT {held_out}").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.selectExpr("count(*)", "count_if(toxic = 1)").first()
    order = ["xxhash64(doc_id)", "doc_id"]
    picked = [known.where(w).orderBy(*map(F.expr, order)).limit(sample) for w in ("toxic = 1", "toxic <> 1")]
    return picked[0].unionAll(picked[1]).selectExpr("doc_id AS id_", "CAST(toxic = 1 AS INT) AS toxic"), (n_toxic / n if n else 0.0)


def select_terms(docs: DataFrame, sample: DataFrame) -> list[str]:
    """Terms that go with one label, by the likelihood ratio of their document counts."""
    def count(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
                counts[toxic].update({t for w in set((text.as_py() or "").lower().split()) for t in terms_of(w)})
        names = list(counts[0] | counts[1])
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([counts[0][t] for t in names], pa.int64()),
                               pa.array([counts[1][t] for t in names], pa.int64())], ["term", "clean", "toxic"])

    n_clean, n_toxic = sample.selectExpr("count_if(toxic = 0)", "count_if(toxic = 1)").first()
    if not n_clean or not n_toxic:
        return []
    both = docs.select("doc_id", "text").join(F.broadcast(sample), F.expr("doc_id = id_"))  # at most 2 * SAMPLE ids
    counts = (both.select("text", "toxic").mapInArrow(count, "term string, clean long, toxic long")
              .groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")))
    n = n_clean + n_toxic
    expected = [("c", f"(c + t) * {n_clean}D / {n}"), ("t", f"(c + t) * {n_toxic}D / {n}")]
    g2 = "2 * (" + " + ".join(f"IF({o} > 0, {o} * ln({o} / ({e})), 0)" for o, e in expected) + ")"
    ratio = f"((t + 0.5) / {n_toxic + 1}) / ((c + 0.5) / {n_clean + 1})"
    best = (counts.where(f"c + t >= {LEAST_DOCS}").selectExpr("term", f"{g2} AS g2", f"{ratio} AS ratio")
            .where(f"g2 >= {LEAST_G2} AND (ratio >= {LEAST_RATIO} OR ratio <= {1 / LEAST_RATIO})")
            .orderBy(F.desc("g2"), "term").limit(MAX_TERMS))
    return sorted(r.term for r in best.select("term").collect())


def with_hits(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``(doc_id, terms, tf)`` per row: numbers and counts of the kept terms in the whole text."""
    number = {t: i for i, t in enumerate(terms)}

    def run(batches):
        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            for at in range(0, len(b), 256):  # few texts at a time as Python objects
                part = b.slice(at, 256)
                ids, tfs = [], []
                for text in part.column(1).to_pylist():
                    words = (text or "").lower().split()
                    hits: Counter = Counter()
                    for w in set(words):
                        t = known.get(w)
                        if t is None:
                            if len(known) >= CACHED_WORDS:
                                known.clear()
                            t = known[w] = tuple(number[x] for x in terms_of(w) if x in number)
                        if t:
                            n = words.count(w)
                            for x in t:
                                hits[x] += n
                    found = sorted(hits)
                    ids.append(found)
                    tfs.append([hits[x] for x in found])
                yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "terms", "tf"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, terms array<int>, tf array<int>")


def unit(terms: list[int], tf: list[int], idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(np.asarray(tf, np.float64))) * idf[terms]
    return w / np.sqrt(w @ w)


class BlockMaxIndex:
    """Examples in blocks; per term the postings of each block and the block's largest weight."""

    def __init__(self, vectors: list[tuple[list[int], np.ndarray]], n_terms: int, block: int = BLOCK):
        self.block, self.n = block, len(vectors)
        self.n_blocks = -(-len(vectors) // block)
        self.top = np.zeros((n_terms, self.n_blocks))
        postings: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for i, (terms, weights) in enumerate(vectors):
            for t, w in zip(terms, weights):
                postings.setdefault((t, i // block), []).append((i % block, w))
                self.top[t, i // block] = max(self.top[t, i // block], w)
        self.postings = {k: (np.array([i for i, _ in v]), np.array([w for _, w in v])) for k, v in postings.items()}

    def nearest(self, terms: list[int], weights: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k best ``(cosine, example)`` with a cosine above zero, best first, smaller numbers first among equals."""
        bound = weights @ self.top[terms]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(best) == k and bound[b] < best[-1][0] - 1e-12):
                break
            score = np.zeros(self.block)
            for t, w in zip(terms, weights):
                if (p := self.postings.get((t, int(b)))) is not None:
                    score[p[0]] += w * p[1]
            found = [(float(score[i]), int(b) * self.block + int(i)) for i in np.flatnonzero(score > 0)]
            best = sorted([*best, *(x for x in found if x[1] != without)], key=lambda x: (-x[0], x[1]))[:k]
        return best


def vote(near: list[tuple[float, int]], toxic: np.ndarray, count: np.ndarray, prior: float) -> float:
    """Share of toxic votes, each weighted by cosine and by how many examples it stands for; the prior has ``CALM`` votes."""
    at = [i for _, i in near]
    w = np.array([c for c, _ in near]) * np.minimum(count[at], NEIGHBOURS)
    return float((w @ (toxic[at] / count[at]) + CALM * prior) / (w.sum() + CALM))


def platt(votes: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the votes (weighted Newton steps with a small ridge; the slope is positive)."""
    x = np.stack([np.log(votes / (1 - votes)), np.ones(len(votes))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (n * (y - p)) - 0.1 * (beta - [1.0, 0.0])
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
    return max(float(beta[0]), 1e-3), float(beta[1])


def score(docs: DataFrame, labels: DataFrame, held_out: str, sample: int = SAMPLE) -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted, nearest`` (ids of the nearest examples) ``, evidence`` (terms in the text that count most)."""
    scratch = Scratch(docs.sparkSession)
    picked, prior = training_labels(labels, held_out, sample)
    picked = scratch.keep(picked)
    terms = select_terms(docs, picked)
    hits = scratch.keep(with_hits(docs, terms))
    n_docs = hits.count()
    df = {r.t: r.n for r in hits.selectExpr("explode(terms) AS t").groupBy("t").agg(F.count("*").alias("n")).collect()}  # at most MAX_TERMS
    idf = np.array([math.log1p(n_docs / max(1, df.get(i, 0))) for i in range(len(terms))])
    # examples with one vector are one entry; at most 2 * SAMPLE of them
    examples = (hits.join(F.broadcast(picked), F.expr("doc_id = id_")).where("size(terms) > 0").groupBy("terms", "tf")
                .agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.min("id_").alias("id")).orderBy("terms", "tf").collect())
    vectors = [(list(e.terms), unit(list(e.terms), list(e.tf), idf)) for e in examples]
    index = BlockMaxIndex(vectors, len(terms))
    count, toxic, ids = (np.array([e[c] for e in examples]) for c in ("n", "toxic", "id"))
    curve = (1.0, 0.0)
    if len(examples) > 1:
        own = np.array([vote(index.nearest(*v, NEIGHBOURS, without=i) if count[i] == 1 else index.nearest(*v, NEIGHBOURS), toxic, count, prior)
                        for i, v in enumerate(vectors)])
        curve = platt(np.clip(own, 1e-6, 1 - 1e-6), toxic / count, count)

    def run(batches):
        seen: dict[tuple, tuple] = {}
        for b in batches:
            out = []
            for t, tf in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                key = (tuple(t), tuple(tf))
                if key not in seen:
                    if len(seen) >= 1 << 16:
                        seen.clear()
                    seen[key] = one(t, tf)
                out.append(seen[key])
            p, near, why = zip(*out) if out else ((), (), ())
            yield pa.record_batch([b.column(0), pa.array(p, pa.float64()), pa.array(near, pa.list_(pa.int64())), pa.array(why, pa.list_(pa.string()))],
                                  ["doc_id", "score", "nearest", "evidence"])

    def one(t, tf):
        if not t:
            return prior, [], []
        v = unit(t, tf, idf)
        near = index.nearest(t, v, NEIGHBOURS)
        if not near:
            return prior, [], []
        p = min(max(vote(near, toxic, count, prior), 1e-6), 1 - 1e-6)
        p = 1 / (1 + math.exp(-min(max(curve[0] * math.log(p / (1 - p)) + curve[1], -30), 30)))
        return p, [int(ids[i]) for _, i in near[:3]], [terms[t[i]] for i in np.argsort(-v, kind="stable")[:3]]

    id_type = hits.schema["doc_id"].dataType.simpleString()
    scored = hits.mapInArrow(run, f"doc_id {id_type}, score double, nearest array<long>, evidence array<string>")
    return scored.selectExpr("doc_id", f"coalesce({held_out}, false) AS held_out", "score", "CAST(score >= 0.5 AS INT) AS predicted", "nearest", "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, held_out: str) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    gone = score(docs, labels, held_out).where("predicted = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    # written, so that Spark knows how few they are before it deals the texts
    return without_ids(docs, Scratch(docs.sparkSession).keep(gone))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels of every fifth id (by checksum) are never read."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out_sql(5))
