"""Language-model scores of whole documents: a gated recurrent model over exact corpus counts.

Word counts of all training documents are added up by Spark.  The most frequent
words (``CLASSES * PLACES`` of them) are predicted one by one, in classes of
equal size by frequency; every other word belongs to a rare class by its last
letters, and has there the share of its count:
(c + 0.1) / sum over the class of (c + 0.1), with one place for unseen words.

Each token's count is needed in the scan.  The ``HEAD`` most frequent words
travel with the tasks (a bounded table); the others are listed by the scan, a row per
document and word, which is joined with the counts and summed by document.

The first predictions of the network are the corpus counts of all training
documents.  It then learns from all of them, in ``ROUNDS`` passes over shards of about
``SHARD_BYTES``, whose number grows with the rows; Spark adds up the parameters of
the shards, and the mean starts the next round.

Defined cases: null text is the empty text, which is one end token; rows without
doc_id are held in; repeated rows are scored each; with no training document
every count is 0; other columns are not looked at; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gru
from .common import Scratch, table
from .registry import query

HEAD = 1 << 18
CLASSES, PLACES, RARE, HIDDEN = 16, 32, 48, 16
SHARD_BYTES, SHARDS, ROUNDS, RATE = 1 << 23, 4, 1, 0.02
UNIT = float(1 << 32)  # parameters are added up as whole multiples of 1 / UNIT, so that no order of addition shows
ALPHA = 0.1
SLICE = 256
_KEY = "xxhash64(doc_id, coalesce(text, ''))"


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def rare_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % RARE


def held_out_sql(parts: int) -> str:
    return f"coalesce(crc32(CAST(doc_id AS STRING)) % {parts} = 0, false)"


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, rare, c)`` over all rows; a task sends each of its words once per ``FLUSH`` distinct ones."""
    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for at in range(0, len(b), SLICE):
                counts.update(chain.from_iterable(map(tokens, b.column(0).slice(at, SLICE).cast(pa.binary()).to_pylist())))
                if len(counts) >= 1 << 19:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    def rows(counts):
        return pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

    sums = docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    return sums.selectExpr("word", f"CAST(crc32(substring(word, -3, 3)) % {RARE} AS INT) AS rare", "c")


def head_words(counts: DataFrame, head: int) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words with their counts, at most ``head`` of them, by count and then by word.

    A histogram of the logarithms of the counts (a row per sixteenth of a doubling)
    gives the count from which the words fit; a filter then finds them, so no task
    sees more than its own share of the words.
    """
    level = "CAST(floor(log2(c) * 16) AS INT)"
    sizes = sorted(((r.level, r["count"]) for r in counts.groupBy(F.expr(f"{level} AS level")).count().collect()), reverse=True)
    least, n = None, 0
    for at, size in sizes:
        if n + size > head:
            break
        least, n = at, n + size
    if least is None:
        return [], np.empty(0)
    top = counts.where(f"{level} >= {least}").select("word", "c").toArrow()
    rows = sorted(zip(top.column("word").to_pylist(), top.column("c").to_pylist()), key=lambda r: (-r[1], r[0]))
    return [w for w, _ in rows], np.array([c for _, c in rows], np.float64)


class Vocabulary:
    """Counts of the head words, places of the frequent ones and masses of the rare classes."""

    def __init__(self, words: list[bytes], counts: np.ndarray, ends: int, rare_mass: np.ndarray):
        frequent = CLASSES * PLACES - 1
        self.logs = np.log10(np.asarray(counts, np.float64) + ALPHA)
        self.number = {w: i for i, w in enumerate(words)}
        # the end token and the most frequent words, in order of frequency, PLACES to a class
        model = [("", ends), *zip(words[:frequent], counts[:frequent])]
        model.sort(key=lambda x: -x[1])
        self.end = next(i for i, x in enumerate(model) if x[0] == "")
        place_of = {w: i for i, (w, _) in enumerate(model) if w != ""}
        # number of a head word -> model number (its own, or that of its rare class)
        self.model = np.array([place_of.get(w, CLASSES * PLACES + rare_class(w)) for w in words] + [0], np.int32)
        self.rare_mass = rare_mass
        self.rare_of: dict[bytes, int] = {}
        freq = np.zeros(CLASSES * PLACES)
        freq[:len(model)] = [c + ALPHA for _, c in model]
        logs = np.log(np.maximum(freq, 1e-9)).reshape(CLASSES, PLACES)
        mass = np.concatenate([freq.reshape(CLASSES, PLACES).sum(axis=1), rare_mass])
        self.class_log = np.log(np.maximum(mass, 1e-9) / mass.sum())
        self.word_log = logs - np.log(np.maximum(freq.reshape(CLASSES, PLACES).sum(axis=1, keepdims=True), 1e-9))

    def read(self, words: list[bytes]):
        """Model numbers of the words and the end; head numbers (-1 for tail words)."""
        head = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        model = np.append(self.model[head], self.end)
        tail = np.flatnonzero(head < 0)
        if len(tail):
            ends, known = [words[i][-3:] for i in tail.tolist()], self.rare_of
            known.update((e, CLASSES * PLACES + rare_class(e)) for e in set(ends) - known.keys())
            model[tail] = [known[e] for e in ends]
        return model, head

    def read_texts(self, texts: list[list[bytes]]):
        """Words of the texts one behind the other, their head numbers, the model numbers with an end after each text, and tokens per text."""
        words, n = list(chain.from_iterable(texts)), np.fromiter(map(len, texts), np.int64, len(texts))
        model, head = self.read(words)
        return words, head, np.insert(model[:-1], np.cumsum(n), self.end), n + 1

    def sequence(self, model: np.ndarray):
        """Inputs (the token before, the end first), classes and places; an end goes before each text but the first anyway."""
        frequent = model < CLASSES * PLACES
        cls = np.where(frequent, model // PLACES, model - CLASSES * PLACES + CLASSES)
        return np.concatenate([[self.end], model[:-1]]), cls.astype(np.int64), np.where(frequent, model % PLACES, 0).astype(np.int64)


def train(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters after rounds of one local pass per shard and averaging."""
    p = gru.start(np.random.default_rng(7), CLASSES * PLACES + RARE, HIDDEN, vocab.class_log, vocab.word_log)
    size = docs.agg(F.expr("sum(octet_length(text))")).first()[0] or 0
    shards = max(SHARDS, math.ceil(size / SHARD_BYTES))
    # a number given is not coalesced: shards that are small in bytes are long in work
    dealt = docs.selectExpr("text", f"CAST(pmod(xxhash64({_KEY}, 1), {shards}) AS INT) AS shard").repartition(shards, "shard")

    def learner(p, k):
        def learn(rows: pd.DataFrame) -> pd.DataFrame:
            *_, model, n = vocab.read_texts([tokens(t.encode()) for t in sorted(rows.text.fillna(""))])
            texts = list(zip(*(np.split(x, np.cumsum(n)[:-1]) for x in vocab.sequence(model))))
            np.random.default_rng(k).shuffle(texts)
            q = gru.train_epoch(p, texts, RATE / (1 + k))
            return pd.DataFrame({"name": list(q), "value": [np.rint(v.ravel().astype(np.float64) * UNIT).astype(np.int64) for v in q.values()]})
        return learn

    for k in range(rounds):
        learned = dealt.groupBy("shard").applyInPandas(learner(p, k), "name string, value array<bigint>")
        sums = learned.selectExpr("name", "posexplode(value) AS (at, v)").groupBy("name", "at").agg(F.sum("v").alias("v"), F.count("*").alias("n")).toPandas()
        if sums.empty:
            return p
        p = {name: (g.v.to_numpy() / g.n.to_numpy() / UNIT).astype(np.float32).reshape(p[name].shape) for name, g in sums.sort_values("at").groupby("name")}
    return p


def score(docs: DataFrame, held_out: str, head: int = HEAD) -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    scratch = Scratch(docs.sparkSession)
    own = docs.select("doc_id", "text")
    training = own.where(f"NOT {held_out}")
    counts = scratch.keep(word_counts(training))
    ends = training.count()
    n_words, n_kinds = counts.selectExpr("coalesce(sum(c), 0)", "count(*)").first()
    total, kinds = n_words + ends, n_kinds + (ends > 0)
    words, freq = head_words(counts, head)
    # masses of the rare classes: all words less the frequent ones, and a place for unseen words
    frequent = words[:CLASSES * PLACES - 1]
    mass = np.full(RARE, ALPHA)
    for r in counts.groupBy("rare").agg(F.expr(f"sum(c + {ALPHA}D)").alias("m")).collect():  # at most RARE rows
        mass[r.rare] += r.m
    for w, c in zip(frequent, freq):
        mass[rare_class(w)] -= c + ALPHA
    vocab = Vocabulary(words, freq, ends, np.maximum(mass, ALPHA))
    params = train(training, vocab)
    log_total = math.log10(total + ALPHA * (kinds + 1))
    log_mass = np.log(vocab.rare_mass)

    def scan(batches):
        for b in batches:
            texts, base, known, n_tokens, rare, rest, times = [], [], [], [], [], [], []
            for at in range(0, len(b), SLICE):
                words, head, model, n = vocab.read_texts(list(map(tokens, b.column(3).slice(at, SLICE).cast(pa.binary()).to_pylist())))
                per = lambda of, values: np.bincount(of, values, len(n))
                owner, ends_at = np.repeat(np.arange(len(n)), n - 1), np.cumsum(n)[:-1]
                there = head >= 0
                logs = vocab.logs[head[there]]
                base.append(per(owner[there], logs) + math.log10(ends + ALPHA) - n * log_total)
                known.append(np.bincount(owner[there], minlength=len(n)) + (ends > 0))
                n_tokens.append(n)
                # share within the rare class; the tail's counts come from the join
                cls = np.delete(model, np.cumsum(n) - 1) - CLASSES * PLACES
                low = cls >= 0
                rare.append(per(owner[there], np.where(low[there], logs * math.log(10), 0)) - per(owner[low], log_mass[cls[low]]))
                texts += zip(*(np.split(x.astype(np.int16), ends_at) for x in vocab.sequence(model)))
                tail = np.flatnonzero(~there)
                for own_tail in np.split(tail, np.searchsorted(tail, np.cumsum(n - 1)[:-1])):
                    found = Counter(map(words.__getitem__, own_tail.tolist()))
                    rest.append(list(found))
                    times.append(list(found.values()))
            model_score = gru.score_texts(params, texts) if texts else np.empty(0)
            base, known, n_tokens, rare = (np.concatenate(x or [np.empty(0)]) for x in (base, known, n_tokens, rare))
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(n_tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base, pa.float64()),
                                   pa.array((model_score + rare) / math.log(10), pa.float64()), pa.array(rest, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                                  ["doc_id", "held_out", "key", "n_tokens", "known", "base", "model", "rest", "times"])

    keyed = own.selectExpr("doc_id", f"{held_out} AS held_out", f"{_KEY} AS key", "text")
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    scanned = scratch.keep(keyed.mapInArrow(scan, f"doc_id {id_type}, held_out boolean, key long, n_tokens long, known long, base double, model double, rest array<binary>, times array<bigint>"))
    rest = scanned.selectExpr("key", "inline(arrays_zip(rest, times)) AS (word, n)")
    joined = rest.join(counts.select("word", "c"), "word", "left")
    sums = joined.groupBy("key").agg(F.expr(f"sum(n * log10(coalesce(c, 0) + {ALPHA}D))").alias("log_"), F.expr("sum(IF(c IS NULL, 0, n))").alias("known_"))
    # rows with equal id and text share a key, and their words were added up together
    copies = scanned.groupBy("key").agg(F.count("*").alias("copies_"))
    extra = copies.join(sums, "key").selectExpr("key AS key_", "log_ / copies_ AS log_", "known_ DIV copies_ AS known_")
    return scanned.join(extra, F.expr("key = key_"), "left").selectExpr(
        "doc_id", "held_out", "n_tokens", "known + coalesce(known_, 0L) AS n_known", f"CAST({total} AS BIGINT) AS train_tokens",
        "base + coalesce(log_, 0D) AS base_score", "model + coalesce(log_, 0D) AS score")


@query("op9_lm")
def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document; every tenth id (by checksum) is held out."""
    return score(table(spark, sf_dir, "documents"), held_out_sql(10))
