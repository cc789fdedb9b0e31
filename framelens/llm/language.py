"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes with the counts
of the bytes that follow.  A byte seen in the longest context costs its share
there; otherwise an escape is paid and the shorter context asked, down to the
uniform byte.  Counts are frozen after training, so a text's code length in a
language is a sum over its bytes; the shortest code wins.

The contexts of all languages share tables: one row per (context, byte) with the
exact code length in every language, escapes included, so a byte is one lookup.
Trees are learned from a bounded sample, about ``SAMPLE`` documents for each
language; every ``TABLE_LANGUAGES`` languages have tables of their own, and the
shortest code over all of them wins.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and
so is every text if there is nothing to learn from; rows without doc_id are not
held out; ties go to the smaller language value; repeated rows are scored each;
other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .registry import query

ORDER = 3
SAMPLE, TABLE_LANGUAGES = 400, 256
SLICE = 64
PAD = b"\n" * ORDER
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def grams(data: bytes) -> np.ndarray:
    """For every byte, the number of the four bytes that end with it (three in front of the first are line ends)."""
    b = np.frombuffer(PAD + data, np.uint8).astype(np.uint32)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


class Slots:
    """Numbers of known keys by open addressing, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.where = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.append(keys.astype(np.uint32), np.uint32(0))  # number -1 reads a spare entry
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.where[at] < 0
            self.where[at[free]] = left[free]  # of several claims to one slot the last stays
            lost = self.where[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, or -1."""
        at = self._home(keys)
        found = self.where[at]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found[open_] = self.where[at[open_]]
            open_ = open_[(found[open_] >= 0) & (self.keys[found[open_]] != keys[open_])]
        return found


class ContextTrees:
    """Exact code lengths in bits under frozen counts of ``(language, four bytes)``."""

    def __init__(self, languages: list[str], lang: np.ndarray, key: np.ndarray, n: np.ndarray):
        self.languages = languages
        size = len(languages)
        below = np.full((1, size), 8.0)  # order -1: a uniform byte
        find_below = lambda k: np.zeros(len(k), np.int64)
        self.levels = []
        for order in range(ORDER + 1):
            mask = np.uint64((1 << 8 * (order + 1)) - 1)
            keys, at = np.unique(key.astype(np.uint64) & mask, return_inverse=True)
            count = np.zeros((len(keys), size))
            np.add.at(count, (at, lang), n)
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
            np.add.at(total, of, count)
            np.add.at(kinds, of, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                # method C: an escape counts as often as there are kinds of bytes; an unseen context costs nothing
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                own = -np.log2(count / (total[of] + kinds[of]))
            shorter = below[find_below(keys)] if order == 0 else self._lengths(order - 1, keys)
            self.levels.append((Slots(keys), np.where(count > 0, own, escape[of] + shorter), Slots(contexts), np.vstack([escape, np.zeros((1, size))])))

    def _lengths(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Code lengths (bytes x languages) of the last byte of each key after ``order`` bytes of context."""
        slots, lengths, contexts, escape = self.levels[order]
        cut = (keys.astype(np.uint64) & np.uint64((1 << 8 * (order + 1)) - 1)).astype(np.uint32)
        at = slots.find(cut)
        out = lengths[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            rest = escape[contexts.find(cut[miss] >> np.uint32(8))]
            out[miss] = rest + (8.0 if order == 0 else self._lengths(order - 1, cut[miss]))
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (not empty) in each language."""
        parts = [grams(t) for t in texts]
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        return np.add.reduceat(self._lengths(ORDER, np.concatenate(parts)), starts, axis=0)


def train(docs: DataFrame, held_out: str, sample: int = SAMPLE, languages: int = TABLE_LANGUAGES) -> list[ContextTrees]:
    """Trees of every language of the rows that are not held out, ``languages`` to a table; counts are added up in Spark, the driver receives the distinct ones."""
    rows = docs.select("doc_id", "lang", "text").where(f"lang IS NOT NULL AND text IS NOT NULL AND NOT coalesce({held_out}, false)")
    per = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    tables = [_trees(rows, per[k:k + languages], sample) for k in range(0, len(per), languages)]
    return [t for t in tables if t is not None]


def _trees(rows: DataFrame, per: list, sample: int) -> ContextTrees | None:
    """Trees of the languages of ``per(lang, count)``; None if none of their texts has a letter."""
    languages = sorted(r.lang for r in per)
    rate = F.create_map(*[F.lit(x) for r in per for x in (r.lang, min(1.0, sample / r["count"]))])
    picked = rows.withColumn("rate_", rate[F.col("lang")]).where("pmod(xxhash64(doc_id, 1), 1048576) < rate_ * 1048576").select("lang", "text")
    number = {x: i for i, x in enumerate(languages)}

    def count(batches):
        total: dict[int, dict[int, int]] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                if not has_letter(t := text.as_py()):
                    continue
                own = total.setdefault(number[lang], {})
                for k, n in zip(*(x.tolist() for x in np.unique(grams(t.encode().lower()), return_counts=True))):
                    own[k] = own.get(k, 0) + n
        for lang, own in total.items():
            yield pa.record_batch([pa.array(np.full(len(own), lang, np.int32)), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["lang", "key", "n"])

    found = picked.mapInArrow(count, "lang int, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    if found.empty:
        return None
    learned = sorted(found.lang.unique())
    renumber = {x: i for i, x in enumerate(learned)}
    return ContextTrees([languages[i] for i in learned], found.lang.map(renumber).to_numpy(), found.key.to_numpy(), found.n.to_numpy())


def predict(docs: DataFrame, tables: list[ContextTrees] | None, held_out: str) -> DataFrame:
    """Per row: ``doc_id, held_out, lang_pred, score``; score is the posterior of the language from the code lengths, over all tables.

    Each table is a pass that hands on the best language so far (of equal ones the
    first in order), its bits, and the sum of all likelihoods against it.
    """
    rows = docs.selectExpr("doc_id", f"coalesce({held_out}, false) AS held_out", "text", f"'{UNKNOWN}' AS lang_pred", "double('infinity') AS bits", "0.0D AS total")
    for trees in tables or []:
        rows = _compared(rows, trees)
    return rows.selectExpr("doc_id", "held_out", "lang_pred", "IF(total > 0, 1 / total, 0.0D) AS score")


def _compared(rows: DataFrame, trees: ContextTrees) -> DataFrame:
    def run(batches):
        for b in batches:
            for at in range(0, len(b), SLICE):
                part = b.slice(at, SLICE)
                texts = part.column(2).to_pylist()
                lang, least, total = (part.column(c).to_pylist() for c in (3, 4, 5))
                known = [i for i, t in enumerate(texts) if has_letter(t)]
                if known:
                    bits = trees.code_lengths([texts[i].encode().lower() for i in known])
                    best = bits.argmin(axis=1)
                    low = bits[np.arange(len(best)), best]
                    sums = np.exp2(np.minimum(low[:, None] - bits, 0)).sum(axis=1)
                    for i, k, x, n in zip(known, best.tolist(), low.tolist(), sums.tolist()):
                        y, m, name = least[i], total[i], trees.languages[k]
                        if m and (y, lang[i]) < (x, name):
                            total[i] = m + n * 2.0 ** (y - x)
                        else:
                            lang[i], least[i], total[i] = name, x, n + (m * 2.0 ** (x - y) if m else 0.0)
                yield pa.record_batch([*part.columns[:3], pa.array(lang, pa.string()), pa.array(least, pa.float64()), pa.array(total, pa.float64())],
                                      ["doc_id", "held_out", "text", "lang_pred", "bits", "total"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, text string, lang_pred string, bits double, total double")


@query("op8_language")
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; every third id (by checksum) is held out of training."""
    docs = table(spark, sf_dir, "documents")
    held_out = "crc32(CAST(doc_id AS STRING)) % 3 = 1"
    return predict(docs, train(docs, held_out), held_out)
