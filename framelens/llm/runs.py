"""Periodic runs of words, found through a dictionary of basic factors, and texts with the repetitions collapsed.

A run is a stretch of consecutive words with smallest period q and at least
``EXPONENT`` periods (and ``LEAST`` words) that neither neighbour extends.

1. Level k of the dictionary names the factor of 2^k words at every position;
   a name of level k + 1 is a pair of names of level k.  Positions whose factor
   occurs nowhere else in the document leave, as no longer factor there repeats.
2. The next occurrence of a factor at a distance of at most twice its length
   proposes that distance as a period; consecutive positions with one distance
   are an arithmetic progression and propose it once.  In a run of period q the
   factors of q to 2q - 1 words recur first after q words, so every run is proposed.
3. A proposal is extended to both sides by equal names, from the longest
   factors to single words, and equal results are kept once.

All documents of a slice are named together; a document is never cut, and the
work is local to the row: no shuffle, one scan.

Defined cases: a null text stays null, has no words and no runs; an empty text
stays empty; rows that share a doc_id are treated one by one; other columns are
kept as they are, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .registry import query

LEAST, EXPONENT = 6, 4
SLICE_WORDS = 1 << 17
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Factors:
    """Names of the basic factors of several documents, and the periods their next occurrences propose."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, exponent: int):
        n, docs = len(ids), np.repeat(np.arange(len(counts)), counts)
        longest = int(counts.max(initial=0))
        self.levels, found = [], []
        # one free place behind each document, so no factor crosses its end
        pos, key = np.arange(n) + docs, docs * (int(ids.max(initial=0)) + 1) + ids
        size, width = n + len(counts) + longest + 2, 1
        while len(pos) and width < 2 * (longest // exponent):
            order = np.argsort(key, kind="stable")
            k, p = key[order], pos[order]
            same = k[1:] == k[:-1]
            gap = p[1:] - p[:-1]
            name = np.empty(len(pos), np.int64)
            name[order] = np.concatenate([[0], np.cumsum(~same)])
            repeated = np.zeros(len(pos), bool)
            repeated[order[1:][same]] = True
            repeated[order[:-1][same]] = True
            dense = np.full(size, -1, np.int32)
            dense[pos[repeated]] = name[repeated]
            self.levels.append((width, dense))
            near = same & (gap <= 2 * width)
            found.append(self._progressions(p[:-1][near], gap[near]))
            second = dense[pos + width]
            going = repeated & (second >= 0)
            pos, key = pos[going], name[going] * (len(name) + 1) + second[going]
            width *= 2
        self.at, self.period = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2

    @staticmethod
    def _progressions(at: np.ndarray, gap: np.ndarray):
        """First position and distance of every stretch of consecutive positions with one distance."""
        order = np.argsort(at)
        at, gap = at[order], gap[order]
        new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(gap) != 0)])[:len(at)]
        return at[new], gap[new]

    def _agree(self, x: np.ndarray, y: np.ndarray, side: int) -> np.ndarray:
        """Number of equal words from x and y on (side 1) or before them (side -1)."""
        total = np.zeros(len(x), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            width, dense = self.levels[level]
            while True:
                shift = total if side > 0 else -total - width
                a, b = x + shift, y + shift
                name = dense[np.maximum(a, 0)]
                more = (a >= 0) & (name >= 0) & (name == dense[np.minimum(np.maximum(b, 0), len(dense) - 1)])
                total[more] += width
                if level + 1 < len(self.levels) or not more.any():  # a lower level fits once at most
                    break
        return total

    def runs(self, least: int, exponent: int):
        """(start, length, period) of all runs by start and period; starts count one free place behind each document."""
        x, y = self.at, self.at + self.period
        left, right = self._agree(x, y, -1), self._agree(x, y, 1)
        start, length, q = x - left, left + right + self.period, self.period
        keep = (length >= least) & (length >= exponent * q)
        if not keep.any():
            return (np.empty(0, np.int64),) * 3
        return np.unique(np.stack([start[keep], q[keep], length[keep]]), axis=1)[[0, 2, 1]]


def runs_of(words: list[list], least: int = LEAST, exponent: int = EXPONENT) -> list[np.ndarray]:
    """Per document of a slice an array of rows (start, length, period), by start and period."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    ids = pa.array([w for d in words for w in d], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    start, length, q = Factors(ids, counts, exponent).runs(least, exponent)
    base = np.cumsum(counts + 1) - counts - 1
    cut = np.searchsorted(start, base)
    rows = np.stack([start, length, q], axis=1)
    out = np.split(rows, cut[1:]) if len(words) else []
    return [r - [b, 0, 0] if len(r) else r for r, b in zip(out, base.tolist())]


def _tandem(words: list, h: int) -> list:
    """The words with a tail in periods, as the number says: of every tenth number only."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _collapsed(words: list, runs: np.ndarray) -> list:
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]


def with_runs(docs: DataFrame, tandem: str | None = None, respace: bool = True, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """The other columns in a struct ``row``; ``text`` with every run cut to its first period and words one space apart; ``runs`` by start and period.

    Texts without runs get single spaces only if ``respace`` says so.

    ``tandem``: a SQL expression over the columns, a number >= 0; every tenth
    number puts the tail of its text into periods before the search (test material).
    """
    def finish(row, texts, words):
        out = []
        found = runs_of(words, least, exponent)
        for t, w, r in zip(texts, words, found):
            kept = _collapsed(w, r) if len(r) else w
            out.append(None if t is None else (b" ".join(kept) if respace or len(r) else t).decode())
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
        flat = np.concatenate(found) if found else np.empty((0, 3), np.int64)
        items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i]).astype(np.int64)) for i in range(3)], ["start", "length", "period"])
        return pa.record_batch([row, pa.array(out, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), items)], ["row", "text", "runs"])

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            numbers = b.column(2).to_pylist()
            words, begin, held = [], 0, 0
            for i, (t, h) in enumerate(zip(texts, numbers)):
                own = (t or b"").split()
                words.append(own if h is None else _tandem(own, h))
                held += len(own)
                if held >= SLICE_WORDS or i + 1 == len(texts):
                    yield finish(b.column(0).slice(begin, i + 1 - begin), texts[begin:i + 1], words)
                    words, begin, held = [], i + 1, 0

    others = [f"`{c}`" for c in docs.columns if c != "text"]
    keyed = docs.selectExpr(f"struct({', '.join(others)}) AS row", "text", f"CAST({tandem or 'NULL'} AS BIGINT) AS h_")
    return keyed.mapInArrow(run, f"row {keyed.schema['row'].dataType.simpleString()}, text string, runs {RUNS}")


def collapsed(docs: DataFrame) -> DataFrame:
    """``docs`` with every run of a text cut to its first period; texts without runs stay as they are."""
    done = with_runs(docs, respace=False)
    return done.select(*["text" if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


# the checksum of a decimal number in SQL: its table from the polynomial 0xEDB88320, then one step for each digit
CRC_TABLE = """(SELECT list(c ORDER BY n) AS ct FROM (SELECT n,
  list_reduce(list_prepend(n, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS c FROM range(256) t(n)))"""


def crc_sql(number: str) -> str:
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda x, y: xor(x // 256, ct[CAST(xor(x, y) % 256 AS INT) + 1])), 4294967295)"


SQL = f"""
WITH d0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {crc_sql('doc_id')} AS h FROM documents, {CRC_TABLE}),
d1 AS (SELECT *, len(w) AS n, h // 10 AS g FROM d0),
d2 AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM d1),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN w[1:a] || list_transform(range(n - a), lambda i: w[CAST(a + i % (1 + (n - a) // (3 + g % 8)) AS INT) + 1]) ELSE w END AS w FROM d2),
five AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 5], ' ') AS s FROM d, unnest(range(n - 4)) t(i) WHERE n >= 6),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM five x JOIN five y ON x.doc_id = y.doc_id AND x.s = y.s AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isle AS (SELECT doc_id, q, min(i) AS a, count(*) + q + 4 AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair) GROUP BY doc_id, q, k),
long AS (SELECT * FROM isle WHERE length >= greatest(6, 4 * q)),
run AS (SELECT * FROM long u WHERE NOT EXISTS (SELECT 1 FROM isle v WHERE v.doc_id = u.doc_id AND v.q < u.q AND v.a <= u.a AND v.a + v.length >= u.a + u.length)),
best AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'a': a, 'l': length, 'q': q}}, (-length, a, q)) AS b,
  string_agg(a || ',' || length || ',' || q || chr(10), '' ORDER BY a, q) AS rs FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(a + q, a + length)) AS i FROM run),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.i) AS t FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i WHERE gone.i IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(b.a AS BIGINT) AS start, CAST(b.l AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period,
  CAST(1000 * b.l // b.q AS BIGINT) AS exponent_milli, sha256(coalesce(rs, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query("op11_runs", SQL)
def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words, the longest of them, and the text without their repetitions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_runs(docs, tandem="crc32(CAST(CAST(doc_id AS STRING) AS BINARY))")
    longest = "array_max(transform(runs, r -> struct(r.length AS length, -r.start AS before, -r.period AS smaller)))"
    best = found.selectExpr("row.doc_id AS doc_id", "CAST(size(runs) AS BIGINT) AS n_runs", f"{longest} AS b", "runs", "text")
    return best.selectExpr("doc_id", "n_runs", "-b.before AS start", "b.length AS length", "-b.smaller AS period", "1000 * b.length DIV -b.smaller AS exponent_milli",
                           "sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), ''), 256) AS runs_sha256",
                           "sha2(coalesce(text, ''), 256) AS collapsed_sha256")
