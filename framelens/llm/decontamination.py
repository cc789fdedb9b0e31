"""Benchmark passages in documents: one suffix automaton of the items, through which every document's words stream.

1. Items are lower-cased (A-Z) and cut into words.  Pieces of them are packed by
   hash into blocks of at most ``BLOCK`` words; the sizes are counted before the
   pieces of a block travel to the tasks.  Pieces of a long item overlap by a
   window less one word, so every window lies whole in a piece.
2. A task builds the generalised suffix automaton of a block.  Each state with
   strings of at least ``WINDOW`` words knows the state of its last ``WINDOW``
   words; that state, and the end of every shorter item, list the items.
3. The words of a document are numbered by the block's vocabulary.  Stretches of
   known words stream through the automaton, which gives the longest matching
   length at each word.  A length of a window or more marks the words it covers.

The scan is local to the row, whatever the number of blocks: a block adds its
spans to those found before, and after ``BLOCKS_A_PASS`` blocks the table is written.

Defined cases: null texts have no words; an item without words has no window; an
item without item_id marks words and is listed nowhere; rows that share an
item_id are one item; rows that share a doc_id are treated one by one; no items,
no hits; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .registry import query

WINDOW = 10
BLOCK, PIECE, BLOCKS_A_PASS = 1 << 18, 1 << 12, 4
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOUND = "n_words bigint, spans array<struct<first: bigint, last: bigint>>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return _WORD.findall((text or b"").translate(_UPPER))


class SuffixAutomaton:
    """Generalised suffix automaton of word-number sequences, with the windows of their items."""

    def __init__(self, pieces: list[tuple[str | None, bool, list[bytes]]], window: int = WINDOW):
        """``pieces``: item, whether the piece is a whole item, words."""
        self.window, self.numbers = window, {}
        self.after, self.link, self.length = [{}], [-1], [0]
        number = self.numbers
        coded = [(item, whole, [number.setdefault(w, len(number)) for w in words]) for item, whole, words in pieces]
        for _, _, seq in coded:
            last = 0
            for c in seq:
                last = self._extended(last, c)
        self.least = window
        self.anchor, self.shorter = [-1] * len(self.link), [()] * len(self.link)
        self.owners: dict[int, set] = {}
        ends = set()
        for item, whole, seq in coded:
            if not whole and len(seq) < window:
                continue
            if len(seq) < window:
                state = 0
                for c in seq:
                    state = self.after[state][c]
                ends.add(state)
                self.owners.setdefault(state, set()).add(item)
                self.least = min(self.least, len(seq))
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= window:
                self.anchor[s] = s if self.length[up] < window else self.anchor[up]
            self.shorter[s] = (*self.shorter[up], s) if s in ends else self.shorter[up]
        for item, _, seq in coded:
            for _, _, state in self.stream(seq):
                if self.anchor[state] >= 0:
                    self.owners.setdefault(self.anchor[state], set()).add(item)

    def _extended(self, last: int, c: int) -> int:
        after, link, length = self.after, self.link, self.length
        if c in after[last]:
            q = after[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = len(link)
        after.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        """A state of its own for the strings of q that end p's longest string and c."""
        after, link = self.after, self.link
        own = len(link)
        after.append(dict(after[q]))
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        link[q] = own
        while p >= 0 and after[p].get(c) == q:
            after[p][c] = own
            p = link[p]
        return own

    def stream(self, seq):
        """(place, longest matching length, state) of every word that could complete a window."""
        after, link, length, shorter, window = self.after, self.link, self.length, self.shorter, self.window
        state = size = 0
        for i, c in enumerate(seq):
            step = after[state].get(c)
            if step is None:
                while state > 0 and step is None:
                    state = link[state]
                    step = after[state].get(c)
                if step is None:
                    size = 0
                    continue
                size = length[state]
            state, size = step, size + 1
            if size >= window or shorter[state]:
                yield i, size, state

    def occurrences(self, words: list[bytes]):
        """Merged (first, last) word numbers of all windows in ``words``, and the items they are from."""
        ids = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        edge = np.flatnonzero(np.diff(ids >= 0, prepend=False, append=False))
        spans, items, seen = [], set(), set()
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a < self.least:
                continue
            for i, size, state in self.stream(ids[a:b].tolist()):
                if size >= self.window:
                    spans.append((a + i - self.window + 1, a + i))
                    seen.add(self.anchor[state])
                for s in self.shorter[state]:
                    if self.length[s] <= size:
                        spans.append((a + i - self.length[s] + 1, a + i))
                        seen.add(s)
        for s in seen:
            items |= self.owners[s]
        return merged(spans), items - {None}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans with touching and overlapping ones joined, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _pieces(items: DataFrame, window: int) -> DataFrame:
    """Distinct pieces of the items: (item_id, whole, words)."""
    def run(batches):
        for b in batches:
            out = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(text)
                for o in range(0, max(len(words) - window + 1, 1) if words else 0, PIECE):
                    out.append((item, len(words) <= PIECE + window - 1, b" ".join(words[o:o + PIECE + window - 1]).decode()))
            item, whole, words = zip(*out) if out else ((), (), ())
            yield pa.record_batch([pa.array(item, pa.string()), pa.array(whole, pa.bool_()), pa.array(words, pa.string())], ["item_id", "whole", "words"])

    return items.selectExpr("CAST(item_id AS STRING) AS item_id", "text").mapInArrow(run, "item_id string, whole boolean, words string").distinct()


def blocks(items: DataFrame, scratch: Scratch, window: int = WINDOW):
    """The pieces of all items, block after block; every block is counted first and holds at most ``BLOCK`` words."""
    pieces = scratch.keep(_pieces(items, window).withColumn("n", F.expr("size(split(words, ' '))")))
    total = pieces.agg(F.sum("n")).first()[0] or 0
    number = max(1, -(-total // (BLOCK // 2)))
    while True:
        key = f"pmod(xxhash64(item_id, words), {number})"
        if pieces.groupBy(F.expr(key)).agg(F.sum("n").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] <= BLOCK:
            break
        number *= 2
    for k in range(number):  # one block at a time, so the driver holds no more
        yield [(r.item_id, r.whole, r.words.encode().split(b" ")) for r in pieces.where(f"{key} = {k}").collect()]
    scratch.free(pieces)


def with_occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The other columns in a struct ``row``, ``text``, its ``n_words``, the merged ``spans`` of hit words and the ``items`` (as strings, in order)."""
    scratch = Scratch(docs.sparkSession)
    others = [f"`{c}`" for c in docs.columns if c != "text"]
    out = docs.selectExpr(f"struct({', '.join(others)}) AS row", "text")
    kinds = f"row {out.schema['row'].dataType.simpleString()}, text {out.schema['text'].dataType.simpleString()}, {_FOUND}"
    out = out.selectExpr("*", "0L AS n_words", "CAST(array() AS array<struct<first: bigint, last: bigint>>) AS spans", "CAST(array() AS array<string>) AS items")

    def pass_of(pieces):
        shipped = docs.sparkSession.sparkContext.broadcast(pieces)

        def run(batches):
            automaton = SuffixAutomaton(shipped.value, window)
            for b in batches:
                n, spans, found = [], [], []
                for text, s, i in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                    words = words_of(text)
                    own, names = automaton.occurrences(words)
                    n.append(len(words))
                    if s:
                        own, names = merged([*own, *((x["first"], x["last"]) for x in s)]), names.union(i)
                    spans.append([{"first": x, "last": y} for x, y in own])
                    found.append(sorted(names, key=str.encode))
                yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()),
                                       pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(found, pa.list_(pa.string()))],
                                      ["row", "text", "n_words", "spans", "items"])
        return run

    written = None
    for k, pieces in enumerate(blocks(items, scratch, window)):
        if k and k % BLOCKS_A_PASS == 0:
            before, written = written, scratch.keep(out)
            if before is not None:
                scratch.free(before)
            out = written
        out = out.mapInArrow(pass_of(pieces), kinds)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, longest: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """``docs`` without the hit spans of ``longest`` words and more; rows of which more than ``coverage`` of the words are hit leave whole.

    A removed span goes from its first to its last word; the rest of the text is unaltered.
    """
    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                if spans:
                    places = [m.span() for m in _WORD.finditer(text.translate(_UPPER))]
                    kept, at = [], 0
                    for s in spans:
                        kept.append(text[at:places[s["first"]][0]])
                        at = places[s["last"]][1]
                    text = b"".join([*kept, text[at:]])
                out.append(None if text is None else text.decode())
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], ["row", "text"])

    found = with_occurrences(docs, items, window)
    kept = found.where(f"n_words = 0 OR aggregate(spans, 0L, (n, s) -> n + s.last - s.first + 1) <= {coverage} * n_words")
    done = kept.selectExpr("row", "text", f"filter(spans, s -> s.last - s.first + 1 >= {longest}) AS spans").mapInArrow(
        run, f"row {kept.schema['row'].dataType.simpleString()}, text string")
    return done.select(*["text" if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


SQL = f"""
WITH d AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {_words_sql('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS k, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) t(i) WHERE len(w) > 0),
occ AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM d, (SELECT DISTINCT k FROM win) z, unnest(range(1, len(w) - k + 2)) t(i)),
hit AS (SELECT doc_id, i, occ.k, item_id FROM occ JOIN win ON win.k = occ.k AND win.s = occ.s),
cover AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN who USING (doc_id)"""


@query("op12_decontamination", SQL)
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item, and the items they are from."""
    found = with_occurrences(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.selectExpr("row.doc_id AS doc_id", "n_words", "aggregate(spans, 0L, (n, s) -> n + s.last - s.first + 1) AS n_hit", "CAST(size(items) AS BIGINT) AS n_items",
                            "sha2(array_join(items, ','), 256) AS items_sha256", "size(spans) > 0 AS contaminated")
