"""SentencePiece encoding and decoding by a forward pass that common prefixes share.

A text is marked (spaces become U+2581, one stands in front) and cut into
marked words, a run of marks and the letters after it; no piece crosses such a
cut.  The distinct words of a batch are sorted, which lays out their trie; a
depth-first walk keeps the forward values along the current prefix, so letters
shared with the word before are not computed again.

The forward value of a prefix depends on the kind of model file:

* unigram: the best score of the prefix and the last piece that gives it
  (Viterbi; among equal scores the longer last piece);
* BPE: the last piece of the prefix's own merge result.  Appending a piece to
  the pieces of a shorter prefix is right exactly if the two pieces side by side
  merge into themselves, so each prefix has one such last piece.

The public model file is a BPE model; the ids equal those of its merge order.
Characters without a piece become byte pieces.

Defined cases: null text is the empty text and has no pieces; U+2581 in a text
is read back as a space, as the format has it; other columns are not looked at;
repeated rows are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy
from .registry import query

MARK = "▁"
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = range(1, 7)
NO_PAIR = float("-inf")
SLICE, CACHED_WORDS, CACHED_PAIRS = 512, 1 << 19, 1 << 18
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def model_path() -> str:
    """The public model file on this machine; pass another path for another model."""
    root = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
    return os.path.join(root, "piece_bpe_32k.model")


def _wire(data: bytes):
    """(field number, value) pairs of a protocol-buffer message; fixed 32-bit values as raw bytes."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at:at + n]
            at += n


@dataclass
class PieceModel:
    """Pieces, scores and kinds of a model file."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    algorithm: int
    dummy_prefix: bool = True
    ids: dict[str, int] = field(init=False)
    byte_ids: dict[int, int] = field(init=False)

    def __post_init__(self):
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (_NORMAL, _USER)}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == _BYTE}
        self.unknown = self.kinds.index(_UNKNOWN)
        self.longest = max(map(len, self.ids), default=1)
        crossing = [p for p in self.ids if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces across words: {crossing[:3]}")

    @staticmethod
    def read(path: str) -> PieceModel:
        pieces, scores, kinds, spec = [], [], [], {"algorithm": UNIGRAM}
        with open(path, "rb") as f:
            message = f.read()
        for number, value in _wire(message):
            if number == 1:
                one = dict(_wire(value))
                pieces.append(one[1].decode())
                scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
                kinds.append(one.get(3, _NORMAL))
            elif number == 2:
                spec["algorithm"] = dict(_wire(value)).get(3, UNIGRAM)
            elif number == 3:
                norm = dict(_wire(value))
                if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
                    raise ValueError("only the identity normaliser that keeps all spaces is supported")
                spec["dummy_prefix"] = bool(norm.get(3, 1))
        return PieceModel(pieces, scores, kinds, **spec)

    def symbol_ids(self, symbol: str) -> tuple[int, ...]:
        """Id of a piece, or the byte pieces of a character that has none."""
        i = self.ids.get(symbol)
        if i is not None:
            return (i,)
        if not self.byte_ids:
            return (self.unknown,)
        return tuple(self.byte_ids[b] for b in symbol.encode())

    def merges(self, word: str):
        """The merge rule itself, the best-scored adjacent pair first, the leftmost among equals: (score of the next merge, parts) until none is left."""
        parts, ids, scores = list(word), self.ids, self.scores

        def pair(i: int) -> float:
            k = ids.get(parts[i] + parts[i + 1])
            return NO_PAIR if k is None else scores[k]

        value = [pair(i) for i in range(len(parts) - 1)]
        while value:
            best = max(value)
            if best == NO_PAIR:
                break
            yield best, parts
            at = value.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del value[at]
            if at:
                value[at - 1] = pair(at - 1)
            if at < len(value):
                value[at] = pair(at)
        yield NO_PAIR, parts


class TrieEncoder:
    """Depth-first forward pass over sorted distinct words.

    Pieces are held by number; a character without a piece has a number behind the pieces.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self.floor = min(model.scores, default=0.0) - 10.0  # score of a character without a piece
        self.spelled = list(model.pieces)
        self.strange: dict[str, int] = {}
        self.fits: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[float, str]]] = {}
        # the longest ending of a prefix that begins a piece, and where each letter leads from there
        self.begin = {p[:k] for p in model.ids for k in range(1, len(p) + 1)}
        self.endings, self.ending_of, self.moves, self.n_moves = [""], {"": 0}, [{}], 0

    def encode(self, words) -> dict[str, array]:
        grow = self._grow_merges if self.model.algorithm == BPE else self._grow_best
        out: dict[str, array] = {}
        last, value = [-1], [0]
        before, spelled, n_pieces = "", self.spelled, len(self.model.pieces)
        for word in sorted(words):
            shared = min(len(before), len(word))
            while before[:shared] != word[:shared]:
                shared -= 1
            del last[shared + 1:], value[shared + 1:]
            grow(word, shared, last, value)
            found, end = [], len(word)
            while end:
                piece = last[end]
                if piece < n_pieces:
                    found.append(piece)
                else:
                    found += reversed(self.model.symbol_ids(spelled[piece]))
                end -= len(spelled[piece])
            found.reverse()
            out[word] = array("i", found)
            before = word
        return out

    def _number(self, symbol: str) -> int:
        known = self.model.ids.get(symbol)
        if known is None:
            known = self.strange.get(symbol)
            if known is None:
                known = self.strange[symbol] = len(self.spelled)
                self.spelled.append(symbol)
        return known

    def _move(self, at: int, letter: str) -> tuple[int, tuple[tuple[int, int], ...]]:
        """From ending ``at`` by ``letter``: the new ending and the pieces that the prefix ends with, longest first."""
        if self.n_moves >= CACHED_PAIRS:
            self.moves, self.n_moves = [{} for _ in self.moves], 0
        text = self.endings[at] + letter
        while text and text not in self.begin:
            text = text[1:]
        to = self.ending_of.get(text)
        if to is None:
            to = self.ending_of[text] = len(self.endings)
            self.endings.append(text)
            self.moves.append({})
        ends = [text[k:] for k in range(len(text)) if text[k:] in self.model.ids]
        if letter not in self.model.ids:
            ends.append(letter)
        known = self.moves[at][letter] = to, tuple((len(e), self._number(e)) for e in ends)
        self.n_moves += 1
        return known

    def _edge(self, piece: int, side: int) -> list[tuple[float, str]]:
        """While ``piece`` is merged: the score of its next merge and its part at the left (0) or right (-1) edge."""
        known = self.edges.get((piece, side))
        if known is None:
            known = self.edges[piece, side] = [(score, parts[side]) for score, parts in self.model.merges(self.spelled[piece])]
        return known

    def _fits(self, left: int, right: int) -> bool:
        """Whether two pieces side by side merge into themselves: no pair across their border is ever the best one."""
        if len(self.fits) >= CACHED_PAIRS:
            self.fits.clear()
        ids, scores = self.model.ids, self.model.scores
        known, j, after = True, 0, self._edge(right, 0)
        if after[-1][1] != self.spelled[right]:
            known = False  # a piece its own merges do not give
        elif left >= 0:
            i, before = 0, self._edge(left, -1)
            while known:
                (x, a), (y, b) = before[i], after[j]
                k = ids.get(a + b)
                if k is not None and scores[k] > x and scores[k] >= y:
                    known = False
                elif x == y == NO_PAIR:
                    break
                elif x >= y:
                    i += 1
                else:
                    j += 1
        self.fits[left << 32 | right] = known
        return known

    def _grow_merges(self, word: str, shared: int, last: list[int], value: list[int]) -> None:
        """Last pieces of the prefixes longer than ``shared``; ``value`` holds their endings."""
        fits, at = self.fits, value[shared]
        for end in range(shared + 1, len(word) + 1):
            at, ends = self.moves[at].get(word[end - 1]) or self._move(at, word[end - 1])
            for n, piece in ends:
                left = last[end - n]
                known = fits.get(left << 32 | piece)
                if known is None:
                    known = self._fits(left, piece)
                if known:
                    last.append(piece)
                    value.append(at)
                    break
            else:
                raise ValueError(f"no last piece for {word[:end]!r}")

    def _grow_best(self, word: str, shared: int, last: list[int], value: list[float]) -> None:
        """Last pieces of the prefixes longer than ``shared``; ``value`` holds their best scores."""
        ids, scores = self.model.ids, self.model.scores
        for end in range(shared + 1, len(word) + 1):
            best, choice = None, -1
            for start in range(max(0, end - self.model.longest), end):
                k = ids.get(word[start:end])
                if k is None and end - start > 1:
                    continue
                s = value[start] + (self.floor if k is None else scores[k])
                if best is None or s > best:
                    best, choice = s, self._number(word[end - 1]) if k is None else k
            last.append(choice)
            value.append(best)


def marked_words(text: str, dummy_prefix: bool = True) -> list[str]:
    return _WORDS.findall((MARK if dummy_prefix else "") + text.replace(" ", MARK)) if text else []


def _encoder(model: PieceModel, held: int = CACHED_WORDS):
    """Batches ``(doc_id, text)`` to batches ``(doc_id, ids)``; ``held`` words are remembered at a time."""

    def run(batches):
        coder, known = TrieEncoder(model), {}
        for b in batches:
            for at in range(0, len(b), SLICE):  # few texts at a time as Python objects
                part = b.slice(at, SLICE)
                words = [marked_words(t or "", model.dummy_prefix) for t in part.column(1).to_pylist()]
                if len(known) >= held:
                    known = {}
                fresh = coder.encode(set(chain.from_iterable(words)).difference(known))
                known.update((w, ids.tobytes()) for w, ids in fresh.items())  # packed: many words are held
                ids = [np.frombuffer(b"".join(map(known.__getitem__, w)), np.int32) for w in words]
                ends = np.cumsum([0, *map(len, ids)])
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` for every row of ``docs(doc_id, text)``."""
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_encoder(PieceModel.read(path or model_path())), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def _decoder(model: PieceModel):
    """Batches ``(doc_id, ids)`` to batches ``(doc_id, ids, text)``."""
    spelled = [b"" if k == _CONTROL else " ⁇ ".encode() if k == _UNKNOWN else bytes([int(p[3:5], 16)]) if k == _BYTE else p.replace(MARK, " ").encode()
               for p, k in zip(model.pieces, model.kinds)]

    def run(batches):
        # each piece, then each without the space that the mark in front of a text stands for
        letters = pa.array(spelled + [x.removeprefix(b" ") for x in spelled], pa.binary())
        some = np.array([len(x) > 0 for x in spelled])
        for b in batches:
            for at in range(0, len(b), SLICE):
                part = b.slice(at, SLICE)
                ids = part.column(1).flatten().to_numpy().copy()
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(part.column(1)).fill_null(0).to_numpy())])
                if model.dummy_prefix:
                    spelt = np.append(np.flatnonzero(some[ids]), len(ids))
                    first = spelt[np.searchsorted(spelt, ends[:-1])]
                    ids[first[first < ends[1:]]] += len(spelled)
                raw = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), letters.take(pa.array(ids))), b"")
                try:
                    texts = raw.cast(pa.string())
                except pa.ArrowInvalid:  # byte pieces that are no UTF-8
                    texts = pa.array([r.decode(errors="replace") for r in raw.to_pylist()], pa.string())
                yield pa.record_batch([part.column(0), part.column(1), texts], ["doc_id", "ids", "text"])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids, text)``: the text of each row's pieces."""
    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(_decoder(PieceModel.read(path or model_path())), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def with_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of ``docs`` with ``text`` as its pieces decode, and ``ids`` (in place of a column of that name)."""
    others = [f"`{c}`" for c in docs.columns if c != "text"]
    rows = docs.selectExpr(f"struct({', '.join(others)}) AS doc_id" if others else "0 AS doc_id", "text")
    model = PieceModel.read(path or model_path())
    there, back = _encoder(model, CACHED_WORDS // 4), _decoder(model)  # stages before have filled the executor's heap
    # both ways in one Python worker: two at a time for a core hold the model and its caches twice
    done = rows.mapInArrow(tidy(lambda batches: back(there(batches))), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")
    return done.select(*[F.col("text") if c == "text" else F.col("doc_id").getField(c).alias(c) for c in docs.columns if c != "ids"], "ids")


@query("op1_pieces")
def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document and the digest of the text they decode to."""
    return decode(encode(table(spark, sf_dir, "documents"))).selectExpr("doc_id", "ids", "size(ids) AS n_pieces", "sha2(text, 256) AS text_sha256")
