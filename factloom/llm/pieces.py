"""SentencePiece (BPE, byte fallback) encoding and decoding in vectorised merge rounds.

The model file is read as plain protobuf fields; the library itself is not used.  No piece of a supported model has a
space mark after another character, so a text falls apart into words (a run of space marks and what follows) that merge
independently.  Words not met before are encoded together as flat numpy arrays: one array of symbols, one of word
numbers.  A round looks up the rank of every neighbouring pair, takes each word's minimum by a segmented reduction,
merges the leftmost non-overlapping pairs of that rank at the same time, and compacts; words without a pair leave the
arrays.  Merging several places of a word at once gives what one merge at a time gives unless a merge makes a pair that
is at least as good as the rank in hand; such a round stops behind the first such merge of the word.  A word falls apart
further where two characters meet that stand side by side in no piece, for no merge can ever cross that place: so runs
without any space, however long, mostly are many short parts, each with a minimum of its own, and the rounds of a part are
no more than the ranks it goes through.

Defined results: null and empty texts encode to the end id alone and decode to the empty string; texts are taken whole.
"""

from __future__ import annotations

import codecs
import contextlib
import gc
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom.llm.batches import slices_of, trimmed

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words that a Python worker remembers before it starts over; bounds its memory.
REMEMBERED = 300_000
#: Characters whose merges run together, if no single word has more; bounds memory as well.
CHARACTERS = 2_000_000
NO_RANK = np.int32(2**31 - 1)
SLOT_BITS = 18

codecs.register_error("factloom-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[i]
        i += 1
        value |= (x & 127) << shift
        shift += 7
        if x < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, bytes | int]]:
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if kind == 2 else (4 if kind == 5 else 8, i)
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


class PieceModel:
    """A BPE model with identity normalisation; raises ValueError for models that need more."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        scores: list[float] = []
        kinds: list[int] = []
        trainer: dict = {}
        normal: dict = {}
        for f, v in _fields(model):
            if f == 1:
                d = dict(_fields(v))
                self.pieces.append(d[1].decode())
                scores.append(struct.unpack("<f", d[2])[0] if 2 in d else 0.0)
                kinds.append(d.get(3, NORMAL))
            elif f == 2:
                trainer = dict(_fields(v))
            elif f == 3:
                normal = dict(_fields(v))
        if trainer.get(3, 1) != 2 or normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1) or USER in kinds or UNUSED in kinds:
            raise ValueError("only BPE models with identity normalisation, a dummy prefix and kept white space are supported")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unk = trainer.get(40, 0)
        self.end = trainer.get(42, 2)
        self.unk_surface = trainer.get(44, " ⁇ ".encode()).decode()
        self.kinds = kinds
        self.index = {p: i for i, p in enumerate(self.pieces) if kinds[i] == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.index):
            raise ValueError("a piece has a space mark after another character")
        self.controls = frozenset(i for i, k in enumerate(kinds) if k == CONTROL)
        self.byte_id = [-1] * 256
        for i, p in enumerate(self.pieces):
            if kinds[i] == BYTE:
                self.byte_id[int(p[3:5], 16)] = i
        #: what a piece puts into the decoded bytes
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else self.unk_surface.encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        order = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        #: symbols are piece ids, then single characters that only occur inside pieces; others are -1
        inner = sorted({c for p in self.index for c in p if c not in self.index})
        self.char_id = np.full(0x110000, -1, np.int32)
        for c, i in [(p, i) for p, i in self.index.items() if len(p) == 1] + [(c, len(self.pieces) + n) for n, c in enumerate(inner)]:
            self.char_id[ord(c)] = i
        part = self.index | {c: len(self.pieces) + n for n, c in enumerate(inner)}
        self.width = len(self.pieces) + len(inner)
        self.ints = list(range(self.width + 1))
        pairs = sorted((part[p[:k]] * self.width + part[p[k:]], order[scores[i]], i) for p, i in self.index.items() for k in range(1, len(p)) if p[:k] in part and p[k:] in part)
        self.pair_key = np.array([x[0] for x in pairs], np.int64)
        # open addressing: where a pair stands, -1 for an empty place; a miss ends at an empty place
        self.slots = np.full(1 << SLOT_BITS, -1, np.int64)
        size = len(self.slots)
        if 2 * len(pairs) > size:
            raise ValueError("too many pairs for the table")
        place = self._place(self.pair_key).tolist()
        for n, at in enumerate(place):
            while self.slots[at] >= 0:
                at = (at + 1) % size
            self.slots[at] = n
        none = len(pairs)  # the entry that stands for no pair
        self.slots[self.slots < 0] = none
        self.pair_key = np.append(self.pair_key, -1)
        beside = {(a, b) for p in self.index for a, b in zip(p, p[1:], strict=False)}
        #: characters that stand side by side in some piece
        self.beside = np.array(sorted(part[a] * self.width + part[b] for a, b in beside), np.int64)
        self.pair_rank = np.array([*(x[1] for x in pairs), NO_RANK], np.int32)
        self.pair_id = np.array([*(x[2] for x in pairs), -1], np.int32)

    @staticmethod
    def _place(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of each pair in the tables; the last number where there is none."""
        none = len(self.pair_key) - 1
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.width + right, -2)
        at = self._place(key)
        found = self.slots[at]
        todo = np.flatnonzero((self.pair_key[found] != key) & (found != none))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
            found[todo] = self.slots[at[todo]]
            f = found[todo]
            todo = todo[(self.pair_key[f] != key[todo]) & (f != none)]
        return found

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where no piece holds the one character beside the other."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.width + right, -1)
        at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        return self.beside[at] != key

    def _rounds(self, words: list[str]) -> list[list[int]]:
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        size = np.array([len(w) for w in words], np.int64)
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), size)  # of each character
        sym = self.char_id[points]
        point = np.arange(len(points), dtype=np.int32)  # the character that a symbol starts at
        none = len(self.pair_key) - 1
        pair = np.full(len(sym), none, np.int32)  # the pair that starts at a symbol
        cut = word_of[:-1] != word_of[1:]
        cut |= self._apart(sym[:-1], sym[1:])
        word = np.concatenate([[0], np.cumsum(cut, dtype=np.int32)])[: len(sym)]  # parts of words from here on
        inside = np.flatnonzero(~cut)
        pair[inside] = self.pairs(sym[inside], sym[inside + 1])
        rank = self.pair_rank[pair]
        done_sym, done_point = [], []
        while len(sym):
            n = len(sym)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, n)))
            live = least < NO_RANK
            if not live.all():
                done_sym.append(sym[~live])
                done_point.append(point[~live])
                sym, word, point, pair, rank, least = (x[live] for x in (sym, word, point, pair, rank, least))
                n = len(sym)
                if not n:
                    break
            at = np.flatnonzero(rank == least)
            # leftmost without overlap: every other place of a run of neighbouring candidates
            each = np.arange(len(at))
            new_run = np.concatenate([[True], np.diff(at) != 1])
            at = at[(each - np.maximum.accumulate(np.where(new_run, each, 0))) % 2 == 0]
            # the pairs that the merges make with what stands left (merged already, if it merges too) and right of them
            made = self.pair_id[pair[at]]
            now = sym.copy()
            now[at + 1] = made
            has_left = (at > 0) & (word[at - 1] == word[at])
            left = self.pairs(np.where(has_left, now[at - 1], -1), made)
            after = np.minimum(at + 2, n - 1)
            has_right = (at + 2 < n) & (word[after] == word[at])
            right = self.pairs(made, np.where(has_right, sym[after], -1))
            # a merge whose new pairs rank as well or better must be the word's last one in this round
            breaks = (np.minimum(self.pair_rank[left], self.pair_rank[right]) <= least[at]).astype(np.int64)
            if breaks.any():
                before = np.cumsum(breaks) - breaks
                start = np.concatenate([[True], word[at][1:] != word[at][:-1]])
                base = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                ok = before == before[base]
                at, made, has_left, left, right = at[ok], made[ok], has_left[ok], left[ok], right[ok]
            gone = np.zeros(n, bool)
            gone[at + 1] = True
            sym[at] = made
            pair[at] = right
            back = at[has_left] - 1
            back -= gone[back]
            pair[back] = left[has_left]
            rank[at] = self.pair_rank[right]
            rank[back] = self.pair_rank[left[has_left]]
            keep = ~gone
            sym, word, point, pair, rank = (x[keep] for x in (sym, word, point, pair, rank))
        sym, point = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_sym, done_point))
        order = np.argsort(point)
        sym, point = sym[order], point[order]
        word = word_of[point]
        ends = np.searchsorted(word, np.arange(len(words)), "right").tolist()
        # the same int objects everywhere, or remembered words would hold millions of their own
        flat, out, lo = list(map(self.ints.__getitem__, np.minimum(sym, self.width).tolist())), [], 0
        known = sym >= 0
        known &= sym < len(self.pieces)
        odd = set(word[~known].tolist())
        for w, hi in enumerate(ends):
            ids = flat[lo:hi]
            if w in odd:
                ids = [i for k in range(lo, hi) for i in ([flat[k]] if known[k] else self._fallback(chr(points[point[k]])))]
            out.append(ids)
            lo = hi
        return out

    def _fallback(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.encode()] if self.byte_fallback else [self.unk]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words, each of which starts with its space marks."""
        out: list[list[int]] = []
        lo = size = 0
        for i, w in enumerate(words):
            if i > lo and (i - lo >= 50_000 or size + len(w) > CHARACTERS):
                out += self._rounds(words[lo:i])
                lo, size = i, 0
            size += len(w)
        return out + self._rounds(words[lo:]) if words else out

    def decode(self, ids: list[int]) -> str:
        """Text of ids; control ids give nothing, byte ids that are no UTF-8 one replacement character a byte."""
        raw, kinds = self.raw, self.kinds
        first = next((k for k, i in enumerate(ids) if kinds[i] != CONTROL), None)
        if first is None:
            return ""
        last = len(ids) if kinds[ids[-1]] != CONTROL else len(ids) - 1
        if not self.controls.isdisjoint(ids[first:last]):  # a control id also ends a run of bytes
            cuts = [-1, *(k for k, i in enumerate(ids) if kinds[i] == CONTROL), len(ids)]
            text = "".join(b"".join([raw[i] for i in ids[lo + 1 : hi]]).decode("utf-8", "factloom-each-byte") for lo, hi in zip(cuts, cuts[1:], strict=False))
        else:
            text = b"".join(map(raw.__getitem__, ids)).decode("utf-8", "factloom-each-byte")
        return text[1:] if kinds[ids[first]] == NORMAL and text[:1] == " " else text


WORD = re.compile(f"{SPACE}+[^{SPACE}]*")


class PieceCodec:
    """A model with the words met so far."""

    def __init__(self, model: bytes):
        self.model = PieceModel(model)
        self.names = [b"%d" % i for i in range(len(self.model.pieces))]
        self.known: dict[str, tuple[int, ...]] = {}

    def words(self, texts: list[str | None]) -> list[list[tuple[int, ...]]]:
        """Ids of the words of whole texts, after meeting the new ones."""
        split = [WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        found = [list(map(self.known.get, ws)) for ws in split]
        lacking = [k for k, got in enumerate(found) if None in got]
        new = list({w for k in lacking for w, got in zip(split[k], found[k], strict=True) if got is None})
        if len(self.known) + len(new) > REMEMBERED:
            self.known, lacking, found = {}, range(len(split)), [[None] * len(ws) for ws in split]
            new = list({w for ws in split for w in ws})
        for w, ids in zip(new, self.model.encode_words(new), strict=True):
            self.known[w] = tuple(ids)
        for k in lacking:
            found[k] = [got or self.known[w] for w, got in zip(split[k], found[k], strict=True)]
        return found

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of whole texts, each closed by the end id."""
        end = (self.model.end,)
        return [list(chain.from_iterable([*ws, end])) for ws in self.words(texts)]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


@contextlib.contextmanager
def no_cycles() -> Iterator[None]:
    """Hundreds of thousands of remembered words and no cycle among them: walking them again and again finds nothing."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_codecs: dict[bytes, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """The worker's codec of a model, built once per process."""
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs[key] = PieceCodec(model)
    return _codecs[key]


def encode_ids(spark: SparkSession, docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids (array<int>, end id included)."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in batches:
            for part in slices_of(b, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(c.encode(part.column(1).to_pylist()), pa.list_(pa.int32()))], ["id", "ids"])

    return docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS id", f"CAST(`{text_col}` AS STRING) AS text").mapInArrow(run, "id long, ids array<int>")


def decode_ids(spark: SparkSession, encoded: DataFrame, model: bytes, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id, text.  Null and empty arrays decode to the empty string."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return encoded.selectExpr(f"CAST(`{id_col}` AS LONG) AS id", f"CAST(`{ids_col}` AS ARRAY<INT>) AS ids").mapInArrow(run, "id long, text string")


def round_trip(spark: SparkSession, docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256 of the decimal ids joined by spaces, decoded_sha256."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        name = c.names.__getitem__
        for b in batches:
            for part in slices_of(b, 1):
                n, of_ids, of_text = [], [], []
                with no_cycles():
                    for ids in c.encode(part.column(1).to_pylist()):
                        n.append(len(ids))
                        of_ids.append(hashlib.sha256(b" ".join(map(name, ids))).hexdigest())
                        of_text.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS id", f"CAST(`{text_col}` AS STRING) AS text")
    return rows.mapInArrow(trimmed(run), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
