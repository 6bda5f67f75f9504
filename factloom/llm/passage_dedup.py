"""Substring deduplication: paragraph MinHash banding, exact Jaccard on colliding paragraphs, removals by components.

A paragraph is one of two things:

* a line of at least ``least_words`` words (five: a line without a 5-word shingle has nothing to compare);
* a stretch inside a text, so that a passage pasted into the middle of a line is found although its lines differ.  Stretches
  begin where the text itself says so, at shingles that are the least of all within ``RADIUS`` places, and reach to the next
  such place, ten words or more.  Each shingle begins in one stretch only, so neighbours have nothing in common.  Equal
  passages begin and end their stretches at the same words wherever they stand: of runs of 51 equal words 99 in 100 hold
  a whole one, of 60 words 99.9.

All paragraphs go the same way.  Their 5-word shingles give ``BANDS`` keys of ``ROWS`` MinHash values; two paragraphs at
Jaccard 0.8 share a key with probability 1 - (1 - 0.8^2)^4 = 0.98, equal ones always.  Keys are shuffled once and sorted;
paragraphs that meet under a key are compared by the exact Jaccard similarity of their shingle sets.  Large groups
are dealt into blocks of about 4 sqrt(size) paragraphs, every pair of blocks a task of its own, and a task hands on a
spanning forest of its links, not all pairs.  Components of links are the passages; of each that stands in two documents or
more, the occurrence with the smallest id (then first place) stays.

Hot keys.  Paragraphs that repeat inside a slice of a partition count once or twice there, so a line in a third of all
documents is a few rows per slice.  A key that many *different* paragraphs of one slice share is hot for certain: those
paragraphs travel salted, as members, and leave one of them under the plain key to meet those of other slices.

Equality of paragraphs is equality of a 64-bit hash over their shingles' hashes, which is not checked against the bytes: among
n different paragraphs n^2 / 2^65 pairs are expected to be taken for one (0.03 at a billion).

Words are runs of non-space bytes, A-Z lower-cased.  Defined results: null, empty and short texts have no paragraphs; rows
with a null id are left out; occurrences within one document alone are no repetition; rows that share an id count as one
document, whatever their texts; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.batches import trimmed
from factloom.llm.components import connected_components
from factloom.llm.jaccard import verify_sets
from factloom.llm.store import Scratch
from factloom.llm.suffix_dedup import slide_min

SHINGLE = 5
SIMILAR = 0.8
RADIUS = 5
BANDS = 4
ROWS = 2
#: Different paragraphs of one slice under one key that make the key a hot one, and the parts it is then dealt into.
HOT, SALT = 64, 64
#: bytes worked on at once
AT_ONCE = 1_000_000
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_random = np.random.default_rng(77003)
LETTER = _random.integers(0, 2**64, 256, np.uint64)
PLACE = _random.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
PERMUTE = _random.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
LOW = np.uint64((1 << 20) - 1)
LINE, INNER = 0, 1


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of several texts: byte places, hashes, text and line numbers, and hashes of the 5-word shingles."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        space = SPACE[data]
        self.lo = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        self.hi = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
        at = np.flatnonzero(~space)
        n = self.hi - self.lo
        off = at - np.repeat(self.lo, n)
        first = np.cumsum(n) - n
        self.hash = mix(np.add.reduceat(LETTER[data[at]] * PLACE[off & 255] + (off >> 8).astype(np.uint64), first)) if len(n) else np.zeros(0, np.uint64)
        self.text = np.searchsorted(begin, self.lo, "right") - 1
        self.line = np.cumsum(data == 10)[self.lo] if len(n) else self.lo
        self.lo, self.hi = self.lo - begin[self.text], self.hi - begin[self.text]
        m = max(0, len(n) - SHINGLE + 1)
        h = np.zeros(m, np.uint64)
        for k in range(SHINGLE):
            h = h * np.uint64(0xC2B2AE3D27D4EB4F) + self.hash[k : k + m]
        self.shingle = mix(h)

    def lines(self, least_words: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of words of each line that is long enough."""
        if not len(self.line):
            return self.line, self.line
        first = np.flatnonzero(np.concatenate([[True], self.line[1:] != self.line[:-1]]))
        n = np.diff(np.append(first, len(self.line)))
        return first[n >= least_words], n[n >= least_words]

    def stretches(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of words of each stretch; none looks or reaches beyond the end of its text."""
        m, width = len(self.shingle), 2 * RADIUS + 1
        if m < width:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = []
        for lo in range(0, m - width + 1, 1 << 19):  # a place must fit the low bits of the sort key
            v = self.shingle[lo : lo + (1 << 19) + width - 1]
            least = (slide_min((v & ~LOW) | np.arange(len(v), dtype=np.uint64), width) & LOW).astype(np.int64)
            opens = np.flatnonzero(least == np.arange(len(least)) + RADIUS) + lo
            found.append(opens[self.text[opens] == self.text[opens + width + SHINGLE - 2]] + RADIUS)
        at = np.concatenate(found)
        whole = np.flatnonzero(self.text[at[1:]] == self.text[at[:-1]])
        return at[whole], at[whole + 1] - at[whole] + SHINGLE - 1


class Paragraphs:
    """Paragraphs of some texts: first word, number of words, kind, shingles (flat, with cuts) and content."""

    def __init__(self, texts: list[bytes], least_words: int, inner: bool = True):
        self.words = w = Words(texts)
        (a, n), (b, m) = w.lines(least_words), w.stretches() if inner else (np.zeros(0, np.int64),) * 2
        self.first, self.count = np.concatenate([a, b]), np.concatenate([n, m])
        self.kind = np.repeat(np.array([LINE, INNER], np.uint64), [len(a), len(b)])
        self.text = w.text[self.first] if len(self.first) else self.first
        self.many = np.maximum(self.count - SHINGLE + 1, 1)  # a shorter one is one shingle of all its words
        self.cut = np.cumsum(self.many) - self.many
        short = np.flatnonzero(self.count < SHINGLE)
        at = np.repeat(self.first - self.cut, self.many) + np.arange(self.many.sum())
        self.shingle = w.shingle[np.minimum(at, len(w.shingle) - 1)] if len(w.shingle) else np.zeros(len(at), np.uint64)
        h = self.count[short].astype(np.uint64)
        for k in range(SHINGLE - 1):
            on = self.count[short] > k
            h[on] = mix(h[on] * np.uint64(0x100000001B3) + w.hash[self.first[short][on] + k])
        self.shingle[self.cut[short]] = h
        place = PLACE[(np.arange(len(at)) - np.repeat(self.cut, self.many)) & 255]
        self.sums = np.add.reduceat(self.shingle * place, self.cut) if len(at) else np.zeros(0, np.uint64)
        self.content = self.content_as(self.kind)

    def content_as(self, kind: np.ndarray | np.uint64) -> np.ndarray:
        """What stands for the paragraphs if they are of this kind."""
        return mix(self.sums + self.count.astype(np.uint64) * np.uint64(2) + kind)

    def bands(self) -> np.ndarray:
        """The keys of each paragraph, ``BANDS`` to a row."""
        least = [np.minimum.reduceat((self.shingle * p) >> np.uint64(32), self.cut) for p in PERMUTE]
        out = np.empty((len(self.first), BANDS), np.uint64)
        for b in range(BANDS):
            key = self.kind * np.uint64(BANDS) + np.uint64(b)
            for r in range(ROWS):
                key = mix(key * np.uint64(0x100000001B3) + least[b * ROWS + r])
            out[:, b] = key
        return out


def _together(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > AT_ONCE:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def _slices(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[tuple[np.ndarray, Paragraphs]]:
    """Ids and paragraphs of the rows that have an id, for slices of texts."""
    for batch in batches:
        batch = batch.filter(batch.column(0).is_valid())
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        for lo, hi in _together(texts):
            p = Paragraphs(texts[lo:hi], least_words)
            if len(p.first):
                yield ids[lo:hi][p.text], p


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns]


def _keys(least_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (band, salt, content): every paragraph of a slice under its keys, under the first key twice if it repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, p in _slices(batches, least_words):
            content, one, times = np.unique(p.content, return_index=True, return_counts=True)
            bands = p.bands()[one]
            for b in range(BANDS):
                key = bands[:, b]
                order = np.argsort(key, kind="stable")
                turn = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
                size = np.diff(np.append(turn, len(order)))
                group = np.repeat(np.arange(len(turn)), size)
                hot = size[group] > HOT
                hot[turn] = False  # one of them stays under the plain key, and travels salted as well
                salt = np.where(hot, 1 + (content[order] % np.uint64(SALT)).astype(np.int64), 0)
                more = [order, order[turn][size > HOT]]
                salts = [salt, 1 + (content[more[1]] % np.uint64(SALT)).astype(np.int64)]
                if b == 0:
                    again = order[(times[order] > 1) & (salt == 0)]
                    more.append(again)
                    salts.append(np.zeros(len(again), np.int64))
                rows = np.concatenate(more)
                yield pa.RecordBatch.from_arrays(_longs(key[rows], np.concatenate(salts), content[rows]), ["band", "salt", "content"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (band, salt, content): (band, content) where a key has several contents or is salted, and (null,
    content) for contents that repeat.  A group may span batches; what is carried over is one row."""
    carry: tuple[np.ndarray, np.ndarray, np.ndarray, bool] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        band, salt, content = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        told = False  # whether the first row has been handed on already
        if carry is not None:
            band, salt, content = (np.concatenate([x, y]) for x, y in zip(carry[:3], (band, salt, content), strict=True))
            told = carry[3]
        turn = np.concatenate([[True], (band[1:] != band[:-1]) | (salt[1:] != salt[:-1])])
        new = turn.copy()
        new[1:] |= content[1:] != content[:-1]
        lead = np.flatnonzero(new)  # one row for each content of a group
        several = np.zeros(len(lead), bool)
        several[1:] = ~turn[lead[1:]]
        several[:-1] |= several[1:]
        # the first row may be the second or later content of a group that began in the batch before
        several |= salt[lead] > 0
        state = several.copy()
        state[0] |= told
        if told:
            several[0] = False
        out = lead[several]
        again = np.unique(content[~new])
        carry = (band[-1:], salt[-1:], content[-1:], bool(state[-1]))
        bands = pa.concat_arrays([pa.array(band[out], pa.int64()), pa.nulls(len(again), pa.int64())])
        yield pa.RecordBatch.from_arrays([bands, pa.array(np.concatenate([content[out], again]), pa.int64())], ["band", "content"])


def _occurrences(least_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, p in _slices(batches, least_words):
            places = [p.words.lo[p.first].astype(np.int32), p.words.hi[p.first + p.count - 1].astype(np.int32)]
            yield pa.RecordBatch.from_arrays(_longs(ids, *places, p.content), ["id", "start", "stop", "content"])

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of shingles of paragraphs given by text and places; places that hold something else are left out."""
    for batch in batches:
        for text, places in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or b""
            # a paragraph reads as a line here, whose content differs from a stretch's by the kind alone
            p = Paragraphs([text[x["start"] : x["stop"]].replace(b"\n", b" ") for x in places], 1, inner=False)
            asked = np.array([x["content"] for x in places], np.int64).view(np.uint64)[p.text]
            right = np.flatnonzero((p.content_as(np.uint64(LINE)) == asked) | (p.content_as(np.uint64(INNER)) == asked))
            sets = [np.unique(p.shingle[p.cut[k] : p.cut[k] + p.many[k]]).view(np.int64) for k in right.tolist()]
            columns = [pa.array(asked[right].view(np.int64)), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["content", "shingles"])


def paragraph_links(docs: DataFrame, met: DataFrame, places: DataFrame, scratch: Scratch, least: float) -> DataFrame:
    """Verified links (a, b) between different paragraphs: ``docs(id, text)``, ``met(band, content)``, ``places(content, id,
    start, stop)``."""
    members = met.where("band is not null").distinct()
    sizes = members.groupBy("band").agg(F.count("*").alias("n"))
    members = members.join(sizes, "band").select("band", "content", F.greatest(F.lit(1), F.ceil(F.sqrt("n") / 4)).cast("long").alias("blocks"))
    members = scratch.keep(members, "members")
    first = places.groupBy("content").agg(F.min(F.struct("id", "start", "stop")).alias("first"))
    wanted = first.join(members.select("content").distinct(), "content", "left_semi").select("content", "first.*")
    asked = scratch.keep(wanted.groupBy("id").agg(F.collect_list(F.struct("content", "start", "stop")).alias("places")), "asked")
    texts = docs.join(asked, "id").select("text", "places")
    sets = scratch.keep(texts.mapInArrow(trimmed(_shingles), "content long, shingles array<long>").dropDuplicates(["content"]), "shingles")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("content"), F.col("blocks")))
    dealt = dealt.select("band", "content", "block", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
    pair = (F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    tasks = dealt.join(sets, "content").select("band", *pair, F.col("block").alias("part"), "content", "shingles")
    return tasks.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(trimmed(verify_sets(least)), "a long, b long")


def _found(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, similar: float, least_words: int) -> DataFrame:
    """Occurrences of passages of two documents or more: id, start, stop, content, passage, keep_id, removed."""
    scratch = Scratch(spark, "passage_dedup")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keys = rows.mapInArrow(trimmed(_keys(least_words)), "band long, salt long, content long").repartition("band", "salt")
    met = scratch.keep(keys.sortWithinPartitions("band", "salt", "content").mapInArrow(_meet, "band long, content long"), "met")
    places = rows.mapInArrow(trimmed(_occurrences(least_words)), "id long, start int, stop int, content long")
    # only what has met something is kept; a paragraph that is everywhere is the streamed side, which a skewed join may split
    places = scratch.keep(places.join(scratch.keep(met.select("content").distinct(), "contents"), "content"), "places")
    root = connected_components(spark, paragraph_links(rows, met, places, scratch, similar), scratch).withColumnRenamed("node", "content")
    named = places.join(root, "content", "left").select("id", "start", "stop", "content", F.coalesce("root", "content").alias("passage"))
    named = scratch.keep(named, "named")
    # written, so that the join has a plain shuffle on either side and a passage that is everywhere can be split
    first = named.groupBy("passage").agg(F.min(F.struct("id", "start")).alias("first"), F.max("id").alias("last"))
    first = scratch.keep(first.where("first.id < last").select("passage", "first"), "first")
    removed = F.struct("id", "start") != F.col("first")
    return named.join(first, "passage").select("id", "start", "stop", "content", "passage", F.col("first.id").alias("keep_id"), removed.alias("removed"))


def repeated_passages(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, least_words: int = SHINGLE) -> DataFrame:
    """Occurrences of passages that stand in two documents or more: id, start, stop (bytes), passage, keep_id, removed."""
    return _found(spark, docs, id_col, text_col, similar, least_words).drop("content")


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of some bytes without spans, which may overlap."""
    out, at = [], 0
    for start, stop in sorted(spans):
        if start > at:
            out.append(data[at:start])
        at = max(at, stop)
    return b"".join([*out, data[at:]])


def drop_passages(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, least_words: int = SHINGLE) -> DataFrame:
    """One row per input row: id and ``kept``, the text (binary) without the removed occurrences.

    Of rows that share an id each loses what it holds itself at the places found; rows with a null id lose nothing.
    """
    gone = _found(spark, docs, id_col, text_col, similar, least_words).where("removed")
    gone = gone.groupBy(F.col("id").alias("of")).agg(F.collect_set(F.struct("start", "stop", "content")).alias("places"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    both = rows.join(gone, rows["id"] == gone["of"], "left").select("id", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, places in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text or b""
                if places:
                    p = Paragraphs([text], least_words)
                    ends = p.words.hi[p.first + p.count - 1]
                    held = zip(p.words.lo[p.first].tolist(), ends.tolist(), p.content.view(np.int64).tolist(), strict=True)
                    text = without(text, [x[:2] for x in {(x["start"], x["stop"], x["content"]) for x in places}.intersection(held)])
                kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], ["id", "kept"])

    return both.mapInArrow(trimmed(run), "id long, kept binary")
