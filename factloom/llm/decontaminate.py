"""Benchmark decontamination by spaced-seed hashing.

Texts become lower-cased words.  A seed is a fixed mask of 1s and 0s; the hash of a place combines the words under the 1s
and ignores those under the 0s, so a substituted word leaves the hash of some mask intact.  The masks' hashes of the
benchmark are joined with those of every document; each hit fixes a diagonal (document place minus item place), along
which item and document are compared word by word.  The overlap is the stretch with the most equal words that begins and
ends with one and in which four of five words are (``WHOLE``).  It counts when it has at least ``MIN_WORDS`` words (or as
many as the whole item, if that is shorter): substituted words inside it cost nothing of its length.

Whole copies of items are sought besides with a milder measure: an item that lies in a document along a diagonal with at
least ``WHOLE`` of its words equal is an overlap, wherever the other words are.  With so few others some run of words is
intact (four words, three or two for the shortest items), so the hashes of such runs find every one of these copies.  Of both measures the one with more equal words is reported.

The benchmark is the stated query set.  Up to ``BLOCK_WORDS`` words, counted first, its index is broadcast: one pass over the
documents, which are never shuffled.  Beyond that nothing of it goes through the driver: the hashes of items are a table,
those of documents are joined with it by an ordinary shuffle (a bitmap of fixed size, set from the items' hashes, keeps most
of the documents' hashes at home), and the diagonals that come out are verified next to the words of both.  Both ways give
the same rows.

Defined results: null and empty texts hit nothing; repeated rows are judged alike; items that repeat id and text count
once; items without a word are skipped, items without an id are not; an item of fewer than ``LEAST`` words hits only texts
that are made of just these words, since anywhere else it tells a copy from chance no more; an empty benchmark leaves all
documents clean; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.batches import slices_of, trimmed
from factloom.llm.store import Scratch, unused

MASKS = ("1101100111", "1110110101", "1011011011", "1111001101")
MIN_WORDS = 13
#: Share of equal words in an overlap, as a fraction.
WHOLE = (4, 5)
LONGEST_RUN = 4
#: Words of an item that is sought inside other texts.
LEAST = 5
BLOCK_WORDS = 400_000
WORDS = re.compile(r"\w+")
#: Words of documents hashed at once, and hits looked at together.
AT_ONCE = 400_000
HITS = 200_000
FILTER_BITS = 22
#: Bits of the bitmap over the hashes of a large benchmark: 8 MB.
BITMAP_BITS = 26


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def intact_run(n: int) -> int:
    """Length of a run of equal words that every whole copy of an item of ``n`` words has, ``LONGEST_RUN`` at most."""
    wrong = n - -(-n * WHOLE[0] // WHOLE[1])
    return min(LONGEST_RUN, -(-(n - wrong) // (wrong + 1)))


def stretch(ids: np.ndarray, item: np.ndarray, shift: int, start: int, stop: int, min_words: int) -> tuple[int, int, int, int] | None:
    """The overlap with the most equal words along a diagonal inside ``start`` to ``stop``: place, place in the item, words,
    equal words.  It begins and ends with an equal word and has a share of ``WHOLE`` of them at least."""
    lo, hi = max(shift, start), min(shift + len(item), stop)
    least = min(min_words, len(item))
    if hi - lo < least:
        return None
    equal = ids[lo:hi] == item[lo - shift : hi - shift]
    at = np.flatnonzero(equal)
    if len(at) * WHOLE[1] < least * WHOLE[0]:
        return None
    # an equal word earns what keeps the share in balance with what another costs: a stretch holds if it sums up to 0 or more
    sums = np.concatenate([[0], np.cumsum(np.where(equal, WHOLE[1] - WHOLE[0], -WHOLE[0]))])
    lowest = np.minimum.accumulate(sums[at])
    # for each end the first start with no larger sum before it, which makes the longest stretch
    first = at[np.minimum(np.searchsorted(-lowest, -sums[at + 1], "left"), len(at) - 1)]
    words = at + 1 - first
    same = np.arange(1, len(at) + 1) - np.searchsorted(at, first, "left")
    good = (words >= least) & (same * WHOLE[1] >= words * WHOLE[0])
    if not good.any():
        return None
    end = int(np.argmax(np.where(good, same, -1)))
    return (lo + int(first[end]), lo + int(first[end]) - shift, int(words[end]), int(same[end]))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def seed_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each place under a mask; word ids are spread first."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, len(mask), np.uint64)
    spread = _mix(ids.astype(np.uint64) + np.uint64(1))
    for k, on in enumerate(mask):
        if on == "1":
            h = h * np.uint64(0xD6E8FEB86659FD93) + spread[k : k + n]
    return _mix(h)


class Seeds:
    """The hashes under one mask of the items that have a fitting number of words."""

    def __init__(self, items: list[np.ndarray], mask: str, fits: Callable[[int], bool]):
        self.mask = mask
        got = [(seed_hashes(x, mask), k) for k, x in enumerate(items) if fits(len(x))]
        keys = np.concatenate([h for h, _ in got]) if got else np.zeros(0, np.uint64)
        which = np.repeat(np.array([k for _, k in got], np.int64), [len(h) for h, _ in got])
        place = np.concatenate([np.arange(len(h)) for h, _ in got]) if got else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.which, self.place = keys[order], which[order], place[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.keys >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, ids: np.ndarray) -> Iterator[np.ndarray]:
        """Rows of item, diagonal and place, for about ``HITS`` hits at a time."""
        h = seed_hashes(ids, self.mask)
        at = np.flatnonzero(self.filter[h >> np.uint64(64 - FILTER_BITS)])
        lo, hi = np.searchsorted(self.keys, h[at], "left"), np.searchsorted(self.keys, h[at], "right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        total = np.cumsum(n)
        cuts = [*np.unique(np.searchsorted(total, np.arange(0, n.sum(), HITS), "left")).tolist(), len(n)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            m = n[a:b]
            hit = np.repeat(lo[a:b], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            yield np.column_stack([self.which[hit], np.repeat(at[a:b], m) - self.place[hit], np.repeat(at[a:b], m)])


class Index:
    """Spaced-seed and run index of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], min_words: int = MIN_WORDS):
        self.min_words = min_words
        self.vocab: dict[str, int] = {}
        self.names: list[int | None] = []
        self.items: list[np.ndarray] = []
        for name, text in items:
            words = words_of(text)
            if words:
                self.names.append(name)
                self.items.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int64))
        self.size = np.array([len(x) for x in self.items], np.int64)
        self.flat = np.concatenate(self.items) if self.items else np.zeros(0, np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.short: dict[tuple[int, ...], list[int]] = {}
        for k, x in enumerate(self.items):
            if len(x) < LEAST:
                self.short.setdefault(tuple(x.tolist()), []).append(k)
        self.seeds = [Seeds(self.items, m, lambda n: n >= len(MASKS[0])) for m in MASKS]
        lengths = sorted({intact_run(len(x)) for x in self.items if len(x) >= LEAST})
        self.runs = [Seeds(self.items, "1" * r, lambda n, r=r: n >= LEAST and intact_run(n) == r) for r in lengths]

    def overlaps(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
        """(text number, item, first word in the text, first word in the item, words, equal words) of the best overlap of each text and item."""
        out: list[tuple[int, int, int, int, int, int]] = []
        if not self.items:
            return out
        get = self.vocab.get
        ids, starts, numbers, size = [], [], [], 0
        for number, text in enumerate(texts):
            w = [get(x, 0) for x in words_of(text)]
            out += [(number, self.names[k], 0, 0, len(w), len(w)) for k in self.short.get(tuple(w), ())] if len(w) < LEAST else []
            ids.extend(w)
            starts.append(size)
            numbers.append(number)
            size += len(w)
            if size >= AT_ONCE:
                out += self._scan(np.array(ids, np.int64), np.array([*starts, size]), numbers)
                ids, starts, numbers, size = [], [], [], 0
        if size:
            out += self._scan(np.array(ids, np.int64), np.array([*starts, size]), numbers)
        return out

    def _scan(self, ids: np.ndarray, starts: np.ndarray, numbers: list[int]) -> list[tuple[int, int, int, int, int, int]]:
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}

        def better(d: int, k: int, place: int, item_place: int, n: int, same: int) -> None:
            if same > best.get((d, k), (0, 0, 0, 0))[3]:
                best[d, k] = (place - int(starts[d]), item_place, n, same)

        for tasks in self._tasks(self.seeds, ids, starts):
            for d, k, shift in tasks.tolist():
                found = stretch(ids, self.items[k], shift, int(starts[d]), int(starts[d + 1]), self.min_words)
                if found:
                    better(d, k, *found)
        for tasks in self._tasks(self.runs, ids, starts):
            d, k, shift = tasks.T
            inside = (shift >= starts[d]) & (shift + self.size[k] <= starts[d + 1])
            d, k, shift = d[inside], k[inside], shift[inside]
            if not len(k):
                continue
            n = self.size[k]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            equal = ids[np.repeat(shift, n) + at] == self.flat[np.repeat(self.first[k], n) + at]
            same = np.add.reduceat(equal.astype(np.int64), np.cumsum(n) - n)
            whole = same * WHOLE[1] >= n * WHOLE[0]
            for x in np.flatnonzero(whole).tolist():
                better(int(d[x]), int(k[x]), int(shift[x]), 0, int(n[x]), int(same[x]))
        return [(numbers[d], self.names[k], *v) for (d, k), v in best.items()]

    @staticmethod
    def _tasks(seeds: list[Seeds], ids: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """Distinct (document, item, diagonal) of the hits of some seeds, for about ``HITS`` hits at a time."""
        for s in seeds:
            for found in s.hits(ids):
                doc = np.searchsorted(starts, found[:, 2], "right") - 1
                yield np.unique(np.column_stack([doc, found[:, 0], found[:, 1]]), axis=0)


def items_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Different pairs of item and text, with ``key`` standing for the text."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    return items.where("text is not null").distinct().withColumn("key", F.xxhash64("text"))


def small_index(items: DataFrame, block_words: int) -> list[tuple[int | None, str]] | None:
    """The items if they have ``block_words`` words at most, else None."""
    total = items.agg(F.sum(F.regexp_count("text", F.lit(r"(?U)\w+")).cast("long"))).first()[0] or 0
    return [(r["item"], r["text"]) for r in items.collect()] if total <= block_words else None


#: Kinds of hashes in a table: the masks, runs of one to ``LONGEST_RUN`` words, and whole texts of fewer than ``LEAST``.
PATTERNS = (*MASKS, *("1" * r for r in range(1, LONGEST_RUN + 1)))
SHORT = len(PATTERNS)
SEED = "kind int, seed long"


def word_ids(text: str | None, known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of the words; ``known`` remembers them."""
    words = words_of(text)
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 5)
    if len(known) > AT_ONCE:
        out = np.array([known[w] for w in words], np.uint64)
        known.clear()
        return out
    return np.array([known[w] for w in words], np.uint64)


def _short_seed(ids: np.ndarray) -> np.ndarray:
    return seed_hashes(ids, "1" * len(ids)) + np.uint64(len(ids))


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for b in (x for batch in batches for x in slices_of(batch, 1)):
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = word_ids(text, known)
            n = len(ids)
            if n < LEAST:
                got = [(SHORT, _short_seed(ids))] if n else []
            else:
                got = [(k, seed_hashes(ids, m)) for k, m in enumerate(PATTERNS) if (n >= len(m) if k < len(MASKS) else intact_run(n) == len(m))]
            for kind, h in got:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), key, np.int64)), pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(np.arange(len(h), dtype=np.int32))],
                    ["key", "kind", "seed", "item_place"],
                )


def _text_seeds(bitmap: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        bits = np.unpackbits(np.frombuffer(bitmap.value, np.uint8), bitorder="little").view(bool)
        for b in (x for batch in batches for x in slices_of(batch, 2)):
            for m1, m2, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                ids = word_ids(text, known)
                got = [(k, seed_hashes(ids, m)) for k, m in enumerate(PATTERNS)]
                got += [(SHORT, _short_seed(ids))] if 0 < len(ids) < LEAST else []
                at = [np.flatnonzero(bits[h >> np.uint64(64 - BITMAP_BITS)]) for _, h in got]
                n = sum(len(x) for x in at)
                if n:
                    kinds = np.concatenate([np.full(len(x), k, np.int32) for (k, _), x in zip(got, at, strict=True)])
                    seeds = np.concatenate([h[x] for (_, h), x in zip(got, at, strict=True)]).view(np.int64)
                    marks = [pa.array(np.full(n, m, np.int64)) for m in (m1, m2)]
                    yield pa.RecordBatch.from_arrays([*marks, pa.array(kinds), pa.array(seeds), pa.array(np.concatenate(at).astype(np.int32))], ["m1", "m2", "kind", "seed", "place"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best overlap of each text and item, given their texts and diagonals."""
    known: dict[str, int] = {}
    last, ids = None, np.zeros(0, np.uint64)
    names = ["m1", "m2", "key", "doc_word", "item_word", "n_words", "n_equal"]
    for batch in batches:
        out = []
        for m1, m2, key, text, item, shifts in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if (m1, m2) != last:
                last, ids = (m1, m2), word_ids(text, known)
            words = word_ids(item, known)
            found = []
            for x in shifts:
                shift = x["shift"]
                if len(words) < LEAST:
                    found += [(0, 0, len(ids), len(ids))] if np.array_equal(ids, words) else []
                elif x["masked"]:
                    found.append(stretch(ids, words, shift, 0, len(ids), MIN_WORDS))
                elif 0 <= shift and shift + len(words) <= len(ids):
                    same = int((ids[shift : shift + len(words)] == words).sum())
                    if same * WHOLE[1] >= len(words) * WHOLE[0]:
                        found.append((shift, 0, len(words), same))
            best = max((f for f in found if f), key=lambda f: f[3], default=None)
            if best:
                out.append((m1, m2, key, *best))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 7)], names)


def _marked(docs: DataFrame, text_col: str, m1: str, m2: str) -> DataFrame:
    """With two hashes that stand for the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn(m1, F.xxhash64(text)).withColumn(m2, F.xxhash64(F.lit(1), text))


def joined_overlaps(spark: SparkSession, texts: DataFrame, items: DataFrame) -> DataFrame:
    """Overlaps of ``texts(m1, m2, text)`` and ``items(key, text)``: m1, m2, key, doc_word, item_word, n_words, n_equal."""
    scratch = Scratch(spark, "decontaminate")
    items = items.dropDuplicates(["key"]).select("key", "text")
    seeds = scratch.keep(items.mapInArrow(trimmed(_item_seeds), f"key long, {SEED}, item_place int"), "seeds")
    # a bitmap in words of 64 bits: as many rows as it has words at most, whatever the number of seeds
    bit = F.shiftrightunsigned("seed", 64 - BITMAP_BITS)
    one = F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(seed, {64 - BITMAP_BITS}) % 64 AS INT))")
    words = seeds.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    bitmap[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(bitmap.tobytes())
    asked = texts.select("m1", "m2", "text").mapInArrow(trimmed(_text_seeds(shared)), f"m1 long, m2 long, {SEED}, place int")
    met = asked.join(seeds, ["kind", "seed"]).select("m1", "m2", "key", (F.col("place") - F.col("item_place")).alias("shift"), (F.col("kind") < len(MASKS)).alias("masked"))
    met = scratch.keep(met.groupBy("m1", "m2", "key").agg(F.collect_set(F.struct("shift", "masked")).alias("shifts")), "met")
    hit = texts.join(met.select("m1", "m2").distinct(), ["m1", "m2"], "left_semi").dropDuplicates(["m1", "m2"])
    both = met.join(items.withColumnRenamed("text", "item"), "key").join(hit, ["m1", "m2"]).select("m1", "m2", "key", "text", "item", "shifts")
    found = both.mapInArrow(trimmed(_verify), "m1 long, m2 long, key long, doc_word long, item_word long, n_words long, n_equal long")
    return scratch.keep(found, "found")


def overlaps(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document row and item that overlap: id, item, doc_word, item_word, n_words, n_equal."""
    schema = "id long, item long, doc_word long, item_word long, n_words long, n_equal long"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = items_of(benchmark, item_col, item_text_col)
    small = small_index(items, block_words)
    if small is None:
        marked = _marked(rows, "text", "m1", "m2")
        found = joined_overlaps(spark, marked.select("m1", "m2", "text"), items)
        found = marked.select("id", "m1", "m2").join(found, ["m1", "m2"]).join(items.select("key", "item"), "key")
        return found.select("id", "item", "doc_word", "item_word", "n_words", "n_equal")
    shared = spark.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for b in (x for batch in batches for x in slices_of(batch, 1, 4_000_000)):
            found = index.overlaps(b.column(1).to_pylist())
            of = b.column(0).to_pylist()
            cols = [[of[f[0]] for f in found], *([f[k] for f in found] for k in range(1, 6))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "item", "doc_word", "item_word", "n_words", "n_equal"])

    return rows.mapInArrow(trimmed(run), schema)


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, with all their columns."""
    items = items_of(benchmark, item_col, item_text_col)
    small = small_index(items, block_words)
    if small is None:
        m1, m2 = unused(docs, "m1", "m2")
        marked = _marked(docs, text_col, m1, m2)
        texts = marked.select(F.col(m1).alias("m1"), F.col(m2).alias("m2"), F.col(text_col).cast("string").alias("text"))
        found = joined_overlaps(spark, texts, items).select(F.col("m1").alias(m1), F.col("m2").alias(m2)).distinct()
        return marked.join(found, [m1, m2], "left_anti").select(*docs.columns)
    shared = spark.sparkContext.broadcast(small)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for b in (x for batch in batches for x in slices_of(batch, at, 4_000_000)):
            clean = np.ones(b.num_rows, bool)
            clean[[f[0] for f in index.overlaps(b.column(at).cast(pa.string()).to_pylist())]] = False
            yield b.filter(pa.array(clean))

    return docs.mapInArrow(trimmed(run), docs.schema)
