"""Removal of repeated byte strings: bucket-pointer refinement over the suffixes of a whole corpus.

A byte goes if it is covered by a ``DEPTH``-byte string that also starts in a document with a smaller id.  To know this,
the suffixes of all documents need sorting to depth 50 only, as far as telling equal from different strings; the order of
unequal ones does not matter.  As in bucket-pointer refinement, suffixes first fall into q-gram buckets; a bucket is
refined by the bucket identifiers found at later offsets of its suffixes, and identifiers of deep buckets are built from
those of shallower ones (1, 2, 4, 8, 16, then 20, 25 and the pair 25 + 25 = 50 bytes).  Identifiers are 64-bit functions of
the bucket's string, so all machines agree on them without numbering buckets globally; a string of 50 bytes is told by
the pair of its two 25-byte identifiers, 128 bits.

Not all suffixes need to be sorted:

1. A 50-byte string is represented by its least q-gram (by identifier, leftmost among equals), which depends on the
   string alone.  Neighbouring strings with the same least q-gram form a *run*; a text has one run per 15 bytes or so.
   Runs fall into the bucket of their q-gram and are refined by the identifiers at the later offsets that cover them, all
   at once: equal runs hold equal strings throughout.  Of equal runs, those beyond the smallest id go as a whole.
2. Only buckets in which different runs meet are refined further, string by string, and only one run of each kind: the
   one with the smallest id, the others being gone already.

Texts are packed into compressed chunks of a few megabytes; what chunks send to a bucket's task is combined per chunk
first (one entry for each different run, with its smallest id), as arrays cut by identifier ranges.  A passage in a third
of all documents is therefore one entry per chunk, not one per document, and the texts travel only in compressed form.

A chunk cuts its entries into ``FAN`` ranges, however large the input.  Where a range is more than one task can sort, its
arrays are put together from several chunks and cut into ``FAN`` narrower ones, and so on: a pass over the entries for
every factor of ``FAN`` (two passes to 150 GB of text or so, three to 20 TB), and in every pass a number of arrays in
proportion to the input.  With more than one pass the entries are written once, in ``SHARES`` parts by range, and the parts
go through the passes one after the other, so that the disk holds the shuffles of one part at a time.

Strings are taken for equal when 128 bits of identifiers are; bytes are not compared.  Among n different strings
n^2 / 2^129 pairs are expected to be mistaken (10^-11 at 10^14 strings).

Defined results: a null text counts as empty; texts shorter than 50 bytes lose nothing; a null id sorts below all others;
rows repeated with one id do not remove each other's bytes, copies under a larger id go as a whole; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.batches import slices_of, trimmed
from factloom.llm.store import Scratch

DEPTH = 50
HALF = 25
GRAM = 20
CHUNK_BYTES = 3_000_000
#: bytes worked on at once; positions must fit the low 20 bits of a sort key
SLICE = 100_000
#: entries a bucket task gets on average
TASK_ENTRIES = 600_000
#: ranges that a sender cuts its entries into: a power of two
FAN_BITS = 7
#: parts of the ranges that are settled one after the other where one pass is not enough: a power of two
SHARES = 8
#: entries of several chunks that are put together before they are cut again
MERGED = 200_000
NO_ID = -(2**63)
C2, C3 = (np.uint64(c) for c in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_random = np.random.default_rng(20240229)
LETTER = _random.integers(0, 2**64, 256, np.uint64)
FACTOR = _random.integers(0, 2**63, 10, np.uint64) * np.uint64(2) + np.uint64(1)
LOW = np.uint64((1 << 20) - 1)


def join(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """Identifier of a bucket from those of its first part and of the part at the later offset.

    A sum of letter values with an odd factor of its own for each place: levels have factors of their own, else letters
    could change places unseen.  ``mix`` spreads what comes out.
    """
    h = a * FACTOR[level]
    h += b
    return h


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= C2
    h ^= h >> np.uint64(29)
    h *= C3
    h ^= h >> np.uint64(32)
    return h


def identifiers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the GRAM bytes and of the HALF bytes that start at each place."""
    one = LETTER[data]
    two = join(one[:-1], one[1:], 0)
    four = join(two[:-2], two[2:], 1)
    eight = join(four[:-4], four[4:], 2)
    sixteen = join(eight[:-8], eight[8:], 3)
    twenty = join(sixteen[:-4], four[16:], 4)
    return mix(twenty), mix(join(join(twenty[:-4], four[20:], 5)[:-1], one[24:], 6))


def slide_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width``, by doubling."""
    have, m = 1, v
    while have * 2 <= width:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


class Runs:
    """Runs of one slice: first string, number of strings, bucket, refined identifier, document."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, docs: np.ndarray):
        n = len(data)
        self.first = self.count = self.doc = np.zeros(0, np.int64)
        self.bucket = self.kind = np.zeros(0, np.uint64)
        if n < DEPTH:
            return
        gram, h = identifiers(data)
        least = slide_min((gram & ~LOW) | np.arange(len(gram), dtype=np.uint64), DEPTH - GRAM + 1)
        at = (least & LOW).astype(np.int64)
        doc = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
        whole = doc[: n - DEPTH + 1] == doc[DEPTH - 1 :]
        turn = np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1 : n - DEPTH + 1] != doc[: n - DEPTH])])
        turn[1:] |= ~whole[:-1]
        self.first = np.flatnonzero(turn & whole)
        stop = np.flatnonzero(np.concatenate([(turn | ~whole)[1:], [True]]) & whole) + 1
        self.count = stop - self.first
        # mixed anew: these are minima, and tasks take ranges of identifiers
        self.bucket = mix(gram[at[self.first]])
        end = stop + DEPTH - 1
        self.kind = mix(mix(join(join(h[self.first], h[self.first + HALF], 7), join(h[end - 2 * HALF], h[end - HALF], 8), 9)) + (self.count.astype(np.uint64) << np.uint64(8)) + (at[self.first] - self.first).astype(np.uint64))
        self.doc = docs[doc[self.first]]


class Chunk:
    """Texts of one chunk; slices of at most SLICE bytes, long texts cut with an overlap of DEPTH - 1 bytes."""

    def __init__(self, ids: bytes, sizes: bytes, blob: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.sizes = np.frombuffer(sizes, np.int64)
        self.data = np.frombuffer(zstandard.decompress(blob), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def slices(self) -> Iterator[tuple[int, Runs]]:
        at, many = 0, len(self.sizes)
        while at < many:
            lo, to = int(self.starts[at]), at
            while to < many and int(self.starts[to] + self.sizes[to]) - lo <= SLICE:
                to += 1
            if to > at:
                ends = self.starts[at:to] + self.sizes[at:to] - lo
                yield lo, Runs(self.data[lo : lo + int(ends[-1])], ends, np.arange(at, to))
                at = to
            else:
                stop = int(self.starts[at] + self.sizes[at])
                for b in range(lo, stop - DEPTH + 1, SLICE - DEPTH + 1):
                    e = min(b + SLICE, stop)
                    yield b, Runs(self.data[b:e], np.array([e - b]), np.array([at]))
                at += 1

    def runs(self) -> Chunk:
        """All runs: first (in the chunk), count, bucket, kind, doc; then groups of equal runs."""
        parts = list(self.slices())
        get = lambda f, t: np.concatenate([f(lo, r) for lo, r in parts]) if parts else np.zeros(0, t)
        self.first, self.count, self.doc = get(lambda lo, r: r.first + lo, np.int64), get(lambda lo, r: r.count, np.int64), get(lambda lo, r: r.doc, np.int64)
        self.bucket, self.kind = get(lambda lo, r: r.bucket, np.uint64), get(lambda lo, r: r.kind, np.uint64)
        self.id = self.ids[self.doc]
        self.group, self.lead, self.least = grouped(self.bucket, self.kind, self.id)
        return self

    def strings(self, groups: np.ndarray):
        """Strings of the runs in these groups whose document has the group's smallest id: start, pair, document."""
        chosen = np.zeros(len(self.lead), bool)
        chosen[groups] = True
        runs = np.flatnonzero(chosen[self.group] & (self.id == self.least[self.group]))
        n = self.count[runs]
        start = np.repeat(self.first[runs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        k1, k2 = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
        done = 0
        for lo in range(0, len(runs), 4000):
            # the runs' bytes one after another; strings across a seam are never asked for
            first, many = self.first[runs[lo : lo + 4000]], n[lo : lo + 4000]
            size = many + DEPTH - 1
            seam = np.cumsum(size) - size
            _, half = identifiers(self.data[np.repeat(first - seam, size) + np.arange(size.sum())])
            at = np.repeat(seam - (np.cumsum(many) - many), many) + np.arange(many.sum())
            k1[done : done + len(at)], k2[done : done + len(at)] = half[at], half[at + HALF]
            done += len(at)
        return start, k1, k2, np.repeat(self.id[runs], n)


def ordered(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order by (a, b, ids); most values of a stand alone, so only its ties are sorted by the rest."""
    order = np.argsort(a)
    s = a[order]
    tie = np.zeros(len(s) + 1, bool)
    tie[1:-1] = s[1:] == s[:-1]
    among = np.flatnonzero(tie[1:] | tie[:-1])
    part = order[among]
    order[among] = part[np.lexsort((ids[part], b[part], a[part]))]
    return order


def grouped(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group number of each entry by (a, b) in sorted order, an entry of each group, and its smallest id."""
    order = ordered(a, b, ids)
    new = np.ones(len(order), bool)
    x, y = a[order], b[order]
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    group = np.zeros(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    lead = order[new]
    return group, lead, ids[lead]


def pack(v: np.ndarray, ascending: bool = False) -> bytes:
    """Byte planes of 64-bit numbers (of their differences if ascending): what is equal lies together and compresses."""
    v = v.astype(np.uint64)
    if ascending:
        v = np.diff(v, prepend=np.uint64(0))
    return np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(b: bytes, ascending: bool = False) -> np.ndarray:
    v = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(v, dtype=np.uint64) if ascending else v


def _table(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0

    def packed() -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts], np.int64)
        blob = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
        return _table({"p": ([part << 32 | number], pa.int64()), "ids": ([np.array(ids, np.int64).tobytes()], pa.binary()), "sizes": ([sizes.tobytes()], pa.binary()), "blob": ([blob], pa.binary())})

    for b in (x for batch in batches for x in slices_of(batch, 1)):
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            ids.append(NO_ID if i is None else i)
            texts.append(t or b"")
            size += len(texts[-1])
            if size >= CHUNK_BYTES:
                yield packed()
                ids, texts, size, number = [], [], 0, number + 1
    if ids:
        yield packed()


def same(v: np.ndarray) -> bytes:
    """Equal numbers as one, others as byte planes."""
    return v[:1].astype(np.uint64).tobytes() if (v[1:] == v[:-1]).all() else pack(v)


def unsame(b: bytes, n: int) -> np.ndarray:
    return np.repeat(np.frombuffer(b, np.uint64), n) if len(b) == 8 else unpack(b)


def counted(v: np.ndarray) -> bytes:
    """Numbers one after the other as the first, others as byte planes."""
    return v[:1].astype(np.uint64).tobytes() if (np.diff(v) == 1).all() else pack(v)


def uncounted(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, np.uint64) + np.arange(n, dtype=np.uint64) if len(b) == 8 else unpack(b)


ENTRY = "r int, salt int, p binary, number binary, a binary, b binary, ids binary"


def _entries(coarse: int, level: int, p: np.ndarray, number: np.ndarray, a: np.ndarray, b: np.ndarray, ids: np.ndarray, salts: int) -> Iterator[pa.RecordBatch]:
    """Entries of one range of the level before, ascending by ``a``, cut into the ranges of this level."""
    fan = 1 << FAN_BITS
    cut = np.searchsorted((a >> np.uint64(64 - FAN_BITS * level)).astype(np.int64) - coarse * fan, np.arange(fan + 1))
    for k in range(fan):
        lo, hi = int(cut[k]), int(cut[k + 1])
        if lo < hi:
            salt = int(p[lo]) % salts
            columns = [same(p[lo:hi]), counted(number[lo:hi]), pack(a[lo:hi], True), pack(b[lo:hi]), pack(ids[lo:hi].view(np.uint64))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([coarse * fan + k], pa.int32()), pa.array([salt], pa.int32()), *(pa.array([c], pa.binary()) for c in columns)],
                ["r", "salt", "p", "number", "a", "b", "ids"],
            )


def _loaded(t: pa.Table) -> tuple[np.ndarray, ...]:
    """p, number, a, b and ids of the entries of some arrays, one after the other."""
    got: list[list[np.ndarray]] = [[], [], [], [], []]
    for p, number, a, b, ids in zip(*(t.column(c).to_pylist() for c in ("p", "number", "a", "b", "ids")), strict=True):
        a = unpack(a, True)
        for k, v in enumerate((unsame(p, len(a)), uncounted(number, len(a)), a, unpack(b), unpack(ids).view(np.int64))):
            got[k].append(v)
    return tuple(np.concatenate(x) for x in got)


def _narrow(level: int, salts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrays of several senders, put together and cut into the ranges of the next level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, list[pa.RecordBatch]] = {}
        sizes: dict[int, int] = {}

        def cut(r: int) -> Iterator[pa.RecordBatch]:
            p, number, a, b, ids = _loaded(pa.Table.from_batches(ranges.pop(r)))
            sizes.pop(r)
            order = np.argsort(a, kind="stable")
            yield from _entries(r, level, p[order], number[order], a[order], b[order], ids[order], salts)

        for batch in batches:
            for k, (r, a) in enumerate(zip(batch.column(0).to_pylist(), batch.column(4), strict=True)):
                ranges.setdefault(r, []).append(batch.slice(k, 1))
                sizes[r] = sizes.get(r, 0) + len(a.as_buffer()) // 8
                if sizes[r] >= MERGED:
                    yield from cut(r)
        for r in list(ranges):
            yield from cut(r)

    return run


def exchanged(entries: DataFrame, tasks: int, shares: int = 1) -> DataFrame:
    """Entries of the first level (those of one of ``shares`` parts) brought to tasks that each hold whole ranges."""
    depth, at_once = 1, -(-tasks // shares)
    while (1 << FAN_BITS * depth) < tasks:
        # any task may put arrays of a range together, so that few ranges still make many tasks
        salts = max(1, tasks >> FAN_BITS * (depth + 1))
        entries = entries.repartition(at_once, "r", "salt").mapInArrow(trimmed(_narrow(depth + 1, salts)), ENTRY)
        depth += 1
    return entries.repartition(at_once, "r")


def _numbered(p: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sender and number of each of its entries."""
    return np.full(n, p, np.uint64), np.arange(n, dtype=np.uint64)


def _send_runs(salts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, ids, sizes, blob in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                c = Chunk(ids, sizes, blob).runs()
                yield from _entries(0, 1, *_numbered(p, len(c.lead)), c.bucket[c.lead], c.kind[c.lead], c.least, salts)

    return run


def _send_strings(salts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, ids, sizes, blob, refine in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                c = Chunk(ids, sizes, blob).runs()
                _, k1, k2, of = c.strings(numbers(refine))
                _, lead, least = grouped(k1, k2, of)
                yield from _entries(0, 1, *_numbered(p, len(lead)), k1[lead], k2[lead], least, salts)

    return run


def numbers(blobs: list[bytes] | None) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, np.uint32) for x in blobs]).astype(np.int64) if blobs else np.zeros(0, np.int64)


def _settle(refining: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """In a bucket task: which entries of which chunk go, and (refining) which need a look string by string.

    A partition holds the blobs of a few ranges; they are put together here, so that Spark only passes them through and
    neither sorts nor copies them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            for k, r in enumerate(batch.column(0).to_pylist()):
                ranges.setdefault(r, []).append(batch.slice(k, 1))
        while ranges:
            yield from settle(pa.Table.from_batches(ranges.popitem()[1])).to_batches()

    def settle(t: pa.Table) -> pa.Table:
        p, number, a, b, ids = _loaded(t)
        order = ordered(a, b, ids)
        a = a[order]
        b = b[order]
        ids = ids[order]
        new_a = np.ones(len(a), bool)
        new_a[1:] = a[1:] != a[:-1]
        new = new_a.copy()
        new[1:] |= b[1:] != b[:-1]
        least = ids[new][np.cumsum(new) - 1]
        gone = ids > least
        look = np.zeros(len(a), bool)
        if refining:
            # buckets in which the leading runs of different kinds come from different documents
            lead = np.flatnonzero(new)
            of = np.cumsum(new_a)[lead] - 1
            first = np.flatnonzero(new_a[lead])
            low, high = np.minimum.reduceat(ids[lead], first), np.maximum.reduceat(ids[lead], first)
            look = (low < high)[np.cumsum(new_a) - 1] & ~gone
        out: dict[str, list] = {"p": [], "gone": [], "look": []}
        hit = np.flatnonzero(gone | look)
        source, number = p[order[hit]], number[order[hit]].astype(np.uint32)
        by = np.argsort(source, kind="stable")
        hit, source, number = hit[by], source[by], number[by]
        cut = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1], [True]])) if len(hit) else np.zeros(1, np.int64)
        for lo, hi in zip(cut.tolist(), cut[1:].tolist(), strict=False):
            h, n = hit[lo:hi], number[lo:hi]
            out["p"].append(int(source[lo]))
            out["gone"].append(n[gone[h]].tobytes())
            out["look"].append(n[look[h]].tobytes())
        return pa.table({"p": pa.array(out["p"], pa.int64()), "gone": pa.array(out["gone"], pa.binary()), "look": pa.array(out["look"], pa.binary())})

    return run


def _finish(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per document: id, n_bytes, spans and kept_sha256; if ``whole``, id and what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, sizes, blob, gone, look, gone2 in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                c = Chunk(ids, sizes, blob).runs()
                drop = np.zeros(len(c.lead), bool)
                drop[numbers(gone)] = True
                runs = np.flatnonzero(drop[c.group] | (c.id > c.least[c.group]))
                cover = np.zeros(len(c.data) + 1, np.int32)
                np.add.at(cover, c.first[runs], 1)
                np.add.at(cover, c.first[runs] + c.count[runs] + DEPTH - 1, -1)
                start, k1, k2, of = c.strings(numbers(look))
                group, _, least = grouped(k1, k2, of)
                drop = np.zeros(len(least), bool)
                drop[numbers(gone2)] = True
                start = start[drop[group] | (of > least[group])]
                np.add.at(cover, start, 1)
                np.add.at(cover, start + DEPTH, -1)
                removed = np.cumsum(cover[:-1]) > 0
                out: list[tuple] = []
                for i, lo, size in zip(c.ids.tolist(), c.starts.tolist(), c.sizes.tolist(), strict=True):
                    r, data = removed[lo : lo + size], c.data[lo : lo + size]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], r.view(np.int8), [0]])))
                    kept = (data[~r] if len(edge) else data).tobytes()
                    spans = [{"start": int(x), "stop": int(y)} for x, y in edge.reshape(-1, 2)]
                    out.append((None if i == NO_ID else i, *((kept,) if whole else (size, spans, hashlib.sha256(kept).hexdigest()))))
                    if len(out) == 5000:
                        yield _rows(out, whole)
                        out = []
                if out:
                    yield _rows(out, whole)

    return run


def _rows(out: list[tuple], whole: bool) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    kinds = {"id": pa.int64(), "kept": pa.binary()} if whole else {"id": pa.int64(), "n_bytes": pa.int64(), "spans": span, "kept_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))


def _settled(scratch: Scratch, entries: DataFrame, tasks: int, refining: bool) -> DataFrame:
    """What the bucket tasks reply to the senders of entries: p, gone, look."""
    settle = lambda df, shares=1: exchanged(df, tasks, shares).mapInArrow(trimmed(_settle(refining)), "p long, gone binary, look binary")
    if tasks <= 1 << FAN_BITS:
        return settle(entries)
    shares = min(SHARES, 1 << FAN_BITS)
    stored = scratch.keep(entries.withColumn("share", F.col("r") % shares), "entries", "share")
    replies = []
    for k in range(shares):
        replies.append(scratch.keep(settle(scratch.part(stored, "share", k), shares), "replies"))
        scratch.drop_part(stored, "share", k)
    return reduce(DataFrame.unionByName, replies)


def _gathered(replies: DataFrame, *columns: str) -> DataFrame:
    """Replies by sender."""
    return replies.groupBy("p").agg(*(F.collect_list(c).alias(c) for c in columns))


def _spans(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    scratch = Scratch(spark, "suffix_dedup")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    chunks = scratch.keep(rows.mapInArrow(trimmed(_chunks), "p long, ids binary, sizes binary, blob binary"), "chunks")
    tasks = max(12, -(-chunks.count() * CHUNK_BYTES // 15 // TASK_ENTRIES))
    salts = max(1, tasks >> FAN_BITS)
    runs = _settled(scratch, chunks.mapInArrow(trimmed(_send_runs(salts)), ENTRY), tasks, True)
    first = scratch.keep(_gathered(runs, "gone", "look"), "runs")
    open_chunks = chunks.join(first.select("p", "look"), "p").select("p", "ids", "sizes", "blob", "look")
    strings = _settled(scratch, open_chunks.mapInArrow(trimmed(_send_strings(salts)), ENTRY), tasks, False)
    second = scratch.keep(_gathered(strings.select("p", F.col("gone").alias("gone2")), "gone2"), "strings")
    every = chunks.join(first.join(second, "p", "left"), "p", "left").select("p", "ids", "sizes", "blob", "gone", "look", "gone2")
    return every.mapInArrow(trimmed(_finish(whole)), "id long, kept binary" if whole else "id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept_sha256 string")


def repeated_spans(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, spans (array of start, stop: the maximal removed runs), kept_sha256."""
    return _spans(spark, docs, id_col, text_col, False)


def drop_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and kept, what is left of the text (binary, since cuts may fall inside a character).

    Rows keep their own texts, whether or not they share an id.
    """
    return _spans(spark, docs, id_col, text_col, True)
