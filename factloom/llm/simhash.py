"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits.  Two fingerprints at three or fewer differing bits have a
segment in which they differ by one bit at most, so the index holds, for each segment value, its 32 variants with one
bit wildcarded; two segment values meet in a variant exactly when they differ in that bit alone.  The equality join runs
on *distinct segment values*, where a variant can hold two values and no more, so it cannot blow up however many
fingerprints share a segment.  Values that agree outside one half of the segment are brought together and their variants
are made and joined there, which moves two rows per value instead of 32.  Fingerprints under equal or meeting segment values are then verified bit by bit.

Large buckets are dealt into about sqrt(size)/16 blocks and every pair of blocks is compared in a task of its own; a task
walks its fingerprints breadth-first and emits a spanning forest of the verified links, at most one row per fingerprint
and task, never all pairs.  No candidate is capped.

``similar_groups`` is the same index at work for copies at a Jaccard similarity of 0.8 over distinct 5-word shingles, with a
fingerprint for that measure: 30 segments of 30 one-bit min-hashes of the shingle set.  At 0.8 a bit differs with
probability 0.1, however the differences are spread, and two texts have a segment with at most one differing bit with
probability 0.997; strangers meet in one by chance once in a million pairs.  Bit counts only preselect, and lose nothing
that can be seen (``MOST``); every link that counts is verified by exact Jaccard, inside the groups that the preselected
links form.

Defined results: null and empty texts have fingerprint zero and link like any other; texts of fewer words than a shingle
use the whole sequence; repeated rows share a fingerprint; a row without an id gets its fingerprint and the component of the
documents that share it (null where there is none), and links nobody; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from factloom.llm.batches import slices_of, trimmed
from factloom.llm.components import connected_components
from factloom.llm.exact_dedup import keep_rows, with_column
from factloom.llm.jaccard import verify_sets
from factloom.llm.store import Scratch, unused

SHINGLE = 3
DISTANCE = 3
SEGMENTS = 30
WIDTH = 30
#: Differing bits up to which a pair of the pipeline's 900-bit fingerprints is verified: at a similarity of 0.8 a bit differs
#: with probability 0.1, so 90 bits do on average, and more than 200 do in one pair of 10^25.
MOST = 200
#: Segment values that a task looks through together; bounds its memory.
MET = 200_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the shingles of A-Z-lower-cased words, repeats included."""
    words = (text or b"").lower().split()  # bytes.split() cuts at space and \t to \r only
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = len(words) - shingle + 1
    grams = zip(*(words[i:] for i in range(shingle)), strict=False)
    h = np.fromiter((digest(join(g), 42) for g in grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of A-Z-lower-cased words; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    grams = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) > shingle else [words]
    return np.unique(np.array([digest(join(g), 7) for g in grams], np.uint64))


def set_key(grams: np.ndarray) -> int:
    """What stands for a shingle set: a 64-bit hash of its sorted members."""
    return xxhash.xxh3_64_intdigest(grams.tobytes(), 11)


def _fixed(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 32, n, np.uint32)


def set_fingerprint(grams: np.ndarray, segments: int = SEGMENTS, width: int = WIDTH) -> np.ndarray:
    """``segments`` x ``width`` one-bit min-hashes of a shingle set, one integer a segment.

    Each bit hangs on the least member under an order of its own, so two sets differ in a bit with probability
    (1 - Jaccard) / 2, wherever in the texts their differences lie.
    """
    bits = segments * width
    flip, times, salt = _fixed(bits, 1), _fixed(bits, 2) | np.uint32(1), _fixed(bits, 3)
    h = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(bits, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 64):
        np.minimum(least, ((h[i : i + 64, None] ^ flip) * times).min(axis=0), out=least)
    x = least ^ salt  # the finaliser of murmur3: equal least members give equal bits, others independent ones
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return (x & np.uint32(1)).reshape(segments, width).astype(np.int64) @ (1 << np.arange(width)).astype(np.int64)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices_of(batch, 1)):
            prints = np.array([fingerprint(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    return run


def _set_fingerprints(shingle: int, segments: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices_of(batch, 1)):
            sets = [shingle_set(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()]
            prints = [set_fingerprint(g, segments, width).astype(np.int32) for g in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), _keys(sets), pa.array(prints, pa.list_(pa.int32()))], ["id", "key", "segs"])

    return run


def _keys(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([set_key(g) for g in sets], np.uint64).view(np.int64))


def spanning_links(prints: np.ndarray, most: int, role: np.ndarray, block: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links at ``most`` or fewer bits, thinned to a spanning forest.  ``prints`` has a row of segments for each.

    Two of role 1 are not compared here, and with ``block`` neither are two of one block.
    """
    links: list[tuple[int, int]] = []
    left = np.arange(len(prints))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[x]).sum(axis=1, dtype=np.int64) <= most
            if role[x] == 1:
                near &= role[left] == 0
            if block is not None:
                near &= block[left] != block[x]
            if near.any():
                found = left[near]
                links.extend((x, int(y)) for y in found)
                queue.extend(found.tolist())
                left = left[~near]
    return links


def _verify(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket and block pair; a group may span batches."""
        rest: tuple[np.ndarray, np.ndarray] | None = None

        def links(rows: np.ndarray, prints: np.ndarray, last: bool):
            new = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            cuts = [0, *new.tolist(), len(rows)]
            a, b = [], []
            for lo, hi in zip(cuts[: len(cuts) - 1 - (not last)], cuts[1:], strict=False):
                if hi - lo > 1:
                    g = rows[lo:hi]
                    for x, y in spanning_links(prints[lo:hi], most, g[:, 4], None if g[0, 2] == g[0, 3] else g[:, 5]):
                        a.append(int(g[x, 6]))
                        b.append(int(g[y, 6]))
            at = len(rows) if last else cuts[-2]
            return (rows[at:], prints[at:]), pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:7]], axis=1)
            prints = batch.column(7).flatten().to_numpy(zero_copy_only=False).view(np.uint32).reshape(len(rows), -1)
            if rest is not None:
                rows, prints = np.concatenate([rest[0], rows]), np.concatenate([rest[1], prints])
            rest, out = links(rows, prints, False)
            yield out
        if rest is not None:
            yield links(*rest, True)[1]

    return run


def _meet(width: int):
    """Pairs of segment values that share a one-wildcard variant: (side, value with a 0, value with a 1 at the wildcard), and
    the numbers of both where rows bring their number as a fifth column.

    A wildcard lies in the lower or the upper half of a segment.  Values that agree in the other half have been brought
    together, so all their variants are looked up here and never travel: two rows per value instead of one per bit.
    """

    low, mask = width // 2, (1 << 40) - 1

    def meet(side: np.ndarray, half: np.ndarray, seg: np.ndarray, *n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for h, bits in ((0, range(low)), (1, range(low, width))):
            mine = half == h
            values, first = np.unique(side[mine].astype(np.int64) << 40 | seg[mine], return_index=True)
            counts = [x[mine][first] for x in n]
            for bit in bits:
                zero = np.flatnonzero((values >> bit) & 1 == 0)
                one = values[zero] | (1 << bit)
                at = np.minimum(np.searchsorted(values, one), max(0, len(values) - 1))
                hit = values[at] == one if len(values) else np.zeros(0, bool)
                u, v = zero[hit], at[hit]
                if len(u):
                    both = [pa.array(c[w]) for c in counts for w in (u, v)]
                    yield pa.RecordBatch.from_arrays([pa.array((values[u] >> 40).astype(np.int32)), pa.array(values[u] & mask), pa.array(values[v] & mask), *both], ["side", "u", "v", *["nu", "nv"][: len(both)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by side, half and the part they agree in; a group holds 2^(width / 2) values at most."""
        rest: list[np.ndarray] | None = None
        for batch in batches:
            got = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            got = got if rest is None else [np.concatenate(x) for x in zip(rest, got, strict=True)]
            side, half, _, part = got[:4]
            new = np.flatnonzero((side[1:] != side[:-1]) | (half[1:] != half[:-1]) | (part[1:] != part[:-1])) + 1
            cut = int(new[-1]) if len(new) else 0
            if cut >= MET:
                yield from meet(*(x[:cut] for x in (*got[:3], *got[4:])))
                got = [x[cut:] for x in got]
            rest = got
        if rest is not None:
            yield from meet(*rest[:3], *rest[4:])

    return run


def near_links(prints: DataFrame, scratch: Scratch, most: int, width: int) -> DataFrame:
    """Spanning links ``(a, b)`` at ``most`` differing bits between rows ``prints(rep, segs)`` with distinct ``segs`` that
    have a segment (of ``width`` bits) with at most one differing bit.

    Every row has many segments, so what travels of a segment is its side and value in one number (``at``); whole
    fingerprints are brought to the members of buckets only.
    """
    at = lambda side, seg: F.shiftleft(F.col(side).cast("long"), 32).bitwiseOR(F.col(seg).bitwiseAND(F.lit(0xFFFFFFFF)))
    side, value = F.shiftright("at", 32), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))
    seg = prints.select("rep", F.posexplode("segs").alias("side", "s")).select("rep", F.col("s").cast("long").alias("seg"), "side").select("rep", at("side", "seg").alias("at"))
    sizes = scratch.keep(seg.groupBy("at").agg(F.count("*").alias("n")), "segments")
    low = width // 2
    part = F.when(F.col("half") == 0, F.shiftright(value, low)).otherwise(F.col("at").bitwiseAND(F.lit((1 << low) - 1)))
    open_halves = sizes.select("at", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    dealt = open_halves.repartition(side, "half", part).select(side.cast("int").alias("side"), "half", value.alias("seg"), part.alias("rest"), "n").sortWithinPartitions("side", "half", "rest")
    met = dealt.mapInArrow(trimmed(_meet(width)), "side int, u long, v long, nu long, nv long")
    # of two values that meet, the one with more fingerprints is the centre: its fingerprints stand in its bucket once,
    # however many values it meets, and only the others' are brought to it
    first = F.col("nu") >= F.col("nv")
    pairs = met.select(F.when(first, at("side", "u")).otherwise(at("side", "v")).alias("centre"), F.when(first, at("side", "v")).otherwise(at("side", "u")).alias("at"), F.greatest("nu", "nv").alias("own"), F.least("nu", "nv").alias("n"))
    leaves = scratch.keep(pairs, "leaves")
    alone = sizes.where("n > 1").select(F.col("at").alias("centre"), F.col("n").alias("own"), F.lit(0).cast("long").alias("n"))
    own = alone.unionByName(leaves.select("centre", "own", "n")).groupBy("centre").agg((F.max("own") + F.sum("n")).alias("n"))
    buckets = scratch.keep(own.select("centre", F.greatest(F.lit(1), F.ceil(F.sqrt("n") / 16)).cast("long").alias("blocks")), "buckets")
    roles = buckets.select("centre", "blocks", F.lit(0).cast("long").alias("role"), F.col("centre").alias("at")).unionByName(leaves.join(buckets, "centre").select("centre", "blocks", F.lit(1).cast("long").alias("role"), "at"))
    members = seg.join(roles, "at").select("rep", "centre", "role", "blocks").join(prints.select("rep", "segs"), "rep")
    members = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).select("centre", "role", "segs", "rep", "block", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    tasks = members.select(F.shiftright("centre", 32).alias("side"), "centre", i.alias("i"), j.alias("j"), "role", "block", "rep", "segs")
    keys = ["centre", "i", "j"]
    return tasks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(trimmed(_verify(most)), "a long, b long")


def simhash_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most: int = DISTANCE) -> DataFrame:
    """One row per input row: id, fp (long, the fingerprint's bits), component_id (smallest id reachable)."""
    scratch = Scratch(spark, "simhash")
    rows = scratch.keep(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(_fingerprints(shingle)), "id long, fp long"), "prints")
    prints = scratch.keep(rows.groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
    if not 0 <= most <= 3:
        raise ValueError("two segments with one wildcard find at most three differing bits")
    halves = prints.where("rep is not null").select("rep", F.expr("array(CAST(shiftright(shiftleft(fp, 32), 32) AS INT), CAST(shiftright(fp, 32) AS INT))").alias("segs"))
    links = near_links(halves, scratch, most, 32)
    roots = connected_components(spark, links, scratch)
    named = prints.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return rows.join(named, "fp").select("id", "fp", "component_id")


def _shingle_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices_of(batch, 1)):
            sets = [shingle_set(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([_keys(sets), pa.array([g.view(np.int64) for g in sets], pa.list_(pa.int64()))], ["key", "shingles"])

    return run


def _similar_rows(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, shingle: int, similar: float, segments: int, width: int, most: int) -> DataFrame:
    """One row per id and shingle set: id, key (of the set), n (rows), root (one of the group's keys)."""
    scratch = Scratch(spark, "similar")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = scratch.keep(rows.mapInArrow(trimmed(_set_fingerprints(shingle, segments, width)), "id long, key long, segs array<int>"), "prints")
    prints = scratch.keep(found.groupBy("key").agg(F.first("segs").alias("segs"), F.min("id").alias("id")), "distinct")
    loose = connected_components(spark, near_links(prints.select(F.col("key").alias("rep"), "segs"), scratch, most, width), scratch)
    loose = scratch.keep(loose, "loose")
    # inside a loose group every pair of blocks is compared by exact Jaccard
    sizes = loose.groupBy("root").agg(F.count("*").alias("n")).select("root", F.ceil(F.sqrt("n") / 4).cast("long").alias("blocks"))
    keys = loose.select(F.col("node").alias("key"))
    ids = prints.join(keys, "key", "left_semi").select(F.col("id").alias("its")).distinct()
    texts = rows.join(ids, F.col("id").eqNullSafe(F.col("its")), "left_semi")
    sets = texts.mapInArrow(trimmed(_shingle_sets(shingle)), "key long, shingles array<long>").join(keys, "key", "left_semi")
    sets = scratch.keep(sets.dropDuplicates(["key"]), "shingles")
    dealt = loose.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).select(F.col("root").alias("band"), F.col("node").alias("key"), "block", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
    tasks = dealt.join(sets, "key").select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block").alias("part"), "key", "shingles")
    links = tasks.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(verify_sets(similar), "a long, b long")
    roots = connected_components(spark, links, scratch)
    pairs = found.groupBy("id", "key").agg(F.count("*").alias("n")).join(roots.withColumnRenamed("node", "key"), "key", "left")
    return scratch.keep(pairs.select("id", "key", "n", F.coalesce("root", "key").alias("root")), "pairs")


def _best(pairs: DataFrame) -> DataFrame:
    """Of each group with two ids, sets or rows: root and best, the smallest id (nulls last) with its key."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    return pairs.groupBy("root").agg(F.min(order).alias("best"), F.sum("n").alias("n")).where("n > 1").select("root", "best")


def similar_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similar: float = 0.8, segments: int = SEGMENTS, width: int = WIDTH, most: int = MOST) -> DataFrame:
    """Groups linked at a Jaccard similarity of ``similar``: id and component_id, for documents in groups of two or more.

    Documents with equal shingle sets stand for each other.  Texts of fewer words than a shingle use the whole sequence;
    null ids link others and are not listed.
    """
    pairs = _similar_rows(spark, docs, id_col, text_col, shingle, similar, segments, width, most)
    out = pairs.join(_best(pairs), "root").select("id", F.col("best.id").alias("component_id"))
    return out.where("id <> component_id").unionByName(out.where("id <> component_id").select(F.col("component_id").alias("id"), "component_id").distinct())


def drop_near_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similar: float = 0.8) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id (nulls last), with all its columns.

    Rows are told apart by id and shingle set, so rows that share an id, or have none, stay or go by their own text.
    """
    pairs = _similar_rows(spark, docs, id_col, text_col, shingle, similar, SEGMENTS, WIDTH, MOST)
    kept = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("key") == F.col("best.key"))
    found = pairs.join(_best(pairs), "root").select("id", F.col("key").alias("mark"), kept.alias("kept"), "n")
    (key,) = unused(docs, "key")
    marked = with_column(lambda texts: _keys([shingle_set(t, shingle) for t in texts]), docs, text_col, key, LongType())
    return keep_rows(marked, found, id_col, key, Scratch(spark, "similar")).select(*docs.columns)
