"""Ranked lexical search: exact top-k by three phases over term-partitioned postings (TPUT).

Postings.  One pass over the texts counts terms and writes the terms of the queries per document (``forward``); blocks of
them, one per term and stretch of rows, are dealt out in ranges of (term, row), so that a list that fills a third of all
postings is simply several ranges.  An entry's impact is the share of a score that one occurrence in the query earns.

1. Heads: each block hands on its ``k`` best entries, each list keeps its best.  A document's entries in the heads sum up to
   at least a lower bound of its score; the k-th best sum of a query is ``tau``.
2. Uniform threshold: every list hands on the entries with an impact of at least tau / (lists of the query).  A document
   without any such entry stays below tau.  Entries meet per shard of documents; what is missing there is at most the
   threshold and at most the head of its list, which bounds every score from above.  The k-th best sum over all shards is
   the floor; documents whose bound reaches it are candidates.
3. Look-up: the exact scores of the candidates, from ``forward``.

No list, document or score is ever gathered on the driver: it holds the queries of a block (at most ``BLOCK_ITEMS`` of them,
of ``BLOCK_BYTES`` of text in the mean), document counts of their terms and one ``tau`` each.  More queries are taken block
by block, each against all rows.  A shard's task holds two numbers for each of its ``2 ** SHARD`` documents and each query of
the block, and streams the entries.

Terms are the maximal runs of letters and digits of ASCII and of anything beyond it; only A-Z are lower-cased.

Defined results: null and empty texts have no term and do not count as documents, queries without a term get no row; every
row is a document and a query of its own, whether or not it repeats another (ids repeat in the result then); equal scores go
by ascending id, a null id before all others, then by row; empty tables give an empty table; further columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.batches import slices_of, trimmed
from factloom.llm.store import Scratch, freed_shuffles

BLOCK_ITEMS = 512
BLOCK_BYTES = 8_000_000
#: Documents of a shard, as a power of two.
SHARD = 13
#: Postings that a task sorts by term at a time.
POSTINGS = 1_000_000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
FORWARD = "row long, id long, n int, terms array<int>, tfs array<int>"
BLOCKS = "term int, base long, offs array<int>, tfs array<int>, ns array<int>"
OUT = "item_id long, rank int, doc_id long, score long"


def terms(text: bytes | str | None) -> list[bytes]:
    """Terms of a text in order, with repeats."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_FOLD).split()


@dataclass
class Queries:
    """The queries of a block: ``lists[q]`` has the numbers of its terms and how often it repeats each."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    lists: list[list[tuple[int, int]]]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Queries:
        counts = [Counter(terms(t)) for _, t in rows]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        return cls([i for i, _ in rows], vocabulary, [sorted((vocabulary[t], f) for t, f in c.items()) for c in counts])


@dataclass
class Weights:
    """Weight of every term, and what the law of the scores needs of the corpus."""

    w: np.ndarray
    n_docs: int
    n_terms: int

    @classmethod
    def of(cls, n_docs: int, n_terms: int, df: np.ndarray) -> Weights:
        return cls(np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64), n_docs, n_terms)

    def impacts(self, term: np.ndarray | int, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        tf, n = tf.astype(np.int64), n.astype(np.int64)
        m = 25 + (75 * n * self.n_docs) // self.n_terms
        return self.w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _forward(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices_of(batch, 2)):
            keep, ns, sizes, ts, fs = [], [], [0], [], []
            for i, text in enumerate(b.column(2).cast(pa.binary()).to_pylist()):
                words = terms(text)
                if not words:
                    continue
                counts = Counter(map(vocabulary.get, words))
                counts.pop(None, None)
                keep.append(i)
                ns.append(len(words))
                ts.extend(counts)
                fs.extend(counts.values())
                sizes.append(len(ts))
            at, off = pa.array(keep, pa.int64()), pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(off, pa.array(x, pa.int32())) for x in (ts, fs)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(ns, pa.int32()), *lists], ["row", "id", "n", "terms", "tfs"])

    return run


def _flat(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(n).flatten().to_numpy(zero_copy_only=False) for n in names]


def _sizes(b: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(b.column(name).value_lengths().to_numpy(zero_copy_only=False), np.int64)


def _lists(of: np.ndarray, *values: np.ndarray) -> list[pa.ListArray]:
    """Values cut into lists of the given sizes."""
    at = pa.array(np.concatenate([[0], np.cumsum(of)]), pa.int32())
    return [pa.ListArray.from_arrays(at, pa.array(v)) for v in values]


def _blocks(shard_bits: int, most: int):
    """Documents, in order of rows, to blocks of postings: one per term and shard of the documents at hand."""

    def cut(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        row, term, tf, n = (np.concatenate(x) for x in zip(*held, strict=True))
        shard = row >> shard_bits
        order = np.lexsort((row, shard, term))
        row, term, tf, n, shard = row[order], term[order], tf[order], n[order], shard[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(shard) != 0)]))
        of = np.diff(np.append(first, len(row)))
        base = shard[first] << shard_bits
        lists = _lists(of, (row - np.repeat(base, of)).astype(np.int32), tf, n)
        return pa.RecordBatch.from_arrays([pa.array(term[first]), pa.array(base), *lists], ["term", "base", "offs", "tfs", "ns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in batches:
            of = _sizes(b, "terms")
            term, tf = _flat(b, "terms", "tfs")
            row, n = b.column("row").to_numpy(zero_copy_only=False), b.column("n").to_numpy(zero_copy_only=False)
            held.append((np.repeat(row, of), term, tf, np.repeat(n, of)))
            size += len(term)
            if size >= most:
                yield cut(held)
                held, size = [], 0
        if size:
            yield cut(held)

    return run


def _heads(weights: Weights, k: int):
    """The ``k`` best entries of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = _sizes(b, "offs")
            offs, tf, n = _flat(b, "offs", "tfs", "ns")
            block = np.repeat(np.arange(len(of)), of)
            term = b.column("term").to_numpy(zero_copy_only=False)[block]
            row = b.column("base").to_numpy(zero_copy_only=False)[block] + offs
            impact = weights.impacts(term, tf, n)
            order = np.lexsort((row, -impact, block))
            place = np.arange(len(order)) - np.repeat(np.cumsum(of) - of, of)
            best = order[place < k]
            yield pa.RecordBatch.from_arrays([pa.array(x[best]) for x in (term, row, impact)], ["term", "row", "impact"])

    return run


def _above(weights: Weights, least: np.ndarray, shard_bits: int):
    """Of each block the entries that reach the least threshold that any query sets its list, keyed by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = _sizes(b, "offs")
            offs, tf, n = _flat(b, "offs", "tfs", "ns")
            term = b.column("term").to_numpy(zero_copy_only=False)
            each = np.repeat(term, of)
            impact = weights.impacts(each, tf, n)
            good = impact >= least[each]
            left = np.add.reduceat(good, np.cumsum(of) - of, dtype=np.int64) if len(of) else of
            some = left > 0
            shard = b.column("base").to_numpy(zero_copy_only=False)[some] >> shard_bits
            lists = _lists(left[some], offs[good], impact[good])
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(term[some]), *lists], ["shard", "term", "offs", "impacts"])

    return run


def _best(k: int):
    """Of a query's documents in a shard the ``k`` with the largest sums."""

    def pick(q: int, seen: np.ndarray, bound: np.ndarray) -> np.ndarray:
        rows = np.flatnonzero(seen)
        return rows[np.lexsort((rows, -seen[rows]))[:k]]

    return pick


def _reaching(floors: np.ndarray):
    """Of a query's documents in a shard those with a bound that reaches the query's floor."""

    def pick(q: int, seen: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return np.flatnonzero((seen > 0) & (bound >= floors[q]))

    return pick


def _picked(queries: Queries, thresholds: np.ndarray, most: np.ndarray, shard_bits: int, pick: Callable[[int, np.ndarray, np.ndarray], np.ndarray]):
    """Streams the entries of whole shards, in order; gives (q, row, seen) of the documents that ``pick`` takes by what is
    seen of their scores and by the bound from above."""
    users: dict[int, list[tuple[int, int]]] = {}
    for q, of in enumerate(queries.lists):
        for t, f in of:
            users.setdefault(t, []).append((q, f))
    bound = lambda q, t, f: min(thresholds[q] - 1, f * most[t])
    whole = np.array([sum(bound(q, t, f) for t, f in of) for q, of in enumerate(queries.lists)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (len(queries.ids), 1 << shard_bits)
        seen, more = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        now = None

        def close() -> Iterator[pa.RecordBatch]:
            for q in np.flatnonzero(seen.any(axis=1)):
                rows = pick(q, seen[q], more[q] + whole[q])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), q, np.int32)), pa.array(rows + (now << shard_bits)), pa.array(seen[q][rows])], ["q", "row", "seen"])
            seen[:], more[:] = 0, 0

        for b in batches:
            for shard, term, at, impact in zip(b.column("shard").to_pylist(), b.column("term").to_pylist(), b.column("offs"), b.column("impacts"), strict=True):
                if shard != now:
                    if now is not None:
                        yield from close()
                    now = shard
                at, impact = at.values.to_numpy(zero_copy_only=False), impact.values.to_numpy(zero_copy_only=False)
                for q, f in users[term]:
                    good = f * impact >= thresholds[q]
                    rows, value = at[good], f * impact[good]
                    seen[q, rows] += value
                    more[q, rows] += value - bound(q, term, f)
        if now is not None:
            yield from close()

    return run


def _exact(queries: Queries, weights: Weights):
    """Scores of (document, queries) pairs."""
    of = [(np.array([t for t, _ in x], np.int64), np.array([f for _, f in x], np.int64)) for x in queries.lists]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(len(queries.vocabulary), np.int64)
        for b in batches:
            qs, rows, ids, scores = [], [], [], []
            for row, doc, n, ts, tfs, wanted in zip(*(b.column(c) if c in ("terms", "tfs") else b.column(c).to_pylist() for c in ("row", "id", "n", "terms", "tfs", "qs")), strict=True):
                ts, tfs = ts.values.to_numpy(zero_copy_only=False), tfs.values.to_numpy(zero_copy_only=False)
                vector[ts] = weights.impacts(ts, tfs, np.full(len(ts), n))
                for q in wanted:
                    t, f = of[q]
                    qs.append(q)
                    rows.append(row)
                    ids.append(doc)
                    scores.append(int((vector[t] * f).sum()))
                vector[ts] = 0
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int32()), pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["q", "row", "id", "score"])

    return run


def _search_block(spark: SparkSession, rows: DataFrame, queries: Queries, k: int, scratch: Scratch) -> DataFrame | None:
    """(q, id, score, rank) of a block of queries against all rows; None where no document has a term."""
    forward = scratch.keep(rows.mapInArrow(trimmed(_forward(queries.vocabulary)), FORWARD), "forward")
    stats = forward.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_terms")).first()
    if not stats["n_docs"] or not queries.vocabulary:
        return None
    blocks = forward.mapInArrow(trimmed(_blocks(SHARD, POSTINGS)), BLOCKS).repartitionByRange("term", "base").sortWithinPartitions("term", "base")
    lists = scratch.keep(blocks, "lists")
    df = np.zeros(len(queries.vocabulary), np.int64)
    for r in lists.groupBy("term").agg(F.sum(F.size("offs")).alias("df")).collect():  # one row for each term of the queries
        df[r["term"]] = r["df"]
    weights = Weights.of(stats["n_docs"], stats["n_terms"], df)

    # 1. heads
    best = Window.partitionBy("term").orderBy(F.desc("impact"), "row")
    heads = lists.mapInArrow(trimmed(_heads(weights, k)), "term int, row long, impact long").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    heads = scratch.keep(heads, "heads")
    most = np.zeros(len(df), np.int64)
    for r in heads.where("r = 1").collect():  # as above
        most[r["term"]] = r["impact"]
    users = spark.createDataFrame([(q, t, f) for q, of in enumerate(queries.lists) for t, f in of], "q int, term int, f int")
    sums = heads.join(users, "term").groupBy("q", "row").agg(F.sum(F.col("f") * F.col("impact")).alias("s")).where("s > 0")
    kth = Window.partitionBy("q").orderBy(F.desc("s"), "row")
    taus = np.zeros(len(queries.ids), np.int64)
    for r in sums.withColumn("r", F.row_number().over(kth)).where(F.col("r") == k).select("q", "s").collect():  # one row a query
        taus[r["q"]] = r["s"]

    # 2. the same threshold for all lists of a query
    lists_of = np.array([max(1, sum(df[t] > 0 for t, _ in of)) for of in queries.lists], np.int64)
    thresholds = np.maximum(1, -(-taus // lists_of))
    least = np.full(len(df), np.iinfo(np.int64).max)
    for q, of in enumerate(queries.lists):
        for t, f in of:
            least[t] = min(least[t], -(-thresholds[q] // f))
    entries = lists.mapInArrow(trimmed(_above(weights, least, SHARD)), "shard long, term int, offs array<int>, impacts array<long>")
    entries = entries.repartition("shard").sortWithinPartitions("shard", "term")
    picked = lambda pick: entries.mapInArrow(trimmed(_picked(queries, thresholds, most, SHARD, pick)), "q int, row long, seen long")
    seen = Window.partitionBy("q").orderBy(F.desc("seen"), "row")
    floors = taus.copy()
    with freed_shuffles(spark):
        for r in picked(_best(k)).withColumn("r", F.row_number().over(seen)).where(F.col("r") == k).select("q", "seen").collect():  # one row a query
            floors[r["q"]] = max(floors[r["q"]], r["seen"])
    candidates = scratch.keep(picked(_reaching(floors)).select("q", "row"), "candidates")

    # 3. look-up; a document has at most one entry for each query of the block
    wanted = candidates.groupBy("row").agg(F.collect_set("q").alias("qs"))
    scored = forward.join(wanted, "row").mapInArrow(trimmed(_exact(queries, weights)), "q int, row long, id long, score long").where("score > 0")
    rank = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("id"), "row")
    out = scratch.keep(scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k), "best")
    scratch.drop(forward, lists, heads, candidates)
    return out


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of every item with a score above 0: item_id, rank, doc_id, score."""
    scratch = Scratch(spark, "lexical")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_blocks = max(-(-size["n"] // (BLOCK_ITEMS // 2)), -(-size["bytes"] // BLOCK_BYTES), 1)
    block = F.pmod(F.xxhash64("item", "text", F.monotonically_increasing_id()), F.lit(n_blocks))
    asked = scratch.keep(asked.withColumn("block", block), "items")
    found = []
    for at in range(n_blocks):
        part = [(r["item"], r["text"]) for r in asked.where(F.col("block") == at).select("item", "text").collect()]
        for lo in range(0, len(part), BLOCK_ITEMS):
            queries = Queries.of(part[lo : lo + BLOCK_ITEMS])
            best = _search_block(spark, rows, queries, k, scratch)
            if best is not None:
                ids = spark.createDataFrame(list(enumerate(queries.ids)), "q int, item_id long")
                found.append(best.join(F.broadcast(ids), "q").select("item_id", "rank", F.col("id").alias("doc_id"), "score"))
    out = spark.createDataFrame([], OUT)
    for f in found:
        out = out.unionByName(f)
    return out
