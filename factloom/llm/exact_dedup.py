"""Exact deduplication with a heavy-hitter split.

1. Every text is lower-cased (A-Z only) and digested with SHA-256 in one pass over the input; from there on only
   ``(row, id, digest)`` travels.
2. Misra-Gries summaries with ``k`` counters, one per partition, are added up.  A summary undercounts by at most
   ``n / (k + 1)``, so keeping sums of at least that leaves at most ``k + 1`` candidates and misses no digest with twice
   as many rows.
3. The candidates are counted exactly (map-side combined) and the verified winners, at most ``k + 1`` rows, are
   broadcast: rows of heavy groups are decided map-side and never shuffled.
4. All other digests take an ordinary shuffle; each of their groups has less than ``2 n / (k + 1)`` rows.

Defined results: a null text counts as empty; empty texts form one group; a null id sorts below every other id; rows
repeated with the same id are told apart by their row number, so exactly one row of each group is kept; an empty table
gives an empty table; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StructField, StructType

from factloom.llm.batches import slices_of, trimmed
from factloom.llm.store import Scratch, unused

COUNTERS = 1024


def _digests(texts: list[bytes | None]) -> list[bytes]:
    # bytes.lower() touches A-Z only
    return [hashlib.sha256((t or b"").lower()).digest() for t in texts]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x for batch in batches for x in slices_of(batch, 2)):
        digests = _digests(b.column(2).cast(pa.binary()).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary())], ["row", "id", "digest"])


def misra_gries(counts: Counter, more: Counter, k: int) -> Counter:
    """Merge two summaries and cut back to ``k`` counters by subtracting the (k+1)-th largest."""
    counts = counts + more
    if len(counts) > k:
        cut = sorted(counts.values(), reverse=True)[k]
        counts = Counter({d: c - cut for d, c in counts.items() if c > cut})
    return counts


def _summaries(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            counts = misra_gries(counts, Counter(b.column(0).to_pylist()), k)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "at_least"])

    return run


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest (binary SHA-256 of the normalised text)."""
    scratch = Scratch(spark, "exact_dedup")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    hashed = scratch.keep(rows.mapInArrow(trimmed(_digest), "row long, id long, digest binary"), "digests")
    n = hashed.count()
    guessed = hashed.select("digest").mapInArrow(trimmed(_summaries(k)), "digest binary, at_least long").groupBy("digest").agg(F.sum("at_least").alias("at_least")).where(F.col("at_least") * (k + 1) >= max(n, 2 * (k + 1))).select("digest")
    best = F.max(F.struct("id", "row")).alias("best")
    winners = scratch.keep(hashed.join(F.broadcast(guessed), "digest").groupBy("digest").agg(best, F.count("*").alias("group_size")), "winners")
    tagged = hashed.join(F.broadcast(winners), "digest", "left")
    heavy = tagged.where("group_size is not null").select("row", "id", "digest", "best", "group_size")
    rest = tagged.where("group_size is null").select("row", "id", "digest")
    light = rest.join(rest.groupBy("digest").agg(best, F.count("*").alias("group_size")), "digest").select("row", "id", "digest", "best", "group_size")
    return heavy.unionByName(light).select("id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "digest")


def with_column(run_of: Callable[[list[bytes | None]], pa.Array], docs: DataFrame, text_col: str, name: str, kind: DataType) -> DataFrame:
    """``docs`` with one more column, made by ``run_of`` from the texts (bytes or None) of a slice."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices_of(batch, at)):
            more = run_of(b.column(at).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, more], [*b.schema.names, name])

    return docs.mapInArrow(trimmed(run), StructType([*docs.schema.fields, StructField(name, kind)]))


def keep_rows(docs: DataFrame, found: DataFrame, id_col: str, mark: str, scratch: Scratch) -> DataFrame:
    """Rows of ``docs`` without the (id, mark) that ``found(id, mark, kept, n)`` drops, one row for each (id, mark).

    The mark stands for the text, so rows are told apart that share an id (or have none) and differ in their texts.
    ``found`` has at most one row for each (id, mark); rows without one stay.  Texts go through one join; only where some row
    repeats both id and mark they go through a second, which leaves one of each.
    """
    its_id, its_mark, kept = unused(docs, "id", "mark", "kept")
    decided = scratch.keep(found.where("not kept or n > 1").select(F.col("id").alias(its_id), F.col("mark").alias(its_mark), F.col("kept").alias(kept)), "decided")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(its_id)) & (F.col(mark) == F.col(its_mark))
    left = docs.join(decided.where(~F.col(kept)), same, "left_anti")
    thin = decided.where(kept)
    if thin.isEmpty():
        return left.drop(mark)
    repeated = left.join(thin, same, "left_semi").dropDuplicates([id_col, mark])
    return left.join(thin, same, "left_anti").unionByName(repeated).drop(mark)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts, the one with the largest id.

    The decision is looked up by id and digest, so rows that share an id (or have none) stay or go by their own text.
    Rows that repeat both id and text count as one document, of which one row stays.
    """
    found = exact_dedup(spark, docs, id_col, text_col)
    found = found.groupBy("id", F.col("digest").alias("mark")).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    (digest,) = unused(docs, "digest")
    marked = with_column(lambda texts: pa.array(_digests(texts), pa.binary()), docs, text_col, digest, BinaryType())
    return keep_rows(marked, found, id_col, digest, Scratch(spark, "exact_dedup")).select(*docs.columns)
