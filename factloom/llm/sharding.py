"""Sharding by jump consistent hashing.

A document's shard depends on its stable key and the number of shards alone: no ring table, no state.  Going from ``n``
to ``n + 1`` shards moves about ``1 / (n + 1)`` of the keys, all of them into the new shard.  A slot is a row's place in its
shard in order of key, checksum and size, found without ever sorting a whole shard in one task: ranges of that order are
sorted side by side, the rows of each shard and range are counted, and the counts before a range are its offset.

Defined results: a null text has no bytes; a null key hashes like key 0 (before it reaches numpy, where a null beside it
would turn a key beyond 2^53 into its neighbour) and comes first in order; rows repeated with the same key share a shard and
get slots of their own, also when a third of all rows are one row; an empty table gives an empty table; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.store import Scratch

SHARDS = 24


def mix64(keys: np.ndarray) -> np.ndarray:
    """Finaliser that spreads consecutive integer keys over 64 bits."""
    h = keys.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach) of many keys at once."""
    key = mix64(keys)
    at = np.full(len(key), -1, np.int64)
    to = np.zeros(len(key), np.int64)
    live = np.arange(len(key)) if shards > 0 else np.zeros(0, np.int64)
    while len(live):
        at[live] = to[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        to[live] = ((at[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[to[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard of each key."""

    @F.pandas_udf("int")
    def jump(key: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(key.to_numpy(np.int64), shards).astype(np.int32))

    return jump(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot, grown_shard (with one shard more)."""
    scratch = Scratch(spark, "sharding")
    data = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.col(id_col).cast("long")
    rows = docs.select(
        key.alias("id"),
        (F.octet_length(data).cast("long") + 8).alias("size"),
        F.crc32(data.cast("binary")).cast("long").alias("text_crc32"),
        shard_of(key, shards).alias("shard"),
        shard_of(key, shards + 1).alias("grown_shard"),
    )
    # the number tells repeated rows apart, so that they spread over ranges as well
    rows = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    order = ["shard", "id", "text_crc32", "size", "row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # a partition's number stands in the upper bits, the place in it in the others
    dealt = scratch.keep(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33)), "dealt")
    sums = dealt.groupBy("shard", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("shard", "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    slot = F.col("offset") + F.col("at") - F.col("first")
    return dealt.join(offsets, ["shard", "range"]).select("id", "size", "text_crc32", "shard", slot.alias("slot"), "grown_shard")


def write_shards(spark: SparkSession, docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", files_per_shard: int = 8) -> None:
    """Write the documents as Parquet folders ``shard=0`` and so on, each in several files so that no task holds a shard."""
    out = docs.withColumn("shard", shard_of(F.col(id_col), shards))
    salt = F.pmod(F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind)), F.lit(files_per_shard))
    out.repartition(shards * files_per_shard, "shard", salt).write.mode("overwrite").partitionBy("shard").parquet(path)
