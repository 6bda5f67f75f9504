"""Connected components by alternating large-star and small-star steps, as DataFrame joins.

Each step shuffles the edges on one end, keeps at most as many edges as before and shortens paths geometrically, so a
chain of any length closes in a logarithmic number of rounds.  A hub's edges are combined map-side before the minimum is
taken, and the joins are ordinary sort-merge joins that adaptive execution may split.  No link, component or label is
ever gathered on the driver: it sees a row count and one checksum per round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.store import Scratch, freed_shuffles


#: Nodes that a task keeps in mind; beyond that it hands its stars on and starts anew.
NODES = 400_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contract the edges of one partition to stars around their smallest node, in parts of ``NODES`` nodes or so."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def stars() -> Iterator[pa.RecordBatch]:
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        for i in range(0, len(pairs), 50_000):
            u, v = zip(*pairs[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > NODES:
            yield from stars()
            parent.clear()
    yield from stars()


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """``edges(a long, b long)`` to ``(node, root)`` where root is the smallest node reachable.

    Only nodes that have an edge to another node appear, roots included.  Edges with a null end and self loops are
    ignored; an empty table gives an empty table.
    """
    pairs = edges.toDF("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # forests of partitions, then of a few partitions together: links found many times over shrink to one per node and task
    local = scratch.keep(pairs.mapInArrow(_forest, "u long, v long"), "local")
    few = max(1, local.rdd.getNumPartitions() // 8)
    e = scratch.keep(local.coalesce(few).mapInArrow(_forest, "u long, v long").distinct(), "forest")
    scratch.drop(local)
    seen = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        with freed_shuffles(spark):
            mark = after.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        scratch.drop(e)
        e = after
        if (mark["n"], mark["x"]) == seen:
            break
        seen = (mark["n"], mark["x"])
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
