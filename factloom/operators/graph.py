"""The relations a knower may see, as edges; neighbours, reach and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.guard import is_valid_at, is_visible
from factloom.sources.shared import written


def edges(facts: DataFrame, knower: str, chapter: int) -> DataFrame:
    """Facts with an object that are visible and valid, as (fact_id, src, label, dst)."""
    seen = facts.where(is_visible(knower, chapter) & is_valid_at(chapter) & F.col("object_id").isNotNull())
    return seen.select(F.col("id").alias("fact_id"), F.col("subject_id").alias("src"), F.col("predicate").alias("label"), F.col("object_id").alias("dst"))


def neighbours(graph: DataFrame, node: int) -> DataFrame:
    return graph.where(F.col("src") == node)


def reach(graph: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, node) for nodes within ``hops`` directed steps of ``starts(start)``; a start that a cycle returns to is in it.

    One join per hop on distinct pairs; only pairs that are new go on.  Steps and each hop's pairs are written, so a hop reads
    what the one before found and never works it out again.
    """
    steps = written(graph.select(F.col("src").alias("node"), "dst").distinct(), "steps")
    found = None
    front = starts.select("start", F.col("start").alias("node")).distinct()
    for _ in range(hops):
        front = front.join(steps, "node").select("start", F.col("dst").alias("node")).distinct()
        if found is not None:
            front = front.join(found, ["start", "node"], "left_anti")
        front = written(front, "front")
        found = front if found is None else found.unionByName(front)
    return found if found is not None else front.limit(0)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges on one side only: fact_id and which side has it."""
    a, b = left.select("fact_id", F.lit(True).alias("l")), right.select("fact_id", F.lit(True).alias("r"))
    return a.join(b, "fact_id", "full_outer").where("l is null or r is null").select("fact_id", F.when(F.col("l"), "left").otherwise("right").alias("side"))


def ripple(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a change does to a set of facts: held, invalidated or new, per fact_id."""
    a, b = before.select("fact_id", F.lit(True).alias("l")), after.select("fact_id", F.lit(True).alias("r"))
    tag = F.when(F.col("l") & F.col("r"), "held").when(F.col("l"), "invalidated").otherwise("new")
    return a.join(b, "fact_id", "full_outer").select("fact_id", tag.alias("effect"))
