"""Forks: ancestry with caps, and what a fork inherits from its ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.shared import written


def lineage(spark: SparkSession, forks: DataFrame) -> DataFrame:
    """root, ancestor, cap, depth.  The cap is the tightest divergence on the way; forks nobody registered are roots.

    A fork that is its own ancestor makes the query fail: the path travels with the recursion and a repeat raises.
    """
    return spark.sql(
        """
        WITH RECURSIVE walk(root, ancestor, parent, cap, next_cap, depth, path) AS (
            SELECT id, id, parent_fork_id, CAST(NULL AS INT), divergence_at, 0, array(id) FROM {forks}
            UNION ALL
            SELECT w.root, w.parent, f.parent_fork_id, w.next_cap, least(w.next_cap, f.divergence_at), w.depth + 1,
                IF(array_contains(w.path, w.parent), raise_error(concat('fork cycle at ', w.parent)), array_append(w.path, w.parent))
            FROM walk w LEFT JOIN {forks} f ON f.id = w.parent
            WHERE w.parent IS NOT NULL)
        SELECT root, ancestor, cap, depth FROM walk""",
        forks=forks,
    )


def resolved(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """Facts of every fork with what it inherits: ``root`` and ``depth`` beside the fact's columns.

    A key (subject, predicate) belongs to the nearest fork that stores any row for it, also a row that its own cap or its
    status takes out; caps are inclusive and applied after that.  The lineage is one row per fork and ancestor and joins
    on the fork; the nearest depth of a key is a map-side combined minimum that is joined back, so no key is sorted in one
    task and a hot one may be split.
    """
    # what a recursion gives has no size that Spark knows, and it would send the facts to the lineage; a written table has one
    lines = written(lines, "lineage")
    joined = facts.join(lines, facts["fork_id"] == lines["ancestor"])
    key = ["root", "subject_id", "predicate"]
    nearest = joined.groupBy(*key).agg(F.min("depth").alias("__nearest"))
    same = [F.col(f"__of.{c}").eqNullSafe(F.col(f"__near.{c}")) for c in key]
    kept = joined.alias("__of").join(nearest.alias("__near"), [*same, F.col("__of.depth") == F.col("__near.__nearest")], "left_semi")
    return kept.where("cap is null or valid_from <= cap").select("root", "depth", *facts.columns)


def in_order(resolved: DataFrame) -> DataFrame:
    """Facts as a reader gets them: nearest fork first, then as recorded."""
    return resolved.orderBy("depth", "recorded_at", "id")
