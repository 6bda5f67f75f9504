"""A whole harvest in one run: candidates, relevance, chapters, prose gate, duplicates, the cap, quality, and what was lost.

Candidates are asked in order until ``most`` works are kept.  Whether a chapter is a duplicate depends on earlier chapters
only, of works that count anyway, so every decision is taken for all candidates side by side and the cap is a place in their
order: that of the ``most``-th work with a chapter left.  What stands behind it was never asked for, so it is in no count.
The place is found by two prefixes, over the sums of stretches and then inside one stretch, so no task sees all works.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import premise, prose, text
from factloom.operators.corpus import branch_points, fates, is_ranked, premise_groups, premise_members, union_sources
from factloom.sources.shared import written
from factloom.sources.tables import CORPUS_VERSION

FACTOR = 4
#: Works that one window numbers at a time.
STRETCH = 100_000


@dataclass(frozen=True)
class Policy:
    """What a harvest asks of works and chapters."""

    name: str
    aliases: tuple[str, ...] = ()
    most: int = 25
    most_chapters: int = 20
    min_words: int = 500
    min_quotes: float = 5.0
    min_hits: int = 2
    min_reads: int = 0
    min_votes: int = 0
    allow_mature: bool = False
    languages: tuple[str, ...] = ("en",)
    least_score: float | None = None
    most_options: int = 4
    plain: bool = False

    @property
    def terms(self) -> list[str]:
        """The name and its aliases, each once."""
        return list(dict.fromkeys([self.name, *self.aliases]))


@dataclass(frozen=True)
class Harvest:
    """Works in order of their rank, chapters that stay with their texts, and the report, one row."""

    works: DataFrame
    chapters: DataFrame
    report: DataFrame


def candidates(sources: list[DataFrame | Callable[[], DataFrame]], most: int) -> DataFrame:
    """The first ``most * FACTOR`` works of each source, the first sighting of each, with their ``place`` in the order asked.

    Sources that are not available are left out (as by ``union_sources``); positions are below 2^48.
    """

    def head(source: DataFrame | Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        return lambda: (source() if callable(source) else source).orderBy("pos").limit(most * FACTOR)

    found = union_sources([head(s) for s in sources])
    return found.withColumn("place", F.col("source_rank").cast("long") * (1 << 48) + F.col("pos"))


def nth_place(places: DataFrame, n: int, stretch: int = STRETCH) -> int | None:
    """The ``n``-th smallest of distinct ``place``s; None where there are fewer.

    Places are dealt into ranges and counted there; only the range with the n-th is numbered.
    """
    ranged = places.select("place").repartitionByRange("place").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "places")
    sums = ranged.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each range
    at = sums.withColumn("before", before).where((F.col("before") < n) & (F.col("before") + F.col("n") >= n)).first()
    if at is None:
        return None
    inside = ranged.where(F.col("part") == at["part"])
    return inside.orderBy("place").limit(n - at["before"]).agg(F.max("place").alias("place")).first()["place"]


def _relevant(p: Policy) -> tuple[Column, Column]:
    relevant = text.is_relevant(p.name, p.terms, p.min_hits, p.min_reads, p.min_votes, p.allow_mature, p.languages)
    return relevant, text.alias_hits(F.col("title"), F.col("description"), F.col("tags"), p.terms)


def harvest(works: DataFrame, chapters: DataFrame, policy: Policy) -> Harvest:
    """Run a policy over ``works(place, source, source_id, title, description, tags, language, reads, votes, mature)`` and their
    ``chapters(place, index, text)``, numbered from 1 within a work.

    Defined results: null texts are empty and so no prose; a work whose chapters cannot be had is neither kept nor counted as
    rejected; equal scores keep their order; with an empty table the report has zeros.
    """
    p = policy
    relevant, hits = _relevant(p)
    asked = written(works.withColumn("relevant", relevant).withColumn("relevance_score", hits), "asked")
    fetched = chapters.where(F.col("index") <= p.most_chapters).join(asked.where("relevant").select("place"), "place", "left_semi")
    told = fetched.select(F.col("place").alias("work"), F.struct("place", "index").alias("pos"), "text")
    fate = fates(told, p.min_words, p.min_quotes, p.plain).select("pos.place", "pos.index", "fate", "words")
    n = lambda f: F.count_if(F.col("fate") == f)
    kept_words = F.coalesce(F.sum(F.when(F.col("fate") == "kept", F.col("words"))), F.lit(0))
    tally = fate.groupBy("place").agg(n("kept").alias("chapters"), n("prose").alias("dropped_non_prose"), n("duplicate").alias("dropped_duplicate"), kept_words.alias("total_words"))
    tally = written(tally, "tally")
    last = nth_place(tally.where("chapters > 0"), p.most)
    reached = F.lit(True) if last is None else F.col("place") <= last
    seen = asked.where(reached)
    tally = tally.where(reached)

    admitted = tally.where("chapters > 0")
    stays = fate.where((F.col("fate") == "kept") & reached).select("place", "index")
    cleaned = written(fetched.join(stays, ["place", "index"]).select("place", "index", text.strip_boilerplate("text").alias("text")), "kept")
    # a work has at most ``most_chapters`` of them
    told = cleaned.groupBy("place").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "text"))), lambda c: c["text"]), "\n\n").alias("prose"))
    scored = prose.with_components(told, "prose").select("place", prose.quality().alias("score"))
    signed = seen.join(admitted, "place").withColumn("signature", F.explode(F.array(premise.signature(F.col("title"), F.col("description"), F.col("tags"), p.name))))
    signed = signed.withColumn("premise", F.explode(F.array(premise.read_signature(F.col("signature"))))).drop("signature", "relevant")
    analysed = written(signed.join(scored, "place").withColumn("handle", F.concat_ws(":", "source", F.col("source_id").cast("string"))), "analysed")
    good = analysed if p.least_score is None else analysed.where(F.col("score") >= p.least_score)

    points = branch_points(good.select(F.col("place").alias("pos"), "premise"), p.most_options).select("key").distinct()
    sums = tally.agg(F.coalesce(F.sum("dropped_non_prose"), F.lit(0)).alias("prose_rejected"), F.coalesce(F.sum("dropped_duplicate"), F.lit(0)).alias("duplicates_dropped"))
    told = good.agg(
        F.count("*").alias("stories_kept"),
        F.coalesce(F.sum("chapters"), F.lit(0)).alias("chapters_kept"),
        F.coalesce(F.sum("total_words"), F.lit(0)).alias("total_words"),
        F.count_distinct(F.when(F.size("premise.tropes") > 0, F.col("premise.key"))).alias("premises_detected"),
        F.min("score").alias("least_score"),
        # scores have two places, ten thousand values at most
        F.bround(F.median("score"), 2).alias("median_score"),
        F.max("score").alias("best_score"),
    )
    one = lambda df: df.withColumn("one", F.lit(1))
    report = one(works.agg(F.lit(p.name).alias("name"), F.lit(len(p.aliases)).cast("long").alias("aliases_used"), F.count("*").alias("candidates_seen")))
    for part in (seen.agg(F.count_if(~F.col("relevant")).alias("relevance_rejected")), sums, told, points.agg(F.count("*").alias("branch_points"))):
        report = report.join(one(part), "one")
    lost = analysed.agg(F.count("*").alias("all"))
    report = report.join(one(lost), "one").withColumn("quality_rejected", F.col("all") - F.col("stories_kept")).drop("one", "all")
    return Harvest(good.orderBy(F.desc("score"), "place"), cleaned.join(good.select("place"), "place", "left_semi"), report)


def write(found: Harvest, path: str, most_options: int = 4) -> None:
    """A harvest as JSON lines below a folder, each table overwritten: ``works`` with their chapters, best first; ``manifest``,
    one row; ``premise_groups`` and their ``premise_members`` in order; ``branch_points``.

    Works are in ranges of their rank, so no task writes them all; groups are tables of their own, since one may hold most of
    all works.  What the manifest says of the order is read off the works as they stand in the files.
    """
    chapters = found.chapters.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("index", "text"))).alias("texts"))
    told = found.works.join(chapters, "place").withColumn("is_partial", F.col("dropped_non_prose") + F.col("dropped_duplicate") > 0)
    told = told.withColumn("schema_version", F.lit(CORPUS_VERSION))
    told.repartitionByRange(F.desc("score"), "place").sortWithinPartitions(F.desc("score"), "place").write.mode("overwrite").json(f"{path}/works")
    members = found.works.select(F.col("place").alias("pos"), "handle", "premise")
    premise_groups(members).orderBy(F.desc("size"), "key").write.mode("overwrite").json(f"{path}/premise_groups")
    premise_members(members).repartitionByRange("key", "place").sortWithinPartitions("key", "place").write.mode("overwrite").json(f"{path}/premise_members")
    branch_points(members, most_options).repartitionByRange("key", "option").sortWithinPartitions("key", "option").write.mode("overwrite").json(f"{path}/branch_points")
    manifest(found, path).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def manifest(found: Harvest, path: str) -> DataFrame:
    """One row about the works written below a folder: version, counts, sources, order, quality."""
    spark = found.works.sparkSession
    works = spark.read.schema("source string, score double, chapters long, total_words long").json(f"{path}/works")
    in_files = works.select("score", F.monotonically_increasing_id().alias("pos"))
    ordering = F.when(F.col("ranked"), "prose_quality_score_desc").otherwise("harvest_order").alias("ordering")
    counts = works.agg(
        F.lit(CORPUS_VERSION).alias("schema_version"),
        F.count("*").alias("story_count"),
        F.coalesce(F.sum("chapters"), F.lit(0)).alias("chapter_count"),
        F.coalesce(F.sum("total_words"), F.lit(0)).alias("total_words"),
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.count("score").alias("scored_works"),
        F.min("score").alias("least"),
        F.bround(F.median("score"), 2).alias("median"),
        F.max("score").alias("best"),
    )
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(found.report.select("name")).join(one(counts), "one").join(one(is_ranked(in_files).select(ordering)), "one").drop("one")
