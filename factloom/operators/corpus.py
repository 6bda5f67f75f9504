"""Refining works: admission, deduplication in order, reports, premises and branch points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.premise import UNCLASSIFIED
from factloom.functions.text import fingerprint, is_prose, strip_boilerplate, words
from factloom.sources.retry import HostError
from factloom.sources.shared import written

MOST_OPTIONS = 4


def _decided(chapters: DataFrame, min_words: int, min_quotes: float, plain: bool, *more: str) -> DataFrame:
    """Texts cleaned and measured once, what comes of it (and ``more`` of it) written, and the fate looked up by fingerprint."""
    # the explode of one keeps the cleaned text from being made anew for each of its uses
    c = chapters.select("work", "pos", F.explode(F.array(strip_boilerplate("text"))).alias("clean"))
    c = c.select("work", "pos", is_prose("clean", min_words, min_quotes).alias("prose"), fingerprint("clean", plain).alias("print"), words("clean").alias("words"), *more)
    c = written(c, "fates")
    first = c.where("prose").groupBy("print").agg(F.min("pos").alias("first"))
    fate = F.when(~F.col("prose"), "prose").when(F.col("pos") == F.col("first"), "kept").otherwise("duplicate")
    return c.join(first, "print", "left").select("work", "pos", "print", fate.alias("fate"), "words", *more)


def fates(chapters: DataFrame, min_words: int, min_quotes: float, plain: bool = False) -> DataFrame:
    """What becomes of chapters ``(work, pos, text)``: work, pos, print, words and fate (kept, prose or duplicate).

    The first of equal cleaned texts in order of ``pos`` stays, whatever its work; chapters that are no prose never shadow
    others.  Texts are cleaned and measured once, the few columns that come of it are written to the shared folder, and the
    order decides by a minimum per fingerprint that is combined map-side and joined back.
    """
    return _decided(chapters, min_words, min_quotes, plain)


def clean_chapters(chapters: DataFrame, min_words: int, min_quotes: float, plain: bool = False) -> DataFrame:
    """``fates`` beside the cleaned texts, which are written with the rest instead of being made again."""
    return _decided(chapters, min_words, min_quotes, plain, "clean").select("work", "pos", "clean", "print", "fate", "words")


def report(cleaned: DataFrame) -> DataFrame:
    """Counts per work: chapters by fate, words kept, whether anything was lost."""
    n = lambda f: F.count_if(F.col("fate") == f)
    by = cleaned.groupBy("work").agg(F.count("*").alias("chapters"), n("kept").alias("kept"), n("prose").alias("not_prose"), n("duplicate").alias("duplicates"), F.coalesce(F.sum(F.when(F.col("fate") == "kept", F.col("words"))), F.lit(0)).alias("words"))
    return by.withColumn("is_partial", F.col("kept") < F.col("chapters"))


def admit(works: DataFrame, most: int, factor: int = 4) -> DataFrame:
    """The first ``most`` admitted works among the first ``most * factor`` candidates ``(pos, admitted)``, with counts as of then.

    Only the bounded head of the candidates is ranked.
    """
    head = works.orderBy("pos").limit(most * factor)
    before = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return head.withColumn("before", F.coalesce(F.sum(F.col("admitted").cast("int")).over(before), F.lit(0))).where(F.col("before") < most)


def union_sources(sources: list[DataFrame | Callable[[], DataFrame]]) -> DataFrame:
    """Works of several sources in order of the sources; the first sighting of (source, source_id) wins.

    A source may be a function that opens it; one that is not available (``HostError``) is left out.
    """
    out = None
    for n, s in enumerate(sources):
        try:
            s = s() if callable(s) else s
        except HostError:
            continue
        s = s.withColumn("source_rank", F.lit(n))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    if out is None:
        raise HostError(503)
    first = out.groupBy("source", "source_id").agg(F.min_by(F.struct(*out.columns), F.struct("source_rank", "pos")).alias("r"))
    return first.select("r.*")


def round_robin(hits: DataFrame, most: int, terms: int = 6) -> DataFrame:
    """Hits ``(id, round, term_pos, pos)`` of several searches taken in turns until ``most`` different ids."""
    head = hits.where(F.col("term_pos") < terms).groupBy("id").agg(F.min(F.struct("round", "term_pos", "pos")).alias("k"))
    return head.orderBy("k").limit(most).select("id", "k.*")


def protected_top(rows: DataFrame, kind: str, prominence: str, protected: str, most: int) -> DataFrame:
    """Per kind the ``most`` prominent rows and all protected ones; ties by title."""
    rank = F.row_number().over(Window.partitionBy(kind).orderBy(F.desc(prominence), "title"))
    top = rows.withColumn("rank", rank).where((F.col("rank") <= most) | F.col(protected))
    first = top.groupBy("title").agg(F.min_by(F.struct(*top.columns), F.struct("kind_pos", "rank")).alias("r"))
    return first.select("r.*")


def merge_pages(parts: DataFrame) -> DataFrame:
    """Page parts ``(title, round, categories, revision)`` of a few continuations (a dozen at most) in one row per title."""
    cats = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("round", "categories"))), lambda x: x["categories"]))
    return parts.groupBy("title").agg(cats.alias("categories"), F.max_by("revision", F.when(F.col("revision").isNotNull(), F.col("round"))).alias("revision"))


def rank_works(works: DataFrame, least: float | None = None) -> DataFrame:
    """Best score first, then as harvested; optionally only from a score on."""
    kept = works if least is None else works.where(F.col("score") >= least)
    return kept.orderBy(F.desc("score"), "pos")


def quality_summary(works: DataFrame) -> DataFrame:
    """Least, middle and best score.  Scores have two places, so the exact median counts ten thousand values at most."""
    return works.where("score is not null").agg(F.count("*").alias("n"), F.min("score").alias("min"), F.bround(F.median("score"), 2).alias("median"), F.max("score").alias("max"))


def is_ranked(works: DataFrame, block: int = 100_000) -> DataFrame:
    """Whether every score is there and none exceeds its predecessor in file order.

    Blocks of positions are looked at side by side; what remains are the seams between them.
    """
    w = works.select("score", "pos", F.floor(F.col("pos") / block).alias("block"))
    prev = F.lag("score").over(Window.partitionBy("block").orderBy("pos"))
    inside = w.select("block", "pos", "score", (F.col("score").isNotNull() & (prev.isNull() | (F.col("score") <= prev))).alias("ok"))
    edges = inside.groupBy("block").agg(F.bool_and("ok").alias("ok"), F.min_by("score", "pos").alias("first"), F.max_by("score", "pos").alias("last"))
    before = F.lag("last").over(Window.orderBy("block"))
    seams = edges.select("ok", (before.isNull() | (F.col("first") <= before)).alias("seam"))
    return seams.agg(F.coalesce(F.bool_and(F.col("ok") & F.col("seam")), F.lit(True)).alias("ranked"))


def premise_groups(works: DataFrame) -> DataFrame:
    """Works ``(pos, handle, premise: struct)`` by premise key: size, label of the first, first and last member."""
    w = works.where("premise is not null").select("pos", "handle", "premise.key", "premise.label")
    return w.groupBy("key").agg(
        F.count("*").alias("size"),
        F.min_by("label", "pos").alias("label"),
        F.min_by("handle", "pos").alias("first"),
        F.max_by("handle", "pos").alias("last"),
    )


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``rows`` with their place (from 1) in an order, counted per range of it, so that no task sorts all of them."""
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    at = written(at, "numbered").withColumn("__range", F.shiftright("__at", 33))
    # one row for each range
    parts = at.groupBy("__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__range", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__at") - F.col("__first") + 1
    return at.join(F.broadcast(parts), "__range").select(*rows.columns, place.alias(name))


def premise_members(works: DataFrame) -> DataFrame:
    """The members of premise groups in order, a row each: key, place (from 1), pos, handle.

    A group may be most of all works, so it is numbered in ranges: rows are sorted by group and position over all tasks, each
    range counts its rows of a group, and what stands before a range is added.
    """
    m = works.where("premise is not null").select("premise.key", "pos", "handle")
    m = m.repartitionByRange("key", "pos").sortWithinPartitions("key", "pos").withColumn("at", F.monotonically_increasing_id())
    m = written(m, "members").withColumn("range", F.shiftright("at", 33))
    # a row for each range of a group: groups and ranges together, not their product, as both are sorted
    parts = m.groupBy("key", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return m.join(parts, ["key", "range"]).select("key", (F.col("before") + F.col("at") - F.col("first") + 1).alias("place"), "pos", "handle")


def branch_points(works: DataFrame, most: int = MOST_OPTIONS) -> DataFrame:
    """Options per decision: the canon one, then alternates by support, at most ``most`` in all.

    Rows (key, option, label, support, point_support); the support of a point counts the options it keeps.
    """
    if most < 2:
        raise ValueError("a decision needs two options")
    w = works.where((F.col("premise.key") != UNCLASSIFIED) & (F.size("premise.tropes") > 0)).select("pos", "premise.*")
    paths = w.groupBy("key", "alternate").agg(F.count("*").alias("support"))
    order = Window.partitionBy("key").orderBy(F.desc("support"), "alternate")
    kept = paths.withColumn("option", F.row_number().over(order)).where(F.col("option") < most).select("key", "option", F.col("alternate").alias("label"), "support")
    canon = w.groupBy("key").agg(F.min_by("canon_option", "pos").alias("label")).select("key", F.lit(0).alias("option"), "label", F.lit(0).cast("long").alias("support"))
    point = kept.groupBy("key").agg(F.sum("support").alias("point_support"))
    return kept.unionByName(canon).join(point, "key")


def chapters_of(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """Cut documents at heading lines: (id, index, title, text), front matter and empty bodies out, numbered anew from 1.

    Lines are numbered, headings add up to a running chapter number, bodies are gathered in order: a window and an
    aggregate per document.
    """
    number = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty"
    heading = rf"(?i)^[ \t]*(?:chapter|part|book)[ \t]+(?:\d{{1,3}}|[ivxlcdm]{{1,7}}|{number})[ \t]*[.:—-]?[ \t]*(.*)$"
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n", -1)).alias("line", "words"))
    title = F.regexp_extract("words", heading, 1)
    opens = (F.col("words").rlike(heading) & ~title.rlike(r"(?i)(?:chapter|part|book)[ \t]+(?:\d|[ivxlcdm])")) | F.col("words").rlike(r"^[ \t]*(?:\d{1,3}|[IVXLCDM]{1,7})[ \t]*$")
    run = Window.partitionBy("id").orderBy("line")
    cut = lines.withColumn("opens", opens).withColumn("title", F.trim(title)).withColumn("chapter", F.sum(F.col("opens").cast("int")).over(run)).where("chapter > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("opens"), F.struct("line", "words")))), lambda x: x["words"]), "\n")
    found = cut.groupBy("id", "chapter").agg(F.max(F.when(F.col("opens"), F.col("title"))).alias("title"), body.alias("text"))
    found = found.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).where("text <> ''")
    return found.select("id", F.row_number().over(Window.partitionBy("id").orderBy("chapter")).alias("index"), F.nullif("title", F.lit("")).alias("title"), "text")


def read_chapters(docs: DataFrame, id_col: str, text: Column, allow_single: bool = False) -> DataFrame:
    """``chapters_of``, where a document without a chapter is an error: all of it would be known from the first chapter on.

    ``allow_single`` takes such a document as one chapter without a title.
    """
    found = chapters_of(docs, id_col, text)
    bare = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(found.select("id").distinct(), "id", "left_anti")
    said = F.raise_error(F.concat(F.lit("no chapter headings in document "), F.col("id").cast("string"))).cast("string")
    whole = bare.select("id", F.lit(1).alias("index"), F.lit(None).cast("string").alias("title"), (F.col("text") if allow_single else said).alias("text"))
    return found.unionByName(whole)
