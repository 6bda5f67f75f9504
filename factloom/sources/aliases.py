"""Other names of a work from an encyclopedia's redirects: which articles to ask, and which answer to take."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import clean_alias, rank_aliases
from factloom.sources.retry import HostError

# Qualifiers of article titles by medium, in the order in which they are tried, and their marks in titles.
SUFFIXES = {
    "movie": ("(film)", "(franchise)", "(film series)", "(TV series)", "(novel)"),
    "novel": ("(novel)", "(novel series)", "(book series)", "(book)", "(TV series)", "(film)"),
    "series": ("(TV series)", "(franchise)", "(novel series)", "(film)"),
}
ANY_SUFFIX = ("(TV series)", "(film)", "(novel)", "(novel series)", "(book series)", "(franchise)", "(book)")
HINTS = {"movie": "film", "novel": "novel", "series": "television series"}
MARKS = {"movie": ("film",), "novel": ("novel", "book"), "series": ("tv series", "television series")}
ENOUGH, MOST = 4, 60


def resolved_title(name: str, kind: str, search: Callable[[str], list[str]]) -> str | None:
    """The article that a search finds for a work of this medium: it begins with the name and, better, names the medium."""
    if kind not in HINTS:
        return None
    try:
        titles = search(f"{name} {HINTS[kind]}")
    except HostError:
        return None
    named = [t for t in titles if t.lower().startswith(name.strip().lower())]
    return next((t for t in named if any(m in t.lower() for m in MARKS[kind])), named[0] if named else None)


def candidate_titles(name: str, kind: str = "auto", search: Callable[[str], list[str]] = lambda term: []) -> list[str]:
    """Articles to ask in order: a name with a qualifier as it is; with a known medium the bare name comes last."""
    if name.rstrip().endswith(")") and "(" in name:
        return [name]
    kind = kind.lower()
    if kind not in SUFFIXES:
        return [name, *(f"{name} {s}" for s in ANY_SUFFIX)]
    found = resolved_title(name, kind, search)
    return [*([found] if found else []), *(f"{name} {s}" for s in SUFFIXES[kind]), name]


def expand(redirects: DataFrame, works: DataFrame, kind: str = "auto", most: int = MOST) -> DataFrame:
    """Aliases of ``works(entity, name)`` out of ``redirects(title, pos, redirect)``: entity, alias, rank.

    Of a work's candidate articles the first with ``ENOUGH`` usable redirects counts, else the one with most (the earlier
    among equals); an article nobody wrote, or that could not be read, has none.  What names something else comes first, mere
    respellings of the name last, as found in either part.

    Redirects stay rows: an article with very many is no array, and equal spellings are merged by a combined minimum.
    """
    suffixes = SUFFIXES.get(kind.lower())
    # a name that is qualified already is asked for as it is
    tails = ["", *(f" {s}" for s in ANY_SUFFIX)] if suffixes is None else [*(f" {s}" for s in suffixes), ""]
    asked = works.select("entity", "name", F.posexplode(F.when(F.col("name").rlike(r"\([^)]*\)\s*$"), F.array(F.lit(""))).otherwise(F.array(*(F.lit(t) for t in tails)))).alias("nth", "tail"))
    asked = asked.select("entity", "name", "nth", F.concat("name", "tail").alias("title"))
    by = ["entity", "name", "nth"]
    usable = asked.join(redirects, "title").withColumn("alias", clean_alias(F.col("redirect"), F.col("name"))).where("alias is not null")
    listed = usable.groupBy(*by, F.lower("alias").alias("low")).agg(F.min(F.struct("pos", "redirect", "alias")).alias("first"))
    size = F.col("size")
    sizes = listed.groupBy(*by).agg(F.count("*").alias("size"))
    best = sizes.groupBy("entity", "name").agg(F.coalesce(F.min(F.when(size >= ENOUGH, F.col("nth"))), F.max_by("nth", F.struct(size, -F.col("nth")))).alias("nth"))
    same = [F.col(f"__of.{c}").eqNullSafe(F.col(f"__best.{c}")) for c in by]
    rows = listed.alias("__of").join(best.alias("__best"), same, "left_semi").select("entity", "name", F.struct("first.pos", "first.redirect").alias("pos"), "first.alias")
    return rank_aliases(rows, F.col("name")).where(F.col("rank") <= most).select("entity", "alias", "rank")
