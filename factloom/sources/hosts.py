"""Rows of two kinds of hosts as works: coercion of loosely typed fields.

Integers differ on purpose: the archive joins all digits of a field ("1.5" is 15), the serial host goes through a float
("1.5" is 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import strip

# Language names, ratings, the archive's fields.
LANGUAGES = {
    "english": "en",
    "spanish": "es",
    "español": "es",
    "french": "fr",
    "français": "fr",
    "german": "de",
    "deutsch": "de",
    "portuguese": "pt",
    "italian": "it",
    "russian": "ru",
    "chinese": "zh",
    "中文": "zh",
    "japanese": "ja",
    "日本語": "ja",
    "korean": "ko",
}
MATURE = ("mature", "explicit")
ORIGIN, WORK_URL = "ao3", "https://archiveofourown.org/works/"
ARCHIVE = "struct<id:string,title:string,metadata:map<string,string>,text:string>"
HOST = "struct<id:string,title:string,deleted:boolean,description:string,mature:boolean,completed:boolean,language:string,readCount:string,voteCount:string,tags:array<string>,parts:array<struct<id:string,title:string,draft:boolean>>>"


def said(meta: Column, name: str) -> Column:
    """A field as a trimmed string, empty where it is missing."""
    return F.coalesce(strip(F.try_element_at(meta, F.lit(name))), F.lit(""))


def either(meta: Column, first: str, second: str) -> Column:
    """The first of two spellings that has a value."""
    return F.when(F.coalesce(F.try_element_at(meta, F.lit(first)), F.lit("")) != "", said(meta, first)).otherwise(said(meta, second))


def field(meta: Column, *names: str) -> Column:
    """Several spellings of a label: their comma-separated values joined without repeats."""
    pieces = F.flatten(F.transform(F.array(*(said(meta, n) for n in names)), lambda p: F.transform(F.split(p, ",", -1), strip)))
    return F.array_join(F.array_distinct(F.filter(pieces, lambda x: x != "")), ", ")


def pieces_of(label: Column) -> Column:
    return F.filter(F.transform(F.split(label, ",", -1), strip), lambda t: t != "")


def digits(c: Column) -> Column:
    """All digits of a field as one number, 0 where there is none."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit("")), F.lit("999999999999")).cast("long"), F.lit(0))


def whole(c: Column) -> Column:
    """Through a float, cut off, not below zero."""
    return F.greatest(F.lit(0), F.coalesce(c.try_cast("double").try_cast("long"), F.lit(0)))


def archive_rows(raw: DataFrame, json: str) -> DataFrame:
    """Rows of the archive's mirror as works of one chapter; rows without id, title or text are dropped.

    The mirror has no blurbs: fandom, characters and tags make the description, and each label is a tag of its own, followed
    by where it came from.
    """
    r = raw.select(F.from_json(F.col(json), ARCHIVE).alias("r")).select("r.*")
    r = r.select(strip("id").alias("id"), strip("title").alias("title"), strip("text").alias("text"), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("m"))
    r = r.where("id <> '' and title <> '' and text <> ''")
    m = F.col("m")
    by = said(m, "author")
    name = F.lower(said(m, "Language"))
    codes = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    done = either(m, "chapters", "Chapters")
    r = r.select(
        "id",
        F.left("title", F.lit(500)).alias("title"),
        F.when(F.startswith(F.lower(by), F.lit("by ")), strip(F.substring(by, 4, 1_000_000))).otherwise(by).alias("author"),
        F.when(name == "", "en").otherwise(F.coalesce(F.try_element_at(codes, name), F.left(name, F.lit(2)))).alias("language"),
        F.lower(said(m, "Rating")).alias("rating"),
        F.lower(field(m, "Archive Warning", "Archive Warnings")).alias("warning"),
        field(m, "Fandom", "Fandoms").alias("fandom"),
        field(m, "Characters", "Character").alias("characters"),
        pieces_of(field(m, "Additional Tags", "Relationship", "Relationships", "Categories", "Category")).alias("free"),
        done.alias("done"),
        ((either(m, "completed", "Completed") != "") | finished(done)).alias("completed"),
        digits(either(m, "words", "Words")).alias("words"),
        digits(said(m, "Hits")).alias("reads"),
        digits(said(m, "Kudos")).alias("votes"),
        F.length("text").alias("text_chars"),
    )
    told = lambda label, c: F.when(F.col(c) != "", F.array(F.concat(F.lit(f"{ORIGIN}_{label}:"), c))).otherwise(F.array().cast("array<string>"))
    line = lambda label, c: F.when(c != "", F.concat(F.lit(f"{label}: "), c, F.lit(".")))
    tags = F.concat(pieces_of(F.col("fandom")), pieces_of(F.col("characters")), "free", told("fandom", "fandom"), told("characters", "characters"), told("chapters", "done"))
    blurb = F.concat_ws(" ", line("Fandom", F.col("fandom")), line("Characters", F.col("characters")), line("Tags", F.array_join("free", ", ")))
    return r.select(
        F.lit(ORIGIN).alias("source"),
        "id",
        "title",
        "author",
        F.concat(F.lit(WORK_URL), "id").alias("url"),
        blurb.alias("description"),
        tags.alias("tags"),
        F.array(F.struct(F.col("id").alias("source_id"), F.lit(1).alias("index"), F.col("title").alias("title"))).alias("chapter_refs"),
        F.lit(1).alias("num_chapters"),
        "reads",
        "votes",
        "completed",
        (F.col("rating").isin(*MATURE) | F.contains("warning", F.lit("rape")) | F.contains("warning", F.lit("underage"))).alias("mature"),
        "language",
        "words",
        "text_chars",
        "fandom",
    )


def finished(done: Column) -> Column:
    """Whether a count of chapters like 3/3 says that nothing is missing."""
    written, planned = strip(F.substring_index(done, "/", 1)), F.when(F.contains(done, F.lit("/")), strip(F.substring(done, F.instr(done, "/") + 1, 1_000))).otherwise("")
    return (written != "") & (written == planned)


def host_rows(raw: DataFrame, json: str) -> DataFrame:
    """Rows of the serial host: deleted ones and those without id or title dropped, drafts left out, chapters numbered densely."""
    r = raw.select(F.from_json(F.col(json), HOST).alias("r")).select("r.*").where("id <> '' and title <> '' and not coalesce(deleted, false)")
    live = F.filter(F.coalesce("parts", F.array().cast("array<struct<id:string,title:string,draft:boolean>>")), lambda p: ~F.coalesce(p["draft"], F.lit(False)) & p["id"].isNotNull())
    refs = F.transform(live, lambda p, i: F.struct(p["id"].alias("source_id"), (i + 1).alias("index"), p["title"].alias("title")))
    return r.select("id", "title", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("mature", F.lit(False)).alias("mature"), F.coalesce("completed", F.lit(False)).alias("completed"), F.lower(F.left("language", F.lit(2))).alias("language"), whole(F.col("readCount")).alias("reads"), whole(F.col("voteCount")).alias("votes"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), refs.alias("chapter_refs"))


def wiki_candidates(name: Column) -> Column:
    """Subdomains to try: run together, with dashes, and both without a leading article."""
    words = F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0))
    bare = F.when(F.get(words, F.lit(0)).isin("the", "a", "an") & (F.size(words) > 1), F.slice(words, F.lit(2), F.size(words))).otherwise(words)
    return F.array_distinct(F.array(F.array_join(words, ""), F.array_join(words, "-"), F.array_join(bare, ""), F.array_join(bare, "-")))
