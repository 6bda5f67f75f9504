"""Entities seen under several canons: merging, indexes, tallies, recognising them in texts."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import strip

BASIS = {"unknown": 0, "novel": 1, "screen": 2, "both": 3}
MIN_NAME = 4


def basis_bits(c: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in BASIS.items() for x in kv)), c)


def basis_name(bits: Column) -> Column:
    return F.element_at(F.array(*(F.lit(k) for k in BASIS)), (bits + 1).cast("int"))


def norm(c: Column) -> Column:
    return F.lower(strip(c))


def with_name(entities: DataFrame) -> DataFrame:
    """With the ``name`` that sightings share and ``sightings``, how many there are."""
    named = entities.withColumn("name", norm(F.col("canonical_name")))
    return named.join(named.groupBy("name").agg(F.count("*").alias("sightings")), "name")


def merge(entities: DataFrame) -> DataFrame:
    """One row per name, most prominent first in ``rank`` order: the spelling and summary of the richest sighting (longest
    summary, then most prominence, then first), basis joined (unknown below novel and screen, both above), first kind that is
    not other, first life status that is known, most prominence, aliases without regard to case and white space and without
    the name itself.  A name seen once keeps its row as it is.

    One pass of map-side combined aggregates; no group is sorted or gathered except its short list of aliases.
    """
    e = entities.withColumn("name", norm(F.col("canonical_name"))).withColumn("bits", basis_bits(F.col("canon_basis")))
    rich = F.struct(F.length("summary"), "prominence", -F.col("pos"))
    out = e.groupBy("name").agg(
        F.max_by("canonical_name", rich).alias("canonical_name"),
        basis_name(F.bit_or("bits")).alias("canon_basis"),
        F.coalesce(F.min_by("kind", F.when(F.col("kind") != "other", F.col("pos"))), F.lit("other")).alias("kind"),
        F.coalesce(F.min_by("life_status", F.when(F.col("life_status") != "unknown", F.col("pos"))), F.lit("unknown")).alias("life_status"),
        F.max_by("summary", rich).alias("summary"),
        F.max("prominence").alias("prominence"),
        F.min("pos").alias("pos"),
        F.count("*").alias("sightings"),
        F.max_by("aliases", rich).alias("own"),
    )
    alias = e.select("name", "pos", F.posexplode("aliases").alias("at", "alias")).withColumn("k", norm(F.col("alias"))).where("k <> '' and k <> name")
    low = alias.groupBy("name", "k").agg(F.min_by("alias", F.struct("pos", "at")).alias("alias"), F.min(F.struct("pos", "at")).alias("o"))
    names = low.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "alias"))), lambda x: x["alias"]).alias("aliases"))
    none = F.array().cast("array<string>")
    every = F.when(F.col("sightings") == 1, F.coalesce("own", none)).otherwise(F.coalesce("aliases", none))
    return out.join(names, "name", "left").withColumn("aliases", every).drop("own")


def in_order(merged: DataFrame) -> DataFrame:
    """Most prominent first, then by name: whoever cuts the list keeps the leads."""
    return merged.orderBy(F.desc("prominence"), "canonical_name")


def _items(entities: DataFrame, field: str) -> DataFrame:
    """Items of a nested field with their name and place; ``solo`` tells items apart where a name was seen but once."""
    rows = with_name(entities).select("name", "pos", "sightings", F.posexplode(field).alias("at", "x"))
    return rows.withColumn("solo", F.when(F.col("sightings") == 1, F.col("at"))).withColumn("o", F.struct("pos", "at"))


def merge_relationships(entities: DataFrame) -> DataFrame:
    """Relationships per name, told apart by target and kind, with the first spelling and their own bases joined."""
    r = _items(entities, "relationships").groupBy("name", norm(F.col("x.target")).alias("t"), F.lower("x.kind").alias("k"), "solo")
    r = r.agg(F.min_by("x", "o").alias("x"), basis_name(F.bit_or(basis_bits(F.col("x.canon_basis")))).alias("canon_basis"))
    return r.select("name", "x.target", "x.kind", "canon_basis")


def merge_attributes(entities: DataFrame) -> DataFrame:
    """Attributes per name, told apart by predicate and value: values that differ between canons stand side by side."""
    a = _items(entities, "attributes").groupBy("name", F.col("x.predicate").alias("p"), F.lower("x.value").alias("v"), "solo")
    a = a.agg(F.min_by("x", "o").alias("x"), basis_name(F.bit_or(basis_bits(F.col("x.canon_basis")))).alias("canon_basis"))
    return a.select("name", "x.predicate", "x.value", "canon_basis")


def merge_sources(entities: DataFrame) -> DataFrame:
    """Source pages per name, the first of each page title; none is ever dropped."""
    s = _items(entities, "sources").groupBy("name", F.lower("x.page_title").alias("t"), "solo").agg(F.min_by("x", "o").alias("x"))
    return s.select("name", "x.*")


def tallies(entities: DataFrame) -> DataFrame:
    """Counts by kind and by basis in one pass."""
    both = entities.groupBy("kind", "canon_basis").agg(F.count("*").alias("n"))
    kinds = both.groupBy(F.col("kind").alias("value")).agg(F.sum("n").alias("n")).withColumn("by", F.lit("kind"))
    bases = both.groupBy(F.col("canon_basis").alias("value")).agg(F.sum("n").alias("n")).withColumn("by", F.lit("basis"))
    return kinds.unionByName(bases)


def match_names(entities: DataFrame) -> DataFrame:
    """Every name an entity answers to: (match, at, plus the entity's columns)."""
    names = F.array_distinct(F.transform(F.concat(F.array("canonical_name"), "aliases"), norm))
    return entities.select(*[c for c in entities.columns if c != "aliases"], F.posexplode(names).alias("at", "match"))


def name_index(entities: DataFrame) -> DataFrame:
    """match to entity; the earliest entity wins a contested name."""
    m = match_names(entities)
    return m.groupBy("match").agg(F.min_by("name", F.struct("pos", "at")).alias("name"))


def unresolved_targets(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Targets of relationships that no entity answers to."""
    known = name_index(entities).select("match")
    return relationships.select(F.lower("target").alias("match"), "target").join(known, "match", "left_anti").select("target").distinct()


def vocabulary(entities: DataFrame, basis: str) -> DataFrame:
    """Names of the entities of one basis."""
    return match_names(entities.where(F.col("canon_basis") == basis)).select("match").distinct()


def thick(entities: DataFrame, least_words: int) -> DataFrame:
    """Entities whose summary has enough words."""
    return entities.where(F.regexp_count(F.coalesce("summary", F.lit("")), F.lit(r"(?U)\S+")) >= least_words)


#: Names and their letters up to which an automaton is broadcast.
MOST_NAMES, MOST_LETTERS = 100_000, 4_000_000
#: Names found that a task holds before it hands them on.
MOST_FOUND = 20_000


def _found_in(by: dict[str, list[tuple]], batches: Iterator[pa.RecordBatch], most: int = MOST_FOUND) -> Iterator[pa.RecordBatch]:
    """Names in the texts of ``batches(key, text)``: a text at a time, and what is found goes on before there is much of it."""
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
    a = ahocorasick.Automaton()
    for match, of in by.items():
        a.add_word(match, of)
    if len(a):
        a.make_automaton()

    def found(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "name", "basis", "rank"])

    for batch in batches:
        rows: list[tuple] = []
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            if len(a):
                key = key.as_py()
                rows += [(key, *x) for x in {x for _, of in a.iter(text.as_py() or "") for x in of}]
            if len(rows) >= most:
                yield found(rows)
                rows = []
        yield found(rows)


def names_in(texts: DataFrame, names: DataFrame, most_names: int = MOST_NAMES) -> DataFrame:
    """(key, name, basis, rank) of the ``names(match, name, basis, rank)`` that ``texts(key, text)`` contain.

    Up to ``most_names`` names, counted first, an automaton over all of them goes to the executors and each text is walked
    once, whatever their number.  Beyond that names and texts are joined on four letters (names have that many at least)
    and what meets is verified.
    """
    size = names.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("match")), F.lit(0)).alias("letters")).first()
    schema = "key string, name string, basis string, rank long"
    if size["n"] > most_names or size["letters"] > MOST_LETTERS:
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - 3, F.lit(1))), lambda i: F.substring(F.col("text"), i, F.lit(4))))
        near = texts.select("key", F.explode(grams).alias("gram")).join(names.withColumn("gram", F.left("match", F.lit(4))), "gram")
        return near.join(texts, "key").where(F.contains("text", F.col("match"))).select("key", "name", "basis", "rank").distinct()
    by: dict[str, list[tuple]] = {}
    for r in names.collect():
        by.setdefault(r["match"], []).append((r["name"], r["basis"], r["rank"]))
    shared = texts.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _found_in(shared.value, batches)

    return texts.select("key", "text").mapInArrow(run, schema)


def classify(texts: DataFrame, entities: DataFrame, id_col: str, text_col: str, most_names: int = MOST_NAMES) -> DataFrame:
    """Basis of each text by the entities whose names (four letters or more) it contains as substrings, and those
    entities, most prominent first.

    Screen wins over all, then all unknown, then novel, else both; a text that names nobody is unknown.  Equal texts are
    looked through once.
    """
    names = match_names(entities).where(F.length("match") >= MIN_NAME)
    names = names.select("match", "name", F.col("canon_basis").alias("basis"), F.col("prominence").cast("long").alias("rank")).distinct()
    keyed = texts.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text")).withColumn("key", F.sha2("text", 256))
    hits = names_in(keyed.dropDuplicates(["key"]).select("key", "text"), names, most_names)
    found = F.array_sort(F.collect_set(F.struct((-F.col("rank")).alias("rank"), "name", "basis")))
    seen = keyed.select("id", "key").join(hits.groupBy("key").agg(found.alias("found")), "key", "left")
    seen = seen.withColumn("found", F.coalesce("found", F.array().cast("array<struct<rank:bigint,name:string,basis:string>>")))
    some = lambda b: F.exists("found", lambda x: x["basis"] == b)
    basis = F.when(some("screen"), "screen").when(F.forall("found", lambda x: x["basis"] == "unknown"), "unknown").when(some("novel"), "novel").otherwise("both")
    return seen.select("id", F.transform("found", lambda x: x["name"]).alias("names"), basis.alias("basis"))


def harvest_report(seen: DataFrame, least_words: int) -> DataFrame:
    """One row about an index run: sightings, thin ones, kept, merged away, relationships, attributes."""
    kept = thick(seen, least_words)
    names = kept.select(norm(F.col("canonical_name")).alias("name"), F.size("relationships").alias("r"), F.size("attributes").alias("a"))
    by = names.groupBy("name").agg(F.count("*").alias("n"), F.sum("r").alias("r"), F.sum("a").alias("a"))
    sums = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates_merged"), F.coalesce(F.sum("r"), F.lit(0)).alias("relationships"), F.coalesce(F.sum("a"), F.lit(0)).alias("attributes"))
    return seen.agg(F.count("*").alias("seen")).join(sums).select("seen", (F.col("seen") - F.col("kept")).alias("thin"), "kept", "duplicates_merged", "relationships", "attributes")
