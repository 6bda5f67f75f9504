"""Reading and writing the canonical tables: Parquet snapshots, JSON lines, artifacts with a manifest.

There is no transactional table format at hand: writes that change rows make a new snapshot folder, appends check for
duplicate keys first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.functions.text import strip
from factloom.schema import FACT
from factloom.sources.shared import written

CORPUS_VERSION, INDEX_VERSION = "1.2", "1.0"


def read_facts(spark: SparkSession, path: str, fork: str | None = None, ordered: bool = False) -> DataFrame:
    """Facts of a snapshot partitioned by fork; naming a fork prunes to its folder.  ``ordered`` as recorded, then by id."""
    df = spark.read.schema(FACT).parquet(path)
    df = df if fork is None else df.where(F.col("fork_id") == fork)
    return df.orderBy("recorded_at", "id") if ordered else df


def write_facts(facts: DataFrame, path: str) -> None:
    """A whole snapshot, a folder per fork, sorted so that footers prune lookups by key."""
    facts.repartition("fork_id", F.pmod(F.xxhash64("subject_id"), F.lit(16))).sortWithinPartitions("subject_id", "predicate", "id").write.mode("overwrite").partitionBy("fork_id").parquet(path)


def append_facts(facts: DataFrame, path: str) -> DataFrame:
    """Insert only: the rows whose id is taken already come back unwritten."""
    spark = facts.sparkSession
    taken = read_facts(spark, path).select("id")
    twice = facts.groupBy("id").count().where("count > 1").select("id")
    bad = facts.join(taken, "id", "left_semi").unionByName(facts.join(twice, "id", "left_semi")).distinct()
    facts.join(taken, "id", "left_anti").join(twice, "id", "left_anti").write.mode("append").partitionBy("fork_id").parquet(path)
    return bad


def get(df: DataFrame, key: str, value: object) -> DataFrame:
    """Point lookup; row groups are skipped by their statistics."""
    return df.where(F.col(key) == F.lit(value))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` by key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def read_jsonl(spark: SparkSession, path: str, schema: StructType, key: str, seq: str | None = None) -> DataFrame:
    """JSON lines with the last good line per key; lines that are no objects are skipped.

    Order is the column ``seq`` where the lines have one; else the place in the file (time and name of the file, then the
    offset of the read), which leaves lines of files written in one moment in an order of their names.
    """
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(key).isNotNull())
    at = F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_name"), F.monotonically_increasing_id())
    if seq is not None:
        at = F.struct(F.col(seq))
    cols = [f.name for f in schema.fields]
    return rows.select(*cols, at.alias("__at")).groupBy(key).agg(F.max_by(F.struct(*cols), "__at").alias("r")).select("r.*")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def with_texts(works: DataFrame, texts: DataFrame, key: str, rows: DataFrame | None = None, offset: str = "row_index") -> DataFrame:
    """Works beside their cached texts.

    Where a text is missing and ``rows(row_index, id, text)`` of the host are given, it is taken from the row at the work's
    stored offset, provided that this row still is the work's own; else it is null.
    """
    both = works.join(texts.select(key, "text"), key, "left")
    if rows is None:
        return both
    again = rows.select(F.col("row_index").alias("__row"), F.col("id").cast("string").alias("__id"), strip(F.col("text")).alias("__text"))
    lost = both["text"].isNull() & (both[offset] == F.col("__row")) & (both[key].cast("string") == F.col("__id"))
    return both.join(again, lost, "left").select(*works.columns, F.coalesce("text", F.nullif("__text", F.lit(""))).alias("text"))


def fetched_chapters(works: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """The first ``most`` chapters of each work that have a text: missing ones are skipped, not fatal."""
    refs = works.select("work_id", F.posexplode(F.slice("chapter_refs", 1, most)).alias("pos", "chapter_id"))
    return refs.join(texts.select("chapter_id", "text"), "chapter_id")


def corpus_manifest(works: DataFrame) -> DataFrame:
    """One row about a corpus: version, counts, sources, order, quality."""
    return works.agg(
        F.lit(CORPUS_VERSION).alias("schema_version"),
        F.count("*").alias("works"),
        F.sum("chapters").alias("chapters"),
        F.sum("words").alias("words"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.min("score").alias("min_score"),
        F.bround(F.median("score"), 2).alias("median_score"),
        F.max("score").alias("max_score"),
    )


def write_corpus(works: DataFrame, path: str) -> None:
    """One JSON object per work in rank order, and the manifest beside them; both overwrite.

    Range partitioning by rank keeps the order over many files without one task writing all.
    """
    works.repartitionByRange(F.col("rank")).sortWithinPartitions("rank").write.mode("overwrite").json(f"{path}/works")
    corpus_manifest(works).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def index_records(entities: DataFrame) -> DataFrame:
    """Entities as they are written: natural key, evidence as a sorted distinct union over sources."""
    evidence = F.array_sort(F.array_distinct(F.flatten(F.transform("sources", lambda s: s["basis_evidence"]))))
    return entities.withColumn("natural_key", F.concat_ws(":", F.col("kind"), F.regexp_replace(F.lower("canonical_name"), "[^a-z0-9]+", "-"))).withColumn("basis_evidence", evidence)


def write_index(entities: DataFrame, path: str) -> None:
    """The entity index and its manifest as JSON."""
    index_records(entities).repartitionByRange(F.desc("prominence"), "canonical_name").sortWithinPartitions(F.desc("prominence"), "canonical_name").write.mode("overwrite").json(f"{path}/entities")
    entities.agg(F.lit(INDEX_VERSION).alias("schema_version"), F.count("*").alias("entities")).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def append_episode(spark: SparkSession, summaries: DataFrame, path: str) -> int:
    """Append rows without ``seq`` to the log, numbered on from its last one in order of ``pos``; how many came in.

    Numbers are counted per range of the new rows, so that no task sorts all of them.
    """
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
    last = spark.read.parquet(path).agg(F.max("seq")).first()[0] if there else None
    rows = written(summaries.repartitionByRange("pos").sortWithinPartitions("pos").withColumn("__at", F.monotonically_increasing_id()), "episodes")
    rows = rows.withColumn("__range", F.shiftright("__at", 33))
    sums = rows.groupBy("__range").agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__range", "__first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    seq = F.lit((last if last is not None else -1) + 1) + F.col("__before") + F.col("__at") - F.col("__first")
    numbered = rows.join(sums, "__range").select(seq.cast("long").alias("seq"), *(c for c in summaries.columns if c != "pos"))
    numbered.write.mode("append").parquet(path)
    return rows.count()
