"""Canonical tables over the driver's tables, and the same views as DuckDB SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.schema import FORK

FORKS = [("canon", None, None, None, "main line"), ("child", "canon", 12, None, "what if"), ("grand", "child", 20, None, "what then"), ("side", "canon", 5, None, "aside")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORKS, FORK)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as facts: who (user) did what (type) to whom, since which day, and who knows."""
    e = table(spark, sf_dir, "events")
    day, n = F.dayofmonth("ts"), F.col("event_id")
    related = F.col("event_type").isin("view", "click")
    revealed = F.when(n % 5 != 0, day + (n % 4).cast("int"))
    own = F.struct(F.concat(F.lit("k"), (F.col("user_id") % 5).cast("string")).alias("knower"), (day + (n % 7).cast("int")).alias("learned_at"))
    public = F.when(revealed.isNotNull(), F.array(F.struct(F.lit("audience").alias("knower"), revealed.alias("learned_at")))).otherwise(F.array().cast("array<struct<knower:string,learned_at:int>>"))
    status = F.when(n % 20 < 2, "quarantined").when(n % 20 < 5, "invalidated").otherwise("active")
    return e.select(
        n.alias("id"),
        F.when(n % 10 < 6, "canon").when(n % 10 < 8, "child").when(n % 10 == 8, "grand").otherwise("side").alias("fork_id"),
        F.col("user_id").alias("subject_id"),
        F.col("event_type").alias("predicate"),
        F.when(related, n * 7 % 150).alias("object_id"),
        F.when(~related, F.regexp_extract("props", "([0-9]+)", 1)).alias("object_literal"),
        day.alias("valid_from"),
        F.when(n % 4 == 0, day + (n % 6).cast("int")).alias("valid_to"),
        revealed.alias("revealed_at"),
        F.when(n % 11 == 0, "attributed").otherwise("narrated").alias("assertion_mode"),
        F.when(n % 22 == 0, "witness").alias("attributed_to"),
        F.when(n % 3 == 0, F.concat(F.array(own), public)).alias("knower_scope"),
        F.struct(F.lit("events").alias("source_id"), day.alias("chapter"), F.lit(0).alias("char_start"), F.length("props").alias("char_end"), F.col("props").alias("quote")).alias("provenance"),
        F.lit(0.9).alias("confidence"),
        F.lit(0).alias("tier"),
        status.alias("status"),
        F.col("ts").alias("recorded_at"),
        F.when(status == "invalidated", F.col("ts")).alias("superseded_at"),
    )


#: The same facts in DuckDB.
FACT_SQL = """fact AS (
    SELECT event_id AS id,
        CASE WHEN event_id % 10 < 6 THEN 'canon' WHEN event_id % 10 < 8 THEN 'child' WHEN event_id % 10 = 8 THEN 'grand' ELSE 'side' END AS fork_id,
        user_id AS subject_id, event_type AS predicate,
        CASE WHEN event_type IN ('view', 'click') THEN event_id * 7 % 150 END AS object_id,
        CASE WHEN event_type NOT IN ('view', 'click') THEN regexp_extract(props, '([0-9]+)', 1) END AS object_literal,
        CAST(day(ts) AS INT) AS valid_from,
        CAST(CASE WHEN event_id % 4 = 0 THEN day(ts) + event_id % 6 END AS INT) AS valid_to,
        CAST(CASE WHEN event_id % 5 <> 0 THEN day(ts) + event_id % 4 END AS INT) AS revealed_at,
        CASE WHEN event_id % 11 = 0 THEN 'attributed' ELSE 'narrated' END AS assertion_mode,
        CASE WHEN event_id % 22 = 0 THEN 'witness' END AS attributed_to,
        event_id % 3 = 0 AS tracked,
        'k' || (user_id % 5) AS own_knower, CAST(day(ts) + event_id % 7 AS INT) AS own_at,
        CASE WHEN event_id % 20 < 2 THEN 'quarantined' WHEN event_id % 20 < 5 THEN 'invalidated' ELSE 'active' END AS status,
        props AS quote, ts AS recorded_at
    FROM events)"""
FORK_SQL = "fork(id, parent, cut) AS (VALUES ('canon', NULL, CAST(NULL AS INT)), ('child', 'canon', 12), ('grand', 'child', 20), ('side', 'canon', 5))"
LINEAGE_SQL = """lineage(root, ancestor, cap, depth) AS (
    VALUES ('canon', 'canon', CAST(NULL AS INT), 0), ('child', 'child', NULL, 0), ('child', 'canon', 12, 1), ('side', 'side', NULL, 0), ('side', 'canon', 5, 1),
        ('grand', 'grand', NULL, 0), ('grand', 'child', 20, 1), ('grand', 'canon', 12, 2))"""
RESOLVED_SQL = """resolved AS (
    SELECT root, depth, fact.* FROM (
        SELECT l.root, l.depth, l.cap, f.*, min(l.depth) OVER (PARTITION BY l.root, f.subject_id, f.predicate) AS nearest
        FROM fact f JOIN lineage l ON f.fork_id = l.ancestor) fact
    WHERE depth = nearest AND (cap IS NULL OR valid_from <= cap))"""


def seen_sql(knower: str, chapter: str) -> str:
    """The guard in DuckDB."""
    return f"""coalesce(status <> 'quarantined' AND CASE WHEN NOT tracked THEN revealed_at <= {chapter}
        WHEN {knower} = 'audience' THEN revealed_at <= {chapter} ELSE own_knower = {knower} AND own_at <= {chapter} END, false)"""


def valid_sql(chapter: str) -> str:
    return f"(valid_from <= {chapter} AND (valid_to IS NULL OR {chapter} <= valid_to))"


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations read as scenes: one per (conversation, turn) with a roster of three people."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    person = lambda k, grade: F.struct(F.concat(F.lit("p"), ((F.col("conv_id") + k) % 7).cast("string")).alias("entity_id"), grade.alias("grade"))
    grade = F.when(F.col("role") == "user", "active").when(F.col("role") == "assistant", "silent").otherwise("referenced")
    return c.select("conv_id", "turn", (F.col("turn") + 1).cast("int").alias("chapter"), F.array(person(0, grade), person(1, F.lit("active")), person(2, F.lit("referenced"))).alias("roster"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations read as an append-only episode log."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("series_id"), F.col("turn").alias("seq"), (F.col("turn") % 4).cast("int").alias("episode_number"), F.col("text").alias("synopsis"))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as chapters of works, one work per source."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("work"), F.col("doc_id").alias("pos"), F.coalesce("text", F.lit("")).alias("text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings read as indexed facts with the guard's columns beside them."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("fact_id"), F.concat(F.lit("f"), (F.col("label") % 2).cast("string")).alias("fork_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.when(F.col("vec_id") % 13 == 0, "quarantined").otherwise("active").alias("status"), (F.col("label") + 1).cast("int").alias("revealed_at"), F.lit(None).cast("array<struct<knower:string,learned_at:int>>").alias("knower_scope"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts read as sightings of entities under several canons: brands, seen many times, and every fiftieth part by itself."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    basis = lambda k: F.element_at(F.array(F.lit("unknown"), F.lit("novel"), F.lit("screen"), F.lit("both")), (k % 4 + 1).cast("int"))
    url = F.concat(F.lit("u/"), n.cast("string"))
    own = F.when(n % 2 == 0, F.upper("p_brand")).otherwise(F.concat(F.lit(" "), "p_brand"))
    target, size = F.substring_index("p_name", " ", -1), F.col("p_size").cast("string")
    relation = lambda t, k: F.struct(t.alias("target"), F.lower("p_type").alias("kind"), F.lit("family").alias("field"), basis(k).alias("canon_basis"), url.alias("source_url"))
    attribute = lambda v: F.struct(F.lit("size").alias("predicate"), v.alias("value"), basis(n).alias("canon_basis"), url.alias("source_url"))
    return p.select(
        n.alias("pos"),
        F.when(n % 50 == 0, F.concat_ws(" ", "p_name", n.cast("string"))).otherwise(own).alias("canonical_name"),
        F.when(F.col("p_size") % 3 == 0, "other").otherwise(F.lower("p_type")).alias("kind"),
        basis(F.col("p_size")).alias("canon_basis"),
        F.when(F.col("p_size") % 5 == 0, "alive").otherwise("unknown").alias("life_status"),
        F.col("p_name").alias("summary"),
        F.array(F.substring_index("p_name", " ", 1), F.concat(F.lit(" "), F.lower("p_brand"))).alias("aliases"),
        F.array(relation(target, n), relation(F.concat(F.lit(" "), F.upper(target)), n + 1)).alias("relationships"),
        F.array(attribute(size)).alias("attributes"),
        F.array(F.struct(F.concat(F.lit("Page "), target).alias("page_title"), url.alias("page_url"), F.array(target).alias("basis_evidence"))).alias("sources"),
        (n % 97).alias("prominence"),
    )


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items read as entities, named by their first three words of four letters or more (those that have one)."""
    b = table(spark, sf_dir, "benchmark")
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)), 1, 3)
    basis = F.element_at(F.array(F.lit("unknown"), F.lit("novel"), F.lit("screen"), F.lit("both")), (F.col("item_id") % 4 + 1).cast("int"))
    e = b.select(F.concat(F.lit("e"), F.col("item_id").cast("string")).alias("name"), words.alias("w"), basis.alias("canon_basis"), (F.col("item_id") % 97).alias("prominence"), F.col("item_id").alias("pos"))
    return e.where(F.size("w") > 0).select("name", F.element_at("w", 1).alias("canonical_name"), F.col("w").alias("aliases"), "canon_basis", "prominence", "pos")
