"""Queries over whole stories: drafts held against canon, harvests, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import template, text
from factloom.functions.guard import is_visible
from factloom.operators import corpus, history, knowledge, lanes, lineage, verify
from factloom.operators.harvest import Harvest, Policy, candidates, harvest
from factloom.operators.harvest import write as write_harvest
from factloom.plans import surface, views
from factloom.plans.queries_text import CLEAN, PREMISE_SQL, PROSE, TOTAL, premised
from factloom.plans.registry import query
from factloom.plans.views import FACT_SQL, LINEAGE_SQL, RESOLVED_SQL, seen_sql, valid_sql
from factloom.sources import paged, tables
from factloom.sources.shared import folder, written

# --- drafts against canon ----------------------------------------------------------------------------------------------

SINGLE, PLACE, HOLDER, STATUS = ["purchase", "signup"], "view", "click", "error"
ROOTS = ("canon", "child", "grand", "side")


def storied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of all forks, where errors tell how somebody is."""
    f = views.facts(spark, sf_dir)
    state = F.when(F.col("id") % 3 == 0, "dead").when(F.col("id") % 3 == 1, "active").otherwise("imprisoned")
    f = f.withColumn("object_literal", F.when(F.col("predicate") == STATUS, state).otherwise(F.col("object_literal")))
    return written(lineage.resolved(f, lineage.lineage(spark, views.forks(spark))), "canon")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations read as a draft: each claims something about somebody in one of the forks."""
    c = views.table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    conv, turn, size = F.col("conv_id"), F.col("turn"), F.length(F.coalesce("text", F.lit("")))
    pick = lambda of, k: F.element_at(F.array(*(F.lit(x) for x in of)), (k % len(of) + 1).cast("int"))
    start = ((conv + turn * 5) % 28 + 1).cast("int")
    c = c.select(
        (conv * 1000 + turn).alias("claim_id"),
        pick(ROOTS, conv).alias("root"),
        ((conv * 7 + turn) % 150).alias("subject_id"),
        pick([*SINGLE, PLACE, HOLDER, STATUS], conv + turn).alias("predicate"),
        (size * 7 % 150).cast("string").alias("says"),
        start.alias("start"),
        F.when(conv % 11 != 0, start + (conv % 3).cast("int")).alias("stop"),
        F.when(F.col("role") == "user", F.concat(F.lit("k"), (conv % 5).cast("string"))).when(F.col("role") == "assistant", "audience").alias("knower"),
        (conv * 10 + turn).alias("cause_id"),
        F.array(conv * 10 + turn, conv * 10 + turn + 5).alias("used"),
    )
    return c.withColumn("span", F.concat_ws(" ", F.col("subject_id").cast("string"), "predicate", "says"))


def _told(flags: DataFrame) -> DataFrame:
    return flags.withColumn("cited_fact_ids", F.array_join(F.transform("cited_fact_ids", lambda i: i.cast("string")), ","))


CANON_SQL = f"""{FACT_SQL}, {LINEAGE_SQL}, {RESOLVED_SQL},
    canon AS (SELECT * REPLACE (CASE WHEN predicate <> 'error' THEN object_literal WHEN id % 3 = 0 THEN 'dead' WHEN id % 3 = 1 THEN 'active' ELSE 'imprisoned' END AS object_literal) FROM resolved),
    spoken AS (SELECT *, coalesce(CAST(object_id AS VARCHAR), object_literal) AS says, concat_ws(' ', subject_id, predicate, coalesce(CAST(object_id AS VARCHAR), object_literal)) AS said,
        valid_from AS start, coalesce(valid_to, 2147483647) AS stop FROM canon)"""
FLAG_SQL = """SELECT {about} AS about, x.id, invariant, 'blocking' AS severity, 'hard' AS lane, span AS draft_span,
        string_agg(CAST(fact_id AS VARCHAR), ',' ORDER BY fact_id) AS cited_fact_ids,
        'draft says ' || span || '; canon: ' || string_agg(said || ' since chapter ' || start, '; ' ORDER BY fact_id) AS citation
    FROM (SELECT DISTINCT id, invariant, fact_id FROM {found}) x JOIN (SELECT DISTINCT id AS fact_id, said, start FROM spoken) USING (fact_id) JOIN (SELECT id, span FROM {spans}) s ON s.id = x.id
    GROUP BY x.id, invariant, span"""
#: Every claim against every fact of its key.
CLASH_SQL = """SELECT c.id, '{name}' AS invariant, arg_max(f.id, (f.stop, f.id)) AS fact_id FROM claim c JOIN spoken f ON f.status = 'active' AND f.root = c.root AND f.predicate = c.predicate
        AND f.{key} = c.{key} AND f.{says} <> c.{says} AND f.start <= c.stop
    WHERE c.predicate IN ({predicates}) AND c.stop >= c.start GROUP BY c.id, c.start HAVING max(f.stop) >= c.start"""
CLAIM_SQL = """claim AS (
    SELECT conv_id * 1000 + turn AS id, ['canon', 'child', 'grand', 'side'][conv_id % 4 + 1] AS root, (conv_id * 7 + turn) % 150 AS subject_id,
        ['purchase', 'signup', 'view', 'click', 'error'][(conv_id + turn) % 5 + 1] AS predicate, CAST(length(coalesce(text, '')) * 7 % 150 AS VARCHAR) AS says,
        (conv_id + turn * 5) % 28 + 1 AS start, CASE WHEN conv_id % 11 <> 0 THEN (conv_id + turn * 5) % 28 + 1 + conv_id % 3 ELSE 2147483647 END AS stop,
        CASE role WHEN 'user' THEN 'k' || conv_id % 5 WHEN 'assistant' THEN 'audience' END AS knower, conv_id * 10 + turn AS cause_id,
        concat_ws(' ', (conv_id * 7 + turn) % 150, ['purchase', 'signup', 'view', 'click', 'error'][(conv_id + turn) % 5 + 1], length(coalesce(text, '')) * 7 % 150) AS span
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)"""


@query(f"""WITH {CANON_SQL}, {CLAIM_SQL},
held AS (SELECT * FROM (SELECT c.id, f.id AS fact_id, says_now, row_number() OVER (PARTITION BY c.id ORDER BY f.valid_from DESC, f.recorded_at DESC, f.id DESC) AS rn
    FROM claim c JOIN (SELECT *, says AS says_now FROM spoken WHERE predicate = 'error' AND status = 'active') f ON f.root = c.root AND f.subject_id = c.subject_id AND f.valid_from <= c.start AND c.start <= f.stop
    WHERE c.predicate <> 'error') WHERE rn = 1 AND says_now IN ('dead', 'destroyed', 'imprisoned')),
found AS (
    {CLASH_SQL.format(name="identity", key="subject_id", says="says", predicates="'purchase', 'signup'")}
    UNION ALL {CLASH_SQL.format(name="timeline", key="subject_id", says="says", predicates="'view'")}
    UNION ALL {CLASH_SQL.format(name="inventory", key="says", says="subject_id", predicates="'click'")}
    UNION ALL SELECT id, 'mortality', fact_id FROM held
    UNION ALL SELECT c.id, 'timeline', f.id FROM claim c JOIN spoken f ON f.root = c.root AND f.id = c.cause_id AND f.status = 'active' AND c.start < f.start
    UNION ALL SELECT u.id, 'epistemic', f.id FROM (SELECT id, root, knower, start AS at, unnest([cause_id, cause_id + 5]) AS used FROM claim WHERE knower IS NOT NULL) u
        JOIN spoken f ON f.root = u.root AND f.id = u.used WHERE NOT {seen_sql("u.knower", "u.at")})
{FLAG_SQL.format(about="'claim'", found="found", spans="claim")}""")
def hard_lane_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(verify.hard_lane(storied(spark, sf_dir), claims(spark, sf_dir), single=SINGLE, place=PLACE, holder=HOLDER, status=STATUS))


@query(f"""WITH {CANON_SQL}, name AS (SELECT DISTINCT c_custkey AS id, unnest([lower(trim(c_name)), lower(trim(c_mktsegment || c_nationkey))]) AS name FROM customer),
low AS (SELECT name, min(id) AS lowest FROM name GROUP BY name), first AS (SELECT subject_id AS id, min(id) AS fact_id FROM spoken WHERE root = 'canon' AND status = 'active' GROUP BY subject_id),
pair AS (SELECT DISTINCT id, lowest FROM name JOIN low USING (name) WHERE id > lowest),
found AS (SELECT p.id, 'identity' AS invariant, unnest([a.fact_id, b.fact_id]) AS fact_id FROM pair p JOIN first a ON a.id = p.id JOIN first b ON b.id = p.lowest),
span AS (SELECT DISTINCT id, 'entity ' || id AS span FROM pair)
{FLAG_SQL.format(about="'entity'", found="found", spans="span")}""")
def twin_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers read as entities of the main line, by their names and a name that others may share."""
    c = views.table(spark, sf_dir, "customer")
    entities = c.select(F.col("c_custkey").alias("id"), F.lit("canon").alias("root"), F.array("c_name", F.concat(F.lit(" "), "c_mktsegment", F.col("c_nationkey").cast("string"))).alias("names"))
    return _told(verify.twins(storied(spark, sf_dir), entities))


OVERLAP_SQL = "SELECT *, coalesce(CAST(object_id AS VARCHAR), object_literal) AS says, coalesce(valid_to, 2147483647) AS stop FROM fact WHERE status = 'active'"


@query(f"""WITH {FACT_SQL}, live AS ({OVERLAP_SQL})
SELECT a.id AS claim_id, arg_max(b.id, (b.stop, b.id)) AS fact_id FROM live a JOIN live b USING (fork_id, subject_id, predicate)
WHERE b.valid_from <= a.valid_from AND a.says <> b.says GROUP BY a.id, a.valid_from HAVING max(b.stop) >= a.valid_from""")
def overlapping_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active facts that start while another one of their key says otherwise, swept in stretches of a week."""
    f = views.facts(spark, sf_dir).where("status = 'active'")
    says = F.coalesce(F.col("object_id").cast("string"), F.col("object_literal"))
    key = F.concat_ws("/", "fork_id", F.col("subject_id").cast("string"), "predicate")
    return verify.overlapping(f.select("id", key.alias("key"), says.alias("says"), F.col("valid_from").alias("start"), F.col("valid_to").alias("stop")), 7)


# --- harvests ----------------------------------------------------------------------------------------------------------

#: Works are documents of two sources, chapters their lines; two of four names have to be mentioned.
POLICY = Policy("trash", ("that", "of the", "src 1"), most=60, most_chapters=20, min_words=12, min_quotes=0.0, min_reads=200, min_votes=1, least_score=20.0, plain=True)


def harvested(spark: SparkSession, sf_dir: str) -> Harvest:
    d = views.table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    works = d.select(
        "source",
        (F.col("doc_id") % 300).alias("source_id"),
        F.col("doc_id").alias("pos"),
        F.lit("").alias("title"),
        F.col("text").alias("description"),
        F.array("source").alias("tags"),
        F.col("lang").alias("language"),
        F.col("n_chars").alias("reads"),
        (F.col("doc_id") % 7).alias("votes"),
        (F.col("doc_id") % 11 == 0).alias("mature"),
    )
    found = candidates([works.where("pos % 2 = 1"), works.where("pos % 2 = 0")], POLICY.most)
    lines = d.select(F.col("doc_id").alias("pos"), F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    chapters = lines.join(found.select("pos", "place"), "pos").select("place", (F.col("line") + 1).alias("index"), "text")
    return harvest(found, chapters, POLICY)


HARVEST_SQL = rf"""doc AS (SELECT *, row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id) AS nth FROM documents),
    cand AS (SELECT * FROM (SELECT *, (1 - doc_id % 2) * 281474976710656 + doc_id AS place, row_number() OVER (PARTITION BY source, doc_id % 300 ORDER BY 1 - doc_id % 2, doc_id) AS sighting
        FROM doc WHERE nth <= {POLICY.most * 4}) WHERE sighting = 1),
    said AS (SELECT place, coalesce(text, '') AS text, ' ' || lower(coalesce(text, '')) AS said, source, doc_id % 11 <> 0 AND n_chars >= 200 AND doc_id % 7 >= 1 AND lang = 'en' AS fits FROM cand),
    asked AS (SELECT *, fits AND (regexp_matches(said || ' ' || source, '\btrash\W*(?:fan\W*fictions?|fan\W*fics?|fics?)\b|\b(?:fan\W*fictions?|fan\W*fics?|fics?)\W*trash\b') OR hits >= 2) AS relevant
        FROM (SELECT *, (source = 'src1' OR regexp_matches(said, '\bsrc\W*1\b'))::INT + regexp_matches(said, '\bof\W*the\b')::INT + regexp_matches(said, '\btrash\b')::INT + regexp_matches(said, '\bthat\b')::INT AS hits FROM said)),
    line AS (SELECT place, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS idx FROM asked WHERE relevant),
    chap AS (SELECT place, idx, {CLEAN} AS clean FROM line WHERE idx <= {POLICY.most_chapters}),
    gauged AS (SELECT *, len(regexp_extract_all(clean, '\S+')) AS words, regexp_replace(regexp_replace(lower(clean), '\s+', ' ', 'g'), '^ | $', '', 'g') AS norm FROM chap),
    ranked AS (SELECT *, words >= {POLICY.min_words} AS prose, row_number() OVER (PARTITION BY norm, words >= {POLICY.min_words} ORDER BY place, idx) AS again FROM gauged),
    tally AS (SELECT place, count(*) FILTER (WHERE prose AND again = 1) AS chapters, count(*) FILTER (WHERE NOT prose) AS dropped_non_prose, count(*) FILTER (WHERE prose AND again > 1) AS dropped_duplicate,
        coalesce(sum(words) FILTER (WHERE prose AND again = 1), 0) AS total_words FROM ranked GROUP BY place),
    cut AS (SELECT coalesce(max(place) FILTER (WHERE nth = {POLICY.most}), 9223372036854775807) AS last FROM (SELECT place, row_number() OVER (ORDER BY place) AS nth FROM tally WHERE chapters > 0)),
    prosed AS (SELECT place AS doc_id, string_agg(clean, chr(10) || chr(10) ORDER BY idx) AS text FROM ranked, cut WHERE prose AND again = 1 AND place <= last GROUP BY place),
    {PROSE.replace("FROM documents", "FROM prosed")},
    scored AS (SELECT doc_id AS place, round_even({TOTAL}, 2) AS score FROM p),
    story AS (SELECT tally.*, score FROM tally JOIN scored USING (place)),
    good AS (SELECT * FROM story WHERE score >= {POLICY.least_score})"""


@query(f"""WITH {HARVEST_SQL}
SELECT 'trash' AS name, 3 AS aliases_used, (SELECT count(*) FROM cand) AS candidates_seen, (SELECT count(*) FROM asked, cut WHERE place <= last AND NOT relevant) AS relevance_rejected,
    (SELECT sum(dropped_non_prose) FROM tally, cut WHERE place <= last) AS prose_rejected, (SELECT sum(dropped_duplicate) FROM tally, cut WHERE place <= last) AS duplicates_dropped,
    (SELECT count(*) FROM story) - count(*) AS quality_rejected, count(*) AS stories_kept, sum(chapters) AS chapters_kept, sum(total_words) AS total_words,
    round(min(score), 1) AS least_score, round(round_even(median(score), 2), 1) AS median_score, round(max(score), 1) AS best_score FROM good""")
def harvest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts of one harvest."""
    report = harvested(spark, sf_dir).report.drop("premises_detected", "branch_points")
    return report.select(*(F.round(c, 1).alias(c) if c.endswith("_score") else F.col(c) for c in report.columns))


@query(f"WITH {HARVEST_SQL} SELECT place, hits AS relevance_score, chapters, dropped_non_prose, dropped_duplicate, total_words, round(score, 1) AS score FROM good JOIN asked USING (place)")
def harvested_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The works of the same harvest."""
    of = harvested(spark, sf_dir).works
    return of.select("place", "relevance_score", "chapters", "dropped_non_prose", "dropped_duplicate", "total_words", F.round("score", 1).alias("score"))


@query(f"""WITH {HARVEST_SQL}, whole AS (SELECT good.*, source FROM good JOIN cand USING (place))
SELECT '1.2' AS schema_version, 'trash' AS name, count(*) AS story_count, sum(chapters) AS chapter_count, sum(total_words) AS total_words, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
    count(*) AS scored_works, round(min(score), 1) AS least, round(round_even(median(score), 2), 1) AS median, round(max(score), 1) AS best, 'prose_quality_score_desc' AS ordering FROM whole""")
def harvest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same harvest written, and what its manifest says."""
    path = folder(spark, "harvest")
    write_harvest(harvested(spark, sf_dir), path)
    shape = "schema_version string, name string, story_count long, chapter_count long, total_words long, sources array<string>, scored_works long, least double, median double, best double, ordering string"
    read = spark.read.schema(shape).json(f"{path}/manifest").withColumn("sources", F.array_join("sources", ","))
    return read.select(*(F.round(c, 1).alias(c) if c in ("least", "median", "best") else F.col(c) for c in read.columns))


@query(f"WITH {PREMISE_SQL} SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) AS place, pos, handle FROM work")
def premise_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.premise_members(premised(spark, sf_dir))


# --- histories ---------------------------------------------------------------------------------------------------------

REPLAYS = (500, 5000, 2**62)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as operations on a few hundred facts, many of them out of place."""
    e = views.table(spark, sf_dir, "events")
    n, day = F.col("event_id"), F.dayofmonth("ts")
    op = F.when(F.col("event_type").isin("view", "signup"), "ASSERT").when(F.col("event_type") == "click", "UPDATE").when(F.col("event_type") == "purchase", "INVALIDATE").when(n % 3 == 0, "RETCON").when(n % 3 == 1, "UPDATE").otherwise("FORGET")
    return e.select(
        n.alias("seq"),
        op.alias("op"),
        (F.col("user_id") * 4 + n % 4).alias("fact_id"),
        F.when(n % 5 != 0, F.regexp_extract("props", "([0-9]+)", 1)).alias("object_literal"),
        F.when(n % 7 != 0, day).alias("valid_from"),
        F.when(n % 2 == 0, day + (n % 6).cast("int")).alias("valid_to"),
        F.when(n % 4 != 0, F.col("value")).alias("confidence"),
    )


#: One operation of a fact after the other.
LOG_SQL = """log AS (
        SELECT event_id AS seq, CASE WHEN event_type IN ('view', 'signup') THEN 'ASSERT' WHEN event_type = 'click' THEN 'UPDATE' WHEN event_type = 'purchase' THEN 'INVALIDATE'
                WHEN event_id % 3 = 0 THEN 'RETCON' WHEN event_id % 3 = 1 THEN 'UPDATE' ELSE 'FORGET' END AS op, user_id * 4 + event_id % 4 AS fact_id,
            CASE WHEN event_id % 5 <> 0 THEN regexp_extract(props, '([0-9]+)', 1) END AS object_literal, CASE WHEN event_id % 7 <> 0 THEN day(ts) END AS valid_from,
            CASE WHEN event_id % 2 = 0 THEN day(ts) + event_id % 6 END AS valid_to, CASE WHEN event_id % 4 <> 0 THEN value END AS confidence FROM events),
    nth AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY seq) AS k FROM log),
    run(fact_id, k, seq, status, object_literal, valid_from, valid_to, confidence, superseded_seq, rejected) AS (
        SELECT DISTINCT fact_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), 'absent', CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT), CAST(0 AS BIGINT) FROM log
        UNION ALL SELECT r.fact_id, n.k, n.seq, CASE WHEN whole OR part THEN 'active' WHEN closes THEN 'invalidated' ELSE r.status END,
            CASE WHEN whole THEN n.object_literal WHEN part THEN coalesce(n.object_literal, r.object_literal) ELSE r.object_literal END,
            CASE WHEN whole THEN n.valid_from WHEN part THEN coalesce(n.valid_from, r.valid_from) ELSE r.valid_from END,
            CASE WHEN whole OR closes THEN n.valid_to WHEN part THEN coalesce(n.valid_to, r.valid_to) ELSE r.valid_to END,
            CASE WHEN whole THEN n.confidence WHEN part THEN coalesce(n.confidence, r.confidence) ELSE r.confidence END,
            CASE WHEN whole THEN NULL WHEN closes THEN n.seq ELSE r.superseded_seq END, r.rejected + CASE WHEN whole OR part OR closes THEN 0 ELSE 1 END
        FROM run r JOIN nth n ON n.fact_id = r.fact_id AND n.k = r.k + 1,
            LATERAL (SELECT (n.op = 'ASSERT' AND r.status = 'absent') OR (n.op = 'RETCON' AND r.status <> 'absent') AS whole, n.op = 'UPDATE' AND r.status = 'active' AS part,
                n.op = 'INVALIDATE' AND r.status = 'active' AS closes))"""


@query(f"""WITH RECURSIVE {LOG_SQL}
SELECT until, fact_id, status, object_literal, valid_from, valid_to, confidence, superseded_seq, rejected FROM (
    SELECT *, row_number() OVER (PARTITION BY until, fact_id ORDER BY k DESC) AS rn FROM run, (VALUES {", ".join(f"({n})" for n in REPLAYS)}) t(until) WHERE seq <= until AND k > 0) WHERE rn = 1""")
def event_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as the log leaves them after 500 operations, 5000, and all."""
    log = event_log(spark, sf_dir)
    at = [history.replay(log, n, 64).withColumn("until", F.lit(n).cast("long")) for n in REPLAYS]
    return at[0].unionByName(at[1]).unionByName(at[2])


@query("""WITH RECURSIVE planted AS (SELECT o_orderkey AS id, day(o_orderdate) AS planted_at FROM orders WHERE day(o_orderdate) <= 20),
    m AS (SELECT l_orderkey AS id, l_partkey * 10 + l_linenumber AS seq, day(l_shipdate) AS chapter, ['planted', 'triggered', 'paid_off', 'broken', 'sold'][l_suppkey % 5 + 1] AS "to", l_linenumber FROM lineitem),
    one AS (SELECT id, min(chapter) AS chapter, seq, any_value("to" ORDER BY "to") AS "to" FROM m GROUP BY id, seq),
    due AS (SELECT one.*, planted_at, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM one JOIN planted USING (id) WHERE chapter <= 20),
    run(id, k, state, n_illegal, first_illegal) AS (
        SELECT id, CAST(0 AS BIGINT), 'planted', CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM planted
        UNION ALL SELECT r.id, d.k, CASE WHEN ok THEN d."to" ELSE r.state END, r.n_illegal + CASE WHEN ok THEN 0 ELSE 1 END, coalesce(r.first_illegal, CASE WHEN NOT ok THEN d.seq END)
        FROM run r JOIN due d ON d.id = r.id AND d.k = r.k + 1,
            LATERAL (SELECT d.chapter >= d.planted_at AND (r.state, d."to") IN (('planted', 'triggered'), ('planted', 'broken'), ('triggered', 'paid_off'), ('triggered', 'broken')) AS ok))
SELECT id, state, state IN ('planted', 'triggered') AS open, CASE WHEN state IN ('planted', 'triggered') THEN 20 - planted_at END AS waits, k AS n_moves, n_illegal, first_illegal
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k DESC) AS rn FROM run) JOIN planted USING (id) WHERE rn = 1""")
def commitment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as commitments, their lines as moves in order of parts, as they stand at the twentieth chapter."""
    planted = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.dayofmonth("o_orderdate").alias("planted_at"))
    names = F.array(*(F.lit(s) for s in (*history.STATES, "sold")))
    line = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.dayofmonth("l_shipdate").alias("chapter"),
        F.element_at(names, (F.col("l_suppkey") % 5 + 1).cast("int")).alias("to"),
    )
    moves = line.groupBy("id", "seq").agg(F.min("chapter").alias("chapter"), F.min("to").alias("to"))
    return history.boundary_report(planted, moves, 20)


@query(f"""WITH {FACT_SQL}, f AS (SELECT id, fork_id, subject_id, predicate, coalesce(CAST(object_id AS VARCHAR), object_literal) AS says, id % 3 AS tier, (id * 7 % 10) / 10.0 AS confidence FROM fact),
    c AS (SELECT *, CASE WHEN confidence >= 0.2 THEN 'active' ELSE 'quarantined' END AS status FROM f),
    a AS (SELECT *, rank() OVER (PARTITION BY fork_id, subject_id, predicate ORDER BY tier, confidence DESC) AS r FROM c WHERE status = 'active'),
    t AS (SELECT fork_id, subject_id, predicate, min(says) AS lo, max(says) AS hi FROM a WHERE r = 1 GROUP BY ALL)
SELECT id, status, CASE WHEN lo <> hi AND r = 1 THEN 'quarantined' WHEN lo <> hi THEN 'outranked' WHEN says = lo THEN 'kept' ELSE 'outranked' END AS verdict FROM a JOIN t USING (fork_id, subject_id, predicate)
UNION ALL SELECT id, status, NULL FROM c WHERE status = 'quarantined'""")
def adjudicated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates through the gate of confidence, and what passes it by tier and confidence."""
    f = views.facts(spark, sf_dir)
    says = F.coalesce(F.col("object_id").cast("string"), F.col("object_literal"))
    rated = f.select("id", "fork_id", "subject_id", "predicate", says.alias("says"), (F.col("id") % 3).cast("int").alias("tier"), (F.col("id") * 7 % 10 / 10).alias("confidence"))
    gated = history.curate(rated, 0.2)
    judged = history.adjudicate(gated.where("status = 'active'"), ["fork_id", "subject_id", "predicate"])
    out = gated.where("status = 'quarantined'").withColumn("verdict", F.lit(None).cast("string"))
    return judged.select("id", "status", "verdict").unionByName(out.select("id", "status", "verdict"))


# --- a paged service ---------------------------------------------------------------------------------------------------

PAGE, REFUSED_PAGE = 20, 7


@query(f"""WITH m AS (SELECT doc_id, doc_id // {PAGE} AS page FROM documents WHERE lang = 'en' AND length(text) >= 1000),
one AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS k FROM m), first AS (SELECT * FROM one WHERE k <= 5), p1 AS (SELECT max(page) + 1 AS p FROM first),
second AS (SELECT m.* FROM m, p1 WHERE page >= p AND page < p + 3), third AS (SELECT m.* FROM m, p1 WHERE page >= p + 3 AND page < {REFUSED_PAGE})
SELECT 1 AS call, doc_id, p AS next_page, false AS cut_short FROM first, p1 UNION ALL SELECT 2, doc_id, p + 3, false FROM second, p1 UNION ALL SELECT 3, doc_id, {REFUSED_PAGE}, true FROM third""")
def paged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind a service with pages: a scan that stops at five matches, one that goes on to a ceiling of rows, and one
    that a refused page ends."""
    root = folder(spark, "pages")
    d = views.table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("row_index"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("lang").alias("label"), "text")
    paged.write_pages(rows, f"{root}/pages", PAGE)
    paged.refuse(f"{root}/pages", REFUSED_PAGE)
    paged.register(spark)
    out = None
    for call, (limit, most) in enumerate([(5, 2**40), (2**30, 3 * PAGE), (2**30, 2**40)], 1):
        found = paged.scan(spark, f"{root}/pages", f"{root}/state", F.length("text") >= 1000, limit, most, PAGE, label="en")
        told = found.matches.select(F.lit(call).alias("call"), F.col("id").cast("long").alias("doc_id"), F.lit(found.page).alias("next_page"), F.lit(found.cut_short).alias("cut_short"))
        out = told if out is None else out.unionByName(told)
    return out


# --- lanes, templates, SQL ---------------------------------------------------------------------------------------------

LANES = ("factual", "persona", "worldview")


@query("""WITH v AS (SELECT vec_id, ['factual', 'persona', 'worldview'][label % 3 + 1] AS lane, label + 1 <= 7 AND vec_id % 13 <> 0 AS seen, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT query_id, ref_id, CAST(rank AS INT) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS ref_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.e, q.e) DESC, v.vec_id) AS rank
    FROM v JOIN v q ON q.lane = v.lane WHERE q.vec_id % 50 = 0 AND v.seen) WHERE rank <= 5""")
def lane_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 50, each in its lane, through the cells that it has to look into."""
    v = views.vectors(spark, sf_dir).join(views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("fact_id"), "label"), "fact_id")
    lane = F.element_at(F.array(*(F.lit(x) for x in LANES)), (F.col("label") % 3 + 1).cast("int"))
    v = v.select(F.col("fact_id").alias("ref_id"), lane.alias("lane"), "vector", "status", "revealed_at", "knower_scope")
    asked = v.where("ref_id % 50 = 0").select(F.col("ref_id").alias("query_id"), "lane", F.col("vector").alias("query"))
    return lanes.search(lanes.index(v), asked, 5, is_visible("audience", 7)).select("query_id", "ref_id", "rank")


SCENE = """{# one turn, told to whoever speaks #}
{{ who | upper }} in chapter {{ chapter }}:
{% for fact in facts %}
- {{ fact.said }} ({{ fact.quote | trim | truncate(40) }})
{% else %}
(nothing yet)
{% endfor %}{% if options %}Next: {{ options | join("; ") }}.{% endif %}
"""


@query("""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+')) AS names FROM conversations),
    f AS (SELECT *, trim(text, chr(32) || chr(10)) AS quote FROM c),
    g AS (SELECT *, CASE WHEN length(quote) <= 45 THEN quote ELSE CASE WHEN contains(left(quote, 37), ' ') THEN regexp_replace(left(quote, 37), ' [^ ]*$', '', 's') ELSE left(quote, 37) END || '...' END AS short FROM f)
SELECT conv_id, turn, sha256(chr(10) || upper(role) || ' in chapter ' || (turn + 1) || ':' || chr(10) ||
    CASE WHEN text = '' THEN chr(10) || '(nothing yet)' || chr(10) ELSE chr(10) || '- turn ' || turn || ' (' || short || ')' || chr(10) END ||
    CASE WHEN len(names[1:3]) > 0 THEN 'Next: ' || array_to_string(list_sort(names)[1:3], '; ') || '.' ELSE '' END || chr(10)) AS digest FROM g""")
def rendered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene for every turn of the conversations."""
    c = views.table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    fact = F.struct(F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("said"), F.col("text").alias("quote"))
    names = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)))
    given = {
        "who": F.col("role"),
        "chapter": F.col("turn") + 1,
        "facts": F.when(F.col("text") != "", F.array(fact)).otherwise(F.array().cast("array<struct<said:string,quote:string>>")),
        "options": F.slice(F.sort_array(names), 1, 3),
    }
    return c.select("conv_id", "turn", F.sha2(template.render(SCENE, given), 256).alias("digest"))


@query(f"""WITH {FACT_SQL}, {LINEAGE_SQL}, {RESOLVED_SQL}, grand AS (SELECT * FROM resolved WHERE root = 'grand'),
e AS (SELECT DISTINCT subject_id AS src, object_id AS dst FROM grand WHERE object_id IS NOT NULL AND {seen_sql("'k1'", "12")} AND {valid_sql("12")}),
live AS (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate ORDER BY (status <> 'invalidated') DESC, valid_from DESC, recorded_at DESC, id DESC) AS rn FROM grand WHERE status <> 'quarantined' AND {valid_sql("15")})
SELECT 'as_of' AS kind, count(*) AS n, sum(id) AS ids FROM live WHERE rn = 1
UNION ALL SELECT 'epistemic', count(*), sum(id) FROM grand WHERE {seen_sql("'k1'", "12")} UNION ALL SELECT 'spoilers', count(*), sum(id) FROM grand WHERE NOT {seen_sql("'k1'", "12")}
UNION ALL SELECT 'attribute', count(*), sum(id) FROM live WHERE rn = 1 AND subject_id = 7 AND predicate = 'view'
UNION ALL SELECT 'reach', count(*), sum(dst) FROM (SELECT dst FROM e WHERE src = 7 UNION SELECT b.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.src = 7)
UNION ALL SELECT 'commitments', count(*), sum(o_orderkey) FROM orders WHERE day(o_orderdate) <= 12 AND o_orderstatus <> 'F'""")
def routed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of question through the SQL functions of a session."""
    state = F.when(F.col("o_orderstatus") == "O", "planted").when(F.col("o_orderstatus") == "F", "paid_off").otherwise("triggered")
    due = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), state.alias("state"), F.dayofmonth("o_orderdate").alias("planted_at"))
    surface.register(spark, views.facts(spark, sf_dir), views.forks(spark), due)
    ask = lambda kind, of="id", **p: surface.route(spark, kind, **p).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum(of).alias("ids"))
    guard = {"fork": "grand", "knower": "k1", "chapter": 12}
    out = ask("as_of", fork="grand", chapter=15).unionByName(ask("epistemic", **guard)).unionByName(ask("spoilers", **guard))
    out = out.unionByName(ask("attribute", fork="grand", chapter=15, subject=7, predicate="view")).unionByName(ask("reach", "node", **guard, start=7, hops=2))
    return out.unionByName(ask("commitments", chapter=12))


# --- stores, options, cuts ---------------------------------------------------------------------------------------------


@query(f"""WITH {FACT_SQL} SELECT 'stored' AS kind, count(*) AS n, sum(id) AS ids FROM fact WHERE id % 5 < 4 OR id % 3 = 0
UNION ALL SELECT 'refused', count(*), sum(id) FROM fact WHERE id % 5 < 4 AND id % 3 = 0""")
def facts_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts appended to a snapshot that has some of them: what is stored then, and what came back."""
    path = folder(spark, "appended")
    f = views.facts(spark, sf_dir)
    tables.write_facts(f.where("id % 5 < 4"), path)
    refused = written(tables.append_facts(f.where("id % 3 = 0"), path), "refused")
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum("id").alias("ids"))
    return count(tables.read_facts(spark, path), "stored").unionByName(count(refused, "refused"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'moved' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT c_custkey + 1000000000, 'moved' FROM customer WHERE c_custkey % 4 = 0")
def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that replace others by key, and rows with a key of their own."""
    c = views.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    new = c.where("c_custkey % 4 = 0").select("c_custkey", F.lit("moved").alias("c_mktsegment"))
    return tables.upsert(c, new.unionByName(new.withColumn("c_custkey", F.col("c_custkey") + 1000000000)), "c_custkey")


@query("SELECT user_id, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type FROM events WHERE event_id % 7 <> 0 GROUP BY user_id")
def jsonl_last_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines in two appended batches with broken lines among them; of each user the last good line."""
    path = folder(spark, "lines")
    e = views.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), "event_type")
    line = F.when(F.col("seq") % 7 == 0, F.concat(F.lit('{"user_id": '), F.col("user_id").cast("string"))).otherwise(F.to_json(F.struct("user_id", "seq", "event_type")))
    for odd in (0, 1):
        e.where(F.col("seq") % 2 == odd).select(line.alias("value")).write.mode("append").text(path)
    return tables.read_jsonl(spark, path, e.schema, "user_id", "seq")


@query("""SELECT p_type || ':' || CASE WHEN p_partkey % 3 = 0 THEN 'canon' ELSE 'alt' || p_partkey END AS option_id, p_name AS label, p_partkey % 3 = 0 AND p_partkey % 2 = 0 AS baseline FROM part WHERE p_size = 7""")
def chapter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts read as authored options of chapters: those of the seventh, and which of them is the story as it was told."""
    p = views.table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    name = F.concat(F.col("p_type"), F.lit(":"), F.when(n % 3 == 0, "canon").otherwise(F.concat(F.lit("alt"), n.cast("string"))))
    # the secret holds the work that an option comes from, where it comes from one
    rows = p.select(F.col("p_size").alias("chapter"), n.alias("pos"), name.alias("option_id"), F.col("p_name").alias("label"), F.when(n % 2 == 1, n.cast("string")).alias("secret"))
    found = knowledge.options_at(knowledge.options_per_chapter(rows), 7)
    return found.select("option_id", "label", knowledge.is_canon_baseline(F.col("option_id"), F.col("secret")).alias("baseline"))


@query(r"""WITH d AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS flat, left(text, 60) AS head FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, length(head) - strpos(reverse(head), ' ') AS stop FROM d)
SELECT doc_id, sha256(CASE WHEN length(text) <= 40 THEN text ELSE left(text, 37) || '...' END) AS cut, sha256(CASE WHEN length(flat) <= 50 THEN flat ELSE left(flat, 49) || '…' END) AS clipped,
    sha256(CASE WHEN length(text) <= 60 THEN text ELSE rtrim(CASE WHEN contains(head, ' ') AND stop > 30 THEN left(head, stop) ELSE head END) || '…' END) AS at_word FROM c""")
def text_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts cut in three ways."""
    d = views.table(spark, sf_dir, "documents").where("text is not null")
    t = F.col("text")
    return d.select("doc_id", F.sha2(text.truncate(t, 40), 256).alias("cut"), F.sha2(text.clip(t, 50), 256).alias("clipped"), F.sha2(text.truncate_at_word(t, 60), 256).alias("at_word"))
