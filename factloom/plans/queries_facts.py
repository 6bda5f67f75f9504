"""Queries over facts, forks, knowledge, graphs and play."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import guard
from factloom.operators import graph, knowledge, lineage, temporal
from factloom.plans import views
from factloom.plans.registry import query
from factloom.plans.views import FACT_SQL, FORK_SQL, LINEAGE_SQL, RESOLVED_SQL, seen_sql, valid_sql
from factloom.sources import shared, tables

SEEN = seen_sql("'k1'", "12")
ALL = f"WITH {FACT_SQL}, {LINEAGE_SQL}, {RESOLVED_SQL}"


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.resolved(views.facts(spark, sf_dir), lineage.lineage(spark, views.forks(spark)))


@query(f"WITH {FACT_SQL} SELECT id, subject_id, predicate FROM fact WHERE {SEEN}")
def visible_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.facts(spark, sf_dir).where(guard.is_visible("k1", 12)).select("id", "subject_id", "predicate")


@query(f"WITH {FACT_SQL} SELECT id, subject_id, predicate FROM fact WHERE NOT {SEEN}")
def withheld_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.facts(spark, sf_dir).where(~guard.is_visible("k1", 12)).select("id", "subject_id", "predicate")


@query(f"""WITH {FACT_SQL}, k(knower) AS (VALUES ('audience'), ('k1'), ('k3'), ('nobody')), c(chapter) AS (VALUES (0), (1), (2), (3), (4), (5), (10), (100))
SELECT knower, chapter, count(*) FILTER (WHERE {seen_sql("knower", "chapter")}) AS visible, count(*) FILTER (WHERE NOT {seen_sql("knower", "chapter")}) AS withheld
FROM fact, k, c GROUP BY knower, chapter""")
def guard_grid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard over a grid of cutoffs: all cells in one pass, a row of arrays per fact instead of a join."""
    cells = F.array(*(F.struct(F.lit(k).alias("knower"), F.lit(c).alias("chapter"), guard.is_visible(k, c).alias("seen")) for k in ("audience", "k1", "k3", "nobody") for c in (0, 1, 2, 3, 4, 5, 10, 100)))
    cell = views.facts(spark, sf_dir).select(F.explode(cells).alias("x")).select("x.*")
    return cell.groupBy("knower", "chapter").agg(F.count_if("seen").alias("visible"), F.count_if(~F.col("seen")).alias("withheld"))


@query(f"""WITH {FACT_SQL} SELECT id, CASE WHEN NOT tracked THEN revealed_at WHEN own_knower = 'k2' THEN own_at END AS learned_at,
    coalesce(revealed_at < valid_from, false) AS foreshadowed, {valid_sql("10")} AS valid_at_10, coalesce(revealed_at <= 10, false) AS revealed_by_10,
    coalesce(CASE WHEN NOT tracked THEN revealed_at WHEN own_knower = 'k2' THEN own_at END <= 10, false) AS known_by_10 FROM fact""")
def knowledge_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.facts(spark, sf_dir).select("id", guard.learned_at("k2").alias("learned_at"), guard.is_foreshadowed().alias("foreshadowed"), guard.is_valid_at(10).alias("valid_at_10"), guard.is_revealed_by(10).alias("revealed_by_10"), guard.is_known_by("k2", 10).alias("known_by_10"))


@query(f"""WITH RECURSIVE {FORK_SQL}, walk(root, ancestor, parent, cap, next_cap, depth) AS (
    SELECT id, id, parent, CAST(NULL AS INT), cut, 0 FROM fork
    UNION ALL SELECT w.root, w.parent, f.parent, w.next_cap, least(w.next_cap, f.cut), w.depth + 1 FROM walk w LEFT JOIN fork f ON f.id = w.parent WHERE w.parent IS NOT NULL)
SELECT root, ancestor, cap, depth FROM walk""")
def fork_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.lineage(spark, views.forks(spark))


@query(f"{ALL} SELECT root, id, depth FROM resolved")
def resolved_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).select("root", "id", "depth")


@query(f"{ALL} SELECT id, row_number() OVER (ORDER BY depth, recorded_at, id) AS place FROM resolved WHERE root = 'grand' ORDER BY place LIMIT 100")
def canon_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred facts of a fork as a reader gets them."""
    head = lineage.in_order(resolved(spark, sf_dir).where("root = 'grand'")).limit(100)
    place = F.row_number().over(Window.orderBy("depth", "recorded_at", "id"))
    return head.select("id", place.cast("long").alias("place"))


@query(f"WITH {FACT_SQL} SELECT fork_id, count(*) AS n, max(id) AS last FROM fact GROUP BY fork_id UNION ALL SELECT 'by key', count(*), max(id) FROM fact WHERE subject_id = 7")
def snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts written as a snapshot, read back per fork and by key."""
    path = shared.folder(spark, "snapshot")
    tables.write_facts(views.facts(spark, sf_dir), path)
    by = lambda df, name: df.groupBy(name.alias("fork_id")).agg(F.count("*").alias("n"), F.max("id").alias("last"))
    keyed = tables.get(tables.read_facts(spark, path), "subject_id", 7)
    return by(tables.read_facts(spark, path), F.col("fork_id")).unionByName(by(keyed, F.lit("by key")))


AS_OF_ORDER = "ORDER BY (status <> 'invalidated') DESC, valid_from DESC, recorded_at DESC, id DESC"


@query(f"""{ALL} SELECT root, subject_id, predicate, id, status FROM (SELECT *, row_number() OVER (PARTITION BY root, subject_id, predicate {AS_OF_ORDER}) AS rn
    FROM resolved WHERE status <> 'quarantined' AND {valid_sql("15")}) WHERE rn = 1""")
def as_of_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.as_of(resolved(spark, sf_dir), 15).select("root", "subject_id", "predicate", "id", "status")


@query(f"""{ALL}, probe AS (SELECT DISTINCT root, subject_id, predicate, chapter FROM resolved, (VALUES (5), (10), (20)) t(chapter))
SELECT root, subject_id, predicate, chapter, id FROM (SELECT p.*, r.id, row_number() OVER (PARTITION BY p.root, p.subject_id, p.predicate, chapter {AS_OF_ORDER}) AS rn
    FROM probe p JOIN resolved r USING (root, subject_id, predicate) WHERE status <> 'quarantined' AND {valid_sql("chapter")}) WHERE rn = 1""")
def as_of_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolved(spark, sf_dir)
    probes = r.select("root", "subject_id", "predicate").distinct().select("*", F.explode(F.array(F.lit(5), F.lit(10), F.lit(20))).alias("chapter"))
    return temporal.as_of_probe(r, probes)


@query(f"""{ALL}, probe AS (SELECT DISTINCT root, subject_id, predicate, chapter FROM resolved, range(32) t(chapter))
SELECT root, subject_id, predicate, chapter, id FROM (SELECT p.*, r.id, row_number() OVER (PARTITION BY p.root, p.subject_id, p.predicate, chapter {AS_OF_ORDER}) AS rn
    FROM probe p JOIN resolved r USING (root, subject_id, predicate) WHERE status <> 'quarantined' AND {valid_sql("chapter")}) WHERE rn = 1""")
def as_of_every_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key at every chapter of a month, by pieces of story time."""
    r = resolved(spark, sf_dir)
    probes = r.select("root", "subject_id", "predicate").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("chapter"))
    return temporal.as_of_ranges(r, probes).select("root", "subject_id", "predicate", F.col("chapter").cast("long").alias("chapter"), "id")


@query(f"""WITH {FACT_SQL}, live AS (SELECT * FROM fact WHERE status = 'active' AND {valid_sql("10")})
SELECT fork_id, subject_id, predicate, a.id AS first, b.id AS second FROM live a JOIN live b USING (fork_id, subject_id, predicate)
WHERE a.id < b.id AND NOT (a.object_id IS NOT DISTINCT FROM b.object_id AND a.object_literal IS NOT DISTINCT FROM b.object_literal)""")
def conflicting_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.conflicts(views.facts(spark, sf_dir), 10)


@query(f"WITH {FACT_SQL} SELECT u.event_id AS pos, f.id FROM events u JOIN fact f ON f.id = u.event_id + 5 WHERE NOT {seen_sql("'k1'", '6')}")
def epistemic_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), (F.col("event_id") + 5).alias("id"))
    return temporal.epistemic_violations(used, views.facts(spark, sf_dir), "k1", 6)


@query(f"""WITH {FACT_SQL} SELECT id, 'attribution' AS rule FROM fact WHERE (assertion_mode = 'attributed') <> (attributed_to IS NOT NULL)
UNION ALL SELECT id, 'one object' FROM fact WHERE (object_id IS NULL) = (object_literal IS NULL)
UNION ALL SELECT id, 'validity order' FROM fact WHERE valid_to < valid_from UNION ALL SELECT id, 'span forward' FROM fact WHERE length(quote) <= 0""")
def fact_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.audit(views.facts(spark, sf_dir))


@query("""SELECT conv_id AS a, turn AS b, 'roster unique' AS rule FROM conversations WHERE conv_id % 5 = 0
UNION ALL SELECT conv_id, NULL, 'episodes contiguous' FROM conversations WHERE turn <> 2 GROUP BY conv_id HAVING min(turn) <> 0 OR max(turn) + 1 <> count(*) OR count(DISTINCT turn) <> count(*)
UNION ALL SELECT conv_id, turn, 'playable choices' FROM conversations WHERE (conv_id + turn) % 6 IN (0, 1, 5)
UNION ALL SELECT event_id, NULL, 'hard flag cites' FROM events WHERE event_type = 'error' AND event_id % 3 < 2
UNION ALL SELECT n_nationkey, NULL, 'divergence matches parent' FROM nation WHERE (n_nationkey % 2 = 0) <> (n_nationkey % 3 = 0)""")
def model_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules about rosters, series, choices, flags and forks, each broken by a known part of the rows."""
    c = views.table(spark, sf_dir, "conversations")
    out = lambda df, a, b=None: df.select(F.col(a).cast("long").alias("a"), (F.col(b) if b else F.lit(None)).cast("long").alias("b"), "rule")
    again = F.when(F.col("conv_id") % 5 == 0, F.slice("roster", 1, 1)).otherwise(F.slice("roster", 1, 0))
    rosters = temporal.audit_rosters(views.scenes(spark, sf_dir).withColumn("roster", F.concat("roster", again)), ["conv_id", "turn"])
    series = temporal.audit_episodes(c.where("turn <> 2").select(F.col("conv_id").alias("series_id"), (F.col("turn") + 1).alias("number")))
    k = (F.col("conv_id") + F.col("turn")) % 6
    # none, one, two, three, four different choices, or the same one twice
    offer = F.when(k == 5, F.array(F.lit("a"), F.lit("a"))).otherwise(F.slice(F.array(*(F.lit(x) for x in "abcd")), F.lit(1), k.cast("int")))
    turns = temporal.audit_turns(c.select(F.struct("conv_id", "turn").alias("id"), offer.alias("choices"))).select("id.conv_id", "id.turn", "rule")
    e = views.table(spark, sf_dir, "events")
    n = F.col("event_id") % 3
    cited = F.when(n == 0, F.array().cast("array<long>")).when(n == 2, F.array("event_id"))
    flags = temporal.audit_flags(e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "hard").otherwise("soft").alias("severity"), cited.alias("fact_ids")))
    nation = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    forks = temporal.audit_forks(nation.select(F.col("k").alias("id"), F.when(F.col("k") % 2 == 0, "p").alias("parent_fork_id"), F.when(F.col("k") % 3 == 0, 1).alias("divergence_at")))
    return out(rosters, "conv_id", "turn").unionByName(out(series, "series_id")).unionByName(out(turns, "conv_id", "turn")).unionByName(out(flags, "id")).unionByName(out(forks, "id"))


@query(f"""WITH {FACT_SQL} SELECT id, CASE WHEN id % 7 = 0 AND status = 'active' THEN 'invalidated' ELSE status END AS status, valid_from,
    CASE WHEN id % 7 = 0 AND status = 'active' THEN valid_from + 1 ELSE valid_to END AS valid_to FROM fact
UNION ALL SELECT id + 100000000, 'active', valid_from + 1, NULL FROM fact WHERE id % 7 = 0 AND status = 'active'""")
def supersede_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh fact gets a successor; commands against facts that are not active are rejected."""
    f = views.facts(spark, sf_dir)
    new = {"id": F.col("id") + 100000000, "object_id": F.lit(None).cast("long"), "object_literal": F.lit("new"), "valid_from": F.col("valid_from") + 1, "valid_to": F.lit(None).cast("int"), "status": F.lit("active"), "superseded_at": F.lit(None).cast("timestamp_ntz")}
    commands = f.where("id % 7 = 0").select(F.col("id").alias("old_id"), F.struct(*(new.get(c, F.col(c)).alias(c) for c in f.columns)).alias("replacement"), (F.col("valid_from") + 1).alias("closes_at"), F.col("recorded_at").alias("at"))
    after, _ = temporal.supersede(f, commands)
    return after.select("id", "status", "valid_from", "valid_to")


@query(f"""WITH {FACT_SQL}, c AS (SELECT *, id % 7 AS kind FROM fact WHERE id % 7 < 6)
SELECT CASE WHEN kind = 0 THEN id + 500000000 ELSE id END AS old_id, CASE kind WHEN 0 THEN 'missing' WHEN 1 THEN 'named twice' ELSE CASE WHEN status <> 'active' THEN 'not active'
    WHEN kind = 2 THEN 'other fork' WHEN kind = 3 THEN 'itself' WHEN kind = 4 THEN 'closes before it starts' END END AS reason
FROM c, range(CASE WHEN kind = 1 THEN 2 ELSE 1 END) t(x) WHERE kind < 5 OR status <> 'active'""")
def supersede_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of six kinds: a missing target, one named twice, another fork, the target itself, a close before the start,
    and sound ones, which fail where the target is not active."""
    f = views.facts(spark, sf_dir)
    kind = F.col("id") % 7
    new = {"id": F.when(kind == 3, F.col("id")).otherwise(F.col("id") + 100000000), "fork_id": F.when(kind == 2, "elsewhere").otherwise(F.col("fork_id"))}
    replacement = F.struct(*(new.get(c, F.col(c)).alias(c) for c in f.columns)).alias("replacement")
    old = F.when(kind == 0, F.col("id") + 500000000).otherwise(F.col("id")).alias("old_id")
    close = (F.col("valid_from") + F.when(kind == 4, -1).otherwise(1)).alias("closes_at")
    commands = f.where(kind < 6).select(kind.alias("kind"), old, replacement, close, F.col("recorded_at").alias("at"))
    commands = commands.unionByName(commands.where("kind = 1")).drop("kind")
    return temporal.supersede(f, commands)[1]


AWARE = "aware AS (SELECT id AS fact_id, own_knower AS knower, own_at AS learned_at FROM fact WHERE tracked UNION ALL SELECT id, 'audience', revealed_at FROM fact WHERE tracked AND revealed_at IS NOT NULL)"
TOLD = "told AS (SELECT id AS fact_id, 'k' || (id % 5) AS knower, CAST(valid_from + id % 3 AS INT) AS learned_at FROM fact)"


def told_rows(f: DataFrame) -> DataFrame:
    return f.select(F.col("id").alias("fact_id"), F.concat(F.lit("k"), (F.col("id") % 5).cast("string")).alias("knower"), (F.col("valid_from") + F.col("id") % 3).cast("int").alias("learned_at"))


@query(f"WITH {FACT_SQL}, {AWARE}, {TOLD} SELECT fact_id, knower, min(learned_at) AS learned_at FROM (FROM aware UNION ALL FROM told) GROUP BY ALL")
def awareness_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.facts(spark, sf_dir)
    return knowledge.merge_awareness(knowledge.awareness_of(f), told_rows(f))


@query(f"WITH {FACT_SQL}, {AWARE} SELECT fact_id, string_agg(knower || '@' || learned_at, ',' ORDER BY knower) AS scope FROM (SELECT fact_id, knower, min(learned_at) AS learned_at FROM aware GROUP BY ALL) GROUP BY fact_id")
def awareness_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = knowledge.scope_of(knowledge.merge_awareness(knowledge.awareness_of(views.facts(spark, sf_dir))))
    return scopes.select("fact_id", F.array_join(F.transform("knower_scope", lambda a: F.concat_ws("@", a["knower"], a["learned_at"].cast("string"))), ",").alias("scope"))


@query(f"""WITH {FACT_SQL}, {AWARE}, staged AS (SELECT conv_id * 10 + turn AS fact_id, CAST(turn + 1 AS INT) AS chapter, conv_id, role FROM conversations),
seen AS (SELECT fact_id, 'p' || (conv_id % 7) AS knower, chapter FROM staged WHERE role IN ('user', 'assistant') UNION ALL SELECT fact_id, 'p' || ((conv_id + 1) % 7), chapter FROM staged)
SELECT fact_id, knower, min(learned_at) AS learned_at FROM (FROM aware UNION ALL SELECT s.* FROM seen s JOIN fact f ON f.id = s.fact_id WHERE tracked) GROUP BY ALL""")
def witness_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = views.scenes(spark, sf_dir).select((F.col("conv_id") * 10 + F.col("turn")).alias("fact_id"), "chapter", "roster")
    return knowledge.witnesses_learn(views.facts(spark, sf_dir), staged)


@query(f"WITH {FACT_SQL}, {TOLD} SELECT t.fact_id, knower, 'not tracked' AS rule FROM told t JOIN fact f ON f.id = t.fact_id WHERE NOT tracked")
def told_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.facts(spark, sf_dir)
    return knowledge.told(f, told_rows(f))[1].select("fact_id", "knower", "rule")


@query(f"WITH {FACT_SQL} SELECT id, CASE WHEN tracked THEN own_at ELSE valid_from END AS first_at FROM fact")
def start_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.facts(spark, sf_dir)
    scopes = f.select(F.col("id").alias("fact_id"), F.array(F.struct(F.lit("k9").alias("knower"), F.col("valid_from").alias("learned_at"))).alias("scope"))
    out, _ = knowledge.start_tracking(f, scopes)
    return out.select("id", F.get("knower_scope", F.lit(0))["learned_at"].alias("first_at"))


@query(f"WITH {FACT_SQL} SELECT id AS fact_id, CASE WHEN NOT tracked THEN 'not tracked' WHEN id % 2 = 0 THEN 'ok' ELSE 'not monotonic' END AS verdict FROM fact")
def record_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.facts(spark, sf_dir)
    more = F.concat("knower_scope", F.array(F.struct(F.lit("z").alias("knower"), F.lit(1).alias("learned_at"))))
    later = F.transform("knower_scope", lambda a: F.struct(a["knower"].alias("knower"), (a["learned_at"] + 1).alias("learned_at")))
    return knowledge.record_learning(f, f.select(F.col("id").alias("fact_id"), F.when(F.col("id") % 2 == 0, more).otherwise(later).alias("scope")))


PROBES = [(r, k, 10, [7, 11]) for r in ("canon", "child", "grand", "side") for k in ("audience", "k1", "k4")]
PACKET_SQL = f"""{ALL}, probe(root, knower, chapter, focus) AS (VALUES {", ".join(str(p) for p in PROBES)}),
    hit AS (SELECT p.knower, p.chapter, p.focus, r.*, {seen_sql("p.knower", "p.chapter")} AS seen FROM probe p JOIN resolved r USING (root)),
    packet AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root, knower, chapter ORDER BY NOT (list_contains(focus, subject_id) OR coalesce(list_contains(focus, object_id), false)), depth, recorded_at, id) AS rank FROM hit WHERE seen AND {valid_sql("chapter")}) WHERE rank <= 40),
    hidden AS (SELECT root, knower, chapter, count(*) FILTER (WHERE NOT seen) AS withheld FROM hit GROUP BY ALL)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.packets(resolved(spark, sf_dir), spark.createDataFrame(PROBES, "root string, knower string, chapter int, focus array<long>"))


@query(f"{PACKET_SQL} SELECT root, knower, chapter, CAST(rank AS INT) AS rank, id, withheld FROM packet JOIN hidden USING (root, knower, chapter)")
def memory_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir)


@query(f"{PACKET_SQL} SELECT root, knower, chapter, CAST(rank AS INT) AS rank, id, 'events' AS source_id, valid_from AS cited_chapter, quote FROM packet WHERE rank <= 3")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.citations(packets(spark, sf_dir), views.facts(spark, sf_dir))


@query(f"""{PACKET_SQL}, actor AS (SELECT rank AS pos, id, trim(subject_id || ' ' || replace(predicate, '_', ' ') || ' ' || coalesce(nullif(object_literal, ''), CAST(object_id AS VARCHAR), '')) AS text FROM packet WHERE root = 'canon' AND knower = 'k1'),
    people(who) AS (VALUES ('k0'), ('k2'), ('k3')),
    lack AS (SELECT who, pos, text FROM actor, people WHERE NOT EXISTS (SELECT 1 FROM resolved r WHERE r.root = 'canon' AND r.id = actor.id AND {seen_sql("who", "10")}))
SELECT who AS character, count(pos) AS missing, (SELECT count(*) FROM actor) AS total,
    CAST(coalesce(least(5, round_even(5.0 * count(pos) / nullif((SELECT count(*) FROM actor), 0), 0)), 0) AS INT) AS tension,
    coalesce(string_agg(text, ' | ' ORDER BY pos) FILTER (WHERE rn <= 3), '') AS blind_spots
FROM people LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY who ORDER BY pos) AS rn FROM lack) USING (who) GROUP BY who""")
def directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolved(spark, sf_dir).where("root = 'canon'")
    probe = spark.createDataFrame([("canon", "k1", 10, [7, 11])], "root string, knower string, chapter int, focus array<long>")
    text = knowledge.describe(F.col("subject_id"), F.col("predicate"), F.col("object_literal"), F.col("object_id"))
    people = ("k0", "k2", "k3")
    # the packet is forty rows; what they say and who sees them comes from one join with the facts
    packet = knowledge.packets(r, probe).select(F.col("rank").alias("pos"), "id")
    told = r.select("id", text.alias("text"), F.array(*(F.when(guard.is_visible(k, 10), k) for k in people)).alias("seen")).join(F.broadcast(packet), "id")
    cast = spark.createDataFrame([(k,) for k in people], "character string")
    seen = told.select("id", F.explode("seen").alias("character")).where("character is not null")
    out = knowledge.directives(told.select("pos", "id", "text"), cast, seen)
    return out.withColumn("blind_spots", F.array_join("blind_spots", " | "))


EDGES = "SELECT id AS fact_id, subject_id AS src, predicate AS label, object_id AS dst FROM fact WHERE object_id IS NOT NULL AND {} AND {}"


@query(f"WITH {FACT_SQL} " + EDGES.format(seen_sql("'k1'", "10"), valid_sql("10")))
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(views.facts(spark, sf_dir), "k1", 10)


@query(f"WITH {FACT_SQL}, e AS ({EDGES.format(seen_sql("'audience'", '10'), valid_sql('10'))}) SELECT * FROM e WHERE src = 7")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(graph.edges(views.facts(spark, sf_dir), "audience", 10), 7)


@query(f"""WITH RECURSIVE {FACT_SQL}, e AS ({EDGES.format(seen_sql("'audience'", '10'), valid_sql('10'))}), step AS (SELECT DISTINCT src, dst FROM e),
walk(start, node, n) AS (SELECT s, s, 0 FROM (VALUES (7), (11)) t(s) UNION SELECT start, dst, n + 1 FROM walk JOIN step ON src = node WHERE n < 3)
SELECT DISTINCT CAST(start AS BIGINT) AS start, CAST(node AS BIGINT) AS node FROM walk WHERE n > 0""")
def khop_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = spark.createDataFrame([(7,), (11,)], "start long")
    return graph.reach(graph.edges(views.facts(spark, sf_dir), "audience", 10), starts, 3)


@query(f"""WITH {FACT_SQL}, a AS ({EDGES.format(seen_sql("'k1'", '10'), valid_sql('10'))}), b AS ({EDGES.format(seen_sql("'k2'", '10'), valid_sql('10'))})
SELECT fact_id, 'left' AS side FROM a WHERE fact_id NOT IN (SELECT fact_id FROM b) UNION ALL SELECT fact_id, 'right' FROM b WHERE fact_id NOT IN (SELECT fact_id FROM a)""")
def graph_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.facts(spark, sf_dir)
    return graph.difference(graph.edges(f, "k1", 10), graph.edges(f, "k2", 10))


@query(f"""{ALL}, a AS (SELECT id FROM resolved WHERE root = 'canon'), b AS (SELECT id FROM resolved WHERE root = 'child')
SELECT coalesce(a.id, b.id) AS fact_id, CASE WHEN b.id IS NULL THEN 'invalidated' WHEN a.id IS NULL THEN 'new' ELSE 'held' END AS effect FROM a FULL JOIN b ON a.id = b.id""")
def fork_ripple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What taking a fork does to the main line's facts."""
    r = resolved(spark, sf_dir)
    of = lambda root: r.where(F.col("root") == root).select(F.col("id").alias("fact_id"))
    return graph.ripple(of("canon"), of("child"))


STATES = ("planted", "triggered", "paid_off", "broken")
STATE = lambda x: "CASE " + " ".join(f"WHEN {x} = {n} THEN '{s}'" for n, s in enumerate(STATES)) + " END"


@query(f"""WITH s AS (SELECT event_id AS id, {STATE("event_id % 4")} AS state, {STATE("event_id // 4 % 4")} AS "to" FROM events)
SELECT id, state, "to", (state, "to") IN (('planted', 'triggered'), ('planted', 'broken'), ('triggered', 'paid_off'), ('triggered', 'broken')) AS allowed, state IN ('planted', 'triggered') AS open FROM s""")
def commitment_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda n: F.element_at(F.array(*(F.lit(s) for s in STATES)), (n + 1).cast("int"))
    e = F.col("event_id")
    s = views.table(spark, sf_dir, "events").select(e.alias("id"), pick(e % 4).alias("state"), pick(F.floor(e / 4) % 4).alias("to"))
    return knowledge.moves(s).withColumn("open", guard.is_open(F.col("state")))


@query("SELECT 'p' || ((conv_id + k) % 7) AS entity_id, count(*) AS scenes FROM conversations, (VALUES (0), (1)) t(k) WHERE k = 1 OR role IN ('user', 'assistant') GROUP BY 1")
def scene_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scenes(spark, sf_dir).select(F.explode(guard.witnesses(F.col("roster"))).alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("scenes"))


@query("SELECT c_custkey AS id, c_mktsegment AS status FROM customer WHERE c_custkey % 4 = 0 AND c_custkey IN (SELECT o_custkey FROM orders)")
def incapacitated_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who act (order) though their state (every fourth is imprisoned) forbids it."""
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"), F.when(F.col("c_custkey") % 4 == 0, "imprisoned").otherwise("alive").alias("state"))
    acting = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return c.where(guard.is_incapacitated(F.col("state"))).join(acting, "id", "left_semi").select("id", "status")


CHOICE_SQL = """offered AS (SELECT conv_id * 100 + turn AS turn_id, conv_id, turn, role, option_id FROM conversations, (VALUES ('a'), ('b')) o(option_id)),
    taken AS (SELECT conv_id * 100 + turn AS turn_id, CASE WHEN turn % 3 = 2 THEN 'z' WHEN conv_id % 2 = 0 THEN 'a' ELSE 'b' END AS option_id, CAST(turn + 1 AS INT) AS chapter FROM conversations)"""


def choices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = views.scenes(spark, sf_dir).withColumn("turn_id", F.col("conv_id") * 100 + F.col("turn"))
    offered = s.select(F.col("turn_id").alias("turn"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("option_id"), F.col("conv_id").alias("subject_id"), F.lit("did").alias("predicate"), F.lit("it").alias("object_literal"), "roster", (F.col("turn") % 2 == 0).alias("secret"), F.array("turn_id").alias("discloses"))
    pick = F.when(F.col("turn") % 3 == 2, "z").when(F.col("conv_id") % 2 == 0, "a").otherwise("b")
    return offered, s.select(F.col("turn_id"), pick.alias("option_id"), "chapter").withColumnRenamed("turn_id", "turn")


@query(f"""WITH {CHOICE_SQL} SELECT turn_id AS turn, option_id, conv_id AS subject_id, CASE WHEN turn % 2 = 1 THEN chapter END AS revealed_at,
    CASE WHEN turn % 2 = 0 THEN CASE WHEN role IN ('user', 'assistant') THEN 2 ELSE 1 END END AS knowers FROM taken JOIN offered USING (turn_id, option_id)""")
def choice_consequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, _, _ = knowledge.apply_choices(*choices(spark, sf_dir))
    return new.select("turn", "option_id", "subject_id", "revealed_at", F.when(F.col("knower_scope").isNotNull(), F.size("knower_scope")).alias("knowers"))


@query(f"WITH {CHOICE_SQL} SELECT turn_id AS turn, option_id, 'not offered' AS rule FROM taken WHERE option_id = 'z'")
def choice_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.apply_choices(*choices(spark, sf_dir))[2].select("turn", "option_id", "rule")


@query("SELECT conv_id AS play_id, count(*) AS depth, count(*) >= 10 AS complete FROM conversations GROUP BY conv_id")
def playthrough_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.playthroughs(views.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("play_id"), "turn"))


@query(f"""{ALL}, probe AS (SELECT DISTINCT CAST(turn + 1 AS INT) AS chapter, knower FROM conversations, (VALUES ('k0'), ('k3'), ('audience')) t(knower))
SELECT p.chapter, p.knower, count(*) FILTER (WHERE {seen_sql("p.knower", "p.chapter")} AND {valid_sql("p.chapter")}) AS visible FROM probe p, resolved WHERE root = 'canon' GROUP BY ALL""")
def replay_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chapters replayed by several characters: each fact is looked at once, whatever the number of chapters."""
    facts = resolved(spark, sf_dir).where("root = 'canon'")
    return knowledge.replay(facts, ["k0", "k3", "audience"], views.scenes(spark, sf_dir).select("chapter"))


@query("SELECT CAST(conv_id AS VARCHAR) AS series_id, turn AS seq FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3")
def episode_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three of each series: ranks are cut per partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("seq")))
    return views.episodes(spark, sf_dir).select("series_id", "seq").withColumn("rank", rank).where("rank <= 3").select("series_id", "seq")


@query("SELECT CAST(conv_id AS VARCHAR) AS series_id, CAST(turn % 4 AS INT) AS episode_number, min(turn) AS seq, sha256(arg_min(text, turn)) AS synopsis FROM conversations GROUP BY 1, 2")
def episode_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.episodes(spark, sf_dir).groupBy("series_id", "episode_number").agg(F.min("seq").alias("seq"), F.sha2(F.min_by("synopsis", "seq"), 256).alias("synopsis"))


@query("""WITH old AS (SELECT conv_id % 10 AS series_id, conv_id AS character_id, conv_id AS pos, 'first' AS state FROM conversations WHERE turn = 0 AND conv_id % 3 <> 0),
new AS (SELECT conv_id % 10 AS series_id, conv_id AS character_id, arg_max(role, turn) AS state, max(conv_id * 100 + turn) AS pos FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id),
ends AS (SELECT series_id, max(pos) AS e FROM old GROUP BY series_id)
SELECT series_id, character_id, pos, state FROM old WHERE character_id NOT IN (SELECT character_id FROM new)
UNION ALL SELECT new.series_id, character_id, pos + coalesce(e + 1, 0), state FROM new LEFT JOIN ends USING (series_id)""")
def bible_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of a few series, some replaced by what the turns of their conversations say last, some new."""
    c = views.table(spark, sf_dir, "conversations").select((F.col("conv_id") % 10).alias("series_id"), F.col("conv_id").alias("character_id"), "turn", "role")
    old = c.where("turn = 0 and character_id % 3 <> 0").select("series_id", "character_id", F.col("character_id").alias("pos"), F.lit("first").alias("state"))
    new = c.where("character_id % 2 = 0").select("series_id", "character_id", (F.col("character_id") * 100 + F.col("turn")).alias("pos"), F.col("role").alias("state"))
    return knowledge.upsert_characters(old, new)


@query("""SELECT user_id AS series_id, event_id AS thread_id, CASE WHEN event_id % 7 = 0 OR event_type <> 'view' THEN 'resolved' ELSE 'open' END AS status,
CASE WHEN event_id % 7 = 0 THEN event_id % 9 END AS resolved_episode FROM events""")
def resolved_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as threads of a user, views being open; every seventh is resolved in some episode."""
    e = views.table(spark, sf_dir, "events")
    threads = e.select(F.col("user_id").alias("series_id"), F.col("event_id").alias("thread_id"), F.when(F.col("event_type") == "view", "open").otherwise("resolved").alias("status"), F.lit(None).cast("long").alias("resolved_episode"))
    done = threads.where("thread_id % 7 = 0").select("series_id", "thread_id", (F.col("thread_id") % 9).alias("episode"))
    return knowledge.resolve_threads(threads, done)


LINE_SQL = """line AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS subject_id, l_returnflag AS predicate, CAST(l_quantity AS INT) AS valid_from,
    CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_quantity AS INT) + l_linenumber END AS valid_to, CASE l_linestatus WHEN 'O' THEN 'active' ELSE 'invalidated' END AS status, l_shipdate AS recorded_at FROM lineitem)"""


@query(f"""WITH {LINE_SQL} SELECT subject_id, predicate, id, status FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate {AS_OF_ORDER}) AS rn
    FROM line WHERE {valid_sql("20")}) WHERE rn = 1""")
def as_of_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as facts about parts, each true for a stretch of quantities: the as-of aggregate over the largest table."""
    li = views.table(spark, sf_dir, "lineitem")
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    facts = li.select(F.lit("canon").alias("root"), F.col("l_partkey").alias("subject_id"), F.col("l_returnflag").alias("predicate"), (F.col("l_orderkey") * 10 + n).alias("id"), q.alias("valid_from"), F.when(n % 3 == 0, q + n).alias("valid_to"), F.when(F.col("l_linestatus") == "O", "active").otherwise("invalidated").alias("status"), F.col("l_shipdate").alias("recorded_at"))
    return temporal.as_of(facts, 20).select("subject_id", "predicate", "id", "status")


@query("SELECT conv_id * 100 + turn AS chapter, conv_id || ':b,' || conv_id || ':' || role AS options FROM conversations")
def options_per_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a chapter with two authored options, nested in their order."""
    c = views.table(spark, sf_dir, "conversations")
    told = lambda pos, what: F.struct(F.lit(pos).alias("pos"), F.concat_ws(":", F.col("conv_id").cast("string"), what).alias("option_id"), what.alias("label"), F.lit(False).alias("secret"))
    rows = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("chapter"), F.explode(F.array(told(2, F.col("role")), told(1, F.lit("b")))).alias("o")).select("chapter", "o.*")
    return knowledge.options_per_chapter(rows).select("chapter", F.array_join(F.transform("options", lambda o: o["option_id"]), ",").alias("options"))


RUNS = """run AS (SELECT conv_id AS play_id, max(turn) AS last, count(*) AS depth FROM conversations GROUP BY conv_id), pick AS (SELECT play_id, CASE play_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'z' END AS option_id FROM run)"""


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as runs of several turns, two options offered on each, and one choice for every run."""
    c = views.table(spark, sf_dir, "conversations")
    turns = c.select(F.col("conv_id").alias("play_id"), F.lit("canon").alias("fork_id"), F.lit("k1").alias("protagonist"), (F.col("turn") + 1).cast("int").alias("chapter"), F.col("turn").cast("int").alias("turn"))
    offered = turns.select("play_id", "turn", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("option_id"))
    n = F.col("play_id") % 3
    return turns, turns.select("play_id").distinct().select("play_id", F.when(n == 0, "a").when(n == 1, "b").otherwise("z").alias("option_id")), offered


@query(f"WITH {RUNS} SELECT play_id, 'canon' AS fork_id, 'k1' AS protagonist, CAST(last + 2 AS INT) AS chapter, CAST(last + 1 AS INT) AS turn FROM run JOIN pick USING (play_id) WHERE depth < 10 AND option_id <> 'z'")
def playthrough_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.advance(*runs(spark, sf_dir))[0]


@query(f"WITH {RUNS} SELECT play_id, option_id, CASE WHEN depth >= 10 THEN 'complete' ELSE 'not offered' END AS reason FROM run JOIN pick USING (play_id) WHERE depth >= 10 OR option_id = 'z'")
def playthrough_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.advance(*runs(spark, sf_dir))[1]


@query("""WITH b AS (SELECT conv_id AS play_id, CAST(turn AS INT) AS turn, 'k' || conv_id % 3 || ':' || turn + 1 || ':' || len(string_split(text, ' ')) AS key, string_split(text, ' ') AS known FROM conversations)
SELECT play_id, turn, key, CASE WHEN play_id % 4 = 0 THEN 'as written: ' || key ELSE array_to_string(known[1:4], '. ') || '.' END AS scene FROM b""")
def scripted_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose words are the known facts; every fourth run has a script for its beats, which no other run may share."""
    c = views.table(spark, sf_dir, "conversations")
    who = F.concat(F.lit("k"), (F.col("conv_id") % 3).cast("string"))
    beats = c.select(F.col("conv_id").alias("play_id"), F.col("turn").cast("int").alias("turn"), who.alias("protagonist"), (F.col("turn") + 1).cast("int").alias("chapter"), F.split("text", " ", -1).alias("known"))
    key = F.concat_ws(":", "protagonist", F.col("chapter").cast("string"), F.size("known").cast("string"))
    script = beats.where("play_id % 4 = 0").select(key.alias("key")).distinct().select("key", F.concat(F.lit("as written: "), "key").alias("text"))
    of = lambda scripted: knowledge.scripted(beats.where(F.col("play_id") % 4 == 0) if scripted else beats.where(F.col("play_id") % 4 != 0), script if scripted else script.limit(0))
    return of(True).unionByName(of(False))


@query("SELECT doc_id AS fact_id, doc_id AS chapter, substr(text, 2, 5) AS quote FROM documents WHERE length(text) >= 6")
def anchor_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One anchor per document, its sentinel being what stands there."""
    d = views.table(spark, sf_dir, "documents").where("length(text) >= 6")
    anchors = d.select(F.col("doc_id").alias("fact_id"), F.col("doc_id").alias("chapter"), F.lit(1).alias("char_start"), F.lit(6).alias("char_end"), F.substring("text", 3, 2).alias("must_contain"))
    return knowledge.seed_from_anchors(anchors, d.select(F.col("doc_id").alias("chapter"), "text")).select("fact_id", "chapter", "quote")


@query("SELECT user_id, count(*) AS open FROM events WHERE event_type = 'view' GROUP BY user_id")
def open_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as threads of a user, views being open."""
    status = F.when(F.col("event_type") == "view", "open").otherwise("closed")
    threads = views.table(spark, sf_dir, "events").select("user_id", "event_id", status.alias("status"))
    return knowledge.open_threads(threads).groupBy("user_id").agg(F.count("*").alias("open"))


@query("SELECT event_id AS id, 'payoff consistent' AS rule FROM events WHERE (event_id % 4 = 2) <> (event_id % 3 = 0)")
def payoff_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = views.table(spark, sf_dir, "events").select(e.alias("id"), F.element_at(F.array(*(F.lit(s) for s in STATES)), (e % 4 + 1).cast("int")).alias("state"), F.when(e % 3 == 0, e).alias("payoff_at"))
    return knowledge.audit_payoffs(rows)
