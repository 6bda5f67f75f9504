"""Facts in time: as-of lookups, conflicts, supersession, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.guard import is_valid_at, is_visible
from factloom.schema import AUDIENCE

KEY = ("root", "subject_id", "predicate")


def as_of(resolved: DataFrame, chapter: int) -> DataFrame:
    """The one fact per key that holds at a chapter: live before invalidated, then latest start, record, id.

    A hash aggregate with a struct as order; no sort of the facts.
    """
    live = resolved.where((F.col("status") != "quarantined") & is_valid_at(chapter))
    order = F.struct(F.col("status") != "invalidated", "valid_from", "recorded_at", "id")
    rest = [c for c in resolved.columns if c not in KEY]
    return live.groupBy(*KEY).agg(F.max_by(F.struct(*rest), order).alias("f")).select(*KEY, "f.*")


def as_of_probe(resolved: DataFrame, probes: DataFrame) -> DataFrame:
    """The same for many probes (root, subject_id, predicate, chapter): an equi-join on the key with the interval as residue.

    Probes must be distinct; those without a fact are left out.
    """
    hit = probes.join(resolved, list(KEY)).where((F.col("status") != "quarantined") & is_valid_at(F.col("chapter")))
    order = F.struct(F.col("status") != "invalidated", "valid_from", "recorded_at", "id")
    return hit.groupBy(*KEY, "chapter").agg(F.max_by("id", order).alias("id"))


def as_of_ranges(resolved: DataFrame, probes: DataFrame) -> DataFrame:
    """``as_of_probe`` for keys with many versions and many probes, where pairs of both would be too many.

    Story time is cut in halves, their halves and so on.  A version stands in the few pieces that make up its interval, a
    piece keeps the best of its versions (combined map-side), and a probe asks the pieces around its chapter, one of each
    size: rows grow with the logarithm of the last chapter asked, never with versions times probes, and a hot key is as many
    groups as it has pieces.  Probes are distinct, at chapters from 0 on; those without a fact are left out.
    """
    order = F.struct(F.col("status") != "invalidated", "valid_from", "recorded_at", "id")
    last = probes.agg(F.max("chapter")).first()[0]
    if last is None:
        return probes.select(*KEY, "chapter").withColumn("id", F.lit(None).cast("long")).limit(0)
    levels = F.sequence(F.lit(0), F.lit(max(int(last), 1).bit_length()))
    lo = F.greatest(F.col("valid_from"), F.lit(0))
    hi = F.least(F.coalesce("valid_to", F.lit(int(last))), F.lit(int(last))) + 1
    live = resolved.where((F.col("status") != "quarantined") & (lo < hi))

    def pieces(level: Column) -> Column:
        """The one or two pieces of a size at the rims of what larger ones leave of an interval."""
        size = F.pow(F.lit(2), level)
        first, stop = F.ceil(lo / size), F.floor(hi / size)
        left = F.when((first % 2 == 1) & (first < stop), first)
        right = F.when((stop % 2 == 1) & (first < stop), stop - 1)
        return F.transform(F.array_distinct(F.array_compact(F.array(left, right))), lambda n: F.struct(level.alias("level"), n.alias("piece")))

    spread = live.select(*KEY, order.alias("order"), F.explode(F.flatten(F.transform(levels, pieces))).alias("p"))
    best = spread.groupBy(*KEY, "p.level", "p.piece").agg(F.max("order").alias("order"))
    around = F.transform(levels, lambda level: F.struct(level.alias("level"), F.floor(F.col("chapter") / F.pow(F.lit(2), level)).alias("piece")))
    asks = probes.where("chapter >= 0").select(*KEY, "chapter", F.explode(around).alias("p")).select(*KEY, "chapter", "p.level", "p.piece")
    # Spark takes the asks for as small as the probes that they are made from, and would send them whole through the driver
    found = asks.hint("merge").join(best, [*KEY, "level", "piece"]).groupBy(*KEY, "chapter").agg(F.max("order").alias("order"))
    return found.select(*KEY, "chapter", F.col("order.id").alias("id"))


def conflicts(facts: DataFrame, chapter: int) -> DataFrame:
    """Pairs of live facts about one key that say different things: first, second (in order of id).

    Keys about which only one thing is said go before facts are paired (a map-side combined minimum and maximum of what is
    said), so what meets is a conflict but for facts that agree with each other beside one that does not.
    """
    live = facts.where((F.col("status") == "active") & is_valid_at(chapter))
    live = live.select("fork_id", "subject_id", "predicate", "object_id", "object_literal", "id")
    key = ["fork_id", "subject_id", "predicate"]
    says = F.struct("object_id", "object_literal")
    torn = live.groupBy(*key).agg(F.min(says).alias("lo"), F.max(says).alias("hi")).where(~F.col("lo").eqNullSafe(F.col("hi"))).select(*key)
    live = live.join(torn, key, "left_semi")
    other = live.select(*key, F.col("object_id").alias("o2"), F.col("object_literal").alias("l2"), F.col("id").alias("second"))
    same = F.col("object_id").eqNullSafe(F.col("o2")) & F.col("object_literal").eqNullSafe(F.col("l2"))
    return live.join(other, key).where((F.col("id") < F.col("second")) & ~same).select(*key, F.col("id").alias("first"), "second")


def epistemic_violations(used: DataFrame, facts: DataFrame, knower: str, chapter: int) -> DataFrame:
    """Used fact ids ``(pos, id)`` that the knower could not know by then; duplicates and order kept, unknown ids ignored."""
    return used.join(facts, "id").where(~is_visible(knower, chapter)).select("pos", "id")


def supersede(facts: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply ``commands(old_id, replacement: struct of a fact, closes_at, at)`` as one batch: (new facts, rejected).

    A command is rejected when its target is missing, not active, in another fork than the replacement, or the
    replacement itself, when its close lies before the target's start, or when a target is named twice.  The result is
    a whole new snapshot: unchanged rows, closed rows, replacements.
    """
    target = facts.select(F.col("id").alias("old_id"), F.col("fork_id").alias("__fork"), F.col("status").alias("__status"), F.col("valid_from").alias("__from"))
    twice = commands.groupBy("old_id").agg(F.count("*").alias("__times"))
    seen = commands.join(target, "old_id", "left").join(twice, "old_id")
    why = (
        F.when(F.col("__status").isNull(), "missing")
        .when(F.col("__times") > 1, "named twice")
        .when(F.col("__status") != "active", "not active")
        .when(F.col("__fork") != F.col("replacement.fork_id"), "other fork")
        .when(F.col("old_id") == F.col("replacement.id"), "itself")
        .when(F.col("closes_at") < F.col("__from"), "closes before it starts")
    )
    seen = seen.withColumn("reason", why)
    good = seen.where("reason is null")
    closing = good.select(F.col("old_id").alias("id"), F.col("closes_at").alias("__to"), F.col("at").alias("__at"))
    hit = F.col("__to").isNotNull()
    changed = {"valid_to": F.when(hit, F.col("__to")).otherwise(F.col("valid_to")), "superseded_at": F.when(hit, F.col("__at")).otherwise(F.col("superseded_at")), "status": F.when(hit, "invalidated").otherwise(F.col("status"))}
    after = facts.join(closing, "id", "left").select(*(changed.get(c, F.col(c)).alias(c) for c in facts.columns))
    return after.unionByName(good.select("replacement.*").select(*facts.columns)), seen.where("reason is not null").select("old_id", "reason")


def audit(facts: DataFrame) -> DataFrame:
    """Broken rules as rows (id, rule), all rules in one pass over the table."""
    scope = F.col("knower_scope")
    audience = F.get(F.filter(scope, lambda a: a["knower"] == AUDIENCE), F.lit(0))["learned_at"]
    bad = {
        "empty scope": F.size(scope) == 0,
        "one object": F.col("object_id").isNull() == F.col("object_literal").isNull(),
        "attribution": (F.col("assertion_mode") == "attributed") != F.col("attributed_to").isNotNull(),
        "validity order": F.col("valid_to") < F.col("valid_from"),
        "invalidated has record": (F.col("status") == "invalidated") & F.col("superseded_at").isNull(),
        "active has no record": (F.col("status") == "active") & F.col("superseded_at").isNotNull(),
        "record order": F.col("superseded_at") < F.col("recorded_at"),
        "knower once": F.size(F.array_distinct(F.transform(scope, lambda a: a["knower"]))) < F.size(scope),
        "reveal matches scope": scope.isNotNull() & ~F.col("revealed_at").eqNullSafe(audience),
        "span forward": F.col("provenance.char_end") <= F.col("provenance.char_start"),
    }
    rules = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in bad.items())))
    return facts.select("id", F.explode(rules).alias("rule"))


def audit_forks(forks: DataFrame) -> DataFrame:
    """A fork has a divergence exactly if it has a parent."""
    return forks.where(F.col("parent_fork_id").isNull() != F.col("divergence_at").isNull()).select("id", F.lit("divergence matches parent").alias("rule"))


def audit_rosters(scenes: DataFrame, key: list[str]) -> DataFrame:
    """Nobody stands on a roster twice."""
    people = F.transform("roster", lambda p: p["entity_id"])
    return scenes.where(F.size(F.array_distinct(people)) < F.size(people)).select(*key, F.lit("roster unique").alias("rule"))


def audit_turns(turns: DataFrame) -> DataFrame:
    """A turn offers two to four different choices: ``turns(id, choices: array<string>)``."""
    n = F.size("choices")
    return turns.where(~n.between(2, 4) | (F.size(F.array_distinct("choices")) < n)).select("id", F.lit("playable choices").alias("rule"))


def audit_episodes(episodes: DataFrame) -> DataFrame:
    """Episode numbers of a series run from 1 without a gap or repeat."""
    by = episodes.groupBy("series_id").agg(F.min("number").alias("lo"), F.max("number").alias("hi"), F.count("*").alias("n"), F.countDistinct("number").alias("d"))
    return by.where("lo <> 1 or hi <> n or d <> n").select("series_id", F.lit("episodes contiguous").alias("rule"))


def audit_flags(flags: DataFrame) -> DataFrame:
    """A hard flag cites facts: ``flags(id, severity, fact_ids)``."""
    return flags.where((F.col("severity") == "hard") & (F.coalesce(F.size("fact_ids"), F.lit(0)) <= 0)).select("id", F.lit("hard flag cites").alias("rule"))
