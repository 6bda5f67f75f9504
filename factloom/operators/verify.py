"""The hard lane: what a draft claims, held against canon by rule alone, each finding with the facts that it cites.

Three rules are one question: does a claim's stretch of story time overlap a fact about the same key that says something
else?  (identity: an attribute with one value has another; location: someone is in two places; inventory: a thing has two
holders.)  ``clashes`` answers it by a sweep instead of a join of intervals.  Of all facts of a key that start by the
claim's end, only the latest end matters, and the latest end among those that say otherwise than that one.  Both are running
maxima: wherever a fact says otherwise than the maximum so far, the smaller of the two is a runner-up, and the largest
runner-up always says otherwise than the maximum.  A key is swept in stretches of story time side by side, and what a
stretch leaves behind are its two maxima, which are carried on to the later ones, so that a key with a third of all facts is
several groups.

Mortality asks for the status as of the claim, timeline for causes that start after their effect, epistemic for facts that
the claim's knower could not have.  A finding always cites at least one fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.guard import is_visible
from factloom.operators.temporal import as_of_ranges
from factloom.schema import INCAPACITATED

#: The end of what never ends.
OPEN = 2**31 - 1
STRETCH = 64
SEVERITY, LANE = "blocking", "hard"
STATE = "struct<stop:int,id:bigint,says:string>"


def _loser(mine: Column, best: Column) -> Column:
    """What comes second of a fact and the best before it, where they say different things."""
    return F.when(mine["says"] != best["says"], F.least(mine, best))


def _swept(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    """``rows`` with ``fact`` (null for claims) as best and second before each row, in a group and an order."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("best", F.max("fact").over(before))
    rows = rows.withColumn("loser", F.coalesce(_loser(F.col("fact"), F.col("best")), F.lit(None).cast(STATE)))
    return rows.withColumn("second", F.max("loser").over(before))


def clashes(facts: DataFrame, claims: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``(claim_id, fact_id)`` for each of ``claims(claim_id, key, says, start, stop)`` that overlaps one of
    ``facts(id, key, says, start, stop)`` of its key that says otherwise: of those, the one that ends last (then the larger
    id).  Ends are inclusive and null where there is none; a claim that ends before it starts overlaps nothing; rows without
    a key, a value or a start are left out; repeated facts are one fact.
    """
    end = F.coalesce(F.col("stop").cast("int"), F.lit(OPEN))
    f = facts.where("key is not null and says is not null and start is not null")
    f = f.select("key", F.col("start").cast("int").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("claim_id"), F.lit(None).cast("int").alias("since"), F.struct(end.alias("stop"), F.col("id").cast("long").alias("id"), F.col("says").cast("string").alias("says")).alias("fact"), F.lit(None).cast("string").alias("says"))
    c = claims.where("key is not null and says is not null and start is not null and (stop is null or stop >= start)")
    c = c.select("key", end.alias("at"), F.lit(1).alias("kind"), F.col("claim_id").cast("long").alias("claim_id"), F.col("start").cast("int").alias("since"), F.lit(None).cast(STATE).alias("fact"), F.col("says").cast("string").alias("says"))
    # a claim without an end looks at all facts; it stands in the stretch behind the last one
    rows = f.unionByName(c).withColumn("stretch", F.floor(F.col("at") / stretch))
    swept = _swept(rows, ["key", "stretch"], ["at", "kind", "fact.stop", "fact.id"])

    left = swept.where("kind = 0").groupBy("key", "stretch").agg(F.max("fact").alias("best"), F.max("loser").alias("second"))
    left = left.select("key", "stretch", F.posexplode(F.array("best", "second")).alias("n", "fact")).where("fact is not null")
    left = _swept(left, ["key"], ["stretch", "n"])
    carried = left.groupBy("key", "stretch").agg(F.max("fact").alias("best"), F.max("loser").alias("second"))
    # what the stretches before one leave behind: a few rows a key, one or two for each stretch with facts
    places = rows.where("kind = 1").select("key", "stretch").distinct().withColumn("asks", F.lit(True))
    earlier = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carry = carried.join(places, ["key", "stretch"], "full_outer").select("key", "stretch", "asks", F.max("best").over(earlier).alias("best0"), F.max("second").over(earlier).alias("second0")).where("asks")

    asked = swept.where("kind = 1").select("key", "stretch", "claim_id", "since", "says", "best", "second").join(carry, ["key", "stretch"], "left")
    other = lambda s: F.when(F.col(s)["says"] != F.col("says"), F.col(s))
    last = F.greatest(*(other(s) for s in ("best", "second", "best0", "second0")))
    return asked.withColumn("last", last).where(F.col("last.stop") >= F.col("since")).select("claim_id", F.col("last.id").alias("fact_id"))


def overlapping(facts: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``(claim_id, fact_id)``: facts that start while another of their key says otherwise; equal starts cite each other."""
    asks = facts.select(F.col("id").alias("claim_id"), "key", "says", "start", F.col("start").alias("stop"))
    return clashes(facts, asks, stretch)


def flags(found: DataFrame, spans: DataFrame, facts: DataFrame, about: str) -> DataFrame:
    """Findings ``(id, invariant, fact_id)`` as flags, one for each id and invariant, with all facts that it cites: about, id,
    invariant, severity, lane, draft_span, cited_fact_ids, citation."""
    of = facts.select(F.col("id").alias("fact_id"), F.struct(F.col("id"), "said", F.col("start").alias("since")).alias("fact"))
    told = found.distinct().join(of, "fact_id").groupBy("id", "invariant").agg(F.array_sort(F.collect_set("fact")).alias("cited"))
    proof = F.array_join(F.transform("cited", lambda c: F.concat(c["said"], F.lit(" since chapter "), c["since"].cast("string"))), "; ")
    return told.join(spans.select("id", "span"), "id").select(
        F.lit(about).alias("about"),
        "id",
        "invariant",
        F.lit(SEVERITY).alias("severity"),
        F.lit(LANE).alias("lane"),
        F.col("span").alias("draft_span"),
        F.transform("cited", lambda c: c["id"]).alias("cited_fact_ids"),
        F.concat(F.lit("draft says "), F.col("span"), F.lit("; canon: "), proof).alias("citation"),
    )


def _spoken(resolved: DataFrame) -> DataFrame:
    """Facts with what they say in words, and their interval."""
    says = F.coalesce(F.col("object_id").cast("string"), F.col("object_literal"))
    said = F.concat_ws(" ", F.col("subject_id").cast("string"), "predicate", says)
    return resolved.select("root", "id", "subject_id", "predicate", says.alias("says"), F.col("valid_from").alias("start"), F.col("valid_to").alias("stop"), said.alias("said"))


def _both(first: DataFrame, *more: DataFrame) -> DataFrame:
    for df in more:
        first = first.unionByName(df)
    return first


def twins(resolved: DataFrame, entities: DataFrame) -> DataFrame:
    """Flags about ``entities(id, root, names)`` of a fork that answer to one name (trimmed, lower-cased), under each id but
    the smallest; they cite the first active fact about either, and are left out where there is none about one of them."""
    facts = _spoken(resolved.where("status = 'active'"))
    first = facts.groupBy("root", F.col("subject_id").alias("id")).agg(F.min(F.col("id")).alias("fact_id"))
    names = F.array_distinct(F.transform("names", lambda n: F.lower(F.trim(n))))
    named = entities.select("root", "id", F.explode(names).alias("name")).where("name <> ''")
    shared = named.groupBy("root", "name").agg(F.min("id").alias("lowest"), F.max("id").alias("highest")).where("lowest < highest")
    pairs = named.join(shared, ["root", "name"]).where("id > lowest").select("root", "id", "lowest").distinct()
    pairs = pairs.join(first, ["root", "id"]).join(first.select("root", F.col("id").alias("lowest"), F.col("fact_id").alias("other")), ["root", "lowest"])
    found = pairs.select("id", F.lit("identity").alias("invariant"), F.explode(F.array("fact_id", "other")).alias("fact_id"))
    spans = pairs.select("id", F.concat(F.lit("entity "), F.col("id").cast("string")).alias("span")).distinct()
    return flags(found, spans, facts.select("id", "said", "start").distinct(), "entity")


def hard_lane(resolved: DataFrame, claims: DataFrame, *, single: list[str], place: str, holder: str, status: str) -> DataFrame:
    """All flags of ``claims(claim_id, root, subject_id, predicate, says, start, stop, span, knower, cause_id, used)`` against
    the facts that its fork ``root`` resolves to.

    ``single`` are the attributes with one value, ``place``, ``holder`` (thing to person) and ``status`` the predicates that
    say where one is, who has a thing and how one is.  Only active facts speak; hidden ones may have any status.  A claim
    without a knower or a cause is not asked about them; used ids and causes without a fact are ignored.
    """
    live = resolved.where("status = 'active'")
    facts = _spoken(live)
    key = lambda who: F.concat_ws("\x1f", "root", F.col(who).cast("string"), "predicate")

    def swept(invariant: str, predicates: list[str], who: str, what: str) -> DataFrame:
        has = F.col(who).isNotNull()
        of = lambda df, i: df.where(F.col("predicate").isin(*predicates) & has).select(i, key(who).alias("key"), F.col(what).cast("string").alias("says"), "start", "stop")
        return clashes(of(facts, "id"), of(claims, "claim_id")).withColumn("invariant", F.lit(invariant))

    drift = swept("identity", single, "subject_id", "says")
    two_places = swept("timeline", [place], "subject_id", "says")
    two_holders = swept("inventory", [holder], "says", "subject_id")

    # how one is, as of each moment at which one acts
    acts = claims.where("subject_id is not null and start is not null").where(F.col("predicate") != status)
    moments = acts.select("root", "subject_id", F.lit(status).alias("predicate"), F.col("start").alias("chapter")).distinct()
    held = as_of_ranges(live.where(F.col("predicate") == status), moments).withColumnRenamed("id", "fact_id")
    out = facts.where(F.col("says").isin(*INCAPACITATED)).select("root", F.col("id").alias("fact_id"))
    gone = held.join(out, ["root", "fact_id"]).select("root", "subject_id", F.col("chapter").alias("start"), "fact_id")
    acting = acts.join(gone, ["root", "subject_id", "start"]).select("claim_id", "fact_id", F.lit("mortality").alias("invariant"))

    known = facts.select("root", F.col("id").alias("cause_id"), F.col("start").alias("since"))
    too_early = claims.select("root", "claim_id", "cause_id", "start").join(known, ["root", "cause_id"]).where("start < since")
    too_early = too_early.select("claim_id", F.col("cause_id").alias("fact_id"), F.lit("timeline").alias("invariant"))

    used = claims.where("knower is not null").select("root", "claim_id", "knower", F.col("start").alias("chapter"), F.explode("used").alias("id"))
    hidden = used.join(resolved, ["root", "id"]).where(~is_visible(F.col("knower"), F.col("chapter")))
    hidden = hidden.select("claim_id", F.col("id").alias("fact_id"), F.lit("epistemic").alias("invariant"))

    found = _both(drift, two_places, two_holders, acting, too_early, hidden).withColumnRenamed("claim_id", "id")
    # a fact that several forks inherit has one id and says the same in all of them
    told = _spoken(resolved).select("id", "said", "start").distinct()
    return flags(found, claims.select(F.col("claim_id").alias("id"), "span"), told, "claim")
