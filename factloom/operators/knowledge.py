"""How knowledge spreads: awareness, witnesses, packets, directives, play."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.guard import is_valid_at, is_visible, learned_at, witnesses
from factloom.schema import COMMITMENT_MOVES
from factloom.sources.shared import written

BUDGET = 40
BLIND_SPOTS = 3
TURNS = 10


def merge_awareness(*events: DataFrame) -> DataFrame:
    """Earliest chapter per (fact_id, knower) over all events: commutative, associative, idempotent, combined map-side."""
    all_events = events[0]
    for e in events[1:]:
        all_events = all_events.unionByName(e)
    return all_events.groupBy("fact_id", "knower").agg(F.min("learned_at").alias("learned_at"))


def scope_of(awareness: DataFrame) -> DataFrame:
    """Awareness rows folded into one sorted scope per fact."""
    return awareness.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("knower", "learned_at"))).alias("knower_scope"))


def awareness_of(facts: DataFrame) -> DataFrame:
    """Scopes as rows (fact_id, knower, learned_at); untracked facts have none."""
    return facts.select(F.col("id").alias("fact_id"), F.explode("knower_scope").alias("a")).select("fact_id", "a.knower", "a.learned_at")


def witnesses_learn(facts: DataFrame, staged: DataFrame) -> DataFrame:
    """Awareness after witnesses took in facts at scenes ``staged(fact_id, chapter, roster)``.

    Untracked facts stay untracked: naming witnesses would narrow who sees them.
    """
    tracked = facts.where("knower_scope is not null").select(F.col("id").alias("fact_id"))
    seen = staged.join(tracked, "fact_id", "left_semi").select("fact_id", F.explode(witnesses(F.col("roster"))).alias("knower"), F.col("chapter").alias("learned_at"))
    return merge_awareness(awareness_of(facts), seen)


def told(facts: DataFrame, told_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(awareness, violations) after ``told_rows(fact_id, knower, learned_at)``; telling an untracked fact is a violation."""
    tracked = facts.where("knower_scope is not null").select(F.col("id").alias("fact_id"))
    good = told_rows.join(tracked, "fact_id", "left_semi")
    return merge_awareness(awareness_of(facts), good), told_rows.join(tracked, "fact_id", "left_anti").withColumn("rule", F.lit("not tracked"))


def start_tracking(facts: DataFrame, scopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, violations) after giving untracked facts a scope: ``scopes(fact_id, scope)``; tracked or empty ones are violations."""
    seen = scopes.join(facts.select(F.col("id").alias("fact_id"), F.col("knower_scope").alias("__old")), "fact_id")
    good = seen.where("__old is null and size(scope) > 0").select(F.col("fact_id").alias("id"), "scope")
    out = facts.join(good, "id", "left").withColumn("knower_scope", F.coalesce("knower_scope", "scope")).select(*facts.columns)
    return out, seen.where("__old is not null or size(scope) <= 0 or scope is null").select("fact_id", F.lit("tracked or empty").alias("rule"))


def record_learning(facts: DataFrame, proposed: DataFrame) -> DataFrame:
    """Verdict per proposal ``(fact_id, scope)``: a scope may gain knowers or make them earlier, nothing else."""
    old = facts.select(F.col("id").alias("fact_id"), F.col("knower_scope").alias("old"))
    both = proposed.join(old, "fact_id", "left")
    as_map = lambda c: F.map_from_entries(F.transform(c, lambda a: F.struct(a["knower"], a["learned_at"])))
    both = both.withColumn("m", as_map(F.col("scope")))
    kept = F.forall("old", lambda a: F.coalesce(F.try_element_at("m", a["knower"]) <= a["learned_at"], F.lit(False)))
    return both.select("fact_id", F.when(F.col("old").isNull(), "not tracked").when(~kept, "not monotonic").otherwise("ok").alias("verdict"))


def packets(resolved: DataFrame, probes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Memory packets for many ``probes(root, knower, chapter, focus array)`` in one plan: the first facts that are visible
    and valid.

    Facts with an entity of the focus at either end come first, then nearest fork, record, id.  ``withheld`` counts what the
    guard hides from the probe, validity and budget aside.  Ranks are pruned per probe before the shuffle settles (window
    group limit).
    """
    if budget < 1:
        raise ValueError("budget must be positive")
    # written, probes have a size that Spark knows: few go to the facts, which stay where they are
    hit = resolved.join(written(probes, "probes"), "root").withColumn("__seen", is_visible(F.col("knower"), F.col("chapter")))
    key = ["root", "knower", "chapter"]
    withheld = hit.groupBy(*key).agg(F.count_if(~F.col("__seen")).alias("withheld"))
    near = F.coalesce(F.array_contains("focus", F.col("subject_id")), F.lit(False)) | F.coalesce(F.array_contains("focus", F.col("object_id")), F.lit(False))
    order = Window.partitionBy(*key).orderBy(~near, "depth", "recorded_at", "id")
    ranked = hit.where(F.col("__seen") & is_valid_at(F.col("chapter"))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget)
    return ranked.join(withheld, key).select(*key, "rank", "id", "withheld")


def describe(subject: Column, predicate: Column, literal: Column, obj: Column) -> Column:
    """Subject, predicate and object in words."""
    thing = F.coalesce(F.nullif(literal, F.lit("")), F.nullif(obj.cast("string"), F.lit("")), F.lit(""))
    return F.trim(F.concat_ws(" ", subject.cast("string"), F.replace(predicate, F.lit("_"), F.lit(" ")), thing))


def tension(missing: Column, total: Column) -> Column:
    """0 to 5, half to even; 0 where there is nothing to know."""
    return F.when(total == 0, 0).otherwise(F.least(F.lit(5), F.bround(5.0 * missing / F.nullif(total, F.lit(0))).cast("int")))


def directives(actor_facts: DataFrame, cast: DataFrame, visible: DataFrame, most: int = BUDGET) -> DataFrame:
    """What each other character does not know of the actor's packet ``actor_facts(pos, id, text)``, ``most`` rows at most.

    ``cast(character)``, ``visible(character, id)``.  One row per character in the cast: missing, total, tension and the
    first three blind spots in packet order.  The packet travels as one row; of what a character sees only the places in the
    packet are gathered.
    """
    packet = actor_facts.orderBy("pos").limit(most)
    spots = packet.agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("spots"))
    seen = visible.join(F.broadcast(packet.select("pos", "id")), "id").groupBy("character").agg(F.collect_set("pos").alias("seen"))
    # an aggregate without a key is one row: every character gets it as a column
    both = cast.select("character").join(F.broadcast(spots)).join(seen, "character", "left")
    lacking = F.filter("spots", lambda s: ~F.array_contains(F.coalesce("seen", F.array().cast("array<int>")), s["pos"]))
    out = both.select("character", F.size("spots").cast("long").alias("total"), lacking.alias("lacking"))
    missing = F.size("lacking").cast("long")
    blind = F.transform(F.slice("lacking", 1, BLIND_SPOTS), lambda x: x["text"])
    return out.select("character", missing.alias("missing"), "total", tension(missing, F.col("total")).alias("tension"), blind.alias("blind_spots"))


def replay(resolved: DataFrame, cast: list[str], chapters: DataFrame) -> DataFrame:
    """How many facts each of the cast sees and holds true in each of ``chapters(chapter)``: chapter, knower, visible.

    The guard only ever opens, and a fact is true between two chapters: it enters a view once and leaves it once.  Entries
    and exits are counted per knower and chapter, one pass over the facts whatever the number of chapters, and summed up over
    the few chapters that remain.
    """

    def span(knower: str) -> Column:
        begins = F.greatest(learned_at(knower), F.col("valid_from"))
        seen = (F.col("status") != "quarantined") & learned_at(knower).isNotNull() & (F.col("valid_to").isNull() | (begins <= F.col("valid_to")))
        ends = F.when(F.col("valid_to").isNotNull(), F.struct(F.lit(knower).alias("knower"), (F.col("valid_to") + 1).alias("chapter"), F.lit(-1).alias("step")))
        opens = F.struct(F.lit(knower).alias("knower"), begins.alias("chapter"), F.lit(1).alias("step"))
        return F.when(F.coalesce(seen, F.lit(False)), F.array_compact(F.array(opens, ends)))

    steps = resolved.select(F.explode(F.flatten(F.array_compact(F.array(*(span(k) for k in cast))))).alias("s")).select("s.*")
    steps = steps.groupBy("knower", "chapter").agg(F.sum("step").alias("step"))
    asked = chapters.select("chapter").distinct().select(F.explode(F.array(*(F.lit(k) for k in cast))).alias("knower"), "chapter", F.lit(0).alias("step"), F.lit(True).alias("asked"))
    both = steps.withColumn("asked", F.lit(False)).unionByName(asked)
    run = Window.partitionBy("knower").orderBy("chapter").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("visible", F.sum("step").over(run)).where("asked").select("chapter", "knower", "visible")


def citations(packet: DataFrame, facts: DataFrame, most: int = 3) -> DataFrame:
    """Receipts of the first facts of each packet: source, chapter, quote."""
    return packet.where(F.col("rank") <= most).join(facts.select("id", "provenance"), "id").select("root", "knower", "chapter", "rank", "id", "provenance.source_id", F.col("provenance.chapter").alias("cited_chapter"), "provenance.quote")


def moves(states: DataFrame) -> DataFrame:
    """Whether commitments ``(id, state, to)`` may move: a join with the four allowed moves."""
    spark = states.sparkSession
    allowed = spark.createDataFrame(COMMITMENT_MOVES, "state string, to string").withColumn("ok", F.lit(True))
    return states.join(F.broadcast(allowed), ["state", "to"], "left").select("id", "state", "to", F.coalesce("ok", F.lit(False)).alias("allowed"))


def apply_choices(choices: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A batch of chosen options as (new facts, awareness, violations).

    ``choices(turn, option_id, subject_id, predicate, object_literal, roster, secret, discloses)`` are what was offered,
    ``chosen(turn, option_id, chapter)`` what was taken.  A secret consequence is known to the witnesses and never
    revealed; a public one is untracked and revealed at once.  Disclosed facts reach the witnesses.  Taking what was not
    offered is a violation.
    """
    taken = chosen.join(choices, ["turn", "option_id"])
    scope = F.array_sort(F.transform(witnesses(F.col("roster")), lambda w: F.struct(w.alias("knower"), F.col("chapter").alias("learned_at"))))
    new = taken.select("turn", "option_id", "subject_id", "predicate", "object_literal", F.col("chapter").alias("valid_from"), F.when(~F.col("secret"), F.col("chapter")).alias("revealed_at"), F.when(F.col("secret"), scope).alias("knower_scope"))
    spread = taken.select(F.explode("discloses").alias("fact_id"), witnesses(F.col("roster")).alias("w"), "chapter").select("fact_id", F.explode("w").alias("knower"), F.col("chapter").alias("learned_at"))
    return new, merge_awareness(spread), chosen.join(choices, ["turn", "option_id"], "left_anti").withColumn("rule", F.lit("not offered"))


def playthroughs(turns: DataFrame, most: int = TURNS) -> DataFrame:
    """Depth (the opening turn counts) and whether the ceiling is reached: ``turns(play_id, turn)``."""
    return turns.groupBy("play_id").agg(F.count("*").alias("depth")).withColumn("complete", F.col("depth") >= most)


def begin(starts: DataFrame) -> DataFrame:
    """Opening turns of new runs ``starts(play_id, fork_id, protagonist, chapter)``: the same with ``turn`` 0."""
    return starts.withColumn("turn", F.lit(0))


def advance(turns: DataFrame, chosen: DataFrame, offered: DataFrame, most: int = TURNS) -> tuple[DataFrame, DataFrame]:
    """(new turns, rejected) of a batch of choices, one for each run: ``turns(play_id, fork_id, protagonist, chapter, turn)``,
    ``chosen(play_id, option_id)``, ``offered(play_id, turn, option_id)``.

    The next turn is a chapter on.  A choice is rejected where the run is unknown, has reached its ceiling, or did not offer
    it on its last turn.
    """
    last = turns.groupBy("play_id").agg(F.max_by(F.struct("fork_id", "protagonist", "chapter", "turn"), "turn").alias("l"), F.count("*").alias("depth"))
    told = offered.select("play_id", F.col("turn").alias("__turn"), "option_id", F.lit(True).alias("__offered")).distinct()
    seen = chosen.join(last, "play_id", "left").withColumn("__turn", F.col("l.turn")).join(told, ["play_id", "__turn", "option_id"], "left")
    why = F.when(F.col("depth").isNull(), "unknown run").when(F.col("depth") >= most, "complete").when(F.col("__offered").isNull(), "not offered")
    seen = seen.withColumn("reason", why)
    new = seen.where("reason is null").select("play_id", "l.fork_id", "l.protagonist", (F.col("l.chapter") + 1).alias("chapter"), (F.col("l.turn") + 1).alias("turn"))
    return new, seen.where("reason is not null").select("play_id", "option_id", "reason")


def replay_as(turns: DataFrame, character: str) -> DataFrame:
    """The same turns and choices seen by another: only the knower changes, the guard does the rest."""
    return turns.withColumn("protagonist", F.lit(character))


def scripted(beats: DataFrame, script: DataFrame) -> DataFrame:
    """Beats ``(play_id, turn, protagonist, chapter, known array<string>)`` with their ``scene``: the scripted text under
    ``knower:chapter:number of facts`` where ``script(key, text)`` has one, else what the first four facts say."""
    key = F.concat_ws(":", "protagonist", F.col("chapter").cast("string"), F.size("known").cast("string"))
    plain = F.when(F.size("known") > 0, F.concat(F.array_join(F.slice("known", 1, 4), ". "), F.lit("."))).otherwise("")
    both = beats.withColumn("key", key).join(script.select("key", F.col("text").alias("__text")), "key", "left")
    return both.select("play_id", "turn", "key", F.coalesce("__text", plain).alias("scene"))


def options_per_chapter(branches: DataFrame) -> DataFrame:
    """Authored rows ``(chapter, pos, option_id, label, secret)`` nested per chapter in authored order."""
    nested = F.array_sort(F.collect_list(F.struct("pos", "option_id", "label", "secret")))
    return branches.groupBy("chapter").agg(F.transform(nested, lambda o: F.struct(o["option_id"].alias("option_id"), o["label"].alias("label"), o["secret"].alias("secret"))).alias("options"))


def options_at(nested: DataFrame, chapter: int) -> DataFrame:
    """The options of a chapter, none for an unmapped one."""
    return nested.where(F.col("chapter") == chapter).select(F.explode("options").alias("o")).select("o.*")


def is_canon_baseline(option_id: Column, source_work_id: Column) -> Column:
    return F.coalesce(source_work_id.isNull() & F.endswith(option_id, F.lit(":canon")), F.lit(False))


def seed_from_anchors(anchors: DataFrame, texts: DataFrame) -> DataFrame:
    """Anchors ``(fact_id, chapter, char_start, char_end, must_contain)`` cut out of their chapters; a quote without its
    sentinel fails the query."""
    quote = F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    cut = anchors.join(texts, "chapter").select("fact_id", "chapter", "char_start", "char_end", "must_contain", quote.alias("quote"))
    checked = F.when(F.contains("quote", F.col("must_contain")), F.col("quote")).otherwise(F.raise_error(F.concat(F.lit("anchor misses its sentinel: "), F.col("fact_id").cast("string"))).cast("string"))
    return cut.select("fact_id", "chapter", "char_start", "char_end", checked.alias("quote"))


def open_threads(threads: DataFrame) -> DataFrame:
    """The threads that are open."""
    return threads.where(F.col("status") == "open")


def resolve_threads(threads: DataFrame, resolved: DataFrame) -> DataFrame:
    """Threads ``(series_id, thread_id, status, resolved_episode)`` after ``resolved(series_id, thread_id, episode)``."""
    done = resolved.groupBy("series_id", "thread_id").agg(F.max("episode").alias("__episode"))
    hit = F.col("__episode").isNotNull()
    changed = {"status": F.when(hit, "resolved").otherwise(F.col("status")), "resolved_episode": F.coalesce("__episode", "resolved_episode")}
    return threads.join(done, ["series_id", "thread_id"], "left").select(*(changed.get(c, F.col(c)).alias(c) for c in threads.columns))


def upsert_characters(characters: DataFrame, new: DataFrame) -> DataFrame:
    """Characters ``(series_id, character_id, pos, ...)`` after new states, which replace by id and move to the end.

    Of several states of one character in a batch the last (by ``pos`` within ``new``) stays.
    """
    key = ["series_id", "character_id"]
    last = new.groupBy(*key).agg(F.max_by(F.struct(*new.columns), "pos").alias("r")).select("r.*")
    ends = characters.groupBy("series_id").agg(F.max("pos").alias("__end"))
    moved = last.join(ends, "series_id", "left").withColumn("pos", F.col("pos") + F.coalesce(F.col("__end") + 1, F.lit(0)))
    return characters.join(last.select(*key), key, "left_anti").unionByName(moved.select(*characters.columns))


def audit_payoffs(commitments: DataFrame) -> DataFrame:
    """A commitment is paid off exactly if it says where: ``(id, state, payoff_at)``."""
    return commitments.where((F.col("state") == "paid_off") != F.col("payoff_at").isNotNull()).select("id", F.lit("payoff consistent").alias("rule"))
