"""Histories: operations on facts and moves of commitments, folded in order.

A step is a function over the few states that a thing can be in: for each state where it leads, and what it leaves behind.
Such functions compose, and composition is associative, so a history is folded in stretches of its order side by side, the
stretches again, and so on: no task ever holds more than a stretch, however long the history of one thing is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.schema import COMMITMENT_MOVES, OPEN_COMMITMENTS

STRETCH = 4096


def ordered_fold(steps: DataFrame, keys: list[str], at: str, compose: Callable[[Column, Column], Column], stretch: int = STRETCH) -> DataFrame:
    """``steps(*keys, at, f)`` to ``(*keys, f)``: the composition of each key's functions in order of ``at``, a whole number
    that does not repeat within a key; ``compose(first, then)`` is associative."""
    span = steps.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    low, width = span["lo"] or 0, (span["hi"] or 0) - (span["lo"] or 0) + 1
    out = steps.select(*keys, (F.col(at) - low).alias("at"), "f")
    while True:
        block = F.floor(F.col("at") / stretch)
        told = F.transform(F.sort_array(F.collect_list(F.struct("at", "f"))), lambda x: x["f"])
        out = out.groupBy(*keys, block.alias("block")).agg(told.alias("fs"))
        # the first stands for the start, so no function without effect is needed
        folded = F.aggregate(F.slice("fs", F.lit(2), F.size("fs")), F.get("fs", F.lit(0)), compose)
        out = out.select(*keys, F.col("block").alias("at"), folded.alias("f"))
        width = -(-width // stretch)
        if width <= 1:
            return out.drop("at")


# --- the log of operations on facts ------------------------------------------------------------------------------------

OPS = ("ASSERT", "UPDATE", "INVALIDATE", "RETCON")
ABSENT, ACTIVE, INVALIDATED = 0, 1, 2
FIELDS = ("object_literal", "valid_from", "valid_to", "confidence")
EFFECT = "struct<to:int,rejected:bigint,object_literal:array<string>,valid_from:array<int>,valid_to:array<int>,confidence:array<double>,superseded_seq:array<bigint>>"


def _effect(to: int, rejected: int = 0, **sets: Column) -> Column:
    """Where an operation leads; a field is null where it stays and an array of its new value where it is set."""
    names = (*FIELDS, "superseded_seq")
    values = [F.array(sets[n]) if n in sets else F.lit(None) for n in names]
    return F.struct(F.lit(to).alias("to"), F.lit(rejected).alias("rejected"), *(v.alias(n) for v, n in zip(values, names, strict=True))).cast(EFFECT)


def operation(op: Column, seq: Column, patch: dict[str, Column]) -> Column:
    """An operation as a function: an effect for each state that a fact may be in.

    ASSERT makes an absent fact; UPDATE sets the fields it has a value for of an active one; INVALIDATE closes an active one
    at ``valid_to`` and records its number; RETCON restates all fields of a fact that is or was there and makes it active.
    Anything else is rejected and leaves the fact as it is.
    """
    stay = [_effect(s, 1) for s in (ABSENT, ACTIVE, INVALIDATED)]
    whole = _effect(ACTIVE, superseded_seq=F.lit(None), **patch)
    some = _effect(ACTIVE)
    for n in FIELDS:
        some = some.withField(n, F.when(patch[n].isNotNull(), F.array(patch[n])))
    close = _effect(INVALIDATED, valid_to=patch["valid_to"], superseded_seq=seq)
    by = {"ASSERT": [whole, *stay[1:]], "UPDATE": [stay[0], some, stay[2]], "INVALIDATE": [stay[0], close, stay[2]], "RETCON": [stay[0], whole, whole]}
    out = F.array(*stay)
    for name, effects in by.items():
        out = F.when(op == name, F.array(*effects)).otherwise(out)
    return out


def compose_effects(first: Column, then: Column) -> Column:
    """One operation behind the other: for each start, what the second does to where the first leads."""

    def on(e: Column) -> Column:
        x = lambda n: F.get(then, e["to"])[n]
        fields = [F.coalesce(x(n), e[n]).alias(n) for n in (*FIELDS, "superseded_seq")]
        return F.struct(x("to").alias("to"), (e["rejected"] + x("rejected")).alias("rejected"), *fields)

    return F.transform(first, on)


def replay(log: DataFrame, until: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """State of every fact after the operations up to a number: fact_id, status, the fields, superseded_seq, rejected.

    ``log(seq, op, fact_id, object_literal, valid_from, valid_to, confidence)`` is append-only and numbered without repeats.
    Facts that nothing made are there with the status ``absent``, so that what was rejected can be told; rows without a
    number or fact are left out; an empty log has no facts.
    """
    known = log.where("seq is not null and fact_id is not null")
    if until is not None:
        known = known.where(F.col("seq") <= until)
    steps = known.select("fact_id", "seq", operation(F.coalesce("op", F.lit("")), F.col("seq"), {n: F.col(n) for n in FIELDS}).alias("f"))
    folded = ordered_fold(steps, ["fact_id"], "seq", compose_effects, stretch).select("fact_id", F.get("f", F.lit(ABSENT)).alias("e"))
    status = F.element_at(F.array(*(F.lit(s) for s in ("absent", "active", "invalidated"))), F.col("e.to") + 1)
    return folded.select("fact_id", status.alias("status"), *(F.get(F.col(f"e.{n}"), F.lit(0)).alias(n) for n in (*FIELDS, "superseded_seq")), "e.rejected")


# --- commitments -------------------------------------------------------------------------------------------------------

STATES = ("planted", "triggered", "paid_off", "broken")


def move(to: Column, at: Column) -> Column:
    """A move as a function over ``STATES``: where it leads, how often it was not allowed, and where first."""

    def of(state: str) -> Column:
        ok = F.coalesce(to.isin(*(b for a, b in COMMITMENT_MOVES if a == state)), F.lit(False))
        goes = F.when(ok, F.array_position(F.array(*(F.lit(s) for s in STATES)), to).cast("int") - 1).otherwise(STATES.index(state))
        return F.struct(goes.alias("to"), (~ok).cast("long").alias("illegal"), F.when(~ok, at.cast("long")).alias("first"))

    return F.array(*(of(s) for s in STATES))


def compose_moves(first: Column, then: Column) -> Column:
    def on(e: Column) -> Column:
        x = lambda n: F.get(then, e["to"])[n]
        return F.struct(x("to").alias("to"), (e["illegal"] + x("illegal")).alias("illegal"), F.coalesce(e["first"], x("first")).alias("first"))

    return F.transform(first, on)


def boundary_report(planted: DataFrame, moves: DataFrame, boundary: int, stretch: int = STRETCH) -> DataFrame:
    """Commitments planted by a chapter, as they stand there: id, state, open, waits (chapters since planting, where open),
    n_moves, n_illegal, first_illegal (number of the first move that was not allowed).

    ``planted(id, planted_at)`` has one row for each commitment, ``moves(id, seq, chapter, to)`` numbers that do not repeat
    within one.  A move that is not allowed changes nothing; moves before the planting are not allowed either; moves of
    commitments that nobody planted are left out.
    """
    here = planted.where(F.col("planted_at") <= boundary)
    due = moves.where((F.col("chapter") <= boundary) & F.col("seq").isNotNull()).join(here.select("id", "planted_at"), "id")
    # a move to nowhere is allowed from no state
    to = F.when(F.col("chapter") >= F.col("planted_at"), F.col("to"))
    steps = due.select("id", "seq", move(to, F.col("seq")).alias("f"))
    folded = ordered_fold(steps, ["id"], "seq", compose_moves, stretch).select("id", F.get("f", F.lit(0)).alias("e"))
    count = steps.groupBy("id").agg(F.count("*").alias("n_moves"))
    state = F.element_at(F.array(*(F.lit(s) for s in STATES)), F.coalesce("e.to", F.lit(0)) + 1)
    out = here.join(folded, "id", "left").join(count, "id", "left").withColumn("state", state)
    is_open = F.col("state").isin(*OPEN_COMMITMENTS)
    return out.select(
        "id",
        "state",
        is_open.alias("open"),
        F.when(is_open, F.lit(boundary) - F.col("planted_at")).alias("waits"),
        F.coalesce("n_moves", F.lit(0)).alias("n_moves"),
        F.coalesce("e.illegal", F.lit(0)).alias("n_illegal"),
        F.col("e.first").alias("first_illegal"),
    )


# --- curation and adjudication -----------------------------------------------------------------------------------------


def curate(candidates: DataFrame, threshold: float) -> DataFrame:
    """Candidates by confidence: active from the threshold on, quarantined below it and where there is none."""
    return candidates.withColumn("status", F.when(F.col("confidence") >= threshold, "active").otherwise("quarantined"))


def adjudicate(facts: DataFrame, keys: list[str], says: str = "says") -> DataFrame:
    """A verdict for each fact ``(id, *keys, says, tier, confidence)``: kept, outranked, or quarantined.

    Of a key, what the best tier (the smallest) says with the highest confidence holds.  Where several different things are
    said on that rank, all of them are quarantined: nothing decides between them.  Facts that agree with what holds are kept,
    whatever their rank.  Nulls rank last.  The order of rows plays no part: a maximum and two bounds per key are combined
    map-side and joined back.
    """
    rank = F.struct(-F.coalesce("tier", F.lit(2**31 - 1)), F.coalesce("confidence", F.lit(float("-inf"))))
    f = facts.withColumn("__rank", rank)
    best = f.groupBy(*keys).agg(F.max("__rank").alias("__best"))
    top = f.join(best, keys).where(F.col("__rank") == F.col("__best"))
    said = top.groupBy(*keys).agg(F.min(says).alias("__lo"), F.max(says).alias("__hi"))
    out = f.join(best, keys).join(said, keys)
    is_top, torn = F.col("__rank") == F.col("__best"), F.col("__lo") != F.col("__hi")
    verdict = F.when(torn & is_top, "quarantined").when(torn, "outranked").when(F.col(says).eqNullSafe(F.col("__lo")), "kept").otherwise("outranked")
    return out.withColumn("verdict", verdict).select(*facts.columns, "verdict")
