"""Streams whose result is that of the batch, whatever order rows arrive in.

``settle``: of equal texts the one that comes first in the order of the works stays.  Arrival is another order, so a text that
was kept is taken back when an earlier copy of it comes: the state of a fingerprint is the place of its keeper.

``replayed``: operations on facts arrive as they are numbered (within a batch in any order); the state of a fact is what its
operations made of it, and each batch gives the facts that it touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FATES = "print string, place long, fate string"
FACTS = "fact_id long, seq long, status string, object_literal string, valid_from int, valid_to int, confidence double, superseded_seq long, rejected long"
FIELDS = ("object_literal", "valid_from", "valid_to", "confidence")


def settle(chapters: DataFrame, forget_after: str | None = None) -> DataFrame:
    """``chapters(print, place)``, streaming, to changes (print, place, fate): kept or duplicate.

    A place may appear again when its fate changes.  Repeats of the keeper's own place say nothing new.  With
    ``forget_after`` (milliseconds) a fingerprint that was silent for so long is forgotten, and its next copy is kept.
    """

    def meet(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = was = state.get[0] if state.exists else None
        for rows in parts:
            # what loses is told at once, so only the keeper is held
            for place in rows["place"]:
                place = int(place)
                if best is None or place < best:
                    if best is not None:
                        yield pd.DataFrame({"print": [key[0]], "place": [best], "fate": ["duplicate"]})
                    best = place
                elif place > best:
                    yield pd.DataFrame({"print": [key[0]], "place": [place], "fate": ["duplicate"]})
        if best != was:
            state.update((best,))
            yield pd.DataFrame({"print": [key[0]], "place": [best], "fate": ["kept"]})
        if forget_after is not None:
            state.setTimeoutDuration(int(forget_after))

    timeout = GroupStateTimeout.NoTimeout if forget_after is None else GroupStateTimeout.ProcessingTimeTimeout
    known = chapters.where("print is not null and place is not null").select("print", "place")
    return known.groupBy("print").applyInPandasWithState(meet, FATES, "place long", "update", timeout)


def write(changes: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each batch's changes with its number; a batch that is done again replaces what it wrote."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if once else writer).start()


def settled(spark: SparkSession, path: str) -> DataFrame:
    """The fate of every place: what the last batch that spoke of it says; within a batch, what it was left with."""
    told = spark.read.parquet(path)
    # inside one batch a place is kept, or lost to an earlier one: lost is later, but a keeper is told last and only once
    last = F.max_by("fate", F.struct("batch", (F.col("fate") == "duplicate").cast("int")))
    return told.groupBy("print", "place").agg(last.alias("fate"))


def step(state: dict, op: dict) -> dict:
    """State of a fact after one more operation; what may not be leaves it alone and is counted."""
    out, status, kind = dict(state), state["status"], op["op"]
    if (kind == "ASSERT" and status == "absent") or (kind == "RETCON" and status != "absent"):
        return out | {n: op[n] for n in FIELDS} | {"status": "active", "superseded_seq": None}
    if kind == "UPDATE" and status == "active":
        return out | {n: op[n] for n in FIELDS if op[n] is not None}
    if kind == "INVALIDATE" and status == "active":
        return out | {"status": "invalidated", "valid_to": op["valid_to"], "superseded_seq": op["seq"]}
    return out | {"rejected": out["rejected"] + 1}


def replayed(log: DataFrame) -> DataFrame:
    """``log(seq, op, fact_id, ...)``, streaming, to the facts that each batch touched, as they are then.

    An operation whose number the fact has already passed fails the query: the log is append-only.
    """
    names = ["seq", "status", *FIELDS, "superseded_seq", "rejected"]

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(names, state.get, strict=True)) if state.exists else {"seq": -1, "status": "absent", **dict.fromkeys(FIELDS), "superseded_seq": None, "rejected": 0}
        rows = pd.concat(list(parts)).sort_values("seq")
        for row in rows.to_dict("records"):
            op = {k: None if pd.isna(v) else v for k, v in row.items()}
            op = op | {n: int(op[n]) for n in ("seq", "valid_from", "valid_to") if op[n] is not None}
            if op["seq"] <= now["seq"]:
                raise ValueError(f"operation {op['seq']} of fact {key[0]} comes after {now['seq']}")
            now = step(now, op) | {"seq": op["seq"]}
        state.update(tuple(now[n] for n in names))
        out = pd.DataFrame([{"fact_id": key[0], **now}])
        yield out.astype({"valid_from": "Int32", "valid_to": "Int32", "superseded_seq": "Int64"})[["fact_id", *names]]

    kept = ", ".join(FACTS.split(", ")[1:])
    known = log.where("seq is not null and fact_id is not null")
    return known.groupBy("fact_id").applyInPandasWithState(fold, FACTS, kept, "update", GroupStateTimeout.NoTimeout)
