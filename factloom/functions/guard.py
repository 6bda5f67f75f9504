"""Who may see a fact and when it holds: single definitions, as never-null boolean columns.

Every predicate is coalesced to false, so a filter and its negation split the rows in two.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.schema import INCAPACITATED, OPEN_COMMITMENTS


def _col(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def learned_at(knower: Column | str, scope: Column | str = "knower_scope", revealed_at: Column | str = "revealed_at") -> Column:
    """Chapter at which a knower acquired the fact: its first scope entry, or the reveal where nothing is tracked."""
    scope, revealed = (F.col(x) if isinstance(x, str) else x for x in (scope, revealed_at))
    own = F.get(F.filter(scope, lambda a: a["knower"] == _col(knower)), F.lit(0))["learned_at"]
    return F.when(scope.isNull(), revealed).otherwise(own)


def is_visible(knower: Column | str, chapter: Column | int) -> Column:
    """Not quarantined and acquired by then.  Story-time validity plays no part; invalidated facts stay visible."""
    return F.coalesce((F.col("status") != "quarantined") & (learned_at(knower) <= _col(chapter)), F.lit(False))


def is_known_by(knower: Column | str, chapter: Column | int) -> Column:
    return F.coalesce(learned_at(knower) <= _col(chapter), F.lit(False))


def is_revealed_by(chapter: Column | int) -> Column:
    return F.coalesce(F.col("revealed_at") <= _col(chapter), F.lit(False))


def is_valid_at(chapter: Column | int) -> Column:
    """Both ends inclusive; an open end holds for ever."""
    return F.coalesce((F.col("valid_from") <= _col(chapter)) & (F.col("valid_to").isNull() | (_col(chapter) <= F.col("valid_to"))), F.lit(False))


def is_foreshadowed() -> Column:
    return F.coalesce(F.col("revealed_at") < F.col("valid_from"), F.lit(False))


def is_open(state: Column) -> Column:
    return F.coalesce(state.isin(*OPEN_COMMITMENTS), F.lit(False))


def is_incapacitated(status: Column) -> Column:
    return F.coalesce(status.isin(*INCAPACITATED), F.lit(False))


def witnesses(roster: Column) -> Column:
    """Distinct roster members who are more than mentioned."""
    return F.array_distinct(F.transform(F.filter(roster, lambda p: p["grade"] != "referenced"), lambda p: p["entity_id"]))
