"""Schemas of the canonical tables and the closed value lists of their columns."""

from __future__ import annotations

from pyspark.sql import types as T

SCOPE = T.ArrayType(T.StructType([T.StructField("knower", T.StringType()), T.StructField("learned_at", T.IntegerType())]))
PROVENANCE = T.StructType([T.StructField("source_id", T.StringType()), T.StructField("chapter", T.IntegerType()), T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()), T.StructField("quote", T.StringType())])
FACT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("fork_id", T.StringType()),
        T.StructField("subject_id", T.LongType()),
        T.StructField("predicate", T.StringType()),
        T.StructField("object_id", T.LongType()),
        T.StructField("object_literal", T.StringType()),
        T.StructField("valid_from", T.IntegerType()),
        T.StructField("valid_to", T.IntegerType()),
        T.StructField("revealed_at", T.IntegerType()),
        T.StructField("assertion_mode", T.StringType()),
        T.StructField("attributed_to", T.StringType()),
        T.StructField("knower_scope", SCOPE),
        T.StructField("provenance", PROVENANCE),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("tier", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("recorded_at", T.TimestampNTZType()),
        T.StructField("superseded_at", T.TimestampNTZType()),
    ]
)
FORK = T.StructType([T.StructField("id", T.StringType()), T.StructField("parent_fork_id", T.StringType()), T.StructField("divergence_at", T.IntegerType()), T.StructField("source_id", T.StringType()), T.StructField("label", T.StringType())])
EPISODE = T.StructType([T.StructField("seq", T.LongType()), T.StructField("series_id", T.StringType()), T.StructField("episode_number", T.IntegerType()), T.StructField("synopsis", T.StringType()), T.StructField("character_actions", T.MapType(T.StringType(), T.StringType())), T.StructField("events", T.ArrayType(T.StringType())), T.StructField("emotional_beat", T.StringType())])

# Names that data written elsewhere also uses.
STATUSES = ("active", "invalidated", "quarantined")
MODES = ("narrated", "attributed")
AUDIENCE, NARRATOR = "audience", "narrator"
GRADES = ("active", "silent", "referenced")
INCAPACITATED = ("dead", "destroyed", "imprisoned")
COMMITMENT_MOVES = (("planted", "triggered"), ("planted", "broken"), ("triggered", "paid_off"), ("triggered", "broken"))
OPEN_COMMITMENTS = ("planted", "triggered")
