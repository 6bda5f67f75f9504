"""Prefix trie of conversations from mergeable partial tries.

A conversation is a sequence of turns (role, text); each distinct sequence of first turns is a node, known by a digest that
chains the digests of its turns, so equal prefixes meet under equal keys wherever they are read.  Texts are read once, for
their digests and numbers of words, and never shuffled.

1. Partitions fold their conversations into partial tries: per node the smallest member, the number of members, and the
   members that end there.  A partial trie that grows beyond ``NODES`` nodes is handed on and begun anew.
2. Partial node tables merge by key in rounds, ``FAN`` tables into one at a time, so that a node of all partitions (the root)
   never meets more than ``FAN`` rows of a sender at once.  Lists of ends merge under (key, stretch of ids): ids are distinct,
   so a merged list holds at most ``STRETCH`` of them, however many conversations are equal.
3. Roll-up from the leaves: with doubling strides, every node hands its sums to its ancestor one, two, four, ... levels up,
   so a chain of any depth takes a logarithmic number of rounds.  An ancestor's key is known to the partial trie already.

The digest of a node's ends reads its stretches in order and keeps only the state of the hash.

Rebuilding (``rebuild``) gives conversation c the first h(c) turns of conversation c - c % 20, then its own turns after its
first h(c), with h the crc32 of the decimal id modulo 4; only turns numbered below 3 travel from one to another.

Defined results: turns go by their number, null first, and equal numbers by role, then digest; null roles and texts are empty;
turns without a conversation id belong to no conversation and are left out; repeated rows are repeated turns; an empty table
gives an empty table, otherwise there is one root; further columns, whatever their names, are ignored.  A conversation is held
by one task at a time, as its digests chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.batches import trimmed
from factloom.llm.store import Scratch

NODES = 200_000
FAN = 32
STRETCH = 1 << 14
DONORS, SHARED = 20, 4
#: A parent with more children than this part of all nodes counts as hot; there are at most as many of them.
HOT = 1_000
ROOT = hashlib.blake2b(b"", digest_size=16).digest()
WORD = r"[^\x20\x09-\x0D]+"
PARTIAL = "key binary, stretch long, depth long, up array<binary>, turn binary, words long, conv_id long, n_convs long, ends array<long>"
TURNS = "array<struct<turn:binary,words:long>>"


def digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn."""
    return F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256), 1, 32))


def sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns): each conversation with its turns in order, as digests and numbers of words."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"),
        F.col(turn_col).cast("long").alias("at"),
        text(role_col).alias("role"),
        digest(text(role_col), text(text_col)).alias("turn"),
        F.regexp_count(text(text_col), F.lit(WORD)).cast("long").alias("words"),
    )
    # nulls come first in an ascending sort of structs
    own = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", "role", "turn", "words"))).alias("turns"))
    return own.select("conv", F.transform("turns", lambda t: F.struct(t["turn"].alias("turn"), t["words"].alias("words"))).alias("turns"))


def rebuild(own: DataFrame) -> DataFrame:
    """Every conversation of ``own(conv, turns)`` with the turns that it takes from its donor in front."""
    shared = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(SHARED)).cast("int")
    taken = own.select("conv", "turns", (F.col("conv") - F.col("conv") % DONORS).alias("donor"), shared.alias("shared"))
    first = own.where(F.col("conv") % DONORS == 0).select(F.col("conv").alias("donor"), F.slice("turns", 1, SHARED - 1).alias("first"))
    both = taken.join(first, "donor", "left")
    head = F.coalesce(F.slice("first", F.lit(1), F.col("shared")), F.array().cast(TURNS))
    tail = F.slice("turns", F.col("shared") + 1, F.size("turns"))
    return both.select("conv", F.concat(head, tail).alias("turns"))


def _partial(most: int, stretch_size: int):
    """Partial tries of a partition's conversations.  Rows without a stretch are nodes, the others lists of ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"binary": pa.binary(), "long": pa.int64(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in PARTIAL.split(", "))])
        nodes: dict[bytes, list] = {}
        ends: dict[tuple[bytes, int], list[int]] = {}

        def give() -> Iterator[pa.RecordBatch]:
            rows = [(key, None, *n, []) for key, n in nodes.items()]
            rows += [(key, stretch, 0, [], b"", 0, ids[0], 0, ids) for (key, stretch), ids in ends.items()]
            for i in range(0, len(rows), 20_000):
                columns = zip(*rows[i : i + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            nodes.clear()
            ends.clear()

        def visit(path: list[bytes], conv: int, turn: bytes, words: int) -> None:
            n = nodes.get(path[-1])
            if n is None:
                depth = len(path) - 1
                up = [path[depth - (1 << k)] for k in range(depth.bit_length())]
                nodes[path[-1]] = [depth, up, turn, words, conv, 1]
            else:
                n[4] = min(n[4], conv)
                n[5] += 1

        for b in batches:
            for conv, turns in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                path = [ROOT]
                visit(path, conv, b"", 0)
                for t in turns.as_py():
                    path.append(hashlib.blake2b(path[-1] + t["turn"], digest_size=16).digest())
                    visit(path, conv, t["turn"], t["words"])
                ends.setdefault((path[-1], conv // stretch_size), []).append(conv)
                if len(nodes) > most:
                    yield from give()
        yield from give()

    return run


def _merged(partial: DataFrame, *keys: str) -> DataFrame:
    """Partial tries with equal keys added up; what describes a node is the same in all of them."""
    same = [F.first(c).alias(c) for c in ("depth", "up", "turn", "words")]
    return partial.groupBy("key", "stretch", *keys).agg(*same, F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.flatten(F.collect_list("ends")).alias("ends"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of each node's ends, from its stretches in order."""
    now, state = None, None

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    for b in batches:
        for key, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            said = ",".join(map(str, sorted(ids))).encode()
            if key == now:
                state.update(b"," + said)
                continue
            if now is not None:
                yield closed()
            now, state = key, hashlib.sha256(said)
    if now is not None:
        yield closed()


def _parents(nodes: DataFrame, spark: SparkSession) -> DataFrame:
    """(key, parent_conv_id); the few parents with very many children are looked up in a broadcast table."""
    up = nodes.where("depth > 0").select("key", F.get("up", F.lit(0)).alias("parent"))
    named = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    per = up.groupBy("parent").agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(1), F.lit(nodes.count() // HOT))
    # children are fewer than nodes, so at most HOT parents have more than a HOT-th of them
    hot = F.broadcast(per.where(F.col("n") > least).join(named, "parent").select("parent", "parent_conv_id"))
    return up.join(hot, "parent").select("key", "parent_conv_id").unionByName(up.join(hot, "parent", "left_anti").join(named, "parent").select("key", "parent_conv_id"))


def trie(spark: SparkSession, convs: DataFrame) -> DataFrame:
    """One row per node of ``convs(conv, turns)`` with distinct conv: key, turn (digest of its last turn), conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch(spark, "trie")
    part = F.spark_partition_id().cast("long")
    merged = scratch.keep(convs.select("conv", "turns").mapInArrow(trimmed(_partial(NODES, STRETCH)), PARTIAL).withColumn("sender", part), "partial")
    senders = (merged.agg(F.max("sender")).first()[0] or 0) + 1
    while senders > 1:
        senders = -(-senders // FAN)
        was = merged
        merged = scratch.keep(_merged(was.withColumn("sender", F.floor(F.col("sender") / FAN)), "sender"), "merged")
        scratch.drop(was)
    # a sender hands a trie on in parts, which its own rows may repeat
    whole = scratch.keep(_merged(merged), "trie")
    scratch.drop(merged)
    nodes = whole.where("stretch is null").select("key", "depth", "up", "turn", "words", "conv_id", "n_convs")
    ends = whole.where("stretch is not null").select("key", "stretch", "ends")
    digests = ends.repartition("key").sortWithinPartitions("key", "stretch").mapInArrow(trimmed(_digests), "key binary, ends_sha256 string")

    children = nodes.where("depth > 0").groupBy(F.get("up", F.lit(0)).alias("key")).agg(F.count("*").alias("n_children"))
    own = nodes.join(children, "key", "left").select("key", "depth", "up", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    rolled = scratch.keep(own.withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")), "rolled")
    deepest = rolled.agg(F.max("depth")).first()[0] or 0
    step, k = 1, 0
    while step <= deepest:
        # sums below a node reach ``step - 1`` levels deep; those of the nodes ``step`` levels below double that
        below = rolled.where(F.col("depth") >= step).groupBy(F.get("up", F.lit(k)).alias("key")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        after = rolled.join(below, "key", "left").select("key", "depth", "up", "n_children", (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"))
        after = scratch.keep(after, "rolled")
        scratch.drop(rolled)
        rolled, step, k = after, step * 2, k + 1
    sums = rolled.select("key", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    none = hashlib.sha256(b"").hexdigest()
    out = nodes.select("key", "turn", "conv_id", "depth", "n_convs").join(sums, "key").join(_parents(nodes, spark), "key", "left").join(digests, "key", "left")
    return out.select("key", "turn", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def with_texts(nodes: DataFrame, turns: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``nodes`` with role and text of the last turn of each; both are null at the root."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = turns.select(text(role_col).alias("role"), text(text_col).alias("text"))
    said = said.select(digest(F.col("role"), F.col("text")).alias("turn"), "role", "text")
    # equal turns are equal texts: one of each travels
    used = said.join(nodes.select("turn").distinct(), "turn", "left_semi").dropDuplicates(["turn"])
    return nodes.join(used, "turn", "left")
