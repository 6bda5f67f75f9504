"""Associative retrieval in lanes over an inverted file of vectors, exact.

Vectors are dealt to the cells of a few centres; a cell knows the widest angle of its vectors to the centre.  By the triangle
inequality of angles no vector of a cell is nearer to a query than the query's angle to the centre less that.  A search
looks into the nearest cell first, which bounds the k-th best score from below, and then into the cells whose bound reaches
it; the others are skipped without a loss.  Lane and guard decide before any limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.vectors import cosine
from factloom.operators import retrieval
from factloom.sources.shared import written

#: Rows that the centres are fitted on, in the order of a hash of their ids, and the number of centres: the bound of what the
#: driver sees.  Every row is indexed.
SAMPLE, CELLS, ROUNDS = 4096, 32, 8
#: What rounding may add to an angle.
SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    """Rows with their ``cell``, and the cells: centre and the widest angle in it."""

    rows: DataFrame
    centres: np.ndarray
    widest: dict[int, float]


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres on the sphere: each a row far from those before it, then a few rounds of means."""
    x = _unit(sample)
    centres = [x[0]]
    near = x @ centres[0]
    for _ in range(min(cells, len(x)) - 1):
        centres.append(x[int(np.argmin(near))])
        near = np.maximum(near, x @ centres[-1])
    c = np.array(centres)
    for _ in range(ROUNDS):
        home = np.argmax(x @ c.T, axis=1)
        c = _unit(np.array([x[home == k].sum(axis=0) if (home == k).any() else c[k] for k in range(len(c))]))
    return c


def index(vectors: DataFrame, id_col: str = "ref_id", vector_col: str = "vector", cells: int = CELLS, sample: int = SAMPLE) -> Index:
    """Index every row of ``vectors``; rows without a vector are left out."""
    known = vectors.where(F.col(vector_col).isNotNull())
    order = F.xxhash64(F.col(id_col).cast("string"))
    some = known.orderBy(order, id_col).limit(sample).select(vector_col).collect()
    if not some:
        return Index(known.withColumn("cell", F.lit(0)), np.zeros((1, 1)), {})
    centres = _fit(np.array([r[0] for r in some], np.float64), cells)
    at = known.columns.index(vector_col)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _unit(np.array(b.column(at).to_pylist(), np.float64))
                near = x @ centres.T
                home = np.argmax(near, axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(x)), home], -1, 1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home.astype(np.int32)), pa.array(angle)], [*b.schema.names, "cell", "angle"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema.fields)
    rows = written(known.mapInArrow(deal, f"{fields}, cell int, angle double"), "cells")
    widest = {r["cell"]: r["a"] for r in rows.groupBy("cell").agg(F.max("angle").alias("a")).collect()}  # a row for each cell
    return Index(rows.drop("angle"), centres, widest)


def search(found: Index, queries: DataFrame, k: int, guard: Column | None = None, id_col: str = "ref_id", vector_col: str = "vector", lane_col: str = "lane") -> DataFrame:
    """The ``k`` best rows of each of ``queries(query_id, lane, query)`` in its lane: query_id, ref_id, score, rank, cells (looked
    into).  Queries are a stated set, counted by the caller; each sees only the cells that it has to."""
    if k < 1:
        raise ValueError("k must be positive")
    cells = [F.struct(F.lit(c).alias("cell"), F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine(F.col("query"), F.array(*(F.lit(float(x)) for x in found.centres[c])))))).alias("angle"), F.lit(float(w)).alias("widest")) for c, w in sorted(found.widest.items())]
    none = F.array().cast("array<struct<cell:int,angle:double,widest:double>>")
    asked = queries.select("query_id", F.col("lane").alias("its_lane"), "query", (F.array(*cells) if cells else none).alias("cells"))
    # the best that any vector of a cell may score
    bound = lambda x: F.cos(F.greatest(F.lit(0.0), x["angle"] - x["widest"] - SLACK))
    asked = written(asked.select("query_id", "its_lane", "query", F.transform("cells", lambda x: F.struct((-bound(x)).alias("less"), x["angle"].alias("angle"), x["cell"].alias("cell"))).alias("cells")), "asked")
    seen = found.rows if guard is None else found.rows.where(guard)

    def scored(looks: DataFrame) -> DataFrame:
        rows = seen.select(F.col(lane_col).alias("its_lane"), F.col("cell").alias("look"), F.col(id_col).alias("ref_id"), F.col(vector_col).alias("vector"))
        return retrieval.nearest(rows, looks, ["its_lane", "look"], k, "ref_id")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ref_id"))
    best = lambda df: df.withColumn("rank", rank).where(F.col("rank") <= k)
    nearest = F.get(F.sort_array(F.transform("cells", lambda x: F.struct(x["angle"], x["cell"]))), F.lit(0))["cell"]
    first = written(best(scored(asked.select("query_id", "its_lane", "query", nearest.alias("look")))).drop("rank"), "nearest")
    floor = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    reach = asked.join(floor, "query_id", "left").withColumn("least", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(-2.0)))
    wanted = F.filter("cells", lambda x: (-x["less"] >= F.col("least") - SLACK) & (x["cell"] != nearest))
    reach = reach.select("query_id", "its_lane", "query", F.transform(wanted, lambda x: x["cell"]).alias("looks"))
    more = scored(reach.select("query_id", "its_lane", "query", F.explode("looks").alias("look")))
    told = reach.select("query_id", (F.size("looks") + 1).alias("cells"))
    return best(first.unionByName(more)).join(told, "query_id")
