"""Guarded similarity search."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.guard import is_visible
from factloom.functions.vectors import cosine, embed
from factloom.operators.chunks import chunks
from factloom.sources.shared import written


def search(vectors: DataFrame, fork: str, query: Column, knower: str, chapter: int, k: int) -> DataFrame:
    """The ``k`` best of one fork that the knower may see: fact_id, score.

    The guard filters before the limit; the limit is a top-k per partition and a merge.
    """
    if k < 1:
        raise ValueError("k must be positive")
    seen = vectors.where((F.col("fork_id") == fork) & is_visible(knower, chapter))
    return seen.select("fact_id", cosine(F.col("vector"), query).alias("score")).orderBy(F.desc("score"), "fact_id").limit(k)


#: Parts that the vectors of a key are dealt into at least, the vectors that a part has on average at most, queries scored at
#: once, and what sums in another order may differ by.
PARTS, PART_ROWS, BLOCK, SLACK = 16, 20_000, 256, 1e-9


def _matrix(c: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; one that is null, or has a null in it, scores as one without a length does."""
    flat = pc.list_flatten(c)
    if not c.null_count and not flat.null_count and len(c) and len(flat) % len(c) == 0 and pc.all(pc.equal(pc.list_value_length(c), len(flat) // len(c))).as_py():
        return flat.to_numpy().reshape(len(c), -1)
    rows = c.to_pylist()
    widths = {len(r) for r in rows if r is not None}
    if len(widths) > 1:
        raise ValueError("vectors differ in width")
    none = [0.0] * (widths.pop() if widths else 0)
    return np.array([none if r is None or None in r else r for r in rows], np.float64).reshape(len(rows), -1)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from left to right as ``vectors.dot`` does."""
    return np.add.accumulate(a * b, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))


def nearest(rows: DataFrame, asked: DataFrame, keys: list[str], k: int, id_col: str = "fact_id", vector_col: str = "vector") -> DataFrame:
    """Of each of ``asked(*keys, query_id, query)`` all rows with equal keys that may be among its ``k`` best: query_id, the id
    and the score.  What is left out is beaten by ``k`` others of its part; exact scores decide among the rest.

    Rows are dealt into parts, queries are repeated per part, and a part is one product of matrices.
    """
    parts = max(PARTS, -(-rows.count() // PART_ROWS))
    known = lambda df: df.where(reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in keys)))
    # both sides may come from one table, so the columns that they are grouped by are named anew
    left = known(rows).select(*(F.col(c).alias(f"row_{c}") for c in keys), F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int").alias("row_part"), id_col, vector_col)
    right = known(asked).select(*(F.col(c).alias(f"ask_{c}") for c in keys), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("ask_part"), "query_id", "query")
    kinds = pa.schema([("query_id", pa.int64()), (id_col, pa.int64()), ("score", pa.float64())])

    def best(v: pa.Table, q: pa.Table) -> pa.Table:
        if not v.num_rows or not q.num_rows:
            return kinds.empty_table()
        v = v.sort_by(id_col)
        x, y = _matrix(v.column(vector_col)), _matrix(q.column("query"))
        ids, of = v.column(id_col).to_numpy(), q.column("query_id").to_numpy()
        if x.any() and y.any() and x.shape[1] != y.shape[1]:
            raise ValueError("vectors differ in width")
        # of equal vectors those with the smallest ids decide
        _, same = np.unique(x, axis=0, return_inverse=True)
        by = np.argsort(same.ravel(), kind="stable")
        s = same.ravel()[by]
        place = np.arange(len(s)) - np.searchsorted(s, s)
        keep = np.sort(by[place < k])
        x, ids = x[keep], ids[keep]
        long, wide = np.sqrt(_dot(x, x)), np.sqrt(_dot(y, y))
        out: list[tuple[np.ndarray, ...]] = []
        for lo in range(0, len(y), BLOCK):
            b = y[lo : lo + BLOCK]
            norms = wide[lo : lo + BLOCK, None] * long[None, :]
            near = np.divide(b @ x.T, norms, out=np.zeros_like(norms), where=norms != 0) if x.shape[1] == b.shape[1] else np.zeros_like(norms)
            near[np.isnan(near)] = np.inf
            floor = np.partition(near, -k, axis=1)[:, -k] - SLACK if near.shape[1] > k else np.full(len(b), -np.inf)
            n, m = np.nonzero(near >= floor[:, None])
            scale = norms[n, m]
            score = np.divide(_dot(x[m], b[n]) if x.shape[1] == b.shape[1] else np.zeros(len(n)), scale, out=np.zeros(len(n)), where=scale != 0)
            out.append((of[lo + n], ids[m], score))
        query, found, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array(query), pa.array(found), pa.array(score)], schema=kinds)

    by_part = lambda df, side: df.groupBy(*(f"{side}_{c}" for c in (*keys, "part")))
    return by_part(left, "row").cogroup(by_part(right, "ask")).applyInArrow(best, f"query_id long, {id_col} long, score double")


def search_many(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The same for a stated set of ``queries(query_id, fork_id, knower, chapter, query)``: a rank per query, pruned before
    the shuffle.

    The guard is asked once for each knower and chapter that queries name, before anything is scored.
    """
    if k < 1:
        raise ValueError("k must be positive")
    keys = ["fork_id", "knower", "chapter"]
    asking = written(queries.select(*keys).distinct(), "asking")
    seen = vectors.join(asking, "fork_id").where(is_visible(F.col("knower"), F.col("chapter")))
    scored = nearest(seen, queries, keys, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "fact_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def upsert(vectors: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The index after adding (an id replaces its row) and removing (again and again if need be)."""
    gone = added.select("fact_id").unionByName(removed.select("fact_id")).distinct()
    return vectors.join(gone, "fact_id", "left_anti").unionByName(added.join(removed.select("fact_id"), "fact_id", "left_anti"))


def retrieve(docs: DataFrame, id_col: str, text_col: str, question: str, k: int, size: int = 1000, overlap: int = 200, embedder: Callable[[Column], Column] = embed) -> DataFrame:
    """Chunks of documents most similar to a question, with their offsets; any embedder of a column will do."""
    index = chunks(docs, id_col, text_col, size, overlap)
    asked = index.sparkSession.range(1).select(embedder(F.lit(question)).alias("q")).first()["q"]
    near = cosine(embedder(F.col("quote")), F.array(*(F.lit(x) for x in asked)))
    # sums in another order differ in the last places: chunks that only they tell apart stand in order
    scored = index.select("id", "chunk", "char_start", "char_end", F.round(near, 12).alias("score"))
    return scored.orderBy(F.desc("score"), "id", "chunk").limit(k)
