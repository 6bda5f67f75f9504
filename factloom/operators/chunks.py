"""Overlapping chunks with exact offsets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# Sizes, and where a chunk may end early.
SIZE, OVERLAP = 1000, 200
HALF = 0.5
SPAN = "array<struct<char_start:int,char_end:int,quote:string>>"


def cut(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Offsets of chunks: up to ``size`` characters, back to the last full stop or line end if past the middle, trimmed;
    the next chunk begins ``overlap`` before the end."""
    lo, n = 0, len(text)
    while lo < n:
        hi = min(lo + size, n)
        if hi < n:
            last = max(text.rfind(".", lo, hi), text.rfind("\n", lo, hi))
            if last > lo + size * HALF:
                hi = last + 1
        body = text[lo:hi]
        if body.strip():
            first = lo + len(body) - len(body.lstrip())
            yield first, first + len(body.strip())
        if hi == n:
            return
        lo = max(hi - overlap, lo + 1)


def check(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("a chunk needs a positive size and a smaller, non-negative overlap")


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row per chunk: id, chunk, char_start, char_end, quote.  Where a chunk ends depends on where the one before it
    did, so each text is walked once, in Arrow batches."""
    check(size, overlap)

    @F.pandas_udf(SPAN)
    def spans(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"char_start": a, "char_end": b, "quote": t[a:b]} for a, b in cut(t, size, overlap)] if isinstance(t, str) else [])

    return docs.select(F.col(id_col).alias("id"), F.posexplode(spans(F.col(text_col))).alias("chunk", "s")).select("id", "chunk", "s.*")


def register(spark: SparkSession, name: str = "chunk_text") -> None:
    """The same as a table function for SQL: ``chunk_text(text, size, overlap)``."""

    @udtf(returnType="char_start int, char_end int, quote string")
    class ChunkText:
        def eval(self, text: str, size: int, overlap: int):
            check(size, overlap)
            for a, b in cut(text or "", size, overlap):
                yield a, b, text[a:b]

    spark.udtf.register(name, ChunkText)
