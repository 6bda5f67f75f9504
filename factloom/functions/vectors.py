"""Hashing embedder and cosine similarity."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Width and gram size of the embedder.
WIDTH = 256
GRAM = 3


class _Places(dict):
    """Twice the bucket of a gram, and one more where its sign is negative."""

    def __missing__(self, gram: str) -> int:
        digest = hashlib.sha256(gram.encode()).digest()
        found = self[gram] = 2 * digest[7] + digest[8] % 2
        return found


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def embed(s: pd.Series) -> pd.Series:
    """Signed hashing of grams into ``WIDTH`` buckets, of unit length; zeros for an empty text.

    The bucket is the eighth byte of the gram's SHA-256 (the first eight bytes modulo 256), the sign the parity of the
    ninth.  Counting into an array that changes is beyond built-in functions short of a pass per bucket, so this runs on
    Arrow batches, with the grams met before in mind.
    """
    places = _Places()

    def vector(x: str | None) -> np.ndarray:
        t = (x or "").strip().lower()
        if not t:
            return np.zeros(WIDTH)
        grams = [t] if len(t) <= GRAM else [t[k : k + GRAM] for k in range(len(t) - GRAM + 1)]
        n = np.bincount(list(map(places.__getitem__, grams)), minlength=2 * WIDTH)
        out = (n[::2] - n[1::2]).astype(np.float64)
        norm = np.sqrt((out * out).sum())
        return out / norm if norm else out

    return s.map(vector)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either length is 0; vectors of different widths are an error."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms > 0, dot(a, b) / F.nullif(norms, F.lit(0.0))).otherwise(0.0)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in width")).cast("double")).otherwise(value)
