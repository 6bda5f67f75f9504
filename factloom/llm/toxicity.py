"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding maps homoglyphs (Cyrillic, Greek, full-width letters) to the letters they imitate and digits and signs to the
letters they replace, lower-cases, and reduces the text to its words joined by single spaces.  A pattern is a word or the
start of a word, anchored by a space in front; the automaton finds all of them in one pass over the text.  Matches that
lie inside an exception phrase do not count.  The weights of the matches are summed and set against the number of
words; a logistic curve turns density and sum into a score between 0 and 1.

The lexicon, the exception phrases and the curve are fitted on labelled rows of the training part only, at most
``SAMPLE_ROWS`` of them taken in the order of a hash of their ids (a documented bound: a lexicon of ``LEXICON`` entries gains
nothing from more).  An exception phrase is a pair of neighbouring words with a lexicon word in it that training texts use
the other way round: in ``EXCEPT`` texts or more that are not toxic, and in no larger a share of the toxic ones.  Scoring runs
over every row and whole texts.

Defined results: null and empty texts have no match and get the curve's value at zero; without labelled toxic rows the
lexicon is empty and every score is the smoothed share of toxic labels, 0 where there is no label at all; repeated label
rows count once, toxic if any of them says so; of documents that repeat a labelled id, one text is learned from (the one with
the largest hash); label and document columns beyond those named are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.batches import slices_of, trimmed
from factloom.llm.store import Scratch

SAMPLE_ROWS = 20_000
LEXICON = 256
PREFIXES = (4, 5, 6, 7)
#: Texts that are not toxic and use a pair of words, for the pair to be an exception.
EXCEPT = 5
#: Look-alikes of Latin letters: Cyrillic, Greek, then digits and signs used in place of letters.
HOMOGLYPHS = dict(zip("асеорхуіјѕԁһԛԝкмтвнгΑΒΕΖΗΙΚΜΝΟΡΤΥΧαβεικνορτυχ", "aceopxyijsdhqwkmtbhrabezhikmnoptyxabeikvoptux", strict=True))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
FOLD = {ord(a): b for a, b in (HOMOGLYPHS | SUBSTITUTES).items()} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {0xFF21 + i: chr(97 + i) for i in range(26)} | {0x200B: None, 0x200C: None, 0x200D: None, 0xAD: None}
WORDS = re.compile(r"\w+")


def fold(text: str | None) -> list[str]:
    """Folded words of a text."""
    return WORDS.findall((text or "").lower().translate(FOLD))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)
    exceptions: tuple[str, ...] = ()

    def automaton(self) -> ahocorasick.Automaton | None:
        a = ahocorasick.Automaton()
        for p, w in self.weights.items():
            a.add_word(p, (len(p), w))
        for e in self.exceptions:
            a.add_word(f" {e} ", (len(e) + 2, None))
        if not len(a):
            return None
        a.make_automaton()
        return a


def features(words: list[str], automaton: ahocorasick.Automaton | None) -> tuple[float, float]:
    """Logarithms of the weighted matches per 100 words and of their sum."""
    if not words or automaton is None:
        return 0.0, 0.0
    hits, spared = [], []
    for end, (n, w) in automaton.iter(f" {' '.join(words)} "):
        if w is None:
            spared.append((end - n + 1, end))
        else:
            hits.append((end - n + 1, end, w))
    if spared and hits:
        # of the exceptions that begin at or before a match, the one that reaches farthest tells whether it is inside
        spared.sort()
        opens, reach = [lo for lo, _ in spared], list(accumulate((hi for _, hi in spared), max))
        hits = [h for h in hits if not (k := bisect_right(opens, h[0])) or reach[k - 1] < h[1]]
    total = sum(h[2] for h in hits)
    return math.log1p(100 * total / len(words)), math.log1p(total)


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _patterns(words: set[str]) -> set[str]:
    found = {f" {w} " for w in words if len(w) > 2}
    for k in PREFIXES:
        found.update([f" {w[:k]}" for w in words if len(w) >= k])
    return found


#: patterns that a worker counts before it hands them on
COUNTED = 200_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class with a pattern, and its occurrences in each class, in parts that bound memory."""

    def part() -> pa.RecordBatch:
        spread: tuple[Counter, Counter] = (Counter(), Counter())
        for c in (0, 1):
            for w, k in uses[c].items():
                for p in _patterns({w}):
                    spread[c][p] += k
            # the totals travel as the empty pattern
            docs[c][""], spread[c][""] = n[c], words_of[c]
        keys = list(docs[0].keys() | docs[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[p] for p in keys], pa.int64()) for c in (*docs, *spread))], ["pattern", "d0", "d1", "u0", "u1"])

    fresh = lambda: ((Counter(), Counter()), (Counter(), Counter()), [0, 0], [0, 0])
    docs, uses, n, words_of = fresh()
    for b in (x for batch in batches for x in slices_of(batch, 0)):
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = fold(text)
            count = Counter(words)
            docs[toxic].update(_patterns(set(count)))
            uses[toxic].update(count)
            n[toxic] += 1
            words_of[toxic] += len(words)
            if len(docs[0]) + len(docs[1]) > COUNTED:
                yield part()
                docs, uses, n, words_of = fresh()
    yield part()


def _pairs(weights: dict[str, float]):
    """Documents of each class with a pair of neighbouring words that holds a lexicon word."""
    lexicon = Model(weights).automaton()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: tuple[Counter, Counter] = (Counter(), Counter())
        known: dict[str, bool] = {}

        def part() -> pa.RecordBatch:
            keys = list(docs[0].keys() | docs[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[p] for p in keys], pa.int64()) for c in docs)], ["pair", "d0", "d1"])

        for b in (x for batch in batches for x in slices_of(batch, 0)):
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = fold(text)
                for w in set(words):
                    if w not in known:
                        known[w] = next(lexicon.iter(f" {w} "), None) is not None
                docs[toxic].update({f"{x} {y}" for x, y in zip(words, words[1:], strict=False) if known[x] or known[y]})
                if len(known) > COUNTED:
                    known.clear()
                if len(docs[0]) + len(docs[1]) > COUNTED:
                    yield part()
                    docs[0].clear()
                    docs[1].clear()
        yield part()

    return run


def _choose(rows: list, w0: int, w1: int) -> dict[str, float]:
    """Strongest patterns first, the longest among equals; none that extends or starts one already chosen."""
    chosen: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (-round(r["g"], 6), -len(r["pattern"]), r["pattern"])):
        p = r["pattern"]
        stem = p.strip()
        if any(stem.startswith(c.strip()) or c.strip().startswith(stem) for c in chosen):
            continue
        rate = math.log(((r["u1"] + 0.5) / (w1 + 1)) / ((r["u0"] + 0.5) / (w0 + 1)))
        if rate > 1:
            chosen[p] = round(min(rate, 8.0), 6)
        if len(chosen) == LEXICON:
            break
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    shrink = np.diag([1e-3, ridge, ridge])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + shrink, a.T @ (y - p) - shrink @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def held_out(id_col: Column) -> Column:
    """Rows whose crc32 of the decimal id leaves no remainder by 5 are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Learn lexicon and curve from at most ``rows`` labelled rows of the training part."""
    key = F.col(id_col).cast("long")
    marked = labels.select(key.alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null").where(~held_out(F.col("id")))
    sample = marked.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(key.alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    texts = texts.groupBy("id").agg(F.max(F.struct(F.xxhash64("text"), "text")).alias("t"), F.max("toxic").alias("toxic")).select("t.text", "toxic")
    scratch = Scratch(spark, "toxicity")
    texts = scratch.keep(texts, "sample")
    counted = texts.mapInArrow(trimmed(_count), "pattern string, d0 long, d1 long, u0 long, u1 long").groupBy("pattern").agg(*(F.sum(c).alias(c) for c in ("d0", "d1", "u0", "u1")))
    counted = scratch.keep(counted, "patterns")
    total = counted.where("pattern = ''").first()  # the totals travel as the empty pattern
    if total is None or not total["d1"]:
        return Model(curve=(-30.0, 0.0, 0.0) if total is None else (math.log(0.5 / (total["d0"] + 1)), 0.0, 0.0))
    # likelihood ratio of the 2 x 2 table, for patterns that lean to the toxic side and are seen in three such texts
    n0, n1 = F.lit(float(total["d0"])), F.lit(float(total["d1"]))
    d0, d1 = F.col("d0").cast("double"), F.col("d1").cast("double")
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    share = (d0 + d1) / (n0 + n1)
    g = 2 * (part(d1, n1 * share) + part(d0, n0 * share) + part(n1 - d1, n1 * (1 - share)) + part(n0 - d0, n0 * (1 - share)))
    found = counted.where((F.col("pattern") != "") & (d1 >= 3) & (d1 * n0 > 3 * d0 * n1)).withColumn("g", g).where("g > 24").orderBy(F.desc("g"), "pattern").limit(20 * LEXICON).collect()
    model = Model(weights=_choose(found, total["u0"], total["u1"]))
    if model.weights:
        pairs = texts.mapInArrow(trimmed(_pairs(model.weights)), "pair string, d0 long, d1 long").groupBy("pair").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
        pairs = pairs.where((F.col("d0") >= EXCEPT) & (F.col("d1") * total["d0"] <= F.col("d0") * total["d1"]))
        model.exceptions = tuple(r["pair"] for r in pairs.orderBy(F.desc("d0"), "pair").limit(LEXICON).collect())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.automaton()
        for b in (x for batch in batches for x in slices_of(batch, 0)):
            f = [features(fold(t), a) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64()), b.column(1)], ["x0", "x1", "toxic"])

    seen = np.array([tuple(r) for r in texts.mapInArrow(trimmed(measure), "x0 double, x1 double, toxic int").collect()], np.float64).reshape(-1, 3)
    seen = seen[np.lexsort(seen.T)]  # sums must not depend on the order of partitions
    model.curve = _logistic(seen[:, :2], seen[:, 2])
    return model


def score(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score, predicted."""
    shared = spark.sparkContext.broadcast((model.weights, model.curve, model.exceptions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        a, (base, per, total) = m.automaton(), m.curve
        for b in (x for batch in batches for x in slices_of(batch, 1)):
            s = [sigmoid(base + per * x + total * y) for x, y in (features(fold(t), a) for t in b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], ["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(run), "id long, score double, predicted int")


def drop_toxic(spark: SparkSession, docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with all their columns."""
    shared = spark.sparkContext.broadcast((model.weights, model.curve, model.exceptions))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        a, (base, per, total) = m.automaton(), m.curve
        for b in (x for batch in batches for x in slices_of(batch, at)):
            s = (base + per * x + total * y for x, y in (features(fold(t), a) for t in b.column(at).cast(pa.string()).to_pylist()))
            yield b.filter(pa.array([sigmoid(z) < 0.5 for z in s], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
