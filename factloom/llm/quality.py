"""Quality rules: counts of a text, and how much more likely its n-grams are in trusted texts than in the corpus.
Built-in functions only.

Rules.  A text fails with fewer than ``LEAST_WORDS`` words, or if more than ``REPEATED`` of 100 of its words stand in
windows of three words that the text holds twice or more.  Windows are told apart by 64 bits of hash inside one text: sorted
with their places, equal ones become neighbours, so no window is compared with more than two others.

Likelihood ratio.  Tokens are runs of letters, marks and digits, and runs of other signs; tokens and pairs of neighbours are
hashed to ``BUCKETS`` buckets.  The trusted texts and all texts are two multinomials over the buckets, with one added to every
count: weight(b) = ln(p(b | trusted) / p(b | corpus)).  A text's score is the mean weight of its n-grams, so that length
does not count, and every text with a mean of at least ``THRESHOLD`` passes: nothing is drawn by lot.  Both multinomials are
counted over all texts (combined map-side to at most ``BUCKETS`` rows a task); the weights, one
array of ``BUCKETS`` numbers, go to the tasks as a scalar.  Weights are whole numbers (millionths), so sums are exact.

Defined results: a null text has no words, as an empty one; a text without words fails; repeated rows count as often as they
stand and each gets its row; a null id stays null and is never trusted; a text is trusted if all of its label rows say so;
without trusted texts every weight is 0 and the rules alone decide; an empty table gives an empty table; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.pii import let
from factloom.llm.store import Scratch

LEAST_WORDS = 50
REPEATED = 50
BUCKETS = 1 << 16
#: Mean weight (nats) from which a text passes.
THRESHOLD = -0.25
#: Trusted ids, 8 bytes each, that are broadcast; more of them meet the texts in a shuffle.
BROADCAST = 1_000_000
#: Weights are whole numbers of this part.
UNIT = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\x20\x09-\x0D]+"
SYMBOL = "[#*$%&|<>]"


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words in windows of three that the text holds twice or more, the first one included; ``words`` is a bound value."""
    whole = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    windows = F.transform(whole, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def places(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        again = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        # each start counts the words since the one before it, three at most
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), step, lambda a: a["n"])

    def counted(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(h) == F.size(F.array_distinct(h)), 0).otherwise(let(let(placed, places), covered))

    return let(windows, counted).cast("long")


def counts(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text that is not null."""
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(WORD))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
        )

    return let(found(text, WORD), of)


def grams(text: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all tokens and pairs of neighbouring tokens."""

    def hashed(t: Column) -> Column:
        pair = lambda x, i: F.pmod(F.xxhash64(x, F.get(t, i + 1)), F.lit(buckets)).cast("int")
        single = F.transform(t, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
        return F.concat(single, F.transform(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), pair))

    return let(found(text, TOKEN), hashed)


def weights(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, weight)`` of every bucket that the corpus uses, at most ``buckets`` rows, as a written table."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    trusted = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.coalesce(quality_col, F.lit(0))).alias("q")).where("q = 1").select("id")

    scratch = Scratch(spark, "quality")
    trusted = scratch.keep(trusted, "trusted")
    if trusted.count() <= BROADCAST:
        trusted = F.broadcast(trusted)

    def counted(of: DataFrame, name: str) -> DataFrame:
        return of.select(F.explode(grams(F.col("text"), buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))

    both = counted(texts, "all").join(counted(texts.join(trusted, "id", "left_semi"), "good"), "bucket", "left")
    both = scratch.keep(both.select("bucket", "all", F.coalesce("good", F.lit(0)).alias("good")), "counts")
    sums = both.agg(F.sum("all").alias("all"), F.sum("good").alias("good")).first()
    if not sums["good"]:
        return both.select("bucket", F.lit(0).cast("long").alias("weight"))
    ratio = ((F.col("good") + 1) / float(sums["good"] + buckets)) / ((F.col("all") + 1) / float(sums["all"] + buckets))
    return both.select("bucket", F.round(UNIT * F.log(ratio)).cast("long").alias("weight"))


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    weight = weights(spark, docs, labels, id_col, text_col, quality_col, buckets)
    dense = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(weight, "bucket", "left").select("bucket", F.coalesce("weight", F.lit(0)).alias("weight"))
    # one array of exactly ``buckets`` numbers, a scalar to the tasks: a text is scored where it is read, nothing is shuffled
    table = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "weight"))), lambda x: x["weight"]).alias("w")).scalar()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    add = lambda a, b: a + F.get("weights", b)
    mean = let(grams(F.col("text"), buckets), lambda g: F.when(F.size(g) > 0, F.aggregate(g, F.lit(0).cast("long"), add) / F.size(g) / UNIT).otherwise(F.lit(0.0)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), table.alias("weights")).select("id", counts(F.col("text")).alias("counts"), mean.alias("score"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    out = rows.select("id", "counts.*", "score").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
