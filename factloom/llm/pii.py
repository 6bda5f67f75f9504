"""Personal data: fixed patterns, and terms that disclose what the patterns protect.  Built-in functions only.

Base spans are the matches of four patterns, leftmost and non-overlapping per kind; matches that fail their check are
dropped without a retry.  A text is cut by each pattern: the lengths of the pieces and of the matches, summed up, are the
positions (code points, end exclusive).  The patterns are written so that no start is tried twice and no repetition
backtracks, which keeps runs of any length linear; each is equivalent to its plain form:

* email: a match can only begin where a run of local-part characters begins, or where the previous match ended;
* card: only whole runs of digits with single separators count, and only those with 14 to 19 digits can pass.

Terms.  Every protected value (an address or number) is an entity, and so is what it belongs to: the local part and the domain
of an address and the first digits of a phone number, which give values that stand once the support of their kin.  The event is a document drawn
from the corpus: P(e) is the share of documents that hold the entity, P(t) of those that hold the term, P(t | e) of the
entity's contexts that hold the term (a context is the set of words of a document, so copies of one document prove nothing).
PMI(t; e) = log2(P(t | e) / P(t)) against the information content IC(e) = -log2 P(e) is how much of the entity the term gives
away.  A few contexts prove little, so P(t | e) is taken at the lower end of its confidence interval (Wilson's, at ``Z``
deviations): words that meet an entity twice by chance stay below.  Terms with a share PMI / IC of at least ``SHARE`` that
stand in at least ``SUPPORT`` contexts of the entity exceed the disclosure threshold: wherever they stand in the documents of
that entity they become spans of kind ``term``, to be generalised or removed with the base spans.  Words inside addresses
are no terms; the other patterns hold no letters.

Positions are sums over arrays.  A fold that appends to an array copies it at every step, so long arrays are summed up in
parts of ``PART`` elements (``running``); texts with hundreds of thousands of matches stay a matter of seconds.

Defined results: null texts count as empty; empty texts have no spans and the digest of the empty string; a null id stays
null; repeated rows get equal results; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.store import Scratch

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT = 2
SHARE = 0.6
Z = 1.96
#: Digits of a phone number that many numbers have in common.
PREFIX = 6
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9][\x20-]?)[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: what a text must contain for the pattern to be tried at all
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTET = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
WORD = r"[\p{L}]{3,}"
SPAN = "array<struct<start:int,rank:int,stop:int,value:string>>"
#: Elements of an array that one fold sums up.
PART = 256
#: Characters of a text that are rebuilt together.
BLOCK = 512


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def weigh(i: Column) -> Column:
        v = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, v).when(v > 4, v * 2 - 9).otherwise(v * 2)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + weigh(i)) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return luhn(digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(10, 15)
    return F.lit(True)


def value_of(kind: str, m: Column) -> Column:
    """The protected value behind a match: what its spellings have in common."""
    return F.concat(F.lit(f"{kind}:"), F.lower(m) if kind in ("email", "ip") else digits(m))


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda's variable is, an expression used twice is not."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _sums(xs: Column) -> Column:
    """What stands before each element of a short array of numbers, summed up, and the whole sum behind them."""
    start = F.array(F.lit(0))
    return F.aggregate(xs, start, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def running(xs: Column) -> Column:
    """What stands before each element of an array of numbers, summed up."""

    def whole(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.element_at(p, -1))
        return let(_sums(totals), lambda before: F.flatten(F.transform(parts, lambda p, i: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: x + F.get(before, i)))))

    def cut(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(v) - 1, F.lit(PART))
        return let(F.transform(starts, lambda i: _sums(F.slice(v, i + 1, F.lit(PART)))), whole)

    return let(xs, lambda v: F.when(F.size(v) > 0, cut(v)).otherwise(F.array().cast("array<int>")))


def placed(text: Column, pattern: str) -> Column:
    """Array of (start, stop, found) of all matches in order."""

    def walk(both: Column) -> Column:
        steps = F.zip_with(F.slice(both["cut"], F.lit(1), F.size(both["found"])), both["found"], lambda c, m: F.length(c) + F.length(m))

        def spans(before: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                start = F.get(before, i) + F.length(F.get(both["cut"], i))
                return F.struct(start.alias("start"), (start + F.length(m)).alias("stop"), m.alias("found"))

            return F.transform(both["found"], span)

        return let(running(steps), spans)

    # bound to a name, else the cut would be made anew for every match
    return let(F.struct(F.split(text, pattern, -1).alias("cut"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), walk)


def spans_of(text: Column, kind: str) -> Column:
    """Array of the base spans of a kind."""
    pattern = PATTERNS[kind]
    rank = KINDS.index(kind)
    good = F.filter(placed(text, pattern), lambda s: passes(kind, s["found"]))
    spans = F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), value_of(kind, s["found"]).alias("value")))
    likely = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike(pattern)
    if kind == "ip":
        likely = text.rlike(pattern)
    return F.when(likely, spans).otherwise(F.array().cast(SPAN))


def context_words(text: Column) -> Column:
    """Distinct lower-cased words outside the addresses."""
    rest = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], "\n")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(rest), F.lit(WORD), F.lit(0)))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: row, id, text, base (array of spans in order)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("base", F.array_sort(F.concat(*(spans_of(F.col("text"), k) for k in KINDS[:4]))))


def entities_of(spans: Column) -> Column:
    """Values of base spans and what they belong to, each once."""

    def more(v: Column) -> Column:
        mail = F.array(v, F.concat(F.lit("local:"), F.substring_index(F.substring(v, 7, 2**31 - 1), "@", 1)), F.concat(F.lit("domain:"), F.substring_index(v, "@", -1)))
        phone = F.array(v, F.concat(F.lit("prefix:"), F.substring(v, 7, PREFIX)))
        return F.when(F.startswith(v, F.lit("email:")), mail).when(F.startswith(v, F.lit("phone:")), phone).otherwise(F.array(v))

    return F.array_distinct(F.flatten(F.transform(spans, lambda s: more(s["value"]))))


def least_share(k: Column, n: Column, z: float = Z) -> Column:
    """Lower end of Wilson's interval for a share of ``k`` in ``n``."""
    p = k / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def disclosing_terms(docs: DataFrame, entity: DataFrame, words: DataFrame, text_col: str = "text", support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """Pairs (value, term) above the threshold, from documents that hold entities, ``entity(row, value, context)`` and
    ``words(row, words)``, and from all documents."""
    n = F.lit(docs.count()).cast("double")
    once = entity.groupBy("value", "context").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    # an entity with fewer than ``support`` different contexts has no term; each document counts, each context is told apart
    of_value = once.groupBy("value").agg(F.sum("copies").alias("holders"), F.count("*").alias("of")).where(F.col("of") >= support)
    near = once.join(of_value.select("value"), "value").join(words, "row").select("value", F.explode("words").alias("term"))
    of_term = near.groupBy("value", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= support)
    all_words = context_words(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    spread = docs.select(F.explode(all_words).alias("term")).groupBy("term").agg(F.count("*").alias("documents"))
    pairs = of_term.join(of_value, "value").join(spread, "term")
    pmi = F.log2(least_share(F.col("contexts"), F.col("of")) * n / F.col("documents"))
    # an entity in more than half of all documents counts as in half of them, or nothing would be left to give away
    ic = F.log2(F.greatest(n, F.lit(2.0)) / F.least(F.col("holders"), F.greatest(n, F.lit(2.0)) / 2))
    return pairs.where(pmi >= share * ic).select("value", "term")


def _told(held: DataFrame, told: DataFrame) -> DataFrame:
    """Places (row, terms) of ``told(row, term)`` in the texts of ``held(row, text)``, in order."""
    wanted = held.join(told.select("row").distinct(), "row", "left_semi")
    mails = let(
        F.struct(F.split("text", PATTERNS["email"], -1).alias("cut"), F.regexp_extract_all("text", F.lit(PATTERNS["email"]), F.lit(0)).alias("mail")),
        lambda x: F.arrays_zip(x["cut"].alias("cut"), x["mail"].alias("mail")),
    )
    outside = wanted.select("row", F.posexplode(mails).alias("at", "p"))
    words = let(
        F.struct(F.split("p.cut", WORD, -1).alias("gap"), F.regexp_extract_all("p.cut", F.lit(WORD), F.lit(0)).alias("word")),
        lambda x: F.arrays_zip(x["gap"].alias("gap"), x["word"].alias("word")),
    )
    # the last gap of a piece has no word behind it but the address, if there is one
    each = outside.select("row", "at", "p.mail", F.posexplode(words).alias("k", "w"))
    size = F.length("w.gap") + F.coalesce(F.length("w.word"), F.length("mail"), F.lit(0))
    stop = F.sum(size).over(Window.partitionBy("row").orderBy("at", "k")).cast("int")
    places = each.select("row", F.lower("w.word").alias("term"), (stop - F.length("w.word")).alias("start"), stop.alias("stop")).where("term is not null")
    span = F.struct("start", F.lit(KINDS.index("term")).alias("rank"), "stop", F.lit(None).cast("string").alias("value"))
    return places.join(told, ["row", "term"]).groupBy("row").agg(F.collect_list(span).alias("terms"))


def _find(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """As ``find``, with the text of each row that has spans (of all rows if ``whole``)."""
    scratch = Scratch(spark, "pii")
    has = F.size("base") > 0
    text = F.col("text") if whole else F.when(has, F.col("text"))
    found = base_spans(docs, id_col, text_col).select("row", "id", "base", text.alias("text"), F.when(has, context_words(F.col("text"))).alias("words"))
    found = scratch.keep(found, "base")
    held = found.where("words is not null")
    values = entities_of(F.col("base"))
    entity = held.select("row", F.xxhash64(F.array_join(F.array_sort("words"), " ")).alias("context"), F.explode(values).alias("value"))
    terms = disclosing_terms(docs, entity, held.select("row", "words"), text_col)
    told = scratch.keep(entity.select("row", "value").join(terms, "value").select("row", "term").distinct(), "told")
    told = _told(held.select("row", "text"), told)
    every = F.array_sort(F.concat("base", F.coalesce("terms", F.array().cast(SPAN))))
    return found.join(told, "row", "left").select("row", "id", "text", "base", every.alias("all"))


def find(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: row, id, base and all (arrays of spans in order of start and kind)."""
    return _find(spark, docs, id_col, text_col, False).drop("text")


def spelled(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def sanitise(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text with every span generalised to its kind in angle brackets.

    Rows keep their own texts, whether or not they share an id.  A text is rebuilt in blocks of ``BLOCK`` characters, each
    with the parts of spans inside it, so that neither a long text nor many spans are walked through more than once.
    """
    found = Scratch(spark, "sanitise").keep(_find(spark, docs, id_col, text_col, True), "spans")
    blocks = found.select("row", F.posexplode_outer(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("block", "piece"))
    spans = found.select("row", F.explode("all").alias("s")).select("row", "s.start", "s.rank", "s.stop")
    first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("stop") - 1) / BLOCK)
    parts = spans.select("*", F.explode(F.sequence(first, last)).alias("b"))
    lo, hi = F.greatest(F.col("start") - F.col("b") * BLOCK, F.lit(0)), F.least(F.col("stop") - F.col("b") * BLOCK, F.lit(BLOCK))
    part = F.struct(lo.cast("int").alias("lo"), (F.col("b") == first).alias("opens"), F.col("rank"), hi.cast("int").alias("hi"))
    parts = parts.groupBy("row", F.col("b").cast("int").alias("block")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    names = F.array(*(F.lit(f"<{k}>".upper()) for k in KINDS))
    piece = F.col("piece")

    def step(acc: Column, s: Column) -> Column:
        # a span inside or across one already replaced adds nothing but its overhang
        gap = F.substring(piece, acc["at"] + 1, F.greatest(s["lo"] - acc["at"], F.lit(0)))
        fresh = s["opens"] & (s["lo"] >= acc["at"])
        return F.struct(F.greatest(acc["at"], s["hi"]).alias("at"), F.concat(acc["out"], gap, F.when(fresh, F.get(names, s["rank"])).otherwise("")).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rebuilt = F.aggregate("parts", start, step, lambda acc: F.concat(acc["out"], F.substring(piece, acc["at"] + 1, F.length(piece))))
    both = blocks.join(parts, ["row", "block"], "left").select("row", F.struct("block", F.coalesce(F.when(F.col("parts").isNotNull(), rebuilt), piece, F.lit("")).alias("t")).alias("p"))
    texts = both.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "").alias("text"))
    return found.select("row", "id").join(texts, "row").select("id", "text")
