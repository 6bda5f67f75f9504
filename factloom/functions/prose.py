"""Prose quality: six components between 0 and 1 and their weighted total between 0 and 100."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import LINE_END, let, strip, text_of

# Weights, bounds and word lists.
NEUTRAL = 0.5
WEIGHTS = {"sentence_rhythm": 0.20, "dialogue_craft": 0.18, "vocabulary": 0.18, "interiority": 0.16, "paragraphs": 0.14, "punctuation": 0.14}
SENTENCE_END = r"(?<=[.!?…])[\"'”’)\]]*\s+"
WORD = r"[A-Za-z][A-Za-z'’]*"
TAG_VERBS = (
    "said", "says", "say", "asked", "asks", "replied", "answered", "whispered", "muttered", "shouted", "yelled",
    "murmured", "growled", "snapped", "breathed", "sighed", "laughed", "added", "continued", "called", "cried",
    "hissed", "demanded", "offered", "admitted", "agreed", "insisted", "told", "explained", "mused", "grumbled",
    "screamed", "stammered", "repeated", "warned", "begged", "teased",
)
INTERIOR = (
    "thought", "thoughts", "thinking", "felt", "feel", "feeling", "wondered", "wonder", "realized", "realised",
    "remembered", "remember", "knew", "hoped", "wanted", "needed", "ashamed", "afraid", "guilt", "ignored",
    "imagined", "decided", "doubted", "regret", "ached", "dreaded", "understood", "suspected", "hated", "loved",
    "inside", "something", "dead",
)
SENSORY = (
    "cold", "warm", "heat", "air", "skin", "breath", "breathing", "smell", "smelled", "taste", "tasted", "light",
    "dark", "shadow", "sound", "silence", "blood", "hands", "arms", "throat", "chest", "goose", "bumps",
    "goosebumps", "damp", "sharp", "weight", "rain", "wind", "twitched", "trembled", "shivered", "flinched",
    "burned", "ached", "sweat", "metallic", "refrigerated",
)
TTR_WINDOW, TTR_LEAST = 400, 40


def ramp(v: Column, low: float, high: float) -> Column:
    """Linear from 0 at ``low`` to 1 at ``high``, clamped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low)))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    return total(F.transform(xs, lambda x: x.cast("double"))) / F.nullif(F.size(xs), F.lit(0))


def _full(xs: Column, bare: bool) -> Column:
    """Pieces that are not blank, ``bare`` of white space at their ends where that matters (it does not for counts)."""
    return F.filter(F.transform(xs, strip), lambda s: s != "") if bare else F.filter(xs, lambda s: s.rlike(r"(?U)\S"))


def sentences(text: Column, bare: bool = True) -> Column:
    return _full(F.split(text, SENTENCE_END, -1), bare)


def paragraphs(text: Column, bare: bool = True) -> Column:
    """Blocks between blank lines, or lines where there is but one block."""
    return let(_full(F.split(text, r"\n\s*\n", -1), bare), lambda blocks: F.when(F.size(blocks) > 1, blocks).otherwise(_full(F.split(text, LINE_END, -1), bare)))


def _count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(WORD))


def sentence_rhythm(sentences: Column) -> Column:
    """Spread of sentence lengths."""

    def measure(n: Column) -> Column:
        # whole numbers, so the sums are exact and the difference of squares is safe
        squares = total(F.transform(n, lambda k: (k * k).cast("double")))
        k = F.nullif(F.size(n), F.lit(0))
        spread = F.sqrt(F.greatest(F.lit(0.0), squares / k - mean(n) * mean(n)))
        return F.when(F.size(n) < 4, NEUTRAL).otherwise(ramp(spread, 2.0, 9.0))

    return let(F.filter(F.transform(sentences, _count), lambda k: k >= 2), measure)


def dialogue_craft(spoken: Column) -> Column:
    """Variety of speech verbs, and speech that does not always open with them, over the lines with quotation marks."""
    verbs = "|".join(sorted(TAG_VERBS))

    def measure(spoken: Column) -> Column:
        tags = F.flatten(F.transform(spoken, lambda x: F.transform(F.regexp_extract_all(x, F.lit(rf"(?i)\b({verbs})\b"), F.lit(1)), lambda v: F.lower(v))))
        first = F.size(F.filter(spoken, lambda x: x.rlike(rf'^\s*["“]?\s*(?:[A-Z][a-z]+|I|He|She|They|We|You)\s+(?:{verbs})\s*,?\s*["“]')))

        def craft(t: Column) -> Column:
            most = F.array_max(F.transform(F.array_distinct(t), lambda v: F.size(F.filter(t, lambda x: x == v))))
            n = F.nullif(F.size(t), F.lit(0))
            value = 0.5 * (1.0 - most / n) + 0.5 * (1.0 - first / F.nullif(F.size(spoken), F.lit(0)))
            return F.when(F.size(t) < 3, NEUTRAL).otherwise(value)

        return let(tags, craft)

    return let(spoken, measure)


def vocabulary(words: Column) -> Column:
    """Different words among all, on windows of fixed size so that length does not count against a text."""

    def measure(w: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(TTR_WINDOW)), lambda i: F.slice(w, i + 1, F.lit(TTR_WINDOW)))
        ratios = F.transform(F.filter(cuts, lambda c: F.size(c) >= TTR_LEAST), lambda c: F.size(F.array_distinct(c)) / F.size(c))
        return F.when(F.size(w) < TTR_LEAST, NEUTRAL).otherwise(let(ratios, lambda r: ramp(mean(r), 0.38, 0.62)))

    return let(words, measure)


def interiority(words: Column) -> Column:
    """Words of thought and sense."""
    known = [*dict.fromkeys((*INTERIOR, *SENSORY))]
    hits = F.size(F.filter(words, lambda w: w.isin(*known)))
    n = F.size(words)
    return F.when(n == 0, 0.0).otherwise(ramp(1000.0 * hits / F.nullif(n, F.lit(0)), 3.0, 30.0))


def paragraph_structure(paragraphs: Column) -> Column:
    """Mean length within a band, fewer marks for many fragments."""

    def measure(n: Column) -> Column:
        m = mean(n)
        base = F.when(m <= 20.0, ramp(m, 5.0, 20.0)).when(m <= 150.0, 1.0).otherwise(1.0 - ramp(m, 150.0, 400.0))
        short = F.size(F.filter(n, lambda k: k < 8)) / F.nullif(F.size(n), F.lit(0))
        return F.when(F.size(n) == 0, 0.0).otherwise(F.when(short > 0.6, base * 0.4).otherwise(base))

    return let(F.transform(paragraphs, _count), measure)


def punctuation(text: Column, words: Column, sentences: Column) -> Column:
    """Marks off for shouting, runs of ! and ?, and many of them."""
    n = F.size(words)
    long_words = F.size(F.filter(words, lambda w: F.length(w) >= 3))
    caps = F.coalesce(F.regexp_count(text, F.lit(r"(?U)\b[A-Z]{3,}\b")) * 1.0 / F.nullif(long_words, F.lit(0)), F.lit(0.0))
    run = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("[!?]{2,}"), F.lit(0)), lambda s: F.length(s))), F.lit(0))
    bangs = F.regexp_count(text, F.lit("!")) * 1.0 / F.greatest(F.size(sentences), F.lit(1))
    one = F.lit(1.0)
    off = 0.60 * F.least(one, caps / 0.06) + 0.25 * ramp(run.cast("double"), 1.0, 5.0) + 0.15 * F.least(one, bangs / 0.25)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - off))


COMPONENTS = ("sentence_rhythm", "dialogue_craft", "vocabulary", "interiority", "paragraphs", "punctuation")


def with_components(df: DataFrame, c: Column | str) -> DataFrame:
    """``df`` with the six components, each a column of its own name.

    A text is cut into sentences, lines, paragraphs and words once; the explode of one keeps Spark from cutting it anew for
    every component.
    """
    text = text_of(c)
    words = lambda t: F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    spoken = F.filter(F.split(text, LINE_END, -1), lambda x: x.rlike('["“”«»]'))
    # only these two become letters of words in lower case
    odd = F.contains(text, F.lit("\u212A")) | F.contains(text, F.lit("\u0130"))
    cut = F.struct(
        text.alias("text"),
        sentences(text, bare=False).alias("sentences"),
        spoken.alias("spoken"),
        paragraphs(text, bare=False).alias("paragraphs"),
        F.when(odd, words(text)).alias("words"),
        words(F.lower(text)).alias("low"),
    )
    part = lambda n: F.col(f"__cut.{n}")
    found = {
        "sentence_rhythm": sentence_rhythm(part("sentences")),
        "dialogue_craft": dialogue_craft(part("spoken")),
        "vocabulary": vocabulary(part("low")),
        "interiority": interiority(part("low")),
        "paragraphs": paragraph_structure(part("paragraphs")),
        "punctuation": punctuation(part("text"), F.coalesce(part("words"), part("low")), part("sentences")),
    }
    return df.select("*", F.explode(F.array(cut)).alias("__cut")).select(*df.columns, *(found[n].alias(n) for n in COMPONENTS))


def quality() -> Column:
    """Total out of the component columns, to two places."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0.0)))), 2)
