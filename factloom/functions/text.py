"""Text measures and normalisation as columns.

Java's classes are ASCII by default; ``(?U)`` makes them Unicode-aware, as the definitions are.
"""

from __future__ import annotations

import difflib
import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Quotation marks, boilerplate and disclaimer patterns, language names, thresholds.
QUOTES = '["“”«»「」]'
PAST_TENSE = r"(?iU)\b\w+ed\b"
CALLS = r"vote|comment|follow|subscribe|like|share|rate|review"
CALL_CONTEXT = r"if\s+you|this\s+(?:chapter|story|book|part)|for\s+more|don'?t\s+forget|my\s+(?:story|book|account)"
BOILERPLATE = (
    r"^\s*a\s*/\s*n\s*[:.-]",
    r"^\s*author'?s?\s+note\s*[:.-]",
    r"^\s*(?:disclaimer|warning)\s*[:.-]",
    r"^\s*i\s+(?:do\s+not|don'?t)\s+own\b",
    r"\bread\s+(?:the\s+rest|the\s+full\s+(?:story|version|fic|chapter)|more)\s+on\s+(?:ao3|archive\w*|ffn|fanfiction\.net|wattpad)\b",
    r"^\s*(?:first|prev(?:ious)?|next|start)\s*[|/]",
    rf"^\s*please\s+(?:{CALLS})\b",
    rf"^\s*(?:don'?t\s+forget|make\s+sure|remember)\s+to\s+(?:{CALLS})\b",
    rf"^\s*(?:{CALLS})\b[^\n]*?\b(?:{CALLS}|{CALL_CONTEXT})\b",
    r"^\s*(?:edit|update)\s*[:.-]",
    r"^\s*\[?(?:posted|cross-?posted)\s+(?:from|to)\b",
    r"^\s*(?:by|written\s+by)\s*[:\-]\s*\S",
    r"^\s*[\w '\-]{0,60}fan\s*fiction\s*$",
)
DISCLAIMER = r"[^.!?\n]*\b(?:i\s+(?:do\s+not|don'?t|dont)\s+own|(?:all\s+)?rights?\s+(?:reserved|belong)|i\s+only\s+own\s+(?:the\s+)?(?:plot|oc|ocs|characters?)|based\s+(?:mainly\s+)?(?:on|after)\s+the\s+(?:film|movie|book|show|series)\b|belongs?\s+to\s+(?:their|its|the)\s+respective\s+owners?)\b[^.!?\n]*[.!?]*"
FICTION_MARK = r"(?:fan\W*fictions?|fan\W*fics?|fics?)"
MIN_WORDS, MIN_QUOTES_PER_1K = 500, 5.0

def let(x: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's variable is, an expression inside a lambda is not."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words(c: Column | str) -> Column:
    """Number of whitespace-separated words."""
    return F.regexp_count(text_of(c), F.lit(r"(?U)\S+"))


def _per_1k(n: Column, c: Column | str) -> Column:
    w = words(c)
    return F.when(w == 0, 0.0).otherwise(n * 1000.0 / F.nullif(w, F.lit(0)))


def quotes_per_1k(c: Column | str) -> Column:
    return _per_1k(F.regexp_count(text_of(c), F.lit(QUOTES)), c)


def past_tense_per_1k(c: Column | str) -> Column:
    return _per_1k(F.regexp_count(text_of(c), F.lit(PAST_TENSE)), c)


def is_prose(c: Column | str, min_words: int = MIN_WORDS, min_quotes: float = MIN_QUOTES_PER_1K) -> Column:
    # a density is never below nothing, so then quotation marks need no count
    return words(c) >= min_words if min_quotes <= 0 else (words(c) >= min_words) & (quotes_per_1k(c) >= min_quotes)


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


#: Line patterns with their common head taken out, so that a line is looked at from its start only; the one pattern that
#: may stand anywhere is tried on lines that hold its first word.
_HEADS = "(?iU)^(?:" + "|".join(p[1:] for p in BOILERPLATE if p.startswith("^")) + ")"
_ANYWHERE = "(?iU)" + "|".join(p for p in BOILERPLATE if not p.startswith("^"))
#: None of these letters has another form beyond ASCII.
_READ = "(?i)read"
#: The words without which no sentence is a disclaimer.
_TOLD = r"(?iU)\bown\b|\brights?\s|\bbased\s|\bbelongs?\s"


def strip_boilerplate(c: Column | str) -> Column:
    """Without lines of author's notes and promotion; disclaimer sentences become a space; spaces inside lines collapsed."""
    lines = F.split(text_of(c), LINE_END, -1)
    kept = F.filter(lines, lambda x: ~x.rlike(_HEADS) & ~(x.rlike(_READ) & x.rlike(_ANYWHERE)))
    # a disclaimer never crosses a line, so lines are searched on their own and only those that can hold one
    told = F.transform(kept, lambda x: F.when(x.rlike(_TOLD), F.regexp_replace(x, f"(?iU){DISCLAIMER}", " ")).otherwise(x))
    return strip(F.array_join(F.transform(told, lambda x: strip(F.regexp_replace(x, r"[ \t]+", " "))), "\n"))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


#: Anything beyond ASCII but letters and marks of Latin-1 that NFKC leaves alone wherever they stand.
_UNSTABLE = r"[[^\x00-\x7F]&&[^¡«»¿À-ÖØ-öø-ÿ]]"


def normalize(c: Column | str) -> Column:
    """NFKC, lower case, white space collapsed and stripped.  Exact for any text; only texts that NFKC may change leave the JVM."""
    t = text_of(c)
    odd = (F.length(t) != F.octet_length(t)) & t.rlike(_UNSTABLE)
    whole = F.coalesce(_nfkc(F.when(odd, t)), t)
    return strip(F.regexp_replace(F.lower(whole), r"(?U)\s+", " "))


def normalize_plain(c: Column | str) -> Column:
    """The same for texts that are in NFKC already, without leaving the JVM."""
    return strip(F.regexp_replace(F.lower(text_of(c)), r"(?U)\s+", " "))


def fingerprint(c: Column | str, plain: bool = False) -> Column:
    return F.sha2(normalize_plain(c) if plain else normalize(c), 256)


def slugify(c: Column, empty: str = "") -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one dash, none at the ends."""
    s = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", empty).otherwise(s) if empty else s


def truncate(c: Column, most: int, suffix: str = "...") -> Column:
    """Cut to ``most`` characters, suffix included."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, max(0, most - len(suffix))), F.lit(suffix[:most])))


def truncate_at_word(c: Column, most: int) -> Column:
    """Cut at the last space if that is past the middle, with an ellipsis."""
    head = F.substring(c, 1, most)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    head = F.when((F.instr(head, " ") > 0) & (at > most // 2), F.left(head, at)).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(head), F.lit("…")))


def clip(c: Column, most: int = 120) -> Column:
    """White space collapsed, cut to ``most`` characters with an ellipsis."""
    flat = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 1), F.lit("…")))


# --- relevance ------------------------------------------------------------------------------------------------------


def alias_keys(term: str) -> list[str]:
    """Forms of a name as a tag would write it: letters and digits only, also without a leading article."""
    parts = _name_words(term)
    keys = ["".join(parts)]
    if len(parts) > 1 and parts[0] in ("the", "a", "an"):
        keys.append("".join(parts[1:]))
    return [k for k in dict.fromkeys(keys) if k]


def _name_words(term: str) -> list[str]:
    return "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in term.lower()).split()


def phrase(term: str) -> str:
    """Pattern of a name in lower-cased text: its words (ASCII letters and digits) with anything or nothing between them,
    but no word around them."""
    parts = _name_words(term)
    return r"(?U)\b" + r"\W*".join(parts) + r"\b" if parts else r"(?!)"


def alias_hits(title: Column, description: Column, tags: Column, terms: list[str]) -> Column:
    """How many of the terms a work mentions, by tag or in words."""
    keys = F.transform(tags, lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]+", ""))
    said = F.lower(F.concat_ws(" ", title, description))
    hit = lambda t: F.arrays_overlap(keys, F.array(*(F.lit(k) for k in alias_keys(t) or ["\0"]))) | said.rlike(phrase(t))
    return sum((F.coalesce(hit(t), F.lit(False)).cast("int") for t in terms), F.lit(0))


def declares(name: str, title: Column, description: Column, tags: Column) -> Column:
    """Whether a work calls itself fiction about ``name``: the name beside the mark, in either order."""
    parts = r"\W*".join(_name_words(name))
    if not parts:
        return F.lit(False)
    said = F.lower(F.concat_ws(" ", title, description, F.array_join(tags, " ")))
    return said.rlike(rf"(?U)\b{parts}\W*{FICTION_MARK}\b|\b{FICTION_MARK}\W*{parts}\b")


def is_relevant(name: str, terms: list[str], min_hits: int = 2, min_reads: int = 0, min_votes: int = 0, allow_mature: bool = False, languages: tuple[str, ...] = ("en",)) -> Column:
    """Gate over columns mature, reads, votes, language, title, description, tags; the rules in order."""
    need = max(1, min(min_hits, len(terms)))
    ok = (F.col("reads") >= min_reads) & (F.col("votes") >= min_votes)
    if not allow_mature:
        ok &= ~F.col("mature")
    if languages:
        ok &= F.col("language").isin(*languages)
    about = declares(name, F.col("title"), F.col("description"), F.col("tags")) | (alias_hits(F.col("title"), F.col("description"), F.col("tags"), terms) >= need)
    return F.coalesce(ok & about, F.lit(False))


def label_matches(label: Column, terms: list[str]) -> Column:
    """A label, reduced to words, contains one of the terms (of three letters or more) as whole words."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    padded = F.concat(F.lit(" "), flat(label), F.lit(" "))
    ok = F.lit(False)
    for t in terms:
        plain = " ".join(_name_words(t))
        if len(plain) >= 3:
            ok |= F.contains(padded, F.lit(f" {plain} "))
    return F.coalesce(ok, F.lit(False))


# --- html -----------------------------------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def html_to_text(c: Column | str, full: bool = True) -> Column:
    """Visible text: scripts, styles and comments out, block ends as blank lines, tags out, entities resolved.

    ``full`` resolves every named entity in an Arrow function; without it the five common ones are resolved in the JVM.
    """
    t = F.regexp_replace(text_of(c), r"(?is)<(script|style)\b.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?i)</(?:p|div|h[1-6]|li|blockquote)\s*>", "\n\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    if full:
        t = _unescape(t)
    else:
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            t = F.replace(t, F.lit(name), F.lit(char))
    t = F.array_join(F.transform(F.split(t, "\n", -1), strip), "\n")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


# --- aliases --------------------------------------------------------------------------------------------------------

# Redirect titles that name something else than the thing itself.
ALIAS_SUFFIXES = ("(disambiguation)", "(franchise)", "(series)")
ALIAS_NOISE = (
    r"^(?:list|lists|index|outline|timeline|glossary)\s+of\b",
    r"\b(?:criticism|controversy|controversies|reception|legacy)\b",
    r"\b(?:box\s*office|merchandise|soundtrack|video\s*game|theme\s*park)\b",
    r"\b(?:fandom|community|influence|adaptations?|bibliograph(?:y|ies))\b",
    r"^(?:anti|pro)-",
    r"^books?\s+in\b|further\s+reading|^cast\s+of\b|^awards?\b",
)


def clean_alias(title: Column, name: Column) -> Column:
    """A redirect's title as a name for the thing, trailing brackets off; null where it is noise or the name itself."""
    noise = "(?iU)" + "|".join(f"(?:{p})" for p in ALIAS_NOISE)
    named = ~F.lower(title).rlike("(?:" + "|".join(s.replace("(", r"\(").replace(")", r"\)") for s in ALIAS_SUFFIXES) + ")$") & ~title.rlike(noise)
    bare = strip(F.regexp_replace(title, r"\s*\([^)]*\)\s*$", ""))
    return F.when(named & (F.length(bare) >= 3) & (F.lower(bare) != F.lower(name)), bare)


def clean_aliases(titles: Column, name: Column) -> Column:
    """Redirect titles that can stand for the thing: noise and the name itself out, trailing brackets off, distinct."""
    first = lambda kept: let(F.transform(kept, lambda t: F.lower(t)), lambda low: F.transform(kept, lambda t, i: F.when(F.array_position(low, F.lower(t)) == i + 1, t)))
    return F.array_compact(let(F.array_compact(F.transform(titles, lambda t: clean_alias(t, name))), first))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two lower-cased strings (no built-in gives it)."""
    return pd.Series([difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype="float64")


def rank_aliases(aliases: DataFrame, name: Column, alias_col: str = "alias", pos_col: str = "pos") -> DataFrame:
    """Aliases with their ``rank``: those that name something else first, then mere respellings of the name, in either part
    as they were found.  One entity's aliases are few; ``name`` may be a column, then give the columns that tell entities
    apart in ``aliases`` under ``entity``."""
    told = aliases.withColumn("is_variant", is_variant(F.col(alias_col), name))
    by = [c for c in ("entity",) if c in aliases.columns]
    return told.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("is_variant", pos_col)))


def is_variant(alias: Column, name: Column, least: float = 0.8) -> Column:
    """Whether an alias merely respells the name."""
    a, n = F.lower(alias), F.lower(name)
    return F.contains(a, n) | F.contains(n, a) | (similarity(alias, name) >= least)
