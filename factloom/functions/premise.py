"""Premises of works: which turn from the main line a work takes, read off title, description and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import strip

# Name and trigger patterns, tropes in order of precedence, templates.
NAME = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"
NEGATION = r"(?:doesn'?t|does\s+not|didn'?t|did\s+not|never|won'?t|will\s+not|refuses\s+to|couldn'?t\s+bring\s+himself\s+to|couldn'?t\s+bring\s+herself\s+to)"
LETHAL = r"(?:kill|kills|killing|murder|murders|murdering|shoot|shoots|stab|stabs|drown|drowns|execute|executes|behead|beheads)"
SURVIVAL = (
    (rf"\b{NAME}\s+{NEGATION}\s+{LETHAL}\s+{NAME}\b", 2),
    (rf"\b(?:lets?|letting|allows?|allowing|spares?|sparing)\s+{NAME}\s+(?:live|survive|go|escape|walk\s+away)\b", 1),
    (rf"\b(?:spares?|spared|sparing)\s+{NAME}\b", 1),
    (rf"\bif\s+{NAME}\s+(?:lived|had\s+lived|survived|had\s+survived|lives|survives|didn'?t\s+die|hadn'?t\s+died|never\s+died)\b", 1),
    (rf"\b{NAME}\s+(?:lived|lives|survived|survives|stayed\s+alive|stays\s+alive|is\s+alive|doesn'?t\s+die|didn'?t\s+die|never\s+died|is\s+not\s+dead)\b", 1),
    (rf"\b{NAME}(?:\s+and\s+[A-Z][a-z]+)?\s*,?\s+(?:two\s+of\s+the\s+few\s+|one\s+of\s+the\s+(?:few\s+|only\s+)?)?survivors?\s+of\b", 1),
)
SURVIVAL_TAG = r"^if([a-z]{3,20})(?:lived|survived|hadlived)$"
WAKES = rf"\b{NAME}\s+(?:wakes|woke|awakens|awoke)\s+up\b"
TIME_GAP = r"\b\d+\s+years\s+(?:after|later)\b|\b(?:decades|centuries|years)\s+later\b"
NO_NAMES = (
    "the", "this", "that", "these", "those", "he", "she", "it", "they", "we", "you", "i", "his", "her", "their",
    "there", "then", "when", "where", "while", "if", "but", "and", "so", "most", "some", "many", "read", "in", "on",
    "at", "a", "an", "one", "two", "everyone", "nobody", "someone", "what", "who", "now", "after", "before",
    "instead", "however", "perhaps", "maybe",
)
CROSSOVER_TITLE = r"(?i)([A-Za-z][A-Za-z' ]{2,40})\s*/\s*([A-Za-z][A-Za-z' ]{2,40}?)\s*fan\W*fiction\b"
CROSSOVER_WORD = r"(?i)\bcross-?over\b"
READER = (
    r"(?i)\bx\s*reader\b",
    r"(?i)\breader\s*x\b",
    r"(?i)\by\s*/\s*n\b",
    r"(?i)\breader\s*[-_]?insert\b",
)
READER_TARGET = r"(?i)([A-Za-z][A-Za-z' ]{2,30}?)\s*x\s*reader\b"
PAIRING = r"\b([A-Z][a-z]{2,})\s*[x×]\s*([A-Z][a-z]{2,})\b"
SIMPLE = {
    "transmigration": r"(?i)\btransmigrat\w*\b|\breincarnat\w*\b|\bisekai\b|\btransported\s+(?:in)?to\b|\bfound\s+(?:him|her|them)self\s+(?:transported|in\s+the\s+body)\b|\bwakes\s+up\s+(?:as|in\s+the\s+body\s+of)\b|\bself[-\s]?insert\b",
    "time_displacement": r"(?i)\btime[-\s]?travel\w*\b|\bback\s+in\s+time\b|\bfrozen\b|\bcryo\w*\b|\b\d+\s+years\s+(?:after|later)\b|\b(?:decades|centuries)\s+later\b",
    "continuation": r"(?i)\blife\s+after\b|\bafter\s+the\s+(?:sinking|events|war|finale|show|series)\b|\bgrow\s+old\b|\bsequel\b|\bpost[-\s]canon\b|\bwhat\s+happen(?:s|ed)\s+next\b",
    "found_family": r"(?i)\badopts?\b|\badopted\b|\bevacuee\b|\btake\s+in\b|\bbecome\s+a\s+family\b|\bhave\s+children\b|\bpregnan\w*\b|\bbaby\b|\bfoster\b",
    "love_triangle": r"(?i)\blove\s*triangle\b",
    "original_character": r"(?i)\bo\.?c\.?s?\b|\boriginal\s+character\b|\+\s*original\b|\boriginal\s*\)",
    "character_death": r"(?i)\bmajor\s+character\s+death\b|\bdeath\s*fic\b|\bcharacter\s+death\b",
    "alternate_universe": r"(?i:\balternate\s+universe\b|\bmodern\s+au\b|\bwhat\s+if\b)|\bAU\b",
}
PRECEDENCE = ("character_survives", "transmigration", "crossover", "reader_insert", "pairing", "time_displacement", "continuation", "found_family", "love_triangle", "original_character", "character_death", "alternate_universe")
LABELS = {
    "character_survives": "{entities} survives the canon death",
    "transmigration": "Outsider transmigrates into the canon world",
    "crossover": "Crossover with {entities}",
    "reader_insert": "Reader-insert romance with {entities}",
    "pairing": "Ship: {entities}",
    "time_displacement": "Time displacement / years after canon",
    "continuation": "Continuation beyond the canon ending",
    "found_family": "Found family / children after canon",
    "love_triangle": "Love triangle",
    "original_character": "Original character inserted into canon",
    "character_death": "Major character death added",
    "alternate_universe": "Unspecified alternate universe",
}
ALTERNATES = {
    "character_survives": "Spare {entities} — {entities} lives",
    "transmigration": "An outsider wakes up inside the story",
    "crossover": "Pull in {entities} and cross the two worlds",
    "reader_insert": "A newcomer becomes close to {entities}",
    "pairing": "Let {entities} become involved",
    "time_displacement": "Displace the story out of its canon timeframe",
    "continuation": "Carry the story past the canon ending",
    "found_family": "Have the characters take on a family",
    "love_triangle": "Introduce a rival claim on the romance",
    "original_character": "Add an outside character to the cast",
    "character_death": "Kill a character canon spares",
    "alternate_universe": "Change the story's premises outright",
}
CANON = {
    "character_survives": "Let canon stand — {entities} dies",
    "transmigration": "Let canon stand — no outsider arrives",
    "crossover": "Let canon stand — the world stays self-contained",
    "reader_insert": "Let canon stand — no newcomer arrives",
    "pairing": "Let canon stand — the pairing does not happen",
    "time_displacement": "Let canon stand — the timeframe holds",
    "continuation": "Let canon stand — the story ends where it ends",
    "found_family": "Let canon stand — no family is taken on",
    "love_triangle": "Let canon stand — no rival claim appears",
    "original_character": "Let canon stand — the cast is unchanged",
    "character_death": "Let canon stand — the character lives",
    "alternate_universe": "Let canon stand — the premises hold",
}
DECISIONS = {
    "character_survives": "Whether {entities} dies, as canon has it",
    "transmigration": "Whether an outsider enters the story's world at all",
    "crossover": "Whether the story stays inside its own world",
    "reader_insert": "Whether a newcomer enters {entities}'s life",
    "pairing": "Whether {entities} become involved",
    "time_displacement": "Whether the story stays in its canon timeframe",
    "continuation": "Whether the story ends where canon ends",
    "found_family": "Whether the characters take on a family",
    "love_triangle": "Whether a rival claim on the romance appears",
    "original_character": "Whether an outside character joins the cast",
    "character_death": "Whether a character canon spares is killed",
    "alternate_universe": "Whether the story's premises hold",
}
CLAUSES = {
    "time_displacement": "displaced in time",
    "continuation": "carrying on past the canon ending",
    "found_family": "building a family",
    "pairing": "as a couple",
    "love_triangle": "against a rival claim",
    "crossover": "across another world",
    "transmigration": "with an outsider present",
    "original_character": "alongside a new character",
    "reader_insert": "with a newcomer involved",
    "character_death": "at another character's cost",
    "alternate_universe": "in a reworked setting",
    "character_survives": "with a canon death undone",
}
UNCLASSIFIED = "unclassified"
WITH_ENTITIES = ("character_survives", "crossover", "reader_insert", "pairing")


def slug(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), "-")


def is_name(c: Column) -> Column:
    w = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return (F.size(w) > 0) & ~F.arrays_overlap(w, F.array(*(F.lit(x) for x in NO_NAMES)))


def _flat(tags: Column) -> Column:
    return F.transform(tags, lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]+", ""))


def _found(xs: Column) -> Column:
    return F.array_distinct(F.filter(xs, lambda x: x != ""))


def survivors(text: Column, tags: Column) -> Column:
    """Slugs of those whose death the work undoes, in order of the patterns."""
    named = [F.transform(F.filter(F.regexp_extract_all(text, F.lit(p), F.lit(g)), is_name), slug) for p, g in SURVIVAL]
    gap = F.filter(F.split(text, r"(?<=[.!?])\s+|\n+", -1), lambda s: s.rlike(TIME_GAP))
    woken = F.transform(F.filter(F.transform(gap, lambda s: F.regexp_extract(s, WAKES, 1)), lambda n: (n != "") & is_name(n)), slug)
    tagged = F.transform(_flat(tags), lambda t: F.regexp_extract(t, SURVIVAL_TAG, 1))
    return _found(F.concat(*named, woken, tagged))


def crossing(title: Column, own: Column) -> Column:
    """Slugs of the other worlds named in the title."""
    pairs = F.arrays_zip(F.regexp_extract_all(title, F.lit(CROSSOVER_TITLE), F.lit(1)).alias("a"), F.regexp_extract_all(title, F.lit(CROSSOVER_TITLE), F.lit(2)).alias("b"))
    return _found(F.filter(F.flatten(F.transform(pairs, lambda p: F.array(slug(p["a"]), slug(p["b"])))), lambda s: s != slug(own)))


def reader_targets(text: Column, tags: Column) -> Column:
    target = F.regexp_extract(text, READER_TARGET, 1)
    said = F.when((target != "") & is_name(target), F.array(slug(target))).otherwise(F.array().cast("array<string>"))
    tagged = F.transform(F.filter(_flat(tags), lambda t: F.endswith(t, F.lit("xreader"))), lambda t: F.regexp_replace(t, "xreader$", ""))
    return _found(F.concat(said, F.filter(tagged, lambda t: ~t.isin("charecter", "character"))))


def paired(title: Column) -> Column:
    a, b = F.regexp_extract(title, PAIRING, 1), F.regexp_extract(title, PAIRING, 2)
    ok = (a != "") & (F.lower(a) != "reader") & (F.lower(b) != "reader") & is_name(a) & is_name(b)
    return F.when(ok, F.array_sort(F.array(slug(a), slug(b)))).otherwise(F.array().cast("array<string>"))


def _lookup(trope: Column, of: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in of.items() for x in kv)), trope)


def _told(trope: Column, of: dict[str, str], entities: Column) -> Column:
    """A template with its names, or without them where none was found."""
    names = F.array_join(F.transform(entities, lambda e: F.initcap(F.replace(e, F.lit("-"), F.lit(" ")))), " & ")
    bare = {t: x.replace("{entities} ", "").replace(" {entities}", "").replace("{entities}", "the character").replace("'s life", " someone's life") for t, x in of.items()}
    if of is LABELS:
        bare = {t: x.replace("{entities} ", "").replace(" with {entities}", "") for t, x in of.items()}
    return F.when(F.size(entities) == 0, _lookup(trope, bare)).otherwise(F.replace(_lookup(trope, of), F.lit("{entities}"), names))


def signature(title: Column, description: Column, tags: Column, own: str) -> Column:
    """What was found, as a struct for ``read_signature``: tropes by precedence and the names of each."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(description, F.lit("")))
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    who = {"character_survives": survivors(text, tags), "crossover": crossing(title, F.lit(own)), "reader_insert": reader_targets(text, tags), "pairing": paired(title)}
    is_reader = F.lit(False)
    for pattern in READER:
        is_reader |= text.rlike(pattern)
    is_reader |= F.exists(_flat(tags), lambda t: F.endswith(t, F.lit("xreader")))
    fired = {"character_survives": F.size(who["character_survives"]) > 0, "crossover": (F.size(who["crossover"]) > 0) | text.rlike(CROSSOVER_WORD), "reader_insert": is_reader, "pairing": F.size(who["pairing"]) > 0} | {t: text.rlike(p) for t, p in SIMPLE.items()}
    tropes = F.array_compact(F.array(*(F.when(F.coalesce(fired[t], F.lit(False)), F.lit(t)) for t in PRECEDENCE)))
    return F.struct(tropes.alias("tropes"), *(who[t].alias(t) for t in WITH_ENTITIES))


def read_signature(s: Column) -> Column:
    """The full signature out of ``signature``'s struct."""
    none = F.array().cast("array<string>")
    trope = F.get(s["tropes"], F.lit(0))
    # of several survivors the first names the turn
    entities = F.when(trope == "character_survives", F.slice(s["character_survives"], 1, 1))
    for t in WITH_ENTITIES[1:]:
        entities = entities.when(trope == t, s[t])
    entities = F.coalesce(entities, none)
    key = F.when(trope.isNull(), UNCLASSIFIED).when(F.size(entities) == 0, trope).otherwise(F.concat(trope, F.lit(":"), F.array_join(F.array_sort(entities), "+")))
    clauses = F.transform(F.slice(s["tropes"], 2, 2), lambda t: _lookup(t, CLAUSES))
    path = F.concat_ws(", ", _told(trope, ALTERNATES, entities), F.array_join(clauses, ", "))
    path = strip(F.regexp_replace(path, r",\s*$", ""))
    return F.struct(key.alias("key"), s["tropes"].alias("tropes"), entities.alias("entities"), _told(trope, LABELS, entities).alias("label"), _told(trope, DECISIONS, entities).alias("decision"), _told(trope, CANON, entities).alias("canon_option"), F.when(trope.isNotNull(), path).alias("alternate"))
