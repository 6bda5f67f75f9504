"""Wiki markup: templates, leads, names, relations and attributes of a page."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import let, strip, text_of, truncate_at_word

# Parameter names by meaning, empty values, patterns.
RELATIONS = {
    "relatives": "relative",
    "known relatives": "relative",
    "family": "family",
    "relationships": "relationship",
    "spouse": "spouse",
    "spouses": "spouse",
    "husband": "spouse",
    "wife": "spouse",
    "children": "child",
    "parents": "parent",
    "father": "parent",
    "mother": "parent",
    "siblings": "sibling",
    "significant other": "partner",
    "significant others": "partner",
    "love interest": "partner",
    "love interests": "partner",
    "romances": "partner",
    "partner": "partner",
    "partners": "partner",
    "allies": "ally",
    "friends": "friend",
    "enemies": "enemy",
    "affiliation": "affiliation",
    "affiliations": "affiliation",
    "allegiance": "affiliation",
    "employer": "employer",
    "team": "affiliation",
    "organization": "affiliation",
    "victims": "victim",
    "killed by": "killer",
    "creator": "creator",
}
ALIAS_FIELDS = ("aliases", "alias", "full name", "fullname", "real name", "other names", "aka")
STATUS_FIELDS = ("status", "current status", "state")
PROFILE_FIELDS = ("age", "gender", "born", "birth_date", "death_date", "died", "species", "occupation", "profession", "job", "residence", "address", "nationality", "ethnicity", "first_appearance", "last_appearance", "first appearance", "last appearance", "seasons", "episodecount", "actor", "portrayed by", "hair", "eyes", "marital status", "nicknames", "moniker", "location", "type", "airdate", "writer", "director")
LAYOUT_FIELDS = ("image", "image2", "imagebg", "images", "photo", "picture", "portrait", "logo", "icon", "caption", "imagecaption", "imagewidth", "width", "height", "size", "px", "pixels", "align", "alignment", "color", "colour", "backcolor", "altbackcolor", "bordercolor", "borderradius", "bgcolor", "fontcolor", "textcolor", "maxwidth", "style", "class", "name", "title", "description", "hidden", "collapse")
NO_VALUE = ("", "-", "--", "n/a", "na", "none", "none known", "unknown", "unnamed", "tbd", "tba", "?", "???")
RANKS = ("captain", "sergeant", "sgt", "detective", "lieutenant", "lt", "officer", "doctor", "dr", "professor", "mr", "mrs", "ms", "miss", "sir", "agent", "father", "mother", "sister", "brother", "nurse", "chief")
ROLES = r"(?i)\b(?:antagonists?|protagonists?|deuteragonist|tritagonist|characters?|villains?|heroe?s?|heroine|narrator|series|seasons?|episodes?|franchise|novels?|comics?|films?|movies?|shows?|books?|games?)\b"
ASSETS = r"(?i)^\s*(?:file|image|category|media|видео|video):"
CONTAINER = r"(?is)<\s*(gallery|ref|references|table|imagemap|poem)\b[^>]*>.*?<\s*/\s*\1\s*>"
BREAK = r"(?i)<\s*br\s*/?\s*>"
LINK = r"\[\[([^\[\]]+?)\]\]"
MOST_VALUE, MOST_ALIAS, MOST_TARGET, MOST_ATTRIBUTES = 2000, 80, 200, 40
NOVEL = r"(?i)\(novels?(?:\s*/\s*comics?)?\)|\bnovels?\b|\bbooks?\b"
SCREEN = r"(?i)\bseasons?\s*\d+\b|\bepisodes?\b|\b(?:pilot|finale)\s+characters\b|\b(?:tv|television)\s+series\b"
VARIANT = r"(?i)\s*\((?:novels?|comics?|books?|novels?\s*/\s*comics?|tv\s*series|television\s*series|series|show|film|movie|games?|character)\)\s*$"

TEMPLATE = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("params", T.MapType(T.StringType(), T.StringType()))]))
_MARK = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")


def _spans(text: str) -> Iterator[tuple[int, int]]:
    """Outermost balanced double braces; an unbalanced one ends the search."""
    depth, opened = 0, 0
    for m in re.finditer(r"\{\{|\}\}", text):
        if m[0] == "{{":
            opened = m.start() if depth == 0 else opened
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                yield opened, m.end()


def templates_of(text: str) -> list[tuple[str, dict[str, str]]]:
    """Name and named parameters of each outermost template; bars inside links and inner templates separate nothing."""
    out = []
    for lo, hi in _spans(text):
        body, cuts, depth = text[lo + 2 : hi - 2], [-1], 0
        for m in _MARK.finditer(body):
            if m[0] in ("{{", "[["):
                depth += 1
            elif m[0] in ("}}", "]]"):
                depth = max(0, depth - 1)
            elif depth == 0:
                cuts.append(m.start())
        parts = [body[a + 1 : b] for a, b in zip(cuts, [*cuts[1:], len(body)], strict=True)]
        named = (p.partition("=") for p in parts[1:] if "=" in p)
        out.append((parts[0].strip(), {k.strip().lower(): v.strip() for k, _, v in named}))
    return out


@F.pandas_udf(TEMPLATE)
def templates(s: pd.Series) -> pd.Series:
    """Templates of a page: nesting is beyond patterns, so this runs on Arrow batches."""
    return s.map(lambda x: [{"name": n, "params": p} for n, p in templates_of(x)] if isinstance(x, str) else [])


@F.pandas_udf(T.StringType())
def without_templates(s: pd.Series) -> pd.Series:
    def drop(x: str) -> str:
        at, kept = 0, []
        for lo, hi in _spans(x):
            kept.append(x[at:lo])
            at = hi
        tail = x[at:]
        # what follows an opening that never closes is lost with it
        return "".join(kept) + (tail[: tail.index("{{")] if "{{" in tail else tail)

    return s.map(lambda x: drop(x) if isinstance(x, str) else "")


def preprocess(c: Column) -> Column:
    """Without comments, containers, references and tables."""
    c = F.regexp_replace(text_of(c), r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, CONTAINER, "")
    c = F.regexp_replace(c, r"(?i)<\s*ref\b[^>]*/\s*>", "")
    return F.regexp_replace(c, r"(?ms)^\{\|.*?^\|\}", "")


def plain(c: Column) -> Column:
    """Readable text of markup: links as their labels, assets, marks, bullets and tags out."""
    c = F.regexp_replace(F.regexp_replace(c, BREAK, "\n"), r"<[^>]+>", "")
    c = F.regexp_replace(c, r"(?i)\[\[\s*(?:file|image|category|media|видео|video):[^\[\]]*\]\]", "")
    c = F.regexp_replace(c, r"\[\[[^\[\]|]*\|\s*([^\[\]]+?)\s*\]\]", "$1")
    c = F.regexp_replace(c, r"\[\[\s*([^\[\]]+?)\s*\|?\s*\]\]", "$1")
    c = F.regexp_replace(c, r"\[(?:https?|//)\S+?(?:\s+([^\]]*))?\]", "$1")
    c = F.regexp_replace(F.regexp_replace(c, "'{2,5}", ""), r"(?m)^[*#:;]+\s*", "")
    c = F.array_join(F.transform(F.split(c, "\n", -1), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " "))), "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def value(c: Column) -> Column:
    """A parameter as one clean line."""
    flat = F.replace(plain(c), F.lit("\n"), F.lit(" "))
    return F.left(F.regexp_replace(flat, "^[ ,;·—-]+|[ ,;·—-]+$", ""), F.lit(MOST_VALUE))


def is_no_value(c: Column) -> Column:
    return F.lower(strip(c)).isin(*NO_VALUE)


def lead_markup(c: Column) -> Column:
    """What stands before the first heading, templates aside."""
    head = F.get(F.split(preprocess(c), r"(?m)^\s*={2,}\s*.+?\s*={2,}\s*$", 2), F.lit(0))
    return strip(without_templates(head))


def profile(ts: Column) -> Column:
    """The template with most profile parameters (two at least), the first among equals."""
    return let(ts, _profile)


def _profile(ts: Column) -> Column:
    signals = F.array(*(F.lit(x) for x in sorted({*RELATIONS, *ALIAS_FIELDS, *STATUS_FIELDS, *PROFILE_FIELDS})))
    ranked = F.transform(ts, lambda t, i: F.struct(F.size(F.array_intersect(F.map_keys(t["params"]), signals)).alias("score"), (-i).alias("at"), t.alias("t")))
    best = F.aggregate(ranked, F.struct(F.lit(1).alias("score"), F.lit(0).alias("at")), lambda a, r: F.when(r["score"] > a["score"], F.struct(r["score"].alias("score"), r["at"].alias("at"))).otherwise(a))
    return F.when(best["score"] >= 2, F.get(ts, -best["at"]))


def usable_alias(c: Column) -> Column:
    return F.length(c).between(2, MOST_ALIAS) & ~is_no_value(c) & ~F.lower(F.regexp_replace(c, r"^[ .]+|[ .]+$", "")).isin(*RANKS) & c.rlike(r"\p{L}")


def first_seen(xs: Column) -> Column:
    """Distinct without regard to case, the first spelling stays."""
    both = lambda v: let(F.transform(v, lambda x: F.lower(x)), lambda low: F.transform(v, lambda x, i: F.when(F.array_position(low, F.lower(x)) == i + 1, x)))
    return F.array_compact(let(xs, both))


def entries(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(c, BREAK, "\n"), r"\n+", -1), strip), lambda x: x != "")


def lead_aliases(lead: Column) -> Column:
    """Names set in bold in the first paragraph: no links, no roles, a capital first."""
    first = F.get(F.filter(F.split(lead, r"\n\s*\n", -1), lambda b: strip(b) != ""), F.lit(0))
    bold = F.filter(F.regexp_extract_all(F.coalesce(first, F.lit("")), F.lit("(?s)'''(.+?)'''"), F.lit(1)), lambda b: ~b.rlike(LINK))
    named = F.filter(F.transform(bold, value), lambda v: usable_alias(v) & v.rlike(r"^\p{Lu}") & ~v.rlike(ROLES))
    return first_seen(named)


def field_aliases(c: Column) -> Column:
    """Names listed in a parameter, notes in brackets aside."""
    return first_seen(F.filter(F.transform(entries(c), lambda e: value(F.regexp_replace(e, r"\([^()]*\)", " "))), usable_alias))


def relations(field: Column, c: Column) -> Column:
    """(target, kind) of each entry of a relation's parameter; the last bracket names the kind."""

    def read(e: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(e, BREAK, " "), r"<[^>]+>", " ")
        notes = F.regexp_extract_all(bare, F.lit(r"\(([^()]*)\)"), F.lit(1))
        said = F.when(F.size(notes) > 0, F.left(value(F.try_element_at(notes, F.lit(-1))), F.lit(120)))
        rest = F.regexp_replace(bare, r"\([^()]*\)", " ")
        links = F.filter(F.transform(F.filter(F.regexp_extract_all(rest, F.lit(LINK), F.lit(1)), lambda x: ~x.rlike(ASSETS)), lambda x: strip(F.substring_index(x, "|", 1))), lambda x: x != "")
        of = F.element_at(F.create_map(*(F.lit(x) for kv in RELATIONS.items() for x in kv)), field)
        return F.struct(F.coalesce(F.get(links, F.lit(0)), value(rest)).alias("target"), F.coalesce(let(said, lambda kind: F.nullif(kind, F.lit(""))), of).alias("kind"))

    return F.filter(F.transform(entries(c), read), lambda r: ~is_no_value(r["target"]) & (F.length(r["target"]) <= MOST_TARGET))


def attributes(params: Column) -> Column:
    """(predicate, value) of what is neither layout, relation nor alias."""
    dropped = F.array(*(F.lit(x) for x in sorted({*LAYOUT_FIELDS, *RELATIONS, *ALIAS_FIELDS})))
    rows = F.filter(F.map_entries(params), lambda e: ~F.array_contains(dropped, e["key"]))
    told = F.transform(rows, lambda e: F.struct(F.left(e["key"], F.lit(80)).alias("predicate"), value(e["value"]).alias("value")))
    return F.slice(F.filter(told, lambda e: ~is_no_value(e["value"])), 1, MOST_ATTRIBUTES)


def life_status(params: Column) -> Column:
    """Alive or deceased, by the first status parameter that says so."""
    out = F.lit("unknown")
    for f in reversed(STATUS_FIELDS):
        told = F.try_element_at(params, F.lit(f))
        said = let(F.lower(value(told)), lambda v: F.when(v.rlike("deceased|dead|killed"), "deceased").when(v.rlike("alive|living"), "alive"))
        out = F.coalesce(F.when(told.isNotNull(), said), out)
    return out


def canonical_name(title: Column) -> Column:
    """A page's title without the medium in brackets."""
    return strip(F.regexp_replace(title, VARIANT, ""))


def canon_basis(title: Column, categories: Column, novel_titles: tuple[str, ...] = ()) -> Column:
    """Struct of basis (novel, screen, both, unknown) and what it rests on; a category counts as novel first."""
    names = F.filter(F.transform(categories, lambda c: strip(F.regexp_replace(c, "(?i)^category:", ""))), lambda c: c != "")

    def novel(c: Column) -> Column:
        hit = c.rlike(NOVEL)
        for t in novel_titles:
            hit |= F.startswith(F.lower(c), F.lit(t.lower()))
        return hit

    said = lambda xs: F.transform(xs, lambda c: F.concat(F.lit("Category:"), c))
    own = F.when(title.rlike(NOVEL), F.array(title)).otherwise(F.array().cast("array<string>"))
    a = F.concat(own, said(F.filter(names, novel)))
    b = said(F.filter(names, lambda c: ~novel(c) & c.rlike(SCREEN)))
    basis = F.when((F.size(a) > 0) & (F.size(b) > 0), "both").when(F.size(a) > 0, "novel").when(F.size(b) > 0, "screen").otherwise("unknown")
    return F.struct(basis.alias("basis"), F.concat(a, b).alias("evidence"))


def relationships(params: Column) -> Column:
    """(target, kind, field) of all relations' parameters in their order, the first of each target and kind."""
    fields = F.array(*(F.lit(x) for x in RELATIONS))
    told = F.filter(F.map_entries(params), lambda e: F.array_contains(fields, e["key"]) & ~is_no_value(value(e["value"])))
    read = lambda e: F.transform(relations(e["key"], e["value"]), lambda r: F.struct(r["target"].alias("target"), r["kind"].alias("kind"), e["key"].alias("field")))
    same = lambda r: F.concat_ws("\0", F.lower(r["target"]), F.lower(r["kind"]))

    def first(rows: Column) -> Column:
        return let(F.transform(rows, same), lambda keys: F.filter(rows, lambda r, i: F.array_position(keys, same(r)) == i + 1))

    return let(F.flatten(F.transform(told, read)), first)


def aliases(params: Column, lead: Column, name: Column, titles: tuple[str, ...] = ()) -> Column:
    """Names in alias parameters and in bold in the lead, without the page's own name and those of works (``titles``)."""
    return _aliases(params, lead_aliases(lead), name, titles)


def _aliases(params: Column, bold: Column, name: Column, titles: tuple[str, ...]) -> Column:
    fields = F.array(*(F.lit(x) for x in ALIAS_FIELDS))
    listed = F.flatten(F.transform(F.filter(F.map_entries(params), lambda e: F.array_contains(fields, e["key"])), lambda e: field_aliases(e["value"])))
    out = F.array(F.lower(strip(name)), *(F.lit(t.strip().lower()) for t in titles))
    return let(out, lambda out: F.filter(first_seen(F.concat(listed, bold)), lambda a: ~F.array_contains(out, F.lower(a))))


def is_entity_page(name: Column, has_profile: Column, found: Column, lead: Column) -> Column:
    """Whether a page is about one thing: it has a profile, relations to others, or its own name in bold in the lead."""
    return _is_entity_page(name, has_profile, found, lead_aliases(lead))


def _is_entity_page(name: Column, has_profile: Column, found: Column, bold: Column) -> Column:
    own = let(F.lower(strip(name)), lambda mine: F.exists(bold, lambda a: F.lower(a) == mine))
    return F.coalesce(has_profile, F.lit(False)) | (F.coalesce(F.size(found), F.lit(0)) > 0) | F.coalesce(own, F.lit(False))


def entities_of(pages: DataFrame, titles: tuple[str, ...] = (), summary_chars: int = 600) -> DataFrame:
    """Pages ``(title, markup, categories, kind, prominence, page_url)`` as sightings of entities, with the page's other columns.

    Pages without text, and those that list things instead of being about one, are left out.  What a page is cut into is
    bound once per page (the explodes of one).
    """
    keep = [c for c in pages.columns if c not in ("markup", "categories")]
    p = pages.where(F.coalesce(F.length("markup"), F.lit(0)) > 0)
    p = p.select(*keep, "categories", templates(preprocess(F.col("markup"))).alias("ts"), lead_markup(F.col("markup")).alias("lead"))
    p = p.select(*keep, "categories", "lead", F.explode(F.array(profile(F.col("ts")))).alias("box"))
    params = F.coalesce("box.params", F.create_map().cast("map<string,string>"))
    p = p.select(*keep, "lead", F.col("box").isNotNull().alias("boxed"), params.alias("params"), canonical_name(F.col("title")).alias("canonical_name"), canon_basis(F.col("title"), F.coalesce("categories", F.array().cast("array<string>"))).alias("b"))
    cut = F.struct(relationships(F.col("params")).alias("relationships"), attributes(F.col("params")).alias("attributes"), lead_aliases(F.col("lead")).alias("bold"))
    p = p.select("*", F.explode(F.array(cut)).alias("x")).where(_is_entity_page(F.col("canonical_name"), F.col("boxed"), F.col("x.relationships"), F.col("x.bold")))
    basis, url = F.col("b.basis"), F.col("page_url")
    with_basis = lambda r, *names: F.struct(*(r[n].alias(n) for n in names), basis.alias("canon_basis"), url.alias("source_url"))
    return p.select(
        *[c for c in keep if c not in ("title", "page_url")],
        "canonical_name",
        basis.alias("canon_basis"),
        _aliases(F.col("params"), F.col("x.bold"), F.col("canonical_name"), titles).alias("aliases"),
        let(plain(F.col("lead")), lambda told: truncate_at_word(told, summary_chars)).alias("summary"),
        life_status(F.col("params")).alias("life_status"),
        F.transform("x.relationships", lambda r: with_basis(r, "target", "kind", "field")).alias("relationships"),
        F.transform("x.attributes", lambda a: with_basis(a, "predicate", "value")).alias("attributes"),
        F.array(F.struct(F.col("title").alias("page_title"), url.alias("page_url"), basis.alias("canon_basis"), F.col("b.evidence").alias("basis_evidence"))).alias("sources"),
    )
