"""Queries over works, texts, pages, entities, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import markup, premise, prose, text, vectors
from factloom.operators import chunks, corpus, entities, retrieval
from factloom.plans import views
from factloom.plans.registry import query
from factloom.sources import aliases, hosts, shared, tables

N_WORDS = r"len(regexp_extract_all({}, '\S+'))"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))


# --- text measures and refining --------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS words, round(coalesce(1000.0 * len(regexp_extract_all(text, '["“”«»「」]')) / nullif(len(regexp_extract_all(text, '\S+')), 0), 0), 6) AS quotes,
    round(coalesce(1000.0 * len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'), lambda x: x LIKE '%_ed')) / nullif(len(regexp_extract_all(text, '\S+')), 0), 0), 6) AS past FROM documents""")
def quote_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", text.words("text").alias("words"), F.round(text.quotes_per_1k("text"), 6).alias("quotes"), F.round(text.past_tense_per_1k("text"), 6).alias("past"))


@query(r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '\S+')) >= 50 AND 1000.0 * len(regexp_extract_all(text, '[\"“”«»「」]')) / len(regexp_extract_all(text, '\S+')) >= 0.5".replace('\\"', '"'))
def prose_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where(text.is_prose("text", 50, 0.5)).select("doc_id")


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


_NOISE = _sql("(?i)" + "|".join(f"(?:{p})" for p in text.BOILERPLATE))
CLEAN = rf"""regexp_replace(array_to_string(list_transform(string_split(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '{_NOISE}')), chr(10)),
    '(?i){_sql(text.DISCLAIMER)}', ' ', 'g'), chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), chr(10)), '^\s+|\s+$', '', 'g')"""


@query(f"SELECT doc_id, length({CLEAN}) AS n, sha256({CLEAN}) AS digest FROM documents")
def boilerplate_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", text.strip_boilerplate("text").alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.sha2("t", 256).alias("digest"))


CHAPTERS = rf"""c AS (SELECT source AS work, doc_id AS pos, {CLEAN} AS clean FROM documents),
    g AS (SELECT *, {N_WORDS.format("clean")} AS words, regexp_replace(regexp_replace(lower(clean), '\s+', ' ', 'g'), '^ | $', '', 'g') AS norm FROM c),
    f AS (SELECT *, words >= 20 AS prose, min(pos) FILTER (WHERE words >= 20) OVER (PARTITION BY norm) AS first FROM g),
    fate AS (SELECT work, pos, words, CASE WHEN NOT prose THEN 'prose' WHEN pos = first THEN 'kept' ELSE 'duplicate' END AS fate FROM f)"""


@query(f"WITH {CHAPTERS} SELECT * FROM fate")
def dedup_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.fates(views.chapters(spark, sf_dir), 20, 0.0, plain=True).select("work", "pos", "words", "fate")


@query(f"WITH {CHAPTERS} SELECT work, pos, sha256(clean) AS digest FROM c JOIN fate USING (work, pos) WHERE fate = 'kept'")
def kept_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned texts that stay, with the full normalisation (NFKC): these texts are in that form already."""
    kept = corpus.clean_chapters(views.chapters(spark, sf_dir), 20, 0.0).where("fate = 'kept'")
    return kept.select("work", "pos", F.sha2("clean", 256).alias("digest"))


@query(f"""WITH {CHAPTERS} SELECT work, count(*) AS chapters, count(*) FILTER (WHERE fate = 'kept') AS kept, count(*) FILTER (WHERE fate = 'prose') AS not_prose,
    count(*) FILTER (WHERE fate = 'duplicate') AS duplicates, coalesce(sum(words) FILTER (WHERE fate = 'kept'), 0) AS words, count(*) FILTER (WHERE fate = 'kept') < count(*) AS is_partial FROM fate GROUP BY work""")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.report(corpus.fates(views.chapters(spark, sf_dir), 20, 0.0, plain=True))


@query(f"""WITH h AS (SELECT doc_id AS pos, {N_WORDS.format("text")} >= 300 AS admitted FROM documents ORDER BY doc_id LIMIT 200)
SELECT pos, admitted, before FROM (SELECT *, coalesce(sum(CAST(admitted AS INT)) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h) WHERE before < 50""")
def admission_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.admit(docs(spark, sf_dir).select(F.col("doc_id").alias("pos"), (text.words("text") >= 300).alias("admitted")), 50)


@query("""WITH s AS (SELECT source, doc_id % 300 AS source_id, doc_id AS pos, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS r FROM documents)
SELECT source, source_id, r AS source_rank, pos FROM (SELECT *, row_number() OVER (PARTITION BY source, source_id ORDER BY r, pos) AS rn FROM s) WHERE rn = 1""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("source", (F.col("doc_id") % 300).alias("source_id"), F.col("doc_id").alias("pos"))
    odd, even = d.where("pos % 2 = 1"), d.where("pos % 2 = 0")
    return corpus.union_sources([odd, even]).select("source", "source_id", "source_rank", "pos")


@query("""SELECT user_id AS id, r AS round, t AS term_pos, p AS pos FROM (SELECT user_id, event_id % 5 AS r, event_id // 5 % 8 AS t, event_id AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 5, event_id // 5 % 8, event_id) AS rn
    FROM events WHERE event_id // 5 % 8 < 6) WHERE rn = 1 ORDER BY r, t, p LIMIT 50""")
def round_robin_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    hits = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (e % 5).alias("round"), (F.floor(e / 5) % 8).alias("term_pos"), e.alias("pos"))
    return corpus.round_robin(hits, 50)


@query("""WITH r AS (SELECT p_name || ' ' || p_partkey % 500 AS title, p_type AS kind, p_partkey AS prominence, p_size = 1 AS protected, CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 2 END AS kind_pos FROM part),
t AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY prominence DESC, title) AS rank FROM r)
SELECT title, kind, prominence, protected FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY kind_pos, rank) AS rn FROM t WHERE rank <= 5 OR protected) WHERE rn = 1""")
def protected_top_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    rows = p.select(F.concat_ws(" ", "p_name", (F.col("p_partkey") % 500).cast("string")).alias("title"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("prominence"), (F.col("p_size") == 1).alias("protected"), F.when(F.col("p_type") == "ECONOMY", 0).when(F.col("p_type") == "STANDARD", 1).otherwise(2).alias("kind_pos"))
    return corpus.protected_top(rows, "kind", "prominence", "protected", 5).select("title", "kind", "prominence", "protected")


@query("""SELECT conv_id AS title, string_agg(role, ',' ORDER BY turn) AS categories, sha256(arg_max(text, turn) FILTER (WHERE role = 'assistant')) AS revision FROM conversations GROUP BY conv_id""")
def merge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "conversations")
    parts = c.select(F.col("conv_id").alias("title"), F.col("turn").alias("round"), F.array("role").alias("categories"), F.when(F.col("role") == "assistant", F.col("text")).alias("revision"))
    return corpus.merge_pages(parts).select("title", F.array_join("categories", ",").alias("categories"), F.sha2("revision", 256).alias("revision"))


LISTS = {n: "[" + ", ".join(f"'{x}'" for x in xs) + "]" for n, xs in (("inner", sorted({*prose.INTERIOR, *prose.SENSORY})),)}
VERBS = "|".join(sorted(prose.TAG_VERBS))
RAMP = "greatest(0.0, least(1.0, (({}) - {}) / ({} - {})))"
PROSE = rf"""t AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?…])["''”’)\]]*\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS sents,
        regexp_extract_all(lower(text), '[A-Za-z][A-Za-z''’]*') AS w, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS blocks,
        list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines FROM documents),
    m AS (SELECT doc_id, text, w, sents, lines, len(w) AS n,
        list_filter(list_transform(sents, lambda s: len(regexp_extract_all(s, '[A-Za-z][A-Za-z''’]*'))), lambda k: k >= 2) AS sl,
        list_transform(CASE WHEN len(blocks) > 1 THEN blocks ELSE lines END, lambda s: len(regexp_extract_all(s, '[A-Za-z][A-Za-z''’]*'))) AS pl,
        list_filter(lines, lambda x: regexp_matches(x, '["“”«»]')) AS spoken,
        list_transform(list_filter(list_transform(range(0, len(w), 400), lambda i: w[i + 1 : i + 400]), lambda c: len(c) >= 40), lambda c: len(list_distinct(c)) * 1.0 / len(c)) AS ttr FROM t),
    v AS (SELECT *, flatten(list_transform(spoken, lambda x: regexp_extract_all(lower(x), '\b({VERBS})\b'))) AS tags FROM m),
    p AS (SELECT doc_id,
        CASE WHEN len(sl) < 4 THEN 0.5 ELSE {RAMP.format("list_stddev_pop(sl)", "2.0", "9.0", "2.0")} END AS sentence_rhythm,
        CASE WHEN len(tags) < 3 THEN 0.5 ELSE 0.5 * (1 - list_max(list_transform(list_distinct(tags), lambda g: len(list_filter(tags, lambda y: y = g)))) * 1.0 / len(tags))
            + 0.5 * (1 - len(list_filter(spoken, lambda x: regexp_matches(x, '^\s*["“]?\s*(?:[A-Z][a-z]+|I|He|She|They|We|You)\s+(?:{VERBS})\s*,?\s*["“]'))) * 1.0 / len(spoken)) END AS dialogue_craft,
        CASE WHEN n < 40 THEN 0.5 ELSE {RAMP.format("list_avg(ttr)", "0.38", "0.62", "0.38")} END AS vocabulary,
        CASE WHEN n = 0 THEN 0.0 ELSE {RAMP.format(f"1000.0 * len(list_filter(w, lambda x: list_contains({LISTS['inner']}, x))) / n", "3.0", "30.0", "3.0")} END AS interiority,
        CASE WHEN len(pl) = 0 THEN 0.0 ELSE (CASE WHEN list_avg(pl) <= 20 THEN {RAMP.format("list_avg(pl)", "5.0", "20.0", "5.0")} WHEN list_avg(pl) <= 150 THEN 1.0 ELSE 1 - {RAMP.format("list_avg(pl)", "150.0", "400.0", "150.0")} END)
            * CASE WHEN len(list_filter(pl, lambda k: k < 8)) * 1.0 / len(pl) > 0.6 THEN 0.4 ELSE 1.0 END END AS paragraphs,
        CASE WHEN n = 0 THEN 0.0 ELSE greatest(0.0, 1 - 0.60 * least(1.0, coalesce(len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z]{{3,}}'))) * 1.0 / nullif(len(list_filter(w, lambda x: length(x) >= 3)), 0), 0.0) / 0.06)
            - 0.25 * {RAMP.format("coalesce(list_max(list_transform(regexp_extract_all(text, '[!?]{2,}'), lambda x: length(x))), 0)", "1.0", "5.0", "1.0")}
            - 0.15 * least(1.0, len(regexp_extract_all(text, '!')) * 1.0 / greatest(len(sents), 1) / 0.25)) END AS punctuation FROM v)"""


@query(f"WITH {PROSE} SELECT doc_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in prose.COMPONENTS) + " FROM p")
def prose_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = prose.with_components(docs(spark, sf_dir).select("doc_id", "text"), "text")
    return scored.select("doc_id", *(F.round(c, 6).alias(c) for c in prose.COMPONENTS))


TOTAL = "100 * (" + " + ".join(f"{w} * {c}" for c, w in prose.WEIGHTS.items()) + ")"


@query(f"WITH {PROSE} SELECT count(*) AS n, round(min({TOTAL}), 1) AS min, round(median({TOTAL}), 1) AS median, round(max({TOTAL}), 1) AS max FROM p")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = prose.with_components(docs(spark, sf_dir).select("doc_id", "text"), "text").select(F.col("doc_id").alias("pos"), prose.quality().alias("score"))
    return corpus.quality_summary(scored).select("n", *(F.round(c, 1).alias(c) for c in ("min", "median", "max")))


@query("SELECT doc_id AS pos, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE n_chars >= 1000 ORDER BY rank LIMIT 200")
def ranked_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two hundred best works from a score on, their lengths being the scores."""
    works = docs(spark, sf_dir).select(F.col("doc_id").alias("pos"), F.col("n_chars").cast("double").alias("score"))
    best = corpus.rank_works(works, 1000.0).limit(200)
    return best.select("pos", F.row_number().over(Window.orderBy(F.desc("score"), "pos")).cast("long").alias("rank"))


@query("SELECT coalesce(bool_and(ok), true) AS ranked FROM (SELECT n_chars <= coalesce(lag(n_chars) OVER (ORDER BY doc_id), n_chars) AS ok FROM documents)")
def ranking_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.is_ranked(docs(spark, sf_dir).select(F.col("n_chars").alias("score"), F.col("doc_id").alias("pos")))


@query(r"""WITH d AS (SELECT doc_id, lang, source, ' ' || lower(text) AS said, n_chars AS reads, doc_id % 7 AS votes, doc_id % 11 = 0 AS mature FROM documents)
SELECT doc_id, regexp_matches(said, '\bof\W*the\b') AS hit FROM d WHERE NOT mature AND reads >= 200 AND votes >= 1 AND lang = 'en'
AND (regexp_matches(said || ' ' || source, '\btrash\W*(?:fan\W*fictions?|fan\W*fics?|fics?)\b|\b(?:fan\W*fictions?|fan\W*fics?|fics?)\W*trash\b')
    OR (source = 'src1' OR regexp_matches(said, '\bsrc\W*1\b'))::INT + regexp_matches(said, '\bof\W*the\b')::INT + regexp_matches(said, '\btrash\b')::INT >= 2)""")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works whose description is the whole text: two of three names, by tag or in words, or a declaration."""
    d = docs(spark, sf_dir)
    d = d.select("doc_id", F.lit("").alias("title"), F.col("text").alias("description"), F.array("source").alias("tags"), F.col("lang").alias("language"), F.col("n_chars").alias("reads"), (F.col("doc_id") % 7).alias("votes"), (F.col("doc_id") % 11 == 0).alias("mature"))
    terms = ["src 1", "of the", "trash"]
    hit = text.alias_hits(F.lit(""), F.col("description"), F.array().cast("array<string>"), ["Of The"]) > 0
    return d.where(text.is_relevant("trash", terms, min_hits=2, min_reads=200, min_votes=1)).select("doc_id", hit.alias("hit"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CASE WHEN length(p_name) <= 9 THEN p_name ELSE left(p_name, 6) || '...' END AS short, CASE WHEN ' ' || p_name || ' ' LIKE '% ring %' OR ' ' || p_name || ' ' LIKE '% red %' THEN true ELSE false END AS matches FROM part")
def labels_and_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    return p.select("p_partkey", text.slugify(F.concat("p_name", F.lit(" / "), "p_type", F.lit("!"))).alias("slug"), text.truncate(F.col("p_name"), 9).alias("short"), text.label_matches(F.col("p_name"), ["Ring", "red", "xx"]).alias("matches"))


# --- premises ----------------------------------------------------------------------------------------------------------

#: What the works are about: titles, blurbs and tags that go through every pattern, with names that are read off the texts
#: themselves (see ``premised``), so that nothing here says what comes out.
BLURBS = (
    ("The Long Night", "@ doesn't kill # and everything turns.", ""),
    ("If he stayed", "What would change if @ lived and they grow old together?", ""),
    ("Mercy", "She lets @ go at last. # never lied.", ""),
    ("Quarter", "He spared @ twice over.", "Drama"),
    ("Alive", "@ survives, but # wakes up alone.", ""),
    ("After the wreck", "@ and Paul, two of the few survivors of the wreck, meet again.", ""),
    ("Years", "It is 20 years later and # wakes up. The end.", ""),
    ("Tagged", "Nothing is said here.", "ifjacklived"),
    ("@ x #", "A story.", ""),
    ("Alone", "A baby is found at the door.", ""),
    ("Harry Potter / Star Wars fanfiction", "A tale.", ""),
    ("Two worlds", "A crossover of sorts.", ""),
    ("You", "@ x reader in a modern AU.", ""),
    ("Insert", "Some reader-insert or y/n story.", "peterxreader"),
    ("Frozen in time", "They wake in a modern AU.", ""),
    ("Isekai", "She is transported to a realm; what if?", ""),
    ("Beyond", "Life after the war, and a love triangle.", ""),
    ("Guests", "An original character dies: character death.", ""),
    ("The x That", "The doesn't kill This.", ""),
    ("Nothing", "Nothing at all happens here.", ""),
)
#: A capitalised word of ASCII letters with no letter beside it.
WHO = r"[^\p{L}]([A-Z][a-z]{2,})[^\p{L}]"
_SLUG = "array_to_string(regexp_extract_all(lower({}), '[a-z0-9]+'), '-')"
_IS_NAME = f"(len(regexp_extract_all(lower({{0}}), '[a-z0-9]+')) > 0 AND NOT list_has_any(regexp_extract_all(lower({{0}}), '[a-z0-9]+'), [{', '.join(repr(x) for x in premise.NO_NAMES)}]))"
_FLAT = "list_transform(tags, lambda t: regexp_replace(lower(t), '[^a-z0-9]+', '', 'g'))"
_NONE = "CAST([] AS VARCHAR[])"


def _names(found: str) -> str:
    return f"list_transform(list_filter({found}, lambda x: {_IS_NAME.format('x')}), lambda x: {_SLUG.format('x')})"


def _first_seen(xs: str) -> str:
    return f"list_filter(list_transform(range(1, len({xs}) + 1), lambda i: CASE WHEN list_position({xs}, {xs}[i]) = i THEN {xs}[i] END), lambda x: x IS NOT NULL AND x <> '')"


def _case(column: str, of: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{_sql(v)}'" for k, v in of.items()) + " END"


_BLURB_ROWS = ", ".join(f"({n}, '{_sql(a)}', '{_sql(b)}', '{_sql(c)}')" for n, (a, b, c) in enumerate(BLURBS))
_FIRED = {t: f"regexp_matches(said, '{_sql(p)}')" for t, p in premise.SIMPLE.items()} | {
    "character_survives": "len(survivors) > 0",
    "crossover": f"len(worlds) > 0 OR regexp_matches(said, '{_sql(premise.CROSSOVER_WORD)}')",
    "reader_insert": "reader",
    "pairing": "len(pair) > 0",
}
_LONE = [t for t in premise.PRECEDENCE if t not in premise.WITH_ENTITIES]


def _told(of: dict[str, str], short: dict[str, str]) -> str:
    """A template by trope in SQL: with names, or as ``short`` has it without."""
    return f"CASE WHEN len(entities) = 0 THEN {_case('tropes[1]', of | short)} ELSE replace({_case('tropes[1]', of)}, '{{entities}}', names) END"


PREMISE_SQL = rf"""b(k, title, blurb, tag) AS (VALUES {_BLURB_ROWS}),
    n AS (SELECT doc_id, source, regexp_extract_all(text, '{WHO}', 1) AS names FROM documents),
    w0 AS (SELECT doc_id AS pos, source || '/' || doc_id AS handle, title, blurb, tag, coalesce(names[1], 'Anna') AS a, coalesce(names[2], 'Peter') AS z FROM n JOIN b ON k = doc_id % {len(BLURBS)}),
    w1 AS (SELECT pos, handle, replace(replace(title, '@', a), '#', z) AS title, replace(replace(blurb, '@', a), '#', z) AS blurb, CASE WHEN tag = '' THEN {_NONE} ELSE [tag] END AS tags FROM w0),
    w2 AS (SELECT *, title || '. ' || blurb AS said FROM w1),
    w3 AS (SELECT *, string_split(regexp_replace(regexp_replace(said, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS sentences,
        {" || ".join(_names(f"regexp_extract_all(said, '{_sql(p)}', {g})") for p, g in premise.SURVIVAL)} AS saved,
        regexp_extract_all(title, '{_sql(premise.CROSSOVER_TITLE)}', 1) AS w_a, regexp_extract_all(title, '{_sql(premise.CROSSOVER_TITLE)}', 2) AS w_b,
        regexp_extract(title, '{premise.PAIRING}', 1) AS p_a, regexp_extract(title, '{premise.PAIRING}', 2) AS p_b, regexp_extract(said, '{_sql(premise.READER_TARGET)}', 1) AS target FROM w2),
    w4 AS (SELECT *, saved || {_names(f"list_filter(list_transform(list_filter(sentences, lambda s: regexp_matches(s, '{premise.TIME_GAP}')), lambda s: regexp_extract(s, '{premise.WAKES}', 1)), lambda x: x <> '')")}
            || list_transform({_FLAT}, lambda t: regexp_extract(t, '{premise.SURVIVAL_TAG}', 1)) AS raw_survivors,
        flatten(list_transform(list_zip(w_a, w_b), lambda p: [{_SLUG.format('p[1]')}, {_SLUG.format('p[2]')}])) AS raw_worlds,
        (CASE WHEN target <> '' AND {_IS_NAME.format('target')} THEN [{_SLUG.format('target')}] ELSE {_NONE} END)
            || list_filter(list_transform(list_filter({_FLAT}, lambda t: t LIKE '%xreader'), lambda t: regexp_replace(t, 'xreader$', '')), lambda t: t NOT IN ('charecter', 'character')) AS raw_readers,
        {" OR ".join(f"regexp_matches(said, '{p}')" for p in premise.READER)} OR len(list_filter({_FLAT}, lambda t: t LIKE '%xreader')) > 0 AS reader,
        CASE WHEN p_a <> '' AND lower(p_a) <> 'reader' AND lower(p_b) <> 'reader' AND {_IS_NAME.format('p_a')} AND {_IS_NAME.format('p_b')} THEN list_sort([{_SLUG.format('p_a')}, {_SLUG.format('p_b')}]) ELSE {_NONE} END AS pair FROM w3),
    w5 AS (SELECT *, {_first_seen("raw_survivors")} AS survivors, list_filter({_first_seen("raw_worlds")}, lambda x: x <> 'the-main-line') AS worlds, {_first_seen("raw_readers")} AS readers FROM w4),
    w6 AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {_FIRED[t]} THEN '{t}' END" for t in premise.PRECEDENCE)}], lambda x: x IS NOT NULL) AS tropes FROM w5),
    w7 AS (SELECT *, CASE tropes[1] WHEN 'character_survives' THEN survivors[1:1] WHEN 'crossover' THEN worlds WHEN 'reader_insert' THEN readers WHEN 'pairing' THEN pair ELSE {_NONE} END AS entities FROM w6),
    w8 AS (SELECT *, array_to_string(list_transform(entities, lambda e: array_to_string(list_transform(string_split(e, '-'), lambda x: upper(x[1]) || x[2:]), ' ')), ' & ') AS names,
        CASE WHEN len(tropes) = 0 THEN 'unclassified' WHEN len(entities) = 0 THEN tropes[1] ELSE tropes[1] || ':' || array_to_string(list_sort(entities), '+') END AS key FROM w7),
    work AS (SELECT pos, handle, key, tropes, {_told(premise.LABELS, {"crossover": "Crossover", "reader_insert": "Reader-insert romance"})} AS label,
        {_told(premise.CANON, {})} AS canon_option,
        {_told(premise.ALTERNATES, {"crossover": "Pull in and cross the two worlds", "reader_insert": "A newcomer becomes close to"})}
            || array_to_string(list_transform(tropes[2:3], lambda t: ', ' || {_case("t", premise.CLAUSES)}), '') AS alternate FROM w8)"""


def premised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as works, each with one of a few blurbs about the first two capitalised words of its text."""
    n = (F.col("doc_id") % len(BLURBS)).cast("int")
    pick = lambda k: F.element_at(F.array(*(F.lit(b[k]) for b in BLURBS)), n + 1)
    names = F.regexp_extract_all("text", F.lit(WHO), F.lit(1))
    d = docs(spark, sf_dir).select("doc_id", "source", F.slice(names, 1, 2).alias("who"))
    a, z = F.coalesce(F.get("who", F.lit(0)), F.lit("Anna")), F.coalesce(F.get("who", F.lit(1)), F.lit("Peter"))
    about = lambda k: F.replace(F.replace(pick(k), F.lit("@"), a), F.lit("#"), z)
    tags = F.when(pick(2) == "", F.array().cast("array<string>")).otherwise(F.array(pick(2)))
    w = d.select(F.col("doc_id").alias("pos"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("handle"), about(0).alias("title"), about(1).alias("description"), tags.alias("tags"))
    # explodes of one: each step is worked out once per work, not once per use
    w = w.select("pos", "handle", F.explode(F.array(premise.signature(F.col("title"), F.col("description"), F.col("tags"), "the main line"))).alias("s"))
    return w.select("pos", "handle", F.explode(F.array(premise.read_signature(F.col("s")))).alias("premise"))


@query(f"WITH {PREMISE_SQL} SELECT pos, key, array_to_string(tropes, ',') AS tropes, label, alternate FROM work")
def premises(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = premised(spark, sf_dir).select("pos", "premise.*")
    return w.select("pos", "key", F.array_join("tropes", ",").alias("tropes"), "label", "alternate")


@query(f"WITH {PREMISE_SQL} SELECT key, count(*) AS size, arg_min(label, pos) FILTER (WHERE label IS NOT NULL) AS label, arg_min(handle, pos) AS first, arg_max(handle, pos) AS last FROM work GROUP BY key")
def premise_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.premise_groups(premised(spark, sf_dir))


@query(f"""WITH {PREMISE_SQL}, s AS (SELECT key, alternate AS label, count(*) AS support FROM work WHERE len(tropes) > 0 GROUP BY key, alternate),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY support DESC, label) AS option FROM s),
kept AS (SELECT key, option, label, support, sum(support) OVER (PARTITION BY key) AS point_support FROM o WHERE option < 4)
SELECT * FROM kept UNION ALL SELECT key, 0, arg_min(canon_option, pos), 0, any_value(point_support) FROM work JOIN (SELECT DISTINCT key, point_support FROM kept) USING (key) GROUP BY key""")
def branch_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.branch_points(premised(spark, sf_dir)).select("key", F.col("option").cast("long").alias("option"), "label", "support", "point_support")


# --- hosts -------------------------------------------------------------------------------------------------------------


ARCHIVE_SQL = """r AS (SELECT *, CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_brand || ', Other' END AS fandom, p_type || ', ' || p_name AS people,
        CASE WHEN p_size % 5 = 0 THEN [] ELSE ['Angst'] END || CASE WHEN p_size % 3 = 0 THEN ['A/B'] ELSE [] END || ['F/M'] AS free, CASE WHEN p_size % 4 = 0 THEN '3/3' WHEN p_size % 4 = 1 THEN '3/?' ELSE '' END AS done FROM part)
    SELECT 'ao3' AS source, id, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'someone' ELSE 'Byron' END AS author, 'https://archiveofourown.org/works/' || id AS url,
        'Fandom: ' || fandom || '. Characters: ' || people || '. Tags: ' || array_to_string(free, ', ') || '.' AS description,
        array_to_string(string_split(fandom, ', ') || string_split(people, ', ') || free || ['ao3_fandom:' || fandom, 'ao3_characters:' || people] || CASE WHEN done = '' THEN [] ELSE ['ao3_chapters:' || done] END, '|') AS tags,
        CASE WHEN p_size % 3 = 0 THEN p_partkey * 1000 + 7 ELSE 0 END AS reads, CASE WHEN p_size % 3 = 0 THEN p_size ELSE 0 END AS votes, p_size % 4 = 0 OR p_size % 7 = 0 AS completed,
        p_size % 3 = 0 OR p_size % 10 = 1 AS mature, CASE WHEN p_size % 2 = 0 THEN 'en' WHEN p_size % 3 = 0 THEN 'fr' ELSE 'kl' END AS language, p_partkey * 1000 + 7 AS words, 'a:1:' || p_name AS chapter
    FROM r WHERE p_size % 6 <> 5"""


@query(f"WITH {ARCHIVE_SQL.replace("'a:1:' || p_name", "id || ':1:' || p_name")}")
def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of the archive's mirror: labels under either spelling, missing fields, and every sixth without text."""
    p = views.table(spark, sf_dir, "part")
    k, n = F.col("p_size"), F.col("p_partkey").cast("string")
    even = k % 2 == 0
    meta = {
        "author": F.when(even, "by someone ").otherwise("Byron"),
        "Language": F.when(even, "English").when(k % 3 == 0, "Français").otherwise("Klingon"),
        "Rating": F.when(k % 3 == 0, "Explicit").otherwise("General"),
        "Archive Warning": F.when(k % 10 == 1, "Underage Sex").otherwise("None"),
        "chapters": F.when(k % 4 == 0, "3/3"),
        "Chapters": F.when(k % 4 == 1, "3/?"),
        "completed": F.when(k % 7 == 0, "2010-04-27").otherwise(""),
        "words": F.concat(n, F.lit(",007")),
        "Hits": F.when(k % 3 == 0, F.concat(n, F.lit(",007"))),
        "Kudos": F.when(k % 3 == 0, k.cast("string")),
        "Fandom": F.when(even, F.col("p_brand")),
        "Fandoms": F.when(even, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit(" , Other,"))),
        "Characters": F.concat_ws(", ", "p_type", "p_name"),
        "Character": F.col("p_type"),
        "Additional Tags": F.when(k % 5 != 0, "Angst"),
        "Relationship": F.when(k % 3 == 0, "A/B"),
        "Category": F.lit("F/M"),
    }
    fields = F.create_map(*(x for name, v in meta.items() for x in (F.lit(name), v.cast("string"))))
    raw = p.select(F.to_json(F.struct(n.alias("id"), F.concat(F.lit(" "), "p_name").alias("title"), fields.alias("metadata"), F.when(k % 6 != 5, "some text").otherwise(" ").alias("text"))).alias("raw"))
    ref = F.get("chapter_refs", F.lit(0))
    found = hosts.archive_rows(raw, "raw").withColumn("tags", F.array_join("tags", "|"))
    found = found.withColumn("chapter", F.concat_ws(":", ref["source_id"], ref["index"].cast("string"), ref["title"]))
    return found.select("source", "id", "title", "author", "url", "description", "tags", "reads", "votes", "completed", "mature", "language", "words", "chapter")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, 'en' AS language, CAST(p_retailprice AS BIGINT) AS reads, 0 AS votes, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS chapters, 1 AS first_index FROM (SELECT * REPLACE (floor(p_retailprice) AS p_retailprice) FROM part) WHERE p_size % 5 <> 0""")
def host_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    part = lambda k, draft: F.struct(F.lit(k).alias("id"), F.lit(k).alias("title"), draft.alias("draft"))
    raw = p.select(F.to_json(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), (F.col("p_size") % 5 == 0).alias("deleted"), F.lit("English").alias("language"), F.col("p_retailprice").cast("string").alias("readCount"), F.lit("-3").alias("voteCount"), F.array(part("a", F.col("p_size") % 2 == 0), part("b", F.lit(False))).alias("parts"))).alias("raw"))
    found = hosts.host_rows(raw, "raw")
    return found.select("id", "language", "reads", "votes", F.size("chapter_refs").alias("chapters"), F.get("chapter_refs", F.lit(0))["index"].alias("first_index"))


@query("SELECT n_nationkey, lower(replace(n_name, '_', '')) || '|' || CASE WHEN contains(n_name, '_') THEN lower(replace(n_name, '_', '-')) || '|' ELSE '' END AS candidates FROM nation")
def wiki_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.table(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.array_join(F.transform(hosts.wiki_candidates(F.col("n_name")), lambda c: F.concat(c, F.lit("|"))), "").alias("candidates"))


@query("""SELECT r_regionkey, 'Realm of ' || r_name || ',The ' || r_name || ' Book' AS aliases FROM region""")
def clean_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.table(spark, sf_dir, "region")
    n = F.col("r_name")
    titles = F.array(n, F.concat(F.lit("Realm of "), n), F.concat(F.lit("realm OF "), n, F.lit(" (place)")), F.concat(F.lit("List of things in "), n), F.concat(n, F.lit(" (franchise)")), F.lit("xy"), F.concat(F.lit("The "), n, F.lit(" Book")), F.concat(n, F.lit(" soundtrack")))
    return r.select("r_regionkey", F.array_join(text.clean_aliases(titles, n), ",").alias("aliases"))


# --- pages and entities ------------------------------------------------------------------------------------------------

PLAIN = r"""regexp_replace(regexp_replace(array_to_string(list_transform(string_split(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(?:p|div|h[1-6]|li|blockquote)\s*>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


@query(f"SELECT page_id, length({PLAIN}) AS n, sha256({PLAIN}) AS digest FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "pages").select("page_id", text.html_to_text("html", full=False).alias("t"))
    return p.select("page_id", F.length("t").cast("long").alias("n"), F.sha2("t", 256).alias("digest"))


@query("""SELECT p_partkey, p_name AS canonical, CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'both' WHEN p_size % 2 = 0 THEN 'novel' WHEN p_size % 3 = 0 THEN 'screen' ELSE 'unknown' END AS basis,
    CASE WHEN p_size % 2 = 0 THEN p_name || ' (Novels)' ELSE '' END || CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN '|' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN 'Category:Season 3 people' ELSE '' END AS evidence FROM part""")
def canon_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part").withColumn("title", F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " (Novels)").otherwise("")))
    cats = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("Category:Season 3 people"), F.lit("Category:Tall"))).otherwise(F.array(F.lit("Tall")))
    b = markup.canon_basis(F.col("title"), cats)
    return p.select("p_partkey", markup.canonical_name(F.col("title")).alias("canonical"), b["basis"].alias("basis"), F.array_join(b["evidence"], "|").alias("evidence"))


@query("""WITH p AS (SELECT *, p_size % 3 = 0 AS boxed, p_size % 4 = 0 AS bold FROM part WHERE p_size % 3 = 0 OR p_size % 4 = 0)
SELECT p_partkey, 'Q ' || p_name || ' ' || p_partkey AS canonical_name, CASE WHEN p_size % 2 = 0 THEN CASE WHEN boxed THEN 'both' ELSE 'novel' END WHEN boxed THEN 'screen' ELSE 'unknown' END AS canon_basis,
    CASE WHEN boxed THEN 'deceased' ELSE 'unknown' END AS life, array_to_string(CASE WHEN boxed THEN ['Old ' || p_brand, 'Captain Ahab'] ELSE [] END || ['Big Ben'], '|') AS aliases,
    CASE WHEN boxed THEN p_type || ':brother:relatives|Ann Lee:spouse:spouse' ELSE '' END AS relations, CASE WHEN boxed THEN 'status=Deceased|home=' || p_type ELSE '' END AS attributes,
    'Q ' || p_name || ' ' || p_partkey || ' is a ' || p_type || ' thing. Big Ben.' AS summary, 'Q ' || p_name || ' ' || p_partkey || CASE WHEN p_size % 2 = 0 THEN ' (novel)' ELSE '' END AS page FROM p""")
def wiki_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per part, read as an entity: some with a profile, some with their name in bold, others only lists, which go."""
    n, t, b, k = F.concat_ws(" ", F.lit("Q"), "p_name", F.col("p_partkey").cast("string")), F.col("p_type"), F.col("p_brand"), F.col("p_size")
    box = F.concat(F.lit("{{Box\n|status = '\''Deceased'\''\n|image = a.png\n|relatives = [["), t, F.lit("]] <small>(brother)</small>, of old\n|spouse = Ann Lee<br/>[[ann lee|her]]\n|age = unknown\n|aliases = Old "), b, F.lit("<br/>Captain Ahab (once)\n|home = [[X|"), t, F.lit("]]\n}}\n"))
    own = F.when(k % 4 == 0, F.concat(F.lit("\'\'\'"), n, F.lit("\'\'\'"))).otherwise(n)
    page = F.concat(F.lit("<!-- x -->{{Quote|hm}}"), F.when(k % 3 == 0, box).otherwise(""), own, F.lit(" is a \'\'"), t, F.lit("\'\' thing.<ref>r</ref> \'\'\'Big Ben\'\'\'.\n== More ==\nrest"))
    title = F.concat(n, F.when(k % 2 == 0, " (novel)").otherwise(""))
    cats = F.when(k % 3 == 0, F.array(F.lit("Category:Season 3 people"))).otherwise(F.array(F.lit("Tall")))
    pages = views.table(spark, sf_dir, "part").select("p_partkey", title.alias("title"), page.alias("markup"), cats.alias("categories"), F.lit("u").alias("page_url"))
    e = markup.entities_of(pages)
    told = lambda xs, *names: F.array_join(F.transform(xs, lambda x: F.concat_ws("=" if "value" in names else ":", *(x[m] for m in names))), "|")
    return e.select("p_partkey", "canonical_name", "canon_basis", F.col("life_status").alias("life"), F.array_join("aliases", "|").alias("aliases"), told(F.col("relationships"), "target", "kind", "field").alias("relations"), told(F.col("attributes"), "predicate", "value").alias("attributes"), "summary", F.get("sources", F.lit(0))["page_title"].alias("page"))


ENTITY_SQL = """e0 AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 50 = 0 THEN p_name || ' ' || p_partkey WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE ' ' || p_brand END AS canonical_name,
        CASE WHEN p_size % 3 = 0 THEN 'other' ELSE lower(p_type) END AS kind, p_size % 4 AS bits, CASE WHEN p_size % 5 = 0 THEN 'alive' ELSE 'unknown' END AS life_status, p_name AS summary,
        [string_split(p_name, ' ')[1], ' ' || lower(p_brand)] AS aliases, string_split(p_name, ' ')[-1] AS target, lower(p_type) AS rel, CAST(p_size AS VARCHAR) AS size, p_partkey % 97 AS prominence FROM part),
    e AS (SELECT *, lower(trim(canonical_name)) AS name, count(*) OVER (PARTITION BY lower(trim(canonical_name))) AS sightings, (length(summary) * 1000 + prominence) * 1000000000 - pos AS rich FROM e0),
    b(bits, basis) AS (VALUES (0, 'unknown'), (1, 'novel'), (2, 'screen'), (3, 'both')),
    al AS (SELECT name, pos, sightings, 0 AS nth, aliases[1] AS alias FROM e UNION ALL SELECT name, pos, sightings, 1, aliases[2] FROM e),
    low AS (SELECT name, lower(trim(alias)) AS k, arg_min(alias, pos * 2 + nth) AS alias, min(pos * 2 + nth) AS o FROM al WHERE sightings > 1 AND lower(trim(alias)) <> name GROUP BY 1, 2
        UNION ALL SELECT name, NULL, alias, pos * 2 + nth FROM al WHERE sightings = 1),
    a AS (SELECT name, list(alias ORDER BY o) AS aliases FROM low GROUP BY name),
    m AS (SELECT name, arg_max(canonical_name, rich) AS canonical_name, bit_or(bits) AS bits, coalesce(arg_min(kind, pos) FILTER (WHERE kind <> 'other'), 'other') AS kind,
        coalesce(arg_min(life_status, pos) FILTER (WHERE life_status <> 'unknown'), 'unknown') AS life_status, arg_max(summary, rich) AS summary, max(prominence) AS prominence, count(*) AS sightings, min(pos) AS pos,
        coalesce(any_value(a.aliases), []) AS aliases FROM e LEFT JOIN a USING (name) GROUP BY name),
    r AS (SELECT name, pos, sightings, 0 AS nth, target, rel, pos % 4 AS bits FROM e UNION ALL SELECT name, pos, sightings, 1, ' ' || upper(target), rel, (pos + 1) % 4 FROM e),
    mr AS (SELECT name, arg_min(target, pos * 2 + nth) AS target, arg_min(rel, pos * 2 + nth) AS kind, bit_or(bits) AS bits FROM r GROUP BY name, lower(trim(target)), lower(rel), CASE WHEN sightings = 1 THEN nth END)"""


@query(f"WITH {ENTITY_SQL} SELECT name, canonical_name, basis AS canon_basis, kind, life_status, summary, prominence, sightings, array_to_string(aliases, ',') AS aliases FROM m JOIN b USING (bits)")
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = entities.merge(views.entities(spark, sf_dir))
    return m.select("name", "canonical_name", "canon_basis", "kind", "life_status", "summary", "prominence", "sightings", F.array_join("aliases", ",").alias("aliases"))


@query(f"WITH {ENTITY_SQL} SELECT canonical_name, row_number() OVER (ORDER BY prominence DESC, canonical_name) AS place FROM m ORDER BY place LIMIT 20")
def entity_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most prominent names."""
    lead = entities.in_order(entities.merge(views.entities(spark, sf_dir))).limit(20)
    return lead.select("canonical_name", F.row_number().over(Window.orderBy(F.desc("prominence"), "canonical_name")).cast("long").alias("place"))


@query(f"WITH {ENTITY_SQL} SELECT name, target, kind, basis AS canon_basis FROM mr JOIN b USING (bits)")
def entity_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.merge_relationships(views.entities(spark, sf_dir))


@query(f"WITH {ENTITY_SQL} SELECT name, 'size' AS predicate, size AS value, basis AS canon_basis FROM (SELECT name, size, bit_or(pos % 4) AS bits FROM e GROUP BY ALL) JOIN b USING (bits)")
def entity_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.merge_attributes(views.entities(spark, sf_dir))


@query(f"WITH {ENTITY_SQL} SELECT name, arg_min('Page ' || target, pos) AS page_title, arg_min('u/' || pos, pos) AS page_url, arg_min(target, pos) AS evidence FROM e GROUP BY name, lower(target)")
def entity_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = entities.merge_sources(views.entities(spark, sf_dir))
    return s.select("name", "page_title", "page_url", F.array_join("basis_evidence", ",").alias("evidence"))


@query(f"""WITH {ENTITY_SQL} SELECT kind || ':' || regexp_replace(lower(canonical_name), '[^a-z0-9]+', '-', 'g') AS natural_key, array_to_string(list_sort(list_distinct([target])), ',') AS evidence, '1.0' AS version FROM e""")
def index_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity index as written to JSON and read again, with the version of its manifest."""
    path = shared.folder(spark, "index")
    tables.write_index(views.entities(spark, sf_dir), path)
    version = spark.read.schema("schema_version string, entities long").json(f"{path}/manifest")
    rows = spark.read.schema("natural_key string, basis_evidence array<string>").json(f"{path}/entities")
    return rows.select("natural_key", F.array_join("basis_evidence", ",").alias("evidence")).join(F.broadcast(version.select(F.col("schema_version").alias("version"))))


@query(f"WITH {ENTITY_SQL} SELECT kind AS value, count(*) AS n, 'kind' AS by FROM e GROUP BY kind UNION ALL SELECT basis, count(*), 'basis' FROM e JOIN b USING (bits) GROUP BY basis")
def entity_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.tallies(views.entities(spark, sf_dir))


NAME_SQL = "n AS (SELECT name AS match, name, pos, 0 AS o, bits FROM m UNION ALL SELECT lower(trim(aliases[i])), name, pos, i, bits FROM m, range(1, 100) t(i) WHERE i <= len(aliases))"


@query(f"WITH {ENTITY_SQL}, {NAME_SQL} SELECT match, arg_min(name, pos * 1000 + o) AS name FROM n GROUP BY match")
def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.name_index(entities.merge(views.entities(spark, sf_dir)))


@query(f"WITH {ENTITY_SQL}, {NAME_SQL} SELECT DISTINCT target FROM mr WHERE lower(target) NOT IN (SELECT match FROM n)")
def unresolved_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = views.entities(spark, sf_dir)
    return entities.unresolved_targets(entities.merge(seen), entities.merge_relationships(seen))


@query(f"WITH {ENTITY_SQL}, {NAME_SQL} SELECT DISTINCT match FROM n WHERE bits = 3")
def basis_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.vocabulary(entities.merge(views.entities(spark, sf_dir)), "both")


@query("""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{4,}')[1:3] AS w FROM benchmark),
n AS (SELECT DISTINCT 'e' || item_id AS name, unnest(w) AS match, ['unknown', 'novel', 'screen', 'both'][item_id % 4 + 1] AS basis, item_id % 97 AS rank FROM w),
h AS (SELECT DISTINCT doc_id AS id, name, basis, rank FROM documents, n WHERE contains(lower(text), match))
SELECT d.doc_id AS id, coalesce(string_agg(name, ',' ORDER BY rank DESC, name), '') AS names, CASE WHEN bool_or(basis = 'screen') THEN 'screen' WHEN bool_and(basis = 'unknown') IS NOT false THEN 'unknown' WHEN bool_or(basis = 'novel') THEN 'novel' ELSE 'both' END AS basis
FROM documents d LEFT JOIN h ON h.id = d.doc_id GROUP BY d.doc_id""")
def classify_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the entities they name, the entity table being the benchmark's items."""
    return entities.classify(docs(spark, sf_dir), views.named(spark, sf_dir), "doc_id", "text").select("id", F.array_join("names", ",").alias("names"), "basis")


# --- chunks and vectors ------------------------------------------------------------------------------------------------


def chunk_sql(size: int, overlap: int) -> str:
    """Chunks of documents by recursion: where the next begins depends on where this one ends."""

    def end(lo: str) -> str:
        head = f"substr(t, {lo} + 1, {size})"
        last = f"length(regexp_extract({head}, '(?s)^(.*)[.\n]', 1))"
        return f"CASE WHEN {lo} + {size} < n AND regexp_matches({head}, '[.\n]') AND {last} > {size} * 0.5 THEN {lo} + {last} + 1 ELSE least({lo} + {size}, n) END"

    return rf"""d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
    walk(doc_id, t, n, lo, hi) AS (
        SELECT doc_id, t, n, CAST(0 AS BIGINT), {end("0")} FROM d WHERE n > 0
        UNION ALL SELECT doc_id, t, n, nlo, {end("nlo")} FROM (SELECT doc_id, t, n, greatest(hi - {overlap}, lo + 1) AS nlo FROM walk WHERE hi < n)),
    body AS (SELECT doc_id, lo, substr(t, lo + 1, hi - lo) AS q FROM walk),
    chunk AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY lo) - 1 AS chunk, lo + length(q) - length(regexp_replace(q, '^\s+', '')) AS char_start, regexp_replace(q, '^\s+|\s+$', '', 'g') AS quote FROM body WHERE regexp_matches(q, '\S'))"""


@query(f"WITH RECURSIVE {chunk_sql(1000, 200)} SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(char_start AS INT) AS char_start, CAST(char_start + length(quote) AS INT) AS char_end, sha256(quote) AS digest FROM chunk")
def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks.chunks(docs(spark, sf_dir), "doc_id", "text")
    return c.select(F.col("id").alias("doc_id"), "chunk", "char_start", "char_end", F.sha2("quote", 256).alias("digest"))


def embed_sql(rows: str, key: str, text_col: str) -> str:
    """Signed bucket counts v(key, bucket, v) of the grams of a table's texts."""
    return rf"""t AS (SELECT {key} AS key, lower(regexp_replace({text_col}, '^\s+|\s+$', '', 'g')) AS t FROM {rows}), g AS (SELECT key, unnest(range(1, CAST(greatest(length(t) - 2, 1) AS BIGINT) + 1)) AS i, t FROM t WHERE t <> ''),
    grams AS (SELECT key, substr(t, i, 3) AS g, count(*) AS n FROM g GROUP BY ALL), h AS (SELECT key, n, sha256(g) AS h FROM grams),
    v AS (SELECT key, CAST('0x' || substr(h, 15, 2) AS INT) AS bucket, sum(n * (1 - 2 * (CAST('0x' || substr(h, 18, 1) AS INT) % 2))) AS v FROM h GROUP BY ALL)"""


@query(f"WITH {embed_sql('documents', 'doc_id', 'text')} SELECT key AS doc_id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY key)), 6) AS value FROM v WHERE v <> 0")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = docs(spark, sf_dir).select("doc_id", F.posexplode(vectors.embed(F.col("text"))).alias("bucket", "value"))
    return b.where("value <> 0").select("doc_id", "bucket", F.round("value", 6).alias("value"))


QUESTION = "thion of the reat"


@query(f"""WITH RECURSIVE {chunk_sql(400, 80)}, every AS (SELECT doc_id || ':' || chunk AS key, quote FROM chunk UNION ALL SELECT 'q', '{QUESTION}'), {embed_sql("every", "key", "quote")},
norm AS (SELECT key, sqrt(sum(v * v)) AS n FROM v GROUP BY key), s AS (SELECT v.key, sum(v.v * q.v) / any_value(n.n) / any_value(m.n) AS score FROM v JOIN norm n USING (key), (SELECT * FROM v WHERE key = 'q') q, (SELECT n FROM norm WHERE key = 'q') m WHERE v.bucket = q.bucket AND v.key <> 'q' GROUP BY v.key)
SELECT doc_id AS id, CAST(chunk AS INT) AS chunk, CAST(char_start AS INT) AS char_start, CAST(char_start + length(quote) AS INT) AS char_end, round(score, 6) AS score FROM s JOIN chunk ON doc_id || ':' || chunk = key ORDER BY round(s.score, 12) DESC, doc_id, chunk LIMIT 10""")
def retrieve_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of all documents nearest to a question."""
    found = retrieval.retrieve(docs(spark, sf_dir), "doc_id", "text", QUESTION, 10, 400, 80)
    return found.select("id", "chunk", "char_start", "char_end", F.round("score", 6).alias("score"))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 0)
SELECT vec_id AS fact_id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v, q WHERE label % 2 = 0 AND label + 1 <= 6 AND vec_id % 13 <> 0 ORDER BY list_cosine_similarity(v.e, q.e) DESC, vec_id LIMIT 20""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.vectors(spark, sf_dir)
    q = v.where("fact_id = 0").select("vector").first()["vector"]
    return retrieval.search(v, "f0", F.array(*(F.lit(x) for x in q)), "audience", 6, 20).select("fact_id", F.round("score", 6).alias("score"))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT vec_id AS query_id, label % 2 AS f, e FROM v WHERE vec_id % 50 = 0)
SELECT query_id, fact_id, rank FROM (SELECT q.query_id, v.vec_id AS fact_id, row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(v.e, q.e) DESC, v.vec_id) AS rank
    FROM v JOIN q ON v.label % 2 = q.f WHERE label + 1 <= 6 AND vec_id % 13 <> 0) WHERE rank <= 5""")
def vector_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 50, against all."""
    v = views.vectors(spark, sf_dir)
    q = v.where("fact_id % 50 = 0").select(F.col("fact_id").alias("query_id"), "fork_id", F.lit("audience").alias("knower"), F.lit(6).alias("chapter"), F.col("vector").alias("query"))
    return retrieval.search_many(v, q, 5).select("query_id", "fact_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT vec_id AS fact_id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'f' || label % 2 END AS fork_id FROM embeddings WHERE vec_id % 5 <> 0")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.vectors(spark, sf_dir)
    added = v.where("fact_id % 3 = 0").withColumn("fork_id", F.lit("new"))
    return retrieval.upsert(v, added, v.where("fact_id % 5 = 0")).select("fact_id", "fork_id")


@query("SELECT '1.2' AS schema_version, count(DISTINCT source) AS works, count(*) AS chapters, sum(n_chars) AS words, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents")
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("chapters"), F.sum("n_chars").alias("words"), F.max("n_chars").alias("score"))
    return tables.corpus_manifest(w).select("schema_version", "works", "chapters", "words", F.array_join("sources", ",").alias("sources"))


NUMBERS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty"
#: Lines put into the documents: headings of all kinds, a line of contents, a heading with nothing behind it.
HEADS = ("Chapter 1: Dawn", "PART two - ", "  Book iv.  The sea", "XIV", "7", "Chapter 1 thru Chapter 9", "chapter nine", "Chapters are long")
_HEAD = rf"^[ \t]*(?:chapter|part|book)[ \t]+(?:\d{{1,3}}|[ivxlcdm]{{1,7}}|{NUMBERS})[ \t]*[.:—-]?[ \t]*(.*)$"


@query(rf"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, flatten(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i % 3 = 0 THEN [[{", ".join(f"'{h}'" for h in HEADS)}][(doc_id + i) % {len(HEADS)} + 1], l[i]] ELSE [l[i]] END)) AS l FROM l),
y AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS nth, unnest(l) AS words FROM x),
z AS (SELECT *, regexp_matches(words, '(?i){_HEAD}') AND NOT regexp_matches(regexp_extract(words, '(?i){_HEAD}', 1), '(?i)(?:chapter|part|book)[ 	]+(?:\d|[ivxlcdm])') AS told, regexp_matches(words, '^[ 	]*(?:\d{{1,3}}|[IVXLCDM]{{1,7}})[ 	]*$') AS bare FROM y),
c AS (SELECT *, sum(CAST(told OR bare AS INT)) OVER (PARTITION BY doc_id ORDER BY nth) AS chapter FROM z),
f AS (SELECT doc_id, chapter, max(trim(regexp_extract(words, '(?i){_HEAD}', 1), chr(32) || chr(9))) FILTER (WHERE told) AS title, regexp_replace(string_agg(words, chr(10) ORDER BY nth) FILTER (WHERE NOT (told OR bare)), '^\s+|\s+$', '', 'g') AS body FROM c WHERE chapter > 0 GROUP BY ALL)
SELECT doc_id AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chapter) AS INT) AS "index", nullif(title, '') AS title, sha256(body) AS digest FROM f WHERE body <> ''""")
def numbered_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with headings put between their lines, cut into chapters: place, title and text."""
    lines = F.split("text", "\n", -1)
    heads = F.array(*(F.lit(h) for h in HEADS))
    with_heads = F.flatten(F.transform(lines, lambda x, i: F.when((i + 1) % 3 == 0, F.array(F.get(heads, ((F.col("doc_id") + i + 1) % len(HEADS)).cast("int")), x)).otherwise(F.array(x))))
    d = docs(spark, sf_dir).select("doc_id", F.array_join(with_heads, "\n").alias("text"))
    return corpus.chapters_of(d, "doc_id", F.col("text")).select("id", "index", "title", F.sha2("text", 256).alias("digest"))


@query("""WITH k AS (SELECT CASE WHEN p_partkey % 50 = 0 THEN lower(p_name || ' ' || p_partkey) ELSE lower(trim(p_brand)) END AS name FROM part WHERE len(string_split(p_name, ' ')) >= 2)
SELECT (SELECT count(*) FROM part) AS seen, (SELECT count(*) FROM part) - count(*) AS thin, count(*) AS kept, count(*) - count(DISTINCT name) AS duplicates_merged, 2 * count(*) AS relationships, count(*) AS attributes FROM k""")
def entity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.harvest_report(views.entities(spark, sf_dir), 2)


@query()
def alias_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts of a brand as aliases of the brand's first: respellings rank last (the ratio of matching blocks is
    beyond SQL)."""
    p = views.table(spark, sf_dir, "part").select(F.col("p_brand").alias("entity"), F.col("p_name").alias("alias"), F.col("p_partkey").alias("pos"))
    p = p.groupBy("entity", "alias").agg(F.min("pos").alias("pos"))
    first = p.groupBy("entity").agg(F.min_by("alias", "pos").alias("name"))
    return text.rank_aliases(p.join(first, "entity"), F.col("name")).select("entity", "alias", "rank")


@query("""WITH w AS (SELECT DISTINCT p_brand AS entity FROM part), r AS (SELECT p_brand || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN ' (film)' ELSE ' (novel)' END AS title, p_partkey AS pos, 'Wq ' || p_partkey || CASE WHEN p_size % 5 = 0 THEN ' soundtrack' ELSE '' END AS redirect FROM part),
s AS (SELECT entity, title, nth FROM w, (VALUES (0, ''), (2, ' (film)'), (3, ' (novel)')) t(nth, tail) JOIN (SELECT DISTINCT title FROM r) x ON x.title = entity || tail),
g AS (SELECT entity, nth, s.title, count(*) FILTER (WHERE redirect NOT LIKE '%soundtrack') AS n FROM s JOIN r USING (title) GROUP BY ALL),
b AS (SELECT entity, coalesce(arg_min(title, nth) FILTER (WHERE n >= 4), arg_max(title, n * 100 - nth)) AS title FROM g GROUP BY entity)
SELECT entity, redirect AS alias, CAST(row_number() OVER (PARTITION BY entity ORDER BY pos) AS INT) AS rank FROM b JOIN r USING (title) WHERE redirect NOT LIKE '%soundtrack' QUALIFY rank <= 60""")
def alias_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as works whose articles' redirects are parts: the first article with enough usable ones counts."""
    p = views.table(spark, sf_dir, "part")
    tail = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, " (film)").otherwise(" (novel)")
    noise = F.when(F.col("p_size") % 5 == 0, " soundtrack").otherwise("")
    redirects = p.select(F.concat("p_brand", tail).alias("title"), F.col("p_partkey").alias("pos"), F.concat(F.lit("Wq "), F.col("p_partkey").cast("string"), noise).alias("redirect"))
    return aliases.expand(redirects, p.select(F.col("p_brand").alias("entity"), F.col("p_brand").alias("name")).distinct())


@query("""SELECT CAST(conv_id AS VARCHAR) AS series_id, turn, row_number() OVER (ORDER BY turn >= 3, conv_id * 100 + turn) - 1 AS seq FROM conversations""")
def episode_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns appended to an episode log in two batches, numbered on from one to the other."""
    path = f"{shared.folder(spark, 'log')}/log"
    c = views.table(spark, sf_dir, "conversations")
    rows = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("pos"), F.col("conv_id").cast("string").alias("series_id"), "turn")
    tables.append_episode(spark, rows.where("turn < 3"), path)
    tables.append_episode(spark, rows.where("turn >= 3"), path)
    return spark.read.parquet(path).select("series_id", "turn", "seq")


@query(r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'cached' WHEN doc_id % 3 = 1 THEN sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) END AS text FROM documents WHERE coalesce(doc_id % 3 <> 1 OR text IS NOT NULL, true)""")
def text_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with cached texts, works whose text is fetched again by offset, and works whose row is another's by now."""
    d = views.table(spark, sf_dir, "documents")
    works = d.select("doc_id", F.col("doc_id").alias("row_index")).where("doc_id % 3 <> 1").unionByName(d.where("doc_id % 3 = 1 and text is not null").select("doc_id", F.col("doc_id").alias("row_index")))
    cache = d.where("doc_id % 3 = 0").select("doc_id", F.lit("cached").alias("text"))
    rows = d.select(F.col("doc_id").alias("row_index"), (F.col("doc_id") + F.when(F.col("doc_id") % 3 == 2, 1).otherwise(0)).alias("id"), "text")
    got = tables.with_texts(works, cache, "doc_id", rows)
    return got.select("doc_id", F.when(F.col("text") == "cached", F.col("text")).otherwise(F.sha2("text", 256)).alias("text"))


@query("""WITH w AS (SELECT source AS work, CAST(sum(n_chars) AS BIGINT) AS score FROM documents GROUP BY source) SELECT work, row_number() OVER (ORDER BY score DESC, work) AS rank, (SELECT count(*) FROM w) AS works FROM w""")
def corpus_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works written as JSON in rank order with their manifest, and read again."""
    path = shared.folder(spark, "corpus")
    w = docs(spark, sf_dir).groupBy(F.col("source").alias("work")).agg(F.count("*").alias("chapters"), F.sum("n_chars").alias("words"))
    w = corpus.numbered(w.withColumn("source", F.lit("s")).withColumn("score", F.col("words")), "rank", F.desc("score"), "work")
    tables.write_corpus(w, path)
    works = spark.read.schema("schema_version string, works long").json(f"{path}/manifest").select("works")
    rows = spark.read.schema("work string, rank long").json(f"{path}/works")
    return rows.join(F.broadcast(works))


@query("SELECT conv_id AS work_id, list(text ORDER BY turn)[1] IS NOT NULL AS first, count(*) FILTER (WHERE turn < 3 AND turn % 2 = 0) AS fetched FROM conversations GROUP BY conv_id HAVING fetched > 0")
def fetched_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as works of turns, of which the first three are wanted and the even ones have a text."""
    c = views.table(spark, sf_dir, "conversations")
    works = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t")).select(F.col("conv_id").alias("work_id"), F.transform("t", lambda t: F.col("conv_id") * 100 + t).alias("chapter_refs"))
    texts = c.where("turn % 2 = 0").select((F.col("conv_id") * 100 + F.col("turn")).alias("chapter_id"), "text")
    return tables.fetched_chapters(works, texts, 3).groupBy("work_id").agg(F.bool_or(F.col("text").isNotNull()).alias("first"), F.count("*").alias("fetched"))
