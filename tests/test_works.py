"""Cleaning, names in texts, entities under several canons, hosts' rows, scans and pages."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, IsNotNull

from factloom.functions import markup, text
from factloom.operators import corpus, entities
from factloom.sources import aliases, paged
from factloom.sources.retry import HostError


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_a_disclaimer_becomes_a_space(spark):
    strip = lambda t: one(spark, t, text.strip_boilerplate)
    assert strip("ran!I do not own this.She") == "ran! She"
    assert strip("This is based mainly on the film Harbour by Ana Ruiz. I DO NOT OWN HARBOUR! I only own the plot for this story.") == ""
    kept = strip('The mill burned. I do not own Harbour. "Run," she said.')
    assert "The mill burned." in kept and "do not own" not in kept.lower() and '"Run," she said.' in kept
    assert strip("Rain fell on the pier\nHarbour Fanfiction\nBy: QuietGull\nNobody came.") == "Rain fell on the pier\nNobody came."


def test_names_in_words_and_tags(spark):
    rows = [("Noravale sails", "", []), ("nora, VALE", "", []), ("noravalet", "", []), ("x", "", ["noravale"]), ("x", "the salt road\npilot", []), ("x", "", ["saltroadpilot"])]
    df = spark.createDataFrame(rows, "title string, description string, tags array<string>")
    hits = text.alias_hits(F.col("title"), F.col("description"), F.col("tags"), ["Nora Vale", "The Salt Road Pilot"])
    assert [r.n for r in df.select(hits.alias("n")).collect()] == [1, 1, 0, 1, 1, 1]
    told = text.declares("Harbour", F.col("t"), F.lit(""), F.array(F.col("g")))
    rows = [("Nora: A Harbour Fanfiction", ""), ("x", "harbourfanfiction"), ("Harbour and a fanfiction", ""), ("fan fic: harbour", "")]
    assert [r.x for r in spark.createDataFrame(rows, "t string, g string").select(told.alias("x")).collect()] == [True, True, False, True]


def test_long_lines_are_cut_at_words(spark):
    assert one(spark, "word " * 40, lambda c: text.truncate_at_word(c, 22)) == "word word word word…"
    assert one(spark, "a" * 30, lambda c: text.truncate_at_word(c, 10)) == "a" * 10 + "…"
    assert one(spark, " a \n b ", lambda c: text.clip(c, 10)) == "a b" and one(spark, "x" * 200, text.clip) == "x" * 119 + "…"


def test_respellings_by_the_ratio_of_matching_blocks(spark):
    ratio = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(text.similarity("a", "b").alias("r")).first()["r"]
    # twice the matching characters over all: bcd in abcd and bcde, six of eight; nothing; all
    assert ratio("abcd", "BCDE") == 0.75 and ratio("abc", "xyz") == 0.0 and ratio("Same", "same") == 1.0
    df = spark.createDataFrame([("Colour", 1), ("Other", 2), ("The Color Book", 3), ("Colr", 4), ("Cold", 5)], "alias string, pos int")
    told = {r.alias: r.is_variant for r in text.rank_aliases(df, F.lit("Color")).collect()}
    assert told == {"Colour": True, "Other": False, "The Color Book": True, "Colr": True, "Cold": False}
    assert [r.alias for r in text.rank_aliases(df, F.lit("Color")).orderBy("rank").collect()] == ["Other", "Cold", "Colour", "The Color Book", "Colr"]


# --- entities ----------------------------------------------------------------------------------------------------------

ENTITY = (
    "pos long, canonical_name string, kind string, canon_basis string, aliases array<string>, summary string, life_status string,"
    " relationships array<struct<target:string,kind:string,field:string,canon_basis:string,source_url:string>>,"
    " attributes array<struct<predicate:string,value:string,canon_basis:string,source_url:string>>,"
    " sources array<struct<page_title:string,page_url:string>>, prominence long"
)


def sighting(pos, name, basis="unknown", kind="other", aliases=(), summary="", life="unknown", relations=(), attributes=(), pages=(), prominence=0):
    relations, attributes = [(t, k, "f", b, "u") for t, k, b in relations], [(p, v, b, "u") for p, v, b in attributes]
    return (pos, name, kind, basis, list(aliases), summary, life, relations, attributes, [(p, "u") for p in pages], prominence)


def test_entity_merge_lattice(spark):
    rows = [
        sighting(1, "Ann ", "novel", aliases=["A"], summary="s"),
        sighting(2, "ann", "screen", "person", ["a", "B", " ANN"], summary="ss", prominence=2),
        sighting(3, "Bob", aliases=["bob", "Rob", "rob "]),
    ]
    got = {r.name: r for r in entities.merge(spark.createDataFrame(rows, ENTITY)).collect()}
    assert got["ann"].canon_basis == "both" and got["ann"].kind == "person" and got["ann"].aliases == ["A", "B"]
    # a name seen once keeps its row as it is
    assert got["bob"].kind == "other" and got["bob"].aliases == ["bob", "Rob", "rob "]


def test_the_longest_summary_wins_however_prominent_others_are(spark):
    rows = [
        sighting(1, "Ida", summary="a much longer text about her", prominence=1, life="alive"),
        sighting(2, " IDA", summary="short", prominence=900, aliases=["ida", "Idalia"], life="deceased"),
        sighting(3, "ida", summary="short", prominence=901),
    ]
    r = entities.merge(spark.createDataFrame(rows, ENTITY)).first()
    assert (r.canonical_name, r.summary, r.prominence, r.aliases, r.life_status) == ("Ida", "a much longer text about her", 901, ["Idalia"], "alive")
    two = [sighting(1, "x", summary="ab", prominence=1), sighting(2, "X", summary="cd", prominence=5), sighting(3, "x ", summary="ef", prominence=5)]
    assert entities.merge(spark.createDataFrame(two, ENTITY)).first()["canonical_name"] == "X"
    order = entities.in_order(entities.merge(spark.createDataFrame([*rows, sighting(9, "Abe", prominence=901), sighting(8, "Zed")], ENTITY)))
    assert [r.canonical_name for r in order.collect()] == ["Abe", "Ida", "Zed"]


def test_items_join_their_own_bases(spark):
    rows = [
        sighting(1, "Ann", "both", relations=[("Bob", "Friend", "novel")], attributes=[("status", "Alive", "novel")], pages=["Ann (novel)", "Ann"]),
        sighting(2, " ann", "screen", relations=[(" bob ", "friend", "screen"), ("Cy", "friend", "screen")], attributes=[("status", "Dead", "screen"), ("status", "alive", "unknown")], pages=["ANN"]),
        sighting(3, "Zed", relations=[("a", "k", "novel"), ("A", "k", "screen")]),
    ]
    df = spark.createDataFrame(rows, ENTITY)
    want = [("ann", "Bob", "Friend", "both"), ("ann", "Cy", "friend", "screen"), ("zed", "A", "k", "screen"), ("zed", "a", "k", "novel")]
    assert sorted(tuple(r) for r in entities.merge_relationships(df).collect()) == want
    assert sorted(tuple(r) for r in entities.merge_attributes(df).collect()) == [("ann", "status", "Alive", "novel"), ("ann", "status", "Dead", "screen")]
    assert sorted(r.page_title for r in entities.merge_sources(df).collect()) == ["Ann", "Ann (novel)"]


def test_names_by_automaton_and_by_join_agree(spark):
    names = [("e1", "Alderman", ["ald", "the alder"], "novel", 3), ("e2", "Alder", [], "screen", 9), ("e3", "Öland", ["old"], "unknown", 1), ("e4", "rman", [], "both", 9)]
    e = spark.createDataFrame([(n, c, a, b, p, k) for k, (n, c, a, b, p) in enumerate(names)], "name string, canonical_name string, aliases array<string>, canon_basis string, prominence long, pos long")
    texts = spark.createDataFrame([(1, "The Alderman sat."), (2, "öLAND only"), (3, None), (4, "old ald"), (1, "The Alderman sat."), (5, "xxrmanxx")], "id long, t string")
    want = [(1, ["e2", "e4", "e1"], "screen")] * 2 + [(2, ["e3"], "unknown"), (3, [], "unknown"), (4, [], "unknown"), (5, ["e4"], "both")]
    for most in (100, 0):
        got = entities.classify(texts, e, "id", "t", most_names=most)
        assert sorted((r.id, r.names, r.basis) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


# --- hosts -------------------------------------------------------------------------------------------------------------


def test_archive_rows_by_field(spark):
    from factloom.sources import hosts

    def row(number, title, told, prose):
        return {"id": number, "title": title, "metadata": told, "text": prose}

    pilot = {"Fandom": "Harbour - Ana Ruiz", "Characters": "Nora Vale, Old Tom", "Relationship": "Nora Vale & Old Tom", "Additional Tags": "Storms, Found Family", "Category": "Gen", "Language": "English"}
    pilot |= {"author": "by mudlark", "Rating": "General Audiences", "Hits": "4,002", "Kudos": "91", "chapters": "2/2", "completed": "2019-01-05", "words": "7,300"}
    two_worlds = {"Fandoms": "Harbour, Lantern Street", "Rating": "Explicit", "Archive Warning": "Major Character Death", "Language": "English", "author": "tern", "chapters": "4/9", "words": "900"}
    rows = [
        {"title": "Nameless", "text": "prose"},
        row("21", "Low Water", pilot, "She waited."),
        row("22", "Silent", {"Fandom": "Harbour"}, ""),
        row(23, "Plain", None, "More prose."),
        {"id": "24", "text": "untitled"},
        row("25", "Both Shores", two_worlds, "They met."),
    ]
    works = hosts.archive_rows(spark.createDataFrame([(json.dumps(r),) for r in rows], "raw string"), "raw")
    got = {r.id: r for r in works.collect()}
    assert set(got) == {"21", "23", "25"}
    low, plain = got["21"], got["23"]
    assert (low.author, low.language, low.words, low.reads, low.votes, low.completed, low.mature) == ("mudlark", "en", 7300, 4002, 91, True, False)
    people, free = ["Nora Vale", "Old Tom"], ["Storms", "Found Family", "Nora Vale & Old Tom", "Gen"]
    assert low.tags == ["Harbour - Ana Ruiz", *people, *free, "ao3_fandom:Harbour - Ana Ruiz", "ao3_characters:Nora Vale, Old Tom", "ao3_chapters:2/2"]
    assert low.description == f"Fandom: Harbour - Ana Ruiz. Characters: {', '.join(people)}. Tags: {', '.join(free)}."
    assert low.url.endswith("/21") and low.num_chapters == 1
    both = got["25"]
    assert both.fandom == "Harbour, Lantern Street" and not both.completed and both.mature and (both.reads, both.votes) == (0, 0)
    assert (plain.fandom, plain.tags, plain.reads, plain.language, plain.description) == ("", [], 0, "en", "")
    assert [r.id for r in works.where(text.is_relevant("Nora Vale", ["nora vale", "old tom"])).collect()] == ["21"]
    floor = lambda n: works.where(text.is_relevant("Lantern Street", ["lantern street", "harbour"], min_reads=n, allow_mature=True)).count()
    assert floor(0) == 1 and floor(1) == 0


def test_a_scan_stops_goes_on_and_makes_do(spark, tmp_path):
    pages, state = str(tmp_path / "pages"), str(tmp_path / "state")
    rows = [(n * 3 + k, f"{n}-{k}", None, "yes" if k == 1 else "no", f"t{n}") for n in range(8) for k in range(3)]
    assert paged.write_pages(spark.createDataFrame(rows, "row_index long, id string, title string, label string, text string"), pages, 3) == 24
    paged.register(spark)
    go = lambda limit, most=100, also=True: paged.scan(spark, pages, state, F.lit(also) & (F.col("text") != "t6"), limit, most, 3, 2, label="yes")
    ids = lambda found: [r.id for r in found.matches.collect()]
    one = go(2)
    assert (ids(one), one.page, one.cut_short) == (["0-1", "1-1"], 2, False)
    two = go(99, 5)  # a ceiling of rows ends it behind the page that reaches it
    assert (ids(two), two.page) == (["2-1", "3-1"], 4)
    (tmp_path / "pages" / "page-5.jsonl").write_text('{"status": 404}\n')
    three = go(99)
    assert (ids(three), three.page, three.cut_short) == (["4-1"], 5, True)
    with pytest.raises(HostError):
        go(99)
    (tmp_path / "pages" / "page-5.jsonl").write_text('{"id": "5-1", "label": "yes"}\n{"id": ""}\nno json\n')
    four = go(99)
    assert (ids(four), four.page, four.cut_short) == (["7-1"], 8, False)  # a null text is no match
    assert (ids(go(99)), paged.state_of(spark, state)) == ([], 8)


def test_equality_is_decided_in_the_source(spark, tmp_path):
    rows = [(k, str(k), None, "yes" if k % 2 else "no", "t") for k in range(20)]
    paged.write_pages(spark.createDataFrame(rows, "row_index long, id string, title string, label string, text string"), str(tmp_path / "p"), 4)
    reader = paged.PagedReader({"path": str(tmp_path / "p"), "pageSize": "4", "limit": "3", "pagesPerRange": "5"})
    assert list(reader.pushFilters([EqualTo(("label",), "yes"), IsNotNull(("label",)), IsNotNull(("text",))])) == [IsNotNull(("text",))]
    (part,) = reader.partitions()
    assert [r[1] for r in reader.read(part)] == ["1", "3", "5", "7"]  # the page that fills the limit is read to its end


def test_sources_that_fail_are_left_out(spark):
    def down():
        raise HostError(503)

    up = spark.createDataFrame([("a", "1", 0)], "source string, source_id string, pos long")
    assert corpus.union_sources([down, lambda: up, up]).count() == 1
    with pytest.raises(HostError):
        corpus.union_sources([down])


def test_candidate_articles():
    from factloom.sources import aliases

    assert aliases.candidate_titles("Harbour (TV series)") == ["Harbour (TV series)"]
    assert aliases.candidate_titles("Harbour")[:2] == ["Harbour", "Harbour (TV series)"]
    found = aliases.candidate_titles("Meridian", "movie", lambda term: ["SS Meridian", "Meridian II", "Meridian (2003 film)"])
    assert found[:2] == ["Meridian (2003 film)", "Meridian (film)"] and found[-1] == "Meridian"

    def down(term):
        raise HostError(503)

    assert aliases.candidate_titles("Meridian", "movie", down)[0] == "Meridian (film)"


# --- pages and documents -----------------------------------------------------------------------------------------------


def test_pages_that_list_things_are_no_entities(spark):
    box = "{{Box|status=Alive|gender=f}}Lead."
    pages = [("Ann", box), ("Total Deaths", "This page lists '''Deaths'''."), ("Stub (novel)", "'''Stub''' is thin."), ("Empty", ""), ("List", "plain text")]
    df = spark.createDataFrame([(t, m, [], "person", 1, "u") for t, m in pages], "title string, markup string, categories array<string>, kind string, prominence long, page_url string")
    got = {r.canonical_name: r for r in markup.entities_of(df).collect()}
    assert set(got) == {"Ann", "Stub"} and got["Ann"].life_status == "alive" and got["Stub"].canon_basis == "novel" and got["Stub"].aliases == []


def test_documents_without_chapters_are_an_error(spark):
    df = spark.createDataFrame([(1, "Chapter 1\nOne."), (2, "no heading\nat all")], "id long, t string")
    with pytest.raises(Exception, match="no chapter headings in document 2"):
        corpus.read_chapters(df, "id", F.col("t")).collect()
    got = corpus.read_chapters(df, "id", F.col("t"), allow_single=True).collect()
    assert sorted((r.id, r["index"], r.title, r.text) for r in got) == [(1, 1, None, "One."), (2, 1, None, "no heading\nat all")]


def test_an_article_with_many_redirects_stays_rows(spark):
    """Equal spellings are merged, the first of them in order stays, and no article is gathered into an array."""
    redirects = [("Nora", n, f"Alias {n % 500}" if n % 7 else f"ALIAS {n % 500} (old)") for n in range(5000)] + [("Nora (film)", 1, "Zed one"), ("Nora", None, "First of all"), ("Nora", 3, None)]
    r = spark.createDataFrame(redirects, "title string, pos long, redirect string")
    out = aliases.expand(r, spark.createDataFrame([("e", "Nora")], "entity string, name string"))
    assert "collect_list" not in out._jdf.queryExecution().toString()
    first = {}
    for _, _, alias in sorted(((p is not None, p or 0, a) for _, p, a in redirects[:5000] + [redirects[5001]])):
        bare = alias.removesuffix(" (old)")
        first.setdefault(bare.lower(), bare)
    assert [x.alias for x in sorted(out.collect(), key=lambda x: x["rank"])] == list(first.values())[:60]


def test_names_found_are_handed_on_in_pieces():
    import pyarrow as pa

    by = {f"name{n:03d}": [(f"e{n}", "novel", n)] for n in range(50)}
    batch = pa.RecordBatch.from_pydict({"key": [str(k) for k in range(100)], "text": [" ".join(by) if k % 2 else None for k in range(100)]})
    got = list(entities._found_in(by, iter([batch]), most=120))
    assert sum(b.num_rows for b in got) == 2500 and max(b.num_rows for b in got) < 120 + 50
    assert [b.num_rows for b in entities._found_in({}, iter([batch]))] == [0]
