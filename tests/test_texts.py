"""Text, prose, premises, markup, chunks, sources and streams."""

import hashlib
import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import markup, premise, prose, text, vectors
from factloom.operators import chunks, corpus, retrieval
from factloom.sources import paged, tables
from factloom.streaming import awareness


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_densities(spark):
    assert one(spark, "", text.quotes_per_1k) == 0
    assert one(spark, '"a" b c d', text.quotes_per_1k) == 500
    assert one(spark, "walked naïved ed red", text.past_tense_per_1k) == 750


def test_boilerplate(spark):
    page = "A/N: late again\nLike a knife, the cold cut through him.\nPlease vote!\nHe said. I do not own this. She left.\nnext | prev\nIt  was\tcold."
    assert one(spark, page, text.strip_boilerplate) == "Like a knife, the cold cut through him.\nHe said. She left.\nIt was cold."


def test_normalisation_folds_width_and_space(spark):
    assert one(spark, " Ｆｕｌｌ  ﬁne\n", text.normalize) == "full fine"
    assert one(spark, None, text.fingerprint) == hashlib.sha256(b"").hexdigest()


def test_html(spark):
    assert one(spark, "<p>a&amp;b<br>c</p><script>x</script><!-- y --><p>&eacute;</p>", text.html_to_text) == "a&b\nc\n\né"


def test_prose_anchors(spark):
    dull = '"Hi," I said, "hello there now."\nI said, "Okay then fine."\nHe said, "Okay then sure."\nShe said, "Okay then yes."'
    rows = spark.createDataFrame([("dull", dull), ("empty", ""), ("loud", "FOR THE LOVE OF ONIONS. PICK SOMETHING!!!!!!!!!!!!")], "k string, t string")
    rows = prose.with_components(rows, "t").withColumn("q", prose.quality())
    got = {r.k: r for r in rows.collect()}
    assert got["empty"].interiority == 0 and got["empty"].sentence_rhythm == 0.5
    assert got["loud"].punctuation == 0
    assert got["dull"].dialogue_craft < 0.5
    assert all(0 <= r.q <= 100 for r in got.values())


def test_premises(spark):
    rows = [("t", "Anna doesn't kill Peter.", []), ("Anna x Peter", "", []), ("t", "quiet", ["ifjacklived"]), ("t", "Jack wakes up 90 years later.", []), ("t", "nothing", None)]
    df = spark.createDataFrame(rows, "t string, d string, g array<string>")
    got = [r.p.key for r in df.select(premise.read_signature(premise.signature(F.col("t"), F.col("d"), F.col("g"), "own")).alias("p")).collect()]
    assert got == ["character_survives:peter", "pairing:anna+peter", "character_survives:jack", "character_survives:jack", "unclassified"]


def test_templates():
    page = "{{Q|x}} {{Box|a = [[L|label]]|b={{in|c=d}}|pos}} {{open"
    assert markup.templates_of(page) == [("Q", {}), ("Box", {"a": "[[L|label]]", "b": "{{in|c=d}}"})]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=200), st.integers(1, 40), st.integers(0, 30))
def test_chunks_cover_and_quote(t, size, overlap):
    if overlap >= size:
        with pytest.raises(ValueError):
            chunks.check(size, overlap)
        return
    spans = list(chunks.cut(t, size, overlap))
    covered = set()
    for a, b in spans:
        assert 0 <= a < b <= len(t) and t[a:b].strip() == t[a:b]
        covered.update(range(a, b))
    assert all(i in covered for i, ch in enumerate(t) if not ch.isspace())


def test_chunk_table_function(spark):
    chunks.register(spark)
    got = spark.sql("SELECT c.* FROM VALUES ('Aa. Bb cc') AS t(x), LATERAL chunk_text(x, 6, 1) c").collect()
    assert [r.quote for r in got][0] == "Aa. Bb"


def test_embedder_against_python(spark):
    def plain(t):
        t = t.strip().lower()
        grams = [t[i : i + 3] for i in range(max(1, len(t) - 2))] if t else []
        v = [0.0] * 256
        for g in grams:
            d = hashlib.sha256(g.encode()).digest()
            v[int.from_bytes(d[:8], "big") % 256] += 1 if d[8] % 2 == 0 else -1
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v

    for t in ("Hello world", "ab", "", "ééé ñ"):
        got = one(spark, t, vectors.embed)
        assert max(abs(a - b) for a, b in zip(got, plain(t), strict=True)) < 1e-12


def test_search_filters_before_the_limit(spark):
    rows = [(i, "f", [1.0, float(i)], "quarantined" if i < 5 else "active", 1 if i % 2 else 9, None) for i in range(10)]
    v = spark.createDataFrame(rows, "fact_id long, fork_id string, vector array<double>, status string, revealed_at int, knower_scope array<struct<knower:string,learned_at:int>>")
    got = retrieval.search(v, "f", F.array(F.lit(1.0), F.lit(0.0)), "audience", 3, 2)
    assert [r.fact_id for r in got.collect()] == [5, 7]
    with pytest.raises(ValueError):
        retrieval.search(v, "f", F.array(F.lit(1.0)), "audience", 3, 0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("TakeOrdered") < plan.index("Filter")


def test_dedup_order_and_fate(spark):
    body = "word " * 30
    rows = [("w1", 1, body), ("w2", 2, body), ("w1", 3, "short"), ("w3", 0, "short"), ("w3", 9, None)]
    got = {r.pos: r.fate for r in corpus.clean_chapters(spark.createDataFrame(rows, "work string, pos long, text string"), 20, 0.0).collect()}
    assert got == {1: "kept", 2: "duplicate", 3: "prose", 0: "prose", 9: "prose"}


def test_chapters_from_text(spark):
    body = "front\nChapter 1 thru Chapter 9\nChapter 1: Dawn\nOne.\n\nII\nTwo.\nChapter three\n"
    got = corpus.chapters_of(spark.createDataFrame([(1, body)], "id long, t string"), "id", F.col("t")).orderBy("index").collect()
    assert [(r["index"], r.title, r.text) for r in got] == [(1, "Dawn", "One."), (2, None, "Two.")]


def test_jsonl_and_paged_source(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"id": "1", "v": 1}\nnot json\n[1]\n{"id": "1", "v": 2}\n{"id": "2", "v": 3}\n')
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    got = tables.read_jsonl(spark, str(tmp_path / "rows.jsonl"), StructType([StructField("id", StringType()), StructField("v", LongType())]), "id")
    assert sorted(tuple(r) for r in got.collect()) == [("1", 2), ("2", 3)]
    pages = tmp_path / "pages"
    pages.mkdir()
    for n in range(3):
        (pages / f"page-{n}.jsonl").write_text("".join(json.dumps({"id": f"{n}-{k}", "text": "t"}) + "\n" for k in range(2)) + "broken\n")
    paged.register(spark)
    assert spark.read.format("paged_rows").option("path", str(pages)).load().count() == 6
    q = spark.readStream.format("paged_rows").option("path", str(pages)).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_awareness_stream_reaches_the_batch_result(spark, tmp_path):
    src = tmp_path / "in"
    schema = "fact_id long, knower string, learned_at int"
    for rows in ([(1, "a", 5), (2, "b", 1)], [(1, "a", 2)], [(1, "a", 9)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(src))
    q = awareness.run(spark.readStream.schema(schema).json(str(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    state = awareness.earliest(spark.read.parquet(str(tmp_path / "out")).drop("batch"))
    assert sorted(tuple(r) for r in state.collect()) == [(1, "a", 2), (2, "b", 1)]


def test_fact_append_refuses_taken_ids(spark, tmp_path):
    from test_facts import fact, facts

    path = str(tmp_path / "facts")
    tables.write_facts(facts(spark, fact(1), fact(2, "child")), path)
    bad = tables.append_facts(facts(spark, fact(2), fact(3)), path)
    assert [r.id for r in bad.collect()] == [2]
    assert sorted(r.id for r in tables.read_facts(spark, path).collect()) == [1, 2, 3]
    assert [r.id for r in tables.read_facts(spark, path, "child").collect()] == [2]


def test_retry_waits_and_gives_up():
    from factloom.sources.retry import HostError, with_retry

    waits, left = [], [503, 429]

    def call():
        if left:
            raise HostError(left.pop())
        return "ok"

    assert with_retry(call, sleep=waits.append) == "ok"
    assert len(waits) == 2 and 1 <= waits[0] <= 1.25 and 2 <= waits[1] <= 2.25
    with pytest.raises(HostError):
        with_retry(lambda: (_ for _ in ()).throw(HostError(404)), sleep=waits.append)
    assert len(waits) == 2


def test_host_rows_and_wiki_names(spark):
    from factloom.sources import hosts

    raw = spark.createDataFrame([('{"id": "a", "title": "T", "text": "t", "metadata": {"words": "1.5", "chapters": "2/?", "Language": "Deutsch"}}',), ('{"id": "", "title": "x"}',), ("broken",)], "raw string")
    got = hosts.archive_rows(raw, "raw").collect()
    assert [(r.id, r.words, r.completed, r.language) for r in got] == [("a", 15, False, "de")]
    raw = spark.createDataFrame([('{"id": "a", "title": "T", "readCount": "1.5", "parts": [{"id": "p", "title": "x", "draft": true}, {"id": "q", "title": "y"}]}',), ('{"id": "b", "title": "T", "deleted": true}',)], "raw string")
    got = hosts.host_rows(raw, "raw").collect()
    assert [(r.id, r.reads, [(c.source_id, c["index"]) for c in r.chapter_refs]) for r in got] == [("a", 1, [("q", 1)])]
    assert one(spark, "The Long Road", hosts.wiki_candidates) == ["thelongroad", "the-long-road", "longroad", "long-road"]


def test_payoffs_anchors_and_options(spark):
    from factloom.operators import knowledge

    branches = spark.createDataFrame([(1, 2, "b", "B", False), (1, 1, "a", "A", True)], "chapter int, pos int, option_id string, label string, secret boolean")
    nested = knowledge.options_per_chapter(branches)
    assert [r.option_id for r in knowledge.options_at(nested, 1).collect()] == ["a", "b"]
    assert knowledge.options_at(nested, 2).count() == 0
    texts = spark.createDataFrame([(1, "The dark hall.")], "chapter int, text string")
    anchor = lambda w: spark.createDataFrame([("f", 1, 4, 8, w)], "fact_id string, chapter int, char_start int, char_end int, must_contain string")
    assert knowledge.seed_from_anchors(anchor("dark"), texts).first()["quote"] == "dark"
    with pytest.raises(Exception, match="sentinel"):
        knowledge.seed_from_anchors(anchor("light"), texts).collect()


def test_ranking_is_checked_across_blocks(spark):
    df = lambda xs: spark.createDataFrame(list(enumerate(xs)), "pos long, score double")
    ok = lambda xs: corpus.is_ranked(df(xs), 3).first()["ranked"]
    assert ok([9.0, 8.0, 8.0, 7.0, 5.0]) and ok([]) and ok([1.0])
    assert not ok([9.0, 8.0, 7.0, 8.0]) and not ok([9.0, None, 7.0]) and not ok([1.0, 2.0])


def test_grams_are_counted_at_their_places():
    import hashlib

    import numpy as np
    import pandas as pd

    from factloom.functions import vectors

    text = " Banana bandana "
    want = np.zeros(vectors.WIDTH)
    for g in (text.strip().lower()[k : k + 3] for k in range(len(text.strip()) - 2)):
        d = hashlib.sha256(g.encode()).digest()
        want[d[7]] += 1 - 2 * (d[8] % 2)
    got = vectors.embed.func(pd.Series([text, "", None]))
    assert np.array_equal(got[0], want / np.sqrt((want * want).sum())) and not got[1].any() and not got[2].any()
    places = vectors._Places()
    assert places["ban"] // 2 == hashlib.sha256(b"ban").digest()[7] and len(places) == 1


def test_a_page_is_read_once_for_each_of_its_parts(spark):
    box = "{{Box|relatives=[[Ann]] <small>(sister)</small>|spouse=Bob ()|status=?|state='''Alive'''|age=4|aliases=Cee}}"
    rows = [("Dan", box + "'''Dan''' is '''Big Ben'''.", ["Tall"], "u"), ("Eve", "only a list", ["Tall"], "u")]
    found = markup.entities_of(spark.createDataFrame(rows, "title string, markup string, categories array<string>, page_url string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the marks of plain text are taken out where a text is read, not again where what was read is used
    assert plan.count("'{2,5}") <= 10
    (r,) = found.collect()
    assert [(x.target, x.kind, x.field) for x in r.relationships] == [("Ann", "sister", "relatives"), ("Bob", "spouse", "spouse")]
    assert (r.life_status, r.aliases, r.summary) == ("alive", ["Cee", "Big Ben"], "Dan is Big Ben.")


def test_pieces_are_counted_as_they_stand(spark):
    rows = [("kelvin", "K KK"), ("dot", "İbcd efg. İ!! ABC"), ("plain", "Abc def.  ghi JKL!!\n\n \n\nmno pqr.\n \n")]
    found = prose.with_components(spark.createDataFrame(rows, "k string, t string"), "t")
    assert "(?U)^\\s+|\\s+$" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.k: r for r in found.collect()}
    assert got["kelvin"].punctuation == 0.0 and got["plain"].sentence_rhythm == 0.5
    # of "bcd efg ABC" three words are long, one of them in capitals; two marks in a row over three sentences
    assert got["dot"].punctuation == pytest.approx(1 - 0.6 - 0.25 * 0.25 - 0.15)


def test_texts_are_cleaned_once(spark):
    rows = [("w", n, f"A/N: hi\n{'one two three ' * 9}{n % 2}") for n in range(4)]
    found = corpus.clean_chapters(spark.createDataFrame(rows, "work string, pos long, text string"), 20, 0.0)
    assert "fan\\s*fiction" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.pos, r.fate, r.clean) for r in found.collect()} == {(n, "kept" if n < 2 else "duplicate", "one two three " * 9 + str(n % 2)) for n in range(4)}


def test_texts_that_nfkc_may_change_are_normalised(spark):
    import unicodedata

    chars = [chr(i) for i in range(1, 0x3100) if not chr(i).isspace()]
    texts = [f"a{c}e{c}" for c in chars] + ["é", "Ȩ́", "plain", "Ñandú"]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", F.col("x").rlike(text._UNSTABLE).alias("odd")).collect()
    assert all(r.odd or unicodedata.normalize("NFKC", r.x) == r.x for r in got) and not any(r.odd for r in got if r.x.isascii() or r.x == "Ñandú")
    assert one(spark, "É Ñ ﬁ", text.normalize) == "é ñ fi"
