"""Drafts against canon, harvests and histories: planted cases, and plain Python on random ones."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import template
from factloom.functions.guard import is_visible
from factloom.functions.vectors import cosine
from factloom.operators import harvest as H
from factloom.operators import corpus, history, lanes, retrieval, temporal, verify
from factloom.plans import surface
from factloom.schema import FACT
from factloom.streaming import settling

# --- drafts against canon ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("stretch", [1, 7, 64, 10_000])
def test_clashes_equal_all_pairs(spark, stretch):
    rng = random.Random(stretch)
    key = lambda: rng.choice(["hot", "hot", "hot", *(f"k{i}" for i in range(8))])
    place = lambda: rng.choice("abc")
    end = lambda s: rng.choice([None, s, s + 1, s + rng.randrange(30)])
    facts = [(i, key(), place(), s := rng.randrange(200), end(s)) for i in range(300)]
    claims = [(i, key(), place(), s := rng.randrange(-5, 220), end(s)) for i in range(300)]
    claims += [(900, "hot", "a", 50, 40), (901, None, "a", 1, 1), (902, "hot", None, 1, 1), (903, "nobody", "a", 1, 9)]
    shape = "{} long, key string, says string, start int, stop int"
    f = spark.createDataFrame([*facts, facts[0], (999, None, "a", 1, 2)], shape.format("id")).repartition(5)
    c = spark.createDataFrame(claims, shape.format("claim_id")).repartition(4)
    far = 2**31 - 1
    want = {}
    for i, k, says, start, stop in claims:
        hits = [((far if b is None else b), j) for j, k2, other, a, b in facts if k == k2 and says is not None and other != says and a <= (far if stop is None else stop) and (b is None or b >= start)]
        if hits and (stop is None or stop >= start):
            want[i] = max(hits)[1]
    got = verify.clashes(f, c, stretch).collect()
    assert {r.claim_id: r.fact_id for r in got} == want and len(got) == len(want)
    assert verify.clashes(f.limit(0), c).count() == 0 and verify.clashes(f, c.limit(0)).count() == 0


def canon(spark, rows):
    base = {"fork_id": "canon", "object_id": None, "object_literal": None, "valid_to": None, "revealed_at": 1, "assertion_mode": "narrated", "confidence": 0.9, "tier": 0, "status": "active"}
    made = [base | r for r in rows]
    df = spark.createDataFrame([tuple(m.get(f.name) for f in FACT) for m in made], FACT)
    return df.withColumn("root", F.lit("canon")).withColumn("depth", F.lit(0))


CLAIM = "claim_id long, root string, subject_id long, predicate string, says string, start int, stop int, span string, knower string, cause_id long, used array<long>"
ROLES = {"single": ["eyes"], "place": "at", "holder": "held by", "status": "is"}


def test_every_planted_contradiction_is_flagged_and_cited(spark):
    resolved = canon(
        spark,
        [
            {"id": 1, "subject_id": 10, "predicate": "eyes", "object_literal": "green", "valid_from": 1},
            {"id": 2, "subject_id": 10, "predicate": "is", "object_literal": "dead", "valid_from": 9},
            {"id": 3, "subject_id": 11, "predicate": "is", "object_literal": "imprisoned", "valid_from": 2, "valid_to": 4},
            {"id": 4, "subject_id": 11, "predicate": "is", "object_literal": "active", "valid_from": 5},
            {"id": 5, "subject_id": 11, "predicate": "at", "object_literal": "port", "valid_from": 3, "valid_to": 6},
            {"id": 6, "subject_id": 12, "predicate": "held by", "object_literal": "knife", "valid_from": 2, "valid_to": 8},
            {"id": 7, "subject_id": 13, "predicate": "fire", "object_literal": "mill", "valid_from": 7},
            {"id": 8, "subject_id": 13, "predicate": "secret", "object_literal": "twin", "valid_from": 1, "revealed_at": 20},
            {"id": 9, "subject_id": 10, "predicate": "eyes", "object_literal": "grey", "valid_from": 1, "status": "quarantined"},
        ],
    )
    claims = [
        (1, "canon", 10, "eyes", "blue", 3, 3, "her blue eyes", None, None, None),
        (2, "canon", 10, "eyes", "green", 3, None, "her green eyes", None, None, None),
        (3, "canon", 10, "walks", "in", 9, 9, "she walks in", None, None, None),
        (4, "canon", 10, "walks", "in", 8, 8, "she walks in", None, None, None),
        (5, "canon", 11, "walks", "out", 3, 3, "he walks out", None, None, None),
        (6, "canon", 11, "walks", "out", 5, 5, "he walks out", None, None, None),
        (7, "canon", 11, "at", "tower", 6, 9, "at the tower", None, None, None),
        (8, "canon", 11, "at", "tower", 7, 9, "at the tower", None, None, None),
        (9, "canon", 10, "held by", "knife", 8, 8, "she has the knife", None, None, None),
        (10, "canon", 12, "held by", "knife", 8, 8, "he has the knife", None, None, None),
        (11, "canon", 14, "flees", "mill", 6, 6, "they flee the fire", None, 7, None),
        (12, "canon", 14, "flees", "mill", 7, 7, "they flee the fire", None, 7, None),
        (13, "canon", 14, "says", "twin", 19, 19, "your twin", "k", None, [8, 404]),
        (14, "canon", 14, "says", "twin", 20, 20, "your twin", "k", None, [8]),
        (15, "side", 10, "eyes", "blue", 3, 3, "elsewhere", None, None, None),
    ]
    got = verify.hard_lane(resolved, spark.createDataFrame(claims, CLAIM), **ROLES).collect()
    want = {(1, "identity"): [1], (3, "mortality"): [2], (5, "mortality"): [3], (7, "timeline"): [5], (9, "inventory"): [6], (11, "timeline"): [7], (13, "epistemic"): [8]}
    assert {(r.id, r.invariant): r.cited_fact_ids for r in got} == want
    assert all(r.cited_fact_ids and r.severity == "blocking" and r.lane == "hard" and r.about == "claim" for r in got)
    assert next(r.citation for r in got if r.id == 1) == "draft says her blue eyes; canon: 10 eyes green since chapter 1"
    assert verify.hard_lane(resolved, spark.createDataFrame([], CLAIM), **ROLES).count() == 0


def test_entities_that_share_a_name(spark):
    resolved = canon(spark, [{"id": i, "subject_id": i, "predicate": "eyes", "object_literal": "x", "valid_from": 1} for i in (1, 2, 3)])
    entities = spark.createDataFrame([(1, "canon", ["Ann", " ANNE "]), (2, "canon", ["anne"]), (3, "canon", ["Bob", None, ""]), (9, "canon", ["bob"]), (2, "side", ["Ann"])], "id long, root string, names array<string>")
    got = verify.twins(resolved, entities).collect()
    assert [(r.id, r.invariant, r.cited_fact_ids) for r in got] == [(2, "identity", [1, 2])]


# --- harvests ----------------------------------------------------------------------------------------------------------


def plain_harvest(works, chapters, most, most_chapters, min_words):
    """One work after the other, as somebody would who fetches them."""
    counts, seen, kept = Counter(), set(), []
    for place, relevant in works:
        if len(kept) >= most:
            break
        if not relevant:
            counts["relevance_rejected"] += 1
            continue
        mine = 0
        for text in chapters.get(place, [])[:most_chapters]:
            clean = re.sub(r"\s+", " ", text.strip())
            if len(clean.split()) < min_words:
                counts["prose_rejected"] += 1
            elif clean.lower() in seen:
                counts["duplicates_dropped"] += 1
            else:
                seen.add(clean.lower())
                mine += 1
                counts["chapters_kept"] += 1
                counts["total_words"] += len(clean.split())
        if mine:
            kept.append(place)
    return kept, counts


@pytest.mark.parametrize("most", [1, 40, 10_000])
def test_harvest_equals_plain_python_on_a_thousand_works(spark, most):
    rng = random.Random(most)
    texts = [" ".join(rng.choice(["sun", "moon", "tide", "Salt"]) for _ in range(rng.choice([2, 5, 6, 9]))) for _ in range(700)]
    works, told, rows, parts = [], {}, [], []
    for place in rng.sample(range(5000), 1000):
        relevant = rng.random() < 0.6
        mature = not relevant and rng.random() < 0.5
        about = "tales of the tide" if relevant or mature else "nothing"
        rows.append((place, "s", str(place), "", about, [], "en", 5, 5, mature))
        works.append((place, relevant))
        told[place] = [rng.choice(texts) for _ in range(rng.choice([0, 1, 2, 4]))]
        parts += [(place, k, t) for k, t in enumerate(told[place], 1)]
    kept, counts = plain_harvest(sorted(works), told, most, 3, 5)
    policy = H.Policy("the tide", most=most, most_chapters=3, min_words=5, min_quotes=0.0, min_hits=1)
    w = spark.createDataFrame(rows, "place long, source string, source_id string, title string, description string, tags array<string>, language string, reads int, votes int, mature boolean").repartition(6)
    c = spark.createDataFrame(parts, "place long, index int, text string").repartition(5)
    got = H.harvest(w, c, policy)
    r = got.report.first()
    assert {k: r[k] for k in ("relevance_rejected", "prose_rejected", "duplicates_dropped", "chapters_kept", "total_words")} == {k: counts[k] for k in ("relevance_rejected", "prose_rejected", "duplicates_dropped", "chapters_kept", "total_words")}
    assert r["stories_kept"] == len(kept) and r["candidates_seen"] == 1000 and r["quality_rejected"] == 0
    found = got.works.select("place", "score", "handle").collect()
    assert sorted(x.place for x in found) == sorted(kept) and [(-x.score, x.place) for x in found] == sorted((-x.score, x.place) for x in found)
    assert got.chapters.count() == counts["chapters_kept"]


def test_harvest_floor_and_empty_tables(spark):
    w = spark.createDataFrame([(1, "s", "1", "", "the tide", [], "en", 1, 1, False)], "place long, source string, source_id string, title string, description string, tags array<string>, language string, reads int, votes int, mature boolean")
    c = spark.createDataFrame([(1, 1, "sun moon tide sun moon"), (1, 2, None)], "place long, index int, text string")
    policy = H.Policy("the tide", min_words=3, min_quotes=0.0, min_hits=1, least_score=100.0)
    r = H.harvest(w, c, policy).report.first()
    assert (r["quality_rejected"], r["stories_kept"], r["prose_rejected"], r["total_words"]) == (1, 0, 1, 0)
    r = H.harvest(w.limit(0), c.limit(0), policy).report.first()
    assert (r["candidates_seen"], r["stories_kept"], r["relevance_rejected"], r["duplicates_dropped"]) == (0, 0, 0, 0)


def test_the_nth_place_over_many_ranges(spark):
    places = random.Random(3).sample(range(100_000), 5000)
    df = spark.createDataFrame([(p,) for p in places], "place long").repartition(9)
    for n in (1, 2, 1777, 5000):
        assert H.nth_place(df, n) == sorted(places)[n - 1]
    assert H.nth_place(df, 5001) is None and H.nth_place(df.limit(0), 1) is None


# --- histories ---------------------------------------------------------------------------------------------------------

LOG = "seq long, op string, fact_id long, object_literal string, valid_from int, valid_to int, confidence double"


def random_log(n, seed):
    rng = random.Random(seed)
    maybe = lambda x: x if rng.random() < 0.7 else None
    kinds = [*history.OPS, "UPDATE", "UPDATE", "FORGET", None]
    seqs = sorted(rng.sample(range(10 * n), n))
    return [(s, rng.choice(kinds), rng.choice([1, 1, 1, *range(2, 9)]), maybe(rng.choice("xyz")), maybe(rng.randrange(9)), maybe(rng.randrange(9)), maybe(rng.random())) for s in seqs]


def plain_replay(log, until):
    state = {}
    for seq, op, fact, *values in log:
        if seq > until:
            continue
        status, fields, closed, bad = state.get(fact, ("absent", [None] * 4, None, 0))
        if op == "ASSERT" and status == "absent" or op == "RETCON" and status != "absent":
            status, fields, closed = "active", values, None
        elif op == "UPDATE" and status == "active":
            fields = [v if v is not None else f for v, f in zip(values, fields, strict=True)]
        elif op == "INVALIDATE" and status == "active":
            status, fields, closed = "invalidated", [*fields[:2], values[2], fields[3]], seq
        else:
            bad += 1
        state[fact] = (status, fields, closed, bad)
    return {f: (s, *v, c, b) for f, (s, v, c, b) in state.items()}


@pytest.mark.parametrize("stretch", [2, 16, 4096])
def test_replay_equals_one_operation_at_a_time(spark, stretch):
    log = random_log(200, stretch)
    df = spark.createDataFrame([*log, (None, "ASSERT", 1, "x", 1, 1, 0.5), (7777, "ASSERT", None, "x", 1, 1, 0.5)], LOG).repartition(5)
    for until in (log[0][0], log[60][0], log[61][0], log[150][0], log[-1][0]):
        got = history.replay(df, until, stretch).collect()
        assert {r.fact_id: tuple(r)[1:] for r in got} == plain_replay(log, until)
    assert history.replay(df, -1).count() == 0


def test_replay_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    log = random_log(120, 5)
    source = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
    for n, cut in enumerate((40, 80, 120)):
        part = log[cut - 40 : cut]
        random.Random(n).shuffle(part)
        spark.createDataFrame(part, LOG).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        settling.write(settling.replayed(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        out = spark.read.parquet(str(tmp_path / "out"))
        last = out.groupBy("fact_id").agg(F.max_by(F.struct("status", *history.FIELDS, "superseded_seq", "rejected"), "seq").alias("s")).select("fact_id", "s.*")
        want = plain_replay(log, log[cut - 1][0])
        assert {r.fact_id: tuple(r)[1:] for r in last.collect()} == want
        batch = history.replay(spark.createDataFrame(log, LOG), log[cut - 1][0])
        assert {r.fact_id: tuple(r)[1:] for r in batch.collect()} == want


def test_shuffled_batches_settle_as_the_batch_does(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rng = random.Random(8)
    rows = [(f"p{rng.choice([0, 0, *range(12)])}", place) for place in range(200)]
    first = {}
    for p, place in rows:
        first.setdefault(p, place)
    rng.shuffle(rows)
    source = spark.readStream.schema("print string, place long").parquet(str(tmp_path / "in"))
    for n in range(4):
        spark.createDataFrame(rows[n * 50 : n * 50 + 50], "print string, place long").repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        settling.write(settling.settle(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r.print, r.place): r.fate for r in settling.settled(spark, str(tmp_path / "out")).collect()}
    assert got == {(p, place): "kept" if first[p] == place else "duplicate" for p, place in rows}


def test_boundary_report_names_the_first_illegal_move(spark):
    planted = spark.createDataFrame([(1, 1), (2, 3), (3, 5), (4, 9), (5, 1)], "id long, planted_at int")
    moves = [(1, 1, 2, "triggered"), (1, 2, 3, "paid_off"), (2, 1, 3, "paid_off"), (2, 2, 4, "triggered"), (2, 3, 4, "planted"), (3, 1, 2, "triggered"), (3, 2, 6, "broken"), (3, 3, 9, "planted"), (4, 1, 9, "triggered"), (7, 1, 1, "broken"), (5, 1, 2, None)]
    got = history.boundary_report(planted, spark.createDataFrame(moves, "id long, seq long, chapter int, to string"), 8, 2).collect()
    want = {1: ("paid_off", False, None, 2, 0, None), 2: ("triggered", True, 5, 3, 2, 1), 3: ("broken", False, None, 2, 1, 1), 5: ("planted", True, 7, 1, 1, 1)}
    assert {r.id: tuple(r)[1:] for r in got} == want


def test_adjudication_quarantines_ties(spark):
    rows = [(1, "a", "x", 0, 0.9), (2, "a", "y", 1, 1.0), (3, "a", "x", 5, 0.1), (4, "b", "x", 0, 0.5), (5, "b", "y", 0, 0.5), (6, "b", "x", 1, 0.9), (7, "c", "x", None, None), (8, "d", "x", 0, 0.5), (9, "d", "x", 0, 0.5)]
    df = spark.createDataFrame(rows, "id long, key string, says string, tier int, confidence double").repartition(4)
    got = {r.id: r.verdict for r in history.adjudicate(df, ["key"]).collect()}
    assert got == {1: "kept", 2: "outranked", 3: "kept", 4: "quarantined", 5: "quarantined", 6: "outranked", 7: "kept", 8: "kept", 9: "kept"}
    assert [r.status for r in history.curate(df, 0.5).orderBy("id").collect()] == ["active", "active", "quarantined", "active", "active", "active", "quarantined", "active", "active"]


def test_as_of_by_pieces_equals_the_join(spark):
    rng = random.Random(12)
    rows = [{"id": i, "subject_id": rng.choice([1, 1, 1, 2, 3]), "predicate": "p", "object_literal": "x", "valid_from": (a := rng.randrange(-3, 70)), "valid_to": rng.choice([None, a, a + rng.randrange(40)]), "status": rng.choice(["active", "active", "invalidated", "quarantined"])} for i in range(200)]
    facts = canon(spark, rows).repartition(4)
    probes = spark.createDataFrame([("canon", s, "p", c) for s in (1, 2, 3, 9) for c in (0, 1, 5, 31, 32, 33, 63, 64, 69)], "root string, subject_id long, predicate string, chapter int")
    want = {tuple(r) for r in temporal.as_of_probe(facts, probes).collect()}
    got = temporal.as_of_ranges(facts, probes)
    assert {tuple(r) for r in got.collect()} == want and want
    assert temporal.as_of_ranges(facts, probes.limit(0)).count() == 0 and temporal.as_of_ranges(facts.limit(0), probes).count() == 0


# --- SQL, templates, lanes ---------------------------------------------------------------------------------------------


def test_questions_without_a_route_fail(spark):
    facts = canon(spark, [{"id": 1, "subject_id": 1, "predicate": "at", "object_id": 2, "valid_from": 1}, {"id": 2, "subject_id": 2, "predicate": "at", "object_id": 1, "valid_from": 1}, {"id": 3, "subject_id": 2, "predicate": "at", "object_id": 5, "valid_from": 1, "revealed_at": 9}])
    forks = spark.createDataFrame([("canon", None, None)], "id string, parent_fork_id string, divergence_at int")
    surface.register(spark, facts.drop("root", "depth"), forks)
    assert sorted(r.node for r in surface.route(spark, "reach", fork="canon", chapter=3, start=1, hops=9).collect()) == [1, 2]
    assert [r.id for r in surface.route(spark, "spoilers", fork="canon", chapter=3).collect()] == [3]
    assert spark.sql("SELECT count(*) AS n FROM fl_canon c JOIN fl_visible('canon', 'audience', 9) v ON c.id = v.id").first().n == 3
    for kind, given in (("similar", {}), ("as_of", {"fork": "canon"}), ("as_of", {"fork": "canon", "chapter": 1, "k": 2})):
        with pytest.raises(surface.Unroutable):
            surface.route(spark, kind, **given)


def test_templates(spark):
    df = spark.createDataFrame([("ann", [("a", "x" * 9), ("b", " y ")], ["p", "q"]), ("bob", [], []), (None, [], ["r"])], "who string, facts array<struct<s:string,q:string>>, xs array<string>")
    given = {n: F.col(n) for n in df.columns}
    say = '{# no #}{{ who|upper }}:{% for f in facts %}[{{ f.s }}={{ f.q | trim }}]{% else %}none{% endfor %}{% if xs %} {{ xs | join("+") }}{% else %}.{% endif %}\n'
    got = df.select(template.render(say, given, strict=False).alias("t"), template.missing(given).alias("m")).collect()
    assert [r.t for r in got] == ["ANN:[a=xxxxxxxxx][b=y] p+q\n", "BOB:none.\n", None] and [r.m for r in got] == [[], [], ["who"]]
    with pytest.raises(Exception, match="not given: who"):
        df.select(template.render(say, given)).collect()
    for bad in ("{{ nobody }}", "{% for x in facts %}", "{{ who | shout }}", "{% while x %}"):
        with pytest.raises(template.TemplateError):
            template.render(bad, given)
    cut = lambda s: spark.range(1).select(template.render("{{ s | truncate(20) }}", {"s": F.lit(s)}).alias("t")).first().t
    assert cut("x" * 25) == "x" * 25 and cut("x" * 26) == "x" * 17 + "..." and cut("one two three four five six") == "one two three..."


def test_lanes_skip_cells_and_lose_nothing(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 6
    rows = [(i, "ab"[i % 2], (centres[i % 12] + rng.normal(size=16) * 0.3).tolist()) for i in range(1200)] + [(5000, "a", [0.0] * 16), (5001, "a", None)]
    v = spark.createDataFrame(rows, "ref_id long, lane string, vector array<double>").repartition(5)
    asked = spark.createDataFrame([(i, lane, rows[i][2]) for i in range(0, 60) for lane in "ab"] + [(900, "c", rows[0][2])], "q long, lane string, query array<double>").selectExpr("q * 2 + int(lane = 'b') AS query_id", "lane", "query")
    got = lanes.search(lanes.index(v, cells=12), asked, 5).collect()
    unit = {i: np.array(x) / np.linalg.norm(x) for i, _, x in rows if x and any(x)}
    for r in asked.collect():
        q = np.array(r.query) / np.linalg.norm(r.query)
        best = sorted(((-float(unit[i] @ q), i) for i, lane, _ in rows if lane == r.lane and i in unit))[:5]
        assert sorted((x["rank"], x.ref_id) for x in got if x.query_id == r.query_id) == [(n, i) for n, (_, i) in enumerate(best, 1)]
    assert np.mean([r.cells for r in got]) < 6
    assert lanes.search(lanes.index(v.limit(0)), asked, 5).count() == 0


def test_places_in_an_order_are_counted_by_ranges(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(40)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, score int").repartition(7)
    got = {r.id: r.place for r in corpus.numbered(df, "place", F.desc("score"), "id").collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert corpus.numbered(df.limit(0), "place", "id").count() == 0
    works = spark.createDataFrame([(i, f"h{i}", (f"k{i % 3}",)) for i in range(90)] + [(99, "none", None)], "pos long, handle string, premise struct<key:string>").repartition(5)
    members = corpus.premise_members(works).collect()
    assert sorted((r.key, r.place, r.pos, r.handle) for r in members) == [(f"k{k}", n + 1, 3 * n + k, f"h{3 * n + k}") for k in range(3) for n in range(30)]


def test_many_queries_are_scored_in_blocks_as_pairs_are(spark):
    """Copies, vectors of no length, nulls and guards: the rows and scores of a join of all pairs, without that join."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 6)).round(1).tolist() + [[0.0] * 6]
    rows = [(i, f"f{i % 2}", None if i % 97 == 5 else base[int(rng.integers(61))], "quarantined" if i % 13 == 0 else "active", i % 9, None) for i in range(600)]
    v = spark.createDataFrame(rows, "fact_id long, fork_id string, vector array<double>, status string, revealed_at int, knower_scope array<struct<knower:string,learned_at:int>>")
    q = v.where("fact_id % 7 = 0").select(F.col("fact_id").alias("query_id"), "fork_id", F.lit("audience").alias("knower"), (F.col("fact_id") % 3 + 4).cast("int").alias("chapter"), F.col("vector").alias("query"))
    found = retrieval.search_many(v, q, 5)
    assert "BroadcastNestedLoop" not in (plan := found._jdf.queryExecution().toString()) and "CoGroup" in plan
    pairs = v.join(q, "fork_id").where(is_visible(F.col("knower"), F.col("chapter"))).select("query_id", "fact_id", cosine(F.col("vector"), F.col("query")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "fact_id"))
    want = pairs.withColumn("rank", rank).where("rank <= 5")
    told = lambda df: sorted((r.query_id, r["rank"], r.fact_id, r.score) for r in df.collect())
    told_want, told_found = told(want), told(found)
    assert [x[:3] for x in told_found] == [x[:3] for x in told_want] and len(told_want) > 300
    assert [x[3] for x in told_found] == [x[3] for x in told_want]
