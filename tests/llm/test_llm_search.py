"""Quality rules, ranked search and the conversation trie against plain Python, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import lexical, quality, trie
from factloom.llm.queries import QUERIES

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "Ab c"), (4, "Ab c"), (5, "aB C"), (None, "x y z"), (6, "word " * 30_000)]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


# --- quality -----------------------------------------------------------------------------------------------------------


def plain_counts(text):
    words = WORD.findall(text)
    at = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if at[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [s for s in text.split("\n") if WORD.search(s)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def plain_grams(text, buckets):
    tokens = re.findall(r"[^\W]+|[^\w\x20\x09-\x0D]+", text)
    seeded = lambda x, seed: xxhash.xxh64_intdigest(x.encode(), seed)
    one = [seeded(t, 42) for t in tokens]
    two = [seeded(b, h) for h, b in zip(one, tokens[1:], strict=False)]
    return [(h - (h >> 63 << 64)) % buckets for h in one + two]


def test_quality_equals_plain_python(spark, sf, texts):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    said = defaultdict(set)
    for r in labels.collect():
        said[r.doc_id].add(r.quality)
    grams = {i: plain_grams(t, quality.BUCKETS) for i, t in texts.items()}
    everything, good = Counter(), Counter()
    for i, g in grams.items():
        everything.update(g)
        if said[i] == {1}:
            good.update(g)
    n, m = sum(everything.values()), sum(good.values())
    weight = {b: round(1e6 * math.log(((good[b] + 1) / (m + quality.BUCKETS)) / ((everything[b] + 1) / (n + quality.BUCKETS)))) for b in everything}
    for r in QUERIES["op11_quality"](spark, sf).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        g = grams[r.doc_id]
        # the log of another library may round a millionth the other way
        assert r.score == pytest.approx(sum(weight[b] for b in g) / len(g) / 1e6 if g else 0.0, abs=2e-6)
        assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)


def test_quality_of_held_out_labels(spark):
    """Trusted texts are those of four fifths of the labels; the others are judged."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = quality.judge(spark, docs, labels.where(~out)).withColumnRenamed("id", "doc_id")
    held = found.join(labels.where(out), "doc_id").where("not base_failed").select("kept", "quality").collect()
    right = sum(r.kept == (r.quality == 1) for r in held)
    assert len(held) > 50 and right >= 0.98 * len(held)


def test_quality_odd_rows(spark, frame):
    wide = frame([(*r, "c", 1, 0.5, "w") for r in ODD], "doc_id long, text string, counts string, id long, score double, weights string")
    labels = spark.createDataFrame([(4, 1), (4, 1), (5, 1), (5, 0), (None, 1), (77, 1)], "doc_id long, quality int")
    got = quality.judge(spark, wide, labels).collect()
    assert Counter(r.id for r in got) == Counter(i for i, _ in ODD)
    by = {r.id: r for r in got}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and by[1].base_failed and by[1].score == 0.0
    assert by[6].n_words == by[6].n_repeat_words == 30_000 and by[6].base_failed and not by[6].kept
    assert quality.judge(spark, wide.limit(0), labels).count() == 0
    bare = quality.judge(spark, wide, labels.limit(0)).collect()
    assert all(r.score == 0.0 and r.kept == (not r.base_failed) for r in bare)


def test_trusted_ids_beyond_the_broadcast(spark, docs, sf, monkeypatch):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    small = sorted(map(tuple, quality.judge(spark, docs, labels).collect()))
    monkeypatch.setattr(quality, "BROADCAST", 0)
    assert sorted(map(tuple, quality.judge(spark, docs, labels).collect())) == small


@pytest.mark.parametrize("text", ["a b c a b c", "a b c d", "x x x x x", "a b c x a b c y b c x", "", "a b", "z " * 7 + "a b c " * 2])
def test_repeated_words(spark, frame, text):
    got = frame([(1, text)]).select(quality.counts(F.col("text")).alias("c")).first().c
    assert tuple(got) == plain_counts(text)


def test_quality_plan_is_native(spark, docs, sf):
    plan = quality.judge(spark, docs, spark.read.parquet(f"{sf}/labels.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hashpartitioning" not in plan


# --- ranked search -----------------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, k):
    """All scores of all documents, by the law as it is stated."""
    docs = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(UPPER)))
        scores = []
        for i, c, n in docs:
            m = 25 + (75 * n * n_docs) // n_terms
            w = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            s = sum(f * w(t) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, f in asked.items() if t in c)
            if s > 0:
                scores.append((-s, -math.inf if i is None else i, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:k], 1)]
    return out


def as_tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3]))


@pytest.mark.parametrize(("shard", "items_at_once", "postings"), [(13, 512, 1_000_000), (3, 7, 300)])
def test_search_equals_all_scores(spark, frame, monkeypatch, shard, items_at_once, postings):
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", items_at_once)
    monkeypatch.setattr(lexical, "POSTINGS", postings)
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 20, 200])))) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(25)] + [(2000, None), (2001, "-- !"), (None, "w1 w2 w3")]
    asked = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 9, 40])))) for i in range(18)] + [(50, ""), (51, None), (52, "nowhere"), (53, "w1 W1 w1, w2")]
    got = as_tuples(lexical.search(spark, frame(rows, parts=5), frame(asked, "item_id long, text string"), 10))
    assert got == sorted(plain_search(rows, asked, 10), key=lambda r: r[:2])


def test_search_on_tables(spark, sf, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert as_tuples(QUERIES["op12_lexical"](spark, sf)) == sorted(plain_search(texts.items(), items, 10), key=lambda r: r[:2])


def test_search_odd_rows(spark, frame):
    wide = frame([(*r, 1, 2, "q", 4) for r in ODD], "doc_id long, text string, row long, id long, q string, rank int")
    asked = frame([(1, "AB x", 3), (1, "AB x", 3), (2, "word", 3), (None, "z", 3)], "item_id long, text string, score int")
    got = as_tuples(lexical.search(spark, wide, asked, 10))
    want = plain_search(ODD, [(1, "AB x"), (1, "AB x"), (2, "word"), (None, "z")], 10)
    assert Counter(got) == Counter(want)
    assert lexical.search(spark, wide.limit(0), asked).count() == 0
    assert lexical.search(spark, wide, asked.limit(0)).count() == 0


# --- conversations -----------------------------------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], (role, text)))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(cs) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    ends = defaultdict(list)
    for c, ts in rebuilt.items():
        ends[tuple(ts)].append(c)
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return Counter((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p], sha(p)) for p, cs in members.items())


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def found_trie(spark, turns):
    got = trie.trie(spark, trie.rebuild(trie.sequences(turns))).select(*NODE).collect()
    return Counter(tuple(r) for r in got)


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("nodes", "fan", "stretch"), [(200_000, 32, 1 << 14), (20, 2, 3)])
def test_trie_equals_plain_python(spark, frame, monkeypatch, nodes, fan, stretch):
    monkeypatch.setattr(trie, "NODES", nodes)
    monkeypatch.setattr(trie, "FAN", fan)
    monkeypatch.setattr(trie, "STRETCH", stretch)
    rng = random.Random(13)
    rows = []
    for c in range(400):
        for t in range(rng.choice([1, 1, 2, 3, 4, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t else "system", rng.choice(["a b", "a  b c", "", "x"])))
    rows += [(c, t, "user", "hot words here") for c in range(1000, 1200) for t in range(3)]  # copies
    rows += [(1500, t, "user", f"{t}") for t in range(150)]  # a long one
    rng.shuffle(rows)
    assert found_trie(spark, frame(rows, TURNS, parts=7)) == plain_trie(rows)


def test_trie_on_tables(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = Counter(tuple(r) for r in QUERIES["op13_prefix_trie"](spark, sf).select(*NODE).collect())
    assert got == plain_trie([tuple(r) for r in turns.collect()])


def test_trie_odd_rows(spark, frame):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, 1, "a", None), (None, 0, "user", "lost"), (41, 5, "a", "b" * 100_000), (-7, 0, "user", "x"), (-20, 0, "user", "y"), (60, 0, "system", "s"), (61, 0, "a", "late")]
    wide = frame([(*r, "k", 1, "up") for r in rows], TURNS + ", key string, at int, turns string")
    assert found_trie(spark, wide) == plain_trie(rows)
    assert found_trie(spark, wide.limit(0)) == Counter()


def test_nodes_get_their_texts(spark, frame):
    rows = [(0, 0, "user", "hello"), (0, 1, "bot", "you"), (20, 0, "user", "hello"), (20, 1, "user", "")]
    turns = frame(rows, TURNS)
    convs = trie.sequences(turns)
    got = trie.with_texts(trie.trie(spark, convs), turns).select("depth", "role", "text", "n_convs").collect()
    assert Counter(map(tuple, got)) == Counter([(0, None, None, 2), (1, "user", "hello", 2), (2, "bot", "you", 1), (2, "user", "", 1)])
