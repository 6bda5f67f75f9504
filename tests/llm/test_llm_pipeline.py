"""The registered queries and the corpus pipeline."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import decontaminate, store, toxicity
from factloom.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op3_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op5_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op9_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op10_simhash": ["doc_id", "fingerprint", "component_id"],
}


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert [c for c in COLUMNS[name] if c not in df.columns] == []
    table = "pages" if name.startswith("op1_") else "documents"
    assert df.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_stages_keep_columns_and_clean_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if n < 4:
            assert out.columns == start.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() <= start.count()
    left = {r.doc_id for r in docs.collect()}
    assert len(left) > 0.6 * start.count()
    assert left == {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}


def test_stages_do_what_they_say(spark):
    body = lambda k: " ".join(hashlib.md5(f"{k}-{i}".encode()).hexdigest()[:6] for i in range(120))
    near = body(1).split()
    near[60] = "changed"
    rows = [(1, body(1), "en", "s", 1), (2, body(1).upper(), "en", "s", 1), (3, " ".join(near), "en", "s", 1), (4, body(4), "en", "s", 1), (5, None, "en", "s", 0), (6, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.exact(spark, docs, "").collect()) == [2, 3, 4, 6]
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs.where("doc_id in (1, 3, 4, 6)"), "").collect()) == [1, 4, 6]
    bench = spark.createDataFrame([(0, " ".join(body(4).split()[10:40]))], "item_id long, text string")
    assert decontaminate.drop_contaminated(spark, docs.where(F.col("text") != ""), bench).count() == 3


COLUMNS_OF_DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, path, rows, schema=COLUMNS_OF_DOCUMENTS, labels=(), items=()):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def plain_run(rows, model, items):
    """The stages by brute force: ids (with how often) of what is left."""
    left = [r for r in rows if toxicity.sigmoid(sum(c * x for c, x in zip(model.curve, (1.0, *toxicity.features(toxicity.fold(r[1]), model.automaton())), strict=True))) < 0.5]
    best = {}
    for i, t in left:
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        if key not in best or (i is not None and (best[key][0] is None or i > best[key][0])):
            best[key] = (i, t)
    left = list(best.values())
    words = [(t or "").lower().split() for _, t in left]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in words]
    group = list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group = [group[a] if g == group[b] else g for g in group]
    order = lambda k: (left[k][0] is None, left[k][0] or 0)
    left = [left[min((k for k in range(len(left)) if group[k] == g), key=order)] for g in set(group)]
    known = {}
    ids = {k: decontaminate.word_ids(t, known) for k, t in items}

    def leaks(t):
        w = decontaminate.word_ids(t, known)
        for item in ids.values():
            for shift in range(1 - len(item), len(w)):
                if decontaminate.stretch(w, item, shift, 0, len(w), decontaminate.MIN_WORDS):
                    return True
                if 0 <= shift <= len(w) - len(item) and 5 * (w[shift : shift + len(item)] == item).sum() >= 4 * len(item):
                    return True
        return False

    return Counter(i for i, t in left if not leaks(t))


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    text = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(text(25))) for k in range(6)]
    rows, labels = [], []
    for i in range(240):
        w = text(rng.randint(30, 90))
        if i % 3 == 0:
            w[3] = w[9] = rng.choice(["vile", "nasty"])
        labels.append((i, 1, int(i % 3 == 0)))
        rows.append((i, " ".join(w)))
    for k in range(20):
        base = text(100)
        near = list(base)
        near[50 + k] = "changed"
        rows += [(1000 + 10 * k, " ".join(base)), (1001 + 10 * k, " ".join(base).upper()), (1002 + 10 * k, " ".join(near)), (1003 + 10 * k, " ".join(near[:60]))]
    leak = items[2][1].split()
    leak[8] = "other"
    rows += [(2000, " ".join([*text(20), *leak, *text(20)])), (2001, " ".join([*text(20), *leak[:16], *text(20)])), (2002, " ".join([*text(20), *leak[:7], *text(20)]))]
    rows += [(None, " ".join(text(40))), (None, " ".join(text(40))), (2003, None), (2004, ""), (2005, "x"), (2005, "y"), (2005, "y")]
    path = folder(spark, tmp_path / "a", [(i, t, "en", "s", len(t or "")) for i, t in rows], labels=labels, items=items)
    model = toxicity.fit(spark, spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    assert model.weights
    before = store.written(spark)
    got = corpus_pipeline.run(spark, path)
    # what the stages wrote for themselves is gone, only the last one's input is left
    assert len([r for r in store.written(spark) if r not in before]) <= 2
    assert Counter(r.doc_id for r in got.collect()) == plain_run(rows, model, items)


def test_run_on_empty_and_odd_tables(spark, tmp_path):
    wide = f"{COLUMNS_OF_DOCUMENTS}, row long, digest string, kept boolean, key long, id long"
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "empty", [], wide)).count() == 0
    rows = [(1, "one text of words here", "en", "s", 1), (1, "another text of words", None, None, None), (None, None, None, None, None), (None, "a third text stands here", "en", "s", 2), (2, "long " * 50_000, "en", "s", 3)]
    path = folder(spark, tmp_path / "odd", [(*r, 7, "d", True, 8, 9) for r in rows], wide)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, path)
        assert kept.columns == docs.columns and kept.count() == len(rows), name
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted((r.doc_id or 0, r.n_tokens > 1) for r in got) == [(0, False), (0, True), (1, True), (1, True), (2, True)]
