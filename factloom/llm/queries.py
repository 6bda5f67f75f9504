"""The thin queries opN_<name>: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, exact_dedup, lexical, passage_dedup, pieces, pii, quality, sharding, simhash, suffix_dedup, toxicity, trie, url_filter

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> bytes:
    """The tokenizer file, read on the driver; executors get its bytes."""
    return Path(PIECE_MODEL).read_bytes()


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.round_trip(spark, table(spark, sf_dir, "documents"), piece_model())
    return found.withColumnRenamed("id", "doc_id")


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(spark, table(spark, sf_dir, "documents"), 24)
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The checksum is a table of 256 remainders and a fold over the bytes, the jump a recursion per key.
ORACLE_SQL["op4_sharding"] = """
WITH RECURSIVE
    bits(b, c, k) AS (
        SELECT b, b, 0 FROM range(256) t(b)
        UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
    crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
    d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    y AS (SELECT doc_id, CAST(length(x) // 2 + 8 AS BIGINT) AS size,
        list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))) AS bytes FROM d),
    s AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1])), 4294967295) AS text_crc32 FROM y, crc),
    n(shards) AS (VALUES (24), (25)),
    m0 AS (SELECT DISTINCT doc_id, CAST((CAST(doc_id AS HUGEINT) + 18446744073709551616) % 18446744073709551616 AS UHUGEINT) AS h FROM documents),
    m1 AS (SELECT doc_id, xor(h, h >> 30) * 13787848793156543929 % 18446744073709551616 AS h FROM m0),
    m2 AS (SELECT doc_id, xor(h, h >> 27) * 10723151780598845931 % 18446744073709551616 AS h FROM m1),
    jump(doc_id, shards, h, b, j) AS (
        SELECT doc_id, shards, xor(h, h >> 31), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM m2, n
        UNION ALL SELECT doc_id, shards, h, j, CAST(floor((j + 1) * (CAST(2147483648 AS DOUBLE) / (CAST(h >> 33 AS DOUBLE) + 1.0))) AS BIGINT)
        FROM (SELECT doc_id, shards, j, (h * 2862933555777941757 + 1) % 18446744073709551616 AS h FROM jump WHERE j < shards)),
    home AS (SELECT doc_id, max(b) FILTER (WHERE shards = 24) AS shard, max(b) FILTER (WHERE shards = 25) AS grown_shard FROM jump GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM s JOIN home USING (doc_id)
"""


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(spark, table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL["op5_exact_dedup"] = """
WITH d AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(spark, table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(spark, docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(spark, docs, model)
    return found.select(F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score", "predicted")


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "doc_word", "item_word", "n_words", "n_equal")


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(spark, table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "trust", "distrust")


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(spark, table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("base", lambda s: s["rank"] == pii.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(F.col("id").alias("doc_id"), *(of(k) for k in pii.KINDS[:4]), F.sha2(pii.spelled(F.col("base")), 256).alias("base_sha256"), pii.spelled(F.col("all")).alias("spans"))


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(spark, table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


#: Every string of 50 bytes of every text, as hexadecimal digits.
ORACLE_SQL["op9_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    b AS (SELECT doc_id, unnest(range(length(x) // 2)) AS p, x FROM d),
    g AS (SELECT doc_id, p, substr(x, 2 * p + 1, 2) AS byte, CASE WHEN 2 * p + 100 <= length(x) THEN substr(x, 2 * p + 1, 100) END AS s FROM b),
    f AS (SELECT doc_id, p, byte, s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id AS hit FROM g),
    c AS (SELECT doc_id, p, byte, coalesce(bool_or(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM f),
    e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM c),
    a AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
        string_agg(byte, '' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passage_dedup.repeated_passages(spark, table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("start").alias("start_byte"), F.col("stop").alias("stop_byte"), F.col("passage").alias("component_id"), F.col("keep_id").alias("keep_doc_id"), "removed")


@query
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


@query
def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


ORACLE_SQL["op12_lexical"] = r"""
WITH t AS (
        SELECT doc_id, row_number() OVER () AS row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    d AS (SELECT row, doc_id, count(*) AS n FROM t GROUP BY ALL),
    c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
    p AS (SELECT row, term, count(*) AS tf FROM t GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, docs),
    q AS (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    f AS (SELECT item_id, term, count(*) AS f FROM q GROUP BY ALL),
    s AS (
        SELECT item_id, row, doc_id, CAST(sum(f * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
        FROM f JOIN w USING (term) JOIN p USING (term) JOIN d USING (row), c GROUP BY ALL),
    r AS (
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
        FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = trie.rebuild(trie.sequences(table(spark, sf_dir, "conversations")))
    return trie.trie(spark, convs).drop("key", "turn")


ORACLE_SQL["op13_prefix_trie"] = r"""
WITH RECURSIVE
    bits(b, c, k) AS (
        SELECT b, b, 0 FROM range(256) t(b)
        UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
    crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
    o AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT c, list({'r': r, 't': t} ORDER BY turn NULLS FIRST, r, sha256(length(r) || ':' || r || t)) AS l FROM o GROUP BY c),
    h AS (
        SELECT c, l, c - c % 20 AS donor, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
            lambda a, y: xor(a >> 8, crc.t[(xor(a, y) & 255) + 1])), 4294967295) % 4 AS h FROM own, crc),
    e AS (SELECT h.c, list_concat(coalesce(d.l[1:h.h], []), h.l[h.h + 1:]) AS l FROM h LEFT JOIN own d ON d.c = h.donor),
    p AS (SELECT c, len(l) AS size, unnest(range(len(l) + 1)) AS depth, l FROM e),
    n AS (
        SELECT depth, l[1:depth] AS p, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE size = depth), '') AS ends
        FROM p GROUP BY ALL),
    k AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
    s AS (
        SELECT n.depth, n.p, n.conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, sha256(ends) AS ends_sha256,
            CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * len(regexp_extract_all(n.p[n.depth].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved FROM n LEFT JOIN k USING (p)),
    a AS (SELECT unnest(range(depth + 1)) AS up, p, n_children, saved FROM s),
    u AS (SELECT p[1:up] AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM a GROUP BY ALL)
SELECT s.conv_id, s.depth, b.conv_id AS parent_conv_id, s.n_convs, s.n_children, n_leaves, saved_tokens, s.ends_sha256
FROM s JOIN u USING (p) LEFT JOIN n b ON s.depth > 0 AND b.p = s.p[1:s.depth - 1]
"""
