"""URL filters: rules, and for urls without a rule the standing of their host in the link graph.  Built-in functions only.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's; the longest fitting rule
decides.  Hosts with urls that a rule allows are trusted seeds, hosts with urls that a rule blocks are blocked seeds, each
in proportion to such urls.  Links between pages, added up per pair of hosts, carry two personalised PageRanks: trust
runs from the trusted seeds along the links, distrust from the blocked seeds against them, so that who links to bad hosts
is held to account.  Both are scaled back to urls of the host; a host is blocked when its distrust exceeds its trust and
reaches ``THRESHOLD`` of its urls.  Urls of unlinked, unseeded hosts are allowed.

Edges are combined map-side, ranks live in written tables that are read again each round, and rounds end when nothing
moves any more; the driver sees one number a round.

Defined results: a null url, or one without ``://``, has empty host and path, belongs to the empty host, and is judged like
any other; a null page contributes no link; links without a host point to the page's own host; repeated rows count as
often as they stand; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.store import Scratch

RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
DAMPING = 0.85
THRESHOLD = 0.5
SETTLED = 1e-6
#: What moves shrinks by ``DAMPING`` a round, to ``SETTLED`` of it in 86; more than this many never happen.
ROUNDS = 120
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]*)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as a string, and its verdict; both null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest comes last and so is asked first
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, act).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Links per pair of hosts: src, dst, n."""
    own, _ = host_and_path(F.col(url_col).cast("string"))
    links = F.regexp_extract_all(F.coalesce(F.col(html_col).cast("string"), F.lit("")), F.lit(LINK), F.lit(1))
    out = pages.select(own.alias("src"), F.explode(links).alias("link"))
    full = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    to, _ = host_and_path(full)
    return out.select("src", F.when(full.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to).otherwise(F.col("src")).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(spark: SparkSession, hosts: DataFrame, edges: DataFrame, scratch: Scratch, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Personalised ranks over ``edges(src, dst, n)`` from ``hosts(host, trusted, blocked)``: host, trust, distrust.

    Ranks are in the seeds' own unit and sum to at most the seeds' sum.  A host without links in the direction of travel
    keeps what reaches it.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("into"))
    shares = scratch.keep(edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("out")).alias("onward"), (F.col("n") / F.col("into")).alias("backward")), "shares")
    seeds = scratch.keep(hosts.select("host", F.col("trusted").cast("double").alias("trusted"), F.col("blocked").cast("double").alias("blocked")), "seeds")
    leaves = seeds.select("host").join(shares.select(F.col("src").alias("host")).distinct(), "host", "left_anti").select(F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("onward"), F.lit(0.0).alias("backward"))
    roots = seeds.select("host").join(shares.select(F.col("dst").alias("host")).distinct(), "host", "left_anti").select(F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(0.0).alias("onward"), F.lit(1.0).alias("backward"))
    steps = scratch.keep(shares.unionByName(leaves).unionByName(roots), "steps")
    rank = scratch.keep(seeds.select("host", F.col("trusted").alias("trust"), F.col("blocked").alias("distrust")), "rank")
    for _ in range(rounds):
        ahead = steps.join(rank, steps["src"] == rank["host"]).select(F.col("dst").alias("host"), (F.col("trust") * F.col("onward")).alias("trust"), F.lit(0.0).alias("distrust"))
        back = steps.join(rank, steps["dst"] == rank["host"]).select(F.col("src").alias("host"), F.lit(0.0).alias("trust"), (F.col("distrust") * F.col("backward")).alias("distrust"))
        got = ahead.unionByName(back).groupBy("host").agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d"))
        after = seeds.join(got, "host", "left").select("host", ((1 - damping) * F.col("trusted") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"), ((1 - damping) * F.col("blocked") + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"))
        after = scratch.keep(after, "rank")
        was = rank.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
        moved = after.join(was, "host").agg(F.sum(F.abs(F.col("trust") - F.col("t")) + F.abs(F.col("distrust") - F.col("d"))).alias("moved"), F.sum(F.col("t") + F.col("d")).alias("all")).first()
        scratch.drop(rank)
        rank = after
        if (moved["moved"] or 0.0) <= SETTLED * max(moved["all"] or 0.0, 1.0):
            break
    else:
        raise RuntimeError(f"ranks did not settle in {rounds} rounds")
    return rank


def judge(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, trust, distrust (of the host, in urls)."""
    scratch = Scratch(spark, "url_filter")
    host, path = host_and_path(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    rule, act = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.select("id", "host", "path", rule.alias("rule"), act.alias("act"))
    count = lambda v: F.count(F.when(F.col("act") == v, 1))
    own = urls.groupBy("host").agg(F.count("*").alias("urls"), count("allow").alias("trusted"), count("block").alias("blocked"))
    edges = scratch.keep(host_edges(pages, url_col, html_col), "edges")
    linked = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    hosts = scratch.keep(linked.join(own, "host", "full_outer").select("host", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("urls", "trusted", "blocked"))), "hosts")
    rank = propagate(spark, hosts, edges, scratch)
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= threshold * F.greatest("urls", F.lit(1)))
    standing = rank.join(hosts.select("host", "urls"), "host").select("host", "trust", "distrust", F.when(bad, "block").otherwise("allow").alias("standing"))
    return urls.join(standing, "host").select("id", "host", "path", "rule", F.coalesce("act", "standing").alias("verdict"), "trust", "distrust")
