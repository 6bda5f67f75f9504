"""The engine as SQL: views and table functions with parameters on a session, and a router of typed questions onto them.

Views: ``fl_facts``, ``fl_forks``, ``fl_lineage``, ``fl_canon`` (what each fork resolves to).  Functions:

* ``fl_as_of(fork, chapter)``: the one fact per key that holds;
* ``fl_visible(fork, knower, chapter)`` and ``fl_withheld(...)``: the two halves of a fork by the guard;
* ``fl_edges(fork, knower, chapter)``: visible, valid facts with an object;
* ``fl_khop(fork, knower, chapter, start, hops)``: nodes within some steps of a node;
* ``fl_open(chapter)``: commitments (where a table of them is given) that still wait.

All are temporary, end with the session, and are plain SQL that Catalyst plans together with the query around them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.operators import lineage
from factloom.schema import AUDIENCE, OPEN_COMMITMENTS

KEY = "subject_id BIGINT, predicate STRING, id BIGINT, object_id BIGINT, object_literal STRING, status STRING"
NAMES = "subject_id, predicate, id, object_id, object_literal, status"
#: The guard as in ``functions.guard``: learned by then and not quarantined.
SEEN = """coalesce(status <> 'quarantined' AND CASE WHEN knower_scope IS NULL THEN revealed_at
    ELSE get(filter(knower_scope, a -> a.knower = {knower}), 0).learned_at END <= {chapter}, false)"""
VALID = "coalesce(valid_from <= {chapter} AND (valid_to IS NULL OR {chapter} <= valid_to), false)"

FUNCTIONS = {
    "fl_as_of(fork STRING, chapter INT)": (
        KEY,
        f"""SELECT subject_id, predicate, f.id, f.object_id, f.object_literal, f.status FROM (
            SELECT subject_id, predicate, max_by(struct(id, object_id, object_literal, status), struct(status <> 'invalidated', valid_from, recorded_at, id)) AS f
            FROM fl_canon WHERE root = fork AND status <> 'quarantined' AND {VALID.format(chapter="fl_as_of.chapter")} GROUP BY subject_id, predicate)""",
    ),
    "fl_visible(fork STRING, who STRING, chapter INT)": (KEY, f"SELECT {NAMES} FROM fl_canon WHERE root = fork AND {SEEN.format(knower='who', chapter='fl_visible.chapter')}"),
    "fl_withheld(fork STRING, who STRING, chapter INT)": (KEY, f"SELECT {NAMES} FROM fl_canon WHERE root = fork AND NOT {SEEN.format(knower='who', chapter='fl_withheld.chapter')}"),
    "fl_edges(fork STRING, who STRING, chapter INT)": (
        "fact_id BIGINT, src BIGINT, label STRING, dst BIGINT",
        f"""SELECT id, subject_id, predicate, object_id FROM fl_canon
            WHERE root = fork AND object_id IS NOT NULL AND {SEEN.format(knower="who", chapter="fl_edges.chapter")} AND {VALID.format(chapter="fl_edges.chapter")}""",
    ),
    # distinct pairs of node and distance: at most ``hops`` rows a node, whatever cycles there are
    "fl_khop(fork STRING, who STRING, chapter INT, start BIGINT, hops INT)": (
        "node BIGINT",
        f"""WITH RECURSIVE walk(node, step) AS (
            SELECT start, 0
            UNION ALL
            SELECT DISTINCT object_id, step + 1 FROM walk JOIN fl_canon ON subject_id = node
            WHERE step < hops AND root = fork AND object_id IS NOT NULL AND {SEEN.format(knower="who", chapter="fl_khop.chapter")} AND {VALID.format(chapter="fl_khop.chapter")})
        SELECT DISTINCT node FROM walk WHERE step > 0""",
    ),
}
OPEN = ("fl_open(chapter INT)", ("id BIGINT, state STRING, planted_at INT", f"SELECT id, state, planted_at FROM fl_commitments WHERE planted_at <= fl_open.chapter AND state IN {OPEN_COMMITMENTS}"))

#: Typed questions: the parameters that each takes, in order, and the function that answers it.
ROUTES = {
    "attribute": (("fork", "chapter", "subject", "predicate"), "SELECT * FROM fl_as_of(:fork, :chapter) WHERE subject_id = :subject AND predicate = :predicate"),
    "as_of": (("fork", "chapter"), "SELECT * FROM fl_as_of(:fork, :chapter)"),
    "epistemic": (("fork", "knower", "chapter"), "SELECT * FROM fl_visible(:fork, :knower, :chapter)"),
    "spoilers": (("fork", "knower", "chapter"), "SELECT * FROM fl_withheld(:fork, :knower, :chapter)"),
    "reach": (("fork", "knower", "chapter", "start", "hops"), "SELECT * FROM fl_khop(:fork, :knower, :chapter, :start, :hops)"),
    "commitments": (("chapter",), "SELECT * FROM fl_open(:chapter)"),
}
DEFAULTS = {"knower": AUDIENCE}


class Unroutable(ValueError):
    """A question of no known kind, or without what its kind needs; nothing is guessed."""


def register(spark: SparkSession, facts: DataFrame, forks: DataFrame, commitments: DataFrame | None = None) -> None:
    """Put the views and functions on a session, over these tables; registering again replaces them."""
    lines = lineage.lineage(spark, forks)
    views = {"fl_facts": facts, "fl_forks": forks, "fl_lineage": lines, "fl_canon": lineage.resolved(facts, lines)}
    functions = dict(FUNCTIONS)
    if commitments is not None:
        views["fl_commitments"] = commitments
        functions |= dict([OPEN])
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    for head, (columns, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE ({columns}) RETURN {body}")


def route(spark: SparkSession, kind: str, **asked: object) -> DataFrame:
    """Answer a typed question by its function; ``Unroutable`` where the kind is unknown or its parameters are not these."""
    if kind not in ROUTES:
        raise Unroutable(f"no route for {kind!r}; there are {', '.join(ROUTES)}")
    names, sql = ROUTES[kind]
    given = {n: DEFAULTS[n] for n in names if n in DEFAULTS} | asked
    if set(given) != set(names):
        raise Unroutable(f"{kind} takes {', '.join(names)}, not {', '.join(asked) or 'nothing'}")
    return spark.sql(sql, args=given)
