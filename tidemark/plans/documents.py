"""Documents of a graph that Spark derives from `conversations` (turns as events, their pieces as claims, runs of one speaker
as states, speakers and dialogues as scopes), and expansion and direct state retrieval over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_tokens
from ..operators import documents, expansion, retrieval
from ..operators.lineage import cut
from .common import table
from .policies import _inputs


def _graph(spark, d) -> dict[str, DataFrame]:
    t = table(spark, d, "conversations")
    event = F.concat_ws(":", "conv_id", "turn")
    ord_ = F.col("conv_id") * 1000 + F.col("turn")
    pieces = t.select(event.alias("event_id"), "conv_id", "role", F.posexplode(F.split("text", r"\. ")).alias("ord", "piece"))
    claims = pieces.select(
        F.concat_ws(":", "event_id", "ord").alias("claim_id"), "event_id", "ord", F.col("role").alias("subject"), F.lit("status").alias("facet_key"), F.col("piece").alias("value"),
        F.when(F.length("piece") > 60, "occurred_at").alias("time_role"), F.when(F.length("piece") > 60, F.col("conv_id").cast("string")).alias("time_value"),
        F.when(F.length("piece") > 30, F.concat_ws(":", F.lit("status"), "role")).alias("state_dimension"), F.lower("role").alias("subject_key"),
    )
    state = F.concat_ws("/", "conv_id", "role")
    scope = F.explode(F.array(F.concat(F.lit("role:"), F.col("role")), F.concat(F.lit("conv:"), F.col("conv_id"))))
    return {
        "events": t.select(event.alias("event_id"), F.col("conv_id").alias("session_id"), F.col("role").alias("speaker"), "text"),
        "claims": claims,
        "scopes": t.select(scope.alias("scope_id")).distinct().select("scope_id", F.when(F.col("scope_id") == "role:user", "group").when(F.col("scope_id").startswith("role"), "person").otherwise("session").alias("scope_type"), F.split_part("scope_id", F.lit(":"), F.lit(2)).alias("label")),
        "event_scopes": t.select(event.alias("event_id"), scope.alias("scope_id"), ord_.alias("ord")),
        "states": t.select(state.alias("state_id"), F.col("role").alias("subject"), F.lit("status").alias("state_domain"), F.lit("current").alias("status")).distinct(),
        "support": pieces.where("length(piece) > 30").select(state.alias("state_id"), F.concat_ws(":", "event_id", "ord").alias("claim_id"), (F.split_part("event_id", F.lit(":"), F.lit(2)).cast("int") * 1000 + F.col("ord")).alias("ord")),
    }


def t11_event_texts(spark, d) -> DataFrame:
    g = _graph(spark, d)
    return documents.event_documents(g["events"], g["claims"], g["event_scopes"], g["scopes"], g["states"], g["support"])


def t11_state_documents(spark, d) -> DataFrame:
    g = _graph(spark, d)
    return documents.state_documents(g["states"], g["support"], g["claims"], g["events"])


def t11_scope_documents(spark, d) -> DataFrame:
    g = _graph(spark, d)
    return documents.scope_documents(g["scopes"], g["event_scopes"], g["events"], g["claims"])


def _memory(spark, d, k: int | None = None) -> dict[str, DataFrame]:
    """Documents as claims, four a state, with relations between neighbours of one state; the tables of `_inputs` (with the best k hits of a question) with what expansion reads."""
    g = _inputs(spark, d, k)
    docs = table(spark, d, "documents")
    terms = cut(docs.select(F.col("doc_id").alias("claim_id"), F.array_distinct(plain_tokens(F.col("text"))).alias("terms")))
    g["claims"] = g["claims"].join(terms, "claim_id")
    g["relations"] = g["relations"].where("src div 4 = dst div 4").select(F.lit("SUPERSEDES").alias("type"), F.col("dst").alias("src"), F.col("src").alias("dst"), F.array(F.expr("dst div 2")).alias("evidence_event_ids"))
    first = g["claims"].select(F.expr("claim_id div 4").alias("state_id"), "claim_id", "subject", "dimension").groupBy("state_id").agg(F.min("claim_id").alias("primary_claim_id"), F.min_by("subject", "claim_id").alias("subject"), F.min_by("dimension", "claim_id").alias("dimension"))
    g["support"], g["states"] = g["states"].select("state_id", "claim_id"), first.withColumns({"many": F.col("dimension") != "en", "current": F.lit(True)})
    g["evidence"] = expansion.state_evidence(g["states"], g["support"], g["relations"])
    g["questions"] = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(plain_tokens(F.col("text"))).alias("terms"), F.lit(None).cast("array<string>").alias("subjects"), F.lit(False).alias("wide"))
    return g


def _expanded(g: dict[str, DataFrame], seeds: DataFrame, events: int, states: int) -> expansion.Expansion:
    claims = g["claims"].select("claim_id", "event_id", "subject", "dimension", "terms")
    found = expansion.expand(seeds, g["questions"], claims, g["relations"], g["states"], g["support"], g["evidence"])
    return expansion.closed_pack(found, claims, g["relations"], g["evidence"], events, states)


def _told(pack: expansion.Expansion) -> DataFrame:
    """What a question is given, as (query_id, kind, id, place)."""
    order = F.struct("hop", "seed_rank", "claim_id")
    of = lambda df, kind, name, place: df.select("query_id", F.lit(kind).alias("kind"), F.col(name).cast("string").alias("id"), place.cast("int").alias("place"))
    claims = retrieval.top(pack.claims, 1_000_000, ["query_id"], [order], "place")
    return of(pack.events, "event", "event_id", F.col("place")).unionByName(of(pack.states, "state", "state_id", F.col("place"))).unionByName(of(claims, "claim", "claim_id", F.col("place")))


def j1_relation_expansion(spark, d) -> DataFrame:
    """The best three documents of each question as seed events, expanded over relations and states and closed within 8 events and 4 states."""
    g = _memory(spark, d, 3)
    best = retrieval.top(g["hits"], 3, ["query_id"], [F.desc("score"), F.col("doc_id")])
    seeds = best.groupBy("query_id", F.expr("cast(doc_id div 2 as string)").alias("id")).agg(F.min("rank").alias("rank")).select("query_id", F.lit("event").alias("kind"), "id", "rank")
    return _told(_expanded(g, seeds, 8, 4))


def r12_state_retrieval(spark, d) -> DataFrame:
    """States searched directly: those of routed scopes by the words of their claims, the best three as seeds of an expansion
    to their proofs."""
    g = _memory(spark, d)
    return _told(_expanded(g, state_seeds(g, spark, d), 8, 4))


def state_seeds(g: dict[str, DataFrame], spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(F.expr("doc_id div 4").alias("doc_id"), F.struct("doc_id", plain_tokens(F.col("text")).alias("t")).alias("p"))
    texts = docs.groupBy("doc_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["t"])).alias("tokens"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), plain_tokens(F.col("text")).alias("tokens"))
    inside = g["support"].join(g["scopes"], "claim_id").join(g["routed"], "scope_id").select("query_id", F.col("state_id").alias("doc_id")).distinct()
    hits = retrieval.bm25(texts, asked, k=3, allowed=inside)
    return hits.select("query_id", F.lit("state").alias("kind"), F.col("doc_id").cast("string").alias("id"), "rank")


_SQL = r"""
WITH ev AS (SELECT conv_id || ':' || turn AS e, conv_id, turn, role, text FROM conversations),
pc AS (SELECT e, conv_id, turn, role, unnest(string_split(text, '. ')) AS piece, generate_subscripts(string_split(text, '. '), 1) - 1 AS o FROM ev),
cl AS (
  SELECT *, e || ':' || o AS c, trim(concat_ws(' ', '', role, 'status:', piece, CASE WHEN length(piece) > 60 THEN '[occurred_at=' || conv_id || '; normalized=]' END,
    '(subject_key=' || lower(role) || CASE WHEN length(piece) > 30 THEN '; dimension=status:' || role ELSE '' END || ')')) AS t,
    array_to_string(list_filter([role, 'status', piece, CASE WHEN length(piece) > 60 THEN 'occurred_at' END, CASE WHEN length(piece) > 60 THEN conv_id::VARCHAR END], lambda x: x IS NOT NULL AND x <> ''), ' ') AS f
  FROM pc
),
et AS (SELECT e, conv_id, turn, role, array_to_string(list_filter([conv_id::VARCHAR, role, text], lambda x: x <> ''), ' ') AS t FROM ev),
"""
_EVENT_TEXTS = _SQL + r"""
ct AS (SELECT e, string_agg(t, ' ' ORDER BY o, c) AS t FROM cl GROUP BY e),
st AS (SELECT DISTINCT e, role || ' current' AS t FROM cl WHERE length(piece) > 30)
SELECT et.e AS event_id, et.t || ' ' || ct.t || ' session ' || conv_id || ' ' || CASE role WHEN 'user' THEN 'group' ELSE 'person' END || ' ' || role || coalesce(' ' || st.t, '') AS document
FROM et JOIN ct ON ct.e = et.e LEFT JOIN st ON st.e = et.e
"""
_STATE_DOCS = _SQL + r"""
su AS (SELECT * FROM cl WHERE length(piece) > 30),
ct AS (SELECT conv_id, role, string_agg(t, ' ' ORDER BY turn, o) AS t FROM su GROUP BY 1, 2),
ee AS (SELECT conv_id, role, string_agg(t, ' ' ORDER BY turn) AS t FROM et WHERE e IN (SELECT e FROM su) GROUP BY 1, 2)
SELECT s.conv_id || '/' || s.role AS state_id, concat_ws(' ', s.role || ' status current', ct.t, ee.t) AS document
FROM (SELECT DISTINCT conv_id, role FROM ev) s LEFT JOIN ct ON ct.conv_id = s.conv_id AND ct.role = s.role LEFT JOIN ee ON ee.conv_id = s.conv_id AND ee.role = s.role
"""
_SCOPE_DOCS = _SQL + r"""
sc AS (SELECT e, conv_id, turn, 'role:' || role AS s, CASE role WHEN 'user' THEN 'group' ELSE 'person' END AS k, role AS l FROM ev UNION ALL SELECT e, conv_id, turn, 'conv:' || conv_id, 'session', conv_id::VARCHAR FROM ev),
kept AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY conv_id, turn) AS at_ FROM sc QUALIFY at_ <= CASE k WHEN 'group' THEN 1200 ELSE 240 END),
said AS (SELECT e, 0 AS n, t FROM et UNION ALL SELECT e, o + 1, f FROM cl WHERE o < 2)
SELECT s AS scope_id, any_value(k) || ' ' || any_value(l) || ' ' || s || ' ' || string_agg(t, ' ' ORDER BY at_, n) FILTER (t <> '') AS document FROM kept JOIN said USING (e) GROUP BY s
"""
QUERIES = {
    "t11_event_texts": (t11_event_texts, _EVENT_TEXTS),
    "t11_state_documents": (t11_state_documents, _STATE_DOCS),
    "t11_scope_documents": (t11_scope_documents, _SCOPE_DOCS),
    "j1_relation_expansion": (j1_relation_expansion, None),
    "r12_state_retrieval": (r12_state_retrieval, None),
}
