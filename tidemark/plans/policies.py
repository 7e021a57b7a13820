"""Policy queries: benchmark passages as questions, documents as claims and events, their sources as scopes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_tokens, ruled_sentences
from ..operators import answers, metrics, policies, retrieval
from ..operators.lineage import cut
from .common import table
from .retrieval import _PLAIN, _corpus

#: What the policy queries ask for.
LIMITS = {"backoff": 3, "seeds": 4, "most": 8, "most_events": 5}


def _inputs(spark, d, k: int | None = None) -> dict[str, DataFrame]:
    """Two neighbours by id share an event, four a state; texts in English hold a time role that every third question asks for.

    Hits are all of a question, or its best k. `wide` are hits with what policies ask of their documents: scoring carries
    these columns along with the id, so that hits, which are many a document, never meet the documents by a join.
    """
    docs = table(spark, d, "documents")
    id_ = F.col("doc_id").alias("claim_id")
    corpus, asking = _corpus(spark, d)
    corpus = docs.select(F.struct("doc_id", "source", "lang").alias("doc_id"), plain_tokens(F.col("text")).alias("tokens")) if k is None else corpus
    wide = cut(retrieval.bm25(corpus, asking, k=k))
    if k is None:
        wide = wide.select("query_id", "doc_id.doc_id", "score", "doc_id.source", "doc_id.lang")
    hits = wide.select("query_id", "doc_id", "score")
    roles = F.when(F.col("lang") == "en", F.array(F.lit("occurred_at"))).otherwise(F.array().cast("array<string>"))
    asked = F.when(F.col("item_id") % 3 == 0, F.array(F.lit("occurred_at"), F.lit("started_at"))).otherwise(F.array().cast("array<string>"))
    known = wide if k is None else hits.join(docs.select("doc_id", "source", "lang"), "doc_id")
    sums = known.groupBy("query_id", F.col("source").alias("scope_id")).agg(F.round(F.sum("score"), 4).alias("score"))
    next_ = docs.select((F.col("doc_id") - 1).alias("src"), F.col("doc_id").alias("dst"))
    return {
        "claims": docs.select(id_, F.expr("doc_id div 2").alias("event_id"), roles.alias("roles"), F.col("source").alias("subject"), F.col("lang").alias("dimension")),
        "hits": hits,
        "wide": known.select("query_id", "doc_id", "score", F.array("source").alias("scope_ids"), roles.alias("roles")),
        "scopes": docs.select(id_, F.col("source").alias("scope_id")),
        "routed": policies.route_scopes(sums, docs.select(F.col("source").alias("scope_id"), F.lower("source").alias("semantic_key")).distinct(), 2),
        "asked": table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), asked.alias("asked")),
        "relations": next_.join(docs.select(F.col("doc_id").alias("src")), "src", "left_semi"),
        "states": docs.select(F.expr("doc_id div 4").alias("state_id"), id_),
    }


def _policy_inputs(spark, d) -> dict[str, DataFrame]:
    """The tables of `_inputs` for claim policies, with the hits that they choose among found once for all of them."""
    g = _inputs(spark, d)
    g["routed"] = cut(g["routed"])
    g["short"] = cut(policies.shortlist(g.pop("wide"), g["routed"], g["asked"], max(LIMITS["backoff"], LIMITS["seeds"], LIMITS["most"])))
    return g


def _all_policies(spark, d) -> dict[str, tuple[DataFrame, DataFrame]]:
    given = _policy_inputs(spark, d)
    return {p: policies.claim_policy(p, **given, **LIMITS) for p in policies.CLAIM_POLICIES}


def r11_claim_policies(spark, d) -> DataFrame:
    parts = [kept.select(F.lit(p).alias("policy"), "query_id", "claim_id", "event_id", "rank") for p, (kept, _) in _all_policies(spark, d).items()]
    return reduce(DataFrame.unionByName, parts)


def r12_event_policies(spark, d) -> DataFrame:
    g = _inputs(spark, d)
    by_doc = lambda name: g[name].withColumnRenamed("claim_id", "doc_id")
    parts = [policies.event_policy(p, g["hits"], by_doc("scopes"), g["routed"], by_doc("claims"), g["asked"], g["relations"], k=5, most=8).select(F.lit(p).alias("policy"), "query_id", "doc_id", "rank") for p in policies.EVENT_POLICIES]
    return reduce(DataFrame.unionByName, parts)


def r6_anchored_routing(spark, d) -> DataFrame:
    """Sources as scopes; each question has the source of the document with its own id as anchor. Sources that share a first letter share a key."""
    g, docs = _inputs(spark, d), table(spark, d, "documents")
    sums = g["hits"].join(docs.select("doc_id", F.col("source").alias("scope_id")), "doc_id").groupBy("query_id", "scope_id").agg(F.round(F.sum("score"), 4).alias("score"))
    scopes = docs.select(F.col("source").alias("scope_id"), F.substring("source", 1, 1).alias("semantic_key")).distinct()
    anchors = g["asked"].join(docs.select(F.col("doc_id").alias("query_id"), F.col("source").alias("scope_id")), "query_id").select("query_id", "scope_id")
    return policies.route_scopes(sums, scopes, 3, anchors)


def e1_packing(spark, d) -> DataFrame:
    """What the last claim policy finds, packed into at most 4 claims, 1 state and 3 events a question."""
    g = _policy_inputs(spark, d)
    kept, states = policies.claim_policy("scope-claim-time-state", **g, **LIMITS)
    kept = cut(kept)
    events = kept.groupBy("query_id", "event_id").agg(F.min("rank").alias("rank"))
    state_list = cut(states.withColumn("rank", F.lit(1)))
    units = policies.evidence_units(events, g["claims"], g["states"].select("state_id", "claim_id"), kept, state_list)
    own = kept.select("query_id", F.lit("claim").alias("kind"), F.col("claim_id").cast("string").alias("id"), "claim_id", "event_id", F.lit(True).alias("known"))
    held = state_list.select("query_id", "state_id").join(g["states"], "state_id").join(kept.select("query_id", "claim_id", "event_id"), ["query_id", "claim_id"], "left")
    held = held.select("query_id", F.lit("state").alias("kind"), F.col("state_id").cast("string").alias("id"), "claim_id", "event_id", F.col("event_id").isNotNull().alias("known"))
    links = kept.select("query_id", F.col("claim_id").alias("src"), F.col("event_id")).join(g["relations"], "src").select("query_id", "src", "dst", "event_id")
    return policies.packed_evidence(units, own.unionByName(held), links, events, claims=4, states=1, events=3)


def j2_scope_coverage(spark, d) -> DataFrame:
    """Seeds: the best two documents of a question; related: those and their neighbours by id; candidates: its best twenty."""
    g = _inputs(spark, d)
    best = cut(retrieval.top(g["hits"], 20, ["query_id"], [F.desc("score"), F.col("doc_id")]))
    seeds = best.where("rank <= 2").select("query_id", "doc_id", "rank")
    near = seeds.join(g["relations"], F.col("doc_id") == F.col("src")).select("query_id", F.col("dst").alias("doc_id"), (F.col("rank") + 2).alias("rank"))
    related = seeds.unionByName(near).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    terms = table(spark, d, "documents").select("doc_id", F.array_distinct(plain_tokens(F.col("text"))).alias("terms"))
    return policies.scope_coverage(related, best, seeds, g["scopes"].withColumnRenamed("claim_id", "doc_id"), terms, 8)


def j2_coverage_states(spark, d) -> DataFrame:
    """States of the first three turns of each dialogue as picked events, by rounds: a state for each word of a turn."""
    t = table(spark, d, "conversations").where("turn < 3")
    picks = t.select(F.col("conv_id").alias("query_id"), F.concat_ws(":", "conv_id", "turn").alias("event_id"), (F.col("turn") + 1).alias("pick"))
    words = t.select(F.concat_ws(":", "conv_id", "turn").alias("event_id"), F.explode(F.array_distinct(plain_tokens(F.col("text")))).alias("state_id")).withColumn("claim_id", F.concat_ws(":", "event_id", "state_id"))
    return policies.coverage_states(picks, words.select("claim_id", "event_id"), words.select("state_id", "claim_id"))


def j4_scoped_expansion(spark, d) -> DataFrame:
    """Events above 100 as seeds of their user; claims lead to the event before by id two times of three and to states by user and type; even types are routed."""
    e = table(spark, d, "events")
    claims = e.select(F.col("event_id").alias("claim_id"), "event_id")
    relations = e.where("event_id % 3 <> 0").select(F.col("event_id").alias("src"), (F.col("event_id") - 1).alias("dst")).join(e.select(F.col("event_id").alias("dst")), "dst", "left_semi").select("src", "dst")
    state = F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd"))
    states = e.select(state.alias("state_id"), F.col("event_type").alias("scope_id"), F.col("event_id").alias("claim_id"))
    seeds = e.where("value > 100").select(F.col("user_id").alias("query_id"), "event_id")
    routed = seeds.select("query_id").distinct().select("query_id", F.explode(F.array(F.lit("purchase"), F.lit("click"))).alias("scope_id"))
    return policies.scoped_expansion(seeds, claims, relations, states, routed, e.select("event_id", F.col("event_type").alias("scope_id")))


def t13_ruled_sentences(spark, d) -> DataFrame:
    """Sentences of every document by the rule that knows abbreviations, initials, ellipses and quotations."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(ruled_sentences(F.col("text"))).alias("ordinal", "sentence"))


def _judged(spark, d) -> DataFrame:
    """Each turn as an answer to the one before; questions of tool turns are adversarial."""
    t = table(spark, d, "conversations")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gold_answer"))
    rows = t.select("conv_id", "turn", F.col("text").alias("hypothesis"), F.when(F.col("role") == "tool", "adversarial").otherwise(F.col("role")).alias("question_type")).join(before, ["conv_id", "turn"])
    return cut(rows.withColumn("answer_f1", metrics.token_f1(plain_tokens(F.col("hypothesis")), plain_tokens(F.col("gold_answer")))))


def m17_judgment(spark, d) -> DataFrame:
    found = answers.judgment(F.col("question_type"), F.col("answer_f1"), F.col("hypothesis"), F.col("gold_answer"))
    return _judged(spark, d).select("conv_id", "turn", found["label"].alias("label"), found["reason"].alias("reason"))


def m20_judged_summary(spark, d) -> DataFrame:
    """Turns judged by rule, else by a given label (equivalent where half of the tokens agree), summed up."""
    key = answers.judgment_key(F.col("conv_id"), F.col("turn"))
    rows = _judged(spark, d).select(key.alias("key"), F.expr("conv_id % 5").alias("sample_id"), "question_type", "answer_f1", "hypothesis", "gold_answer")
    judged = rows.select("key", F.when(F.col("answer_f1") >= 0.5, "equivalent").otherwise("wrong").alias("label"))
    out = answers.rescored_summary(answers.rescored(rows, judged))
    return out.select("level", "value", "n", F.round("score", 6).alias("score"))


_CLAIMS = _PLAIN + """
, h AS (SELECT query_id, doc_id, score, source, lang = 'en' OR query_id % 3 <> 0 AS fits FROM sc JOIN documents USING (doc_id) WHERE score > 0),
sums AS (SELECT query_id, source, round(sum(score), 4) AS score FROM h GROUP BY 1, 2),
routed AS (SELECT query_id, source FROM sums QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source) <= 2),
i AS (SELECT h.*, r.source IS NOT NULL AS inside FROM h LEFT JOIN routed r ON r.query_id = h.query_id AND r.source = h.source)
"""
_R11 = _CLAIMS + """
, g AS (SELECT 'claim' AS policy, query_id, doc_id, score, true AS inside FROM i UNION ALL SELECT 'scope-claim', query_id, doc_id, score, inside FROM i UNION ALL SELECT 'scope-claim-time', query_id, doc_id, score, inside FROM i WHERE fits),
c AS (SELECT *, row_number() OVER (PARTITION BY policy, query_id ORDER BY score DESC, doc_id) AS b FROM g),
k AS (SELECT policy, query_id, doc_id, score, row_number() OVER (PARTITION BY policy, query_id ORDER BY score DESC, doc_id) AS r FROM c WHERE inside OR b <= 3),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM documents a JOIN documents b ON abs(a.doc_id - b.doc_id) = 1 AND a.source = b.source AND a.lang = b.lang),
s0 AS (SELECT query_id, doc_id FROM k WHERE policy = 'scope-claim-time' AND r <= 4),
s1 AS (SELECT * FROM s0 UNION SELECT query_id, y FROM s0 JOIN e ON x = doc_id),
s2 AS (SELECT * FROM s1 UNION SELECT query_id, y FROM s1 JOIN e ON x = doc_id),
z AS (SELECT policy, query_id, doc_id, r FROM k WHERE r <= 8 UNION ALL
  SELECT * FROM (SELECT 'scope-claim-time-state', query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM h JOIN s2 USING (query_id, doc_id)) WHERE r <= 8),
l AS (SELECT *, min(r) OVER (PARTITION BY policy, query_id, doc_id // 2) AS lead FROM z),
n AS (SELECT *, dense_rank() OVER (PARTITION BY policy, query_id ORDER BY lead) AS dr FROM l)
SELECT policy, query_id, doc_id AS claim_id, doc_id // 2 AS event_id, row_number() OVER (PARTITION BY policy, query_id ORDER BY r) AS rank FROM n WHERE dr <= 5
"""
_R12 = _CLAIMS + """
, g AS (SELECT 'event-rag' AS policy, query_id, doc_id, score, 0 AS more FROM i UNION ALL SELECT 'scope-event', query_id, doc_id, score, 0 FROM i WHERE inside
  UNION ALL SELECT 'scope-event-time', query_id, doc_id, score, CASE WHEN fits AND query_id % 3 = 0 THEN 0.25 ELSE 0 END FROM i WHERE inside),
t AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY policy, query_id ORDER BY score DESC, doc_id) <= 20),
k AS (SELECT policy, query_id, doc_id, row_number() OVER (PARTITION BY policy, query_id ORDER BY round(score + more, 6) DESC, doc_id) AS r FROM t QUALIFY r <= 5),
f AS (SELECT query_id, doc_id, r FROM k WHERE policy = 'scope-event-time'),
x AS (SELECT f.query_id, d.doc_id, min(f.r) AS r FROM f JOIN documents d ON d.doc_id = f.doc_id + 1 GROUP BY 1, 2),
a AS (SELECT query_id, doc_id, 0 AS late, r FROM f UNION ALL SELECT x.query_id, x.doc_id, 1, x.r FROM x ANTI JOIN f USING (query_id, doc_id))
SELECT policy, query_id, doc_id, r::INT AS rank FROM k UNION ALL SELECT * FROM (SELECT 'sts', query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY late, r, doc_id)::INT AS rank FROM a) WHERE rank <= 8
"""
_R6 = _CLAIMS + """
, n AS (SELECT item_id AS query_id, source, left(source, 1) AS key FROM benchmark JOIN documents ON doc_id = item_id),
u AS (SELECT n.query_id, n.source, coalesce(s.score, 0) AS score, 0 AS turn FROM n LEFT JOIN sums s ON s.query_id = n.query_id AND s.source = n.source
  UNION ALL SELECT query_id, source, score, 1 FROM sums s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.query_id = s.query_id AND n.key = left(s.source, 1)))
SELECT query_id, source AS scope_id, row_number() OVER (PARTITION BY query_id ORDER BY turn, score DESC, source) AS rank FROM u QUALIFY rank <= 3
"""
_J4 = """
WITH RECURSIVE e AS (SELECT event_id, user_id || ':' || event_type || ':' || strftime(ts, '%Y-%m-%d') AS state, event_type IN ('purchase', 'click') AS routed FROM events),
l AS (SELECT a.event_id AS x, b.event_id AS y FROM events a JOIN events b ON b.event_id = a.event_id - 1 AND a.event_id % 3 <> 0),
st AS (SELECT 'c' || x AS src, 'c' || y AS dst FROM l UNION ALL SELECT 'c' || y, 'c' || x FROM l UNION ALL SELECT 'c' || event_id, 's' || state FROM e WHERE routed UNION ALL SELECT 's' || state, 'c' || event_id FROM e),
r AS (SELECT user_id AS query_id, 'c' || event_id AS id FROM events WHERE value > 100 UNION SELECT r.query_id, st.dst FROM r JOIN st ON st.src = r.id)
SELECT query_id, CASE WHEN left(id, 1) = 'c' THEN 'claim' ELSE 'state' END AS kind, substr(id, 2) AS id FROM r
UNION ALL SELECT query_id, 'event', substr(id, 2) FROM r JOIN e ON id = 'c' || event_id WHERE routed
"""
QUERIES = {
    "r6_anchored_routing": (r6_anchored_routing, _R6),
    "r11_claim_policies": (r11_claim_policies, _R11),
    "r12_event_policies": (r12_event_policies, _R12),
    "e1_packing": (e1_packing, None),
    "j2_scope_coverage": (j2_scope_coverage, None),
    "j2_coverage_states": (j2_coverage_states, r"""
WITH w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS state_id FROM conversations WHERE turn < 3),
x AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY state_id) AS depth FROM w),
f AS (SELECT conv_id, state_id, min((depth, turn)) AS at_ FROM x GROUP BY 1, 2)
SELECT conv_id AS query_id, state_id, row_number() OVER (PARTITION BY conv_id ORDER BY at_, state_id)::INT AS place FROM f"""),
    "j4_scoped_expansion": (j4_scoped_expansion, _J4),
    "t13_ruled_sentences": (t13_ruled_sentences, None),
    "m17_judgment": (m17_judgment, None),
    "m20_judged_summary": (m20_judged_summary, None),
}
