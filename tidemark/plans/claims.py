"""Claim, state and answer queries over events, conversations and documents; wording that needs set words is built around their values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_tokens
from ..operators import answers as A
from ..operators import claims as C
from .common import table
from .evidence import _PREV, _STATES, _events, _states


def _by_type(**words: str):
    """A word for each type of event."""
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])[F.col("event_type")]


def _by_value(*steps: tuple[float, str], other: str):
    """A word by the first bound that the event's value lies under."""
    out = F.lit(other)
    for bound, word in reversed(steps):
        out = F.when(F.col("value") < bound, word).otherwise(out)
    return out


def _pick(n: int, *values: str):
    """One of the values by the event's number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % n + 1).cast("int"))


def c1_sentence_claims(spark, d) -> DataFrame:
    said = F.concat(F.lit("The "), "event_type", F.lit(" is now worth it. Nothing here.\nRisk of "), "event_type", F.lit(" is due. It has a deadline."))
    e = table(spark, d, "events").select("event_id", said.alias("text"), F.lit("speaker").alias("speaker"))
    return C.from_sentences(e, 2).select("event_id", "number", "subject", "facet", "role")


def c2_normalised(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    raw = e.select(
        F.col("user_id").alias("event_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("subject"), F.when(F.col("value") > 100, " ").otherwise("v").alias("value"),
        _pick(2, "Work", "zzz").alias("facet"), F.lit("due-at").alias("role"), _pick(3, "Unknown", "May 2024", "June 2024").alias("time"),
    )
    good, bad = C.normalised(raw, e.where(F.col("user_id") % 5 != 0).select(F.col("user_id").alias("event_id")), 5)
    return good.drop("number").withColumn("reason", F.lit(None).cast("string")).unionByName(bad).select("event_id", "ord", "facet", "role", "time", "reason")


def c6_lasting(spark, d) -> DataFrame:
    facet = _by_type(signup="work", click="travel", view="activity", purchase="health", error="status")
    role = _by_value((15, ""), (30, "updated_at"), (45, "deadline_at"), (60, "started_at"), (75, "occurred_at"), other="valid_from")
    said = F.concat(F.when(F.col("props").contains("1"), "formerly ").when(F.col("props").contains("2"), "used  to be, still, ").when(F.col("props").contains("3"), "Previously ").otherwise(""), F.col("event_type"))
    return table(spark, d, "events").select("event_id", C.lasting(facet, role, said).alias("lasting"))


def c7_dimension(spark, d) -> DataFrame:
    value = F.when(F.col("event_id") % 8 == 0, "lives here").otherwise(F.col("event_type"))
    topics = F.when(F.col("event_id") % 3 == 0, F.array("event_type")).when(F.col("event_id") % 3 == 1, F.array(F.col("event_type"), F.lit("more"))).otherwise(F.array(F.lit("Health")))
    owner, claim = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    return table(spark, d, "events").select("event_id", C.dimension(_pick(4, "place", "work", "health", "preference"), value, topics, owner, claim).alias("dimension"))


def c8_generic(spark, d) -> DataFrame:
    owner = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    target = F.concat(F.when(F.col("value") < 40, F.concat(F.initcap(owner), F.lit("'s "))).when(F.col("value") < 60, "User 1's ").otherwise(""), _by_type(signup="Condition", click="health", view="knee", purchase="Health!", error="bad condition"))
    return table(spark, d, "events").select("event_id", C.generic_target(target, F.lit("health"), F.lit("health"), owner).alias("generic"))


def f6_relations(spark, d) -> DataFrame:
    e = _events(spark, d).where("prev_id is not null").withColumn("type", _pick(4, " supersedes", "CONFLICTS_WITH", "MERGES", "CORRECTS"))
    raw = e.select("type", F.col("event_id").alias("src"), F.col("prev_id").alias("dst"))
    back = e.where(F.col("value") > 50).select("type", F.col("prev_id").alias("src"), F.col("event_id").alias("dst"))
    again = e.where(F.col("value") < 20).select(F.lit("CORRECTS").alias("type"), F.col("event_id").alias("src"), F.col("prev_id").alias("dst"))
    claims = table(spark, d, "events").where("event_type <> 'error'").select(F.col("event_id").alias("claim_id"), F.col("ts").alias("at"))
    good, bad = C.relations(raw.unionByName(back).unionByName(again), claims)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)


def j1_related(spark, d) -> DataFrame:
    e = _events(spark, d)
    keyed = F.col("event_type") != "error"
    claims = e.select(F.col("event_id").alias("claim_id"), F.when(keyed, F.col("user_id")).alias("subject"), F.when(keyed, F.col("event_type")).alias("dimension"))
    seeds = e.where("value > 100").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("claim_id"), F.lit(1.0).alias("relevance"))
    out = C.expand_related(seeds, e.where("prev_id is not null").select(F.col("event_id").alias("src"), F.col("prev_id").alias("dst")), claims, 2)
    return out.withColumn("priority", F.round(C.state_priority(F.lit(1), F.col("relevance"), F.col("hop")), 6)).select("query_id", "claim_id", "hop", "priority")


def j10_anchored(spark, d) -> DataFrame:
    e = table(spark, d, "events").withColumn("state_id", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    hits = e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("claim_id"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("rank"))
    return C.anchored_states(hits, e.select("state_id", F.col("event_id").alias("claim_id")), 5)


def r13_states(spark, d) -> DataFrame:
    e = table(spark, d, "events").withColumn("state_id", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    hits = e.groupBy(F.col("user_id").alias("query_id"), "state_id").agg(F.max("value").alias("score"))
    states = e.groupBy("state_id", (F.col("user_id") % 10).alias("scope_id")).agg((F.count(F.lit(1)) / 4).alias("validity"))
    scopes = e.select(F.col("user_id").alias("query_id"), F.when(F.col("user_id") % 2 == 0, F.col("user_id") % 10).otherwise(-1).alias("scope_id"))
    return C.select_states(hits, states, scopes, 3).select("query_id", "state_id", F.round("score", 6).alias("score"), "rank")


def g3_state_edges(spark, d) -> DataFrame:
    s = _states(spark, d)
    at = table(spark, d, "events").select(F.col("event_id").alias("primary_claim"), F.col("ts").alias("at"))
    support = s.select("state_id", F.explode(F.array_distinct(F.array("first_claim", "primary_claim"))).alias("claim_id"))
    return C.state_graph(s.join(at, "primary_claim").select("state_id", "owner", "primary_claim", "status", "at"), support)[1]


def t6_time_roles(spark, d) -> DataFrame:
    role = _by_type(signup=" Deadline", click="start-at", view="plan for", purchase="planned_for", error="odd")
    time = _by_value((20, "last week"), (40, "Two days AGO"), (60, "n/a"), other="May 2024")
    return table(spark, d, "events").select("event_id", C.time_role(role, time).alias("role"))


def t9_participants(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", A.participant_key(F.concat(F.initcap("role"), F.lit("'s Turn "), F.col("turn").cast("string"))).alias("key"))


def t20_abstains(spark, d) -> DataFrame:
    said = F.concat_ws(" ", "event_type", _by_value((10, "I don't know"), (25, "is unclear"), (40, "unclear building"), (55, "<think>no data</think>"), (70, "No  such events"), other="was seen"), F.when(F.col("props").contains("7"), "by nothing"))
    return table(spark, d, "events").select("event_id", A.abstains(said).alias("abstains"))


def e3_frames(spark, d) -> DataFrame:
    raw = F.concat(F.lit('{"operation":"'), _pick(3, "Count", "lookup", "guess"), F.lit('","count_unit":"'), _pick(4, "visits", "people", "kg", "none"), F.lit('","entities":["'), "event_type", F.lit('"," '), "event_type", F.lit(' ",""],"required_bindings":[{"subject":" s ","relation":"Lives In"},{}]}'))
    f = A.frame(F.from_json(raw, "operation string, count_unit string, requested_slot string, entities array<string>, required_bindings array<struct<subject: string, relation: string, object: string>>"))
    return table(spark, d, "events").select("event_id", f.alias("f")).select("event_id", "f.operation", "f.count_unit", "f.requested_slot", F.array_join("f.entities", "|").alias("entities"), F.array_join(F.transform("f.required_bindings", lambda b: F.concat_ws(" ", b["subject"], b["relation"])), "|").alias("bindings"))


def e5_compiled(spark, d) -> DataFrame:
    counted = F.array(F.concat(F.lit("D1:"), F.col("event_id").cast("string")), F.concat(F.lit("D1:"), F.col("prev_id").cast("string")), F.concat(F.lit("D1:"), F.col("event_id").cast("string")))
    said = A.compiled(_pick(4, "lookup", "count", "enumerate", "boolean"), F.lit("occurrences"), _pick(3, "type", "Answer", "value"), F.lit(" yes "), F.array("event_type", "prev_type"), counted)
    return _events(spark, d).where("prev_id is not null").select("event_id", said.alias("answer"))


def e6_citations(spark, d) -> DataFrame:
    """Each turn cites itself, its role, the first turn of its dialogue (twice) and nothing; the first two turns may be cited."""
    at = lambda turn: F.concat(F.lit("D"), F.col("conv_id"), F.lit(":"), turn)
    cited = F.array(at(F.col("turn")), F.col("role"), at(F.lit(0)), F.concat(F.lit(" "), at(F.lit(0))), F.lit(""))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(A.citations(cited, F.array(at(F.lit(0)), at(F.lit(1)))), ",").alias("cited"))


def d7_wanted_roles(spark, d) -> DataFrame:
    asked = F.concat(F.lit("When did they "), "event_type", _by_value((20, " recently?"), (40, ", and was it Completed lately?"), (60, "; has it finished?"), other=" unfinished things?"), F.when(F.col("props").contains("5"), " The latest.").otherwise(""))
    w = A.wanted_roles(asked)
    return table(spark, d, "events").select("event_id", F.array_join(w["kept"], ",").alias("roles"), w["newest_first"].alias("newest_first"))


def r8_content_match(spark, d) -> DataFrame:
    """A turn's words asked of the turn before."""
    t = table(spark, d, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return t.select("conv_id", "turn", F.round(A.content_match(plain_tokens(F.col("text")), plain_tokens(F.col("before")), ("the", "and"), ((("of",), ("in",), 14.0, 10.0),)), 6).alias("score"))


def r26_cue_slots(spark, d) -> DataFrame:
    pairs = A.cue_slots(F.lit("(t, *, e, *)"), F.concat(F.lit("{"), F.date_format("ts", "yyyy-MM-dd"), F.lit("} and { "), "event_type", F.lit(" }")))
    return table(spark, d, "events").select("event_id", F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["slot"], p["value"])), "|").alias("channels"))


def m5_category_score(spark, d) -> DataFrame:
    said = F.when(F.col("event_type") == "error", "not mentioned").otherwise(F.col("prev_type"))
    return _events(spark, d).where("prev_id is not null").select("event_id", F.round(A.category_score(F.col("event_id") % 6, said, F.concat("event_type", F.lit("; more"))), 6).alias("score"))


def m10_merged(spark, d) -> DataFrame:
    e = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("batch"), F.col("event_type").alias("type"))
    return A.merged_results(e.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") > 50).alias("correct")))


def m15_stratified(spark, d) -> DataFrame:
    return A.stratified(table(spark, d, "documents"), "lang", "doc_id", {"en": 40, "de": 20, "fr": 10}).select("doc_id", "lang")


def m19_compared(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("q_idx"), "event_type", "value")
    gold = e.groupBy("q_idx").agg(F.collect_set("event_type").alias("items")).withColumn("retrieval_type", F.when(F.col("q_idx") % 2 == 0, "Entities").otherwise("Times"))
    return A.compared(e.where("value > 60").groupBy("q_idx").agg(F.collect_set("event_type").alias("items")), gold, {"Entities": "entities", "Times": "date"})


#: What a target about health may say without telling which.
_GENERIC = ", ".join(f"'{x}'" for x in ("health", *C.GENERIC["health"]))
_WORDS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+'))"
QUERIES = {
    "c1_sentence_claims": (c1_sentence_claims, "SELECT event_id, 1 AS number, 'The ' || event_type AS subject, 'status' AS facet, 'updated_at' AS role FROM events UNION ALL SELECT event_id, 2, 'Risk of ' || event_type, 'risk', 'mentioned_at' FROM events"),
    "c2_normalised": (c2_normalised, """
WITH r AS (SELECT user_id, event_id AS ord, CASE WHEN user_id % 5 = 0 THEN 'unknown_event' WHEN value > 100 THEN 'no_value' END AS reason FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, reason IS NULL ORDER BY ord) AS k FROM r)
SELECT user_id AS event_id, ord, CASE WHEN ord % 2 = 0 THEN 'work' ELSE 'other' END AS facet, CASE WHEN ord % 3 = 0 THEN '' ELSE 'deadline_at' END AS role, ['', 'May 2024', 'June 2024'][ord % 3 + 1] AS time, coalesce(reason, CASE WHEN k > 5 THEN 'limit' END) AS reason FROM n"""),
    "c6_lasting": (c6_lasting, r"""
WITH x AS (
  SELECT event_id, CASE event_type WHEN 'signup' THEN 'work' WHEN 'click' THEN 'travel' WHEN 'view' THEN 'activity' WHEN 'purchase' THEN 'health' ELSE 'status' END AS facet,
    CASE WHEN value < 15 THEN '' WHEN value < 30 THEN 'updated_at' WHEN value < 45 THEN 'deadline_at' WHEN value < 60 THEN 'started_at' WHEN value < 75 THEN 'occurred_at' ELSE 'valid_from' END AS role,
    CASE WHEN contains(props, '1') THEN 'formerly ' WHEN contains(props, '2') THEN 'used  to be, still, ' WHEN contains(props, '3') THEN 'Previously ' ELSE '' END || event_type AS said FROM events
)
SELECT event_id, role NOT IN ('completed_at', 'deadline_at', 'finalized_at', 'occurred_at', 'planned_for') AND NOT (regexp_matches(said, '(?i)\b(formerly|previously|used\s+to)\b') AND NOT regexp_matches(said, '(?i)\b(currently|no\s+longer|now|still)\b'))
  AND (facet IN ('education', 'family', 'health', 'identity', 'location', 'occupation', 'place', 'possession', 'preference', 'relationship', 'status', 'work') OR facet = 'activity' AND role IN ('started_at', 'updated_at', 'valid_from')) AS lasting FROM x"""),
    "c7_dimension": (c7_dimension, """
WITH x AS (SELECT event_id, event_type, event_id % 3 AS t, CASE WHEN event_id % 8 = 0 THEN 'location' ELSE ['place', 'occupation', 'health', 'preference'][event_id % 4 + 1] END AS dom FROM events)
SELECT event_id, dom || ':' || CASE WHEN dom = 'location' THEN 'residence' WHEN dom = 'occupation' THEN 'primary' WHEN t = 0 THEN event_type WHEN t = 2 AND dom <> 'health' THEN 'health' ELSE 'claim_local_' || event_type || '_' || substr(sha1(event_id::VARCHAR), 1, 8) END AS dimension FROM x"""),
    "c8_generic": (c8_generic, rf"""
WITH x AS (
  SELECT event_id, 'user_' || user_id AS o, trim(regexp_replace(lower(CASE WHEN value < 40 THEN 'User ' || user_id || chr(39) || 's ' WHEN value < 60 THEN 'User 1' || chr(39) || 's ' ELSE '' END
    || CASE event_type WHEN 'signup' THEN 'Condition' WHEN 'click' THEN 'health' WHEN 'view' THEN 'knee' WHEN 'purchase' THEN 'Health!' ELSE 'bad condition' END), '[^a-z0-9]+', '_', 'g'), '_') AS t FROM events
),
w AS (SELECT event_id, t, CASE WHEN starts_with(t, o || '_s_') THEN substr(t, length(o) + 4) WHEN starts_with(t, o || '_') THEN substr(t, length(o) + 2) ELSE t END AS u FROM x)
SELECT event_id, t IN ({_GENERIC}) OR u IN ({_GENERIC}) AS generic FROM w"""),
    "f6_relations": (f6_relations, f"""
WITH {_PREV}, t AS (SELECT *, ['SUPERSEDES', 'CONFLICTS_WITH', 'MERGES', 'CORRECTS'][event_id % 4 + 1] AS type FROM e WHERE prev_id IS NOT NULL), r AS (SELECT type, event_id AS src, prev_id AS dst FROM t UNION ALL SELECT type, prev_id, event_id FROM t WHERE value > 50 UNION ALL SELECT 'CORRECTS', event_id, prev_id FROM t WHERE value < 20),
k AS (SELECT event_id, ts FROM events WHERE event_type <> 'error'), j AS (SELECT DISTINCT type, CASE WHEN type = 'CONFLICTS_WITH' THEN least(src, dst) ELSE src END AS src, CASE WHEN type = 'CONFLICTS_WITH' THEN greatest(src, dst) ELSE dst END AS dst, CASE WHEN type = 'MERGES' THEN 'unknown_type' WHEN a.ts IS NULL OR b.ts IS NULL THEN 'unknown_end' WHEN type <> 'CONFLICTS_WITH' AND a.ts < b.ts THEN 'reversed' END AS reason FROM r LEFT JOIN k a ON a.event_id = src LEFT JOIN k b ON b.event_id = dst)
SELECT type, src, dst, coalesce(reason, CASE WHEN min(type) OVER w <> max(type) OVER w THEN 'mixed_types' END) AS reason FROM j WINDOW w AS (PARTITION BY reason, least(src, dst), greatest(src, dst))"""),
    "j1_related": (j1_related, f"""
WITH {_PREV}, p AS (SELECT event_id AS a, prev_id AS b FROM e WHERE prev_id IS NOT NULL AND event_type = prev_type), o AS (SELECT a, b FROM p UNION SELECT b, a FROM p), h0 AS (SELECT user_id AS q, event_id AS c FROM events WHERE value > 100), h1 AS (SELECT DISTINCT q, b AS c FROM h0 JOIN o ON a = c EXCEPT SELECT * FROM h0),
h2 AS (SELECT DISTINCT q, b AS c FROM h1 JOIN o ON a = c EXCEPT SELECT * FROM h0 EXCEPT SELECT * FROM h1) SELECT q AS query_id, c AS claim_id, 0 AS hop, 1.75::DOUBLE AS priority FROM h0 UNION ALL SELECT q, c, 1, 1.275 FROM h1 UNION ALL SELECT q, c, 2, 0.8675 FROM h2"""),
    "j10_anchored": (j10_anchored, "WITH h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) SELECT user_id AS query_id, user_id || ':' || event_type AS state_id, min(r)::INT AS rank FROM h WHERE r <= 5 GROUP BY 1, 2"),
    "r13_states": (r13_states, "SELECT user_id AS query_id, user_id || ':' || event_type AS state_id, round(max(value) + count(*) / 4, 6) AS score, (row_number() OVER (PARTITION BY user_id ORDER BY max(value) + count(*) / 4 DESC, user_id || ':' || event_type))::INT AS rank FROM events WHERE user_id % 2 = 0 GROUP BY user_id, event_type QUALIFY rank <= 3"),
    "g3_state_edges": (g3_state_edges, _STATES + """, sx AS (SELECT t.*, e.ts AS seen FROM t JOIN events e ON e.event_id = primary_claim)
SELECT 'SUPPORTS' AS type, 'claim::' || first_claim AS src, 'state::' || state_id AS dst FROM sx UNION SELECT 'SUPPORTS', 'claim::' || primary_claim, 'state::' || state_id FROM sx
UNION SELECT 'CURRENT_AFTER', 'state::' || state_id, 'time::' || strftime(seen, '%Y-%m-%d') FROM sx WHERE status = 'current' UNION SELECT 'CURRENT_STATE_OF', 'state::' || state_id, 'subject::' || owner FROM sx WHERE status = 'current'"""),
    "t6_time_roles": (t6_time_roles, r"""
WITH x AS (
  SELECT event_id, trim(regexp_replace(lower(CASE event_type WHEN 'signup' THEN ' Deadline' WHEN 'click' THEN 'start-at' WHEN 'view' THEN 'plan for' WHEN 'purchase' THEN 'planned_for' ELSE 'odd' END), '[^a-z0-9]+', '_', 'g'), '_') AS k,
    CASE WHEN value < 20 THEN 'last week' WHEN value < 40 THEN 'Two days AGO' WHEN value < 60 THEN '' ELSE 'May 2024' END AS t FROM events
),
n AS (SELECT event_id, t, CASE k WHEN 'deadline' THEN 'deadline_at' WHEN 'start_at' THEN 'started_at' WHEN 'plan_for' THEN 'planned_for' ELSE k END AS k FROM x)
SELECT event_id, CASE WHEN k NOT IN ('deadline_at', 'started_at', 'planned_for') THEN '' WHEN k = 'planned_for' AND regexp_matches(t, '(?i)\b(ago|earlier|yesterday|last\s+(day|night|week|month|year))\b') THEN 'occurred_at' ELSE k END AS role FROM n"""),
    "t9_participants": (t9_participants, "SELECT conv_id, turn, lower(role) || ' turn ' || turn AS key FROM conversations"),
    "t20_abstains": (t20_abstains, r"""
WITH x AS (
  SELECT event_id, lower(trim(regexp_replace(event_type || ' ' || CASE WHEN value < 10 THEN 'I don' || chr(39) || 't know' WHEN value < 25 THEN 'is unclear' WHEN value < 40 THEN 'unclear building' WHEN value < 55 THEN '<think>no data</think>' WHEN value < 70 THEN 'No  such events' ELSE 'was seen' END
    || CASE WHEN contains(props, '7') THEN ' by nothing' ELSE '' END, '(?s)<think>.*?</think>', '', 'g'))) AS t FROM events
),
w AS (SELECT *, regexp_split_to_array(t, '\s+') AS w FROM x)
SELECT event_id, regexp_matches(t, 'i don.?t know|no such (events?|information|data)|no (relevant )?(events?|data|details|information)')
  OR len(w) <= 15 AND list_has_any(w, ['unknown', 'unclear', 'uncertain', 'unsure', 'no', 'none', 'nothing']) AND NOT list_has_any(w, ['located', 'place', 'area', 'building', 'room', 'street', 'city', 'country']) AS abstains FROM w"""),
    "e3_frames": (e3_frames, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'count' ELSE 'lookup' END AS operation, CASE WHEN event_id % 3 = 0 THEN ['occurrences', 'entities', 'stated_number', 'none'][event_id % 4 + 1] ELSE 'none' END AS count_unit, 'answer' AS requested_slot, event_type AS entities, 's lives_in' AS bindings FROM events"),
    "e5_compiled": (e5_compiled, f"WITH {_PREV} SELECT event_id, CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'yes' END WHEN 1 THEN '2' WHEN 2 THEN event_type || CASE WHEN prev_type <> event_type THEN ', ' || prev_type ELSE '' END ELSE 'yes' END AS answer FROM e WHERE prev_id IS NOT NULL"),
    "e6_citations": (e6_citations, r"""
WITH x AS (SELECT conv_id, turn, ['D' || conv_id || ':' || turn, role, 'D' || conv_id || ':0', ' D' || conv_id || ':0', ''] AS c FROM conversations),
y AS (SELECT conv_id, turn, trim(unnest(c)) AS x, generate_subscripts(c, 1) AS p FROM x),
z AS (SELECT conv_id, turn, x, min(p) AS p FROM y WHERE regexp_full_match(x, 'D[0-9]+:[0-9]+') AND x IN ('D' || conv_id || ':0', 'D' || conv_id || ':1') GROUP BY ALL)
SELECT conv_id, turn, string_agg(x, ',' ORDER BY p) AS cited FROM z GROUP BY 1, 2"""),
    "d7_wanted_roles": (d7_wanted_roles, r"""
WITH x AS (SELECT event_id, 'When did they ' || event_type || CASE WHEN value < 20 THEN ' recently?' WHEN value < 40 THEN ', and was it Completed lately?' WHEN value < 60 THEN '; has it finished?' ELSE ' unfinished things?' END || CASE WHEN contains(props, '5') THEN ' The latest.' ELSE '' END AS q FROM events),
w AS (SELECT event_id, regexp_matches(q, '(?i)\b(recently|lately|recent|latest)\b') AS recent, regexp_matches(q, '(?i)\b(completed|finished)\b') AS done FROM x)
SELECT event_id, array_to_string(list_concat(CASE WHEN recent THEN ['occurred_at', 'started_at', 'updated_at'] ELSE [] END, CASE WHEN done THEN ['completed_at'] ELSE [] END)[1:2], ',') AS roles, recent AS newest_first FROM w"""),
    "r8_content_match": (r8_content_match, f"""
WITH t AS (SELECT conv_id, turn, {_WORDS.format('text')} AS q, {_WORDS.format('lag(text) OVER (PARTITION BY conv_id ORDER BY turn)')} AS d FROM conversations), h AS (SELECT *, list_filter(q, lambda x: list_contains(d, x)) AS h FROM t)
SELECT conv_id, turn, round(CASE WHEN len(q) = 0 THEN 0 ELSE 2 * len(h) + 10 * len(h) / len(q) - CASE WHEN len(h) / len(q) < 0.2 THEN 8 ELSE 0 END + 3 * len(list_filter(h, lambda x: x IN ('the', 'and'))) + CASE WHEN list_contains(q, 'of') THEN CASE WHEN list_contains(d, 'in') THEN 14 ELSE -10 END ELSE 0 END END, 6)::DOUBLE AS score FROM h"""),
    "r26_cue_slots": (r26_cue_slots, "SELECT event_id, 't=' || strftime(ts, '%Y-%m-%d') || '|e=' || event_type AS channels FROM events"),
    "m5_category_score": (m5_category_score, f"WITH {_PREV} SELECT event_id, CASE event_id % 6 WHEN 5 THEN (event_type = 'error')::INT::DOUBLE WHEN 0 THEN NULL ELSE CASE WHEN event_type <> 'error' AND event_type = prev_type THEN CASE WHEN event_id % 6 = 3 THEN 1.0::DOUBLE ELSE round(2.0::DOUBLE / 3, 6) END ELSE 0.0::DOUBLE END END AS score FROM e WHERE prev_id IS NOT NULL"),
    "m10_merged": (m10_merged, "SELECT event_type AS type, count(*) AS total, count(*) FILTER (value > 50) AS correct, count(DISTINCT user_id % 10) AS batches, round(count(*) FILTER (value > 50) / count(*), 4) AS accuracy FROM events GROUP BY GROUPING SETS ((event_type), ())"),
    "m15_stratified": (m15_stratified, "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de', 'fr') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':42'), doc_id) <= CASE lang WHEN 'en' THEN 40 WHEN 'de' THEN 20 ELSE 10 END"),
    "m19_compared": (m19_compared, "WITH x AS (SELECT user_id AS q_idx, count(DISTINCT event_type)::INT AS n_gold, (count(DISTINCT event_type) FILTER (value > 60))::INT AS n_got FROM events GROUP BY 1) SELECT q_idx, CASE WHEN q_idx % 2 = 0 THEN 'entities' ELSE 'date' END AS field, n_got, n_gold, round(2 * n_got / (n_got + n_gold), 6) AS f1 FROM x"),
}
