"""Validation of a state graph that Spark derives from `events`: sign-ups as places a user lives, one after another, and
purchases as what a user owns; faults come where values of the table ask for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import validation
from ..operators.lineage import cut
from .common import table


def _claims(spark, d) -> DataFrame:
    e = table(spark, d, "events").where("event_type in ('signup', 'purchase', 'view')")
    day, user, v = F.date_format("ts", "yyyy-MM-dd"), F.concat(F.lit("u"), F.col("user_id")), F.col("value")
    home = F.col("event_type") == "signup"
    lasts = F.col("event_type") != "view"
    dom = F.when(home, "location").when(lasts, "possession")
    target = F.when(home, "residence").when(lasts, F.concat(F.lit("item_"), F.floor(v / 100)))
    state = F.when(home, F.concat(F.lit("h"), F.col("event_id"))).when(lasts, F.concat_ws("_", F.lit("o"), "user_id", F.floor(v / 100)))
    return e.select(
        F.concat(F.lit("c"), F.col("event_id")).alias("id"), F.concat(F.lit("e"), F.col("event_id")).alias("event"), user.alias("scope"), day.alias("day"), "event_id", "ts", v, state.alias("state"), home.alias("home"),
        F.when(home, "location").when(lasts, "possession").otherwise("plan").alias("facet_key"), F.concat(F.lit("D"), F.day("ts"), F.lit(":"), F.col("event_id")).alias("dialog_id"),
        F.when(v >= 100, "started_at").alias("time_role"), F.when((v >= 100) & (v < 150), day).alias("time_value"),
        F.when(lasts, F.col("user_id").cast("string")).alias("canonical_subject"), F.when(lasts, user).alias("subject_key"), dom.alias("state_domain"), F.when(home, "single").when(lasts, "object_scoped").alias("slot_type"),
        target.alias("state_target"), F.concat_ws(":", F.when(v >= 300, "old").otherwise(dom), target).alias("state_dimension"), F.when(lasts & (v >= 1), "facet").alias("dimension_source"), F.when(lasts, "rule").alias("dimension_reason"),
    )


def event_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as `validation.graph_problems` reads them."""
    claims = cut(_claims(spark, d))
    identity = list(validation.IDENTITY)
    along = Window.partitionBy("scope").orderBy("ts", "event_id")
    homes = cut(claims.where("home").withColumns({"next": F.lead("id").over(along), "next_event": F.lead("event").over(along), "next_value": F.lead("value").over(along)}))
    one = homes.select(F.col("state").alias("id"), F.when(F.col("value") >= 200, "ambiguous").when(F.col("next").isNotNull(), "historical").otherwise("current").alias("status"), F.array("id").alias("support_claim_ids"), F.array("event").alias("support_event_ids"), F.col("id").alias("primary_claim_id"), F.col("day").alias("current_after"), F.array("scope").alias("scope_ids"), F.col("canonical_subject").alias("subject"), F.col("value").cast("string").alias("value"), *identity)
    last = F.struct("ts", "event_id")
    many = claims.where("not home and state is not null").groupBy(F.col("state").alias("id")).agg(
        F.lit("current").alias("status"), F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "id"))), lambda x: x["id"]).alias("support_claim_ids"), F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event"))), lambda x: x["event"]).alias("support_event_ids"),
        F.max_by("id", last).alias("primary_claim_id"), F.max_by("day", last).alias("current_after"), F.array(F.max("scope")).alias("scope_ids"), F.max_by("canonical_subject", last).alias("subject"), F.max_by(F.col("value").cast("string"), last).alias("value"), *[F.max_by(c, last).alias(c) for c in identity],
    )
    states = cut(one.unionByName(many)).withColumns({"node_type": F.lit("state"), "node_id": F.col("id"), "fact_type": F.lit("state"), "temporal_status": F.lit("ongoing"), "intent": F.lit("none")})
    events = table(spark, d, "events")
    kind = lambda df, name: df.withColumns({"node_type": F.lit(name), "node_id": F.col("id")})
    days = events.select(F.date_format("ts", "yyyy-MM-dd").alias("value")).distinct()
    nodes = kind(claims.withColumnRenamed("event", "source_event_id").select("id", "source_event_id", "facet_key", "dialog_id", "time_role", "time_value", F.col("value").cast("string").alias("value"), *identity), "claim")
    for more in (
        states, kind(events.select(F.concat(F.lit("e"), F.col("event_id")).alias("id")), "event"), kind(events.where("user_id <> 7").select(F.concat(F.lit("u"), F.col("user_id")).alias("id")).distinct(), "scope"),
        kind(days.select(F.concat(F.lit("d"), "value").alias("id"), "value", F.lit("started_at").alias("time_role")), "time"), kind(days.select(F.concat(F.lit("a"), "value").alias("id"), "value", F.lit("current_after").alias("time_role")), "time"),
    ):
        nodes = nodes.unionByName(more, allowMissingColumns=True)
    drawn = lambda df, t, a, b, **more: df.select(F.lit(t).alias("type"), a.alias("src"), b.alias("dst"), *[x.alias(c) for c, x in more.items()])
    held = claims.where("state is not null")
    edges = drawn(held, "ASSERTS", F.col("event"), F.col("id"))
    for more in (
        drawn(events, "IN_SCOPE", F.concat(F.lit("e"), F.col("event_id")), F.concat(F.lit("u"), F.col("user_id"))),
        drawn(claims.where("value >= 100"), "HAS_TIME", F.col("id"), F.concat(F.lit("d"), "day"), time_role=F.when(F.col("value") < 110, "updated_at").otherwise("started_at")),
        drawn(homes.where("next is not null"), "SUPERSEDES", F.col("next"), F.col("id"), reason=F.when(F.col("value") >= 5, "moved"), evidence_event_ids=F.when(F.col("next_value") >= 10, F.array("next_event")).when(F.col("next_value") >= 5, F.array(F.lit("e0")))),
        drawn(homes.where("next is not null and value >= 250"), "CONFLICTS_WITH", F.col("next"), F.col("id"), reason=F.lit("both"), evidence_event_ids=F.array("event")),
        drawn(held.where("value < 20 or value >= 21"), "SUPPORTS", F.col("id"), F.col("state")),
        drawn(claims.where("state is null and value >= 250"), "SUPPORTS", F.col("id"), F.lit("o_1_0")),
        drawn(states, "CURRENT_AFTER", F.col("id"), F.concat(F.when(F.col("value").cast("double") < 2, "d").otherwise("a"), "current_after")),
        drawn(states.where("id not like 'h%7'"), "CURRENT_STATE_OF", F.col("id"), F.get("scope_ids", F.lit(0))),
    ):
        edges = edges.unionByName(more, allowMissingColumns=True)
    return nodes, edges


def g6_graph_rules(spark, d) -> DataFrame:
    return validation.graph_problems(*event_graph(spark, d))


_FIELDS = ("canonical_subject", "subject_key", "state_domain", "slot_type", "state_target", "state_dimension", "dimension_source", "dimension_reason")
_NONE = ", ".join(f"NULL::VARCHAR AS {c}" for c in _FIELDS)
_GRAPH = rf"""
claims AS (
  SELECT 'c' || event_id AS id, 'e' || event_id AS event, 'u' || user_id AS scope, strftime(ts, '%Y-%m-%d') AS day, event_id, ts, value AS v, event_type = 'signup' AS home, event_type <> 'view' AS lasts,
    CASE event_type WHEN 'signup' THEN 'h' || event_id WHEN 'purchase' THEN 'o_' || user_id || '_' || floor(value / 100)::INT END AS state,
    CASE event_type WHEN 'signup' THEN 'location' WHEN 'purchase' THEN 'possession' ELSE 'plan' END AS facet_key, 'D' || day(ts) || ':' || event_id AS dialog_id,
    CASE WHEN value >= 100 THEN 'started_at' END AS time_role, CASE WHEN value >= 100 AND value < 150 THEN strftime(ts, '%Y-%m-%d') END AS time_value,
    CASE WHEN event_type <> 'view' THEN user_id::VARCHAR END AS canonical_subject, CASE WHEN event_type <> 'view' THEN 'u' || user_id END AS subject_key,
    CASE event_type WHEN 'signup' THEN 'location' WHEN 'purchase' THEN 'possession' END AS state_domain, CASE event_type WHEN 'signup' THEN 'single' WHEN 'purchase' THEN 'object_scoped' END AS slot_type,
    CASE event_type WHEN 'signup' THEN 'residence' WHEN 'purchase' THEN 'item_' || floor(value / 100)::INT END AS state_target,
    concat_ws(':', CASE WHEN value >= 300 THEN 'old' WHEN event_type = 'signup' THEN 'location' WHEN event_type = 'purchase' THEN 'possession' END, CASE event_type WHEN 'signup' THEN 'residence' WHEN 'purchase' THEN 'item_' || floor(value / 100)::INT END) AS state_dimension,
    CASE WHEN event_type <> 'view' AND value >= 1 THEN 'facet' END AS dimension_source, CASE WHEN event_type <> 'view' THEN 'rule' END AS dimension_reason
  FROM events WHERE event_type IN ('signup', 'purchase', 'view')
),
homes AS (SELECT *, lead(id) OVER w AS next, lead(event) OVER w AS next_event, lead(v) OVER w AS next_v FROM claims WHERE home WINDOW w AS (PARTITION BY scope ORDER BY ts, event_id)),
states AS (
  SELECT state AS id, CASE WHEN v >= 200 THEN 'ambiguous' WHEN next IS NOT NULL THEN 'historical' ELSE 'current' END AS status, [id] AS cs, [event] AS es, id AS pc, day AS ca, scope, {", ".join(_FIELDS)}, v FROM homes
  UNION ALL SELECT state, 'current', list(id ORDER BY ts, event_id), list(event ORDER BY ts, event_id), last(id ORDER BY ts, event_id), last(day ORDER BY ts, event_id), max(scope), {", ".join(f"last({c} ORDER BY ts, event_id)" for c in _FIELDS)}, last(v ORDER BY ts, event_id)
    FROM claims WHERE NOT home AND state IS NOT NULL GROUP BY state
),
days AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events),
kinds AS (
  SELECT id, 'claim' AS k FROM claims UNION ALL SELECT id, 'state' FROM states UNION ALL SELECT 'e' || event_id, 'event' FROM events UNION ALL SELECT DISTINCT 'u' || user_id, 'scope' FROM events WHERE user_id <> 7
  UNION ALL SELECT 'd' || day, 'time' FROM days UNION ALL SELECT 'a' || day, 'time' FROM days
),
supports AS (SELECT id AS c, state AS s FROM claims WHERE state IS NOT NULL AND (v < 20 OR v >= 21) UNION SELECT id, 'o_1_0' FROM claims WHERE state IS NULL AND v >= 250),
listed AS (SELECT id AS s, unnest(cs) AS c FROM states),
good AS (SELECT * FROM supports INTERSECT SELECT c, s FROM listed),
after AS (SELECT id, CASE WHEN v < 2 THEN 'd' ELSE 'a' END || ca AS t FROM states),
rels AS (
  SELECT 'SUPERSEDES' AS t, next AS a, id AS b, CASE WHEN v >= 5 THEN 'moved' END AS reason, CASE WHEN next_v >= 10 THEN [next_event] WHEN next_v >= 5 THEN ['e0'] ELSE [] END AS ev FROM homes WHERE next IS NOT NULL
  UNION ALL SELECT 'CONFLICTS_WITH', next, id, 'both', [event] FROM homes WHERE next IS NOT NULL AND v >= 250
),
ends AS (
  SELECT 'ASSERTS' AS t, event AS a, id AS b, 'event->claim' AS due FROM claims WHERE state IS NOT NULL UNION ALL SELECT 'IN_SCOPE', 'e' || event_id, 'u' || user_id, 'event->scope' FROM events
  UNION ALL SELECT 'HAS_TIME', id, 'd' || day, 'claim->time' FROM claims WHERE v >= 100 UNION ALL SELECT t, a, b, 'claim->claim' FROM rels UNION ALL SELECT 'SUPPORTS', c, s, 'claim->state' FROM supports
  UNION ALL SELECT 'CURRENT_AFTER', id, t, 'state->time' FROM after UNION ALL SELECT 'CURRENT_STATE_OF', id, scope, 'state->scope' FROM states WHERE id NOT LIKE 'h%7'
),
past AS (SELECT DISTINCT s FROM rels JOIN good ON c = b WHERE t = 'SUPERSEDES'),
facing AS (SELECT x.s AS p, y.s AS q, r.a, r.b FROM rels r JOIN good x ON x.c = r.a JOIN good y ON y.c = r.b WHERE r.t = 'CONFLICTS_WITH'),
open_ AS (SELECT unnest([p, q]) AS s FROM facing WHERE p <> q AND p NOT IN (FROM past) AND q NOT IN (FROM past)),
due AS (SELECT s.*, CASE WHEN id IN (FROM past) THEN 'historical' WHEN id IN (FROM open_) THEN 'ambiguous' ELSE 'current' END AS due FROM states s),
met AS (SELECT l.s, l.c, x AS st, y AS cl FROM listed l JOIN states x ON x.id = l.s JOIN claims y ON y.id = l.c),
prim AS (SELECT x AS st, y AS cl FROM states x JOIN claims y ON y.id = x.pc)
"""
_EACH = lambda what, alias: ", ".join(what.format(c=c, a=alias) for c in _FIELDS)
_RULES = rf"""
SELECT 'claim_time_value_missing' AS rule, id, time_role AS detail FROM claims WHERE time_role IS NOT NULL AND time_value IS NULL
UNION SELECT 'claim_state_field_missing', id, unnest(list_filter([{_EACH("CASE WHEN coalesce(trim({c}), '') = '' THEN '{c}' END", "")}], lambda x: x IS NOT NULL)) FROM claims WHERE lasts
UNION SELECT 'claim_state_dimension_mismatch', id, state_dimension FROM claims WHERE lasts AND state_dimension <> state_domain || ':' || state_target
UNION SELECT 'state_identity_field_missing', id, unnest(list_filter([{_EACH("CASE WHEN coalesce(trim({c}), '') = '' THEN '{c}' END", "")}], lambda x: x IS NOT NULL)) FROM states
UNION SELECT 'state_dimension_mismatch', id, state_dimension FROM states WHERE state_dimension <> state_domain || ':' || state_target
UNION SELECT 'edge_missing_endpoint', t || ':' || a || '->' || b, '' FROM ends e WHERE a NOT IN (SELECT id FROM kinds) OR b NOT IN (SELECT id FROM kinds)
UNION SELECT 'edge_endpoint_type_mismatch', t || ':' || a || '->' || b, x.k || '->' || y.k FROM ends JOIN kinds x ON x.id = a JOIN kinds y ON y.id = b WHERE x.k || '->' || y.k <> due
UNION SELECT 'has_time_role_mismatch', 'HAS_TIME:' || id || '->d' || day, 'updated_at:started_at' FROM claims WHERE v >= 100 AND v < 110
UNION SELECT 'relation_reason_missing', t || ':' || a || '->' || b, '' FROM rels WHERE reason IS NULL
UNION SELECT 'relation_evidence_missing', t || ':' || a || '->' || b, '' FROM rels WHERE len(ev) = 0
UNION SELECT 'relation_evidence_not_endpoint', t || ':' || a || '->' || b, ev[1] FROM rels JOIN claims x ON x.id = a JOIN claims y ON y.id = b WHERE len(ev) > 0 AND ev[1] NOT IN (x.event, y.event)
UNION SELECT 'relation_evidence_event_missing', t || ':' || a || '->' || b, ev[1] FROM rels WHERE len(ev) > 0 AND ev[1] NOT IN (SELECT id FROM kinds WHERE k = 'event')
UNION SELECT 'relation_direction_invalid', t || ':' || a || '->' || b, x.dialog_id || '->' || y.dialog_id FROM rels JOIN claims x ON x.id = a JOIN claims y ON y.id = b WHERE t = 'SUPERSEDES' AND (day(x.ts), x.event_id) <= (day(y.ts), y.event_id)
UNION SELECT 'relation_state_dimension_mismatch', t || ':' || a || '->' || b, '' FROM rels JOIN claims x ON x.id = a JOIN claims y ON y.id = b WHERE x.state_dimension <> y.state_dimension
UNION SELECT 'relation_pair_type_conflict', least(a, b) || ':' || greatest(a, b), string_agg(DISTINCT t, ',' ORDER BY t) FROM rels GROUP BY least(a, b), greatest(a, b) HAVING count(DISTINCT t) > 1
UNION SELECT 'state_support_edge_missing', s, c FROM (SELECT s, c FROM listed EXCEPT SELECT s, c FROM supports)
UNION SELECT 'state_support_edge_undeclared', s, c FROM (SELECT s, c FROM supports EXCEPT SELECT s, c FROM listed)
UNION SELECT 'state_support_identity_mismatch', s, c || ':state_dimension' FROM met WHERE st.state_dimension <> cl.state_dimension
UNION SELECT 'claim_state_support_count', id, count(DISTINCT s)::VARCHAR FROM claims LEFT JOIN good ON c = id WHERE lasts GROUP BY id HAVING count(DISTINCT s) <> 1
UNION SELECT 'state_primary_field_mismatch', st.id, unnest(list_filter([{_EACH("CASE WHEN st.{c} IS DISTINCT FROM cl.{c} THEN '{c}' END", "")}], lambda x: x IS NOT NULL)) FROM prim
UNION SELECT 'state_internal_conflict', p, a || ':' || b FROM facing WHERE p = q
UNION SELECT 'state_status_relation_mismatch', id, status || ' for ' || due FROM due WHERE status <> due
UNION SELECT 'single_slot_active_count', coalesce(subject_key, '') || ':' || coalesce(state_dimension, ''), count(*)::VARCHAR FROM due WHERE slot_type = 'single' AND due <> 'historical' GROUP BY 2 HAVING count(*) > 1 AND bool_or(due <> 'ambiguous')
UNION SELECT 'state_current_after_role_invalid', id, t FROM after WHERE t LIKE 'd%'
UNION SELECT 'state_scope_invalid', id, scope FROM states WHERE scope = 'u7'
UNION SELECT 'state_scope_edge_missing', id, scope FROM states WHERE scope <> 'u7' AND id LIKE 'h%7'
"""

QUERIES = {"g6_graph_rules": (g6_graph_rules, f"WITH {_GRAPH} {_RULES}")}
