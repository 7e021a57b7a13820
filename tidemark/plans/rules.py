"""Queries by the whole rules of spans, subjects, bindings, time profiles, orders and one-hop expansion, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, subjects, times
from .common import table


def t14_time_spans(spark, d) -> DataFrame:
    """Every place of 'the' in a text, and those where it is a whole word."""
    t = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    told = t.select("doc_id", T.span_starts(F.col("text"), F.lit("the")).alias("a"), T.time_span_starts(F.col("text"), F.lit("the")).alias("b"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return told.select("doc_id", F.size("a").alias("n_all"), F.size("b").alias("n_whole"), total("a").alias("sum_all"), total("b").alias("sum_whole"))


def c9_subject_keys(spark, d) -> DataFrame:
    """Subjects are a text's first two words where they stand before a stop of the first line, else its first; a source's
    names share aliases."""
    t = table(spark, d, "documents").select("doc_id", "source", F.lit("").alias("speaker"), F.regexp_extract(F.coalesce("text", F.lit("")), r"^([^ \n.,]+(?: [^ \n.,]+)?)", 1).alias("subject"))
    return subjects.subject_keys(t, ["source"]).select("doc_id", "source", "subject_key", "canonical_subject")


def r16_hit_order(spark, d) -> DataFrame:
    """A user's events ranked by value, then put in order of time; errors have no time."""
    e = table(spark, d, "events").select(F.col("user_id").alias("query_id"), "event_id", F.when(F.col("event_type") != "error", F.col("ts")).alias("ts"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("rank"))
    latest = times.order_hits(e, F.col("ts"), "latest").withColumnRenamed("place", "latest")
    return times.order_hits(latest, F.col("ts"), "chronological").select("query_id", "event_id", "latest", F.col("place").alias("chronological"))


def r21_time_scaling(spark, d) -> DataFrame:
    """Mean time of each user's orders of one kind, between the earliest and the latest mean; errors have no time."""
    known = F.when(F.col("event_type") != "error", F.struct(F.col("ts")))
    t = table(spark, d, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.collect_list(known["ts"]).alias("at"))
    scaled, _ = times.scale_times(t, "at")
    return scaled.select("user_id", "event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("scaled", 6).alias("scaled"))


def _history(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events as days of a user, claims as the rows of a day, states as a user's rows of one kind, newest current."""
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("event", F.concat_ws(":", F.col("user_id").cast("string"), "day"))
    events = e.select(F.col("event").alias("event_id"), F.col("day").alias("occurred_at")).distinct()
    claims = e.select(F.col("event").alias("event_id"), F.col("event_id").alias("claim_id"), F.col("event_type").alias("time_role"), F.when(F.col("event_type") != "error", F.date_format("ts", "HH")).alias("time_value"))
    newest = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))) == 1
    states = e.select(F.col("event_id").alias("claim_id"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("state_id"), newest.alias("current"), F.col("event_id").alias("primary_claim_id"), F.when(F.col("event_type") != "view", F.col("day")).alias("current_after"))
    return events, claims, states


def d4_event_profiles(spark, d) -> DataFrame:
    events, claims, states = _history(spark, d)
    at = table(spark, d, "events").where("value >= 20").select(F.col("event_id").alias("claim_id"), F.concat(F.lit("time::"), F.date_format("ts", "yyyy-MM")).alias("time_id"), F.lit("high").alias("time_role"), F.date_format("ts", "yyyy-MM").alias("value"))
    p = times.event_profiles(events, claims, at, states)
    return p.select("event_id", *[F.array_join(c, ",").alias(c) for c in ("time_roles", "time_values", "time_ids", "current_state_ids")])


def j3_events_to_states(spark, d) -> DataFrame:
    """Every purchase asks for the claims of its user's day and their states."""
    _, claims, states = _history(spark, d)
    seeds = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("query_id"), F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("event_id"))
    return graph.one_hop(seeds, claims, states.where("current"))


def j9_binding(spark, d) -> DataFrame:
    """A conversation's first speaker is asked about; turns that hold the word 'and' are cited, those that name no speaker
    first are their speaker's."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    claims = t.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("claim_id"), "conv_id", F.regexp_extract("text", r"^([^ \n.,]+)", 1).alias("subject"), F.col("role").alias("speaker"), F.col("text").contains(" and ").alias("cited"))
    owners = subjects.claim_owners(claims, t.select(F.col("role").alias("name")).distinct())
    cited = claims.where("cited").join(owners, "claim_id").select(F.col("conv_id").alias("query_id"), "owner")
    asked = t.groupBy(F.col("conv_id").alias("query_id")).agg(F.array(F.min_by("role", "turn")).alias("participants"))
    return subjects.participant_binding(asked, cited)


_HISTORY = """e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, user_id || ':' || strftime(ts, '%Y-%m-%d') AS event, user_id || ':' || event_type AS state_id,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1 AS current FROM events)"""
QUERIES = {
    "t14_time_spans": (t14_time_spans, r"""
WITH p AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), 'the') AS p FROM documents),
u AS (SELECT doc_id, text, len(p) AS n, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM p),
s AS (SELECT doc_id, text, n, i, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) + 3 * (i - 1) AS at_ FROM u),
b AS (SELECT *, i < n AS here, i < n AND NOT regexp_matches(CASE WHEN at_ > 0 THEN substring(text, at_::BIGINT, 1) ELSE '' END || substring(text, at_::BIGINT + 4, 1), '[\p{L}\p{N}]') AS whole FROM s)
SELECT doc_id, count(*) FILTER (WHERE here) AS n_all, count(*) FILTER (WHERE whole) AS n_whole, coalesce(sum(at_) FILTER (WHERE here), 0)::BIGINT AS sum_all, coalesce(sum(at_) FILTER (WHERE whole), 0)::BIGINT AS sum_whole FROM b GROUP BY doc_id"""),
    "c9_subject_keys": (c9_subject_keys, r"""
WITH t AS (SELECT doc_id, source, regexp_extract(coalesce(text, ''), '^([^ \n.,]+(?: [^ \n.,]+)?)', 1) AS s FROM documents),
l AS (SELECT doc_id, source, regexp_replace(trim(regexp_replace(s, '\s+', ' ', 'g')), '^[ \t\r\n''"`.,:;!?()\[\]{}]+|[ \t\r\n''"`.,:;!?()\[\]{}]+$', '', 'g')[1:180] AS label FROM t),
r AS (SELECT doc_id, source, regexp_replace(label, '^([A-Za-z][A-Za-z''-]*)[''’]s$', '\1') AS label FROM l),
k AS (SELECT *, regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')[1:100] AS key, regexp_matches(label, '^[A-Za-z][A-Za-z''-]*(?: [A-Za-z][A-Za-z''-]*){0,3}$') AND NOT regexp_matches(label, '(?i)[''’]s\b') AS plain FROM r),
names AS (SELECT source, key, bool_or(plain) AS plain FROM k GROUP BY ALL),
full_ AS (SELECT source, split_part(key, '_', 1) AS short, min(key) AS key FROM names WHERE plain AND contains(key, '_') GROUP BY 1, 2 HAVING count(*) = 1),
told AS (SELECT n.source, n.key, coalesce(f.key, n.key) AS subject_key FROM names n LEFT JOIN full_ f ON f.source = n.source AND f.short = n.key AND n.plain),
best AS (SELECT t.source, t.subject_key, arg_max(label, (length(label), lower(label), label)) AS canonical_subject FROM k JOIN told t USING (source, key) GROUP BY ALL)
SELECT k.doc_id, k.source, t.subject_key, b.canonical_subject FROM k JOIN told t USING (source, key) JOIN best b ON b.source = k.source AND b.subject_key = t.subject_key"""),
    "r16_hit_order": (r16_hit_order, """
WITH e AS (SELECT user_id AS query_id, event_id, CASE WHEN event_type <> 'error' THEN ts END AS ts, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events)
SELECT query_id, event_id, row_number() OVER (PARTITION BY query_id ORDER BY ts DESC NULLS LAST, r) AS latest, row_number() OVER (PARTITION BY query_id ORDER BY ts NULLS LAST, r) AS chronological FROM e"""),
    "r21_time_scaling": (r21_time_scaling, """
WITH t AS (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, avg(CASE WHEN event_type <> 'error' THEN epoch_us(ts) / 1e6 END) AS m FROM events GROUP BY ALL)
SELECT user_id, event_type, day, round(coalesce((m - (SELECT min(m) FROM t)) / (SELECT max(m) - min(m) FROM t), 0), 6) AS scaled FROM t"""),
    "d4_event_profiles": (d4_event_profiles, f"""
WITH {_HISTORY}, f AS (
  SELECT event, NULL AS role, day AS value, NULL AS time_id, NULL AS state_id FROM e
  UNION ALL SELECT event, event_type, CASE WHEN event_type <> 'error' THEN strftime(ts, '%H') END, NULL, NULL FROM e
  UNION ALL SELECT event, 'high', strftime(ts, '%Y-%m'), 'time::' || strftime(ts, '%Y-%m'), NULL FROM e WHERE value >= 20
  UNION ALL SELECT event, 'CURRENT_AFTER', NULL, NULL, state_id FROM e WHERE current AND event_type <> 'view')
SELECT event AS event_id, coalesce(string_agg(DISTINCT role, ',' ORDER BY role), '') AS time_roles, coalesce(string_agg(DISTINCT value, ',' ORDER BY value), '') AS time_values,
  coalesce(string_agg(DISTINCT time_id, ',' ORDER BY time_id), '') AS time_ids, coalesce(string_agg(DISTINCT state_id, ',' ORDER BY state_id), '') AS current_state_ids FROM f GROUP BY 1"""),
    "j3_events_to_states": (j3_events_to_states, f"""
WITH {_HISTORY} SELECT s.event_id AS query_id, s.event AS event_id, c.event_id AS claim_id, CASE WHEN c.current THEN c.state_id END AS state_id FROM e s JOIN e c ON c.event = s.event WHERE s.event_type = 'purchase'"""),
    "j9_binding": (j9_binding, r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, role, regexp_replace(regexp_replace(lower(regexp_extract(text, '^([^ \n.,]+)', 1)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS k FROM t WHERE contains(text, ' and ')),
o AS (SELECT conv_id, list(DISTINCT CASE WHEN k IN (SELECT role FROM t) THEN k ELSE role END) AS owners FROM c GROUP BY 1),
q AS (SELECT conv_id, arg_min(role, turn) AS asked FROM t GROUP BY 1),
s AS (SELECT q.conv_id, CASE WHEN owners IS NULL THEN 'not_applicable' WHEN list_contains(owners, asked) THEN 'supported_participant' ELSE 'contradicted_participant' END AS status FROM q LEFT JOIN o USING (conv_id))
SELECT conv_id AS query_id, status, status = 'contradicted_participant' AS blocked FROM s"""),
}
