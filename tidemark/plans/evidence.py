"""Evidence and claim queries over documents, conversations, events and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_tokens, sentences
from ..operators import evidence as E
from . import folds
from .common import table


def _events(spark, d) -> DataFrame:
    """Events with the one before of the same user."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumns({"prev_id": F.lag("event_id").over(by), "prev_type": F.lag("event_type").over(by), "prev_value": F.lag("value").over(by)})


def _states(spark, d) -> DataFrame:
    return folds.f2_state_fold(spark, d).withColumn("state_id", F.concat_ws(":", F.col("owner").cast("string"), "dimension", F.col("cluster").cast("string")))


def t7_scope_labels(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(E.scope_labels(F.split("text", " ")), "|").alias("labels"))


def t21_gold_items(spark, d) -> DataFrame:
    kind, t = F.col("event_id") % 4, F.col("event_type")
    said = F.when(kind == 0, F.concat(F.lit("['"), t, F.lit("', 'x']"))).when(kind == 1, F.concat(F.lit('["'), t, F.lit('"]'))).when(kind == 2, F.lit("[]")).otherwise(t)
    return table(spark, d, "events").select("event_id", F.array_join(E.gold_items(said), "|").alias("items"))


def c3_rejections(spark, d) -> DataFrame:
    reasons = {"missing_field": F.col("value").isNull(), "limit": F.col("value") > 40, "unknown_id": F.col("event_type") == "error"}
    return E.rejected(table(spark, d, "events"), ["user_id"], reasons)


def c5_cited_sentences(spark, d) -> DataFrame:
    ids = F.array(F.col("doc_id") % 5, F.lit(3), F.lit(1), F.lit(3), F.lit(999999))
    return table(spark, d, "documents").select("doc_id", F.sha2(F.array_join(E.cited_sentences(sentences(F.col("text")), ids, 2), "\n"), 256).alias("evidence_sha"))


def f3_decision_faults(spark, d) -> DataFrame:
    """Decisions between a user's successive events: by rest of the id one says nothing known, one names no winner, and so on."""
    e, k = _events(spark, d).where("prev_id is not null"), F.col("event_id") % 7
    rows = e.select(
        "event_id", F.col("prev_id").alias("existing"), F.col("event_id").alias("incoming"), F.col("event_type").alias("slot"),
        F.when(k == 0, "MERGES").when(k <= 3, "SUPERSEDES").when(k == 4, "DIFFERENT_TARGET").otherwise("COMPATIBLE").alias("decision"),
        F.when(k == 1, F.lit(None)).when(k == 2, "existing").otherwise("incoming").alias("winner"), F.when(k == 5, " ").otherwise("same target").alias("reason"),
        F.when(k == 6, F.array("event_id", F.lit(-1).cast("long"))).otherwise(F.array("event_id")).alias("evidence"), F.lit(1).alias("existing_dialog"), F.lit(2).alias("incoming_dialog"),
    )
    return rows.select("event_id", E.decision_fault(F.col("slot") == "view").alias("fault"))


def g2_claim_edges(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    when = F.when(F.col("event_type") != "error", F.col("ts"))
    return E.claim_edges(e.select(F.col("event_id").alias("event"), F.col("event_id").alias("claim"), F.col("user_id").alias("subject"), F.array("event_type").alias("topics"), when.alias("at"), F.lit("occurred_at").alias("role")))


def r15_constraints(spark, d) -> DataFrame:
    """Per user: events of type purchase that are worth more than 30; users without any take all their purchases."""
    e = table(spark, d, "events").withColumnRenamed("user_id", "query_id")
    names = F.array_compact(F.array(F.when(F.col("event_type") == "purchase", "type"), F.when(F.col("value") > 30, "value")))
    matches = e.select("query_id", "event_id", F.explode(names).alias("constraint"))
    wanted = e.select("query_id").distinct().select("query_id", F.explode(F.array(F.lit("type"), F.lit("value"))).alias("constraint"))
    return E.constrained(matches, wanted, e.where("event_type = 'purchase'").select("query_id", "event_id"))


def r24_restored(spark, d) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    out = E.restore(e.select("event_id", "user_id", "event_type", "day"), e.select("user_id", "event_type", "day", "props", "event_id"), ["user_id", "event_type", "day"], "props", ["event_id"])
    return out.select("event_id", "props")


def r25_memory_dialogs(spark, d) -> DataFrame:
    """Turns that name their dialog and the one before; turn 0 is the summary of its conversation."""
    t = table(spark, d, "conversations")
    named = lambda n: F.concat(F.lit("D"), F.col("conv_id").cast("string"), F.lit(":"), n.cast("string"))
    text = F.concat(F.lit("see "), named(F.col("turn")), F.lit(" and "), named(F.greatest(F.col("turn") - 1, F.lit(1))))
    rows = t.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("memory_id"), F.col("conv_id").alias("day"), text.alias("text"), (F.col("turn") == 0).alias("summary"))
    return E.memory_dialogs(rows).select("memory_id", F.array_join(F.array_sort("dialog_ids"), ",").alias("dialog_ids"))


def j6_state_proof(spark, d) -> DataFrame:
    return E.proof(_states(spark, d), folds.KEYS)


def j7_siblings(spark, d) -> DataFrame:
    return E.siblings(_states(spark, d).withColumn("kind", F.length("dimension") % 2), ["owner", "kind"])


def d3_grounding_rows(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("query_id"), "event_id", F.col("event_type").alias("role"), F.when(F.col("value") > 5, "claim").otherwise("event_fallback").alias("source"), "ts")
    roles = F.when(F.col("query_id") % 3 == 0, F.array(F.lit("view"), F.lit("purchase"))).otherwise(F.array().cast("array<string>"))
    return E.grounding_rows(e, F.col("query_id") % 2 == 0, roles, ("claim", "state"), [F.col("ts"), F.col("event_id")]).select("query_id", "event_id", "rank")


def d6_recency(spark, d) -> DataFrame:
    """Each user's newest event: errors have only their report's day, others their own time."""
    e = table(spark, d, "events")
    fact = F.when(F.col("event_type") != "error", F.col("ts"))
    key = E.recency(F.lit(None).cast("timestamp"), fact, F.date_trunc("day", "ts"), F.lit(0), F.col("event_id"))
    return e.groupBy("user_id").agg(F.max_by("event_id", key).alias("newest"))


def d8_role_filter(spark, d) -> DataFrame:
    """Days of users whose event types meet those asked for; users that ask for none keep every day."""
    e = table(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.collect_set("event_type").alias("roles"))
    asked = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("error"), F.lit("purchase"))).otherwise(F.array().cast("array<string>"))
    return e.where((F.size(asked) == 0) | F.arrays_overlap("roles", asked)).select("user_id", "day")


def e2_handles(spark, d) -> DataFrame:
    e = _events(spark, d)
    units = e.select("event_id", F.concat(F.element_at(F.array(F.lit("C"), F.lit("S"), F.lit("X")), (F.col("event_id") % 3 + 1).cast("int")), (F.col("event_id") % 4).cast("string")).alias("handle"), F.array("event_id", "prev_id").alias("c"), F.array("user_id").alias("s"))
    return E.handles(units, F.col("c"), F.col("s")).select("event_id", "handle", "id")


def e4_retrieval_queries(spark, d) -> DataFrame:
    e = _events(spark, d)
    op = F.when(F.col("event_id") % 2 == 0, "count").otherwise("lookup")
    return e.select("event_id", F.array_join(E.retrieval_queries(F.concat(F.lit("what of "), "event_type"), F.array("event_type", "prev_type", "event_type"), op), "|").alias("asked"))


def m3_multi_answer_f1(spark, d) -> DataFrame:
    """An event's type and the type before as gold, the type before alone as the answer."""
    e = _events(spark, d).where("prev_id is not null")
    return e.select("event_id", F.round(E.multi_answer_f1(F.array(plain_tokens(F.col("prev_type"))), F.array(plain_tokens(F.col("event_type")), plain_tokens(F.col("prev_type")))), 6).alias("f1"))


def m12_judged_f1(spark, d) -> DataFrame:
    e = _events(spark, d).where("prev_id is not null")
    n_gold, n_said = F.col("event_id") % 3, F.col("event_id") % 5
    return e.select("event_id", *[F.round(v, 6).alias(k) for k, v in E.judged_f1(F.array(F.col("value") / 20, F.col("prev_value") / 20), n_said, n_gold).items()])


def m14_bin_zero(spark, d) -> DataFrame:
    k = F.col("event_id") % 3
    score = F.when(k == 2, 0.5).otherwise(0.0)
    out = E.bin_zero(score, F.when(k == 0, "0").otherwise("1"), k, F.col("event_id") % 2, F.col("event_type") == "error")
    return table(spark, d, "events").select("event_id", out.alias("f1"))


_PREV = "e AS (SELECT *, lag(event_id) OVER w AS prev_id, lag(event_type) OVER w AS prev_type, lag(value) OVER w AS prev_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
_STATES = folds._FOLD + ", t AS (SELECT *, concat_ws(':', owner::VARCHAR, dimension, cluster::VARCHAR) AS state_id FROM s)"
QUERIES = {
    "t7_scope_labels": (t7_scope_labels, r"""
WITH c AS (SELECT conv_id, turn, list_transform(string_split(text, ' ')[1:12], lambda x: regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^[ .,;:!?''"-]+|[ .,;:!?''"-]+$', '', 'g')) AS l FROM conversations),
u AS (SELECT conv_id, turn, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM c), f AS (SELECT conv_id, turn, arg_min(x, i) AS x, min(i) AS i FROM u WHERE x <> '' GROUP BY conv_id, turn, lower(x)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS r FROM f), g AS (SELECT conv_id, turn, string_agg(x, '|' ORDER BY i) AS labels FROM r WHERE r <= 4 GROUP BY 1, 2)
SELECT conv_id, turn, coalesce(labels, '') AS labels FROM conversations LEFT JOIN g USING (conv_id, turn)"""),
    "t21_gold_items": (t21_gold_items, "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || '|x' WHEN 2 THEN '' ELSE event_type END AS items FROM events"),
    "c3_rejections": (c3_rejections, "SELECT user_id, CASE WHEN value IS NULL THEN 'missing_field' WHEN value > 40 THEN 'limit' WHEN event_type = 'error' THEN 'unknown_id' END AS reason, count(*) AS n FROM events GROUP BY 1, 2 HAVING reason IS NOT NULL"),
    "c5_cited_sentences": (c5_cited_sentences, r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents),
i AS (SELECT doc_id, s, list_filter(list_sort(list_distinct([doc_id % 5, 1, 3])), lambda k: k >= 1 AND k <= len(s))[1:2] AS i FROM s)
SELECT doc_id, sha256(array_to_string(list_transform(i, lambda k: s[k]), chr(10))) AS evidence_sha FROM i"""),
    "f3_decision_faults": (f3_decision_faults, f"WITH {_PREV} SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'unknown_decision' WHEN 1 THEN 'no_winner' WHEN 2 THEN 'earlier_wins' WHEN 4 THEN CASE WHEN event_type = 'view' THEN 'different_target_in_single_slot' END WHEN 5 THEN 'no_reason' WHEN 6 THEN 'foreign_evidence' END AS fault FROM e WHERE prev_id IS NOT NULL"),
    "g2_claim_edges": (g2_claim_edges, "SELECT 'ASSERTS' AS type, 'event::' || event_id AS src, 'claim::' || event_id AS dst FROM events UNION SELECT 'MENTIONS', 'event::' || event_id, 'subject::' || user_id FROM events UNION SELECT 'MENTIONS', 'event::' || event_id, 'topic::' || event_type FROM events UNION SELECT 'HAS_TIME', 'claim::' || event_id, 'time::occurred_at::' || strftime(ts, '%Y-%m-%d') FROM events WHERE event_type <> 'error'"),
    "r15_constraints": (r15_constraints, "WITH p AS (SELECT user_id AS query_id, event_id, coalesce(value > 30, false) AS hit FROM events WHERE event_type = 'purchase'), q AS (SELECT *, bool_or(hit) OVER (PARTITION BY query_id) AS met FROM p) SELECT query_id, event_id, CASE WHEN hit THEN 'exact' ELSE 'routed' END AS status FROM q WHERE hit OR NOT met"),
    "r24_restored": (r24_restored, "SELECT event_id, last_value(props) OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS props FROM events"),
    "r25_memory_dialogs": (r25_memory_dialogs, """
WITH m AS (SELECT conv_id, turn, unnest([turn, greatest(turn - 1, 1)]) AS n FROM conversations), x AS (SELECT DISTINCT conv_id, turn, n FROM m WHERE turn <> 0 UNION SELECT DISTINCT c.conv_id, c.turn, m.n FROM conversations c JOIN m ON m.conv_id = c.conv_id AND m.turn <> 0 WHERE c.turn = 0),
g AS (SELECT conv_id, turn, string_agg('D' || conv_id || ':' || n, ',' ORDER BY 'D' || conv_id || ':' || n) AS dialog_ids FROM x GROUP BY 1, 2) SELECT c.conv_id || '-' || c.turn AS memory_id, coalesce(dialog_ids, '') AS dialog_ids FROM conversations c LEFT JOIN g USING (conv_id, turn)"""),
    "j6_state_proof": (j6_state_proof, _STATES + "SELECT state_id, primary_claim AS claim_id FROM t UNION SELECT state_id, superseded_by FROM t WHERE superseded_by IS NOT NULL UNION SELECT b.state_id, a.primary_claim FROM t a JOIN t b ON b.owner = a.owner AND b.dimension = a.dimension AND b.cluster = a.cluster + 1"),
    "j7_siblings": (j7_siblings, _STATES + "SELECT state_id, owner, (length(dimension) % 2)::INT AS kind, count(*) OVER (PARTITION BY owner, length(dimension) % 2) AS n FROM t WHERE status = 'current' QUALIFY n > 1"),
    "d3_grounding_rows": (d3_grounding_rows, "SELECT user_id AS query_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events WHERE user_id % 2 = 0 AND value > 5 AND (user_id % 3 <> 0 OR event_type IN ('view', 'purchase')) QUALIFY rank <= 32"),
    "d6_recency": (d6_recency, "SELECT user_id, event_id AS newest FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type <> 'error' THEN ts ELSE date_trunc('day', ts) END DESC, event_id DESC) = 1"),
    "d8_role_filter": (d8_role_filter, "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events GROUP BY 1, 2 HAVING user_id % 2 <> 0 OR bool_or(event_type IN ('error', 'purchase'))"),
    "e2_handles": (e2_handles, f"WITH {_PREV}, h AS (SELECT *, ['C', 'S', 'X'][event_id % 3 + 1] AS k, event_id % 4 AS n FROM e) SELECT event_id, k || n AS handle, CASE WHEN k = 'C' AND n = 1 THEN event_id WHEN k = 'C' AND n = 2 THEN prev_id WHEN k = 'S' AND n = 1 THEN user_id END AS id FROM h"),
    "e4_retrieval_queries": (e4_retrieval_queries, f"WITH {_PREV} SELECT event_id, 'what of ' || event_type || CASE WHEN event_id % 2 = 0 THEN '|' || event_type || CASE WHEN prev_type <> event_type THEN '|' || prev_type ELSE '' END ELSE '' END AS asked FROM e"),
    "m3_multi_answer_f1": (m3_multi_answer_f1, f"WITH {_PREV} SELECT event_id, CASE WHEN event_type = prev_type THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS f1 FROM e WHERE prev_id IS NOT NULL"),
    "m12_judged_f1": (m12_judged_f1, f"""
WITH {_PREV}, x AS (SELECT event_id, (event_id % 3)::DOUBLE AS g, (event_id % 5)::DOUBLE AS n, least(least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 20)) + least(1.0::DOUBLE, greatest(0.0::DOUBLE, prev_value / 20)), (event_id % 3)::DOUBLE) AS t FROM e WHERE prev_id IS NOT NULL),
p AS (SELECT *, least(1, t / nullif(g, 0)) AS r, CASE WHEN n > 0 THEN least(1, t / n) END AS h, CASE WHEN n > 0 THEN least(1, t / CASE WHEN g > 0 THEN least(n, g) ELSE n END) END AS l FROM x)
SELECT event_id, round(CASE WHEN n = 0 AND g = 0 THEN 1.0::DOUBLE WHEN g > 0 AND l + r > 0 THEN 2 * l * r / (l + r) ELSE 0.0::DOUBLE END, 6) AS lenient, round(CASE WHEN n = 0 AND g = 0 THEN 1.0::DOUBLE WHEN g > 0 AND h + r > 0 THEN 2 * h * r / (h + r) ELSE 0.0::DOUBLE END, 6) AS harsh FROM p"""),
    "m14_bin_zero": (m14_bin_zero, "SELECT event_id, CASE event_id % 3 WHEN 2 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE CASE WHEN event_id % 2 = 0 OR event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS f1 FROM events"),
}
