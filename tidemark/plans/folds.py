"""State queries: events as claims of a user about an event type, the value's bucket as what is claimed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import state
from .common import table

KEYS = ["owner", "dimension"]


def _claims(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("claim_id"), F.col("user_id").alias("owner"), F.col("event_type").alias("dimension"), F.floor(F.col("value") / 10).alias("value"), F.col("ts").alias("at"))


def f2_state_fold(spark, d) -> DataFrame:
    return state.fold_changes(_claims(spark, d), KEYS)


def f1_decided_fold(spark, d) -> DataFrame:
    """The general fold with the decisions that equal values are compatible and others superseded by the later claim."""
    c = _claims(spark, d)
    by = Window.partitionBy(*KEYS).orderBy("at", "claim_id")
    pairs = c.withColumn("existing", F.lag("claim_id").over(by)).withColumn("before", F.lag("value").over(by)).where("existing is not null")
    told = pairs.select("existing", F.col("claim_id").alias("incoming"), F.when(F.col("value") == F.col("before"), "COMPATIBLE").otherwise("SUPERSEDES").alias("decision"), F.lit("incoming").alias("winner"))
    return state.fold_decided(c, told, KEYS).select(*KEYS, "primary_claim", F.size("support").alias("n_claims"), "status", "superseded_by")


def branching(c: DataFrame) -> DataFrame:
    """Decisions on each claim and the five before it of its key, by how far their values lie apart."""
    by = Window.partitionBy(*KEYS).orderBy("at", "claim_id")
    before = F.array(*[F.struct(F.lag("claim_id", i).over(by).alias("id"), F.lag("value", i).over(by).alias("v")) for i in range(1, 6)])
    near = c.withColumn("before", before).select("claim_id", "value", F.explode(F.filter("before", lambda x: x["id"].isNotNull())).alias("x"))
    gap = F.col("value") - F.col("x.v")
    how = F.when(gap == 0, "COMPATIBLE").when(F.abs(gap) > 9, "DIFFERENT_TARGET").when(gap > 2, "SUPERSEDES").when(gap < -4, "CORRECTS").otherwise("CONFLICTS_WITH")
    return near.select(F.col("x.id").alias("existing"), F.col("claim_id").alias("incoming"), how.alias("decision"), F.when(gap < -4, "existing").otherwise("incoming").alias("winner"))


def f4_fold_errors(spark, d) -> DataFrame:
    """The fold of claims whose decisions branch: clusters merge, conflict, retire one another, and some break a rule."""
    c = _claims(spark, d).withColumn("day", F.dayofmonth("at"))
    out = state.fold_decided(c, branching(c), KEYS, "day", 5)
    return out.select(*KEYS, "primary_claim", F.array_join(F.transform("support", lambda x: x.cast("string")), ",").alias("support"), "status", "superseded_by", "error")


def f5_relation_windows(spark, d) -> DataFrame:
    """Windows of 8 claims with 2 in common, of keys with two claims or more."""
    by = Window.partitionBy(*KEYS)
    c = _claims(spark, d).withColumn("r", F.row_number().over(by.orderBy("at", "claim_id")) - 1).withColumn("n", F.count(F.lit(1)).over(by)).where("n >= 2")
    starts = F.expr("filter(sequence(0, cast(n - 1 as int), 6), s -> s = 0 or s + 2 < n)")
    return c.withColumn("start", F.explode(starts)).where("r >= start and r < start + 8").groupBy(*KEYS, F.col("start").cast("long").alias("start")).agg(F.count(F.lit(1)).alias("n_claims"), F.min("claim_id").alias("least_claim"))


def f7_current_states(spark, d) -> DataFrame:
    return f2_state_fold(spark, d).where("status = 'current'").select(*KEYS, "value", "primary_claim", "n_claims")


def f8_validity(spark, d) -> DataFrame:
    """3 for current; 1.5 for each outgoing and -2 for each incoming lifecycle edge of a cluster."""
    c = f2_state_fold(spark, d)
    score = F.when(F.col("status") == "current", 3.0).otherwise(0.0) + F.when(F.col("cluster") > 1, 1.5).otherwise(0.0) - F.when(F.col("superseded_by").isNotNull(), 2.0).otherwise(0.0)
    return c.groupBy("owner").agg(F.round(F.sum(score), 2).alias("validity"), F.count(F.lit(1)).alias("n_states"))


_FOLD = """
WITH c AS (SELECT event_id AS claim_id, user_id AS owner, event_type AS dimension, floor(value / 10)::BIGINT AS value, ts FROM events),
l AS (SELECT *, CASE WHEN value IS DISTINCT FROM lag(value) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY owner, dimension ORDER BY ts, claim_id)),
n AS (SELECT *, sum(new) OVER (PARTITION BY owner, dimension ORDER BY ts, claim_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM l),
g AS (SELECT owner, dimension, cluster, first(claim_id ORDER BY ts, claim_id) AS first_claim, last(claim_id ORDER BY ts, claim_id) AS primary_claim, count(*) AS n_claims, any_value(value) AS value FROM n GROUP BY ALL),
f AS (SELECT *, lead(first_claim) OVER (PARTITION BY owner, dimension ORDER BY cluster) AS superseded_by FROM g),
s AS (SELECT *, CASE WHEN superseded_by IS NULL THEN 'current' ELSE 'historical' END AS status FROM f)
"""
QUERIES = {
    "f2_state_fold": (f2_state_fold, _FOLD + "SELECT * FROM s"),
    "f1_decided_fold": (f1_decided_fold, _FOLD + "SELECT owner, dimension, primary_claim, n_claims::INT AS n_claims, status, superseded_by FROM s"),
    "f4_fold_errors": (f4_fold_errors, None),
    "f5_relation_windows": (f5_relation_windows, "WITH c AS (SELECT event_id, user_id AS owner, event_type AS dimension, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)), x AS (SELECT *, unnest(range(0, n, 6)) AS start FROM c WHERE n >= 2) SELECT owner, dimension, start, count(*) AS n_claims, min(event_id) AS least_claim FROM x WHERE (start = 0 OR start + 2 < n) AND r >= start AND r < start + 8 GROUP BY ALL"),
    "f7_current_states": (f7_current_states, _FOLD + "SELECT owner, dimension, value, primary_claim, n_claims FROM s WHERE status = 'current'"),
    "f8_validity": (f8_validity, _FOLD + "SELECT owner, round(sum(CASE WHEN status = 'current' THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN cluster > 1 THEN 1.5::DOUBLE ELSE 0 END - CASE WHEN superseded_by IS NOT NULL THEN 2.0::DOUBLE ELSE 0 END), 2) AS validity, count(*) AS n_states FROM s GROUP BY owner"),
}
