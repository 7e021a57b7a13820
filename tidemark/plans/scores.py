"""Evaluation queries: answers, labels and retrieved sets scored and summarised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_tokens
from ..operators import metrics
from .common import table


def m1_set_scores(spark, d) -> DataFrame:
    """Event types of each user up to value 20 against those above 30, by three conventions for empty sets."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") < 5, F.col("event_type"))).alias("c"), F.collect_set(F.when(F.col("value") > 60, F.col("event_type"))).alias("g"))
    out = [F.round(v, 6).alias(f"{k}_{n}") for n in ("null", "zero", "both_empty") for k, v in metrics.set_scores(F.col("c"), F.col("g"), n).items() if k != "f1"]
    return e.select("user_id", *out)


def _pairs(spark, d) -> DataFrame:
    """Each turn against the one before it."""
    t = table(spark, d, "conversations")
    a = t.select("conv_id", (F.col("turn") + 1).alias("turn"), plain_tokens(F.col("text")).alias("gold"))
    return t.select("conv_id", "turn", plain_tokens(F.col("text")).alias("said")).join(a, ["conv_id", "turn"])


def m2_token_f1(spark, d) -> DataFrame:
    return _pairs(spark, d).select("conv_id", "turn", F.round(metrics.token_f1(F.col("said"), F.col("gold")), 6).alias("f1"))


def m4_bleu1(spark, d) -> DataFrame:
    return _pairs(spark, d).select("conv_id", "turn", F.round(metrics.bleu1(F.col("said"), F.col("gold")), 6).alias("bleu1"))


def m6_exact_sets(spark, d) -> DataFrame:
    same = F.array_sort(F.array_distinct("said")) == F.array_sort(F.array_distinct("gold"))
    return _pairs(spark, d).select("conv_id", "turn", (same & (F.size("said") > 0)).alias("exact"))


def m8_summary(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "value", F.when(F.col("value") > 10, 1.0).alias("hit"))
    return metrics.summary(e, "event_type", ["value", "hit"], 3)


def m9_hierarchy(spark, d) -> DataFrame:
    e = table(spark, d, "labels").select((F.col("doc_id") % 3).alias("major"), (F.col("doc_id") % 5).alias("minor"), F.col("quality").alias("ok"))
    return e.groupingSets([["major"], ["minor"], ["major", "minor"]], "major", "minor").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg("ok"), 4).alias("accuracy"))


def m11_majority(spark, d) -> DataFrame:
    """A label by strict majority of an item's judge runs."""
    return table(spark, d, "events").groupBy("user_id").agg((F.avg(F.when(F.col("value") > 10, 1.0).otherwise(0.0)) > 0.5).alias("correct"), F.count(F.lit(1)).alias("runs"))


def m13_bins(spark, d) -> DataFrame:
    n = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("k"), F.avg(F.length("text")).alias("x"))
    bins = F.when(F.col("k") == 0, "0").when(F.col("k") == 1, "1").when(F.col("k") == 2, "2").when(F.col("k") <= 5, "3-5").otherwise("6+")
    return n.groupBy(bins.alias("bin")).agg(F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_samp("x"), 4).alias("std"), F.count(F.lit(1)).alias("n"))


def m16_conditional(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    part = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    return e.groupBy("user_id").agg(F.round(part("view"), 4).alias("recall"), F.round(part("click"), 4).alias("chronological"), F.round(part("view") - part("click"), 4).alias("difference"))


def m17_cascade(spark, d) -> DataFrame:
    t = F.col("text")
    verdict = F.coalesce(F.when(F.length(t) < 120, "short"), F.when(t.rlike(r"[*#$%&]{3}"), "symbols"), F.when(t.rlike(r"\d"), "number"), F.lit("undecided"))
    return table(spark, d, "documents").select("doc_id", verdict.alias("judgment"))


def m18_cutoffs(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "value", F.explode(F.array(F.lit(5), F.lit(10), F.lit(20))).alias("cutoff"))
    return e.groupingSets([["cutoff", "event_type"], ["cutoff"]], "cutoff", "event_type").agg(F.round(F.avg(F.when(F.col("value") <= F.col("cutoff"), 1.0).otherwise(0.0)), 4).alias("score"))


def m20_rescored(spark, d) -> DataFrame:
    """A label by rule first, else the given one, overall and by language."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", F.coalesce(F.when(F.length("text") < 120, 0), F.col("quality")).alias("ok"))
    return j.rollup("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ok"), 4).alias("score"))


_PAIRS = "WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS s FROM conversations), p AS (SELECT a.conv_id, a.turn, a.s AS said, b.s AS gold FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1)"
_OVER = _PAIRS + ", x AS (SELECT conv_id, turn, len(said)::DOUBLE AS n, len(gold)::DOUBLE AS m, coalesce(list_sum(list_transform(list_distinct(said), lambda w: least(len(list_filter(said, lambda v: v = w)), len(list_filter(gold, lambda v: v = w))))), 0)::DOUBLE AS k FROM p)"
_SETS = "WITH e AS (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (WHERE value < 5), []) AS c, coalesce(list(DISTINCT event_type) FILTER (WHERE value > 60), []) AS g FROM events GROUP BY 1), s AS (SELECT user_id, len(c)::DOUBLE AS c, len(g)::DOUBLE AS g, len(list_intersect(c, g))::DOUBLE AS k FROM e)"
QUERIES = {
    "m1_set_scores": (m1_set_scores, _SETS + """
SELECT user_id, round(CASE WHEN c = 0 THEN CASE WHEN g > 0 THEN 0.0 END ELSE k / c END, 6) AS precision_null, round(k / nullif(g, 0), 6) AS recall_null, round(coalesce(k / nullif(c, 0), 0), 6) AS precision_zero, round(coalesce(k / nullif(g, 0), 0), 6) AS recall_zero,
  round(CASE WHEN c = 0 AND g = 0 THEN 1.0 ELSE coalesce(k / nullif(c, 0), 0) END, 6) AS precision_both_empty, round(CASE WHEN g = 0 THEN 1.0 ELSE coalesce(k / nullif(g, 0), 0) END, 6) AS recall_both_empty FROM s"""),
    "m2_token_f1": (m2_token_f1, _OVER + "SELECT conv_id, turn, CASE WHEN k > 0 THEN round(2.0::DOUBLE * (k / n) * (k / m) / (k / n + k / m), 6) ELSE 0.0::DOUBLE END AS f1 FROM x"),
    "m4_bleu1": (m4_bleu1, _OVER + "SELECT conv_id, turn, CASE WHEN n > 0 THEN round(CASE WHEN n >= m THEN 1.0::DOUBLE ELSE exp(1 - m / n) END * k / n, 6) ELSE 0.0::DOUBLE END AS bleu1 FROM x"),
    "m6_exact_sets": (m6_exact_sets, _PAIRS + "SELECT conv_id, turn, len(said) > 0 AND list_sort(list_distinct(said)) = list_sort(list_distinct(gold)) AS exact FROM p"),
    "m8_summary": (m8_summary, "WITH e AS (SELECT event_type, value, CASE WHEN value > 10 THEN 1.0::DOUBLE END AS hit FROM events), t AS (SELECT event_type AS level, count(*) AS n, avg(value) AS value, avg(hit) AS hit FROM e GROUP BY 1), u AS (SELECT * FROM t UNION ALL SELECT 'overall', count(*), avg(value), avg(hit) FROM e UNION ALL SELECT 'macro', count(*), avg(value), avg(hit) FROM t) SELECT level, n, round(value, 3) AS value, round(hit, 3) AS hit FROM u"),
    "m9_hierarchy": (m9_hierarchy, "WITH e AS (SELECT doc_id % 3 AS major, doc_id % 5 AS minor, quality FROM labels) SELECT major, minor, count(*) AS n, round(100 * avg(quality), 4) AS accuracy FROM e GROUP BY GROUPING SETS ((major), (minor), (major, minor))"),
    "m11_majority": (m11_majority, "SELECT user_id, avg(CASE WHEN value > 10 THEN 1.0::DOUBLE ELSE 0 END) > 0.5 AS correct, count(*) AS runs FROM events GROUP BY 1"),
    "m13_bins": (m13_bins, "WITH n AS (SELECT conv_id, count(*) AS k, avg(length(text)) AS x FROM conversations GROUP BY 1) SELECT CASE WHEN k = 0 THEN '0' WHEN k = 1 THEN '1' WHEN k = 2 THEN '2' WHEN k <= 5 THEN '3-5' ELSE '6+' END AS bin, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, count(*) AS n FROM n GROUP BY 1"),
    "m16_conditional": (m16_conditional, "WITH a AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'view') AS r, avg(value) FILTER (WHERE event_type = 'click') AS c FROM events GROUP BY 1) SELECT user_id, round(r, 4) AS recall, round(c, 4) AS chronological, round(r - c, 4) AS difference FROM a"),
    "m17_cascade": (m17_cascade, "SELECT doc_id, CASE WHEN length(text) < 120 THEN 'short' WHEN regexp_matches(text, '[*#$%&]{3}') THEN 'symbols' WHEN regexp_matches(text, '[0-9]') THEN 'number' ELSE 'undecided' END AS judgment FROM documents"),
    "m18_cutoffs": (m18_cutoffs, "WITH e AS (SELECT event_type, value, unnest([5, 10, 20]) AS cutoff FROM events) SELECT cutoff, event_type, round(avg(CASE WHEN value <= cutoff THEN 1.0::DOUBLE ELSE 0 END), 4) AS score FROM e GROUP BY GROUPING SETS ((cutoff, event_type), (cutoff))"),
    "m20_rescored": (m20_rescored, "SELECT lang, count(*) AS n, round(avg(CASE WHEN length(text) < 120 THEN 0 ELSE quality END), 4) AS score FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)"),
}
