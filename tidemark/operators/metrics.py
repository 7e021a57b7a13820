"""Metrics of retrieval and answers as columns and grouped tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_scores(chosen: Column, gold: Column, convention: str = "null") -> dict[str, Column]:
    """precision, recall and f1 of two id arrays.

    null: recall null without gold, precision 0 with gold but nothing chosen, null with neither. zero: zeros instead.
    both_empty: 1, 1, 1 if both are empty; 0, 1, 0 if only gold is; 0, 0, 0 if only chosen is.
    """
    c, g, hit = F.size(F.array_distinct(chosen)), F.size(F.array_distinct(gold)), F.size(F.array_intersect(chosen, gold))
    p, r = hit / F.nullif(c, F.lit(0)), hit / F.nullif(g, F.lit(0))
    if convention == "zero":
        p, r = F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0))
    elif convention == "both_empty":
        p = F.when((c == 0) & (g == 0), 1.0).otherwise(F.coalesce(p, F.lit(0.0)))
        r = F.when(g == 0, 1.0).otherwise(F.coalesce(r, F.lit(0.0)))
    else:
        p = F.when(c == 0, F.when(g > 0, 0.0)).otherwise(p)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).when((p + r) == 0, 0.0)}


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays: both are sorted as one, and a token of b meets one of a that is
    left of its kind."""
    marked = lambda xs, side: F.transform(F.array_compact(xs), lambda t: F.struct(t.alias("t"), F.lit(side).alias("side")))
    start = F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("left"), F.lit(0).alias("both"))

    def met(s: Column, x: Column) -> Column:
        left = F.when(s["t"].eqNullSafe(x["t"]), s["left"]).otherwise(0)
        own = x["side"] == 0
        return F.struct(x["t"].alias("t"), F.when(own, left + 1).otherwise(F.greatest(left - 1, F.lit(0))).alias("left"), (s["both"] + F.when(~own & (left > 0), 1).otherwise(0)).alias("both"))

    return F.aggregate(F.array_sort(F.concat(marked(a, 0), marked(b, 1))), start, met, lambda s: s["both"])


def token_f1(predicted: Column, gold: Column) -> Column:
    n, m = F.size(predicted), F.size(gold)
    score = lambda both: F.when(both > 0, 2.0 * (both / n) * (both / m) / (both / n + both / m)).otherwise(0.0)
    return F.element_at(F.transform(F.array(overlap(predicted, gold)), score), 1)  # the overlap is worked out once


def bleu1(predicted: Column, gold: Column) -> Column:
    n, m = F.size(predicted), F.size(gold)
    brevity = F.when(n >= m, 1.0).otherwise(F.exp(1 - m / n))
    return F.when(n > 0, brevity * overlap(predicted, gold) / n).otherwise(0.0)


def summary(rows: DataFrame, by: str, values: list[str], digits: int = 4) -> DataFrame:
    """Means by type and over all rows (null skipped), and the mean of the type means as 'macro'."""
    means = rows.rollup(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values], F.grouping(by).alias("all"))
    typed = means.select(F.when(F.col("all") == 1, "overall").otherwise(F.col(by).cast("string")).alias("level"), "n", *values, "all")
    macro = typed.where("all = 0").agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values]).select(F.lit("macro").alias("level"), "n", *values)
    return typed.drop("all").unionByName(macro).select("level", F.col("n").cast("long").alias("n"), *[F.round(v, digits).alias(v) for v in values])


def rank_metrics(ranks: DataFrame, cutoffs: tuple[int, ...]) -> DataFrame:
    """hit@k and mean reciprocal rank from (query_id, rank of the first gold document or null)."""
    hits = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 4).alias(f"hit_{k}") for k in cutoffs]
    return ranks.agg(F.count(F.lit(1)).alias("n"), *hits, F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 4).alias("mrr"))
