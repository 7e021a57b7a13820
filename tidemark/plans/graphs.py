"""Graph queries: conversations and events as nodes and edges, checks, summaries, expansion and closure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph
from .common import table


def _event_id():
    return F.concat(F.lit("event::"), F.col("conv_id").cast("string"), F.lit("::"), F.col("turn").cast("string"))


def g1_nodes(spark, d) -> DataFrame:
    t = table(spark, d, "conversations")
    events = t.select(_event_id().alias("id"), F.lit("event").alias("node_type"))
    scopes = t.select(F.explode(F.array(F.concat(F.lit("scope::session::"), F.col("conv_id").cast("string")), F.concat(F.lit("scope::speaker::"), F.col("role")))).alias("id"), F.lit("scope").alias("node_type"))
    return events.unionByName(scopes).distinct()


def g1_edges(spark, d) -> DataFrame:
    t = table(spark, d, "conversations").withColumn("src", _event_id())
    ends = F.array(F.struct(F.lit("IN_SCOPE").alias("type"), F.concat(F.lit("scope::session::"), F.col("conv_id").cast("string")).alias("dst")), F.struct(F.lit("MENTIONS").alias("type"), F.concat(F.lit("scope::speaker::"), F.col("role")).alias("dst")))
    return t.select("src", F.explode(ends).alias("e")).select("e.type", "src", "e.dst")


def g4_upsert(spark, d) -> DataFrame:
    n = table(spark, d, "events").select(F.col("user_id").alias("id"), "event_type", "ts", "event_id")
    return graph.upsert(n, ["ts", "event_id"]).select("id", "event_type", "event_id")


def g5_edge_dedup(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.when(F.col("event_type") == "error", "CONFLICTS_WITH").otherwise("NEXT").alias("type"), F.col("user_id").alias("src"), (F.col("event_id") % 40).alias("dst"))
    return graph.distinct_edges(e)


def g6_problems(spark, d) -> DataFrame:
    """The graph of conversations with edges to scopes of sources that are no nodes."""
    extra = table(spark, d, "conversations").where("turn = 0").select(F.lit("IN_SCOPE").alias("type"), _event_id().alias("src"), F.lit("scope::none").alias("dst"))
    return graph.problems(g1_nodes(spark, d), g1_edges(spark, d).unionByName(extra))


def g7_summary(spark, d) -> DataFrame:
    e = table(spark, d, "events").groupingSets([["event_type"], ["user_id"], []], "event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return e.select("event_type", "user_id", "n")


def _next(spark, d) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("event_id").alias("src"), F.lead("event_id").over(by).alias("dst")).where("dst is not null")


def g8_reachable(spark, d) -> DataFrame:
    seeds = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("seed"), F.col("event_id").alias("id"))
    return graph.reachable(_next(spark, d), seeds, 3)


def j3_one_hop(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type")
    return _next(spark, d).join(e, F.col("dst") == F.col("event_id")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_edges"), F.min("src").alias("least_src"))


def j5_closure(spark, d) -> DataFrame:
    s = table(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("state_id"), F.col("event_id").alias("claim_id"), "value")
    return graph.closed(s.select("state_id", "claim_id"), s.where("value < 40").select("claim_id"))


def j8_unique_alias(spark, d) -> DataFrame:
    """Orders all of whose lines have one return flag."""
    return graph.unique_alias(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("alias"), F.col("l_returnflag").alias("id")))


def j9_binding_gate(spark, d) -> DataFrame:
    """Conversations whose speakers are known and share none with those asked for are blocked."""
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("own"))
    return t.select("conv_id", (~F.arrays_overlap("own", F.array(F.lit("system"), F.lit("tool")))).alias("blocked"))


_NEXT = "nx AS (SELECT src, dst FROM (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)"
QUERIES = {
    "g1_nodes": (g1_nodes, "SELECT 'event::' || conv_id || '::' || turn AS id, 'event' AS node_type FROM conversations UNION SELECT 'scope::session::' || conv_id, 'scope' FROM conversations UNION SELECT 'scope::speaker::' || role, 'scope' FROM conversations"),
    "g1_edges": (g1_edges, "SELECT 'IN_SCOPE' AS type, 'event::' || conv_id || '::' || turn AS src, 'scope::session::' || conv_id AS dst FROM conversations UNION ALL SELECT 'MENTIONS', 'event::' || conv_id || '::' || turn, 'scope::speaker::' || role FROM conversations"),
    "g4_upsert": (g4_upsert, "SELECT user_id AS id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1"),
    "g5_edge_dedup": (g5_edge_dedup, "WITH e AS (SELECT CASE WHEN event_type = 'error' THEN 'CONFLICTS_WITH' ELSE 'NEXT' END AS type, user_id AS s, event_id % 40 AS t FROM events) SELECT DISTINCT type, CASE WHEN type = 'CONFLICTS_WITH' THEN least(s, t) ELSE s END AS src, CASE WHEN type = 'CONFLICTS_WITH' THEN greatest(s, t) ELSE t END AS dst FROM e"),
    "g6_problems": (g6_problems, "SELECT DISTINCT 'dangling_end' AS rule, 'scope::none' AS id, 'IN_SCOPE dst' AS detail FROM conversations WHERE turn = 0"),
    "g7_summary": (g7_summary, "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())"),
    "g8_reachable": (g8_reachable, f"WITH RECURSIVE {_NEXT}, r AS (SELECT event_id AS seed, event_id AS id, 0 AS hop FROM events WHERE event_type = 'purchase' UNION ALL SELECT r.seed, nx.dst, r.hop + 1 FROM r JOIN nx ON nx.src = r.id WHERE r.hop < 3) SELECT seed, id, min(hop)::INT AS hop FROM r GROUP BY 1, 2"),
    "j3_one_hop": (j3_one_hop, f"WITH {_NEXT} SELECT event_type, count(*) AS n_edges, min(src) AS least_src FROM nx JOIN events ON event_id = dst GROUP BY 1"),
    "j5_closure": (j5_closure, "SELECT concat_ws(':', user_id::VARCHAR, event_type, strftime(ts, '%Y-%m-%d')) AS state_id FROM events GROUP BY 1 HAVING bool_and(value < 40)"),
    "j8_unique_alias": (j8_unique_alias, "SELECT l_orderkey AS alias, min(l_returnflag) AS id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1"),
    "j9_binding_gate": (j9_binding_gate, "SELECT conv_id, NOT bool_or(role IN ('system', 'tool')) AS blocked FROM conversations GROUP BY 1"),
}
