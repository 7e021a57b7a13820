"""Graph tables: nodes and edges from records, upserts, checks, summaries, expansion and closure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: What an edge of each type may join.
EDGE_ENDS = {"IN_SCOPE": ("event", "scope"), "MENTIONS": ("event", "scope"), "ASSERTS": ("event", "claim"), "HAS_TIME": ("claim", "time"), "OCCURRED_AT": ("event", "time"), "SUPPORTS": ("claim", "state"), "NEXT": ("event", "event")}


def upsert(nodes: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each node id by `order`."""
    return nodes.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("_r = 1").drop("_r")


def collisions(nodes: DataFrame) -> DataFrame:
    """Ids with more than one payload."""
    rest = [c for c in nodes.columns if c != "id"]
    return nodes.groupBy("id").agg(F.count_distinct(F.to_json(F.struct(*rest))).alias("payloads")).where("payloads > 1")


def distinct_edges(edges: DataFrame, undirected: tuple[str, ...] = ("CONFLICTS_WITH",)) -> DataFrame:
    """Edges once each; those of undirected types by their sorted ends."""
    flip = F.col("type").isin(*undirected) & (F.col("src") > F.col("dst"))
    return edges.select("type", F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("dst")).distinct()


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, id, detail): dangling ends, unknown edge types, ends of the wrong kind, colliding nodes."""
    kinds = nodes.select("id", "node_type").dropDuplicates(["id"])
    ends = edges.select("type", F.explode(F.array(F.struct(F.lit("src").alias("side"), F.col("src").alias("id")), F.struct(F.lit("dst").alias("side"), F.col("dst").alias("id")))).alias("e")).select("type", "e.side", "e.id")
    due = F.lit(None).cast("string")
    for t, (a, b) in EDGE_ENDS.items():
        due = F.when(F.col("type") == t, F.when(F.col("side") == "src", a).otherwise(b)).otherwise(due)
    seen = ends.join(kinds, "id", "left").withColumn("due", due)
    rule = F.when(F.col("due").isNull(), "unknown_type").when(F.col("node_type").isNull(), "dangling_end").when(F.col("node_type") != F.col("due"), "wrong_end")
    found = seen.select(rule.alias("rule"), "id", F.concat_ws(" ", "type", "side").alias("detail")).where("rule is not null")
    return found.unionByName(collisions(nodes).select(F.lit("collision").alias("rule"), "id", F.col("payloads").cast("string").alias("detail"))).distinct()


def reachable(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, id, hop): what each seed (seed, id) reaches within `hops` steps over edges (src, dst), with the least hop.

    A frontier join a step; what was visited leaves by anti join, and a step is written, so it costs its frontier.
    """
    seen = seeds.select("seed", "id", F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.join(edges, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def components(links: DataFrame) -> DataFrame:
    """(id, comp): one id of its component, the same for all, for every id that undirected links (a, b) of unlike ends touch.

    A round maps each id to the neighbour, or itself, that comes first by a hash drawn anew, and keeps links between what
    is left; by chance about half of the ids go, on chains too, so all rounds together cost little more than the first.
    The maps are then joined from the last, the smallest, back.
    """
    sides = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    links = cut(links.where("a <> b").select(*sides("a", "b")).distinct())
    moves = []
    while not links.isEmpty():
        drawn = lambda c, n=len(moves): F.struct(F.xxhash64(c, F.lit(n)).alias("h"), F.col(c).alias("id"))
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves.append(cut(both.groupBy("a").agg(F.min(drawn("b")).alias("near")).select(F.col("a").alias("id"), F.least("near", drawn("a"))["id"].alias("comp"))))
        to = lambda c: moves[-1].select(F.col("id").alias(c), F.col("comp").alias(f"{c}_to"))
        links = cut(links.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to").select(*sides("a_to", "b_to")).distinct())
    if not moves:
        return links.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    labels = moves.pop()
    while moves:
        last = labels.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
        labels = cut(moves.pop().join(last, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")))
    return labels


def closed(states: DataFrame, kept: DataFrame) -> DataFrame:
    """States of (state_id, claim_id) rows all of whose claims are kept: relational division by an anti join."""
    missing = states.join(kept, "claim_id", "left_anti").select("state_id").distinct()
    return states.select("state_id").distinct().join(missing, "state_id", "left_anti")


def unique_alias(pairs: DataFrame) -> DataFrame:
    """Aliases of (alias, id) rows that name one id only."""
    return pairs.groupBy("alias").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").select("alias", "id")


def one_hop(seeds: DataFrame, claims: DataFrame, states: DataFrame) -> DataFrame:
    """(query_id, event_id, claim_id, state_id) reached from seeds (query_id, event_id): their claims (event_id, claim_id) and
    the states (claim_id, state_id) of these; a claim without a state keeps its row, an event without claims has none."""
    return seeds.select("query_id", "event_id").distinct().join(claims.select("event_id", "claim_id").distinct(), "event_id").join(states.select("claim_id", "state_id").distinct(), "claim_id", "left").select("query_id", "event_id", "claim_id", "state_id")
