"""Relation-aware expansion for many questions at once, to the fixpoint: a state per path, one written round after another."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


class Expansion(NamedTuple):
    """What questions reach: claims (query_id, claim_id, hop, seed_rank, relevance, open), states (query_id, state_id, score,
    hop, place), events (query_id, event_id, place), relations (query_id, type, src, dst)."""

    claims: DataFrame
    states: DataFrame
    events: DataFrame
    relations: DataFrame


def state_evidence(states: DataFrame, support: DataFrame, relations: DataFrame) -> DataFrame:
    """(state_id, claim_id): the claims that prove a state (state_id, primary_claim_id, support (state_id, claim_id)).

    With a primary claim: that claim, those of its support that take part in a relation (src, dst), and the claims these are
    related to; without one all its support.
    """
    held = support.select("state_id", "claim_id").distinct()
    both = relations.select("src", "dst").unionByName(relations.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    led = states.where("primary_claim_id is not null").select("state_id", F.col("primary_claim_id").alias("claim_id"))
    witness = held.join(led.select("state_id"), "state_id", "left_semi").join(both.select(F.col("src").alias("claim_id")).distinct(), "claim_id", "left_semi")
    core = led.unionByName(witness.select("state_id", "claim_id")).distinct()
    far = core.join(both, F.col("claim_id") == F.col("src")).select("state_id", F.col("dst").alias("claim_id"))
    return core.unionByName(far).unionByName(held.join(led.select("state_id"), "state_id", "left_anti")).distinct()


def question_weights(questions: DataFrame, claims: DataFrame) -> DataFrame:
    """questions (query_id, terms, …) with `weights` (term, w) and their sum `whole`: rare terms of the claims' terms weigh more."""
    asked = questions.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    seen = claims.select(F.explode(F.array_distinct("terms")).alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = claims.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    weighed = asked.join(seen, "term", "left").crossJoin(F.broadcast(n)).select("query_id", "term", (F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("w"))  # n is one row
    lists = weighed.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("weights"))
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x["w"])
    return questions.join(lists, "query_id", "left").withColumn("whole", F.coalesce(total, F.lit(0.0)))


def relevance(terms: Column) -> Column:
    """The share of a question's weights whose terms a claim holds, rounded so that equal sums are equal."""
    met = F.aggregate(F.filter("weights", lambda x: F.array_contains(terms, x["term"])), F.lit(0.0), lambda a, x: a + x["w"])
    return F.round(F.coalesce(F.when(F.col("whole") > 0, met / F.col("whole")), F.lit(0.0)), 9)


def expand(seeds: DataFrame, questions: DataFrame, claims: DataFrame, relations: DataFrame, states: DataFrame, support: DataFrame, evidence: DataFrame, decay: float = 0.7) -> Expansion:
    """All that questions (query_id, terms, subjects, wide) reach from seeds (query_id, kind, id, rank) of kind event, claim or state.

    claims: claim_id, event_id, subject, dimension, terms; relations: type, src, dst, evidence_event_ids; states: state_id,
    subject, dimension, many, current; support and evidence: state_id, claim_id. Ids of events, claims and states are of
    one type within each kind.

    Of a seed event all claims are reached, but only those most relevant to the question, and those about the same state,
    open relations; if the question has no terms or none fit, all do. An open claim leads over relations, in both
    directions, to claims about the same state, or from an unkeyed claim to an unkeyed one, which opens nothing further.
    Claims lead to the states they support, and states to their evidence; for a wide question a state of many values leads
    to its current siblings. `subjects`, where given, shut out claims and states of other subjects, not those of none. A
    claim keeps the path that reached it in the earliest round: least hop, then seed rank, then greatest relevance, which
    decays by `decay` a relation but is never below the claim's own. A state's score is the best over its paths.

    Every round joins its frontier alone, with what was reached taken out by an anti join, is written, and is the last one
    if it finds nothing; relevance is worked out for reached claims only, never for all claims of all questions.
    """
    asked = cut(question_weights(questions.select("query_id", "terms", F.coalesce("subjects", F.array().cast("array<string>")).alias("subjects"), F.coalesce("wide", F.lit(False)).alias("wide")), claims))
    text = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    key = F.when((text("subject") != "") & (F.coalesce(F.col("dimension").cast("string"), F.lit("")) != ""), F.concat_ws("\x1f", text("subject"), F.col("dimension").cast("string")))
    known = cut(claims.select("claim_id", "event_id", text("subject").alias("of"), key.alias("key"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms")))
    kept = cut(states.select("state_id", text("subject").alias("of"), key.alias("key"), F.coalesce("many", F.lit(False)).alias("many"), F.coalesce("current", F.lit(True)).alias("current")))
    allowed = (F.size("subjects") == 0) | (F.col("of") == "") | F.array_contains("subjects", F.col("of"))
    keys = known.select("claim_id", "key")
    edges = relations.select("type", "src", "dst", F.col("src").alias("here"), F.col("dst").alias("there"), "evidence_event_ids")
    edges = edges.unionByName(edges.withColumns({"here": F.col("dst"), "there": F.col("src")})).join(keys.withColumnRenamed("claim_id", "here"), "here")
    edges = cut(edges.join(keys.select(F.col("claim_id").alias("there"), F.col("key").alias("far")), "there").where("key <=> far").drop("far"))

    def admitted(found: DataFrame, seen: DataFrame | None) -> DataFrame:
        """The best path of each newly reached claim: found has query_id, claim_id, hop, rank, carried, open."""
        if seen is not None:
            found = found.join(seen.select("query_id", "claim_id"), ["query_id", "claim_id"], "left_anti")
        best = found.groupBy("query_id", "claim_id").agg(F.min(F.struct("hop", "rank", (-F.col("carried")).alias("less"), (~F.col("open")).alias("shut"))).alias("p"))
        rows = best.join(known, "claim_id").join(asked.select("query_id", "weights", "whole", "subjects"), "query_id").where(allowed)
        return cut(rows.select("query_id", "claim_id", "event_id", "key", F.col("p.hop").alias("hop"), F.col("p.rank").alias("rank"), F.greatest(-F.col("p.less"), relevance(F.col("terms"))).alias("relevance"), (~F.col("p.shut")).alias("open")))

    def stated(found: DataFrame) -> DataFrame:
        """Paths (query_id, state_id, hop, rank, relevance) to states that the question may see."""
        rows = found.join(kept, "state_id").join(asked.select("query_id", "subjects", "wide"), "query_id").where(allowed)
        return rows.select("query_id", "state_id", "hop", "rank", "relevance", F.when(F.col("wide") & F.col("many"), F.col("key")).alias("group"))

    def grown(paths: DataFrame, seen: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(all paths to states with those to siblings, what of it is new, by its best path)."""
        score = F.round(1 / (1 + 0.25 * F.greatest(F.col("rank") - 1, F.lit(0))) + 0.75 * F.col("relevance") - 0.25 * F.col("hop"), 6)
        best = lambda df: df.withColumn("score", score).groupBy("query_id", "state_id").agg(F.max("score").alias("score"), F.max_by(F.struct("hop", "rank", "relevance"), "score").alias("p"), F.max("group").alias("group"))
        direct = cut(best(paths))
        fresh = direct if seen is None else direct.join(seen.select("query_id", "state_id"), ["query_id", "state_id"], "left_anti")
        near = fresh.where("group is not null").join(kept.where("many and current").select(F.col("state_id").alias("other"), F.col("key").alias("group")), "group").where("other <> state_id")
        near = near.groupBy("query_id", F.col("other").alias("state_id")).agg(F.max_by("p", "score").alias("p")).join(direct.select("query_id", "state_id"), ["query_id", "state_id"], "left_anti")
        if seen is not None:
            near = near.join(seen.select("query_id", "state_id"), ["query_id", "state_id"], "left_anti")
        own = near.join(support, "state_id").join(known.select("claim_id", "terms"), "claim_id").join(asked.select("query_id", "weights", "whole"), "query_id").groupBy("query_id", "state_id").agg(F.max(relevance(F.col("terms"))).alias("own"))
        beside = near.join(own, ["query_id", "state_id"], "left").select("query_id", "state_id", "p.hop", "p.rank", F.greatest("p.relevance", F.coalesce("own", F.lit(0.0))).alias("relevance"))
        every = cut(direct.select("query_id", "state_id", "score", "p").unionByName(best(stated(beside)).select("query_id", "state_id", "score", "p")))
        return every, every if seen is None else every.join(seen.select("query_id", "state_id"), ["query_id", "state_id"], "left_anti")

    def proofs(new: DataFrame) -> DataFrame:
        return new.join(evidence.select("state_id", "claim_id"), "state_id").select("query_id", "claim_id", "p.hop", "p.rank", F.col("p.relevance").alias("carried"), F.lit(True).alias("open"))

    of = lambda kind, name: seeds.where(F.col("kind") == kind).groupBy("query_id", F.col("id").alias(name)).agg(F.min("rank").alias("rank"))
    zero, none = F.lit(0).alias("hop"), F.lit(0.0).alias("carried")
    at_event = of("event", "event_id").join(known, "event_id").join(asked.select("query_id", "weights", "whole"), "query_id").withColumn("own", relevance(F.col("terms")))
    group = Window.partitionBy("query_id", "event_id")
    at_event = at_event.withColumn("best", F.max("own").over(group)).withColumn("about", F.collect_set(F.when(F.col("own") == F.col("best"), F.col("key"))).over(group))
    leads = (F.coalesce(F.size("weights"), F.lit(0)) < 1) | (F.col("best") <= 0) | (F.col("own") == F.col("best")) | F.coalesce(F.array_contains("about", F.col("key")), F.lit(False))
    found = at_event.select("query_id", "claim_id", zero, "rank", none, leads.alias("open")).unionByName(of("claim", "claim_id").select("query_id", "claim_id", zero, "rank", none, F.lit(True).alias("open")))
    state_log, new = grown(stated(of("state", "state_id").select("query_id", "state_id", zero, "rank", (1 / F.col("rank")).alias("relevance"))), None)
    frontier = admitted(found.unionByName(proofs(new)), None)
    claim_log, crossed, round_ = frontier.withColumn("round", F.lit(0)), None, 0
    while frontier.limit(1).count():
        round_ += 1
        paths = stated(frontier.join(support.select("state_id", "claim_id"), "claim_id").select("query_id", "state_id", "hop", "rank", "relevance"))
        every, new = grown(paths, state_log)
        state_log = cut(state_log.unionByName(every).groupBy("query_id", "state_id").agg(F.max("score").alias("score"), F.max_by("p", "score").alias("p")))
        step = cut(frontier.where("open").select("query_id", F.col("claim_id").alias("here"), "hop", "rank", "relevance").join(edges, "here"))
        passed = step.select("query_id", "type", "src", "dst", "evidence_event_ids", "rank", F.lit(round_).alias("round"))
        crossed = passed if crossed is None else crossed.unionByName(passed)
        found = step.select("query_id", F.col("there").alias("claim_id"), (F.col("hop") + 1).alias("hop"), "rank", (decay * F.col("relevance")).alias("carried"), F.col("key").isNotNull().alias("open"))
        frontier = admitted(found.unionByName(proofs(new)), claim_log)
        claim_log = cut(claim_log.unionByName(frontier.withColumn("round", F.lit(round_))))
    reached = [of("event", "event_id").select("query_id", "event_id", F.lit(-1).alias("round"), "rank"), claim_log.where("event_id is not null").select("query_id", "event_id", "round", "rank")]
    if crossed is not None:
        reached.append(crossed.select("query_id", F.explode("evidence_event_ids").alias("event_id"), "round", "rank"))
    events = reached[0]
    for more in reached[1:]:
        events = events.unionByName(more)
    first = events.groupBy("query_id", "event_id").agg(F.min(F.struct("round", "rank")).alias("at"))
    by = Window.partitionBy("query_id")
    lines = crossed.select("query_id", "type", "src", "dst").distinct() if crossed is not None else relations.select(F.lit(None).alias("query_id"), "type", "src", "dst").where("false")
    return Expansion(
        claim_log.select("query_id", "claim_id", "hop", F.col("rank").alias("seed_rank"), F.round("relevance", 6).alias("relevance"), "open"),
        state_log.select("query_id", "state_id", "score", F.col("p.hop").alias("hop"), F.row_number().over(by.orderBy(F.desc("score"), "state_id")).alias("place")),
        first.select("query_id", "event_id", F.row_number().over(by.orderBy("at", "event_id")).alias("place")),
        lines,
    )


def closed_pack(found: Expansion, claims: DataFrame, relations: DataFrame, evidence: DataFrame, most_events: int = 0, most_states: int = 0) -> Expansion:
    """What of an expansion stays within limits (0: none) of events and states a question, and is proved by what stays.

    The first events by place stay; of claims those whose event stays; states with all of their evidence among them, the
    best `most_states` of these; relations with both claims and all events that they cite. Evidence of unknown claims
    proves nothing, so such a state goes.
    """
    events = found.events.where(F.col("place") <= most_events) if most_events else found.events
    events = cut(events)
    here = events.select("query_id", "event_id")
    source = claims.select("claim_id", "event_id")
    kept = cut(found.claims.join(source, "claim_id").join(here, ["query_id", "event_id"], "left_semi").drop("event_id").select(*found.claims.columns))
    need = found.states.select("query_id", "state_id").join(evidence.select("state_id", "claim_id").distinct(), "state_id").join(source, "claim_id", "left")
    lacking = need.join(here, ["query_id", "event_id"], "left_anti").select("query_id", "state_id").distinct()
    proved = found.states.join(need.select("query_id", "state_id").distinct(), ["query_id", "state_id"], "left_semi").join(lacking, ["query_id", "state_id"], "left_anti")
    proved = proved.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("place")))
    states = proved.where(F.col("place") <= most_states) if most_states else proved
    ends = kept.select("query_id", "claim_id")
    lines = found.relations.join(ends.withColumnRenamed("claim_id", "src"), ["query_id", "src"], "left_semi").join(ends.withColumnRenamed("claim_id", "dst"), ["query_id", "dst"], "left_semi")
    cited = lines.join(relations.select("type", "src", "dst", F.explode("evidence_event_ids").alias("event_id")), ["type", "src", "dst"]).join(here, ["query_id", "event_id"], "left_anti")
    lines = lines.join(cited.select("query_id", "type", "src", "dst").distinct(), ["query_id", "type", "src", "dst"], "left_anti")
    return Expansion(kept, states.select(*found.states.columns), events, lines.select(*found.relations.columns))
