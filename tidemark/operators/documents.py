"""Documents of graph rows, the texts that retrieval searches: events, claims, states and scopes with what belongs to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import top

#: Fields of each kind's document, in order, and the labels of a claim's and a state's details.
EVENT_FIELDS = ("dialog_id", "session_id", "date", "occurred_at", "group", "speaker", "text", "image_caption", "image_query")
SCOPE_FIELDS = ("scope_type", "label", "value")
STATE_FIELDS = ("canonical_subject", "subject", "state_domain", "state_target", "state_dimension", "facet_key", "slot_type", "value", "status", "summary")
CLAIM_FIELDS = ("subject", "predicate", "object", "facet_key", "value", "scope_hint", "time_role", "phase_role", "time_value")
CLAIM_LABELS = {"canonical_subject": "canonical_subject", "subject_key": "subject_key", "state_dimension": "dimension", "state_domain": "domain", "state_target": "target", "slot_type": "slot_type", "polarity": "polarity", "certainty": "certainty"}
#: Events that the document of a scope takes, by its type, and claims of each.
SCOPE_EVENTS, OTHER_EVENTS, EVENT_CLAIMS = {"group": 1200, "project": 1200}, 240, 2


def joined(df: DataFrame, fields: tuple[str, ...]) -> Column:
    """The fields that df has and a row fills, with a space between."""
    parts = [F.col(f"`{c}`").cast("string") for c in fields if c in df.columns]
    return F.array_join(F.filter(F.array(F.lit(""), *parts), lambda x: x != ""), " ")


def claim_text(df: DataFrame) -> Column:
    """A claim in words, its time in brackets, and what identifies its state in parentheses, each by its label."""
    have = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    time = F.when((have("time_role") != "") | (have("time_value") != ""), F.concat(F.lit("["), have("time_role"), F.lit("="), have("time_value"), F.lit("; normalized="), have("normalized_time_value"), F.lit("]")))
    head = F.concat_ws(" ", have("dialog_id"), have("subject"), F.concat(have("facet_key"), F.lit(":")), have("value"))
    labels = F.filter(F.array(F.lit(""), *[F.when(have(c) != "", F.concat(F.lit(f"{label}="), have(c))).otherwise("") for c, label in CLAIM_LABELS.items()]), lambda x: x != "")
    more = F.when(F.size(labels) > 0, F.concat(F.lit("("), F.array_join(labels, "; "), F.lit(")")))
    return F.trim(F.concat_ws(" ", head, time, more))


def _lists(rows: DataFrame, by: str, order: list[str], text: str, name: str) -> DataFrame:
    """(by, name): the texts of each `by`, in order, with a space between."""
    listed = F.sort_array(F.collect_list(F.struct(*order, text)))
    return rows.groupBy(by).agg(F.array_join(F.filter(F.transform(listed, lambda x: x[text]), lambda x: x != ""), " ").alias(name))


def event_documents(events: DataFrame, claims: DataFrame, event_scopes: DataFrame, scopes: DataFrame, states: DataFrame | None = None, support: DataFrame | None = None) -> DataFrame:
    """(event_id, document): an event's fields, then its claims (claim_id, event_id, ord), its scopes (event_id, scope_id)
    and, if given, the states its claims support (state_id, claim_id), each in the order of its ord or id. What an event
    gathers is its own claims and scopes."""
    said = _lists(claims.select("event_id", "ord", "claim_id", claim_text(claims).alias("t")), "event_id", ["ord", "claim_id"], "t", "claims")
    where = event_scopes.select("event_id", "scope_id").distinct().join(scopes.select("scope_id", joined(scopes, SCOPE_FIELDS).alias("t")), "scope_id")
    out = events.select("event_id", joined(events, EVENT_FIELDS).alias("own")).join(said, "event_id", "left").join(_lists(where, "event_id", ["scope_id"], "t", "scopes"), "event_id", "left")
    parts = ["own", "claims", "scopes"]
    if states is not None:
        held = claims.select("event_id", "claim_id").join(support.select("state_id", "claim_id"), "claim_id").select("event_id", "state_id").distinct()
        held = held.join(states.select("state_id", joined(states, ("subject", "state_dimension", "value", "status")).alias("t")), "state_id")
        out = out.join(_lists(held, "event_id", ["state_id"], "t", "states"), "event_id", "left")
        parts.append("states")
    return out.select("event_id", F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda x: x != ""), " ").alias("document"))


def state_documents(states: DataFrame, support: DataFrame, claims: DataFrame, events: DataFrame) -> DataFrame:
    """(state_id, document): a state's fields, the claims that support it (state_id, claim_id, ord) and the events of these.
    What a state gathers is its own support."""
    held = support.select("state_id", "claim_id", "ord").join(claims.select("claim_id", "event_id", claim_text(claims).alias("t")), "claim_id")
    said = _lists(held, "state_id", ["ord", "claim_id"], "t", "claims")
    seen = held.groupBy("state_id", "event_id").agg(F.min("ord").alias("ord")).join(events.select("event_id", joined(events, EVENT_FIELDS).alias("t")), "event_id")
    out = states.select("state_id", joined(states, STATE_FIELDS).alias("own")).join(said, "state_id", "left").join(_lists(seen, "state_id", ["ord", "event_id"], "t", "events"), "state_id", "left")
    return out.select("state_id", F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in ("own", "claims", "events")]), lambda x: x != ""), " ").alias("document"))


def scope_documents(scopes: DataFrame, event_scopes: DataFrame, events: DataFrame, claims: DataFrame) -> DataFrame:
    """(scope_id, document): a scope's fields and id, then its first events (event_id, scope_id, ord), 1,200 for groups and
    projects and 240 for others, each with its first two claims (claim_id, event_id, ord).

    The limits are the feature: ranks are limited before the shuffle, so a scope that holds a third of all events sends its
    first 1,200 from each task, and no document grows beyond them.
    """
    limit = F.lit(OTHER_EVENTS)
    for kind, n in SCOPE_EVENTS.items():
        limit = F.when(F.col("scope_type") == kind, n).otherwise(limit)
    most = max(OTHER_EVENTS, *SCOPE_EVENTS.values())
    first = top(event_scopes.select("scope_id", "event_id", "ord"), most, ["scope_id"], [F.col("ord"), F.col("event_id")], "at")
    kept = first.join(scopes.select("scope_id", limit.alias("most")), "scope_id").where("at <= most").select("scope_id", "event_id", "at")
    ids = kept.select("event_id").distinct()
    two = top(claims.select("event_id", "claim_id", "ord", joined(claims, CLAIM_FIELDS).alias("t")).join(ids, "event_id", "left_semi"), EVENT_CLAIMS, ["event_id"], [F.col("ord"), F.col("claim_id")], "n")
    said = events.select("event_id", F.lit(0).alias("n"), joined(events, EVENT_FIELDS).alias("t")).join(ids, "event_id", "left_semi").unionByName(two.select("event_id", "n", "t"))
    body = _lists(kept.join(said, "event_id"), "scope_id", ["at", "n"], "t", "body")
    own = scopes.select("scope_id", joined(scopes, (*SCOPE_FIELDS, "scope_id")).alias("own"))
    return own.join(body, "scope_id", "left").select("scope_id", F.array_join(F.filter(F.array("own", F.coalesce("body", F.lit(""))), lambda x: x != ""), " ").alias("document"))
