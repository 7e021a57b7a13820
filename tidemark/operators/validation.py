"""Validation of graph tables: one named rule a fault, as (rule, id, detail).

nodes have an `id`, a `node_type` and the fields of their type, edges `type`, `src`, `dst` and theirs; a table without one
of the fields below is read as if that field were null. Rules that look at one row share a scan; the others are joins and
aggregates over nodes and edges that are written once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .claims import TIME_ROLES, domain, facet, lasting, time_role
from .lineage import cut

#: Node types, and what an edge of each type joins.
NODE_TYPES = ("event", "claim", "state", "scope", "time")
EDGE_ENDS = {
    "MENTIONS": ("event", "scope"),
    "IN_SCOPE": ("event", "scope"),
    "ASSERTS": ("event", "claim"),
    "OCCURRED_AT": ("event", "time"),
    "HAS_TIME": ("claim", "time"),
    "CORRECTS": ("claim", "claim"),
    "SUPERSEDES": ("claim", "claim"),
    "CONFLICTS_WITH": ("claim", "claim"),
    "SUPPORTS": ("claim", "state"),
    "CURRENT_AFTER": ("state", "time"),
    "CURRENT_STATE_OF": ("state", "scope"),
}
RELATIONS = ("CORRECTS", "SUPERSEDES", "CONFLICTS_WITH")
#: What tells which state a claim is about, what every state says, and fields that answers would leak by.
IDENTITY = ("canonical_subject", "subject_key", "state_domain", "slot_type", "state_target", "state_dimension", "dimension_source", "dimension_reason")
STATE_SAYS = {"fact_type": "state", "temporal_status": "ongoing", "intent": "none"}
STATUSES = ("current", "historical", "ambiguous")
GOLD = ("A", "R", "answer", "options", "gold_evidence", "evidence")

_TEXTS = ("node_id", "time_role", "value", "subject", "time_value", "facet_key", "source_event_id", "dialog_id", "status", "primary_claim_id", "current_after", *IDENTITY, *STATE_SAYS)
_LISTS = ("support_claim_ids", "support_event_ids", "scope_ids")


def _whole(df: DataFrame, keys: tuple[str, ...], texts: tuple[str, ...], lists: tuple[str, ...], more: tuple[str, ...] = ()) -> DataFrame:
    """df with every field that rules read, null where it has none, and a list of the fields `more` that it has and fills."""
    have = set(df.columns)
    filled = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in sorted(more) if c in have]))
    return df.select(
        *[F.col(c).cast("string").alias(c) for c in keys], *[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in texts],
        *[(F.col(c) if c in have else F.lit(None)).cast("array<string>").alias(c) for c in lists], filled.alias("gold"),
    )


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _blank(c: str) -> Column:
    return F.trim(_text(c)) == ""


def _told(df: DataFrame, id_: Column, *rules: tuple[str, Column, Column | str | list[tuple[Column, Column]]]) -> DataFrame:
    """A row for each rule (name, fault, detail) that a row of df breaks, or for each of a rule's (fault, detail) in a list.

    Rows without a fault go by plain conditions before anything is built of them.
    """
    each = [(name, fault & more, text) for name, fault, detail in rules for more, text in (detail if isinstance(detail, list) else [(F.lit(True), F.lit(detail) if isinstance(detail, str) else detail)])]
    found = F.array(*[F.when(fault, F.struct(F.lit(name).alias("rule"), F.coalesce(text.cast("string"), F.lit("")).alias("detail"))) for name, fault, text in each])
    faulty = df.where(reduce(lambda x, y: x | y, [F.coalesce(fault, F.lit(False)) for _, fault, _ in each]))
    return faulty.select(id_.alias("id"), F.explode(found).alias("p")).where("p is not null").select("p.rule", "id", "p.detail")


def _missing(fields: tuple[str, ...]) -> list[tuple[Column, Column]]:
    return [(_blank(c), F.lit(c)) for c in fields]


def _by_row(nodes: DataFrame) -> list[DataFrame]:
    """Rules that one node breaks by itself."""
    is_ = lambda kind: F.col("node_type") == kind
    role, time = _text("time_role"), _text("time_value")
    claim_lasts = is_("claim") & F.col("lasts")
    whole = (~_blank("state_domain")) & (~_blank("state_target"))
    dimension = whole & (_text("state_dimension") != F.concat("state_domain", F.lit(":"), "state_target"))
    support, unlike = F.col("support_claim_ids"), [(_text(c) != said, F.concat_ws("=", F.lit(c), _text(c))) for c, said in STATE_SAYS.items()]
    return [
        _told(
            nodes, F.col("id"),
            ("node_id_invalid", _blank("node_id") | (F.col("node_id") != F.col("id")), _text("node_id")),
            ("unsupported_node_type", ~F.coalesce(F.col("node_type").isin(*NODE_TYPES), F.lit(False)), _text("node_type")),
            ("unsupported_time_role", is_("time") & ~role.isin(*TIME_ROLES, "current_after"), role),
            ("claim_time_role_unsupported", is_("claim") & (role != "") & ~role.isin(*TIME_ROLES, "current_after"), role),
            ("claim_time_role_missing", is_("claim") & (time != "") & (role == ""), time),
            ("claim_time_value_missing", is_("claim") & (role != "") & (time == ""), role),
            ("claim_state_field_missing", claim_lasts, _missing(IDENTITY)),
            ("claim_state_domain_mismatch", claim_lasts & ~_blank("state_domain") & (F.col("state_domain") != F.col("due_domain")), _text("state_domain")),
            ("claim_state_dimension_mismatch", claim_lasts & dimension, _text("state_dimension")),
            ("claim_slot_type_invalid", claim_lasts & ~_text("slot_type").isin("single", "object_scoped"), _text("slot_type")),
            ("forbidden_gold_field", F.size("gold") > 0, F.array_join("gold", ",")),
        ),
        _told(
            nodes.where("node_type = 'state'"), F.col("id"),
            ("state_semantics_invalid", F.lit(True), unlike),
            ("state_status_invalid", ~_text("status").isin(*STATUSES), _text("status")),
            ("state_support_not_list", support.isNull(), ""),
            ("state_support_missing", F.coalesce(F.size(F.coalesce(support, F.array().cast("array<string>"))) == 0, F.lit(True)), ""),
            ("state_support_duplicate", F.size(support) != F.size(F.array_distinct(support)), ""),
            ("state_support_events_not_list", F.col("support_event_ids").isNull(), ""),
            ("state_primary_not_supported", ~F.coalesce(F.array_contains(support, F.col("primary_claim_id")), F.lit(False)), _text("primary_claim_id")),
            ("state_identity_field_missing", F.lit(True), _missing(IDENTITY)),
            ("state_dimension_mismatch", dimension, _text("state_dimension")),
            ("state_scope_missing", F.coalesce(F.size("scope_ids") < 1, F.lit(True)), ""),
        ),
    ]


def _ends(nodes: DataFrame, side: str, fields: tuple[str, ...]) -> DataFrame:
    return nodes.select(F.col("id").alias(side), F.struct("node_type", *fields).alias(f"{side}_node"))


def _dialog_order(dialog: Column) -> Column:
    """Place of a dialogue id `D<session>:<turn>`: session and turn as numbers."""
    part = lambda i: F.regexp_extract(dialog, r"(\d+):(\d+)", i).try_cast("int")
    return F.struct(F.coalesce(part(1), F.lit(0)), F.coalesce(part(2), F.lit(0)))


def _by_edge(nodes: DataFrame, edges: DataFrame) -> list[DataFrame]:
    """Rules about an edge and its two ends."""
    of = ("time_role", "source_event_id", "dialog_id", "subject_key", "state_domain", "state_dimension")
    known = edges.join(_ends(nodes, "src", of), "src", "left").join(_ends(nodes, "dst", of), "dst", "left")
    ends = F.create_map(*[x for t, (a, b) in EDGE_ENDS.items() for x in (F.lit(t), F.lit(f"{a}->{b}"))])[F.col("type")]
    types = F.concat_ws("->", "src_node.node_type", "dst_node.node_type")
    both = F.col("src_node").isNotNull() & F.col("dst_node").isNotNull()
    whole = both & ends.isNotNull()
    relation = whole & F.col("type").isin(*RELATIONS)
    evidence = F.coalesce("evidence_event_ids", F.array().cast("array<string>"))
    field = lambda side, c: F.coalesce(F.col(f"{side}_node.{c}"), F.lit(""))
    same = reduce(lambda x, y: x & y, [field("src", c) == field("dst", c) for c in of[3:]])
    later = (_dialog_order(field("src", "dialog_id")) > _dialog_order(field("dst", "dialog_id"))) | (field("src", "dialog_id") == field("dst", "dialog_id"))
    name = F.concat(F.col("type"), F.lit(":"), F.col("src"), F.lit("->"), F.col("dst"))
    outside = F.filter(evidence, lambda e: ~F.array_contains(F.array(field("src", "source_event_id"), field("dst", "source_event_id")), e))
    judged = known.withColumn("whole", whole)
    cited = judged.where(relation).select(name.alias("edge"), F.explode(F.array_distinct(evidence)).alias("e"), outside.alias("outside"))
    cited = cited.join(nodes.select(F.col("id").alias("e"), (F.col("node_type") == "event").alias("there")), "e", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    pairs = edges.where(F.col("type").isin(*RELATIONS)).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sort_array(F.collect_set("type")).alias("types"))
    return [
        _told(
            judged, name,
            ("unsupported_edge_type", ends.isNull(), _text("type")),
            ("edge_missing_endpoint", ends.isNotNull() & ~both, ""),
            ("edge_endpoint_type_mismatch", whole & (types != ends), types),
            ("has_time_role_mismatch", whole & (F.col("type") == "HAS_TIME") & (_text("time_role") != field("dst", "time_role")), F.concat_ws(":", _text("time_role"), field("dst", "time_role"))),
            ("relation_reason_missing", relation & (F.btrim(_text("reason"), F.lit(" \t\r\n'\"`.,:;!?()[]{}")) == ""), ""),
            ("relation_evidence_missing", relation & (F.size(evidence) == 0), ""),
            ("relation_direction_invalid", relation & (F.col("type") != "CONFLICTS_WITH") & ~later, F.concat_ws("->", field("src", "dialog_id"), field("dst", "dialog_id"))),
            ("relation_state_dimension_mismatch", relation & ~same, ""),
        ),
        _told(cited, F.col("edge"), ("relation_evidence_event_missing", ~F.col("there"), F.col("e")), ("relation_evidence_not_endpoint", F.col("there") & F.array_contains("outside", F.col("e")), F.col("e"))),
        _told(pairs.where(F.size("types") > 1), F.concat_ws(":", "a", "b"), ("relation_pair_type_conflict", F.lit(True), F.array_join("types", ","))),
    ]


def _by_support(nodes: DataFrame, edges: DataFrame, supported: DataFrame) -> list[DataFrame]:
    """Rules about states, the claims they declare, and the events behind these."""
    states = nodes.where("node_type = 'state'")
    compare = ("subject_key", "state_domain", "state_dimension")
    listed = states.select(F.col("id").alias("state"), F.posexplode("support_claim_ids").alias("at", "claim"), *[F.col(c).alias(f"state_{c}") for c in compare])
    claims = nodes.select(F.col("id").alias("claim"), F.struct("node_type", "source_event_id", *compare).alias("node"))
    drawn = edges.where("type = 'SUPPORTS'").select(F.col("src").alias("claim"), F.col("dst").alias("state")).distinct()
    met = cut(listed.join(claims, "claim", "left").join(drawn.withColumn("drawn", F.lit(True)), ["claim", "state"], "left"))
    is_claim = F.coalesce(F.col("node.node_type") == "claim", F.lit(False))
    unlike = [(~F.col(f"node.{c}").eqNullSafe(F.col(f"state_{c}")), F.concat_ws(":", "claim", F.lit(c))) for c in compare]
    in_order = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(is_claim & (F.col("node.source_event_id") != ""), F.struct("at", F.col("node.source_event_id").alias("e"))))), lambda x: x["e"]))
    due = states.select(F.col("id").alias("state"), F.coalesce("support_event_ids", F.array().cast("array<string>")).alias("own")).join(met.groupBy("state").agg(in_order.alias("due")), "state", "left")
    due = due.withColumn("due", F.coalesce("due", F.array().cast("array<string>")))
    events = states.select(F.col("id").alias("state"), F.explode(F.array_distinct("support_event_ids")).alias("e")).join(nodes.select(F.col("id").alias("e"), "node_type"), "e", "left")
    undeclared = drawn.join(met.select("claim", "state"), ["claim", "state"], "left_anti")
    counts = nodes.where("node_type = 'claim'").select("id", "lasts").join(supported.groupBy(F.col("claim").alias("id")).agg(F.count_distinct("state").alias("n")), "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = ("subject", "value", *IDENTITY)
    primary = states.select("id", "primary_claim_id", *[F.col(c).alias(f"state_{c}") for c in own]).join(nodes.select(F.col("id").alias("primary_claim_id"), F.struct("node_type", *own).alias("node")), "primary_claim_id", "left")
    differ = [(~F.col(f"node.{c}").eqNullSafe(F.col(f"state_{c}")), F.lit(c)) for c in ("value", *IDENTITY)]
    differ.append((F.coalesce("node.canonical_subject", F.lit("")) != F.coalesce("state_subject", F.lit("")), F.lit("subject")))
    return [
        _told(
            met, F.col("state"),
            ("state_support_invalid", ~is_claim, F.col("claim")),
            ("state_support_edge_missing", is_claim & F.col("drawn").isNull(), F.col("claim")),
            ("state_support_identity_mismatch", F.col("node").isNotNull(), unlike),
        ),
        _told(due, F.col("state"), ("state_support_events_mismatch", F.col("own") != F.col("due"), F.concat_ws(" for ", F.array_join("own", ","), F.array_join("due", ",")))),
        _told(events, F.col("state"), ("state_support_event_invalid", ~F.coalesce(F.col("node_type") == "event", F.lit(False)), F.col("e"))),
        _told(undeclared, F.col("state"), ("state_support_edge_undeclared", F.lit(True), F.col("claim"))),
        _told(counts, F.col("id"), ("claim_state_support_count", F.col("lasts") & (F.col("n") != 1), F.col("n")), ("nonpersistent_claim_supports_state", ~F.col("lasts") & (F.col("n") > 0), "")),
        _told(
            primary, F.col("id"),
            ("state_primary_invalid", ~F.coalesce(F.col("node.node_type") == "claim", F.lit(False)), F.coalesce("primary_claim_id", F.lit(""))),
            ("state_primary_field_mismatch", F.col("node").isNotNull(), differ),
        ),
    ]


def expected_status(nodes: DataFrame, edges: DataFrame, supported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((state, due), (state, a, b)): the status that relations ask of each state, and conflicts inside one state.

    A state with a claim that was corrected or superseded is historical; one whose claim conflicts with a claim of another
    state, neither historical, is ambiguous; all others are current.
    """
    relations = edges.where(F.col("type").isin(*RELATIONS)).select("type", "src", "dst").distinct()
    past = relations.where("type <> 'CONFLICTS_WITH'").join(supported, F.col("dst") == F.col("claim")).select("state").distinct().withColumn("past", F.lit(True))
    side = lambda c: supported.select(F.col("claim").alias(c), F.col("state").alias(f"{c}_state"))
    facing = relations.where("type = 'CONFLICTS_WITH'").join(side("src"), "src").join(side("dst"), "dst")
    facing = cut(facing.select("src", "dst", "src_state", "dst_state"))
    within = facing.where("src_state = dst_state").select(F.col("src_state").alias("state"), F.col("src").alias("a"), F.col("dst").alias("b"))
    of = lambda c: past.select(F.col("state").alias(f"{c}_state"), F.col("past").alias(f"{c}_past"))
    active = facing.where("src_state <> dst_state").join(of("src"), "src_state", "left").join(of("dst"), "dst_state", "left").where("src_past is null and dst_past is null")
    open_ = active.select(F.explode(F.array("src_state", "dst_state")).alias("state")).distinct().withColumn("open", F.lit(True))
    due = F.when(F.col("past"), "historical").when(F.col("open"), "ambiguous").otherwise("current")
    states = nodes.where("node_type = 'state'").select(F.col("id").alias("state")).distinct()
    return states.join(past, "state", "left").join(open_, "state", "left").select("state", due.alias("due")), within


def _by_status(nodes: DataFrame, edges: DataFrame, supported: DataFrame) -> list[DataFrame]:
    """Rules about a state's status, its one active value, when it holds and whose it is."""
    due, within = expected_status(nodes, edges, supported)
    states = cut(nodes.where("node_type = 'state'").join(due.withColumnRenamed("state", "id"), "id"))
    single = states.where("slot_type = 'single' and due <> 'historical'").groupBy(_text("subject_key").alias("subject_key"), _text("state_dimension").alias("state_dimension")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("due") != "ambiguous").alias("settled"))
    after = edges.where("type = 'CURRENT_AFTER'").select(F.col("src").alias("id"), "dst")
    times = states.select("id", "current_after").join(after, "id").join(nodes.select(F.col("id").alias("dst"), F.col("time_role").alias("role"), F.col("value").alias("at")), "dst", "left")
    n_after = states.select("id").join(after.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    owners = states.select("id", F.explode(F.array_distinct("scope_ids")).alias("scope")).join(nodes.select(F.col("id").alias("scope"), "node_type"), "scope", "left")
    owned = edges.where("type = 'CURRENT_STATE_OF'").select(F.col("src").alias("id"), F.col("dst").alias("scope"), F.lit(True).alias("drawn")).distinct()
    is_scope = F.coalesce(F.col("node_type") == "scope", F.lit(False))
    return [
        _told(within, F.col("state"), ("state_internal_conflict", F.lit(True), F.concat_ws(":", "a", "b"))),
        _told(states, F.col("id"), ("state_status_relation_mismatch", _text("status") != F.col("due"), F.concat_ws(" for ", _text("status"), "due"))),
        _told(single, F.concat_ws(":", "subject_key", "state_dimension"), ("single_slot_active_count", (F.col("n") > 1) & F.col("settled"), F.col("n"))),
        _told(n_after, F.col("id"), ("state_current_after_count", F.col("n") != 1, F.col("n"))),
        _told(times, F.col("id"), ("state_current_after_role_invalid", F.coalesce("role", F.lit("")) != "current_after", F.col("dst")), ("state_current_after_value_mismatch", F.coalesce("at", F.lit("")) != _text("current_after"), F.col("dst"))),
        _told(owners.join(owned, ["id", "scope"], "left"), F.col("id"), ("state_scope_invalid", ~is_scope, F.col("scope")), ("state_scope_edge_missing", is_scope & F.col("drawn").isNull(), F.col("scope"))),
    ]


def graph_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, id, detail): every fault of a graph, once.

    Ids of nodes must be unique (`graph.upsert`); a null id is a node of its own kind of fault and meets no edge. Support
    counts as such where a state declares the claim and the edge is drawn. Empty tables give no rows. An edge's id is its
    type and ends. Lists inside a state (claims, events, scopes) are bounded by that state.
    """
    of_claim = lambda x: F.when(F.col("node_type") == "claim", x)
    own = _whole(nodes, ("id", "node_type"), _TEXTS, _LISTS, GOLD)
    own = own.withColumns({"_facet": of_claim(facet(F.col("facet_key"))), "_role": of_claim(time_role(F.col("time_role"), F.col("time_value")))})
    own = own.withColumns({"lasts": of_claim(lasting(F.col("_facet"), F.col("_role"), F.col("value"))), "due_domain": of_claim(domain(F.col("_facet"), F.col("value")))}).drop("_facet", "_role")
    own = cut(own)
    drawn = cut(_whole(edges, ("type", "src", "dst"), ("time_role", "reason"), ("evidence_event_ids",)).drop("gold").distinct())
    declared = own.where("node_type = 'state'").select(F.col("id").alias("state"), F.explode("support_claim_ids").alias("claim"))
    supported = cut(drawn.where("type = 'SUPPORTS'").select(F.col("src").alias("claim"), F.col("dst").alias("state")).intersect(declared.select("claim", "state")))
    every = [*_by_row(own), *_by_edge(own, drawn), *_by_support(own, drawn, supported), *_by_status(own, drawn, supported)]
    return reduce(DataFrame.unionByName, every).distinct()
