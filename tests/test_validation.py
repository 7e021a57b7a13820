"""Graph validation: one sound graph, and a copy of it for each fault, all checked in one run."""

import pytest
from pyspark.sql import functions as F
from tidemark.operators import validation
from tidemark.operators.validation import graph_problems
from tidemark.plans.validation import event_graph

from .conftest import SF

FIELDS = "id node_type node_id time_role value subject time_value facet_key source_event_id dialog_id status primary_claim_id current_after canonical_subject subject_key state_domain slot_type state_target state_dimension dimension_source dimension_reason fact_type temporal_status intent answer".split()
LISTS = ["support_claim_ids", "support_event_ids", "scope_ids"]
IDENTITY = {"canonical_subject": "Ann", "subject_key": "ann", "state_domain": "location", "slot_type": "single", "state_target": "residence", "state_dimension": "location:residence", "dimension_source": "facet", "dimension_reason": "one slot"}


def sound():
    """Ann moved: claim new supersedes claim old, one state each; a plan that is no state; two scopes, two times."""
    nodes = {
        "e1": {"node_type": "event"}, "e2": {"node_type": "event"}, "s": {"node_type": "scope"},
        "t1": {"node_type": "time", "time_role": "started_at", "value": "May"}, "now": {"node_type": "time", "time_role": "current_after", "value": "2024"},
        "old": {"node_type": "claim", "facet_key": "location", "value": "Rome", "source_event_id": "e1", "dialog_id": "D1:2", **IDENTITY},
        "new": {"node_type": "claim", "facet_key": "location", "value": "Oslo", "source_event_id": "e2", "dialog_id": "D1:10", "time_role": "started_at", "time_value": "May", **IDENTITY},
        "plan": {"node_type": "claim", "facet_key": "plan", "value": "to ski", "source_event_id": "e2", "dialog_id": "D1:10"},
    }
    for name, claim, event, status in (("was", "old", "e1", "historical"), ("is", "new", "e2", "current")):
        nodes[name] = {"node_type": "state", "status": status, "primary_claim_id": claim, "support_claim_ids": [claim], "support_event_ids": [event], "scope_ids": ["s"], "current_after": "2024", "subject": "Ann", "value": nodes[claim]["value"], "fact_type": "state", "temporal_status": "ongoing", "intent": "none", **IDENTITY}
    edges = [
        ["IN_SCOPE", "e1", "s"], ["MENTIONS", "e2", "s"], ["ASSERTS", "e1", "old"], ["ASSERTS", "e2", "new"], ["OCCURRED_AT", "e1", "t1"], ["HAS_TIME", "new", "t1", {"time_role": "started_at"}],
        ["SUPERSEDES", "new", "old", {"reason": "moved", "evidence_event_ids": ["e2"]}], ["SUPPORTS", "old", "was"], ["SUPPORTS", "new", "is"], ["CURRENT_AFTER", "was", "now"], ["CURRENT_AFTER", "is", "now"],
        ["CURRENT_STATE_OF", "was", "s"], ["CURRENT_STATE_OF", "is", "s"],
    ]
    return nodes, [[*e, {}][:4] for e in edges]


def put(node, **fields):
    return lambda n, e: n[node].update(fields)


def edge(*rows):
    return lambda n, e: e.extend([*r, {}][:4] for r in rows)


def drop(kind, src):
    return lambda n, e: e.remove(next(x for x in e if x[0] == kind and x[1] == src))


def change(kind, **fields):
    return lambda n, e: next(x for x in e if x[0] == kind)[3].update(fields)


def turned(n, e):
    next(x for x in e if x[0] == "SUPERSEDES")[1:3] = ["old", "new"]
    n["was"]["status"], n["is"]["status"] = "current", "historical"


def conflict(n, e):
    e[:] = [x for x in e if x[0] != "SUPERSEDES"] + [["CONFLICTS_WITH", "new", "old", {"reason": "both", "evidence_event_ids": ["e1"]}]]
    n["was"]["status"] = n["is"]["status"] = "ambiguous"


def free(n, e):
    e[:] = [x for x in e if x[0] != "SUPERSEDES"]
    n["was"]["status"] = "current"


def inner(n, e):
    n["is"].update(support_claim_ids=["new", "old"], support_event_ids=["e2", "e1"])
    conflict(n, e)
    e.append(["SUPPORTS", "old", "is", {}])


FAULTS = [
    (lambda n, e: None, set()),
    (conflict, set()),
    (put("e1", node_id="other"), {("node_id_invalid", "e1")}),
    (put("e1", node_id=""), {("node_id_invalid", "e1")}),
    (put("s", node_type="place"), {("unsupported_node_type", "s"), ("edge_endpoint_type_mismatch", "IN_SCOPE:e1->s"), ("edge_endpoint_type_mismatch", "MENTIONS:e2->s"), ("edge_endpoint_type_mismatch", "CURRENT_STATE_OF:is->s"), ("edge_endpoint_type_mismatch", "CURRENT_STATE_OF:was->s"), ("state_scope_invalid", "is"), ("state_scope_invalid", "was")}),
    (put("t1", time_role="then"), {("unsupported_time_role", "t1"), ("has_time_role_mismatch", "HAS_TIME:new->t1")}),
    (put("plan", time_role="then", time_value="May"), {("claim_time_role_unsupported", "plan")}),
    (put("plan", time_value="May"), {("claim_time_role_missing", "plan")}),
    (put("plan", time_role="updated_at"), {("claim_time_value_missing", "plan")}),
    (put("new", dimension_reason=" "), {("claim_state_field_missing", "new"), ("state_primary_field_mismatch", "is")}),
    (put("new", facet_key="health"), {("claim_state_domain_mismatch", "new")}),
    (put("new", state_dimension="x:y"), {("claim_state_dimension_mismatch", "new"), ("state_primary_field_mismatch", "is"), ("state_support_identity_mismatch", "is"), ("relation_state_dimension_mismatch", "SUPERSEDES:new->old")}),
    (put("new", slot_type="many"), {("claim_slot_type_invalid", "new"), ("state_primary_field_mismatch", "is")}),
    (put("plan", facet_key="health", **IDENTITY), {("claim_state_domain_mismatch", "plan"), ("claim_state_support_count", "plan")}),
    (put("new", facet_key="plan"), {("nonpersistent_claim_supports_state", "new")}),
    (put("is", fact_type="event", intent=None), {("state_semantics_invalid", "is")}),
    (put("is", status="past"), {("state_status_invalid", "is"), ("state_status_relation_mismatch", "is")}),
    (put("is", status="historical"), {("state_status_relation_mismatch", "is")}),
    (put("is", support_claim_ids=None, support_event_ids=[]), {("state_support_not_list", "is"), ("state_support_missing", "is"), ("state_primary_not_supported", "is"), ("state_support_edge_undeclared", "is"), ("claim_state_support_count", "new")}),
    (put("is", support_claim_ids=[], support_event_ids=[]), {("state_support_missing", "is"), ("state_primary_not_supported", "is"), ("state_support_edge_undeclared", "is"), ("claim_state_support_count", "new")}),
    (put("is", support_claim_ids=["new", "new"]), {("state_support_duplicate", "is")}),
    (put("is", support_claim_ids=["new", "e1"]), {("state_support_invalid", "is"), ("state_support_identity_mismatch", "is")}),
    (put("is", support_claim_ids=["new", "gone"]), {("state_support_invalid", "is")}),
    (drop("SUPPORTS", "new"), {("state_support_edge_missing", "is"), ("claim_state_support_count", "new")}),
    (put("is", support_event_ids=None), {("state_support_events_not_list", "is"), ("state_support_events_mismatch", "is")}),
    (put("is", support_event_ids=["s"]), {("state_support_events_mismatch", "is"), ("state_support_event_invalid", "is")}),
    (put("is", primary_claim_id="gone"), {("state_primary_invalid", "is"), ("state_primary_not_supported", "is")}),
    (put("is", primary_claim_id="old"), {("state_primary_not_supported", "is"), ("state_primary_field_mismatch", "is")}),
    (put("is", subject="Bob"), {("state_primary_field_mismatch", "is")}),
    (put("is", value="Bergen"), {("state_primary_field_mismatch", "is")}),
    (put("is", dimension_source=None), {("state_identity_field_missing", "is"), ("state_primary_field_mismatch", "is")}),
    (put("is", state_target="x"), {("state_dimension_mismatch", "is"), ("state_primary_field_mismatch", "is")}),
    (put("is", current_after="2025"), {("state_current_after_value_mismatch", "is")}),
    (edge(["CURRENT_AFTER", "is", "t1"]), {("state_current_after_count", "is"), ("state_current_after_role_invalid", "is"), ("state_current_after_value_mismatch", "is")}),
    (drop("CURRENT_AFTER", "is"), {("state_current_after_count", "is")}),
    (put("is", scope_ids=[]), {("state_scope_missing", "is")}),
    (put("is", scope_ids=None), {("state_scope_missing", "is")}),
    (put("is", scope_ids=["s", "e1"]), {("state_scope_invalid", "is")}),
    (drop("CURRENT_STATE_OF", "is"), {("state_scope_edge_missing", "is")}),
    (edge(["LIKES", "e1", "s"]), {("unsupported_edge_type", "LIKES:e1->s")}),
    (edge(["ASSERTS", "e1", "gone"]), {("edge_missing_endpoint", "ASSERTS:e1->gone")}),
    (edge(["ASSERTS", "e1", "s"]), {("edge_endpoint_type_mismatch", "ASSERTS:e1->s")}),
    (change("HAS_TIME", time_role="updated_at"), {("has_time_role_mismatch", "HAS_TIME:new->t1")}),
    (change("SUPERSEDES", reason=" .;"), {("relation_reason_missing", "SUPERSEDES:new->old")}),
    (change("SUPERSEDES", evidence_event_ids=[]), {("relation_evidence_missing", "SUPERSEDES:new->old")}),
    (change("SUPERSEDES", evidence_event_ids=["s"]), {("relation_evidence_event_missing", "SUPERSEDES:new->old")}),
    (lambda n, e: (n.update(e3={"node_type": "event"}), change("SUPERSEDES", evidence_event_ids=["e3"])(n, e)), {("relation_evidence_not_endpoint", "SUPERSEDES:new->old")}),
    (turned, {("relation_direction_invalid", "SUPERSEDES:old->new")}),
    (edge(["CONFLICTS_WITH", "old", "new", {"reason": "x", "evidence_event_ids": ["e1"]}]), {("relation_pair_type_conflict", "new:old")}),
    (edge(["SUPPORTS", "plan", "is"]), {("state_support_edge_undeclared", "is")}),
    (free, {("single_slot_active_count", "ann:location:residence")}),
    (inner, {("state_internal_conflict", "is"), ("claim_state_support_count", "old")}),
    (put("e2", answer="Oslo"), {("forbidden_gold_field", "e2")}),
]


@pytest.fixture(scope="module")
def found(spark):
    nodes, edges, wants = [], [], []
    for i, (fault, want) in enumerate(FAULTS):
        n, e = sound()
        for k, v in n.items():
            v["node_id"] = k
        fault(n, e)
        for k, v in n.items():
            v.setdefault("node_id", k)
        mark = lambda x, i=i: x if not x else f"{i}|{x}"
        for k, v in n.items():
            v = v | {c: mark(v.get(c)) for c in ("node_id", "source_event_id", "primary_claim_id", "subject_key")}
            nodes.append([mark(k), *[v.get(c) for c in FIELDS[1:]], *[None if v.get(c) is None else [mark(x) for x in v[c]] for c in LISTS]])
        edges += [[t, mark(a), mark(b), f.get("time_role"), f.get("reason"), None if f.get("evidence_event_ids") is None else [mark(x) for x in f["evidence_event_ids"]]] for t, a, b, f in e]
        wants.append(want)
    kinds = ", ".join([f"{c} string" for c in FIELDS] + [f"{c} array<string>" for c in LISTS])
    table = graph_problems(spark.createDataFrame(nodes, kinds), spark.createDataFrame(edges, "type string, src string, dst string, time_role string, reason string, evidence_event_ids array<string>"))
    got = [set() for _ in FAULTS]
    for r in table.collect():
        i = int(r["id"].split("|")[0].split(":")[-1])
        got[i].add((r["rule"], r["id"].replace(f"{i}|", "")))
    return got, wants


@pytest.mark.parametrize("i", range(len(FAULTS)))
def test_fault(found, i):
    assert found[0][i] == found[1][i]


def test_every_rule_is_met(found):
    assert len({rule for want in found[1] for rule, _ in want}) >= 48


def test_empty_graph(spark):
    none = spark.createDataFrame([], "id string, node_type string"), spark.createDataFrame([], "type string, src string, dst string")
    assert graph_problems(*none).count() == 0


def test_windows_and_groups_of_the_event_graph_are_worked_out_once(spark):
    for table in event_graph(spark, SF):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "max_by" not in plan


def test_a_rule_with_several_details_gives_a_row_for_each(spark):
    df = spark.createDataFrame([("x", "", None), ("y", "1", " "), ("z", "1", "2")], "id string, a string, b string")
    got = validation._told(df, F.col("id"), ("empty", F.lit(True), validation._missing(("a", "b"))), ("null", F.col("b").isNull(), ""))
    assert sorted(map(tuple, got.collect())) == [("empty", "x", "a"), ("empty", "x", "b"), ("empty", "y", "b"), ("null", "x", "")]
