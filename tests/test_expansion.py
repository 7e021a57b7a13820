"""Relation-aware expansion: facts by hand, and random graphs against a walk in rounds told in plain Python."""

import math
import random

import pytest
from tidemark.operators import expansion

CLAIMS = "claim_id string, event_id string, subject string, dimension string, terms array<string>"
RELATIONS = "type string, src string, dst string, evidence_event_ids array<string>"
STATES = "state_id string, primary_claim_id string, subject string, dimension string, many boolean, current boolean"


def run(spark, seeds, questions, claims, relations, states=(), support=()):
    tables = [
        spark.createDataFrame(list(rows), kind)
        for rows, kind in (
            (seeds, "query_id long, kind string, id string, rank int"), (questions, "query_id long, terms array<string>, subjects array<string>, wide boolean"), (claims, CLAIMS),
            (relations, RELATIONS), (states, STATES), (support, "state_id string, claim_id string"),
        )
    ]
    seeds, questions, claims, relations, states, support = tables
    evidence = expansion.state_evidence(states, support, relations)
    found = expansion.expand(seeds, questions, claims, relations, states, support, evidence)
    return found, expansion.closed_pack(found, claims, relations, evidence, 8, 8)


def ids(df, name, order="place"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_a_related_claim_its_event_and_its_state_are_reached(spark):
    claims = [("old", "D1:1", None, None, ["old"]), ("new", "D2:1", None, None, ["new"])]
    states = [("state-old", None, None, None, None, None), ("state-new", None, None, None, None, None)]
    found, pack = run(spark, [(1, "event", "D1:1", 1)], [(1, [], None, False)], claims, [("SUPERSEDES", "new", "old", ["D2:1"])], states, [("state-old", "old"), ("state-new", "new")])
    assert ids(pack.events, "event_id") == ["D1:1", "D2:1"] and ids(pack.states, "state_id") == ["state-old", "state-new"]
    assert ids(found.claims, "claim_id", "hop") == ["old", "new"] and pack.relations.count() == 1


def test_a_claim_of_a_seed_that_does_not_fit_opens_nothing(spark):
    claims = [("fits", "D1:1", "ann", "visit", ["visited", "support", "group"]), ("other", "D1:1", "ann", "career", ["plans", "work"]), ("was", "D2:1", "ann", "career", ["considered", "career"])]
    found, pack = run(spark, [(1, "event", "D1:1", 1)], [(1, ["visit", "support", "group"], None, False)], claims, [("SUPERSEDES", "other", "was", ["D2:1"])])
    assert ids(pack.events, "event_id") == ["D1:1"] and found.relations.count() == 0
    assert {(r["claim_id"], r["open"]) for r in found.claims.collect()} == {("fits", True), ("other", False)}


def test_a_state_group_is_closed_however_long(spark):
    claims = [(f"c{i}", f"D{i}:1", "person", "residence", ["residence", "update"]) for i in range(1, 8)]
    relations = [("SUPERSEDES", f"c{i}", f"c{i + 1}", [f"D{i + 1}:1"]) for i in range(1, 7)]
    found, pack = run(spark, [(1, "event", "D1:1", 1)], [(1, ["residence"], None, False)], claims, relations)
    assert ids(pack.events, "event_id") == [f"D{i}:1" for i in range(1, 8)]
    assert max(r["hop"] for r in found.claims.collect()) == 6


def test_expansion_stops_where_the_state_changes_and_after_an_unkeyed_neighbour(spark):
    claims = [("home", "D1:1", "person", "home", []), ("job", "D2:1", "person", "job", [])] + [(f"u{i}", f"U{i}", None, None, []) for i in range(3)]
    relations = [("SUPERSEDES", "home", "job", ["D2:1"]), ("CORRECTS", "u0", "u1", []), ("CORRECTS", "u1", "u2", [])]
    found, pack = run(spark, [(1, "event", "D1:1", 1), (2, "claim", "u0", 1)], [(1, ["live"], None, False), (2, [], None, False)], claims, relations)
    assert {(r["query_id"], r["claim_id"], r["open"]) for r in found.claims.collect()} == {(1, "home", True), (2, "u0", True), (2, "u1", False)}
    assert found.relations.where("query_id = 1").count() == 0


def test_subjects_siblings_and_limits(spark):
    claims = [("a", "E1", "Ann", "pet", ["cat"]), ("b", "E2", "Ann", "pet", ["dog"]), ("c", "E3", "Bob", "pet", ["cat"]), ("d", "E1", "", "", ["cat"])]
    states = [("sa", "a", "Ann", "pet", True, True), ("sb", "b", "Ann", "pet", True, True), ("sc", "c", "Bob", "pet", True, True), ("past", "b", "Ann", "pet", True, False)]
    support = [("sa", "a"), ("sb", "b"), ("sc", "c")]
    seeds = [(q, "event", e, 1) for q in (1, 2) for e in ("E1", "E3")] + [(3, "state", "sb", 2)]
    questions = [(1, ["cat"], ["ann"], False), (2, ["cat"], ["ann"], True), (3, ["dog"], None, False)]
    found, pack = run(spark, seeds, questions, claims, [], states, support)
    reached = {q: {r["claim_id"] for r in found.claims.where(f"query_id = {q}").collect()} for q in (1, 2, 3)}
    assert reached == {1: {"a", "d"}, 2: {"a", "b", "d"}, 3: {"b"}}
    assert {(r["query_id"], r["state_id"]) for r in found.states.collect()} == {(1, "sa"), (2, "sa"), (2, "sb"), (3, "sb"), (3, "past")} - {(3, "past")}
    tight = expansion.closed_pack(found, spark.createDataFrame(claims, CLAIMS), spark.createDataFrame([], RELATIONS), spark.createDataFrame(support, "state_id string, claim_id string"), 1, 1)
    assert {(r["query_id"], r["state_id"]) for r in tight.states.collect()} == {(1, "sa"), (2, "sa"), (3, "sb")}


def walk(seeds, question, claims, relations, support, evidence):
    """One question's paths by rounds, for graphs without wide questions: {claim: (hop, rank, relevance, open)}."""
    _, terms, subjects, _ = question
    known = {c[0]: c for c in claims}
    key = {c[0]: (c[2].lower(), c[3]) if c[2] and c[3] else None for c in claims}
    n, weight = len(claims), {}
    for t in set(terms):
        weight[t] = math.log((n + 1) / (sum(t in c[4] for c in claims) + 1)) + 1
    own = {c: round(sum(weight[t] for t in sorted(weight) if t in known[c][4]) / sum(weight.values()), 9) if weight else 0.0 for c in known}
    sees = lambda c: not subjects or not known[c][2] or known[c][2].lower() in subjects
    found = [(known_id, 0, rank, 0.0, True) for _, kind, known_id, rank in seeds if kind == "claim"]
    for _, kind, event, rank in seeds:
        if kind == "event":
            here = [c for c in known if known[c][1] == event]
            best = max((own[c] for c in here), default=0)
            about = {key[c] for c in here if own[c] == best and key[c]}
            found += [(c, 0, rank, 0.0, not weight or best <= 0 or own[c] == best or key[c] in about) for c in here]
    seen, states = {}, set()
    while found:
        fresh = {}
        for c, hop, rank, carried, open_ in found:
            if c in known and c not in seen and sees(c):
                path = (hop, rank, -carried, not open_)
                fresh[c] = min(fresh.get(c, path), path)
        found = []
        for c, (hop, rank, less, shut) in fresh.items():
            seen[c] = (hop, rank, round(max(-less, own[c]), 6), not shut)
            rel = max(-less, own[c])
            if not shut:
                for _, a, b, _ in relations:
                    for here, there in ((a, b), (b, a)):
                        if here == c and there in known and key[here] == key[there]:
                            found.append((there, hop + 1, rank, 0.7 * rel, key[c] is not None))
        new = {}
        for c in fresh:
            for s in {s for s, x in support if x == c} - states:
                hop, rank, less, _ = fresh[c]
                rel = max(-less, own[c])
                path = (round(1 / (1 + 0.25 * max(rank - 1, 0)) + 0.75 * rel - 0.25 * hop, 6), hop, rank, rel)
                new.setdefault(s, []).append(path)
        for s, paths in new.items():
            top = max(p[0] for p in paths)
            _, hop, rank, rel = next(p for p in paths if p[0] == top)
            found += [(c, hop, rank, rel, True) for x, c in evidence if x == s]
        states |= set(new)
    return seen, states


@pytest.mark.parametrize("seed", [1])
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    claims = [(f"c{i}", f"e{i // 2}", r.choice(["Ann", "Bob", ""]), r.choice(["x", "y", ""]), r.sample(words, 3)) for i in range(60)]
    relations = [(r.choice(["CORRECTS", "SUPERSEDES"]), *r.sample([c[0] for c in claims], 2), [f"e{r.randrange(30)}"]) for _ in range(90)]
    support = [(f"s{i // 3}", f"c{i}") for i in range(0, 60)]
    states = [(f"s{i}", None, None, None, None, None) for i in range(20)]
    questions = [(q, r.sample(words, 2) if q % 3 else [], ["ann"] if q == 1 else None, False) for q in range(6)]
    seeds = [(q, kind, f"{kind[0]}{r.randrange(30)}", k) for q in range(6) for k, kind in enumerate(("event", "event", "claim"), 1)]
    found, _ = run(spark, seeds, questions, claims, relations, states, support)
    got = {q: {} for q in range(6)}
    for x in found.claims.collect():
        got[x["query_id"]][x["claim_id"]] = (x["hop"], x["seed_rank"], x["open"])
    reached = {q: set() for q in range(6)}
    for x in found.states.collect():
        reached[x["query_id"]].add(x["state_id"])
    for q in range(6):
        want, held = walk([s for s in seeds if s[0] == q], questions[q], claims, relations, support, support)
        assert got[q] == {c: (hop, rank, open_) for c, (hop, rank, _, open_) in want.items()} and reached[q] == held
