"""Spans, extracted events, paragraphs, subjects, bindings, time profiles and scaling by hand."""

import datetime as dt

from pyspark.sql import functions as F
from tidemark.functions import text as T
from tidemark.operators import graph, subjects, times


def one(spark, expr, value, type_="string"):
    return spark.createDataFrame([(value,)], f"x {type_}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_span_starts(spark):
    starts = lambda text, span: one(spark, lambda c: T.span_starts(c, F.lit(span)), text)
    assert starts("aaaa a", "aa") == [0, 2]
    assert starts("a.b a+b", "a.b") == [0] and starts(r"x\Ey\E", r"\E") == [1, 4]
    assert starts("", "a") == [] and starts("abc", "") == []
    whole = lambda text, span: one(spark, lambda c: T.time_span_starts(c, F.lit(span)), text)
    assert whole("2023 in 2023-05, 12023; 2023", "2023") == [0, 24]
    assert whole("May mayor May", "May") == [0, 10] and whole("été may é", "t") == []


def test_json_event(spark):
    said = '```json\n{"date": "May 1, 2020", "location": ["Rome", "Oslo"], "entity": ["Ann ", {"name": "Bo"}, {"entity": "Cy"}, ""], "content": " met "}\n```'
    got = one(spark, T.json_event, said).asDict()
    assert got == {"time": ["May 1, 2020"], "spaces": "Rome", "entities": ["Ann", "Bo", "Cy"], "content": "met"}
    assert one(spark, T.json_event, "no object") is None and one(spark, T.json_event, None) is None
    assert one(spark, T.json_event, "{'entity': 'Ann', 'date': ['a', ' ']}")["time"] == ["a"]
    assert one(spark, T.primary_other, ["a", "b", "c"], "array<string>").asDict() == {"entity": "a", "others": ["b", "c"]}
    assert one(spark, T.primary_other, [], "array<string>").asDict() == {"entity": None, "others": []}


def test_paragraphs_and_passages(spark):
    long = "word " * 20
    assert [(p["pos"], len(p["text"])) for p in one(spark, T.paragraphs, f"{long}\n\nshort\n \n{long}")] == [(1, 99), (3, 99)]
    assert one(spark, T.paragraphs, None) == [] and one(spark, T.passages, "") == []
    assert len(one(spark, T.passages, f"{long}.\n\n{long}")) == 2
    assert [len(p) for p in one(spark, T.passages, f"A{long.strip()}. B{long.strip()}. Short one.")] == [101, 101]


def test_subject_keys(spark):
    names = [(1, "d", "I", "Ann Lee"), (2, "d", "Ann's", "Bo"), (3, "d", "Ann Lee", "Bo"), (4, "d", "Bo", "Bo"), (5, "d", "Bo Ek", ""), (6, "d", "Bo Sund", ""), (7, "e", "Ann", ""), (8, None, "", "Cy"), (9, "d", "Ann Lee's dog", "")]
    df = spark.createDataFrame(names, "claim_id long, dialog string, subject string, speaker string")
    got = {r["claim_id"]: (r["subject_key"], r["canonical_subject"]) for r in subjects.subject_keys(df, ["dialog"]).collect()}
    assert got[1] == got[2] == got[3] == ("ann_lee", "Ann Lee")
    assert got[4] == ("bo", "Bo") and got[7] == ("ann", "Ann") and got[8] == ("cy", "Cy") and got[9][0] == "ann_lee_s_dog"
    assert subjects.subject_keys(df.limit(0), ["dialog"]).count() == 0


def test_participant_binding(spark):
    claims = spark.createDataFrame([(1, "Ann", "Bo"), (2, "a dog", "Bo"), (3, "a dog", "Eve")], "claim_id long, subject string, speaker string")
    people = spark.createDataFrame([("ann",), ("bo",)], "name string")
    owners = subjects.claim_owners(claims, people)
    assert {(r["claim_id"], r["owner"]) for r in owners.collect()} == {(1, "ann"), (2, "bo")}
    asked = spark.createDataFrame([(1, ["ann"]), (2, ["ann"]), (3, []), (4, None), (5, ["bo"])], "query_id long, participants array<string>")
    cited = spark.createDataFrame([(1, "ann"), (1, "bo"), (2, "bo"), (3, "bo"), (5, None)], "query_id long, owner string")
    got = {r["query_id"]: (r["status"], r["blocked"]) for r in subjects.participant_binding(asked, cited).collect()}
    assert got == {1: ("supported_participant", False), 2: ("contradicted_participant", True), 3: ("not_applicable", False), 4: ("not_applicable", False), 5: ("not_applicable", False)}


def test_order_and_scaling(spark):
    hits = spark.createDataFrame([(1, 1, None), (1, 2, 5), (1, 3, 9), (1, 4, 5)], "query_id long, rank int, at int")
    order = lambda o: [r["rank"] for r in times.order_hits(hits, F.col("at"), o).orderBy("place").collect()]
    assert order("latest") == [3, 2, 4, 1] and order("chronological") == [2, 4, 3, 1] and order("none") == [1, 2, 3, 4]
    day = lambda n: dt.date(2024, 1, n)
    rows = spark.createDataFrame([(1, [day(1)]), (2, [day(2), None, day(4)]), (3, [day(5)]), (4, []), (5, None)], "id long, at array<date>")
    scaled, stats = times.scale_times(rows, "at")
    assert [r["scaled"] for r in scaled.orderBy("id").collect()] == [0.0, 0.5, 1.0, 0.0, 0.0]
    later, _ = times.scale_times(spark.createDataFrame([(1, [day(9)])], "id long, at array<date>"), "at", stats)
    assert later.first()["scaled"] == 2.0
    assert times.scale_times(rows.where("id > 3"), "at")[0].agg(F.max("scaled")).first()[0] == 0.0


def test_event_profiles_and_one_hop(spark):
    events = spark.createDataFrame([("e", "2024-01-01"), ("f", None)], "event_id string, occurred_at string")
    claims = spark.createDataFrame([("e", 1, "EVENT_TIME", "May"), ("e", 2, "", None)], "event_id string, claim_id long, time_role string, time_value string")
    at = spark.createDataFrame([(2, "t", "STATE_START", "June")], "claim_id long, time_id string, time_role string, value string")
    states = spark.createDataFrame([(1, "s", True, 1, "2024"), (2, "u", True, 1, "2024"), (2, "v", False, 2, "2024"), (1, "w", True, 1, None)], "claim_id long, state_id string, current boolean, primary_claim_id long, current_after string")
    got = {r["event_id"]: r for r in times.event_profiles(events, claims, at, states).collect()}
    assert got["e"].asDict() == {"event_id": "e", "time_roles": ["CURRENT_AFTER", "EVENT_TIME", "STATE_START"], "time_values": ["2024-01-01", "June", "May"], "time_ids": ["t"], "current_state_ids": ["s"]}
    assert got["f"]["time_roles"] == [] and times.event_profiles(events, claims, at).where("array_contains(time_roles, 'CURRENT_AFTER')").count() == 0
    seeds = spark.createDataFrame([(9, "e"), (9, "f")], "query_id long, event_id string")
    assert {(r["claim_id"], r["state_id"]) for r in graph.one_hop(seeds, claims, states.where("claim_id = 1")).collect()} == {(1, "s"), (1, "w"), (2, None)}
