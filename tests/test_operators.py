"""Inline facts of single operators."""

import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F
from tidemark.functions import text as T
from tidemark.operators import answers, claims, evidence, graph, retrieval, state, times
from tidemark.plans import evidence as plans_evidence
from tidemark.plans import retrieval as plans_retrieval
from tidemark.plans import texts
from tidemark.sources import graph_store, records


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_tokens_and_keys(spark):
    assert one(spark, T.stemmed_tokens(F.lit("Stories walking walked cats's is"))) == ["story", "walk", "walk", "cats'", "is"]
    assert one(spark, T.bucket_key(F.lit(" A--b! "))) == "a_b"
    assert one(spark, T.bucket_key(F.lit(None).cast("string"))) == "unknown"
    assert one(spark, T.id_ranges(F.lit("3, 7-9, x, 5-4"))) == [3, 7, 8, 9, 4, 5]
    assert one(spark, T.letter_answer(F.lit("Answer: B."))) == "B"
    assert one(spark, T.time_label(F.lit("n/a"))) == ""
    assert one(spark, T.sentences(F.lit("One. Two!\nThree"))) == ["One.", "Two!", "Three"]


def test_relative_times(spark):
    rows = [("we met yesterday", "2023-05-08"), ("it was last Friday", "2023-07-15"), ("next month", "2023-05-25"), ("Seven years now", "2023-09-13"), ("two weekends ago", "2023-07-17"), ("due next week", "2025-01-10"), ("nothing", "2025-01-10")]
    df = spark.createDataFrame(rows, "said string, day string").withColumn("day", F.to_date("day"))
    got = {r["said"]: (r["normalised"], r["start"]) for r in times.ground(df, "said", "day").collect()}
    assert got == {
        "we met yesterday": ("7 May 2023", dt.date(2023, 5, 7)),
        "it was last Friday": ("the Friday before 15 July 2023", dt.date(2023, 7, 14)),
        "next month": ("June 2023", dt.date(2023, 6, 1)),
        "Seven years now": ("since 2016 (7 years)", dt.date(2016, 1, 1)),
        "two weekends ago": ("2 weekends before 17 July 2023", dt.date(2023, 7, 8)),
        "due next week": ("the week after 10 January 2025", dt.date(2025, 1, 17)),
    }


def fold(spark, claims, decisions):
    c = spark.createDataFrame([(x, "o", i) for i, x in enumerate(claims)], "claim_id string, owner string, at int")
    d = spark.createDataFrame(decisions, "existing string, incoming string, decision string, winner string")
    return sorted((r["primary_claim"], r["support"], r["status"], r["superseded_by"]) for r in state.fold_decided(c, d, ["owner"]).collect())


def test_decided_fold(spark):
    assert fold(spark, ["old", "detail", "new"], [("old", "detail", "COMPATIBLE", "incoming"), ("detail", "new", "SUPERSEDES", "incoming")]) == [
        ("detail", ["old", "detail"], "historical", "new"), ("new", ["new"], "current", None)]
    assert fold(spark, ["a", "b", "bridge"], [("a", "b", "CONFLICTS_WITH", None), ("a", "bridge", "COMPATIBLE", None), ("b", "bridge", "COMPATIBLE", None)]) == [
        ("bridge", ["a", "b", "bridge"], "current", None)]
    assert [x[2] for x in fold(spark, ["a", "b", "c"], [("a", "b", "CONFLICTS_WITH", None), ("a", "c", "SUPERSEDES", "incoming")])] == ["historical", "current", "current"]


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "event"), ("b", "scope")], "id string, node_type string")
    edges = spark.createDataFrame([("IN_SCOPE", "a", "b"), ("NEXT", "a", "b"), ("ODD", "a", "c")], "type string, src string, dst string")
    graph_store.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = graph_store.read_graph(spark, str(tmp_path / "g"))
    assert n.count() == 2 and e.count() == 3
    assert {(r["rule"], r["id"]) for r in graph.problems(nodes, edges).collect()} == {("wrong_end", "b"), ("unknown_type", "a"), ("unknown_type", "c")}


def test_record_scans(spark, tmp_path):
    sample = [{"sample_id": "s", "conversation": {"session_2": json.dumps([{"dia_id": "D2:1", "speaker": "A", "clean_text": "x"}, {"speaker": "B", "text": "no id"}]), "session_2_date_time": "1:56 pm on 8 May, 2023"}}]
    (tmp_path / "d.json").write_text(json.dumps(sample))
    rows = records.read_dialogues(spark, str(tmp_path / "d.json")).collect()
    assert [(r["dia_id"], r["text"], r["session_time"]) for r in rows] == [("D2:1", "x", "1:56 pm on 8 May, 2023")]
    (tmp_path / "g.json").write_text(json.dumps([{"topic_id": "t", "date": "2025-01-10", "dialogues": {"g": [{"speaker": "A", "dialogue": " a  b "}, {"speaker": "B", "dialogue": " "}]}}]))
    assert [(r["event_id"], r["text"]) for r in records.read_group_chat(spark, str(tmp_path / "g.json")).collect()] == [("t:2025-01-10:g:1", "a b")]
    (tmp_path / "b.txt").write_text("Chapter 1\n\nOne.\nChapter 2\n\nTwo.")
    assert [(r["chapter_id"], r["text"]) for r in records.read_chapters(spark, str(tmp_path / "b.txt")).collect()] == [(1, "One."), (2, "Two.")]


def test_evidence_columns(spark):
    words = lambda *xs: F.array(*[F.lit(x) for x in xs])
    assert one(spark, evidence.scope_labels(words("Work", " ", "work", "Home.", "a", "b", "c"))) == ["Work", "Home", "a", "b"]
    assert one(spark, evidence.scope_labels(F.lit(None).cast("array<string>"))) == []
    assert [one(spark, evidence.gold_items(F.lit(x))) for x in ('["a", "b"]', "['a', 'b']", "[]", "", " plain, text ", None)] == [["a", "b"], ["a", "b"], [], [], ["plain, text"], []]
    assert one(spark, evidence.cited_sentences(words("s1", "s2", "s3"), F.array(*[F.lit(i) for i in (3, 9, 0, 1, 3, 2)]), 2)) == ["s1", "s2"]
    assert one(spark, evidence.retrieval_queries(F.lit("q"), words("b", "q", "", "c", "d", "e"), F.lit("count"))) == ["q", "b", "c", "d"]
    assert one(spark, evidence.retrieval_queries(F.lit("q"), words("b"), F.lit("lookup"))) == ["q"]
    two = F.array(words("new", "york"), words("rome"))
    assert one(spark, F.round(evidence.multi_answer_f1(F.array(words("york")), two), 6)) == round((2 / 3 + 0) / 2, 6)
    assert one(spark, evidence.multi_answer_f1(F.array(words("york")), F.slice(two, 1, 0))) == 0
    scores = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    judged = lambda s, n, g: [one(spark, F.round(evidence.judged_f1(s, F.lit(n), F.lit(g))[k], 6)) for k in ("lenient", "harsh")]
    assert judged(scores(1, 2), 4, 2) == [1.0, round(2 * 0.5 / 1.5, 6)] and judged(scores(), 0, 0) == [1.0, 1.0] and judged(scores(), 3, 0) == [0.0, 0.0] and judged(scores(), 0, 2) == [0.0, 0.0]


def test_handles_and_constraints(spark):
    units = spark.createDataFrame([(1, "C2"), (1, "S1"), (1, "C9"), (1, "C0"), (1, "D1"), (1, None)], "query_id int, handle string")
    assert [r["id"] for r in evidence.handles(units, F.array(F.lit("c1"), F.lit("c2")), F.array(F.lit("s1"))).collect()] == ["c2", "s1", None, None, None, None]
    pairs = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    got = evidence.constrained(pairs([(1, "a", 7), (1, "b", 7), (1, "a", 8), (2, "a", 8)], "query_id int, constraint string, event_id int"), pairs([(1, "a"), (1, "b"), (2, "a"), (2, "b")], "query_id int, constraint string"), pairs([(1, 9), (2, 9)], "query_id int, event_id int"))
    assert sorted(map(tuple, got.collect())) == [(1, 7, "exact"), (2, 9, "routed")]


def test_claim_columns(spark):
    role = lambda r, t: one(spark, claims.time_role(F.lit(r), F.lit(t)))
    assert [role("planned for", "yesterday"), role("planned_for", "May"), role("due_at", None), role(None, None), role("odd", "x")] == ["occurred_at", "planned_for", "deadline_at", "", ""]
    assert [tuple(one(spark, claims.role_and_time(F.lit(r), F.lit(t)))) for r, t in ((None, "May"), ("updated_at", "none"), ("odd", "May"))] == [("occurred_at", "May"), ("", ""), ("occurred_at", "May")]
    lasting = lambda f, r, v: one(spark, claims.lasting(F.lit(f), F.lit(r), F.lit(v)))
    assert [lasting("work", None, None), lasting("work", "", "used to work"), lasting("work", "", "used to, now not"), lasting("activity", "", "x"), lasting("activity", "started_at", "x"), lasting("event", "", "x")] == [True, False, True, False, True, False]
    topics = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    about = lambda f, v, t: one(spark, claims.dimension(F.lit(f), F.lit(v), t, F.lit("Ann"), F.lit("c1")))
    assert about("place", "moved to Rome", topics()) == "location:residence" and about("work", "x", topics()) == "occupation:primary"
    assert about("health", "x", topics("Knee", "knee ")) == "health:knee" and about("health", "x", topics("Ann's condition")).startswith("health:claim_local_x_")
    assert about("health", None, F.lit(None).cast("array<string>")).startswith("health:claim_local_unresolved_")


def test_sentence_claims_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "Nothing here.", "s"), (4, "who is responsible? Plan B has a risk. now", None)], "event_id int, text string, speaker string")
    got = [tuple(r) for r in claims.from_sentences(rows, 2).select("event_id", "number", "subject", "facet", "role").collect()]
    assert got == [(4, 1, None, "owner", "mentioned_at"), (4, 2, "Plan B", "risk", "mentioned_at")]


def test_relations_and_expansion(spark):
    known = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "claim_id string, at int")
    raw = spark.createDataFrame([("supersedes", "b", "a"), ("SUPERSEDES", "a", "b"), ("CONFLICTS_WITH", "c", "b"), ("CONFLICTS_WITH", "b", "c"), ("CORRECTS", "c", "a"), ("SUPERSEDES", "c", "a"), ("CORRECTS", "a", "a"), ("CORRECTS", "a", "z"), (None, "a", "b")], "type string, src string, dst string")
    good, bad = claims.relations(raw, known)
    assert {tuple(r) for r in good.collect()} == {("SUPERSEDES", "b", "a"), ("CONFLICTS_WITH", "b", "c")}
    assert sorted(r["reason"] for r in bad.collect()) == ["mixed_types", "mixed_types", "reversed", "same_end", "unknown_end", "unknown_type"]
    keyed = spark.createDataFrame([("a", "s", "d"), ("b", "s", "d"), ("c", "s", "other"), ("d", None, None), ("e", None, None)], "claim_id string, subject string, dimension string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("e", "d")], "src string, dst string")
    seeds = spark.createDataFrame([(1, "a", 1.0), (1, "a", 0.5), (2, "d", 1.0)], "query_id int, claim_id string, relevance double")
    assert sorted(tuple(r) for r in claims.expand_related(seeds, edges, keyed, 3).collect()) == [(1, "a", 0, 1.0), (1, "b", 1, 0.7), (2, "d", 0, 1.0), (2, "e", 1, 0.7)]
    assert claims.leaks(spark.range(1).select(F.struct(F.lit(1).alias("gold"), F.array(F.struct(F.lit(1).alias("Answer"))).alias("x")).alias("p")), ("gold", "answer")) == ["Answer", "gold"]


def test_answers(spark):
    say = lambda x: one(spark, answers.abstains(F.lit(x)))
    assert [say(None), say(""), say("I dont know"), say("No."), say("no"), say("no room"), say("in Rome")] == [False, False, True, False, True, False, False]
    assert one(spark, answers.participant_key(F.lit("Ann’s  Brother's"))) == "ann brother" and one(spark, answers.participant_key(F.lit(None))) == ""
    roles = lambda q: one(spark, answers.wanted_roles(F.lit(q)))
    assert (roles("What has he been doing recently?")["all"], roles("What has he been doing recently?")["newest_first"]) == (["occurred_at", "started_at", "updated_at"], True)
    assert roles("When was the project completed?")["all"] == ["completed_at"] and roles("Who?")["all"] == []
    slots = lambda c, t: [tuple(p) for p in one(spark, answers.cue_slots(F.lit(c), F.lit(t)))]
    assert slots("(t, *, e, c)", "{May 1} of { Ann }") == [("t", "May 1"), ("e", "Ann")] and slots("(t)", "none") == [] and slots(None, None) == [] and slots("(t,s,e,c)", "{a}{b}{c}{d}{e}") == []
    assert one(spark, answers.folded_terms(F.lit("Alerts, testing the buses of us"), {"alerts": "alarm"}, ("the",))) == ["alarm", "test", "buse"]
    terms = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    assert [one(spark, answers.content_match(q, d, ("b",))) for q, d in ((terms(), terms("a")), (terms("a", "b"), terms("b")), (terms("a"), F.lit(None).cast("array<string>")))] == [0.0, 10.0, -8.0]


def test_question_scans(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"sample_id": "s", "qa": [{"question": "Q", "answer": "A", "category": 2, "evidence": ["(D1:2)", "D1:2; D3:1"]}, {"question": "R", "adversarial_answer": "B", "category": 5}]}]))
    a, b = records.read_questions(spark, str(tmp_path / "q.json")).orderBy("qa_index").collect()
    assert (a["question_id"], a["question_type"], a["evidence_dialog_ids"], a["evidence_session_ids"]) == ("s::qa_0000", "temporal", ["D1:2", "D3:1"], ["session_1", "session_3"])
    assert (b["answer"], b["question_type"], b["evidence_dialog_ids"]) == ("B", "adversarial", [])
    (tmp_path / "c.json").write_text(json.dumps([{"id": str(i), "Q": "q", "A": x, "options": {"B": "red", "A": "blue"}} for i, x in enumerate(("b", "A. blue", "Red", "none"))] + [{"id": "9", "Q": "q", "A": "x"}]))
    got = records.read_choices(spark, str(tmp_path / "c.json")).orderBy("question_id").collect()
    assert [r["correct"] for r in got] == ["B", "A", "B", None, None] and got[0]["options"] == ["A. blue", "B. red"] and got[4]["question_type"] == "open_ended"
    for n, body in (("r1", {"rows": [{"question_id": "1", "question": "q", "answer": "a"}, {"question": "q"}]}), ("r2", {"items": [{"question_id": "2", "question": "q", "answer": "a"}]})):
        (tmp_path / f"{n}.json").write_text(json.dumps(body))
    rows = records.read_results(spark, str(tmp_path / "r*.json")).collect()
    assert sorted((r["question_id"], r["source"][-7:]) for r in rows) == [("1", "r1.json"), ("2", "r2.json")]
    book = spark.createDataFrame([("q", "c", "t", "g", None, [1], "1")], "question string, cue string, retrieval_type string, get string, correct_answer array<string>, correct_answer_chapters array<int>, bins_items_correct_answer string")
    book.write.parquet(str(tmp_path / "b"))
    assert [(r["q_idx"], r["correct_answer"]) for r in records.read_book_questions(spark, str(tmp_path / "b")).collect()] == [(0, [])]
    book.drop("get").write.parquet(str(tmp_path / "m"))
    with pytest.raises(ValueError, match="without get"):
        records.read_book_questions(spark, str(tmp_path / "m"))
    records.write_report(spark.range(2), str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_whole_texts_are_read(spark, tmp_path):
    late = "漢字 " * 120 + "Late words"
    spark.createDataFrame([(1, late), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["key"] for r in texts.t5_bucket_keys(spark, str(tmp_path)).collect()} == {1: "late_words", 2: "unknown"}
    turn = "So, so - SO so! so ... so so so so so so so Ann met Bob and Cy"
    spark.createDataFrame([(1, 1, turn), (1, 2, None)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r["turn"]: r["labels"] for r in plans_evidence.t7_scope_labels(spark, str(tmp_path)).collect()} == {1: "So|Ann|met|Bob", 2: ""}
    spark.createDataFrame([(1, "a " * 100_003), (2, "a"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r["item_id"]: (r["entity"], r["n_others"]) for r in texts.t19_primary_other(spark, str(tmp_path)).collect()} == {1: ("a", 100_002), 2: ("a", 0), 3: (None, 0)}


def test_ruled_sentences(spark):
    split = lambda x: one(spark, T.ruled_sentences(F.lit(x).cast("string")))
    assert split("Dr. Smith met J. Doe. He left... Slowly, e.g. by bus.\nDone!") == ["Dr. Smith met J. Doe.", "He left... Slowly, e.g. by bus.", "Done!"]
    assert split('He said "Stop. Now." Then he went.') == ['He said "Stop. Now."', "Then he went."] and split("“A. Bc. D” e. End") == ["“A. Bc. D” e. End"]
    assert split("It was v. good. yes. No") == ["It was v. good. yes.", "No"] and split(None) == [] and split(" ") == []


def test_judgments(spark):
    same = lambda g, s: one(spark, times.same_date(F.lit(g).cast("string"), F.lit(s).cast("string")))
    assert same("7 May 2023", "May 7th, 2023.") and same("May 2023", "2023-05-07") and same("2023", "May 2023") and not same("7 May 2023", "2023") and not same(None, "2023")
    assert same("the friday before 15 July 2023", "14 July 2023") and same("Monday after 17 July 2023", "24 July 2023") and same("the week before 9 June 2023", "2 June 2023")
    assert same("a few days after 9 June 2023", "12 June 2023") and not same("a few days after 9 June 2023", "14 June 2023") and same("5/7/2023", "7 May 2023") and not same("31 June 2023", "31 June 2023")
    rows = [("a", "s1", "adversarial", 0.0, "Not mentioned in the conversation", "x"), ("b", "s1", "adversarial", 0.0, "Rome", "x"), ("c", "s1", "single-hop", 1.0, "x", "x"), ("d", "s1", "single-hop", 0.0, "no information available", "x"), ("e", "s1", "temporal", 0.2, "7 May 2023", "May 2023"), ("f", "s1", None, None, "three dogs", "3 dogs"), ("g", "s2", "open-domain", 0.3, "a dog", "hound"), ("h", "s2", "open-domain", 0.3, None, "hound")]
    df = spark.createDataFrame(rows, "key string, sample_id string, question_type string, answer_f1 double, hypothesis string, gold_answer string")
    labels = lambda *x: spark.createDataFrame(list(x), "key string, label string")
    out = answers.rescored(df, labels(("g", "equivalent"), ("h", "wrong"), ("a", "wrong")), labels(("g", "wrong")))
    assert {r["key"]: (r["label"], r["reason"]) for r in out.collect()} == {
        "a": ("equivalent", "adversarial_abstention"), "b": ("wrong", "adversarial_not_abstained"), "c": ("equivalent", "official_f1_exact"), "d": ("wrong", "abstained_with_available_gold"),
        "e": ("equivalent", "date_format_or_granularity"), "f": ("equivalent", "number_format"), "g": ("wrong", "verified"), "h": ("wrong", "judged"),
    }
    got = {(r["level"], r["value"]): (r["n"], r["score"]) for r in answers.rescored_summary(out).collect()}
    assert got["overall", None] == (8, 0.5) and got["non_adversarial", None] == (6, 0.5) and got["sample", "s2"] == (2, 0.0) and got["type", "adversarial"] == (2, 0.5) and got["type", None] == (1, 1.0)
    with pytest.raises(PySparkException, match="no label"):
        answers.rescored(df, labels(("g", "equivalent")), labels()).collect()
    assert one(spark, answers.judgment_key(F.lit("a"), F.lit(None))) != one(spark, answers.judgment_key(F.lit("a"), F.lit("")))


def test_newest_first(spark):
    hits = spark.createDataFrame([(1, "a", 1.0, "2023-01-01"), (1, "b", 1.0, "2023-01-03"), (1, "c", 1.0, None), (2, "a", 1.0, "2023-01-01")], "query_id int, doc_id string, score double, at string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in times.rerank(hits, F.array(F.lit("x")), F.array(F.lit("y")), at=F.col("at")).collect()}
    assert got == {(1, "a"): 1.1, (1, "b"): 1.2, (1, "c"): 1.0, (2, "a"): 1.0}


def test_external_hits_in_runs(spark, tmp_path):
    rows = [(i * 977, i % 3 % 2) for i in range(2000)] + [(None, 1), (-5, 1), (-40_005, None)]
    spark.createDataFrame(rows, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = plans_retrieval.r27_external_hits(spark, str(tmp_path))
    by = Window.partitionBy(F.col("doc_id") % 10).orderBy(F.desc("score"), "doc_id")
    assert sorted(map(str, out.collect())) == sorted(map(str, out.select("doc_id", "score", F.row_number().over(by).alias("rank")).collect()))
    assert out.count() == len(rows)
    windows = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x]
    assert windows and all("_run" in x for x in windows) and sum("row_number" in x and "_run1" in x for x in windows) == 1


def test_generic_targets_and_empty_times(spark):
    from tidemark.operators import claims as C

    generic = lambda t, dom: one(spark, C.generic_target(F.lit(t), F.lit(dom), F.lit(dom), F.lit("Ann")))
    assert generic("current status", "status") and generic("Ann's status", "status") and generic("Belongings", "possession") and not generic("knee", "health")
    assert [one(spark, T.time_label(F.lit(x))) for x in ("not mentioned", "Empty", "not specified.", "May 4")] == ["", "", "", "May 4"]


def _fold(spark, claims, decisions, **more):
    c = spark.createDataFrame([("o", i, i, d) for i, d in claims], "owner string, claim_id long, at long, talk string")
    d = spark.createDataFrame(decisions, "existing long, incoming long, decision string, winner string")
    return sorted((r["primary_claim"], r["support"], r["status"], r["error"]) for r in state.fold_decided(c, d, ["owner"], **more).collect())


def test_conflicts_outlive_a_merge(spark):
    # B conflicts with X; D joins A and B: the merged cluster and X are at odds
    got = _fold(spark, [(1, "a"), (2, "a"), (3, "a"), (4, "a")], [(2, 3, "CONFLICTS_WITH", "none"), (1, 4, "COMPATIBLE", "none"), (2, 4, "COMPATIBLE", "none")])
    assert got == [(3, [3], "ambiguous", ""), (4, [1, 2, 4], "ambiguous", "")]
    # a claim that fits both sides of a conflict ends it
    got = _fold(spark, [(1, "a"), (2, "b"), (3, "c")], [(1, 2, "CONFLICTS_WITH", "none"), (1, 3, "COMPATIBLE", "none"), (2, 3, "COMPATIBLE", "none")])
    assert got == [(3, [1, 2, 3], "current", "")]


def test_fold_errors(spark):
    assert _fold(spark, [(1, "a"), (2, "b")], [(1, 2, "SUPERSEDES", "existing")], dialog="talk")[1][3] == "contradicts chronology"
    assert _fold(spark, [(1, "a"), (2, "a")], [(1, 2, "SUPERSEDES", "existing")], dialog="talk")[1][2:] == ("historical", "")
    every = _fold(spark, [(1, "a"), (2, "b"), (3, "c")], [], most_active=1)
    assert len(every) == 3 and all(r[3] == "active-cluster limit exceeded" for r in every)
    assert _fold(spark, [(1, "a"), (2, "a"), (3, "a")], [(2, 3, "COMPATIBLE", "none"), (1, 3, "SUPERSEDES", "existing")])[1][3] == "compatible and retired"


def test_anchor_scopes(spark):
    scopes = spark.createDataFrame([("b", "speaker", "Ann Lee"), ("a", "speaker", "ann  lee"), ("c", "entity", "ANN-LEE"), ("d", "entity", "Bo"), ("e", "speaker", None), ("f", "topic", "ann lee")], "scope_id string, scope_type string, value string")
    asked = spark.createDataFrame([(1, "with Ann Lee today"), (1, "Ann Lee"), (2, "Joann Lee"), (3, None), (4, "Bo")], "query_id long, entity string")
    got = sorted((r["query_id"], r["scope_type"], r["scope_id"]) for r in retrieval.anchor_scopes(asked, scopes).collect())
    assert got == [(1, "entity", "c"), (1, "speaker", "a")]


def test_a_name_of_many_scopes_meets_questions_as_one_row(spark):
    scopes = spark.range(500).select(F.format_string("s%03d", "id").alias("scope_id"), F.lit("speaker").alias("scope_type"), F.lit("Ann").alias("value"))
    out = retrieval.anchor_scopes(spark.range(50).select(F.col("id").alias("query_id"), F.lit("ann").alias("entity")), scopes)
    assert [tuple(r) for r in out.orderBy("query_id").collect()] == [(q, "speaker", "ann", "s000") for q in range(50)]
    assert not out._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")


def test_bm25_by_blocks_and_by_joins_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, [f"w{(i * j) % 17}" for j in range(i % 9)]) for i in range(300)] + [(900, []), (901, None)], "doc_id long, tokens array<string>")
    asked = spark.createDataFrame([(q, [f"w{(q + j) % 19}" for j in range(4)]) for q in range(25)] + [(99, ["none"]), (98, [])], "query_id long, tokens array<string>")
    few, one = docs.where("doc_id % 3 = 0").select("doc_id"), asked.select("query_id").where("query_id < 5").crossJoin(docs.select("doc_id").where("doc_id < 50"))
    rows = lambda **kw: sorted(map(tuple, retrieval.bm25(docs, asked, **kw).select("query_id", "doc_id", "score").collect()))
    cases = [{}, {"k": 3}, {"k": None}, {"k": 2, "allowed": few}, {"k": 2, "allowed": one}, {"k": 3, "weighted": True}]
    blocks = [rows(**c) for c in cases]
    monkeypatch.setattr(retrieval, "BLOCK", 60)
    assert [rows(**c) for c in cases] == blocks and blocks[0]
    monkeypatch.setattr(retrieval, "MOST_BLOCKS", 0)
    joined = [rows(**c) for c in cases]
    assert [[r[:2] for r in x] for x in joined] == [[r[:2] for r in x] for x in blocks]
    assert all(abs(a[2] - b[2]) < 2e-6 for x, y in zip(joined, blocks) for a, b in zip(x, y))
    assert retrieval.bm25(docs, asked.where("false")).count() == 0


def test_exact_searches_by_blocks(spark):
    import numpy as np

    g = np.random.default_rng(3)
    heads = g.normal(size=(12, 8))
    v = np.concatenate([h + 0.1 * g.normal(size=(40, 8)) for h in heads] + [np.zeros((3, 8)), heads[:1].repeat(5, 0)])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)], "doc_id long, v array<double>")
    asked = rows.where("doc_id % 29 = 0 or doc_id in (480, 900)").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in retrieval.dense(rows, asked, 7).collect()}
    n = np.sqrt((v * v).sum(1))
    for q in [*range(0, len(v), 29), 480]:
        s = np.round(v @ v[q] / (n * n[q] + 1e-12), 6)
        want = sorted((i for i in range(len(v)) if i != q), key=lambda i: (-s[i], i))[:7]
        assert [got[q, i + 1][0] for i in range(7)] == want
    w = np.abs(v)
    events = spark.createDataFrame([(i, x[:4].tolist(), x[4:].tolist()) for i, x in enumerate(w)], "doc_id long, time array<double>, content array<double>")
    asked = events.where("doc_id % 31 = 0 or doc_id = 481").select(F.col("doc_id").alias("query_id"), F.col("time").alias("q_time"), F.col("content").alias("q_content"))
    for weights, exact in ((None, None), ({"time": 3.0, "content": 1.0}, None), (None, "time")):
        out = {}
        for r in retrieval.vigilance(events, asked, {"time": 0.8, "content": 0.7}, 6, weights, exact).collect():
            out.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"]))
        for q in [*range(0, len(w), 31), 481]:
            m = [np.minimum(w[q][p], w[:, p]).sum(1) / w[q][p].sum() if w[q][p].sum() else (w[:, p].sum(1) == 0) * 1.0 for p in (slice(0, 4), slice(4, 8))]
            a, b = (3, 1) if weights else (1, 1)
            mean = np.round((a * np.round(m[0], 6) + b * np.round(m[1], 6)) / (a + b), 7)
            fits = [i for i in range(len(w)) if round(m[0][i], 6) >= 0.8 and round(m[1][i], 6) >= 0.7 and (not exact or abs(w[q][0] - w[i][0]) < 1e-10)]
            assert [i for _, i in sorted(out.get(q, []))] == sorted(fits, key=lambda i: (-mean[i], i))[:6]


def test_searches_by_parts_with_copies_and_gaps(spark, monkeypatch):
    import numpy as np

    for name, n in (("MET_VECTORS", 40), ("MET_QUERIES", 5), ("AT_ONCE", 3)):
        monkeypatch.setattr(retrieval, name, n)
    v = np.abs(np.random.default_rng(5).normal(size=(300, 4)))
    v[100:260] = v[0]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0, None, 1.0, 1.0])], "doc_id long, v array<double>")
    asked = rows.where("doc_id % 30 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    got = {}
    for r in retrieval.dense(rows, asked, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    n = np.sqrt((v * v).sum(1))
    for q in range(0, 300, 30):
        s = np.round(v @ v[q] / (n * n[q] + 1e-12), 6)
        assert got[q] == sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:4]
    keep = retrieval._least_of_alike(np.zeros(50, int), [np.ones(50)], np.arange(50)[::-1], 4)
    assert list(keep) == [46, 47, 48, 49]
    events = rows.select("doc_id", F.col("v").alias("a"))
    got = {}
    for r in retrieval.vigilance(events, asked.select("query_id", F.col("q").alias("q_a")), {"a": 0.9}, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    whole = {**dict(enumerate(v)), 901: np.array([1.0, np.nan, 1.0, 1.0])}
    for q in range(0, 300, 30):
        m = {i: round(np.fmin(v[q], w).sum() / v[q].sum(), 6) for i, w in whole.items()}
        assert got[q] == sorted((i for i in m if m[i] >= 0.9), key=lambda i: (-m[i], i))[:4]


def test_dates_of_texts_are_read_once(spark):
    gold, said = ["3 May 2020", "May 2020", "2020", None, "2020-05-03"], ["2020-05-03", "2020-06-01", None, "x"]
    rows = spark.createDataFrame([(g, s) for g in gold for s in said], "gold string, said string")
    out = times.same_dates(rows.crossJoin(spark.range(20)), "gold", "said")
    plain = {(r["gold"], r["said"]): r["same"] for r in rows.select("gold", "said", times.same_date(F.col("gold"), F.col("said")).alias("same")).collect()}
    got = [((r["gold"], r["said"]), r["same"]) for r in out.collect()]
    assert len(got) == 400 and all(plain[k] == same for k, same in got) and sum(plain.values()) == 5
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_piece_of_a_sentence_is_read_once(spark):
    plan = spark.range(1).select(T.ruled_sentences(F.lit("a").substr(F.lit(1), F.col("id").cast("int"))).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 2


def test_terms_of_a_batch_are_counted_in_slices(spark, monkeypatch):
    docs = spark.createDataFrame([(i, [f"w{(i * j) % 7}" for j in range(i % 9)]) for i in range(100)], "doc_id long, tokens array<string>").coalesce(1)
    asked = spark.createDataFrame([(q, [f"w{q}"]) for q in range(7)], "query_id long, tokens array<string>")
    rows = lambda: sorted(map(tuple, retrieval.bm25(docs, asked, k=None).collect()))
    whole = rows()
    monkeypatch.setattr(retrieval, "COUNTED_ROWS", 3)
    assert rows() == whole and whole


def test_strips_of_vectors_keep_all_that_may_lead():
    import numpy as np

    rng = np.random.default_rng(3)
    score = rng.random((5, 9000)).astype(np.float32)
    score[1] = 0.5
    score[2, 7:] = -np.inf
    sure = rng.random(score.shape) < 0.5
    asked = []

    def scored(cols, which=None):
        asked.append(cols.stop - cols.start)
        return score[:, cols], None if which is None else which[:, cols]

    row, at = retrieval._leads(5, 9000, 4, 1e-5, scored)
    assert max(asked) <= retrieval.STRIP
    for i in range(5):
        best = np.sort(score[i][score[i] > -np.inf])[::-1][:4]
        assert set(at[row == i]) == set(np.flatnonzero(score[i] >= best[-1] - 1e-5))
    row, at = retrieval._leads(5, 9000, 4, 1e-5, lambda cols: scored(cols, sure))
    for i in range(5):
        best = np.sort(score[i][sure[i] & (score[i] > -np.inf)])[::-1][:4]
        assert set(np.flatnonzero(score[i] >= (best[-1] if len(best) == 4 else -1e30) - 1e-5)) == set(at[row == i])


def test_searches_in_single_precision_agree_with_double(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "STRIP", 16)
    monkeypatch.setattr(retrieval, "AT_ONCE", 3)
    v = np.abs(np.random.default_rng(8).normal(size=(120, 6)))
    v[60:90] = v[3] * (1 + 1e-7 * np.arange(30)[:, None])  # nearer than single precision tells
    v[100], v[101] = 0.0, 1e-9
    odd = [(500, [1.0, 2.0]), (501, [float("nan")] + [1.0] * 5), (502, [None] + [1.0] * 5), (503, [-1.0] * 6), (0, [0.5] * 6)]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + odd, "doc_id long, v array<double>").coalesce(1)
    asked = rows.where("doc_id % 20 = 0 or doc_id in (61, 101, 501, 503)").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    order = lambda df: [tuple(r) for r in df.orderBy("query_id", "rank").collect()]
    found = lambda: (order(retrieval.dense(rows, asked, 5)), order(retrieval.vigilance(rows.withColumnRenamed("v", "a"), asked.withColumnRenamed("q", "q_a"), {"a": 0.5}, 5)))
    quick = found()
    monkeypatch.setattr(retrieval, "_usual", lambda length: 0)  # nothing is of the usual kind: all in double precision
    assert str(quick) == str(found()) and len(quick[0]) > 30


def test_token_overlap_is_worked_out_once_by_sorting(spark):
    import random
    from collections import Counter

    from tidemark.operators import metrics

    r = random.Random(4)
    pairs = [([r.choice("abcdefgh") for _ in range(r.randrange(12))], [r.choice("abcdefgh") for _ in range(r.randrange(12))]) for _ in range(60)]
    pairs += [(["x"] * 3000 + ["y"], ["y"] * 2 + ["x"] * 2500), (["a", None, "a"], [None, "a"]), (None, ["a"])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a array<string>, b array<string>")
    out = df.select("i", metrics.overlap(F.col("a"), F.col("b")).alias("n"), metrics.token_f1(F.col("a"), F.col("b")).alias("f1"))
    for row in out.collect():
        a, b = pairs[row["i"]]
        if a is None:
            assert row["n"] is None and row["f1"] == 0
            continue
        n = sum((Counter(x for x in a if x) & Counter(x for x in b if x)).values())
        assert row["n"] == n and abs(row["f1"] - (2 * n / (len(a) + len(b)) if n else 0)) < 1e-9
    plan = df.select(metrics.token_f1(F.col("a"), F.col("b")).alias("f1"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort(") == 1


def test_judged_summary_counts_rows_once(spark):
    rows = spark.createDataFrame([("adversarial", 1, "wrong"), ("user", 1, "equivalent"), ("user", 2, "wrong"), (None, 2, "equivalent")], "question_type string, sample_id long, label string")
    out = answers.rescored_summary(rows)
    got = {(r["level"], r["value"]): (r["n"], r["score"]) for r in out.collect()}
    assert got[("overall", None)] == (4, 0.5) and got[("non_adversarial", None)] == (3, 2 / 3) and got[("sample", "2")] == (2, 0.5) and got[("type", "user")] == (2, 0.5)
    assert "parquet" in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["level"], r["n"]) for r in answers.rescored_summary(rows.limit(0)).collect()] == [("non_adversarial", 0)]
