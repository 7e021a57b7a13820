"""Scans of varying JSON, gapless numbers, and graphs that are replaced as a whole."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tidemark.sources import datasets, graph_store


def write(path, body):
    path.write_text(json.dumps(body))
    return str(path)


def test_both_layouts_of_a_chat_dataset(spark, tmp_path):
    say = lambda *xs: [{"speaker": s, "time": t, "dialogue": d} for s, t, d in xs]
    write(tmp_path / "a.json", {"dialogues": {"2025-01-10": {"g": say(("A", "2025-01-10 09:00:00", "one"), ("B", "late", "two"))}, "2025-01-09": {"g": [{"speaker": "C", "text": "zero"}], "h": None}}})
    write(tmp_path / "b.json", [{"date": "2025-02-02", "topic": 7, "dialogues": {"g": say(("A", "2025-02-02T10:00:00", "x"))}}, {"date": "2025-02-01", "dialogues": {"g": say(("A", "", "w"))}}, {"date": "2025-02-02", "dialogues": {"g": say(("B", "", "y")), "h": []}}])
    rows = lambda **kw: sorted((r["source"][-6], r["day"], r["group"], r["message_index"], r["text"], str(r["at"])) for r in datasets.read_chat_dataset(spark, str(tmp_path / "*.json"), **kw).collect())
    first = [("a", 1, "g", 1, "zero", "2025-01-09 00:00:00"), ("b", 1, "g", 1, "w", "2025-02-01 00:00:00")]
    both = [("a", 2, "g", 1, "one", "2025-01-10 09:00:00"), ("a", 2, "g", 2, "two", "2025-01-10 00:00:00"), ("b", 2, "g", 1, "x", "2025-02-02 10:00:00"), ("b", 2, "g", 2, "y", "2025-02-02 00:00:00")]
    assert rows() == sorted(first + both) and rows(max_days=1) == first and rows(date="2025-02-02") == both[2:]
    totals = datasets.dataset_totals(datasets.read_chat_dataset(spark, str(tmp_path / "a.json"))).first()
    assert (totals["n_days"], totals["n_groups"], totals["n_messages"], totals["first_date"], totals["last_date"]) == (2, 1, 3, "2025-01-09", "2025-01-10")
    with pytest.raises(PySparkException, match="no dialogues by date"):
        datasets.read_chat_dataset(spark, write(tmp_path / "c.txt", [{"date": "2025-01-01"}])).collect()


def test_paragraphs_of_nested_json(spark, tmp_path):
    long = lambda x: f"{x} " + "of a text that is long enough to be kept as a paragraph."
    deep = {"book": [{"b": long("Two"), "a": {"text": f"{long('One')}\n\n{long('Half')}\n\nshort"}}, [long("Two") + "\n\n" + long("Three")]], "answer": long("Never"), "n": 5, "Questions": {"q": long("Never")}}
    path = write(tmp_path / "book.json", deep)
    got = [(r["ordinal"], r["text"]) for r in datasets.json_paragraphs(spark, path).orderBy("ordinal").collect()]
    assert [(n, t.split()[0]) for n, t in got] == [(0, "One"), (1, "Half"), (2, "Two"), (3, "Three")]


def test_names_inside_payloads(spark):
    rows = spark.createDataFrame([(1, '{"a": [{"Gold": 1}], "b": {"answer": {"gold": 2}}}'), (2, '{"goldfish": 1}'), (3, "no json"), (4, None)], "id long, props string")
    got = {(r["id"], r["path"]) for r in datasets.payload_leaks(rows, "id", "props", ("gold", "answer")).collect()}
    assert got == {(1, "a.Gold"), (1, "b.answer"), (1, "b.answer.gold")}


def test_gapless_numbers_over_files(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(str(tmp_path / "p"))
    out = datasets.gapless(spark.read.parquet(str(tmp_path / "p")), "q_idx")
    assert sorted(r["q_idx"] for r in out.collect()) == list(range(1000)) and out.columns == ["id", "q_idx"]


def test_a_folder_of_results(spark, tmp_path):
    write(tmp_path / "evaluation_results_004.json", {"total_questions": 3, "correct": 2, "accuracy_by_type": {"mc": {"total": 2, "correct": 2}, "open": {"total": 1}}, "detailed_results": [{"question_id": "a_1", "question_type": "mc", "is_correct": True}, {"question_id": "a_2"}]})
    write(tmp_path / "evaluation_results_005.json", {"total_questions": 2, "correct": 0, "accuracy_by_type": {"mc": {"total": 2, "correct": 0, "more": [1]}}, "extra": {"x": 1}})
    write(tmp_path / "other.json", {"total_questions": 100})
    summaries, asked = datasets.read_result_folder(spark, str(tmp_path))
    got = {(r["level"], r["batch"], r["type"]): (r["total"], r["correct"], r["accuracy"]) for r in datasets.folder_report(summaries).collect()}
    assert got == {("batch", "004", None): (3, 2, 0.6667), ("batch", "005", None): (2, 0, 0.0), ("type", None, "mc"): (4, 2, 0.5), ("type", None, "open"): (1, 0, 0.0), ("all", None, None): (5, 2, 0.4)}
    assert sorted((r["batch"], r["question_id"], r["is_correct"]) for r in asked.collect()) == [("004", "a_1", True), ("004", "a_2", False)]


def test_a_write_that_dies_leaves_the_old_graph(spark, tmp_path):
    path = str(tmp_path / "g")
    nodes = lambda *ids: spark.createDataFrame([(i, "event") for i in ids], "id string, node_type string")
    edges = lambda *ids: spark.createDataFrame([("NEXT", i, i) for i in ids], "type string, src string, dst string")
    with pytest.raises(FileNotFoundError):
        graph_store.read_graph(spark, path)
    graph_store.write_graph(nodes("a"), edges("a"), path)
    broken = edges("b").withColumn("src", F.raise_error(F.lit("died")).cast("string"))
    with pytest.raises(PySparkException, match="died"):
        graph_store.write_graph(nodes("b"), broken, path)
    read = lambda: tuple({r[c] for r in t.collect()} for t, c in zip(graph_store.read_graph(spark, path), ("id", "src")))
    assert read() == ({"a"}, {"a"})
    held = graph_store.read_graph(spark, path)
    graph_store.write_graph(nodes("c"), edges("c"), path, {"summary": nodes("s")})
    assert read() == ({"c"}, {"c"}) and held[0].first()["id"] == "a"  # readers of the version before go on
    assert len(list((tmp_path / "g").glob("v-*"))) == 2
    graph_store.write_graph(nodes("d"), edges("d"), path)
    assert read() == ({"d"}, {"d"}) and len(list((tmp_path / "g").glob("v-*"))) == 2
    (tmp_path / "g" / "CURRENT").write_text("0 v-old\n")
    (tmp_path / "g" / ".CURRENT.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="graph schema 0"):
        graph_store.write_graph(nodes("e"), edges("e"), path)
    with pytest.raises(ValueError, match="graph schema 0"):
        graph_store.read_graph(spark, path)
