"""Scans of dialogue, group-chat, chapter and graph files, and sinks; explicit schemas throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import any_time
from .datasets import gapless, open_json

#: Categories of dialogue questions by number.
CATEGORIES = {1: "multi-hop", 2: "temporal", 3: "open-domain", 4: "single-hop", 5: "adversarial"}
#: Columns of a book's question table.
BOOK_COLUMNS = ("question", "cue", "retrieval_type", "get", "correct_answer", "correct_answer_chapters", "bins_items_correct_answer")


def _elements(spark: SparkSession, path: str, kind: str, name: str) -> DataFrame:
    """The elements of JSON arrays as structs of `kind`, a row each, so that no file is one row; also JSON objects, one a file."""
    rows = spark.read.schema(kind).option("multiLine", True).json(path)
    return rows.select(F.struct(*[F.col(c) for c in rows.columns]).alias(name))


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """Turns of a JSON array of samples: sessions by number, turns without an id dropped, text by its first filled field."""
    turn = "struct<dia_id: string, speaker: string, text: string, clean_text: string, compressed_text: string, blip_caption: string, query: string>"
    raw = _elements(spark, path, "sample_id string, conversation map<string, string>", "s")
    parts = raw.select("s.sample_id", F.explode("s.conversation").alias("key", "body"), F.col("s.conversation").alias("all")).where(F.col("key").rlike(r"^session_\d+$"))
    turns = parts.select("sample_id", F.regexp_extract("key", r"(\d+)", 1).cast("int").alias("session"), F.col("all")[F.concat("key", F.lit("_date_time"))].alias("session_time"), F.posexplode(F.from_json("body", f"array<{turn}>")).alias("ord", "t"))
    return turns.where("t.dia_id is not null").select("sample_id", "session", "session_time", "ord", "t.dia_id", "t.speaker", F.coalesce("t.text", "t.clean_text", "t.compressed_text").alias("text"), F.col("t.blip_caption").alias("image_caption"), F.col("t.query").alias("image_query"))


def read_group_chat(spark: SparkSession, path: str) -> DataFrame:
    """Messages of daily records {topic_id, date, dialogues: {group: [message]}}; blank text dropped, white space collapsed."""
    raw = _elements(spark, path, "topic_id string, date string, dialogues map<string, array<struct<speaker: string, time: string, dialogue: string, text: string, message_index: int>>>", "d")
    rows = raw.select("d.topic_id", "d.date", F.explode("d.dialogues").alias("group", "messages")).select("topic_id", "date", "group", F.posexplode("messages").alias("ord", "m"))
    text = F.trim(F.regexp_replace(F.coalesce("m.text", "m.dialogue", F.lit("")), r"\s+", " "))
    out = rows.select("topic_id", "date", "group", F.coalesce("m.message_index", F.col("ord") + 1).alias("message_index"), "m.speaker", F.col("m.time").alias("time"), text.alias("text"))
    return out.where("text <> ''").withColumn("event_id", F.concat_ws(":", "topic_id", "date", "group", F.col("message_index").cast("string"))).withColumn("occurred_at", F.coalesce(any_time(F.col("time")), any_time(F.col("date"))))


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    """Chapters of one book text, split at 'Chapter N' headings."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"(?=Chapter \d+\n\n)")).alias("i", "part"))
    return raw.where(F.col("part").rlike(r"^Chapter \d+\n\n")).select(F.regexp_extract("part", r"^Chapter (\d+)", 1).cast("int").alias("chapter_id"), F.regexp_replace("part", r"^Chapter \d+\n\n|\s+$", "").alias("text"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON array of samples: id by sample and place, category named, evidence ids without brackets, each once, and their sessions."""
    item = "struct<question: string, answer: string, adversarial_answer: string, category: int, evidence: array<string>>"
    raw = _elements(spark, path, f"sample_id string, qa array<{item}>", "s")
    rows = raw.select("s.sample_id", F.posexplode("s.qa").alias("qa_index", "q"))
    ids = F.array_distinct(F.flatten(F.transform(F.coalesce("q.evidence", F.array().cast("array<string>")), lambda x: F.regexp_extract_all(x, F.lit(r"(D\d+:\d+)"), 1))))
    kind = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])[F.col("q.category")]
    out = rows.select("sample_id", F.format_string("%s::qa_%04d", "sample_id", "qa_index").alias("question_id"), "qa_index", "q.category", kind.alias("question_type"), "q.question", F.coalesce("q.answer", "q.adversarial_answer").alias("answer"), ids.alias("evidence_dialog_ids"))
    return out.withColumn("evidence_session_ids", F.array_distinct(F.transform("evidence_dialog_ids", lambda x: F.concat(F.lit("session_"), F.regexp_extract(x, r"^D(\d+)", 1)))))


def read_choices(spark: SparkSession, path: str) -> DataFrame:
    """Questions {id, Q, A, options, topic_id} of a JSON array: options sorted as 'K. text', the right letter by letter, prefix or text; open-ended ones have none."""
    raw = _elements(spark, path, "id string, topic_id string, Q string, A string, options map<string, string>", "q")
    options = F.array_sort(F.transform(F.map_entries(F.coalesce("q.options", F.create_map().cast("map<string,string>"))), lambda e: F.concat_ws(". ", e["key"], e["value"])))
    rows = raw.select(F.col("q.id").alias("question_id"), "q.topic_id", F.col("q.Q").alias("question"), F.trim("q.A").alias("answer"), options.alias("options"))
    letter = lambda test: F.substring(F.get(F.filter("options", test), F.lit(0)), 1, 1)
    said = F.lower("answer")
    right = F.coalesce(letter(lambda o: F.lower(F.substring(o, 1, 1)) == said), letter(lambda o: F.startswith(said, F.lower(F.substring(o, 1, 2)))), letter(lambda o: F.lower(F.trim(F.substring(o, 4, 1_000_000))) == said))
    return rows.withColumn("question_type", F.when(F.size("options") > 0, "multiple_choice").otherwise("open_ended")).withColumn("correct", right)


def read_book_questions(spark: SparkSession, path: str) -> DataFrame:
    """A book's question table (Parquet): its columns must be there; null lists become empty, q_idx, where missing, counts rows from 0 in the order of files and rows."""
    df = spark.read.parquet(path)
    if missing := sorted(set(BOOK_COLUMNS) - set(df.columns)):
        raise ValueError(f"question table without {', '.join(missing)}")
    lists = {c: F.coalesce(c, F.array().cast(df.schema[c].dataType)) for c in ("correct_answer", "correct_answer_chapters")}
    if "q_idx" in df.columns:
        return df.withColumns(lists)
    return gapless(df, "q_idx").withColumns(lists)


def read_results(spark: SparkSession, path: str, keys: tuple[str, ...] = ("rows", "results", "items")) -> DataFrame:
    """Rows (question_id, question, answer, source) of result files: JSON objects that hold them under one of the keys; rows without question or answer go."""
    held = [F.try_variant_get("v", f"$.{k}", "array<struct<question_id: string, question: string, answer: string>>") for k in keys]
    rows = open_json(spark, path).select("source", F.explode(F.coalesce(*held)).alias("r"))
    return rows.select("r.*", "source").where("question <> '' and answer <> ''")


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A report as JSON lines or CSV with a header, in as many files as the table has partitions."""
    if fmt not in ("json", "csv"):
        raise ValueError(f"no report format: {fmt}")
    df.write.mode("overwrite").options(**({"header": "true"} if fmt == "csv" else {})).format(fmt).save(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of the files under a path, for a manifest of what a graph was made from."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
