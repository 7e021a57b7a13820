"""Scans of JSON whose layout varies, by values of open type: chat datasets in two layouts, books as nested JSON, folders of
results; and the search for names that must not be inside payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import any_time, passages
from ..operators.lineage import cut
from ..operators.retrieval import ranked

#: Names that hold answers, which no memory may be made of.
ANSWER_KEYS = ("answer", "answers", "correct_answer", "gold", "gold_answer", "ground_truth", "qa", "question", "questions", "evidence")


def open_json(spark: SparkSession, path: str) -> DataFrame:
    """(source, ord, v): JSON files as values of open type, a row for each element of an outer list, else one for the file."""
    rows = spark.read.option("multiLine", True).option("singleVariantColumn", "v").json(path).select(F.col("_metadata.file_path").alias("source"), "v")
    each = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    return rows.select("source", F.posexplode(each).alias("ord", "v"))


def _as(v: Column | str, kind: str, path: str = "$") -> Column:
    return F.try_variant_get(v, path, kind)


def read_chat_dataset(spark: SparkSession, path: str, max_days: int | None = None, date: str | None = None) -> DataFrame:
    """Messages of group-chat files: source, date, group, message_index, speaker, text, at, day (1 for a source's first date).

    A file is an object {"dialogues": {date: {group: [message]}}} or a list of {"date", "dialogues": {group: [message]}};
    records of one date are one day, their messages in order. The first `max_days` dates of each source stay, or `date`
    alone. A time that no layout fits is midnight of its date. A file of neither layout is an error; null groups are empty.
    """
    raw = spark.read.schema("date string, dialogues variant").option("multiLine", True).json(path)
    raw = raw.select(F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("ord"), "date", "dialogues")
    days, own = _as("dialogues", "map<string, variant>"), F.col("date")
    layout = F.when(days.isNull(), F.raise_error(F.concat(F.lit("no dialogues by date in "), F.col("source"), F.lit(", record "), F.col("ord")))).otherwise(
        F.when(own.isNotNull(), F.array(F.struct(own.alias("key"), F.to_variant_object(days).alias("value")))).otherwise(F.map_entries(days))
    )
    dated = raw.select("source", "ord", F.explode(layout).alias("d")).select("source", "ord", F.col("d.key").alias("date"), _as("d.value", "map<string, variant>").alias("groups"))
    kept = dated.select("source", "date").distinct().withColumn("day", F.dense_rank().over(Window.partitionBy("source").orderBy("date")))
    if date is not None:
        kept = kept.where(F.col("date") == date)
    if max_days is not None:
        kept = kept.where(F.col("day") <= max_days)
    rows = dated.join(kept, ["source", "date"]).select("source", "date", "day", "ord", F.explode("groups").alias("group", "messages"))
    said = rows.select("source", "date", "day", "group", "ord", F.posexplode(_as("messages", "array<variant>")).alias("pos", "m"))
    text = F.coalesce(_as("m", "string", "$.dialogue"), _as("m", "string", "$.text"), F.lit(""))
    when = F.coalesce(any_time(_as("m", "string", "$.time")), any_time(F.col("date")))
    out = said.select("source", "date", "day", "group", "ord", "pos", _as("m", "string", "$.speaker").alias("speaker"), text.alias("text"), when.alias("at"))
    return ranked(out, ["source", "date", "group"], [F.col("ord")], [F.col("pos")], "message_index").drop("ord", "pos")


def dataset_totals(messages: DataFrame) -> DataFrame:
    """source, n_days, n_groups, n_messages, first_date, last_date of each dataset."""
    days = messages.groupBy("source", "date", "group").agg(F.count(F.lit(1)).alias("n"))
    return days.groupBy("source").agg(F.count_distinct("date").alias("n_days"), F.count_distinct("group").alias("n_groups"), F.sum("n").alias("n_messages"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def walk(rows: DataFrame, v: str = "v", without: tuple[str, ...] = ()) -> DataFrame:
    """rows with `place` (positions from the outside in), `path` (names), `key` and `v`: every value inside `v`, at any depth.

    One level a round, each written; a round joins nothing. What stands under a name in `without` is left out, in any case
    of letters. Keys of an object come in the order of their names. Null values end a walk. Rows of `rows` keep their columns.
    """
    keep = [c for c in rows.columns if c != v]
    names = [n.lower() for n in without]
    level = cut(rows.select(*keep, F.array().cast("array<int>").alias("place"), F.lit("").alias("path"), F.lit(None).cast("string").alias("key"), F.col(v).alias("v")))
    levels = [level]
    while True:
        inner = level.where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")).alias("o").lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("o.v").outer()).alias("i"))
        dot = F.when(F.col("o.path") == "", F.col("i.key")).otherwise(F.concat_ws(".", "o.path", "i.key"))
        path = F.when(F.col("i.key").isNull(), F.col("o.path")).otherwise(dot)
        below = inner.where(F.col("i.key").isNull() | ~F.lower("i.key").isin(*names)) if names else inner
        level = cut(below.select(*[F.col(f"o.`{c}`").alias(c) for c in keep], F.array_append("o.place", F.col("i.pos")).alias("place"), path.alias("path"), F.col("i.key").alias("key"), F.col("i.value").alias("v")))
        if not level.limit(1).count():
            break
        levels.append(level)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def json_paragraphs(spark: SparkSession, path: str, without: tuple[str, ...] = ANSWER_KEYS) -> DataFrame:
    """(source, ordinal, text): paragraphs of all strings of each JSON file outside the names `without`, each text once.

    A paragraph that a file repeats stays where it comes first; ordinals count from 0 without gaps in each file.
    """
    texts = walk(open_json(spark, path), without=without).where(F.schema_of_variant("v") == "STRING")
    parts = texts.select("source", "ord", "place", F.posexplode(passages(_as("v", "string"))).alias("pos", "text"))
    first = parts.groupBy("source", "text").agg(F.min(F.struct("ord", "place", "pos")).alias("at"))
    run = F.when(F.size("at.place") > 0, F.get("at.place", F.lit(0))).otherwise(0)
    numbered = ranked(first, ["source"], [F.col("at.ord"), run], [F.col("at.place"), F.col("at.pos")], "n")
    return numbered.select("source", (F.col("n") - 1).alias("ordinal"), "text")


def payload_leaks(rows: DataFrame, id_col: str, json_col: str, banned: tuple[str, ...]) -> DataFrame:
    """(id, path): names in `banned`, in any case of letters, at any depth of a JSON text; text that is no JSON holds none."""
    parsed = rows.select(F.col(id_col).alias("id"), F.try_parse_json(F.col(json_col)).alias("v")).where("v is not null")
    return walk(parsed).where(F.lower("key").isin(*[b.lower() for b in banned])).select("id", "path").distinct()


def read_result_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((batch, type, total, correct), (batch, question_id, question_type, is_correct)) of evaluation_results_<batch>.json files.

    Files are objects of unlike fields; type is null in the row of a batch's own totals; a missing number is 0.
    """
    raw = spark.read.option("multiLine", True).option("singleVariantColumn", "v").option("pathGlobFilter", "evaluation_results_*.json").json(path)
    files = raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^evaluation_results_(.*)\.json$", 1).alias("batch"), "v")
    number = lambda v, at: F.coalesce(_as(v, "long", at), F.lit(0).cast("long"))
    whole = files.select("batch", F.lit(None).cast("string").alias("type"), number("v", "$.total_questions").alias("total"), number("v", "$.correct").alias("correct"))
    kinds = files.select("batch", F.explode(_as("v", "map<string, variant>", "$.accuracy_by_type")).alias("type", "s"))
    kinds = kinds.select("batch", "type", number("s", "$.total").alias("total"), number("s", "$.correct").alias("correct"))
    asked = files.select("batch", F.explode(_as("v", "array<variant>", "$.detailed_results")).alias("q"))
    asked = asked.select("batch", _as("q", "string", "$.question_id").alias("question_id"), _as("q", "string", "$.question_type").alias("question_type"), F.coalesce(_as("q", "boolean", "$.is_correct"), F.lit(False)).alias("is_correct"))
    return whole.unionByName(kinds), asked


def folder_report(summaries: DataFrame) -> DataFrame:
    """(level, batch, type, total, correct, accuracy): each batch, each type over all batches, and all; of no questions, 0."""
    own = summaries.where("type is null")
    parts = [
        own.select(F.lit("batch").alias("level"), "batch", "type", "total", "correct"),
        summaries.where("type is not null").groupBy("type").agg(F.sum("total").alias("total"), F.sum("correct").alias("correct")).select(F.lit("type").alias("level"), F.lit(None).cast("string").alias("batch"), "type", "total", "correct"),
        own.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("correct"), F.lit(0)).alias("correct")).select(F.lit("all").alias("level"), F.lit(None).cast("string").alias("batch"), F.lit(None).cast("string").alias("type"), "total", "correct"),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("accuracy", F.round(F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0), 4))


def gapless(df: DataFrame, name: str) -> DataFrame:
    """A Parquet scan with its rows numbered from 0 in the order of files and of rows inside them, without gaps.

    Two passes: rows are counted by file, and each row's place in its file is moved by the sizes of the files before. Only
    a row a file meets in one task.
    """
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_file", F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(before, "_file").withColumn(name, F.col("_before") + F.col("_at")).drop("_file", "_at", "_before")
