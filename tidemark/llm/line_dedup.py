"""Line dedup: overlapping three-line windows, hashed, found again anywhere, later occurrences removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, unused

WINDOW = 3
#: Characters of the word rule's white space, without the line break that lines are split at.
BLANK = " \t\x0b\x0c\r"


def line_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b, id, p): two independent hashes of three consecutive lines with a word, the id, and the numbers of the lines.

    A row's lines are split and hashed once, in nested array functions, so nothing is evaluated again for a filter.
    """
    line = lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"), (F.btrim(x, F.lit(BLANK)) != "").alias("w"))
    solid = F.filter(F.transform(F.split(F.col(text_col), "\n", -1), line), lambda s: s["w"])

    def window(v, j):
        rows = [F.get(v, j + k) for k in range(WINDOW)]
        return F.struct(*[F.xxhash64(*[r[c] for r in rows]).alias(c) for c in "ab"], F.array(*[r["i"] for r in rows]).alias("p"))

    starts = lambda v: F.when(F.size(v) >= WINDOW, F.sequence(F.lit(0), F.size(v) - WINDOW)).otherwise(F.array().cast("array<int>"))
    every = F.flatten(F.transform(F.array(solid), lambda v: F.transform(starts(v), lambda j: window(v, j))))
    some = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return some.select(F.col(id_col).alias("id"), F.explode(every).alias("w")).select("w.a", "w.b", "id", "w.p")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines that repeated windows cover taken out of `text_col`, plus `_n_lines` and `_n_removed`.

    A window is three consecutive lines that each hold a word; lines without a word lie between and never count or go.
    A window is a later one if the same three lines also start a window earlier: in a smaller id, or earlier in the same
    document. Every line that some later window covers goes, all others stay, joined by \\n as before.

    Null or empty text has no windows and stays as it is (null: 0 lines). Rows with a null id are not compared and stay
    whole. Rows that share an id are taken as one document seen twice: each loses what any of them would lose. Extra
    columns pass through, whatever their names; input columns named `_n_lines` or `_n_removed` are replaced. An empty
    table gives no rows.

    Plan: windows are made once and written; they travel as two 64-bit hashes and a coordinate, never as text. The first
    place of a window comes from an aggregate that combines before the shuffle, so a window held by a third of all rows
    costs one row a task; it is written too, so that the join back, an inner sort-merge join of two exchanges, can be
    split by adaptive execution. Text is shuffled once, to meet its covered lines.
    """
    spread = cut(line_windows(docs, id_col, text_col))
    place = F.struct("id", F.get("p", F.lit(0)))
    first = cut(spread.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("a", "b", "first"))
    later = spread.join(first, ["a", "b"]).where(place > F.col("first"))
    gone, key = unused(docs, "gone"), unused(docs, "key")
    covered = later.select(F.col("id").alias(key), F.explode("p").alias("p")).groupBy(key).agg(F.collect_set("p").alias(gone))
    text = F.col(text_col)
    # what stays is the numbers of all lines without the covered ones, a set difference by hash: work as lines, not lines by removals
    stay = lambda v: F.array_except(F.sequence(F.lit(0), F.size(v) - 1), F.col(gone))
    kept = F.flatten(F.transform(F.array(F.split(text, "\n", -1)), lambda v: F.transform(stay(v), lambda i: F.get(v, i))))
    return (
        docs.join(covered, F.col(id_col) == F.col(key), "left")
        .withColumn("_n_lines", F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long"))
        .withColumn("_n_removed", F.coalesce(F.size(gone), F.lit(0)).cast("long"))
        .withColumn(text_col, F.when(F.col(gone).isNull(), text).otherwise(F.array_join(kept, "\n")))
        .drop(key, gone)
    )
