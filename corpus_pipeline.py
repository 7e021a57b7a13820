"""A training corpus from `documents`: quality rules, line dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. The stages learn or compare on their own input only (quality labels come from `labels`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, minhash, packing, quality_rules, substring
from tidemark.llm.common import cut, table, unused
from tidemark.llm.queries import tokenizer_file


def _with_text(docs: DataFrame, text) -> DataFrame:
    """docs with a new text, and n_chars (where there is one) counted anew."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test or the learned rules reject go, among them null and empty texts. Rows keep their columns;
    rows that repeat are judged each; without labels only the base test decides."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of later three-line windows go; a document that has lost every line with a word goes too.
    Null and empty texts stay as they are, as do rows without an id."""
    out = line_dedup.drop_repeated_lines(docs)
    left = out.where((F.col("_n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _with_text(left, F.col("text")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the least id. Rows that repeat an id are one document, and of
    them the row with the least hash of all its columns stays. Rows without an id or without words stay."""
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    rank = unused(docs, "rank")
    same = [F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*same), "text")
    one = left.where("doc_id is not null").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
    return one.select(*docs.columns).unionByName(left.where("doc_id is null").select(*docs.columns))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of later 20-word windows go; texts that lose none keep their layout; a document left without words
    goes. Null and empty texts and rows without an id stay as they are. A row comes out for a row: rows that share an id
    are one document seen twice, and each keeps its own text and columns."""
    out = substring.remove_repeats(docs, carry=tuple(docs.columns)).where("n_removed = 0 or kept_text <> ''")
    left = out.select("kept_text", F.col("n_removed").alias("_gone"), F.col("row"))
    text = F.when(F.col("_gone") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    chars = {"n_chars": F.when(F.col("_gone") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {}
    new = {"text": text} | chars
    return left.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 tokens."""
    pieces = packing.token_pieces(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"), with_ids=False)
    return packing.pack(pieces)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("repeats", repeats), ("packed", packed)]

#: None: learned rules and byte-pair encoding cannot be told in SQL; tests/llm holds lines, near, repeats and packed against
#: brute force, and quality against its statistics and base test.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
