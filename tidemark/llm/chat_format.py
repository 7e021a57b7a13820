"""Chat formatting: every participant's view of a dialogue, with that speaker as assistant. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

USER, ASSISTANT, END = "<|user", "<|assistant|>", "<|end|>"


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int | None = None) -> DataFrame:
    """One row per conversation, part and participant: conv_id, perspective, part, n_turns, text, mask.

    Turns are rendered in order of turn, role, text: `<|assistant|>\\n…<|end|>\\n` for the turns of the perspective's own
    speaker, `<|user name=…|>\\n…<|end|>\\n` for all others. mask lists the spans (start, stop in code points) that the
    assistant is trained on: its text and end marker. Marker openings inside names and texts are parted ("< |").

    A dialogue is one text, part 0, as its contract asks, and so one row, however long. Where single dialogues are too long
    for a row, `part_turns` deals them: a part holds the turns whose number falls into one run of so many numbers, and
    starts its own text and mask. Identical rows are turns of their own. Null text
    is empty. A null role speaks as unnamed user and has no perspective. A null turn number comes first, in part 0. Rows
    with a null conversation id belong to no conversation and give nothing. Extra columns are not read.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    own = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("_conv"),
        (F.coalesce(F.floor(F.col(turn_col) / part_turns), F.lit(0)) if part_turns else F.lit(0)).cast("long").alias("_part"),
        F.struct(F.col(turn_col).alias("turn"), safe(F.col(role_col)).alias("role"), safe(F.coalesce(F.col(text_col), F.lit(""))).alias("text")).alias("_t"),
    )
    people = own.where("_t.role is not null").groupBy("_conv").agg(F.collect_set("_t.role").alias("_people"))
    parts = own.groupBy("_conv", "_part").agg(F.sort_array(F.collect_list("_t")).alias("_turns"))
    views = parts.join(people, "_conv").select("_conv", "_part", "_turns", F.explode("_people").alias("_me"))
    mine = lambda t: F.coalesce(t["role"] == F.col("_me"), F.lit(False))
    head = lambda t: F.when(mine(t), F.lit(f"{ASSISTANT}\n")).otherwise(F.concat(F.lit(USER), F.coalesce(F.concat(F.lit(" name="), t["role"]), F.lit("")), F.lit("|>\n")))
    pieces = F.transform("_turns", lambda t: F.struct(mine(t).alias("mine"), head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, stop: bigint>>)").alias("spans"))

    def step(acc, p):
        lo = acc["at"] + F.length(p["head"])
        hi = lo + F.length(p["body"])
        return F.struct((hi + 1).alias("at"), F.when(p["mine"], F.concat(acc["spans"], F.array(F.struct(lo.alias("start"), hi.alias("stop"))))).otherwise(acc["spans"]).alias("spans"))

    return (
        views.withColumn("_p", pieces)
        .withColumn("mask", F.aggregate("_p", start, step, lambda acc: acc["spans"]))
        .select(
            F.col("_conv").alias(conv_col),
            F.col("_me").alias("perspective"),
            F.col("_part").alias("part"),
            F.size("_turns").cast("long").alias("n_turns"),
            F.concat(F.array_join(F.transform("_p", lambda p: F.concat(p["head"], p["body"])), "\n"), F.lit("\n")).alias("text"),
            "mask",
        )
    )
