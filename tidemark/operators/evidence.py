"""Evidence and claim checks: scope labels, rejects, grounded sentences, handles, constraints, query lists, judged scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label
from .metrics import token_f1

#: What a merge decision may say, and which of these retire a claim.
DECISIONS = ("COMPATIBLE", "DIFFERENT_TARGET", "SUPERSEDES", "CORRECTS", "CONFLICTS_WITH")
LIFECYCLE = ("SUPERSEDES", "CORRECTS")


def scope_labels(labels: Column, most: int = 4) -> Column:
    """Labels trimmed, without empty ones, each once whatever its case, in order, the first `most`; null gives none."""
    none = F.array().cast("array<string>")

    def step(kept, x):
        new = (F.size(kept) < most) & (x != "") & ~F.exists(kept, lambda y: F.lower(y) == F.lower(x))
        return F.when(new, F.concat(kept, F.array(x))).otherwise(kept)

    return F.aggregate(F.transform(F.filter(F.coalesce(labels, none), lambda x: x.isNotNull()), lambda x: label(x)), none, step)


def gold_items(text: Column) -> Column:
    """Items of a JSON list, a list literal in single quotes, or plain text as one item; empty and [] give none."""
    t = F.trim(F.coalesce(text, F.lit("")))
    listed = F.coalesce(F.from_json(t, "array<string>"), F.from_json(F.translate(t, "'", '"'), "array<string>"))
    plain = F.when(t == "", F.array().cast("array<string>")).otherwise(F.array(t))
    return F.when(t.startswith("["), F.filter(F.coalesce(listed, plain), lambda x: x.isNotNull() & (x != ""))).otherwise(plain)


def rejected(claims: DataFrame, by: list[str], reasons: dict[str, Column]) -> DataFrame:
    """How many claims of each group fall for each reason; the first that holds counts, claims without any do not."""
    reason = F.coalesce(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(name)) for name, hit in reasons.items()])
    return claims.withColumn("reason", reason).where("reason is not null").groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))


def cited_sentences(sentences: Column, ids: Column, most: int) -> Column:
    """The sentences of distinct ids within 1..n in order, at most `most`."""
    good = F.filter(F.array_sort(F.array_distinct(ids)), lambda i: (i >= 1) & (i <= F.size(sentences)))
    return F.transform(F.slice(good, 1, most), lambda i: F.get(sentences, i.cast("int") - 1))


def decision_fault(single: Column) -> Column:
    """Why a row (existing, incoming, decision, winner, reason, evidence, existing_dialog, incoming_dialog) is no decision.

    Null where it is one. Dialogs are orderable; evidence must lie within the two claims. `single`: the slot holds one value.
    """
    c = F.col
    lifecycle, later = c("decision").isin(*LIFECYCLE), F.when(c("existing_dialog") > c("incoming_dialog"), "existing").otherwise("incoming")
    faults = {
        "unknown_decision": ~F.coalesce(c("decision").isin(*DECISIONS), F.lit(False)),
        "no_winner": lifecycle & ~F.coalesce(c("winner").isin("existing", "incoming"), F.lit(False)),
        "no_reason": F.trim(F.coalesce(c("reason"), F.lit(""))) == "",
        "foreign_evidence": F.size(F.array_except("evidence", F.array("existing", "incoming"))) > 0,
        "different_target_in_single_slot": single & (c("decision") == "DIFFERENT_TARGET"),
        "earlier_wins": lifecycle & (c("existing_dialog") != c("incoming_dialog")) & (c("winner") != later),
    }
    return F.coalesce(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(name)) for name, hit in faults.items()])


def claim_edges(claims: DataFrame) -> DataFrame:
    """(type, src, dst) of claims (event, claim, subject, topics, at, role): who asserts, what is mentioned, when it holds."""
    node = lambda kind, *cols: F.concat_ws("::", F.lit(kind), *cols)
    edge = lambda kind, src, dst: F.struct(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"))
    event, claim, time = node("event", "event"), node("claim", "claim"), node("time", "role", F.date_format("at", "yyyy-MM-dd"))
    fixed = F.array(edge("ASSERTS", event, claim), edge("MENTIONS", event, node("subject", "subject")))
    topics = F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: edge("MENTIONS", event, node("topic", t)))
    timed = F.when(F.col("at").isNotNull(), F.array(edge("HAS_TIME", claim, time))).otherwise(F.slice(fixed, 1, 0))
    return claims.select(F.inline(F.concat(fixed, topics, timed))).distinct()


def constrained(matches: DataFrame, wanted: DataFrame, routed: DataFrame) -> DataFrame:
    """query_id, event_id, status from exact matches (query_id, constraint, event_id) of wanted (query_id, constraint).

    exact: events that meet every constraint of a query; queries without any take their routed events (query_id, event_id).
    """
    need = wanted.groupBy("query_id").agg(F.count_distinct("constraint").alias("need"))
    met = matches.join(wanted, ["query_id", "constraint"], "left_semi").groupBy("query_id", "event_id").agg(F.count_distinct("constraint").alias("met"))
    exact = met.join(need, "query_id").where("met = need").select("query_id", "event_id", F.lit("exact").alias("status"))
    rest = routed.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    return exact.unionByName(rest.select("query_id", "event_id", F.lit("routed").alias("status")))


def restore(rows: DataFrame, full: DataFrame, key: list[str], field: str, order: list[str]) -> DataFrame:
    """rows with a dropped field again, that of the last row of `full` with the same key; null keys match each other."""
    last = full.groupBy(*key).agg(F.max_by(field, F.struct(*order)).alias(field))
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in key]
    return rows.alias("r").join(last.alias("f"), on, "left").select("r.*", f"f.{field}")


def memory_dialogs(memories: DataFrame) -> DataFrame:
    """(memory_id, dialog_ids) of memories (memory_id, day, text, summary): ids named in the text, in order.

    A summary has those of all memories of its day instead.
    """
    own = memories.withColumn("ids", F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(D\d+:\d+)"), 1)))
    days = own.where("not summary").select("day", F.explode("ids").alias("i")).groupBy("day").agg(F.array_sort(F.collect_set("i")).alias("day_ids"))
    ids = F.when(F.col("summary"), F.coalesce("day_ids", F.array().cast("array<string>"))).otherwise(F.col("ids"))
    return own.join(days, "day", "left").select("memory_id", ids.alias("dialog_ids"))


def proof(states: DataFrame, by: list[str]) -> DataFrame:
    """(state_id, claim_id): a state's primary claim, the claim that retired it, and the primary claims that it retired."""
    own = states.select("state_id", F.explode(F.array_compact(F.array("primary_claim", "superseded_by"))).alias("claim_id"))
    after = states.select(*by, F.col("state_id").alias("later"), F.col("first_claim").alias("superseded_by"))
    other = states.join(after, [*by, "superseded_by"]).select(F.col("later").alias("state_id"), F.col("primary_claim").alias("claim_id"))
    return own.unionByName(other).distinct()


def siblings(states: DataFrame, by: list[str]) -> DataFrame:
    """Current states (state_id, by, n) that share subject and group with others: membership, not pairs, so a group of n has n rows."""
    sizes = states.where("status = 'current'").select("state_id", *by).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return sizes.where("n > 1")


def grounding_rows(times: DataFrame, asks_time: Column, roles: Column, sources: tuple[str, ...], order: list[Column], limit: int = 32) -> DataFrame:
    """The first `limit` time rows of each question that asks for time: by role (no roles: any) and allowed source."""
    fit = times.where(asks_time & ((F.size(roles) == 0) | F.array_contains(roles, F.col("role"))) & F.col("source").isin(*sources))
    return fit.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= limit)


def recency(state_at: Column, fact_at: Column, report_at: Column, session: Column, number: Column) -> Column:
    """An orderable key: the later of state and fact time if any, else the report's; then the dialog's order."""
    return F.struct(F.coalesce(F.greatest(state_at, fact_at), report_at).alias("at"), session.alias("session"), number.alias("number"))


def handles(units: DataFrame, claims: Column, states: Column) -> DataFrame:
    """units (query_id, handle) with the id that C1.. and S1.. name in the offered lists; others are rejected (null id)."""
    kind, n = F.substring("handle", 1, 1), F.regexp_extract("handle", r"^[CS]([1-9]\d{0,8})$", 1).try_cast("int")
    found = F.when(kind == "C", F.get(claims, n - 1)).when(kind == "S", F.get(states, n - 1))
    return units.withColumn("id", found)


def retrieval_queries(question: Column, bindings: Column, operation: Column, most: int = 4) -> Column:
    """The question, and for operations over sets the bindings' phrases, each once, at most `most`."""
    extra = F.when(operation.isin("enumerate", "count", "intersection"), bindings).otherwise(F.array().cast("array<string>"))
    return F.slice(F.filter(F.array_distinct(F.concat(F.array(question), extra)), lambda x: x.isNotNull() & (x != "")), 1, most)


def multi_answer_f1(predicted: Column, gold: Column) -> Column:
    """Mean over gold answers (arrays of tokens) of the best token F1 of any predicted one; 0 without either."""
    best = F.transform(gold, lambda g: F.coalesce(F.array_max(F.transform(predicted, lambda p: token_f1(p, g))), F.lit(0.0)))
    return F.when(F.size(gold) > 0, F.aggregate(best, F.lit(0.0), lambda s, v: s + v) / F.size(gold)).otherwise(0.0)


def judged_f1(scores: Column, n_predicted: Column, n_gold: Column) -> dict[str, Column]:
    """Harsh and lenient F1 from a judge's scores of gold items, each taken into 0..1, their sum at most n_gold.

    Harsh precision counts all predictions, lenient at most n_gold of them where there is gold. A part without a
    denominator is null: both null give 1, one null gives 0.
    """
    total = F.least(F.aggregate(F.coalesce(scores, F.array().cast("array<double>")), F.lit(0.0), lambda s, v: s + F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))), n_gold.cast("double"))
    recall = F.when(n_gold > 0, F.least(F.lit(1.0), total / n_gold))

    def f1(n: Column) -> Column:
        p = F.when(n > 0, F.least(F.lit(1.0), total / n))
        return F.when(p.isNull() & recall.isNull(), 1.0).when(p + recall > 0, 2 * p * recall / (p + recall)).otherwise(0.0)

    return {"lenient": f1(F.when(n_gold > 0, F.least(n_predicted, n_gold)).otherwise(n_predicted)), "harsh": f1(n_predicted)}


def bin_zero(score: Column, bin_: Column, n_gold: Column, n_retrieved: Column, abstained: Column) -> Column:
    """A score of 0 becomes 1 where there was nothing to find and nothing was given."""
    return F.when((bin_ == "0") & (n_gold == 0) & (score == 0) & ((n_retrieved == 0) | abstained), 1.0).otherwise(score)
