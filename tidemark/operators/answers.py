"""Answers: question frames, rules for time roles, compiled answers and citations, category scores, samples for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answer_tokens, plain_tokens
from .evidence import multi_answer_f1
from .lineage import cut
from .metrics import token_f1
from .times import clean_text, same_date

#: What a question may ask for, and how it counts.
OPERATIONS = ("lookup", "enumerate", "count", "intersection", "compare", "boolean", "inference")
OCCURRENCES = ("occurrence", "occurrences", "event", "events", "visit", "visits", "time", "times")
ENTITIES = ("entity", "entities", "people", "persons", "items")
PLAIN_SLOTS = ("", "answer", "object", "short description", "value")
#: Wording of answers that give none, words of doubt in short ones, and words that keep those.
#: Ways to say that there is no answer.
NO_ANSWERS = (
    r"i don'?t know",
    r"no relevant information",
    r"no information (?:is )?provided",
    r"(?:cannot|can'?t) (?:find|provide|determine|identify)",
    r"(?:unable|not able) to (?:find|provide|determine|identify)",
    r"no (?:relevant )?(?:events?|data|details|information)",
    r"none found",
    r"not (?:available|provided|given)",
    r"insufficient information",
    r"no such (?:events?|information|data)",
    r"cannot be determined",
    r"not enough information",
)
NO_ANSWER = "|".join(NO_ANSWERS)
DOUBT = ("unknown", "unclear", "uncertain", "unsure", "no", "none", "nothing")
PLACES = ("located", "place", "area", "building", "room", "street", "city", "country")
#: Categories of questions by number.
CATEGORIES = {1: "multi-hop", 2: "temporal", 3: "open-domain", 4: "single-hop", 5: "adversarial"}
#: How a judged answer says that there is none, and numbers written as words.
NO_ANSWER_GIVEN = r"(?i)no information available|not mentioned in the conversation"
NUMBER_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19", "twenty": "20"}

_NONE = "array<string>"


def _words(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _filled(values: Column) -> Column:
    """Trimmed, none empty or null, each once."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast(_NONE)), lambda v: F.trim(v)), lambda v: F.coalesce(v, F.lit("")) != ""))


def participant_key(text: Column) -> Column:
    """Tokens of a name without possessive endings, joined by spaces."""
    return F.array_join(plain_tokens(F.regexp_replace(F.coalesce(text, F.lit("")), "[’']s", " ")), " ")


def abstains(answer: Column) -> Column:
    """Whether an answer says that there is none; null and empty answers do not."""
    bare = F.lower(F.trim(F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?s)<think>.*?</think>", "")))
    words = F.split(bare, r"\s+")
    return bare.rlike(NO_ANSWER) | ((F.size(words) <= 15) & F.arrays_overlap(words, _words(*DOUBT)) & ~F.arrays_overlap(words, _words(*PLACES)))


def frame(raw: Column) -> Column:
    """A question's frame from its fields (operation, count_unit, requested_slot, entities, required_bindings)."""
    low = lambda c, other: F.lower(F.trim(F.coalesce(c, F.lit(other))))
    said, unit = low(raw["operation"], "lookup"), low(raw["count_unit"], "none")
    op = F.when(said.isin(*OPERATIONS), said).otherwise("lookup")
    counted = F.when(unit.isin(*OCCURRENCES), "occurrences").when(unit.isin(*ENTITIES), "entities").when(unit == "none", "none").otherwise("stated_number")
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    key = lambda c: F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    bindings = F.transform(F.filter(raw["required_bindings"], lambda b: b.isNotNull()), lambda b: F.struct(text(b["subject"]).alias("subject"), key(b["relation"]).alias("relation"), text(b["object"]).alias("object")))
    kept = F.filter(bindings, lambda b: (b["subject"] != "") | (b["relation"] != "") | (b["object"] != ""))
    slot = F.coalesce(F.nullif(text(raw["requested_slot"]), F.lit("")), F.lit("answer"))
    return F.struct(_filled(raw["entities"]).alias("entities"), kept.alias("required_bindings"), slot.alias("requested_slot"), op.alias("operation"), F.when(op == "count", counted).otherwise("none").alias("count_unit"))


def wanted_roles(question: Column) -> Column:
    """Time roles a question asks for by its wording, at most two, and whether the newest comes first."""
    recent, done = question.rlike(r"(?i)\b(recently|lately|recent|latest)\b"), question.rlike(r"(?i)\b(completed|finished)\b")
    roles = F.concat(F.when(recent, _words("occurred_at", "started_at", "updated_at")).otherwise(F.array().cast(_NONE)), F.when(done, _words("completed_at")).otherwise(F.array().cast(_NONE)))
    return F.struct(roles.alias("all"), F.slice(roles, 1, 2).alias("kept"), F.coalesce(recent, F.lit(False)).alias("newest_first"))


def citations(cited: Column, allowed: Column) -> Column:
    """Ids of the form D<session>:<number> among those allowed, in order, each once."""
    return F.array_intersect(F.filter(_filled(cited), lambda x: x.rlike(r"^D\d+:\d+$")), F.coalesce(allowed, F.array().cast(_NONE)))


def compiled(operation: Column, unit: Column, slot: Column, answer: Column, values: Column, counted: Column) -> Column:
    """The answer by what was asked: the first value of a named slot, the number of distinct events, a list; else as said."""
    v = _filled(values)
    return (
        F.when((operation == "lookup") & ~F.lower(F.trim(F.coalesce(slot, F.lit("")))).isin(*PLAIN_SLOTS) & (F.size(v) > 0), F.get(v, F.lit(0)))
        .when((operation == "count") & (unit == "occurrences") & (F.size(_filled(counted)) > 0), F.size(_filled(counted)).cast("string"))
        .when(operation.isin("enumerate", "intersection") & (F.size(v) > 0), F.array_join(v, ", ")).otherwise(F.trim(F.coalesce(answer, F.lit(""))))
    )


def category_score(category: Column, said: Column, gold: Column) -> Column:
    """Score of an answer by its question's category; null for an unknown category."""
    low, whole = F.lower(F.coalesce(said, F.lit(""))), F.coalesce(gold, F.lit(""))
    parts = lambda t: F.transform(F.split(F.coalesce(t, F.lit("")), ","), answer_tokens)
    no = F.contains(low, F.lit("no information available")) | F.contains(low, F.lit("not mentioned"))
    one = lambda g: token_f1(answer_tokens(said), answer_tokens(g))
    return F.when(category == 5, no.cast("double")).when(category == 3, one(F.trim(F.split(whole, ";")[0]))).when(category == 1, multi_answer_f1(parts(said), parts(whole))).when(category.isin(2, 4), one(whole))


def plain_numbers(text: Column) -> Column:
    """Words of an answer without articles, numbers as digits, joined by spaces."""
    known = F.create_map(*[F.lit(x) for w, n in NUMBER_WORDS.items() for x in (w, n)])
    words = F.filter(F.split(F.regexp_replace(clean_text(text), "[^a-z0-9]+", " "), " "), lambda w: ~w.isin("", "a", "an", "the"))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w)), " ")


def judgment(question_type: Column, f1: Column, said: Column, gold: Column) -> Column:
    """(label, reason) by rules in order: adversarial questions by abstention, an exact answer, abstention, one date, one
    number; null where no rule decides."""
    f1, gave_up = F.coalesce(f1, F.lit(0.0)), F.coalesce(said, F.lit("")).rlike(NO_ANSWER_GIVEN)
    adversarial, a, b = F.coalesce(question_type == "adversarial", F.lit(False)), plain_numbers(gold), plain_numbers(said)
    # an answer with a number holds a digit or a number's name as a word: only these are compared by words
    may = F.lower(gold).rlike(f"[0-9]|(?<![a-z0-9])(?:{'|'.join(NUMBER_WORDS)})(?![a-z0-9])")
    number = may & (a == b) & a.rlike("[0-9]") & (clean_text(gold) != clean_text(said))
    told = lambda label, reason: F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"))
    return F.coalesce(
        F.when(adversarial & ((f1 >= 1.0) | gave_up), told("equivalent", "adversarial_abstention")), F.when(adversarial, told("wrong", "adversarial_not_abstained")),
        F.when(f1 >= 1.0, told("equivalent", "official_f1_exact")), F.when(gave_up, told("wrong", "abstained_with_available_gold")),
        F.when(same_date(gold, said), told("equivalent", "date_format_or_granularity")), F.when(number, told("equivalent", "number_format")),
    )


def judgment_key(*parts: Column) -> Column:
    """Hash of what a judge saw; null differs from an empty text."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def rescored(rows: DataFrame, judged: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """rows (key, question_type, answer_f1, hypothesis, gold_answer, ...) with label and reason: by rule, else the judged
    label (key, label), and for judged equivalents the verified one where that table is given. A row left without a
    label fails the job that reads it."""
    one = lambda t, name: t.groupBy("key").agg(F.min("label").alias(name))
    ruled = rows.withColumn("rule", judgment(F.col("question_type"), F.col("answer_f1"), F.col("hypothesis"), F.col("gold_answer"))).join(one(judged, "judged"), "key", "left")
    label, reason = F.col("judged"), F.lit("judged")
    if verified is not None:
        ruled = ruled.join(one(verified, "verified"), "key", "left")
        again = label == "equivalent"
        label, reason = F.when(again, F.col("verified")).otherwise(label), F.when(again, F.lit("verified")).otherwise(reason)
    out = ruled.withColumns({"label": F.coalesce(F.col("rule")["label"], label), "reason": F.coalesce(F.col("rule")["reason"], reason)})
    known = F.when(F.col("label").isNull(), F.raise_error(F.concat(F.lit("no label for "), F.col("key")))).otherwise(F.col("label"))
    return out.withColumn("label", known).drop("rule", "judged", "verified")


def rescored_summary(rows: DataFrame) -> DataFrame:
    """n and share of equivalent labels: overall, by type, by sample, and without adversarial questions. Rows are counted by
    type and sample once, and these counts are written."""
    ok = F.when(F.col("label") == "equivalent", 1.0).otherwise(0.0)
    rows = cut(rows.groupBy("question_type", "sample_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(ok).alias("ok")))
    scores = (F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), (F.sum("ok") / F.sum("rows")).alias("score"))
    level = F.when(F.grouping("question_type") == 0, "type").when(F.grouping("sample_id") == 0, "sample").otherwise("overall")
    every = rows.groupingSets([["question_type"], ["sample_id"], []], "question_type", "sample_id").agg(level.alias("level"), *scores)
    every = every.select("level", F.coalesce(F.col("question_type").cast("string"), F.col("sample_id").cast("string")).alias("value"), "n", "score")
    rest = rows.where(~F.coalesce(F.col("question_type") == "adversarial", F.lit(False))).agg(*scores)
    return every.unionByName(rest.select(F.lit("non_adversarial").alias("level"), F.lit(None).cast("string").alias("value"), "n", "score"))


def stratified(rows: DataFrame, bin_: str, key: str, targets: dict[str, int], seed: int = 42) -> DataFrame:
    """As many rows of each bin as its target says, by least hash of key and seed: the same rows at any partitioning. Bins without a target go."""
    due = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])[F.col(bin_)]
    order = Window.partitionBy(bin_).orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key)
    return rows.withColumn("_due", due).where("_due is not null").withColumn("_r", F.row_number().over(order)).where("_r <= _due").drop("_due", "_r")


def merged_results(summaries: DataFrame) -> DataFrame:
    """Results (batch, type, total, correct) by type and over all (type null), with accuracy; accuracy of no questions is 0."""
    sums = summaries.groupingSets([["type"], []], "type").agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"), F.count_distinct("batch").alias("batches"))
    return sums.withColumn("accuracy", F.round(F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0), 4))


def cue_slots(cue: Column, completed: Column, most: int = 4) -> Column:
    """(slot, value) pairs of a cue: its slots *, t, s, e, c paired in order with the {...} tokens of the completed cue; none or over `most` tokens: empty."""
    slots = F.regexp_extract_all(F.coalesce(cue, F.lit("")), F.lit(r"(\*|\b[tsec]\b)"), 1)
    tokens = F.regexp_extract_all(F.coalesce(completed, F.lit("")), F.lit(r"\{([^{}]*)\}"), 1)
    active = F.filter(slots, lambda s: s != "*")
    n = F.least(F.size(active), F.size(tokens))
    pairs = F.zip_with(F.slice(active, 1, n), F.slice(tokens, 1, n), lambda s, t: F.struct(s.alias("slot"), F.trim(t).alias("value")))
    return F.when((F.size(tokens) > 0) & (F.size(tokens) <= most), pairs).otherwise(F.slice(pairs, 1, 0))


def content_match(asked: Column, found: Column, important: tuple[str, ...], rules: tuple[tuple[tuple[str, ...], tuple[str, ...], float, float], ...] = ()) -> Column:
    """Score of found terms for asked ones: 2 a match (5 if important), 10 times the share matched, less 8 under a fifth.

    A rule (needs, one of, gain, loss) counts where all it needs was asked: gain if one of its terms was found, else
    minus loss. No terms asked: 0.
    """
    q = F.array_distinct(F.coalesce(asked, F.array().cast(_NONE)))
    doc = F.coalesce(found, F.array().cast(_NONE))
    hit = F.array_intersect(q, doc)
    share = F.size(hit) / F.size(q)
    score = 2.0 * F.size(hit) + 10 * share - F.when(share < 0.2, 8.0).otherwise(0.0)
    score = score + 3.0 * F.size(F.array_intersect(hit, _words(*important)))
    for needs, of, gain, loss in rules:
        score = score + F.when(F.size(F.array_intersect(q, _words(*needs))) == len(set(needs)), F.when(F.arrays_overlap(doc, _words(*of)), gain).otherwise(-loss)).otherwise(0.0)
    return F.when(F.size(q) > 0, score).otherwise(0.0)


def folded_terms(text: Column, aliases: dict[str, str], stop: tuple[str, ...]) -> Column:
    """Terms of a text: alias where there is one, else without ing, ed, es or s if four letters or more are left; short and stop terms go."""
    named = F.create_map(*[F.lit(x) for pair in (aliases or {"": ""}).items() for x in pair])

    def term(t: Column) -> Column:
        cut = F.when(F.lit(False), t)
        for end in ("ing", "ed", "es", "s"):
            cut = cut.when(F.endswith(t, F.lit(end)) & (F.length(t) > len(end) + 3), F.substr(t, F.lit(1), F.length(t) - len(end)))
        return F.coalesce(named[t], cut.otherwise(t))

    return F.filter(F.transform(plain_tokens(text), term), lambda t: (F.length(t) >= 3) & ~t.isin("", *stop))


def compared(retrieved: DataFrame, gold: DataFrame, field_of: dict[str, str]) -> DataFrame:
    """Retrieved (q_idx, items) beside gold (q_idx, retrieval_type, items), with the field of the type and set scores; a question without retrieval has none."""
    both = gold.select("q_idx", "retrieval_type", F.array_distinct("items").alias("gold")).join(retrieved.select("q_idx", F.array_distinct("items").alias("got")), "q_idx", "left")
    got = F.coalesce("got", F.slice("gold", 1, 0))
    same, n, m = F.size(F.array_intersect(got, "gold")), F.size(got), F.size("gold")
    f1 = F.when((n == 0) & (m == 0), 1.0).when(n + m > 0, 2.0 * same / (n + m)).otherwise(0.0)
    field = F.create_map(*[F.lit(x) for pair in field_of.items() for x in pair])[F.col("retrieval_type")]
    return both.select("q_idx", field.alias("field"), n.alias("n_got"), m.alias("n_gold"), F.round(f1, 6).alias("f1"))
