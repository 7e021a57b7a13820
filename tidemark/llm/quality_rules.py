"""Quality rules: a decision list learned by sequential covering from labelled word statistics. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut

#: Statistics that a rule may test, all of them per word, per line or plain counts.
FEATURES = ("n_words", "mean_word", "symbol_share", "repeat_share", "dup_line_share", "upper_share", "mark_share", "digit_share", "odd_share", "line_words")
BINS = 24


def word_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the FEATURES over whole texts.

    Words are runs outside 0x20 and 0x09-0x0D; null text has none. Lines are split at \\n; a line without a word is not
    counted. A window of five words repeats if the same five stand elsewhere in the text; its words count once each.
    Columns of those names in the input are replaced. All within a row: no shuffle.
    """
    names = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES}
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = docs.select(*[c for c in docs.columns if c not in names])
    less = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
    size = lambda c: F.size(c).cast("long")
    base = kept.withColumns({"_w": F.filter(F.split(text, SPACES), lambda w: w != ""), "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    hashed = base.withColumns({
        "n_words": size("_w"),
        "word_chars": F.length(F.regexp_replace(text, SPACES, "")).cast("long"),
        "n_symbols": less("#*$%&|<>"),
        "_n_lines": size("_lines"),
        "n_dup_lines": size("_lines") - size(F.array_distinct("_lines")),
        "_h": F.transform("_w", lambda w: F.xxhash64(w)),
    })
    at = lambda i: F.get("_h", i)
    five = hashed.withColumn(
        "_g",
        F.when(F.size("_h") > 5, F.transform(F.sequence(F.lit(0), F.size("_h") - 5), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2), at(i + 3), at(i + 4)))).otherwise(F.expr("cast(array() as array<bigint>)")),
    ).drop("_h")
    # windows in order of hash and place: one with an equal neighbour is repeated
    sort = F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    dup = five.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), sort)).drop("_g")
    same = lambda a, b: F.coalesce(F.get("_s", a)["h"] == F.get("_s", b)["h"], F.lit(False))
    places = F.when(
        F.col("_s").isNotNull(),
        F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda j: same(j, j + 1) | ((j > 0) & same(j, F.greatest(j - 1, F.lit(0))))), lambda j: F.get("_s", j)["i"])),
    )
    cover = dup.withColumn("_p", places).drop("_s")
    step = lambda i: F.least(F.lit(5), F.get("_p", i + 1) - F.get("_p", i))
    covered = F.when(F.size("_p") > 0, F.aggregate(F.transform(F.filter(F.sequence(F.lit(0), F.size("_p") - 1), lambda i: i < F.size("_p") - 1), step), F.lit(5), lambda a, x: a + x)).otherwise(F.lit(0))
    share = lambda n, of: F.round(F.coalesce(n / F.nullif(of, F.lit(0)), F.lit(0.0)), 6)
    done = cover.withColumn("n_repeat_words", covered.cast("long")).withColumns({
        "mean_word": share(F.col("word_chars"), F.col("n_words")),
        "symbol_share": share(F.col("n_symbols"), F.col("n_words")),
        "repeat_share": share(F.col("n_repeat_words"), F.col("n_words")),
        "dup_line_share": share(F.col("n_dup_lines"), F.col("_n_lines")),
        "upper_share": share(less("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.col("word_chars")),
        "mark_share": share(less("!?;:."), F.col("n_words")),
        "digit_share": share(less("0123456789"), F.col("word_chars")),
        "odd_share": share(less("@{}[]()\\/_=+~^`"), F.col("word_chars")),
        "line_words": share(F.col("n_words"), F.col("_n_lines")),
    })
    # the one-row explode is a fence: a filter on a statistic would else be pushed down as a copy of all that makes it
    fenced = done.withColumn("_all", F.struct(*sorted(names))).select(*kept.columns, F.explode(F.array("_all")).alias("_all"))
    return fenced.select(*kept.columns, "_all.*")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _all(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: the first rule that holds rejects, otherwise keep."""
    out = F.when(F.lit(False), False)
    for rule in rules:
        out = out.when(_all(rule), False)
    return out.otherwise(True)


def learn(labelled: DataFrame, rules_most: int = 8, conditions_most: int = 3, precision: float = 0.95, coverage: float = 0.01) -> list[Rule]:
    """Rules for label 0 from rows of (FEATURES, label 0 or 1, fold long): sequential covering with grow and prune parts.

    A rule grows by the condition of best information gain on rows not yet covered, is cut back to the prefix that is
    worth most on the pruning part, and joins the list if there its precision is at least `precision` and it covers
    at least `coverage` of the bad rows left; otherwise the list ends. What the driver sees are counts per feature, bin and label: at
    most len(FEATURES) * (BINS + 1) rows a step, whatever the input. No labels or one class: no rules.
    """
    probs = [i / BINS for i in range(1, BINS)]
    cuts = labelled.agg(*[F.percentile_approx(f, probs, 2000).alias(f) for f in FEATURES]).first()
    if cuts is None or cuts[FEATURES[0]] is None:
        return []
    edges = {f: sorted(set(map(float, cuts[f]))) for f in FEATURES}
    left, rules = labelled, []
    for _ in range(rules_most):
        grow, prune = left.where("fold % 3 <> 0"), left.where("fold % 3 = 0")
        rule: Rule = ()
        for _ in range(conditions_most):
            binned = F.array(*[F.struct(F.lit(f).alias("f"), _bin(f, edges[f]).alias("b")) for f in FEATURES])
            rows = (
                grow.where(_all(rule)).select("label", F.explode(binned).alias("x")).groupBy("x.f", "x.b")
                .agg(F.sum(1 - F.col("label")).alias("bad"), F.sum("label").alias("good")).collect()
            )
            counts = {f: [[0, 0] for _ in range(len(edges[f]) + 1)] for f in FEATURES}
            for r in rows:
                counts[r["f"]][r["b"]] = [r["bad"], r["good"]]
            bad, good = (sum(x[i] for x in counts[FEATURES[0]]) for i in (0, 1))
            if not bad or not good:
                break
            best, gain = None, 0.0
            for f in FEATURES:
                p = n = 0
                for i, e in enumerate(edges[f]):
                    p, n = p + counts[f][i][0], n + counts[f][i][1]
                    for above, pos, neg in ((False, p, n), (True, bad - p, good - n)):
                        value = pos * (_log(pos, neg) - _log(bad, good)) if pos else 0.0
                        if value > gain + 1e-9:
                            best, gain = Condition(f, above, e), value
            if best is None:
                break
            rule = (*rule, best)
        if not rule:
            break
        sums = prune.agg(*[F.sum(F.when(_all(rule[:i]), F.col("label") * 0 + (1 - F.col("label")) if k == "p" else F.col("label")).otherwise(0)).alias(f"{k}{i}") for i in range(1, len(rule) + 1) for k in "pn"], F.sum(1 - F.col("label")).alias("bad")).first()
        worth = [(((sums[f"p{i}"] or 0) - (sums[f"n{i}"] or 0)) / max(1, (sums[f"p{i}"] or 0) + (sums[f"n{i}"] or 0)), sums[f"p{i}"] or 0, -i) for i in range(1, len(rule) + 1)]
        rule = rule[: -max(worth)[2]]
        p, n = sums[f"p{len(rule)}"] or 0, sums[f"n{len(rule)}"] or 0
        if not p or p / (p + n) < precision or p < coverage * (sums["bad"] or 0):
            break
        rules.append(rule)
        left = left.where(~_all(rule))
    return rules


def _bin(feature: str, edges: list[float]) -> Column:
    """How many edges lie below the feature's value."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(feature)))


def _log(pos: float, neg: float) -> float:
    from math import log2

    return log2(pos / (pos + neg))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000) -> list[Rule]:
    """Rules learned on at most `sample` labelled documents (least hash of their id, so the same at every run).

    labels: id and quality (1 good, 0 bad, null unknown); several labels of one id count as the worst. Documents that the
    base test already fails are left out, as no rule decides about them.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").cast("int").alias("label"))
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(some), "_id")  # at most `sample` ids
    rows = cut(word_stats(texts, "_text").where(~base_failed()).select(*FEATURES, "label", F.expr("pmod(xxhash64(_id, 'fold'), 3)").alias("fold")))
    return learn(rows)


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """word_stats of docs with base_failed and kept (false if the base test fails, else the list's verdict)."""
    return word_stats(docs, text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
