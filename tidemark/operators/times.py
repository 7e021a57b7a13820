"""Time: relative expressions grounded at an anchor date, role filters, time-aware reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .retrieval import if_small

#: Numbers written as words.
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
#: Expressions that are grounded.
EXPRESSION = r"(?i)\b(yesterday|today|tomorrow|last (?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)|(?:last|next) (?:week|month|year)|(?:\w+) weekends? ago|(?:\w+) years? now)\b"


def _day(d: Column) -> Column:
    return F.date_format(d, "d MMMM yyyy")


def _number(word: Column) -> Column:
    out = word.try_cast("int")
    for i, w in enumerate(NUMBERS, 1):
        out = F.when(word == w, i).otherwise(out)
    return out


def ground(rows: DataFrame, text_col: str, anchor_col: str) -> DataFrame:
    """rows exploded to their time expressions: expression, normalised, start and end dates; unmatched text gives no row."""
    found = rows.withColumn("expression", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(EXPRESSION), 1), F.lower))))
    e, a = F.col("expression"), F.to_date(anchor_col)
    first = F.split(e, " ")[0]
    n = _number(first)
    weekday = F.regexp_extract(e, r"^last (\w+)$", 1)
    is_day = weekday.isin("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    before = F.expr(f"next_day(date_sub(to_date({anchor_col}), 8), initcap(substring(split(expression, ' ')[1], 1, 3)))")
    before = F.when(is_day, before)
    month = lambda k: F.trunc(F.add_months(a, k), "month")
    back = F.expr(f"next_day(date_sub(to_date({anchor_col}), 8), 'Sat')")
    weekend = lambda k: F.date_sub(back, (k - 1) * 7)
    start = (
        F.when(e == "yesterday", F.date_sub(a, 1)).when(e == "today", a).when(e == "tomorrow", F.date_add(a, 1)).when(is_day, before)
        .when(e == "last week", F.date_sub(a, 7)).when(e == "next week", F.date_add(a, 7)).when(e == "last month", month(-1)).when(e == "next month", month(1))
        .when(e == "last year", F.make_date(F.year(a) - 1, F.lit(1), F.lit(1))).when(e == "next year", F.make_date(F.year(a) + 1, F.lit(1), F.lit(1)))
        .when(e.rlike("weekends? ago$"), weekend(n)).when(e.rlike("years? now$"), F.make_date(F.year(a) - n, F.lit(1), F.lit(1)))
    )
    end = (
        F.when(e.isin("last month", "next month"), F.last_day(F.col("start"))).when(e.isin("last year", "next year"), F.make_date(F.year("start"), F.lit(12), F.lit(31)))
        .when(e.rlike("weekends? ago$"), F.date_add("start", 1)).when(e.rlike("years? now$"), a).otherwise(F.col("start"))
    )
    said = (
        F.when(e.isin("yesterday", "today", "tomorrow"), _day(F.col("start"))).when(is_day, F.concat(F.lit("the "), F.initcap(weekday), F.lit(" before "), _day(a)))
        .when(e == "last week", F.concat(F.lit("the week before "), _day(a))).when(e == "next week", F.concat(F.lit("the week after "), _day(a)))
        .when(e.isin("last month", "next month"), F.date_format("start", "MMMM yyyy")).when(e.isin("last year", "next year"), F.year("start").cast("string"))
        .when(e.rlike("weekends? ago$"), F.concat(n.cast("string"), F.lit(" weekends before "), _day(a)))
        .when(e.rlike("years? now$"), F.concat(F.lit("since "), (F.year(a) - n).cast("string"), F.lit(" ("), n.cast("string"), F.lit(" years)")))
    )
    return found.withColumn("start", start).where("start is not null").withColumn("end", end).withColumn("normalised", said)


MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_YEAR = r"((?:19|20)\d{2})"


def clean_text(text: Column) -> Column:
    """Small letters without ordinal endings, a first 'on' or 'the', repeated spaces and stops around."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"(\d)(?:st|nd|rd|th)\b", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"^(?:on|the)\s+", ""), r"\s+", " ")
    return F.regexp_replace(t, r"^[ .]+|[ .]+$", "")


def _read(t: Column, pattern: str, order: tuple[int, int, int] | tuple[int, int]) -> Column:
    """The date of a whole text, its parts (year, month, day) by group; the first of the month without a day."""
    g = lambda i: F.regexp_extract(t, f"^{pattern}$", i)
    name = g(order[1])
    number = F.when(name.rlike("^[a-z]"), F.date_format(F.try_to_timestamp(F.concat(F.lit("2000 "), F.substring(name, 1, 3)), F.lit("yyyy MMM")), "M")).otherwise(name)
    parts = F.concat_ws("-", g(order[0]), number, g(order[2]) if len(order) == 3 else F.lit("1"))
    return F.to_date(F.try_to_timestamp(parts, F.lit("yyyy-M-d")))


def _days(t: Column) -> Column:
    sign = r"[-/.]"
    first, last = rf"{_YEAR}{sign}(\d{{1,2}}){sign}(\d{{1,2}})", rf"(\d{{1,2}}){sign}(\d{{1,2}}){sign}{_YEAR}"
    tries = (_read(t, rf"(\d{{1,2}}) {MONTH} {_YEAR}", (3, 2, 1)), _read(t, rf"{MONTH} (\d{{1,2}}),? {_YEAR}", (3, 1, 2)), _read(t, first, (1, 2, 3)), _read(t, first, (1, 3, 2)), _read(t, last, (3, 1, 2)), _read(t, last, (3, 2, 1)))
    return F.array_distinct(F.filter(F.array(*tries), lambda x: x.isNotNull()))


def _let(value: Column, then) -> Column:
    """then(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def date_constraint(text: Column) -> Column:
    """(precision, dates) that a whole text names: day, month or year, also by weekday, day, week or a few days before or
    after a day; null without. Number dates are read both ways round; a year and a month without a day are a month."""
    week = F.array(*[F.lit(x) for x in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")])
    found = lambda name, dates: F.struct(F.lit(name).alias("precision"), dates.alias("dates"))

    def near(t):
        part = lambda i: F.regexp_extract(t, r"^(monday|tuesday|wednesday|thursday|friday|saturday|sunday|day|week|(?:a )?few days) (before|after) (.+)$", i)

        def moved(unit, back, d):
            target = F.array_position(week, unit).cast("int")  # 0 for other units
            off = F.when(back, F.weekday(d) + 1 - target).otherwise(target - 1 - F.weekday(d))
            step = F.when(target > 0, F.pmod(off + 6, F.lit(7)) + 1).when(unit == "week", 7).otherwise(1)
            one = lambda k: F.date_add(d, F.when(back, -k).otherwise(k).cast("int"))
            return F.when(unit.endswith("days"), F.array(*[one(F.lit(k)) for k in (2, 3, 4)])).otherwise(F.array(one(step)))

        return _let(clean_text(part(3)), lambda x: F.flatten(F.transform(_days(x), lambda d: moved(part(1), part(2) == "before", d))))

    def named(t):
        month = F.coalesce(_read(t, rf"{MONTH} {_YEAR}", (2, 1)), _read(t, rf"{_YEAR}[-/.](\d{{1,2}})", (1, 2)))
        year = F.to_date(F.try_to_timestamp(F.concat(F.regexp_extract(t, f"^{_YEAR}$", 1), F.lit("-1-1")), F.lit("yyyy-M-d")))
        days = lambda x: F.when(F.size(x) > 0, found("day", x))
        coarse = lambda name, x: _let(x, lambda d: F.when(d.isNotNull(), found(name, F.array(d))))
        return F.coalesce(_let(_days(t), days), coarse("month", month), coarse("year", year), _let(near(t), days))

    # every date holds its year as it stands: texts without one are not read further
    return F.when(text.rlike(_YEAR), _let(F.regexp_replace(clean_text(text), r"^(?:around|approximately|about) ", ""), named))


def same_date(gold: Column, said: Column) -> Column:
    """Whether two texts name one date, where the gold text may be the coarser one."""
    return _let(date_constraint(gold), lambda g: _let(date_constraint(said), lambda s: _same(g, s)))


def _same(g: Column, s: Column) -> Column:
    whole = lambda unit: F.transform(s["dates"], lambda x: F.to_date(F.date_trunc(unit, x)))
    near = F.when(g["precision"] == s["precision"], s["dates"]).when(g["precision"] == "year", whole("year")).when((g["precision"] == "month") & (s["precision"] == "day"), whole("month"))
    return F.coalesce(F.arrays_overlap(g["dates"], near), F.lit(False))


def same_dates(rows: DataFrame, gold: str, said: str, name: str = "same", texts: DataFrame | None = None) -> DataFrame:
    """rows with same_date of two of their columns. A text is read once however many rows hold it: rows meet their texts'
    dates by joins. `texts` is one column that holds all texts of both, where it is cheaper to have than from the rows."""
    every = texts if texts is not None else rows.select(gold).union(rows.select(said))
    read = cut(every.toDF("_text").distinct().withColumn("_read", date_constraint(F.col("_text"))))
    for c in (gold, said):
        rows = rows.join(if_small(read.toDF(f"_{c}_text", f"_{c}_read")), F.col(c).eqNullSafe(F.col(f"_{c}_text")), "left").drop(f"_{c}_text")
    return rows.withColumn(name, _same(F.col(f"_{gold}_read"), F.col(f"_{said}_read"))).drop(f"_{gold}_read", f"_{said}_read")


def rerank(hits: DataFrame, roles: Column, asked: Column, boost: float = 0.25, at: Column | None = None, recency: float = 0.2) -> DataFrame:
    """hits with `boost` added where a document's roles meet those asked for; with `at`, up to `recency` more for the
    newest of a question's documents (those without a time first)."""
    score = F.col("score") + F.when(F.arrays_overlap(roles, asked), boost).otherwise(0.0)
    if at is not None:
        score = score + recency * F.percent_rank().over(Window.partitionBy("query_id").orderBy(at.asc_nulls_first(), "doc_id"))
    return hits.withColumn("score", F.round(score, 6))


def order_hits(hits: DataFrame, at: Column, ordering: str) -> DataFrame:
    """hits (query_id, rank) with `place` from 1: by time, newest first for "latest", oldest first for "chronological", those
    without a time last, the given rank among equals; any other ordering keeps the rank."""
    by = {"latest": [at.desc_nulls_last()], "chronological": [at.asc_nulls_last()]}.get(ordering, [])
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*by, "rank")))


def scale_times(rows: DataFrame, times_col: str, stats: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with `scaled`, statistics lo and hi, one row): the mean of a row's times, from 0 at the earliest mean to 1 at the
    latest; 0 where these are one or without a time. Statistics of other rows may be given and hold for these then."""
    known = F.filter(times_col, lambda x: x.isNotNull())
    seconds = F.transform(known, lambda x: F.unix_micros(x.cast("timestamp")) / 1e6)
    mean = F.when(F.size(known) > 0, F.aggregate(seconds, F.lit(0.0), lambda s, x: s + x) / F.size(known))
    if stats is None:
        stats = rows.agg(F.min(mean).alias("lo"), F.max(mean).alias("hi"))
    lo, hi = stats.select("lo", "hi").first() or (None, None)
    share = (mean - F.lit(lo)) / F.lit((hi - lo) or 1.0) if lo is not None else F.lit(0.0)
    return rows.withColumn("scaled", F.coalesce(share, F.lit(0.0))), stats


def event_profiles(events: DataFrame, claims: DataFrame, times: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """(event_id, time_roles, time_values, time_ids, current_state_ids), sorted sets, of every event (event_id, occurred_at):
    from its claims (event_id, claim_id, time_role, time_value), their times (claim_id, time_id, time_role, value) and, if
    given, their states (claim_id, state_id, current, primary_claim_id, current_after). CURRENT_AFTER needs a current state
    with such a time whose primary claim this is. The plain report time is a value but no role."""
    none = F.lit(None).cast("string")
    fact = lambda role, value, time, state: (role.alias("role"), value.cast("string").alias("value"), time.cast("string").alias("time_id"), state.cast("string").alias("state_id"))
    facts = events.select("event_id", *fact(none, F.col("occurred_at"), none, none)).unionByName(claims.select("event_id", *fact(F.col("time_role"), F.col("time_value"), none, none)))
    own = claims.select("event_id", "claim_id")
    facts = facts.unionByName(own.join(times, "claim_id").select("event_id", *fact(F.col("time_role"), F.col("value"), F.col("time_id"), none)))
    if states is not None:
        now = states.where("current and claim_id = primary_claim_id and current_after is not null")
        facts = facts.unionByName(own.join(now, "claim_id").select("event_id", *fact(F.lit("CURRENT_AFTER"), none, none, F.col("state_id"))))
    kept = lambda c: F.sort_array(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    return facts.groupBy("event_id").agg(kept("role").alias("time_roles"), kept("value").alias("time_values"), kept("time_id").alias("time_ids"), kept("state_id").alias("current_state_ids"))
