"""Column expressions for text: tokens, labels, keys, ids, dates. No Python in the hot path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Time sentinels that mean no value.
NO_TIME = ("empty", "n/a", "na", "none", "not mentioned", "not specified", "null", "unknown")
#: Layouts that a record's time may have.
TIME_LAYOUTS = ("h:mm a 'on' d MMMM, yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd", "MMMM d, yyyy")


#: Abbreviations that end no sentence.
ABBREVIATIONS = ("dr", "e.g", "i.e", "jr", "mr", "mrs", "ms", "prof", "sr", "st", "vs")


def plain_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; null gives none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), F.array().cast("array<string>"))


def stemmed_tokens(text: Column) -> Column:
    """Tokens with apostrophes and underscores, stripped of the first fitting suffix: ies to y, ing, ed, s."""

    def stem(t: Column) -> Column:
        n = F.length(t)
        return (
            F.when(t.endswith("ies") & (n > 4), F.concat(t.substr(F.lit(1), n - 3), F.lit("y")))
            .when(t.endswith("ing") & (n > 5), t.substr(F.lit(1), n - 3))
            .when(t.endswith("ed") & (n > 4), t.substr(F.lit(1), n - 2))
            .when(t.endswith("s") & (n > 4), t.substr(F.lit(1), n - 1))
            .otherwise(t)
        )

    return F.transform(F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_']+)"), 1), F.array().cast("array<string>")), stem)


def label(text: Column, most: int = 180) -> Column:
    """Spaces collapsed, edge punctuation taken off, cut to `most` characters."""
    one = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    return F.substring(F.regexp_replace(one, r"^[ .,;:!?'\"-]+|[ .,;:!?'\"-]+$", ""), 1, most)


def time_label(text: Column) -> Column:
    """A label, with sentinels for no value made empty."""
    return F.when(F.lower(label(text)).isin(*NO_TIME), "").otherwise(label(text))


def bucket_key(text: Column, fallback: str = "unknown", most: int = 100) -> Column:
    """Lower case, other characters as one underscore, trimmed and cut; the fallback where nothing is left."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(key, 1, most), F.lit("")), F.lit(fallback))


def short_hash(text: Column, n: int = 10) -> Column:
    return F.substring(F.sha1(text), 1, n)


def answer_tokens(text: Column) -> Column:
    """Words of an answer without commas, punctuation, case and the articles a, an, the, and."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    return F.filter(F.split(bare, r"[\x20\x09-\x0D]+"), lambda w: (w != "") & ~w.isin("a", "an", "the", "and"))


def sentences(text: Column) -> Column:
    """Sentences by end marks and line breaks, trimmed, none empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n"), lambda s: F.trim(s)), lambda s: s != "")


def ruled_sentences(text: Column) -> Column:
    """Sentences by end marks before a space, white space as one space. An ellipsis, an abbreviation, an initial, a small
    letter that follows or an open quotation ends none; pieces between marks are merged in one pass.
    """
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    pieces = F.regexp_extract_all(bare, F.lit(r"""(?s).*?[.!?]+["”’']*(?:\s+|$)|.+$"""), F.lit(0))
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))

    # what the fold asks of a piece, worked out once: an expression that a lambda names twice is computed twice
    def ending(x):
        mark = F.regexp_extract(x, r"""([.!?]+)["”’']*\s*$""", 1)
        word = F.lower(F.regexp_extract(x, r"""([A-Za-z]+(?:\.[A-Za-z]+)*)[.!?]+["”’']*\s*$""", 1))
        return F.struct(x.alias("x"), mark.alias("mark"), word.alias("word"))

    def told(e):
        x, on = e["x"], e["mark"].startswith("...") | (e["mark"].startswith(".") & (e["word"].isin(*ABBREVIATIONS) | (F.length(e["word"]) == 1)))
        return F.struct(x.alias("x"), on.alias("on"), x.rlike(r"^\p{Ll}").alias("small"), count(x, '"').alias("plain"), (count(x, "“") - count(x, "”")).alias("curly"))

    start = F.expr("named_struct('out', cast(array() as array<string>), 'open', '', 'on', false, 'plain', 0, 'curly', 0)")

    def step(a, x):
        ends = (a["open"] != "") & ~a["on"] & ~x["small"] & (a["plain"] % 2 == 0) & (a["curly"] <= 0)
        keep = lambda new, old: F.when(ends, new).otherwise(old)
        return F.struct(
            keep(F.concat(a["out"], F.array(F.trim(a["open"]))), a["out"]).alias("out"), keep(x["x"], F.concat(a["open"], x["x"])).alias("open"), x["on"].alias("on"),
            (keep(F.lit(0), a["plain"]) + x["plain"]).alias("plain"), (keep(F.lit(0), a["curly"]) + x["curly"]).alias("curly"),
        )

    return F.aggregate(F.transform(F.transform(pieces, ending), told), start, step, lambda a: F.when(F.trim(a["open"]) != "", F.concat(a["out"], F.array(F.trim(a["open"])))).otherwise(a["out"]))


def any_time(text: Column) -> Column:
    """A timestamp by the first layout that fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_LAYOUTS])


def id_ranges(text: Column) -> Column:
    """'3, 7-9' as [3, 7, 8, 9]: bad parts are skipped, reversed ranges accepted."""

    def span(part: Column) -> Column:
        ends = F.split(F.trim(part), r"\s*-\s*")
        lo, hi = F.get(ends, F.lit(0)).try_cast("int"), F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0))).try_cast("int")
        return F.when(lo.isNotNull() & hi.isNotNull() & (F.size(ends) <= 2), F.sequence(F.least(lo, hi), F.greatest(lo, hi))).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), ","), span))


def letter_answer(text: Column) -> Column:
    """The letter A to D of a choice answer by four patterns in order, else the text trimmed."""
    t = F.trim(F.coalesce(text, F.lit("")))
    tries = (r"^\(?([A-Da-d])\)?[.:)]?$", r"(?i)answer\s*(?:is|:)\s*\(?([A-D])\b", r"^\(?([A-Da-d])[.):]\s", r"\b([A-D])\b")
    return F.coalesce(*[F.upper(F.nullif(F.regexp_extract(t, p, 1), F.lit(""))) for p in tries], t)


def dialog_key(text: Column) -> Column:
    """D<session>:<number> as an orderable pair; others last."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, r"^D(\d+):(\d+)$", i), F.lit("")).cast("int"), F.lit(1_000_000_000))
    return F.struct(part(1).alias("session"), part(2).alias("number"))


def span_starts(text: Column, span: Column) -> Column:
    """Where a span stands in a text, from 0, none overlapping; case counts, and an empty span stands nowhere."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(span, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    sizes = F.transform(F.split(text, quoted), F.length)
    start = F.expr("named_struct('at', 0, 'out', cast(array() as array<int>))")
    step = lambda a, n: F.struct((a["at"] + n + F.length(span)).alias("at"), F.concat(a["out"], F.array(a["at"] + n)).alias("out"))
    found = F.aggregate(F.slice(sizes, 1, F.greatest(F.size(sizes) - 1, F.lit(0))), start, step, lambda a: a["out"])
    return F.when(F.length(span) > 0, found).otherwise(F.array().cast("array<int>"))


def time_span_starts(text: Column, span: Column) -> Column:
    """span_starts that are whole time expressions: no letter or digit beside them, and no digit of theirs joined on by - / :"""

    def whole(at: Column) -> Column:
        before = F.when(at > 0, F.substr(text, at, F.lit(1))).otherwise("")
        after = F.substr(text, at + F.length(span) + 1, F.lit(1))
        loose = ~before.rlike(r"[\p{L}\p{N}]") & ~after.rlike(r"[\p{L}\p{N}]")
        return loose & ~(span.rlike(r"^\p{Nd}") & before.isin("-", "/", ":")) & ~(span.rlike(r"\p{Nd}$") & after.isin("-", "/", ":"))

    return F.filter(span_starts(text, span), whole)


def json_event(response: Column) -> Column:
    """(time, spaces, entities, content) of the first JSON object in a text, also in a code fence; null without one. A date or
    an entity may stand alone or in a list, an entity may be an object with a name, of several places the first is taken."""
    fields = F.from_json(F.nullif(F.regexp_extract(response, r"(?s)\{.*\}", 0), F.lit("")), "map<string,string>")

    def event(f: Column) -> Column:
        many = lambda k: F.coalesce(F.when(F.ltrim(f[k]).startswith("["), F.from_json(f[k], "array<string>")), F.when(f[k].isNotNull(), F.array(f[k])), F.array().cast("array<string>"))
        name = lambda x: F.when(F.ltrim(x).startswith("{"), F.coalesce(F.nullif(F.get_json_object(x, "$.name"), F.lit("")), F.get_json_object(x, "$.entity"), F.lit(""))).otherwise(x)
        solid = lambda a: F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != "")
        return F.struct(
            solid(many("date")).alias("time"), F.trim(F.coalesce(F.get(many("location"), F.lit(0)), F.lit(""))).alias("spaces"),
            solid(F.transform(many("entity"), name)).alias("entities"), F.trim(F.coalesce(f["content"], F.lit(""))).alias("content"),
        )

    return F.get(F.transform(F.filter(F.array(fields), lambda f: f.isNotNull()), event), F.lit(0))


def primary_other(entities: Column) -> Column:
    """The first entity, and the others in order; null without one."""
    return F.struct(F.get(entities, F.lit(0)).alias("entity"), F.slice(entities, 2, F.greatest(F.size(entities) - 1, F.lit(0))).alias("others"))


def paragraphs(text: Column, least: int = 40) -> Column:
    """(pos, text) of the parts between blank lines, white space as one space; pos counts from 1 before parts of fewer than
    `least` characters go."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.filter(F.transform(parts, lambda x, i: F.struct((i + 1).alias("pos"), x.alias("text"))), lambda x: F.length(x["text"]) >= least)


def passages(text: Column) -> Column:
    """Parts between blank lines of 40 characters or more; a text of one part is cut at sentence ends before a capital, and
    pieces of 80 characters or more are kept."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t]+", " "))
    strip = lambda a: F.transform(a, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    parts = F.filter(strip(F.split(bare, r"\n\s*\n")), lambda x: x != "")
    pieces = F.filter(strip(F.split(bare, r"(?<=[.!?])\s+(?=[A-Z])")), lambda x: F.length(x) >= 80)
    return F.filter(F.when(F.size(parts) > 1, parts).otherwise(pieces), lambda x: F.length(x) >= 40)
