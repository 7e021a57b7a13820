"""Text, claim and time queries over documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import times
from .common import table


def t2_plain_tokens(spark, d) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", T.plain_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.get("t", F.lit(0)).alias("first_token"))


def t4_labels(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.label(F.col("text"), 60).alias("label"))


def t5_bucket_keys(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.bucket_key(F.col("text")).alias("key"))


def t8_ordered_distinct(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_distinct(T.plain_tokens(F.col("text"))), " ").alias("terms"))


def t10_stable_ids(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.concat_ws("::", F.lit("document"), "source", T.short_hash(F.col("text"))).alias("stable_id"), F.sha2("text", 256).alias("sha"))


def t11_event_documents(spark, d) -> DataFrame:
    """Each conversation's text: its turns in order, at most 240."""
    t = table(spark, d, "conversations").withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("r <= 240")
    return t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat_ws(": ", x["role"], x["text"])), "\n").alias("document"))


def t12_answer_words(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.answer_tokens(F.col("text")), " ").alias("answer"))


def t13_sentences(spark, d) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "s"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.max(F.length("s")).alias("longest"))


def t14_span_occurrences(spark, d) -> DataFrame:
    """How often 'the ' stands in each text, without overlaps, and its first place (from 0; -1 if none)."""
    n = (F.length("text") - F.length(F.replace("text", F.lit("the "), F.lit("")))) / 4
    return table(spark, d, "documents").select("doc_id", n.cast("long").alias("n"), (F.instr("text", "the ") - 1).cast("long").alias("first_at"))


def t15_context_lines(spark, d) -> DataFrame:
    cut = F.when(F.length("text") > 80, F.concat(F.substring("text", 1, 80), F.lit("..."))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("["), F.col("role"), F.lit("] "), cut).alias("line"))


def t16_letters(spark, d) -> DataFrame:
    """Answers worded by a document's labels."""
    good, bad = F.col("quality") == 1, F.col("toxic") == 1
    said = F.when(good & bad, "(C)").when(good, "The ANSWER is: b, I think").when(bad, "d) because of A").otherwise(F.concat(F.lit("Perhaps A or "), F.col("doc_id").cast("string")))
    return table(spark, d, "labels").select("doc_id", T.letter_answer(said).alias("letter"))


def t17_id_ranges(spark, d) -> DataFrame:
    """Ranges of a line's number, quantity and discount; the return flag is no number."""
    whole = lambda c: F.col(c).cast("int").cast("string")
    x = F.concat(whole("l_linenumber"), F.lit(", "), whole("l_quantity"), F.lit(" -"), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit(", "), F.col("l_returnflag"), F.lit("-1, "), whole("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.transform(T.id_ranges(x), lambda i: i.cast("string")), ",").alias("ids"))


def t18_json_fields(spark, d) -> DataFrame:
    """Events told as JSON in a fence: the date alone, places as a list, the entity as an object with a name or in a list."""
    entity = F.when(F.col("value") < 50, F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("name"))).alias("entity")))).otherwise(F.to_json(F.struct(F.array("event_type", F.lit(" ")).alias("entity"))))
    rest = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.array(F.concat(F.lit(" u"), F.col("user_id")), F.lit("x")).alias("location"), F.col("props").alias("content")))
    body = F.concat(F.substr(rest, F.lit(1), F.length(rest) - 1), F.lit(","), F.substr(entity, F.lit(2)))
    e = T.json_event(F.when(F.col("event_type") == "error", "no event").otherwise(F.concat(F.lit("Result: ```json\n"), body, F.lit("\n``` done"))))
    return table(spark, d, "events").select("event_id", F.array_join(e["time"], "|").alias("time"), e["spaces"].alias("spaces"), F.array_join(e["entities"], "|").alias("entities"), e["content"].alias("content"))


def t19_primary_other(spark, d) -> DataFrame:
    p = T.primary_other(T.plain_tokens(F.col("text")))
    return table(spark, d, "benchmark").select("item_id", p["entity"].alias("entity"), F.size(p["others"]).alias("n_others"), F.array_join(p["others"], " ").alias("others"))


def t22_chat_roles(spark, d) -> DataFrame:
    t = table(spark, d, "conversations")
    first = t.groupBy("conv_id").agg(F.min_by("role", "turn").alias("speaker_a"))
    return t.join(first, "conv_id").select("conv_id", "turn", F.when(F.col("role") == F.col("speaker_a"), "user").otherwise("assistant").alias("chat_role"))


def c4_claim_dedup(spark, d) -> DataFrame:
    key = Window.partitionBy("user_id", "event_type", F.col("value").cast("int")).orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("r", F.row_number().over(key)).where("r = 1").select("event_id", "user_id", "event_type")


def c9_aliases(spark, d) -> DataFrame:
    """First tokens that belong to one longer name only, with that name."""
    names = table(spark, d, "benchmark").select(F.array_join(F.slice(T.plain_tokens(F.col("text")), 1, 3), " ").alias("id")).where("id <> ''").distinct()
    pairs = names.select(F.split("id", " ")[0].alias("alias"), "id")
    return pairs.groupBy("alias").agg(F.count_distinct("id").alias("n"), F.max_by("id", F.struct(F.length("id"), "id")).alias("name")).where("n = 1").select("alias", "name")


def c10_fixed_chunks(spark, d) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    t = table(spark, d, "conversations").withColumn("chunk", F.floor((r - 1) / 3).cast("long"))
    return t.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))


def c10_greedy_chunks(spark, d) -> DataFrame:
    """Turns gathered while a chunk stays within 1500 characters; one conversation's turns fold in order."""
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("t"))
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("chunk"), F.expr("cast(array() as array<struct<turn: bigint, chunk: int>>)").alias("out"))

    def step(a, x):
        over = (a["size"] > 0) & (a["size"] + x["n"] > 1500)
        chunk = a["chunk"] + over.cast("int")
        return F.struct((F.when(over, 0).otherwise(a["size"]) + x["n"]).alias("size"), chunk.alias("chunk"), F.concat(a["out"], F.array(F.struct(x["turn"].alias("turn"), chunk.alias("chunk")))).alias("out"))

    return t.select("conv_id", F.inline(F.aggregate("t", start, step, lambda a: a["out"])))


def c11_paragraphs(spark, d) -> DataFrame:
    """Lines of 40 characters or more, each text once, where it stands first."""
    p = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "p")).withColumn("p", F.trim(F.regexp_replace("p", r"\s+", " "))).where("length(p) >= 40")
    first = p.groupBy("p").agg(F.min(F.struct("doc_id", "pos")).alias("f"))
    return first.groupBy("f.doc_id").agg(F.count(F.lit(1)).alias("n_paragraphs"), F.sum(F.length("p")).alias("n_chars"))


def c12_turn_pairs(spark, d) -> DataFrame:
    t = table(spark, d, "conversations").withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    return t.groupBy("conv_id", F.floor(F.col("r") / 2).alias("pair")).agg(F.min_by("text", "r").alias("query"), F.coalesce(F.max(F.when(F.col("r") % 2 == 1, F.col("text"))), F.lit("")).alias("response"))


def c13_rows_per_type(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))).where("r > 2 and r <= 12").select("event_type", "event_id", "r")


def s3_message_ids(spark, d) -> DataFrame:
    t = table(spark, d, "conversations")
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    return t.where(text != "").select(F.concat_ws(":", F.lit("topic"), F.col("conv_id").cast("string"), "role", F.col("turn").cast("string")).alias("event_id"), text.alias("text"))


def s4_timestamp_layouts(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    layout = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "h:mm a 'on' d MMMM, yyyy")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return e.select("event_id", F.date_format(T.any_time(layout), "yyyy-MM-dd HH:mm").alias("at"))


def s11_session_export(spark, d) -> DataFrame:
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return t.select("conv_id", F.sha2(F.concat(F.lit("Session "), F.col("conv_id").cast("string"), F.lit("\n"), F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")), 256).alias("document_sha"))


def s13_group_chat_records(spark, d) -> DataFrame:
    at = F.lit("1970-01-01 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("turn").cast("decimal(18,6)"))
    return table(spark, d, "conversations").select(F.concat_ws(":", F.lit("sample"), F.col("conv_id").cast("string")).alias("group"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"), F.concat(F.lit("D"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("dialog_id"))


def d1_anchor_dates(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.date_format("ts", "h:mm a 'on' d MMMM, yyyy").alias("said"))
    return e.select("event_id", F.date_format(T.any_time(F.col("said")), "yyyy-MM-dd HH:mm").alias("anchor"))


def d2_relative_times(spark, d) -> DataFrame:
    said = F.concat(F.lit("We met "), F.element_at(F.array(*[F.lit(x) for x in ("yesterday", "last friday", "next month", "seven years now", "two weekends ago", "next week", "somewhere")]), (F.col("event_id") % 7 + 1).cast("int")), F.lit("."))
    rows = times.ground(table(spark, d, "events").select("event_id", "ts", said.alias("said")), "said", "ts")
    return rows.select("event_id", "expression", F.date_format("start", "yyyy-MM-dd").alias("start_day"), F.date_format("end", "yyyy-MM-dd").alias("end_day"))


def d4_time_profile(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("roles"), F.count_distinct(F.to_date("ts")).alias("n_days"))


def d9_date_equivalence(spark, d) -> DataFrame:
    """Whether a gold date of an order, told as a day, month or year by its priority, and a line's ship date are one."""
    told = lambda layout: F.date_format("o_orderdate", layout)
    urgent = F.col("o_orderpriority")
    gold = F.when(urgent < "2", told("d MMMM yyyy")).when(urgent < "3", told("MMMM yyyy")).when(urgent < "4", told("yyyy")).otherwise(told("yyyy-MM-dd"))
    orders = table(spark, d, "orders").select("o_orderkey", gold.alias("gold"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("said"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return times.same_dates(rows, "gold", "said", texts=orders.select("gold").union(lines.select("said"))).select("l_orderkey", "l_linenumber", "same")


def d10_dialog_order(spark, d) -> DataFrame:
    said = F.when(F.col("turn") % 5 == 4, F.lit("note")).otherwise(F.concat(F.lit("D"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")))
    k = T.dialog_key(said)
    return table(spark, d, "conversations").select("conv_id", "turn", k["session"].alias("session"), k["number"].alias("number"))


_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
QUERIES = {
    "t2_plain_tokens": (t2_plain_tokens, f"WITH t AS (SELECT doc_id, {_TOK.format('text')} AS t FROM documents) SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct, t[1] AS first_token FROM t"),
    "t4_labels": (t4_labels, r"""SELECT doc_id, substring(regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^[ .,;:!?''"-]+|[ .,;:!?''"-]+$', '', 'g'), 1, 60) AS label FROM documents"""),
    "t5_bucket_keys": (t5_bucket_keys, "SELECT doc_id, coalesce(nullif(substring(regexp_replace(regexp_replace(lower(coalesce(substring(text, 1, 300), '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 100), ''), 'unknown') AS key FROM documents"),
    "t8_ordered_distinct": (t8_ordered_distinct, f"WITH x AS (SELECT conv_id, turn, {_TOK.format('text')} AS t FROM conversations), u AS (SELECT conv_id, turn, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM x), f AS (SELECT conv_id, turn, w, min(i) AS i FROM u GROUP BY ALL), g AS (SELECT conv_id, turn, string_agg(w, ' ' ORDER BY i) AS terms FROM f GROUP BY ALL) SELECT x.conv_id, x.turn, coalesce(g.terms, '') AS terms FROM x LEFT JOIN g USING (conv_id, turn)"),
    "t10_stable_ids": (t10_stable_ids, "SELECT doc_id, concat_ws('::', 'document', source, substring(sha1(text), 1, 10)) AS stable_id, sha256(text) AS sha FROM documents"),
    "t11_event_documents": (t11_event_documents, "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS document FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 240 GROUP BY conv_id"),
    "t12_answer_words": (t12_answer_words, r"SELECT item_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '[\x20\x09-\x0D]+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the', 'and')), ' ') AS answer FROM benchmark"),
    "t13_sentences": (t13_sentences, r"WITH s AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)))) AS s FROM documents) SELECT doc_id, count(*) AS n_sentences, max(length(s))::INT AS longest FROM s WHERE s <> '' GROUP BY doc_id"),
    "t14_span_occurrences": (t14_span_occurrences, "SELECT doc_id, ((length(text) - length(replace(text, 'the ', ''))) // 4)::BIGINT AS n, (strpos(text, 'the ') - 1)::BIGINT AS first_at FROM documents"),
    "t15_context_lines": (t15_context_lines, "SELECT conv_id, turn, '[' || role || '] ' || CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END AS line FROM conversations"),
    "t16_letters": (t16_letters, r"""
WITH x AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN '(C)' WHEN quality = 1 THEN 'The ANSWER is: b, I think' WHEN toxic = 1 THEN 'd) because of A' ELSE 'Perhaps A or ' || doc_id END AS t FROM labels)
SELECT doc_id, coalesce(upper(nullif(regexp_extract(t, '^\(?([A-Da-d])\)?[.:)]?$', 1), '')), upper(nullif(regexp_extract(t, '(?i)answer\s*(?:is|:)\s*\(?([A-D])\b', 1), '')), upper(nullif(regexp_extract(t, '^\(?([A-Da-d])[.):]\s', 1), '')), upper(nullif(regexp_extract(t, '\b([A-D])\b', 1), '')), t) AS letter FROM x"""),
    "t17_id_ranges": (t17_id_ranges, r"""
WITH x AS (SELECT l_orderkey, l_linenumber, string_split(l_linenumber::INT || ', ' || trunc(l_quantity)::INT || ' -' || round(l_discount * 100)::INT || ', ' || l_returnflag || '-1, ' || l_linenumber::INT, ',') AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, array_to_string(flatten(list_transform(list_filter(p, lambda a: regexp_matches(trim(a), '^[0-9]+(\s*-\s*[0-9]+)?$')),
  lambda a: range(least(regexp_extract(a, '([0-9]+)', 1)::INT, regexp_extract(a, '([0-9]+)\s*$', 1)::INT), greatest(regexp_extract(a, '([0-9]+)', 1)::INT, regexp_extract(a, '([0-9]+)\s*$', 1)::INT) + 1))), ',') AS ids FROM x"""),
    "t18_json_fields": (t18_json_fields, "SELECT event_id, CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d') END AS \"time\", CASE WHEN event_type <> 'error' THEN 'u' || user_id END AS spaces, CASE WHEN event_type <> 'error' THEN event_type END AS entities, CASE WHEN event_type <> 'error' THEN trim(props) END AS content FROM events"),
    "t19_primary_other": (t19_primary_other, f"WITH t AS (SELECT item_id, {_TOK.format('text')} AS t FROM benchmark) SELECT item_id, t[1] AS entity, greatest(len(t) - 1, 0)::INT AS n_others, array_to_string(t[2:], ' ') AS others FROM t"),
    "t22_chat_roles": (t22_chat_roles, "WITH f AS (SELECT conv_id, arg_min(role, turn) AS a FROM conversations GROUP BY 1) SELECT c.conv_id, turn, CASE WHEN role = a THEN 'user' ELSE 'assistant' END AS chat_role FROM conversations c JOIN f USING (conv_id)"),
    "c4_claim_dedup": (c4_claim_dedup, "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, trunc(value)::INT ORDER BY ts, event_id) = 1"),
    "c9_aliases": (c9_aliases, f"WITH n AS (SELECT DISTINCT array_to_string({_TOK.format('text')}[1:3], ' ') AS id FROM benchmark), p AS (SELECT split_part(id, ' ', 1) AS alias, id FROM n WHERE id <> '') SELECT alias, max(id) AS name FROM p GROUP BY alias HAVING count(DISTINCT id) = 1"),
    "c10_fixed_chunks": (c10_fixed_chunks, "WITH r AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS chunk FROM conversations) SELECT conv_id, chunk, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars FROM r GROUP BY 1, 2"),
    "c10_greedy_chunks": (c10_greedy_chunks, None),
    "c11_paragraphs": (c11_paragraphs, r"WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents), t AS (SELECT doc_id, trim(regexp_replace(p, '\s+', ' ', 'g')) AS p FROM p), f AS (SELECT p, min(doc_id) AS doc_id FROM t WHERE length(p) >= 40 GROUP BY p) SELECT doc_id, count(*) AS n_paragraphs, sum(length(p))::BIGINT AS n_chars FROM f GROUP BY doc_id"),
    "c12_turn_pairs": (c12_turn_pairs, "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r FROM conversations) SELECT conv_id, r // 2 AS pair, arg_min(text, r) AS query, coalesce(max(CASE WHEN r % 2 = 1 THEN text END), '') AS response FROM r GROUP BY 1, 2"),
    "c13_rows_per_type": (c13_rows_per_type, "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events QUALIFY r > 2 AND r <= 12"),
    "s3_message_ids": (s3_message_ids, r"SELECT concat_ws(':', 'topic', conv_id::VARCHAR, role, turn::VARCHAR) AS event_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''"),
    "s4_timestamp_layouts": (s4_timestamp_layouts, "SELECT event_id, strftime(CASE WHEN event_id % 3 = 2 THEN date_trunc('day', ts) ELSE ts END, '%Y-%m-%d %H:%M') AS at FROM events".replace(" AS at", ' AS "at"')),
    "s11_session_export": (s11_session_export, "SELECT conv_id, sha256('Session ' || conv_id || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS document_sha FROM conversations GROUP BY conv_id"),
    "s13_group_chat_records": (s13_group_chat_records, """SELECT 'sample:' || conv_id AS "group", strftime(TIMESTAMP '1970-01-01 00:00:00' + turn * INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS "at", 'D' || conv_id || ':' || turn AS dialog_id FROM conversations"""),
    "d1_anchor_dates": (d1_anchor_dates, "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS anchor FROM events"),
    "d2_relative_times": (d2_relative_times, """
WITH e AS (SELECT event_id, ts::DATE AS a, event_id % 7 AS k FROM events), x AS (
  SELECT event_id, k, a, ['yesterday', 'last friday', 'next month', 'seven years now', 'two weekends ago', 'next week'][k + 1] AS expression,
    CASE k WHEN 0 THEN a - 1 WHEN 1 THEN a - ((isodow(a) + 1) % 7 + 1)::INT WHEN 2 THEN (date_trunc('month', a) + INTERVAL 1 MONTH)::DATE WHEN 3 THEN make_date(year(a) - 7, 1, 1)
      WHEN 4 THEN a - ((isodow(a)) % 7 + 1)::INT - 7 WHEN 5 THEN a + 7 END AS s FROM e WHERE k < 6)
SELECT event_id, expression, strftime(s, '%Y-%m-%d') AS start_day, strftime(CASE k WHEN 2 THEN last_day(s) WHEN 3 THEN a WHEN 4 THEN s + 1 ELSE s END, '%Y-%m-%d') AS end_day FROM x"""),
    "d4_time_profile": (d4_time_profile, "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS roles, count(DISTINCT ts::DATE) AS n_days FROM events GROUP BY 1"),
    "d9_date_equivalence": (d9_date_equivalence, r"""
WITH x AS (SELECT l_orderkey, l_linenumber, o_orderpriority AS p, o_orderdate::DATE AS g, l_shipdate::DATE AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
y AS (SELECT *, [s, CASE WHEN day(s) <= 12 THEN make_date(year(s), day(s), month(s)) ELSE s END] AS ss, CASE WHEN p >= '4' AND day(g) <= 12 THEN [g, make_date(year(g), day(g), month(g))] ELSE [g] END AS gs FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN p >= '2' AND p < '3' THEN list_contains(list_transform(ss, lambda a: date_trunc('month', a)), date_trunc('month', g)) WHEN p >= '3' AND p < '4' THEN year(s) = year(g) ELSE list_has_any(gs, ss) END AS same FROM y"""),
    "d10_dialog_order": (d10_dialog_order, "SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 1000000000 ELSE conv_id END::INT AS session, CASE WHEN turn % 5 = 4 THEN 1000000000 ELSE turn END::INT AS number FROM conversations"),
}
