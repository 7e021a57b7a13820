"""Retrieval queries: documents as corpus, benchmark passages as questions, embeddings as given vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_tokens, stemmed_tokens
from ..operators import metrics, retrieval, times
from .common import table


def _corpus(spark, d):
    docs = table(spark, d, "documents").select("doc_id", plain_tokens(F.col("text")).alias("tokens"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), plain_tokens(F.col("text")).alias("tokens"))
    return docs, asked


def _vectors(spark, d):
    v = table(spark, d, "embeddings")
    return v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def r1_bm25(spark, d) -> DataFrame:
    return retrieval.bm25(*_corpus(spark, d))


def r1_bm25_allowed(spark, d) -> DataFrame:
    docs, asked = _corpus(spark, d)
    allowed = table(spark, d, "documents").where("lang = 'en'").select("doc_id")
    return retrieval.bm25(docs, asked, k1=1.2, allowed=allowed)


_BM25 = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM benchmark),
st AS (SELECT count(*) AS n, greatest(avg(len(t)), 1.0) AS m FROM d),
terms AS (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d),
tf AS (SELECT term, doc_id, len, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (
  SELECT q.query_id, tf.doc_id, round(sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * ({k1} + 1) / (tf.tf + {k1} * (1 - 0.75 + 0.75 * tf.len / st.m))), 6) AS score
  FROM tf JOIN df USING (term) JOIN q USING (term) CROSS JOIN st GROUP BY 1, 2
),
bm25 AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0 {allowed} QUALIFY rank <= 10)
"""
_PLAIN = _BM25.format(k1=1.5, allowed="")
_DENSE = """
, p AS (
  SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(
    list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) /
    (sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) + 1e-12), 6) AS score
  FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id
),
dense AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM p QUALIFY rank <= 10)
"""
_DENSE_ONLY = "WITH" + _DENSE.lstrip().lstrip(",")
_UNION = ", u AS (SELECT query_id, doc_id, b.score AS lex, b.rank AS lr, e.score AS den, e.rank AS dr FROM bm25 b FULL JOIN dense e USING (query_id, doc_id))"


def r2_cosine(spark, d) -> DataFrame:
    return retrieval.dense(*_vectors(spark, d))


def r3_max_merge(spark, d) -> DataFrame:
    hits = r1_bm25(spark, d)
    return retrieval.max_merge(hits.select("query_id", "doc_id", "score"), hits.select("query_id", "doc_id", F.round(F.col("score") / F.col("rank"), 6).alias("score")))


def r4_weighted_union(spark, d) -> DataFrame:
    return retrieval.weighted_union(r1_bm25(spark, d), r2_cosine(spark, d))


def r5_rank_fusion(spark, d) -> DataFrame:
    return retrieval.rank_fusion(r1_bm25(spark, d), r2_cosine(spark, d))


def r5_rank_sum(spark, d) -> DataFrame:
    return retrieval.rank_fusion(r1_bm25(spark, d), r2_cosine(spark, d), overlap=None)


def r6_scope_routing(spark, d) -> DataFrame:
    """Sources as scopes: each question's best three by the sum of all their documents' scores."""
    hits = retrieval.bm25(*_corpus(spark, d), k=None).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    sums = hits.groupBy("query_id", F.col("source").alias("scope")).agg(F.round(F.sum("score"), 4).alias("score"))
    return retrieval.top(sums, 3, ["query_id"], [F.desc("score"), F.col("scope")])


def r7_anchor_scopes(spark, d) -> DataFrame:
    """Part names as what questions mention; their first words are speakers, all their words entities."""
    name = F.explode(F.split("p_name", " ")).alias("value")
    parts = table(spark, d, "part")
    scopes = parts.select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("scope_id"), F.lit("speaker").alias("scope_type"), F.substring_index("p_name", " ", 1).alias("value"))
    scopes = scopes.unionByName(parts.select(F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("scope_id"), F.lit("entity").alias("scope_type"), name))
    entities = parts.select(F.col("p_partkey").alias("query_id"), F.upper("p_name").alias("entity"))
    return retrieval.anchor_scopes(entities, scopes)


def r9_scope_pushdown(spark, d) -> DataFrame:
    routed = r6_scope_routing(spark, d).where("rank = 1").select("query_id", "scope")
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("scope")).join(routed, "scope").groupBy("query_id", "scope").agg(F.count(F.lit(1)).alias("n_candidates"))


def r10_backoff(spark, d) -> DataFrame:
    """The ten best inside the scope joined by the three best without scope, best score each, ranked anew."""
    docs, asked = _corpus(spark, d)
    every = retrieval.bm25(docs, asked, k=3).select("query_id", "doc_id", "score")
    scoped = retrieval.bm25(docs, asked, allowed=table(spark, d, "documents").where("lang = 'en'").select("doc_id")).select("query_id", "doc_id", "score")
    return retrieval.top(retrieval.max_merge(scoped, every), 13, ["query_id"], [F.desc("score"), F.col("doc_id")])


def r14_group_ranking(spark, d) -> DataFrame:
    hits = r1_bm25(spark, d).join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    score = F.round(F.sum("score") + 0.35 * F.count_distinct("source"), 4)
    return retrieval.top(hits.groupBy("query_id", "lang").agg(score.alias("score")), 24, ["query_id"], [F.desc("score"), F.col("lang")])


def r16_time_order(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") != "error", F.col("ts")).alias("ts"))
    return retrieval.top(e, 5, ["user_id"], [F.desc_nulls_last("ts"), F.col("event_id")]).select("user_id", "event_id", "rank")


def r17_term_relevance(spark, d) -> DataFrame:
    """Share of the query's idf mass that each top document holds."""
    docs, asked = _corpus(spark, d)
    hits = retrieval.bm25(docs, asked)
    terms = docs.select("doc_id", F.explode(F.array_distinct("tokens")).alias("term"))
    want = asked.select("query_id", F.explode(F.array_distinct("tokens")).alias("term"))
    seen = terms.join(want.select("term").distinct(), "term", "left_semi")
    idf = want.select("term").distinct().join(seen.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term", "left").join(docs.agg(F.count(F.lit(1)).alias("n"))).select("term", (F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf"))
    total = want.join(idf, "term").groupBy("query_id").agg(F.sum("idf").alias("total"))
    met = hits.select("query_id", "doc_id").join(want, "query_id").join(seen, ["doc_id", "term"], "left_semi").join(idf, "term").groupBy("query_id", "doc_id").agg(F.sum("idf").alias("met"))
    return met.join(total, "query_id").select("query_id", "doc_id", F.round(F.col("met") / F.col("total"), 5).alias("relevance"))


def r18_diversified(spark, d) -> DataFrame:
    docs, asked = _corpus(spark, d)
    return retrieval.diversified(retrieval.bm25(docs, asked).join(docs.select("doc_id", F.array_distinct("tokens").alias("terms")), "doc_id"), 5)


def r19_round_robin(spark, d) -> DataFrame:
    """Turns of each role in turn: the first of every role, then the second."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "role")
    deep = t.withColumn("depth", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")))
    return deep.withColumn("pick", F.row_number().over(Window.partitionBy("conv_id").orderBy("depth", "role", "turn"))).select("conv_id", "turn", "depth", "pick")


def _slots(spark, d):
    part = lambda lo: F.transform(F.slice("embedding", lo, 16), lambda x: F.abs(x))
    v = table(spark, d, "embeddings").select("vec_id", part(1).alias("time"), part(17).alias("content"))
    return v.withColumnRenamed("vec_id", "doc_id"), v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("time").alias("q_time"), F.col("content").alias("q_content"))


def r20_vigilance(spark, d) -> DataFrame:
    return retrieval.vigilance(*_slots(spark, d), {"time": 0.6, "content": 0.6})


def r20_weighted(spark, d) -> DataFrame:
    """Time counts three times as much as content, and needs less of it."""
    return retrieval.vigilance(*_slots(spark, d), {"time": 0.5, "content": 0.55}, k=5, weights={"time": 0.75, "content": 0.25})


def r21_scaling(spark, d) -> DataFrame:
    v = table(spark, d, "embeddings").withColumns({"lo": F.array_min("embedding").cast("double"), "hi": F.array_max("embedding").cast("double")})
    scaled = F.transform("embedding", lambda x: F.when(F.col("hi") > F.col("lo"), (x.cast("double") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5))
    return v.select("vec_id", F.round(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x), 6).alias("scaled_sum"), F.round(F.element_at(scaled, 1), 6).alias("scaled_first"))


def r22_fill_missing(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.to_date("ts")).alias("day"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"))
    first = e.agg(F.coalesce(F.add_months(F.min("day"), -12), F.lit("1900-01-01").cast("date")).alias("first"))
    return e.join(F.broadcast(first)).select("event_id", F.date_format(F.coalesce("day", "first"), "yyyy-MM-dd").alias("day"), F.coalesce("kind", F.lit("none")).alias("kind"))


def r23_latest(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest_id"))


def r27_external_hits(spark, d) -> DataFrame:
    t = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, F.col("doc_id") % 7).cast("double").alias("score"))
    filled = t.select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    # Runs of one score and about 4,000 ids of a group.
    runs = [-F.col("score"), F.floor(F.col("doc_id") / 40_000)]
    return retrieval.ranked(filled.withColumn("g", F.col("doc_id") % 10), ["g"], runs, [F.col("doc_id")]).drop("g")


def d5_time_rerank(spark, d) -> DataFrame:
    hits = r1_bm25(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return retrieval.top(times.rerank(hits.drop("rank"), F.array("lang"), F.array(F.lit("en"), F.lit("de"))).drop("lang"), 10, ["query_id"], [F.desc("score"), F.col("doc_id")])


def m7_hit_mrr(spark, d) -> DataFrame:
    """First rank of a document that shares the query vector's label."""
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    hits = r2_cosine(spark, d).join(labels.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("l")), "doc_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    return metrics.rank_metrics(hits.groupBy("query_id").agg(F.min(F.when(F.col("l") == F.col("ql"), F.col("rank"))).alias("rank")), (1, 3, 5, 10))


def t1_stemmed_terms(spark, d) -> DataFrame:
    t = table(spark, d, "conversations").select(F.explode(stemmed_tokens(F.col("text"))).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


_SLOT = "list_transform(embedding[{0}:{1}], lambda x: abs(x)::DOUBLE)"
QUERIES = {
    "r1_bm25": (r1_bm25, _PLAIN + "SELECT * FROM bm25"),
    "r1_bm25_allowed": (r1_bm25_allowed, _BM25.format(k1=1.2, allowed="AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')") + "SELECT * FROM bm25"),
    "r2_cosine": (r2_cosine, _DENSE_ONLY + "SELECT * FROM dense"),
    "r3_max_merge": (r3_max_merge, _PLAIN + "SELECT query_id, doc_id, max(s) AS score FROM (SELECT query_id, doc_id, score AS s FROM bm25 UNION ALL SELECT query_id, doc_id, round(score / rank, 6) FROM bm25) GROUP BY 1, 2"),
    "r4_weighted_union": (r4_weighted_union, _PLAIN + _DENSE + _UNION + """
, s AS (SELECT query_id, doc_id, lr, dr, round(coalesce(lex, 0) + 8.0 * greatest(coalesce(den, 0), 0), 6) AS score, CASE WHEN lex IS NOT NULL AND den IS NOT NULL THEN 'hybrid' WHEN den IS NOT NULL THEN 'embedding' ELSE 'bm25' END AS source FROM u)
SELECT query_id, doc_id, score, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lr NULLS LAST, dr NULLS LAST, doc_id) AS rank FROM s"""),
    "r5_rank_fusion": (r5_rank_fusion, _PLAIN + _DENSE + _UNION + """
, s AS (SELECT query_id, doc_id, coalesce(1.0::DOUBLE / (60 + lr), 0) AS a, coalesce(1.0::DOUBLE / (60 + dr), 0) AS b FROM u), f AS (SELECT query_id, doc_id, round(greatest(a, b) + 0.25 * least(a, b), 8) AS score FROM s)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f"""),
    "r5_rank_sum": (r5_rank_sum, _PLAIN + _DENSE + _UNION + """
, f AS (SELECT query_id, doc_id, round(coalesce(1.0::DOUBLE / (60 + lr), 0) + coalesce(1.0::DOUBLE / (60 + dr), 0), 8) AS score FROM u)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f"""),
    "r6_scope_routing": (r6_scope_routing, _PLAIN + ", s AS (SELECT query_id, source AS scope, round(sum(score), 4) AS score FROM (SELECT * FROM sc WHERE score > 0) JOIN documents USING (doc_id) GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, scope) AS rank FROM s QUALIFY rank <= 3"),
    "r7_anchor_scopes": (r7_anchor_scopes, r"""
WITH s AS (SELECT 's' || p_partkey AS scope_id, 'speaker' AS scope_type, lower(split_part(p_name, ' ', 1)) AS alias FROM part UNION ALL SELECT 'e' || p_partkey, 'entity', lower(unnest(string_split(p_name, ' '))) FROM part),
n AS (SELECT p_partkey AS query_id, trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', ' ', 'g')) AS name FROM part),
c AS (SELECT scope_id, scope_type, trim(regexp_replace(alias, '[^\p{L}\p{N}]+', ' ', 'g')) AS alias FROM s),
m AS (SELECT DISTINCT query_id, alias FROM n JOIN (SELECT DISTINCT alias FROM c WHERE scope_type = 'speaker' AND alias <> '') ON contains(' ' || name || ' ', ' ' || alias || ' '))
SELECT query_id, scope_type, alias, min(scope_id) AS scope_id FROM m JOIN c USING (alias) GROUP BY ALL"""),
    "r9_scope_pushdown": (r9_scope_pushdown, _PLAIN + ", s AS (SELECT query_id, source AS scope, round(sum(score), 4) AS score FROM (SELECT * FROM sc WHERE score > 0) JOIN documents USING (doc_id) GROUP BY 1, 2), r AS (SELECT query_id, scope FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, scope) = 1) SELECT query_id, scope, count(*) AS n_candidates FROM r JOIN documents d ON d.source = r.scope GROUP BY 1, 2"),
    "r10_backoff": (r10_backoff, _PLAIN + ", e AS (SELECT query_id, doc_id, score FROM sc WHERE score > 0 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10), m AS (SELECT query_id, doc_id, score FROM bm25 WHERE rank <= 3 UNION SELECT * FROM e) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m"),
    "r14_group_ranking": (r14_group_ranking, _PLAIN + ", s AS (SELECT query_id, lang, round(sum(score) + 0.35 * count(DISTINCT source), 4) AS score FROM bm25 JOIN documents USING (doc_id) GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lang) AS rank FROM s QUALIFY rank <= 24"),
    "r16_time_order": (r16_time_order, "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type <> 'error' THEN ts END DESC NULLS LAST, event_id) AS rank FROM events QUALIFY rank <= 5"),
    "r17_term_relevance": (r17_term_relevance, _PLAIN + """
, x AS (SELECT DISTINCT doc_id, term FROM terms WHERE term IN (SELECT term FROM q)), i AS (SELECT w.term, ln(((SELECT n FROM st) + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT term FROM q) w LEFT JOIN df ON df.term = w.term),
tot AS (SELECT query_id, sum(idf) AS total FROM q JOIN i USING (term) GROUP BY 1)
SELECT b.query_id, b.doc_id, round(sum(i.idf) / any_value(total), 5) AS relevance FROM bm25 b JOIN q USING (query_id) JOIN x ON x.doc_id = b.doc_id AND x.term = q.term JOIN i ON i.term = q.term JOIN tot ON tot.query_id = b.query_id GROUP BY 1, 2"""),
    "r18_diversified": (r18_diversified, None),
    "r19_round_robin": (r19_round_robin, "WITH x AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS depth FROM conversations) SELECT conv_id, turn, depth, row_number() OVER (PARTITION BY conv_id ORDER BY depth, role, turn) AS pick FROM x"),
    "r20_vigilance": (r20_vigilance, f"""
WITH v AS (SELECT vec_id, {_SLOT.format(1, 16)} AS t, {_SLOT.format(17, 32)} AS c FROM embeddings),
m AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id,
  round(list_sum(list_transform(list_zip(q.t, e.t), lambda z: least(z[1], z[2]))) / list_sum(q.t), 6) AS mt, round(list_sum(list_transform(list_zip(q.c, e.c), lambda z: least(z[1], z[2]))) / list_sum(q.c), 6) AS mc FROM v q JOIN v e ON q.vec_id % 100 = 0),
s AS (SELECT query_id, doc_id, round((mt + mc) / 2, 7) AS score FROM m WHERE mt >= 0.6 AND mc >= 0.6)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10"""),
    "r20_weighted": (r20_weighted, f"""
WITH v AS (SELECT vec_id, {_SLOT.format(1, 16)} AS t, {_SLOT.format(17, 32)} AS c FROM embeddings),
m AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id,
  round(list_sum(list_transform(list_zip(q.t, e.t), lambda z: least(z[1], z[2]))) / list_sum(q.t), 6) AS mt, round(list_sum(list_transform(list_zip(q.c, e.c), lambda z: least(z[1], z[2]))) / list_sum(q.c), 6) AS mc FROM v q JOIN v e ON q.vec_id % 100 = 0),
s AS (SELECT query_id, doc_id, round(0.75 * mt + 0.25 * mc, 7) AS score FROM m WHERE mt >= 0.5 AND mc >= 0.55)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5"""),
    "r21_scaling": (r21_scaling, "WITH v AS (SELECT vec_id, embedding AS e, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings), s AS (SELECT vec_id, list_transform(e, lambda x: CASE WHEN hi > lo THEN (x::DOUBLE - lo) / (hi - lo) ELSE 0.5 END) AS l FROM v) SELECT vec_id, round(list_sum(l), 6) AS scaled_sum, round(l[1], 6) AS scaled_first FROM s"),
    "r22_fill_missing": (r22_fill_missing, "WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN ts::DATE END AS day, CASE WHEN event_type <> 'view' THEN event_type END AS kind FROM events) SELECT event_id, strftime(coalesce(day, (SELECT coalesce((min(day) - INTERVAL 12 MONTH)::DATE, DATE '1900-01-01') FROM e)), '%Y-%m-%d') AS day, coalesce(kind, 'none') AS kind FROM e"),
    "r23_latest": (r23_latest, "SELECT user_id, event_type AS latest, event_id AS latest_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "r27_external_hits": (r27_external_hits, "WITH t AS (SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN doc_id % 7 END, 0)::DOUBLE AS score FROM labels) SELECT doc_id, score, row_number() OVER (PARTITION BY doc_id % 10 ORDER BY score DESC, doc_id) AS rank FROM t"),
    "d5_time_rerank": (d5_time_rerank, _PLAIN + ", s AS (SELECT query_id, doc_id, round(score + CASE WHEN lang IN ('en', 'de') THEN 0.25 ELSE 0 END, 6) AS score FROM bm25 JOIN documents USING (doc_id)) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s"),
    "m7_hit_mrr": (m7_hit_mrr, _DENSE_ONLY + ", r AS (SELECT d.query_id, min(CASE WHEN a.label = b.label THEN rank END) AS rank FROM dense d JOIN embeddings a ON a.vec_id = d.doc_id JOIN embeddings b ON b.vec_id = d.query_id GROUP BY 1) SELECT count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_{k}" for k in (1, 3, 5, 10)) + ", round(avg(coalesce(1.0::DOUBLE / rank, 0)), 4) AS mrr FROM r"),
    "t1_stemmed_terms": (t1_stemmed_terms, "WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_'']+')) AS t FROM conversations) SELECT CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN t[:-4] || 'y' WHEN t LIKE '%ing' AND length(t) > 5 THEN t[:-4] WHEN t LIKE '%ed' AND length(t) > 4 THEN t[:-3] WHEN t LIKE '%s' AND length(t) > 4 THEN t[:-2] ELSE t END AS term, count(*) AS n FROM t GROUP BY 1"),
}
