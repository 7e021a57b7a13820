"""The registered queries over the training-data operators, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat_format, html_extract, language_id, line_dedup, lm_score, minhash, packing, prefix_trie, quality_rules, sentencepiece_lattice, spelling, substring
from .common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), "text")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_format.rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return out.withColumn("mask", spans)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and the text that they decode to."""
    path = tokenizer_file("piece_bpe_32k.model")
    encoded = sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), path)
    return sentencepiece_lattice.decode(encoded, path).select("doc_id", "n_tokens", "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"), with_ids=False)
    return packing.pack(pieces)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "bits")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_line_dedup, op2_html_extraction, op3_chat_formatting, op4_nearest_neighbours, op5_sentencepiece,
        op6_quality_rules, op7_lm_scoring, op8_best_fit_packing, op9_minhash_dedup, op10_substring_dedup,
        op11_language_id, op12_spelling_variants, op13_prefix_trie,
    )
    return {f.__name__: f for f in named}


_WORDS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_LINES = r"""
WITH parts AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS ix FROM parts WHERE text IS NOT NULL),
solid AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ix) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
wins AS (
  SELECT doc_id, n, hash(line, lead(line) OVER w, lead(line, 2) OVER w) AS k, lead(line, 2) OVER w IS NOT NULL AS whole
  FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY n)
),
late AS (SELECT doc_id, n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, n) AS r FROM wins WHERE whole) WHERE r > 1),
gone AS (SELECT DISTINCT s.doc_id, s.ix FROM late l JOIN solid s ON s.doc_id = l.doc_id AND s.n BETWEEN l.n AND l.n + 2),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.ix) FILTER (WHERE g.ix IS NULL) AS text, count(*) AS n_lines, count(g.ix) AS n_removed
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.ix = l.ix GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

_CHAT = r"""
WITH own AS (
  SELECT conv_id, 0::BIGINT AS part, turn, replace(role, '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
views AS (SELECT o.*, p.role AS perspective FROM own o JOIN (SELECT DISTINCT conv_id, role FROM own WHERE role IS NOT NULL) p ON p.conv_id = o.conv_id),
pieces AS (
  SELECT *, coalesce(role = perspective, false) AS mine, text || '<|end|>' AS body,
    CASE WHEN role = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user' || coalesce(' name=' || role, '') || '|>' || chr(10) END AS head
  FROM views
),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
      PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS lo
  FROM pieces
)
SELECT conv_id, perspective, part, count(*) AS n_turns,
  string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS text,
  coalesce(string_agg(lo::BIGINT::VARCHAR || '-' || (lo + length(body))::BIGINT::VARCHAR, ',' ORDER BY lo) FILTER (WHERE mine), '') AS mask
FROM placed GROUP BY conv_id, perspective, part
"""

_NEAR = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN comp c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_REPEATS = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS ix, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i + 19], ' ')))) AS k FROM w WHERE len(w) >= 20),
late AS (SELECT doc_id, ix FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, ix) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(ix, ix + 20)) AS ix FROM late),
lists AS (SELECT doc_id, list(ix) AS g FROM gone GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS ix FROM w),
kept AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.ix) AS t FROM pos p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.ix = p.ix WHERE g.ix IS NULL GROUP BY p.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(l.g), 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN lists l ON l.doc_id = w.doc_id LEFT JOIN kept k ON k.doc_id = w.doc_id
"""


#: The checksum of zip files, by a table of 256 made by its rule; {0}: a list of bytes as BIGINT.
_CRC_TABLE = "SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS t"
_CRC = "xor(list_reduce({0}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"

_TRIE = rf"""
WITH crc AS ({_CRC_TABLE}),
turns AS (
  SELECT conv_id AS c, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS m, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
),
lists AS (SELECT c, list(m ORDER BY i) AS l FROM turns GROUP BY c),
convs AS (SELECT c, l, {_CRC.format("list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 4 AS h FROM lists, crc),
rebuilt AS (SELECT a.c, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS l FROM convs a LEFT JOIN lists b ON b.c = a.c - a.c % 20),
pre AS (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM rebuilt),
nodes AS (SELECT d, l[1:d] AS k, min(c) AS conv_id, count(*) AS n_convs FROM pre GROUP BY 1, 2),
kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
own AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * len({_WORDS.format("n.k[n.d].t")}) END AS saved
  FROM nodes n LEFT JOIN kids c ON c.d = n.d AND c.k = n.k
),
up AS (SELECT *, unnest(range(0, d + 1)) AS a FROM own),
totals AS (SELECT a AS d, k[1:a] AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY 1, 2),
ends AS (SELECT len(l) AS d, l AS k, string_agg(c::VARCHAR, ',' ORDER BY c) AS t FROM rebuilt GROUP BY 1, 2)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves, t.saved_tokens, sha256(coalesce(e.t, '')) AS ends_sha256
FROM own n JOIN totals t ON t.d = n.d AND t.k = n.k LEFT JOIN nodes p ON p.d = n.d - 1 AND p.k = n.k[1:n.d - 1] LEFT JOIN ends e ON e.d = n.d AND e.k = n.k
"""

_BYTES = "flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, 128 + (unicode(x) & 63)::BIGINT] END))"

_SPELLING = rf"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2
),
sums AS (SELECT *, {_CRC.format(_BYTES.format("doc_id::VARCHAR || ':' || run"))} AS h FROM runs, crc),
vocab AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM sums GROUP BY 1 HAVING sum(n) >= 3 AND length(word) >= 5
),
places AS (SELECT word, n, length(word) AS len, unnest(range(0, length(word))) AS i FROM vocab),
without AS (SELECT word, n, len, i, substr(word, 1, i) || substr(word, i + 2) AS x FROM places),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM without a JOIN without b ON a.x = b.x AND a.i = b.i AND a.len = b.len AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM without a JOIN vocab b ON b.word = a.x
  UNION SELECT b.word, b.n, a.word, a.n FROM without a JOIN vocab b ON b.word = a.x
),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM pairs),
forms AS (SELECT word, n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM ranked WHERE r = 1),
walk AS (SELECT word, form AS at FROM forms WHERE form IS NOT NULL UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.at WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.at AS root FROM walk w LEFT JOIN forms f ON f.word = w.at WHERE f.form IS NULL)
SELECT v.word, f.form, coalesce(e.root, v.word) AS root, v.n, coalesce(f.n_near, 0) AS n_near, f.form_n
FROM vocab v LEFT JOIN forms f ON f.word = v.word LEFT JOIN ends e ON e.word = v.word
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": _LINES, "op3_chat_formatting": _CHAT, "op9_minhash_dedup": _NEAR, "op10_substring_dedup": _REPEATS, "op12_spelling_variants": _SPELLING, "op13_prefix_trie": _TRIE}
