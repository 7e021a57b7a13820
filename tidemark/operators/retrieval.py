"""Retrieval for many questions at once: BM25, cosine, fusion, time-aware reranking, coverage picks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def top(df: DataFrame, k: int, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1; Spark limits ranks before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def ranked(df: DataFrame, by: list[str], run: list[Column], order: list[Column], name: str = "rank") -> DataFrame:
    """Rows of each group numbered from 1 by `run` and then `order`, a group of any size in many tasks: rows are numbered
    within each run and moved by the sizes of the runs before. Runs are columns that sort before all of `order`; only
    their sizes, a row a run, meet in one task of a group.
    """
    keys = [f"_run{i}" for i in range(len(run))]
    rows = df.withColumns(dict(zip(keys, run)))
    group = [*by, *keys]
    before = Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sizes = sizes.select("_before", *[F.col(c).alias(f"_of_{c}") for c in group])
    placed = rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group]
    return placed.join(sizes, same).withColumn(name, (F.col(name) + F.col("_before")).cast("int")).select(*df.columns, name)


#: Rows of a table that is broadcast, at most; their number is counted first.
BROADCAST_ROWS = 200_000


def if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Numbers of a block of questions' weights (terms x questions) that a task holds, and blocks at most; beyond these, joins.
BLOCK, MOST_BLOCKS = 4_000_000, 32
#: Documents of a batch whose terms are counted at once: what a task holds besides the batch does not grow with it.
COUNTED_ROWS = 256


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = 10, k1: float = 1.5, b: float = 0.75, allowed: DataFrame | None = None, weighted: bool = False) -> DataFrame:
    """query_id, doc_id, score, rank from docs (doc_id, tokens) and queries (query_id, tokens); all hits and no rank if k is None.

    Statistics are those of all documents; `allowed` (doc_id, and query_id if it differs by question) limits candidates
    only, after them. weighted counts a query term as often as it stands. Null tokens are none.

    Tokens are made once, and what is written of a document is the counts of terms that some question has. Where questions
    are few (counted first) their weights go to the tasks in blocks, and a task sends on its best k a question, or all hits
    where each question has its own candidates or k is None. Where they are many, questions and counts meet by joins.
    """
    own = bool(allowed is not None and "query_id" in allowed.columns)
    docs = docs.select("doc_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    asked = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg((F.count(F.lit(1)) if weighted else F.lit(1).cast("long")).alias("times"))
    terms, questions = asked.agg(F.count_distinct("term"), F.count_distinct("query_id")).first()
    if terms > BROADCAST_ROWS or terms * questions > BLOCK * MOST_BLOCKS:
        hits = _joined_bm25(docs, asked, k1, b, allowed)
    else:
        counted = _counted(docs, asked.select("term").distinct())
        hits = _blocks(counted, asked, max(1, BLOCK // max(1, terms)), None if own else k, k1, b, None if own else allowed)
        if own:
            hits = hits.join(allowed, ["query_id", "doc_id"], "left_semi")
    return hits if k is None else top(hits, k, ["query_id"], [F.desc("score"), F.col("doc_id")])


def _joined_bm25(docs: DataFrame, asked: DataFrame, k1: float, b: float, allowed: DataFrame | None) -> DataFrame:
    """All hits by joins of questions' terms and documents' counts, for any number of questions."""
    asked, per_query = cut(asked), allowed is not None and "query_id" in allowed.columns
    lengths = docs.select("doc_id", F.size("tokens").alias("len"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "tokens")).alias("term"))
    kept = lengths.join(asked.select("term").distinct().withColumn("known", F.lit(True)), "term", "left").where("term is null or known")
    tf = cut(kept.groupBy("term", "doc_id", "len").agg(F.count(F.lit(1)).alias("tf")))
    stats = tf.where("term is null").agg(F.sum("tf").alias("n_docs"), F.greatest(F.avg("len"), F.lit(1.0)).alias("mean_len"))
    tf = tf.where("term is not null")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if allowed is not None and not per_query:
        tf = tf.join(allowed, "doc_id", "left_semi")
    scored = tf.join(df, "term").join(asked, "term").join(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))
    hits = scored.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    return hits.join(allowed, ["query_id", "doc_id"], "left_semi") if per_query else hits


def _counted(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, len, terms, counts), written: of each document its length and how often it has each term of a small vocabulary."""
    words = pa.array(sorted(r["term"] for r in vocabulary.collect()), pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, COUNTED_ROWS) for b in batches for lo in range(0, b.num_rows, COUNTED_ROWS)):
            tokens = batch.column("tokens")
            length = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)).astype(np.int64)
            at = pc.index_in(tokens.flatten(), value_set=words)
            which = np.asarray(pc.fill_null(at, -1)).astype(np.int64)
            row = np.repeat(np.arange(len(length)), length)[which >= 0]
            pair, n = np.unique(row * max(1, len(words)) + which[which >= 0], return_counts=True)
            ends = np.searchsorted(pair, np.arange(len(length) + 1) * max(1, len(words))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pair % max(1, len(words)), n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(length), *lists], ["doc_id", "len", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut(docs.select("doc_id", "tokens").mapInArrow(count, f"doc_id {kind}, len long, terms array<int>, counts array<int>"))


def _blocks(counted: DataFrame, asked: DataFrame, most: int, k: int | None, k1: float, b: float, allowed: DataFrame | None) -> DataFrame:
    """Hits of counted documents, questions in blocks of `most`: a document's weights times the block's terms by questions."""
    n_docs, mean = counted.agg(F.count(F.lit(1)), F.greatest(F.avg("len"), F.lit(1.0))).first()
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
    rows = asked.toArrow()
    words, term = np.unique(np.asarray(rows.column("term").to_pylist(), dtype=object), return_inverse=True) if rows.num_rows else (np.zeros(0, object), np.zeros(0, np.int64))
    frequency = np.zeros(len(words))
    frequency[np.asarray(df.column("term"))] = np.asarray(df.column("df"))
    idf = np.log(1 + (n_docs - frequency + 0.5) / (frequency + 0.5))
    ids, query = np.unique(np.asarray(rows.column("query_id").to_pylist(), dtype=object), return_inverse=True) if rows.num_rows else (np.zeros(0, object), np.zeros(0, np.int64))
    weight = np.asarray(rows.column("times")) * idf[term]
    source = counted if allowed is None else counted.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    kind, to = (x.schema[c].dataType for x, c in ((asked, "query_id"), (counted, "doc_id")))
    schema = f"query_id {kind.simpleString()}, doc_id {to.simpleString()}, score double"
    if not len(ids):
        return counted.sparkSession.createDataFrame([], schema)
    out = None
    for lo in range(0, len(ids), most):
        mine = (query >= lo) & (query < lo + most)
        block = np.zeros((len(words), min(most, len(ids) - lo)))
        block[term[mine], query[mine] - lo] = weight[mine]
        shared = counted.sparkSession.sparkContext.broadcast((block, ids[lo : lo + most]))
        hits = source.mapInArrow(lambda batches, shared=shared: _scored(batches, *shared.value, k, k1, b, mean), schema)
        out = hits if out is None else out.unionByName(hits)
    return out.withColumn("score", F.round("score", 6)).where("score > 0")


def _scored(batches: Iterator[pa.RecordBatch], block: np.ndarray, ids: np.ndarray, k: int | None, k1: float, b: float, mean: float) -> Iterator[pa.RecordBatch]:
    """(query_id, doc_id, score) of each document and question that share a term; with k, those that may be among a question's
    best k of the task's batch, ties within rounding included."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            length, ends = np.asarray(part.column("len")), np.asarray(part.column("terms").offsets)
            terms, counts = (np.asarray(part.column(c).values) for c in ("terms", "counts"))
            score = np.zeros((part.num_rows, block.shape[1]))
            for i in range(part.num_rows):
                t, n = terms[ends[i] : ends[i + 1]], counts[ends[i] : ends[i + 1]]
                if len(t):
                    score[i] = (n * (k1 + 1) / (n + k1 * (1 - b + b * length[i] / mean))) @ block[t]
            good = score > 0
            if k is not None and len(score) > k:
                good &= score >= np.partition(score, len(score) - k, axis=0)[len(score) - k] - 1e-5
            doc, query = np.nonzero(good)
            yield pa.RecordBatch.from_arrays([pa.array(ids[query].tolist()), part.column("doc_id").take(pa.array(doc)), pa.array(score[doc, query])], ["query_id", "doc_id", "score"])


#: Vectors and queries that meet in one task at a time, about; queries and vectors whose scores are held at once.
MET_VECTORS, MET_QUERIES, AT_ONCE, STRIP = 8_000, 4_000, 64, 1_024


def _met(vectors: DataFrame, queries: DataFrame, find: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """find of each part of the vectors (doc_id, ...) with each part of the queries (query_id, ...): groups of a bounded size."""
    n, m = vectors.count(), queries.count()
    parts, blocks = max(1, -(-n // MET_VECTORS)), max(1, -(-m // MET_QUERIES))
    of = lambda c, size: F.pmod(F.xxhash64(c), F.lit(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    left = vectors.withColumn("_part", of("doc_id", parts)).withColumn("_block", every(blocks))
    right = queries.withColumn("_block", of("query_id", blocks)).withColumn("_part", every(parts))
    return left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInArrow(find, schema)


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows padded with NaN, their lengths, and whether they hold a null."""
    v = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    length, flat = np.asarray(pc.list_value_length(v)).astype(np.int64), v.flatten()
    rows = np.full((len(v), length.max(initial=0)), np.nan)
    inside = np.arange(rows.shape[1]) < length[:, None]
    rows[inside] = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
    gap = np.zeros(rows.shape, bool)
    gap[inside] = np.asarray(flat.is_null())
    return rows, length, gap.any(axis=1)


def _in_order(x: np.ndarray) -> np.ndarray:
    """The sums of rows, added from left to right as SQL and Spark add a list."""
    return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _least_of_alike(row: np.ndarray, values: list[np.ndarray], place: np.ndarray, k: int) -> np.ndarray:
    """Which entries to keep so that of entries of a row with the very same values the first k by place stay."""
    order = np.lexsort((place, *values, row))
    same = np.ones(len(order), bool)
    for x in (row, *values):
        x = x[order]
        same[1:] &= (x[1:] == x[:-1]) | ((x[1:] != x[1:]) & (x[:-1] != x[:-1]))
    start = np.maximum.accumulate(np.where(same & (np.arange(len(order)) > 0), 0, np.arange(len(order))))
    return np.sort(order[np.arange(len(order)) - start < k])


def _kth(score: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row, as a column; less than all where there are fewer."""
    return np.partition(score, score.shape[1] - k, axis=1)[:, [score.shape[1] - k]] if score.shape[1] >= k else np.full((len(score), 1), -np.inf)


def _leads(rows: int, n: int, k: int, slack: float, scored: Callable[[slice], tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all that may be among a row's k best of n columns, from strips of columns.

    scored gives a strip's scores (-inf: no match) and which of them are sure, None for all; what is less than a row's k-th
    sure score by more than `slack` goes. The k-th of the first strip rules out most of the others, so these are only compared.
    """
    least, held, found = np.full(rows, -np.inf), 0, []

    def pruned() -> list[tuple[np.ndarray, ...]]:
        row, at, score, sure = (np.concatenate(x) for x in zip(*found))
        known = np.where(sure, score, -np.inf)
        order = np.lexsort((-known, row))
        start = np.searchsorted(row[order], np.arange(rows + 1))
        full = np.flatnonzero(start[1:] - start[:-1] >= k)
        least[full] = np.maximum(least[full], known[order[start[full] + k - 1]])
        stay = score >= (least - slack)[row]
        return [(row[stay], at[stay], score[stay], sure[stay])]

    for lo in range(0, n, STRIP):
        score, sure = scored(slice(lo, min(n, lo + STRIP)))
        if lo == 0:
            least = _kth(score if sure is None else np.where(sure, score, -np.inf), k)[:, 0].astype(np.float64)
        flat = np.flatnonzero(score >= np.maximum(least - slack, -1e30)[:, None].astype(score.dtype))
        row, at = np.divmod(flat, score.shape[1])
        found.append((row, at + lo, score.ravel()[flat], np.ones(len(flat), bool) if sure is None else sure.ravel()[flat]))
        held += len(flat)
        if held > 200_000:
            found = pruned()
            held = len(found[0][0])
    return pruned()[0][:2] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _usual(length: np.ndarray) -> int:
    """The commonest length."""
    return int(np.bincount(length).argmax()) if len(length) else 0


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, doc_id, score, rank by cosine of given vectors (doc_id, v), all of one length, for queries (query_id, q).

    Exact: parts of the vectors meet parts of the queries in groups of a bounded size, and a group sends on a query's best k,
    with all that rounding may move there; of equal scores the k least ids are enough. Vectors are compared in single
    precision with a slack for its error, and what is left is worked out in double precision; those with nulls, NaN or odd
    lengths or sizes are compared in double precision at once. Null vectors take no part, and a score that a null among the
    numbers leaves unknown comes last.
    """

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        (v, length, gap), (q, q_length, q_gap) = _matrix(left["v"]), _matrix(right["q"])
        ids, asked = (np.asarray(t[c].to_pylist(), dtype=object if pa.types.is_string(t[c].type) else None) for t, c in ((left, "doc_id"), (right, "query_id")))
        place = np.unique(ids, return_inverse=True)[1]
        size, q_size = (np.sqrt((x * x).sum(axis=1, where=~np.isnan(x))) for x in (v, q))
        exact, q_exact = (np.sqrt(_in_order(x)) for x in (v * v, q * q))
        wide, usual = min(v.shape[1], q.shape[1]), _usual(length)
        by_id = np.argsort(ids, kind="stable")
        first, last = (np.searchsorted(ids[by_id], asked, side) for side in ("left", "right"))
        out = [pa.table({"query_id": right["query_id"].slice(0, 0), "doc_id": left["doc_id"].slice(0, 0), "score": pa.array([], pa.float64())})]
        # the usual case, in single precision: one length, no null or NaN, sizes that keep 1e-12 and overflow out of sight
        clean, q_clean = (~g & (n == usual) & np.isfinite(x[:, :usual]).all(axis=1) & (z > 1e-2) & (z < 1e15) if usual and usual <= wide else np.zeros(len(x), bool) for x, n, g, z in ((v, length, gap, size), (q, q_length, q_gap, q_size)))
        unit = lambda x, z: (x[:, :usual] / z[:, None]).astype(np.float32)
        every, slack = np.arange(len(v)), 1e-5 + 2.5e-7 * (usual + 4)
        for some, at_once, fast in ((np.flatnonzero(q_clean), np.flatnonzero(clean), True), (np.flatnonzero(q_clean), np.flatnonzero(~clean), False), (np.flatnonzero(~q_clean), every, False)):
            if not len(some) or not len(at_once):
                continue
            columns, spot = np.ascontiguousarray(unit(v[at_once], size[at_once]).T) if fast else None, np.full(len(v), -1)
            spot[at_once] = np.arange(len(at_once))
            for lo in range(0, len(some), AT_ONCE):
                part = some[lo : lo + AT_ONCE]
                own = last[part] - first[part]
                own_row = np.repeat(np.arange(len(part)), own)
                own_at = spot[by_id[np.repeat(first[part] - np.cumsum(own) + own, own) + np.arange(own.sum())]]

                def others(score: np.ndarray, cols: slice, own_row: np.ndarray = own_row, own_at: np.ndarray = own_at) -> np.ndarray:
                    inside = (own_at >= cols.start) & (own_at < cols.stop)
                    score[own_row[inside], own_at[inside] - cols.start] = -np.inf
                    return score

                if fast:
                    given = unit(q[part], q_size[part])
                    row, at = _leads(len(part), len(at_once), k, slack, lambda cols, given=given, columns=columns, others=others: (others(given @ columns[:, cols], cols), None))
                else:

                    def slow(cols: slice, part: np.ndarray = part, at_once: np.ndarray = at_once, others: Callable = others) -> tuple[np.ndarray, None]:
                        here = at_once[cols]
                        with np.errstate(invalid="ignore", over="ignore"):
                            score = (q[part, :wide] @ v[here, :wide].T) / (q_size[part, None] * size[here] + 1e-12)
                        unknown = q_gap[part, None] | gap[here] | (q_length[part, None] != length[here])
                        return others(np.where(unknown, -2.0, np.where(np.isnan(score), 1e30, score)), cols), None

                    row, at = _leads(len(part), len(at_once), k, slack, slow)
                mine, at = part[row], at_once[at]
                with np.errstate(invalid="ignore", over="ignore"):
                    found = _in_order(q[mine, :wide] * v[at, :wide]) / (q_exact[mine] * exact[at] + 1e-12)
                lost = q_gap[mine] | gap[at] | (q_length[mine] != length[at])
                found[lost] = -2.0
                keep = _least_of_alike(row, [found], place[at], k)
                out.append(pa.table({"query_id": right["query_id"].take(pa.array(mine[keep])), "doc_id": left["doc_id"].take(pa.array(at[keep])), "score": pa.array(found[keep], mask=lost[keep])}))
        return pa.concat_tables(out)

    some = vectors.select("doc_id", "v").where("doc_id is not null and v is not null")
    asked = queries.select("query_id", "q").where("query_id is not null and q is not null")
    kind, to = (x.schema[c].dataType.simpleString() for x, c in ((asked, "query_id"), (some, "doc_id")))
    hits = _met(some, asked, find, f"query_id {kind}, doc_id {to}, score double")
    return top(hits.withColumn("score", F.round("score", 6)), k, ["query_id"], [F.desc("score"), F.col("doc_id")])


def max_merge(*hits: DataFrame) -> DataFrame:
    """The best score of each document over several queries of one question."""
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    return every.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def _both(lexical: DataFrame, dense_: DataFrame) -> DataFrame:
    a = lexical.select("query_id", "doc_id", F.col("score").alias("lex"), F.col("rank").alias("lex_rank"))
    b = dense_.select("query_id", "doc_id", F.col("score").alias("den"), F.col("rank").alias("den_rank"))
    return a.join(b, ["query_id", "doc_id"], "full")


def weighted_union(lexical: DataFrame, dense_: DataFrame, weight: float = 8.0) -> DataFrame:
    """score = lexical + weight * max(cosine, 0), tagged by source; ties by lexical rank, dense rank, id."""
    score = F.round(F.coalesce("lex", F.lit(0.0)) + weight * F.greatest(F.coalesce("den", F.lit(0.0)), F.lit(0.0)), 6)
    source = F.when(F.col("lex").isNotNull() & F.col("den").isNotNull(), "hybrid").when(F.col("den").isNotNull(), "embedding").otherwise("bm25")
    rows = _both(lexical, dense_).select("query_id", "doc_id", score.alias("score"), source.alias("source"), "lex_rank", "den_rank")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("lex_rank"), F.asc_nulls_last("den_rank"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).drop("lex_rank", "den_rank")


def rank_fusion(lexical: DataFrame, dense_: DataFrame, k: int = 60, overlap: float | None = 0.25) -> DataFrame:
    """Reciprocal ranks: the larger plus `overlap` times the smaller, or with None their plain sum."""
    a, b = (F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0)) for c in ("lex_rank", "den_rank"))
    score = a + b if overlap is None else F.greatest(a, b) + overlap * F.least(a, b)
    rows = _both(lexical, dense_).select("query_id", "doc_id", F.round(score, 8).alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


def vigilance(events: DataFrame, queries: DataFrame, channels: dict[str, float], k: int = 10, weights: dict[str, float] | None = None, exact: str | None = None) -> DataFrame:
    """Events whose match sum(min(q, w)) / sum(abs(q)) reaches every channel's threshold, best mean match first.

    weights make the mean of channels a weighted one; `exact` names a channel whose first numbers must be equal to 1e-10.
    Exact: parts of the events meet parts of the queries in groups of a bounded size, and a group sends on a query's best k,
    with all that rounding may move there or over a threshold; of equal matches the k least ids are enough. Events of the
    usual kind (numbers of one length, none less than 0) are compared in single precision with a slack for its error, and
    what is left is worked out in double precision, as all others are at once.
    """
    names, share = list(channels), weights or dict.fromkeys(channels, 1.0)
    whole = sum(share.values())

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        w, q = {c: _matrix(left[c]) for c in names}, {c: _matrix(right[f"q_{c}"]) for c in names}
        place = np.unique(np.asarray(left["doc_id"].to_pylist(), dtype=object if pa.types.is_string(left["doc_id"].type) else None), return_inverse=True)[1]
        sizes = {c: [np.where(gap, np.nan, _in_order(np.where(np.arange(x.shape[1]) < length[:, None], np.abs(x), 0.0))) for x, length, gap in (w[c], q[c])] for c in names}
        columns = {c: np.ascontiguousarray(w[c][0].T) for c in names}
        first = lambda x: x[:, 0] if x.shape[1] else np.full(len(x), np.nan)
        out = [pa.table({"query_id": right["query_id"].slice(0, 0), "doc_id": left["doc_id"].slice(0, 0), **{f"m_{c}": pa.array([], pa.float64()) for c in names}})]
        n, usual = len(place), {c: _usual(w[c][1]) for c in names}
        clean, q_clean = np.ones(n, bool), np.ones(len(right), bool)
        for c in names:
            for side, x, (numbers, length, gap) in ((0, clean, w[c]), (1, q_clean, q[c])):
                inside = numbers[:, : usual[c]] if usual[c] <= numbers.shape[1] else np.full((len(x), 1), np.nan)
                x &= ~gap & (length == usual[c]) & ((inside >= 0) & (inside < 1e30)).all(axis=1) & ((sizes[c][side] > 1e-20) if side else True)
        plain = {c: np.ascontiguousarray(w[c][0][clean, : usual[c]].T.astype(np.float32)) for c in names}

        def slow(part: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Scores of events for queries and which are sure, in double precision, for numbers of any kind."""
            may = sure = np.ones((len(part), len(here)), bool)
            mean = 0.0
            for c, least in channels.items():
                given, size = q[c][0][part], sizes[c][1][part, None]
                total = np.zeros(may.shape)
                for j in range(max(len(columns[c]), given.shape[1])):
                    a, b = given[:, j, None] if j < given.shape[1] else np.nan, columns[c][j][here] if j < len(columns[c]) else np.nan
                    beyond = (j >= q[c][1][part, None]) & (j >= w[c][1][here])  # neither has a number there
                    total += np.where(beyond, 0.0, np.fmin(a, b))
                with np.errstate(invalid="ignore", divide="ignore"):
                    m = np.where(size == 0, (sizes[c][0][here] == 0) * 1.0, total / size)
                nan = np.isnan(m) & ~q[c][2][part, None]  # NaN is above all numbers, what a null leaves unknown is no match
                may, sure = may & (nan | (m >= least - 1e-6)), sure & (nan | (m >= least + 1e-6))
                mean = mean + share[c] / whole * m
            return np.where(may, np.where(np.isnan(mean), 1e30, mean), -np.inf), sure

        def fast(part: np.ndarray, cols: slice) -> tuple[np.ndarray, np.ndarray]:
            may = sure = True
            mean = 0.0
            for c, least in channels.items():
                given, held = q[c][0][part, : usual[c]].astype(np.float32), plain[c][:, cols]
                total, less = np.zeros((len(part), held.shape[1]), np.float32), np.empty((len(part), held.shape[1]), np.float32)
                for j in range(usual[c]):
                    np.add(total, np.minimum(given[:, j, None], held[j], out=less), out=total)
                total *= (1 / sizes[c][1][part, None]).astype(np.float32)
                error = 2e-6 + 1.2e-7 * (usual[c] + 4)
                may, sure = may & (total >= np.float32(least - error)), sure & (total >= np.float32(least + error))
                total *= np.float32(share[c] / whole)
                mean = mean + total
            return np.where(may, mean, np.float32(-np.inf)), sure

        def matches(c: str, mine: np.ndarray, at: np.ndarray) -> np.ndarray:
            """The match of pairs in one channel, added from left to right."""
            total = np.zeros(len(mine))
            for j in range(max(w[c][0].shape[1], q[c][0].shape[1])):
                a, b = q[c][0][mine, j] if j < q[c][0].shape[1] else np.nan, w[c][0][at, j] if j < w[c][0].shape[1] else np.nan
                total += np.where((j >= q[c][1][mine]) & (j >= w[c][1][at]), 0.0, np.fmin(a, b))
            with np.errstate(invalid="ignore", divide="ignore"):
                return np.where(sizes[c][1][mine] == 0, (sizes[c][0][at] == 0) * 1.0, total / sizes[c][1][mine])

        widest = max(usual.values(), default=0)
        slack = 2 * (3e-6 + 1.2e-7 * (widest + 8)) * sum(abs(share[c] / whole) for c in names)
        for some, there, quick in ((np.flatnonzero(q_clean), np.flatnonzero(clean), True), (np.flatnonzero(q_clean), np.flatnonzero(~clean), False), (np.flatnonzero(~q_clean), np.arange(n), False)):
            for lo in range(0, len(some) if len(there) else 0, AT_ONCE):
                part = some[lo : lo + AT_ONCE]

                def scored(cols: slice, part: np.ndarray = part, there: np.ndarray = there, quick: bool = quick) -> tuple[np.ndarray, np.ndarray]:
                    score, sure = fast(part, cols) if quick else slow(part, there[cols])
                    if exact is not None:
                        with np.errstate(invalid="ignore"):
                            near = np.abs(first(q[exact][0])[part, None] - first(w[exact][0])[there[cols]]) < 1e-10
                        score, sure = np.where(near, score, -np.inf), sure & near
                    return score, sure

                row, at = _leads(len(part), len(there), k, slack, scored)
                mine, at = part[row], there[at]
                values = [matches(c, mine, at) for c in names]
                keep = _least_of_alike(row, values, place[at], k)
                out.append(pa.table({"query_id": right["query_id"].take(pa.array(mine[keep])), "doc_id": left["doc_id"].take(pa.array(at[keep])), **{f"m_{c}": x[keep] for c, x in zip(names, values)}}))
        return pa.concat_tables(out)

    some = events.select("doc_id", *names).where(" and ".join(f"`{c}` is not null" for c in names))
    asked = queries.select("query_id", *[f"q_{c}" for c in names]).where(" and ".join(f"`q_{c}` is not null" for c in names))
    kind, to = (x.schema[c].dataType.simpleString() for x, c in ((asked, "query_id"), (some, "doc_id")))
    scored = _met(some, asked, find, f"query_id {kind}, doc_id {to}, " + ", ".join(f"m_{c} double" for c in names))
    scored = scored.withColumns({f"m_{c}": F.round(f"m_{c}", 6) for c in names})
    for c, least in channels.items():
        scored = scored.where(F.col(f"m_{c}") >= least)
    mean = sum((share[c] * F.col(f"m_{c}") for c in names), F.lit(0.0)) / whole
    return top(scored.select("query_id", "doc_id", F.round(mean, 7).alias("score")), k, ["query_id"], [F.desc("score"), F.col("doc_id")])


def diversified(candidates: DataFrame, budget: int, relevance: float = 0.7) -> DataFrame:
    """Greedy picks per question from (query_id, doc_id, score, rank, terms): relevance against likeness to what is chosen.

    Rows marked `chosen`, where there is such a column, are picked already, by rank. One question's candidates (at most its
    top k) form a group; everything before is native.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        given = rows["chosen"] if "chosen" in rows else rows["rank"] < 0
        rows = rows.assign(late=~given).sort_values(["late", "rank"]).reset_index(drop=True)
        scores = rows["score"][rows["late"]]
        low, high = scores.min(), scores.max()
        rel = (rows["score"] - low) / (high - low) if high > low else rows["score"] * 0 + 1.0
        n = int(len(rows) - rows["late"].sum())
        sets, left, chosen = [set(t) for t in rows["terms"]], list(range(n, len(rows))), list(range(min(n, budget)))
        while left and len(chosen) < budget:
            new = {i: 1 - max((len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for j in chosen), default=0.0) for i in left}
            best = max(left, key=lambda i: (round(relevance * rel[i] + (1 - relevance) * new[i], 9), rel[i], new[i], -rows["rank"][i]))
            chosen.append(best)
            left.remove(best)
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "doc_id": rows["doc_id"].iloc[chosen].to_numpy(), "pick": range(1, len(chosen) + 1)})

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id long, doc_id long, pick int")


def anchor_scopes(entities: DataFrame, scopes: DataFrame, types: tuple[str, ...] = ("speaker", "entity")) -> DataFrame:
    """query_id, scope_type, alias, scope_id: the scopes that a question's entities (query_id, entity) name.

    A speaker's name counts as named if an entity is the name, starts with it or holds it as whole words; then the
    speaker's scope and those of the given types with the same name are anchors, the least id of each type and name.
    Names are compared in lower case with other characters than letters and digits as one space. Whole words inside a
    name are runs of its words, so the comparison is an equi-join on runs and never on all pairs. Null and empty names
    match nothing.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^\\p{L}\\p{N}]+", " "))
    named = scopes.select("scope_id", "scope_type", plain("value").alias("alias")).where("alias <> ''")
    words = F.split("name", " ")
    runs = F.expr("flatten(transform(sequence(1, size(w)), i -> transform(sequence(1, size(w) - i + 1), n -> array_join(slice(w, i, n), ' '))))")
    said = entities.select("query_id", plain("entity").alias("name")).where("name <> ''").distinct().withColumn("w", words)
    met = said.select("query_id", F.explode(runs).alias("alias")).distinct()
    speakers = named.where("scope_type = 'speaker'").select("alias").distinct()
    mentioned = met.join(speakers, "alias", "left_semi")
    # the least id of each type and name is found before questions meet it: a name that many scopes share is one row
    least = named.where(F.col("scope_type").isin(*types)).groupBy("scope_type", "alias").agg(F.min("scope_id").alias("scope_id"))
    return mentioned.join(least, "alias").select("query_id", "scope_type", "alias", "scope_id")
