"""Approximate nearest neighbours by low-dimensional stable projections, a kd-tree over them, and a chi-square stop.

Unit vectors are projected by a Gaussian matrix to M numbers. For a neighbour at distance d, its projected squared
distance over d squared follows a chi-square law with M degrees of freedom. A search takes neighbours in the order of
their projected distance, verifies each on the original vectors, and stops when the chi-square mass below (next
projected distance / k-th best true distance) squared reaches `sure`: then each true neighbour is missed with a
probability of at most 1 - sure.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

M = 8
LEAF = 64


def _projection(dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(1000 + dim)).standard_normal((dim, M))


def _mass(x: np.ndarray) -> np.ndarray:
    """Chi-square distribution function with M (even) degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, M // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def _quantile(p: float) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _mass(np.float64(mid)) < p else (lo, mid)
    return hi


def _matrix(column) -> np.ndarray:
    """Vectors as rows, each moved by a power of two so that its largest component is near 1: cosines stay exactly as they
    are, and squares of very large or very small components neither overflow nor vanish."""
    x = np.array(column.tolist(), np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _project(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))) @ _projection(x.shape[1])


def _split(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Inner nodes of a kd-tree of 2 ** depth cells in heap order: (axis, cut)."""
    nodes: list[tuple[int, float]] = []
    level = [points]
    for _ in range(depth):
        below = []
        for p in level:
            axis = int(np.argmax(p.std(axis=0))) if len(p) else 0
            at = float(np.median(p[:, axis])) if len(p) else 0.0
            nodes.append((axis, at))
            below += [p[p[:, axis] <= at], p[p[:, axis] > at]] if len(p) else [p, p]
        level = below
    return nodes


def _cell(points: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    axes, cuts = np.array([n[0] for n in nodes], np.int64), np.array([n[1] for n in nodes])
    while len(nodes) and (inner := at < len(nodes)).any():
        i = np.flatnonzero(inner)
        at[i] = 2 * at[i] + 1 + (points[i, axes[at[i]]] > cuts[at[i]])
    return at - len(nodes)


def _boxes(nodes: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = [np.full(M, -np.inf)], [np.full(M, np.inf)]
    for i, (axis, at) in enumerate(nodes):
        left, right = hi[i].copy(), lo[i].copy()
        left[axis], right[axis] = min(left[axis], at), max(right[axis], at)
        lo += [lo[i], right]
        hi += [left, hi[i]]
    return np.array(lo[len(nodes) :]), np.array(hi[len(nodes) :])


def _leaves(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's own kd-tree: order of points, first point, and box of each leaf."""
    parts, todo = [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            parts.append(at)
            continue
        axis = int(np.argmax(points[at].std(axis=0)))
        half = len(at) // 2
        at = at[np.argpartition(points[at, axis], half)]
        todo += [at[half:], at[:half]]
    heads = np.cumsum([0] + [len(p) for p in parts])
    return np.concatenate(parts), heads, np.array([points[p].min(axis=0) for p in parts]), np.array([points[p].max(axis=0) for p in parts])


def _search(key, index: pd.DataFrame, asked: pd.DataFrame, need: int, far: float) -> pd.DataFrame:
    """The best vectors of one block for each query sent to it."""
    empty = pd.DataFrame({"q": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "first": pd.Series(dtype="int64"), "times": pd.Series(dtype="int32")})
    if not len(index) or not len(asked):
        return empty
    x, low = _matrix(index["embedding"]), _project(_matrix(index["embedding"]))
    norm, times, first = np.sqrt((x * x).sum(axis=1)), index["times"].to_numpy(), index["first"].to_numpy()
    order, heads, lo, hi = _leaves(low)
    y = _matrix(asked["embedding"])
    y_low, y_norm, limit = _project(y), np.sqrt((y * y).sum(axis=1)), asked["bound"].to_numpy()
    out = []
    for i in range(len(y)):
        edge = (np.maximum(0, np.maximum(lo - y_low[i], y_low[i] - hi)) ** 2).sum(axis=1)
        walk = np.argsort(edge, kind="stable")
        d2 = limit[i] if limit[i] >= 0 else np.inf
        got, score = np.zeros(0, np.int64), np.zeros(0)
        wait, wait_d = np.zeros(0, np.int64), np.zeros(0)
        step = 0
        while step < len(walk) or len(wait):
            # open leaves until the nearest waiting point is surely the next projected neighbour
            if step < len(walk) and (not len(wait) or edge[walk[step]] <= wait_d.min()):
                opened = np.concatenate([order[heads[w] : heads[w + 1]] for w in walk[step : step + 4]])
                step += 4
                wait = np.concatenate((wait, opened))
                wait_d = np.concatenate((wait_d, ((low[opened] - y_low[i]) ** 2).sum(axis=1)))
            upto = edge[walk[step]] if step < len(walk) else np.inf
            stop = far * d2 + 1e-9
            if wait_d.min(initial=upto) > stop:
                break
            now = wait_d <= min(upto, stop)
            if now.any():
                at = wait[now]
                wait, wait_d = wait[~now], wait_d[~now]
                got = np.concatenate((got, at))
                score = np.concatenate((score, (x[at] * y[i]).sum(axis=1) / (norm[at] * y_norm[i])))
                best = np.lexsort((first[got], -score))
                enough = np.searchsorted(np.cumsum(times[got[best]]), need)
                if enough < len(best):
                    best = best[: max(need, enough + 1)]
                    d2 = min(d2, max(0.0, 2 - 2 * score[best[enough]]))
                got, score = got[best], score[best]
            elif upto > stop:
                break
        if len(got):
            out.append(pd.DataFrame({"q": np.full(len(got), asked["v"].iloc[i]), "v": index["v"].to_numpy()[got], "score": score, "first": first[got], "times": times[got]}))
    return pd.concat(out) if out else empty


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", sure: float = 0.98, fit_rows: int = 20_000, block_rows: int = 4096, cells_most: int = 1024
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors by cosine of each row of `queries`, which are rows of vectors.

    Scores are exact double-precision cosines of the original vectors; ties go to the smaller id; a query is not its own
    neighbour; all candidates are returned where there are fewer than k. Null ids, and vectors that are null, empty,
    zero, or hold a null or non-finite component, take no part. Vectors of another length are never compared.

    Equal vectors meet in one representative with its k + 1 least ids (a rank limit that Spark applies before the
    shuffle), so a very common vector costs one point. Every representative is indexed. The upper kd-tree's cuts come from
    at most `fit_rows` vectors (by hash), and it has at most `cells_most` cells. A query searches its own cell first;
    then only the cells whose box passes the stopping test. Blocks are bounded: cells over `block_rows` vectors are dealt
    over several, and queries to one cell come in groups of `block_rows`.
    """
    need = k + 1
    good = F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("e", lambda x: x != 0)
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("e")).where(F.col("id").isNotNull() & good).withColumn("v", F.xxhash64("e"))
    few = clean(vectors).withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= need)
    points = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("e").alias("embedding")).withColumn("dim", F.size("embedding"))
    points = cut(points.withColumn("first", F.element_at("ids", 1)).withColumn("times", F.size("ids")))
    sent = cut(clean(queries).select(F.col("id").alias("query_id"), "v"))
    far = _quantile(sure)
    rows = {r["dim"]: r["n"] for r in points.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(100).collect()}
    trees = {}
    for dim, n in rows.items():
        depth = min(int(np.log2(cells_most)), max(0, int(np.ceil(np.log2(n / block_rows)))))
        sample = points.where(F.col("dim") == dim).orderBy(F.xxhash64("v")).limit(fit_rows).select("embedding").toPandas() if depth else None
        trees[dim] = _split(_project(_matrix(sample["embedding"])), depth) if depth else []

    def home(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            pdf["cell"] = 0
            for dim, at in pdf.groupby("dim").groups.items():
                pdf.loc[at, "cell"] = _cell(_project(_matrix(pdf.loc[at, "embedding"])), trees.get(dim, []))
            yield pdf

    placed = cut(points.mapInPandas(home, "v long, ids array<long>, embedding array<double>, dim int, first long, times int, cell long"))
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("salts"))
    asked = placed.join(sent.select("v").distinct(), "v", "left_semi").select("v", "embedding", "dim", "cell").withColumn("bound", F.lit(-1.0))

    def visit(wanted: DataFrame) -> DataFrame:
        groups = wanted.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("groups"))
        plan = sizes.join(groups, ["dim", "cell"])
        index = placed.drop("ids").join(plan, ["dim", "cell"]).withColumn("salt", F.expr("cast(pmod(v, salts) as int)")).withColumn("part", F.explode(F.expr("sequence(0, groups - 1)")))
        query = wanted.join(plan, ["dim", "cell"]).withColumn("part", F.expr("cast(pmod(xxhash64(v), groups) as int)")).withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)")))
        keys = ["dim", "cell", "salt", "part"]
        index, query = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (index, query))
        found = index.groupBy(*keys).cogroup(query.groupBy(*keys)).applyInPandas(lambda key, a, b: _search(key, a, b, need, far), "q long, v long, score double, first long, times int")
        return cut(found)

    near = visit(asked)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "first")
    reached = near.withColumn("sum", F.sum("times").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("sum") >= need)
    bound = reached.groupBy("q").agg(F.max("score").alias("s")).select(F.col("q").alias("v"), F.greatest(F.lit(0.0), 2 - 2 * F.col("s")).alias("bound"))
    open_ = asked.drop("bound").join(bound, "v", "left")
    boxes = {dim: _boxes(nodes) for dim, nodes in trees.items()}

    def others(batches):
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                if dim not in boxes or len(boxes[dim][0]) < 2:
                    continue
                lo, hi = boxes[dim]
                low = _project(_matrix(own["embedding"]))
                for at in range(0, len(own), 256):
                    p, rows_ = low[at : at + 256], own.iloc[at : at + 256]
                    edge = (np.maximum(0, np.maximum(lo[None] - p[:, None], p[:, None] - hi[None])) ** 2).sum(axis=2)
                    reach = np.where(rows_["bound"].isna(), np.inf, far * rows_["bound"].to_numpy() + 1e-9)
                    i, c = np.nonzero((edge <= reach[:, None]) & (np.arange(len(lo))[None] != rows_["cell"].to_numpy()[:, None]))
                    if len(i):
                        far_rows = rows_.iloc[i].assign(cell=c)
                        yield far_rows.assign(bound=far_rows["bound"].fillna(-1.0))[["v", "embedding", "dim", "cell", "bound"]]

    more = cut(open_.select("v", "embedding", "dim", "cell", "bound").mapInPandas(others, "v long, embedding array<double>, dim int, cell long, bound double"))
    found = near.unionByName(visit(more)).withColumn("r", F.row_number().over(order)).where(F.col("r") <= need)
    listed = found.join(placed.select("v", "ids"), "v").select(F.col("q"), F.explode("ids").alias("vec_id"), "score")
    ranked = sent.join(listed, F.col("v") == F.col("q")).where("query_id <> vec_id").dropDuplicates(["query_id", "vec_id"])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
