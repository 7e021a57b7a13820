"""LM scoring by masked pseudo-likelihood: a window network predicts each token from both sides, trained in numpy.

The network: embeddings of the two tokens before and the two after, one tanh layer, and a two-level softmax (group of the
outcome, then the outcome in its group). Outcomes are the HEAD commonest words and, for every other word, the class of its
ending; a word's probability within its class comes from the table of all words and their counts, which grows with the
corpus, with a share kept back for words spelled byte by byte, so that no two words fall to one unknown id. As context,
other words are the sum of two rows, by ending and by whole word. Training is data-parallel: documents are dealt to
shards by a hash of their id and text, about SHARD tokens each; a shard is one pass from the same weights over its
documents in the order of that hash; weights are averaged by token count, and the next round starts from the average. The
rounds share all documents out among them: each token is predicted in one round. Nothing hangs on how rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, slices, spans, words

SIDE = (-2, -1, 1, 2)
CLASSES = 32
VOCAB = CLASSES * CLASSES
REST = 64  # classes of the words that are not among the commonest
HEAD = VOCAB - REST
PIECES = 1024  # rows for endings, and as many for whole words, that make up the context of a rarer word
DIM, HIDDEN = 16, 32
SHAPES = {"e": (VOCAB + 1 + 2 * PIECES, DIM), "w": (len(SIDE) * DIM, HIDDEN), "b": (HIDDEN,), "c": (HIDDEN, CLASSES), "d": (CLASSES,), "u": (CLASSES, HIDDEN, CLASSES), "v": (CLASSES, CLASSES)}
HELD = 0.5  # taken from each word's count and given to spelling
HOT = 1 << 16  # commonest words of the table that tasks hold; the others are joined
BYTES = 257  # byte values and the edge of a word
SHARD = 2_000_000  # tokens that one pass takes one after another


def _fresh() -> dict[str, np.ndarray]:
    g = np.random.Generator(np.random.PCG64(77))
    scale = {"e": 0.3, "w": (len(SIDE) * DIM) ** -0.5, "c": 0.05, "u": 0.05}
    return {k: (g.standard_normal(s) * scale.get(k, 0.0)).astype(np.float32) for k, s in SHAPES.items()}


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES]).astype(np.float64)


def _shaped(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


class Words(NamedTuple):
    """The words of some texts in order, and the same with two pads around each text."""

    hashed: np.ndarray
    row: np.ndarray  # text of each word
    head: np.ndarray  # id below HEAD, or -1
    kind: np.ndarray  # outcome: head id, or HEAD + class
    at: np.ndarray  # place of each word in own and other
    own: np.ndarray  # context row (VOCAB for pads)
    other: np.ndarray  # second context row, or -1
    data: np.ndarray
    first: np.ndarray
    end: np.ndarray


def _bytes(text: pa.Array) -> np.ndarray:
    text = text.cast(pa.large_string())
    bounds = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    return np.frombuffer(text.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]


def _found(sorted_: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Place of each hash in sorted_, or -1."""
    if not len(sorted_):
        return np.full(len(hashed), -1, np.int64)
    i = np.minimum(np.searchsorted(sorted_, hashed), len(sorted_) - 1)
    return np.where(sorted_[i] == hashed, i, -1)


def _endings(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class by the last two bytes, piece by the last three)."""
    tail = [np.where(end - j >= first, data[np.maximum(end - j, 0)], 0).astype(np.uint64) for j in (1, 2, 3)] if len(first) else [np.zeros(0, np.uint64)] * 3
    two = tail[0] | tail[1] << np.uint64(8)
    return (mix(two) % np.uint64(REST)).astype(np.int64), (mix(two | tail[2] << np.uint64(16)) % np.uint64(PIECES)).astype(np.int64)


def _words(text: pa.Array, heads: np.ndarray) -> Words:
    hashed, row, first, end = words(text)
    data = _bytes(text)
    head = _found(heads, hashed)
    class_, piece = _endings(data, first, end)
    rare = head < 0
    at = np.arange(len(row)) + 2 + 2 * row
    own, other = np.full(len(row) + 2 * len(text) + 2, VOCAB, np.int32), np.full(len(row) + 2 * len(text) + 2, -1, np.int32)
    own[at] = np.where(rare, VOCAB + 1 + piece, head)
    other[at] = np.where(rare, VOCAB + 1 + PIECES + (hashed % np.uint64(PIECES)).astype(np.int64), -1)
    return Words(hashed, row, head, np.where(rare, HEAD + class_, head), at, own, other, data, first, end)


def _context(w: dict[str, np.ndarray], t: Words, here: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(input of the network, context rows, second rows) of the words `here`."""
    near = t.at[here][:, None] + np.array(SIDE)
    own, other = t.own.take(near).ravel(), t.other.take(near).ravel()
    x = w["e"].take(own, axis=0)
    two = np.flatnonzero(other >= 0)
    x[two] += w["e"].take(other[two], axis=0)
    return x.reshape(len(here), -1), own, other


def _pairs(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(successive bytes of each word as numbers, the first of them per word, last byte and edge)."""
    size = end - first
    heads = np.cumsum(size) - size
    cur = data[np.repeat(first - heads, size) + np.arange(size.sum())].astype(np.int64)
    prev = np.concatenate(([BYTES - 1], cur[:-1]))
    prev[heads] = BYTES - 1
    return prev * BYTES + cur, heads, cur[heads + size - 1] * BYTES + BYTES - 1


def _spelled(t: np.ndarray, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Log-probability of each word byte by byte."""
    if not len(first):
        return np.zeros(0)
    inner, heads, last = _pairs(data, first, end)
    return np.add.reduceat(t[inner], heads) + t[last]


def _small(m: np.ndarray, b: np.ndarray) -> bool:
    """Whether no output of a layer on tanh values can overflow exp; then rows need not be moved by their largest value."""
    return float((np.abs(m).sum(axis=-2) + np.abs(b)).max()) < 60


def _row_sums(m: np.ndarray) -> np.ndarray:
    return m @ np.ones(m.shape[1], m.dtype)


def _sums(m: np.ndarray) -> np.ndarray:
    return np.ones(len(m), m.dtype) @ m


def _softmax(z: np.ndarray, small: bool = False) -> np.ndarray:
    z = np.exp(z if small else z - z.max(axis=1, keepdims=True))
    z /= _row_sums(z)[:, None]
    return z


def _log_chosen(z: np.ndarray, at: np.ndarray, small: bool = False) -> np.ndarray:
    """Log of the softmax of each row of z, at one place of the row."""
    if not small:
        z = z - z.max(axis=1, keepdims=True)
    return z[np.arange(len(z)), at] - np.log(_row_sums(np.exp(z)))


def _sum_rows(rows: np.ndarray, values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """n rows of sums: values[of[i]] is added to row rows[i]."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    rows = rows[order]
    heads = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    out[rows[heads]] = np.add.reduceat(values.take(of[order], axis=0), heads, axis=0)
    return out


def _by_group(t: Words, here: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, slice]]]:
    """(the words `here` sorted by the group of their outcomes, group, place in the group, run of each group that stands)."""
    kind = t.kind[here].astype(np.int16)
    here = here[np.argsort((kind % CLASSES).astype(np.uint8), kind="stable")]
    kind = t.kind[here]
    group = kind % CLASSES
    ends = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
    return here, group, kind // CLASSES, [(c, slice(a, b)) for c, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]


def log_probs(w: dict[str, np.ndarray], t: Words) -> np.ndarray:
    """Log-probability of each word's outcome given its window."""
    out = np.zeros(len(t.row), np.float32)
    outer, inner = _small(w["c"], w["d"]), _small(w["u"], w["v"])
    for lo in range(0, len(out), 16384):
        here, group, place, runs = _by_group(t, np.arange(lo, min(lo + 16384, len(out))))
        h = np.tanh(_context(w, t, here)[0] @ w["w"] + w["b"])
        p = _log_chosen(h @ w["c"] + w["d"], group, outer)
        for c, i in runs:
            p[i] += _log_chosen(h[i] @ w["u"][c] + w["v"][c], place[i], inner)
        out[here] = p
    return out


def gradient(w: dict[str, np.ndarray], t: Words, here: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log-probability of the words `here`, by each weight."""
    n = len(here)
    here, group, place, runs = _by_group(t, here)
    x, own, other = _context(w, t, here)
    h = np.tanh(x @ w["w"] + w["b"])
    g = {}
    dz = _softmax(h @ w["c"] + w["d"], _small(w["c"], w["d"]))
    dz[np.arange(n), group] -= 1
    dz /= n
    g["c"], g["d"] = h.T @ dz, _sums(dz)
    dh = dz @ w["c"].T
    g["u"], g["v"] = np.zeros_like(w["u"]), np.zeros_like(w["v"])
    inner = _small(w["u"], w["v"])
    for c, i in runs:
        q = _softmax(h[i] @ w["u"][c] + w["v"][c], inner)
        q[np.arange(len(q)), place[i]] -= 1
        q /= n
        g["u"][c], g["v"][c] = h[i].T @ q, _sums(q)
        dh[i] += q @ w["u"][c].T
    da = dh * (1 - h * h)
    g["w"], g["b"] = x.T @ da, _sums(da)
    dx = (da @ w["w"].T).reshape(n * len(SIDE), DIM)
    two = np.flatnonzero(other >= 0)
    g["e"] = _sum_rows(np.concatenate((own, other[two])), dx, np.concatenate((np.arange(len(own)), two)), len(w["e"]))
    return g


def _train(w: dict[str, np.ndarray], seen: dict[str, np.ndarray], t: Words, done: int = 0, rate: float = 0.08) -> None:
    """Adagrad steps over all words, larger ones as more words are done; w and seen (squared gradients) change in place."""
    lo, n = 0, len(t.row)
    while lo < n:
        here = np.arange(lo, min(n, lo + min(8192, max(512, (done + lo) // 8))))
        lo += len(here)
        for k, g in gradient(w, t, here).items():
            seen[k] += g**2
            w[k] -= rate * g / (np.sqrt(seen[k]) + 1e-6)


def counted_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every word of the texts with its count: w, n. Words are counted within a batch before rows leave the task."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 23):
                data, solid, _, first, end = spans(part.column("text"))
                offsets = np.concatenate(([0], np.cumsum(end - first)))
                found = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]).dictionary_encode()
                n = np.bincount(np.asarray(found.indices), minlength=len(found.dictionary))
                yield pa.RecordBatch.from_arrays([found.dictionary.cast(pa.large_string()).cast(pa.string()), pa.array(n, pa.int64())], ["w", "n"])

    own = docs.select(F.col(text_col).alias("text")).where("text is not null")
    return cut(own.mapInArrow(tally, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")))


class Vocabulary(NamedTuple):
    """What tasks hold: hashes of the head words, totals and spelling of the others, and the commonest of the table."""

    heads: np.ndarray
    left: np.ndarray  # per class, log of the share that goes to spelling
    spelling: np.ndarray
    hot: np.ndarray
    hot_log: np.ndarray


def vocabulary(counted: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of a table of counts, and the table of all words outside the head: h (hash), n, lp (log-probability
    of the word within its class). The HEAD commonest words have outcomes of their own."""
    top = [r["w"] for r in counted.orderBy(F.desc("n"), "w").limit(HEAD).collect()]
    heads = np.sort(words(pa.array(top, pa.string()))[0])
    shared = counted.sparkSession.sparkContext.broadcast(heads)

    def rare(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        text = batch.column("w")
        hashed, row, first, end = words(text)
        i = np.flatnonzero(_found(shared.value, hashed) < 0)
        data = _bytes(text)
        return hashed[i], np.asarray(batch.column("n"))[row[i]], _endings(data, first[i], end[i])[0], data, first[i], end[i]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * REST + BYTES * BYTES, np.int64)
        for batch in batches:
            _, n, class_, data, first, end = rare(batch)
            if len(n):
                inner, _, last = _pairs(data, first, end)
                np.add.at(sums, class_, n)
                sums += np.bincount(np.concatenate((class_ + REST, inner + 2 * REST, last + 2 * REST)), minlength=len(sums))
        i = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(sums[i])], ["i", "x"])

    got = counted.mapInArrow(add, "i int, x long").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    sums = np.zeros(2 * REST + BYTES * BYTES)
    sums[got["i"].to_numpy(np.int64)] = got["x"].to_numpy(float)
    total, kinds = sums[:REST], sums[REST : 2 * REST]
    pairs = sums[2 * REST :].reshape(BYTES, BYTES) + 0.01
    spelling = np.log(pairs / pairs.sum(axis=1, keepdims=True)).ravel()
    # A class without words leaves all to spelling.
    left = np.log(np.where(total > 0, HELD * kinds / np.maximum(total, 1), 1.0))
    told = counted.sparkSession.sparkContext.broadcast((total, left, spelling))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, left, spelling = told.value
        for batch in batches:
            hashed, n, class_, data, first, end = rare(batch)
            lp = np.logaddexp(np.log((n - HELD) / total[class_]), left[class_] + _spelled(spelling, data, first, end))
            yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)), pa.array(n), pa.array(lp)], ["h", "n", "lp"])

    others = cut(counted.mapInArrow(weigh, "h long, n long, lp double"))
    hot = others.orderBy(F.desc("n"), "h").limit(HOT).toPandas()
    keys = hot["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Vocabulary(heads, left, spelling, keys[order], hot["lp"].to_numpy(float)[order]), others


def train(docs: DataFrame, known: Vocabulary, n_tokens: int, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> np.ndarray:
    """Weights after `rounds` rounds that share all documents of n_tokens tokens. The driver holds one model, about 85,000
    numbers; a task adds up its shards and sends one. A shard is read from start to end and never held."""
    shards = max(1, -(-n_tokens // (SHARD * rounds)))
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    own = docs.where(F.col(text_col).isNotNull()).select(key.alias("k"), F.col(text_col).alias("text")).withColumn("round", F.expr(f"pmod(k, {rounds})")).withColumn("shard", F.expr(f"pmod(shiftright(k, 8), {shards})"))
    flat = _flat(_fresh())
    for round_ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast((known.heads, flat))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            heads, start = shared.value
            total, every, done, now = np.zeros(len(start)), 0, 0, None
            w, seen = {}, {}
            for batch in batches:
                for part in slices(batch, "text"):
                    shard = np.asarray(part.column("shard"))
                    for lo, hi in zip(edges := np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))), [*edges[1:], len(shard)]):
                        if shard[lo] != now:
                            if done:
                                total, every = total + _flat(w) * done, every + done
                            now, done, w, seen = shard[lo], 0, _shaped(start), {k: np.full(s, 0.01, np.float32) for k, s in SHAPES.items()}
                        t = _words(part.column("text").slice(lo, hi - lo), heads)
                        _train(w, seen, t, done)
                        done += len(t.row)
            if done:
                total, every = total + _flat(w) * done, every + done
            if every:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(start)), pa.int32()), pa.array(total), pa.array(np.full(len(start), every), pa.int64())], ["i", "x", "n"])

        dealt = own.where(F.col("round") == round_).repartition(4 * shards, "shard").sortWithinPartitions("shard", "k", "text")
        rows = dealt.select("shard", "text").mapInArrow(run, "i int, x double, n long").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).toPandas()
        if len(rows):
            flat = rows.sort_values("i")["x"].to_numpy()
    return flat


def score(docs: DataFrame, known: Vocabulary, others: DataFrame, flat: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_tokens, log_prob (sum over all tokens) and mean_log_prob (null without tokens). Words that
    tasks do not hold are joined to the table `others`; what is in no table is spelled."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((known, flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = shared.value[0], _shaped(shared.value[1])
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                t = _words(part.column("text"), v.heads)
                lp = log_probs(w, t).astype(np.float64)
                rare = np.flatnonzero(t.head < 0)
                hot = _found(v.hot, t.hashed[rare])
                lp[rare[hot >= 0]] += v.hot_log[hot[hot >= 0]]
                total = np.bincount(t.row, weights=lp, minlength=n)
                cold = rare[hot < 0]
                bare = v.left[t.kind[cold] - HEAD] + _spelled(v.spelling, t.data, t.first[cold], t.end[cold])
                bounds = np.searchsorted(t.row[cold], np.arange(n + 1))
                far = pa.StructArray.from_arrays([pa.array(t.hashed[cold].view(np.int64)), pa.array(bare.astype(np.float32))], ["h", "bare"])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.bincount(t.row, minlength=n), pa.int64()), pa.array(total), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), far)], ["id", "n_tokens", "log_prob", "far"])

    schema = own.select("id").withColumns({"n_tokens": F.lit(0).cast("long"), "log_prob": F.lit(0.0), "far": F.lit(None).cast("array<struct<h: bigint, bare: float>>")}).schema
    near = cut(own.mapInArrow(run, schema).withColumn("k", F.monotonically_increasing_id()))
    far = near.select("k", F.inline("far")).join(others.select("h", "lp"), "h", "left")
    sums = far.groupBy("k").agg(F.sum(F.coalesce("lp", F.col("bare").cast("double"))).alias("more"))
    whole = near.select("k", "id", "n_tokens", "log_prob").join(sums, "k", "left")
    log_prob = F.col("log_prob") + F.coalesce("more", F.lit(0.0))
    return whole.select(F.col("id").alias(id_col), "n_tokens", log_prob.alias("log_prob"), F.when(F.col("n_tokens") > 0, log_prob / F.col("n_tokens")).alias("mean_log_prob"))


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """score of docs under a network and a table of words made from docs. Words are split at ASCII white space, in counts,
    training and scores alike; null and empty texts have no tokens, log_prob 0 and a null mean; a null id stays null; rows
    that repeat are counted and scored each; very long texts are read in one piece; extra columns are not read, whatever
    their names; an empty table gives no rows.
    """
    counted = counted_words(docs, text_col)
    known, others = vocabulary(counted)
    n_tokens = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return score(docs, known, others, train(docs, known, n_tokens, id_col, text_col, rounds), id_col, text_col)
