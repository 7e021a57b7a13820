"""Language ID by prediction by partial matching: a context tree of bytes for each language, and exact code lengths.

The tree of a language holds, for every context of up to `order` bytes, which bytes follow it and how often. A byte that a
context of n bytes, q of them different, has seen m times gets m / (n + q); all others share the escape q / (n + q) as
the next shorter context deals it out among bytes that this one has not seen (exclusion), down to all 256 alike. So each
language's probabilities of the next byte add up to one, and a text's code length is the sum of their logarithms. The
language with the shortest code is the answer. Statistics are frozen: a text does not change the tree that codes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

#: Bytes of context, and nodes of all trees together at most: the most frequent, by a threshold on counts.
ORDER, MOST_NODES = 3, 1_000_000
#: Bytes that are coded at once, and bytes of text that share them.
STEP, SLICE = 1 << 21, 4 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def folded(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds): what is coded of each text: ASCII letters in lower case, one space for any run of other ASCII
    characters (none at the start), all other bytes as they are, but U+00C0 to U+00DE in lower case."""
    text = text.cast(pa.large_string())
    n = len(text)
    bounds = np.frombuffer(text.buffers()[1], np.int64, n + 1, text.offset * 8)
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    data = _FOLD[raw]
    after = np.flatnonzero(raw[:-1] == 0xC3) + 1
    data[after[(raw[after] >= 0x80) & (raw[after] <= 0x9E) & (raw[after] != 0x97)]] += 32
    keep = data != 32
    keep[1:] |= data[:-1] != 32
    starts = bounds[:-1][bounds[:-1] < len(data)]
    keep[starts] = data[starts] != 32
    kept = np.concatenate(([0], np.cumsum(keep)))
    return data[keep], kept[bounds]


def grams(data: np.ndarray, bounds: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, gram) of every byte, in steps: the byte itself lowest, `order` bytes before it above; 0 before a text starts."""
    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    at = np.arange(len(data)) + order * (row + np.int64(1))
    spread = np.zeros(len(data) + order * len(bounds), np.uint32 if order < 4 else np.uint64)
    spread[at] = data
    for lo in range(0, len(data), STEP):
        here, first = at[lo : lo + STEP], at[lo] - order
        text = spread[first : here[-1] + 1]
        out = text[order:].copy()
        for j in range(1, order + 1):
            out |= text[order - j : len(text) - j] << (8 * j)
        yield row[lo : lo + STEP], out[here - here[0]]


def distinct(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams, and for each gram which of them it is. Grams of four bytes go by the pairs of their halves, where
    the halves that occur are few; sorting gives the same."""
    if found.dtype == np.uint32:
        high, low = found >> 16, found & 0xFFFF
        code = np.zeros(1 << 16, np.int32)
        code[high] = code[low] = 1
        halves = np.flatnonzero(code)
        n = len(halves)
        if n * n <= 1 << 24:
            code[halves] = np.arange(n)
            pair = code[high] * n + code[low]
            place = np.zeros(n * n, np.int32)
            place[pair] = 1
            some = np.flatnonzero(place)
            place[some] = np.arange(len(some))
            return (halves[some // n].astype(np.uint64) << np.uint64(16)) | halves[some % n].astype(np.uint64), place[pair]
    kinds, which = np.unique(found, return_inverse=True)
    return kinds.astype(np.uint64), which


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each slice of texts."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            names = part.column("lang").dictionary_encode()
            of = np.asarray(names.indices)
            for row, found in grams(*folded(part.column("text")), order):
                key, n = np.unique(found | (of[row].astype(np.uint64) << np.uint64(56)), return_counts=True) if len(names.dictionary) < 256 else (found, None)
                if n is None:  # so many languages that their number does not fit beside a gram
                    pairs, n = np.unique(np.stack([of[row].astype(np.uint64), found]), axis=1, return_counts=True)
                    which, gram = pairs
                else:
                    which, gram = key >> np.uint64(56), key & np.uint64((1 << 56) - 1)
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(which.astype(np.int64))).cast(pa.string()), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


class Trees:
    """Frozen context trees: per language and order the sorted nodes with the bits of their last byte, and the sorted
    contexts with the bits of an escape."""

    def __init__(self, order: int, nodes: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]):
        self.order, self.langs = order, sorted(nodes)
        self.levels = [self._tree(nodes[lang]) for lang in self.langs]

    def _tree(self, nodes: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, ...]]:
        levels: list[tuple[np.ndarray, ...]] = []
        for k in range(self.order + 1):
            gram, n = nodes.get(k, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            at = np.argsort(gram)
            gram, n = gram[at], n[at].astype(float)
            context, first, of = np.unique(gram >> np.uint64(8), return_index=True, return_inverse=True)
            kinds = np.diff(np.append(first, len(gram))).astype(float)
            whole = np.bincount(of, n, len(context)) + kinds
            if k:  # a shorter context has seen all that a longer one has
                low, bits = levels[-1][0], levels[-1][1]
                below = 2.0 ** -bits[np.searchsorted(low, gram & np.uint64((1 << 8 * k) - 1))]
            else:
                below = np.full(len(gram), 1 / 256)
            free = np.maximum(1 - np.bincount(of, below, len(context)), 2.0**-50)
            levels.append((gram, -np.log2(n / whole[of]), context, -np.log2(kinds / whole / free)))
        return levels

    def bits(self, lang: int, gram: np.ndarray) -> np.ndarray:
        """The exact code length of the last byte of each gram after the bytes before it."""
        out, left = np.zeros(len(gram)), np.arange(len(gram))
        for k in range(self.order, -1, -1):
            own, bits, contexts, escape = self.levels[lang][k]
            x = gram[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            at, seen = _find(own, x)
            out[left[seen]] += bits[at[seen]]
            left, x = left[~seen], x[~seen]
            at, seen = _find(contexts, x >> np.uint64(8))
            out[left[seen]] += escape[at[seen]]
        out[left] += 8
        return out


def _find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(where, what)
    at[at == len(where)] = 0
    return at, where[at] == what if len(where) else np.zeros(len(what), bool)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, most_nodes: int = MOST_NODES) -> Trees:
    """Trees from all rows of docs with a text and a language.

    Bytes are counted by Spark, combined before the shuffle, so a language of a third of all rows costs no task more than
    its share. Shorter contexts are sums over longer ones. What the trees keep is found from a histogram of counts: all
    nodes if there are at most `most_nodes`, else those of at least the least count that fits; only these come to the
    driver. A pruned tree is a tree again, as a longer context is never more frequent than its end.
    """
    some = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    full = cut(some.mapInArrow(lambda b: _count(b, order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    levels = full.select("lang", F.lit(order).alias("k"), "gram", "n")
    for k in range(order):
        levels = levels.unionByName(full.groupBy("lang", F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("gram")).agg(F.sum("n").alias("n")).select("lang", F.lit(k).alias("k"), "gram", "n"))
    levels = cut(levels)
    size = F.floor(16 * F.log2("n"))  # at most some hundred sizes
    counts = levels.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("size")).collect()
    total, least = 0, None
    for r in counts:
        total += r["c"]
        if total > most_nodes:
            break
        least = r["size"]
    kept = levels.where(size >= least).toArrow() if least is not None else levels.where("false").toArrow()
    lang, k = kept.column("lang").combine_chunks().dictionary_encode(), np.asarray(kept.column("k"))
    which, gram, n = np.asarray(lang.indices), np.asarray(kept.column("gram")).view(np.uint64), np.asarray(kept.column("n"))
    nodes = {name: {j: (gram[m], n[m]) for j in range(order + 1) if (m := (which == i) & (k == j)).any()} for i, name in enumerate(lang.dictionary.to_pylist())}
    return Trees(order, nodes)


def _predict(batches: Iterator[pa.RecordBatch], trees: Trees) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            total = np.zeros((part.num_rows, len(trees.langs)))
            for row, found in grams(*folded(part.column("text")), trees.order):
                kinds, which = distinct(found)
                for i in range(len(trees.langs)):
                    total[:, i] += np.bincount(row, trees.bits(i, kinds)[which], part.num_rows)
            best = total.argmin(axis=1)  # ties: the first of the languages in order
            bits = total[np.arange(len(best)), best]
            score = 1 / np.exp2(bits[:, None] - total).sum(axis=1)
            told = np.asarray(part.column("lettered"))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([trees.langs[i] if x else "und" for i, x in zip(best.tolist(), told.tolist())], pa.string()), pa.array(np.where(told, score, 0.0)), pa.array(np.where(told, bits, 0.0))], ["id", "lang_pred", "score", "bits"]
            )


def predict(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, bits) for every row of docs, from its whole text alone.

    score is the probability of the language, all being as likely beforehand; bits the code length under it. Null text,
    text without a letter and a model of no language give `und`, 0 and 0. Ties go to the language first in order.
    Rows that repeat are judged each; extra columns are not read; an empty table gives no rows.
    """
    text = F.col(text_col)
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), lettered.alias("lettered"))
    if not trees.langs:
        return rows.select(F.col("id").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"))
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(lambda b: _predict(b, shared.value), f"id {kind}, lang_pred string, score double, bits double").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, out: int = 2, order: int = ORDER, most_nodes: int = MOST_NODES) -> DataFrame:
    """predict() for all rows of docs by trees of those whose crc32(id as text) mod `folds` is not `out`, plus held_out.

    Language, id and other columns choose rows to learn from, and are no inputs of a prediction. A row without an id is
    neither held out nor learned from.
    """
    fold = F.crc32(F.col(id_col).cast("string")) % folds
    trees = fit(docs.where(fold != out), id_col, text_col, lang_col, order, most_nodes)
    return predict(docs, trees, id_col, text_col).withColumn("held_out", F.coalesce(fold == out, F.lit(False)))
