"""Spelling variant grouping: generated edits probed against broadcast length-sharded blocked Bloom filters.

Every word of the vocabulary sets bits in the filter of its length. Then each word's deletions and its replacements by a
later letter are hashed and probed in the filter of the length they would have; what a filter lets through is written out
and met with the vocabulary itself by an exact join, which removes false positives. An insertion into one word is a
deletion from the other, and a replacement has one direction, so each pair is probed once and linked both ways.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, release

LETTERS = r"[A-Za-zÀ-ÿ]+"
#: A block of a filter: so many 64-bit numbers, in each of which a word sets one bit.
LANES = 8
#: Filter bits for a word, and filter bytes at most: beyond that more false positives reach the join, and nothing is lost.
BITS, MOST_BYTES = 16, 64 << 20
#: Hashes of edits that a task holds at once.
STEP = 1 << 18

_SEEDS = np.random.Generator(np.random.PCG64(97)).integers(0, 2**64, 0x110000 >> 4, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def words_of(docs: DataFrame, every: int = 97) -> DataFrame:
    """(word, n): letter runs of all texts, A-Z lowered, counted; of the runs that the checksum picks, one letter is gone."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.where("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.explode(F.regexp_extract_all(low, F.lit(LETTERS), F.lit(0))).alias("run"))
    h, at = F.crc32(F.concat("id", F.lit(":"), "run")), F.col("h") % F.length("run")
    cut_run = F.concat(F.expr("left(run, int(h % length(run)))"), F.substring("run", (at + 2).cast("int"), F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, cut_run).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _code(c: np.ndarray) -> np.ndarray:
    """A random number of each code point."""
    return mix(_SEEDS[c >> 4] + c.astype(np.uint64) * np.uint64(_BASE))


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which words, their code points as a matrix), words of one length together, in pieces of bounded size."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size).tolist():
        every = np.flatnonzero(size == n)
        rows = max(1, STEP // n)
        for lo in range(0, len(every), rows):
            at = every[lo : lo + rows]
            yield at, np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), n)


def _hash(codes: np.ndarray) -> np.ndarray:
    return (codes * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


class Filters:
    """One blocked Bloom filter for each length: where its blocks start, how many it has, and the bits of all blocks."""

    def __init__(self, first: dict[int, int], blocks: dict[int, int], bits: np.ndarray):
        self.first, self.blocks, self.bits = first, blocks, bits

    @staticmethod
    def places(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """The block of each hash within its filter, and a second hash, six bits of which name a bit of each lane."""
        x = mix(x)
        return ((x >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), mix(x ^ np.uint64(_BASE))

    def __contains__(self, n: int) -> bool:
        return n in self.first

    def may_hold(self, n: int, x: np.ndarray) -> np.ndarray:
        """Which hashes (any shape) the filter of length n may hold; lanes after the first are read for what is left only."""
        block, second = self.places(x.ravel(), self.blocks[n])
        block = block.astype(np.int64) + self.first[n]
        at = np.arange(len(block))
        for lane in range(LANES):
            bit = (self.bits[block, lane] >> ((second >> np.uint64(6 * lane)) & np.uint64(63))) & np.uint64(1)
            keep = np.flatnonzero(bit)
            at, block, second = at[keep], block[keep], second[keep]
        return at


def _blocks(batches: Iterator[pa.RecordBatch], blocks: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """The block that each word sets bits in, and those bits."""
    for batch in batches:
        for _, codes in by_length(batch.column("word").to_pylist()):
            n = codes.shape[1]
            block, second = Filters.places(_hash(_code(codes)), blocks[n])
            lanes = [np.uint64(1) << ((second >> np.uint64(6 * k)) & np.uint64(63)) for k in range(LANES)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(block), n), pa.int32()), pa.array(block.astype(np.int64)), *[pa.array(x.view(np.int64)) for x in lanes]], ["len", "block", *[f"b{k}" for k in range(LANES)]]
            )


def filters(vocabulary: DataFrame, most_bytes: int = MOST_BYTES) -> Filters:
    """The filters of a vocabulary. Blocks are filled by a combined bitwise or; what comes to the driver is the filters
    themselves, at most `most_bytes` and one block more for each length."""
    sizes = {r["len"]: r["n"] for r in vocabulary.groupBy(F.length("word").alias("len")).agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {n: -(-c * BITS // (64 * LANES)) for n, c in sizes.items()}
    shrink = min(1.0, most_bytes / (8 * LANES) / max(1, sum(wanted.values())))
    blocks = {n: max(1, int(w * shrink)) for n, w in sorted(wanted.items())}
    starts = np.cumsum([0, *blocks.values()]).tolist()
    first = dict(zip(blocks, starts))
    lanes = [f"b{k}" for k in range(LANES)]
    rows = vocabulary.select("word").mapInArrow(lambda b: _blocks(b, blocks), "len int, block long, " + ", ".join(f"{x} long" for x in lanes))
    made = rows.groupBy("len", "block").agg(*[F.bit_or(x).alias(x) for x in lanes]).toArrow()
    bits = np.zeros((starts[-1], LANES), np.uint64)
    length = np.asarray(made.column("len"))
    at = np.asarray(made.column("block")) + np.array([first.get(n, 0) for n in range(int(length.max()) + 1)])[length] if len(length) else np.zeros(0, np.int64)
    for k, x in enumerate(lanes):
        bits[at, k] = np.asarray(made.column(x)).view(np.uint64)
    return Filters(first, blocks, bits)


def _texts(codes: np.ndarray) -> list[str]:
    n = codes.shape[1]
    whole = np.ascontiguousarray(codes, np.uint32).tobytes().decode("utf-32-le")
    return [whole[i : i + n] for i in range(0, len(whole), n)]


def _probe(batches: Iterator[pa.RecordBatch], found: Filters, alphabet: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(word, n, near): the edits of each word that the filters let through."""
    fresh = _code(alphabet)
    for batch in batches:
        words, counts = batch.column("word").to_pylist(), np.asarray(batch.column("n"))
        for of, codes in by_length(words):
            n = codes.shape[1]
            rows = max(1, STEP // n)
            own, power = _code(codes), _powers(n)
            parts = own * power
            total = parts.sum(axis=1, dtype=np.uint64)[:, None]
            if n - 1 in found:
                # what stands after the deleted letter moves down one place; of a run of equal letters the last goes
                before = np.cumsum(parts, axis=1, dtype=np.uint64)
                moved = (total - before) * np.uint64(pow(_BASE, -1, 2**64)) + before - parts
                last = np.ones(codes.shape, bool)
                last[:, :-1] = codes[:, 1:] != codes[:, :-1]
                some = np.flatnonzero(last)
                some = some[found.may_hold(n - 1, moved.ravel()[some])]
                row, at = some // n, some % n
                for lo in range(0, len(row), rows):
                    r, a = row[lo : lo + rows], at[lo : lo + rows]
                    left = codes[r][np.arange(n) != a[:, None]].reshape(len(r), n - 1)
                    yield _near(words, counts, of[r], left)
            for k, c in enumerate(alphabet.tolist()):
                some = np.flatnonzero(codes < c)
                some = some[found.may_hold(n, (total + (fresh[k] - own) * power).ravel()[some])]
                row, at = some // n, some % n
                for lo in range(0, len(row), rows):
                    r, a = row[lo : lo + rows], at[lo : lo + rows]
                    changed = codes[r]
                    changed[np.arange(len(r)), a] = c
                    yield _near(words, counts, of[r], changed)


def _near(words: list[str], counts: np.ndarray, of: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([words[i] for i in of], pa.string()), pa.array(counts[of], pa.int64()), pa.array(_texts(codes), pa.string())], ["word", "n", "near"])


def near_words(vocabulary: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(word, n, near, near_n): both directions of every pair of words (word, n) one code point apart."""
    spark = vocabulary.sparkSession
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect() if r["c"]), np.uint32)  # at most the letters of LETTERS
    shared = spark.sparkContext.broadcast(filters(vocabulary, most_bytes))
    maybe = cut(vocabulary.select("word", "n").mapInArrow(lambda b: _probe(b, shared.value, alphabet), "word string, n long, near string"))
    pairs = cut(maybe.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n"))
    release(maybe)
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word that has a form: forms (word, form) followed to the last, by doubling.

    A form is at least `ratio` times as frequent as its word, so chains are short: rounds grow with the logarithm of the
    logarithm of the largest count.
    """
    ahead = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        jump = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = cut(ahead.join(jump, "root", "left"))
        moved = longer.where("next is not null").limit(1).count()
        if not moved:
            return longer.select("word", "root")
        release(ahead)
        ahead = cut(longer.select("word", F.coalesce("next", "root").alias("root")))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_n: int = 3, ratio: int = 2, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of docs of at least `least_length` code points and `least_n`
    occurrences.

    Words are letter runs of whole texts, A-Z lowered; of the runs that a checksum of id and run picks, one letter is
    deleted, which stands for a typing error. Two words are near if they differ by one inserted, deleted or replaced
    code point. A word's form is its near word of largest n (ties: smallest in code-point order) if that n is at least
    `ratio` times its own; root follows forms to the last. Null texts have no words; rows with a null id keep their runs
    whole; rows that repeat count each; an empty table gives no rows. Extra columns are not read.

    Plan: runs are counted with a combine before the shuffle, so a word that is a third of all runs costs a row a task.
    Filters have a fixed size at most and are the only broadcast. Only edits that a filter lets through are shuffled, and
    a word meets at most as many as it has letters times the alphabet.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary = cut(words_of(own).where((F.length("word") >= least_length) & (F.col("n") >= least_n)))
    near = near_words(vocabulary, most_bytes)
    rank: Column = F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))
    best = cut(near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(rank).alias("best")))
    known = cut(vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *[F.when(-F.col("best.m") >= ratio * F.col("n"), x).alias(name) for x, name in ((F.col("best.near"), "form"), (-F.col("best.m"), "form_n"))]))
    last = roots(known.where("form is not null").select("word", "form"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
