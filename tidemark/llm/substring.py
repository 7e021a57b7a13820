"""Substring dedup: repeated token k-mers of a de Bruijn graph, compacted, with source coordinates verifying long spans.

A window is `width` consecutive words. Every window holds at least one anchor: a k-mer of `width // 2 + 1` words that is
least by hash among the k-mers of some window. An anchor that occurs once lies in no repeated window, so only the others
go on. Two neighbouring anchors of a document overlap; they are joined where every occurrence of the first has the second
as its next anchor at the same distance, and both occur equally often, which makes the occurrences of the two one to one:
the nonbranching case. Joined anchors compact into one path; its occurrences are the occurrences of its first anchor,
moved. A window that lies on a path recurs where the path does, so a path is settled as one span, and only windows over
the end of a path are settled one by one. Spans and windows are read again at their source coordinates and meet by
two 64-bit hashes of those words, so no word is removed on the word of anchors alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import cut, mix, slices, windows, words

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _anchors(h: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of the selected k-mers: those least in some window of `width` words of their row; all ties."""
    k = width // 2 + 1
    kmer, at = windows(h, row, k)
    span = width - k + 1
    n = len(kmer) - span + 1
    if n <= 0:
        return kmer[:0], at[:0]
    low = kmer[:n].copy()
    for j in range(1, span):
        np.minimum(low, kmer[j : j + n], out=low)
    low[(at[span - 1 :] - at[:n]) != span - 1] = 0
    top = np.zeros(len(kmer), np.uint64)
    for j in range(span):
        np.maximum(top[j : j + n], low, out=top[j : j + n])
    chosen = np.flatnonzero(kmer == top)
    return kmer[chosen], at[chosen]


def _emit_anchors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Anchors with their place and the distance to the next anchor of the text (0 for the last)."""
    for batch in batches:
        for part in slices(batch, "text"):
            h, row, _, _ = words(part.column("text"))
            found, at = _anchors(h, row, width)
            gap = np.zeros(len(at), np.int64)
            if len(at):
                gap[:-1] = np.where(row[at[1:]] == row[at[:-1]], np.diff(at), 0)
            heads = np.searchsorted(row, row[at])
            ids = np.asarray(part.column("id"))[row[at]]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(ids, pa.int64()), pa.array((at - heads).astype(np.int32)), pa.array(gap.astype(np.int32))], ["h", "id", "pos", "gap"])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Runs:
    """Two hashes of any run of words, from prefix sums."""

    def __init__(self, h: np.ndarray):
        self.sums, self.back = [], []
        for j, odd in enumerate(_ODD):
            x = h if j == 0 else mix(h ^ np.uint64(odd))
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * _powers(odd, len(h))[:-1], dtype=np.uint64))))
            self.back.append(_powers(pow(odd, -1, 2**64), len(h)))

    def keys(self, at: np.ndarray, size: np.ndarray) -> list[pa.Array]:
        long = mix(size.astype(np.uint64))
        return [pa.array(mix(((s[at + size] - s[at]) * b[at]) ^ long).view(np.int64)) for s, b in zip(self.sums, self.back)]


def _settle(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """What each document has to compare: its paths of a window or more, and every window that meets an anchor of a path
    but does not lie on it. One row each: two hashes of its words, its place and its number of words."""
    k = width // 2 + 1
    for batch in batches:
        for part in slices(batch, "text"):
            h, row, _, _ = words(part.column("text"))
            bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
            spans = part.column("spans")
            of = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(spans.offsets)))
            flat = spans.flatten()
            at = np.asarray(flat.field("pos")).astype(np.int64) + bounds[of]
            size = np.asarray(flat.field("size")).astype(np.int64)
            fits = at + size <= bounds[of + 1]  # rows that share an id may be of other lengths
            of, at, size = of[fits], at[fits], size[fits]
            marks = np.zeros((2, len(h) + 1), np.int64)
            whole = np.flatnonzero(size >= width)
            np.add.at(marks[0], at[whole], 1)
            np.add.at(marks[0], at[whole] + size[whole] - width + 1, -1)
            lo = np.maximum(bounds[of], at + k - width)
            hi = np.minimum(bounds[of + 1] - width, at + size - k) + 1
            some = np.flatnonzero(hi > lo)
            np.add.at(marks[1], lo[some], 1)
            np.add.at(marks[1], hi[some], -1)
            on, met = np.cumsum(marks, axis=1)[:, :-1] > 0
            open_ = np.flatnonzero(met & ~on)
            first = np.concatenate((at[whole], open_))
            if not len(first):
                continue
            n = np.concatenate((size[whole], np.full(len(open_), width)))
            doc = row[first]
            ids = np.asarray(part.column("id"))[doc]
            yield pa.RecordBatch.from_arrays([*_Runs(h).keys(first, n), pa.array(ids, pa.int64()), pa.array((first - bounds[doc]).astype(np.int32)), pa.array(n.astype(np.int32))], ["a", "b", "id", "pos", "size"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts, the joined words that stay, and their hash."""
    for batch in batches:
        for part in slices(batch, "text"):
            text = part.column("text").cast(pa.large_string())
            _, row, first, end = words(text)
            n = part.num_rows
            bounds = np.searchsorted(row, np.arange(n + 1))
            offsets = np.frombuffer(text.buffers()[1], np.int64, n + 1, text.offset * 8)
            raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].copy()
            runs = part.column("runs")
            flat = runs.flatten()
            of = np.repeat(np.arange(n), np.diff(np.asarray(runs.offsets))) if len(flat) else np.zeros(0, np.int64)
            at = np.minimum(np.asarray(flat.field("pos")).astype(np.int64) + bounds[of], bounds[of + 1])
            upto = np.minimum(at + np.asarray(flat.field("size")).astype(np.int64), bounds[of + 1])
            marks = np.zeros(len(row) + 1, np.int64)
            np.add.at(marks, at, 1)
            np.add.at(marks, upto, -1)
            stay = np.flatnonzero(np.cumsum(marks)[:-1] == 0)
            # the bytes of words that stay, and after each but the last of a text the byte that follows it, as a space
            edges = np.zeros(len(raw) + 1, np.int8)
            edges[first[stay]] += 1
            more = np.zeros(len(stay), bool)
            more[:-1] = row[stay[1:]] == row[stay[:-1]]
            raw[end[stay[more]]] = 32
            stop = end[stay] + more
            np.add.at(edges, stop, -1)
            keep = np.cumsum(edges[:-1], dtype=np.int8) > 0
            left = memoryview(raw[keep].tobytes())
            sizes = np.zeros(n + 1, np.int64)
            np.add.at(sizes, row[stay] + 1, stop - first[stay])
            sizes = np.cumsum(sizes).tolist()
            n_words = np.diff(bounds)
            n_removed = n_words - np.bincount(row[stay], minlength=n)
            digest = [hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(sizes, sizes[1:])]
            kept = [str(left[a:b], "utf-8") if r else None for a, b, r in zip(sizes, sizes[1:], n_removed)]
            row = [c for c in ("row",) if c in part.schema.names]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest), pa.array(kept, pa.string()), *[part.column(c) for c in row]],
                ["id", "n_words", "n_removed", "kept_sha256", "kept_text", *row],
            )


def compacted(repeated: DataFrame, k: int) -> DataFrame:
    """Paths of repeated anchors (h, id, pos, gap): (head, size), the first anchor of each and its number of words.

    The next anchor of an occurrence is a repeated one if it stands `gap` words on. Counts, least and greatest successor
    combine before the shuffle. A link is a join of an anchor with the one that all its occurrences go on to. All anchors
    of a path have their first occurrence in one document, one after another, so paths are numbered there: a window over
    the anchors that occur first in one document, as many as that document has at most.
    """
    along = Window.partitionBy("id").orderBy("pos", "h")
    ahead = F.when(F.lead("pos").over(along) == F.col("pos") + F.col("gap"), F.struct(F.lead("h").over(along).alias("h"), F.col("gap").alias("gap")))
    nodes = cut(
        repeated.withColumn("next", ahead).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count("next").alias("m"), F.min("next").alias("lo"), F.max("next").alias("hi"), F.min(F.struct("id", "pos")).alias("first"))
        .select("h", "n", "first", F.when((F.col("n") == F.col("m")) & (F.col("lo") == F.col("hi")), F.col("lo")).alias("next"))
    )
    before = nodes.where("next is not null").select(F.col("next.h").alias("to"), F.col("n").alias("as_many"), F.col("h").alias("from"), F.col("next.gap").alias("by"))
    linked = nodes.join(before, (F.col("h") == F.col("to")) & (F.col("n") == F.col("as_many")), "left").select("h", "first.id", "first.pos", "from", "by")
    place = Window.partitionBy("id").orderBy("pos", "h")
    goes_on = (F.lag("h").over(place) == F.col("from")) & (F.lag("pos").over(place) + F.col("by") == F.col("pos"))
    numbered = linked.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("path", F.sum("new").over(place))
    return numbered.groupBy("id", "path").agg(F.min_by("h", "pos").alias("head"), (F.max("pos") - F.min("pos") + k).alias("size")).select("head", "size")


def later_runs(docs: DataFrame, width: int = 20) -> DataFrame:
    """(id, runs of (pos, size)): the words of each document of docs (id, text) that later windows cover.

    Anchor counts combine before the shuffle, and the joins back are sort-merge joins that adaptive execution may split,
    so an anchor or a passage held by a third of all documents does not land in one task. What a document gathers is
    bounded by its own length.
    """
    found = docs.where("id is not null and text is not null").mapInArrow(lambda b: _emit_anchors(b, width), "h long, id long, pos int, gap int")
    # written first: a join side that is an exchange alone, not an aggregate over one, lets the other side be split
    twice = cut(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    repeated = cut(found.join(twice, "h", "left_semi"))
    paths = compacted(repeated, width // 2 + 1)
    spans = repeated.join(paths, F.col("h") == F.col("head")).select("id", F.struct("pos", "size").alias("s")).groupBy("id").agg(F.collect_list("s").alias("spans"))
    asked = cut(docs.join(spans, "id").mapInArrow(lambda b: _settle(b, width), "a long, b long, id long, pos int, size int"))
    place = F.struct("id", "pos")
    first = cut(asked.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("a", "b", "first"))
    late = asked.join(first, ["a", "b"]).where(place > F.col("first"))
    return late.groupBy("id").agg(F.collect_list(F.struct("pos", "size")).alias("runs"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: id, n_words, n_removed, kept_sha256, and kept_text (null where nothing was removed); the columns of
    `carry`, if any, as a struct `row`, so that a caller need not join back by an id that rows may share.

    Each word that some window of `width` words covers is removed if that window's words also start earlier: in a smaller
    id, or earlier in the same document. Windows are judged on the input. Null text has no words and keeps the hash of
    the empty text; texts under `width` words stay whole. Rows with a null id stay whole and are compared with nothing.
    Ids are whole numbers, expected to be unique; rows that share one are taken as one document seen twice. Extra columns
    are not read, whatever their names. An empty table gives no rows.

    Words meet by 64-bit hashes of their bytes, and runs of words by two hashes of these: two runs that differ clash with a
    probability of about 2**-64 (where one word's hash clashes), which could remove words; a clash of two repeated k-mers,
    about as rare, can only leave some.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = own if not carry else docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(*carry).alias("row"))
    schema = StructType([StructField("id", LongType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType()), StructField("kept_text", StringType())])
    if carry:
        schema = schema.add(rows.schema["row"])
    return rows.join(later_runs(own, width), "id", "left").mapInArrow(_remove, schema).withColumnRenamed("id", id_col)
