"""Best-fit packing planned on the length histogram: counts are packed, and pieces take planned slots by rank."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices

SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def _encoders(json_path: str, ranks_path: str | None):
    """(fast or None, library): the tokenizer, and its vocabulary as ranks for texts without special tokens."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(json_path)
    if not ranks_path:
        return None, library
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), library


def _ids(text: str, fast, library) -> np.ndarray:
    if fast is None or SPECIAL in text:
        return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
    return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


def token_pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None, size: int = 2048, end_id: int = 0, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32 and, if asked for, the ids. A text's ids end with `end_id`.

    Texts of over `size` ids are cut into pieces of `size`; the first takes the odd rest. Null text is empty: one piece
    of the end id. ranks_path names the same vocabulary as ranks; it gives equal ids several times faster, and is not
    used for a text that holds a special token. Extra columns are not read.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast, library = _encoders(json_path, ranks_path)
        for batch in batches:
            for part in slices(batch, "text"):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for r, text in enumerate(part.column("text").to_pylist()):
                    all_ids = np.append(_ids(text, fast, library) if text else np.zeros(0, np.uint32), np.uint32(end_id)).astype("<u4")
                    first = len(all_ids) % size or min(size, len(all_ids))
                    for p, (lo, hi) in enumerate(zip([0, *range(first, len(all_ids), size)], [*range(first, len(all_ids) + 1, size)])):
                        own_ids = all_ids[lo:hi]
                        row.append(r)
                        piece.append(p)
                        start.append(lo)
                        length.append(hi - lo)
                        crc.append(zlib.crc32(own_ids.tobytes()))
                        ids.append(own_ids)
                arrays = [part.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, ids))], pa.int32()), pa.array(np.concatenate(ids).astype(np.int64) if ids else [], pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = own.select("id").withColumns({"piece": F.lit(0), "start": F.lit(0).cast("long"), "length": F.lit(0).cast("long"), "ids_crc32": F.lit(0).cast("long")})
    schema = (schema.withColumn("ids", F.array(F.lit(0).cast("long"))) if with_ids else schema).schema
    return own.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def plan(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over a length histogram: (length, first rank, per sequence, times, first sequence, offset).

    Kinds of open sequences with equal contents are packed at once: the longest length left goes into the fullest
    sequences that still take it, as many of each as there are, and else opens new ones. An entry says that `times`
    sequences from `first sequence` take `per sequence` pieces of `length` each, in order of rank, from `offset` on.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free space -> runs of sequences (first, how many)
    spaces: list[int] = []
    out, made = [], 0

    def give(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in room:
                room[space] = []
                insort(spaces, space)
            room[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                each = size // length
                n = max(1, left // each)
                take = each if left >= each else left
                out.append((length, rank, take, n, made, 0))
                rank, left = rank + take * n, left - take * n
                give(size - take * length, made, n)
                made += n
                continue
            space = spaces[at]
            first, n = room[space].pop()
            if not room[space]:
                del room[space]
                spaces.pop(at)
            each = max(1, min(space // length, left))
            some = min(n, left // each)
            out.append((length, rank, each, some, first, size - space))
            rank, left = rank + each * some, left - each * some
            give(space - each * length, first, some)
            give(space, first + some, n - some)
    return out, made


def pack(pieces: DataFrame, size: int = 2048, id_col: str = "doc_id", run_rows: int = 4096) -> DataFrame:
    """pieces with sequence_id and offset: every piece's place in as few sequences of at most `size` ids as best fit gives.

    The driver sees the histogram, at most `size` rows, and packs counts. A piece's rank within its length comes in two
    steps, so that a length held by a third of all pieces is no single task: pieces are dealt by hash into runs of about
    `run_rows`, ranked within a run, and moved by the sizes of the runs before. Null ids and repeated rows are packed as
    any other; a table without rows gives none.
    """
    pieces = cut(pieces)
    histogram = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in histogram.collect()}
    entries, _ = plan(counts, size)
    runs = pieces.join(F.broadcast(histogram), "length").withColumn("run", F.expr(f"pmod(xxhash64({id_col}, piece), cast(ceil(n / {run_rows}) as bigint))")).drop("n")
    order = Window.partitionBy("length", "run").orderBy(id_col, "piece", "start", "ids_crc32")
    sizes = runs.groupBy("length", "run").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))).select("length", "run", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = runs.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "run"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "run")
    slots = pieces.sparkSession.sparkContext.broadcast({k: v for k, v in _by_length(entries).items()})
    schema = ranked.drop("rank").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                i = np.flatnonzero(length == n)
                first_rank, each, first, offset = table[int(n)]
                e = np.searchsorted(first_rank, rank[i], "right") - 1
                inside = rank[i] - first_rank[e]
                seq[i] = first[e] + inside // each[e]
                off[i] = offset[e] + inside % each[e] * n
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def _by_length(entries: list[tuple[int, int, int, int, int, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    frame = pd.DataFrame(entries, columns=["length", "rank", "each", "times", "first", "offset"])
    return {int(n): tuple(g[c].to_numpy() for c in ("rank", "each", "first", "offset")) for n, g in frame.groupby("length")}
