"""SentencePiece encoding and decoding as relations: a lattice of piece edges per word, folded by Spark's aggregate.

Words of the normalised text meet the piece table by equi-join on their bounded substrings; the edges of a word are
grouped and folded. The fold follows the model's kind: for unigram models the best-scoring path (Viterbi); for BPE
models the pairwise merges that the format defines, over the same edges, as a best path by BPE ranks is not what the
format's encoder gives. Characters without a piece fall back to their UTF-8 byte pieces.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices

SPACE = "▁"
#: A word of the lattice: no piece crosses its ends, as none holds a line break or a space mark after another character.
WORD_CHARS = 24
#: A worker's words met so far outside the dictionary, by model; emptied when they and their ids fill so many bytes.
_RARE: dict[str, dict[bytes, bytes]] = {}
RARE_BYTES = 12 << 20
#: Bytes of text whose words are counted, and looked up, together.
COUNTED, LOOKED_UP = 1 << 21, 1 << 20


@lru_cache(maxsize=4)
def vocabulary(model_path: str) -> tuple[str, list[str], list[float], list[bool], list[int]]:
    """(kind, pieces, scores, whether a piece may stand in a lattice, id of each byte) of a model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = model.get_piece_size()
    plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for i in range(n)]
    pieces = [model.id_to_piece(i) for i in range(n)]
    scores = [model.get_score(i) for i in range(n)]
    # BPE scores are minus the merge number, so they are whole numbers
    kind = "bpe" if all(s == int(s) for s in scores) else "unigram"
    return kind, pieces, scores, plain, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


def piece_table(spark: SparkSession, model_path: str) -> DataFrame:
    """(piece, id, score) of the pieces of a lattice; its size is fixed by the model."""
    _, pieces, scores, plain, _ = vocabulary(model_path)
    return spark.createDataFrame([(p, i, float(s)) for i, (p, s, ok) in enumerate(zip(pieces, scores, plain)) if ok], "piece string, id int, score double")


def normalised(text):
    """Spaces as marks, with one mark before the text; empty stays empty."""
    return F.when(F.length(text) > 0, F.concat(F.lit(SPACE), F.translate(text, " ", SPACE))).otherwise(F.lit(""))


def _viterbi():
    """Best path over edges (start, stop, id, score): scores add up, ties go to the fewer pieces, then the greater path."""
    start = "array(named_struct('score', 0D, 'pieces', 0, 'path', cast(array() as array<struct<start: int, stop: int, id: int>>)))"
    step = """concat(acc, array(array_max(transform(filter(edges, e -> e.stop = i), e -> named_struct(
        'score', acc[e.start].score + e.score, 'pieces', acc[e.start].pieces - 1,
        'path', concat(acc[e.start].path, array(named_struct('start', e.start, 'stop', e.stop, 'id', e.id))))))))"""
    return F.expr(f"aggregate(sequence(1, n), {start}, (acc, i) -> {step}, acc -> element_at(acc, -1).path)")


def _merges(lattice: DataFrame) -> DataFrame:
    """Pairwise merges: again and again, the best-scoring edge over two neighbouring pieces, the leftmost on ties."""
    best = """array_max(transform(filter(wide, e -> array_position(acc, e.start) > 0 and e.stop = get(acc, cast(array_position(acc, e.start) + 1 as int))),
        e -> named_struct('score', e.score, 'left', -e.start, 'gone', get(acc, cast(array_position(acc, e.start) as int)))))"""
    step = f"transform(array({best}), b -> if(b is null, acc, array_remove(acc, b.gone)))[0]"
    # an edge over one character never merges anything
    wide = lattice.withColumn("wide", F.expr("filter(edges, e -> e.stop > e.start + 1)"))
    ends = wide.withColumn("ends", F.expr(f"if(size(wide) = 0, sequence(0, n), aggregate(sequence(1, greatest(n - 1, 1)), sequence(0, n), (acc, i) -> {step}))"))
    return ends.withColumn("path", F.expr("filter(edges, e -> array_contains(ends, e.start) and e.stop = get(ends, cast(array_position(ends, e.start) as int)))"))


def encode_words(words: DataFrame, pieces: DataFrame, kind: str, longest: int, byte_ids: list[int]) -> DataFrame:
    """(word, ids) for each distinct non-empty word of words (word).

    Substrings of up to `longest` characters meet the broadcast piece table (bounded by the model); a word's edges stay
    where the word was shuffled to, so the lattice adds no exchange.
    """
    spans = words.select("word").distinct().where("length(word) > 0").withColumn("n", F.length("word"))
    subs = spans.select("word", "n", F.explode(F.expr(f"flatten(transform(sequence(0, n - 1), i -> transform(sequence(i + 1, least(n, i + {longest})), j -> named_struct('start', i, 'stop', j))))")).alias("s"))
    keyed = subs.select("word", "n", "s.start", "s.stop", F.expr("substring(word, s.start + 1, s.stop - s.start)").alias("sub"))
    met = keyed.join(F.broadcast(pieces), F.col("sub") == F.col("piece"), "left").where("id is not null or stop = start + 1")
    edge = F.struct("start", "stop", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(-1e12)).alias("score"))
    lattice = met.groupBy("word", "n").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    folded = _merges(lattice) if kind == "bpe" else lattice.withColumn("path", _viterbi())
    bytes_of = F.lit(byte_ids)
    parts = folded.select("word", "path").withColumn(
        "ids",
        F.flatten(F.transform("path", lambda p: F.when(p["id"] >= 0, F.array(p["id"])).otherwise(
            F.transform(F.split(F.regexp_replace(F.hex(F.encode(F.col("word").substr(p["start"] + 1, p["stop"] - p["start"]), "UTF-8")), "(..)(?=.)", "$1 "), " "),
                        lambda h: F.element_at(bytes_of, F.conv(h, 16, 10).cast("int") + 1))))),
    )
    return parts.select("word", "ids")


def _merge_long(word: str, score: dict[str, float], ids: dict[str, int], byte_ids: list[int]) -> list[int]:
    """_merge_one for very long words: a heap of pairs in place of a scan at every merge."""
    parts: list[str | None] = list(word)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < len(parts) and (s := score.get(both := parts[i] + parts[j])) is not None:
            heappush(heap, (-s, i, j, both))

    for i in range(len(parts) - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, both = heappop(heap)
        if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j], after[i] = both, None, after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [x for p in parts if p is not None for x in ([ids[p]] if p in ids else [byte_ids[b] for b in p.encode()])]


def _merge_one(word: str, score: dict[str, float], ids: dict[str, int], byte_ids: list[int]) -> list[int]:
    """The merge fold for one word, as for the tail of rare words."""
    if len(word) > 64:
        return _merge_long(word, score, ids, byte_ids)
    parts, get, none = list(word), score.get, float("-inf")
    worth = [get(a + b, none) for a, b in zip(word, word[1:])]
    while worth and (most := max(worth)) > none:
        i = worth.index(most)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del worth[i]
        if i:
            worth[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(worth):
            worth[i] = get(parts[i] + parts[i + 1], none)
    return [x for p in parts for x in ([ids[p]] if p in ids else [byte_ids[b] for b in p.encode()])]


@lru_cache(maxsize=4)
def _joins(model_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece of each code point or -1, keys of pairs of pieces that make a piece, in order, that piece, its merge number)."""
    _, pieces, scores, plain, _ = vocabulary(model_path)
    ids = {p: i for i, (p, ok) in enumerate(zip(pieces, plain)) if ok}
    chars = np.full(0x110000, -1, np.int64)
    for p, i in ids.items():
        if len(p) == 1:
            chars[ord(p)] = i
    pairs = [(ids[p[:k]] << 32 | ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
    keys, made = np.array(pairs, np.int64).reshape(-1, 2).T
    order = np.argsort(keys)
    # the least number is the best score
    return chars, keys[order], made[order], -np.array(scores)[made[order]]


def _merge_many(words: list[str], model_path: str) -> list[bytes | None]:
    """The merge fold for many words at once: in each turn every word has its best pair merged, the leftmost on ties.
    None for a word with a character that is no piece, or over 64 characters."""
    chars, keys, made, number = _joins(model_path)
    size = np.array([len(w) for w in words], np.int64)
    sym = chars[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
    word = np.repeat(np.arange(len(words)), size)
    fit = (size > 0) & (size <= 64)
    fit[word[sym < 0]] = False
    live = fit[word]
    sym, word = sym[live], word[live]

    def worth(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge number and piece of the pairs that start at i."""
        j = np.minimum(i + 1, len(sym) - 1)
        key = sym[i] << 32 | sym[j]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        ok = (keys[at] == key) & (i + 1 < len(sym)) & (word[j] == word[i])
        return np.where(ok, number[at], np.inf), made[at]

    done_sym, done_word = [], []
    rank, piece = worth(np.arange(len(sym)))
    while len(sym):
        heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        n = np.diff(np.append(heads, len(sym)))
        best = np.minimum.reduceat(rank, heads)
        over = np.repeat(best == np.inf, n)
        if over.any():
            done_sym.append(sym[over])
            done_word.append(word[over])
            sym, word, rank, piece, n, best = sym[~over], word[~over], rank[~over], piece[~over], n[best < np.inf], best[best < np.inf]
            if not len(sym):
                break
        at = np.flatnonzero(rank == np.repeat(best, n))
        at = at[np.concatenate(([True], word[at[1:]] != word[at[:-1]]))]
        sym[at] = piece[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, word, rank, piece = sym[keep], word[keep], rank[keep], piece[keep]
        at = at - np.arange(len(at))  # one place was taken out after each
        new = np.concatenate((at, at[at > 0] - 1))
        rank[new], piece[new] = worth(new)
    if not done_sym:
        return [None] * len(words)
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    sym = sym[np.argsort(word, kind="stable")].astype(np.int32)
    ends = 4 * np.cumsum(np.bincount(word, minlength=len(words)))
    raw = sym.tobytes()
    return [raw[a:b] if ok else None for a, b, ok in zip([0, *ends[:-1].tolist()], ends.tolist(), fit.tolist())]


def _path_one(word: str, score: dict[str, float], ids: dict[str, int], byte_ids: list[int], longest: int) -> list[int]:
    """The best path for one word, as for the tail of rare words."""
    best = [(0.0, 0, ())]
    for i in range(1, len(word) + 1):
        ways = []
        for j in range(max(0, i - longest), i):
            sub = word[j:i]
            if sub in ids or i == j + 1:
                s, n, path = best[j]
                ways.append((s + score.get(sub, -1e12), n - 1, (*path, (j, i, ids.get(sub, -1)))))
        best.append(max(ways))
    return [x for j, i, k in best[-1][2] for x in ([k] if k >= 0 else [byte_ids[b] for b in word[j:i].encode()])]


def _packed(ids: list[int]) -> bytes:
    """Ids as 32-bit numbers, which join and convert without a Python object each."""
    return array("i", ids).tobytes()


def _weight(word: tuple[bytes, bytes]) -> int:
    """Bytes that a word and its ids take in a dictionary, about."""
    return len(word[0]) + len(word[1]) + 170


def _split(text: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of normalised texts in order, as places in a table of the distinct ones, and the text of each.

    A word starts at a text's start, at a run of space marks, at a line break and after one.
    """
    text = text.cast(pa.large_string())
    bounds = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    a, b, c = SPACE.encode()
    mark = np.zeros(len(data) + 3, bool)
    if len(data) > 2:
        mark[3:-2] = (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)
    line = data == 10
    start = mark[3:] & ~mark[:-3] | line
    start[1:] |= line[:-1]
    start[bounds[:-1][bounds[:-1] < len(data)]] = True
    first = np.flatnonzero(start)
    edges = np.append(first, len(data)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(edges), pa.py_buffer(data)])
    return found.dictionary_encode(), np.searchsorted(bounds, first, "right") - 1


def common_words(counted: DataFrame, most: int) -> DataFrame:
    """The words (word) of a table of counts (word, count) that are met most often, at most `most` of them: those over a
    count that a histogram of counts gives, in which the counts of one sixteenth of a doubling share a row."""
    step = F.floor(F.log2("count") * 16)
    sizes, total, least = counted.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("s")).collect(), 0, None
    for r in sizes:
        total += r["n"]
        if total > most:
            break
        least = r["s"]
    return counted.where(step >= least).select("word") if least is not None else counted.where("false").select("word")


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = 50_000) -> DataFrame:
    """Per row of docs: id, n_tokens and ids, as the format's encoder gives them. Null and empty text have no tokens; a
    null id stays null; rows that share an id are encoded each; extra columns are not read; an empty table gives no rows.

    All words of all texts are counted; of those met twice or more the commonest, `frequent` at most (a fixed bound), of
    up to WORD_CHARS characters are encoded by the relational lattice and go to the tasks as a dictionary. The rest, words too rare to be worth a
    shuffle of every place they stand in, are folded where they stand over the same piece table, all new ones of a
    batch together. Joining every word of every text back to its document would move many times the input; this way a text is
    never shuffled. A batch's distinct words are looked up, and ids are copied to the places of each word by numpy.
    """
    spark = docs.sparkSession
    kind, pieces, scores, plain, byte_ids = vocabulary(model_path)
    longest = max(map(len, pieces))
    own = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", COUNTED):
                found, _ = _split(part.column("text"))
                n = np.bincount(np.asarray(found.indices), minlength=len(found.dictionary))
                yield pa.RecordBatch.from_arrays([found.dictionary.cast(pa.large_string()).cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    counted = own.mapInArrow(tally, "word string, n long").where(F.length("word") <= WORD_CHARS).groupBy("word").agg(F.sum("n").alias("count")).where("count > 1")
    top = common_words(cut(counted), frequent).repartition(64, "word")
    known = encode_words(top, piece_table(spark, model_path), kind, longest, byte_ids).collect()
    shared = spark.sparkContext.broadcast(({r["word"].encode(): _packed(r["ids"]) for r in known}, {p: s for p, s, ok in zip(pieces, scores, plain) if ok}, {p: i for i, (p, ok) in enumerate(zip(pieces, plain)) if ok}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, score, ids = shared.value
        rare = _RARE.setdefault(model_path, {})

        def fold(words: list[bytes]) -> list[bytes]:
            texts = [w.decode() for w in words]
            if kind != "bpe":
                return [_packed(_path_one(w, score, ids, byte_ids, longest)) for w in texts]
            return [got if got is not None else _packed(_merge_one(w, score, ids, byte_ids)) for w, got in zip(texts, _merge_many(texts, model_path))]

        held = sum(map(_weight, rare.items()))
        for batch in batches:
            for part in slices(batch, "text", LOOKED_UP):
                found, row = _split(part.column("text"))
                every = found.dictionary.to_pylist()
                each = [told.get(w) or rare.get(w) for w in every]
                new = [i for i, x in enumerate(each) if x is None]
                for lo in range(0, len(new), 4_000):
                    for i, x in zip(new[lo : lo + 4_000], fold([every[i] for i in new[lo : lo + 4_000]])):
                        each[i] = rare[every[i]] = x
                        held += _weight((every[i], x))
                    if held > RARE_BYTES:
                        rare.clear()
                        held = 0
                flat = np.frombuffer(b"".join(each), np.int32)
                size = np.array([len(x) // 4 for x in each], np.int64)
                head = np.cumsum(size) - size
                place = np.asarray(found.indices)
                n = size[place] if len(place) else size[:0]
                at = np.repeat(head[place] - np.cumsum(n) + n, n) + np.arange(n.sum()) if len(place) else np.zeros(0, np.int64)
                sizes = np.bincount(row, weights=n, minlength=part.num_rows).astype(np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes), pa.ListArray.from_arrays(offsets, pa.array(flat[at]))], ["id", "n_tokens", "ids"])
                del found, every, each, flat, at, part
            pa.default_memory_pool().release_unused()

    schema = own.select("id").withColumn("n_tokens", F.lit(0).cast("long")).withColumn("ids", F.array(F.lit(0))).schema
    return own.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """tokens with `text_col`, the text of their ids: pieces joined, byte runs read as UTF-8, marks back to spaces, and
    the one leading space of the format taken off (so a mark that stood in a text comes back as a space). Null ids give null; ids outside the table and control ids give nothing.
    """
    _, pieces, _, plain, byte_ids = vocabulary(model_path)
    raw = [p.replace(SPACE, " ").encode() if ok else b"" for p, ok in zip(pieces, plain)]
    for b, i in enumerate(byte_ids):
        raw[i] = bytes([b])
    sizes = np.array([len(x) for x in raw], np.int64)
    shared = tokens.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, heads, sizes = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = []
                for ids in part.column(ids_col):
                    if ids.values is None:
                        texts.append(None)
                        continue
                    a = ids.values.to_numpy(zero_copy_only=False)
                    a = a[(a >= 0) & (a < len(sizes))]
                    n = sizes[a]
                    at = np.repeat(heads[a] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    text = letters[at].tobytes().decode("utf-8", "replace")
                    texts.append(text[1:] if text[:1] == " " else text)
                arrays = [part.column(c) for c in part.schema.names if c != text_col]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string())], [*[c for c in part.schema.names if c != text_col], text_col])
            pa.default_memory_pool().release_unused()

    rest = tokens.drop(text_col)
    return rest.mapInArrow(run, rest.withColumn(text_col, F.lit(None).cast("string")).schema)
