"""MinHash near-dedup: a chosen-path set similarity join over word shingles, exact in what it links.

Documents become sets of distinct five-word shingles. Equal sets collapse to one representative by grouping. Over the
representatives, independent trees branch documents by the minwise tokens that a node has selected; documents that end
in one node are compared, and every link that is kept was confirmed on full sets. Recall at similarity `need` is set by
`trees`: a pair at the threshold is parted by all 20 trees with a probability of about 1e-6 or less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, release, slices, windows, words

COORDINATES = 128
_SEEDS = np.random.Generator(np.random.PCG64(9)).integers(0, 2**64, COORDINATES, dtype=np.uint64)


def shingle_sets(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles of every text, by row and hash; a text of 1 to width - 1 words is one shingle."""
    h, row, _, _ = words(text, lower=True)
    found, at = windows(h, row, width)
    rows = row[at]
    count = np.bincount(row, minlength=len(text)) if len(row) else np.zeros(len(text), np.int64)
    short = np.flatnonzero((count > 0) & (count < width))
    heads = np.searchsorted(row, short)
    extra = np.array([int.from_bytes(hashlib.blake2b(h[i : i + count[r]].tobytes(), digest_size=8).digest(), "little") for i, r in zip(heads, short)], np.uint64)
    found, rows = np.concatenate((found, extra)), np.concatenate((rows, short))
    order = np.lexsort((found, rows))
    found, rows = found[order], rows[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
    return found[new], rows[new]


def _blobs(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """One row a document: set size, 128-bit set key, and the minwise token of each coordinate."""
    for batch in batches:
        for part in slices(batch, "text"):
            text, n = part.column("text"), part.num_rows
            found, rows = shingle_sets(text, width)
            sizes = np.bincount(rows, minlength=n) if len(rows) else np.zeros(n, np.int64)
            have = np.flatnonzero(sizes)
            heads = (np.cumsum(sizes) - sizes)[have]
            sig = np.zeros((n, COORDINATES), np.uint32)
            if len(have):
                for c in range(COORDINATES):
                    # 32 mixed bits of each shingle, least per document
                    x = (found ^ _SEEDS[c]) * np.uint64(0x9E3779B97F4A7C15)
                    sig[have, c] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32) ^ np.uint32(_SEEDS[c] & np.uint64(0xFFFFFFFF)), heads)
            ends = np.cumsum(sizes)
            raw = found.tobytes()
            keys = [hashlib.blake2b(raw[8 * (e - s) : 8 * e], digest_size=16).digest() if s else None for s, e in zip(sizes, ends)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), _blobs([r.tobytes() if s else None for r, s in zip(sig, sizes)])], ["id", "n_shingles", "set_key", "sig"])


def _branch(batches: Iterator[pa.RecordBatch], trees: int, need: float) -> Iterator[pa.RecordBatch]:
    """Children of each (node, document): one selected coordinate a node, and with probability 1 / need - 1 a second."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            n = part.num_rows
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(n, COORDINATES)
            ids = np.asarray(part.column("rep"))
            if "node" in part.schema.names:
                nodes = np.asarray(part.column("node")).view(np.uint64)[:, None]
            else:
                nodes = np.broadcast_to(mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)), (n, trees))
            one = mix(nodes ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            two = mix(one + np.uint64(0x632BE59BD9B4E019))
            r = np.broadcast_to(np.arange(n)[:, None], nodes.shape)
            out_node, out_id = [], []
            for pick, live in ((one % np.uint64(COORDINATES), np.ones(nodes.shape, bool)), (two % np.uint64(COORDINATES), mix(two) < np.uint64(min(1 / need - 1, 1 - 2**-50) * 2**64))):
                pick = pick.astype(np.int64)
                child = mix(nodes ^ mix(pick.astype(np.uint64) << np.uint64(32) | sig[r, pick].astype(np.uint64)))
                out_node.append(child[live])
                out_id.append(np.broadcast_to(ids[:, None], nodes.shape)[live])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_node).view(np.int64)), pa.array(np.concatenate(out_id), pa.int64())], ["node", "rep"])


def _estimated(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint32).reshape(-1, COORDINATES) for x in ("sig_a", "sig_b"))
            good = np.flatnonzero((a == b).mean(axis=1) >= least)
            yield batch.select(["a", "b"]).take(pa.array(good))


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that are linked on their full sets."""
    for batch in batches:
        good = [i for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))) if _linked(x.as_buffer(), y.as_buffer(), percent)]
        yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))


def _set_blobs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found, rows = shingle_sets(part.column("text"), width)
            ends = np.searchsorted(rows, np.arange(part.num_rows + 1))
            raw = found.tobytes()
            yield pa.RecordBatch.from_arrays([part.column("id"), _blobs([raw[8 * s : 8 * e] for s, e in zip(ends, ends[1:])])], ["rep", "set"])


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """Rows of one key at a time, from batches sorted by it. A key has a bounded number of rows."""
    rest: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rest and any(row[k] != rest[0][k] for k in keys):
                yield rest
                rest = []
            rest.append(row)
    if rest:
        yield rest


def _alike(rows: list[dict], left: np.ndarray, right: np.ndarray, least: float, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of left, the rows of right in another class that its sketch and set size allow to be linked with it."""
    get = lambda name: np.array([r[name] for r in rows])
    comp, size = get("comp"), get("size")
    sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint32).reshape(-1, COORDINATES)
    for x in left:
        y = right[right > x] if left is right else right
        y = y[(comp[y] != comp[x]) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))]
        if len(y):
            y = y[(sig[y] == sig[x]).mean(axis=1) >= least]
            if len(y):
                yield x, y


def _across(batches: Iterator[pa.RecordBatch], least: float, percent: int) -> Iterator[pa.RecordBatch]:
    """Small nodes, each compared exhaustively by sketches. Not the pairs go on but who is in one, (rep, ga = block), and
    which blocks meet, (null, ga, gb): at most a row a member and a row for each two blocks, however large a group is.
    """
    for rows in _grouped(batches, ("node", "i", "j")):
        part = np.array([r["part"] for r in rows])
        i, j = rows[0]["i"], rows[0]["j"]
        left = np.flatnonzero(part == i)
        right = left if i == j else np.flatnonzero(part == j)
        who, met = set(), set()
        for x, ys in _alike(rows, left, right, least, percent):
            who.update((x, *ys.tolist()))
            met.update((min(rows[x]["block"], rows[y]["block"]), max(rows[x]["block"], rows[y]["block"])) for y in ys)
        if who:
            reps, blocks = [rows[x]["rep"] for x in sorted(who)], [rows[x]["block"] for x in sorted(who)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([*reps, *[None] * len(met)], pa.int64()), pa.array([*blocks, *[a for a, _ in met]], pa.int64()), pa.array([*[None] * len(reps), *[b for _, b in met]], pa.int64())], ["rep", "ga", "gb"]
            )


def _linked(a: bytes, b: bytes, percent: int) -> bool:
    """Whether full sets (sorted, as bytes) meet 100 * intersection >= percent * union."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _between(batches: Iterator[pa.RecordBatch], least: float, percent: int) -> Iterator[pa.RecordBatch]:
    """Links on full sets between two blocks; those that join what is joined already need no row."""
    for rows in _grouped(batches, ("ga", "gb")):
        own = np.array([r["block"] for r in rows])
        left = np.flatnonzero(own == rows[0]["ga"])
        right = left if rows[0]["ga"] == rows[0]["gb"] else np.flatnonzero(own == rows[0]["gb"])
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while (p := up.get(c, c)) != c:
                c = p
            return c

        found = []
        for x, ys in _alike(rows, left, right, least, percent):
            for y in ys.tolist():
                a, b = root(rows[x]["comp"]), root(rows[y]["comp"])
                if a != b and _linked(rows[x]["set"], rows[y]["set"], percent):
                    up[max(a, b)] = min(a, b)
                    found.append((rows[x]["rep"], rows[y]["rep"]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([min(f) for f in found], pa.int64()), pa.array([max(f) for f in found], pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the least id reachable, for every id that undirected `links` (a, b) touch.

    Labels fall by neighbours' least label and then by pointer jumping until none moves; every round is written and the
    one before deleted, so a round's cost is its joins over links and labels, and no link or label is gathered in one
    place. Hub vertices cost one pre-aggregated row a task.
    """
    both = cut(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    labels = cut(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("id"), F.least("x", "y").alias("comp")))
    while True:
        near = both.join(labels, F.col("y") == F.col("id")).groupBy("x").agg(F.min("comp").alias("m"))
        down = labels.join(near, F.col("id") == F.col("x"), "left").select("id", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        up = labels.select(F.col("id").alias("up"), F.col("comp").alias("over"))
        moved = cut(down.join(up, F.col("comp") == F.col("up"), "left").select("id", F.least("comp", "over").alias("comp"), (F.least("comp", "over") != F.col("was")).alias("moved")))
        release(labels)
        labels = moved.select("id", "comp")
        if moved.where("moved").isEmpty():
            release(both)
            return labels


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, trees: int = 20, depth: int = 6, leaf: int = 600, block: int = 200, rounds: int = 3
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id reachable over links) and kept (id = component_id).

    Documents with 100 * intersection >= percent * union of their shingle sets are linked. Empty or null text has no set
    and links with nothing; fewer than `width` words make one shingle. A null id is never linked: component_id is null,
    kept true. Ids are whole numbers; rows that share an id are one vertex with the links of each. Extra columns are not
    read, whatever their names. An empty table gives no rows.

    How groups of copies stay cheap: equal sets meet by a grouped key. Then, on the first level of the trees, in up to
    `rounds` rounds every document is held against one head of its nodes that is not yet in its class (a pair a document
    and round), so a large group of near copies falls into few classes. Links within a class are not needed, so only
    nodes that still hold several classes go on, and of those only the ones with more than `leaf` documents outside their
    largest class branch deeper. In a node that ends, the documents outside the largest class are held against each other
    and against the class in parts of `leaf`, so each member of the class is there once however large it is. What comes
    out is not pairs but who is alike and which blocks of documents meet, so full sets are compared block by block, every
    pair that the sketches allow, and only links leave the task. Nodes that `depth` levels leave large are compared whole
    in parts. Only sketches (512 bytes) visit nodes; full sets are read for documents in surviving pairs.
    """
    need = percent / 100
    guess = need - 5 * (need * (1 - need) / COORDINATES) ** 0.5
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = cut(own.mapInArrow(lambda b: _sketch(b, width), "id long, n_shingles long, set_key binary, sig binary"))
    keyed = sketches.where("set_key is not null and id is not null")
    classes = cut(keyed.groupBy("set_key").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").cast("int").alias("size")))
    reps = classes.select("rep", "sig", "size")

    def populated(nodes: DataFrame) -> DataFrame:
        many = nodes.groupBy("node").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head < last").select("node", "head")
        return cut(nodes.join(cut(many), "node"))

    def sets_of(asked: DataFrame) -> DataFrame:
        return cut(own.join(asked, "id", "left_semi").mapInArrow(lambda x: _set_blobs(x, width), "rep long, set binary"))

    def confirm(pairs: DataFrame) -> DataFrame:
        a, b = (reps.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("size").alias(f"size_{x}")) for x in "ab")
        sized = pairs.join(a, "a").join(b, "b").where(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
        close = cut(sized.mapInArrow(lambda x: _estimated(x, guess), "a long, b long"))
        sets = sets_of(close.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        a, b = (sets.select(F.col("rep").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
        found = cut(close.join(a, "a").join(b, "b").mapInArrow(lambda x: _confirmed(x, percent), "a long, b long"))
        release(close, sets)
        return found

    spark = docs.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    comp = spark.createDataFrame([], "id long, comp long")
    same = lambda df, by, to: df.join(comp.select(F.col("id").alias(by), F.col("comp").alias(to)), by, "left").withColumn(to, F.coalesce(to, by))
    level = populated(reps.select("rep", "sig").mapInArrow(lambda b: _branch(b, trees, need), "node long, rep long"))
    for round_ in range(rounds):
        # one head a node, another one each round; of its nodes' heads in other classes, a document asks for one
        order = F.col("rep") if round_ == 0 else F.xxhash64("rep", F.lit(round_))
        heads = cut(level.groupBy("node").agg(F.min_by("rep", order).alias("now")))
        star = level.select("node", "rep").join(heads, "node").where("now <> rep").select("rep", F.col("now").alias("head")).distinct()
        apart = same(same(star, "rep", "comp_rep"), "head", "comp_head").where("comp_rep <> comp_head")
        first = F.col("head") if round_ == 0 else F.xxhash64("head", "rep", F.lit(round_))
        asked = apart.groupBy("rep").agg(F.min_by("head", first).alias("head"))
        found = confirm(asked.select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct())
        release(heads)
        if found.isEmpty():
            break
        links = links.unionByName(found)
        comp = components(links)

    def mixed(level: DataFrame) -> DataFrame:
        """Members of nodes of several classes: node, rep, head, comp, big (the largest class), most (its members), less (the others)."""
        placed = same(level, "rep", "comp")
        counts = placed.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("n"))
        nodes = counts.groupBy("node").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all")).where("all > top.n")
        return cut(placed.join(cut(nodes.select("node", F.col("top.comp").alias("big"), F.col("top.n").alias("most"), (F.col("all") - F.col("top.n")).alias("less"))), "node"))

    now = mixed(level)
    ended = now.where(F.col("less") <= leaf)
    for _ in range(depth - 1):
        large = now.where(F.col("less") > leaf)
        if large.isEmpty():
            break
        now = mixed(populated(cut(large.select("node", "rep").join(reps.select("rep", "sig"), "rep").mapInArrow(lambda b: _branch(b, trees, need), "node long, rep long"))))
        ended = ended.unionByName(now.where(F.col("less") <= leaf))
    ended = ended.unionByName(now.where(F.col("less") > leaf))
    same_id = keyed.join(classes.select("set_key", "rep"), "set_key").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    # blocks of about `block` documents by the least head of their nodes; a class of more than that there has its own
    anchors = cut(ended.groupBy("rep", "comp").agg(F.min("head").alias("anchor")))
    counts = anchors.groupBy("anchor", "comp").agg(F.count(F.lit(1)).alias("n")).select("anchor", "comp", "n", F.when(F.col("n") > block, F.col("comp")).alias("of"))
    sums = counts.groupBy("anchor", "of").agg(F.ceil(F.sum("n") / (2 * block)).alias("deal"))
    deals = cut(counts.join(sums.withColumnRenamed("anchor", "a").withColumnRenamed("of", "o"), (F.col("anchor") == F.col("a")) & F.col("of").eqNullSafe(F.col("o"))).select("anchor", "comp", "of", "deal"))
    blocks = anchors.join(deals, ["anchor", "comp"]).select("rep", "comp", F.expr("xxhash64(anchor, of, pmod(xxhash64(rep), deal))").alias("block"))
    about = cut(blocks.join(reps, "rep"))
    # parts of a node: first those of the documents outside its largest class, then those of the class
    small = F.col("most") + F.col("less") <= leaf
    parts = ended.withColumn("a", F.when(small, 1).otherwise(F.ceil(F.col("less") / leaf)).cast("int")).withColumn("p", F.when(small, 0).otherwise(F.ceil(F.col("most") / leaf)).cast("int"))
    parts = parts.withColumn("minor", small | (F.col("comp") != F.col("big"))).withColumn("part", F.expr("cast(if(minor, pmod(xxhash64(rep), a), a + pmod(xxhash64(rep), p)) as int)"))
    dealt = parts.withColumn("other", F.explode(F.expr("sequence(0, if(minor, a + p, a) - 1)"))).select("node", "rep", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    alike = cut(
        dealt.join(about, "rep").repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "rep")
        .mapInArrow(lambda b: _across(b, guess, percent), "rep long, ga long, gb long").distinct()
    )
    asked = alike.where("rep is not null").select("rep").distinct()
    known = cut(about.join(asked, "rep", "left_semi").join(sets_of(asked.withColumnRenamed("rep", "id")), "rep"))
    meet = alike.where("rep is null").select("ga", "gb")
    sides = meet.select("ga", "gb", F.explode(F.array_distinct(F.array("ga", "gb"))).alias("block"))
    second = cut(
        sides.join(known, "block").repartition("ga", "gb").sortWithinPartitions("ga", "gb", "rep")
        .mapInArrow(lambda b: _between(b, guess, percent), "a long, b long")
    )
    final = components(links.unionByName(second).unionByName(same_id))
    return (
        sketches.select("id", "n_shingles").join(final, "id", "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("comp", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )
