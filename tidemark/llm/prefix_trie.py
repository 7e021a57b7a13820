"""Conversation prefix trie: shared first turns as nodes of a tree, subtree totals by parallel tree contraction.

Contraction alternates two steps in join rounds. Rake: every leaf hands its total to its parent and goes. Compress: of a
chain of nodes with one child each, a node whose coin shows heads and whose child's does not goes, and its child hangs on
its parent by an edge that carries what went. Each round removes all leaves and a share of every chain, so rounds grow
with the logarithm of the tree, not with its depth. Then the nodes that compress removed are expanded again: the total of
each is that of the child it left behind and what stood between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release

#: Conversation ids of one end list's part: so many neighbouring ids at most meet in one row.
PART = 512
#: First turns are taken from the conversation whose id is the next lower multiple of this.
FAMILY = 20

_COMBINE = {"sum": lambda x, y: x + y, "bit_xor": lambda x, y: x.bitwiseXOR(y)}


def along(df: DataFrame, key: str, order: list[Column], **values: tuple[Column, str]) -> DataFrame:
    """df with running totals (a value and "sum" or "bit_xor") of the rows of each key in order, this row included.

    Rows are dealt by ranges of key and order, so a key of any size lies in many tasks; each range sums its own rows, and
    only one row for each range that a key reaches meets in the task that adds up what lies before.
    """
    rows = cut(df.repartitionByRange(key, *order).withColumn("_piece", F.spark_partition_id()))
    so_far = Window.partitionBy("_piece", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    fold = {name: getattr(F, kind) for name, (_, kind) in values.items()}
    pieces = rows.groupBy("_piece", key).agg(*[fold[name](value).alias(f"_{name}") for name, (value, _) in values.items()])
    moved = pieces.withColumns({f"_{name}": fold[name](f"_{name}").over(before) for name in values}).where(" or ".join(f"_{name} is not null" for name in values))
    own = rows.withColumns({name: fold[name](value).over(so_far) for name, (value, _) in values.items()})
    whole = {name: _COMBINE[kind](F.col(name), F.coalesce(f"_{name}", F.lit(0))) for name, (_, kind) in values.items()}
    return own.join(moved, ["_piece", key], "left").withColumns(whole).drop("_piece", *[f"_{name}" for name in values])


def subtree_totals(tree: DataFrame, sums: list[str]) -> DataFrame:
    """(id, sums): for every node of a forest (id, parent, sums) its own values and those of all nodes below it.

    parent is null for roots; ids are unique and may be of any type. A parent of very many children costs one combined
    row a task when they are raked, and joins on a parent are sort-merge joins of written tables, which adaptive
    execution may split. An empty table gives no rows.
    """
    zero = F.lit(0).cast("long")
    children = tree.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    alive = cut(tree.join(children, "id", "left").select("id", "parent", F.coalesce("k", zero).alias("k"), *sums, *[zero.alias(f"edge_{s}") for s in sums]))
    raked, spliced, turn = [], [], 0
    while True:
        turn += 1
        leaves = alive.where("k = 0")
        raked.append(leaves.select("id", *sums))
        gifts = leaves.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("gone"), *[F.sum(F.col(s) + F.col(f"edge_{s}")).alias(f"gift_{s}") for s in sums])
        coin = (F.col("k") == 1) & F.col("parent").isNotNull() & (F.xxhash64("id", F.lit(turn)).bitwiseAND(1) == 1)
        rest = alive.where("k > 0").join(gifts, "id", "left").withColumns({"k": F.col("k") - F.coalesce("gone", zero), **{s: F.col(s) + F.coalesce(f"gift_{s}", zero) for s in sums}})
        rest = cut(rest.select(*alive.columns).withColumn("heads", coin))
        left, unary = rest.agg(F.count(F.lit(1)), F.count_if("heads")).first()
        if not left:
            break
        if not unary:
            alive = rest.drop("heads")
            continue
        chain = rest.where("heads").select(F.col("id").alias("v"), F.col("parent").alias("above"), *[F.col(s).alias(f"v_{s}") for s in sums], *[F.col(f"edge_{s}").alias(f"v_edge_{s}") for s in sums])
        met = cut(rest.join(chain, (F.col("parent") == F.col("v")) & ~F.col("heads"), "left"))
        out = met.where("v is not null")
        spliced.append(out.select(F.col("v").alias("id"), F.col("id").alias("to"), *[(F.col(f"v_{s}") + F.col(f"edge_{s}")).alias(s) for s in sums]))
        edges = {f"edge_{s}": F.col(f"edge_{s}") + F.coalesce(F.col(f"v_{s}") + F.col(f"v_edge_{s}"), zero) for s in sums}
        stay = met.join(out.select(F.col("v").alias("id")), "id", "left_anti").withColumns({"parent": F.coalesce("above", "parent"), **edges})
        alive = cut(stay.select(*alive.columns))
        release(rest)
    totals = raked[0]
    for more in raked[1:]:
        totals = totals.unionByName(more)
    if not spliced:
        return totals
    back = spliced[0]
    for more in spliced[1:]:
        back = back.unionByName(more)
    back = cut(back)
    while True:  # whose child went later is led on to the child that this one left
        onward = back.select(F.col("id").alias("to"), F.col("to").alias("next"), *[F.col(s).alias(f"next_{s}") for s in sums])
        longer = cut(back.join(onward, "to", "left"))
        moved = longer.where("next is not null").limit(1).count()
        release(back)
        back = longer.select("id", F.coalesce("next", "to").alias("to"), *[(F.col(s) + F.coalesce(f"next_{s}", zero)).alias(s) for s in sums])
        if not moved:
            break
        back = cut(back)
    totals = cut(totals)
    ends = totals.select(F.col("id").alias("to"), *[F.col(s).alias(f"end_{s}") for s in sums])
    return totals.unionByName(back.join(ends, "to").select("id", *[(F.col(s) + F.col(f"end_{s}")).alias(s) for s in sums]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined parts of every node; rows come sorted by node and part, and pass one by one."""
    node, state = None, None
    for batch in batches:
        out = []
        for depth, a, b, part in zip(*(batch.column(c).to_pylist() for c in ("depth", "a", "b", "part"))):
            if (depth, a, b) == node:
                state.update(b"," + part.encode())
            else:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (depth, a, b), hashlib.sha256(part.encode())
        yield _digest_rows(out)
    if node:
        yield _digest_rows([(*node, state.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    depth, a, b, digest = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(digest, pa.string())], ["depth", "a", "b", "ends_sha256"])


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """(c, depth, x, y, n): the turns of every conversation after its first ones are taken from the head of its family,
    as two hashes and a number of words; depth 0 is the root, which every conversation has."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", blank("role").alias("role"), blank("text").alias("text"))
    numbered = along(turns, "c", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], i=(F.lit(1), "sum"))
    own = cut(
        numbered.select("c", (F.col("i") - 1).alias("i"), F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit("second"), "role", "text").alias("y"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n"))
    )
    lengths = own.groupBy("c").agg(F.count(F.lit(1)).alias("turns"))
    heads = lengths.where(f"c % {FAMILY} = 0").select(F.col("c").alias("head"), F.col("turns").alias("there"))
    asked = lengths.select("c", (F.col("c") - F.col("c") % FAMILY).alias("head"), (F.crc32(F.col("c").cast("string")) % 4).alias("h")).join(heads, "head", "left")
    convs = cut(asked.select("c", "head", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("given")))
    first = own.where(f"c % {FAMILY} = 0 and i < 3").withColumnRenamed("c", "head")
    given = convs.where("given > 0").join(first, "head").where("i < given").select("c", (F.col("i") + 1).alias("depth"), "x", "y", "n")
    kept = own.join(convs, "c").where("i >= h").select("c", (F.col("given") + F.col("i") - F.col("h") + 1).alias("depth"), "x", "y", "n")
    zero = F.lit(0).cast("long")
    return convs.select("c", zero.alias("depth"), zero.alias("x"), zero.alias("y"), zero.alias("n")).unionByName(given).unionByName(kept)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (conv_id, turn, role, text): conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by number, null first; turns of one number by role, then text; rows that repeat are turns of their
    own. Null role or text is empty; rows without a conv_id are no conversation; an empty table gives no rows, not even a
    root. Extra columns are not read, whatever their names. A node is known by its depth and two 64-bit hashes made by
    exclusive or of hashes of its turns and their places: two unlike beginnings meet with a probability of 2**-128.

    Plan: text is shuffled once, to be ordered, and then goes on as hashes. Members, children and gifts of leaves combine
    before the shuffle. The ids that end in one node are joined in parts of 512 neighbouring ids and hashed part by part
    as they stream by in order: a hash of all of them has to pass one task, but never lies in its memory.
    """
    salted = rebuilt_turns(conversations).select("c", "depth", "n", *[F.when(F.col("depth") > 0, F.xxhash64("depth", h)).otherwise(F.lit(0)).alias(f"h{h}") for h in "xy"])
    prefixes = cut(along(salted, "c", [F.col("depth")], a=(F.col("hx"), "bit_xor"), b=(F.col("hy"), "bit_xor")))
    above = [F.min(F.col(p).bitwiseXOR(F.col(h))).alias(f"up_{p}") for p, h in (("a", "hx"), ("b", "hy"))]
    nodes = cut(prefixes.groupBy("depth", "a", "b").agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n").alias("words"), *above))
    ups = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    placed = cut(nodes.join(ups, ["depth", "up_a", "up_b"], "left"))
    children = placed.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"))
    grown = cut(placed.join(children, ["depth", "conv_id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    tree = grown.select(
        F.struct("depth", "conv_id").alias("id"), F.when(F.col("depth") > 0, F.struct((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id"))).alias("parent"),
        (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"]).select("id.depth", "id.conv_id", "n_leaves", "saved_tokens")
    last = prefixes.groupBy("c").agg(F.max("depth").alias("depth"), F.max_by("a", "depth").alias("a"), F.max_by("b", "depth").alias("b"))
    parts = last.groupBy("depth", "a", "b", F.shiftright("c", PART.bit_length() - 1).alias("at")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("part"))
    ends = parts.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "at").mapInArrow(_digests, "depth long, a long, b long, ends_sha256 string")
    return (
        grown.join(totals, ["depth", "conv_id"]).join(ends, ["depth", "a", "b"], "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    )
