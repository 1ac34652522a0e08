"""Parent-child links to full hierarchies: nested-set ranges, depth, root, paths, descendants and cycles.

Subtree sizes are computed upward, ranges for siblings are allotted downward by prefix sums over these sizes,
and ``first..last`` (the preorder numbers of a node's subtree) then answer every ancestor and descendant question
by comparison. Nodes that the downward pass never reaches lie on a circle of links, or below one.

Groups (traces) of up to ``limit`` rows are worked off in streams of whole groups with numpy; larger ones, by the same method,
as distributed joins whose number of rounds is the logarithm of the depth. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.session import materialise

#: Groups above this many rows take the distributed way.
LARGE_GROUP = 200_000
#: Rows that a Python worker gathers before it works them off.
CHUNK_ROWS = 60_000
NODE_SCHEMA = "grp string, node string, parent string, root string, depth long, first long, last long"
_ARROW = pa.schema(
    [(n, pa.string()) for n in ("grp", "node", "parent", "root")] + [(n, pa.int64()) for n in ("depth", "first", "last")]
)


def stated_parent(parent: Column) -> Column:
    """A parent id in lower case; null where none is stated: null, blank or only zeros."""
    p = F.lower(F.trim(parent))
    return F.when(p.rlike("[^0]"), p)


def _number(par: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """Root, depth, first and last of each node. par: index of the parent, -1 for a root. rank: order among siblings."""
    n = len(par)
    has = par >= 0
    waiting = np.bincount(par[has], minlength=n)
    size = np.ones(n, np.int64)
    level = np.flatnonzero(waiting == 0)  # upward: leaves first
    while len(level):
        level = level[par[level] >= 0]
        up = par[level]
        np.add.at(size, up, size[level])
        np.subtract.at(waiting, up, 1)
        up = np.unique(up)
        level = up[waiting[up] == 0]
    order = np.lexsort((rank, par))  # siblings side by side, roots (-1) in front
    ahead = np.cumsum(size[order]) - size[order]
    sorted_par = par[order]
    opens = np.r_[True, sorted_par[1:] != sorted_par[:-1]] if n else np.zeros(0, bool)
    base = ahead[opens][np.cumsum(opens) - 1] if n else ahead
    offset = np.empty(n, np.int64)
    offset[order] = ahead - base
    starts = np.searchsorted(sorted_par, np.arange(n), "left")
    ends = np.searchsorted(sorted_par, np.arange(n), "right")
    root, depth, first = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    level = np.flatnonzero(par == -1)  # downward: roots first
    root[level], depth[level], first[level] = level, 0, offset[level]
    while len(level):
        count = ends[level] - starts[level]
        owner = np.repeat(level, count)
        child = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[level], count)]
        root[child], depth[child], first[child] = root[owner], depth[owner] + 1, first[owner] + 1 + offset[child]
        level = child
    last = np.where(first >= 0, first + size - 1, -1)
    return root, depth, first, last


def _work_off(table: pa.Table) -> pa.Table:
    """All groups of ``table`` (grp, node, parent), each group whole and its rows side by side."""
    table = table.combine_chunks()
    grp, node, parent = (table.column(i) for i in range(3))
    codes = pa.chunked_array([*node.chunks, *parent.chunks], pa.string()).combine_chunks().dictionary_encode()
    ids = codes.dictionary.take(rank_order := pc.sort_indices(codes.dictionary))
    place = np.empty(len(ids) + 1, np.int64)
    place[rank_order.to_numpy()] = np.arange(len(ids))
    flat = codes.indices.fill_null(len(ids)).to_numpy()
    place[-1] = -1
    flat = place[flat]
    n = len(table)
    own, up = flat[:n], flat[n:]
    g = grp.combine_chunks().dictionary_encode()
    gi = g.indices.to_numpy().astype(np.int64)
    width = len(ids) + 1
    key = gi * width + own
    order = np.lexsort((np.where(up < 0, width, up), key))  # of a node's copies the smallest stated parent counts
    key, own, up, gi = key[order], own[order], up[order], gi[order]
    keep = np.r_[True, key[1:] != key[:-1]]
    key, own, up, gi = key[keep], own[keep], up[keep], gi[keep]
    at = np.searchsorted(key, gi * width + up)
    at[at == len(key)] = 0
    par = np.where((up >= 0) & (key[at] == gi * width + up), at, -1)
    root, depth, first, last = _number(par, np.arange(len(key)))
    # Numbers start at 0 in each group.
    roots_before = np.full(len(g.dictionary), np.iinfo(np.int64).max)
    seen = first >= 0
    np.minimum.at(roots_before, gi[seen], first[seen])
    shift = np.where(seen, roots_before[gi], 0)
    return pa.table(
        [
            g.dictionary.take(pa.array(gi)),
            ids.take(pa.array(own)),
            ids.take(pa.array(up, mask=up < 0)),
            ids.take(pa.array(own[np.maximum(root, 0)], mask=root < 0)),
            pa.array(depth),
            pa.array(first - shift),
            pa.array(last - shift),
        ],
        schema=_ARROW,
    )


def _small_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < CHUNK_ROWS:
            continue
        table = pa.Table.from_batches(held)
        g = table.column(0)
        tail = pc.equal(g, g[len(g) - 1])  # the last group may go on
        cut = len(g) - pc.sum(tail).as_py()
        if cut:
            yield from _work_off(table.slice(0, cut)).to_batches()
        held = table.slice(cut).combine_chunks().to_batches()
        rows = len(g) - cut
    if held:
        yield from _work_off(pa.Table.from_batches(held)).to_batches()


def _until_done(state: DataFrame, step, name: str) -> DataFrame:
    """Double pointers until no further node reaches its root; what is left over never will."""
    left = state.where("jump is not null").count()
    while left:
        state = materialise(step(state), name)
        now = state.where("jump is not null").count()
        if now == left:
            break
        left = now
    return state


def _large_groups(nodes: DataFrame) -> DataFrame:
    """The distributed way: pointer doubling, where round k joins each node with its ancestor 2^k links above."""
    spread = nodes.groupBy("grp", "node").agg(F.min("parent").alias("parent"))
    known = spread.select("grp", F.col("node").alias("parent"), F.lit(True).alias("there"))
    base = materialise(
        spread.join(known, ["grp", "parent"], "left").select("grp", "node", "parent", F.when(F.col("there"), F.col("parent")).alias("up")),
        "tree",
    )

    def hop(state: DataFrame, *carry: Column) -> DataFrame:
        other = state.select("grp", F.col("node").alias("jump"), F.col("jump").alias("next"), *[F.col(c).alias(f"o_{c}") for c in ("far", "dist", "acc")])
        on = state.join(other, ["grp", "jump"], "left")
        return on.select("grp", "node", "parent", "up", *carry, F.col("next").alias("jump"), F.coalesce("o_far", "far").alias("far"),
            (F.col("dist") + F.coalesce("o_dist", F.lit(0))).alias("dist"), (F.col("acc") + F.coalesce("o_acc", F.lit(0))).alias("acc"))

    def upward(state: DataFrame) -> DataFrame:
        below = state.where("jump is not null").groupBy("grp", F.col("jump").alias("node")).agg(F.sum("size").alias("more"))
        grown = state.join(below, ["grp", "node"], "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more")
        return hop(grown, F.col("size"))

    start = base.select("*", F.lit(1).cast("long").alias("size"), F.col("up").alias("jump"), F.coalesce("up", "node").alias("far"),
        F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.lit(0).cast("long").alias("acc"))
    sized = _until_done(start, upward, "sizes")
    # Prefix sums over siblings in two levels, so that a node with a third of all rows as children is spread.
    split = sized.select("grp", "node", "parent", "up", "size", F.col("jump").isNotNull().alias("lost"), "far", "dist", F.coalesce(F.substring("node", 1, 2), F.lit("")).alias("part"))
    parts = split.where("not lost").groupBy("grp", "up", "part").agg(F.sum("size").alias("part_size"))
    ahead = W.partitionBy("grp", "up").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("grp", F.coalesce("up", F.lit("")).alias("up_"), "part", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("part_ahead"))
    beside = W.partitionBy("grp", "up", "part").orderBy("node").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        split.withColumn("near", F.coalesce(F.sum(F.when(~F.col("lost"), F.col("size"))).over(beside), F.lit(0)))
        .withColumn("up_", F.coalesce("up", F.lit("")))
        .join(parts, ["grp", "up_", "part"], "left")
        .select("grp", "node", "parent", "up", "size", "lost", "far", "dist",
            (F.col("near") + F.coalesce("part_ahead", F.lit(0)) + F.when(F.col("up").isNull(), 0).otherwise(1)).alias("step"))
    )
    offsets = materialise(offsets, "offsets")
    lost = offsets.where("lost").select("grp", "node", "parent", F.lit(None).cast("string").alias("root"), *[F.lit(-1).cast("long").alias(c) for c in ("depth", "first", "last")])
    walk = offsets.where("not lost").select("grp", "node", "parent", "up", "size", F.col("dist").alias("depth"), F.col("far").alias("root"),
        F.col("up").alias("jump"), F.coalesce("up", "node").alias("far"), F.lit(0).cast("long").alias("dist"), F.col("step").alias("acc"))
    numbered = _until_done(walk, lambda s: hop(s, F.col("size"), F.col("depth"), F.col("root")), "preorder")
    found = numbered.select("grp", "node", "parent", "root", "depth", F.col("acc").alias("first"), (F.col("acc") + F.col("size") - 1).alias("last"))
    return found.unionByName(lost)


def hierarchy(df: DataFrame, group: str, node: str, parent: str, limit: int = LARGE_GROUP) -> DataFrame:
    """One row per distinct node: ``grp, node, parent, root, depth, first, last``, ids in lower case.

    ``parent`` is what the row states (null where none is stated); a node whose parent is not in its group, or states none, is a root
    of depth 0. ``first..last`` are the preorder numbers of its subtree within the group, siblings in order of id, so that
    ``a.first <= d.first and d.first <= a.last`` says that d descends from a (or is a). On a circle of links, or below one: root null,
    depth, first and last -1. Of repeated rows the smallest stated parent counts. Rows whose group or node is null are left out; an
    empty table gives an empty result; other columns are ignored."""
    links = df.select(
        F.col(group).alias("grp"), F.lower(F.trim(F.col(node))).alias("node"), stated_parent(F.col(parent)).alias("parent")
    ).where("grp is not null and node is not null")
    large = materialise(links.groupBy("grp").count().where(F.col("count") > limit).select("grp"), "large-groups")  # at most rows / limit names
    some = bool(large.limit(1).count())
    small = links.join(large, "grp", "left_anti") if some else links
    done = small.repartition("grp").sortWithinPartitions("grp").mapInArrow(_small_groups, NODE_SCHEMA)
    return done.unionByName(_large_groups(links.join(large, "grp", "left_semi"))) if some else done


#: Preorder numbers per bucket of the range join.
RANGE_BUCKET = 64


def descendants(tree: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """All descendants of the nodes in ``of`` (grp, node; without it, of all nodes): ``grp, node, descendant, distance``, by nested-set ranges. Ranges and numbers meet in buckets
    of RANGE_BUCKET numbers, so beside the result only the two buckets at a range's ends are compared. Nodes on circles have none."""
    tree = tree.where("depth >= 0")
    a = tree.where("last > first")
    if of is not None:
        a = a.join(of.select("grp", "node").distinct(), ["grp", "node"], "left_semi")
    bucket = lambda c: F.floor(c / RANGE_BUCKET).cast("long")
    a = a.select("grp", "node", F.col("first").alias("low"), F.col("last").alias("high"), F.col("depth").alias("above"),
        F.explode(F.sequence(bucket(F.col("first") + 1), bucket(F.col("last")))).alias("bucket"))
    d = tree.select("grp", F.col("node").alias("descendant"), "first", "depth", bucket(F.col("first")).alias("bucket"))
    near = a.join(d, ["grp", "bucket"]).where((F.col("first") > F.col("low")) & (F.col("first") <= F.col("high")))
    return near.select("grp", "node", "descendant", (F.col("depth") - F.col("above")).alias("distance"))


#: Preorder numbers per task of ``paths``.
PATH_BUCKET = 50_000


def paths(tree: DataFrame, bucket: int = PATH_BUCKET) -> DataFrame:
    """Adds ``path``: the ids from the root to the node as an array (empty on circles). A scan in preorder keeps the open ancestors, one path at a time. Groups are parted by ``bucket`` preorder
    numbers, so a tree with a third of all rows is spread; a part gets the ancestors of its first node beside its own (nodes whose range
    reaches into it), which are fewer than the ids in that node's path."""
    low, high = (F.floor(F.col(c) / bucket).cast("long") for c in ("first", "last"))
    own = tree.select("*", low.alias("part"), F.lit(True).alias("own"))
    over = tree.where(high > low).select("*", F.explode(F.sequence(low + 1, high)).alias("part"), F.lit(False).alias("own"))
    return (
        own.unionByName(over)
        .repartition("grp", "part")
        .sortWithinPartitions("grp", "part", "first")
        .mapInArrow(_walk_paths, NODE_SCHEMA + ", path array<string>")
    )


def _walk_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part: tuple = ()
    stack: list[str] = []
    for batch in batches:
        rows = []
        for g, p, node, depth, own in zip(*(batch.column(i).to_pylist() for i in (0, 7, 1, 4, 8)), strict=True):
            if depth < 0:
                rows.append([])
                continue
            if (g, p) != part:
                part, stack = (g, p), []
            del stack[depth:]
            stack.append(node)
            if own:
                rows.append(list(stack))
        kept = batch.filter(batch.column(8))
        yield pa.RecordBatch.from_arrays([*kept.columns[:7], pa.array(rows, pa.list_(pa.string()))], names=[*batch.schema.names[:7], "path"])
