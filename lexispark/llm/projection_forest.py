"""Near-duplicate vectors of equal label by a forest of random-projection trees.

Each tree splits the unit vectors at the median of a random direction, level by level; a vector within ``spill`` of a
split goes to both sides. A tree has one direction for each level, made from a seed, and a split for each inner node,
so trees of millions of leaves are short tables of numbers. Their upper levels are fitted on a bounded sample; leaves
that then hold many vectors are split further, each on a bounded sample of its own, until they are small or cannot be
split (copies that all lie together). Every vector is sorted into every tree. Vectors of one label that share a leaf are
compared exactly (cosine in double precision) and linked from 0.98 on; components are the union of all links.

Exact copies are one class and are compared once; their counts enter the links. A pair that shares several leaves
is counted in the first of them only, so no pair has to be written out to count links once: a leaf gives each
vector its number of links there and one edge to its component in the leaf. A leaf with many rows is compared in
pairs of blocks, each a task of bounded size.

Defined results: a row with a null label, or a vector that is null, empty, zero or holds a null or non-finite
component, has no links and is its own component; vectors of different lengths do not link; a row with a null
vec_id takes no part (component null, kept); every row counts as a vector, also one that repeats, and rows that share a
vec_id but not the vector are different vectors (each has its own links); an empty table gives an empty result; other
columns, whatever their names, pass unread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.graph import components
from lexispark.llm.runtime import Stage, bounded_batches, small

THRESHOLD = 0.98
TREES = 4
#: Vectors that a tree's upper levels, and each further leaf, are fitted on: those with the lowest hashes.
SAMPLE, LEAF_SAMPLE = 8000, 2000
#: Rows, of all labels, that a leaf should have at most, and from how many on a leaf is split further.
LEAF_ROWS, LARGE_LEAF = 2000, 8000
#: A split is worth it if no more than this share of the rows goes to both sides; levels that may be passed over.
MOST_SPILL, PASSED = 0.4, 6
#: Levels of a tree (node numbers are 64 bits), and rounds of further splits.
LEVELS, ROUNDS = 48, 6
#: Rows of a block: a task compares two blocks.
BLOCK = 1024


@dataclass
class Tree:
    """Nodes are numbered as in a heap: 1, and 2i and 2i + 1 below i. ``node`` are the inner ones, sorted, with the
    ``split`` of each (NaN: passed over, all rows go to 2i); a number that is not there is a leaf."""

    seed: int
    dim: int
    node: np.ndarray
    split: np.ndarray

    def directions(self) -> np.ndarray:
        d = np.random.default_rng(self.seed).normal(size=(self.dim, LEVELS))
        return d / np.linalg.norm(d, axis=0)

    def add(self, node: np.ndarray, split: np.ndarray) -> Tree:
        node, split = np.concatenate([self.node, node]), np.concatenate([self.split, split])
        order = np.argsort(node, kind="stable")
        return Tree(self.seed, self.dim, node[order], split[order])

    def leaves(self, x: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each vector reaches."""
        p = x @ self.directions()
        row, at, level = np.arange(len(x)), np.ones(len(x), np.int64), 0
        rows, ends = [], []
        while len(row):
            pos = np.minimum(np.searchsorted(self.node, at), max(0, len(self.node) - 1))
            inner = self.node[pos] == at if len(self.node) else np.zeros(len(row), bool)
            rows.append(row[~inner])
            ends.append(at[~inner])
            row, at, pos = row[inner], at[inner], pos[inner]
            far = p[row, min(level, LEVELS - 1)] - self.split[pos]
            left, right = ~(far > spill), far > -spill  # a passed node's NaN goes left
            row, at, level = np.concatenate([row[left], row[right]]), np.concatenate([2 * at[left], 2 * at[right] + 1]), level + 1
        return (np.concatenate(rows), np.concatenate(ends)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def grown(p: np.ndarray, node: int, rows: float, spill: float, leaf_rows: int = LEAF_ROWS) -> tuple[list[int], list[float]]:
    """Inner nodes and splits below ``node``, for leaves of about ``leaf_rows`` of ``rows`` vectors, from a sample's
    projections on the directions of all levels."""
    nodes, splits, todo = [], [], [(node, np.arange(len(p)), rows, 0)]
    while todo:
        node, at, rows, passed = todo.pop()
        level = node.bit_length() - 1
        if rows <= leaf_rows or len(at) < 16 or level >= LEVELS:
            continue
        here = p[at, level]
        cut = float(np.median(here))
        left, right = ~(here - cut > spill), here - cut > -spill
        if (left & right).mean() > MOST_SPILL or not (here > cut).any():
            if passed < PASSED:
                nodes.append(node)
                splits.append(np.nan)
                todo.append((2 * node, at, rows, passed + 1))
            continue
        nodes.append(node)
        splits.append(cut)
        todo += [(2 * node, at[left], rows * left.mean(), 0), (2 * node + 1, at[right], rows * right.mean(), 0)]
    ends = set(nodes)
    while dead := [i for i, (n, s) in enumerate(zip(nodes, splits)) if np.isnan(s) and 2 * n not in ends]:  # passed for nothing
        ends -= {nodes[i] for i in dead}
        nodes, splits = ([v for i, v in enumerate(z) if i not in set(dead)] for z in (nodes, splits))
    return nodes, splits


def fit(sample: np.ndarray, rows: int, seed: int, spill: float = 0.0, leaf_rows: int = LEAF_ROWS) -> Tree:
    """A tree over ``sample`` (unit vectors) whose leaves have about ``leaf_rows`` of ``rows`` vectors."""
    tree = Tree(seed, sample.shape[1], np.zeros(0, np.int64), np.zeros(0))
    nodes, splits = grown(sample @ tree.directions(), 1, float(rows), spill, leaf_rows) if len(sample) else ([], [])
    return tree.add(np.array(nodes, np.int64), np.array(splits, float))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (by their largest component first, which keeps squares in range)."""
    v = vectors / np.maximum(np.abs(vectors).max(axis=1, keepdims=True), np.finfo(float).tiny)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of up to ``dim`` numbers as rows, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim))
    out[np.arange(dim)[None, :] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


#: ``places`` are the numbers ``tree << _SHIFT | leaf`` of all leaves of a vector, ascending.
_SHIFT = LEVELS + 1
_ROUTED = "tree int, leaf long, label long, dim int, cid long, copies long, v array<double>, places array<long>"


def _route(batches, forest, dim: int, spill: float):
    """A row for each vector and leaf."""
    for batch in batches:
        if not batch.num_rows:
            continue
        row, tree, leaf = _places(batch, forest, dim, spill)
        ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((tree << _SHIFT) | leaf))
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(tree.astype(np.int32)), pa.array(leaf), *[batch.column(c).take(take) for c in ("label", "dim", "cid", "copies", "v")], lists.take(take)],
            ["tree", "leaf", "label", "dim", "cid", "copies", "v", "places"],
        )


def _places(batch, forest, dim: int, spill: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, tree, leaf), sorted."""
    x = unit(_matrix(batch.column("v"), dim))
    found = [(*tree.leaves(x, spill), t) for t, tree in enumerate(forest)]
    row, leaf = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    tree = np.repeat([t for _, _, t in found], [len(r) for r, _, _ in found])
    order = np.lexsort((leaf, tree, row))
    return row[order], tree[order].astype(np.int64), leaf[order]


def _tallied(batches, forest, dim: int, spill: float):
    """How many vectors of a task reach each leaf."""
    total: dict[tuple[int, int], int] = {}
    for batch in batches:
        if batch.num_rows:
            _, tree, leaf = _places(batch, forest, dim, spill)
            pair, n = np.unique(np.stack([tree, leaf], 1), axis=0, return_counts=True)
            for (t, k), c in zip(pair.tolist(), n.tolist()):
                total[t, k] = total.get((t, k), 0) + c
    yield pa.RecordBatch.from_pydict({"tree": pa.array([t for t, _ in total], pa.int32()), "leaf": pa.array([k for _, k in total], pa.int64()), "rows": pa.array(list(total.values()), pa.int64())})


def _chosen(batches, forest, dim: int, spill: float, large: dict[tuple[int, int], int]):
    """Of each large leaf the vectors of a sample of about ``LEAF_SAMPLE``, by a hash of the class."""
    for batch in batches:
        if not batch.num_rows:
            continue
        row, tree, leaf = _places(batch, forest, dim, spill)
        size = np.array([large.get(k, 0) for k in zip(tree.tolist(), leaf.tolist())])
        share = np.array(batch.column("share"))[row]
        on = (size > 0) & (share * size < LEAF_SAMPLE)
        yield pa.RecordBatch.from_arrays([pa.array(tree[on].astype(np.int32)), pa.array(leaf[on]), pa.array(size[on]), batch.column("v").take(pa.array(row[on]))], ["tree", "leaf", "size", "v"])


def _refiner(forest, dim: int, spill: float, leaf_rows: int):
    """A function that gives the nodes that split one large leaf further."""

    def refined(table: pa.Table) -> pa.Table:
        tree, leaf, size = (table.column(c)[0].as_py() for c in ("tree", "leaf", "size"))
        x = unit(_matrix(table.column("v"), dim))
        nodes, splits = grown(x @ forest.value[tree].directions(), leaf, float(size), spill, leaf_rows)
        return pa.table({"tree": pa.array([tree] * len(nodes), pa.int32()), "node": pa.array(nodes, pa.int64()), "split": pa.array(splits, pa.float64())})

    return refined


def grow_forest(classes: DataFrame, rows: int, dim: int, spill: float, trees: int, seed: int, leaf_rows: int, large_leaf: int, sample: int) -> list[Tree]:
    """Trees whose leaves have some ``leaf_rows`` of the classes each, as far as these can be split.

    What comes to the driver are a bounded sample, the sizes of the large leaves and the splits: some numbers for
    every ``leaf_rows`` vectors.
    """
    spark = classes.sparkSession
    few = classes.orderBy(F.xxhash64("cid", F.lit(seed)), "cid").limit(sample).select("v").toArrow()
    x = unit(_matrix(few.column("v"), dim))
    forest = [fit(x, rows, seed + t, spill, leaf_rows) for t in range(trees)]
    if rows <= large_leaf:
        return forest
    done: set[tuple[int, int]] = set()
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(forest)
        tally = classes.select("v").mapInArrow(lambda b, s=shared: _tallied(b, s.value, dim, spill), "tree int, leaf long, rows long")
        found = tally.groupBy("tree", "leaf").agg(F.sum("rows").alias("rows")).where(F.col("rows") > large_leaf).collect()
        large = {(r["tree"], r["leaf"]): r["rows"] for r in found if (r["tree"], r["leaf"]) not in done}
        if not large:
            break
        done |= set(large)
        share = (F.xxhash64("cid", F.lit(seed + 1)).bitwiseAND((1 << 52) - 1) / float(1 << 52)).alias("share")
        kind = "tree int, leaf long, size long, v array<double>"
        chosen = classes.select("v", share).mapInArrow(lambda b, s=shared, g=large: _chosen(b, s.value, dim, spill, g), kind)
        more = chosen.groupBy("tree", "leaf").applyInArrow(_refiner(shared, dim, spill, leaf_rows), "tree int, node long, split double").toArrow()
        if not more.num_rows:
            break
        of, node, split = (more.column(c).to_numpy() for c in ("tree", "node", "split"))
        forest = [tree.add(node[of == t], split[of == t]) for t, tree in enumerate(forest)]
    return forest


_FOUND = "cid long, links long, root long"


def _linked(table: pa.Table, threshold: float) -> pa.Table:
    """Links of one block pair of a leaf: each vector's number of links counted here, and its component's least id."""
    part, low, high = (table.column(c).to_numpy() for c in ("part", "low", "high"))
    cid, copies = table.column("cid").to_numpy(), table.column("copies").to_numpy()
    here = (int(table.column("tree")[0].as_py()) << _SHIFT) | int(table.column("leaf")[0].as_py())
    x = unit(_matrix(table.column("v"), int(table.column("dim")[0].as_py())))
    lists = table.column("places").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    places = np.full((len(cid), int(size.max())), -1, dtype=np.int64)
    places[np.arange(places.shape[1])[None, :] < size[:, None]] = lists.flatten().to_numpy()
    own = low[0] == high[0]
    left = np.arange(len(cid)) if own else np.flatnonzero(part == low[0])
    right = left if own else np.flatnonzero(part == high[0])
    links, root = np.zeros(len(cid), dtype=np.int64), np.arange(len(cid))
    ps, qs = [], []
    for i in range(0, len(left), 256):
        p, q = np.nonzero(x[left[i : i + 256]] @ x[right].T >= threshold)
        p, q = left[i + p], right[q]
        if own:
            p, q = p[p < q], q[p < q]
        for j in range(0, len(p), 20_000):
            a, b = p[j : j + 20_000], q[j : j + 20_000]
            pa_, pb_ = places[a], places[b]
            shared = (pa_[:, :, None] == pb_[:, None, :]) & (pa_ >= 0)[:, :, None]
            first = np.where(shared.any(axis=2), pa_, np.iinfo(np.int64).max).min(axis=1)
            on = first == here  # another leaf that both are in counts the others
            ps.append(a[on])
            qs.append(b[on])
    p, q = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (ps, qs))
    np.add.at(links, p, copies[q])
    np.add.at(links, q, copies[p])
    order = np.argsort(cid, kind="stable")
    rank = np.empty(len(cid), dtype=np.int64)
    rank[order] = np.arange(len(cid))
    root, before = rank.copy(), None
    while before is None or not np.array_equal(root, before):
        before = root.copy()
        np.minimum.at(root, p, before[q])
        np.minimum.at(root, q, before[p])
        root = np.minimum(root, root[order[root]])
    on = links > 0
    return pa.table({"cid": cid[on], "links": links[on], "root": cid[order[root[on]]]}, schema=pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]))


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, seed: int = 17, leaf_rows: int = LEAF_ROWS, large_leaf: int = LARGE_LEAF, block: int = BLOCK, sample: int = SAMPLE
) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    stage = Stage(spark, "projection-forest")
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    given = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.when(usable, v).alias("v"))
    keyed = stage.table(given.select("vec_id", "label", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("d1"), F.xxhash64(F.reverse("v")).alias("d2"), "v"))
    classes = stage.table(
        keyed.where("v is not null").groupBy("label", "d1", "d2")
        .agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
        .withColumn("dim", F.size("v")).withColumn("cid", F.monotonically_increasing_id())
    )
    total = classes.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    known = classes.select("label", "d1", "d2", "cid", "rep", "copies")
    if total["n"]:
        dim = total["dim"]
        spill = 0.8 * float(np.sqrt(2 * (1 - threshold) / dim))
        forest = spark.sparkContext.broadcast(grow_forest(classes, total["n"], dim, spill, trees, seed, leaf_rows, large_leaf, sample))
        routed = stage.table(classes.select("label", "dim", "cid", "copies", "v").mapInArrow(lambda b: _route(b, forest.value, dim, spill), _ROUTED))
        leaf = ["tree", "leaf", "label", "dim"]
        sizes = stage.table(routed.groupBy(*leaf).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")))
        dealt = routed.join(small(sizes), leaf).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        dealt = dealt.select(*leaf, "cid", "copies", "v", "places", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
        found = stage.table(dealt.groupBy(*leaf, "low", "high").applyInArrow(lambda t: _linked(t, threshold), _FOUND))
        group = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), stage)
        counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
        # Classes are numbered, not named by an id that another vector may share; a component's name is its least id.
        of = group.join(known.select(F.col("cid").alias("node"), "rep"), "node")
        group = of.join(of.groupBy("component").agg(F.min("rep").alias("group_id")), "component").select(F.col("node").alias("cid"), "group_id")
        named = known.join(counts, "cid", "left").join(group, "cid", "left")
        named = named.select("label", "d1", "d2", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("group_id", "rep").alias("group_id"))
    else:
        named = known.select("label", "d1", "d2", "copies", F.lit(0).cast("long").alias("links"), F.col("rep").alias("group_id"))
    named = stage.table(named.where("copies > 1 or links > 0"))
    out = keyed.select("vec_id", "label", "d1", "d2").join(small(named), ["label", "d1", "d2"], "left").select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("group_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("group_id", "vec_id"), F.lit(True)).alias("kept"),
    )
    return stage.result(out, keyed, named)


#: DuckDB's form of ``near_duplicates``: all pairs of a label, and the closure of their links.
SQL = """
with recursive given as (select row_number() over () as r, vec_id, label, embedding::double[] as v from embeddings),
usable as (
  select r, vec_id, label, v, list_transform(v, lambda x: x / list_max(list_transform(v, lambda y: abs(y)))) as s from given
  where vec_id is not null and label is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0
),
link as (
  select a.r as a, b.r as b from usable a join usable b on a.label = b.label and len(a.v) = len(b.v) and a.r <> b.r
  where list_dot_product(a.s, b.s) / sqrt(list_dot_product(a.s, a.s)) / sqrt(list_dot_product(b.s, b.s)) >= 0.98
),
reach(r, other) as (select r, r from given union select reach.r, link.b from reach join link on link.a = reach.other),
least as (select reach.r, min(g.vec_id) as component_id from reach join given g on g.r = reach.other group by reach.r),
n as (select a as r, count(*) as n_links from link group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, coalesce(vec_id = component_id, true) as kept
from given left join least using (r) left join n using (r)
"""
