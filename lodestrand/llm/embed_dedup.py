"""Embedding near-duplicates: exact cosine threshold pairs by dual traversal of cover trees."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import one, require, tidy, tidy_group, unit_hash, written
from .components import connected_components

COSINE = 0.98
TILE, LEAF = 2048, 32
#: The top of the trees is built on the driver from a sample: so many centres over all labels at most, of so many bytes,
#: chosen from so many vectors for each.
MOST_CENTRES, CENTRE_BYTES, PER_CENTRE = 4096, 4 << 20, 8
_SLACK = 1e-9


class Node:
    __slots__ = ("centre", "children", "members", "radius")

    def __init__(self, centre: int, members: np.ndarray, radius: float):
        self.centre, self.members, self.radius, self.children = centre, members, radius, []


def cover_tree(x: np.ndarray) -> Node:
    """Nested levels over unit vectors: a node's children are a net of its points at half its level's radius.

    The first child has its parent's centre. ``radius`` is the true distance to the farthest point below. Nodes of
    ``LEAF`` points or fewer are not divided.
    """
    every = np.arange(len(x))
    top = Node(0, every, float(np.linalg.norm(x - x[0], axis=1).max(initial=0)))
    todo = [(top, 2.0)]
    while todo:
        node, level = todo.pop()
        while level > node.radius:
            level /= 2
        if len(node.members) <= LEAF or node.radius <= _SLACK:
            continue
        rest = np.concatenate([[node.centre], node.members[node.members != node.centre]])
        while len(rest):
            far = np.sqrt(np.maximum(0, 2 - 2 * (x[rest] @ x[rest[0]])))
            near = far <= level
            near[0] = True
            child = Node(int(rest[0]), rest[near], float(far[near].max()) + _SLACK)
            node.children.append(child)
            todo.append((child, level / 2))
            rest = rest[~near]
        if len(node.children) == 1:  # all within this level: go on with the next
            node.children = []
            todo[-1] = (node, level / 2)
    return top


def linked_pairs(a: Node, b: Node, x: np.ndarray, y: np.ndarray, cosine: float):
    """Blocks (rows of x, rows of y, mask or None) that hold all pairs with cosine >= ``cosine``; None: every pair is one."""
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        d = math.sqrt(max(0.0, 2 - 2 * float(x[p.centre] @ y[q.centre])))
        if d > reach + p.radius + q.radius + _SLACK:
            continue
        if d + p.radius + q.radius < reach - 1e-6:
            yield p.members, q.members, None
            continue
        if not p.children and not q.children:
            mask = x[p.members] @ y[q.members].T >= cosine
            if mask.any():
                yield p.members, q.members, mask
            continue
        turn = bool(p.children) and (not q.children or p.radius >= q.radius)
        node, other, own, its = (p, q, x, y) if turn else (q, p, y, x)
        centres = np.array([c.centre for c in node.children])
        radii = np.array([c.radius for c in node.children])
        far = np.sqrt(np.maximum(0, 2 - 2 * (own[centres] @ its[other.centre])))
        todo += [(node.children[k], other) if turn else (other, node.children[k]) for k in np.flatnonzero(far <= reach + radii + other.radius + _SLACK)]


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _parts(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component of each row and column of a block of links, by the least row in it; -1 without a link."""
    none = len(mask)
    rows = np.where(mask.any(axis=1), np.arange(none), none)
    while True:
        columns = np.where(mask, rows[:, None], none).min(axis=0)
        new = np.minimum(rows, np.where(mask, columns[None], none).min(axis=1))
        if (new == rows).all():
            return np.where(rows < none, rows, -1), np.where(columns < none, columns, -1)
        rows = new


def _compare(weight: np.ndarray, x: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of the rows of two tiles, ``left`` and ``right``, or of one if they are the same object."""
    n, one_tile = len(x), left is right
    links, forest = np.zeros(n, np.int64), _Forest(n)
    if not len(left) or not len(right):
        return links, np.arange(n)
    tree = cover_tree(x[left])
    for p, q, mask in linked_pairs(tree, tree if one_tile else cover_tree(x[right]), x[left], x[right], cosine):
        a, b = left[p], right[q]
        if mask is None:
            links[a] += weight[b].sum()
            if not one_tile:
                links[b] += weight[a].sum()
            for k in (*a.tolist(), *b.tolist()):
                forest.join(int(a[0]), k)
        else:
            links[a] += mask @ weight[b]
            if not one_tile:
                links[b] += mask.T @ weight[a]
            for own, parts in zip((a, b), _parts(mask), strict=True):
                for k, r in zip(own.tolist(), parts.tolist(), strict=True):
                    if r >= 0:
                        forest.join(int(a[r]), k)
    if one_tile:
        links[left] -= weight[left]  # with itself
    return links, np.array([forest.root(k) for k in range(n)])


def _unit(lists: pa.Array, dim: int) -> np.ndarray:
    """Vectors of length ``dim`` scaled to length 1; the largest component goes first, so that no square over- or underflows."""
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def net(x: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` rows, each the farthest from those before: the first levels of a cover tree, of falling radius."""
    chosen, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(k, len(x)):
        best = int(far.argmax())
        if far[best] <= _SLACK:
            break
        chosen.append(best)
        far = np.minimum(far, np.linalg.norm(x - x[best], axis=1))
    return x[chosen]


def _top(reps: DataFrame, tile: int) -> dict[tuple, np.ndarray]:
    """Centres of the cells of each (label, length) with two tiles of vectors or more."""
    counts = reps.groupBy("label", "dim").agg(F.count("*").alias("n"))
    total, longest = counts.where(F.col("n") >= 2 * tile).agg(F.sum(F.floor(F.col("n") / tile)), F.max("dim")).first()
    if not total:
        return {}
    room = max(2, min(MOST_CENTRES, CENTRE_BYTES // (8 * longest)))
    wide = tile * -(-total // room)  # vectors of a cell; more than a tile where centres run out
    large = counts.where(F.col("n") >= 2 * wide).withColumn("k", F.floor(F.col("n") / wide))
    chosen = reps.join(F.broadcast(large), ["label", "dim"]).where(unit_hash(F.lit("centre"), "rep") < PER_CENTRE * F.col("k") / F.col("n"))
    found: dict[tuple, list] = {}
    for r in chosen.select("label", "dim", "k", "rep", "v").orderBy("rep").toLocalIterator():
        found.setdefault((r["label"], r["dim"], r["k"]), []).append(r["v"])
    return {(label, dim): net(_unit(pa.array(v, pa.list_(pa.float64())), dim), k) for (label, dim, k), v in found.items()}


def _deal(reps: DataFrame, centres: dict[tuple, np.ndarray], radii: dict[tuple, np.ndarray] | None, cosine: float) -> DataFrame:
    """Without radii: home (the nearest centre of each vector) and far (how far it is). With them: cells, the later cells it can reach into."""
    sent = reps.sparkSession.sparkContext.broadcast((centres, radii))  # MOST_CENTRES vectors at most
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    new = [T.StructField("home", T.IntegerType()), T.StructField("far", T.DoubleType())] if radii is None else [T.StructField("cells", T.ArrayType(T.IntegerType()))]
    names = reps.columns

    @tidy
    def run(batches):
        tops, bounds = sent.value
        for batch in batches:
            label, dim = (one(batch.column(names.index(c))).to_pylist() for c in ("label", "dim"))
            lists, groups = one(batch.column(names.index("v"))), {}
            for k, key in enumerate(zip(label, dim, strict=True)):
                if key in tops:
                    groups.setdefault(key, []).append(k)
            home, far, cells = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows), [[] for _ in label]
            for key, rows in groups.items():
                d = np.sqrt(np.maximum(0, 2 - 2 * (_unit(lists.take(pa.array(rows)), key[1]) @ tops[key].T)))
                if bounds is None:
                    home[rows], far[rows] = d.argmin(axis=1), d.min(axis=1)
                    continue
                own = one(batch.column(names.index("home"))).to_numpy()[rows]
                # a partner's home is no farther from it than this vector's home: a second bound beside the covering radius
                near = (d <= reach + bounds[key][None] + 1e-6) & (d <= d[np.arange(len(rows)), own][:, None] + 2 * reach + 1e-6) & (np.arange(len(tops[key]))[None] > own[:, None])
                for k, row in zip(rows, near, strict=True):
                    cells[k] = np.flatnonzero(row).tolist()
            extra = [pa.array(home, pa.int32()), pa.array(far)] if bounds is None else [pa.array(cells, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, *(f.name for f in new)])

    return reps.mapInArrow(run, T.StructType([*reps.schema.fields, *new]))


def cell_tasks(reps: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """``reps`` (label, v, rep, weight, dim), a row for each pair of tiles that it is in: plus cell, kind, low, high, left, right.

    A vector is a member of the cell of its nearest centre and a guest of later cells that it can reach into. Members of
    a cell meet each other (kind 0) and its guests (kind 1); both are cut into tiles by a hash.
    """
    centres = _top(reps, tile)
    homes = written(_deal(reps, centres, None, cosine), "homes")
    radii = {key: np.full(len(c), -math.inf) for key, c in centres.items()}
    if centres:
        wide = homes.groupBy("label", "dim", "home").agg(F.max("far").alias("radius")).where("home > 0")  # a row for each centre at most
        for r in wide.collect():
            radii[r["label"], r["dim"]][r["home"]] = r["radius"]
    dealt = written(_deal(homes, centres, radii, cosine), "cells")
    places = F.expr("concat(array(struct(home as cell, false as guest)), transform(cells, c -> struct(c as cell, true as guest)))")
    sizes = dealt.select("label", "dim", F.explode(places).alias("p")).groupBy("label", "dim", "p.cell").agg(F.ceil(F.count_if(~F.col("p.guest")) / tile).cast("int").alias("own"), F.ceil(F.count_if("p.guest") / tile).cast("int").alias("guests"))
    each = dealt.select("label", "dim", "rep", "weight", "v", F.explode(places).alias("p")).select("label", "dim", "rep", "weight", "v", "p.cell", "p.guest").join(sizes, ["label", "dim", "cell"])
    each = each.withColumn("t", F.pmod(F.xxhash64("rep", F.lit(1)), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("own"))).cast("int"))
    among = "transform(sequence(0, own - 1), j -> struct(0 as kind, least(t, j) as low, greatest(t, j) as high, t <= j as left, t >= j as right))"
    with_guests = "if(guests > 0, transform(sequence(0, guests - 1), g -> struct(1 as kind, g as low, t as high, false as left, true as right)), array())"
    as_guest = "if(own > 0, transform(sequence(0, own - 1), j -> struct(1 as kind, t as low, j as high, true as left, false as right)), array())"
    tasks = F.explode(F.expr(f"if(guest, {as_guest}, concat({among}, {with_guests}))"))
    return each.select("label", "dim", "cell", "rep", "weight", "v", tasks.alias("k")).select("label", "dim", "cell", "rep", "weight", "v", "k.*")


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """For every row: id_col, n_links long (other vectors linked directly), component (smallest id reachable over links).

    Vectors link when their labels are equal and not null and their cosine in double precision is ``cosine`` or more.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, link with nothing;
    vectors of different lengths don't either. Other columns are ignored; an empty table gives no rows. Very long vectors are compared whole. Ids are taken to
    be unique: vectors that share one count as one node of a component.

    Equal vectors of a label are one representative with a weight. The top of a label's cover tree is a net of a bounded
    sample: its centres divide the label into cells, and only cells whose covering radii let two vectors meet are
    compared. A task holds two tiles of cells, builds the lower levels of a tree over either, and walks them together. It
    returns sums and a spanning forest, never its pairs; so a group of near copies costs no more rows than it has members.
    """
    require(vectors, id_col, vector_col, label_col)
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    fine = F.expr("id is not null and label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    rows = v.withColumn("fine", F.coalesce(fine, F.lit(False)))
    good = rows.where("fine").select("id", "label", "v")
    kind = vectors.schema[id_col].dataType
    reps = written(good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("weight")).withColumn("dim", F.size("v")), "vectors")

    @tidy_group
    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("rep")
        ids, n = one(group["rep"]), group.num_rows
        weight, left, right = (one(group[c]).to_numpy(zero_copy_only=False) for c in ("weight", "left", "right"))
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        same = group["kind"][0].as_py() == 0 and group["low"][0].as_py() == group["high"][0].as_py()
        links, root = _compare(weight, _unit(one(group["v"]), group["dim"][0].as_py()), a, a if same else b, cosine)
        use = np.flatnonzero((links > 0) | (root != np.arange(n)))
        return pa.table({"rep": ids.take(pa.array(use)), "links": pa.array(links[use]), "root": ids.take(pa.array(root[use]))})

    key = ["label", "dim", "cell", "kind", "low", "high"]
    tasks = cell_tasks(reps, cosine, tile).repartition(*key)  # by the whole key, or one task would hold a cell
    found = written(tasks.groupBy(*key).applyInArrow(compare, T.StructType([T.StructField("rep", kind), T.StructField("links", T.LongType()), T.StructField("root", kind)])), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected_components(found, "rep", "root")
    named = reps.join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select("label", "v", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component"))
    linked = good.join(named, ["label", "v"]).select("id", "n_links", "component")
    alone = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.union(alone).select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component")
