"""The evidence graph: edges between units of an example by inverted indexes, scores, closures, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shared_term_edges(terms: DataFrame, least: int = 2, most: int = 12) -> DataFrame:
    """(example, src, dst), src < dst: nodes of an example that share a term which ``least`` to ``most`` of its nodes have.

    ``terms``: (example, node, term), distinct. Group sizes are counted before the join, so it makes at most ``most`` rows
    for each of its input.
    """
    sizes = terms.groupBy("example", "term").agg(F.count("*").alias("size")).where(F.col("size").between(least, most))
    own = terms.join(sizes, ["example", "term"])
    other = own.select("example", "term", F.col("node").alias("dst"))
    return own.select("example", "term", F.col("node").alias("src")).join(other, ["example", "term"]).where("src < dst").select("example", "src", "dst").distinct()


def title_token_edges(sentence_terms: DataFrame, title_terms: DataFrame) -> DataFrame:
    """(example, src, dst), src < dst: a node whose sentence holds a token of another node's title, and that node.

    Both inputs: (example, node, term), distinct. Without a cap: it reaches no farther than the example.
    """
    other = title_terms.select("example", "term", F.col("node").alias("b"))
    pairs = sentence_terms.select("example", "term", F.col("node").alias("a")).join(other, ["example", "term"]).where("a <> b")
    return pairs.select("example", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def adjacent_edges(nodes: DataFrame) -> DataFrame:
    """(example, src, dst): each node and the next of the same page. ``nodes``: (example, page, position, node)."""
    after = F.lead("node").over(Window.partitionBy("example", F.lower("page")).orderBy("position", "node"))
    return nodes.select("example", F.col("node").alias("src"), after.alias("dst")).where("dst is not null").select("example", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def document_edges(sentences: DataFrame, names_most: int = 12, words_most: int = 8, least: int = 4) -> DataFrame:
    """(example, src, dst): the edges of ``adjacent_edges``, ``title_token_edges`` and ``shared_term_edges`` of names and of words, once each.

    ``sentences``: (example, node, page, own, heads, names), the last three distinct. No edge leaves its example, so
    sentences are dealt by it once and no term is shuffled; a task takes a batch of examples at a time.
    """
    kind = sentences.schema["example"].dataType.simpleString()
    grouped = sentences.groupBy("example").agg(F.array_sort(F.collect_list(F.struct("node", "page", "own", "heads", "names"))).alias("s"))

    def link(batches):
        import pyarrow as pa

        from ..functions import links

        for batch in batches:
            for first, n in links.slices(batch.column("s")):
                part = batch.slice(first, n)
                document, src, dst = links.edges(part.column("s"), names_most, words_most, least)
                yield pa.RecordBatch.from_arrays([part.column("example").take(pa.array(document)), pa.array(src, pa.int32()), pa.array(dst, pa.int32())], ["example", "src", "dst"])

    return grouped.mapInArrow(link, f"example {kind}, src int, dst int")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("example", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def node_scores(nodes: DataFrame, edges: DataFrame, once: bool = False) -> DataFrame:
    """``nodes`` (example, node, overlap, title_overlap, asked) with degree, score and is_anchor.

    score = overlap / asked + 0.25 title_overlap / asked + 0.01 min(degree, 8), asked at least 1; anchors overlap at all.
    ``once``: every edge is there once and one way, so ends are counted before they are shuffled.
    """
    ends = edges.select("example", F.explode(F.array_distinct(F.array("src", "dst"))).alias("src")) if once else both_ways(edges)
    degree = ends.groupBy("example", F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    n = F.greatest("asked", F.lit(1))
    own = nodes.join(degree, ["example", "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return own.withColumn("score", F.col("overlap") / n + 0.25 * F.col("title_overlap") / n + 0.01 * F.least("degree", F.lit(8))).withColumn("is_anchor", (F.col("overlap") > 0) | (F.col("title_overlap") > 0))


def closure_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(example, a, b), a < b: an anchor and a neighbour."""
    anchors = nodes.where("is_anchor").select("example", F.col("node").alias("src"))
    return both_ways(edges).join(anchors, ["example", "src"], "left_semi").select("example", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def closure_triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(example, a, b, c) ascending: an anchor, a neighbour, and a neighbour of either."""
    anchors = nodes.where("is_anchor").select("example", F.col("node").alias("x"))
    both = both_ways(edges)
    first = anchors.join(both.select("example", F.col("src").alias("x"), F.col("dst").alias("y")), ["example", "x"])
    by_anchor = first.join(both.select("example", F.col("src").alias("x"), F.col("dst").alias("z")), ["example", "x"])
    by_other = first.join(both.select("example", F.col("src").alias("y"), F.col("dst").alias("z")), ["example", "y"])
    all_three = by_anchor.select("example", "x", "y", "z").union(by_other.select("example", "x", "y", "z")).where("z <> x and z <> y")
    return all_three.withColumn("m", F.array_sort(F.array("x", "y", "z"))).select("example", F.col("m")[0].alias("a"), F.col("m")[1].alias("b"), F.col("m")[2].alias("c")).distinct()


def closure_triple_sums(nodes: DataFrame, edges: DataFrame, weights: tuple[int, int, int]) -> DataFrame:
    """(example, triples, checksum): how many ``closure_triples`` each example has, and the sum of ``weights`` times a, b and c.

    They are the sets that hang together in the graph, less those that do among the nodes that aren't anchors. They are
    counted, not listed: an example's edges meet in one task once, as its windows do, and its neighbourhoods are rows of bits there.
    """
    kind = nodes.schema["example"].dataType.simpleString()

    def count(own, links):
        import numpy as np
        import pyarrow as pa

        from ..functions import bits

        found = []
        if own.num_rows and links.num_rows:
            src, dst = bits.pairs(*(links.column(c).to_numpy().astype(np.int64) for c in ("src", "dst")))
            plain = ~np.isin(np.stack([src, dst]), own.column("node").to_numpy()).any(axis=0)
            (n, total), (m, rest) = bits.triples(src, dst, weights), bits.triples(src[plain], dst[plain], weights)
            found = [(own.column("example")[0].as_py(), n - m, total - rest)] if n > m else []
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(columns, (own.schema.field("example").type, pa.int64(), pa.int64()), strict=True)], ["example", "triples", "checksum"])

    anchors = nodes.where("is_anchor").select("example", "node")
    return anchors.groupBy("example").cogroup(edges.select("example", "src", "dst").groupBy("example")).applyInArrow(count, f"example {kind}, triples long, checksum long")


def anchor_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(example, seed, other, seed_score, other_score, around): an anchor, a neighbour, and how many other nodes are in sight of either.

    ``nodes``: (example, node, score, is_anchor). An example's nodes and edges meet in one task once, and neighbourhoods
    are rows of bits there, so no neighbour of a pair becomes a row.
    """
    kind = nodes.schema["example"].dataType.simpleString()

    def meet(own, links):
        import numpy as np
        import pyarrow as pa

        from ..functions import bits

        names, types = ["example", "seed", "other", "seed_score", "other_score", "around"], (own.schema.field("example").type, pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32())
        if not own.num_rows or not links.num_rows:
            return pa.table([pa.array([], t) for t in types], names)
        node, score, anchor = (own.column(c).to_numpy() for c in ("node", "score", "is_anchor"))
        order = np.argsort(node)
        node, score, anchor = node[order], score[order], anchor[order]
        u, v = bits.pairs(*(links.column(c).to_numpy() for c in ("src", "dst")))
        known = np.isin(u, node) & np.isin(v, node)
        u, v = np.searchsorted(node, u[known]), np.searchsorted(node, v[known])
        near = bits.packed(np.concatenate([u, v]), np.concatenate([v, u]), len(node))
        degree = np.bincount(np.concatenate([u, v]), minlength=len(node))
        around = degree[u] + degree[v] - bits.in_common(near, u, near, v) - 2
        x, y, around = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([around, around])
        x, y, around = x[anchor[x]], y[anchor[x]], around[anchor[x]]
        example = pa.array([own.column("example")[0].as_py()], types[0]).take(pa.array(np.zeros(len(x), np.int64)))
        return pa.table([example, *(pa.array(c, t) for c, t in zip((node[x], node[y], score[x], score[y], around), types[1:], strict=True))], names)

    own = nodes.select("example", F.col("node").cast("int").alias("node"), F.col("score").cast("double").alias("score"), "is_anchor")
    links = edges.select("example", F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))
    return own.groupBy("example").cogroup(links.groupBy("example")).applyInArrow(meet, f"example {kind}, seed int, other int, seed_score double, other_score double, around int")


def invariants(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: edges, and those that are loops, turned round (src > dst), doubled, or lead to no node of their example."""
    ends = edges.select("example", F.col("src").alias("node")).union(edges.select("example", F.col("dst").alias("node"))).distinct()
    known = edges.select("example").distinct().join(nodes.select("example").distinct(), "example", "left_semi")
    dangling = ends.join(known, "example", "left_semi").join(nodes.select("example", "node"), ["example", "node"], "left_anti").agg(F.count("*").alias("dangling"), F.lit(0).alias("one"))
    own = edges.groupBy("example", "src", "dst").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("n"))), F.lit(0)).alias("loops"), F.coalesce(F.sum(F.when(F.col("src") > F.col("dst"), F.col("n"))), F.lit(0)).alias("turned"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("doubled"), F.lit(0).alias("one"))
    return own.join(dangling, "one").drop("one")


def select_context(units: DataFrame, asked: DataFrame, budget: int) -> DataFrame:
    """(example, place, unit): up to ``budget`` units of each example, those that the question names first, then what they lead to.

    ``units``: (example, unit, entities, properties); ``asked``: (example, query_entities, query_properties). A hit weighs
    2 for each entity and 1 for each property. Then, round by round, units that share a term with the last round's follow,
    by how often they do, then by the question's terms in them, then by text. All examples advance together; a round is a
    written table, and there are ``budget`` at most.
    """
    both = lambda a, b: F.size(F.array_intersect(a, b))
    own = units.join(asked, "example").select("example", "unit", F.array_union("entities", "properties").alias("terms"), (2 * both("entities", "query_entities") + both("properties", "query_properties")).alias("hit"), both(F.array_union("entities", "properties"), F.array_union("query_entities", "query_properties")).alias("named"))
    own = stored(own)
    order = Window.partitionBy("example").orderBy(F.desc("hit"), "unit")
    taken = stored(own.where("hit > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= budget).select("example", "place", "unit", "terms"))
    frontier = taken
    while True:
        near = frontier.select("example", F.explode("terms").alias("term")).join(own.select("example", "unit", "named", F.explode("terms").alias("term")), ["example", "term"])
        fresh = near.groupBy("example", "unit").agg(F.count("*").alias("n"), F.first("named").alias("named")).join(taken.select("example", "unit"), ["example", "unit"], "left_anti")
        sizes = taken.groupBy("example").agg(F.count("*").alias("size"))
        rank = F.row_number().over(Window.partitionBy("example").orderBy(F.desc("n"), F.desc("named"), "unit"))
        placed = fresh.join(sizes, "example").withColumn("place", F.col("size") + rank).where(F.col("place") <= budget)
        frontier = stored(placed.join(own.select("example", "unit", "terms"), ["example", "unit"]).select("example", F.col("place").cast("int").alias("place"), "unit", "terms"))
        if frontier.isEmpty():
            return taken.select("example", "place", "unit")
        taken = stored(taken.union(frontier))


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the folder of spark.checkpoint.dir; in local mode alone a temporary one is set where none is."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestrand-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst): the smallest node reachable.

    Two steps alternate until the edges stay the same: every larger neighbour of a node is hung on the smallest of its
    neighbourhood, then every smaller one. Both are a minimum, which is combined before the shuffle, and a join in which a
    hub's rows spread by their other end; rounds grow with the logarithm of a component's size, each is one written table.
    """
    pairs = edges.where("src is not null and dst is not null")
    nodes = pairs.select("src").union(pairs.select("dst")).distinct()

    def hang(rows: DataFrame, keep: str) -> DataFrame:
        least = rows.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return rows.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")

    state = stored(pairs.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    sign = None
    while (now := tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())) != sign and now[0]:
        large = hang(state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v"))), "v > u").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("v"))
        sign, state = now, stored(least.union(hang(large, "v <> m")).distinct())
    return nodes.join(state, F.col("src") == F.col("u"), "left").select(F.col("src").alias("node"), F.coalesce("v", "src").alias("component"))


def shortest_paths(roots: DataFrame, links: DataFrame, most: int = 64) -> DataFrame:
    """(root, node, depth, paths): the distance of every node from each root over undirected ``links`` (src, dst), and how many shortest paths there are.

    Levels advance together for all roots, until none finds a new node; each is a written table. ``roots``: (root).
    """
    both = stored(links.select("src", "dst").union(links.select("dst", "src")).distinct())
    level = stored(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("paths")))
    found = level
    for depth in range(1, most + 1):
        ahead = level.select("root", F.col("node").alias("src"), "paths").join(both, "src").groupBy("root", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        level = stored(ahead.join(found.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(depth).alias("depth"), "paths"))
        if level.isEmpty():
            return found
        found = found.union(level)
    raise ValueError(f"paths go on after {most} steps")


def all_shortest_paths(goals: DataFrame, links: DataFrame, most_steps: int = 64, most_paths: int = 10_000_000) -> DataFrame:
    """(root, goal, nodes, relations): every shortest path from each root to each of its goals, node by node.

    ``goals``: (root, goal); ``links``: (src, rel, dst), undirected; of several links between two nodes the one with the
    greatest relation counts. Distances grow level by level for all roots together, a root's no further than to the last of
    its goals, and each level keeps the links that lead to it from the one before; then the paths are unfolded backwards
    from the goals, a step at a time, on these links alone, so a step makes no row that isn't part of a path.
    The paths of all goals are counted first: beyond ``most_paths`` this raises, as no path is ever left out. A goal that
    is its root has a path of one node; one that can't be reached has none.
    """
    either = links.where("src <> dst").select("src", "rel", "dst").union(links.where("src <> dst").select("dst", "rel", "src"))
    both = stored(either.groupBy("src", "dst").agg(F.max("rel").alias("rel")))
    left = goals.select("root", "goal").distinct()
    level = stored(left.select("root").distinct().select("root", F.col("root").alias("node"), F.lit(1).cast("long").alias("paths")))
    before, found, steps = level.limit(0), [], []
    while True:
        found.append(left.join(level.select("root", F.col("node").alias("goal"), "paths"), ["root", "goal"]))
        left = stored(left.join(level.select("root", F.col("node").alias("goal")), ["root", "goal"], "left_anti"))
        # a neighbour of a level's node is in the level before, in the same, or in the next
        ahead = level.join(left.select("root").distinct(), "root", "left_semi").select("root", F.col("node").alias("src"), "paths").join(both, "src").withColumnRenamed("dst", "node")
        seen = level.select("root", "node").union(before.select("root", "node"))
        step = stored(ahead.join(seen, ["root", "node"], "left_anti").select("root", F.col("src").alias("before"), "node", "rel", "paths"))
        before, level = level, stored(step.groupBy("root", "node").agg(F.sum("paths").alias("paths")))
        if level.isEmpty():
            break
        if len(steps) == most_steps:
            raise ValueError(f"paths go on after {most_steps} steps")
        steps.append(step)
    n = sum(f.agg(F.coalesce(F.sum("paths"), F.lit(0))).first()[0] for f in found)
    if n > most_paths:
        raise ValueError(f"{n} paths are over {most_paths}")
    begun = [f.select("root", "goal", F.col("goal").alias("at"), F.array("goal").alias("nodes"), F.array().cast("array<string>").alias("relations")) for f in found]
    state = begun[-1]
    for own, step in zip(reversed(begun[:-1]), reversed(steps), strict=True):
        back = state.join(step.select("root", F.col("node").alias("at"), "before", "rel"), ["root", "at"])
        state = own.union(stored(back.select("root", "goal", F.col("before").alias("at"), F.array_prepend("nodes", F.col("before")).alias("nodes"), F.array_prepend("relations", F.col("rel")).alias("relations"))))
    return state.select("root", "goal", "nodes", "relations")


def path_string(nodes: F.Column, relations: F.Column) -> F.Column:
    """a -> relation -> b -> relation -> c; empty for a path without a step."""
    pairs = F.flatten(F.transform(F.slice(nodes, 2, F.greatest(F.size(nodes) - 1, F.lit(0))), lambda n, i: F.array(F.get(relations, i), n)))
    return F.when(F.size(nodes) > 1, F.array_join(F.concat(F.slice(nodes, 1, 1), pairs), " -> ")).otherwise("")


def closure(edges: DataFrame, most: int = 32) -> DataFrame:
    """(src, dst): reflexive-transitive closure of ``edges``, by squaring until nothing new is reached; paths of over 2^``most`` steps raise."""
    nodes = edges.select("src").union(edges.select("dst")).distinct()
    reach = stored(edges.select("src", "dst").union(nodes.select("src", F.col("src").alias("dst"))).distinct())
    n = reach.count()
    for _ in range(most):
        two = reach.join(reach.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        reach = stored(two.distinct())
        if (m := reach.count()) == n:
            return reach
        n = m
    raise ValueError(f"the closure goes on after {most} rounds")
