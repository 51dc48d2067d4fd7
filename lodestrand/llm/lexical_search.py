"""Ranked lexical search of many queries at once: sets of terms that queries share are summed once for each document."""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat_words, one, require, slices, tidy, written

TOP = 10
#: Pairs of classes of terms within items, over all items that are planned together and evaluated in one pass.
BLOCK_PAIRS = 4_000_000
#: Bytes of accumulators that a task holds at once.
HELD = 32 << 20
#: Parts that the best rows of an item are ranked in before the last ranking.
PARTS = 32
#: Bytes that stand in no term become blanks, A-Z become a-z, all others stay.
_BYTES = np.array([b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)], np.uint8)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of every text in one flat array, and the offsets of the texts in it (null: none)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return pa.array([], pa.large_string()), np.zeros(len(texts) + 1, np.int64)
    data = _BYTES[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    return flat_words(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data)))


@dataclass
class Plan:
    """A graph of sums. Node k < len(leaves) is a term's value times a power of two; later nodes sum earlier ones."""

    terms: list[str]
    leaves: list[tuple[int, int]] = field(default_factory=list)
    sums: list[tuple[int, ...]] = field(default_factory=list)
    tops: list[tuple[int, ...]] = field(default_factory=list)


def plan(items: list[Counter]) -> Plan:
    """The graph for ``items`` (terms with repeats).

    Repeats become powers of two, so that items with unlike repeats still share. Leaves that stand in the same items are
    one class, summed once. Then the pair of nodes that most items hold becomes a node of its own in all of these, until
    no two items share a pair. What is left of an item are its tops.
    """
    out = Plan(sorted({t for item in items for t in item}))
    number, inside = {t: k for k, t in enumerate(out.terms)}, defaultdict(list)
    for at, item in enumerate(items):
        for t, times in item.items():
            for bit in range(times.bit_length()):
                if times >> bit & 1:
                    inside[number[t], 1 << bit].append(at)
    out.leaves = sorted(inside)
    classes = defaultdict(list)
    for k, leaf in enumerate(out.leaves):
        classes[tuple(inside[leaf])].append(k)

    def node(members: tuple[int, ...]) -> int:
        out.sums.append(members)
        return len(out.leaves) + len(out.sums) - 1

    own: list[set[int]] = [set() for _ in items]
    for held_by, members in classes.items():
        made = members[0] if len(members) == 1 else node(tuple(members))
        for at in held_by:
            own[at].add(made)
    shared = Counter(k for nodes in own for k in nodes)
    holders: dict[tuple[int, int], set[int]] = defaultdict(set)
    for at, nodes in enumerate(own):
        few = sorted(k for k in nodes if shared[k] > 1)
        for i, a in enumerate(few):
            for b in few[i + 1 :]:
                holders[a, b].add(at)
    heap = [(-len(at), pair) for pair, at in holders.items() if len(at) > 1]
    heapq.heapify(heap)
    while heap:
        count, pair = heapq.heappop(heap)
        now = holders.get(pair, set())
        if len(now) != -count:
            if len(now) > 1:
                heapq.heappush(heap, (-len(now), pair))
            continue
        (a, b), made, fresh = pair, node(pair), set()
        for at in sorted(now):
            own[at] -= {a, b}
            for other in own[at]:
                for gone in (a, b):
                    holders[min(gone, other), max(gone, other)].discard(at)
                if shared[other] > 1:
                    holders[other, made].add(at)
                    fresh.add((other, made))
            own[at].add(made)
        holders.pop(pair)
        shared[made] = len(now)
        for key in sorted(fresh):
            if len(holders[key]) > 1:
                heapq.heappush(heap, (-len(holders[key]), key))
    out.tops = [tuple(sorted(nodes)) for nodes in own]
    return out


def postings(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs): how many terms each document has, and which of ``terms``, how often each. Arrow batches, no shuffle."""
    kind = docs.schema[id_col].dataType
    vocabulary = pa.array(terms, pa.large_string())

    def run(batches):
        for batch in (part for b in batches for part in slices(b, 1)):
            words, offsets = terms_of(one(batch.column(1)))
            coded = words.dictionary_encode()
            known = pc.fill_null(pc.index_in(coded.dictionary, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            code = known[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            hit = code >= 0
            key, tf = np.unique(doc[hit] * max(1, len(terms)) + code[hit], return_counts=True)
            at = np.searchsorted(key, np.arange(batch.num_rows + 1) * max(1, len(terms)))
            edge = pa.array(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [one(batch.column(0)), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(edge, pa.array((key % max(1, len(terms))).astype(np.int32))), pa.ListArray.from_arrays(edge, pa.array(tf.astype(np.int64)))],
                names=["id", "n", "terms", "tfs"],
            )

    schema = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def evaluate(graph: Plan, values: np.ndarray, docs: np.ndarray, terms: np.ndarray, n_docs: int) -> np.ndarray:
    """(items, documents): scores of the documents of a batch, from the value of each (document, term) in it."""
    base = np.zeros((len(graph.terms), n_docs), np.int64)
    base[terms, docs] = values
    acc = np.zeros((len(graph.leaves) + len(graph.sums), n_docs), np.int64)
    if graph.leaves:
        term, times = np.array(graph.leaves, np.int64).T
        np.multiply(base[term], times[:, None], out=acc[: len(term)])
    for k, members in enumerate(graph.sums, len(graph.leaves)):
        if len(members) == 2:
            np.add(acc[members[0]], acc[members[1]], out=acc[k])
        else:
            acc[list(members)].sum(axis=0, out=acc[k])
    return np.stack([acc[list(top)].sum(axis=0) for top in graph.tops])


def _best(graph: Plan, weights: np.ndarray, mean_top: int, mean_bottom: int, top: int):
    """For each item the ``top`` rows of a task, best first: a function of batches."""
    width = 8 * (2 * len(graph.leaves) + len(graph.sums) + len(graph.terms) + len(graph.tops))
    step = max(16, HELD // max(1, width))

    def run(batches):
        best: list[list[tuple]] = [[] for _ in graph.tops]
        kind = None
        for batch in batches:
            ids, n = one(batch.column(0)), one(batch.column(1)).to_numpy(zero_copy_only=False)
            kind = ids.type
            lists, tfs = one(batch.column(2)), one(batch.column(3)).flatten().to_numpy(zero_copy_only=False)
            offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)
            offsets = offsets - offsets[0]
            m = 25 + (75 * n * mean_top) // max(1, mean_bottom)
            for i in range(0, len(n), step):
                j = min(len(n), i + step)
                doc = np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]))
                term, tf = flat[offsets[i] : offsets[j]], tfs[offsets[i] : offsets[j]]
                value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[i:j][doc]))
                scores = evaluate(graph, value, doc, term, j - i)
                order = None
                for at, own in enumerate(scores):
                    least = best[at][-1][0] if len(best[at]) == top else 1
                    found = np.flatnonzero(own >= max(1, least))
                    if not len(found):
                        continue
                    if len(found) > top:
                        if order is None:
                            order = np.empty(j - i, np.int64)
                            order[pc.array_sort_indices(ids.slice(i, j - i)).to_numpy()] = np.arange(j - i)
                        cut = np.partition(own[found], len(found) - top)[len(found) - top]
                        found = found[own[found] >= cut]
                        found = found[np.lexsort((order[found], -own[found]))[:top]]
                    best[at] += [(int(own[d]), ids[i + int(d)].as_py()) for d in found]
                    best[at].sort(key=lambda x: (-x[0], x[1] is None, x[1]) if x[1] is not None else (-x[0], True, 0))
                    del best[at][top:]
        rows = [(at, score, doc) for at, own in enumerate(best) for score, doc in own]
        if rows:
            at, score, doc = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(score, pa.int64()), pa.array(doc, kind)], names=["at", "score", "id"])

    return run


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", top: int = TOP) -> DataFrame:
    """(item_col, rank, id_col, score): for every row of ``items`` its ``top`` best documents with a score above 0.

    Items are the stated queries: they are read in order by the driver, in blocks of bounded planning work (an item alone
    may be a block), and each block is one pass over the documents. A pass finds the block's terms in whole texts, counts
    them over all documents, and sums values along the block's graph document by document; no document leaves its task but
    the best ones of an item, which are ranked in parts and then together.

    Null and empty texts have no terms: such documents count for nothing, such items have no rows. A very long text is one
    row of one task. Equal scores go by ascending id, null ids last; rows that repeat an id are documents of their own, and
    so are items. Empty tables give no rows; other columns are ignored.
    """
    require(docs, id_col, text_col)
    require(items, item_col, query_col)
    spark = docs.sparkSession
    schema = T.StructType([T.StructField(item_col, items.schema[item_col].dataType), T.StructField("rank", T.IntegerType()), T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.LongType())])
    done = None
    for block in _item_blocks(items.select(item_col, query_col)):
        part = _search_block(docs, block, id_col, text_col, item_col, top, schema)
        done = part if done is None else done.union(part)
    return spark.createDataFrame([], schema) if done is None else done


def _item_blocks(items: DataFrame):
    """Lists of (item, terms with repeats), so many as may be planned together."""
    block, pairs = [], 0
    for row in items.toLocalIterator():
        words, _ = terms_of(pa.array([row[1]], pa.large_string()))
        own = Counter(words.to_pylist())
        if not own:
            continue
        cost = len(own) * (len(own) + 1) // 2
        if block and pairs + cost > BLOCK_PAIRS:
            yield block
            block, pairs = [], 0
        block.append((row[0], own))
        pairs += cost
    if block:
        yield block


def _search_block(docs: DataFrame, block: list[tuple], id_col: str, text_col: str, item_col: str, top: int, schema: T.StructType) -> DataFrame:
    spark = docs.sparkSession
    graph = plan([own for _, own in block])
    found = written(postings(docs, graph.terms, id_col, text_col), "postings")
    n_docs, length = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["term"]: r["n"] for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    weights = np.array([weight(n_docs, df.get(k, 0)) for k in range(len(graph.terms))], np.int64)
    rows = found.where(F.size("terms") > 0).mapInArrow(tidy(_best(graph, weights, n_docs, length, top)), T.StructType([T.StructField("at", T.IntegerType()), T.StructField("score", T.LongType()), T.StructField("id", schema[id_col].dataType)]))
    order = (F.desc("score"), F.asc_nulls_last("id"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("at", "part").orderBy(*order))).where(F.col("k") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("at").orderBy(*order))).where(F.col("rank") <= top)
    names = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(block)], T.StructType([T.StructField("at", T.IntegerType()), T.StructField(item_col, schema[item_col].dataType)]))
    return rows.join(F.broadcast(names), "at").select(item_col, "rank", F.col("id").alias(id_col), "score")
