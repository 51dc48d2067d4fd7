"""SimHash near-duplicates: exact comparison of all fingerprints by tiles, with numpy exclusive-or and bit counts."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import one, require, tidy, written
from .components import connected_components

SEED, SHINGLE, RADIUS = 42, 3, 2
#: A fingerprint is four words of 16 bits; a cell holds the fingerprints with the same four bit counts.
PARTS, BASE = 4, 17
TILE = 2048


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Majority bits of the shingles' XXH64; fewer words than a shingle count as one, none give zero."""
    h = _hashes(words, shingle)
    return int(_majority(np.array(h, np.uint64), np.array([0]), np.array([len(h)]))[0]) if h else 0


def _hashes(words: list[bytes], shingle: int) -> list[int]:
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return [digest(b" ".join(words), SEED)] if words else []
    return [digest(x, SEED) for x in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))]


def _majority(h: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """h: hashes of texts one after another; every text has one at least."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, beside: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp long, columns ``beside``) for every row; whole texts, A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``; null text: zero."""

    @tidy
    def run(batches):
        for batch in batches:
            texts, out, part, n = one(batch.column(1)).cast(pa.binary()).to_pylist(), np.zeros(batch.num_rows, np.uint64), [], 0

            def flush():
                if part:
                    counts = np.array([len(h) for _, h in part])
                    flat = np.fromiter((x for _, h in part for x in h), np.uint64, counts.sum())
                    out[[k for k, _ in part]] = _majority(flat, np.cumsum(counts) - counts, counts)
                    part.clear()

            for k, text in enumerate(texts):
                if h := _hashes(text.lower().split(), shingle) if text else []:
                    part.append((k, h))
                    n += len(h)
                    if n > 200_000:
                        flush()
                        n = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64)), *batch.columns[2:]], names=["id", "fp", *beside])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType()), *(docs.schema[c] for c in beside)])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *beside).mapInArrow(run, schema)


def _cells(fp: np.ndarray) -> np.ndarray:
    """The four bit counts of each fingerprint as one number."""
    counts = np.bitwise_count(fp.view(np.uint16).reshape(-1, PARTS)).astype(np.int64)
    return counts @ (BASE ** np.arange(PARTS, dtype=np.int64))


def _near_cells(radius: int) -> list[tuple[int, ...]]:
    """One of each pair of opposite steps between cells whose bit counts differ by radius at most in sum; (0, 0, 0, 0) first."""
    steps = [s for s in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, s)) <= radius]
    return [(0,) * PARTS, *(s for s in steps if s > (0,) * PARTS)]


def _forest(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between two tiles as a spanning forest: (fingerprint, root)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    rows = max(1, (1 << 20) // max(1, len(right)))
    for i in range(0, len(left), rows):
        near = np.bitwise_count(left[i : i + rows, None] ^ right[None, :]) <= radius
        for a, b in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            x, y = root(int(left[i + a])), root(int(right[b]))
            if x != y:
                parent[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in list(parent) if root(x) != x]


def near_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that span, for the distinct values of column ``fp``, all pairs at ``radius`` or fewer differing bits.

    Fingerprints with equal bit counts of their four 16-bit words form a cell, cut into tiles of about ``tile``. A bit
    that differs changes one count by one, so only cells whose counts differ by ``radius`` at most in sum are compared;
    all other tile pairs are skipped unread. A tile is one row with its fingerprints in a binary column; what is dealt to
    tasks are tiles, not fingerprints. There are 17^4 cells at most, so their sizes fit the driver at any input.
    """
    spark = fps.sparkSession

    def cells(batches):
        for batch in batches:
            fp = one(batch.column(0)).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(_cells(fp.view(np.uint64)))], names=["fp", "cell"])

    distinct = written(fps.select("fp").distinct().mapInArrow(cells, "fp long, cell long"), "fingerprints")
    tiles = {r[0]: -(-r[1] // tile) for r in distinct.groupBy("cell").count().collect()}  # 83,521 cells at most
    if not tiles:
        return spark.createDataFrame([], "a long, b long")
    steps = [(s, sum(x * BASE**k for k, x in enumerate(s))) for s in _near_cells(radius)]

    def beside(c: int, sign: int) -> list[int]:
        digits = [c // BASE**k % BASE for k in range(PARTS)]
        return [c + sign * d for s, d in steps if c + sign * d in tiles and all(0 <= x + sign * y < BASE for x, y in zip(digits, s, strict=True))]

    def pack(group: pa.Table) -> pa.Table:
        """A tile as one row."""
        fp = np.sort(one(group["fp"]).to_numpy(zero_copy_only=False))
        return pa.table({"cell": group["cell"][:1], "tile": group["tile"][:1], "fps": pa.array([fp.tobytes()], pa.binary())})

    sizes = distinct.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))  # a row for each cell, as above
    own = distinct.join(F.broadcast(sizes), "cell").withColumn("tile", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("tiles")).cast("int"))
    packed = written(own.select("fp", "cell", "tile").repartition("cell", "tile").groupBy("cell", "tile").applyInArrow(pack, "cell long, tile int, fps binary"), "tiles")

    def deal(batches):
        """Each tile as the first side of its own groups, and as a part of the second side of those of the cells behind.

        A group (cell, i, j) holds the tile i of a cell, and the tiles j of all cells ahead of it and, from i on, of itself.
        """
        for batch in batches:
            for c, own, blob in zip(*(one(batch.column(k)).to_pylist() for k in range(3)), strict=True):
                out = [(True, c, own, j) for j in range(max(tiles[b] for b in beside(c, 1)))]
                out += [(False, a, i, own) for a in beside(c, -1) for i in range(tiles[a]) if a != c or i <= own]
                for k in range(0, len(out), 256):
                    part = out[k : k + 256]
                    columns = [pa.array(x, t) for x, t in zip(zip(*part, strict=True), (pa.bool_(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([blob] * len(part), pa.binary())], names=["first", "cell", "i", "j", "fps"])

    def compare(group: pa.Table) -> pa.Table:
        sides: dict[bool, list[bytes]] = {True: [], False: []}
        for first, blob in zip(group["first"].to_pylist(), group["fps"].to_pylist(), strict=True):
            sides[first].append(blob)
        left, right = (np.frombuffer(b"".join(sides[f]), np.uint64) for f in (True, False))
        links = np.array(_forest(left, right, radius), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": pa.array(links[:, 0]), "b": pa.array(links[:, 1])})

    pairs = packed.mapInArrow(deal, "first boolean, cell long, i int, j int, fps binary")
    return pairs.repartition("cell", "i", "j").groupBy("cell", "i", "j").applyInArrow(compare, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id_col, fp long, component) for every row of ``docs``; other columns are ignored.

    component is the smallest id reachable over links of ``radius`` or fewer differing bits, the row's own included. Null
    and empty texts have fingerprint zero and link like any other. Rows that repeat an id each give a row. A null id never
    names a component unless all ids of its component are null. An empty table gives no rows. A very long text is
    fingerprinted whole, by one task.
    """
    require(docs, id_col, text_col)
    own = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    roots = connected_components(near_links(own, radius))
    classes = own.groupBy("fp").agg(F.min("id").alias("least")).join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = classes.groupBy("root").agg(F.min("least").alias("component"))
    return own.join(classes.join(names, "root").select("fp", "component"), "fp").select(F.col("id").alias(id_col), "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which one of each near-duplicate group stays: that of the smallest id.

    Groups are told apart by the root of their fingerprints, not by ids, which may be null or repeated. Null ids come
    last; of unlike texts of the smallest id the one with the least hash stays, of equal rows one. Of rows with the same id and text
    any one stays, whatever their other columns. A very long text is fingerprinted whole, by one task; an empty table stays empty.
    """
    require(docs, id_col, text_col)
    keys = ("__a", "__b")  # 128 bits of the id and the text of a row
    row = (F.isnull(id_col), F.col(id_col), F.isnull(text_col), F.col(text_col))
    keyed = docs.withColumns({"__a": F.xxhash64(*row), "__b": F.xxhash64(F.lit("row"), *row)})
    own = written(fingerprints(keyed, id_col, text_col, shingle, keys), "simhash")
    roots = connected_components(near_links(own, radius))
    each = own.groupBy("fp").agg(F.min(F.struct(F.isnull("id").alias("last"), "id", *keys)).alias("least"))
    groups = each.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
    return keyed.join(groups.select("least.__a", "least.__b"), [*keys], "left_semi").dropDuplicates([*keys]).select(*docs.columns)
