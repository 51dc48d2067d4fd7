"""Packing as a cutting-stock problem: patterns of piece lengths by column generation, handed out to ranked documents."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import one, require, slices, tidy, written
from .packing import _CODERS, END, TEXT_AT_ONCE, WordIds, vocabulary_path

CAPACITY = 2048
#: Other lengths that a first pattern is made of, lengths that one pricing step looks at, pivots at most, and the seed of their order.
DRAWN, PRICED, PIVOTS, SEED = 48, 256, 500, 11
#: Rows of a length that one task ranks: a thousandth of all, within these bounds.
LEAST_BIN, MOST_BIN = 64, 200_000
#: Pieces that go on to the next step at once.
ROWS_AT_ONCE = 200
_EPS, LEAST_PIVOT = 1e-9, 1e-5


def free_sums(capacity: int) -> list[int]:
    """Sums of a sequence that need no padding: the capacity and the powers of two below it, largest first."""
    return [capacity] + [1 << k for k in range(capacity.bit_length(), -1, -1) if 1 << k < capacity]


def knapsack(lengths: list[int], worth: np.ndarray, most: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Best worth of every exact sum up to ``capacity`` with ``most`` pieces of each length, and what to read a pattern from.

    The pieces of a length come in bundles of 1, 2, 4 and so on and the rest; dynamic programming takes each or not.
    """
    bundles = []
    for k, (length, n) in enumerate(zip(lengths, most, strict=True)):
        size, left = 1, min(n, capacity // length)
        while left > 0:
            bundles.append((k, min(size, left)))
            size, left = 2 * size, left - size
    value, taken = np.full(capacity + 1, -np.inf), np.zeros((len(bundles), capacity + 1), bool)
    value[0] = 0
    for b, (k, n) in enumerate(bundles):
        w = lengths[k] * n
        better = value[: capacity + 1 - w] + worth[k] * n
        np.greater(better, value[w:] + _EPS, out=taken[b, w:])
        np.copyto(value[w:], better, where=taken[b, w:])
    return value, taken, bundles


def pattern_at(total: int, lengths: list[int], taken: np.ndarray, bundles: list[tuple[int, int]]) -> dict[int, int]:
    """The pattern {length: pieces} that the sum ``total`` was reached with."""
    out: dict[int, int] = {}
    for b in range(len(bundles) - 1, -1, -1):
        if total and taken[b, total]:
            k, n = bundles[b]
            out[lengths[k]] = out.get(lengths[k], 0) + n
            total -= lengths[k] * n
    return out


class Master:
    """The linear program: every length's pieces go to patterns or to the tape, at least cost.

    The tape is what is laid end to end and cut at the capacity; a piece on it costs its share of a cut. A pattern that
    fills the capacity costs nothing, one that ends at a smaller power of two nine tenths of the tape. Revised simplex
    with the inverse of the basis; the tape is the first basis.
    """

    def __init__(self, demand: dict[int, int], capacity: int, first: list[dict[int, int]]):
        """``first``: patterns that enter in this order, each until a length is used up, which then leaves the tape."""
        self.lengths, self.capacity = sorted(demand, reverse=True), capacity
        self.at = {length: k for k, length in enumerate(self.lengths)}
        self.need = np.array([demand[length] for length in self.lengths], float)
        self.basis: list[dict[int, int] | None] = [None] * len(self.lengths)
        self.level, order = self.need.copy(), []
        for pattern in first:
            index, times = np.array([self.at[x] for x in pattern]), np.array(list(pattern.values()), float)
            ratio = self.level[index] / times
            row = int(index[np.argmin(ratio)])
            if self.basis[row] is None and ratio.min() > _EPS:
                self.level[index] = np.maximum(0, self.level[index] - ratio.min() * times)
                self.basis[row], self.level[row] = pattern, ratio.min()
                order.append(row)
        # a length that is used up stands in no later pattern: in the order of entering the basis is triangular
        self.inverse, entered = np.eye(len(self.lengths)), []
        uses = np.zeros((len(self.lengths), len(self.lengths)))
        for row in order:
            for length, n in self.basis[row].items():
                uses[self.at[length], row] = n
        for row in order:
            earlier = [k for k in entered if uses[row, k]]
            self.inverse[row] = (self.inverse[row] - (uses[row, earlier][:, None] * self.inverse[earlier]).sum(axis=0)) / uses[row, row]
            entered.append(row)
        for row in set(range(len(self.lengths))) - set(order):
            earlier = np.flatnonzero(uses[row])
            self.inverse[row] -= (uses[row, earlier][:, None] * self.inverse[earlier]).sum(axis=0)
        worth = [x / capacity if p is None else self.cost(sum(y * n for y, n in p.items())) for x, p in zip(self.lengths, self.basis, strict=True)]
        self.duals = (np.array(worth)[:, None] * self.inverse).sum(axis=0)

    def tape_and_more(self) -> float:
        """What the present numbers cost."""
        return float((self.duals * self.need).sum())

    def cost(self, total: int) -> float:
        return 0.0 if total == self.capacity else 0.9 * total / self.capacity

    def enter(self, pattern: dict[int, int]) -> bool:
        """One pivot, if the pattern still lowers the cost."""
        index, times = np.array([self.at[x] for x in pattern]), np.array(list(pattern.values()), float)
        reduced = self.cost(sum(x * n for x, n in pattern.items())) - (self.duals[index] * times).sum()
        if reduced > -1e-7:
            return False
        step = (self.inverse[:, index] * times).sum(axis=1)
        up = np.flatnonzero(step > LEAST_PIVOT)
        if not len(up):
            return False
        ratio = self.level[up] / step[up]
        ties = up[ratio <= ratio.min() * (1 + 1e-9) + 1e-7]
        row = int(ties[np.argmax(step[ties])])  # the largest pivot of those that come first, so that errors stay small
        least = self.level[row] / step[row]
        pivot = self.inverse[row] / step[row]
        columns, rows = np.flatnonzero(np.abs(pivot) > 1e-13), np.flatnonzero(np.abs(step) > 1e-12)
        rows = rows[rows != row]
        self.inverse[np.ix_(rows, columns)] -= np.outer(step[rows], pivot[columns])
        self.inverse[row] = pivot
        self.level[rows] -= least * step[rows]
        self.level[row] = least
        np.maximum(self.level, 0, out=self.level)
        self.duals += reduced * pivot
        self.basis[row] = pattern
        return True

    def solution(self) -> list[tuple[dict[int, int], float]]:
        """The patterns of the basis with their number."""
        return [(pattern, float(v)) for pattern, v in zip(self.basis, self.level, strict=True) if pattern is not None]


def generate(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], float]]:
    """Patterns and their fractional numbers: columns are priced by knapsacks until none lowers the cost.

    The first columns are patterns of the longest pieces at the tape's prices, each used up in turn. Then a pricing step
    sees ``PRICED`` lengths, all of which take turns in a seeded order. When a whole turn finds nothing, all lengths are
    priced together, and if that finds nothing either the program is solved. It ends earlier when all that is on the tape
    costs under half a sequence, or after ``PIVOTS`` pivots: what is then still on the tape stays whole, only less well
    packed.
    """
    if not demand:
        return []
    master, rng, pivots = Master(demand, capacity, [p for p, _ in fill(demand, capacity)[0]]), np.random.default_rng(SEED), 0
    while pivots < PIVOTS and master.tape_and_more() > 0.5:
        order, found = rng.permutation(len(master.lengths)), 0
        for i in range(0, len(order), PRICED):
            got = _price(master, sorted(order[i : i + PRICED].tolist()), demand)
            found, pivots = found + got, pivots + got
            if pivots >= PIVOTS:
                break
        if not found:
            got = _price(master, list(range(len(master.lengths))), demand)
            pivots += got
            if not got:
                break
    return master.solution()


def _price(master: Master, block: list[int], demand: dict[int, int]) -> int:
    lengths = [master.lengths[k] for k in block]
    value, taken, bundles = knapsack(lengths, master.duals[block], [demand[x] for x in lengths], master.capacity)
    got = 0
    for total in free_sums(master.capacity)[:4]:
        if value[total] > master.cost(total) + 1e-7:
            got += master.enter(pattern_at(total, lengths, taken, bundles))
    return got


def fill(demand: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Patterns used as often as they can be, the longest piece first, each with other lengths drawn at random; and the rest."""
    rng, tape, out = np.random.default_rng(SEED), {}, []
    left = {length: n for length, n in sorted(demand.items(), reverse=True) if n > 0}
    while left:
        top = next(iter(left))
        others = [x for x in left if x != top]
        drawn = set(rng.choice(others, DRAWN, replace=False).tolist() if len(others) > DRAWN else others)
        drawn = sorted(drawn | ({capacity - top} & left.keys() - {top}), reverse=True)
        lengths, most = [top, *drawn], [left[top] - 1, *(left[x] for x in drawn)]
        room = capacity - top
        value, taken, bundles = knapsack(lengths, np.array(lengths) / capacity - 1e-4, most, room)
        if value[room] > -np.inf:
            pattern = pattern_at(room, lengths, taken, bundles)
            pattern[top] = pattern.get(top, 0) + 1
            n = min(left[x] // k for x, k in pattern.items())
            out.append((pattern, n))
        else:
            pattern, n = {top: 1}, left[top]
            tape[top] = n
        for length, k in pattern.items():
            left[length] -= n * k
            if not left[length]:
                del left[length]
    return out, tape


def patterns(demand: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Patterns with whole numbers, and the pieces of each length that none takes.

    Numbers of the linear program are rounded down; what that leaves, a few pieces of a length whatever their number, is
    filled by the same knapsack.
    """
    left, out = {length: n for length, n in demand.items() if n > 0}, []
    for pattern, x in generate(left, capacity):
        n = min([int(x + 1e-6), *(left[length] // k for length, k in pattern.items())])
        if n > 0:
            out.append((pattern, n))
            for length, k in pattern.items():
                left[length] -= n * k
    more, tape = fill(left, capacity)
    return out + more, tape


@dataclass
class Places:
    """Where the piece of a length and a rank goes: ranges of ranks, sorted by length and first rank, and the tape."""

    key: np.ndarray
    low: np.ndarray
    times: np.ndarray
    offset: np.ndarray
    sequence: np.ndarray
    tape: np.ndarray
    first: int
    whole: int
    tail: np.ndarray
    capacity: int

    @staticmethod
    def of(found: list[tuple[dict[int, int], int]], tape: dict[int, int], capacity: int) -> Places:
        """Sequences are numbered pattern by pattern, then along the tape; the tape's end is cut into powers of two."""
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for pattern, n in found:
            offset = 0
            for length, times in sorted(pattern.items(), reverse=True):
                low = used.get(length, 0)
                rows.append((length, low, times, offset, sequence, -1))
                used[length] = low + n * times
                offset += length * times
            sequence += n
        total = 0
        for length, n in sorted(tape.items(), reverse=True):
            rows.append((length, used.get(length, 0), 1, 0, sequence, total))
            total += length * n
        rows.sort()
        columns = np.array(rows, np.int64).reshape(-1, 6).T
        rest, whole = total % capacity, total // capacity
        sizes = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
        tail = whole * capacity + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)
        return Places((columns[0] << 44) + columns[1], columns[1], columns[2], columns[3], columns[4], columns[5], sequence, whole, tail, capacity)

    def chunk(self, at: int) -> tuple[int, int, int]:
        """The number, start and end of the tape's chunk that holds position ``at``."""
        if at < self.whole * self.capacity:
            k = at // self.capacity
            return k, k * self.capacity, (k + 1) * self.capacity
        k = int(np.searchsorted(self.tail, at, side="right")) - 1
        return self.whole + k, int(self.tail[k]), int(self.tail[k + 1])

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
        """Rows (which piece, first id within it, ids, sequence, offset): one for a piece, more for one that the tape cuts."""
        k = np.searchsorted(self.key, (length << 44) + rank, side="right") - 1
        turn = rank - self.low[k]
        laid = self.tape[k] >= 0
        sequence, offset = self.sequence[k] + turn // self.times[k], self.offset[k] + turn % self.times[k] * length
        which = np.flatnonzero(~laid)
        parts = [[which], [np.zeros(len(which), np.int64)], [length[which]], [sequence[which]], [offset[which]]]
        more: list[tuple[int, int, int, int, int]] = []
        for j in np.flatnonzero(laid).tolist():
            at = start = int(self.tape[k[j]] + turn[j] * length[j])
            end = start + int(length[j])
            while at < end:
                number, low, high = self.chunk(at)
                more.append((j, at - start, min(end, high) - at, self.first + number, at - low))
                at = min(end, high)
        for column, values in zip(parts, zip(*more, strict=True) if more else [()] * 5, strict=True):
            column.append(np.array(values, np.int64))
        return [np.concatenate(c) for c in parts]


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int, end_id: int) -> DataFrame:
    """(id, start, length, crc, doc_tokens, ids): documents' ids with the end id, cut every ``capacity``; ``ids`` of shorter pieces alone."""

    def as_batch(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([one(batch.column(0)).take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:5]), pa.array(columns[5], pa.binary())], names=["id", "start", "length", "crc", "doc_tokens", "ids"])

    @tidy
    def run(batches):
        coder = _CODERS.get(path) or _CODERS.setdefault(path, WordIds(path))
        for batch in (part for b in batches for part in slices(b, 1, TEXT_AT_ONCE)):
            rows: list[tuple] = []
            for k, ids in enumerate(coder(pc.fill_null(one(batch.column(1)), ""))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for i in range(0, len(ids), capacity):
                    own = ids[i : i + capacity].tobytes()
                    rows.append((k, i, len(own) // 4, zlib.crc32(own), len(ids), own if len(own) < 4 * capacity else None))
                if len(rows) >= ROWS_AT_ONCE:
                    yield as_batch(batch, rows)
                    rows = []
            yield as_batch(batch, rows)

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in ("start", "length", "crc", "doc_tokens")), T.StructField("ids", T.BinaryType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def ranked(rows: DataFrame, demand: dict[int, int]) -> DataFrame:
    """``rows`` (pid, length, ...) with rank, from 0 within each length, in bins of rows so that no length is ranked by one task."""
    most = min(MOST_BIN, max(LEAST_BIN, sum(demand.values()) // 1000))
    hot = {length: -(-n // most) for length, n in demand.items() if n > most}
    parts: Column = F.lit(1)
    if hot:
        parts = F.coalesce(F.create_map(*(F.lit(x).cast("long") for pair in hot.items() for x in pair))[F.col("length")], F.lit(1).cast("long"))
    rows = rows.withColumn("bin", F.pmod(F.xxhash64("pid"), parts))
    counts = rows.groupBy("length", "bin").agg(F.count("*").alias("n"))
    before = counts.select("length", "bin", (F.sum("n").over(Window.partitionBy("length").orderBy("bin")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "bin").orderBy("pid"))
    return rows.withColumn("place", place).join(before, ["length", "bin"]).withColumn("rank", F.col("before") + F.col("place") - 1).drop("bin", "before", "place")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END) -> DataFrame:
    """One row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and ``end_id``; a null text is an empty one. Documents of over ``capacity`` ids are cut
    there. The driver sees how many pieces each length has, ``capacity`` numbers at most, and finds patterns of lengths
    that fill sequences whole; pieces are ranked within their length, and pattern and place follow from length and rank by
    arithmetic. What no pattern takes is laid end to end and cut where a sequence is full, and the last, partly full one
    into powers of two; so no sequence is padded, and besides long documents about one for each such sequence is cut.

    The longest text is tokenised whole, by one task. Rows that repeat an id are packed one by one. An empty table gives
    no rows; other columns are ignored.
    """
    require(docs, id_col, text_col)
    own = written(pieces(docs, id_col, text_col, path or vocabulary_path(), capacity, end_id).withColumn("pid", F.monotonically_increasing_id()), "stock")
    demand = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = Places.of(*patterns(demand, capacity), capacity)
    kind = docs.schema[id_col].dataType.simpleString()

    @tidy
    def place(batches):
        for batch in batches:
            column = {n: one(batch.column(n)) for n in batch.schema.names}
            which, at, size, sequence, offset = places(column["length"].to_numpy(), column["rank"].to_numpy())
            taken = {n: column[n].take(pa.array(which)) for n in ("pid", "id", "start", "crc", "doc_tokens")}
            cut = size < column["length"].to_numpy()[which]
            new = [pa.array(at), pa.array(size), pa.array(sequence), pa.array(offset), pa.array(cut)]
            yield pa.RecordBatch.from_arrays([*taken.values(), *new], names=[*taken, "at", "length", "sequence_id", "offset", "cut"])

    schema = f"pid long, id {kind}, start long, crc long, doc_tokens long, at long, length long, sequence_id long, offset long, cut boolean"
    placed = written(ranked(own.select("pid", "id", "start", "length", "crc", "doc_tokens"), demand).mapInArrow(place, schema), "placed")

    @tidy
    def checksums(batches):
        for batch in batches:
            column = {n: one(batch.column(n)) for n in batch.schema.names}
            crc = [zlib.crc32(x[4 * a : 4 * (a + n)]) for x, a, n in zip(column["ids"].to_pylist(), column["at"].to_pylist(), column["length"].to_pylist(), strict=True)]
            column["crc"] = pa.array(crc, pa.int64())
            yield pa.RecordBatch.from_arrays([column[n] for n in fields], names=fields)

    fields = ["id", "start", "at", "length", "crc", "doc_tokens", "sequence_id", "offset"]
    # written, so that its size is known: as a rule few pieces are cut, and only then their ids stay where they are
    few = written(placed.where("cut").drop("cut", "crc"), "cut")
    parts = few.join(own.select("pid", "ids"), "pid").mapInArrow(checksums, f"id {kind}, " + ", ".join(f"{n} long" for n in fields[1:]))
    every = placed.where("not cut").select(*fields).union(parts)
    return every.select(F.col("id").alias(id_col), (F.col("start") + F.col("at")).alias("start"), "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
