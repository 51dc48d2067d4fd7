"""Exact substring deduplication with fixed-block anchors.

A repeated window of 20 words holds at least one block of 10 words that starts at a multiple of 10 in its own document.
These non-overlapping blocks are the index; every rolling 10-word window probes it. Rows are sorted by id and cut, as
they pass, into "strips" of a few MB, so that which occurrence comes first is a question of strip order, and inside a
strip of row order. Hashes travel as sorted, delta-coded, compressed arrays, one row for each pair of strip and hash
range:

1. every strip sends the truncated hashes of its index blocks and probes; each hash range answers with the probes of a
   strip that hit another strip's blocks;
2. windows around a hit send their full 128-bit hashes; each range answers with those that an earlier strip has too;
3. with these and the repeats inside the strip, overlapping windows merge into maximal repeats, which are cut out.

No hash is ever wider spread than its range, and no row is larger than a strip (or than one text, if that is larger).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat_words, one, require, slices, tidy, tidy_group, tidy_pair, without, written

WINDOW = 20
#: Text of a strip. From ``LARGE`` bytes of text on, strips and hash ranges grow with the root of the corpus up to the larger
#: sizes, so that pairs of strip and range number about corpus / LARGE times 16,000 until then.
STRIP_BYTES, MOST_STRIP, MOST_RANGE, LARGE = 8 << 20, 64 << 20, 256 << 20, 64 << 30
#: Text that one task sorts by id.
SORTED_BYTES = 64 << 20
#: Text that is split into words at once, and hashes that are worked on at once.
PART_BYTES, SPAN = 1 << 20, 1 << 16
#: A strip is a page and a row group of its own, or nearly: a task that reads some holds one at a time.
ROW_BY_ROW = {"parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")
_C1, _C2 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)


def _pack(columns: dict[str, pa.Array]) -> bytes:
    batch, sink = pa.record_batch(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_ZSTD) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _squeeze(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys: differences by byte plane, compressed."""
    planes = np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)
    return _plain(planes)


def _swell(blob: bytes) -> np.ndarray:
    planes = _raw(blob).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _plain(values: np.ndarray) -> bytes:
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _raw(blob: bytes) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    return np.frombuffer(pa.decompress(blob[8:], size, codec="zstd", asbytes=True) if size else b"", np.uint8)


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = (x * _C1) ^ (x >> np.uint64(31))
    z = (z + y) * _C2
    return z ^ (z >> np.uint64(29))


def _rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values, in log k joins."""
    done, span, need = None, h, k
    width, at = 1, 0
    while need:
        if need & 1:
            n = len(h) - at - width + 1
            if n <= 0:
                return np.zeros(0, np.uint64)
            done = span[at : at + n] if done is None else _join(done[:n], span[at : at + n])
            at += width
        need >>= 1
        if need:
            span = _join(span[:-width], span[width:]) if len(span) > width else np.zeros(0, np.uint64)
            width *= 2
    return done


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """of: ascending."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The keys sorted, in place, each once."""
    keys.sort()
    return keys[np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])]


def _alike(full: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs of hashes (equal ones as they come), and what of it is the same pair as the one before."""
    order = np.lexsort((check, full))
    again = np.zeros(len(order), bool)
    for i in range(1, len(order), SPAN):
        y = order[i : i + SPAN]
        x = order[i - 1 : i - 1 + len(y)]
        again[i : i + SPAN] = (full[x] == full[y]) & (check[x] == check[y])
    return order, again


class _Strip:
    """The rows of one strip in order, with the hashes of their words.

    Text is split into words a part at a time, and of the windows' hashes only those that are asked for are made, so that
    a strip takes some numbers of 8 bytes for each word, not all words and all hashes at once.
    """

    def __init__(self, blob: bytes, window: int, wide: bool):
        self.rows, self.block, self.window = _unpack(blob), window // 2, window
        sizes, hashes = [np.zeros(0, np.int64)], [[np.zeros(0, np.uint64)] for _ in range(1 + wide)]
        for part in self.parts():
            words, offsets = flat_words(part.column("text"))
            sizes.append(np.diff(offsets))
            coded = words.dictionary_encode()
            codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.large_binary()).to_pylist()
            for seed, held in enumerate(hashes):
                held.append(np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in names), np.uint64, len(names))[codes])
        self.size = np.concatenate(sizes)
        self.offsets = np.concatenate([[0], np.cumsum(self.size)])
        self.n = int(self.offsets[-1])
        self.hashes = []
        while hashes:
            self.hashes.append(np.concatenate(hashes.pop(0)))
        size = self.size.astype(np.int32)  # a text has fewer words than 2^31
        place = np.arange(self.n, dtype=np.int32)
        place -= np.repeat(self.offsets[:-1].astype(np.int32), size)
        left = np.repeat(size, size)
        left -= place
        self.probes, self.windows = left >= self.block, left >= window
        self.anchors = self.probes & (place % np.int32(self.block) == 0)

    def parts(self):
        """The rows in runs of about ``PART_BYTES`` of text."""
        for batch in self.rows.to_batches():
            yield from slices(batch, self.rows.column_names.index("text"), PART_BYTES)

    def rolled(self, k: int, seed: int = 0) -> np.ndarray:
        """The hash of the k words from each word on; 0 where there are fewer."""
        h, out = self.hashes[seed], np.zeros(self.n, np.uint64)
        for i in range(0, self.n - k + 1, SPAN):
            found = _rolling(h[i : i + SPAN + k - 1], k)
            out[i : i + len(found)] = found
        return out

    def pairs(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of the windows at ``where``; the words' hashes go meanwhile."""
        full = self.rolled(self.window)[where]
        self.hashes[0] = None
        check = self.rolled(self.window, 1)[where]
        self.hashes[1] = None
        return full, check

    def around(self, hit: np.ndarray) -> np.ndarray:
        """Windows that hold a hit block."""
        return self.windows & _within(hit, 0, self.block + 1)


def _within(marks: np.ndarray, first: int, last: int) -> np.ndarray:
    """Places i with a mark at i + first, ... or i + last - 1."""
    before, i = np.zeros(len(marks) + 1, np.int32), np.arange(len(marks), dtype=np.int32)
    np.cumsum(marks, out=before[1:])
    return before[np.minimum(i + last, len(marks))] > before[np.maximum(i + first, 0)]


def _sizes(total: int, strip_bytes: int) -> tuple[int, int]:
    """(text of a strip, number of hash ranges) for ``total`` bytes of text."""
    growth = max(1.0, math.sqrt(total / LARGE))
    strip = max(strip_bytes, min(MOST_STRIP, int(strip_bytes * growth)))
    return strip, max(1, math.ceil(total / max(strip, min(MOST_RANGE, int(strip * growth)))))


def _strips(docs: DataFrame, id_col: str, text_col: str, others: list[str], total: int, strip_bytes: int) -> DataFrame:
    """(strip long, rows binary): rows in the order of id and text, ``strip_bytes`` of text each or a little more, strips in order.

    The sort is by ranges of id and of the text's beginning, so that even an id that many rows share is dealt to many
    tasks; ids may be of any type that has an order.
    """
    names = ["id", "text", *(f"c{k}" for k in range(len(others)))]
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip((id_col, text_col, *others), names, strict=True)))
    ranged = plain.repartitionByRange(max(1, math.ceil(total / SORTED_BYTES)), F.col("id"), F.substring("text", 1, 64)).sortWithinPartitions("id", "text")

    @tidy
    def cut(batches):
        part, n, size = TaskContext.get().partitionId(), 0, 0
        held: list[pa.RecordBatch] = []

        def strip():
            whole = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | n], pa.int64()), pa.array([_pack({c: one(whole[c]) for c in names})], pa.binary())], names=["strip", "rows"])

        for batch in (piece for b in batches for piece in slices(b, 1, strip_bytes // 4)):
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= strip_bytes:
                yield strip()
                held, n, size = [], n + 1, 0
        if held:
            yield strip()

    return written(ranged.mapInArrow(cut, "strip long, rows binary"), "strips", **ROW_BY_ROW)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, strip_bytes: int = STRIP_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` plus n_words long, n_removed long, kept_text string (in place of such columns of ``docs``).

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if it lies in a window of ``window`` (even) words whose
    words also start earlier: in a row of smaller id, or earlier in the same row. kept_text: the other words, joined by
    one space. A null text has no words and gives an empty kept_text. Ids are of any type with an order; null ids come
    before all others. Of rows with the same id, the smaller text comes first; of equal rows, one (any) is the first. An
    empty table gives no rows. A very long text is a strip of its own and takes a task with memory for a few copies of it.
    """
    require(docs, id_col, text_col)
    if window < 4 or window % 2:
        raise ValueError("window must be even and 4 at least")
    docs = without(docs, "n_words", "n_removed", "kept_text")
    block, others = window // 2, [c for c in docs.columns if c not in (id_col, text_col)]
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    strip_bytes, n_ranges = _sizes(total, strip_bytes)
    bits = np.uint64(min(62, max(24, math.ceil(math.log2(max(2, total / 5)))) + 10))
    strips = _strips(docs, id_col, text_col, others, total, strip_bytes)

    def ranges(keys: np.ndarray, width: int):
        """Ascending keys of ``width`` bits cut into hash ranges: (range, slice)."""
        edge = np.searchsorted(keys, np.array([(k << width) // n_ranges + bool((k << width) % n_ranges) for k in range(1, n_ranges)], np.uint64))
        for r, (i, j) in enumerate(zip([0, *edge], [*edge, len(keys)], strict=True)):
            if j > i:
                yield r, slice(i, j)

    @tidy_group
    def send(group: pa.Table) -> pa.Table:
        s, strip = group["strip"][0].as_py(), _Strip(group["rows"][0].as_py(), window, False)
        keys = strip.rolled(block)
        keys >>= np.uint64(64) - bits
        probes, blocks = _distinct(keys[strip.probes]), _distinct(keys[strip.anchors])
        both = {r: [_squeeze(probes[x]), _squeeze(probes[:0])] for r, x in ranges(probes, int(bits))}
        for r, x in ranges(blocks, int(bits)):
            both[r][1] = _squeeze(blocks[x])
        return pa.table({"bin": pa.array(list(both), pa.int64()), "strip": pa.array([s] * len(both), pa.int64()), "probes": pa.array([x[0] for x in both.values()], pa.binary()), "blocks": pa.array([x[1] for x in both.values()], pa.binary())})

    @tidy_group
    def probe(group: pa.Table) -> pa.Table:
        strips = group["strip"].to_pylist()
        blocks = [_swell(b) for b in group["blocks"].to_pylist()]
        keys, owner = np.concatenate(blocks), np.repeat(np.array(strips), [len(b) for b in blocks])
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        first = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1)) != 0) if len(keys) else np.zeros(0, np.int64)
        index = keys[first]
        sole = np.where(np.diff(np.append(first, len(keys))) == 1, owner[first], -1)  # a strip sends a block once
        out = []
        for s, blob in zip(strips, group["probes"].to_pylist(), strict=True):
            p = _swell(blob)
            at = np.minimum(np.searchsorted(index, p), max(0, len(index) - 1))
            hits = p[(index[at] == p) & (sole[at] != s)] if len(index) else p[:0]
            if len(hits):
                out.append((s, _squeeze(hits)))
        return pa.table({"strip": pa.array([x[0] for x in out], pa.int64()), "hits": pa.array([x[1] for x in out], pa.binary())})

    @tidy_pair
    def widen(left: pa.Table, right: pa.Table) -> pa.Table:
        nothing = pa.table({"bin": pa.array([], pa.int64()), "strip": pa.array([], pa.int64()), "full": pa.array([], pa.binary()), "check": pa.array([], pa.binary())})
        if not left.num_rows or not right.num_rows:
            return nothing
        s, strip = left["strip"][0].as_py(), _Strip(left["rows"][0].as_py(), window, True)
        hits = np.sort(np.concatenate([_swell(b) for b in right["hits"].to_pylist()]))
        keys = strip.rolled(block)
        keys >>= np.uint64(64) - bits
        hit = strip.probes & _member(keys, hits)
        del keys, hits
        full, check = strip.pairs(strip.around(hit))
        order, again = _alike(full, check)
        order = order[~again]
        full, check = full[order], check[order]
        out = [(r, _squeeze(full[x]), _plain(check[x])) for r, x in ranges(full, 64)]
        return pa.table({"bin": pa.array([x[0] for x in out], pa.int64()), "strip": pa.array([s] * len(out), pa.int64()), "full": pa.array([x[1] for x in out], pa.binary()), "check": pa.array([x[2] for x in out], pa.binary())})

    @tidy_group
    def earlier(group: pa.Table) -> pa.Table:
        strips, at = np.unique(group["strip"].to_numpy(), return_index=True)  # a strip sends one row, if any; in their order the first of equal pairs is the earliest
        parts = [_swell(group["full"][int(k)].as_py()) for k in at]
        size, full = [len(x) for x in parts], np.concatenate(parts)
        del parts
        check = np.concatenate([_raw(group["check"][int(k)].as_py()).view(np.uint64) for k in at])
        owner = np.repeat(np.arange(len(at), dtype=np.int32), size)
        order, again = _alike(full, check)
        told = order[again]  # ascending by pair
        told = told[np.argsort(owner[told], kind="stable")]
        edge = np.searchsorted(owner[told], np.arange(len(at) + 1))
        out = [(int(s), _squeeze(full[told[i:j]]), _plain(check[told[i:j]])) for s, i, j in zip(strips, edge[:-1], edge[1:], strict=True) if j > i]
        return pa.table({"strip": pa.array([x[0] for x in out], pa.int64()), "full": pa.array([x[1] for x in out], pa.binary()), "check": pa.array([x[2] for x in out], pa.binary())})

    @tidy_pair
    def cut_out(left: pa.Table, right: pa.Table) -> pa.Table:
        strip = _Strip(left["rows"][0].as_py(), window, True) if left.num_rows else None
        if strip is None:
            return pa.table({f.name: pa.array([], f.type) for f in arrow_out})
        full, check = strip.pairs(strip.windows)
        n_own, n_told = len(full), 0
        if right.num_rows:
            # what earlier strips have stands before the strip's own windows; of equal pairs of hashes all but the first are repeats
            full = np.concatenate([*(_swell(b) for b in right["full"].to_pylist()), full])
            n_told = len(full) - n_own
            check = np.concatenate([*(_raw(b).view(np.uint64) for b in right["check"].to_pylist()), check])
        order, again = _alike(full, check)
        del full, check
        seat = order[again] - n_told
        del order, again
        flagged = np.zeros(strip.n, bool)
        flagged[np.flatnonzero(strip.windows)[seat[seat >= 0]]] = True
        del seat
        kept = ~_within(flagged, 1 - window, 1)
        before = np.zeros(strip.n + 1, np.int32)
        np.cumsum(kept, out=before[1:])
        left_over = before[strip.offsets]
        del flagged, before
        texts, row, word = [], 0, 0
        for part in strip.parts():
            words, offsets = flat_words(part.column("text"))
            words = words.filter(pa.array(kept[word : word + offsets[-1]]))
            lists = pa.ListArray.from_arrays(pa.array(left_over[row : row + part.num_rows + 1] - left_over[row], pa.int32()), words)
            texts.append(pc.binary_join(lists, pa.scalar(" ", words.type)).cast(pa.string()))
            row, word = row + part.num_rows, word + offsets[-1]
        columns = [*(strip.rows[n] for n in strip.rows.column_names), pa.array(strip.size, pa.int64()), pa.array(strip.size - np.diff(left_over), pa.int64()), pa.chunked_array(texts, pa.string())]
        return pa.table({f.name: (c if isinstance(c, pa.ChunkedArray) else pa.chunked_array([c])).cast(f.type) for f, c in zip(arrow_out, columns, strict=True)})

    from pyspark.sql.pandas.types import to_arrow_schema

    inner = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("text", T.StringType()), *(T.StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(others)), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    arrow_out = to_arrow_schema(inner)
    by_strip = strips.groupBy("strip")
    sent = by_strip.applyInArrow(send, "bin long, strip long, probes binary, blocks binary")
    hits = sent.groupBy("bin").applyInArrow(probe, "strip long, hits binary")
    wide = by_strip.cogroup(hits.groupBy("strip")).applyInArrow(widen, "bin long, strip long, full binary, check binary")
    told = wide.groupBy("bin").applyInArrow(earlier, "strip long, full binary, check binary")
    done = by_strip.cogroup(told.groupBy("strip")).applyInArrow(cut_out, inner)
    names = {"id": id_col, "text": text_col, **{f"c{k}": c for k, c in enumerate(others)}}
    return done.select(*(F.col(k).alias(v) for k, v in names.items()), "n_words", "n_removed", "kept_text").select(*docs.columns, "n_words", "n_removed", "kept_text")
