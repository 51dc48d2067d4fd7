"""Best-fit packing of tokenised documents into fixed-length sequences, in bulk-synchronous sweeps."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat_words, new_path, one, require, slices, tidy, written

CAPACITY, END = 4096, 1
#: Distinct words each Python worker keeps with their ids; further ones are encoded again in each batch.
KEPT_WORDS = 400_000
#: Bytes of text that are tokenised at once.
TEXT_AT_ONCE = 8 << 20
#: How narrow a band of long pieces is.
NARROW = 0.92
#: Slots that a gap has in one superstep at most (the rest of it takes part in the next), and rows of a size that one task ranks.
MOST_SLOTS, ROWS_A_BIN = 64, 500_000
_PLAIN = r"^[a-zß-öø-ÿ]+$"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of texts by a vocabulary whose pieces never cross white space.

    The distinct words of a batch are looked up among the words known so far; the others are encoded once. A trailing run
    of ``.,;:!?`` after a letter is a piece of its own in the vocabulary's pattern and is split off, so that fewer words
    are distinct. Words of lower-case letters alone need no pattern: many are encoded in one call, and the end-of-word mark
    of their last piece tells them apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.full.get_vocab_size()
        self.last = np.array([(self.full.id_to_token(k) or "").endswith("</w>") for k in range(size)])
        self.known = pa.array([], pa.large_string())
        self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in one array, where each word's begin, and how many it has."""
        plain = pc.match_substring_regex(words, _PLAIN)
        flat, size = [], np.zeros(len(words), np.int64)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(pc.invert(plain))])
        simple = words.filter(plain).to_pylist()
        at = 0
        for i in range(0, len(simple), 5000):
            part = simple[i : i + 5000]
            ids = np.array(self.plain.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(self.last[ids]) + 1
            if len(stops) != len(part):
                raise ValueError("the vocabulary marks no ends of words")
            size[order[at : at + len(part)]] = np.diff(stops, prepend=0)
            flat.append(ids)
            at += len(part)
        rest = words.filter(pc.invert(plain)).to_pylist()
        for i in range(0, len(rest), 5000):
            found = [e.ids for e in self.full.encode_batch_fast(rest[i : i + 5000], add_special_tokens=False)]
            size[order[at : at + len(found)]] = [len(x) for x in found]
            flat.append(np.array([x for ids in found for x in ids], np.uint32))
            at += len(found)
        first = np.empty(len(words), np.int64)
        first[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate([*flat, np.zeros(0, np.uint32)]), first, size

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For distinct words how many ids each has, and all of them in one array."""
        # lower case is the same to the vocabulary, but not in the strings of its special tokens
        chunks = pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words))
        ends = pc.match_substring_regex(chunks, r"[a-zà-öø-ÿ][.,;:!?]+$")
        stems = pc.if_else(ends, pc.utf8_rtrim(chunks, ".,;:!?"), chunks)
        tails = pc.replace_with_mask(pa.array([""] * len(chunks), chunks.type), ends, pc.replace_substring_regex(chunks.filter(ends), r"^.*?([.,;:!?]+)$", r"\1"))
        parts = pa.concat_arrays([stems, tails]).dictionary_encode()
        flat, first, size = self._encode(parts.dictionary)
        index = parts.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T.ravel()  # stem and tail of each word in turn
        return size[index].reshape(-1, 2).sum(axis=1), _runs(flat, first, size, index)

    def __call__(self, texts: pa.Array):
        """For every text its ids, without special tokens."""
        words, offsets = flat_words(texts)
        coded = words.dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.known)
        at, size, flat = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64), self.size, self.flat
        if found.null_count:
            fresh = coded.dictionary.filter(pc.is_null(found))
            n, ids = self._words(fresh)
            at[at < 0] = len(size) + np.arange(len(fresh))
            size, flat = np.concatenate([size, n]), np.concatenate([flat, ids])
            if len(size) <= KEPT_WORDS:
                self.known, self.size, self.flat = pa.concat_arrays([self.known, fresh.cast(pa.large_string())]), size, flat
        first = np.cumsum(size) - size
        codes = coded.indices.to_numpy(zero_copy_only=False)
        for i, j in _slices(offsets, 500_000):
            own = at[codes[offsets[i] : offsets[j]]]
            edge = np.concatenate([[0], np.cumsum(size[own])])[offsets[i : j + 1] - offsets[i]]
            got = _runs(flat, first, size, own)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                yield got[a:b]


def _runs(flat: np.ndarray, first: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of a flat array, one behind the other."""
    n = size[which]
    done = np.cumsum(n)
    return flat[np.arange(done[-1] if len(done) else 0) + np.repeat(first[which] - (done - n), n)]


def _slices(offsets: np.ndarray, most: int):
    """Runs [i, j) of texts with about ``most`` words each, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_CODERS: dict[str, WordIds] = {}


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END) -> DataFrame:
    """(id, piece, start, length, crc) of every document: its ids and the end id, cut every ``capacity`` ids only."""
    path = path or vocabulary_path()

    @tidy
    def run(batches):
        coder = _CODERS.get(path) or _CODERS.setdefault(path, WordIds(path))
        for batch in (part for b in batches for part in slices(b, 1, TEXT_AT_ONCE)):
            rows: list[tuple] = []
            for k, ids in enumerate(coder(pc.fill_null(one(batch.column(1)), ""))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                rows += [(k, i // capacity, i, len(x := ids[i : i + capacity]), zlib.crc32(x.tobytes())) for i in range(0, len(ids), capacity)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([one(batch.column(0)).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=["id", "piece", "start", "length", "crc"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "crc"))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def bands(capacity: int) -> list[tuple[int, int]]:
    """(low, high] of lengths that one series of supersteps places: a twelfth narrower each down to an eighth of the capacity, then quarters.

    Within a band all pieces are placed at once, so a band is narrow where pieces are long: else those that would close a
    gap have their place before it is there.
    """
    out, high = [], capacity
    while high:
        low = min(high - 1, int(high * NARROW) if high > capacity // 8 else high // 4)
        out.append((low, high))
        high = low
    return out


def _slots(gaps: DataFrame, low: int, high: int) -> DataFrame:
    """(size, seq, gap, slot): a gap cut into slots of gap, gap - high, gap - 2 high and so on that hold a piece of over ``low``.

    As no piece of the band is longer than ``high``, any of the slots may be filled without harm to the others.
    """
    slot = F.explode(F.expr(f"sequence(0, least(cast((gap - {low + 1}) div {high} as int), {MOST_SLOTS - 1}))"))
    return gaps.where(F.col("gap") > low).select("seq", "gap", slot.alias("slot")).select((F.col("gap") - high * F.col("slot")).alias("size"), "seq", "gap", "slot")


def depths(opens: dict[int, int], closes: dict[int, int]) -> tuple[list[tuple[int, int, int]], int, int]:
    """Rows (size, kind, depth before it) of the line of sizes, and the number and volume of pieces that meet no gap.

    Gaps and pieces stand in one line by size, the largest first, gaps first among equals. A gap opens a level, a piece
    closes the one on top: so every piece gets the smallest gap that holds it and that no longer piece has taken.
    """
    rows, depth, n, volume = [], 0, 0, 0
    for size in sorted(opens.keys() | closes.keys(), reverse=True):
        rows.append((size, 0, depth))
        depth += opens.get(size, 0)
        rows.append((size, 1, depth))
        over = max(0, closes.get(size, 0) - depth)
        n, volume, depth = n + over, volume + over * size, max(0, depth - closes.get(size, 0))
    return rows, n, volume


def superstep(pieces: DataFrame, slots: DataFrame, starts: DataFrame, hot: int) -> DataFrame:
    """(pid, length, seq, gap, slot): every piece of a band, with the gap that it gets in this superstep, if any.

    Rows are ranked among those of their size and kind; a size that over ``ROWS_A_BIN`` rows share is ranked in hash bins
    on top of the counts of the bins before. The rank and what stands before its size in the line give the depth of a
    row, and the depth of a piece is that of its gap: at each depth gaps and pieces take turns, so a piece's gap is the
    row before it. A depth has two rows for each size at most. Pieces whose depth is below 1 meet no gap.
    """
    opens = slots.select("size", F.lit(0).alias("kind"), F.col("seq").alias("id"), "slot", "gap")
    closes = pieces.select(F.col("length").alias("size"), F.lit(1).alias("kind"), F.col("pid").alias("id"), F.lit(0).alias("slot"), F.lit(None).cast("long").alias("gap"))
    rows, key = opens.union(closes), ["size", "kind"]
    if hot > ROWS_A_BIN:
        rows, key = rows.withColumn("bin", F.pmod(F.xxhash64("id", "slot"), F.lit(-(-hot // ROWS_A_BIN)))), ["size", "kind", "bin"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("id", "slot"))
    ranked = rows.withColumn("rank", rank)
    if hot > ROWS_A_BIN:
        counts = rows.groupBy(*key).agg(F.count("*").alias("n"))
        before = counts.select(*key, (F.sum("n").over(Window.partitionBy("size", "kind").orderBy("bin")) - F.col("n")).alias("before"))
        ranked = ranked.join(before, key).withColumn("rank", F.col("before") + F.col("rank"))
    depth = F.when(F.col("kind") == 0, F.col("start") + F.col("rank")).otherwise(F.col("start") - F.col("rank") + 1)
    placed = ranked.join(F.broadcast(starts), ["size", "kind"]).withColumn("depth", depth)
    # pieces below depth 1 are no group: each stands alone
    level = F.when(F.col("depth") > 0, F.col("depth")).otherwise(-F.col("id") - 1)
    gap = F.lag(F.struct("id", "gap", "slot")).over(Window.partitionBy(F.col("depth") > 0, level).orderBy(F.desc("size"), "kind"))
    met = placed.withColumn("open", F.when(F.col("depth") > 0, gap)).where("kind = 1")
    return met.select(F.col("id").alias("pid"), F.col("size").alias("length"), F.col("open.id").alias("seq"), F.col("open.gap").alias("gap"), F.col("open.slot").alias("slot"))


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (id, piece, length, ...) plus sequence_id and offset; lengths from 1 to ``capacity``.

    Bulk-synchronous: bands of lengths, longest first. A superstep matches all pieces of a band that have no place yet
    with the gaps of all sequences, and is written as a part of one table; gaps are what the matches so far leave.
    The driver sees counts by size alone, ``capacity`` for each kind at most. From these it knows how many pieces a
    superstep will place: where that is under a tenth, or only the last hundredth of a band is left, as many sequences are
    opened first as the others fill at least. What gaps are left is written with each superstep.
    Pieces of equal length differ in no way that matters, so ties go by row number.
    """
    spark = pieces.sparkSession
    own = written(pieces.withColumn("pid", F.monotonically_increasing_id()), "numbered")
    lengths = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps, schema = new_path(spark, "supersteps"), "pid long, length long, seq long, gap long, slot int"
    opened, done, gaps = 0, 0, spark.createDataFrame([], "seq long, gap long")
    for low, high in bands(capacity):
        closes = {x: n for x, n in lengths.items() if low < x <= high}
        if not closes:
            continue
        left, all_closes, first = own.where((F.col("length") > low) & (F.col("length") <= high)).select("pid", "length"), sum(closes.values()), done
        while closes:
            opens = {r["size"]: r["n"] for r in _slots(gaps, low, high).groupBy("size").agg(F.count("*").alias("n")).collect()} if opened else {}
            starts, n, volume = depths(opens, closes)
            # under a tenth finds a gap, or a hundredth of the band is left and some of it doesn't
            if n > 0.9 * sum(closes.values()) or (n and done > first and sum(closes.values()) <= 0.01 * all_closes):
                more = max(-(-volume // capacity), -(-n // (capacity // (low + 1))))
                gaps = gaps.union(spark.range(opened, opened + more).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("gap")))
                opened += more
                for k in range(min(MOST_SLOTS, (capacity - low - 1) // high + 1)):
                    opens[capacity - k * high] = opens.get(capacity - k * high, 0) + more
                starts, n, volume = depths(opens, closes)
            hot = max(*opens.values(), *closes.values())
            superstep(left, _slots(gaps, low, high), spark.createDataFrame(starts, "size long, kind int, start long"), hot).write.parquet(f"{steps}/{done}")
            step = spark.read.schema(schema).parquet(f"{steps}/{done}")
            left, closes, done = step.where("seq is null").select("pid", "length"), _unmet(starts, closes), done + 1
            used = step.where("seq is not null").select("seq", (-F.col("length")).alias("gap"))
            gaps = written(gaps.union(used).groupBy("seq").agg(F.sum("gap").alias("gap")).where("gap > 0"), "gaps")
    read = lambda: spark.read.schema(schema).parquet(*(f"{steps}/{k}" for k in range(done)))
    kept = pieces.columns
    if not done:
        return own.select(*kept, F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    # a sequence's pieces in the order of supersteps, as each one's gap tells, and of slots within
    offset = F.sum("length").over(Window.partitionBy("seq").orderBy(F.desc("gap"), "slot")) - F.col("length")
    places = read().where("seq is not null").withColumn("offset", offset).select("pid", "seq", "offset")
    return own.join(places, "pid").select(*kept, F.col("seq").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def _unmet(starts: list[tuple[int, int, int]], closes: dict[int, int]) -> dict[int, int]:
    """Counts by length of the pieces that meet no gap."""
    left = {size: closes[size] - depth for size, kind, depth in starts if kind == 1 and size in closes}
    return {size: n for size, n in left.items() if n > 0}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END) -> DataFrame:
    """One row for each piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and ``end_id``; a null text is an empty one. Only documents of over ``capacity`` ids are
    cut; the longest text is tokenised whole, by one task. The pieces of a sequence are gapless from 0. Rows that repeat an id are packed one by one. An empty table gives
    no rows; other columns are ignored.
    """
    require(docs, id_col, text_col)
    packed = best_fit(written(token_pieces(docs, id_col, text_col, path, capacity, end_id), "pieces"), capacity)
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
