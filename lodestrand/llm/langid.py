"""Language identification of code-switched text with a linear-chain conditional random field over words."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, one, require, sample_below, slices, tidy, unit_hash, without

#: The sample that the field is fitted on: documents of each language, characters of each, and documents in all.
PER_LANGUAGE, EXCERPT, MOST = 600, 400, 12_000
WIDTH, LONGEST = 1 << 18, 5
BLOCK, KEPT_WORDS = 64, 200_000
#: Words whose features are held at once as the field is fitted.
AT_ONCE = 4096
_WORD = regex.compile(r"\p{L}+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return _WORD.findall(text.lower()) if text else []


def features(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, one word after another: (feature of each, word of each).

    A word stands between two marks; its features are all runs of 2 to 5 characters, those at a mark being its affixes,
    and the whole word, its entry in the lexicon.
    """
    marked = ["^" + w + "$" for w in vocabulary]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))
    rolled, place = (code + np.uint64(1)) * _M1, np.repeat(size, size) - left
    index, of = [], []
    one_char = rolled.copy()
    for n in range(2, LONGEST + 1):
        rolled = rolled[:-1] * _M2 + (one_char[n - 1 :] ^ (one_char[n - 1 :] >> np.uint64(29)))
        fits = left[: len(rolled)] >= n
        index.append(rolled[fits] ^ np.uint64(n))
        of.append(owner[: len(rolled)][fits])
    if len(marked):
        index.append(np.add.reduceat((one_char ^ (one_char >> np.uint64(31))) * (place.astype(np.uint64) * _M2 + _M1), np.cumsum(size) - size))
        of.append(np.arange(len(marked)))
    index, of = np.concatenate(index), np.concatenate(of)
    index = (index ^ (index >> np.uint64(32))) * _M1
    order = np.argsort(of, kind="stable")
    return ((index >> np.uint64(20)) % np.uint64(WIDTH)).astype(np.int64)[order], of[order]


def _features_in_parts(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``features``, made for ``AT_ONCE`` words at a time."""
    found = [tuple(x.astype(np.int32) for x in features(vocabulary[i : i + AT_ONCE])) for i in range(0, len(vocabulary), AT_ONCE)]
    return np.concatenate([index for index, _ in found]), np.concatenate([of + i * AT_ONCE for i, (_, of) in enumerate(found)], dtype=np.int32)


@dataclass
class Field:
    """labels, weights[feature, label] and transitions[from, to], all in logarithms."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, vocabulary: list[str]) -> np.ndarray:
        if not vocabulary:
            return np.zeros((0, len(self.labels)), np.float32)
        index, of = features(vocabulary)
        return np.add.reduceat(self.weights[index], np.flatnonzero(np.diff(of, prepend=-1)), axis=0).astype(np.float32)


def _positive(e: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(e - e.max(axis=1, keepdims=True), -60)).astype(np.float64)


def marginals(e: np.ndarray, offsets: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Posterior label probabilities of every word by forward-backward over each whole sequence.

    e: log emissions of all words; sequence s has words offsets[s] to offsets[s + 1]. Sequences are cut into blocks that
    advance together: the product of each block's matrices carries the messages from block to block, exactly.
    """
    labels, b, a = e.shape[1], _positive(e), np.exp(moves - moves.max())
    size = np.diff(offsets)
    n_blocks = -(-size // BLOCK)
    owner = np.repeat(np.arange(len(size)), n_blocks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    start = offsets[:-1][owner] + number * BLOCK
    length = np.minimum(BLOCK, offsets[1:][owner] - start)
    order = np.argsort(-length, kind="stable")
    start, length, back = start[order], length[order], np.argsort(order)
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(BLOCK)]  # blocks longer than t
    m = np.repeat(np.eye(labels)[None], len(start), axis=0)
    for t, k in enumerate(active):
        if not k:
            break
        step = (m[:k].reshape(-1, labels) @ a).reshape(k, labels, labels) * b[start[:k] + t][:, None, :]
        m[:k] = step / step.max(axis=(1, 2), keepdims=True)
    m = m[back]  # blocks in their order
    first = np.cumsum(n_blocks) - n_blocks
    into, out = np.full((len(owner), labels), 1 / labels), np.ones((len(owner), labels))
    by_count = np.argsort(-n_blocks, kind="stable")
    for k in range(1, int(n_blocks.max(initial=0))):
        has = by_count[: int(np.searchsorted(-n_blocks[by_count], -k, side="left"))]
        v = np.einsum("ij,ijk->ik", into[first[has] + k - 1], m[first[has] + k - 1])
        into[first[has] + k] = v / v.sum(axis=1, keepdims=True)
        last = first[has] + n_blocks[has] - k
        v = np.einsum("ijk,ik->ij", m[last], out[last])
        out[last - 1] = v / v.max(axis=1, keepdims=True)
    alpha, forward, backward = np.zeros_like(b), into[order], out[order]
    for t, k in enumerate(active):
        if not k:
            break
        v = (forward[:k] @ a) * b[start[:k] + t]
        forward[:k] = v / v.sum(axis=1, keepdims=True)
        alpha[start[:k] + t] = forward[:k]
    for t in range(BLOCK - 1, -1, -1):
        if k := active[t]:
            at = start[:k] + t
            alpha[at] *= backward[:k]
            v = (b[at] * backward[:k]) @ a.T
            backward[:k] = v / v.max(axis=1, keepdims=True)
    return alpha / alpha.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = 0, rounds: int = 60, segment: int = 8, length: int = 48) -> Field:
    """Fits a field to (text, language) rows; training sequences switch language as they are spliced from many rows.

    Full-batch steps of Adam on the conditional likelihood; the gradient of the transitions comes from the same
    forward-backward messages as that of the words.
    """
    labels = sorted({lang for _, lang in rows})
    code = {lang: k for k, lang in enumerate(labels)}
    random = np.random.default_rng(seed)
    parts = []
    for text, lang in rows:
        w = words(text)[:-1] or words(text)
        i = 0
        while i < len(w):
            n = int(random.integers(1, 2 * segment)) * (1 if random.random() < 0.7 else 3)
            parts.append((code[lang], w[i : i + n]))
            i += n
    random.shuffle(parts)
    vocabulary: dict[str, int] = {}
    word = np.array([vocabulary.setdefault(x, len(vocabulary)) for _, w in parts for x in w], np.int64)
    truth = np.repeat([k for k, _ in parts], [len(w) for _, w in parts])
    n_labels = len(labels)
    if n_labels < 2 or len(word) < 2:
        return Field(labels or ["und"], np.zeros((WIDTH, max(1, n_labels)), np.float32), np.zeros((max(1, n_labels),) * 2))
    used = len(word) // length * length or len(word)
    word, truth = word[:used], truth[:used]
    steps = min(length, used)
    grid, gold = word.reshape(-1, steps), truth.reshape(-1, steps)
    n_words, index, of = len(vocabulary), *_features_in_parts(list(vocabulary))
    del parts, vocabulary
    begin = np.flatnonzero(np.diff(of, prepend=-1)).astype(np.int32)
    edges = [*begin[::AT_ONCE].tolist(), len(index)]
    there = np.zeros(WIDTH, bool)
    there[index] = True
    met, index = np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[index]  # weights of no word stay 0
    weights, moves = np.zeros((len(met), n_labels)), np.zeros((n_labels, n_labels))
    seen = np.zeros((n_labels, n_labels))
    np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    e, grad = np.empty((n_words, n_labels)), np.empty_like(weights)
    for r in range(1, rounds + 1):
        for k, (i, j) in enumerate(pairwise(edges)):
            own = slice(k * AT_ONCE, (k + 1) * AT_ONCE)
            e[own] = np.add.reduceat(weights[index[i:j]], begin[own] - i, axis=0)
        b, a = _positive(e)[grid], np.exp(moves)
        alpha, beta = np.zeros_like(b), np.ones_like(b)
        alpha[:, 0] = b[:, 0] / b[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, steps):
            v = (alpha[:, t - 1] @ a) * b[:, t]
            alpha[:, t] = v / v.sum(axis=1, keepdims=True)
        for t in range(steps - 2, -1, -1):
            v = (b[:, t + 1] * beta[:, t + 1]) @ a.T
            beta[:, t] = v / v.sum(axis=1, keepdims=True)
        expected = np.zeros_like(moves)
        for t in range(1, steps):
            x = alpha[:, t - 1, :, None] * a[None] * (b[:, t] * beta[:, t])[:, None, :]
            expected += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        delta = np.multiply(alpha, beta, out=alpha)
        delta /= delta.sum(axis=2, keepdims=True)
        np.put_along_axis(delta, gold[..., None], np.take_along_axis(delta, gold[..., None], 2) - 1, 2)
        for k in range(n_labels):
            per_word, total = np.bincount(grid.ravel(), delta[..., k].ravel(), n_words), np.zeros(len(met))
            for i, j in pairwise(edges):
                np.add.at(total, index[i:j], per_word[of[i:j]])
            grad[:, k] = total / len(word) + 1e-6 * weights[:, k]
        grad_moves = (expected - seen) / len(word) + 1e-4 * moves
        for x, g, m, s, rate in ((weights, grad, state[0], state[1], 0.05), (moves, grad_moves, state[2], state[3], 0.1)):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            x -= rate * (m / (1 - 0.9**r)) / (np.sqrt(s / (1 - 0.99**r)) + 1e-8)
    every = np.zeros((WIDTH, n_labels), np.float32)
    every[met] = weights
    return Field(labels, every, moves)


def fit_on(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: str = "doc_id", per_language: int = PER_LANGUAGE, excerpt: int = EXCERPT, most: int = MOST, seed: int = 0) -> Field:
    """Fits on an excerpt of ``excerpt`` characters, from a hashed place, of ``per_language`` hashed rows of each language.

    That is the documented sample; ``most`` rows in all, shared evenly if there are many languages, reach the driver. Rows
    are chosen by comparing their hash with a bound that follows from the number of rows of their language, so no task
    gathers a language; rows that repeat an id count once.
    """
    h = F.xxhash64(F.lit(seed), F.col(order), F.col(lang_col))
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).cast("string").alias("lang"), h.alias("h"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return fit([], seed)
    size = max(1, min(per_language, most // len(counts)))
    bounds = docs.sparkSession.createDataFrame([(lang, sample_below(n, size)) for lang, n in counts.items()], "lang string, below double")
    place = (F.pmod("h", F.greatest(F.length("text") - excerpt, F.lit(1))) + 1).cast("int")
    chosen = known.join(F.broadcast(bounds), "lang").where(unit_hash("h") < F.col("below")).select("lang", "h", F.substring("text", place, F.lit(excerpt)).alias("text"))
    rows = chosen.groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    taken: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["h"], r["lang"], r["text"])):
        taken.setdefault(r["lang"], []).append(r["text"])
    try:
        return fit([(text, lang) for lang in sorted(taken) for text in taken[lang][:size]], seed)
    finally:
        give_back()  # the driver lives on


def label_documents(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus lang_pred string, score double, shares map of language to share (in place of such columns).

    A share is the mean posterior of a language over the words of the whole text; lang_pred has the largest (ties: the
    first in alphabetical order) and score is its share. A null text or one without a letter is ``und`` with score 0 and
    no shares. Rows that repeat each give a row; texts of any length are read whole, a very long one by one task. An empty
    table gives no rows.
    """
    docs = without(docs, "lang_pred", "score", "shares")
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(field)  # fixed size: WIDTH weights for each language
    shape = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("shares", T.MapType(T.StringType(), T.DoubleType()))])
    at = docs.columns.index(text_col)

    @tidy
    def run(batches):
        model: Field = sent.value
        kept: dict[str, int] = {}
        store = np.zeros((0, len(model.labels)), np.float32)
        for batch in (part for b in batches for part in slices(b, at)):
            texts = one(batch.column(at)).to_pylist()
            total, size = np.zeros((len(texts), len(model.labels))), np.zeros(len(texts), np.int64)
            part: list[tuple[int, list[str]]] = []
            n = 0
            for k, text in enumerate([*texts, None]):
                if w := words(text):
                    part.append((k, w))
                    n += len(w)
                if part and (n > 300_000 or k == len(texts)):
                    fresh: dict[str, int] = {}
                    base = len(kept)
                    codes = np.array([c if (c := kept.get(x)) is not None else base + fresh.setdefault(x, len(fresh)) for _, w in part for x in w], np.int64)
                    e = np.concatenate([store, model.emissions(list(fresh))])
                    edge = np.cumsum([0, *(len(w) for _, w in part)])
                    g = marginals(e[codes], edge, model.moves)
                    rows = [r for r, _ in part]
                    total[rows], size[rows] = np.add.reduceat(g, edge[:-1], axis=0), np.diff(edge)
                    if base + len(fresh) <= KEPT_WORDS:
                        kept.update((x, base + c) for x, c in fresh.items())
                        store = e
                    part, n = [], 0
            share = total / np.maximum(size, 1)[:, None]
            best = share.argmax(axis=1)
            pred = [model.labels[b] if s else "und" for b, s in zip(best.tolist(), size.tolist(), strict=True)]
            score = np.where(size > 0, np.clip(share.max(axis=1), 0, 1), 0.0)
            shares = [list(zip(model.labels, row, strict=True)) if s else [] for row, s in zip(share.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(shares, pa.map_(pa.string(), pa.float64()))], names=[f.name for f in shape.fields])

    return docs.mapInArrow(run, shape)
