"""Quality classifier from weak labels: heuristics vote, expectation-maximisation weighs them, a hashed linear scorer learns."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat_words, one, require, sample_below, slices, tidy, unit_hash, written

#: Rows that the scorer is fitted on, in the order of a hash; each reaches the driver as at most WIDTH feature counts.
SAMPLE, WIDTH = 4_000, 1 << 12
KEEP = 0.5
#: Common function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "the of and to in is that for it on with as was be by this are or from an le la les de des et un une est que pour dans avec sur pas "
    "der die das und ist ein eine von mit für den nicht sich auf el los las una con por del se su al es y".split()
)
_SYMBOLS = re.compile(r"[#$%&*|<>{}\[\]\\^~=+_@]")
_BARE = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_ENDS = re.compile(r"[.!?](?:\s|$)")
BAD, GOOD, NONE = 0, 1, 2


def _band(x: float, good: bool, bad: bool) -> int:
    return GOOD if good else BAD if bad else NONE


def _votes(text: str) -> list[int]:
    words = text.split()
    n = len(words)
    if not n:
        return [BAD] + [NONE] * 9
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = len(_SYMBOLS.findall(text)) / max(1, len(text))
    stops = sum(map(STOP_WORDS.__contains__, text.lower().split())) / n
    ends = len(_ENDS.findall(text)) / n
    again = 1 - len(set(lines)) / max(1, len(lines))
    bare = len(_BARE.findall(text)) / n
    size = sum(map(len, words)) / n
    kinds = len(set(words)) / n
    capitals = sum(map(len, _CAPITALS.findall(text))) / (size * n)
    twice = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    return [
        _band(n, n >= 20, n < 2),
        _band(symbols, symbols < 0.004, symbols > 0.02),
        NONE if n < 20 else _band(stops, stops >= 0.08, stops < 0.03),
        NONE if n < 10 else _band(ends, 1 / 80 <= ends <= 1 / 2.5, ends < 1 / 300),
        NONE if len(lines) < 3 else _band(again, again < 0.05, again > 0.3),
        _band(bare, bare < 0.01, bare > 0.1),
        _band(size, 2.5 <= size <= 9, size > 12 or size < 1.8),
        NONE if n < 50 else _band(kinds, kinds > 0.25, kinds < 0.1),
        NONE if n < 10 else _band(capitals, capitals < 0.2, capitals > 0.4),
        NONE if n < 10 else _band(twice, twice < 0.02, twice > 0.1),
    ]


LABELLERS = ("length", "symbols", "stop_words", "sentence_ends", "repeated_lines", "bare_marks", "word_size", "distinct_words", "capitals", "words_twice")


def labeller_votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, text, votes): votes has a character for each labeller, 0 bad, 1 good, 2 none; whole texts; a null text is an empty one.

    h is a hash of the id and the length, in whose order rows are sampled.
    """
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit("sample"), F.col(id_col), F.length(text_col)).alias("h"), F.col(text_col).cast("string").alias("text"))

    @tidy
    def run(batches):
        for batch in (part for b in batches for part in slices(b, 2)):
            votes = ["".join(map(str, _votes(t or ""))) for t in one(batch.column(2)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(votes, pa.string())], names=["id", "h", "text", "votes"])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("votes", T.StringType())]))


@dataclass
class LabelModel:
    """prior of good, and table[labeller, class, vote] for the votes bad and good."""

    prior: float
    table: np.ndarray

    def posterior(self, votes: list[str]) -> np.ndarray:
        """Probability of good for vote strings."""
        if not votes:
            return np.zeros(0)
        v = np.array([[int(c) for c in x] for x in votes])
        says = np.concatenate([np.log(self.table), np.zeros((*self.table.shape[:2], 1))], axis=2)  # no vote, no evidence
        logs = says[np.arange(v.shape[1])[None, :], :, v].sum(axis=1) + np.log([1 - self.prior, self.prior])
        odds = logs[:, 1] - logs[:, 0]
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit_label_model(counts: dict[str, int], rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over counts of vote patterns, from the majority vote on.

    Patterns number 3 to the power of the labellers at most, whatever the number of documents. In a class, a labeller
    that votes is right with a learnt accuracy; one that doesn't vote says nothing, and so does one worse than chance.
    """
    if not counts:
        return LabelModel(0.5, np.full((len(LABELLERS), 2, 2), 0.5))
    patterns, n = list(counts), np.array(list(counts.values()), float)
    v = np.array([[int(c) for c in x] for x in patterns])
    good, bad = (v == GOOD).sum(axis=1), (v == BAD).sum(axis=1)
    p = (good + 0.5) / (good + bad + 1)
    for _ in range(rounds):
        prior = float(np.clip((p @ n) / n.sum(), 0.02, 0.98))
        table = np.empty((v.shape[1], 2, 2))
        for vote in (BAD, GOOD):
            hit = (v == vote) * n[:, None]
            table[:, 1, vote], table[:, 0, vote] = (hit * p[:, None]).sum(axis=0) + 1, (hit * (1 - p)[:, None]).sum(axis=0) + 1
        table /= table.sum(axis=2, keepdims=True)
        turned = table[:, 1, GOOD] * table[:, 0, BAD] < table[:, 0, GOOD] * table[:, 1, BAD]
        table[turned] = table[turned].mean(axis=1, keepdims=True)  # worse than chance: says nothing
        model = LabelModel(prior, table)
        new = model.posterior(patterns)
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return model


def _shape(word: str) -> str:
    kinds = "".join(("A" if c.isupper() else "a") if c.isalpha() else "9" if c.isdigit() else c for c in word[:40])
    return re.sub(r"(.)\1+", r"\1", kinds)[:12]


def _slots(words: list[str]) -> np.ndarray:
    """Two hashed features of each word: itself, and the shape of its characters."""
    pick = xxhash.xxh3_64_intdigest
    return np.array([(pick(w.lower(), 1) % WIDTH, pick(_shape(w), 2) % WIDTH) for w in words], np.int64).reshape(-1, 2)


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, offsets = flat_words(pc.fill_null(texts, ""))
    coded = words.dictionary_encode()
    return _slots(coded.dictionary.to_pylist()), coded.indices.to_numpy(zero_copy_only=False), offsets


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """Score from 0 to 1: the logistic of the mean weight of all words; a text without words has 0."""
        slots, codes, offsets = _coded(texts)
        each = self.weights[slots].sum(axis=1)[codes] if len(codes) else np.zeros(0)
        sums = np.diff(np.concatenate([[0.0], np.cumsum(each)])[offsets])
        size = np.diff(offsets)
        return np.where(size > 0, 1 / (1 + np.exp(-np.clip(sums / np.maximum(size, 1) + self.bias, -50, 50))), 0.0)


def fit_scorer(rows: list[tuple[list[int], list[float], float]], rounds: int = 300) -> Scorer:
    """Logistic regression on (slots, shares of words, posterior) rows by full-batch Adam steps."""
    weights, bias = np.zeros(WIDTH), 0.0
    if not rows:
        return Scorer(weights, bias)
    size = np.array([len(r[0]) for r in rows])
    slot, share = np.concatenate([r[0] for r in rows]).astype(np.int64), np.concatenate([r[1] for r in rows])
    owner, target = np.repeat(np.arange(len(rows)), size), np.array([r[2] for r in rows])
    m, s, mb, sb = np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0
    for r in range(1, rounds + 1):
        z = np.bincount(owner, weights[slot] * share, len(rows)) + bias
        gap = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / len(rows)
        g, gb = np.bincount(slot, gap[owner] * share, WIDTH) + 1e-6 * weights, gap.sum()
        m, s, mb, sb = m + 0.1 * (g - m), s + 0.01 * (g * g - s), mb + 0.1 * (gb - mb), sb + 0.01 * (gb * gb - sb)
        a, b = 1 - 0.9**r, 1 - 0.99**r
        weights = weights - 0.1 * (m / a) / (np.sqrt(s / b) + 1e-8)
        bias -= 0.1 * (mb / a) / (np.sqrt(sb / b) + 1e-8)
    return Scorer(weights, float(bias))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """For every row: id_col, votes, weak_label double (posterior of the votes), score double, keep boolean (score >= ``keep``).

    Votes of all documents are kept in a written table, counted by pattern and weighed by expectation-maximisation; the
    posteriors of ``sample`` rows, first in a hash order, train the scorer, which then scores every whole text. Rows that
    repeat an id and a length count once in the sample, and each give a row. Null, empty and blank texts score 0 and are
    not kept. A very long text is read whole, by one task. An empty table gives no rows; other columns are ignored.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    voted = written(labeller_votes(docs, id_col, text_col), "votes")
    counts = {r["votes"]: r["count"] for r in voted.groupBy("votes").count().collect()}
    model, total = fit_label_model(counts), sum(counts.values())

    @tidy
    def gather(batches):
        for batch in (part for b in batches for part in slices(b, 1)):
            slots, codes, offsets = _coded(one(batch.column(1)))
            slot_rows, share_rows = [], []
            for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                found, n = np.unique(slots[codes[i:j]].ravel(), return_counts=True)
                slot_rows.append(found.tolist())
                share_rows.append((n / max(1, j - i)).tolist())
            target = model.posterior(one(batch.column(2)).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slot_rows, pa.list_(pa.int32())), pa.array(share_rows, pa.list_(pa.float64())), pa.array(target)], names=["h", "slots", "shares", "target"])

    chosen = voted.where((unit_hash("h") < sample_below(total, sample)) & (F.length("text") > 0))
    distinct = chosen.groupBy("h").agg(F.min(F.struct("text", "votes")).alias("row")).select("h", "row.text", "row.votes")
    rows = sorted(distinct.mapInArrow(gather, "h long, slots array<int>, shares array<double>, target double").collect(), key=lambda r: r["h"])
    scorer = fit_scorer([(r["slots"], r["shares"], r["target"]) for r in rows[:sample] if r["slots"]])
    sent = spark.sparkContext.broadcast((model, scorer))

    @tidy
    def score(batches):
        for batch in (part for b in batches for part in slices(b, 1)):
            labels, scorer = sent.value
            s = scorer(one(batch.column(1)))
            label = labels.posterior(one(batch.column(2)).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(label), pa.array(s), pa.array((s >= keep) & (s > 0))], names=[id_col, "votes", "weak_label", "score", "keep"])

    shape = T.StructType([docs.schema[id_col], T.StructField("votes", T.StringType()), T.StructField("weak_label", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    return voted.select("id", "text", "votes").mapInArrow(score, shape)
