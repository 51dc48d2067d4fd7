"""Coefficients of a linear re-ranking found by coordinate search: one job scores all values of a coordinate for all starts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import stored

IMPROVEMENT, DIGITS = 1e-12, 12


@dataclass(frozen=True)
class Found:
    """What a search has chosen, what it measures, and the evaluations it made."""

    values: dict[str, float]
    by_dataset: dict[str, float]
    start: str
    passes: int
    improved: bool
    evaluations: int

    @property
    def objective(self) -> float:
        return objective(self.by_dataset)


def objective(by_dataset: dict[str, float]) -> float:
    """The mean over datasets, each weighing the same."""
    return sum(by_dataset.values()) / len(by_dataset)


def grouped(rows: DataFrame, names: list[str]) -> DataFrame:
    """(dataset, example, own): the candidates of an example as one array of (base, f1, a value of each feature), by identity."""
    fields = ("base", "f1", *names)
    given = rows.select("dataset", "example", "identity", *(F.col(n).cast("double").alias(n) for n in fields)).where(" and ".join(f"`{n}` is not null" for n in ("base", *names)))
    own = F.array_sort(F.collect_list(F.struct("identity", *fields)))
    return given.groupBy("dataset", "example").agg(own.alias("own")).select("dataset", "example", F.transform("own", lambda c: F.struct(*(c[n].alias(n) for n in fields))).alias("own"))


def evaluate(groups: DataFrame, trials: list[dict[str, float]]) -> list[dict[str, float]]:
    """For each trial (coefficient by feature) the mean F1, by dataset, of the examples' best candidates.

    ``groups``: as ``grouped`` makes them, so that a trial shuffles no candidates: a task takes a batch of examples through
    all trials, the best candidate is the first of those that score highest. Only sums meet.
    """
    names = list(trials[0])

    def best(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            lists, datasets = batch.column("own"), batch.column("dataset").dictionary_encode()
            own, size = lists.flatten(), np.diff(lists.offsets.to_numpy())
            values = {n: own.field(n).to_numpy(zero_copy_only=False) for n in ("base", "f1", *names)}
            begins = np.concatenate(([0], np.cumsum(size)[:-1]))
            of, code = np.repeat(np.arange(len(size)), size), datasets.indices.to_numpy()
            out = []
            for k, t in enumerate(trials):
                score = values["base"] + sum((t[n] * values[n] for n in names), 0.0)
                top = np.flatnonzero(score == np.maximum.reduceat(score, begins)[of])
                first = top[np.concatenate(([True], of[top][1:] != of[top][:-1]))]
                f1 = values["f1"][first]
                known = ~np.isnan(f1)
                total, n = np.bincount(code[known], f1[known], len(datasets.dictionary)), np.bincount(code[known], minlength=len(datasets.dictionary))
                out += [(k, d, s, c) for d, s, c in zip(datasets.dictionary.to_pylist(), total.tolist(), n.tolist(), strict=True) if c]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), batch.schema.field("dataset").type, pa.float64(), pa.int64()), strict=True)] if out else [pa.array([], t) for t in (pa.int32(), batch.schema.field("dataset").type, pa.float64(), pa.int64())], ["trial", "dataset", "total", "n"])

    kind = groups.schema["dataset"].dataType.simpleString()
    sums = groups.select("dataset", "own").mapInArrow(best, f"trial int, dataset {kind}, total double, n long")
    found: list[dict[str, float]] = [{} for _ in trials]
    for r in sums.groupBy("trial", "dataset").agg((F.sum("total") / F.sum("n")).alias("f1")).collect():
        found[r["trial"]][r["dataset"]] = round(r["f1"], DIGITS)
    return found


def coordinate_search(rows: DataFrame, grids: dict[str, list[float]], originals: dict[str, float], most_passes: int = 10) -> Found:
    """The best coefficients that three starts lead to: the originals, zeros, and the doubled originals, clipped to the grids.

    A pass goes through the coefficients in order and gives each the grid value that is best while the others stay. Better
    is: a higher mean over datasets, fewer datasets below the originals, the least loss against them in any, nearer to the
    originals, smaller values in order. A start ends with a pass that changes nothing, or after ``most_passes``. If the best
    end isn't above the originals these stay. Rows are grouped and stored once; each step is one job for all starts that still run.
    """
    order = list(grids)
    rows = stored(grouped(rows, order))
    doubled = {n: min(grids[n], key=lambda v: (abs(v - 2 * originals[n]), v)) for n in order}
    at = {"original": dict(originals), "zero": dict.fromkeys(order, 0.0), "doubled": doubled}
    first = evaluate(rows, [originals, *at.values()])
    base, measured, evaluations = first[0], dict(zip(at, first[1:], strict=True)), len(first)
    if not base:
        raise ValueError("there is no row to search on")

    def key(values: dict[str, float], by: dict[str, float]) -> tuple:
        gains = [by[d] - base[d] for d in sorted(base)]
        return -objective(by), sum(g < -IMPROVEMENT for g in gains), -min(gains), sum(abs(values[n] - originals[n]) / originals[n] for n in order), tuple(values[n] for n in order)

    running, passes = list(at), dict.fromkeys(at, 0)
    while running:
        before = {s: dict(at[s]) for s in running}
        for n in order:
            trials = [(s, {**at[s], n: v}) for s in running for v in grids[n]]
            results = evaluate(rows, [t for _, t in trials])
            evaluations += len(trials)
            for s in running:
                at[s], measured[s] = min(((t, by) for (own, t), by in zip(trials, results, strict=True) if own == s), key=lambda x: key(*x))
        for s in running:
            passes[s] += 1
        running = [s for s in running if at[s] != before[s] and passes[s] < most_passes]
    best = min(at, key=lambda s: key(at[s], measured[s]))
    improved = objective(measured[best]) > objective(base) + IMPROVEMENT
    return Found(at[best] if improved else dict(originals), measured[best] if improved else base, best, passes[best], improved, evaluations)
