"""Batched logistic search (L2, L7): all (C, fold) pairs are fitted in the same passes over the table.

Every iteration is one Spark job.  A task reads its rows once and adds up loss, gradient and Hessian
of every pair; the sums of a pair meet in one task, and only the totals (a few thousand numbers a pair)
reach the driver, which takes a Newton step for each pair that is still open and halves a step that
raised the loss.  The objective is the weighted log-loss plus ``|beta|^2 / (2 C)``; the intercept is free.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9
MOST_PASSES = 60


@dataclass
class Fit:
    """One (C, fold) pair: ``beta`` ends with the intercept."""
    C: float
    fold: int
    weights: tuple[float, float]
    beta: np.ndarray
    passes: int = 0


def matrix(column: pa.Array) -> np.ndarray:
    """A list<double> column without nulls as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack((x, np.ones((len(x), 1))))


def _sums(open_fits: list[tuple[int, int, tuple[float, float], np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            y, fold = (batch[c].to_numpy(zero_copy_only=False) for c in ("y", "fold"))
            last = None
            for i, f, (w0, w1), beta in sorted(open_fits, key=lambda p: p[1]):   # a fold's rows are taken once
                if f != last:
                    last, use = f, fold != f
                    x, t = _with_one(matrix(batch[f"x{f}"]))[use], y[use]
                w = np.where(t == 1, w1, w0)
                z = x @ beta
                p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
                loss = float((w * (np.logaddexp(0.0, z) - t * z)).sum())
                half = x * np.sqrt(w * p * (1 - p))[:, None]
                h = half.T @ half           # one operand: the symmetric product, half the work
                part = np.concatenate(([loss], x.T @ (w * (p - t)), h.ravel()))
                total[i] = total.get(i, 0.0) + part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))],
                                             names=["pair", "sums"])
    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, part in zip(batch["pair"].to_pylist(), matrix(batch["sums"]) if len({len(x) for x in batch["sums"]}) == 1
                           else [np.array(x.as_py()) for x in batch["sums"]]):
            total[i] = total.get(i, 0.0) + part
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))],
                                     names=["pair", "sums"])


def fit_many(rows: DataFrame, pairs: list[tuple[float, int]], weights: dict[int, tuple[float, float]]) -> list[Fit]:
    """Fits for ``pairs`` of (C, fold).  ``rows`` holds ``y`` (0/1), ``fold`` and, for every fold ``f``,
    the encoded row ``x{f}`` (array<double>); a pair learns from the rows outside its fold, with the class
    weights ``weights[fold]``.  The table is read once an iteration."""
    first = rows.first()
    fits = [Fit(c, f, weights[f], np.zeros(len(first[f"x{f}"]) + 1)) for c, f in pairs]
    step: dict[int, np.ndarray] = {}
    loss: dict[int, float] = {}
    live = set(range(len(fits)))
    names = ["y", "fold", *sorted({f"x{f}" for _, f in pairs})]
    for _ in range(MOST_PASSES):
        if not live:
            break
        asked = [(i, fits[i].fold, fits[i].weights, fits[i].beta) for i in sorted(live)]
        got = (rows.select(*names).mapInArrow(_sums(asked), "pair int, sums array<double>")
               .repartition(len(asked), "pair").mapInArrow(_total, "pair int, sums array<double>").collect())
        for r in got:
            i, sums = r["pair"], np.array(r["sums"])
            fit = fits[i]
            fit.passes += 1
            d = len(fit.beta)
            ridge = np.append(np.full(d - 1, 1.0 / fit.C), 0.0)
            now = sums[0] + 0.5 * float(ridge @ fit.beta ** 2)
            if i in loss and now > loss[i] + 1e-12 * abs(loss[i]):   # went too far: half way back
                step[i] = step[i] / 2
                fit.beta = fit.beta - step[i]
                if np.abs(step[i]).max() <= TOLERANCE:
                    live.discard(i)
                continue
            loss[i] = now
            gradient = sums[1:d + 1] + ridge * fit.beta
            hessian = sums[d + 1:].reshape(d, d) + np.diag(ridge)
            step[i] = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            if np.abs(step[i]).max() <= TOLERANCE * max(1.0, np.abs(fit.beta).max()):
                live.discard(i)
            fit.beta = fit.beta + step[i]
    return fits


def _held(fits: list[tuple[str, int, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, fold = (batch[c].to_numpy(zero_copy_only=False) for c in ("y", "fold"))
            for f in sorted({f for _, f, _ in fits}):
                use = fold == f
                if not use.any():
                    continue
                x = _with_one(matrix(batch[f"x{f}"]))[use]
                for name, _, beta in (c for c in fits if c[1] == f):
                    p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -700, 700)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(p)), pa.array(np.full(len(p), f, np.int32)), pa.array(y[use].astype(np.int32)), pa.array(p)],
                        names=["model", "fold", "y", "p"])
    return run


def held_out_scores(rows: DataFrame, fits: list[Fit]) -> DataFrame:
    """``model`` (the C), ``fold, y, p``: every row scored by the fits that held it out."""
    names = ["y", "fold", *sorted({f"x{f.fold}" for f in fits})]
    return rows.select(*names).mapInArrow(_held([(repr(f.C), f.fold, f.beta) for f in fits]),
                                          "model string, fold int, y int, p double")
