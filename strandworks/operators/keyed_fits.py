"""Many linear classifiers in one job: folds, costs and feature sets are keys of one sum of moments.

Rows stay where they are; in one pass each task adds up, for every fit that is still open, the loss, its gradient and its
second derivatives at that fit's coefficients, and only these sums, p x p numbers a fit, reach the driver. There the
quadratic model is solved; a step that does not lower a fit's objective is halved. So the number of jobs is that of
Newton steps, whatever the number of fits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.functions.storage import cut

#: Half the width of the round corner of the hinge.
CORNER = 0.5
#: Gradient (relative to the rows) at which a fit counts as solved, for absolute and squared penalties; the most steps.
SLACK, LOOSE, ROUNDS = 1e-6, 1e-4, 200
#: Numbers that a task holds at once.
NUMBERS = 4_000_000


def logistic(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of a margin, and its first and second derivatives."""
    p = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
    return np.logaddexp(0, -m), p - 1, p * (1 - p)


def hinge(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hinge with a round corner: linear below 1 - CORNER, none above 1 + CORNER."""
    near = np.abs(1 - m) <= CORNER
    short = 1 + CORNER - m
    loss = np.where(near, short**2 / (4 * CORNER), np.maximum(1 - m, 0))
    return loss, np.where(near, -short / (2 * CORNER), np.where(m < 1, -1.0, 0.0)), np.where(near, 1 / (2 * CORNER), 0.0)


@dataclass
class Fit:
    """One fit: rows of ``fold`` are left out and scored, ``active`` features may differ from zero."""

    fold: int
    cost: float
    active: np.ndarray
    beta: np.ndarray  # the last is the intercept
    now: dict = field(default_factory=dict)


def prepared(df: DataFrame, features: list[str], fold: str = "fold") -> DataFrame:
    """fold, s (-1 or 1) and x of every row, kept for the rounds to come."""
    return cut(df.select(F.col(fold).cast("int").alias("fold"), (2 * F.col("y") - 1).cast("double").alias("s"), F.array(*(F.col(c).cast("double") for c in features)).alias("x")))


def moments(rows: DataFrame, fits: list[Fit], betas: list[np.ndarray], loss: Callable) -> list[dict]:
    """Of each fit at its coefficients: n, value, gradient and information of its rows; loss and hits of those left out."""
    shared = rows.sparkSession.sparkContext.broadcast((np.array(betas), np.array([f.fold for f in fits])))
    p = len(betas[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b, folds = shared.value
        total = np.zeros((len(b), 5 + p + p * p))
        step = max(1, NUMBERS // max(1, len(b)))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                x = np.column_stack([np.stack(part["x"].to_numpy()), np.ones(len(part))])
                s = part["s"].to_numpy()[:, None]
                mine = part["fold"].to_numpy()[:, None] != folds[None, :]
                margin = s * (x @ b.T)
                value, first, second = loss(margin)
                total[:, 0] += mine.sum(axis=0)
                total[:, 1] += (value * mine).sum(axis=0)
                total[:, 2] += (value * ~mine).sum(axis=0)
                total[:, 3] += (~mine).sum(axis=0)
                total[:, 4] += ((margin > 0) & ~mine).sum(axis=0)
                total[:, 5 : 5 + p] += (first * s * mine).T @ x
                weight = second * mine
                for i in range(len(b)):
                    total[i, 5 + p :] += (x.T @ (x * weight[:, i, None])).ravel()
        yield pd.DataFrame({"fit": np.arange(len(b)), "m": list(total)})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fit": group["fit"].iloc[:1], "m": [np.sum(np.stack(group["m"].to_numpy()), axis=0)]})

    kind = "fit int, m array<double>"
    parts = rows.mapInPandas(run, kind)  # a row for each fit and task
    found = {r["fit"]: np.array(r["m"]) for r in parts.groupBy("fit").applyInPandas(add, kind).collect()}
    out = []
    for i in range(len(fits)):
        m = found.get(i, np.zeros(5 + p + p * p))
        out.append({"n": m[0], "value": m[1], "held_loss": m[2], "held_n": m[3], "held_hits": m[4], "gradient": m[5 : 5 + p], "information": m[5 + p :].reshape(p, p)})
    return out


def descend(start: np.ndarray, gradient: np.ndarray, information: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """The best coefficients of quadratic models, a row each, under an absolute penalty for every coefficient: one
    coordinate at a time, all models together."""
    new, size = start.copy(), np.diagonal(information, axis1=1, axis2=2)
    for _ in range(2000):
        before = new.copy()
        for j in range(new.shape[1]):
            h = np.maximum(size[:, j], 1e-300)
            pull = h * new[:, j] - gradient[:, j] - np.einsum("fi,fi->f", information[:, j], new - start)
            new[:, j] = np.where(size[:, j] > 1e-12, np.sign(pull) * np.maximum(np.abs(pull) - penalty[:, j], 0) / h, new[:, j])
        if np.abs(new - before).max(initial=0.0) < 1e-10:
            break
    return new


class Absolute:
    """Mean loss plus the absolute values of the coefficients, by 1 / (rows * cost); the intercept is free."""

    @staticmethod
    def penalty(f: Fit) -> np.ndarray:
        return np.r_[np.full(len(f.beta) - 1, 1 / (max(1.0, f.now["n"]) * f.cost)), 0.0]

    def value(self, f: Fit, beta: np.ndarray, m: dict) -> float:
        return m["value"] / max(1.0, m["n"]) + float(self.penalty(f) @ np.abs(beta))

    def gap(self, f: Fit) -> float:
        g, lam = f.now["gradient"] / max(1.0, f.now["n"]), self.penalty(f)
        return float(np.where(f.beta == 0, np.maximum(np.abs(g) - lam, 0), np.abs(g + lam * np.sign(f.beta))).max())

    def aims(self, fits: list[Fit]) -> list[np.ndarray]:
        if not fits:
            return []
        n = [max(1.0, f.now["n"]) for f in fits]
        slopes, bends = ([f.now[what] / k for f, k in zip(fits, n, strict=True)] for what in ("gradient", "information"))
        return list(descend(np.array([f.beta for f in fits]), np.array(slopes), np.array(bends) + 1e-9 * np.eye(len(fits[0].beta)), np.array([self.penalty(f) for f in fits])))


class Squares:
    """The cost times the loss, plus half the squares of the coefficients; the intercept is free."""

    @staticmethod
    def free(f: Fit) -> np.ndarray:
        return np.r_[f.active, True]

    def value(self, f: Fit, beta: np.ndarray, m: dict) -> float:
        return f.cost * m["value"] + 0.5 * float(beta[:-1] @ beta[:-1])

    def slope(self, f: Fit) -> np.ndarray:
        return (f.cost * f.now["gradient"] + np.r_[f.beta[:-1], 0.0]) * self.free(f)

    def gap(self, f: Fit) -> float:
        return float(np.abs(self.slope(f)).max()) / max(1.0, f.cost * f.now["n"])

    def aims(self, fits: list[Fit]) -> list[np.ndarray]:
        return [self.aim(f) for f in fits]

    def aim(self, f: Fit) -> np.ndarray:
        on = self.free(f)
        h = f.cost * f.now["information"] + np.diag(np.r_[np.ones(len(f.beta) - 1), 1e-6])
        out = f.beta.copy()
        out[on] -= np.linalg.solve(h[np.ix_(on, on)], self.slope(f)[on])
        return out


def solve(rows: DataFrame, fits: list[Fit], loss: Callable, goal: Absolute | Squares, slack: float = SLACK, rounds: int = ROUNDS) -> list[Fit]:
    """All fits at the best coefficients of their goal; raises if one does not meet its conditions in ``rounds`` steps."""
    for f, m in zip(fits, moments(rows, fits, [f.beta for f in fits], loss), strict=True):
        f.now = m
    todo = [i for i, f in enumerate(fits) if f.now["n"] and goal.gap(f) > slack]
    aims = dict(zip(todo, goal.aims([fits[i] for i in todo]), strict=True))
    for _ in range(rounds):
        if not aims:
            return fits
        at = list(aims)
        tried = moments(rows, [fits[i] for i in at], [aims[i] for i in at], loss)
        onward = []
        for i, m in zip(at, tried, strict=True):
            f, aim = fits[i], aims.pop(i)
            small = np.abs(aim - f.beta).max() < 1e-10
            if not small and goal.value(f, aim, m) > goal.value(f, f.beta, f.now) + 1e-13:
                aims[i] = (aim + f.beta) / 2
                continue
            f.beta, f.now = aim, m
            if not small and goal.gap(f) > slack:
                onward.append(i)
        aims.update(zip(onward, goal.aims([fits[i] for i in onward]), strict=True))
    if aims:
        raise RuntimeError(f"{len(aims)} of {len(fits)} fits are not solved")
    return fits
