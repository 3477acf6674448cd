"""Monthly exposures to a basket of legs: ridge betas with recent months weighing more, their errors by bootstrap and their path.

All fits of a symbol (penalties by left-out years, bootstrap draws, month-ends of the path) are solved from weighted moments of
(1, legs, return): a draw is a row of weights, so one matrix product gives the moments of all draws. A symbol's months are
bounded by the calendar; symbols are the unit of work.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import bars as B


@dataclass(frozen=True)
class ExposureConfig:
    """Half life, least and window of months; penalties; draws and seed of the bootstrap; points of the path; the fewest legs kept."""

    half_life: float = 24.0
    least: int = 36
    wanted: int = 60
    penalties: tuple[float, ...] = tuple(float(x) for x in np.logspace(-4.0, 2.0, 13))
    draws: int = 400
    seed: int = 20260905
    points: int = 24
    window: int = 60
    legs: int = 2


def solve(m: np.ndarray, lam: float) -> np.ndarray:
    """Constant and slopes of ridges on weighted standardised columns, from moments (weights of one in sum) of (1, legs, y); a stack of any shape."""
    mean, k = m[..., 0, 1:], m.shape[-1] - 2
    cov = m[..., 1:, 1:] - mean[..., :, None] * mean[..., None, :]
    sd = np.sqrt(np.maximum(np.diagonal(cov, axis1=-2, axis2=-1)[..., :k], 0))
    sd = np.where(sd > 1e-12, sd, 1.0)
    gram = cov[..., :k, :k] / (sd[..., :, None] * sd[..., None, :]) + lam * np.eye(k)
    b = np.linalg.solve(gram, (cov[..., :k, k] / sd)[..., None])[..., 0] / sd
    return np.concatenate([(mean[..., k] - (mean[..., :k] * b).sum(axis=-1))[..., None], b], axis=-1)


def recent(n: int, half_life: float) -> np.ndarray:
    w = 0.5 ** (np.arange(n - 1, -1, -1) / half_life)
    return w / w.sum()


def penalty(z: np.ndarray, years: np.ndarray, grid: tuple[float, ...]) -> float:
    """The penalty of the least squared error when each year is left out in turn; the middle one if none can be."""
    each = np.unique(years)
    sums = np.array([z[years == y].T @ z[years == y] for y in each])
    total = sums.sum(axis=0)
    k = z.shape[1] - 2
    held = [s for s in sums if total[0, 0] - s[0, 0] >= max(k + 2, 12)] if len(each) > 1 else []
    if not held:
        return grid[len(grid) // 2]
    train = np.array([(total - s) / (total - s)[0, 0] for s in held])

    def error(lam: float) -> float:
        b = np.concatenate([solve(train, lam), np.full((len(held), 1), -1.0)], axis=1)  # the squared error is a form in (b, -1)
        return float(np.einsum("si,sij,sj->", b, np.array(held), b))

    return min(grid, key=error)


def prune(known: np.ndarray, wanted: int, least: int) -> list[int]:
    """Legs to keep: while fewer than ``wanted`` rows have them all, the one goes whose going gains most, down to ``least`` legs."""
    legs = list(range(known.shape[1]))
    while (now := int(known[:, legs].all(axis=1).sum())) < wanted and len(legs) > least:
        gains = [int(known[:, [x for x in legs if x != c]].all(axis=1).sum()) for c in legs]
        if max(gains) <= now:
            break
        legs.pop(gains.index(max(gains)))
    return legs


def log_returns(bars: DataFrame) -> DataFrame:
    """symbol, month and y: log return of each completed month."""
    return B.month_ends(bars).where("ret > -1").select("symbol", "month", F.log1p("ret").alias("y"))


def differences(bars: DataFrame) -> DataFrame:
    """symbol, month and y: change of the level of each completed month, for series that are rates."""
    return B.month_ends(bars).where("ret is not null").select("symbol", "month", (F.col("close") * F.col("ret") / (1 + F.col("ret"))).alias("y"))


SCHEMA = (
    "symbol string, alpha double, r2 double, share double, residual double, penalty double, months int, start date, finish date, pruned array<string>, "
    "betas array<struct<leg: string, beta: double, se: double, change_6: double, change_12: double>>, path array<struct<leg: string, month: date, beta: double>>"
)


def exposures(months: DataFrame, basket: DataFrame, legs: list[str], config: ExposureConfig = ExposureConfig()) -> DataFrame:
    """A row a symbol: alpha (monthly), r2, share (not explained), residual (yearly deviation), penalty, and its betas with errors, changes and path.

    ``months``: symbol, month, y. ``basket``: month, leg, x, of which ``legs`` are used; a leg that shortens the joint months too much is
    pruned. A symbol of fewer than ``least`` joint months has no row. Nulls and NaN are missing months.
    """
    wide = basket.where(F.col("leg").isin(legs)).groupBy("month").pivot("leg", legs).agg(F.first("x")).toDF("month", *(f"x{i}" for i in range(len(legs))))
    x = months.join(F.broadcast(wide), "month", "left")  # a row a month

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["y"]).sort_values("month")
        raw = rows[[f"x{i}" for i in range(len(legs))]].to_numpy(float)
        keep = prune(np.isfinite(raw), max(config.least, config.wanted), config.legs)
        own = np.isfinite(raw[:, keep]).all(axis=1)
        n, k = int(own.sum()), len(keep)
        if n < config.least:
            return pd.DataFrame(columns=[c.split()[0] for c in ("symbol", "alpha", "r2", "share", "residual", "penalty", "months", "start", "finish", "pruned", "betas", "path")])
        month, z = rows["month"].to_numpy()[own], np.c_[np.ones(n), raw[own][:, keep], rows["y"].to_numpy(float)[own]]
        lam = penalty(z, np.array([m.year for m in month]), config.penalties)
        products = (z[:, :, None] * z[:, None, :]).reshape(n, -1)
        fit = lambda w: solve((w @ products / w.sum(axis=-1, keepdims=True)).reshape(*w.shape[:-1], k + 2, k + 2), lam)
        weights = recent(n, config.half_life)
        b = fit(weights)
        rest = z[:, -1] - z[:, :-1] @ b
        spread = float(((z[:, -1] - z[:, -1].mean()) ** 2).sum())
        r2 = 1 - float(rest @ rest) / spread if spread > 0 else math.nan
        se = np.full(k, math.nan)
        if n >= 8 and config.draws > 1:
            drawn = np.random.default_rng(config.seed).integers(0, n, (config.draws, n))
            times = np.zeros((config.draws, n))
            np.add.at(times, (np.arange(config.draws)[:, None], drawn), 1.0)
            se = fit(times * weights)[:, 1:].std(axis=0, ddof=1)
        ends = range(max(config.least, n - config.points), n + 1)
        rolled = np.zeros((len(ends), n))
        for i, end in enumerate(ends):
            first = max(0, end - config.window)
            rolled[i, first:end] = recent(end - first, config.half_life)
        path = fit(rolled)[:, 1:]
        since = lambda j, steps: float(path[-1, j] - path[-1 - steps, j]) if len(path) > steps else None
        names = [legs[j] for j in keep]
        out = {
            "symbol": rows["symbol"].iloc[0], "alpha": float(b[0]), "r2": r2, "share": 1 - r2, "residual": float(rest.std(ddof=1) * math.sqrt(12)), "penalty": lam, "months": n, "start": month[0], "finish": month[-1],
            "pruned": [name for j, name in enumerate(legs) if j not in keep],
            "betas": [{"leg": name, "beta": float(b[j + 1]), "se": float(se[j]), "change_6": since(j, 6), "change_12": since(j, 12)} for j, name in enumerate(names)],
            "path": [{"leg": name, "month": month[end - 1], "beta": float(path[i, j])} for i, end in enumerate(ends) for j, name in enumerate(names)],
        }
        return pd.DataFrame([out])

    return x.groupBy("symbol").applyInPandas(run, SCHEMA)
