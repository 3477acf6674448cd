"""Cycles of a detrended log price: modes, how well they have forecast, and a damped projection.

A symbol's history is bounded by the calendar, so symbols are the unit of work: one group fits the modes, refits them on every
prefix for the check, and projects. A refit is one Fourier transform of a few thousand numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Horizons in months and in rows.
HORIZONS = {1: 21, 2: 42, 3: 63, 6: 126, 12: 252, 18: 378}
#: Width of a peak, rows and share of the recent slope, share of the dominant period that is projected, confidence beyond it.
PEAK, RECENT, KEPT, PROJECTED, BEYOND = math.pi / 8, 504, 0.5, 0.25, 0.29


def position(phase: float) -> tuple[str, float]:
    """Where a mode A cos(phase) stands, and the share of its cycle that has passed."""
    phase %= 2 * math.pi
    share = phase / (2 * math.pi)
    if min(phase, 2 * math.pi - phase) <= PEAK:
        return "peak", share
    if abs(phase - math.pi) <= PEAK:
        return "trough", share
    return ("falling" if phase < math.pi else "rising"), share


def modes(rest: np.ndarray, top: int = 5, least: int = 5) -> pd.DataFrame:
    """The strongest Fourier modes with periods of ``least`` rows to half the series: k, period, amplitude, phase, share."""
    n = len(rest)
    if n < 2 * max(least, 2):
        return pd.DataFrame({c: np.zeros(0) for c in ("k", "period", "amplitude", "phase", "share")})
    f = np.fft.rfft(rest)
    power, k = np.abs(f) ** 2, np.arange(len(f))
    period = n / np.maximum(k, 1)
    own = k[(k > 0) & (period >= least) & (period <= n / 2)]
    own = own[np.argsort(-power[own], kind="stable")][:top]
    total = power[1:].sum()
    return pd.DataFrame({"k": own, "period": n / own, "amplitude": 2 * np.abs(f[own]) / n, "phase": np.angle(f[own]), "share": power[own] / total if total > 0 else 0.0 * own})


def rebuilt(found: pd.DataFrame, n: int, at: np.ndarray) -> np.ndarray:
    """The sum of the modes of a series of ``n`` rows at some places, which may lie beyond it."""
    turn = 2 * math.pi * np.outer(at, found["k"]) / n + found["phase"].to_numpy()
    return (np.cos(turn) * found["amplitude"].to_numpy()).sum(axis=1)


def consistency(rest: np.ndarray, top: int = 5, least: int = 5, held: int = 60) -> dict:
    """How the newest forecast of ``held`` rows compares with those made from every earlier prefix, each refitted and carried on.

    error, usual, spread, z and blocks; label is consistent (z of 1 at most), drifting (2.5) or broken, unknown where there is no z.
    """
    out = {"error": None, "usual": None, "spread": None, "z": None, "blocks": 0, "label": "unknown"}
    n = len(rest)
    if n < 4 * held:
        return out

    def miss(end: int) -> float | None:
        found = modes(rest[:end], top, least)
        if not len(found):
            return None
        return float(np.sqrt(np.mean((rest[end : end + held] - rebuilt(found, end, np.arange(end, end + held))) ** 2)))

    out["error"] = miss(n - held)
    earlier = [x for x in map(miss, range(4 * held, n - held + 1, max(held // 2, 1))) if x is not None] if out["error"] is not None else []
    if len(earlier) < 4:
        return out
    usual, spread = float(np.mean(earlier)), float(np.std(earlier, ddof=1))
    z = (out["error"] - usual) / spread if spread > 0 else 0.0
    return out | {"usual": usual, "spread": spread, "z": z, "blocks": len(earlier), "label": "consistent" if z <= 1 else "drifting" if z <= 2.5 else "broken"}


def _section(close: np.ndarray, top: int, least: int, held: int, horizons: dict[int, int]) -> dict | None:
    """All cycle figures of one series of positive closes; none if it is too short for any mode."""
    n = len(close)
    if n < 3:
        return None
    log, t = np.log(close), np.arange(n)
    line = np.polynomial.polynomial.polyfit(t, log, 1)
    rest = log - np.polynomial.polynomial.polyval(t, line)
    found = modes(rest, top, least)
    if not len(found):
        return None
    fitted = rebuilt(found, n, t)
    whole = ((rest - rest.mean()) ** 2).sum()
    r2 = float(1 - ((rest - fitted) ** 2).sum() / whole) if whole > 0 else 0.0
    check = consistency(rest, top, least, held)
    trust = 1.0 if check["z"] is None else min(max(1 - abs(check["z"]) / 4, 0.1), 1.0)
    slope = float(np.median(np.diff(log)[-RECENT:])) * KEPT
    damping, dominant = min(max(r2, 0.0), 1.0), float(found["period"].iloc[0])
    limit = max(dominant * PROJECTED, 1.0)
    ahead = []
    for months, days in horizons.items():
        reach = min(float(days), limit)
        swing = damping * float(rebuilt(found, n, np.array([n - 1 + reach]))[0] - fitted[-1])
        sure = damping / (1 + days / max(dominant, 1.0)) * trust
        if days > limit:
            sure = min(sure, BEYOND) * limit / days
        ahead.append({"h": months, "days": days, "expected": math.expm1(slope * days + swing), "trend": math.expm1(slope * days), "cycle": math.expm1(swing), "reach": reach, "truncated": days > limit, "confidence": sure})
    now = [position(2 * math.pi * k * (n - 1) / n + p) for k, p in zip(found["k"], found["phase"])]
    listed = [x | {"rank": i + 1, "position": now[i][0], "passed": now[i][1]} for i, x in enumerate(found.astype({"k": int}).to_dict("records"))]
    return {"n": n, "slope": float(line[1]), "recent_slope": slope, "r2": r2, "dominant": dominant, "limit": limit, "modes": listed, "check": check, "ahead": ahead}


SCHEMA = (
    "symbol string, n int, slope double, recent_slope double, r2 double, dominant double, `limit` double, "
    "modes array<struct<rank: int, k: int, period: double, amplitude: double, phase: double, share: double, position: string, passed: double>>, "
    "check struct<error: double, usual: double, spread: double, z: double, blocks: int, label: string>, "
    "ahead array<struct<h: int, days: int, expected: double, trend: double, cycle: double, reach: double, truncated: boolean, confidence: double>>"
)


def sections(bars: DataFrame, top: int = 5, least: int = 5, held: int = 60, horizons: dict[int, int] | None = None) -> DataFrame:
    """A row a symbol: trend, modes, consistency (check) and projection by horizon (ahead).

    The projection adds to half the median recent slope the modes' change, damped by the share of variance they rebuild and held
    beyond a quarter of the dominant period. Closes that are null or not positive are left out; a symbol too short for a mode has no row.
    """
    chosen = horizons or HORIZONS

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = _section(rows.sort_values("date")["close"].to_numpy(), top, least, held, chosen)
        names = ["symbol", "n", "slope", "recent_slope", "r2", "dominant", "limit", "modes", "check", "ahead"]
        return pd.DataFrame([] if out is None else [{"symbol": rows["symbol"].iloc[0], **out}], columns=names)

    return bars.select("symbol", "date", "close").where("close > 0").groupBy("symbol").applyInPandas(run, SCHEMA)


def cycle_modes(bars: DataFrame, **how) -> DataFrame:
    return sections(bars, **how).select("symbol", F.inline("modes"))


def cycle_consistency(bars: DataFrame, **how) -> DataFrame:
    return sections(bars, **how).select("symbol", "n", "r2", "dominant", "check.*")


def cycle_projection(bars: DataFrame, **how) -> DataFrame:
    return sections(bars, **how).select("symbol", F.inline("ahead"))
