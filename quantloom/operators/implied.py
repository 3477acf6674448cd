"""What an option chain implies for each horizon: quantiles, tails, skew, and the shift to what base rates say.

A chain of one expiry is the unit of work. Its smile is a monotone cubic through volatilities inverted from the side that is out of the
money; the slope of the call curve gives the distribution, made monotone. All strikes are inverted together.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.scalars import normal_cdf, phi
from quantloom.operators import options as O

#: Horizons in months and their days to expiry.
DAYS = {1: 30, 2: 61, 3: 91, 6: 182, 12: 365, 18: 548}
#: Quantile levels, points of the grid and of the density handed out, bounds of a volatility, widest log moneyness, least mid.
LEVELS, GRID, SHOWN, VOL_LOW, VOL_HIGH, WIDEST, LEAST_MID = (0.05, 0.25, 0.50, 0.75, 0.95), 400, 61, 1e-4, 5.0, 1.2, 0.05


def value(spot, strike, t, r, sigma, call, q=0.0) -> np.ndarray:
    """Black-Scholes values of arrays; positive times, prices and volatilities."""
    spot, strike, sigma = (np.asarray(x, float) for x in (spot, strike, sigma))
    d = (np.log(spot / strike) + (r - q + sigma * sigma / 2) * t) / (sigma * math.sqrt(t))
    sign = np.where(call, 1.0, -1.0)
    return sign * (spot * math.exp(-q * t) * phi(sign * d) - strike * math.exp(-r * t) * phi(sign * (d - sigma * math.sqrt(t))))


def delta(spot, strike, t, r, sigma, call, q=0.0) -> np.ndarray:
    spot, strike, sigma = (np.asarray(x, float) for x in (spot, strike, sigma))
    d = (np.log(spot / strike) + (r - q + sigma * sigma / 2) * t) / (sigma * math.sqrt(t))
    return math.exp(-q * t) * np.where(call, phi(d), -phi(-d))


def volatilities(mid: np.ndarray, spot: float, strike: np.ndarray, t: float, r: float, call: np.ndarray) -> np.ndarray:
    """Volatility that gives each mid, all bisected together; NaN where none within the bounds does, or the mid is below the least."""
    lo, hi = np.full(len(mid), VOL_LOW), np.full(len(mid), VOL_HIGH)
    ok = (mid >= LEAST_MID) & (value(spot, strike, t, r, lo, call) <= mid) & (mid <= value(spot, strike, t, r, hi, call))
    for _ in range(60):
        at = (lo + hi) / 2
        below = value(spot, strike, t, r, at, call) < mid
        lo, hi = np.where(below, at, lo), np.where(below, hi, at)
    return np.where(ok, (lo + hi) / 2, np.nan)


def slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes of the monotone cubic: weighted harmonic means inside, one-sided and shape-preserving at the ends."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    if len(x) == 2:
        return np.r_[d, d]
    a, b = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = np.where(d[:-1] * d[1:] > 0, (a + b) / (a / d[:-1] + b / d[1:]), 0.0)

    def end(h0, h1, d0, d1):
        m = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if m * d0 <= 0:
            return 0.0
        return 3 * d0 if d0 * d1 <= 0 and abs(m) > 3 * abs(d0) else m

    return np.r_[end(h[0], h[1], d[0], d[1]), inner, end(h[-1], h[-2], d[-1], d[-2])]


def smile(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The monotone cubic through the points; beyond the ends, the end values."""
    m, h = slopes(x, y), np.diff(x)
    at = np.clip(at, x[0], x[-1])
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(h) - 1)
    s = (at - x[i]) / h[i]
    return y[i] * (1 + 2 * s) * (1 - s) ** 2 + h[i] * m[i] * s * (1 - s) ** 2 + y[i + 1] * s * s * (3 - 2 * s) + h[i] * m[i + 1] * s * s * (s - 1)


def strike_volatilities(chain: pd.DataFrame, spot: float, t: float, r: float, forward: float) -> tuple[np.ndarray, np.ndarray]:
    """Strikes and volatilities, from the side out of the money, else the other; strikes far from the others' volatility are dropped."""
    x = chain[(chain["strike"] > 0) & chain["type"].isin(["call", "put"])]
    x = x[np.abs(np.log(x["strike"] / forward)) <= WIDEST]
    if not len(x):
        return np.zeros(0), np.zeros(0)
    x = x.assign(iv=volatilities(x["mid"].to_numpy(float), spot, x["strike"].to_numpy(float), t, r, (x["type"] == "call").to_numpy()))
    wide = x.drop_duplicates(["strike", "type"], keep="last").pivot(index="strike", columns="type", values="iv").reindex(columns=["call", "put"]).sort_index()
    k = wide.index.to_numpy(float)
    call, put = wide["call"].to_numpy(), wide["put"].to_numpy()
    iv = np.where(k > forward, np.where(np.isnan(call), put, call), np.where(np.isnan(put), call, put))
    ok = (iv > VOL_LOW) & (iv < VOL_HIGH)
    k, iv = k[ok], iv[ok]
    if len(iv) >= 4:
        off = np.abs(iv - np.median(iv))
        near = off <= max(6 * 1.4826 * np.median(off), 0.05)
        if near.sum() >= 4:
            k, iv = k[near], iv[near]
    return k, iv


def fitted(chain: pd.DataFrame, spot: float, t: float, r: float, q: float, least: int) -> dict | None:
    """The distribution of one expiry, none with fewer than ``least`` strikes or where the strikes hold less than half of it."""
    forward = spot * math.exp((r - q) * t)
    k, iv = strike_volatilities(chain, spot, t, r, forward)
    if len(k) < least:
        return None
    x = np.log(k / forward)
    for band in (3 * float(np.interp(0.0, x, iv)) * math.sqrt(t), 0.35):
        inside = np.abs(x) <= band
        if inside.sum() >= max(2 * least, 10):
            x, iv = x[inside], iv[inside]
            break
    low, high = forward * math.exp(x[0]), forward * math.exp(x[-1])
    grid = np.linspace(low, high, GRID)
    vol = np.clip(smile(x, iv, np.log(grid / forward)), VOL_LOW, VOL_HIGH)
    slope = np.diff(value(spot, grid, t, r, vol, True, q)) / np.diff(grid)
    raw, mid = 1 + math.exp(r * t) * slope, (grid[1:] + grid[:-1]) / 2
    cdf = O.isotonic(np.clip(raw, 0, 1))
    span = float(cdf[-1] - cdf[0])
    if not span >= 0.5:
        return None
    cdf = (cdf - cdf[0]) / span
    above = lambda p: 1 - float(np.interp(p, mid, cdf))
    # the density by the mass of each cell, so that none is lost between its points
    points = np.linspace((mid[0] + mid[1]) / 2, (mid[-1] + mid[-2]) / 2, SHOWN)
    edges = np.r_[points[0], (points[1:] + points[:-1]) / 2, points[-1]]
    pdf = np.diff(np.interp(edges, mid, cdf)) / np.diff(edges)
    area = float(((pdf[1:] + pdf[:-1]) / 2 * np.diff(points)).sum())
    wing = forward * np.exp(np.linspace(x[0], x[-1], 200))
    wing_vol = smile(x, iv, np.log(wing / forward))
    gap = [np.abs(np.abs(delta(spot, wing, t, r, wing_vol, c, q)) - 0.25) for c in (False, True)]
    broken = float(np.mean(np.diff(raw) < -1e-9))
    at = [float(v) / spot - 1 for v in np.interp(LEVELS, cdf, mid)]
    return dict(zip(("q05", "q25", "q50", "q75", "q95"), at)) | {
        "iv_atm": float(smile(x, iv, np.zeros(1))[0]), "skew_25d": float(wing_vol[gap[0].argmin()] - wing_vol[gap[1].argmin()]),
        "p_up10": above(spot * 1.1), "p_dn10": 1 - above(spot * 0.9), "p_up20": above(spot * 1.2), "p_dn20": 1 - above(spot * 0.8),
        "rn_mean": forward / spot - 1, "span": span, "n_strikes": len(x), "forward": forward, "low": low, "high": high,
        "monotone": bool((slope <= 1e-9).all()), "broken": broken, "quality": "ok" if broken <= 0.25 else "noisy_tails",
        "density": [{"k": float(a), "pdf": float(b / area)} for a, b in zip(points, pdf)],
    }


FIELDS = (
    "q05 double, q25 double, q50 double, q75 double, q95 double, iv_atm double, skew_25d double, p_up10 double, p_dn10 double, p_up20 double, p_dn20 double, "
    "rn_mean double, span double, n_strikes int, forward double, low double, high double, monotone boolean, broken double, quality string, density array<struct<k: double, pdf: double>>"
)


def implied(chain: DataFrame, as_of: str, r: float = 0.04, q: float = 0.0, least: int = 5) -> DataFrame:
    """underlying, months, expiry, t (years), spot and the distribution of the expiry nearest to each horizon.

    ``chain``: underlying, spot, expiry, strike, type, mid. An expiry is fitted once, whatever horizons it serves. A chain without a
    positive spot, or that can't be fitted, has no rows; null mids and strikes are left out.
    """
    spots = chain.where("spot > 0")
    asked = O.nearest_expiry(spots, as_of, tuple(DAYS.values()))
    months = F.create_map(*(F.lit(v) for m, d in DAYS.items() for v in (d, m)))[F.col("target")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        t = max((rows["expiry"].iloc[0] - pd.Timestamp(as_of).date()).days, 1) / 365.25
        spot = float(rows["spot"].iloc[0])
        out = fitted(rows.dropna(subset=["strike", "mid"]), spot, t, r, q, least)
        names = ["underlying", "expiry", "spot", "t", *(f.split()[0] for f in FIELDS.split(", ") if ":" not in f), "density"]
        own = [] if out is None else [{"underlying": rows["underlying"].iloc[0], "expiry": rows["expiry"].iloc[0], "spot": spot, "t": t} | out]
        return pd.DataFrame(own, columns=list(dict.fromkeys(names)))

    used = spots.join(asked.select("underlying", "expiry").distinct(), ["underlying", "expiry"], "left_semi")
    fits = used.select("underlying", "expiry", "spot", "strike", "type", "mid").groupBy("underlying", "expiry").applyInPandas(run, f"underlying string, expiry date, spot double, t double, {FIELDS}")
    return asked.withColumn("months", months).drop("target").join(fits, ["underlying", "expiry"])


def to_base_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """The rows of :func:`implied` with implied_iqr, width_ratio (over the base rates' spread), mean_shift and shifted quantiles rw_q05 to rw_q95.

    ``rates``: symbol, months, iqr, median. The shift is the base rates' median less the risk-neutral mean; without a median there
    is none, and no ratio without a positive spread.
    """
    x = rows.join(rates.select(F.col("symbol").alias("underlying"), "months", "iqr", "median"), ["underlying", "months"], "left")
    shift = F.col("median") - F.col("rn_mean")
    x = x.withColumn("implied_iqr", F.col("q75") - F.col("q25")).withColumn("width_ratio", F.when(F.col("iqr") > 0, F.col("implied_iqr") / F.col("iqr"))).withColumn("mean_shift", shift)
    return x.select("*", *((F.col(k) + F.col("mean_shift")).alias(f"rw_{k}") for k in ("q05", "q25", "q50", "q75", "q95"))).drop("iqr", "median")


def priced(spot: Column, strike: Column, t: Column, sigma: Column, call: Column, r: float = 0.04) -> Column:
    """Black-Scholes value as a column expression (positive inputs)."""
    d = (F.ln(spot / strike) + (r + sigma * sigma / 2) * t) / (sigma * F.sqrt(t))
    sign = F.when(call, 1.0).otherwise(-1.0)
    return sign * (spot * normal_cdf(sign * d) - strike * F.exp(-r * t) * normal_cdf(sign * (d - sigma * F.sqrt(t))))
