"""Option chains: ladders, nearest expiries and strikes, Black-Scholes, implied volatility and density."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_N = NormalDist()
#: The horizons' days to expiry.
TARGETS = (30, 61, 91, 182, 365, 548)


def nearest_expiry(contracts: DataFrame, as_of: str, targets: tuple[int, ...] = TARGETS) -> DataFrame:
    """The expiry nearest to each target number of days, the earlier on a tie."""
    e = contracts.select("underlying", "expiry", F.datediff("expiry", F.lit(as_of).cast("date")).alias("dte")).where("dte > 0").distinct()
    each = e.select("*", F.explode(F.array(*map(F.lit, targets))).alias("target"))
    return each.groupBy("underlying", "target").agg(F.min_by("expiry", F.struct(F.abs(F.col("dte") - F.col("target")), F.col("dte"))).alias("expiry"))


def ladder(contracts: DataFrame, spot: float, k: int = 9) -> DataFrame:
    """Calls and puts side by side on the ``k`` strikes nearest to the spot, with net open interest and the put-call ratio."""
    side = lambda t: F.coalesce(F.sum(F.when(F.col("type") == t, F.col("oi"))), F.lit(0))
    g = contracts.groupBy("underlying", "strike").agg(side("call").alias("call_oi"), side("put").alias("put_oi"))
    w = Window.partitionBy("underlying").orderBy(F.abs(F.col("strike") - spot), "strike")
    near = g.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return near.select("underlying", "strike", "call_oi", "put_oi", (F.col("call_oi") - F.col("put_oi")).alias("net"), F.coalesce(F.col("put_oi") / F.nullif(F.col("call_oi"), F.lit(0)), F.lit(0.0)).alias("pcr"))


def open_interest(contracts: DataFrame, spot: float) -> DataFrame:
    """Totals, ratio, the strike with most open interest and the net at the strike nearest to the spot."""
    g = ladder(contracts, spot, 1_000_000)
    return g.groupBy("underlying").agg(
        F.sum("call_oi").alias("calls"), F.sum("put_oi").alias("puts"), F.max_by("strike", F.struct(F.col("call_oi") + F.col("put_oi"), -F.col("strike"))).alias("peak"),
        F.min_by("net", F.struct(F.abs(F.col("strike") - spot), F.col("strike"))).alias("net_near"),
    ).withColumn("pcr", F.col("puts") / F.nullif(F.col("calls"), F.lit(0)))


def third_friday(month):
    """The third Friday of a date's month."""
    return F.date_add(F.next_day(F.date_sub(F.trunc(month, "month"), 1), "FRI"), 14)


def mid(bid: str = "bid", ask: str = "ask", others: tuple[str, ...] = ("day_close", "last")) -> Column:
    """The middle of a two-sided quote, else the first of the others above zero; null where none is."""
    quoted = F.when((F.col(ask) >= F.col(bid)) & (F.col(bid) > 0), (F.col(bid) + F.col(ask)) / 2)
    return F.coalesce(quoted, *(F.when((F.col(c) > 0) & ~F.isnan(c), F.col(c).cast("double")) for c in others))


def first_at_strike(contracts: DataFrame, by: str = "oi") -> DataFrame:
    """One call and one put of each (underlying, strike): the nearest expiry's; absent sides count zero."""
    x = contracts.groupBy("underlying", "strike").agg(*(F.min(F.when(F.col("type") == t, F.struct("expiry", by)))[by].alias(t) for t in ("call", "put")))
    return x.select("underlying", "strike", *(F.coalesce(t, F.lit(0)).alias(t) for t in ("call", "put")))


def zones(quantiles: DataFrame, horizons: tuple[int, ...] = (3, 6)) -> DataFrame:
    """Price zones from implied quantiles (symbol, h, spot, q25, q75): cheap spans the 25 per cent points, rich the 75.

    A horizon without both quantiles, or without a positive spot, takes no part; a symbol without any has no row.
    """
    ok = quantiles.where(F.col("h").isin(*horizons) & (F.col("spot") > 0)).dropna(subset=["q25", "q75"])
    at = lambda q: F.col("spot") * (1 + F.col(q))
    names = F.array_join(F.transform(F.array_sort(F.collect_set("h")), lambda h: F.concat(h.cast("string"), F.lit("m"))), "-")
    return ok.groupBy("symbol").agg(*(F.round(f(at(q)), 4).alias(f"{name}_{end}") for name, q in (("cheap", "q25"), ("rich", "q75")) for end, f in (("lo", F.min), ("hi", F.max))), names.alias("horizon"))


def price(spot: float, strike: float, t: float, r: float, sigma: float, call: bool, q: float = 0.0) -> float:
    """Black-Scholes value with a dividend yield; where degenerate, the discounted forward's intrinsic value."""
    if t <= 0 or sigma <= 0 or spot <= 0 or strike <= 0:
        forward = spot * math.exp(-q * t) - strike * math.exp(-r * t)
        return max(0.0, forward if call else -forward)
    d = (math.log(spot / strike) + (r - q + sigma * sigma / 2) * t) / (sigma * math.sqrt(t))
    e = d - sigma * math.sqrt(t)
    sign = 1 if call else -1
    return sign * (spot * math.exp(-q * t) * _N.cdf(sign * d) - strike * math.exp(-r * t) * _N.cdf(sign * e))


def implied(value: float, spot: float, strike: float, t: float, r: float, call: bool, q: float = 0.0) -> float | None:
    """Volatility between 1e-4 and 5 at which the model gives ``value``, by bisection; none outside the bounds."""
    lo, hi = 1e-4, 5.0
    if not (value > 0 and t > 0 and price(spot, strike, t, r, lo, call, q) <= value <= price(spot, strike, t, r, hi, call, q)):
        return None
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if price(spot, strike, t, r, mid, call, q) < value else (lo, mid)
    return (lo + hi) / 2


def isotonic(x: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing sequence in least squares (pool adjacent violators)."""
    level, weight = [], []
    for v in x:
        level.append(float(v))
        weight.append(1)
        while len(level) > 1 and level[-2] > level[-1]:
            b, n = level.pop(), weight.pop()
            level[-1] = (level[-1] * weight[-1] + b * n) / (weight[-1] + n)
            weight[-1] += n
    return np.repeat(level, weight)


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation; beyond the ends, the end values."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    if len(x) > 2:
        a, b = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = (a + b) / (a / d[:-1] + b / d[1:])
        m[1:-1] = np.where(d[:-1] * d[1:] > 0, mean, 0.0)
    m[0], m[-1] = d[0], d[-1]
    at = np.clip(at, x[0], x[-1])
    i = np.clip(np.searchsorted(x, at) - 1, 0, len(h) - 1)
    s = (at - x[i]) / h[i]
    return y[i] * (1 + 2 * s) * (1 - s) ** 2 + h[i] * m[i] * s * (1 - s) ** 2 + y[i + 1] * s * s * (3 - 2 * s) + h[i] * m[i + 1] * s * s * (s - 1)


def density(strikes: np.ndarray, vols: np.ndarray, spot: float, t: float, r: float, points: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid, density and distribution implied by a smile: its call curve's slope, made monotone and differenced."""
    grid = np.linspace(strikes[0], strikes[-1], points)
    smile = pchip(np.log(strikes), vols, np.log(grid))
    call = np.array([price(spot, k, t, r, s, True) for k, s in zip(grid, smile)])
    cdf = isotonic(np.clip(1 + math.exp(r * t) * np.gradient(call, grid), 0, 1))
    pdf = np.clip(np.gradient(cdf, grid), 0, None)
    area = float(((pdf[1:] + pdf[:-1]) / 2 * np.diff(grid)).sum())
    return grid, pdf / area if area > 0 else pdf, cdf


def implied_density(contracts: DataFrame, spot: float, as_of: str, r: float = 0.04, least: int = 5) -> DataFrame:
    """Implied quantiles of each (underlying, expiry) with enough strikes, from out-of-the-money marks."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        days = (rows["expiry"].iloc[0] - pd.Timestamp(as_of).date()).days
        t = max(days, 1) / 365.25 if days >= 0 else 0.0
        marks = {}
        for x in rows.sort_values(["strike", "type"]).itertuples():
            call = x.type == "call"
            if t > 0 and call == (x.strike >= spot) and x.mark >= 0.05 and (v := implied(x.mark, spot, x.strike, t, r, call)):
                marks[x.strike] = v
        k = np.array(sorted(marks))
        v = np.array([marks[s] for s in k])
        if len(k):
            centre = np.median(v)
            near = np.abs(v - centre) <= max(6 * 1.4826 * np.median(np.abs(v - centre)), 0.05)
            k, v = (k[near], v[near]) if near.sum() >= 4 else (k, v)
        if len(k) < least:
            return pd.DataFrame({k: pd.Series(dtype=t) for k, t in {"underlying": "object", "expiry": "object", "q25": "float64", "q50": "float64", "q75": "float64", "n": "int32"}.items()})
        grid, _, cdf = density(k, v, spot, t, r)
        q = np.interp([0.25, 0.5, 0.75], cdf, grid)
        return pd.DataFrame({"underlying": [rows["underlying"].iloc[0]], "expiry": [rows["expiry"].iloc[0]], "q25": [q[0]], "q50": [q[1]], "q75": [q[2]], "n": [len(k)]})

    return contracts.select("underlying", "expiry", "strike", "type", "mark").groupBy("underlying", "expiry").applyInPandas(run, "underlying string, expiry date, q25 double, q50 double, q75 double, n int")


def without_outliers(points: DataFrame, value: str = "iv", sigmas: float = 6.0, floor: float = 0.05) -> DataFrame:
    """Points of each (underlying, expiry) but those far from the median, by the median absolute deviation.

    Smiles of fewer than four points, or that would be left with fewer, are kept whole.
    """
    key = ["underlying", "expiry"]
    med = points.groupBy(*key).agg(F.percentile(value, 0.5).alias("__med"))
    x = points.join(med, key).withColumn("__off", F.abs(F.col(value) - F.col("__med")))
    mad = x.groupBy(*key).agg(F.percentile("__off", 0.5).alias("__mad"))
    w = Window.partitionBy(*key)
    x = x.join(mad, key).withColumn("__in", F.col("__off") <= F.greatest(F.lit(sigmas * 1.4826) * F.col("__mad"), F.lit(floor)))
    return x.withColumn("__k", F.count_if("__in").over(w)).where("__in or __k < 4").select(*points.columns)


def smile(points: DataFrame, spot: float, tolerance: float = 0.10) -> DataFrame:
    """At-the-money volatility (mean at the nearest strike) and the 25-delta put less call volatility of each expiry.

    ``points`` has underlying, expiry, strike, type, iv and delta. A wing further than ``tolerance`` from 0.25 gives null.
    """
    key, known = ["underlying", "expiry"], points.where("iv is not null")
    near = known.groupBy(*key).agg(F.min(F.struct(F.abs(F.col("strike") - spot).alias("off"), "strike"))["strike"].alias("atm_strike"))
    atm = known.join(near, key).where("strike = atm_strike").groupBy(*key, "atm_strike").agg(F.avg("iv").alias("atm_iv"))
    off = F.abs(F.abs("delta") - 0.25)
    wing = lambda t: F.min(F.when((F.col("type") == t) & F.col("delta").isNotNull(), F.struct(off.alias("off"), "strike", "iv")))
    wings = known.groupBy(*key).agg(wing("put").alias("p"), wing("call").alias("c"))
    skew = F.when((F.col("p.off") <= tolerance) & (F.col("c.off") <= tolerance), F.col("p.iv") - F.col("c.iv"))
    return atm.join(wings.select(*key, skew.alias("skew_25d")), key)
