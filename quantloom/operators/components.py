"""Components of a forecast, one long table of them, and their mixture.

A component gives a symbol, horizon (months ``months``, rows ``h``) an expected simple return (``value``), a deviation (``sigma``) and how
much evidence stands behind it. Skill weighs them, the market's drift pulls them in (both in ``forecasts``), and the mixture
of what is left lives on log returns.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.scalars import phi
from quantloom.operators import bars as B
from quantloom.operators import cross as X
from quantloom.operators import cycles, evidence
from quantloom.operators import forecasts as G
from quantloom.operators import models as M
from quantloom.operators.cycles import HORIZONS

#: Yearly drift without a market, volatility without a history, evidence of components that aren't measured.
DRIFT, VOLATILITY, FACTOR_EVIDENCE, STATEMENT_EVIDENCE, MACRO_EVIDENCE = 0.08, 0.25, 0.20, 0.30, 0.25
#: Yearly tilt of each stage of a company.
TILTS = {"turnaround": 0.06, "growing": 0.04, "stable": 0.0, "peaking": -0.03, "declining": -0.08}
#: How a macro series' change over three months tilts a year (factor, bound), and a change of mode "pct" (or, for the dollar, "diff") in the other unit.
MACRO = {"hy_spread": (-0.05, 0.08, "pct", 100.0), "vix": (-0.002, 0.06, "pct", 20.0), "dollar": (-0.5, 0.04, "diff", 0.01), "curve": (0.01, 0.05, "", 1.0)}
#: Fixed value: the normal distribution's 90 per cent point.
Z90 = 1.2815515655446004
COLUMNS = ("symbol", "component", "months", "h", "value", "sigma", "evidence")


def _horizons(x: DataFrame) -> DataFrame:
    """Every row once for each horizon."""
    return x.withColumn("__at", F.explode(F.array(*(F.struct(F.lit(m).alias("months"), F.lit(d).alias("h")) for m, d in HORIZONS.items())))).select(*x.columns, "__at.*")


def daily_volatility(bars: DataFrame, rows: int = 252) -> DataFrame:
    """symbol and daily: deviation of the newest log returns, more than twenty of a history of more than thirty closes; else 25 per cent a year."""
    r = bars.where("close > 0").withColumn("lr", F.ln(F.col("close") / F.lag("close").over(B.by()))).withColumn("age", F.row_number().over(B.newest()))
    own = F.when(F.col("age") <= rows, F.col("lr"))
    g = r.groupBy("symbol").agg(F.stddev_samp(own).alias("sd"), F.count(own).alias("k"), F.count("*").alias("n"))
    return g.select("symbol", F.when((F.col("n") > 30) & (F.col("k") > 20) & (F.col("sd") > 0), F.col("sd")).otherwise(VOLATILITY / math.sqrt(252)).alias("daily"))


def _named(x: DataFrame, name: str) -> DataFrame:
    return x.withColumn("component", F.lit(name)).select(*COLUMNS)


def _base() -> Column:
    return F.col("daily") * F.sqrt(F.col("h"))


def compounded(daily: Column, rows: Column) -> Column:
    return F.when(daily > -1, F.expm1(F.log1p(daily) * rows)).otherwise(-1.0)


def seasonality(bars: DataFrame) -> DataFrame:
    """Mean forward return from the calendar month of a symbol's newest bar; the spread from its tenths; evidence by years, full at twenty."""
    month = bars.groupBy("symbol").agg(F.month(F.max("date")).alias("m"))
    x = B.forward_stats(bars, tuple(HORIZONS)).withColumnRenamed("h", "months").join(month, ["symbol", "m"]).join(daily_volatility(bars), "symbol")
    rows = F.create_map(*(F.lit(v) for kv in HORIZONS.items() for v in kv))[F.col("months")]
    x = x.withColumn("h", rows)
    sigma = F.when(F.col("p90") > F.col("p10"), (F.col("p90") - F.col("p10")) / (2 * Z90)).otherwise(_base())
    return _named(x.withColumn("value", F.col("mean")).withColumn("sigma", sigma).withColumn("evidence", F.least(F.lit(1.0), F.col("n") / 20)), "seasonality")


def regime_model(bars: DataFrame, rows: int = 2707, window: int = 10) -> DataFrame:
    """A row a symbol: its fitted hidden Markov model and what it says of each day and state.

    Features are the return and the mean squared distance from the moving average over its square. States are named by their mean
    return on the most likely path, ties by volatility: bull, neutral, bear. days: date, state (most likely path) and filtered (by
    no later row). states: label, posterior (newest), stationary, duration (expected rows), mean_return, n (rows on the path) and ahead: rows
    to be expected in the state over each horizon, from the newest posterior and powers of the transition matrix. A symbol of
    fewer than 60 rows with both features has no row. A model is one series' recursion and runs in one task.
    """
    state = "label: string, posterior: double, stationary: double, duration: double, mean_return: double, n: int, moves: array<double>, ahead: array<struct<months: int, h: int, days: double>>"

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("date")
        mean = x["close"].rolling(window).mean()
        v = ((x["close"] - mean) ** 2).rolling(window).mean() / mean**2
        raw = pd.DataFrame({"date": x["date"], "r": x["close"].pct_change(), "v": v}).dropna().tail(rows)
        if len(raw) < 60:
            return pd.DataFrame(columns=["symbol", "days", "states"])
        f = raw[["r", "v"]].to_numpy()
        spread = f.std(axis=0)
        z = (f - f.mean(axis=0)) / np.where(spread > 0, spread, 1.0)
        m = M.Hmm(rounds=200, starts=4).fit(z)
        path = m.viterbi(z)
        filtered, smoothed, _, _ = m._passes(z)
        on = [f[path == j] if (path == j).any() else (m.mean[j] * spread + f.mean(axis=0))[None] for j in range(m.k)]
        r, w = (np.array([o[:, c].mean() for o in on]) for c in (0, 1))
        label = dict.fromkeys(range(m.k), "neutral")
        label[min(label, key=lambda j: (r[j], -w[j]))] = "bear"
        label[min(label, key=lambda j: (-r[j], w[j]))] = "bull"
        p, sums, ahead = smoothed[-1] / smoothed[-1].sum(), np.zeros(m.k), [[] for _ in range(m.k)]
        at = {days: months for months, days in HORIZONS.items()}
        for day in range(1, max(at) + 1):
            sums, p = sums + p, p @ m.move
            for j in range(m.k) if day in at else ():
                ahead[j].append({"months": at[day], "h": day, "days": float(sums[j])})
        still, stays = m.stationary(), m.durations()
        states = [{"label": label[j], "posterior": float(smoothed[-1, j]), "stationary": float(still[j]), "duration": float(stays[j]), "mean_return": float(r[j]), "n": int((path == j).sum()), "moves": m.move[j].tolist(), "ahead": ahead[j]} for j in range(m.k)]
        days = [{"date": d, "state": label[a], "filtered": label[b]} for d, a, b in zip(raw["date"], path.tolist(), filtered.argmax(axis=1).tolist())]
        return pd.DataFrame([{"symbol": x["symbol"].iloc[0], "days": days, "states": states}])

    schema = f"symbol string, days array<struct<date: date, state: string, filtered: string>>, states array<struct<{state}>>"
    return bars.select("symbol", "date", "close").where("close > 0").groupBy("symbol").applyInPandas(run, schema)


def regime_days(model: DataFrame) -> DataFrame:
    """symbol, date, state and filtered of :func:`regime_model`."""
    return model.select("symbol", F.inline("days"))


def regime_states(model: DataFrame) -> DataFrame:
    """A row a symbol and state of :func:`regime_model`."""
    return model.select("symbol", F.inline("states"))


def regime(bars: DataFrame, market: str, model: DataFrame | None = None) -> DataFrame:
    """The market's regimes carried forward, priced with what each symbol did on the day after days of each regime.

    Days come by the labels that look at no later row, ten of a label at least. Evidence is the newest posterior of the
    market's state (0.05 at least). Labels without enough days add nothing; a symbol with none of them has no row.
    """
    model = regime_model(bars.where(F.col("symbol") == market)) if model is None else model
    labels = regime_days(model).select("date", F.col("filtered").alias("label"))
    own = evidence.stats_by_label(bars, labels, least=10)
    states = regime_states(model).groupBy("label").agg(F.max_by("ahead", "posterior").alias("ahead"), F.max("posterior").alias("posterior"))
    now = regime_days(model).agg(F.max_by("state", "date").alias("now"))
    sure = states.join(now, F.col("label") == F.col("now")).select(F.greatest(F.lit(0.05), F.least(F.lit(1.0), "posterior")).alias("evidence"))
    x = own.join(F.broadcast(states.select("label", F.inline("ahead"))), "label")  # three states
    g = x.groupBy("symbol", "months", "h").agg(F.sum(F.col("days") * F.col("mean")).alias("mean"), F.sum(F.col("days") * F.pow("sd", F.lit(2))).alias("var"))
    g = g.join(F.broadcast(sure)).join(daily_volatility(bars), "symbol")  # one row
    return _named(g.withColumn("value", F.expm1("mean")).withColumn("sigma", F.when(F.col("var") > 0, F.sqrt("var")).otherwise(_base())), "regime")


def factors(bars: DataFrame, names: list[str], window: int = 1260) -> DataFrame:
    """Betas of the newest rows times the factors' mean daily returns over their whole history; the intercept takes no part."""
    fit = M.factor_regression(bars, names, window)
    premia = X.returns(bars).where(F.col("symbol").isin(names)).groupBy(F.col("symbol").alias("name")).agg(F.avg("ret").alias("premium"))
    g = fit.where("name <> 'alpha'").join(F.broadcast(premia), "name").groupBy("symbol").agg(F.sum(F.col("coef") * F.col("premium")).alias("mean"), F.max("sigma").alias("rest"), F.max("r2").alias("r2"))
    total = F.when(F.col("r2") < 0.98, F.col("rest") / F.sqrt(F.greatest(1 - F.col("r2"), F.lit(0.02)))).otherwise(F.col("rest"))
    x = _horizons(g.join(daily_volatility(bars), "symbol").withColumn("total", total))
    sigma = F.when(F.col("total") > 0, F.col("total") * F.sqrt("h")).otherwise(_base())
    return _named(x.withColumn("value", compounded(F.col("mean"), F.col("h"))).withColumn("sigma", sigma).withColumn("evidence", F.lit(FACTOR_EVIDENCE)), "factors")


def spectral(bars: DataFrame) -> DataFrame:
    """The cycles' projection; its confidence is the evidence, and widens the base deviation, four times at most."""
    x = cycles.cycle_projection(bars).withColumnRenamed("h", "months").withColumnRenamed("days", "h").join(daily_volatility(bars), "symbol")
    sure = F.when(F.col("confidence") != 0, F.col("confidence")).otherwise(0.05)
    sigma = F.least(_base() / F.sqrt(F.greatest(sure, F.lit(0.05))), _base() * 4)
    return _named(x.withColumn("value", F.col("expected")).withColumn("sigma", sigma).withColumn("evidence", sure), "spectral")


def _tilted(bars: DataFrame, annual: DataFrame, name: str, widen: float, sure: float) -> DataFrame:
    daily = F.when(F.col("annual") > -1, F.expm1(F.log1p("annual") / 252)).otherwise(-0.001)
    x = _horizons(daily_volatility(bars).join(annual, "symbol")) if "symbol" in annual.columns else _horizons(daily_volatility(bars).join(F.broadcast(annual)))
    return _named(x.withColumn("value", compounded(daily, F.col("h"))).withColumn("sigma", _base() * widen).withColumn("evidence", F.lit(sure)), name)


def fundamentals(bars: DataFrame, stages: DataFrame) -> DataFrame:
    """A tilt by the company's stage, and a quarter of its yearly revenue growth between -50 and 50 per cent.

    ``stages``: symbol, stage, yoy. A symbol with neither a known stage nor growth has no row.
    """
    tilt = F.create_map(*(F.lit(v) for kv in TILTS.items() for v in kv))[F.lower("stage")]
    x = stages.withColumn("tilt", tilt).where("tilt is not null or yoy is not null")
    growth = F.least(F.lit(0.5), F.greatest(F.lit(-0.5), "yoy")) * 0.25
    annual = F.coalesce("tilt", F.lit(0.0)) + F.coalesce(F.when(F.col("yoy").isNotNull(), growth), F.lit(0.0))
    return _tilted(bars, x.select("symbol", annual.alias("annual")), "fundamentals", 1.6, STATEMENT_EVIDENCE)


def macro(bars: DataFrame, changes: DataFrame) -> DataFrame:
    """A tilt by risk appetite, the same for every symbol, from series (of ``MACRO``; curve's is a level), change and mode (diff or pct)."""
    known = F.create_map(*(F.lit(x) for k, (f, b, m, u) in MACRO.items() for x in (k, F.struct(F.lit(f).alias("f"), F.lit(b).alias("b"), F.lit(m).alias("m"), F.lit(u).alias("u")))))
    x = changes.where("change is not null and not isnan(change)").withColumn("k", known[F.col("series")]).where("k is not null")
    moved = F.col("change") * F.when(F.coalesce("mode", F.lit("diff")) == F.col("k.m"), F.col("k.u")).otherwise(1.0) * F.col("k.f")
    annual = x.agg(F.sum(F.greatest(-F.col("k.b"), F.least(F.col("k.b"), moved))).alias("annual")).where("annual is not null")
    return _tilted(bars, annual, "macro", 2.0, MACRO_EVIDENCE)


def market_prior(bars: DataFrame, market: str) -> DataFrame:
    """months, h, prior and source: the market's mean daily log return (more than sixty closes), or 8 per cent a year, compounded."""
    r = bars.where((F.col("symbol") == market) & (F.col("close") > 0)).withColumn("lr", F.ln(F.col("close") / F.lag("close").over(B.by())))
    g = r.agg(F.avg("lr").alias("mean"), F.count("*").alias("n"))
    ok = F.col("n") > 60
    daily = F.when(ok, F.coalesce("mean", F.lit(0.0))).otherwise(math.log1p(DRIFT) / 252)
    x = _horizons(g.select(daily.alias("daily"), F.when(ok, "market").otherwise("assumed").alias("source")))
    return x.select("months", "h", F.expm1(F.col("daily") * F.col("h")).alias("prior"), "source")


def calibrated(components: DataFrame, bars: DataFrame, skill: DataFrame, market: str) -> DataFrame:
    """``components`` pulled to the market's prior by what their evidence, skill and history lack, and into the bounds of what the symbol has done."""
    n = bars.where("close > 0").groupBy("symbol").agg(F.count("*").alias("n_obs"))
    bounds = B.return_bounds(bars, tuple(HORIZONS.values())).select("symbol", "h", F.col("p05").alias("low"), F.col("p95").alias("high"))
    x = components.join(F.broadcast(market_prior(bars, market).select("h", "prior")), "h").join(n, "symbol")  # a row a horizon
    x = x.join(bounds, ["symbol", "h"], "left").join(skill.select("symbol", "component", "skill"), ["symbol", "component"], "left")
    return G.shrunk(x)


def parts(components: DataFrame, weights: DataFrame, value: str = "calibrated") -> DataFrame:
    """symbol, months, h and parts: weight, mean and deviation of log(1 + return) with the component's two moments.

    Components without a positive weight or deviation, or at or below -100 per cent, are left out; weights of the others sum to one.
    """
    x = components.join(weights, ["symbol", "component"]).withColumn("growth", 1 + F.col(value)).withColumn("s2", F.log1p(F.pow(F.col("sigma") / F.col("growth"), F.lit(2))))
    x = x.where("weight > 0 and sigma > 0 and growth > 1e-9 and s2 > 0 and not isnan(growth) and not isnan(sigma)")
    one = F.struct("component", "weight", (F.ln("growth") - F.col("s2") / 2).alias("mean"), F.sqrt("s2").alias("sd"))
    g = x.groupBy("symbol", "months", "h").agg(F.sort_array(F.collect_list(one)).alias("parts"), F.sum("weight").alias("total"))  # six at most
    return g.select("symbol", "months", "h", F.transform("parts", lambda p: F.struct(p["component"].alias("component"), (p["weight"] / F.col("total")).alias("weight"), p["mean"].alias("mean"), p["sd"].alias("sd"))).alias("parts"))


def _cdf(x: np.ndarray, w: np.ndarray, m: np.ndarray, s: np.ndarray) -> np.ndarray:
    return (w * phi((x[:, None] - m) / s)).sum(axis=1)


def mixture_quantiles(p: np.ndarray, w: np.ndarray, m: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Quantile ``p`` of each row's mixture of normals (rows by parts; padding has weight zero), all rows bisected together."""
    mean = (w * m).sum(axis=1)
    sd = np.sqrt(np.maximum((w * (s * s + m * m)).sum(axis=1) - mean * mean, 1e-18))
    p, lo, hi = np.clip(p, 1e-9, 1 - 1e-9), mean - 12 * sd, mean + 12 * sd
    for _ in range(60):
        mid = (lo + hi) / 2
        below = _cdf(mid, w, m, s) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def truncated_mean(lower: np.ndarray, upper: np.ndarray, w: np.ndarray, m: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Mean of each row's mixture between two cuts (which may be infinite); NaN where it has no mass there."""
    density = lambda z: np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    a, b = (lower[:, None] - m) / s, (upper[:, None] - m) / s
    mass = phi(b) - phi(a)
    top, held = (w * (m * mass - s * (density(b) - density(a)))).sum(axis=1), (w * mass).sum(axis=1)
    return np.divide(top, held, out=np.full(len(w), np.nan), where=held > 1e-12)


CASES = ("bear", "neutral", "bull")
FIGURES = (
    "mean", "std", "skew", "kurtosis", "mean_log", "std_log", "cut_low", "cut_high", *(f"p_{c}" for c in CASES),
    *(f"{c}_{f}" for c in CASES for f in ("expected", "p10", "p50", "p90")), "q25", "q50", "q75",
)


def mix(parts_: DataFrame, cut: float = 0.5) -> DataFrame:
    """symbol, months, h and the figures of each mixture of :func:`parts`.

    mean, std, skew and kurtosis are of the simple return, mean_log and std_log of the log return. It is cut half a deviation
    either side of its log mean into bear, neutral and bull: probabilities (one in sum), and each case's mean and 10, 50, 90 per
    cent points within it; q25, q50, q75 are of the whole. All but the log figures are simple returns. Rows without parts have none.
    """

    def run(frames):
        for x in frames:
            x = x[x["parts"].map(lambda v: v is not None and len(v) > 0)]
            n, k = len(x), max((len(v) for v in x["parts"]), default=1)
            w, m, s = np.zeros((n, k)), np.zeros((n, k)), np.ones((n, k))
            for i, own in enumerate(x["parts"]):
                for j, part in enumerate(own):
                    w[i, j], m[i, j], s[i, j] = part["weight"], part["mean"], part["sd"]
            raw = [(w * np.exp(o * m + o * o * s * s / 2)).sum(axis=1) for o in (1, 2, 3, 4)]
            std = np.sqrt(np.maximum(raw[1] - raw[0] ** 2, 0))
            m3, m4 = raw[2] - 3 * raw[0] * raw[1] + 2 * raw[0] ** 3, raw[3] - 4 * raw[0] * raw[2] + 6 * raw[0] ** 2 * raw[1] - 3 * raw[0] ** 4
            mean = (w * m).sum(axis=1)
            sd = np.sqrt(np.maximum((w * (s * s + m * m)).sum(axis=1) - mean * mean, 1e-18))
            low, high = mean - cut * sd, mean + cut * sd
            at = [np.zeros(n), _cdf(low, w, m, s), _cdf(high, w, m, s), np.ones(n)]
            chance = np.array([at[1], np.maximum(at[2] - at[1], 0), 1 - at[2]])
            chance = chance / chance.sum(axis=0)
            divide = lambda a, b: np.divide(a, b, out=np.full(n, np.nan), where=b > 0)
            out = dict(zip(FIGURES, [raw[0] - 1, std, divide(m3, std**3), divide(m4, std**4), mean, sd, np.expm1(low), np.expm1(high), *chance]))
            edge = [np.full(n, -np.inf), low, high, np.full(n, np.inf)]
            for c, name in enumerate(CASES):
                span = np.maximum(at[c + 1] - at[c], 1e-12)
                q = [mixture_quantiles(at[c] + span * f, w, m, s) for f in (0.1, 0.5, 0.9)]
                inside = truncated_mean(edge[c], edge[c + 1], w, m, s)
                out |= {f"{name}_expected": np.expm1(np.where(np.isnan(inside), q[1], inside))} | {f"{name}_{p}": np.expm1(v) for p, v in zip(("p10", "p50", "p90"), q)}
            out |= {f"q{p}": np.expm1(mixture_quantiles(np.full(n, p / 100), w, m, s)) for p in (25, 50, 75)}
            yield pd.DataFrame({"symbol": x["symbol"], "months": x["months"], "h": x["h"]} | out)

    return parts_.mapInPandas(run, "symbol string, months int, h int, " + ", ".join(f"`{f}` double" for f in FIGURES))


def zones(mixed: DataFrame, prices: DataFrame, months: int = 6) -> DataFrame:
    """symbol, price, bargain_below, fair_value, expensive_above and price over fair value less one, from the quartiles at one horizon."""
    x = mixed.where(F.col("months") == months).join(prices.where("price > 0"), "symbol")
    at = lambda q: F.col("price") * (1 + F.col(q))
    return x.select("symbol", "price", at("q25").alias("bargain_below"), at("q50").alias("fair_value"), at("q75").alias("expensive_above"), (1 / (1 + F.col("q50")) - 1).alias("against_fair"))


def targets(mixed: DataFrame, prices: DataFrame) -> DataFrame:
    """symbol, horizon, kind, price and probability: the bull case's median price in 3, 6 and 12 months, and the bear's in 3 as the price to reassess at."""
    x = mixed.join(prices.where("price > 0"), "symbol")
    exits = x.where(F.col("months").isin(3, 6, 12)).select("symbol", "months", F.lit("exit").alias("kind"), (F.col("price") * (1 + F.col("bull_p50"))).alias("target"), F.col("p_bull").alias("probability"))
    stop = x.where("months = 3").select("symbol", "months", F.lit("reassess").alias("kind"), (F.col("price") * (1 + F.col("bear_p50"))).alias("target"), F.col("p_bear").alias("probability"))
    return exits.unionByName(stop)


def recommendations(mixed: DataFrame, zone: DataFrame, labels: DataFrame, coverage: DataFrame, months: int = 3) -> DataFrame:
    """symbol, score, action, conviction and strength of each symbol.

    The score is the bull's less the bear's probability at ``months``, and how far fair value lies above the price (half
    at most, either way; nothing without a zone). Conviction grows with it, 0.3 lower where returns are noise (``labels``: symbol,
    label) and 0.15 higher where they have structure, and halves as the share of sections that exist (``coverage``: symbol, share) falls to none.
    """
    x = mixed.where(F.col("months") == months).select("symbol", (F.col("p_bull") - F.col("p_bear")).alias("edge"))
    x = x.join(zone.select("symbol", (F.col("fair_value") / F.col("price") - 1).alias("gap")), "symbol", "left").join(labels, "symbol", "left").join(coverage, "symbol", "left")
    x = x.withColumn("score", F.col("edge") + F.when(F.col("gap").isNotNull(), F.greatest(F.lit(-0.5), F.least(F.lit(0.5), "gap"))).otherwise(0.0))
    s = F.col("score")
    action = F.when(s > 0.35, "strong_buy").when(s > 0.12, "buy").when(s > -0.12, "hold").when(s > -0.35, "sell").otherwise("strong_sell")
    sure = F.least(F.lit(1.0), F.abs(s) / 0.6)
    sure = F.when(F.col("label") == "noise", sure * 0.7).when(F.col("label") == "structure", F.least(F.lit(1.0), sure * 1.15)).otherwise(sure)
    sure = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure * (0.5 + 0.5 * F.coalesce("share", F.lit(0.0))))), 3)
    strength = F.when(F.col("conviction") >= 0.66, "strong").when(F.col("conviction") >= 0.33, "normal").otherwise("weak")
    return x.withColumn("conviction", sure).select("symbol", F.round("edge", 4).alias("edge"), F.round("gap", 4).alias("gap"), F.round(s, 4).alias("score"), action.alias("action"), "conviction", strength.alias("strength"))
