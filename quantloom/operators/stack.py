"""The cross-sectional forecast stack: a monthly panel, walk-forward ridges, ablation, gates and predictions.

All models (horizons, years, and every subset of features that ablation asks for) come from one pass over the panel: sums of
products by horizon, month and pattern of missing features. A subset's model is the submatrix of the sums over those patterns
that lack none of its features, so no subset reads the panel again. Predictions, ranks and spreads are Spark's;
the driver holds rows by horizon, subset and month only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import bars as B
from quantloom.operators import cross as X
from quantloom.operators import models as M

#: The candidate features and the levels of the predictive band.
FEATURES = ("mom_12_1", "rev_1m", "quality", "value", "vol_dummy", "trend_dummy")
LEVELS = (0.05, 0.25, 0.50, 0.75, 0.95)


@dataclass(frozen=True)
class StackConfig:
    """Horizons in months; penalties; the least history to fit and the least names to rank; gates; the bootstrap."""

    horizons: tuple[int, ...] = (1, 2, 3, 6, 12, 18)
    penalties: tuple[float, ...] = (1.0, 3.0, 10.0, 30.0, 100.0)
    least_months: int = 36
    least_rows: int = 200
    least_names: int = 8
    embargo: int = 1
    gate: float = 0.03
    draws: int = 1000
    block: int = 6
    quintile: float = 0.2
    seed: int = 7


@dataclass
class Stack:
    """What :func:`stack` returns. ``gates``: a row a horizon. ``ablations``: a row a horizon and feature left out. ``predictions``:
    a row a symbol and horizon. ``contributions``: a row a symbol, horizon and feature. ``features`` were kept, ``absent`` has why others weren't."""

    gates: DataFrame
    ablations: DataFrame
    predictions: DataFrame
    contributions: DataFrame
    features: list[str]
    absent: dict[str, str]
    published: bool
    reason: str | None
    trials: int


def feature_panel(bars: DataFrame, sectors: DataFrame, horizons: tuple[int, ...] = StackConfig.horizons, fundamentals: DataFrame | None = None) -> DataFrame:
    """symbol, month, the candidate features and target_h<h>: the return over h months ahead less that of the symbol's sector series.

    ``sectors`` has symbol and etf (a symbol of ``bars``); symbols without one, or with fewer than 15 months, have no rows. Momentum needs 12
    months before. A target is null where its months, or the sector's closes in them, are missing. ``fundamentals`` (symbol,
    quality, value) is point in time; without it both are null.
    """
    by = B.cells(bars).groupBy("symbol", F.trunc("date", "month").alias("month"))
    m = by.agg(F.max_by("close", "date").alias("close"), F.max_by("cell", F.when(F.col("cell").isNotNull(), F.col("date"))).alias("cell"))
    w = Window.partitionBy("symbol").orderBy("month")
    x = m.withColumn("months", F.count("*").over(Window.partitionBy("symbol"))).where("months >= 15").join(F.broadcast(sectors.where("etf is not null")), "symbol")  # a row a symbol
    level = m.select(F.col("symbol").alias("etf"), "month", F.col("close").alias("level"))
    x = x.join(level, ["etf", "month"], "left")
    ahead = lambda h: F.lead(F.struct("month", "close", "level"), h).over(w)
    # the sector's close in the symbol's own later month: the later row of the symbol carries it
    target = lambda h: F.when((F.col("level") > 0) & ahead(h)["level"].isNotNull(), ahead(h)["close"] / F.col("close") - ahead(h)["level"] / F.col("level"))
    x = x.select(
        "symbol", "month", F.row_number().over(w).alias("place"),
        (F.lag("close", 1).over(w) / F.lag("close", 12).over(w) - 1).alias("mom_12_1"), (F.col("close") / F.lag("close", 1).over(w) - 1).alias("rev_1m"),
        F.col("cell").startswith("highvol").cast("double").alias("vol_dummy"), F.col("cell").endswith("up").cast("double").alias("trend_dummy"),
        *(target(h).alias(f"target_h{h}") for h in horizons),
    ).where("place > 12")
    if fundamentals is None:
        x = x.withColumn("quality", F.lit(None).cast("double")).withColumn("value", F.lit(None).cast("double"))
    else:
        x = x.join(F.broadcast(fundamentals.select("symbol", "quality", "value")), "symbol", "left")  # a row a symbol
    return x.select("symbol", "month", *FEATURES, *(f"target_h{h}" for h in horizons))


def standardised(panel: DataFrame, features: list[str]) -> DataFrame:
    """Each feature less its month's mean, over its sample deviation; zero for all in a month where it does not vary."""
    w = Window.partitionBy("month")
    z = lambda c: F.when(F.stddev_samp(c).over(w) > 1e-12, (F.col(c) - F.avg(c).over(w)) / F.stddev_samp(c).over(w)).otherwise(0.0)
    return panel.select(*(z(c).alias(c) if c in features else F.col(c) for c in panel.columns))


def _long(z: DataFrame, features: list[str], horizons: list[int]) -> DataFrame:
    """A row a symbol, month and horizon with a target; i: the month's number; missing: bits of the features that are null."""
    targets = F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"target_h{h}").cast("double").alias("target")) for h in horizons))
    missing = sum((F.when(F.col(f).isNull(), 1 << k).otherwise(0) for k, f in enumerate(features)), F.lit(0))
    i = F.year("month") * 12 + F.month("month") - 1
    x = z.select("symbol", "month", i.alias("i"), missing.alias("missing"), *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features), targets.alias("t"))
    return x.select("symbol", "month", "i", "missing", *features, F.inline("t")).where("target is not null and not isnan(target)")


class Sums:
    """Sums of products by horizon, month and pattern of missing features; bounded by the calendar, not by the symbols."""

    def __init__(self, rows: DataFrame, features: list[str]):
        cols = ["one", *features, "target"]
        pairs = [(a, b) for a in range(len(cols)) for b in range(a, len(cols))]
        x = rows.withColumn("one", F.lit(1.0)).groupBy("h", "i", "missing")
        got = x.agg(*(F.sum(F.col(cols[a]) * F.col(cols[b])).alias(f"p{a}_{b}") for a, b in pairs)).toPandas().sort_values(["h", "i", "missing"])
        self.h, self.i, self.missing = (got[c].to_numpy(dtype=int) for c in ("h", "i", "missing"))
        self.m = np.zeros((len(got), len(cols), len(cols)))
        for a, b in pairs:
            self.m[:, a, b] = self.m[:, b, a] = got[f"p{a}_{b}"].to_numpy(dtype=float)

    def months(self, h: int, subset: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Months of one horizon and their sums for the features of a subset, over rows that lack none of them."""
        own = np.flatnonzero((self.h == h) & ((self.missing & sum(1 << k for k in subset)) == 0))
        at = [0, *(k + 1 for k in subset), self.m.shape[1] - 1]
        month, place = np.unique(self.i[own], return_inverse=True)
        out = np.zeros((len(month), len(at), len(at)))
        np.add.at(out, place, self.m[np.ix_(own, at, at)])
        return month, out


def _by_year(month: np.ndarray, m: np.ndarray) -> list[np.ndarray]:
    return [m[month // 12 == y].sum(axis=0) for y in np.unique(month // 12)]


def _models(sums: Sums, h: int, name: str, subset: tuple[int, ...], k: int, config: StackConfig) -> list[tuple]:
    """h, subset's name and bits, year, constant and slopes (zero for features left out) of each year that can be fitted."""
    month, m = sums.months(h, subset)
    out = []
    for year in np.unique(month // 12).tolist():
        own = month + h <= month[month // 12 == year].min() - config.embargo
        if own.sum() < config.least_months or m[own, 0, 0].sum() < config.least_rows:
            continue
        b = M.moment_ridge(m[own].sum(axis=0), M.moment_penalty(_by_year(month[own], m[own]), config.penalties))
        full = np.zeros(k)
        full[list(subset)] = b[1:]
        out.append((h, name, sum(1 << j for j in subset), year, float(b[0]), *full.tolist()))
    return out


def _predicted(rows: DataFrame, models: list[tuple], features: list[str], config: StackConfig) -> DataFrame:
    """h, subset, symbol, i, target and prediction out of sample, in months of ``least_names`` symbols at least."""
    schema = "h int, subset string, bits int, year int, constant double" + "".join(f", b{k} double" for k in range(len(features)))
    table = F.broadcast(rows.sparkSession.createDataFrame(models, schema))  # a row a horizon, subset and year
    guess = sum((F.col(f"b{k}") * F.col(f) for k, f in enumerate(features)), F.col("constant"))
    x = rows.withColumn("year", F.floor(F.col("i") / 12).cast("int")).join(table, ["h", "year"]).where("(missing & bits) = 0")
    x = x.select("h", "subset", "symbol", "i", "month", "target", guess.alias("prediction"))
    return x.withColumn("names", F.count("*").over(Window.partitionBy("h", "subset", "i"))).where(F.col("names") >= config.least_names)


def _monthly(predicted: DataFrame, config: StackConfig) -> pd.DataFrame:
    """ic and ls (top less bottom quintile) by horizon, subset and month."""
    by = ["h", "subset", "i"]
    w = Window.partitionBy(*by)
    x = predicted.withColumn("p", X.average_rank(F.col("prediction"), by)).withColumn("q", X.average_rank(F.col("target"), by))
    x = x.withColumn("up", F.row_number().over(w.orderBy("prediction", "symbol"))).withColumn("down", F.col("names") + 1 - F.col("up"))
    k = F.greatest(F.lit(1), F.floor(F.col("names") * config.quintile))
    ls = F.avg(F.when(F.col("down") <= k, F.col("target"))) - F.avg(F.when(F.col("up") <= k, F.col("target")))
    g = x.groupBy(*by).agg(F.when(F.count("*") >= 3, F.corr("p", "q")).alias("ic"), F.when(F.count("*") >= 5, ls).alias("ls"), F.count("*").alias("n"))
    return g.toPandas().sort_values(by).astype({"ic": "float64", "ls": "float64"})


def _sharpe(x: np.ndarray) -> float:
    x = x[np.isfinite(x)]
    sd = x.std(ddof=1) if len(x) > 1 else 0.0
    return float(x.mean() / sd) if sd > 0 else math.nan


def _deflated(x: np.ndarray, trials: int, variance: float) -> tuple[float, float, float]:
    """Sharpe ratio, its excess over the greatest that chance would give in so many trials, and the probability of being above that."""
    x, s = x[np.isfinite(x)], _sharpe(x)
    if math.isnan(s):
        return s, s, s
    z = (x - x.mean()) / x.std()
    skew, kurtosis = float((z**3).mean()) if len(x) > 2 else 0.0, float((z**4).mean()) if len(x) > 3 else 3.0
    bar = M.expected_best_sharpe(trials, variance)
    return s, s - bar, M.deflated_sharpe(s, len(x), skew, kurtosis, trials, variance)


def stack(panel: DataFrame, config: StackConfig = StackConfig(), candidates: tuple[str, ...] = FEATURES) -> Stack:
    """Fit, validate and gate the stack over a panel of :func:`feature_panel`, and predict for every symbol.

    A feature that is missing everywhere or constant is absent. Features are standardised by month. For each horizon the ridge
    with all features and those with one left out are run walk-forward (refit each year on months whose labels ended an embargo
    before it). A feature goes if leaving it out raises the rank correlation in most horizons. The gates of a horizon: mean
    correlation above ``gate``, its bootstrapped lower bound above zero, and a Sharpe ratio of the quintile spread above what the best of
    all trials (full, ablated and final, one frozen set) would reach by chance. It is published if any horizon passes.
    Predictions come from a fit on all labelled rows; the band adds quantiles of the residuals out of sample (ten at least, else the middle alone).
    With too few names or no feature nothing is fitted: no rows, and a reason. The panel is read five times: store it first.
    """
    spark = panel.sparkSession
    horizons = [h for h in config.horizons if f"target_h{h}" in panel.columns]
    present = [f for f in candidates if f in panel.columns]
    spread = panel.agg(F.count_distinct("symbol").alias("names"), *(F.stddev_pop(f).alias(f) for f in present)).first()
    features = [f for f in present if spread[f] is not None and spread[f] > 1e-12]
    absent = {f: "absent or constant across the panel" for f in candidates if f not in features}
    gate_schema = (
        "h int, oos_ic double, ci_low double, ci_high double, n_test_months int, n_oos_rows long, sharpe double, deflated double, probability double, "
        "ic_pass boolean, sharpe_pass boolean, passed boolean, n_trials int, var_trials double"
    )
    empty = lambda schema: spark.createDataFrame([], schema)
    prediction_schema = "symbol string, h int, expected double, " + ", ".join(f"q{int(100 * q):02d} double" for q in LEVELS)
    reason = "no usable features across the walk-forward panel" if not features else f"cross-section too thin: {spread.names} names < min {config.least_names}" if spread.names < config.least_names else None
    if reason:
        return Stack(
            empty(gate_schema), empty("h int, dropped string, ic_full double, ic_without double, raises boolean"), empty(prediction_schema),
            empty("symbol string, h int, feature string, contribution double"), features, absent, False, reason, 0,
        )

    k, z = len(features), standardised(panel, features)
    rows = _long(z, features, horizons)
    sums = Sums(rows, features)
    everything = tuple(range(k))
    subsets = {"": everything} | ({f"-{f}": tuple(j for j in everything if j != n) for n, f in enumerate(features)} if k > 1 else {})
    models = [x for h in horizons for name, own in subsets.items() for x in _models(sums, h, name, own, k, config)]
    first = _monthly(_predicted(rows, models, features, config), config)
    series = lambda table, h, name, what: table.loc[(table.h == h) & (table.subset == name), what].to_numpy()
    mean_of = lambda x: float(x[np.isfinite(x)].mean()) if np.isfinite(x).any() else math.nan
    ablations, votes = [], dict.fromkeys(features, 0)
    for h in horizons:
        whole = mean_of(series(first, h, "", "ic"))
        for f in features if k > 1 else ():
            less = mean_of(series(first, h, f"-{f}", "ic"))
            ablations.append((h, f, *(None if math.isnan(x) else x for x in (whole, less)), bool(less > whole)))
            if not math.isnan(less - whole):
                votes[f] += 1 if less > whole else -1
    kept = [f for f in features if votes[f] <= 0] or features
    absent |= {f: "dropped by ablation" for f in features if f not in kept}

    own = tuple(features.index(f) for f in kept)
    predicted = _predicted(rows, [x for h in horizons for x in _models(sums, h, "kept", own, k, config)], features, config)
    last = _monthly(predicted, config)
    sharpes = np.array([_sharpe(series(t, h, name, "ls")) for t, names in ((first, subsets), (last, ["kept"])) for h in horizons for name in names])
    sharpes = sharpes[np.isfinite(sharpes)]
    trials, variance = max(1, len(sharpes)), float(sharpes.var(ddof=1)) if len(sharpes) > 1 else 0.0
    gates = []
    for h in horizons:
        ic = series(last, h, "kept", "ic")
        ic, ls = ic[np.isfinite(ic)], series(last, h, "kept", "ls")
        mean = mean_of(ic)
        low, high = M.bootstrap_ci(ic, max(1, min(config.block, len(ic))), config.draws, config.seed + h) if len(ic) > 2 else (math.nan, math.nan)
        sharpe, excess, chance = _deflated(ls, trials, variance)
        a, b = bool(mean > config.gate and low > 0), bool(excess > 0)
        shown = [None if math.isnan(x) else float(x) for x in (mean, low, high, sharpe, excess, chance)]
        gates.append((h, *shown[:3], len(ic), int(series(last, h, "kept", "n").sum()), *shown[3:], a, b, a and b, trials, variance))
    published = any(g[11] for g in gates)

    fits = []
    for h in horizons:
        month, m = sums.months(h, own)
        if len(month) and m[:, 0, 0].sum() >= config.least_rows:
            fits.append((h, *M.moment_ridge(m.sum(axis=0), M.moment_penalty(_by_year(month, m), config.penalties)).tolist()))
    table = F.broadcast(spark.createDataFrame(fits, "h int, constant double" + "".join(f", b{j} double" for j in range(len(kept)))))  # a row a horizon
    whole = sum((F.col(f).isNull().cast("int") for f in kept), F.lit(0)) == 0
    newest = z.where(whole).groupBy("symbol").agg(F.max_by(F.struct(*kept), "month").alias("f")).select("symbol", "f.*")
    part = [F.struct(F.lit(f).alias("feature"), (F.col(f"b{j}") * F.col(f)).alias("contribution")) for j, f in enumerate(kept)]
    x = newest.join(table).select("symbol", "h", "constant", F.array(*part).alias("parts"))
    rest = F.col("target") - F.col("prediction")
    band = predicted.groupBy("h").agg(F.count("*").alias("n"), F.percentile(rest, F.array(*map(F.lit, LEVELS))).alias("q"))
    expected = F.col("constant") + F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["contribution"])
    shown = [F.when(F.col("n") >= 10, F.col("expected") + F.col("q")[j]).otherwise(F.col("expected") if q == 0.5 else F.lit(None)).alias(f"q{int(100 * q):02d}") for j, q in enumerate(LEVELS)]
    predictions = x.withColumn("expected", expected).join(F.broadcast(band), "h", "left").select("symbol", "h", "expected", *shown)  # a row a horizon
    return Stack(
        spark.createDataFrame(gates, gate_schema), spark.createDataFrame(ablations, "h int, dropped string, ic_full double, ic_without double, raises boolean"),
        predictions, x.select("symbol", "h", F.inline("parts")), kept, absent, published,
        None if published else "gates not met (OOS IC / deflated Sharpe); engine falls back to base_rates + implied", trials,
    )
