"""Statistical models, one symbol (or small matrix) at a time as grouped pandas functions.

Sums over rows stay in Spark wherever the model has sufficient statistics; only recursions and small solves run in Python.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import bars as B
from quantloom.operators import cross as X

_N = NormalDist()


def ols(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray | float]:
    """Least squares with intercept: coefficients, standard errors, t, R-squared (plain, adjusted) and residual deviation."""
    a = np.c_[np.ones(len(y)), x]
    inverse = np.linalg.pinv(a.T @ a)
    b = inverse @ a.T @ y
    rest = y - a @ b
    free = max(1, len(y) - a.shape[1])
    sse, sst = float(rest @ rest), float(((y - y.mean()) ** 2).sum())
    se = np.sqrt(np.clip(np.diag(inverse) * sse / free, 0, None))
    r2 = 1 - sse / sst if sst else 0.0
    return {"coef": b, "se": se, "t": np.divide(b, se, out=np.zeros_like(b), where=se > 0), "r2": r2, "adj": 1 - (1 - r2) * (len(y) - 1) / free, "sigma": math.sqrt(sse / free)}


def factor_regression(bars: DataFrame, factors: list[str], window: int = 756) -> DataFrame:
    """Each symbol's returns on those of some factor symbols, over the newest rows that all have; sigma is the residuals' deviation.

    Sums of products are enough for the fit: Spark forms them and each symbol's row of sums is solved.
    """
    r = X.returns(bars)
    f = r.where(F.col("symbol").isin(factors)).groupBy("date").pivot("symbol", factors).agg(F.first("ret")).toDF("date", *(f"f{i}" for i in range(len(factors)))).dropna()
    x = r.where(~F.col("symbol").isin(factors)).join(f, "date")
    x = x.withColumn("age", F.row_number().over(B.newest())).where(F.col("age") <= window)
    k = len(factors)
    cols = [F.lit(1.0), *(F.col(f"f{i}") for i in range(k)), F.col("ret")]
    pairs = [(a, b) for a in range(k + 2) for b in range(a, k + 2)]
    sums = x.groupBy("symbol").agg(F.array(*(F.sum(cols[a] * cols[b]) for a, b in pairs)).alias("sums"), F.count("*").alias("n")).where(F.col("n") >= max(10 * k, 30))

    def run(frames):
        for rows in frames:
            out = []
            for symbol, own, n in rows.itertuples(index=False):
                m = np.zeros((k + 2, k + 2))
                for (a, b), v in zip(pairs, own):
                    m[a, b] = m[b, a] = v
                fit = ols_from_sums(m)
                out += [(symbol, name, c, t, fit["r2"], n, fit["sigma"]) for name, c, t in zip(["alpha", *factors], fit["coef"], fit["t"])]
            yield pd.DataFrame(out, columns=["symbol", "name", "coef", "t", "r2", "n", "sigma"])

    return sums.mapInPandas(run, "symbol string, name string, coef double, t double, r2 double, n int, sigma double")


def ols_from_sums(m: np.ndarray) -> dict[str, np.ndarray | float]:
    """Least squares from the summed products of (1, features, target), centred before they are solved."""
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    c = m[1:, 1:] - n * np.outer(mean, mean)
    inverse = np.linalg.pinv(c[:-1, :-1])
    b = inverse @ c[:-1, -1]
    sse, free = max(float(c[-1, -1] - b @ c[:-1, -1]), 0.0), max(1.0, n - len(m) + 1)
    var = sse / free
    se = np.sqrt(np.clip(np.r_[var / n + mean[:-1] @ inverse @ mean[:-1] * var, np.diag(inverse) * var], 0, None))
    coef = np.r_[mean[-1] - mean[:-1] @ b, b]
    r2 = 1 - sse / c[-1, -1] if c[-1, -1] > 0 else 0.0
    return {"coef": coef, "se": se, "t": np.divide(coef, se, out=np.zeros_like(coef), where=se > 0), "r2": r2, "sigma": math.sqrt(var)}


def ridge(x: np.ndarray, y: np.ndarray, lam: float, weights: np.ndarray | None = None) -> np.ndarray:
    """Ridge on weighted standardised columns; intercept and slopes on the raw scale."""
    w = np.full(len(y), 1 / len(y)) if weights is None else weights / weights.sum()
    mean, ybar = w @ x, float(w @ y)
    sd = np.sqrt(np.maximum(w @ (x - mean) ** 2, 1e-24))
    z = (x - mean) / sd
    b = np.linalg.solve((z * w[:, None]).T @ z * len(y) + lam * np.eye(x.shape[1]), (z * w[:, None]).T @ (y - ybar) * len(y)) / sd
    return np.r_[ybar - mean @ b, b]


def choose_lambda(x: np.ndarray, y: np.ndarray, years: np.ndarray, grid: tuple[float, ...] = (1.0, 3.0, 10.0, 30.0, 100.0)) -> float:
    """The penalty with the least squared error when each calendar year is left out in turn."""
    def error(lam: float) -> float:
        out = 0.0
        for year in np.unique(years):
            own = years == year
            if own.all():
                continue
            b = ridge(x[~own], y[~own], lam)
            out += float(((y[own] - b[0] - x[own] @ b[1:]) ** 2).sum())
        return out

    return min(grid, key=lambda lam: (error(lam), lam))


def exposure(bars: DataFrame, factors: list[str], half_life: float = 252.0) -> DataFrame:
    """Ridge betas of each symbol's returns, recent rows weighing more, the penalty chosen by leaving out years."""
    r = X.returns(bars)
    f = r.where(F.col("symbol").isin(factors)).groupBy("date").pivot("symbol", factors).agg(F.first("ret")).toDF("date", *(f"f{i}" for i in range(len(factors)))).dropna()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        x, y = rows[[f"f{i}" for i in range(len(factors))]].to_numpy(), rows["ret"].to_numpy()
        years = pd.to_datetime(rows["date"]).dt.year.to_numpy()
        lam = choose_lambda(x, y, years) if len(y) >= 60 else 10.0
        b = ridge(x, y, lam, 0.5 ** (np.arange(len(y))[::-1] / half_life))
        return pd.DataFrame({"symbol": rows["symbol"].iloc[0], "factor": factors, "beta": b[1:], "lambda": lam})

    return r.where(~F.col("symbol").isin(factors)).join(f, "date").groupBy("symbol").applyInPandas(run, "symbol string, factor string, beta double, lambda double")


def pca(bars: DataFrame, symbols: list[str], components: int = 3) -> DataFrame:
    """Variance shares and loadings of standardised returns, from their correlation matrix (summed in Spark, solved on the driver: its size is the number of symbols asked for)."""
    if len(symbols) > 2000:
        raise ValueError("the driver solves the matrix of at most 2,000 symbols")
    r = X.returns(bars.where(F.col("symbol").isin(symbols)))
    c = np.eye(len(symbols))
    at = {s: i for i, s in enumerate(symbols)}
    for a, b, v in X.correlations(r).select("a", "b", "corr").collect():
        if v is not None:
            c[at[a], at[b]] = c[at[b], at[a]] = v
    value, vector = np.linalg.eigh(c)
    order = np.argsort(-value)[:components]
    rows = []
    for k, i in enumerate(order):
        v = vector[:, i] * np.sign(vector[np.argmax(np.abs(vector[:, i])), i])
        rows += [(k + 1, float(value[i] / len(symbols)), s, float(x)) for s, x in zip(symbols, v)]
    return bars.sparkSession.createDataFrame(rows, "component int, share double, symbol string, loading double")


def spectral_modes(bars: DataFrame, top: int = 5, least: float = 10.0, most: float | None = None) -> DataFrame:
    """Strongest cycles of the detrended log price of each symbol: period, amplitude, phase and share of all power but the mean's.

    Periods below ``least`` rows or above ``most`` (by default half the history) are left out; a history of fewer than twice
    ``least`` rows has none.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y = np.log(rows.sort_values("date")["close"].to_numpy())
        i = np.arange(len(y))
        if len(y) < 2 * max(least, 2):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in {"symbol": "object", "rank": "int32", "period": "float64", "amplitude": "float64", "phase": "float64", "share": "float64"}.items()})
        f = np.fft.rfft(y - np.polyval(np.polyfit(i, y, 1), i))
        period = np.r_[np.inf, len(y) / np.arange(1, len(f))]
        power = np.abs(f) ** 2
        inside = (period >= least) & (period <= (len(y) / 2 if most is None else most))
        best = np.argsort(-np.where(inside, power, -1.0), kind="stable")[: min(top, int(inside.sum()))]
        return pd.DataFrame({"symbol": rows["symbol"].iloc[0], "rank": np.arange(1, len(best) + 1, dtype="int32"), "period": period[best], "amplitude": 2 * np.abs(f[best]) / len(y), "phase": np.angle(f[best]), "share": power[best] / max(power[1:].sum(), 1e-300)})

    return bars.select("symbol", "date", "close").groupBy("symbol").applyInPandas(run, "symbol string, rank int, period double, amplitude double, phase double, share double")


class Hmm:
    """Gaussian hidden Markov model with full covariances, fitted by expectation maximisation from several starts."""

    def __init__(self, states: int = 3, rounds: int = 60, starts: int = 4, seed: int = 7, floor: float = 1e-6):
        self.k, self.rounds, self.starts, self.seed, self.floor = states, rounds, starts, seed, floor

    def _log_density(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), self.k))
        for j in range(self.k):
            c = np.linalg.cholesky(self.cov[j])
            z = np.linalg.solve(c, (x - self.mean[j]).T)
            out[:, j] = -0.5 * (z * z).sum(axis=0) - np.log(np.diag(c)).sum() - x.shape[1] / 2 * math.log(2 * math.pi)
        return out

    def _passes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Filtered and smoothed posteriors, expected transitions and the log likelihood."""
        log = self._log_density(x)
        top = log.max(axis=1, keepdims=True)
        b = np.exp(log - top)
        n = len(x)
        alpha, scale = np.empty((n, self.k)), np.empty(n)
        now = self.start * b[0]
        for t in range(n):
            if t:
                now = (alpha[t - 1] @ self.move) * b[t]
            scale[t] = max(now.sum(), 1e-300)
            alpha[t] = now / scale[t]
        beta = np.ones((n, self.k))
        for t in range(n - 2, -1, -1):
            beta[t] = self.move @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        xi = self.move * (alpha[:-1].T @ (b[1:] * beta[1:] / scale[1:, None]))
        return alpha, gamma, xi, float(np.log(scale).sum() + top.sum())

    def _once(self, x: np.ndarray, rng: np.random.Generator) -> float:
        centre = [x[rng.integers(len(x))]]
        while len(centre) < self.k:
            d = np.min([((x - c) ** 2).sum(axis=1) for c in centre], axis=0)
            centre.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() else x[rng.integers(len(x))])
        self.mean = np.array(centre)
        self.cov = np.array([np.cov(x.T).reshape(x.shape[1], -1) + self.floor * np.eye(x.shape[1])] * self.k)
        self.start = np.full(self.k, 1 / self.k)
        self.move = np.full((self.k, self.k), 0.05 / max(1, self.k - 1)) + np.eye(self.k) * (0.95 - 0.05 / max(1, self.k - 1))
        self.path, last = [], -np.inf
        for _ in range(self.rounds):
            _, g, xi, like = self._passes(x)
            self.path.append(like)
            if like - last < 1e-6 * abs(like):
                break
            last = like
            w = g.sum(axis=0)
            left = xi.sum(axis=1, keepdims=True)
            self.start, self.move = g[0], np.where(left > 0, xi / np.maximum(left, 1e-300), 1 / self.k)
            for j in np.flatnonzero(w > 1e-12):  # a state that no row is in keeps its place
                self.mean[j] = g[:, j] @ x / w[j]
                d = x - self.mean[j]
                self.cov[j] = (g[:, j, None] * d).T @ d / w[j] + self.floor * np.eye(x.shape[1])
        return self.path[-1]

    def fit(self, x: np.ndarray) -> Hmm:
        best = None
        for k in range(self.starts):
            like = self._once(x, np.random.default_rng(self.seed + k))
            if best is None or like > best[0]:
                best = (like, self.mean.copy(), self.cov.copy(), self.start.copy(), self.move.copy(), list(self.path))
        _, self.mean, self.cov, self.start, self.move, self.path = best
        return self

    def filtered(self, x: np.ndarray) -> np.ndarray:
        """Posteriors that look at no later row."""
        return self._passes(x)[0]

    def smoothed(self, x: np.ndarray) -> np.ndarray:
        return self._passes(x)[1]

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        log, move = self._log_density(x), np.log(np.maximum(self.move, 1e-300))
        score, back = np.log(np.maximum(self.start, 1e-300)) + log[0], []
        for t in range(1, len(x)):
            s = score[:, None] + move
            back.append(s.argmax(axis=0))
            score = s.max(axis=0) + log[t]
        out = [int(score.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return np.array(out[::-1])

    def durations(self) -> np.ndarray:
        return 1 / np.maximum(1 - np.diag(self.move), 1e-12)

    def stationary(self) -> np.ndarray:
        p = np.full(self.k, 1 / self.k)
        for _ in range(2000):
            p = p @ self.move
        return p / p.sum()


def regimes(bars: DataFrame, rows: int = 2707) -> DataFrame:
    """Bull, neutral and bear days of each symbol from returns and volatility: smoothed and look-ahead-free labels."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("date").tail(rows)
        r = x["close"].pct_change()
        v = (x["close"] / x["close"].rolling(10).mean() - 1).pow(2).rolling(10).mean()
        ok = (r.notna() & v.notna()).to_numpy()
        if ok.sum() < 120:
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in {"symbol": "object", "date": "object", "state": "object", "filtered": "object", "p": "float64"}.items()})
        z = np.c_[r[ok], np.log(v[ok] + 1e-12)]
        z = (z - z.mean(axis=0)) / np.maximum(z.std(axis=0), 1e-12)
        m = Hmm(rounds=200, starts=4).fit(z)
        order = np.argsort(m.mean[:, 0])
        name = np.empty(3, object)
        name[order] = ["bear", "neutral", "bull"]
        a, g, _, _ = m._passes(z)
        return pd.DataFrame({"symbol": x["symbol"].iloc[0], "date": x["date"][ok], "state": name[g.argmax(axis=1)], "filtered": name[a.argmax(axis=1)], "p": g.max(axis=1)})

    parts = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that small tables' symbols stay spread
    return bars.select("symbol", "date", "close").repartition(parts, "symbol").groupBy("symbol").applyInPandas(run, "symbol string, date date, state string, filtered string, p double")


def mixture_quantile(p: float, parts: list[tuple[float, float, float]]) -> float:
    """Quantile of a mixture of normals (weight, mean, deviation) by bisection."""
    lo = min(m - 12 * s for _, m, s in parts)
    hi = max(m + 12 * s for _, m, s in parts)
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(w * _N.cdf((mid - m) / s) for w, m, s in parts) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def cases(parts: list[tuple[float, float, float]], cut: float = 0.5) -> dict[str, float]:
    """Bear, neutral and bull probabilities and medians of a log-return mixture, cut half a deviation either side of its mean."""
    total = sum(w for w, _, _ in parts)
    parts = [(w / total, m, max(s, 1e-9)) for w, m, s in parts]
    mean = sum(w * m for w, m, _ in parts)
    sd = math.sqrt(max(sum(w * (s * s + m * m) for w, m, s in parts) - mean * mean, 1e-18))
    lo, hi = (sum(w * _N.cdf((x - m) / s) for w, m, s in parts) for x in (mean - cut * sd, mean + cut * sd))
    mid = lambda a, b: math.expm1(mixture_quantile((a + b) / 2, parts))
    return {"mean": math.expm1(mean), "p_bear": lo, "p_neutral": hi - lo, "p_bull": 1 - hi, "bear": mid(0, lo), "neutral": mid(lo, hi), "bull": mid(hi, 1)}


def scenarios(bars: DataFrame, horizons: tuple[int, ...] = (21, 63, 126, 252)) -> DataFrame:
    """Cases of each symbol and horizon from a mixture of its drift, its season and the market's prior."""
    r = X.returns(bars).withColumn("lr", F.log1p("ret"))
    own = r.groupBy("symbol").agg(F.avg("lr").alias("mu"), F.stddev_samp("lr").alias("sd"), F.count("*").alias("n"))
    market = r.agg(F.avg("lr").alias("market"))
    season = B.seasonal_stats(bars).where("years = 10").groupBy("symbol").agg(F.avg("mean").alias("season"))
    x = own.join(season, "symbol", "left").join(F.broadcast(market)).select("*", F.explode(F.array(*map(F.lit, horizons))).alias("h"))  # one row of market

    def run(batches):
        for rows in batches:
            out = []
            for t in rows.itertuples():
                s = t.sd * math.sqrt(t.h) if t.sd and t.sd > 0 else 1e-6
                blocks = t.n / t.h
                trust = min(0.9, blocks / (blocks + 10))
                prior = t.market * t.h
                parts = [(trust, trust * t.mu * t.h + (1 - trust) * prior, s), (1 - trust, prior, s)]
                if t.season is not None and not math.isnan(t.season):
                    parts.append((0.2, math.log1p(max(-0.9, t.season)) * t.h / 21, s))
                out.append({"symbol": t.symbol, "h": t.h, **cases(parts)})
            yield pd.DataFrame(out, columns=["symbol", "h", "mean", "p_bear", "p_neutral", "p_bull", "bear", "neutral", "bull"])

    return x.mapInPandas(run, "symbol string, h int, mean double, p_bear double, p_neutral double, p_bull double, bear double, neutral double, bull double")


def moment_ridge(m: np.ndarray, lam: float) -> np.ndarray:
    """Ridge coefficients on standardised columns, the constant first, from the summed products of rows (1, features, target)."""
    n, mean, y = m[0, 0], m[0, 1:-1] / m[0, 0], m[0, -1] / m[0, 0]
    cov = m[1:-1, 1:-1] - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov) / n, 0))
    sd = np.where(sd > 1e-12, sd, 1.0)
    b = np.linalg.solve(cov / np.outer(sd, sd) + lam * np.eye(len(sd)), (m[1:-1, -1] - n * mean * y) / sd) / sd
    return np.r_[y - mean @ b, b]


def moment_penalty(parts: list[np.ndarray], grid: tuple[float, ...]) -> float:
    """The penalty with the least squared error when each part (a year) is left out in turn; the middle one if none can be."""
    total = sum(parts)
    held = [p for p in parts if total[0, 0] - p[0, 0] >= max(len(total), 20)] if len(parts) > 1 else []
    if not held:
        return grid[len(grid) // 2]

    def error(lam: float) -> float:
        ends = [(np.r_[moment_ridge(total - p, lam), -1.0], p) for p in held]  # the squared error is a form in (b, -1)
        return float(sum(b @ p @ b for b, p in ends))

    return min(grid, key=error)


def walk_forward(panel: DataFrame, features: tuple[str, ...] = ("mom", "reversal", "vol"), horizon: int = 1, embargo: int = 1, least: int = 200, months: int = 36, names: int = 8, grid: tuple[float, ...] = (1.0, 3.0, 10.0, 30.0, 100.0)) -> DataFrame:
    """Out-of-sample predictions: for each test year a standardised ridge on the months whose labels settled before it, with an embargo.

    A year is fitted from ``least`` rows and ``months`` months on, with the penalty of the least squared error when its
    years are left out in turn; months of fewer than ``names`` symbols get no prediction. Sums of products by month are
    enough for all of that, so each year's model comes from at most a few hundred monthly rows.
    """
    i = F.year("month") * 12 + F.month("month") - 1
    cols = ["one", *features, "target"]
    rows = panel.select("symbol", "month", i.alias("i"), "target", F.lit(1.0).alias("one"), *features).dropna(subset=["target", *features])
    pairs_ = [(a, b) for a in range(len(cols)) for b in range(a, len(cols))]
    stats = rows.groupBy("i").agg(F.count("*").alias("n"), *(F.sum(F.col(cols[a]) * F.col(cols[b])).alias(f"p{a}_{b}") for a, b in pairs_)).toPandas().sort_values("i")
    at = stats["i"].to_numpy(dtype=int)
    sums = np.zeros((len(at), len(cols), len(cols)))
    for a, b in pairs_:
        sums[:, a, b] = sums[:, b, a] = stats[f"p{a}_{b}"].to_numpy(dtype=float)

    models = []
    for year in sorted({int(x) // 12 for x in at}):
        own = at + horizon <= at[at // 12 == year].min() - embargo
        if stats["n"].to_numpy()[own].sum() < least or own.sum() < months:
            continue
        lam = moment_penalty([sums[own & (at // 12 == y)].sum(axis=0) for y in np.unique(at[own] // 12)], grid)
        models.append((year, *moment_ridge(sums[own].sum(axis=0), lam).tolist()))
    schema = "year int, " + ", ".join(f"b{k} double" for k in range(len(features) + 1))
    betas = F.broadcast(panel.sparkSession.createDataFrame(models, schema))  # a row a year
    full = F.broadcast(panel.sparkSession.createDataFrame([(int(x),) for x in at[stats["n"].to_numpy() >= names]], "i int"))  # a row a month
    guess = sum((F.col(f"b{k}") * F.col(n) for k, n in enumerate(cols[:-1])), F.lit(0.0))
    return rows.join(full, "i", "left_semi").withColumn("year", F.year("month")).join(betas, "year").select("symbol", "month", "target", guess.alias("prediction"))


def bootstrap_ci(values: np.ndarray, block: int = 6, draws: int = 1000, seed: int = 7) -> tuple[float, float]:
    """Central 90 per cent of the mean by a circular block bootstrap."""
    rng, n = np.random.default_rng(seed), len(values)
    if not n:
        return math.nan, math.nan
    starts = rng.integers(0, n, (draws, -(-n // block)))
    rows = (starts[:, :, None] + np.arange(block)).reshape(draws, -1)[:, :n] % n
    return tuple(np.quantile(values[rows].mean(axis=1), [0.05, 0.95]))


def expected_best_sharpe(trials: int, variance: float) -> float:
    """The greatest Sharpe ratio to be expected of so many trials by chance, given the variance among them."""
    gamma = 0.5772156649015329
    if trials <= 1 or variance <= 0:
        return 0.0
    return math.sqrt(variance) * ((1 - gamma) * _N.inv_cdf(1 - 1 / trials) + gamma * _N.inv_cdf(1 - 1 / (trials * math.e)))


def deflated_sharpe(sharpe: float, n: int, skew: float, kurtosis: float, trials: int, variance: float) -> float:
    """Probability that a Sharpe ratio beats the greatest expected among ``trials`` chance ones."""
    bar = expected_best_sharpe(trials, variance)
    spread = math.sqrt(max(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe, 1e-12))
    return _N.cdf((sharpe - bar) * math.sqrt(max(n - 1, 1)) / spread)


def sharpe_table(bars: DataFrame, trials: int = 25) -> DataFrame:
    """Moments of each symbol's returns and its deflated Sharpe ratio."""
    g = X.returns(bars).groupBy("symbol").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt"), F.count("*").alias("n"))
    g = g.withColumn("sharpe", F.col("m") / F.nullif(F.col("sd"), F.lit(0.0)))
    v = g.agg(F.var_samp("sharpe").alias("v"))
    score = F.pandas_udf(lambda s, n, a, k, v: pd.Series([deflated_sharpe(*x[:4], trials, x[4]) if None not in x and x[0] == x[0] else None for x in zip(s, n, a, k, v)]), "double")
    return g.join(F.broadcast(v)).select("symbol", "sharpe", "skew", "kurt", score("sharpe", "n", "skew", "kurt", "v").alias("dsr"))  # one row of variance


def distribution_fit(bars: DataFrame, least: int = 8) -> DataFrame:
    """Which of normal and Laplace is nearer to each symbol's returns by the Kolmogorov-Smirnov distance."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(rows["ret"].to_numpy())
        n = len(x)
        if n < least:
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in {"symbol": "object", "family": "object", "ks": "float64"}.items()})
        centre, width = np.median(x), max(np.abs(x - np.median(x)).mean(), 1e-12)
        cdfs = {"normal": np.array([_N.cdf(v) for v in (x - x.mean()) / max(x.std(), 1e-12)]), "laplace": np.where(x < centre, 0.5 * np.exp((x - centre) / width), 1 - 0.5 * np.exp(-(x - centre) / width))}
        i = np.arange(1, n + 1)
        ks = {k: float(np.maximum(i / n - c, c - (i - 1) / n).max()) for k, c in cdfs.items()}
        best = min(ks, key=lambda k: (ks[k], k))
        return pd.DataFrame({"symbol": [rows["symbol"].iloc[0]], "family": [best], "ks": [ks[best]]})

    return X.returns(bars).groupBy("symbol").applyInPandas(run, "symbol string, family string, ks double")
