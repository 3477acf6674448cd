"""The forecast stack against a plain NumPy version that fits rows, not sums."""

import math

import numpy as np
import pandas as pd
import pytest
from statistics import NormalDist

from quantloom.operators import stack as S

CONFIG = S.StackConfig(horizons=(1, 3), least_months=24, least_rows=120, draws=300)


def planted(spark, signal, seed, names=30, months=120, holes=False):
    """A monthly panel whose first feature leads the target with a strength of ``signal``; the others are noise."""
    rng = np.random.default_rng(seed)
    when = pd.date_range("2008-01-01", periods=months, freq="MS").date
    rows = []
    for s in range(names):
        mom, rev = rng.normal(size=months), rng.normal(size=months)
        flags = rng.integers(0, 2, (2, months)).astype(float)
        for i in range(months):
            t = [float(signal * mom[i] * 0.01 + 0.01 * rng.normal()) if i + h < months else None for h in (1, 3)]
            hole = holes and rng.random() < 0.05
            rows.append((f"S{s:02d}", when[i], float(mom[i]), None if hole else float(rev[i]), None, None, float(flags[0][i]), float(flags[1][i]), *t))
    schema = "symbol string, month date, mom_12_1 double, rev_1m double, quality double, value double, vol_dummy double, trend_dummy double, target_h1 double, target_h3 double"
    return spark.createDataFrame(rows, schema)


def ridge(x, y, lam):
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 1e-12, sd, 1.0)
    z = (x - mean) / sd
    b = np.linalg.solve(z.T @ z + lam * np.eye(x.shape[1]), z.T @ (y - y.mean())) / sd
    return b, y.mean() - b @ mean


def penalty(x, y, year, grid):
    if len(set(year)) < 2:
        return grid[len(grid) // 2]
    best = None
    for lam in grid:
        total, used = 0.0, 0
        for held in sorted(set(year)):
            own = year == held
            if (~own).sum() < max(x.shape[1] + 2, 20):
                continue
            b, c = ridge(x[~own], y[~own], lam)
            total, used = total + ((y[own] - x[own] @ b - c) ** 2).sum(), used + 1
        if used and (best is None or total < best[0]):
            best = (total, lam)
    return best[1] if best else grid[len(grid) // 2]


def walk(z, cols, h, config):
    x = z.dropna(subset=[f"target_h{h}", *cols])
    i = np.array([d.year * 12 + d.month - 1 for d in x["month"]])
    a, y, out = x[cols].to_numpy(), x[f"target_h{h}"].to_numpy(), []
    for year in sorted(set(i // 12)):
        train = i + h <= i[i // 12 == year].min() - config.embargo
        if train.sum() < config.least_rows or len(set(i[train])) < config.least_months:
            continue
        b, c = ridge(a[train], y[train], penalty(a[train], y[train], i[train] // 12, config.penalties))
        for month in sorted(set(i[i // 12 == year])):
            own = i == month
            if own.sum() >= config.least_names:
                out.append(pd.DataFrame({"i": month, "symbol": x["symbol"][own], "pred": a[own] @ b + c, "actual": y[own]}))
    return pd.concat(out)


def monthly(oos, quintile=0.2):
    ic = oos.groupby("i").apply(lambda g: np.corrcoef(g.pred.rank(), g.actual.rank())[0, 1], include_groups=False)

    def spread(g):
        g = g.sort_values(["pred", "symbol"])
        k = max(1, int(len(g) * quintile))
        return g.actual.tail(k).mean() - g.actual.head(k).mean()

    return ic.to_numpy(), oos.groupby("i").apply(spread, include_groups=False).to_numpy()


def plain(panel, config, features):
    z = panel.copy()
    for f in features:
        g = z.groupby("month")[f]
        sd = g.transform("std")
        z[f] = ((z[f] - g.transform("mean")) / sd.where(sd > 1e-12)).where(sd > 1e-12, 0.0)
    sharpe = lambda x: x.mean() / x.std(ddof=1)
    trials, votes, ablations = [], dict.fromkeys(features, 0), {}
    for h in config.horizons:
        ic, ls = monthly(walk(z, features, h, config))
        trials.append(sharpe(ls))
        for f in features:
            less, ls = monthly(walk(z, [x for x in features if x != f], h, config))
            trials.append(sharpe(ls))
            ablations[h, f] = (ic.mean(), less.mean())
            votes[f] += 1 if less.mean() > ic.mean() else -1
    kept = [f for f in features if votes[f] <= 0] or features
    finals = {h: walk(z, kept, h, config) for h in config.horizons}
    for h in config.horizons:
        trials.append(sharpe(monthly(finals[h])[1]))
    v, n, inv, gamma = np.var(trials, ddof=1), len(trials), NormalDist().inv_cdf, 0.5772156649015329
    bar = math.sqrt(v) * ((1 - gamma) * inv(1 - 1 / n) + gamma * inv(1 - 1 / (n * math.e)))
    out = {}
    for h, oos in finals.items():
        ic, ls = monthly(oos)
        rng = np.random.default_rng(config.seed + h)
        means = [ic[(rng.integers(0, len(ic), -(-len(ic) // 6))[:, None] + np.arange(6)).ravel()[: len(ic)] % len(ic)].mean() for _ in range(config.draws)]
        s = sharpe(ls)
        q = (ls - ls.mean()) / ls.std()
        z_ = (s - bar) * math.sqrt(len(ls) - 1) / math.sqrt(1 - (q**3).mean() * s + ((q**4).mean() - 1) / 4 * s * s)
        out[h] = (ic.mean(), *np.quantile(means, [0.05, 0.95]), len(ic), len(oos), s, s - bar, NormalDist().cdf(z_), n)
    return z, kept, ablations, finals, out


def check(spark, panel, config, features):
    got = S.stack(panel, config)
    z, kept, ablations, finals, want = plain(panel.toPandas().astype({f: float for f in features}), config, features)
    assert got.features == kept and got.trials == next(iter(want.values()))[-1]
    assert {(r.h, r.dropped): (r.ic_full, r.ic_without) for r in got.ablations.collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in ablations.items()}
    for r in got.gates.collect():
        assert (r.oos_ic, r.ci_low, r.ci_high, r.n_test_months, r.n_oos_rows, r.sharpe, r.deflated, r.probability, r.n_trials) == pytest.approx(want[r.h], abs=1e-8)
        assert r.passed == (r.oos_ic > 0.03 and r.ci_low > 0 and r.deflated > 0)
    assert got.published == any(r.passed for r in got.gates.collect())
    parts = {}
    for r in got.contributions.collect():
        parts.setdefault((r.symbol, r.h), {})[r.feature] = r.contribution
    rows = {(r.symbol, r.h): r for r in got.predictions.collect()}
    for h in config.horizons:
        own = z.dropna(subset=[f"target_h{h}", *kept])
        x, y, year = own[kept].to_numpy(), own[f"target_h{h}"].to_numpy(), np.array([d.year for d in own["month"]])
        b, c = ridge(x, y, penalty(x, y, year, config.penalties))
        rest = (finals[h].actual - finals[h].pred).to_numpy()
        for symbol, g in z.dropna(subset=kept).groupby("symbol"):
            f = g.sort_values("month")[kept].iloc[-1].to_numpy(float)
            r = rows[symbol, h]
            assert parts[symbol, h] == pytest.approx(dict(zip(kept, b * f)), abs=1e-9)
            assert r.expected == pytest.approx(b @ f + c, abs=1e-9)
            assert [r.q05, r.q25, r.q50, r.q75, r.q95] == pytest.approx([b @ f + c + np.quantile(rest, q) for q in S.LEVELS], abs=1e-9)
    return got


FOUR = ["mom_12_1", "rev_1m", "vol_dummy", "trend_dummy"]


def test_signal_is_published(spark):
    got = check(spark, planted(spark, 1.0, 3), CONFIG, FOUR)
    assert got.published and "mom_12_1" in got.features and set(got.absent) >= {"quality", "value"}


def test_noise_is_not_published(spark):
    got = check(spark, planted(spark, 0.0, 99, holes=True), CONFIG, FOUR)
    assert not got.published and got.reason.startswith("gates")


def test_thin_and_empty_panels(spark):
    thin = S.stack(planted(spark, 1.0, 1, names=4, months=40), CONFIG)
    assert not thin.published and "thin" in thin.reason and thin.gates.count() == thin.predictions.count() == 0
    none = S.stack(planted(spark, 1.0, 1, names=2, months=20).limit(0), CONFIG)
    assert not none.published and none.reason.startswith("no usable") and none.contributions.count() == 0
