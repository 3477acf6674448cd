"""Values of the queries that SQL can't express, worked out again with NumPy or plain Python."""

import json
import math
import re

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import models as M
from quantloom.operators import workflow as A
from quantloom.queries import catalog
from quantloom.sources import tables

QUERIES = catalog().queries
FACTORS = ["Brand#11", "Brand#12", "Brand#13"]
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def closes(spark):
    x = tables.bars_smooth(spark, SF).select("symbol", "date", "close", "open", "high", "low", "volume").toPandas()
    return x.sort_values(["symbol", "date"])


@pytest.fixture(scope="module")
def returns(closes):
    x = closes.assign(ret=closes.groupby("symbol")["close"].pct_change())
    return x.dropna(subset=["ret"])


def test_factor_regressions(spark, returns):
    wide = returns[returns.symbol.isin(FACTORS)].pivot(index="date", columns="symbol", values="ret")[FACTORS].dropna()
    got = {(r.symbol, r.name): r for r in QUERIES["ols_factor_table"](spark, SF).select("symbol", "name", "coef", "t", "r2", "n").toPandas().itertuples(index=False, name="Row")}
    seen = 0
    for symbol, own in returns[~returns.symbol.isin(FACTORS)].groupby("symbol"):
        both = own.set_index("date")[["ret"]].join(wide, how="inner").sort_index().tail(756)
        if len(both) < 30:
            continue
        y, a = both["ret"].to_numpy(), np.c_[np.ones(len(both)), both[FACTORS].to_numpy()]
        b, *_ = np.linalg.lstsq(a, y, rcond=None)
        rest = y - a @ b
        se = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * (rest @ rest) / (len(y) - 4))
        for k, name in enumerate(["alpha", *FACTORS]):
            r = got[symbol, name]
            assert (r.coef, r.t, r.r2) == pytest.approx((b[k], b[k] / se[k], 1 - (rest @ rest) / ((y - y.mean()) ** 2).sum()), abs=2e-6, rel=1e-4) and r.n == len(both)
            seen += 1
    assert seen == len(got) > 50


def test_principal_components(spark, returns):
    got = QUERIES["pca_signals"](spark, SF).toPandas()
    wide = returns.pivot(index="date", columns="symbol", values="ret")
    value, vector = np.linalg.eigh(wide.corr().fillna(0.0).to_numpy())
    order = np.argsort(-value)[: got.component.nunique()]
    for k, i in enumerate(order):
        own = got[got.component == k + 1].set_index("symbol").loading
        assert got[got.component == k + 1].share.iloc[0] == pytest.approx(value[i] / len(value), abs=1e-5)
        assert abs(own.reindex(wide.columns).to_numpy() @ vector[:, i]) == pytest.approx(1.0, abs=1e-3)


def test_spectral_modes(spark, closes):
    got = QUERIES["spectral_modes"](spark, SF).toPandas()
    for symbol, own in closes.groupby("symbol"):
        y = np.log(own["close"].to_numpy())
        t = np.arange(len(y))
        a = np.c_[np.ones(len(y)), t]
        f = np.fft.rfft(y - a @ np.linalg.lstsq(a, y, rcond=None)[0])
        power, k = np.abs(f) ** 2, np.arange(len(f))
        inside = [i for i in k[1:] if 10 <= len(y) / i <= len(y) / 2]
        best = sorted(inside, key=lambda i: -power[i])[:5]
        x = got[got.symbol == symbol].sort_values("rank")
        assert x.period.tolist() == pytest.approx([len(y) / i for i in best], abs=1e-5)
        assert x.share.tolist() == pytest.approx([power[i] / power[1:].sum() for i in best], abs=2e-6)


def test_distribution_fit(spark, returns):
    got = {r.symbol: r for r in QUERIES["distribution_fit"](spark, SF).collect()}
    for symbol, own in returns.groupby("symbol"):
        x = np.sort(own["ret"].to_numpy())
        n, med = len(x), np.median(x)
        b = np.abs(x - med).mean()
        normal = np.array([0.5 * math.erfc(-(v - x.mean()) / x.std() / math.sqrt(2)) for v in x])
        laplace = np.where(x < med, 0.5 * np.exp((x - med) / b), 1 - 0.5 * np.exp(-(x - med) / b))
        far = lambda c: max(np.max(np.arange(1, n + 1) / n - c), np.max(c - np.arange(n) / n))
        ks = {"normal": far(normal), "laplace": far(laplace)}
        assert got[symbol].ks == pytest.approx(min(ks.values()), abs=2e-6) and ks[got[symbol].family] == min(ks.values())


def test_deflated_sharpe(spark, returns):
    from statistics import NormalDist

    got, nd = {r.symbol: r for r in QUERIES["deflated_sharpe"](spark, SF).collect()}, NormalDist()
    rows = {s: x["ret"].to_numpy() for s, x in returns.groupby("symbol")}
    sharpe = {s: x.mean() / x.std(ddof=1) for s, x in rows.items()}
    spread, trials, gamma = np.var(list(sharpe.values()), ddof=1), 25, 0.5772156649015329
    best = math.sqrt(spread) * ((1 - gamma) * nd.inv_cdf(1 - 1 / trials) + gamma * nd.inv_cdf(1 - 1 / (trials * math.e)))
    for s, x in rows.items():
        z = (x - x.mean()) / x.std()
        skew, kurt = (z**3).mean(), (z**4).mean()
        want = nd.cdf((sharpe[s] - best) * math.sqrt(len(x) - 1) / math.sqrt(1 - skew * sharpe[s] + (kurt - 1) / 4 * sharpe[s] ** 2))
        assert got[s].dsr == pytest.approx(want, abs=1e-4), s


def test_compact_numbers(spark, duck):
    got = {r.o_orderkey: r.label for r in QUERIES["compact_numbers"](spark, "/root/testdata/sf0.001").collect()}
    for key, price in duck.execute("SELECT o_orderkey, o_totalprice FROM orders").fetchall():
        v = price * 1000
        unit, name = next((u, n) for u, n in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K"), (1.0, "")) if abs(v) >= u or u == 1.0)
        assert got[key][len(got[key]) - len(name) :] == name and abs(float(got[key].rstrip("TBMK")) - v / unit) <= 0.0500001


def test_cockpit_rank(spark):
    """Score, lane and rank from the parts that the cockpit names."""
    x = A.cockpit(tables.bars_smooth(spark, SF)).toPandas()
    for r in x.itertuples():
        score = 0.65 * r.scan + 0.35 * r.flow_score + A.RECOMMENDATION_POINTS[r.recommendation] + A.STATE_POINTS[r.state] + A.LOCATION_POINTS[r.location]
        score += 10 * r.fresh_long - 14 * r.fresh_short + 30 * r.total_return - 35 * abs(min(r.max_drawdown, 0))
        assert r.score == pytest.approx(score, abs=0.0051)
        assert r.lane == ("Priority" if r.score >= 45 else "Watch" if r.score >= 18 else "Risk" if r.score <= -18 else "Review")
    ordered = x.sort_values(["score", "symbol"], ascending=[False, True])
    assert ordered["rank"].tolist() == list(range(1, len(x) + 1))
    shown = {r.symbol: (r.score, r.lane, r.rank) for r in QUERIES["cockpit_rank"](spark, SF).collect()}
    assert shown == {r.symbol: (r.score, r.lane, r.rank) for r in x.itertuples()}


def test_filing_sections(spark, duck):
    got = {r.doc_id: r.n for r in QUERIES["filing_sections"](spark, "/root/testdata/sf0.001").collect()}
    for doc, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        spans = []
        for m in re.finditer(r"\bthe\b", text or "", re.I):
            end = text.find("\n", m.end())
            spans.append((end if end >= 0 else len(text)) - m.start())
        assert got[doc] == (max(spans) if spans and max(spans) >= 40 else None)


def test_packets_are_json_with_every_section(spark):
    from quantloom.plans import packet

    rows = QUERIES["research_packet"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 25
    for r in rows:
        body = json.loads(r.packet)
        assert set(packet.ROWS) | set(packet.LISTS) | {"errors"} == set(body)
        assert sorted(body["errors"]) == sorted(k for k, v in body.items() if v is None)


def test_scenario_probabilities_and_order(spark):
    for r in QUERIES["scenario_mixture"](spark, "/root/testdata/sf0.001").collect():
        assert r.p_bear + r.p_neutral + r.p_bull == pytest.approx(1, abs=1e-5) and r.bear < r.neutral < r.bull


def test_implied_density_quantiles(spark):
    rows = QUERIES["implied_density"](spark, SF).collect()
    assert all(r.q25 <= r.q50 <= r.q75 and r.n >= 5 for r in rows)
    strikes, vols = np.linspace(60, 180, 61), np.full(61, 0.3)
    grid, _, cdf = __import__("quantloom.operators.options", fromlist=["density"]).density(strikes, vols, 120.0, 0.5, 0.04)
    q = np.interp([0.25, 0.5, 0.75], cdf, grid)
    s = 0.3 * math.sqrt(0.5)
    want = [120 * math.exp((0.04 - 0.045) * 0.5 + z * s) for z in (-0.67449, 0.0, 0.67449)]
    assert q == pytest.approx(want, rel=0.02)  # a flat smile gives back the lognormal


def test_exposure_is_a_weighted_ridge(spark, returns):
    got = QUERIES["ridge_exposure"](spark, SF).toPandas()
    wide = returns[returns.symbol.isin(FACTORS)].pivot(index="date", columns="symbol", values="ret")[FACTORS].dropna()
    symbol = got.symbol.iloc[0]
    both = returns[returns.symbol == symbol].set_index("date")[["ret"]].join(wide, how="inner").sort_index()
    own = got[got.symbol == symbol].set_index("factor")
    x, y = both[FACTORS].to_numpy(), both["ret"].to_numpy()
    w = 0.5 ** (np.arange(len(y))[::-1] / 252.0)
    w /= w.sum()
    mean = w @ x
    sd = np.sqrt(w @ (x - mean) ** 2)
    z = (x - mean) / sd
    lam = own["lambda"].iloc[0]
    b = np.linalg.solve(z.T @ (z * w[:, None]) * len(y) + lam * np.eye(3), z.T @ ((y - w @ y) * w) * len(y)) / sd
    assert own.beta.reindex(FACTORS).tolist() == pytest.approx(b.tolist(), abs=2e-6)
    years = pd.to_datetime(pd.Series(both.index)).dt.year.to_numpy()
    error = lambda g: sum(((y[years == k] - np.c_[np.ones((years == k).sum()), x[years == k]] @ M.ridge(x[years != k], y[years != k], g)) ** 2).sum() for k in np.unique(years))
    assert lam == min((1.0, 3.0, 10.0, 30.0, 100.0), key=error)
