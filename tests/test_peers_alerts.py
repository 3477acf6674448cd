"""Sector forecasts on a planted panel, and materiality and scheduled runs of alerts."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import alertruns as R
from quantloom.operators import peers
from quantloom.operators import workflow as A


def panel(spark, months=60, names=12, seed=4):
    """Momentum decides the forward excess return; the newest three months have no label."""
    rng, rows = np.random.default_rng(seed), []
    for i in range(months):
        day = datetime.date(2015 + i // 12, i % 12 + 1, 1)
        for s in range(names):
            mom = float(rng.normal())
            rows.append((f"S{s:02d}", day, mom, float(rng.normal()), float(rng.integers(0, 2)), None if s == 3 and i == months - 1 else 1.0, 0.05 * mom + 0.005 * float(rng.normal()) if i < months - 3 else None))
    return spark.createDataFrame(rows, "symbol string, month date, mom_12_1 double, rev_1m double, vol_dummy double, trend_dummy double, target_h3 double")


def sectors(spark, names=12):
    return spark.createDataFrame([(f"S{s:02d}", "x" if s < 8 else "y") for s in range(names)] + [("none", "z")], "symbol string, sector string")


def plain(x, at, h, cols):
    """The forecast of one sector's month by loops: expected excess return and probabilities by symbol."""
    full = x.dropna(subset=cols)
    known = full.dropna(subset=["target_h3"])
    i = lambda d: d.year * 12 + d.month - 1
    context = known[[i(d) + h <= at for d in known["month"]]]
    y = context["target_h3"].to_numpy()
    bucket = np.searchsorted(np.quantile(y, [0.2, 0.4, 0.6, 0.8]), y, side="left")
    a, out = context[cols].to_numpy(), {}
    for row in full[[i(d) == at for d in full["month"]]].itertuples():
        q = np.array([getattr(row, c) for c in cols])
        p = []
        for k in range(5):
            own = a[bucket == k]
            var = own.var(axis=0) + 0.01 * a.var(axis=0) + 1e-12
            p.append(len(own) / len(a) * math.exp(-0.5 * (((q - own.mean(axis=0)) ** 2) / var + np.log(var)).sum()))
        p = np.array(p) / sum(p)
        out[row.symbol] = (sum(p[k] * y[bucket == k].mean() for k in range(5)), p)
    return out


def test_sector_forecasts_equal_loops(spark):
    x = panel(spark)
    frame, cols = x.toPandas(), list(peers.FEATURES)
    got = {r.symbol: r for r in peers.forecasts(x, sectors(spark)).collect()}
    assert set(got) == {f"S{s:02d}" for s in range(12)} - {"S03"}
    for sector, own in frame.groupby(frame["symbol"].map(lambda s: "x" if int(s[1:]) < 8 else "y")):
        newest = 2019 * 12 + 11
        live, last = plain(own, newest, 3, cols), plain(own, newest - 3, 3, cols)
        order = sorted(live, key=lambda s: (-live[s][0], s))
        for symbol, (expected, p) in live.items():
            r = got[symbol]
            assert r.sector == sector and r.expected == pytest.approx(expected) and [r[f"p_{b}"] for b in peers.BUCKETS] == pytest.approx(list(p))
            assert r["rank"] == order.index(symbol) + 1 and r.bucket == peers.BUCKETS[int(p.argmax())] and r.sure == (p.max() >= 0.55)
            assert r.predicted_last == pytest.approx(last[symbol][0])
            real = own[(own.symbol == symbol) & (own.month == datetime.date(2019, 9, 1))].target_h3.iloc[0]
            assert r.realized_last == pytest.approx(real)
    # momentum decides: the ranking follows it
    at = frame[frame.month == frame.month.max()].set_index("symbol").mom_12_1
    ranked = sorted((s for s in got if got[s].sector == "x"), key=lambda s: got[s]["rank"])
    assert np.corrcoef(range(len(ranked)), [-at[s] for s in ranked])[0, 1] > 0.8


def test_plugged_in_predictor_and_thin_sectors(spark):
    x = panel(spark)
    even = lambda a, y, q: np.ones((len(q), 5))
    rows = peers.forecasts(x, sectors(spark), predictor=even, most=100).collect()
    assert {round(r.confidence, 9) for r in rows} == {0.2} and not any(r.sure for r in rows)
    assert peers.forecasts(x.where("month >= '2019-06-01'"), sectors(spark)).count() == 0
    assert peers.forecasts(x.limit(0), sectors(spark)).count() == 0
    own = peers.projected(peers.forecasts(x, sectors(spark)), "S09").collect()
    assert len(own) == 1 and [p.symbol for p in own[0].peers][own[0]["rank"] - 1] == "S09" and len(own[0].peers) == 4


ALERTS = "symbol string, rank long, lane string, score double, kind string, severity string, category string, id string, title string, message string, action string, volatility_now double"


def alerts(spark):
    rows = [("A", 1, "Priority", 50.0, "priority-setup", "High", "Setup"), ("A", 1, "Priority", 50.0, "ridge-buy-setup", "Medium", "Ridge"), ("B", 2, "Risk", -20.0, "risk-lane", "High", "Risk"), ("C", 3, "Watch", 20.0, "high-volatility", "Medium", "Volatility")]
    return spark.createDataFrame([(*r, f"{r[0].lower()}-{r[4]}", "t", f"m{i}", None, 0.5) for i, r in enumerate(rows)], ALERTS)


def scorer(rows):
    """Urgent for what is grave, minor but unsure for the rest; setups are not answered."""
    return [None if x["category"] == "Setup" else {"probabilities": {"urgent": 0.8, "material": 0.2}, "confidence": 0.9} if x["severity"] == "High" else {"probabilities": {"minor": 1.0}, "confidence": 0.3 if x["category"] == "Ridge" else 0.6} for x in rows]


def test_scores_fail_open_and_are_kept(spark):
    now = datetime.datetime(2024, 1, 1, 12)
    keyed = R.content_key(alerts(spark))
    assert keyed.select("key").distinct().count() == 4
    got = R.score(keyed, scorer, now=now)
    by = {r.id: (r.materiality, r.materiality_score, r.materiality_confidence) for r in R.with_scores(keyed, got).collect()}
    assert by == {"a-priority-setup": (None, None, None), "a-ridge-buy-setup": (None, None, None), "b-risk-lane": ("urgent", pytest.approx((0.8 * 3 + 0.2 * 2) / 3), 0.9), "c-high-volatility": ("minor", pytest.approx(1 / 3), 0.6)}
    left = {r.key.split(":")[0]: (r.until - now).total_seconds() for r in got.collect()}
    assert left == {"a-priority-setup": 60, "a-ridge-buy-setup": 900, "b-risk-lane": 900, "c-high-volatility": 900}

    def broken(rows):
        raise RuntimeError("no connection")

    assert R.score(keyed, broken, now=now).where("level is not null").count() == 0
    kept = spark.createDataFrame(got.collect(), R.SCORES)
    soon = {r.key.split(":")[0]: r.level for r in R.score(keyed, broken, kept, now + datetime.timedelta(minutes=5)).collect()}
    assert soon["b-risk-lane"] == "urgent" and soon["a-priority-setup"] is None and len(soon) == 4  # only the failure was asked again
    late = R.score(keyed, broken, kept, now + datetime.timedelta(minutes=20))
    assert late.where("level is not null").count() == 0 and late.count() == 4
    assert R.score(keyed.limit(0), scorer).count() == 0


def test_levels_of_materiality(spark):
    x = spark.createDataFrame([("a", "noise"), ("b", "minor"), ("c", "material"), ("d", "urgent"), ("e", None), ("f", "odd")], "id string, materiality string")
    kept = lambda least: {r.id for r in A.material(x, least).collect()}
    assert kept(" Material ") == {"c", "d", "e", "f"} and kept("noise") == kept(None) == kept("high") == set("abcdef")


def rules(spark):
    rows = [(1, True, 1, None, ["a ", "B"], 10, 25, 0.45, None, "webhook", "any"), (2, True, 2, datetime.date(2024, 1, 2), ["B", "A"], 1, 25, 0.45, None, "none", None), (3, True, 3, datetime.date(2024, 1, 3), ["A"], 9, 9, 0.4, None, "none", None), (4, False, 4, None, ["A"], 9, 9, 0.4, None, "none", None),
            (5, True, 5, None, [], 9, 2, 0.6, "urgent", "webhook", "high"), (6, True, 6, None, ["C"], 9, 9, 0.6, None, "webhook", "any")]
    return spark.createDataFrame(rows, "rule_id long, active boolean, updated_at long, last_run_date date, tickers array<string>, max_results int, max_alerts int, volatility double, least string, channel string, severity string")


def test_runs_of_due_rules(spark):
    keyed = R.content_key(alerts(spark))
    scored = R.with_scores(keyed, R.score(keyed, scorer))
    got = {r.rule_id: (r.alert_count, r.high_alert_count, r.headline, r.alert_ids, r.delivery) for r in R.runs(rules(spark), scored, "2024-01-03").collect()}
    assert got == {
        1: (3, 2, "2 high-priority alerts", ["a-priority-setup", "b-risk-lane", "a-ridge-buy-setup"], "ready"),
        2: (1, 1, "1 high-priority alert", ["b-risk-lane"], "off"),  # one ticker only
        5: (2, 2, "2 high-priority alerts", ["a-priority-setup", "b-risk-lane"], "ready"),  # urgent or unscored; two at most
        6: (0, 0, "No high-signal alerts", [], "skipped"),  # its threshold is higher
    }
    done = R.runs(rules(spark), scored, "2024-01-03")
    after = {r.rule_id: str(r.last_run_date) for r in R.ran(rules(spark), done).collect()}
    assert after == {1: "2024-01-03", 2: "2024-01-03", 3: "2024-01-03", 4: "None", 5: "2024-01-03", 6: "2024-01-03"}
    assert R.runs(rules(spark).limit(0), scored, "2024-01-03").count() == 0


def test_schedule_writes_each_day_once(spark, tmp_path):
    keyed = R.content_key(alerts(spark)).withColumn("materiality", F.lit(None).cast("string"))
    batch = R.on_schedule(lambda: rules(spark), lambda: keyed, str(tmp_path / "runs"))
    days = spark.createDataFrame([("2024-01-03",), ("2024-01-04",), ("2024-01-03",)], "run_date string").selectExpr("cast(run_date as date) as run_date")
    batch(days, 0)
    batch(days, 0)
    rows = spark.read.parquet(str(tmp_path / "runs"))
    assert rows.count() == rows.select("rule_id", "run_date").distinct().count() == 4 + 5
