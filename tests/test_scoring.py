"""Setup scores, odds and evidence on planted rows."""

import pytest

from quantloom.operators import evidence as E
from quantloom.operators import scoring as S

SCHEMA = "symbol string, yoy double, qoq double, accelerating boolean, gross_margin double, leverage double, leverage_label string, margin_up boolean, revenue_up boolean, ps double, market_cap double, perf_3m double, perf_6m double, rsi double, ratio_50 double, ratio_high double, industry string"


def test_setup_bands(spark):
    rows = [
        ("best", 0.6, 0.1, True, 60.0, 2.5, "high", True, True, 2.0, 2e9, 0.2, 0.4, 55.0, 1.05, 0.9, "Old"),
        ("blown", 0.6, 0.1, True, 60.0, 2.5, "high", True, True, 2.0, 2e9, 1.5, 2.0, 85.0, 1.4, 1.0, "New"),
        ("falling", -0.1, -0.1, False, 20.0, -0.5, "negative", False, False, 9.0, 1e11, -0.3, -0.2, 30.0, 0.8, 0.4, "Other"),
        ("unknown", *[None] * 16),
        ("softer", 0.3, -0.05, True, 50.0, 1.0, "moderate", None, None, 3.0, None, 0.1, 0.2, 60.0, 1.0, 0.7, "Other"),
    ]
    got = {r.symbol: r for r in S.setup(spark.createDataFrame(rows, SCHEMA), stale=["Old"], hot=["New"]).collect()}
    assert (got["best"].revenue, got["best"].stage, got["best"].advice, got["best"].reclass) == (100.0, "Coiled Spring", "BUY", 80.0)
    assert (got["blown"].technical, got["blown"].stage, got["blown"].advice) == (15.0, "Extended", "AVOID")
    assert got["falling"].revenue == 0.0 and got["falling"].op_leverage == 10.0 and got["falling"].valuation == 0.0
    assert got["unknown"].revenue == got["unknown"].valuation == got["unknown"].technical == got["unknown"].reclass == 50.0
    assert got["softer"].revenue == 65.0
    assert all(0 <= v <= 100 for r in got.values() for v in r[1:8])


def test_odds(spark):
    rows = [("up", 0.01, 0.02, 0.03, 0.04, 0.05), ("mid", -0.2, -0.1, 0.0, 0.1, 0.2), ("down", -0.5, -0.4, -0.3, -0.2, -0.1)]
    got = {r.symbol: r for r in S.odds(spark.createDataFrame(rows, "symbol string, q05 double, q25 double, q50 double, q75 double, q95 double")).collect()}
    assert (got["up"].p_up, got["up"].posture) == (1.0, "odds_favorable") and (got["down"].p_up, got["down"].posture) == (0.0, "odds_unfavorable")
    assert got["mid"].p_up == pytest.approx(0.5) and got["mid"].posture == "balanced"
    assert got["up"].conviction == 0.4  # without a weight the tilt counts for four tenths


def test_price_targets(spark):
    """A quarter of 100 at 40 per cent and 30 of costs, 10 shares, growth of a half, a gap of a fifth."""
    rows = [("a", 100.0, 0.4, 30.0, 10.0, 0.5, 0.2), ("thin", 100.0, 0.02, 1.0, 10.0, None, None), ("none", 100.0, 0.4, 30.0, 0.0, 0.5, 0.2)]
    got = {r.symbol: r for r in S.price_targets(spark.createDataFrame(rows, "symbol string, revenue double, gross_margin double, opex double, shares double, yoy double, gap double")).collect()}
    a = got["a"]
    assert (a.bear, a.base, a.bull) == (round((400 * 0.37 - 120) / 10 * 12, 2), round((600 * 0.4 - 120) / 10 * 20, 2), round((400 * 1.65 * 0.42 - 120) / 10 * 28 * 1.1, 2))
    assert got["thin"].bear is None and got["thin"].base == round((8 - 4) / 10 * 20, 2) and got["none"].bull is None


def test_claims(spark):
    facts = spark.createDataFrame([("rev", 1000.0), ("gm", 0.4)], "key string, value double")
    claims = spark.createDataFrame([(1, "rev", 1004.0), (1, "gm", 0.5), (1, "none", 1.0), (2, "rev", None)], "doc_id int, key string, value double")
    checked = E.verify(claims, facts)
    assert {(r.doc_id, r.key): r.status for r in checked.collect()} == {(1, "rev"): "verified", (1, "gm"): "value_mismatch", (1, "none"): "concept_missing", (2, "rev"): "uncheckable"}
    assert {r.doc_id: r.share for r in E.verified_share(checked).collect()} == {1: 0.5, 2: 1.0}


def test_sections(spark):
    text = "Item 1. Short. Item 2 " + "risk words " * 40 + "Item 3 tail"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "Item 2 x")], "doc_id int, text string")
    got = {r.doc_id: r.section for r in E.longest_between(docs, [r"item 2"], [r"item 3"]).collect()}
    assert got[1].startswith("Item 2 risk") and got[1].endswith("words ") and got[2] is None and got[3] is None
