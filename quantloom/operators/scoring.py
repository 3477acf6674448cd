"""Component scores of a setup and its stage, from one row of features per symbol.

Features: yoy, qoq, accelerating, gross_margin (per cent), leverage, leverage_label, margin_up, revenue_up, ps, market_cap,
perf_3m, perf_6m, rsi, ratio_50, ratio_high, industry. A null feature makes its component neutral (50) or leaves out its term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the components.
WEIGHTS = {"revenue": 0.25, "margin": 0.20, "valuation": 0.15, "op_leverage": 0.15, "technical": 0.15, "reclass": 0.10}
NEUTRAL = 50.0
#: ANSI SQL of each component before it is clamped to 0..100.
COMPONENTS = {
    "revenue": """CASE WHEN yoy IS NULL THEN 50.0 ELSE
        CASE WHEN qoq < -0.03 AND (CASE WHEN yoy < 0 THEN 0.0 WHEN NOT accelerating AND yoy < 0.10 THEN 30.0 WHEN yoy < 0.25 THEN 60.0 WHEN yoy < 0.50 THEN CASE WHEN accelerating THEN 80.0 ELSE 65.0 END ELSE CASE WHEN accelerating THEN 100.0 ELSE 80.0 END END) > 30
             THEN greatest(30.0, (CASE WHEN yoy < 0.25 THEN 60.0 WHEN yoy < 0.50 THEN CASE WHEN accelerating THEN 80.0 ELSE 65.0 END ELSE CASE WHEN accelerating THEN 100.0 ELSE 80.0 END END) - 15.0)
             ELSE CASE WHEN yoy < 0 THEN 0.0 WHEN NOT accelerating AND yoy < 0.10 THEN 30.0 WHEN yoy < 0.25 THEN 60.0 WHEN yoy < 0.50 THEN CASE WHEN accelerating THEN 80.0 ELSE 65.0 END ELSE CASE WHEN accelerating THEN 100.0 ELSE 80.0 END END END END""",
    "margin": "CASE WHEN gross_margin IS NULL THEN 30.0 + coalesce(leverage, 0.0) * 20.0 ELSE gross_margin * 1.2 + coalesce(leverage, 0.0) * 25.0 END",
    "valuation": """CASE WHEN ps IS NULL THEN 50.0 ELSE 100.0 - ps * CASE WHEN coalesce(yoy, 0.0) > 0.15 THEN 15.0 ELSE 25.0 END - CASE WHEN ps > 8.0 THEN (ps - 8.0) * 8.0 ELSE 0.0 END
        + CASE WHEN market_cap BETWEEN 5e8 AND 8e9 THEN 10.0 ELSE 0.0 END END""",
    "op_leverage": "CASE leverage_label WHEN 'high' THEN 80.0 WHEN 'moderate' THEN 50.0 WHEN 'low' THEN 25.0 WHEN 'negative' THEN 10.0 ELSE 40.0 END + CASE WHEN margin_up AND revenue_up THEN 20.0 WHEN margin_up AND revenue_up IS NULL THEN 10.0 ELSE 0.0 END",
    "technical": """CASE WHEN perf_3m > 1.0 OR rsi > 80.0 OR ratio_50 > 1.25 THEN 15.0 WHEN perf_3m IS NULL AND perf_6m IS NULL AND rsi IS NULL AND ratio_50 IS NULL AND ratio_high IS NULL THEN 50.0 ELSE 50.0
        + CASE WHEN coalesce(perf_6m, perf_3m) IS NULL THEN 0.0 WHEN coalesce(perf_6m, perf_3m) > 0.80 THEN 6.0 WHEN coalesce(perf_6m, perf_3m) >= 0.05 THEN 18.0 WHEN coalesce(perf_6m, perf_3m) > 0 THEN 8.0 ELSE -12.0 END
        + CASE WHEN rsi IS NULL THEN 0.0 WHEN rsi BETWEEN 45.0 AND 70.0 THEN 14.0 WHEN rsi BETWEEN 35.0 AND 75.0 THEN 4.0 ELSE -8.0 END
        + CASE WHEN ratio_50 IS NULL THEN 0.0 WHEN ratio_50 BETWEEN 0.90 AND 1.18 THEN 10.0 ELSE -6.0 END
        + CASE WHEN ratio_high BETWEEN 0.55 AND 0.95 THEN 8.0 WHEN ratio_high > 0.98 THEN -6.0 ELSE 0.0 END END""",
    "reclass": "CASE WHEN industry IS NULL OR industry = '' THEN 50.0 WHEN stale_industry AND coalesce(yoy, 0.0) > 0.15 THEN 80.0 WHEN hot_industry THEN 30.0 ELSE 50.0 END",
}
STAGE = """CASE WHEN technical < 30 THEN 'Extended' WHEN total >= 75 AND technical >= 50 AND revenue >= 50 THEN 'Coiled Spring' WHEN total >= 60 AND total < 75 AND revenue >= 50 THEN 'Inflecting'
    WHEN total >= 70 AND technical >= 70 THEN 'Renaming Phase' WHEN total >= 60 AND technical BETWEEN 30 AND 70 AND valuation < 75 THEN 'Proof Phase' ELSE 'No Setup' END"""
ADVICE = "CASE stage WHEN 'Coiled Spring' THEN 'BUY' WHEN 'Inflecting' THEN 'BUY SETUP' WHEN 'Proof Phase' THEN 'HOLD' WHEN 'Extended' THEN 'AVOID' ELSE 'WAIT' END"


def setup(features: DataFrame, stale: list[str] = (), hot: list[str] = ()) -> DataFrame:
    """Components (0 to 100), their weighted total, the stage and what it advises; the stage rules go by order."""
    x = features.withColumn("stale_industry", F.col("industry").isin(*stale) if stale else F.lit(False)).withColumn("hot_industry", F.col("industry").isin(*hot) if hot else F.lit(False))
    x = x.select("symbol", *(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.expr(sql))).alias(name) for name, sql in COMPONENTS.items()))
    total = sum((F.col(name) * w for name, w in WEIGHTS.items()), F.lit(0.0))
    x = x.withColumn("total", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 6))
    return x.withColumn("stage", F.expr(STAGE)).withColumn("advice", F.expr(ADVICE))


#: Share of the growth, change of the gross margin and multiple of each scenario.
SCENARIOS = {"bear": (0.0, -0.03, 12.0), "base": (1.0, 0.0, 20.0), "bull": (1.3, 0.02, 28.0)}
#: Horizons in months whose odds give the posture, the most telling first.
HORIZONS = (6, 3, 12, 1)


def price_targets(rows: DataFrame) -> DataFrame:
    """Bear, base and bull prices from a quarter's run rate, to the cent; null where not positive or a figure is missing.

    ``rows`` has revenue, gross_margin (a share), opex and shares of the newest quarter, revenue growth yoy (null: none) and
    the reclassification gap (null: none), which stretches the bull multiple by half of itself.
    """
    out = rows
    for name, (share, margin, multiple) in SCENARIOS.items():
        sales = F.col("revenue") * 4 * (1 + F.coalesce("yoy", F.lit(0.0)) * share)
        gross = F.col("gross_margin") + margin
        stretch = 1 + F.coalesce("gap", F.lit(0.0)) / 2 if name == "bull" else F.lit(1.0)
        price = (sales * gross - F.col("opex") * 4) / F.col("shares") * multiple * stretch
        out = out.withColumn(name, F.when((F.col("shares") > 0) & (gross > 0) & (price > 0), F.round(price, 2)))
    return out


def blend_sources(base: DataFrame, implied: DataFrame, stack: DataFrame | None = None) -> DataFrame:
    """The odds' quantiles by symbol and horizon, and their source.

    A stack that passed its gates (passed; its quantiles are excesses, lifted by industry_q50) comes first, else the plain mean of base
    rates and implied quantiles to six places, else the one of both there is. A set with a null quantile counts as missing.
    """
    names = ("q05", "q25", "q50", "q75", "q95")
    whole = lambda p: F.greatest(*(F.col(f"{p}{q}").isNull().cast("int") for q in names)) == 0
    side = lambda df, p, more=(): df.select("symbol", "h", *(F.col(q).alias(p + q) for q in names), *more)
    x = side(base, "b_", [c for c in ("shrink_w", "industry_q50") if c in base.columns]).join(side(implied, "i_"), ["symbol", "h"], "full")
    has_stack = F.lit(False)
    if stack is not None:
        x = x.join(side(stack, "s_", ["passed"]), ["symbol", "h"], "full")
        has_stack = F.coalesce(F.col("passed"), F.lit(False)) & whole("s_")
    lift = F.coalesce(F.col("industry_q50"), F.lit(0.0)) if "industry_q50" in x.columns else F.lit(0.0)
    pick = lambda q: F.when(has_stack, F.round(F.col(f"s_{q}") + lift, 6) if stack is not None else F.lit(None)).when(whole("b_") & whole("i_"), F.round((F.col(f"b_{q}") + F.col(f"i_{q}")) / 2, 6)).when(whole("b_"), F.col(f"b_{q}")).when(whole("i_"), F.col(f"i_{q}"))
    source = F.when(has_stack, "stack").when(whole("b_") & whole("i_"), "base_rates+implied").when(whole("b_"), "base_rates").when(whole("i_"), "implied")
    return x.select("symbol", "h", *(pick(q).alias(q) for q in names), source.alias("source"), F.col("shrink_w") if "shrink_w" in x.columns else F.lit(None).cast("double").alias("shrink_w"))


def odds(quantiles: DataFrame) -> DataFrame:
    """Chance of a rise from five quantiles (q05 … q95), linear between them; 1 or 0 where all are of one sign.

    posture and conviction follow: the tilt, times 0.4 and 0.6 of the weight shrink_w (a null or missing weight: none).
    """
    knots = [("q05", 0.05), ("q25", 0.25), ("q50", 0.50), ("q75", 0.75), ("q95", 0.95)]
    p = F.when(F.col("q05") > 0, 1.0).when(F.col("q95") < 0, 0.0)
    for (a, pa), (b, pb) in zip(knots, knots[1:]):
        share = F.coalesce((0 - F.col(a)) / F.nullif(F.col(b) - F.col(a), F.lit(0.0)), F.lit(0.0))
        p = p.when((F.col(a) <= 0) & (F.col(b) >= 0), F.round(1 - (pa + (pb - pa) * share), 4))
    x = quantiles.withColumn("p_up", p)
    favorable, unfavorable = (F.col("p_up") >= 0.58) & (F.col("q50") > 0), (F.col("p_up") <= 0.42) & (F.col("q50") < 0)
    x = x.withColumn("posture", F.when(favorable, "odds_favorable").when(unfavorable, "odds_unfavorable").otherwise("balanced"))
    weight = F.coalesce(F.col("shrink_w"), F.lit(0.0)) if "shrink_w" in x.columns else F.lit(0.0)
    tilt = F.coalesce(F.abs(F.col("p_up") - 0.5) * 2, F.lit(0.0))
    return x.withColumn("conviction", F.round(F.least(F.lit(1.0), tilt * (0.4 + 0.6 * weight)), 3))


def posture(odds_: DataFrame) -> DataFrame:
    """One row a symbol: the posture of its first usable horizon (6, 3, 12, then 1 month)."""
    turn = F.array_position(F.array(*map(F.lit, HORIZONS)), F.col("h"))
    return odds_.where("q50 is not null").groupBy("symbol").agg(*(F.min_by(c, turn).alias(c) for c in ("h", "posture", "conviction", "p_up", "q50")))


def scenario_paths(odds_: DataFrame) -> DataFrame:
    """symbol, h, scenario and its central return: bull, neutral and bear are the 75, 50 and 25 per cent points at 3, 6 and 12 months."""
    return odds_.where(F.col("h").isin(3, 6, 12)).selectExpr("symbol", "h", "source", "stack(3, 'bull', q75, 'neutral', q50, 'bear', q25) AS (scenario, value)")


def top_drivers(exposure: DataFrame, most: int = 2) -> DataFrame:
    """Each symbol's factors of the largest absolute beta, with direction and rank; null betas take no part."""
    w = Window.partitionBy("symbol").orderBy(F.desc(F.abs("beta")), "factor")
    x = exposure.where("beta is not null and not isnan(beta)").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return x.select("symbol", "rank", "factor", F.round("beta", 4).alias("beta"), F.when(F.col("beta") >= 0, "positive").otherwise("negative").alias("direction"))
