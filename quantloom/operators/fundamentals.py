"""Quarterly statements: which filing counts, trailing sums, growth, forecasts, ratios and labels.

Tables have one row per (symbol, period_end) with fiscal_year and fiscal_quarter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_period():
    return Window.partitionBy("symbol").orderBy("period_end")


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def growth(now: Column, before: Column) -> Column:
    """Change over a positive base only."""
    return F.when(before > 0, now / before - 1)


def first_filed(filings: DataFrame) -> DataFrame:
    """Of a period's filings the earliest dated one; undated ones come last."""
    w = Window.partitionBy("symbol", "period_end").orderBy(F.col("filing_date").asc_nulls_last(), "seq")
    return filings.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "seq")


def latest_filed(facts: DataFrame) -> DataFrame:
    """The latest-filed row of each (symbol, concept, period end)."""
    return facts.groupBy("symbol", "concept", "period_end").agg(F.max_by("value", F.struct("filing_date", "seq")).alias("value"), F.max("filing_date").alias("filing_date"))


def known_at(quarters: DataFrame, when: str) -> DataFrame:
    """Rows filed on or before a date; undated rows go by their period's end."""
    return quarters.where(F.coalesce("filing_date", "period_end") <= F.lit(when).cast("date"))


def fourth_quarters(quarters: DataFrame, years: DataFrame) -> DataFrame:
    """Revenue of the fourth quarter as the year's less the other three, where all three are there."""
    first = quarters.where("fiscal_quarter < 4").groupBy("symbol", "fiscal_year").agg(F.sum("revenue").alias("s"), F.count("revenue").alias("n")).where("n = 3")
    return years.join(first, ["symbol", "fiscal_year"]).select("symbol", "fiscal_year", (F.col("revenue") - F.col("s")).alias("q4"))


def with_derived(quarters: DataFrame) -> DataFrame:
    """Margins and free cash flow (cash from operations less the size of capital spending)."""
    return quarters.select(
        "*", ratio(F.col("gross_profit"), F.col("revenue")).alias("gross_margin"), ratio(F.col("operating_income"), F.col("revenue")).alias("operating_margin"), (F.col("cfo") - F.abs("capex")).alias("fcf")
    )


def trailing_year(quarters: DataFrame, columns: tuple[str, ...] = ("revenue", "operating_income", "fcf")) -> DataFrame:
    """Sums of four quarters, only where all four are there."""
    w = by_period().rowsBetween(-3, 0)
    return with_derived(quarters).select("symbol", "period_end", *(F.when(F.count(c).over(w) == 4, F.sum(c).over(w)).alias(f"ttm_{c}") for c in columns))


def growth_metrics(quarters: DataFrame) -> DataFrame:
    """Year and quarter growth, change of margin, acceleration and its label."""
    w = by_period()
    x = with_derived(quarters).select(
        "symbol", "period_end", growth(F.col("revenue"), F.lag("revenue", 4).over(w)).alias("yoy"), growth(F.col("revenue"), F.lag("revenue", 1).over(w)).alias("qoq"),
        (F.col("gross_margin") - F.lag("gross_margin", 4).over(w)).alias("margin_change"),
    )
    x = x.withColumn("acceleration", F.col("yoy") - F.lag("yoy", 1).over(w))
    label = F.when(F.col("acceleration").isNull(), None).when(F.col("acceleration") > 0.005, "accelerating").when(F.col("acceleration") < -0.005, "decelerating").otherwise("stable")
    return x.withColumn("trend", label)


def operating_leverage(quarters: DataFrame) -> DataFrame:
    """Change of operating income over change of revenue, against four quarters before."""
    w = by_period()
    d = lambda c: F.col(c) - F.lag(c, 4).over(w)
    x = quarters.select("symbol", "period_end", ratio(d("operating_income"), d("revenue")).alias("leverage"))
    return x.withColumn("label", F.expr("CASE WHEN leverage IS NULL THEN NULL WHEN leverage > 2 THEN 'high' WHEN leverage >= 1 THEN 'moderate' WHEN leverage >= 0 THEN 'low' ELSE 'negative' END"))


def moving_averages(quarters: DataFrame) -> DataFrame:
    w = by_period().rowsBetween(-3, 0)
    return quarters.select("symbol", "period_end", F.avg("revenue").over(w).alias("mean"), (F.col("revenue") / F.avg("revenue").over(w) - 1).alias("distance"))


def forecast(quarters: DataFrame, ahead: int = 4) -> DataFrame:
    """Least-squares trend of revenue times the mean seasonal factor of the fiscal quarter, from six quarters on."""
    x = quarters.select("symbol", "fiscal_quarter", "revenue", (F.row_number().over(by_period()) - 1).cast("double").alias("i"))
    line = x.groupBy("symbol").agg(F.regr_slope("revenue", "i").alias("slope"), F.regr_intercept("revenue", "i").alias("base"), F.count("*").alias("n"), F.max_by("fiscal_quarter", "i").alias("last_q")).where("n >= 6")
    season = x.join(line, "symbol").withColumn("f", F.col("revenue") / F.nullif(F.col("base") + F.col("slope") * F.col("i"), F.lit(0.0))).groupBy("symbol", "fiscal_quarter").agg(F.avg("f").alias("factor"))
    steps = line.select("*", F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("step")).withColumn("fiscal_quarter", (F.col("last_q") + F.col("step") - 1) % 4 + 1)
    return steps.join(season, ["symbol", "fiscal_quarter"], "left").select("symbol", "step", (F.greatest(F.lit(0.0), F.col("base") + F.col("slope") * (F.col("n") + F.col("step") - 1)) * F.coalesce("factor", F.lit(1.0))).alias("revenue"))


def value_z(priced: DataFrame) -> DataFrame:
    """Price over trailing revenue at each filing, standardised by the symbol's own history up to then (eight or more)."""
    w = by_period()
    four, hist = w.rowsBetween(-3, 0), w.rowsBetween(Window.unboundedPreceding, 0)
    x = priced.withColumn("ps", F.when(F.count("revenue").over(four) == 4, F.col("close") / F.sum("revenue").over(four) * 1e9))
    return x.select("symbol", "period_end", "ps", F.when(F.count("ps").over(hist) >= 8, ratio(F.col("ps") - F.avg("ps").over(hist), F.stddev_samp("ps").over(hist))).alias("z"))


def stage(quarters: DataFrame) -> DataFrame:
    """Newest stage of each symbol by growth and margins."""
    g = growth_metrics(quarters).join(with_derived(quarters).select("symbol", "period_end", "operating_margin"), ["symbol", "period_end"])
    last = g.groupBy("symbol").agg(*(F.max_by(c, "period_end").alias(c) for c in ("yoy", "acceleration", "margin_change", "operating_margin")))
    rule = """CASE WHEN yoy IS NULL THEN 'unknown' WHEN operating_margin < 0 AND acceleration > 0 THEN 'turnaround' WHEN yoy < -0.02 THEN 'declining'
        WHEN yoy > 0.05 AND acceleration < -0.02 THEN 'peaking' WHEN yoy > 0.05 THEN 'growing' ELSE 'stable' END"""
    return last.select("symbol", "yoy", "acceleration", F.expr(rule).alias("stage"))


def curve_shape(yields: DataFrame, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """Slopes of a yield curve and their label, by date (and symbol, where there are several curves)."""
    at = lambda k: F.max(F.when(F.col("tenor") == k, F.col("value")))
    g = yields.groupBy(*by).agg((at(10) - at(2)).alias("s2s10"), (at(20) - at(5)).alias("s5s20"))
    return g.withColumn("shape", F.expr("CASE WHEN s2s10 IS NULL THEN NULL WHEN s2s10 < -0.05 THEN 'inverted' WHEN s2s10 < 0.25 THEN 'flat' WHEN s2s10 < 1.5 THEN 'normal' ELSE 'steep' END"))


def newest_periods(quarters: DataFrame) -> DataFrame:
    """Quarters with their age: 1 is a symbol's newest."""
    return quarters.withColumn("age", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("period_end"))))


def trajectory(quarters: DataFrame, most: int = 8) -> DataFrame:
    """Over the newest quarters: slopes of yearly revenue growth and of operating margin, and whether each speeds up on average.

    The mean second difference of a row of values is its last step less its first, over a positive number.
    """
    d = with_derived(quarters).withColumn("growth", growth(F.col("revenue"), F.lag("revenue", 4).over(by_period())))
    x = newest_periods(d).where(F.col("age") <= most)
    row = lambda c: F.array_compact(F.expr(f"transform(array_sort(collect_list(named_struct('at', -age, 'v', {c}))), x -> x.v)"))
    line = lambda c: F.when(F.count(c) >= 3, F.regr_slope(F.col(c), -F.col("age").cast("double")))
    g = x.groupBy("symbol").agg(F.count("*").alias("n"), row("growth").alias("g"), row("operating_margin").alias("m"), line("growth").alias("growth_slope"), line("operating_margin").alias("margin_slope"))
    faster = lambda a: F.expr(f"CASE WHEN size({a}) >= 3 THEN {a}[size({a}) - 1] - {a}[size({a}) - 2] - {a}[1] + {a}[0] > 0 END")
    return g.select("symbol", "n", "growth_slope", "margin_slope", faster("g").alias("revenue_accelerates"), faster("m").alias("margin_accelerates"))


def metric_trends(quarters: DataFrame, metrics: tuple[str, ...] = ("revenue", "gross_profit", "operating_income", "cfo")) -> DataFrame:
    """For each metric: newest yearly and quarterly change, and a label from its last two quarterly changes."""
    long = quarters.select("symbol", "period_end", F.expr(f"stack({len(metrics)}, {', '.join(f'{chr(39)}{m}{chr(39)}, {m}' for m in metrics)}) AS (metric, v)")).where("v is not null")
    x = long.withColumn("age", F.row_number().over(Window.partitionBy("symbol", "metric").orderBy(F.desc("period_end")))).where("age <= 5")
    g = x.groupBy("symbol", "metric").agg(*(F.max(F.when(F.col("age") == k, F.col("v"))).alias(f"v{k}") for k in (1, 2, 3, 5)))
    g = g.select("symbol", "metric", F.expr("v1 / nullif(v5, 0.0) - 1").alias("yoy"), F.expr("v1 / nullif(v2, 0.0) - 1").alias("qoq"), F.expr("v2 / nullif(v3, 0.0) - 1").alias("before"))
    label = "CASE WHEN qoq IS NULL OR before IS NULL THEN 'stable' WHEN qoq < 0 AND before < 0 THEN 'declining' WHEN qoq > before + 0.01 THEN 'accelerating' WHEN qoq < before - 0.01 THEN 'decelerating' ELSE 'stable' END"
    return g.select("symbol", "metric", "yoy", "qoq", F.expr(label).alias("trend"))


#: Bands of the spread of recent margins; fewer than two margins are insufficient.
STABILITY = "CASE WHEN {n} < 2 THEN 'insufficient' WHEN {spread} < 0.01 THEN 'very stable' WHEN {spread} < 0.03 THEN 'stable' WHEN {spread} < 0.07 THEN 'moderate' ELSE 'volatile' END"


def momentum_and_margins(quarters: DataFrame) -> DataFrame:
    """Whether quarterly and yearly revenue growth both rose, the yearly change of margins and how stable they are."""
    x = newest_periods(with_derived(quarters)).where("age <= 6")
    at = lambda c, k: F.max(F.when(F.col("age") == k, F.col(c)))
    four = lambda c: F.when(F.col("age") <= 4, F.col(c))
    g = x.groupBy("symbol").agg(
        *(at("revenue", k).alias(f"r{k}") for k in (1, 2, 3, 5, 6)), (at("gross_margin", 1) - at("gross_margin", 5)).alias("gross_change"), (at("operating_margin", 1) - at("operating_margin", 5)).alias("operating_change"),
        *(f(four(c)).alias(f"{k}_{c}") for c in ("gross_margin", "operating_margin") for k, f in (("n", F.count), ("hi", F.max), ("lo", F.min))),
    )
    r = lambda a, b: f"r{a} / nullif(r{b}, 0.0)"
    label = lambda c: F.expr(STABILITY.format(n=f"n_{c}", spread=f"(hi_{c} - lo_{c})"))
    return g.select("symbol", F.expr(f"coalesce({r(1, 2)} > {r(2, 3)} AND {r(1, 5)} > {r(2, 6)}, false)").alias("accelerating"), "gross_change", "operating_change", label("gross_margin").alias("gross_stability"), label("operating_margin").alias("operating_stability"))


def year_sums(quarters: DataFrame, flows: tuple[str, ...], stocks: tuple[str, ...]) -> DataFrame:
    """A row per symbol: sums of the newest four quarters' flows (null unless all four are there) and the newest stocks."""
    x = newest_periods(quarters).where("age <= 4")
    return x.groupBy("symbol").agg(*(F.when(F.count(c) == 4, F.sum(c)).alias(c) for c in flows), *(F.max(F.when(F.col("age") == 1, F.col(c))).alias(c) for c in stocks))


def quality(quarters: DataFrame) -> DataFrame:
    """Gross profit and accruals over assets, net debt over EBITDA and interest cover, of the newest four quarters."""
    x = year_sums(quarters, ("gross_profit", "ebitda", "net_income", "cfo", "operating_income", "interest"), ("total_assets", "total_debt", "cash", "investments"))
    return x.select(
        "symbol", F.expr("gross_profit / nullif(total_assets, 0.0)").alias("gp_to_assets"), F.expr("(net_income - cfo) / nullif(total_assets, 0.0)").alias("accruals"),
        F.expr("(total_debt - coalesce(cash, 0.0) - coalesce(investments, 0.0)) / nullif(ebitda, 0.0)").alias("net_debt_ebitda"), F.expr("operating_income / nullif(abs(interest), 0.0)").alias("interest_cover"),
    )


#: Ratio: its formula over a year's sums, the newest balance sheet, the price, the capitalisation and the enterprise value.
RATIOS = {
    "pe": "price / nullif(eps, 0.0)", "ps": "cap / nullif(revenue, 0.0)", "pb": "cap / nullif(equity, 0.0)", "ev_ebitda": "ev / nullif(ebitda, 0.0)", "ev_ebit": "ev / nullif(operating_income, 0.0)", "ev_sales": "ev / nullif(revenue, 0.0)",
    "debt_to_equity": "total_debt / nullif(equity, 0.0)", "fcf_yield": "fcf / nullif(cap, 0.0)", "nav_per_share": "equity / nullif(shares, 0.0)", "net_cash_per_share": "(cash + coalesce(investments, 0.0) - total_debt) / nullif(shares, 0.0)",
    "gross_margin": "gross_profit / nullif(revenue, 0.0)", "operating_margin": "operating_income / nullif(revenue, 0.0)", "net_margin": "net_income / nullif(revenue, 0.0)",
}


def ratios(quarters: DataFrame, prices: DataFrame, provided: DataFrame) -> DataFrame:
    """Valuation and balance-sheet ratios in long form: symbol, ratio, value and where it comes from.

    A ratio worked out from the statements beats a provided one (symbol, ratio, value). ``prices`` has symbol, price and
    vendor_cap; the capitalisation is price times shares where both are known.
    """
    x = year_sums(quarters, ("eps", "revenue", "gross_profit", "operating_income", "net_income", "ebitda", "fcf"), ("shares", "cash", "investments", "total_debt", "equity")).join(prices, "symbol")
    x = x.withColumn("cap", F.expr("coalesce(price * shares, vendor_cap)")).withColumn("ev", F.expr("cap + total_debt - cash - coalesce(investments, 0.0)"))
    own = x.select("symbol", F.explode(F.map_from_arrays(F.array(*map(F.lit, RATIOS)), F.array(*(F.expr(sql) for sql in RATIOS.values())))).alias("ratio", "own"))
    both = own.join(provided, ["symbol", "ratio"], "full")
    return both.select("symbol", "ratio", F.coalesce("own", "value").alias("value"), F.when(F.col("own").isNotNull(), "statements").when(F.col("value").isNotNull(), "provider").alias("source"))


def merge_statements(income: DataFrame, balance: DataFrame, cash: DataFrame, most: int = 12) -> DataFrame:
    """The newest ``most`` periods of each symbol, the three statements joined on (symbol, period_end), any of them missing.

    Fiscal quarter, fiscal year and filing date come from the first statement that has the period. Statements without a
    period end are left out. Derived figures follow: free cash flow, total debt and margins, null where a part is.
    """
    dims = ("fiscal_quarter", "fiscal_year", "filing_date")
    sides = {"income": income, "balance": balance, "cash-flow": cash}
    out = None
    for k, (name, df) in enumerate(sides.items()):
        own = df.where("period_end is not null").withColumn(f"__{k}", F.lit(name))
        own = own.select(*(F.col(c).alias(f"__{c}_{k}") if c in dims else F.col(c) for c in own.columns))
        out = own if out is None else out.join(own, ["symbol", "period_end"], "full")
    first = lambda c: F.coalesce(*(F.col(f"__{c}_{k}") for k, df in enumerate(sides.values()) if c in df.columns)).alias(c)
    values = [c for c in out.columns if not c.startswith("__") and c not in ("symbol", "period_end")]
    x = out.select("symbol", "period_end", *(first(c) for c in dims), F.array_compact(F.array("__0", "__1", "__2")).alias("statements"), *values)
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    x = x.withColumn("fcf", F.col("cfo") - F.abs("capex"))
    no_debt = F.col("long_term_debt").isNull() & (F.coalesce("debt_current", F.lit(0.0)) == 0)
    x = x.withColumn("total_debt", F.when(~no_debt, F.coalesce("debt_current", F.lit(0.0)) + F.coalesce("long_term_debt", F.lit(0.0))))
    for name, part in (("gross_margin", "gross_profit"), ("operating_margin", "operating_income"), ("net_margin", "net_income"), ("fcf_margin", "fcf")):
        x = x.withColumn(name, ratio(part, "revenue"))
    age = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("period_end")))
    return x.withColumn("age", age).where(F.col("age") <= most)
