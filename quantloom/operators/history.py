"""What a series says of itself: forecasts from settled outcomes only, calibration, signal ranks, spells and recent windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import bars as B

#: Trading days of a year, as the factor of a daily deviation.
YEAR = 252.0**0.5


def forward(bars: DataFrame, horizon: int) -> DataFrame:
    """Row number and the return over the next ``horizon`` rows (null where it isn't known yet)."""
    return bars.withColumn("rn", F.row_number().over(B.by())).withColumn("realized", F.lead("close", horizon).over(B.by()) / F.col("close") - 1)


def settled_means(bars: DataFrame, labels: DataFrame, horizon: int = 21, least_month: int = 3, least_label: int = 20) -> DataFrame:
    """For each row, the mean outcome of earlier rows of the same calendar month, and of the same label (symbol, date, label).

    Only outcomes that were known by then count: frames end ``horizon`` rows before. Labels are carried forward.
    """
    x = forward(bars.join(labels, ["symbol", "date"], "left"), horizon)
    x = x.withColumn("label", F.last("label", ignorenulls=True).over(B.by().rowsBetween(Window.unboundedPreceding, 0)))
    settled = lambda key: Window.partitionBy("symbol", key).orderBy("rn").rangeBetween(Window.unboundedPreceding, -horizon)
    mean = lambda key, least: F.when(F.count("realized").over(settled(key)) >= least, F.avg("realized").over(settled(key)))
    x = x.withColumn("m", F.month("date")).select("symbol", "date", "label", "realized", mean("m", least_month).alias("seasonal"), mean("label", least_label).alias("by_label"))
    return x.where("realized is not null").select("symbol", "date", "seasonal", F.when(F.col("label").isNotNull(), F.col("by_label")).alias("by_label"), "realized")


def settled_lines(bars: DataFrame, signals: DataFrame, horizon: int = 21, least: int = 252) -> DataFrame:
    """For each row, what a line through its signal's earlier (signal, outcome) pairs, all settled, would have forecast.

    ``signals`` has symbol, date and x; a missing x is the last one known.
    """
    x = forward(bars.join(signals, ["symbol", "date"], "left"), horizon)
    x = x.withColumn("x", F.last("x", ignorenulls=True).over(B.by().rowsBetween(Window.unboundedPreceding, 0)))
    w = B.by().rowsBetween(Window.unboundedPreceding, -horizon)
    line = F.regr_intercept("realized", "x").over(w) + F.regr_slope("realized", "x").over(w) * F.col("x")
    return x.select("symbol", "date", F.when(F.regr_count("realized", "x").over(w) >= least, line).alias("predicted"), "realized").where("realized is not null")


def signed_means(panel: DataFrame, signal: str = "mom", target: str = "target", least: int = 3) -> DataFrame:
    """For each month, the mean outcome of earlier months in which the signal had the same sign."""
    w = Window.partitionBy("symbol", "side").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    x = panel.withColumn("side", F.signum(signal).cast("int"))
    return x.select("symbol", "month", "side", F.when(F.count(target).over(w) >= least, F.avg(target).over(w)).alias("predicted"), F.col(target).alias("realized"))


def split_half(forecasts: DataFrame, key: str, least_months: int = 8, least_rows: int = 10) -> DataFrame:
    """Coverage, in the later months, of the band between the quartiles of the earlier months' residuals.

    ``forecasts`` has key, month, predicted and actual. A key with too few months or residuals has null figures.
    """
    months = forecasts.select(key, "month").distinct().withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("month"))).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    x = forecasts.join(months, [key, "month"]).withColumn("early", F.col("i") <= F.floor(F.col("n") / 2) + 1)
    rest = F.when(F.col("early"), F.col("actual") - F.col("predicted"))
    band = x.groupBy(key).agg(F.max("n").alias("months"), F.count(rest).alias("k"), F.percentile(rest, 0.25).alias("lo"), F.percentile(rest, 0.75).alias("hi"))
    inside = F.col("actual").between(F.col("predicted") + F.col("lo"), F.col("predicted") + F.col("hi")).cast("double")
    late = x.where("not early").join(band, key).groupBy(key).agg(F.avg(inside).alias("coverage"), F.count("*").alias("n_late"))
    ok = (F.col("months") >= least_months) & (F.col("k") >= least_rows)
    return band.join(late, key, "left").select(key, "months", F.when(ok, F.col("coverage")).alias("coverage"), F.when(ok, F.col("hi") - F.col("lo")).alias("width"), F.coalesce("n_late", F.lit(0)).alias("n_late"))


def rank_signals(signals: DataFrame, target: DataFrame, windows: tuple[int, ...] = (252, 126, 63), ahead: int = 21, least: int = 20) -> DataFrame:
    """Signals (signal, date, x) by the size of their correlation with a target's returns (date, ret) over the longest window.

    Windows count the dates that the target and any signal share: one row per date, so that table is bounded by the
    calendar. ``forward_corr`` is against the target's return over the next ``ahead`` rows.
    """
    w = Window.orderBy("date")
    base = target.join(signals.select("date").distinct(), "date", "left_semi").withColumn("age", F.row_number().over(Window.orderBy(F.desc("date"))))
    next_ = w.rowsBetween(1, ahead)
    base = base.withColumn("next", F.when(F.count("ret").over(next_) == ahead, F.expm1(F.sum(F.log1p("ret")).over(next_))))
    both = signals.where("x is not null").join(base, "date")
    least = max(3, min(least, *windows))
    r = lambda y, on: F.when(F.count(F.when(on, F.col(y))) >= least, F.corr(F.when(on, F.col("x")), F.when(on, F.col(y))))
    out = both.groupBy("signal").agg(*(r("ret", F.col("age") <= k).alias(f"corr_{k}") for k in windows), r("next", F.lit(True)).alias("forward_corr"), F.count("*").alias("n"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.coalesce(F.abs(f"corr_{max(windows)}"), F.lit(0.0))), "signal")))


def trend_label(series: DataFrame, value: str, n: int = 63, tolerance: float = 1e-4) -> DataFrame:
    """rising, falling or flat: the slope of a symbol's newest values (fewer than five are flat)."""
    x = B.trailing(series.where(F.col(value).isNotNull()), n)
    g = x.groupBy("symbol").agg(F.regr_slope(F.col(value), -F.col("age").cast("double")).alias("slope"), F.count("*").alias("n"))
    label = F.when((F.col("n") < 5) | F.col("slope").isNull(), "flat").when(F.col("slope") > tolerance, "rising").when(F.col("slope") < -tolerance, "falling").otherwise("flat")
    return g.select("symbol", "slope", "n", label.alias("trend"))


def relative_average(bars: DataFrame, target: str, weights: DataFrame, days: int = 50, band: float = 0.02) -> DataFrame:
    """The target's price over its own mean, less the same of an index of weighted symbols; leading or lagging beyond ``band``.

    Only dates on which all the symbols have a price count. The index is one series, bounded by the calendar.
    """
    own = F.col("symbol") == target
    x = bars.select("symbol", "date", "close").join(weights.select("symbol", "weight"), "symbol", "left").where(own | F.col("weight").isNotNull())
    whole = weights.agg((F.count("*") + 1).alias("k"))
    full = x.groupBy("date").agg(F.count("*").alias("k")).join(F.broadcast(whole), "k", "left_semi").select("date")
    x = x.join(full, "date", "left_semi")
    moved = x.withColumn("part", F.coalesce(F.col("weight") * (F.col("close") / F.lag("close").over(B.by()) - 1), F.lit(0.0)))
    day = moved.groupBy("date").agg(F.max(F.when(own, F.col("close"))).alias("close"), F.sum(F.when(~own, F.col("part"))).alias("r"))
    w = Window.orderBy("date")
    index = day.withColumn("level", F.exp(F.sum(F.log1p("r")).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    frame = w.rowsBetween(1 - days, 0)
    last = index.select("date", (F.col("close") / F.avg("close").over(frame)).alias("own"), (F.col("level") / F.avg("level").over(frame)).alias("of_index"), F.count("*").over(frame).alias("n"))
    out = last.where(F.col("n") >= days).groupBy().agg(F.max_by("own", "date").alias("own"), F.max_by("of_index", "date").alias("of_index")).where("own is not null")
    value = F.col("own") - F.col("of_index")
    return out.select(F.lit(target).alias("symbol"), "own", "of_index", value.alias("value"), F.when(value > band, "leading").when(value < -band, "lagging").otherwise("in_line").alias("signal"))


def recent(bars: DataFrame, reference: str, spans: tuple[int, ...] = (20, 60)) -> DataFrame:
    """Return, annualised deviation and return beyond a reference's over the newest sessions, a row per symbol and span."""
    x = B.trailing(B.with_returns(bars), max(spans) + 1).select("symbol", "age", "close", "ret", F.explode(F.array(*map(F.lit, spans))).alias("span")).where("age <= span + 1")
    ret = F.when(F.col("age") <= F.col("span"), F.col("ret"))
    g = x.groupBy("symbol", "span").agg((F.min_by("close", "age") / F.max_by("close", "age") - 1).alias("change"), (F.stddev_samp(ret) * YEAR).alias("vol"), F.count("*").alias("n")).where("n >= 3")
    other = F.broadcast(g.where((F.col("symbol") == reference) & (F.col("n") == F.col("span") + 1)).select("span", F.col("change").alias("ref")))  # one row a span
    return g.join(other, "span", "left").select("symbol", "span", "change", (F.col("change") - F.col("ref")).alias("relative"), F.when(F.col("n") > 3, F.col("vol")).alias("vol"))


def technicals(bars: DataFrame, lengths: tuple[int, ...] = (20, 50, 200)) -> DataFrame:
    """Return over 63 and 126 bars, distance to the moving averages and share of the 252-bar highest close; null where history is short."""
    x = B.trailing(bars, 252)
    at = lambda k: F.max(F.when(F.col("age") == k, F.col("close")))
    mean = lambda k: F.when(F.max("age") >= k, F.avg(F.when(F.col("age") <= k, F.col("close"))))
    return x.groupBy("symbol").agg(
        (at(1) / at(64) - 1).alias("perf_3m"), (at(1) / at(127) - 1).alias("perf_6m"), *((at(1) / mean(k) - 1).alias(f"to_sma_{k}") for k in lengths), (at(1) / F.max("close")).alias("ratio_high")
    )


def setup_label(bars: DataFrame, edge: float = 0.03) -> DataFrame:
    """Momentum, Mean reversion or Balance by the newest close against its mean of 50; with volatility and distance from the POC."""
    x = B.with_returns(bars).withColumn("age", F.row_number().over(B.newest()))
    g = x.groupBy("symbol").agg(F.max("age").alias("n"), F.max(F.when(F.col("age") == 1, F.col("close"))).alias("close"), F.avg(F.when(F.col("age") <= 50, F.col("close"))).alias("mean"), F.stddev_samp("ret").alias("sd"))
    trend = F.when(F.col("n") >= 50, F.col("close") / F.col("mean") - 1).otherwise(0.0)
    g = g.join(B.auction_levels(bars).select("symbol", "poc"), "symbol").select("symbol", trend.alias("trend"), (F.coalesce("sd", F.lit(0.0)) * YEAR).alias("vol"), (F.col("close") / F.nullif("poc", F.lit(0.0)) - 1).alias("from_poc"))
    return g.withColumn("setup", F.when(F.col("trend") > edge, "Momentum").when(F.col("trend") < -edge, "Mean reversion").otherwise("Balance"))


def vol_of_vol(bars: DataFrame, n: int = 252) -> DataFrame:
    """Annualised deviation of the changes of the log of rolling volatility over its newest ``n`` values."""
    v = B.trailing(B.log_volatility(bars).where("vol is not null"), n).withColumn("known", F.count("*").over(Window.partitionBy("symbol")))
    d = v.where("vol > 0").withColumn("d", F.ln("vol") - F.lag(F.ln("vol")).over(B.by()))
    g = d.groupBy("symbol").agg(F.max("known").alias("known"), F.count("d").alias("n"), (F.stddev_samp("d") * YEAR).alias("vv"))
    return g.select("symbol", F.when((F.col("known") >= 40) & (F.col("n") >= 20), F.col("vv")).alias("vol_of_vol"), "n")


def label_months(labels: DataFrame) -> DataFrame:
    """The last label of each month, with its day."""
    return labels.groupBy("symbol", F.trunc("date", "month").alias("month")).agg(F.max("date").alias("date"), F.max_by("label", "date").alias("label"))


def label_age(labels: DataFrame) -> DataFrame:
    """The newest label of each symbol and for how many rows it has held."""
    x = labels.withColumn("age", F.row_number().over(B.newest())).withColumn("now", F.first("label").over(B.newest().rowsBetween(Window.unboundedPreceding, 0)))
    g = x.groupBy("symbol").agg(F.max("now").alias("label"), F.count("*").alias("n"), F.min(F.when(~F.col("label").eqNullSafe(F.col("now")), F.col("age"))).alias("other"))
    return g.select("symbol", "label", F.coalesce(F.col("other") - 1, "n").alias("days"))


def seasonal_highlights(stats: DataFrame, top: int = 3) -> DataFrame:
    """The calendar months with the largest mean of ten years (five, where ten are missing)."""
    pick = lambda y: F.max(F.when(F.col("years") == y, F.col("mean")))
    g = stats.groupBy("symbol", "m").agg(F.coalesce(pick(10), pick(5)).alias("mean")).where("mean is not null")
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("mean"), "m"))).where(F.col("rank") <= top)
