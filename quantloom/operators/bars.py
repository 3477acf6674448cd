"""Levels, tables and rolling statistics of daily bars.

Every function takes a long table of (symbol, date, open, high, low, close, volume) and covers all its symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Window names and their rows.
WINDOWS = {"1m": 21, "2m": 42, "3m": 63, "6m": 126, "1y": 252, "2y": 504, "3y": 756, "5y": 1260, "10y": 2520}


def by() -> WindowSpec:
    """A symbol's rows in order of date."""
    return Window.partitionBy("symbol").orderBy("date")


def newest() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy(F.desc("date"))


def last(n: int) -> WindowSpec:
    """The newest ``n`` rows up to each row."""
    return by().rowsBetween(1 - n, 0)


def full(value: Column, n: int, of: str = "close") -> Column:
    """``value`` once a frame of ``n`` rows is full."""
    return F.when(F.count(of).over(last(n)) >= n, value)


def clean(raw: DataFrame) -> DataFrame:
    """Bars with a price missing go, a missing volume is zero, and of a symbol's repeated days the last row stays."""
    ok = raw.select("symbol", F.to_date("date").alias("date"), *(F.expr(f"try_cast({c} AS double)").alias(c) for c in ("open", "high", "low", "close", "volume")), *(["seq"] if "seq" in raw.columns else []))
    ok = ok.dropna(subset=["open", "high", "low", "close"]).fillna({"volume": 0.0})
    order = "seq" if "seq" in raw.columns else "volume"
    return ok.groupBy("symbol", "date").agg(*(F.max_by(c, order).alias(c) for c in ("open", "high", "low", "close", "volume")))


def with_returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("ret", F.col("close") / F.lag("close").over(by()) - 1)


def trailing(bars: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` rows of each symbol; row_number under a limit prunes before the shuffle."""
    return bars.withColumn("age", F.row_number().over(newest())).where(F.col("age") <= n)


def auction_levels(bars: DataFrame, window: int = 22) -> DataFrame:
    """Value area of the 21 bars before the newest: high, low and median close, with the newest close."""
    w = trailing(bars, window)
    past = F.col("age") > 1
    return w.groupBy("symbol").agg(
        F.max(F.when(past, F.col("high"))).alias("vah"), F.min(F.when(past, F.col("low"))).alias("val"), F.percentile(F.when(past, F.col("close")), 0.5).alias("poc"),
        F.max_by("close", "date").alias("close"), F.max("date").alias("date"),
    )


def auction_location(bars: DataFrame) -> DataFrame:
    """Where the newest close is: above, inside or below value, and how far from the point of control."""
    x = auction_levels(bars)
    place = F.when(F.col("close") > F.col("vah"), "above value").when(F.col("close") < F.col("val"), "below value").otherwise("inside value")
    return x.withColumn("location", place).withColumn("poc_distance", F.col("close") / F.col("poc") - 1)


def month_map(bars: DataFrame, years: int = 10) -> DataFrame:
    """Sum of daily percentage changes by year and month over each symbol's last ``years`` years."""
    r = with_returns(bars).withColumn("year", F.year("date")).withColumn("month", F.month("date"))
    top = F.max("year").over(Window.partitionBy("symbol"))
    g = r.groupBy("symbol", "year", "month").agg((F.sum("ret") * 100).alias("pct"))
    return g.withColumn("newest", top).where(F.col("year") > F.col("newest") - years).drop("newest")


def month_ends(bars: DataFrame) -> DataFrame:
    """Close of each completed month and its change; a symbol's newest month counts as incomplete."""
    m = bars.groupBy("symbol", F.trunc("date", "month").alias("month")).agg(F.max_by("close", "date").alias("close"))
    done = m.withColumn("newest", F.max("month").over(Window.partitionBy("symbol"))).where("month < newest").drop("newest")
    return done.withColumn("ret", F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("month")) - 1)


def seasonal_stats(bars: DataFrame, windows: tuple[int, ...] = (1, 2, 5, 10)) -> DataFrame:
    """For each calendar month and window of years: mean, median, count and hit rate of monthly returns."""
    m = month_ends(bars).where("ret is not null").withColumn("newest", F.max(F.year("month")).over(Window.partitionBy("symbol")))
    each = m.select("symbol", F.month("month").alias("m"), F.explode(F.array(*map(F.lit, windows))).alias("years"), F.year("month").alias("y"), "newest", "ret").where("y >= newest - years")
    return each.groupBy("symbol", "m", "years").agg(F.avg("ret").alias("mean"), F.percentile("ret", 0.5).alias("median"), F.count("*").alias("n"), F.avg((F.col("ret") > 0).cast("double")).alias("hit"))


def forward_stats(bars: DataFrame, horizons: tuple[int, ...] = (1, 2, 3, 6, 12, 18)) -> DataFrame:
    """Returns from the close of the month before each calendar month over some months, by month and horizon."""
    m = month_ends(bars).select("symbol", (F.year("month") * 12 + F.month("month") - 1).alias("i"), "close")
    starts = m.select("symbol", F.explode(F.array(*map(F.lit, horizons))).alias("h"), "i", F.col("close").alias("c0"))
    ends = m.select("symbol", F.col("i").alias("j"), F.col("close").alias("c1"))
    r = starts.withColumn("j", F.col("i") + F.col("h")).join(ends, ["symbol", "j"]).withColumn("ret", F.col("c1") / F.col("c0") - 1)
    q = lambda p: F.percentile("ret", p)
    return r.groupBy("symbol", F.expr("(i + 1) % 12 + 1").alias("m"), "h").agg(F.avg("ret").alias("mean"), q(0.5).alias("median"), F.count("*").alias("n"), F.avg((F.col("ret") > 0).cast("double")).alias("hit"), q(0.1).alias("p10"), q(0.9).alias("p90"))


def volatility_table(bars: DataFrame) -> DataFrame:
    """Last price, daily and annual deviation of returns, and the last close's ranges over a week and a month."""
    g = with_returns(bars).groupBy("symbol").agg(F.max_by("close", "date").alias("price"), F.stddev_samp("ret").alias("daily"))
    out = g.withColumn("annual", F.col("daily") * F.sqrt(F.lit(252.0)))
    return out.withColumn("week_range", F.col("price") * F.col("daily") * F.sqrt(F.lit(5.0))).withColumn("month_range", F.col("price") * F.col("daily") * F.sqrt(F.lit(21.0)))


def drawdown(bars: DataFrame) -> DataFrame:
    """Total return, worst drawdown and annual volatility of each close series."""
    d = with_returns(bars).withColumn("dd", F.col("close") / F.max("close").over(by().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return d.groupBy("symbol").agg(
        (F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("total_return"), F.min("dd").alias("max_drawdown"), (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("annual_volatility")
    )


def portfolio(bars: DataFrame, holdings: list[str], benchmark: str, investment: float = 10_000.0) -> DataFrame:
    """Daily value of equal holdings on the first holding's calendar, beside the same money in the benchmark."""
    first = bars.where(F.col("symbol") == holdings[0]).select("date")
    own = bars.where(F.col("symbol").isin(holdings)).join(first, "date", "left_semi")
    units = own.withColumn("c0", F.first("close").over(Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    value = units.groupBy("date").agg(F.sum(investment * F.col("close") / F.col("c0")).alias("portfolio"))
    bench = bars.where(F.col("symbol") == benchmark).select("date", F.col("close").alias("b"))
    both = value.join(bench, "date")
    start = both.agg(F.min_by("b", "date").alias("b0"))
    return both.join(F.broadcast(start)).select("date", "portfolio", (investment * len(holdings) * F.col("b") / F.col("b0")).alias("benchmark"))


def price_extremes(bars: DataFrame) -> DataFrame:
    """252-bar and 21-bar highs and lows."""
    w = trailing(bars, 252)
    month = F.col("age") <= 21
    return w.groupBy("symbol").agg(F.max("high").alias("high_252"), F.min("low").alias("low_252"), F.max(F.when(month, F.col("high"))).alias("high_21"), F.min(F.when(month, F.col("low"))).alias("low_21"))


def performance(bars: DataFrame, spans: tuple[int, ...] = (5, 21, 63, 126, 252, 504)) -> DataFrame:
    """Returns over some bars (from the first bar where history is shorter) and the distance from the 252-bar extremes."""
    w = trailing(bars, max(spans) + 1).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    now = F.max(F.when(F.col("age") == 1, F.col("close")))
    past = lambda k: F.max(F.when(F.col("age") == F.least(F.lit(k + 1), F.col("n")), F.col("close")))
    year = F.col("age") <= 252
    return w.groupBy("symbol").agg(
        *((now / past(k) - 1).alias(f"ret_{k}") for k in spans), (now / F.max(F.when(year, F.col("close"))) - 1).alias("from_high"), (now / F.min(F.when(year, F.col("close"))) - 1).alias("from_low")
    )


def volatility_windows(bars: DataFrame, windows: tuple[int, ...] = (21, 63, 252)) -> DataFrame:
    """Annualised deviation and mean absolute move of returns over the newest rows."""
    r = trailing(with_returns(bars), max(windows))
    own = lambda k: F.when(F.col("age") <= k, F.col("ret"))
    return r.groupBy("symbol").agg(*(F.stddev_samp(own(k)).alias(f"sd{k}") for k in windows), *(F.avg(F.abs(own(k))).alias(f"move_{k}") for k in windows)).select(
        "symbol", *((F.col(f"sd{k}") * F.sqrt(F.lit(252.0))).alias(f"vol_{k}") for k in windows), *(f"move_{k}" for k in windows)
    )


def sma_stack(bars: DataFrame, lengths: tuple[int, ...] = (20, 50, 200)) -> DataFrame:
    return bars.select("symbol", "date", *(full(F.avg("close").over(last(n)), n).alias(f"sma_{n}") for n in lengths))


def rolling_sigma(bars: DataFrame, n: int = 20) -> DataFrame:
    """Population deviation of closes over up to ``n`` rows."""
    return bars.select("symbol", "date", F.stddev_pop("close").over(last(n)).alias("sigma"))


def vwma(bars: DataFrame, n: int = 20) -> DataFrame:
    """Volume-weighted mean of closes over up to ``n`` rows; null where there was no volume."""
    pv, v = F.sum(F.col("close") * F.col("volume")).over(last(n)), F.sum("volume").over(last(n))
    return bars.select("symbol", "date", (pv / F.nullif(v, F.lit(0.0))).alias("vwma"))


def normalized_score(bars: DataFrame, n: int = 100) -> DataFrame:
    """Place of the close between its least and greatest over ``n`` rows, 0 to 100; 50 where flat."""
    lo, hi = F.min("close").over(last(n)), F.max("close").over(last(n))
    return bars.select("symbol", "date", F.coalesce((F.col("close") - lo) / F.nullif(hi - lo, F.lit(0.0)) * 100, F.lit(50.0)).alias("score"))


def bars_since_off(bars: DataFrame, fast: int = 20, slow: int = 50) -> DataFrame:
    """Rows since the fast mean was last not above the slow one; null if it never was."""
    x = bars.select("symbol", "date", (F.avg("close").over(last(fast)) > F.avg("close").over(last(slow))).alias("trend_on"), F.row_number().over(by()).alias("rn"))
    off = F.last(F.when(~F.col("trend_on"), F.col("rn")), ignorenulls=True).over(by().rowsBetween(Window.unboundedPreceding, 0))
    return x.select("symbol", "date", "trend_on", (F.col("rn") - off).alias("since_off"))


def regression_channel(bars: DataFrame) -> DataFrame:
    """Least-squares line of the close over the row number, and a band of one population deviation of what is left."""
    whole = Window.partitionBy("symbol")
    x = bars.withColumn("i", (F.row_number().over(by()) - 1).cast("double"))
    fit = x.withColumn("slope", F.regr_slope("close", "i").over(whole)).withColumn("base", F.regr_intercept("close", "i").over(whole))
    line = fit.withColumn("trend", F.col("base") + F.col("slope") * F.col("i"))
    band = line.withColumn("band", F.stddev_pop(F.col("close") - F.col("trend")).over(whole))
    return band.select("symbol", "date", "trend", (F.col("trend") + F.col("band")).alias("upper"), (F.col("trend") - F.col("band")).alias("lower"))


def regression_direction(bars: DataFrame) -> DataFrame:
    """Slope and direction of each close series; fewer than three rows are flat."""
    x = bars.withColumn("i", (F.row_number().over(by()) - 1).cast("double"))
    g = x.groupBy("symbol").agg(F.regr_slope("close", "i").alias("slope"), F.count("*").alias("n"))
    return g.select("symbol", "n", "slope", F.expr("CASE WHEN n < 3 THEN 'flat' WHEN slope > 0 THEN 'up' WHEN slope < 0 THEN 'down' ELSE 'flat' END").alias("direction"))


def log_volatility(bars: DataFrame, n: int = 21) -> DataFrame:
    """Rolling annualised deviation of log returns, full frames only."""
    x = bars.withColumn("lr", F.ln(F.col("close") / F.lag("close").over(by())))
    return x.select("symbol", "date", "close", full(F.stddev_samp("lr").over(last(n)), n, "lr").alias("sd")).select("symbol", "date", "close", (F.col("sd") * F.sqrt(F.lit(252.0))).alias("vol"))


def volatility_percentile(bars: DataFrame, n: int = 21, least: int = 30) -> DataFrame:
    """Newest rolling volatility, the mean of its history and the share of the history at or below it."""
    v = log_volatility(bars, n).where("vol is not null").withColumn("now", F.last("vol").over(by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    g = v.groupBy("symbol").agg(F.max("now").alias("vol"), F.avg("vol").alias("mean"), F.avg((F.col("vol") <= F.col("now")).cast("double")).alias("pct"), F.count("*").alias("n"))
    return g.select("symbol", "vol", "mean", F.when(F.col("n") >= least, F.col("pct")).alias("pct"))


def cells(bars: DataFrame) -> DataFrame:
    """Two-by-two state: volatility against its rolling median, and 12-month less 1-month return."""
    v = log_volatility(bars)
    med = F.percentile("vol", 0.5).over(last(504))
    x = v.withColumn("med", F.when(F.count("vol").over(last(504)) >= 63, med)).withColumn("trend", F.col("close") / F.lag("close", 252).over(by()) - F.col("close") / F.lag("close", 21).over(by()))
    label = F.concat(F.when(F.col("vol") > F.col("med"), "highvol_").otherwise("lowvol_"), F.when(F.col("trend") > 0, "up").otherwise("down"))
    return x.select("symbol", "date", "close", F.when(F.col("med").isNotNull() & F.col("trend").isNotNull(), label).alias("cell"))


def return_bounds(bars: DataFrame, horizons: tuple[int, ...] = (21, 42, 63, 126, 252)) -> DataFrame:
    """5th and 95th percentile of rolling returns by horizon, with twenty windows at least."""
    ahead = F.array(*(F.struct(F.lit(h).alias("h"), (F.lead("close", h).over(by()) / F.col("close") - 1).alias("r")) for h in horizons))
    each = bars.select("symbol", ahead.alias("ahead")).select("symbol", F.inline("ahead")).where("r is not null")  # one window for all
    return each.groupBy("symbol", "h").agg(F.percentile("r", 0.05).alias("p05"), F.percentile("r", 0.95).alias("p95"), F.count("*").alias("n")).where("n >= 20")


def scanner(bars: DataFrame) -> DataFrame:
    """Scanner score and rank: trend over 50 rows, last change, distance from the 252-bar high, volatility."""
    x = trailing(with_returns(bars), 252)
    now = F.max(F.when(F.col("age") == 1, F.col("close")))
    g = x.groupBy("symbol").agg(
        now.alias("price"), (F.max(F.when(F.col("age") == 1, F.col("ret"))) * 100).alias("change"), F.max("high").alias("high"), (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("vol"),
        (now / F.avg(F.when(F.col("age") <= 50, F.col("close"))) - 1).alias("trend"),
    )
    s = g.withColumn("score", F.round(F.col("trend") * 100 + F.col("change") + (F.col("price") / F.col("high") - 1) * 25 - F.col("vol") * 5, 6))
    return s.select("symbol", "price", "score", F.row_number().over(Window.orderBy(F.desc("score"), "symbol")).alias("rank"))


def decimate(bars: DataFrame, buckets: int = 50) -> DataFrame:
    """Each symbol's closes thinned to the first, the last, and the least and greatest of each bucket."""
    x = bars.select("symbol", "date", "close", F.ntile(buckets).over(by()).alias("b"), F.row_number().over(by()).alias("rn"), F.row_number().over(newest()).alias("age"))
    w = Window.partitionBy("symbol", "b")
    lo, hi = F.row_number().over(w.orderBy("close", "date")), F.row_number().over(w.orderBy(F.desc("close"), "date"))
    return x.withColumn("lo", lo).withColumn("hi", hi).where("lo = 1 or hi = 1 or rn = 1 or age = 1").select("symbol", "date", "close")


def aggregate_k(bars: DataFrame, k: int = 5) -> DataFrame:
    """Every ``k`` consecutive bars merged into one."""
    x = bars.withColumn("g", F.floor((F.row_number().over(by()) - 1) / k))
    return x.groupBy("symbol", "g").agg(F.min("date").alias("date"), F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))


def summary(bars: DataFrame) -> DataFrame:
    """Last price, its change, annual volatility, distance from the 50-row mean (0 with fewer rows), and the 252-row high and low of closes."""
    x = trailing(with_returns(bars), 504)
    at = lambda k: F.max(F.when(F.col("age") == k, F.col("close")))
    year = F.when(F.col("age") <= 252, F.col("close"))
    g = x.groupBy("symbol").agg(at(1).alias("price"), F.coalesce(at(2), at(1)).alias("before"), F.coalesce(F.stddev_samp("ret") * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias("annual"), F.avg(F.when(F.col("age") <= 50, F.col("close"))).alias("mean"), F.count("*").alias("n"), F.max(year).alias("high"), F.min(year).alias("low"))
    change = F.col("price") - F.col("before")
    return g.select("symbol", "price", change.alias("change"), F.coalesce(change / F.nullif(F.col("before"), F.lit(0.0)) * 100, F.lit(0.0)).alias("change_percent"), "annual", F.when(F.col("n") >= 50, F.col("price") / F.col("mean") - 1).otherwise(0.0).alias("trend"), "high", "low")
