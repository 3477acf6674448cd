"""Relations between symbols: betas, correlations, factors, ranks, and the joins they stand on.

Tables stay long, (symbol, date, value). A table of all pairs comes from sums over blocks of dates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import bars as B


def returns(bars: DataFrame) -> DataFrame:
    return B.with_returns(bars).where("ret is not null").select("symbol", "date", "ret")


#: A pair's moments over shared dates: count, means, and sums of squares and products about the means.
_MOMENTS = ("n", "mx", "my", "xx", "yy", "xy")


def tiled(r: DataFrame, size: int) -> DataFrame:
    """The rows once for each pair of tiles (i <= j) that their symbol's tile is in; a tile holds ``size`` symbols in order of name.

    The window that numbers symbols has no partition: a row a symbol.
    """
    names = r.select("symbol").distinct().withColumn("tile", F.floor((F.row_number().over(Window.orderBy("symbol")) - 1) / size).cast("int"))
    names = names.withColumn("tiles", F.max("tile").over(Window.partitionBy()))
    x = r.join(F.broadcast(names), "symbol").withColumn("other", F.explode(F.sequence(F.lit(0), "tiles")))  # a row a symbol
    return x.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other")).drop("tiles", "other")


def gram(r: DataFrame, by: tuple[str, ...] = (), tile: int = 512) -> DataFrame:
    """a, b (a < b), the columns ``by``, and n, mx, my, xx, yy, xy: the pair's moments over the dates that both have.

    Each quarter's returns of two tiles of symbols are one matrix of dates by symbols, from which the moments of the tiles' pairs are taken;
    those of a pair's quarters are merged. A task holds a tile's square of pairs at most, however many symbols there are. Rows grow with
    pairs and quarters, not with pairs and dates.
    """
    keys = ", ".join(f"`{k}` {r.schema[k].dataType.simpleString()}" for k in by)
    schema = "a string, b string, " + (keys + ", " if by else "") + ", ".join(f"{c} double" for c in _MOMENTS)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot_table(index="date", columns="symbol", values="ret", aggfunc="last")
        names, have, x = wide.columns.to_numpy(), wide.notna().to_numpy(), wide.fillna(0.0).to_numpy()
        first = rows.loc[rows["tile"] == key[1], "symbol"].nunique()  # the first tile's symbols come first by name
        out = []
        for i in range(first):  # one symbol against those behind it, or all of the other tile
            start = i + 1 if key[1] == key[2] else first
            both = have[:, i : i + 1] & have[:, start:]
            n = both.sum(axis=0)
            at = np.flatnonzero(n)
            both, n = both[:, at], n[at].astype(float)
            one, others = np.where(both, x[:, i : i + 1], 0.0), np.where(both, x[:, start:][:, at], 0.0)
            mx, my = one.sum(axis=0) / n, others.sum(axis=0) / n
            dx, dy = np.where(both, one - mx, 0.0), np.where(both, others - my, 0.0)
            own = {"a": names[i], "b": names[start:][at]} | dict(zip(by, key[3:]))
            out.append(pd.DataFrame(own | {"n": n, "mx": mx, "my": my, "xx": (dx * dx).sum(axis=0), "yy": (dy * dy).sum(axis=0), "xy": (dx * dy).sum(axis=0)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["a", "b", *by, *_MOMENTS])

    own = tiled(r.where("ret is not null").select("symbol", "date", "ret", *by), tile)
    blocks = own.groupBy(F.trunc("date", "quarter").alias("block"), "i", "j", *by).applyInPandas(run, schema)
    first = F.struct(*(F.lit(0.0).alias(c) for c in _MOMENTS))

    def merged(s: Column, t: Column) -> Column:
        n = s["n"] + t["n"]
        dx, dy, w = t["mx"] - s["mx"], t["my"] - s["my"], s["n"] * t["n"] / n
        parts = (n, s["mx"] + dx * t["n"] / n, s["my"] + dy * t["n"] / n, s["xx"] + t["xx"] + dx * dx * w, s["yy"] + t["yy"] + dy * dy * w, s["xy"] + t["xy"] + dx * dy * w)
        return F.struct(*(v.alias(c) for c, v in zip(_MOMENTS, parts)))

    pairs = blocks.groupBy("a", "b", *by).agg(F.collect_list(F.struct(*_MOMENTS)).alias("m"))  # one entry a quarter
    return pairs.select("a", "b", *by, F.aggregate("m", first, merged).alias("m")).select("a", "b", *by, "m.*")


def covariance() -> Column:
    """Of the moments of :func:`gram`; null with fewer than two dates."""
    return F.expr("xy / nullif(n - 1, 0.0D)")


def correlation() -> Column:
    """Of the moments of :func:`gram`; null with fewer than two dates and where a side is constant."""
    size = F.sqrt(F.col("xx") * F.col("yy"))
    return F.when((F.col("n") >= 2) & (size > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("xy") / size)))  # greatest and least pass over nulls


def against(r: DataFrame, reference: str) -> DataFrame:
    """symbol, date, ret and the reference symbol's return of the same date; one symbol's rows, so the hash table is a calendar."""
    ref = r.where(F.col("symbol") == reference).select("date", F.col("ret").alias("ref"))
    return r.where(F.col("symbol") != reference).join(ref, "date")


def beta_table(bars: DataFrame, reference: str, windows: tuple[int, ...] = (63, 126, 252, 504), least: int = 20) -> DataFrame:
    """Slope, intercept and correlation against a reference over the newest rows both have."""
    x = against(returns(bars), reference).withColumn("age", F.row_number().over(B.newest()))
    each = x.select("symbol", "ret", "ref", "age", F.explode(F.array(*map(F.lit, windows))).alias("window")).where("age <= window")
    g = each.groupBy("symbol", "window").agg(F.regr_slope("ret", "ref").alias("beta"), F.regr_intercept("ret", "ref").alias("alpha"), F.corr("ret", "ref").alias("corr"), F.count("*").alias("n"))
    return g.where(F.col("n") >= least)


def rolling_beta(bars: DataFrame, reference: str, n: int = 63) -> DataFrame:
    x = against(returns(bars), reference)
    w = B.last(n)
    return x.select("symbol", "date", F.when(F.count("*").over(w) >= n, F.covar_samp("ret", "ref").over(w) / F.nullif(F.var_samp("ref").over(w), F.lit(0.0))).alias("beta"))


def gauge_fixed(bars: DataFrame, reference: str) -> DataFrame:
    """Returns less the reference's, standardised by symbol (sample deviation); constant series go."""
    x = against(returns(bars), reference).withColumn("d", F.col("ret") - F.col("ref"))
    w = Window.partitionBy("symbol")
    return x.withColumn("m", F.avg("d").over(w)).withColumn("s", F.stddev_samp("d").over(w)).where("s > 0").select("symbol", "date", ((F.col("d") - F.col("m")) / F.col("s")).alias("ret"))


def correlations(r: DataFrame) -> DataFrame:
    """Correlation, annual covariance and cosine of every pair of return series on shared dates."""
    about = lambda c, x, y: f"({c} + n * {x} * {y})"
    cosine = F.expr(f"{about('xy', 'mx', 'my')} / nullif(sqrt({about('xx', 'mx', 'mx')} * {about('yy', 'my', 'my')}), 0.0D)")
    return gram(r).select("a", "b", correlation().alias("corr"), (covariance() * 252).alias("cov"), cosine.alias("cosine"), F.col("n").cast("long").alias("n"))


def impact_weights(bars: DataFrame, target: str, top: int = 8) -> DataFrame:
    """Squared correlations of the target with the others; the greatest few, scaled to sum to one."""
    x = against(returns(bars), target).groupBy("symbol").agg(F.pow(F.corr("ret", "ref"), 2).alias("r2"))
    best = x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("r2"), "symbol"))).where(F.col("rank") <= top)
    return best.withColumn("weight", F.col("r2") / F.sum("r2").over(Window.partitionBy()))


def momentum(bars: DataFrame, lookback: int = 252, skip: int = 21) -> DataFrame:
    """Close ``skip`` rows ago over the close ``lookback`` rows ago."""
    w = B.by()
    return bars.select("symbol", "date", (F.lag("close", skip).over(w) / F.lag("close", lookback).over(w) - 1).alias("momentum")).where("momentum is not null")


def average_rank(value: Column, by: list[str]) -> Column:
    """Rank from 1, equal values sharing the mean of their places."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def momentum_terciles(bars: DataFrame, lookback: int = 252, skip: int = 21, names: int = 6, dates: int = 60) -> DataFrame:
    """By date: mean return of the top third by momentum (12-1) less that of the bottom third, the momentum factor.

    Lags are of a symbol's own rows. Symbols with fewer than lookback + skip + 40 rows take no part. There is no factor, and
    no row, with fewer than ``names`` symbols or with ``dates`` dates or fewer. Its window has no partition: a row a date.
    """
    long = bars.groupBy("symbol").agg(F.count("*").alias("rows")).where(F.col("rows") >= lookback + skip + 40).select("symbol")
    enough = long.agg(F.count("*").alias("names"))  # one row
    own = bars.join(long, "symbol", "left_semi")
    x = momentum(own, lookback, skip).join(returns(own), ["symbol", "date"])
    x = x.withColumn("pct", average_rank(F.col("momentum"), ["date"]) / F.count("*").over(Window.partitionBy("date")))
    g = x.groupBy("date").agg(F.avg(F.when(F.col("pct") >= 2 / 3, F.col("ret"))).alias("top"), F.avg(F.when(F.col("pct") <= 1 / 3, F.col("ret"))).alias("bottom"), F.count("*").alias("n"))
    factor = g.select("date", (F.col("top") - F.col("bottom")).alias("spread"), "n").where("spread is not null")
    all_ = factor.withColumn("dates", F.count("*").over(Window.partitionBy())).where(F.col("dates") > dates)
    return all_.join(F.broadcast(enough.where(F.col("names") >= names))).select("date", "spread", "n")


def monthly_panel(bars: DataFrame, horizon: int = 1) -> DataFrame:
    """symbol, month, momentum over 11 months, volatility proxy and the forward return of each completed month."""
    w = Window.partitionBy("symbol").orderBy("month")
    m = B.month_ends(bars)
    return m.select(
        "symbol", "month", (F.lag("close", 1).over(w) / F.lag("close", 12).over(w) - 1).alias("mom"), F.col("ret").alias("reversal"),
        F.stddev_samp("ret").over(w.rowsBetween(-5, 0)).alias("vol"), (F.lead("close", horizon).over(w) / F.col("close") - 1).alias("target"),
    ).where("mom is not null and target is not null and vol is not null")


def zscore(panel: DataFrame, columns: tuple[str, ...] = ("mom", "reversal", "vol")) -> DataFrame:
    """Each feature standardised across the symbols of its month (sample deviation)."""
    w = Window.partitionBy("month")
    return panel.select("symbol", "month", *(((F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_samp(c).over(w), F.lit(0.0))).alias(f"z_{c}") for c in columns), "target")


def quintile_spread(panel: DataFrame, by: str = "mom") -> DataFrame:
    """By month: mean target of the top fifth less that of the bottom fifth, with five names at least."""
    w = Window.partitionBy("month")
    x = panel.withColumn("up", F.row_number().over(w.orderBy(by, "symbol"))).withColumn("down", F.row_number().over(w.orderBy(F.desc(by), F.desc("symbol")))).withColumn("n", F.count("*").over(w))
    k = F.floor(F.col("n") / 5)
    return x.where("n >= 5").groupBy("month").agg((F.avg(F.when(F.col("down") <= k, F.col("target"))) - F.avg(F.when(F.col("up") <= k, F.col("target")))).alias("spread"), F.count("*").alias("n"))


def rank_ic(panel: DataFrame, by: str = "mom") -> DataFrame:
    """By month: correlation of average ranks of feature and target."""
    x = panel.withColumn("p", average_rank(F.col(by), ["month"])).withColumn("q", average_rank(F.col("target"), ["month"]))
    return x.groupBy("month").agg(F.corr("p", "q").alias("ic"), F.count("*").alias("n")).where("n >= 3")


def quintile_buckets(panel: DataFrame) -> DataFrame:
    """Bucket 0 to 4 of each target between its month's 20, 40, 60 and 80 per cent points; a tie goes below. Mean by bucket."""
    edges = panel.groupBy("month").agg(F.percentile("target", F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8)))).alias("edges"))
    x = panel.join(edges, "month").withColumn("bucket", F.size(F.filter("edges", lambda e: e < F.col("target"))))
    return x.groupBy("bucket").agg(F.avg("target").alias("mean"), F.count("*").alias("n"))


def purged_pairs(panel: DataFrame, horizon: int = 1, embargo: int = 1) -> DataFrame:
    """Train rows by test year: those whose label ends ``embargo`` months or more before the year's first test month."""
    i = F.year("month") * 12 + F.month("month")
    first = panel.groupBy(F.year("month").alias("year")).agg(F.min(i).alias("first"), F.count("*").alias("n_test"))
    train = panel.groupBy(i.alias("i")).agg(F.count("*").alias("n"))  # months are few: sums by month meet years by range
    return F.broadcast(first).join(train, F.col("i") + horizon <= F.col("first") - embargo, "left").groupBy("year").agg(F.max("n_test").alias("n_test"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_train"))


def base_rates(bars: DataFrame, horizons: tuple[int, ...] = (1, 3, 6, 12), k: float = 24.0) -> DataFrame:
    """Quantiles of forward monthly returns by horizon: all, those from the newest cell, and their shrunk blend."""
    w = Window.partitionBy("symbol").orderBy("month")
    m = B.cells(bars).groupBy("symbol", F.trunc("date", "month").alias("month")).agg(F.max_by("close", "date").alias("close"), F.max_by("cell", "date").alias("cell"))
    m = m.withColumn("now", F.last("cell").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ahead = F.array(*(F.struct(F.lit(h).alias("h"), (F.lead("close", h).over(w) / F.col("close") - 1).alias("r")) for h in horizons))
    each = m.select("symbol", (F.col("cell") == F.col("now")).alias("own"), ahead.alias("ahead")).select("symbol", "own", F.inline("ahead")).where("r is not null")
    own = F.when(F.col("own"), F.col("r"))
    g = each.groupBy("symbol", "h").agg(
        F.percentile("r", 0.25).alias("q25"), F.percentile("r", 0.5).alias("q50"), F.percentile("r", 0.75).alias("q75"), F.avg((F.col("r") > 0).cast("double")).alias("hit"), F.count("r").alias("n"),
        F.percentile(own, 0.5).alias("own_q50"), F.count(own).alias("own_n"), F.percentile("r", 0.05).alias("q05"), F.percentile("r", 0.95).alias("q95"),
    )
    weight = (F.col("own_n") / F.col("h")) / (F.col("own_n") / F.col("h") + k)
    return g.withColumn("shrink_w", weight).withColumn("shrunk", F.when(F.col("own_n") > 0, weight * F.col("own_q50") + (1 - weight) * F.col("q50")).otherwise(F.col("q50")))


def vol_managed(bars: DataFrame, target: float | None = None) -> DataFrame:
    """Base-rate quantiles scaled by a target over the newest volatility; by default, the median of the symbol's own history."""
    v = B.log_volatility(bars).where("vol is not null").groupBy("symbol").agg(F.max_by("vol", "date").alias("vol"), F.percentile("vol", 0.5).alias("median"))
    scale = (F.col("median") if target is None else F.lit(target)) / F.nullif(F.col("vol"), F.lit(0.0))
    return base_rates(bars).join(v, "symbol").select("symbol", "h", *((F.col(q) * scale).alias(q) for q in ("q25", "q50", "q75")))


def entropy_rolling(bars: DataFrame, n: int = 63, bins: int = 10) -> DataFrame:
    """Entropy (0 to 1) of returns over ``n`` rows on a grid of three deviations either side, edges clipped."""
    r = returns(bars).withColumn("s", F.stddev_samp("ret").over(Window.partitionBy("symbol")))
    r = r.withColumn("bin", F.least(F.greatest(F.floor((F.col("ret") + 3 * F.col("s")) / (6 * F.col("s")) * bins), F.lit(0)), F.lit(bins - 1)))
    w = B.last(n)
    p = [F.sum((F.col("bin") == i).cast("int")).over(w) / n for i in range(bins)]
    h = sum((F.when(x > 0, -x * F.log2(x)).otherwise(0.0) for x in p), F.lit(0.0)) / F.log2(F.lit(float(bins)))
    return r.select("symbol", "date", F.when(F.count("*").over(w) >= n, F.round(h, 9)).alias("entropy"))


def entropy_backtest(bars: DataFrame, horizon: int = 21) -> DataFrame:
    """Mean compounded return over the rows after, by symbol and third of rolling entropy."""
    e = entropy_rolling(bars).join(returns(bars), ["symbol", "date"])
    x = e.withColumn("fwd", F.when(F.count("*").over(B.by().rowsBetween(1, horizon)) == horizon, F.exp(F.sum(F.log1p("ret")).over(B.by().rowsBetween(1, horizon))) - 1)).where("entropy is not null and fwd is not null")
    cut = x.groupBy("symbol").agg(F.percentile("entropy", 1 / 3).alias("lo"), F.percentile("entropy", 2 / 3).alias("hi"))
    y = x.join(cut, "symbol").withColumn("third", F.when(F.col("entropy") <= F.col("lo"), "low").when(F.col("entropy") >= F.col("hi"), "high").otherwise("mid"))
    return y.groupBy("symbol", "third").agg(F.avg("fwd").alias("mean"), F.count("*").alias("n"))


def aligned(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """Closes of some symbols by date (outer), one column each."""
    return bars.where(F.col("symbol").isin(symbols)).groupBy("date").pivot("symbol", symbols).agg(F.first("close"))


def common_window(bars: DataFrame, n: int) -> DataFrame:
    """Rows of the newest ``n`` dates on which every symbol traded."""
    total = bars.agg(F.countDistinct("symbol").alias("k"))
    dates = bars.groupBy("date").agg(F.countDistinct("symbol").alias("own")).join(F.broadcast(total)).where("own = k").orderBy(F.desc("date")).limit(n).select("date")
    return bars.join(F.broadcast(dates), "date", "left_semi").select("symbol", "date", "close")


def as_of(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, value: str) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` on or before its date, by one sorted pass over both."""
    a = left.withColumn("__at", F.col(left_on)).withColumn("__side", F.lit(1))
    b = right.select(F.col(by), F.col(right_on).alias("__at"), F.col(value).alias("__value"), F.lit(0).alias("__side"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__value", ignorenulls=True).over(w)).where("__side = 1").drop("__at", "__side", "__value")


def as_of_series(left: DataFrame, series: DataFrame, left_on: str, right_on: str, value: str) -> DataFrame:
    """``left`` with the last known ``value`` of one series on or before its date; null before the series begins.

    The series is packed by month (31 entries at most) with the value it had before; rows meet their month by a broadcast table as
    long as the calendar, so ``left`` stays where it is and is not copied. Of one date's values the largest counts.
    """
    own = series.where(F.col(value).isNotNull()).select(F.col(right_on).alias("d"), F.col(value).alias("v"))
    month = own.groupBy(F.trunc("d", "month").alias("__month")).agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("__days"))
    span = month.agg(F.min("__month").alias("a"), F.max("__month").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("__month"))
    w = Window.orderBy("__month").rowsBetween(Window.unboundedPreceding, -1)  # a row a month
    table = span.join(month, "__month", "left").withColumn("__before", F.last(F.element_at("__days", -1)["v"], ignorenulls=True).over(w))
    end = own.agg(F.max_by("v", F.struct("d", "v")).alias("__end"), F.max("d").alias("__last"))  # one row
    x = left.withColumn("__month", F.trunc(left_on, "month")).join(F.broadcast(table), "__month", "left").join(F.broadcast(end))
    known = F.filter("__days", lambda s: s["d"] <= F.col(left_on))
    found = F.when(F.col(left_on) >= F.col("__last"), F.col("__end")).otherwise(F.coalesce(F.when(F.size(known) > 0, F.element_at(known, -1)["v"]), F.col("__before")))
    return x.withColumn(value, found).drop("__month", "__days", "__before", "__end", "__last")


def changes_as_of(series: DataFrame, months: tuple[int, ...] = (1, 3, 12)) -> DataFrame:
    """Newest close of each symbol and its change from the value as of some months before."""
    now = series.groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("now"))
    asked = now.select("symbol", "date", "now", F.explode(F.array(*map(F.lit, months))).alias("k")).withColumn("at", F.add_months("date", -F.col("k")))
    found = as_of(asked, series.select("symbol", "date", "close"), "symbol", "at", "date", "close")
    return found.select("symbol", "k", "now", (F.col("now") - F.col("close")).alias("diff"), (F.col("now") / F.col("close") - 1).alias("pct"))


def kinematics(ema: DataFrame, column: str = "ema_21") -> DataFrame:
    """Mean change of the smoothed log price over four blocks of 21 rows: velocity, and its first two differences."""
    x = ema.select("symbol", "date", (F.ln(column) - F.lag(F.ln(column)).over(B.by())).alias("d"), F.floor((F.row_number().over(B.newest()) - 1) / 21).alias("block")).where("block < 4")
    g = x.groupBy("symbol").agg(*(F.avg(F.when(F.col("block") == k, F.col("d"))).alias(f"v{k}") for k in range(4)))
    return g.select("symbol", F.col("v0").alias("velocity"), F.expr("v0 - v1").alias("acceleration"), F.expr("v0 - 2 * v1 + v2").alias("jerk"))


def walk_forward_skill(panel: DataFrame, feature: str = "mom") -> DataFrame:
    """By symbol: out-of-sample R-squared of the expanding mean of its settled targets against zero."""
    w = Window.partitionBy("symbol").orderBy("month")
    x = panel.select("symbol", "month", "target", F.avg("target").over(w.rowsBetween(Window.unboundedPreceding, -2)).alias("guess")).where("guess is not null")
    return x.groupBy("symbol").agg((1 - F.sum(F.pow(F.col("target") - F.col("guess"), 2)) / F.sum(F.pow("target", F.lit(2)))).alias("r2"), F.count("*").alias("n"))
