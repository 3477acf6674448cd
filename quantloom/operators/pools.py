"""Base rates of an industry's own history, distribution families by their distance, entropy on quantile bins, and states."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scalars import normal_cdf
from quantloom.operators import bars as B
from quantloom.operators import cross as X
from quantloom.operators.models import Hmm

QUANTILES = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
#: Families in the order that settles equal distances.
FAMILIES = ("normal", "laplace", "lognormal", "exponential", "pareto")
STATES = ("bear", "neutral", "bull")


def pooled_base_rates(bars: DataFrame, members: DataFrame, horizons: tuple[int, ...] = (1, 3, 6, 12), k: float = 24.0) -> DataFrame:
    """Forward monthly returns of each symbol's pool (an industry's or the market's own series, as in ``members``: symbol,
    pool): all of them, those from months in the symbol's own newest cell (cond_q50, cond_n), and the blend of the two.

    The blend trusts the cell by its independent months (rows by horizon) against ``k``. A symbol without a newest cell
    has the pool's whole history; one whose pool has no bars has no rows. Pools are summed once by cell and horizon, however
    many symbols share them.
    """
    w = Window.partitionBy("symbol").orderBy("month")
    m = B.cells(bars).groupBy("symbol", F.trunc("date", "month").alias("month")).agg(F.max_by("close", "date").alias("close"), F.max_by("cell", "date").alias("cell"))
    now = m.groupBy("symbol").agg(F.max_by("cell", "month").alias("now"))
    ahead = F.array(*(F.struct(F.lit(h).alias("h"), (F.lead("close", h).over(w) / F.col("close") - 1).alias("r")) for h in horizons))
    each = m.join(members.select(F.col("pool").alias("symbol")).distinct(), "symbol", "left_semi").select("symbol", "cell", ahead.alias("ahead"))
    each = each.select("symbol", F.inline("ahead"), F.explode(F.array(F.lit("*"), "cell")).alias("of")).where("r is not null and of is not null")
    stats = [F.percentile("r", p).alias(q) for q, p in QUANTILES.items()] + [F.avg((F.col("r") > 0).cast("double")).alias("hit"), F.avg("r").alias("mean")]
    per = each.groupBy(F.col("symbol").alias("pool"), "h", "of").agg(*stats, F.count("*").alias("n"))
    names = [*QUANTILES, "hit", "mean"]
    cond = per.where("of != '*'").select("pool", "h", F.col("of").alias("now"), *(F.col(c).alias(f"cond_{c}") for c in names), F.col("n").alias("cond_n"))
    out = members.select("symbol", "pool").join(now, "symbol", "left").join(per.where("of = '*'").drop("of"), "pool").join(cond, ["pool", "h", "now"], "left")
    free = F.coalesce("cond_n", F.lit(0)) / F.col("h")
    out = out.withColumn("w", free / (free + k))
    blend = [F.coalesce(F.col("w") * F.col(f"cond_{c}") + (1 - F.col("w")) * F.col(c), F.col(c)).alias(f"shrunk_{c}") for c in names]
    return out.select("symbol", "pool", "h", F.col("now").alias("cell"), *names, "n", "cond_q50", F.coalesce("cond_n", F.lit(0)).alias("cond_n"), "w", *blend)


def fitted_families(values: DataFrame, least: int = 8) -> DataFrame:
    """symbol, family, loc, scale, ks and rank: how far (Kolmogorov-Smirnov) each family with a closed form lies from the values.

    ``values`` has symbol and value; null and non-finite values are left out, and symbols with fewer than ``least``. A family
    without spread, or made for positive values where some aren't, has no row. loc and scale are mean and deviation (of the
    logarithms for lognormal), median and mean distance from it, the rate as scale, and the least value with the shape as loc.
    """
    x = values.where("value is not null and not isnan(value) and abs(value) < double('inf')").select("symbol", F.col("value").cast("double").alias("value"))
    g = x.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.percentile("value", 0.5).alias("median"), F.min("value").alias("low")).where(F.col("n") >= least)
    log = F.when(F.col("low") > 0, F.ln("value"))
    y = x.join(g, "symbol")
    h = y.groupBy("symbol").agg(F.avg(F.abs(F.col("value") - F.col("median"))).alias("mad"), F.avg(log).alias("lmean"), F.stddev_samp(log).alias("lsd"), F.avg(F.when(F.col("low") > 0, F.ln(F.col("value")) - F.ln("low"))).alias("lratio"))
    y = y.join(h, "symbol").withColumn("i", F.row_number().over(Window.partitionBy("symbol").orderBy("value")))
    some = lambda c: F.nullif(F.col(c), F.lit(0.0))
    v, away = F.col("value"), -F.abs(F.col("value") - F.col("median")) / some("mad")
    laplace = F.when(v < F.col("median"), 0.5 * F.exp(away)).otherwise(1 - 0.5 * F.exp(away))
    forms = {
        "normal": ("sd > 0", "mean", "sd", normal_cdf((v - F.col("mean")) / some("sd"))),
        "laplace": ("mad > 0", "median", "mad", laplace),
        "lognormal": ("low > 0 and lsd > 0", "lmean", "lsd", normal_cdf((F.ln(v) - F.col("lmean")) / some("lsd"))),
        "exponential": ("low > 0", "0.0D", "1 / nullif(mean, 0)", 1 - F.exp(-v / some("mean"))),
        "pareto": ("low > 0 and lratio > 0", "1 / nullif(lratio, 0)", "low", 1 - F.pow(F.col("low") / F.nullif(v, F.lit(0.0)), 1 / some("lratio"))),
    }
    y = y.select("*", *(f[3].alias(f"cdf_{name}") for name, f in forms.items()))
    each = F.array(*(F.when(F.expr(f[0]), F.struct(F.lit(name).alias("family"), F.lit(k).alias("turn"), F.expr(f[1]).alias("loc"), F.expr(f[2]).alias("scale"), F.col(f"cdf_{name}").alias("cdf"))) for k, (name, f) in enumerate(forms.items())))
    z = y.select("symbol", "n", "i", F.inline(F.filter(each, lambda s: s.isNotNull())))
    gap = F.greatest(F.col("i") / F.col("n") - F.col("cdf"), F.col("cdf") - (F.col("i") - 1) / F.col("n"))
    out = z.groupBy("symbol", "family", "turn").agg(F.first("loc").alias("loc"), F.first("scale").alias("scale"), F.max(gap).alias("ks"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy("ks", "turn"))).drop("turn")


def quantile_entropy(bars: DataFrame, windows: tuple[int, ...] = (21, 63, 252), bins: int = 10) -> DataFrame:
    """symbol, days, entropy (0 to 1) and n of the newest returns on bins that hold equal shares of the whole history.

    Edges that coincide keep their order: a return on them counts as above the first only. Where fewer than three edges differ the
    bins are equal-width between the least and the greatest return; a constant history has entropy 0. A shorter history fills a window
    as far as it goes; windows with fewer than ten returns, or fewer than bins, are left out.
    """
    r = X.returns(bars).select("symbol", "date", "ret")
    grid = r.groupBy("symbol").agg(F.percentile("ret", F.array(*(F.lit(k / bins) for k in range(bins + 1)))).alias("edges"))
    wide = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda k: F.element_at("edges", 1) + (F.element_at("edges", -1) - F.element_at("edges", 1)) * k / bins)
    grid = grid.withColumn("edges", F.when(F.size(F.array_distinct("edges")) < 3, wide).otherwise(F.col("edges")))
    inner = F.arrays_zip(F.slice("edges", 2, bins - 1).alias("at"), F.slice("edges", 1, bins - 1).alias("before"))
    x = r.withColumn("age", F.row_number().over(B.newest())).where(F.col("age") <= max(windows)).join(grid, "symbol")
    above = F.filter(inner.alias("inner"), lambda e: (e["at"] < F.col("ret")) | ((e["at"] == F.col("ret")) & (e["at"] > e["before"])))
    x = x.select("symbol", "age", F.size(above).alias("bin"), F.explode(F.array(*map(F.lit, windows))).alias("days")).where("age <= days")
    c = x.groupBy("symbol", "days", "bin").agg(F.count("*").alias("c"))
    g = c.groupBy("symbol", "days").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    g = g.withColumn("entropy", (F.log2("n") - F.col("s") / F.col("n")) / float(np.log2(bins)))
    return g.where(F.col("n") >= max(bins, 10)).select("symbol", "days", F.least(F.greatest("entropy", F.lit(0.0)), F.lit(1.0)).alias("entropy"), "n")


def state_opinion(bars: DataFrame, years: int = 10, least: int = 252) -> DataFrame:
    """symbol, state, p, label, days, share, path_share, path_now and n_days: what a three-state model of the last ``years`` says.

    p is the newest day's posterior given the days up to it, and label the likeliest state; days is how long a state is expected
    to last, share its long-run share, path_share its share of the likeliest path, path_now whether that path ends in it. States are
    ordered by their mean return. Symbols with fewer than ``least`` days of return and 10-day deviation have no row.
    """
    schema = "symbol string, state string, p double, label string, days double, share double, path_share double, path_now boolean, n_days int"

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("date")
        ret = x["close"].pct_change()
        both = np.c_[ret, ret.rolling(10, min_periods=10).std()]
        both = both[np.isfinite(both).all(axis=1)]
        if len(both) < least:
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        z = (both - both.mean(axis=0)) / np.maximum(both.std(axis=0), 1e-12)
        m = Hmm(rounds=200, starts=4).fit(z)
        order = np.argsort(m.mean[:, 0], kind="stable")
        p, path = m.filtered(z)[-1][order], m.viterbi(z)
        return pd.DataFrame({
            "symbol": x["symbol"].iloc[0], "state": STATES, "p": p, "label": STATES[int(p.argmax())], "days": m.durations()[order], "share": m.stationary()[order],
            "path_share": [(path == s).mean() for s in order], "path_now": [bool(path[-1] == s) for s in order], "n_days": len(both),
        })

    newest = Window.partitionBy("symbol").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = bars.where("close > 0").select("symbol", "date", "close").withColumn("end", F.max("date").over(newest)).where(F.col("date") >= F.add_months("end", -12 * years)).drop("end")
    parts = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that small tables' symbols stay spread
    return own.repartition(parts, "symbol").groupBy("symbol").applyInPandas(run, schema)
