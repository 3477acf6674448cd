"""What is thought of a symbol: reclassification, agreement of forecasts, timing, what to watch, and the legs of an exposure.

Every function takes one row per symbol (and horizon, or month) and is a set of column expressions or a grouped sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import bars as B

#: Names of the proof stages, from 0.
PROOF_STAGES = ("Narrative only", "Product proof", "Financial bend", "Proof / guide-up", "Public renaming", "Overbuild / fatigue")
#: Bounds of an entropy reading that is structure or noise.
STRUCTURE, NOISE = 0.35, 0.70
#: What an interval may be called, and the periods that intraday bars reach.
INTERVALS = {"15m": "15m", "15min": "15m", "15": "15m", "1d": "1d", "d": "1d", "day": "1d", "daily": "1d", "1w": "1w", "w": "1w", "wk": "1w", "1wk": "1w", "week": "1w", "weekly": "1w"}
INTRADAY_PERIODS = ("1d", "5d", "1mo")


def _truth(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def reclassified(rows: DataFrame) -> DataFrame:
    """Each symbol's gap (0 to 1), proof stage with its name, price scenarios' inputs untouched, catalysts and kill criteria.

    ``rows``: stale (the industry's old name is a stale one), evidence (hits of the best theme), theme (null: none), yoy,
    accelerating, leverage (label), market_cap, status of the fundamentals, product (the summary names a product), mentions (of
    the theme by analysts), ret_3m, ret_1m and gross_margin (a share). A null counts as not met.
    """
    known = _truth(F.col("status").isin("available", "partial"))
    part = lambda cond, worth: F.when(_truth(cond), worth).otherwise(0.0)
    gap = part(F.col("stale"), 0.3) + part(F.col("evidence") >= 5, 0.4) + part(F.col("yoy") > 0.25, 0.2) + part(F.col("market_cap") < 5e9, 0.1)
    gap = F.when(known, gap).otherwise(F.greatest(F.lit(0.0), gap - 0.2))
    met = {
        1: (F.col("evidence") >= 3) & F.col("product"), 2: F.col("accelerating") & (F.col("yoy") > 0.15), 3: (F.col("yoy") > 0.30) & F.lower("leverage").isin("high", "moderate"),
        4: _truth(F.col("mentions") > 4) | _truth(F.col("ret_3m") > 0.40),
    }
    slower = _truth(F.col("yoy") < 0.05) | _truth(~_truth(F.col("accelerating")) & (F.col("yoy") < 0.10))
    turned = (_truth(F.col("ret_1m") < -0.10) & met[4]) | slower
    stage = F.lit(0)
    for k in (1, 2, 3):  # a step needs the one before it
        stage = F.when(_truth(met[k]) & (stage >= k - 1), k).otherwise(stage)
    stage = F.when(met[4], 4).otherwise(stage)
    stage = F.when(turned & (met[4] | _truth(met[2])), 5).otherwise(stage)
    stage = F.when(~known & (stage > 1), 1).otherwise(stage)
    share = lambda x: F.concat(F.round(x * 100, 0).cast("int").cast("string"), F.lit("%"))
    margin, theme = F.col("gross_margin"), F.col("theme")
    short = F.coalesce(F.lower(F.element_at(F.split(theme, " "), 1)), F.lit("infrastructure"))
    catalysts = F.array(
        F.concat(F.lit("Next quarterly earnings: watch infrastructure/"), short, F.lit(" revenue mix")), F.lit("Backlog or order-rate guidance"),
        F.when(margin.isNotNull(), F.concat(F.lit("Gross margin stability at >"), share(margin))).otherwise("Gross margin stability vs prior quarter"), F.lit("Estimate revisions following next print"),
        F.when(theme.isNotNull(), F.concat(F.lit("Industry capex confirmation around: "), theme)).otherwise("Sector capex confirmation in customer 10-Qs and call transcripts"),
    )
    kill = F.array(
        F.lit("Revenue growth decelerates below 5% YoY for two consecutive quarters"), F.when(margin.isNotNull(), F.concat(F.lit("Gross margin falls below "), share(margin - 0.05))).otherwise("Gross margin contracts by more than 5pp"),
        F.lit("Operating expenses grow faster than revenue for two quarters"), F.concat(F.coalesce(theme, F.lit("thesis")), F.lit("-specific: customer cancellations or program delays")),
        F.lit("Stock fully renamed by sell-side while estimates haven't moved (sell-into-renaming risk)"),
    )
    names = F.array(*map(F.lit, PROOF_STAGES))
    out = rows.withColumn("gap", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), gap)), 3)).withColumn("proof_stage", stage)
    return out.withColumn("proof_name", F.element_at(names, F.col("proof_stage") + 1)).withColumn("catalysts", catalysts).withColumn("kill_criteria", kill)


def agreement(means: DataFrame, trailing: DataFrame, near: float = 0.25, enough: int = 3) -> DataFrame:
    """By symbol and horizon: how far the components' means differ, and which restate the trailing mean.

    ``means``: symbol, h (rows), name, mean (null: not available). ``trailing``: symbol and daily, its mean daily return, compounded
    over the horizon for comparison. collinear: ``enough`` or more lie within ``near`` of it.
    """
    x = means.where("mean is not null and not isnan(mean)").join(trailing, "symbol", "left")
    x = x.withColumn("reference", F.when(F.col("daily") > -1, F.expm1(F.log1p("daily") * F.col("h"))).when(F.col("daily").isNotNull(), -1.0))
    close = F.abs(F.col("mean") - F.col("reference")) <= near * F.greatest(F.abs("reference"), F.lit(1e-9))
    g = x.groupBy("symbol", "h").agg(
        F.count("*").alias("n"), F.stddev_samp("mean").alias("stdev"), (F.max("mean") - F.min("mean")).alias("spread"), F.first("reference").alias("reference"), F.array_sort(F.collect_list(F.when(close, F.col("name")))).alias("near"),
    )
    return g.withColumn("collinear", F.when(F.col("reference").isNotNull(), F.size("near") >= enough))


def timing(rows: DataFrame) -> DataFrame:
    """Is this a good month to add? Mean over spread, plus bull less bear, plus the month's hit rate above a half.

    ``rows``: symbol, mean, std, p_bull, p_bear, hit (null: not known). Without a mean the label is unknown.
    """
    num = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    ratio = F.when(num("std") > 0, F.col("mean") / F.col("std")).otherwise(0.0)
    score = ratio + num("p_bull") - num("p_bear") + F.coalesce(F.col("hit") - 0.5, F.lit(0.0))
    x = rows.withColumn("score", F.when(F.col("mean").isNotNull(), score))
    return x.withColumn("timing", F.when(F.col("score").isNull(), "unknown").when(F.col("score") > 0.25, "good").when(F.col("score") < -0.25, "bad").otherwise("neutral"))


def watched(weights: DataFrame, most: int = 6) -> DataFrame:
    """The symbols that explain the most (weights: symbol, weight, share), with what to watch for, the heaviest first."""
    w = Window.orderBy(F.desc(F.abs("weight")), "symbol")  # a row per impact weight: a handful
    x = weights.where("weight is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return x.select("rank", "symbol", "weight", "share", F.concat("symbol", F.lit(" moves more than 5% over 20 sessions")).alias("condition"))


def entropy_label(value: Column) -> Column:
    """Structure, mixed or noise; unknown where there is no number."""
    return F.when(value.isNull() | F.isnan(value), "unknown").when(value < STRUCTURE, "structure").when(value > NOISE, "noise").otherwise("mixed")


def interval(value: Column) -> Column:
    """15m, 1d or 1w for what a caller may call it; nothing is 1d, and what isn't known is null."""
    names = F.create_map(*(F.lit(x) for k, v in INTERVALS.items() for x in (k, v)))
    return F.element_at(names, F.lower(F.trim(F.coalesce(F.nullif(value, F.lit("")), F.lit("1d")))))


def clamped_period(period: Column, at: Column) -> Column:
    """The period; five days where intraday bars don't reach as far."""
    return F.when((at == "15m") & ~period.isin(*INTRADAY_PERIODS), "5d").otherwise(period)


def proxy_factors(bars: DataFrame, recipes: dict[str, list[tuple[str, str]]], market: str, risk_free: float = 0.0) -> DataFrame:
    """date, factor, value: the market's return less the daily risk-free rate, and long less short of each factor's first recipe whose two legs have bars.

    A factor without such a recipe has no rows; without the market there are none at all. Which legs have bars is asked of the
    legs alone, of which there are a handful.
    """
    legs = {x for own in recipes.values() for pair in own for x in pair} | {market}
    r = B.with_returns(bars.where(F.col("symbol").isin(*legs))).where("ret is not null").select("symbol", "date", "ret")
    have = {x.symbol for x in r.groupBy("symbol").count().where("count > 1").collect()}
    if market not in have:
        return r.where("false").selectExpr("date", "symbol AS factor", "ret AS value")
    built = {f: next((p for p in own if have.issuperset(p)), None) for f, own in recipes.items()}
    one = lambda s: F.max(F.when(F.col("symbol") == s, F.col("ret")))
    wide = r.groupBy("date").agg((one(market) - risk_free / 252).alias("MKT"), *((one(p[0]) - one(p[1])).alias(f) for f, p in built.items() if p))
    names = [c for c in wide.columns if c != "date"]
    return wide.select("date", F.expr(f"stack({len(names)}, {', '.join(f'{chr(39)}{n}{chr(39)}, `{n}`' for n in names)}) AS (factor, value)")).where("value is not null")


def macro_months(series: DataFrame) -> DataFrame:
    """series_id, month, level (the month's last value) and change, the first difference between successive months that have one."""
    m = series.where("value is not null").groupBy("series_id", F.trunc("date", "month").alias("month")).agg(F.max_by("value", "date").alias("level"))
    return m.withColumn("change", F.col("level") - F.lag("level").over(Window.partitionBy("series_id").orderBy("month")))


def basket(bars: DataFrame, macro: DataFrame, legs: dict[str, str], spreads: dict[str, tuple[str, str]], changes: dict[str, str]) -> DataFrame:
    """leg, month and value of an exposure's legs: monthly log returns of ``legs``, differences of two (``spreads``), and changes of macro levels.

    A leg without data has no rows. Completed months only, as of bars.
    """
    symbols = {*legs.values(), *(s for p in spreads.values() for s in p)}
    m = B.month_ends(bars.where(F.col("symbol").isin(*symbols))).where("ret is not null").select("symbol", "month", F.log1p("ret").alias("value"))
    named = lambda own: F.create_map(*(F.lit(x) for k, v in own.items() for x in (v, k)))
    out = m.where(F.col("symbol").isin(*legs.values())).select(F.element_at(named(legs), F.col("symbol")).alias("leg"), "month", "value")
    for name, (a, b) in spreads.items():
        x = m.where(F.col("symbol") == a).join(m.where(F.col("symbol") == b).select("month", F.col("value").alias("other")), "month")
        out = out.unionByName(x.select(F.lit(name).alias("leg"), "month", (F.col("value") - F.col("other")).alias("value")))
    x = macro_months(macro).where(F.col("series_id").isin(*changes.values()) & F.col("change").isNotNull())
    return out.unionByName(x.select(F.element_at(named(changes), F.col("series_id")).alias("leg"), "month", F.col("change").alias("value")))


def pruned_legs(legs: DataFrame, own: DataFrame, target: int, least: int = 2) -> tuple[list[str], list[str]]:
    """Legs kept and legs dropped, in order: while fewer than ``target`` months are common to all and more than ``least`` legs
    remain, the one goes whose loss adds the most months (ties: the first by name); it ends where none adds any.

    ``own`` has the months of the symbol itself. The driver gets each leg's months: legs and months are few by nature.
    """
    months = {r.leg: set(r.months) for r in legs.where("value is not null").groupBy("leg").agg(F.collect_set("month").alias("months")).collect()}
    mine = {r.month for r in own.select("month").distinct().collect()}
    common = lambda names: len(mine.intersection(*(months[n] for n in names)))
    kept, dropped = sorted(months), []
    while len(kept) > least and common(kept) < target:
        gain = {n: common([x for x in kept if x != n]) for n in kept}
        worst = max(kept, key=lambda n: gain[n])
        if gain[worst] <= common(kept):
            break
        kept.remove(worst)
        dropped.append(worst)
    return kept, dropped


def spreads_by_horizon(quantiles: DataFrame) -> DataFrame:
    """symbol, h, iqr and median of shrunk quantiles (symbol, h, q25, q50, q75); null where a side is."""
    return quantiles.select("symbol", "h", (F.col("q75") - F.col("q25")).alias("iqr"), F.col("q50").alias("median"))


def series_payload(series: DataFrame) -> DataFrame:
    """series_id and payload, {"dates": [...], "values": [...]} in order of date without nulls; one array a series."""
    x = series.where("value is not null and not isnan(value)").groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(F.col("date").cast("string").alias("d"), F.col("value").alias("v")))).alias("x"))
    return x.select("series_id", F.to_json(F.struct(F.col("x.d").alias("dates"), F.col("x.v").alias("values"))).alias("payload"))


def payload_series(payloads: DataFrame) -> DataFrame:
    """series_id, date and value of payloads; one whose two lists differ in length is an error."""
    x = payloads.select("series_id", F.from_json("payload", "dates array<string>, values array<double>").alias("p"))
    same = F.size("p.dates") == F.size("p.values")
    pairs = F.when(same, F.arrays_zip("p.dates", "p.values")).otherwise(F.raise_error(F.lit("payload has mismatched dates and values")).cast("array<struct<dates: string, values: double>>"))
    return x.select("series_id", F.explode(pairs).alias("z")).select("series_id", F.to_date("z.dates").alias("date"), F.col("z.values").alias("value"))
