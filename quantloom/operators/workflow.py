"""Cockpit scores, lanes, alerts, digests and the filters of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import scalars as S
from quantloom.operators import bars as B
from quantloom.operators import indicators as I

#: Points for labels, as the service's users know them.
RECOMMENDATION_POINTS = {"BUY": 30.0, "BUY SETUP": 22.0, "HOLD LONG": 18.0, "WATCH": 6.0, "CASH": -8.0, "SELL": -30.0}
STATE_POINTS = {"LONG": 8.0, "WATCH": 2.0, "CASH": -5.0}
LOCATION_POINTS = {"above value": 8.0, "inside value": 2.0, "below value": -8.0}
STAGE_POINTS = {"coiled spring": 12.0, "inflecting": 8.0, "proof phase": 4.0, "renaming phase": -2.0, "extended": -10.0, "no setup": -4.0}
#: Title, message and action of each kind of alert.
ALERT_TEXTS = {
    "priority-setup": ("Priority setup", "{symbol} is ranked #{rank} with a {score} cockpit score and {setup}.", "Review Ridge and Flow confirmation before sizing."),
    "risk-lane": ("Risk lane", "{symbol} is in the Risk lane with a {score} cockpit score.", "Check open exposure and wait for the state to improve."),
    "fresh-short-flow": ("Fresh short flow", "{symbol} printed a fresh short Flow Compass shift.", "Treat long ideas as impaired until flow stabilizes."),
    "fresh-long-flow": ("Fresh long flow", "{symbol} printed a fresh long Flow Compass shift.", "Compare entry quality against auction value and Ridge state."),
    "ridge-sell": ("Ridge sell", "{symbol} has a Ridge SELL recommendation.", "Review exits or avoid fresh long exposure."),
    "ridge-buy": ("Ridge buy", "{symbol} has a Ridge BUY recommendation.", "Confirm flow, auction location, and current price before entry."),
    "ridge-buy-setup": ("Ridge buy setup", "{symbol} has a Ridge BUY SETUP recommendation.", "Watch for confirmation instead of forcing the entry."),
    "auction-above-value": ("Above value", "{symbol} is accepting above auction value.", "Look for continuation only if flow remains supportive."),
    "auction-below-value": ("Below value", "{symbol} is trading below auction value.", "Require reclaim evidence before treating weakness as opportunity."),
    "high-volatility": ("High volatility", "{symbol} is running at {volatility} annualized volatility.", "Size risk with wider expected range in mind."),
}
#: What a digest advises.
NEXT_STEPS = {"risk": "Review risk alerts before adding exposure.", "priority": "Open priority setups in Cockpit for confirmation.", "any": "Export or save the digest with the research library.", "none": "Keep the current list on watch; no immediate action fired."}


def points(column: str, table: dict[str, float]) -> Column:
    pairs = [F.lit(x) for k, v in table.items() for x in (k, v)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(column)), F.lit(0.0))


def lane(score: str, stage: Column | None = None) -> Column:
    s = F.col(score)
    plain = F.when(s >= 45, "Priority").when(s >= 18, "Watch").when(s <= -18, "Risk").otherwise("Review")
    if stage is None:
        return plain
    return F.when(F.coalesce(F.lower(stage).isin("coiled spring", "inflecting"), F.lit(False)) & (s >= 25), "Misclassified Inflection").otherwise(plain)


def cockpit_scores(parts: DataFrame) -> DataFrame:
    """Rows of a symbol's parts with score, lane, setup and rank (from one; its window holds a row a symbol).

    Parts: scan, flow_score, flow_state, recommendation, state, location, fresh_long, fresh_short, total_return, max_drawdown; and,
    where a setup score is known, setup_total (0 to 100) and stage. A null part counts nothing.
    """
    num = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = num("scan") * 0.65 + num("flow_score") * 0.35 + points("recommendation", RECOMMENDATION_POINTS) + points("state", STATE_POINTS) + points("location", LOCATION_POINTS)
    score = score + F.when(F.col("fresh_long"), 10.0).otherwise(0.0) - F.when(F.col("fresh_short"), 14.0).otherwise(0.0) + num("total_return") * 30 - F.abs(F.least(num("max_drawdown"), F.lit(0.0))) * 35
    setup = F.concat_ws(" / ", F.coalesce("recommendation", F.lit("No ridge read")), F.coalesce("flow_state", F.lit("No flow read")), F.coalesce("location", F.lit("unknown auction location")))
    stage = F.lit(None).cast("string")
    if "stage" in parts.columns:
        known = F.col("setup_total").isNotNull()
        stage = F.when(known, F.col("stage"))
        score = score + F.when(known, (F.col("setup_total") - 50) * 0.4 + points("__stage", STAGE_POINTS)).otherwise(0.0)
        setup = F.concat_ws(" / ", setup, F.nullif(F.trim(stage), F.lit("")))
        parts = parts.withColumn("__stage", F.lower("stage"))
    x = parts.withColumn("score", F.round(score, 2)).withColumn("setup", setup).drop("__stage")
    return x.withColumn("lane", lane("score", stage)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "symbol")))


def cockpit(bars: DataFrame, setups: DataFrame | None = None) -> DataFrame:
    """Each symbol's composite score from scanner, flow, strategy and auction, with lane and rank; ``setups`` adds its total and stage."""
    flow = I.flow_compass(bars).groupBy("symbol").agg(*(F.max_by(c, "date").alias(c) for c in ("flow_score", "state", "fresh_long", "fresh_short"))).withColumnRenamed("state", "flow_state")
    auction = B.auction_location(bars).select("symbol", "location")
    vol = B.volatility_table(bars).select("symbol", F.col("annual").alias("volatility"))
    x = B.scanner(bars).select("symbol", "price", F.col("score").alias("scan")).join(flow, "symbol").join(I.ridge_strategy(bars), "symbol").join(auction, "symbol").join(vol, "symbol")
    if setups is not None:
        x = x.join(setups.select("symbol", F.col("total").alias("setup_total"), "stage"), "symbol", "left")
    return cockpit_scores(x)


def alerts(rows: DataFrame, volatility: float = 0.45) -> DataFrame:
    """No, one or several alerts a row; a fresh long turn only where there is no fresh short one."""
    a = lambda cond, kind, severity, category: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(category).alias("category")))
    r, where = F.upper("recommendation"), F.lower("location")
    rules = F.array(
        a(F.col("lane") == "Priority", "priority-setup", "High", "Setup"), a(F.col("lane") == "Risk", "risk-lane", "High", "Risk"), a(F.col("fresh_short"), "fresh-short-flow", "High", "Flow"),
        a(F.col("fresh_long") & ~F.col("fresh_short"), "fresh-long-flow", "Medium", "Flow"), a(r == "SELL", "ridge-sell", "High", "Ridge"), a(r == "BUY", "ridge-buy", "High", "Ridge"),
        a(r == "BUY SETUP", "ridge-buy-setup", "Medium", "Ridge"), a(where == "above value", "auction-above-value", "Medium", "Auction"), a(where == "below value", "auction-below-value", "Medium", "Auction"),
        a(F.col("volatility") >= volatility, "high-volatility", "Medium", "Volatility"),
    )
    out = rows.select("symbol", "rank", "lane", "score", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("a")).select("symbol", "rank", "lane", "score", "a.*")
    return out.withColumn("id", F.concat(F.lower("symbol"), F.lit("-"), "kind"))


def with_texts(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Alerts with title, message and action; ``rows`` are the cockpit rows that they come from."""
    x = found.join(rows.select("symbol", "setup", "volatility"), "symbol")
    filled = {"{symbol}": F.col("symbol"), "{rank}": F.col("rank").cast("string"), "{score}": S.fixed(F.coalesce("score", F.lit(0.0))), "{setup}": F.coalesce("setup", F.lit("mixed setup")), "{volatility}": F.concat(S.fixed(F.col("volatility") * 100), F.lit("%"))}
    pick = lambda i: F.element_at(F.create_map(*(F.lit(v) for k, t in ALERT_TEXTS.items() for v in (k, t[i]))), F.col("kind"))
    message = pick(1)
    for mark, value in filled.items():
        message = F.replace(message, F.lit(mark), value)
    return x.select(*found.columns, pick(0).alias("title"), message.alias("message"), pick(2).alias("action"))


#: Levels of materiality from the least up.
MATERIALITY = ("noise", "minor", "material", "urgent")


def material(found: DataFrame, least: str | None, levels: tuple[str, ...] = MATERIALITY) -> DataFrame:
    """Alerts whose known materiality is ``least`` or more; those that were not scored stay. An unknown ``least`` keeps all."""
    least = (least or "").strip().lower()
    if least not in levels:
        return found
    place = F.array_position(F.array(*map(F.lit, levels)), F.col("materiality"))
    return found.where(F.coalesce(place, F.lit(0)).isin(0) | (place > levels.index(least)))


def digest_note(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One row: the digest's headline, summary (the five best of each list, by rank) and next steps."""
    best = lambda cond: F.slice(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("rank", "symbol")))), lambda x: x["symbol"]), 1, 5)
    of = rows.agg(F.count("*").alias("names"), best(F.col("lane") == "Priority").alias("priority"), best(F.col("lane") == "Risk").alias("risk"), best(F.col("fresh_long") | F.col("fresh_short")).alias("shifts"))
    n = found.agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "High").alias("high"))
    x = of.join(F.broadcast(n))  # one row each
    noun = lambda c: F.when(F.col(c) == 1, " alert").otherwise(" alerts")
    across = F.concat(F.lit(" across "), F.col("names").cast("string"), F.lit(" names"))
    headline = F.when(F.col("high") > 0, F.concat(F.col("high").cast("string"), F.lit(" high-priority"), noun("high"), across)).when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" watchlist"), noun("n"), across)).otherwise(F.concat(F.lit("No high-signal alerts"), across))
    part = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(name + ": "), F.array_join(c, ", ")))
    summary = F.concat_ws(" | ", part("Priority", "priority"), part("Risk", "risk"), part("Flow shifts", "shifts"))
    steps = F.array_compact(F.array(F.when(F.size("risk") > 0, NEXT_STEPS["risk"]), F.when(F.size("priority") > 0, NEXT_STEPS["priority"]), F.when(F.col("n") > 0, NEXT_STEPS["any"])))
    return x.select(headline.alias("headline"), F.when(summary == "", "No names crossed the alert rules in this run.").otherwise(summary).alias("summary"), F.when(F.size(steps) == 0, F.array(F.lit(NEXT_STEPS["none"]))).otherwise(steps).alias("next_steps"))


def digest(found: DataFrame, most: int = 25) -> DataFrame:
    """The gravest alerts: severity, then score, rank and id."""
    order = [F.when(F.col("severity") == "High", 0).otherwise(1), F.desc("score"), "rank", "id"]
    return found.orderBy(*order).limit(most)


def digest_counts(found: DataFrame) -> DataFrame:
    """Counts by severity, by category and by lane, in one pass over grouping sets."""
    g = found.groupingSets([["severity"], ["category"], ["lane"]], "severity", "category", "lane").agg(F.count("*").alias("n"))
    return g.select(F.when(F.col("severity").isNotNull(), "severity").when(F.col("category").isNotNull(), "category").otherwise("lane").alias("dimension"), F.coalesce("severity", "category", "lane").alias("value"), "n")


def scan_filter(rows: DataFrame, stages: list[str] | None = None, low: float | None = None, high: float | None = None, sort: str = "score_desc", limit: int | None = None) -> DataFrame:
    """Rows of some lanes (any case) within score bounds, sorted, then limited, then ranked from one."""
    x = rows
    if stages:
        x = x.where(F.lower("lane").isin([s.lower() for s in stages]))
    if low is not None:
        x = x.where(F.col("score") >= low)
    if high is not None:
        x = x.where(F.col("score") <= high)
    order = {"score_asc": [F.asc("score"), F.asc("symbol")], "ticker": [F.asc("symbol")], "rank": [F.asc("rank")]}.get(sort, [F.desc("score"), F.asc("symbol")])
    ranked = x.drop("rank").withColumn("rank", F.row_number().over(Window.orderBy(*order))) if sort != "rank" else x
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def stage_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("lane", F.lit("No Setup")).alias("lane")).agg(F.count("*").alias("n"))


def key_levels(bars: DataFrame) -> DataFrame:
    """Auction levels and extremes of each symbol in order of their distance from the close."""
    x = B.auction_levels(bars).join(B.price_extremes(bars), "symbol")
    names = ("vah", "val", "poc", "high_252", "low_252", "high_21", "low_21")
    long = x.select("symbol", "close", F.expr(f"stack({len(names)}, {', '.join(f'{chr(39)}{n}{chr(39)}, {n}' for n in names)}) AS (level, value)")).where("value is not null")
    far = F.abs(F.col("value") / F.col("close") - 1)
    return long.select("symbol", "level", "value", F.row_number().over(Window.partitionBy("symbol").orderBy(far, "level")).alias("rank"))
