"""The second packet: where a symbol stands, as a row with every key of its contract, its memo, summary, validation and Markdown.

The caller hands over whatever sections it has; those it hasn't are null with a reason, so that consumers find the same keys always.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.operators import memos as M
from quantloom.operators import scoring as S
from quantloom.plans.packet import finite, gather

#: Sections that may be null (each with a key of its error beside it), in their order, and the keys about the packet itself.
SECTIONS = ("profile", "exposure", "state", "base_rates", "implied", "fundamentals", "text", "levels", "stack", "tabular", "odds", "scenarios", "memo")
HEAD = ("ticker", "as_of", "generated_at", "engine", "engine_version")
TAIL = ("sources", "meta")
ENGINE, VERSION = "quantloom-situation", "1"
#: Days that a snapshot of options may be younger than the packet; bounds of a density's area and of its median's distance.
TOLERANCE, LEAST_AREA, MOST_AREA, MEDIAN_OFF = 4, 0.95, 1.05, 0.06
#: Sections of several rows a symbol, and the struct's field that holds them.
LISTED = {"base_rates": "by_horizon", "odds": "by_horizon", "scenarios": "paths", "implied": "by_horizon", "stack": "by_horizon", "text": "events"}

BETAS = "struct<r2: double, share: double, betas: array<struct<leg: string, beta: double>>>"
IMPLIED = "struct<snapshot_ts: string, underlying_price: double, by_horizon: array<struct<months: int, q50: double, iv_atm: double, width_ratio: double, skew_25d: double, density: array<struct<k: double, pdf: double>>>>>"
LEVELS = "struct<current_price: double, poc: double, cheap: struct<lo: double, hi: double>, rich: struct<lo: double, hi: double>>"
ODDS = "struct<by_horizon: array<struct<h: int, q05: double, q25: double, q50: double, q75: double, q95: double, source: string, p_up: double, shrink_w: double>>>"
#: Types of sections that the memo reads, for those that aren't given.
EMPTY = {"exposure": BETAS, "implied": IMPLIED, "levels": LEVELS, "odds": ODDS, "state": "struct<market_cell: string, ticker_cell: string>"}


def odds_of(rates: DataFrame, implied: DataFrame | None = None, stack: DataFrame | None = None) -> DataFrame:
    """symbol, h, five quantiles, source, shrink_w and p_up of base rates (symbol, h, q05 … q95, shrink_w) blended with the other two."""
    five = ("q05", "q25", "q50", "q75", "q95")
    implied = rates.where("false").select("symbol", "h", *five) if implied is None else implied
    return S.odds(S.blend_sources(rates, implied, stack)).select("symbol", "h", *five, "source", "p_up", "shrink_w")


def guarded(rows: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """``rows`` (as_of, implied) with implied nulled where its snapshot is younger than as_of by more than ``tolerance`` days.

    implied_error says why it was nulled. A snapshot too young without any horizon has nothing to leak: it stays, and implied_note
    says so. A snapshot without a readable date is let pass.
    """
    day = F.expr("try_cast(substring(implied.snapshot_ts, 1, 10) AS date)")
    lag = F.datediff(day, "as_of")
    late = F.coalesce(lag > tolerance, F.lit(False))
    data = F.coalesce(F.exists("implied.by_horizon", lambda b: b.isNotNull()), F.lit(False))
    why = F.concat(F.lit("option snapshot of "), day.cast("string"), F.lit(" is "), lag.cast("string"), F.lit(" days younger than as_of "), F.col("as_of").cast("string"))
    x = rows.withColumn("implied_error", F.when(late & data, why)).withColumn("implied_note", F.when(late & ~data, why))
    return x.withColumn("implied", F.when(F.col("implied_error").isNull(), F.col("implied")))


def with_memo(rows: DataFrame) -> DataFrame:
    """``rows`` (symbol, as_of, exposure, odds, state, implied, levels) with the memo's struct, its Markdown as text."""
    at, drivers, by_horizon = F.col("__at"), F.col("__drivers"), F.col("implied.by_horizon")
    x = rows.withColumns({"__at": M.horizon_odds(F.col("odds.by_horizon")), "__drivers": M.determinants(F.col("exposure.betas"))})
    said = M.falsifiers(F.col("symbol"), drivers, F.col("exposure.r2"), at, F.col("state.market_cell"), by_horizon)
    parts = {"posture": M.posture(F.col("symbol"), at), "determinants": drivers, "priced_in": M.priced_in(by_horizon), "zones": M.zones(F.col("levels")), "falsifiers": said}
    x = x.withColumn("memo", F.struct(*(v.alias(k) for k, v in parts.items()))).drop("__at", "__drivers")
    text = M.markdown(F.col("symbol"), F.col("as_of"), F.col("memo"))
    return x.withColumn("memo", F.struct("memo.*", text.alias("text")))


def situations(symbols: DataFrame, one: dict[str, DataFrame], many: dict[str, DataFrame], reasons: dict[str, str] | None = None, sources: list[tuple[str, str]] = (), generated_at: Column | None = None) -> DataFrame:
    """A row a symbol with every key of the contract.

    ``symbols``: symbol and as_of (a date). ``one`` and ``many`` hold sections by name, with one row and several rows a symbol; a section in
    both has the fields of the one and, beside them, its rows. ``reasons`` say why a section isn't given. ``sources``: (provider, note).
    The memo is built here. All sections meet in one grouping.
    """
    reasons = reasons or {}
    if unknown := (set(one) | set(many)) - set(SECTIONS[:-1]):
        raise ValueError(f"no sections of the packet: {', '.join(sorted(unknown))}")
    lists = {f"{name}__rows": df for name, df in many.items()}
    x = gather(symbols.select("symbol", "as_of"), one, lists)
    made = {}
    for name in many:
        rows = F.col(f"{name}__rows")
        own = [F.col(f"{name}.{f}").alias(f) for f in one[name].columns if f != "symbol"] if name in one else []
        there = rows.isNotNull() | (F.col(name).isNotNull() if name in one else F.lit(False))
        made[name] = F.when(there, F.struct(*own, rows.alias(LISTED.get(name, "rows"))))
    given = set(one) | set(many)
    made |= {name: F.lit(None).cast(EMPTY.get(name, "string")) for name in SECTIONS if name != "memo" and name not in given}
    x = with_memo(guarded(x.withColumns(made)))
    missing = lambda n: F.lit(reasons.get(n, "no rows" if n in given else "not built"))
    said = {n: F.coalesce("implied_error", missing(n)) if n == "implied" else missing(n) for n in SECTIONS}
    x = x.withColumns({f"{n}_error": F.when(F.col(n).isNull(), said[n]) for n in SECTIONS})
    errors = F.filter(F.array(*(F.when(F.col(f"{n}_error").isNotNull(), F.struct(F.lit(n).alias("source"), F.col(f"{n}_error").alias("error"))) for n in SECTIONS)), lambda e: e.isNotNull())
    noted = F.filter(F.array(F.when(F.col("implied_note").isNotNull(), F.struct(F.lit("implied").alias("source"), F.col("implied_note").alias("reason")))), lambda e: e.isNotNull())
    status = F.struct(*(F.when(F.col(n).isNull(), "error").otherwise("available").alias(n) for n in SECTIONS))
    listed = F.array(*(F.struct(F.lit(p).alias("provider"), F.lit(n).alias("note")) for p, n in sources)) if sources else F.lit(None).cast("array<struct<provider: string, note: string>>")
    now = F.current_timestamp() if generated_at is None else generated_at
    x = x.withColumn("meta", F.struct(errors.alias("errors"), noted.alias("unavailable"), status.alias("source_status"))).withColumn("sources", F.coalesce(listed, F.array()))
    x = x.withColumns({"ticker": F.col("symbol"), "generated_at": now, "engine": F.lit(ENGINE), "engine_version": F.lit(VERSION)})
    return x.select("symbol", *HEAD, *SECTIONS, *TAIL, *(f"{n}_error" for n in SECTIONS))


def packets(situations_: DataFrame) -> DataFrame:
    """symbol, as_of and the packet as JSON, nulls kept, numbers that are NaN or infinite as nulls."""
    own = [finite(F.col(f.name), f.dataType).alias(f.name) for f in situations_.schema if f.name != "symbol"]
    return situations_.select("symbol", "as_of", F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("packet"))


def summary(situations_: DataFrame, events: int = 5) -> DataFrame:
    """The bounded projection of each packet: posture, falsifiers, what is priced in, zones, exposure, cells, odds by horizon, what is missing."""
    odds = F.transform("odds.by_horizon", lambda o: F.struct(o["h"].alias("h"), o["source"].alias("source"), o["p_up"].alias("p_up"), o["q50"].alias("q50")))
    kinds = {f.name: f.dataType for f in situations_.schema}
    has = lambda n, f: hasattr(kinds[n], "fieldNames") and f in kinds[n].fieldNames()
    gone = F.filter(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in SECTIONS)), lambda n: n.isNotNull())
    return situations_.select(
        "symbol", "as_of", "engine", "engine_version", "memo.posture", "memo.falsifiers", F.transform("memo.priced_in", lambda p: p["text"]).alias("priced_in"), "memo.zones",
        F.struct("exposure.r2", "exposure.share", "exposure.betas").alias("exposure"), "state", odds.alias("odds"),
        (F.coalesce(F.col("stack.published"), F.lit(False)) if has("stack", "published") else F.col("stack").isNotNull()).alias("stack_published"),
        (F.slice("text.events", 1, events) if has("text", "events") else F.lit(None).cast("array<string>")).alias("events"),
        F.substring("memo.text", 1, 1500).alias("memo_excerpt"), gone.alias("unavailable_sections"), "meta.errors",
    )


def markdown(situations_: DataFrame) -> DataFrame:
    """symbol, as_of and the memo as Markdown, built anew where a stored packet has no text."""
    anew = M.markdown(F.col("symbol"), F.col("as_of"), F.col("memo"))
    return situations_.select("symbol", "as_of", F.when(F.length(F.trim("memo.text")) > 0, F.col("memo.text")).otherwise(anew).alias("markdown"))


def _density_problem(block: Column, spot: Column) -> Column:
    """What is wrong with a horizon's density: its area, or its median against q50; null if nothing, or if there is none."""
    d, name = block["density"], F.concat(F.lit("implied["), block["months"].cast("string"), F.lit("]"))
    cells = F.transform(F.sequence(F.lit(2), F.size(d)), lambda i: F.struct(
        F.element_at(d, i - 1)["k"].alias("lo"), F.element_at(d, i)["k"].alias("hi"),
        ((F.element_at(d, i)["pdf"] + F.element_at(d, i - 1)["pdf"]) / 2 * (F.element_at(d, i)["k"] - F.element_at(d, i - 1)["k"])).alias("mass")))
    area = F.aggregate(cells, F.lit(0.0), lambda s, c: s + c["mass"])
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))

    def step(s: Column, c: Column) -> Column:
        share = F.when(c["mass"] > 0, (area / 2 - s["sum"]) / c["mass"]).otherwise(0.0)
        at = F.when(s["at"].isNull() & (s["sum"] + c["mass"] >= area / 2), c["lo"] + share * (c["hi"] - c["lo"])).otherwise(s["at"])
        return F.struct((s["sum"] + c["mass"]).alias("sum"), at.alias("at"))

    median = F.aggregate(cells, start, step)["at"]
    off = F.abs(median / F.when(spot > 0, spot) - 1 - block["q50"])
    wrong = F.when(~area.between(LEAST_AREA, MOST_AREA), F.concat(name, F.lit(": the density's area is "), M.number(area, 3)))
    wrong = wrong.when((area > 0) & (off > MEDIAN_OFF), F.concat(name, F.lit(": the density's median is off q50 by "), M.number(off, 3)))
    return F.when(F.size(d) >= 3, wrong)


def violations(packets_: DataFrame) -> DataFrame:
    """symbol, as_of and problems of packets as JSON: missing keys, a section together with its error, wrong kinds, another engine, densities.

    A text that isn't a JSON object has the one problem of being none.
    """
    body = F.from_json("packet", "map<string,string>")
    x = packets_.withColumn("b", body)
    keys = F.map_keys("b")
    b = lambda k: F.col("b")[k]
    checks = [F.when(~F.array_contains(keys, k), F.lit(f"missing key: {k}")) for k in (*HEAD, *SECTIONS, *TAIL, *(f"{n}_error" for n in SECTIONS))]
    checks += [F.when(b(n).isNotNull() & b(f"{n}_error").isNotNull(), F.lit(f"{n} is there and so is its error")) for n in SECTIONS]
    checks += [F.when(~F.coalesce(b("sources").startswith("["), F.lit(False)), F.lit("sources is no list"))]
    checks += [F.when(~F.coalesce(b("meta").startswith("{"), F.lit(False)), F.lit("meta is no object"))]
    checks += [F.when(~F.coalesce(F.get_json_object(b("meta"), "$.errors").startswith("["), F.lit(False)), F.lit("meta.errors is no list"))]
    checks += [F.when(~b("engine").eqNullSafe(F.lit(ENGINE)), F.lit("another engine"))]
    implied = F.from_json(b("implied"), IMPLIED)
    x = x.withColumn("i", implied)
    dense = F.transform(F.coalesce("i.by_horizon", F.array()), lambda h: _density_problem(h, F.col("i.underlying_price")))
    found = F.filter(F.concat(F.array(*checks), dense), lambda p: p.isNotNull())
    return x.select("symbol", "as_of", F.when(F.col("b").isNull(), F.array(F.lit("no JSON object"))).otherwise(found).alias("problems"))
