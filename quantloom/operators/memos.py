"""What a memo says, as expressions over a packet's sections: drivers, what is priced in, posture, zones, falsifiers, Markdown.

The sections are structs and arrays of one row per symbol; a null section makes what rests on it null or leaves it out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Horizons in months, and the order in which a posture looks for a usable one.
HORIZONS = (1, 2, 3, 6, 12, 18)
PREFERRED = (6, 3, 12, 2, 1, 18)
#: Ratio of the implied to the historic width beyond which it is wider or narrower.
WIDER, NARROWER = 1.15, 0.85
#: Chance of a rise from and up to which the odds lean.
UP, DOWN = 0.58, 0.42


def known(x: Column) -> Column:
    """The number, null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def number(x: Column, places: int = 2) -> Column:
    return F.when(known(x).isNotNull(), F.format_string(f"%.{places}f", x)).otherwise("n/a")


def percent(x: Column, places: int = 1, signed: bool = False) -> Column:
    return F.when(known(x).isNotNull(), F.format_string(f"%{'+' if signed else ''}.{places}f%%", x * 100)).otherwise("n/a")


def determinants(betas: Column, most: int = 6) -> Column:
    """Drivers (name, beta, direction) of an array of (leg, beta), the largest first and ties by name; null betas are left out."""
    usable = F.filter(betas, lambda b: known(b["beta"]).isNotNull())
    keyed = F.transform(usable, lambda b: F.struct((-F.abs(b["beta"])).alias("key"), b["leg"].alias("name"), b["beta"].alias("beta")))
    direction = lambda b: F.when(b["beta"] >= 0, "positive").otherwise("negative")
    return F.transform(F.slice(F.array_sort(keyed), 1, most), lambda b: F.struct(b["name"].alias("name"), b["beta"].alias("beta"), direction(b).alias("direction")))


def width_label(ratio: Column) -> Column:
    """wider, narrower or in_line by the implied over the historic width; null without a ratio."""
    r = known(ratio)
    return F.when(r > WIDER, "wider").when(r < NARROWER, "narrower").when(r.isNotNull(), "in_line")


def priced_in(by_horizon: Column) -> Column:
    """(months, label, text) of the horizons of an array of (months, iv_atm, width_ratio, skew_25d) that have a volatility, by months."""
    usable = F.filter(by_horizon, lambda b: known(b["iv_atm"]).isNotNull())
    keyed = F.array_sort(F.transform(usable, lambda b: F.struct(b["months"].alias("months"), b["iv_atm"].alias("iv"), b["width_ratio"].alias("width"), b["skew_25d"].alias("skew"))))

    def said(b: Column) -> Column:
        label = width_label(b["width"])
        width = F.when(label == "in_line", F.concat(F.lit("as wide as history ("), number(b["width"]), F.lit("x)")))
        width = width.when(label.isNotNull(), F.concat(number(b["width"]), F.lit("x of history, "), label))
        skew = F.when(known(b["skew"]).isNotNull(), F.concat(F.lit("25-delta skew "), number(b["skew"], 3)))
        text = F.concat_ws("; ", F.concat(b["months"].cast("string"), F.lit("m: ATM IV "), percent(b["iv"])), width, skew)
        return F.struct(b["months"].alias("months"), label.alias("label"), text.alias("text"))

    return F.transform(keyed, said)


def zones(levels: Column) -> Column:
    """cheap and rich (pairs of prices), poc and current_price of a levels struct; null without one."""
    return F.when(levels.isNotNull(), F.struct(*(levels[c].alias(c) for c in ("cheap", "rich", "poc", "current_price"))))


def horizon_odds(odds: Column) -> Column:
    """The entry of an array of (h, q50, …) whose horizon comes first in the preferred order and has a median; null if none has."""
    turn = lambda o: F.array_position(F.array(*map(F.lit, PREFERRED)), o["h"])
    usable = F.filter(odds, lambda o: known(o["q50"]).isNotNull() & (turn(o) > 0))
    return F.array_min(F.transform(usable, lambda o: F.struct(turn(o).alias("turn"), o.alias("odds"))))["odds"]


def posture(symbol: Column, at: Column) -> Column:
    """stance, horizon, conviction, p_up, q50 and one_line: how the odds of :func:`horizon_odds` lean, trusted as far as rows stand behind them.

    Conviction is twice the distance of p_up from a half, times 0.4 and 0.6 of shrink_w (null: none). Without usable odds the stance is
    balanced and the conviction 0.
    """
    p, mid = known(at["p_up"]), known(at["q50"])
    stance = F.when((p >= UP) & (mid > 0), "odds_favorable").when((p <= DOWN) & (mid < 0), "odds_unfavorable").otherwise("balanced")
    conviction = F.round(F.coalesce(F.abs(p - 0.5) * 2 * (0.4 + 0.6 * F.coalesce(known(at["shrink_w"]), F.lit(0.0))), F.lit(0.0)), 3)
    line = F.concat(
        symbol, F.lit(": "), F.replace(stance, F.lit("_"), F.lit(" ")), F.lit(" over "), at["h"].cast("string"), F.lit(" months, a rise in "), percent(p, 0),
        F.lit(" of cases, middle move "), percent(mid, signed=True), F.lit(", weight of own history "), number(at["shrink_w"]),
    )
    none = F.concat(symbol, F.lit(": no usable odds, balanced by default"))
    return F.struct(
        stance.alias("stance"), at["h"].alias("horizon"), F.least(F.lit(1.0), conviction).alias("conviction"), p.alias("p_up"), mid.alias("q50"), F.coalesce(line, none).alias("one_line")
    )


def falsifiers(symbol: Column, drivers_: Column, r2: Column, at: Column, market_cell: Column, by_horizon: Column) -> Column:
    """Three conditions that would prove the read wrong: drivers, band of the odds, the market's cell; then implied width and filings.

    ``drivers_`` are of :func:`determinants`, ``at`` is of :func:`horizon_odds`.
    """
    top = F.slice(drivers_, 1, 2)
    drivers = F.when(F.size(top) > 0, F.concat(
        F.lit("The moves of "), symbol, F.lit(" stop following "), F.array_join(F.transform(top, lambda d: d["name"]), " and "), F.lit(" (R² now "), number(r2), F.lit(")")))
    band = F.when((known(at["q05"]) + known(at["q95"])).isNotNull(), F.concat(
        F.lit("The return over "), at["h"].cast("string"), F.lit(" months ends outside "), percent(at["q05"], signed=True), F.lit(" to "), percent(at["q95"], signed=True)))
    cell = F.when(market_cell.isNotNull(), F.concat(F.lit("The market leaves the cell "), market_cell, F.lit(" on which the rates were conditioned")))
    widths = F.array_sort(F.transform(F.filter(by_horizon, lambda b: known(b["width_ratio"]).isNotNull()), lambda b: F.struct(b["months"].alias("months"), b["width_ratio"].alias("ratio"))))
    first = F.get(widths, F.lit(0))
    width = F.when(first.isNotNull(), F.concat(
        F.lit("Volatility over "), first["months"].cast("string"), F.lit(" months comes out far from the implied "), number(first["ratio"]), F.lit("x of history")))
    filing = F.lit("A later filing changes the risk factors or the guidance that the read relies on")
    return F.slice(F.filter(F.array(drivers, band, cell, width, filing, filing, filing), lambda t: t.isNotNull()), 1, 3)


def markdown(symbol: Column, as_of: Column, memo: Column) -> Column:
    """A memo struct (posture, determinants, priced_in, zones, falsifiers) as Markdown; parts without content say so."""
    bullets = lambda items: F.when(F.size(items) > 0, F.concat(F.lit("- "), F.array_join(items, "\n- "))).otherwise("None.")
    drivers = F.transform(memo["determinants"], lambda d: F.concat(d["name"], F.lit(": beta "), number(d["beta"]), F.lit(", "), d["direction"]))
    pair = lambda z: F.when((z["lo"] + z["hi"]).isNotNull(), F.concat(number(z["lo"]), F.lit(" to "), number(z["hi"]))).otherwise("n/a")
    z = memo["zones"]
    levels = F.array(*(F.concat(F.lit(f"{name}: "), text) for name, text in (
        ("cheap", pair(z["cheap"])), ("rich", pair(z["rich"])), ("point of control", number(z["poc"])), ("price", number(z["current_price"])))))
    parts = [
        F.concat(F.lit("# "), symbol, F.lit(" as of "), as_of.cast("string")), memo["posture"]["one_line"],
        F.lit("## Drivers"), bullets(drivers), F.lit("## Priced in"), bullets(F.transform(memo["priced_in"], lambda p: p["text"])),
        F.lit("## Zones"), bullets(levels), F.lit("## What would prove it wrong"), bullets(memo["falsifiers"]),
    ]
    return F.concat_ws("\n\n", *parts)
