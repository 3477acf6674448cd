"""Queries over the eigen section, on signals made of each brand's own bars and the market's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import bars as B
from quantloom.operators import cross as X
from quantloom.operators import eigen as E
from quantloom.plans import eigen
from quantloom.queries import Catalog
from quantloom.queries.forecast_queries import MARKET
from quantloom.queries.pool_queries import MONTHS
from quantloom.queries.sql import RETURNS, SMOOTH
from quantloom.sources import tables

NAMES = ["market", "month", "range", "reversal", "volume"]


def signals(bars: DataFrame) -> DataFrame:
    """symbol, date, signal, x: the market's return, a month's, the day's range, the last return and the change of volume."""
    w = B.by()
    r = B.with_returns(bars)
    market = r.where(F.col("symbol") == MARKET).select("date", F.col("ret").alias("market"))  # a row a date
    x = r.select(
        "symbol", "date", (F.col("close") / F.lag("close", 21).over(w) - 1).alias("month"), F.ln(F.col("high") / F.col("low")).alias("range"),
        F.lag("ret").over(w).alias("reversal"), F.ln(F.col("volume") / F.lag("volume").over(w)).alias("volume"),
    ).join(F.broadcast(market), "date", "left")
    return x.select("symbol", "date", F.expr(f"stack({len(NAMES)}, {', '.join(f'{chr(39)}{n}{chr(39)}, {n}' for n in NAMES)}) AS (signal, x)"))


#: Signals by row, and beside them the target.
ROWS = SMOOTH + ", " + RETURNS + f""",
made AS (
    SELECT b.symbol, b.date, r.ret, b.close / lag(b.close, 21) OVER w - 1 AS month, ln(b.high / b.low) AS range, lag(r.ret) OVER w AS reversal,
           ln(b.volume / lag(b.volume) OVER w) AS volume
    FROM bars b JOIN rets r ON r.symbol = b.symbol AND r.date = b.date WINDOW w AS (PARTITION BY b.symbol ORDER BY b.date)),
sig AS (SELECT made.*, m.ret AS market FROM made LEFT JOIN (SELECT date, ret FROM rets WHERE symbol = '{MARKET}') m ON m.date = made.date)"""
LONG = ROWS + """,
aged AS (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS age,
           CASE WHEN count(ret) OVER nx = 21 THEN exp(sum(ln(1 + ret)) OVER nx) - 1 END AS nxt
    FROM sig WHERE ret IS NOT NULL WINDOW nx AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING)),
long AS (SELECT * FROM aged UNPIVOT INCLUDE NULLS (x FOR signal IN (market, month, range, reversal, volume)))"""
_C = "CASE WHEN count(CASE WHEN {on} AND {y} IS NOT NULL THEN x END) >= 20 THEN corr(CASE WHEN {on} THEN x END, CASE WHEN {on} THEN {y} END) END AS {name}"
RANKED = ("SELECT symbol, signal, " + ", ".join(_C.format(on=f"age <= {k}", y="ret", name=f"corr_{k}") for k in (252, 126, 63)) + ", " + _C.format(on="true", y="nxt", name="forward_corr")
          + ", count(x) AS n FROM long GROUP BY symbol, signal")
WHOLE = ROWS + """,
whole AS (SELECT * FROM sig WHERE ret + market + month + range + reversal + volume IS NOT NULL),
r AS (
    SELECT symbol, signal, corr(x, ret) AS r FROM whole UNPIVOT (x FOR signal IN (market, month, range, reversal, volume)) GROUP BY symbol, signal),
base AS (SELECT symbol, signal, r * r / sum(r * r) OVER (PARTITION BY symbol) AS w FROM r)"""


def register(c: Catalog) -> None:
    smooth = tables.bars_smooth
    made = lambda s, d: tables.written(smooth(s, d))

    c.add("eigen_axes", lambda s, d: E.axes(signals(smooth(s, d)), NAMES).select("symbol", "n", F.posexplode(F.arrays_zip("eigenvalues", "shares"))).select("symbol", "n", (F.col("pos") + 1).alias("component"), "col.*"), "symbol n:int component:int ~eigenvalues ~shares")

    def ranked(s, d):
        b = made(s, d)
        return E.ranking(signals(b), X.returns(b), NAMES)

    c.add("eigen_ranking", ranked, "symbol signal ~corr_252 ~corr_126 ~corr_63 ~forward_corr n:long rank:int", LONG, f"""
        SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY coalesce(abs(CASE WHEN has > 0 THEN corr_252 ELSE forward_corr END), 0) DESC, signal) AS rank
        FROM (SELECT *, count(corr_252) OVER (PARTITION BY symbol) AS has FROM ({RANKED}))""")

    names = [(a, b) for a in NAMES for b in NAMES if a < b]
    per = " UNION ALL ".join(f"SELECT symbol, cell, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS c, count(*) AS n FROM of GROUP BY symbol, cell" for a, b in names)

    def flips(s, d):
        b = made(s, d)
        return E.symmetry(signals(b), B.cells(b).withColumnRenamed("cell", "label"), NAMES, least_corr=0.02)

    c.add("eigen_symmetry", flips, "symbol a b regimes:int ~lo ~hi ~spread state", MONTHS.split(",\ncm AS")[0] + ", " + ROWS.removeprefix(SMOOTH + ", ") + f""",
of AS (SELECT sig.*, cell FROM sig JOIN cells ON cells.symbol = sig.symbol AND cells.date = sig.date WHERE cell IS NOT NULL AND market + month + range + reversal + volume IS NOT NULL),
per AS ({per}),
agg AS (
    SELECT symbol, a, b, count(c) AS regimes, min(c) AS lo, max(c) AS hi, max(c) - min(c) AS spread, min(abs(c)) AS weakest
    FROM per WHERE n >= 30 GROUP BY ALL HAVING count(c) > 1)""",
          """SELECT *, CASE WHEN lo < 0 AND hi > 0 AND weakest >= 0.02 THEN 'broken' WHEN NOT (lo < 0 AND hi > 0) AND spread <= 0.25 THEN 'invariant' ELSE 'mixed' END AS state FROM agg""")  # fmt: skip

    def load(weigh):
        def run(s, d):
            b = made(s, d)
            return E.load_bearing(E.candidates(signals(b), X.returns(b), NAMES), weigh)

        return run

    shown = "symbol signal ~baseline ~delta ~survivor_delta load_bearing"
    c.add("eigen_load", load(E.by_strength), shown, WHOLE, """
        SELECT d.symbol, d.signal, d.w AS baseline, d.w + sum(abs(b.w / (1 - d.w) - b.w)) AS delta, 0.0 AS survivor_delta, false AS load_bearing
        FROM base d JOIN base b ON b.symbol = d.symbol AND b.signal <> d.signal GROUP BY d.symbol, d.signal, d.w""")
    c.add("eigen_load_ridge", load(E.by_ridge()), shown + " rank:int")

    def section(s, d):
        b = made(s, d)
        return eigen.section(signals(b), X.returns(b), NAMES, B.cells(b).withColumnRenamed("cell", "label"), E.by_ridge())

    c.add("eigen_section", lambda s, d: section(s, d).select("symbol", *(F.to_json(n).alias(n) for n in ("pca", "ranking", "symmetry", "load_bearing"))), "symbol pca ranking symmetry load_bearing")
