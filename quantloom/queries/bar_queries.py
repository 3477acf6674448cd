"""Queries over daily bars."""

from __future__ import annotations

from quantloom.operators import bars as B
from quantloom.operators import indicators as I
from quantloom.queries import Catalog
from quantloom.queries.sql import BARS, RETURNS, SMOOTH, TRADES
from quantloom.sources import tables

W = "OVER (PARTITION BY symbol ORDER BY date"
AGE = "row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS age"


def frame(n: int) -> str:
    return f"{W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def register(c: Catalog) -> None:
    def smooth(name: str, op, columns: str, sql: str = "", ctes: str = SMOOTH, **kw) -> None:
        c.add(name, lambda s, d: op(tables.bars_smooth(s, d), **kw), columns, ctes if sql else "", sql)

    def raw(name: str, op, columns: str, sql: str, ctes: str = BARS) -> None:
        c.add(name, lambda s, d: op(tables.bars(s, d)), columns, ctes, sql)

    levels = f"""SELECT symbol, max(high) FILTER (age > 1) AS vah, min(low) FILTER (age > 1) AS val, quantile_cont(close, 0.5) FILTER (age > 1) AS poc,
        max_by(close, date) AS close, max(date) AS date FROM (SELECT *, {AGE} FROM bars) WHERE age <= 22 GROUP BY symbol"""
    raw("auction_levels", B.auction_levels, "symbol ~vah ~val ~poc ~close date", levels)
    raw("auction_location", B.auction_location, "symbol date location ~poc_distance", f"""SELECT *, close / poc - 1 AS poc_distance,
        CASE WHEN close > vah THEN 'above value' WHEN close < val THEN 'below value' ELSE 'inside value' END AS location FROM ({levels})""")  # fmt: skip
    c.add("clean_bars", lambda s, d: B.clean(tables.trades(s, d).selectExpr("symbol", "date", "price AS open", "price AS high", "price AS low", "if(size > 48, null, price) AS close", "if(size > 45, null, size) AS volume", "seq")),
          "symbol date open close volume", TRADES, "SELECT symbol, date, max_by(price, seq) AS open, max_by(price, seq) AS close, max_by(coalesce(CASE WHEN size > 45 THEN NULL ELSE size END, 0.0), seq) AS volume FROM trades WHERE size <= 48 GROUP BY ALL")
    smooth("trailing_window", lambda b: B.trailing(b, 21), "symbol date age:long ~close", f"SELECT * FROM (SELECT *, {AGE} FROM bars) WHERE age <= 21")
    smooth("month_map", B.month_map, "symbol year month ~pct", """SELECT symbol, year, month, pct FROM (SELECT *, max(year) OVER (PARTITION BY symbol) AS newest FROM (
        SELECT symbol, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, sum(ret) * 100 AS pct FROM rets GROUP BY ALL)) WHERE year > newest - 10""", SMOOTH + ", " + RETURNS)  # fmt: skip
    months = SMOOTH + """, m0 AS (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, max_by(close, date) AS close FROM bars GROUP BY ALL),
        m1 AS (SELECT * FROM (SELECT *, max(month) OVER (PARTITION BY symbol) AS newest FROM m0) WHERE month < newest),
        months AS (SELECT symbol, month, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY month) - 1 AS ret FROM m1)"""  # fmt: skip
    smooth("month_end_returns", B.month_ends, "symbol month ~close ~ret", "SELECT * FROM months", months)
    smooth("seasonal_month_stats", B.seasonal_stats, "symbol m:int years:int ~mean ~median n:long ~hit", """SELECT symbol, month(month) AS m, years, avg(ret) AS mean, quantile_cont(ret, 0.5) AS median, count(*) AS n, avg(CAST(ret > 0 AS INTEGER)) AS hit
        FROM (SELECT *, max(year(month)) OVER (PARTITION BY symbol) AS newest_year FROM months WHERE ret IS NOT NULL), unnest([1, 2, 5, 10]) AS w(years) WHERE year(month) >= newest_year - years GROUP BY ALL""", months)  # fmt: skip
    smooth("forward_month_stats", B.forward_stats, "symbol m:int h:int ~mean ~median n:long ~hit ~p10 ~p90", """SELECT symbol, m, h, avg(ret) AS mean, quantile_cont(ret, 0.5) AS median, count(*) AS n, avg(CAST(ret > 0 AS INTEGER)) AS hit, quantile_cont(ret, 0.1) AS p10, quantile_cont(ret, 0.9) AS p90 FROM (
        SELECT a.symbol, (a.i + 1) % 12 + 1 AS m, h, b.close / a.close - 1 AS ret FROM (SELECT *, year(month) * 12 + month(month) - 1 AS i FROM months) a, unnest([1, 2, 3, 6, 12, 18]) AS t(h)
        JOIN (SELECT *, year(month) * 12 + month(month) - 1 AS i FROM months) b ON a.symbol = b.symbol AND b.i = a.i + h) GROUP BY ALL""", months)  # fmt: skip
    rets = SMOOTH + ", " + RETURNS
    smooth("volatility_table", B.volatility_table, "symbol ~price ~daily ~annual ~week_range ~month_range", "SELECT *, daily * sqrt(252) AS annual, price * daily * sqrt(5) AS week_range, price * daily * sqrt(21) AS month_range FROM (SELECT symbol, max_by(close, date) AS price, stddev_samp(ret) AS daily FROM rets GROUP BY symbol)", rets)
    smooth("drawdown", B.drawdown, "symbol ~total_return ~max_drawdown ~annual_volatility", f"SELECT symbol, max_by(close, date) / min_by(close, date) - 1 AS total_return, min(dd) AS max_drawdown, stddev_samp(ret) * sqrt(252) AS annual_volatility FROM (SELECT *, close / max(close) {W} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM rets) GROUP BY symbol", rets)
    smooth("portfolio_vs_benchmark", B.portfolio, "date ~portfolio ~benchmark", """SELECT v.date, portfolio, 30000 * b.close / b0 AS benchmark FROM
        (SELECT date, sum(10000 * close / c0) AS portfolio FROM (SELECT *, first_value(close) OVER (PARTITION BY symbol ORDER BY date) AS c0 FROM bars
            WHERE symbol IN ('Brand#11', 'Brand#12', 'Brand#13') AND date IN (SELECT date FROM bars WHERE symbol = 'Brand#11')) GROUP BY date) v
        JOIN (SELECT date, close FROM bars WHERE symbol = 'Brand#21') b ON v.date = b.date,
        (SELECT min_by(b.close, b.date) AS b0 FROM bars a JOIN bars b ON a.date = b.date WHERE a.symbol = 'Brand#11' AND b.symbol = 'Brand#21')""", holdings=["Brand#11", "Brand#12", "Brand#13"], benchmark="Brand#21")  # fmt: skip
    smooth("price_extremes", B.price_extremes, "symbol ~high_252 ~low_252 ~high_21 ~low_21", f"SELECT symbol, max(high) AS high_252, min(low) AS low_252, max(high) FILTER (age <= 21) AS high_21, min(low) FILTER (age <= 21) AS low_21 FROM (SELECT *, {AGE} FROM bars) WHERE age <= 252 GROUP BY symbol")
    perf = ", ".join(f"max(close) FILTER (age = 1) / max(close) FILTER (age = least({k + 1}, n)) - 1 AS ret_{k}" for k in (5, 21, 63, 126, 252, 504))
    smooth("performance_metrics", B.performance, "symbol ~ret_5 ~ret_21 ~ret_63 ~ret_126 ~ret_252 ~ret_504 ~from_high ~from_low", f"""SELECT symbol, {perf}, max(close) FILTER (age = 1) / max(close) FILTER (age <= 252) - 1 AS from_high, max(close) FILTER (age = 1) / min(close) FILTER (age <= 252) - 1 AS from_low
        FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT *, {AGE} FROM bars) WHERE age <= 505) GROUP BY symbol""")  # fmt: skip
    vols = ", ".join(f"stddev_samp(ret) FILTER (age <= {k}) * sqrt(252) AS vol_{k}, avg(abs(ret)) FILTER (age <= {k}) AS move_{k}" for k in (21, 63, 252))
    smooth("volatility_windows", B.volatility_windows, "symbol ~vol_21 ~vol_63 ~vol_252 ~move_21 ~move_63 ~move_252", f"SELECT symbol, {vols} FROM (SELECT *, {AGE} FROM rets) GROUP BY symbol", rets)
    sma = ", ".join(f"CASE WHEN count(close) {frame(n)} >= {n} THEN avg(close) {frame(n)} END AS sma_{n}" for n in (20, 50, 200))
    smooth("sma_stack", B.sma_stack, "symbol date ~~sma_20 ~~sma_50 ~~sma_200", f"SELECT symbol, date, {sma} FROM bars")
    c.add("rolling_sigma", lambda s, d: B.rolling_sigma(tables.bars_smooth(s, d)).selectExpr("symbol", "date", "round(sigma, 4) AS sigma"), "symbol date ~sigma", SMOOTH, f"SELECT symbol, date, round(stddev_pop(close) {frame(20)}, 4) AS sigma FROM bars")
    smooth("vwma", B.vwma, "symbol date ~vwma", f"SELECT symbol, date, sum(close * volume) {frame(20)} / nullif(sum(volume) {frame(20)}, 0) AS vwma FROM bars")
    smooth("normalized_score", B.normalized_score, "symbol date ~score", f"SELECT symbol, date, coalesce((close - lo) / nullif(hi - lo, 0) * 100, 50) AS score FROM (SELECT *, min(close) {frame(100)} AS lo, max(close) {frame(100)} AS hi FROM bars)")
    smooth("bars_since_trend_off", lambda b: B.bars_since_off(b, 1, 3), "symbol date trend_on since_off:long", f"""SELECT symbol, date, trend_on, rn - last_value(CASE WHEN NOT trend_on THEN rn END IGNORE NULLS) {W} ROWS UNBOUNDED PRECEDING) AS since_off
        FROM (SELECT *, close > avg(close) {frame(3)} AS trend_on, row_number() {W}) AS rn FROM bars)""")  # fmt: skip
    line = f"(SELECT *, CAST(row_number() {W}) - 1 AS DOUBLE) AS i FROM bars)"
    smooth("regression_channel", B.regression_channel, "symbol date ~trend ~upper ~lower", f"""SELECT symbol, date, trend, trend + band AS upper, trend - band AS lower FROM (SELECT *, stddev_pop(close - trend) OVER (PARTITION BY symbol) AS band FROM (
        SELECT *, intercept + slope * i AS trend FROM {line} JOIN (SELECT symbol, regr_slope(close, i) AS slope, regr_intercept(close, i) AS intercept FROM {line} GROUP BY symbol) USING (symbol)))""")  # fmt: skip
    smooth("regression_direction", B.regression_direction, "symbol n:long ~slope direction", f"SELECT *, CASE WHEN n < 3 THEN 'flat' WHEN slope > 0 THEN 'up' WHEN slope < 0 THEN 'down' ELSE 'flat' END AS direction FROM (SELECT symbol, count(*) AS n, regr_slope(close, i) AS slope FROM {line} GROUP BY symbol)")
    logs = SMOOTH + f""", lr AS (SELECT symbol, date, close, ln(close / lag(close) {W})) AS lr FROM bars),
        vols AS (SELECT symbol, date, close, CASE WHEN count(lr) {frame(21)} >= 21 THEN stddev_samp(lr) {frame(21)} * sqrt(252) END AS vol FROM lr)"""  # fmt: skip
    smooth("log_volatility", B.log_volatility, "symbol date ~vol", "SELECT * FROM vols", logs)
    smooth("realized_vol_percentile", B.volatility_percentile, "symbol ~vol ~mean ~pct", "SELECT symbol, max(now) AS vol, avg(vol) AS mean, CASE WHEN count(*) >= 30 THEN avg(CAST(vol <= now AS INTEGER)) END AS pct FROM (SELECT *, last_value(vol) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS now FROM vols WHERE vol IS NOT NULL) GROUP BY symbol", logs)
    cell = logs + f""", cells AS (SELECT symbol, date, close, CASE WHEN med IS NOT NULL AND trend IS NOT NULL THEN CASE WHEN vol > med THEN 'highvol_' ELSE 'lowvol_' END || CASE WHEN trend > 0 THEN 'up' ELSE 'down' END END AS cell FROM (
        SELECT *, CASE WHEN count(vol) {frame(504)} >= 63 THEN quantile_cont(vol, 0.5) {frame(504)} END AS med, close / lag(close, 252) {W}) - close / lag(close, 21) {W}) AS trend FROM vols))"""  # fmt: skip
    smooth("cells", B.cells, "symbol date cell", "SELECT * FROM cells", cell)
    smooth("vol_by_cell", lambda b: I.volatility_by_cell(b), "symbol cell ~mean ~median n:long", "SELECT symbol, cell, avg(vol) AS mean, quantile_cont(vol, 0.5) AS median, count(vol) AS n FROM cells JOIN vols USING (symbol, date) WHERE cell IS NOT NULL GROUP BY ALL", cell)
    bounds = " UNION ALL ".join(f"SELECT symbol, {h} AS h, lead(close, {h}) {W}) / close - 1 AS r FROM bars" for h in (21, 42, 63, 126, 252))
    smooth("return_bounds", B.return_bounds, "symbol h:int ~p05 ~p95 n:long", f"SELECT symbol, h, quantile_cont(r, 0.05) AS p05, quantile_cont(r, 0.95) AS p95, count(r) AS n FROM ({bounds}) WHERE r IS NOT NULL GROUP BY ALL HAVING count(r) >= 20")
    smooth("scanner_rank", B.scanner, "symbol ~price ~score rank:long", f"""SELECT *, row_number() OVER (ORDER BY score DESC, symbol) AS rank FROM (SELECT symbol, price, round(trend * 100 + change + (price / high - 1) * 25 - vol * 5, 6) AS score FROM (
        SELECT symbol, max(close) FILTER (age = 1) AS price, max(ret) FILTER (age = 1) * 100 AS change, max(high) AS high, stddev_samp(ret) * sqrt(252) AS vol, max(close) FILTER (age = 1) / avg(close) FILTER (age <= 50) - 1 AS trend
        FROM (SELECT rets.*, high, {AGE} FROM rets JOIN bars USING (symbol, date)) WHERE age <= 252 GROUP BY symbol))""", rets)  # fmt: skip
    smooth("decimate_minmax", B.decimate, "symbol date ~close", """SELECT symbol, date, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, b ORDER BY close, date) AS lo, row_number() OVER (PARTITION BY symbol, b ORDER BY close DESC, date) AS hi FROM (
        SELECT *, ntile(50) OVER (PARTITION BY symbol ORDER BY date) AS b, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS age FROM bars)) WHERE lo = 1 OR hi = 1 OR rn = 1 OR age = 1""")  # fmt: skip
    smooth("ohlcv_aggregate_k", B.aggregate_k, "symbol g:long date ~open ~high ~low ~close ~volume", f"SELECT symbol, g, min(date) AS date, min_by(open, date) AS open, max(high) AS high, min(low) AS low, max_by(close, date) AS close, sum(volume) AS volume FROM (SELECT *, (row_number() {W}) - 1) // 5 AS g FROM bars) GROUP BY symbol, g")
    # recursive indicators: the SQL folds each symbol's closes row by row
    folded = SMOOTH + f""", n AS (SELECT *, row_number() {W}) AS rn FROM bars)"""
    ema = ", ".join(f"e.e{k} + 2.0 / {k + 1} * (n.close - e.e{k}) AS e{k}" for k in (21, 50, 200))
    c.add("ema_stack", lambda s, d: I.ema_stack(tables.bars_smooth(s, d)), "symbol date ~ema_21 ~ema_50 ~ema_200")
    c.sql["ema_stack"] = f"""WITH RECURSIVE {folded}, e AS (SELECT symbol, date, rn, close AS e21, close AS e50, close AS e200 FROM n WHERE rn = 1
        UNION ALL SELECT n.symbol, n.date, n.rn, {ema} FROM e JOIN n ON n.symbol = e.symbol AND n.rn = e.rn + 1)
        SELECT symbol, date, round(e21, 6) AS ema_21, round(e50, 6) AS ema_50, round(e200, 6) AS ema_200 FROM e"""  # fmt: skip
    c.add("rsi14", lambda s, d: I.rsi(tables.bars_smooth(s, d)), "symbol date ~rsi")
    c.sql["rsi14"] = f"""WITH RECURSIVE {folded}, d AS (SELECT symbol, date, rn, close - lag(close) {W}) AS x FROM n),
        e AS (SELECT symbol, date, rn, greatest(x, 0.0) AS g, greatest(-x, 0.0) AS l FROM d WHERE rn = 2
        UNION ALL SELECT d.symbol, d.date, d.rn, e.g + (greatest(d.x, 0.0) - e.g) / 14, e.l + (greatest(-d.x, 0.0) - e.l) / 14 FROM e JOIN d ON d.symbol = e.symbol AND d.rn = e.rn + 1)
        SELECT n.symbol, n.date, round(CASE WHEN e.rn >= 15 THEN CASE WHEN g = 0 AND l = 0 THEN 50.0 WHEN l = 0 THEN 100.0 WHEN g = 0 THEN 0.0 ELSE 100 - 100 / (1 + g / l) END ELSE 50.0 END, 6) AS rsi
        FROM n LEFT JOIN e ON n.symbol = e.symbol AND n.rn = e.rn"""  # fmt: skip
    c.add("ema_crossovers", lambda s, d: I.crossovers(tables.bars_smooth(s, d)), "symbol date direction rank:long")
    c.sql["ema_crossovers"] = f"""WITH RECURSIVE {folded}, e AS (SELECT symbol, date, rn, close AS f, close AS s FROM n WHERE rn = 1
        UNION ALL SELECT n.symbol, n.date, n.rn, e.f + 2.0 / 22 * (n.close - e.f), e.s + 2.0 / 56 * (n.close - e.s) FROM e JOIN n ON n.symbol = e.symbol AND n.rn = e.rn + 1),
        x AS (SELECT symbol, date, CAST(sign(f - s) AS INTEGER) AS sg, lag(CAST(sign(f - s) AS INTEGER)) {W}) AS before FROM e)
        SELECT symbol, date, direction, rank FROM (SELECT symbol, date, CASE WHEN sg > 0 THEN 'up' ELSE 'down' END AS direction, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rank FROM x WHERE sg * before < 0) WHERE rank <= 5"""  # fmt: skip
    c.add("flow_compass", lambda s, d: I.flow_compass(tables.bars_smooth(s, d)), "symbol date ~flow_score ~signal state fresh_long fresh_short")
    c.add("ridge_strategy", lambda s, d: I.ridge_strategy(tables.bars_smooth(s, d)), "symbol state recommendation ~ending_equity ~total_return ~max_drawdown closed_trades:int ~win_rate")
