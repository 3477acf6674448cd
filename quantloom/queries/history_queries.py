"""Queries over settled forecasts, signal ranks, spells, recent windows, statement trends and smiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import bars as B
from quantloom.operators import cross as X
from quantloom.operators import fundamentals as Q
from quantloom.operators import history as H
from quantloom.operators import options as O
from quantloom.queries import Catalog
from quantloom.queries.bar_queries import AGE, W, frame
from quantloom.queries.sql import CONTRACTS, QUARTERS, RETURNS, SMOOTH
from quantloom.sources import tables

REF = "Brand#11"
#: Momentum over 21 rows as a signal, and its sign as a label.
SIGNALS = f"sig AS (SELECT * FROM (SELECT symbol, date, close, close / lag(close, 21) {W}) - 1 AS x FROM bars) WHERE x IS NOT NULL), labels AS (SELECT symbol, date, CASE WHEN x > 0 THEN 'up' ELSE 'down' END AS label FROM sig)"
#: Figures that the test tables lack, from those they have.
STATEMENTS = """SELECT *, operating_income + 0.05 * revenue AS ebitda, operating_income * 0.7 AS net_income, operating_income * 0.7 / 1000 AS eps, 0.01 * revenue AS interest, 4 * revenue AS total_assets, revenue AS total_debt,
    0.5 * revenue AS cash, CAST(NULL AS DOUBLE) AS investments, 2 * revenue AS equity, CAST(1000 AS DOUBLE) AS shares, cfo - abs(capex) AS fcf FROM {quarters}"""
PRICES = "SELECT DISTINCT symbol, CASE WHEN symbol LIKE 'A%' THEN NULL ELSE 50.0 END AS price, 40000.0 AS vendor_cap FROM {quarters}"
PROVIDED = "SELECT DISTINCT symbol, p.ratio, p.value FROM {quarters}, (SELECT 'pe' AS ratio, 20.0 AS value UNION ALL SELECT 'dividend_yield', 0.02) p"
POINTS = "SELECT underlying, expiry, strike, CASE WHEN strike % 10 = 0 THEN 'call' ELSE 'put' END AS type, mark / 50 AS iv, CASE WHEN strike % 10 = 0 THEN 0.6 - strike / 500 ELSE strike / -500 - 0.1 END AS delta FROM {contracts}"


def signals(bars):
    return bars.withColumn("x", F.col("close") / F.lag("close", 21).over(B.by()) - 1).where("x is not null").select("symbol", "date", "x")


def labels(bars):
    return signals(bars).select("symbol", "date", F.when(F.col("x") > 0, "up").otherwise("down").alias("label"))


def register(c: Catalog) -> None:
    def smooth(name: str, op, columns: str, sql: str, ctes: str = SMOOTH) -> None:
        c.add(name, lambda s, d: op(tables.bars_smooth(s, d)), columns, ctes, sql)

    outcome = f"row_number() {W}) AS rn, lead(close, 21) {W}) / close - 1 AS realized"
    carried = f"last_value({{}} IGNORE NULLS) {W} ROWS UNBOUNDED PRECEDING)"
    sig = SMOOTH + ", " + SIGNALS
    past = "OVER (PARTITION BY symbol, {} ORDER BY rn RANGE BETWEEN UNBOUNDED PRECEDING AND 21 PRECEDING)"
    mean = lambda k, n: f"CASE WHEN count(realized) {past.format(k)} >= {n} THEN avg(realized) {past.format(k)} END"
    smooth("settled_means", lambda b: H.settled_means(b, labels(b)), "symbol date ~seasonal ~by_label ~realized", f"SELECT symbol, date, seasonal, CASE WHEN label IS NOT NULL THEN by_label END AS by_label, realized FROM (SELECT *, {mean('month(date)', 3)} AS seasonal, {mean('label', 20)} AS by_label FROM (SELECT b.symbol, b.date, realized, rn, {carried.format('label').replace('symbol', 'b.symbol').replace('date', 'b.date')} AS label FROM (SELECT *, {outcome} FROM bars) b LEFT JOIN labels l ON l.symbol = b.symbol AND l.date = b.date)) WHERE realized IS NOT NULL", sig)
    own = f"{W} ROWS BETWEEN UNBOUNDED PRECEDING AND 21 PRECEDING)"
    smooth("settled_lines", lambda b: H.settled_lines(b, signals(b)), "symbol date ~predicted ~realized", f"SELECT symbol, date, CASE WHEN k >= 252 THEN base + slope * x END AS predicted, realized FROM (SELECT *, regr_count(realized, x) {own} AS k, regr_slope(realized, x) {own} AS slope, regr_intercept(realized, x) {own} AS base FROM (SELECT b.symbol, b.date, realized, x FROM (SELECT *, {outcome} FROM bars) b LEFT JOIN sig l ON l.symbol = b.symbol AND l.date = b.date)) WHERE realized IS NOT NULL", sig)
    wm = "OVER (PARTITION BY symbol ORDER BY month"
    panel = SMOOTH + f""", m0 AS (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, max_by(close, date) AS close FROM bars GROUP BY ALL),
        m1 AS (SELECT *, close / lag(close) {wm}) - 1 AS ret FROM (SELECT *, max(month) OVER (PARTITION BY symbol) AS newest FROM m0) WHERE month < newest),
        panel AS (SELECT * FROM (SELECT symbol, month, lag(close, 1) {wm}) / lag(close, 12) {wm}) - 1 AS mom, stddev_samp(ret) {wm} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS vol, lead(close) {wm}) / close - 1 AS target FROM m1) WHERE mom IS NOT NULL AND target IS NOT NULL AND vol IS NOT NULL)"""
    ws = "OVER (PARTITION BY symbol, sign(mom) ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    signed = f"SELECT symbol, month, sign(mom) AS side, CASE WHEN count(target) {ws} >= 3 THEN avg(target) {ws} END AS predicted, target AS realized FROM panel"
    smooth("signed_means", lambda b: H.signed_means(X.monthly_panel(b)), "symbol month side:int ~predicted ~realized", signed, panel)
    smooth("split_half", lambda b: H.split_half(H.signed_means(X.monthly_panel(b)).where("predicted is not null").withColumnRenamed("realized", "actual"), "symbol"), "symbol months:long ~coverage ~width n_late:long", f"""SELECT symbol, max(n) AS months,
        CASE WHEN max(n) >= 8 AND max(k) >= 10 THEN avg(CAST(actual BETWEEN predicted + lo AND predicted + hi AS INTEGER)) FILTER (NOT early) END AS coverage, CASE WHEN max(n) >= 8 AND max(k) >= 10 THEN max(hi) - max(lo) END AS width, count(*) FILTER (NOT early) AS n_late
        FROM (SELECT *, quantile_cont(CASE WHEN early THEN actual - predicted END, 0.25) OVER w AS lo, quantile_cont(CASE WHEN early THEN actual - predicted END, 0.75) OVER w AS hi, count(*) FILTER (early) OVER w AS k FROM (
        SELECT symbol, month, predicted, realized AS actual, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY month) <= count(*) OVER (PARTITION BY symbol) // 2 + 1 AS early FROM ({signed}) WHERE predicted IS NOT NULL)
        WINDOW w AS (PARTITION BY symbol)) GROUP BY symbol""", panel)  # fmt: skip
    rets = SMOOTH + ", " + RETURNS
    others = lambda b: X.returns(b).where(F.col("symbol") != REF).select(F.col("symbol").alias("signal"), "date", F.col("ret").alias("x"))
    base = f", tg AS (SELECT date, ret FROM rets WHERE symbol = '{REF}' AND ret IS NOT NULL), sg AS (SELECT symbol AS signal, date, ret AS x FROM rets WHERE symbol <> '{REF}' AND ret IS NOT NULL), base AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS age, CASE WHEN count(ret) OVER n = 21 THEN exp(sum(ln(1 + ret)) OVER n) - 1 END AS next FROM tg SEMI JOIN sg USING (date) WINDOW n AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING))"
    shown = ", ".join(f"CASE WHEN count(*) FILTER (age <= {k}) >= 20 THEN corr(x, ret) FILTER (age <= {k}) END AS corr_{k}" for k in (252, 126, 63))
    smooth("rank_signals", lambda b: H.rank_signals(others(b), X.returns(b).where(F.col("symbol") == REF).select("date", "ret")), "signal ~corr_252 ~corr_126 ~corr_63 ~forward_corr n:long rank:long", f"SELECT *, row_number() OVER (ORDER BY coalesce(abs(corr_252), 0) DESC, signal) AS rank FROM (SELECT signal, {shown}, CASE WHEN count(next) >= 20 THEN corr(x, next) END AS forward_corr, count(*) AS n FROM sg JOIN base USING (date) GROUP BY signal)", rets + base)
    smooth("beta_trend", lambda b: H.trend_label(X.rolling_beta(b, REF), "beta"), "symbol ~slope n:long trend", f"SELECT symbol, slope, n, CASE WHEN n < 5 OR slope IS NULL THEN 'flat' WHEN slope > 1e-4 THEN 'rising' WHEN slope < -1e-4 THEN 'falling' ELSE 'flat' END AS trend FROM (SELECT symbol, regr_slope(beta, -age) AS slope, count(*) AS n FROM (SELECT *, {AGE} FROM (SELECT symbol, date, CASE WHEN count(*) {frame(63)} >= 63 THEN covar_samp(ret, ref) {frame(63)} / nullif(var_samp(ref) {frame(63)}, 0) END AS beta FROM vs) WHERE beta IS NOT NULL) WHERE age <= 63 GROUP BY symbol)", rets + f", vs AS (SELECT a.symbol, a.date, a.ret, b.ret AS ref FROM rets a JOIN rets b ON a.date = b.date AND b.symbol = '{REF}' WHERE a.symbol <> '{REF}' AND a.ret IS NOT NULL AND b.ret IS NOT NULL)")
    weights = f", wt AS (SELECT symbol, r2 / sum(r2) OVER () AS weight FROM (SELECT symbol, corr(a.ret, b.ret) ** 2 AS r2 FROM rets a JOIN (SELECT date, ret FROM rets WHERE symbol = '{REF}') b USING (date) WHERE a.symbol <> '{REF}' GROUP BY symbol ORDER BY r2 DESC, symbol LIMIT 2))"
    f50 = "OVER (ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"
    smooth("relative_average", lambda b: H.relative_average(b, REF, X.impact_weights(b, REF, 2)), "symbol ~own ~of_index ~value signal", f"""SELECT '{REF}' AS symbol, own, of_index, own - of_index AS value, CASE WHEN own - of_index > 0.02 THEN 'leading' WHEN own - of_index < -0.02 THEN 'lagging' ELSE 'in_line' END AS signal FROM (
        SELECT date, close / avg(close) {f50} AS own, level / avg(level) {f50} AS of_index, count(*) {f50} AS n FROM (SELECT date, close, exp(sum(ln(1 + r)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS level FROM (
        SELECT date, max(close) FILTER (weight IS NULL) AS close, sum(part) AS r FROM (SELECT *, coalesce(weight * (close / lag(close) {W}) - 1), 0) AS part FROM (SELECT * FROM (SELECT bars.*, weight, count(*) OVER (PARTITION BY date) AS k FROM bars LEFT JOIN wt USING (symbol) WHERE weight IS NOT NULL OR symbol = '{REF}') WHERE k = (SELECT count(*) + 1 FROM wt))) GROUP BY date))) WHERE n >= 50 ORDER BY date DESC LIMIT 1""", rets + weights)  # fmt: skip
    smooth("recent", lambda b: H.recent(b, REF), "symbol span:int ~change ~relative ~vol", f"SELECT g.symbol, span, change, change - ref AS relative, CASE WHEN n > 3 THEN vol END AS vol FROM g LEFT JOIN (SELECT span, change AS ref FROM g WHERE symbol = '{REF}' AND n = span + 1) USING (span)", rets + f", g AS (SELECT symbol, span, min_by(close, age) / max_by(close, age) - 1 AS change, stddev_samp(ret) FILTER (age <= span) * sqrt(252) AS vol, count(*) AS n FROM (SELECT *, {AGE} FROM rets), (SELECT unnest([20, 60]) AS span) WHERE age <= span + 1 GROUP BY ALL HAVING count(*) >= 3)")
    now = "max(close) FILTER (age = {})"
    smooth("technicals", H.technicals, "symbol ~perf_3m ~perf_6m ~to_sma_20 ~to_sma_50 ~to_sma_200 ~ratio_high", f"SELECT symbol, {now.format(1)} / {now.format(64)} - 1 AS perf_3m, {now.format(1)} / {now.format(127)} - 1 AS perf_6m, {', '.join(f'CASE WHEN max(age) >= {k} THEN {now.format(1)} / avg(close) FILTER (age <= {k}) - 1 END AS to_sma_{k}' for k in (20, 50, 200))}, {now.format(1)} / max(close) AS ratio_high FROM (SELECT *, {AGE} FROM bars) WHERE age <= 252 GROUP BY symbol")
    smooth("setup_label", H.setup_label, "symbol ~trend ~vol ~from_poc setup", f"SELECT *, CASE WHEN trend > 0.03 THEN 'Momentum' WHEN trend < -0.03 THEN 'Mean reversion' ELSE 'Balance' END AS setup FROM (SELECT symbol, CASE WHEN max(age) >= 50 THEN {now.format(1)} / avg(close) FILTER (age <= 50) - 1 ELSE 0 END AS trend, coalesce(stddev_samp(ret), 0) * sqrt(252) AS vol, {now.format(1)} / nullif(quantile_cont(close, 0.5) FILTER (age BETWEEN 2 AND 22), 0) - 1 AS from_poc FROM (SELECT *, {AGE} FROM rets) GROUP BY symbol)", rets)
    logs = SMOOTH + f", lr AS (SELECT symbol, date, ln(close / lag(close) {W})) AS lr FROM bars), vols AS (SELECT symbol, date, CASE WHEN count(lr) {frame(21)} >= 21 THEN stddev_samp(lr) {frame(21)} * sqrt(252) END AS vol FROM lr)"
    smooth("vol_of_vol", H.vol_of_vol, "symbol ~vol_of_vol n:long", f"SELECT symbol, CASE WHEN max(known) >= 40 AND count(d) >= 20 THEN stddev_samp(d) * sqrt(252) END AS vol_of_vol, count(d) AS n FROM (SELECT *, ln(vol) - lag(ln(vol)) {W}) AS d FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS known FROM (SELECT *, {AGE} FROM vols WHERE vol IS NOT NULL) WHERE age <= 252) WHERE vol > 0) GROUP BY symbol", logs)
    smooth("label_months", lambda b: H.label_months(labels(b)), "symbol month date label", "SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, max(date) AS date, max_by(label, date) AS label FROM labels GROUP BY symbol, 2", sig)
    smooth("label_age", lambda b: H.label_age(labels(b)), "symbol label days:long", f"SELECT symbol, max(now) AS label, coalesce(min(age) FILTER (label <> now) - 1, count(*)) AS days FROM (SELECT *, {AGE}, first_value(label) OVER (PARTITION BY symbol ORDER BY date DESC) AS now FROM labels) GROUP BY symbol", sig)
    smooth("seasonal_highlights", lambda b: H.seasonal_highlights(B.seasonal_stats(b)), "symbol m:int ~mean rank:int", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY mean DESC, m) AS rank FROM (SELECT symbol, month(month) AS m, coalesce(avg(ret) FILTER (year(month) >= newest - 10), avg(ret) FILTER (year(month) >= newest - 5)) AS mean FROM (SELECT *, max(year(month)) OVER (PARTITION BY symbol) AS newest FROM m2) GROUP BY ALL) WHERE mean IS NOT NULL) WHERE rank <= 3", panel + ", m2 AS (SELECT symbol, month, ret FROM m1 WHERE ret IS NOT NULL)")

    def quarter(name: str, op, columns: str, sql: str, ctes: str = "") -> None:
        c.add(name, lambda s, d: op(tables.quarters(s, d)), columns, QUARTERS + ctes, sql)

    wq = "OVER (PARTITION BY symbol ORDER BY period_end)"
    aged = ", a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) AS age, gross_profit / nullif(revenue, 0) AS gross_margin, operating_income / nullif(revenue, 0) AS operating_margin, CASE WHEN lag(revenue, 4) %s > 0 THEN revenue / lag(revenue, 4) %s - 1 END AS growth FROM quarters)" % (wq, wq)
    steps = lambda v: f"CASE WHEN count({v}) >= 3 THEN list({v} ORDER BY age) FILTER ({v} IS NOT NULL) END"
    faster = lambda v: f"{v}[1] - {v}[2] - {v}[-2] + {v}[-1] > 0"
    quarter("trajectory", Q.trajectory, "symbol n:long ~growth_slope ~margin_slope revenue_accelerates margin_accelerates", f"SELECT symbol, n, growth_slope, margin_slope, {faster('g')} AS revenue_accelerates, {faster('m')} AS margin_accelerates FROM (SELECT symbol, count(*) AS n, {steps('growth')} AS g, {steps('operating_margin')} AS m, CASE WHEN count(growth) >= 3 THEN regr_slope(growth, -age) END AS growth_slope, CASE WHEN count(operating_margin) >= 3 THEN regr_slope(operating_margin, -age) END AS margin_slope FROM a WHERE age <= 8 GROUP BY symbol)", aged)
    quarter("metric_trends", Q.metric_trends, "symbol metric ~yoy ~qoq trend", "SELECT symbol, metric, yoy, qoq, CASE WHEN qoq IS NULL OR before IS NULL THEN 'stable' WHEN qoq < 0 AND before < 0 THEN 'declining' WHEN qoq > before + 0.01 THEN 'accelerating' WHEN qoq < before - 0.01 THEN 'decelerating' ELSE 'stable' END AS trend FROM (SELECT symbol, metric, max(v) FILTER (age = 1) / nullif(max(v) FILTER (age = 5), 0) - 1 AS yoy, max(v) FILTER (age = 1) / nullif(max(v) FILTER (age = 2), 0) - 1 AS qoq, max(v) FILTER (age = 2) / nullif(max(v) FILTER (age = 3), 0) - 1 AS before FROM (SELECT *, row_number() OVER (PARTITION BY symbol, metric ORDER BY period_end DESC) AS age FROM (UNPIVOT (SELECT symbol, period_end, revenue, gross_profit, operating_income, cfo FROM quarters) ON revenue, gross_profit, operating_income, cfo INTO NAME metric VALUE v)) WHERE age <= 5 GROUP BY ALL)")
    at = lambda v, k: f"max({v}) FILTER (age = {k})"
    rise = lambda a, b: f"{at('revenue', a)} / nullif({at('revenue', b)}, 0)"
    stab = lambda v: f"CASE WHEN count({v}) FILTER (age <= 4) <= 1 THEN 'insufficient' ELSE ['very stable', 'stable', 'moderate', 'volatile'][1 + len(list_filter([0.01, 0.03, 0.07], lambda b: max({v}) FILTER (age <= 4) - min({v}) FILTER (age <= 4) >= b))] END"
    quarter("momentum_and_margins", Q.momentum_and_margins, "symbol accelerating ~gross_change ~operating_change gross_stability operating_stability", f"SELECT symbol, coalesce({rise(1, 2)} > {rise(2, 3)} AND {rise(1, 5)} > {rise(2, 6)}, false) AS accelerating, {at('gross_margin', 1)} - {at('gross_margin', 5)} AS gross_change, {at('operating_margin', 1)} - {at('operating_margin', 5)} AS operating_change, {stab('gross_margin')} AS gross_stability, {stab('operating_margin')} AS operating_stability FROM a WHERE age <= 6 GROUP BY symbol", aged)

    def view(name: str, text: str):
        def of(df):
            return df.sparkSession.sql(text, **{name: df})

        return of

    statements, prices, provided, points = view("quarters", STATEMENTS), view("quarters", PRICES), view("quarters", PROVIDED), view("contracts", POINTS)
    flows, stocks = ("eps", "revenue", "gross_profit", "operating_income", "net_income", "ebitda", "fcf", "cfo", "interest"), ("shares", "cash", "investments", "total_debt", "equity", "total_assets")
    ys = f", st AS ({STATEMENTS.format(quarters='quarters')}), ys AS (SELECT symbol, {', '.join(f'CASE WHEN count({v}) = 4 THEN sum({v}) END AS {v}' for v in flows)}, {', '.join(f'max({v}) FILTER (age = 1) AS {v}' for v in stocks)} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) AS age FROM st) WHERE age <= 4 GROUP BY symbol)"
    quarter("quality", lambda q: Q.quality(statements(q)), "symbol ~gp_to_assets ~accruals ~net_debt_ebitda ~interest_cover", "SELECT symbol, gross_profit / nullif(total_assets, 0) AS gp_to_assets, (net_income - cfo) / nullif(total_assets, 0) AS accruals, (total_debt - coalesce(cash, 0) - coalesce(investments, 0)) / nullif(ebitda, 0) AS net_debt_ebitda, operating_income / nullif(abs(interest), 0) AS interest_cover FROM ys", ys)
    by_hand = """pe: price / eps; ps: cap / revenue; pb: cap / equity; ev_ebitda: ev / ebitda; ev_ebit: ev / operating_income; ev_sales: ev / revenue; debt_to_equity: total_debt / equity; fcf_yield: fcf / cap; nav_per_share: equity / shares;
        net_cash_per_share: (cash + coalesce(investments, 0) - total_debt) / shares; gross_margin: gross_profit / revenue; operating_margin: operating_income / revenue; net_margin: net_income / revenue"""  # fmt: skip
    each = " UNION ALL ".join("SELECT symbol, '{}' AS ratio, {} / nullif({}, 0) AS own FROM cv".format(x.split(":")[0].strip(), *x.split(":")[1].rsplit(" / ", 1)) for x in by_hand.split(";"))
    quarter("ratios", lambda q: Q.ratios(statements(q), prices(q), provided(q)), "symbol ratio ~value source", f"SELECT symbol, ratio, coalesce(own, value) AS value, CASE WHEN own IS NOT NULL THEN 'statements' WHEN value IS NOT NULL THEN 'provider' END AS source FROM ({each}) FULL JOIN ({PROVIDED.format(quarters='quarters')}) USING (symbol, ratio)", ys + f", cv AS (SELECT *, cap + total_debt - cash - coalesce(investments, 0) AS ev FROM (SELECT *, coalesce(price * shares, vendor_cap) AS cap FROM ys JOIN ({PRICES.format(quarters='quarters')}) USING (symbol)))")

    pts = CONTRACTS + f", pts AS ({POINTS.format(contracts='contracts')})"
    c.add("smile_without_outliers", lambda s, d: O.without_outliers(points(tables.contracts(s, d)), sigmas=1.0, floor=0.001), "underlying expiry strike type ~iv", pts, "SELECT * FROM (SELECT *, count(*) FILTER (inside) OVER (PARTITION BY underlying, expiry) AS k FROM (SELECT p.*, abs(iv - med) <= greatest(1.4826 * mad, 0.001) AS inside FROM pts p JOIN (SELECT underlying, expiry, max(med) AS med, quantile_cont(abs(iv - med), 0.5) AS mad FROM pts JOIN (SELECT underlying, expiry, quantile_cont(iv, 0.5) AS med FROM pts GROUP BY ALL) USING (underlying, expiry) GROUP BY ALL) USING (underlying, expiry))) WHERE inside OR k < 4")
    wing = lambda t: f"min(CASE WHEN type = '{t}' THEN {{'off': abs(abs(delta) - 0.25), 'strike': strike, 'iv': iv}} END)"
    c.add("smile", lambda s, d: O.smile(points(tables.contracts(s, d)), 130.0), "underlying expiry ~atm_strike ~atm_iv ~skew_25d", pts, f"SELECT underlying, expiry, atm_strike, avg(iv) FILTER (strike = atm_strike) AS atm_iv, CASE WHEN max(p.off) <= 0.1 AND max(c.off) <= 0.1 THEN max(p.iv) - max(c.iv) END AS skew_25d FROM pts JOIN (SELECT underlying, expiry, min({{'off': abs(strike - 130), 'strike': strike}}).strike AS atm_strike, {wing('put')} AS p, {wing('call')} AS c FROM pts GROUP BY ALL) USING (underlying, expiry) GROUP BY ALL")
