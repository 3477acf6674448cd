"""Queries over relations between symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import bars as B
from quantloom.operators import cross as X
from quantloom.operators import indicators as I
from quantloom.operators import scoring as S
from quantloom.queries import Catalog
from quantloom.queries.bar_queries import AGE, W, frame
from quantloom.queries.sql import QUARTERS, RETURNS, SMOOTH
from quantloom.sources import tables

REF = "Brand#11"


def register(c: Catalog) -> None:
    def smooth(name: str, op, columns: str, sql: str = "", ctes: str = SMOOTH) -> None:
        c.add(name, lambda s, d: op(tables.bars_smooth(s, d)), columns, ctes if sql else "", sql)

    rets = SMOOTH + ", " + RETURNS.replace("rets AS", "r0 AS") + ", rets AS (SELECT symbol, date, ret FROM r0 WHERE ret IS NOT NULL)"
    vs = rets + f", vs AS (SELECT a.symbol, date, a.ret, b.ret AS ref FROM rets a JOIN (SELECT date, ret FROM rets WHERE symbol = '{REF}') b USING (date) WHERE a.symbol <> '{REF}')"
    smooth("beta_table", lambda b: X.beta_table(b, REF), "symbol window:int ~beta ~alpha ~corr n:long", f'SELECT symbol, "window", regr_slope(ret, ref) AS beta, regr_intercept(ret, ref) AS alpha, corr(ret, ref) AS corr, count(*) AS n FROM (SELECT *, {AGE} FROM vs), unnest([63, 126, 252, 504]) AS t("window") WHERE age <= "window" GROUP BY ALL HAVING count(*) >= 20', vs)
    c.sql["beta_table"] = c.sql["beta_table"].replace("CAST(window AS", 'CAST("window" AS').replace(") AS window,", ') AS "window",')
    smooth("rolling_beta", lambda b: X.rolling_beta(b, REF), "symbol date ~beta", f"SELECT symbol, date, CASE WHEN count(*) {frame(63)} >= 63 THEN covar_samp(ret, ref) {frame(63)} / nullif(var_samp(ref) {frame(63)}, 0) END AS beta FROM vs", vs)
    fixed = vs + ", g0 AS (SELECT symbol, date, ret - ref AS d FROM vs), rg AS (SELECT symbol, date, (d - avg(d) OVER (PARTITION BY symbol)) / nullif(stddev_samp(d) OVER (PARTITION BY symbol), 0) AS ret FROM g0)"
    pair = "SELECT a.symbol AS a, b.symbol AS b, corr(a.ret, b.ret) AS corr, covar_samp(a.ret, b.ret) * 252 AS cov, sum(a.ret * b.ret) / sqrt(sum(a.ret * a.ret) * sum(b.ret * b.ret)) AS cosine, count(*) AS n FROM {t} a JOIN {t} b ON a.date = b.date AND a.symbol < b.symbol GROUP BY ALL"
    smooth("gauge_fixed_corr", lambda b: X.correlations(X.gauge_fixed(b, REF)), "a b ~corr n:long", pair.format(t="rg"), fixed)
    smooth("corr_table", lambda b: X.correlations(X.returns(b)), "a b ~corr n:long", pair.format(t="rets"), rets)
    smooth("covariance_pairs", lambda b: X.correlations(X.returns(b)), "a b ~cov", pair.format(t="rets"), rets)
    smooth("cosine_pairs", lambda b: X.correlations(X.returns(b)), "a b ~cosine", pair.format(t="rets"), rets)
    smooth("impact_weights", lambda b: X.impact_weights(b, REF), "symbol ~r2 ~weight rank:long", "SELECT *, r2 / sum(r2) OVER () AS weight FROM (SELECT *, row_number() OVER (ORDER BY r2 DESC, symbol) AS rank FROM (SELECT symbol, corr(ret, ref) ** 2 AS r2 FROM vs GROUP BY symbol)) WHERE rank <= 8", vs)
    mom = rets + f", mom AS (SELECT * FROM (SELECT symbol, date, lag(close, 21) {W}) / lag(close, 252) {W}) - 1 AS momentum FROM bars) WHERE momentum IS NOT NULL)"
    smooth("momentum_12_1", X.momentum, "symbol date ~momentum", "SELECT * FROM mom", mom)
    rank = "rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"
    smooth("momentum_terciles", X.momentum_terciles, "date ~spread n:long", f"""SELECT date, spread, n FROM (SELECT *, count(*) OVER () AS dates FROM (SELECT date, avg(ret) FILTER (pct >= 2.0 / 3) - avg(ret) FILTER (pct <= 1.0 / 3) AS spread, count(*) AS n FROM (
        SELECT date, ret, ({rank.format(by='date', x='momentum')}) / count(*) OVER (PARTITION BY date) AS pct FROM mom JOIN rets USING (symbol, date) WHERE symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 313))
        GROUP BY date) WHERE spread IS NOT NULL) WHERE dates > 60 AND (SELECT count(*) FROM (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 313)) >= 6""", mom)  # fmt: skip
    wm = "OVER (PARTITION BY symbol ORDER BY month"
    panel = SMOOTH + f""", m0 AS (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, max_by(close, date) AS close FROM bars GROUP BY ALL),
        m1 AS (SELECT symbol, month, close, close / lag(close) {wm}) - 1 AS ret FROM (SELECT *, max(month) OVER (PARTITION BY symbol) AS newest FROM m0) WHERE month < newest),
        panel AS (SELECT * FROM (SELECT symbol, month, lag(close, 1) {wm}) / lag(close, 12) {wm}) - 1 AS mom, ret AS reversal, stddev_samp(ret) {wm} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS vol, lead(close, 1) {wm}) / close - 1 AS target FROM m1)
            WHERE mom IS NOT NULL AND target IS NOT NULL AND vol IS NOT NULL)"""  # fmt: skip
    smooth("monthly_panel", X.monthly_panel, "symbol month ~mom ~reversal ~vol ~target", "SELECT * FROM panel", panel)
    z = ", ".join(f"({k} - avg({k}) OVER (PARTITION BY month)) / nullif(stddev_samp({k}) OVER (PARTITION BY month), 0) AS z_{k}" for k in ("mom", "reversal", "vol"))
    smooth("zscore_by_date", lambda b: X.zscore(X.monthly_panel(b)), "symbol month ~z_mom ~z_reversal ~z_vol", f"SELECT symbol, month, {z} FROM panel", panel)
    smooth("quintile_long_short", lambda b: X.quintile_spread(X.monthly_panel(b)), "month ~spread n:long", """SELECT month, avg(target) FILTER (down <= n // 5) - avg(target) FILTER (up <= n // 5) AS spread, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY month) AS n,
        row_number() OVER (PARTITION BY month ORDER BY mom, symbol) AS up, row_number() OVER (PARTITION BY month ORDER BY mom DESC, symbol DESC) AS down FROM panel) WHERE n >= 5 GROUP BY month""", panel)  # fmt: skip
    smooth("spearman_ic", lambda b: X.rank_ic(X.monthly_panel(b)), "month ~ic n:long", f"SELECT month, corr(p, q) AS ic, count(*) AS n FROM (SELECT month, {rank.format(by='month', x='mom')} AS p, {rank.format(by='month', x='target')} AS q FROM panel) GROUP BY month HAVING count(*) >= 3", panel)
    smooth("quintile_buckets", lambda b: X.quintile_buckets(X.monthly_panel(b)), "bucket:int ~mean n:long", "SELECT bucket, avg(target) AS mean, count(*) AS n FROM (SELECT target, len(list_filter(edges, lambda e: e < target)) AS bucket FROM panel JOIN (SELECT month, quantile_cont(target, [0.2, 0.4, 0.6, 0.8]) AS edges FROM panel GROUP BY month) USING (month)) GROUP BY bucket", panel)
    smooth("purge_embargo_pairs", lambda b: X.purged_pairs(X.monthly_panel(b)), "year:int n_test:long n_train:long", "SELECT y.year, max(n_test) AS n_test, count(p.symbol) AS n_train FROM (SELECT year(month) AS year, min(year(month) * 12 + month(month)) AS first, count(*) AS n_test FROM panel GROUP BY 1) y LEFT JOIN panel p ON year(p.month) * 12 + month(p.month) + 1 <= first - 1 GROUP BY y.year", panel)
    smooth("walk_forward_skill", lambda b: X.walk_forward_skill(X.monthly_panel(b)), "symbol ~r2 n:long", f"SELECT symbol, 1 - sum((target - guess) ** 2) / sum(target ** 2) AS r2, count(*) AS n FROM (SELECT symbol, target, avg(target) {wm} ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS guess FROM panel) WHERE guess IS NOT NULL GROUP BY symbol", panel)
    cell = SMOOTH + f""", lr AS (SELECT symbol, date, close, ln(close / lag(close) {W})) AS lr FROM bars),
        vols AS (SELECT symbol, date, close, CASE WHEN count(lr) {frame(21)} >= 21 THEN stddev_samp(lr) {frame(21)} * sqrt(252) END AS vol FROM lr),
        cells AS (SELECT symbol, date, close, CASE WHEN med IS NOT NULL AND trend IS NOT NULL THEN CASE WHEN vol > med THEN 'highvol_' ELSE 'lowvol_' END || CASE WHEN trend > 0 THEN 'up' ELSE 'down' END END AS cell FROM (
        SELECT *, CASE WHEN count(vol) {frame(504)} >= 63 THEN quantile_cont(vol, 0.5) {frame(504)} END AS med, close / lag(close, 252) {W}) - close / lag(close, 21) {W}) AS trend FROM vols)),
        cm AS (SELECT *, last_value(cell) OVER (PARTITION BY symbol ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS now FROM (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, max_by(close, date) AS close, arg_max_null(cell, date) AS cell FROM cells GROUP BY ALL)),
        fw AS ({" UNION ALL ".join(f"SELECT symbol, {h} AS h, lead(close, {h}) {wm}) / close - 1 AS r, cell = now AS own FROM cm" for h in (1, 3, 6, 12))}),
        rates AS (SELECT *, CASE WHEN own_n > 0 THEN w * own_q50 + (1 - w) * q50 ELSE q50 END AS shrunk FROM (SELECT *, (own_n / h) / (own_n / h + 24) AS w FROM (
            SELECT symbol, h, quantile_cont(r, 0.25) AS q25, quantile_cont(r, 0.5) AS q50, quantile_cont(r, 0.75) AS q75, avg(CAST(r > 0 AS INTEGER)) AS hit, count(r) AS n, quantile_cont(r, 0.5) FILTER (own) AS own_q50, count(r) FILTER (own) AS own_n, quantile_cont(r, 0.05) AS q05, quantile_cont(r, 0.95) AS q95 FROM fw WHERE r IS NOT NULL GROUP BY ALL)))"""  # fmt: skip
    smooth("base_rates", X.base_rates, "symbol h:int ~q25 ~q50 ~q75 ~hit n:long", "SELECT * FROM rates", cell)
    smooth("base_rates_by_cell", X.base_rates, "symbol h:int ~own_q50 own_n:long", "SELECT * FROM rates", cell)
    smooth("shrunk_base_rates", X.base_rates, "symbol h:int ~shrunk", "SELECT * FROM rates", cell)
    smooth("vol_managed", X.vol_managed, "symbol h:int ~q25 ~q50 ~q75", "SELECT symbol, h, q25 * med / vol AS q25, q50 * med / vol AS q50, q75 * med / vol AS q75 FROM rates JOIN (SELECT symbol, max_by(vol, date) AS vol, quantile_cont(vol, 0.5) AS med FROM vols WHERE vol IS NOT NULL GROUP BY symbol) USING (symbol)", cell)
    five = ("q05", "q25", "q50", "q75", "q95")
    cut = lambda b: X.base_rates(b).select("symbol", "h", *five, "shrink_w")
    knots = " ".join(f"WHEN {a} <= 0 AND {b} >= 0 THEN round(1 - ({p} + {round(q - p, 2)} * coalesce(-{a} / nullif({b} - {a}, 0), 0)), 4)" for (a, p), (b, q) in zip(zip(five, (0.05, 0.25, 0.5, 0.75)), zip(five[1:], (0.25, 0.5, 0.75, 0.95))))
    lean = """SELECT *, round(least(1, coalesce(abs(p_up - 0.5) * 2, 0) * (0.4 + 0.6 * coalesce(shrink_w, 0))), 3) AS conviction,
        CASE WHEN p_up >= 0.58 AND q50 > 0 THEN 'odds_favorable' WHEN p_up <= 0.42 AND q50 < 0 THEN 'odds_unfavorable' ELSE 'balanced' END AS posture FROM (SELECT *, CASE WHEN q05 > 0 THEN 1.0 WHEN q95 < 0 THEN 0.0 {knots} END AS p_up FROM {of})"""
    weighed = "(SELECT *, w AS shrink_w FROM rates)"
    smooth("odds", lambda b: S.odds(cut(b)), "symbol h:int ~p_up posture ~conviction", lean.format(knots=knots, of=weighed), cell)
    smooth("odds_posture", lambda b: S.posture(S.odds(cut(b))), "symbol h:int posture ~conviction ~p_up ~q50", f"SELECT * FROM ({lean.format(knots=knots, of=weighed)}) WHERE q50 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY list_position([6, 3, 12, 1], h)) = 1", cell)
    # implied quantiles: half the base rates', from three months on; a stack: a fifth of them at six months, past its gates where the median rises
    implied = lambda b: cut(b).where("h >= 3").select("symbol", "h", *((F.col(q) * 0.5).alias(q) for q in five))
    stacked = lambda b: cut(b).where("h = 6").select("symbol", "h", (F.col("q50") > 0).alias("passed"), *((F.col(q) * 0.2).alias(q) for q in five))
    mixed = "SELECT symbol, h, CASE WHEN h = 6 AND q50 > 0 THEN 'stack' WHEN h >= 3 THEN 'base_rates+implied' ELSE 'base_rates' END AS source, " + ", ".join(f"CASE WHEN h = 6 AND q50 > 0 THEN round({q} / 5, 6) WHEN h >= 3 THEN round({q} * 0.75, 6) ELSE {q} END AS {q}" for q in five) + " FROM rates"
    smooth("odds_sources", lambda b: S.blend_sources(cut(b), implied(b), stacked(b)), "symbol h:int source " + " ".join("~" + q for q in five), mixed, cell)
    smooth("scenario_paths", lambda b: S.scenario_paths(S.blend_sources(cut(b), implied(b), stacked(b))), "symbol h:int source scenario ~value", f"SELECT symbol, h, source, scenario, value FROM (SELECT symbol, h, source, q75 AS bull, q50 AS neutral, q25 AS bear FROM ({mixed})) UNPIVOT INCLUDE NULLS (value FOR scenario IN (bull, neutral, bear)) WHERE h IN (3, 6, 12)", cell)
    smooth("top_drivers", lambda b: S.top_drivers(X.correlations(X.returns(b)).selectExpr("a AS symbol", "b AS factor", "cov AS beta")), "symbol rank:int factor ~beta direction", f"SELECT a AS symbol, row_number() OVER (PARTITION BY a ORDER BY abs(cov) DESC, b) AS rank, b AS factor, round(cov, 4) AS beta, CASE WHEN cov >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM ({pair.format(t='rets')}) QUALIFY rank <= 2", rets)
    ent = " + ".join(f"CASE WHEN b{i} > 0 THEN -b{i} / 63 * log2(b{i} / 63) ELSE 0 END" for i in range(10))
    bins = ", ".join(f"sum(CAST(bin = {i} AS INTEGER)) {frame(63)} AS b{i}" for i in range(10))
    entropy = rets + f""", eb AS (SELECT symbol, date, ret, least(greatest(floor((ret + 3 * s) / (6 * s) * 10), 0), 9) AS bin FROM (SELECT *, stddev_samp(ret) OVER (PARTITION BY symbol) AS s FROM rets)),
        ent AS (SELECT symbol, date, ret, CASE WHEN k >= 63 THEN round(({ent}) / log2(10), 9) END AS entropy FROM (SELECT symbol, date, ret, count(*) {frame(63)} AS k, {bins} FROM eb))"""  # fmt: skip
    smooth("entropy_rolling", X.entropy_rolling, "symbol date ~entropy", "SELECT * FROM ent", entropy)
    ahead = f"{W} ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING)"
    smooth("entropy_backtest", X.entropy_backtest, "symbol third ~mean n:long", f"""SELECT symbol, third, avg(fwd) AS mean, count(*) AS n FROM (SELECT symbol, fwd, CASE WHEN entropy <= lo THEN 'low' WHEN entropy >= hi THEN 'high' ELSE 'mid' END AS third
        FROM fwd JOIN (SELECT symbol, quantile_cont(entropy, 1.0 / 3) AS lo, quantile_cont(entropy, 2.0 / 3) AS hi FROM fwd GROUP BY symbol) USING (symbol)) GROUP BY ALL""", entropy + f""",
        fwd AS (SELECT * FROM (SELECT symbol, entropy, CASE WHEN count(*) {ahead} = 21 THEN exp(sum(ln(1 + ret)) {ahead}) - 1 END AS fwd FROM ent) WHERE entropy IS NOT NULL AND fwd IS NOT NULL)""")  # fmt: skip
    three = ["Brand#11", "Brand#12", "Brand#13"]
    cols = ", ".join(f"max(close) FILTER (symbol = '{s}') AS c{i}" for i, s in enumerate(three))
    smooth("align_outer", lambda b: X.aligned(b, three).toDF("date", "c0", "c1", "c2"), "date ~c0 ~c1 ~c2", f"SELECT date, {cols} FROM bars WHERE symbol IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY date")
    for name in ("common_window", "common_window_all"):  # one query under the two names it has had
        smooth(name, lambda b: X.common_window(b, 60), "symbol date ~close", "SELECT symbol, date, close FROM bars WHERE date IN (SELECT date FROM bars GROUP BY date HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars) ORDER BY date DESC LIMIT 60)")
    smooth("macro_change_asof", X.changes_as_of, "symbol k:int ~now ~diff ~pct", """SELECT a.symbol, k, now, now - b.close AS diff, now / b.close - 1 AS pct FROM (SELECT symbol, k, now, CAST(date - to_months(CAST(k AS INTEGER)) AS DATE) AS at FROM (SELECT symbol, max(date) AS date, max_by(close, date) AS now FROM bars GROUP BY symbol), unnest([1, 3, 12]) AS t(k)) a
        ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND a.at >= b.date""")  # fmt: skip

    def filed(spark, sf_dir):
        q = tables.quarters(spark, sf_dir)
        price = tables.bars_smooth(spark, sf_dir).where(f"symbol = '{REF}'").select("date", "close")
        return X.as_of_series(q, price, "filing_date", "date", "close").select("symbol", "period_end", "filing_date", "close")

    c.add("asof_price_at_filing", filed, "symbol period_end filing_date ~close", SMOOTH + ", " + QUARTERS, f"SELECT q.symbol, period_end, filing_date, close FROM quarters q ASOF LEFT JOIN (SELECT date, close FROM bars WHERE symbol = '{REF}') b ON q.filing_date >= b.date")
    smooth("kinematics", lambda b: X.kinematics(I.ema_stack(b, (21,))), "symbol ~velocity ~acceleration ~jerk")
    c.sql["kinematics"] = f"""WITH RECURSIVE {SMOOTH}, n AS (SELECT *, row_number() {W}) AS rn FROM bars), e AS (SELECT symbol, date, rn, close AS e FROM n WHERE rn = 1 UNION ALL SELECT n.symbol, n.date, n.rn, e.e + (n.close - e.e) / 11 FROM e JOIN n ON n.symbol = e.symbol AND n.rn = e.rn + 1),
        v AS (SELECT symbol, avg(d) FILTER (age <= 21) AS v0, avg(d) FILTER (age BETWEEN 22 AND 42) AS v1, avg(d) FILTER (age BETWEEN 43 AND 63) AS v2 FROM (SELECT symbol, ln(e) - lag(ln(e)) {W}) AS d, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS age FROM e) WHERE age <= 84 GROUP BY symbol)
        SELECT symbol, round(v0, 6) + 0.0 AS velocity, round(v0 - v1, 6) + 0.0 AS acceleration, round(v0 - 2 * v1 + v2, 6) + 0.0 AS jerk FROM v"""  # fmt: skip
    smooth("cross_calendar", lambda b: b.join(b.where("symbol = 'Brand#11'").select("date"), "date", "left_semi").groupBy("symbol").agg({"date": "count"}).toDF("symbol", "n"), "symbol n:long", "SELECT symbol, count(*) AS n FROM bars WHERE date IN (SELECT date FROM bars WHERE symbol = 'Brand#11') GROUP BY symbol")
