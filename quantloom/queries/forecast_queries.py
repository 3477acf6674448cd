"""Queries over the forecast: the stack, cycles, components, mixture, zones and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import components as C
from quantloom.operators import cross as X
from quantloom.operators import cycles
from quantloom.operators import exposures as E
from quantloom.operators import forecasts as G
from quantloom.operators import fundamentals as Q
from quantloom.operators import implied as I
from quantloom.operators import opinions as P
from quantloom.operators import peers
from quantloom.operators import stack as S
from quantloom.queries import Catalog
from quantloom.queries.sql import QUARTERS, SMOOTH
from quantloom.session import shared_folder
from quantloom.sources import tables

MARKET = "Brand#11"
FACTORS = ["Brand#11", "Brand#12", "Brand#13"]
#: Which symbols stand for the macro series.
MACRO = {"hy_spread": "Brand#21", "vix": "Brand#22", "dollar": "Brand#23", "curve": "Brand#24"}

#: Which symbols stand for rates in the basket; the day on which quotes are taken.
RATES = ["Brand#21", "Brand#22"]
AS_OF = "2001-01-15"

VOLS = """
    lr AS (
        SELECT symbol, date, close, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS lr
        FROM bars),
    dv AS (
        SELECT symbol,
               CASE WHEN count(*) > 30 AND count(own) > 20 AND stddev_samp(own) > 0
                    THEN stddev_samp(own) ELSE 0.25 / sqrt(252) END AS daily
        FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 252 THEN lr END AS own FROM lr)
        GROUP BY symbol),
    hz AS (
        SELECT unnest([1, 2, 3, 6, 12, 18]) AS months, unnest([21, 42, 63, 126, 252, 378]) AS h)"""

TILTED = """
    SELECT symbol, months, h,
           CASE WHEN daily > -1 THEN exp(ln(1 + daily) * h) - 1 ELSE -1 END AS value,
           base * sqrt(h) * {widen} AS sigma, {sure} AS evidence
    FROM (SELECT symbol, dv.daily AS base, CASE WHEN annual > -1 THEN exp(ln(1 + annual) / 252) - 1 ELSE -0.001 END AS daily
          FROM dv {join}), hz"""

PANEL = """
    lr AS (
        SELECT symbol, date, close, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS lr
        FROM bars),
    vols AS (
        SELECT symbol, date, close,
               CASE WHEN count(lr) OVER w >= 21 THEN stddev_samp(lr) OVER w * sqrt(252) END AS vol
        FROM lr WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
    cells AS (
        SELECT symbol, date, close,
               CASE WHEN med IS NOT NULL AND trend IS NOT NULL
                    THEN CASE WHEN vol > med THEN 'highvol_' ELSE 'lowvol_' END || CASE WHEN trend > 0 THEN 'up' ELSE 'down' END
               END AS cell
        FROM (SELECT *,
                     CASE WHEN count(vol) OVER w >= 63 THEN quantile_cont(vol, 0.5) OVER w END AS med,
                     close / lag(close, 252) OVER o - close / lag(close, 21) OVER o AS trend
              FROM vols
              WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 503 PRECEDING AND CURRENT ROW),
                     o AS (PARTITION BY symbol ORDER BY date))),
    ms AS (
        SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, arg_max(close, date) AS close,
               arg_max(cell, date) FILTER (cell IS NOT NULL) AS cell
        FROM cells GROUP BY ALL),
    own AS (
        SELECT m.*, e.close AS level, row_number() OVER w AS place, count(*) OVER (PARTITION BY m.symbol) AS n
        FROM ms m LEFT JOIN ms e ON e.symbol = left(m.symbol, 7) || '1' AND e.month = m.month
        WINDOW w AS (PARTITION BY m.symbol ORDER BY m.month)),
    fp AS (
        SELECT symbol, month, place, n,
               lag(close, 1) OVER w / lag(close, 12) OVER w - 1 AS mom_12_1,
               close / lag(close, 1) OVER w - 1 AS rev_1m,
               CAST(starts_with(cell, 'highvol') AS DOUBLE) AS vol_dummy, CAST(ends_with(cell, 'up') AS DOUBLE) AS trend_dummy,
               lead(close, 1) OVER w / close - lead(level, 1) OVER w / level AS target_h1,
               lead(close, 6) OVER w / close - lead(level, 6) OVER w / level AS target_h6,
               lead(close, 18) OVER w / close - lead(level, 18) OVER w / level AS target_h18
        FROM own WINDOW w AS (PARTITION BY symbol ORDER BY month))"""


def sectors(bars: DataFrame) -> DataFrame:
    """A brand's sector series is the first brand of its manufacturer."""
    return bars.select("symbol").distinct().withColumn("etf", F.concat(F.substring("symbol", 1, 7), F.lit("1")))


def stages(s: SparkSession, d: str) -> DataFrame:
    """Stage and growth of the customer segment that orders most of each brand."""
    item, part, orders, customer = (tables.table(s, d, t) for t in ("lineitem", "part", "orders", "customer"))
    sold = item.join(part, item.l_partkey == part.p_partkey).join(orders, item.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey)
    n = sold.groupBy(F.col("p_brand").alias("brand"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    top = n.groupBy("brand").agg(F.min(F.struct(-F.col("n"), "segment"))["segment"].alias("segment"))
    own = Q.stage(tables.quarters(s, d)).withColumnRenamed("symbol", "segment")
    return top.join(own, "segment").select(F.col("brand").alias("symbol"), "stage", "yoy")


def changes(bars: DataFrame) -> DataFrame:
    """Changes over three months of the symbols that stand for macro series."""
    name = F.create_map(*(F.lit(x) for k, v in MACRO.items() for x in (v, k)))
    x = X.changes_as_of(bars.where(F.col("symbol").isin(list(MACRO.values())))).where("k = 3")
    return x.select(name[F.col("symbol")].alias("series"), F.col("pct").alias("change"), F.when(F.col("symbol") == MACRO["curve"], "diff").otherwise("pct").alias("mode"))


def basket(bars: DataFrame) -> DataFrame:
    """Monthly log returns of the factor symbols, and changes in level of two that stand for rates."""
    own = E.log_returns(bars.where(F.col("symbol").isin(FACTORS)))
    rates = E.differences(bars.where(F.col("symbol").isin(RATES)))
    return own.unionByName(rates).select("month", F.col("symbol").alias("leg"), F.col("y").alias("x"))


def chain(s: SparkSession, d: str, bars: DataFrame | None = None) -> DataFrame:
    """Quotes of every brand's contracts: strikes by its parts' sizes about the newest close, mids at its volatility with a smile."""
    b = tables.bars_smooth(s, d) if bars is None else bars
    own = b.groupBy("symbol").agg(F.max_by("close", "date").alias("spot")).join(C.daily_volatility(b), "symbol")
    part = tables.table(s, d, "part")
    days = F.element_at(F.array(*map(F.lit, (30, 91, 182, 364))), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    x = part.select(F.col("p_brand").alias("symbol"), (0.5 + F.col("p_size") / 50).alias("k"), F.date_add(F.lit(AS_OF).cast("date"), days).alias("expiry"), (days / 365.25).alias("t")).distinct()
    x = x.join(own, "symbol").withColumn("strike", F.col("spot") * F.col("k")).withColumn("type", F.explode(F.array(F.lit("call"), F.lit("put"))))
    sigma = F.col("daily") * F.sqrt(F.lit(252.0)) * (1 + 0.3 * F.pow(F.ln("k"), F.lit(2)))
    mid = I.priced(F.col("spot"), F.col("strike"), F.col("t"), sigma, F.col("type") == "call")
    return x.select(F.col("symbol").alias("underlying"), "spot", "expiry", "strike", "type", mid.alias("mid"))


def register(c: Catalog) -> None:
    smooth = tables.bars_smooth

    def panel(s, d):
        return S.feature_panel(smooth(s, d), sectors(smooth(s, d)))

    c.add(
        "feature_panel", panel, "symbol month ~mom_12_1 ~rev_1m ~vol_dummy ~trend_dummy ~target_h1 ~target_h6 ~target_h18",
        SMOOTH + "," + PANEL, "SELECT * FROM fp WHERE place > 12 AND n >= 15",
    )
    def stored(s, d):
        """The panel as a written table: what follows reads it several times."""
        if s.sparkContext.getCheckpointDir() is None:
            s.sparkContext.setCheckpointDir(shared_folder(s))
        return panel(s, d).checkpoint()

    c.add("stack_gates", lambda s, d: S.stack(stored(s, d)).gates, "h:int ~oos_ic ~ci_low ~ci_high n_test_months:int n_oos_rows:long ~sharpe ~deflated ~probability ic_pass sharpe_pass passed n_trials:int")
    c.add("stack_ablations", lambda s, d: S.stack(stored(s, d)).ablations, "h:int dropped ~ic_full ~ic_without raises")
    c.add("stack_predictions", lambda s, d: S.stack(stored(s, d)).predictions, "symbol h:int ~expected ~q05 ~q25 ~q50 ~q75 ~q95")
    c.add("stack_contributions", lambda s, d: S.stack(stored(s, d)).contributions, "symbol h:int feature ~contribution")

    c.add("cycle_modes", lambda s, d: cycles.cycle_modes(smooth(s, d)), "symbol rank:int k:int ~period ~amplitude ~phase ~share position ~passed")
    c.add("cycle_consistency", lambda s, d: cycles.cycle_consistency(smooth(s, d)), "symbol n:int ~r2 ~dominant ~error ~usual ~spread ~z blocks:int label")
    c.add("cycle_projection", lambda s, d: cycles.cycle_projection(smooth(s, d)), "symbol h:int days:int ~expected ~trend ~cycle ~reach truncated ~confidence")

    model = lambda s, d: C.regime_model(smooth(s, d).where(F.col("symbol") == MARKET))  # noqa: E731  the market is one series by its meaning
    c.add("regime_path", lambda s, d: C.regime_days(model(s, d)), "symbol date state filtered")
    c.add("regime_states", lambda s, d: C.regime_states(model(s, d)), "symbol label ~posterior ~stationary ~duration ~mean_return n:int")

    c.add(
        "market_prior", lambda s, d: C.market_prior(smooth(s, d), MARKET), "months:int h:int ~prior source", SMOOTH + "," + VOLS,
        f"""
        SELECT months, h, exp(daily * h) - 1 AS prior, source
        FROM (SELECT CASE WHEN count(*) > 60 THEN avg(lr) ELSE ln(1.08) / 252 END AS daily,
                     CASE WHEN count(*) > 60 THEN 'market' ELSE 'assumed' END AS source
              FROM lr WHERE symbol = '{MARKET}'), hz""",
    )
    shown = "symbol months:int h:int ~value ~sigma ~evidence"
    c.add(
        "component_seasonality", lambda s, d: C.seasonality(smooth(s, d)), shown, SMOOTH + "," + VOLS,
        f"""
        SELECT symbol, hz.months, hz.h, mean AS value,
               CASE WHEN p90 > p10 THEN (p90 - p10) / (2 * 1.2815515655446004) ELSE daily * sqrt(hz.h) END AS sigma,
               least(1, n / 20) AS evidence
        FROM (WITH {SMOOTH},
              mo AS (SELECT symbol, date_trunc('month', date) AS month, arg_max(close, date) AS close FROM bars GROUP BY ALL),
              me AS (SELECT symbol, year(month) * 12 + month(month) - 1 AS i, close FROM mo
                     QUALIFY month < max(month) OVER (PARTITION BY symbol))
              SELECT a.symbol, (a.i + 1) % 12 + 1 AS m, k AS months, avg(b.close / a.close - 1) AS mean, count(*) AS n,
                     quantile_cont(b.close / a.close - 1, 0.1) AS p10, quantile_cont(b.close / a.close - 1, 0.9) AS p90
              FROM me a, unnest([1, 2, 3, 6, 12, 18]) t(k) JOIN me b ON b.symbol = a.symbol AND b.i = a.i + k GROUP BY ALL) f
        JOIN (SELECT symbol, month(max(date)) AS m FROM bars GROUP BY symbol) USING (symbol, m)
        JOIN hz USING (months) JOIN dv USING (symbol)""",
    )
    c.add("component_regime", lambda s, d: C.regime(smooth(s, d), MARKET), shown)
    c.add("component_factors", lambda s, d: C.factors(smooth(s, d), FACTORS), shown)
    c.add("component_spectral", lambda s, d: C.spectral(smooth(s, d)), shown)
    c.add(
        "component_fundamentals", lambda s, d: C.fundamentals(smooth(s, d), stages(s, d)), shown,
        SMOOTH + "," + VOLS + f""", sg AS (
            SELECT p_brand AS brand, arg_min(c_mktsegment, row(-n, c_mktsegment)) AS segment
            FROM (SELECT p_brand, c_mktsegment, count(*) AS n
                  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
                  JOIN customer ON o_custkey = c_custkey GROUP BY ALL) GROUP BY ALL),
        qs AS (WITH {QUARTERS} SELECT symbol, period_end, operating_income / nullif(revenue, 0) AS margin,
                      CASE WHEN lag(revenue, 4) OVER w > 0 THEN revenue / lag(revenue, 4) OVER w - 1 END AS yoy
               FROM quarters WINDOW w AS (PARTITION BY symbol ORDER BY period_end)),
        st AS (SELECT symbol AS segment, yoy,
                      CASE WHEN yoy IS NULL THEN NULL WHEN margin < 0 AND up > 0 THEN 0.06 WHEN yoy < -0.02 THEN -0.08
                           WHEN yoy > 0.05 AND up < -0.02 THEN -0.03 WHEN yoy > 0.05 THEN 0.04 ELSE 0 END AS tilt
               FROM (SELECT symbol, arg_max_null(yoy, period_end) AS yoy, arg_max_null(up, period_end) AS up,
                            arg_max_null(margin, period_end) AS margin
                     FROM (SELECT *, yoy - lag(yoy) OVER (PARTITION BY symbol ORDER BY period_end) AS up FROM qs) GROUP BY symbol)),
        an AS (SELECT brand AS symbol, coalesce(tilt, 0) + coalesce(least(0.5, greatest(-0.5, yoy)) * 0.25, 0) AS annual
               FROM sg JOIN st USING (segment) WHERE tilt IS NOT NULL OR yoy IS NOT NULL)""",
        TILTED.format(widen=1.6, sure=0.3, join="JOIN an USING (symbol)"),
    )
    pick = " ".join(f"WHEN '{v}' THEN greatest(-{b}, least({b}, {f} * pct{'' if m != 'pct' else f' * {u}'}))" for (k, v), (f, b, m, u) in zip(MACRO.items(), C.MACRO.values()))
    c.add(
        "component_macro", lambda s, d: C.macro(smooth(s, d), changes(smooth(s, d))), shown,
        SMOOTH + "," + VOLS + f""", an AS (
            SELECT sum(CASE symbol {pick} END) AS annual
            FROM (SELECT a.symbol, now / b.close - 1 AS pct
                  FROM (SELECT symbol, CAST(max(date) - INTERVAL 3 MONTH AS DATE) AS at, arg_max(close, date) AS now FROM bars GROUP BY symbol) a
                  ASOF JOIN bars b ON b.symbol = a.symbol AND a.at >= b.date))""",
        TILTED.format(widen=2, sure=0.25, join="CROSS JOIN an"),
    )

    def skill(s, d):
        """Skills of the components that can be run over the past; the others' are null."""
        x = c.queries["settled_means"](s, d)
        both = x.selectExpr("symbol", "date", "stack(2, 'seasonality', seasonal, 'regime', by_label) AS (component, predicted)")
        got = G.skills(both, x.select("symbol", "date", "realized"))
        every = smooth(s, d).select("symbol").distinct().withColumn("component", F.explode(F.array(*map(F.lit, G.PRIOR))))
        return every.join(got, ["symbol", "component"], "left").select("symbol", "component", "skill")

    def components(s, d):
        b = smooth(s, d)
        own = (C.seasonality(b), C.regime(b, MARKET), C.factors(b, FACTORS), C.spectral(b), C.fundamentals(b, stages(s, d)), C.macro(b, changes(b)))
        out = own[0]
        for x in own[1:]:
            out = out.unionByName(x)
        return out

    def calibrated(s, d):
        return C.calibrated(components(s, d), smooth(s, d), skill(s, d), MARKET)

    def mixed(s, d):
        return C.mix(C.parts(calibrated(s, d), G.weights(skill(s, d), G.PRIOR)))

    def price(s, d):
        return smooth(s, d).groupBy("symbol").agg(F.max_by("close", "date").alias("price"))

    def recommended(s, d):
        m = mixed(s, d)
        labels = X.entropy_rolling(smooth(s, d)).groupBy("symbol").agg(F.max_by("entropy", "date").alias("entropy")).select("symbol", P.entropy_label(F.col("entropy")).alias("label"))
        share = components(s, d).groupBy("symbol").agg((F.count_distinct("component") / 6).alias("share"))
        return C.recommendations(m, C.zones(m, price(s, d)), labels, share)

    c.add("forecast_components", calibrated, "symbol component months:int h:int ~value ~sigma ~evidence ~confidence ~prior ~low ~high ~calibrated clamped")
    c.add("forecast_parts", lambda s, d: C.parts(calibrated(s, d), G.weights(skill(s, d), G.PRIOR)).select("symbol", "months", F.inline("parts")), "symbol months:int component ~weight ~mean ~sd")
    c.add("forecast_mixture", mixed, "symbol months:int h:int " + " ".join(f"~{f}" for f in C.FIGURES))
    c.add("price_zones", lambda s, d: C.zones(mixed(s, d), price(s, d)), "symbol ~price ~bargain_below ~fair_value ~expensive_above ~against_fair")
    c.add("price_goals", lambda s, d: C.targets(mixed(s, d), price(s, d)), "symbol months:int kind ~target ~probability")
    c.add("recommendations", recommended, "symbol ~edge ~gap ~score action ~conviction strength")

    def exposed(s, d):
        return E.exposures(E.log_returns(smooth(s, d).where(~F.col("symbol").isin(FACTORS + RATES))), basket(smooth(s, d)), FACTORS + RATES)

    c.add("exposure_summary", lambda s, d: exposed(s, d).withColumn("pruned", F.array_join("pruned", ",")), "symbol ~alpha ~r2 ~share ~residual ~penalty months:int start finish pruned")
    c.add("exposure_betas", lambda s, d: exposed(s, d).select("symbol", F.inline("betas")), "symbol leg ~beta ~se ~change_6 ~change_12")
    c.add("exposure_path", lambda s, d: exposed(s, d).select("symbol", F.inline("path")), "symbol leg month ~beta")

    def rates(s, d):
        x = X.base_rates(smooth(s, d)).selectExpr("symbol", "h", "q25", "q75", "shrunk AS q50")
        return P.spreads_by_horizon(x).withColumnRenamed("h", "months")

    fields = " ".join(f"~{f}" for f in ("q05", "q25", "q50", "q75", "q95", "iv_atm", "skew_25d", "p_up10", "p_dn10", "p_up20", "p_dn20", "rn_mean", "span", "forward"))
    c.add("implied_by_horizon", lambda s, d: I.implied(chain(s, d), AS_OF), f"underlying months:int expiry {fields} n_strikes:int monotone quality")
    c.add("implied_shifted", lambda s, d: I.to_base_rates(I.implied(chain(s, d), AS_OF), rates(s, d)), "underlying months:int ~implied_iqr ~width_ratio ~mean_shift ~rw_q05 ~rw_q25 ~rw_q50 ~rw_q75 ~rw_q95")

    def families(s, d):
        return smooth(s, d).select("symbol").distinct().withColumn("sector", F.concat(F.lit("maker "), F.substring("symbol", 7, 1)))

    shown = "sector symbol month rank:int bucket ~expected ~confidence sure " + " ".join(f"~p_{b}" for b in peers.BUCKETS) + " ~predicted_last ~realized_last"
    c.add("sector_forecast", lambda s, d: peers.forecasts(stored(s, d), families(s, d)), shown)
    c.add("peer_projection", lambda s, d: peers.projected(peers.forecasts(stored(s, d), families(s, d)), MARKET).withColumn("peers", F.to_json("peers")), "sector symbol bucket ~expected ~confidence peers")
