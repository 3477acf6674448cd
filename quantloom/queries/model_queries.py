"""Queries over statistical models, vectors and packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import cross as X
from quantloom.operators import models as M
from quantloom.plans import packet
from quantloom.queries import Catalog
from quantloom.queries.sql import SMOOTH
from quantloom.sources import tables

FACTORS = ["Brand#11", "Brand#12", "Brand#13"]


def register(c: Catalog) -> None:
    smooth = tables.bars_smooth
    c.add("ols_factor_table", lambda s, d: M.factor_regression(smooth(s, d), FACTORS), "symbol name ~coef ~t ~r2 n:int")
    c.add("ridge_exposure", lambda s, d: M.exposure(smooth(s, d), FACTORS), "symbol factor ~beta ~lambda")
    c.add("pca_signals", lambda s, d: M.pca(smooth(s, d), sorted(r[0] for r in tables.table(s, d, "part").select("p_brand").distinct().collect())), "component ~share symbol ~loading")  # brands are a small dimension
    c.add("spectral_modes", lambda s, d: M.spectral_modes(smooth(s, d)), "symbol rank:int ~period ~amplitude ~phase ~share")
    c.add("hmm_regimes", lambda s, d: M.regimes(smooth(s, d)), "symbol date state filtered ~p")
    c.add("scenario_mixture", lambda s, d: M.scenarios(smooth(s, d)), "symbol h:int ~mean ~p_bear ~p_neutral ~p_bull ~bear ~neutral ~bull")
    c.add("stack_oos", lambda s, d: M.walk_forward(X.monthly_panel(smooth(s, d))), "symbol month ~target ~prediction")
    c.add("deflated_sharpe", lambda s, d: M.sharpe_table(smooth(s, d)), "symbol ~sharpe ~skew ~kurt ~dsr")
    c.add("return_moments", lambda s, d: M.sharpe_table(smooth(s, d)), "symbol ~sharpe ~kurt", SMOOTH, "SELECT symbol, avg(ret) / nullif(stddev_samp(ret), 0) AS sharpe, kurtosis_pop(ret) + 3 AS kurt FROM (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM bars) WHERE ret IS NOT NULL GROUP BY symbol")
    c.add("distribution_fit", lambda s, d: M.distribution_fit(smooth(s, d)), "symbol family ~ks")

    def centroids(s, d):
        v = tables.table(s, d, "embeddings").where("embedding is not null and label is not null")
        x = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
        a, b = x.toDF("a", "i", "x"), x.toDF("b", "i", "y")
        return a.join(b, "i").where("a < b").groupBy("a", "b").agg((F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))).alias("cosine"))

    c.add("embedding_cosine", centroids, "a b ~cosine", "x AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IS NOT NULL) GROUP BY ALL)", "SELECT a.label AS a, b.label AS b, sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) AS cosine FROM x a JOIN x b ON a.i = b.i AND a.label < b.label GROUP BY ALL")
    c.add("research_packet", lambda s, d: packet.packets(tables.written(smooth(s, d))), "symbol as_of packet")
