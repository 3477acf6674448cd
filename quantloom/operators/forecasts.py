"""Weighing and calibrating the components of a forecast by what they have been worth out of sample.

Tables are long: (symbol, date, component, predicted), (symbol, date, realized), (symbol, h, component, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Prior weights of the components.
PRIOR = {"seasonality": 0.15, "regime": 0.25, "factors": 0.20, "spectral": 0.15, "fundamentals": 0.15, "macro": 0.10}
#: Least skill factor, that of a component not measured, the skill that earns full credit, blocks of the horizon prior, greatest confidence.
SKILL_FLOOR, SKILL_UNMEASURED, SKILL_SCALE, PRIOR_BLOCKS, MOST_CONFIDENCE = 0.25, 0.5, 0.05, 10.0, 0.90


def skills(predictions: DataFrame, realized: DataFrame, holdout: int = 252, margin: int = 60) -> DataFrame:
    """symbol, component, skill and n_test: 1 less the mean squared error over that of the mean realised before the holdout.

    The last ``holdout`` dates of a symbol that have predictions and a realised value are the test. There is no skill (null) with
    too few dates, with fewer than three quarters of the holdout (5 to 30) predicted, or where the realised value never differs.
    """
    dates = predictions.select("symbol", "date").distinct().join(realized.where("realized is not null and not isnan(realized)"), ["symbol", "date"])
    w = Window.partitionBy("symbol")
    aged = dates.withColumn("age", F.row_number().over(w.orderBy(F.desc("date")))).withColumn("n", F.count("*").over(w))
    based = aged.withColumn("base", F.avg(F.when(F.col("age") > holdout, F.col("realized"))).over(w))
    test = based.where((F.col("age") <= holdout) & (F.col("n") > holdout + margin)).withColumn("spread", F.avg(F.pow(F.col("realized") - F.col("base"), F.lit(2))).over(w))
    ok = predictions.where("predicted is not null and not isnan(predicted)").join(test.select("symbol", "date", "realized", "spread"), ["symbol", "date"])
    g = ok.groupBy("symbol", "component").agg(F.avg(F.pow(F.col("realized") - F.col("predicted"), F.lit(2))).alias("mse"), F.max("spread").alias("spread"), F.count("*").alias("n_test"))
    least = max(5, min(30, round(holdout * 0.75)))
    names = predictions.select("symbol", "component").distinct()
    scored = F.when((F.col("n_test") >= least) & (F.col("spread") > 0), 1 - F.col("mse") / F.col("spread"))
    return names.join(g, ["symbol", "component"], "left").select("symbol", "component", scored.alias("skill"), F.coalesce("n_test", F.lit(0)).alias("n_test"))


def weights(skill: DataFrame, prior: dict[str, float] | None = None, strength: float = 0.5) -> DataFrame:
    """symbol, component and weight (of a symbol, one in sum): ``strength`` prior, the rest measured.

    Measured is each scored component's share of the positive skills; where none is positive and two or more are scored, of the
    skills above the worst. Components that weren't scored keep their prior share; where nothing was measured, all do.
    Without a prior, components weigh alike; one the prior lacks weighs nothing in it, and if it lacks them all they weigh alike.
    """
    w = Window.partitionBy("symbol")
    given = F.lit(1.0) if prior is None else F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in prior.items() for x in (k, float(v)))), F.col("component")), F.lit(0.0))
    x = skill.withColumn("given", given)
    x = x.withColumn("prior", F.coalesce(F.col("given") / F.nullif(F.sum("given").over(w), F.lit(0.0)), 1 / F.count("*").over(w)))
    x = x.withColumn("above", F.greatest("skill", F.lit(0.0))).withColumn("rise", F.col("skill") - F.min("skill").over(w))
    relative = (F.coalesce(F.sum("above").over(w), F.lit(0.0)) <= 0) & (F.count("skill").over(w) >= 2)
    x = x.withColumn("credit", F.when(F.col("skill").isNotNull(), F.when(relative, F.col("rise")).otherwise(F.col("above"))))
    x = x.withColumn("total", F.coalesce(F.sum("credit").over(w), F.lit(0.0))).withColumn("held", F.coalesce(F.sum(F.when(F.col("skill").isNotNull(), F.col("prior"))).over(w), F.lit(0.0)))
    scale = F.when(F.col("held") > 0, F.col("held")).otherwise(1.0)
    x = x.withColumn("measured", F.when(F.col("total") <= 0, F.col("prior")).when(F.col("skill").isNotNull(), F.col("credit") / F.col("total") * scale).otherwise(F.col("prior")))
    x = x.withColumn("blend", strength * F.col("prior") + (1 - strength) * F.col("measured") / F.coalesce(F.nullif(F.sum("measured").over(w), F.lit(0.0)), F.lit(1.0)))
    return x.select("symbol", "component", (F.col("blend") / F.sum("blend").over(w)).alias("weight"))


def shrunk(components: DataFrame) -> DataFrame:
    """The rows with confidence, calibrated value and what it was clamped to.

    ``components``: symbol, h (rows ahead), component, value, evidence (0 to 1), skill, n_obs, prior, low, high. Confidence is the
    evidence times a factor of the skill and one of how many whole horizons were observed (null: ten years), 0.9 at most;
    the value moves to the prior by what confidence lacks, and then into the bounds. A null value stays null, a null prior or
    bound does nothing.
    """
    factor = F.when(F.col("skill").isNull() | F.isnan("skill"), SKILL_UNMEASURED).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(SKILL_FLOOR), 0.5 + 0.5 * F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("skill") / SKILL_SCALE)))))
    blocks = F.when(F.col("n_obs") > 0, F.col("n_obs")).otherwise(2520) / F.greatest("h", F.lit(1))
    confidence = F.least(F.lit(MOST_CONFIDENCE), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("evidence", F.lit(0.0)))) * factor * blocks / (blocks + PRIOR_BLOCKS))
    x = components.withColumn("confidence", confidence)
    x = x.withColumn("raw", F.when(F.col("prior").isNull(), F.col("value")).otherwise(F.col("confidence") * F.col("value") + (1 - F.col("confidence")) * F.col("prior")))
    clamped = F.when(F.col("raw") < F.col("low"), "low").when(F.col("raw") > F.col("high"), "high")
    x = x.withColumn("clamped", clamped).withColumn("calibrated", F.when(F.col("clamped") == "low", F.col("low")).when(F.col("clamped") == "high", F.col("high")).otherwise(F.col("raw")))
    return x.drop("raw")
