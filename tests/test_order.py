"""Means of logical tables don't depend on the order in which rows are read."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from quantloom.queries import catalog
from quantloom.sources import tables

QUERIES = catalog().queries
#: Tenths whose mean lies half-way between two marks.
TENTHS = [9216, 9648, 9851, 9587, 9273, 9291, 9127, 9064, 9493, 9874, 9654, 9495, 9090, 9352, 9819, 9068, 9420, 9918, 9154, 9020, 9300, 9437, 9787, 9425, 9893, 9121, 9045, 9619, 9629, 9779, 9046, 9386, 9735, 9600, 9338, 9564, 9902, 9944, 9285, 9517]
#: How many discounts of 0.00, 0.01 … 0.10 a day has, whose return lies half-way between two of nine places.
DISCOUNTS = [13, 3, 6, 15, 5, 13, 8, 18, 18, 12, 17]


@pytest.fixture(scope="module", params=[1, -1], ids=["rising", "falling"])
def folder(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("order"))
    parts = [(48 * i, "Brand#1", 20, t / 10) for i, t in enumerate(sorted(TENTHS)[:: request.param])]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{path}/part.parquet")
    day = datetime.datetime(2000, 1, 3)
    items = [(0, day, d / 100, 0.02, 1.0) for d, n in list(enumerate(DISCOUNTS))[:: request.param] for _ in range(n)] + [(0, day + datetime.timedelta(1), 0.050000002, 0.02, 1.0)]
    spark.createDataFrame(items, "l_partkey long, l_shipdate timestamp_ntz, l_discount double, l_tax double, l_quantity double").coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return path


def test_marks_half_way(spark, folder):
    assert [r.mark for r in tables.contracts(spark, folder).collect()] == [9.4691]
    assert [(r.oi, r.mark) for r in QUERIES["option_chain_rows"](spark, folder).collect()] == [(40.0, 9.9691)]


def test_mid_of_marks_half_way(spark, folder):
    assert [r.mid for r in QUERIES["quote_mid"](spark, folder).collect()] == [18.9382]


def test_trend_of_returns_half_way(spark, folder):
    rows = QUERIES["bars_since_trend_off"](spark, folder).orderBy("date").collect()
    assert [(r.trend_on, r.since_off) for r in rows] == [(False, 0), (True, 1)]


def test_means_of_values_that_are_no_decimals(spark):
    """As a mean of doubles: nulls take no part, values that aren't finite or too large stay what they are."""
    rows = [(1, 0.1), (1, 0.2), (1, None), (2, math.nan), (2, 1.0), (3, math.inf), (3, 1.0), (4, 1e300), (5, None), (6, 9e19), (6, 9e19)]
    got = {r.k: r.m for r in spark.createDataFrame(rows, "k int, x double").groupBy("k").agg(tables.mean("x").alias("m")).collect()}
    assert math.isnan(got.pop(2)) and got == {1: 0.15, 3: math.inf, 4: 1e300, 5: None, 6: 9e19}
    whole = spark.range(1).select(*(tables.rounded(F.lit(x), 4).alias(str(i)) for i, x in enumerate((0.00005, -0.00005, math.inf, None)))).first()
    assert list(whole) == [0.0001, -0.0001, math.inf, None]
