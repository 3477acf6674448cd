"""The second packet: contract, memo, guard of snapshots, validation, one grouping in place of joins."""

import json
import math

import pytest
from pyspark.sql import functions as F

from quantloom.operators import memos as M
from quantloom.plans import packet
from quantloom.plans import situation as P
from quantloom.queries import catalog, packet_queries

DAY = "2024-03-01"


@pytest.fixture(scope="module")
def hand(spark):
    """A symbol with all that a memo reads, one with NaN and nulls in it, one without any row."""
    symbols = spark.sql(f"SELECT symbol, date'{DAY}' AS as_of FROM VALUES ('A'), ('B'), ('C') AS t(symbol)")
    beta = "array<struct<leg: string, beta: double>>"
    exposure = spark.createDataFrame([("A", 0.61, 0.39, [("oil", -0.8), ("rates", 0.5), ("gold", 0.5), ("x", None)]), ("B", math.nan, None, [("oil", math.nan)]), ("Z", 0.1, 0.9, [])], f"symbol string, r2 double, share double, betas {beta}")
    levels = spark.createDataFrame([("A", 50.0, 48.0, (40.0, 42.5), (60.0, 61.0)), ("B", None, 3.0, None, None)], "symbol string, current_price double, poc double, cheap struct<lo: double, hi: double>, rich struct<lo: double, hi: double>")
    chain = spark.createDataFrame([("A", "2024-03-04T10:00:00", 50.0), ("B", "2024-03-09", 7.0)], "symbol string, snapshot_ts string, underlying_price double")
    flat = [(49.0, 0.5), (50.0, 0.5), (51.0, 0.5)]
    h = [("A", 3, 0.0, 0.3, 1.2, 0.04, flat), ("A", 1, 0.0, 0.25, 1.0, None, flat), ("A", 6, 0.0, None, 0.5, 0.1, None), ("B", 1, 0.0, 0.2, 0.5, 0.0, flat)]
    implied = spark.createDataFrame(h, "symbol string, months int, q50 double, iv_atm double, width_ratio double, skew_25d double, density array<struct<k: double, pdf: double>>")
    o = "symbol string, h int, q05 double, q25 double, q50 double, q75 double, q95 double, source string, p_up double, shrink_w double"
    odds = spark.createDataFrame([("A", 3, -0.2, -0.1, 0.02, 0.1, 0.2, "implied", 0.56, 0.2), ("A", 6, -0.1, 0.0, 0.05, 0.1, 0.3, "base_rates", 0.65, 0.5), ("B", 6, None, None, math.nan, None, None, None, None, None)], o)
    return P.situations(symbols, {"exposure": exposure, "levels": levels, "implied": chain}, {"implied": implied, "odds": odds}, {"text": "no filings"}, [("own", "bars")], F.lit("now")).cache()


def test_contract(hand):
    rows = {r.symbol: json.loads(r.packet) for r in P.packets(hand).collect()}
    assert set(rows) == {"A", "B", "C"}  # a symbol with sections that isn't asked for has no packet
    for body in rows.values():
        assert list(body) == [*P.HEAD, *P.SECTIONS, *P.TAIL, *(f"{n}_error" for n in P.SECTIONS)]
        assert all((body[n] is None) != (body[f"{n}_error"] is None) for n in P.SECTIONS)
        assert {e["source"] for e in body["meta"]["errors"]} == {n for n in P.SECTIONS if body[n] is None}
    assert rows["C"]["text_error"] == "no filings" and rows["C"]["stack_error"] == "not built" and rows["C"]["odds_error"] == "no rows"
    assert rows["B"]["exposure"]["r2"] is None and rows["B"]["sources"] == [{"provider": "own", "note": "bars"}]
    assert [r.problems for r in P.violations(P.packets(hand)).collect()] == [[], [], []]


def test_guard(hand):
    rows = {r.symbol: r for r in hand.collect()}
    assert rows["A"].implied.snapshot_ts[:10] == "2024-03-04" and rows["A"].implied_error is None  # three days
    assert rows["B"].implied is None and "8 days" in rows["B"].implied_error


def test_guard_keeps_what_leaks_nothing(spark):
    rows = spark.sql(f"""SELECT id, date'{DAY}' AS as_of, named_struct('snapshot_ts', ts, 'by_horizon', b) AS implied FROM VALUES
        (1, '2024-03-05', array(1)), (2, '2024-03-06', array(1)), (3, '2024-03-06', array(cast(null as int))), (4, '2024-03-06', null), (5, 'soon', array(1)), (6, null, array(1)), (7, '2020-01-01', array(1)) AS t(id, ts, b)""")
    got = {r.id: (r.implied is not None, r.implied_error is not None, r.implied_note is not None) for r in P.guarded(rows).collect()}
    assert got == {1: (True, False, False), 2: (False, True, False), 3: (True, False, True), 4: (True, False, True), 5: (True, False, False), 6: (True, False, False), 7: (True, False, False)}


def test_memo(hand):
    rows = {r.symbol: r.memo for r in hand.collect()}
    a = rows["A"]
    assert [(d.name, d.direction) for d in a.determinants] == [("oil", "negative"), ("gold", "positive"), ("rates", "positive")]
    assert [(p.months, p.label) for p in a.priced_in] == [(1, "in_line"), (3, "wider")] and a.priced_in[1].text == "3m: ATM IV 30.0%; 1.20x of history, wider; 25-delta skew 0.040"
    assert (a.posture.stance, a.posture.horizon) == ("odds_favorable", 6) and a.posture.conviction == round(0.3 * 0.7, 3)
    assert len(a.falsifiers) == 3 and "oil and gold" in a.falsifiers[0] and "-10.0% to +30.0%" in a.falsifiers[1] and "1.00x" in a.falsifiers[2]
    assert a.zones.cheap.hi == 42.5 and "cheap: 40.00 to 42.50" in a.text and a.text.startswith(f"# A as of {DAY}")
    for s in ("B", "C"):
        assert (rows[s].posture.stance, rows[s].posture.conviction, rows[s].posture.horizon) == ("balanced", 0.0, None) and len(rows[s].falsifiers) == 3
    assert rows["B"].determinants == [] and rows["C"].determinants is None and rows["C"].zones is None and "None." in rows["C"].text


def test_summary_and_markdown(hand):
    s = {r.symbol: r for r in P.summary(hand).collect()}
    assert [(o.h, o.p_up) for o in s["A"].odds] == [(3, 0.56), (6, 0.65)] and s["A"].stack_published is False
    assert set(s["C"].unavailable_sections) == set(P.SECTIONS) - {"memo"} and s["A"].memo_excerpt.startswith("# A")
    old = hand.withColumn("memo", F.col("memo").withField("text", F.lit(" ")))  # a stored packet without a text
    assert {r.symbol: r.markdown for r in P.markdown(old).collect()} == {r.symbol: r.markdown for r in P.markdown(hand).collect()}


def test_violations(spark, hand):
    good = json.loads(P.packets(hand).where("symbol = 'A'").first().packet)
    broken = lambda **k: json.dumps(good | k)
    dense = lambda q50, pdf: {**good["implied"], "by_horizon": [{**good["implied"]["by_horizon"][0], "q50": q50, "density": [{"k": k, "pdf": pdf} for k in (49.0, 50.0, 51.0)]}]}
    less = {k: v for k, v in good.items() if k not in ("odds", "memo_error")}
    rows = [(0, json.dumps(good)), (1, json.dumps(less)), (2, broken(odds_error="?")), (3, broken(sources={}, engine="other")), (4, broken(meta={"errors": {}})), (5, broken(implied=dense(0.0, 0.9))), (6, broken(implied=dense(0.2, 0.5))), (7, "[1]"), (8, "nonsense"), (9, None)]
    x = spark.createDataFrame(rows, "id int, packet string").selectExpr("cast(id as string) AS symbol", f"date'{DAY}' AS as_of", "packet")
    got = {int(r.symbol): r.problems for r in P.violations(x).collect()}
    assert got[0] == [] and sorted(got[1]) == ["missing key: memo_error", "missing key: odds"] and got[2] == ["odds is there and so is its error"]
    assert got[3] == ["sources is no list", "another engine"] and got[4] == ["meta.errors is no list"]
    assert got[5] == ["implied[1]: the density's area is 1.800"] and got[6] == ["implied[1]: the density's median is off q50 by 0.200"]
    assert got[7] == got[8] == got[9] == ["no JSON object"]


def test_unknown_section(spark, hand):
    with pytest.raises(ValueError, match="horoscope"):
        P.situations(hand.select("symbol", "as_of"), {"horoscope": hand.select("symbol")}, {})


def test_gather_is_one_shuffle(spark):
    symbols = spark.sql("SELECT symbol, 1 AS v FROM VALUES ('A'), ('B') AS t(symbol)")
    parts = {n: spark.createDataFrame([("A", i), ("A", i + 1), ("Z", 9)], "symbol string, x int") for i, n in enumerate("pqr")}
    out = packet.gather(symbols, {"p": parts["p"]}, {"q": parts["q"], "r": parts["r"].where("false")})
    assert sorted(out.collect()) == [("A", 1, (1,), [(1,), (2,)], None), ("B", 1, None, None, None)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_width_labels(spark):
    x = spark.createDataFrame(list(enumerate([1.16, 1.15, 0.85, 0.84, None, math.nan])), "id int, r double").coalesce(1)
    assert [r.l for r in x.select(M.width_label(F.col("r")).alias("l")).collect()] == ["wider", "in_line", "in_line", "narrower", None, None]


def test_query(spark, sf_dir):
    """The packets of the test tables keep their contract, and their JSON says what the columns say."""
    x = packet_queries.situations(spark, sf_dir)
    rows = P.packets(x).collect()
    assert len(rows) == 25
    for r in rows:
        body = json.loads(r.packet)
        assert body["odds"]["by_horizon"] and body["state"]["market_cell"] and len(body["memo"]["falsifiers"]) == 3
    assert set(catalog().sql) >= {"implied_guard", "width_labels"}
