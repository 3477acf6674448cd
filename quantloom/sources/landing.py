"""What connectors fetch, brought to the library's tables.

Fetching is a landing job's work; these functions start from the landed rows: vendors' JSON, CSV and HTML.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import scalars as S

#: Days that a period token reaches back; other tokens reach 400.
PERIOD_DAYS = {"1d": 7, "5d": 14, "1wk": 14, "1mo": 45, "3mo": 120, "6mo": 220, "1y": 400, "2y": 800, "5y": 1900, "10y": 3800, "max": 8000}
#: What a factor file writes for missing.
MISSING = (-99.99, -999.0, -9999.0)


def in_period(bars: DataFrame, period: str, today: str) -> DataFrame:
    """Rows of the period that ends with tomorrow; a range of dates, so it reaches the scan."""
    end = F.date_add(F.lit(today).cast("date"), 1)
    return bars.where((F.col("date") >= F.date_sub(end, PERIOD_DAYS.get(period, 400))) & (F.col("date") <= end))


def aggregates(raw: DataFrame) -> DataFrame:
    """symbol and json {"results": [{t, o, h, l, c, v}, …]} to bars; times in any epoch unit."""
    schema = "results array<struct<t: bigint, o: double, h: double, l: double, c: double, v: double>>"
    x = raw.select("symbol", F.explode(F.from_json("json", schema)["results"]).alias("r"))
    return x.select("symbol", F.to_date(S.from_epoch(F.col("r.t"))).alias("date"), F.col("r.o").alias("open"), F.col("r.h").alias("high"), F.col("r.l").alias("low"), F.col("r.c").alias("close"), F.coalesce("r.v", F.lit(0.0)).alias("volume"))


def currency(column: str):
    """``$1,234.50`` as a number; blanks and N/A are null."""
    return F.regexp_replace(column, r"[$,\s]", "").try_cast("double")


def csv_history(rows: DataFrame) -> DataFrame:
    """Vendor rows of text (symbol, date as MM/dd/yyyy, open, high, low, close, volume) to bars."""
    return rows.select("symbol", F.try_to_timestamp("date", F.lit("MM/dd/yyyy")).cast("date").alias("date"), *(currency(c).alias(c) for c in ("open", "high", "low", "close", "volume")))


def prefer(first: DataFrame, second: DataFrame, least_days: int = 365, late_days: int = 90) -> DataFrame:
    """The first provider's bars, but the second's for symbols that the first lacks or whose history starts too late."""
    span = first.unionByName(second).groupBy("symbol").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    own = first.groupBy("symbol").agg(F.min("date").alias("own"))
    good = span.join(own, "symbol").where((F.datediff("hi", "lo") < least_days) | (F.datediff("own", "lo") <= late_days)).select("symbol")
    return first.join(good, "symbol", "left_semi").withColumn("provider", F.lit("first")).unionByName(second.join(good, "symbol", "left_anti").withColumn("provider", F.lit("second")))


def series(rows: DataFrame) -> DataFrame:
    """series_id, date and value of an economic series' text rows; a dot is missing."""
    return rows.select("series_id", F.to_date("date").alias("date"), F.col("value").try_cast("double").alias("value")).where("value is not null")


def factors(lines: DataFrame) -> DataFrame:
    """Daily factor returns from the lines (value) of a published file: eight-digit dates only, per cents as shares."""
    x = lines.where(F.col("value").rlike(r"^\s*\d{8}\s*,")).select(F.split("value", r"\s*,\s*").alias("p"))
    cell = lambda i: F.element_at("p", i).try_cast("double")
    clean = lambda i: F.when(~cell(i).isin(*MISSING), cell(i) / 100)
    return x.select(F.to_date(F.trim(F.element_at("p", 1)), "yyyyMMdd").alias("date"), *(clean(i + 2).alias(n) for i, n in enumerate(("mkt", "smb", "hml", "rmw", "cma", "rf"))))


def company_facts(raw: DataFrame) -> DataFrame:
    """symbol and json of nested facts to (symbol, taxonomy, concept, unit, end, value, filed, form)."""
    row = "struct<`end`: string, val: double, filed: string, form: string, fy: int, fp: string>"
    schema = f"facts map<string, map<string, struct<units: map<string, array<{row}>>>>>"
    x = raw.select("symbol", F.explode(F.from_json("json", schema)["facts"]).alias("taxonomy", "c"))
    x = x.select("symbol", "taxonomy", F.explode("c").alias("concept", "u")).select("symbol", "taxonomy", "concept", F.explode("u.units").alias("unit", "rows"))
    x = x.select("symbol", "taxonomy", "concept", "unit", F.explode("rows").alias("r"))
    return x.select("symbol", "taxonomy", "concept", "unit", F.to_date("r.end").alias("period_end"), F.col("r.val").alias("value"), F.to_date("r.filed").alias("filing_date"), "r.form", F.col("r.fy").alias("fiscal_year"), F.col("r.fp").alias("fiscal_period"))


def pick_fact(facts: DataFrame, concepts: list[str], unit: str = "USD") -> DataFrame:
    """Each symbol's newest row of the first concept that has one, the preferred unit before others."""
    x = facts.where(F.col("concept").isin(concepts)).withColumn("place", F.array_position(F.array(*map(F.lit, concepts)), F.col("concept")))
    w = Window.partitionBy("symbol").orderBy("place", (F.col("unit") != unit).cast("int"), F.desc("filing_date"), F.desc("period_end"), F.desc("fiscal_year"))
    return x.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "place")


def submissions(raw: DataFrame) -> DataFrame:
    """symbol and json of parallel arrays (form, filingDate, accessionNumber) to one row per filing, in order."""
    x = raw.select("symbol", F.from_json("json", "form array<string>, filingDate array<string>, accessionNumber array<string>").alias("j"))
    x = x.select("symbol", F.posexplode(F.arrays_zip("j.form", "j.filingDate", "j.accessionNumber")).alias("pos", "z"))
    return x.select("symbol", "pos", F.col("z.form").alias("form"), F.to_date("z.filingDate").alias("filing_date"), F.col("z.accessionNumber").alias("accession"))


def newest_filings(filings: DataFrame, as_of: str, wanted: dict[str, int]) -> DataFrame:
    """The newest filings of each wanted form on or before a date."""
    most = F.element_at(F.create_map(*(F.lit(x) for k, v in wanted.items() for x in (k, v))), F.col("form"))
    x = filings.where((F.col("filing_date") <= F.lit(as_of).cast("date")) & F.col("form").isin(*wanted))
    return x.withColumn("rn", F.row_number().over(Window.partitionBy("symbol", "form").orderBy(F.desc("filing_date"), "pos"))).where(F.col("rn") <= most).drop("rn")


def watchlist(pages: DataFrame) -> DataFrame:
    """list_id and html to the distinct symbols in its embedded "symbols": […] blocks, in order."""
    block = F.regexp_extract_all("html", F.lit(r'"symbols"\s*:\s*(\[[^\]]*\])'), F.lit(1))
    x = pages.select("list_id", F.flatten(F.transform(block, lambda b: F.coalesce(F.from_json(b, "array<string>"), F.array().cast("array<string>")))).alias("s"))
    return x.select("list_id", F.posexplode(F.array_distinct(F.filter(F.transform("s", S.clean_symbol), lambda v: v.isNotNull()))).alias("pos", "symbol"))


def news_about(news: DataFrame, symbol: str, most_others: int, limit: int) -> DataFrame:
    """The newest items that mention a symbol beside few others."""
    return news.where(F.array_contains("tickers", symbol) & (F.size("tickers") - 1 <= most_others)).orderBy(F.desc("published"), "url").limit(limit)


def chain_rows(raw: DataFrame) -> DataFrame:
    """underlying and json of a chain page to contracts, greeks and quotes flattened and the spot beside them."""
    row = "struct<details: struct<strike_price: double, expiration_date: string, contract_type: string>, open_interest: double, implied_volatility: double, greeks: struct<delta: double>, last_quote: struct<bid: double, ask: double>, day: struct<close: double>, underlying_asset: struct<price: double>>"
    x = raw.select("underlying", F.explode(F.from_json("json", f"results array<{row}>")["results"]).alias("r"))
    mid = F.when((F.col("r.last_quote.ask") >= F.col("r.last_quote.bid")) & (F.col("r.last_quote.bid") > 0), (F.col("r.last_quote.ask") + F.col("r.last_quote.bid")) / 2).otherwise(F.col("r.day.close"))
    return x.select("underlying", F.to_date("r.details.expiration_date").alias("expiry"), F.col("r.details.strike_price").alias("strike"), F.col("r.details.contract_type").alias("type"), F.coalesce("r.open_interest", F.lit(0.0)).alias("oi"), F.col("r.implied_volatility").alias("iv"), F.col("r.greeks.delta").alias("delta"), mid.alias("mark"), F.col("r.underlying_asset.price").alias("spot")).where("strike > 0 and expiry is not null")


def company_ids(raw: DataFrame) -> DataFrame:
    """json {"0": {"ticker", "cik_str", …}, …} to (symbol, cik), capitals and ten digits; of a symbol's entries the last stays."""
    x = raw.select(F.explode(F.from_json("json", "map<string, struct<ticker: string, cik_str: bigint>>")).alias("k", "v"))
    own = x.where("v.ticker is not null and v.cik_str is not null").select(F.upper("v.ticker").alias("symbol"), F.col("v.cik_str").alias("n"), F.col("k").try_cast("long").alias("k"))
    return own.groupBy("symbol").agg(F.max_by("n", "k").alias("n")).select("symbol", F.lpad(F.col("n").cast("string"), 10, "0").alias("cik"))


def universe(dimension: DataFrame, symbol: str | None = None, sector: str | None = None, broad: bool = False, limit: int | None = None) -> DataFrame:
    """symbol and pos: a sector's symbols, or the peers of a symbol (itself among them), or all; ``broad`` adds all behind the peers.

    ``dimension`` has symbol and sector. Where nothing is found it is all. Its window holds a row per symbol of the dimension.
    """
    names = dimension.select("symbol", F.lower(F.trim("sector")).alias("sector")).dropDuplicates(["symbol"])
    if sector is not None:
        own = names.where(F.col("sector") == sector.strip().lower()).withColumn("turn", F.lit(1))
    elif symbol is not None:
        mine = names.where(F.col("symbol") == symbol).select("sector")
        peers = names.join(F.broadcast(mine), "sector", "left_semi").select("symbol").withColumn("turn", F.lit(1))
        itself = dimension.sparkSession.createDataFrame([(symbol, 1)], "symbol string, turn int")
        own = peers.unionByName(itself).dropDuplicates(["symbol"])
        if broad:
            own = own.unionByName(names.join(own, "symbol", "left_anti").select("symbol", F.lit(2).alias("turn")))
    else:
        own = names.withColumn("turn", F.lit(1))
    own = own.select("symbol", "turn")
    if own.isEmpty():
        own = names.select("symbol", F.lit(1).alias("turn"))
    out = own.withColumn("pos", F.row_number().over(Window.orderBy("turn", "symbol"))).select("symbol", "pos")
    return out.where(F.col("pos") <= limit) if limit else out
