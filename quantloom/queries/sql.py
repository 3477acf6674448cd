"""The logical tables of sources.tables as DuckDB common table expressions."""

TRADES = """trades AS (
    SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity AS size,
           row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS seq
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""

BARS = TRADES + """, bars AS (
    SELECT symbol, date, min_by(price, seq) AS open, max(price) AS high, min(price) AS low, max_by(price, seq) AS close, sum(size) AS volume
    FROM trades GROUP BY symbol, date)"""

SMOOTH = """d0 AS (
    SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, round((avg(l_discount) - 0.05) / 2, 9) AS r, round(avg(l_tax) / 10, 9) AS t, sum(l_quantity) AS volume
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
c0 AS (SELECT *, round(100 * exp(sum(r) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)), 6) AS close FROM d0),
o0 AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY date), 100.0) AS open FROM c0),
bars AS (
    SELECT symbol, date, open, round(greatest(open, close) * (1 + t), 6) AS high, round(least(open, close) / (1 + t), 6) AS low, close, volume FROM o0)"""

QUARTERS = """q0 AS (
    SELECT c_mktsegment AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS start, round(sum(o_totalprice), 2) AS revenue, round(avg(c_acctbal), 2) AS acct, count(*) AS n_orders
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
quarters AS (
    SELECT symbol, CAST(start + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end, CAST(start + INTERVAL 3 MONTH + INTERVAL 29 DAY AS DATE) AS filing_date,
           year(start) AS fiscal_year, quarter(start) AS fiscal_quarter, revenue,
           round(revenue * (0.45 + (n_orders % 17) / 100), 2) AS gross_profit, round(revenue * (0.10 + (n_orders % 11) / 100), 2) AS operating_income,
           round(revenue * 0.12 + acct, 2) AS cfo, round(-revenue * 0.04, 2) AS capex
    FROM q0)"""

CONTRACTS = """contracts AS (
    SELECT p_brand AS underlying, CAST(DATE '2024-01-01' + CAST((p_partkey % 24) * 30 + 18 AS INTEGER) AS DATE) AS expiry, CAST(p_size * 5 AS DOUBLE) AS strike,
           CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS type, count(*) AS oi, round(avg(p_retailprice) / 100, 4) AS mark
    FROM part GROUP BY ALL)"""

RETURNS = """rets AS (SELECT symbol, date, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM bars)"""
