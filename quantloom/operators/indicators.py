"""Recursive and path-dependent indicators.

What recurs over rows (exponential means, a position's state) runs on one symbol's history at a time, as a grouped pandas
function: a history is bounded by the calendar, and symbols are spread over the cluster. The rest is window functions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import bars as B


def ema(x: pd.Series, n: int) -> pd.Series:
    """Exponential mean of span ``n`` that starts at the first value."""
    return x.ewm(span=n, adjust=False).mean()


def wilder_rsi(close: pd.Series, n: int) -> pd.Series:
    """Relative strength with Wilder's smoothing; 50 where undefined, 100 without losses, 0 without gains."""
    move = close.diff()
    gain = move.clip(lower=0).ewm(alpha=1 / n, adjust=False, min_periods=n).mean()
    loss = (-move).clip(lower=0).ewm(alpha=1 / n, adjust=False, min_periods=n).mean()
    out = 100 - 100 / (1 + gain / loss.where(loss != 0))
    out = out.mask((loss == 0) & (gain > 0), 100.0).mask((gain == 0) & (loss > 0), 0.0)
    return out.fillna(50.0)


def _per_symbol(bars: DataFrame, fn, schema: str) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return fn(rows.sort_values("date").reset_index(drop=True))

    return bars.groupBy("symbol").applyInPandas(run, schema)


def ema_stack(bars: DataFrame, lengths: tuple[int, ...] = (21, 50, 200)) -> DataFrame:
    def run(x: pd.DataFrame) -> pd.DataFrame:
        return x[["symbol", "date"]].assign(**{f"ema_{n}": ema(x["close"], n) for n in lengths})

    return _per_symbol(bars.select("symbol", "date", "close"), run, "symbol string, date date, " + ", ".join(f"ema_{n} double" for n in lengths))


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    return _per_symbol(bars.select("symbol", "date", "close"), lambda x: x[["symbol", "date"]].assign(rsi=wilder_rsi(x["close"], n)), "symbol string, date date, rsi double")


def crossovers(bars: DataFrame, fast: int = 21, slow: int = 55, most: int = 5) -> DataFrame:
    """The newest sign changes of the spread between two exponential means."""
    e = ema_stack(bars, (fast, slow)).withColumn("sg", F.signum(F.col(f"ema_{fast}") - F.col(f"ema_{slow}")))
    x = e.withColumn("before", F.lag("sg").over(B.by())).where("sg * before < 0")
    out = x.withColumn("rank", F.row_number().over(B.newest())).where(F.col("rank") <= most)
    return out.select("symbol", "date", F.when(F.col("sg") > 0, "up").otherwise("down").alias("direction"), "rank")


def volatility_by_cell(bars: DataFrame) -> DataFrame:
    """Mean, median and count of rolling volatility by two-by-two state."""
    both = B.cells(bars).where("cell is not null").select("symbol", "date", "cell").join(B.log_volatility(bars).select("symbol", "date", "vol"), ["symbol", "date"])
    return both.groupBy("symbol", "cell").agg(F.avg("vol").alias("mean"), F.percentile("vol", 0.5).alias("median"), F.count("vol").alias("n"))


@dataclass(frozen=True)
class FlowConfig:
    norm: int = 100
    signal: int = 9
    trigger: float = 25.0
    strong: float = 55.0


def _flow(x: pd.DataFrame, cfg: FlowConfig) -> pd.DataFrame:
    close, volume = x["close"], x["volume"].fillna(0.0)

    def centred(s: pd.Series) -> pd.Series:
        lo, hi = s.rolling(cfg.norm, min_periods=1).min(), s.rolling(cfg.norm, min_periods=1).max()
        base = ((s - lo) / (hi - lo).where(hi > lo) * 100).fillna(50.0)
        return (((base + (base - base.shift(3)).fillna(0.0)) - 50) * 2).clip(-100, 100)

    way = np.sign(close - x["open"])
    way = way.where(way != 0, np.sign(close.diff()).fillna(0.0))
    volume_part = centred((way * volume).cumsum())
    r14, r3 = wilder_rsi(close, 14), wilder_rsi(close, 3)
    momentum_part = centred(r14.diff().fillna(0.0) + r3.rolling(3).mean().fillna(50.0))
    mean30 = close.rolling(30).mean()
    trend_part = centred(((ema(close, 13) - mean30) / mean30).fillna(0.0))
    typical = (x["high"] + x["low"] + close) / 3
    middle = (typical * volume).rolling(cfg.norm, min_periods=1).sum() / volume.rolling(cfg.norm, min_periods=1).sum().replace(0, np.nan)
    spread = typical.rolling(cfg.norm, min_periods=1).std(ddof=0)
    value_part = ((close - middle) / (2 * spread.replace(0, np.nan)) * 100).fillna(0.0).clip(-100, 100)
    sigma = close.rolling(10, min_periods=1).std(ddof=0)
    rising = close.diff() > 0
    up, down = ema(sigma.where(rising, 0.0), 10), ema(sigma.where(close.diff() <= 0, 0.0), 10)
    rvi_part = (((up / (up + down).replace(0, np.nan) * 100).fillna(50.0) - 50) * 2).clip(-100, 100)
    score = ema(0.28 * volume_part + 0.25 * trend_part + 0.20 * momentum_part + 0.17 * value_part + 0.10 * rvi_part, cfg.signal)
    signal = ema(score, cfg.signal)
    long_, short = (score > cfg.trigger) & (score > signal), (score < -cfg.trigger) & (score < signal)
    state = np.select([long_ & (score > cfg.strong), long_, short & (score < -cfg.strong), short], ["STRONG LONG", "LONG OK", "STRONG SHORT", "AVOID CALLS"], "NEUTRAL")
    fresh = lambda s: s & ~s.shift(1, fill_value=False)
    return x[["symbol", "date"]].assign(flow_score=score, signal=signal, state=state, fresh_long=fresh(long_), fresh_short=fresh(short))


def flow_compass(bars: DataFrame, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """Smoothed blend of volume flow, trend, momentum, value and relative volatility, with its state and fresh turns."""
    schema = "symbol string, date date, flow_score double, signal double, state string, fresh_long boolean, fresh_short boolean"
    return _per_symbol(bars.select("symbol", "date", "open", "high", "low", "close", "volume"), lambda x: _flow(x, cfg), schema)


@dataclass(frozen=True)
class RidgeConfig:
    capital: float = 10_000.0
    share: float = 0.9
    most_cash: float = 30_000.0
    fast: int = 75
    base: int = 150
    major: int = 200
    confirm: int = 2
    exit_style: str = "Major Breakdown"
    commission: float = 0.0001


def _ridge(x: pd.DataFrame, cfg: RidgeConfig) -> pd.DataFrame:
    close = x["close"]
    fast, base, major, strength = ema(close, cfg.fast), ema(close, cfg.base), close.rolling(cfg.major).mean(), wilder_rsi(close, 14)
    trend = fast > base
    row = pd.Series(np.arange(len(close)))
    since = (row - row.where(~trend).ffill()).fillna(cfg.confirm)
    confirmed = trend & (since >= cfg.confirm - 1)
    leave = {
        "Fast/Base Cross": (fast < base) & (fast.shift(1) >= base.shift(1)),
        "Emergency Only": (close < major) & (close < base) & (strength < 40),
    }.get(cfg.exit_style, (close < major) & (fast < base))
    cash, held, paid, equity, results = cfg.capital, 0, 0.0, [], []
    bought = sold = False
    for price, enter, out in zip(close, confirmed, leave):
        bought = sold = False
        wanted = int(min((cash + held * price) * cfg.share, cfg.most_cash) // price) if price > 0 else 0
        if held == 0 and enter and wanted:
            size = min(wanted, int(cash // (price * (1 + cfg.commission))))
            if size:
                paid = size * price * (1 + cfg.commission)
                cash, held, bought = cash - paid, size, True
        elif held and out:
            got = held * price * (1 - cfg.commission)
            results.append(got - paid)
            cash, held, sold = cash + got, 0, True
        equity.append(cash + held * price)
    curve = pd.Series(equity)
    state = "LONG" if held else "WATCH" if trend.iloc[-1] else "CASH"
    advice = "BUY" if bought else "SELL" if sold else "HOLD LONG" if held else "BUY SETUP" if confirmed.iloc[-1] else "WATCH" if trend.iloc[-1] else "CASH"
    return pd.DataFrame({
        "symbol": [x["symbol"].iloc[0]], "state": [state], "recommendation": [advice], "ending_equity": [equity[-1]], "total_return": [equity[-1] / cfg.capital - 1],
        "max_drawdown": [(curve / curve.cummax() - 1).min()], "closed_trades": [len(results)], "win_rate": [sum(r > 0 for r in results) / len(results) if results else 0.0],
    })


def ridge_strategy(bars: DataFrame, cfg: RidgeConfig = RidgeConfig()) -> DataFrame:
    """One position at a time along each close series: entered on a confirmed trend, left by the chosen exit style."""
    schema = "symbol string, state string, recommendation string, ending_equity double, total_return double, max_drawdown double, closed_trades int, win_rate double"
    return _per_symbol(bars.select("symbol", "date", "close"), lambda x: _ridge(x, cfg), schema)
