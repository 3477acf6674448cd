"""Scalar functions as column expressions; all are null for null."""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """A number as double; NaN, infinities and what isn't a number are null."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def percent(x: Column, digits: int = 1, sign: bool = False) -> Column:
    """A share as a percentage text."""
    share = finite(x) * 100
    return F.when(share.isNotNull(), F.format_string(f"%{'+' if sign else ''}.{digits}f%%", share))


def fixed(x: Column, digits: int = 1) -> Column:
    """A number with so many decimals, rounded by its binary value, as texts for readers show it; for few rows."""
    return F.pandas_udf(lambda s: s.map(lambda v: None if pd.isna(v) else f"{v:.{digits}f}"), "string")(x.cast("double"))


def trimmed(text: Column, limit: int) -> Column:
    """Single spaces, and an ellipsis beyond ``limit`` characters."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…"))).otherwise(t)


def compact(x: Column) -> Column:
    """K, M, B and T with one decimal."""
    size = F.abs(x)
    step = lambda d, s: F.format_string(f"%.1f{s}", x / d)
    return F.when(size >= 1e12, step(1e12, "T")).when(size >= 1e9, step(1e9, "B")).when(size >= 1e6, step(1e6, "M")).when(size >= 1e3, step(1e3, "K")).otherwise(F.format_string("%.1f", x.cast("double")))


def from_epoch(x: Column) -> Column:
    """A time from seconds, milli-, micro- or nanoseconds, told apart by magnitude; times before 1970 are negative."""
    x = x.cast("long")
    size = F.abs(x.cast("decimal(20,0)"))
    micros = F.floor(x.cast("decimal(20,0)") / 1000).cast("long")  # decimals: a double can't hold nanoseconds of today
    return F.when(size >= 10**16, F.timestamp_micros(micros)).when(size >= 10**13, F.timestamp_micros(x)).when(size >= 10**11, F.timestamp_millis(x)).otherwise(F.timestamp_seconds(x))


def session_bucket(ts: Column, interval: str = "15m") -> Column:
    """Start of the 15 minutes, day or week (from Monday) in New York that a UTC time falls in, as a UTC time."""
    local = F.from_utc_timestamp(ts, "America/New_York")
    start = {"1d": F.date_trunc("day", local), "1w": F.date_trunc("week", local)}.get(interval)
    if start is None:
        start = F.date_trunc("hour", local) + F.make_dt_interval(mins=(F.floor(F.minute(local) / 15) * 15).cast("int"))
    return F.to_utc_timestamp(start, "America/New_York")


def clean_symbol(x: Column) -> Column:
    """A symbol without its exchange, in capitals, dots as dashes; null where it isn't one."""
    s = F.regexp_replace(F.regexp_replace(F.upper(F.trim(x)), r"^[A-Z0-9_]+:", ""), r"\.", "-")
    return F.when(s.rlike(r"^[A-Z0-9^][A-Z0-9^=-]{0,14}$"), s)


#: Cody's rational approximations of the error function (numerator and denominator of each range, lowest power last).
_ERF_SMALL = ((1.85777706184603153e-1, 3.16112374387056560, 113.864154151050156, 377.485237685302021, 3209.37758913846947), (1.0, 23.6012909523441209, 244.024637934444173, 1282.61652607737228, 2844.23683343917062))
_ERFC_MIDDLE = (
    (2.15311535474403846e-8, 0.564188496988670089, 8.88314979438837594, 66.1191906371416295, 298.635138197400131, 881.952221241769090, 1712.04761263407058, 2051.07837782607147, 1230.33935479799725),
    (1.0, 15.7449261107098347, 117.693950891312499, 537.181101862009858, 1621.38957456669019, 3290.79923573345963, 4362.61909014324716, 3439.36767414372164, 1230.33935480374942),
)
_ERFC_LARGE = (
    (1.63153871373020978e-2, 0.305326634961232344, 0.360344899949804439, 0.125781726111229246, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242, 1.87295284992346047, 0.527905102951428412, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def phi(x: np.ndarray) -> np.ndarray:
    """Distribution function of the standard normal over an array; NaN stays."""
    x = np.asarray(x, float)
    y = np.abs(x) / math.sqrt(2)
    with np.errstate(over="ignore", under="ignore", divide="ignore", invalid="ignore"):
        small = 1 - y * np.polyval(_ERF_SMALL[0], y * y) / np.polyval(_ERF_SMALL[1], y * y)
        inverse = 1 / np.maximum(y * y, 1e-300)
        large = (1 / math.sqrt(math.pi) - inverse * np.polyval(_ERFC_LARGE[0], inverse) / np.polyval(_ERFC_LARGE[1], inverse)) / y
        middle = np.polyval(_ERFC_MIDDLE[0], y) / np.polyval(_ERFC_MIDDLE[1], y)
        tail = np.where(y <= 0.46875, small, np.exp(-y * y) * np.where(y <= 4, middle, large))  # erfc of |x| / sqrt 2
    tail = np.where(np.isinf(y), 0.0, tail) / 2
    return np.where(x > 0, 1 - tail, tail)


def normal_cdf(x: Column) -> Column:
    """Distribution function of the standard normal."""
    return F.pandas_udf(lambda s: pd.Series(phi(s.to_numpy(float)), s.index), "double")(x)


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def series_label(ts: Column, at: Column) -> Column:
    """A time as its axis label: to the second for 15m, else its date."""
    return F.when(at == "15m", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd"))


_STEP = re.compile(r"([^.\[\]]+)|\[(\d+)\]")


def _walk(root: str | None, path: str | None) -> str | None:
    try:
        at = json.loads(root) if root and path else None
    except ValueError:
        return None
    for key, index in _STEP.findall(path or ""):
        if index:
            at = at[int(index)] if isinstance(at, list) and int(index) < len(at) else None
        elif isinstance(at, dict):
            key = key.strip()
            at = at[key] if key in at else next((v for k, v in at.items() if k.casefold() == key.casefold()), None)
        else:
            return None
    return at if at is None or isinstance(at, str) else json.dumps(at)


def walk_path(root: Column, path: Column) -> Column:
    """What a path such as ``Quarters[0].revenue`` leads to in a JSON text, as text; keys in any case, null where it leads nowhere."""
    return F.pandas_udf(lambda a, b: pd.Series([_walk(x, y) for x, y in zip(a, b)], dtype=object), "string")(root, path)
