"""Option pricing as column expressions; native but for the iterative implied volatility."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

RATE = 0.053


def pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


# Abramowitz and Stegun, formula 7.1.26 (absolute error below 1.5e-7).
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
_ERF_P = 0.3275911


def cdf(x: Column) -> Column:
    """The normal distribution by a rational approximation of erf, which Spark lacks."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + _ERF_P * z)
    poly = F.lit(0.0)
    for a in reversed(_ERF):
        poly = (poly + a) * t
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def d1(spot: Column, strike: Column, years: Column, sigma: Column, rate: float = RATE) -> Column:
    return (F.ln(spot / strike) + (rate + sigma * sigma / 2) * years) / (sigma * F.sqrt(years))


def usable(spot: Column, strike: Column, years: Column, sigma: Column) -> Column:
    return (spot > 0) & (strike > 0) & (years > 0) & (sigma > 0)


def gamma(spot: Column, strike: Column, years: Column, sigma: Column, rate: float = RATE) -> Column:
    return F.when(usable(spot, strike, years, sigma), pdf(d1(spot, strike, years, sigma, rate)) / (spot * sigma * F.sqrt(years)))


def delta(spot: Column, strike: Column, years: Column, sigma: Column, cp: Column, rate: float = RATE) -> Column:
    call = cdf(d1(spot, strike, years, sigma, rate))
    return F.when(usable(spot, strike, years, sigma), F.when(cp == "C", call).otherwise(call - 1))


def price(spot: Column, strike: Column, years: Column, sigma: Column, cp: Column, rate: float = RATE) -> Column:
    a = d1(spot, strike, years, sigma, rate)
    b = a - sigma * F.sqrt(years)
    held = strike * F.exp(-rate * years)
    return F.when(usable(spot, strike, years, sigma), F.when(cp == "C", spot * cdf(a) - held * cdf(b)).otherwise(held * cdf(-b) - spot * cdf(-a)))


def vanna_charm(spot: Column, strike: Column, years: Column, sigma: Column, rate: float = RATE) -> tuple[Column, Column]:
    a = d1(spot, strike, years, sigma, rate)
    root = sigma * F.sqrt(years)
    b, ok = a - root, usable(spot, strike, years, sigma)
    return F.when(ok, -pdf(a) * b / sigma), F.when(ok, -pdf(a) * (rate / root - b / (2 * years)))


def dollar_gamma(spot: Column, strike: Column, years: Column, sigma: Column, oi: Column, cp: Column) -> Column:
    """Signed gamma exposure in millions for a one percent move: calls plus, puts minus."""
    sign = F.when(cp == "C", 1.0).when(cp == "P", -1.0)
    return F.when(oi > 0, sign * gamma(spot, strike, years, sigma) * oi * 100 * spot * spot * 0.01 / 1e6)


def bucket(dte: Column) -> Column:
    return F.when(dte < 0, None).when(dte < 1, "0DTE").when(dte <= 7, "1-7D").when(dte <= 30, "8-30D").when(dte <= 60, "31-60D")


def distance_pct(level: Column, spot: Column) -> Column:
    return F.when((spot > 0) & (level > 0), (spot - level) / spot * 100)


def midpoint(bid: Column, ask: Column) -> Column:
    """Of a two-sided quote; crossed or one-sided quotes have none."""
    return F.when((bid > 0) & (ask > 0) & (ask >= bid), (bid + ask) / 2)


def years_to_expiry(as_of: Column, expiration: Column) -> Column:
    """From a UTC instant to 16:00 New York of the expiration day, in years of 365 days; at least a minute, null when past."""
    close = F.to_utc_timestamp(F.to_timestamp(F.concat(expiration.cast("string"), F.lit(" 16:00:00"))), "America/New_York")
    seconds = F.unix_timestamp(close) - F.unix_timestamp(as_of)
    return F.when(seconds > 0, F.greatest(seconds, F.lit(60)) / (365.0 * 86400))


def third_friday(day: Column) -> Column:
    """The monthly expiration at or after the day."""

    def of(month: Column) -> Column:
        return F.date_add(F.next_day(F.date_sub(F.trunc(month, "month"), 1), "Fri"), 14)

    return F.when(of(day) >= day, of(day)).otherwise(of(F.add_months(day, 1)))


def _cdf(x: np.ndarray) -> np.ndarray:
    """``cdf`` on arrays."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + _ERF_P * z)
    poly = np.zeros_like(z)
    for a in reversed(_ERF):
        poly = (poly + a) * t
    erf = 1 - poly * np.exp(-z * z)
    return np.where(x >= 0, (1 + erf) / 2, (1 - erf) / 2)


@F.pandas_udf(DoubleType())
def implied_volatility(price_: pd.Series, spot: pd.Series, strike: pd.Series, years: pd.Series, cp: pd.Series) -> pd.Series:
    """Newton's method on whole batches: start 0.5, within [0.005, 4], at most 60 steps; null below intrinsic value."""
    p, s, k, t = (x.to_numpy(float) for x in (price_, spot, strike, years))
    call = (cp == "C").to_numpy()
    with np.errstate(all="ignore"):
        intrinsic = np.where(call, s - k, k - s)
        valid = (p > 0) & (s > 0) & (k > 0) & (t > 0) & (p >= intrinsic)
        sigma = np.full(len(p), 0.5)
        done = ~valid
        for _ in range(60):
            root = sigma * np.sqrt(t)
            a = (np.log(s / k) + (RATE + sigma**2 / 2) * t) / root
            b = a - root
            held = k * np.exp(-RATE * t)
            na, nb = _cdf(a), _cdf(b)
            model = np.where(call, s * na - held * nb, held * (1 - nb) - s * (1 - na))
            vega = s * np.exp(-a * a / 2) / math.sqrt(2 * math.pi) * np.sqrt(t)
            gap = model - p
            done |= np.abs(gap) < 1e-5
            step = np.where(done | (vega < 1e-10), 0.0, gap / vega)
            if not step.any():
                break
            sigma = np.clip(sigma - step, 0.005, 4.0)
    return pd.Series(np.where(valid & done, sigma, np.nan)).replace({np.nan: None}).astype("Float64")


def vega(spot: Column, strike: Column, years: Column, sigma: Column, rate: float = RATE) -> Column:
    """Change of the price per unit of volatility."""
    return F.when(usable(spot, strike, years, sigma), spot * pdf(d1(spot, strike, years, sigma, rate)) * F.sqrt(years))
