"""Closed forms as column expressions: normal distribution, options, impact, valuation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(x: Column) -> Column:
    """By a rational approximation of the error function, within 1e-7."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-z * z)
    return F.when(x >= 0, 1 - tail / 2).otherwise(tail / 2)


def normal_density(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def greeks(spot: Column, strike: Column, years: Column, vol: Column, rate: float) -> dict[str, Column]:
    """Delta, gamma, vega and theta of a call."""
    root = vol * F.sqrt(years)
    d1 = (F.log(spot / strike) + (rate + vol * vol / 2) * years) / root
    d2 = d1 - root
    return {
        "delta": normal_cdf(d1), "gamma": normal_density(d1) / (spot * root), "vega": spot * normal_density(d1) * F.sqrt(years),
        "theta": -spot * normal_density(d1) * vol / (2 * F.sqrt(years)) - rate * strike * F.exp(-rate * years) * normal_cdf(d2),
    }
