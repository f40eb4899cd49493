"""Closed forms of the coverage tests, as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from riskspark.functions import special

#: Fixed value: the 95 % quantile of chi-squared with one degree of freedom; and the 90 % one.
CHI2_95, CHI2_90 = 3.841458820694124, 2.705543454095404
#: The zones of Z2.
YELLOW, RED = -0.70, -1.80


def xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.ln(F.greatest(y, F.lit(1e-300))))


def pf_lr(x: Column, n: Column, p: Column) -> Column:
    """Likelihood ratio of x failures in n trials against the rate p."""
    rate = x / n
    return -2.0 * ((xlogy(n - x, 1.0 - p) + xlogy(x, p)) - (xlogy(n - x, 1.0 - rate) + xlogy(x, rate)))


def tuff_lr(v: Column, p: Column) -> Column:
    """Likelihood ratio of a first failure at trial v."""
    own = -F.ln(v) + F.when(v == 1, F.lit(0.0)).otherwise((v - 1) * F.ln(F.greatest(1.0 - 1.0 / v, F.lit(1e-300))))
    return -2.0 * (F.ln(p) + (v - 1) * F.ln(1.0 - p) - own)


def traffic_light(z: Column) -> Column:
    return F.when(z.isNull() | F.isnan(z), "n/a").when(z < RED, "red").when(z < YELLOW, "yellow").otherwise("green")


def uniform(key: Column) -> Column:
    """A uniform number in [0, 1) that depends on the key alone."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


@F.pandas_udf(DoubleType())
def chi2_p(lr: pd.Series) -> pd.Series:
    """How often a likelihood ratio is that large by chance."""
    return pd.Series(special.chi2_sf(lr.to_numpy()))


@F.pandas_udf(DoubleType())
def ks_p(d: pd.Series, n: pd.Series) -> pd.Series:
    """The limiting p-value of a distance from the uniform law."""
    return pd.Series(special.ks_sf(d.to_numpy(), n.to_numpy(float)))
