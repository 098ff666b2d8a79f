"""Numeric column expressions shared by the trend, response and clinical jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import dictionary as d

DAYS_PER_YEAR = 365.25


def pct_change(new: Column, ref: Column) -> Column:
    """Percent change to one decimal: the printed figure is the one compared with a threshold."""
    return F.round((new - ref) / F.nullif(ref, F.lit(0.0)) * 100, 1)


def years(days: Column) -> Column:
    return days / DAYS_PER_YEAR


def t95(df: Column) -> Column:
    """Two-sided 95% t value: the next listed degrees of freedom at or above ``df``."""
    out = F.lit(d.T95_BEYOND)
    for known in sorted(d.T95, reverse=True):
        out = F.when(df <= known, d.T95[known]).otherwise(out)
    return out


def target_distance(value: Column, low: Column, high: Column) -> Column:
    """How far a value lies outside a target range whose ends may be open."""
    return F.greatest(F.coalesce(low - value, F.lit(0.0)), F.coalesce(value - high, F.lit(0.0)), F.lit(0.0))


def target_direction(before: Column, after: Column, low: Column, high: Column) -> Column:
    d0, d1 = target_distance(before, low, high), target_distance(after, low, high)
    return (F.when(before.isNull() | after.isNull() | (low.isNull() & high.isNull()), None)
            .when((d0 == 0) & (d1 == 0), "within").when(F.abs(d1 - d0) < 1e-9, "unchanged")
            .when(d1 < d0, "toward").otherwise("away"))


def to_step(value: Column, step: float = 1.0) -> Column:
    """Round half to even to a multiple of ``step``."""
    return F.round(F.bround(value / step, 0) * step, 1)


def ckd_epi_2021(creatinine: Column, age: Column, sex: Column) -> Column:
    """eGFR from creatinine in mg/dL (CKD-EPI 2021, race-free)."""
    c = d.CKD_EPI
    kappa = F.when(sex == "female", c["kappa"]["female"]).otherwise(c["kappa"]["male"])
    alpha = F.when(sex == "female", c["alpha"]["female"]).otherwise(c["alpha"]["male"])
    ratio = creatinine / kappa
    return (F.lit(c["constant"]) * F.pow(F.least(ratio, F.lit(1.0)), alpha)
            * F.pow(F.greatest(ratio, F.lit(1.0)), F.lit(c["exponent_above"])) * F.pow(F.lit(c["age_base"]), age)
            * F.when(sex == "female", c["female_factor"]).otherwise(1.0))


def g_category(egfr: Column) -> Column:
    out = F.lit(d.G_CATEGORIES[-1][1])
    for low, name in reversed(d.G_CATEGORIES[:-1]):
        out = F.when(egfr >= low, name).otherwise(out)
    return F.when(egfr.isNotNull(), out)


def a_category(uacr: Column) -> Column:
    return F.when(uacr > 300, "A3").when(uacr >= 30, "A2").when(uacr.isNotNull(), "A1")


def range_flag(value: Column, low: Column, high: Column) -> Column:
    return F.when(value > high, "H").when(value < low, "L").otherwise("")


def value_class(value: Column, low: Column, high: Column, extreme_low: Column, extreme_high: Column) -> Column:
    def outside(lo: Column, hi: Column) -> Column:
        return F.coalesce(value < lo, F.lit(False)) | F.coalesce(value > hi, F.lit(False))

    return F.when(outside(extreme_low, extreme_high), "extreme").when(outside(low, high), "abnormal").otherwise("normal")
