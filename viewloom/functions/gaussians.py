"""Attribute transforms of Gaussian points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Degree-0 spherical-harmonic factor and the guard of the logarithm.
SH_C0 = 0.28209479177387814
LOG_GUARD = 1e-8


def logit(p: Column) -> Column:
    """Inverse sigmoid; 0 and 1 give minus and plus infinity."""
    return (
        F.when(p == 0, F.lit(float("-inf")))
        .when(p == 1, F.lit(float("inf")))
        .otherwise(F.ln(p / F.nullif(F.lit(1.0) - p, F.lit(0.0))))
    )


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def stored_scale(scale: Column) -> Column:
    return F.ln(scale + F.lit(LOG_GUARD))


def stored_colour(rgb: Column) -> Column:
    return (rgb - F.lit(0.5)) / F.lit(SH_C0)


def shown_colour(f_dc: Column) -> Column:
    return F.lit(SH_C0) * f_dc + F.lit(0.5)


def byte_colour(rgb: Column) -> Column:
    return F.least(F.greatest(rgb * 255.0, F.lit(0.0)), F.lit(255.0)).cast("int")


def activate_scale(x: Column, smin: float, smax: float) -> Column:
    return F.lit(float(smin)) * x + F.lit(float(smax)) * (F.lit(1.0) - x)
