"""Fidelity of images, as column expressions over arrays of samples and as scalar formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the fidelity floor, in dB.
IDENTICAL = 99.0
CEILING, BASE, BY_QUALITY, LEAST_SLACK = 48.0, 18.0, 22.0, 18.0
SMOOTH_NUMERATOR, SMOOTH_OFFSET = 12.0, 0.3
LEAST_COVERAGE = 0.01


def squared_error(a: Column, b: Column) -> Column:
    """Sum of squared differences of two arrays of samples, exact."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def psnr(error: Column, samples: Column) -> Column:
    """Decibels for a sum of squared errors over so many samples; 99 if there is none."""
    mse = error.cast("double") / samples
    return F.when((samples == 0) | (error == 0), F.lit(IDENTICAL)).otherwise(10.0 * F.log10(F.lit(65025.0) / mse))


def psnr_arrays(a: Column, b: Column) -> Column:
    """PSNR of two arrays of samples; 0 if their sizes differ."""
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(psnr(squared_error(a, b), F.size(a)))


def floor_db(quality: Column | float, detail: Column) -> Column:
    """The least PSNR that an image of that detail may be encoded with."""
    q = F.least(F.lit(1.0), F.greatest(F.lit(0.0), quality if isinstance(quality, Column) else F.lit(float(quality))))
    slack = F.least(F.lit(LEAST_SLACK), F.lit(SMOOTH_NUMERATOR) / (F.lit(SMOOTH_OFFSET) + detail))
    return F.least(F.lit(CEILING), F.lit(BASE) + F.lit(BY_QUALITY) * q + slack)


def floor_of(quality: float, detail: float) -> float:
    slack = min(LEAST_SLACK, SMOOTH_NUMERATOR / (SMOOTH_OFFSET + detail))
    return min(CEILING, BASE + BY_QUALITY * min(1.0, max(0.0, quality)) + slack)


def dilution(coverage: Column) -> Column:
    """Decibels by which PSNR over the whole image exceeds PSNR over its covered part."""
    return -10.0 * F.log10(F.greatest(coverage, F.lit(LEAST_COVERAGE)))


def dilution_of(coverage: float) -> float:
    return -10.0 * math.log10(max(coverage, LEAST_COVERAGE))


def mode_for(mode: Column) -> Column:
    """The mode that an image of any mode is written in."""
    return F.when(mode.isin("1", "L", "P", "RGB"), mode).when(mode.isin("LA", "I", "F", "I;16"), "L").otherwise("RGB")


def reduced_mode(mode: Column, low: Column, high: Column, values: Column, grey: Column) -> Column:
    """RGB with equal channels is L; L of black and white alone (both of them) is 1. `values`: the distinct samples."""
    flat = F.when((mode == "RGB") & grey, F.lit("L")).otherwise(mode)
    two = (low != high) & (F.size(values) <= 4) & F.forall(values, lambda v: v.isin(0, 255))
    return F.when((flat == "L") & two, F.lit("1")).otherwise(flat)


def mask_action(low: Column, values: Column, reduce: bool = True) -> Column:
    """What becomes of a soft mask: `drop` if all is opaque, `stencil` if all is opaque or clear, else `replace`."""
    binary = F.lit(reduce) & (F.size(values) <= 4) & F.forall(values, lambda v: v.isin(0, 255))
    return F.when(low == 255, F.lit("drop")).when(binary, F.lit("stencil")).otherwise(F.lit("replace"))
