"""Spectral indices, turbidity, calibration and survey-standard compliance as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
#: Survey orders with the constants a and b of their vertical uncertainty. Fixed values.
ORDERS = [("special", 0.25, 0.0075), ("1a", 0.5, 0.013), ("1b", 0.5, 0.013), ("2", 1.0, 0.023), ("2a", 1.0, 0.023), ("2b", 1.5, 0.04)]
#: Scene classes: 6 water; 3, 8, 9, 10, 11 cloud, shadow and snow; 4, 5 land. Fixed values.
WATER, CLOUDY, LAND = 6, (3, 8, 9, 10, 11), (4, 5)
MAX_DEPTH = 25.0


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ndwi(green: Column, nir: Column) -> Column:
    return (green - nir) / (green + nir + EPS)


def water_mask(scl: Column, index: Column) -> Column:
    """Water by class or index, neither cloudy nor land; by index alone without a class."""
    masked = ((scl == WATER) | (index > 0.1)) & ~scl.isin(*CLOUDY) & ~scl.isin(*LAND)
    return F.when(scl.isNull(), index > 0.1).otherwise(masked)


def reflectance(dn: Column, offset: float = EPS) -> Column:
    return dn / 10000.0 + offset


def log_ratio(a: Column, b: Column) -> Column:
    """ln(1000 a) / ln(1000 b + eps), the ratio that depth is linear in."""
    return F.log(1000.0 * a) / F.log(1000.0 * b + EPS)


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def suspended_matter(red: Column) -> Column:
    """Suspended matter from red reflectance, within 0 to 200."""
    r = clip(red, 1e-6, 0.17563)
    return clip(366.14 * r / (1 - r / 0.19563), 0.0, 200.0)


def ndti(red: Column, green: Column) -> Column:
    return (red - green) / (red + green + EPS)


def erf(x: Column) -> Column:
    """The error function by Abramowitz and Stegun 7.1.26, within 1.5e-7."""
    a = F.abs(x)
    t = 1.0 / (1.0 + 0.3275911 * a)
    y = 1.0 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-a * a)
    return F.signum(x) * y


def allowed_uncertainty(depth: Column, a: float, b: float) -> Column:
    return F.sqrt(F.lit(a * a) + (b * depth) * (b * depth))


def chance_within(depth: Column, sigma: Column, a: float, b: float) -> Column:
    """The probability that the error stays within an order's uncertainty."""
    return clip(erf(allowed_uncertainty(depth, a, b) / (2.0**0.5 * F.greatest(sigma, F.lit(1e-3)))), 0.0, 1.0)


def total_sigma(sigma: Column, spm: Column, depth: Column, k_t: float = 0.012, k_d: float = 0.04, limit: float = 12.0) -> Column:
    deep = F.greatest(F.lit(0.0), depth - limit)
    return F.sqrt(F.greatest(sigma * sigma + (k_t * spm) * (k_t * spm) + (k_d * deep) * (k_d * deep), F.lit(1e-4)))


def calibrate(pred: Column, alpha: Column, beta: Column) -> Column:
    return clip(alpha + beta * pred, 0.0, MAX_DEPTH)


def sigma_floor(std: Column) -> Column:
    """The spread of the passes with a floor, between 0.1 and 10 metres."""
    return clip(std + 0.10, 0.10, 10.0)


def bounds(depth: Column, sigma: Column) -> tuple[Column, Column]:
    """The range of 95 per cent, within the depths that the model knows."""
    return clip(depth - 1.96 * sigma, 0.0, MAX_DEPTH), clip(depth + 1.96 * sigma, 0.0, MAX_DEPTH)


def stretch(value: Column, low: Column, high: Column) -> Column:
    """A byte from a percentile stretch; the range is one unit where it is empty."""
    top = F.when(high <= low, low + 1).otherwise(high)
    return clip((value - low) / (top - low) * 255.0, 0.0, 255.0).cast("int")


def gamma_stretch(value: Column, low: Column, high: Column, gamma: float) -> Column:
    span = F.when(high <= low, F.lit(1.0)).otherwise(high - low)
    return F.floor(F.pow(clip((value - low) / span, 0.0, 1.0), F.lit(1.0 / gamma)) * 255.0).cast("int")


def ramp(share: Column, stops: list[tuple[int, int, int]]) -> Column:
    """(r, g, b) of a linear colour ramp with evenly spaced stops, truncated to whole numbers."""
    at = clip(share, 0.0, 1.0) * (len(stops) - 1)
    i = F.least(F.floor(at).cast("int"), F.lit(len(stops) - 2))

    def channel(c: int) -> Column:
        table = F.array(*[F.lit(float(s[c])) for s in stops])
        a, b = F.get(table, i), F.get(table, i + 1)
        return F.floor(a + (b - a) * (at - i)).cast("int")

    return F.struct(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))
