"""Transverse Mercator (UTM) and web Mercator coordinates, both ways, for columns and for NumPy arrays.

Krueger's series in the third flattening, to its fourth power: below a tenth of a
millimetre within a zone.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

#: WGS 84 and the UTM grid. Fixed values.
SEMI_MAJOR, FLATTENING, SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
MERCATOR_LIMIT = 20037508.342789244

_N = FLATTENING / (2 - FLATTENING)
_E = 2 * math.sqrt(_N) / (1 + _N)
RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Coefficients of the series to the plane and back. Fixed values.
ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280]
BETA = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280]


@dataclass(frozen=True)
class Functions:
    """The functions that the formulas need, over columns or arrays."""

    sin: Callable
    cos: Callable
    sinh: Callable
    cosh: Callable
    tanh: Callable
    asin: Callable
    asinh: Callable
    atanh: Callable
    atan2: Callable
    sqrt: Callable


COLUMNS = Functions(F.sin, F.cos, F.sinh, F.cosh, F.tanh, F.asin, F.asinh, F.atanh, F.atan2, F.sqrt)
ARRAYS = Functions(np.sin, np.cos, np.sinh, np.cosh, np.tanh, np.arcsin, np.arcsinh, np.arctanh, np.arctan2, np.sqrt)
_DEGREE = math.pi / 180


def _series(m: Functions, factors: list[float], x, y):
    """The sums of factors that turn one pair of transverse coordinates into the other."""
    along = sum(a * m.sin(2 * (j + 1) * x) * m.cosh(2 * (j + 1) * y) for j, a in enumerate(factors))
    across = sum(a * m.cos(2 * (j + 1) * x) * m.sinh(2 * (j + 1) * y) for j, a in enumerate(factors))
    return along, across


def to_utm(lon, lat, zone, north, m: Functions = COLUMNS):
    """(east, north) in metres of degrees in a zone (1 to 60); north is 1 for the northern grid and 0 for the southern one."""
    s = m.sin(lat * _DEGREE)
    t = m.sinh(m.atanh(s) - _E * m.atanh(_E * s))
    away = (lon - (zone * 6 - 183)) * _DEGREE
    c = m.cos(away)
    x, y = m.atan2(t, c), m.asinh(m.sin(away) / m.sqrt(t * t + c * c))
    along, across = _series(m, ALPHA, x, y)
    return FALSE_EAST + SCALE * RADIUS * (y + across), (1 - north) * FALSE_NORTH + SCALE * RADIUS * (x + along)


def from_utm(east, northing, zone, north, m: Functions = COLUMNS):
    """(lon, lat) in degrees of a place of a zone's grid."""
    x, y = (northing - (1 - north) * FALSE_NORTH) / (SCALE * RADIUS), (east - FALSE_EAST) / (SCALE * RADIUS)
    along, across = _series(m, BETA, x, y)
    x, y = x - along, y - across
    conformal = m.atanh(m.sin(x) / m.cosh(y))
    s = m.sin(x) / m.cosh(y)
    for _ in range(7):  # each round is a hundred times closer
        s = m.tanh(conformal + _E * m.atanh(_E * s))
    return m.atan2(m.sinh(y), m.cos(x)) / _DEGREE + (zone * 6 - 183), m.asin(s) / _DEGREE


def zone_of(lon):
    """The zone of a longitude from -180 on, without the exceptions around Norway."""
    return F.least(F.lit(60), F.greatest(F.lit(1), F.floor((lon + 180) / 6).cast("int") + 1))


def utm_code(zone, north):
    """The EPSG code of a zone's grid."""
    return F.when(north == 1, 32600 + zone).otherwise(32700 + zone)


def project(code: int, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Degrees in the coordinates of an EPSG code: 4326, 3857 or a UTM grid."""
    if code == 4326:
        return lon, lat
    if code == 3857:
        return lon / 180 * MERCATOR_LIMIT, np.arcsinh(np.tan(lat * _DEGREE)) / math.pi * MERCATOR_LIMIT
    return to_utm(lon, lat, *_grid(code), ARRAYS)


def unproject(code: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The degrees of coordinates of an EPSG code."""
    if code == 4326:
        return x, y
    if code == 3857:
        return x / MERCATOR_LIMIT * 180, np.arctan(np.sinh(y / MERCATOR_LIMIT * math.pi)) / _DEGREE
    return from_utm(x, y, *_grid(code), ARRAYS)


def _grid(code: int) -> tuple[int, int]:
    if not (32601 <= code <= 32660 or 32701 <= code <= 32760):
        raise ValueError(f"no projection for EPSG:{code}")
    return code % 100, int(code < 32700)
