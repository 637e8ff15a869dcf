"""Closed-form WGS 84 projections as column expressions, from longitude and latitude in degrees and back.

Only built-in functions: projecting a table of points is one projection in generated code.
The transverse Mercator series is Krueger's, to the sixth order in n.
"""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import WGS84_A as A
from ..dims import WGS84_F as FLAT

E2 = FLAT * (2 - FLAT)
E = sqrt(E2)
N = FLAT / (2 - FLAT)
#: Rectifying radius and the series' coefficients (public formulas).
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
ALPHA = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180 - 127 * N**5 / 288 + 7891 * N**6 / 37800,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440 + 281 * N**5 / 630 - 1983433 * N**6 / 1935360,
    61 * N**3 / 240 - 103 * N**4 / 140 + 15061 * N**5 / 26880 + 167603 * N**6 / 181440,
    49561 * N**4 / 161280 - 179 * N**5 / 168 + 6601661 * N**6 / 7257600,
    34729 * N**5 / 80640 - 3418889 * N**6 / 1995840,
    212378941 * N**6 / 319334400,
)
UTM_SCALE, UPS_SCALE = 0.9996, 0.994
FALSE_EASTING, UPS_FALSE = 500000.0, 2000000.0


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Code 3857."""
    return F.radians(lon) * A, F.log(F.tan(F.lit(pi / 4) + F.radians(lat) / 2)) * A


def mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - F.lit(pi / 2))


def world_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Code 3395 (ellipsoidal)."""
    phi = F.radians(lat)
    es = F.sin(phi) * E
    return F.radians(lon) * A, (F.log(F.tan(F.lit(pi / 4) + phi / 2)) - F.log((1 + es) / (1 - es)) * (E / 2)) * A


def utm(lon: Column, lat: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Codes 32601 to 32660 and 32701 to 32760."""
    phi, dl = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - F.atanh(F.sin(phi) * E) * E)
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        east = east + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a
        north = north + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a
    return east * (UTM_SCALE * RADIUS) + FALSE_EASTING, north * (UTM_SCALE * RADIUS) + F.when(south, 10000000.0).otherwise(0.0)


def ups(lon: Column, lat: Column, south: Column) -> tuple[Column, Column]:
    """Codes 5041 and 5042: polar stereographic, northing along the meridian of 180 or 0 degrees."""
    phi, lam = F.when(south, -F.radians(lat)).otherwise(F.radians(lat)), F.radians(lon)
    es = F.sin(phi) * E
    t = F.tan(F.lit(pi / 4) - phi / 2) / F.pow((1 - es) / (1 + es), F.lit(E / 2))
    rho = t * (2 * A * UPS_SCALE / sqrt((1 + E) ** (1 + E) * (1 - E) ** (1 - E)))
    return F.sin(lam) * rho + UPS_FALSE, F.when(south, F.cos(lam) * rho).otherwise(-F.cos(lam) * rho) + UPS_FALSE


def utm_zone(lon: Column) -> Column:
    return F.least(F.lit(60), F.floor((lon + 180) / 6).cast("int") + 1)


def project(lon: Column, lat: Column, srs_id: int) -> tuple[Column, Column]:
    """Points in the system ``srs_id``; systems that are not closed-form WGS 84 raise ValueError."""
    if srs_id in (4326, 4979):
        return lon, lat
    if srs_id == 3857:
        return mercator(lon, lat)
    if srs_id == 3395:
        return world_mercator(lon, lat)
    if srs_id in (5041, 5042):
        return ups(lon, lat, F.lit(srs_id == 5042))
    if 32601 <= srs_id <= 32660 or 32701 <= srs_id <= 32760:
        return utm(lon, lat, F.lit(srs_id % 100), F.lit(srs_id > 32700))
    raise ValueError(f"no closed form for system {srs_id}")
