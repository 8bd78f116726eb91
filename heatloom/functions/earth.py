"""The sun's place and the map grid as Column expressions, from published series."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sun_position(ts: Column, lat: Column | float, lon: Column | float) -> tuple[Column, Column]:
    """Azimuth (degrees from north) and elevation (degrees, with refraction) at a UTC time; the low-precision solar series."""
    lat, lon = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lat, lon))
    micros = F.unix_micros(ts.cast("timestamp"))
    days = micros / 86400e6 + 2440587.5 - 2451545.0
    c = days / 36525.0
    wrap = lambda x: x - 360.0 * F.floor(x / 360.0)
    mean_long = wrap(280.46646 + c * (36000.76983 + c * 0.0003032))
    anomaly = F.radians(357.52911 + c * (35999.05029 - 0.0001537 * c))
    centre = F.sin(anomaly) * (1.914602 - c * (0.004817 + 0.000014 * c)) + F.sin(2 * anomaly) * (0.019993 - 0.000101 * c) + F.sin(3 * anomaly) * 0.000289
    node = F.radians(125.04 - 1934.136 * c)
    apparent = F.radians(mean_long + centre - 0.00569 - 0.00478 * F.sin(node))
    tilt = F.radians(23.0 + (26.0 + (21.448 - c * (46.815 + c * (0.00059 - c * 0.001813))) / 60.0) / 60.0 + 0.00256 * F.cos(node))
    declination = F.asin(F.sin(tilt) * F.sin(apparent))
    y, e = F.pow(F.tan(tilt / 2), F.lit(2.0)), 0.016708634 - c * (0.000042037 + 0.0000001267 * c)
    l2 = 2 * F.radians(mean_long)
    equation = 4 * F.degrees(y * F.sin(l2) - 2 * e * F.sin(anomaly) + 4 * e * y * F.sin(anomaly) * F.cos(l2) - 0.5 * y * y * F.sin(2 * l2) - 1.25 * e * e * F.sin(2 * anomaly))
    solar = F.pmod(micros, F.lit(86_400_000_000)) / 60e6 + equation + 4.0 * lon
    hour = F.radians(wrap(solar / 4.0) - 180.0)
    phi = F.radians(lat)
    up = F.asin(F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(hour))
    azimuth = wrap(F.degrees(F.atan2(F.sin(hour), F.cos(hour) * F.sin(phi) - F.tan(declination) * F.cos(phi))) + 180.0)
    elevation = F.degrees(up)
    bend = F.when(elevation > -1.0, 1.02 / 60.0 / F.tan(F.radians(elevation + 10.3 / (elevation + 5.11))))
    return azimuth, elevation + F.coalesce(bend, F.lit(0.0))


def to_grid(lon: Column, lat: Column, centre: float = 147.0) -> tuple[Column, Column]:
    """Easting and northing (m) of the transverse Mercator zone around a central meridian, southern hemisphere (Krueger's series).
    Fixed values: ellipsoid 6378137, 1/298.257222101; scale 0.9996; false origin 500000, 10000000."""
    f = 1 / 298.257222101
    n = f / (2 - f)
    e = math.sqrt(f * (2 - f))
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3]
    phi, d = F.radians(lat), F.radians(lon - centre)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return 500000.0 + 0.9996 * a * x, 10000000.0 + 0.9996 * a * y


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance of two places on the map grid."""
    (x1, y1), (x2, y2) = to_grid(lon1, lat1), to_grid(lon2, lat2)
    return F.sqrt(F.pow(x2 - x1, F.lit(2.0)) + F.pow(y2 - y1, F.lit(2.0)))
