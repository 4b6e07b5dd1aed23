"""Distances, Web-Mercator coordinates and view arithmetic, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
EARTH_KM = 6371.0
MERCATOR_LIMIT = 85.0511


def c(x: Column | str | float) -> Column:
    """A column by name, a literal, or a column as it is."""
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def valid_latlon(lat: Column | str, lon: Column | str) -> Column:
    """In range and not the unknown position 0/0; NULL or NaN is not valid."""
    lat, lon = c(lat), c(lon)
    ok = lat.between(-90, 90) & lon.between(-180, 180) & ~((F.abs(lat) < 1e-6) & (F.abs(lon) < 1e-6))
    return F.coalesce(ok, F.lit(False))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    a1, o1, a2, o2 = (F.radians(c(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(clip(h, 0.0, 1.0)))


def flat_km(lat1, lon1, lat2, lon2) -> Column:
    """Equirectangular distance with the cosine of the middle latitude."""
    a1, o1, a2, o2 = (c(x) for x in (lat1, lon1, lat2, lon2))
    east = F.radians(o2 - o1) * F.cos(F.radians((a1 + a2) / 2))
    return F.sqrt(F.pow(F.radians(a2 - a1), 2) + F.pow(east, 2)) * EARTH_KM


def world_x(lon) -> Column:
    return (c(lon) + 180.0) / 360.0


def world_y(lat) -> Column:
    r = F.radians(clip(c(lat), -MERCATOR_LIMIT, MERCATOR_LIMIT))
    return (1 - F.ln(F.tan(r) + 1 / F.cos(r)) / F.pi()) / 2


def lon_of(mx) -> Column:
    return c(mx) * 360.0 - 180.0


def lat_of(my) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * c(my)))))


def zoom_for_bbox(x0, y0, x1, y1, w: float, h: float, tile_px: float, pad: float = 1.35, low: float = 1.0, high: float = 14.5) -> Column:
    """The map zoom at which a padded box of world coordinates fits a panel of w by h pixels."""
    dx, dy = F.greatest((c(x1) - c(x0)) * pad, F.lit(1e-9)), F.greatest((c(y1) - c(y0)) * pad, F.lit(1e-9))
    return clip(F.least(F.log2(F.lit(w / tile_px) / dx), F.log2(F.lit(h / tile_px) / dy)), low, high)


def smoothstep(x) -> Column:
    x = clip(c(x), 0.0, 1.0)
    return x * x * (3 - 2 * x)
