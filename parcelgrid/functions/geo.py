"""Distance and tile-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelgrid.functions.text import py_float_text

# Km per degree (longitude at the equator, latitude).
KM_PER_DEG_LON_EQUATOR = 111.320
KM_PER_DEG_LAT = 110.574


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def km_per_deg_lon(lat) -> Column:
    return F.lit(KM_PER_DEG_LON_EQUATOR) * F.cos(F.radians(_c(lat)))


def km_per_deg_lat() -> Column:
    return F.lit(KM_PER_DEG_LAT)


def tile_key(ne_lat, sw_long, strict: bool = False) -> Column:
    """``tile_<lat>_long_<lon>.json`` with the dots of the number text as ``_``.

    A latitude whose text has no ``.`` (exponent form) has no key: null, or an
    error with ``strict=True``.
    """
    lat, lon = py_float_text(ne_lat), py_float_text(sw_long)
    key = F.concat(F.lit("tile_"), F.replace(lat, F.lit("."), F.lit("_")), F.lit("_long_"),
                   F.replace(lon, F.lit("."), F.lit("_")), F.lit(".json"))
    ok = lat.contains(".")
    if strict:
        return F.when(ok, key).otherwise(F.raise_error(F.concat(F.lit("no tile key for "), lat)))
    return F.when(ok, key)
