"""Formatting of picture metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# EXIF tags of dates in order of preference, maker and model.
DATE_TAGS, MAKE, MODEL = (36867, 36868, 306), 271, 272


def degrees(dms: Sequence[Any]) -> float:
    """Decimal degrees of degrees, minutes and seconds; fractions may be pairs."""
    d, m, s = (v[0] / v[1] if isinstance(v, (tuple, list)) else float(v) for v in dms)
    return d + m / 60 + s / 3600


def gps_text(gps: Mapping[str, Any]) -> str:
    """``GPS: lat°N, lon°E`` with four decimals, negative for south and west; empty unless all four fields are there."""
    try:
        lat, lon = degrees(gps["GPSLatitude"]), degrees(gps["GPSLongitude"])
        lat = -lat if gps["GPSLatitudeRef"] == "S" else lat
        lon = -lon if gps["GPSLongitudeRef"] == "W" else lon
    except (KeyError, TypeError, ValueError, ZeroDivisionError):
        return ""
    return f"GPS: {lat:.4f}°N, {lon:.4f}°E"


def exif_text(tags: Mapping[int, Any], gps: Mapping[str, Any] | None = None, size: tuple[int, int] | None = None) -> str:
    """``[EXIF] Date: … | Camera: … | GPS: … | Size: WxH`` of what is known; empty for nothing."""
    out = [f"Date: {v}" for v in [next((tags[t] for t in DATE_TAGS if tags.get(t)), None)] if v]
    make, model = str(tags.get(MAKE) or "").strip(), str(tags.get(MODEL) or "").strip()
    if camera := model if not make or make in model else f"{make} {model}".strip():
        out.append(f"Camera: {camera}")
    if gps and (place := gps_text(gps)):
        out.append(place)
    if size:
        out.append(f"Size: {size[0]}x{size[1]}")
    return "[EXIF] " + " | ".join(out) if out else ""


def gps_column(lat: Column, lat_ref: Column, lon: Column, lon_ref: Column) -> Column:
    """The same as a column; latitude and longitude are arrays of degrees, minutes and seconds."""
    value = lambda a, ref, minus: (a[0] + a[1] / 60 + a[2] / 3600) * F.when(ref == minus, -1.0).otherwise(1.0)
    return F.format_string("GPS: %.4f°N, %.4f°E", value(lat, lat_ref, "S"), value(lon, lon_ref, "W"))
