"""Small Column helpers: null-safe clipping, text, time, distance."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: mean Earth radius in kilometres.
EARTH_RADIUS_KM = 6371.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def clip(x, lo=None, hi=None) -> Column:
    """Limit to [lo, hi]; a null stays null (least/greatest would skip it)."""
    x = _col(x)
    out = None
    if lo is not None:
        out = F.when(x < lo, F.lit(float(lo)))
    if hi is not None:
        out = F.when(x > hi, F.lit(float(hi))) if out is None else out.when(x > hi, F.lit(float(hi)))
    return x if out is None else out.otherwise(x)


def one_decimal(x) -> Column:
    """Text with one decimal, half up on the value rounded to four places.

    The explicit rounding makes the digit independent of the printf rule of the
    runtime.
    """
    return F.format_string("%.1f", F.floor(F.round(_col(x), 4) * 10 + 0.5) / 10)


def acquisition_time(day, hhmm) -> Column:
    """Detection time from a date and an HHMM number; impossible times are null."""
    text = F.concat_ws(" ", _col(day).cast("string"), F.lpad(_col(hhmm).cast("string"), 4, "0"))
    return F.when(
        _col(day).isNotNull() & _col(hhmm).isNotNull(),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HHmm")),
    )


def brightness(columns: list[str]) -> Column:
    """Brightness of whichever sensor produced the table."""
    known = [F.col(c) for c in ("bright_ti4", "brightness") if c in columns]
    if not known:
        raise ValueError("no brightness column: expected bright_ti4 or brightness")
    return F.coalesce(*known)


def kmh_to_ms(speed) -> Column:
    return _col(speed) / F.lit(3.6)


def square(x: Column) -> Column:
    return x * x


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    half_lat = F.sin(F.radians(_col(lat2) - _col(lat1)) / 2)
    half_lon = F.sin(F.radians(_col(lon2) - _col(lon1)) / 2)
    a = square(half_lat) + F.cos(F.radians(_col(lat1))) * F.cos(F.radians(_col(lat2))) * square(half_lon)
    return F.asin(F.sqrt(a)) * (2 * EARTH_RADIUS_KM)


def is_error_payload(text) -> Column:
    """A feed answer that is an error message instead of data."""
    text = _col(text)
    return (F.instr(F.substring(text, 1, 200), "Invalid") > 0) | (
        F.instr(F.lower(F.substring(text, 1, 50)), "error") > 0
    )


def in_box(lat, lon, spec) -> Column:
    return _col(lat).between(spec.min_lat, spec.max_lat) & _col(lon).between(spec.min_lon, spec.max_lon)


def in_season(day, seasons) -> Column:
    """Inside the yearly season of one of the wanted years.

    Written as plain date ranges so that the scan can skip files and row groups.
    """
    day = _col(day)
    (m1, d1), (m2, d2) = seasons.start, seasons.end
    out = F.lit(False)
    for y in seasons.years:
        out = out | day.between(
            F.lit(f"{y:04d}-{m1:02d}-{d1:02d}").cast("date"),
            F.lit(f"{y:04d}-{m2:02d}-{d2:02d}").cast("date"),
        )
    return out
