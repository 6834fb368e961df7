"""Deterministic vegetation-dryness proxy for zones without an observation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from emberline.functions.scalar import _col


def _unit(zone_idx, day, a: int, b: int) -> Column:
    """A repeatable number in [0, 1) from zone and date, equal on every partition."""
    mixed = _col(zone_idx).cast("long") * a + F.unix_date(_col(day)).cast("long") * b
    return F.pmod(mixed, F.lit(1000)) / F.lit(1000.0)


def ndvi_proxy(zone_idx, day, active_fire, rain) -> Column:
    """Greenness in [-1, 1]: lower near active fire, higher after rain.

    Pass a literal false as ``active_fire`` when building training data, so the
    label cannot reach the features.
    """
    # Ranges 0.35-0.75 and 0.2-0.5, rain gain 1.1 up to 0.9.
    base = F.lit(0.35) + F.lit(0.4) * _unit(zone_idx, day, 7919, 104729)
    burnt = base * (F.lit(0.2) + F.lit(0.3) * _unit(zone_idx, day, 31, 17))
    value = F.when(_col(active_fire), burnt).otherwise(base)
    # The value lies in 0.07..0.75, so only the upper limit can bind.
    wetter = value * F.lit(1.1)
    wetter = F.when(wetter > 0.9, F.lit(0.9)).otherwise(wetter)
    return F.when(_col(rain) > 1.0, wetter).otherwise(value)


def ndvi(observed, proxy: Column) -> Column:
    """An observation where there is one, else the proxy; within [-1, 1]."""
    value = F.coalesce(_col(observed), proxy)
    return F.when(value < -1.0, F.lit(-1.0)).when(value > 1.0, F.lit(1.0)).otherwise(value)
