"""Column expressions of the one-step spread model."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from emberline.functions.scalar import _col, clip

# Cell states.
UNBURNED, BURNING, BURNED, NON_FUEL = 0, 1, 2, 3

# The eight neighbours as (row step, column step, bearing).
NEIGHBOURS = [
    (-1, 0, 0),
    (-1, 1, 45),
    (0, 1, 90),
    (1, 1, 135),
    (1, 0, 180),
    (1, -1, 225),
    (0, -1, 270),
    (-1, -1, 315),
]


def neighbours(row_axis: str = "reference") -> list[tuple[int, int, int]]:
    """Offsets with bearings; ``north_up`` mirrors them for rows that grow northwards."""
    if row_axis == "reference":
        return NEIGHBOURS
    if row_axis == "north_up":
        return [(-dr, dc, bearing) for dr, dc, bearing in NEIGHBOURS]
    raise ValueError(f"unknown row axis {row_axis!r}")


def dryness(ffmc) -> Column:
    return clip(_col(ffmc) / 101.0, 0, 1)


def fuel(ndvi) -> Column:
    return clip(ndvi, 0, 1)


def is_bare(ndvi, spec) -> Column:
    return _col(ndvi) < spec.bare_ground_ndvi


def initial_state(ignition, non_fuel) -> Column:
    """Bare ground can never burn, so it overrides an ignition."""
    return (
        F.when(_col(non_fuel), F.lit(NON_FUEL))
        .when(_col(ignition), F.lit(BURNING))
        .otherwise(F.lit(UNBURNED))
    )


def wind_alignment(bearing, wind_from, spec) -> Column:
    """Above one when a bearing runs with the wind, below one against it."""
    turn = F.abs(_col(bearing) - F.pmod(_col(wind_from) + 180.0, F.lit(360.0)))
    turn = F.least(turn, 360.0 - turn)
    return clip(1.0 + spec.wind_gain * F.cos(F.radians(turn)), spec.wind_floor, spec.wind_ceiling)


def spread_probability(dry, load, wind_speed, alignment, spec) -> Column:
    speed = _col(wind_speed) / 10.0
    boost = 1.0 + F.when(speed > 1.0, F.lit(1.0)).otherwise(speed)
    p = spec.base_probability * _col(dry) * _col(load) * _col(alignment) * boost
    return clip(p, 0.0, spec.max_probability)
