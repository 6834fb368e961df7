"""Immutable settings passed to operators; nothing reads global state."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class RegionSpec:
    """A latitude/longitude box cut into square cells."""

    # The study region's box and its two grid steps, in degrees.
    min_lat: float = 11.5
    max_lat: float = 15.5
    min_lon: float = 74.0
    max_lon: float = 77.5
    cell_deg: float = 0.1
    weather_cell_deg: float = 0.5
    match_cells: float = 0.75

    def __post_init__(self):
        if not (self.min_lat < self.max_lat and self.min_lon < self.max_lon):
            raise ValueError("region bounds are empty")
        if self.cell_deg <= 0 or self.weather_cell_deg <= 0:
            raise ValueError("grid steps must be positive")

    @staticmethod
    def _cells(lo: float, hi: float, step: float) -> int:
        return math.ceil((hi - lo) / step - 1e-9)

    def shape(self, step: float | None = None) -> tuple[int, int]:
        """(rows, cols) of the grid with the given step (default: fire cells)."""
        step = step or self.cell_deg
        return (
            self._cells(self.min_lat, self.max_lat, step),
            self._cells(self.min_lon, self.max_lon, step),
        )

    @property
    def n_rows(self) -> int:
        return self.shape()[0]

    @property
    def n_cols(self) -> int:
        return self.shape()[1]

    @property
    def n_zones(self) -> int:
        return self.n_rows * self.n_cols

    @property
    def match_radius(self) -> float:
        """Largest distance, in degrees, at which a detection counts as nearby."""
        return self.cell_deg * self.match_cells


@dataclass(frozen=True)
class AlertSpec:
    # Alert threshold, severity bands, and reason cut-offs.
    threshold: float = 0.70
    extreme: float = 0.90
    high: float = 0.70
    moderate: float = 0.40
    extreme_fwi: float = 60.0
    high_wind_ms: float = 8.0


@dataclass(frozen=True)
class SpreadSpec:
    # Spread coefficients and the minutes one step stands for.
    base_probability: float = 0.35
    wind_gain: float = 0.8
    wind_floor: float = 0.4
    wind_ceiling: float = 1.8
    max_probability: float = 0.97
    bare_ground_ndvi: float = 0.15
    minutes_per_step: int = 15
    # "reference": the row before is north of the cell; "north_up": the row
    # after is, which is where the grid's growing latitudes really point.
    row_axis: str = "reference"


@dataclass(frozen=True)
class SeasonSpec:
    """Months and days that bound a fire season, and the years wanted."""

    # Season from 1 January to 31 May of three years.
    years: tuple[int, ...] = field(default=(2023, 2024, 2025))
    start: tuple[int, int] = (1, 1)
    end: tuple[int, int] = (5, 31)
