"""Trailing windows that follow the stored state.

A window changes only if one of its days does. So after a refresh only the
windows that end on a touched day, or up to a window's length after one, are
built anew, from these days and the days before them; all others keep their files.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import SparkSession

from emberline.operators.sequences import sequences
from emberline.plans.versions import VersionedDates

#: The column of the windows' ledger: the newest state version among a window's days.
STATE = ("state",)


def window_table(base: str) -> VersionedDates:
    return VersionedDates(base, STATE)


def stale_ends(state: dict[dt.date, int], built: dict[dt.date, int], n_days: int) -> dict[dt.date, int]:
    """The last days whose windows have to be built, each with the newest state
    version among its days. ``state`` and ``built`` give versions by date."""
    out = {}
    for end in state:
        days = [end - dt.timedelta(days=k) for k in range(n_days)]
        newest = max(state[d] for d in days if d in state)
        if built.get(end) != newest:
            out[end] = newest
    return out


def refresh_windows(spark: SparkSession, state: VersionedDates, windows: VersionedDates, features: Sequence[str], n_days: int = 7) -> int | None:
    """Brings the windows up to the newest state; the new version of the
    windows, or None if nothing had changed. Windows are of consecutive days."""
    now = {r["date"]: r["version"] for r in state.ledger(spark).where("version is not null").collect()}
    built = {r["date"]: r["state"] for r in windows.ledger(spark).collect()} if windows.numbers(spark) else {}
    ends = stale_ends(now, built, n_days)
    if not ends:
        return None
    needed = {end - dt.timedelta(days=k) for end in ends for k in range(n_days)} & set(now)
    rows = state.read(spark, dates=sorted(needed)).select("zone_idx", "date", *features)
    seq = sequences(rows, n_days, features, label=None)
    fresh = seq.where(seq["date"].isin(sorted(ends)))
    return windows.write(fresh, {end: {"state": newest} for end, newest in ends.items()})
