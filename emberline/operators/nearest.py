"""Joins of scattered points to the zone grid by distance in degrees.

Zone centres form a regular lattice, so the zones near a point follow from its
coordinates. Each point is unfolded into those zones and the rows meet in one
partially aggregated group-by: no zone table is joined, a crowded cell shrinks
on the map side, and the exchange carries at most one row per zone and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from emberline.functions.scalar import clip, square
from emberline.operators.grid import zone_centre
from emberline.spec import RegionSpec

# Average number of candidates per zone the first search aims at.
CANDIDATES = 8.0
# Descent of the second search: each tile has 2**FAN_BITS children a side, so a
# parent never lists more than 256 of them, however many points they hold; the
# finest regular tiles are 1/256 of the region on a side. What lies in one is cut
# once more, into parts of its measured extent: as many a side as leave about
# CANDIDATES places in each, so a crowd is resolved however small its spot is.
FAN_BITS = 4
LEVELS = 2
MOST_PARTS = 64


def _zone_distance2(row: Column, col: Column, spec: RegionSpec) -> Column:
    lat, lon = zone_centre(row, col, spec)
    return square(lat - F.col("latitude")) + square(lon - F.col("longitude"))


def _present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def _unfold(points: DataFrame, lo_hi_rows, lo_hi_cols, spec: RegionSpec) -> DataFrame:
    """One row per point and grid cell in the given row and column ranges."""
    edges = {
        "_r0": F.greatest(lo_hi_rows[0], F.lit(0)),
        "_r1": F.least(lo_hi_rows[1], F.lit(spec.n_rows - 1)),
        "_c0": F.greatest(lo_hi_cols[0], F.lit(0)),
        "_c1": F.least(lo_hi_cols[1], F.lit(spec.n_cols - 1)),
    }
    df = points.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    df = df.withColumns(edges).where("_r1 >= _r0 and _c1 >= _c0")
    df = df.withColumn("_r", F.explode(F.sequence("_r0", "_r1")))
    df = df.withColumn("_c", F.explode(F.sequence("_c0", "_c1")))
    return df.withColumns(
        {
            "zone_idx": F.col("_r") * spec.n_cols + F.col("_c"),
            "_d2": _zone_distance2(F.col("_r"), F.col("_c"), spec),
        }
    )


def zones_within(points: DataFrame, spec: RegionSpec, radius: float | None = None) -> DataFrame:
    """Pairs of a point and each zone whose centre is at most ``radius`` away.

    Adds ``zone_idx`` and ``distance_deg``. A point meets a constant number of
    zones (four at the default radius), so the work is linear in the points.
    Stateless, hence usable on a stream too.
    """
    radius = spec.match_radius if radius is None else radius

    def span(value: str, origin: float):
        at = F.col(value) - origin
        step = spec.cell_deg
        # Half a cell because the centre counts; the margin absorbs rounding,
        # the exact test follows.
        return (
            F.ceil((at - radius) / step - 0.5 - 1e-9).cast("int"),
            F.floor((at + radius) / step - 0.5 + 1e-9).cast("int"),
        )

    pairs = _unfold(points, span("latitude", spec.min_lat), span("longitude", spec.min_lon), spec)
    return (
        pairs.withColumn("distance_deg", F.sqrt("_d2"))
        .where(F.col("distance_deg") <= radius)
        .drop("_r0", "_r1", "_c0", "_c1", "_r", "_c", "_d2")
    )


def _best(d2: Column, tie: str, values: Sequence[str]) -> Column:
    """Ordering by distance, then id; the carried values ride along."""
    return F.struct(d2.alias("d2"), F.col(tie).alias("tie"), F.struct(*values).alias("v"))


def _unpack(df: DataFrame, keys: Sequence[str], values: Sequence[str], prefix: str) -> DataFrame:
    return df.select(
        *keys,
        *[F.col(f"_best.v.{v}").alias(f"{prefix}_{v}") for v in values],
        F.sqrt("_best.d2").alias(f"{prefix}_distance_deg"),
    )


def nearest_within(
    points: DataFrame,
    spec: RegionSpec,
    values: Sequence[str],
    prefix: str,
    tie: str,
    by: Sequence[str] = ("date",),
    radius: float | None = None,
) -> DataFrame:
    """The closest point at most ``radius`` from each zone, per ``by`` group.

    Zones without one have no row: join the result to a spine to keep them.
    """
    keys = [*by, "zone_idx"]
    near = zones_within(_present(points, by), spec, radius)
    near = near.withColumn("_d2", _zone_distance2(
        F.floor(F.col("zone_idx") / spec.n_cols), F.pmod("zone_idx", F.lit(spec.n_cols)), spec
    ))
    best = near.groupBy(*keys).agg(F.min(_best(F.col("_d2"), tie, values)).alias("_best"))
    return _unpack(best, keys, values, prefix)


def zones_touched(
    points: DataFrame, spec: RegionSpec, by: Sequence[str] = ("date",), radius: float | None = None
) -> DataFrame:
    """Distinct (group, zone) with at least one point in reach."""
    return zones_within(points, spec, radius).select(*by, "zone_idx").distinct()


def _window_cells(points: DataFrame, spec: RegionSpec, by: Sequence[str]) -> DataFrame:
    """Half-width, in cells, of the first search window of each group.

    It shrinks as a group gets denser, so a group emits about ``CANDIDATES``
    rows per zone whether it holds ten points or a third of the table.
    """
    ideal = F.ceil((F.sqrt(F.lit(CANDIDATES * spec.n_zones) / F.count(F.lit(1))) - 1) / 2)
    widest = F.lit(max(spec.n_rows, spec.n_cols))
    return points.groupBy(*by).agg(F.greatest(F.least(ideal, widest), F.lit(1)).cast("int").alias("_k"))


def one_row_per_day(df: DataFrame, by: Sequence[str], also: str | None = None) -> DataFrame:
    """Broadcast hint for a table keyed by calendar date alone, or by date and
    ``also``, which numbers a few columns.

    Its size is bounded by the calendar (366 short rows a year, under 2 MB for a
    century) whatever the data volume. Any other key gets no hint and is left to
    the adaptive planner, which checks the measured size.
    """
    only_date = len(by) == 1 and dict(df.dtypes).get(by[0]) == "date"  # one row for each value of ``also``
    return F.broadcast(df) if only_date else df


def grown(df: DataFrame) -> DataFrame:
    """A table that grows with points or zone-days stays with the tasks in a
    join: however small it is still, it isn't collected for a broadcast."""
    return df.hint("merge")


def nearest(
    zones: DataFrame,
    points: DataFrame,
    spec: RegionSpec,
    values: Sequence[str],
    prefix: str,
    tie: str,
    by: Sequence[str] = ("date",),
) -> DataFrame:
    """The closest point to each zone at any distance, per ``by`` group.

    ``zones`` holds the wanted (by..., zone_idx) rows, all of which are kept;
    those of a group without points get nulls. Exact, with ties broken by the
    ``tie`` column.

    First search: a window around each point, wide enough for the group's
    density. A zone whose best match lies inside the reach that the window
    guarantees is settled. Second search, for the few others: see ``_descend``.
    """
    keys = [*by, "zone_idx"]
    # Stating that keys are present lets a second use of the result, such as a
    # median per date, share its exchanges: the planner adds the same filters
    # on one side of a join only.
    points = _present(points, [*by, "latitude", "longitude"])
    points = points.select(*by, "latitude", "longitude", tie, *[v for v in values if v != tie])
    wanted = _present(zones.select(*keys), keys)
    reach = one_row_per_day(_window_cells(points, spec, by), by)

    row, col = (
        F.floor((F.col("latitude") - spec.min_lat) / spec.cell_deg).cast("int"),
        F.floor((F.col("longitude") - spec.min_lon) / spec.cell_deg).cast("int"),
    )
    k = F.col("_k")
    pairs = _unfold(points.join(reach, list(by)), (row - k, row + k), (col - k, col + k), spec)
    # The window width travels inside the candidate, as one aggregate that every
    # use of the result needs whole: the uses then share one exchange.
    candidate = F.struct(
        F.col("_d2").alias("d2"), F.col(tie).alias("tie"), F.struct(*values).alias("v"), F.col("_k").alias("k")
    )
    found = pairs.select(*keys, candidate.alias("_b"))
    # The wanted rows enter the same aggregation, which so keeps every zone
    # without a second exchange.
    blank = wanted.select(
        *keys,
        F.lit(None).cast(found.schema["_b"].dataType).alias("_b"),
        F.lit(True).alias("_wanted"),
    )
    first = (
        found.withColumn("_wanted", F.lit(False))
        .unionByName(blank)
        .groupBy(*keys)
        .agg(F.min("_b").alias("_first"), F.max("_wanted").alias("_wanted"))
        .where("_wanted")
        .drop("_wanted")
    )
    sure = (F.col("_first.k") + 0.5) * spec.cell_deg - 1e-9
    open_zones = first.where(F.col("_first").isNull() | (F.col("_first.d2") > square(sure)))
    second = _descend(open_zones, points, spec, values, tie, by)
    settled = F.struct("_first.d2", "_first.tie", "_first.v")
    best = first.join(grown(second), keys, "left").withColumn(
        "_best", F.coalesce("_second", F.when(F.col("_first").isNotNull(), settled))
    )
    return _unpack(best, keys, values, prefix)


def _tiles(points: DataFrame, spec: RegionSpec) -> DataFrame:
    """Finest tile of each point. Points off the region join its border tiles;
    the search relies on the tiles' measured extents, not on their nominal ones."""
    side = 1 << (FAN_BITS * LEVELS)

    def index(value: str, lo: float, hi: float) -> Column:
        tile = F.floor(clip((F.col(value) - lo) / (hi - lo), 0, 1 - 1e-12) * side).cast("int")
        # Never null here; saying so spares each level its own null filter, and
        # the levels then share one exchange.
        return F.coalesce(tile, F.lit(0))

    return points.withColumns(
        {
            "_ty": index("latitude", spec.min_lat, spec.max_lat),
            "_tx": index("longitude", spec.min_lon, spec.max_lon),
        }
    )


def _parted(places: DataFrame, finest: DataFrame, by: list[str]) -> DataFrame:
    """The part of its tile that each place lies in, _sy and _sx: the tile's
    measured extent is cut into as many a side as its points ask for."""
    side = F.least(F.ceil(F.sqrt(F.col("n") / CANDIDATES)), F.lit(MOST_PARTS))

    def part(value: str, lo: str, hi: str) -> Column:
        share = F.when(F.col(hi) > F.col(lo), (F.col(value) - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(0.0)
        return F.least(F.floor(share * side), side - 1).cast("int")

    cut = places.join(grown(finest), [*by, "_ty", "_tx"])
    cut = cut.withColumns({"_sy": part("latitude", "y0", "y1"), "_sx": part("longitude", "x0", "x1")})
    return cut.select(*places.columns, "_sy", "_sx")


def _descend(
    open_zones: DataFrame,
    points: DataFrame,
    spec: RegionSpec,
    values: Sequence[str],
    tie: str,
    by: Sequence[str],
) -> DataFrame:
    """Exact nearest point by narrowing tiles instead of comparing all pairs.

    From the whole region down, a zone looks at the children of its surviving
    tiles (at most FAN**2 each) and drops those whose nearest possible point is
    farther than the farthest possible point of another. Few tiles survive a
    level, so the final join with the points stays close to one part of a tile
    a zone, no matter how the points are spread.
    """
    by = list(by)
    tiled = _tiles(points, spec)
    extent = [
        F.min("latitude").alias("y0"),
        F.max("latitude").alias("y1"),
        F.min("longitude").alias("x0"),
        F.max("longitude").alias("x1"),
    ]
    finest = tiled.groupBy(*by, "_ty", "_tx").agg(*extent, F.count(F.lit(1)).alias("n"))

    def children(level: int) -> DataFrame:
        """Per tile of the level above: its non-empty children and their extents."""
        down = FAN_BITS * (LEVELS - level)
        tiles = finest.withColumns({"_ty": F.shiftright("_ty", down), "_tx": F.shiftright("_tx", down)})
        if down:
            merged = [F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1")]
            tiles = tiles.groupBy(*by, "_ty", "_tx").agg(*merged)
        return tiles.groupBy(
            *by,
            F.shiftright("_ty", FAN_BITS).alias("_py"),
            F.shiftright("_tx", FAN_BITS).alias("_px"),
        ).agg(F.collect_list(F.struct("_ty", "_tx", "y0", "y1", "x0", "x1")).alias("_kids"))

    row = F.floor(F.col("zone_idx") / spec.n_cols)
    col = F.pmod("zone_idx", F.lit(spec.n_cols))
    zlat, zlon = zone_centre(row, col, spec)
    search = open_zones.select(
        *by,
        "zone_idx",
        zlat.alias("_y"),
        zlon.alias("_x"),
        F.coalesce(F.col("_first.d2"), F.lit(float("inf"))).alias("_bound"),
        F.lit(0).alias("_py"),
        F.lit(0).alias("_px"),
    )

    # Squared distance from the zone to the nearest and to the farthest place
    # in a tile's extent.
    rate = """transform(_kids, t -> struct(t._ty as ty, t._tx as tx,
        pow(greatest(t.y0 - _y, _y - t.y1, 0D), 2D) + pow(greatest(t.x0 - _x, _x - t.x1, 0D), 2D) as lo,
        pow(greatest(abs(_y - t.y0), abs(_y - t.y1)), 2D)
          + pow(greatest(abs(_x - t.x0), abs(_x - t.x1)), 2D) as hi))"""
    tighten = "least(_bound, array_min(transform(_rated, t -> t.hi)))"
    # The margin keeps ties and rounding on the safe side.
    survive = "inline(filter(_rated, t -> t.lo <= _bound * 1.000000001D))"
    def narrowed(search: DataFrame, kids: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
        return (
            search.join(grown(kids), [*by, "_py", "_px"])
            .withColumn("_rated", F.expr(rate))
            .withColumn("_bound", F.expr(tighten))
            .select(*by, "zone_idx", "_y", "_x", "_bound", *carried, F.expr(survive))
        )

    for level in range(1, LEVELS + 1):
        search = narrowed(search, children(level)).select(
            *by, "zone_idx", "_y", "_x", "_bound", F.col("ty").alias("_py"), F.col("tx").alias("_px")
        )

    # Copies at the same place are one candidate: the smallest tie value.
    places = tiled.groupBy(*by, "_ty", "_tx", "latitude", "longitude").agg(
        F.min(F.struct(F.col(tie).alias("tie"), F.struct(*values).alias("v"))).alias("_p")
    )
    places = _parted(places, finest, by).withColumnsRenamed({"_ty": "_py", "_tx": "_px"})
    parts = places.groupBy(*by, "_py", "_px", "_sy", "_sx").agg(*extent)
    parts = parts.groupBy(*by, "_py", "_px").agg(
        F.collect_list(F.struct(F.col("_sy").alias("_ty"), F.col("_sx").alias("_tx"), "y0", "y1", "x0", "x1")).alias("_kids")
    )
    search = narrowed(search, parts, ["_py", "_px"]).withColumnsRenamed({"ty": "_sy", "tx": "_sx"})
    hits = search.join(grown(places), [*by, "_py", "_px", "_sy", "_sx"])
    d2 = F.expr("(_y - latitude) * (_y - latitude) + (_x - longitude) * (_x - longitude)")
    return (
        hits.select(*by, "zone_idx", F.struct(d2.alias("d2"), F.col("_p.tie").alias("tie"), F.col("_p.v").alias("v")).alias("_b"))
        .groupBy(*by, "zone_idx")
        .agg(F.min("_b").alias("_second"))
    )
