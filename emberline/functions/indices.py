"""Fire-weather moisture codes and danger indices as staged column expressions.

Each ``with_*`` adds one index. Intermediate quantities become columns of their
own, so every later expression refers to them by name: Catalyst then keeps them
as shared projections instead of copying large expressions into each branch,
and all of it stays in whole-stage code generation. A null input gives a null
index, never a plausible number.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from emberline.functions.scalar import _col

# Monthly day-length factors, and what an unknown month gets.
DUFF_DAY_LENGTH = {
    1: 6.5, 2: 7.5, 3: 9.0, 4: 12.8, 5: 13.9, 6: 13.9,
    7: 12.4, 8: 10.9, 9: 9.4, 10: 8.0, 11: 7.0, 12: 6.0,
}
DUFF_DAY_LENGTH_DEFAULT = 9.0
DROUGHT_DAY_LENGTH = {
    1: -1.6, 2: -1.6, 3: -1.6, 4: 0.9, 5: 3.8, 6: 5.8,
    7: 6.4, 8: 5.0, 9: 2.4, 10: 0.4, 11: -1.6, 12: -1.6,
}
DROUGHT_DAY_LENGTH_DEFAULT = 3.8
# Previous-day codes where none is carried over.
FFMC_START = 85.0
DMC_START = 6.0
DC_START = 15.0


def month_factor(month, table: dict[int, float], default: float) -> Column:
    literal_map = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    return F.coalesce(F.try_element_at(literal_map, _col(month).cast("int")), F.lit(default))


class Formula(NamedTuple):
    """Working columns in stages, each of SQL texts over inputs and earlier
    columns in braces, and the text of the result. ``functions.sql`` makes SQL
    functions of the same texts."""

    stages: tuple[dict[str, str], ...]
    result: str


def _limit(name: str, lo: float | None = None, hi: float | None = None) -> str:
    """SQL text of ``clip``: a null stays null."""
    low = f"when {{{name}}} < {lo}D then {lo}D " if lo is not None else ""
    high = f"when {{{name}}} > {hi}D then {hi}D " if hi is not None else ""
    return f"case {low}{high}else {{{name}}} end"


# Rain above half a millimetre wets the fuel. It dries towards one equilibrium and
# gets wet towards the other, else does not change; a missing input leaves the code unknown.
FFMC = Formula(
    (
        {"wet": "{rain} - 0.5D"},
        {
            "mo": "147.2D * (101D - {prev}) / (59.5D + {prev})",
            "heat": "0.18D * (21.1D - {temp}) * (1D - exp(-0.115D * {rh}))",
            "dry": "0.424D * (1D - pow({rh} / 100D, 1.7D)) + 0.0694D * sqrt({wind_ms} * 3.6D) * (1D - pow({rh} / 100D, 8D))",
        },
        {
            "start": "case when {rain} > 0.5D then {mo} + 42.5D * {wet} * exp(-100D / (251D - {mo}))"
            f" * (1D - exp(-6.93D / ({_limit('wet', lo=1e-6)}))) when {{rain}} is not null then {{mo}} end",
            "ed": "0.942D * pow({rh}, 0.679D) + 11D * exp(({rh} - 100D) / 10D) + {heat}",
            "ew": "0.618D * pow({rh}, 0.753D) + 10D * exp(({rh} - 100D) / 10D) + {heat}",
            "wetting": "{dry} * 0.581D * exp(0.0365D * {temp})",
        },
        {"m0": _limit("start", 0.0, 250.0)},
        {
            "m": "case when {m0} > {ed} then {ed} + ({m0} - {ed}) * pow(10D, -{dry})"
            " when {m0} < {ew} then {ew} - ({ew} - {m0}) * pow(10D, -{wetting})"
            " when {ed} is not null and {ew} is not null then {m0} end",
        },
        {"code": "59.5D * (250D - {m}) / (147.2D + {m})"},
    ),
    _limit("code", 0.0, 101.0),
)
DMC = Formula(
    (
        {"excess": "{rain} - 1.27D"},
        {"log": f"ln({_limit('prev', lo=1e-6)})", "rk0": "1.894D * ({temp} + 1.1D) * (100D - {rh}) * {day} * 1e-4D"},
        {
            "rk": _limit("rk0", lo=0.0),
            "b": "case when {prev} <= 33D then 100D / (0.5D + 0.3D * {prev}) when {prev} <= 65D then 14D - 1.3D * {log} else 6.2D * {log} - 17.2D end",
        },
        {"mr": f"{{prev}} + 1000D * {{excess}} / (48.77D + {{b}} * ({_limit('excess', lo=1e-6)}))"},
        {"code": f"case when {{rain}} > 1.5D then ({_limit('mr', lo=0.0)}) + {{rk}} when {{rain}} is not null then {{prev}} + {{rk}} end"},
    ),
    _limit("code", lo=0.0),
)
DC = Formula(
    (
        {"v0": "0.36D * ({temp} + 2.8D) + {day}", "q": "800D * exp(-{prev} / 400D) + 3.937D * (0.83D * {rain} - 1.27D)"},
        {"v": _limit("v0", lo=0.0), "dr": f"400D * ln(800D / ({_limit('q', lo=1e-6)}))"},
        {"code": f"case when {{rain}} > 2.8D then ({_limit('dr', lo=0.0)}) when {{rain}} is not null then {{prev}} end + 0.5D * {{v}}"},
    ),
    _limit("code", lo=0.0),
)
BUI = Formula(
    (
        {"sum": "{dmc} + 0.4D * {dc}"},
        {"den": _limit("sum", lo=1e-6)},
        {
            "code": "case when {dmc} <= 0.4D * {dc} then 0.8D * {dmc} * {dc} / {den}"
            " else {dmc} - (1D - 0.8D * {dc} / {den}) * (0.92D + pow(0.0114D * {dmc}, 1.7D)) end",
        },
    ),
    _limit("code", lo=0.0),
)
FWI = Formula(
    (
        {
            "gap": "101D - {ffmc}",
            "fd": "case when {bui} <= 80D then 0.626D * pow({bui}, 0.809D) + 2D else 1000D / (25D + 108.64D * exp(-0.023D * {bui})) end",
        },
        {"isi": "91.9D * exp(-0.1386D * {gap}) * (1D + pow({gap}, 5.31D) / 4.93e7D) * exp(0.05039D * ({wind_ms} * 3.6D))"},
        {"b": "0.1D * {isi} * {fd}"},
        {"code": "case when {b} <= 1D then {b} else exp(2.72D * pow(0.434D * ln({b}), 0.647D)) end"},
    ),
    _limit("code", lo=0.0),
)


def _apply(df: DataFrame, formula: Formula, out: str, inputs: dict[str, str], given: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``out``. ``inputs`` names columns, ``given`` has inputs that are none."""
    names = dict(inputs)
    if given:
        df = df.withColumns({f"_fw_{k}": v for k, v in given.items()})
        names |= {k: f"_fw_{k}" for k in given}
    for stage in formula.stages:
        df = df.withColumns({f"_fw_{k}": F.expr(text.format(**names)) for k, text in stage.items()})
        names |= {k: f"_fw_{k}" for k in stage}
    df = df.withColumn(out, F.expr(formula.result.format(**names)))
    return df.drop(*[c for c in df.columns if c.startswith("_fw_")])


def with_ffmc(
    df: DataFrame,
    temp: str = "wx_temperature_c",
    rh: str = "wx_humidity_pct",
    wind_ms: str = "wx_wind_speed_ms",
    rain: str = "wx_precipitation_mm",
    prev=FFMC_START,
    out: str = "ffmc",
) -> DataFrame:
    """Fine fuel moisture code, 0 to 101."""
    inputs = {"temp": temp, "rh": rh, "wind_ms": wind_ms, "rain": rain}
    return _apply(df, FFMC, out, inputs, {"prev": _col(prev).cast("double")})


def with_dmc(
    df: DataFrame,
    temp: str = "wx_temperature_c",
    rh: str = "wx_humidity_pct",
    rain: str = "wx_precipitation_mm",
    month=5,
    prev=DMC_START,
    out: str = "dmc",
) -> DataFrame:
    """Duff moisture code, not negative."""
    given = {"prev": _col(prev).cast("double"), "day": month_factor(month, DUFF_DAY_LENGTH, DUFF_DAY_LENGTH_DEFAULT)}
    return _apply(df, DMC, out, {"temp": temp, "rh": rh, "rain": rain}, given)


def with_dc(
    df: DataFrame,
    temp: str = "wx_temperature_c",
    rain: str = "wx_precipitation_mm",
    month=5,
    prev=DC_START,
    out: str = "dc",
) -> DataFrame:
    """Drought code, not negative."""
    given = {"prev": _col(prev).cast("double"), "day": month_factor(month, DROUGHT_DAY_LENGTH, DROUGHT_DAY_LENGTH_DEFAULT)}
    return _apply(df, DC, out, {"temp": temp, "rain": rain}, given)


def with_bui(df: DataFrame, dmc: str = "dmc", dc: str = "dc", out: str = "bui") -> DataFrame:
    """Build-up index, not negative."""
    return _apply(df, BUI, out, {"dmc": dmc, "dc": dc})


def with_fwi(
    df: DataFrame,
    ffmc: str = "ffmc",
    bui: str = "bui",
    wind_ms: str = "wx_wind_speed_ms",
    out: str = "fwi",
) -> DataFrame:
    """Fire weather index, with the initial spread index inside."""
    return _apply(df, FWI, out, {"ffmc": ffmc, "bui": bui, "wind_ms": wind_ms})


def sealed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Stops the optimizer from copying the definitions of ``columns`` upwards.

    A filter on an index would otherwise be pushed below the staged projections
    by substituting every stage into it, which multiplies to an expression of
    millions of nodes. Rows pass through a one-element ``inline``, behind which
    the columns are plain attributes.
    """
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.inline(F.array(F.struct(*columns))))


def with_indices(df: DataFrame, month=5, ffmc_prev=FFMC_START, dmc_prev=DMC_START, dc_prev=DC_START) -> DataFrame:
    """All five indices from the four ``wx_`` weather columns."""
    df = with_ffmc(df, prev=ffmc_prev)
    df = with_dmc(df, month=month, prev=dmc_prev)
    df = with_dc(df, month=month, prev=dc_prev)
    return sealed(with_fwi(with_bui(df)), ["ffmc", "dmc", "dc", "bui", "fwi"])
