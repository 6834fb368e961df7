"""The indices, alert rules and spread model as temporary SQL functions.

``register`` makes them for one session; they are plain SQL, so a query that
calls them is planned as if it were written out, and nothing leaves the JVM.
The index functions are built from the texts that ``functions.indices`` uses.
Each stage of a formula is a function of its own that hands its working values
on as arguments, so every value is computed once.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from emberline.functions import indices as I
from emberline.spec import AlertSpec, SpreadSpec

# Function: its formula and inputs. Inputs with a default come last.
INDICES = {
    "ffmc": (I.FFMC, ("temp", "rh", "wind_ms", "rain", "prev"), {"prev": I.FFMC_START}),
    "dmc": (I.DMC, ("temp", "rh", "rain", "day", "prev"), {"prev": I.DMC_START}),
    "dc": (I.DC, ("temp", "rain", "day", "prev"), {"prev": I.DC_START}),
    "bui": (I.BUI, ("dmc", "dc"), {}),
    "fwi": (I.FWI, ("ffmc", "bui", "wind_ms"), {}),
}


def _create(name: str, parameters: str, kind: str, body: str) -> str:
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}"


def _index(name: str) -> list[str]:
    """The statements of one index function, the last stage first."""
    formula, inputs, defaults = INDICES[name]
    known = list(inputs)
    bodies = []
    for stage in formula.stages:
        names = {k: k for k in known}
        bodies.append((list(known), [text.format(**names) for text in stage.values()]))
        known += stage
    out = [_create(f"{name}_{len(bodies)}", ", ".join(f"{k} DOUBLE" for k in known), "DOUBLE", formula.result.format(**{k: k for k in known}))]
    for number, (have, more) in reversed(list(enumerate(bodies))):
        parameters = ", ".join(f"{k} DOUBLE" + (f" DEFAULT {defaults[k]}D" if not number and k in defaults else "") for k in have)
        own = f"{name}_{number}" if number else name
        out.append(_create(own, parameters, "DOUBLE", f"{name}_{number + 1}({', '.join([*have, *more])})"))
    return out


def _by_month(name: str, table: dict[int, float], default: float) -> str:
    pairs = ", ".join(f"{k}, {v}D" for k, v in table.items())
    return _create(name, "month INT", "DOUBLE", f"coalesce(try_element_at(map({pairs}), month), {default}D)")


def _clip(x: str, lo: float, hi: float) -> str:
    return f"case when {x} < {lo}D then {lo}D when {x} > {hi}D then {hi}D else {x} end"


def statements(alerts: AlertSpec = AlertSpec(), spread: SpreadSpec = SpreadSpec()) -> list[str]:
    """All CREATE statements, in the order in which they refer to each other."""
    text = "format_string('%.1f', floor(round({0}, 4) * 10 + 0.5D) / 10)"
    reasons = (
        "concat_ws('; ', case when active_fire then 'active satellite hotspot nearby' end, "
        f"case when fwi > {alerts.extreme_fwi}D then concat('extreme FWI (', {text.format('fwi')}, ')') end, "
        f"case when wind_ms > {alerts.high_wind_ms}D then concat('high wind (', {text.format('wind_ms')}, ' m/s)') end)"
    )
    turn = "abs(bearing - pmod(wind_from + 180D, 360D))"
    return [
        *[s for name in INDICES for s in _index(name)],
        _by_month("duff_day_length", I.DUFF_DAY_LENGTH, I.DUFF_DAY_LENGTH_DEFAULT),
        _by_month("drought_day_length", I.DROUGHT_DAY_LENGTH, I.DROUGHT_DAY_LENGTH_DEFAULT),
        _create("fallback_risk", "fwi DOUBLE", "DOUBLE", _clip("(fwi / 100D)", 0, 1)),
        _create(
            "severity", "score DOUBLE", "STRING",
            f"case when score >= {alerts.extreme}D then 'EXTREME' when score >= {alerts.high}D then 'HIGH' "
            f"when score >= {alerts.moderate}D then 'MODERATE' when score is not null then 'LOW' end",
        ),
        _create("is_alert", "score DOUBLE", "BOOLEAN", f"nanvl(score, null) >= {alerts.threshold}D"),
        _create("alert_text", "why STRING", "STRING", "case when why = '' then 'elevated model risk score' else why end"),
        _create("alert_reason", "active_fire BOOLEAN, fwi DOUBLE, wind_ms DOUBLE", "STRING", f"alert_text({reasons})"),
        _create("turned", "turn DOUBLE", "DOUBLE", _clip(f"(1D + {spread.wind_gain}D * cos(radians(least(turn, 360D - turn))))", spread.wind_floor, spread.wind_ceiling)),
        _create("wind_alignment", "bearing DOUBLE, wind_from DOUBLE", "DOUBLE", f"turned({turn})"),
        _create("spread_limit", "p DOUBLE", "DOUBLE", _clip("p", 0, spread.max_probability)),
        _create(
            "spread_probability", "dryness DOUBLE, fuel DOUBLE, wind_ms DOUBLE, alignment DOUBLE", "DOUBLE",
            f"spread_limit({spread.base_probability}D * dryness * fuel * alignment * (1D + case when wind_ms / 10D > 1 then 1D else wind_ms / 10D end))",
        ),
    ]


def register(spark: SparkSession, alerts: AlertSpec = AlertSpec(), spread: SpreadSpec = SpreadSpec()) -> None:
    """Makes the functions in this session, replacing those of the same names."""
    for statement in statements(alerts, spread):
        spark.sql(statement)
