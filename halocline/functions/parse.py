"""Column functions that read dirty text and derive named values. Unreadable input gives null, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leading_year(text: Column, newest: int) -> Column:
    """A four-digit year at the start of a text, 1750 to newest."""
    y = F.regexp_extract(F.trim(text), r"^(\d{4})\b", 1).try_cast("int")
    return F.when(y.between(1750, newest), y)


def clock_instant(day: Column, hhmm: Column) -> Column:
    """Day and HHMM text whose leading zeros may be lost; null unless it is a real clock time."""
    digits = F.lpad(F.trim(hhmm), 4, "0")
    hour, minute = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int")
    ok = digits.rlike(r"^\d{4}$") & (F.length(F.trim(hhmm)).between(1, 4)) & (hour <= 23) & (minute <= 59)
    return F.when(ok, F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + hour * 3600 + minute * 60))


def carried_seconds(minute_start: Column, seconds: Column) -> Column:
    """The start of a minute plus seconds; 60 carries over."""
    return F.timestamp_seconds(F.unix_seconds(minute_start) + seconds)


def window_bounds(text: Column) -> tuple[Column, Column]:
    """The two dates of 'a/b', swapped if reversed; one date alone is both."""
    a, b = (F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})(?:/(\d{4}-\d{2}-\d{2}))?$", i).try_cast("date") for i in (1, 2))
    b = F.coalesce(b, a)
    return F.least(a, b), F.greatest(a, b)


def subrectangle(code: Column) -> tuple[Column, Column]:
    """Longitude and latitude of the middle of a coded sub-rectangle such as 07C09."""
    lat_no, letter, sub = F.substring(code, 1, 2).try_cast("int"), F.ascii(F.substring(code, 3, 1)) - 65, F.substring(code, 4, 3).try_cast("int")
    lon = -letter + (F.pmod(sub - 1, F.lit(10))) * 0.1 + 0.05
    lat = 36.0 + (lat_no - 1) * 0.5 + (F.ceil(sub / 10) - 1) * 0.05 + 0.025
    return F.round(lon, 3), F.round(lat, 3)


def horizon_label(event_id: Column) -> Column:
    """'L_040_050' in an id, in tenths of centimetres, as '4-5cm'."""
    a, b = (F.regexp_extract(event_id, r"_(\d{3})_(\d{3})$", i).try_cast("int") for i in (1, 2))
    text = lambda v: F.when(F.pmod(v, F.lit(10)) == 0, (F.floor(v / 10)).cast("string")).otherwise((v / 10).cast("string"))
    return F.when(a.isNotNull(), F.concat(text(a), F.lit("-"), text(b), F.lit("cm")))


def oxygen_baseline(depth: Column) -> Column:
    return F.when(depth.isNull() | (depth < 200), 150.0).when(depth < 1000, 90.0).otherwise(60.0)


def below_baseline(value: Column, depth: Column) -> Column:
    """Whether an oxygen value is under the baseline of its depth; a null value is not."""
    return F.coalesce(value < oxygen_baseline(depth), F.lit(False))


# Standard names, the units that mean the same, and the limits in them.
VELOCITIES = ("eastward_sea_water_velocity", "northward_sea_water_velocity")
RANGES = (
    (("sea_water_temperature", "sea_surface_temperature"), ("degree_Celsius", "degrees_Celsius", "degree_C", "deg_C", "celsius", "Celsius"), -2.5, 40.0),
    (("sea_water_practical_salinity", "sea_water_salinity"), ("1", "psu", "PSU", "1e-3", "0.001"), 2.0, 41.0),
    (VELOCITIES, ("m/s", "m s-1", "meters_per_second", "m.s-1"), -5.0, 5.0),
    (VELOCITIES, ("cm/s", "cm s-1", "centimeters_per_second"), -500.0, 500.0),
)


def range_limits(name: Column, unit: Column) -> tuple[Column, Column]:
    """Physical limits of a standard name in a declared unit; null (not tested) for others."""
    lo = hi = F.when(F.lit(False), 0.0)
    for names, units, low, high in RANGES:
        fits = name.isin(*names) & F.trim(unit).isin(*units)
        lo, hi = lo.when(fits, low), hi.when(fits, high)
    return lo, hi


def row_problem(key: Column, lon: Column, lat: Column, y: Column, m: Column, d: Column) -> Column:
    """key, position or date: why a row cannot be used, first reason first; null if it can."""
    place = F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
    real = F.coalesce(m.between(1, 12) & d.between(1, 31) & (d <= F.dayofmonth(F.last_day(F.make_date(y, F.when(m.between(1, 12), m), F.lit(1))))), F.lit(False))
    return F.when(key.isNull() | (key == ""), "key").when(~place, "position").when(~real, "date")


def match_rank(kind: Column) -> Column:
    order = F.array(*[F.lit(x) for x in ("exact", "like", "phonetic", "near_1", "near_2", "near_3")])
    return F.coalesce(F.nullif(F.array_position(order, kind), F.lit(0)), F.lit(99))


def ph_baseline(depth: Column) -> Column:
    return F.when(depth.isNull() | (depth < 200), 7.95).when(depth < 1000, 7.75).otherwise(7.60)
