"""Column functions that clean and classify; each states what a null gives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BAD_FLAGS = (3, 4, 9)


def decade(year: Column, cutoff: int) -> Column:
    """Decade of a year; null and years after the cutoff are -1, years before 1950 are 1940."""
    return F.when(year.isNull() | (year > cutoff), -1).when(year < 1950, 1940).otherwise((F.floor(year / 10) * 10).cast("int"))


def depth_band(depth: Column) -> Column:
    """0 to 200 m, 1 to 1000 m, 2 deeper, 3 for null (never the surface)."""
    return F.when(depth.isNull(), 3).when(depth <= 200, 0).when(depth <= 1000, 1).otherwise(2)


def good_value(value: Column, flag: Column) -> Column:
    """The value where its flag is given and not bad; else null."""
    return F.when(flag.isNotNull() & ~flag.isin(*BAD_FLAGS), value)


def good_position(flag: Column) -> Column:
    """A position counts if its flag is null or not bad."""
    return F.coalesce(~flag.isin(*BAD_FLAGS), F.lit(True))


def position_status(lon: Column, lat: Column) -> Column:
    """missing, out_of_range or ok."""
    inside = lon.between(-180, 180) & lat.between(-90, 90)
    return F.when(lon.isNull() | lat.isNull(), "missing").when(inside, "ok").otherwise("out_of_range")


def no_data(value: Column, codes: tuple) -> Column:
    """Null for a no-data code or a negative value."""
    return F.when(~value.isin(*codes) & (value >= 0), value)


def licence(text: Column) -> Column:
    """Licence class of a free text; non-commercial wins, restricted comes first, null and unknown texts are unknown."""
    t = F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"[\s_]+", "-")
    by = t.contains("cc-by") | t.contains("creative-commons-attribution") | t.contains("licenses/by/") | t.contains("open-government-licence")
    return (
        F.when(t == "", "unknown").when(t.rlike("^restricted([^a-z]|$)"), "restricted")
        .when(t.rlike("(^|[^a-z])nc([^a-z]|$)|non-?commercial"), "cc-by-nc").when(t.rlike("(^|[^a-z])nd([^a-z]|$)|no-?deriv"), "unknown")
        .when(t.contains("cc0") | t.contains("creative-commons-zero") | t.contains("publicdomain/zero"), "cc0")
        .when(t.contains("by-sa") | t.contains("sharealike") | t.contains("share-alike"), "cc-by-sa").when(by, "cc-by").otherwise("unknown")
    )


def basin(lon: Column, lat: Column) -> Column:
    """Ocean basin of a point; null where it would be a guess, out of range, or a coordinate is null."""
    america = F.when(lat >= 15, -100.0).when(lat >= 0, -83.0).otherwise(-70.0)
    east = F.when(lat <= -10, 146.82).otherwise(130.0)
    return (
        F.when(position_status(lon, lat) != "ok", None).when(lat >= 66.5, "Arctic Ocean").when(lat <= -60, "Southern Ocean")
        .when(lat.between(30, 46) & lon.between(-6, 36), "Mediterranean Sea").when((lat > 30) & (lon >= 20) & (lon < 100), None)
        .when((lat > -10) & lon.between(100, 130), None).when((lon >= america) & (lon <= 20), "Atlantic Ocean")
        .when((lon > 20) & (lon <= east), "Indian Ocean").otherwise("Pacific Ocean")
    )


def exposure(seafloor: Column, today: Column, before: Column) -> Column:
    """Where the sea floor lies between the two saturation horizons; null inputs and land are no_data."""
    return (
        F.when(seafloor.isNull() | today.isNull() | before.isNull() | (seafloor <= 0), "no_data").when(seafloor <= today, "supersaturated")
        .when(seafloor <= before, "newly_corrosive").otherwise("corrosive_preindustrial")
    )


def thinning(record_id: Column, zoom: int) -> Column:
    """Which ids are drawn at a zoom: every 48th, 16th, 6th, 2nd or all."""
    for limit, every in ((2, 48), (4, 16), (6, 6), (8, 2)):
        if zoom < limit:
            return F.pmod(record_id, F.lit(every)) == 0
    return F.lit(True)


def risk_level(index: Column, gap: Column) -> Column:
    return F.when(gap, "data_gap").when(index >= 0.8, "critical").when(index >= 0.6, "high").when(index >= 0.4, "moderate").when(index >= 0.2, "low").otherwise("minimal")


def small_int(value: Column, scale: int) -> Column:
    """A value as a scaled 16-bit integer, rounded half to even and clamped to +-32767."""
    return F.greatest(F.least(F.bround(value * scale), F.lit(32767.0)), F.lit(-32767.0)).cast("int")


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and the first 16 hex digits of the sha1 of the parts joined by ':'."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 16))


def small_int_value(packed: Column, scale: int) -> Column:
    """The value of a scaled 16-bit integer."""
    return packed.cast("double") / scale


# Words in the label of a channel that watches the instrument itself.
HOUSEKEEPING = ("on board", "off board", "onboard", "offboard", "case", "chassis", "battery", "acceleration", "internal", "board temperature", "ground fault", "voltage", "current limit", "status", "digital input", "junction box")


def housekeeping(label: Column) -> Column:
    low = F.lower(label)
    return F.coalesce(F.exists(F.array(*[F.lit(x) for x in HOUSEKEEPING]), lambda w: low.contains(w)), F.lit(False))


def corrected(code: Column) -> Column:
    """Whether a sensor code names a corrected reading."""
    return code.contains("corrected") & ~code.contains("uncorrected")


def priority(name: Column, prefixes: tuple) -> Column:
    """The place of the first prefix that begins a name; their number if none does."""
    out = F.when(F.lit(False), 0)
    for i, prefix in enumerate(prefixes):
        out = out.when(name.startswith(prefix), i)
    return out.otherwise(len(prefixes))


def years_count(years: Column, undated: Column, first: int | None, last: int | None) -> Column:
    """Records of a map from year to count: all and the undated ones without a range, else those of its years."""
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + x)
    if first is None and last is None:
        return total(years) + undated
    return total(F.map_filter(years, lambda y, n: y.between(first if first is not None else -9999, last if last is not None else 9999)))


def decade_index(year: Column) -> Column:
    """0 for the 1970s to 5 for the 2020s; null outside."""
    return F.when(year.between(1970, 2029), F.floor((year - 1970) / 10).cast("int"))


def concentration(value: Column, codes: tuple) -> Column:
    """A concentration; null for a fill code or a negative value."""
    return F.when(~value.isin(*codes) & (value >= 0), value)
