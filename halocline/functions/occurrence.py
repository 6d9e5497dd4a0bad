"""Rules on raw occurrence records: ranks, coordinates, depths, flags and dates. Unreadable input gives null, never a guess."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, patterns and boxes that decide the result.
PLANKTONIC_GENERA = ("Microsetella", "Macrosetella", "Miracia", "Euterpina", "Clytemnestra", "Aegisthus")
EXCLUDED_ORDERS = ("Harpacticoida", "Siphonostomatoida", "Monstrilloida")
NON_CALCIFYING_ORDERS = ("Prymnesiales", "Phaeocystales")
DIATOM_CLASSES = ("Bacillariophyceae", "Coscinodiscophyceae", "Mediophyceae")
COCCOLITH_CLASSES = ("Coccolithophyceae", "Prymnesiophyceae")
EDNA_TITLE = "microbiome|metagenom|amplicon|18s|16s|metabarcod|edna|e-dna|sequenc|omics"
REGIONS = (("north_atlantic", -30, 40, 20, 80), ("atlantic", -100, -30, -60, 80), ("pacific_north", 40, 180, 0, 80), ("pacific_north", -180, -80, 0, 80), ("mediterranean", -10, 42, 30, 47))
FIRST_YEAR, LAST_YEAR, DEEPEST = 1000, 2200, 11000
#: A date written with its year first, with its year last, an ISO interval, and a clock time behind a date.
YEAR_FIRST = r"^(\d{4})(?:([-/])(\d{1,2})(?:\2(\d{1,2}))?)?$"
YEAR_LAST = r"^(\d{1,2})([./-])(\d{1,2})\2(\d{4})$"
ISO_END = r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2}))?)?(?:T[^/]*)?"
CLOCK = r"^(.*?)[T ](\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?$"


def is_copepod(cls: Column, subclass: Column) -> Column:
    return F.coalesce(cls == "Copepoda", F.lit(False)) | F.coalesce(subclass == "Copepoda", F.lit(False))


def taxon_group(cls: Column, subclass: Column, order: Column, phylum: Column, division: Column | None = None, subphylum: Column | None = None, infraphylum: Column | None = None) -> Column:
    """The group of a record by its ranks, first rule first; null outside all groups. Sources put a group's name at different
    ranks; a rank that is not given counts as null."""
    division, subphylum, infraphylum = (F.lit(None).cast("string") if c is None else c for c in (division, subphylum, infraphylum))
    at = lambda name, *ranks: F.array_contains(F.array(*[F.coalesce(r, F.lit("")) for r in ranks]), name)
    chalky = cls.isin(*COCCOLITH_CLASSES) & ~F.coalesce(order.isin(*NON_CALCIFYING_ORDERS), F.lit(False))
    return (
        F.when(is_copepod(cls, subclass), "copepoda").when(order == "Euphausiacea", "euphausiacea").when(at("Bacillariophyta", phylum, division) | cls.isin(*DIATOM_CLASSES), "diatoms")
        .when(chalky, "coccolithophores").when((cls == "Dinophyceae") | at("Dinoflagellata", phylum, division, subphylum, infraphylum), "dinoflagellates")
    )


def is_edna(extension_rows: Column, title: Column) -> Column:
    """Whether a record is environmental DNA: its extension has rows; where there is no extension, the title says so."""
    return F.when(extension_rows.isNotNull(), extension_rows > 0).otherwise(F.coalesce(F.lower(title).rlike(EDNA_TITLE), F.lit(False)))


def drop_reason(absence: Column, dropped: Column, dataset_excluded: Column, lon: Column, lat: Column, on_land: Column, copepod: Column, order: Column, genus: Column) -> Column:
    """Why a record is not kept, the first reason in a fixed order; null if it is kept."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    placed = yes(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)))
    bottom = copepod & order.isin(*EXCLUDED_ORDERS) & ~F.coalesce(genus, F.lit("")).isin(*PLANKTONIC_GENERA)
    return F.when(yes(dataset_excluded), "excluded_dataset").when(yes(absence), "absence").when(yes(dropped), "dropped").when(~placed, "bad_coords").when(yes(on_land), "on_land").when(yes(bottom), "excluded_order")


def resolved_depth(depth: Column, least: Column, most: Column) -> Column:
    """The depth, else the middle of its bounds, else the one bound, if in 0 to 11,000 m. A record whose values are all zero or
    negative counts downwards with the sign turned."""
    values = F.filter(F.array(depth, least, most), lambda v: v.isNotNull())
    turned = F.forall(values, lambda v: v <= 0) & F.exists(values, lambda v: v < 0)
    d = F.coalesce(depth, (least + most) / 2, least, most)
    d = F.when(turned, -d).otherwise(d)
    return F.when(d.between(0, DEEPEST), d)


def placeholder_date(day: Column, source: Column, fills: dict[str, Sequence[str]]) -> Column:
    """Whether a day is one of the fill dates of its source. A source without a list has none: such a day may be real."""
    rule = F.lit(False)
    for name, days in fills.items():
        rule = F.when(source == name, day.isin(*[F.to_date(F.lit(x)) for x in days])).otherwise(rule)
    return F.coalesce(rule, F.lit(False))


def region(lon: Column, lat: Column) -> Column:
    """The first region box that holds a point, its edges included; global outside all."""
    out = F.when(F.lit(False), "")
    for name, west, east, south, north in REGIONS:
        out = out.when(lon.between(west, east) & lat.between(south, north), name)
    return out.otherwise("global")


def flag_number(text: Column) -> Column:
    """A quality flag (0 to 9) written as a number in any form, such as '2.0'; blanks, NUL bytes and all else are null."""
    v = F.btrim(text.cast("string"), F.lit("\x00 ")).try_cast("double")
    return F.when(v.between(0, 9) & (v == F.floor(v)), v.cast("int"))


def _real(y: Column, m: Column, d: Column) -> Column:
    """Whether year, month (or null) and day (or null) can stand in a calendar."""
    months = F.when(m.between(1, 12), m)
    days = F.dayofmonth(F.last_day(F.make_date(y, F.coalesce(months, F.lit(1)), F.lit(1))))
    return y.between(FIRST_YEAR, LAST_YEAR) & F.when(m.isNull(), d.isNull()).otherwise(months.isNotNull() & (d.isNull() | d.between(1, days)))


def _parts(y: Column, m: Column, d: Column) -> Column:
    return F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))


def written_date(text: Column, day_first: Column) -> Column:
    """struct(y, m, d) of a date text, each part null where it is not certain. An interval keeps the parts its ends share; of
    two numbers before a year, one over 12 is the day, and if neither is, day_first must vouch for the order."""
    ends = "^" + ISO_END + r"\s*/\s*" + ISO_END + "$"
    groups = lambda t, pattern, names: {n: F.regexp_extract(t, pattern, i).try_cast("int").alias(n) for n, i in names}
    clock = lambda s: F.struct(s.alias("s"), F.when(s.rlike(CLOCK), F.struct(F.trim(F.regexp_extract(s, CLOCK, 1)).alias("day"), *groups(s, CLOCK, (("hour", 2), ("minute", 3), ("second", 4))).values())).alias("c"))
    # A text is one of the kinds, so the groups of one pattern only are taken; each is taken once.
    return _bound(F.trim(text), lambda s: F.when(s.rlike(ends), _bound(F.struct(*groups(s, ends, zip(("ay", "am", "ad", "by", "bm", "bd"), range(1, 7), strict=True)).values()), _interval)).otherwise(_bound(clock(s), lambda x: _single(x, day_first))))


def _bound(value: Column, then) -> Column:
    """then(value) with the value evaluated once, however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _interval(n: Column) -> Column:
    year = F.when(n["ay"] == n["by"], n["ay"])
    month = F.when(year.isNotNull() & (n["am"] == n["bm"]), n["am"])
    day = F.when(month.isNotNull() & (n["ad"] == n["bd"]), n["ad"])
    return F.when(_real(n["ay"], n["am"], n["ad"]) & _real(n["by"], n["bm"], n["bd"]), _parts(year, month, day))


def _single(x: Column, day_first: Column) -> Column:
    """The parts of one day x: s the text, c the day's text and the clock time behind it, null without one."""
    c, second = x["c"], F.coalesce(x["c"]["second"], F.lit(0))
    good_time = ((c["hour"] < 24) & (c["minute"] < 60) & (second < 61)) | ((c["hour"] == 24) & (c["minute"] == 0) & (second == 0))
    number = lambda t, pattern, names: F.struct(*[F.regexp_extract(t, pattern, i).try_cast("int").alias(n) for n, i in names])
    none = F.lit(None).cast("int")

    def year_last(n: Column) -> Column:
        p, q, z = n["p"], n["q"], n["z"]
        known = z.between(FIRST_YEAR, LAST_YEAR)
        last = F.when(known & (p > 12) & q.between(1, 12) & _real(z, q, p), _parts(z, q, p)).when(known & p.between(1, 12) & q.between(1, 12), F.when(day_first & _real(z, q, p), _parts(z, q, p)).otherwise(_parts(z, none, none)))
        return F.when(known & p.between(1, 12) & (q > 12), _parts(z, none, none)).otherwise(last)

    def of_day(day: Column) -> Column:
        first = _bound(number(day, YEAR_FIRST, (("y", 1), ("m", 3), ("d", 4))), lambda n: F.when(_real(n["y"], n["m"], n["d"]), _parts(n["y"], n["m"], n["d"])))
        return F.when(day.rlike(YEAR_FIRST), first).when(day.rlike(YEAR_LAST), _bound(number(day, YEAR_LAST, (("p", 1), ("q", 3), ("z", 4))), year_last))

    return F.when(c.isNotNull() & ~good_time, F.lit(None)).otherwise(_bound(F.when(c.isNotNull(), c["day"]).otherwise(x["s"]), of_day))


def resolved_date(text: Column, day_first: Column, start: Column, end: Column, y: Column, m: Column, d: Column) -> Column:
    """struct(y, m, d, source): the date of a record by the first source that can say it: the reader's own interval (shared
    parts; not if the text says 24 o'clock, which shifts it), the fields, the text, else the year alone of fields or text."""
    # Bound to a name once: an expression that is named nine times would be nine trees of it.
    t = F.get(F.transform(F.array(F.struct(text.alias("text"), day_first.alias("vouched"))), lambda x: written_date(x["text"], x["vouched"])), F.lit(0))
    return F.get(F.transform(F.array(F.struct(t.alias("t"), text.alias("text"), start.alias("start"), end.alias("end"), y.alias("y"), m.alias("m"), d.alias("d"))), lambda x: _first_said(x["t"], x["text"], *(x[c] for c in ("start", "end", "y", "m", "d")))), F.lit(0))


def _first_said(t: Column, text: Column, start: Column, end: Column, y: Column, m: Column, d: Column) -> Column:
    midnight = F.coalesce(text.contains("T24:"), F.lit(False))
    own_y = F.when(F.year(start) == F.year(end), F.year(start))
    own_m = F.when(own_y.isNotNull() & (F.month(start) == F.month(end)), F.month(start))
    own_d = F.when(start == end, F.dayofmonth(start))
    fy = F.when(y.between(FIRST_YEAR, LAST_YEAR), y)
    fm = F.when(fy.isNotNull() & m.between(1, 12), m)
    fd = F.when(_real(fy, fm, d), d)
    said = lambda y_, m_, d_, source: F.struct(y_.cast("int").alias("y"), m_.cast("int").alias("m"), d_.cast("int").alias("d"), F.lit(source).alias("source"))
    none = F.lit(None).cast("int")
    return (
        F.when(midnight & t["d"].isNotNull(), said(t["y"], t["m"], t["d"], "text")).when(~midnight & own_y.isNotNull(), said(own_y, own_m, own_d, "reader"))
        .when(fm.isNotNull(), said(fy, fm, fd, "fields")).when(t["m"].isNotNull() & (fy.isNull() | (fy == t["y"])), said(t["y"], t["m"], t["d"], "text"))
        .when(fy.isNotNull(), said(fy, none, none, "fields")).when(t["y"].isNotNull(), said(t["y"], none, none, "text")).otherwise(said(none, none, none, "none"))
    )
