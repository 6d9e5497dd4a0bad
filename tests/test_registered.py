"""Registries of sources and layers, and latest states that are merged from deltas."""

import datetime

import pytest

from halocline.sources.registry import Layer, Source, export, leaves, points
from halocline.streaming.latest import Latest, messages

T0 = datetime.datetime(2024, 1, 1)
GROUPS = {"at": (["ts"], ["lon"]), "who": (["ts"], ["name"])}


def at(h):
    return T0 + datetime.timedelta(hours=h)


def said(spark, *rows):
    return spark.createDataFrame([(k, None if h is None else at(h), lon, name) for k, h, lon, name in rows], "mmsi long, ts timestamp, lon double, name string")


def state(df):
    return {r.mmsi: (r.at and (r.at.ts, r.at.lon), r.who and (r.who.ts, r.who.name)) for r in df.collect()}


def test_sources_share_a_scan_and_a_row_may_count_twice(spark):
    t = spark.createDataFrame([(1, 10.0, 5.0), (2, 200.0, 5.0), (3, None, 5.0), (4, -180.0, 90.0)], "k int, lon double, lat double")
    reads = []

    def read(name):
        reads.append(name)
        return t

    got = points(read, {"a": Source("t", where="k < 4"), "b": Source("t", "lat", "lon"), "c": Source("u", where="k = 4")})
    assert sorted(map(tuple, got.collect())) == [("a", 10.0, 5.0), ("b", 5.0, 10.0), ("c", -180.0, 90.0)]
    assert reads == ["t", "u"]
    with pytest.raises(ValueError):
        points(read, {})
    assert points(lambda n: t.where("false"), {"a": Source("t")}).collect() == []


def test_layers_by_name(spark):
    t = spark.createDataFrame([(1, 170.0, 0.0, 1.5), (2, -175.0, 0.0, None), (3, 0.0, 0.0, 2.0)], "k int, lon double, lat double, v double")
    layers = {"o": Layer("observations", "t", "k", value="v"), "f": Layer("field", "t", "k", value="v"), "c": Layer("composite", parts=("o", "f", "o"))}
    got = {(r.part, r.id) for r in export(lambda n: t, layers, "c", (160.0, -1.0, -170.0, 1.0)).collect()}
    assert got == {("o", "1"), ("o", "2"), ("f", "1")}
    assert export(lambda n: t, layers, "o").count() == 3
    with pytest.raises(KeyError):
        leaves(layers, "none")
    with pytest.raises(ValueError):
        leaves({"x": Layer("composite", parts=("y",)), "y": Layer("composite", parts=("x",))}, "x")
    with pytest.raises(ValueError):
        leaves({"x": Layer("picture")}, "x")


def test_deltas_merge_in_any_order_and_twice(spark, tmp_path):
    first = said(spark, (1, 5, 10.0, None), (1, 4, None, "OLD"), (2, 1, None, "B"), (None, 1, 1.0, "X"), (4, None, 1.0, "Y"))
    second = said(spark, (1, 3, 99.0, None), (1, 6, None, "NEW"), (1, 7, None, None), (3, 2, 7.0, None), (3, 2, 8.0, None))
    want = {1: ((at(5), 10.0), (at(6), "NEW")), 2: (None, (at(1), "B")), 3: ((at(2), 8.0), None), 4: (None, None)}
    for k, order in enumerate(((0, 1), (1, 0))):
        book = Latest(spark, str(tmp_path / str(k)), "mmsi", GROUPS)
        for n in order:
            book.add((first, second)[n], n)
        assert state(book.read(first)) == want
        book.add(second, 1)  # replayed
        book.compact(1, first)
        assert state(book.read(first)) == want
        book.add(first, 0)  # replayed after the compaction
        book.add(second, 2)
        assert state(book.read(first)) == want
        book.add(said(spark, (2, 9, 3.0, "b")), 3)
        book.compact(3, first)
        assert state(book.read(first)) == want | {2: ((at(9), 3.0), (at(9), "b"))}


def test_messages_of_both_kinds(spark):
    frame = lambda kind, name, lon: f'{{"MessageType":"{kind}","MetaData":{{"MMSI":1,"ShipName":"{name}","time_utc":"2024-01-01 00:00:00"}},"Message":{{"Latitude":1.0,"Longitude":{lon},"Sog":2.0}}}}'
    rows = [frame("PositionReport", "A", 10), frame("PositionReport", "A", 181), frame("ShipStaticData", " B ", 5), frame("ShipStaticData", " ", 5), frame("Other", "C", 1), "broken", None]
    got = sorted(((r.lon, r.name) for r in messages(spark.createDataFrame([(x,) for x in rows], "value string")).collect()), key=str)
    assert got == sorted([(10.0, None), (None, None), (None, "B"), (None, None)], key=str)
