import datetime as dt
import gzip
import json
import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from swathkit.functions import geometry, times
from swathkit.operators import catalogue, refresh, rings, tracks
from swathkit.operators.colocate import HOUR, by_bucket, colocate, deal, keyed_points, prepare_footprints
from swathkit.plans import colocation
from swathkit.sources import files, inventory, tables

RINGS = "footprint_id string, rings array<array<struct<lon:double,lat:double>>>"
CASES = {
    "R1": ([(10, -5), (10, 5), (20, 5), (20, -5)], [[(20, 0), (20, -5), (10, 0), (20, 0)], [(10, 0), (10, 5), (20, 5), (20, 0), (10, 0)]]),
    "R2": ([(10, 175), (10, -175), (20, -175), (20, 175)], [[(20, 180), (20, 175), (10, 180), (20, 180)], [(10, -180), (10, -175), (20, -175), (20, -180), (10, -180)]]),
    "R3": ([(10, 5), (20, 5), (20, -5), (10, -5)], [[(10, 5), (20, 5), (20, 0), (10, 5)], [(20, 0), (20, -5), (10, -5), (10, 0), (20, 0)]]),
    "R4": ([(10, 5), (10, 15), (20, 15), (20, 5), (10, 5)], [[(10, 5), (10, 15), (20, 15), (20, 5), (10, 5)]]),
    "R5": ([(10, 170), (10, 180), (10, -170), (20, -170), (20, 180), (20, 170)], [[(10, 170), (10, 180), (10, -170), (20, -170), (20, 180), (20, 170), (10, 170)]]),
    "R6": ([(80, 0.5), (80, 120.5), (80, -119.5)], [[(80, 0.5), (80, 120.5), (80, 180), (80, 0.5)], [(80, -180), (80, -119.5), (80, 0), (80, -180)]]),
    "R7": ([(1, 1), (1, 1), (2, 2)], []),
}


def test_rings(spark):
    rows = [(k, [[(float(lon), float(lat)) for lat, lon in ring]]) for k, (ring, _) in CASES.items()]
    got = {r.footprint_id: [[(v.lat, v.lon) for v in ring] for ring in r.rings] for r in rings.normalise_rings(spark.createDataFrame(rows, RINGS)).collect()}
    for name, (_, want) in CASES.items():
        assert len(got[name]) == len(want), name
        for a, b in zip(got[name], want):
            assert a == [pytest.approx(v, abs=1e-9) for v in b], name


def test_exact_keeps_corner(spark):
    ring = [[(float(lon), float(lat)) for lat, lon in CASES["R1"][0]]]
    got = rings.normalise_rings(spark.createDataFrame([("R1", ring)], RINGS), exact=True).first().rings
    assert any((v.lat, v.lon) == (10.0, -5.0) for r in got for v in r)


def _granule(n, end="2024-01-01T00:00:10Z"):
    pos = " ".join(f"{i} {i}" for i in range(n))
    return (f"g{n}", f'<r xmlns:gml="u"><gml:beginPosition>2024-01-01T00:00:00</gml:beginPosition><gml:endPosition>{end}</gml:endPosition><gml:posList>{pos}</gml:posList></r>')


def test_points(spark):
    rows = tracks.extract_points(spark.createDataFrame([_granule(4), _granule(7), _granule(1)], "file_name string, xml string"))[0].collect()
    texts = {n: [r.timestamp[17:-1] for r in sorted(rows, key=lambda r: r.pos) if r.file_name == n] for n in ("g4", "g7", "g1")}
    assert texts["g4"] == ["00.000", "03.333", "06.666", "09.999"]
    assert texts["g7"][-1] == "10.000" and texts["g1"] == ["00.000"]


def test_bad_granules(spark):
    bad = [("odd", _granule(2)[1].replace("1 1", "1")), ("none", "<r/>"), ("cut", _granule(2)[1][:70]), ("two", "<r/><r/>"), ("amp", "<r>&</r>"), ("null", None), ("empty", ""), _granule(2)]
    df = spark.createDataFrame(bad, "file_name string, xml string")
    points, rejects = tracks.extract_points(df, mode="quarantine")
    assert {r.file_name for r in points.collect()} == {"g2"}
    assert {r.file_name: r.reason for r in rejects.collect()} == {"odd": "positions are missing or not pairs of numbers", "none": "no begin time", **dict.fromkeys(("cut", "two", "amp", "null", "empty"), "malformed XML")}
    for name in ("odd", "none", "cut", "two"):
        with pytest.raises(Exception, match=f"{name}: "):
            tracks.extract_points(df.filter(F.col("file_name") == name))[0].collect()
    assert tracks.extract_points(df.filter("file_name = 'g2'"))[1].count() == 0


def test_bad_manifests(spark):
    xml = "<x><startTime>2024-08-01T00:00:00Z</startTime><stopTime>2024-08-01T00:00:02Z</stopTime><posList>0 0 0 5 5 5</posList>{}</x>"
    rows = [("good", xml.format("")), ("second", xml.format("<posList>1 2 3</posList>")), ("open", xml.format("<y>")), ("times", xml.format("").replace("stopTime", "stop"))]
    df = spark.createDataFrame([("2024-08-01", f"/{n}", n, x) for n, x in rows], "day string, path string, file_name string, xml string")
    found, rejects = tracks.footprints(df, mode="quarantine")
    assert [r.file_name for r in found.collect()] == ["good"]
    assert {r.file_name: r.reason[:9] for r in rejects.collect()} == {"second": "positions", "open": "malformed", "times": "no stop t"}
    with pytest.raises(Exception, match="open: malformed XML"):
        tracks.footprints(df.filter("file_name = 'open'"))[0].collect()


def test_version_keys(spark):
    names = [("a.b_1", "a", ""), ("A_B_C_D_E_F_G_H_I.x_7_z.manifest", "A_B_C_D_E_F_G_H_I.x", "7"), ("A_B_C_D_E_F_G_H_I_7.manifest", "A_B_C_D_E_F_G_H_I", "7.manifest"), ("A__C_D_E_F_G_H_I", "A__C_D_E_F_G_H_I", ""), ("x.manifest", "x", "")]
    group, version = tracks.version_key(F.col("n"))
    got = spark.createDataFrame([n[:1] for n in names], "n string").select("n", group.alias("g"), version.alias("v")).collect()
    assert [tuple(r) for r in got] == names


def test_times(spark):
    one = spark.sql("select timestamp'2024-08-01 23:58:20' a, timestamp'2024-08-02 00:01:20' b, timestamp'2024-08-02 00:01:21' c")
    mid = times.iso_text(times.midpoint(F.col("a"), F.col("b")))
    late = times.iso_text(times.midpoint(F.col("a"), F.col("c")))
    row = one.select(mid, late, times.safe_name(mid), times.safe_name(late)).first()
    assert list(row) == ["2024-08-01T23:59:50Z", "2024-08-01T23:59:50.500000Z", "20240801T235950Z.geojson", "20240801T235950500000Z.geojson"]
    names = spark.createDataFrame([("20240801T235950Z_1",), ("20240801T235950500000Z_1.geojson",), ("x",)], "n string").select(times.time_of_name(F.col("n"))).collect()
    assert [r[0] for r in names] == [dt.datetime(2024, 8, 1, 23, 59, 50), dt.datetime(2024, 8, 1, 23, 59, 50, 500000), None]
    assert times.month_bounds("2024-12") == ("2024-12-01T00:00:00Z", "2025-01-01T00:00:00Z")
    with pytest.raises(Exception, match="no letter or digit"):
        spark.range(1).select(times.safe_name(F.lit("-:"))).collect()
    for bad in ("2024-13", "2024", "24-01"):
        with pytest.raises(ValueError):
            times.month_bounds(bad)


def test_catalogue(spark):
    chunks = catalogue.date_chunks(spark, "2024-08-01", "2024-08-10", 3).collect()
    assert [(r.chunk_start.day, r.chunk_end.day) for r in chunks] == [(1, 3), (4, 6), (7, 9), (10, 10)]
    with pytest.raises(ValueError):
        catalogue.date_chunks(spark, "2024-08-02", "2024-08-01")
    listing = spark.createDataFrame([("2024-08-01", f"out/{i}") for i in range(3)], "chunk_start string, target_path string")
    expected = spark.createDataFrame([("2024-08-01", 4), ("2024-08-02", 0)], "chunk_start string, expected long")
    there = spark.createDataFrame([("out/1",), ("out/1",), ("out/9",)], "target_path string")
    missing, summary = catalogue.reconcile(listing, there, expected)
    assert sorted(r.target_path for r in missing.collect()) == ["out/0", "out/2"]
    assert sorted(tuple(r) for r in summary.collect()) == [("2024-08-01", 4, 3, 1, 2), ("2024-08-02", 0, 0, 0, 0)]
    for chunks, cap in ((expected, 4), (None, 3)):
        with pytest.raises(ValueError, match="shorter"):
            catalogue.reconcile(listing, there, chunks, cap)


@pytest.mark.parametrize("name", ["catalogue_missing", "catalogue_reconcile"])
def test_days_of_any_number_of_rows_are_reconciled(spark, tmp_path, name):
    """One day with more listed rows than a server's answer can hold."""
    n = 12_000
    spark.range(n).select(F.col("id").alias("event_id"), F.lit("2024-01-01 10:00:00").cast("timestamp_ntz").alias("ts")).write.parquet(str(tmp_path / "events.parquet"))
    rows = colocation.QUERIES[name](spark, str(tmp_path)).collect()
    listed = [i for i in range(n) if i % 10 != 3]
    absent = [i for i in listed if i % 3 != 0]
    if name == "catalogue_missing":
        assert sorted(r.target_path for r in rows) == sorted(f"out/2024-01-01/D{i}_MD.XML" for i in absent)
    else:
        assert [tuple(r) for r in rows] == [("2024-01-01", len(listed), len(listed), len(listed) - len(absent), len(absent))]


def test_catalogue_files(spark, tmp_path):
    for day, names in (("2024-08-01", (" a ", "b", " ")), ("2024-08-02", ("c",))):
        (tmp_path / f"list/chunk_start={day}").mkdir(parents=True)
        rows = "".join(f"{n}\tu\t{'' if n == 'b' else day + 'T01:02:03Z'}\n" for n in names)
        (tmp_path / f"list/chunk_start={day}/x.tsv").write_text("dipFilename\tproductURI\tbeginAcquisition\n" + rows)
    out = str(tmp_path / "out")
    assert files.read_inventory(spark, out).count() == 0
    (tmp_path / "out/2024-08-01").mkdir(parents=True)
    (tmp_path / "out/2024-08-01/b_MD.XML").write_text("x")
    (tmp_path / "out/2024-08-01/b_MD.XML.tmp").write_text("x")
    listing = catalogue.with_targets(files.read_catalogue(spark, str(tmp_path / "list")), "http://h", out)
    missing, summary = catalogue.reconcile(listing, files.read_inventory(spark, out))
    assert sorted(r.target_path for r in missing.collect()) == [f"{out}/2024-08-01/a_MD.XML", f"{out}/2024-08-02/c_MD.XML"]
    assert sorted((str(r.chunk_start), r.listed, r.present) for r in summary.collect()) == [("2024-08-01", 2, 1), ("2024-08-02", 1, 0)]
    one = files.read_catalogue(spark, str(tmp_path / "list/chunk_start=2024-08-02/x.tsv"), chunk_start="2024-08-05").first()
    assert (one.dip_filename, str(one.chunk_start)) == ("c", "2024-08-05")


def test_circular_mean(spark):
    assert spark.createDataFrame([(179.0,), (-179.0,)], "x double").select(geometry.circular_mean(F.col("x"))).first()[0] == pytest.approx(180)


def _geo(kind, coords):
    return json.dumps({"type": "Feature", "geometry": {"type": kind, "coordinates": coords}})


SQUARE = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
HOLE = [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]


def _deep(levels):
    """A point at the bottom of nested collections, beside empty ones."""
    geometry = {"type": "Point", "coordinates": [3, 5]}
    for _ in range(levels):
        geometry = {"type": "GeometryCollection", "geometries": [{"type": "GeometryCollection", "geometries": []}, geometry]}
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": None}, {"type": "Feature", "geometry": geometry}]})


def _footprints(spark, docs):
    rows = [(f"/r/folder/20240101T0{i // 60}{i % 60:02}00Z.geojson", d) for i, d in enumerate(docs)]
    return files.parse_footprints(spark.createDataFrame(rows, "path string, value string"))


def _points(spark, rows):
    return spark.createDataFrame([(float(lat), float(lon), str(us), us) for lon, lat, us in rows], "latitude double, longitude double, timestamp string, point_us long")


def test_containment(spark):
    docs = [
        _geo("Polygon", [SQUARE]), _geo("Polygon", [SQUARE, HOLE]), _geo("LineString", SQUARE), _geo("Point", [1, 1]), _geo("Polygon", [SQUARE[:2]]), "{bad",
        _geo("MultiPolygon", [[SQUARE], [SQUARE]]), json.dumps({"type": "GeometryCollection", "geometries": [{"type": "MultiPoint", "coordinates": [[5, 5]]}]}),
        json.dumps({"type": "GeometryCollection", "geometries": [json.loads(_geo("Polygon", [SQUARE]))]}), json.dumps({"type": "Thing", "geometry": json.loads(_geo("Point", [11, 5]))}), _deep(40),
    ]
    found, rejects = _footprints(spark, docs)
    assert rejects.count() == 1
    base = found.agg(F.min("footprint_us")).first()[0]
    points = _points(spark, [(0, 5, base), (0, 0, base), (5, 5, base), (4, 5, base), (3, 5, base), (1 + 5e-10, 1, base), (11, 5, base)])
    got = {(r.longitude, r.latitude, int(r.geojson_filename[11:13])) for r in colocate(points, found).collect()}
    inside = [(0, 5), (0, 0), (5, 5), (4, 5), (3, 5), (1 + 5e-10, 1)]
    assert got == {(x, y, k) for k in (0, 6) for x, y in inside} | {(x, y, 1) for x, y in inside if (x, y) not in [(5, 5), (4, 5)]} | {(1 + 5e-10, 1, 3), (5, 5, 7), (11, 5, 9), (3, 5, 10)}


def test_window_and_months(spark):
    found, _ = _footprints(spark, [_geo("Polygon", [SQUARE])])
    at = found.first().footprint_us
    points = _points(spark, [(5, 5, at - 4 * HOUR), (5, 5, at + 4 * HOUR), (5, 5, at + 4 * HOUR + 1), (5, 5, at), (5, 5, at)])
    whole = colocate(points, found)
    assert sorted(r.time_diff_seconds for r in whole.collect()) == [-14400.0, 0.0, 0.0, 14400.0]
    parts = [colocate(points, found, month=m) for m in ("2023-12", "2024-01", "2024-02")]
    assert sum(p.count() for p in parts) == whole.count()
    for cells in (1, 64):
        for deg in (3.0, 10.0, 45.0):
            assert colocate(points, found, cell_deg=deg, max_cells=cells).count() == 4
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_files(spark, tmp_path):
    day = tmp_path / "root/2024/08/01/sub"
    day.mkdir(parents=True)
    xml = "<x><startTime>2024-08-01T23:58:20Z</startTime><stopTime>2024-08-02T00:01:20Z</stopTime><posList>10 5 10 15 20 15 20 5 10 5</posList></x>"
    for version in ("1", "2"):
        (day / f"A_B_C_D_E_F_G_H_I_{version}_x.manifest").write_text(xml)
    (tmp_path / "root/2024/08/02").mkdir()
    manifests, days = files.read_manifests(spark, str(tmp_path / "root"), "2024-07-31", "2024-08-02")
    assert [tuple(map(str, r)) for r in days.orderBy("day").collect()] == [("2024-07-31", "False"), ("2024-08-01", "True"), ("2024-08-02", "True")]
    assert [(str(r.day), r.manifests, r.selected) for r in tracks.manifest_counts(manifests, days.select("day")).orderBy("day").collect()] == [("2024-07-31", 0, 0), ("2024-08-01", 2, 1), ("2024-08-02", 0, 0)]
    found = tracks.footprints(manifests)[0]
    row = found.collect()
    assert len(row) == 1 and row[0].file_name.endswith("_2_x.manifest") and row[0].central_lat == 14.0 and row[0].polygon_file == "20240801T235950Z.geojson"
    files.write_summary(found, str(tmp_path / "summary"))
    with pytest.raises(ValueError, match="no footprints"):
        files.write_summary(found.limit(0), str(tmp_path / "none"))
    (tmp_path / "p.csv").write_text("latitude,longitude,timestamp\n1,2,2024-01-01T00:00:00.000Z\nx,2,2024-01-01T00:00:00Z\n")
    good, rejects = files.read_points(spark, str(tmp_path / "p.csv"), mode="quarantine")
    assert good.count() == 1 and rejects.count() == 1
    with pytest.raises(Exception):
        files.read_points(spark, str(tmp_path / "p.csv"))[0].collect()


def test_single_files_are_written_by_several_tasks(spark, tmp_path):
    """A grouped table is so small that Spark would gather it in one task; each file goes where its folders say, and no two to one place."""
    rows = spark.range(400).groupBy((F.col("id") % 40).alias("n")).agg(F.max("id").cast("string").alias("value"))
    rows = rows.select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n") % 2).cast("int")).alias("day"), F.concat(F.lit("a b_"), F.col("n").cast("string"), F.lit(".x")).alias("file_name"), "value")
    files.write_scratch_files(rows, str(tmp_path / "made"), "day", "file_name")
    parts = list((tmp_path / "made").glob("day=*/file_name=*/part-*"))
    assert len(parts) == 40 and len({p.name.split("-")[1] for p in parts}) > 1
    with pytest.raises(FileExistsError):
        files.place_files(spark, str(tmp_path / "made"), lambda names: str(tmp_path / "same"))
    files.place_files(spark, str(tmp_path / "made"), lambda names: f"{tmp_path}/out/{names['day'].replace('-', '/')}/{names['file_name']}")
    got = {str(p.relative_to(tmp_path / "out")): p.read_text().strip() for p in (tmp_path / "out").rglob("*.x")}
    assert got == {f"2024/01/0{n % 2 + 1}/a b_{n}.x": str(360 + n) for n in range(40)}


def test_dates_in_the_root(spark, tmp_path):
    """A root that itself looks like a date: the day is what stands below it."""
    root = tmp_path / "1999/01/02"
    for day in ("2024/08/01", "2024/08/02/sub"):
        (root / day).mkdir(parents=True)
        (root / day / "m.manifest").write_text("<x/>")
    found, _ = files.read_manifests(spark, str(root), "2024-08-01", "2024-08-03")
    assert sorted(str(r.day) for r in found.collect()) == ["2024-08-01", "2024-08-02"]


def test_granule_groups(spark, tmp_path):
    for name in ("base/a.XML", "base/b.xml", "base/sub/c.XML", "base/sub/deep/d.XML"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(_granule(2)[1])
    base = str(tmp_path / "base")
    groups = lambda **o: sorted((r.file_name, r.granule_group) for r in tracks.extract_points(files.read_granules(spark, base, **o))[0].filter("pos = 0").collect())
    assert groups() == [("a.XML", "base")]
    assert groups(recursive=True) == [("a.XML", "base"), ("c.XML", "sub"), ("d.XML", "sub")]
    assert files.read_granules(spark, f"{base}/sub/c.XML").first().granule_group == "c.XML"
    points = tracks.extract_points(files.read_granules(spark, base, recursive=True))[0]
    files.write_points(points, str(tmp_path / "points"), crlf=True)
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "points").glob("part-*")))
    assert raw.count(b"\r\n") == raw.count(b"\n") > 6
    back = files.read_points(spark, str(tmp_path / "points"))[0].orderBy("point_id").collect()
    assert [(r.latitude, r.timestamp) for r in back] == [(r.latitude, r.timestamp) for r in points.orderBy("path", "pos").collect()]


def test_written_footprints_match_again(spark, tmp_path):
    """Equal times get suffixes, several rings are several parts; what is written is read and matched in the order of the points."""
    xml = "<x><startTime>2024-08-01T00:00:00Z</startTime><stopTime>2024-08-01T00:00:00Z</stopTime>{}</x>"
    west, east = "<posList>10 -15 10 -5 20 -5 20 -15</posList>", "<posList>10 5 10 15 20 15 20 5</posList>"
    rows = [("m1", west), ("m2", west + east), ("m3", east)]
    manifests = spark.createDataFrame([(dt.date(2024, 8, 1), f"/{n}", n, xml.format(r)) for n, r in rows], "day date, path string, file_name string, xml string")
    files.write_footprints(tracks.footprints(manifests)[0], str(tmp_path / "f/north"))
    files.write_footprints(tracks.footprints(manifests.filter("file_name = 'm3'"))[0], str(tmp_path / "f/east"))
    found, rejects = files.read_footprints(spark, [str(tmp_path / "f/north"), str(tmp_path / "f/east")], lines=True)
    assert rejects.count() == 0
    (tmp_path / "p.csv").write_text("latitude,longitude,timestamp\n15,10,2024-08-01T01:00:00\n15,-10,2024-07-31T23:00:00.5+00:00\n15,0,2024-08-01T00:00:00Z\n15,10,2024-08-01T01:00:00\n")
    points = files.read_points(spark, str(tmp_path / "p.csv"))[0]
    files.write_matches(colocate(points, found), str(tmp_path / "m"), "csv")
    lines = [line for p in sorted((tmp_path / "m").rglob("part-*")) for line in p.read_text().splitlines() if not line.startswith("latitude")]
    names = ["20240801T000000Z_1.geojson", "20240801T000000Z_2.geojson"]
    east_of = [("15.0,10.0", "north", names[0]), ("15.0,10.0", "north", names[1]), ("15.0,10.0", "east", "20240801T000000Z.geojson")]
    want = [("15.0,-10.0", "north", "20240801T000000Z.geojson"), ("15.0,-10.0", "north", names[0]), *east_of, *east_of]
    assert [(",".join(x.split(",")[:2]), x.split(",")[3], x.split(",")[4]) for x in lines] == want
    assert sorted(p.name for p in (tmp_path / "m").glob("month=*")) == ["month=2024-07", "month=2024-08"]


def test_point_rows_in_error_are_shown(spark, tmp_path):
    (tmp_path / "p.csv").write_text("latitude,longitude,timestamp\n1,2,\n")
    with pytest.raises(Exception, match="not a point row.*longitude"):
        files.read_points(spark, str(tmp_path / "p.csv"))[0].collect()


def test_all_holes_count(spark):
    """A point in the last of many holes is outside."""
    holes = [[[i, 1], [i + 0.5, 1], [i + 0.5, 2], [i, 2], [i, 1]] for i in range(1, 9)]
    found, _ = _footprints(spark, [_geo("Polygon", [SQUARE, *holes])])
    at = found.first().footprint_us
    got = colocate(_points(spark, [(8.2, 1.5, at), (8.7, 1.5, at)]), found).collect()
    assert [r.longitude for r in got] == [8.7]


def _pairs(matches):
    return Counter((r.longitude, r.latitude, r.point_timestamp, r.geojson_filename) for r in matches.collect())


def _crowd(spark):
    """Points of which most are in one cell near a pole, a third of all in one place, some equal throughout; footprints that crowd there too."""
    rng = random.Random(3)
    base = 1_704_067_200_000_000
    places = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(300)] + [(rng.uniform(40, 50), rng.uniform(80, 89)) for _ in range(1200)] + [(45.5, 84.5)] * 700 + [(45.0, 85.0)] * 100
    points = _points(spark, [(x, y, base + (rng.randrange(10**10) if k < 2000 else 0)) for k, (x, y) in enumerate(places)])
    box = lambda x, y, w: [[x - w, y - w], [x + w, y - w], [x + w, y + w], [x - w, y + w], [x - w, y - w]]
    docs = [_geo("Polygon", [box(rng.uniform(40, 50), rng.uniform(80, 89), rng.uniform(0.2, 2))]) for _ in range(250)] + [_geo("Polygon", [box(rng.uniform(-170, 170), rng.uniform(-80, 80), 6)]) for _ in range(40)]
    docs += [_geo("MultiPolygon", [[box(44, 84, 2)], [box(46, 85, 2)], [box(-100, 10, 3)]]), _geo("Polygon", [box(0, 0, 90)]), _geo("MultiPolygon", [[box(0, 0, 179)], [box(45, 85, 1)]])]
    return points, _footprints(spark, docs)[0]


def test_crowded_cells_are_dealt_evenly(spark):
    points, found = _crowd(spark)
    whole = _pairs(colocate(points, found))
    assert sum(whole.values()) > 10_000
    for hot_rows in (50, 400):
        assert _pairs(colocate(points, found, hot_rows=hot_rows)) == whole
    fp = by_bucket(prepare_footprints(found, 4 * HOUR, 10.0, 9)).cache()
    levels = sorted(r[0] for r in fp.select("level").distinct().collect())
    assert levels[0] == 0 and len(levels) > 1
    pt, dealt, keys = deal(keyed_points(points, 4 * HOUR, 10.0, levels), fp, 10.0, 50)
    for rows, least in ((pt, 60), (dealt, 10)):
        spread = [r["n"] for r in rows.groupBy(*keys).agg(F.count("*").alias("n")).collect()]
        assert max(spread) <= 4 * 50 and len(spread) > least
    assert pt.filter("times = 100").count() >= 1
    # What a task of the join reads, with as many tasks as keys allow.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = sorted(r["n"] for r in pt.repartition(16, *keys).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(tasks) == 16 and tasks[-1] <= 4 * tasks[8]


def test_parts_are_stored_once_a_cell(spark):
    """A footprint of 400 parts: rows for its cells, each with its own parts only; a point in several parts matches once."""
    square = lambda k: [[[0.4 * k, 0], [0.4 * k + 0.5, 0], [0.4 * k + 0.5, 1], [0.4 * k, 1], [0.4 * k, 0]]]
    found, _ = _footprints(spark, [_geo("MultiPolygon", [square(k) for k in range(400)])])
    rows = prepare_footprints(found, 4 * HOUR, 10.0, 9).collect()
    assert len(rows) <= 2 * 18 and sum(len(r.parts) for r in rows) < 2 * 440
    at = found.first().footprint_us
    inside = [(0.45, 0.5), (81.2, 0.5), (9.99, 0.2), (10.0, 0.0), (159.6, 1.0), (160.2, 0.5)]
    assert _pairs(colocate(_points(spark, [(x, y, at) for x, y in inside]), found)) == {(x, y, str(at), found.first().file_name): 1 for x, y in inside[:5]}


def _even_odd(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


@pytest.mark.parametrize("shape", ["round", "star", "comb"])
def test_rings_of_many_vertices(spark, shape):
    """Edges looked up by band of latitude give what all edges give, and are few."""
    n = 4000
    if shape == "comb":
        ring = [(-20 + 40 * k / n, (-1) ** k * 15.0 + 1) for k in range(n)] + [(20, -30), (-20, -30)]
    else:
        radius = lambda k: 20 if shape == "round" or k % 2 else 4
        ring = [(radius(k) * math.cos(2 * math.pi * k / n) + 2, radius(k) * math.sin(2 * math.pi * k / n) + 1) for k in range(n)]
    found, _ = _footprints(spark, [_geo("Polygon", [[list(v) for v in ring]])])
    at = found.first().footprint_us
    rng = random.Random(1)
    points = [(rng.uniform(-25, 25), rng.uniform(-25, 25)) for _ in range(400)] + ring[::97]
    got = {(r.longitude, r.latitude) for r in colocate(_points(spark, [(x, y, at) for x, y in points]), found, cell_deg=30.0).collect()}
    want = {(x, y) for x, y in points[:400] if _even_odd(ring, x, y)} | set(ring[::97])
    assert got == want and 0 < len(want) < 440
    one = spark.createDataFrame([([(float(x), float(y)) for x, y in ring],)], "r array<struct<lon:double,lat:double>>").selectExpr(f"{geometry.edges_sql('r')} as ring_edges").selectExpr(f"{geometry.banded_sql('ring_edges')} as bands")
    sizes = one.selectExpr("size(bands.edges) as n_all", "size(bands.starts) as bands", f"size({geometry.edges_at_sql('3D', 'bands')}) as few").first()
    assert sizes["n_all"] < 5 * n and (shape != "round" or (sizes["bands"] > 300 and sizes["few"] < 40))


def test_small_rings_in_columns(spark):
    """Rings of up to eight vertices are tested without lambdas, and give what the edges give; also on edges and vertices, and where a ring crosses itself."""
    rng = random.Random(5)
    rows = []
    for n in [3, 4, 5, 8, 9] * 12:
        ring = [(rng.randrange(-8, 9) / 2, rng.randrange(-8, 9) / 2) for _ in range(n)]
        middle = [((a + c) / 2, (b + d) / 2) for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1])]
        rows += [(ring, float(x), float(y)) for x, y in ring + middle + [(rng.randrange(-9, 10) / 4, rng.randrange(-9, 10) / 4) for _ in range(20)]]
    table = spark.createDataFrame(rows, "r array<struct<lon:double,lat:double>>, x double, y double").selectExpr("x", "y", f"{geometry.edges_sql('r')} as ring_edges")
    table = table.selectExpr("*", f"{geometry.plain_ring_sql('ring_edges')} as ring").select("x", "y", "ring_edges", "ring.*")
    got = table.selectExpr("size(ring_edges) as n", "ring_x0 is not null as plain", f"{geometry.in_plain_ring_sql('x', 'y')} as a", f"{geometry.in_ring_sql('x', 'y', 'ring_edges')} as b").collect()
    assert all(r.plain == (r.n <= 8) and (r.a == r.b or not r.plain) for r in got)
    assert {r.b for r in got if r.plain} == {True, False}


def test_footprints_of_one_small_ring_hold_no_lambda_parts(spark):
    hole = [[[2, 2], [3, 2], [3, 3], [2, 3], [2, 2]]]
    found, _ = _footprints(spark, [_geo("Polygon", [SQUARE]), _geo("Polygon", [SQUARE, *hole]), _geo("MultiPolygon", [[SQUARE], [SQUARE]]), _geo("Point", [1, 1])])
    rows = prepare_footprints(found, 4 * HOUR, 30.0, 9).collect()
    assert {(r.file_name[11:13], r.ring_n, max(len(p.rings) for p in r.parts)) for r in rows} == {("00", 4, 0), ("01", None, 2), ("02", None, 1), ("03", None, 0)}
    assert all(r.west <= 1 <= r.east and r.south <= 1 <= r.north for r in rows if r.gx == r.gy == 0)


def test_xml_in_one_parse(spark):
    """Names with and without namespaces, text cut by comments, children and entities, elements without text, prefixes that stand for nothing."""
    from swathkit.functions.xml import read_elements

    one = lambda text, by_end=False: read_elements(text, ("beginPosition", "endPosition"), "posList", by_end)
    doc = '<g:r xmlns:g="u"><g:beginPosition>a<!-- x -->b&amp;<![CDATA[<]]></g:beginPosition><endPosition>c<i>d</i>e</endPosition><endPosition>f</endPosition><g:posList> 1 2\n3 4 </g:posList><g:posList>5 x</g:posList></g:r>'
    assert one(doc) == (True, ["ab&<", "c"], [[1.0, 2.0, 3.0, 4.0]])
    assert one("<r><beginPosition/><beginPosition>b</beginPosition><thePosList>1</thePosList></r>") == (True, ["", None], [])
    ending = read_elements("<r><aTime/><bTime>t</bTime><xposList>1 2</xposList><posList>3 y</posList><posList/></r>", ("Time", "none"), "posList", True)
    assert ending == (True, ["t", None], [[1.0, 2.0], None])
    for bad in ("<g:r/>", "<r>", "", None, "<r/><r/>", "<r>&</r>"):
        assert one(bad)[0] is False


def test_single_files_of_any_name(spark, tmp_path):
    for name in ("meta.txt", "m.XML", "n.xml", "plain"):
        (tmp_path / name).write_text(_granule(2)[1])
        rows = files.read_granules(spark, str(tmp_path / name)).collect()
        assert [(r.file_name, r.granule_group) for r in rows] == [(name, name)]
    assert [r.file_name for r in files.read_granules(spark, str(tmp_path)).collect()] == ["m.XML"]
    with pytest.raises(FileNotFoundError):
        files.read_granules(spark, str(tmp_path / "none"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_by_month_are_pruned(spark, tmp_path):
    """A month's footprints come from its folder and its neighbours', filters reach the scan, and a month written again leaves the others."""
    us = lambda text: int(dt.datetime.fromisoformat(text + "+00:00").timestamp()) * 1_000_000
    times_ = ["2024-01-15T00:00:00", "2024-01-31T23:00:00", "2024-02-01T01:00:00", "2024-02-20T00:00:00", "2024-02-29T21:00:00", "2024-03-01T03:00:00", "2024-03-01T05:00:00", "2024-05-01T00:00:00"]
    ring = "array(array(named_struct('lon', x - 1, 'lat', -1D), named_struct('lon', x + 1, 'lat', -1D), named_struct('lon', x + 1, 'lat', 1D), named_struct('lon', x - 1, 'lat', 1D)))"
    rows = spark.createDataFrame([(us(t), f"{k}.geojson", float(10 * k)) for k, t in enumerate(times_)], "us long, polygon_file string, x double")
    made = rows.selectExpr("timestamp_micros(us) as central_ts", "polygon_file", f"{ring} as rings")
    folder = str(tmp_path / "north")
    tables.write_footprints_table(made, folder)
    found = tables.read_footprints_table(spark, [folder], "2024-02", 4 * HOUR)
    assert sorted(r.file_name for r in found.collect()) == [f"{k}.geojson" for k in (1, 2, 3, 4, 5)]
    assert {f.split("month=")[1][:7] for f in found.inputFiles()} >= {"2024-02"}
    plan = _plan(found)
    assert "PartitionFilters: [month#" in plan and "IN (2024-01,2024-02,2024-03)" in plan and "GreaterThanOrEqual(footprint_us" in plan
    boxed = tables.read_footprints_table(spark, [folder], box=(9.5, 21, 0, 5))
    assert sorted(r.file_name for r in boxed.collect()) == ["1.geojson", "2.geojson"] and "GreaterThanOrEqual(x1,9.5)" in _plan(boxed)
    points = spark.createDataFrame([(0.0, float(10 * k), t, us(t), k) for k, t in enumerate(times_)], "latitude double, longitude double, timestamp string, point_us long, point_id long")
    tables.write_points_table(points, str(tmp_path / "points"))
    at = tables.read_points_table(spark, str(tmp_path / "points"), "2024-02")
    assert sorted(r.point_id for r in at.collect()) == [2, 3, 4] and re.search(r"PartitionFilters: \[[^]]*month#\d+ = 2024-02", _plan(at)) and "GreaterThanOrEqual(point_us" in _plan(at)
    assert sorted(r.geojson_filename for r in colocate(at, found).collect()) == ["2.geojson", "3.geojson", "4.geojson"]
    tables.write_points_table(points.filter("point_id = 3").withColumn("latitude", F.lit(9.0)), str(tmp_path / "points"))
    assert {(r.point_id, r.latitude) for r in tables.read_points_table(spark, str(tmp_path / "points")).collect()} == {(k, 0.0) for k in (0, 1, 5, 6, 7)} | {(3, 9.0)}


def test_inventory_lists_changed_days_only(spark, tmp_path):
    out, table = tmp_path / "out", str(tmp_path / "kept")
    update = lambda: inventory.update_inventory(spark, str(out), table)
    have = lambda: sorted(r.target_path.removeprefix(str(out)) for r in inventory.kept_inventory(spark, str(out), table).collect())

    def put(day, *names, old=True):
        (out / day).mkdir(parents=True, exist_ok=True)
        for name in names:
            (out / day / name).write_text("x")
        if old:
            os.utime(out / day, (1_700_000_000 + len(list((out / day).iterdir())),) * 2)

    assert update() == [] and have() == []
    put("2024-08-01", "a_MD.XML", "b_MD.XML", "c.tmp")
    put("2024-08-02", "d_MD.XML")
    assert update() == ["2024-08-01", "2024-08-02"]
    assert have() == ["/2024-08-01/a_MD.XML", "/2024-08-01/b_MD.XML", "/2024-08-02/d_MD.XML"]
    assert update() == []
    put("2024-08-02", "e_MD.XML")
    put("2024-08-03", "f_MD.XML", old=False)
    assert update() == ["2024-08-02", "2024-08-03"]
    # A folder that changed just now is listed once more; one that is gone leaves the inventory.
    (out / "2024-08-01/a_MD.XML").unlink()
    (out / "2024-08-01/b_MD.XML").unlink()
    (out / "2024-08-01/c.tmp").unlink()
    (out / "2024-08-01").rmdir()
    assert update() == ["2024-08-03", "2024-08-01"]
    assert have() == ["/2024-08-02/d_MD.XML", "/2024-08-02/e_MD.XML", "/2024-08-03/f_MD.XML"]


def test_late_manifests_change_their_day_only(spark, tmp_path):
    xml = "<x><startTime>{0}T00:00:00Z</startTime><stopTime>{0}T00:00:02Z</stopTime><posList>0 {1} 0 5 5 5</posList></x>"

    def put(day, name, east=1):
        at = tmp_path / "root" / day.replace("-", "/") / "sub"
        at.mkdir(parents=True, exist_ok=True)
        (at / name).write_text(xml.format(day, east))

    name = "A_B_C_D_E_F_G_H_I_{}_x.manifest".format
    root, table = str(tmp_path / "root"), str(tmp_path / "table")
    run = lambda: [str(d) for d in refresh.refresh_footprints(spark, root, "2024-08-01", "2024-08-04", table)]
    whole = lambda: tracks.footprints(files.read_manifests(spark, root, "2024-08-01", "2024-08-04")[0])[0]
    rows = lambda df: sorted(map(repr, df.select("day", "path", "file_name", "central_time", "central_lat", "polygon_file", "rings", "straddles").collect()))
    for day in ("2024-08-01", "2024-08-02", "2024-08-04"):
        put(day, name(1))
    assert run() == ["2024-08-01", "2024-08-02", "2024-08-04"] and rows(refresh.kept_footprints(spark, table)) == rows(whole())
    assert run() == []
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "table/footprints/day=2024-08-01").glob("*.parquet")}
    put("2024-08-02", name(2), 2)
    put("2024-08-03", name(1))
    assert run() == ["2024-08-02", "2024-08-03"] and rows(refresh.kept_footprints(spark, table)) == rows(whole())
    (tmp_path / "root/2024/08/04/sub" / name(1)).unlink()
    assert run() == ["2024-08-04"] and rows(refresh.kept_footprints(spark, table)) == rows(whole())
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "table/footprints/day=2024-08-01").glob("*.parquet")}


def test_requests_and_caps(spark):
    day = lambda n: dt.date(2024, 8, n)
    rows = [("a", day(1), day(10), 3), ("b", day(1), day(1), 9), ("c", day(2), day(1), 1), ("d", day(1), day(2), 0), ("e", None, day(1), 1)]
    chunks, rejects = catalogue.chunk_requests(spark.createDataFrame(rows, "k string, start date, end date, days long"))
    assert sorted((r.k, r.chunk_start.day, r.chunk_end.day) for r in chunks.collect()) == [("a", 1, 3), ("a", 4, 6), ("a", 7, 9), ("a", 10, 10), ("b", 1, 1)]
    assert sorted((r.k, r.reason) for r in rejects.collect()) == [("c", "start after end"), ("d", "days below 1"), ("e", "no start, end or days")]
    counts = spark.createDataFrame([("x", 9_999), ("y", 10_000)], "chunk_start string, expected long")
    assert [r.chunk_start for r in catalogue.over_cap(counts).collect()] == ["y"]


def test_far_points_stand_in_their_own_cells(spark):
    """Points of a MultiPoint take a cell each, of the smallest size, and not all cells of the box around them."""
    far = [[-170, -80], [3, 4], [3.5, 4.5], [170, 80], [10, 0]]
    found, _ = _footprints(spark, [_geo("MultiPoint", far)])
    rows = prepare_footprints(found, 4 * HOUR, 10.0, 9).collect()
    assert sorted((r.level, r.gx, r.gy, len(r.parts[0].points)) for r in rows if len(r.parts[0].points) > 1) == [(0, 0, 0, 3)]
    # A point on the corner of cells stands in all four.
    assert len(rows) <= 12 and all(r.level == 0 and r.east - r.west < 10 for r in rows)
    at = found.first().footprint_us
    places = [*far, [3, 4.5], [0, 0], [170, -80]]
    assert _pairs(colocate(_points(spark, [(float(x), float(y), at) for x, y in places]), found)) == {(float(x), float(y), str(at), found.first().file_name): 1 for x, y in far}


def test_rings_are_tested_behind_the_join(spark):
    """The loop over the pairs of a key holds time and box only, so it is compiled; wide rows of footprints stand in one bucket."""
    points, found = _crowd(spark)
    plan = colocate(points, found)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 1 and "west" in joins[0] and "ring_" not in joins[0] and "exists(" not in joins[0]
    fp = prepare_footprints(found, 4 * HOUR, 10.0, 9)
    assert "buckets" not in fp.columns and fp.groupBy("file_name", "source_folder", "level", "gx", "gy").count().filter("count > 1").isEmpty()
    kept = by_bucket(fp).collect()
    assert all((r.parts is None) == (r.ring_x0 is not None) for r in kept) and any(r.parts is None for r in kept)


def test_small_rings_take_the_cells_that_loops_find(spark):
    """A ring in columns from the start, and the same with so many vertices that it isn't, have the same cells, boxes and matches."""
    rng = random.Random(11)
    rings = []
    for _ in range(60):
        x, y, w = rng.uniform(-170, 170), rng.uniform(-80, 80), rng.choice([0.1, 4, 10, 45])
        rings.append([(x + rng.uniform(-w, w), y + rng.uniform(-w, w)) for _ in range(rng.randint(3, 5))])
    many = [[v for v in ring for _ in range(3)] for ring in rings]
    few, lots = (_footprints(spark, [_geo("Polygon", [[list(v) for v in [*ring, ring[0]]]]) for ring in kind])[0] for kind in (rings, many))
    cells = lambda df: {(r.file_name, r.level, r.bucket, r.gx, r.gy, r.west, r.east, r.south, r.north) for r in prepare_footprints(df, 4 * HOUR, 10.0, 9).collect()}
    assert cells(few) == cells(lots)
    at = few.first().footprint_us
    points = _points(spark, [(rng.uniform(-180, 180), rng.uniform(-90, 90), at + rng.randrange(-5 * HOUR, 5 * HOUR)) for _ in range(1500)] + [(*v, at) for ring in rings for v in ring])
    assert len(_pairs(colocate(points, few))) > 300 and _pairs(colocate(points, few)) == _pairs(colocate(points, lots))


def test_points_without_a_coordinate_leave_the_others(spark):
    found, _ = _footprints(spark, [_geo("MultiPoint", [[3, 4], [50, 60]])])
    found = found.withColumn("parts", F.expr("transform(parts, p -> struct(p.kind as kind, transform(p.rings, r -> concat(r, array(struct(cast(null as double) as lon, 1D as lat)))) as rings))"))
    at = found.first().footprint_us
    assert sum(_pairs(colocate(_points(spark, [(3.0, 4.0, at), (50.0, 60.0, at), (3.0, 1.0, at)]), found)).values()) == 2


def test_equal_points_travel_once(spark, tmp_path):
    """Equal points are one row of the join, and their matches stand together, so that copies of points add little to a file; 0.0 and -0.0 are two texts."""
    found, _ = _footprints(spark, [_geo("Polygon", [SQUARE]), _geo("Polygon", [[[-1, -1], [2, -1], [2, 1], [-1, -1]]])])
    at = found.agg(F.min("footprint_us")).first()[0]
    rng = random.Random(7)
    few = [(rng.uniform(0, 1), rng.uniform(0, 1), at + rng.randrange(HOUR)) for _ in range(300)] + [(0.0, 0.5, at), (-0.0, 0.5, at)]
    many = few * 40
    rng.shuffle(many)
    rows = keyed_points(_points(spark, many), 4 * HOUR, 10.0, [0]).collect()
    assert len(rows) == 5 * len(few) and {r.times for r in rows} == {40}
    once, all_of = (colocate(_points(spark, some), found) for some in (few, many))
    text = lambda df: Counter(map(repr, df.collect()))
    assert len(text(once)) > 300 and text(all_of) == {match: 40 * n for match, n in text(once).items()}
    size = lambda df, name: (df.coalesce(1).write.parquet(str(tmp_path / name)), sum(p.stat().st_size for p in (tmp_path / name).glob("*.parquet")))[1]
    assert size(all_of, "many") < 2 * size(once, "once")


def test_named_files_are_written_in_place(spark, tmp_path, monkeypatch):
    """Tasks write each file under its name; none is moved by the driver."""
    monkeypatch.setattr(files, "place_files", lambda *_: pytest.fail("files were moved one by one"))
    rows = spark.range(400).select(F.format_string("%02d/a b%%_%d.x", F.col("id") % 3, "id").alias("place"), F.when(F.col("id") != 7, F.concat(F.lit("ä"), F.col("id").cast("string"))).alias("value"))
    out = tmp_path / "out dir"
    (out / "00").mkdir(parents=True)
    (out / "00/.a b%_0.x.crc").write_text("crc\0 of what stood there")
    for _ in range(2):
        files.write_named_files(rows, str(out))
        assert {str(p.relative_to(out)): p.read_text() for p in out.rglob("*") if p.is_file()} == {f"{n % 3:02}/a b%_{n}.x": ("" if n == 7 else f"ä{n}") + "\n" for n in range(400)}
    assert spark.read.option("recursiveFileLookup", "true").text(str(out)).count() == 400
    with pytest.raises(FileExistsError, match="00/same"):
        files.write_named_files(rows.withColumn("place", F.when(F.col("place").startswith("00"), F.lit("00/same")).otherwise(F.col("place"))), str(out))
    ring = F.expr("array(array(struct(1D as lon, 2D as lat), struct(3D as lon, 2D as lat), struct(3D as lon, 5D as lat), struct(1D as lon, 2D as lat)))")
    prints = spark.range(5).select(ring.alias("rings"), F.lit("2024-08-01T00:00:00Z").alias("central_time"), F.lit("m").alias("file_name"), F.format_string("%d.geojson", "id").alias("polygon_file"))
    files.export_geojson(prints, str(tmp_path / "exchange"))
    assert {p.name: json.loads(p.read_text())["type"] for p in (tmp_path / "exchange").iterdir()} == {f"{n}.geojson": "Feature" for n in range(5)}


def test_many_manifests_make_few_tasks_and_files(spark, tmp_path):
    """Manifests are read as bytes by a few tasks, unless their pattern may match compressed ones; a refresh adds one file to a day, however many tasks read it."""
    xml = "<x><startTime>{0}T00:00:{1:02}Z</startTime><stopTime>{0}T00:01:00Z</stopTime><posList>0 1 0 5 5 5</posList></x>"
    for day in ("2024-08-01", "2024-08-02"):
        at = tmp_path / "root" / day.replace("-", "/")
        at.mkdir(parents=True)
        for n in range(40):
            (at / f"A_B_C_D_E_F_G_H_{n}_1_x.manifest").write_text(xml.format(day, n))
    (at / "z.manifest.gz").write_bytes(gzip.compress(xml.format("2024-08-02", 59).encode()))
    root, table = str(tmp_path / "root"), str(tmp_path / "table")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4194304")
    try:
        rows, _ = files.read_manifests(spark, root, "2024-08-01", "2024-08-02")
        assert rows.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism < 80
        assert "binaryFile" in rows._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.xml for r in rows.collect()) == sorted(xml.format(day, n) for day in ("2024-08-01", "2024-08-02") for n in range(40))
        for pattern in ("*.gz", "z.*"):
            assert [r.xml for r in files.read_manifests(spark, root, "2024-08-01", "2024-08-02", pattern)[0].collect()] == [xml.format("2024-08-02", 59)]
        assert len(refresh.refresh_footprints(spark, root, "2024-08-01", "2024-08-02", table)) == 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert refresh.kept_footprints(spark, table).count() == 80
    assert [len(list((tmp_path / "table").glob(f"{kind}/day={day}/*.parquet"))) for kind in ("manifests", "footprints") for day in ("2024-08-01", "2024-08-02")] == [1] * 4
