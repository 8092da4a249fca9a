"""Registered queries of the colocation jobs, on points, footprints and documents derived from events."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swathkit.functions import geojson, geometry, times
from swathkit.operators import catalogue, refresh, rings, tracks
from swathkit.operators.colocate import HOUR, colocate, match_totals
from swathkit.sources import files, inventory, tables
from swathkit.sources.scratch import materialize, scratch_path


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, spread over all cores: what is derived from a row costs far more than moving it, and a small table is one split."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("us", times.micros_of_ntz(F.col("ts")))
    return rows.repartition(spark.sparkContext.defaultParallelism, "event_id")


def _point_place(event_id: Column) -> tuple[Column, Column]:
    return event_id * 7919 % 3600 * F.lit(0.1) - 180, event_id * 104729 % 1800 * F.lit(0.1) - 90


def points(events: DataFrame) -> DataFrame:
    """Half of the events are points, a fifth footprints: the two sides of the join."""
    lon, lat = _point_place(F.col("event_id"))
    rows = events.filter("event_id % 2 = 0").withColumn("longitude", lon).withColumn("latitude", lat)
    return rows.select("latitude", "longitude", times.millis_text(F.timestamp_micros("us")).alias("timestamp"), F.col("us").alias("point_us"))


_CORNERS = ((-6, -5), (7, -7), (5, 6), (-8, 4))


def _centres(events: DataFrame) -> DataFrame:
    return events.withColumn("cx", (F.col("event_id") * 31337) % 3400 * F.lit(0.1) - 170).withColumn("cy", (F.col("event_id") * 2713) % 1600 * F.lit(0.1) - 80)


def _folder() -> Column:
    return F.when(F.col("event_id") % 2 == 0, "a").otherwise("b")


def _shapes(events: DataFrame, scale: int = 1) -> DataFrame:
    """A footprint for each of the events."""
    rows = _centres(events)
    ring = F.array(*[F.struct((F.col("cx") + scale * a).alias("lon"), (F.col("cy") + scale * b).alias("lat")) for a, b in _CORNERS])
    part = F.struct(F.lit("Polygon").alias("kind"), F.array(ring).alias("rings"))
    return rows.select(F.col("us").alias("footprint_us"), _folder().alias("source_folder"), F.concat(F.col("event_id").cast("string"), F.lit(".geojson")).alias("file_name"), F.array(part).alias("parts"))


def footprint_table(events: DataFrame, scale: int = 1) -> DataFrame:
    return _shapes(events.filter("event_id % 5 = 1"), scale)


def colocate_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return colocate(points(events), footprint_table(events, 3))


def colocate_interval_pip(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return colocate(points(events), footprint_table(events))


#: The events lie within a January; later by this, the end of the month cuts them.
_LATER = 15 * 86_400_000_000


def colocate_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("us", F.col("us") + _LATER)
    return colocate(points(events), footprint_table(events), month="2024-01")


def colocate_multi_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_totals(colocate_interval_pip(spark, sf_dir))


def _document(event_id: Column, cx: Column, cy: Column) -> Column:
    """GeoJSON of nine kinds, one of them malformed and one without area."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    pair = lambda x, y: text("[", x, ",", y, "]")
    box = lambda x, y, w, h: text("[", pair(x - w, y - h), ",", pair(x + w, y - h), ",", pair(x + w, y + h), ",", pair(x - w, y + h), ",", pair(x - w, y - h), "]")
    geometry_of = lambda kind, coordinates: text(f'{{"type":"{kind}","coordinates":', coordinates, "}")
    collection = lambda *inner: text('{"type":"GeometryCollection","geometries":[', *inner, "]}")
    feature = lambda g: text('{"type":"Feature","properties":null,"geometry":', g, "}")
    outer = box(cx, cy, 6, 5)
    lon, lat = _point_place(event_id + event_id % 2)
    square = geometry_of("Polygon", text("[", outer, "]"))
    kinds = [
        feature(square),
        feature(geometry_of("Polygon", text("[", outer, ",", box(cx, cy, 3, 2), ",", box(cx + 5, cy, F.lit(0.5), 1), "]"))),
        feature(geometry_of("MultiPolygon", text("[[", outer, "],[", box(cx + 6, cy, 6, 5), "]]"))),
        feature(geometry_of("Point", pair(lon, lat))),
        geometry_of("MultiPoint", text("[", pair(cx, cy), ",", pair(lon, lat), "]")),
        feature(collection(geometry_of("LineString", outer), ",", collection(collection(collection(collection(collection(square))))))),
        feature(geometry_of("LineString", outer)),
        text('{"type":"FeatureCollection","features":[', feature(square), ",", feature(geometry_of("Polygon", text("[", box(cx - 6, cy, 6, 5), "]"))), "]}"),
        text('{"type":"Feature","geometry":', outer),
    ]
    kind = (F.floor(event_id / 5) % len(kinds)).cast("int")
    return functools.reduce(lambda chosen, k: chosen.when(kind == k, kinds[k]), range(1, len(kinds)), F.when(kind == 0, kinds[0]))


def _documents(events: DataFrame) -> DataFrame:
    rows = _centres(events)
    name = F.concat(times.safe_name(times.iso_text(F.timestamp_micros("us")), "_"), F.col("event_id").cast("string"), F.lit(".geojson"))
    # Behind a generator a document is put together once, however often its reader refers to it, and apart from the reader's code, with which it outgrows what can be compiled.
    made = F.struct(F.concat(F.lit("/f/"), _folder(), F.lit("/"), name).alias("path"), _document(F.col("event_id"), F.col("cx"), F.col("cy")).alias("value"))
    return rows.select(F.explode(F.array(made)).alias("made")).select("made.*")


def colocate_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints with holes, of several parts, of points, in nested collections; malformed and empty ones match nothing."""
    events = _events(spark, sf_dir)
    found, _ = files.parse_footprints(_documents(events.filter("event_id % 5 = 1")))
    return colocate(points(events), found).select("longitude", "latitude", "source_folder", "geojson_filename", "time_diff_seconds")


def geojson_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejects = files.parse_footprints(_documents(_events(spark, sf_dir)))
    return rejects


def _granules(events: DataFrame) -> DataFrame:
    """Metadata of tracks with one to five points, as XML text."""
    n = F.col("event_id") % 5 + 1
    pos = F.array_join(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.concat_ws(" ", ((F.col("event_id") * 7 + i * 3) % 90).cast("string"), ((F.col("event_id") * 11 + i * 5) % 180).cast("string"))), " ")
    begin = times.iso_text(F.timestamp_micros("us"))
    end = times.iso_text(F.timestamp_micros(F.col("us") + (F.col("event_id") % 7 + 1) * 1_000_001))
    return events.select(F.col("event_id").cast("string").alias("file_name"), _granule(begin, end, pos).alias("xml"))


def _granule(begin: Column, end: Column, pos: Column) -> Column:
    start = F.lit('<r xmlns:gml="http://www.opengis.net/gml/3.2"><gml:beginPosition>')
    return F.concat(start, begin, F.lit("</gml:beginPosition><gml:endPosition>"), end, F.lit("</gml:endPosition><gml:posList>"), pos, F.lit("</gml:posList></r>"))


def points_from_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = tracks.extract_points(_granules(_events(spark, sf_dir)))
    return found.select("file_name", "pos", "latitude", "longitude", "timestamp")


def _harmed(events: DataFrame) -> DataFrame:
    """The granules, half of them damaged in one of five ways."""
    way = F.col("file_name").cast("long") % 10
    harm = F.when(way == 1, F.substring("xml", 1, 60)).when(way == 3, F.concat("xml", F.lit("<more/>"))).when(way == 5, F.regexp_replace("xml", "begin", "start"))
    harm = harm.when(way == 7, F.regexp_replace("xml", "</gml:posList>", " 1</gml:posList>")).when(way == 9, F.regexp_replace("xml", "<gml:endPosition>", "<gml:endPosition>x")).otherwise(F.col("xml"))
    return _granules(events).withColumn("xml", harm)


def granule_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.extract_points(_harmed(_events(spark, sf_dir)), mode="quarantine")[1]


def granules_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = tracks.extract_points(_harmed(_events(spark, sf_dir)), mode="quarantine")
    return found.groupBy("file_name").agg(F.count("*").alias("n"), F.max("timestamp").alias("last"))


#: Events in a file of the queries that write files first.
_A_FILE = 100


def _tracks_of_files(events: DataFrame) -> DataFrame:
    """Granules of 100 events each, with the day of the first."""
    place = F.concat_ws(" ", (F.col("event_id") * 7 % 90).cast("string"), (F.col("event_id") * 11 % 180).cast("string"))
    rows = events.groupBy(F.floor(F.col("event_id") / _A_FILE).alias("granule")).agg(F.min("us").alias("low"), F.max("us").alias("high"), F.array_sort(F.collect_list(F.struct("event_id", place.alias("place")))).alias("v"))
    text = _granule(times.iso_text(F.timestamp_micros("low")), times.iso_text(F.timestamp_micros("high")), F.array_join(F.transform("v", lambda v: v["place"]), " "))
    return rows.select(times.utc_date(F.col("low")).alias("day"), text.alias("value"))


def _write_singly(rows: DataFrame, path: str) -> None:
    """Documents (day, value) as a file for each, in folders by day, on all cores; tasks move their files in place themselves."""
    spread = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    spread.write.partitionBy("day").option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


def granule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Granules written as files in folders by day, and read from there."""
    path = scratch_path(spark, "granules")
    _write_singly(_tracks_of_files(_events(spark, sf_dir)), path)
    found, _ = tracks.extract_points(files.read_granules(spark, path, recursive=True, files="part-*"))
    return found.select("granule_group", "pos", "latitude", "longitude", "timestamp")


def _manifest(start: Column, stop: Column, x: Column, y: Column) -> Column:
    pos = F.concat_ws(" ", *[c.cast("string") for a, b in _CORNERS for c in (y + b, x + a)])
    return F.concat(F.lit('<x xmlns:s="u"><s:startTime>'), start, F.lit("</s:startTime><s:stopTime>"), stop, F.lit("</s:stopTime><s:posList>"), pos, F.lit("</s:posList></x>"))


def _manifests(events: DataFrame, x: Column | None = None, start_us: Column | None = None) -> DataFrame:
    """A manifest for each event; some 997 of them a day differ by more than their version."""
    x = F.col("event_id") * 31337 % 340 - 170 if x is None else x
    start_us = F.col("us") if start_us is None else start_us
    stop_us = start_us + F.col("event_id") % 11 * 1_000_001
    xml = _manifest(*(times.iso_text(F.timestamp_micros(c)) for c in (start_us, stop_us)), x, F.col("event_id") * 2713 % 160 - 80)
    key = F.concat_ws("_", *[F.lit(c) for c in "ABCDEFGH"], (F.col("event_id") % 997).cast("string"), F.lpad((F.col("event_id") * 7919 % 100000).cast("string"), 5, "0"), F.lit("x.manifest"))
    return events.select(times.utc_date(F.col("us")).alias("day"), F.concat(F.lit("/m/"), F.col("event_id").cast("string")).alias("path"), key.alias("file_name"), xml.alias("xml"))


def footprint_midpoint_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = tracks.read_manifest(_manifests(_events(spark, sf_dir)))
    return found.select("path", "central_time", F.round("central_lat", 6).alias("central_lat"), F.round("central_lon", 6).alias("central_lon"))


def _vertices(df: DataFrame, *keys: str) -> DataFrame:
    """A row for each vertex of rings."""
    rows = df.select(*keys, F.posexplode("rings").alias("ring_no", "ring")).select(*keys, "ring_no", F.posexplode("ring").alias("pos", "v"))
    return rows.select(*keys, "ring_no", "pos", F.round("v.lon", 6).alias("lon"), F.round("v.lat", 6).alias("lat"))


def footprints_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = tracks.footprints(_manifests(_events(spark, sf_dir)))
    return _vertices(found, "path", "central_time", "polygon_file", "straddles")


def manifest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifests = _manifests(_events(spark, sf_dir))
    ends = manifests.agg(F.date_sub(F.min("day"), 1).alias("low"), F.date_add(F.max("day"), 1).alias("high"))
    days = ends.select(F.explode(F.sequence("low", "high")).alias("day"))
    return tracks.manifest_counts(manifests, days).withColumn("day", F.col("day").cast("string"))


def _by_dates(spark: SparkSession, path: str) -> tuple[str, str]:
    """Folders day=YYYY-MM-DD of a path become YYYY/MM/DD; the first and the last date."""
    folder = spark._jvm.org.apache.hadoop.fs.Path
    system = folder(path).getFileSystem(spark._jsc.hadoopConfiguration())
    days = sorted(name.removeprefix("day=") for name in (s.getPath().getName() for s in system.listStatus(folder(path))) if name.startswith("day="))
    for day in days:
        target = folder(f"{path}/{day.replace('-', '/')}")
        system.mkdirs(target.getParent())
        system.rename(folder(f"{path}/day={day}"), target)
    return days[0], days[-1]


def _grouped(events: DataFrame) -> DataFrame:
    """A row for each hundred events: their number, first and last time, and the day of the first."""
    rows = events.groupBy(F.expr(f"event_id div {_A_FILE}").alias("g")).agg(F.min("us").alias("low"), F.max("us").alias("high"), F.count("*").alias("n"))
    return rows.withColumn("day", times.utc_date(F.col("low")))


def _grouped_manifests(events: DataFrame, versions: int = 1) -> DataFrame:
    """Manifests of the groups of events, as rectangles over the meridian of 0; versions of each, the later ones of other shape."""
    rows = _grouped(events).withColumn("version", F.explode(F.sequence(F.lit(1), F.lit(versions))))
    x, y, high = F.col("g") % 9 - 4, F.col("g") * 2713 % 160 - 80, F.lit(4) + F.col("version")
    corners = F.concat_ws(" ", *[c.cast("string") for dy, dx in ((-1, -6), (-1, 6), (1, 6), (1, -6)) for c in (y + dy * high, x + dx)])
    time = lambda c: times.iso_text(F.timestamp_micros(c))
    text = F.concat(F.lit('<x xmlns:s="u"><s:startTime>'), time("low"), F.lit("</s:startTime><s:stopTime>"), time("high"), F.lit("</s:stopTime><s:posList>"), corners, F.lit("</s:posList></x>"))
    name = F.concat(F.lit("A_B_C_D_E_F_G_H_"), F.col("g").cast("string"), F.lit("_"), F.col("version").cast("string"), F.lit("_x.manifest"))
    return rows.select("g", "version", "day", name.alias("file_name"), text.alias("xml"))


def manifest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests in a tree of dates, one for every hundred events, read for a range that begins and ends with a missing day."""
    path = scratch_path(spark, "manifests")
    rows = _grouped_manifests(_events(spark, sf_dir))
    _write_singly(rows.select("day", F.col("xml").alias("value")), path)
    low, high = (dt.date.fromisoformat(d) for d in _by_dates(spark, path))
    manifests, days = files.read_manifests(spark, path, str(low - dt.timedelta(1)), str(high + dt.timedelta(1)), files="part-*")
    found, _ = tracks.read_manifest(manifests)
    out = days.join(found.select("day", "central_time", "central_lat"), "day", "left")
    return out.select(F.col("day").cast("string").alias("day"), "present", "central_time", F.round("central_lat", 6).alias("central_lat"))


def _write_tree(rows: DataFrame, root: str, between: str = "/") -> None:
    """Documents (day, file_name, xml) as files YYYY/MM/DD/<name>; between stands between the parts of the date."""
    place = F.concat(F.replace(F.col("day").cast("string"), F.lit("-"), F.lit(between)), F.lit("/"), "file_name")
    files.write_named_files(rows.select(place.alias("place"), F.col("xml").alias("value")), root)


def late_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints kept by day: a first run without the second versions of one group in seven, a second run once they have come. The rows of all days, and whether the second run computed their day."""
    path = scratch_path(spark, "late")
    rows = materialize(_grouped_manifests(_events(spark, sf_dir), 2), "documents")
    is_late = (F.col("version") == 2) & (F.col("g") % 7 == 0)
    low, high = map(str, rows.agg(F.min("day"), F.max("day")).first())
    _write_tree(rows.filter("version = 1"), f"{path}/root")
    refresh.refresh_footprints(spark, f"{path}/root", low, high, f"{path}/table")
    _write_tree(rows.filter(is_late), f"{path}/root")
    again = refresh.refresh_footprints(spark, f"{path}/root", low, high, f"{path}/table")
    found = refresh.kept_footprints(spark, f"{path}/table").withColumn("again", F.col("day").isin(again) if again else F.lit(False))
    return found.select(F.col("day").cast("string").alias("day"), "file_name", "central_time", F.round("central_lat", 6).alias("central_lat"), F.size("rings").alias("n_rings"), "polygon_file", "again")


def colocate_geojson_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints of several rings, a file for each, in two folders of <time>.geojson files, and all points."""
    events, path = _events(spark, sf_dir), scratch_path(spark, "exchange")
    rows = _grouped_manifests(events)
    for k, name in enumerate("ab"):
        manifests = rows.filter(F.col("g") % 2 == k).withColumn("path", F.concat(F.lit("/m/"), "file_name"))
        files.export_geojson(tracks.footprints(manifests, exact=True)[0], f"{path}/{name}")
    found, _ = files.read_footprints(spark, [f"{path}/a", f"{path}/b"])
    return colocate(points(events), found).drop("folder_no", "footprint_us")


def colocate_month_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and footprints as tables by month, of which a job for January reads its own folders."""
    events, path = _events(spark, sf_dir).withColumn("us", F.col("us") + _LATER), scratch_path(spark, "tables")
    place = points(events).withColumn("point_id", F.col("point_us"))
    tables.write_points_table(place, f"{path}/points")
    shapes = footprint_table(events)
    for name in "ab":
        some = shapes.filter(F.col("source_folder") == name)
        rings = some.select(F.timestamp_micros("footprint_us").alias("central_ts"), F.col("file_name").alias("polygon_file"), F.col("parts")[0]["rings"].alias("rings"))
        tables.write_footprints_table(rings, f"{path}/{name}")
    at = tables.read_points_table(spark, f"{path}/points", "2024-01")
    found = tables.read_footprints_table(spark, [f"{path}/a", f"{path}/b"], "2024-01", 4 * HOUR)
    return colocate(at, found).drop("point_id", "folder_no", "footprint_us")


def point_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as CSV, a third of them without latitude, with text for longitude or without time; what the reader rejects, equal rows counted."""
    path = scratch_path(spark, "points")
    way = F.col("event_id") % 9
    rows = _events(spark, sf_dir).select(
        F.when(way == 1, "").otherwise((F.col("event_id") % 90).cast("string")).alias("latitude"),
        F.when(way == 4, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise((F.col("event_id") % 180).cast("string")).alias("longitude"),
        F.when(way == 7, "").otherwise(times.millis_text(F.timestamp_micros("us"))).alias("timestamp"),
    )
    rows.write.option("header", True).option("emptyValue", "").csv(path)
    _, rejects = files.read_points(spark, path, mode="quarantine")
    return rejects.groupBy("latitude", "longitude", "timestamp").agg(F.count("*").alias("n"))


def catalogue_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose listing reaches a cap that a query can return: the mean of all days."""
    events = _events(spark, sf_dir)
    counts = events.groupBy(times.utc_date(F.col("us")).alias("chunk_start")).agg(F.count("*").alias("expected"))
    cap = counts.agg(F.floor(F.avg("expected"))).first()[0]
    return catalogue.over_cap(counts, cap).select(F.col("chunk_start").cast("string").alias("chunk_start"), "expected")


def chunk_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for a range of dates from each event, some backwards or with chunks of no days: its chunks, or why there are none."""
    day = times.utc_date(F.col("us"))
    requests = _events(spark, sf_dir).select("event_id", day.alias("start"), F.date_add(day, (F.col("event_id") % 12 - 2).cast("int")).alias("end"), (F.col("event_id") % 5).alias("days"))
    chunks, rejects = catalogue.chunk_requests(requests)
    found = chunks.groupBy("event_id").agg(F.count("*").alias("n"), F.max("chunk_start").cast("string").alias("last"), F.lit(None).cast("string").alias("reason"))
    return found.unionByName(rejects.select("event_id", F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("last"), "reason"))


def _chain_manifests(events: DataFrame) -> DataFrame:
    """Manifests east of the meridian of 0, with times in steps of ten minutes: many are equal, and their files get suffixes."""
    return _manifests(events, F.col("event_id") * 31337 % 160 + 10, F.col("us") - F.col("us") % 600_000_000)


def _chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[DataFrame]]:
    """Points and the footprints of two folders of manifests."""
    events = _events(spark, sf_dir)
    place = points(events.withColumn("us", F.col("us") - F.col("us") % 1000)).withColumn("file_name", F.lit("track")).withColumn("pos", F.col("point_us"))
    rows = events.filter("event_id % 5 = 1")
    return place, [tracks.footprints(_chain_manifests(rows.filter(f"event_id % 2 = {k}")))[0] for k in (0, 1)]


def _matches_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    place, folders = _chain(spark, sf_dir)
    path = scratch_path(spark, "chain")
    files.write_points(place, f"{path}/points")
    for name, found in zip("ab", folders):
        files.write_footprints(found, f"{path}/{name}")
    found, _ = files.read_footprints(spark, [f"{path}/b", f"{path}/a"], lines=True)
    return colocate(files.read_points(spark, f"{path}/points")[0], found)


def colocate_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From manifests to footprint files, from points to their file, and from both files to matches."""
    return _matches_of_files(spark, sf_dir).drop("point_id", "folder_no", "footprint_us")


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with their number in the order of files and lines."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return spark.read.csv(path, header=True, schema=schema).withColumn("place", place)


def matches_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches as they stand in the CSV files, with those of the same point numbered."""
    path = scratch_path(spark, "matches")
    files.write_matches(_matches_of_files(spark, sf_dir), path, "csv", ["lat", "lon", "point_time", "folder", "file", "footprint_time", "seconds"])
    rows = _lines(spark, path, "lat double, lon double, point_time string, folder string, file string, footprint_time string, seconds double, month string")
    nth = F.row_number().over(Window.partitionBy("point_time", "lat", "lon").orderBy("place"))
    earlier = F.coalesce(F.lag("point_time").over(Window.partitionBy("month", F.substring("point_time", 1, 10)).orderBy("place")) <= F.col("point_time"), F.lit(True))
    return rows.select("month", "point_time", "lat", "lon", nth.alias("nth"), "folder", "file", "footprint_time", "seconds", earlier.alias("in_order"))


def footprint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary as it stands in the CSV files, with the lines of the same day numbered."""
    path = scratch_path(spark, "summary")
    files.write_summary(tracks.footprints(_chain_manifests(_events(spark, sf_dir)))[0], path)
    rows = _lines(spark, path, "central_time string, central_lat double, central_lon double, filename string, polygon_file string")
    nth = F.row_number().over(Window.partitionBy(F.substring("central_time", 1, 10)).orderBy("place"))
    return rows.select("central_time", F.round("central_lat", 6).alias("central_lat"), F.round("central_lon", 6).alias("central_lon"), "filename", "polygon_file", nth.alias("nth"))


def circular_mean_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean longitudes of bands of latitude, on the side of the meridian of 180 degrees and on the other."""
    lon, lat = _point_place(F.col("event_id"))
    rows = _events(spark, sf_dir).select(lon.alias("longitude"), F.floor((lat + 90) / 7).cast("int").alias("band"))
    rows = rows.withColumn("far", (F.col("longitude") > 100) | (F.col("longitude") < -150))
    return rows.groupBy("band", "far").agg(F.round(geometry.circular_mean(F.col("longitude")), 6).alias("mean_lon"), F.count("*").alias("n"))


def latest_version_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.latest_versions(_manifests(_events(spark, sf_dir))).select(F.col("day").cast("string").alias("day"), "group_key", "version", "file_name", "path")


def _walks(events: DataFrame) -> DataFrame:
    """Tracks of users: vertices in order of events, with whole degrees."""
    return events.select(F.col("user_id").alias("ring_id"), F.col("event_id").alias("pos"), ((F.col("event_id") * 104729) % 179 - 89).cast("double").alias("lat"), ((F.col("event_id") * 7919) % 359 - 179).cast("double").alias("lon"))


def unwrap_longitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rings.unwrapped(_walks(_events(spark, sf_dir)), ["ring_id"])


def _ring_table(events: DataFrame) -> DataFrame:
    """Quadrilaterals of whole degrees up to 60 degrees wide, all over the globe; many cross a meridian."""
    x, y = (F.col("event_id") * 31337) % 357 - 178, (F.col("event_id") * 2713) % 120 - 60
    wide, high = (F.col("event_id") % 29 + 1), (F.col("event_id") % 13 + 1)
    lon = lambda a: F.when(a > 179, a - 360).when(a < -179, a + 360).otherwise(a).cast("double")
    corner = lambda a, b: F.struct(lon(x + a).alias("lon"), (y + b).cast("double").alias("lat"))
    ring = F.array(corner(-wide, -high), corner(wide, -high), corner(wide, high), corner(-wide, high))
    return events.select(F.col("event_id").alias("footprint_id"), F.array(ring).alias("rings"))


def normalise_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vertices(rings.normalise_rings(_ring_table(_events(spark, sf_dir))), "footprint_id", "straddles")


def split_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertices of all pieces of each ring, corners kept."""
    table = _ring_table(_events(spark, sf_dir)).select("footprint_id", F.col("rings")[0].alias("core"))
    found = rings.split_rings(table, ["footprint_id"], exact=True).select("footprint_id", F.col("segment").alias("ring_no"), F.posexplode("coords").alias("pos", "v"))
    return found.select("footprint_id", "ring_no", "pos", F.round("v.lon", 6).alias("lon"), F.round("v.lat", 6).alias("lat"))


def clean_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings with repeated and closing vertices and longitudes beyond 180 degrees, cleaned, opened, wrapped and closed again."""
    x, y = (F.col("event_id") * 31337 % 1080 - 540).cast("double"), (F.col("event_id") * 2713 % 120 - 60).cast("double")
    corner = lambda a, b: F.struct((x + a).alias("lon"), (y + b).alias("lat"))
    ring = F.array(corner(0, 0), corner(0, 0), corner(3, 0), corner(3, 0), corner(3, 0), corner(3, 2), corner(0, 0))
    core = F.transform(geometry.open_ring(geometry.drop_repeats(ring)), lambda v: F.struct(geometry.wrap_180(v["lon"]).alias("lon"), v["lat"].alias("lat")))
    rows = _events(spark, sf_dir).select("event_id", F.posexplode(geometry.close_ring(core)).alias("pos", "v"))
    return rows.select("event_id", "pos", "v.lon", "v.lat")


def _features(events: DataFrame) -> DataFrame:
    table = _shapes(events)
    text = geojson.feature_text(F.col("parts")[0]["rings"], times.iso_text(F.timestamp_micros("footprint_us")), F.col("file_name"))
    path = F.concat(F.lit("/f/"), F.col("source_folder"), F.lit("/"), times.safe_name(times.iso_text(F.timestamp_micros("footprint_us"))))
    return table.select(path.alias("path"), text.alias("value"), F.col("file_name").alias("id"))


def geojson_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(_events(spark, sf_dir))
    return rows.select("id", F.get_json_object("value", "$.geometry.type").alias("kind"), F.get_json_object("value", "$.geometry.coordinates[0][1][0]").cast("double").alias("lon1"), F.get_json_object("value", "$.properties.central_time").alias("central_time"))


def geojson_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = files.parse_footprints(_features(_events(spark, sf_dir)))
    ring = F.col("parts")[0]["rings"][0]
    return found.select("source_folder", "file_name", "footprint_us", F.size("parts").alias("n_parts"), F.size(ring).alias("n_vertices"), ring[0]["lon"].alias("lon0"), ring[0]["lat"].alias("lat0"))


def filename_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", times.safe_name(times.iso_text(F.timestamp_micros("us"))).alias("name"))
    return rows.select("event_id", "name", F.unix_micros(times.time_of_name(F.col("name"))).alias("us"))


def _ends(events: DataFrame) -> tuple[dt.date, dt.date]:
    day = times.utc_date(F.col("us"))
    return events.agg(F.min(day), F.max(day)).first()


def date_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    low, high = map(str, _ends(events))
    found = catalogue.date_chunks(spark, low, high, 3)
    start = F.to_date(F.lit(low))
    joined = events.select(F.date_add(start, (F.datediff(times.utc_date(F.col("us")), start) / 3).cast("int") * 3).alias("chunk_start")).join(found, "chunk_start")
    return joined.groupBy("chunk_start", "chunk_end", "label").agg(F.count("*").alias("n")).select(F.col("chunk_start").cast("string").alias("chunk_start"), F.col("chunk_end").cast("string").alias("chunk_end"), "label", "n")


def month_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months from two before the first event to one after the last, with their events."""
    events = _events(spark, sf_dir)
    low, high = _ends(events)
    n = (high.year - low.year) * 12 + high.month - low.month + 4
    start = low.year * 12 + low.month - 3
    counts = events.groupBy(F.substring(times.utc_date(F.col("us")).cast("string"), 1, 7).alias("month")).agg(F.count("*").alias("n"))
    return catalogue.months(spark, start // 12, start % 12 + 1, n).join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def _listing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A listing of all events, a chunk for each day whatever its size (it is no answer that a server could have cut), and the third of it that is there."""
    events = _events(spark, sf_dir)
    raw = events.select(
        F.when(F.col("event_id") % 10 == 3, " ").otherwise(F.concat(F.lit(" D"), F.col("event_id").cast("string"))).alias("dipFilename"),
        F.lit("u").alias("productURI"),
        F.when(F.col("event_id") % 7 == 0, "").otherwise(times.iso_text(F.timestamp_micros("us"))).alias("beginAcquisition"),
        times.utc_date(F.col("us")).alias("chunk_start"),
    )
    listing = catalogue.with_targets(catalogue.clean_listing(raw), "http://host/meta", "out")
    return listing, listing.filter("substring(dip_filename, 2) % 3 = 0").select("target_path")


def catalogue_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing, _ = catalogue.reconcile(*_listing(spark, sf_dir), cap=None)
    return missing.select("target_path", "metadata_url")


def catalogue_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, summary = catalogue.reconcile(*_listing(spark, sf_dir), cap=None)
    return summary.withColumn("chunk_start", F.col("chunk_start").cast("string"))


def catalogue_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of each day as TSV files, a granule for every hundred events; files on disk, of which an inventory is kept; what the catalogue expects.

    What is missing per day, with two days that list nothing, and whether the second update of the
    inventory, after files of every fourth day had come, listed the day.
    """
    path, events = scratch_path(spark, "catalogue"), _events(spark, sf_dir)
    first = _grouped(events).withColumnRenamed("day", "chunk_start")
    name = F.concat(F.lit(" D"), F.col("g").cast("string"))
    raw = first.select(name.alias("dipFilename"), F.lit("u").alias("productURI"), times.iso_text(F.timestamp_micros("low")).alias("beginAcquisition"), "chunk_start")
    raw.write.partitionBy("chunk_start").option("sep", "\t").option("header", True).csv(f"{path}/listing")
    listing = catalogue.with_targets(files.read_catalogue(spark, f"{path}/listing"), "http://host/meta", f"{path}/out")
    stored = first.filter("g % 3 = 0").select(F.col("chunk_start").alias("day"), F.concat(F.lit("D"), F.col("g").cast("string"), F.lit("_MD.XML")).alias("file_name"), F.lit("x").alias("xml"))
    late = F.datediff("day", F.lit("2024-01-01").cast("date")) % 4 == 0
    _write_tree(stored.filter(~late), f"{path}/out", "-")
    inventory.update_inventory(spark, f"{path}/out", f"{path}/inventory", settle_ms=0)
    _write_tree(stored.filter(late), f"{path}/out", "-")
    again = inventory.update_inventory(spark, f"{path}/out", f"{path}/inventory", settle_ms=0)
    low, high = _ends(events)
    chunks = catalogue.date_chunks(spark, str(low - dt.timedelta(1)), str(high + dt.timedelta(1)))
    expected = first.groupBy("chunk_start").agg((F.count("*") + 1).alias("expected"))
    chunks = chunks.join(expected, "chunk_start", "left").fillna(0, ["expected"])
    _, summary = catalogue.reconcile(listing, inventory.kept_inventory(spark, f"{path}/out", f"{path}/inventory"), chunks, cap=None)
    day = F.col("chunk_start").cast("string")
    return summary.withColumn("chunk_start", day).withColumn("listed_again", day.isin(again) if again else F.lit(False))


QUERIES = {
    f.__name__: f
    for f in (
        colocate_interval_pip, colocate_wide, colocate_month, colocate_multi_folder, colocate_shapes, colocate_from_files, matches_in_order, geojson_rejects, points_from_xml, granule_files, granule_rejects,
        granules_kept, footprint_midpoint_centre, footprints_job, footprint_summary, manifest_days, manifest_tree, circular_mean_by_group, latest_version_per_group, unwrap_longitudes, split_rings,
        normalise_rings, clean_rings, geojson_export, geojson_flatten, filename_time, date_chunks, month_keys, catalogue_missing, catalogue_reconcile, catalogue_job,
        colocate_month_tables, colocate_geojson_folder, late_manifests, point_rejects, catalogue_capped, chunk_requests,
    )
}

_POINTS = "SELECT event_id AS pid, epoch_us(ts) AS pt_us, ((event_id * 7919) % 3600) * 0.1e0 - 180 AS lon, ((event_id * 104729) % 1800) * 0.1e0 - 90 AS lat FROM events WHERE event_id % 2 = 0"
_SHAPES = "SELECT event_id AS fid, epoch_us(ts) AS fp_us, ((event_id * 31337) % 3400) * 0.1e0 - 170 AS cx, ((event_id * 2713) % 1600) * 0.1e0 - 80 AS cy FROM events WHERE event_id % 5 = 1"


def _near(scale: int = 1, shapes: str = _SHAPES, points: str = _POINTS) -> str:
    """Tables p, f and n (pid, fid): the pairs that meet in time and place, of shapes (fid, fp_us, cx, cy) with the usual corners."""
    ends = list(zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1]))
    edge = ", ".join(f"{{'x1': cx + ({scale * a}), 'y1': cy + ({scale * b}), 'x2': cx + ({scale * c}), 'y2': cy + ({scale * d})}}" for (a, b), (c, d) in ends)
    return f"""
        p AS ({points}), f0 AS ({shapes}), f AS (SELECT *, [{edge}] AS edges FROM f0),
        c AS (SELECT pid, lon, lat, fid, unnest(edges) AS e FROM p JOIN f ON fp_us BETWEEN pt_us - 14400000000 AND pt_us + 14400000000
              AND lon BETWEEN cx - {8 * scale} - 1e-8 AND cx + {7 * scale} + 1e-8 AND lat BETWEEN cy - {7 * scale} - 1e-8 AND cy + {6 * scale} + 1e-8),
        t AS (SELECT *, (e.y1 > lat) <> (e.y2 > lat) AS crosses, (e.x2 - e.x1) * (lat - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1 AS hit FROM c),
        g AS (SELECT pid, fid,
              bool_or((lon BETWEEN least(e.x1, e.x2) - 1e-9 AND greatest(e.x1, e.x2) + 1e-9 AND lat BETWEEN least(e.y1, e.y2) - 1e-9 AND greatest(e.y1, e.y2) + 1e-9
                       AND abs((e.x2 - e.x1) * (lat - e.y1) - (lon - e.x1) * (e.y2 - e.y1)) <= 1e-9) OR (crosses AND abs(hit - lon) <= 1e-9)) AS edge,
              count(*) FILTER (WHERE crosses AND lon < hit) % 2 = 1 AS odd FROM t GROUP BY pid, fid),
        n AS (SELECT pid, fid FROM g WHERE edge OR odd)"""


_TIME = "CASE WHEN ({0}) % 1000000 = 0 THEN strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%S.%fZ') END"
_OFFSET = _TIME.replace("SZ'", "S+00:00'").replace("fZ'", "f+00:00'")
_MILLIS = "strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_FOLDER_OF = "CASE WHEN {0} % 2 = 0 THEN 'a' ELSE 'b' END"
_MATCH = f"""
    , m AS (SELECT lat AS latitude, lon AS longitude, {_MILLIS.format("pt_us")} AS point_timestamp, {_FOLDER_OF.format("fid")} AS source_folder, fid || '.geojson' AS geojson_filename,
            {_OFFSET.format("fp_us")} AS footprint_timestamp, (fp_us - pt_us) / 1e6 AS time_diff_seconds, pt_us FROM n JOIN p USING (pid) JOIN f0 USING (fid))"""
_ALL = " SELECT * EXCLUDE (pt_us) FROM m"
_MANIFEST = "SELECT *, epoch_us(ts) AS us, 'A_B_C_D_E_F_G_H_' || (event_id % 997) AS group_key, lpad((event_id * 7919 % 100000)::VARCHAR, 5, '0') AS version, '/m/' || event_id AS path, ts::DATE AS day FROM events"
_NAMED = "group_key || '_' || version || '_x.manifest'"
_LATEST = f"SELECT *, {_NAMED} AS file_name FROM ({_MANIFEST}) QUALIFY row_number() OVER (PARTITION BY day, group_key ORDER BY version DESC, path) = 1"
_HALF = "{0} + {1} // 2 + CASE WHEN {1} % 2 = 1 AND ({1} // 2) % 2 = 1 THEN 1 ELSE 0 END"
_SAFE = "regexp_replace({0}, '[^0-9A-Za-z]', '', 'g')"
_MANIFEST_RING = "unnest([" + ", ".join(f"{{'i': {i}, 'x': (event_id * 31337) % 340 - 170 + ({a}), 'y': (event_id * 2713) % 160 - 80 + ({b})}}" for i, (a, b) in enumerate(_CORNERS)) + "])"
_GROUPS = f"SELECT event_id // {_A_FILE} AS g, epoch_us(min(ts)) AS low, epoch_us(max(ts)) AS high, min(ts)::DATE AS day, count(*) AS n FROM events GROUP BY 1"
_LISTING = """
    WITH l AS (SELECT 'D' || event_id AS dip, event_id, ts::DATE AS chunk_start FROM events WHERE event_id % 10 <> 3),
    t AS (SELECT *, 'out/' || chunk_start || '/' || dip || '_MD.XML' AS target_path FROM l)"""
# Footprints of the chain of files: the latest versions of each folder, times in steps of ten minutes.
_CHAIN = f"""
    e AS ({_MANIFEST} WHERE event_id % 5 = 1),
    v AS (SELECT *, {_NAMED} AS file_name, us - us % 600000000 AS start_us, (event_id % 11) * 1000001 AS d FROM e QUALIFY row_number() OVER (PARTITION BY event_id % 2, day, group_key ORDER BY version DESC, path) = 1),
    w AS (SELECT *, {_HALF.format("start_us", "d")} AS mid FROM v),
    s AS (SELECT event_id AS fid, mid AS fp_us, ((event_id * 31337) % 160 + 10)::DOUBLE AS cx, ((event_id * 2713) % 160 - 80)::DOUBLE AS cy, file_name, day, {_FOLDER_OF.format("event_id")} AS folder, {_TIME.format("mid")} AS central_time,
          row_number() OVER (PARTITION BY event_id % 2, mid ORDER BY file_name, path) - 1 AS k FROM w),
    z AS (SELECT *, {_SAFE.format("central_time")} || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.geojson' AS polygon_file FROM s)"""
# The same of all events, in one folder.
_CHAIN_ALL = _CHAIN.replace(" WHERE event_id % 5 = 1", "").replace("event_id % 2, ", "")
_CHAIN_MATCH = f"WITH {_CHAIN}, {_near(1, 'SELECT fid, fp_us, cx, cy FROM z', _POINTS.replace('epoch_us(ts)', 'epoch_us(ts) - epoch_us(ts) % 1000'))}"


def _box(cx: str, w: str = "6", h: str = "5") -> str:
    return f"(abs(lon - ({cx})) <= {w} + 1e-9 AND abs(lat - cy) <= {h} + 1e-9)"


_SAME = "(lon BETWEEN px - 1e-9 AND px + 1e-9 AND lat BETWEEN py - 1e-9 AND py + 1e-9)"
_WITHIN = f"""CASE (fid // 5) % 9
    WHEN 0 THEN {_box("cx")} WHEN 1 THEN {_box("cx")} AND NOT {_box("cx", "3", "2")} AND NOT {_box("cx + 5", "0.5", "1")} WHEN 2 THEN {_box("cx")} OR {_box("cx + 6")}
    WHEN 3 THEN {_SAME} WHEN 4 THEN {_SAME} OR (abs(lon - cx) <= 1e-9 AND abs(lat - cy) <= 1e-9) WHEN 5 THEN {_box("cx")} WHEN 7 THEN {_box("cx")} OR {_box("cx - 6")} ELSE false END"""
# Rectangles cut at one meridian at most: a, b are unwrapped, m is the meridian between them. Rings lose the corner at their closing edge.
_RECTANGLES = """
    r AS (SELECT event_id AS footprint_id, (event_id * 31337) % 357 - 178 - (event_id % 29 + 1) AS a0, 2 * (event_id % 29 + 1) AS w, (event_id * 2713) % 120 - 60 - (event_id % 13 + 1) AS s, (event_id * 2713) % 120 - 60 + (event_id % 13 + 1) AS n FROM events),
    q AS (SELECT *, CASE WHEN a0 < -179 THEN a0 + 360 ELSE a0 END AS a FROM r),
    u AS (SELECT *, a + w AS b, CASE WHEN a < 0 AND a + w > 0 THEN 0 WHEN a < 180 AND a + w > 180 THEN 180 END AS m FROM q),
    l AS (SELECT *, CASE WHEN m = 180 OR b > 180 THEN -180 ELSE m END AS east_m, CASE WHEN b > 180 THEN b - 360 ELSE b END AS b1, CASE WHEN a >= 180 THEN a - 360 ELSE a END AS a1 FROM u)"""
_VERTEX = "SELECT {0}, g.ring_no, g.i AS pos, g.v.x::DOUBLE AS lon, g.v.y::DOUBLE AS lat FROM (SELECT *, unnest([{1}]) AS h FROM {2}) x, LATERAL (SELECT h.r AS ring_no, unnest(range(0, len(h.v))) AS i, unnest(h.v) AS v) g"


def _ring_of(number: int, *vertices: tuple[str, str]) -> str:
    return f"{{'r': {number}, 'v': [" + ", ".join(f"{{'x': ({x})::DOUBLE, 'y': ({y})::DOUBLE}}" for x, y in vertices) + "]}"


_WHOLE = _ring_of(0, ("a1", "s"), ("b1", "s"), ("b1", "n"), ("a1", "n"), ("a1", "s"))
_WEST = _ring_of(0, ("m", "n"), ("a", "n"), ("m", "s"), ("m", "n"))
_EAST = _ring_of(1, ("east_m", "s"), ("b1", "s"), ("b1", "n"), ("east_m", "n"), ("east_m", "s"))
# The general way, for rings that cross the meridian of 0 only, with non-zero counts of vertices on it: pieces between crossings, islands of one hemisphere, first and last joined.
_PIECES = f"""
    m AS ({_LATEST}), v AS (SELECT path, us, event_id, file_name, (event_id % 11) * 1000001 AS d, {_MANIFEST_RING} AS v FROM m),
    v1 AS (SELECT path, v.i AS i, v.x::DOUBLE AS x, v.y::DOUBLE AS y FROM v),
    e AS (SELECT a.*, b.x AS x2, b.y AS y2 FROM v1 a JOIN v1 b ON a.path = b.path AND b.i = (a.i + 1) % 4),
    x AS (SELECT *, (x < 0 AND x2 > 0 OR x > 0 AND x2 < 0) AS cut, y + (0 - x) / nullif(x2 - x, 0) * (y2 - y) AS yc FROM e),
    k AS (SELECT *, count(*) FILTER (WHERE cut) OVER (PARTITION BY path ORDER BY i ROWS UNBOUNDED PRECEDING) AS after FROM x),
    o AS (SELECT path, after - cut::INT AS seg, i * 3 AS o, x, y FROM k UNION ALL SELECT path, after - 1, i * 3 + 1, 0, yc FROM k WHERE cut UNION ALL SELECT path, after, i * 3 + 2, 0, yc FROM k WHERE cut),
    pz AS (SELECT path, seg, CASE WHEN bool_or(x > 0) AND NOT bool_or(x < 0) THEN 1 WHEN bool_or(x < 0) AND NOT bool_or(x > 0) THEN -1 ELSE 0 END AS zone, count(*) AS n FROM o GROUP BY path, seg HAVING count(*) >= 2),
    known AS (SELECT *, last_value(CASE WHEN zone <> 0 THEN zone END IGNORE NULLS) OVER (PARTITION BY path ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier, row_number() OVER (PARTITION BY path ORDER BY seg) AS nth FROM pz),
    isl AS (SELECT *, count(*) FILTER (WHERE zone <> 0 AND zone <> earlier) OVER (PARTITION BY path ORDER BY seg ROWS UNBOUNDED PRECEDING) AS island FROM known),
    iz AS (SELECT path, island, max(zone) + min(zone) AS zs, bool_or(zone <> 0) AS has, max(abs(zone)) * CASE WHEN max(zone) > 0 THEN 1 ELSE -1 END AS zone FROM isl GROUP BY path, island),
    ends AS (SELECT path, max(island) AS top, arg_min(zone, island) AS z0, arg_max(zone, island) AS z1 FROM iz GROUP BY path),
    -- The last island goes before the first, whose first vertex it replaces, if they meet in one hemisphere.
    rows1 AS (SELECT o.path, isl.island, o.seg, o.o, o.x, o.y, row_number() OVER (PARTITION BY o.path, o.seg ORDER BY o.o) AS within, min(o.seg) OVER (PARTITION BY o.path, isl.island) AS lead_seg, top, top > 0 AND (z0 = z1 OR z0 = 0 OR z1 = 0) AS meets FROM o JOIN isl USING (path, seg) JOIN ends USING (path)),
    rows2 AS (SELECT path, CASE WHEN meets AND island = top THEN 0 ELSE island END AS ring, CASE WHEN meets AND island = top THEN 0 ELSE 1 END AS part, seg, o, x, y FROM rows1 WHERE within > 1 OR (seg = lead_seg AND NOT (meets AND island = 0))),
    rows3 AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM rows2 WINDOW w AS (PARTITION BY path, ring ORDER BY part, seg, o)),
    rows4 AS (SELECT path, ring, part, seg, o, x, y FROM rows3 WHERE px IS NULL OR px <> x OR py <> y),
    big AS (SELECT path, ring, dense_rank() OVER (PARTITION BY path ORDER BY ring) - 1 AS ring_no FROM rows4 GROUP BY path, ring HAVING count(*) >= 3),
    rows5 AS (SELECT path, ring_no, row_number() OVER (PARTITION BY path, ring_no ORDER BY part, seg, o) - 1 AS pos, x, y FROM rows4 JOIN big USING (path, ring)),
    closed AS (SELECT path, ring_no, pos, x, y FROM rows5 UNION ALL SELECT path, ring_no, n, x0, y0 FROM (SELECT path, ring_no, count(*) AS n, arg_min(x, pos) AS x0, arg_min(y, pos) AS y0, arg_max(x, pos) AS x1, arg_max(y, pos) AS y1 FROM rows5 GROUP BY path, ring_no) WHERE x0 <> x1 OR y0 <> y1),
    ft AS (SELECT path, file_name, {_HALF.format("us", "((event_id % 11) * 1000001)")} AS mid FROM m),
    fn AS (SELECT *, {_TIME.format("mid")} AS central_time, row_number() OVER (PARTITION BY mid ORDER BY file_name, path) - 1 AS k FROM ft)"""

ORACLES = {
    "colocate_interval_pip": f"WITH {_near()}{_MATCH}{_ALL}",
    "colocate_wide": f"WITH {_near(3)}{_MATCH}{_ALL}",
    "colocate_month": f"WITH {_near(1, _SHAPES.replace('epoch_us(ts)', f'epoch_us(ts) + {_LATER}'), _POINTS.replace('epoch_us(ts)', f'epoch_us(ts) + {_LATER}'))}{_MATCH}{_ALL} WHERE make_timestamp(pt_us) < TIMESTAMP '2024-02-01'",
    "colocate_multi_folder": f"WITH {_near()}{_MATCH} SELECT source_folder, count(*) AS matches, min(time_diff_seconds) AS least, max(time_diff_seconds) AS most FROM m GROUP BY source_folder",
    "colocate_shapes": f"""
        WITH p AS ({_POINTS}), s AS ({_SHAPES}),
        f AS (SELECT *, (((fid + fid % 2) * 7919) % 3600) * 0.1e0 - 180 AS px, (((fid + fid % 2) * 104729) % 1800) * 0.1e0 - 90 AS py FROM s)
        SELECT lon AS longitude, lat AS latitude, {_FOLDER_OF.format("fid")} AS source_folder, {_SAFE.format(_TIME.format("fp_us"))} || '_' || fid || '.geojson' AS geojson_filename, (fp_us - pt_us) / 1e6 AS time_diff_seconds
        FROM p JOIN f ON fp_us BETWEEN pt_us - 14400000000 AND pt_us + 14400000000 AND {_WITHIN}""",
    "colocate_from_files": _CHAIN_MATCH + f"""
        SELECT lat AS latitude, lon AS longitude, {_MILLIS.format("pt_us")} AS point_timestamp, folder AS source_folder, polygon_file AS geojson_filename, {_OFFSET.format("z.fp_us")} AS footprint_timestamp, (z.fp_us - pt_us) / 1e6 AS time_diff_seconds
        FROM n JOIN p USING (pid) JOIN z USING (fid)""",
    "matches_in_order": _CHAIN_MATCH + f"""
        SELECT strftime(make_timestamp(pt_us), '%Y-%m') AS month, {_MILLIS.format("pt_us")} AS point_time, lat, lon, row_number() OVER (PARTITION BY pt_us, lat, lon ORDER BY z.fp_us, folder DESC, polygon_file)::INTEGER AS nth,
               folder, polygon_file AS file, {_OFFSET.format("z.fp_us")} AS footprint_time, (z.fp_us - pt_us) / 1e6 AS seconds, true AS in_order FROM n JOIN p USING (pid) JOIN z USING (fid)""",
    "footprint_summary": f"""
        WITH {_CHAIN_ALL}, c AS (SELECT fid, unnest([{", ".join(f"{{'x': cx + ({a}), 'y': cy + ({b})}}" for a, b in _CORNERS)}]) AS v FROM z),
        g AS (SELECT fid, avg(v.y) AS lat, degrees(atan2(sum(sin(radians(v.x))), sum(cos(radians(v.x))))) AS lon FROM c GROUP BY fid)
        SELECT central_time, round(lat, 6) AS central_lat, round(lon, 6) AS central_lon, file_name AS filename, polygon_file, row_number() OVER (PARTITION BY central_time[:10] ORDER BY central_time, day, file_name)::INTEGER AS nth
        FROM z JOIN g USING (fid)""",
    "geojson_rejects": f"""
        SELECT '/f/' || folder || '/' || name AS path, folder AS source_folder, name AS file_name, 'malformed JSON' AS reason
        FROM (SELECT {_FOLDER_OF.format("event_id")} AS folder, {_SAFE.format(_TIME.format("epoch_us(ts)"))} || '_' || event_id || '.geojson' AS name FROM events WHERE (event_id // 5) % 9 = 8)""",
    "points_from_xml": f"""
        WITH e AS (SELECT event_id, epoch_us(ts) AS us, event_id % 5 + 1 AS n, (event_id % 7 + 1) * 1000001 AS d FROM events),
        s AS (SELECT *, CASE WHEN n = 1 THEN 0 ELSE d // (n - 1) + CASE WHEN 2 * (d % (n - 1)) > n - 1 OR (2 * (d % (n - 1)) = n - 1 AND (d // (n - 1)) % 2 = 1) THEN 1 ELSE 0 END END AS step FROM e),
        p AS (SELECT *, unnest(range(0, n)) AS pos FROM s)
        SELECT event_id::VARCHAR AS file_name, pos::INTEGER AS pos, ((event_id * 7 + pos * 3) % 90)::DOUBLE AS latitude, ((event_id * 11 + pos * 5) % 180)::DOUBLE AS longitude, {_MILLIS.format("us + step * pos")} AS timestamp FROM p""",
    "granule_files": f"""
        WITH e AS (SELECT event_id, event_id // {_A_FILE} AS g, epoch_us(ts) AS us FROM events),
        s AS (SELECT g, min(us) AS low, max(us) - min(us) AS d, count(*) AS n FROM e GROUP BY g),
        t AS (SELECT *, CASE WHEN n = 1 THEN 0 ELSE d // (n - 1) + CASE WHEN 2 * (d % (n - 1)) > n - 1 OR (2 * (d % (n - 1)) = n - 1 AND (d // (n - 1)) % 2 = 1) THEN 1 ELSE 0 END END AS step FROM s),
        p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY event_id) - 1 AS pos FROM e JOIN t USING (g))
        SELECT 'day=' || strftime(make_timestamp(low), '%Y-%m-%d') AS granule_group, pos::INTEGER AS pos, (event_id * 7 % 90)::DOUBLE AS latitude, (event_id * 11 % 180)::DOUBLE AS longitude, {_MILLIS.format("low + step * pos")} AS timestamp FROM p""",
    "granule_rejects": """
        SELECT event_id::VARCHAR AS file_name, CASE event_id % 10 WHEN 1 THEN 'malformed XML' WHEN 3 THEN 'malformed XML' WHEN 5 THEN 'no begin time' WHEN 7 THEN 'positions are missing or not pairs of numbers' ELSE 'no end time' END AS reason
        FROM events WHERE event_id % 2 = 1""",
    "granules_kept": f"""
        WITH e AS (SELECT event_id, epoch_us(ts) AS us, event_id % 5 + 1 AS n, (event_id % 7 + 1) * 1000001 AS d FROM events WHERE event_id % 2 = 0),
        s AS (SELECT *, CASE WHEN n = 1 THEN 0 ELSE d // (n - 1) + CASE WHEN 2 * (d % (n - 1)) > n - 1 OR (2 * (d % (n - 1)) = n - 1 AND (d // (n - 1)) % 2 = 1) THEN 1 ELSE 0 END END AS step FROM e)
        SELECT event_id::VARCHAR AS file_name, n, {_MILLIS.format("us + step * (n - 1)")} AS last FROM s""",
    "footprint_midpoint_centre": f"""
        WITH m AS ({_MANIFEST}), v AS (SELECT path, us, (event_id % 11) * 1000001 AS d, {_MANIFEST_RING} AS v FROM m),
        g AS (SELECT path, us, d, avg(v.y::DOUBLE) AS lat, degrees(atan2(sum(sin(radians(v.x))), sum(cos(radians(v.x))))) AS lon FROM v GROUP BY ALL),
        t AS (SELECT *, {_HALF.format("us", "d")} AS mid FROM g)
        SELECT path, {_TIME.format("mid")} AS central_time, round(lat, 6) AS central_lat, round(CASE WHEN lon <= -180 THEN lon + 360 ELSE lon END, 6) AS central_lon FROM t""",
    "footprints_job": f"""
        WITH {_PIECES}, zero AS (SELECT path, bool_or(NOT has) AS z FROM iz GROUP BY path)
        SELECT path, central_time, {_SAFE.format("central_time")} || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.geojson' AS polygon_file, coalesce(z, false) AS straddles, ring_no::INTEGER AS ring_no, pos::INTEGER AS pos, round(x, 6) AS lon, round(y, 6) AS lat
        FROM closed JOIN fn USING (path) LEFT JOIN zero USING (path)""",
    "manifest_days": f"""
        WITH d AS (SELECT unnest(generate_series(min(ts::DATE) - INTERVAL 1 DAY, max(ts::DATE) + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM events),
        a AS (SELECT day, count(*) AS manifests FROM ({_MANIFEST}) GROUP BY day), b AS (SELECT day, count(*) AS selected FROM ({_LATEST}) GROUP BY day)
        SELECT day::VARCHAR AS day, coalesce(manifests, 0) AS manifests, coalesce(selected, 0) AS selected FROM d LEFT JOIN a USING (day) LEFT JOIN b USING (day)""",
    "manifest_tree": f"""
        WITH e AS ({_GROUPS}), t AS (SELECT day, {_HALF.format("low", "(high - low)")} AS mid, (g * 2713) % 160 - 80 AS lat FROM e),
        d AS (SELECT unnest(generate_series((SELECT min(day) FROM e) - INTERVAL 1 DAY, (SELECT max(day) FROM e) + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day)
        SELECT day::VARCHAR AS day, mid IS NOT NULL AS present, CASE WHEN mid IS NOT NULL THEN {_TIME.format("mid")} END AS central_time, round(lat, 6)::DOUBLE AS central_lat FROM d LEFT JOIN t USING (day)""",
    "late_manifests": f"""
        WITH e AS ({_GROUPS}), v AS (SELECT *, CASE WHEN g % 7 = 0 THEN 2 ELSE 1 END AS version, {_HALF.format("low", "(high - low)")} AS mid FROM e),
        n AS (SELECT *, 'A_B_C_D_E_F_G_H_' || g || '_' || version || '_x.manifest' AS file_name, {_TIME.format("mid")} AS central_time FROM v),
        k AS (SELECT *, row_number() OVER (PARTITION BY mid ORDER BY file_name) - 1 AS k, bool_or(version = 2) OVER (PARTITION BY day) AS again FROM n)
        SELECT day::VARCHAR AS day, file_name, central_time, ((g * 2713) % 160 - 80)::DOUBLE AS central_lat, 2 AS n_rings, {_SAFE.format("central_time")} || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.geojson' AS polygon_file, again FROM k""",
    "colocate_geojson_folder": f"""
        WITH p AS ({_POINTS}), e AS ({_GROUPS}), f AS (SELECT *, {_HALF.format("low", "(high - low)")} AS fp_us, g % 9 - 4 AS cx, (g * 2713) % 160 - 80 AS cy, 'A_B_C_D_E_F_G_H_' || g || '_1_x.manifest' AS manifest FROM e),
        n AS (SELECT *, {_TIME.format("fp_us")} AS central_time, row_number() OVER (PARTITION BY g % 2, fp_us ORDER BY manifest) - 1 AS k FROM f)
        SELECT lat AS latitude, lon AS longitude, {_MILLIS.format("pt_us")} AS point_timestamp, {_FOLDER_OF.format("g")} AS source_folder, {_SAFE.format("central_time")} || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.geojson' AS geojson_filename,
               {_OFFSET.format("fp_us")} AS footprint_timestamp, (fp_us - pt_us) / 1e6 AS time_diff_seconds
        FROM p JOIN n ON fp_us BETWEEN pt_us - 14400000000 AND pt_us + 14400000000 AND abs(lon - cx) <= 6 + 1e-9 AND abs(lat - cy) <= 5 + 1e-9""",
    "point_rejects": f"""
        SELECT latitude, longitude, "timestamp", count(*) AS n FROM (
            SELECT CASE WHEN event_id % 9 <> 1 THEN (event_id % 90)::VARCHAR END AS latitude, CASE WHEN event_id % 9 = 4 THEN 'x' || event_id ELSE (event_id % 180)::VARCHAR END AS longitude,
                   CASE WHEN event_id % 9 <> 7 THEN {_MILLIS.format("epoch_us(ts)")} END AS "timestamp" FROM events WHERE event_id % 9 IN (1, 4, 7)) GROUP BY ALL""",
    "catalogue_capped": """
        WITH c AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1)
        SELECT day::VARCHAR AS chunk_start, n AS expected FROM c WHERE n >= (SELECT floor(avg(n)) FROM c)""",
    "chunk_requests": """
        WITH r AS (SELECT event_id, ts::DATE AS a, (event_id % 12 - 2)::INTEGER AS more, (event_id % 5)::INTEGER AS days FROM events),
        s AS (SELECT *, CASE WHEN more < 0 THEN 'start after end' WHEN days < 1 THEN 'days below 1' END AS reason FROM r)
        SELECT event_id, CASE WHEN reason IS NULL THEN more // days + 1 ELSE 0 END::BIGINT AS n, CASE WHEN reason IS NULL THEN (a + (more // days) * days)::VARCHAR END AS last, reason FROM s""",
    "circular_mean_by_group": """
        WITH p AS (SELECT ((event_id * 7919) % 3600) * 0.1e0 - 180 AS lon, ((event_id * 104729) % 1800) * 0.1e0 - 90 AS lat FROM events),
        g AS (SELECT floor((lat + 90) / 7)::INTEGER AS band, lon > 100 OR lon < -150 AS far, degrees(atan2(sum(sin(radians(lon))), sum(cos(radians(lon))))) AS m, count(*) AS n FROM p GROUP BY 1, 2)
        SELECT band, far, round(CASE WHEN m <= -180 THEN m + 360 ELSE m END, 6) AS mean_lon, n FROM g""",
    "latest_version_per_group": f"SELECT day::VARCHAR AS day, group_key, version, file_name, path FROM ({_LATEST})",
    "unwrap_longitudes": """
        WITH v AS (SELECT user_id AS ring_id, event_id AS pos, ((event_id * 104729) % 179 - 89)::DOUBLE AS lat, ((event_id * 7919) % 359 - 179)::DOUBLE AS lon FROM events),
        j AS (SELECT *, lon - lag(lon) OVER (PARTITION BY ring_id ORDER BY pos) AS d FROM v)
        SELECT ring_id, pos, lat, lon, lon + sum(CASE WHEN d > 180 THEN -360 WHEN d < -180 THEN 360 ELSE 0 END) OVER (PARTITION BY ring_id ORDER BY pos) AS ulon FROM j""",
    "split_rings": f"WITH {_RECTANGLES}, c AS (SELECT * FROM l WHERE m IS NOT NULL), o AS (SELECT * FROM l WHERE m IS NULL) "
    + _VERTEX.format("footprint_id", ", ".join((_ring_of(0, ("a", "s"), ("m", "s")), _ring_of(1, ("east_m", "s"), ("b1", "s"), ("b1", "n"), ("m", "n")), _ring_of(2, ("east_m", "n"), ("a", "n"), ("a", "s")))), "c")
    + " UNION ALL " + _VERTEX.format("footprint_id", _ring_of(0, ("CASE WHEN a = 180 THEN 180 ELSE a1 END", "s"), ("b1", "s"), ("b1", "n"), ("CASE WHEN a = 180 THEN 180 ELSE a1 END", "n"), ("CASE WHEN a = 180 THEN 180 ELSE a1 END", "s")), "o"),
    "normalise_rings": f"WITH {_RECTANGLES}, c AS (SELECT * FROM l WHERE m IS NOT NULL), o AS (SELECT * FROM l WHERE m IS NULL) "
    + _VERTEX.format("footprint_id, false AS straddles", f"{_WEST}, {_EAST}", "c") + " UNION ALL " + _VERTEX.format("footprint_id, false AS straddles", _WHOLE, "o"),
    "clean_rings": """
        WITH r AS (SELECT event_id, (event_id * 31337) % 1080 - 540 AS x, (event_id * 2713) % 120 - 60 AS y FROM events),
        v AS (SELECT event_id, unnest([{'p': 0, 'x': x, 'y': y}, {'p': 1, 'x': x + 3, 'y': y}, {'p': 2, 'x': x + 3, 'y': y + 2}, {'p': 3, 'x': x, 'y': y}]) AS v FROM r),
        w AS (SELECT event_id, v.p AS pos, v.x AS x, v.y AS lat, ((v.x + 180) % 360 + 360) % 360 - 180 AS lon FROM v)
        SELECT event_id, pos::INTEGER AS pos, (CASE WHEN lon = -180 AND x > 0 THEN 180 ELSE lon END)::DOUBLE AS lon, lat::DOUBLE AS lat FROM w""",
    "geojson_export": f"SELECT event_id || '.geojson' AS id, 'Polygon' AS kind, ((event_id * 31337) % 3400) * 0.1e0 - 170 + 7 AS lon1, {_TIME.format('epoch_us(ts)')} AS central_time FROM events",
    "geojson_flatten": f"""
        SELECT {_FOLDER_OF.format("event_id")} AS source_folder, {_SAFE.format(_TIME.format("epoch_us(ts)"))} || '.geojson' AS file_name,
               epoch_us(ts) AS footprint_us, 1 AS n_parts, 5 AS n_vertices, ((event_id * 31337) % 3400) * 0.1e0 - 170 - 6 AS lon0, ((event_id * 2713) % 1600) * 0.1e0 - 80 - 5 AS lat0 FROM events""",
    "filename_time": f"SELECT event_id, {_SAFE.format(_TIME.format('epoch_us(ts)'))} || '.geojson' AS name, epoch_us(ts) AS us FROM events",
    "date_chunks": """
        WITH b AS (SELECT min(ts::DATE) AS lo, max(ts::DATE) AS hi FROM events), c AS (SELECT lo + (((ts::DATE - lo) // 3) * 3)::INTEGER AS s, hi FROM events, b)
        SELECT s::VARCHAR AS chunk_start, least(s + 2, hi)::VARCHAR AS chunk_end, CASE WHEN s = least(s + 2, hi) THEN s::VARCHAR ELSE s::VARCHAR || '..' || least(s + 2, hi)::VARCHAR END AS label, count(*) AS n FROM c GROUP BY ALL""",
    "month_keys": """
        WITH b AS (SELECT date_trunc('month', min(ts))::DATE AS lo, date_trunc('month', max(ts))::DATE AS hi FROM events),
        k AS (SELECT strftime(unnest(generate_series(lo - INTERVAL 2 MONTH, hi + INTERVAL 1 MONTH, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM b), c AS (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1)
        SELECT month, coalesce(n, 0) AS n FROM k LEFT JOIN c USING (month)""",
    "catalogue_missing": _LISTING + " SELECT target_path, 'http://host/meta/' || dip || '_MD.XML' AS metadata_url FROM t WHERE event_id % 3 <> 0",
    "catalogue_reconcile": _LISTING + " SELECT chunk_start::VARCHAR AS chunk_start, count(*) AS expected, count(*) AS listed, count(*) FILTER (WHERE event_id % 3 = 0) AS present, count(*) FILTER (WHERE event_id % 3 <> 0) AS missing FROM t GROUP BY 1",
    "catalogue_job": f"""
        WITH d AS (SELECT unnest(generate_series(min(ts::DATE) - INTERVAL 1 DAY, max(ts::DATE) + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM events),
        c AS (SELECT day, count(*) AS n, count(*) FILTER (WHERE g % 3 = 0) AS p FROM ({_GROUPS}) GROUP BY 1)
        SELECT day::VARCHAR AS chunk_start, coalesce(n + 1, 0) AS expected, coalesce(n, 0) AS listed, coalesce(p, 0) AS present, coalesce(n - p, 0) AS missing,
               coalesce(p, 0) > 0 AND date_diff('day', DATE '2024-01-01', day) % 4 = 0 AS listed_again FROM d LEFT JOIN c USING (day)""",
    "colocate_month_tables": f"WITH {_near(1, _SHAPES.replace('epoch_us(ts)', f'epoch_us(ts) + {_LATER}'), _POINTS.replace('epoch_us(ts)', f'epoch_us(ts) + {_LATER}'))}{_MATCH}{_ALL} WHERE make_timestamp(pt_us) < TIMESTAMP '2024-02-01'",
}
