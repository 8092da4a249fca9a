"""Readers and writers of the file formats."""

from __future__ import annotations

import contextlib
import datetime as dt
import os
import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathkit.functions import geojson, times
from swathkit.functions.geometry import let
from swathkit.operators import catalogue
from swathkit.sources.scratch import remove, scratch_path


def _file() -> Column:
    return F.col("_metadata.file_path")


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _folder(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def _there(spark: SparkSession, path: str) -> str | None:
    """The full form of a path as file listings show it, or None if nothing is there."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(found).toUri().toString() if system.exists(found) else None


def _is_file(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(found).isFile()


def _tail(base: str) -> str:
    """A full path without its scheme's slashes, of which listings show one or three."""
    return "/" + base.partition(":")[2].lstrip("/") if ":" in base else base


def read_catalogue(spark: SparkSession, path: str, chunk_start: str | None = None) -> DataFrame:
    """Listing in tab-separated values with header. Its chunk is given, or named by folders chunk_start=YYYY-MM-DD."""
    raw = spark.read.csv(path, sep="\t", header=True)
    if chunk_start is not None:
        raw = raw.withColumn("chunk_start", F.lit(dt.date.fromisoformat(chunk_start)))
    return catalogue.clean_listing(raw)


def read_inventory(spark: SparkSession, out_dir: str, files: str = "*_MD.XML") -> DataFrame:
    """target_path (out_dir, day, name) of the files that are there; only names are listed, nothing is read."""
    base = _there(spark, out_dir)
    if base is None:
        return spark.createDataFrame([], "target_path string")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", files).load(out_dir).select("path")
    inside = F.substring_index("path", _tail(base.rstrip("/")), -1)
    return listed.select(F.concat(F.lit(out_dir.rstrip("/")), inside).alias("target_path"))


def read_granules(spark: SparkSession, path: str, recursive: bool = False, files: str = "*.XML") -> DataFrame:
    """path, file_name, granule_group, xml of a file of any name, or of all files of a folder that match a pattern.

    granule_group is the first folder below path, path's own name for files right in it, and the
    file's name for a single file.
    """
    base = _there(spark, path)
    if base is None:
        raise FileNotFoundError(path)
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    single = _is_file(spark, path)
    rows = (reader if single else reader.option("pathGlobFilter", files)).text(path, wholetext=True)
    inside = F.regexp_replace(F.substring_index(_file(), _tail(base), -1), "^/", "")
    group = _name(_file()) if single else F.when(inside.contains("/"), F.substring_index(inside, "/", 1)).otherwise(F.lit(base.rstrip("/").rsplit("/", 1)[-1]))
    return rows.select(_file().alias("path"), _name(_file()).alias("file_name"), group.alias("granule_group"), F.col("value").alias("xml"))


def read_manifests(spark: SparkSession, root: str, start: str, end: str, files: str = "*.manifest") -> tuple[DataFrame, DataFrame]:
    """(manifests: day, path, file_name, xml of root/YYYY/MM/DD/** for an inclusive range of dates; days: day, and whether it has a folder)."""
    return read_manifest_days(spark, root, dates_between(start, end), files)


def dates_between(start: str, end: str) -> list[dt.date]:
    """An inclusive range of dates."""
    low, high = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    if low > high:
        raise ValueError("start must not be after end")
    return [low + dt.timedelta(n) for n in range((high - low).days + 1)]


#: The end of a pattern that no compressed file matches. Their bytes are the text, and are read some five times faster than by the text reader, which unpacks.
_SUFFIX = re.compile(r"\.(?!(?:gz|bz2|deflate|lz4|snappy|zst|zstd|xz|lzo)$)[A-Za-z0-9]+$", re.IGNORECASE)


def read_manifest_days(spark: SparkSession, root: str, dates: list[dt.date], files: str = "*.manifest") -> tuple[DataFrame, DataFrame]:
    """What read_manifests gives, for some dates."""
    whole = "binaryFile" if _SUFFIX.search(files) else "text"
    rows, days = _manifest_files(spark, root, dates, lambda reader, folders: reader.format(whole).option("wholetext", "true").load(folders), files)
    if rows is None:
        return spark.createDataFrame([], "day date, path string, file_name string, xml string"), days
    xml = F.col("content").cast("string") if whole == "binaryFile" else F.col("value")
    return _in_few_tasks(rows.select("day", _file().alias("path"), _name(_file()).alias("file_name"), xml.alias("xml"))), days


def list_manifests(spark: SparkSession, root: str, dates: list[dt.date], files: str = "*.manifest") -> DataFrame:
    """day, path, size, modified of the manifests of some dates; nothing of them is read."""
    rows, _ = _manifest_files(spark, root, dates, lambda reader, folders: reader.format("binaryFile").load(folders), files)
    if rows is None:
        return spark.createDataFrame([], "day date, path string, size long, modified timestamp")
    return _in_few_tasks(rows.select("day", "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")))


def _in_few_tasks(rows: DataFrame) -> DataFrame:
    """Rows of many small files, of which Spark gives each task some thirty: what a task's shuffle costs is more than they do."""
    return rows.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism)


def _manifest_files(spark: SparkSession, root: str, dates: list[dt.date], load, files: str) -> tuple[DataFrame | None, DataFrame]:
    """(rows that load gives of the folders by date that are there, with their day; days: which are there)."""
    there = {d: _there(spark, f"{root.rstrip('/')}/{d:%Y/%m/%d}") for d in dates}
    days = spark.createDataFrame([(d, p is not None) for d, p in there.items()], "day date, present boolean")
    folders = [p for p in there.values() if p is not None]
    if not folders:
        return None, days
    rows = load(spark.read.option("pathGlobFilter", files).option("recursiveFileLookup", "true"), folders)
    base = _tail(folders[0].rstrip("/"))[: -len("/YYYY/MM/DD")]
    day = F.to_date(F.substring(F.substring_index(_file(), base, -1), 2, 10), "yyyy/MM/dd")
    return rows.withColumn("day", day), days


def read_points(spark: SparkSession, path: str, mode: str = "fail") -> tuple[DataFrame, DataFrame]:
    """(points: latitude, longitude, timestamp, point_us, point_id; rejects: the rows that don't parse).

    mode='fail': such a row is an error that shows it. point_id sorts as the rows stand in the files.
    """
    raw = spark.read.csv(path, header=True, schema="latitude string, longitude string, timestamp string")
    place = F.struct(_file().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lat, lon = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    us = times.micros(times.parse_utc(F.col("timestamp"), strict=False))
    rows = raw.select("*", lat.alias("lat"), lon.alias("lon"), us.alias("point_us"), place.alias("point_id"))
    good = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("point_us").isNotNull()
    if mode == "quarantine":
        points = rows.filter(good).select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "timestamp", "point_us", "point_id")
        return points, rows.filter(~good).select(*raw.columns)
    shown = F.to_json(F.struct(*raw.columns), {"ignoreNullFields": "false"})
    checked = F.when(good, F.col("lat")).otherwise(F.raise_error(F.concat(F.lit("not a point row: "), shown)).cast("double"))
    points = rows.select(checked.alias("latitude"), F.col("lon").alias("longitude"), "timestamp", "point_us", "point_id")
    return points, raw.limit(0)


def parse_footprints(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(footprints: footprint_us, source_folder, file_name, parts; rejects: path, source_folder, file_name, reason) of documents.

    files: path, value; source_folder, file_name and folder_no are taken if there.
    """
    have = files.columns
    folder = F.col("source_folder") if "source_folder" in have else _folder(F.col("path"))
    name = F.col("file_name") if "file_name" in have else _name(F.col("path"))
    number = ["folder_no"] if "folder_no" in have else []
    rows = files.select("path", folder.alias("source_folder"), name.alias("file_name"), *number, "value", F.try_parse_json("value").alias("doc"))
    rows = rows.withColumn("footprint_us", times.micros(times.time_of_name(F.col("file_name"))))
    reason = F.when(F.col("footprint_us").isNull(), "no time in the name").when(F.col("doc").isNull(), "malformed JSON")
    rows = rows.withColumn("reason", reason)
    keep = ["footprint_us", "source_folder", "file_name", *number]
    # Behind a generator the parts are computed once, however often what follows refers to them; within a lambda they don't outgrow generated code.
    parts = let(F.struct("doc", "value"), lambda d: geojson.parts(d["doc"], d["value"]))
    good = rows.filter("reason is null").select(*keep, F.explode(F.array(parts)).alias("parts"))
    return good, rows.filter("reason is not null").select("path", "source_folder", "file_name", "reason")


def read_footprints(spark: SparkSession, folders: list[str], lines: bool = False, files: str = "*.geojson") -> tuple[DataFrame, DataFrame]:
    """Footprints and rejects of several folders: of the *.geojson right in them, or if lines of the features that write_footprints wrote there.

    source_folder is a folder's own name, folder_no its place in the list.
    """
    bases = [b for b in (_there(spark, f) for f in folders) if b is not None]
    if len(bases) < len(folders):
        raise FileNotFoundError([f for f in folders if _there(spark, f) is None])
    if lines:
        rows = spark.read.option("recursiveFileLookup", "true").text(bases)
    else:
        rows = spark.read.option("pathGlobFilter", files).text(bases, wholetext=True)
    number, label = F.lit(None).cast("int"), F.lit(None).cast("string")
    # The longest folder that holds the file, should one lie in another.
    for base in sorted(bases, key=len):
        inside = _file().contains(_tail(base.rstrip("/")) + "/")
        number, label = F.when(inside, bases.index(base)).otherwise(number), F.when(inside, base.rstrip("/").rsplit("/", 1)[-1]).otherwise(label)
    name = F.get_json_object("value", "$.id") if lines else _name(_file())
    return parse_footprints(rows.select(_file().alias("path"), label.alias("source_folder"), name.alias("file_name"), number.alias("folder_no"), "value"))


def write_points(points: DataFrame, path: str, crlf: bool = False) -> None:
    """CSV with latitude, longitude, timestamp, in order of path (or file) and place."""
    first = "path" if "path" in points.columns else "file_name"
    out = points.orderBy(first, "pos").select("latitude", "longitude", "timestamp")
    out.write.mode("overwrite").option("header", True).option("lineSep", "\r\n" if crlf else "\n").csv(path)


def write_footprints(footprints: DataFrame, path: str) -> None:
    """One GeoJSON feature per line, its id the polygon_file, in folders by day. Overwrites, so a second run adds nothing."""
    text = geojson.feature_text(F.col("rings"), F.col("central_time"), F.col("file_name"), F.col("polygon_file"))
    footprints.select("day", text.alias("value")).write.mode("overwrite").partitionBy("day").text(path)


def write_scratch_files(rows: DataFrame, path: str, *by: str) -> None:
    """Text files in folders by columns, written on all cores: to make a file costs far more than its few bytes, by which Spark would gather all in one task.

    Each task moves its files in place as it ends: the driver would do that for one after the other. So
    a failed write leaves some there, which is fine below a scratch path only.
    """
    rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, *by).write.partitionBy(*by).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


#: Renames that are under way at once.
_RENAMES = 16


def place_files(spark: SparkSession, written: str, target: Callable[[dict[str, str]], str]) -> None:
    """Move each file below a path to where target puts the values of its folders (column=value). The folders are listed by Spark; two files of one target are an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    moves: dict[str, str] = {}
    for source in spark.read.option("recursiveFileLookup", "true").text(written).inputFiles():
        place = target({k: unquote(v) for k, _, v in (part.partition("=") for part in unquote(source).split("/")[:-1]) if v})
        if place in moves:
            raise FileExistsError(place)
        moves[place] = source
    uri = spark._jvm.java.net.URI
    for folder in {place.rpartition("/")[0] for place in moves}:
        path(folder).getFileSystem(conf).mkdirs(path(folder))
    system = path(written).getFileSystem(conf)

    def move(item: tuple[str, str]) -> None:
        place, source = item
        if not system.rename(path(uri(source)), path(place)):
            raise FileExistsError(place)

    with ThreadPoolExecutor(_RENAMES) as pool:
        for _ in pool.map(move, moves.items()):
            pass


def write_named_files(rows: DataFrame, folder: str) -> None:
    """Documents (place, value) as files of their own at folder/place, a line each. Overwrites; places must not repeat.

    In a folder of the file system that all share, tasks write each file where it belongs, on all
    cores; Spark's writer can't name files, and what it wrote would have to be moved one by one. It is
    the way for other file systems.
    """
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    if at.getScheme() != "file":
        written = scratch_path(spark, "named")
        write_scratch_files(rows.select("place", "value"), written, "place")
        place_files(spark, written, lambda names: f"{folder}/{names['place']}")
        remove(spark, [written])
        return
    # The rows of a place come to one task, one after the other, so a task sees which repeat.
    dealt = rows.select("place", "value").repartition(spark.sparkContext.defaultParallelism, "place").sortWithinPartitions("place")
    twice = dealt.mapInArrow(_write_places(at.getPath()), "place string").agg(F.min("place")).first()[0]
    if twice is not None:
        raise FileExistsError(f"{folder}/{twice}")


def _write_places(base: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes rows (place, value), sorted by place; gives the places that repeat, whose first row stands."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unfinished, last, folder = f".{uuid.uuid4().hex}", None, None
        for batch in batches:
            twice = []
            for place, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if place is None:
                    raise ValueError("a document without a place")
                if place == last:
                    twice.append(place)
                    continue
                inside, _, name = f"{base}/{place}".rpartition("/")
                if inside != folder:
                    os.makedirs(inside, exist_ok=True)
                with open(f"{inside}/{unfinished}", "wb") as out:
                    out.write(f"{value or ''}\n".encode())
                # The sum of a file that stood there before would tell readers that this one is harmed.
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(f"{inside}/.{name}.crc")
                os.replace(f"{inside}/{unfinished}", f"{inside}/{name}")
                last, folder = place, inside
            yield pa.RecordBatch.from_pydict({"place": pa.array(twice, pa.string())})

    return write


def export_geojson(footprints: DataFrame, folder: str) -> None:
    """Each footprint as a file of its own, named by polygon_file, right in a folder: the form that other tools exchange. Names must not repeat."""
    text = geojson.feature_text(F.col("rings"), F.col("central_time"), F.col("file_name"))
    write_named_files(footprints.select(F.col("polygon_file").alias("place"), text.alias("value")), folder)


def write_summary(footprints: DataFrame, path: str, crlf: bool = False) -> None:
    """CSV with central_time, central_lat, central_lon, filename, polygon_file, in order of the time's text; an error if there are none."""
    if footprints.isEmpty():
        raise ValueError("no footprints to write")
    out = footprints.orderBy("central_time", "day", "file_name").select("central_time", "central_lat", "central_lon", F.col("file_name").alias("filename"), "polygon_file")
    out.write.mode("overwrite").option("header", True).option("lineSep", "\r\n" if crlf else "\n").csv(path)


def write_matches(matches: DataFrame, path: str, format: str = "parquet", names: list[str] | None = None) -> None:
    """The seven columns of matches in folders by month (UTC) of the point; other months' folders stay. names: other names for the seven.

    Within a month the rows stand in the order of the points, then of the footprints' times, folders
    (as they were listed) and names.
    """
    seven = matches.columns[:7]
    month = F.substring(times.iso_text(times.parse_utc(F.col("point_timestamp"))), 1, 7)
    keys = [c for c in ("point_id", "footprint_us", "folder_no", "source_folder", "geojson_filename") if c in matches.columns]
    ordered = matches.withColumn("month", month).orderBy("month", *(keys if "point_id" in keys else ["point_timestamp", *keys]))
    out = ordered.select(*[F.col(c).alias(n) for c, n in zip(seven, names or seven)], "month")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("month").format(format).save(path)
