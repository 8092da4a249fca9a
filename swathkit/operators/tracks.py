"""Granule metadata to points, and manifests to footprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathkit.functions import geometry, times
from swathkit.functions.xml import first_and_lists
from swathkit.operators.rings import normalised

_XML = "malformed XML"
_POSITIONS = "positions are missing or not pairs of numbers"


def _once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """keep and columns, each computed once per row: filters and lambdas above can't be moved below the generator and so repeat it."""
    return df.select(*keep, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__one")).select(*keep, "__one.*")


def _split(rows: DataFrame, keep: list[str], mode: str) -> tuple[DataFrame, DataFrame]:
    """(rows without reason, rejects: keep and reason). mode 'fail': a reason is an error that names the file, and there are no rejects."""
    if mode not in ("fail", "quarantine"):
        raise ValueError("mode must be 'fail' or 'quarantine'")
    named = F.concat(F.coalesce("file_name", F.lit("?")), F.lit(": "), F.col("reason"))
    stop = F.when(F.col("reason").isNotNull(), F.raise_error(named).cast("string"))
    good = rows.withColumn("reason", stop) if mode == "fail" else rows
    rejects = rows.filter("reason is not null").select(*keep, "reason")
    return good.filter("reason is null").drop("reason"), rejects if mode == "quarantine" else rejects.limit(0)


def _pairs(numbers: Column) -> Column:
    """lat lon lat lon ... as vertices; null if the numbers aren't pairs."""
    vertex = lambda i: F.struct(F.get(numbers, 2 * i + 1).alias("lon"), F.get(numbers, 2 * i).alias("lat"))
    whole = (F.size(numbers) >= 2) & (F.size(numbers) % 2 == 0)
    return F.when(whole, F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(numbers) / 2) - 1, F.lit(0))), vertex))


def extract_points(granules: DataFrame, mode: str = "fail") -> tuple[DataFrame, DataFrame]:
    """(points, rejects) of granules (file_name, xml; path and granule_group are kept if there).

    points: file_name, pos, latitude, longitude, point_ts, timestamp, the track of each granule with
    interpolated times. The first begin, end and position list count. The step is rounded half-even
    to microseconds and then multiplied. The elements are found by local name, whatever the
    namespace, in one parse of the document. rejects: file_name and reason of the granules that are
    malformed XML, lack an element or hold bad numbers; mode='fail' makes the first of them an error
    that names the file.
    """
    keep = [c for c in ("path", "granule_group", "file_name") if c in granules.columns]
    read = granules.select(*keep, first_and_lists(("beginPosition", "endPosition"), "posList")(F.col("xml")).alias("x"))
    begin, end = (times.parse_utc(F.get("x.first", i), False) for i in (0, 1))
    rows = _once(read, [*keep, "x"], begin=begin, end=end, vertices=_pairs(F.get("x.lists", 0)))
    reason = F.when(~F.col("x.ok"), _XML).when(F.col("begin").isNull(), "no begin time").when(F.col("end").isNull(), "no end time").when(F.col("vertices").isNull(), _POSITIONS)
    rows, rejects = _split(rows.withColumn("reason", reason).drop("x"), keep, mode)
    gaps = F.greatest(F.size("vertices") - 1, F.lit(1)).cast("long")
    step = times.divide_half_even(times.micros(F.col("end")) - times.micros(F.col("begin")), gaps)
    rows = rows.withColumn("step", F.when(F.size("vertices") == 1, F.lit(0)).otherwise(step).cast("long"))
    rows = rows.select(*keep, "begin", "step", F.posexplode("vertices").alias("pos", "v"))
    ts = F.timestamp_micros(times.micros(F.col("begin")) + F.col("step") * F.col("pos"))
    points = rows.select(*keep, "pos", F.col("v.lat").alias("latitude"), F.col("v.lon").alias("longitude"), ts.alias("point_ts"), times.millis_text(ts).alias("timestamp"))
    return points, rejects


def version_key(name: Column) -> tuple[Column, Column]:
    """(group key: first nine fields of a file name split at _, or the name without its suffix; version: the tenth field or '')."""
    fields = F.split(name, "_", -1)
    group = F.when(F.size(fields) >= 9, F.array_join(F.slice(fields, 1, 9), "_")).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
    return group, F.when(F.size(fields) > 9, F.get(fields, 9)).otherwise(F.lit(""))


def latest_versions(manifests: DataFrame, scope: str = "day") -> DataFrame:
    """Per day and group key the row of the greatest version, then name, then path (manifests: day, path, file_name, ...). scope='all': over all days."""
    group, version = version_key(F.col("file_name"))
    keys = ["day", "group_key"] if scope == "day" else ["group_key"]
    best = Window.partitionBy(*keys).orderBy(F.desc("version"), F.desc("file_name"), F.asc("path"))
    rows = manifests.withColumn("group_key", group).withColumn("version", version)
    return rows.withColumn("rank", F.row_number().over(best)).filter("rank = 1").drop("rank")


def manifest_counts(manifests: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """day, manifests, selected (latest versions): counts per day; of all of days (day) if given, so that those without manifests show."""
    selected = latest_versions(manifests.select("day", "path", "file_name")).groupBy("day").agg(F.count("*").alias("selected"))
    counts = manifests.groupBy("day").agg(F.count("*").alias("manifests")).join(selected, "day")
    if days is None:
        return counts
    return days.join(counts, "day", "left").select("day", F.coalesce("manifests", F.lit(0)).alias("manifests"), F.coalesce("selected", F.lit(0)).alias("selected"))


def read_manifest(manifests: DataFrame, mode: str = "fail") -> tuple[DataFrame, DataFrame]:
    """(manifests (file_name, xml, ...) with central_ts, central_time (text), central_lat, central_lon and rings instead of xml; rejects).

    Elements are found by the end of their tag. The centre is over all vertices as given, closing
    ones included. rejects and mode are as in extract_points.
    """
    keep = [c for c in manifests.columns if c != "xml"]
    read = manifests.select(*keep, first_and_lists(("startTime", "stopTime"), "posList", by_end=True)(F.col("xml")).alias("x"))
    start, stop = (times.parse_utc(F.get("x.first", i), False) for i in (0, 1))
    rows = _once(read, [*keep, "x"], start=start, stop=stop, rings=F.transform("x.lists", _pairs))
    usable = (F.size("rings") > 0) & F.forall("rings", lambda r: r.isNotNull())
    reason = F.when(~F.col("x.ok"), _XML).when(F.col("start").isNull(), "no start time").when(F.col("stop").isNull(), "no stop time").when(~F.coalesce(usable, F.lit(False)), _POSITIONS)
    rows, rejects = _split(rows.withColumn("reason", reason).drop("x"), keep, mode)
    lat, lon = geometry.centre(F.flatten("rings"))
    rows = rows.withColumn("central_ts", times.midpoint(F.col("start"), F.col("stop"))).withColumn("central_time", times.iso_text(F.col("central_ts")))
    return rows.withColumn("central_lat", lat).withColumn("central_lon", lon).drop("start", "stop"), rejects


def nameless_footprints(manifests: DataFrame, scope: str = "day", exact: bool = False, mode: str = "fail") -> tuple[DataFrame, DataFrame]:
    """What footprints gives, without polygon_file."""
    parsed, rejects = read_manifest(latest_versions(manifests, scope), mode)
    rows = _once(parsed, [c for c in parsed.columns if c != "rings"], cut=normalised(F.col("rings"), exact))
    return rows.select("day", "path", "file_name", "central_time", "central_lat", "central_lon", "central_ts", "cut.rings", "cut.straddles"), rejects


def with_names(footprints: DataFrame) -> DataFrame:
    """Adds polygon_file: equal times get the names x, x_1, x_2 in order of file name and path."""
    again = F.row_number().over(Window.partitionBy("central_time").orderBy("file_name", "path")) - 1
    suffix = F.when(again > 0, F.concat(F.lit("_"), again.cast("string"))).otherwise(F.lit(""))
    return footprints.withColumn("polygon_file", F.concat(times.safe_name(F.col("central_time"), ""), suffix, F.lit(".geojson")))


def footprints(manifests: DataFrame, scope: str = "day", exact: bool = False, mode: str = "fail") -> tuple[DataFrame, DataFrame]:
    """(footprints, rejects) of manifests (day, path, file_name, xml).

    footprints: day, path, file_name, central_time, central_lat, central_lon, central_ts, polygon_file,
    rings (cut at the meridians), straddles. Takes the latest version of each granule.
    """
    rows, rejects = nameless_footprints(manifests, scope, exact, mode)
    columns = ["day", "path", "file_name", "central_time", "central_lat", "central_lon", "central_ts", "polygon_file", "rings", "straddles"]
    return with_names(rows).select(*columns), rejects


def as_parts(rings: Column) -> Column:
    """Each ring as a Polygon part of its own."""
    return F.transform(rings, lambda r: F.struct(F.lit("Polygon").alias("kind"), F.array(r).alias("rings")))
