"""Points and footprints as Parquet tables in folders by month, sorted by time: a month's job reads the files and row groups of that month only."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathkit.functions import times
from swathkit.operators.colocate import month_filter

_BOX = ("x0", "x1", "y0", "y1")


def _month(us: Column) -> Column:
    return F.substring(times.utc_date(us).cast("string"), 1, 7)


def _months(month: str, widen_us: int) -> list[str]:
    """The months that [month - widen, next month + widen) touches."""
    low, high = times.month_micros(month)
    day = lambda us: dt.date(1970, 1, 1) + dt.timedelta(days=us // 86_400_000_000)
    first, last = day(low - widen_us), day(high + widen_us - 1)
    numbers = range(first.year * 12 + first.month - 1, last.year * 12 + last.month)
    return [f"{n // 12:04}-{n % 12 + 1:02}" for n in numbers]


def _write(rows: DataFrame, us: str, path: str) -> None:
    """Rows in folders by month, in ranges of time, so that a file and a row group hold a short time; other months' folders stay."""
    ranged = rows.withColumn("month", _month(F.col(us))).repartitionByRange("month", us).sortWithinPartitions("month", us)
    ranged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def _of_month(rows: DataFrame, us: str, month: str | None, widen_us: int) -> DataFrame:
    """Filters on the folder and on the time: the former choose files, the latter row groups."""
    if month is None:
        return rows
    return month_filter(rows.filter(F.col("month").isin(_months(month, widen_us))), us, month, widen_us)


def write_points_table(points: DataFrame, path: str) -> None:
    """latitude, longitude, timestamp, point_us and point_id (path or file and place in it, if points have no id)."""
    if "point_id" not in points.columns:
        first = "path" if "path" in points.columns else "file_name"
        points = points.withColumn("point_id", F.struct(first, "pos"))
    if "point_us" not in points.columns:
        points = points.withColumn("point_us", times.micros(F.col("point_ts")))
    _write(points.select("latitude", "longitude", "timestamp", "point_us", "point_id"), "point_us", path)


def read_points_table(spark: SparkSession, path: str, month: str | None = None) -> DataFrame:
    """Points for colocate; of one month (YYYY-MM, UTC) if given."""
    return _of_month(spark.read.parquet(path), "point_us", month, 0).drop("month")


def with_box(footprints: DataFrame) -> DataFrame:
    """Adds x0, x1, y0, y1: the box of all vertices of the rings."""
    ends = ("array_min", "lon"), ("array_max", "lon"), ("array_min", "lat"), ("array_max", "lat")
    return footprints.withColumns({name: F.expr(f"{best}(transform(flatten(rings), v -> v.{axis}))") for name, (best, axis) in zip(_BOX, ends)})


def write_footprints_table(footprints: DataFrame, path: str) -> None:
    """The columns of tracks.footprints with footprint_us and the box of each footprint."""
    rows = with_box(footprints.withColumn("footprint_us", times.micros(F.col("central_ts"))))
    _write(rows, "footprint_us", path)


def read_footprints_table(spark: SparkSession, folders: list[str], month: str | None = None, window_us: int = 0, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Footprints for colocate: footprint_us, source_folder (a folder's own name), folder_no, file_name, parts, and the box.

    month: only those that a point of that month can match within window_us. box: (west, east, south,
    north), only those whose box meets it.
    """
    found = None
    for number, folder in enumerate(folders):
        rows = _of_month(spark.read.parquet(folder), "footprint_us", month, window_us)
        if box is not None:
            west, east, south, north = map(float, box)
            rows = rows.filter((F.col("x1") >= west) & (F.col("x0") <= east) & (F.col("y1") >= south) & (F.col("y0") <= north))
        parts = F.expr("transform(rings, r -> struct('Polygon' as kind, array(r) as rings))").alias("parts")
        name = F.lit(folder.rstrip("/").rsplit("/", 1)[-1])
        rows = rows.select("footprint_us", name.alias("source_folder"), F.lit(number).alias("folder_no"), F.col("polygon_file").alias("file_name"), parts, *_BOX)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("no folders given")
    return found
