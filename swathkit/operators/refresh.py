"""Footprints kept as a table by day, brought up to date when manifests come late, change or go."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathkit.operators import tracks
from swathkit.sources import files
from swathkit.sources.scratch import materialize, remove

_STATE = "path string, size long, modified timestamp, day date"
_FOOTPRINT = (
    "path string, file_name string, central_time string, central_lat double, central_lon double, central_ts timestamp, "
    "rings array<array<struct<lon:double,lat:double>>>, straddles boolean, day date"
)


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def _prints(listed: DataFrame, name: str) -> DataFrame:
    """A number for each day that changes with any path, size or time of change."""
    one = F.xxhash64("path", "size", F.unix_micros("modified"))
    return listed.groupBy("day").agg(F.struct(F.count("*").alias("n"), F.bit_xor(one).alias("mix")).alias(name))


def changed_days(spark: SparkSession, listed: DataFrame, table: str) -> list[dt.date]:
    """Days whose files (day, path, size, modified) aren't those that the table was made of; days that lost all of theirs count."""
    if not _exists(spark, f"{table}/manifests"):
        return sorted(r.day for r in listed.select("day").distinct().collect())
    kept = spark.read.schema(_STATE).parquet(f"{table}/manifests")
    both = _prints(listed, "now").join(_prints(kept, "then"), "day", "full")
    return sorted(r.day for r in both.filter(~F.col("now").eqNullSafe(F.col("then"))).select("day").collect())


def refresh_footprints(spark: SparkSession, root: str, start: str, end: str, table: str, pattern: str = "*.manifest", exact: bool = False) -> list[dt.date]:
    """Compute the footprints of the days in an inclusive range whose manifests changed since the last time; those days.

    Each day is replaced as a whole, by the latest version of each of its manifests; other days aren't
    read. What a day was made of is written last, so after a failure it is computed again. Days of the
    table outside the range are left alone.
    """
    dates = files.dates_between(start, end)
    # Kept, as each look at it would ask for every file again; a file that changes later is found the next time.
    listed = materialize(files.list_manifests(spark, root, dates, pattern), "listed")
    in_range = set(dates)
    days = [d for d in changed_days(spark, listed, table) if d in in_range]
    if not days:
        return []
    remove(spark, [f"{table}/manifests/day={d}" for d in days] + [f"{table}/footprints/day={d}" for d in days])
    manifests, _ = files.read_manifest_days(spark, root, days, pattern)
    found, _ = tracks.nameless_footprints(manifests, "day", exact)
    _write_days(found, f"{table}/footprints")
    _write_days(listed.filter(F.col("day").isin(days)).select("path", "size", "modified", "day"), f"{table}/manifests")
    return days


def _write_days(rows: DataFrame, path: str) -> None:
    """Adds rows in folders by day, gathered by day first: each task would make a file for each of its days, and tasks grow with the manifests."""
    rows.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def kept_footprints(spark: SparkSession, table: str) -> DataFrame:
    """The footprints of the table, with names: those that one run over all manifests would give."""
    return tracks.with_names(spark.read.schema(_FOOTPRINT).parquet(f"{table}/footprints"))
