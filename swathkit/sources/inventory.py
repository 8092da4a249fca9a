"""A kept inventory of files in folders by day: only folders that changed since the last time are listed."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathkit.sources.scratch import remove

#: A folder that changed in the last seconds may change again within its clock's tick: it is listed once more next time.
SETTLE_MS = 2000


def _folders(spark: SparkSession, path: str) -> dict[str, tuple[str, int]]:
    """Folders right in a path: name to (full path, time of change in ms). Empty if there is no such path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return {}
    return {s.getPath().getName(): (s.getPath().toString(), s.getModificationTime()) for s in system.listStatus(at) if s.isDirectory()}


def _kept(spark: SparkSession, table: str) -> dict[str, int]:
    """When the days that the table has were changed. One row for each day."""
    if not _folders(spark, table).get("folders"):
        return {}
    return {r.day: r.modified for r in spark.read.schema("day string, modified long").parquet(f"{table}/folders").collect()}


def update_inventory(spark: SparkSession, out_dir: str, table: str, files: str = "*_MD.XML", settle_ms: int = SETTLE_MS) -> list[str]:
    """Bring the inventory kept at `table` up to date with out_dir/<day>/<file>; the names of the days that were listed or left out.

    A day is listed if its folder's time of change isn't the one known; file systems without such times
    have 0 and are listed each time. The list of a day is replaced as a whole, and what is known of the
    folders is written last: after a failure the same days are listed again.
    """
    now, known = _folders(spark, out_dir), _kept(spark, table)
    young = time.time() * 1000 - settle_ms
    changed = sorted(day for day, (_, modified) in now.items() if modified <= 0 or known.get(day) != modified)
    gone = sorted(set(known) - set(now))
    if not changed and not gone:
        return []
    remove(spark, [f"{table}/folders", *(f"{table}/files/day={day}" for day in [*changed, *gone])])
    if changed:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", files).load([now[day][0] for day in changed])
        parts = F.split("path", "/")
        rows = listed.select(F.element_at(parts, -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.element_at(parts, -2).alias("day"))
        rows.write.mode("append").partitionBy("day").parquet(f"{table}/files")
    state = [(day, modified if modified < young else -1) for day, (_, modified) in now.items()]
    spark.createDataFrame(state, "day string, modified long").coalesce(1).write.mode("overwrite").parquet(f"{table}/folders")
    return [*changed, *gone]


def kept_inventory(spark: SparkSession, out_dir: str, table: str) -> DataFrame:
    """target_path, day, size, modified of the files that the kept inventory has; the form that reconcile takes."""
    if not any(name.startswith("day=") for name in _folders(spark, f"{table}/files")):
        return spark.createDataFrame([], "target_path string, day string, size long, modified timestamp")
    rows = spark.read.schema("name string, size long, modified timestamp, day string").parquet(f"{table}/files")
    return rows.select(F.concat_ws("/", F.lit(out_dir.rstrip("/")), "day", "name").alias("target_path"), "day", "size", "modified")
