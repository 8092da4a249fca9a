"""Catalogue listings: chunks of dates, clean-up, and what is missing against an inventory."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A listing of so many rows has been cut by the server (fixed value).
QUERY_CAP = 10_000


def date_chunks(spark: SparkSession, start: str, end: str, days: int = 1) -> DataFrame:
    """chunk_start, chunk_end, label: an inclusive range of dates in inclusive chunks; the last may be shorter."""
    low, high = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    if low > high or days < 1:
        raise ValueError("start must not be after end, and days must be 1 at least")
    one = spark.range(1).select(F.lit(low).alias("a"), F.lit(high).alias("b"))
    rows = one.select("b", F.explode(F.sequence("a", "b", F.make_interval(days=F.lit(days)))).alias("chunk_start")).withColumn("chunk_start", F.col("chunk_start").cast("date"))
    rows = rows.withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), F.col("b")))
    label = F.when(F.col("chunk_start") == F.col("chunk_end"), F.col("chunk_start").cast("string")).otherwise(F.concat_ws("..", F.col("chunk_start").cast("string"), F.col("chunk_end").cast("string")))
    return rows.select("chunk_start", "chunk_end", label.alias("label"))


def chunk_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks: the columns of requests and chunk_start, chunk_end; rejects: the columns of requests and reason) of many ranges at once.

    requests: start and end (dates, inclusive), days (in a chunk), and any other columns.
    """
    lacking = F.col("start").isNull() | F.col("end").isNull() | F.col("days").isNull()
    reason = F.when(lacking, "no start, end or days").when(F.col("start") > F.col("end"), "start after end").when(F.col("days") < 1, "days below 1")
    rows = requests.withColumn("reason", reason)
    good = rows.filter("reason is null").drop("reason")
    starts = F.expr("transform(sequence(0, cast(floor(datediff(end, start) / days) as int)), k -> date_add(start, cast(k * days as int)))")
    chunks = good.withColumn("chunk_start", F.explode(starts)).withColumn("chunk_end", F.expr("least(date_add(chunk_start, cast(days - 1 as int)), end)"))
    return chunks, rows.filter("reason is not null")


def months(spark: SparkSession, year: int, month: int, n: int = 12) -> DataFrame:
    """month: n consecutive keys YYYY-MM."""
    start = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    return spark.range(1).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(F.add_months(start, i).cast("string"), 1, 7))).alias("month"))


def clean_listing(raw: DataFrame) -> DataFrame:
    """dip_filename, product_uri, begin_acquisition trimmed, rows without name dropped; with chunk_start (date) if there. raw: dipFilename, productURI, beginAcquisition."""
    keep = ["chunk_start"] if "chunk_start" in raw.columns else []
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return raw.select(text("dipFilename").alias("dip_filename"), text("productURI").alias("product_uri"), text("beginAcquisition").alias("begin_acquisition"), *keep).filter("dip_filename <> ''")


def over_cap(counts: DataFrame, cap: int = QUERY_CAP, count_col: str = "expected") -> DataFrame:
    """Chunks with as many records as a query can return at most, or more: they have been cut, and need shorter chunks."""
    return counts.filter(F.col(count_col) >= cap)


def check_cap(counts: DataFrame, cap: int = QUERY_CAP, count_col: str = "expected") -> None:
    """Raise if a chunk (chunk_start, count_col) has as many records as a query can return at most: it has been cut."""
    full = over_cap(counts, cap, count_col).orderBy("chunk_start").take(1)
    if full:
        raise ValueError(f"{full[0][count_col]} records for the chunk of {full[0]['chunk_start']}: use shorter chunks")


def with_targets(listing: DataFrame, base_url: str, out_dir: str) -> DataFrame:
    """Adds metadata_filename, metadata_url, acquisition_date and target_path."""
    name = F.concat("dip_filename", F.lit("_MD.XML"))
    day = F.substring_index(F.trim("begin_acquisition"), "T", 1)
    rows = listing.withColumn("metadata_filename", name).withColumn("metadata_url", F.concat_ws("/", F.lit(base_url.rstrip("/")), name)).withColumn("acquisition_date", day)
    chunk = F.col("chunk_start").cast("string") if "chunk_start" in listing.columns else F.lit(None).cast("string")
    return rows.withColumn("target_path", F.concat_ws("/", F.lit(out_dir), F.coalesce(F.nullif("acquisition_date", F.lit("")), chunk), name))


def reconcile(listing: DataFrame, inventory: DataFrame, chunks: DataFrame | None = None, cap: int | None = QUERY_CAP) -> tuple[DataFrame, DataFrame]:
    """(rows of listing whose target_path isn't in inventory(target_path); per chunk: expected, listed, present, missing).

    chunks: chunk_start and expected, the number of records that the catalogue says it has. Chunks
    without a listed row show as well, and an expected number of cap or more is an error, raised
    before anything is compared. Without chunks the listed rows count as expected. cap None: the
    listing isn't the answer of one query a chunk, so its chunks may have any number of rows.
    """
    here = inventory.select("target_path", F.lit(True).alias("here")).distinct()
    flagged = listing.join(here, "target_path", "left").withColumn("here", F.coalesce("here", F.lit(False)))
    summary = flagged.groupBy("chunk_start").agg(F.count("*").alias("listed"), F.count_if("here").alias("present"))
    if chunks is None:
        if cap is not None:
            check_cap(summary, cap, "listed")
        summary = summary.withColumn("expected", F.col("listed"))
    else:
        if cap is not None:
            check_cap(chunks, cap)
        summary = chunks.select("chunk_start", "expected").join(summary, "chunk_start", "left").fillna(0, ["listed", "present"])
    missing = flagged.filter(~F.col("here")).select(*listing.columns)
    return missing, summary.select("chunk_start", "expected", "listed", "present", (F.col("listed") - F.col("present")).alias("missing"))
