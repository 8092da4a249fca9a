"""Dated URL lists as validity intervals, joined as of each capture's fetch time. DataFrame functions only.

A list entry says what holds for a host or domain from its date on: block, allow or remove. The
entries of a key become intervals from one date to the next. A capture asks for its host and those
parent domains that have as many labels as some key of the list, and the longest key with a valid
interval decides.

The join is an equi-join on key and calendar month with the exact dates as a residual: an interval
stands in every month it touches (within the months that captures have), a capture in one. So a key
that a third of all captures share is spread over the months, meets the few entries of that month
only, and can be split further by the adaptive skew join; and no capture meets an interval twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of entries for one key and date the first of these holds.
ACTIONS = ("block", "allow", "remove")


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; an IPv6 address keeps its brackets. Empty if there is none."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)", 1)


def suffixes(host: Column, least_labels: int = 2, sizes: Sequence[int] | None = None) -> Column:
    """The host and its parent domains of at least so many labels, longest first; of `sizes` labels only, if given. An IP address has no parents."""
    count = F.size(F.split(host, r"\."))
    if sizes is None:
        wanted = F.when(count >= least_labels, F.sequence(count, F.least(F.lit(least_labels), count), F.lit(-1)))
    else:
        wanted = F.filter(F.array(*map(F.lit, sorted((n for n in set(sizes) if n >= least_labels), reverse=True))).cast("array<int>"), lambda n: n <= count)
    every = F.transform(F.coalesce(wanted, F.array().cast("array<int>")), lambda n: F.call_function("substring_index", host, F.lit("."), -n))
    address = host.startswith("[") | host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    return F.when(address, F.array(host)).otherwise(every)


def _date(column: str) -> Column:
    """A date, timestamp or text as date; null of text that is none."""
    return F.col(f"`{column}`").try_cast("date")


def intervals(entries: DataFrame, key_col: str = "key", action_col: str = "action", date_col: str = "since") -> DataFrame:
    """key, action, since, until (null: still valid; exclusive) of block and allow entries.

    Entries without key or date (or with text that is no date) and unknown actions are left out. A key's entries are first reduced
    to one per date, so that its window holds no more rows than there are dates.
    """
    order = F.array_position(F.array(*map(F.lit, ACTIONS)), F.lower(F.col(action_col)))
    rows = entries.select(F.lower(F.col(key_col)).alias("key"), _date(date_col).alias("since"), order.alias("rank"))
    rows = rows.filter("key is not null and since is not null and rank > 0").groupBy("key", "since").agg(F.min("rank").alias("rank"))
    rows = rows.withColumn("until", F.lead("since").over(Window.partitionBy("key").orderBy("since")))
    return rows.filter(F.col("rank") < len(ACTIONS)).select("key", F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("rank").cast("int")).alias("action"), "since", "until")


def judge_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetch_date") -> DataFrame:
    """page_id, host, fetch_date, list_key, list_action, listed_since, blocked: one row per row of captures.

    A capture without list key, host or fetch time (text that is no date counts as none) has null list columns and isn't blocked. Repeated
    captures and repeated entries are fine; other columns are not read; empty tables give no rows or
    no blocks.
    """
    rows = captures.select(F.col(id_col).alias("page_id"), host_of(F.coalesce(F.col(url_col), F.lit(""))).alias("host"), _date(time_col).alias("fetch_date"))
    low, high = rows.agg(F.min("fetch_date"), F.max("fetch_date")).first()
    valid = intervals(entries)
    # Numbers of labels that keys have: as many as the longest key has labels, at most.
    sizes = [r[0] for r in entries.select(F.size(F.split("key", r"\."))).distinct().collect() if r[0] is not None]
    # Only months that captures have: the number of rows of an interval is bounded by the captures' range.
    start = F.greatest(F.col("since"), F.lit(low).cast("date"))
    stop = F.least(F.coalesce(F.date_sub("until", 1), F.lit(high).cast("date")), F.lit(high).cast("date"))
    months = F.sequence(F.trunc(start, "month"), F.trunc(stop, "month"), F.expr("interval 1 month"))
    named = [F.col("key").alias("list_key"), F.col("action").alias("list_action"), F.col("since").alias("listed_since"), "until"]
    valid = valid.filter(start <= stop).select(*named, F.explode(months).alias("list_month"))
    asked = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("month", F.trunc("fetch_date", "month"))
    asked = asked.select("row", "page_id", "host", "fetch_date", "month", F.explode_outer(suffixes(F.col("host"), sizes=sizes)).alias("key"))
    in_force = (F.col("fetch_date") >= F.col("listed_since")) & (F.col("until").isNull() | (F.col("fetch_date") < F.col("until")))
    holds = (F.col("key") == F.col("list_key")) & (F.col("month") == F.col("list_month")) & in_force
    joined = asked.join(valid, holds, "left")
    found = F.max(F.when(F.col("list_key").isNotNull(), F.struct(F.length("list_key").alias("n"), "list_key", "list_action", "listed_since")))
    best = joined.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("fetch_date").alias("fetch_date"), found.alias("found"))
    return best.select("page_id", "host", "fetch_date", "found.list_key", "found.list_action", "found.listed_since", F.coalesce(F.col("found.list_action") == "block", F.lit(False)).alias("blocked"))
