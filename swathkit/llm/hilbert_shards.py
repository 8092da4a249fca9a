"""Sharding along a Hilbert curve, so that a shard spans a small box in every metadata dimension.

Each dimension is quantised to the same number of bits, at its quantiles over all rows and in its own
order, the cells are ordered by their index on the Hilbert curve, and the order is cut in runs. The cut is
by row count, with the `rows` law: shard sizes differ by one row at most. Files written from the
shards carry narrow minimum and maximum values per dimension, which is what prunes them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swathkit.llm.shared import fresh, materialize


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer cells (rows x dimensions, each below 2**bits).

    The published transpose form: undo the excess rotations from the top bit down, Gray-encode, then
    interleave the bits. Works on whole columns.
    """
    x = [cells[:, d].astype(np.int64).copy() for d in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for d in range(n):
            high = (x[d] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[d] = x[d] ^ swap
        q >>= 1
    for d in range(1, n):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(n):
            index = (index << 1) | (((x[d] ^ flip) >> bit) & 1)
    return index


#: Characters of a text value that are compared.
CHARACTERS = 1_000


def _is_text(df: DataFrame, name: str) -> bool:
    return not isinstance(df.schema[name].dataType, T.NumericType | T.TimestampType | T.DateType | T.TimestampNTZType)


def _ordered(df: DataFrame, name: str) -> Column:
    """A column in its own order: text (and what isn't a number or time) by its first CHARACTERS, other values as numbers, times by their seconds."""
    kind, value = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    return F.substring(value.cast("string"), 1, CHARACTERS) if _is_text(df, name) else value.cast("timestamp").cast("double")


def _text_cuts(df: DataFrame, names: Sequence[str], shares: list[float]) -> dict[str, list[str]]:
    """Exact quantiles of text columns, of all rows: values are counted and sorted by Spark, and of each column only those at the quantiles' ranks reach the driver."""
    return {name: _quantiles(df.select(_ordered(df, name).alias("value")), shares) for name in names}


def _quantiles(values: DataFrame, shares: list[float]) -> list[str]:
    """The values (column value, nulls left out) at the ranks ceil(share * rows)."""
    counted = values.filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    # Range partitions are sampled anew by every job, so the sorted values are written once, with their place.
    counted = counted.repartitionByRange("value").sortWithinPartitions("value").withColumn("place", F.monotonically_increasing_id())
    counted = materialize(counted, "values").withColumn("part", F.shiftright("place", 33))
    # One row per partition: bounded by the number of partitions, not of values.
    sums = sorted(map(tuple, counted.groupBy("part").agg(F.sum("n")).collect()))
    total = sum(n for _, n in sums)
    if not total:
        return []
    ranks = [max(1, math.ceil(share * total)) for share in shares]
    wanted, before = [], 0
    for part, n in sums:
        own = [r for r in ranks if before < r <= before + n]
        if own:
            wanted.append((part, before, own))
        before += n
    starts = values.sparkSession.createDataFrame(wanted, "part long, before long, ranks array<long>")
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("place")) + F.col("before")
    rows = counted.join(F.broadcast(starts), "part").withColumn("upto", upto)
    hit = rows.withColumn("ranks", F.expr("filter(ranks, r -> r > upto - n and r <= upto)")).filter("size(ranks) > 0")
    found = {r.rank: r.value for r in hit.select("value", F.explode("ranks").alias("rank")).collect()}
    return [found[r] for r in ranks]


def cuts(df: DataFrame, dims: Sequence[str], bits: int, accuracy: int = 10_000) -> list[list[float] | list[str]]:
    """For each dimension the values that cut it in 2**bits cells of about equal rows, numbers and times from one pass of bounded sketches over all rows, text exactly. A frequent value stands several times, so that few values spread over all cells."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    numbers = [d for d in dims if not _is_text(df, d)]
    sketches = df.agg(*[F.percentile_approx(_ordered(df, d), shares, accuracy).alias(f"d{i}") for i, d in enumerate(numbers)]).first() if numbers else ()
    texts = _text_cuts(df, [d for d in dims if _is_text(df, d)], shares)
    return [texts[d] if d in texts else sorted(sketches[numbers.index(d)] or []) for d in dims]


def quantise(df: DataFrame, name: str, edges: list[float] | list[str]) -> Column:
    """A column as a cell number: how many of the edges lie below its value. Null is cell 0."""
    if not edges:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < _ordered(df, name))), F.lit(0))


def hilbert_column(df: DataFrame, dims: Sequence[str], bits: int = 6) -> Column:
    """Index on the curve over the dimensions' cells. Cells hold about equal numbers of rows, so the curve runs through all of them."""
    if not dims or bits * len(dims) > 62:
        raise ValueError("dims must not be empty, and bits x dims must be 62 at most")

    @F.pandas_udf("long")
    def index(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(cells.to_numpy(), bits))

    edges = cuts(df, dims, bits)
    return index(F.struct(*[quantise(df, d, e).alias(f"d{i}") for i, (d, e) in enumerate(zip(dims, edges))]))


def hilbert_shards(docs: DataFrame, n_shards: int, dims: Sequence[str] = ("lang", "source", "n_chars"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), curve: one row per row of docs.

    shard is 0 to n_shards - 1 and slot runs from 0 without gaps. With fewer rows than shards some
    shards are empty. size is the UTF-8 length of the text plus 8; a null text has 0 bytes and the
    checksum 0. Ties on the curve are ordered by checksum and id, so equal texts of a cell are
    neighbours; rows that repeat in full are interchangeable. Null ids and null dimensions sort as
    any value. Only ids, sizes and curve indexes are shuffled, never texts.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        hilbert_column(docs, dims).alias("curve"),
    )
    # The range partitions are sampled anew by every job, so the sorted rows are written once, with their place.
    rows = rows.repartitionByRange("curve", "text_crc32", "doc_id").sortWithinPartitions("curve", "text_crc32", "doc_id")
    rows = materialize(rows.withColumn("place", F.monotonically_increasing_id()), "curve")
    part = F.shiftright("place", 33)
    # One row per partition: bounded by the number of partitions, not of rows.
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy()))
    rows = rows.withColumn("part", part).join(F.broadcast(counts.drop("n")), "part")
    rank = F.col("before") + (F.col("place") - F.shiftleft("part", 33))
    rows = rows.withColumn("rank", rank).withColumn("shard", F.expr(f"(rank * {n_shards}) div total"))
    first = F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def write_sharded(docs: DataFrame, path: str, n_files: int, dims: Sequence[str] = ("lang", "source", "n_chars"), bits: int = 6) -> None:
    """Write docs as Parquet in runs along the curve, about n_files of them, with all columns; readers that filter on any of dims skip most files."""
    (curve,) = fresh(docs, "curve")
    ranged = docs.withColumn(curve, hilbert_column(docs, dims, bits)).repartitionByRange(n_files, curve).sortWithinPartitions(curve)
    ranged.drop(curve).write.mode("overwrite").parquet(path)
