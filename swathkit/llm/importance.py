"""Importance resampling of documents towards a target: hashed n-gram features, log ratios, Gumbel draws.

Features are runs of one and of two consecutive words. Each counts in the bucket of its CRC-32. The
checksums of all features of a batch are computed at once, from a table of byte and distance from the
end (see crc_spans). Two scans count the buckets of the documents and of the target, a third weighs
every document by the mean gain of its features; what passes the driver are the counts of the
buckets, a number that is a parameter. Weights plus Gumbel noise of the id make scores; documents are
put in order of score by a range shuffle of ids, and ranks follow from the counts of the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathkit.llm.crc_spans import span_crcs
from swathkit.llm.shared import ALNUM, Words, binary_list, fresh, materialize, slices

BUCKETS = 10_000
#: Bytes of text that are cut into features at a time; a longer text is alone.
_AT_ONCE = 1 << 21
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(values: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words in each value; owner and bucket of every feature).

    Words are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z in lower case;
    the two words of a pair are joined by one space, whatever stands between them.
    """
    found = Words(values, ALNUM)
    sizes, owner = found.ends - found.starts, found.owner
    kept = ALNUM[found.data]
    kept[found.ends] = True
    text = np.where(ALNUM[found.data], _LOWER[found.data], np.uint8(32))[kept]
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    pairs = np.flatnonzero(owner[1:] == owner[:-1])
    crcs = np.concatenate((span_crcs(text, starts, ends), span_crcs(text, starts[pairs], ends[pairs + 1])))
    return np.bincount(owner, minlength=len(values)), np.concatenate((owner, owner[pairs])), (crcs % np.uint32(buckets)).astype(np.int64)


def _texts(df: DataFrame, text_col: str, *others: Column) -> DataFrame:
    return df.select(*others, F.col(f"`{text_col}`").cast("binary").alias("text"))


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        values = binary_list(batch.column(0))
        for a, b in slices(values, _AT_ONCE):
            total += np.bincount(features(values[a:b], buckets)[2], minlength=buckets)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket; a row for each bucket in use. Null texts have none."""
    counted = _texts(texts, text_col).mapInArrow(partial(_count, buckets=buckets), "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, buckets: int) -> np.ndarray:
    """The counts as an array: one number for each bucket, so its size is a parameter."""
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, rounded down."""
    buckets = len(source)
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weigh(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = binary_list(batch.column(1))
        n_words, sums = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        for a, b in slices(values, _AT_ONCE):
            words, owner, bucket = features(values[a:b], len(gain))
            n_words[a:b] = words
            # Whole numbers far below 2**53: the sums of doubles are exact.
            sums[a:b] = np.bincount(owner, weights=gain[bucket], minlength=b - a)
        n = n_words + np.maximum(n_words - 1, 0)
        weight = np.floor_divide(sums, np.maximum(n, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n, weight))], names=["doc_id", "n_words", "n_features", "weight"])


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight: one row per row of docs. Weights are mean gains, rounded down; 0 without features."""
    gain = gains(_dense(bucket_counts(docs, text_col, buckets), buckets), _dense(bucket_counts(target, target_col, buckets), buckets))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _texts(docs, text_col, F.col(f"`{id_col}`").alias("doc_id")).select("doc_id", "text")
    return rows.mapInArrow(partial(_weigh, gain=gain), f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate, rounded down, from the hash of seed and id; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, min_words: int = 20,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row per row of docs; rank (1, 2, ...) is null for those that aren't drawn.

    Of the N documents with at least min_words words, the floor(percent * N / 100) of the highest
    scores are drawn, ties to the smaller id, null ids last. Rows that repeat an id are drawn each on
    its own; which of them comes first is open if their scores are equal. Null and empty texts have no
    features and weight 0; without a target text all gains follow from smoothing alone. Other columns
    are not read. An empty table gives no rows.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent must lie in 0 to 100")
    scored = weigh(docs, target, id_col, text_col, target_col, buckets)
    scored = materialize(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # `row` spreads rows that are equal in both, of which there may be many, over partitions.
    ranged = scored.filter(F.col("n_words") >= min_words).withColumn("row", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*order, "row").sortWithinPartitions(*order, "row").drop("row")
    ranged = materialize(ranged.withColumn("place", F.monotonically_increasing_id()), "ranked")
    # One number for each partition of the sort.
    part = F.shiftright("place", 33)
    counts = sorted(ranged.groupBy(part.alias("part")).count().collect())
    drawn = percent * sum(n for _, n in counts) // 100
    before = dict(zip((p for p, _ in counts), np.cumsum([0, *(n for _, n in counts)]).tolist()))
    offsets = docs.sparkSession.createDataFrame(list(before.items()), "part long, before long")
    placed = ranged.withColumn("part", part).join(F.broadcast(offsets), "part")
    rank = F.col("before") + F.col("place") - F.shiftleft("part", 33) + 1
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = placed.select(*columns, F.when(rank <= drawn, rank).cast("long").alias("rank"))
    short = scored.filter(F.col("n_words") < min_words)
    return ranked.unionByName(short.select(*columns, F.lit(None).cast("long").alias("rank")))


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that are drawn, with all their columns. Needs ids without repeats; rows with a null id are never returned. Options as in resample."""
    drawn = resample(docs, target, id_col=id_col, **options).filter("rank is not null and doc_id is not null")
    (key,) = fresh(docs, "id")
    return docs.join(drawn.select(F.col("doc_id").alias(key)), F.col(f"`{id_col}`") == F.col(key), "left_semi")
