"""Near-duplicates by SimHash and multi-index hashing.

Fingerprints: 64 bits, each the majority of that bit over the hashes of all word shingles. Equal
fingerprints are collapsed first, so a group of copies costs one row.

Links at up to 2 differing bits: a fingerprint is cut in two 32-bit segments. Of two linked
fingerprints at least one segment differs in at most one bit. So every fingerprint stands in the
table of each segment, and enumerates the ball of radius 1 around its own segments; table matches
are verified over all 64 bits. A pair at distance one is probed from the side whose bit is 0 only.

A segment value that many fingerprints share would give all pairs of them. Beyond `bucket_limit`, a
bucket is left out there, and its fingerprints and those that probe it take an exact way without
pairs: each enumerates the radius 1 ball around its whole fingerprint; two fingerprints are within
2 bits exactly when their balls meet, and all that meet in one point are linked to the least of them.
A point has 65 neighbours at most, so no group grows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathkit.llm.bloom_dedup import MAX_BITS, SMALL, filter_words, split_by
from swathkit.llm.components import components
from swathkit.llm.shared import binary_list, fresh, materialize, text_keys

_CHUNK = 1 << 22


def _word_chunks(text: bytes) -> Iterator[list[bytes]]:
    """Words of a lower-cased text, some MB of text at a time, cut at white space."""
    if len(text) <= _CHUNK:
        yield text.split()
        return
    at = 0
    while at < len(text):
        end = at + _CHUNK
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[at:end].split()
        at = end


def fingerprint(text: bytes, words_per_shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text: bit i is 1 if it is set in over half of the shingles' XXH64 values. 0 without words."""
    k, hash64 = words_per_shingle, xxhash.xxh64_intdigest
    ones, total, carry = np.zeros(64, np.int64), 0, []
    for chunk in _word_chunks(text.lower()):
        words = carry + chunk
        shingles = map(b" ".join, zip(*(words[i:] for i in range(k))))
        values = np.fromiter(map(hash64, shingles, repeat(seed)), np.uint64)
        if len(values):
            ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(values)
        carry = words[-(k - 1) :] if k > 1 else []
    if not total:
        return hash64(b" ".join(carry), seed) if carry else 0
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, keyed: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) per row of docs, if keyed also key0, key1 of the text. Null texts are empty: fingerprint 0."""
    keys = [k.alias(f"key{i}") for i, k in enumerate(text_keys(F.col(text_col)))] if keyed else []
    names = ["doc_id", "fp", *(f"key{i}" for i in range(len(keys)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, words_per_shingle) for t in binary_list(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keys).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _segments(fps: DataFrame, probe: bool) -> DataFrame:
    """(part, value, fp): the segments of fps, and if probe also those with one 0 bit set to 1."""
    value = F.when(F.col("part") == 0, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    rows = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("part")).withColumn("value", value)
    if probe:
        bits = F.expr("explode(concat(array(value), filter(transform(sequence(0, 31), i -> value | shiftleft(1L, i)), v -> v <> value)))")
        rows = rows.select("part", bits.alias("value"), "fp")
    return rows.select("part", "value", "fp")


def links(fps: DataFrame, bucket_limit: int = 64) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) at 1 or 2 differing bits that join the same classes as all such links do."""
    table = _segments(fps, probe=False)
    probes = _segments(fps, probe=True)
    sizes = table.groupBy("part", "value").agg(F.count("*").alias("n"))
    many = materialize(sizes.filter(F.col("n") > bucket_limit).select("part", "value"), "buckets")
    few = table.join(many, ["part", "value"], "left_anti").withColumnRenamed("fp", "b")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("b")))
    pairs = probes.join(few, ["part", "value"]).filter((F.col("fp") != F.col("b")) & (apart <= 2))
    pairs = pairs.select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b")).distinct()
    crowd = probes.join(many, ["part", "value"], "left_semi").select("fp").distinct()
    points = F.expr("explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))))")
    balls = crowd.select("fp", points.alias("point"))
    meet = balls.groupBy("point").agg(F.collect_list("fp").alias("near")).filter(F.size("near") > 1)
    stars = meet.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).filter("a <> b").distinct()
    return pairs.unionByName(stars)


#: A fingerprint of more than this share of all rows is hot; there are fewer than its inverse.
_HOT = 1000


def _least(rows: DataFrame, value: Column, bucket_limit: int) -> DataFrame:
    """fp, least, hot: the least value of the rows of each fingerprint's component, and whether very many rows have this fingerprint."""
    heads = materialize(rows.groupBy("fp").agg(F.min(value).alias("head"), F.count("*").alias("n")), "heads")
    total = heads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    linked = components(links(heads.select("fp"), bucket_limit))
    label = heads.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = label.groupBy("component").agg(F.min("head").alias("least"))
    return materialize(label.join(least, "component").select("fp", "least", (F.col("n") * _HOT > total).alias("hot")), "labels")


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """rows with least by their fp. The few hot fingerprints are broadcast: their rows stay where they are."""
    hot = F.broadcast(label.filter("hot").drop("hot"))
    rest = rows.join(hot.select("fp"), "fp", "left_anti").join(label.filter("not hot").drop("hot"), "fp")
    return rows.join(hot, "fp").unionByName(rest)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, bucket_limit: int = 64) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links of 2 bits or fewer).

    One row per row of docs. Null and empty texts have fingerprint 0 and link as any other. Rows that
    repeat an id each have a row. A null id is never a component's id unless all its ids are null.
    Other columns are not read; an empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    label = _least(rows, F.col("doc_id"), bucket_limit)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _labelled(rows, label).select("doc_id", hexed.alias("fingerprint"), F.col("least").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, bucket_limit: int = 64, small: int = SMALL) -> DataFrame:
    """One row of docs for each group, with all its columns: that of the smallest id, a null id after all others.

    Ids may be null or repeat: rows are told apart by id and two hashes of the text, and by those the
    first of an id is chosen. Of rows that repeat id and text, one stays at most. Null and empty texts
    are one group; an empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, words_per_shingle, keyed=True), "fingerprints")
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key0", "key1")
    label = _least(rows, key, bucket_limit)
    # Without nulls at the top, structs compare field by field, null equal to null.
    counted = _labelled(rows, label).groupBy("doc_id", "key0", "key1", (key == F.col("least")).alias("first")).agg(F.count("*").alias("n"))
    names = fresh(docs, "id", "first", "key0", "key1", "a", "b", "row")
    other, first, key0, key1, a, b, row = names
    marked = materialize(counted.filter("not first or n > 1").select("key0", "key1", F.col("doc_id").alias("other"), "first"), "marked")
    texts = text_keys(F.col(text_col))
    keyed = docs.withColumns({a: texts[0], b: texts[1], row: F.col(f"`{id_col}`").cast("long")})
    same = F.col(row).eqNullSafe(F.col(other)) & (F.col(a) == F.col(key0)) & (F.col(b) == F.col(key1))
    out = [F.col(f"`{c}`") for c in docs.columns]
    gone = marked.select(F.col("key0").alias(key0), F.col("key1").alias(key1), F.col("other").alias(other), F.col("first").alias(first))
    # Texts are shuffled only beyond `small` marked rows, and then those that may be marked only.
    if marked.count() <= small:
        kept, gone = keyed.join(F.broadcast(gone), same, "left_anti").select(*out), F.broadcast(gone)
        maybe = keyed
    else:
        own = [F.col("key0"), F.col("key1")]
        words = materialize(filter_words(marked, own, MAX_BITS, 1), "filter")
        rest, maybe = split_by(keyed, [F.col(a), F.col(b)], words, MAX_BITS)
        kept = rest.select(*out).unionByName(maybe.join(gone, same, "left_anti").select(*out))
    if marked.filter("first").isEmpty():
        return kept
    # One of each of the first rows that repeat id and text.
    again = maybe.join(gone.filter(F.col(first)), same, "inner").dropDuplicates([other, key0, key1]).select(*out)
    return kept.unionByName(again)
