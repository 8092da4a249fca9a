"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass one sets two bits for every row, in one 64-bit word of a filter, and keeps the bits that were
set by more than one row. Bits are counted in each task before they travel, so a text that half of all
rows have is one count for each task. Pass two looks every row up: a row whose bits are not both taken twice has no
equal and passes straight through; the others, possible repeats, are shuffled by their hash. A full
filter only sends more rows to the shuffle; it never changes the result.

The filter has about 16 bits for each row, up to 2**MAX_BITS bits: a table of 2**MAX_BITS / 64 rows of
16 bytes at most, so it may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathkit.llm.shared import fresh, lower_ascii, materialize, text_keys

MIN_BITS, MAX_BITS = 16, 26
#: Rows of two longs and an id that may be broadcast: some 50 MB.
SMALL = 1_000_000


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z in lower case; null as empty."""
    return F.sha2(lower_ascii(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def _place(keys: list[Column], bits: int) -> tuple[Column, list[Column]]:
    """The word of a key, and two bits of it."""
    word = F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(1 << (bits - 6)))
    other = F.xxhash64(F.lit(2), *keys)
    return word, [F.pmod(other, F.lit(64)).cast("int"), F.pmod(F.shiftright(other, 8), F.lit(64)).cast("int")]


def filter_words(df: DataFrame, keys: list[Column], bits: int, times: int) -> DataFrame:
    """word, bits: the words of a filter of the keys of df, with the bits that at least `times` (1 or 2) rows set."""
    word, spots = _place(keys, bits)
    set_ = df.select(F.explode(F.array_distinct(F.array(*[word * 64 + s for s in spots]))).alias("at"))
    counted = set_.groupBy("at").agg(F.count("*").alias("n")).filter(F.col("n") >= times)
    marked = counted.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    return marked.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def split_by(df: DataFrame, keys: list[Column], words: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is not in the filter for certain, rows whose key may be), both with df's columns."""
    word, held, at = fresh(df, "word", "held", "at")
    place, spots = _place(keys, bits)
    looked = df.withColumns({at: place}).join(F.broadcast(words.select(F.col("word").alias(word), F.col("bits").alias(held))), F.col(at) == F.col(word), "left")
    both = [F.coalesce(F.getbit(F.col(held), s), F.lit(0)) == 1 for s in spots]
    taken = both[0] & both[1]
    names = [F.col(f"`{c}`") for c in df.columns]
    return looked.filter(~taken).select(*names), looked.filter(taken).select(*names)


def filter_bits(rows: int, bits: int | None = None) -> int:
    """Bits of a filter for so many rows, or those given."""
    bits = bits or min(MAX_BITS, max(MIN_BITS, (16 * max(rows, 1) - 1).bit_length()))
    if not MIN_BITS <= bits <= 28:
        raise ValueError(f"the filter's bits must lie in {MIN_BITS} to 28: it is broadcast")
    return bits


def split_repeats(df: DataFrame, keys: list[Column], bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose key occurs once for certain, rows whose key may repeat), both with df's columns.

    df is read three times, so a costly key is best materialised before. Keys aren't null.
    """
    return split_by(df, keys, materialize(filter_words(df, keys, bits, 2), "filter"), bits)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None, hot_groups: int = 1000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs.

    Texts are equal if identical after lower-casing A-Z. Of equal texts the row with the largest id
    stays; null ids lose to all others. A null text equals an empty one. A row that repeats id and
    text counts in group_size and is kept as often as it occurs if its id wins (exact_dedup keeps one).
    Extra columns are not read; an empty table gives no rows. Groups of more than 1 / hot_groups of all
    rows, of which there are fewer than hot_groups, are broadcast, so their rows are never in one task.
    """
    digests = materialize(docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("text_sha256")), "digests")
    count = digests.count()
    once, maybe = split_repeats(digests, [F.col("text_sha256")], filter_bits(count, bits))
    groups = maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = materialize(groups, "groups")
    is_hot = F.col("group_size") * hot_groups > count
    hot = F.broadcast(groups.filter(is_hot))
    cold = maybe.join(hot, "text_sha256", "left_anti").join(groups.filter(~is_hot), "text_sha256")
    many = maybe.join(hot, "text_sha256").unionByName(cold).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return once.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256").unionByName(many)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None, small: int = SMALL) -> DataFrame:
    """The rows of docs that stay, with all their columns. Of rows that repeat id and text one stays.

    Texts are compared by two 64-bit hashes, which are written once; texts themselves are shuffled
    only where they repeat beyond `small` groups or repeat with their id. Null and empty texts, ties
    and empty tables are as in exact_groups. Of one id with equal texts but other columns that differ,
    any one row stays.
    """
    keys = text_keys(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))))
    hashes = materialize(docs.select(F.col(id_col).alias("id"), *[k.alias(f"key{i}") for i, k in enumerate(keys)]), "hashes")
    own = [F.col("key0"), F.col("key1")]
    width = filter_bits(hashes.count(), bits)
    _, maybe = split_repeats(hashes, own, width)
    of_id = maybe.groupBy("key0", "key1", "id").agg(F.count("*").alias("same"))
    # A null id is the least.
    best = of_id.groupBy("key0", "key1").agg(F.max(F.struct("id", "same")).alias("top"), F.sum("same").alias("n"))
    best = best.filter("n > 1").select("key0", "key1", F.col("top.id").alias("keep"), (F.col("top.same") > 1).alias("twice"))
    best = materialize(best, "repeats")
    names = fresh(docs, "key0", "key1", "keep", "twice", "a", "b")
    key0, key1, keep, twice, a, b = names
    groups = best.toDF(key0, key1, keep, twice)
    # Each hash once per row, in columns of their own.
    rows = docs.withColumns({a: keys[0], b: keys[1]})
    equal = (F.col(a) == F.col(key0)) & (F.col(b) == F.col(key1))
    out = [F.col(f"`{c}`") for c in docs.columns]
    few = best.count() <= small
    if few:
        looked = rows.join(F.broadcast(groups), equal, "left")
    else:
        words = materialize(filter_words(best, own, MAX_BITS, 1), "filter")
        alone, some = split_by(rows, [F.col(a), F.col(b)], words, MAX_BITS)
        looked = some.join(groups, equal, "left")
    unique = F.col(key0).isNull()
    wins = F.col(f"`{id_col}`").eqNullSafe(F.col(keep))
    stay = looked.filter(unique | (wins & ~F.col(twice))).select(*out)
    if not few:
        stay = alone.select(*out).unionByName(stay)
    if best.filter("twice").isEmpty():
        return stay
    return stay.unionByName(looked.filter(wins & F.col(twice)).dropDuplicates([a, b]).select(*out))
