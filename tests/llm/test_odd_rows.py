"""Nulls in any column, repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from swathkit.llm import bloom_dedup, byte_bpe, context_mixing, decontaminate, hilbert_shards, simhash_dedup, suffix_dedup, toxicity, url_filter, warc

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
_ALL = ["None", "None", "1", "1", "1", "2", "3", "4", "5", "-6"]
#: The ids that stay. Among near copies that depends on the fingerprints, tested elsewhere.
_DISTINCT = ["None", "1", "1", "2", "3", "4", "5", "-6"]
KEPT = {"toxicity": _ALL, "exact": _DISTINCT, "exact by shuffle": _DISTINCT, "benchmark": [i for i in _ALL if i != "4"]}
#: Beside the columns of documents, names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, component long, node long, part int, value long, score double, digest string, word string, tf long, row long, __digest string, place long, gram long, n long, __key0 string, __keep string, __gone string, __found string, __word string, __at long, __a string, __first string, __row string"
_MODEL = lambda spark, docs: toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (4, 7)], "doc_id long, toxic int"))
_ITEMS = lambda spark: spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (None, "one two three four five six"), (2, None), (3, "")], "item_id long, text string")
TABLES = {
    "op1": lambda spark, docs: hilbert_shards.hilbert_shards(docs, 5),
    "op2": lambda spark, docs: byte_bpe.token_digests(docs, RANKS, P.PATTERN),
    "op3": lambda spark, docs: toxicity.score(docs, _MODEL(spark, docs)),
    "op5": lambda spark, docs: suffix_dedup.remove_repeats(docs),
    "op7": lambda spark, docs: simhash_dedup.near_groups(docs),
    "op9": lambda spark, docs: context_mixing.score(docs, F.col("doc_id") != 2),
    "op10": lambda spark, docs: bloom_dedup.exact_groups(docs),
}
STAGES = {
    "toxicity": lambda spark, docs: toxicity.keep_clean(docs, _MODEL(spark, docs)),
    "exact": lambda spark, docs: bloom_dedup.exact_dedup(docs),
    "exact by shuffle": lambda spark, docs: bloom_dedup.exact_dedup(docs, small=0),
    "near": lambda spark, docs: simhash_dedup.keep_first(docs),
    "near by shuffle": lambda spark, docs: simhash_dedup.keep_first(docs, small=0),
    "benchmark": lambda spark, docs: decontaminate.drop_contaminated(docs, _ITEMS(spark)),
}


def _table(spark, rows):
    rest = len(SCHEMA.split(", ")) - 2
    made = spark.createDataFrame([(i, t, *[None] * rest) for i, t in rows], SCHEMA)
    # Values of their own, by which a column that is overwritten on the way shows.
    return made.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce("text", F.lit("?"))) for c, kind in made.dtypes if kind == "string" and c != "text"})


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}x{i // 7}" for i in range(40_000))
    return _table(spark, [(None, None), (None, "apples and pears"), (1, "some words"), (1, "some words"), (1, "Some other words"), (2, ""), (3, " \t\n"), (4, "one two three four five six"), (5, long), (-6, long + "!")]).cache()


@pytest.mark.parametrize("name", sorted(TABLES))
def test_one_row_per_row(spark, odd, name):
    got = TABLES[name](spark, odd)
    ids = sorted(str(r.doc_id) for r in got.collect())
    assert ids == sorted(str(r.doc_id) for r in odd.collect())
    nameless = TABLES[name](spark, odd.withColumn("doc_id", F.lit(None).cast("long")))
    assert nameless.filter("doc_id is null").count() == 10
    assert TABLES[name](spark, odd.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_keep_columns(spark, odd, name):
    got = STAGES[name](spark, odd)
    assert got.columns == odd.columns
    rows = got.collect()
    assert all(r[c] == f"{c} of {'?' if r.text is None else r.text}" for r in rows for c, kind in odd.dtypes if kind == "string" and c != "text")
    kept = sorted(str(r.doc_id) for r in rows)
    assert set(kept) <= {str(r.doc_id) for r in odd.collect()}
    assert kept == sorted(KEPT.get(name, kept))
    assert STAGES[name](spark, odd.limit(0)).count() == 0


def test_near_copies_of_the_long_text_go(spark, odd):
    kept = [r.doc_id for r in simhash_dedup.keep_first(odd.filter("doc_id is not null")).collect()]
    assert -6 in kept and 5 not in kept


@pytest.mark.parametrize("small", [1000, 0])
def test_near_copies_are_told_apart_by_row(spark, small):
    """Null and repeated ids: only the copies go, one row of each group stays, its other columns with it."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(None, None), (2, ""), (None, a), (None, b), (None, b), (7, c), (7, d), (3, d), (7, c), (None, c)]
    kept = simhash_dedup.keep_first(_table(spark, rows).withColumn("lang", F.substring("text", 1, 1)), small=small)
    assert sorted((str(r.doc_id), r.text, r.lang) for r in kept.collect()) == sorted([("2", "", ""), ("None", a, "a"), ("None", b, "b"), ("7", c, "c"), ("3", d, "d")])
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_contaminated_rows_are_told_apart_by_row(spark, limit):
    item = "one two three four five six"
    rows = [(None, item), (None, "clean"), (4, item), (4, "clean as well"), (5, None), (5, "so " + item), (None, None)]
    kept = decontaminate.drop_contaminated(_table(spark, rows), _ITEMS(spark), block_bytes=limit)
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == [("4", "clean as well"), ("5", "None"), ("None", "None"), ("None", "clean")]


def test_items_with_nulls_and_repeats(spark, odd):
    for limit in (1 << 24, 0):
        got = sorted((r.doc_id, str(r.item_id)) for r in decontaminate.contained_items(odd, _ITEMS(spark), block_bytes=limit).collect())
        assert got == [(4, "1"), (4, "1"), (4, "None")]


def test_pages_with_nulls_and_repeats(spark):
    body = "x" * 200
    pages = spark.createDataFrame([(None, None, None, "a"), (None, "http://a.example.com", body, "a"), (1, "http://a.example.com", body, "b"), (1, "http://a.example.com", body, "b"), (2, None, body, None)], "page_id long, url string, html string, digest string")
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert got == [("1", 200, "response", None), ("1", 200, "response", None), ("2", 200, "revisit", 1), ("None", 0, "response", None), ("None", 200, "response", None)]
    entries = spark.createDataFrame([("example.com", "block", "2024-01-01"), ("example.com", "block", "2024-01-01"), (None, None, None)], "key string, action string, since string")
    fetched = pages.withColumn("fetch_date", F.lit("2024-02-02")).withColumn("key", F.lit("k")).withColumn("month", F.lit(1))
    judged = url_filter.judge_captures(fetched, entries)
    assert sorted((str(r.page_id), r.blocked) for r in judged.collect()) == [("1", True), ("1", True), ("2", False), ("None", False), ("None", True)]
