import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from swathkit.llm import decontaminate, queries, toxicity  # noqa: E402
from tests.llm.test_operators import _classes, _fingerprint, _lower  # noqa: E402


def test_pipeline_against_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = queries.toxicity_model(spark, folder)
    clean = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted == 0}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in clean}
    last = {}
    for i in sorted(rows):
        last[_lower(rows[i])] = i
    ids = sorted(last.values())
    labels = _classes([_fingerprint(rows[i]) for i in ids])
    ids = [ids[k] for k in sorted(set(labels))]
    items = [decontaminate.shingles(r.text.encode(), 5) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    ids = [i for i in ids if not any(x and len(x & own) >= 0.8 * len(x) for own in [decontaminate.shingles(_lower(rows[i]), 5)] for x in items)]
    got = corpus_pipeline.run(spark, folder)
    assert sorted(r.doc_id for r in got.collect()) == ids
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_queries_are_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert all(any(name.startswith(f"op{n}_") for name in found) for n in range(1, 11)) and "pipeline" in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)
