"""op9 predicts each bit where it stands, with contexts that cross the borders of words."""

import random
import tracemalloc
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from swathkit.llm import bit_mixing as bm


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture
def trained():
    """A mixer of some texts."""
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoiné") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    texts = [" ".join(rng.choice(words) for _ in range(60)).encode() for _ in range(30)]
    windows, n = bm._summed(bm.Streams(texts).windows)
    bits = bm.table_bits(len(windows))
    table = np.zeros(2 * sum(1 << b for b in bits), np.int64)
    bm.count_bits(windows, n, table, bits)
    mixer = bm.Mixer(bm._in_half(table.reshape(-1, 2)), bits)
    mixer.run(windows, n, 0.2)
    mixer.freeze()
    return mixer, texts


def test_words_in_their_order_score_better(spark):
    """Words that occur once in their document: held-out texts that keep the order of training against the same words in another."""
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshr") for _ in range(4)) for _ in range(40)]
    words = list(dict.fromkeys(words))
    train = [" ".join(words[k:] + words[:k]) for k in range(len(words))] * 2
    plain = [" ".join(words[k : k + 20]) for k in range(10)]
    mixed = [" ".join(rng.sample(t.split(), 20)) for t in plain]
    docs = _docs(spark, list(enumerate([*plain, *mixed, *train])))
    rows = {r.doc_id: r.score for r in bm.score(docs, F.col("doc_id") >= 20).collect()}
    assert all(rows[i] > rows[10 + i] + 1 for i in range(10))


def test_streams_are_the_texts():
    """Each byte's window ends with it and begins six bytes before, in its own text only."""
    texts = [b"", b" Ab\tcd\n", b"x" * 20, "été a".encode()]
    streams = bm.Streams(texts)
    whole = [b" ".join((*t.lower().split(), b"\n")) for t in texts]
    want = [(b" " * 6 + w)[i : i + 7] for w in whole for i in range(len(w))]
    assert [int(w).to_bytes(7, "little") for w in streams.windows] == want
    words = [w for t in texts for w in (*t.lower().split(), b"\n")]
    assert streams.words(np.arange(len(words))) == words
    assert [bm.Streams([w]).hashes()[0] for w in words] == streams.hashes().tolist()


def test_bits_against_plain_version(trained):
    """One bit at a time, from the counts of its contexts."""
    mixer, texts = trained
    streams = bm.Streams([*texts[:2], b"unseen \xff words"])
    got = bm.Memory(mixer).log_p(streams.windows)
    for w, found in list(zip(streams.windows.tolist(), got))[:400:7] + list(zip(streams.windows.tolist(), got))[-15:]:
        before, byte, total = int(w).to_bytes(7, "little")[:6], w >> 48, 0.0
        place = next((k for k in range(6) if before[5 - k] == 32), 6)
        for upper in (True, False):
            half, node = (byte >> 4, 1) if upper else (byte & 15, 1)
            known = np.uint64(0) if upper else np.uint64(byte >> 4) + np.uint64(16)
            rows = bm._rows(np.array([w & (1 << 48) - 1], np.uint64), known, mixer.bits)[:, 0]
            for s in (3, 2, 1, 0):
                slots = [int(mixer.slots[r + node]) for r in rows]
                x = [*((v >> 3) / 256 for v in slots), 0.3]
                gate = (place * 8 + (slots[5] & 7)) * 4 + (slots[3] & 7) // 2
                z = min(max(float(np.dot(mixer.weights[gate], x)), -18), 18)
                at = min(max(z * 2 + 16, 0), 31.999)
                refined = (1 - at % 1) * mixer.refine[gate, int(at)] + at % 1 * mixer.refine[gate, int(at) + 1]
                p = min(max((1 / (1 + np.exp(-z)) + refined) / 2, 1e-6), 1 - 1e-6)
                bit = half >> s & 1
                total += np.log(p if bit else 1 - p)
                node = node * 2 + bit
        assert found == pytest.approx(total, abs=2e-3, rel=1e-3)


def test_bytes_are_a_distribution(trained):
    mixer, texts = trained
    for context in bm.Streams(texts[:1]).windows[:200:20] & np.uint64((1 << 48) - 1):
        windows = context + (np.arange(256, dtype=np.uint64) << np.uint64(48))
        assert np.exp(mixer.run(windows)[0].astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_remembered_predictions_are_the_same(trained, monkeypatch):
    """However few windows a task remembers."""
    mixer, texts = trained
    windows = bm.Streams(texts).windows
    want = mixer.run(windows)[0]
    for bits in (3, 22):
        monkeypatch.setattr(bm, "CACHE_BITS", bits)
        memory = bm.Memory(mixer)
        got = np.concatenate([memory.log_p(windows[i : i + 500]) for i in range(0, len(windows), 500)])
        assert got == pytest.approx(want, abs=1e-4)


def test_document_scores_against_plain_version():
    rng = random.Random(2)
    texts = [[rng.randrange(4) for _ in range(rng.randint(1, 30))] for _ in range(20)]
    log_p = [[-rng.random() * 20 for _ in t] for t in texts]
    got = bm.document_scores(np.array(sum(log_p, [])), np.array(sum(texts, [])), np.repeat(np.arange(20), [len(t) for t in texts]), 20)
    for t, lps, found in zip(texts, log_p, got):
        urns = []
        for a in bm.URNS:
            for wide in (False, True):
                total, seen, size = 0.0, Counter(), Counter()
                for before, word, lp in zip([None, *t], t, lps):
                    context = before if wide else 0
                    total += np.log((seen[context, word] + a * np.exp(lp)) / (size[context] + a))
                    seen[context, word] += 1
                    size[context] += 1
                urns.append(total)
        assert found == pytest.approx(np.logaddexp.reduce(urns) - np.log(len(urns)), rel=1e-9)


@pytest.mark.parametrize("heavy", [bm.HEAVY, 3])
def test_every_row_and_its_base(spark, heavy, monkeypatch):
    """Nulls, empty texts, repeated ids; the base however few words are broadcast."""
    monkeypatch.setattr(bm, "HEAVY", heavy)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["The", "of", "Été", "x1", "rare%d" % i]) for _ in range(rng.randint(1, 40))) for i in range(50)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "the null id"), (7, "twice"), (7, "twice"), (8, "q" * 5000), *enumerate(texts, 10)]
    train = [(i if i is not None else -1) % 5 != 1 and i is not None for i, _ in rows]
    got = bm.score(_docs(spark, rows), F.col("doc_id") % 5 != 1).collect()
    tokens = [["".join(c.lower() if c.isascii() else c for c in t or "").split(), i] for i, t in rows]
    counts = Counter(w for (ws, _), is_train in zip(tokens, train) if is_train for w in [*ws, "\n"])
    total = sum(counts.values())
    base = lambda ws: sum(log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in [*ws, "\n"])
    want = sorted((i is None, i or 0, len(ws) + 1, sum(w in counts for w in [*ws, "\n"]), round(base(ws), 6)) for ws, i in tokens)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {total} and all(r.score < 0 for r in got)
    nothing = bm.score(_docs(spark, rows), F.lit(False)).collect()
    assert len(nothing) == len(rows) and all(r.n_known == 0 and np.isfinite(r.score) for r in nothing)
    assert bm.score(_docs(spark, rows).limit(0), F.lit(True)).count() == 0


def test_texts_come_in_small_batches(spark, monkeypatch):
    """12 MB of texts are fewer than Spark's ten thousand rows: neither the JVM nor a worker holds them at once."""
    sizes, key = [], "spark.sql.execution.arrow.maxBytesPerBatch"
    count_windows, before = bm.count_windows, spark.conf.get(key)

    def batch_sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes]})

    def watched(texts):
        sizes.extend(r["size"] for r in texts.coalesce(1).mapInArrow(batch_sizes, "size long").collect())
        return count_windows(texts)

    monkeypatch.setattr(bm, "count_windows", watched)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab cd "), 7_000).alias("text"))
    assert bm.score(docs, F.lit(True)).count() == 300
    assert sum(sizes) > 12e6 and max(sizes) < 6e6 and spark.conf.get(key) == before


def test_streams_are_made_in_little_memory():
    """At most 26 bytes of memory for each byte of text, 8 of them the windows."""
    texts = [b"some words of a text " * 50] * 2000
    tracemalloc.start()
    try:
        streams = bm.Streams(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(streams.windows) == len(streams.data) and peak < 26 * len(streams.data)


def test_packed_counts_add_up():
    """Counts beyond what one number holds, over several arrays."""
    rng = np.random.default_rng(3)
    held, want = [], Counter()
    for _ in range(4):
        windows = np.unique(rng.integers(0, 1 << 56, 200, dtype=np.uint64) % np.uint64(300) * np.uint64(239_072_435_685_151))
        n = rng.choice([1, 2, 254, 255, 256, 510, 70_000], len(windows))
        held.append(bm._packed(windows, n))
        want.update(dict(zip(windows.tolist(), n.tolist())))
    windows, n = bm._unpacked(held)
    assert list(zip(windows.tolist(), n.tolist())) == sorted(want.items()) and not held
