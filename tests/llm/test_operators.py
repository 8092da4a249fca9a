import hashlib
import random
import time
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathkit.llm import bloom_dedup, byte_bpe, context_mixing, decontaminate, hilbert_shards, simhash_dedup, suffix_dedup, toxicity, url_filter, warc

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gram string, label string, key string, row string"


def _docs(spark, texts):
    """Ids from 0; extra columns bear names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", None, None, "g", "l", "k", "r") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice(["th", "er", "on", "an", "é", "ble"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    near = made[3].split()
    near[len(near) // 2 :] = ["changed", *near[len(near) // 2 + 1 :]]
    return [*made, None, "", " \n ", "a" * 700, "ab" * 300, made[0], made[0].upper(), made[1], " ".join(near), made[2] + " " + made[4][:200], long, "!" * 5000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return _docs(spark, texts).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def _lower(text):
    return (text or "").encode().lower()


def test_exact_groups(docs, texts, nothing):
    want = {}
    for i, t in enumerate(texts):
        want.setdefault(_lower(t), []).append(i)
    for bits, hot in ((16, 1000), (None, 1000), (26, 30), (26, 1)):
        got = bloom_dedup.exact_groups(docs, bits=bits, hot_groups=hot).collect()
        assert len(got) == len(texts)
        for r in got:
            group = want[_lower(texts[r.doc_id])]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(group), len(group), r.doc_id == max(group), hashlib.sha256(_lower(texts[r.doc_id])).hexdigest())
    kept = bloom_dedup.exact_dedup(docs.union(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in want.values()) and kept.columns == docs.columns
    assert bloom_dedup.exact_groups(nothing).count() == 0
    null_id = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert bloom_dedup.exact_groups(null_id).count() == len(texts)


def test_exact_groups_stays_native(docs):
    assert "Python" not in bloom_dedup.exact_groups(docs)._jdf.queryExecution().executedPlan().toString()


def test_hilbert_curve_is_continuous():
    bits = 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * 3, indexing="ij"), -1).reshape(-1, 3)
    index = hilbert_shards.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_shards(docs, texts, nothing):
    rows = hilbert_shards.hilbert_shards(docs, 7).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    assert {r.slot for r in hilbert_shards.hilbert_shards(docs.limit(3), 24).collect()} == {0}
    assert hilbert_shards.hilbert_shards(nothing, 24).count() == 0


def test_bpe(docs, texts, nothing):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    for r in byte_bpe.token_digests(docs, path, P.PATTERN).collect():
        text = texts[r.doc_id] or ""
        ids = coder.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert all(bytes(r.bytes) == (texts[r.doc_id] or "").encode() for r in back)
    own = byte_bpe.ByteBpe(path, P.PATTERN)
    for odd in ["x" * 3000, "世界 <|endoftext|> it's 12½", "\x1c \x85 a", "tab\t\n  end  ", "ab" * 2000]:
        assert own.encode(odd) == coder.encode_ordinary(odd)
    assert byte_bpe.token_digests(nothing, path, P.PATTERN).count() == 0


def test_toxicity(spark, nothing):
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 400):x}q" for _ in range(400)]
    texts, labels = [], []
    for i in range(600):
        sentences = [" ".join(rng.choice(words) for _ in range(8)) + "." for _ in range(rng.randint(1, 9))]
        bad = i % 5 == 0
        if bad:
            sentences[rng.randrange(len(sentences))] = f"{rng.choice(words)} {rng.choice(['idiot', 'scum'])} {rng.choice(words)}."
        texts.append(" ".join(sentences))
        labels.append((i, int(bad)))
    docs = _docs(spark, [*texts, None, "", "..."])
    model = toxicity.fit(docs, spark.createDataFrame(labels[:400], "doc_id long, toxic int"))
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(rows) == 603 and all(0 <= r.score <= 1 for r in rows.values())
    assert sum(rows[i].predicted == y for i, y in labels[400:]) >= 196
    assert {rows[i].score for i in (600, 601, 602)} == {0.0}
    found = [r.sentence for r in toxicity.locate(docs, model).collect()]
    assert found and sum("idiot" in s or "scum" in s for s in found) >= 0.95 * len(found)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in rows.values())
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, none).agg(F.max("score")).first()[0] == 0
    assert toxicity.score(nothing, model).count() == 0


def test_url_filter(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.b.example.com/x", "2024-01-10"), (2, "https://u:p@A.b.Example.com:80/", "2024-03-01"), (3, "http://c.example.com", "2024-02-01"), (4, None, "2024-02-01"), (5, "http://c.example.com", None), (6, "nonsense", "2024-02-01"), (6, "nonsense", "2024-02-01")],
        "page_id long, url string, fetch_date string",
    )
    entries = spark.createDataFrame(
        [("example.com", "block", "2024-01-05"), ("b.example.com", "allow", "2024-01-10"), ("b.example.com", "remove", "2024-02-01"), ("b.example.com", "allow", "2024-02-01"), ("b.example.com", "remove", "2024-03-01"), (None, "block", "2024-01-01"), ("c.example.com", "odd", "2024-01-01")],
        "key string, action string, since string",
    )
    got = {(r.page_id, r.list_key, r.list_action, r.blocked) for r in url_filter.judge_captures(pages, entries).collect()}
    assert got == {(1, "b.example.com", "allow", False), (2, "example.com", "block", True), (3, "example.com", "block", True), (4, None, None, False), (5, None, None, False), (6, None, None, False)}
    assert url_filter.judge_captures(pages, entries).count() == 7
    assert url_filter.judge_captures(pages.limit(0), entries).count() == 0
    assert url_filter.judge_captures(pages, entries.limit(0)).filter("blocked").count() == 0


def test_suffix_dedup(docs, texts, nothing):
    seen, want = set(), {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            piece = raw[p : p + 100]
            if piece in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(piece)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want[i] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    for limit in (1000, 0):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, group_limit=limit).collect()}
        assert got == want
    assert suffix_dedup.remove_repeats(docs.union(docs)).agg(F.sum("n_removed")).first()[0] == 2 * sum(w[1] for w in want.values())
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    # The first document without id: it comes before all others, which it does anyway.
    unnamed = docs.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id") + 2**60))
    for limit in (1000, 0):
        got = {(r.doc_id or 2**60) - 2**60: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(unnamed, group_limit=limit).collect()}
        assert got == want


@pytest.mark.parametrize("limit", [1000, 0])
def test_suffix_dedup_tells_texts_of_one_id_apart(spark, limit):
    """Texts with null or repeated ids lose their own repeats only, at equal places too; full repeats are one document."""
    rng = random.Random(8)
    fresh = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    shared, other = fresh(300), fresh(250)
    rows = [(None, shared + fresh(400)), (None, shared + fresh(90)), (None, fresh(800)), (7, fresh(500)), (7, other + fresh(300)), (7, other + fresh(200)), (7, fresh(120)), (9, other)]
    rows += [rows[2], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.remove_repeats(docs, group_limit=limit).collect()
    removed = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in got)
    in_pairs = [x for x in removed if x[1] in (700, 390)], [x for x in removed if x[1] in (550, 450)]
    assert [sorted(x[2] for x in pair) for pair in in_pairs] == [[0, 300], [0, 250]]
    assert [x for x in removed if x not in in_pairs[0] + in_pairs[1]] == [("7", 120, 0), ("7", 500, 0), ("7", 500, 0), ("9", 250, 250), ("None", 800, 0), ("None", 800, 0)]


def test_anchors_meet_within_a_task(spark):
    """Equal results whether all, some or no equal anchors are compared before the shuffle."""
    texts = ["ab" * 4000, "abc" * 300 + "x" * 900, "ab" * 4000, "q" + "ab" * 2000]
    results = []
    for meet in (1, 250_000):
        spots = list(suffix_dedup._anchor_batches(100)(iter([_arrow(texts)]))) if meet > 1 else []
        results.append([tuple(r) for r in suffix_dedup.remove_repeats(_docs(spark, texts).repartition(1 if meet > 1 else 4)).orderBy("doc_id").drop("spans").collect()])
    assert results[0] == results[1] and results[0][2][2] == 8000
    grams = Counter(g for b in spots for g in b.column(0).to_pylist())
    assert max(grams.values()) < sum(grams.values()) // 10


def _arrow(texts):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])


def test_decontaminate(spark, docs, texts, nothing):
    items = spark.createDataFrame([(0, texts[4]), (1, texts[70][1000:1300]), (2, None), (3, ""), (4, "two words"), (5, "not in any document at all, never ever"), (6, texts[5].upper())], "item_id long, text string")
    want = set()
    for i, t in enumerate(texts):
        own = decontaminate.shingles((t or "").encode(), 5)
        for r in items.collect():
            item = decontaminate.shingles((r.text or "").encode(), 5)
            if item and len(item & own) >= 0.8 * len(item):
                want.add((i, r.item_id, len(item), len(item & own)))
    assert want
    for limit in (1 << 24, 0):
        got = decontaminate.contained_items(docs, items, block_bytes=limit).collect()
        assert {tuple(r)[:4] for r in got} == want and len(got) == len(want)
    assert decontaminate.contained_items(nothing, items).count() == 0
    assert decontaminate.contained_items(docs, items.limit(0)).count() == 0
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(texts) - len({w[0] for w in want})


def _fingerprint(text):
    import xxhash

    words = _lower(text).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def _classes(prints):
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [root(i) for i in range(len(prints))]


def test_simhash(docs, texts, nothing):
    prints = [_fingerprint(t) for t in texts]
    labels = _classes(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.near_groups(docs).collect()}
    assert got == {i: (f"{p:016x}", labels[i]) for i, p in enumerate(prints)}
    assert simhash_dedup.near_groups(nothing).count() == 0
    kept = simhash_dedup.keep_first(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(labels)) and kept.columns == docs.columns


@pytest.mark.parametrize("limit", [0, 3, 64])
def test_links_have_all_classes(spark, limit):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:20]:
        for _ in range(12):
            prints.add(p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash_dedup.links(spark.createDataFrame([(s,) for s in signed], "fp long"), limit)
    found = {r.node: r.component for r in simhash_dedup.components(edges).collect()}
    groups, want = {}, {}
    for s, label in zip(signed, _classes(prints)):
        want.setdefault(label, set()).add(s)
        groups.setdefault(found.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (7, 7)], "a long, b long")
    rows = simhash_dedup.components(edges).collect()
    assert {(r.node, r.component) for r in rows} == {(i, 0) for i in range(301)} | {(500, 500), (501, 500)}


def test_warc_round_trip(spark, texts):
    html = [t for t in texts if t is not None] + [None, "x" * 99, "x" * 99, "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 5]
    pages = spark.createDataFrame([(i, "http://h/\r\n" if i % 2 else None, h, "z") for i, h in enumerate(html)], "page_id long, url string, html string, other string")
    first, want = {}, set()
    for i, h in enumerate(html):
        raw = (h or "").encode()
        head = first.setdefault(raw, i) if len(raw) >= 100 else i
        want.add((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if head == i else "revisit", None if head == i else head))
    got = [tuple(r) for r in warc.round_trip(pages).collect()]
    assert set(got) == want and len(got) == len(want)
    assert warc.round_trip(pages.limit(0)).count() == 0


def _record(n, body=b"payload"):
    block = body * n
    return b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode() + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [lambda b: b, lambda b: __import__("gzip").compress(b, mtime=0)])
def test_warc_salvage(pack):
    records = [pack(_record(n)) for n in range(1, 7)]
    for harm in (lambda d: d[:-30] + b"\0" * 30, lambda d: d[: len(d) // 2], lambda d: d[:-6] + b"?" + d[-5:], lambda d: b"junk" + d):
        data = records[0] + harm(records[1]) + b"".join(records[2:])
        found = list(warc.salvage(data))
        good = [r.block for r in found if not r.reason]
        assert good[:1] + good[-4:] == [b"payload" * n for n in (1, 3, 4, 5, 6)]
        assert len(good) == 5 or harm(b"") == b"junk"
        assert any(r.reason for r in found) and found[0].start == 0 and found[-1].end == len(data)
        assert all(a.end == b.start for a, b in zip(found, found[1:]))
    assert [r.reason for r in warc.salvage(b"rubbish")] == ["no version line"] and not list(warc.salvage(b""))


def test_warc_salvage_within_members():
    """Archives that are one gzip stream, or have many records a member, lose only what the damage reaches."""
    import gzip

    rng = random.Random(9)
    bodies = [rng.randbytes(3000) for _ in range(40)]
    plain = [_record(1, b) for b in bodies]
    stream = gzip.compress(b"".join(plain), mtime=0)
    half = len(stream) // 2
    for data in (stream[:half], stream[:half] + b"\0" * 200 + stream[half + 200 :], stream[:half] + bytes([stream[half] ^ 1]) + stream[half + 1 :]):
        found = list(warc.salvage(data))
        good = [r.block for r in found if not r.reason]
        assert good[:17] == bodies[:17] and set(good) < set(bodies)
        assert any(r.reason for r in found) and all((r.start, r.end) == (0, len(data)) for r in found)
    bad = plain[3][:-50] + b"?" + plain[3][-49:]
    members = [gzip.compress(b"".join(x), mtime=0) for x in (plain[:3] + [bad] + plain[4:10], plain[10:20], plain[20:])]
    cut = members[1][: len(members[1]) - 6000]
    found = list(warc.salvage(members[0] + cut + members[2]))
    assert [r.block for r in found if not r.reason] == bodies[:3] + bodies[4:18] + bodies[20:]
    places = sorted({(r.start, r.end) for r in found})
    assert places[0][0] == 0 and places[-1][1] == len(members[0] + cut + members[2]) and len(places) == 3
    assert all(a[1] == b[0] for a, b in zip(places, places[1:]))
    assert {(r.start, r.end) for r in found if r.reason} == set(places[:2])


def test_read_warc_takes_every_file(spark, tmp_path):
    import gzip

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.warc").write_bytes(_record(1))
    (tmp_path / "sub" / "b.warc.gz").write_bytes(gzip.compress(_record(2) + _record(3)))
    (tmp_path / "sub" / "part-0").write_bytes(_record(4) + b"rubbish")
    read = lambda **options: sorted((r.file.rsplit("/")[-1], r.payload_bytes) for r in warc.read_warc(spark, str(tmp_path), **options).filter("reason is null").collect())
    assert read() == [("a.warc", 7), ("b.warc.gz", 14), ("b.warc.gz", 21), ("part-0", 28)]
    assert read(files="*.gz") == [("b.warc.gz", 14), ("b.warc.gz", 21)]
    assert warc.read_warc(spark, str(tmp_path)).filter("reason is not null").count() == 1


def test_context_mixing(docs, texts, nothing):
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    rows = context_mixing.score(docs, train).collect()
    tokens = {i: [*_lower(t).split(), b"\n"] for i, t in enumerate(texts)}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    total = sum(counts.values())
    assert len(rows) == len(texts)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in counts for w in ws), total)
        assert r.base_score == pytest.approx(sum(log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in ws), rel=1e-9)
        assert r.score < 0 and (r.bits_per_byte is None) == (not texts[r.doc_id])
    assert context_mixing.score(nothing, train).count() == 0
    assert context_mixing.score(docs, F.lit(False)).filter("n_known > 0").count() == 0


def _plain_bits(model, units, word, context):
    """ln of the probability of one unit, bit by bit, from counts made by looking through all units (word, context, train)."""
    cm, total, history = context_mixing, 0.0, 0x2020202020202020
    logit = lambda pair: np.log((pair[1] + 0.4) / (pair[0] + 0.4))
    for depth, byte in enumerate(word):
        hashed = cm._hashed(np.array([history], np.uint64), np.array([context]))
        node = 1
        for s in range(7, -1, -1):
            pairs = {name: [0, 0] for name in ("tokens", "units", "own")}
            for w, c, n in units:
                if len(w) > depth and w[:depth] == word[:depth] and w[depth] >> (s + 1) == byte >> (s + 1):
                    bit = w[depth] >> s & 1
                    pairs["tokens"][bit] += n
                    pairs["units"][bit] += n > 0
                    pairs["own"][bit] += n * (c == context)
            slots = cm._slots(hashed, np.array([node]), model.bits)[:, 0]
            x = [*(logit(pairs[k]) for k in ("tokens", "units", "own")), *model.logits[slots].astype(float), 0.3]
            seen = lambda n: min(7, n.bit_length())
            gate = (seen(sum(pairs["own"])) * 8 + seen(sum(pairs["units"]))) * 4 + min(depth, 3)
            z = float(np.clip(np.dot(model.weights[gate], x), -18, 18))
            place = min(max(z * 2 + 16, 0), 31.999)
            low = int(place)
            refined = (1 - (place - low)) * model.refine[gate, low] + (place - low) * model.refine[gate, low + 1]
            p = min(max((1 / (1 + np.exp(-z)) + refined) / 2, 1e-6), 1 - 1e-6)
            bit = byte >> s & 1
            total += np.log(p if bit else 1 - p)
            node = node * 2 + bit
        history = (history << 8 | byte) & (1 << 64) - 1
    return total


def _counted(texts):
    """Units of some texts: (word, context) -> tokens, and documents."""
    tokens, documents = Counter(), Counter()
    for t in texts:
        found = [(context_mixing.spell(w), c) for c, held in context_mixing.streams_of((t or "").encode())[0].items() for w in held]
        tokens.update(found)
        documents.update(set(found))
    return tokens, documents


def _model(tokens, documents, held=(), prefix=3):
    import pyarrow as pa

    cm = context_mixing
    keys = sorted({*tokens, *held})
    table = pa.table({"word": pa.array([w for w, _ in keys], pa.binary()), "context": pa.array([c for _, c in keys], pa.int32()), "train": [tokens.get(k, 0) for k in keys], "docs": [documents.get(k, 0) for k in keys], "prefix": pa.array([w[:prefix] for w, _ in keys], pa.binary())})
    below = {}
    for (w, c), n in ((k, tokens.get(k, 0)) for k in keys):
        row = below.setdefault((w[:prefix], c), [0, 0])
        row[0] += n
        row[1] += n > 0
    prefixes = cm.prefix_table(pa.table({"prefix": pa.array([k[0] for k in below], pa.binary()), "context": pa.array([k[1] for k in below], pa.int32()), "train": [v[0] for v in below.values()], "units": [v[1] for v in below.values()]}))
    units = cm.spelled(table, prefixes)
    counts = np.zeros(2 * len(cm.ORDERS) << 16, np.int32)
    train = cm.spelled(table.filter(pa.array([k in tokens for k in keys])), prefixes)
    cm.count_bits(train, counts, 16)
    mixer = cm.Mixer(cm.half(counts.reshape(-1, 2)))
    mixer.learn(train, prefixes)
    mixer.freeze()
    return keys, units, prefixes, mixer


def test_bits_against_plain_version(texts):
    """All counts by looking through all units, one bit at a time."""
    tokens, documents = _counted([*texts[:6], "a\u00e9 a\u00e9b ab abc abcdefg abcdefh " + "z" * 80])
    held = {k: 1 for k in _counted(["abx thq \u00e9 ab \u00f1 abcdefg"])[0]}
    for prefix in (3, 6):
        keys, units, prefixes, mixer = _model(tokens, documents, held, prefix)
        got = mixer.run(units, prefixes)[0]
        rows = [(*k, tokens.get(k, 0)) for k in keys]
        some = sorted({*range(0, len(keys), 9), *(i for i, k in enumerate(keys) if k in held)})
        for i in some:
            assert got[i] == pytest.approx(_plain_bits(mixer, rows, *keys[i]), abs=2e-3, rel=1e-4)


def test_words_are_a_distribution(texts):
    """The probabilities of all words of one byte, of the end and of known words, after one context, don't exceed one."""
    tokens, documents = _counted(texts[:20])
    every = {(bytes([a]) + b" ", 0): 1 for a in range(256) if a not in b" \t\n\r\x0b\x0c"}
    ended = {(b"\n", 0): 1}
    keys, units, prefixes, mixer = _model(tokens, documents, every | ended)
    p = np.exp(mixer.run(units, prefixes)[0])
    total = sum(x for x, (w, c) in zip(p, keys) if c == 0)
    assert 0.3 < total <= 1


def test_score_against_plain_version(spark, docs, texts):
    """Token by token: the bits of each unit, refined by what the document had before, mixed over the urns."""
    train = F.col("doc_id") % 3 != 0
    rows = {r.doc_id: r.score for r in context_mixing.score(docs, train).collect()}
    table, _ = context_mixing.unit_table(docs.withColumn("is_train", train), F.col("is_train"))
    log_p = {bytes(r.key): r.log_p for r in table.collect()}
    for i, t in enumerate(texts):
        units, now = [], 0
        for word in _lower(t).split():
            spelled = word + b" "
            units += [(context_mixing.GOES_ON if k else now, spelled[k : k + 32]) for k in range(0, len(spelled), 32)]
            now = context_mixing._context(word, now)
        units.append((now, b"\n"))
        if len(units) > 5000:
            continue
        urns = []  # Of both kinds, in any order.
        for a in context_mixing.URNS:
            total, seen, sizes = 0.0, Counter(), Counter()
            for unit in units:
                lp = log_p[context_mixing._key(*unit)]
                total += (np.log(seen[unit] + a * np.exp(lp)) if seen[unit] else np.log(a) + lp) - np.log(sizes[unit[0]] + a)
                seen[unit] += 1
                sizes[unit[0]] += 1
            urns.append(total)
            total, seen, sizes, last = 0.0, Counter(), Counter(), {}
            for unit in units:
                before = (unit[0], last.get(unit[0]))
                lp = log_p[context_mixing._key(*unit)]
                total += (np.log(seen[before, unit] + a * np.exp(lp)) if seen[before, unit] else np.log(a) + lp) - np.log(sizes[before] + a)
                seen[before, unit] += 1
                sizes[before] += 1
                last[unit[0]] = unit
            urns.append(total)
        assert rows[i] == pytest.approx((np.logaddexp.reduce(urns) - np.log(len(urns))) / np.log(10), rel=1e-6, abs=1e-6)


def test_order_of_words_counts(spark):
    """Held-out ASCII texts with turns that repeat score better than the same words shuffled."""
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    turns = [[rng.choice(words) for _ in range(5)] for _ in range(12)]
    plain = [" ".join(w for _ in range(14) for w in rng.choice(turns)) for _ in range(20)]
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in plain]
    train = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    for heavy in (context_mixing.HEAVY, 3):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(context_mixing, "HEAVY", heavy)
            rows = {r.doc_id: r.score for r in context_mixing.score(_docs(spark, [*plain, *mixed, *train]), F.col("doc_id") >= 40).collect()}
        assert all(rows[i] > rows[20 + i] + 1 for i in range(20))


def test_long_words_cost_all_their_bytes(spark, texts):
    """A held-out word of 100 000 bytes, alone, repeated, and beyond the broadcast units, as well as twice its length."""
    rng = random.Random(3)
    word = "".join(rng.choice("abcdefghijklmnop0123456789") for _ in range(100_000))
    docs = _docs(spark, [word, word + " " + word, word * 2, *texts[:40]])
    train = F.col("doc_id") > 2
    for heavy in (context_mixing.HEAVY, 1):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(context_mixing, "HEAVY", heavy)
            rows = {r.doc_id: r for r in context_mixing.score(docs, train).collect()}
        # 26 equally likely letters are 4.7 bits a byte at least.
        assert rows[0].bits_per_byte > 4.6 and rows[0].n_known == 1 and rows[1].n_tokens == 3
        # What repeats within a document costs little; more bytes cost more.
        assert rows[1].score > 1.5 * rows[0].score and rows[2].score < rows[0].score


def test_shared_prefixes_and_parts_change_nothing(spark):
    """Prefixes made longer for many units, and units dealt in smaller parts, change no count: untaught predictors give the same scores. All units are learnt from."""
    rng = random.Random(7)
    texts = [" ".join("http://" + "".join(rng.choice("etaoin") for _ in range(rng.randint(1, 9))) for _ in range(60)) for _ in range(60)]
    docs = _docs(spark, texts)
    found = []
    for shared, part in ((1 << 18, 1 << 16), (50, 1 << 16), (50, 300)):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(context_mixing, "SHARED", shared)
            patch.setattr(context_mixing, "PART", part)
            units = context_mixing.with_prefixes(context_mixing.count_units(docs, F.lit(True)))
            sizes = {len(r.prefix) for r in units.select("prefix").distinct().collect()}
            assert max(sizes) == 3 if shared > 50 else max(sizes) >= 12
            found.append([r.score for r in context_mixing.score(docs, F.col("doc_id") > 5, rate=0).orderBy("doc_id").collect()])
    assert found[0] == pytest.approx(found[1], rel=1e-6) and found[0] == pytest.approx(found[2], rel=1e-6)
    units = context_mixing.with_prefixes(context_mixing.count_units(docs, F.col("doc_id") > 5)).repartition(3, "prefix").sortWithinPartitions("word", "context")
    n = units.filter("train > 0").count()
    below = units.groupBy("prefix", "context").agg(F.sum("train").alias("train"), F.count_if(F.col("train") > 0).alias("units")).toArrow()
    mixer, learnt = context_mixing.train_mixer(units, context_mixing.prefix_table(below), n)
    assert learnt == n and (mixer.weights[:, 0] != np.float32(0.3)).any()
    assert [context_mixing.slot_bits(n) for n in (0, 1 << 13, (1 << 13) + 1, 1 << 30)] == [16, 16, 17, 21]


def test_scores_beat_the_smoothed_unigrams(spark):
    """On held-out documents, in total."""
    from swathkit.llm import queries

    held = queries.op9_context_mixing(spark, "/root/testdata/sf0.01").filter("held_out")
    base, score, n = held.agg(F.sum("base_score"), F.sum("score"), F.count("*")).first()
    assert n > 100 and score > 0.98 * base


def _plain_scores(texts, model):
    """Score of each text, word by word, from the model's weights alone."""
    import re

    out = []
    for text in texts:
        clean = 1.0
        for sentence in re.split(rb"[.!?\n\r]", (text or "").encode().lower()):
            found = set()
            for word in re.findall(rb"[a-z\x80-\xff]+", sentence):
                found |= set(toxicity._features(toxicity.Words([word], toxicity.LETTERS))[0].tolist())
            found = [f for f in found if model.weights[f]]
            if found:
                clean *= 1 - 1 / (1 + np.exp(-(model.bias + sum(float(model.weights[f]) for f in found))))
        out.append(1 - clean)
    return out


def test_toxicity_against_plain_version(spark):
    """All documents of a small table; and long texts, whose pieces end at any sentence end or between words."""
    from swathkit.llm import queries

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = queries.toxicity_model(spark, folder)
    rows = docs.collect()
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert [got[r.doc_id] for r in rows] == pytest.approx(_plain_scores([r.text for r in rows], model), abs=1e-9)
    weights = np.zeros(1 << toxicity.BITS, np.float32)
    weights[toxicity._features(toxicity.Words([b"scum"], toxicity.LETTERS))[0, 0]] = 3
    weights[toxicity._features(toxicity.Words([b"idiot"], toxicity.LETTERS))[0, 0]] = 2
    own = toxicity.Model(weights, -4.0)
    rng = random.Random(4)
    words = ["plain", "words", "here", "café"] * 20 + ["scum", "idiot"]
    texts = [" ".join(rng.choice(words) + rng.choice(ends) for _ in range(900)) for ends in (["", "", "! "], ["", "?"], [""], ["", "\r"])]
    texts += ["x" * 3000 + " scum", "scum " + "y" * 3000 + " idiot. idiot", "...!!!" * 400 + "scum"]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(toxicity, "_PIECE", 200)
        patch.setattr(toxicity, "_SLICE", 1)
        scores, count, low, high = toxicity._document_scores([t.encode() for t in texts], own)
    assert scores == pytest.approx(_plain_scores(texts, own), abs=1e-9)
    whole = toxicity._document_scores([t.encode() for t in texts], own)
    assert all((a == b).all() for a, b in zip((count, low, high), whole[1:]))


def test_warc_digests(spark, tmp_path):
    import base64

    block = b"payload" * 30
    sha1 = hashlib.sha1(block).digest()
    record = lambda digest: b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Block-Digest: " + digest + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    good = [b"sha1:" + base64.b32encode(sha1), b"SHA-1:" + sha1.hex().upper().encode(), b"md5:" + hashlib.md5(block).hexdigest().encode(), b"odd:1"]
    assert [r.verified for r in warc.salvage(b"".join(map(record, good)))] == [True, True, True, False]
    wrong = [b"sha1:" + base64.b32encode(sha1[::-1]), b"sha1:" + sha1[::-1].hex().encode(), b"sha256:" + sha1.hex().encode()]
    for digest in wrong:
        assert [r.reason for r in warc.salvage(record(digest) + record(good[0]))] == ["block digest differs", ""]


def test_torn_records_are_skipped(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 60) for i in range(40)], "page_id long, url string, html string")
    path = warc.scratch_path(spark, "torn")
    warc.write_warc(pages, path, torn=F.col("id") % 7 == 3)
    rows = warc.read_warc(spark, path).collect()
    assert sorted(r.record_id for r in rows if r.reason is None) == list(range(40)) and sum(r.reason is not None for r in rows) == 6
    assert warc.round_trip(pages, torn_every=3).count() == 40


def test_curve_against_plain_version(spark, docs):
    """Cells by quantiles in plain Python, indexes of the curve from their own definition, and the order of the shards."""
    rows = [(i, f"t{i}", random.Random(i).choice(["en", "fr", None]), f"src{i * 7 % 13}", (i * 37) % 101 if i % 9 else None) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    dims = ["lang", "source", "n_chars"]
    edges = hilbert_shards.cuts(table, dims, 6)
    code = lambda v: v if v is None or isinstance(v, str) else float(v)
    for k, name in enumerate(dims):
        values = sorted(code(r[k + 2]) for r in rows if r[k + 2] is not None)
        assert edges[k] == [values[max(0, -(-len(values) * q // 64) - 1)] for q in range(1, 64)]
    cells = np.array([[0 if r[k + 2] is None else sum(e < code(r[k + 2]) for e in edges[k]) for k in range(3)] for r in rows])
    assert cells[:, 0].max() > 25 and cells[:, 1:].max(axis=0).min() > 50
    index = hilbert_shards.hilbert_index(cells, 6)
    got = hilbert_shards.hilbert_shards(table, 7).collect()
    assert {r.doc_id: r.curve for r in got} == dict(enumerate(index.tolist()))
    order = sorted(got, key=lambda r: (r.curve, r.text_crc32, r.doc_id))
    assert [(r.shard, r.slot) for r in order] == [(k * 7 // 400, k - -(-(k * 7 // 400) * 400 // 7)) for k in range(400)]


def test_filters_read_few_of_the_sharded_files(spark, tmp_path):
    """The share of 24 files that a filter on one, two or three dimensions must read, by the files' minimum and maximum."""
    import pyarrow.parquet as pq

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hilbert_shards.write_sharded(docs.withColumn("__curve", F.lit(1)), str(tmp_path / "out"), 24)
    spans = []
    for path in (tmp_path / "out").glob("*.parquet"):
        table = pq.read_table(path, columns=["n_chars", "source", "lang"])
        spans.append({c: (min(v), max(v)) for c in table.column_names for v in [table.column(c).drop_null().to_pylist()]})
    assert len(spans) >= 20
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()
    source, lang, size = docs.filter("lang <> 'en'").orderBy("doc_id").select("source", "lang", "n_chars").first()
    touched = lambda **want: sum(all(s[c][0] <= v <= s[c][1] for c, v in want.items()) for s in spans) / len(spans)
    assert touched(lang=lang) < 0.5 and touched(source=source) < 0.6 and touched(n_chars=size) < 0.6
    assert touched(source=source, n_chars=size) < 0.4 and touched(lang=lang, source=source, n_chars=size) < 0.3


def test_odd_hosts_and_dates(spark):
    urls = ["http://[2001:db8::1]:80/x", "http://10.0.0.1/", "https://u@1.2.3.4:8/", "http://1.2.3.example.com"]
    hosts = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(url_filter.host_of(F.col("u"))).collect()]
    assert hosts == ["[2001:db8::1]", "10.0.0.1", "1.2.3.4", "1.2.3.example.com"]
    pages = spark.createDataFrame([(i, u, d) for i, (u, d) in enumerate(zip(urls, ["2024-02-01", "no date", "2024-02-01", "2024-02-01 10:00:00"]))], "page_id long, url string, fetch_date string")
    entries = spark.createDataFrame([(k, "block", d) for k, d in [("[2001:db8::1]", "2024-01-01"), ("10.0.0.1", "2024-01-01"), ("3.4", "2024-01-01"), ("example.com", "2024-01-01"), ("example.com", "bad")]], "key string, action string, since string")
    got = {r.page_id: (r.list_key, r.blocked) for r in url_filter.judge_captures(pages, entries).collect()}
    assert got == {0: ("[2001:db8::1]", True), 1: (None, False), 2: (None, False), 3: ("example.com", True)}


def test_text_cells_of_long_common_prefixes(spark):
    """Values that differ only behind their first bytes spread over the cells, in order."""
    names = [f"{scheme}://a-long-name-of-a-host.example/site{k:03}" for scheme in ("http", "https") for k in range(40)]
    docs = spark.createDataFrame([(i, names[i % 80]) for i in range(4000)], "doc_id long, source string")
    edges = hilbert_shards.cuts(docs, ["source"], 6)[0]
    assert edges == sorted(edges, key=str.encode) and len(set(edges)) > 50
    cells = {r.source: r.c for r in docs.select("source", hilbert_shards.quantise(docs, "source", edges).alias("c")).distinct().collect()}
    assert [cells[n] for n in sorted(names)] == sorted(cells.values()) and len(set(cells.values())) > 50
    assert hilbert_shards.quantise(docs, "source", []) is not None and hilbert_shards.cuts(docs.limit(0), ["source", "doc_id"], 3) == [[], []]


def test_text_cuts_are_exact_quantiles(spark):
    """Of more rows than a sample would hold, half of them of one value, the cuts are the values at the ranks."""
    value = F.when(F.col("id") < 15_000, "00007").when(F.col("id") % 100 != 1, F.lpad(F.col("id").cast("string"), 5, "0"))
    docs = spark.range(30_000).select(value.alias("source"))
    values = sorted(["00007"] * 15_000 + [f"{i:05}" for i in range(15_000, 30_000) if i % 100 != 1])
    want = [values[-(-k * len(values) // 64) - 1] for k in range(1, 64)]
    assert hilbert_shards.cuts(docs, ["source"], 6) == [want]


def test_host_of_many_labels(spark):
    """60 000 labels: only parents of as many labels as keys have are asked for."""
    host = "a." * 59_998 + "example.com"
    pages = spark.createDataFrame([(1, f"http://{host}/x", "2024-02-02"), (2, "http://b.example.com.", "2024-02-02"), (3, "http://com", "2024-02-02")], "page_id long, url string, fetch_date string")
    entries = spark.createDataFrame([("example.com", "block", "2024-01-01"), ("a.example.com", "allow", "2024-02-03"), ("com", "block", "2024-01-01"), (None, "block", "2024-01-01")], "key string, action string, since string")
    began = time.perf_counter()
    got = {r.page_id: (r.list_key, r.blocked) for r in url_filter.judge_captures(pages, entries).collect()}
    assert got == {1: ("example.com", True), 2: (None, False), 3: (None, False)}
    assert time.perf_counter() - began < 60
    kept = spark.createDataFrame([("a.b.c",), ("b.c",), ("c",), ("1.2.3.4",), ("[::1]",), ("",)], "h string").select(url_filter.suffixes(F.col("h")), url_filter.suffixes(F.col("h"), sizes=[1, 2, 9])).collect()
    assert [tuple(r) for r in kept] == [(["a.b.c", "b.c"], ["b.c"]), (["b.c"], ["b.c"]), ([], []), (["1.2.3.4"], ["1.2.3.4"]), (["[::1]"], ["[::1]"]), ([], [])]


def test_hot_key_of_the_filter(spark):
    """Twenty million equal rows: counted in their tasks, so no task and no array holds them."""
    rows = spark.range(20_000_000).select(F.lit("same").alias("k")).unionByName(spark.createDataFrame([("once",), ("twice",), ("twice",)], "k string"))
    words = bloom_dedup.filter_words(rows, [F.col("k")], 20, 2)
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "partial_count" in plan
    assert words.count() == 2
    once, maybe = bloom_dedup.split_by(spark.createDataFrame([("once",), ("twice",), ("same",)], "k string"), [F.col("k")], words, 20)
    assert [r.k for r in once.collect()] == ["once"] and sorted(r.k for r in maybe.collect()) == ["same", "twice"]


def test_warc_headers_of_other_forms():
    """Folded lines belong to the header before; HTTP headers may end lines with LF; a block without blank line is all payload."""
    def record(block, more=b""):
        return b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http;\r\n msgtype=response\r\n" + more + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"

    found = warc.parse_record(record(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\n\nx"), 0)
    assert found.headers["content-type"] == "application/http; msgtype=response" and found.payload() == b"body\n\nx"
    assert warc.parse_record(record(b"HTTP/1.1 200 OK\nA: b\n\nbody"), 0).payload() == b"body"
    assert warc.parse_record(record(b"no header", b"X: 1\r\n\t2\r\n"), 0).payload() == b"no header"
