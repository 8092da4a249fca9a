"""Secret scans, spelling variants and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathkit.llm import importance, secret_scan, spelling_variants
from swathkit.llm.crc_spans import joined, span_crcs
from swathkit.llm.guess_cost import KIND_BITS, dictionary, guess_bits

P = pytest.importorskip("public_tokenizers")
WORDS = P.path("word_bpe_49k.json")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEMA = "doc_id long, text string, id string, word string, n long, key string, score long, rank long, place long, bucket long, __text string, __redacted string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, *["x", "x", 1, "x", 1, 1, 1, 1, "x", "x"]) for i, t in rows], SCHEMA)


def _lower(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


# Checksums


def test_span_crcs_of_all_lengths():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 400_000, dtype=np.uint8)
    sizes = np.concatenate([np.arange(1, 400), rng.integers(400, 60_000, 40), [400_000]])
    starts = np.array([rng.integers(0, 400_000 - n + 1) for n in sizes])
    got = span_crcs(data, starts, starts + sizes)
    assert got.tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, sizes)]
    both = joined(got[:-1], got[1:], sizes[1:])
    assert both.tolist() == [zlib.crc32(data[a : a + n].tobytes() + data[b : b + m].tobytes()) for a, n, b, m in zip(starts, sizes, starts[1:], sizes[1:])]
    assert span_crcs(data, starts[:0], starts[:0]).tolist() == []


# Importance resampling


def _plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text))
    return words, [zlib.crc32(f.encode()) % 10_000 for f in [*words, *map(" ".join, zip(words, words[1:]))]]


def _plain_resample(rows, target):
    """(doc_id, n_features, weight, score, rank) by the definition, ids not null."""
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(_plain_features(text)[1])
    for text in target:
        t.update(_plain_features(text)[1])
    total, aim = sum(s.values()), sum(t.values())
    made, long = [], []
    for i, text in rows:
        words, found = _plain_features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (total + 10_000) / ((s[b] + 1) * (aim + 10_000)))) for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        row = (i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
        made.append(row)
        if len(words) >= 20:
            long.append(row)
    drawn = sorted(long, key=lambda r: (-r[3], r[0]))[: 25 * len(long) // 100]
    rank = {r[0]: k for k, r in enumerate(drawn, 1)}
    return sorted((*r, rank.get(r[0])) for r in made)


def _prose(seed, n, words=25):
    rng = random.Random(seed)
    some = ["".join(rng.choice(["th", "Er", "on", "an", "é", "ble", "9", "漢"]) for _ in range(rng.randint(1, 6))) for _ in range(200)]
    return [rng.choice([" ", ", ", "\n", "_", " - "]).join(rng.choice(some) for _ in range(rng.randint(0, 2 * words))) for _ in range(n)]


def test_resample_against_plain_version(spark):
    texts = [*_prose(1, 150), None, "", " .,", "x" * 3000, "Long " + "y" * 500 + " words " + "Z" * 64, "one two", *_prose(1, 2)]
    rows = [(3 * i - 40, t) for i, t in enumerate(texts)]
    target = [*_prose(2, 10), "one two three", None, ""]
    docs, aim = _docs(spark, rows), spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, aim)
    assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    want = _plain_resample(rows, target)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
    drawn = importance.draw(docs, aim)
    assert drawn.columns == docs.columns and sorted(r.doc_id for r in drawn.collect()) == [r[0] for r in want if r[4]]


def test_resample_of_odd_rows(spark):
    """Null and repeated ids, equal rows, no target, no documents."""
    long = " ".join(f"w{i}" for i in range(30))
    docs = _docs(spark, [(None, long), (None, long), (4, long), (4, long), (5, None), (6, "short"), *[(7, long)] * 20])
    got = importance.resample(docs, spark.createDataFrame([], "text string")).collect()
    assert len(got) == 26 and sorted(r.rank for r in got if r.rank) == list(range(1, 7))
    assert {(r.n_features, r.weight) for r in got if r.doc_id == 5} == {(0, 0)}
    everything = importance.resample(docs, docs, percent=100).collect()
    placed = [(r.score, r.doc_id) for r in sorted((r for r in everything if r.rank), key=lambda r: r.rank)]
    assert len(placed) == 24 and placed == sorted(placed, key=lambda p: (-p[0], p[1] is None, p[1] or 0))
    assert importance.resample(docs.limit(0), docs).count() == 0
    with pytest.raises(ValueError):
        importance.resample(docs, docs, percent=101)


def test_drawn_documents_resemble_the_target(spark):
    docs = _docs(spark, [*enumerate(_prose(5, 200, 60)), *((1000 + i, t) for i, t in enumerate(_prose(6, 200, 60)))])
    drawn = importance.draw(docs, spark.createDataFrame([(t,) for t in _prose(6, 100, 60)], "text string"))
    ids = [r.doc_id for r in drawn.collect()]
    assert sum(i >= 1000 for i in ids) > 0.7 * len(ids)


# Spelling variants


def _plain_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = _lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _plain_variants(rows):
    words, form, out = _plain_words(rows), {}, []
    near = {w: [v for v in words if _near(w, v)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def _misspelt(seed, texts=120):
    """Words of skewed frequency, with random slips, accents, capitals and chains of variants."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéèôñü") for _ in range(rng.randint(6, 9))) for _ in range(9)] + ["q" * 40, "q" * 41, "r" * 33 + "s", "r" * 33 + "t"]

    def slip(word):
        k = rng.randrange(len(word))
        return rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("abcxyÀÿ") + word[k:], word[:k] + rng.choice("abcxÿ") + word[k + 1 :]])

    pool = [(w, 200) for w in base]
    for word in base:
        other = slip(word)
        pool += [(other, 30), (slip(other), 5), (slip(word), 9), (slip(word), 5)]
    words, weights = zip(*pool)
    rows = [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, weights, k=rng.randint(0, 90)))) for i in range(texts)]
    return [(i, t.replace(" ", ", ") if i % 3 else t) for i, t in rows]


@pytest.mark.parametrize("chunk", [1 << 15, 7])
def test_variants_against_plain_version(spark, chunk):
    long = "z" * 100_000
    rows = [*_misspelt(4), (None, None), (None, "letter letter letters Letter letter LETTER"), (7, ""), (8, f"{long} {long} {long}x {long} {long} {long} " * 3)]
    docs = _docs(spark, rows)
    got = spelling_variants.spelling_variants(docs, chunk=chunk)
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    want = _plain_variants(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])


def test_slips_are_applied(spark):
    """Enough runs that some lose a letter, and with it the length that a word needs."""
    rows = [(i, " ".join(f"{c}abcdé{d} {c}{d}wxyzv" for c in LOWER[:8] for d in LOWER[:4])) for i in range(100)]
    assert dict(map(tuple, spelling_variants.word_counts(_docs(spark, rows)).collect())) == _plain_words(rows)
    assert set(_plain_words(rows).values()) != {100}


def test_chains_of_forms(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(26)] + [("w26", None), ("a", "w3"), ("b", "w26")]
    forms = spark.createDataFrame(chain, "word string, form string")
    for small in (1000, 0):
        assert {r.word: r.root for r in spelling_variants.roots(forms, small).collect()} == {w: "w26" for w, f in chain if f}


def test_variants_of_nothing(spark):
    assert spelling_variants.spelling_variants(_docs(spark, [(1, None), (2, "some words here")])).count() == 0
    assert spelling_variants.spelling_variants(_docs(spark, [(1, "x")]).limit(0)).count() == 0


# Secrets


def _plain_base(text):
    """Kind, start and end of what the patterns find, in code points."""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.I | re.A):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 16]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


SECRETS = [
    None, "", "no secrets", 'é Token = "7702344ead31d5951ffa625c69a7546f3a470a7f" end', "api_key:abc123 short", "APIKEY=x" + "y" * 11, "password==" + "a1" * 6, "AKIA" + "Z" * 14 + " AKIA" + "Z" * 13,
    "AKIAAKIA" + "9" * 10, "deadbeef" * 2 + " " + "deadbee" * 2, "漢字 secret: 'abcdefghijkl' and token=tokentokentoken", "passwd\"  :   'AAAAAAAAAAAAAAAA", "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop",
    "pwd: xK9#mQ2v!", "password: changeme", "passphrase=correcthorsebatterystaple9Q", "see https://user:Tg7!kk2Lp0@example.com/x", "auth: bearer Zx81!qPw4$", "password: Summer2024!", "api-key => q7#Vn2@xW8", "é password=abc@xK9#mQ2v^", "token=" + "a" * 50_000,
    "password: " + "xK9#mQ2v" * 3000,
]


@pytest.fixture(scope="module")
def secrets(spark):
    return _docs(spark, [(i, t) for i, t in enumerate(SECRETS)]).cache()


def test_secrets_against_plain_version(secrets):
    got = secret_scan.secret_digests(secrets, WORDS)
    assert got.columns[:4] + got.columns[5:] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(SECRETS)
    for i, text in enumerate(SECRETS):
        base = _plain_base(text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert rows[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [rows[i].n_assign, rows[i].n_access, rows[i].n_hex] == [sum(k == kind for k, *_ in base) for kind in ("assign", "access", "hex")]
        assert [s for s in rows[i].spans.split(",") if s and not s.startswith("guess")] == [s for s in listed.split(",") if s]


def test_values_that_are_hard_to_guess(spark, secrets):
    found = {}
    for r in secret_scan.locate(secrets, WORDS).collect():
        assert SECRETS[r.doc_id][r.start : r.end] == r.secret
        if r.kind == "guess":
            found[r.doc_id] = r.secret
    # Passwords that a guesser would try early are left alone, as are values that a pattern has.
    assert found == {13: "xK9#mQ2v", 15: "correcthorsebatterystaple9Q", 16: "Tg7!kk2Lp0", 17: "Zx81!qPw4$", 19: "q7#Vn2@xW8", 20: "abc@xK9#mQ2v^", 22: "xK9#mQ2v" * 3000}


def _plain_guess(text, known):
    """The least sum over all cuts, where parts are only words, single years and brute-force spans."""
    spans = ((str.islower, 3.0), (str.isupper, 3.0), (str.isdigit, math.log2(10)), (lambda c: c.islower() or c.isdigit(), math.log2(36)), (lambda c: c.isupper() or c.isdigit(), math.log2(36)), (str.isalnum, math.log2(62)), (lambda c: True, math.log2(95)))
    best = [0.0] + [math.inf] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(j):
            part = text[i:j]
            costs = [bits * len(part) for allowed, bits in spans if all(map(allowed, part))]
            if part in known:
                costs.append(known[part])
            if len(part) == 4 and part.isdigit() and 1900 <= int(part) <= 2050:
                costs.append(math.log2(151))
            best[j] = min(best[j], best[i] + KIND_BITS + min(costs))
    return best[-1]


def test_guess_bits():
    known = dictionary(WORDS)
    bits = lambda text: guess_bits(text, known)
    for text in ("horsequ", "xqplant", "Kz7Pw", "horse1987", "a#Tb", "battery9"):
        assert bits(text) == pytest.approx(_plain_guess(text, known))
    assert bits("") == 0 and bits("é") > 0
    assert bits("20240131") < bits("20249931") and bits("2024-01-31") < bits("2024#01&31")
    assert bits("zxcvbnm") < bits("zxqvhnm") and bits("ZXCVBNM<") < 15
    assert bits("xq9!" * 6) == pytest.approx(KIND_BITS + bits("xq9!") + math.log2(6))
    assert bits("horse") < bits("Horse") <= bits("h0rse") < bits("hxrsq")
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["horse", "12", "aa", "qwert", "1999", "#", "Zk"]) for _ in range(rng.randint(1, 7)))
        for enough in (10.0, 25.0, 40.0):
            assert guess_bits(text, known, enough) == pytest.approx(min(bits(text), enough))


def test_redacted(spark, secrets):
    got = secret_scan.redact(secrets, WORDS)
    assert got.columns == secrets.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[0].text is None and rows[2].text == "no secrets" and rows[2]["__text"] == "x" and rows[3].text == 'é [secret]" end'
    assert rows[16].text == "see https://user:[secret]@example.com/x"
    assert secret_scan.secret_digests(got, WORDS).filter("n_assign + n_access + n_hex + n_guess > 0").count() == 0
    assert secret_scan.redact(secrets.limit(0), WORDS).count() == 0 and secret_scan.locate(secrets.limit(0), WORDS).count() == 0


def test_secrets_of_rows_without_ids(spark):
    docs = _docs(spark, [(None, "AKIA" + "Z" * 14), (None, "AKIA" + "Z" * 14), (3, None), (3, "x")])
    got = secret_scan.secret_digests(docs, WORDS).collect()
    assert sorted((str(r.doc_id), r.n_access) for r in got) == [("3", 0), ("3", 0), ("None", 1), ("None", 1)]
    assert secret_scan.secret_digests(docs.limit(0), WORDS).count() == 0
