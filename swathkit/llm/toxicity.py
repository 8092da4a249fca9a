"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's probability is a logistic model over hashed features of its words (the whole word and
its first four, five and six bytes) that point to toxic documents; a sentence with none of them has
probability 0, so that long clean documents don't add up to a toxic one. A document's is the
noisy-or of its sentences, 1 - product(1 - p), and the loss is taken there, so the gradient finds the sentences that explain a
label. Training runs on at most `max_train` labelled documents, those of least id hash, and on the
`FEATURES` features that tell most about their labels, which Spark counts; what their sentences have of
these is the only thing that goes through the driver. Scoring reads all of every text, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathkit.llm.shared import LETTERS, Words, binary_list, materialize, mix, slices

MAX_TRAIN = 8_000
BITS = 22
FEATURES = 4_096
#: Standard errors of the log odds.
CERTAIN = 3.3
_SLICE = 1 << 17
_PIECE = 1 << 22
_PREFIXES = (4, 5, 6)
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n\r")] = True
_BETWEEN = re.compile(rb"[^A-Za-z\x80-\xff]")


@dataclass
class Model:
    weights: np.ndarray  # of 2**BITS features, float32
    bias: float


def _features(words: Words) -> np.ndarray:
    """Feature numbers, one row per word: the word and its prefixes. Number 0 has no weight."""
    whole = words.hashes()
    out = [whole]
    sizes = words.ends - words.starts
    for n in _PREFIXES:
        part = mix(words.hashes(n) + np.uint64(n))
        out.append(np.where(sizes > n, part, np.uint64(0)))
    return (np.stack(out, axis=1) & np.uint64((1 << BITS) - 1)).astype(np.int32)


def _sentences(words: Words) -> np.ndarray:
    """Sentence number of each word; a number never spans two texts."""
    marks = np.concatenate(([0], np.cumsum(_ENDS[words.data])))
    mark = marks[words.starts]
    new = np.ones(len(mark), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (words.owner[1:] != words.owner[:-1])
    return np.cumsum(new) - 1


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def train(labels: np.ndarray, owner: np.ndarray, at: np.ndarray, feature: np.ndarray, epochs: int = 80, rate: float = 0.15, decay: float = 2e-6) -> Model:
    """Fit by full-batch Adam. labels: of the documents; owner: the document of each sentence with evidence; at, feature: which sentence has which feature."""
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    used, feature = np.unique(feature, return_inverse=True)
    w, bias, base = np.zeros(len(used)), -2.0, len(owner)
    grads = [np.zeros(len(used) + 1), np.zeros(len(used) + 1)]
    for step in range(1, epochs + 1):
        z = bias + np.bincount(at, w[feature], minlength=base)
        p = _sigmoid(z)
        clean = np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(labels)))
        toxic = np.clip(1 - clean, 1e-7, 1 - 1e-7)
        # d loss / d z of a sentence: -p for a toxic label scaled by clean / toxic, +p for a clean one.
        pull = np.where(labels == 1, -(1 - toxic) / toxic, 1.0)[owner] * p / len(labels)
        g = np.append(np.bincount(feature, pull[at], minlength=len(used)) + decay * w, pull.sum())
        grads[0] = 0.9 * grads[0] + 0.1 * g
        grads[1] = 0.99 * grads[1] + 0.01 * g * g
        move = rate * (grads[0] / (1 - 0.9**step)) / (np.sqrt(grads[1] / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return Model(weights, float(bias))


def _telling(joined: DataFrame, toxic: int, clean: int) -> np.ndarray:
    """The features whose share of toxic documents is larger beyond chance, FEATURES at most, counted once per document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for text, label in zip(binary_list(batch.column(0)), batch.column(1).to_pylist()):
                for piece, _ in _pieces(text):
                    sums[label, np.unique(_features(Words([piece.lower()], LETTERS)))] += 1
        seen = np.flatnonzero(sums.any(axis=0))
        for k in range(0, len(seen), 1 << 16):
            some = seen[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[1, some].astype(np.int64)), pa.array(sums[0, some].astype(np.int64))], names=["feature", "in_toxic", "in_clean"])

    counts = joined.mapInArrow(count, "feature long, in_toxic long, in_clean long").groupBy("feature").agg(*[(F.sum(c) + 0.5).alias(c) for c in ("in_toxic", "in_clean")])
    odds = F.log(F.col("in_toxic") / (toxic + 1)) - F.log(F.col("in_clean") / (clean + 1))
    scored = counts.withColumn("z", odds / F.sqrt(1 / F.col("in_toxic") + 1 / F.col("in_clean"))).filter((F.col("feature") != 0) & (F.col("z") > CERTAIN))
    return np.array([r[0] for r in scored.orderBy(F.desc("z"), "feature").limit(FEATURES).select("feature").collect()], np.int64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """Learn from labelled documents: at most max_train of them, those whose id has the least hash.

    Labels other than 0 and 1 and null labels are left out; a label row repeated for an id counts once
    (the larger label). Without labels of both kinds the model gives the same score to all texts. The
    driver gets the sentences that have a telling feature, as numbers, not the texts.
    """
    marked = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    marked = marked.groupBy("label_id").agg(F.max("label").alias("label"))
    # The bound is applied to the labels, so only that many texts are fetched.
    marked = marked.orderBy(F.xxhash64("label_id"), "label_id").limit(max_train)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined = materialize(texts.join(F.broadcast(marked), F.col("doc_id") == F.col("label_id")).select("text", "label"), "labelled")
    toxic, clean = (int(x or 0) for x in joined.agg(F.sum("label"), F.sum(1 - F.col("label"))).first())
    if not toxic or not clean:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    common = np.zeros(1 << BITS, bool)
    common[_telling(joined, toxic, clean)] = 1
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value, 0.0)
        for batch in batches:
            found = [_sentences_of(text, model) for text in binary_list(batch.column(0))]
            columns = [pa.array([x[k].astype(np.int32).tobytes() for x in found], pa.binary()) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *columns], names=["label", "at", "features"])

    rows = joined.mapInArrow(evidence, "label int, at binary, features binary").toArrow()
    at, feature, owner, base = [], [], [], 0
    # In an order that doesn't depend on how the rows are dealt.
    order = sorted(range(rows.num_rows), key=lambda i: (rows.column("label")[i].as_py(), rows.column("at")[i].as_py(), rows.column("features")[i].as_py()))
    for k, i in enumerate(order):
        there, numbers = np.unique(np.frombuffer(rows.column("at")[i].as_py(), np.int32), return_inverse=True)
        at.append(numbers + base)
        feature.append(np.frombuffer(rows.column("features")[i].as_py(), np.int32))
        owner.append(np.full(len(there), k))
        base += len(there)
    return train(rows.column("label").to_numpy()[order], np.concatenate(owner), np.concatenate(at), np.concatenate(feature))


def _pieces(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """A long text in pieces, and whether the sentence at a piece's end goes on: cut where a sentence ends, else between words, else not at all."""
    at = 0
    while len(text) - at > _PIECE:
        low, high = at + _PIECE // 2, at + _PIECE
        cut = max(text.rfind(mark, low, high) for mark in (b".", b"!", b"?", b"\n", b"\r"))
        ended = cut >= 0
        if not ended:
            between = _BETWEEN.search(text, low)
            cut = between.start() if between else len(text)
        yield text[at : cut + 1], not ended and cut < len(text)
        at = cut + 1
    yield text[at:], False


def _judge(values: list[bytes], model: Model) -> tuple[np.ndarray, ...]:
    """Sentences of several texts: owner, first byte, end; and which of them have which features with weight, each once."""
    words = Words([v.lower() for v in values], LETTERS)
    if not len(words.starts):
        return (np.zeros(0, np.int64),) * 5
    number = _sentences(words)
    first = np.flatnonzero(np.diff(number, prepend=-1))
    features = _features(words)
    # Within a sentence a feature counts once, as in training; only features with weight need the check.
    row, column = np.nonzero(model.weights[features])
    pairs = np.unique(number[row].astype(np.int64) << BITS | features[row, column])
    owner = words.owner[first]
    last = np.append(first[1:], len(number)) - 1
    return owner, words.starts[first] - words.offsets[owner], words.ends[last] - words.offsets[owner], pairs >> BITS, pairs & ((1 << BITS) - 1)


def _probability(n: int, at: np.ndarray, feature: np.ndarray, model: Model) -> np.ndarray:
    """Of n sentences; 0 without evidence."""
    z = model.bias + np.bincount(at, model.weights[feature], minlength=n)
    return np.where(np.bincount(at, minlength=n) > 0, _sigmoid(z), 0.0)


def _sentences_of(text: bytes, model: Model) -> tuple[np.ndarray, ...]:
    """Sentences of one text, read piece by piece: first byte, end; and which of them have which features."""
    starts, ends, ats, features = [], [], [], []
    base = n = 0
    goes_on = False
    for piece, more in _pieces(text):
        _, start, end, at, feature = _judge([piece], model)
        if len(start):
            # The first one is the last of the piece before, if no sentence ends before its first word.
            same = goes_on and n > 0 and not _ENDS[np.frombuffer(piece[: start[0]], np.uint8)].any()
            if same:
                ends[-1][-1] = end[0] + base
            starts.append(start[same:] + base)
            ends.append(end[same:] + base)
            ats.append(at + n - same)
            features.append(feature)
            n += len(start) - same
            if same and not len(ends[-1]):
                ends.pop()
        elif goes_on and _ENDS[np.frombuffer(piece, np.uint8)].any():
            more = False
        goes_on = more
        base += len(piece)
    if not n:
        return (np.zeros(0, np.int64),) * 4
    pairs = np.unique(np.concatenate(ats).astype(np.int64) << BITS | np.concatenate(features))
    return np.concatenate(starts), np.concatenate(ends), pairs >> BITS, pairs & ((1 << BITS) - 1)


def _document_scores(texts: list[bytes], model: Model) -> tuple[np.ndarray, ...]:
    """Per text: score, number of sentences, and the byte span of the likeliest sentence (0, 0 without evidence)."""
    clean = np.zeros(len(texts))
    count, low, high = (np.zeros(len(texts), np.int64) for _ in range(3))
    for a, b in slices(texts, _SLICE):
        if b - a > 1:
            owner, start, end, at, feature = _judge(texts[a:b], model)
            owner = owner + a
        else:
            start, end, at, feature = _sentences_of(texts[a], model)
            owner = np.full(len(start), a)
        p = _probability(len(start), at, feature, model)
        clean += np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(texts))
        count += np.bincount(owner, minlength=len(texts))
        best = np.lexsort((start, -p, owner))
        best = best[np.diff(owner[best], prepend=-1) != 0]
        best = best[p[best] > 0]
        low[owner[best]], high[owner[best]] = start[best], end[best]
    return np.abs(np.expm1(clean)), count, low, high


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below threshold, with all their columns. Null and empty texts score 0; each row is judged alone, ids may be null or repeat; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = _document_scores(binary_list(batch.column(at)), Model(*shared.value))[0]
            yield batch.filter(pa.array(value < threshold))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted (1 if score >= threshold), n_sentences, worst_start, worst_end: one row per row of docs.

    worst_* are the byte span of the likeliest sentence. A text without evidence, as an empty or null
    one, has the score 0 and null spans. Ids may be null or repeat; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, count, low, high = _document_scores(binary_list(batch.column(1)), Model(*shared.value))
            none = high == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(value), pa.array((value >= threshold).astype(np.int32)), pa.array(count), pa.array(low, mask=none), pa.array(high, mask=none)],
                names=["doc_id", "score", "predicted", "n_sentences", "worst_start", "worst_end"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int, n_sentences long, worst_start long, worst_end long")


def locate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end, score, sentence: the sentences whose own probability is at least threshold, by byte span."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        for batch in batches:
            texts = binary_list(batch.column(1))
            rows = []
            for i, text in enumerate(texts):
                start, end, at, feature = _sentences_of(text, known)
                p = _probability(len(start), at, feature, known)
                rows += [(i, int(s), int(e), float(q), text[s:e].decode(errors="replace")) for s, e, q in zip(start, end, p) if q >= threshold]
            at, start, end, p, sentence = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(p, pa.float64()), pa.array(sentence, pa.string())], names=["doc_id", "start", "end", "score", "sentence"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, start long, end long, score double, sentence string")
