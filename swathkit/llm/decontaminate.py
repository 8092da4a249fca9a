"""Benchmark decontamination: short items inside long documents, by containment of word shingles.

Containment is the share of an item's shingles that a document has. The search is by MinHash,
partitioned by item size: items of 2**i to 2**(i+1)-1 shingles keep their k least shingle hashes,
where k is fixed per partition as floor((1 - threshold) * (2**(i+1) - 1)) + 1. A document that holds
the share `threshold` of an item misses fewer than k of its shingles, hence meets its sketch: the
search loses nothing, however long the document, which a banded MinHash of the document would.
Candidates are then verified on the shingles themselves.

Items go to every task in blocks of a measured size, a scan of the documents for each block; documents
are neither shuffled nor collected, and no shingle is too frequent for a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathkit.llm.shared import ALNUM, Words, binary_list, materialize, mix, slices

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SLICE = 1 << 18
BLOCK_BYTES = 16 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
OUT = "doc_id long, item_id long, item_shingles long, shared_shingles long, containment double"


def shingles(text: bytes, size: int) -> set[bytes]:
    """Distinct word shingles of a text; with fewer words the whole sequence, with none nothing."""
    words = _WORD.findall(text.lower())
    if len(words) <= size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def shingle_hashes(values: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of all shingles of several texts, repeats included; equal shingles have equal hashes."""
    words = Words([v.lower() for v in values], ALNUM)
    hashes, owner = words.hashes(), words.owner
    counts = np.bincount(owner, minlength=len(values))
    rolled = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for i in range(size):
        rolled = mix(rolled * _ODD + hashes[i : i + len(rolled)])
    whole = owner[: len(rolled)] == owner[size - 1 :] if len(rolled) else np.zeros(0, bool)
    owners, found = [owner[: len(rolled)][whole]], [rolled[whole]]
    first = np.cumsum(counts) - counts
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        value = np.zeros(len(short), np.uint64)
        for i in range(n):
            value = mix(value * _ODD + hashes[first[short] + i])
        owners.append(short)
        found.append(value)
    return np.concatenate(owners), np.concatenate(found)


def sketch_size(n: int, threshold: float) -> int:
    """Sketch length of an item with n shingles: that of its size partition."""
    largest = (1 << n.bit_length()) - 1
    return min(n, int((1 - threshold) * largest + 1e-9) + 1)


def _sketches(ids: list, texts: list[bytes], size: int, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sketch) of each item that has words."""
    for low, high in slices(texts, _SLICE):
        owner, found = shingle_hashes(texts[low:high], size)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(high - low + 1))
        for i in range(high - low):
            own = np.unique(found[order[cuts[i] : cuts[i + 1]]])
            if len(own):
                yield low + i, own[: sketch_size(len(own), threshold)]


def _verified(doc, text: bytes, items: list[tuple[object, set[bytes]]], size: int, threshold: float) -> Iterator[tuple]:
    own = shingles(text, size)
    for item, wanted in items:
        shared = len(wanted & own)
        if shared >= threshold * len(wanted) - 1e-9:
            yield doc, item, len(wanted), shared, shared / len(wanted)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "item_shingles", "shared_shingles", "containment"])


def _finder(ids: list, texts: list[bytes], size: int, threshold: float):
    """A function of document texts that looks them up in the sketches of these items: rows of OUT, with a text's place as its id."""
    index = list(_sketches(ids, texts, size, threshold))
    keys = np.concatenate([s for _, s in index]) if index else np.zeros(0, np.uint64)
    holder = np.concatenate([np.full(len(s), i) for i, s in index]) if index else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, holder = keys[order], holder[order]
    wanted: dict[int, set[bytes]] = {}

    def find(bodies: list[bytes]) -> list[tuple]:
        rows: list[tuple] = []
        for low, high in slices(bodies, _SLICE) if len(keys) else ():
            owner, found = shingle_hashes(bodies[low:high], size)
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == found)
            last = np.searchsorted(keys, found[hit], side="right")
            pairs = {(int(o), int(i)) for o, a, b in zip(owner[hit], at[hit], last) for i in holder[a:b]}
            by_doc: dict[int, list[int]] = {}
            for o, i in sorted(pairs):
                by_doc.setdefault(o, []).append(i)
            for o, items in by_doc.items():
                for i in items:
                    if i not in wanted:
                        wanted[i] = shingles(texts[i], size)
                rows += _verified(low + o, bodies[low + o], [(ids[i], wanted[i]) for i in items], size, threshold)
        return rows

    return find


def _scan(find):
    """Document batches to the rows of OUT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_pylist()
            yield _batch([(docs[at], *rest) for at, *rest in find(binary_list(batch.column(1)))])

    return run


def _drop(find, text_at: int):
    """Document batches, all columns, without the rows that hold an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[at for at, *_ in find(binary_list(batch.column(text_at)))]] = False
            yield batch.filter(pa.array(clean))

    return run


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of the items (item_id, text), in blocks of about so many bytes (measured first), each small enough for every task."""
    count, total = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()
    n = max(1, min(count, -(-total // max(1, block_bytes))))
    if n > 1:
        # By text: repeats of an item are together. Written once, as each block reads it.
        items = materialize(items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(n))), "items")
    for k in range(n):
        rows = (items.filter(F.col("block") == k) if n > 1 else items).select("item_id", "text").collect()
        if rows or not k:
            yield [r[0] for r in rows], [(r[1] or "").encode() for r in rows]


def _check(threshold: float) -> None:
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, item_shingles, shared_shingles, containment: every pair with containment of at least threshold.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case. Shingles
    are distinct; a text of fewer than `words` words has its whole sequence as only shingle. Items or
    documents that are null, empty or without words never match. Repeated rows on either side give
    repeated pairs; null ids stay null. Empty tables give no rows; other columns are not read.
    """
    _check(threshold)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    found = [docs.mapInArrow(_scan(_finder(*block, words, threshold)), OUT) for block in _blocks(items, block_bytes)]
    return reduce(DataFrame.unionByName, found)


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that hold no item, with all their columns, filtered where they are scanned.

    Each row is judged by its own text: ids may be null or repeat, and equal rows stay or go together.
    Null and empty texts stay. Of many blocks of items, each filters what the one before has left.
    """
    _check(threshold)
    items = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    text_at = [c.lower() for c in docs.columns].index(text_col.lower())
    for k, block in enumerate(_blocks(items, block_bytes)):
        docs = (materialize(docs, "clean") if k else docs).mapInArrow(_drop(_finder(*block, words, threshold), text_at), docs.schema)
    return docs
