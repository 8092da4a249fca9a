"""Substring dedup by prefix doubling over the positions that can repeat.

A byte goes when a string of `length` bytes that covers it also starts earlier (a smaller document
id, or the same document and an earlier start). A document is an id and a text: beside its id, each
carries a hash of its text, by which texts of one id are told apart and ordered.

1. Anchors. Of every window of `length` bytes, the 32-byte grams of least hash are anchors, so equal
   windows hold equal anchors at equal places. Each task first compares its own, so periodic texts
   and near copies don't gather; one shuffle by the gram's hash then brings equal anchors together. An anchor whose whole neighbourhood (all windows that can hold it) also occurs earlier
   makes all its windows repeats. Where a gram has one neighbourhood only, there are no other
   repeats. Both kinds end here, which is nearly all of the corpus.
2. Prefix doubling, for the rest: grams with several neighbourhoods. The first occurrence of each
   neighbourhood is fetched from its text. Names of prefixes are paired with the names at growing
   offsets (1, 2, 4 ... 32, then `length` - 64) and renamed, until the names stand for `length`
   bytes; a position whose name occurs earlier starts a repeat. Positions can only equal positions
   at the same distance from the same gram, so Spark sorts the neighbourhoods by gram and each task
   doubles the few of a gram together. Grams with more than `group_limit` neighbourhoods would be
   unbounded there: for those, Spark itself groups the rank pairs of single positions, with
   map-side combine.
3. The repeated spans go back to their documents, which are cut and hashed.

Names are 64-bit hashes of the pair rather than running numbers: doubling needs only equal names for
equal prefixes, and running numbers would cost a global sort of all positions in each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swathkit.llm.shared import binary_list, materialize, mix, slices

GRAM = 32
SLICE = 1 << 15
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_ANCHORS = "gram long, around long, doc_id long, text_key long, pos long, head int, tail int, later boolean"
#: Anchors that are compared within the task before the shuffle.
MEET = 250_000
_NULL_ID = -(1 << 63)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each place; places near the end hash what a zero padding gives."""
    h = np.zeros(len(data) + GRAM, np.uint64)
    h[: len(data)] = data
    h += np.uint64(1)
    width = 1
    for step in _STEP:
        n = len(h) - width
        joined = h[:n] * step
        joined += h[width:]
        joined ^= joined >> np.uint64(29)
        h, width = joined, width * 2
    return mix(h[: len(data)])


def sliding(values: np.ndarray, width: int, pick, fill) -> np.ndarray:
    """pick (minimum or maximum) over values[i : i + width], the end padded by fill."""
    out = np.concatenate((values, np.full(width - 1, fill, values.dtype)))
    span = 1
    while span * 2 <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = pick(out[: len(values)], out[width - span : width - span + len(values)])
    return out[: len(values)]


def find_anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of the documents data[offsets[i]:offsets[i+1]]: document index, place, gram and neighbourhood hash, bytes before and after."""
    reach = length - GRAM
    sizes = np.diff(offsets)
    ends = np.repeat(offsets[1:], sizes)
    here = np.arange(len(data))
    h = gram_hashes(data)
    h[h == 0] = np.uint64(1)
    keyed = np.where(here + GRAM <= ends, h, np.uint64(0xFFFFFFFFFFFFFFFF))
    least = sliding(keyed, reach + 1, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))
    least[here + length > ends] = 0
    most = sliding(least[::-1], reach + 1, np.maximum, np.uint64(0))[::-1]
    at = np.flatnonzero(keyed == most)
    owner = np.searchsorted(offsets, at, side="right") - 1
    low = np.maximum(at - reach, offsets[owner])
    high = np.minimum(at + length, offsets[owner + 1])
    around = (at - low).astype(np.uint64) * np.uint64(1000003) + (high - low).astype(np.uint64)
    for j in range(-(-(2 * length - GRAM) // GRAM)):
        around = mix(around * _STEP[0] + h[low + np.minimum(GRAM * j, high - low - GRAM)])
    return owner, at, h[at], around, at - low, high - at


def _later(gram: np.ndarray, around: np.ndarray, doc: np.ndarray, text: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which anchors have an equal one (gram and neighbourhood) at an earlier place among these."""
    key = mix(gram * _STEP[1] + around)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    shared = np.zeros(len(key), bool)
    shared[1:] |= same
    shared[:-1] |= same
    some = order[shared]
    some = some[np.lexsort((pos[some], text[some], doc[some], key[some]))]
    new = np.ones(len(some), bool)
    new[1:] = key[some[1:]] != key[some[:-1]]
    first = some[new][np.cumsum(new) - 1]
    later = np.zeros(len(key), bool)
    later[some] = (gram[some] == gram[first]) & (around[some] == around[first]) & ((doc[some] != doc[first]) | (text[some] != text[first]) | (pos[some] != pos[first]))
    return later


def _anchor_rows(held: list[tuple]) -> pa.RecordBatch:
    doc = pa.concat_arrays([h[0] for h in held])
    text, gram, around, pos, head, tail = (np.concatenate(c) for c in zip(*(h[1:] for h in held)))
    order = doc.fill_null(_NULL_ID).to_numpy()
    later = _later(gram, around, order, text, pos)
    # What is known to repeat needs no meeting with its equals: it is spread by its place instead of gathering at a hot gram.
    gram = np.where(later, mix(order.view(np.uint64) * _STEP[2] + mix(text.view(np.uint64)) + pos.view(np.uint64)), gram)
    columns = [pa.array(gram.view(np.int64)), pa.array(around.view(np.int64)), doc, pa.array(text), pa.array(pos), pa.array(head.astype(np.int32)), pa.array(tail.astype(np.int32)), pa.array(later)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ANCHORS.split(", ")])


def _anchor_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            texts = binary_list(batch.column(1))
            # Without a third column ids are unique.
            text_keys = batch.column(2).to_numpy() if batch.num_columns > 2 else np.zeros(batch.num_rows, np.int64)
            for first, last in slices(texts, SLICE):
                for owner, at, *rest in _pieces(texts[first:last], length):
                    gram, around, head, tail = rest
                    held.append((batch.column(0).take(pa.array(first + owner)), text_keys[first + owner], gram, around, at.astype(np.int64), head, tail))
                    n += len(at)
                    if n >= MEET:
                        yield _anchor_rows(held)
                        held, n = [], 0
        if held:
            yield _anchor_rows(held)

    return run


def _pieces(part: list[bytes], length: int):
    """Anchors with places inside their document. A document longer than a slice is taken in overlapping pieces."""
    if len(part) == 1 and len(part[0]) > 2 * SLICE:
        data, halo = np.frombuffer(part[0], np.uint8), 2 * length
        for cut in range(0, len(data), SLICE):
            low, high = max(0, cut - halo), min(len(data), cut + SLICE + halo)
            owner, at, gram, around, head, tail = find_anchors(data[low:high], np.array([0, high - low]), length)
            mine = (at + low >= cut) & (at + low < cut + SLICE)
            yield owner[mine], at[mine] + low, gram[mine], around[mine], head[mine], tail[mine]
        return
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))))
    if offsets[-1]:
        owner, at, *rest = find_anchors(np.frombuffer(b"".join(part), np.uint8), offsets, length)
        yield owner, at - offsets[owner], *rest


def _windows(contexts: list[bytes], heads: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the two halves' pairs for each window of each context, aligned at the gram: first and second name, and which windows exist."""
    reach = length - GRAM
    width = reach + length
    joined = b"".join(c.rjust(len(c) + reach - int(h), b"\0").ljust(width, b"\0") for c, h in zip(contexts, heads))
    names = np.frombuffer(joined, np.uint8).reshape(len(contexts), width).astype(np.uint64) + np.uint64(1)
    span = 1
    while span * 2 <= length:
        names = mix(names[:, :-span] * _STEP[span.bit_length() % 5] + names[:, span:])
        span *= 2
    column = np.arange(reach + 1)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    low = reach - heads.astype(np.int64)
    exists = (column >= low[:, None]) & (column + length <= (low + sizes)[:, None])
    return names[:, : reach + 1], names[:, length - span : length - span + reach + 1], exists


def _fetch(length: int, single: bool):
    """From documents with the places to look at: the neighbourhoods' bytes, or if single the rank pairs of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, text_keys, places = batch.column(0).to_pylist(), binary_list(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            rows: list[tuple] = []
            for doc, text, text_key, found in zip(ids, texts, text_keys, places):
                for x in found:
                    rows.append((x["gram"], doc, text_key, x["pos"], x["head"], text[x["pos"] - x["head"] : x["pos"] + x["tail"]]))
            for k in range(0, len(rows), 2000):
                gram, doc, text_key, pos, head, context = zip(*rows[k : k + 2000])
                columns = {"gram": pa.array(gram, pa.int64()), "doc_id": pa.array(doc, pa.int64()), "text_key": pa.array(text_key, pa.int64()), "pos": pa.array(pos, pa.int64())}
                if not single:
                    yield pa.RecordBatch.from_pydict(columns | {"head": pa.array(head, pa.int32()), "context": pa.array(context, pa.binary())})
                    continue
                first, second, exists = _windows(list(context), np.array(head), length)
                row, column = np.nonzero(exists)
                starts = np.array(pos, np.int64)[row] + column - (length - GRAM)
                yield pa.RecordBatch.from_pydict({"rank": first[exists].view(np.int64), "rank_on": second[exists].view(np.int64), "doc_id": columns["doc_id"].take(pa.array(row)), "text_key": columns["text_key"].take(pa.array(row)), "pos": starts})

    return run


def _double(length: int):
    """Neighbourhoods sorted by gram, document and place -> spans that start with a repeat. Works on whole grams, some thousand neighbourhoods at a time."""

    def spans(table: pa.Table) -> pa.RecordBatch:
        gram, text, pos = (table.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "text_key", "pos"))
        doc = pc.fill_null(table.column("doc_id"), _NULL_ID).to_numpy()
        heads = table.column("head").to_numpy()
        names, rest, exists = _windows(table.column("context").to_pylist(), heads, length)
        column = np.arange(names.shape[1], dtype=np.uint64)
        keys = mix(names * _STEP[3] + mix(rest + mix(gram.view(np.uint64))[:, None] + column * _STEP[1]))
        row, at = np.nonzero(exists)
        _, first, back = np.unique(keys[exists], return_index=True, return_inverse=True)
        earliest = row[first][back]
        again = np.zeros(exists.shape, bool)
        again[row, at] = (doc[earliest] != doc[row]) | (text[earliest] != text[row]) | (pos[earliest] != pos[row])
        edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (row, low), (_, high) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        base = pos[row] - (length - GRAM)
        return pa.RecordBatch.from_pydict({"doc_id": table.column("doc_id").take(pa.array(row)).combine_chunks(), "text_key": text[row], "start": base + low, "stop": base + high - 1 + length})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < 2000:
                continue
            table = pa.Table.from_batches(held)
            last = table.column("gram")[n - 1].as_py()
            cut = int(np.searchsorted(table.column("gram").to_numpy() == last, True))
            for piece in _whole_grams(table.slice(0, cut)):
                yield spans(piece)
            held, n = table.slice(cut).to_batches(), n - cut
        if n:
            for piece in _whole_grams(pa.Table.from_batches(held)):
                yield spans(piece)

    return run


def _whole_grams(table: pa.Table, rows: int = 3000) -> Iterator[pa.Table]:
    """Pieces of about so many rows that end with a gram."""
    gram = table.column("gram").to_numpy()
    ends = np.append(np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(gram)) if len(gram) else []
    low = 0
    for i, end in enumerate(ends):
        if end - low >= rows or i == len(ends) - 1:
            yield table.slice(low, end - low)
            low = end


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, runs, kept = [], [], [], []
        for text, found in zip(binary_list(batch.column(1)), batch.column(2).to_pylist()):
            merged: list[list[int]] = []
            for low, high in sorted((x["start"], min(x["stop"], len(text))) for x in found or () if x["start"] < len(text)):
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            digest, at = hashlib.sha256(), 0
            for low, high in merged:
                digest.update(text[at:low])
                at = high
            digest.update(text[at:])
            sizes.append(len(text))
            removed.append(sum(high - low for low, high in merged))
            runs.append(merged)
            kept.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(map(len, runs), pa.int64()), pa.array(kept, pa.string()), pa.array(runs, pa.list_(pa.list_(pa.int64())))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, group_limit: int = 1000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans ([start, stop] of each maximal removed run), one row per row of docs.

    length is at least 64 and at most 128. Null texts are empty. A null id comes before all others.
    Rows that repeat an id and its text are one document and don't count as copies of each other;
    texts that share an id (or have none) but differ are different documents, in the order of a hash
    of the text. Empty tables give empty results;
    other columns are not read.
    """
    if not 64 <= length <= 128:
        raise ValueError("length must lie in 64 to 128")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    place = F.struct("doc_id", "text_key", "pos")
    anchors = docs.mapInArrow(_anchor_batches(length), _ANCHORS).repartition("gram")
    same, gram = Window.partitionBy("gram", "around"), Window.partitionBy("gram")
    anchors = anchors.withColumn("first", F.min(place).over(same)).withColumn("repeat", F.col("later") | (place != F.col("first")))
    anchors = anchors.withColumn("n", F.sum(F.when(F.col("repeat"), 0).otherwise(1)).over(gram))
    found = materialize(anchors.filter("repeat or n > 1").select("gram", "doc_id", "text_key", "pos", "head", "tail", "repeat", "n"), "anchors")

    of_doc = F.col("doc_id").eqNullSafe(F.col("other")) & (F.col("text_key") == F.col("other_key"))

    def texts(places: DataFrame) -> DataFrame:
        other = places.groupBy(F.col("doc_id").alias("other"), F.col("text_key").alias("other_key")).agg(F.collect_set(F.struct("gram", "pos", "head", "tail")).alias("places"))
        return docs.join(other, of_doc).select("doc_id", "text", "text_key", "places")

    few = texts(found.filter(f"not repeat and n <= {group_limit}")).mapInArrow(_fetch(length, False), "gram long, doc_id long, text_key long, pos long, head int, context binary")
    few = few.repartition("gram").sortWithinPartitions("gram", "doc_id", "text_key", "pos").mapInArrow(_double(length), "doc_id long, text_key long, start long, stop long")
    many = texts(found.filter(f"not repeat and n > {group_limit}")).mapInArrow(_fetch(length, True), "rank long, rank_on long, doc_id long, text_key long, pos long")
    least = many.groupBy("rank", "rank_on").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    many = many.join(least, ["rank", "rank_on"]).filter(place != F.col("first")).select("doc_id", "text_key", F.col("pos").alias("start"), (F.col("pos") + length).alias("stop"))
    whole = found.filter("repeat").select("doc_id", "text_key", (F.col("pos") - F.col("head")).alias("start"), (F.col("pos") + F.col("tail")).alias("stop"))
    spans = whole.unionByName(few).unionByName(many).groupBy(F.col("doc_id").alias("other"), F.col("text_key").alias("other_key")).agg(F.collect_set(F.struct("start", "stop")).alias("found"))
    return docs.join(spans, of_doc, "left").select("doc_id", "text", "found").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"
    )
