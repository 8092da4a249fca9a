"""Language-model scoring by logistic context mixing of hashed-context bit predictors.

A text is a sequence of words, each with a blank, and an end. Its bytes are predicted bit by bit. The
predictors look up how often a bit was 0 or 1 after a context: the word so far (its tokens, and its
distinct words), the word so far together with a context that crosses the border of words, and, in
hashed tables, the 2 or 4 bytes before with that context too. The context across words
is the last character beyond ASCII that the document had before this word: it tells languages apart.
The logits are mixed by weights that a gate selects (how often the contexts were seen, and the place
in the word); an adaptive table over gate and mixed probability refines the result. The bits of a
word add up to its probability, and within a document that is refined by what the document had
before: the n-th word after a context has probability (k + a P) / (n - 1 + a), k its earlier
occurrences there, mixed over several a. So the whole is a distribution over all sequences of words.

A word's bits depend on the word and that one context, so they are computed once for each pair of
the two, called a unit, not at each occurrence. Spark counts the units of all documents and sorts
them; in their order, the counts of a word so far are sums over neighbours, exact however large the
corpus. Units that share a prefix are in one task, and the few bytes before that prefix is complete
are counted in a table of prefixes. A prefix that very many units share is made longer.

Weights and refinement are learnt online, in blocks of units: from every training unit, weighed by
its tokens, with the counts of one document taken out. Each part of some 65 000 units is learnt from
on its own; the means over these parts, weighted by how often each
weight was used, are the model.

Texts are scored by joining their units to the table of units. The most frequent units, a fixed
number, are broadcast and scored where the text is read; only the others are shuffled, and no
frequent word can gather in one task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathkit.llm.shared import binary_list, materialize, mix

END = b"\n"
#: Bytes that the hashed contexts take from the word so far, and whether the context across words is part.
ORDERS = ((1, 1), (2, 1), (3, 1), (4, 1))
#: The slots of an order grow with the units of training, eight for each, between these bounds: 17 MB of counts at most.
MIN_BITS, MAX_BITS = 16, 21
#: Longer words are units by pieces of so many bytes.
PIECE = 32
#: The context of pieces that continue a word, and of rows that only count whole long words.
GOES_ON, WHOLE = 1, -1
#: First prefix, and how many units may share one before it is made longer.
PREFIX, SHARED = 3, 1 << 18
#: Units that are learnt from together; of fewer units than LEAST in all, each part goes over its own several times.
PART, LEAST = 1 << 16, 1 << 19
BLOCK = 16384
CHUNK = 1 << 13
HEAVY = 100_000
URNS = (30.0, 300.0, 3_000.0, 30_000.0)
_LOG_URNS = np.log(URNS)
_FLUSH = 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LN10 = float(np.log(10.0))
_PRIOR = np.float32(0.4)
_SEEN, _PLACES, _BUCKETS = 8, 4, 33
GATES = _SEEN * _SEEN * _PLACES
#: Tokens and distinct words after the word so far, tokens with the context across words, the hashed orders, a constant.
INPUTS = 3 + len(ORDERS) + 1
_BEYOND_ASCII = re.compile(rb"[\x80-\xff]{2,}")
_UNIT = "word binary, context int, train long, docs long, held long"


def _context(word: bytes, before: int) -> int:
    """The context after a word: 0, or 2 to 255 by the last character beyond ASCII so far."""
    if word.isascii():
        return before
    found = _BEYOND_ASCII.findall(word)
    return 2 + (found[-1][-2] * 67 + found[-1][-1]) % 254 if found else before


def streams_of(text: bytes) -> tuple[dict[int, list[bytes]], list[bytes], int]:
    """(units by their context, in order; words longer than a piece; number of words and the end).

    A unit stands without its blank: so a piece that goes on is the only one of PIECE bytes.
    """
    words = text.lower().split()
    streams: dict[int, list[bytes]] = {}
    now = 0
    if text.isascii():
        streams[0] = words
    else:
        for word in words:
            streams.setdefault(now, []).append(word)
            if not word.isascii():
                now = _context(word, now)
    n, long = len(words) + 1, []
    if words and max(map(len, words)) >= PIECE:
        long = [w for w in words if len(w) >= PIECE]
        goes_on = []
        for context, held in streams.items():
            streams[context] = [w[:PIECE] for w in held]
        for word in long:
            goes_on += [word[at : at + PIECE] for at in range(PIECE, len(word) + 1, PIECE)]
        streams[GOES_ON] = goes_on
    streams.setdefault(now, []).append(END)
    return streams, long, n


def spell(unit: bytes) -> bytes:
    """A unit as it is predicted: with its blank, unless it goes on or is the end."""
    return unit if len(unit) == PIECE or unit == END else unit + b" "


def count_units(docs: DataFrame, train: Column, text_col: str = "text") -> DataFrame:
    """word, context, train (tokens), docs (training documents), held (tokens of others), of all documents. Long words count as pieces, and as a whole under the context WHOLE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[Counter, Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for context, (tokens, documents, others) in sums.items():
                keys = list({*tokens, *others})
                words = keys if context == WHOLE else map(spell, keys)
                counts = (pa.array(map(s.__getitem__, keys), pa.int64()) for s in (tokens, documents, others))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([context] * len(keys), pa.int32()), *counts], names=[x.split()[0] for x in _UNIT.split(", ")])
            sums.clear()

        for batch in batches:
            for low, high in _blocks(texts := binary_list(batch.column(0)), 1 << 18):
                for text, is_train in zip(texts[low:high], batch.column(1).slice(low, high - low).to_pylist()):
                    streams, long, _ = streams_of(text)
                    if long:
                        streams[WHOLE] = long
                    for context, held in streams.items():
                        tokens, documents, others = sums.get(context) or sums.setdefault(context, (Counter(), Counter(), Counter()))
                        if is_train:
                            tokens.update(held)
                            documents.update(set(held))
                        else:
                            others.update(held)
                if sum(len(s[0]) + len(s[2]) for s in sums.values()) > _FLUSH:
                    yield from flush()
        yield from flush()

    found = docs.select(F.col(text_col).alias("text"), train.alias("is_train")).mapInArrow(run, _UNIT)
    return found.groupBy("word", "context").agg(*(F.sum(c).alias(c) for c in ("train", "docs", "held")))


def with_prefixes(units: DataFrame, shared: int | None = None) -> DataFrame:
    """Adds prefix: the first bytes of the word, twice as many as long as more than `shared` units begin with them."""
    shared = shared or SHARED
    size, rows = PREFIX, units.withColumn("prefix", F.substring("word", 1, PREFIX))
    while size < PIECE:
        # At most units / shared of them.
        hot = rows.filter(F.length("prefix") == size).groupBy("prefix").agg(F.count("*").alias("n")).filter(F.col("n") > shared).select(F.col("prefix").alias("hot"))
        hot = materialize(hot, "prefixes")
        if hot.isEmpty():
            break
        rows = rows.join(F.broadcast(hot), F.col("prefix") == F.col("hot"), "left")
        rows = rows.withColumn("prefix", F.when(F.col("hot").isNotNull(), F.substring("word", 1, 2 * size)).otherwise(F.col("prefix"))).drop("hot")
        size *= 2
    return rows


@dataclass
class Spelled:
    """Units in the order of their words: places of their bytes, contexts, counts, and the row of the prefix table that each belongs to."""

    data: np.ndarray
    starts: np.ndarray
    size: np.ndarray
    context: np.ndarray
    train: np.ndarray
    docs: np.ndarray
    row: np.ndarray


@dataclass
class Prefixes:
    """The table of prefixes, in order: bytes, contexts, tokens and units of training below each."""

    data: np.ndarray
    starts: np.ndarray
    size: np.ndarray
    context: np.ndarray
    train: np.ndarray
    units: np.ndarray
    row: dict[tuple[bytes, int], int]


def _places(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size


def prefix_table(rows: pa.Table) -> Prefixes:
    """Of rows (prefix, context, train, units)."""
    keys = list(zip(rows.column("prefix").to_pylist(), rows.column("context").to_pylist()))
    order = sorted(range(len(keys)), key=keys.__getitem__)
    keys = [keys[i] for i in order]
    counts = (rows.column(c).to_numpy()[order].astype(np.int64) for c in ("train", "units"))
    return Prefixes(*_places([p for p, _ in keys]), np.array([c for _, c in keys], np.int64), *counts, dict(zip(keys, range(len(keys)))))


def spelled(batch: pa.Table, prefixes: Prefixes) -> Spelled:
    words, contexts = batch.column("word").to_pylist(), batch.column("context").to_pylist()
    row = np.fromiter(map(prefixes.row.__getitem__, zip(batch.column("prefix").to_pylist(), contexts)), np.int64, len(words))
    return Spelled(*_places(words), np.array(contexts, np.int64), batch.column("train").to_numpy(), batch.column("docs").to_numpy(), row)


class Cursor:
    """Counts of the units that agree with a unit up to a bit, and have the next bit 0 or 1, for all units at once.

    The units are in an order in which those that agree are neighbours; the cursor moves on bit by
    bit, and knows where such neighbourhoods begin.
    """

    def __init__(self, order: np.ndarray, group: np.ndarray | None, counts: list[np.ndarray]):
        self.unit = order
        self.begins = np.ones(len(order), bool)
        self.begins[1:] = False if group is None else group[order[1:]] != group[order[:-1]]
        self.counts = [c[order] for c in counts]

    def enter(self, byte: np.ndarray, size: np.ndarray, depth: int) -> None:
        """Go on to the byte at depth, leaving out the units that have ended."""
        keep = size[self.unit] > depth
        if not keep.all():
            run = np.cumsum(self.begins)[keep]
            self.unit, self.counts = self.unit[keep], [c[keep] for c in self.counts]
            self.begins = np.ones(len(run), bool)
            self.begins[1:] = run[1:] != run[:-1]
        self.byte = byte[self.unit]

    def bit(self, s: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of the counts: how many have the bit 0, and 1."""
        value = (self.byte >> s) & 1
        starts, run = np.flatnonzero(self.begins), np.cumsum(self.begins) - 1
        for c in self.counts:
            ones = np.add.reduceat(c * value, starts)
            zeros = np.add.reduceat(c, starts) - ones
            yield zeros.astype(np.float32)[run], ones.astype(np.float32)[run]
        self.begins[1:] |= value[1:] != value[:-1]


def _hashed(history: np.ndarray, context: np.ndarray) -> list[np.ndarray]:
    """A hash of each of the contexts of ORDERS."""
    of = mix(context.astype(np.uint64) + np.uint64(1))
    return [mix((history & np.uint64((1 << 8 * n) - 1)) * _ODD + np.uint64(n) + (of if wide else np.uint64(0))) for n, wide in ORDERS]


def _slots(hashed: list[np.ndarray], node: np.ndarray, bits: int) -> np.ndarray:
    """Places in the tables, orders x units."""
    mixed = node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return np.stack([(((h + mixed) * _ODD) >> np.uint64(64 - bits)).astype(np.int64) + (k << bits) for k, h in enumerate(hashed)])


def _bytes(units: Spelled | Prefixes, depth: int) -> np.ndarray:
    out = np.zeros(len(units.size), np.uint8)
    there = np.flatnonzero(units.size > depth)
    out[there] = units.data[units.starts[there] + depth]
    return out


def count_bits(units: Spelled, table: np.ndarray, bits: int) -> None:
    """Add the bits of each unit, once, to a flat table: for each order and slot how many were 0, and 1."""
    history = np.full(len(units.size), 0x2020202020202020, np.uint64)
    for depth in range(int(units.size.max(initial=0))):
        here = np.flatnonzero(units.size > depth)
        byte = _bytes(units, depth)[here]
        hashed, node = _hashed(history[here], units.context[here]), np.ones(len(here), np.int64)
        for s in range(7, -1, -1):
            value = (byte >> s) & 1
            np.add.at(table, (_slots(hashed, node, bits) * 2 + value).ravel(), table.dtype.type(1))  # Of the table's type: much faster.
            node = node * 2 + value
        history[here] = history[here] << np.uint64(8) | byte.astype(np.uint64)


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def _seen(n: np.ndarray) -> np.ndarray:
    """0 for none, then by powers of two."""
    return np.minimum(np.frexp(n)[1], _SEEN - 1)


def _logit(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + _PRIOR) / (zeros + _PRIOR))


class Mixer:
    """Gated weights and the refining table, beside the counts of the hashed contexts."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.reshape(-1, 2)
        self.bits = (len(self.counts) // len(ORDERS)).bit_length() - 1
        self.weights = np.full((GATES, INPUTS), 0.3, np.float32)
        self.weights[:, -1] = 0
        self.refine = np.tile(_squash((np.arange(_BUCKETS, dtype=np.float32) - _BUCKETS // 2) / 2), (GATES, 1))
        self.logits: np.ndarray | None = None

    def freeze(self) -> None:
        """Logits of all slots instead of their counts: nothing can be learnt after that."""
        self.logits, self.counts = _logit(*self.counts.astype(np.float32).T).astype(np.float16), None

    def _inputs(self, found: list[np.ndarray], slots: np.ndarray, depth: int, value: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Logits, inputs x units, and gates. found: zeros and ones of tokens, of units and of tokens in context; own: tokens and units that are the unit's own, to be taken out."""
        x = np.empty((INPUTS, len(value)), np.float32)
        if own is not None:
            is_one = (value == 1).astype(np.float32)
            mine = [[o * (1 - is_one), o * is_one] for o in own]
            found = [np.maximum(f - mine[k // 2 % 2][k % 2], 0) for k, f in enumerate(found)]
        if self.logits is not None:
            x[3:-1] = np.take(self.logits, slots)
        else:
            # Both counts of a slot are taken as one number.
            both = np.take(self.counts.view(np.uint32).ravel(), slots).view(np.float16).astype(np.float32)
            zeros, ones = both[:, 0::2], both[:, 1::2]
            if own is not None:
                zeros, ones = np.maximum(zeros - mine[1][0], 0), np.maximum(ones - mine[1][1], 0)
            x[3:-1] = _logit(zeros, ones)
        for k in range(3):
            x[k] = _logit(found[2 * k], found[2 * k + 1])
        x[-1] = 0.3
        gate = (_seen(found[4] + found[5]) * _SEEN + _seen(found[2] + found[3])) * _PLACES + min(depth, _PLACES - 1)
        return x, gate

    def _refined(self, gate: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability out of the table, between two of its places, and the nearer one."""
        place = np.clip(z * 2 + _BUCKETS // 2, 0, _BUCKETS - 1.001)
        low = place.astype(np.int32)
        share = place - low
        at = gate * _BUCKETS + low
        flat = self.refine.ravel()
        return (1 - share) * flat[at] + share * flat[at + 1], at + (share > 0.5)

    def run(self, units: Spelled, prefixes: Prefixes, rate: float = 0.0) -> tuple[np.ndarray, ...]:
        """Natural log of the probability of each unit. With a rate, weights and refinement are learnt on the way: they become their means over it, and how often each was used is returned as well."""
        n = len(units.size)
        total = np.zeros(n, np.float64)
        some = (units.train > 0).astype(np.int64)
        of_word = Cursor(np.arange(n), None, [units.train, some])
        of_context = Cursor(np.argsort(units.context, kind="stable"), units.context, [units.train])
        rows = np.arange(len(prefixes.size))
        above = [Cursor(rows, None, [prefixes.train, prefixes.units]), Cursor(np.argsort(prefixes.context, kind="stable"), prefixes.context, [prefixes.train])]
        found_above = np.zeros((6, len(rows)), np.float32)
        place = np.zeros(n, np.int64)
        # What is known of the units that go on, in their order.
        history, context = np.full(n, 0x2020202020202020, np.uint64), units.context
        own = np.stack([units.train / np.maximum(units.docs, 1), units.docs == 1]).astype(np.float32) if rate else None
        weight = units.train.astype(np.float32)
        sums = np.zeros(self.weights.shape), np.zeros(self.refine.shape)
        used = np.zeros(GATES)

        for depth in range(int(units.size.max(initial=0))):
            byte = _bytes(units, depth)
            going = units.size[of_word.unit] > depth
            if not going.all():
                history, context, weight = history[going], context[going], weight[going]
                own = own if own is None else own[:, going]
            for cursor in (of_word, of_context):
                cursor.enter(byte, units.size, depth)
            here = of_word.unit
            byte = byte[here]
            place[here] = np.arange(len(here))
            spot = place[of_context.unit]
            shallow = np.flatnonzero(prefixes.size[units.row[here]] > depth)
            if len(shallow):
                row = units.row[here[shallow]]
                byte_above = _bytes(prefixes, depth)
                for cursor in above:
                    cursor.enter(byte_above, prefixes.size, depth)
            count = -(-len(here) // BLOCK)
            # Blocks of learning are drawn evenly from the whole order.
            blocks = [slice(k, None, count) if rate else slice(k * BLOCK, (k + 1) * BLOCK) for k in range(count)]
            hashed = [_hashed(history[b], context[b]) for b in blocks]
            node, gained = np.ones(len(here), np.int64), np.zeros(len(here), np.float32)
            for s in range(7, -1, -1):
                found = [x for pair in of_word.bit(s) for x in pair]
                for pair in of_context.bit(s):
                    for x in pair:
                        found.append(np.empty(len(here), np.float32))
                        found[-1][spot] = x
                if len(shallow):
                    self._gather(above, found_above, s)
                    for x, y in zip(found, found_above):
                        x[shallow] = y[row]
                bit = (byte >> s) & 1
                for b, h in zip(blocks, hashed):
                    value = bit[b]
                    x, gate = self._inputs([f[b] for f in found], _slots(h, node[b], self.bits), depth, value, None if own is None else own[:, b])
                    z = np.clip(np.einsum("ki,ik->i", x, np.take(self.weights, gate, axis=0)), -18, 18)
                    p = _squash(z)
                    refined, cell = self._refined(gate, z)
                    mixed = np.clip((p + refined) / 2, 1e-6, 1 - 1e-6)
                    gained[b] += np.log(np.where(value, mixed, 1 - mixed))
                    if rate:
                        load = np.bincount(gate, weight[b], GATES)
                        sums[0][:] += self.weights * load[:, None]
                        sums[1][:] += self.refine * load[:, None]
                        used += load
                        self._learn(x, gate, cell, p, value, weight[b], load, rate)
                node = node * 2 + bit
            total[here] += gained
            history = history << np.uint64(8) | byte.astype(np.uint64)
        if rate:
            for table, mean in zip((self.weights, self.refine), sums):
                table[used > 0] = mean[used > 0] / used[used > 0, None]
        return total, used

    @staticmethod
    def _gather(cursors: list[Cursor], into: np.ndarray, s: int) -> None:
        line = 0
        for cursor in cursors:
            for pair in cursor.bit(s):
                into[line, cursor.unit], into[line + 1, cursor.unit] = pair
                line += 2

    def _learn(self, x: np.ndarray, gate: np.ndarray, cell: np.ndarray, p: np.ndarray, value: np.ndarray, weight: np.ndarray, here: np.ndarray, rate: float) -> None:
        """Move the weights against the errors, over their curvature; a gate that saw few units moves less."""
        error, curve = (value - p) * weight, (p * (1 - p) + 1e-3) * weight
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        first = np.flatnonzero(np.diff(gate[order], prepend=-1))
        some, x = gate[order[first]], np.take(x, order, axis=1)
        total = lambda values: np.add.reduceat(values, first, axis=-1).T
        pull, resist = total(x * error[order].astype(np.float32)), total(x * x * curve[order].astype(np.float32))
        pace = rate * np.minimum(1, np.sqrt(total((weight[order] > 0).astype(np.float32)) / 32)) / INPUTS
        self.weights[some] += pace[:, None] * pull / (resist + np.float32(0.02) * here[some, None].astype(np.float32) + np.float32(1e-9))
        hits = np.bincount(cell, weight, self.refine.size).reshape(self.refine.shape)
        ones = np.bincount(cell, weight * value, self.refine.size).reshape(self.refine.shape)
        self.refine += ((1 - 0.98 ** np.minimum(hits, 200)) * (ones / np.maximum(hits, 1e-9) - self.refine) * (hits > 0)).astype(np.float32)
        self.refine = np.clip(self.refine, 1e-4, 1 - 1e-4)

    def learn(self, units: Spelled, prefixes: Prefixes, rate: float = 0.2, passes: int = 1) -> np.ndarray:
        """Learn from some units, in one or several passes. How often each gate was used."""
        for k in range(passes):
            used = self.run(units, prefixes, rate / (1 + k))[1]
        return used


def half(counts: np.ndarray) -> np.ndarray:
    """Rows of counts in half precision, with the odds of those beyond its range kept."""
    return (counts / np.maximum(counts.max(axis=1, keepdims=True) / 60_000, 1)).astype(np.float16)


def slot_bits(units: int) -> int:
    """Eight slots for each order and unit of training, within bounds."""
    return min(MAX_BITS, max(MIN_BITS, (max(units, 1) - 1).bit_length() + 3))


def _parts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Sorted units in parts of some size that end with a prefix."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < 2 * least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column("prefix").to_pylist()
        low = 0
        for i in range(1, n):
            if i - low >= least and keys[i] != keys[i - 1]:
                yield table.slice(low, i - low)
                low = i
        held, n = table.slice(low).to_batches(), n - low
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def bit_counts(units: DataFrame, bits: int) -> np.ndarray:
    """Counts of both bit values in all slots, each training unit once: (orders << bits) x 2, in half precision."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 * len(ORDERS) << bits, np.int32)
        for batch in batches:
            zero = np.zeros(batch.num_rows, np.int64)
            count_bits(Spelled(*_places(batch.column(0).to_pylist()), batch.column(1).to_numpy().astype(np.int64), zero, zero, zero), table, bits)
        flat = table.reshape(-1, CHUNK)
        for i in np.flatnonzero(flat.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([flat[i].tobytes()], pa.binary())], names=["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int32).astype(np.int64) for c in table.column("counts").chunks for x in c)
        return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([half(total.reshape(-1, 2)).tobytes()], pa.binary())})

    kind = "chunk long, counts binary"
    found = units.filter("train > 0").select("word", "context").mapInArrow(count, kind).groupBy("chunk").applyInArrow(add, kind).toArrow()
    out = np.zeros((2 * len(ORDERS) << bits) // CHUNK * CHUNK, np.float16).reshape(-1, CHUNK)
    for i, counts in zip(found.column("chunk").to_pylist(), found.column("counts")):
        out[i] = np.frombuffer(counts.as_buffer(), np.float16)
    return out.reshape(-1, 2)


def train_mixer(units: DataFrame, prefixes: Prefixes, distinct: int, rate: float = 0.2) -> tuple[Mixer, int]:
    """A mixer of all units with train > 0, distinct in number, and how many it learnt from. units: sorted, with prefix."""
    mixer = Mixer(bit_counts(units, slot_bits(distinct)))
    if not distinct:
        return mixer, 0
    shared = units.sparkSession.sparkContext.broadcast((mixer.counts, prefixes))
    passes = min(4, -(-LEAST // distinct))
    kind = "place int, learnt long, weights binary, refine binary, used binary"
    tables = ("weights", "refine", "used")

    def row(place: int, learnt: int, sums: list[np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array([place], pa.int32()), pa.array([learnt]), *(pa.array([x.tobytes()], pa.binary()) for x in sums)]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in kind.split(", ")])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = shared.value
        learnt, sums = 0, [np.zeros(x.shape) for x in (mixer.weights, mixer.refine, np.zeros((GATES, 1)))]
        for part in _parts(batches, PART):
            own = Mixer(counts)
            used = own.learn(spelled(part, known), known, rate, passes)[:, None]
            learnt += part.num_rows
            for total, x in zip(sums, (used * own.weights, used * own.refine, used)):
                total += x
        yield row(TaskContext.get().partitionId() % 32, learnt, sums)

    def add(found: pa.Table) -> pa.Table:
        sums = [sum(np.frombuffer(x.as_py()) for c in found.column(name).chunks for x in c) for name in tables]
        return pa.Table.from_batches([row(found.column("place")[0].as_py(), sum(found.column("learnt").to_pylist()), sums)])

    # A row from each task, then 32 at most: what comes to the driver doesn't grow.
    mixer.counts = None
    rows = units.filter("train > 0").mapInArrow(learn, kind).groupBy("place").applyInArrow(add, kind).collect()
    mixer.counts = shared.value[0]
    weights, refine, used = (sum(np.frombuffer(r[name]) for r in sorted(rows, key=lambda r: r["place"])) for name in tables)
    seen = used > 0
    for table, total in ((mixer.weights, weights), (mixer.refine, refine)):
        table[seen] = (total.reshape(table.shape)[seen] / used[seen, None]).astype(np.float32)
    return mixer, sum(r["learnt"] for r in rows)


@dataclass
class Pairs:
    """What a stream of units says about the pairs of neighbours that repeat in it.

    sizes: how often each unit that has several followers is followed; single: how many of these
    followers occur once after it; unit, times: those that occur several times, and how often.
    """

    sizes: np.ndarray
    single: int
    unit: np.ndarray
    times: np.ndarray


def pairs_of(held: list[bytes], found: dict[bytes, int]) -> Pairs:
    """Of a stream, and of its units with their counts; units are numbered in the order of found."""
    none = np.zeros(0, np.int64)
    if len(found) == len(held):
        return Pairs(none, 0, none, none)
    number = dict(zip(found, range(len(found))))
    ids = np.fromiter(map(number.__getitem__, held), np.int64, len(held))
    sizes = np.bincount(ids[:-1], minlength=1)
    sizes = sizes[sizes > 1]
    pairs, times = np.unique(ids[:-1] * len(found) + ids[1:], return_counts=True)
    again = times > 1
    unit, times = pairs[again] % len(found), times[again]
    return Pairs(sizes, int(sizes.sum() - times.sum()), unit, times)


def _log_gamma(z):
    """By Stirling's series, from z + 3 down. z: an array, or a Column with F as module."""
    log = F.log if isinstance(z, Column) else np.log
    w = z + 3
    return (w - 0.5) * log(w) - w + 0.9189385332046727 + 1 / (12 * w) - 1 / (360 * w * w * w) - log(z * (z + 1) * (z + 2))


def _rise(log_x, t):
    """log(x (x + 1) ... (x + t - 1)) for t >= 1, of log(x): x itself may be too small for a double."""
    x = F.exp(log_x) if isinstance(log_x, Column) else np.exp(log_x)
    return log_x + _log_gamma(x + t) - _log_gamma(x + 1)


def unit_table(docs: DataFrame, train: Column, text_col: str = "text", rate: float = 0.2) -> tuple[DataFrame, int]:
    """(key, n, known, log_p, base) of each unit of docs, and the number of training tokens.

    key: context and word; n: all occurrences; known: whether training has the word; log_p: natural
    log of the unit's probability, null of whole long words; base: log10 of the smoothed unigram
    probability, null of units that aren't whole words.
    """
    units = materialize(count_units(docs, train, text_col), "counted")
    words = units.filter((F.col("context") != GOES_ON) & ((F.col("context") == WHOLE) | F.substring("word", -1, 1).isin(bytearray(b" "), bytearray(END))))
    words = words.groupBy("word", (F.col("context") == WHOLE).alias("whole")).agg(F.sum("train").alias("c"))
    seen = F.col("c") > 0
    # Under its blank, or whole: no word is counted twice.
    total, distinct_words = (int(x or 0) for x in words.agg(F.sum("c"), F.count_if(seen)).first())
    spelled_units = with_prefixes(units.filter(F.col("context") != WHOLE))
    n_units, n_train = spelled_units.agg(F.count("*"), F.count_if(F.col("train") > 0)).first()
    parts = max(1, -(-n_units // PART))
    ordered = materialize(spelled_units.repartition(parts, "prefix").sortWithinPartitions("word", "context"), "units")
    below = ordered.filter("train > 0").groupBy("prefix", "context").agg(F.sum("train").alias("train"), F.count("*").alias("units"))
    blank = ordered.filter("train = 0").select("prefix", "context", F.lit(0).cast("long").alias("train"), F.lit(0).cast("long").alias("units")).distinct()
    prefixes = prefix_table(below.unionByName(blank).groupBy("prefix", "context").agg(F.sum("train").alias("train"), F.sum("units").alias("units")).toArrow())
    mixer, _ = train_mixer(ordered, prefixes, n_train, rate)
    mixer.freeze()
    shared = docs.sparkSession.sparkContext.broadcast((mixer, prefixes))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = shared.value
        for part in _parts(batches, PART // 4):
            of = spelled(part, table)
            words = part.column("word").to_pylist()
            log_p = known.run(of, table)[0]
            new = np.fromiter((a != b for a, b in zip(words, [None, *words])), bool, len(words))
            whole = np.fromiter((w[-1:] in (b" ", END) for w in words), bool, len(words)) & (of.context != GOES_ON)
            # A word's count is the sum over its contexts, which follow each other.
            count = np.add.reduceat(of.train * (of.context != GOES_ON), np.flatnonzero(new))[np.cumsum(new) - 1]
            base = np.log10((count + 0.5) / (total + 0.5 * (distinct_words + 1)))
            n = of.train + part.column("held").to_numpy()
            yield pa.RecordBatch.from_arrays([_keys(of.context, words), pa.array(n), pa.array((count > 0) & whole), pa.array(log_p), pa.array(base, mask=~whole)], names=["key", "n", "known", "log_p", "base"])

    kind = "key binary, n long, known boolean, log_p double, base double"
    table = ordered.mapInArrow(predict, kind)
    base = F.log10((F.col("train") + 0.5) / (total + 0.5 * (distinct_words + 1)))
    key = F.concat(F.lit(bytearray([0xFF])), F.col("word"))
    whole = units.filter(F.col("context") == WHOLE).select(key.alias("key"), (F.col("train") + F.col("held")).alias("n"), (F.col("train") > 0).alias("known"), F.lit(None).cast("double").alias("log_p"), base.alias("base"))
    return materialize(table.unionByName(whole), "scored"), total


def _key(context: int, word: bytes) -> bytes:
    """One byte for the context (255 of whole long words; the others are below), then the word."""
    return bytes([context & 0xFF]) + word


def _keys(contexts: np.ndarray, words: list[bytes]) -> pa.Array:
    return pa.array(map(_key, contexts.tolist(), words), pa.binary())


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.2) -> DataFrame:
    """doc_id, is_train, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte: one row per row of docs.

    Tokens are the words between white space with A-Z in lower case, then one end. base_score is the
    smoothed unigram log10 probability, score the model's, bits_per_byte the model's per byte of text
    (null for empty texts). Null and empty texts are one end token. Without training documents all
    words are unknown. train is a condition on docs' columns; null counts as false. Ids may be null
    or repeat: rows are told apart by their place. rate: that of learning; at 0 weights stay as they
    are at first.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("is_train"))
    table, total = unit_table(docs, F.col("is_train"), rate=rate)
    # Long units are left to the join, so that what is broadcast has a bound in bytes.
    top = table.filter(F.length("key") <= PIECE + 1).orderBy(F.desc("n"), "key").limit(HEAVY).select("key", "known", "log_p", "base").toArrow()
    heavy = docs.sparkSession.sparkContext.broadcast((top.column("key").to_pylist(), top.column("known").to_numpy(), *(top.column(c).fill_null(0.0).to_numpy() for c in ("log_p", "base"))))
    sums = [f"u{k}" for k in range(2 * len(URNS))]
    kind = "row long, doc_id long, is_train boolean, n_bytes long, key binary, tf long, again array<int>, n_tokens long, n_known long, base double, " + ", ".join(f"{u} double" for u in sums)
    names = [x.split()[0] for x in kind.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, known, logs, bases = heavy.value
        place: dict[int, dict[bytes, int]] = {}
        for k, key in enumerate(keys):
            place.setdefault(key[0], {})[key[1:].removesuffix(b" ")] = k
        for batch in batches:
            texts, rows = binary_list(batch.column(1)), batch.column(3).to_numpy()
            for low, high in _blocks(texts):
                at, index, tf = [], [], []
                light, light_tf, light_at, light_again = [], [], [], []
                # Of repeated pairs: sizes of contexts, and units that are known here, by text.
                sizes, sizes_at, pair_unit, pair_times, pair_at = [], [], [], [], []
                tokens, rest = np.zeros(high - low, np.int64), np.zeros((len(URNS), high - low))
                single = np.zeros(high - low)
                for i in range(low, high):
                    streams, long, tokens[i - low] = streams_of(texts[i])
                    for context, held in streams.items():
                        found = Counter(held)
                        where = list(map(place.get(context, {}).get, found))
                        pairs = pairs_of(held, found)
                        sizes.append(pairs.sizes)
                        sizes_at.append(np.full(len(pairs.sizes), i - low))
                        single[i - low] += pairs.single
                        unknown: dict[int, list[int]] = {}
                        for unit, n in zip(pairs.unit.tolist(), pairs.times.tolist()):
                            if where[unit] is None:
                                unknown.setdefault(unit, []).append(n)
                            else:
                                pair_unit.append(where[unit])
                                pair_times.append(n)
                                pair_at.append(i - low)
                        for number, (unit, k, n) in enumerate(zip(found, where, found.values())):
                            if k is None:
                                light.append(_key(context, spell(unit)))
                                light_tf.append(n)
                                light_at.append(i)
                                light_again.append(unknown.get(number))
                            else:
                                index.append(k)
                                tf.append(n)
                                at.append(i - low)
                    for word, n in Counter(long).items():
                        light.append(b"\xff" + word)
                        light_tf.append(n)
                        light_at.append(i)
                        light_again.append(None)
                    n = np.array([len(held) for held in streams.values() if held], np.float64)
                    rest[:, i - low] = _rise(_LOG_URNS[:, None], n).sum(axis=1)
                at, index, tf = np.array(at, np.int64), np.array(index, np.int64), np.array(tf, np.int64)
                sizes, sizes_at = np.concatenate(sizes), np.concatenate(sizes_at).astype(np.int64)
                pair_at, times = np.array(pair_at, np.int64), np.array(pair_times, np.float64)
                pair_log = logs[np.array(pair_unit, np.int64)]
                of = lambda x, at=at: np.bincount(at, x, minlength=high - low)  # noqa: B023, E731
                here = np.arange(low, high)
                urns = [of(np.where(tf == 1, np.log(a) + logs[index], _rise(np.log(a) + logs[index], tf))) - r for a, r in zip(URNS, rest)]
                alone = of(tf * logs[index])
                for log_a in _LOG_URNS:
                    more = of(_rise(log_a + pair_log, times) - times * pair_log, pair_at)
                    urns.append(alone + more + single * log_a - of(_rise(log_a, sizes.astype(np.float64)), sizes_at))
                none = pa.nulls(high - low, pa.int64())
                own = [pa.array(rows[here]), batch.column(0).take(pa.array(here)), batch.column(2).take(pa.array(here)), pa.array([len(t) for t in texts[low:high]], pa.int64())]
                # A key that no unit has, and that spreads these rows: words hold no white space.
                spread = pa.array([b"\n%d" % r for r in rows[here]], pa.binary())
                again = pa.nulls(high - low, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*own, spread, none, again, pa.array(tokens), pa.array(of(tf * known[index]).astype(np.int64)), pa.array(of(tf * bases[index])), *map(pa.array, urns)], names=names)
                if light:
                    empty = lambda k: pa.nulls(len(light), k)  # noqa: B023, E731
                    head = [pa.array(rows[light_at]), empty(pa.int64()), empty(pa.bool_()), empty(pa.int64()), pa.array(light, pa.binary()), pa.array(light_tf, pa.int64())]
                    tail = [*[empty(pa.int64())] * 2, *[empty(pa.float64())] * (1 + len(sums))]
                    yield pa.RecordBatch.from_arrays([*head, pa.array(light_again, pa.list_(pa.int32())), *tail], names=names)

    parts = docs.select("*", F.monotonically_increasing_id().alias("row")).mapInArrow(read, kind)
    joined = parts.join(table.select(F.col("key").alias("unit"), "known", "log_p", F.col("base").alias("unit_base")), F.col("key") == F.col("unit"), "left")
    light = F.col("tf").isNotNull()
    of_light = lambda value, else_: F.sum(F.when(light, value).otherwise(else_))
    totals = [
        F.first("doc_id", ignorenulls=True).alias("doc_id"),
        F.first("is_train", ignorenulls=True).alias("is_train"),
        F.max("n_bytes").alias("n_bytes"),
        F.max("n_tokens").alias("n_tokens"),
        of_light(F.when(F.col("known"), F.col("tf")).otherwise(0), F.col("n_known")).alias("n_known"),
        of_light(F.coalesce(F.col("tf") * F.col("unit_base"), F.lit(0.0)), F.col("base")).alias("base_score"),
    ]
    for u, v, a in zip(sums, sums[len(URNS) :], URNS):
        x = F.col("log_p") + float(np.log(a))
        risen = F.coalesce(F.when(F.col("tf") == 1, x).otherwise(_rise(x, F.col("tf"))), F.lit(0.0))
        totals.append(of_light(risen, F.col(u)).alias(u))
        paired = F.coalesce(F.col("tf") * F.col("log_p"), F.lit(0.0)) + F.coalesce(_of_pairs(x), F.lit(0.0))
        totals.append(of_light(paired, F.col(v)).alias(v))
    rows = joined.groupBy("row").agg(*totals)
    best = F.greatest(*map(F.col, sums))
    mixed = best + F.log(sum((F.exp(F.col(u) - best) for u in sums[1:]), F.exp(F.col("u0") - best)) / len(sums))
    rows = rows.withColumn("score", mixed / _LN10)
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10.0)) / F.col("n_bytes"))
    return rows.select("doc_id", "is_train", "n_bytes", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))


def _of_pairs(x: Column) -> Column:
    """What the pairs that end in a unit and repeat (again: how often each) add to its plain occurrences."""
    return F.aggregate("again", F.lit(0.0), lambda total, n: total + _rise(x, n) - n * F.col("log_p"))


def _blocks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a megabyte."""
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high]) < most):
            size += len(texts[high])
            high += 1
        yield low, high
        low = high
