"""Language-model scoring by logistic context mixing of hashed-context bit predictors, along each text.

A text is its words, each with a blank, and an end. Its bytes are predicted bit by bit where they
stand, from the 1 to 6 bytes before, whatever words these belong to: at the start of a word the
contexts are bytes of the words before it. For each order a hashed table says how often a bit was 0
or 1 after that context in the training texts. The logits are mixed by weights that a gate selects
(how often the contexts of orders 6 and 4 were seen, and the place in the word); a table over gate
and mixed logit, learnt online as the weights are, refines the result.

The bits of a word add up to its probability, and that is refined by what the document had before:
the n-th word has probability (k + a P) / (n - 1 + a), k the word's earlier occurrences, in the
document or after the same word there, mixed over several a. So the whole is a distribution over all
sequences of words.

A byte and the six before it are a window, one number. Spark counts the windows of all training
texts. The tables are sums over them, and weights and refinement are learnt from each of them,
weighed by its count, with one occurrence taken out. Texts are scored where they are read: every
byte takes the prediction of its own window, and a task remembers those it made last.

Only the base, the smoothed unigrams, needs a join: the most frequent words, a fixed number, are
broadcast, the others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathkit.llm.shared import arrow_bytes, binary_list, materialize, mix, powers, slices

END = b"\n"
#: Bytes of each context, and the slots of its table as a power of two: 14 million in all at most.
ORDERS = (1, 2, 3, 4, 5, 6)
MOST_BITS = (17, 18, 20, 22, 22, 22)
#: Slots for each window of training, up to MOST_BITS; 16 slots, the nodes of half a byte, are a row.
SLOTS = 8
URNS = (30.0, 300.0, 3_000.0, 30_000.0)
#: Words whose counts are broadcast, as two numbers each.
HEAVY = 1 << 19
#: Windows of a task that counts or learns; fewer windows than LEAST are gone over several times.
PART, LEAST = 1 << 20, 1 << 21
#: Windows that are predicted at once, bytes of text that are counted and scored at once, and windows that a task holds or remembers.
BLOCK, TEXTS, SCORED, HELD, CACHE_BITS = 1 << 14, 15 << 17, 15 << 15, 1 << 22, 22
#: Bytes of an Arrow batch: by Spark's own limits it is ten thousand texts, held by the JVM and the worker at once.
BATCH = 1 << 22
CHUNK = 1 << 13
#: Bytes of training text for each task that collects windows, and the fewest such tasks.
SPAN, TASKS = 1 << 27, 12
PAD = 7
INPUTS = len(ORDERS) + 1
_PLACES, _OFTEN, _SOME, _BUCKETS = 7, 8, 4, 33
GATES = _PLACES * _OFTEN * _SOME
_PRIOR = np.float32(0.02)
_ODD, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LN10 = float(np.log(10.0))


class Streams:
    """Texts as they are predicted, one after the other: the window of each byte, and where words begin.

    starts: of each word or end, among the bytes; owner: its text; sizes: bytes of each text's stream.
    """

    def __init__(self, texts: list[bytes]):
        streams = [b" ".join((*text.lower().split(), END)) for text in texts]
        blank = b" " * PAD
        buffer = blank + blank.join(streams)
        self.sizes = np.fromiter(map(len, streams), np.int64, len(streams))
        at = np.repeat(PAD * np.arange(len(streams)), self.sizes)
        at += np.arange(len(at))
        self.windows = np.ndarray((len(buffer) - PAD,), "<u8", buffer, 0, (1,))[at]
        del at
        self.windows >>= np.uint64(8)
        # The byte itself is the highest of the number, the one before it the next.
        each = self.windows.view(np.uint8).reshape(-1, 8)
        self.data = each[:, 6].copy()
        self.starts = np.flatnonzero(each[:, 5] == 32)
        self.owner = np.searchsorted(np.cumsum(self.sizes), self.starts, side="right")

    def hashes(self) -> np.ndarray:
        """Of each word, by its bytes alone."""
        up, down = powers(len(self.data) + 1)
        return mix(np.add.reduceat((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], self.starts) * down[self.starts])

    def words(self, places: np.ndarray) -> list[bytes]:
        """The words or ends with these numbers, without blanks."""
        whole, ends = self.data.tobytes(), np.append(self.starts[1:], len(self.data))
        spans = zip(self.starts[places].tolist(), ends[places].tolist())
        return [word if word == END else word[:-1] for word in (whole[low:high] for low, high in spans)]


def _summed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs. keys are sorted in place."""
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.diff(first, append=len(keys))


def _packed(windows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A window (56 bits) and its count as one number, several numbers if it counts over 255."""
    full, rest = np.divmod(n, 255)
    some, many = rest > 0, np.flatnonzero(full)
    return np.concatenate([(windows[some] << np.uint64(8)) | rest[some].astype(np.uint64), np.repeat((windows[many] << np.uint64(8)) | np.uint64(255), full[many])])


def _unpacked(packed: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows in order, and the sums of their counts. The list is emptied on the way."""
    whole = np.concatenate(packed)
    packed.clear()
    whole.sort()
    keys = whole >> np.uint64(8)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    keys = keys[first]
    return keys, np.add.reduceat(whole.view(np.uint8)[::8], first, dtype=np.int64)


def count_words(texts: DataFrame) -> DataFrame:
    """word, c: the words of a column of texts, and one end for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "c"])
            counts.clear()
            return out

        for batch in batches:
            values = binary_list(batch.column(0))
            counts[END] += len(values)
            for low, high in slices(values, TEXTS):
                counts.update(b"\n".join(values[low:high]).lower().split())
                if len(counts) > HELD // 8:
                    yield flush()
        yield flush()

    return texts.mapInArrow(run, "word binary, c long").filter("c > 0").groupBy("word").agg(F.sum("c").alias("c"))


def count_windows(texts: DataFrame) -> DataFrame:
    """window, n: the windows of a column of texts, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            """What is held becomes one, and is given out if it has at least so many windows."""
            keys, counts = _unpacked(held)
            packed = _packed(keys, counts)
            if len(packed) < least:
                held.append(packed)
                return
            del packed
            for i in range(0, len(keys), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 17)].astype(np.int64)) for x in (keys, counts)], names=["window", "n"])

        for batch in batches:
            values = binary_list(batch.column(0))
            for low, high in slices(values, TEXTS):
                held.append(_packed(*_summed(Streams(values[low:high]).windows)))
                if sum(map(len, held)) > HELD:
                    yield from flush(HELD // 2)
        if held:
            yield from flush(0)

    return texts.mapInArrow(run, "window long, n long").groupBy("window").agg(F.sum("n").alias("n"))


def table_bits(windows: int) -> list[int]:
    """The slots of each order, as powers of two."""
    wanted = max(12, (max(windows, 1) * SLOTS - 1).bit_length())
    return [min(wanted, most) for most in MOST_BITS]


def _rows(context: np.ndarray, before: np.ndarray | int, bits: list[int]) -> np.ndarray:
    """Orders x windows: the first slot of the row of each context with what is known of the byte (0, or 16 and its upper half)."""
    out, at = np.empty((len(ORDERS), len(context)), np.int64), 0
    for k, (n, b) in enumerate(zip(ORDERS, bits)):
        h = ((context >> np.uint64(48 - 8 * n)) + np.uint64(n << 56)) * _ODD
        h = ((h ^ (h >> np.uint64(29))) + before) * _OTHER
        h ^= h >> np.uint64(32)
        out[k] = ((h * _ODD) >> np.uint64(64 - b + 4)).astype(np.int64) * 16 + at
        at += 1 << b
    return out


def _parts_of(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and bytes of windows."""
    return windows & np.uint64((1 << 48) - 1), windows >> np.uint64(48)


def _halves(context: np.ndarray, byte: np.ndarray, bits: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For both halves of the bytes: the rows of their contexts, and the half's value."""
    upper = byte >> np.uint64(4)
    yield _rows(context, np.uint64(0), bits), upper.astype(np.int64)
    yield _rows(context, upper + np.uint64(16), bits), (byte & np.uint64(15)).astype(np.int64)


def count_bits(windows: np.ndarray, n: np.ndarray, table: np.ndarray, bits: list[int]) -> None:
    """Add the bits of windows, n times each, to a flat table: for each slot how often the bit was 0, and 1."""
    for low in range(0, len(windows), BLOCK):
        context, byte = _parts_of(windows[low : low + BLOCK])
        weight = np.tile(n[low : low + BLOCK].astype(table.dtype), len(ORDERS))
        for rows, half in _halves(context, byte, bits):
            node = np.ones(len(half), np.int64)
            for s in (3, 2, 1, 0):
                bit = (half >> s) & 1
                np.add.at(table, ((rows + node) * 2 + bit).ravel(), weight)
                node = node * 2 + bit


def _in_half(counts: np.ndarray) -> np.ndarray:
    """Rows of counts in half precision, with the odds of those beyond its range kept."""
    return (counts / np.maximum(counts.max(axis=1, keepdims=True) / 60_000, 1)).astype(np.float16)


def bit_counts(windows: DataFrame, bits: list[int], total: int) -> np.ndarray:
    """Counts of both bit values in all slots, in half precision. total: of all windows' n."""
    kept = np.int32 if total < 1 << 31 else np.int64
    size = 2 * sum(1 << b for b in bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(-(-size // CHUNK) * CHUNK, kept)
        for batch in batches:
            count_bits(batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy(), table, bits)
        flat = table.reshape(-1, CHUNK)
        some = np.flatnonzero(flat.any(axis=1))
        for at in (some[i : i + 32] for i in range(0, len(some), 32)):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([flat[i].tobytes() for i in at], pa.binary())], names=["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), kept).astype(np.int64) for x in table.column("counts"))
        return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([_in_half(total.reshape(-1, 2)).tobytes()], pa.binary())})

    kind = "chunk long, counts binary"
    found = windows.mapInArrow(count, kind).groupBy("chunk").applyInArrow(add, kind).toArrow()
    out = np.zeros((-(-size // CHUNK), CHUNK), np.float16)
    for i, counts in zip(found.column("chunk").to_pylist(), found.column("counts")):
        out[i] = np.frombuffer(counts.as_buffer(), np.float16)
    return out.ravel()[:size].reshape(-1, 2)


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def _logit(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + _PRIOR) / (zeros + _PRIOR))


def _level(n: np.ndarray) -> np.ndarray:
    """How often: 0 for never, then by powers of two."""
    return np.minimum(np.frexp(n)[1], _OFTEN - 1)


class Mixer:
    """Gated weights and the refining table, beside the counts of the hashed contexts."""

    def __init__(self, counts: np.ndarray, bits: list[int]):
        self.counts, self.bits = counts, bits
        self.slots: np.ndarray | None = None
        self.weights = np.full((GATES, INPUTS), 0.3, np.float32)
        self.weights[:, -1] = 0
        self.refine = np.tile(_squash((np.arange(_BUCKETS, dtype=np.float32) - _BUCKETS // 2) / 2), (GATES, 1))

    def freeze(self) -> None:
        """Instead of the counts of a slot, its logit (in 256ths) and level in one number: nothing can be learnt after that."""
        self.slots = np.empty(len(self.counts), np.int16)
        for low in range(0, len(self.counts), 1 << 20):
            zeros, ones = self.counts[low : low + (1 << 20)].astype(np.float32).T
            value = np.clip(np.rint(_logit(zeros, ones) * 256), -4095, 4095).astype(np.int16)
            self.slots[low : low + (1 << 20)] = value * 8 + _level(zeros + ones).astype(np.int16)
        self.counts = None

    def _inputs(self, slots: np.ndarray, bit: np.ndarray, learning: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, inputs x windows, and the levels of orders 6 and 4. Learning leaves out one occurrence of the window itself."""
        x = np.empty((INPUTS, slots.shape[1]), np.float32)
        x[-1] = 0.3
        if learning:
            # Both counts of a slot are taken as one number.
            both = np.take(self.counts.view(np.uint32).ravel(), slots).view(np.float16).astype(np.float32)
            zeros, ones = np.maximum(both[:, 0::2] - (1 - bit), 0), np.maximum(both[:, 1::2] - bit, 0)
            x[:-1] = _logit(zeros, ones)
            return x, *(_level(zeros[k] + ones[k]) for k in (5, 3))
        found = np.take(self.slots, slots)
        np.multiply(found >> 3, np.float32(1 / 256), out=x[:-1])
        return x, found[5] & 7, found[3] & 7

    def _refined(self, gate: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability out of the table, between two of its places, and the nearer one."""
        place = np.clip(z * 2 + _BUCKETS // 2, 0, np.float32(_BUCKETS - 1.001))
        low = place.astype(np.int32)
        share = place - low
        at = gate * _BUCKETS + low
        flat = self.refine.ravel()
        return (1 - share) * flat[at] + share * flat[at + 1], at + (share > 0.5)

    def run(self, windows: np.ndarray, n: np.ndarray | None = None, rate: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Natural log of the probability of each window's byte after its context, and how often each gate was used.

        With a rate, weights and refinement are learnt on the way from windows that occur n times, and become their means over it.
        """
        total = np.zeros(len(windows), np.float32)
        sums, used = (np.zeros(self.weights.shape), np.zeros(self.refine.shape)), np.zeros(GATES)
        for low in range(0, len(windows), BLOCK):
            context, byte = _parts_of(windows[low : low + BLOCK])
            weight = n[low : low + BLOCK].astype(np.float32) if rate else None
            place, inside = np.zeros(len(context), np.int64), np.ones(len(context), bool)
            for k in range(_PLACES - 1):
                inside &= (context >> np.uint64(40 - 8 * k)) & np.uint64(255) != 32
                place += inside
            gained = np.zeros(len(context), np.float32)
            for rows, half in _halves(context, byte, self.bits):
                node = np.ones(len(half), np.int64)
                for s in (3, 2, 1, 0):
                    bit = (half >> s) & 1
                    value = bit.astype(np.float32)
                    x, often, some = self._inputs(rows + node, value, bool(rate))
                    gate = (place * _OFTEN + often) * _SOME + some // 2
                    z = np.clip(np.einsum("ki,ik->i", x, np.take(self.weights, gate, axis=0)), -18, 18)
                    p = _squash(z)
                    refined, cell = self._refined(gate, z)
                    mixed = np.clip((p + refined) / 2, np.float32(1e-6), np.float32(1 - 1e-6))
                    gained += np.log(np.where(bit, mixed, 1 - mixed))
                    if rate:
                        load = np.bincount(gate, weight, GATES)
                        sums[0][:] += self.weights * load[:, None]
                        sums[1][:] += self.refine * load[:, None]
                        used += load
                        self._learn(x, gate, cell, p, value, weight, load, rate)
                    node = node * 2 + bit
            total[low : low + BLOCK] = gained
        if rate:
            for table, mean in zip((self.weights, self.refine), sums):
                table[used > 0] = mean[used > 0] / used[used > 0, None]
        return total, used

    def _learn(self, x: np.ndarray, gate: np.ndarray, cell: np.ndarray, p: np.ndarray, value: np.ndarray, weight: np.ndarray, here: np.ndarray, rate: float) -> None:
        """Move the weights against the errors, over their curvature; a gate that saw few windows moves less."""
        error, curve = (value - p) * weight, (p * (1 - p) + np.float32(1e-3)) * weight
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        first = np.flatnonzero(np.diff(gate[order], prepend=-1))
        some, x = gate[order[first]], np.take(x, order, axis=1)
        pull, resist = (np.add.reduceat(v, first, axis=1).T for v in (x * error[order], x * x * curve[order]))
        pace = rate * np.minimum(1, np.sqrt(np.diff(first, append=len(order)) / 32)) / INPUTS
        self.weights[some] += pace[:, None] * pull / (resist + np.float32(0.02) * here[some, None].astype(np.float32) + np.float32(1e-9))
        hits = np.bincount(cell, weight, self.refine.size).reshape(self.refine.shape)
        ones = np.bincount(cell, weight * value, self.refine.size).reshape(self.refine.shape)
        self.refine += ((1 - 0.98 ** np.minimum(hits, 200)) * (ones / np.maximum(hits, 1e-9) - self.refine) * (hits > 0)).astype(np.float32)
        self.refine = np.clip(self.refine, 1e-4, 1 - 1e-4)


def train_mixer(windows: DataFrame, rate: float = 0.2) -> Mixer:
    """Counts of the bits of all windows (window, n), and weights and refinement learnt from each of them."""
    distinct, total = (int(x or 0) for x in windows.agg(F.count("*"), F.sum("n")).first())
    bits = table_bits(distinct)
    windows = windows.coalesce(max(1, distinct // PART))
    mixer = Mixer(bit_counts(windows, bits, total), bits)
    if not distinct or not rate:
        return mixer
    shared = windows.sparkSession.sparkContext.broadcast(mixer.counts)
    passes = min(4, -(-LEAST // distinct))
    tables = ("weights", "refine", "used")
    kind = ", ".join(f"{x} binary" for x in tables)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(x.shape) for x in (mixer.weights, mixer.refine, np.zeros((GATES, 1)))]
        held: list[pa.RecordBatch] = []

        def part() -> None:
            table = pa.Table.from_batches(held)
            held.clear()
            keys, n = table.column(0).to_numpy().astype(np.uint64), table.column(1).to_numpy()
            del table
            order = np.argsort(mix(keys))  # Any order will do that has no pattern.
            keys, n = keys[order], n[order]
            own = Mixer(shared.value, bits)
            for k in range(passes):
                used = own.run(keys, n, rate / (1 + k))[1][:, None]
            for total, x in zip(sums, (used * own.weights, used * own.refine, used)):
                total += x

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PART:
                part()
        if held:
            part()
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in sums], names=list(tables))

    def add(found: pa.Table) -> pa.Table:
        sums = [sum(np.frombuffer(x.as_buffer()) for x in found.column(name)) for name in tables]
        return pa.table({name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(tables, sums)})

    # A row from each task, 32 after that: what comes to the driver doesn't grow.
    counts, mixer.counts = mixer.counts, None
    rows = windows.mapInArrow(learn, kind).groupBy(F.spark_partition_id() % 32).applyInArrow(lambda _, t: add(t), kind).collect()
    shared.unpersist()
    mixer.counts = counts
    weights, refine, used = (sum(np.frombuffer(r[name]) for r in rows) for name in tables)
    seen = used > 0
    for table, total in ((mixer.weights, weights), (mixer.refine, refine)):
        table[seen] = (total.reshape(table.shape)[seen] / used[seen, None]).astype(np.float32)
    return mixer


class Memory:
    """Predictions of windows, the last that were made kept by a hash of the window."""

    def __init__(self, mixer: Mixer):
        self.mixer = mixer
        self.keys, self.values = np.full(1 << CACHE_BITS, (1 << 64) - 1, np.uint64), np.zeros(1 << CACHE_BITS, np.float32)

    def log_p(self, windows: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each window's byte after its context."""
        at = ((windows * _ODD) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        out = self.values[at]
        unknown = np.flatnonzero(self.keys[at] != windows)
        if len(unknown):
            missed = windows[unknown]
            new = _summed(missed.copy())[0]
            made = self.mixer.run(new)[0]
            out[unknown] = made[np.searchsorted(new, missed)]
            at = ((new * _ODD) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
            # Of windows with one place, the same must win in both arrays.
            at, last = np.unique(at, return_index=True)
            self.keys[at], self.values[at] = new[last], made[last]
        return out


def _earlier(keys: np.ndarray) -> np.ndarray:
    """For each key how many equal ones stand before it."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - np.repeat(first, np.diff(first, append=len(keys)))
    return out


def document_scores(log_p: np.ndarray, word: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Natural log of the probability of each text, of its words in order: their log_p, numbers and texts."""
    opens = np.append(True, owner[1:] != owner[:-1])
    nth = np.arange(len(word)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]
    most = int(word.max(initial=0)) + 1
    before = _earlier(owner * most + word)
    # A word has been followed as often as it occurred before; the first word has none before it.
    follows = np.where(opens, 0, np.append(0, before[:-1]))
    pair = (owner * most + np.append(0, word[:-1])) * (most + 1) + np.where(opens, most, word)
    paired = np.where(opens, 0, _earlier(pair))
    p, urns = np.exp(log_p), []
    for k, n in ((before, nth), (paired, follows)):
        again = np.flatnonzero(k)
        for a in URNS:
            gained = np.log(a) + log_p
            gained[again] = np.log(k[again] + a * p[again])
            urns.append(np.bincount(owner, gained - np.log(n + a), texts))
    return np.logaddexp.reduce(urns) - np.log(len(urns))


def frequent_words(words: DataFrame, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of the most frequent words of (word, c): all from some count on, `most` of them at most, and the end."""
    short, band = F.length("word") <= 64, F.floor(F.log("c") * 8)
    bands = words.filter(short).groupBy(band.alias("band")).agg(F.count("*").alias("n")).orderBy(F.desc("band")).collect()
    fits = np.cumsum([r["n"] for r in bands]) <= (HEAVY if most is None else most)
    least = min([r["band"] for r, ok in zip(bands, fits) if ok], default=1 << 10)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Streams([b" ".join(binary_list(batch.column(0)))]).hashes()[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), batch.column(1)], names=["hash", "c"])

    is_end = F.col("word") == F.lit(bytearray(END))
    top = words.filter(short & (band >= least) & ~is_end).mapInArrow(hashed, "hash long, c long").toArrow()
    ends = words.filter(is_end).agg(F.sum("c")).first()[0] or 0
    hashes = np.append(top.column("hash").to_numpy().view(np.uint64), Streams([b""]).hashes())
    order = np.argsort(hashes)
    return hashes[order], np.append(top.column("c").to_numpy(), ends)[order]


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
    with arrow_bytes(docs.sparkSession, BATCH):
        return materialize(_scored(docs, rate), "scores")


def _scored(docs: DataFrame, rate: float) -> DataFrame:
    """score() of (doc_id, text, is_train), before it is computed."""
    texts = docs.filter("is_train").select("text")
    words = materialize(count_words(texts), "words")
    total, distinct_words = (int(x or 0) for x in words.agg(F.sum("c"), F.count("*")).first())
    size = int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    windows = materialize(count_windows(texts.coalesce(max(TASKS, size // SPAN))), "windows")
    mixer = train_mixer(windows, rate)
    mixer.freeze()

    known = frequent_words(words)
    shared = docs.sparkSession.sparkContext.broadcast((mixer, *known))
    scale = float(np.log10(total + 0.5 * (distinct_words + 1)))
    kind = "row long, doc_id long, is_train boolean, n_bytes long, n_tokens long, n_known long, base double, log_p double, word binary, tf long"
    columns = [x.split()[0] for x in kind.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, heavy, heavy_counts = shared.value
        memory = Memory(mixer)
        for batch in batches:
            values, rows = binary_list(batch.column(1)), batch.column(3).to_numpy()
            for low, high in slices(values, SCORED):
                n, here = high - low, batch.slice(low, high - low)
                streams = Streams(values[low:high])
                log_p = np.add.reduceat(memory.log_p(streams.windows).astype(np.float64), streams.starts)
                found, first, word = np.unique(streams.hashes(), return_index=True, return_inverse=True)
                logs = document_scores(log_p, word, streams.owner, n)
                place = np.minimum(np.searchsorted(heavy, found), len(heavy) - 1)
                is_heavy = heavy[place] == found
                c = np.where(is_heavy, heavy_counts[place], 0)
                base = np.where(is_heavy, np.log10(c + 0.5) - scale, 0)
                of = lambda x, owner=streams.owner, n=n: np.bincount(owner, x, n)
                none = pa.nulls(n, pa.int64())
                # A word that no text has, and that spreads these rows.
                spread = pa.array([b" %d" % r for r in rows[low:high]], pa.binary())
                own = [here.column(3), here.column(0), here.column(2), pa.array(list(map(len, values[low:high])), pa.int64())]
                own += [pa.array(of(None)), pa.array(of((c > 0)[word]).astype(np.int64)), pa.array(of(base[word])), pa.array(logs)]
                yield pa.RecordBatch.from_arrays([*own, spread, none], names=columns)
                light = np.flatnonzero(~is_heavy)
                if len(light):
                    number = np.cumsum(~is_heavy) - 1
                    some = ~is_heavy[word]
                    keys, tf = _summed(streams.owner[some] * len(light) + number[word[some]])
                    names = pa.array(streams.words(first[light]), pa.binary()).take(pa.array(keys % len(light)))
                    empty = lambda k, n=len(keys): pa.nulls(n, k)
                    head = [pa.array(rows[low + keys // len(light)]), empty(pa.int64()), empty(pa.bool_()), *(empty(pa.int64()) for _ in range(3))]
                    yield pa.RecordBatch.from_arrays([*head, empty(pa.float64()), empty(pa.float64()), names, pa.array(tf)], names=columns)

    parts = docs.select("*", F.monotonically_increasing_id().alias("row")).mapInArrow(read, kind)
    joined = parts.join(words.select(F.col("word").alias("known_word"), "c"), F.col("word") == F.col("known_word"), "left")
    of_light = F.log10(F.coalesce("c", F.lit(0)) + 0.5) - scale
    rows = joined.groupBy("row").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "is_train", "n_bytes", "n_tokens")),
        F.sum(F.when(F.col("tf").isNull(), F.col("n_known")).when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.when(F.col("tf").isNull(), F.col("base")).otherwise(F.col("tf") * of_light)).alias("base_score"),
        (F.max("log_p") / _LN10).alias("score"),
    )
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10.0)) / F.col("n_bytes"))
    return rows.select("doc_id", "is_train", "n_bytes", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
