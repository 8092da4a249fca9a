"""Words that differ by one letter, grouped under their most frequent form.

Words are counted in Spark; a batch's words are combined before they leave the task. Each word has a
vector: how often it uses the letters of each of a few groups. One inserted, deleted or replaced letter
raises one of these counts by one, lowers one by one, or both. So the words form a trie of successive
counts, which a depth-first search walks with a budget of one surplus and one deficit; the words at the
leaves are verified letter by letter.

The upper levels of the trie are the shuffle: a word stands under its own upper counts, and is sought
under all upper counts within the budget. Under counts with many words, words are dealt to chunks and
those that seek to blocks; a task holds one chunk, and the seekers of a block stream past. What leaves
it is one row for each seeker and chunk, however many words are near: their number and the best of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from itertools import product
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathkit.llm.crc_spans import joined, span_crcs
from swathkit.llm.shared import binary_list, materialize, slices

MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
#: One run in so many (by checksum) loses a letter.
SLIP = 199
#: Letter groups, and how many of their counts are levels of the shuffle.
GROUPS, UPPER = 12, 4
#: Words of a chunk and seekers of a block.
CHUNK = 1 << 15
#: Rows that may be broadcast: two words each.
SMALL = 200_000
_AT_ONCE = 1 << 21
_WIDE = 32
_PAIRS = 1 << 15
_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, code points) of the runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8; the latter are C3 and one more byte."""
    lead = data == 0xC3
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[0::2], edges[1::2]
    points = np.concatenate(([0], np.cumsum(data & 0xC0 != 0x80)))
    return starts, ends, points[ends] - points[starts]


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of data as strings. They don't overlap and are in order."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    kept = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept))


def _words_of(ids: list[str], values: list[bytes]) -> pa.Table:
    """word, n of some texts."""
    data = _LOWER[np.frombuffer(b"\n".join(values) + b"\n", np.uint8)]
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, values), np.int64, len(values)) + 1)))
    starts, ends, points = _runs(data)
    long = points >= MIN_LETTERS
    starts, ends, points = starts[long], ends[long], points[long]
    owner = np.searchsorted(offsets, starts, side="right") - 1
    prefixes = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    h = joined(prefixes[owner], span_crcs(data, starts, ends), ends - starts)
    slips = h % np.uint32(SLIP) == 0
    counted = pc.value_counts(_gathered(data, starts[~slips], ends[~slips]))
    shorter = []
    for k in np.flatnonzero(slips & (points > MIN_LETTERS)).tolist():
        run = data[starts[k] : ends[k]].tobytes().decode()
        at = int(h[k]) % len(run)
        shorter.append(run[:at] + run[at + 1 :])
    words = pa.concat_arrays([counted.field("values"), pa.array(shorter, pa.large_string())])
    return pa.table({"word": words, "n": pa.concat_arrays([counted.field("counts"), pa.array([1] * len(shorter), pa.int64())])})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, values = batch.column(0).to_pylist(), binary_list(batch.column(1))
        parts = [_words_of(ids[a:b], values[a:b]) for a, b in slices(values, _AT_ONCE)]
        if parts:
            found = pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")])
            yield from found.select(["word", "n_sum"]).rename_columns(["word", "n"]).cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).combine_chunks().to_batches()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_COUNT) -> DataFrame:
    """word, n: runs of letters with A-Z in lower case, one in SLIP without one of its letters, of at least MIN_LETTERS code points and `least` occurrences."""
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def letter_groups(words: DataFrame) -> list[str]:
    """The letters in use, dealt to GROUPS groups by how many words have them, so that each group is used about equally. One row per letter reaches the driver: 90 at most."""
    counts = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).filter("letter <> ''").groupBy("letter").count()
    letters = [r.letter for r in counts.orderBy(F.desc("count"), "letter").collect()]
    there_and_back = [*range(GROUPS), *reversed(range(GROUPS))]
    groups = [""] * GROUPS
    for k, letter in enumerate(letters):
        groups[there_and_back[k % len(there_and_back)]] += letter
    return groups


def _budgeted() -> list[tuple[list[int], int, int]]:
    """(change of each upper count, surplus left, deficit left): all changes within the budget."""
    changes = [c for c in product((-1, 0, 1), repeat=UPPER) if c.count(1) <= 1 and c.count(-1) <= 1]
    return [(list(c), 1 - c.count(1), 1 - c.count(-1)) for c in changes]


class _Words:
    """Some words: their counts by group, and their letters as padded rows if they fit."""

    def __init__(self, words: list[str], groups: np.ndarray):
        self.text = [w.encode("latin-1") for w in words]
        self.size = np.fromiter(map(len, self.text), np.int64, len(words))
        letters = np.frombuffer(b"".join(self.text), np.uint8)
        owner = np.repeat(np.arange(len(words)), self.size)
        self.counts = np.bincount(owner * GROUPS + groups[letters], minlength=len(words) * GROUPS).reshape(-1, GROUPS)[:, UPPER:]
        self.rows = np.zeros((len(words), _WIDE), np.uint8)
        column = np.arange(len(letters)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        fits = column < _WIDE
        self.rows[owner[fits], column[fits]] = letters[fits]


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced letter makes b of a."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = len(commonprefix([a, b]))
    if len(a) == len(b):
        return k < len(a) and a[k + 1 :] == b[k + 1 :]
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def _verified(seekers: _Words, table: _Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs of seekers and table words whether they differ by exactly one letter."""
    gap = seekers.size[i] - table.size[j]
    out = np.zeros(len(i), bool)
    fits = np.maximum(seekers.size[i], table.size[j]) <= _WIDE
    for k in np.flatnonzero(~fits & (np.abs(gap) <= 1)).tolist():
        out[k] = one_edit(seekers.text[i[k]], table.text[j[k]])
    same = np.flatnonzero(fits & (gap == 0))
    out[same] = (seekers.rows[i[same]] != table.rows[j[same]]).sum(axis=1) == 1
    for longer, shorter, k in ((seekers.rows[i], table.rows[j], np.flatnonzero(fits & (gap == 1))), (table.rows[j], seekers.rows[i], np.flatnonzero(fits & (gap == -1)))):
        long, short = longer[k], shorter[k]
        first = (long != short).argmax(axis=1)
        behind = np.arange(_WIDE - 1) >= first[:, None]
        out[k] = ~((long[:, 1:] != short[:, :-1]) & behind).any(axis=1)
    return out


class _Trie:
    """Words of a chunk in the order of their counts: a node is a range of them."""

    def __init__(self, words: list[str], n: list[int], groups: np.ndarray):
        self.words, self.n, self.groups = words, np.array(n, np.int64), groups
        self.table = _Words(words, groups)
        order = np.lexsort(self.table.counts.T[::-1])
        self.order, self.counts = order, self.table.counts[order]
        # Places in the order of what makes the better form: more occurrences, then the smaller word.
        best = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
        self.best = np.array(best)
        self.place = np.empty(len(words), np.int64)
        self.place[best] = np.arange(len(words))

    def search(self, words: list[str], surplus: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many words are near each of the given ones; the place of the best of them, or the number of words)."""
        seekers = _Words(words, self.groups)
        near, best = np.zeros(len(words), np.int64), np.full(len(words), len(self.words))
        stack = [(0, 0, len(self.words), np.arange(len(words)), surplus, deficit)]
        while stack:
            level, low, high, rows, up, down = stack.pop()
            if level == self.counts.shape[1] or (high - low) * len(rows) <= _PAIRS:
                self._leaf(seekers, low, high, rows, up, down, level, near, best)
                continue
            column = self.counts[low:high, level]
            edges = np.concatenate(([0], np.flatnonzero(np.diff(column)) + 1, [high - low]))
            own = seekers.counts[rows, level]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                more = column[a] - own
                open_ = (more <= up) & (-more <= down)
                if open_.any():
                    more = more[open_]
                    stack.append((level + 1, low + a, low + b, rows[open_], up[open_] - np.maximum(more, 0), down[open_] - np.maximum(-more, 0)))
        return near, best

    def _leaf(self, seekers: _Words, low: int, high: int, rows: np.ndarray, up: np.ndarray, down: np.ndarray, level: int, near: np.ndarray, best: np.ndarray) -> None:
        """Verify the words of a node against the seekers that reach it, some pairs at a time."""
        wide = max(1, _PAIRS // max(len(rows), 1))
        step = max(1, _PAIRS // wide)
        for a in range(low, high, wide):
            for b in range(0, len(rows), step):
                some = rows[b : b + step]
                more = self.counts[None, a : min(a + wide, high), level:] - seekers.counts[some, None, level:]
                fit = (np.maximum(more, 0).sum(axis=2) <= up[b : b + step, None]) & (np.maximum(-more, 0).sum(axis=2) <= down[b : b + step, None])
                i, j = np.nonzero(fit)
                i, j = some[i], self.order[a + j]
                good = _verified(seekers, self.table, i, j)
                np.add.at(near, i[good], 1)
                np.minimum.at(best, i[good], self.place[j[good]])


def _search(batches: Iterator[pa.RecordBatch], groups: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows in order of group, words of the table before those that seek: near words of each of the latter in its group."""
    group, trie, words, counts = None, None, [], []
    for batch in batches:
        keys, roles = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(zero_copy_only=False)
        text, n = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        surplus, deficit = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (4, 5))
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (roles[1:] != roles[:-1])) + 1).tolist(), len(keys)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            if keys[a] != group:
                group, trie, words, counts = keys[a], None, [], []
            if roles[a] == 0:
                words += text[a:b]
                counts += n[a:b]
                continue
            if not words:
                continue
            trie = trie or _Trie(words, counts, groups)
            near, best = trie.search(text[a:b], surplus[a:b], deficit[a:b])
            hit = np.flatnonzero(near)
            form = trie.best[best[hit]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([text[a + k] for k in hit.tolist()], pa.string()), pa.array(near[hit]), pa.array([words[k] for k in form.tolist()], pa.string()), pa.array(trie.n[form])],
                names=["word", "n_near", "form", "form_n"],
            )


def near_words(words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """word, n_near, best (struct<minus: -n, form>): how many words are one letter off, and the most frequent of them, of words (word, n) without repeats."""
    letters = letter_groups(words)
    table = np.zeros(256, np.int64)
    for k, group in enumerate(letters):
        for letter in group:
            table[ord(letter)] = k
    upper = [F.char_length("word") - F.char_length(F.translate("word", group, "")) if group else F.lit(0) for group in letters[:UPPER]]
    placed = words.withColumn("upper", F.array(*upper))
    key = lambda counts: F.array_join(counts.cast("array<string>"), ".")
    changes = F.array(*[F.struct(F.array(*map(F.lit, c)).alias("change"), F.lit(up).alias("up"), F.lit(down).alias("down")) for c, up, down in _budgeted()])
    seeking = placed.withColumn("c", F.explode(changes)).withColumn("sought", F.zip_with("upper", "c.change", lambda a, b: a + b))
    seeking = seeking.filter(F.forall("sought", lambda a: a >= 0)).select(key(F.col("sought")).alias("key"), "word", "n", "c.up", "c.down")
    standing = placed.select(key(F.col("upper")).alias("key"), "word", "n")
    # How many chunks of words and blocks of seekers each key has; keys without words drop out.
    sizes = standing.groupBy("key").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    sizes = sizes.join(seeking.groupBy("key").agg(F.ceil(F.count("*") / chunk).cast("int").alias("blocks")), "key")
    sizes = materialize(sizes, "sizes")
    dealt = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    group = F.concat_ws("/", "key", "chunk", "block").alias("group")
    table_rows = standing.join(sizes, "key").withColumn("chunk", dealt("chunks")).withColumn("block", each("blocks"))
    table_rows = table_rows.select(group, F.lit(0).alias("role"), "word", "n", F.lit(0).alias("up"), F.lit(0).alias("down"))
    seek_rows = seeking.join(sizes, "key").withColumn("block", dealt("blocks")).withColumn("chunk", each("chunks"))
    seek_rows = seek_rows.select(group, F.lit(1).alias("role"), "word", "n", "up", "down")
    rows = table_rows.unionByName(seek_rows).repartition("group").sortWithinPartitions("group", "role")
    found = rows.mapInArrow(partial(_search, groups=table), "word string, n_near long, form string, form_n long")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("minus"), "form")).alias("best"))


def roots(forms: DataFrame, small: int = SMALL) -> DataFrame:
    """word, root: the last of the forms that follow each other from a word, for the words of forms (word, form) that have one.

    Each round doubles the steps that are known. A form is several times as frequent as its word, so the
    rounds are few. Targets that lead on are far fewer than words and are broadcast up to `small` rows.
    """
    hops = materialize(forms.filter("form is not null").select("word", F.col("form").alias("root")), "hops")
    while True:
        ahead = hops.select("root").distinct().join(hops.select(F.col("word").alias("root"), F.col("root").alias("next")), "root")
        ahead = materialize(ahead, "ahead")
        count = ahead.count()
        if count == 0:
            return hops
        known = F.broadcast(ahead) if count <= small else ahead
        hops = materialize(hops.join(known, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "hops")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, chunk: int = CHUNK) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of at least MIN_LETTERS code points that occurs at least MIN_COUNT times.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case; where the CRC-32 of
    `<doc_id>:<run>` is a multiple of SLIP, the run loses the code point at that number modulo its
    length. n counts occurrences, n_near the words that differ by exactly one inserted, deleted or
    replaced code point; form is the near word of largest n (ties: the smaller word) if that is at
    least `ratio` times n, else null, like form_n; root is the last word that forms lead to, the word
    itself if there is none. Null and empty texts have no words; a null id counts as empty text; rows
    that repeat count again; other columns are not read; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 at least: forms must become more frequent")
    words = materialize(word_counts(docs, id_col, text_col), "words")
    near = near_words(words, chunk)
    found = words.join(near, "word", "left").withColumn("form_n", F.when(-F.col("best.minus") >= ratio * F.col("n"), -F.col("best.minus")))
    forms = materialize(found.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"), "forms")
    return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
