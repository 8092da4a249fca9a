"""What the operators of this folder share: byte views of text columns, and the scratch tables of the sources."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathkit.sources.scratch import materialize, scratch_path  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def lower_ascii(text: Column) -> Column:
    """A-Z only. Pure ASCII text takes the byte-wise lower(); other text may not, as lower() changes more letters there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def binary_list(column: pa.Array) -> list[bytes]:
    """The column's values as bytes, null as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_binary(column.type) else column
    return pc.fill_null(column, b"").to_pylist()


@contextmanager
def arrow_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """What is computed within hands its rows to Python in batches of about so many bytes at most (or of one row)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def slices(values: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive values of at most limit bytes together; a longer value is alone."""
    start = total = 0
    for i, value in enumerate(values):
        if i > start and total + len(value) > limit:
            yield start, i
            start, total = i, 0
        total += len(value)
    if start < len(values):
        yield start, len(values)


def text_keys(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text that don't depend on each other: with an id, a key of rows whose ids may be null or repeat."""
    return [F.xxhash64(F.lit(k), text) for k in (1, 2)]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd multiplier mod 2**64, and of its inverse."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        made = []
        for base in (_P, _P_INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _POWERS.clear()
        _POWERS[size] = (made[0], made[1])
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Words:
    """Words of several byte strings at once: starts, ends, owning string, and hashes of any part of a word.

    keep is a table of 256 booleans: the byte values that belong to words. Values are joined by a
    byte outside of words, so no word crosses from one to the next.
    """

    def __init__(self, values: list[bytes], keep: np.ndarray, gap: bytes = b"\n"):
        self.data = np.frombuffer(gap.join(values) + gap, np.uint8)
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        self.offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
        inside = keep[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate(([0], edges))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.owner = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self._sums: np.ndarray | None = None

    def hashes(self, first: int | None = None) -> np.ndarray:
        """Hash of each word, or of its first bytes."""
        up, down = powers(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=self._sums[1:])
        ends = self.ends if first is None else np.minimum(self.ends, self.starts + first)
        return mix((self._sums[ends] - self._sums[self.starts]) * down[self.starts])


def byte_table(allowed) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[b for b in range(256) if allowed(b)]] = True
    return table


#: Letters, digits and every byte of a non-ASCII character.
ALNUM = byte_table(lambda b: b >= 0x80 or chr(b).isalnum())
LETTERS = byte_table(lambda b: b >= 0x80 or chr(b).isalpha())
#: Words between white space, as [^\x20\x09-\x0D]+ has them.
SOLID = byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
