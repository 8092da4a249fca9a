"""Secrets in texts: three fixed patterns, and values in credential contexts that are hard to guess.

The patterns find assignments, access keys and long hexadecimal runs. Beyond them, whatever stands as
the value of a credential (a wider set of names, any signs, also as user:value@ in an address) is
priced by guess_cost; a value that takes `strong` bits or more is a secret of kind `guess`, unless a
pattern has it already. Names and addresses are found in the bytes of the UTF-8 text; offsets are
turned into code points for texts with findings only. One scan, nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathkit.llm.guess_cost import dictionary, guess_bits
from swathkit.llm.shared import binary_list, fresh

#: Order of kinds that start at one place.
KINDS = ("assign", "access", "hex", "guess")
# The patterns, and the least length of what they find.
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_LEAST_VALUE, _LEAST_ACCESS = 12, 18
_NAMED = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Names before a value, and the value up to white space, quotes or brackets.
_CONTEXT = re.compile(
    rb"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|auth|private|secret)[_-]?key|credentials?|auth(?:orization)?)["'`]?\x20{0,4}(?::|=>|={1,2})\x20{0,4}(?:bearer\x20|basic\x20)?["'`]?([^\s"'`<>,;]+)"""
    rb"""|://[^\s/:@"'<>]+:([^\s/@"'<>]+)@""",
    re.IGNORECASE,
)
_HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"auth", b"://")
_CLOSING = b".:!?)]}"
#: Values shorter than this aren't priced; a value of so many bits is a secret.
MIN_VALUE, STRONG = 6, 40.0


class Span(NamedTuple):
    """A finding: offsets in bytes, and the bits that its value takes to guess (kind guess)."""

    start: int
    end: int
    kind: int
    bits: float | None = None


def base_spans(data: bytes, low: bytes) -> list[Span]:
    """What the fixed patterns find, leftmost and without overlap within a kind. low: data with A-Z in lower case."""
    found: list[Span] = []
    if any(name in low for name in _NAMED):
        found += [Span(*m.span(), 0) for m in _ASSIGN.finditer(data) if m.end(2) - m.start(2) >= _LEAST_VALUE]
    if b"AKIA" in data:
        found += [Span(*m.span(), 1) for m in _ACCESS.finditer(data) if m.end() - m.start() >= _LEAST_ACCESS]
    found += [Span(*m.span(), 2) for m in _HEX.finditer(data)]
    return found


def guessed_spans(data: bytes, low: bytes, known: dict[str, float], strong: float) -> Iterator[Span]:
    """Values in credential contexts that take at least `strong` bits to guess."""
    if not any(hint in low for hint in _HINTS):
        return
    for match in _CONTEXT.finditer(data):
        k = 1 if match[1] is not None else 2
        value = match[k].rstrip(_CLOSING)
        if len(value) >= MIN_VALUE:
            bits = guess_bits(value.decode("utf-8", "replace"), known, strong)
            if bits >= strong:
                yield Span(match.start(k), match.start(k) + len(value), 3, bits)


def find(data: bytes, known: dict[str, float], strong: float = STRONG) -> list[Span]:
    """All findings of a text, by start, then kind. A guessed value within another finding is left out."""
    low = data.lower()
    base = base_spans(data, low)
    added = [s for s in guessed_spans(data, low, known, strong) if not any(b.start <= s.start and s.end <= b.end for b in base)]
    return sorted(base + added, key=lambda s: (s.start, s.kind))


def _in_code_points(data: bytes, spans: list[Span]) -> list[Span]:
    if not spans or data.isascii():
        return spans
    before = np.concatenate(([0], np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)))
    return [s._replace(start=int(before[s.start]), end=int(before[s.end])) for s in spans]


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def _scan(docs: DataFrame, path: str, strong: float, text_col: str, others: list[Column], schema: str, columns: Callable[[bytes, list[Span]], tuple]) -> DataFrame:
    """One row for each row of docs: `others`, then what `columns` makes of a text and its findings, as the rest of schema."""
    (text,) = fresh(docs, "text")
    rows = docs.select(F.col(f"`{text_col}`").cast("binary").alias(text), *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dictionary(path)
        for batch in batches:
            made = [columns(data, find(data, known, strong)) for data in binary_list(batch.column(0))]
            new = [pa.array(values) for values in zip(*made)] if made else []
            if new:
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], names=[*batch.schema.names[1:], *names])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    names = [part.split()[0] for part in schema.split(", ")]
    return rows.mapInArrow(run, ", ".join([*kept, schema]))


def secret_digests(docs: DataFrame, path: str, strong: float = STRONG, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans: one row per row of docs.

    path: the ranked word list of guess_cost. spans lists kind:start:end of all findings in code
    points, end exclusive, by start and kind; base_sha256 is the digest of the same list without those
    of kind guess. Null and empty texts have none; ids may be null or repeat; other columns aren't read.
    """

    def digests(data: bytes, found: list[Span]) -> tuple:
        spans = _in_code_points(data, found)
        counts = [sum(s.kind == k for s in spans) for k in range(len(KINDS))]
        return *counts, hashlib.sha256(_listed([s for s in spans if s.kind < 3]).encode()).hexdigest(), _listed(spans)

    schema = "n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    return _scan(docs, path, strong, text_col, [F.col(f"`{id_col}`").alias("doc_id")], schema, digests)


def locate(docs: DataFrame, path: str, strong: float = STRONG, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kind, start, end, secret, bits: one row per finding, with its text; bits (of kind guess) are `strong` where pricing stopped there."""

    def located(data: bytes, found: list[Span]) -> tuple:
        spans = _in_code_points(data, found)
        return ([{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "secret": data[b.start : b.end].decode(), "bits": s.bits} for s, b in zip(spans, found)],)

    one = "array<struct<kind:string,start:bigint,end:bigint,secret:string,bits:double>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string()), ("bits", pa.float64())]))
    rows = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text"), F.col(f"`{id_col}`").alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dictionary(path)
        for batch in batches:
            made = [located(data, find(data, known, strong))[0] for data in binary_list(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(made, kind)], names=["doc_id", "found"])

    found = rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, found {one}")
    return found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def redact(docs: DataFrame, path: str, strong: float = STRONG, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every finding in the text replaced by a mark, findings that overlap by one; all other columns and rows stay, null texts too."""
    (new,) = fresh(docs, "redacted")

    def redacted(data: bytes, found: list[Span]) -> tuple:
        out, at, last = [], 0, -1
        for s in found:
            if s.start >= last:
                out += [data[at : s.start], mark.encode()]
            at = last = max(last, s.end)
        return (b"".join([*out, data[at:]]).decode(),)

    names = [F.col(f"`{c}`") for c in docs.columns]
    made = _scan(docs, path, strong, text_col, names, f"{new} string", redacted)
    text = F.when(F.col(f"`{text_col}`").isNotNull(), F.col(new)).alias(text_col)
    return made.select(*[text if c == text_col else F.col(f"`{c}`") for c in docs.columns])
