"""What metadata documents say, in one parse each: texts of some elements, and lists of numbers of others."""

from __future__ import annotations

from collections.abc import Callable
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_KIND = "ok boolean, first array<string>, lists array<array<double>>"
_ARROW = pa.struct([("ok", pa.bool_()), ("first", pa.list_(pa.string())), ("lists", pa.list_(pa.list_(pa.float64())))])


def _numbers(text: str) -> list[float] | None:
    try:
        return [float(part) for part in text.split()]
    except ValueError:
        return None


def read_elements(text: str | None, tags: tuple[str, ...], listed: str, by_end: bool) -> tuple[bool, list[str | None], list[list[float] | None]]:
    """(well-formed; text of the first element of each tag, None if there is none; numbers of the listed elements, None where they aren't numbers).

    An element's text ends at its first child. by_end: tags are what names end with, elements without
    text are passed over, and all listed elements count; else names are equal to the tags, and the
    first element of each counts even if it has no text.
    """
    wanted = (*tags, listed)
    texts: list[list[str]] = [[] for _ in wanted]
    which, held = -1, []

    def close() -> None:
        nonlocal which, held
        if which >= 0:
            found = "".join(held)
            if found or not by_end:
                texts[which].append(found)
            which, held = -1, []
            parser.CharacterDataHandler = None

    def start(name: str, _: dict) -> None:
        nonlocal which
        close()
        local = name.rpartition("}")[2]
        for k, tag in enumerate(wanted):
            if (local.endswith(tag) if by_end else local == tag) and (not texts[k] or (by_end and k == len(tags))):
                which = k
                parser.CharacterDataHandler = held.append
                break

    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = start, lambda _: close()
    try:
        parser.Parse(text or "", True)
    except expat.ExpatError:
        return False, [None] * len(tags), []
    return True, [t[0] if t else None for t in texts[:-1]], [_numbers(t) for t in texts[-1]]


def first_and_lists(tags: tuple[str, ...], listed: str, by_end: bool = False) -> Callable[[Column], Column]:
    """A function of a Column of XML texts: struct<ok, first, lists> of read_elements."""

    @F.arrow_udf(_KIND)
    def read(texts: pa.Array) -> pa.Array:
        found = [read_elements(t, tags, listed, by_end) for t in texts.to_pylist()]
        return pa.array([{"ok": ok, "first": first, "lists": lists} for ok, first, lists in found], _ARROW)

    return read
