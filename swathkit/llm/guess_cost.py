"""How many bits of guessing a password takes: the cheapest way to cut it into parts that a guesser knows.

Parts are dictionary words (also with capitals and look-alike signs), dates, repeated units, keyboard
walks, and spans that only brute force finds. One pass over the positions keeps the least cost of each
prefix; every part adds its own bits and those of choosing its kind.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

#: Bits for the choice among the five kinds of parts.
KIND_BITS = math.log2(5)
MIN_WORD, MAX_WORD = 3, 20
MAX_UNIT = 16
MIN_WALK = 4
_LOOKALIKES = str.maketrans("@4301!$57", "aaeoiisst")
_YEARS = range(1900, 2051)
_DATE = re.compile(r"(?P<y>\d{4})(?P<s>[-/._]?)(?P<m>\d{2})(?P=s)(?P<d>\d{2})|(?P<d2>\d{2})(?P<s2>[-/._]?)(?P<m2>\d{2})(?P=s2)(?P<y2>\d{4})")
_DATE_BITS, _YEAR_BITS = math.log2(len(_YEARS) * 366), math.log2(len(_YEARS))
# Classes of characters that a brute-force span may use, with the bits of one character. Letters of one
# case alone count less than random ones do, as unknown words look like that.
_LOWER, _UPPER, _DIGIT, _OTHER = 1, 2, 4, 8
_SPANS = ((_LOWER, 3.0), (_UPPER, 3.0), (_DIGIT, math.log2(10)), (_LOWER | _DIGIT, math.log2(36)), (_UPPER | _DIGIT, math.log2(36)), (_LOWER | _UPPER | _DIGIT, math.log2(62)), (15, math.log2(95)))
_ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
_SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
_KEYS = {key: (x, y) for y, row in enumerate(_ROWS) for x, key in enumerate(row) if key != " "}
#: Steps from a key to those beside it; each row stands half a key to the right of the one above.
_STEPS = {(1, 0), (-1, 0), (0, 1), (-1, 1), (0, -1), (1, -1)}


@lru_cache(maxsize=4)
def dictionary(path: str) -> dict[str, float]:
    """Bits of each whole word of a ranked word list: the vocabulary of a tokenizers file whose tokens end words in </w>, in order of ids."""
    with open(path, encoding="utf-8") as file:
        ids = json.load(file)["model"]["vocab"]
    words = (t.removesuffix("</w>") for t in sorted(ids, key=ids.get) if t.endswith("</w>"))
    ranked = [w for w in words if MIN_WORD <= len(w) <= MAX_WORD and w.isascii() and w.isalpha()]
    return {w: math.log2(rank) for rank, w in enumerate(ranked, 2)}


def _class(c: str) -> int:
    if not c.isascii():
        return _OTHER
    return _LOWER if c.islower() else _UPPER if c.isupper() else _DIGIT if c.isdigit() else _OTHER


def _capital_bits(word: str) -> float:
    n = sum(c.isupper() for c in word)
    if n == 0:
        return 0.0
    return 1.0 if n == len(word) or (n == 1 and word[0].isupper()) else math.log2(math.comb(len(word), n)) + 1


def _words(text: str, i: int, known: dict[str, float]):
    for j in range(i + MIN_WORD, min(i + MAX_WORD, len(text)) + 1):
        part = text[i:j]
        low = part.lower()
        if low in known:
            yield j, known[low] + _capital_bits(part)
        plain = low.translate(_LOOKALIKES)
        if plain != low and plain in known:
            yield j, known[plain] + _capital_bits(part) + sum(a != b for a, b in zip(plain, low))


def _dates(text: str, i: int):
    if not text[i].isdigit():
        return
    if len(text) >= i + 4 and text[i : i + 4].isdecimal() and int(text[i : i + 4]) in _YEARS:
        yield i + 4, _YEAR_BITS
    if found := _DATE.match(text, i):
        year, month, day, sign = (found["y"], found["m"], found["d"], found["s"]) if found["y"] else (found["y2"], found["m2"], found["d2"], found["s2"])
        if int(year) in _YEARS and (1 <= int(month) <= 12 and 1 <= int(day) <= 31 or 1 <= int(day) <= 12 and 1 <= int(month) <= 31):
            yield found.end(), _DATE_BITS + (2.0 if sign else 0.0)


def _walk(keys: str, i: int) -> tuple[int, int]:
    """(end of the walk of keys side by side from i, changes of direction)."""
    j, turns, step = i, 0, None
    while j + 1 < len(keys) and keys[j] in _KEYS and keys[j + 1] in _KEYS:
        (x, y), (x2, y2) = _KEYS[keys[j]], _KEYS[keys[j + 1]]
        now = (x2 - x, y2 - y)
        if now not in _STEPS:
            break
        turns += step is not None and now != step
        step, j = now, j + 1
    return j + 1, turns


def guess_bits(text: str, known: dict[str, float], enough: float = math.inf) -> float:
    """Least bits of all ways to cut a text into parts; 0 for an empty one. Stops at `enough` if no way costs less, and returns that."""
    n = len(text)
    if n == 0:
        return 0.0
    keys = text.lower().translate(_SHIFTED)
    best: dict[int, float] = {0: 0.0}
    spans = [math.inf] * len(_SPANS)
    units: dict[str, float] = {}
    # The farthest end of a part that leaves the cost below `enough`.
    reach = walked = 0

    def put(j: int, bits: float) -> None:
        nonlocal reach
        if bits < best.get(j, math.inf):
            best[j] = bits
            if bits < enough:
                reach = max(reach, j)

    for i in range(n):
        here = best.pop(i, math.inf)
        if here < enough:
            start = here + KIND_BITS
            for j, bits in _words(text, i, known):
                put(j, start + bits)
            for j, bits in _dates(text, i):
                put(j, start + bits)
            for u in range(1, min(MAX_UNIT, (n - i) // 2) + 1):
                # Only where a run of repeats begins, so that each run is walked through once.
                if i and text[i - 1] == text[i - 1 + u]:
                    continue
                j = i
                while j + u < n and text[j] == text[j + u]:
                    j += 1
                times = (j - i) // u + 1
                if times > 1:
                    unit = text[i : i + u]
                    if unit not in units:
                        units[unit] = guess_bits(unit, known)
                    put(i + times * u, start + units[unit] + math.log2(times))
            if i >= walked:
                j, turns = _walk(keys, i)
                walked = max(walked, j - 1)
                if j - i >= MIN_WALK:
                    shift = any(a != b for a, b in zip(text[i:j].lower(), keys[i:j]))
                    put(j, start + math.log2(len(_KEYS)) + math.log2(j - i) + turns * math.log2(len(_STEPS)) + shift)
        kind = _class(text[i])
        for k, (allowed, bits) in enumerate(_SPANS):
            spans[k] = min(spans[k], here + KIND_BITS) + bits if kind & allowed else math.inf
        least = min(spans)
        put(i + 1, least)
        if reach <= i and least >= enough:
            return enough
    return min(best[n], enough)
