"""CRC-32 of many spans of one byte buffer at once.

The checksum is linear but for a constant: each byte contributes a word that depends on its value and
its distance from the end of the span, and the contributions are XORed. They are looked up in one
table of distance and byte for distances below BLOCK; a span's length adds a constant. Longer spans
are cut into blocks from their end, whose words are folded two by two, the left one moved on by the
length of the right one.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64
#: Blocks that are looked up at a time: some MB of work space, however long the spans are.
_AT_ONCE = 1 << 14
_BITS = BLOCK.bit_length() - 1
_ONES = np.uint32(0xFFFFFFFF)


def _steps() -> np.ndarray:
    """What each value of the lowest byte becomes when a zero byte is fed in (reflected polynomial of CRC-32)."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = (value >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (value & np.uint32(1)))
    return value


_STEPS = _steps()


def _fed(state: np.ndarray) -> np.ndarray:
    """The state after one zero byte."""
    return (state >> np.uint32(8)) ^ _STEPS[state & np.uint32(255)]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(contribution at distance * 256 + byte; state of an empty message after 0, 1, .. BLOCK - 1 zero bytes)."""
    rows, states = [_STEPS], [np.array([_ONES])]
    for _ in range(BLOCK - 1):
        rows.append(_fed(rows[-1]))
        states.append(_fed(states[-1]))
    return np.concatenate(rows), np.concatenate(states)


_POSITION, _EMPTY = _tables()
#: For each power of two of zero bytes, what each byte of the state becomes: 4 x 256 words.
_moves: list[np.ndarray] = []


def _move(state: np.ndarray, power: int) -> np.ndarray:
    """The state after 2**power zero bytes."""
    while len(_moves) <= power:
        table = np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)
        _moves.append(_fed(table) if not _moves else _move(_move(table, len(_moves) - 1), len(_moves) - 1))
    table = _moves[power]
    moved = table[0][state & np.uint32(255)]
    for k in (1, 2, 3):
        moved = moved ^ table[k][(state >> np.uint32(8 * k)) & np.uint32(255)]
    return moved


def moved(state: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each state after its own number of zero bytes."""
    for power in range(int(zeros.max(initial=0)).bit_length()):
        state = np.where((zeros >> power) & 1 == 1, _move(state, power), state)
    return state


def joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums of A + B from those of A and B, and B's length."""
    return moved(first, size) ^ second


def _constants(sizes: np.ndarray) -> np.ndarray:
    """What a span's length alone contributes: the checksum of so many zero bytes."""
    return moved_blocks(_EMPTY[sizes % BLOCK], sizes // BLOCK) ^ _ONES


def moved_blocks(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    for power in range(int(blocks.max(initial=0)).bit_length()):
        state = np.where((blocks >> power) & 1 == 1, _move(state, _BITS + power), state)
    return state


def _words(data: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XOR of the contributions of each span of 1 to BLOCK bytes."""
    after = np.cumsum(sizes)
    distance = np.repeat(after, sizes) - 1 - np.arange(after[-1])
    at = np.repeat(ends, sizes) - 1 - distance
    return np.bitwise_xor.reduceat(_POSITION[distance * 256 + data[at]], after - sizes)


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 (uint32) of data[start:end] for each span, none of them empty. Spans may overlap, data is uint8."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    sizes = ends - starts
    blocks = (sizes + BLOCK - 1) // BLOCK
    # Blocks of a span in order; `after` counts those that follow in the same span.
    span = np.repeat(np.arange(len(starts)), blocks)
    after = np.repeat(np.cumsum(blocks), blocks) - 1 - np.arange(len(span))
    block_ends = ends[span] - after * BLOCK
    block_sizes = np.minimum(block_ends - starts[span], BLOCK)
    words = np.concatenate([_words(data, block_ends[i : i + _AT_ONCE], block_sizes[i : i + _AT_ONCE]) for i in range(0, len(span), _AT_ONCE)])
    power = _BITS
    while len(words) > len(starts):
        words = np.where(after & 1 == 1, _move(words, power), words)
        after >>= 1
        first = np.flatnonzero(np.concatenate(([True], (span[1:] != span[:-1]) | (after[1:] != after[:-1]))))
        words, span, after = np.bitwise_xor.reduceat(words, first), span[first], after[first]
        power += 1
    return words ^ _constants(sizes)
