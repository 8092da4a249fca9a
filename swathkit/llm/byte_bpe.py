"""Byte-level BPE over padded numpy matrices.

The distinct pieces of a block of texts are put in matrices by length: one row per piece, one token
per cell, padded to the bucket's width. Every round each row merges its leftmost pair of least rank,
found in a hash table of token pairs; the row is compacted by one cell and the ranks of the two pairs
beside the merge are looked up again. Rows without a mergeable pair leave the matrix. Pieces longer
than `_LONG` bytes, where rounds over a row would cost the square of its length, merge by a heap with
the same rule. Pieces are cached within bounds, so a frequent word is merged once per task.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PAD = 0xFFFF
_NONE = np.int64(1 << 40)
_LONG = 2048
_BLOCK = 1 << 20
_CACHED = 250_000
#: The split pattern of the 50k rank files (fixed value), and the same for texts of white space, printable ASCII and U+00A1 to U+00FF.
_USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r "
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_LATIN_TEXT = re.compile("[\t-\r -~\xa1-\xff]*")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PairTable:
    """Open-addressing hash table: (left token, right token) -> merged token, looked up for whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= _PAD:
            raise ValueError("ranks must be below 65535")
        pairs = [(ranks[a] << 16 | ranks[b], rank) for token, rank in ranks.items() for i in range(1, len(token)) if (a := token[:i]) in ranks and (b := token[i:]) in ranks]
        keys = np.array([k for k, _ in pairs], np.uint32)
        values = np.array([v for _, v in pairs], np.int64)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, 0xFFFFFFFF, np.uint32)
        self.values = np.full(1 << self.bits, _NONE, np.int64)
        self.probes, slot, left = 0, self._slot(keys), np.arange(len(keys))
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] == 0xFFFFFFFF
            _, first = np.unique(slot[left][free], return_index=True)
            put = left[free][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = left[~np.isin(left, put)]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a number above all ranks."""
        keys = (left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)).ravel()
        slot = self._slot(keys)
        found = np.where(self.keys[slot] == keys, self.values[slot], _NONE)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != 0xFFFFFFFF))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there != 0xFFFFFFFF)]
        return found.reshape(left.shape)


class ByteBpe:
    """Encoder and decoder for a rank file and a split pattern."""

    def __init__(self, path: str, pattern: str):
        self.token_rank = load_ranks(path)
        missing = [b for b in range(256) if bytes([b]) not in self.token_rank]
        if missing:
            raise ValueError(f"no rank for the bytes {missing[:5]}")
        self.single = np.array([self.token_rank[bytes([b])] for b in range(256)], np.int64)
        self.token = dict(zip(self.token_rank.values(), self.token_rank))
        self.table = PairTable(self.token_rank)
        self.decimal = {i: str(i) for i in self.token}
        self.token_size = np.zeros(max(self.token) + 1, np.int64)
        self.token_size[list(self.token)] = [len(t) for t in self.token.values()]
        self.split = regex.compile(pattern)
        self.usual = pattern == _USUAL
        self.text_ids: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces (none of them empty) in one row, and how many each piece has."""
        flat: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.token_rank.get(piece)
            if rank is not None:
                buckets.setdefault(0, []).append(i)
            elif len(piece) > _LONG:
                flat.append(np.array(self._merge_long(piece), np.int64))
                owner.append(np.full(len(flat[-1]), i))
            else:
                buckets.setdefault((len(piece) - 1).bit_length() + 1, []).append(i)
        whole = buckets.pop(0, [])
        flat.append(np.array([self.token_rank[pieces[i]] for i in whole], np.int64))
        owner.append(np.array(whole, np.int64))
        for bits, rows in buckets.items():
            step = max(1, (1 << 18) >> bits)
            for k in range(0, len(rows), step):
                for at, ids in self._merge_rows([pieces[i] for i in rows[k : k + step]]):
                    used = ids != _PAD
                    flat.append(ids[used])
                    owner.append(np.repeat(np.array(rows[k : k + step])[at], used.sum(axis=1)))
        ids, owners = np.concatenate(flat), np.concatenate(owner)
        return ids[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(pieces))

    def _merge_rows(self, pieces: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, padded ids) of the rows that are done, round by round."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(sizes.max())
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(len(pieces), width)
        rows = np.arange(len(pieces))
        ids = np.where(np.arange(width) < sizes[:, None], self.single[raw], _PAD)
        ranks = self.table.ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            line = np.arange(len(rows))
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[line, at] if ranks.shape[1] else np.full(len(rows), _NONE)
            done = best == _NONE
            if done.any():
                yield rows[done], ids[done]
                go = ~done
                rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
                line = np.arange(len(rows))
                if not len(rows):
                    return
            ids[line, at] = best
            keep = np.ones(ids.shape, bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            # The pair that begins at the merged cell takes the place of the one that began a cell on.
            ranks = ranks[keep[:, 1:]].reshape(len(rows), -1)
            after, before = np.flatnonzero(at < ranks.shape[1]), np.flatnonzero(at > 0)
            ranks[after, at[after]] = self.table.ranks(ids[after, at[after]], ids[after, at[after] + 1])
            ranks[before, at[before] - 1] = self.table.ranks(ids[before, at[before] - 1], ids[before, at[before]])

    def _merge_long(self, piece: bytes) -> list[int]:
        n, token = len(piece), self.token
        ids, nxt, prv = [int(self.single[b]) for b in piece], list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.token_rank.get
        heap = [(r, i) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        dead = bytearray(n)
        while heap:
            r, i = heapq.heappop(heap)
            if dead[i] or (j := nxt[i]) >= n or rank(token[ids[i]] + token[ids[j]]) != r:
                continue
            ids[i], dead[j], nxt[i] = r, 1, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for a, b in ((prv[i], i), (i, nxt[i])):
                if a >= 0 and b < n and (q := rank(token[ids[a]] + token[ids[b]])) is not None:
                    heapq.heappush(heap, (q, a))
        return [t for t, d in zip(ids, dead) if not d]

    def learn(self, pieces: Iterable[str]) -> None:
        """Put pieces in the cache. It is emptied first if it has grown past its bound."""
        if len(self.text_ids) > _CACHED:
            self.text_ids.clear(), self.decoded.clear()
        new = [p for p in pieces if p not in self.text_ids]
        if not new:
            return
        ids, counts = self.merge([p.encode() for p in new])
        words = [self.decimal[i] for i in ids.tolist()]
        stops = np.cumsum(counts)
        byte_stops = np.concatenate(([0], np.cumsum(self.token_size[ids])))[stops]
        back = self.decode(ids)
        low = low_byte = 0
        for piece, high, high_byte in zip(new, stops.tolist(), byte_stops.tolist()):
            self.text_ids[piece] = ",".join(words[low:high])
            self.decoded[piece] = back[low_byte:high_byte]
            low, low_byte = high, high_byte

    def matches(self, text: str) -> list[str]:
        """The pattern's matches. Latin text takes an equal, faster pattern if the pattern is the usual one."""
        return (_LATIN if self.usual and _LATIN_TEXT.fullmatch(text) else self.split).findall(text)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pattern's matches, some at a time for a long text."""
        if len(text) <= _BLOCK:
            yield self.matches(text)
            return
        held: list[str] = []
        for match in self.split.finditer(text):
            held.append(match[0])
            if len(held) == 200_000:
                yield held
                held = []
        yield held

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for block in self.pieces(text):
            if block:
                ids, counts = self.merge([p.encode() for p in block])
                out += ids.tolist()
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Per text: number of tokens, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded bytes."""
        at = 0
        while at < len(texts):
            end, total = at, 0
            while end < len(texts) and (end == at or total + len(texts[end]) <= _BLOCK):
                total += len(texts[end])
                end += 1
            if total > _BLOCK:
                yield self._long_digest(texts[at])
            else:
                blocks = [self.matches(t) for t in texts[at:end]]
                self.learn(set().union(*blocks))
                for block in blocks:
                    ids = ",".join(map(self.text_ids.__getitem__, block))
                    back = b"".join(map(self.decoded.__getitem__, block))
                    yield ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()
            at = end

    def _long_digest(self, text: str) -> tuple[int, str, str]:
        ids, back, n = hashlib.sha256(), hashlib.sha256(), 0
        for block in self.pieces(text):
            self.learn({*block})
            part = ",".join(map(self.text_ids.__getitem__, block))
            if part:
                ids.update(("," * bool(n) + part).encode())
                back.update(b"".join(map(self.decoded.__getitem__, block)))
                n += part.count(",") + 1
        return n, ids.hexdigest(), back.hexdigest()


@lru_cache(1)
def coder(path: str, pattern: str) -> ByteBpe:
    """One coder per Python worker."""
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: token ids of each text. Null texts are empty and have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, bytes binary: what the ids stand for. Null ids give no bytes; an id without token is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            back = [bpe.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per row of docs, from encoding and decoding the whole text.

    Null texts are empty: 0 tokens and the hash of nothing. Repeated rows give repeated results, other
    columns are not read, an empty table gives no rows. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            found = list(zip(*bpe.digests([t or "" for t in batch.column(1).to_pylist()]))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[0], pa.int64()), pa.array(found[1], pa.string()), pa.array(found[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
