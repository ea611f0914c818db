"""Byte-level BPE with numpy: distinct pieces of a batch, bucketed by length, merged as padded matrices.

Every row merges its leftmost pair of least rank each round; pairs are looked up in an open-addressing hash table;
rows without a pair to merge are taken out and the matrix is made smaller.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_text, map_arrow

NONE = np.int32(np.iinfo(np.int32).max)
#: Pieces of more bytes are merged one by one with a heap: the matrix takes a round a merge, each over the row's whole width.
LONG = 256
#: Distinct pieces whose ids a worker keeps between batches.
KEPT = 400_000
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PairTable:
    """(left id, right id) to the id of their merger, as an open-addressing table probed for many pairs at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(2 * len(left)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, NONE, dtype=np.int32)
        keys = left.astype(np.int64) << 32 | right
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] < 0
            slots, first = np.unique(at[todo][free], return_index=True)
            won = todo[free][first]
            self.keys[slots], self.values[slots] = keys[won], merged[won]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = at[todo] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merger's id for each pair, NONE where there is none; ids below zero never pair."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(keys.shape, NONE, dtype=np.int32)
        flat, at = out.reshape(-1), self._slot(keys).reshape(-1)
        keys = keys.reshape(-1)
        todo = np.flatnonzero((left.reshape(-1) >= 0) & (right.reshape(-1) >= 0))
        while len(todo):
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            flat[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
            at[todo] = at[todo] + 1 & self.mask
        return out


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.byte_ids = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int32)
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        splits = [(ranks[b[:i]], ranks[b[i:]], rank) for b, rank in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
        self.pairs = PairTable(*np.array(splits, dtype=np.int64).reshape(-1, 3).T)
        self.known: dict[str, tuple[int, ...]] = {}

    def merge_rows(self, rows: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of rows of bytes, all at once in one padded matrix."""
        out: list[tuple[int, ...]] = [()] * len(rows)
        sizes = np.array([len(r) for r in rows])
        width = int(sizes.max())
        ids = np.full((len(rows), width), -1, dtype=np.int32)
        filled = np.arange(width) < sizes[:, None]
        ids[filled] = self.byte_ids[np.frombuffer(b"".join(rows), dtype=np.uint8)]
        which = np.arange(len(rows))
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:]) if width > 1 else np.zeros((len(rows), 0), np.int32)
        while True:
            if ranks.shape[1]:
                at = ranks.argmin(1)
                least = ranks[np.arange(len(which)), at]
            else:
                at, least = np.zeros(len(which), np.int64), np.full(len(which), NONE)
            done = least == NONE
            for i, row, n in zip(which[done].tolist(), ids[done].tolist(), sizes[done].tolist()):
                out[i] = tuple(row[:n])
            if done.all():
                return out
            go = ~done
            which, sizes, at, least = which[go], sizes[go] - 1, at[go], least[go]
            ids, ranks = ids[go], ranks[go]
            width = int(sizes.max())
            after = np.arange(width) > at[:, None]
            padded = ids[:, : width + 1]
            ids = np.where(after, padded[:, 1 : width + 1], padded[:, :width])
            ids[np.arange(width) >= sizes[:, None]] = -1
            line = np.arange(len(which))
            ids[line, at] = least
            if width == 1:
                ranks = np.zeros((len(which), 0), np.int32)
                continue
            wider = np.concatenate([ranks, np.full((len(ranks), 1), NONE, np.int32)], 1) if ranks.shape[1] < width else ranks
            ranks = np.where(after[:, : width - 1], wider[:, 1:width], wider[:, : width - 1])
            right = at < sizes - 1
            ranks[line[right], at[right]] = self.pairs.find(ids[line[right], at[right]], ids[line[right], at[right] + 1])
            ended = ~right & (at < width - 1)
            ranks[line[ended], at[ended]] = NONE
            left = at > 0
            ranks[line[left], at[left] - 1] = self.pairs.find(ids[line[left], at[left] - 1], ids[line[left], at[left]])

    def merge_long(self, row: bytes) -> tuple[int, ...]:
        """The same merges for one long row, with a heap of (rank, position)."""
        n = len(row)
        ids = self.byte_ids[np.frombuffer(row, dtype=np.uint8)]
        heap = [(r, i) for i, r in enumerate(self.pairs.find(ids[:-1], ids[1:]).tolist()) if r != NONE]
        heapq.heapify(heap)
        ids = ids.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, parts = self.ranks, self.bytes_of
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or ranks.get(parts[ids[i]] + parts[ids[j]]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(parts[rank] + parts[ids[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i))
            if (k := before[i]) >= 0 and (r := ranks.get(parts[ids[k]] + parts[rank])) is not None:
                heapq.heappush(heap, (r, k))
        return tuple(x for x in ids if x >= 0)

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of pieces that aren't known yet into known."""
        if len(self.known) > KEPT:
            self.known.clear()
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces - self.known.keys():
            raw = piece.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.known[piece] = (rank,)
            elif len(raw) > LONG:
                self.known[piece] = self.merge_long(raw)
            else:
                buckets.setdefault((len(raw) + 3) // 4, []).append((piece, raw))
        for own in buckets.values():
            for at in range(0, len(own), 8192):
                part = own[at : at + 8192]
                self.known.update(zip((p for p, _ in part), self.merge_rows([raw for _, raw in part])))

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.pattern.findall(t) for t in texts]
        pieces = set(chain.from_iterable(split))
        if len(self.known) > KEPT:
            self.known.clear()
        self.learn(pieces)
        known = self.known
        return [list(chain.from_iterable(map(known.__getitem__, s))) for s in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Bpe:
    with open(path, "rb") as lines:
        return Bpe({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)


def encode_table(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int): the whole text's tokens. Null text gives no tokens; other columns are ignored."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = load(path, pattern).encode([t or "" for t in batch.column("text").to_pylist()])
        return pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def decode_table(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes: what ids stand for; null ids give null. An id outside the vocabulary is an error."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path, pattern)
        raw = [None if ids is None else bpe.decode(ids) for ids in batch.column("ids").to_pylist()]
        return pa.record_batch([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text and decodes the ids; one row per row of docs (see ENCODED).

    Null counts as empty: no tokens and the hash of nothing. Repeated rows come back as often; an empty table gives an
    empty result; other columns are ignored. The ids themselves stay in the worker: only digests leave it.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path, pattern)
        counts, ids_sha, raw_sha = [], [], []
        for ids in bpe.encode([t or "" for t in batch.column("text").to_pylist()]):
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            raw_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(id_text(docs, id_col, text_col), run, ENCODED)
