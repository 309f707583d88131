"""Encoding of texts with a public byte-level BPE vocabulary.

Two-tier lookup: whole pre-tokens that are vocabulary entries are resolved by a
minimal perfect hash over the vocabulary; the rest is merged with a heap of
candidate pairs over a doubly linked list of bytes.  A bounded memo in front of
both tiers keeps the ids of pre-tokens already met by a worker.

The vocabulary file is found by path (a parameter) on every worker; nothing of
it is stored in this repository.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..session import require, spread

#: Folder of the vocabulary files; each worker reads its own copy.
TOKENIZER_DIR = os.environ.get("SCRIPTORIA_TOKENIZERS", "/opt/tokenizers")

# Pre-token pattern of the public byte-level vocabulary.
PRE_TOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens kept in a worker's memo before it is emptied; only speed depends on it.
MEMO_LIMIT = 400_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def load_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary of a rank file: one base64 token and its id per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of byte strings: a cascade of bit levels.

    At each level the keys still unplaced are hashed into a bit array of the
    same size; a key alone on its bit stays, the others go to the next level.
    The number of set bits before a key's bit is its slot, so n keys fill the
    slots 0..n-1.  A slot holds its key, so a lookup of a stranger answers ``None``.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        self.levels: list[np.ndarray] = []  # of each level, the slot of every bit or -1
        self.keys: list[bytes | None] = [None] * len(keys)
        self.values = [0] * len(keys)
        left, h, used = np.arange(len(keys)), self._hashes(keys), 0
        while len(left):
            at = self._bit(h[left], len(self.levels), len(left))
            alone = np.bincount(at, minlength=len(left))[at] == 1
            slots = np.full(len(left), -1, dtype=np.int64)
            bits = np.sort(at[alone])
            slots[bits] = used + np.arange(len(bits))
            for k, s in zip(left[alone].tolist(), slots[at[alone]].tolist()):
                self.keys[s], self.values[s] = keys[k], values[k]
            self.levels.append(slots)
            used += len(bits)
            left = left[~alone]

    @staticmethod
    def _hashes(keys: list[bytes]) -> np.ndarray:
        import xxhash

        return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))

    @staticmethod
    def _bit(h: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (_mix(h + np.uint64(level + 1) * _GOLD) % np.uint64(size)).astype(np.int64)

    def lookup(self, keys: list[bytes]) -> list[int | None]:
        """Value of each key, None for strangers; each level is one vector operation."""
        h = self._hashes(keys)
        slots = np.full(len(keys), -1, dtype=np.int64)
        for level, own in enumerate(self.levels):
            if len(open_ := np.flatnonzero(slots < 0)):
                slots[open_] = own[self._bit(h[open_], level, len(own))]
        own, values = self.keys, self.values
        return [values[s] if s >= 0 and own[s] == k else None for s, k in zip(slots.tolist(), keys)]


class ByteBPE:
    """Encoder over one vocabulary; ids equal those of repeated lowest-rank merging."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.table = PerfectHash(list(self.ranks), list(self.ranks.values()))
        self.pattern = regex.compile(PRE_TOKEN)
        self.memo: dict[str, tuple[int, ...]] = {}

    def merge(self, token: bytes) -> tuple[int, ...]:
        """Ids of a pre-token outside the vocabulary: heap of pairs over linked bytes."""
        ranks, n = self.ranks, len(token)
        parts: list[bytes | None] = [token[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, p) for i in range(n - 1) if (r := ranks.get(p := token[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i] if parts[i] is not None else n
            if j >= n or len(parts[i]) + len(parts[j]) != len(pair) or parts[i] + parts[j] != pair:
                continue
            parts[i], parts[j] = pair, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := ranks.get(p := pair + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, p))
            if (b := left[i]) >= 0:
                if (r := ranks.get(p := parts[b] + pair)) is not None:
                    heapq.heappush(heap, (r, b, p))
        return tuple(ranks[p] for p in parts if p is not None)

    def learn(self, tokens: list[str]) -> None:
        """Put unseen pre-tokens into the memo, first by the perfect hash, then by merging."""
        raw = [t.encode("utf-8") for t in tokens]
        for t, b, found in zip(tokens, raw, self.table.lookup(raw)):
            self.memo[t] = (found,) if found is not None else self.merge(b)

    def encode_many(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; an empty list for empty and null texts."""
        memo, find, out = self.memo, self.pattern.findall, []
        if len(memo) > MEMO_LIMIT:
            memo.clear()
        for text in texts:
            tokens = find(text) if text else []
            fresh = [t for t in set(tokens) if t not in memo]
            if fresh:
                self.learn(fresh)
            ids: list[int] = []
            for t in tokens:
                ids += memo[t]
            out.append(ids)
        return out


_ENCODERS: dict[str, ByteBPE] = {}


def encoder(path: str) -> ByteBPE:
    """One encoder per Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBPE(path)
    return _ENCODERS[path]


def encode_corpus(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every row: columns ``id_col`` and ``ids`` (array of int).

    Null and empty texts get an empty list; a blank text is encoded as it stands;
    strings of special tokens are ordinary text.  A null id stays null, repeated
    rows stay repeated, an empty table gives an empty result.  Texts are encoded
    whole.  One pass over the two columns, without a shuffle unless the table comes in fewer parts than there are cores.
    """
    path = os.path.join(folder, f"{vocabulary}.tiktoken")
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # bounds what Python holds at once
                part = batch.slice(start, 256)
                lists = enc.encode_many(part.column(1).to_pylist())
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])

    return spread(require(documents, id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
