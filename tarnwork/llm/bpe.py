"""Byte-level BPE on length-bucketed padded matrices.

Texts are cut by the tokenizer's pattern. Each distinct piece becomes a row of byte tokens in a padded numpy matrix of its
length bucket; a round looks every neighbouring pair up in an open-addressing hash table, merges the leftmost pair of minimum
rank of each row, and closes the gap. Rows without a mergeable pair leave the matrix. Pieces are remembered by the worker,
within a bound, so frequent ones are merged once.

Null text counts as empty and gives no ids. Repeated rows give repeated results, rows without an id are encoded like others, an
empty table gives an empty one, and other columns, whatever their names, are not read. Texts are never cut: their length only
decides how many share a step. Ids that the vocabulary does not have make decoding fail.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tarnwork.llm.common import STEP_CHARS, id_text, per_text, pieces

#: Upper bounds of the length buckets in bytes. Longer pieces (rare) go through the same merges in a heap, one at a time.
BUCKETS = (4, 8, 12, 16, 24, 32, 64, 128, 256, 512)
NONE = np.int32(2**31 - 1)
#: Pieces that a worker remembers before it starts afresh.
REMEMBERED = 300_000


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start[0] : start[0] + size[0]], flat[start[1] : ...], ... one after the other."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class PairTable:
    """Open addressing: (left, right) -> rank of the merged token."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * max(1, len(pairs)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        keys = np.fromiter(((a << 32) | b for a, b in pairs), np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._slot(keys)
        while len(keys):  # in each turn one key per free slot moves in, the rest tries the next slot
            free = self.keys[at] == -1
            _, first = np.unique(at, return_index=True)
            won = np.zeros(len(keys), bool)
            won[first] = True
            won &= free
            self.keys[at[won]], self.ranks[at[won]] = keys[won], ranks[won]
            keys, ranks, at = keys[~won], ranks[~won], (at[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE where a pair does not merge; negative tokens are padding."""
        keys = (left.astype(np.int64) << 32) | right
        out = np.full(keys.shape, NONE, np.int32)
        flat, keys = out.reshape(-1), keys.reshape(-1)
        todo = np.flatnonzero((left.reshape(-1) >= 0) & (right.reshape(-1) >= 0))
        at = self._slot(keys[todo])
        while len(todo):
            there = self.keys[at]
            hit = there == keys[todo]
            flat[todo[hit]] = self.ranks[at[hit]]
            more = ~hit & (there != -1)
            todo, at = todo[more], (at[more] + 1) & (len(self.keys) - 1)
        return out


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path if path.startswith("/") else SparkFiles.get(path), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Numbered(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Vocabulary:
    """Ranks of a .tiktoken file and the pattern that cuts texts."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.rank = ranks_of(path)
        self.find = regex.compile(pattern).findall
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for t, r in self.rank.items():
            for k in range(1, len(t)):
                a, b = self.rank.get(t[:k]), self.rank.get(t[k:])
                if a is not None and b is not None:
                    pairs[a, b] = r
        self.pairs, self.pair_rank = PairTable(pairs), pairs
        self.forget()

    def forget(self) -> None:
        self.known = Numbered()
        self.flat, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, ids per piece)."""
        size = np.array([len(p) for p in pieces], np.int64)
        whole = np.array([self.rank.get(p, -1) for p in pieces], np.int64)
        parts = [(np.flatnonzero(whole >= 0), whole[whole >= 0].astype(np.int32), np.ones((whole >= 0).sum(), np.int64))]
        for i in np.flatnonzero((whole < 0) & (size > BUCKETS[-1])):
            ids = self._heap(pieces[i])
            parts.append((np.array([i]), ids, np.array([len(ids)])))
        least = 0
        for width in BUCKETS:
            own = np.flatnonzero((whole < 0) & (size > least) & (size <= width))
            least = width
            for at in range(0, len(own), step := 1_000_000 // width):
                parts += self._matrix(pieces, own[at : at + step], size, width)
        own, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
        order = np.argsort(own)
        return ragged(np.concatenate([p[1] for p in parts]), (np.cumsum(n) - n)[order], n[order]), n[order]

    def _matrix(self, pieces: list[bytes], own: np.ndarray, size: np.ndarray, width: int) -> list[tuple]:
        done, m = [], np.full((len(own), width), -1, np.int32)
        m[np.arange(width) < size[own, None]] = self.byte[np.frombuffer(b"".join([pieces[i] for i in own]), np.uint8)]
        while len(m):
            ranks = self.pairs.get(m[:, :-1], m[:, 1:]) if m.shape[1] > 1 else np.full((len(m), 1), NONE)
            at = ranks.argmin(axis=1)  # the leftmost of the least
            best = ranks[np.arange(len(m)), at]
            over = best == NONE
            if over.any():
                done.append((own[over], m[over][m[over] >= 0], (m[over] >= 0).sum(axis=1)))
                m, own, at, best = m[~over], own[~over], at[~over], best[~over]
            if len(m):
                m[np.arange(len(m)), at] = best
                column = np.arange(m.shape[1] - 1)
                m = np.take_along_axis(m, column + (column >= at[:, None] + 1), axis=1)
        return done

    def _heap(self, piece: bytes) -> np.ndarray:
        """The same order of merges, by a heap of (rank, place) over a linked list."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank, n = self.pair_rank.get, len(ids)
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (s := rank((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.forget()
        before, found = len(self.known), [self.find(t) for t in texts]
        counts = [len(x) for x in found]
        at = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(found)), np.int64, sum(counts))
        new = [p.encode("utf-8", "replace") for p in itertools.islice(self.known, before, None)]
        if new:
            ids, size = self.merged(new)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, ids])
        size = self.size[at]
        ids = ragged(self.flat, self.start[at], size)
        cut = np.concatenate([[0], np.cumsum(size)])[np.cumsum(counts)[:-1]] if counts else []
        return np.split(ids, cut) if texts else []


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


@functools.lru_cache(maxsize=2)
def tokens_of(path: str) -> dict[int, bytes]:
    return {r: t for t, r in ranks_of(path).items()}


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids binary): ids as little-endian unsigned 32-bit integers. path: a file that every executor has, or the name of one given to addFile()."""

    def run(texts: list[str]) -> list[list]:
        ids = vocabulary(path, pattern).encode(texts)
        return [[len(x) for x in ids], [x.astype("<u4").tobytes() for x in ids]]

    kind = docs.schema[id_col].dataType.simpleString()
    out = id_text(docs, id_col, text_col).mapInArrow(per_text(run, [pa.int64(), pa.binary()]), f"id {kind}, n_tokens long, ids binary")
    return out.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """tokens with a column decoded (binary), from ids as encode() gives them; null ids give empty bytes."""
    schema = StructType([*tokens.schema.fields, StructField("decoded", BinaryType())])

    def run(batches):
        token = tokens_of(path)
        for batch in batches:
            for at, n in pieces(batch.column(ids_col), 4 * STEP_CHARS):
                part = batch.slice(at, n)
                got = [b"".join(map(token.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], [*part.schema.names, "decoded"])

    return tokens.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Of each document: the number of ids, SHA-256 of the ids and of the bytes decoded from them."""
    both = decode(encode(docs, path, pattern), path, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
