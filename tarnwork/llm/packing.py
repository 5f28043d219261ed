"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Documents are dealt by a hash of their id to blocks of bounded size, each packed by itself; texts take no part. Ids that more
than BUSY rows share, and missing ids, are dealt row by row, so that no block holds them all. Within a block
they come longest first (ties by id, missing ids first, then by cluster). Bins stand in order of what they have left; each carries a bitmap of its
sources and one of its duplicate clusters. The search starts at the successor of the document's length and goes on until the
tightest bin that has neither the document's source nor its cluster is found; else a new bin opens. Longer documents are cut
into pieces: full ones take a bin each, the rest is packed like a document. Nothing is dropped.

A null source counts as one source of its own, a null cluster conflicts with nothing. Documents of length 0 (also null or
negative) take no room: bin_id null, piece 0. Repeated rows are packed once for each row; as they share source and cluster,
they never share a bin. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import written
from tarnwork.llm.minhash import near_duplicates

CAPACITY, BLOCK = 2048, 20_000
#: Rows of one id from which on they are dealt to blocks one by one.
BUSY = 100


class Bins:
    """Open bins of one block, ordered by what they have left."""

    def __init__(self, capacity: int, n_sources: int, n_clusters: int):
        self.capacity, self.n = capacity, 0
        self.left, self.order = np.empty(1024, np.int64), np.empty(1024, np.int64)  # in order of `left`
        self.source = np.zeros((n_sources // 64 + 1, 1024), np.uint64)
        self.cluster = np.zeros((n_clusters // 64 + 1, 1024), np.uint64)

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset); cluster -1 conflicts with nothing."""
        source_word, source_bit = source >> 6, np.uint64(1 << (source & 63))
        cluster_word, cluster_bit = (cluster >> 6, np.uint64(1 << (cluster & 63))) if cluster >= 0 else (0, np.uint64(0))
        at, step = int(np.searchsorted(self.left[: self.n], size)), 32
        while at < self.n:  # successors, in ever larger steps
            bins = self.order[at : min(at + step, self.n)]
            free = ((self.source[source_word, bins] & source_bit) | (self.cluster[cluster_word, bins] & cluster_bit)) == 0
            first = int(free.argmax())
            if free[first]:
                at += first
                break
            at, step = at + len(bins), step * 4
        if at >= self.n:
            at = self._open()
        left, chosen = int(self.left[at]), int(self.order[at])
        self.source[source_word, chosen] |= source_bit
        self.cluster[cluster_word, chosen] |= cluster_bit
        to = int(np.searchsorted(self.left[:at], left - size, "right"))
        self.left[to + 1 : at + 1], self.order[to + 1 : at + 1] = self.left[to:at].copy(), self.order[to:at].copy()
        self.left[to], self.order[to] = left - size, chosen
        return chosen, self.capacity - left

    def _open(self) -> int:
        if self.n == len(self.left):
            self.left, self.order = (np.concatenate([x, np.empty_like(x)]) for x in (self.left, self.order))
            self.source, self.cluster = (np.concatenate([x, np.zeros_like(x)], axis=1) for x in (self.source, self.cluster))
        self.left[self.n], self.order[self.n] = self.capacity, self.n
        self.n += 1
        return self.n - 1


def pack_block(ids: list, sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple]:
    """(row, piece, size, bin, offset) for each piece; bin None for rows without size."""
    known = {s: i for i, s in enumerate(dict.fromkeys(sources))}
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    shared = {c: i for i, c in enumerate(c for c, n in seen.items() if n > 1 and c is not None)}  # the others can't conflict
    bins, out, todo = Bins(capacity, len(known), len(shared)), [], []
    for i, n in enumerate(sizes):
        full, rest = divmod(n, capacity) if n > 0 else (0, 0)
        if n <= 0:
            out.append((i, 0, 0, None, 0))
        for piece in range(full):
            todo.append((capacity, i, piece))
        if rest:
            todo.append((rest, i, full))
    todo.sort(key=lambda x: (-x[0], ids[x[1]] is not None, ids[x[1]] or 0, str(clusters[x[1]]), x[2], x[1]))
    for n, i, piece in todo:
        out.append((i, piece, n, *bins.place(n, known[sources[i]], shared.get(clusters[i], -1))))
    return out


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def best_fit(docs: DataFrame, size: Column, cluster: Column, capacity: int = CAPACITY, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(id, piece int, n_words long, bin_id long, at long) for each piece of each row; integer ids. bin_id has the block in its upper bits."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        size.cast("long").alias("size"),
        F.xxhash64(F.coalesce(F.col(source_col).cast("string"), F.lit("\0none"))).alias("source"),
        cluster.cast("long").alias("cluster"),
    )
    rows = written(rows, "sizes")
    blocks = max(1, -(-rows.count() // BLOCK))
    rows = _dealt(rows, blocks)

    def run(table: pa.Table) -> pa.Table:
        ids, sizes, sources, clusters = (table.column(c).to_pylist() for c in ("id", "size", "source", "cluster"))
        block = table.column("block")[0].as_py()
        made = pack_block(ids, [n or 0 for n in sizes], sources, clusters, capacity)
        return pa.table(
            {
                "id": pa.array([ids[r[0]] for r in made], pa.int64()),
                "piece": pa.array([r[1] for r in made], pa.int32()),
                "n_words": pa.array([r[2] for r in made], pa.int64()),
                "bin_id": pa.array([None if r[3] is None else (block << 32) + r[3] for r in made], pa.int64()),
                "at": pa.array([r[4] for r in made], pa.int64()),
            }
        )

    packed = rows.groupBy("block").applyInArrow(run, "id long, piece int, n_words long, bin_id long, at long")
    return packed.withColumnRenamed("id", id_col)


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """rows (a written table) with their block: a hash of the id, and, for ids that many rows share or that are missing, of their place in the table."""
    busy = rows.groupBy(F.col("id").alias("busy")).agg(F.count("*").alias("n")).where(F.col("n") > BUSY) if blocks > 1 else None
    if busy is None or not busy.limit(1).count():
        return rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    placed = rows.withColumn("place", F.monotonically_increasing_id()).join(busy, F.col("id").eqNullSafe(F.col("busy")), "left")
    key = F.xxhash64("id", F.when(F.col("n").isNotNull(), F.col("place")))
    return placed.select("id", "size", "source", "cluster", F.pmod(key, F.lit(blocks)).alias("block"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """best_fit() of documents by their words; equal texts are a duplicate cluster."""
    return best_fit(docs, word_count(F.col("text")), F.xxhash64("text"), capacity)


def pack_apart(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pack_documents(), but a duplicate cluster is a component of near copies, equal texts included. A row without an id goes by its text.

    Words are counted where shingles are made, so texts are not read again for them.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    rows = near_duplicates(docs.select(key.alias("key"), "text", "doc_id", "source"), "key", carry=("doc_id", "source"))
    return best_fit(rows, F.col("n_words"), F.col("component_id"), capacity)
