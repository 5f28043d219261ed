"""Embedding near duplicates: dual traversal of cover trees.

Equal vectors become one with a weight. The others are split into cells, round by round, until a cell fits a block: each cell that
is too large gets centres from a sample of its own (a few vectors for each block; exactness does not depend on them), and its
vectors go to the nearest. The cells form the upper tree, every node with its centre and the true radius of what lies below it; it
is a small table, and the dual descent begins there: a pair of nodes is dropped when their distance less both radii exceeds
the threshold's distance, and is settled as a whole when their distance and both radii stay under it. Only the pairs of blocks
that are left are compared. Each block has a cover tree: nested nets with halving radii, again with true radii. Blocks travel in
tiles of neighbours, so that a tree is sent once for all partners in a tile. Trees are descended both at once, by matrix products
over the nodes that are still alive, or pair by pair once few are; what reaches the leaves is decided in double precision.

A pair of blocks returns how many links each vector has there and one edge from each linked vector to the smallest id it
reaches, so output grows with vectors and not with pairs of a group. Counts are summed and edges joined by union-find.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different length do
not either. Components may be as large or small as doubles go. Rows with the same id count as one vector (the smallest in order
of components); rows without an id link with nothing and are kept. An empty table gives an empty one; other columns, whatever
their names, are not read. Where vectors have no structure (random ones of many dimensions), no pair of blocks can be dropped.
"""

from __future__ import annotations

import functools
import io
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import discard, settings, written
from tarnwork.llm.graph import components

THRESHOLD = 0.9
#: Vectors in a block (of up to WIDE components, else fewer) and in a tile of blocks.
BLOCK, TILE, WIDE = 3000, 12_000, 256
#: Centres of a split at most, sampled vectors for each of them, and rounds of splits. A cell that is still too large is dealt to blocks by a hash.
MAX_PIVOTS, SAMPLED, ROUNDS = 64, 8, 8
RADII = (2.0, 1.0, 0.5, 0.25, 0.125, 0.0625)
#: A net of more than one in so many vectors is left out: its pairs cost as much as those of the vectors and drop next to none.
DENSE = 4
#: Under this share of live pairs among live rows and columns, pairs are taken one by one.
SPARSE = 0.02


def doubt(d: int) -> float:
    """Cosines of d components in single precision are off by less; those so near the threshold are computed again in double precision."""
    return (d + 8) * 2.0**-23


def slack(d: int) -> float:
    """What three distances from cosines in single precision are off by at most."""
    return 3 * float(np.sqrt(2 * doubt(d)))


@dataclass
class Tree:
    ids: np.ndarray  # in net order: the first n[i] are the net of level i; the last level has all
    x: np.ndarray  # as given
    weight: np.ndarray  # vectors that each stands for
    unit: np.ndarray  # single precision, length 1
    n: list[int]
    parent: list[np.ndarray]  # of each level's nodes, in the level above
    radius: list[np.ndarray]

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, x=self.x, weight=self.weight, n=np.array(self.n), parent=np.concatenate(self.parent), radius=np.concatenate(self.radius))
        return out.getvalue()

    @staticmethod
    def unpack(data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as z:
            n, cut = z["n"].tolist(), np.cumsum(z["n"])[:-1]
            return Tree(z["ids"], z["x"], z["weight"], unit(z["x"]), n, np.split(z["parent"], cut), np.split(z["radius"], cut))


def cut(t: Tree, levels: int) -> Tree:
    """t with its first nets only, and all vectors below the last of these."""
    if levels == len(t.n):
        return t
    up = np.arange(t.n[-1])
    for level in range(len(t.n) - 1, levels - 2, -1):
        up = t.parent[level][up]
    return replace(t, n=[*t.n[: levels - 1], t.n[-1]], parent=[*t.parent[: levels - 1], up], radius=[*t.radius[: levels - 1], t.radius[-1]])


def scaled(x: np.ndarray) -> np.ndarray:
    """In double precision, the largest component 1, so that no square over- or underflows."""
    y = x.astype(np.float64)
    return y / np.abs(y).max(axis=1, keepdims=True)


def unit(x: np.ndarray) -> np.ndarray:
    y = scaled(x)
    return (y / np.sqrt((y * y).sum(axis=1, keepdims=True))).astype(np.float32)


def distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosines))


def build(ids: np.ndarray, x: np.ndarray, weight: np.ndarray | None = None) -> Tree:
    weight = np.ones(len(ids), np.int64) if weight is None else weight
    u = unit(x)
    d = distance(u @ u.T)
    near, order, n = np.full(len(ids), np.inf, np.float32), [], []
    for r in RADII:
        while True:
            far = np.flatnonzero(near > r)
            if not len(far):
                break
            for p in far:  # each that no earlier one of this turn has covered
                if near[p] > r:
                    order.append(p)
                    np.minimum(near, d[p], out=near)
        if len(order) > len(ids) / DENSE:
            break
        n.append(len(order))
    inside = np.zeros(len(ids), bool)
    inside[order] = True
    order = np.concatenate([np.array(order, np.int64), np.flatnonzero(~inside)])
    n.append(len(ids))
    d = d[order][:, order]
    parent = [np.zeros(n[0], np.int64)]
    for above, here in zip(n, n[1:]):
        parent.append(np.concatenate([np.arange(above), d[above:here, :above].argmin(axis=1)]))
    radius, up = [np.zeros(n[-1], np.float32)], np.arange(n[-1])
    for level in range(len(n) - 2, -1, -1):
        up = parent[level + 1][up]
        r = np.zeros(n[level], np.float32)
        np.maximum.at(r, up, d[np.arange(n[-1]), up])
        radius.insert(0, r)
    return Tree(ids[order], x[order], weight[order], u[order], n, parent, radius)


def _expand(i: np.ndarray, j: np.ndarray, a: Tree, b: Tree, level: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of node pairs."""
    kids = []
    for t in (a, b):
        order = np.argsort(t.parent[level], kind="stable")
        count = np.bincount(t.parent[level], minlength=t.n[level - 1])
        kids.append((order, np.cumsum(count) - count, count))
    (ka, sa, ca), (kb, sb, cb) = kids
    size = ca[i] * cb[j]
    ends = np.cumsum(size)
    k = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
    w = np.repeat(cb[j], size)
    return ka[np.repeat(sa[i], size) + k // w], kb[np.repeat(sb[j], size) + k % w]


def _pairwise(a: Tree, b: Tree, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", a.unit[i[k : k + 50_000]], b.unit[j[k : k + 50_000]]) for k in range(0, len(i), 50_000)] or [np.empty(0, np.float32)])


def linked(a: Tree, b: Tree, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the pairs with cosine >= threshold in double precision, by dual traversal."""
    levels = min(len(a.n), len(b.n))
    a, b = cut(a, levels), cut(b, levels)
    near, reach = doubt(a.x.shape[1]), float(np.sqrt(2 - 2 * threshold)) + slack(a.x.shape[1])
    i = j = None
    alive = np.ones((a.n[0], b.n[0]), bool)
    last = len(a.n) - 1
    for level in range(last + 1):
        if level and alive is not None:
            alive = alive[a.parent[level]][:, b.parent[level]]
        elif level:
            i, j = _expand(i, j, a, b, level)
        if alive is not None:
            rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            if not len(rows):
                return np.empty(0, np.int64), np.empty(0, np.int64)
            sub = alive[np.ix_(rows, cols)]
            if level < last or sub.mean() >= SPARSE:
                cosines = a.unit[rows] @ b.unit[cols].T
                most = reach + a.radius[level][rows][:, None] + b.radius[level][cols]
                sub &= cosines >= 1 - np.minimum(most, 2) ** 2 / 2
            i, j = np.nonzero(sub)
            i, j = rows[i], cols[j]
            if level < last and len(i) > SPARSE * a.n[level] * b.n[level]:
                alive = np.zeros((a.n[level], b.n[level]), bool)
                alive[i, j] = True
            else:
                alive = None
        else:
            good = _pairwise(a, b, i, j) >= 1 - np.minimum(reach + a.radius[level][i] + b.radius[level][j], 2) ** 2 / 2
            i, j = i[good], j[good]
    cosines = _pairwise(a, b, i, j)
    sure, open_ = cosines > threshold + near, np.flatnonzero(np.abs(cosines - threshold) <= near)
    x, y = scaled(a.x[i[open_]]) if len(open_) else a.x[:0], scaled(b.x[j[open_]]) if len(open_) else b.x[:0]
    sure[open_] = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)) >= threshold
    return i[sure], j[sure]


def summary(a: Tree, b: Tree, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors that each is linked with in this pair of blocks, smallest id each reaches by them)."""
    i, j = linked(a, b, threshold)
    weight = a.weight if same else np.concatenate([a.weight, b.weight])
    if same:
        other = i != j
        i, j = i[other], j[other]  # both directions are there
    else:
        i, j = np.concatenate([i, j + len(a.ids)]), np.concatenate([j + len(a.ids), i])
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    own, first = np.unique(i, return_index=True)
    count = np.add.reduceat(weight[j], first) if len(own) else np.empty(0, np.int64)
    label = ids.copy()
    while len(own):
        new = np.minimum(label[own], np.minimum.reduceat(label[j], first))
        if (new == label[own]).all():
            break
        label[own] = new
    return ids[own], count, label[own]


class Cells:
    """The upper tree: nodes with centre, radius, size, weight and smallest id."""

    def __init__(self) -> None:
        self.up, self.down, self.d, self.centre, self.radius, self.size, self.weight, self.least = ([] for _ in range(8))

    def add(self, up: int, d: int, centre: np.ndarray | None) -> int:
        self.up.append(up)
        self.down.append([])
        self.d.append(d)
        self.centre.append(centre)
        for column, value in ((self.radius, 2.0), (self.size, 0), (self.weight, 0), (self.least, 0)):
            column.append(value)
        return len(self.up) - 1

    def seen(self, cell: int, size: int, weight: int, least: int, radius: float) -> None:
        self.size[cell], self.weight[cell], self.least[cell], self.radius[cell] = size, weight, least, radius
        if self.up[cell] >= 0:
            self.down[self.up[cell]].append(cell)

    def leaves(self) -> list[int]:
        """In order of the tree, so that neighbours stand together."""
        out, todo = [], [i for i in range(len(self.up) - 1, -1, -1) if self.up[i] < 0]
        while todo:
            i = todo.pop()
            if self.down[i]:
                todo += reversed(self.down[i])
            elif self.size[i]:
                out.append(i)
        return out

    def descend(self, threshold: float) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int, bool]], list[tuple[int, int]]]:
        """(pairs of leaves to compare, what is settled for leaves, links between smallest ids of settled nodes).

        Settled: {leaf: (weight that each of its vectors is linked with, the leaf's smallest id, whether that weight holds the leaf itself)}.
        """
        base, pairs, ties = float(np.sqrt(2 - 2 * threshold)), [], []
        weight, own, settled = [0] * len(self.up), [False] * len(self.up), [False] * len(self.up)
        todo = [(i, i) for i in range(len(self.up)) if self.up[i] < 0 and self.size[i]]
        while todo:
            after: list[tuple[int, int]] = []
            for a, b in todo:
                for x in self.down[a] or [a]:
                    near = [y for y in self.down[b] or [b] if a != b or x <= y]
                    if not near:
                        continue
                    off, gaps = slack(self.d[x]), np.zeros(len(near))
                    if self.centre[x] is not None:
                        gaps = distance(np.stack([self.centre[y] for y in near]) @ self.centre[x])
                    for y, gap in zip(near, gaps.tolist(), strict=True):
                        wide = self.radius[x] + self.radius[y]
                        if x != y and gap > wide + base + off:
                            continue
                        if gap + wide < base - off:
                            weight[x] += self.weight[y]
                            settled[x] = settled[y] = True
                            if x == y:
                                own[x] = True
                            else:
                                weight[y] += self.weight[x]
                                ties.append((self.least[x], self.least[y]))
                        elif self.down[x] or self.down[y]:
                            after.append((x, y))
                        else:
                            pairs.append((x, y))
            todo = after
        for i, kids in enumerate(self.down):  # a cell's number is larger than that of the cell above it
            for k in kids if settled[i] else ():
                weight[k], own[k], settled[k] = weight[k] + weight[i], own[k] or own[i], True
                ties.append((self.least[k], self.least[i]))
        return pairs, {i: (weight[i], self.least[i], own[i]) for i in self.leaves() if settled[i]}, ties


def block_size(d: int) -> int:
    return max(32, min(BLOCK, BLOCK * WIDE // d))


def centres(u: np.ndarray, k: int) -> np.ndarray:
    """k centres of length 1: vectors of the sample, moved twice to the middle of what is nearest to them."""
    c = u[np.linspace(0, len(u) - 1, min(k, len(u))).astype(int)]
    for _ in range(2):
        at = (u @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, at, u)
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(norm > 1e-6, total / np.maximum(norm, 1e-6), c).astype(np.float32)
    return c


SPLIT = "id long, w long, d int, cell int, far double, x binary"


def split(placed: DataFrame, cells: Cells, dtype: str) -> DataFrame:
    """Splits cells that are too large, round by round; the vectors with the cell they end in."""
    spark, still = placed.sparkSession, {i for i in range(len(cells.up)) if cells.size[i] > block_size(cells.d[i])}
    for _ in range(ROUNDS):
        if not still:
            break
        want = {c: min(MAX_PIVOTS, int(1.5 * cells.size[c] / block_size(cells.d[c])) + 2) for c in still}
        share = spark.createDataFrame([(c, int(min(1.0, 1.5 * SAMPLED * k / cells.size[c]) * (1 << 30))) for c, k in want.items()], "cell int, share long")
        drawn = placed.join(F.broadcast(share), "cell").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("share")).select("cell", "id", "x").collect()
        found: dict[int, list] = {}
        for r in sorted(drawn, key=lambda r: (r["cell"], r["id"])):
            found.setdefault(r["cell"], []).append(np.frombuffer(r["x"], dtype))
        own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for c, xs in found.items():
            middle = centres(unit(np.stack(xs)), want[c])
            own[c] = (np.array([cells.add(c, cells.d[c], m) for m in middle], np.int32), middle)

        def assign(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, far = batch.column(3).to_numpy().copy(), batch.column(4).to_numpy().copy()
                for c in np.unique(cell).tolist():
                    if c in own:
                        at = np.flatnonzero(cell == c)
                        x = unit(np.frombuffer(b"".join(batch.column(5).take(pa.array(at)).to_pylist()), dtype).reshape(len(at), -1))
                        gap = distance(x @ own[c][1].T)
                        best = gap.argmin(axis=1)
                        cell[at], far[at] = own[c][0][best], gap[np.arange(len(at)), best]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cell), pa.array(far), batch.column(5)], batch.schema.names)

        moved = written(placed.mapInArrow(assign, SPLIT), "cells")
        discard(placed)
        placed, fresh = moved, {int(i) for numbers, _ in own.values() for i in numbers}
        still = set()
        for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.min("id").alias("least"), F.max("far").alias("r")).collect():  # some rows for each block
            if r["cell"] in fresh:
                cells.seen(r["cell"], r["n"], r["w"], r["least"], r["r"])
                if r["n"] > block_size(cells.d[r["cell"]]) and r["n"] < cells.size[cells.up[r["cell"]]]:
                    still.add(r["cell"])
    return placed


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links long, component_id long, kept boolean) for each row; integer ids."""
    spark = vectors.sparkSession
    v, dtype = F.col("v"), "<f8" if "double" in vectors.schema[vector_col].dataType.simpleString() else "<f4"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = rows.where(fine & F.col("id").isNotNull())
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        good = good.groupBy("id").agg(F.min("v").alias("v"))
    keyed = written(good.select("id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(7), "v").alias("g")), "vectors")
    classes = written(keyed.groupBy("h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("w")), "classes")

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2)
            x, at = values.flatten().to_numpy(zero_copy_only=False).astype(dtype), np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy())])
            made = [x[p:q].tobytes() for p, q in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at), pa.int32()), pa.array(made, pa.binary())], ["id", "w", "d", "x"])

    heads = keyed.join(classes.select("rep", "w"), keyed["id"] == F.col("rep")).select("id", "w", "v")
    heads = heads.mapInArrow(flat, "id long, w long, d int, x binary")
    cells, root = Cells(), {}
    first = written(heads, "heads")
    for r in first.groupBy("d").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.min("id").alias("least")).orderBy("d").collect():  # a row for each length
        root[r["d"]] = cells.add(-1, r["d"], None)
        cells.seen(root[r["d"]], r["n"], r["w"], r["least"], 2.0)
    of = F.create_map(*[F.lit(x) for kv in root.items() for x in kv])[F.col("d")] if root else F.lit(0)
    placed = split(first.select("id", "w", "d", of.cast("int").alias("cell"), F.lit(2.0).alias("far"), "x"), cells, dtype)

    pairs, settled, ties = cells.descend(threshold)
    shape, tile_of, chunks, block, tile, held = [], [], {}, 0, 0, 0
    few = sum(cells.size[c] for c in cells.leaves()) // math.isqrt(8 * spark.sparkContext.defaultParallelism)
    tile_rows = max(BLOCK, min(TILE, few))  # small tables: so many tiles that all cores have pairs of them
    for c in cells.leaves():
        n = -(-cells.size[c] // block_size(cells.d[c]))
        chunks[c] = range(block, block + n)
        for _ in range(n):
            size = cells.size[c] // n * BLOCK // block_size(cells.d[c])
            if held and held + size > tile_rows:
                tile, held = tile + 1, 0
            tile_of.append(tile)
            held += size
        shape.append((c, block, n))
        block += n
    works: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x, y in pairs:
        for p in chunks[x]:
            for q in chunks[y]:
                if x != y or p <= q:
                    p_, q_ = min(p, q), max(p, q)
                    works.setdefault((tile_of[p_], tile_of[q_]), []).append((p_, q_))
    at = spark.createDataFrame(shape, "cell int, first long, n long")
    tiles = spark.createDataFrame(list(enumerate(tile_of)), "block long, tile long")
    dealt = placed.join(F.broadcast(at), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("n"))).join(F.broadcast(tiles), "block")

    def plant(table: pa.Table) -> pa.Table:
        own, ids, weight, x = (table.column(k).to_numpy() for k in ("block", "id", "w", "x"))
        trees = {}
        for b in np.unique(own).tolist():
            here = np.flatnonzero(own == b)
            trees[b] = build(ids[here], np.frombuffer(b"".join(x[here]), dtype).reshape(len(here), -1), weight[here]).pack()
        return pa.table({"tile": [table.column("tile")[0].as_py()], "block": pa.array([list(trees)], pa.list_(pa.int64())), "tree": pa.array([list(trees.values())], pa.list_(pa.binary()))})

    planted = dealt.select("tile", "block", "id", "w", "x").groupBy("tile").applyInArrow(plant, "tile long, block array<long>, tree array<binary>")
    planted = written(planted, "trees")
    todo = spark.createDataFrame([(s, t, [p for p, _ in w], [q for _, q in w]) for (s, t), w in works.items()], "s long, t long, p array<long>, q array<long>")
    a, b = (planted.select(F.col("tile").alias(x), F.struct("block", "tree").alias(f"{x}_")) for x in "st")
    both = todo.join(a, "s").join(b, "t").select("p", "q", "s_", F.when(F.col("s") != F.col("t"), F.col("t_")).alias("t_"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                packed: dict[int, bytes] = {}
                for side in (2, 3):
                    if (own := batch.column(side)[k].as_py()) is not None:
                        packed |= zip(own["block"], own["tree"], strict=True)
                open_ = functools.lru_cache(maxsize=None)(lambda i, packed=packed: Tree.unpack(packed[i]))
                for p, q in zip(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), strict=True):
                    if p in packed and q in packed:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in summary(open_(p), open_(q), p == q, threshold)], ["id", "n", "least"])

    with settings(spark, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "2m"}):  # a pair of tiles is much work for its bytes
        found = written(both.mapInArrow(compare, "id long, n long, least long"), "found")
    known = spark.createDataFrame([(c, *x) for c, x in settled.items()], "cell int, more long, reach long, own boolean")
    inside = placed.select("id", "w", "cell").join(F.broadcast(known), "cell", "left")
    inside = written(inside.select("id", "w", "reach", (F.coalesce("more", F.lit(0)) - F.when(F.col("own"), F.col("w")).otherwise(0)).alias("more")), "inside")
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    total = inside.join(links, "id", "left").select(F.col("id").alias("rep"), (F.col("w") - 1 + F.col("more") + F.coalesce("n", F.lit(0))).alias("n_links"))
    edges = found.select(F.col("id").alias("a"), F.col("least").alias("b")).unionByName(inside.where("reach is not null").select(F.col("id").alias("a"), F.col("reach").alias("b")))
    groups = components(edges.unionByName(spark.createDataFrame(ties, "a long, b long")))
    member = keyed.select("id", "h", "g").join(classes, ["h", "g"]).select("id", "rep")
    made = member.join(total, "rep").join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("id", "n_links", F.coalesce("component", "rep").alias("component"))
    made = written(made, "linked")
    discard(keyed, classes, first, placed, planted, found, inside)
    out = rows.select("id").join(made, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
