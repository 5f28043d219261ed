"""Near duplicates by SuperMinHash.

A document is its set of five-word shingles (lower-cased A-Z, words between ASCII white space), each a 64-bit hash. Documents
with equal sets form a class, and only its smallest id goes on. Every element of a set draws a random permutation of the
registers step by step; step j offers j plus a random fraction to the register that comes next in the element's permutation,
and a set's registers keep minima. As values grow with j, a set whose registers all lie under j is done, so large sets take
few steps. Registers are cut into bands; equal bands make a bucket.

In a bucket, every member is verified on full sets against the smallest id (the hub) only, so work grows with the bucket's
size and not with its square. Union-find joins what is linked. Members that are still in different groups of a bucket are
compared with each other only where the sizes of the sets and the frequencies of their shingles allow a link (open_pairs), and
those are verified on full sets too. So every bucket's links are respected exactly, with no cap on buckets.

The chance that a pair at the limit of 0.75 shares none of the 32 bands of 4 registers is 5e-6, and less above it.

An empty table gives an empty one; other columns, whatever their names, are not read.
Texts that are null, empty or all white space have no shingles and link with nothing. Rows with the same id count as one node
of the graph, linked by any of its texts; rows without an id only belong to their equals. Equal texts always share a component. Texts are taken whole.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.llm.common import GOLDEN, Words, discard, free_name, id_text, mix, per_text, written
from tarnwork.llm.graph import components

WORDS, PERCENT = 5, 75
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Candidate ids up to which their set is broadcast (8 bytes each); beyond, a shuffled join does the same.
BROADCAST_IDS = 1_000_000
#: Documents up to which a shingle counts as rare.
RARE = 64


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    own = Words(texts, lower=True)
    return _shingles(own.hashes(), own.count, words)


def _shingles(h: np.ndarray, size: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    rolled, out, end = np.zeros(max(0, len(h) - words + 1), np.uint64), [], 0
    for k in range(words):
        rolled = mix(rolled * np.uint64(31) + h[k : k + len(rolled)] + GOLDEN)
    for n in size.tolist():
        start, end = end, end + n
        if n >= words:
            own = np.sort(rolled[start : end - words + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif n:
            whole = np.full(1, n, np.uint64)
            for x in h[start:end]:
                whole = mix(whole * np.uint64(31) + x + GOLDEN)
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out


#: Steps whose swaps are looked up one by one; only elements that are still open then get a permutation of their own.
FIRST_STEPS = 4


#: Elements that draw their permutations together, each taking m bytes and more: as many as 2 MB of prose have, and short words have several times as
#: many. A larger set goes whole, but takes few steps.
ELEMENTS = 300_000


def superminhash(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """Registers (sets x m), infinite for empty sets."""
    start = np.cumsum([0, *map(len, sets)])
    edges = [0, *(np.flatnonzero(np.diff(start[:-1] // ELEMENTS)) + 1).tolist(), len(sets)]
    return np.concatenate([_registers(sets[a:b], m) for a, b in zip(edges, edges[1:], strict=False)])


def _registers(sets: list[np.ndarray], m: int) -> np.ndarray:
    size = np.array([len(s) for s in sets], np.int64)
    h = np.full(len(sets) * m, np.inf)
    element, owner = np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets), dtype=np.int32), size)
    open_, moved, order = np.flatnonzero(size > 0), [], None  # moved: (to, value) of each step's swap
    for j in range(m):
        if not len(element):
            break
        draw = mix(element + np.uint64(int(GOLDEN) * (2 * j + 1) % 2**64))
        k = j + (mix(draw ^ GOLDEN) % np.uint64(m - j)).astype(np.int64)
        if j == FIRST_STEPS:
            order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(element), 1))
            for to, value in moved:
                order[np.arange(len(element)), to] = value
        if order is None:
            register, own = k.copy(), np.full(len(k), j, np.int64)
            for to, value in moved:
                register[to == k] = value[to == k]
                own[to == j] = value[to == j]
            moved.append((k, own))
        else:
            at = np.arange(len(element))
            register = order[at, k].astype(np.int64)
            order[at, k] = order[:, j]
        np.minimum.at(h, owner.astype(np.int64) * m + register, j + (draw >> np.uint64(11)) * 2.0**-53)
        done = h.reshape(-1, m)[open_].max(axis=1) <= j + 1
        if done.any():
            over = np.zeros(len(sets), bool)
            over[open_[done]] = True
            left, open_ = ~over[owner], open_[~done]
            element, owner = element[left], owner[left]
            if order is None:
                moved = [(to[left], value[left]) for to, value in moved]
            else:
                order = order[left]
    return h.reshape(-1, m)


def bands(registers: np.ndarray) -> np.ndarray:
    """(sets x BANDS) keys as signed 64-bit integers; the band's number is part of its key."""
    parts = registers.view(np.uint64).reshape(len(registers), BANDS, ROWS)
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(registers), 1))
    for r in range(ROWS):
        key = mix(key * np.uint64(31) + parts[:, :, r] + GOLDEN)
    return key.view(np.int64)


def _sign(texts: list[str]) -> list:
    own = Words(texts, lower=True)
    sets = _shingles(own.hashes(), own.count)
    keys = bands(superminhash(sets)) if texts else np.empty((0, BANDS), np.int64)
    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1)))
    return [own.count, [len(s) for s in sets], [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], listed]


def _sets(texts: list[str]) -> list:
    return [[s.tobytes() for s in shingles(texts)]]


def _common(batches):
    """Adds to (a, b, sa, sb) the sizes of union and intersection; sa and sb are sorted distinct hashes."""
    for batch in batches:
        common, union = [], []
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
            at = np.searchsorted(b, a)
            n = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(a) and len(b) else 0
            common.append(n)
            union.append(len(a) + len(b) - n)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "common", "both"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, both long) for pairs (a, b): sizes of intersection and union of their full sets."""
    half = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    full = half.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    return full.select("a", "b", "sa", "sb").mapInArrow(_common, "a long, b long, common long, both long")


def only(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose column is among ids (one column `id`, distinct)."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, df[column] == ids["id"], "left_semi")


def _tokens(batches):
    """(id, set) -> (id, s) for each shingle."""
    for batch in batches:
        for i in range(batch.num_rows):
            own = np.frombuffer(batch.column(1)[i].as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), batch.column(0)[i].as_py())), pa.array(own)], ["id", "s"])


def open_pairs(rest: DataFrame, sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(pairs, what was written for them): the pairs (a, b) of `rest` (key, id, n, component) that can still be linked: other components, one bucket or a rare shingle shared.

    A linked pair shares at least 0.75 / 1.75 of the sum of its sizes. Shingles that only one of these documents has are no
    help, which excludes most. With shingles ordered from rare to common, a linked pair's rarest common shingle lies in the
    prefix of both sets. If that is rare (RARE documents at most), an index of prefixes finds the pair; if not, the pair
    shares common shingles only, and both need enough of those, which is asked of pairs in a bucket.
    """
    docs = rest.select("id", "n", "component").distinct()
    held = sets.join(docs.select("id").distinct(), "id", "left_semi").select("id", "set")
    token = written(held.mapInArrow(_tokens, "id long, s long"), "tokens")
    df = written(token.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    known = token.join(df, "s")
    counts = known.groupBy("id").agg(F.count("*").alias("shared"), F.count_if(F.col("df") > RARE).alias("frequent"))
    docs = docs.join(counts, "id").where(f"100 * shared >= {PERCENT} * n")
    docs = written(docs, "open")
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "s"))
    prefix = known.join(docs, "id").withColumn("place", place).where(f"df <= {RARE} and place <= shared - ceil({PERCENT} * n / 100) + 1")
    prefix = prefix.select("s", "id", "n", "component", "shared")
    apart = f"x.component != y.component and x.id < y.id and 100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n) and {100 + PERCENT} * least(x.%s, y.%s) >= {PERCENT} * (x.n + y.n)"
    keys = rest.groupBy("id").agg(F.collect_set("key").alias("keys"))
    # common shingles alone can link a document only if they are 0.75 of it: with a partner of least size, 0.75 / 1.75 of 1.75 n
    common = docs.where(f"100 * frequent >= {PERCENT} * n").join(keys, "id")
    band = F.floor(F.log(F.col("n")) / math.log(100 / PERCENT)).cast("int")  # sizes of linked sets lie in one band or in neighbouring ones
    placed = written(rest.select("key", "id").distinct().join(common, "id").withColumn("band", band), "placed")
    once = "x.key = array_min(array_intersect(x.keys, y.keys))"  # of the buckets that a pair shares, one speaks for it
    pairs = prefix.alias("x").join(prefix.alias("y"), F.expr(f"x.s = y.s and {apart % ('shared', 'shared')}"))
    wider = placed.withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)))
    more = placed.alias("x").join(wider.alias("y"), F.expr(f"x.key = y.key and x.band = y.band and {apart % ('frequent', 'frequent')} and {once}"))
    found = [p.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")) for p in (pairs, more)]
    return found[0].unionByName(found[1]).distinct(), [token, df, docs, placed]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_shingles, component_id long, kept boolean) for each row; integer ids. With columns to carry along it adds them and n_words."""
    texts = id_text(docs, id_col, text_col).select(F.col("_id").cast("long").alias("_id"), "_text")
    key = F.struct(F.col(id_col).cast("long").alias("id"), *[F.col(c).alias(f"_{c}") for c in carry])
    kind = docs.select(key.alias("row")).schema["row"].dataType.simpleString()
    rows = docs.select(key.alias("row"), F.col(text_col).cast("string").alias("_text"))
    signed = rows.mapInArrow(per_text(_sign, [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]), f"row {kind}, words long, n long, digest binary, bands array<long>")
    signed = written(signed.select("row.*", "words", "n", "digest", "bands"), "signed")
    own = [f"_{c}" for c in carry] + (["words"] if carry else [])
    # what is joined back to the rows it sums up is written first: then both sides are dealt for the join, and a hot key can be split
    classes = written(signed.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    member = written(signed.select("id", "n", "digest", *own).join(classes, "digest", "left").select("id", "n", "rep", *own), "member")
    heads = signed.where("n > 0").join(member.where("id = rep").select("id").distinct(), "id", "left_semi")
    keyed = written(heads.select("id", "n", F.explode("bands").alias("key")), "keyed")
    hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub")
    hubs = written(hubs, "hubs")
    buckets = written(keyed.join(hubs, "key"), "buckets")  # id, n, key, hub of the buckets with two ids or more
    candidates = written(buckets.select("id").distinct(), "candidates")
    sets = only(texts, "_id", candidates).mapInArrow(per_text(_sets, [pa.binary()]), "id long, set binary").where(F.length("set") > 0)
    sets = written(sets, "sets")

    pairs = buckets.where("id > hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    tested = written(verify(pairs, sets), "tested")
    linked = tested.where(f"100 * common >= {PERCENT} * both").select("a", "b")
    group = written(components(linked), "groups")

    placed = buckets.join(group, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    mixed = written(mixed, "mixed")
    rest = written(placed.join(mixed, "key", "left_semi"), "rest")
    pairs, used = open_pairs(rest, sets)
    more = written(verify(pairs, sets).where(f"100 * common >= {PERCENT} * both").select("a", "b"), "more")
    stars = group.where("id != component").select(F.col("component").alias("a"), F.col("id").alias("b"))
    repeated = member.where("rep != id").groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")  # one id, several texts
    repeated = repeated.select(F.explode(F.array("lo", "hi")).alias("a"), F.col("id").alias("b"))
    links = written(stars.unionByName(more).unionByName(repeated), "links")
    final = components(links)
    discard(signed, classes, keyed, hubs, mixed, buckets, candidates, sets, tested, group, rest, *used, more, links)
    out = member.join(final.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "id")
    made = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"), *own)
    return made.withColumnsRenamed({f"_{c}": c for c in carry} | {"words": "n_words"})


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns: the one of the smallest id. Rows without words or text all stay.

    Where ids are missing or repeated, every row is a document of its own: rows are numbered, the number being their id, and of
    a component the row of the smallest id stays, a missing id being the last, rows of one id by their number.
    """
    ids = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n"))
    own = id_col
    if ids.where("id is null or n > 1").limit(1).count():
        own = free_name(docs, "row")
        docs = written(docs.withColumn(own, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(docs, own, text_col)
    if own == id_col:
        gone = found.where("not kept").select(F.col(own).cast(docs.schema[own].dataType).alias("id"))
    else:
        member = written(found.select(F.col(own).alias("id"), "component_id").join(docs.select(F.col(own).alias("id"), F.col(id_col).alias("doc")), "id"), "numbers")
        first = member.groupBy("component_id").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "id")).alias("first"))
        gone = member.join(first, "component_id").where("id != first.id").select("id")
    gone = written(gone, "gone")
    if own != id_col:
        discard(member)
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[own] == gone["id"], "left_anti").drop(*[own] if own != id_col else [])
