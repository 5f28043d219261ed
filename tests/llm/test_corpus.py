"""Operators that compare rows: packing, near duplicates, vectors, lines, and the pipeline."""

import random
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import common, covertree, lines, minhash, packing, queries
from tarnwork.llm.graph import Forest, components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def smallest(nodes, links):
    forest = Forest()
    for a, b in links:
        forest.join(a, b)
    return {n: forest.root(n) for n in nodes}


# --- components ----------------------------------------------------------------------------------------------------------


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(80)] + [(5, 5), (400, 399), (400, 399)]
    got = {x.id: x.component for x in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {n: c for n, c in smallest({x for ab in links if ab[0] != ab[1] for x in ab}, links).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- near duplicates -----------------------------------------------------------------------------------------------------


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_of(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    index, links = {}, []
    for k, (_, s) in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(k)
    for k, (i, s) in enumerate(sets):
        for j, n in Counter(j for x in s for j in index[x] if j < k).items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                links.append((i, sets[j][0]))
    root = smallest([i for i, _ in rows], links)
    return sorted((i, len(s), root[i], root[i] == i) for i, s in sets)


def test_near_duplicates_like_brute_force(spark, sf):
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    assert sorted(map(tuple, queries.op5_superminhash(spark, sf).collect())) == near_of(rows)


def test_family_around_the_threshold(spark):
    """Copies of copies, many under the threshold with each other, and a hub that few are linked with."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(160):
        text = list(base)
        for _ in range(r.randrange(0, 9)):
            text[r.randrange(len(text))] = f"n{r.randrange(10**6)}"
        rows.append((k * 3 % 1000, " ".join(text)))
    rows += [(5000 + k, rows[k][1].upper()) for k in range(20)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == near_of(rows)


def test_words_are_told_apart():
    r = random.Random(6)
    words = ["", "a", "b", "ab", "ba", "\x00", "\x00\x00", "é", "É", "x" * 64, "x" * 65, "x" * 66, "Z" * 9, "z" * 9, *("".join(r.choice("ab") for _ in range(r.randrange(1, 30))) for _ in range(500))]
    own = common.Words([" ".join(words), "", "a  b\tc\nd\x0be\x0cf\rg\x1ch\x85i\xa0j", *words], lower=True)
    h, n = own.hashes(), own.count
    first, number = own.distinct()
    assert [own[first[k]] for k in number] == [own[i] for i in range(len(h))] and not own.same_as(np.roll(np.arange(len(h)), 1))
    assert n.tolist()[:3] == [len(words) - 1, 0, 7] and n.tolist()[3:] == [0] + [1] * (len(words) - 1)
    known = {}
    for w, x in zip(words[1:], h, strict=False):
        assert known.setdefault(w.encode().lower(), x) == x
    assert len(set(known.values())) == len(known) and h[len(words) + 6 :].tolist() == h[: len(words) - 1].tolist()


def test_a_bucket_of_many_components_is_not_paired(spark):
    """20,000 documents in one bucket that share passages but hardly any link: every link is found, in seconds."""
    import time

    rng = np.random.default_rng(3)
    passages = rng.integers(1, 2**62, (12, 60))
    sets, links = [], set()
    for i in range(20_000):
        own = rng.integers(1, 2**62, int(rng.integers(40, 160)))
        sets.append(np.unique(np.concatenate([passages[rng.permutation(12)[:4]].reshape(-1), own])).astype(np.uint64))
        if i % 100 == 1:
            sets[i] = np.unique(np.concatenate([sets[i - 1][:-5], own[:3].astype(np.uint64)]))
            links.add((i - 1, i))
    rest = spark.createDataFrame([(1, i, len(s), i) for i, s in enumerate(sets)], "key long, id long, n long, component long")
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "id long, set binary")
    began = time.time()
    pairs, _ = minhash.open_pairs(rest, table)
    found = {(r.a, r.b) for r in minhash.verify(pairs, table).where("100 * common >= 75 * both").collect()}
    assert time.time() - began < 90  # all pairs would be 2e8
    assert links <= found and all(len(np.intersect1d(sets[a], sets[b])) * 100 >= 75 * len(np.union1d(sets[a], sets[b])) for a, b in found)
    for i in rng.integers(0, 20_000, 4).tolist():  # against brute force
        near = {(min(i, j), max(i, j)) for j in range(20_000) if j != i and min(len(sets[i]), len(sets[j])) * 100 >= 75 * max(len(sets[i]), len(sets[j])) and len(np.intersect1d(sets[i], sets[j], assume_unique=True)) * 100 >= 75 * len(np.union1d(sets[i], sets[j]))}
        assert near <= found


def test_near_duplicate_edges(spark):
    rows = [(9, None), (8, ""), (7, " \n"), (6, "a b"), (5, "A  B"), (4, "a b c d e"), (3, "x " * 5000), (3, "x " * 5000), (2, "é ü"), (1, "É ü")]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id int, text string, n int, key string")
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()))
    assert got == sorted([(9, 0, 9, True), (8, 0, 8, True), (7, 0, 7, True), (6, 1, 5, False), (5, 1, 5, True), (4, 1, 4, True), (3, 1, 3, True), (3, 1, 3, True), (2, 1, 2, True), (1, 1, 1, True)])
    assert minhash.keep_first(df).columns == df.columns and minhash.keep_first(df).where("doc_id = 6").count() == 0
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_superminhash_is_unbiased():
    r = random.Random(0)
    off = []
    for _ in range(60):
        a = np.unique(np.array([r.getrandbits(64) for _ in range(150)], np.uint64))
        b = np.unique(np.concatenate([a[: r.randrange(150)], np.array([r.getrandbits(64) for _ in range(60)], np.uint64)]))
        h = minhash.superminhash([a, b])
        off.append((h[0] == h[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.05
    assert np.isinf(minhash.superminhash([np.empty(0, np.uint64)])).all()


def test_signing_short_words_keeps_to_its_memory():
    rng = np.random.default_rng(0)
    texts = [" ".join(row) for row in rng.choice(list("abcdefghij"), (7600, 100))]  # a step of short words
    assert len(list(common.pieces(pa.array(texts)))) == 1
    tracemalloc.start()
    keys = minhash._sign(texts)[3]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6, peak
    sets = minhash.shingles(texts)
    at = [0, 1, 3124, 3125, 3126, 7599]
    alone = [minhash.bands(minhash.superminhash([sets[i]]))[0].tolist() for i in at]
    assert [keys[i].as_py() for i in at] == alone and sum(map(len, sets)) > 2 * minhash.ELEMENTS


def test_superminhash_in_runs_of_sets(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**62, n).astype(np.uint64)) for n in (0, 3, 500, 0, 40, 41, 7, 0)]
    whole = minhash.superminhash(sets)
    for n in (1, 10, 45, 100):
        monkeypatch.setattr(minhash, "ELEMENTS", n)
        assert np.array_equal(minhash.superminhash(sets), whole)
    assert minhash.superminhash([]).shape == (0, minhash.REGISTERS)


# --- vectors -------------------------------------------------------------------------------------------------------------


def linked_of(ids, x, threshold=0.9):
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    root = smallest(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near), strict=True)])
    return sorted((i, int(n), root[i], root[i] == i) for i, n in zip(ids, near.sum(axis=1), strict=True))


def test_vectors_like_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 100)
    rows = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()
    want = linked_of([i for i, _ in rows], np.array([v for _, v in rows], np.float64))
    assert sorted(map(tuple, queries.op7_cover_tree(spark, sf).collect())) == want


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vector_clusters_and_edges(spark, monkeypatch, kind):
    monkeypatch.setattr(covertree, "BLOCK", 60)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(80, 16))
    x = np.concatenate([base, *[base[:25] + rng.normal(size=(25, 16)) * s for s in (0.05, 0.3, 0.5)], base[3] + rng.normal(size=(70, 16)) * 0.15])
    x = x.astype(np.float32).astype(np.float64)
    ids = [int(i) for i in rng.permutation(1000)[: len(x)]]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [float("inf")] + [1.0] * 15), (2006, [1.0, 0.0]), (2007, [2.0, 0.0])]
    rows = [(i, v.tolist(), 1) for i, v in zip(ids, x, strict=True)] + [(i, v, None) for i, v in odd]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, n int")
    want = linked_of(ids, x) + [(i, 0, i, True) for i in range(2000, 2006)] + [(2006, 1, 2006, True), (2007, 1, 2006, False)]
    assert sorted(map(tuple, covertree.near_vectors(df).collect())) == sorted(want)
    twice = df.unionByName(df.where("vec_id in (2006, 2007)"))
    assert sorted(map(tuple, covertree.near_vectors(twice).collect())) == sorted([*want, *want[-2:]])
    assert covertree.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("tight", [0.002, 0.03])
def test_cells_that_are_settled_as_a_whole(spark, monkeypatch, tight):
    """Tight groups along an arc, each linked with some neighbours as a whole, equal vectors, and very large and small components."""
    monkeypatch.setattr(covertree, "BLOCK", 40)
    monkeypatch.setattr(covertree, "TILE", 100)
    rng = np.random.default_rng(2)
    x = []
    for k, turn in enumerate([0.0, 0.15, 0.3, 0.55, 0.7, 1.4, 1.6, 2.5, 2.93]):
        middle = np.zeros(12)
        middle[:2] = np.cos(turn), np.sin(turn)
        x.append((middle + rng.normal(size=(90, 12)) * tight) * 10.0 ** (40 * k - 160))
    x = np.concatenate([*x, np.tile(x[4][:1], (200, 1))])
    ids = [int(i) for i in rng.permutation(5000)[: len(x)]]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, covertree.near_vectors(df).collect())) == linked_of(ids, x / np.abs(x).max(axis=1, keepdims=True))
    cells = covertree.Cells()
    top = cells.add(-1, 12, None)
    cells.seen(top, 1, 1, 0, 2.0)
    assert cells.descend(0.9)[0] == [(top, top)]


def test_tree_is_nested():
    x = np.random.default_rng(1).normal(size=(300, 5)).astype(np.float32)
    t = covertree.build(np.arange(300), x)
    u = covertree.unit(t.x).astype(np.float64)
    d = np.sqrt(np.maximum(0, 2 - 2 * u @ u.T))
    for r, n in zip(covertree.RADII, t.n[:-1], strict=False):  # the last level has all
        near = d[:, :n].min(axis=1)
        assert near.max() <= r + 1e-3 and (n < 2 or (d[:n, :n] + 9 * np.eye(n)).min() > r - 1e-3)
    assert sorted(t.ids) == list(range(300)) and covertree.Tree.unpack(t.pack()).n == t.n


# --- packing -------------------------------------------------------------------------------------------------------------


def packed_of(ids, sizes, sources, clusters, capacity):
    """Best fit by looking at every bin."""
    todo, out, bins = [], [], []
    for i, n in enumerate(sizes):
        full, rest = divmod(max(n, 0), capacity)
        out += [(i, 0, 0, None, 0)] if n <= 0 else []
        todo += [(capacity, i, k) for k in range(full)] + ([(rest, i, full)] if rest else [])
    for n, i, k in sorted(todo, key=lambda x: (-x[0], ids[x[1]], str(clusters[x[1]]), x[2], x[1])):
        fits = [b for b in bins if b["left"] >= n and sources[i] not in b["sources"] and (clusters[i] is None or clusters[i] not in b["clusters"])]
        least = min((b["left"] for b in fits), default=None)
        b = next((b for b in fits if b["left"] == least), None)
        if b is None:
            b = {"left": capacity, "sources": set(), "clusters": set(), "n": len(bins)}
            bins.append(b)
        out.append((i, k, n, b["n"], capacity - b["left"]))
        b["left"] -= n
        b["sources"].add(sources[i])
        b["clusters"].add(clusters[i])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_best_fit_without_conflicts(seed):
    r = random.Random(seed)
    n = 400
    ids, sizes = list(range(n)), [r.choice((0, r.randrange(1, 60), r.randrange(1, 300))) for _ in range(n)]
    sources, clusters = [r.choice("aaaabcdefgh") for _ in range(n)], [r.choice((None, r.randrange(50), r.randrange(10**6))) for _ in range(n)]
    got = packing.pack_block(ids, sizes, sources, clusters, 100)
    left: dict = {}

    def shape(rows):  # bins of equal room are interchangeable: compare how tight each piece was placed
        return sorted((i, k, size) for i, k, size, *_ in rows)

    assert shape(got) == shape(packed_of(ids, sizes, sources, clusters, 100))
    held: dict = {}
    for i, _, size, b, at in got:
        if b is None:
            continue
        assert left.get(b, 100) == 100 - at and at + size <= 100
        fits = [x for x in left if left[x] >= size and left[x] < 100 - at and sources[i] not in held[x][0] and (clusters[i] is None or clusters[i] not in held[x][1])]
        assert not fits, "a tighter compatible bin was open"
        s, c = held.setdefault(b, (set(), set()))
        assert sources[i] not in s and (clusters[i] is None or clusters[i] not in c)
        s.add(sources[i])
        c.add(clusters[i])
        left[b] = 100 - at - size


def test_packing_keeps_every_word(spark, sf, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 70)
    got = queries.op1_best_fit_packing(spark, sf)
    want = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()}
    assert {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()} == want
    assert got.groupBy("bin_id").agg(F.sum("n_words").alias("n")).where(f"n > {packing.CAPACITY}").count() == 0
    df = spark.createDataFrame([(1, None, None, "s", 1, 2), (2, "", "en", None, 1, 2), (3, "a " * 5000, None, "s", None, 2), (3, "a " * 5000, None, "s", None, 2)], "doc_id int, text string, lang string, source string, bin_id int, size int")
    out = packing.pack_documents(df)
    assert out.where("doc_id = 3").count() == 6 and out.where("bin_id is null").count() == 2
    assert out.where("doc_id = 3").groupBy("bin_id").count().where("count > 1").count() == 0
    assert packing.pack_documents(df.where("false")).count() == 0


def test_near_copies_never_share_a_bin(spark, tmp_path):
    r = random.Random(8)
    base = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(6)]
    rows = []
    for k, text in enumerate(base):  # copies in other letters, with other white space, with a word more, and equal
        own = [text, text.upper(), text.replace(" ", "  "), text + " more", text]
        rows += [(10 * k + j, t, "en", f"source {j}", len(t)) for j, t in enumerate(own)]
        rows += [(None, text, "en", f"none {k}", len(text)), (None, text, "en", f"other {k}", len(text))]
    r.shuffle(rows)
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op1_best_fit_packing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and sum(x.n_words for x in got) == sum(len(x[1].split()) for x in rows)
    held = Counter((x.bin_id, x.doc_id // 10) for x in got if x.doc_id is not None)
    assert max(held.values()) == 1
    one = [(j, t, "en", f"s{j}", 1) for j, t in enumerate(own)] + [(None, text, "en", "s8", 1), (None, text, "en", "s9", 1)]
    assert packing.pack_apart(spark.createDataFrame(one, DOCS)).select("bin_id").distinct().count() == 7  # rows without an id too
    assert packing.pack_apart(spark.createDataFrame([], DOCS)).count() == 0


def test_rows_that_share_an_id_are_dealt_to_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 500)
    rows = [(None, "one two three", "en", "s", 1)] * 4000 + [(7, "four five", "en", "t", 1)] * 3000 + [(i, "six", "en", "u", 1) for i in range(1000, 2000)]
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    blocks = packing._dealt(df.select(F.col("doc_id").alias("id"), F.lit(3).alias("size"), "source", F.lit(1).alias("cluster")), 16).groupBy("block").count().collect()
    assert len(blocks) == 16 and max(r["count"] for r in blocks) < 1000
    got = packing.pack_documents(df)
    assert got.count() == 8000 and got.groupBy("bin_id").count().where("count > 3").count() == 0 and got.where("bin_id is null").count() == 0


# --- lines and the pipeline ----------------------------------------------------------------------------------------------


def plain_lines(rows, least):
    key = lambda x: x.strip(" \t\r\x0b\x0c")
    sites, first = {}, {}
    for i, t, s in rows:
        for x in (t or "").split("\n"):
            if key(x):
                sites.setdefault(key(x), set()).add(s)
                first[key(x)] = min(first.get(key(x), i), i)
    gone = {x for x, s in sites.items() if len(s) >= least}
    return {i: t if t is None else "\n".join(x for x in t.split("\n") if key(x) not in gone or first[key(x)] == i) for i, t, _ in rows}


@pytest.mark.parametrize("least", [2, 3, 10])
def test_lines(spark, least):
    r = random.Random(2)
    rows = [(i, "\n".join([f"own {i}", *r.sample([f" shared {k} " for k in range(12)], r.randrange(0, 6)), ""]), r.choice(["a", "b", "c", None])) for i in range(60)]
    rows += [(100 + k, "on every site\n\nx", f"s{k}") for k in range(12)] + [(200, None, "a"), (201, "", None), (202, "on every site", "a"), (203, "long\n" * 3000, "b")]
    df = spark.createDataFrame([(*x, 7, 1) for x in rows], "doc_id long, text string, source string, gone int, key int")
    got = lines.drop_spread_lines(df, least)
    assert got.columns == df.columns and {x.doc_id: x.text for x in got.collect()} == plain_lines(rows, least)
    assert lines.drop_spread_lines(df.where("false")).count() == 0


def test_lines_plan_has_no_python(spark, sf):
    plan = queries.op8_line_dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_lines_like_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(f"select doc_id, text, n_lines, n_removed from ({lines.ORACLE}) order by 1").fetchall()
    assert [tuple(r) for r in queries.op8_line_dedup(spark, sf).orderBy("doc_id").collect()] == want


def test_pipeline_stage_by_stage(spark, sf):
    import sys

    sys.path.insert(0, ".")
    import corpus_pipeline as p
    from tarnwork.llm import repetition, secrets

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "secret_scan", "packing"]
    rows = {r.doc_id: r for r in docs.collect()}
    kept = [i for i, r in rows.items() if repetition.measure([r.text or ""])[-1][0]]
    docs = p.quality(spark, docs, sf)
    assert sorted(r.doc_id for r in docs.collect()) == sorted(kept)
    want = plain_lines([(i, rows[i].text, rows[i].source) for i in kept], lines.MIN_SITES)
    docs = p.boilerplate(spark, docs, sf)
    assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {i: (t, len(t)) for i, t in want.items()}
    alive = {i for i, _, _, first in near_of(list(want.items())) if first}
    docs = p.near_duplicates(spark, docs, sf)
    assert {r.doc_id for r in docs.collect()} == alive
    docs = p.secret_spans(spark, docs, sf)
    assert {r.doc_id: r.text for r in docs.collect()} == {i: secrets.redacted(want[i]) for i in alive}
    assert docs.columns == list(spark.read.parquet(f"{sf}/documents.parquet").columns)
    last = p.run(spark, sf)
    assert {r.doc_id for r in last.collect()} == alive
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 9000, None, None, 1)], DOCS)
    for _, stage in p.STAGES:
        assert stage(spark, odd.where("false"), sf).count() == 0
        stage(spark, odd, sf).collect()


def test_one_row_of_repeated_and_nameless_ones_stays(spark):
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(None, text), (None, text + " x"), (9, text), (9, text), (7, text + " y"), (None, other), (None, other), (3, other + " z"), (3, " ".join("abcdefgh")), (None, None), (5, ""), (5, "")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id int, text string, row int").repartition(4)
    got = minhash.keep_first(df)
    assert got.columns == df.columns
    kept = {r.row for r in got.collect()}
    assert kept == {4, 7, 8, 9, 10, 11}  # the smallest id of each group, and what has no words
    same = spark.createDataFrame([(None, text)] * 5, "doc_id long, text string")
    assert minhash.keep_first(same).count() == 1


def test_rows_without_an_id(spark, sf):
    from tarnwork.llm import bpe, langid, records, repetition, secrets

    rows = [(None, "a b c d e f", "en", None, 1), (None, "a b c d e f", None, "s", 1), (None, None, None, None, None), (4, "a b c d e f", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(map(repr, map(tuple, minhash.near_duplicates(df).collect()))) == sorted(map(repr, [(None, 2, 4, False), (None, 2, 4, False), (None, 0, None, True), (4, 2, 4, True)]))
    assert sorted(map(repr, minhash.keep_first(df).collect())) == sorted(map(repr, (r for r in df.collect() if r.doc_id == 4 or r.text is None)))
    assert packing.pack_documents(df).count() == lines.drop_spread_lines(df).count() == langid.identify(df).where("not held_out").count() == 4
    assert records.read(records.write(df, queries.tokenizer_path("word_bpe_49k.json"), 2)).where("doc_id is null").count() == 3
    assert bpe.encode(df, queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), queries.pattern()).count() == repetition.quality(df).count() == secrets.find_secrets(df).count() == 4
    v = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in covertree.near_vectors(v).collect()} == {(None, 0, None, True), (1, 0, 1, True)}
