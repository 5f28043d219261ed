"""What the operators share: reading tables, written intermediates, Arrow batches in bounded pieces."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one step of a Python operator holds at a time.
STEP_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_written: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset and all runs on one machine (tests), a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tarnwork-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder; removed when the process ends, or by remove()."""
    path = f"{shared_root(spark)}/tarnwork/{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session has ended  # noqa: BLE001
            return


def written(df: DataFrame, what: str) -> DataFrame:
    """df, computed once, written to the shared folder and read back: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_dir(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarnwork_path = path
    return out


@contextlib.contextmanager
def settings(spark: SparkSession, changes: dict[str, str]) -> Iterator[None]:
    """Spark's settings, changed while something is written."""
    before = {k: spark.conf.get(k, None) for k in changes}
    try:
        for k, v in changes.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def discard(*frames: DataFrame) -> None:
    """Deletes what written() wrote; for frames that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_tarnwork_path", None):
            remove(df.sparkSession, path)


def free_name(df: DataFrame, want: str) -> str:
    """want, or want with underscores, so that it clashes with no column of df whatever the letter case."""
    have = {c.lower() for c in df.columns}
    while want.lower() in have:
        want += "_"
    return want


def per_text(fn: Callable[[list[str]], list[list]], types: list[pa.DataType], step: int = STEP_CHARS):
    """A mapInArrow function for rows (key, text): keeps the first column, replaces the text by fn's columns.

    fn gets whole texts (null as ""), about `step` characters of them at a time, and returns one list or array per output column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in pieces(batch.column(1), step):
                texts = [t or "" for t in batch.column(1).slice(at, n).to_pylist()]
                made = [pa.array(v, type=t) for v, t in zip(fn(texts), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *made], [str(i) for i in range(1 + len(made))])

    return run


def pieces(texts: pa.Array, step: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of texts with about `step` bytes each; a longer text stands alone."""
    import pyarrow.compute as pc

    start = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if held and held + n > step:
            yield start, i - start
            start, held = i, 0
        held += n + 64
    if len(texts) > start:
        yield start, len(texts) - start


GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that part words; words of more bytes than LONG are taken one by one, as some texts are a single word.
WHITE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
LONG = 64
PRIME = np.uint64(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


class Words:
    """The words of texts, between ASCII white space, as places in one buffer of UTF-8; `count` has how many each text has.

    What is done to every word goes on byte by byte for all of them at once, the longest first.
    """

    def __init__(self, texts: list[str], lower: bool = False):
        cut = [t.encode("utf-8", "surrogatepass") for t in texts]
        whole = b"\n".join(cut)
        self.whole = whole.lower() if lower else whole
        self.data = np.frombuffer(self.whole, np.uint8)
        edge = np.diff(np.concatenate([[True], WHITE[self.data], [True]]).view(np.int8))
        self.start = np.flatnonzero(edge == -1)
        self.size = np.flatnonzero(edge == 1) - self.start
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)) + 1)
        self.count = np.diff(np.searchsorted(self.start, ends), prepend=0) if cut else np.empty(0, np.int64)
        self.order = np.argsort(-self.size, kind="stable")
        rising = self.size[self.order][::-1]
        self.live = len(rising) - np.searchsorted(rising, np.arange(LONG + 1), "right")  # words of more than k bytes

    def __getitem__(self, i: int) -> bytes:
        return self.whole[self.start[i] : self.start[i] + self.size[i]]

    def taken(self, at: np.ndarray) -> list[bytes]:
        whole = self.whole
        return [whole[a:b] for a, b in zip(self.start[at].tolist(), (self.start + self.size)[at].tolist(), strict=True)]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        first, h = self.start[self.order], np.zeros(len(self.order), np.uint64)
        for k, c in enumerate(self.live[:LONG].tolist()):
            if not c:
                break
            own = (h[:c] ^ BYTE[self.data[first[:c] + k]]) * PRIME
            h[:c] = mix(own) if k % 8 == 7 else own
        for i in range(self.live[LONG]):
            h[i] = xxhash.xxh64_intdigest(self[self.order[i]])
        out = np.empty(len(h), np.uint64)
        out[self.order] = mix(h ^ self.size[self.order].astype(np.uint64))
        return out

    def same_as(self, other: np.ndarray) -> bool:
        """Whether every word i has the bytes of word other[i]."""
        if not (self.size == self.size[other]).all():
            return False
        first, second = self.start[self.order], self.start[other[self.order]]
        apart = np.flatnonzero(first != second)
        first, second, size = first[apart], second[apart], self.size[self.order][apart]
        live = len(size) - np.searchsorted(size[::-1], np.arange(LONG), "right")
        for k, c in enumerate(live.tolist()):
            if not c:
                break
            if (self.data[first[:c] + k] != self.data[second[:c] + k]).any():
                return False
        return all(self.whole[a : a + n] == self.whole[b : b + n] for a, b, n in zip(first.tolist(), second.tolist(), size[: (size > LONG).sum()].tolist()))

    def distinct(self) -> tuple[np.ndarray, np.ndarray] | None:
        """(places of the distinct words, number of each word among them); None where two words share a hash."""
        _, first, number = np.unique(self.hashes(), return_index=True, return_inverse=True)
        return (first, number) if self.same_as(first[number]) else None


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
