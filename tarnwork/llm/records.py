"""Token ids as length-delimited binary records in shards, with a separate index.

A shard holds documents of one range of ids, in ascending order. It begins with a head: eight bytes of format and version, the width of an
id (unsigned 32 bits) and their masked checksum. A record is: payload length (unsigned 64 bits), its masked
checksum, the payload, the payload's masked checksum (both unsigned 32 bits, all little-endian). The payload is the document's
number (64 bits) and its ids, each in `width` bytes. The index beside the shard has (document, offset, ids) in 20 bytes for each
record, so that a reader can take records in any order. A checksum is CRC-32, masked by rotation and an added constant, as
framed logs do so that checksums of data that hold checksums stay useful.

Tasks write to a name of their own and rename when done, so a task that is run again leaves one whole shard. Shards go to the
folder that all executors share, through pyarrow.fs; their number follows the table's bytes. When all are there, what failed attempts and earlier
runs left in the folder is removed and a manifest is written: width, end id, the tokenizer file's SHA-256, and a line for each
shard with its documents, ids and the ids before it. opened() reads it in any later session. Only one row for each shard
reaches the driver.

Null text counts as empty: its record has the end id alone. Rows with the same document number follow each other in order of
text; those without a number come first. If either fill several shards, these part them by the first 64 characters, then by place in the table (so
the table should be a written one), and only within a shard the whole text counts. An empty table writes no record. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm.bpe import Numbered, ragged
from tarnwork.llm.common import Words, new_dir, pieces, remove

FRAME, INDEX = struct.Struct("<QI"), np.dtype([("doc", "<i8"), ("offset", "<u8"), ("ids", "<u4")])
#: Words that a worker remembers before it starts afresh.
REMEMBERED = 700_000
#: A word of one token that parts words in a call.
SEPARATOR = b"\x01"
MASK = 0xA282EAD8
MAGIC, HEAD = b"twrec\0\0\1", struct.Struct("<8sII")
HEAD_BYTES = HEAD.size
#: Bytes of input (as the table's statistics tell) for a shard.
SHARD_BYTES = 64 << 20
BUFFER = 4 << 20
MANIFEST = "manifest.json"
#: Stands for a missing document number.
NO_DOC = -(1 << 63)


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


class WordTokenizer:
    """A tokenizers file whose tokens never cross ASCII white space: each distinct word is encoded once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path if path.startswith("/") else SparkFiles.get(path))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        (self.separator,) = self.tokenizer.encode(SEPARATOR.decode(), add_special_tokens=False).ids
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.forget()

    def forget(self) -> None:
        self.known = Numbered()
        self.flat, self.start, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, ids of each). Many words are one call, parted by a word of their own that no other has."""
        runs = [words[k : k + 500] for k in range(0, len(words), 500)]
        if any(SEPARATOR in w for w in words):
            runs = [[w] for w in words]
        texts = [f" {SEPARATOR.decode()} ".join(w.decode() for w in r) for r in runs]
        flat, size = [], []
        for run, made in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(made.ids, np.uint32)
            parts = np.flatnonzero(ids == self.separator) if len(run) > 1 else np.empty(0, np.int64)
            if len(parts) != len(run) - 1:
                raise ValueError("the tokenizer does not keep words apart")
            ends = np.append(parts, len(ids))
            size.append(np.diff(ends, prepend=-1) - 1)
            flat.append(np.delete(ids, parts))
        return np.concatenate(flat), np.concatenate(size)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.forget()
        before, words = len(self.known), Words(texts)
        first, number = words.distinct() or (np.arange(len(words.size)),) * 2
        at = np.fromiter(map(self.known.__getitem__, words.taken(first)), np.int64, len(first))[number]
        if new := list(itertools.islice(self.known, before, None)):
            ids, size = self._encoded(new)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, ids])
        size = self.size[at]
        cut = np.concatenate([[0], np.cumsum(size)])[np.cumsum(words.count)[:-1]] if texts else []
        return np.split(ragged(self.flat, self.start[at], size), cut) if texts else []


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, path: str, end_id: int, out_dir: str | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards (in out_dir, or a fresh folder in the shared one) and returns a row for each: shard, uri, n_docs, n_ids, start, width."""
    spark = docs.sparkSession
    out_dir = out_dir or new_dir(spark, "records")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_DOC)).alias("doc"), F.monotonically_increasing_id().alias("place"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not shards:
        size = int(str(docs.select(text_col)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // SHARD_BYTES), 1_000_000))
    remove(spark, f"{out_dir}/{MANIFEST}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tok = TaskContext.get().partitionId(), tokenizer(path)
        uri = f"{out_dir}/shard-{shard:06d}"
        fs, folder = _fs(out_dir)
        fs.create_dir(folder, recursive=True)
        name, own = f"{folder}/shard-{shard:06d}", f"{folder}/.{uuid.uuid4().hex}"
        n_docs = n_ids = 0
        offset = HEAD_BYTES
        with fs.open_output_stream(f"{own}.rec", buffer_size=BUFFER) as rec, fs.open_output_stream(f"{own}.idx", buffer_size=BUFFER) as idx:
            rec.write(headed(tok.width))
            for batch in batches:
                for at, n in pieces(batch.column(1)):
                    numbers = batch.column(0).slice(at, n).to_pylist()
                    index = np.zeros(n, INDEX)
                    for k, (doc, ids) in enumerate(zip(numbers, tok.encode(batch.column(1).slice(at, n).to_pylist()), strict=True)):
                        record = framed(struct.pack("<q", doc) + np.append(ids, end_id).astype(f"<u{tok.width}").tobytes())
                        index[k] = (doc, offset, len(ids) + 1)
                        rec.write(record)
                        offset += len(record)
                        n_ids += len(ids) + 1
                    idx.write(index.tobytes())
                    n_docs += n
        for end in ("rec", "idx"):
            fs.move(f"{own}.{end}", f"{name}.{end}")
        if n_docs:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "uri": [uri], "n_docs": [n_docs], "n_ids": [n_ids], "width": pa.array([tok.width], pa.int32())})

    dealt = rows.repartitionByRange(shards, F.col("doc"), F.left("text", F.lit(64)), F.col("place")).sortWithinPartitions("doc", "text").select("doc", "text")
    made = dealt.mapInArrow(run, "shard int, uri string, n_docs long, n_ids long, width int")
    start, manifest = 0, []
    for r in sorted(made.collect()):  # as many rows as shards
        manifest.append((*r[:4], start, r[4]))
        start += r[3]
    _finish(spark, out_dir, path, end_id, manifest)
    return spark.createDataFrame(manifest, "shard int, uri string, n_docs long, n_ids long, start long, width int")


def headed(width: int) -> bytes:
    return HEAD.pack(MAGIC, width, masked(MAGIC + struct.pack("<I", width)))


def _width(head: bytes, uri: str) -> int:
    magic, width, check = HEAD.unpack(head) if len(head) == HEAD.size else (b"", 0, 0)
    if magic != MAGIC or masked(head[:12]) != check:
        raise ValueError(f"{uri}: no shard of this format")
    return width


def _finish(spark: SparkSession, out_dir: str, path: str, end_id: int, shards: list[tuple]) -> None:
    """Removes what is none of the shards, and writes the manifest last."""
    jvm, known = spark.sparkContext._jvm, {f"{uri.rsplit('/', 1)[1]}.{end}" for _, uri, *_ in shards for end in ("rec", "idx")}
    at = jvm.org.apache.hadoop.fs.Path(out_dir)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.listStatus(at) if fs.exists(at) else []:
        name = found.getPath().getName()
        if name not in known and (name.startswith("shard-") or name.removeprefix(".").split(".")[-1] in ("rec", "idx")):
            fs.delete(found.getPath(), False)
    with open(path if path.startswith("/") else SparkFiles.get(path), "rb") as f:
        tokenizer_hash = hashlib.file_digest(f, "sha256").hexdigest()
    head = {"format": "twrec-1", "end_id": end_id, "tokenizer_sha256": tokenizer_hash, "shards": len(shards), "ids": sum(r[3] for r in shards)}
    rows = [{"shard": r[0], "name": r[1].rsplit("/", 1)[1], "n_docs": r[2], "n_ids": r[3], "start": r[4], "width": r[5]} for r in shards]
    out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{out_dir}/{MANIFEST}"), True)
    try:
        for at in range(0, len(rows) + 1, 10_000):
            out.write(bytearray("".join(json.dumps(x) + "\n" for x in ([head] if not at else []) + rows[at : at + 10_000]).encode()))
    finally:
        out.close()


def opened(spark: SparkSession, out_dir: str) -> DataFrame:
    """The shards of a folder that write() has finished, as write() returns them."""
    lines = spark.read.schema("format string, shard int, name string, n_docs long, n_ids long, start long, width int").json(f"{out_dir}/{MANIFEST}")
    return lines.where("format is null").select("shard", F.concat(F.lit(f"{out_dir}/"), "name").alias("uri"), "n_docs", "n_ids", "start", "width")


def read_shard(uri: str) -> Iterator[tuple[int, np.ndarray]]:
    """(document, ids) of each record, in order; checks every checksum and the index."""
    fs, name = _fs(uri)
    with fs.open_input_stream(f"{name}.rec", buffer_size=BUFFER) as rec, fs.open_input_stream(f"{name}.idx", buffer_size=BUFFER) as idx:
        width, offset = _width(rec.read(HEAD.size), uri), HEAD.size
        while head := rec.read(FRAME.size):
            size, check = FRAME.unpack(head) if len(head) == FRAME.size else (0, None)
            if masked(head[:8]) != check:
                raise ValueError(f"{uri}: the length at {offset} does not agree with its checksum")
            payload, check = rec.read(size), rec.read(4)
            if len(payload) < size or len(check) < 4 or masked(payload) != struct.unpack("<I", check)[0]:
                raise ValueError(f"{uri}: the record at {offset} does not agree with its checksum")
            doc, ids = struct.unpack_from("<q", payload)[0], np.frombuffer(payload, f"<u{width}", offset=8)
            entry = idx.read(INDEX.itemsize)
            if len(entry) < INDEX.itemsize or np.frombuffer(entry, INDEX)[0].tolist() != (doc, offset, len(ids)):
                raise ValueError(f"{uri}: the index does not agree with the record at {offset}")
            offset += FRAME.size + size + 4
            yield doc, ids
        if idx.read(1):
            raise ValueError(f"{uri}: the index has more entries than there are records")


def read_at(uri: str, row: int) -> tuple[int, np.ndarray]:
    """Record number `row` of a shard, found by its index."""
    fs, name = _fs(uri)
    with fs.open_input_file(f"{name}.idx") as f:
        doc, offset, n = np.frombuffer(f.read_at(INDEX.itemsize, row * INDEX.itemsize), INDEX)[0].tolist()
    with fs.open_input_file(f"{name}.rec") as f:
        width = _width(f.read_at(HEAD.size, 0), uri)
        return doc, np.frombuffer(f.read_at(n * width, offset + FRAME.size + 8), f"<u{width}")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 long) of each record; start counts the ids before it in all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at, rows = r["start"], []
                for doc, ids in read_shard(r["uri"]):
                    rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    out = manifest.repartition(max(1, manifest.count())).mapInArrow(run, ", ".join(f"{x} long" for x in names))
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_DOC)))
