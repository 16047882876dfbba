"""Token ids as independent zstandard frames with a trailing seek table.

A file holds one frame for each document (its ids as little-endian unsigned 32-bit integers), then a skippable frame
with the documents' ids, then the seek table of the public zstandard seekable format: compressed size, size
and checksum (low half of XXH64) of every frame. A reader takes the tail first and then only the frames
it wants; each is checked when it is read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandwork.session import materialize, scratch, ship_package, small_arrow_batches

from .tokens import encoder, groups, vocabulary

# fixed values of the public format
SEEK_MAGIC = 0x8F92EAB1
TABLE_MAGIC = 0x184D2A5E
IDS_MAGIC = 0x184D2A50
CHECKSUM_FLAG = 0x80
FOOTER = struct.Struct("<IBI")

FILE_BYTES = 48 << 20  # of text for each file, about
MANIFEST = "name string, first_doc long, n_docs long, n_tokens long"


def _open_dir(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Writer:
    """Append frames; ``close`` writes the ids and the seek table."""

    def __init__(self, sink) -> None:
        import xxhash
        import zstandard

        self.sink, self.pack, self.hash = sink, zstandard.ZstdCompressor(level=1), xxhash.xxh64_intdigest
        self.docs: list[int] = []
        self.entries: list[bytes] = []

    def add(self, doc_id: int, raw: bytes) -> None:
        frame = self.pack.compress(raw)
        self.sink.write(frame)
        self.docs.append(doc_id)
        self.entries.append(struct.pack("<III", len(frame), len(raw), self.hash(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        ids = np.array(self.docs, "<i8").tobytes()
        self.sink.write(struct.pack("<II", IDS_MAGIC, len(ids)) + ids)
        self.entries.append(struct.pack("<III", 8 + len(ids), 0, self.hash(b"") & 0xFFFFFFFF))
        table = b"".join(self.entries) + FOOTER.pack(len(self.entries), CHECKSUM_FLAG, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)


class Reader:
    """Documents of one file by place or by doc_id; only the frames asked for are read and decompressed."""

    def __init__(self, source) -> None:
        import xxhash
        import zstandard

        self.source, self.unpack, self.hash = source, zstandard.ZstdDecompressor(), xxhash.xxh64_intdigest
        size = source.size()
        source.seek(size - FOOTER.size)
        n, flags, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != SEEK_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end")
        source.seek(size - FOOTER.size - 12 * n)
        table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3)
        self.packed, self.raw, self.sums = (table[:, k].astype(np.int64) for k in range(3))
        self.at = np.cumsum(self.packed) - self.packed
        source.seek(int(self.at[-1]) + 8)
        self.docs = np.frombuffer(source.read(int(self.packed[-1]) - 8), "<i8")

    def __len__(self) -> int:
        return len(self.docs)

    def ids(self, k: int) -> np.ndarray:
        """Token ids of the document at place k of the file."""
        self.source.seek(int(self.at[k]))
        raw = self.unpack.decompress(self.source.read(int(self.packed[k])), max_output_size=int(self.raw[k]))
        if len(raw) != self.raw[k] or self.hash(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Token ids of every document with that doc_id; doc_ids ascend within a file."""
        a, b = np.searchsorted(self.docs, doc_id, "left"), np.searchsorted(self.docs, doc_id, "right")
        return [self.ids(k) for k in range(a, b)]


def write_tokens(docs: DataFrame, uri: str, vocab: str, end_id: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of all texts below ``uri`` in ascending doc_id order; returns the manifest.

    Null texts are empty (only the end id); rows without doc_id are left out; rows of repeated doc_ids are
    all written, by text; an empty table gives no file; other columns aren't read. Every attempt of a task writes a file of
    its own name, and the manifest, which is written once, names those that count; the others are deleted in the
    end, those of an earlier call with the same ``uri`` too. A name begins with the file's number, so names ascend as doc_ids do.
    """
    spark = docs.sparkSession
    ship_package(spark)
    small_arrow_batches(spark)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // file_bytes), min(spark.sparkContext.defaultParallelism, total >> 20))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tokens, writer, fs, n_tokens = encoder(vocab), None, None, 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in groups(texts):
                if writer is None:
                    fs, folder = _open_dir(uri)
                    fs.create_dir(folder, recursive=True)
                    name = f"part-{part:010d}-{uuid.uuid4().hex}.zst"
                    sink = fs.open_output_stream(f"{folder}/{name}", compression=None)  # as it is, whatever the name ends with
                    writer = Writer(sink)
                flat, size = tokens.encode(texts[a:b])
                at = 0
                for i, k in zip(ids[a:b], size.tolist()):
                    writer.add(i, flat[at : at + k].astype("<u4").tobytes() + end)
                    at += k
                n_tokens += at + b - a
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "first_doc": pa.array([writer.docs[0]], pa.int64()), "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())})

    manifest = materialize(rows.mapInArrow(write, MANIFEST), "manifest")
    _delete_others(uri, manifest)
    return manifest


def _delete_others(uri: str, manifest: DataFrame) -> None:
    """Delete the files below ``uri`` that the manifest doesn't name: attempts that failed or were overtaken."""
    fs, folder = _open_dir(uri)
    there = {f.base_name for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.base_name.startswith("part-")}
    for name in there - {r[0] for r in manifest.select("name").toLocalIterator()}:  # a name a file
        fs.delete_file(f"{folder}/{name}")


def read_tokens(spark: SparkSession, uri: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files, a task for each file."""
    ship_package(spark)
    # one row for each file; ranges of doc_ids ascend with the files' numbers
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files = files.repartition(max(1, manifest.count()))  # a task for each file, which adaptive execution leaves alone

    def read(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, folder = _open_dir(uri)
                with fs.open_input_file(f"{folder}/{name}") as source:
                    r = Reader(source)
                    size, crc = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
                    for k in range(len(r)):
                        raw = r.ids(k)
                        size[k], crc[k] = len(raw), zlib.crc32(raw.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(r.docs), pa.array(start + np.cumsum(size) - size), pa.array(size), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("name", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_round_trip(docs: DataFrame, vocab: str | None = None, end_id: int = 2) -> DataFrame:
    """Write all texts, then read the files back."""
    spark = docs.sparkSession
    uri = scratch(spark, "tokens")
    manifest = write_tokens(docs, uri, vocab or vocabulary("byte_bpe_50k.json"), end_id)
    return read_tokens(spark, uri, manifest)
