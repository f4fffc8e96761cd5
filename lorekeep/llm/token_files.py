"""Token ids in binary files, each id in the fewest bits that hold the vocabulary.

A file holds whole documents in ascending id order: ids in blocks of 4096 packed at a fixed width, then a footer with the
documents' ids and starts and each block's place, so that any span of ids is read by its blocks alone and unpacked as
numpy arrays. Partitions are ranges of doc_id, so the files are in order too. A task names its files anew each time it
runs and only the names that its committed output lists are read, so lost executors and repeated tasks do no harm.

Defined cases: null text is empty text, so its only id is the end; null doc_ids come last; repeated rows are written each;
rows that tie in their id go by their text; a very long text is a file's last document, whatever its length; an empty table
gives no document; only the id and text columns are read.
"""

from __future__ import annotations

import array
import io
import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_folder, table, written
from .tokens import default_tokenizer, encoder

MAGIC = b"LKIDS001"
FOOTER = struct.Struct("<IIQQQ8s")  # bits, ids in a block, documents, ids, where the footer's arrays begin, magic
BLOCK = 4096
END = 2
#: A new file is begun after so many ids or documents.
FILE_IDS, FILE_DOCS = 1 << 25, 1 << 20
#: Ids that a reader unpacks at once, but for a longer document; and rows that it returns at once.
READ_IDS, READ_ROWS = 1 << 21, 1 << 14


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Least significant bits first. Widths of whole machine words are that same layout and copied."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each, bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)])
    at = np.arange(n, dtype=np.int64) * bits
    first, out = at >> 3, np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        out |= raw[first + k].astype(np.uint64) << np.uint64(8 * k)
    return ((out >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


class Writer:
    def __init__(self, out: io.RawIOBase, bits: int):
        self.out, self.bits, self.rest, self.ids, self.at = out, bits, np.zeros(0, "<u4"), 0, 0
        self.docs, self.named, self.starts, self.blocks = array.array("q"), bytearray(), array.array("Q"), array.array("Q")

    def _put(self, ids: np.ndarray) -> None:
        for i in range(0, len(ids), BLOCK):
            self.blocks.append(self.at)
            self.at += self.out.write(pack(ids[i : i + BLOCK], self.bits))

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc or 0)
        self.named.append(doc is not None)
        self.starts.append(self.ids)
        self.ids += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // BLOCK * BLOCK
        self._put(self.rest[:whole])
        self.rest = self.rest[whole:]

    def close(self) -> None:
        self._put(self.rest)
        self.starts.append(self.ids)
        self.blocks.append(self.at)
        for numbers, kind in ((self.docs, "<i8"), (self.named, "u1"), (self.starts, "<u8"), (self.blocks, "<u8")):
            self.out.write(np.asarray(numbers).astype(kind).tobytes())
        self.out.write(FOOTER.pack(self.bits, BLOCK, len(self.docs), self.ids, self.at, MAGIC))
        self.out.close()


class Reader:
    """Random access to a file's ids and documents."""

    def __init__(self, file: pa.NativeFile):
        size = file.size()
        file.seek(size - FOOTER.size)
        self.file = file
        self.bits, self.block, docs, self.n, at, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("this is no file of token ids")
        file.seek(at)
        rest = file.read(size - FOOTER.size - at)
        self.docs = np.frombuffer(rest, "<i8", docs)
        self.named = np.frombuffer(rest, np.uint8, docs, 8 * docs)
        self.starts = np.frombuffer(rest, "<u8", docs + 1, 9 * docs).astype(np.int64)
        self.blocks = np.frombuffer(rest, "<u8", -1, 17 * docs + 8).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Those from start to before stop, from their blocks alone."""
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block + 1
        self.file.seek(int(self.blocks[first]))
        data = self.file.read(int(self.blocks[last] - self.blocks[first]))
        n = min(last * self.block, self.n) - first * self.block
        return unpack(data, n, self.bits)[start - first * self.block : stop - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Each document's id, start and ids, read many at a time."""
        i, n = 0, len(self.docs)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + READ_IDS, "right")) - 1)
            some = self.ids(int(self.starts[i]), int(self.starts[j]))
            for k in range(i, j):
                at = self.starts[k] - self.starts[i]
                yield int(self.docs[k]) if self.named[k] else None, int(self.starts[k]), some[at : at + self.starts[k + 1] - self.starts[k]]
            i = j


def _store(folder: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_files(docs: DataFrame, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """Writes all documents' ids; returns part, file (in order within the part), path, n_docs and n_tokens of each file."""
    tokenizer = tokenizer or default_tokenizer()
    folder = new_folder(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        bits, last = bits_for(encode.vocabulary), np.array([end], "<u4").tobytes()
        store, place = _store(folder)
        store.create_dir(place, recursive=True)
        out, made = None, []

        def done() -> None:
            out.close()
            made.append((part, len(made), f"{folder}/{name}", len(out.docs), out.ids))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    name = f"{part:06d}-{uuid.uuid4().hex}.ids"
                    out = Writer(store.open_output_stream(f"{place}/{name}"), bits)
                out.add(doc, np.frombuffer(encode.encode(text.as_py()) + last, "<u4"))
                if out.ids >= FILE_IDS or len(out.docs) >= FILE_DOCS:
                    done()
                    out = None
        if out is not None:
            done()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in made], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
            ["part", "file", "path", "n_docs", "n_tokens"],
        )

    by = F.col("doc_id").asc_nulls_last()
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(by).sortWithinPartitions(by, "text")
    return written(rows.mapInArrow(run, "part int, file int, path string, n_docs long, n_tokens long"))


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files."""
    # one row for each partition of the writer, then for each of its files
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("_ids"))
    earlier = lambda within, by: Window.partitionBy(within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("_ids").over(earlier(F.lit(0), "part")), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("n_tokens").over(earlier("part", "file")), F.lit(0))
    files = files.withColumn("_within", within).join(parts, F.col("part") == F.col("_part")).withColumn("start", F.col("_before") + F.col("_within"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, place = _store(path)
                with store.open_input_file(place) as file:
                    rows = ((doc, start + at, len(ids), zlib.crc32(ids)) for doc, at, ids in Reader(file).documents())
                    while some := list(itertools.islice(rows, READ_ROWS)):
                        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = files.select("path", "start").repartition(F.col("path"))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(write_files(table(spark, sf_dir, "documents")))
