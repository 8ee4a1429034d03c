"""Token ids in binary files: each id in as few bits as the vocabulary needs.

A file holds the ids of some documents in ascending id order, null ids first:

    magic "pkids001"
    blocks        BLOCK ids each, every id `bits` wide, lowest bit first; each block is whole bytes
    block_at      u64 per block and one more: where each block starts in the file
    doc_ids       i64 per document; has_id  u8 per document
    doc_ends      u64 per document: number of ids up to its end
    footer        u64: bits, BLOCK, documents, ids, where block_at starts; then the magic again

Any range of ids is read with the footer, two entries of block_at and the blocks it touches, which
numpy unpacks at once. Files are written by Spark tasks into a folder all tasks reach; a task that
runs again writes a file of another name. The manifest, a table beside the files, lists those of the
tasks that succeeded, with the number of ids in all files before.

Null text counts as empty; each document still has its end id. Documents with equal id are ordered
by a hash of their text. An empty table gives no file with documents.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relspark.llm.byte_pairs import encoder
from relspark.llm.rows import column, text_of
from relspark.llm.words import runs
from relspark.sources.stored import folder_of_application

MAGIC = b"pkids001"
BLOCK = 1 << 14
FOOTER = 5 * 8 + len(MAGIC)
END_ID = 2
#: Text encoded at once; what that takes for a while is a multiple of it, in every worker of an executor.
SLICE_BYTES = 1 << 19


def bits_for(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


_WHOLE = {8: "u1", 16: "<u2", 32: "<u4"}


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in _WHOLE:  # the same bits, without taking them apart
        return ids.astype(_WHOLE[bits]).tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(each[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(packed: bytes, bits: int, count: int) -> np.ndarray:
    if bits in _WHOLE:
        return np.frombuffer(packed, _WHOLE[bits], count).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little", count=bits * count)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = each.reshape(count, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def storage(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


class FileWriter:
    """Writes blocks as ids come; keeps at most one block and the document table."""

    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.rest = np.zeros(0, np.uint32)
        self.block_at, self.keys, self.has_key, self.sizes = [], [], [], []
        out.write(MAGIC)

    def _blocks(self, whole: np.ndarray) -> None:
        for i in range(0, len(whole), BLOCK):
            self.block_at.append(self.out.tell())
            self.out.write(pack(whole[i : i + BLOCK], self.bits))

    def add(self, keys: np.ndarray, has_key: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.keys.append(keys)
        self.has_key.append(has_key)
        self.sizes.append(sizes)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:whole])
        self.rest = ids[whole:]

    def close(self) -> tuple[int, int]:
        """(documents, ids)"""
        self._blocks(self.rest)
        table_at = self.out.tell()
        ends = np.cumsum(np.concatenate([np.zeros(0, np.int64), *self.sizes]))
        total = int(ends[-1]) if len(ends) else 0
        self.out.write(np.array([*self.block_at, table_at], "<u8").tobytes())
        self.out.write(np.concatenate([np.zeros(0, np.int64), *self.keys]).astype("<i8").tobytes())
        self.out.write(np.concatenate([np.zeros(0, bool), *self.has_key]).astype(np.uint8).tobytes())
        self.out.write(ends.astype("<u8").tobytes())
        footer = np.array([self.bits, BLOCK, len(ends), total, table_at], "<u8")
        self.out.write(footer.tobytes() + MAGIC)
        return len(ends), total


class FileReader:
    def __init__(self, source):
        self.source = source
        size = source.size()
        footer = source.read_at(FOOTER, size - FOOTER)
        if footer[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a file of packed ids, or not whole")
        numbers = np.frombuffer(footer[: -len(MAGIC)], "<u8").astype(int).tolist()
        self.bits, self.block, self.documents, self.ids, self.table_at = numbers
        self.blocks = -(-self.ids // self.block)

    def _table(self, before: int, count: int, kind: str) -> np.ndarray:
        return np.frombuffer(self.source.read_at(count * np.dtype(kind).itemsize, self.table_at + before), kind)

    def documents_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc ids, whether there is one, ends)"""
        at, n = (self.blocks + 1) * 8, self.documents
        return (
            self._table(at, n, "<i8"),
            self._table(at + 8 * n, n, "u1").astype(bool),
            self._table(at + 9 * n, n, "<u8").astype(np.int64),
        )

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start, ..., stop - 1 of the file; reads only the blocks that hold them."""
        stop = min(stop, self.ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        at = self._table(first * 8, last - first + 2, "<u8").astype(int)
        data = self.source.read_at(int(at[-1] - at[0]), int(at[0]))
        parts = []
        for k in range(first, last + 1):
            count = min(self.block, self.ids - k * self.block)
            low = at[k - first] - at[0]
            parts.append(unpack(data[low : at[k - first + 1] - at[0]], self.bits, count))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]


def write_ids(
    docs: DataFrame,
    folder: str,
    tokenizer_file: str,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Encode all texts, write the files below `folder`, and return their manifest.

    (part, path, documents, ids, start). One shuffle orders the texts by id; they are encoded behind
    it, so once. There are at most as many files as shuffle partitions.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, "rb") as file:
        definition = spark.sparkContext.broadcast(file.read())  # a fixed file of some MB
    bits = bits_for(max(encoder(definition.value).size, end_id + 1))
    rows = docs.select(
        column(docs, id_column).cast("long").alias("id"),
        text_of(docs, text_column).alias("text"),
        F.xxhash64(text_of(docs, text_column)).alias("place"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["id", "place", "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        system, base = storage(folder)
        system.create_dir(base, recursive=True)
        name = f"{base}/part-{part:05d}-{uuid.uuid4().hex}.ids"
        encode = encoder(definition.value).encode
        with system.open_output_stream(name) as out:
            writer = FileWriter(out, bits)
            for batch in batches:
                keys = batch["id"]
                for first, texts in runs(batch["text"], SLICE_BYTES):
                    ids, before = encode(texts)
                    sizes = np.diff(before)
                    ids = np.insert(ids, before[1:], end_id)
                    key = keys.slice(first, len(texts))
                    number = key.fill_null(0).to_numpy(zero_copy_only=False)
                    writer.add(number, key.is_valid().to_numpy(zero_copy_only=False), sizes + 1, ids)
            documents, count = writer.close()
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "name": [name.rpartition("/")[2]], "documents": [documents], "ids": [count]}
        )

    files = rows.mapInArrow(write, "part long, name string, documents long, ids long")
    files.write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder with the number of ids before each; one row per file."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    files = spark.read.parquet(f"{folder}/manifest")
    return files.select(
        "part",
        F.concat(F.lit(folder + "/"), "name").alias("path"),
        "documents",
        "ids",
        F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"),
    )


def read_ids(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, from the files.

    One task reads one file or a few; documents are read in ranges of about a million ids.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                system, name = storage(path)
                with system.open_input_file(name) as source:
                    yield from documents(FileReader(source), start)

    def documents(file: FileReader, start: int) -> Iterator[pa.RecordBatch]:
        keys, has_key, ends = file.documents_table()
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        group = ends // (1 << 20)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(ends)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            ids = file.read(int(begins[a]), int(ends[b - 1]))
            each = [ids[x:y] for x, y in zip(begins[a:b] - begins[a], ends[a:b] - begins[a], strict=True)]
            columns = [
                pa.array(keys[a:b], mask=~has_key[a:b]),
                pa.array(begins[a:b] + start),
                pa.array(ends[a:b] - begins[a:b]),
                pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    spread = files.select("path", "start").repartition("path")
    ids = ", ids array<long>" if with_ids else ""
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ids)


def new_folder(spark: SparkSession) -> str:
    """Among the application's, so that it goes with them (or with the open run)."""
    return f"{folder_of_application(spark)}/ids-{uuid.uuid4().hex}"
