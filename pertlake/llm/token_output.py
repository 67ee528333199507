"""Operator 2, token ids in Arrow stream files of equal-length sequences.

The corpus is one long id stream: documents in ascending doc_id order, each followed by
the end id. A shard file holds a contiguous range of documents as an Arrow IPC stream of
record batches with two fixed-size-list columns: ``ids`` and ``mask`` (false only in the
padding at a shard's end). All batches of a shard but its last have the same byte size, so
sequence i lies in batch i // BATCH_SEQUENCES at a computed byte place: a memory map gives
any sequence and its mask without copying. A second stream file holds the documents'
places. Files are written under attempt names and renamed, with the same content on every
attempt, so a lost executor leaves nothing wrong.

Defined results: a null or empty text has the end id only; rows with a null doc_id come
first; repeated doc_ids stay next to each other in the order of a hash of their texts, each a
document of its own; very long texts are whole; only the id and text columns are read; an empty
table gives no file and no rows. Ids are stored in 16 bits if the vocabulary allows it.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pertlake.llm.common import tokenizer_path
from pertlake.llm.encoding import worker_encoder
from pertlake.session import scratch_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
SEQUENCE = 2048
BATCH_SEQUENCES = 128

MANIFEST = (
    "shard int, first_id long, documents long, tokens long, ids_file string, docs_file string,"
    " first_batch long, batch_bytes long"
)
DOC_BATCH = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The shared folder's file system and the path inside it (any scheme Arrow knows)."""
    uri = re.sub(r"^file:/+", "/", uri)
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


class _Stream:
    """An Arrow stream file written under an attempt name and renamed when complete."""

    def __init__(self, fs: pafs.FileSystem, path: str, schema: pa.Schema):
        self._fs, self._path, self._part = fs, path, f"{path}.{uuid.uuid4().hex}.tmp"
        self._sink = fs.open_output_stream(self._part)
        self._writer = pa.ipc.new_stream(self._sink, schema)
        # byte places of the record batches: the first one follows the schema message
        self.places = [len(schema.serialize())]

    def write(self, batch: pa.RecordBatch) -> None:
        self._writer.write_batch(batch)
        self.places.append(self._sink.tell())

    def close(self) -> None:
        self._writer.close()
        self._sink.close()
        self._fs.move(self._part, self._path)


def sequence_schema(dtype: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(dtype, length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Packs an id stream into equal-length sequences, a record batch at a time."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype: pa.DataType, length: int):
        self._length, self._size = length, length * BATCH_SEQUENCES
        self._dtype = dtype
        self._np = dtype.to_pandas_dtype()
        self._buffer = np.empty(self._size, self._np)
        self._held = 0
        self._stream = _Stream(fs, path, sequence_schema(dtype, length))
        self.tokens = 0

    def add(self, ids: np.ndarray) -> None:
        self.tokens += len(ids)
        at = 0
        while at < len(ids):
            n = min(self._size - self._held, len(ids) - at)
            self._buffer[self._held : self._held + n] = ids[at : at + n]
            self._held += n
            at += n
            if self._held == self._size:
                self._flush()

    def _flush(self) -> None:
        rows = -(-self._held // self._length)
        self._buffer[self._held : rows * self._length] = 0
        mask = np.zeros(rows * self._length, bool)
        mask[: self._held] = True
        ids = pa.FixedSizeListArray.from_arrays(pa.array(self._buffer[: rows * self._length], self._dtype), self._length)
        masks = pa.FixedSizeListArray.from_arrays(pa.array(mask), self._length)
        self._stream.write(pa.record_batch([ids, masks], names=["ids", "mask"]))
        self._held = 0

    def close(self) -> tuple[int, int]:
        """(byte place of the first batch, bytes from one batch to the next)."""
        if self._held:
            self._flush()
        self._stream.close()
        p = self._stream.places
        return p[0], p[1] - p[0] if len(p) > 1 else 0


class ShardReader:
    """Random access to a shard's sequences, masks and token ranges."""

    def __init__(self, path: str, first_batch: int, batch_bytes: int):
        fs, inside = file_system(path)
        if isinstance(fs, pafs.LocalFileSystem):
            self._source = pa.memory_map(inside)
        else:
            self._source = fs.open_input_file(inside)
        self._schema = pa.ipc.read_schema(pa.ipc.read_message(self._source))
        self._length = self._schema.field("ids").type.list_size
        self._first, self._stride = first_batch, batch_bytes
        self._at: tuple[int, pa.RecordBatch] | None = None

    def batch(self, k: int) -> pa.RecordBatch:
        if self._at is None or self._at[0] != k:
            self._source.seek(self._first + k * self._stride)
            self._at = k, pa.ipc.read_record_batch(pa.ipc.read_message(self._source), self._schema)
        return self._at[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence i; the ids are a view of the file's bytes."""
        b = self.batch(i // BATCH_SEQUENCES)
        k = i % BATCH_SEQUENCES * self._length
        ids = b.column("ids").values.slice(k, self._length).to_numpy(zero_copy_only=True)
        return ids, self.mask(i).to_numpy(zero_copy_only=False)

    def mask(self, i: int) -> pa.BooleanArray:
        """The mask of sequence i, a view of the file's bits (one bit a token)."""
        return self.batch(i // BATCH_SEQUENCES).column("mask").values.slice(i % BATCH_SEQUENCES * self._length, self._length)

    def tokens(self, start: int, length: int) -> np.ndarray:
        """Ids start .. start + length of the shard's stream."""
        size, out = self._length * BATCH_SEQUENCES, []
        while length > 0:
            k, a = divmod(start, size)
            n = min(size - a, length)
            out.append(self.batch(k).column("ids").values.slice(a, n).to_numpy(zero_copy_only=True))
            start, length = start + n, length - n
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint32)

    def close(self) -> None:
        self._at = None
        self._source.close()


def write_tokens(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, keep_space: bool = True,
    sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encode and write ``docs`` under ``folder``; returns the manifest, one row per shard file."""
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True)
    dtype = pa.uint16() if max(known, end_id + 1) <= 1 << 16 else pa.uint32()
    fs, inside = file_system(folder)
    fs.create_dir(inside, recursive=True)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k = TaskContext.get().partitionId()
        fs, inside = file_system(folder)
        encoder = worker_encoder(vocabulary, keep_space)
        ids_file, docs_file = f"{folder}/shard-{k:06d}.ids.arrows", f"{folder}/shard-{k:06d}.docs.arrows"
        writer = places = None
        first, n, start = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                writer = ShardWriter(fs, f"{inside}/shard-{k:06d}.ids.arrows", dtype, sequence)
                places = _Stream(fs, f"{inside}/shard-{k:06d}.docs.arrows", DOC_BATCH)
                first = batch.column(0)[0].as_py()
            lengths = np.empty(batch.num_rows, np.int64)
            for row, ids in encoder.documents(batch.column(1), end_id):
                writer.add(ids)
                lengths[row] = len(ids)
            starts = start + np.cumsum(lengths) - lengths
            places.write(pa.record_batch([batch.column(0), pa.array(starts), pa.array(lengths)], schema=DOC_BATCH))
            start += int(lengths.sum())
            n += batch.num_rows
        if writer is not None:
            at, step = writer.close()
            places.close()
            rows = [k], [first], [n], [writer.tokens], [ids_file], [docs_file], [at], [step]
            yield pa.record_batch(
                [pa.array(x, t) for x, t in zip(rows, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                names=["shard", "first_id", "documents", "tokens", "ids_file", "docs_file", "first_batch", "batch_bytes"],
            )

    # equal and null ids have an order too, so every attempt writes the same, and many of them take several ranges
    order = ["doc_id", F.xxhash64("text"), "text"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    manifest = f"{folder}/manifest"
    ordered.mapInArrow(shard, MANIFEST).write.parquet(manifest)
    return docs.sparkSession.read.schema(MANIFEST).parquet(manifest)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the shard files.

    ``start`` needs the tokens of all earlier shards: a running sum over the manifest,
    which has one narrow row per shard.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))
    n = max(1, manifest.count())

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = ShardReader(row["ids_file"], row["first_batch"], row["batch_bytes"])
                fs, inside = file_system(row["docs_file"])
                with fs.open_input_stream(inside) as source, pa.ipc.open_stream(source) as places:
                    for part in places:
                        start, length = part.column(1).to_numpy(), part.column(2).to_numpy()
                        crc = np.fromiter(
                            (zlib.crc32(reader.tokens(int(a), int(m)).astype("<u4").tobytes()) for a, m in zip(start, length, strict=True)),
                            np.int64, len(start),
                        )
                        yield pa.record_batch(
                            [part.column(0), pa.array(start + row["base"]), part.column(2), pa.array(crc)],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                reader.close()

    return shards.repartition(n).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write and read back ``docs`` in a fresh folder of the shared scratch space."""
    return read_tokens(write_tokens(docs, scratch_path(spark, "op2-tokens"), tokenizer_path(spark, VOCABULARY)))
