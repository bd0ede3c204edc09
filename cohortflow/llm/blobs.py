"""Chunks of documents and the compressed arrays that chunks and shards exchange.

A chunk is some megabytes of documents in one row. Operators that ask something about very many short strings (windows, word pairs)
let each chunk send its distinct ones to shards by hash, as sorted compressed arrays; a shard answers each chunk in the
order asked. Number and size of such rows follow the text, whatever one string's frequency.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

CHUNK_BYTES = 2 * 1024 * 1024  # compressed, a row stays far below what the JVM allocates apart
CHUNK_SCHEMA = "chunk long, lengths binary, text binary, rest binary"


def small_batches(spark: SparkSession) -> None:
    """Rows here are megabytes: let a batch for Python hold few of them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 * 1024 * 1024))


def squeeze(*values) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(values, protocol=5))


def unsqueeze(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def by_planes(values: np.ndarray) -> np.ndarray:
    """The bytes of an integer array, all lowest bytes first: compresses well where high bytes are alike."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)


def from_planes(planes: np.ndarray, dtype) -> np.ndarray:
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def chunks(docs: DataFrame, text_col: str = "text", size: int = CHUNK_BYTES) -> DataFrame:
    """The rows of docs in chunks of about `size` bytes of text: UTF-8 lengths, texts joined, other columns as an Arrow table."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0

        def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal made
            table = pa.Table.from_batches(held)
            at = table.schema.get_field_index(text_col)
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in table.column(at).to_pylist()]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema.remove(at)) as out:
                out.write_table(table.remove_column(at))
            chunk = (part << 32) + made
            made += 1
            lengths = np.array([len(t) for t in texts], dtype="<i8")
            blob = zstandard.ZstdCompressor(level=1)
            return pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([chunk], pa.int64()),
                    "lengths": pa.array([squeeze(lengths)], pa.binary()),
                    "text": pa.array([blob.compress(b"".join(texts))], pa.binary()),
                    "rest": pa.array([blob.compress(sink.getvalue().to_pybytes())], pa.binary()),
                }
            )

        held, bytes_held = [], 0
        for batch in batches:
            lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0))
            start, total = 0, 0
            for i, n in enumerate(lengths.tolist()):
                total += n
                if bytes_held + total >= size:
                    held.append(batch.slice(start, i + 1 - start))
                    yield row(held)
                    held, bytes_held, start, total = [], 0, i + 1, 0
            if start < batch.num_rows:
                held.append(batch.slice(start))
                bytes_held += total
        if held:
            yield row(held)

    return docs.mapInArrow(build, CHUNK_SCHEMA)


def chunk_lengths(blob: bytes) -> np.ndarray:
    return unsqueeze(blob)[0]


def chunk_text(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def chunk_rest(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()


def gathered(answers: DataFrame, name: str) -> DataFrame:
    """One row per chunk with the shards' answers to it as a list of (shard, answer)."""
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("shard", "answer")).alias(name))


def shard_bits(n_bytes: int, per_shard: int = 4 * 1024 * 1024, least: int = 5) -> int:
    """log2 of the number of shards that get about per_shard bytes of text each."""
    return max(least, int(np.ceil(np.log2(max(1, n_bytes / per_shard)))))
