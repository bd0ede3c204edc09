"""Token ids in ORC files: run-length encoded integers, row indexes and Bloom filters on the document id.

Documents are range-partitioned and sorted by id, so file order is id order, the row index of each stripe brackets a narrow
id range and a lookup skips nearly all stripes by metadata alone. Readers split files by stripe.

Defined cases: a null text is the empty text and holds the end id only; a null id sorts first; rows that repeat an id are
kept, in any order among themselves; an empty table gives files without rows; extra columns are not written.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import ensure_checkpoint_dir
from .tokens import TOKENIZER, encoder

END_ID = 0
SCHEMA = "part int, pos long, doc_id long, n_tokens long, ids array<int>"
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 * 1024 * 1024),
}
END = np.array([END_ID], dtype="<u4").tobytes()


def _encode_batches(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos = TaskContext.get().partitionId(), 0
        for batch in batches:
            raw = [ids + END for ids in encoder(file).encode(batch.column("text").to_pylist())]
            lengths = np.array([len(r) // 4 for r in raw], dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(raw))])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(raw), part, np.int32)),
                    pa.array(np.arange(pos, pos + len(raw), dtype=np.int64)),
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(lengths),
                    pa.ListArray.from_arrays(pa.array(offsets), values),
                ],
                names=["part", "pos", "doc_id", "n_tokens", "ids"],
            )
            pos += len(raw)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER) -> str:
    """Encode every text and write the ids under path in ascending id order."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_encode_batches(tokenizer), SCHEMA).write.options(**ORC_OPTIONS).orc(path)
    return path


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The written rows; with doc_ids the filter reaches the stripe statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<i4", copy=False)).cast("B")
        edges = ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(edges[:-1], edges[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("part"), batch.column("pos"), batch.column("doc_id"), pa.array(np.diff(edges).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["part", "pos", "doc_id", "n_tokens", "ids_crc32"],
        )


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: start counts the ids of all rows before."""
    rows = read_tokens(spark, path).mapInArrow(_checksums, "part int, pos long, doc_id long, n_tokens long, ids_crc32 long")
    totals = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # one row per written file; the prefix sum over files needs no more
    starts = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(starts, "part").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
