"""Chunks of texts in the shared folder, and the exchange of their distinct keys.

``pack`` writes the rows of a table as compressed Arrow streams of a few MB of text each. An operator that needs something
global then works in three steps: every chunk sends its distinct keys to hash buckets (one blob for each chunk and bucket, so
that a key which stands everywhere is sent once a chunk and no bucket holds more than its share), every bucket answers each
blob in the order of its keys, and a cogroup by chunk brings the answers to the texts. Nothing of it passes the driver, and a
lost executor costs only its tasks: the chunks are files in the shared folder.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.kernels import tidy

#: Bytes of text in a chunk; a text is never split.
CHUNK_BYTES = 4 << 20
#: Bytes of text for each hash bucket; with it the number of buckets follows the input.
BUCKET_BYTES = 8 << 20
#: Rows of a chunk at most, so that chunk and place fit one long.
CHUNK_ROWS = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one that spark.checkpoint.dir names; it is deleted when the application ends.

    Only where driver and executors are one process may it be /tmp; a cluster without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = f"{(base or 'file:///tmp/textloom-checkpoints').rstrip('/')}/textloom-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return folder


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a shared folder; only for callers who have written all that reads from it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df, written to the shared folder and read again; this cuts its lineage."""
    df.write.parquet(f"{folder}/{name}", compression="none" if name.startswith("packed") else None)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def squeeze(raw: bytes) -> bytes:
    """raw, compressed, behind its length."""
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def expand(blob: bytes) -> bytes:
    return pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


def to_blob(rows: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9))) as out:
        out.write(rows)
    return sink.getvalue().to_pybytes()


def from_blob(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def pieces(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about so many bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
    part = (np.cumsum(size) - size) // limit
    cuts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else []
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
        for c in range(a, b, CHUNK_ROWS):
            yield batch.slice(c, min(b, c + CHUNK_ROWS) - c)


def chunks_of(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[int, pa.Table]]:
    """The rows of a task in chunks of about so many bytes of text, numbered over all tasks."""
    at = TaskContext.get().partitionId() << 20
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for piece in pieces(batch, text, limit // 4):
            held.append(piece)
            size += (pc.sum(pc.binary_length(piece.column(piece.schema.get_field_index(text)))).as_py() or 0) + 16 * piece.num_rows
            if size >= limit or sum(x.num_rows for x in held) >= CHUNK_ROWS // 2:
                yield at, pa.Table.from_batches(held).combine_chunks()
                at, size = at + 1, 0
                held.clear()
    if held:
        yield at, pa.Table.from_batches(held).combine_chunks()


class Chunks:
    """The rows of docs in numbered chunks.

    They are written to the shared folder once, as (chunk long, blob binary), and every pass reads them and their numbers from there:
    cut anew, the same number could mean other rows, as even file splits follow the cores that are registered at the moment. Rows of
    a relation are written when the first pass asks for them, any other at once. Where all passes are parts of one query
    (``one_query``), chunks of a relation are not written: all passes read the same exchange, whose rows keep their numbers.
    """

    def __init__(self, docs: DataFrame, folder: str, text: str = "text", limit: int = CHUNK_BYTES, one_query: bool = False):
        self.docs, self.folder, self.text, self.limit, self.one_query = docs, folder, text, limit, one_query
        self.written: DataFrame | None = None
        leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
        if not all("Relation" in leaves.apply(k).nodeName() for k in range(leaves.size())):
            self.one_query = False
            self.rows()

    def rows(self) -> DataFrame:
        """The chunks, written or exchanged by their numbers."""
        if self.written is None:
            self.written = self._packed().repartition("chunk") if self.one_query else table(self._packed(), self.folder, "packed")
        return self.written

    def _packed(self) -> DataFrame:
        text, limit = self.text, self.limit

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk, rows in chunks_of(batches, text, limit):
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([to_blob(rows)], pa.binary())], ["chunk", "blob"])
            tidy()

        return self.docs.mapInArrow(run, "chunk long, blob binary")

    def each(self, f: Callable[[int, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """f over every chunk, as (chunk, rows)."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, blob in zip(column(batch, "chunk"), batch.column(batch.schema.get_field_index("blob")), strict=True):
                    yield from f(chunk, from_blob(blob.as_buffer()))
                    tidy()

        return self.rows().mapInArrow(read, schema)

    def with_answers(self, answers: DataFrame, f: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """f over every chunk with its answers, as (chunk, rows, answers); a chunk without answers gets an empty table."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if left.num_rows != 1:
                raise RuntimeError("an answer came without its chunk")
            out = f(left.column("chunk")[0].as_py(), from_blob(left.column("blob")[0].as_buffer()), right)
            tidy()
            return out

        return self.rows().groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def answered(asked: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """f over the rows of every bucket."""

    def run(rows: pa.Table) -> pa.Table:
        out = f(rows)
        tidy()
        return out

    return asked.groupBy("bucket").applyInArrow(run, schema)


def bucket_count(docs: DataFrame, text: str = "text", each: int = BUCKET_BYTES) -> int:
    return max(4, math.ceil((docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) / each))


def by_bucket(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted distinct keys by bucket, and where each bucket begins (n + 1 places)."""
    bucket = (keys % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def column(rows: pa.RecordBatch | pa.Table, name: str) -> list:
    return rows.column(rows.schema.get_field_index(name)).to_pylist()
