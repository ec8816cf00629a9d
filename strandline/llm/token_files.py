"""Token ids in files that training reads with random access.

Format: Arrow IPC streams in files. ``ids-SHARD-ATTEMPT.arrow`` has batches of two fixed-size-list columns,
``input_ids`` (uint16 where the vocabulary fits, else uint32) and ``mask`` (bool, one bit a position):
all sequences have the same length and all batches but the last the same number of rows, so sequence k
of a mapped file is row k mod rows of batch k div rows, without a copy. Documents follow one another in
ascending id order; each file's last sequence is filled up with masked zeros.
``docs-SHARD-ATTEMPT.arrow`` has the ids, starts (within the file) and lengths of the file's documents.

Nulls: a null text is an empty one (the end id alone), a null id sorts first. Long texts are written whole, over as many
sequences as they need. Repeated rows are written each on their own; ties in id are ordered by a hash of the text. An empty table
gives no files and no rows. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import slices
from .byte_bpe import tokenizer
from .shared import file_system, new_path, stored

LENGTH = 1024
ROWS = 256
#: Bytes of a shard's texts, or fewer.
SHARD = 128 << 20
TEXT = "_text_of_document"


def write(docs: DataFrame, path: str, folder: str, end_id: int = 2, length: int = LENGTH, rows: int = ROWS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Writes all documents under ``folder`` and returns the manifest: shard, name, docs, tokens (a row for each file).

    A shard is a range of ids (and of hashes of texts, where many rows share an id) of about ``SHARD`` bytes at most. An
    attempt of a task writes files with names of its own; the manifest has those of the attempts that count.
    """
    ordered = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string").alias(TEXT))
    size = ordered.agg(F.sum(F.octet_length(TEXT))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))
    tie = F.xxhash64(TEXT)
    ordered = ordered.repartitionByRange(n, F.col(f"`{id_col}`"), tie).sortWithinPartitions(F.col(f"`{id_col}`"), tie, TEXT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, context = tokenizer(path), TaskContext.get()
        dtype = np.dtype("<u2" if bpe.size <= 65_536 else "<u4")
        value = pa.from_numpy_dtype(dtype)
        schema = pa.schema([("input_ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        fs, root = file_system(folder)
        shard = context.partitionId()
        name = f"{shard:06d}-{context.taskAttemptId()}"
        held: list[np.ndarray] = []
        waiting, start = 0, 0
        ids_out, starts, sizes = [], [], []
        sink = writer = None

        def flush(last: bool) -> None:
            nonlocal held, waiting
            step = length * rows
            flat = np.concatenate(held) if held else np.empty(0, dtype)
            whole = len(flat) if last else len(flat) // step * step
            for a in range(0, whole, step):
                part = flat[a : min(a + step, whole)]
                lines = -(-len(part) // length)
                full = np.zeros(lines * length, dtype)
                full[: len(part)] = part
                mask = np.arange(lines * length) < len(part)
                columns = [pa.FixedSizeListArray.from_arrays(pa.array(v), length) for v in (full, mask)]
                writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema))
            held = [flat[whole:]] if whole < len(flat) else []
            waiting = len(flat) - whole

        for whole in batches:
            for batch in slices(whole, 1):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(f"{root}/ids-{name}.arrow")
                    writer = pa.ipc.new_stream(sink, schema)
                ids_out.append(batch.column(0))
                for t in batch.column(1).to_pylist():
                    ids = np.append(bpe.ids(t or ""), end_id).astype(dtype)
                    starts.append(start)
                    sizes.append(len(ids))
                    start += len(ids)
                    waiting += len(ids)
                    held.append(ids)
                    if waiting >= length * rows:
                        flush(False)
        if writer is None:
            return
        flush(True)
        writer.close()
        sink.close()
        table = pa.table([pa.chunked_array(ids_out), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], [id_col, "start", "n_tokens"])
        with fs.open_output_stream(f"{root}/docs-{name}.arrow") as out, pa.ipc.new_stream(out, table.schema) as stream:
            stream.write_table(table, max_chunksize=100_000)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([len(sizes)], pa.int64()), pa.array([start], pa.int64())], ["shard", "name", "docs", "tokens"])

    return stored(ordered.mapInArrow(run, "shard int, name string, docs long, tokens long"), "manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame, id_col: str = "doc_id", id_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """Reads the files back: id, start (ids of all documents before), n_tokens, ids_crc32 (and ids)."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    shards = manifest.select("name", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [id_col, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{root}/docs-{name}.arrow") as a, fs.open_input_file(f"{root}/ids-{name}.arrow") as b:
                    ids = _Ids(pa.ipc.open_stream(b))
                    for docs in pa.ipc.open_stream(a):
                        crc, values = [], []
                        for size in docs.column("n_tokens").to_pylist():
                            one, seen = 0, []
                            for part in ids.take(size):
                                one = zlib.crc32(part.astype("<u4").tobytes(), one)
                                if with_ids:
                                    seen += part.tolist()
                            crc.append(one)
                            values.append(seen)
                        start = pa.array(docs.column("start").to_numpy() + first)
                        cols = [docs.column(0), start, docs.column("n_tokens"), pa.array(crc, pa.int64())] + [pa.array(values, pa.list_(pa.int64()))] * with_ids
                        yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return shards.repartition(n, "name").mapInArrow(run, schema)


class _Ids:
    """The unmasked ids of a stream, batch by batch."""

    def __init__(self, stream):
        self.stream, self.flat, self.at = stream, np.empty(0, np.uint16), 0

    def take(self, n: int) -> Iterator[np.ndarray]:
        while n:
            if self.at == len(self.flat):
                batch = self.stream.read_next_batch()
                self.flat, self.at = batch.column(0).flatten().to_numpy(), 0
                mask = batch.column(1).flatten()
                if mask.true_count < len(mask):
                    self.flat = self.flat[: mask.true_count]
            part = self.flat[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            yield part


def sequence(path: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence k and its mask from a local file by mapping it, without reading what lies before."""
    batches = pa.ipc.open_stream(pa.memory_map(path)).read_all().to_batches()
    rows = batches[0].num_rows
    batch, row = batches[k // rows], k % rows
    return batch.column(0)[row].values.to_numpy(), batch.column(1)[row].values.to_numpy(zero_copy_only=False)


def write_and_read(docs: DataFrame, path: str, end_id: int = 2, text: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Writes to a fresh folder of the shared place and reads that back."""
    spark = docs.sparkSession
    folder = new_path(spark, "token-files")
    manifest = write(docs, path, folder, end_id, text=text, id_col=id_col)
    return read(spark, folder, manifest, id_col, docs.schema[id_col].dataType.simpleString(), with_ids)
