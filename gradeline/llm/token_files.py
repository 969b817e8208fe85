"""Token-id output: Arrow stream files of fixed-size-list batches, with zero-copy random access to equal-length sequences."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.llm.common import shared_dir, small_batches, tidy
from gradeline.llm.tokens import default_path, encoder

#: Ids of a sequence and sequences of a record batch. All batches of a file but the last have as many.
SEQUENCE, BATCH = 2048, 64


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _schema(ids: pa.DataType, sequence: int) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(pa.field("item", ids, False), sequence), False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), False), sequence), False)], metadata={"sequence": str(sequence), "batch": str(BATCH)})


class TokenFile:
    """Random access to a file of sequences. Local files are memory-mapped: ids and masks are views of the map."""

    def __init__(self, uri: str):
        from pyarrow import fs

        where, path = _open(uri)
        self.source = pa.memory_map(path) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.sequence_length = int(self.reader.schema.metadata[b"sequence"])
        self.batch_size = int(self.reader.schema.metadata[b"batch"])
        self.at, self.batch = -1, None

    def _batch(self, k: int) -> pa.RecordBatch:
        if k != self.at:
            self.at, self.batch = k, self.reader.get_batch(k)
        return self.batch

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of the k-th sequence."""
        b = self._batch(k // self.batch_size)
        at = k % self.batch_size
        n = self.sequence_length
        return b.column("ids").flatten().to_numpy(zero_copy_only=True)[at * n : (at + 1) * n], b.column("mask").flatten()[at * n : (at + 1) * n]

    def span(self, start: int, length: int) -> Iterator[np.ndarray]:
        """The ids start, start+1, ... in views of one batch each."""
        per = self.batch_size * self.sequence_length
        while length > 0:
            ids = self._batch(start // per).column("ids").flatten().to_numpy(zero_copy_only=True)
            part = ids[start % per : start % per + length]
            yield part
            start, length = start + len(part), length - len(part)

    def close(self) -> None:
        self.at, self.batch, self.reader = -1, None, None
        self.source.close()


@dataclass
class _Writer:
    """Cuts a stream of ids into sequences and batches; the last sequence is filled with 0 and masked."""

    out: pa.ipc.RecordBatchFileWriter
    schema: pa.Schema
    sequence: int
    dtype: np.dtype

    def __post_init__(self):
        self.held: list[np.ndarray] = []
        self.size = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= BATCH * self.sequence:
            self.flush(False)

    def flush(self, last: bool) -> None:
        flat, per = np.concatenate([np.empty(0, self.dtype), *self.held]), BATCH * self.sequence
        while len(flat) >= per or (last and len(flat)):
            part, flat = flat[:per], flat[per:]
            rows = -(-len(part) // self.sequence)
            full = np.zeros(rows * self.sequence, self.dtype)
            full[: len(part)] = part
            mask = np.arange(len(full)) < len(part)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), type=self.schema.field(n).type) for n, v in (("ids", full), ("mask", mask))]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.held, self.size = [flat], len(flat)


def write_token_files(docs: DataFrame, folder: str | None = None, end_id: int = 2, tokenizer: str | None = None, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Write all documents' ids in ascending id order (null first; equal ids by a hash of the text, then the text) and return
    the manifest.

    Each document is the ids of its whole text and `end_id`; a null text is the end id alone. Rows are dealt to tasks by
    ranges of (id, hash), and equal rows of any number to as many tasks as they need. Repeated rows are written as often as
    they come; an empty table gives an empty manifest; other columns, whatever their names, don't matter. A task writes one file of sequences and one of its documents' places (`id_col`, start, n_tokens);
    the files go to a folder that all machines share, under a name of the attempt's own until they are whole, so that a
    repeated task does no harm. The manifest has a row per file, in order: path, index, n_docs, n_tokens, start.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer or default_path()
    folder = folder or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    where, base = _open(folder)
    where.create_dir(base, recursive=True)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    own = own.withColumns({"_hash": F.xxhash64("_text"), "_row": F.monotonically_increasing_id()})
    order = [F.col("_id").asc_nulls_first(), F.col("_hash")]
    # the row's number only cuts runs of equal rows: which of them comes first shows nowhere
    ordered = own.repartitionByRange(*order, F.col("_row")).sortWithinPartitions(*order, F.col("_text").asc_nulls_first()).select("_id", "_text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number, attempt = context.partitionId(), context.taskAttemptId()
        fs_, root = _open(folder)
        enc = encoder(path)
        schema = _schema(pa.from_numpy_dtype(enc.dtype), sequence)
        names = [f"{root}/{kind}-{number:06d}.arrow" for kind in ("ids", "index")]
        drafts = [f"{n}.{attempt}" for n in names]
        n_docs = total = 0
        index = writer = None
        with fs_.open_output_stream(drafts[0]) as sink, pa.ipc.new_file(sink, schema) as out, fs_.open_output_stream(drafts[1]) as places:
            writer = _Writer(out, schema, sequence, enc.dtype)
            for b in batches:
                if index is None:
                    index = pa.ipc.new_file(places, index_schema(b, id_col))
                ids, at = enc.encode_ended(b.column("_text"), end_id)
                start, n = writer.total + at[:-1], np.diff(at)
                writer.add(ids)
                index.write_batch(pa.RecordBatch.from_arrays([b.column("_id"), pa.array(start, pa.int64()), pa.array(n, pa.int64())], schema=index_schema(b, id_col)))
                n_docs += b.num_rows
            writer.flush(True)
            total = writer.total
            if index is not None:
                index.close()
        tidy()
        if not n_docs:
            for d in drafts:
                fs_.delete_file(d)
            return
        for d, n in zip(drafts, names, strict=True):
            fs_.move(d, n)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([n_docs], pa.int64()), pa.array([total], pa.int64())], names=["number", "n_docs", "n_tokens"])

    done = sorted(ordered.mapInArrow(write, "number bigint, n_docs bigint, n_tokens bigint").collect())
    start, manifest = 0, []
    for r in done:
        manifest.append({"path": f"{folder}/ids-{r.number:06d}.arrow", "index": f"{folder}/index-{r.number:06d}.arrow", "n_docs": r.n_docs, "n_tokens": r.n_tokens, "start": start})
        start += r.n_tokens
    return manifest


def index_schema(batch: pa.RecordBatch, id_col: str) -> pa.Schema:
    return pa.schema([pa.field(id_col, batch.schema.field("_id").type), pa.field("start", pa.int64()), pa.field("n_tokens", pa.int64())])


def read_token_files(spark: SparkSession, manifest: list[dict], id_type: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """From the files, per document: `id_col`, start (ids of all documents before it), n_tokens and ids_crc32. One task per file.

    Null ids, repeated rows and empty texts come back as they were written; no files give no rows."""
    if not manifest:
        return spark.createDataFrame([], f"`{id_col}` {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")
    rows = spark.createDataFrame([(m["path"], m["index"], m["start"]) for m in manifest], "path string, index string, base bigint").repartition(len(manifest), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, index, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tokens = TokenFile(path)
                fs_, at = _open(index)
                with fs_.open_input_file(at) as f:
                    places = pa.ipc.open_file(f)
                    for k in range(places.num_record_batches):
                        p = places.get_batch(k)
                        crc = []
                        for s, n in zip(p.column("start").to_pylist(), p.column("n_tokens").to_pylist(), strict=True):
                            value = 0
                            for part in tokens.span(s, n):
                                value = zlib.crc32(part.astype("<u4").tobytes(), value)
                            crc.append(value)
                        starts = pa.array(p.column("start").to_numpy() + base)
                        yield pa.RecordBatch.from_arrays([p.column(0), starts, p.column("n_tokens"), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])
                tokens.close()

    return rows.mapInArrow(read, f"`{id_col}` {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")
