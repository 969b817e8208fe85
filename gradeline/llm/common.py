"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space ones.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. A folder of our own only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key with more than 1/HOT of all rows is hot (there are fewer than HOT of them); its rows are dealt to SALTS tasks.
HOT, SALTS = 200, 64


def join_copies(rows: DataFrame, table: DataFrame, key: str, copies: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """Join `rows` to a `table` of one row a key, whose column `copies` (left out) says how many rows have it.

    Rows of hot keys, and rows without a key, are dealt to many tasks; the list of hot keys is shorter than HOT, so it is
    broadcast. `table` is read more than once: give a checkpoint or files. A row's task follows from its place among the
    `rows`, so these must come in the same order when a lost executor's work is done again: from files or a checkpoint too.
    total: the sum of `copies`, if it is known.
    """
    total = table.agg(F.sum(copies)).first()[0] or 0 if total is None else total
    hot = F.broadcast(table.filter(F.col(copies) * HOT > total).select(key, F.lit(True).alias("_hot")))
    mine = F.when(F.col("_hot") | F.col(key).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.join(hot, key, "left").withColumn("_salt", mine).drop("_hot")
    wide = table.drop(copies).join(hot, key, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return dealt.join(wide, [key, "_salt"], how).drop("_salt")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small in this session, so that tasks and workers hold few texts at a time.

    Plans are run after an operator returns, so the setting stays; smaller ones of the session's own are kept."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= 1000:
        spark.conf.set(rows, 1000)
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)i?b?", spark.conf.get(size).lower()).groups()
    if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= 8 << 20:
        spark.conf.set(size, "8m")


def tidy() -> None:
    """Give memory that a worker no longer uses back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """The words as UTF-8; bytes.split() cuts at exactly the six characters of WORD_PATTERN."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_array(text: Column) -> Column:
    """The words of a text column as an array; empty for null and blank texts."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def held_out(doc_id: Column, divisor: int) -> Column:
    """Rows whose crc32 of the id as text leaves the remainder 2; never for a null id."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor == 2, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, for arrays of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of all runs of n words, from the words' hashes; empty if there are fewer than n."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.full(count, np.uint64(seed))
    for j in range(n):
        out = mix64(out + np.uint64(0x9E3779B97F4A7C15)) ^ words[j : j + count]
    return mix64(out)


#: Bytes that are white space between words, and the lower case of A-Z.
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: An odd multiplier, its inverse modulo 2^64, and how many bytes are hashed at a time.
_BASE, _SLICE = 0x9E3779B97F4A7C15, 1 << 18
_BACK = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64; at least n of them."""
    if len(_powers.get(base, ())) < n:
        rows = np.full(max(n, _SLICE), np.uint64(base))
        rows[0] = 1
        _powers[base] = np.multiply.accumulate(rows)
    return _powers[base]


def slices(column: pa.Array, size: int = 1 << 20) -> Iterator[pa.Array]:
    """The column in pieces of about `size` bytes (a longer text alone), so that work on one fits the processor's cache."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    k = 0
    while k < len(column):
        z = max(k + 1, int(np.searchsorted(at, at[k] + size, "right")) - 1)
        yield column.slice(k, z - k)
        k = z


class Words:
    """All words of an Arrow column of texts, without a Python object for each: where they lie and their 64-bit hashes.

    `first` has for each text the number of its first word, and the number of all words at the end. A null text has none.
    """

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        column = column.fill_null(b"") if column.null_count else column
        n = len(column)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]) if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
        at = at - at[0]
        inside = ~_SPACE[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        # words end with their text
        cut = at[(at > 0) & (at < len(self.data))]
        begins[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)

    def hashes(self, seed: int = 0, lower: bool = False) -> np.ndarray:
        """Polynomials of the words' bytes modulo 2^64, mixed; another seed gives independent values. lower: of A-Z lower-cased."""
        values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(2 * seed + 1))
        if lower:
            values = values[_LOWERED]
        out = np.empty(len(self.start), np.uint64)
        k = 0
        while k < len(out):
            low = self.start[k]
            z = max(k + 1, int(np.searchsorted(self.end, low + _SLICE, "right")))
            part = values[self.data[low : self.end[z - 1]]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * _power(_BASE, len(part))[: len(part)], out=sums[1:])
            a, b = self.start[k:z] - low, self.end[k:z] - low
            out[k:z] = (sums[b] - sums[a]) * _power(_BACK, len(part))[a]
            k = z
        return mix64(out ^ (self.end - self.start).astype(np.uint64))

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()
