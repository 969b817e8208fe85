"""Files as rows: a listing, fingerprints of files of any size, and the schemas in Parquet footers, all read inside tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that a task holds at a time.
PIECE = 4 << 20
#: Files whose store Arrow can't open are read by Spark, each as one row, if they are not larger.
ONE_ROW = (1 << 31) - 1


def listing(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """file, n_bytes of every file under path that has any, at any depth; no content is read. Spark passes over empty files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("n_bytes"))


def dealt(files: DataFrame) -> DataFrame:
    """Files spread over the tasks, so that a task has few of them."""
    return files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 4), "file")


def opened(uri: str) -> tuple[pa.fs.FileSystem, str] | None:
    """The file system and path of a file for a task; None if Arrow knows no such store."""
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


def sha256_of(uri: str) -> str | None:
    """SHA-256 of a file, piece by piece; None if its store can't be opened here."""
    found = opened(uri)
    if found is None:
        return None
    chain = hashlib.sha256()
    with found[0].open_input_stream(found[1], buffer_size=0) as stream:
        while piece := stream.read(PIECE):
            chain.update(piece)
    return chain.hexdigest()


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """file, n_bytes, sha256 of the bytes of each file under path.

    A task streams its files and carries the state of the digest, so no row holds a file and memory doesn't follow its size.
    Only where Arrow can't open the store does Spark read the file as one row (an error over 2 GB)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sha256_of(f) for f in b.column("file").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("n_bytes"), pa.array(found, pa.string())], names=["file", "n_bytes", "sha256"])

    told = dealt(listing(spark, path)).mapInArrow(run, "file string, n_bytes bigint, sha256 string")
    if not path.split("://")[0].startswith(("viewfs", "abfs", "wasb")):
        return told
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("n_bytes"), F.when(F.col("length") <= ONE_ROW, F.sha2("content", 256)).alias("sha256"))


def footers(spark: SparkSession, path: str) -> DataFrame:
    """file, column, type of every column of every Parquet file under path: one footer a file, read in tasks, no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        for b in batches:
            rows = []
            for f in b.column("file").to_pylist():
                found = opened(f)
                if found is None:
                    raise ValueError(f"{f}: this store can't be opened in tasks")
                with found[0].open_input_file(found[1]) as source:
                    rows += [(f, c.name, c.dataType.simpleString()) for c in from_arrow_schema(pq.read_schema(source))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["file", "column", "type"])

    return dealt(listing(spark, path, "*.parquet")).mapInArrow(run, "file string, column string, type string")


def footer_differences(spark: SparkSession, path: str) -> DataFrame:
    """file, column, found, expected wherever a file's own columns or types are not those that most files have (of equally
    many, those of the smallest schema hash). Null stands for a column that is not there. No rows: one schema reads them all."""
    columns = footers(spark, path)
    schemas = columns.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("column", "type"))).alias("schema"))
    hashed = schemas.withColumn("h", F.sha2(F.to_json("schema"), 256))
    most = hashed.groupBy("h").agg(F.count("*").alias("n"), F.first("schema").alias("expected")).orderBy(F.desc("n"), "h").limit(1)
    off = hashed.join(F.broadcast(most.select(F.col("h").alias("_h"), "expected"))).filter("h <> _h")
    found = off.select("file", F.map_from_entries("schema").alias("a"), F.map_from_entries("expected").alias("b"))
    names = F.explode(F.array_union(F.map_keys("a"), F.map_keys("b")))
    return found.select("file", "a", "b", names.alias("column")).select("file", "column", F.try_element_at("a", F.col("column")).alias("found"), F.try_element_at("b", F.col("column")).alias("expected")).filter(~F.col("found").eqNullSafe(F.col("expected")))
