"""Exact dedup against a persistent index of digests, in buckets and sorted by hash."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.llm.common import cut, join_copies, shared_dir, small_batches
from gradeline.operators.versions import Versions

#: A new index merges its segments into one when there are more.
MOST_SEGMENTS = 16


class DigestIndex:
    """Digests of all texts seen so far, in a folder that all machines share.

    Each load is a segment: Parquet files in buckets of `digest`, sorted by it, one file a bucket and segment, so a
    sort-merge join with it moves only the other side. A numbered manifest lists the segments; a load is in the index when
    its manifest is there, and half-written segments are never read. Of two writers at once one gets `VersionTaken`.

    Columns: digest; keep_id and keep_row (which row stays; null in a segment that only counts further copies of digests
    that were there before), copies (rows of the load that have the digest).
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        """Opens the index in `folder`, or begins one of so many buckets there (default: the session's shuffle partitions)."""
        self.spark, self.folder, self.versions = spark, folder.rstrip("/"), Versions(spark, f"{folder.rstrip('/')}/versions")
        # the scan of one sorted file a bucket needs no sort
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self.version, manifest = self.versions.latest()
        self.segments: list[str] = manifest.get("segments", [])
        self.buckets: int = manifest.get("buckets", buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.id_type: str | None = manifest.get("id_type")

    def _table(self, folder: str) -> DataFrame:
        """The rows of a segment, with Spark knowing their buckets; the catalog's entry that tells them goes at once."""
        name = f"digests_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (digest BINARY, keep_id {self.id_type}, keep_row BIGINT, copies BIGINT) USING parquet OPTIONS (path '{folder}') CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS")
        table = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return table

    def _written(self, rows: DataFrame) -> str:
        folder, name = f"segment-{uuid.uuid4().hex}", f"digests_{uuid.uuid4().hex}"
        placed = rows.select("digest", "keep_id", "keep_row", "copies").repartition(self.buckets, "digest")
        placed.write.bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.folder}/{folder}").format("parquet").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        return folder

    def tables(self) -> list[DataFrame]:
        return [self._table(f"{self.folder}/{s}") for s in self.segments]

    def _publish(self, segments: list[str]) -> None:
        self.version = self.versions.publish(self.version, {"segments": segments, "buckets": self.buckets, "id_type": self.id_type})
        self.segments = segments

    def add(self, groups: DataFrame) -> DataFrame:
        """Load one row per digest (digest, keep_id, keep_row, copies): those that the index doesn't have are appended, of
        the others only the copies. Returns the appended ones, which a sort-merge anti-join with each segment finds.

        An empty load changes nothing but the version. Ids have one type in an index."""
        kind = groups.schema["keep_id"].dataType.simpleString()
        if self.id_type not in (None, kind):
            raise ValueError(f"ids are {kind}, the index has {self.id_type}")
        self.id_type = kind
        new = self._table(f"{self.folder}/{self._written(groups)}")
        fresh = new
        for table in self.tables():
            fresh = fresh.join(table.select("digest").hint("merge"), "digest", "left_anti")
        appended = self._written(fresh)
        added = self._table(f"{self.folder}/{appended}")
        # copies of digests that were there before
        known = new.join(added.select("digest").hint("merge"), "digest", "left_anti").withColumns({"keep_id": F.lit(None).cast(kind), "keep_row": F.lit(None).cast("long")})
        segments = [*self.segments, appended, *([self._written(known)] if self.segments else [])]
        self._publish(segments)
        if len(segments) > MOST_SEGMENTS:
            self._publish([self._written(self.found())])
        return added

    def next_row(self) -> int:
        """A number above all keep_row of the index."""
        return max([-1, *(t.agg(F.max("keep_row")).first()[0] or -1 for t in self.tables())]) + 1

    def found(self) -> DataFrame:
        """One row per digest of the index: digest, keep_id, keep_row and the copies of all loads."""
        # Spark 4.1 takes a union of bucketed scans for one that keeps equal digests together, which it does not; an
        # expression hides the buckets, so that the rows are dealt anew
        rows = [t.withColumn("digest", F.concat("digest", F.lit(b""))) for t in self.tables()]
        every = rows[0]
        for r in rows[1:]:
            every = every.unionAll(r)
        return every.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("keep_row").alias("keep_row"), F.sum("copies").alias("copies"))


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, digest): SHA-256 of the whole text with A-Z lower-cased and nothing else changed, a null text as an empty one."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # bytes.lower() changes A-Z only
            found = [hashlib.sha256((t.as_py() or b"").lower()).digest() for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(found, pa.binary())], names=["_id", "digest"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, f"_id {kind}, digest binary")


def exact_groups(docs: DataFrame, index: DigestIndex | None = None, loads: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, dropped ones too: its id, keep_id (id of the row of equal text that stays), group_size, kept and
    digest. Equal are texts that are the same bytes after lower-casing A-Z; null counts as empty.

    The documents go into the index in loads of descending ids, so that of equal texts the largest id stays; a row that an
    index given had before stays instead (then no row here is kept, and keep_id is the earlier one's). Ties: of rows with the
    same text and id exactly one is kept; a null id is smaller than any other. An empty table gives an empty result; other
    columns, whatever their names, don't matter. Rows of a text that very many have are summed before they move, and dealt
    to many tasks when they learn their group.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark, f"{shared_dir(spark).rstrip('/')}/digests-{uuid.uuid4().hex}")
    rows = cut(digests(docs, id_col, text_col))
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id() + F.lit(index.next_row())))
    bounds = _bounds(rows, loads)
    load = F.lit(0)
    for b in bounds:
        load = load + F.when(F.col("_id") >= F.lit(b), 0).otherwise(1)
    for k in range(len(bounds) + 1):
        mine = rows.filter(load == k)
        best = F.max(F.struct(F.col("_id").isNotNull(), "_id", "_row")).alias("best")
        index.add(mine.groupBy("digest").agg(best, F.count("*").alias("copies")).select("digest", F.col("best._id").alias("keep_id"), F.col("best._row").alias("keep_row"), "copies"))
    found = cut(index.found().withColumn("group_size", F.col("copies")))
    met = join_copies(rows, found, "digest", "copies", "left")
    return met.select(F.col("_id").alias(id_col), "keep_id", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"), "digest")


def _bounds(rows: DataFrame, loads: int) -> list:
    """Descending ids that cut the rows into about equal loads; any bounds give the same result. None for ids that are no numbers."""
    if loads < 2 or rows.schema["_id"].dataType.typeName() not in ("byte", "short", "integer", "long", "float", "double"):
        return []
    steps = F.array(*(F.lit(k / loads) for k in range(1, loads)))
    return sorted(set(rows.agg(F.percentile_approx("_id", steps, 1000)).first()[0] or []), reverse=True)
