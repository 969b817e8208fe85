"""Files laid out for serving: rows along a space-filling curve, key columns with bloom filters, so that reads skip row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.operators.spatial import in_box

#: Bits of each coordinate in the curve, and the masks that spread 16 bits to every other place.
BITS = 16
SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _spread(c: Column) -> Column:
    for by, mask in SPREAD:
        c = c.bitwiseOR(F.shiftleft(c, by)).bitwiseAND(F.lit(mask).cast("long"))
    return c


def curve(x: Column, y: Column, west: float, south: float, east: float, north: float) -> Column:
    """The place of a point on the Z-shaped curve through the box; coordinates outside count as on its edge, null as null."""
    top = (1 << BITS) - 1
    scaled = lambda c, low, high: F.when(c.isNotNull(), F.least(F.lit(top), F.greatest(F.lit(0), F.floor((c - low) / max(high - low, 1e-12) * top)))).cast("long")
    return _spread(scaled(x, west, east)).bitwiseOR(F.shiftleft(_spread(scaled(y, south, north)), 1))


def write_served(df: DataFrame, path: str, keys: list[str], lon: str = "lon", lat: str = "lat", files: int | None = None, group_bytes: int = 8 << 20) -> None:
    """Write rows sorted along the curve of (lon, lat), in row groups of about `group_bytes`, with a bloom filter for each
    column of `keys`.

    Neighbours stand together, so the least and greatest coordinates of a row group span a small box and box filters skip
    the others; the bloom filters skip row groups without a wanted key. The curve follows the box of the data (one
    aggregate). Rows of one place may be any number: ranges are cut by a hash of the keys too. Rows without coordinates
    come first."""
    west, east, south, north = df.agg(F.min(lon), F.max(lon), F.min(lat), F.max(lat)).first()
    place = curve(F.col(lon), F.col(lat), west, south, east, north) if west is not None else F.lit(None).cast("long")
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumns({"_place": place, "_cut": F.xxhash64(*keys)}).repartitionByRange(n, "_place", "_cut").sortWithinPartitions("_place", "_cut")
    writer = placed.drop("_place", "_cut").write.mode("errorifexists").option("compression", "zstd").option("parquet.block.size", group_bytes)
    # small row groups are only cut in time if the writer looks often
    writer = writer.option("parquet.page.size", max(1 << 14, group_bytes // 8)).option("parquet.block.size.row.check.min", 100)
    for k in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true").option(f"parquet.bloom.filter.expected.ndv#{k}", max(1000, group_bytes // 64))
    writer.parquet(path)


def read_box(spark: SparkSession, path: str, west: float, south: float, east: float, north: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The rows inside a box, its boundary included."""
    return spark.read.parquet(path).filter(in_box(F.col(lon), F.col(lat), west, south, east, north))


def rows_scanned(df: DataFrame) -> int:
    """Run a plan and tell how many rows its file scans gave out, before any filter of its own: what row groups and pages
    that were not skipped held."""
    executed = df.select("*")._jdf.queryExecution().executedPlan()  # a plan of its own counts from nothing
    executed.executeCollect()
    plan = executed.finalPhysicalPlan() if executed.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else executed
    leaves, total = plan.collectLeaves(), 0
    for k in range(leaves.size()):
        metric = leaves.apply(k).metrics().get("numOutputRows")
        total += metric.get().value() if metric.isDefined() else 0
    return total
