"""The driver's tables as an inventory: the same column expressions build the DataFrames here and the CTEs of the oracle SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.operators.places import Drawn

PANEL = [
    "cast(year(l_shipdate) as int) as vintage_year",
    "lpad(cast(1 + l_partkey % 56 as string), 2, '0') as state_code",
    "case when l_partkey % 11 = 0 then '' else lpad(cast(l_partkey % 7 as string), 3, '0') end as county_code",
    "cast(l_partkey as string) as structure_number",
    "case when l_linenumber <= 2 then '1' else '2' end as record_type",
    "l_orderkey * 10 + l_linenumber as source_row",
    "cast(cast(floor(l_quantity) as int) % 12 as string) as deck",
    "case when l_returnflag = 'N' then 'N' else cast(cast(round(l_discount * 100) as int) as string) end as superstructure",
    "case when l_linestatus = 'O' and l_tax = 0 then '' else concat(' ', cast(cast(round(l_tax * 100) as int) as string), ' ') end as substructure",
    "'n' as culvert",
    "case when l_tax = 0 then '' else cast(cast(floor(l_extendedprice) as int) % 10 as string) end as material",
    "case when l_tax = 0 then '' else cast(cast(floor(l_extendedprice) as int) % 23 as string) end as design",
]
INVENTORY = [
    "lpad(cast(1 + c_custkey % 56 as string), 2, '0') as state_code",
    "lpad(cast(c_custkey % 7 as string), 3, '0') as county_code",
    "cast(c_custkey as string) as structure_number",
    "case when c_custkey % 10 < 8 then '1' else '2' end as record_type",
    "cast((c_custkey * 37) % 41 as double) as lon",
    "cast((c_custkey * 91) % 29 as double) as lat",
    "case when c_acctbal >= 0 then cast(floor(c_acctbal) as int) end as traffic",
    "case when c_custkey % 13 > 0 then cast(1900 + c_custkey % 121 as int) end as year_built",
    "case when c_custkey % 9 > 0 then cast((c_custkey * 7) % 10 as int) end as lowest",
    "case when c_custkey % 9 = 0 then 'Unknown' when (c_custkey * 7) % 10 >= 7 then 'Good' when (c_custkey * 7) % 10 >= 5 then 'Fair' else 'Poor' end as condition_class",
    "cast(c_custkey % 11 as string) as material",
    "lpad(cast(c_custkey % 24 as string), 2, '0') as design",
    "c_name as facility",
    "c_nationkey as nation_key",
    "case when c_custkey % 11 = 0 then null when c_custkey % 6 = 0 then '01001' when c_custkey % 6 = 1 then '01003' when c_custkey % 6 = 2 then '02001' when c_custkey % 6 = 3 then '02003' when c_custkey % 6 = 4 then '03001' else '99001' end as published",
]
RAW = [
    "case when c_custkey % 17 = 0 then '99' when c_custkey % 5 = 0 then 'co' else cast(1 + c_custkey % 56 as string) end as state",
    "cast(c_custkey % 7 as string) as county",
    "case when c_custkey % 19 = 0 then '' when c_custkey % 23 = 0 then concat('ABCDEFGHIJKLMNOP', cast(c_custkey as string)) else cast(c_custkey % 400 as string) end as structure_number",
    "case when c_custkey % 4 = 0 then '' else '1' end as record_type",
    "case when c_custkey % 29 = 0 then '0000' when c_custkey % 31 = 0 then '3965' when c_custkey % 37 = 0 then '123456789' when c_custkey % 41 = 0 then '39x' else concat(cast(30 + c_custkey % 15 as string), lpad(cast(c_custkey % 70 as string), 2, '0'), '30.00') end as lat_raw",
    "concat(lpad(cast(75 + c_custkey % 45 as string), 3, '0'), '3015.50') as lon_raw",
    "case when c_custkey % 6 = 0 then '' when c_custkey % 43 = 0 then '12a' else cast(1500 + c_custkey % 540 as string) end as year_built",
    "cast(cast(floor(c_acctbal) as int) as string) as adt",
    "case when c_custkey % 47 = 0 then '1,234.5' when c_custkey % 53 = 0 then '-1' else concat(cast(c_custkey % 900 as string), '.5') end as length",
    "cast(c_custkey % 12 as string) as deck",
    "'N' as superstructure",
    "'' as substructure",
    "cast(c_custkey % 10 as string) as culvert",
    "cast(c_custkey % 10 as string) as material",
    "cast(c_custkey % 23 as string) as design",
    "c_custkey as line_number",
]

#: (code, name, closed rings of integer points): a square, an L with a shared edge, one with a hole, a far one, one empty.
POLYGONS = [
    ("01001", "Square", [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]]),
    ("01003", "Ell", [[(10, 0), (20, 0), (20, 5), (15, 5), (15, 10), (10, 10), (10, 0)]]),
    ("02001", "Ring", [[(22, 0), (38, 0), (38, 14), (22, 14), (22, 0)], [(26, 4), (32, 4), (32, 9), (26, 9), (26, 4)]]),
    ("02003", "North", [[(5, 15), (15, 15), (15, 25), (5, 25), (5, 15)]]),
    ("03001", "Empty", [[(100, 60), (110, 60), (110, 70), (100, 70), (100, 60)]]),
]
#: Areas with jagged sides of 30 edges each, one for each part; some are far larger than the others. Units of 1/1024 degree.
AREA_BASE = [
    "lpad(cast(p_partkey as string), 9, '0') as geoid",
    "cast(p_partkey as bigint) as p",
    "cast(case when p_partkey % 97 = 0 then 2048 else 64 + (p_partkey * 31) % 192 end as bigint) as w",
    "(cast(p_partkey as bigint) * 7919) % 40960 as x0",
    "(cast(p_partkey as bigint) * 15485863) % 28672 as y0",
]
#: For the k-th vertex: its place along the side, how far it stands off the side, and its coordinates.
AREA_ALONG = "cast(floor(w * (k % 30) / 30.0) as bigint)"
AREA_OFF = "(case when k % 30 = 0 then 0 else (p * 131 + k * 7919) % cast(floor(w / 16.0) as bigint) - cast(floor(w / 32.0) as bigint) end)"
AREA_X = f"cast(x0 + (case cast(floor(k / 30.0) as int) when 0 then {AREA_ALONG} when 1 then w + {AREA_OFF} when 2 then w - {AREA_ALONG} else {AREA_OFF} end) as double) / cast(1024 as double)"
AREA_Y = f"cast(y0 + (case cast(floor(k / 30.0) as int) when 0 then {AREA_OFF} when 1 then {AREA_ALONG} when 2 then w + {AREA_OFF} else w - {AREA_ALONG} end) as double) / cast(1024 as double)"
#: How far from a point its nearest area may lie, in degrees.
AREA_REACH = 0.25
#: Points in the region of the areas and a little beyond, one for each order.
AREA_POINTS = [
    "cast(o_orderkey as bigint) as point",
    "cast((cast(o_orderkey as bigint) * 7907) % 49152 as double) / cast(1024 as double) as lon",
    "cast((cast(o_orderkey as bigint) * 104729) % 36864 as double) / cast(1024 as double) as lat",
]
POINT_KEY = ["state_code", "structure_number", "record_type"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that all machines share: in `spark.checkpoint.dir`, of our own only in local mode without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*PANEL)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*INVENTORY)


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*RAW)


def polygons(spark: SparkSession) -> DataFrame:
    rows = [(g, n, [[(float(x), float(y)) for x, y in r] for r in rings]) for g, n, rings in POLYGONS]
    return spark.createDataFrame(rows, "geoid string, name string, rings array<array<struct<x: double, y: double>>>")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(spark, sf_dir).select(*POINT_KEY, "lon", "lat", "published")


def population_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw population lines from the nations: two summary levels, one negative sentinel."""
    return table(spark, sf_dir, "nation").select(
        F.concat(F.when(F.col("n_nationkey") % 3 == 0, "0400000US").otherwise("0500000US"), F.element_at(F.array(*map(F.lit, ("01001", "01003", "02001", "02003", "77001"))), F.col("n_nationkey") % 5 + 1)).alias("key"),
        F.when(F.col("n_nationkey") % 7 == 2, "-555555555").otherwise((F.col("n_nationkey") * 1000).cast("string")).alias("value"),
        "n_nationkey",
    )


def _outlines(p: np.ndarray, w: np.ndarray, x0: np.ndarray, y0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """AREA_X and AREA_Y of all 121 vertices of each area, a row an area."""
    k = np.arange(120)
    if len(p) and (p.min() < 0 or p.max() >= 2**32):
        off = np.fmod(p[:, None] * 131 + k * 7919, w[:, None] // 16)
    else:  # numbers that doubles divide and cut exactly, many times as fast
        off, most = p[:, None] * 131.0 + k * 7919.0, np.floor(w[:, None] / 16.0)
        off -= np.floor(off / most) * most
    off = np.where(k % 30 == 0, 0.0, off - w[:, None] // 32)
    w = w[:, None].astype(float)
    along = np.floor(w * np.arange(30) / 30.0)
    x = np.concatenate([along, w + off[:, 30:60], w - along, off[:, 90:], along[:, :1]], axis=1)
    y = np.concatenate([off[:, :30], along, w + off[:, 60:90], w - along, off[:, :1]], axis=1)
    return (x0[:, None] + x) / 1024.0, (y0[:, None] + y) / 1024.0


def drawn_areas(spark: SparkSession, sf_dir: str, *carried: str) -> Drawn:
    """(geoid, carried columns of AREA_BASE, rings): jagged areas of 120 edges from the parts. The parts are few bytes, so they
    are dealt to tasks before their outlines are drawn."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                b = whole.slice(start, 2000)
                x, y = _outlines(*[b.column(c).to_numpy(zero_copy_only=False) for c in ("p", "w", "x0", "y0")])
                points = pa.StructArray.from_arrays([pa.array(v.ravel()) for v in (x, y)], names=["x", "y"])
                rings = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * 121, pa.int32()), points)
                each = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1), pa.int32()), rings)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("geoid", *carried)], each], names=["geoid", *carried, "rings"])

    base = table(spark, sf_dir, "part").filter("p_partkey is not null").selectExpr(*AREA_BASE)
    base = base.repartition(4 * spark.sparkContext.defaultParallelism, "geoid")
    kinds = "".join(f"{c} {base.schema[c].dataType.simpleString()}, " for c in ("geoid", *carried))
    return Drawn(base, draw, f"{kinds}rings array<array<struct<x: double, y: double>>>")


def areas(spark: SparkSession, sf_dir: str, *carried: str) -> DataFrame:
    return drawn_areas(spark, sf_dir, *carried).frame()


def area_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*AREA_POINTS)
