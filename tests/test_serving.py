"""Layout for serving, names and vocabulary, gates over shared inputs, hot keys of duplicates."""

import pytest
from pyspark.sql import functions as F

from gradeline.operators import checks, ingest, layout, serve
from gradeline.plans import adapters


def test_reads_skip_row_groups(spark, tmp_path):
    points = adapters.area_points(spark, "/root/testdata/sf0.01").withColumn("number", F.sha2(F.col("point").cast("string"), 256))
    points.write.parquet(str(tmp_path / "plain"))
    layout.write_served(points, str(tmp_path / "served"), ["number"], files=4, group_bytes=64 << 10)
    box = (10.0, 5.0, 12.0, 7.0)
    found = {}
    for kind in ("plain", "served"):
        inside = layout.read_box(spark, str(tmp_path / kind), *box)
        key = spark.read.parquet(str(tmp_path / kind)).filter(F.col("number") == F.sha2(F.lit("7"), 256))
        found[kind] = (sorted(r.point for r in inside.collect()), [r.point for r in key.collect()], layout.rows_scanned(inside), layout.rows_scanned(key))
    n = points.count()
    assert found["plain"][:2] == found["served"][:2] and len(found["plain"][0]) > 10
    assert found["plain"][2] == found["plain"][3] == n and found["served"][2] < n / 5 and found["served"][3] < n / 5


def test_curve_keeps_neighbours_together(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (9.0, -9.0), (None, 1.0)], "x double, y double")
    found = [r[0] for r in df.select(layout.curve(F.col("x"), F.col("y"), 0, 0, 1, 1)).collect()]
    top = (1 << layout.BITS) - 1
    full = int("01" * layout.BITS, 2)
    assert found == [0, full, 2 * full, 3 * full, full, None] and top == 65_535


def test_empty_and_unplaced_rows_are_written(spark, tmp_path):
    df = spark.createDataFrame([("a", None, None), ("b", 1.0, 2.0)], "k string, lon double, lat double")
    layout.write_served(df, str(tmp_path / "a"), ["k"], files=1)
    layout.write_served(df.filter("k = 'a'"), str(tmp_path / "b"), ["k"], files=1)
    layout.write_served(df.filter("false"), str(tmp_path / "c"), ["k"], files=1)
    assert [spark.read.parquet(str(tmp_path / x)).count() for x in "abc"] == [2, 1, 0]


def test_names_fall_back(spark):
    df = spark.createDataFrame([("01001",), ("09110",), ("x",)], "fips string")
    names = spark.createDataFrame([("01001", "Square"), ("01001", "Zed"), ("x", " ")], "fips string, name string")
    assert sorted(map(tuple, serve.with_names(df, names, "fips", "County FIPS").collect())) == [("01001", "Square"), ("09110", "County FIPS 09110"), ("x", "County FIPS x")]


def test_vocabulary(spark):
    groups = spark.createDataFrame([("Beam", "02"), ("Beam", "01"), ("None", None), ("Odd", "77")], "g string, c string")
    labels = spark.createDataFrame([("01", "Slab"), ("02", "Girder"), ("99", "x")], "c string, label string")
    counted = spark.createDataFrame([("Beam", "01", 3), ("Beam", "02", 4)], "g string, c string, n int")
    assert sorted(map(tuple, serve.vocabulary(groups, labels, "g", "c", counted).collect())) == [("Beam", "01=Slab; 02=Girder", 7), ("None", None, 0), ("Odd", None, 0)]
    assert serve.vocabulary(groups, labels, "g", "c").columns == ["g", "members"]


def scans(df):
    return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Scan parquet")


def test_a_gate_scans_its_input_once(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 as m").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    folded = checks.fold(rows, {f"rule{k}": f"id >= {-k}" for k in range(20)})
    assert scans(checks.gate({}, folded)) == 1 and checks.gate({}, folded).count() == 20
    with pytest.raises(ValueError, match="small.*93"):
        checks.gate({}, checks.fold(rows, {"small": "id < 7", "nulls are not true": "nullif(id, id) = 1 or true"}))
    held = checks.shared(t=rows)["t"]
    by_group = {f"group{k}": held.groupBy("m").count().filter(f"count < {k}") for k in range(5)}
    assert scans(checks.gate(by_group)) == 0 and checks.gate(by_group, folded).count() == 25
    with pytest.raises(ValueError, match="no checks"):
        checks.gate({})


def test_first_valid_wins_on_a_hot_key(spark, tmp_path):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("k"), F.when(F.col("id") % 3 == 1, F.lit("r")).alias("t"), F.col("id").cast("int").alias("n"), F.when(F.col("id") % 30 == 0, F.array(F.lit("adt_invalid"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    df.write.parquet(str(tmp_path / "t"))
    found = ingest.first_valid_wins(spark.read.parquet(str(tmp_path / "t")), ["k", "t"], "n")
    again = {r.n for r in found.filter(F.array_contains("reasons", "duplicate_key")).collect()}
    # all rows without a key share one; the first valid of them is row 3
    assert again == {n for n in range(0, 3000, 3) if n % 30 and n > 3} and found.count() == 3000 and found.columns == df.columns
