"""Readers: fields of any length in the JVM, files of any size, footers, conversions that count, provenance."""

import csv
import hashlib
import json
import os
import random
import resource
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from gradeline.plans import file_queries, queries
from gradeline.sources import boundaries, delimited, files, snapshot, vintages


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quoted_fields_are_read_in_the_jvm(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice(['"', '""', ",", "a", "b ", '","', "é"]) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    lines += ['1,"' + "x" * 100_000 + '",2', '"' + 'a""' * 50_000 + '",z', '"' + "," * 100_000, ",".join(['"q,q"'] * 5000)]
    df = spark.createDataFrame(list(enumerate(lines)), "k int, line string").select("k", snapshot.quoted_fields(F.col("line")).alias("f"))
    assert "Python" not in plan_of(df) and "Arrow" not in plan_of(df)
    csv.field_size_limit(1 << 30)
    found = {r.k: r.f for r in df.collect()}
    assert found == {k: next(csv.reader([t])) or [""] for k, t in enumerate(lines)}
    assert spark.createDataFrame([(None,)], "line string").select(snapshot.quoted_fields(F.col("line"))).first()[0] is None


def test_fingerprints_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b.txt").write_bytes(b"hello\n" * 1000)
    (tmp_path / "in" / "empty").write_bytes(b"")
    with open(tmp_path / "in" / "large", "wb") as f:
        f.truncate(3 << 30)
    before = resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss
    found = {r.file.rsplit("/", 1)[1].replace("%20", " "): (r.n_bytes, r.sha256) for r in files.fingerprints(spark, str(tmp_path / "in")).collect()}
    whole = hashlib.sha256()
    for _ in range(3 << 8):
        whole.update(bytes(1 << 22))
    assert found["large"] == (3 << 30, whole.hexdigest())
    assert found["a b.txt"] == (6000, hashlib.sha256(b"hello\n" * 1000).hexdigest()) and set(found) == {"large", "a b.txt"}
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss - before < 400_000
    pieces = files.PIECE
    assert pieces <= 8 << 20


def test_footers_name_the_odd_file(spark, tmp_path):
    at = str(tmp_path / "p")
    for k in range(5):
        spark.range(3).selectExpr("id as a", "cast(id as string) as b").coalesce(1).write.mode("append").parquet(at)
    spark.range(3).selectExpr("cast(id as int) as a", "array(named_struct('x', id)) as c").coalesce(1).write.mode("append").parquet(at)
    df = files.footer_differences(spark, at)
    found = sorted(map(tuple, df.select("column", "found", "expected").collect()))
    assert found == [("a", "int", "bigint"), ("b", None, "string"), ("c", "array<struct<x:bigint>>", None)]
    assert len({r.file for r in df.collect()}) == 1 and files.footers(spark, at).select("file").distinct().count() == 6


def test_population_text(spark, tmp_path):
    (tmp_path / "p.dat").write_text("GEO_ID|B01003_M001|NAME|B01003_E001\n0500000US01001|12|'A \"x\"|100\n0400000US01|1|b|900\n0500000US01003|-555555555|c|-555555555\n0500000US01005|3\n0500000US01007||d| 70 \n0500000US01009|x|e|1.5|more|fields\n")
    df = delimited.read_population(spark, str(tmp_path / "p.dat"), 2024)
    assert sorted((r.geoid, r.population, r.margin) for r in df.collect()) == [("01001", 100, 12), ("01003", None, None), ("01005", None, 3), ("01007", 70, None), ("01009", None, None)]
    first = df.orderBy("geoid").first()
    assert (first.geoid_fq, first.vintage, first.period, first.table) == ("0500000US01001", 2024, "2020-2024", "B01003")
    assert "StringStartsWith" in plan_of(df)
    with pytest.raises(ValueError, match="NO_SUCH"):
        delimited.read_delimited(spark, str(tmp_path / "p.dat"), {"NO_SUCH": "x"})


def test_conversion_reconciles_only_if_nothing_is_lost(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source, out = tmp_path / "in" / "v.txt", str(tmp_path / "out")
    source.write_text("KEY,STATUS_WITH_10YR_RULE,DECK\n'a'b ', x ,7\n\n,y,8\nk,z,9,\n'K2',,N\n")
    args = (1992, ["KEY", "STATUS_WITH_10YR_RULE", "DECK", "MORE"], ["KEY"], ["DECK"])
    told = vintages.convert_vintage(spark, str(source), out, *args).first()
    assert (told.read, told.converted, told.rejected, told.reconciles, told.era, told.absent_columns) == (4, 2, 2, True, "ten_year_rule", ["MORE"])
    assert told.by_reason == {"missing_key_field": 1, "row_field_count_mismatch": 1} and told.sha256 == hashlib.sha256(source.read_bytes()).hexdigest()
    assert {r.SOURCE_SHA256 for r in spark.read.parquet(f"{out}/rows").collect()} == {told.sha256}
    # a conversion that loses a row on its way to the files
    keep, vintages.read_vintage = vintages.read_vintage, lambda *a: (lambda r: (r[0].filter("KEY <> 'K2'"), r[1], r[2]))(keep(*a))
    keep_ = keep
    try:
        lost = vintages.convert_vintage(spark, str(source), out, *args).first()
    finally:
        vintages.read_vintage = keep_
    assert (lost.read, lost.converted, lost.rejected, lost.reconciles) == (4, 1, 2, False)
    listed, totals = vintages.catalog([(1992, "v.txt", told.sha256, vintages.vintage_counts(spark, out, 1992).withColumn("read", F.lit(4).cast("long")))])
    assert totals.first()["read"] == 4 and listed.first()["converted"] == 1


def test_catalog_with_provenance(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "b.txt").write_text("x\ny\n")
    notes = tmp_path / "notes" / "2024"
    notes.mkdir(parents=True)
    sha = hashlib.sha256(b"x\ny\n").hexdigest()
    names = {"file": "file", "url": "url", "zip": "archive", "zipSha256": "archive_sha256", "fileSha256": "file_sha256", "downloadedUtc": "downloaded_at"}
    (notes / "source.json").write_text(json.dumps({"file": "b.txt", "url": "https://example.org/b", "zip": "b.zip", "fileSha256": sha, "downloadedUtc": "2024-01-02T03:04:05Z"}, indent=1))
    provenance = vintages.read_provenance(spark, str(tmp_path / "notes"), names)
    rows = spark.read.text(str(tmp_path / "src"))
    got = vintages.source_catalog(spark, {"boundaries": (str(tmp_path / "src"), rows)}, provenance).first()
    assert (got.kind, got.file, got.n_bytes, got.sha256, got.n_rows, got.url, got.same_bytes, got.archive_sha256) == ("boundaries", "b.txt", 4, sha, 2, "https://example.org/b", True, None)
    sources = spark.createDataFrame([(2024, "b.txt", "other"), (2023, "a.txt", "h")], "year int, file string, sha256 string")
    assert sorted((r.year, r.url, r.same_bytes) for r in vintages.with_provenance(sources, provenance).collect()) == [(2023, None, None), (2024, "https://example.org/b", False)]
    shutil.rmtree(tmp_path / "src")
    with pytest.raises(ValueError):
        vintages.source_catalog(spark, {}, provenance)


@pytest.mark.parametrize("name", ["snapshot_rows", "snapshot_dry_run", "population_text", "boundary_rows", "vintage_rows", "vintage_rejects", "file_fingerprint", "footer_columns", "served_box", "rule_counts", "served_rollup", "reconcile_after_append", "keyed_loads", "published_manifest", "vintage_conversion", "points_in_areas", "nearest_areas"])
def test_file_query_matches_sql(spark, name):
    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for f in os.listdir(sf):
        db.sql(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    df = file_queries.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    shown = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v if v is None or isinstance(v, bool) else str(v)
    rel = db.sql(file_queries.ORACLE[name])
    at = [rel.columns.index(n) for n in names]
    got = sorted((tuple(shown(r[n]) for n in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(shown(r[k]) for k in at) for r in rel.fetchall()), key=repr) and got


def test_geometry_is_parsed_once(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    (tmp_path / "f.json").write_text(json.dumps({"type": "Feature", "properties": {"GEOID": "1"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}) + "\n")
    good, _ = boundaries.read_boundaries(spark, str(tmp_path / "f.json"), {"GEOID": "geoid"}, {})
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert sum("from_json" in line for line in plan.splitlines()) == 1
    assert [[(p.x, p.y) for p in r] for r in good.first().rings] == [[tuple(p) for p in ring]]


def test_vintage_file_is_written_and_read_unsorted(spark, tmp_path):
    """Lines come back as they are, under the header, and nothing sorts them: neither the writing task nor the line numbers."""
    odd = ["'1', N , '2'", " 'a\\b', \"N\",'' ", ",,", "\t'x', y, z"]
    lines = spark.createDataFrame([(x,) for x in odd], "value string")
    path = file_queries.one_unsorted_file("'KEY', A , B", lines, str(tmp_path / "text"))
    (part,) = [f for f in os.listdir(path) if f.startswith("part-")]
    first, *rest = open(f"{path}/{part}", encoding="utf-8").read().splitlines()
    assert first == "'KEY', A , B" and sorted(rest) == sorted(odd)
    numbered = snapshot.numbered_lines(spark, path)
    assert "SortMergeJoin" not in plan_of(numbered) and [r.line_number for r in numbered.orderBy("line_number").collect()] == [1, 2, 3, 4, 5]


def test_rows_are_dealt_before_they_are_validated(spark):
    assert queries._validated(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() >= 16
