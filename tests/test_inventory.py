import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from gradeline.functions import codes, ratings
from gradeline.operators import checks, crosscheck, export, ingest, panel, publish, serve, spatial, transitions
from gradeline.plans import adapters, queries
from gradeline.sources import boundaries, files, snapshot, vintages
from gradeline.streaming.landing import load_landing

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else None if v is None else v if isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", ["area_rollup", "packed_series", "series_wellformed", "transition_pairs", "matrix_rows", "matrix_cells", "matrix_grid", "validate_reasons", "first_valid_wins", "point_in_polygon", "touching_polygons", "nearest_polygon", "coverage", "disagreement_pairs", "kpi_summary", "rank_area", "report_card", "check_span", "check_national_sum", "csv_escape"])
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    rel = db.sql(queries.ORACLE[name])
    want = sorted((tuple(plain(dict(zip(rel.columns, r, strict=True))[c]) for c in names) for r in rel.fetchall()), key=repr)
    assert sorted(rel.columns) == names and got == want


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE)


def years(spark, rows):
    cols = "vintage_year int, state_code string, structure_number string, county_code string, deck int, superstructure int, substructure int, culvert int, material string, design string"
    df = spark.createDataFrame(rows, cols)
    low = ratings.lowest(*[F.col(c) for c in panel.COMPONENTS])
    return df.withColumn("lowest", low).withColumn("condition_class", ratings.condition_class(low))


def test_series_with_gap_and_unrated(spark):
    df = years(spark, [(2000, "19", "A", "001", 7, 6, None, None, "1", "01"), (2002, "19", "A", "001", None, None, None, None, "1", "01"), (2003, "19", "A", "001", 4, 8, 8, None, "1", "01")])
    series = panel.packed_series(df)
    assert series.first()["ratings"] == "6.U4"
    assert [tuple(r) for r in panel.expand_series(series).orderBy("vintage_year").select("vintage_year", "rating").collect()] == [(2000, 6), (2002, None), (2003, 4)]


def test_pairs_skip_gaps_and_keep_improvements(spark):
    df = years(spark, [(2000, "19", "A", None, 5, None, None, None, "1", "01"), (2001, "19", "A", None, 7, None, None, 3, "3", "19"), (2003, "19", "A", None, 6, None, None, 3, "1", "01")])
    pairs = transitions.transition_pairs(transitions.component_long(df))
    assert [(r.component, r.from_year, r.from_rating, r.to_rating, r.material) for r in pairs.collect()] == [("deck", 2000, 5, 7, "1")]


@pytest.mark.parametrize("n,shown", [(49, None), (50, 100.0), (51, 100.0)])
def test_floor(spark, n, shown):
    rows = [(y, "19", f"S{k}", None, 6, None, None, None, "1", "01") for k in range(n) for y in (2000, 2001)]
    pairs = codes.with_cohort(transitions.transition_pairs(transitions.component_long(years(spark, rows))))
    grid = transitions.matrix_grid(transitions.matrix_rows(pairs), transitions.matrix_cells(pairs), 50)
    assert grid.count() == 100
    assert grid.filter("from_rating = 6 and to_rating = 6").first()["rate"] == shown


def test_dms(spark):
    df = spark.createDataFrame([("41303000", "093300000"), ("4130", "093300000"), ("0000", "1"), ("41603000", "093300000"), ("123456789", "0"), ("41x", "093300000"), ("90300000", "180595900"), ("91000000", "093300000"), ("000000000", "093300000"), ("41303000", "9" * 20), ("254626.80", "0801141.63"), ("29467560", "095221920"), (" ", "1")], "a string, b string")
    found = [tuple(r) for r in df.select(*[v.alias(k) for k, v in ratings.decode_dms(F.col("a"), F.col("b")).items()]).collect()]
    assert found[0][:2] == pytest.approx((41.508333, -93.5), abs=1e-6)
    assert [f[2] for f in found] == [None, None, "missing_or_zero", "out_of_range", "malformed", "missing_or_zero", None, "out_of_range", "malformed", "missing_or_zero", None, "out_of_range", "missing_or_zero"]
    assert found[6][0] == 90.5


def test_whole_number(spark):
    df = spark.createDataFrame([(v,) for v in ("2147483647", "2147483648", "-2147483648", " +12 ", "0000000000012", "1.0", "", None)], "v string")
    assert [r[0] for r in df.select(ingest.whole_number(F.col("v"))).collect()] == [2147483647, None, -2147483648, 12, 12, None, None, None]


def test_states_of_published_rows_are_numbers(spark):
    df = spark.createDataFrame([("8",), ("08",), ("co",), ("83",)], "state string")
    assert [r.fips for r in ingest.with_state(df, "state").collect()] == ["08", "08", None, None]
    assert [r.fips for r in ingest.resolve_state(df, "state").collect()] == ["08", "08", "08", None]


def test_quoted_fields(spark):
    long = 'x,""' * 25_000
    lines = {"a,b,c": ["a", "b", "c"], "a,,c,": ["a", "", "c", ""], '12,"R, N",x': ["12", "R, N", "x"], '"S ""H""",y': ['S "H"', "y"], "only": ["only"], '"a"b"c,d': ['ab"c', "d"], 'x"y",z': ['x"y"', "z"], '"open,a': ["open,a"], '"",b': ["", "b"], f'1,"{long}",2': ["1", long.replace('""', '"'), "2"]}
    df = spark.createDataFrame([(k,) for k in lines], "line string")
    assert [r[0] for r in df.select(snapshot.quoted_fields(F.col("line"))).collect()] == list(lines.values())


def test_snapshot_rows_and_faults(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('State,Number,Name\n19,A1,"Mill, ""Old"" road"\n\n19,,x\n19,A2\n19,A3,y\n')
    rows = snapshot.read_snapshot(spark, str(path), {"STATE": "state", "NUMBER": "number", "NAME": "name"}, ["STATE", "NUMBER"], ["number"]).orderBy("line_number").collect()
    assert [(r.line_number, r.fault, r.name) for r in rows] == [(2, None, 'Mill, "Old" road'), (4, "row_structural_fault", "x"), (5, "row_structural_fault", None), (6, None, "y")]
    with pytest.raises(ValueError):
        snapshot.bind_header(["a"], ["B"])


def test_vintage(spark, tmp_path):
    path = tmp_path / "v.txt"
    path.write_text("KEY,STATUS_WITH_10YR_RULE,DECK\n'a'b ', x ,7\n,y,8\nk,z,9,\n'K2',,N\n")
    rows, rejects, absent = vintages.read_vintage(spark, str(path), 1992, ["KEY", "STATUS_WITH_10YR_RULE", "DECK", "MORE"], ["KEY"], ["DECK"])
    assert [(r.KEY, r.SOURCE_ROW, r.DECK_NUM, r.MORE) for r in rows.orderBy("SOURCE_ROW").collect()] == [("a'b", 2, 7, None), ("K2", 5, None, None)]
    assert sorted(r.reason for r in rejects.collect()) == ["missing_key_field", "row_field_count_mismatch"] and absent == ["MORE"]
    assert vintages.summary(rows, rejects).first()["read"] == 4
    with pytest.raises(ValueError):
        vintages.read_vintage(spark, str(path), 2011, ["KEY", "STATUS_WITH_10YR_RULE", "DECK"], ["KEY"], ["DECK"])
    with pytest.raises(ValueError):
        vintages.read_vintage(spark, str(path), 1992, ["KEY", "STATUS_WITH_10YR_RULE"], ["KEY"], [])


def test_first_valid_wins_over_invalid(spark):
    df = spark.createDataFrame([("k", 1, ["adt_invalid"]), ("k", 2, []), ("k", 3, [])], "k string, n int, reasons array<string>")
    assert [r.reasons for r in ingest.first_valid_wins(df, ["k"], "n").orderBy("n").collect()] == [["adt_invalid"], [], ["duplicate_key"]]


def test_publish_checks_pointer_and_skip(spark, tmp_path):
    root = str(tmp_path / "pub")
    df = spark.range(5).withColumnRenamed("id", "k")
    none = df.filter("k < 0")
    assert publish.publish(spark, root, {"t": (df, ["k"])}, {"c": none}, "h1", 2025, n_read=7, n_rejected=2)["tables"] == {"t": 5}
    assert publish.publish(spark, root, {"t": (df, ["k"])}, {"c": none}, "h1", 2025) is None
    first = publish.current_run(spark, root)
    with pytest.raises(ValueError):
        publish.publish(spark, root, {"t": (df, ["k"])}, {"c": df}, "h2", 2025)
    with pytest.raises(ValueError):
        publish.publish(spark, root, {"t": (none, ["k"])}, {"c": none}, "h1", 2025, force=True)
    assert publish.current_run(spark, root) == first and publish.served(spark, root, "t").count() == 5
    # a forced run converges beside the served one
    forced = publish.publish(spark, root, {"t": (df.filter("k < 4"), ["k"])}, {"c": none}, "h1", 2025, force=True, with_csv=True)
    assert publish.current_run(spark, root) == forced["run_id"] != first and publish.served(spark, root, "t").count() == 4
    assert spark.read.parquet(f"{root}/run_id={first}/t").count() == 5 and publish.reconcile(spark, root, first).count() == 0
    states = [(r.status, r.n_rows, r.n_read, r.n_rejected) for r in publish.ledger(spark, root).orderBy("at").collect()]
    assert states == [("Running", None, 7, 2), ("Completed", 5, 7, 2), ("Running", None, None, None), ("Failed", 0, None, None), ("Running", None, None, None), ("Failed", 0, None, None), ("Running", None, None, None), ("Completed", 4, None, None)]
    spark.range(1).withColumnRenamed("id", "k").write.mode("append").parquet(f"{root}/run_id={first}/t")
    assert [tuple(r) for r in publish.reconcile(spark, root, first).collect()] == [("t", 5, 6)]
    with pytest.raises(ValueError):
        checks.gate({})


def test_read_back(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int").write.parquet(path)
    assert publish.read_back(spark, path, "k string, n int", ["k"], {"positive": "n > 0"}, 2).count() == 2
    with pytest.raises(ValueError, match="columns"):
        publish.read_back(spark, path, "k string, n bigint", ["k"], {})
    spark.createDataFrame([("b", -1), (None, None)], "k string, n int").write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="positive .2 rows.; null keys; repeated keys; 4 rows, not 2"):
        publish.read_back(spark, path, "k string, n int", ["k"], {"positive": "n > 0"}, 2)


def test_boundaries(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    feature = lambda geometry, **p: json.dumps({"type": "Feature", "properties": {"GEOID": "01001", "ALAND": 7, **p}, "geometry": geometry})
    lines = ['{"type": "FeatureCollection", "crs": {"properties": {"name": "EPSG:4269"}}}', feature({"type": "Polygon", "coordinates": [ring]}), feature({"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}, GEOID="01003"), "", feature({"type": "Polygon", "coordinates": [ring[:3]]}), feature({"type": "Polygon", "coordinates": [[*ring[:3], [1, 1]]]}), feature({"type": "Point", "coordinates": [0, 0]}), feature({"type": "Polygon", "coordinates": [[[0, 99], *ring]]}), feature({"type": "Polygon", "coordinates": [ring]}, GEOID=" "), "junk"]
    (tmp_path / "b.json").write_text("\n".join(lines))
    good, bad = boundaries.read_boundaries(spark, str(tmp_path), {"GEOID": "geoid"}, {"ALAND": "aland"})
    assert [(r.geoid, r.aland, len(r.rings)) for r in good.orderBy("geoid").collect()] == [("01001", 7, 1), ("01003", 7, 3)]
    assert sorted(r.reason for r in bad.collect()) == ["geometry_missing", "missing_key_field", "no_feature", "point_outside_degrees", "ring_open", "ring_short"]
    pts = spark.createDataFrame([("p", 3.0, 1.0)], "k string, lon double, lat double")
    assert [r.geoid for r in spatial.point_in_polygon(pts, good.filter("geoid = '01001'")).collect()] == ["01001"]
    text = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))",), ("POINT (1 1)",)], "t string")
    assert [r[0] and [len(x) for x in r[0]] for r in text.select(boundaries.wkt_rings(F.col("t"))).collect()] == [[4, 4], None]
    (tmp_path / "b.json").write_text(lines[0].replace("4269", "3857"))
    with pytest.raises(ValueError, match="3857"):
        boundaries.read_boundaries(spark, str(tmp_path), {"GEOID": "geoid"}, {})


def test_vintage_catalog_and_footers(spark, tmp_path):
    rows = spark.createDataFrame([(2000, "a"), (2000, "b"), (2001, "c")], "VINTAGE_YEAR smallint, x string")
    vintages.write_vintages(rows, str(tmp_path / "v"))
    assert files.footer_differences(spark, str(tmp_path / "v")).count() == 0
    assert checks.written_per_vintage(rows, spark.createDataFrame([(2000, 2), (2001, 2)], "VINTAGE_YEAR smallint, converted bigint")).collect()[0].asDict() == {"VINTAGE_YEAR": 2001, "converted": 2, "written": 1}
    spark.createDataFrame([(2002, 1, 2)], "VINTAGE_YEAR smallint, x int, y int").write.mode("append").partitionBy("VINTAGE_YEAR").parquet(str(tmp_path / "v"))
    off = files.footer_differences(spark, str(tmp_path / "v")).orderBy("column").collect()
    assert [(r.column, r.found, r.expected) for r in off] == [("x", "int", "string"), ("y", "int", None)] and all("VINTAGE_YEAR=2002" in r.file for r in off)
    rejects = spark.createDataFrame([("r",)], "reason string")
    listed, totals = vintages.catalog([(2001, "b", "h", vintages.summary(rows, rejects)), (2000, "a", "g", vintages.summary(rows, rejects.filter("false")))])
    assert [(r.year, r.read) for r in listed.collect()] == [(2000, 3), (2001, 4)] and tuple(totals.first()) == (2, 2000, 2001, 7, 6, 1)


def test_renames_manifest_and_staging(spark):
    df = spark.createDataFrame([(" ", "G", "1.5"), ("F", "G", "x"), (None, None, None)], "new string, old string, area string")
    assert [(r.c, r.a, r.z) for r in vintages.unified(df, {"c": ["new", "gone", "old"], "z": ["gone"]}, {"a": "area"}).collect()] == [("G", 1.5, None), ("F", None, None), (None, None, None)]
    text = spark.createDataFrame([('{"2000": {"rows": 3, "file": {"sha": "h"}}, "2001": {"rows": 1}}',)], "j string")
    listed = vintages.manifest_rows(text, "j", "struct<rows:bigint,file:struct<sha:string>>").selectExpr("cast(key as int) y", "entry.rows stated", "entry.file.sha sha")
    assert sorted(map(tuple, listed.collect()), key=str) == [(2000, 3, "h"), (2001, 1, None)]
    rows = spark.createDataFrame([(2000,)] * 3 + [(2002,)], "y int")
    assert sorted(map(tuple, vintages.differing_counts(rows, listed, "y", "stated").collect())) == [(2001, None, 1), (2002, 1, None)]
    assert tuple(crosscheck.boundary_report(adapters.polygons(spark)).first()) == (5, 5, 0, 0)
    people = crosscheck.population_report(spark.createDataFrame([("01001", 5), ("1", None)], "geoid string, population bigint"))
    assert tuple(people.first()) == (2, 2, 1, 5, 1) and crosscheck.national_total(people, 5).count() == 0 and crosscheck.national_total(people, 6).count() == 1


def test_geojson_with_run(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.0, 2.0), ("a", 3.0, 4.0)], "id string, lon double, lat double")
    assert export.write_geojson(df, ["id"], F.col("id"), ["id"], str(tmp_path / "g"), "run7") == 2
    assert spark.read.json(str(tmp_path / "g/meta")).select("run_id", "features").first() == ("run7", 2)


def test_filter_arguments(spark):
    with pytest.raises(ValueError, match="state.*min_traffic"):
        serve.check_filter(state="03", min_traffic=-1)
    assert serve.check_cohort("DECK", "culvert", "steel", "west") == ("deck", "Culvert", "Steel", "West") and serve.check_cohort("deck")[1:] == ("All", "All", "All")
    serve.check_county("12086")
    serve.check_trend("state", "fl", (1992, 2025))
    serve.check_ranking("high-adt-poor", None, "12")
    for f, args, said in ((serve.check_cohort, ("2", "Culvert"), "component.*all three"), (serve.check_cohort, ("deck", "All", "Steel", "West"), "type_group"), (serve.check_county, ("1208",), "5 digits"), (serve.check_county, ("03001",), "no state"), (serve.check_trend, ("county", "x", (2001, 1990)), "5 digits.*1990.*after"), (serve.check_trend, ("town", None), "level.*required"), (serve.check_ranking, ("high-adt-poor", "state", "zz", 0), "group_by.*state.*limit")):
        with pytest.raises(ValueError, match=said):
            f(*args)


def test_csv_report(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"'), (2, None)], "k int, t string")
    lines = export.csv_report(df, ["k", "t"], ["k"], ["by k"])
    assert [r.line for r in lines.orderBy("section", "k").collect()] == ["# by k", "k,t", '1,"a,""b"""', "2,"]


def test_boundary_point_is_no_match(spark):
    pts = spark.createDataFrame([("a", 10.0, 5.0), ("b", 5.0, 5.0), ("c", 28.0, 6.0)], "k string, lon double, lat double")
    assert [(r.k, r.geoid) for r in spatial.point_in_polygon(pts, adapters.polygons(spark)).collect()] == [("b", "01001")]
    assert [(r.k, r.touching) for r in spatial.touching_polygons(pts, adapters.polygons(spark), ["k"]).orderBy("k").collect()] == [("a", 2), ("b", 1)]


def test_landing(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, at int, v string")
    rows.write.parquet(str(tmp_path / "in"))
    load_landing(spark, str(tmp_path / "in"), "k int, at int, v string", str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], ["at"]).awaitTermination()
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "out/batch=0")).collect()) == ["b", "c"]
