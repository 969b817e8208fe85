"""Publishing and keyed tables: what is told of the content, writers that meet, loads that die, attempts that go."""

import threading
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from gradeline.operators import publish
from gradeline.operators.keyed_table import KeyedTable
from gradeline.operators.publish import Table
from gradeline.operators.versions import Versions, VersionTaken


def points(spark, n=6):
    return spark.createDataFrame([(k, 2000 + k % 2, f"a{k % 3}", None if k == 1 else k * 1.5) for k in range(n)], "k int, y int, area string, v double")


def test_manifest_tells_the_content(spark, tmp_path):
    root, df = str(tmp_path / "p"), points(spark)
    converted = spark.createDataFrame([(2000, 3), (2001, 3)], "y int, converted bigint")
    table = Table(df, ["k"], spans=["y", "v"], distinct=[["area"], ["area", "y"]], year="y", converted=converted)
    told = publish.publish(spark, root, {"t": table, "s": (df.select("k"), ["k"])}, {"c": df.filter("k < 0")}, "h", 2025, rules={"as many": "select (select count(*) from {t}) = (select count(*) from {s})"})
    c = told["contents"]["t"]
    assert (c["rows"], c["spans"], c["distinct"], c["rows_per_year"]) == (6, {"y": ["2000", "2001"], "v": ["0.0", "7.5"]}, {"area": 3, "area,y": 6}, {"2000": 3, "2001": 3})
    assert publish.manifest_of(spark, root, told["run_id"])["contents"]["t"] == c and publish.reconcile(spark, root, told["run_id"]).count() == 0
    # one row put in place of another: as many rows, other content
    at = f"{root}/run_id={told['run_id']}/t"
    changed = spark.read.parquet(at).withColumn("v", F.when(F.col("k") == 3, 0.0).otherwise(F.col("v"))).cache()
    changed.count()
    changed.write.mode("overwrite").parquet(at)
    assert [tuple(r) for r in publish.reconcile(spark, root, told["run_id"]).collect()] == [("t", 6, 6)]


def test_a_null_is_no_other_value(spark):
    rows = lambda *r: spark.createDataFrame(r, "a int, b int").agg(*publish.content_digest(spark.createDataFrame(r, "a int, b int"))).first()
    assert rows((1, None)) != rows((None, 1)) and rows((1, 2), (3, 4)) == rows((3, 4), (1, 2)) != rows((1, 4), (3, 2))


@pytest.mark.parametrize("fault", ["rule", "year", "null key", "rows"])
def test_faults_leave_the_pointer(spark, tmp_path, fault):
    root, df = str(tmp_path / "p"), points(spark)
    none = df.filter("k < 0")
    publish.publish(spark, root, {"t": (df, ["k"])}, {"c": none}, "h0", 2025)
    before = publish.current_run(spark, root)
    table, rules = Table(df, ["k"], year="y"), {}
    if fault == "rule":
        rules = {"misses are the unmatched": "select count(*) = 5 from {t}", "no rows told": "select null", "fine": "select true"}
    if fault == "year":
        table.converted = spark.createDataFrame([(2000, 3), (2001, 4)], "y int, converted bigint")
    if fault == "null key":
        table.key = ["v"]
    if fault == "rows":
        table.rows = none
    said = {"rule": "misses are the unmatched.*no rows told", "year": "2001, 4, 3", "null key": "1 rows", "rows": "0 rows"}[fault]
    with pytest.raises(ValueError, match=said):
        publish.publish(spark, root, {"t": table}, {"c": none}, "h1", 2025, rules=rules)
    assert publish.current_run(spark, root) == before
    assert sorted(r.status for r in publish.ledger(spark, root).collect()) == ["Completed", "Failed", "Running", "Running"]


def test_two_publishers_at_once(spark, tmp_path, monkeypatch):
    root, df = str(tmp_path / "p"), points(spark)
    none, meet, ended = df.filter("k < 0"), threading.Barrier(2), {}
    monkeypatch.setattr(publish, "gate", lambda checks: meet.wait(60))

    def run(name):
        try:
            ended[name] = publish.publish(spark, root, {"t": (df, ["k"])}, {"c": none}, name, 2025)["run_id"]
        except VersionTaken as e:
            ended[name] = e

    threads = [threading.Thread(target=run, args=(n,)) for n in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [v for v in ended.values() if isinstance(v, str)]
    assert len(won) == 1 and publish.current_run(spark, root) == won[0]
    assert sorted(r.status for r in publish.ledger(spark, root).collect()) == ["Completed", "Failed", "Running", "Running"]


def test_versions_go_to_one_writer(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    assert v.latest() == (0, {}) and v.publish(0, {"x": 1}) == 1
    wins, meet = [], threading.Barrier(8)

    def run(k):
        meet.wait(60)
        try:
            wins.append(v.publish(1, {"x": k}) and k)
        except VersionTaken:
            pass

    threads = [threading.Thread(target=run, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(wins) == 1 and v.latest() == (2, {"x": wins[0]})


def test_retirement(spark, tmp_path):
    root, df = str(tmp_path / "p"), points(spark)
    none = df.filter("k < 0")
    runs = [publish.publish(spark, root, {"t": (df, ["k"])}, {"c": none}, f"h{k}", 2025)["run_id"] for k in range(3)]
    with pytest.raises(ValueError):
        publish.publish(spark, root, {"t": (none, ["k"])}, {"c": none}, "bad", 2025)
    assert publish.retire(spark, root, timedelta(hours=1)) == []
    gone = publish.retire(spark, root, timedelta(0))
    assert len(gone) == 3 and set(runs[:2]) < set(gone) and publish.served(spark, root, "t").count() == 6
    assert not (tmp_path / "p" / f"run_id={runs[0]}").exists() and publish.retire(spark, root, timedelta(0)) == []
    assert publish.ledger(spark, root).filter("status = 'Retired'").count() == 3
    with pytest.raises(ValueError, match="nothing is published"):
        publish.served(spark, str(tmp_path / "none"), "t")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_keyed_table_rewrites_only_what_it_touches(spark, tmp_path):
    schema = "a string, b int, v string"
    table = KeyedTable(spark, str(tmp_path / "t"), ["a", "b"], parts=16)
    first = [(f"a{k}", k, "old") for k in range(200)] + [(None, 1, "old"), (None, None, "old")]
    assert table.load(spark.createDataFrame(first, schema))["rewritten"] == 16
    old = KeyedTable(spark, str(tmp_path / "t"))
    files = set(old.rows().inputFiles())
    told = table.load(spark.createDataFrame([("a7", 7, "new"), (None, 1, "new"), ("z", 0, "new")], schema))
    assert told["version"] == 2 and told["rewritten"] <= 3 and told["rewritten"] + told["kept"] == 16
    want = {(a, b): v for a, b, v in first} | {("a7", 7): "new", (None, 1): "new", ("z", 0): "new"}
    assert rows_of(table.rows()) == sorted(((a, b, v) for (a, b), v in want.items()), key=repr)
    # readers of the version before see what they saw; parts that were not touched are the same files
    assert rows_of(old.rows()) == sorted(first, key=repr)
    now = set(table.rows().inputFiles())
    assert len({f.split("_part=")[1].split("/")[0] for f in now - files}) == told["rewritten"] and len(files & now) > 0
    assert rows_of(old.refresh().rows()) == rows_of(table.rows())
    assert table.vacuum(timedelta(hours=1)) == [] and rows_of(table.rows()) == rows_of(old.rows())
    assert table.load(spark.createDataFrame([], schema))["rewritten"] == 0 and table.rows().count() == len(want)
    assert KeyedTable(spark, str(tmp_path / "t")).key == ["a", "b"]
    with pytest.raises(ValueError):
        table.load(spark.createDataFrame([(1,)], "a int"))


def test_a_load_that_dies_changes_nothing(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], parts=4)
    table.load(spark.range(100).selectExpr("id as k", "'old' as v"))

    @F.udf("string")
    def breaks(k):
        if k == 57:
            raise RuntimeError("lost half-way")
        return "new"

    with pytest.raises(Exception, match="lost half-way"):
        table.load(spark.range(100).select(F.col("id").alias("k"), breaks("id").alias("v")))
    again = KeyedTable(spark, str(tmp_path / "t"))
    assert again.version == 1 and again.rows().filter("v = 'old'").count() == 100
    # of two loads from one version the second loses; after a refresh it goes through
    other = KeyedTable(spark, str(tmp_path / "t"))
    again.load(spark.createDataFrame([(1, "x")], "k long, v string"))
    with pytest.raises(VersionTaken):
        other.load(spark.createDataFrame([(1, "y")], "k long, v string"))
    assert KeyedTable(spark, str(tmp_path / "t")).rows().filter("k = 1").first().v == "x"
    other.refresh().load(spark.createDataFrame([(1, "y")], "k long, v string"))
    assert other.rows().filter("k = 1").first().v == "y" and other.rows().count() == 100
    left = {p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("load-")}
    gone = set(other.vacuum(timedelta(0)))
    assert gone < left and other.rows().count() == 100
