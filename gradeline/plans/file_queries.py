"""Queries of readers, conversions and publishing: the driver's tables go to files in the shared folder and come back through the
library's own readers; the SQL gives the same rows from the tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.operators import checks, layout, panel, publish
from gradeline.operators.keyed_table import KeyedTable
from gradeline.plans import adapters
from gradeline.plans.adapters import scratch
from gradeline.plans.oracle import sql
from gradeline.plans.queries import ORACLE, QUERIES, Query
from gradeline.sources import boundaries, delimited, files, snapshot, vintages


#: Years whose files are written and converted at the same time.
BESIDE = 7


def query(body: str):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql(body)
        return f

    return register


def one_file(spark: SparkSession, header: str, rows: DataFrame, to: str) -> str:
    """Write lines (`n`, `value`) under a header as one text file, as such files are published."""
    head = spark.createDataFrame([(-1, header)], "n bigint, value string")
    lines = head.unionByName(rows.select(F.col("n").cast("long").alias("n"), "value"))
    lines.repartition(1).sortWithinPartitions("n").select("value").write.text(to)
    return to


def one_unsorted_file(header: str, lines: DataFrame, to: str) -> str:
    """Write `value` under a header as one text file. Nothing is sorted, so the task that writes holds a row at a time."""
    plain = {"header": "true", "sep": "\u0001", "quote": "", "escape": "", "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    lines.select(F.col("value").alias(header)).repartition(1).write.options(**plain).csv(to)
    return to


# snapshots and other text

_SNAP = "concat(case when c_custkey % 53 = 0 then '' else cast(c_custkey % 56 as string) end, ',', cast(c_custkey as string), ',\"', c_name, ', \"\"', c_mktsegment, '\"\"\"', case when c_custkey % 41 = 0 then ',more' else '' end)"


@query(
    "SELECT CAST(row_number() OVER (ORDER BY c_custkey) + 1 AS INT) AS line_number, CASE WHEN c_custkey % 41 = 0 OR c_custkey % 53 = 0 THEN 'row_structural_fault' END AS fault, CASE WHEN c_custkey % 53 > 0 THEN CAST(c_custkey % 56 AS VARCHAR) END AS state, CAST(c_custkey AS VARCHAR) AS number, c_name || ', \"' || c_mktsegment || '\"' AS name, CAST(NULL AS VARCHAR) AS design FROM customer"
)
def snapshot_rows(s, d):
    lines = adapters.table(s, d, "customer").selectExpr("cast(c_custkey as bigint) as n", f"{_SNAP} as value")
    path = one_file(s, "STATE_CODE,number,Facility", lines, f"{scratch(s)}/snapshot")
    rows = snapshot.read_snapshot(s, path, {"State_Code": "state", "NUMBER": "number", "FACILITY": "name", "DESIGN": "design"}, ["STATE_CODE", "NUMBER"], ["state", "number"])
    return rows.select("line_number", "fault", "state", "number", "name", "design")


@query("SELECT CAST(row_number() OVER (ORDER BY c_custkey) + 1 AS INT) AS line_number, CAST(c_custkey AS VARCHAR) AS number FROM customer QUALIFY row_number() OVER (ORDER BY c_custkey) <= 100")
def snapshot_dry_run(s, d):
    lines = adapters.table(s, d, "customer").selectExpr("cast(c_custkey as bigint) as n", f"{_SNAP} as value")
    path = one_file(s, "STATE_CODE,number,Facility", lines, f"{scratch(s)}/snapshot")
    return snapshot.read_snapshot(s, path, {"NUMBER": "number"}, ["NUMBER"], ["number"], limit=100).select("line_number", "number")


@query("SELECT substr(key, 10, 5) AS geoid, key AS geoid_fq, CASE WHEN TRY_CAST(value AS BIGINT) >= 0 THEN TRY_CAST(value AS BIGINT) END AS population, CASE WHEN n % 4 > 0 THEN n END AS margin, CAST(2024 AS SMALLINT) AS vintage, '2020-2024' AS period, 'B01003' AS \"table\" FROM (SELECT '0500000US' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS key, CASE WHEN s_suppkey % 7 = 2 THEN '-555555555' WHEN s_suppkey % 11 = 0 THEN 'x' ELSE CAST(s_suppkey * 1000 AS VARCHAR) END AS value, CAST(s_suppkey AS BIGINT) AS n FROM supplier WHERE s_suppkey % 3 > 0)")
def population_text(s, d):
    lines = adapters.table(s, d, "supplier").selectExpr(
        "s_suppkey as n",
        "concat(case when s_suppkey % 3 = 0 then '0400000US' else '0500000US' end, lpad(cast(s_suppkey as string), 5, '0'), '|', case when s_suppkey % 4 > 0 then cast(s_suppkey as string) else '-222222222' end, '|', case when s_suppkey % 7 = 2 then '-555555555' when s_suppkey % 11 = 0 then 'x' else cast(s_suppkey * 1000 as string) end) as value",
    )
    return delimited.read_population(s, one_file(s, "GEO_ID|B01003_M001|B01003_E001", lines, f"{scratch(s)}/population"), 2024)


@query("SELECT geoid, CAST(w AS BIGINT) AS land, 1 AS n_rings, 121 AS n_points, west, east, south, north FROM jagb JOIN (SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS geoid, CASE WHEN p_partkey % 97 = 0 THEN 2048 ELSE 64 + (p_partkey * 31) % 192 END AS w FROM part) USING (geoid)")
def boundary_rows(s, d):
    areas = adapters.areas(s, d, "w")
    rings = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("geoid").alias("GEOID"), F.col("w").alias("ALAND")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")).alias("geometry")))
    path = f"{scratch(s)}/boundaries"
    areas.select(feature.alias("value")).write.text(path)
    good, _ = boundaries.read_boundaries(s, path, {"GEOID": "geoid"}, {"ALAND": "land"})
    x, y = (F.flatten("rings")[k] for k in ("x", "y"))
    return good.select("geoid", "land", F.size("rings").alias("n_rings"), F.size(x).alias("n_points"), F.array_min(x).alias("west"), F.array_max(x).alias("east"), F.array_min(y).alias("south"), F.array_max(y).alias("north"))


# vintages

_LINE = "concat('''', case when l_orderkey % 101 = 0 then '' else cast(l_orderkey as string) end, ''', ', l_returnflag, ' , ''', cast(cast(l_quantity as int) % 12 as string), '''', case when l_orderkey % 103 = 0 then ',' else '' end)"
_SUPERSET = ["KEY", "STATUS_WITH_10YR_RULE", "DECK", "MORE"]


_HEADER = "'KEY', status_with_10yr_rule , DECK"


def _vintage_lines(s, d):
    return adapters.table(s, d, "lineitem").selectExpr("year(l_shipdate) as y", f"{_LINE} as value")


def _vintage_files(s, d, base):
    """A text file for each year of the table; published years are a few dozen. The table is read once; a file is written by
    one task, those of the years beside each other."""
    _vintage_lines(s, d).write.partitionBy("y").parquet(f"{base}/lines")
    rows = s.read.parquet(f"{base}/lines")
    years = [r.y for r in rows.select("y").distinct().orderBy("y").collect()]
    with ThreadPoolExecutor(BESIDE) as pool:
        return dict(zip(years, pool.map(lambda y: one_unsorted_file(_HEADER, rows.filter(F.col("y") == y), f"{base}/text/{y}"), years), strict=True))


@query(
    "SELECT CAST(y AS SMALLINT) AS year, 'ten_year_rule' AS era, count(*) AS \"read\", count(*) FILTER (n_key AND NOT n_more) AS converted, count(*) FILTER (n_more OR NOT n_key) AS rejected, count(*) FILTER (n_more) AS more_fields, count(*) FILTER (NOT n_more AND NOT n_key) AS without_key, true AS reconciles, 1 AS absent FROM (SELECT year(l_shipdate) AS y, l_orderkey % 101 > 0 AS n_key, l_orderkey % 103 = 0 AS n_more FROM lineitem) GROUP BY y"
)
def vintage_conversion(s, d):
    base = scratch(s)
    with ThreadPoolExecutor(BESIDE) as pool:
        found = reduce(DataFrame.unionByName, pool.map(lambda at: vintages.convert_vintage(s, at[1], f"{base}/out", at[0], _SUPERSET, ["KEY"], ["DECK"]), _vintage_files(s, d, base).items()))
    reason = lambda r: F.coalesce(F.try_element_at("by_reason", F.lit(r)), F.lit(0).cast("long"))
    return found.select("year", "era", "read", "converted", "rejected", reason("row_field_count_mismatch").alias("more_fields"), reason("missing_key_field").alias("without_key"), "reconciles", F.size("absent_columns").alias("absent"))


@query("SELECT CAST(1995 AS SMALLINT) AS \"VINTAGE_YEAR\", CAST(l_orderkey AS VARCHAR) AS \"KEY\", l_returnflag AS \"STATUS_WITH_10YR_RULE\", CAST(CAST(l_quantity AS INT) % 12 AS VARCHAR) AS \"DECK\", CAST(NULL AS VARCHAR) AS \"MORE\", CAST(CASE WHEN CAST(l_quantity AS INT) % 12 < 10 THEN CAST(l_quantity AS INT) % 12 END AS TINYINT) AS \"DECK_NUM\", length(sha) AS sha_length FROM lineitem, (SELECT repeat('x', 64) AS sha) WHERE year(l_shipdate) = 1995 AND l_orderkey % 101 > 0 AND l_orderkey % 103 > 0")
def vintage_rows(s, d):
    base = scratch(s)
    path = one_unsorted_file(_HEADER, _vintage_lines(s, d).filter("y = 1995"), f"{base}/text")
    good, _, _ = vintages.read_vintage(s, path, 1995, _SUPERSET, ["KEY"], ["DECK"])
    return good.select("VINTAGE_YEAR", *_SUPERSET, "DECK_NUM", F.length("SOURCE_SHA256").cast("long").alias("sha_length"))


@query("SELECT reason, raw_line FROM (SELECT CASE WHEN l_orderkey % 103 = 0 THEN 'row_field_count_mismatch' WHEN l_orderkey % 101 = 0 THEN 'missing_key_field' END AS reason, '''' || CASE WHEN l_orderkey % 101 = 0 THEN '' ELSE CAST(l_orderkey AS VARCHAR) END || ''', ' || l_returnflag || ' , ''' || CAST(CAST(l_quantity AS INT) % 12 AS VARCHAR) || '''' || CASE WHEN l_orderkey % 103 = 0 THEN ',' ELSE '' END AS raw_line FROM lineitem WHERE year(l_shipdate) = 1995) WHERE reason IS NOT NULL")
def vintage_rejects(s, d):
    path = one_unsorted_file(_HEADER, _vintage_lines(s, d).filter("y = 1995"), f"{scratch(s)}/text")
    return vintages.read_vintage(s, path, 1995, _SUPERSET, ["KEY"], ["DECK"])[1].select("reason", "raw_line")


@query("SELECT sha256(string_agg(CAST(c_custkey AS VARCHAR) || '|' || c_name, chr(10) ORDER BY c_custkey) || chr(10)) AS sha256, sum(length(CAST(c_custkey AS VARCHAR) || c_name) + 2)::BIGINT AS n_bytes FROM customer")
def file_fingerprint(s, d):
    lines = adapters.table(s, d, "customer").selectExpr("c_custkey + 1 as n", "concat(cast(c_custkey as string), '|', c_name) as value")
    path = f"{scratch(s)}/lines"
    lines.repartition(1).sortWithinPartitions("n").select("value").write.text(path)
    return files.fingerprints(s, path).filter("file not like '%_SUCCESS'").select("sha256", "n_bytes")


@query("SELECT * FROM (SELECT count(DISTINCT n_regionkey) AS n_files FROM nation), (VALUES ('n_name', 'string'), ('n_nationkey', 'bigint')) AS t(\"column\", \"type\") UNION ALL SELECT 1, 'n_nationkey', 'int'")
def footer_columns(s, d):
    nation, base = adapters.table(s, d, "nation").selectExpr("cast(n_nationkey as bigint) as n_nationkey", "n_name", "n_regionkey"), f"{scratch(s)}/nations"
    nation.repartition("n_regionkey").write.partitionBy("n_regionkey").parquet(base)
    nation.limit(1).selectExpr("cast(n_nationkey as int) as n_nationkey").repartition(1).write.parquet(f"{base}/n_regionkey=99")
    return files.footers(s, base).groupBy("column", "type").agg(F.count("*").alias("n_files"))


# publishing


@query("SELECT 'series' AS name, 'first_year' AS part, CAST(min(first_year) AS VARCHAR) AS low, CAST(max(first_year) AS VARCHAR) AS high, count(*) AS n FROM ser UNION ALL SELECT 'years', CAST(vintage_year AS VARCHAR), '', '', count(*) FROM sy GROUP BY vintage_year UNION ALL SELECT 'years', 'state_code,structure_number', '', '', count(DISTINCT (state_code, structure_number)) FROM sy")
def published_manifest(s, d):
    years = panel.structure_years(adapters.panel(s, d))
    series = panel.packed_series(years)
    converted = years.groupBy("vintage_year").agg(F.count("*").alias("converted"))
    tables = {"years": publish.Table(years, panel.KEY, distinct=[panel.ENTITY], year="vintage_year", converted=converted), "series": publish.Table(series, panel.ENTITY, spans=["first_year"])}
    rules = {"a series for each structure": "select (select count(*) from {series}) = (select count(distinct state_code, structure_number) from {years})", "observations are rows": "select (select sum(observed_years) from {series}) = (select count(*) from {years})"}
    row_rules = checks.fold(years, {"classes": "condition_class in ('Good', 'Fair', 'Poor', 'Unknown')", "keys": "state_code is not null and structure_number is not null"})
    told = publish.publish(s, scratch(s), tables, {"rows": row_rules.filter("n > 0")}, "driver", 2025, rules=rules)["contents"]
    out = [("years", y, "", "", n) for y, n in told["years"]["rows_per_year"].items()]
    out += [("years", c, "", "", n) for c, n in told["years"]["distinct"].items()]
    out += [("series", c, low, high, told["series"]["rows"]) for c, (low, high) in told["series"]["spans"].items()]
    return s.createDataFrame(out, "name string, part string, low string, high string, n bigint")


@query("SELECT * FROM roll")
def served_rollup(s, d):
    root, rollup = scratch(s), panel.area_rollup(panel.structure_years(adapters.panel(s, d)))
    publish.publish(s, root, {"rollup": (rollup, ["level", "fips", "vintage_year"])}, {"areas": rollup.filter("fips is null")}, "driver", 2025)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rollup.schema)
    publish.read_back(s, f"{root}/run_id={publish.current_run(s, root)}/rollup", schema, ["level", "fips", "vintage_year"], {"parts": "total = good + fair + poor + unknown", "some": "total > 0"})
    return publish.served(s, root, "rollup").select(*rollup.columns)


@query("SELECT 'rollup' AS name, count(*) AS expected, count(*) + 1 AS actual FROM roll")
def reconcile_after_append(s, d):
    root, rollup = scratch(s), panel.area_rollup(panel.structure_years(adapters.panel(s, d)))
    told = publish.publish(s, root, {"rollup": (rollup, ["level", "fips", "vintage_year"])}, {"areas": rollup.filter("fips is null")}, "driver", 2025)
    at = f"{root}/run_id={told['run_id']}/rollup"
    s.read.parquet(at).limit(1).write.mode("append").parquet(at)
    return publish.reconcile(s, root, told["run_id"])


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN 0.0::DOUBLE ELSE CAST(c_acctbal AS DOUBLE) END AS balance FROM customer UNION ALL SELECT -c_custkey, 'new', 1.0::DOUBLE FROM customer WHERE c_custkey % 100 = 0")
def keyed_loads(s, d):
    table = KeyedTable(s, scratch(s), ["c_custkey"], parts=16)
    rows = adapters.table(s, d, "customer").selectExpr("c_custkey", "c_name", "cast(c_acctbal as double) as balance")
    table.load(rows)
    more = rows.filter("c_custkey % 100 = 0").selectExpr("-c_custkey as c_custkey", "'new' as c_name", "cast(1 as double) as balance")
    table.load(rows.filter("c_custkey % 10 = 0").withColumn("balance", F.lit(0.0)).unionByName(more.selectExpr("cast(c_custkey as " + rows.schema["c_custkey"].dataType.simpleString() + ") as c_custkey", "c_name", "balance")))
    return table.rows()


@query("SELECT point, lon, lat FROM apts WHERE lon BETWEEN 10 AND 12 AND lat BETWEEN 5 AND 7")
def served_box(s, d):
    path = f"{scratch(s)}/points"
    layout.write_served(adapters.area_points(s, d), path, ["point"])
    return layout.read_box(s, path, 10, 5, 12, 7)


@query("SELECT 'rated' AS \"check\", count(*) FILTER (lowest IS NULL) AS n FROM inv UNION ALL SELECT 'poor is low', count(*) FILTER (NOT coalesce(condition_class <> 'Poor' OR lowest < 5, false)) FROM inv UNION ALL SELECT 'busy', count(*) FILTER (NOT coalesce(traffic > 1000, false)) FROM inv")
def rule_counts(s, d):
    return checks.fold(adapters.inventory(s, d), {"rated": "lowest is not null", "poor is low": "condition_class <> 'Poor' or lowest < 5", "busy": "traffic > 1000"})

