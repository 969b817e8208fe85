"""Published codes against the polygons that hold the points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.functions.ratings import share

KEY = ["state_code", "structure_number", "record_type"]
STRUCTURE = ["state_code", "structure_number"]


def outcomes(points: DataFrame, assigned: DataFrame) -> DataFrame:
    """Every point once: agree, other_county, other_state, no_code or unmatched."""
    joined = points.join(assigned.select(*KEY, "geoid"), KEY, "left")
    code, found = F.col("published"), F.col("geoid")
    kind = F.when(found.isNull(), "unmatched").when(code.isNull(), "no_code").when(code == found, "agree").when(F.substring(code, 1, 2) == F.substring(found, 1, 2), "other_county").otherwise("other_state")
    return joined.withColumn("outcome", kind)


def coverage(rows: DataFrame) -> DataFrame:
    """One row: points and structures, matched and not, and outcome counts; percents of both, and of agreement where matched."""
    c = lambda k: F.count_if(F.col("outcome") == k).alias(k)
    matched = F.col("outcome") != "unmatched"
    out = rows.agg(F.count("*").alias("n_points"), F.count_if(matched).alias("matched"), F.countDistinct(F.struct(*STRUCTURE)).alias("structures"), F.countDistinct(F.when(matched, F.struct(*STRUCTURE))).alias("matched_structures"), *[c(k) for k in ("agree", "other_county", "other_state", "no_code", "unmatched")])
    percents = {"matched_percent": ("matched", "n_points"), "structures_percent": ("matched_structures", "structures"), "agree_percent": ("agree", "matched")}
    return out.withColumns({k: share(F.col(a), F.col(b), 4) for k, (a, b) in percents.items()})


def disagreements(rows: DataFrame, polygon_codes: DataFrame) -> DataFrame:
    """Pairs of published and containing code that differ: rows, structures, and whether the published code is current
    (null if there is none)."""
    differ = rows.filter(F.col("outcome").isin("other_county", "other_state", "no_code"))
    known = polygon_codes.select(F.col("geoid").alias("_code"), F.lit(True).alias("_current"))
    joined = differ.join(known, F.col("published") == F.col("_code"), "left")
    per = joined.groupBy("published", "geoid", "outcome").agg(F.count("*").alias("n_rows"), F.countDistinct(F.struct(*STRUCTURE)).alias("structures"), F.when(F.count("published") == 0, F.lit(None)).otherwise(F.max(F.coalesce("_current", F.lit(False)))).alias("current"))
    return per


def by_state(pairs: DataFrame) -> DataFrame:
    old = F.when(~F.col("current"), F.col("n_rows")).otherwise(0)
    out = pairs.filter("published is not null").groupBy(F.substring("published", 1, 2).alias("state_fips")).agg(F.sum("n_rows").alias("n_rows"), F.sum("structures").alias("structures"), F.count("*").alias("pairs"), F.sum(old).alias("rows_retired"))
    return out.filter("n_rows > 0")


def retired_codes(points: DataFrame, polygon_codes: DataFrame) -> DataFrame:
    """Published codes that no polygon has, with their rows."""
    given = points.filter("published is not null")
    return given.join(polygon_codes.select(F.col("geoid").alias("published")), "published", "left_anti").groupBy("published").agg(F.count("*").alias("n_rows"))


def absent_population(areas: DataFrame) -> DataFrame:
    """Areas (of `with_population`) without a population, by the first two digits of their code."""
    return areas.filter("population is null").groupBy(F.substring("geoid", 1, 2).alias("state_fips")).agg(F.count("*").alias("areas"))


def misses(points: DataFrame, assigned: DataFrame, touching: DataFrame, nearest: DataFrame) -> DataFrame:
    """Points in no polygon with a reason; one on a boundary is 0 metres from it."""
    left = points.join(assigned.select(*KEY), KEY, "left_anti").join(touching, KEY, "left").join(nearest, KEY, "left")
    on = F.col("touching").isNotNull()
    return left.select(*KEY, F.when(on, "on_boundary").otherwise("outside_all").alias("reason"), F.coalesce("touching", F.lit(0)).alias("touching"), F.coalesce("first_geoid", "nearest_geoid").alias("nearest_geoid"), F.when(on, F.lit(0)).otherwise(F.col("distance_m")).cast("long").alias("distance_m"))


def miss_buckets(rows: DataFrame) -> DataFrame:
    d = F.col("distance_m")
    bucket = F.when(F.col("reason") == "on_boundary", "on a boundary").when(d.isNull(), "beyond the radius").when(d < 100, "under 100 m").when(d < 1000, "100 m to 1 km").when(d < 10000, "1 km to 10 km").otherwise("over 10 km")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("misses"))


def miss_summary(rows: DataFrame) -> DataFrame:
    """Per reason rows, structures, lower median and maximum distance (nulls left aside)."""
    return rows.groupBy("reason").agg(F.count("*").alias("n_rows"), F.countDistinct(F.struct(*STRUCTURE)).alias("structures"), F.expr("cast(percentile_disc(0.5) within group (order by distance_m) as bigint)").alias("median_m"), F.max("distance_m").alias("max_m"))


def top_disagreements(pairs: DataFrame, names: DataFrame, top: int = 15) -> DataFrame:
    """The largest pairs with the names of both codes; a code without a polygon has no name."""
    first = pairs.orderBy(F.desc("n_rows"), F.col("published").asc_nulls_last(), "geoid").limit(top)
    a, b = names.select(F.col("geoid").alias("geoid"), F.col("name").alias("containing_name")), names.select(F.col("geoid").alias("published"), F.col("name").alias("published_name"))
    return first.join(a, "geoid").join(b, "published", "left").select("published", "geoid", "n_rows", "published_name", "containing_name")


def key_alignment(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with the side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("only_in", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("only_in", F.lit("right")))


def with_population(areas: DataFrame, population: DataFrame, key: str) -> DataFrame:
    """Areas with their population and why one is missing; absence stays null."""
    given = population.select(key, "population", F.lit(True).alias("_listed"))
    return areas.join(given, key, "left").select(*areas.columns, "population", F.when(F.col("_listed").isNull(), "not listed").when(F.col("population").isNull(), "not published").otherwise("published").alias("status"))


def population(raw: DataFrame, prefix: str, width: int, *carried: str) -> DataFrame:
    """Rows whose key has the prefix: the rest of the key, the value with negative sentinels as null, and the carried columns."""
    value = F.col("value").try_cast("bigint")
    return raw.filter(F.col("key").startswith(prefix)).select(F.substring("key", len(prefix) + 1, width).alias("geoid"), F.when(value >= 0, value).alias("population"), *carried)


def population_report(rows: DataFrame) -> DataFrame:
    """One row on staged population lines: lines, areas, lines without a value, people, and codes that are not five digits."""
    return rows.agg(F.count("*").alias("n_lines"), F.countDistinct("geoid").alias("areas"), F.count_if(F.col("population").isNull()).alias("without_value"), F.sum("population").alias("people"), F.count_if(~F.coalesce(F.col("geoid").rlike("^[0-9]{5}$"), F.lit(False))).alias("malformed"))


def boundary_report(polygons: DataFrame) -> DataFrame:
    """One row on staged polygons: polygons, areas, those without rings, and codes that are not five digits."""
    return polygons.agg(F.count("*").alias("polygons"), F.countDistinct("geoid").alias("areas"), F.count_if(F.coalesce(F.size("rings"), F.lit(0)) <= 0).alias("without_rings"), F.count_if(~F.coalesce(F.col("geoid").rlike("^[0-9]{5}$"), F.lit(False))).alias("malformed"))


def national_total(report: DataFrame, stated: int) -> DataFrame:
    """The report's row if its people are not the stated total."""
    return report.select("people", F.lit(stated).cast("long").alias("stated")).filter(~F.col("people").eqNullSafe(F.col("stated")))
