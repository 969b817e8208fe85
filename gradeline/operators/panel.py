"""Yearly panel: keep-first structure-years, packed rating series, area rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeline.functions.ratings import blank_to_null, condition_class, guarded_pad, lowest, share, strict_digit

KEY = ["vintage_year", "state_code", "structure_number"]
ENTITY = ["state_code", "structure_number"]
COMPONENTS = ["deck", "superstructure", "substructure", "culvert"]
COUNTS = ["total", "good", "fair", "poor", "unknown"]


def keep_first(df: DataFrame, key: list[str], order: list[str], together: list[str] | None = None) -> DataFrame:
    """The first row of each key by `order`, then by the other columns: one exchange and one sort, no aggregate of whole rows.

    together (some of the key): rows that agree in these stay in one partition, sorted by them first, so that what is
    grouped or ordered by them next needs neither an exchange nor a sort."""
    rest = [c for c in df.columns if c not in key and c not in order]
    first = [*(together or []), *[k for k in key if k not in (together or [])]]
    placed = df.repartition(*together) if together else df
    ranked = placed.withColumn("_place", F.row_number().over(Window.partitionBy(*first).orderBy(*order, *rest)))
    return ranked.filter("_place = 1").select(*df.columns)


def typed_ratings(panel: DataFrame) -> DataFrame:
    return panel.withColumns({f"{c}_num": strict_digit(F.col(c)) for c in COMPONENTS})


def structure_years(panel: DataFrame) -> DataFrame:
    """One row per (year, state, structure) of record type 1: the lowest source row, its four ratings, lowest and class."""
    ones = panel.filter("record_type = '1'").select(*KEY, "source_row", "county_code", *COMPONENTS, "material", "design")
    first = keep_first(ones, KEY, ["source_row", *COMPONENTS, "county_code", "material", "design"], ENTITY)
    out = first.select(*KEY, guarded_pad(F.col("county_code"), 3).alias("county_code"), *[strict_digit(F.col(c)).cast("int").alias(c) for c in COMPONENTS], blank_to_null(F.col("material")).alias("material"), guarded_pad(F.col("design"), 2).alias("design"))
    return out.withColumn("lowest", lowest(*[F.col(c) for c in COMPONENTS])).withColumn("condition_class", condition_class(F.col("lowest")))


def packed_series(years: DataFrame) -> DataFrame:
    """Per structure first_year, last_year, observed_years and the series: a digit, `U` published but unrated, `.` not published."""
    marks = F.map_from_entries(F.collect_list(F.struct(F.col("vintage_year"), F.coalesce(F.col("lowest").cast("string"), F.lit("U")))))
    per = years.groupBy(*ENTITY).agg(F.min("vintage_year").alias("first_year"), F.max("vintage_year").alias("last_year"), F.count("*").cast("int").alias("observed_years"), marks.alias("_marks"))
    text = F.array_join(F.transform(F.sequence("first_year", "last_year"), lambda y: F.coalesce(F.try_element_at("_marks", y), F.lit("."))), "")
    return per.withColumn("ratings", text).drop("_marks")


def expand_series(series: DataFrame) -> DataFrame:
    """The observed years of packed series: vintage_year, rating (null if unrated)."""
    rows = series.select(*ENTITY, "first_year", F.posexplode(F.split("ratings", "")).alias("_at", "_mark"))
    return rows.filter("_mark not in ('.', '')").select(*ENTITY, (F.col("first_year") + F.col("_at")).cast("int").alias("vintage_year"), F.when(F.col("_mark") != "U", F.col("_mark").cast("int")).alias("rating"))


def class_counts(column: str = "condition_class") -> list[Column]:
    c = F.col(column)
    return [F.count("*").cast("int").alias("total"), *[F.count_if(c == k).cast("int").alias(k.lower()) for k in ("Good", "Fair", "Poor", "Unknown")]]


def area_rollup(years: DataFrame) -> DataFrame:
    """(level, fips, year) with five counts, for states and counties from one pass; rows without a county count in states only."""
    levels = F.array(F.struct(F.lit("state").alias("level"), F.col("state_code").alias("fips")), F.struct(F.lit("county").alias("level"), F.concat("state_code", "county_code").alias("fips")))
    rows = years.select("vintage_year", "condition_class", F.explode(levels).alias("a")).select("vintage_year", "condition_class", "a.level", "a.fips")
    return rows.filter("fips is not null").groupBy("level", "fips", "vintage_year").agg(*class_counts())


def trend_points(rollup: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of the year window with shares of the total, unknown included."""
    return rollup.filter(F.col("vintage_year").between(first, last)).withColumns({f"{c}_percent": share(F.col(c), F.col("total")) for c in COUNTS[1:]})


def year_accounting(panel: DataFrame) -> DataFrame:
    """Per year: rows, record-type-1 rows and kept rows, from one scan."""
    one = F.when(F.col("record_type") == "1", F.struct(*ENTITY))
    return panel.groupBy("vintage_year").agg(F.count("*").alias("n_rows"), F.count_if(F.col("record_type") == "1").alias("type1"), F.countDistinct(one).alias("kept"))


def series_statistics(series: DataFrame) -> DataFrame:
    gap = F.col("observed_years") < F.col("last_year") - F.col("first_year") + 1
    return series.agg(F.count("*").alias("entities"), F.sum("observed_years").alias("observations"), F.count_if(gap).alias("with_gaps"), F.countDistinct("state_code").alias("areas"))
