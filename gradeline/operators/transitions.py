"""Rating transitions between consecutive years, by cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeline.functions.codes import NATIONAL, with_cohort
from gradeline.operators.panel import COMPONENTS, ENTITY

COHORT = ["component", "type_group", "material_group", "region"]


def component_long(years: DataFrame) -> DataFrame:
    """Wide to long in one scan; unrated components are left out."""
    ids = ["vintage_year", *ENTITY, "material", "design"]
    return years.unpivot(ids, COMPONENTS, "component", "rating").filter("rating is not null")


def transition_pairs(long: DataFrame) -> DataFrame:
    """(y, y+1) pairs of one component; material and design come from the from-year. One shuffle: keys are unique per year."""
    w = Window.partitionBy(*ENTITY, "component").orderBy("vintage_year")
    nxt = long.withColumns({"_year": F.lead("vintage_year").over(w), "to_rating": F.lead("rating").over(w)})
    return nxt.filter("_year = vintage_year + 1").select(*ENTITY, "component", F.col("vintage_year").alias("from_year"), F.col("rating").alias("from_rating"), "to_rating", "material", "design")


def component_pairs(years: DataFrame) -> DataFrame:
    """The pairs of all components, as `transition_pairs` of `component_long` gives them, from one window over whole years: a
    pair needs both years, so the next row of the structure decides. Years that come from `structure_years` lie by structure
    already and move no more."""
    w = Window.partitionBy(*ENTITY).orderBy("vintage_year")
    after = F.lead(F.struct("vintage_year", *COMPONENTS)).over(w)
    met = years.select(*ENTITY, "vintage_year", "material", "design", *COMPONENTS, after.alias("after")).filter("after.vintage_year = vintage_year + 1")
    each = F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("from_rating"), F.col(f"after.{c}").alias("to_rating")) for c in COMPONENTS])
    rated = F.filter(each, lambda p: p["from_rating"].isNotNull() & p["to_rating"].isNotNull())
    pairs = met.select(*ENTITY, F.col("vintage_year").alias("from_year"), "material", "design", F.explode(rated).alias("p"))
    return pairs.select(*ENTITY, "p.component", "from_year", "p.from_rating", "p.to_rating", "material", "design")


def cohort_pairs(pairs: DataFrame) -> DataFrame:
    return with_cohort(pairs)


def _both(cells: DataFrame) -> DataFrame:
    """Cohort rows and, from them, national rows with NATIONAL in all three dimensions at once."""
    nation = cells.withColumns({c: F.lit(NATIONAL) for c in COHORT[1:]})
    return cells.unionByName(nation)


def matrix_cells(pairs: DataFrame) -> DataFrame:
    by = [*COHORT, "from_rating", "to_rating"]
    cells = pairs.groupBy(*by).agg(F.count("*").alias("pairs"))
    return _both(cells).groupBy(*by).agg(F.sum("pairs").alias("pairs"))


def matrix_rows(pairs: DataFrame) -> DataFrame:
    """Per matrix row the total, first and last from-year and the number of distinct years: a set of years is carried, so
    that the national rows come from the cohorts' and no row is expanded for a distinct count."""
    by = [*COHORT, "from_rating"]
    part = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.collect_set("from_year").alias("ys"))
    whole = _both(part).groupBy(*by).agg(F.sum("n").alias("row_total"), F.array_distinct(F.flatten(F.collect_list("ys"))).alias("ys"))
    return whole.select(*by, "row_total", F.array_min("ys").alias("first_from_year"), F.array_max("ys").alias("last_from_year"), F.size("ys").alias("year_pairs_observed"))


def movement(cells: DataFrame) -> DataFrame:
    """National shares of pairs unchanged, declined and improved by component."""
    nation = cells.filter(F.col("region") == NATIONAL)
    s = lambda cond: F.round(F.lit(100.0).cast("double") * F.sum(F.when(cond, F.col("pairs")).otherwise(0)) / F.sum("pairs"), 2)
    a, b = F.col("from_rating"), F.col("to_rating")
    return nation.groupBy("component").agg(F.sum("pairs").alias("pairs"), s(a == b).alias("unchanged_percent"), s(b < a).alias("declined_percent"), s(b > a).alias("improved_percent"))


def floor_diagnostic(rows: DataFrame, floor: int) -> DataFrame:
    low = F.col("row_total") < floor
    return rows.filter(F.col("region") != NATIONAL).agg(F.lit(floor).alias("sample_floor"), F.count("*").alias("n_rows"), F.count_if(low).alias("rows_below"), F.sum("row_total").alias("pairs"), F.sum(F.when(low, F.col("row_total")).otherwise(0)).alias("pairs_below"))


def narrow_span(rows: DataFrame, floor: int, years: int = 5) -> DataFrame:
    return rows.filter((F.col("row_total") >= floor) & (F.col("year_pairs_observed") <= years))


def totals(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("component_pairs"), F.countDistinct(F.struct(*ENTITY, "from_year")).alias("structure_pairs"), F.countDistinct(F.struct(*COHORT[1:])).alias("cohorts"))


def matrix_grid(rows: DataFrame, cells: DataFrame, floor: int) -> DataFrame:
    """The 10 x 10 national grid of each component, empty rows kept; rates are null for rows below the floor."""
    spark = rows.sparkSession
    axis = spark.range(10).select(F.col("id").cast("int").alias("from_rating"))
    grid = F.broadcast(axis.crossJoin(spark.range(10).select(F.col("id").cast("int").alias("to_rating"))))
    names = rows.filter(F.col("region") == NATIONAL).select("component").distinct()
    nation = lambda df: df.filter(F.col("region") == NATIONAL).drop(*COHORT[1:])
    out = names.crossJoin(grid).join(nation(rows).select("component", "from_rating", "row_total"), ["component", "from_rating"], "left").join(nation(cells), ["component", "from_rating", "to_rating"], "left")
    pairs, total = F.coalesce("pairs", F.lit(0)), F.coalesce("row_total", F.lit(0))
    return out.select("component", "from_rating", "to_rating", total.alias("row_total"), pairs.alias("pairs"), F.when(total >= floor, F.bround(F.lit(100.0).cast("double") * pairs / total, 1)).alias("rate"))


def unchanged_share(rows: DataFrame, cells: DataFrame, floor: int) -> DataFrame:
    """Per cohort the share of pairs that stay, over rows at or above the floor; null if there are none."""
    same = cells.filter("from_rating = to_rating").select(*COHORT, "from_rating", F.col("pairs").alias("same"))
    both = rows.join(same, [*COHORT, "from_rating"], "left").withColumn("ok", F.col("row_total") >= floor)
    total = F.sum(F.when(F.col("ok"), F.col("row_total")))
    kept = F.sum(F.when(F.col("ok"), F.coalesce("same", F.lit(0))))
    return both.groupBy(*COHORT).agg(total.alias("pairs_above_floor"), F.bround(F.try_divide(F.lit(100.0).cast("double") * kept, total), 1).alias("unchanged_percent"))


def cohort_catalog(rows: DataFrame, floor: int) -> DataFrame:
    """Per cohort and component: pairs, matrix rows, rows at or above the floor; `place` orders the cohorts: the nation first,
    then by pairs of all components, then by name. Cohorts are as many as the code tables allow, so one task orders them."""
    per = rows.groupBy(*COHORT).agg(F.sum("row_total").alias("pairs"), F.count("*").alias("n_rows"), F.count_if(F.col("row_total") >= floor).alias("rows_above_floor"))
    whole = per.groupBy(*COHORT[1:]).agg(F.sum("pairs").alias("cohort_pairs")).withColumn("is_national", F.col("region") == NATIONAL)
    placed = whole.withColumn("place", F.row_number().over(Window.orderBy(F.desc("is_national"), F.desc("cohort_pairs"), *COHORT[1:])))
    return per.join(placed, COHORT[1:])
