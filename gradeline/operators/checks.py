"""Invariant checks: each returns the rows that violate it; a gate runs them all before a write."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.functions.codes import NATIONAL
from gradeline.functions.ratings import condition_class
from gradeline.operators.panel import class_counts, expand_series
from gradeline.operators.transitions import COHORT, matrix_rows


def state_totals(rollup: DataFrame, years: DataFrame) -> DataFrame:
    """Years whose state totals differ from the structure rows."""
    a = rollup.filter("level = 'state'").groupBy("vintage_year").agg(F.sum("total").alias("rolled"))
    return a.join(years.groupBy("vintage_year").agg(F.count("*").alias("counted")), "vintage_year").filter("rolled <> counted")


def partition(rollup: DataFrame) -> DataFrame:
    return rollup.filter("good + fair + poor + unknown <> total")


def within_parent(rollup: DataFrame) -> DataFrame:
    """States whose counties add up to more than the state."""
    below = rollup.filter("level = 'county'").groupBy(F.substring("fips", 1, 2).alias("fips"), "vintage_year").agg(F.sum("total").alias("counties"))
    return below.join(rollup.filter("level = 'state'").select("fips", "vintage_year", "total"), ["fips", "vintage_year"]).filter("counties > total")


def series_vs_rollup(series: DataFrame, rollup: DataFrame) -> DataFrame:
    """Expand and recount: state-years where series and rollup differ."""
    seen = expand_series(series).withColumn("c", condition_class(F.col("rating"))).groupBy(F.col("state_code").alias("fips"), "vintage_year").agg(*class_counts("c"))
    names = ["total", "good", "fair", "poor", "unknown"]
    a = seen.select("fips", "vintage_year", F.struct(*names).alias("a"))
    b = rollup.filter("level = 'state'").select("fips", "vintage_year", F.struct(*names).alias("b"))
    return a.join(b, ["fips", "vintage_year"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("fips", "vintage_year", F.col("a.total").alias("series_total"), F.col("b.total").alias("rollup_total"))


def unmapped(pairs: DataFrame) -> DataFrame:
    """Codes that no lookup knows, with their pairs."""
    bad = F.col("material_group").isNull() | F.col("type_group").isNull() | F.col("region").isNull()
    return pairs.filter(bad).groupBy("state_code", "material", "design").agg(F.count("*").alias("pairs"))


def pair_shape(pairs: DataFrame) -> DataFrame:
    good = F.col("from_rating").between(0, 9) & F.col("to_rating").between(0, 9) & F.col("from_year").isNotNull()
    return pairs.filter(~F.coalesce(good, F.lit(False)))


def row_totals(rows: DataFrame, cells: DataFrame) -> DataFrame:
    by = [*COHORT, "from_rating"]
    return rows.select(*by, "row_total").join(cells.groupBy(*by).agg(F.sum("pairs").alias("cells")), by, "left").filter(~F.col("row_total").eqNullSafe(F.col("cells")))


def national_sum(cells: DataFrame) -> DataFrame:
    """National cells that differ from the sum of the cohorts'."""
    by, nation = ["component", "from_rating", "to_rating"], F.col("region") == NATIONAL
    a = cells.filter(nation).select(*by, F.col("pairs").alias("national"))
    b = cells.filter(~nation).groupBy(*by).agg(F.sum("pairs").alias("summed"))
    return a.join(b, by, "full_outer").filter(~F.col("national").eqNullSafe(F.col("summed")))


def sentinel(rows: DataFrame) -> DataFrame:
    """Rows with the reserved value in some of the three dimensions only."""
    n = reduce(lambda a, b: a + b, [(F.col(c) == NATIONAL).cast("int") for c in COHORT[1:]])
    return rows.filter(~n.isin(0, 3)).select(*COHORT, "from_rating")


def span(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Matrix rows whose years differ from those recomputed from the pairs."""
    by, names = [*COHORT, "from_rating"], ["first_from_year", "last_from_year", "year_pairs_observed"]
    a, b = rows.select(*by, F.struct(*names).alias("a")), matrix_rows(pairs).select(*by, F.struct(*names).alias("b"))
    return a.join(b, by, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select(*by, F.col("a.last_from_year").alias("stated"), F.col("b.last_from_year").alias("found"))


def unique(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def reconciles(points: DataFrame, assigned: DataFrame, missed: DataFrame, key: list[str]) -> DataFrame:
    """Keys that assigned and missed together don't hold as often as the input."""
    a = points.groupBy(*key).agg(F.count("*").alias("given"))
    b = assigned.select(*key).unionByName(missed.select(*key)).groupBy(*key).agg(F.count("*").alias("found"))
    return a.join(b, key, "full_outer").filter(~F.col("given").eqNullSafe(F.col("found")))


def coverage_recount(coverage: DataFrame, points: DataFrame, assigned: DataFrame) -> DataFrame:
    """The coverage row if its totals differ from a recount."""
    again = points.agg(F.count("*").alias("points_again")).crossJoin(assigned.agg(F.count("*").alias("matched_again")))
    return coverage.crossJoin(again).filter("n_points <> points_again or matched <> matched_again").select("n_points", "points_again", "matched", "matched_again")


def sign(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """One row if nothing matched, or too few matched points with a code lie in their own state."""
    m = F.col("outcome") != "unmatched"
    coded = m & F.col("published").isNotNull()
    own = rows.agg(F.count_if(m).alias("matched"), F.count_if(coded).alias("coded"), F.count_if(coded & (F.col("outcome") != "other_state")).alias("same_state"))
    return own.filter((F.col("matched") == 0) | (F.col("same_state") < F.lit(least).cast("double") * F.col("coded")))


def key_shape(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).rlike("^[0-9]{5}$")).groupBy(column).agg(F.count("*").alias("n_rows"))


def miss_reason(missed: DataFrame, touching: DataFrame, key: list[str]) -> DataFrame:
    """Misses whose touch count differs from one found anew."""
    again = touching.select(*key, F.col("touching").alias("again"))
    return missed.join(again, key, "left").filter(F.col("touching") != F.coalesce("again", F.lit(0))).select(*key, "reason", "touching", F.coalesce("again", F.lit(0)).alias("again"))


def disagreement_account(pairs: DataFrame, coverage: DataFrame, polygon_codes: DataFrame) -> DataFrame:
    """One row if the pairs don't account for the coverage row's differing outcomes, if a containing code has no polygon, or if
    a pair is malformed (no rows, more structures than rows, an unknown outcome)."""
    known = polygon_codes.select("geoid", F.lit(True).alias("_known"))
    told = pairs.join(known, "geoid", "left")
    bad = (F.col("n_rows") <= 0) | (F.col("structures") > F.col("n_rows")) | ~F.col("outcome").isin("other_county", "other_state", "no_code")
    s = told.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("pair_rows"), F.count_if(F.col("_known").isNull()).alias("unresolved"), F.count_if(bad).alias("malformed"))
    both = s.crossJoin(coverage.select((F.col("other_county") + F.col("other_state") + F.col("no_code")).alias("outcome_rows")))
    return both.filter(~F.col("pair_rows").eqNullSafe(F.col("outcome_rows")) | (F.col("unresolved") > 0) | (F.col("malformed") > 0))


def reserved_value(groups: dict[str, DataFrame]) -> DataFrame:
    """(dimension, value) of groups that are spelled like the reserved value; each frame has one column."""
    named = [df.select(F.lit(k).alias("dimension"), df[df.columns[0]].alias("value")) for k, df in groups.items()]
    return reduce(DataFrame.unionByName, named).filter(F.col("value") == NATIONAL).distinct()


def written_per_vintage(written: DataFrame, converted: DataFrame, year: str = "VINTAGE_YEAR") -> DataFrame:
    """Vintages whose number of rows read back differs from the number converted (`year`, converted); null is none."""
    n = written.groupBy(year).agg(F.count("*").alias("written"))
    return converted.select(year, "converted").join(n, year, "full_outer").filter(~F.coalesce("converted", F.lit(0)).eqNullSafe(F.coalesce("written", F.lit(0))))


def fold(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(check, n) for any number of rules over the same rows from one scan and one aggregate: n rows for which the rule (a SQL
    condition) is not true."""
    sums = rows.agg(*[F.count_if(~F.coalesce(F.expr(r), F.lit(False))).alias(f"r{k}") for k, r in enumerate(rules.values())])
    each = F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"r{k}").alias("n")) for k, name in enumerate(rules)])
    return sums.select(F.explode(each).alias("e")).select("e.check", "e.n")


def shared(**inputs: DataFrame) -> dict[str, DataFrame]:
    """The inputs of a gate's checks, each computed once and written to the checkpoint folder; checks read that."""
    return {name: df.checkpoint(eager=True) for name, df in inputs.items()}


def gate(checks: dict[str, DataFrame], *folded: DataFrame) -> DataFrame:
    """(check, n) of all checks from one job; raises if there are none, or if any has rows.

    folded: further checks that are counted already (`fold`). Checks over the same input are built over `shared` ones, so that
    the input is not scanned once for each."""
    counts = [c.agg(F.lit(k).alias("check"), F.count("*").alias("n")) for k, c in checks.items()] + list(folded)
    if not counts:
        raise ValueError("no checks were given")
    counts = reduce(DataFrame.unionByName, counts)
    found = counts.collect()
    if len(found) < len(checks) + len(folded):
        raise ValueError("the checks gave no result")
    bad = {r["check"]: r["n"] for r in found if r["n"]}
    if bad:
        raise ValueError(f"checks failed: {bad}")
    return counts
