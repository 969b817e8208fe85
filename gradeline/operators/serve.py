"""Parameterised shapes over the inventory: filters, pages, summaries, rankings, report cards."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeline.functions import codes
from gradeline.functions.ratings import share
from gradeline.operators.spatial import in_box

KEY = ["state_code", "structure_number", "record_type"]


def check_filter(state: str | None = None, classes: list[str] | None = None, years: tuple[int, int] | None = None, min_traffic: int | None = None, box: tuple[float, float, float, float] | None = None, **_) -> None:
    """Raise one ValueError that names every bad argument."""
    bad = []
    if state is not None and state not in {s[0] for s in codes.STATES}:
        bad.append(f"state: {state} is unknown")
    if classes and not set(classes) <= set(codes.CLASSES):
        bad.append(f"classes: {sorted(set(classes) - set(codes.CLASSES))} are unknown")
    if years and years[0] > years[1]:
        bad.append("years: the first is after the last")
    if min_traffic is not None and min_traffic < 0:
        bad.append("min_traffic: is negative")
    if box and (box[0] > box[2] or box[1] > box[3]):
        bad.append("box: west, south, east, north are out of order")
    if bad:
        raise ValueError("; ".join(bad))


def _known_county(fips: str | None) -> str | None:
    """What is wrong with a county's code, or nothing."""
    if fips is None or not re.fullmatch("[0-9]{5}", fips):
        return "fips: a county has 5 digits"
    return None if fips[:2] in {s[0] for s in codes.STATES} else f"fips: {fips[:2]} is no state"


def _raise(bad: list[str | None]) -> None:
    if any(bad):
        raise ValueError("; ".join(filter(None, bad)))


def check_county(fips: str | None) -> None:
    _raise([_known_county(fips)])


def check_trend(level: str | None, fips: str | None, years: tuple[int, int] | None = None, published: tuple[int, int] = (1992, 2025)) -> None:
    """Level state (FIPS or USPS code) or county (5 digits), years within the published ones and in order."""
    bad = [None if level in ("state", "county") else f"level: {level} is neither state nor county"]
    if level == "county":
        bad.append(_known_county(fips))
    elif level == "state" and (fips or "").upper().zfill(2) not in {x for s in codes.STATES for x in s[:2]}:
        bad.append(f"fips: {fips} is no state")
    elif not fips:
        bad.append("fips: is required")
    if years:
        bad += [f"years: {y} is not published" for y in years if not published[0] <= y <= published[1]]
        bad.append("years: the first is after the last" if years[0] > years[1] else None)
    _raise(bad)


def check_cohort(component: str | None, type_group: str | None = None, material_group: str | None = None, region: str | None = None) -> tuple[str, str, str, str]:
    """(component, type group, material group, region) as spelled in the tables; all three groups or none, which is the nation."""
    known = {"component": ("deck", "superstructure", "substructure", "culvert"), "type_group": tuple(codes.TYPE_GROUPS), "material_group": tuple(codes.MATERIAL_GROUPS), "region": (*codes.REGIONS, codes.OUTSIDE)}
    for k in ("type_group", "material_group"):
        known[k] = (*known[k], codes.ABSENT)
    given = {"component": component, "type_group": type_group, "material_group": material_group, "region": region}
    found = {k: next((x for x in known[k] if v and x.lower() == v.strip().lower()), None) for k, v in given.items()}
    groups = [k for k in list(given)[1:] if given[k]]
    bad = [f"component: {component} is unknown" if found["component"] is None else None]
    if len(groups) in (1, 2):
        bad.append("type_group, material_group, region: all three or none")
    else:
        bad += [f"{k}: {given[k]} is unknown" for k in groups if found[k] is None]
    _raise(bad)
    return found["component"], *[found[k] if groups else codes.NATIONAL for k in list(given)[1:]]


def check_ranking(view: str | None = None, group_by: str | None = None, state: str | None = None, limit: int = 25, most: int = 500) -> None:
    """View worst-condition, grouped by state, county or cohort, or high-adt-poor, which is not grouped."""
    bad = [
        f"view: {view} is unknown" if view not in (None, "worst-condition", "high-adt-poor") else None,
        f"group_by: {group_by} is unknown" if group_by not in (None, "state", "county", "cohort") else None,
        "group_by: does not apply to single structures" if view == "high-adt-poor" and group_by else None,
        f"state: {state} is unknown" if state is not None and state.upper().zfill(2) not in {x for s in codes.STATES for x in s[:2]} else None,
        f"limit: must lie between 1 and {most}" if not 1 <= limit <= most else None,
    ]
    _raise(bad)


def inventory_filter(df: DataFrame, state: str | None = None, county: str | None = None, classes: list[str] | None = None, materials: list[str] | None = None, designs: list[str] | None = None, years: tuple[int, int] | None = None, min_traffic: int | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Rows that meet all given conditions; one that is not given asks nothing, and a null never meets one."""
    check_filter(state, classes, years, min_traffic, box)
    tests: list[Column] = []
    for name, value in (("state_code", state), ("county_code", county)):
        if value is not None:
            tests.append(F.col(name) == value)
    for name, values in (("condition_class", classes), ("material", materials), ("design", designs)):
        if values:
            tests.append(F.col(name).isin(values))
    if years:
        tests.append(F.col("year_built").between(*years))
    if min_traffic is not None:
        tests.append(F.col("traffic") >= min_traffic)
    if box:
        tests.append(in_box(F.col("lon"), F.col("lat"), *box))
    for t in tests:
        df = df.filter(t)
    return df


def of_type_group(df: DataFrame, names: list[str]) -> DataFrame:
    chosen = codes.groups(df.sparkSession, codes.TYPE_ROWS, "design", "type_group").filter(F.col("type_group").isin(names))
    return df.join(F.broadcast(chosen), "design", "left_semi")


def keyed_lookup(df: DataFrame, state: str, number: str) -> DataFrame:
    return df.filter((F.col("state_code") == state) & (F.col("structure_number") == number)).orderBy("record_type").limit(1)


def page(df: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(size).crossJoin(F.broadcast(total))


def discrete_median(column: str, upper: bool = False) -> Column:
    """The lower, or upper, of the two middle values; nulls left aside."""
    return F.expr(f"cast(percentile_disc(0.5) within group (order by {column} {'desc' if upper else 'asc'}) as int)")


def tally() -> list[Column]:
    c = F.col("condition_class")
    return [F.count("*").alias("structures"), F.count_if(c != "Unknown").alias("rated"), *[F.count_if(c == k).alias(k.lower()) for k in codes.CLASSES[:3]], F.count_if(c == "Unknown").alias("unrated")]


def kpi_summary(df: DataFrame, as_of: int) -> DataFrame:
    """Counts by class, percent poor of all rows, upper median age, rounded mean traffic."""
    aged = df.withColumn("_age", F.lit(as_of) - F.col("year_built"))
    out = aged.agg(*tally(), discrete_median("_age", upper=True).alias("median_age"), F.bround(F.avg("traffic")).cast("long").alias("mean_traffic"))
    return out.withColumn("percent_poor", share(F.col("poor"), F.col("structures")))


def with_names(df: DataFrame, names: DataFrame, key: str, what: str = "Area") -> DataFrame:
    """Add `name`: that of `names` (key, name), else what is known of it (`what` and the key), so that no row goes for want of
    a name. Blank names are none; of several names of a key the least is taken."""
    one = names.groupBy(F.col(key).alias("_k")).agg(F.min(F.nullif(F.trim("name"), F.lit(""))).alias("_name"))
    known = F.coalesce("_name", F.concat(F.lit(f"{what} "), F.col(key).cast("string")))
    return df.join(one, F.col(key) == F.col("_k"), "left").withColumn("name", known).drop("_k", "_name")


def vocabulary(groups: DataFrame, labels: DataFrame, group: str, code: str, counted: DataFrame | None = None) -> DataFrame:
    """For each group of a dimension its members as text (`code=label`, in order of the code), null for a group without any,
    and how many rows of `counted` (group, code, n) fall into it (0 if none).

    groups: (group, code), one row a code; a group that has no code of its own has a null one. labels: (code, label); a code
    without a label is no member."""
    told = groups.join(F.broadcast(labels.select(code, "label")), code, "left")
    listed = F.sort_array(F.collect_list(F.when(F.col("label").isNotNull(), F.struct(F.col(code).alias("c"), "label"))))
    members = F.nullif(F.array_join(F.transform(listed, lambda x: F.concat(x["c"], F.lit("="), x["label"])), "; "), F.lit(""))
    out = told.groupBy(group).agg(members.alias("members"))
    if counted is None:
        return out
    sums = counted.groupBy(group).agg(F.sum("n").alias("n"))
    return out.join(sums, group, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def group_tally(df: DataFrame, by: list[str]) -> DataFrame:
    return df.filter("record_type = '1'").groupBy(*by).agg(*tally())


def ranked(groups: DataFrame, key: str, floor: int, top: int) -> DataFrame:
    """The top groups of at least `floor` rated structures by unrounded share of poor, then poor, then key; numbered 1 to top."""
    part = F.try_divide(F.lit(100.0).cast("double") * F.col("poor"), F.col("rated"))
    first = groups.filter(F.col("rated") >= floor).withColumn("_share", part).orderBy(F.desc("_share"), F.desc("poor"), key).limit(top)
    w = Window.orderBy(F.desc("_share"), F.desc("poor"), key)
    return first.withColumns({"rank": F.row_number().over(w), "poor_percent": F.bround("_share", 1)}).drop("_share")


def set_aside(groups: DataFrame, floor: int) -> DataFrame:
    """The sort rule, the floor, and what it leaves out, to travel with a ranking."""
    low = F.col("rated") < floor
    return groups.agg(F.lit("share of poor of rated, descending; poor, descending; key").alias("sort_rule"), F.lit(floor).alias("sample_floor"), F.count_if(~low).alias("groups_ranked"), F.count_if(low).alias("groups_set_aside"), F.coalesce(F.sum(F.when(low, F.col("structures"))), F.lit(0)).alias("structures_set_aside"))


def high_traffic_poor(df: DataFrame, top: int) -> DataFrame:
    """Poor structures with the most traffic, with the number of poor ones whose traffic is unknown."""
    poor = df.filter("record_type = '1' and condition_class = 'Poor'")
    unknown = poor.agg(F.count_if(F.col("traffic").isNull()).alias("without_traffic"))
    return poor.filter("traffic is not null").orderBy(F.desc("traffic"), *KEY).limit(top).select(*KEY, "traffic", "lowest", "year_built").crossJoin(F.broadcast(unknown))


def report_cards(df: DataFrame, areas: DataFrame, history: DataFrame) -> DataFrame:
    """A card for every area that the inventory or the list knows: counts, shares of rated, traffic, upper median year, and
    the yearly history as an array."""
    own = df.filter("record_type = '1'").withColumn("fips", F.concat("state_code", "county_code"))
    cards = own.groupBy("fips").agg(*tally(), F.sum(F.col("traffic").cast("long")).alias("traffic"), discrete_median("year_built", upper=True).alias("median_year"))
    past = history.filter("level = 'county'").groupBy("fips").agg(F.sort_array(F.collect_list(F.struct("vintage_year", "total", "poor"))).alias("history"))
    out = cards.join(areas.select("fips", "name"), "fips", "full_outer").join(past, "fips", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("structures", "rated", "good", "fair", "poor", "unrated")]
    return out.select("fips", F.coalesce("name", F.concat(F.lit("Area "), F.col("fips"))).alias("name"), *counts, share(F.col("poor"), F.col("rated")).alias("poor_percent"), "traffic", "median_year", "history")


def decoded(df: DataFrame, as_of: int) -> DataFrame:
    """Labels, age and public id; material loses leading zeros, design is padded, an unknown code reads as such."""
    spark = df.sparkSession
    table = codes.labels(spark)
    of = lambda kind, key: F.broadcast(table.filter(F.col("kind") == kind).select(F.col("code").alias(key), F.col("label").alias(f"{key}_label")))
    names = F.broadcast(codes.states(spark).select("fips", "usps"))
    out = df.withColumns({"_m": F.regexp_replace("material", "^0+(?=.)", ""), "_d": F.when(F.length("design") < 2, F.lpad("design", 2, "0")).otherwise(F.col("design")), "_r": F.upper(F.col("lowest").cast("string"))})
    out = out.join(of("material", "_m"), "_m", "left").join(of("design", "_d"), "_d", "left").join(of("rating", "_r"), "_r", "left").join(names, F.col("state_code") == F.col("fips"), "left")
    text = lambda c: F.coalesce(c, F.lit("Unknown"))
    return out.select(*KEY, F.concat(F.coalesce("usps", "state_code"), F.lit("-"), F.col("structure_number")).alias("public_id"), text("_m_label").alias("material_label"), text("_d_label").alias("design_label"), text("_r_label").alias("rating_label"), (F.lit(as_of) - F.col("year_built")).alias("age"))
