"""The registered queries: each operator over the whole of the driver's tables, and SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.functions import codes, ratings
from gradeline.operators import checks, crosscheck, export, ingest, panel, serve, spatial, transitions
from gradeline.plans import adapters
from gradeline.plans.adapters import POINT_KEY
from gradeline.plans.oracle import FLOOR, PCT, PKEY, TALLY, _class, _digit, _pad, counts, sql
from gradeline.sources import vintages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
YEAR, REACH, TOP = 2025, 3.0, 10
CK = POINT_KEY


def query(body: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql(body)
        return f

    return register


# shared inputs


def _years(s, d):
    return panel.structure_years(adapters.panel(s, d))


def _rollup(s, d):
    return panel.area_rollup(_years(s, d))


def _pairs(s, d):
    return transitions.cohort_pairs(transitions.component_pairs(_years(s, d)))


def _mapped(s, d):
    return _pairs(s, d).filter("material_group is not null and type_group is not null and region is not null")


def _assigned(s, d):
    return spatial.point_in_polygon(adapters.points(s, d), adapters.polygons(s))


def _outcomes(s, d):
    return crosscheck.outcomes(adapters.points(s, d), _assigned(s, d))


def _disagreements(s, d):
    return crosscheck.disagreements(_outcomes(s, d), adapters.polygons(s))


def _touching(s, d):
    return spatial.touching_polygons(adapters.points(s, d), adapters.polygons(s), CK)


def _nearest(s, d):
    return spatial.nearest_polygon(spatial.unmatched_points(adapters.points(s, d), _assigned(s, d), CK), adapters.polygons(s), CK, REACH)


def _misses(s, d):
    return crosscheck.misses(adapters.points(s, d), _assigned(s, d), _touching(s, d), _nearest(s, d))


def _validated(s, d):
    """Dealt to tasks first: the table's files are few and small, the tests of a row are many."""
    return ingest.validate(adapters.raw_rows(s, d).repartition(4 * s.sparkContext.defaultParallelism, "line_number"), YEAR)


# ratings and codes


@query(f"SELECT deck AS raw, {_digit('deck')} AS rating, count(*) AS n FROM panel GROUP BY ALL")
def strict_digit(s, d):
    return adapters.panel(s, d).groupBy(F.col("deck").alias("raw"), ratings.strict_digit(F.col("deck")).cast("int").alias("rating")).agg(F.count("*").alias("n"))


@query("SELECT vintage_year, state_code, structure_number, lowest FROM sy")
def lowest_rating(s, d):
    return _years(s, d).select(*panel.KEY, "lowest")


@query("SELECT vintage_year, condition_class, count(*) AS n FROM sy GROUP BY ALL")
def condition_class(s, d):
    return _years(s, d).groupBy("vintage_year", "condition_class").agg(F.count("*").alias("n"))


@query("SELECT vintage_year, " + ", ".join(f"count({_digit(c)}) AS n_{c}, CAST(sum({_digit(c)}) AS BIGINT) AS sum_{c}" for c in panel.COMPONENTS) + " FROM panel GROUP BY ALL")
def typed_ratings(s, d):
    t = panel.typed_ratings(adapters.panel(s, d))
    return t.groupBy("vintage_year").agg(*[a for c in panel.COMPONENTS for a in (F.count(f"{c}_num").alias(f"n_{c}"), F.sum(f"{c}_num").alias(f"sum_{c}"))])


@query(f"SELECT p_partkey, {_pad('code', 3)} AS padded FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN ' ' ELSE CAST(p_partkey AS VARCHAR) END AS code FROM part)")
def guarded_pad(s, d):
    code = F.when(F.col("p_partkey") % 10 == 0, " ").otherwise(F.col("p_partkey").cast("string"))
    return adapters.table(s, d, "part").select("p_partkey", ratings.guarded_pad(code, 3).alias("padded"))


@query("SELECT p_partkey, CASE WHEN length(a) <= 2 AND length(b) <= 3 THEN a || b END AS fips FROM (SELECT p_partkey, " + _pad("CAST(p_size AS VARCHAR)", 2) + " AS a, " + _pad("CAST(p_partkey AS VARCHAR)", 3) + " AS b FROM part)")
def composite_key(s, d):
    return adapters.table(s, d, "part").select("p_partkey", ratings.composite_key([(F.col("p_size").cast("string"), 2), (F.col("p_partkey").cast("string"), 3)]).alias("fips"))


@query("SELECT line_number, nullif(trim(structure_number), '') AS structure_number, coalesce(nullif(trim(record_type), ''), '1') AS record_type FROM rawr")
def blank_to_null(s, d):
    return adapters.raw_rows(s, d).select("line_number", ratings.blank_to_null(F.col("structure_number")).alias("structure_number"), ratings.blank_to_null(F.col("record_type"), "1").alias("record_type"))


# panel


@query("SELECT vintage_year, state_code, structure_number, county_code, deck, superstructure, substructure, culvert, material, design, lowest, condition_class FROM sy")
def structure_year(s, d):
    return _years(s, d)


@query("SELECT state_code, structure_number, first_year, last_year, observed_years, ratings FROM ser")
def packed_series(s, d):
    return panel.packed_series(_years(s, d))


@query("SELECT state_code, structure_number, vintage_year, lowest AS rating FROM sy")
def series_expand(s, d):
    return panel.expand_series(panel.packed_series(_years(s, d)))


@query("SELECT state_code, structure_number, ratings, false AS well_formed FROM (SELECT state_code, structure_number, CASE WHEN CAST(structure_number AS BIGINT) % 3 = 0 THEN ratings || '.' ELSE ratings END AS ratings, last_year - first_year + 1 AS n FROM ser) WHERE NOT (regexp_full_match(ratings, '[0-9U]([0-9U.]*[0-9U])?') AND length(ratings) = n)")
def series_wellformed(s, d):
    broken = F.when(F.col("structure_number").cast("bigint") % 3 == 0, F.concat("ratings", F.lit("."))).otherwise(F.col("ratings"))
    df = panel.packed_series(_years(s, d)).withColumn("ratings", broken)
    good = ratings.series_wellformed(F.col("ratings"), F.col("last_year") - F.col("first_year") + 1)
    return df.withColumn("well_formed", good).filter(~F.col("well_formed")).select("state_code", "structure_number", "ratings", "well_formed")


@query("SELECT count(*) AS entities, CAST(sum(observed_years) AS BIGINT) AS observations, count(*) FILTER (observed_years < last_year - first_year + 1) AS with_gaps, count(DISTINCT state_code) AS areas FROM spans")
def series_stats(s, d):
    return panel.series_statistics(panel.packed_series(_years(s, d)))


@query("SELECT * FROM roll")
def area_rollup(s, d):
    return _rollup(s, d)


@query("SELECT *, " + ", ".join(f"{PCT.format(c, 'total', 1)} AS {c}_percent" for c in panel.COUNTS[1:]) + " FROM roll WHERE vintage_year BETWEEN 1996 AND 1999")
def trend_window(s, d):
    return panel.trend_points(_rollup(s, d), 1996, 1999)


@query("SELECT vintage_year, count(*) AS n_rows, count(*) FILTER (record_type = '1') AS type1, count(DISTINCT (state_code, structure_number)) FILTER (record_type = '1') AS kept FROM panel GROUP BY ALL")
def per_year_accounting(s, d):
    return panel.year_accounting(adapters.panel(s, d))


@query("SELECT vintage_year, count(*) AS n_rows FROM panel GROUP BY ALL")
def vintage_counts(s, d):
    return adapters.panel(s, d).groupBy("vintage_year").agg(F.count("*").alias("n_rows"))


@query("SELECT unified, count(*) AS n FROM (SELECT coalesce(nullif(trim(CASE WHEN vintage_year >= 1998 THEN superstructure END), ''), nullif(trim(substructure), '')) AS unified FROM panel) GROUP BY ALL")
def coalesce_renamed(s, d):
    rows = adapters.panel(s, d).withColumn("later", F.when(F.col("vintage_year") >= 1998, F.col("superstructure")))
    return vintages.unified(rows, {"unified": ["later", "substructure", "never"]}, {}).groupBy("unified").agg(F.count("*").alias("n"))


# transitions


@query("SELECT component, rating, count(*) AS n FROM lng GROUP BY ALL")
def component_long(s, d):
    return transitions.component_long(_years(s, d)).groupBy("component", "rating").agg(F.count("*").alias("n"))


@query("SELECT state_code, structure_number, component, from_year, from_rating, to_rating FROM pairs")
def transition_pairs(s, d):
    return transitions.component_pairs(_years(s, d)).select("state_code", "structure_number", "component", "from_year", "from_rating", "to_rating")


@query("SELECT component, type_group, material_group, region, count(*) AS pairs FROM coh GROUP BY ALL")
def cohort_assign(s, d):
    return _pairs(s, d).groupBy(*transitions.COHORT).agg(F.count("*").alias("pairs"))


@query("SELECT code, CAST(count(DISTINCT grp_name) AS INT) AS n_groups FROM (SELECT tc AS code, tg AS grp_name FROM typs UNION ALL SELECT DISTINCT lpad(CAST(p_size AS VARCHAR), 2, '0'), 'Extra' FROM part) GROUP BY ALL HAVING count(DISTINCT grp_name) > 1")
def lookup_disjoint(s, d):
    extra = adapters.table(s, d, "part").select(F.lpad(F.col("p_size").cast("string"), 2, "0").alias("code"), F.lit("Extra").alias("grp")).distinct()
    return codes.overlapping_codes(codes.groups(s, codes.TYPE_ROWS, "code", "grp").union(extra), "code", "grp")


@query("SELECT * FROM mrows")
def matrix_rows(s, d):
    return transitions.matrix_rows(_mapped(s, d))


@query("SELECT * FROM cells")
def matrix_cells(s, d):
    return transitions.matrix_cells(_mapped(s, d))


_SH = "round(100.0::DOUBLE * sum(CASE WHEN {} THEN pairs ELSE 0 END) / sum(pairs), 2)"


@query(f"SELECT component, CAST(sum(pairs) AS BIGINT) AS pairs, {_SH.format('from_rating = to_rating')} AS unchanged_percent, {_SH.format('to_rating < from_rating')} AS declined_percent, {_SH.format('to_rating > from_rating')} AS improved_percent FROM cells WHERE region = 'All' GROUP BY ALL")
def movement(s, d):
    return transitions.movement(transitions.matrix_cells(_mapped(s, d)))


@query(f"SELECT {FLOOR} AS sample_floor, count(*) AS n_rows, count(*) FILTER (row_total < {FLOOR}) AS rows_below, CAST(sum(row_total) AS BIGINT) AS pairs, CAST(sum(CASE WHEN row_total < {FLOOR} THEN row_total ELSE 0 END) AS BIGINT) AS pairs_below FROM mrows WHERE region <> 'All'")
def floor_diagnostic(s, d):
    return transitions.floor_diagnostic(transitions.matrix_rows(_mapped(s, d)), FLOOR)


@query(f"SELECT * FROM mrows WHERE row_total >= {FLOOR} AND year_pairs_observed <= 3")
def narrow_span(s, d):
    return transitions.narrow_span(transitions.matrix_rows(_mapped(s, d)), FLOOR, 3)


@query("SELECT count(*) AS component_pairs, count(DISTINCT (state_code, structure_number, from_year)) AS structure_pairs, count(DISTINCT (type_group, material_group, region)) AS cohorts FROM mapped")
def transition_totals(s, d):
    return transitions.totals(_mapped(s, d))


@query(f"SELECT n.component, a.i AS from_rating, b.i AS to_rating, coalesce(row_total, 0) AS row_total, coalesce(pairs, 0) AS pairs, CASE WHEN row_total >= {FLOOR} THEN round_even(100.0::DOUBLE * coalesce(pairs, 0) / row_total, 1) END AS rate FROM (SELECT DISTINCT component FROM mrows WHERE region = 'All') n CROSS JOIN (SELECT CAST(unnest(range(10)) AS INT) AS i) a CROSS JOIN (SELECT CAST(unnest(range(10)) AS INT) AS i) b LEFT JOIN (SELECT * FROM mrows WHERE region = 'All') r ON r.component = n.component AND r.from_rating = a.i LEFT JOIN (SELECT * FROM cells WHERE region = 'All') c ON c.component = n.component AND c.from_rating = a.i AND c.to_rating = b.i")
def matrix_grid(s, d):
    return transitions.matrix_grid(transitions.matrix_rows(_mapped(s, d)), transitions.matrix_cells(_mapped(s, d)), FLOOR)


@query(f"SELECT component, type_group, material_group, region, CAST(sum(row_total) FILTER (row_total >= {FLOOR}) AS BIGINT) AS pairs_above_floor, round_even(100.0::DOUBLE * sum(coalesce(pairs, 0)) FILTER (row_total >= {FLOOR}) / nullif(sum(row_total) FILTER (row_total >= {FLOOR}), 0), 1) AS unchanged_percent FROM mrows LEFT JOIN (SELECT component, type_group, material_group, region, from_rating, pairs FROM cells WHERE from_rating = to_rating) USING (component, type_group, material_group, region, from_rating) GROUP BY ALL")
def unchanged_share(s, d):
    return transitions.unchanged_share(transitions.matrix_rows(_mapped(s, d)), transitions.matrix_cells(_mapped(s, d)), FLOOR)


@query(f"SELECT component, type_group, material_group, region, pairs, n_rows, rows_above_floor, cohort_pairs, is_national, place FROM (SELECT component, type_group, material_group, region, CAST(sum(row_total) AS BIGINT) AS pairs, count(*) AS n_rows, count(*) FILTER (row_total >= {FLOOR}) AS rows_above_floor FROM mrows GROUP BY ALL) JOIN (SELECT *, region = 'All' AS is_national, CAST(row_number() OVER (ORDER BY region = 'All' DESC, cohort_pairs DESC, type_group, material_group, region) AS INT) AS place FROM (SELECT type_group, material_group, region, CAST(sum(row_total) AS BIGINT) AS cohort_pairs FROM mrows GROUP BY ALL)) USING (type_group, material_group, region)")
def cohort_catalog(s, d):
    return transitions.cohort_catalog(transitions.matrix_rows(_mapped(s, d)), FLOOR)


@query("SELECT type_group, string_agg(code || '=' || label, '; ' ORDER BY code) AS members, CAST(sum(n) AS BIGINT) AS structure_years FROM (SELECT CASE WHEN design IS NULL THEN 'Not published' ELSE tg END AS type_group, tc AS code, label, n FROM (SELECT design, count(*) AS n FROM sy GROUP BY ALL) x LEFT JOIN typs ON design = tc LEFT JOIN labs ON kind = 'design' AND code = tc) GROUP BY ALL")
def dimension_vocab(s, d):
    per = codes.with_cohort(_years(s, d)).groupBy("type_group", "design").agg(F.count("*").alias("n"))
    names = codes.labels(s).filter("kind = 'design'").select(F.col("code").alias("design"), "label")
    return serve.vocabulary(per.select("type_group", "design"), names, "type_group", "design", per).withColumnRenamed("n", "structure_years")


# ingest


@query("SELECT line_number, round(lat, 9) AS lat, round(lon, 9) AS lon, fault FROM vco")
def dms_decode(s, d):
    found = ratings.decode_dms(F.col("lat_raw"), F.col("lon_raw"))
    return adapters.raw_rows(s, d).select("line_number", F.round(found["lat"], 9).alias("lat"), F.round(found["lon"], 9).alias("lon"), found["fault"].alias("fault"))


@query("SELECT state, fips, usps, count(*) AS n FROM resolved GROUP BY ALL")
def state_resolve(s, d):
    return ingest.resolve_state(adapters.raw_rows(s, d), "state").groupBy("state", "fips", "usps").agg(F.count("*").alias("n"))


@query("SELECT line_number, south IS NULL OR (lat BETWEEN south AND north AND lon BETWEEN west AND east) AS inside FROM vco WHERE fault IS NULL AND fips IS NOT NULL")
def bounds_check(s, d):
    found = ratings.decode_dms(F.col("lat_raw"), F.col("lon_raw"))
    df = ingest.with_state(adapters.raw_rows(s, d), "state").withColumns(found).filter("fault is null and fips is not null")
    return df.select("line_number", ingest.inside_bounds(F.col("lat"), F.col("lon")).alias("inside"))


@query("SELECT line_number, array_to_string(reasons, ',') AS reasons FROM val")
def validate_reasons(s, d):
    return _validated(s, d).select("line_number", F.array_join("reasons", ",").alias("reasons"))


@query(f"SELECT line_number, fips AS state_code, {_pad('county', 3)} AS county_code, trim(structure_number) AS structure_number, coalesce(nullif(trim(record_type), ''), '1') AS record_type, {_pad('design', 2)} AS design, yb AS year_built, ad AS adt, CAST(ln AS DOUBLE) AS length_m, {_class('lw')} AS condition_class FROM (SELECT *, least({_digit('deck')}, {_digit('superstructure')}, {_digit('substructure')}, {_digit('culvert')}) AS lw FROM val WHERE len(reasons) = 0)")
def canonical_row(s, d):
    valid = _validated(s, d).filter(F.size("reasons") == 0)
    rows = ingest.canonical(valid, YEAR, "line_number")
    return rows.withColumn("length_m", F.col("length_m").cast("double")).drop("material", "lowest", "snapshot_year")


@query("SELECT line_number, array_to_string(reasons, ',') AS reasons FROM fvw WHERE len(reasons) = 0 OR reasons[1] = 'duplicate_key'")
def first_valid_wins(s, d):
    # validated once: the rows are looked at for their keys, the first of each and the rest
    path = f"{adapters.scratch(s)}/validated"
    _validated(s, d).select("line_number", "fips", F.trim("structure_number").alias("_number"), "record_type", "reasons").write.parquet(path)
    out = ingest.first_valid_wins(s.read.parquet(path), ["fips", "_number", "record_type"], "line_number")
    return out.filter((F.size("reasons") == 0) | (F.get("reasons", 0) == "duplicate_key")).select("line_number", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT reason, count(*) AS n_rows FROM (SELECT unnest(reasons) AS reason FROM val) GROUP BY ALL")
def quarantine_by_reason(s, d):
    return ingest.quarantine_by_reason(_validated(s, d))


@query("SELECT state, count(*) AS n_rows FROM val WHERE len(reasons) > 0 GROUP BY ALL ORDER BY n_rows DESC, state LIMIT 15")
def quarantine_by_state(s, d):
    return ingest.quarantine_by_state(_validated(s, d))


@query("SELECT user_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_latest(s, d):
    events = adapters.table(s, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    old, new = events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")
    both = ingest.upsert(ingest.latest(old, ["user_id"], ["ts", "event_id"]), ingest.latest(events.join(new.select("user_id").distinct(), "user_id", "left_semi"), ["user_id"], ["ts", "event_id"]), ["user_id"])
    return both.select("user_id", "event_type", F.round("value", 6).alias("value"))


@query("SELECT k AS prop, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY ALL")
def json_props(s, d):
    return vintages.manifest_rows(adapters.table(s, d, "events"), "props", key="prop").groupBy("prop").agg(F.count("*").alias("n"))


@query("SELECT geoid, population, count(*) AS n FROM pop GROUP BY ALL")
def prefix_key_sentinel(s, d):
    return crosscheck.population(adapters.population_lines(s, d), "0500000US", 5).groupBy("geoid", "population").agg(F.count("*").alias("n"))


# spatial and cross-check


@query(f"SELECT {PKEY}, lon, lat FROM inv WHERE lon BETWEEN 10 AND 20 AND lat BETWEEN 5 AND 15")
def bbox_filter(s, d):
    return adapters.inventory(s, d).filter(spatial.in_box(F.col("lon"), F.col("lat"), 10, 5, 20, 15)).select(*CK, "lon", "lat")


@query(f"SELECT {PKEY}, geoid FROM pip")
def point_in_polygon(s, d):
    return _assigned(s, d).select(*CK, "geoid")


@query("SELECT * FROM touch")
def touching_polygons(s, d):
    return _touching(s, d)


@query(f"SELECT {PKEY}, b[2] AS nearest_geoid, b[1] AS distance_m FROM near")
def nearest_polygon(s, d):
    return _nearest(s, d)


@query("SELECT point, geoid FROM ain")
def points_in_areas(s, d):
    return spatial.point_in_polygon(adapters.area_points(s, d), adapters.drawn_areas(s, d), many=True).select("point", "geoid")


@query("SELECT point, CAST(count(*) AS INT) AS touching, min(geoid) AS first_geoid FROM aedge WHERE odd OR onb GROUP BY 1")
def areas_touching(s, d):
    return spatial.touching_polygons(adapters.area_points(s, d), adapters.drawn_areas(s, d), ["point"], many=True)


@query("SELECT point, b[2] AS nearest_geoid, b[1] AS distance_m FROM anear")
def nearest_areas(s, d):
    points, areas = adapters.area_points(s, d), adapters.drawn_areas(s, d)
    # written once: its places are told before it meets the areas
    path = f"{adapters.scratch(s)}/missed"
    spatial.outside_polygons(points, areas, ["point"], many=True).write.parquet(path)
    return spatial.nearest_polygon(s.read.parquet(path), areas, ["point"], adapters.AREA_REACH, many=True)


@query("SELECT * FROM unm")
def unmatched_points(s, d):
    return spatial.unmatched_points(adapters.points(s, d), _assigned(s, d), CK)


@query(f"SELECT {PKEY}, published, geoid, outcome FROM outc")
def crosscheck_outcome(s, d):
    return _outcomes(s, d).select(*CK, "published", "geoid", "outcome")


@query("SELECT * FROM cov")
def coverage(s, d):
    return crosscheck.coverage(_outcomes(s, d))


@query("SELECT * FROM dis")
def disagreement_pairs(s, d):
    return _disagreements(s, d)


@query("SELECT substr(published, 1, 2) AS state_fips, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(structures) AS BIGINT) AS structures, count(*) AS pairs, CAST(sum(CASE WHEN NOT current THEN n_rows ELSE 0 END) AS BIGINT) AS rows_retired FROM dis WHERE published IS NOT NULL GROUP BY ALL HAVING sum(n_rows) > 0")
def disagreement_by_state(s, d):
    return crosscheck.by_state(_disagreements(s, d))


@query("SELECT published, count(*) AS n_rows FROM pts WHERE published IS NOT NULL AND published NOT IN (SELECT geoid FROM polys) GROUP BY ALL")
def retired_codes(s, d):
    return crosscheck.retired_codes(adapters.points(s, d), adapters.polygons(s))


@query("SELECT CASE WHEN reason = 'on_boundary' THEN 'on a boundary' WHEN distance_m IS NULL THEN 'beyond the radius' WHEN distance_m < 100 THEN 'under 100 m' WHEN distance_m < 1000 THEN '100 m to 1 km' WHEN distance_m < 10000 THEN '1 km to 10 km' ELSE 'over 10 km' END AS bucket, count(*) AS misses FROM miss GROUP BY ALL")
def miss_buckets(s, d):
    return crosscheck.miss_buckets(_misses(s, d))


@query("SELECT reason, count(*) AS n_rows, count(DISTINCT (state_code, structure_number)) AS structures, quantile_disc(distance_m, 0.5) AS median_m, max(distance_m) AS max_m FROM miss GROUP BY ALL")
def miss_summary(s, d):
    return crosscheck.miss_summary(_misses(s, d))


@query(f"SELECT d.published, d.geoid, n_rows, b.name AS published_name, a.name AS containing_name FROM (SELECT * FROM dis ORDER BY n_rows DESC, published NULLS LAST, geoid LIMIT {TOP}) d JOIN polys a ON a.geoid = d.geoid LEFT JOIN polys b ON b.geoid = d.published")
def top_disagreements(s, d):
    return crosscheck.top_disagreements(_disagreements(s, d), adapters.polygons(s), TOP)


@query("SELECT geoid, 'left' AS only_in FROM (SELECT geoid FROM polys EXCEPT SELECT geoid FROM pop) UNION ALL SELECT geoid, 'right' FROM (SELECT geoid FROM pop EXCEPT SELECT geoid FROM polys)")
def key_alignment(s, d):
    return crosscheck.key_alignment(adapters.polygons(s), crosscheck.population(adapters.population_lines(s, d), "0500000US", 5), "geoid")


@query("SELECT p.geoid, name, population, CASE WHEN q.geoid IS NULL THEN 'not listed' WHEN population IS NULL THEN 'not published' ELSE 'published' END AS status FROM polys p LEFT JOIN pop1 q ON p.geoid = q.geoid")
def left_absence(s, d):
    people = crosscheck.population(adapters.population_lines(s, d), "0500000US", 5).groupBy("geoid").agg(F.max("population").alias("population"))
    return crosscheck.with_population(adapters.polygons(s).select("geoid", "name"), people, "geoid")


@query("SELECT published, geoid, n_rows FROM (SELECT published, geoid, CASE WHEN published IS NULL OR substr(published, 1, 2) = '01' THEN -n_rows ELSE n_rows END AS n_rows FROM dis)")
def nullsafe_upsert(s, d):
    have = _disagreements(s, d).select("published", "geoid", "n_rows")
    new = have.filter("published is null or substring(published, 1, 2) = '01'").withColumn("n_rows", -F.col("n_rows"))
    return ingest.upsert(have, new, ["published", "geoid"])


@query("SELECT count(*) AS n_lines, count(DISTINCT geoid) AS areas, count(*) FILTER (population IS NULL) AS without_value, CAST(sum(population) AS BIGINT) AS people, count(*) FILTER (NOT regexp_full_match(geoid, '[0-9]{5}')) AS malformed FROM pop")
def staging_reconcile(s, d):
    return crosscheck.population_report(crosscheck.population(adapters.population_lines(s, d), "0500000US", 5))


@query("SELECT vintage_year, n_rows, n_rows + 1 AS stated FROM (SELECT vintage_year, count(*) AS n_rows FROM panel GROUP BY ALL) WHERE vintage_year % 2 = 0")
def vintage_reconcile(s, d):
    rows = adapters.panel(s, d)
    even = (F.col("vintage_year") % 2 == 0).cast("int")
    manifest = rows.groupBy("vintage_year").agg(F.count("*").alias("n")).select("vintage_year", (F.col("n") + even).alias("stated"))
    return vintages.differing_counts(rows, manifest, "vintage_year", "stated")


# serving

_BASIC = f"{PKEY}, condition_class, traffic, year_built"
_COLS = [*CK, "condition_class", "traffic", "year_built"]


@query(f"SELECT {_BASIC} FROM inv WHERE condition_class IN ('Poor', 'Fair') AND material IN ('1', '2', '3') AND year_built BETWEEN 1920 AND 1990 AND traffic >= 500 AND lon BETWEEN 2 AND 35 AND lat BETWEEN 1 AND 25")
def inventory_filter(s, d):
    return serve.inventory_filter(adapters.inventory(s, d), classes=["Poor", "Fair"], materials=["1", "2", "3"], years=(1920, 1990), min_traffic=500, box=(2, 1, 35, 25)).select(*_COLS)


@query(f"SELECT {_BASIC} FROM inv WHERE design IN (SELECT tc FROM typs WHERE tg IN ('Culvert', 'Truss / Arch'))")
def type_group_filter(s, d):
    return serve.of_type_group(adapters.inventory(s, d), ["Culvert", "Truss / Arch"]).select(*_COLS)


@query(f"SELECT {_BASIC} FROM inv WHERE state_code = '21' AND structure_number = '20' ORDER BY record_type LIMIT 1")
def keyed_lookup(s, d):
    return serve.keyed_lookup(adapters.inventory(s, d), "21", "20").select(*_COLS)


@query(f"SELECT {_BASIC}, (SELECT count(*) FROM inv) AS total FROM inv ORDER BY {PKEY} LIMIT 50 OFFSET 100")
def page(s, d):
    return serve.page(adapters.inventory(s, d).select(*_COLS), CK, 100, 50)


@query(f"SELECT {TALLY}, quantile_disc(age, 0.5 ORDER BY age DESC) AS median_age, CAST(round_even(avg(traffic), 0) AS BIGINT) AS mean_traffic, round_even(100.0::DOUBLE * count(*) FILTER (condition_class = 'Poor') / count(*), 1) AS percent_poor FROM (SELECT *, 2025 - year_built AS age FROM inv)".replace("quantile_disc(age, 0.5 ORDER BY age DESC)", "(list_sort(list(age) FILTER (age IS NOT NULL)))[count(age) // 2 + 1]"))
def kpi_summary(s, d):
    return serve.kpi_summary(adapters.inventory(s, d), YEAR)


_RANK = "SELECT *, row_number() OVER (ORDER BY share DESC, poor DESC, {k}) AS rank FROM (SELECT *, 100.0::DOUBLE * poor / rated AS share FROM ({g}) WHERE rated >= {f} ORDER BY share DESC, poor DESC, {k} LIMIT {n})"


def _rank(keys: str, k: str) -> str:
    g = f"SELECT {keys}, {TALLY} FROM inv LEFT JOIN mats ON material = mc WHERE record_type = '1' GROUP BY ALL"
    return f"SELECT * EXCLUDE (share), round_even(share, 1) AS poor_percent FROM ({_RANK.format(k=k, g=g, f=FLOOR, n=TOP)})"


@query(_rank("state_code", "state_code"))
def rank_state(s, d):
    return serve.ranked(serve.group_tally(adapters.inventory(s, d), ["state_code"]), "state_code", FLOOR, TOP)


@query(f"SELECT r.*, coalesce(name, 'Area ' || fips) AS name FROM ({_rank('state_code || county_code AS fips', 'fips')}) r LEFT JOIN polys ON geoid = fips")
def rank_area(s, d):
    own = adapters.inventory(s, d).withColumn("fips", F.concat("state_code", "county_code"))
    top = serve.ranked(serve.group_tally(own, ["fips"]), "fips", FLOOR, TOP)
    return serve.with_names(top, adapters.polygons(s).select(F.col("geoid").alias("fips"), "name"), "fips")


@query(_rank("coalesce(mg, 'Unknown code') AS cohort", "cohort"))
def rank_cohort(s, d):
    table = codes.groups(s, codes.MATERIAL_ROWS, "material", "cohort")
    own = adapters.inventory(s, d).join(F.broadcast(table), "material", "left").withColumn("cohort", F.coalesce("cohort", F.lit("Unknown code")))
    return serve.ranked(serve.group_tally(own, ["cohort"]), "cohort", FLOOR, TOP)


@query("SELECT 'share of poor of rated, descending; poor, descending; key' AS sort_rule, 20 AS sample_floor, count(*) FILTER (rated >= 20) AS groups_ranked, count(*) FILTER (rated < 20) AS groups_set_aside, CAST(coalesce(sum(CASE WHEN rated < 20 THEN structures END), 0) AS BIGINT) AS structures_set_aside FROM grp")
def rank_set_aside(s, d):
    return serve.set_aside(serve.group_tally(adapters.inventory(s, d), ["state_code"]), 20)


@query(f"SELECT {PKEY}, traffic, lowest, year_built, (SELECT count(*) FROM inv WHERE record_type = '1' AND condition_class = 'Poor' AND traffic IS NULL) AS without_traffic FROM inv WHERE record_type = '1' AND condition_class = 'Poor' AND traffic IS NOT NULL ORDER BY traffic DESC, {PKEY} LIMIT {TOP}")
def high_traffic_poor(s, d):
    return serve.high_traffic_poor(adapters.inventory(s, d), TOP)


@query(f"SELECT fips, coalesce(name, 'Area ' || fips) AS name, coalesce(structures, 0) AS structures, coalesce(rated, 0) AS rated, coalesce(poor, 0) AS poor, {PCT.format('poor', 'rated', 1)} AS poor_percent, traffic, median_year, n_history FROM (SELECT coalesce(c.fips, p.geoid) AS fips, name, structures, rated, poor, traffic, median_year FROM (SELECT state_code || county_code AS fips, {TALLY}, CAST(sum(traffic) AS BIGINT) AS traffic, (list_sort(list(year_built) FILTER (year_built IS NOT NULL)))[count(year_built) // 2 + 1] AS median_year FROM inv WHERE record_type = '1' GROUP BY 1) c FULL JOIN polys p ON c.fips = p.geoid) LEFT JOIN (SELECT fips, CAST(count(*) AS INT) AS n_history FROM roll WHERE level = 'county' GROUP BY 1) USING (fips)")
def report_card(s, d):
    cards = serve.report_cards(adapters.inventory(s, d), adapters.polygons(s).select(F.col("geoid").alias("fips"), "name"), _rollup(s, d))
    return cards.select("fips", "name", "structures", "rated", "poor", "poor_percent", "traffic", "median_year", F.when(F.col("history").isNotNull(), F.size("history")).alias("n_history"))


@query("SELECT max(vintage_year) AS latest FROM panel")
def latest_snapshot(s, d):
    return adapters.panel(s, d).agg(F.max("vintage_year").alias("latest"))


@query("SELECT state_code, (list_sort(list(year_built) FILTER (year_built IS NOT NULL)))[count(year_built) // 2 + 1] AS upper_median, (list_sort(list(traffic) FILTER (traffic IS NOT NULL)))[(count(traffic) - 1) // 2 + 1] AS lower_median FROM inv GROUP BY ALL")
def discrete_medians(s, d):
    return adapters.inventory(s, d).groupBy("state_code").agg(serve.discrete_median("year_built", upper=True).alias("upper_median"), serve.discrete_median("traffic").alias("lower_median"))


_DECODED = f"SELECT i.state_code, structure_number, record_type, coalesce(usps, i.state_code) || '-' || structure_number AS public_id, coalesce(m.label, 'Unknown') AS material_label, coalesce(g.label, 'Unknown') AS design_label, coalesce(r.label, 'Unknown') AS rating_label, 2025 - year_built AS age FROM inv i LEFT JOIN labs m ON m.kind = 'material' AND m.code = material LEFT JOIN labs g ON g.kind = 'design' AND g.code = design LEFT JOIN labs r ON r.kind = 'rating' AND r.code = CAST(lowest AS VARCHAR) LEFT JOIN states ON fips = i.state_code"


@query(_DECODED)
def detail_decoded(s, d):
    return serve.decoded(adapters.inventory(s, d), YEAR)


@query(f"SELECT material_label, design_label, count(*) AS n FROM ({_DECODED}) GROUP BY ALL")
def decode_labels(s, d):
    return serve.decoded(adapters.inventory(s, d), YEAR).groupBy("material_label", "design_label").agg(F.count("*").alias("n"))


@query("SELECT kind, code, label, count(structure_number) AS used FROM labs LEFT JOIN inv ON (kind = 'material' AND material = code) OR (kind = 'design' AND design = code) OR (kind = 'rating' AND CAST(lowest AS VARCHAR) = code) GROUP BY ALL")
def lookup_tables(s, d):
    used = adapters.inventory(s, d).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("code")) for k, c in (("material", "material"), ("design", "design"), ("rating", "lowest"))])).alias("u")).select("u.*")
    per = used.filter("code is not null").groupBy("kind", "code").agg(F.count("*").alias("used"))
    return codes.labels(s).join(per, ["kind", "code"], "left").withColumn("used", F.coalesce("used", F.lit(0)))


# export


@query("SELECT state_code || '-' || structure_number || '-' || record_type AS id, lon, lat, condition_class FROM inv")
def geojson_lines(s, d):
    lines = export.geojson_lines(adapters.inventory(s, d), F.concat_ws("-", *CK), ["condition_class"])
    parsed = F.from_json("line", "id string, geometry struct<coordinates: array<double>>, properties struct<condition_class: string>")
    return lines.select(parsed.alias("f")).select("f.id", F.get("f.geometry.coordinates", 0).alias("lon"), F.get("f.geometry.coordinates", 1).alias("lat"), "f.properties.condition_class")


@query("SELECT count(*) AS total, least(count(*), 500) AS returned, count(*) > 500 AS truncated, least(count(*), 500) AS n_features FROM inv")
def capped_features(s, d):
    out = export.capped_features(adapters.inventory(s, d), CK, F.concat_ws("-", *CK), ["condition_class"], 500)
    return out.select("total", "returned", "truncated", F.size("features").cast("long").alias("n_features"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(t, '[\",]') THEN '\"' || replace(t, '\"', '\"\"') || '\"' ELSE t END AS field FROM (SELECT p_partkey, replace(CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 = 1 THEN p_name || ', ' || p_brand WHEN p_size % 5 = 2 THEN '\"' || p_brand || '\"' WHEN p_size % 5 = 3 THEN p_name || chr(10) || p_type ELSE p_type END, chr(10), ' ') AS t FROM part)")
def csv_escape(s, d):
    text = F.expr("case when p_size % 5 = 0 then null when p_size % 5 = 1 then concat(p_name, ', ', p_brand) when p_size % 5 = 2 then concat('\"', p_brand, '\"') when p_size % 5 = 3 then concat(p_name, chr(10), p_type) else p_type end")
    return adapters.table(s, d, "part").select("p_partkey", export.csv_field(text).alias("field"))


# checks, each on an input that is wrong on purpose


def _broken(s, d):
    odd = (F.col("vintage_year") == 1997) & (F.col("level") == "state")
    return _rollup(s, d).withColumn("total", F.when(odd & (F.col("fips") == "07"), F.col("total") - 1).when(odd & (F.col("fips") == "09"), 1).otherwise(F.col("total")))


_BROKEN = "(SELECT level, fips, vintage_year, CAST(CASE WHEN vintage_year = 1997 AND level = 'state' AND fips = '07' THEN total - 1 WHEN vintage_year = 1997 AND level = 'state' AND fips = '09' THEN 1 ELSE total END AS INT) AS total, good, fair, poor, unknown FROM roll)"


@query(f"SELECT vintage_year, CAST(rolled AS BIGINT) AS rolled, counted FROM (SELECT vintage_year, sum(total) AS rolled FROM {_BROKEN} WHERE level = 'state' GROUP BY 1) JOIN (SELECT vintage_year, count(*) AS counted FROM sy GROUP BY 1) USING (vintage_year) WHERE rolled <> counted")
def check_state_totals(s, d):
    return checks.state_totals(_broken(s, d), _years(s, d))


@query(f"SELECT * FROM {_BROKEN} WHERE good + fair + poor + unknown <> total")
def check_partition(s, d):
    return checks.partition(_broken(s, d))


@query(f"SELECT fips, vintage_year, CAST(counties AS BIGINT) AS counties, total FROM (SELECT substr(fips, 1, 2) AS fips, vintage_year, sum(total) AS counties FROM {_BROKEN} WHERE level = 'county' GROUP BY ALL) JOIN (SELECT fips, vintage_year, total FROM {_BROKEN} WHERE level = 'state') USING (fips, vintage_year) WHERE counties > total")
def check_within_parent(s, d):
    return checks.within_parent(_broken(s, d))


@query(f"SELECT coalesce(a.fips, b.fips) AS fips, coalesce(a.vintage_year, b.vintage_year) AS vintage_year, a.total AS series_total, b.total AS rollup_total FROM (SELECT * FROM roll WHERE level = 'state') a FULL JOIN (SELECT * FROM {_BROKEN} WHERE level = 'state') b ON a.fips = b.fips AND a.vintage_year = b.vintage_year WHERE row(a.total, a.good, a.fair, a.poor, a.unknown) IS DISTINCT FROM row(b.total, b.good, b.fair, b.poor, b.unknown)")
def check_series_vs_rollup(s, d):
    return checks.series_vs_rollup(panel.packed_series(_years(s, d)), _broken(s, d))


@query("SELECT state_code, material, design, count(*) AS pairs FROM coh WHERE material_group IS NULL OR type_group IS NULL OR region IS NULL GROUP BY ALL")
def check_unmapped(s, d):
    return checks.unmapped(_pairs(s, d))


@query("SELECT state_code, structure_number, component, from_year, CASE WHEN from_rating = 9 THEN 10 ELSE from_rating END AS from_rating, to_rating FROM pairs WHERE from_rating = 9")
def check_pair_shape(s, d):
    bad = _pairs(s, d).withColumn("from_rating", F.when(F.col("from_rating") == 9, 10).otherwise(F.col("from_rating")))
    return checks.pair_shape(bad).select("state_code", "structure_number", "component", "from_year", "from_rating", "to_rating")


@query("SELECT component, type_group, material_group, region, from_rating, row_total, row_total - 1 AS cells FROM mrows WHERE from_rating = 4")
def check_row_totals(s, d):
    cells = transitions.matrix_cells(_mapped(s, d))
    first = cells.groupBy(*transitions.COHORT, "from_rating").agg(F.min("to_rating").alias("to_rating")).filter("from_rating = 4").withColumn("less", F.lit(1))
    bad = cells.join(first, [*transitions.COHORT, "from_rating", "to_rating"], "left").withColumn("pairs", F.col("pairs") - F.coalesce("less", F.lit(0))).drop("less")
    return checks.row_totals(transitions.matrix_rows(_mapped(s, d)), bad)


@query("SELECT component, from_rating, to_rating, pairs + 1 AS national, pairs AS summed FROM cells WHERE region = 'All' AND from_rating = 5")
def check_national_sum(s, d):
    more = (F.col("region") == codes.NATIONAL) & (F.col("from_rating") == 5)
    return checks.national_sum(transitions.matrix_cells(_mapped(s, d)).withColumn("pairs", F.col("pairs") + more.cast("int")))


@query("SELECT component, 'All' AS type_group, material_group, region, from_rating FROM mrows WHERE region = 'West'")
def check_sentinel(s, d):
    bad = F.when(F.col("region") == "West", codes.NATIONAL).otherwise(F.col("type_group"))
    return checks.sentinel(transitions.matrix_rows(_mapped(s, d)).withColumn("type_group", bad))


@query("SELECT component, type_group, material_group, region, from_rating, last_from_year + 1 AS stated, last_from_year AS found FROM mrows WHERE region = 'All' AND from_rating = 3")
def check_span(s, d):
    late = (F.col("region") == codes.NATIONAL) & (F.col("from_rating") == 3)
    return checks.span(transitions.matrix_rows(_mapped(s, d)).withColumn("last_from_year", F.col("last_from_year") + late.cast("int")), _mapped(s, d))


@query(f"SELECT {PKEY}, 2::BIGINT AS n_rows FROM pip WHERE geoid = '01003'")
def check_unique(s, d):
    a = _assigned(s, d)
    return checks.unique(a.union(a.filter("geoid = '01003'")), CK)


@query(f"SELECT {PKEY}, 1::BIGINT AS given, NULL::BIGINT AS found FROM pip WHERE geoid = '02003'")
def check_reconciles(s, d):
    a, p = _assigned(s, d), adapters.points(s, d)
    return checks.reconciles(p, a.filter("geoid <> '02003'"), spatial.unmatched_points(p, a, CK), CK)


@query("SELECT n_points, n_points AS points_again, matched, matched - (SELECT count(*) FROM pip WHERE geoid = '01001') AS matched_again FROM cov")
def check_coverage(s, d):
    return checks.coverage_recount(crosscheck.coverage(_outcomes(s, d)), adapters.points(s, d), _assigned(s, d).filter("geoid <> '01001'"))


@query("SELECT count(*) FILTER (outcome <> 'unmatched') AS matched, count(*) FILTER (outcome <> 'unmatched' AND published IS NOT NULL) AS coded, count(*) FILTER (outcome IN ('agree', 'other_county')) AS same_state FROM outc")
def check_sign(s, d):
    return checks.sign(_outcomes(s, d))


@query("SELECT substr(published, 1, 4) AS published, count(*) AS n_rows FROM pts WHERE published = '99001' GROUP BY ALL")
def check_key_shape(s, d):
    bad = F.when(F.col("published") == "99001", F.substring("published", 1, 4)).otherwise(F.col("published"))
    return checks.key_shape(adapters.points(s, d).withColumn("published", bad), "published")


@query(f"SELECT {PKEY}, reason, touching + 1 AS touching, touching AS again FROM miss WHERE reason = 'on_boundary'")
def check_miss_reason(s, d):
    more = (F.col("reason") == "on_boundary").cast("int")
    return checks.miss_reason(_misses(s, d).withColumn("touching", F.col("touching") + more), _touching(s, d), CK)


@query("SELECT CAST(sum(n_rows) AS BIGINT) AS pair_rows, count(*) FILTER (geoid = '01001') AS unresolved, CAST(0 AS BIGINT) AS malformed, (SELECT other_county + other_state + no_code FROM cov) AS outcome_rows FROM dis WHERE outcome <> 'no_code'")
def check_disagreement(s, d):
    return checks.disagreement_account(_disagreements(s, d).filter("outcome <> 'no_code'"), crosscheck.coverage(_outcomes(s, d)), adapters.polygons(s).filter("geoid <> '01001'"))


@query("SELECT DISTINCT 'region' AS dimension, 'All' AS value FROM mapped WHERE region = 'West'")
def check_reserved_value(s, d):
    rows = _mapped(s, d).withColumn("region", F.when(F.col("region") == "West", codes.NATIONAL).otherwise(F.col("region")))
    return checks.reserved_value({c: rows.select(c) for c in ("type_group", "material_group", "region")})


@query("SELECT substr(p.geoid, 1, 2) AS state_fips, count(*) AS areas FROM polys p LEFT JOIN pop1 q ON p.geoid = q.geoid WHERE population IS NULL GROUP BY ALL")
def absent_population(s, d):
    people = crosscheck.population(adapters.population_lines(s, d), "0500000US", 5).groupBy("geoid").agg(F.max("population").alias("population"))
    return crosscheck.absent_population(crosscheck.with_population(adapters.polygons(s).select("geoid", "name"), people, "geoid"))


@query("SELECT count(*) AS n_read, count(*) FILTER (len(reasons) > 0) AS n_rejected, " + PCT.format("count(*) FILTER (len(reasons) > 0)", "count(*)", 2) + " AS rejected_percent FROM val")
def reject_rate(s, d):
    return ingest.reject_rate(_validated(s, d))
