"""DuckDB SQL of the registered queries, put together from named CTEs."""

from __future__ import annotations

import re

from gradeline.functions import codes
from gradeline.operators.panel import COMPONENTS
from gradeline.plans.adapters import AREA_BASE, AREA_POINTS, AREA_REACH, AREA_X, AREA_Y, INVENTORY, PANEL, POLYGONS, RAW

FLOOR = 5


def values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names})"


def _digit(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '[0-9]') THEN CAST(trim({c}) AS INT) END"


def _pad(c: str, n: int) -> str:
    t = f"nullif(trim({c}), '')"
    return f"CASE WHEN length({t}) < {n} THEN lpad({t}, {n}, '0') ELSE {t} END"


def _class(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'Unknown' WHEN {c} >= 7 THEN 'Good' WHEN {c} >= 5 THEN 'Fair' ELSE 'Poor' END"


def counts(c: str = "condition_class") -> str:
    return "CAST(count(*) AS INT) AS total, " + ", ".join(f"CAST(count(*) FILTER ({c} = '{k}') AS INT) AS {k.lower()}" for k in codes.CLASSES)


TALLY = "count(*) AS structures, count(*) FILTER (condition_class <> 'Unknown') AS rated, " + ", ".join(f"count(*) FILTER (condition_class = '{k}') AS {k.lower()}" for k in codes.CLASSES[:3]) + ", count(*) FILTER (condition_class = 'Unknown') AS unrated"
PCT = "round_even(100.0::DOUBLE * {} / nullif({}, 0), {})"
PKEY = "state_code, structure_number, record_type"
EDGES = [(g, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for g, _, rings in POLYGONS for r in rings for a, b in zip(r, r[1:], strict=False)]
BOUNDS = [s[:1] + s[1:] for s in codes.STATES]


def _dms(c: str, width: int, limit: int, out: str) -> str:
    raw = f"replace(trim(coalesce({c}, '')), '.', '')"
    d = f"lpad({raw}, {width}, '0')"
    part = lambda a, n: f"TRY_CAST(substr({d}, {a}, {n}) AS INT)"
    deg, m, s = part(1, width - 6), part(width - 5, 2), f"({part(width - 3, 4)} / 100.0::DOUBLE)"
    value = f"({deg} + {m} / 60.0::DOUBLE + {s} / 3600.0::DOUBLE)"
    number = f"CASE WHEN regexp_full_match({raw}, '[0-9]+') THEN TRY_CAST({raw} AS UBIGINT) END"
    return f"{value} AS {out}_v, CASE WHEN {number} IS NULL THEN 'missing_or_zero' WHEN length({raw}) > {width} THEN 'malformed' WHEN {number} = 0 THEN 'missing_or_zero' WHEN {m} >= 60 OR {s} >= 60 OR {deg} > {limit} THEN 'out_of_range' END AS {out}_f"


_R = {
    "unknown_state_code": "fips IS NULL",
    "structure_number_invalid": "NOT coalesce(length(nullif(trim(structure_number), '')) <= 15, false)",
    "coordinate_missing_or_zero": "fault = 'missing_or_zero'",
    "coordinate_invalid": "fault IN ('malformed', 'out_of_range')",
    "coordinate_outside_state": "fault IS NULL AND fips IS NOT NULL AND NOT (south IS NULL OR (lat BETWEEN south AND north AND lon BETWEEN west AND east))",
    "year_built_impossible": "nullif(trim(year_built), '') IS NOT NULL AND (yb IS NULL OR yb < 1600 OR yb > 2026)",
    "adt_invalid": "nullif(trim(adt), '') IS NOT NULL AND (ad IS NULL OR ad < 0)",
    "structure_length_invalid": "nullif(trim(length), '') IS NOT NULL AND (ln IS NULL OR ln < 0)",
    "condition_code_invalid": " OR ".join(f"(nullif(trim({c}), '') IS NOT NULL AND NOT regexp_full_match(trim({c}), '[0-9Nn]'))" for c in COMPONENTS),
}
_INT = "CASE WHEN regexp_full_match(trim({0}), '[+-]?[0-9]+') THEN TRY_CAST(trim({0}) AS INT) END"

#: name -> SQL; a CTE may use those before it.
CTES: dict[str, str] = {
    "panel": f"SELECT {', '.join(PANEL)} FROM lineitem",
    "inv": f"SELECT {', '.join(INVENTORY)} FROM customer",
    "pts": f"SELECT {PKEY}, lon, lat, published FROM inv",
    "rawr": f"SELECT {', '.join(RAW)} FROM customer",
    "states": values(codes.STATES, "fips, usps, state_name, south, north, west, east"),
    "mats": values(codes.MATERIAL_ROWS, "mc, mg"),
    "typs": values(codes.TYPE_ROWS, "tc, tg"),
    "regs": values(codes.REGION_ROWS, "rc, region"),
    "labs": values(codes.LABEL_ROWS, "kind, code, label"),
    "polys": values([(g, n) for g, n, _ in POLYGONS], "geoid, name"),
    "edges": values(EDGES, "geoid, x1, y1, x2, y2"),
    "ranked": "SELECT *, row_number() OVER (PARTITION BY vintage_year, state_code, structure_number ORDER BY source_row, deck, superstructure, substructure, culvert, county_code, material, design) AS rn FROM panel WHERE record_type = '1'",
    "sy0": f"SELECT vintage_year, state_code, structure_number, {_pad('county_code', 3)} AS county_code, {', '.join(f'{_digit(c)} AS {c}' for c in COMPONENTS)}, nullif(trim(material), '') AS material, {_pad('design', 2)} AS design FROM ranked WHERE rn = 1",
    "sy": f"SELECT *, {_class('lowest')} AS condition_class FROM (SELECT *, least(deck, superstructure, substructure, culvert) AS lowest FROM sy0)",
    "spans": "SELECT state_code, structure_number, min(vintage_year) AS first_year, max(vintage_year) AS last_year, CAST(count(*) AS INT) AS observed_years FROM sy GROUP BY ALL",
    "ser": "SELECT s.state_code, s.structure_number, first_year, last_year, observed_years, string_agg(CASE WHEN y.vintage_year IS NULL THEN '.' ELSE coalesce(CAST(y.lowest AS VARCHAR), 'U') END, '' ORDER BY g.yy) AS ratings FROM (SELECT *, unnest(range(first_year, last_year + 1)) AS yy FROM spans) g JOIN spans s USING (state_code, structure_number, first_year, last_year, observed_years) LEFT JOIN sy y ON y.state_code = g.state_code AND y.structure_number = g.structure_number AND y.vintage_year = g.yy GROUP BY ALL",
    "areas": "SELECT 'state' AS level, state_code AS fips, vintage_year, condition_class FROM sy UNION ALL SELECT 'county', state_code || county_code, vintage_year, condition_class FROM sy WHERE county_code IS NOT NULL",
    "roll": f"SELECT level, fips, vintage_year, {counts()} FROM areas GROUP BY ALL",
    "lng": " UNION ALL ".join(f"SELECT vintage_year, state_code, structure_number, material, design, '{c}' AS component, {c} AS rating FROM sy WHERE {c} IS NOT NULL" for c in COMPONENTS),
    "pairs": "SELECT * EXCLUDE (next_year) FROM (SELECT state_code, structure_number, component, vintage_year AS from_year, rating AS from_rating, lead(rating) OVER w AS to_rating, lead(vintage_year) OVER w AS next_year, material, design FROM lng WINDOW w AS (PARTITION BY state_code, structure_number, component ORDER BY vintage_year)) WHERE next_year = from_year + 1",
    "coh": "SELECT p.*, CASE WHEN material IS NULL THEN 'Not published' ELSE mg END AS material_group, CASE WHEN design IS NULL THEN 'Not published' ELSE tg END AS type_group, region FROM pairs p LEFT JOIN mats ON material = mc LEFT JOIN typs ON design = tc LEFT JOIN regs ON state_code = rc",
    "mapped": "SELECT * FROM coh WHERE material_group IS NOT NULL AND type_group IS NOT NULL AND region IS NOT NULL",
    "stacked": "SELECT component, type_group, material_group, region, from_rating, to_rating, from_year FROM mapped UNION ALL SELECT component, 'All', 'All', 'All', from_rating, to_rating, from_year FROM mapped",
    "cells": "SELECT component, type_group, material_group, region, from_rating, to_rating, count(*) AS pairs FROM stacked GROUP BY ALL",
    "mrows": "SELECT component, type_group, material_group, region, from_rating, count(*) AS row_total, min(from_year) AS first_from_year, max(from_year) AS last_from_year, count(DISTINCT from_year) AS year_pairs_observed FROM stacked GROUP BY ALL",
    "placed": "SELECT state_code, structure_number, record_type, lon, lat, published, geoid, sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) % 2 = 1 AS odd, bool_or((x2 - x1) * (lat - y1) = (y2 - y1) * (lon - x1) AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS onb FROM pts, edges GROUP BY ALL",
    "pip": f"SELECT {PKEY}, lon, lat, published, geoid FROM placed WHERE odd AND NOT onb",
    "touch": f"SELECT {PKEY}, CAST(count(*) AS INT) AS touching, min(geoid) AS first_geoid FROM placed WHERE odd OR onb GROUP BY ALL",
    "unm": f"SELECT p.* FROM pts p ANTI JOIN pip USING ({PKEY})",
    "segs": "SELECT *, x1 + t * (x2 - x1) AS px, y1 + t * (y2 - y1) AS py FROM (SELECT u.state_code, u.structure_number, u.record_type, lon, lat, e.*, least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0.0))) AS t FROM unm u, edges e)",
    "clo": f"SELECT {PKEY}, geoid, min(row((px - lon) * (px - lon) + (py - lat) * (py - lat), px, py, lon, lat)) AS c FROM segs GROUP BY ALL",
    "near": f"SELECT {PKEY}, min(row(m, geoid)) AS b FROM (SELECT {PKEY}, geoid, CAST(round(2 * 6371008.8::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(c[3] - c[5]) / 2), 2) + cos(radians(c[5])) * cos(radians(c[3])) * pow(sin(radians(c[2] - c[4]) / 2), 2))))) AS BIGINT) AS m FROM clo WHERE c[1] <= 9.0) GROUP BY {PKEY}",
    "outc": "SELECT p.*, q.geoid, CASE WHEN q.geoid IS NULL THEN 'unmatched' WHEN p.published IS NULL THEN 'no_code' WHEN p.published = q.geoid THEN 'agree' WHEN substr(p.published, 1, 2) = substr(q.geoid, 1, 2) THEN 'other_county' ELSE 'other_state' END AS outcome FROM pts p LEFT JOIN (SELECT state_code, structure_number, record_type, geoid FROM pip) q USING (state_code, structure_number, record_type)",
    "cov": "SELECT count(*) AS n_points, count(*) FILTER (outcome <> 'unmatched') AS matched, count(DISTINCT (state_code, structure_number)) AS structures, count(DISTINCT (state_code, structure_number)) FILTER (outcome <> 'unmatched') AS matched_structures, " + ", ".join(f"count(*) FILTER (outcome = '{k}') AS {k}" for k in ("agree", "other_county", "other_state", "no_code", "unmatched")) + ", round_even(100.0::DOUBLE * count(*) FILTER (outcome <> 'unmatched') / nullif(count(*), 0), 4) AS matched_percent, round_even(100.0::DOUBLE * count(DISTINCT (state_code, structure_number)) FILTER (outcome <> 'unmatched') / nullif(count(DISTINCT (state_code, structure_number)), 0), 4) AS structures_percent, round_even(100.0::DOUBLE * count(*) FILTER (outcome = 'agree') / nullif(count(*) FILTER (outcome <> 'unmatched'), 0), 4) AS agree_percent FROM outc",
    "dis": "SELECT published, geoid, outcome, n_rows, structures, CASE WHEN published IS NULL THEN NULL ELSE hit END AS current FROM (SELECT published, o.geoid, outcome, count(*) AS n_rows, count(DISTINCT (state_code, structure_number)) AS structures, bool_or(p.geoid IS NOT NULL) AS hit FROM outc o LEFT JOIN polys p ON published = p.geoid WHERE outcome IN ('other_county', 'other_state', 'no_code') GROUP BY published, o.geoid, outcome)",
    "miss": f"SELECT {PKEY}, CASE WHEN touching IS NOT NULL THEN 'on_boundary' ELSE 'outside_all' END AS reason, coalesce(touching, 0) AS touching, coalesce(first_geoid, b[2]) AS nearest_geoid, CASE WHEN touching IS NOT NULL THEN 0 ELSE b[1] END AS distance_m FROM unm LEFT JOIN touch USING ({PKEY}) LEFT JOIN near USING ({PKEY})",
    "popr": "SELECT CASE WHEN n_nationkey % 3 = 0 THEN '0400000US' ELSE '0500000US' END || ['01001', '01003', '02001', '02003', '77001'][n_nationkey % 5 + 1] AS key, CASE WHEN n_nationkey % 7 = 2 THEN '-555555555' ELSE CAST(n_nationkey * 1000 AS VARCHAR) END AS value, n_nationkey FROM nation",
    "pop": "SELECT substr(key, 10, 5) AS geoid, CASE WHEN TRY_CAST(value AS BIGINT) >= 0 THEN TRY_CAST(value AS BIGINT) END AS population FROM popr WHERE starts_with(key, '0500000US')",
    "pop1": "SELECT geoid, max(population) AS population FROM pop GROUP BY ALL",
    "resolved": f"SELECT r.state, s.fips, s.usps FROM rawr r LEFT JOIN states s ON upper({_pad('state', 2)}) = s.fips OR upper({_pad('state', 2)}) = s.usps",
    "vst": f"SELECT r.*, s.*, {_dms('lat_raw', 8, 90, 'la')}, {_dms('lon_raw', 9, 180, 'lo')} FROM rawr r LEFT JOIN states s ON {_pad('state', 2)} = s.fips",
    "vco": f"SELECT *, coalesce(la_f, lo_f) AS fault, CASE WHEN coalesce(la_f, lo_f) IS NULL THEN la_v END AS lat, CASE WHEN coalesce(la_f, lo_f) IS NULL THEN -lo_v END AS lon, {_INT.format('year_built')} AS yb, {_INT.format('adt')} AS ad, CASE WHEN regexp_full_match(replace(trim(length), ',', ''), '[+-]?([0-9]{{1,8}}(\\.[0-9]*)?|\\.[0-9]+)') THEN TRY_CAST(replace(trim(length), ',', '') AS DECIMAL(9,1)) END AS ln FROM vst",
    "val": "SELECT *, list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{k}' END" for k, t in _R.items()) + "], lambda x: x IS NOT NULL) AS reasons FROM vco",
    "fvw": "SELECT * EXCLUDE (reasons), CASE WHEN len(reasons) = 0 AND row_number() OVER (PARTITION BY fips, trim(structure_number), record_type, len(reasons) = 0 ORDER BY line_number) > 1 THEN ['duplicate_key'] ELSE reasons END AS reasons FROM val",
    "jagv": f"SELECT geoid, j, {AREA_X} AS x, {AREA_Y} AS y FROM (SELECT *, j % 120 AS k FROM (SELECT {', '.join(AREA_BASE)} FROM part), (SELECT unnest(range(0, 121)) AS j))",
    "jagb": "SELECT geoid, min(x) AS west, max(x) AS east, min(y) AS south, max(y) AS north FROM jagv GROUP BY 1",
    "jage": "SELECT v.geoid, v.x AS x1, v.y AS y1, z.x AS x2, z.y AS y2 FROM jagv v JOIN jagv z ON v.geoid = z.geoid AND z.j = v.j + 1",
    "apts": f"SELECT {', '.join(AREA_POINTS)} FROM orders",
    "ahit": "SELECT point, lon, lat, geoid FROM apts JOIN jagb ON lon BETWEEN west AND east AND lat BETWEEN south AND north",
    "aedge": "SELECT point, lon, lat, geoid, sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) % 2 = 1 AS odd, bool_or((x2 - x1) * (lat - y1) = (y2 - y1) * (lon - x1) AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS onb FROM ahit JOIN jage USING (geoid) GROUP BY ALL",
    "ain": "SELECT point, geoid FROM aedge WHERE odd AND NOT onb",
    "amiss": "SELECT * FROM apts ANTI JOIN ain USING (point)",
    "afar": f"SELECT point, lon, lat, geoid FROM amiss JOIN jagb ON lon BETWEEN west - {AREA_REACH} AND east + {AREA_REACH} AND lat BETWEEN south - {AREA_REACH} AND north + {AREA_REACH}",
    "aseg": "SELECT *, x1 + t * (x2 - x1) AS px, y1 + t * (y2 - y1) AS py FROM (SELECT f.*, e.x1, e.y1, e.x2, e.y2, least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0.0), 0.0))) AS t FROM afar f JOIN jage e USING (geoid))",
    "aclo": "SELECT point, geoid, min(row((px - lon) * (px - lon) + (py - lat) * (py - lat), px, py, lon, lat)) AS c FROM aseg GROUP BY ALL",
    "anear": f"SELECT point, min(row(m, geoid)) AS b FROM (SELECT point, geoid, CAST(round(2 * 6371008.8::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(c[3] - c[5]) / 2), 2) + cos(radians(c[5])) * cos(radians(c[3])) * pow(sin(radians(c[2] - c[4]) / 2), 2))))) AS BIGINT) AS m FROM aclo WHERE c[1] <= {AREA_REACH} * {AREA_REACH}) GROUP BY 1",
    "grp": f"SELECT state_code, {TALLY} FROM inv WHERE record_type = '1' GROUP BY ALL",
}


#: Computed once where they are used more than once.
MATERIALIZED = {"jagv", "jage", "ahit", "afar"}


def sql(body: str) -> str:
    """The body with the CTEs that it uses, directly or not, in order."""
    used: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for n in CTES:
            if n not in used and re.search(rf"\b{n}\b", text):
                used.add(n)
                todo.append(CTES[n])
    head = ", ".join(f"{n} AS {'MATERIALIZED ' if n in MATERIALIZED else ''}({CTES[n]})" for n in CTES if n in used)
    return f"WITH {head} {body}" if head else body
