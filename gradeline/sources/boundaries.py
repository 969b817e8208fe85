"""Boundaries: polygons from lines of GeoJSON features or of well-known text, in degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of longitude and latitude on the published ellipsoids.
DEGREES = ("urn:ogc:def:crs:OGC:1.3:CRS84", "urn:ogc:def:crs:OGC::CRS84", "EPSG:4326", "urn:ogc:def:crs:EPSG::4326", "EPSG:4269", "urn:ogc:def:crs:EPSG::4269")

_RING = "array<array<double>>"


def _points(rings: Column) -> Column:
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))))


def geojson_rings(geometry: Column) -> Column:
    """Rings of a Polygon or MultiPolygon (GeoJSON text), all polygons' together; null for other kinds."""
    kind, text = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    return F.when(kind == "Polygon", _points(F.from_json(text, f"array<{_RING}>"))).when(kind == "MultiPolygon", _points(F.flatten(F.from_json(text, f"array<array<{_RING}>>"))))


def wkt_rings(text: Column) -> Column:
    """Rings of a POLYGON or MULTIPOLYGON of well-known text; null for other kinds."""
    rings = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1))
    number = lambda p, k: F.get(F.split(F.trim(p), r"\s+"), k).try_cast("double")
    found = F.transform(rings, lambda r: F.transform(F.split(r, ","), lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y"))))
    return F.when(F.upper(F.trim(text)).rlike(r"^(MULTI)?POLYGON\s*\("), found)


def ring_fault(rings: Column) -> Column:
    """What is wrong with the rings, or null: no geometry, a short ring, an open ring, or a point outside of degrees."""
    closed = lambda r: F.get(r, 0) == F.element_at(r, -1)
    inside = lambda p: F.coalesce(p["x"].between(-180, 180) & p["y"].between(-90, 90), F.lit(False))
    return (
        F.when(rings.isNull() | (F.size(rings) == 0), "geometry_missing")
        .when(F.exists(rings, lambda r: F.size(r) < 4), "ring_short")
        .when(F.exists(rings, lambda r: F.exists(r, lambda p: ~inside(p))), "point_outside_degrees")
        .when(F.exists(rings, lambda r: ~closed(r)), "ring_open")
    )


def read_boundaries(spark: SparkSession, path: str, names: dict[str, str], areas: dict[str, str], key: str = "geoid", crs: tuple[str, ...] = DEGREES) -> tuple[DataFrame, DataFrame]:
    """(polygons, rejects) of files with one GeoJSON feature a line.

    names: our text columns by property, areas: our whole-number columns by property. Polygons have these and `rings`.
    Rejects (line, reason): no feature, a blank key, or a fault of the rings. A feature or header line that names another
    coordinate system than `crs` is an error. Blank lines and header lines don't count."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    item = lambda p: F.get_json_object("value", p)
    rows = lines.withColumns({"_type": item("$.type"), "_crs": item("$.crs.properties.name")})
    wrong = rows.filter(F.col("_crs").isNotNull() & ~F.col("_crs").isin(*crs)).select("_crs").limit(1).collect()
    if wrong:
        raise ValueError(f"the coordinate system is {wrong[0][0]}")
    rows = rows.filter(F.coalesce(F.col("_type") != "FeatureCollection", F.lit(True)))
    rows = rows.withColumns({ours: F.nullif(F.trim(item(f"$.properties.{p}")), F.lit("")) for p, ours in names.items()} | {ours: item(f"$.properties.{p}").try_cast("bigint") for p, ours in areas.items()})
    # a row of one struct: what is generated is made once, not again for each place that reads it
    rows = rows.select("*", F.inline(F.array(F.struct(geojson_rings(item("$.geometry")).alias("rings")))))
    reason = F.when(~F.col("_type").eqNullSafe("Feature"), "no_feature").when(F.col(key).isNull(), "missing_key_field").otherwise(ring_fault(F.col("rings")))
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason is null").select(*names.values(), *areas.values(), "rings"), rows.filter("reason is not null").select(F.col("value").alias("line"), "reason")
