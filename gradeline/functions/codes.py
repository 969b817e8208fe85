"""Code tables as relations. All values below are fixed: codes and labels by the published coding guides; bounds (with a
margin), cohort groups and the words for absent and national by the results that they must give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: FIPS, USPS, name, and bounds (south, north, west, east); no bounds where the sign rule does not hold.
STATES = [
    ("01", "AL", "Alabama", 30.1, 35.1, -88.6, -84.8), ("02", "AK", "Alaska", 51.0, 71.6, -180.0, -129.9),
    ("04", "AZ", "Arizona", 31.2, 37.2, -115.0, -108.9), ("05", "AR", "Arkansas", 32.9, 36.6, -94.7, -89.5),
    ("06", "CA", "California", 32.4, 42.1, -124.6, -114.0), ("08", "CO", "Colorado", 36.9, 41.1, -109.2, -101.9),
    ("09", "CT", "Connecticut", 40.9, 42.2, -73.9, -71.7), ("10", "DE", "Delaware", 38.3, 39.9, -75.9, -74.9),
    ("11", "DC", "District of Columbia", 38.7, 39.1, -77.2, -76.8), ("12", "FL", "Florida", 24.3, 31.1, -87.7, -79.9),
    ("13", "GA", "Georgia", 30.3, 35.1, -85.7, -80.7), ("15", "HI", "Hawaii", 18.8, 22.4, -160.4, -154.7),
    ("16", "ID", "Idaho", 41.9, 49.1, -117.4, -110.9), ("17", "IL", "Illinois", 36.9, 42.6, -91.6, -87.4),
    ("18", "IN", "Indiana", 37.7, 41.9, -88.2, -84.7), ("19", "IA", "Iowa", 40.3, 43.6, -96.7, -90.1),
    ("20", "KS", "Kansas", 36.9, 40.1, -102.2, -94.5), ("21", "KY", "Kentucky", 36.4, 39.2, -89.7, -81.9),
    ("22", "LA", "Louisiana", 28.8, 33.1, -94.2, -88.7), ("23", "ME", "Maine", 42.9, 47.6, -71.2, -66.8),
    ("24", "MD", "Maryland", 37.8, 39.8, -79.6, -74.9), ("25", "MA", "Massachusetts", 41.2, 42.9, -73.6, -69.8),
    ("26", "MI", "Michigan", 41.6, 48.4, -90.5, -82.3), ("27", "MN", "Minnesota", 43.4, 49.5, -97.4, -89.4),
    ("28", "MS", "Mississippi", 30.1, 35.1, -91.8, -88.0), ("29", "MO", "Missouri", 35.9, 40.7, -95.9, -89.0),
    ("30", "MT", "Montana", 44.3, 49.1, -116.2, -103.9), ("31", "NE", "Nebraska", 39.9, 43.1, -104.2, -95.2),
    ("32", "NV", "Nevada", 34.9, 42.1, -120.1, -113.9), ("33", "NH", "New Hampshire", 42.6, 45.4, -72.7, -70.5),
    ("34", "NJ", "New Jersey", 38.8, 41.4, -75.7, -73.8), ("35", "NM", "New Mexico", 31.2, 37.1, -109.2, -102.9),
    ("36", "NY", "New York", 40.4, 45.1, -79.9, -71.7), ("37", "NC", "North Carolina", 33.7, 36.7, -84.4, -75.3),
    ("38", "ND", "North Dakota", 45.8, 49.1, -104.2, -96.4), ("39", "OH", "Ohio", 38.3, 42.0, -84.9, -80.4),
    ("40", "OK", "Oklahoma", 33.5, 37.1, -103.1, -94.3), ("41", "OR", "Oregon", 41.9, 46.4, -124.7, -116.4),
    ("42", "PA", "Pennsylvania", 39.6, 42.4, -80.6, -74.6), ("44", "RI", "Rhode Island", 41.1, 42.1, -71.9, -71.0),
    ("45", "SC", "South Carolina", 32.0, 35.3, -83.4, -78.4), ("46", "SD", "South Dakota", 42.4, 46.0, -104.2, -96.3),
    ("47", "TN", "Tennessee", 34.9, 36.7, -90.4, -81.5), ("48", "TX", "Texas", 25.7, 36.6, -106.7, -93.4),
    ("49", "UT", "Utah", 36.9, 42.1, -114.2, -108.9), ("50", "VT", "Vermont", 42.6, 45.1, -73.5, -71.4),
    ("51", "VA", "Virginia", 36.4, 39.6, -83.8, -75.1), ("53", "WA", "Washington", 45.4, 49.1, -124.9, -116.8),
    ("54", "WV", "West Virginia", 37.1, 40.7, -82.7, -77.6), ("55", "WI", "Wisconsin", 42.4, 47.2, -93.0, -86.7),
    ("56", "WY", "Wyoming", 40.9, 45.1, -111.2, -104.0), ("60", "AS", "American Samoa", None, None, None, None),
    ("66", "GU", "Guam", None, None, None, None), ("69", "MP", "Northern Mariana Islands", None, None, None, None),
    ("72", "PR", "Puerto Rico", 17.8, 18.6, -67.4, -65.1), ("78", "VI", "U.S. Virgin Islands", 17.6, 18.5, -65.2, -64.5),
]

#: Climate regions of the contiguous states.
REGIONS = {
    "Northeast": ["CT", "DE", "MA", "MD", "ME", "NH", "NJ", "NY", "PA", "RI", "VT", "DC"],
    "Upper Midwest": ["IA", "MI", "MN", "WI"],
    "Ohio Valley": ["IL", "IN", "KY", "MO", "OH", "TN", "WV"],
    "Southeast": ["AL", "FL", "GA", "NC", "SC", "VA"],
    "Northern Rockies & Plains": ["MT", "ND", "NE", "SD", "WY"],
    "South": ["AR", "KS", "LA", "MS", "OK", "TX"],
    "Southwest": ["AZ", "CO", "NM", "UT"],
    "Northwest": ["ID", "OR", "WA"],
    "West": ["CA", "NV"],
}
OUTSIDE = "Outside contiguous U.S."
ABSENT = "Not published"
NATIONAL = "All"

#: Cohort groups of material and design codes.
MATERIAL_GROUPS = {"Concrete": ["1", "2"], "Steel": ["3", "4"], "Prestressed concrete": ["5", "6"], "Timber": ["7"], "Masonry": ["8"], "Other": ["0", "9"]}
TYPE_GROUPS = {"Girder / Stringer": ["01", "02", "03", "04", "05", "06", "21", "22"], "Truss / Arch": ["09", "10", "11", "12", "13", "14"], "Culvert": ["19"], "Other": ["00", "07", "08", "15", "16", "17", "18", "20"]}

#: Labels of the codes.
MATERIALS = {"1": "Concrete", "2": "Concrete continuous", "3": "Steel", "4": "Steel continuous", "5": "Prestressed concrete", "6": "Prestressed concrete continuous", "7": "Wood or timber", "8": "Masonry", "9": "Aluminum, wrought iron, or cast iron", "0": "Other"}
DESIGNS = {"01": "Slab", "02": "Stringer/multi-beam or girder", "03": "Girder and floorbeam system", "04": "Tee beam", "05": "Box beam or girders — multiple", "06": "Box beam or girders — single or spread", "07": "Frame", "08": "Orthotropic", "09": "Truss — deck", "10": "Truss — thru", "11": "Arch — deck", "12": "Arch — thru", "13": "Suspension", "14": "Stayed girder", "15": "Movable — lift", "16": "Movable — bascule", "17": "Movable — swing", "18": "Tunnel", "19": "Culvert", "20": "Mixed types", "21": "Segmental box girder", "22": "Channel beam", "00": "Other"}
RATINGS = {"9": "Excellent condition", "8": "Very good condition", "7": "Good condition", "6": "Satisfactory condition", "5": "Fair condition", "4": "Poor condition", "3": "Serious condition", "2": "Critical condition", "1": "Imminent failure condition", "0": "Failed condition — out of service", "N": "Not applicable"}
CLASSES = ("Good", "Fair", "Poor", "Unknown")

_REGION_OF = {s: r for r, states in REGIONS.items() for s in states}
MATERIAL_ROWS = [(c, g) for g, codes in MATERIAL_GROUPS.items() for c in codes]
TYPE_ROWS = [(c, g) for g, codes in TYPE_GROUPS.items() for c in codes]
REGION_ROWS = [(s[0], _REGION_OF.get(s[1], OUTSIDE)) for s in STATES]
LABEL_ROWS = [(kind, c, v) for kind, table in (("material", MATERIALS), ("design", DESIGNS), ("rating", RATINGS)) for c, v in table.items()]


def states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATES, "fips string, usps string, state_name string, south double, north double, west double, east double")


def groups(spark: SparkSession, rows: list[tuple[str, str]], code: str, group: str) -> DataFrame:
    return spark.createDataFrame(rows, f"{code} string, {group} string")


def labels(spark: SparkSession) -> DataFrame:
    """All decodes as one relation: kind, code, label."""
    return spark.createDataFrame(LABEL_ROWS, "kind string, code string, label string")


def overlapping_codes(table: DataFrame, code: str, group: str) -> DataFrame:
    """Codes that stand in more than one group, with the number of groups."""
    return table.groupBy(code).agg(F.countDistinct(group).cast("int").alias("n_groups")).filter("n_groups > 1")


def with_cohort(df: DataFrame, material: str = "material", design: str = "design", state: str = "state_code") -> DataFrame:
    """Add material_group, type_group and region: an absent code is ABSENT, a code outside the tables is null."""
    spark = df.sparkSession
    out = df.join(F.broadcast(groups(spark, MATERIAL_ROWS, "_mc", "_mg")), F.col(material) == F.col("_mc"), "left")
    out = out.join(F.broadcast(groups(spark, TYPE_ROWS, "_tc", "_tg")), F.col(design) == F.col("_tc"), "left")
    out = out.join(F.broadcast(groups(spark, REGION_ROWS, "_rc", "region")), F.col(state) == F.col("_rc"), "left")
    absent: Column = F.lit(ABSENT)
    out = out.withColumns({"material_group": F.when(F.col(material).isNull(), absent).otherwise(F.col("_mg")), "type_group": F.when(F.col(design).isNull(), absent).otherwise(F.col("_tg"))})
    return out.drop("_mc", "_mg", "_tc", "_tg", "_rc")
