"""The polygon grid against plain loops over all edges, with and without broadcast, and with points crowded in one cell."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gradeline.operators import hot, places, spatial
from gradeline.plans import adapters
from gradeline.plans import queries as plans


def ring(rng, x, y, size, n):
    pts = [(x + size * (0.5 + rng.random() / 2) * math.cos(2 * math.pi * k / n), y + size * (0.5 + rng.random() / 2) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return [*pts, pts[0]]


def sample(seed):
    """Polygons of very different sizes and numbers of edges, some with holes, some on whole numbers; points among them and on corners."""
    rng = random.Random(seed)
    shapes = {f"p{k:03d}": [ring(rng, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice([0.2, 0.5, 1, 2, 60]), rng.choice([3, 9, 40, 150]))] for k in range(60)}
    shapes["hole"] = [[(-8, -8), (8, -8), (8, 8), (-8, 8), (-8, -8)], ring(rng, 0, 0, 4, 12)]
    shapes |= {g: [[(float(x), float(y)) for x, y in r] for r in rings] for g, _, rings in adapters.POLYGONS}
    corners = [v for rings in shapes.values() for r in rings for v in r[:2]]
    points = [(rng.uniform(-25, 25), rng.uniform(-25, 25)) for _ in range(1500)] + [(float(rng.randint(-10, 40)), float(rng.randint(-10, 30))) for _ in range(500)] + corners
    return shapes, points


def plain(shapes, x, y):
    inside, touching = set(), set()
    for g, rings in shapes.items():
        odd = on = False
        for r in rings:
            for (x1, y1), (x2, y2) in zip(r, r[1:], strict=False):
                odd ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
                on |= (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2)
        inside |= {g} if odd and not on else set()
        touching |= {g} if odd or on else set()
    return inside, touching


def frames(spark, shapes, points):
    polygons = spark.createDataFrame([(g, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for g, rings in shapes.items()], "geoid string, rings array<array<struct<x: double, y: double>>>")
    return polygons, spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "k int, lon double, lat double")


@pytest.mark.parametrize("edges", [0, 200_000])
def test_grid_equals_plain_loops(spark, monkeypatch, edges):
    monkeypatch.setattr(spatial, "BROADCAST_EDGES", edges)
    shapes, points = sample(edges)
    polygons, pts = frames(spark, shapes, points)
    sizes, n = spatial.grid_of(polygons)
    assert len(sizes) > 1 and n == sum(len(r) - 1 for rings in shapes.values() for r in rings)
    want = {k: plain(shapes, x, y) for k, (x, y) in enumerate(points)}
    found = {}
    for r in spatial.point_in_polygon(pts, polygons).collect():
        found.setdefault(r.k, set()).add(r.geoid)
    assert found == {k: w[0] for k, w in want.items() if w[0]}
    touch = {r.k: (r.touching, r.first_geoid) for r in spatial.touching_polygons(pts, polygons, ["k"]).collect()}
    assert touch == {k: (len(w[1]), min(w[1])) for k, w in want.items() if w[1]}


def test_nearest_equals_all_edges(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BROADCAST_EDGES", 0)
    shapes, points = sample(7)
    shapes = {g: r for g, r in shapes.items() if g.startswith("p0")}
    polygons, pts = frames(spark, shapes, points[:300])

    def nearest(x, y, reach):
        best = None
        for g, rings in shapes.items():
            for r in rings:
                for (x1, y1), (x2, y2) in zip(r, r[1:], strict=False):
                    dx, dy = x2 - x1, y2 - y1
                    t = min(1.0, max(0.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
                    d = math.hypot(x1 + t * dx - x, y1 + t * dy - y)
                    if d <= reach and (best is None or d < best[0]):
                        best = (d, g)
        return best

    want = {k: nearest(x, y, 0.7) for k, (x, y) in enumerate(points[:300])}
    found = {r.k: r.nearest_geoid for r in spatial.nearest_polygon(pts, polygons, ["k"], 0.7).collect()}
    assert set(found) == {k for k, w in want.items() if w} and len(found) > 20
    # metres are rounded and taken on the sphere: the planar nearest is nearly always the same
    assert sum(found[k] == w[1] for k, w in want.items() if w) >= 0.9 * len(found)


def test_crowded_cell_and_missing_coordinates(spark, monkeypatch, tmp_path):
    """A third of all points on one place are dealt to many tasks; points without coordinates meet nothing."""
    monkeypatch.setattr(spatial, "BROADCAST_EDGES", 0)
    polygons = adapters.polygons(spark)
    spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") % 3 == 1, F.col("id") / 100.0).alias("lon"), F.when(F.col("id") % 3 < 2, 5.0).alias("lat")).write.parquet(str(tmp_path / "p"))
    pts = spark.read.parquet(str(tmp_path / "p"))
    found = spatial.point_in_polygon(pts, polygons)
    held = found.groupBy("id").count()
    assert held.filter("id % 3 = 0").count() == 1000 and held.filter("id % 3 = 2").count() == 0
    placed = pts.filter("lon is not null").withColumns({"_level": F.lit(0), "_cx": F.floor("lon"), "_cy": F.floor("lat")})
    assert [tuple(r) for r in hot.hot_keys(placed, ["_level", "_cx", "_cy"]).collect()][0] == (0, 5, 5)
    rows = hot.join_dealt(placed, placed.select("_level", "_cx", "_cy").distinct(), ["_level", "_cx", "_cy"])
    assert rows.count() == 2000
    assert spatial.point_in_polygon(pts.filter("false"), polygons).count() == spatial.point_in_polygon(pts, polygons.filter("false")).count() == 0


def test_areas_are_cut_to_their_cells(spark):
    areas = adapters.areas(spark, "/root/testdata/sf0.001")
    sizes, n = spatial.grid_of(areas)
    cells = spatial.polygon_index(areas, sizes)
    per = cells.agg(F.max(F.size("near")).alias("most"), F.avg(F.size("near")).alias("mean")).first()
    assert n == 120 * areas.count() and len(sizes) == 2 and per["most"] < 60 and per["mean"] < 15


def test_index_does_not_go_to_the_tasks_whole(spark, monkeypatch):
    """Its size can't be told from the table that the polygons are made of."""
    monkeypatch.setattr(spatial, "BROADCAST_EDGES", 0)
    shapes, points = sample(3)
    polygons, pts = frames(spark, shapes, points)
    plan = spatial.candidates(pts, polygons)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in next(line for line in plan.splitlines() if "Join [_level" in line)
    few = spatial.point_in_polygon(pts, polygons)
    monkeypatch.setattr(spatial, "BROADCAST_CELLS", 0)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, spatial.point_in_polygon(pts, polygons).collect()))


def test_polygons_are_cut_a_few_at_a_time(spark, monkeypatch):
    polygons, _ = frames(spark, *sample(5))
    batch = polygons.toArrow().combine_chunks().to_batches()[0]
    sizes, widest = spatial.np.array([1.0, 16.0]), spatial.np.array([64.0])
    every = spatial._cells(batch, sizes, widest, 0.0).to_pylist()
    monkeypatch.setattr(spatial, "TOGETHER", 300)
    slices = list(spatial._few(batch))
    assert len(slices) > 5 and sum(b.num_rows for b in slices) == batch.num_rows
    assert [row for b in slices for row in spatial._cells(b, sizes, widest, 0.0).to_pylist()] == every


def test_areas_are_those_of_the_expressions(spark):
    """Outlines drawn in arrays equal the column expressions that the SQL has, and lie in many tasks."""
    areas = adapters.areas(spark, "/root/testdata/sf0.01", "w")
    ring = f"transform(sequence(0, 120), j -> transform(array(j % 120), k -> named_struct('x', {adapters.AREA_X}, 'y', {adapters.AREA_Y}))[0])"
    plain = adapters.table(spark, "/root/testdata/sf0.01", "part").selectExpr(*adapters.AREA_BASE).selectExpr("geoid", "w", f"array({ring}) as rings")
    assert sorted(map(str, areas.collect())) == sorted(map(str, plain.collect()))
    assert areas.rdd.getNumPartitions() >= 16


@pytest.mark.parametrize(("block", "pairs", "ranges"), [(128, 8192, 500_000), (7, 50, 40)])
def test_few_places_equal_plain_loops(spark, monkeypatch, block, pairs, ranges):
    """Blocks of a polygon that lie in several parts count together; unknown coordinates meet nothing."""
    for name, most in (("BLOCK", block), ("PAIRS", pairs), ("RANGES", ranges)):
        monkeypatch.setattr(places, name, most)
    shapes, points = sample(11)
    points = list(dict.fromkeys(points))
    batch = frames(spark, shapes, points)[0].toArrow().combine_chunks().to_batches()[0]
    held = places.Places(*spatial.np.array([*points, (math.nan, 1.0), (1.0, math.nan)]).T)
    assert len(held.x) == len(points)
    want = {g: plain(shapes, *g) for g in zip(held.x.tolist(), held.y.tolist(), strict=True)}
    codes = batch.column("geoid").to_pylist()
    inside, touching = {}, {}
    for part in places.met(batch, held):
        for who, at, odd, on in zip(*part, strict=True):
            place = (float(held.x[at]), float(held.y[at]))
            assert codes[who] not in touching.setdefault(place, set())
            touching[place].add(codes[who])
            inside.setdefault(place, set()).update({codes[who]} if odd and not on else ())
    assert touching == {k: w[1] for k, w in want.items() if w[1]}
    assert {k: w for k, w in inside.items() if w} == {k: w[0] for k, w in want.items() if w[0]}


def drawn(polygons):
    """The same polygons, drawn in tasks."""

    def twice(batches):
        for b in batches:
            yield b.slice(0, b.num_rows // 2)
            yield b.slice(b.num_rows // 2)

    return places.Drawn(polygons.select("geoid", "rings"), twice, "geoid string, rings array<array<struct<x: double, y: double>>>")


def test_few_places_touching(spark, monkeypatch):
    """Points on the same places, also without coordinates, with the places in the tasks and without."""
    shapes, points = sample(13)
    polygons, pts = frames(spark, shapes, [*points, *points[:200]])
    pts = pts.withColumns({"lon": F.when(F.col("k") % 50 > 0, F.col("lon")), "lat": F.when(F.col("k") % 51 > 0, F.col("lat"))})
    every = {k: p for k, p in enumerate([*points, *points[:200]]) if k % 50 and k % 51}
    want = {k: plain(shapes, *p)[1] for k, p in every.items()}
    want = {k: (len(w), min(w)) for k, w in want.items() if w}
    for table in (polygons, drawn(polygons)):
        assert {r.k: (r.touching, r.first_geoid) for r in spatial.touching_polygons(pts, table, ["k"], many=True).collect()} == want
    monkeypatch.setattr(spatial, "HELD_PLACES", 100)
    assert {r.k: (r.touching, r.first_geoid) for r in spatial.touching_polygons(pts, drawn(polygons), ["k"], many=True).collect()} == want
    none = spatial.touching_polygons(pts.filter("false"), polygons, ["k"], many=True)
    assert none.count() == 0 and none.schema == spatial.touching_polygons(pts, polygons, ["k"]).schema


def exchanged(df):
    """Whether edges of polygons are in its plan outside of the tasks that draw them, and how often polygons are looked at."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "near#" in plan or "rings#" in plan, plan.count("MapInArrow")


def test_areas_touching_keeps_edges_in_the_tasks_that_draw_them(spark):
    assert exchanged(plans.QUERIES["areas_touching"](spark, "/root/testdata/sf0.001")) == (False, 1)


@pytest.mark.parametrize(("block", "pairs"), [(128, 8192), (7, 400)])
def test_few_places_closest_points(spark, monkeypatch, block, pairs):
    """The least of (squared distance, x, y) over all edges of a polygon, however its blocks lie in parts."""
    monkeypatch.setattr(places, "BLOCK", block)
    monkeypatch.setattr(places, "PAIRS", pairs)
    shapes, points = sample(17)
    held = places.Places(*spatial.np.array(list(dict.fromkeys(points[::4]))).T)
    batch = frames(spark, shapes, points)[0].toArrow().combine_chunks().to_batches()[0]
    found = [row for part in places.close(batch, held, 0.7) for row in zip(*(v.tolist() for v in part), strict=True)]
    assert len({row[:2] for row in found}) == len(found)
    want = []
    for who, g in enumerate(batch.column("geoid").to_pylist()):
        for at, (x, y) in enumerate(zip(held.x.tolist(), held.y.tolist(), strict=True)):
            best = (math.inf,)
            for r in shapes[g]:
                for (x1, y1), (x2, y2) in zip(r, r[1:], strict=False):
                    dx, dy = x2 - x1, y2 - y1
                    t = min(1.0, max(0.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
                    px, py = x1 + t * dx, y1 + t * dy
                    best = min(best, ((px - x) * (px - x) + (py - y) * (py - y), px, py))
            want += [(who, at, *best)] if best[0] <= 0.7 * 0.7 else []
    assert sorted(found) == want and len(want) > 100


def test_few_places_outside_and_nearest(spark, monkeypatch):
    """The same points and metres as by cells, for points on the same places and some without coordinates."""
    shapes, points = sample(19)
    shapes = {g: r for g, r in shapes.items() if max(x for x, _ in r[0]) - min(x for x, _ in r[0]) < 10}
    polygons, pts = frames(spark, shapes, [*points[::2], *points[:100]])
    pts = pts.withColumn("lon", F.when(F.col("k") % 50 > 0, F.col("lon")))
    outside = spatial.unmatched_points(pts, spatial.point_in_polygon(pts, polygons), ["k"])
    near = spatial.nearest_polygon(outside, polygons, ["k"], 0.7)
    want = sorted(map(tuple, outside.select("k").collect())), sorted(map(tuple, near.collect()))
    for most in (spatial.HELD_PLACES, 100):
        monkeypatch.setattr(spatial, "HELD_PLACES", most)
        left = spatial.outside_polygons(pts, drawn(polygons), ["k"], many=True)
        close = spatial.nearest_polygon(left, drawn(polygons), ["k"], 0.7, many=True)
        assert (sorted(map(tuple, left.select("k").collect())), sorted(map(tuple, close.collect()))) == want
        assert left.schema == pts.schema and close.schema == near.schema
    assert len(want[0]) > 100 and len(want[1]) > 50


def test_nearest_areas_keeps_edges_in_the_tasks_that_draw_them(spark):
    assert exchanged(plans.QUERIES["nearest_areas"](spark, "/root/testdata/sf0.001")) == (False, 1)


def test_few_places_containment(spark, monkeypatch):
    """Every point of a place gets the place's polygons, also where a third of all points are on one."""
    shapes, points = sample(23)
    points = [*points[::3], *[(5.0, 5.0)] * 300]
    polygons, pts = frames(spark, shapes, points)
    unknown = spark.createDataFrame([(-1, None, 5.0)], pts.schema)
    want = sorted((k, g) for k, p in enumerate(points) for g in plain(shapes, *p)[0])
    for most in (spatial.HELD_PLACES, 100):
        monkeypatch.setattr(spatial, "HELD_PLACES", most)
        found = spatial.point_in_polygon(pts.unionByName(unknown), drawn(polygons), many=True)
        assert sorted((r.k, r.geoid) for r in found.collect()) == want
        assert found.columns == ["k", "lon", "lat", "geoid"]


def test_points_in_areas_keeps_edges_in_the_tasks_that_draw_them(spark):
    assert exchanged(plans.QUERIES["points_in_areas"](spark, "/root/testdata/sf0.001")) == (False, 1)
