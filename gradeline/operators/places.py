"""Few places of many points: they go to the tasks that have the polygons and meet their edges there, so nothing of a polygon is
exchanged but what it says of a place."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Edges of a polygon that are looked at together; those beyond make further blocks, each with a box of its own.
BLOCK = 128
#: Points of polygons that a task holds in arrays at once, pairs of a block and a strip, pairs of a block and a place.
TOGETHER, RANGES, PAIRS = 200_000, 500_000, 8192
#: Metres by which distances told in arrays may differ from Spark's, rounding included, with much to spare.
DOUBT = 2.0

Rows = list[np.ndarray]
Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Drawn:
    """Polygons that `draw` makes of `rows` in tasks. What looks at them there makes and drops them a few at a time; else
    their rings would go to Spark and back, which takes longer than the rest."""

    rows: DataFrame
    draw: Callable[[Batches], Batches]
    schema: str

    def frame(self) -> DataFrame:
        return self.rows.mapInArrow(self.draw, self.schema)


def tell(polygons: DataFrame | Drawn, run: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """What `run` tells of batches of polygons; `code` in the schema is the codes' type."""
    frame, drawn = (polygons.frame(), polygons.draw) if isinstance(polygons, Drawn) else (polygons, None)
    schema = schema.replace("code", frame.schema["geoid"].dataType.simpleString())
    if drawn is None:
        return frame.select("geoid", "rings").mapInArrow(run, schema)
    return polygons.rows.mapInArrow(lambda batches: run(drawn(batches)), schema)


def each(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of whole-number ranges [low, high]: the row and the number of every member."""
    n = np.maximum(high - low + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes make about `most` together, one at least."""
    begin = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=-1))
    for a, z in zip(begin, np.append(begin[1:], len(sizes)), strict=True):
        yield int(a), int(z)


def few(batch: pa.RecordBatch, most: int) -> Batches:
    """Slices of a batch of polygons of about `most` points, a polygon at least."""
    rings = batch.column("rings")
    polygon = np.repeat(np.arange(batch.num_rows), rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    points = np.bincount(polygon, rings.flatten().value_lengths().fill_null(0).to_numpy(zero_copy_only=False), batch.num_rows)
    for a, z in runs(points, most):
        yield batch.slice(a, z - a)


def edges(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(polygon's row, x1, y1, x2, y2) of all edges of a batch of polygons, in order."""
    rings = batch.column("rings")
    flat = rings.flatten()
    xy = flat.flatten()
    x, y = (xy.field(k).to_numpy(zero_copy_only=False) for k in ("x", "y"))
    ring_size = flat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    polygon = np.repeat(np.repeat(np.arange(batch.num_rows), rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), ring_size)
    # an edge from each point but the last of a ring
    at = np.flatnonzero(np.arange(len(x)) + 1 != np.repeat(np.cumsum(ring_size), ring_size))
    return polygon[at], x[at], y[at], x[at + 1], y[at + 1]


class Places:
    """Different places, in strips of about equally many by y and by x within a strip, so that boxes find theirs wherever they crowd."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        known = ~(np.isnan(x) | np.isnan(y))
        x, y = x[known], y[known]
        order = np.argsort(y, kind="stable")
        _, group = np.unique(np.searchsorted(y[order], y[order]) * max(1, int(np.sqrt(len(x)) / 2)) // max(1, len(x)), return_inverse=True)
        strip = np.empty(len(x), np.int64)
        strip[order] = group  # the same for places of one y
        order = np.lexsort((x, strip))
        self.x, self.y, strip = x[order], y[order], strip[order]
        begin = np.flatnonzero(np.diff(strip, prepend=-1))
        self.low, self.high = (f.reduceat(self.y, begin) if len(begin) else self.y for f in (np.minimum, np.maximum))
        self.values = np.unique(self.x)
        self.key = strip * (len(self.values) + 1) + np.searchsorted(self.values, self.x)

    def within(self, box: Rows, alive: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(box, place) of the places within the boxes (west, east, south, north; borders included), at most PAIRS at once and
        in order of boxes, and the last box looked at. alive: the places that are still asked for."""
        west, east, south, north = box
        s0, s1 = np.searchsorted(self.high, south), np.searchsorted(self.low, north, "right") - 1
        w, e = np.searchsorted(self.values, west), np.searchsorted(self.values, east, "right")
        for first, end in runs(np.maximum(s1 - s0 + 1, 0), RANGES) if len(west) else ():
            b, strip = each(s0[first:end], s1[first:end])
            b += first
            base = strip * (len(self.values) + 1)
            a, z = np.searchsorted(self.key, base + w[b]), np.searchsorted(self.key, base + e[b])
            some = z > a
            b, a, z = b[some], a[some], z[some]
            upto = np.cumsum(z - a)
            for start in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
                i = np.arange(start, min(start + PAIRS, upto[-1]))
                k = np.searchsorted(upto, i, "right")
                at, of = z[k] - (upto[k] - i), b[k]
                y = self.y[at]
                kept = (y >= south[of]) & (y <= north[of])
                if alive is not None:
                    kept &= alive[at]
                yield of[kept], at[kept], int(of[-1])


class Blocks:
    """The edges of a batch of polygons in blocks of at most BLOCK, with the boxes of blocks and of their polygons."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        p, *self.ends = edges(batch)
        x1, y1, x2, y2 = self.ends
        n = np.bincount(p, minlength=batch.num_rows)
        blocks = -(-n // BLOCK)
        self.owner, number = each(np.zeros(len(n), np.int64), blocks - 1)
        self.size = np.minimum(BLOCK, n[self.owner] - number * BLOCK)
        self.begin = np.cumsum(self.size) - self.size
        self.single = not len(blocks) or blocks.max() <= 1
        self.low, self.high = np.minimum(y1, y2), np.maximum(y1, y2)
        told = ((np.fmin, np.fmin(x1, x2)), (np.fmax, np.fmax(x1, x2)), (np.fmin, np.fmin(y1, y2)), (np.fmax, np.fmax(y1, y2)))
        self.box = [f.reduceat(v, self.begin) if len(p) else v for f, v in told]
        starts = np.flatnonzero(number == 0)
        self.whole = [np.repeat(f.reduceat(v, starts), blocks[blocks > 0]) if len(p) else v for (f, _), v in zip(told, self.box, strict=True)]

    def padded(self, values: np.ndarray, fill: float) -> np.ndarray:
        """Values of edges, a row a block."""
        wide = int(self.size.max())
        if (self.size == wide).all():
            return values.reshape(-1, wide)
        out = np.full((len(self.size), wide), fill)
        out[np.arange(wide) < self.size[:, None]] = values
        return out


def _whole(parts: Iterator[tuple[int, Rows]], single: bool, merge: Callable[[Rows], Rows]) -> Iterator[Rows]:
    """Parts' rows (polygon, place, values), one for a polygon and a place. A part comes with its last polygon, whose blocks may
    go on in the next part."""
    held: Rows = []
    for last, rows in parts:
        if single:
            yield rows
            continue
        rows = merge([np.concatenate(v) for v in zip(held, rows, strict=True)] if held else rows)
        goes_on = rows[0] == last
        yield [v[~goes_on] for v in rows]
        held = [v[goes_on] for v in rows]
    if held:
        yield held


def _starts(who: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.flatnonzero((np.diff(who, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 0))


def _sides(rows: Rows) -> Rows:
    who, at, odd, on = rows
    order = np.lexsort((at, who))
    who, at = who[order], at[order]
    begin = _starts(who, at)
    if not len(begin):
        return rows
    return [who[begin], at[begin], np.logical_xor.reduceat(odd[order], begin), np.logical_or.reduceat(on[order], begin)]


def met(batch: pa.RecordBatch, places: Places, alive: np.ndarray | None = None) -> Iterator[Rows]:
    """(polygon's row, place, whether a ray to the right crosses an odd number of edges, whether it lies on an edge) where one of
    both is so. The comparisons are those of the SQL, edge by edge."""
    b = Blocks(batch)
    if not len(b.owner):
        return
    x1, y1, x2, y2 = b.ends
    # an edge's height where a ray meets it may be told a little right of the edge
    box = [b.whole[0], np.fmin(b.whole[1], b.box[1] + 1e-9 * (b.whole[1] - b.whole[0])), b.box[2], b.box[3]]
    low, high = b.padded(b.low, np.inf), b.padded(b.high, -np.inf)

    def parts() -> Iterator[tuple[int, Rows]]:
        for block, at, last in places.within(box, alive):
            y = places.y[at][:, None]
            pair, slot = np.divmod(np.flatnonzero((low[block] <= y) & (high[block] >= y)), low.shape[1])
            e = b.begin[block[pair]] + slot
            x, y = places.x[at[pair]], places.y[at[pair]]
            ax, ay, bx, by = x1[e], y1[e], x2[e], y2[e]
            run = (bx - ax) * (y - ay)
            with np.errstate(divide="ignore", invalid="ignore"):
                crossed = ((ay > y) != (by > y)) & (x < run / (by - ay) + ax)
            lies = (run == (by - ay) * (x - ax)) & (np.minimum(ax, bx) <= x) & (x <= np.maximum(ax, bx))
            odd = np.bincount(pair[crossed], minlength=len(at)) % 2 == 1
            on = np.zeros(len(at), bool)
            on[pair[lies]] = True
            some = odd | on
            yield int(b.owner[last]), [b.owner[block[some]], at[some], odd[some], on[some]]

    for rows in _whole(parts(), b.single, _sides):
        some = rows[2] | rows[3]  # blocks of a polygon may undo each other
        yield [v[some] for v in rows]


def _least(rows: Rows) -> Rows:
    order = np.lexsort((*rows[:1:-1], rows[1], rows[0]))
    first = order[_starts(rows[0][order], rows[1][order])]
    return [v[first] for v in rows]


def close(batch: pa.RecordBatch, places: Places, reach: float) -> Iterator[Rows]:
    """(polygon's row, place, squared planar distance, x, y of the closest point) of polygons within reach, each once a place."""
    b = Blocks(batch)
    if not len(b.owner):
        return
    x1, y1, x2, y2 = b.ends
    slack = reach + 16 * np.spacing(max(reach, *(float(np.nanmax(np.abs(v), initial=0.0)) for v in b.box)))
    box = [b.box[0] - slack, b.box[1] + slack, b.box[2] - slack, b.box[3] + slack]
    wide = np.arange(int(b.size.max()))

    def parts() -> Iterator[tuple[int, Rows]]:
        for blocks, ats, last in places.within(box):
            for k in range(0, len(ats), PAIRS // 8):
                block, at = blocks[k : k + PAIRS // 8], ats[k : k + PAIRS // 8]
                real = wide < b.size[block][:, None]
                e = np.where(real, b.begin[block][:, None] + wide, 0)
                x, y = places.x[at][:, None], places.y[at][:, None]
                ax, ay = x1[e], y1[e]
                dx, dy = x2[e] - ax, y2[e] - ay
                long = dx * dx + dy * dy
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = np.where(long == 0, 0.0, ((x - ax) * dx + (y - ay) * dy) / long)
                t = np.minimum(1.0, np.maximum(0.0, t))
                px, py = ax + t * dx, ay + t * dy
                d2 = (px - x) * (px - x) + (py - y) * (py - y)
                d2 = np.where(real & ~np.isnan(d2), d2, np.inf)
                d = d2.min(1, keepdims=True)
                qx = np.where(d2 == d, px, np.inf)
                q = qx.min(1, keepdims=True)
                qy = np.where(qx == q, py, np.inf).min(1)
                yield int(b.owner[block[-1]]) if k + PAIRS // 8 < len(ats) else int(b.owner[last]), [b.owner[block], at, d[:, 0], q[:, 0], qy]

    for rows in _whole(parts(), b.single, _least):
        near = rows[2] <= reach * reach
        yield [v[near] for v in rows]


def inside_pairs(places: Places) -> Callable[[Batches], Batches]:
    """For mapInArrow: _at, geoid of places strictly inside polygons."""

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for batch in few(whole, TOGETHER):
                for who, at, odd, on in met(batch, places.value):
                    in_ = odd & ~on
                    yield pa.RecordBatch.from_arrays([pa.array(at[in_], pa.int32()), batch.column("geoid").take(pa.array(who[in_]))], names=["_at", "geoid"])

    return run


def inside_any(places: Places) -> Callable[[Batches], Batches]:
    """For mapInArrow: _at of places strictly inside a polygon of the task; such a place meets no further ones."""

    def run(batches: Batches) -> Batches:
        alive = np.ones(len(places.value.x), bool)
        for whole in batches:
            for batch in few(whole, TOGETHER):
                for _, at, odd, on in met(batch, places.value, alive):
                    alive[at[odd & ~on]] = False
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(~alive), pa.int32())], names=["_at"])

    return run


def touching_counts(places: Places) -> Callable[[Batches], Batches]:
    """For mapInArrow: _at, touching, first_geoid: number and first code of a task's polygons that hold or touch a place."""

    def run(batches: Batches) -> Batches:
        n = np.zeros(len(places.value.x), np.int64)
        first = np.full(len(n), None, object)
        kind = None
        for whole in batches:
            kind = whole.column("geoid").type
            for batch in few(whole, TOGETHER):
                codes = batch.column("geoid")
                order = pc.sort_indices(codes, null_placement="at_end").to_numpy()
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                ordered = np.array([*codes.take(pa.array(order)).to_pylist(), None], object)
                least = np.full(len(n), len(order))
                for who, at, _, _ in met(batch, places.value):
                    np.add.at(n, at, 1)
                    np.minimum.at(least, at, rank[who])
                found = np.flatnonzero(least < len(order))
                for k, g in zip(found.tolist(), ordered[least[found]].tolist(), strict=True):
                    if g is not None and (first[k] is None or g < first[k]):
                        first[k] = g
        found = np.flatnonzero(n)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n[found]), pa.array(first[found].tolist(), kind)], names=["_at", "touching", "first_geoid"])

    return run


def closest_points(places: Places, reach: float, radius: float) -> Callable[[Batches], Batches]:
    """For mapInArrow: _at, geoid, px, py, lon, lat: the closest points of polygons within reach of a place, without those that
    another polygon of the task beats on the sphere by more than DOUBT."""

    def run(batches: Batches) -> Batches:
        x, y = places.value.x, places.value.y
        best = np.full(len(x), np.inf)
        for whole in batches:
            for batch in few(whole, TOGETHER):
                for who, at, _, px, py in close(batch, places.value, reach):
                    lon, lat = x[at], y[at]
                    h = np.sin(np.radians(py - lat) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(py)) * np.sin(np.radians(px - lon) / 2) ** 2
                    m = 2 * radius * np.arcsin(np.sqrt(np.clip(h, 0.0, 1.0)))
                    np.minimum.at(best, at, m)
                    k = np.flatnonzero(m <= best[at] + DOUBT)
                    yield pa.RecordBatch.from_arrays([pa.array(at[k], pa.int32()), batch.column("geoid").take(pa.array(who[k])), *[pa.array(v[k]) for v in (px, py, lon, lat)]], names=["_at", "geoid", "px", "py", "lon", "lat"])

    return run
