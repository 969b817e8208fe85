"""Embedding near-duplicates by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.llm.common import cut, join_copies, small_batches
from gradeline.llm.components import connected_components
from gradeline.llm.ngram_join import roots_of

#: Vectors of a block of the grid order, leading dimensions of the grid and those by whose cells blocks meet, and the size
#: at which the recursion compares.
BLOCK, DIMENSIONS, CELLS, LEAF = 2048, 6, 3, 128
#: Neighbouring blocks that a block meets in one task.
RUN = 8
#: Vectors that the principal directions are fitted on; they shape the order and the speed, never the result.
FIT_VECTORS = 10_000


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_directions(vectors: DataFrame, dimensions: int) -> dict[int, np.ndarray]:
    """For each vector length the leading directions of a sample of at most about FIT_VECTORS vectors."""
    total = vectors.count()
    rate = min(1.0, FIT_VECTORS / max(1, total))
    share = F.pmod(F.xxhash64("vec"), F.lit(1_000_000)) < rate * 1_000_000
    sample = [np.array(r[0], float) for r in vectors.filter(share).select("vec").limit(2 * FIT_VECTORS).collect()]
    out = {}
    for size in {len(v) for v in sample}:
        x = _unit(np.stack([v for v in sample if len(v) == size]))
        _, directions = np.linalg.eigh(x.T @ x)
        out[size] = directions[:, ::-1][:, :dimensions].copy()
    return out


def _box_gap(a: np.ndarray, b: np.ndarray) -> float:
    """The squared distance of the bounding boxes of two sets of points."""
    gap = np.maximum(0, np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)))
    return float((gap * gap).sum())


def sequence_join(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two grid-ordered sequences at or above the cosine: intervals are halved, and two whose boxes in the
    leading dimensions lie further apart than epsilon are skipped. same: one sequence with itself, pairs i < j."""
    limit = 2 - 2 * cosine + 1e-9
    found_i, found_j = [], []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d or (same and a >= d) or _box_gap(px[a:b], py[c:d]) > limit:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= cosine)
            i, j = i + a, j + c
            keep = i < j if same else np.ones(len(i), bool)
            found_i.append(i[keep])
            found_j.append(j[keep])
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *found_i]), np.concatenate([empty, *found_j])


def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """`vectors` with `n_links`, `component_id` and `kept`.

    Vectors of equal label (null links with nothing) and equal length are linked if their cosine, in double precision, is
    at least `cosine`. Null, empty and zero vectors, those with null or non-finite components and rows with a null id
    link with nothing: 0 links, component_id their own id, kept (false for a null id). Repeated rows link with each
    other. Input columns of the added names are replaced. An empty table gives an empty result.

    Equal vectors (by 128 bits of hash) are one vector with a weight. All are sorted by label and grid cell (width epsilon
    on the leading principal dimensions) and cut into blocks of BLOCK. Two blocks meet only if their cells on the first CELLS
    dimensions touch (an equality join on label and cells) and their boxes come within epsilon. A block goes once to
    each run of RUN neighbours that it meets, and they go there one after another, so a task holds two blocks at a time.
    Tasks return a sum and a root per vector.
    """
    small_batches(vectors.sparkSession)
    epsilon = float(np.sqrt(2 - 2 * cosine))
    outer = [c for c in vectors.columns if c not in ("n_links", "component_id", "kept")]
    names = [f"c{k}" for k in range(len(outer))]
    inner = vectors.select(*[F.col(c).alias(n) for c, n in zip(outer, names, strict=True)])
    id_col, vec_col = names[outer.index(id_col)], names[outer.index(vec_col)]
    element = inner.schema[vec_col].dataType.elementType.simpleString()
    width = "<f4" if element == "float" else "<f8"
    vec = F.transform(F.col(vec_col).cast("array<double>"), lambda v: v + F.lit(0.0))
    fine = F.coalesce(F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0), F.lit(False)) & F.col(id_col).isNotNull()
    label = F.col(names[outer.index(label_col)]) if label_col else F.lit(0)
    fine = fine & label.isNotNull()
    tagged = inner.withColumn("key", F.when(fine, F.struct(F.xxhash64(label, vec).alias("x"), F.xxhash64(F.lit(7), label, vec).alias("y"))))
    good = tagged.filter("key is not null").groupBy("key").agg(F.min(id_col).alias("rep"), F.count("*").alias("copies"), F.first(label).alias("label"), F.first(vec).alias("vec"))
    classes = cut(good.withColumn("node", F.monotonically_increasing_id()))
    directions = principal_directions(classes, DIMENSIONS)
    label_type = classes.schema["label"].dataType.simpleString()
    grid = [f"g{k}" for k in range(DIMENSIONS)]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size, cells = b["vec"].map(len).to_numpy(np.int64), np.zeros((len(b), DIMENSIONS), np.int64)
            raw = np.empty(len(b), object)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                x = np.stack(b["vec"].to_numpy()[at])
                raw[at] = [r.tobytes() for r in x.astype(width)]
                if n in directions:
                    p = _unit(x) @ directions[n]
                    cells[at, : p.shape[1]] = np.floor(p / epsilon)
            yield pd.DataFrame({"label": b["label"], "size": size, **{g: cells[:, k] for k, g in enumerate(grid)}, "node": b["node"], "copies": b["copies"], "raw": raw})

    placed = classes.select("label", "vec", "node", "copies").mapInPandas(place, f"label {label_type}, size int, {', '.join(f'{c} bigint' for c in grid)}, node bigint, copies bigint, raw binary")
    order = ["label", "size", *grid, "node"]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def block_of(g: pd.DataFrame, n: int) -> dict:
        p = _unit(np.frombuffer(b"".join(g["raw"]), width).reshape(-1, n)) @ directions.get(n, np.zeros((n, 1)))
        lo, hi = p.min(axis=0), p.max(axis=0)
        cells = [np.append(np.floor(x[:CELLS] / epsilon), np.zeros(max(0, CELLS - len(x)))).astype(np.int64).tolist() for x in (lo, hi)]
        return {"label": g["label"].iloc[0], "size": n, "lo": lo.tolist(), "hi": hi.tolist(), "first": cells[0], "last": cells[1], "nodes": g["node"].tolist(), "copies": g["copies"].tolist(), "raw": b"".join(g["raw"])}

    def chop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def blocks(rows: pd.DataFrame, last: bool) -> Iterator[dict]:
            nonlocal held
            same = (rows["label"].to_numpy()[1:] == rows["label"].to_numpy()[:-1]) & (np.diff(rows["size"]) == 0)
            edges = [0, *(np.flatnonzero(~same) + 1).tolist(), len(rows)]
            done = 0
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                for start in range(begin, end, BLOCK):
                    stop = min(start + BLOCK, end)
                    if stop == len(rows) and stop - start < BLOCK and not last:
                        break
                    yield block_of(rows.iloc[start:stop], int(rows["size"].iloc[start]))
                    done = stop
            held = rows.iloc[done:]

        for b in batches:
            done = list(blocks(b if held is None or not len(held) else pd.concat([held, b], ignore_index=True), False))
            if done:
                yield pd.DataFrame(done)
        if held is not None and len(held):
            yield pd.DataFrame(list(blocks(held.reset_index(drop=True), True)))

    blocks = placed.mapInPandas(chop, f"label {label_type}, size int, lo array<double>, hi array<double>, first array<bigint>, last array<bigint>, nodes array<bigint>, copies array<bigint>, raw binary")
    blocks = cut(blocks.withColumn("block", F.monotonically_increasing_id()))

    def cells(more: int) -> Column:
        """All cells (of CELLS = 3 dimensions) of a block's range, widened by `more` on each side."""
        x, y, z = (F.sequence(F.get("first", k) - more, F.get("last", k) + more) for k in range(CELLS))
        return F.flatten(F.transform(x, lambda a: F.flatten(F.transform(y, lambda b: F.transform(z, lambda c: F.array(a, b, c))))))

    meta = blocks.select("label", "size", "block", "lo", "hi", "first", "last")
    left, right = meta.withColumn("cell", F.explode(cells(0))).alias("l"), meta.withColumn("cell", F.explode(cells(1))).alias("r")
    gaps = F.zip_with(F.zip_with("l.lo", "r.hi", lambda a, b: a - b), F.zip_with("r.lo", "l.hi", lambda a, b: a - b), lambda a, b: F.pow(F.greatest(a, b, F.lit(0.0)), 2.0))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) <= epsilon**2 + 1e-9
    once = F.zip_with("l.first", "r.first", lambda a, b: F.greatest(a, b - 1)) == F.col("cell")
    pairs = left.join(right, ["label", "size", "cell"]).filter((F.col("l.block") <= F.col("r.block")) & once & near)
    pairs = cut(pairs.select(F.col("l.block").alias("block"), F.col("r.block").alias("other")).withColumn("run", F.floor(F.col("other") / RUN)))
    body = blocks.select(F.col("block").alias("other"), "size", "nodes", "copies", "raw")
    heads = pairs.groupBy("block", "run").agg(F.max(F.col("block") == F.col("other")).alias("own")).select("block", "run", F.col("block").alias("other"), F.lit(0).alias("rank"), "own")
    steps = heads.unionByName(pairs.filter("block <> other").select("block", "run", "other", F.lit(1).alias("rank"), F.lit(False).alias("own")))
    loaded = steps.join(body, "other").repartition("block", "run").sortWithinPartitions("block", "run", "rank", "other")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                y = _unit(np.frombuffer(r.raw, width).reshape(-1, r.size))
                d = directions.get(r.size, np.zeros((r.size, 1)))
                if r.rank == 0:
                    x, px, head = y, y @ d, r
                    if not r.own:
                        continue
                same = r.rank == 0
                i, j = sequence_join(x, px, y, y @ d, cosine, same)
                nodes, weight = (np.asarray(h) if same else np.concatenate([h, o]) for h, o in ((head.nodes, r.nodes), (head.copies, r.copies)))
                j = j if same else j + len(x)
                add, root = np.zeros(len(nodes), np.int64), roots_of(len(nodes), i, j)
                np.add.at(add, i, weight[j])
                np.add.at(add, j, weight[i])
                hit = np.flatnonzero(add)
                yield pd.DataFrame({"a": nodes[hit], "b": nodes[root[hit]], "links": add[hit]})

    found = cut(loaded.mapInPandas(compare, "a bigint, b bigint, links bigint"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    result = classes.select("key", "rep", "copies", "node").join(links, "node", "left").join(connected_components(found.select("a", "b")), "node", "left")
    result = cut(result.withColumn("component", F.coalesce("component", "node")))
    least = cut(result.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("many")))
    result = cut(join_copies(result, least, "component", "many").select("key", "copies", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    component = F.coalesce(F.col("least"), F.col(id_col))
    joined = join_copies(tagged, result, "key", "copies", "left")
    return joined.select(*[F.col(n).alias(c) for n, c in zip(names, outer, strict=True)], F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col(id_col) == component, F.lit(False)).alias("kept"))
