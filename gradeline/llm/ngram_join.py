"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets verify them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.llm.common import Words, cut, gram_hashes, join_copies, mix64, slices, small_batches, tidy
from gradeline.llm.components import connected_components

#: Weight of one block: a text weighs 1 and 1 more for each WEIGHT bytes. A task holds the n-gram sets of two blocks at most.
BLOCK, WEIGHT = 1000, 8192
#: A label of more blocks than this is compared bucket by bucket, not block by block.
WIDE = 16


def choose_bands(threshold: float, recall: float, hashes: int = 144) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which a pair at the threshold still meets in a band with `recall`."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    return hashes, 1


def shingles(texts: pa.Array, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of n words; of all words if there are fewer; none without words."""
    out = []
    for part in slices(texts):
        words = Words(part)
        hashed, first = words.hashes(), words.first.tolist()
        runs = gram_hashes(hashed, n, seed=n)
        for a, z in zip(first[:-1], first[1:], strict=True):
            found = runs[a : z - n + 1] if z - a >= n else gram_hashes(hashed[a:z], z - a, seed=z - a) if z > a else hashed[:0]
            out.append(np.unique(found))
    return out


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band from minima of `bands * rows` hash functions."""
    keys = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(grams), 512):
        np.minimum(low, ((grams[None, k : k + 512] ^ keys[:, None]) * (keys[:, None] | np.uint64(1))).min(axis=1), out=low)
    out = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        out = mix64(out) ^ low.reshape(bands, rows)[:, r]
    return mix64(out).view(np.int64)


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number of common members for each pair (left[k], right[k])."""
    if len(left) <= 8 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left.tolist(), right.tolist(), strict=True)], np.int64)
    rows, cols = np.unique(left), np.unique(right)
    used = np.union1d(rows, cols)
    flat = np.concatenate([sets[i] for i in used])
    owner = np.repeat(used, [len(sets[i]) for i in used])
    _, ids, n = np.unique(flat, return_inverse=True, return_counts=True)
    flat, owner = ids[n[ids] > 1], owner[n[ids] > 1]
    _, flat = np.unique(flat, return_inverse=True)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    at_row, at_col = np.full(len(sets), -1), np.full(len(sets), -1)
    at_row[rows], at_col[cols] = np.arange(len(rows)), np.arange(len(cols))
    common = np.zeros((len(rows), len(cols)))
    width = 4096
    for k in range(0, int(flat[-1]) + 1 if len(flat) else 0, width):
        a, b = np.searchsorted(flat, (k, k + width))
        column, who = flat[a:b] - k, owner[a:b]
        x, y = np.zeros((len(rows), width), np.float32), np.zeros((len(cols), width), np.float32)
        m = at_row[who] >= 0
        x[at_row[who[m]], column[m]] = 1
        m = at_col[who] >= 0
        y[at_col[who[m]], column[m]] = 1
        common += x @ y.T
    return common[at_row[left], at_col[right]].astype(np.int64)


def verified(bands: np.ndarray, block: np.ndarray, sets: list[np.ndarray], threshold: float, crossing: bool, band: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that share a band and whose sets' Jaccard similarity is at least the threshold. band: only those that
    share this band and none before it."""
    n = len(sets)
    left_at, right_at = (np.flatnonzero(block == block.min()), np.flatnonzero(block != block.min())) if crossing else (np.arange(n), np.arange(n))
    meet = np.zeros((len(left_at), len(right_at)), bool)
    for k in range(band + 1 if band >= 0 else bands.shape[1]):
        same = bands[left_at, k][:, None] == bands[right_at, k][None, :]
        meet = meet | same if band < 0 or k < band else same & ~meet
    i, j = np.nonzero(meet if crossing else np.triu(meet, 1))
    i, j = left_at[i], right_at[j]
    size = np.array([len(s) for s in sets], np.int64)
    ratio_ok = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
    i, j = i[ratio_ok], j[ratio_ok]
    if not len(i):
        return i, j
    common = _overlaps(sets, i, j)
    ok = common >= threshold * (size[i] + size[j] - common) - 1e-9
    return i[ok], j[ok]


def roots_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n items the smallest item that the links (i, j) reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def jaccard_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id_col`, `text_key` (md5 of the text), `class_key`, `class_id`, `n_links`, `keeper`.

    Two documents are linked if the Jaccard similarity of their sets of n-word runs is at least the threshold; a
    document of fewer words has one run. class_id is the smallest id that links reach, n_links the number of other rows
    linked directly, keeper true for one (id, text) of each class. Null and blank texts link with nothing. Repeated rows
    link with each other. A null id takes part; it is the smallest id only if all of a class are null. Long texts are read
    whole. An empty table gives an empty result; other columns don't matter, whatever their names.

    Equal texts are one text with a weight. Texts that share a band get one label by connected components over (text,
    smallest text of the bucket) edges, so that a bucket of any size costs one edge per member. Texts of one label meet in
    tasks of at most two blocks, where those that share a band are compared on full sets; each pair of blocks of a large
    label has its own task. Chains of chance meetings can make one label of very many texts: one of more than WIDE blocks
    is compared bucket by bucket, a pair in the first bucket that it shares, and only large buckets are cut into blocks. So
    work follows the buckets' sizes, not the label's, and each pair is compared once. Tasks return a sum and a root per
    text, never pairs.
    """
    small_batches(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    own = own.withColumn("_key", F.unhex(F.md5(F.coalesce("_text", F.lit("")).cast("binary"))))
    id_type = own.schema["_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shingles(b.column("_text"), n)
            signed = [band_hashes(s, bands, rows) if len(s) else None for s in found]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_key"), pa.array(signed, pa.list_(pa.int64()))], names=["_id", "_key", "bands"])
        tidy()

    signed = own.mapInArrow(sign, f"_id {id_type}, _key binary, bands array<bigint>")
    nodes = cut(signed.groupBy("_key").agg(F.min("_id").alias("first_id"), F.count("*").alias("copies"), F.first("bands").alias("bands")))
    # One row per text, reduced before the exchange: copies and repeated rows meet in no task.
    texts = own.groupBy("_key").agg(F.first("_text").alias("_text"))

    # two buckets of one 64-bit name would only be compared together
    banded = nodes.filter("bands is not null").select("_key", F.posexplode("bands").alias("band", "hash")).withColumn("bucket", F.xxhash64("band", "hash"))
    hubs = cut(banded.groupBy("bucket").agg(F.min("_key").alias("hub"), F.max("_key").alias("last"), F.count("*").alias("held")).filter("hub <> last").drop("last"))
    met = join_copies(banded.select("_key", "bucket"), hubs, "bucket", "held").select(F.col("_key").alias("a"), F.col("hub").alias("b"))
    labels = connected_components(met)

    weights = own.select("_key", (1 + F.floor(F.octet_length("_text") / WEIGHT)).alias("weight")).groupBy("_key").agg(F.first("weight").alias("weight"))
    members = cut(labels.join(weights, labels["node"] == weights["_key"]).select("_key", "component", "weight"))
    sizes = members.groupBy("component").agg(F.sum("weight").alias("size"))
    members = cut(members.join(sizes, "component"))
    shares = lambda size: F.ceil(F.col(size) / BLOCK).cast("int")

    def dealt(df: DataFrame, size: str, one: Column, many: Column) -> DataFrame:
        """A row for each task of a text: label, band, and the blocks (low, high) that meet there. Labels of up to BLOCK share tasks."""
        small = F.col(size) <= BLOCK
        df = df.withColumns({"label": F.when(small, one).otherwise(many), "block": F.when(small, 0).otherwise(F.pmod(F.xxhash64("_key"), shares(size)).cast("int")), "cuts": F.when(small, 1).otherwise(shares(size))})
        df = df.select("_key", "label", "band", "block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
        return df.select("_key", "label", "band", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    total, widest = members.agg(F.sum("weight"), F.max("size")).first()
    tasks = max(1, (total or 0) // BLOCK)
    spread = lambda *names: F.pmod(F.xxhash64(*names), F.lit(tasks)).cast("string")
    wide = F.col("size") > WIDE * BLOCK
    narrow = dealt(members.filter(~wide).withColumn("band", F.lit(-1)), "size", spread("component"), F.hex("component"))
    inside = members.filter(wide).join(banded.drop("bucket"), "_key").withColumn("bucket", F.struct("band", "hash"))
    if (widest or 0) > WIDE * BLOCK:
        # rows of a large bucket are dealt to many tasks, which needs them in one order
        inside = cut(inside)
        buckets = cut(inside.groupBy("bucket").agg(F.sum("weight").alias("held"), F.count("*").alias("_n")).filter("_n > 1"))
        inside = join_copies(inside, buckets, "bucket", "_n")
    else:
        inside = inside.withColumn("held", F.lit(0).cast("long"))
    by_bucket = dealt(inside, "held", spread("hash"), F.concat(F.lit("b"), F.col("hash").cast("string")))
    loaded = narrow.unionByName(by_bucket).join(nodes.select("_key", "copies", "bands"), "_key").join(texts, "_key")

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        sets = shingles(pa.array(g["_text"], pa.large_string()), n)
        i, j = verified(np.stack(g["bands"].to_numpy()), g["block"].to_numpy(), sets, threshold, bool(g["low"][0] != g["high"][0]), int(g["band"][0]))
        root, weight, add = roots_of(len(g), i, j), g["copies"].to_numpy(np.int64), np.zeros(len(g), np.int64)
        np.add.at(add, i, weight[j])
        np.add.at(add, j, weight[i])
        hit = np.flatnonzero(add)
        del sets
        tidy()
        return pd.DataFrame({"a": g["_key"].to_numpy()[hit], "b": g["_key"].to_numpy()[root[hit]], "links": add[hit]})

    found = cut(loaded.groupBy("label", "band", "low", "high").applyInPandas(compare, "a binary, b binary, links bigint"))
    links = found.groupBy(F.col("a").alias("_key")).agg(F.sum("links").alias("links"))
    linked = connected_components(found.select("a", "b")).select(F.col("node").alias("_key"), F.col("component").alias("class_key"))
    full = nodes.select("_key", "first_id", "copies", F.col("bands").isNull().alias("bare")).join(links, "_key", "left").join(linked, "_key", "left")
    full = cut(full.withColumn("class_key", F.coalesce("class_key", "_key")))
    classes = cut(full.groupBy("class_key").agg(F.count("*").alias("many"), F.min("first_id").alias("class_id"), F.min(F.struct(F.col("first_id").isNull(), "first_id", "_key")).alias("best")))
    full = join_copies(full, classes, "class_key", "many")
    full = cut(full.select("_key", "copies", "class_key", "class_id", "bare", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.col("best._key").alias("best_key")))
    rows_ = join_copies(own.select("_id", "_key"), full, "_key", "copies")
    return rows_.select(
        F.col("_id").alias(id_col),
        F.col("_key").alias("text_key"),
        "class_key",
        F.when(F.col("bare"), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("bare"), F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"),
        (F.col("bare") | (F.col("_id").eqNullSafe(F.col("class_id")) & (F.col("_key") == F.col("best_key")))).alias("keeper"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one document of each class, columns unchanged whatever their names. Null and blank texts all stay. Of
    repeated rows of one id and text that differ elsewhere the one with the smallest hash of all its columns stays."""
    names = docs.columns
    inner = docs.toDF(*[f"c{k}" for k in range(len(names))])
    id_, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    classes = jaccard_classes(inner.select(id_, text), id_col=id_, text_col=text, **options)
    keep = classes.filter("keeper").groupBy("text_key", F.col(id_).alias("keep_id")).agg(F.count("*").alias("rows"))
    blank = F.coalesce(F.col(text), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    full = inner.filter(~blank).withColumn("key", F.unhex(F.md5(F.col(text).cast("binary"))))
    kept = full.join(keep, (F.col("key") == F.col("text_key")) & F.col(id_).eqNullSafe(F.col("keep_id")))
    once = kept.filter("rows = 1").select(*inner.columns)
    whole = F.struct(*inner.columns)
    again = kept.filter("rows > 1").groupBy("key", id_).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("row")).select("row.*")
    return once.unionByName(again).unionByName(inner.filter(blank)).toDF(*names)
