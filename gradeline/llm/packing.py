"""Best-fit packing with swap-based local search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeline.llm.common import cut, small_batches, tidy
from gradeline.llm.tokens import default_path, encoder

#: Pieces that one task packs together; with more of them bins come out fuller, with fewer tasks stay smaller.
GROUP = 4096


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of item numbers by best fit in the order given: an item goes to the bin with the least room that holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: a bin with room r exists
    for k, need in enumerate(lengths.tolist()):
        above = rooms >> need
        if above:
            room = need + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(k)
        else:
            room, b = size, len(bins)
            bins.append([k])
        if room - need:
            by_room[room - need].append(b)
            rooms |= 1 << (room - need)
    return bins


def _place_for(n: int, room: int, there: list[int], lengths: list[int]) -> list[int] | None:
    """What must leave a bin with `room` so that n tokens gain by coming in: nothing (move), the shortest document shorter
    than n that makes room (one for one), or the shortest such pair (two for one); null if neither works."""
    if n <= room:
        return []
    need = n - room
    one = min(((lengths[j], j) for j in there if need <= lengths[j] < n), default=None)
    order = sorted(((lengths[j], j) for j in there if lengths[j] < n))
    best, low, high = one and (one[0], [one[1]]), 0, len(order) - 1
    while low < high:
        both = order[low][0] + order[high][0]
        if both >= n:
            high -= 1
        elif both < need:
            low += 1
        else:
            if best is None or both < best[0]:
                best = both, [order[low][1], order[high][1]]
            high -= 1
    return best and best[1]


def _gains(there: list[int], size: int) -> np.ndarray:
    """For each length up to size: would a bin of documents of these lengths gain by it, that is, does `_place_for` find a place?

    A bin with this room takes n if n is in (s, s + room] for s = 0, the length of a document or the sum of two. The
    lengths are bits of one number, so each s costs a shift. Different lengths in a bin are at most about the square root of
    twice its size, so sums are few.
    """
    room, sums, seen = size - sum(there), {0}, set()
    for n in there:
        sums.update([n + x for x in seen])
        sums.add(n)
        if n in seen:
            continue
        seen.add(n)
    run, found = (1 << room) - 1, 0
    for s in sums:
        found |= run << (s + 1)
    bits = np.frombuffer((found & ((1 << (size + 1)) - 1)).to_bytes(size // 8 + 1, "little"), np.uint8)
    return np.unpackbits(bits, bitorder="little")[: size + 1].view(bool)


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int, steps: list[tuple[int, int]] | None = None) -> list[list[int]]:
    """Moves, one-for-one and two-for-one exchanges between underfull bins until as few bins are left as the lengths allow,
    or no underfull bin can give anything.

    From each bin, emptiest first, each document, longest first, goes to the first bin, fullest first, that gains tokens by
    taking it: into its room, or in the place of one or two together shorter documents, which come back. The receiving bin
    is at least as full as the giving one, so every step increases the sum of squared fills, and the search ends. A sweep
    tries every underfull bin as giver: an exchange between fuller ones can open the room that the emptiest needs. A bin
    that becomes empty is dropped. Full bins take no part. Which bins gain by which length is kept in a table, so that a
    document is tried on all bins at once. steps: gets (bins left, gain of the sum of squared fills) of each step.
    """
    fewest = -(-int(lengths.sum()) // size)
    if len(bins) <= fewest:
        return bins
    items = [list(x) for x in bins]
    fill = np.array([lengths[x].sum() for x in items], np.int64)
    at = np.flatnonzero(fill < size)
    whole = [x for x, f in zip(items, fill.tolist(), strict=True) if f >= size]
    items, fill = [items[b] for b in at], fill[at]
    # A row for each length that occurs, a column for each bin; never true for full and dropped bins.
    row = {n: r for r, n in enumerate(np.unique(lengths).tolist())}
    used = np.array(list(row))
    gains = np.zeros((len(used), len(items)), bool)
    size_of = lengths.tolist()
    for b, x in enumerate(items):
        gains[:, b] = _gains([size_of[k] for k in x], size)[used]
    left = len(whole) + len(items)
    changed = True
    while changed and left > fewest:
        changed = False
        for low in np.argsort(fill, kind="stable").tolist():
            if left <= fewest:
                break
            if not items[low] or fill[low] >= size:
                continue
            for k in sorted(items[low], key=lambda k: -size_of[k]):
                n = size_of[k]
                takes = gains[row[n]] * fill
                takes[low] = 0
                high = int(takes.argmax())
                if not takes[high] or fill[high] < fill[low]:
                    continue
                out = _place_for(n, size - int(fill[high]), items[high], size_of)
                more = n - sum(size_of[j] for j in out)
                items[low] = [j for j in items[low] if j != k] + out
                items[high] = [j for j in items[high] if j not in out] + [k]
                fill[high] += more
                fill[low] -= more
                for b in (low, high):
                    gains[:, b] = _gains([size_of[j] for j in items[b]], size)[used] if items[b] and fill[b] < size else False
                changed = True
                left -= not items[low]
                if steps is not None:
                    steps.append((left, int(fill[high] ** 2 + fill[low] ** 2 - (fill[high] - more) ** 2 - (fill[low] + more) ** 2)))
                if not items[low]:
                    break
    return whole + [x for x in items if x]


def pieces_of(docs: DataFrame, size: int = 2048, end_id: int = 0, tokenizer: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document's ids plus the end id: `id_col`, piece, start, length, ids_crc32 (and ids).

    Only documents longer than `size` are cut. A null or blank text is the end id alone. Repeated rows and null ids give
    pieces like others; other columns don't matter. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    path = tokenizer or default_path()
    id_type = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids, at = enc.encode_ended(b.column("_text"), end_id)
            tokens = np.diff(at)
            many = -(-tokens // size)
            doc = np.repeat(np.arange(len(many)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * size
            length = np.minimum(tokens[doc] - start, size)
            begin = at[doc] + start
            wide = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(wide[4 * k : 4 * z]) for k, z in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            arrays = [b.column("_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                kept = [ids[k:z].tolist() for k, z in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                arrays, names = [*arrays, pa.array(kept, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        tidy()

    return own.mapInArrow(split, f"`{id_col}` {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else ""))


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """Add `_number`: 0, 1, ... over the rows of a key, whatever partitions hold them.

    Rows are numbered inside their partition, and go on from the counts of the key's partitions before it; so no task meets
    all rows of a key. `rows` must come from a checkpoint, whose partitions stay.
    """
    held = rows.withColumn("_part", F.spark_partition_id())
    counts = held.groupBy(key, "_part").agg(F.count("*").alias("_before"))
    before = F.sum("_before").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    later = counts.withColumn("_before", before).filter("_before is not null")
    inside = F.row_number().over(Window.partitionBy(key, "_part").orderBy("_part")) - 1
    found = held.withColumn("_number", inside).join(later, [key, "_part"], "left")
    return found.withColumn("_number", F.col("_number") + F.coalesce("_before", F.lit(0))).drop("_part", "_before")


def pack(pieces: DataFrame, size: int = 2048, id_col: str = "doc_id", group: int = GROUP) -> DataFrame:
    """Add `sequence_id` and `offset` to pieces (columns as of `pieces_of`, others stay).

    Full pieces are sequences of their own. The others are dealt by hash to groups of about `group` pieces, one task each.
    There best fit in the order of the pieces' checksums makes the first bins, about 1.5 % more than needed, and the local
    search empties those. It ends at the fewest bins that the lengths allow or a bin or two above; that is the loss against
    packing all together. Repeated rows are pieces of their own, numbered for the hash, so that they are dealt to all groups
    however many they are. Placing is deterministic. Null ids stay null; an empty table gives an empty result; input columns
    named like the added ones are replaced, others stay whatever their names.
    """
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    # inside, columns go by their place
    inner = [f"c{k}" for k in range(len(names))]
    c_id, c_piece, c_length, c_crc = (inner[names.index(c)] for c in (id_col, "piece", "length", "ids_crc32"))
    id_type = pieces.schema[id_col].dataType
    held = cut(pieces.toDF(*inner).withColumn("_full", F.col(c_length) >= size))
    rest = held.filter("not _full")
    groups = max(1, round(rest.count() / group))
    # pandas would turn ids with nulls into floats, so ids travel as text
    dealt = rest.withColumn(c_id, F.col(c_id).cast("string")).drop("_full")
    dealt = _numbered(dealt.withColumn("_hash", F.xxhash64(F.col(c_id), c_piece, c_crc)), "_hash")
    dealt = dealt.withColumn("_group", F.pmod(F.xxhash64("_hash", "_number"), F.lit(groups)).cast("int")).drop("_hash", "_number")

    def place(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([c_crc, c_piece, c_id, c_length]).reset_index(drop=True)
        lengths = g[c_length].to_numpy(np.int64)
        bins = local_search(best_fit(lengths, size), lengths, size)
        sequence, offset = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
        for n, items in enumerate(bins):
            k = np.sort(np.array(items))
            sequence[k] = n
            offset[k] = np.cumsum(lengths[k]) - lengths[k]
        g["sequence_id"], g["offset"] = sequence + (np.int64(g["_group"][0]) << 32 if len(g) else 0), offset
        return g.drop(columns="_group")

    schema = dealt.drop("_group").schema.add("sequence_id", "long").add("offset", "long")
    packed = dealt.groupBy("_group").applyInPandas(place, schema).withColumn(c_id, F.col(c_id).cast(id_type))
    alone = held.filter("_full").drop("_full").withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(alone).select(*inner, "sequence_id", "offset").toDF(*names, "sequence_id", "offset")


def packed_sequences(docs: DataFrame, size: int = 2048, end_id: int = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences themselves: `sequence_id`, `ids` (joined by offset) and `spans` (doc_id, piece, offset, length).

    Null and empty texts are the end id alone, a null id stays null in its spans, repeated rows have spans of their own;
    texts of any length are cut into whole sequences; no rows give no sequences; other columns of `docs` don't matter."""
    packed = pack(pieces_of(docs, size, end_id, tokenizer, id_col=id_col, text_col=text_col, with_ids=True), size, id_col)
    parts = F.sort_array(F.collect_list(F.struct("offset", F.col(id_col).alias("doc_id"), "piece", "length", "ids")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return whole.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("spans"))
