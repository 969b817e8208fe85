"""Substring dedup: level-wise doubling over hashed word windows."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.llm.common import Words, cut, join_copies, mix64, shared_dir, small_batches, tidy

#: Windows start at no fewer words than this.
SHORTEST = 8
#: Bytes of text that a task searches at a time (a longer text alone).
SLICE = 1 << 20


def levels(window: int) -> list[int]:
    """The window lengths: each is twice the one before, the last (at most twice) is `window`. 35: 9, 18, 35."""
    out = [window]
    while (out[0] + 1) // 2 >= SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(mix64(a + np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xD6E8FEB86659FD93)))


def window_hashes(words: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """Hashes of all windows of each length; a longer window's from two shorter ones that cover it."""
    out: dict[int, np.ndarray] = {}
    size, current = 1, words
    while size * 2 <= lengths[0]:
        current = _join(current[: max(0, len(current) - size)], current[size:])
        size *= 2
    for n in lengths:
        if n != size:
            shift = n - size
            current = _join(current[: max(0, len(current) - shift)], current[shift:])
            size = n
        out[n] = current
    return out


def first_minima(h: np.ndarray, size: int) -> np.ndarray:
    """For each run of `size` values the place of its first minimum; runs are joined from shorter ones by doubling."""
    at, low, done = np.arange(len(h)), h, 1
    while done < size:
        step = min(done, size - done)
        at = np.where(low[step:] < low[:-step], at[step:], at[:-step])
        low = np.minimum(low[step:], low[:-step])
        done += step
    return at


class Search:
    """Windows of a batch of texts that may occur elsewhere.

    At each level a window of the full length stands or falls with one shorter window inside it: the one with the
    smallest hash (its anchor), which every equal window elsewhere has at the same place. An anchor whose hash occurs
    once in all texts kills the windows that it stands for; only anchors of living windows go to the next level, at twice
    the length. At the last level the anchor is the window itself, and two independent hashes (128 bits) tell it.
    """

    def __init__(self, texts: list[bytes], window: int):
        self.window, self.lengths = window, levels(window)
        self.words = Words(pa.array(texts, pa.large_binary()))
        self.first, self.n_words = self.words.first, len(self.words.start)
        self.hashes = window_hashes(self.words.hashes(), self.lengths)
        whole = np.zeros(self.n_words + 1, np.int64)
        begun = self.first[:-1][np.diff(self.first) >= window]
        np.add.at(whole, begun, 1)
        np.add.at(whole, self.first[1:][np.diff(self.first) >= window] - window + 1, -1)
        self.alive = np.flatnonzero(np.cumsum(whole))

    def anchors(self, level: int) -> np.ndarray:
        """For each living window the place of its anchor."""
        n = self.lengths[level]
        inside = self.window - n + 1
        if inside == 1 or not len(self.alive):
            return self.alive
        return first_minima(self.hashes[n], inside)[self.alive]

    def second(self) -> np.ndarray:
        """The other hashes of the whole windows."""
        return window_hashes(self.words.hashes(seed=1), self.lengths)[self.window]

    def drop(self, level: int, alone: np.ndarray, others: np.ndarray | None = None) -> None:
        """Kill the windows whose anchors at this level are among `alone`; at the last level, with the second hash of others."""
        if not len(alone) or not len(self.alive):
            return
        order = np.argsort(alone, kind="stable")
        alone = alone[order]
        at = self.anchors(level)
        h = self.hashes[self.lengths[level]][at]
        place = np.searchsorted(alone, h)
        if others is None:
            dead = alone[np.minimum(place, len(alone) - 1)] == h
        else:
            others, mine, dead = others[order], self.second()[at], np.zeros(len(h), bool)
            for step in range(int(np.unique(alone, return_counts=True)[1].max())):
                k = np.minimum(place + step, len(alone) - 1)
                dead |= (alone[k] == h) & (others[k] == mine)
        self.alive = self.alive[~dead]

    def asked(self, level: int, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the living windows' distinct anchors: hash, second hash (0 but at the last level), number of a text that holds it,
        and occurrences in all texts of the batch with their copies, up to 2."""
        at = self.anchors(level)
        at = at[np.flatnonzero(np.diff(at, prepend=-1))] if len(at) else at
        h = self.hashes[self.lengths[level]][at] if len(at) else np.empty(0, np.uint64)
        h2 = self.second()[at] if len(at) and level == len(self.lengths) - 1 else np.zeros(len(at), np.uint64)
        text = np.searchsorted(self.first, at, "right") - 1
        order = np.lexsort((h2, h)) if h2.any() else np.argsort(h, kind="stable")
        h, h2, text = h[order], h2[order], text[order]
        new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]))) if len(h) else np.empty(0, np.int64)
        total = np.add.reduceat(copies[text], new) if len(new) else np.empty(0, np.int64)
        return h[new], h2[new], text[new], np.minimum(total, 2)

    def removed(self) -> np.ndarray:
        """For each word of the batch whether a living window covers it."""
        step = np.zeros(self.n_words + 1, np.int64)
        step[self.alive] += 1
        step[self.alive + self.window] -= 1
        return np.cumsum(step)[:-1] > 0


def _distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """Distinct non-blank texts as a bucketed table (key, copies, blob): later joins on the key leave the texts where they are.

    The files lie in the shared folder beside the checkpoints and go with them."""
    own = docs.select(F.col(text_col).alias("_text")).filter(F.coalesce(F.col("_text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    own = own.withColumn("key", F.unhex(F.md5(F.col("_text").cast("binary"))))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3)
        for b in batches:
            blobs = [z.compress(t.encode("utf-8", "surrogatepass")) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(blobs, pa.binary())], names=["key", "blob"])

    packed = own.mapInArrow(squeeze, "key binary, blob binary")
    distinct = packed.groupBy("key").agg(F.count("*").alias("copies"), F.first("blob").alias("blob"))
    return _bucketed(distinct)


def _bucketed(df: DataFrame) -> DataFrame:
    """The rows as files in the shared folder, in buckets of `key`: joins of such tables on the key move nothing.

    Buckets are told by a catalog's entry, which goes as soon as the files are known; the files go with the folder."""
    spark, name = df.sparkSession, f"texts_{uuid.uuid4().hex}"
    where = f"{shared_dir(spark).rstrip('/')}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").option("compression", "none").option("path", where).format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def repeated_words(docs: DataFrame, window: int = 35, text_col: str = "text") -> DataFrame:
    """For each distinct non-blank text: `text_key` (md5), copies (rows), n_words, n_removed, spans (start, end of removed
    words) and kept (the other words, joined by one space).

    Removed are the words covered by a window of `window` words that also starts anywhere else, in the same text or
    another, repeated rows included. Null and blank texts give no row; texts of fewer words lose nothing; an empty table
    gives an empty result; other columns don't matter. Long texts are read whole, in one task each.

    Windows are found by doubling (`levels`, `Search`). Each level is one grouped sum over hashes: a hash of a single
    occurrence goes back to the only text that has it, so frequent passages gather nowhere. Texts that occur more than once
    need no search of their own; they only tell the others what they hold. Chance agreement of 64-bit hashes on the lower
    levels only keeps a window for the last one, which goes by 128 bits.
    """
    small_batches(docs.sparkSession)
    texts, lengths = _distinct_texts(docs, text_col), levels(window)
    last = len(lengths) - 1
    alone: list[DataFrame] = []

    def searched(batches: Iterator[pd.DataFrame], upto: int) -> Iterator[tuple[pd.DataFrame, list[bytes], Search]]:
        """Rows of about SLICE bytes of text at a time, with their search after the first `upto` levels."""
        z = zstandard.ZstdDecompressor()
        for b in batches:
            texts, start = [z.decompress(blob) for blob in b["blob"]], 0
            size = np.cumsum([len(t) for t in texts])
            while start < len(b):
                end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + SLICE, "right")))
                rows, part = b.iloc[start:end], texts[start:end]
                search, start = Search(part, window), end
                for level in range(upto):
                    told = [np.concatenate([np.empty(0, np.int64), *(np.asarray(x, np.int64) for x in rows[c] if x is not None)]).view(np.uint64) for c in (f"h{level}", f"g{level}") if c in rows]
                    search.drop(level, *told)
                yield rows, part, search

    for level in range(len(lengths)):

        def ask(batches: Iterator[pd.DataFrame], level: int = level) -> Iterator[pd.DataFrame]:
            for rows, _, search in searched(batches, level):
                h, h2, text, n = search.asked(level, rows["copies"].to_numpy(np.int64))
                yield pd.DataFrame({"h": h.view(np.int64), "h2": h2.view(np.int64), "key": rows["key"].to_numpy()[text], "n": n})
            tidy()

        asked = _with_alone(texts, alone).mapInPandas(ask, "h bigint, h2 bigint, key binary, n bigint")
        names = ["h", "h2"] if level == last else ["h"]
        once = asked.groupBy(*names).agg(F.sum("n").alias("n"), F.min("key").alias("key")).filter("n = 1")
        lists = [F.collect_list(F.struct(*names)).alias("both")]
        found = once.groupBy("key").agg(*lists).select("key", *[F.col(f"both.{c}").alias(f"{'hg'[k]}{level}") for k, c in enumerate(names)])
        alone.append(_bucketed(found))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, texts, search in searched(batches, len(lengths)):
            gone = search.removed()
            many = np.diff(np.append(0, np.cumsum(gone))[search.first])
            kept, spans = [], []
            for k, t in enumerate(texts):
                words, edge = t.split(), []
                if many[k]:
                    mine = gone[search.first[k] : search.first[k + 1]]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
                    words = list(itertools.compress(words, (~mine).tolist()))
                kept.append(b" ".join(words).decode("utf-8", "replace"))
                spans.append(edge)
            yield pd.DataFrame({"text_key": rows["key"].to_numpy(), "copies": rows["copies"].to_numpy(), "n_words": np.diff(search.first), "n_removed": many, "spans": spans, "kept": kept})
        tidy()

    return _with_alone(texts, alone).mapInPandas(finish, "text_key binary, copies bigint, n_words bigint, n_removed bigint, spans array<array<int>>, kept string")


def _with_alone(texts: DataFrame, alone: list[DataFrame]) -> DataFrame:
    """Texts with the hashes that came back to them so far; all are buckets of the same key."""
    for table in alone:
        texts = texts.join(table, "key", "left")
    return texts


def remove_repeats(docs: DataFrame, window: int = 35, text_col: str = "text") -> DataFrame:
    """`docs` with the text of each document that has repeated windows replaced by its kept words; other texts stay as they
    are. Rows and columns stay, whatever their names; null and blank texts, and empty tables, as `repeated_words` says."""
    names = docs.columns
    inner = docs.toDF(*[f"c{k}" for k in range(len(names))])
    text = F.col(f"c{names.index(text_col)}")
    changed = cut(repeated_words(docs.select(text_col), window, text_col).filter("n_removed > 0").select("text_key", "copies", "kept"))
    keyed = inner.withColumn("text_key", F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    joined = join_copies(keyed, changed, "text_key", "copies", "left")
    return joined.select(*[(F.coalesce("kept", text) if c == text_col else F.col(f"c{k}")).alias(c) for k, c in enumerate(names)])
