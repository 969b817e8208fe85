"""Cross-tokenizer alignment: distinct texts are tokenised and aligned once, pair counts are weighted by their copies."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.llm.common import Words, cut, join_copies, slices, small_batches, tidy
from gradeline.llm.tokens import Memo, byte_signs

#: Chunks kept with their alignment in a worker; the memory is bounded, the results don't depend on it.
MEMO_CHUNKS = 300_000
#: Up to so many id pairs (16 bytes each) go to the tasks whole; more are joined by shuffles.
BROADCAST_PAIRS = 2_000_000
#: A group of more token pairs than this is counted by its distinct ids.
WIDE_GROUP = 64
#: New chunks go through the tokenizers in texts of about so many bytes, each after a lead that is left out again.
RUN, LEAD = 20_000, b" a"
#: An id pair is A's id times 2^SHIFT plus B's.
SHIFT = 24
#: One id pair of a chunk and how often it is linked there.
LINK = np.dtype([("code", np.int64), ("n", np.int64)])


class Chunks(Words):
    """Pieces of texts that both tokenizers cut alike: each starts where a space or a newline follows a character that is
    certainly no white space. Texts are given with their leading space."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
        self.data = np.frombuffer(data, np.uint8, at[-1] - at[0], at[0])
        at = at - at[0]
        after = np.flatnonzero((self.data == 0x20) | (self.data == 0x0A))
        after = after[after > 0]
        starts = after[self._solid(after)]
        self.start = np.union1d(starts, at[:-1][np.diff(at) > 0])
        self.end = np.append(self.start[1:], len(self.data))
        self.first = np.searchsorted(self.start, at)

    def _solid(self, at: np.ndarray) -> np.ndarray:
        """Whether the character that ends at each place is certainly no white space (some others are passed over)."""
        back = lambda k: self.data[np.maximum(at - k, 0)]
        last, before = back(1), back(2)
        two = (before == 0xC2) & ((last == 0x85) | (last == 0xA0))
        three = (last >= 0x80) & (back(3) >= 0xE1) & (back(3) <= 0xE3)
        return (last > 0x20) & ~two & ~three

    def joins(self) -> np.ndarray:
        """Whether another chunk may follow each one in a text of our own making: it ends in no white space."""
        return self._solid(self.end)


class Aligner:
    """Ids of both tokenizers and their alignment, chunk by chunk.

    Chunks are known by 64-bit hashes; of 10^13 chunks about one may read as another."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_path), sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a.encode_special_tokens = True
        back = {sign: byte for byte, sign in byte_signs().items()}
        entries = {k: v for v, k in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(back[c] for c in entries[k]) if k in entries else b"" for k in range(max(entries) + 1)]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        if max(len(self.a_bytes), len(pieces)) > 1 << SHIFT or any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError(f"{piece_path}: too many ids, or pieces that span words")
        most = max(len(self.a_bytes), len(pieces))
        self.width = np.array([len(str(k)) for k in range(most)])
        self.digits = np.array([b"%d" % k for k in range(most)], f"S{self.width.max() + 1}").view(np.uint8).reshape(most, -1)
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self._forget()

    def _forget(self) -> None:
        self.memo, self.text, self.counts, self.bad = Memo(LINK), [], np.empty((0, 4), np.int64), np.empty(0, bool)

    def _told(self, runs: list[bytes]) -> list[tuple[list[int], list[int]] | None]:
        """The ids of texts that start with a space; None where the tokens' bytes are not the text's."""
        seen = [r.decode("utf-8", "replace") for r in runs]
        got = zip((e.ids for e in self.a.encode_batch_fast(seen, add_special_tokens=False)), self.b.encode([x[1:] for x in seen], num_threads=1), runs, strict=True)
        return [(a, b) if b"".join(map(self.a_bytes.__getitem__, a)) == r and b"".join(map(self.b_bytes.__getitem__, b)) == r else None for a, b, r in got]

    def _learn(self, hashes: np.ndarray, chunks: list[bytes], joins: np.ndarray) -> None:
        """Chunks go through the tokenizers in texts of about RUN bytes, led by LEAD; one that may not be followed goes alone.
        A text that is not told back is halved until the chunks at fault are alone."""
        sizes = np.array([len(c) for c in chunks])
        edge = np.append(True, (np.cumsum(sizes)[1:] // RUN != np.cumsum(sizes)[:-1] // RUN) | ~joins[1:] | ~joins[:-1])
        cuts = [*np.flatnonzero(edge).tolist(), len(chunks)]
        todo, good = list(zip(cuts[:-1], cuts[1:], strict=True)), []
        bad = np.zeros(len(chunks), bool)
        while todo:
            told = self._told([LEAD + b"".join(chunks[x:y]) for x, y in todo])
            good += [(x, y, *t) for (x, y), t in zip(todo, told, strict=True) if t is not None]
            wrong = [span for span, t in zip(todo, told, strict=True) if t is None]
            bad[[x for x, y in wrong if y == x + 1]] = True
            todo = [half for x, y in wrong if y > x + 1 for half in ((x, (x + y) // 2), ((x + y) // 2, y))]
        good.sort(key=lambda t: t[0])
        # where each good chunk stands among the chunks and the leads
        spans, lead = [np.concatenate([[len(LEAD)], sizes[x:y]]) for x, y, _, _ in good], []
        for x, y, _, _ in good:
            lead += [True, *[False] * (y - x)]
        told = [np.concatenate([np.empty(0, np.int64), *(np.array(t[k], np.int64) for t in good)]) for k in (2, 3)]
        links, n_links, counts, text = self._align(*told, np.concatenate([np.empty(0, np.int64), *spans]), np.array(lead, bool))
        every, kept = np.zeros((len(chunks), 4), np.int64), np.zeros(len(chunks), np.int64)
        every[~bad], kept[~bad] = counts, n_links
        text = iter(text)
        self.text += [b"" if x else next(text) for x in bad.tolist()]
        self.memo.add(hashes, links, kept)
        self.counts = np.concatenate([self.counts, every])
        self.bad = np.concatenate([self.bad, bad])

    def _align(self, a: np.ndarray, b: np.ndarray, size: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Of each chunk that is no lead: its links one after another, how many, (n_a, n_b, n_groups, n_links), and its groups as text."""
        a_ends, b_ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_to, b_to = np.searchsorted(a_ends, both, "right"), np.searchsorted(b_ends, both, "right")
        a_at, b_at = np.append(0, a_to[:-1])[: len(both)], np.append(0, b_to[:-1])[: len(both)]
        n_a, n_b = a_to - a_at, b_to - b_at
        chunk = np.searchsorted(np.cumsum(size), both)
        wide = n_a * n_b > WIDE_GROUP
        n = np.where(wide, 0, n_a * n_b)
        group = np.repeat(np.arange(len(both)), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        code = (a[a_at[group] + k // n_b[group]] << SHIFT) | b[b_at[group] + k % n_b[group]]
        where, times = chunk[group], np.ones(len(code), np.int64)
        more = [(where, code, times)]
        for g in np.flatnonzero(wide).tolist():
            (x, nx), (y, ny) = (np.unique(t[s:e], return_counts=True) for t, s, e in ((a, a_at[g], a_to[g]), (b, b_at[g], b_to[g])))
            more.append((np.full(len(x) * len(y), chunk[g]), ((x[:, None] << SHIFT) | y[None, :]).ravel(), (nx[:, None] * ny[None, :]).ravel()))
        where, code, times = (np.concatenate(t) for t in zip(*more, strict=True))
        order = np.argsort(where, kind="stable") if len(more) > 1 else np.arange(len(where))
        order = order[~lead[where[order]]]
        links = np.empty(len(order), LINK)
        links["code"], links["n"] = code[order], times[order]
        total = lambda x: np.bincount(chunk, x, len(size)).astype(np.int64)[~lead]
        counts = np.stack([total(n_a), total(n_b), total(np.ones(len(both))), total(n_a * n_b)], 1)
        # the groups' text: each id with the sign after it, A's ids of a group before B's
        ids, sign = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[np.arange(len(a)) + np.repeat(b_at, n_a)] = a
        ids[np.arange(len(b)) + np.repeat(a_to, n_b)] = b
        sign[a_to - 1 + b_at], sign[b_to - 1 + a_to] = ord("|"), ord(";")
        shown, width = self.digits[ids], self.width[ids]
        shown[np.arange(len(ids)), width] = sign
        raw = shown[np.arange(shown.shape[1]) <= width[:, None]].tobytes()
        upto = np.append(0, np.cumsum(width + 1))
        last = np.append(0, (a_to + b_to)[np.searchsorted(chunk, np.arange(len(size)), "right") - 1]) if len(both) else np.zeros(1, np.int64)
        begin, end = upto[last[:-1]][~lead], upto[last[1:]][~lead]
        return links, np.bincount(where[order], minlength=len(size))[~lead], counts, [raw[s : e - 1] for s, e in zip(begin.tolist(), end.tolist(), strict=True)]

    def texts(self, column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """For texts that are neither null nor empty: counts (four each), the hash of the groups, where each text's distinct
        links begin (and the end), and these links in order of their codes."""
        spaced = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), column.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()))
        chunks = Chunks(spaced)
        hashes = chunks.hashes()
        found = self.memo.find(hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, first = np.unique(hashes[new], return_index=True)
            if self.memo.n and self.memo.n + len(distinct) > MEMO_CHUNKS:
                # what came first came often; later chunks make room
                keep = MEMO_CHUNKS * 3 // 4
                self.memo.forget(keep)
                self.text, self.counts, self.bad = self.text[:keep], self.counts[:keep], self.bad[:keep]
                new = np.flatnonzero(self.memo.find(hashes) < 0)
                distinct, first = np.unique(hashes[new], return_index=True)
            first, raw = new[first], chunks.data.tobytes()
            self._learn(distinct, [raw[s:e] for s, e in zip(chunks.start[first].tolist(), chunks.end[first].tolist(), strict=True)], chunks.joins()[first])
            found = self.memo.find(hashes)
        n = len(column)
        text = np.repeat(np.arange(n), np.diff(chunks.first))
        bad = np.bincount(text, self.bad[found], n) > 0
        counts = np.stack([np.bincount(text, self.counts[found, k], n).astype(np.int64) for k in range(4)], 1)
        counts[bad] = 0
        told = list(map(self.text.__getitem__, found.tolist()))
        at = chunks.first.tolist()
        groups = ["" if b else hashlib.sha256(b";".join(told[s:e])).hexdigest() for s, e, b in zip(at[:-1], at[1:], bad.tolist(), strict=True)]
        size = np.where(bad[text], 0, self.memo.size[found].astype(np.int64))
        place = np.repeat(self.memo.start[found] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        links, text = self.memo.pool[place], np.repeat(text, size)
        order = np.argsort((text << 2 * SHIFT) | links["code"])
        links, text = links[order], text[order]
        begin = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (links["code"][1:] != links["code"][:-1]))) if len(links) else np.empty(0, np.int64)
        out = links[begin]
        if len(begin):
            out["n"] = np.add.reduceat(links["n"], begin)
        return counts, groups, np.searchsorted(text[begin], np.arange(n + 1)), out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One for each worker process."""
    if (byte_path, piece_path) not in _aligners:
        _aligners[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return _aligners[byte_path, piece_path]


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def align_texts(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, text_col: str = "text") -> DataFrame:
    """For each distinct text that is neither null nor empty: `text_key` (SHA-256), copies (rows), n_a, n_b, n_groups, n_links,
    groups_sha256, and its distinct linked id pairs: codes (A's id times 2^SHIFT plus B's) and times (linked occurrences).

    Equal texts meet by their full text, summed before the exchange, so that a text of many copies is one row a task. Texts
    that a tokenizer can't give back byte by byte have zeros, no pairs and an empty groups_sha256. Token ids are those of the
    whole text, found chunk by chunk: no token of either tokenizer spans a chunk's border. An empty table gives an empty
    result; other columns don't matter; very long texts are read whole, in one task each.
    """
    import public_tokenizers

    small_batches(docs.sparkSession)
    paths = (byte_path or public_tokenizers.path("byte_bpe_50k.json"), piece_path or public_tokenizers.path("piece_bpe_32k.model"))
    distinct = docs.select(F.col(text_col).alias("text")).filter(F.length("text") > 0).groupBy("text").agg(F.count("*").alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        for b in batches:
            start = 0
            for part in slices(b.column("text"), 1 << 19):
                rows, start = b.slice(start, len(part)), start + len(part)
                counts, groups, at, links = own.texts(part)
                at = pa.array(at, pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(links[c], pa.int64())) for c in ("code", "n")]
                yield pa.RecordBatch.from_arrays([rows.column("text_key"), rows.column("copies"), *(pa.array(counts[:, k]) for k in range(4)), pa.array(groups, pa.string()), *lists], names=[x.split()[0] for x in schema.split(", ")])
        tidy()

    schema = "text_key binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, codes array<bigint>, times array<bigint>"
    return distinct.select("text", text_key(F.col("text")).alias("text_key"), "copies").mapInArrow(run, schema)


def pair_counts(texts: DataFrame) -> DataFrame:
    """From rows of `align_texts`: code, a, b, how many documents hold the pair linked (n_docs), and whether that is the
    highest number of its A id (best). Sums are made before the exchange; an A id has no more rows than B has ids."""
    counted = texts.select("copies", F.explode("codes").alias("code")).groupBy("code").agg(F.sum("copies").alias("n_docs"))
    counted = cut(counted.withColumns({"a": F.shiftright("code", SHIFT), "b": F.col("code").bitwiseAND(F.lit((1 << SHIFT) - 1))}))
    most = counted.groupBy("a").agg(F.max("n_docs").alias("_most"))
    return counted.join(most, "a").select("code", "a", "b", "n_docs", (F.col("n_docs") == F.col("_most")).alias("best"))


def pair_measures(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each text_key that has links: n_best (links of a best pair) and count_sum (n_docs over all links).

    Up to BROADCAST_PAIRS id pairs go to the tasks whole; more meet the links by their code, hot codes dealt to many tasks."""
    links = texts.select("text_key", F.explode(F.arrays_zip("codes", "times")).alias("link")).select("text_key", F.col("link.codes").alias("code"), F.col("link.times").alias("times"))
    if pairs.count() <= BROADCAST_PAIRS:
        met = links.join(F.broadcast(pairs.select("code", "n_docs", "best")), "code")
    else:
        met = join_copies(links, pairs.select("code", "n_docs", "best", F.col("n_docs").alias("_copies")), "code", "_copies")
    return met.groupBy("text_key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n_docs") * F.col("times")).alias("count_sum"))


def align_documents(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (see `align_texts` and
    `pair_measures`). Null and empty texts, and those that can't be told back, have zeros and an empty string; repeated rows
    give a row each; a null id stays null; other columns, whatever their names, don't matter; no rows give no rows."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    texts = cut(align_texts(rows, byte_path, piece_path, "_text"))
    pairs = cut(pair_counts(texts))
    found = texts.drop("codes", "times").join(pair_measures(texts, pairs), "text_key", "left")
    keyed = rows.select("_id", F.when(F.length("_text") > 0, text_key(F.col("_text"))).alias("text_key"))
    zero = F.lit(0).cast("long")
    numbers = [F.coalesce(c, zero).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return join_copies(keyed, cut(found), "text_key", "copies", "left").select(F.col("_id").alias(id_col), *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
