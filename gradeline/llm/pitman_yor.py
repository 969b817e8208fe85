"""Language-model scoring by a hierarchical Pitman-Yor model of word triples."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.llm.common import Words, cut, mix64, slices, small_batches, tidy

#: Tokens read for text start and end (their hashes; words hash to 64 bits as well).
START, END = 1, 2
#: Concentration of all restaurants; Gibbs sweeps thrown away, and averaged.
THETA, BURN, KEEP = 1.0, 2, 4
#: A middle word's discounts are estimated as if PRIOR_WEIGHT customers with the discount PRIOR had been seen before.
PRIOR, PRIOR_WEIGHT = 0.75, 10.0
#: Tokens that one owner loads at once, on average, and tokens of a chunk of documents.
OWNER_TOKENS, CHUNK = 2_000_000, 2_000_000
#: Seats that many dishes take together; further ones of a dish are drawn in rows. Both draw the same numbers.
TOGETHER = 1000


def _press(*arrays: np.ndarray) -> bytes:
    """The arrays in few bytes: the first bytes of all numbers, then the second ones, and so on."""
    return zstandard.ZstdCompressor(3).compress(pickle.dumps([(a.dtype.str, a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) for a in map(np.ascontiguousarray, arrays)]))


def _open(blob: bytes) -> list[np.ndarray]:
    loaded = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
    return [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(t).itemsize, -1).T).view(t).ravel() for t, b in loaded]


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a column of texts (words with A-Z lower-cased, hashed, and an end after each text), and each text's number."""
    words = Words(column)
    many = np.diff(words.first) + 1
    w = np.full(int(many.sum()), END, np.uint64)
    inside = np.ones(len(w), bool)
    inside[np.cumsum(many) - 1] = False
    w[inside] = words.hashes(lower=True)
    return w, many


def class_of(words: np.ndarray) -> np.ndarray:
    """The class of 65,536 that stands for a word as the one before the middle word."""
    return (mix64(words) >> np.uint64(48)).astype(np.uint16)


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, in as few bytes as hold them."""
    steps = np.diff(ascending, prepend=np.uint64(0))
    return steps.astype(np.uint32) if not len(steps) or steps.max() < 1 << 32 else steps


def uniform(key: np.ndarray, sweep: int, seat: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) that the dish's key, the sweep and the seat fix, wherever they are drawn."""
    salt = np.atleast_1d(np.asarray(seat, np.uint64)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64((sweep + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return (mix64(key + mix64(salt)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def seat(c: np.ndarray, others: np.ndarray, share: np.ndarray, discount: np.ndarray, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each dish after seating its c customers one by one, by the Chinese restaurant process.

    The first customer opens a table. With k seated at t tables the next opens one more with probability
    a / (a + k - discount * t), where a = (THETA + discount * (others + t)) * share; others: the restaurant's tables of
    other dishes, share: the parent's probability of the dish.
    """
    tables = np.minimum(c, 1).astype(np.float64)
    k, todo = 1, np.flatnonzero(c > 1)
    while len(todo) and k < TOGETHER:
        t, d = tables[todo], discount[todo]
        a = (THETA + d * (others[todo] + t)) * share[todo]
        tables[todo] += uniform(key[todo], sweep, k) * (a + k - d * t) < a
        k += 1
        todo = todo[c[todo] > k]
    for i in todo.tolist():
        t, d, size = tables[i], discount[i], int(c[i])
        for begin in range(TOGETHER, size, 4096):
            seats = np.arange(begin, min(size, begin + 4096))
            drawn, at = uniform(key[i : i + 1], sweep, seats), 0
            while at < len(seats):
                a, few = (THETA + d * (others[i] + t)) * share[i], slice(at, at + 500)
                opens = drawn[few] * (a + seats[few] - d * t) < a
                step = int(opens.argmax())
                t, at = (t + 1, at + step + 1) if opens[step] else (t, at + len(opens))
        tables[i] = t
    return tables


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of numbers below 2^31 in order, (a, b), and for each row the place of its pair; all in 32 bits."""
    codes = a.astype(np.int64)
    codes <<= 32
    codes |= b
    order = np.argsort(codes)
    codes = codes[order]
    new = np.append(True, codes[1:] != codes[:-1]) if len(codes) else np.empty(0, bool)
    place = np.empty(len(codes), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    codes = codes[new]
    return (codes >> 32).astype(np.int32), codes.astype(np.uint32).view(np.int32), place


def _discounts(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """n1 / (n1 + 2 n2) of counts of counts, drawn towards PRIOR."""
    return np.clip((n1 + PRIOR * PRIOR_WEIGHT) / (n1 + 2 * n2 + PRIOR_WEIGHT), 0.05, 0.95)


def _reseat(c2: np.ndarray, own: np.ndarray, tables: np.ndarray, c1: np.ndarray, t1: np.ndarray, base: np.ndarray, c: np.ndarray, t: np.ndarray, d1: np.ndarray, d2: np.ndarray, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of the lower level's dishes after a sweep. own, tables: of the dish, of its restaurant; c1, t1: the dish's customers
    and tables in the parent; c, t: all of the parent's."""
    rest = c1 - own
    held = np.minimum(t1, rest)
    share = np.maximum(rest - d1 * held, 0) + (THETA + d1 * (t - t1 + held)) * base
    share /= THETA + c - own
    return seat(c2, tables - own, share, d2, key, 2 * sweep)


def _key_lower(classes: np.ndarray, middles: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix64(mix64(mix64(classes.astype(np.uint64)) + middles) + words)


def _key_upper(middles: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix64(mix64(mix64(middles)) + words)


class Parents(NamedTuple):
    """What several owners share of a word's restaurant, before each sweep and after the last (the first axis, where there is one).

    keys: (number of the middle word << 32 | number of the word), ascending; c1, t1: these dishes' customers and tables;
    c, t: all of a middle word's; d1, d2: its discounts (those of other middle words are not read).
    """

    keys: np.ndarray
    c1: np.ndarray
    t1: np.ndarray
    c: np.ndarray
    t: np.ndarray
    d1: np.ndarray
    d2: np.ndarray


def log_probabilities(u: np.ndarray, v: np.ndarray, w: np.ndarray, count: np.ndarray, middles: np.ndarray, words: np.ndarray, base: np.ndarray, shares: np.ndarray, parents: Parents | None = None) -> np.ndarray:
    """log10 of the model's probability for each row (u: class, v: number in `middles`, w: number in `words`; count: how often
    training has the row).

    A restaurant (u, v) serves the words after u v; its parent is that of v, whose own parent is `base`. One sweep seats
    the customers of all dishes of the lower level anew, given the parents, then those of the upper level, whose customers
    are the lower one's tables; a dish's own tables are taken out of both levels first. All dishes of a level are seated
    at the same time, given the others as they were. Probabilities are averaged over the KEEP sweeps after BURN.
    shares: to how many owners a middle word is dealt; where these are several, the rows are one owner's, and `parents` tells
    the word's restaurant, which all of them seated together (`shared_parents`).
    """
    n = len(middles)
    cv, cu, context = _distinct(v, u)
    r, tw, row = _distinct(context, w)
    del context
    c2 = np.bincount(row, count, len(r)).astype(np.int32)
    q = cv[r]
    pq, pw, p = _distinct(q, tw)
    again = np.flatnonzero(c2 > 1)
    key2 = _key_lower(cu[r[again]], middles[q[again]], words[tw[again]])
    del tw
    key1 = _key_upper(middles[pq], words[pw])
    t2 = np.minimum(c2, 1).astype(np.float32)
    c1 = np.bincount(p, t2, len(pq))
    t1 = np.minimum(c1, 1)
    d2, d1 = (_discounts(*(np.bincount(group[counts == k], minlength=n) for k in (1, 2))) for counts, group in ((c2, q), (c1, pq)))
    size2 = np.bincount(r, c2, len(cv))
    pr, qr, g1 = p[again], q[again], base[pw]
    told, far = np.flatnonzero(shares > 1), np.flatnonzero(shares[pq] > 1)
    if len(told):
        d1[told], d2[told] = parents.d1[told], parents.d2[told]
        at = np.searchsorted(parents.keys, pq[far].astype(np.int64) << 32 | pw[far])
        c1[far], t1[far] = parents.c1[0, at], parents.t1[0, at]

    def sums(sweep: int) -> tuple[np.ndarray, np.ndarray]:
        c, t = np.bincount(pq, c1, n), np.bincount(pq, t1, n)
        if len(told):
            c[told], t[told] = parents.c[sweep, told], parents.t[sweep, told]
        return c, t

    c, t = sums(0)
    total = np.zeros(len(r))
    for sweep in range(BURN + KEEP):
        t2[again] = _reseat(c2[again], t2[again], np.bincount(r, t2, len(cv))[r[again]], c1[pr], t1[pr], g1[pr], c[qr], t[qr], d1[qr], d2[qr], key2, sweep)
        c1 = np.bincount(p, t2, len(pq))
        c1[far] = 0
        t1 = np.minimum(t1, c1)
        t1 = seat(c1.astype(np.int64), np.bincount(pq, t1, n)[pq] - t1, g1, d1[pq], key1, 2 * sweep + 1)
        if len(far):
            c1[far], t1[far] = parents.c1[sweep + 1, at], parents.t1[sweep + 1, at]
        c, t = sums(sweep + 1)
        if sweep >= BURN:
            upper = (np.maximum(c1 - d1[pq] * t1, 0) + (THETA + d1 * t)[pq] * g1) / (THETA + c)[pq]
            tables = np.bincount(r, t2, len(cv))
            for k in range(0, len(r), 1 << 18):
                x = slice(k, k + (1 << 18))
                d = d2[q[x]]
                total[x] += (np.maximum(c2[x] - d * t2[x], 0) + (THETA + d * tables[r[x]]) * upper[p[x]]) / (THETA + size2[r[x]])
    return np.log10(total / KEEP)[row]


def vocabulary(own: DataFrame) -> DataFrame:
    """(`w`, `seen`, `n`): each token's number in the training rows and in all; for the text start, n is the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, learn, size = [], [], 0

        def counted() -> pa.RecordBatch:
            w, at = np.unique(np.concatenate(held), return_inverse=True)
            seen, n = np.bincount(at, np.concatenate(learn), len(w)).astype(np.int64), np.bincount(at, minlength=len(w))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (w.view(np.int64), seen, n)], names=["w", "seen", "n"])

        for b in batches:
            w, many = tokens_of(b.column("_text"))
            flags = np.repeat(b.column("_train").to_numpy(zero_copy_only=False).astype(bool), many)
            held += [w, np.full(b.num_rows, START, np.uint64)]
            learn += [flags, np.zeros(b.num_rows, bool)]
            size += len(w)
            if size >= 2 * CHUNK:
                yield counted()
                held, learn, size = [], [], 0
        if held:
            yield counted()
        tidy()

    return own.select("_text", "_train").mapInArrow(count, "w bigint, seen bigint, n bigint").groupBy("w").agg(F.sum("seen").alias("seen"), F.sum("n").alias("n"))


def _lists(frame: pd.DataFrame) -> tuple[list[int], list[np.ndarray], list[list[np.ndarray]]]:
    """What shares of a word told a block first: the shares, the dishes of each, and further facts of these."""
    frame = frame.sort_values("other")
    loaded = [_open(x) for x in frame["blob"]]
    return frame["other"].tolist(), [np.cumsum(x[0], dtype=np.uint64) for x in loaded], [x[1:] for x in loaded]


def shared_parents(own: DataFrame, hot_words: np.ndarray, hot_shares: np.ndarray, seen_short: DataFrame, total: int, owner_of: Callable) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """The restaurants of middle words with too many tokens for one owner; the same sweeps as in `log_probabilities`.

    A word's triples are dealt to shares by the class before it, and its dishes to as many blocks by the word that follows. In
    each sweep a block tells the shares its dishes' state, the shares seat their own and tell the tables they opened, and the
    blocks add these up and seat them. A word's totals (a row for each word) go through the driver, twice a sweep. Only
    dishes that can change take part. Gives rows like those of chunks (`owner`: of a word's share by `owner_of`, `chunk`: -1 -
    the word's number, `tokens`: dishes, customers and tables before each sweep and after the last), and the words' totals and
    discounts.
    """
    first_share = np.cumsum(hot_shares) - hot_shares
    sends, rooms = "h int, part int, other int, blob binary", "h int, part int, fixed binary, dishes binary, seats binary, c bigint, t bigint, n1 bigint, n2 bigint, m1 bigint, m2 bigint"
    low = np.uint64((1 << 40) - 1)

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            share, code, learn = map(np.concatenate, zip(*held, strict=True))
            order = np.argsort(share, kind="stable")
            share, code, learn = share[order], code[order], learn[order]
            edges, rows = np.flatnonzero(np.append(True, share[1:] != share[:-1])).tolist() + [len(share)], []
            for a, z in zip(edges, edges[1:]):
                codes, at = np.unique(code[a:z], return_inverse=True)
                used, place = np.unique(codes & low, return_inverse=True)
                classes = (codes >> np.uint64(40)).astype(np.uint16)
                h = int(np.searchsorted(first_share, share[a], "right")) - 1
                rows.append((h, int(share[a] - first_share[h]), _press(_steps(used), place.astype(np.uint32), np.diff(classes, prepend=np.uint16(0)), np.bincount(at, learn[a:z], len(codes)).astype(np.uint32))))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["h", "part", "blob"])

        for b in batches:
            start = 0
            for text in slices(b.column("_text"), 1 << 20):
                flags = b.column("_train").slice(start, len(text)).to_numpy(zero_copy_only=False).astype(bool)
                start += len(text)
                w, many = tokens_of(text)
                first = np.cumsum(many) - many
                v = np.roll(w, 1)
                v[first] = START
                u = np.roll(v, 1)
                u[first] = START
                h = np.minimum(np.searchsorted(hot_words, v), len(hot_words) - 1)
                x = np.flatnonzero(hot_words[h] == v)
                if not len(x):
                    continue
                classes, h = class_of(u[x]), h[x]
                held.append((first_share[h] + classes % hot_shares[h], classes.astype(np.uint64) << np.uint64(40) | w[x] >> np.uint64(24), np.repeat(flags, many)[x]))
                size += len(x)
                if size >= CHUNK:
                    yield counted()
                    held.clear()
                    size = 0
        if held:
            yield counted()
        tidy()

    def gather(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        h, share = map(int, key)
        loaded = [_open(x) for x in frame["blob"]]
        code = [np.cumsum(classes, dtype=np.uint16).astype(np.uint64) << np.uint64(40) | np.cumsum(used, dtype=np.uint64)[place] for used, place, classes, _ in loaded]
        code, at = np.unique(np.concatenate(code), return_inverse=True)
        c2 = np.bincount(at, np.concatenate([x[3] for x in loaded]), len(code)).astype(np.uint32)
        del loaded, at
        short, classes = code & low, (code >> np.uint64(40)).astype(np.uint16)
        block = (mix64(short) % np.uint64(hot_shares[h])).astype(np.int32)
        order = np.lexsort((classes, short, block))
        short, classes, block, c2 = short[order], classes[order], block[order], c2[order]
        new = np.append(True, short[1:] != short[:-1])
        dish, again, once = np.cumsum(new) - 1, c2 > 1, c2 == 1
        dishes, block = short[new], block[new]
        ones, many = (np.bincount(dish, x, len(dishes)).astype(np.uint32) for x in (once, again))
        met = np.unique(classes[again])
        rows = [(h, share, -1, _press(np.diff(classes[again], prepend=np.uint16(0)), c2[again], np.diff(dishes[many > 0], prepend=np.uint64(0)), many[many > 0], np.bincount(classes, once, 65_536)[met].astype(np.uint32)))]
        edges = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist() + [len(block)]
        for a, z in zip(edges, edges[1:]):
            counts = np.array([once.sum(), (c2 == 2).sum()] if not a else [0, 0], np.int64)
            rows.append((h, int(block[a]), share, _press(_steps(dishes[a:z]), ones[a:z], many[a:z], counts)))
        tidy()
        return pd.DataFrame(rows, columns=["h", "part", "other", "blob"])

    told = cut(own.mapInArrow(triples, "h int, part int, blob binary").groupBy("h", "part").applyInPandas(gather, sends))
    shares, lists = told.filter("other < 0"), told.filter("other >= 0")

    def known(dishes: list[np.ndarray], facts: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
        """All dishes of a block, each one's place for each share, customers seated for good and now, and whether these can change."""
        every = np.unique(np.concatenate(dishes))
        places = [np.searchsorted(every, x) for x in dishes]
        ones, again = (np.bincount(np.concatenate(places), np.concatenate([x[k] for x in facts]), len(every)).astype(np.int64) for k in (0, 1))
        return every, places, ones, ones + again, (again > 0) | (ones > 1)

    def ask(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        every, *_, moving = known(*_lists(frame)[1:])
        return pd.DataFrame({"h": np.int32(key[0]), "part": np.int32(key[1]), "w": every[moving].view(np.int64)})

    counts = lists.groupBy("h", "part").applyInPandas(ask, "h int, part int, w bigint").join(seen_short, "w")

    def open_block(key: tuple, frame: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        others, dishes, facts = _lists(frame)
        every, places, ones, c1, moving = known(dishes, facts)
        number, seen = np.cumsum(moving) - 1, np.zeros(int(moving.sum()), np.int64)
        np.add.at(seen, np.searchsorted(every[moving], counts["w"].to_numpy(np.int64).view(np.uint64)), counts["seen"].to_numpy(np.int64))
        asked = [(np.diff(number[at[x[1] > 0]], prepend=0), x[1][x[1] > 0]) for at, x in zip(places, facts, strict=True)]
        still = np.array([c1[~moving].sum()])
        fixed = _press(_steps(every[moving]), seen, ones[moving], np.array(others), np.array([len(x) for x, _ in asked]), *map(np.concatenate, zip(*asked, strict=True)), still)
        t1 = np.minimum(c1, 1)
        row = key[0], key[1], fixed, _press(*(x[moving].astype(np.uint32) for x in (c1, t1))), _press(np.ones(sum(int(m.sum()) for _, m in asked), np.uint32))
        return pd.DataFrame([(*row, c1.sum(), t1.sum(), (c1 == 1).sum(), (c1 == 2).sum(), *sum(x[2] for x in facts))], columns=list(rooms_of))

    rooms_of = [x.split()[0] for x in rooms.split(", ")]
    state = cut(lists.groupBy("h", "part").cogroup(counts.groupBy("h", "part")).applyInPandas(open_block, rooms))

    def sums(df: DataFrame, *names: str) -> list[np.ndarray]:
        out = np.zeros((len(names), len(hot_words)))
        for r in df.groupBy("h").agg(*(F.sum(x).alias(x) for x in names)).collect():
            out[:, r.h] = [r[x] for x in names]
        return list(out)

    c, t, n1, n2, m1, m2 = sums(state, *rooms_of[-6:])
    d1, d2 = _discounts(n1, n2), _discounts(m1, m2)
    states, totals = [state], [(c, t)]

    def sweep_once(state: DataFrame, sweep: int, c: np.ndarray, t: np.ndarray) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        def reply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for x in frame.itertuples(index=False):
                    _, seen, _, others, sizes, number, many, _ = _open(x.fixed)
                    (c1, t1), (t2,) = _open(x.dishes), _open(x.seats)
                    edges, seats = (np.cumsum(np.append(0, x), dtype=np.int64) for x in (sizes.astype(np.int64), many.astype(np.int64)))
                    for share, a, z in zip(others.tolist(), edges.tolist(), edges[1:].tolist(), strict=False):
                        if a < z:
                            at = np.cumsum(number[a:z])
                            rows.append((x.h, share, x.part, _press(c1[at], t1[at], seen[at], t2[seats[a] : seats[z]])))
                yield pd.DataFrame(rows, columns=["h", "part", "other", "blob"])

        def lower(key: tuple, mine: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
            if not len(mine) or not len(replies):
                return pd.DataFrame({"h": [], "part": [], "other": [], "blob": []})
            h, share = map(int, key)
            classes, c2, dishes, many, ones = _open(mine["blob"].iloc[0])
            replies = replies.sort_values("other")
            loaded = [_open(x) for x in replies["blob"]]
            c1, t1, seen, t2 = (np.concatenate([x[k] for x in loaded]).astype(np.float64) for k in range(4))
            classes, dishes = np.cumsum(classes, dtype=np.uint16), np.cumsum(dishes, dtype=np.uint64)
            p, r = np.repeat(np.arange(len(many)), many), np.unique(classes, return_inverse=True)[1]
            key2 = _key_lower(classes, hot_words[h], dishes[p])
            of_word = (np.full(len(p), x[h]) for x in (c, t, d1, d2))
            t2 = _reseat(c2.astype(np.int64), t2, (np.bincount(r, t2, len(ones)) + ones)[r], c1[p], t1[p], ((seen + 1) / total)[p], *of_word, key2, sweep).astype(np.uint32)
            edges = np.cumsum([0, *(len(x[3]) for x in loaded)])
            return pd.DataFrame([(h, b, share, _press(t2[a:z])) for b, a, z in zip(replies["other"], edges, edges[1:], strict=False)], columns=["h", "part", "other", "blob"])

        def collect(key: tuple, mine: pd.DataFrame, opened: pd.DataFrame) -> pd.DataFrame:
            row = mine.iloc[0].to_dict()
            _, _, ones, _, sizes, number, many, still = _open(row["fixed"])
            number = np.concatenate([np.cumsum(x) for x in np.split(number, np.cumsum(sizes)[:-1])])
            t2 = np.concatenate([np.empty(0, np.uint32), *(_open(x)[0] for x in opened.sort_values("other")["blob"])])
            c1 = (ones + np.bincount(np.repeat(number, many), t2, len(ones))).astype(np.uint32)
            t1 = np.minimum(_open(row["dishes"])[1], c1)
            row |= {"dishes": _press(c1, t1), "seats": _press(t2), "c": int(c1.sum() + still[0]), "t": int(t1.sum() + still[0])}
            return pd.DataFrame([row], columns=rooms_of)

        opened = shares.groupBy("h", "part").cogroup(state.mapInPandas(reply, sends).groupBy("h", "part")).applyInPandas(lower, sends)
        state = cut(state.groupBy("h", "part").cogroup(opened.groupBy("h", "part")).applyInPandas(collect, rooms))
        c, before = sums(state, "c", "t")

        def upper(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for row in frame.to_dict("records"):
                    h = row["h"]
                    dishes, seen, *_, still = _open(row["fixed"])
                    c1, t1 = _open(row["dishes"])
                    t1 = seat(c1.astype(np.int64), before[h] - t1, (seen + 1) / total, np.full(len(c1), d1[h]), _key_upper(hot_words[h : h + 1], np.cumsum(dishes, dtype=np.uint64)), 2 * sweep + 1)
                    rows.append(row | {"dishes": _press(c1, t1.astype(np.uint32)), "t": int(t1.sum() + still[0])})
                yield pd.DataFrame(rows, columns=rooms_of)

        state = cut(state.mapInPandas(upper, rooms))
        return state, c, sums(state, "t")[0]

    for sweep in range(BURN + KEEP):
        state, c, t = sweep_once(state, sweep, c, t)
        states.append(state)
        totals.append((c, t))

    def tell(key: tuple, frame: pd.DataFrame, course: pd.DataFrame) -> pd.DataFrame:
        others, dishes, facts = _lists(frame)
        every, places, _, c1, moving = known(dishes, facts)
        c1 = np.tile(c1.astype(np.uint32), (BURN + KEEP + 1, 1))
        t1 = np.minimum(c1, 1)
        for k, blob in zip(course["k"], course["dishes"], strict=True):
            c1[k, moving], t1[k, moving] = _open(blob)
        # most dishes stay as they are from sweep to sweep
        c1, t1 = (np.diff(x.astype(np.int32), axis=0, prepend=np.int32(0)) for x in (c1, t1))
        owners = owner_of(mix64(hot_words[key[0] : key[0] + 1]), np.array(others))
        return pd.DataFrame([(int(k), -1 - int(key[0]), _press(_steps(x), c1[:, at].ravel(), t1[:, at].ravel()), None) for k, x, at in zip(owners, dishes, places, strict=True)], columns=["owner", "chunk", "tokens", "ids"])

    course = reduce(DataFrame.unionAll, [x.select("h", "part", F.lit(k).alias("k"), "dishes") for k, x in enumerate(states)])
    out = lists.groupBy("h", "part").cogroup(course.groupBy("h", "part")).applyInPandas(tell, "owner int, chunk bigint, tokens binary, ids binary")
    return out, {"d1": d1, "d2": d2, "c": np.array([x for x, _ in totals]), "t": np.array([x for _, x in totals])}


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: `id_col`, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text).

    Tokens are the words with A-Z lower-cased and one end; a null or blank text is the end alone. The model learns from the
    rows where `train` is true (null: not). base: add-one unigrams. Model: the two words before a token are a restaurant
    whose customers are the words that follow them in training; all restaurants of one middle word share that word's
    restaurant as parent, and its base is the add-one unigram distribution (`log_probabilities`). The first of the two words
    counts by its class of 65,536, and a word that follows by 40 bits of its hash; both only save room in the exchange.
    Random numbers come from hashes of the words, so scores do not depend on how rows or words are dealt to tasks. Repeated
    rows are documents of their own; an empty table gives an empty result; other columns don't matter, whatever their names.

    Tasks. A chunk of documents sends its triples, packed, to the owners of their middle words; there are as many owners as
    keep an owner at OWNER_TOKENS on average. A middle word with more than half of that has several owners, to which the
    classes before it are dealt; they share its restaurant, which is seated first (`shared_parents`), so scores do not depend
    on the limit. There are at most 2 such words an owner's worth of tokens.
    Owners ask the vocabulary (a join) for the training counts of their words, seat, and return sums per document; the
    unigram part of a token comes from the owner that has it as middle word, which knows its count. What is exchanged grows
    in proportion to the tokens. All tokens after the same two words meet in one owner; repeats inside a document count as
    one row there.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    id_type = own.schema["_id"].dataType.simpleString()

    table = cut(vocabulary(own))
    word = F.col("w") != START
    learned, distinct, every = table.agg(F.sum("seen"), F.count_if(F.col("seen") > 0), F.sum(F.when(word, F.col("n")))).first()
    learned, distinct, every = learned or 0, distinct or 0, every or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-every // OWNER_TOKENS))
    limit = OWNER_TOKENS // 2
    hot = sorted((int(np.int64(r.w).view(np.uint64)), -(-r.n // limit), r.seen) for r in table.filter((F.col("n") > limit) & (F.col("w") != END)).collect())
    hot_words, hot_parts, hot_seen = (np.array([x[k] for x in hot], t) for k, t in enumerate((np.uint64, np.int64, np.int64)))
    ends = table.filter(F.col("w") == END).select("seen").first()
    ends = ends.seen if ends else 0

    def of_hot(words: np.ndarray, values: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """For hot words their values, for others those of rest."""
        if not len(hot_words):
            return rest
        at = np.minimum(np.searchsorted(hot_words, words), len(hot_words) - 1)
        return np.where(hot_words[at] == words, values[at], rest)

    def owner_of(mixed: np.ndarray, share: np.ndarray) -> np.ndarray:
        return mix64(mixed + share.astype(np.uint64) + np.uint64(1)) % np.uint64(parts)

    def pack_chunk(number: int, ids: list, flags: np.ndarray, many: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        n, first = len(w), np.cumsum(many) - many
        words, place = np.unique(np.append(w, np.uint64(START)), return_inverse=True)
        # the words before a token are the tokens before it, or the start
        place = place.astype(np.int32)
        wi, start = place[:n], place[n]
        vi, ui = np.roll(wi, 1), np.roll(wi, 2)
        vi[first] = ui[first] = start
        ui[first[many > 1] + 1] = start
        d = np.repeat(np.arange(len(ids), dtype=np.uint16), many)
        ui = class_of(words)[ui]
        if len(words) < 1 << 21:
            code = vi.astype(np.int64)
            for x in (ui, wi):
                code <<= 21
                code |= x
            order = np.argsort(code, kind="stable")
            del code
        else:
            order = np.lexsort((wi, ui, vi))
        ui, vi, wi, d = (x[order] for x in (ui, vi, wi, d))
        del place, order, w
        new = np.flatnonzero(np.append(True, (np.diff(vi) != 0) | (np.diff(ui) != 0) | (np.diff(wi) != 0) | (np.diff(d) != 0)))
        times = np.diff(np.append(new, n)).astype(np.uint32)
        ui, vi, wi, d = (x[new] for x in (ui, vi, wi, d))
        many_of, mixed = of_hot(words, hot_parts, np.ones(len(words), np.int64)), mix64(words)
        to = np.where(many_of[vi] > 1, owner_of(mixed[vi], ui % many_of[vi]), mixed[vi] % np.uint64(parts))
        to = to.astype(np.uint16 if parts < 65_536 else np.int64)
        order = np.argsort(to, kind="stable")
        ui, vi, wi, d, times, to = (x[order] for x in (ui, vi, wi, d, times, to))
        edges, home, bits, short = np.searchsorted(to, np.arange(parts + 1)), number % parts, np.packbits(flags), words >> np.uint64(24)
        rows = []
        for k in range(parts):
            a, z = edges[k], edges[k + 1]
            if a == z and k != home:
                continue
            run = np.flatnonzero(np.diff(vi[a:z], prepend=-1))
            if 8 * (z - a) < len(words):
                used, place = np.unique(wi[a:z], return_inverse=True)
            else:
                mask = np.zeros(len(words), bool)
                mask[wi[a:z]] = True
                used, place = np.flatnonzero(mask), (np.cumsum(mask) - 1)[wi[a:z]]
            held = _steps(words[vi[a:z][run]]), np.diff(np.append(run, z - a)).astype(np.uint32), _steps(short[used]), place.astype(np.uint16 if len(used) <= 65_536 else np.uint32), np.diff(ui[a:z], prepend=np.uint16(0)), d[a:z], times[a:z], bits
            rows.append((k, number, _press(*held), pickle.dumps((ids, many)) if k == home else None))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["owner", "chunk", "tokens", "ids"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, held, size = [], [], 0
        for b in batches:
            start = 0
            for part in slices(b.column("_text"), 1 << 22):
                flags = b.column("_train").slice(start, len(part)).to_numpy(zero_copy_only=False).astype(bool)
                ids += b.column("_id").slice(start, len(part)).to_pylist()
                start += len(part)
                w, many = tokens_of(part)
                held.append((flags, many, w))
                size += len(w)
                if size >= CHUNK or len(ids) >= 50_000:
                    yield pack_chunk(number, ids, *map(np.concatenate, zip(*held, strict=True)))
                    number, ids, held, size = number + 1, [], [], 0
        if held:
            yield pack_chunk(number, ids, *map(np.concatenate, zip(*held, strict=True)))
        tidy()

    seen_short = table.filter("seen > 0").select(F.shiftrightunsigned("w", 24).alias("w"), "seen")
    sent, shared = own.mapInArrow(send, "owner int, chunk bigint, tokens binary, ids binary"), {}
    if len(hot_words):
        rooms, shared = shared_parents(own, hot_words, hot_parts, seen_short, learned + distinct + 1, owner_of)
        sent = sent.unionAll(rooms)
    sent = sent.groupBy("owner")

    def shorts(blob: list[np.ndarray]) -> np.ndarray:
        return np.cumsum(blob[2], dtype=np.uint64)

    def ask(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        words = np.unique(np.concatenate([shorts(_open(x)) for x in frame["tokens"][frame["chunk"] >= 0]]))
        return pd.DataFrame({"owner": np.int32(key[0]), "w": words.view(np.int64)})

    told = sent.applyInPandas(ask, "owner int, w bigint").join(seen_short, "w").groupBy("owner")

    def parents_of(frame: pd.DataFrame, middles: np.ndarray, words: np.ndarray) -> Parents | None:
        if not len(frame):
            return None
        at = np.searchsorted(middles, hot_words)
        here = np.flatnonzero((at < len(middles)) & (middles[np.minimum(at, len(middles) - 1)] == hot_words))
        keys, c1, t1 = [], [], []
        for chunk, blob in zip(frame["chunk"], frame["tokens"], strict=True):
            dishes, *course = _open(blob)
            keys.append(np.int64(at[-1 - chunk]) << 32 | np.searchsorted(words, np.cumsum(dishes, dtype=np.uint64)))
            for x, held in zip(course, (c1, t1), strict=True):
                held.append(np.cumsum(x.reshape(-1, len(dishes)), axis=0, dtype=np.int32))
        keys, first = np.unique(np.concatenate(keys), return_index=True)
        found = {k: np.zeros((*x.shape[:-1], len(middles))) for k, x in shared.items()}
        for k, x in shared.items():
            found[k][..., at[here]] = x[..., here]
        return Parents(keys, *(np.concatenate(x, axis=1)[:, first] for x in (c1, t1)), found["c"], found["t"], found["d1"], found["d2"])

    def score(frame: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk").reset_index(drop=True)
        rooms, frame = frame[frame["chunk"] < 0], frame[frame["chunk"] >= 0]
        loaded = [_open(t) for t in frame["tokens"]]
        if not loaded:
            return pd.DataFrame({"chunk": [], "sums": [], "ids": []})
        for x in loaded:
            x[0] = np.cumsum(x[0], dtype=np.uint64)
        words, middles = np.unique(np.concatenate([shorts(x) for x in loaded])), np.unique(np.concatenate([x[0] for x in loaded]))
        w = np.concatenate([np.searchsorted(words, shorts(x)).astype(np.int32)[x[3]] for x in loaded])
        v = np.concatenate([np.repeat(np.searchsorted(middles, x[0]).astype(np.int32), x[1]) for x in loaded])
        u = np.concatenate([np.cumsum(x[4], dtype=np.uint16) for x in loaded]).astype(np.int32)
        learn = np.concatenate([x[6] * np.unpackbits(x[7])[x[5]] for x in loaded])
        parents = parents_of(rooms, middles, words)
        seen, total = np.zeros(len(words), np.int64), learned + distinct + 1
        np.add.at(seen, np.searchsorted(words, counts["w"].to_numpy(np.int64).view(np.uint64)), counts["seen"].to_numpy(np.int64))
        shares = of_hot(middles, hot_parts, np.ones(len(middles), np.int64))
        # sums of whole numbers come out alike in any order
        values = np.rint(log_probabilities(u, v, w, learn, middles, words, (seen + 1) / total, shares, parents) * (1 << 20)).astype(np.int64)
        del u, w
        before = of_hot(middles, hot_seen, np.bincount(v, learn, len(middles)).astype(np.int64))
        token = middles != START
        logs, known = np.where(token, np.log10((before + 1) / total), 0), token & (before > 0)
        rows, start = [], 0
        for chunk, ids, x in zip(frame["chunk"], frame["ids"], loaded, strict=True):
            d, times, s = x[5], x[6], slice(start, start + len(x[5]))
            start += len(d)
            who, at = np.unique(d, return_inverse=True)
            sums = [np.bincount(at, times * y, len(who)) for y in (values[s], logs[v[s]], known[v[s]])]
            rows.append((int(chunk), _press(who, sums[0].astype(np.int64), sums[1], sums[2].astype(np.uint32)), ids))
        tidy()
        return pd.DataFrame(rows, columns=["chunk", "sums", "ids"])

    partial = sent.cogroup(told).applyInPandas(score, "chunk bigint, sums binary, ids binary")

    def add_up(frame: pd.DataFrame) -> pd.DataFrame:
        ids, many = pickle.loads(next(x for x in frame["ids"] if x is not None))
        out = np.zeros((3, len(ids)))
        for blob in frame["sums"]:
            who, *sums = _open(blob)
            for row, x in zip(out, sums, strict=True):
                row[who] += x
        out[1] += np.log10((ends + 1) / (learned + distinct + 1))
        out[2] += ends > 0
        return pd.DataFrame({"id": pd.Series([None if i is None else str(i) for i in ids], dtype=object), "n_tokens": many, "n_known": out[2].astype(np.int64), "train_tokens": learned, "base_score": out[1], "score": out[0] / (1 << 20)})

    scored = partial.groupBy("chunk").applyInPandas(add_up, "id string, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return scored.select(F.col("id").cast(id_type).alias(id_col), "n_tokens", "n_known", "train_tokens", "base_score", "score")
