"""Text to token ids with a public tokenizer of the `tokenizers` library, for use inside Spark tasks."""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import regex

from gradeline.llm.common import Words, slices

#: Words kept with their ids in a worker; the memory is bounded, the results don't depend on it.
MEMO_WORDS = 1_000_000
#: Parts of new words kept likewise; they only spare work on words that share them.
MEMO_PARTS = 100_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memo:
    """Ids of words by the words' 64-bit hashes: an open table in arrays, read for many words at once."""

    def __init__(self, dtype: np.dtype, slots: int = 1 << 12):
        self.pool, self.used = np.empty(slots, dtype), 0
        self.hashes, self.start, self.size, self.n = np.empty(slots, np.uint64), np.empty(slots, np.int64), np.empty(slots, np.int32), 0
        self._resize(slots)

    def _resize(self, slots: int) -> None:
        self.mask, self.entry = slots - 1, np.full(slots, -1, np.int32)
        self._place(np.arange(self.n))

    def _place(self, new: np.ndarray) -> None:
        at = (self.hashes[new] >> np.uint64(20)).astype(np.int64) & self.mask
        while len(new):
            free = self.entry[at] < 0
            self.entry[at[free]] = new[free]
            left = self.entry[at] != new
            new, at = new[left], (at[left] + 1) & self.mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """For each hash its entry, or -1."""
        at = (hashes >> np.uint64(20)).astype(np.int64) & self.mask
        out = self.entry[at]
        todo = np.flatnonzero((out >= 0) & (self.hashes[out] != hashes))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            e = self.entry[at[todo]]
            out[todo] = e
            todo = todo[(e >= 0) & (self.hashes[e] != hashes[todo])]
        return out

    def add(self, hashes: np.ndarray, ids: list[int], sizes: list[int]) -> None:
        """New hashes, none of which is held, with the ids of all one after another and how many each has."""
        sizes = np.array(sizes, np.int32)
        need, n = self.used + int(sizes.sum()), self.n + len(hashes)
        if need > len(self.pool):
            self.pool = np.resize(self.pool, 2 * need)
        if n > len(self.hashes):
            self.hashes, self.start, self.size = np.resize(self.hashes, 2 * n), np.resize(self.start, 2 * n), np.resize(self.size, 2 * n)
        self.pool[self.used : need] = ids
        self.hashes[self.n : n], self.size[self.n : n] = hashes, sizes
        self.start[self.n : n] = self.used + np.cumsum(sizes) - sizes
        new, self.used, self.n = np.arange(self.n, n), need, n
        if 2 * n > len(self.entry):
            self._resize(4 * (1 << int(n).bit_length()))
        else:
            self._place(new)

    def forget(self, keep: int) -> None:
        """Only the first `keep` words stay."""
        self.n = min(self.n, keep)
        self.used = int(self.start[self.n - 1] + self.size[self.n - 1]) if self.n else 0
        self._resize(len(self.entry))


def byte_signs() -> dict[int, str]:
    """Byte-level: printable bytes stand for themselves, the others for the signs from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Encodes whole texts of a tokenizer whose tokens never span white space, one distinct word at a time.

    Each distinct word goes through the library once and its ids are kept by the word's 64-bit hash; so of 10^13 words
    about one may read as another. If the tokenizer is one that cuts lower-cased words at letters, digits and other signs
    before its byte-pair merges, the library's model gets these parts of plain Latin words directly; all other words go
    through the whole tokenizer, one by one.
    """

    #: Fixed value: the pattern by which such a tokenizer cuts words.
    PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Words of these characters are lower-cased alike everywhere and hold no white space of other alphabets.
    PLAIN = regex.compile("[\x21-\x7e\xa1-įĲ-ɏ]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = [t["content"] for t in told["added_tokens"]]
        steps = [told["normalizer"], told["pre_tokenizer"]]
        flat = [x["type"] for s in steps for x in (s or {}).get("normalizers", (s or {}).get("pretokenizers", [s or {"type": ""}]))]
        self.in_parts = flat == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] and told["model"]["type"] == "BPE" and steps[1]["pretokenizers"][0]["pattern"].get("Regex") == self.PARTS
        self.part = regex.compile(self.PARTS)
        self.signs = byte_signs()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        apart = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("a", "b", "a b", " a\tb\n", "a  b")]
        if any(x != apart[0] + apart[1] for x in apart[2:]):
            raise ValueError(f"{path}: tokens depend on white space")
        self.memo, self.parts = Memo(self.dtype), {}

    def _learn(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """(ids of all words one after another, how many each has)."""
        flat: list[int] = []
        sizes = []
        text = b"\n".join(words).decode("utf-8", "replace")
        marked = any(x in text for x in self.special)
        if len(self.parts) > MEMO_PARTS:
            self.parts.clear()
        tokenize, held = self.tokenizer.model.tokenize, self.parts
        for s in text.split("\n"):
            before = len(flat)
            plain = self.in_parts and (s.isprintable() if s.isascii() else self.PLAIN.fullmatch(s) and unicodedata.is_normalized("NFC", s))
            if plain and not (marked and any(x in s for x in self.special)):
                low = s.lower()
                for p in (low,) if low.isalpha() else self.part.findall(low):
                    got = held.get(p)
                    if got is None:
                        seen = p if p.isascii() else "".join(map(self.signs.__getitem__, p.encode()))
                        got = held[p] = [t.id for t in tokenize(seen)]
                    flat += got
            else:
                flat += self.tokenizer.encode(s, add_special_tokens=False).ids
            sizes.append(len(flat) - before)
        return flat, sizes

    def _part_of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = Words(column)
        hashes = words.hashes()
        found = self.memo.find(hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, first = np.unique(hashes[new], return_index=True)
            if self.memo.n + len(distinct) > MEMO_WORDS:
                # what came first came often; later words make room
                self.memo.forget(MEMO_WORDS * 3 // 4)
                new = np.flatnonzero(self.memo.find(hashes) < 0)
                distinct, first = np.unique(hashes[new], return_index=True)
            raw, first = words.data.tobytes(), new[first]
            self.memo.add(distinct, *self._learn([raw[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)]))
            found = self.memo.find(hashes)
        size = self.memo.size[found].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.memo.start[found] - ends + size, size) + np.arange(total)
        return self.memo.pool[at], np.concatenate([[0], ends])[words.first]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's begin, and the end). A null text has none."""
        ids, ends = [np.empty(0, self.dtype)], [np.zeros(1, np.int64)]
        for part in slices(column):
            got, at = self._part_of(part)
            ids.append(got)
            ends.append(at[1:] + ends[-1][-1])
        return np.concatenate(ids), np.concatenate(ends)

    def encode_ended(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As `encode`, with `end_id` after each text."""
        ids, at = self.encode(column)
        out = np.full(len(ids) + len(column), end_id, self.dtype)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(column)), np.diff(at))] = ids
        return out, at + np.arange(len(at))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
