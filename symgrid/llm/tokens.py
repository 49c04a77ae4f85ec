"""Token ids of a public vocabulary, with a bounded cache of words.

The tokenizer drops white space and encodes what stands between it alone, so a word's ids may be
kept. All ids come from the library: it encodes every word that the cache doesn't hold. Words are
looked up together, as numpy arrays, by a hash, and the bytes of each one are then compared with
those of the word whose ids were found; a text with a word that only shares the hash of another
goes to the library whole. So does a text with a character outside :data:`SIMPLE`, since what the
library does to it may reach across a space.
"""

from __future__ import annotations

import re
import string
from functools import cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
END = 1
#: Words a table holds before it starts anew (some 80 bytes each).
WORDS = 1_000_000
#: Words that the library encodes in one call.
TOGETHER = 100
#: Text bytes looked up together.
BLOCK = 1 << 20


SIMPLE = "".join(re.escape(c) for c in map(chr, range(0x300)) if len(c.lower()) == 1 and ord(c.lower()) < 0x300)
_OTHER = re.compile(f"[^{SIMPLE}]|<\\|")


class Table:
    """Ids and bytes of words by a 64-bit hash: open addressing in numpy arrays."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.bits = max(4, (2 * most).bit_length())
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.zeros(1 << self.bits, np.int32)
        self.first = np.zeros(self.most, np.int64)
        self.count = np.zeros(self.most, np.int64)
        self.ids = np.zeros(4 * self.most, "<u4")
        self.begin = np.zeros(self.most, np.int64)
        self.size = np.zeros(self.most, np.int64)
        self.letters = np.zeros(8 * self.most, np.uint8)
        self.entries = self.used = self.spelt = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int64)
        rows = np.arange(len(hashes))
        slots = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(rows):
            keys = self.keys[slots]
            hit = keys == hashes[rows]
            out[rows[hit]] = self.at[slots[hit]]
            on = ~hit & (keys != 0)
            rows, slots = rows[on], (slots[on] + 1) & ((1 << self.bits) - 1)
        return out

    def differ(self, entries: np.ndarray, sizes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Which of the words, whose bytes are ``letters`` one after the other, aren't those of ``entries``."""
        wrong = self.size[entries] != sizes
        if wrong.any():
            letters = letters[np.repeat(~wrong, sizes)]
        right = np.flatnonzero(~wrong)
        own = sizes[right]
        ends = np.cumsum(own)
        same = self.letters[np.repeat(self.begin[entries[right]] - ends + own, own) + np.arange(len(letters))] == letters
        if not same.all():
            wrong[right[np.searchsorted(ends, np.flatnonzero(~same), side="right")]] = True
        return np.flatnonzero(wrong)

    def add(self, hashes: np.ndarray, words: list[bytes], ids: list[bytes]) -> None:
        """Enter words of distinct hashes that the table doesn't hold."""
        n, data, letters = len(hashes), np.frombuffer(b"".join(ids), "<u4"), np.frombuffer(b"".join(words), np.uint8)
        if self.spelt + len(letters) > len(self.letters):
            self.letters = np.concatenate([self.letters, np.zeros(max(len(self.letters), len(letters)), np.uint8)])
        new = slice(self.entries, self.entries + n)
        self.letters[self.spelt : self.spelt + len(letters)] = letters
        self.size[new] = np.fromiter(map(len, words), np.int64, n)
        self.begin[new] = self.spelt + np.cumsum(self.size[new]) - self.size[new]
        self.spelt += len(letters)
        if self.used + len(data) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(data)), "<u4")])
        counts = np.fromiter(map(len, ids), np.int64, n) // 4
        entries = np.arange(self.entries, self.entries + n)
        self.ids[self.used : self.used + len(data)] = data
        self.count[entries] = counts
        self.first[entries] = self.used + np.cumsum(counts) - counts
        self.used += len(data)
        self.entries += n
        rows, slots = np.arange(n), (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(rows):
            free = np.flatnonzero(self.keys[slots] == 0)
            taken, one = np.unique(slots[free], return_index=True)
            self.keys[taken], self.at[taken] = hashes[rows[free[one]]], entries[rows[free[one]]]
            on = np.ones(len(rows), bool)
            on[free[one]] = False
            rows, slots = rows[on], (slots[on] + 1) & ((1 << self.bits) - 1)


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
#: Marks that the library may cut from the letter before them; letters of two bytes begin with 0xC3 to 0xC9.
MARKS = ",.;:!?$%#*&()"
_LETTERS = [*string.ascii_letters, *(chr(i) for i in range(0xC0, 0x250) if i not in (0xD7, 0xF7) and not _OTHER.match(chr(i)))]
_MARK, _ASCII, _LEAD = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(MARKS.encode())] = True
_ASCII[list(string.ascii_letters.encode())] = True
_LEAD[0xC3:0xC9] = True
_SMALL = np.zeros(256, np.uint8)
_SMALL[65:91] = 32
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


class Encoder:
    """Little-endian unsigned 32-bit ids of texts."""

    def __init__(self, vocabulary: str = VOCABULARY, words: int = WORDS) -> None:
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.words = Table(words)
        rule, upper = self.tokenizer.normalizer, string.ascii_uppercase
        #: Whether the library writes capitals small; then they are looked up so.
        self.folds = rule is not None and rule.normalize_str(upper) == upper.lower()
        #: Whether the library always cuts these marks from a letter before them; then a word is looked up without them.
        self.cuts = all(self.library(f"x{c}{m}x") == self.library(f"x{c}") + self.library(f"{m}x") for c in _LETTERS for m in MARKS)
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def library(self, text: str) -> bytes:
        """Ids straight from the library."""
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        # Short texts of many words cost the library less than as many calls; offsets tell whose the ids are.
        out: list[bytes] = []
        for at in range(0, len(words), TOGETHER):
            part = [w.decode() for w in words[at : at + TOGETHER]]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.asarray(got.ids, "<u4")
            begins = np.cumsum([0, *(len(w) + 1 for w in part)])
            edges = np.searchsorted(np.array([a for a, _ in got.offsets], np.int64), begins).tolist()
            out += [ids[a:b].tobytes() for a, b in zip(edges, edges[1:])]
        self.words.add(hashes, words, out)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers) < n:
            step = np.full(n, _BASE, np.uint64)
            back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            self.powers, self.inverses = np.multiply.accumulate(step), np.multiply.accumulate(back)
        return self.powers[:n], self.inverses[:n]

    def _block(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts of simple characters."""
        data = b" " + b" ".join(texts) + b" "
        letters = np.frombuffer(data, np.uint8)
        if self.folds:
            letters = letters | _SMALL[letters]
        space = _SPACE[letters]
        change = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = change[::2] + 1, change[1::2] + 1
        if self.cuts:
            marks = np.flatnonzero(_MARK[letters])
            one, two = letters[marks - 1], letters[marks - 2]
            # The sign of multiplication and that of division are no letters.
            marks = marks[_ASCII[one] | (one >= 0x80) & _LEAD[two] & ~((two == 0xC3) & ((one == 0x97) | (one == 0xB7)))]
            starts, ends = np.sort(np.concatenate([starts, marks])), np.sort(np.concatenate([ends, marks]))
        powers, inverses = self._powers(len(letters))
        sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(_BYTE[letters] * powers, out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * inverses[starts]
        hashes ^= hashes >> np.uint64(32)
        hashes = (hashes + (ends - starts).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)
        entries = self.words.find(hashes)
        lost = np.flatnonzero(entries < 0)
        if len(lost):
            new, one = np.unique(hashes[lost], return_index=True)
            if self.words.entries + len(new) > self.words.most:
                self.words.clear()
                new, one = np.unique(hashes, return_index=True)
                lost = np.arange(len(hashes))
                if len(new) > self.words.most:
                    return [self.library(t.decode()) for t in texts]
            spelt = letters.tobytes()
            self._learn([spelt[starts[i] : ends[i]] for i in lost[one].tolist()], new)
            entries[lost] = self.words.find(hashes[lost])
        sizes = ends - starts
        wrong = self.words.differ(entries, sizes, letters[~space])
        counts = self.words.count[entries]
        after = np.cumsum(counts)
        ids = self.words.ids[np.repeat(self.words.first[entries] - after + counts, counts) + np.arange(int(after[-1]) if len(after) else 0)].tobytes()
        bounds = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)]))
        edges = (4 * np.concatenate([[0], after])[bounds]).tolist()
        out = [ids[a:b] for a, b in zip(edges, edges[1:])]
        for k in np.unique(np.searchsorted(bounds, wrong, side="right") - 1).tolist():
            out[k] = self.library(texts[k].decode())
        return out

    def __call__(self, texts: list[str | None], end: int | None = END) -> list[bytes]:
        """Ids of each text (null: empty), with the end id appended."""
        tail = b"" if end is None else np.asarray([end], "<u4").tobytes()
        out = [tail] * len(texts)
        rows: list[int] = []
        block: list[bytes] = []
        held = 0
        for row, text in enumerate([*texts, None]):
            if row == len(texts) or held > BLOCK:
                if rows:
                    for k, ids in zip(rows, self._block(block)):
                        out[k] = ids + tail
                rows, block, held = [], [], 0
            if text and ("<|" in text if text.isascii() else _OTHER.search(text)):
                out[row] = self.library(text) + tail
            elif text:
                rows.append(row)
                block.append(text.encode())
                held += len(block[-1])
        return out


@cache
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """This worker's encoder."""
    return Encoder(vocabulary)
