"""Byte-level BPE encoding by speculate and verify, and decoding.

Speculate: every new word is cut by greedy longest match over the vocabulary, all words in
step. Verify: merging is local, so a cut is the exact one if each token is what merging makes
of its own bytes and no two neighbours would have merged across their border. The second test
undoes both neighbours' merges from the latest back and looks at each moment whether the
pieces at the border form an earlier merge; numpy does that for all adjacent pairs at once.
Only words with a failing pair go through exact merging: short ones side by side in numpy,
longer ones with a heap.

Texts stay bytes: a stretch of some STRETCH bytes of an Arrow column is cut into words by
comparing the classes of neighbouring characters, and each word is looked up among the words
that the worker remembers by its bytes themselves (up to NEAR bytes; longer words are not
remembered). What is remembered is bounded: two generations of REMEMBERED words.

Defined cases: a null text encodes to no tokens and decodes to the empty text; special
tokens in a text become their ids, as the vocabulary file says; null or empty ids decode
to the empty text; ids that the vocabulary lacks raise ValueError; very long texts are cut
into words piecemeal; words over LOCKSTEP bytes are merged exactly without speculation, for
which one such word must fit in memory (some 60 bytes for each of its bytes); other columns
are carried along, but one that has the output's name is replaced. Files that ask for more
than byte-level BPE (normalisers, other splitting, added tokens that aren't special) are refused.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import replacing, small_batches, with_field

#: The endings that byte-level vocabularies split off, and the classes of characters whose runs are words.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
CLASSES = (r"\p{L}+", r"\p{N}+", r"\p{White_Space}+")
LETTER, NUMBER, SPACE, OTHER, BORDER = 0, 1, 2, 3, 4
#: A byte that no UTF-8 has: it stands between texts.
APART = 0xFF
#: Orders of tokens are below it.
NEVER = 1 << 22
#: Words that a worker remembers in each of two generations, and bytes of the longest of them.
REMEMBERED, NEAR = 200_000, 32
#: Bytes of the longest words that are merged side by side, and that are cut in step.
SIDE_BY_SIDE, LOCKSTEP = 256, 1024
#: Bytes that are cut into words at a time, and cells of a block of words merged side by side.
STRETCH, CELLS = 1 << 19, 1 << 18
#: Bytes that words may be looked at beyond the end of the buffer they are in.
PAD = bytes(SIDE_BY_SIDE + 8)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SMALL = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: printable Latin-1 as itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def classes() -> tuple[np.ndarray, bytes]:
    """The class of each code point, and of each byte that is a character or APART."""
    out = np.full(0x110000, OTHER, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(low, high)))
        for k, pattern in enumerate(CLASSES):
            for m in regex.finditer(pattern, every):
                out[low + m.start() : low + m.end()] = k
    of_byte = out[:256].copy()
    of_byte[0x80:] = OTHER
    of_byte[APART] = BORDER
    return out, of_byte.tobytes()


def classified(buf: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to; buf ends with PAD."""
    of_point, of_byte = classes()
    out = np.frombuffer(bytearray(buf.tobytes().translate(of_byte)), np.uint8)
    lead = np.flatnonzero((buf >= 0xC0) & (buf != APART))
    if len(lead):
        first = buf[lead]
        point = (first & 0x1F).astype(np.int32) << 6 | buf[lead + 1] & 0x3F
        more = np.flatnonzero(first >= 0xE0)
        if len(more):
            at, four = lead[more], first[more] >= 0xF0
            point[more] = (point[more] & 0x3FF) << 6 | buf[at + 2] & 0x3F
            point[more[four]] = ((first[more[four]] & 7).astype(np.int32) << 18) | (point[more[four]] & 0xFFF) << 6 | buf[at[four] + 3] & 0x3F
        kind = of_point[np.minimum(point, 0x10FFFF)]
        out[lead] = kind
        out[lead + 1] = kind
        if len(more):
            out[lead[more] + 2] = kind[more]
            out[lead[more[four]] + 3] = kind[more[four]]
    return out


def word_starts(buf: np.ndarray, size: int) -> np.ndarray:
    """Where the words of buf[:size] begin, APART a word of its own; what follows size is not seen.

    A word is an ending after an apostrophe, or a run of one class with the space before it; of white
    space before another character the last one is apart, or that character's if it is a space.
    """
    kind = classified(buf)
    kind[size:] = BORDER
    begins = np.empty(size, bool)
    begins[:1] = True
    begins[1:] = (kind[1:size] != kind[: size - 1]) | (kind[1:size] == BORDER)
    after = np.flatnonzero(begins[1:] & (kind[: size - 1] == SPACE) & (kind[1:size] != BORDER)) + 1
    last = after - 1
    while len(wide := np.flatnonzero((buf[last] & 0xC0) == 0x80)):
        last[wide] -= 1
    begins[last] = True
    begins[after[buf[last] == 0x20]] = False
    mark = np.flatnonzero(buf[:size] == 0x27)
    mark = mark[begins[mark]]
    mark = mark[kind[mark + 1] == LETTER]
    if len(mark):
        one, two = buf[mark + 1], buf[mark + 2]
        length = np.zeros(len(mark), np.int64)
        for e in ENDINGS:
            fits = one == ord(e[0])
            if len(e) == 2:
                fits &= (two == ord(e[1])) & (mark + 2 < size)
            length[fits] = len(e)
        mark, length = mark[length > 0], length[length > 0]
        begins[mark + 1] = False
        end = mark + 1 + length
        begins[end[end < size]] = True
    return np.flatnonzero(begins)


class Lookup:
    """Numbers of non-negative 64-bit keys, found many at a time by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        bits = max(4, int(len(keys) * 3 + 1).bit_length())
        self.shift, self.last, self.missing = np.uint64(64 - bits), (1 << bits) - 1, missing
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, missing, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]
            done = self.keys[slot] == keys[left]
            self.values[slot[done]] = values[left[done]]
            left, slot = left[~done], (slot[~done] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * _ODD >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found, out = self.keys[slot], self.values[slot]
        wrong = np.flatnonzero((found != keys) & (found >= 0))
        slot = slot[wrong]
        while len(wrong):
            slot = (slot + 1) & self.last
            found, out[wrong] = self.keys[slot], self.values[slot]
            on = (found != keys[wrong]) & (found >= 0)
            wrong, slot = wrong[on], slot[on]
        return out


class Memory:
    """Words of up to NEAR bytes with their ids. A word is known by its bytes, which are kept and compared."""

    def __init__(self) -> None:
        self.size, self.used = 0, 0
        self.bits = 12
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.parts = np.zeros((NEAR // 8, 1 << 11), np.uint64)
        self.hash = np.zeros(1 << 11, np.uint64)
        self.length, self.at, self.count = np.zeros(1 << 11, np.uint8), np.zeros(1 << 11, np.int64), np.zeros(1 << 11, np.int32)
        self.ids = np.zeros(1 << 13, np.int32)

    def _room(self, words: int, ids: int) -> None:
        while self.used + ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        if self.size + words > len(self.hash):
            while self.size + words > 1 << (self.bits - 1):
                self.bits += 1
            more = (1 << (self.bits - 1)) - len(self.hash)
            self.parts = np.concatenate([self.parts, np.zeros((len(self.parts), more), np.uint64)], 1)
            for name in ("hash", "length", "at", "count"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros(more, old.dtype)]))
            self.slots = np.full(1 << self.bits, -1, np.int32)
            self._place(np.arange(self.size))

    def _place(self, entries: np.ndarray) -> None:
        last = (1 << self.bits) - 1
        slot = (self.hash[entries] >> np.uint64(64 - self.bits)).view(np.int64)
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]
            left = self.slots[slot] != entries
            entries, slot = entries[left], (slot[left] + 1) & last

    def find(self, words: Words) -> np.ndarray:
        """The entry of each word, -1 where there is none."""
        last = (1 << self.bits) - 1
        out = np.full(len(words.hash), -1, np.int32)
        at, slot = np.arange(len(out)), (words.hash >> np.uint64(64 - self.bits)).view(np.int64)
        while len(at):
            entry = self.slots[slot]
            some = entry >= 0
            at, entry, slot = at[some], entry[some], slot[some]
            same = (self.hash[entry] == words.hash[at]) & words.equal(at, self.parts, self.length, entry)
            out[at[same]] = entry[same]
            at, slot = at[~same], (slot[~same] + 1) & last
        return out

    def store(self, ids: np.ndarray) -> int:
        """Keep ids without a word; where they begin."""
        self._room(0, len(ids))
        begin, self.used = self.used, self.used + len(ids)
        self.ids[begin : self.used] = ids
        return begin

    def add(self, words: Words, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Enter different words that are not there yet, with their ids one after the other; their entries."""
        self._room(len(counts), len(ids))
        begin = self.store(ids)
        entries = np.arange(self.size, self.size + len(counts))
        self.size += len(counts)
        self.parts[:, entries], self.hash[entries], self.length[entries] = words.parts, words.hash, words.length
        self.at[entries], self.count[entries] = begin + np.cumsum(counts) - counts, counts
        self._place(entries)
        return entries


class Words:
    """Words of up to NEAR bytes as numbers of eight bytes each."""

    def __init__(self, parts: np.ndarray, length: np.ndarray, hashes: np.ndarray):
        self.parts, self.length, self.hash = parts, length, hashes

    @classmethod
    def of(cls, eights: np.ndarray, starts: np.ndarray, length: np.ndarray) -> Words:
        parts = np.zeros((NEAR // 8, len(starts)), np.uint64)
        parts[0] = eights[starts] & _SMALL[np.minimum(length, 8)]
        with np.errstate(over="ignore"):
            hashes = (parts[0] ^ length.astype(np.uint64) << np.uint64(56)) * _ODD
            for k in range(1, len(parts)):
                longer = np.flatnonzero(length > 8 * k)
                if not len(longer):
                    break
                parts[k, longer] = eights[starts[longer] + 8 * k] & _SMALL[np.minimum(length[longer] - 8 * k, 8)]
                h = hashes[longer]
                hashes[longer] = ((h ^ h >> np.uint64(29)) + parts[k, longer]) * _ODD
            hashes ^= hashes >> np.uint64(32)
            hashes *= _ODD
        return cls(parts, length, hashes)

    def __getitem__(self, at: np.ndarray) -> Words:
        return Words(self.parts[:, at], self.length[at], self.hash[at])

    def equal(self, at: np.ndarray, parts: np.ndarray, length: np.ndarray, entry: np.ndarray) -> np.ndarray:
        same = (self.parts[0, at] == parts[0, entry]) & (self.length[at] == length[entry])
        longer = np.flatnonzero(same & (self.length[at] > 8))
        for k in range(1, len(parts)):
            if not len(longer):
                break
            same[longer] &= self.parts[k, at[longer]] == parts[k, entry[longer]]
            longer = longer[self.length[at[longer]] > 8 * k + 8]
        return same

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(one of each word, the number of each word's one)."""
        _, first, inverse = np.unique(self.hash, return_index=True, return_inverse=True)
        if not self.equal(np.arange(len(inverse)), self.parts[:, first], self.length[first], inverse).all():
            _, first, inverse = np.unique(np.concatenate([self.parts, self.length[None].astype(np.uint64)]), axis=1, return_index=True, return_inverse=True)
            inverse = inverse.reshape(-1)
        return first, inverse


def ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each row, so many as count, one row after the other."""
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


class Coder:
    """A vocabulary; `order` numbers tokens by when merging can make them: single bytes first, then by merge rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        supported(spec)
        letters = byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"] if t not in _specials(spec)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ids = spec["model"]["vocab"]
        made = {a + b for a, b in merges}
        base = [t for t in raw if t not in made]
        names = [*base, *[a + b for a, b in merges]]
        order = {t: i for i, t in enumerate(names)}
        self.n_base = len(base)
        self.id_of = np.array([ids[t] for t in names], np.int32)
        self.left = np.array([*range(len(base)), *[order[a] for a, _ in merges]], np.int64)
        self.right = np.array([*range(len(base)), *[order[b] for _, b in merges]], np.int64)
        keys = (self.left << 22 | self.right)[len(base) :]
        self.pairs = Lookup(keys, np.arange(len(base), len(names)), NEVER)
        self.merge = dict(zip(keys.tolist(), range(len(base), len(names)), strict=True))
        self.bytes_at = [raw[t] for t in names]
        self.of_bytes = {b: i for i, b in enumerate(self.bytes_at)}
        self.of_byte = np.array([self.of_bytes[bytes([b])] for b in range(256)], np.int32)
        self._grow_trie()
        self.special = {t.encode(): i for t, i in _specials(spec).items()}
        self.cut = regex.compile(b"(" + b"|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self.memory, self.before = Memory(), Memory()
        self.failed = self.proposed = 0
        self.sound = np.zeros(len(names), bool)
        buf, starts, length = self._buffer(self.bytes_at)
        for i in np.array_split(np.arange(len(names)), max(1, len(names) >> 12)):
            count, tokens = self.exactly(buf, starts[i], length[i])
            self.sound[i] = (count == 1) & (tokens[np.cumsum(count) - 1] == i)

    def _grow_trie(self) -> None:
        """Beginnings of tokens as numbered nodes, 0 the empty one, where bytes lead from them, and each node's token."""
        begun = sorted({b[:k] for b in self.of_bytes for k in range(len(b) + 1)})
        number = {b: i for i, b in enumerate(begun)}
        steps = np.array([number[b[:-1]] << 8 | b[-1] for b in begun[1:]], np.int64)
        self.child = Lookup(steps, np.arange(1, len(begun)), 0)
        self.token_at = np.array([self.of_bytes.get(b, -1) for b in begun], np.int32)

    @staticmethod
    def _buffer(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        length = np.fromiter(map(len, words), np.int64, len(words))
        return np.frombuffer(b"".join(words) + PAD, np.uint8), np.cumsum(length) - length, length

    def speculate(self, buf: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of words, orders) by greedy longest match, all words in step along the trie."""
        word, at, end = np.arange(len(starts)), starts, starts + length
        node, token, stop = np.zeros(len(word), np.int32), np.full(len(word), -1, np.int32), at.copy()
        out_word, out_token = [word[:0]], [token[:0]]
        while len(word):
            node = np.where(at < end, self.child.get(node.astype(np.int64) << 8 | buf[at]), 0)
            goes = node > 0
            at = at + goes
            here = self.token_at[node]
            better = goes & (here >= 0)
            token, stop = np.where(better, here, token), np.where(better, at, stop)
            stuck = np.flatnonzero(~goes)
            if len(stuck):
                out_word.append(word[stuck])
                out_token.append(token[stuck])
                at[stuck] = stop[stuck]
                over = np.zeros(len(word), bool)
                over[stuck] = at[stuck] >= end[stuck]
                if over.any():
                    live = np.flatnonzero(~over)
                    word, at, end, node, token, stop = word[live], at[live], end[live], node[live], token[live], stop[live]
        word, token = np.concatenate(out_word), np.concatenate(out_token)
        order = np.argsort(word, kind="stable")
        return word[order], token[order]

    def formed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The order of the token that each pair merges to, NEVER if it doesn't."""
        return self.pairs.get(a.astype(np.int64) << 22 | b)

    def borders_hold(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For all pairs of neighbours: merging leaves the border between them alone.

        Going back in time the later made of the two pieces at the border falls apart.
        Before it was made, an earlier merge across the border would have come first; of
        equal merges the left one goes first.
        """
        holds = np.ones(len(a), bool)
        at, until = np.arange(len(a)), np.full(len(a), NEVER, np.int64)
        while len(at):
            clash = self.formed(a, b) < until
            holds[at[clash]] = False
            go = ~clash & (np.maximum(a, b) >= self.n_base)
            at, a, b = at[go], a[go], b[go]
            left_later = a > b
            until = np.where(left_later, a, b + 1)
            a, b = np.where(left_later, self.right[a], a), np.where(left_later, b, self.left[b])
        return holds

    def exactly(self, buf: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, orders of all words one after the other) by exact merging."""
        counts, found, owners = np.zeros(len(starts), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        width, below = 8, 0
        while width <= SIDE_BY_SIDE:
            some = np.flatnonzero((length > below) & (length <= width))
            for i in range(0, len(some), CELLS // width):
                block = some[i : i + CELLS // width]
                counts[block], tokens = self._side_by_side(buf, starts[block], length[block], width)
                found.append(tokens)
                owners.append(np.repeat(block, counts[block]))
            width, below = width * 2, width
        for i in np.flatnonzero(length > SIDE_BY_SIDE).tolist():
            tokens = self.exact(buf[starts[i] : starts[i] + length[i]].tobytes())
            counts[i] = len(tokens)
            found.append(np.array(tokens, np.int64))
            owners.append(np.full(len(tokens), i))
        order = np.argsort(np.concatenate(owners), kind="stable")
        return counts, np.concatenate(found)[order]

    def _side_by_side(self, buf: np.ndarray, starts: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Words as columns. Each round makes the earliest merge, the leftmost of equal ones, in every word that has one."""
        row = np.arange(width)[:, None]
        part = np.where(row < length, self.of_byte[buf[np.minimum(starts + row, len(buf) - 1)]], -1).astype(np.int32)
        after, before = (np.repeat((row + k).astype(np.int16), len(starts), 1) for k in (1, -1))
        made = np.full((width, len(starts)), NEVER * width, np.int32)
        high, low = np.nonzero(row + 1 < length)
        made[high, low] = self.formed(part[high, low], part[high + 1, low]).astype(np.int32) * width + high
        column = np.arange(len(starts))
        while True:
            least = made[:, column].min(0) if len(column) < len(starts) else made.min(0)
            live = least < NEVER * width
            column, least = column[live], least[live]
            if not len(column):
                return (part >= 0).sum(0), part.T[part.T >= 0].astype(np.int64)
            at, token = least & (width - 1), least // width
            gone = after[at, column]
            then = after[gone, column].astype(np.int64)
            part[at, column], part[gone, column] = token, -1
            made[gone, column] = made[at, column] = NEVER * width
            after[at, column] = then
            some = np.flatnonzero(then < length[column])
            c, a, b = column[some], at[some], then[some]
            before[b, c] = a
            made[a, c] = self.formed(token[some], part[b, c]).astype(np.int32) * width + a
            left = before[at, column].astype(np.int64)
            some = np.flatnonzero(left >= 0)
            c, a = column[some], left[some]
            made[a, c] = self.formed(part[a, c], token[some]).astype(np.int32) * width + a

    def exact(self, word: bytes) -> list[int]:
        """Merging with a heap over a linked list: n log n in the word's length."""
        n = len(word)
        part = self.of_byte[np.frombuffer(word, np.uint8)].astype(np.int64)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        made = self.formed(part[:-1], part[1:])
        at = np.flatnonzero(made < NEVER)
        heap = (made[at].astype(np.int64) << 40 | at).tolist()
        heapq.heapify(heap)
        part, after, before = memoryview(part), memoryview(after), memoryview(before)
        left, right, merge = self.left, self.right, self.merge
        while heap:
            m, i = divmod(heapq.heappop(heap), 1 << 40)
            j = after[i]
            if j >= n or part[i] != left[m] or part[j] != right[m]:
                continue
            part[i], part[j] = m, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if 0 <= x and y < n and (m := merge.get(part[x] << 22 | part[y])) is not None:
                    heapq.heappush(heap, m << 40 | x)
        return [p for p in part if p >= 0]

    def learn(self, buf: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids of all words one after the other): speculated, verified together, merged exactly where that fails."""
        fails = length > LOCKSTEP
        step = np.flatnonzero(~fails)
        owner, token = self.speculate(buf, starts[step], length[step])
        owner = step[owner]
        fails[owner[~self.sound[token]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        fails[owner[inner[~self.borders_hold(token[inner], token[inner + 1])]]] = True
        bad = np.flatnonzero(fails)
        self.proposed += len(starts)
        self.failed += len(bad)
        counts, exact = self.exactly(buf, starts[bad], length[bad])
        good = ~fails[owner]
        owner, token = np.concatenate([owner[good], np.repeat(bad, counts)]), np.concatenate([token[good], exact])
        return np.bincount(owner, minlength=len(starts)), self.id_of[token[np.argsort(owner, kind="stable")]]

    def learn_all(self, words: Iterable[bytes]) -> list[list[int]]:
        """The ids of each word, without looking at what is remembered."""
        counts, ids = self.learn(*self._buffer(list(words)))
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]

    def _known(self, buf: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each word's ids begin in the memory, how many). What is not remembered yet is learnt."""
        begin, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        near = np.flatnonzero(length <= NEAR)
        eights = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
        words = Words.of(eights, starts[near], length[near])
        entry = self.memory.find(words)
        new = np.flatnonzero(entry < 0)
        if len(new):
            first, inverse = words[new].distinct()
            one = words[new[first]]
            old = self.before.find(one)
            known = np.flatnonzero(old >= 0)
            at = np.zeros(len(first), np.int64)
            if len(known):
                n = self.before.count[old[known]]
                at[known] = self.memory.add(one[known], n, self.before.ids[ragged(self.before.at[old[known]], n)])
            fresh = np.flatnonzero(old < 0)
            if len(fresh):
                which = near[new[first[fresh]]]
                at[fresh] = self.memory.add(one[fresh], *self.learn(buf, starts[which], length[which]))
            entry[new] = at[inverse]
        begin[near], count[near] = self.memory.at[entry], self.memory.count[entry]
        far = np.flatnonzero(length > NEAR)
        if len(far):
            number: dict[bytes, int] = {}
            text = buf.tobytes()
            inverse = [number.setdefault(text[i:j], len(number)) for i, j in zip(starts[far].tolist(), (starts[far] + length[far]).tolist(), strict=True)]
            n, ids = self.learn(*self._buffer(list(number)))
            at = self.memory.store(ids) + np.cumsum(n) - n
            begin[far], count[far] = at[inverse], n[inverse]
        return begin, count

    def _forget(self, used: int) -> None:
        """Ids of long words go at once. A full generation becomes the one before, whose own words are forgotten."""
        if self.memory.size > REMEMBERED:
            self.before, self.memory = self.memory, Memory()
        elif used:
            self.memory.used = used

    def encode_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ends, ids of all texts one after the other, int32); a stretch at a time."""
        parts, special, ends_text = texts, None, None
        if self.cut and any(s in t for s in self.special for t in texts):
            parts, special, ends_text = [], [], []
            for t in texts:
                pieces = self.cut.split(t)
                for p, s in zip(pieces[::2], [*pieces[1::2], None], strict=True):
                    parts.append(p)
                    special.append(-1 if s is None else self.special[s])
                    ends_text.append(s is None)
            special, ends_text = np.array(special, np.int32), np.array(ends_text, bool)
        joined = b"".join(x for p in parts for x in (p, b"\xff"))
        at, apart, total = 0, 0, 0
        out, ends = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        room = STRETCH
        while at < len(joined):
            stop = min(at + room, len(joined))
            buf = np.frombuffer(joined[at:stop] + PAD, np.uint8)
            starts = word_starts(buf, stop - at)
            bounds = np.append(starts, stop - at)
            if stop < len(joined):
                # a start with four bytes after it does not depend on what follows
                n = int(np.searchsorted(bounds, stop - at - 4, "right")) - 1
                if n <= 0:
                    room *= 2
                    continue
                bounds = bounds[: n + 1]
            room = STRETCH
            at += int(bounds[-1])
            starts, length = bounds[:-1], np.diff(bounds)
            border = np.flatnonzero(buf[starts] == APART)
            count = np.zeros(len(starts), np.int64)
            begin = np.zeros(len(starts), np.int64)
            word = np.flatnonzero(buf[starts] != APART)
            begin[word], count[word] = self._known(buf, starts[word], length[word])
            used = int((self.memory.at[: self.memory.size] + self.memory.count[: self.memory.size]).max(initial=0))
            these = slice(apart, apart + len(border))
            apart += len(border)
            if special is not None:
                is_special = border[special[these] >= 0]
                begin[is_special] = self.memory.store(special[these][special[these] >= 0]) + np.arange(len(is_special))
                count[is_special] = 1
                border = border[ends_text[these]]
            out.append(self.memory.ids[ragged(begin, count)])
            ends.append(total + np.cumsum(count)[border])
            total += len(out[-1])
            self._forget(used)
        return np.concatenate(ends), np.concatenate(out)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, int32."""
        ends, ids = self.encode_texts([(t or "").encode("utf-8", "replace") for t in texts])
        return np.split(ids, ends[:-1]) if texts else []

    def encode_column(self, column: pa.Array) -> pa.ListArray:
        ends, ids = self.encode_texts(texts_of(column))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 of each text; null is empty, and bytes that are no UTF-8 become U+FFFD."""
    column = column.fill_null("")
    raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
    try:
        column.validate(full=True)
    except pa.ArrowInvalid:
        return [x.decode("utf-8", "replace").encode() for x in raw]
    return raw


def _specials(spec: dict) -> dict[str, int]:
    return {t["content"]: t["id"] for t in spec.get("added_tokens", ())}


def supported(spec: dict) -> None:
    """ValueError if a vocabulary file asks for what this module doesn't do."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [
        name
        for name, bad in {
            "model": model.get("type", "BPE") != "BPE" or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("byte_fallback") or model.get("dropout") or model.get("ignore_merges"),
            "normalizer": spec.get("normalizer"),
            "pre_tokenizer": before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True),
            "added_tokens": any(not t.get("special") or t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", ())),
        }.items()
        if bad
    ]
    if wrong:
        raise ValueError(f"not a plain byte-level BPE file: {', '.join(wrong)}")


class Decoder:
    """The bytes of each id: all that decoding needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        supported(spec)
        letters, special = byte_letters(), _specials(spec)
        of = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special} | {i: t.encode() for t, i in special.items()}
        self.known, self.length = np.zeros(max(of) + 1, bool), np.zeros(max(of) + 1, np.int32)
        self.known[list(of)] = True
        self.length[list(of)] = [*map(len, of.values())]
        self.bytes = np.frombuffer(b"".join(of[i] for i in sorted(of)), np.uint8)
        self.at = (np.cumsum(self.length) - self.length).astype(np.int32)

    def join(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids one after the other."""
        wrong = (ids < 0) | (ids >= len(self.known))
        wrong |= ~self.known[np.where(wrong, 0, ids)]
        if wrong.any():
            raise ValueError(f"no token has the id {ids[wrong][0]}")
        return self.bytes[ragged(self.at[ids], self.length[ids])]

    def decode(self, ids: Iterable[int]) -> str:
        return self.join(np.fromiter(ids, np.int64)).tobytes().decode("utf-8", "replace")

    def decode_lists(self, ends: np.ndarray, ids: np.ndarray) -> pa.StringArray:
        """The text of each of the lists that end there; bytes that are no UTF-8 become U+FFFD."""
        some = [self.join(ids[i : i + (STRETCH >> 2)]) for i in range(0, len(ids), STRETCH >> 2)]
        flat = np.concatenate(some or [np.zeros(0, np.uint8)])
        bounds = np.concatenate([[0], np.cumsum(self.length[ids], dtype=np.int64)])[np.concatenate([[0], ends])]
        out = pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(flat)])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            raw = flat.tobytes()
            return pa.array([raw[i:j].decode("utf-8", "replace") for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string())
        return out

    def decode_column(self, column: pa.ListArray) -> pa.StringArray:
        flat = column.flatten()
        if flat.null_count:
            raise ValueError("no token has the id null")
        length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return self.decode_lists(np.cumsum(length, dtype=np.int64), flat.to_numpy(zero_copy_only=False))


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One for each Python worker."""
    return Coder(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def bpe_encode(docs: DataFrame, vocabulary: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """docs with the token ids of each whole text, array<int>. vocabulary: path of the JSON file on every machine."""
    docs = replacing(docs, (out,), (text_col,))
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, c.encode_column(b.column(at))], names=[*b.schema.names, out])

    return docs.mapInArrow(run, with_field(docs.schema, (out, T.ArrayType(T.IntegerType(), False))))


def bpe_decode(docs: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the text of each row's ids; bytes that are no UTF-8 become U+FFFD."""
    docs = replacing(docs, (out,), (ids_col,))
    small_batches(docs.sparkSession)
    at = docs.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = decoder(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, d.decode_column(b.column(at))], names=[*b.schema.names, out])

    return docs.mapInArrow(run, with_field(docs.schema, (out, T.StringType())))


def bpe_round_trip(docs: DataFrame, vocabulary: str, text_col: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`bpe_encode` and `bpe_decode` in one Python worker a task instead of two: docs with the ids and the text they decode to."""
    docs = replacing(docs, (ids, decoded), (text_col,))
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, d = coder(vocabulary), decoder(vocabulary)
        for b in batches:
            found = c.encode_column(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, found, d.decode_column(found)], names=[*b.schema.names, ids, decoded])

    return docs.mapInArrow(run, with_field(docs.schema, (ids, T.ArrayType(T.IntegerType(), False)), (decoded, T.StringType())))
