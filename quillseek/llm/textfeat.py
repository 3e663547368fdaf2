"""Sparse text features as 64-bit hashes, for whole Arrow batches at a time.

The bytes of many texts form one array; a running sum of byte times power of an odd number
(modulo 2**64) gives the hash of any span by one subtraction and one product, so words,
their beginnings and the marks between them are hashed without a loop over words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that are hashed at a time; longer texts are cut at the next white space, or after SLACK more bytes without any.
SLICE, SLACK = 1 << 20, 1 << 16
#: Lengths in bytes of the word beginnings that are features of their own.
BEGINNINGS = (4, 5, 6, 7)
#: Bytes of a mark that are hashed.
MARK = 16

_powers: dict[str, np.ndarray] = {}
_word = np.zeros(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _word[_low:_high] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n + 1:
        size = max(n + 1, SLICE + 1)
        with np.errstate(over="ignore"):
            for name, factor in (("up", BASE), ("down", INVERSE)):
                x = np.full(size, factor, np.uint64)
                x[0] = 1
                _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


_gap = {bytes: re.compile(rb"[\x20\x09-\x0d]"), str: re.compile(r"[\x20\x09-\x0d]")}


def _cut(t: bytes | str, at: int) -> int:
    """Where the slice that begins at `at` ends: at white space, else between two characters."""
    if len(t) - at <= SLICE + SLACK:
        return len(t)
    if gap := _gap[type(t)].search(t, at + SLICE, at + SLICE + SLACK):
        return gap.start()
    end = at + SLICE + SLACK
    while isinstance(t, bytes) and t[end] & 0xC0 == 0x80 and end > at + SLICE:
        end -= 1
    return end


def slices(texts: list[bytes] | list[str]) -> Iterator[tuple[list[int], list]]:
    """Groups of (number of the text, part of it) of about SLICE bytes or characters, SLICE + SLACK longer at most."""
    owners, parts, size = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = _cut(t, at)
            owners.append(i)
            parts.append(t[at:end])
            size += end - at
            at = end
            if size >= SLICE:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


def _mix(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind * 0x51ED270B7A2D)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hashed(owners: list[int], parts: list[bytes], beginnings: bool, marks: bool) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """(numbers of texts, hashes) of the words and of the marks of the parts, repeats included.

    Words are runs of letters, digits and bytes from 0x80 on; with `beginnings` also how
    longer words start. Marks, if asked for, are what stands between two words, other than
    one character, and that a word repeats the one before. Of a mark longer than MARK bytes
    count its first MARK bytes and the power of two of its length.
    """
    with np.errstate(over="ignore"):
        buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        up, down = powers(len(buf) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], dtype=np.uint64)])
        bounds = np.cumsum([len(p) + 1 for p in parts])
        owner_of = np.array(owners, np.int64)
        inside = _word[buf]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        doc = owner_of[np.searchsorted(bounds, starts, "right")]

        def span(s: np.ndarray, e: np.ndarray, kind: int) -> np.ndarray:
            return _mix((sums[e] - sums[s]) * down[s], kind)

        whole = span(starts, ends, 1)
        words, between = [(doc, whole)], []
        if beginnings:
            for n in BEGINNINGS:
                longer = ends - starts > n
                words.append((doc[longer], span(starts[longer], starts[longer] + n, n + 10)))
        if marks and len(starts) > 1:
            inner = doc[1:] == doc[:-1]
            s, e = ends[:-1], starts[1:]
            odd = inner & (e - s > 1)
            s, n = s[odd], (e - s)[odd]
            mark = span(s, s + np.minimum(n, MARK), 2)
            long = n > MARK
            mark[long] = _mix(mark[long] + np.log2(n[long]).astype(np.uint64) * np.uint64(BASE), 4)
            between.append((doc[:-1][odd], mark))
            again = inner & (whole[1:] == whole[:-1])
            between.append((doc[1:][again], np.full(int(again.sum()), 0xA5A5A5A5, np.uint64)))
    return words, between


def normal(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _counted(d: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]) if len(d) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return d[first], h[first], np.diff(np.concatenate([first, [len(d)]]))


def _wanted(d: np.ndarray, h: np.ndarray, wanted: np.ndarray, quick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = quick[(h >> np.uint64(44)).astype(np.int64)]
    d, h = d[near], h[near]
    hit = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h if len(wanted) else np.zeros(len(h), bool)
    return d[hit], h[hit]


def features(texts: list[str | None], beginnings: bool = True, marks: bool = False, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of texts, hashes), each pair once and in order; `wanted`: sorted hashes, others are left out.

    A mark counts with how often it comes: one feature for each power of two of words a mark.
    """
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    found, between, n_words = [none], [none], np.zeros(len(texts), np.int64)
    if wanted is not None:
        quick = np.zeros(1 << 20, bool)
        quick[(wanted >> np.uint64(44)).astype(np.int64)] = True
    for owners, parts in slices([normal(t) for t in texts]):
        words, more = hashed(owners, parts, beginnings, marks)
        n_words += np.bincount(words[0][0], minlength=len(texts))
        found += [_wanted(d, h, wanted, quick) for d, h in words] if wanted is not None else words
        between += more
    if marks:
        d, h, n = _counted(*map(np.concatenate, zip(*between, strict=True)))
        every = np.log2(np.maximum(n_words[d] / np.maximum(n, 1), 1)).astype(np.uint64)
        with np.errstate(over="ignore"):
            h = _mix(h + every * np.uint64(BASE), 3)
        found.append((d, h) if wanted is None else _wanted(d, h, wanted, quick))
    return _counted(*map(np.concatenate, zip(*found, strict=True)))[:2]
