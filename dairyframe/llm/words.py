"""Word and shingle hashes of many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

GOLD = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.default_rng(20)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_LONG = 1024
_PLACE = _RANDOM.integers(1, 2**63, _LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Marks bytes that divide words; it never occurs in UTF-8.
GAP = 255


def fold_table(word_bytes: range | list[int]) -> np.ndarray:
    """Byte to byte: A-Z lower-cased, what isn't in ``word_bytes`` becomes GAP."""
    out = np.full(256, GAP, np.uint8)
    for b in word_bytes:
        out[b] = b + 32 if 65 <= b <= 90 else b
    return out


#: Words are runs of anything but ASCII white space.
NOT_SPACE = fold_table([b for b in range(255) if b != 32 and not 9 <= b <= 13])
#: Words are runs of ASCII letters and digits.
ALPHANUMERIC = fold_table([*range(48, 58), *range(65, 91), *range(97, 123)])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the value moves every bit of the hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word of ``data``."""
    low = table[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = low != GAP
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    sizes = ends - starts
    held = low[inside[1:-1].astype(bool)]
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(held)) - np.repeat(first, sizes)
    h = mix(np.add.reduceat(_BYTE[held] * _PLACE[place & (_LONG - 1)], first) + sizes.astype(np.uint64) * GOLD)
    for i in np.flatnonzero(sizes > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h, starts, ends


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; entry i starts at word i."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    h = words[: len(words) - size + 1]
    for k in range(1, size):
        h = mix(h * GOLD + words[k : len(words) - size + 1 + k])
    return h


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending: the hashes one text after the other, and each text's number of them.

    A text of fewer than ``size`` words has its whole word sequence as one shingle; without words it has none.
    """
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    words, starts, _ = word_hashes(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), NOT_SPACE)
    owner = np.searchsorted(ends, starts, "right")
    h = shingle_hashes(words, size)
    inside = owner[: len(h)] == owner[size - 1 :] if len(h) else np.zeros(0, bool)
    h, doc = h[inside], owner[: len(inside)][inside]
    counts = np.bincount(owner, minlength=len(texts))
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        first = np.searchsorted(owner, few)
        whole = []
        for i, at in zip(few, first):
            one = words[at : at + counts[i]]
            value = mix(one[:1] + np.uint64(counts[i]))
            for k in range(1, len(one)):
                value = mix(value * GOLD + one[k : k + 1])
            whole.append(value[0])
        h, doc = np.concatenate([h, np.array(whole, np.uint64)]), np.concatenate([doc, few])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(texts))


def blocks(texts: list[bytes], most: int = 1 << 20) -> list[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes, so that work arrays stay in the cache."""
    found, at, held = [], 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            found.append((at, i))
            at, held = i, 0
        held += len(t) + 1
    return found + ([(at, len(texts))] if at < len(texts) else [])
