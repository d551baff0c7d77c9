"""Word and shingle hashes of whole texts, vectorised over a batch.

Texts are lower-cased in A-Z only and cut at the parting bytes; each word gets a 64-bit hash from running sums of its
bytes, each window of words one from its words' hashes. No Python loop runs over words.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_PARTS = np.zeros(256, bool)
_PARTS[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA5A3564E27F8862B, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x9FB21C651E98DF25], "u8")
_POWERS: dict[int, np.ndarray] = {}
#: Bytes of text that are hashed at a time, and powers that a worker keeps; a longer stretch is one word, made for itself.
SEGMENT = 1 << 17
#: Bytes of text in a chunk.
CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(SEGMENT.bit_length(), (n - 1).bit_length())
        have = np.empty(size, "u8")
        have[0], filled = 1, 1
        while filled < size:
            have[filled : 2 * filled] = have[:filled] * np.uint64(pow(base, filled, 1 << 64))
            filled *= 2
        if size <= 2 * SEGMENT:
            _POWERS[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Parting bytes for words of letters and digits: every ASCII byte but those.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def word_hashes(raw: list[bytes], between: np.ndarray = _PARTS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, in order, and the place of the text that has it; between marks parting bytes."""
    sizes = np.array([len(r) + 1 for r in raw])
    data = _LOWER[np.frombuffer(b"\n".join([*raw, b""]), "u1")]
    parts = between[data]
    edge = np.diff(np.concatenate([[True], parts, [True]]).astype("i1"))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    h, k = np.empty(len(start), "u8"), 0
    while k < len(start):
        last = max(k + 1, int(np.searchsorted(end, start[k] + SEGMENT, side="right")))
        a, z = int(start[k]), int(end[last - 1])
        sums = np.zeros(z - a + 1, "u8")
        np.cumsum((data[a:z].astype("u8") + np.uint64(1)) * _powers(_BASE, z - a), dtype="u8", out=sums[1:])
        first, behind = start[k:last] - a, end[k:last] - a
        h[k:last] = (sums[behind] - sums[first]) * _powers(_INVERSE, z - a)[first]
        k = last
    h = mixed(h + (end - start).astype("u8") * _FACTORS[4])
    owner = np.searchsorted(np.cumsum(sizes), start, side="right")
    return h, owner


def shingle_hashes(raw: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text of each window of n words, and the number of words of each text.

    A text of fewer than n words has all of them as its one window; one without words has none.
    """
    h, owner = word_hashes(raw)
    words = np.bincount(owner, minlength=len(raw))
    if len(h) >= n:
        same = owner[: len(h) - n + 1] == owner[n - 1 :]
        s = np.zeros(len(h) - n + 1, "u8")
        for k in range(n):
            s = mixed(s + h[k : len(h) - n + 1 + k] * _FACTORS[k % 4])
        shingle, of = s[same], owner[: len(same)][same]
    else:
        shingle, of = np.empty(0, "u8"), np.empty(0, "i8")
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        first = np.searchsorted(owner, short)
        extra = np.array([_sequence(h[a : a + words[k]]) for a, k in zip(first, short)], "u8")
        shingle, of = np.concatenate([shingle, extra]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        shingle, of = shingle[order], of[order]
    return shingle, of, words


def _sequence(h: np.ndarray) -> np.uint64:
    s = np.array([len(h)], "u8")
    for k in range(len(h)):
        s = mixed(s + h[k : k + 1] * _FACTORS[0])
    return s[0]


def shingle_sets(raw: list[bytes], n: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted signed integers."""
    shingle, of, _ = shingle_hashes(raw, n)
    bounds = np.searchsorted(of, np.arange(len(raw) + 1))
    return [np.unique(shingle[a:b].view("i8")) for a, b in zip(bounds[:-1], bounds[1:])]


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK, lower: bool = False) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about a megabyte of text each (one text at least), and the texts as bytes; null is empty.

    lower turns all letters to lower case, not those of ASCII alone. Only a slice's texts are made into bytes at a time.
    """
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype("i8") + 1)
        first = 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
            part = b.slice(first, last - first)
            texts = pc.utf8_lower(part.column(column)) if lower else part.column(column)
            yield part, [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
            first = last
    release()


def release() -> None:
    """Give freed memory back to the system: a worker lives on after its task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)
