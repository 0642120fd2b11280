"""Whole-batch text vectorisation with numpy.

A batch of texts becomes one array of code points; words, pieces and grams are
then found, hashed and counted for the whole batch at once, so that no Python
statement runs per word.  Nothing is truncated: a text of any length is handled
whole, and a batch is cut only between texts.

Null texts count as empty here; callers that tell the two apart look at the
Arrow validity themselves.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


@functools.lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    cats = [unicodedata.category(chr(i))[0] for i in range(0x30000)] + ["X"] * (sys.maxunicode + 1 - 0x30000)
    cats = np.array(cats, dtype="U1")
    out[cats == "L"] = LETTER
    out[cats == "N"] = NUMBER
    spaces = [9, 10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[spaces] = SPACE
    out[0x1C:0x20] = OTHER
    return out


@functools.lru_cache(1)
def lower_case() -> np.ndarray:
    """Lower case of every code point that has one of a single code point, else itself."""
    low = (chr(i).lower() for i in range(0x20000))
    out = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    out[:0x20000] = [ord(c) if len(c) == 1 else i for i, c in enumerate(low)]
    return out


@functools.lru_cache(1)
def scatter() -> np.ndarray:
    """A fixed random 64-bit value per code point."""
    return np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, sys.maxunicode + 1, np.uint64, endpoint=False)


@functools.lru_cache(1)
def _inverse() -> np.uint64:
    return np.uint64(pow(int(MULT), -1, 2**64))


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, which: str = "up") -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        step = MULT if which == "up" else _inverse()
        grown = np.full(max(n, 1 << 16), step, np.uint64)
        grown[0] = 1
        _powers[which] = have = np.multiply.accumulate(grown)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def codepoints(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and the offsets of each text in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    parts = texts.to_pylist()
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    whole = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(lens, out=offsets[1:])
    return (lower_case()[whole] if lower else whole), offsets


def batches(texts: pa.Array, budget: int = 2_000_000):
    """(from, to) ranges of texts of about `budget` bytes, each text whole."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at, done = 0, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, done + budget, "right")))
        yield at, min(to, n)
        done, at = int(ends[min(to, n) - 1]), min(to, n)


def runs(cls: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the maximal stretches of one class, cut at the texts' borders too."""
    if not len(cls):
        return np.zeros(0, np.int64)
    edge = np.empty(len(cls), bool)
    edge[0] = True
    np.not_equal(cls[1:], cls[:-1], out=edge[1:])
    inner = offsets[1:-1]
    edge[inner[inner < len(cls)]] = True
    return np.flatnonzero(edge)


def span_hash(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of code points; equal spans have equal hashes."""
    n = len(cps)
    total = np.zeros(n + 1, np.uint64)
    if n:
        np.cumsum(scatter()[cps] * powers(n), out=total[1:])
    raw = (total[ends] - total[starts]) * powers(n + 1, "down")[starts]
    return mix(raw ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words (runs of letters and digits): hash, text number, start and end.

    Starts and ends count code points of the batch.
    """
    return words_of(*codepoints(texts, lower=True))


def words_of(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, as in `words`, of lower-cased code points."""
    word = (classes()[cps] - np.uint8(1)) < 2
    starts = runs(word.view(np.uint8), offsets)
    ends = np.append(starts[1:], len(cps))
    keep = word[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    owner = np.searchsorted(offsets, starts, "right") - 1
    return span_hash(cps, starts, ends), owner, starts, ends


def expand(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lengths l: the group of each of sum(l) places, and the place's number in it."""
    group = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return group, np.arange(len(group)) - np.repeat(first, lengths)
