"""Benchmark decontamination by the q-gram lemma: count shared grams in diagonal bands, then align within the band."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm.textvec import SPACE, batches, classes, codepoints, expand, span_hash

Q = 16
#: Characters of the grams of passages in which the edits allowed can break every gram of Q: those of 20 to 31, 40 to 47 and 60 to 63 characters.
SHORT_Q = 10
#: Edits allowed per character of a passage.
RATE = 0.05
#: Passages with fewer characters, after normalising, share no gram with anything, and aren't looked for.
LEAST = Q
#: Characters of passages that are looked for in one scan; a larger benchmark takes several scans.
AT_ONCE = 2_000_000
_OUTSIDE = np.uint32(0xFFFFFFFF)


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters and digits with one space between stretches of them; offsets of the texts, places in the given texts."""
    cps, offsets = codepoints(texts, lower=True)
    kind = classes()[cps]
    word = (kind != 0) & (kind != SPACE)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = word.copy()
    if len(keep):
        keep[1:] |= word[:-1] & (owner[1:] == owner[:-1])
    out = np.where(word, cps, np.uint32(32))[keep]
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(offsets) - 1))]).astype(np.int64)
    return out, ends, np.flatnonzero(keep) - offsets[owner[keep]]


def gram(length: int) -> int:
    """Characters of the grams that a passage of this length is looked for by: the lemma asks for one at least with them."""
    return Q if length + 1 > Q * (int(RATE * length) + 1) else SHORT_Q


def budget(length: int) -> tuple[int, int]:
    """Edits allowed in a passage of this length, and the grams that a match within them shares with it at least."""
    edits = int(RATE * length)
    return edits, length + 1 - gram(length) * (edits + 1)


@dataclass
class Grams:
    """Grams of one size, sorted by hash, and where in which passages they are."""

    q: int
    keys: np.ndarray
    first: np.ndarray
    count: np.ndarray
    item: np.ndarray
    place: np.ndarray
    sieve: np.ndarray


@dataclass
class Passages:
    """The benchmark's passages and, for each size that they ask for, their grams."""

    ids: pa.Array
    texts: list[np.ndarray]
    edits: np.ndarray
    least: np.ndarray
    grams: list[Grams]


_SIEVE_BITS = 22


def _grams(texts: list[np.ndarray], q: int) -> Grams | None:
    """Grams of the passages that are looked for by those of size q, if there are any."""
    hashes, item, place = [], [], []
    for k, t in enumerate(texts):
        if gram(len(t)) == q:
            at = np.arange(len(t) - q + 1)
            hashes.append(span_hash(t, at, at + q))
            item.append(np.full(len(at), k))
            place.append(at)
    if not hashes:
        return None
    h, item, place = (np.concatenate(x) for x in (hashes, item, place))
    order = np.argsort(h, kind="stable")
    keys, first, count = np.unique(h[order], return_index=True, return_counts=True)
    sieve = np.zeros(1 << _SIEVE_BITS, bool)
    sieve[(keys >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)] = True
    return Grams(q, keys, first, count, item[order], place[order], sieve)


def passages(ids: pa.Array, texts: list[str], least: int = LEAST) -> Passages:
    cps, ends, _ = normalised(pa.array(texts, pa.string()))
    kept, own = [], []
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        t = cps[a:b]
        t = t[:-1] if len(t) and t[-1] == 32 else t
        if len(t) >= max(least, Q):
            kept.append(t)
            own.append(k)
    limits = np.array([budget(len(t)) for t in kept], np.int64).reshape(-1, 2)
    grams = [g for q in (Q, SHORT_Q) if (g := _grams(kept, q))]
    return Passages(ids.take(pa.array(own, pa.int64())), kept, limits[:, 0], limits[:, 1], grams)


def _align(pattern: np.ndarray, text: np.ndarray, width: int) -> tuple[int, int]:
    """Fewest edits of the whole pattern against a stretch of `text`, over `width` diagonals, and where that stretch ends."""
    step = np.arange(width)
    row = np.zeros(width, np.int64)
    padded = np.concatenate([text, np.full(max(0, len(pattern) + width - len(text)), _OUTSIDE, np.uint32)])
    for i, c in enumerate(pattern):
        best = row + (padded[i : i + width] != c)
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        row = np.minimum.accumulate(best - step) + step
    k = int(row.argmin())
    return int(row[k]), min(len(text), len(pattern) + k)


def _shared(g: Grams, cps: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, passage and diagonal of each gram that they share."""
    if len(cps) < g.q:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(len(cps) - g.q + 1)
    h = span_hash(cps, at, at + g.q)
    at = at[g.sieve[(h >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)]]
    k = np.minimum(np.searchsorted(g.keys, h[at]), len(g.keys) - 1)
    hit = g.keys[k] == h[at]
    at, k = at[hit], k[hit]
    doc = np.searchsorted(ends, at, "right") - 1
    inside = at + g.q <= ends[doc + 1]
    at, k, doc = at[inside], k[inside], doc[inside]
    group, n = expand(g.count[k])
    where = g.first[k][group] + n
    return doc[group], g.item[where], at[group] - ends[doc][group] - g.place[where]


def find(p: Passages, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """(text, passage, start, end, edits) of the best place of each passage in each text that has one within its budget."""
    cps, ends, places = normalised(texts)
    if not p.grams:
        return []
    doc, item, diagonal = (np.concatenate(x) for x in zip(*(_shared(g, cps, ends) for g in p.grams)))
    # bands of 2 (e + 1) diagonals begin at every (e + 1)th, so e + 1 neighbouring ones are whole in one of them
    band = diagonal // (p.edits[item] + 1)
    doc, item, band = np.tile(doc, 2), np.tile(item, 2), np.concatenate([band, band - 1])
    order = np.lexsort((band, item, doc))
    doc, item, band = doc[order], item[order], band[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
    begin = np.flatnonzero(new)
    shared = np.diff(np.append(begin, len(doc)))
    begin = begin[shared >= p.least[item[begin]]]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for d, j, b in zip(doc[begin].tolist(), item[begin].tolist(), band[begin].tolist()):
        pattern, edits = p.texts[j], int(p.edits[j])
        if best.get((d, j), (edits + 1,))[0] == 0:
            continue
        low, width = b * (edits + 1), 2 * (edits + 1)
        start = max(0, int(ends[d]) + low) if low > 0 else int(ends[d])
        region = cps[start : min(int(ends[d + 1]), int(ends[d]) + low + len(pattern) + width)]
        if low < 0:  # the text begins inside the band
            region = np.concatenate([np.full(-low, _OUTSIDE, np.uint32), region])
            start += low
        cost, stop = _align(pattern, region, width)
        if cost <= edits and (cost, start + stop) < best.get((d, j), (edits + 1, 0)):
            back, length = _align(pattern[::-1], region[:stop][::-1], 2 * width)
            begun = max(start + stop - length, int(ends[d]))
            best[d, j] = (cost, start + stop, begun)
    return [(d, j, int(places[begun]), int(places[stop - 1]) + 1, cost) for (d, j), (cost, stop, begun) in sorted(best.items())]


def _parts(benchmark: DataFrame, at_once: int, least: int) -> Iterator[Passages]:
    """The benchmark in parts of bounded size, so that one of any size can be looked for."""
    kind = to_arrow_type(benchmark.select("item_id").schema[0].dataType)
    ids, texts, size = [], [], 0
    rows = benchmark.select("item_id", "text").where("text IS NOT NULL").distinct().orderBy("item_id", F.xxhash64("text"))
    for r in rows.toLocalIterator():
        if size + len(r[1]) > at_once and texts:
            yield passages(pa.array(ids, kind), texts, least)
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1])
    if texts:
        yield passages(pa.array(ids, kind), texts, least)


def matches(docs: DataFrame, benchmark: DataFrame, at_once: int = AT_ONCE, least: int = LEAST) -> DataFrame:
    """One row per document row and passage found in it: doc_id, item_id, start, end, edits.

    Texts are compared by their lower-cased letters and digits.  A passage of m
    characters is found where an edit distance e of at most 5 % of m suffices: a
    match shares at least m + 1 - q (e + 1) grams of q characters with it, all in
    one band of diagonals; bands with as many are verified by banded alignment.
    Grams have 16 characters, or 10 where with 16 that number isn't positive, so
    that no match is left out.  Of several
    places in one document the one with fewest edits, then the first, is given;
    start and end count code points of the given text.

    Defined cases: null and empty texts and passages match nothing, nor do
    passages under `least` characters, by default those too short for a gram; a
    passage with a null item_id is found like others and reported with a null;
    doc_id and item_id may have any type with an order; equal passages under several item_ids give a
    row each; repeated rows give repeated rows; empty tables give an empty
    result; other columns are not looked at.
    """
    kinds = [df.select(c).schema[0].dataType.simpleString() for df, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start int, end int, edits int"
    out = None
    for p in _parts(benchmark, at_once, least):
        shared = docs.sparkSession.sparkContext.broadcast(p)

        def run(given: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in given:
                for i, j in batches(b.column("text"), 1_000_000):
                    found = find(shared.value, b.column("text").slice(i, j - i))
                    if found:
                        d, item, start, end, edits = zip(*found)
                        yield pa.RecordBatch.from_arrays(
                            [b.column("doc_id").slice(i, j - i).take(pa.array(d)), shared.value.ids.take(pa.array(item)), *(pa.array(x, pa.int32()) for x in (start, end, edits))],
                            names=["doc_id", "item_id", "start", "end", "edits"],
                        )

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, at_once: int = AT_ONCE, least: int = LEAST) -> DataFrame:
    """The rows of `docs` in which no passage of the benchmark is found, with all columns; cases as in `matches`."""
    at = docs.columns.index("text")
    for p in _parts(benchmark, at_once, least):
        shared = docs.sparkSession.sparkContext.broadcast(p)

        def run(given: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in given:
                clean = np.ones(b.num_rows, bool)
                for i, j in batches(b.column(at), 1_000_000):
                    for d, *_ in find(shared.value, b.column(at).slice(i, j - i)):
                        clean[i + d] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
