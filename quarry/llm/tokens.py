"""Token ids by frequency rank, in bytes with separate control bytes (two bits per id: its bytes less one)."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written
from quarry.llm.textvec import LETTER, NUMBER, OTHER, SPACE, batches, classes, codepoints, expand, runs, span_hash

#: Pre-tokenisation of the byte-level vocabularies; `pieces` finds the same pieces for a whole batch.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


def pieces(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces that PATTERN finds in the texts."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = classes()[cps]
    starts = runs(cls, offsets)
    ends = np.append(starts[1:], n)
    borders = np.zeros(n + 1, bool)
    borders[offsets] = True
    flag = np.zeros(n + 1, bool)
    flag[starts] = True
    kind = cls[starts]
    spaces = (kind == SPACE) & ~borders[ends]  # space before something: its last character stands apart,
    last = ends[spaces] - 1
    flag[last] = True
    joined = last[cps[last] == 32]  # and a blank goes with what follows
    flag[joined + 1] = False
    quotes = starts[(kind == OTHER) & (ends - starts == 1) & (cps[starts] == 39)]
    quotes = quotes[flag[quotes] & ~borders[quotes + 1]]
    quotes = quotes[cls[quotes + 1] == LETTER]
    for suffix in _SUFFIXES:
        at = quotes[quotes + len(suffix) < n]
        for k, c in enumerate(suffix):
            at = at[cps[at + 1 + k] == ord(c)]
        if len(suffix) == 2:  # both letters in the same text
            at = at[~borders[at + 2]]
        flag[at + 1] = False
        flag[at + 1 + len(suffix)] = True
        quotes = np.setdiff1d(quotes, at)
    begin = np.flatnonzero(flag[:n])
    return begin, np.append(begin[1:], n)


@functools.lru_cache(2)
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Tokenizer:
    """Ids of whole batches: every distinct piece is encoded once, and remembered up to a bound of memory.

    Pieces are found by a 64-bit hash, and compared character by character with
    what was found; those that only share their hash with another are encoded on
    their own.
    """

    HELD = 400_000

    def __init__(self, vocabulary: str):
        self.encoding = _encoding(vocabulary)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(0, np.int64)  # where each key's piece stands in `chars`, and its length
        self.length = np.zeros(0, np.int64)
        self.chars = np.zeros(0, np.uint32)

    def _encoded(self, cps: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces end to end, and how many each has."""
        found = [self.encoding.encode_ordinary(cps[a:b].tobytes().decode("utf-32-le")) for a, b in zip(begin.tolist(), end.tolist())]
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((x for xs in found for x in xs), np.uint32, int(count.sum())), count

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of each text's."""
        cps, offsets = codepoints(texts)
        begin, end = pieces(cps, offsets)
        distinct, where, inverse = np.unique(span_hash(cps, begin, end), return_index=True, return_inverse=True)
        new = distinct[~np.isin(distinct, self.keys, assume_unique=True)]
        if len(new):
            at = where[np.searchsorted(distinct, new)]
            ids, count = self._encoded(cps, begin[at], end[at])
            length = end[at] - begin[at]
            group, n = expand(length)
            keys = np.concatenate([self.keys, new])
            order = np.argsort(keys)
            self.keys = keys[order]
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])[order]
            self.count = np.concatenate([self.count, count])[order]
            self.at = np.concatenate([self.at, len(self.chars) + np.cumsum(length) - length])[order]
            self.length = np.concatenate([self.length, length])[order]
            self.ids = np.concatenate([self.ids, ids])
            self.chars = np.concatenate([self.chars, cps[begin[at][group] + n]])
        slot = np.searchsorted(self.keys, distinct)[inverse]
        first, count, known = self.first[slot], self.count[slot], self.ids
        other = np.flatnonzero(~self._same(cps, begin, end, slot))
        if len(other):
            ids, own = self._encoded(cps, begin[other], end[other])
            first[other], count[other] = len(known) + np.cumsum(own) - own, own
            known = np.concatenate([known, ids])
        group, n = expand(count)
        ids = known[first[group] + n]
        owner = np.searchsorted(offsets, begin, "right") - 1
        per_text = np.bincount(owner, count, len(texts)).astype(np.int64)
        if len(self.keys) > self.HELD:
            self.clear()
        return ids, per_text

    def _same(self, cps: np.ndarray, begin: np.ndarray, end: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Whether each piece is the one that its slot was filled with."""
        length = end - begin
        same = length == self.length[slot]
        # pieces follow each other without gaps, so all their characters are those of the batch
        shift = np.repeat(self.at[slot] - begin, length)
        place = np.arange(len(cps)) + shift
        wrong = cps != self.chars[np.minimum(place, len(self.chars) - 1)] if len(self.chars) else np.zeros(0, bool)
        if wrong.any():
            same[np.searchsorted(begin, np.flatnonzero(wrong), "right") - 1] = False
        return same


def encode(ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control bytes and data bytes of each text whose `counts` ranks stand end to end."""
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    ends = np.cumsum(size)
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    start = ends - size
    for k in range(4):
        more = size > k
        data[start[more] + k] = (ranks[more] >> np.uint32(8 * k)) & np.uint32(0xFF)
    quads = -(-counts // 4)
    group, n = expand(counts)
    place = (np.cumsum(quads) - quads)[group] * 4 + n
    codes = np.zeros(int(quads.sum()) * 4, np.uint8)
    codes[place] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    cut_c = np.concatenate([[0], np.cumsum(quads)])
    cut_i = np.concatenate([[0], np.cumsum(counts)])
    cut_d = np.concatenate([[0], ends])[cut_i]
    return [control[a:b].tobytes() for a, b in zip(cut_c[:-1], cut_c[1:])], [data[a:b].tobytes() for a, b in zip(cut_d[:-1], cut_d[1:])]


#: For each control byte the lengths of its four ids.
LENGTHS = np.array([[1 + (c >> s & 3) for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The `n` ranks of a text: lengths from the table, then all bytes gathered at once."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    start = np.cumsum(size) - size
    padded = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    out = np.zeros(n, np.uint32)
    for k in range(4):
        out |= np.where(size > k, padded[np.minimum(start + k, len(padded) - 1)], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenised(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n, ids) with ids as little-endian 32-bit integers, as a table in the shared folder."""

    docs.sparkSession.sparkContext.addFile(vocabulary)  # Spark brings it to every executor
    name = os.path.basename(vocabulary)

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(SparkFiles.get(name))
        for b in given:
            for i, j in batches(b.column("text"), 1_000_000):
                ids, counts = tokenizer(b.column("text").slice(i, j - i))
                cut = np.concatenate([[0], np.cumsum(counts)])
                ids = ids.astype("<u4" if len(ids) and ids.max() > 0xFFFF else "<u2")
                rows = [ids[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(counts), pa.array(rows, pa.binary())], names=["doc_id", "n", "ids"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return written(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, ids binary"), "ids")


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a batch end to end, whatever width each row was written in, and each row's number."""
    counts = b.column("n").to_numpy()
    rows = b.column("ids").to_pylist()
    if all(len(x) == 2 * n for x, n in zip(rows, counts.tolist())):
        return np.frombuffer(b"".join(rows), "<u2").astype(np.uint32), counts
    parts = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4").astype(np.uint32) for x, n in zip(rows, counts.tolist())]
    return np.concatenate(parts), counts


def rank_table(ids: DataFrame) -> DataFrame:
    """(token, n, rank) of all tokens that occur: rank 0 is the most frequent, of equals the smaller id.

    It has at most as many rows as the vocabulary.
    """

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in given:
            part = np.bincount(_flat(b)[0])
            if len(part) > len(total):
                total, part = part, total
            total[: len(part)] += part
        token = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(total[token])], names=["token", "n"])

    counted = ids.select("n", "ids").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()
    ordered = sorted(((r["token"], r["n"]) for r in counted), key=lambda x: (-x[1], x[0]))
    return ids.sparkSession.createDataFrame([(t, n, k) for k, (t, n) in enumerate(ordered)], "token bigint, n bigint, rank bigint")


def binary_ids(docs: DataFrame, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    """Encoded documents (doc_id, n_tokens, control, data), one row per row of `docs`, and the table of ranks (token, n, rank).

    Whole texts are tokenised once, with a public byte-level vocabulary.  The
    ids are counted over all documents and ranked, frequent ones first, so that
    most take one byte; two control bits per id say how many bytes it takes, four
    ids to a control byte, and both streams begin anew in each document.  With
    the rank table `decode` gives the ids back exactly.

    Defined cases: a null or empty text has 0 tokens and empty streams; texts made
    to share hashes get their own ids all the same; repeated rows give repeated
    rows; an empty table gives empty results; doc_id may have any type; other
    columns are not looked at.
    """
    ids = tokenised(docs, vocabulary)
    ranks = rank_table(ids)
    token = np.array([r["token"] for r in ranks.orderBy("rank").collect()], np.int64)
    rank_of = np.zeros(int(token.max()) + 1 if len(token) else 1, np.uint32)
    rank_of[token] = np.arange(len(token), dtype=np.uint32)

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            if not b.num_rows:
                continue
            flat, counts = _flat(b)
            cut, at, row = np.concatenate([[0], np.cumsum(counts)]), 0, 0
            while row < len(counts):
                to = max(row + 1, int(np.searchsorted(cut, at + 500_000, "right")) - 1)
                control, data = encode(rank_of[flat[cut[row] : cut[to]]], counts[row:to])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(row, to - row), b.column("n").slice(row, to - row), pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                    names=["doc_id", "n_tokens", "control", "data"],
                )
                row, at = to, int(cut[to])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return ids.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, control binary, data binary"), ranks
