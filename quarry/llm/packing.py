"""Packing by shortest pack first over the histogram of lengths."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import written
from quarry.llm.textvec import batches, expand
from quarry.llm.tokens import Tokenizer

CAPACITY = 2048
#: Parts that the pieces of one length are ranked in, the same for any table.
SALTS = 16_384
Pattern = tuple[int, list[int]]


def patterns(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """(count, lengths) of packs that hold the histogram's pieces.

    Lengths are placed longest first.  Each goes to the shortest packs, those
    with most room left; where no pack has room, new packs are begun.  Packs
    alike are handled together as a pattern with a count, so the work depends
    on the capacity and not on the number of documents.
    """
    open_at: list[list[tuple[int, tuple | None]]] = [[] for _ in range(capacity + 1)]  # by room left
    most = 0
    done: list[tuple[int, tuple]] = []
    def put(room: int, count: int, pack: tuple) -> None:
        nonlocal most
        if room:
            open_at[room].append((count, pack))
            most = max(most, room)
        else:
            done.append((count, pack))

    for length in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        left = histogram[length]
        while left:
            while most and not open_at[most]:
                most -= 1
            if most >= length:
                count, pack = open_at[most].pop()
                use = min(count, left)
                if count > use:
                    open_at[most].append((count - use, pack))
                put(most - length, use, (pack, length))
                left -= use
            else:  # new packs: each takes as many of this length as it holds before the next is begun
                each = capacity // length
                full, rest = divmod(left, each)
                for count, n in ((full, each), (1, rest)):
                    if count and n:
                        pack = None
                        for _ in range(n):
                            pack = (pack, length)
                        put(capacity - n * length, count, pack)
                left = 0
    done += [x for at in open_at for x in at]
    out = []
    for count, pack in done:
        lengths = []
        while pack is not None:
            pack, length = pack
            lengths.append(length)
        out.append((count, lengths[::-1]))
    return sorted(out, key=lambda x: (x[1], x[0]), reverse=True)


def slots(found: list[Pattern]) -> dict[str, np.ndarray]:
    """Per slot of each pattern: its length, the first rank it takes, its first pack and its offset in the pack."""
    cols: dict[str, list[int]] = {"length": [], "rank": [], "pack": [], "offset": []}
    taken: dict[int, int] = {}
    base = 0
    for count, lengths in found:
        at = 0
        for length in lengths:
            for k, v in zip(cols, (length, taken.get(length, 0), base, at)):
                cols[k].append(v)
            taken[length] = taken.get(length, 0) + count
            at += length
        base += count
    out = {k: np.array(v, np.int64) for k, v in cols.items()}
    order = np.lexsort((out["rank"], out["length"]))
    return {k: v[order] for k, v in out.items()}


def pieces(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """(doc_id, piece, piece_start, n_tokens, ids) as a table: every document's token ids in pieces of `capacity` and a rest."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(SparkFiles.get(name))
        for b in given:
            for i, j in batches(b.column("text"), 1_000_000):
                ids, counts = tokenizer(b.column("text").slice(i, j - i))
                owner, piece = expand(np.maximum(1, -(-counts // capacity)))
                size = np.minimum(counts[owner] - piece * capacity, capacity)
                cut = np.append(0, np.cumsum(size)).astype(np.int32)
                cols = [b.column("doc_id").slice(i, j - i).take(pa.array(owner)), pa.array(piece), pa.array(piece * capacity), pa.array(size)]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(cut), pa.array(ids.astype(np.int32)))], names=["doc_id", "piece", "piece_start", "n_tokens", "ids"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return written(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece bigint, piece_start bigint, n_tokens bigint, ids array<int>"), "pieces")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of a document: doc_id, piece, piece_start, n_tokens, ids, pack_id, pack_offset.

    A document's token ids, those of the public vocabulary, are cut into pieces of
    `capacity` and a rest, so whole texts are packed.  The pieces of one length
    are ranked by (doc_id, piece, ids) inside salts of a hash, the salts one after
    the other, and the rank picks the place: pattern, pack and offset.

    Defined cases: a null or empty text has one piece of 0 tokens with null
    pack_id and pack_offset; repeated rows are packed as often as they come, and
    pieces alike in doc_id, number and ids may change places; an empty table gives
    an empty result; doc_id may have any type with an order; other columns are not
    looked at.
    """
    cut = pieces(docs, vocabulary, capacity)
    histogram = {r[0]: r[1] for r in cut.groupBy("n_tokens").count().collect()}  # at most capacity + 1 rows
    histogram.pop(0, None)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids"), F.lit(SALTS)))
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("n_tokens", "salt").count().select("n_tokens", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece", "ids")
    ranked = salted.withColumn("r", F.row_number().over(inside) - 1).join(starts, ["n_tokens", "salt"])
    ranked = ranked.select("doc_id", "piece", "piece_start", "n_tokens", "ids", (F.col("r") + F.col("first")).cast("bigint").alias("rank"))
    where = slots(patterns(histogram, capacity))  # its size depends on the capacity only
    names = ["doc_id", "piece", "piece_start", "n_tokens", "ids"]

    def place(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = max(1, int(where["rank"].max()) + 1) if len(where["rank"]) else 1
        keys = where["length"] * total + where["rank"]
        for b in given:
            length, rank = b.column("n_tokens").to_numpy(), b.column("rank").to_numpy()
            real = length > 0
            at = np.searchsorted(keys, length * total + np.minimum(rank, total - 1), "right") - 1
            at[~real] = 0
            if len(where["rank"]):
                packs, offsets = where["pack"][at] + rank - where["rank"][at], where["offset"][at]
            else:
                packs = offsets = np.zeros(len(length), np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(packs, mask=~real), pa.array(offsets, mask=~real)], names=[*names, "pack_id", "pack_offset"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece bigint, piece_start bigint, n_tokens bigint, ids array<int>, pack_id bigint, pack_offset bigint")


def assembled(packed: DataFrame) -> DataFrame:
    """One row per pack: pack_id, n_tokens, ids end to end, and doc_ids and ends of its pieces, which attention must not cross."""
    members = packed.where("pack_id IS NOT NULL").groupBy("pack_id").agg(F.sort_array(F.collect_list(F.struct("pack_offset", "n_tokens", "doc_id", "ids"))).alias("m"))
    ends = F.transform("m", lambda x: x["pack_offset"] + x["n_tokens"])
    return members.select("pack_id", F.element_at(ends, -1).alias("n_tokens"), F.flatten(F.col("m.ids")).alias("ids"), F.col("m.doc_id").alias("doc_ids"), ends.alias("ends"))
