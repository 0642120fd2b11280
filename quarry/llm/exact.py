"""Exact dedup against a minimal perfect hash of the historical distinct digests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import fresh, written
from quarry.llm.textvec import mix

#: Digests in one shard of the hash; the number of shards follows the history or, if they are more, the new digests.
SHARD = 200_000
_SEED = np.uint64(0x9E3779B97F4A7C15)
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _level(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each 32-byte digest (rows of four words) in the bit field of a level."""
    seed = mix(np.array([(level + 1) * int(_SEED) & (2**64 - 1)], np.uint64))
    h = mix(keys[:, 0] ^ seed) ^ keys[:, 1]
    return (mix(h + keys[:, 2]) % np.uint64(size)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the levels in bits, and the bits end to end.

    On each level the keys that meet no other set their bit, and the others go
    on to the next.  A key's slot is the number of set bits before its own, so
    n distinct keys get the slots 0 to n - 1.
    """
    sizes, fields = [], []
    level = 0
    while len(keys):
        size = -(-max(64, len(keys)) // 8) * 8
        at = _level(keys, level, size)
        alone = np.bincount(at, minlength=size) == 1
        fields.append(alone)
        sizes.append(size)
        keys = keys[~alone[at]]
        level += 1
    bits = np.concatenate(fields) if fields else np.zeros(0, bool)
    return np.array(sizes, np.int64), np.packbits(bits, bitorder="little")


def slot(keys: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Slot of each key; a key outside the set gets -1 or the slot of another."""
    out = np.full(len(keys), -1, np.int64)
    before = np.concatenate([[0], np.cumsum(_POP[bits], dtype=np.int64)])
    left, base = np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        if not len(left):
            break
        p = base + _level(keys[left], level, int(size))
        byte, bit = p >> 3, (p & 7).astype(np.uint8)
        hit = (bits[byte] >> bit) & 1 == 1
        below = bits[byte] & ((np.uint16(1) << bit.astype(np.uint16)) - 1).astype(np.uint8)
        out[left[hit]] = (before[byte] + _POP[below])[hit]
        left, base = left[~hit], base + int(size)
    return out


def _words(digests: pa.ChunkedArray) -> np.ndarray:
    """Digests of 32 bytes as rows of four 64-bit words."""
    joined = b"".join(digests.to_pylist())
    return np.frombuffer(joined, "<u8").reshape(-1, 4)


_INDEX = "shard int, sizes array<bigint>, bits binary, digests binary, winners array<{kind}>"
_FOUND = "digest binary, winner {kind}, member boolean"


def _build_shard(t: pa.Table) -> pa.Table:
    keys = _words(t["digest"])
    sizes, bits = build(keys)
    at = slot(keys, sizes, bits)
    order = np.argsort(at)
    winners = t["winner"].combine_chunks().take(pa.array(order))
    return pa.table(
        {
            "shard": pa.array([t["shard"][0].as_py()], pa.int32()),
            "sizes": pa.array([sizes], pa.list_(pa.int64())),
            "bits": pa.array([bits.tobytes()], pa.binary()),
            "digests": pa.array([keys[order].tobytes()], pa.binary()),
            "winners": pa.ListArray.from_arrays(pa.array([0, len(winners)], pa.int32()), winners),
        }
    )


def _look_up(new: pa.Table, index: pa.Table) -> pa.Table:
    """Winner of each new digest that the shard holds, all 32 bytes compared."""
    n = len(new)
    if not n or not len(index):
        return pa.table({"digest": new["digest"], "winner": pa.nulls(n, index.schema.field("winners").type.value_type), "member": pa.array(np.zeros(n, bool))})
    keys = _words(new["digest"])
    held = np.frombuffer(index["digests"][0].as_py(), "<u8").reshape(-1, 4)
    at = slot(keys, np.array(index["sizes"][0].as_py(), np.int64), np.frombuffer(index["bits"][0].as_py(), np.uint8))
    member = (at >= 0) & (held[np.maximum(at, 0)] == keys).all(1)
    winners = index["winners"].combine_chunks().flatten().take(pa.array(np.maximum(at, 0), mask=~member))
    return pa.table({"digest": new["digest"], "winner": winners, "member": pa.array(member)})


def history_index(digests: DataFrame, shards: int) -> DataFrame:
    """The index of (digest, winner): per shard the hash, and slots of full digests and winners."""
    sharded = digests.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").applyInArrow(_build_shard, _INDEX.format(kind=_kind(digests, "winner")))


def _kind(df: DataFrame, column: str) -> str:
    return df.select(column).schema[0].dataType.simpleString()


def _resolved(docs: DataFrame, history: DataFrame, shard: int) -> DataFrame:
    """doc_id, digest (null for a null text), keeper_id, in_history of every row."""
    ids = history.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__old")).distinct()
    d = docs.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    d = d.join(ids, F.col("doc_id") == F.col("__old"), "left").select("doc_id", "digest", F.col("__old").isNotNull().alias("old"))
    d = written(d, "digests")
    firsts = d.where(F.col("digest").isNotNull()).groupBy("digest", "old").agg(F.min("doc_id").alias("winner"))
    firsts = written(firsts, "firsts")
    old = firsts.where("old").select("digest", "winner")
    new = firsts.where("NOT old").select("digest", F.col("winner").alias("own"))
    most = max([r["count"] for r in firsts.groupBy("old").count().collect()], default=1)  # of history and arrivals the larger side
    shards = -(-most // shard)
    index = written(history_index(old, shards), "history")
    sharded = new.select("digest", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"))
    found = sharded.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_look_up, _FOUND.format(kind=_kind(docs, "doc_id")))
    new = new.join(found, "digest").select("digest", F.lit(False).alias("old"), F.when(F.col("member"), F.col("winner")).otherwise(F.col("own")).alias("keeper_id"), "member")
    both = new.unionByName(old.select("digest", F.lit(True).alias("old"), F.col("winner").alias("keeper_id"), F.lit(True).alias("member")))
    out = d.join(both, ["digest", "old"], "left")
    keeper = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("keeper_id"))
    return out.select("doc_id", "digest", keeper.alias("keeper_id"), F.coalesce("member", F.lit(False)).alias("in_history"))


def keepers(docs: DataFrame, history: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per row of `docs`: doc_id, keeper_id, in_history.

    `history` has a column doc_id: those documents came earlier.  Their
    distinct texts, as SHA-256 digests with the smallest doc_id as winner, are
    held in a sharded minimal perfect hash, a table in the shared folder.  The
    distinct digests of the other documents are looked up; members keep the
    history's winner, and the rest are grouped among themselves, the smallest
    doc_id being kept.  Digests are reduced per text before they move, so a
    text repeated a million times costs one row per task.

    Defined cases: a null text repeats nothing, its keeper is its own doc_id;
    the empty text is a text like others; a null doc_id never wins against
    another; rows repeated whole have one keeper, themselves included; with an
    empty history all are grouped; an empty table gives an empty result; doc_id
    may have any type with an order.  Other columns are not looked at.
    """
    return _resolved(docs, history, shard).drop("digest")


def drop_copies(docs: DataFrame, history: DataFrame, shard: int = SHARD) -> DataFrame:
    """The rows of `docs` that are their text's keeper, with all columns.

    Rows with a null text all stay.  Of several rows with the keeper's doc_id
    and text one stays, the first by a hash of the other columns; so does one
    of a text whose rows all have a null doc_id.
    """
    key, n = fresh(docs, "key", "n")

    def identity(doc_id, hexed):
        return F.concat_ws(":", F.coalesce(hexed, F.lit("")), F.coalesce(doc_id.cast("string"), F.lit("")))

    keep = _resolved(docs, history, shard).select(identity(F.col("keeper_id"), F.lower(F.hex("digest"))).alias(key)).distinct()
    d = docs.withColumn(key, identity(F.col("doc_id"), F.sha2(F.col("text").cast("binary"), 256)))
    others = [F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    w = Window.partitionBy(key).orderBy(F.xxhash64(*others) if others else F.lit(0))
    ranked = d.join(keep, key, "left_semi").withColumn(n, F.row_number().over(w))
    return ranked.where((F.col(n) == 1) | F.col("text").isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = """
WITH d AS (
  SELECT doc_id, text, doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AS old FROM documents
)
SELECT doc_id,
       CASE WHEN text IS NULL THEN doc_id
            ELSE coalesce(min(CASE WHEN old THEN doc_id END) OVER (PARTITION BY text), min(doc_id) OVER (PARTITION BY text)) END AS keeper_id,
       text IS NOT NULL AND bool_or(old) OVER (PARTITION BY text) AS in_history
FROM d
"""
