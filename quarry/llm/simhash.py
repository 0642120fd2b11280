"""SimHash near-dedup: candidates from blocks of bits, discarded by tables of their distances to pivots, then verified.

**Candidates.**  Fingerprints at most 20 bits apart differ in at most 2 bits in
one of 7 blocks, since 3 in each make 21.  So whoever looks up, for each block
of a fingerprint, all values of it with up to 2 bits changed, meets all that are
near, whatever the number of fingerprints; none is left to chance.

**Pivots.**  Distances of 128-bit fingerprints to one reference crowd around 64,
so that a few references of any kind tell hardly any two of them apart.  The
references here come as a family: a base, and all fingerprints that differ from
it by complementing some of 64 blocks of two bits, 2^64 in all.  The distance to
each of them is a sum over the blocks, of the distance d to the base there or,
where the block is complemented, of 2 - d.  So the table needs only the 64 block
distances of a fingerprint, and the largest difference of two fingerprints'
distances over the whole family is the sum of the 64 absolute differences, taken
at the reference that complements just the blocks where the first is nearer.
Block distances are held in unary, two bits each, which makes that sum a count
of differing bits.  It never exceeds the Hamming distance, so what it discards
can't be near.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import fresh, written
from quarry.llm.textvec import batches, mix, words

BITS = 128
#: Fingerprints at most so many bits apart are near.
NEAR = 20
#: Blocks that a fingerprint is cut into: near ones differ in RADIUS bits at most in one of them, since otherwise they differ in BLOCKS * (RADIUS + 1) or more.
BLOCKS = 7
RADIUS = NEAR // BLOCKS
#: Fingerprints of a cell, about; a task holds two cells.
CELL = 1_000_000
#: Cells of a small table, so that its pairs of cells occupy all cores.
LEAST_CELLS = 8
_LOW = np.uint64(0x5555555555555555)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text the 128-bit majority of its distinct words' hashes, as two words; and how many distinct words it has."""
    n = len(texts)
    h, owner, _, _ = words(texts)
    _, first = np.unique(mix(h ^ mix(owner.astype(np.uint64) + np.uint64(1))), return_index=True)
    first.sort()
    h, owner = h[first], owner[first]
    count = np.bincount(owner, minlength=n)
    ones = np.zeros((n, BITS), np.int64)
    for a in range(0, len(h), 50_000):
        part, own = h[a : a + 50_000], owner[a : a + 50_000]
        both = np.stack([part, mix(part ^ np.uint64(0xA5A5A5A55A5A5A5A))], 1)
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        ones[own[begin]] += np.add.reduceat(np.unpackbits(both.view(np.uint8), axis=1), begin, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > count[:, None], axis=1).view(np.uint64).reshape(n, 2), count


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


def base() -> np.ndarray:
    """The reference that the family of pivots is built on."""
    return np.random.Generator(np.random.PCG64(41)).integers(0, 2**64, 2, np.uint64, endpoint=False)


def pivot_table(prints: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Distances to the reference in each block of two bits, in unary: 00, 01, 11."""
    x = prints ^ reference
    low, high = x & _LOW, (x >> np.uint64(1)) & _LOW
    return (low | high) | ((low & high) << np.uint64(1))


def pivot_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Largest difference of two fingerprints' distances to one reference, over the whole family, from their rows of the table."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


def near(prints: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) are near: those whose pivot distances differ nowhere by more than NEAR, verified."""
    left = np.flatnonzero(pivot_bound(table[i], table[j]) <= NEAR)
    out = np.zeros(len(i), bool)
    out[left] = distance(prints[i[left]], prints[j[left]]) <= NEAR
    return out


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each one's connected component."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        np.minimum.at(root, np.maximum(a, b), low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def blocks() -> list[tuple[int, int]]:
    """First bit and width of each block."""
    ends = [BITS * k // BLOCKS for k in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def block_key(prints: np.ndarray, first: int, width: int) -> np.ndarray:
    """The bits of a block as a number."""
    word, low = divmod(first, 64)
    key = prints[:, word] >> np.uint64(low)
    if low + width > 64:
        key |= prints[:, word + 1] << np.uint64(64 - low)
    return (key & np.uint64((1 << width) - 1)).view(np.int64)


def ball(width: int) -> np.ndarray:
    """What two blocks that agree in all but RADIUS bits at most can differ by."""
    return np.array([sum(1 << b for b in at) for r in range(RADIUS + 1) for at in combinations(range(width), r)], np.int64)


def candidates(home: np.ndarray, visit: np.ndarray, step: int = 512, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i of `home`, j of `visit`) that differ in RADIUS bits at most in some block, once for each such block.

    They are looked at in turns of about `most`; those that the pivot table
    can't discard come out.  One word of it is asked before the other.
    """
    ours, theirs = pivot_table(home, base()), pivot_table(visit, base())
    for first, width in blocks():
        word = int(2 * first + width < BITS)  # the one that has less of the block
        key, masks = block_key(home, first, width), ball(width)
        order = np.argsort(key, kind="stable")
        start = np.append(0, np.cumsum(np.bincount(key, minlength=1 << width)))
        held, rest = ours[order, word], ours[order, 1 - word]
        other, last = np.ascontiguousarray(theirs[:, word]), np.ascontiguousarray(theirs[:, 1 - word])
        keys = block_key(visit, first, width)
        for at in range(0, len(visit), step):
            look = (keys[at : at + step, None] ^ masks).ravel()
            low = start[look]
            size = start[look + 1] - low
            some = np.flatnonzero(size)
            low, size, who = low[some], size[some], some // len(masks) + at
            end = np.cumsum(size)
            turn = 0
            while turn < len(end):
                done = end[turn] - size[turn]
                upto = max(turn + 1, int(np.searchsorted(end, done + most, "right")))
                n = size[turn:upto]
                place = np.repeat(low[turn:upto] + done - (end[turn:upto] - n), n) + np.arange(end[upto - 1] - done)
                j = np.repeat(who[turn:upto], n)
                turn = upto
                bound = np.bitwise_count(held[place] ^ other[j])
                left = np.flatnonzero(bound <= NEAR)
                place, j, bound = place[left], j[left], bound[left]
                bound += np.bitwise_count(rest[place] ^ last[j])
                left = np.flatnonzero(bound <= NEAR)
                yield order[place[left]], j[left]


def spanning(home: np.ndarray, visit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the near pairs of `home` with `visit`, or with itself, connect; `visit` is numbered on from `home`."""
    same = visit is None
    both = home if same else np.concatenate([home, visit])
    table, shift = pivot_table(both, base()), 0 if same else len(home)
    root, held = np.arange(len(both)), 0
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def merged() -> np.ndarray:
        apart = np.flatnonzero(root != np.arange(len(both)))
        return roots(len(both), np.concatenate([apart, *out_i]), np.concatenate([root[apart], *out_j]))

    for i, j in candidates(home, home if same else visit):
        j = j + shift
        if same:
            i, j = i[i < j], j[i < j]
        ok = near(both, table, i, j)
        out_i.append(i[ok])
        out_j.append(j[ok])
        held += int(ok.sum())
        if held > 2_000_000:
            root, held = merged(), 0
            out_i, out_j = [], []
    root = merged()
    apart = np.flatnonzero(root != np.arange(len(both)))
    return apart, root[apart]


def _met(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between the rows of each pair of cells."""
    parts = [b for b in given if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    p = np.stack([t.column("f1").to_numpy(), t.column("f2").to_numpy()], 1).view(np.uint64)
    node, pair, side = (t.column(c).to_numpy() for c in ("node", "pair", "side"))
    for one in np.unique(pair):
        home, visit = np.flatnonzero((pair == one) & (side != 1)), np.flatnonzero((pair == one) & (side == 1))
        if len(visit):
            a, b = spanning(p[home], p[visit])
        elif (side[home] == 2).any():
            a, b = spanning(p[home])
        else:
            continue
        at = node[np.concatenate([home, visit])]
        yield pa.RecordBatch.from_arrays([pa.array(at[a]), pa.array(at[b])], names=["a", "b"])


def links(distinct: DataFrame, n: int, most: int = CELL) -> DataFrame:
    """Edges (a, b) between nodes, which connect just what the pairs of near fingerprints connect; none is left out.

    Rows are dealt to cells of about `most` by hash, and every cell meets every
    cell, itself too, in a task of its own.  The number of cells says how the
    work is dealt out, and nothing about what is found: all pairs meet once.
    """
    cells = max(LEAST_CELLS, -(-n // most))
    dealt = distinct.select("f1", "f2", "node", F.pmod(F.xxhash64("f1", "f2"), F.lit(cells)).alias("cell"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    low, high = F.least("cell", "other"), F.greatest("cell", "other")
    side = F.when(F.col("cell") == F.col("other"), 2).when(F.col("cell") < F.col("other"), 0).otherwise(1)
    rows = dealt.select("f1", "f2", "node", (F.shiftright(high * (high + 1), 1) + low).cast("int").alias("pair"), side.alias("side"))
    return rows.repartitionById(cells * (cells + 1) // 2, "pair").mapInArrow(_met, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes with an edge (a, b), root being the smallest: large and small stars in turn."""
    def tally(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = tally(e)
    while before[0]:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(least.select("a", F.col("m").alias("b")))
        e = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        after = tally(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _grouped(docs: DataFrame, nameless: bool = False) -> DataFrame:
    """doc_id, th (hash of the text), root, group_id, n_links of every row; all but doc_id and th null where there is no fingerprint.

    Rows with a null doc_id are grouped only if `nameless`.
    """

    def prints(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            for i, j in batches(b.column("text"), 500_000):
                p, count = fingerprints(b.column("text").slice(i, j - i))
                none = count == 0
                p = p.view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("th").slice(i, j - i), pa.array(p[:, 0], mask=none), pa.array(p[:, 1], mask=none)], names=["doc_id", "th", "f1", "f2"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    marks = written(texts.mapInArrow(prints, f"doc_id {kind}, th bigint, f1 bigint, f2 bigint"), "fingerprints")
    known = F.lit(True) if nameless else F.col("doc_id").isNotNull()
    distinct = marks.where(known & F.col("f1").isNotNull()).groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    found = components(links(distinct, distinct.count()))
    named = written(distinct.join(found, "node", "left").select("f1", "f2", "id", "n", F.coalesce("root", "node").alias("root")), "named")
    of_group = named.groupBy("root").agg(F.min("id").alias("group_id"), (F.sum("n") - 1).alias("n_links"))
    named = named.select("f1", "f2", "root").join(of_group, "root")
    out = marks.join(named, ["f1", "f2"], "left")
    return out.select("doc_id", "th", *[F.when(known, F.col(c)).alias(c) for c in ("root", "group_id", "n_links")])


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, group_id, the smallest doc_id of the group, n_links, how many other rows it is linked with.

    A fingerprint is the 128-bit majority over a text's distinct words.  Equal
    fingerprints are one; the distinct ones meet by blocks of bits: pairs whose
    distances to a pivot differ by more than 20 can't be near and are discarded,
    the others are verified.  Groups are the connected components of all pairs
    at most 20 bits apart; no such pair is left out.

    Defined cases: texts that are null, empty or without words are near nothing,
    their group is their own doc_id, with no links; rows with a null doc_id
    aren't grouped, their group is null; repeated rows have one group; one doc_id
    with several texts belongs to the group of each; doc_id may have any type
    with an order; an empty table gives an empty result; other columns are not
    looked at.
    """
    return _grouped(docs).select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def keep_one(docs: DataFrame, nameless: bool = False) -> DataFrame:
    """One row of each group, with all columns, and the rows that are in none.

    It is the row with the smallest doc_id, of several with it that with the
    smallest hash of the text, then of the row.  Rows that `groups` finds near
    nothing because they have no words, and rows with a null doc_id, all stay,
    but of several with one doc_id and text one stays.  With `nameless`, rows
    with a null doc_id are in groups like others, and one of them is kept only
    where no row of the group has a doc_id; those without words all stay.
    """
    th, kept, kept_th, n = fresh(docs, "th", "kept", "kept_th", "n")
    marks = _grouped(docs, nameless)
    first = marks.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")).alias("m")).select("m.doc_id", "m.th")
    keep = first.unionAll(marks.where("root IS NULL").select("doc_id", "th").distinct()).where("doc_id IS NOT NULL").select(F.col("doc_id").alias(kept), F.col("th").alias(kept_th))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.xxhash64(*(c.cast("string") for c in columns))
    named = docs.where("doc_id IS NOT NULL").withColumn(th, F.xxhash64("text"))
    named = named.join(keep, (F.col("doc_id") == F.col(kept)) & (F.col(th) == F.col(kept_th)), "left_semi")
    out = named.withColumn(n, F.row_number().over(Window.partitionBy("doc_id", th).orderBy(order))).where(F.col(n) == 1).select(*columns)
    rest = docs.where("doc_id IS NULL")
    if nameless:
        rest = rest.withColumn(th, F.xxhash64("text"))
        met = marks.where("doc_id IS NULL AND root IS NOT NULL").select(F.col("th").alias(kept_th))
        best = first.where("doc_id IS NULL").select(F.col("th").alias(kept_th))
        same = F.col(th) == F.col(kept_th)
        one = rest.join(best, same, "left_semi").withColumn(n, F.row_number().over(Window.partitionBy(th).orderBy(order))).where(F.col(n) == 1)
        out, rest = out.unionAll(one.select(*columns)), rest.join(met, same, "left_anti")
    return out.unionAll(rest.select(*columns))
