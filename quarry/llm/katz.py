"""Katz backoff language model over all documents, and each document's score under it.

Documents are read once, in blocks of a few million characters, and written as a
table of word numbers.  The orders are then counted one after the other.  For
each order every block sends its distinct grams, with their counts, to buckets;
a bucket adds the counts up, keeps its part of the gram table, and answers each
block with the grams' counts in the corpus and their positions.

Positions lay out the buckets.  A gram's position is the number of occurrences
of grams before it in the table, so that a history occupies as long a stretch of
the line of all tokens as it has followers; order m + 1 is cut into stretches of
equal length.  A bucket holds whole histories but for its first and its last,
frequent histories span many buckets, and no bucket holds more than its stretch
of occurrences.  Since histories lie together, the backoff weights come from a
scan of the gram table; only the histories at the buckets' ends are added up.

Blocks meet buckets through a tree: with more blocks than `FAN`, groups of
blocks and ranges of buckets meet first, merge their counts, and pass them on,
and the answers take the way back.  So no task handles more rows than FAN, or
more grams than a block or a bucket, however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm.common import drop, saved, scratch, written
from quarry.llm.textvec import batches, mix, words
from quarry.llm.textvec import expand as expand_runs

#: Order of the registered model.
ORDER = 3
#: Counts up to this are discounted by Good and Turing's estimate.
K = 5
#: Share that larger counts give away, so that every history can back off.
RESERVE = 1e-4
#: Characters of a block, occurrences of grams in a bucket, and the most rows that meet in one task.
BLOCK_CHARS, BUCKET_TOKENS, FAN = 6_000_000, 1_000_000, 4096
#: Most passes over the buckets of an order, one after the other: what is on its way to the buckets takes that part of the disk.
PASSES = 4
END = np.uint64(0xD1B54A32D192ED03)

_TEXTS = "block bigint, counted boolean, ids array<{kind}>, lengths array<bigint>, words binary, ranks binary, n_words bigint, numbers binary, n_tokens bigint"
#: Of grams: how many, how many histories, and the packed columns.
_PACKED = "size bigint, heads bigint, buckets binary, h binary, runs binary, w binary, counts binary, suffix binary, below binary"
_MESSAGES = "g bigint, r bigint, sg bigint, sr bigint, " + _PACKED
_HISTORIES = "g bigint, r bigint, size bigint, h binary, below binary"
_COUNTED = f"kind string, g bigint, r bigint, part bigint, starts binary, word_ids binary, tally array<bigint>, {_PACKED}"
_ANSWER = ("g", "r", "part", "size", "counts", "starts", "word_ids", "buckets")


def squeeze(a: np.ndarray) -> bytes:
    """Integers as byte planes of the width that they need, compressed."""
    if not len(a):
        return b""
    top = int(a.max())
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    planes = np.ascontiguousarray(a.astype(f"<u{width}").view(np.uint8).reshape(len(a), width).T)
    return bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def expand(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    width = data[0]
    raw = pa.decompress(memoryview(data)[1:], n * width, codec="zstd")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(f"<u{width}").reshape(n).astype(np.uint64)


def squeeze_steps(a: np.ndarray) -> bytes:
    """Integers as their differences: small where they grow slowly."""
    return squeeze(np.diff(a.astype(np.uint64), prepend=np.uint64(0)))


def expand_steps(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(expand(data, n), dtype=np.uint64)


@dataclass
class Grams:
    """Distinct grams by bucket, history and word: local count, count of the suffix; in the gram table, count of the history's suffix.

    A history is its position in the table of one order less; of single words
    `h` is the hash, and `w` 0.
    """

    bucket: np.ndarray
    h: np.ndarray
    w: np.ndarray
    count: np.ndarray
    suffix: np.ndarray
    below: np.ndarray

    def heads(self) -> np.ndarray:
        """Where each history begins in each bucket."""
        new = np.ones(len(self.h), bool)
        new[1:] = (self.h[1:] != self.h[:-1]) | (self.bucket[1:] != self.bucket[:-1])
        return np.flatnonzero(new)

    def cut(self, a, z=None) -> Grams:
        s = a if z is None else slice(a, z)
        return Grams(self.bucket[s], self.h[s], self.w[s], self.count[s], self.suffix[s], self.below[s])

    def packed(self) -> dict:
        at = self.heads()
        runs = np.diff(np.append(at, len(self.h)))
        cols = (squeeze_steps(self.bucket), squeeze_steps(self.h[at]), squeeze(runs), squeeze(self.w), squeeze(self.count), squeeze(self.suffix), squeeze(self.below[at]))
        return {"size": len(self.h), "heads": len(at), **dict(zip(("buckets", "h", "runs", "w", "counts", "suffix", "below"), cols))}

    @staticmethod
    def unpacked(r: dict) -> Grams:
        n, heads = r["size"], r["heads"]
        runs = expand(r["runs"], heads).astype(np.int64)
        h, below = (np.repeat(x, runs) for x in (expand_steps(r["h"], heads), expand(r["below"], heads)))
        bucket, w, count, suffix = expand_steps(r["buckets"], n), expand(r["w"], n), expand(r["counts"], n), expand(r["suffix"], n)
        return Grams(bucket.astype(np.int64), h, w, count.astype(np.int64), suffix.astype(np.int64), below.astype(np.int64))

    @staticmethod
    def merged(rows: list[dict]) -> tuple[Grams, np.ndarray]:
        """The rows' grams as one, counts added up; and for each given gram the place it went to."""
        parts = [Grams.unpacked(r) for r in rows]

        def taken(name: str) -> np.ndarray:
            out = np.concatenate([getattr(p, name) for p in parts])
            for p in parts:
                setattr(p, name, None)
            return out

        bucket, h, w = taken("bucket"), taken("h"), taken("w")
        one_bucket = not len(bucket) or bucket[0] == bucket[-1] and bucket.min() == bucket.max()
        order = np.lexsort((w, h) if one_bucket else (w, h, bucket))
        h, w, bucket = h[order], w[order], bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1]) | (bucket[1:] != bucket[:-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        bucket, h, w = bucket[at], h[at], w[at]
        count = np.add.reduceat(taken("count")[order], at)
        suffix = np.maximum.reduceat(taken("suffix")[order], at)
        return Grams(bucket, h, w, count, suffix, np.zeros(len(at), np.int64)), place


def discounts(tally: np.ndarray) -> np.ndarray:
    """Factors for the counts 0 to K + 1 (all larger ones) from the numbers of grams seen 1 to K + 1 times."""
    n = tally.astype(float)
    out = np.full(K + 2, 1 - RESERVE)
    out[0] = 0
    good = None
    if (n[: K + 1] > 0).all():
        top = (K + 1) * n[K] / n[0]
        r = np.arange(1, K + 1)
        star = (r + 1) * n[1 : K + 1] / n[:K]
        good = (star / r - top) / (1 - top) if top < 1 else None
    if good is None or not ((good > 0) & (good < 1)).all():  # too few grams for the estimate: absolute discounting
        d = min(0.9, max(0.1, n[0] / max(1.0, n[0] + 2 * n[1])))
        good = (np.arange(1, K + 1) - d) / np.arange(1, K + 1)
    out[1 : K + 1] = good
    return out


@dataclass
class Numbers:
    """What all tasks need to know: the layout, and by order the discounts and the buckets' first positions.

    `base` has 8 bytes for every `stretch` tokens of the corpus, which bounds what
    goes to the driver and the executors: 60 MB for 1.5e13 tokens.
    """

    tokens: int
    stretch: int
    word_bits: int
    levels: int
    fan: int
    groups: int
    tasks: int
    factors: list[np.ndarray]
    base: list[np.ndarray]
    unknown: float = 0.0

    def share(self, m: int, count: np.ndarray) -> np.ndarray:
        """Discounted count of grams of order m."""
        return self.factors[m - 1][np.minimum(count, K + 1)] * count

    def node(self, level: int, group: np.ndarray | int, bucket: np.ndarray):
        """Node of the tree at a level, for a source's group and a gram's bucket; at the last level a node is a bucket."""
        return (0 if level == self.levels else group), bucket // self.fan ** (self.levels - level)


def texts_table(docs: DataFrame, counted: bool = True) -> tuple[DataFrame, str]:
    """The blocks of `docs`, and where their table is."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, ids, lengths, size = 0, [], [], [], 0
        part = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            nonlocal number, held, ids, lengths, size
            h = np.concatenate(held)
            keys, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")  # frequent words get small numbers
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            row = {
                "block": pa.array([((part << 24) + number) * 2 + (not counted)]),
                "counted": pa.array([counted]),
                "ids": pa.ListArray.from_arrays(pa.array([0, sum(map(len, ids))], pa.int32()), pa.concat_arrays(ids)),
                "lengths": pa.array([np.concatenate(lengths)], pa.list_(pa.int64())),
                "words": pa.array([squeeze_steps(keys)], pa.binary()),
                "ranks": pa.array([squeeze(order)], pa.binary()),
                "n_words": pa.array([len(keys)]),
                "numbers": pa.array([squeeze(place[inverse])], pa.binary()),
                "n_tokens": pa.array([len(h)]),
            }
            number, held, ids, lengths, size = number + 1, [], [], [], 0
            return pa.RecordBatch.from_pydict(row)

        for b in given:
            for i, j in batches(b.column("text")):
                text = b.column("text").slice(i, j - i)
                h, owner, _, _ = words(text)
                count = np.bincount(owner, minlength=j - i)
                closed = np.where(count > 0, count + 1, 0)
                tokens = np.full(int(closed.sum()), END)
                begin = np.cumsum(closed) - closed
                tokens[begin[owner] + np.arange(len(h)) - (np.cumsum(count) - count)[owner]] = h
                held.append(tokens)
                ids.append(b.column("doc_id").slice(i, j - i))
                lengths.append(closed)
                size += text.nbytes
                if size >= BLOCK_CHARS:
                    yield flush()
        if ids:
            yield flush()

    path = scratch(docs.sparkSession, "texts")
    return saved(docs.select("doc_id", "text").mapInArrow(run, _TEXTS.format(kind=kind)), path), path


@dataclass
class Opened:
    """A block's tokens, each document closed by an end mark, and what is known of its distinct grams by order."""

    lengths: np.ndarray
    owner: np.ndarray
    grams: list[Grams]  # in the order in which they are sent
    gram: list[np.ndarray]  # which gram (numbered locally) ends at each token, -1 for none that can be in the corpus
    counts: list[np.ndarray]  # corpus counts of the local numbers
    starts: list[np.ndarray]


def _opened(row: dict, answers: list[dict], num: Numbers, order: int) -> Opened:
    """The block as far as `order`; answers must be there for the orders before."""
    lengths = np.array(row["lengths"], np.int64)
    t, n_words = row["n_tokens"], row["n_words"]
    by_rank = expand(row["ranks"], n_words).astype(np.int64)
    token = by_rank[expand(row["numbers"], t).astype(np.int64)]
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    since = (np.arange(t) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
    o = Opened(lengths, owner, [], [], [], [])
    word_ids = np.zeros(n_words, np.uint64)
    for m in range(1, order + 1):
        if m == 1:
            zero = np.zeros(n_words, np.int64)
            first = sorted((r for r in answers if r["n"] == 1), key=lambda r: r["part"])
            if first:  # the words themselves aren't needed any more
                keys = zero.astype(np.uint64)
                bucket = np.concatenate([expand(r["buckets"], r["size"]) for r in first]).astype(np.int64)
            else:
                keys = expand_steps(row["words"], n_words)
                bucket = (keys >> np.uint64(64 - num.word_bits)).astype(np.int64) if num.word_bits else zero
            sent = np.arange(n_words)
            grams = Grams(bucket, keys, zero.astype(np.uint64), np.bincount(token, minlength=n_words), zero, zero)
            gram = token
        else:
            before, shorter = o.gram[-1], o.counts[-1]
            real = np.flatnonzero(since >= m - 1)
            hist = before[real - 1]
            alive = (hist >= 0) & (o.counts[0][token[real]] > 0)
            alive &= shorter[hist] > 0
            real, hist = real[alive], hist[alive]
            _, first, inverse, count = np.unique(hist.astype(np.int64) * n_words + token[real], return_index=True, return_inverse=True, return_counts=True)
            gram = np.full(t, -1, np.int32)
            gram[real] = inverse
            hist, first = hist[first], real[first]
            del real, alive, inverse
            h, w, c = o.starts[-1][hist], word_ids[token[first]], shorter[hist]
            inside = (mix(w + np.uint64(1)) >> np.uint64(11)).astype(float) * 2.0**-53  # spreads a history's followers over its stretch
            bucket = (h.astype(np.int64) + np.minimum((inside * c).astype(np.int64), np.maximum(c - 1, 0))) // num.stretch
            sent = np.lexsort((w, h, bucket))
            suffix = np.where(before[first] >= 0, shorter[before[first]], 0)
            grams = Grams(bucket, h, w, count, suffix, np.zeros(len(first), np.int64)).cut(sent)
        if not row["counted"]:
            grams.count = np.zeros_like(grams.count)
        o.grams.append(grams)
        o.gram.append(gram)
        own = sorted((r for r in answers if r["n"] == m), key=lambda r: r["part"])
        if own or not len(sent):
            counts, starts = np.zeros(len(sent), np.int64), np.zeros(len(sent), np.uint64)
            if own:
                counts[sent] = np.concatenate([expand(r["counts"], r["size"]) for r in own])
            if own and own[0]["starts"] is not None:
                starts[sent] = np.concatenate([expand_steps(r["starts"], r["size"]) for r in own]) + num.base[m - 1][grams.bucket].astype(np.uint64)
            o.counts.append(counts)
            o.starts.append(starts)
            if m == 1 and own:
                word_ids = np.concatenate([expand(r["word_ids"], r["size"]) for r in own])
    return o


def _table(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields})


def _split(grams: Grams, num: Numbers, level: int, group: int, source: tuple[int, int]) -> list[dict]:
    """Rows for the nodes of a level."""
    g, r = num.node(level, group, grams.bucket)
    found, begin = np.unique(r, return_index=True)
    ends = np.append(begin, len(r))
    return [{"g": g, "r": int(x), "sg": source[0], "sr": source[1], **grams.cut(a, z).packed()} for x, a, z in zip(found, ends[:-1], ends[1:])]


def _send(num: Numbers, order: int):
    """Rows with a block's grams of an order for the first level of the tree."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _table([], _MESSAGES)
        row = texts.to_pylist()[0]
        o = _opened(row, answers.to_pylist(), num, order)
        group = int(mix(np.array([row["block"]], np.uint64))[0] % np.uint64(num.groups))
        return _table(_split(o.grams[-1], num, 1, group, (row["block"], 0)), _MESSAGES)

    return run


def _merge(num: Numbers, level: int):
    """What a node of the tree passes on to the next level."""

    def run(t: pa.Table) -> pa.Table:
        g, r = t["g"][0].as_py(), t["r"][0].as_py()
        grams, _ = Grams.merged(_in_order(t))
        return _table(_split(grams, num, level + 1, g // num.fan, (g, r)), _MESSAGES)

    return run


def _in_order(t: pa.Table) -> list[dict]:
    return sorted(t.to_pylist(), key=lambda r: (r["sg"], r["sr"]))


def _answers(rows: list[dict], place: np.ndarray, part: int, **values: np.ndarray) -> list[dict]:
    out, at = [], 0
    for r in rows:
        p = place[at : at + r["size"]]
        at += r["size"]
        pack = {k: (squeeze_steps if k == "starts" else squeeze)(v[p]) for k, v in values.items()}
        out.append({"kind": "answer", "g": r["sg"], "r": r["sr"], "part": part, "size": r["size"], **pack})
    return out


def _route(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """Answers that a node of the tree has got, for each of those who asked it."""
    if not rows.num_rows:
        return _table([], _COUNTED)
    asked = _in_order(rows)
    _, place = Grams.merged(asked)
    got = sorted(answers.to_pylist(), key=lambda r: r["part"])
    values = {k: np.concatenate([f(r[k], r["size"]) for r in got]) for k, f in (("counts", expand), ("starts", expand_steps), ("word_ids", expand), ("buckets", expand)) if got[0][k] is not None}
    return _table(_answers(asked, place, asked[0]["r"], **values), _COUNTED)


def _histories(num: Numbers, order: int):
    """From the table of the order before: the count of each gram's suffix, for the buckets whose histories it is in."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            for row in b.to_pylist():
                grams = Grams.unpacked(row)
                start = num.base[order - 2][row["r"]] + np.cumsum(grams.count) - grams.count
                first, last = start // num.stretch, (start + grams.count - 1) // num.stretch
                at, step = expand_runs(last - first + 1)
                bucket = first[at] + step
                order_ = np.lexsort((start[at], bucket))
                at, bucket = at[order_], bucket[order_]
                found, begin = np.unique(bucket, return_index=True)
                rows = [{"g": 0, "r": int(r), "size": z - a, "h": squeeze_steps(start[at[a:z]]), "below": squeeze(grams.suffix[at[a:z]])} for r, a, z in zip(found, begin, np.append(begin[1:], len(at)).tolist())]
                yield from _table(rows, _HISTORIES).to_batches()

    return run


def _add_up(num: Numbers, order: int, last: bool):
    """Counts of a bucket's grams over all blocks: answers, and the bucket's part of the gram table."""

    def run(t: pa.Table, histories: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _table([], _COUNTED)
        bucket, rows = t["r"][0].as_py(), _in_order(t)
        grams, place = Grams.merged(rows)
        if order == 2:
            grams.below = np.full(len(grams.h), num.tokens)
        elif order > 2:
            known = histories.to_pylist()
            h = np.concatenate([expand_steps(r["h"], r["size"]) for r in known] or [grams.h[:0]])
            below = np.concatenate([expand(r["below"], r["size"]) for r in known] or [grams.h[:0]]).astype(np.int64)
            by = np.argsort(h, kind="stable")
            if len(by):
                grams.below = below[by[np.minimum(np.searchsorted(h[by], grams.h), len(by) - 1)]]
        total = grams.count
        values = {"counts": total.astype(np.uint64)}
        if not last:
            values["starts"] = (np.cumsum(total) - total).astype(np.uint64)
        if order == 1:  # frequent words get small numbers, the same whatever the blocks
            rank = np.empty(len(total), np.uint64)
            rank[np.lexsort((grams.h, -total))] = np.arange(len(total), dtype=np.uint64)
            values["buckets"] = grams.bucket.astype(np.uint64)
            values["word_ids"] = (rank << np.uint64(num.word_bits)) + np.uint64(bucket)
        out = _answers(rows, place, bucket, **values)
        seen = np.flatnonzero(total > 0)
        tally = np.bincount(np.minimum(total[seen], K + 2), minlength=K + 3)[1 : K + 2].tolist() + [int(total.sum())]
        return _table([*out, {"kind": "grams", "r": bucket, "tally": tally, **grams.cut(seen).packed()}], _COUNTED)

    return run


def _grouped(num: Numbers, df: DataFrame, *key: str):
    """`df` grouped, over as many tasks as its work needs: packed rows are small, so adaptive merging of tasks by bytes would leave few."""
    return df.repartition(num.tasks, *key).groupBy(*key)


def _asked(rows: DataFrame, histories: DataFrame, num: Numbers, order: int, last: bool, level: int = 1) -> DataFrame:
    """Answers to the sources of `rows`, and the gram table, through what is left of the tree."""
    if level == num.levels:
        return _grouped(num, rows, "g", "r").cogroup(_grouped(num, histories, "g", "r")).applyInArrow(_add_up(num, order, last), _COUNTED)
    rows = written(rows, f"rows{level}")
    onward = _grouped(num, rows, "g", "r").applyInArrow(_merge(num, level), _MESSAGES)
    found = written(_asked(onward, histories, num, order, last, level + 1), f"answers{level}", "kind").select(*[c.split()[0] for c in _COUNTED.split(", ")])
    answers = found.where("kind = 'answer'")
    return _grouped(num, rows, "g", "r").cogroup(_grouped(num, answers, "g", "r")).applyInArrow(_route, _COUNTED).unionByName(found.where("kind = 'grams'"))


def _evaluate(num: Numbers, order: int, id_type: pa.DataType, asks_only: bool = False):
    """Each token's probability: the longest seen gram's share, times the weights of the histories given up on the way.

    With `asks_only` the histories whose weights that takes.
    """

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        row = texts.to_pylist()[0]
        rows = answers.to_pylist()
        o = _opened(row, rows, num, order)
        n = len(o.owner)
        logp, open_ = np.zeros(n), np.ones(n, bool)
        asks = []
        for m in range(order, 0, -1):
            gram = o.gram[m - 1]
            seen = open_ & (gram >= 0)
            seen[seen] = o.counts[m - 1][gram[seen]] > 0
            at = np.flatnonzero(seen)
            below = num.tokens if m == 1 else o.counts[m - 2][o.gram[m - 2][at - 1]]
            logp[at] += np.log(num.share(m, o.counts[m - 1][gram[at]]) / below)
            open_[at] = False
            if m == 1:
                logp[open_] += math.log(max(num.unknown, 1e-300))
                break
            left = np.flatnonzero(open_)
            hist = o.gram[m - 2][left - 1]
            known = (left > 0) & (o.owner[left] == o.owner[left - 1]) & (hist >= 0)
            left, hist = left[known], hist[known]
            known = o.counts[m - 2][hist] > 0
            left, start = left[known], o.starts[m - 2][hist[known]].astype(np.int64)
            if asks_only:
                asks.append((m - 1, np.unique(start)))
                continue
            got = [r for r in rows if r["n"] == -(m - 1)]
            if got:
                key = np.concatenate([expand_steps(r["starts"], r["size"]) for r in got]).astype(np.int64)
                weight = np.concatenate([np.frombuffer(r["word_ids"], "<f8") for r in got])
                place = np.minimum(np.searchsorted(key, start), len(key) - 1)
                logp[left] += np.where(key[place] == start, weight[place], 0.0)
        if asks_only:
            return pa.table({"block": pa.array([row["block"]] * sum(len(a) for _, a in asks), pa.int64()), "n": pa.array([m for m, a in asks for _ in a], pa.int32()), "history": pa.array(np.concatenate([a for _, a in asks]) if asks else [], pa.int64())})
        n = len(o.lengths)
        total = np.bincount(o.owner, logp, n).astype(float)
        none = o.lengths == 0
        return pa.table(
            {
                "doc_id": texts["ids"].combine_chunks().flatten().cast(id_type),
                "n_tokens": pa.array(o.lengths),
                "log_prob": pa.array(total, mask=none),
                "perplexity": pa.array(np.exp(np.minimum(700, -total / np.maximum(o.lengths, 1))), mask=none),
            }
        )

    return run


def _sums(num: Numbers, order: int):
    """Per history of a bucket: what its followers take, what the shorter model gives them; its end histories apart."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            for row in b.to_pylist():
                if not row["size"]:  # all that asked here were others than the corpus
                    continue
                grams = Grams.unpacked(row)
                at = grams.heads()
                taken, seen = np.add.reduceat(num.share(order, grams.count), at), np.add.reduceat(grams.count, at)
                lower = np.add.reduceat(num.share(order - 1, grams.suffix) / grams.below, at)
                history, end = grams.h[at].astype(np.int64), np.zeros(len(at), bool)
                end[[0, -1]] = True
                for kind, mask in (("end", end), ("whole", ~end)):
                    for a in range(0, len(at), 500_000):
                        k = np.flatnonzero(mask[a : a + 500_000]) + a
                        cols = [pa.array([kind] * len(k), pa.string()), pa.array(history[k]), pa.array(taken[k]), pa.array(seen[k]), pa.array(lower[k])]
                        if kind == "whole":
                            cols[2:] = [pa.array(np.log(1 - taken[k] / seen[k]) - np.log(1 - lower[k])), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.float64())]
                        yield pa.RecordBatch.from_arrays(cols, names=["kind", "history", "value", "seen", "lower"])

    return run


def weights_of(grams: DataFrame, num: Numbers, order: int) -> DataFrame:
    """(history, weight): logarithms of the backoff weights of the histories of an order's grams, as a table."""
    parts = grams.mapInArrow(_sums(num, order), "kind string, history bigint, value double, seen bigint, lower double")
    parts = written(parts, f"weights{order - 1}", "kind")
    ends = parts.where("kind = 'end'").groupBy("history").agg((F.log(1 - F.sum("value") / F.sum("seen")) - F.log(1 - F.sum("lower"))).alias("weight"))
    return parts.where("kind = 'whole'").select("history", F.col("value").alias("weight")).unionAll(ends)


@dataclass
class Model:
    """The partitioned tables: texts by block; by order the grams (and answers to the blocks) by bucket; weights by history."""

    texts: DataFrame
    counted: list[DataFrame]
    weights: list[DataFrame]
    numbers: Numbers

    def grams(self, m: int) -> DataFrame:
        return self.counted[m - 1].where("kind = 'grams'")

    def answers(self, m: int) -> DataFrame:
        return self.counted[m - 1].where("kind = 'answer'").select(F.lit(m).alias("n"), *_ANSWER)


def train(docs: DataFrame, order: int = ORDER, bucket_tokens: int = BUCKET_TOKENS, fan: int = FAN, others: DataFrame | None = None) -> Model:
    """The model of `docs`; the blocks of `others` are answered too, but don't count."""
    texts, *paths = texts_table(docs)
    if others is not None:
        more, path = texts_table(others, False)
        texts, paths = texts.unionAll(more), [*paths, path]
    blocks, entries, tokens = texts.agg(F.count("*"), F.sum("n_words"), F.sum(F.when(F.col("counted"), F.col("n_tokens")))).first()
    tokens = max(1, tokens or 0)
    bits = max(0, math.ceil(math.log2(max(1, (entries or 0) / bucket_tokens))))
    widest = max(1, blocks, 1 << bits, -(-tokens // bucket_tokens))
    levels = max(1, math.ceil(math.log(widest) / math.log(fan) - 1e-9))
    fan = max(2, math.ceil(widest ** (1 / levels)))
    tasks = max(1, min(widest, max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), widest // 4)))
    num = Numbers(tokens, bucket_tokens, bits, levels, fan, max(1, -(-blocks // fan)), tasks, [], [])
    model = Model(texts, [], [], num)
    passes = max(1, min(PASSES, widest // (4 * texts.sparkSession.sparkContext.defaultParallelism)))  # each with work for all cores
    for m in range(1, order + 1):
        known = texts.sparkSession.createDataFrame([], "n int, g bigint, r bigint, part bigint, size bigint, counts binary, starts binary, word_ids binary, buckets binary")
        for k in range(1, m):
            known = known.unionAll(model.answers(k))
        rows = _grouped(num, texts, "block").cogroup(_grouped(num, known, "g")).applyInArrow(_send(num, m), _MESSAGES)
        histories = model.grams(m - 1).mapInArrow(_histories(num, m), _HISTORIES) if m > 2 else texts.sparkSession.createDataFrame([], _HISTORIES)
        width = num.node(1, 0, np.array([(1 << bits) if m == 1 else -(-tokens // bucket_tokens)]))[1][0] + 1
        path = scratch(texts.sparkSession, f"rows{m}")
        rows = saved(rows.withColumn("pass", F.expr(f"int(r * {passes} div {width})")), path, "pass")
        counted = None
        for k in range(passes):
            one = rows.where(F.col("pass") == k).drop("pass")
            known = histories.where(F.expr(f"int(r * {passes} div {width}) = {k}")) if num.levels == 1 else histories
            part = written(_asked(one, known, num, m, m == order), f"grams{m}", "kind")
            counted = part if counted is None else counted.unionAll(part)
        drop(texts.sparkSession, path)
        model.counted.append(counted)
        sizes = model.grams(m).select("r", F.get("tally", F.lit(K + 1)).alias("n")).toArrow()
        base = np.zeros((1 << bits) if m == 1 else -(-tokens // bucket_tokens) + 1, np.int64)
        base[sizes["r"].to_numpy()] = sizes["n"].to_numpy()
        num.base.append(np.cumsum(base) - base)
        tally = np.array(model.grams(m).agg(*[F.coalesce(F.sum(F.get("tally", F.lit(k))), F.lit(0)) for k in range(K + 2)]).first(), np.int64)
        num.factors.append(discounts(tally[: K + 1]))
        if m == 1:
            texts = model.texts = written(texts.withColumn("words", F.lit(None).cast("binary")), "texts")
            for p in paths:
                drop(texts.sparkSession, p)
            r = np.arange(1, K + 1)
            large = tally[K + 1] - (r * tally[:K]).sum()
            num.unknown = 1 - float((num.factors[0][1 : K + 1] * r * tally[:K]).sum() + num.factors[0][K + 1] * large) / tokens
        else:
            model.weights.append(weights_of(model.grams(m), num, m))
    return model


def _asked_weights(model: Model, texts: DataFrame, answers: DataFrame, order: int) -> DataFrame:
    """The weights that the blocks of `texts` need, a row per block and order with the histories sorted."""
    asks = _grouped(model.numbers, texts, "block").cogroup(_grouped(model.numbers, answers, "g")).applyInArrow(_evaluate(model.numbers, order, pa.null(), True), "block bigint, n int, history bigint")
    weights = None
    for m, w in enumerate(model.weights, 1):
        w = w.select(F.lit(m).alias("n"), "history", "weight")
        weights = w if weights is None else weights.unionAll(w)
    found = asks.join(weights, ["n", "history"]).select("block", "n", "history", "weight")

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("history")
        row = {"n": pa.array([-t["n"][0].as_py()], pa.int32()), "g": pa.array([t["block"][0].as_py()]), "r": pa.array([0]), "part": pa.array([0]), "size": pa.array([len(t)])}
        row |= {"counts": pa.nulls(1, pa.binary()), "buckets": pa.nulls(1, pa.binary()), "starts": pa.array([squeeze_steps(t["history"].to_numpy())], pa.binary()), "word_ids": pa.array([t["weight"].to_numpy().astype("<f8").tobytes()], pa.binary())}
        return pa.table(row)

    schema = "n int, g bigint, r bigint, part bigint, size bigint, counts binary, starts binary, word_ids binary, buckets binary"
    return found.groupBy("block", "n").applyInArrow(pack, schema)


def score(docs: DataFrame, order: int = ORDER, bucket_tokens: int = BUCKET_TOKENS, fan: int = FAN, corpus: DataFrame | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, log_prob, perplexity, under the model of all of them, or of `corpus`.

    Tokens are the lower-cased words and an end mark.  A gram of the highest
    order that is seen has its Good-Turing discounted share of its history, one
    seen once too; any other token has the history's backoff weight times its
    probability one order lower, down to single words, whose discounts leave a
    share to unknown ones.  Weights are such that each history's probabilities
    sum to one.  Where the corpus is too small for Good and Turing's estimate
    (some count up to 6 never occurs, or a factor falls outside 0 to 1), an
    absolute discount takes its place.  Words are 64-bit hashes.

    Defined cases: a null or empty text, or one without words, has 0 tokens and
    null log_prob and perplexity; a text of any length is scored whole, in one
    block; repeated rows count and are scored as often as they come; an empty
    table gives an empty result, and under an empty corpus every token has the
    unknown word's share, 1; doc_id may have any type; other columns are not
    looked at.
    """
    m = train(docs if corpus is None else corpus, order, bucket_tokens, fan, None if corpus is None else docs)
    field = docs.select("doc_id").schema[0].dataType
    answers = m.answers(1)
    for k in range(2, order + 1):
        answers = answers.unionAll(m.answers(k))
    texts = m.texts.where(F.col("counted") == F.lit(corpus is None))
    if corpus is not None and order > 1:  # of its own grams the corpus has seen all, so only others' back off
        answers = written(answers.where(F.col("g") % 2 == 1), "answers")
        answers = answers.unionAll(written(_asked_weights(m, texts, answers, order), "asked"))
    elif corpus is not None:
        answers = answers.where(F.col("g") % 2 == 1)
    schema = f"doc_id {field.simpleString()}, n_tokens bigint, log_prob double, perplexity double"
    return _grouped(m.numbers, texts, "block").cogroup(_grouped(m.numbers, answers, "g")).applyInArrow(_evaluate(m.numbers, order, to_arrow_type(field)), schema)
