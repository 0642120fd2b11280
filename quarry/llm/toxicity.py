"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written
from quarry.llm.linear import bounded, one_text
from quarry.llm.textvec import batches, codepoints, span_hash, words_of

BITS = 18
#: Besides each word, its beginnings of these lengths are features: a stem counts whatever its ending.
PREFIXES = (4, 5, 6, 7)
#: At most so many labelled documents, one text each, are fitted to.
SAMPLE = 4_000
_ENDS = np.array([ord(c) for c in ".!?\n…。！？"], np.uint32)


@dataclass
class Model:
    """Weight of each hashed word, the sentences' bias, and the document score from which a document is toxic."""

    weights: np.ndarray
    bias: float
    threshold: float = 0.5


def sentences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per feature (a word or its beginning) its hash and sentence; per sentence its text, start and end.

    A sentence ends with . ! ? or a line end; stretches without words are none.
    Starts and ends count code points of the text.
    """
    cps, offsets = codepoints(texts, lower=True)
    hashes, owner, starts, ends = words_of(cps, offsets)
    marks = np.flatnonzero(np.isin(cps, _ENDS))
    piece = np.searchsorted(marks, starts)
    new = np.ones(len(piece), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(piece))[: len(first)] - 1
    own = owner[first]
    stop = np.append(marks, len(cps))[piece[first]] + 1
    stop = np.maximum(ends[last], np.minimum(stop, offsets[own + 1])) if len(first) else first
    at = np.cumsum(new) - 1
    found, where = [hashes], [at]
    for n in PREFIXES:
        longer = ends - starts > n
        found.append(span_hash(cps, starts[longer], starts[longer] + n) ^ np.uint64(n << 50))
        where.append(at[longer])
    order = np.argsort(np.concatenate(where), kind="stable")
    feature = (np.concatenate(found)[order] >> np.uint64(64 - BITS)).astype(np.int64)
    return feature, np.concatenate(where)[order], own, starts[first] - offsets[own], stop - offsets[own]


def _sums(x: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(group, x, n).astype(float)


def fit(feature: np.ndarray, sentence: np.ndarray, doc: np.ndarray, toxic: np.ndarray, rounds: int = 200, noise: float = 0.02, penalty: float = 0.3, spread: float = 5.0) -> Model:
    """Noisy-or over sentences, fitted to documents' labels by proximal gradients.

    feature, sentence: per feature found; doc: per sentence; toxic: per document.  A
    document is clean with the product of its sentences' chances of being clean.
    A label is wrong with the chance `noise`, which bounds the pull of toxic
    documents that nothing explains.  Only words whose share of sentences of
    toxic documents (equal sentences, as in copies, counted once) is `spread`
    standard deviations from that of all get a weight, since the rest would only
    learn wrong labels by heart; the L1 penalty draws weights to 0, and
    steps are divided by the sentences a word is in.
    """
    n, m = len(toxic), len(doc)
    values = np.random.default_rng(5).random(1 << BITS)
    _, once = np.unique(_sums(values[feature], sentence, m), return_index=True)  # equal sentences, equal sums
    bad, good = np.zeros(m, bool), np.zeros(m, bool)
    bad[once], good[once] = toxic[doc[once]], ~toxic[doc[once]]
    in_toxic = np.bincount(feature[bad[sentence]], minlength=1 << BITS)
    held = in_toxic + np.bincount(feature[good[sentence]], minlength=1 << BITS)
    bad = bad[once]
    share = bad.mean() if len(bad) else 0.5
    z = np.abs(in_toxic - share * held) / np.sqrt(np.maximum(held, 1) * max(1e-9, share * (1 - share)))
    known = np.flatnonzero(z >= spread)
    place = np.full(1 << BITS, -1, np.int64)
    place[known] = np.arange(len(known))
    keep = (place >= 0)[feature]
    f, s = place[feature[keep]], sentence[keep]
    size = 1.0 / (0.1 * held[known] + 2.0)
    w, bias = np.zeros(len(known)), float(np.log(max(1, toxic.sum()) / max(1, m)))
    for _ in range(rounds):
        z = bias + _sums(w[f], s, m)
        clean = np.exp(-_sums(np.logaddexp(0, z), doc, n))
        pull = (1 - 2 * noise) * clean / np.where(toxic, -(noise + (1 - 2 * noise) * (1 - clean)), noise + (1 - 2 * noise) * clean)
        g = pull[doc] / (1 + np.exp(-np.clip(z, -50, 50)))
        w -= size * np.bincount(f, g[s], len(known))
        w = np.sign(w) * np.maximum(np.abs(w) - size * penalty, 0)
        bias -= np.clip(g.sum() / max(1.0, toxic.sum()), -0.3, 0.3)
    weights = np.zeros(1 << BITS, np.float32)
    weights[known] = w
    return Model(weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from a bounded sample of the labelled documents, or None without labels of both kinds.

    At most `sample` doc_ids are drawn, and one text is taken for each: of several the one with the smallest hash.
    """
    lab = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").alias("__id"), "toxic")
    ids = bounded(lab, sample, "__id")
    lab = written(lab.join(ids, "__id").groupBy("__id").agg((F.max("toxic") > 0).alias("y")), "labels")
    named = docs.select("doc_id", "text").where("text IS NOT NULL").join(lab, F.col("doc_id") == F.col("__id"))
    named = one_text(named, "doc_id", "y")

    def features(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            for i, j in batches(b.column("text")):
                f, s, own, _, _ = sentences(b.column("text").slice(i, j - i))
                doc = own[s] if len(s) else s
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                rows = [(f[a:z].astype("<i4").tobytes(), (s[a:z] - (s[a] if z > a else 0)).astype("<i4").tobytes()) for a, z in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), b.column("y").slice(i, j - i), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                    names=["doc_id", "y", "f", "s"],
                )

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    got = named.select("doc_id", "text", "y").mapInArrow(features, f"doc_id {kind}, y boolean, f binary, s binary").toArrow()
    got = got.sort_by("doc_id")
    _, first = np.unique(np.array([hash((f.as_py(), s.as_py())) for f, s in zip(got["f"], got["s"])], np.int64), return_index=True)
    got = got.take(pa.array(np.sort(first))).combine_chunks()  # a text repeated many times counts once
    toxic = np.array(got["y"].to_pylist(), bool)
    if toxic.all() or not toxic.any():
        return None
    f, s = (_joined(got[c]) for c in ("f", "s"))
    words = np.array([len(x.as_buffer()) // 4 for x in got["f"]], np.int64)
    del got
    last = np.cumsum(words) - 1
    counts = np.where(words > 0, s[np.maximum(last, 0)] + 1 if len(s) else 0, 0)
    s = s + np.repeat(np.cumsum(counts) - counts, words).astype(np.int32)
    return fit(f, s, np.repeat(np.arange(len(toxic)), counts), toxic)


def _joined(binaries: pa.ChunkedArray) -> np.ndarray:
    """All values end to end, as 32-bit integers."""
    a = pa.concat_arrays(binaries.chunks)
    offsets = np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, a.offset * 4)
    return np.frombuffer(a.buffers()[2] or b"", "<i4", (offsets[-1] - offsets[0]) // 4, offsets[0])


def _scores(model: Model | None, texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Score of each text; text, start, end and score of the sentences that offend."""
    n = len(texts)
    if model is None:
        return np.zeros(n), [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
    f, s, own, start, end = sentences(texts)
    z = model.bias + _sums(model.weights[f], s, len(own))
    total = _sums(np.logaddexp(0, z), own, n)
    score = -np.expm1(-total)
    top = np.full(n, -np.inf)
    np.maximum.at(top, own, z)
    bad = (score[own] >= model.threshold) & ((z >= 0) | (z == top[own]))
    return score, [own[bad], start[bad], end[bad], 1 / (1 + np.exp(-z[bad]))]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of `docs`: doc_id, score, toxic, offending.

    The score is the noisy-or of the sentences' scores: one minus the product of
    their chances of being clean.  From 0.5 a document is toxic, and `offending`
    lists start, end (code points) and score of its sentences that score 0.5 or,
    failing any, the highest.

    Defined cases: a null or empty text, or one without words, scores 0; without
    labels of both kinds there is nothing to learn from and all score 0; labels
    that are null or of unknown documents are left out, of several for one
    document the toxic one counts; of several texts under one labelled doc_id one
    is fitted to, that with the smallest hash; repeated rows give repeated rows;
    an empty table gives an empty result; doc_id may have any type; other columns
    are not looked at.
    """
    model = train(docs, labels, sample)

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            for i, j in batches(b.column("text")):
                scores, (own, start, end, p) = _scores(model, b.column("text").slice(i, j - i))
                lists = np.searchsorted(own, np.arange(j - i + 1))
                spans = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(p)], fields=list(_SPANS.value_type))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array(scores), pa.array(scores >= 0.5), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), spans)],
                    names=["doc_id", "score", "toxic", "offending"],
                )

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, toxic boolean, offending array<struct<start:int,end:int,score:double>>")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that aren't toxic, with all columns; cases as in `score`."""
    model = train(docs, labels, sample)
    at = docs.columns.index("text")

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            clean = [_scores(model, b.column(at).slice(i, j - i))[0] < 0.5 for i, j in batches(b.column(at))]
            yield b.filter(pa.array(np.concatenate(clean))) if clean else b

    return docs.mapInArrow(run, docs.schema)
