"""Language identification in two steps: the family first, then the language within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import linear
from quarry.llm.common import written
from quarry.llm.textvec import LETTER, batches, classes, codepoints, mix, scatter

BITS = 15
#: At most so many labelled documents of each language are fitted to.
SAMPLE = 1_000
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "is"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ca", "ro"), "romance"),
    **dict.fromkeys(("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"), "slavic"),
}
UNKNOWN = "und"


@dataclass
class Model:
    """All machines' weights side by side: the families' first, then those of each family's languages."""

    families: list[str] = field(default_factory=list)
    languages: list[list[str]] = field(default_factory=list)
    pairs: list[list[tuple[int, int]]] = field(default_factory=list)  # the families', then each family's
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature and text of each gram: two, three or four characters, all but letters being one space.

    A text without letters has no grams.
    """
    cps, offsets = codepoints(texts, lower=True)
    letter = classes()[cps] == LETTER
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = letter.copy()  # a space stays only where it follows a letter of its text
    if len(keep):
        keep[1:] |= letter[:-1] & (owner[1:] == owner[:-1])
    h = np.where(letter, scatter()[cps], np.uint64(1))[keep]
    owner = owner[keep]
    out, own, h1 = [], [], h
    for n in (2, 3, 4):
        if len(h) <= 1:
            break
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h1[n - 1 :]
        same = owner[: len(h)] == owner[n - 1 :]
        out.append((mix(h[same]) >> np.uint64(64 - BITS)).astype(np.int32))
        own.append(owner[: len(h)][same])
    if not out:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(own)


def fit(features: list[np.ndarray], langs: list[str], families: dict[str, str]) -> Model:
    """Machines over gram frequencies, each divided by the root of its mean."""
    known = sorted(set(langs))
    if not known:
        return Model()
    index, value, total = [], [], np.zeros(1 << BITS)
    for f in features:
        u, c = np.unique(f, return_counts=True)
        index.append(u)
        value.append(c / max(1, len(f)))
        total[u] += value[-1]
    scale = 1 / np.sqrt(total / max(1, len(features)) + 1e-5)
    x = linear.Sparse(index, [v * scale[i] for i, v in zip(index, value)])
    family = np.array([families.get(s, s) for s in langs])
    names = sorted(set(family))
    pairs, w = linear.one_versus_one(x, np.array([names.index(f) for f in family]), 1 << BITS, cost=10.0)
    model = Model(names, [], [pairs])
    columns = [w]
    for name in names:
        own = [s for s in known if families.get(s, s) == name]
        rows = np.flatnonzero(family == name)
        sub = linear.Sparse([x.row(i)[0] for i in rows], [x.row(i)[1] for i in rows])
        pairs, w = linear.one_versus_one(sub, np.array([own.index(langs[i]) for i in rows]), 1 << BITS, cost=10.0)
        model.languages.append(own)
        model.pairs.append(pairs)
        columns.append(w)
    w = np.concatenate(columns, 1)
    model.weights, model.bias = (w[:-1] * scale[:, None]).astype(np.float32), w[-1]
    return model


def predict(model: Model, texts: pa.Array) -> tuple[list[str], list[str], np.ndarray]:
    """Family, language and smallest margin of the votes that chose them, for each text."""
    n = len(texts)
    if not model.families or not n:
        return [UNKNOWN] * n, [UNKNOWN] * n, np.zeros(n)
    f, own = grams(texts)
    count = np.bincount(own, minlength=n)
    margins = np.empty((n, model.weights.shape[1]))
    for k in range(model.weights.shape[1]):
        margins[:, k] = np.bincount(own, model.weights[:, k][f], n) / np.maximum(count, 1) + model.bias[k]
    width = len(model.pairs[0])
    top = linear.vote(margins[:, :width], model.pairs[0], len(model.families))

    def sure(m: np.ndarray, pairs: list[tuple[int, int]], chosen: np.ndarray) -> np.ndarray:
        out = np.full(len(m), np.inf)
        for k, p in enumerate(pairs):
            out = np.where(np.isin(chosen, p), np.minimum(out, np.abs(m[:, k])), out)
        return out

    margin, lang, at = sure(margins[:, :width], model.pairs[0], top), np.full(n, UNKNOWN, object), width
    for k, (own_langs, pairs) in enumerate(zip(model.languages, model.pairs[1:])):
        m = margins[:, at : at + len(pairs)]
        at += len(pairs)
        mine = top == k
        chosen = linear.vote(m[mine], pairs, len(own_langs))
        lang[mine] = np.array(own_langs, object)[chosen]
        margin[mine] = np.minimum(margin[mine], sure(m[mine], pairs, chosen))
    none = count == 0
    lang[none] = UNKNOWN
    family = np.where(none, UNKNOWN, np.array(model.families, object)[top])
    return family.tolist(), lang.tolist(), np.where(none | np.isinf(margin), 0.0, margin)


def train(docs: DataFrame, sample: int = SAMPLE, families: dict[str, str] = FAMILIES) -> Model:
    """A model from at most `sample` documents of each language that `lang` names, one text each."""
    named = docs.select("doc_id", "lang", "text").where("lang IS NOT NULL AND doc_id IS NOT NULL")
    ids = written(linear.bounded(named, sample, "doc_id", "lang").select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang")), "sampled")
    chosen = named.where("text IS NOT NULL").join(ids, (F.col("doc_id") == F.col("__id")) & (F.col("lang") == F.col("__lang")))
    chosen = linear.one_text(chosen, "doc_id", "lang")

    def features(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            for i, j in batches(b.column("text")):
                f, own = grams(b.column("text").slice(i, j - i))
                order = np.argsort(own, kind="stable")
                cut = np.searchsorted(own[order], np.arange(j - i + 1))
                f = f[order].astype("<u2")
                rows = [f[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("lang").slice(i, j - i), pa.array(rows, pa.binary())], names=["doc_id", "lang", "f"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    got = chosen.mapInArrow(features, f"doc_id {kind}, lang string, f binary").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    return fit([np.frombuffer(x, "<u2") for x in got["f"].to_pylist()], got["lang"].to_pylist(), families)


def identify(docs: DataFrame, sample: int = SAMPLE, families: dict[str, str] = FAMILIES) -> DataFrame:
    """One row per row of `docs`: doc_id, family, language, margin.

    One-versus-one linear support vector machines choose the family, others the
    language within it.  They are fitted to a bounded sample of the rows whose
    column lang isn't null, and applied to all whole texts.  A language that
    `families` lacks is a family of its own.

    Of two languages with as many pairs won the one with the larger sum of margins
    is chosen, then the first by name.

    Defined cases: a null or empty text, or one without letters, is "und" with
    margin 0; of the sampled doc_ids those with a null text are not fitted to, of
    several texts under one doc_id and language that with the smallest hash is;
    doc_id may have any type; without labelled rows all are "und"; with one language all texts
    with letters are that language, with margin 0; repeated rows give repeated
    rows; an empty table gives an empty result; other columns are not looked at.
    """
    model = train(docs, sample, families)

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            for i, j in batches(b.column("text")):
                family, lang, margin = predict(model, b.column("text").slice(i, j - i))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(family, pa.string()), pa.array(lang, pa.string()), pa.array(margin)], names=["doc_id", "family", "language", "margin"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, family string, language string, margin double")
