"""Toxicity and language identification: held-out accuracy on made-up corpora, and edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import langid, linear, toxicity
from quarry.llm.textvec import mix, scatter

SYLLABLES = {"en": "the ing tion er an re st ly".split(), "de": "sch ung der ein keit lich ge ver".split(), "fr": "eau le tre ment oi ou qu é".split(), "es": "ción ado la mente os ll ña ar".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) + ("." if rng.random() < 0.15 else "") for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(700):
        lang = rng.choice(list(SYLLABLES))
        text, toxic = prose(rng, lang, rng.randint(20, 120)), rng.random() < 0.3
        if toxic:
            words = text.split()
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["moron", "scum", "trash"]))
            text = " ".join(words)
        docs.append((i, text, lang, toxic))
        if i < 500:
            labels.append((i, 1, int(toxic if rng.random() > 0.02 else not toxic)))
    return docs, labels


def test_toxicity_on_unlabelled_documents(spark, corpus):
    docs, labels = corpus
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, score boolean")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(d, lab).collect()}
    assert len(got) == len(docs)
    held = [x for x in docs if x[0] >= 500]
    right = sum(got[i]["toxic"] == toxic for i, _, _, toxic in held)
    assert right >= 0.97 * len(held)
    inside = 0
    for i, text, _, toxic in held:
        for s in got[i]["offending"]:
            said = text[s["start"] : s["end"]]
            inside += any(w in said for w in ("moron", "scum", "trash"))
            assert 0 <= s["start"] < s["end"] <= len(text)
        assert bool(got[i]["offending"]) == got[i]["toxic"]
    assert inside >= 0.9 * sum(len(got[x[0]]["offending"]) for x in held)
    kept = {r["doc_id"] for r in toxicity.drop_toxic(d, lab).collect()}
    assert kept == {i for i, r in got.items() if not r["toxic"]}


def test_score_is_noisy_or():
    text = "bad words here. Very bad! fine\n\nnothing."
    model = toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), -2.0)
    f, s, own, start, end = toxicity.sentences(pa.array([text]))
    model.weights[f[s == 0]] = 0.3
    z = model.bias + np.bincount(s, model.weights[f], len(own))
    total, _ = toxicity._scores(model, pa.array([text]))
    assert total[0] == pytest.approx(1 - np.prod(1 - 1 / (1 + np.exp(-z))))
    assert [text[a:b].strip() for a, b in zip(start, end)] == ["bad words here.", "Very bad!", "fine", "nothing."]


def test_toxicity_edges(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "...", 1), (None, "moron", 1), (4, "word " * 200_000, 1), (4, "a", 1), (4, "a", 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    for lab in ([], [(4, 1)], [(4, 0), (77, 1), (None, 1), (3, None)]):
        got = toxicity.score(d, spark.createDataFrame(lab, "doc_id bigint, toxic int")).collect()
        assert len(got) == 7 and not any(r["toxic"] for r in got)
    lab = spark.createDataFrame([(4, 1), (1, 0)], "doc_id bigint, toxic int")
    assert toxicity.score(d.limit(0), lab).collect() == []
    assert toxicity.drop_toxic(d, lab).columns == d.columns and toxicity.drop_toxic(d.limit(0), lab).collect() == []


def test_languages_on_held_out_documents(spark, corpus):
    docs, _ = corpus
    d = spark.createDataFrame([(i, t, lang if i < 500 else None) for i, t, lang, _ in docs], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(d).collect()}
    held = [x for x in docs if x[0] >= 500]
    assert sum(got[i]["language"] == lang for i, _, lang, _ in held) >= 0.98 * len(held)
    assert all(got[i]["family"] == langid.FAMILIES[got[i]["language"]] for i, *_ in docs)


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 ?!", "en"), (None, "the thing", "en"), (5, "the thing " * 100_000, None), (5, "a", "xx"), (5, "a", "xx")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, family int")
    got = langid.identify(d).collect()
    assert len(got) == 7
    for r in got:
        if r["doc_id"] in (1, 2, 3):
            assert (r["family"], r["language"], r["margin"]) == ("und", "und", 0.0)
    none = langid.identify(spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")).collect()
    assert none[0]["language"] == "und"
    one = langid.identify(spark.createDataFrame([(1, "text here", "en"), (2, "other", None)], "doc_id bigint, text string, lang string")).collect()
    assert {r["language"] for r in one} == {"en"}
    assert langid.identify(d.limit(0)).collect() == []


def test_svm_separates_and_votes():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    y = np.where(x @ [1, -2, 0.5, 0] + 0.3 > 0, 1.0, -1.0)
    rows = linear.Sparse([np.arange(4)] * 300, list(x))
    w = linear.svm(rows, np.arange(300), y, 4, cost=10.0, epochs=60)
    assert (np.sign(x @ w[:4] + w[4]) == y).mean() > 0.97
    pairs = [(0, 1), (0, 2), (1, 2)]
    assert linear.vote(np.array([[1.0, 2.0, -1.0], [-1.0, -1.0, 2.0], [-1, 1, -1]]), pairs, 3).tolist()[:2] == [0, 1]


# -- brute-force versions: the same models, applied and fitted statement by statement ----------------


def test_toxicity_scores_equal_brute_force(spark, corpus):
    docs, labels = corpus
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id bigint, text string")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.train(d, lab)
    got = {r["doc_id"]: r for r in toxicity.score(d, lab).collect()}

    def features(word):  # the word, and its beginnings, each told from words alike
        out = toxicity.sentences(pa.array([word]))[0].tolist()
        assert len(out) == 1 + sum(len(word) > k for k in toxicity.PREFIXES)
        return out

    seen = {}
    for i, text, *_ in docs[::7]:
        clean, spans = 1.0, []
        for m in re.finditer(r"[^.!?\n]+[.!?\n]?", text):
            words = re.findall(r"[^\W_]+", m.group().lower())
            if not words:
                continue
            z = model.bias
            for w in words:
                if w not in seen:
                    seen[w] = features(w)
                z += sum(float(model.weights[f]) for f in seen[w])
            p = 1 / (1 + math.exp(-z))
            clean *= 1 - p
            spans.append((p, text[m.start() : m.end()].strip()))
        assert got[i]["score"] == pytest.approx(1 - clean, abs=1e-9)
        if got[i]["toxic"]:
            top = max(p for p, _ in spans)
            assert sorted(text[s["start"] : s["end"]].strip() for s in got[i]["offending"]) == sorted(x for p, x in spans if p >= 0.5 or p == top)


def test_noisy_or_fit_equals_plain_gradients():
    """The proximal steps of `fit`, written out by document, sentence and word."""
    rng = np.random.default_rng(3)
    n_docs, per_doc, words = 60, 3, 12
    toxic = rng.random(n_docs) < 0.4
    sentences = [[list(map(int, rng.choice(words - 1, 4, replace=False))) for _ in range(per_doc)] for _ in range(n_docs)]
    for k in range(n_docs):
        if toxic[k]:
            sentences[k][rng.integers(per_doc)][0] = words - 1
    flat = [s for d in sentences for s in d]
    f = np.array([w for s in flat for w in s])
    s = np.repeat(np.arange(len(flat)), 4)
    doc = np.repeat(np.arange(n_docs), per_doc)
    model = toxicity.fit(f, s, doc, toxic, rounds=25, spread=0.0)
    sums = np.bincount(s, np.random.default_rng(5).random(1 << toxicity.BITS)[f])
    held = np.zeros(words)
    for k in np.unique(sums, return_index=True)[1]:  # sentences alike count once
        for w in flat[k]:
            held[w] += 1
    w, bias = np.zeros(words), math.log(toxic.sum() / len(flat))
    for _ in range(25):
        grad, grad_bias = np.zeros(words), 0.0
        for k in range(n_docs):
            z = [bias + sum(w[x] for x in sent) for sent in sentences[k]]
            clean = math.prod(1 / (1 + math.exp(v)) for v in z)
            chance = 0.02 + 0.96 * (1 - clean)  # of the label toxic
            outer = -0.96 * clean / chance if toxic[k] else 0.96 * clean / (1 - chance)
            for v, sent in zip(z, sentences[k]):
                g = outer / (1 + math.exp(-v))
                grad_bias += g
                for x in sent:
                    grad[x] += g
        size = 1 / (0.1 * held + 2)
        w -= size * grad
        w = np.sign(w) * np.maximum(np.abs(w) - size * 0.3, 0)
        bias -= min(0.3, max(-0.3, grad_bias / toxic.sum()))
    assert model.weights[:words] == pytest.approx(w, abs=1e-4) and model.bias == pytest.approx(bias, abs=1e-6)
    assert w[words - 1] > 1


def test_language_equals_brute_force(spark, corpus):
    docs, _ = corpus
    d = spark.createDataFrame([(i, t, lang if i < 300 else None) for i, t, lang, _ in docs], "doc_id bigint, text string, lang string")
    model = langid.train(d)
    got = {r["doc_id"]: r for r in langid.identify(d).collect()}
    codes, top = scatter(), 2**64

    def feature(gram):
        h = 0
        for k, c in enumerate(gram):
            v = int(codes[ord(c)]) if c != " " else 1
            h = (h * 0x9E3779B97F4A7C15 + v) % top if k else v
        return int(mix(np.array([h], np.uint64))[0] >> np.uint64(64 - langid.BITS))

    def chosen(margins, pairs, names):
        won, sums = Counter(), Counter()
        for (a, b), m in zip(pairs, margins):
            won[a if m >= 0 else b] += 1
            sums[a] += math.tanh(m)
            sums[b] -= math.tanh(m)
        return names[max(range(len(names)), key=lambda k: (round(won[k] + 1e-3 * sums[k], 12), -k))]

    known = {}
    for i, text, *_ in docs[::9]:
        t = re.sub(r"[^a-zà-ÿ]+", " ", text.lower()).lstrip(" ")
        grams = [t[k : k + n] for n in (2, 3, 4) for k in range(len(t) - n + 1)]
        features = [known.setdefault(g, None) or known.__setitem__(g, feature(g)) or known[g] for g in grams]
        margins = [sum(float(model.weights[f, k]) for f in features) / len(features) + model.bias[k] for k in range(model.weights.shape[1])]
        family = chosen(margins, model.pairs[0], model.families)
        at, lang = len(model.pairs[0]), None
        for name, langs, pairs in zip(model.families, model.languages, model.pairs[1:]):
            if name == family:
                lang = chosen(margins[at : at + len(pairs)], pairs, langs)
            at += len(pairs)
        assert (got[i]["family"], got[i]["language"]) == (family, lang)


def test_samples_are_bounded_in_rows(spark):
    """One doc_id repeated many times, with several texts, takes one place of the sample."""
    rows = spark.createDataFrame([(i % 50 if i < 2000 else 7, "xy"[i % 2]) for i in range(6000)], "k bigint, g string").repartition(5)
    assert linear.bounded(rows, 20, "k").count() == 20
    by = Counter(r["g"] for r in linear.bounded(rows, 20, "k", "g").collect())
    assert by == {"x": 20, "y": 20}
    assert linear.bounded(rows, 10_000, "k").count() == 50 and linear.bounded(rows.limit(0), 5, "k").count() == 0
    texts = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, None), (3, "c")], "k bigint, text string")
    assert sorted(r["k"] for r in linear.one_text(texts, "k").collect()) == [1, 2, 3]
