"""The distributed model against dictionaries."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import katz


DOCS = [
    (1, "the cat sat on the mat. The cat sat!"),
    (2, "the dog sat on the log"),
    (3, None),
    (4, ""),
    (5, "?!"),
    (6, "the cat sat on the mat. The cat sat!"),
    (7, "a cat and a dog and a cat " * 40),
    (8, "on the mat"),
]


def brute(texts, order):
    """Counts of all orders, discounts, and a function for the log probability of a word after others."""
    docs = [re.findall(r"\w+", t.lower()) + ["</s>"] for t in texts if t and re.search(r"\w", t)]
    counts = [Counter(tuple(d[i : i + m]) for d in docs for i in range(len(d) - m + 1)) for m in range(1, order + 1)]
    total = sum(counts[0].values())
    factors = []
    for c in counts:
        seen = Counter(c.values())
        factors.append(katz.discounts(__import__("numpy").array([seen[r] for r in range(1, katz.K + 2)])))
    cut = [1] * order

    def share(g):
        c = counts[len(g) - 1][g]
        return factors[len(g) - 1][min(c, katz.K + 1)] * c / (counts[len(g) - 2][g[:-1]] if len(g) > 1 else total)

    followers = {}
    for m in range(1, order):
        for g, c in counts[m].items():
            if c >= cut[m]:
                followers.setdefault(g[:-1], []).append(g)

    def weight(h):
        kept = followers.get(h, [])
        return (1 - sum(map(share, kept))) / (1 - sum(p(g[-1], h[1:]) for g in kept))

    def p(w, h):
        g = (*h, w)
        if counts[len(g) - 1][g] >= cut[len(g) - 1]:
            return share(g)
        if not h:
            return 0.0
        return (weight(h) if counts[len(h) - 1][h] else 1.0) * p(w, h[1:])

    return docs, counts, p


@pytest.mark.parametrize("order, fan", [(1, 4096), (3, 4096), (3, 4)])
def test_scores_equal_brute_force(spark, order, fan):
    rows = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in katz.score(rows.repartition(3), order, bucket_tokens=25, fan=fan).collect()}
    _, _, p = brute([t for _, t in DOCS], order)
    assert len(got) == len(DOCS)
    for i, text in DOCS:
        words = re.findall(r"\w+", (text or "").lower())
        if not words:
            assert got[i]["n_tokens"] == 0 and got[i]["log_prob"] is None and got[i]["perplexity"] is None
            continue
        words.append("</s>")
        expected = sum(math.log(p(w, tuple(words[max(0, k - order + 1) : k]))) for k, w in enumerate(words))
        assert got[i]["n_tokens"] == len(words)
        assert got[i]["log_prob"] == pytest.approx(expected, rel=1e-9)
        assert got[i]["perplexity"] == pytest.approx(math.exp(-expected / len(words)), rel=1e-9)


def stored(model, order):
    """The stored tables as dictionaries: words by id, counts of grams, weights of histories."""
    base = model.numbers.base
    vocabulary, by_start = {}, {}
    tables = []
    for m in range(1, order + 1):
        table, starts = {}, {}
        for r in model.grams(m).collect():
            g = katz.Grams.unpacked(r.asDict())
            at = base[m - 1][r["r"]] + np.cumsum(g.count) - g.count
            if m == 1:
                rank = np.empty(len(g.h), np.int64)
                rank[np.lexsort((g.h, -g.count))] = np.arange(len(g.h))
                names = [(int(x),) for x in (rank << model.numbers.word_bits) + r["r"]]
            else:
                names = [(*by_start[int(h)], int(w)) for h, w in zip(g.h, g.w)]
            for name, start, count in zip(names, at.tolist(), g.count.tolist()):
                assert name not in table
                table[name], starts[start] = count, name
            if m == 1:
                vocabulary |= {int(h): name for h, name in zip(g.h, names)}
        weights = {}
        if m > 1:
            weights = {by_start[r["history"]]: r["weight"] for r in model.weights[m - 2].collect()}
        by_start = starts
        tables.append((table, weights))
    return vocabulary, tables


@pytest.mark.parametrize("order, fan", [(2, 4096), (3, 3)])
def test_stored_weights_sum_to_one(spark, order, fan):
    """Every history's probabilities over all words and the unknown one, from the stored counts and weights alone."""
    rows = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    model = katz.train(rows.repartition(2), order, bucket_tokens=25, fan=fan)
    _, counts, _ = brute([t for _, t in DOCS], order)
    vocabulary, tables = stored(model, order)
    num = model.numbers
    for m in range(1, order + 1):
        assert sorted(tables[m - 1][0].values()) == sorted(counts[m - 1].values())

    def p(w, h):
        if not h:
            return num.unknown if w is None else float(num.share(1, tables[0][0][(w,)])) / num.tokens
        table, weights = tables[len(h)]
        c = table.get((*h, w), 0)
        if c:
            return float(num.share(len(h) + 1, c)) / tables[len(h) - 1][0][h]
        return math.exp(weights.get(h, 0.0)) * p(w, h[1:])

    every = [g[0] for g in tables[0][0]] + [None]
    assert sum(p(w, ()) for w in every) == pytest.approx(1, abs=1e-9)
    seen = 0
    for m in range(2, order + 1):
        assert set(tables[m - 1][1]) == {g[:-1] for g in tables[m - 1][0]}
        for h in tables[m - 1][1]:
            assert sum(p(w, h) for w in every) == pytest.approx(1, abs=1e-9)
            seen += 1
    assert seen > 5


@pytest.mark.parametrize("fan", [4096, 2])
def test_other_texts_back_off(spark, fan):
    """Texts outside the corpus: unseen trigrams, bigrams and words, against dictionaries."""
    order = 3
    others = [(1, "the cat sat on the log"), (2, "a dog and the mat and a cat sat"), (3, "zebra cat the zebra sat on zebra"), (4, None), (5, "mat mat mat"), (6, "cat")]
    rows = spark.createDataFrame(DOCS, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r for r in katz.score(spark.createDataFrame(others, "doc_id int, text string"), order, bucket_tokens=25, fan=fan, corpus=rows).collect()}
    _, counts, p = brute([t for _, t in DOCS], order)
    left = 1 - sum(p(g[0], ()) for g in counts[0])
    weights = {}

    def chance(w, h):
        if (w,) in counts[0] and (not h or counts[len(h)][(*h, w)]):
            return p(w, h)
        if not h:
            return left
        if counts[len(h) - 1][h] == 0:
            return chance(w, h[1:])
        if h not in weights:
            kept = [g[-1] for g in counts[len(h)] if g[:-1] == h]
            weights[h] = (1 - sum(p(k, h) for k in kept)) / (1 - sum(p(k, h[1:]) for k in kept))
        return weights[h] * chance(w, h[1:])

    assert len(got) == len(others) and got[4]["log_prob"] is None
    for i, text in others:
        if text:
            words = [*text.split(), "</s>"]
            expected = sum(math.log(chance(w, tuple(words[max(0, k - 2) : k]))) for k, w in enumerate(words))
            assert got[i]["log_prob"] == pytest.approx(expected, rel=1e-9)


def test_one_very_long_text_and_any_id_type(spark):
    text = " ".join(f"w{k * k % 977}" for k in range(200_000))
    rows = spark.createDataFrame([(1, text), (2, "w1 w4 w9")], "doc_id smallint, text string")
    got = {r["doc_id"]: r for r in katz.score(rows, bucket_tokens=10_000).collect()}
    assert got[1]["n_tokens"] == 200_001 and got[2]["n_tokens"] == 4
    _, _, p = brute(["w1 w4 w9", text], 3)
    words = ["w1", "w4", "w9", "</s>"]
    assert got[2]["log_prob"] == pytest.approx(sum(math.log(p(w, tuple(words[max(0, k - 2) : k]))) for k, w in enumerate(words)), rel=1e-9)


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, block int, ids int")
    assert katz.score(empty).collect() == []
    nothing = spark.createDataFrame([(1, None, 1), (None, "", 2)], "doc_id bigint, text string, words int")
    assert sorted((r["doc_id"] is None, r["n_tokens"]) for r in katz.score(nothing).collect()) == [(False, 0), (True, 0)]


def test_repeated_rows_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "a b a b"), (1, "a b a b"), (None, "a b c")], "doc_id bigint, text string")
    got = katz.score(rows).collect()
    assert len(got) == 3 and len({r["log_prob"] for r in got if r["doc_id"] == 1}) == 1


def test_grams_seen_once_are_kept(spark):
    rows = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    _, counts, _ = brute([t for _, t in DOCS], 2)
    assert 1 in counts[1].values()
    model = katz.train(rows, 2, bucket_tokens=25)
    assert sum(r["size"] for r in model.grams(2).collect()) == len(counts[1])
    got = {r["doc_id"]: r["log_prob"] for r in katz.score(rows, 2).collect()}
    factors = model.numbers.factors
    total = sum(counts[0].values())
    words = [*DOCS[1][1].split(), "</s>"]  # "dog sat", "the log" and "log </s>" are seen once
    expected = math.log(factors[0][min(counts[0][("the",)], katz.K + 1)] * counts[0][("the",)] / total)
    for g in zip(words, words[1:]):
        expected += math.log(factors[1][min(counts[1][g], katz.K + 1)] * counts[1][g] / counts[0][g[:1]])
    assert got[2] == pytest.approx(expected, rel=1e-9)


def test_registered_order_knows_trigrams(spark):
    # x is followed by c after a and by d after b: only a trigram tells them apart
    texts = ["a x c", "b x d"] * 20
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["log_prob"] for r in katz.score(rows).collect()}
    _, _, p = brute(texts, 3)
    words = ["a", "x", "c", "</s>"]
    assert got[0] == pytest.approx(sum(math.log(p(w, tuple(words[max(0, k - 2) : k]))) for k, w in enumerate(words)), rel=1e-9)
    assert got[0] > math.log(1 / 9)  # one in 8 for a as a unigram; a bigram model gives c one in 2 after x
