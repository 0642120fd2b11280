"""The pipeline, stage by stage, against brute force on each stage's own input."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quarry.llm import decontam, packing, simhash, tokens
from quarry.llm.queries import VOCABULARY

BAD = ["moron", "scum", "trash"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    folder = tmp_path_factory.mktemp("sf")
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(4000)]
    benchmark = [(k, " ".join(rng.choices(vocabulary, k=30))) for k in range(5)]
    docs, labels = [], []

    def add(words, toxic=False):
        words = list(words)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((len(docs), " ".join(w + ("." if rng.random() < 0 else "") for w in words), "en", f"s{rng.randint(0, 3)}", 0))
        if rng.random() < 0.6:
            labels.append((docs[-1][0], 1, int(toxic)))

    for _ in range(320):
        base = rng.choices(vocabulary, k=rng.randint(30, 150))
        add(base, rng.random() < 0.3)
        if rng.random() < 0.2:  # an exact copy
            docs.append((len(docs), *docs[-1][1:]))
        if rng.random() < 0.2:  # a near copy
            w = docs[-1][1].split()
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(w), *docs[-1][2:]))
        if rng.random() < 0.1:  # a leak
            add([*rng.choices(vocabulary, k=20), rng.choice(benchmark)[1], *rng.choices(vocabulary, k=20)])
    docs += [(9001, None, "en", "s0", 0), (9002, "", "en", None, None), (9002, "", "en", None, None)]
    spark.createDataFrame([(i, t, s, src, len(t or "")) for i, t, s, src, _ in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def rows(df):
    return [tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()]


def test_each_stage_on_its_own_input(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    benchmark = rows(spark.read.parquet(f"{tables}/benchmark.parquet"))
    history = {r["doc_id"] for r in labels.collect()}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = rows(docs)
        out = stage(spark, docs, tables)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = rows(docs)
        if name != "packing":
            assert docs.columns == columns
            assert not Counter(got) - Counter(given)
        if name == "toxicity":
            bad = [r for r in given if re.search("|".join(BAD), r[1] or "")]
            gone = Counter(given) - Counter(got)
            assert sum(gone[r] for r in bad) >= 0.9 * len(bad)
            assert sum(gone.values()) - sum(gone[r] for r in bad) <= 0.02 * len(given)
        elif name == "exact dedup":
            texts = [r[1] for r in got if r[1] is not None]
            assert len(texts) == len(set(texts)) and set(texts) == {r[1] for r in given if r[1] is not None}
            for r in got:
                same = [g[0] for g in given if g[1] == r[1]]
                assert r[0] == min([i for i in same if i in history] or same)
        elif name == "near dedup":
            prints, count = simhash.fingerprints(pa.array([r[1] for r in given], pa.string()))
            real = [i for i in range(len(given)) if count[i]]
            pairs = [(i, j) for n, i in enumerate(real) for j in real[:n] if simhash.distance(prints[i], prints[j]) <= simhash.NEAR]
            root = simhash.roots(len(given), *np.array(pairs).reshape(-1, 2).T)
            expected = {min(given[i][0] for i in range(len(given)) if root[i] == g) for g in set(root.tolist())}
            assert {r[0] for r in got} == expected and len(got) == len(expected)
        elif name == "decontamination":
            found = decontam.find(decontam.passages(pa.array([b[0] for b in benchmark]), [b[1] for b in benchmark]), pa.array([r[1] for r in given], pa.string()))
            exact = {k for k, r in enumerate(given) for _, item in benchmark if item in (r[1] or "")}
            assert exact and exact <= {f[0] for f in found}
            assert sorted(got, key=str) == sorted((r for k, r in enumerate(given) if k not in {f[0] for f in found}), key=str)
        else:
            sizes = Counter()
            encoding = tokens._encoding(VOCABULARY)
            for doc_id, _, _, n, ids, pack, _ in got:
                sizes[doc_id] += n
                assert (pack is None) == (n == 0) and len(ids) == n
            assert sizes == Counter({r[0]: len(encoding.encode_ordinary(r[1] or "")) for r in given})
            lengths = Counter(r[3] for r in got if r[3])
            assert len({r[5] for r in got if r[5] is not None}) == sum(n for n, _ in packing.patterns(lengths, packing.CAPACITY))


def test_near_stage_drops_every_copy_at_the_threshold(spark):
    """Copies 19 or 20 bits from their originals, and no nearer to anything else."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 9))) for _ in range(20_000)]
    tried = []
    for _ in range(900):
        w = rng.choices(vocabulary, k=60)
        tried.append(" ".join(w))
        for at in rng.sample(range(60), 9):
            w[at] = rng.choice(vocabulary)
            tried.append(" ".join(w))
    prints, _ = simhash.fingerprints(pa.array(tried))
    texts, copies = [], 0
    for k in range(0, len(tried), 10):
        far = simhash.distance(prints[k], prints[k + 1 : k + 10])
        just = np.flatnonzero((far == simhash.NEAR) | (far == simhash.NEAR - 1))
        texts += [k, k + 1 + int(just[0])] if len(just) else [k]
        copies += bool(len(just))
    assert copies > 400
    p = prints[texts]
    i, j = np.triu_indices(len(texts), 1)
    ok = simhash.distance(p[i], p[j]) <= simhash.NEAR
    expected = np.unique(simhash.roots(len(texts), i[ok], j[ok])).tolist()
    docs = spark.createDataFrame([(k, tried[t], "en", "s", len(tried[t])) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.near_stage(spark, docs, "").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in got) == expected


def test_near_stage_groups_rows_without_a_doc_id(spark):
    """They are copies like others, and kept only where nothing near has a doc_id; texts without words are near nothing."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 9))) for _ in range(5000)]
    a, b, c = (rng.choices(vocabulary, k=120) for _ in range(3))

    def near(w):
        w = list(w)
        w[rng.randrange(len(w))] = rng.choice(vocabulary)
        return " ".join(w)

    texts = [(4, " ".join(a)), (None, near(a)), (None, " ".join(a)), (None, " ".join(b)), (None, near(b)), (None, near(b)), (None, " ".join(c)), (None, " ".join(c)), (6, near(c)), (5, "?!"), (None, "?!"), (None, "?!"), (None, None), (None, None), (7, None)]
    prints, _ = simhash.fingerprints(pa.array([t for _, t in texts[:9]]))
    far = simhash.distance(prints[:, None], prints[None])
    assert (far[:3, :3] <= simhash.NEAR).all() and (far[3:6, 3:6] <= simhash.NEAR).all() and (far[6:9, 6:9] <= simhash.NEAR).all()
    assert min(far[:3, 3:].min(), far[3:6, 6:].min()) > simhash.NEAR
    docs = spark.createDataFrame([(i, t, "en", f"row {k}", 0) for k, (i, t) in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = rows(corpus_pipeline.near_stage(spark, docs, ""))
    of_b = [r for r in got if r[3] in ("row 3", "row 4", "row 5")]
    assert len(of_b) == 1
    assert sorted(r[3] for r in got if r not in of_b) == sorted(f"row {k}" for k in (0, 8, 9, 10, 11, 12, 13, 14))
    assert len(rows(corpus_pipeline.near_stage(spark, docs.where("doc_id IS NULL"), ""))) == 3 + 4


def fewest_edits(pattern, text):
    """Of the whole pattern against any stretch of the text."""
    row = np.zeros(len(text) + 1, int)
    t, step = np.array([ord(c) for c in text]), np.arange(len(text) + 1)
    for i, c in enumerate(pattern, 1):
        row = np.minimum.accumulate(np.append(i, np.minimum(row[:-1] + (t != ord(c)), row[1:] + 1)) - step) + step
    return int(row.min())


def test_decontamination_stage_drops_leaks_at_the_threshold(spark, tmp_path):
    """Passages of every length, with as many edits as 5 % allow, spread so that few grams stay whole; and with one more."""
    rng = random.Random(17)
    benchmark, docs = [], []
    for length in range(16, 130):
        item = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=length))
        benchmark.append((length, item))
        for more, kind in [(0, "put"), (0, "cut"), (0, "add"), (1, "put"), (2, "put")]:
            chars, edits = list(item), length // 20 + more
            for at in sorted((k * length // (edits + 1) for k in range(1, edits + 1)), reverse=True):
                chars[at : at + (kind != "add")] = [] if kind == "cut" else ["9"]
            text = " ".join(["".join(rng.choices("abcdefgh", k=30)), "".join(chars), "".join(rng.choices("abcdefgh", k=30))])
            docs.append((len(docs), text, length))
    leaks = {i for i, text, length in docs if 20 * fewest_edits(benchmark[length - 16][1], text) <= length}
    assert {i for i, *_ in docs if i % 5 < 3} <= leaks and len(leaks) < 0.65 * len(docs)
    spark.createDataFrame(benchmark, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = spark.createDataFrame([(i, text, "en", "s", len(text)) for i, text, _ in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"] for r in corpus_pipeline.decontamination_stage(spark, given, str(tmp_path)).collect()}
    assert got == {i for i, *_ in docs} - leaks


def test_run_gives_what_the_stages_give(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
    assert Counter(rows(corpus_pipeline.run(spark, tables))) == Counter(rows(docs))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    """Columns named like those that the stages make inside stay what they are."""
    extra = "th bigint, kept string, key string, n int, root int, kind string"
    schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}"
    rows_ = [(1, "some words of a text", "en", "s", 1, 7, "a", "b", 3, 4, "c"), (2, "some words of a text", "en", "s", 1, 7, "a", "b", 3, 4, "c"), (None, None, None, None, None, None, None, None, None, None, None)]
    for name, given in (("none", []), ("some", rows_)):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(given, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.schema.simpleString() == spark.read.parquet(f"{folder}/documents.parquet").schema.simpleString()
        assert sorted(rows(docs), key=str) == sorted((given and [given[0], given[2]]) or [], key=str)
        got = corpus_pipeline.run(spark, folder).collect()
        assert [r["doc_id"] for r in got if r["n_tokens"]] == ([1] if given else [])
