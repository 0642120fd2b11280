"""Decontamination, near-dedup and token ids against brute force."""

import base64
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import decontam, simhash, tokens
from quarry.llm.queries import QUERIES, VOCABULARY

# -- decontamination ---------------------------------------------------------------------------


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n))


def norm(text):
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def distance_inside(pattern, text):
    """Fewest edits of the pattern against any stretch of the text."""
    row = np.zeros(len(text) + 1, int)
    t = np.array([ord(c) for c in text])
    for i, c in enumerate(pattern, 1):
        best = np.minimum(row[:-1] + (t != ord(c)), row[1:] + 1)
        new = np.concatenate([[i], best])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row.min())


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        k = rng.randrange(len(chars))
        kind = rng.random()
        if kind < 0.34:
            chars[k] = rng.choice("xyz")
        elif kind < 0.67:
            del chars[k]
        else:
            chars.insert(k, rng.choice("xyz"))
    return "".join(chars)


def test_matches_equal_brute_force(spark):
    rng = random.Random(5)
    items = [(k, words(rng, rng.randint(3, 60))) for k in range(12)] + [(50, None), (51, ""), (52, "short one")]
    docs = []
    for i in range(60):
        parts = [words(rng, rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(items[:12])[1]
            parts += [edited(rng, item, rng.choice([0, 0, 1, 2, 4, 8, 12])), words(rng, rng.randint(0, 30))]
        text = " ".join(parts)
        docs.append((i, text.upper() if i % 7 == 0 else text.replace(" ", ",  ") if i % 5 == 0 else text))
    docs += [(100, None), (101, ""), (None, items[3][1]), (102, items[4][1]), (102, items[4][1]), (103, "z " * 100_000 + items[5][1])]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id bigint, text string, edits int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    expected = defaultdict(int)
    for i, text in docs:
        for k, item in items:
            p = norm(item or "")
            if len(p) >= decontam.LEAST and text:
                cost = distance_inside(p, norm(text))
                if cost <= decontam.budget(len(p))[0]:
                    expected[i, k, cost] += 1
    for at_once in (200, 1_000_000):
        got = defaultdict(int)
        for r in decontam.matches(d, b, at_once).collect():
            got[r["doc_id"], r["item_id"], r["edits"]] += 1
            text = next(t for i, t in docs if i == r["doc_id"])
            item = next(t for k, t in items if k == r["item_id"])
            assert distance_inside(norm(item), norm(text[r["start"] : r["end"]])) <= decontam.budget(len(norm(item)))[0]
        assert got == expected
    dirty = {k[0] for k in expected}
    assert {r["doc_id"] for r in decontam.drop_leaks(d, b, 200).collect()} == {i for i, _ in docs} - dirty
    assert decontam.drop_leaks(d, b).columns == d.columns


def test_decontamination_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "text")], "doc_id bigint, text string")
    b = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.matches(d, b).collect() == [] and decontam.drop_leaks(d, b).count() == 1
    b = spark.createDataFrame([(1, "a long enough passage of a benchmark")], "item_id bigint, text string")
    for kind in ("int", "string"):
        other = b.unionAll(spark.createDataFrame([(None, "another passage of it")], b.schema)).withColumn("item_id", F.col("item_id").cast(kind))
        text = spark.createDataFrame([("x", "here: A long enough passage, of a benchmark. and another passage of it")], "doc_id string, text string")
        assert sorted(str(r["item_id"]) for r in decontam.matches(text, other).collect()) == ["1", "None"]
    short = spark.createDataFrame([(1, "sixteen letters!"), (2, "fifteen letter")], "item_id bigint, text string")
    text = spark.createDataFrame([(1, "has sixteen letters s and fifteen letter x")], "doc_id bigint, text string")
    assert [r["item_id"] for r in decontam.matches(text, short).collect()] == []
    text = spark.createDataFrame([(1, "has sixteen letters9 in it")], "doc_id bigint, text string")
    exactly = spark.createDataFrame([(1, "sixteen letters9")], "item_id bigint, text string")
    assert [r["item_id"] for r in decontam.matches(text, exactly).collect()] == [1]
    assert decontam.matches(text, exactly, least=17).collect() == []
    assert decontam.matches(d.limit(0), b).collect() == []


# -- near-dedup -------------------------------------------------------------------------------------


def near_corpus():
    rng = random.Random(9)
    vocabulary = [words(rng, 1) for _ in range(3000)]
    docs, family = [], 0
    for _ in range(150):
        base = rng.choices(vocabulary, k=rng.randint(40, 200))
        for _ in range(rng.choice([1, 1, 2, 4, 60 if family == 7 else 1])):
            w = list(base)
            for _ in range(len(w) // 40):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(w)))
        family += 1
    return docs


def test_groups_equal_brute_force(spark):
    docs = near_corpus()
    t = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, group_id int")
    rows = simhash.groups(t).collect()
    got = {r["doc_id"]: r["group_id"] for r in rows}
    size = Counter(got.values())
    assert all(r["n_links"] == size[r["group_id"]] - 1 for r in rows)
    prints, _ = simhash.fingerprints(pa.array([x for _, x in docs]))
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if simhash.distance(prints[i], prints[j]) <= simhash.NEAR]
    assert len(pairs) > 200
    assert all(got[i] == got[j] for i, j in pairs)
    root = simhash.roots(len(docs), *np.array(pairs).T)
    assert all(root[g] == root[i] for i, g in got.items())  # nothing is grouped that isn't connected
    assert all(got[g] == g and g <= i for i, g in got.items())
    kept = simhash.keep_one(t)
    assert kept.columns == t.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_pivots_only_discard_far_pairs():
    rng = np.random.default_rng(4)
    p = rng.integers(0, 2**64, (400, 2), np.uint64, endpoint=False)
    p[200:] = p[:200] ^ (np.uint64(1) << rng.integers(0, 64, (200, 2)).astype(np.uint64))
    table = simhash.pivot_table(p, simhash.base())
    i, j = np.triu_indices(400, 1)
    assert (simhash.near(p, table, i, j) == (simhash.distance(p[i], p[j]) <= simhash.NEAR)).all()
    assert (simhash.pivot_bound(table[i], table[j]) <= simhash.distance(p[i], p[j])).all()


def test_the_bound_is_the_largest_difference_over_all_pivots():
    """Over bits that fall into 6 blocks, with the 64 references that complement some of them written out."""
    rng = np.random.default_rng(3)
    p = np.zeros((30, 2), np.uint64)
    p[:, 0] = rng.integers(0, 2**12, 30).astype(np.uint64)
    ref = simhash.base()
    family = []
    for mask in range(64):
        flip = sum(3 << (2 * k) for k in range(6) if mask >> k & 1)
        family.append(ref ^ np.array([flip, 0], np.uint64))
    distances = np.stack([simhash.distance(p, r) for r in family])
    table = simhash.pivot_table(p, ref)
    i, j = np.triu_indices(30, 1)
    assert (np.abs(distances[:, i] - distances[:, j]).max(0) == simhash.pivot_bound(table[i], table[j])).all()


def test_pivots_discard_most_far_candidates(spark):
    """Of the far pairs that blocks propose, on real texts, the pivots leave few to verify."""
    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data here")
    texts = pa.array([r[0] for r in spark.read.parquet(path).where("doc_id % 3 = 0").select("text").collect()], pa.string())
    prints, count = simhash.fingerprints(texts)
    prints = np.unique(prints[count > 0], axis=0)
    table = simhash.pivot_table(prints, simhash.base())
    i, j = np.random.default_rng(1).integers(0, len(prints), (2, 3_000_000))
    far = kept = 0
    for first, width in simhash.blocks():
        key = simhash.block_key(prints, first, width)
        met = np.bitwise_count(key[i] ^ key[j]) <= simhash.RADIUS
        met &= simhash.distance(prints[i], prints[j]) > simhash.NEAR
        far += int(met.sum())
        kept += int((simhash.pivot_bound(table[i[met]], table[j[met]]) <= simhash.NEAR).sum())
    assert far > 10_000 and kept < 0.1 * far


def apart(rng, p, bits):
    """Prints so many bits from those of `p`, each at bits of its own."""
    q = p.copy()
    for k in range(len(p)):
        for bit in rng.choice(128, bits, replace=False):
            q[k, bit >> 6] ^= np.uint64(1) << np.uint64(bit & 63)
    return q


def test_near_prints_agree_on_a_block():
    """The blocks take every bit once, and more than NEAR bits are needed to be out of the radius in all of them."""
    assert [k for a, n in simhash.blocks() for k in range(a, a + n)] == list(range(128))
    assert len(simhash.blocks()) * (simhash.RADIUS + 1) > simhash.NEAR
    for k in range(128):
        p = np.zeros((1, 2), np.uint64)
        p[0, k >> 6] = np.uint64(1) << np.uint64(k & 63)
        assert [int(simhash.block_key(p, a, n)[0]) for a, n in simhash.blocks()] == [1 << (k - a) if a <= k < a + n else 0 for a, n in simhash.blocks()]
    assert sorted(simhash.ball(9).tolist()) == [x for x in range(512) if x.bit_count() <= simhash.RADIUS]


@pytest.mark.parametrize("step, most", [(1, 1), (7, 50), (512, 1_000_000)])
def test_candidates_are_all_that_blocks_propose_and_pivots_leave(step, most):
    rng = np.random.default_rng(6)
    p = apart(rng, rng.integers(0, 2**64, (20, 2), np.uint64, endpoint=False)[rng.integers(0, 20, 200)], 9)
    i, j = (x.ravel() for x in np.mgrid[:120, 120:200])
    table = simhash.pivot_table(p, simhash.base())
    left = simhash.pivot_bound(table[i], table[j]) <= simhash.NEAR
    expected = Counter()
    for first, width in simhash.blocks():
        key = simhash.block_key(p, first, width)
        ok = left & (np.bitwise_count(key[i] ^ key[j]) <= simhash.RADIUS)
        expected.update(zip(i[ok].tolist(), j[ok].tolist()))
    got = Counter()
    for a, b in simhash.candidates(p[:120], p[120:], step, most):
        got.update(zip(a.tolist(), (b + 120).tolist()))
    assert got == expected and {(x, y) for x, y in zip(i.tolist(), j.tolist()) if simhash.distance(p[x], p[y]) <= simhash.NEAR} <= set(got)


def test_spanning_edges_of_cells_equal_brute_force():
    rng = np.random.default_rng(8)
    p = apart(rng, rng.integers(0, 2**64, (40, 2), np.uint64, endpoint=False)[rng.integers(0, 40, 400)], 10)
    i, j = np.triu_indices(400, 1)
    ok = simhash.distance(p[i], p[j]) <= simhash.NEAR
    i, j = i[ok], j[ok]
    assert (simhash.roots(400, *simhash.spanning(p)) == simhash.roots(400, i, j)).all()
    across = (i < 150) & (j >= 150)
    assert (simhash.roots(400, *simhash.spanning(p[:150], p[150:])) == simhash.roots(400, i[across], j[across])).all()
    assert all(len(x) == 0 for given in ((p[:0],), (p[:0], p), (p, p[:0])) for x in simhash.spanning(*given))


def test_many_far_prints_with_one_partner_each():
    rng = np.random.default_rng(7)
    p = rng.integers(0, 2**64, (3000, 2), np.uint64, endpoint=False)
    root = simhash.roots(6000, *simhash.spanning(np.concatenate([p, apart(rng, p, 12)])))
    assert (root[:3000] == np.arange(3000)).all() and (root[3000:] == np.arange(3000)).all()


@pytest.mark.parametrize("n, most", [(300, 40), (4000, 1_000_000), (4000, 600)])
def test_every_pair_at_the_threshold_is_linked(spark, n, most):
    """Pairs exactly 20 bits apart, in one hot cluster of bits or spread, in cells of any size."""
    rng = np.random.default_rng(n)
    p = rng.integers(0, 2**64, (n, 2), np.uint64, endpoint=False)
    if most < n:  # a third agree on the first word, and so on three blocks
        p[: n // 3, 0] = p[0, 0]
    both = np.concatenate([p, apart(rng, p, simhash.NEAR)])
    rows = spark.createDataFrame([(int(a), int(b), k) for k, (a, b) in enumerate(both.view(np.int64))], "f1 bigint, f2 bigint, node bigint").repartition(5)
    found = dict(map(tuple, simhash.components(simhash.links(rows, 2 * n, most)).collect()))
    expected = [np.flatnonzero(simhash.distance(both[k], both) <= simhash.NEAR) for k in range(2 * n)]
    root = simhash.roots(2 * n, np.repeat(np.arange(2 * n), [len(x) for x in expected]), np.concatenate(expected))
    assert all(k in expected[k + n] for k in range(n))
    assert [found.get(k, k) for k in range(2 * n)] == root.tolist()


def test_components_of_chains(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60) if k not in (20, 45)] + [(100, 200), (200, 100), (7, 7)]
    rng.shuffle(edges)
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {k: 0 if k <= 20 else 21 if k <= 45 else 46 for k in range(61) if k not in (0, 21, 46)} | {200: 100}


def test_near_dedup_edges(spark):
    rows = [(1, None), (2, ""), (3, "?!"), (4, "same words here"), (5, "same words here"), (5, "same words here"), (None, "same words here"), (6, "long words " * 100_000)]
    t = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, f1 int")
    got = sorted(map(tuple, simhash.groups(t).collect()), key=str)
    assert got == sorted([(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 2), (5, 4, 2), (5, 4, 2), (None, None, 0), (6, 6, 0)], key=str)
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(t).collect()) == ["1", "2", "3", "4", "6", "None"]
    assert simhash.groups(t.limit(0)).collect() == [] and simhash.keep_one(t.limit(0)).collect() == []


@pytest.mark.parametrize("kind", ["int", "string", "decimal(20,0)"])
def test_near_dedup_with_any_id_type(spark, kind):
    rows = [("1", "one text of words"), ("1", "quite another story altogether"), ("2", "quite another story altogether"), ("3", "one text of words")]
    t = spark.createDataFrame(rows, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = sorted((str(r["doc_id"]), str(r["group_id"]), r["n_links"]) for r in simhash.groups(t).collect())
    assert got == [("1", "1", 1), ("1", "1", 1), ("2", "1", 1), ("3", "1", 1)]
    assert sorted(r["text"] for r in simhash.keep_one(t).collect()) == [rows[0][1], rows[1][1]]


# -- token ids ------------------------------------------------------------------------------------------

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no public vocabulary here")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=20), max_size=8))
def test_coding_round_trip(docs):
    counts = np.array([len(d) for d in docs], np.int64)
    ranks = np.array([x for d in docs for x in d], np.uint32)
    control, data = tokens.encode(ranks, counts)
    for d, c, b in zip(docs, control, data):
        assert tokens.decode(c, b, len(d)).tolist() == d
        assert len(c) == -(-len(d) // 4) and len(b) == sum(max(1, (x.bit_length() + 7) // 8) for x in d)


@needs_vocabulary
@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" '\n\tstrevmld1!é"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=5))
def test_batches_tokenise_as_single_texts(texts):
    encoding = tokens._encoding(VOCABULARY)
    ids, counts = tokens.Tokenizer(VOCABULARY)(pa.array(texts, pa.string()))
    expected = [encoding.encode_ordinary(t) for t in texts]
    assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == [x for e in expected for x in e]


@needs_vocabulary
def test_pieces_made_to_share_a_hash_keep_their_own_ids():
    """Thue-Morse words of 2048 letters and their complements agree in any polynomial hash modulo 2^64."""
    bits = np.array([bin(k).count("1") % 2 for k in range(2048)])
    texts = ["".join(a[k] for k in x) for x in (bits, 1 - bits) for a in ("ab", "cd")]
    hashes = tokens.span_hash(*[np.concatenate([np.array([ord(c) for c in t], np.uint32) for t in texts]), np.arange(0, 8192, 2048), np.arange(2048, 8193, 2048)])
    assert len(set(hashes.tolist())) == 2
    encoding, tokenizer = tokens._encoding(VOCABULARY), tokens.Tokenizer(VOCABULARY)
    for order in (texts, texts[::-1], texts[2:] + texts[:2]):
        for batch in ([x] for x in order) if order is texts[::-1] else (order,):
            ids, counts = tokenizer(pa.array([f"so {x} it is" for x in batch]))
            expected = [encoding.encode_ordinary(f"so {x} it is") for x in batch]
            assert counts.tolist() == list(map(len, expected)) and ids.tolist() == [x for e in expected for x in e]


@needs_vocabulary
def test_binary_ids_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randint(0, 50))) for i in range(40)] + [(100, None), (101, ""), (None, "x y"), (102, "many words " * 60_000), (103, "tie"), (103, "tie")]
    t = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, ids int")
    encoded, ranks = tokens.binary_ids(t, VOCABULARY)
    table = ranks.orderBy("rank").collect()
    assert [(r["n"], -r["token"]) for r in table] == sorted([(r["n"], -r["token"]) for r in table], reverse=True)
    token = np.array([r["token"] for r in table])
    with open(VOCABULARY, "rb") as f:
        piece = {int(k): base64.b64decode(b) for b, k in map(bytes.split, f)}
    back = sorted((str(r["doc_id"]), b"".join(piece[x] for x in token[tokens.decode(r["control"], r["data"], r["n_tokens"])].tolist()).decode()) for r in encoded.collect())
    assert back == sorted((str(i), x or "") for i, x in rows)
    empty, none = tokens.binary_ids(t.limit(0), VOCABULARY)
    assert empty.collect() == [] and none.collect() == []


@needs_vocabulary
def test_registered_ids_decode_from_the_result_alone(spark, tmp_path):
    docs = [(1, "the sea, the sea"), (2, "over the hills"), (3, None), (4, "")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op4_token_ids"](spark, str(tmp_path)).collect()
    token = {r["rank"]: r["token"] for r in rows if r["kind"] == "rank"}
    with open(VOCABULARY, "rb") as f:
        piece = {int(k): base64.b64decode(b) for b, k in map(bytes.split, f)}
    back = {r["doc_id"]: b"".join(piece[token[x]] for x in tokens.decode(r["control"], r["data"], r["n_tokens"]).tolist()).decode() for r in rows if r["kind"] == "ids"}
    assert back == {i: x or "" for i, x in docs}
