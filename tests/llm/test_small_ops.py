"""Chat formatting, packing, pseudonyms and exact dedup on small tables, with their edge cases."""

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import chat, exact, packing, pii, tokens
from quarry.llm.queries import VOCABULARY

# -- chat ---------------------------------------------------------------------------------


def test_chat_merges_sorts_and_escapes(spark):
    rows = [
        (1, 2, "user", "b", 0), (1, 1, "user", "a", 0), (1, 3, "bot", None, 0), (1, None, None, "first", 0), (1, 3, "bot", "", 0),
        (2, 1, "user", "say <|end|>", 0), (None, 1, "user", "x", 0), (3, 1, "u", "same", 0), (3, 1, "u", "same", 0),
    ]
    t = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, starts int")
    got = {r["conv_id"]: r for r in chat.format_chats(t).collect()}
    assert got[1]["chat"] == "<|unknown|>\nfirst<|end|>\n<|user|>\na\nb<|end|>\n<|bot|>\n\n<|end|>\n"
    assert (got[1]["n_turns"], got[1]["n_messages"]) == (5, 3)
    assert got[2]["chat"] == "<|user|>\nsay < |end|><|end|>\n"
    assert got[None]["n_turns"] == 1 and got[3]["chat"] == "<|u|>\nsame\nsame<|end|>\n"
    assert chat.format_chats(t.limit(0)).collect() == []


def test_no_role_forges_a_marker_and_long_texts_are_whole(spark):
    rows = [(1, 1, "a|>\nx<|end|>\n<|b", "t"), (2, 1, "u", "long " * 400_000)]
    got = {r["conv_id"]: r["chat"] for r in chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got[1] == "<|a| >\nx< |end| >\n< |b|>\nt<|end|>\n" and got[1].count("<|") == 2 == got[1].count("|>")
    assert got[2] == "<|u|>\n" + "long " * 400_000 + "<|end|>\n"


def test_chat_long_conversation(spark):
    rows = [(1, k, "ab"[k // 7 % 2], f"t{k}" * 50) for k in range(3000)]
    random.Random(1).shuffle(rows)
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).first()
    assert got["n_messages"] == len({k // 7 for k in range(3000)}) and got["chat"].count("t2999") == 50


# -- packing --------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_patterns_hold_every_piece_once(lengths):
    found = packing.patterns(Counter(lengths), 30)
    assert Counter(x for n, p in found for x in p * n) == Counter(lengths)
    assert all(sum(p) <= 30 for _, p in found)
    # longest first, each into the pack with most room
    rooms: list[int] = []
    for x in sorted(lengths, reverse=True):
        k = max(range(len(rooms)), key=lambda i: rooms[i], default=None)
        if k is not None and rooms[k] >= x:
            rooms[k] -= x
        else:
            rooms.append(30 - x)
    assert sum(n for n, _ in found) == len(rooms)


def check_packs(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        if r["pack_id"] is not None:
            by[r["pack_id"]].append((r["pack_offset"], r["n_tokens"]))
        else:
            assert r["n_tokens"] == 0
    for pieces in by.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]))
        assert sum(pieces[-1]) <= capacity
    return by


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no public vocabulary here")
def test_pack_covers_whole_documents(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(["w"] * rng.choice([1, 2, 3, 7, 15, 16, 17, 40, 100])), "x") for i in range(300)]
    docs += [(900, None, "x"), (901, "", "x"), (902, " \n ", "x"), (903, "w " * 5000, "x"), (1, "a b", "x"), (1, "a b", "x"), (None, "q r s", "x")]
    t = spark.createDataFrame(docs, "doc_id bigint, text string, rank string").repartition(3)
    packed = packing.pack(t, VOCABULARY, 16)
    rows = packed.collect()
    by = check_packs(rows, 16)
    encoding = tokens._encoding(VOCABULARY)
    whole = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["piece"])):
        assert r["piece_start"] == 16 * r["piece"] and len(r["ids"]) == r["n_tokens"]
        whole[r["doc_id"]] += r["ids"]
    for i, text, _ in docs:
        if i != 1:
            assert whole[i] == encoding.encode_ordinary(text or "")
    assert len(whole[1]) == sum(len(encoding.encode_ordinary(x or "")) for i, x, _ in docs if i == 1)
    histogram = Counter(r["n_tokens"] for r in rows if r["n_tokens"])
    assert len(by) == sum(n for n, _ in packing.patterns(histogram, 16))
    packs = packing.assembled(packed).collect()
    assert sorted(r["pack_id"] for r in packs) == sorted(by)
    member = {(r["pack_id"], r["pack_offset"]): r for r in rows if r["pack_id"] is not None}
    for r in packs:
        assert len(r["ids"]) == r["n_tokens"] == r["ends"][-1] <= 16
        for doc_id, start, end in zip(r["doc_ids"], [0, *r["ends"][:-1]], r["ends"]):
            own = member[r["pack_id"], start]
            assert (own["doc_id"], own["ids"]) == (doc_id, r["ids"][start:end])
    assert packing.pack(t.limit(0), VOCABULARY, 16).collect() == []


# -- pseudonyms ----------------------------------------------------------------------------------

KEY = b"k"


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(size):
    assert sorted(pii.feistel(x, size, KEY, "t") for x in range(size)) == list(range(size))


def test_formats_are_kept_and_checked():
    text = "card 4111 1111 1111 1111, bad 4111111111111112, call +1 (017) 555-7713 at 233.254.104.120 or 999.1.1.1, on 2024-02-29 not 2023-02-29, mail Ünd.34@mail7.example.com; v1.2.3.4.5 x12345678"
    out, found = pii.pseudonymise(text, KEY)
    assert Counter(f["kind"] for f in found) == {"card": 1, "phone": 1, "ip": 1, "date": 1, "email": 1}
    assert re.sub(r"\d", "9", out[:24]) == re.sub(r"\d", "9", text[:24])
    for kept in ("4111111111111112", "999.1.1.1", "2023-02-29", "@mail7.example.com", "v1.2.3.4.5", "x12345678", "+1 ("):
        assert kept in out
    for gone in ("4111 1111 1111 1111", "(017) 555-7713", "233.254.104.120", "2024-02-29", "Ünd.34@"):
        assert gone not in out
    for f in found:
        if f["kind"] == "card":
            assert pii.luhn(f["replacement"].replace(" ", ""))
        if f["kind"] == "ip":
            assert [len(o) for o in f["replacement"].split(".")] == [3, 3, 3, 3] and all(int(o) < 256 for o in f["replacement"].split("."))
    at = 0
    rebuilt = ""
    for f in found:
        rebuilt += text[at : f["start"]] + f["replacement"]
        at = f["end"]
    assert rebuilt + text[at:] == out


def test_equal_values_stay_linked():
    a = pii.pseudonymise("4111-1111-1111-1111", KEY)[1][0]["replacement"].replace("-", "")
    b = pii.pseudonymise("4111111111111111", KEY)[1][0]["replacement"]
    assert a == b and pii.pseudonymise("4111111111111111", b"other")[1][0]["replacement"] != b
    m, n = (pii.pseudonymise(x, KEY)[1][0]["replacement"] for x in ("Ann.B@x.org", "ann.b@x.org"))
    assert m.lower() == n and m != n
    ips = [f"10.{i}.1.1" for i in range(10)]
    assert len({pii.pseudonym("ip", x, KEY) for x in ips}) == 10


def test_pseudonyms_edges(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "no numbers", 5), (None, "call 555-123-4567", 5), (4, "x " * 200_000 + "10.0.0.1", 5), (4, "10.0.0.1", 5), (4, "10.0.0.1", 5)]
    t = spark.createDataFrame(rows, "doc_id bigint, text string, found int")
    got = pii.pseudonyms(t, KEY).collect()
    assert len(got) == 7
    by = {(r["doc_id"], r["n_replaced"]): r["text"] for r in got}
    assert by[1, 0] is None and by[2, 0] == "" and by[3, 0] == "no numbers" and "555-123-4567" not in by[None, 1]
    assert all("10.0.0.1" not in r["text"] for r in got if r["doc_id"] == 4)
    assert pii.pseudonyms(t.limit(0), KEY).collect() == []


# -- exact dedup -------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 20_000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).integers(0, 2**64, (n, 4), np.uint64, endpoint=False)
    sizes, bits = exact.build(keys)
    assert sorted(exact.slot(keys, sizes, bits)) == list(range(n))


def brute_keepers(rows, old):
    groups = defaultdict(list)
    for d, t in rows:
        if t is not None:
            groups[t].append(d)
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, d, False))
            continue
        known = [x for x in groups[t] if x is not None and x in old]
        ids = [x for x in groups[t] if x is not None]
        out.append((d, min(known) if known else min(ids, default=None), bool(known)))
    return out


ROWS = [(5, "a"), (2, "a"), (9, "a"), (3, "b"), (4, "b"), (7, ""), (8, ""), (1, None), (6, None), (None, "c"), (10, "c"), (None, "d"), (None, "d"), (11, "long " * 100_000), (12, "long " * 100_000), (9, "a"), (13, "e")]


@pytest.mark.parametrize("old", [[], [9, 4, 13], [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13], [99, None, 9, 9]])
@pytest.mark.parametrize("shard", [1, 100])
def test_keepers_equal_brute_force(spark, old, shard):
    t = spark.createDataFrame([(*r, 1, "z") for r in ROWS], "doc_id bigint, text string, digest int, winner string")
    history = spark.createDataFrame([(x, 0) for x in old], "doc_id bigint, toxic int")
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(tuple, exact.keepers(t, history, shard).collect()), key=key) == sorted(brute_keepers(ROWS, set(old)), key=key)


def test_drop_copies(spark):
    t = spark.createDataFrame([(*r, 1, "z") for r in ROWS], "doc_id bigint, text string, key int, n string")
    history = spark.createDataFrame([(9,)], "doc_id bigint")
    kept = exact.drop_copies(t, history)
    assert kept.columns == t.columns
    assert Counter((r["doc_id"], (r["text"] or "")[:4]) for r in kept.collect()) == {(9, "a"): 1, (3, "b"): 1, (7, ""): 1, (1, ""): 1, (6, ""): 1, (10, "c"): 1, (None, "d"): 1, (11, "long"): 1, (13, "e"): 1}
    assert exact.drop_copies(t.limit(0), history).collect() == []


@pytest.mark.parametrize("kind", ["string", "smallint"])
@pytest.mark.parametrize("history", [[], ["3"]])
def test_dedup_with_any_id_type_and_history(spark, kind, history):
    rows = [("1", "a"), ("2", "b"), ("3", "a"), ("4", "a"), (None, "b"), ("5", None)]
    t = spark.createDataFrame(rows, "doc_id string, text string")
    t = t.withColumn("doc_id", t["doc_id"].cast(kind))
    old = spark.createDataFrame([(x,) for x in history], "doc_id string")
    old = old.withColumn("doc_id", old["doc_id"].cast(kind))
    got = {str(r["doc_id"]): str(r["keeper_id"]) for r in exact.keepers(t, old, 1).collect()}
    first = "3" if history else "1"
    assert got == {"1": first, "2": "2", "3": first, "4": first, "None": "2", "5": "5"}


def test_shards_follow_the_larger_side(spark):
    rows = [(i, f"t{i}") for i in range(500)]
    t = spark.createDataFrame(rows, "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint")
    assert {r["keeper_id"] for r in exact.keepers(t, none, 10).collect()} == set(range(500))
