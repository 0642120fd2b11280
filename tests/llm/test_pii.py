"""Pseudonyms: whole texts against a brute-force search, and the promises of linking, injectivity and change."""

import itertools
import random
import re
from datetime import date, timedelta

import pytest

from quarry.llm import pii

KEY = b"k"


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000])
def test_nothing_stays_in_its_place(size):
    got = [pii.permuted(x, size, KEY, "t") for x in range(size)]
    assert sorted(got) == list(range(size)) and all(x != y for x, y in enumerate(got))
    assert [pii.feistel(pii.feistel(x, size, KEY, "t"), size, KEY, "t", True) for x in range(size)] == list(range(size))


def one(value):
    text, found = pii.pseudonymise(f"see {value} there", KEY)
    assert len(found) == 1, value
    assert text == f"see {found[0]['replacement']} there"
    return found[0]["replacement"]


def test_separators_padding_and_case_keep_values_linked():
    def digits(x):
        return re.sub(r"\D", "", x)

    for same in (["+49 30 1234567", "+49301234567", "+49-30-123-4567", "+49.30.1234567"], ["+1 (555) 123-4567", "+1 555 123 4567", "+15551234567"], ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"]):
        assert len({digits(one(x)) for x in same}) == 1
    assert one("+49301234567").startswith("+49") and one("+351 912 345 678").startswith("+351 ") and one("+7 9123456789").startswith("+7 ")
    assert digits(one("(555) 123-4567")) == digits(one("+1 555 123 4567"))[1:]
    assert one("DE89 3704 0044 0532 0130 00").replace(" ", "") == one("DE89370400440532013000")
    assert one("Иван.Ю@Example.ru").lower() == one("иван.ю@example.ru")
    iso = one("2020-02-01").split("-")
    assert list(map(int, one("1/2/2020").split("/"))) == list(map(int, one("01/02/2020").split("/"))) == list(map(int, one("01.02.2020").split("."))) == list(map(int, reversed(iso)))
    y, m, d = map(int, one("1900-01-13").split("-"))
    assert one("01/13/1900") == f"{m:02d}/{d:02d}/{y}"


@pytest.mark.parametrize("form", ["{d:02d}/{m:02d}/{y}", "{m:02d}/{d:02d}/{y}", "{d}.{m}.{y}", "{y}-{m:02d}-{d:02d}"])
def test_dates_are_injective_and_keep_their_widths(form):
    first = date(1900, 1, 1)
    given = {form.format(y=x.year, m=x.month, d=x.day) for x in (first + timedelta(k) for k in range(0, 73_049, 3))}
    got = {x: pii.pseudonym("date", x, KEY) for x in given}
    assert len(set(got.values())) == len(given) and all(x != y for x, y in got.items())
    assert all([len(p) for p in re.split("[-/.]", x)] == [len(p) for p in re.split("[-/.]", y)] for x, y in got.items())


def test_day_first_and_month_first_dates_never_meet():
    days = [date(1900, 1, 1) + timedelta(k) for k in range(0, 73_049, 7)]
    given = {f"{x.day:02d}/{x.month:02d}/{x.year}" for x in days} | {f"{x.month:02d}/{x.day:02d}/{x.year}" for x in days}
    assert len({pii.pseudonym("date", x, KEY) for x in given}) == len(given)


def test_values_of_each_kind_are_injective_and_valid():
    rng = random.Random(8)
    ssn = {f"{rng.choice([1, 665, 667, 899, rng.randint(1, 600)]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" for _ in range(500)}
    got = {pii.pseudonym("ssn", x, KEY) for x in ssn}
    assert len(got) == len(ssn) and all(pii.pseudonym("ssn", x, KEY) for x in got)
    for bad in ("000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000"):
        assert pii.pseudonym("ssn", bad, KEY) is None
    ibans = {f"DE{pii._checked('DE', f'{k:018d}'):02d}{k:018d}" for k in range(300)} | {f"GB{pii._checked('GB', f'WEST{k:014d}'):02d}WEST{k:014d}" for k in range(300)}
    got = {pii.pseudonym("iban", x, KEY) for x in ibans}
    assert len(got) == 600
    for x in got:  # the remainder by its definition
        assert int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    assert pii.pseudonym("iban", "DE88370400440532013000", KEY) is None
    names = {"".join(t) + "@a.b" for t in itertools.product("абö1", repeat=3)}
    assert len({pii.pseudonym("email", x, KEY) for x in names}) == len(names)


def test_what_is_reported_has_changed_and_what_is_not_has_not():
    for local in ("иван", "李雷", "α", "ünï", "x", "7", "A.b+c", "محمد", "ß-x"):
        new = one(f"{local}@example.ru")
        assert new != f"{local}@example.ru" and new.endswith("@example.ru") and len(new) == len(local) + 11
    for local in ("ß", "._.", "+"):
        assert pii.pseudonymise(f"{local}@example.ru", KEY) == (f"{local}@example.ru", [])
    long = "a" * 100_000 + "@example.ru"
    text, found = pii.pseudonymise(long + " " + "b" * 100_000, KEY)
    assert len(found) == 1 and found[0]["end"] == len(long) and len(text) == len(long) + 100_001
    assert pii.pseudonymise(long.replace("aaa", "AAa"), KEY)[0].lower() == pii.pseudonymise(long, KEY)[0]


# -- a brute-force search: every stretch of the text is tried as every kind ------------------------


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def kind_of(s):
    digits = re.sub(r"[ .-]", "", s)
    if re.fullmatch(r"[\w.+%-]+@[\w-]+(\.[\w-]+)+", s):
        return "email"
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", s) and s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000":
        return "ssn"
    if re.fullmatch(r"\d{3}-\d{3}-\d{4}|\(\d{3}\) \d{3}-\d{4}", s) or re.fullmatch(r"\+\d{1,3}( \d{2,4}){2,4}", s) and 8 <= len(digits) - 1 <= 15:
        return "phone"
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", s) and all(p == str(int(p)) and int(p) < 256 for p in s.split(".")):
        return "ip"
    if re.fullmatch(r"\d{4}-\d\d-\d\d", s):
        try:
            return "date" if 1900 <= date.fromisoformat(s).year < 2100 else None
        except ValueError:
            return None
    if re.fullmatch(r"\d{16}|\d{4}( \d{4}){3}", s) and luhn(digits) and len(set(digits)) > 1:
        return "card"
    return None


def brute(text):
    found, at = [], 0
    while at < len(text):
        for end in range(len(text), at, -1):
            kind = kind_of(text[at:end])
            before, after = text[at - 1 : at], text[end : end + 1]
            if kind and not re.match(r"[\w.+-]", before) and not re.match(r"[\w-]", after):
                found.append((kind, at, end))
                at = end - 1
                break
        at += 1
    return found


def test_texts_equal_a_brute_force_search():
    rng = random.Random(4)
    values = ["4111 1111 1111 1111", "4111111111111112", "5500005555555559", "+49 30 1234 567", "(017) 555-7713", "555-123-4567", "10.0.0.1", "256.1.1.1", "01.2.3.4", "2024-02-29", "2023-02-29", "1850-01-01", "ann.b@x.org", "иван@пример.ру", "@x.org", "a@b", "123-45-6789", "666-45-6789", "plain", "x12", "12", "1.5"]
    for _ in range(120):
        text = "".join(rng.choice(values) + rng.choice([" ", ", ", "; ", "\n", " and "]) for _ in range(rng.randint(0, 6)))
        out, found = pii.pseudonymise(text, KEY)
        expected = brute(text)
        assert [(f["kind"], f["start"], f["end"]) for f in found] == expected, text
        rebuilt, at = "", 0
        for kind, start, end in expected:
            rebuilt += text[at:start] + pii.pseudonym(kind, text[start:end], KEY)
            at = end
        assert rebuilt + text[at:] == out


def test_any_id_type(spark):
    t = spark.createDataFrame([(1, "call 555-123-4567"), (None, None)], "doc_id smallint, text string")
    got = {r["doc_id"]: r for r in pii.pseudonyms(t, KEY).collect()}
    assert got[1]["n_replaced"] == 1 and got[None]["text"] is None
    d = spark.createDataFrame([(date(2020, 1, 1), "10.0.0.1")], "doc_id date, text string")
    assert pii.pseudonyms(d, KEY).first()["n_replaced"] == 1
