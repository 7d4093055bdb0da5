"""Pseudonyms of whole tables against a plain finder: words are cut at blanks and judged by validators of their own."""

import datetime as dt
import ipaddress
import random
import time

import pytest
from helpers import table

from cohortlens.llm import pii, queries

ORDINARY = ["the", "Größe", "order", "12", "3.5", "x=1", "v1.2.3", "漢字", "2024", "1/2", "a@b", "10-20", "№7", "(none)", "AKIA", "+49"]


def luhn(word):
    digits = [int(c) for c in word][::-1]
    return sum(digits[0::2]) + sum(2 * d if d < 5 else 2 * d - 9 for d in digits[1::2])


def kind_of(word):
    """Kind and value of a word that is a valid identifier, or None."""
    if word.count("@") == 1:
        name, domain = word.split("@")
        if name and domain.count(".") == 1 and domain.split(".")[1].isalpha() and len(domain.split(".")[1]) > 1:
            return "email", word
    if word.isascii() and word.isdigit() and len(word) in (13, 15, 16, 19) and luhn(word) % 10 == 0 and len(set(word)) > 1:
        return "card", word
    if len(word) == 20 and word.startswith("AKIA") and word.isalnum() and word.isupper():
        return "access_key", word
    if word[:2] in ("DE", "NO") and word[2:].isdigit() and len(word) == {"DE": 22, "NO": 15}[word[:2]]:
        if int(word[4:] + "".join(str(ord(c) - 55) for c in word[:2]) + word[2:4]) % 97 == 1:
            return "iban", word
    if word.count(".") == 3:
        try:
            return "ipv4", str(ipaddress.IPv4Address(word))
        except ValueError:
            pass
    for form, mark in (("%Y-%m-%d", "-"), ("%d.%m.%Y", "."), ("%d/%m/%Y", "/"), ("%m/%d/%Y", "/")):
        if word.count(mark) == 2:
            try:
                day = dt.datetime.strptime(word, form).date()
            except ValueError:
                continue
            if 1900 <= day.year <= 2099:
                return "date", day
    a = word.split("-")
    if [len(x) for x in a] == [3, 2, 4] and "".join(a).isdigit():
        if a[0] not in ("000", "666") and a[0][0] != "9" and a[1] != "00" and a[2] != "0000":
            return "ssn", word
    if [len(x) for x in a] == [3, 3, 4] and "".join(a).isdigit() and a[0][0] in "23456789" and a[1][0] in "23456789":
        return "phone", "".join(a)
    return None


def words_at_random(rng, n):
    out = []
    for _ in range(n):
        number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
        day = dt.date(1900, 1, 1) + dt.timedelta(rng.randrange(73_000))
        out.append(rng.choice([
            lambda: rng.choice(ORDINARY), lambda: number(16), lambda: number(13), lambda: "AKIA" + "".join(rng.choice("ABZ09") for _ in range(16)),
            lambda: "DE" + number(20), lambda: "NO" + f"{98 - int(tail + '232400') % 97:02d}" + tail if (tail := number(11)) else "",
            lambda: ".".join(str(rng.randrange(300)) for _ in range(4)), lambda: f"{number(3)}-{number(2)}-{number(4)}",
            lambda: f"{number(3)}-{number(3)}-{number(4)}", lambda: f"user{rng.randrange(9)}@mail{rng.randrange(3)}.org",
            lambda: day.strftime("%Y-%m-%d"), lambda: f"{day.day}.{day.month}.{day.year}", lambda: f"{day.day:02d}/{day.month:02d}/{day.year}",
            lambda: f"{day.day}/{day.month}/{day.year}", lambda: f"{day.month}/{day.day}/{day.year}" if day.day > 12 else "x",
            lambda: f"{rng.randrange(40)}.{rng.randrange(15)}.{rng.randrange(1800, 2200)}", lambda: (body := number(15)) + str(-luhn(body + "0") % 10)])())
    return out


def test_a_table_against_a_plain_finder(spark):
    rng = random.Random(12)
    pool = words_at_random(rng, 1500)
    # blanks join groups of digits into runs, so words are kept apart by a mark that no format has
    docs = [(i, " | ".join(rng.choice(pool) for _ in range(rng.randrange(40)))) for i in range(400)]
    got = dict((r["doc_id"], r) for r in pii.pseudonymize(table(spark, docs), key=b"some key").collect())
    back = dict((r["doc_id"], r["text"]) for r in pii.pseudonymize(spark.createDataFrame(list(got.values())), key=b"some key", undo=True).collect())
    image, seen = {}, set()
    for i, text in docs:
        n = 0
        for old, new in zip(text.split(" | "), got[i]["text"].split(" | "), strict=True):
            found = kind_of(old)
            if found is None:
                assert new == old
                continue
            n += 1
            kind, value = kind_of(new)
            assert kind == found[0] and new != old, (old, new)
            assert image.setdefault(found, value) == value, "equal values keep equal pseudonyms, however they are written"
            seen.add(kind)
        assert got[i]["n_replaced"] == n and back[i] == text
    assert len(set((k, v) for (k, _), v in image.items())) == len(image), "different values stay different"
    assert seen == {"email", "card", "access_key", "iban", "ipv4", "date", "ssn", "phone"}


def test_every_way_to_write_a_date_is_linked():
    change, undo = pii.Pseudonymizer(b"key"), pii.Pseudonymizer(b"key", undo=True)
    for day in (dt.date(2024, 2, 1), dt.date(1999, 11, 5), dt.date(2001, 3, 25), dt.date(1950, 12, 31), dt.date(2024, 2, 11)):
        ways = [f"{day:%Y-%m-%d}", f"{day:%d.%m.%Y}", f"{day:%d/%m/%Y}", f"{day.day}.{day.month}.{day.year}", f"{day.day}/{day.month}/{day.year}",
                f"{day.year}-{day.month}-{day.day}", *([f"{day:%m/%d/%Y}", f"{day.month}/{day.day}/{day.year}"] if day.day > 12 else [])]
        images = [change(w)[0] for w in ways]
        assert [undo(x)[0] for x in images] == ways
        assert len({kind_of(x) for x in images}) == 1 and kind_of(images[0])[1] != day


@pytest.mark.parametrize("text", ["1 " * 500_000, "1 2 3 4 5 6 7 8 9 0 " * 50_000, "12 345 6789-" * 80_000])
def test_tables_of_digit_groups_are_fast(text):
    start = time.monotonic()
    pii.Pseudonymizer(b"key")(text)
    assert time.monotonic() - start < 30


def test_windows_of_runs_match_trying_all():
    rng = random.Random(8)
    for _ in range(300):
        run = "".join(rng.choice(["1", "2", "59", "407", "8 ", "3-", "0000"]) for _ in range(rng.randrange(1, 60))).strip(" -")
        groups, at = [], 0
        for part in run.replace("-", " ").split(" "):
            groups.append((at, at + len(part)))
            at += len(part) + 1
        want = []
        for g, (a, _) in enumerate(groups):
            fits = [b for _, b in groups[g:] for d in ["".join(c for c in run[a:b] if c.isdigit())]
                    if 13 <= len(d) <= 19 and luhn(d) % 10 == 0 and len(set(d)) > 1]
            want += [(a, fits[-1])] if fits else []
        assert list(zip(*(x.tolist() for x in pii.card_windows(run)), strict=True)) == want


def test_a_key_is_required_and_the_query_takes_it_from_the_session(spark, tmp_path):
    with pytest.raises(TypeError):
        pii.pseudonymize(table(spark))
    table(spark, [(1, "on 2024-01-31")], extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.unset(queries.PSEUDONYM_KEY)
    own = queries.pseudonym_key(spark)
    assert len(own) == 32 and own == queries.pseudonym_key(spark)
    spark.conf.set(queries.PSEUDONYM_KEY, "given")
    assert queries.op8_pseudonyms(spark, str(tmp_path)).first()["text"] == pii.Pseudonymizer(b"given")("on 2024-01-31")[0]
    spark.conf.unset(queries.PSEUDONYM_KEY)
