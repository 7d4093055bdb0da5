"""Whole licence texts, their openings and notices, against a search by plain Python."""

import random
import re
import textwrap
import unicodedata

import pytest
from helpers import AWKWARD, got, order, table

from cohortlens.llm import licences

# spellings on their own, one word to another
SAME = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "organisation": "organization", "favour": "favor",
        "fulfil": "fulfill", "https": "http", "ver": "version"}


def words_of(line):
    out, word = [], ""
    for c in line.lower() + " ":
        if unicodedata.category(c)[0] in "LN":
            word += c
        elif word:
            out += {"v2": ["version", "2"], "v3": ["version", "3"]}.get(word, [SAME.get(word, word)])
            word = ""
    return out


def lines_of(text):
    out = []
    for line in (text or "").split("\n"):
        low = line.lower().lstrip(" \t")
        low = "copyright " + re.sub(r"^(\(c\)|©)", "", low) if low.startswith(("(c)", "©")) else low
        clause = re.match(r"copyright\b", low) and (words_of(low) + [""])[1] not in licences.NO_CLAUSE.split()
        parts = [low]
        if clause:
            parts = re.split(r"[.;][ \t]+", low)
            grants = [i for i, p in enumerate(parts) if any(w.startswith(("licen", "permi", "redistrib", "spdx")) for w in words_of(p)) or "public domain" in p]
            parts = parts[grants[0]:] if grants else []
        out += [w for w in map(words_of, parts) if w and not (w[0] == "copyright" and (w + [""])[1] not in licences.NO_CLAUSE.split())]
    return out


def search(text, known):
    lines = lines_of(text)
    flat = [w for line in lines for w in line]
    starts = [sum(map(len, lines[:i])) for i in range(len(lines) + 1)]
    whole, names, where = set(), set(), set()
    texts = {}
    for name, body in known:
        texts.setdefault(tuple(w for line in lines_of(body) for w in line), set()).add(name)
    openings = {}
    for body, found in texts.items():
        if len(body) > licences.OPENING:
            openings.setdefault(body[:licences.OPENING], set()).update(found)
    for at in starts[:-1]:
        full = [b for b in texts if b and tuple(flat[at:at + len(b)]) == b and at + len(b) in starts]
        opens = [o for o in openings if tuple(flat[at:at + len(o)]) == o]
        names |= {min(texts[b]) for b in full} | ({"|".join(sorted(openings[o])) for o in opens} if not full else set())
        whole |= {min(texts[b]) for b in full if at == 0 and len(b) == len(flat)}
        where |= {at} if full or opens else set()
    return min(whole, default=None), ",".join(sorted(names)), len(where)


def spellings(rng, text):
    """The same text in another dress."""
    text = re.sub(r"\s+", " ", text)
    text = textwrap.fill(text, rng.choice([30, 72, 5000]), break_long_words=False, break_on_hyphens=False)
    text = rng.choice([str, str.upper, lambda s: re.sub(r"\blicense\b", "licence", s), lambda s: s.replace(",", " ;").replace('"', "“")])(text)
    return rng.choice(["", "Copyright (c) 2020 Some One\n", "© 2021 A. B. Sea Inc. All rights reserved.\n\n", "Copyright 2019 X. "]) + text


@pytest.mark.parametrize("block", [1000, 7])
def test_every_known_text_opening_and_notice_is_found(spark, block):
    rng = random.Random(block)
    docs = []
    for name, text in licences.KNOWN:
        docs += [(len(docs) + k, t) for k, t in enumerate([
            spellings(rng, text), "A word before.\n" + spellings(rng, text), spellings(rng, text) + "\nSomething else", "prose " + text,
            " ".join(text.split()[:rng.choice([5, 21, 30, 60])]) + "\nand on", " ".join(text.split()[1:])])]
    docs += [(5000, "\n".join(t for _, t in licences.KNOWN)), (5001, "Released under the MIT License " * 3)]
    df = licences.scan_licences(table(spark, docs + AWKWARD), licences.known_digests(spark), block_entries=block)
    want = [(i, *search(t, licences.KNOWN)) for i, t in docs + AWKWARD]
    assert got(df, "doc_id", "text_licence", "line_licences", "n_licence_lines") == order(want)
    found = {w[0]: w for w in want[:len(docs)]}
    for k, (name, text) in enumerate(licences.KNOWN):
        own = min(n for n, t in licences.KNOWN if lines_of(t) and sum(lines_of(t), []) == sum(lines_of(text), []))
        assert found[6 * k][1] == own and own in found[6 * k + 1][2].split(",") and own in found[6 * k + 2][2].split(",")


def test_openings_and_lines_after_a_clause(spark):
    mit = dict(licences.TEXTS)["MIT"]
    docs = [(1, " ".join(mit.split()[:25])), (2, "Copyright 2020 X. Licensed under the MIT License"), (3, "Copyright (c) 2020 A. B. Smith; released under the MIT License"),
            (4, "copyright holders may differ"), (5, mit)]
    df = licences.scan_licences(table(spark, docs), licences.known_digests(spark))
    assert got(df, "doc_id", "text_licence", "line_licences", "n_licence_lines") == [
        (1, None, "MIT|MIT-0", 1), (2, "MIT", "MIT", 1), (3, "MIT", "MIT", 1), (4, None, "", 0), (5, "MIT", "MIT", 1)]
