import collections
import random
import re

import numpy as np
import pytest
from helpers import AWKWARD, got, order, table

from cohortlens.llm import graph, jaccard, repeats
from cohortlens.llm.suffixes import common_prefixes, suffix_order


def test_suffix_order_and_prefixes_match_sorting():
    rng = random.Random(1)
    for turn in range(1500):
        body = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 40))]
        if turn % 3 == 0:
            body = [rng.randint(1, 2) for _ in range(3)] * rng.randint(1, 9)
        symbols = np.array([*body, 0])
        order_ = suffix_order(symbols)
        text = symbols.tolist()
        assert order_.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        shared = common_prefixes(symbols, order_, 5)
        for r in range(1, len(text)):
            a, b = text[order_[r - 1]:], text[order_[r]:]
            k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared[r] == min(k, 5)


def removed(texts, size):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i:i + size] for r in raws for i in range(len(r) - size + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - size + 1):
            if seen[r[i:i + size]] > 1:
                gone[i:i + size] = b"\1" * size
        spans = sum(1 for i in range(len(r)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, bytes(x for x, g in zip(r, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("crowd", [256, 2])
def test_repeats_match_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "GROUP_PIECES", crowd)  # at 2, groups go through bands and single windows
    rng = random.Random(crowd)
    base = ["".join(rng.choice("ab cé"[:rng.choice([1, 2, 5])]) for _ in range(rng.randint(0, 200))) for _ in range(6)]
    texts = ["".join(rng.choice(base)[rng.randint(0, 50):][:rng.randint(0, 120)] + "".join(rng.choice("xyzw") for _ in range(rng.randint(0, 6)))
                     for _ in range(rng.randint(0, 5))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, "a" * 300), (51, "ab" * 100), (50, texts[3]), (None, texts[4]), (None, None), (52, ""), (3, texts[3])]
    df = repeats.remove_repeats(table(spark, rows), size=24, gram=8)
    want = [(i, *r[:3], bytearray(r[3])) for (i, _), r in zip(rows, removed([t for _, t in rows], 24), strict=True)]
    assert sum(w[2] for w in want) > 1000
    assert got(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == order(want)


def test_repeats_of_awkward_and_no_rows(spark):
    df = repeats.remove_repeats(table(spark))
    want = [(i, *r[:3]) for (i, _), r in zip(AWKWARD, removed([t for _, t in AWKWARD], 400), strict=True)]
    assert got(df, "doc_id", "n_bytes", "n_removed", "n_spans") == order(want)
    assert repeats.remove_repeats(table(spark).limit(0)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (4, 5), (5, 5), (4, 5), (7, 6)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 240)]
    df = graph.components(spark.createDataFrame(edges, "a long, b long"))
    want = {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 7: 6, 6: 6} | {i: 100 for i in range(100, 141)} | {i: 200 for i in range(200, 240)}
    assert {r["node"]: r["label"] for r in df.collect()} == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def linked(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if a and sets[j] and 100 * k >= percent * (len(a) + len(sets[j]) - k):
                head[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    ids = {g: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for g, m in groups.items()}
    return [(rows[i][0], len(sets[i]), ids[find(i)]) for i in range(len(rows))]


def near_copies(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 60, 90]))] for _ in range(8)]
    common = [rng.choice(vocabulary) for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            words += common
        if rng.random() < 0.3:
            words = words + [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        text = " ".join(words)
        rows.append((i, text.upper() if rng.random() < 0.2 else text))
    return rows


@pytest.mark.parametrize("percent", [80, 60])
def test_classes_match_all_pairs(spark, percent):
    rows = near_copies(percent, 220) + AWKWARD + [(None, "a text without an id, but with words enough to make a window of ten")]
    df = jaccard.classes(table(spark, rows), percent=percent)
    want = linked(rows, percent)
    assert len({w[2] for w in want}) < 0.8 * len(want)
    assert got(df, "id", "size", "component") == order(want)


def test_keep_one_leaves_one_row_of_each_class(spark):
    rows = near_copies(3, 120) + AWKWARD + [(2, AWKWARD[1][1])]
    kept = jaccard.keep_one(table(spark, rows))
    assert kept.columns == table(spark).columns
    want = linked(rows)
    expected = [(i, t) for (i, t), (_, size, component) in zip(rows, want, strict=True) if not size or i == component]
    seen, once = set(), []
    for i, t in expected:
        if not shingles(t) or (i, t) not in seen:
            once.append((i, t))
        seen.add((i, t))
    assert got(kept, "doc_id", "text") == order(once)


def test_classes_without_rows_or_words(spark):
    assert jaccard.classes(table(spark).limit(0)).count() == 0
    df = jaccard.classes(table(spark, [(1, None), (2, ""), (3, " \n")]))
    assert got(df, "id", "size", "component") == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    with pytest.raises(ValueError):
        jaccard.classes(table(spark), percent=40)


def test_pieces_of_runs_are_few_and_long_texts_are_cut_in_chunks(monkeypatch):
    rng = random.Random(4)
    for body in (b"a" * 200_000, b"ab" * 100_000, b"0123456789 -\n" * 15_000):
        got_ = list(repeats.cut_pieces(np.frombuffer(body, np.uint8), np.array([0, len(body)]), 400, 128))
        assert sum(len(g[0]) for g in got_) < 50 and sum(int(g[6].sum()) for g in got_) > 10
    body = bytes(rng.randrange(256) for _ in range(30_000)) + b"x" * 9_000
    whole = list(repeats.cut_pieces(np.frombuffer(body, np.uint8), np.array([0, len(body)]), 400, 128))
    monkeypatch.setattr(repeats, "CHUNK", 1 << 10)
    parts = list(repeats.cut_pieces(np.frombuffer(body, np.uint8), np.array([0, len(body)]), 400, 128))
    assert len(whole) == 1 and len(parts) > 30
    # every window of the text is in exactly one piece either way, under the same anchor
    def windows(found):
        out = {}
        for row, low, high, at, anchor, content, copies, reach in found:
            for a, b, p, h, c, r in zip(low, high, at, anchor, copies, reach, strict=True):
                last = b if c == 1 else r
                for w in range(a, last - 400 + 1):
                    assert w not in out
                    out[w] = h
        return out
    assert windows(whole) == windows(parts) and len(windows(whole)) == len(body) - 399


def test_repeats_in_megabytes_of_blanks_and_short_periods(spark):
    head = "".join(chr(97 + (i * 7919) % 26) for i in range(900))
    rows = [(1, " " * 5_000_000), (2, "ab\n" * 400_000 + head), (3, head), (4, " " * 399), (5, " " * 400), (6, "unique " + head[:300])]
    df = repeats.remove_repeats(table(spark, rows))
    want = {1: (5_000_000, 5_000_000, 1), 2: (1_200_900, 1_200_900, 1), 3: (900, 900, 1), 4: (399, 0, 0), 5: (400, 400, 1), 6: (307, 0, 0)}
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in df.collect()} == want
