"""Spans of a benchmark are cut alike, whatever blocks its items are taken in."""

import time

import numpy as np
import pytest
from helpers import AWKWARD, got, order, table
from test_benchmark_pii_toxicity import contaminated, words_of

from cohortlens.llm import decontaminate


def word(name, n):
    return [f"{name}{i}" for i in range(n)]


def left_of(text, items, window):
    """Words that are left, and words cut, when all items are searched at once until no window is left."""
    words, gone = words_of(text), 0
    windows = set()
    for _, item in items:
        w = words_of(item)
        k = min(window, len(w))
        windows |= {tuple(w[i:i + k]) for i in range(len(w) - k + 1) if k}
    while True:
        hit = {j for t in windows for i in range(len(words) - len(t) + 1) if tuple(words[i:i + len(t)]) == t for j in range(i, i + len(t))}
        if not hit:
            return words, gone
        words, gone = [w for i, w in enumerate(words) if i not in hit], gone + len(hit)


@pytest.mark.parametrize("coverage", [0.5, 1.0])
@pytest.mark.parametrize("block", [60, 1 << 20])
def test_blocks_make_no_difference(spark, block, coverage):
    a, b, c, d = word("a", 6), word("b", 6), word("c", 6), word("d", 6)
    items = [(1, " ".join(a)), (2, " ".join(a[3:] + b[:3])), (3, " ".join(c)), (4, " ".join(d[:4]))]
    fill = word("n", 14)
    docs = [(20, " ".join(fill + a + b[:3] + fill)),  # windows of two items overlap
            (21, " ".join(fill + c[:3] + d[:4] + c[3:] + fill)),  # cutting one joins up another
            (22, " ".join(d[:4] + fill[:3] + c + fill[:2])),  # 10 of 15 words by two items, each of them below half
            (23, " ".join(fill)), (24, " ".join(a[:3] + d[:4] + a[3:])), *[(25, " ".join(fill + c))] * 3]
    docs += contaminated(5)[0][:30] + AWKWARD
    items += [i for i in contaminated(5)[1] if i[0] is not None]
    asked = spark.createDataFrame(items, "item_id long, text string")
    df = decontaminate.remove(table(spark, docs), asked, window=4, max_coverage=coverage, block_bytes=block)
    want = []
    for i, text in docs:
        words, gone = left_of(text, items, 4)
        if gone <= coverage * len(words_of(text)):
            want.append((i, " ".join(words)))
    assert df.columns == table(spark).columns
    assert order([(i, " ".join(words_of(t))) for i, t in got(df, "doc_id", "text")]) == order(want)


def test_a_thousand_nested_passages_are_cut():
    scan = decontaminate.Scan([("a", [b"x", b"y"])], 4)
    text = np.frombuffer(b"x " * 1500 + b"z " + b"x " * 1200 + b"y " * 1200 + b"end", np.uint8)
    out, hit, counts = scan.clean(text, np.array([0, len(text)]))
    assert hit.tolist() == [2400] and counts.tolist() == [3902] and out[0].split() == [b"x"] * 1500 + [b"z", b"end"]


def test_repetitive_items_take_linear_time():
    start = time.monotonic()
    automaton = decontaminate.Automaton.of([("equal", [b"word"] * 200_000), ("short", [b"word"] * 4), ("two", [b"a", b"b"] * 20_000)], 10)
    matched, hit, found = automaton.stream([b"word"] * 100_000 + [b"x"] + [b"word"] * 4 + [b"x"] + [b"b", b"a"] * 5)
    assert time.monotonic() - start < 30
    assert matched.max() == 100_000 and found == {"equal", "short", "two"}
    assert hit.tolist() == [True] * 100_000 + [False] + [True] * 4 + [False] + [True] * 10
