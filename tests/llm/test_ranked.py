import collections
import math
import random
import re

import pytest
from helpers import AWKWARD, got, order, table

from cohortlens.llm import ranked


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranking(docs, items, k):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if b[t])
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize(("tree", "leaf", "block", "k"), [(4096, 16, 1 << 20, 10), (20, 2, 1 << 20, 3), (20, 3, 200, 10)])
def test_ranking_matches_brute_force(spark, monkeypatch, tree, leaf, block, k):
    monkeypatch.setattr(ranked, "TREE_ROWS", tree)
    monkeypatch.setattr(ranked, "LEAF_ROWS", leaf)
    rng = random.Random(tree + leaf)
    words = ["a", "B", "b", "é", "É", "x1", "2", "漢", "zeta", *(f"w{i}" for i in range(60))]
    docs = [(i, " ".join(rng.choice(words[:rng.choice([6, 69])]) for _ in range(rng.randint(0, 30))) + rng.choice(["", "!", "-a", "\n\n"])) for i in range(150)]
    docs += [(7, docs[9][1]), (9, docs[9][1]), (9, docs[9][1]), (None, docs[9][1]), *AWKWARD]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for i in range(30)]
    items += [(3, items[3][1]), (3, "another text w5"), (None, "w1 w2"), (40, None), (41, " .,; "), (42, "nowhere"), (43, docs[9][1]), (44, "WORD é")]
    df = ranked.search(table(spark, docs), spark.createDataFrame([(n, t, "z", "y") for n, t in items], "item_id long, text string, item string, rank string"),
                       k=k, block_bytes=block)
    want = ranking(docs, items, k)
    assert len(want) > 90
    assert got(df, "item_id", "rank", "doc_id", "score") == order(want)


def test_ranking_of_no_rows(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    some = spark.createDataFrame([("a", "quick word")], "item_id string, text string")
    assert ranked.search(table(spark), none).count() == 0
    assert ranked.search(table(spark, []), some).count() == 0
    df = ranked.search(table(spark, [(1, "quick"), (2, None), (3, "slow and slower")]), some)
    assert [tuple(r) for r in df.collect()] == [("a", 1, 1, ranking([(1, "quick"), (2, None), (3, "slow and slower")], [("a", "quick word")], 10)[0][3])]


def test_bounds_skip_documents_without_changing_results(monkeypatch):
    """Most pairs of documents and items are never scored once every item has its results."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    n, wide = 4000, 300
    terms_ = [np.sort(rng.choice(wide, rng.integers(5, 30), replace=False)) for _ in range(n)]
    tfs = [rng.integers(1, 4, len(t)) for t in terms_]
    # a clear head: some documents hold much of an item
    asked = [np.sort(rng.choice(wide, 20, replace=False)) for _ in range(20)]
    for i in range(400):
        terms_[i * 10] = asked[i % 20][:15]
        tfs[i * 10] = rng.integers(2, 9, 15)
    weight = rng.integers(1, 9000, wide)
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(n)), "n": pa.array([int(t.sum()) for t in tfs]),
                                        "terms": pa.array(terms_, pa.list_(pa.int32())), "tfs": pa.array(tfs, pa.list_(pa.int32()))})
    total = sum(int(t.sum()) for t in tfs)
    scored = []
    plain = ranked.DocumentTree.products

    def watched(self, level, nodes, table, columns):
        scored.append(0 if level else len(nodes) * len(columns))
        return plain(self, level, nodes, table, columns)

    monkeypatch.setattr(ranked.DocumentTree, "products", watched)
    monkeypatch.setattr(ranked, "CELLS", 2000)
    docs = ranked.Documents(batch, n, total, weight)
    have = {}
    trees = ranked.item_trees(asked, weight)
    assert len(trees) > 1 and sorted(i for t in trees for i in t.items) == list(range(20))
    for tree in trees:
        best = ranked.Best(tree, 10)
        best.add(docs.tree(tree.terms))
        for rows in best.rows():
            for r in rows.to_pylist():
                have.setdefault(r["item"], []).append((r["doc_id"], r["score"]))
    for i, a in enumerate(asked):
        scores = []
        for d in range(n):
            m = 10 + (90 * int(tfs[d].sum()) * n) // total
            tf = dict(zip(terms_[d].tolist(), tfs[d].tolist(), strict=True))
            scores.append((-sum(int(weight[t]) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in a.tolist() if t in tf), d))
        assert have[i] == [(d, -s) for s, d in sorted(scores)[:10]]
    assert sum(scored) < 0.6 * n * len(asked)
