import math
import random

import numpy as np
import pytest
from helpers import got, order
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm import negatives, smallworld
from cohortlens.llm.covertree import LEAF, CoverTree
from cohortlens.llm.vectors import on_sphere

AWKWARD = [
    (None, [1.0, 0.5, 0.25, 0.0], 1), (701, None, 1), (702, [], 1), (703, [1.0, None, 0.0, 0.0], 1), (704, [1.0, math.nan, 0.0, 0.0], 2),
    (705, [math.inf, 0.0, 0.0, 0.0], 2), (706, [0.5, 0.5, 0.5, 0.5], None), (800, [0.0, 0.0, 0.0, 0.0], 1), (900, [1.0, 1.0], 1),
    (901, [1.0, 0.5], 1), (902, [1.0, 0.75], 2), (1000, [0.5, 0.5, 0.5, -0.5], 2), (1000, [0.5, 0.5, 0.5, -0.5], 2), (1000, [0.5, 0.25, 0.5, -0.5], 2),
]


def rows_of(seed, n=260, wide=4):
    """Few distinct values, so that scores tie and vectors repeat."""
    rng = random.Random(seed)
    out = [(i, [rng.choice([-1.0, -0.3, 0.0, 0.26, 0.51, 0.9]) for _ in range(wide)], rng.randint(0, 3)) for i in range(n)]
    return out + [(2000 + i, out[5][1], out[5][2]) for i in range(30)]


def vectors(spark, rows):
    fields = [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]
    fields += [T.StructField(n, T.StringType()) for n in ("VEC_ID", "id", "vector", "shard", "spot", "score", "_c0")]
    return spark.createDataFrame([(*r, *["z"] * 7) for r in rows], T.StructType(fields))


def usable(rows):
    rows = [(i, tuple(np.float32(x) if x is not None else None for x in v or ()), c) for i, v, c in rows]
    return sorted({(i, v, c) for i, v, c in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)},
                  key=lambda r: (r[0], r[1], str(r[2])))


def mined(rows, every, k):
    rows = [(i, tuple(math.floor(256 * float(x)) for x in v), c) for i, v, c in usable(rows) if c is not None]
    rows = sorted(set(rows))
    out = []
    for i, v, c in rows:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, d) for j, w, d in rows if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == c][:k]:
            fits = [(t, m) for t, m, d in scored if d != c and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(i, j, r, m, -s, -t) for r, (t, m) in enumerate(fits, 1)]
    return out


@pytest.mark.parametrize(("shard", "block", "k"), [(8192, 4096, 5), (40, 3, 5), (40, 3, 2)])
def test_negatives_match_brute_force(spark, shard, block, k):
    rows = rows_of(shard) + AWKWARD
    df = negatives.mine(vectors(spark, rows), F.col("id") % 20 == 0, n_positives=k, n_negatives=k, shard_rows=shard, block_rows=block)
    want = mined(rows, 20, k)
    assert len(want) > 60
    assert got(df, "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score") == order(want)


def test_negatives_of_no_rows_and_no_anchors(spark):
    for rows in ([], [(None, None, None)], [(1, [1.0], 1), (2, [1.0], 2)]):
        assert negatives.mine(vectors(spark, rows), F.col("id") % 20 == 0).count() == 0


def test_negatives_beyond_exact_doubles(spark):
    rows = [(0, [1e6, 1.0], 0), (1, [1e6, 1.0], 0), (2, [1e6, 0.999], 1), (3, [1e6, 0.996], 1)]
    df = negatives.mine(vectors(spark, rows), F.col("id") % 20 == 0)
    assert got(df, "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score") == order(mined(rows, 20, 5))


@pytest.mark.parametrize("kind", ["spread", "tight", "equal", "few"])
def test_cover_tree_covers_separates_and_bounds(kind):
    rng = np.random.default_rng(3)
    points = {"spread": rng.normal(size=(500, 8)), "tight": np.concatenate([rng.normal(size=(20, 8)) * 9, rng.normal(size=(300, 8)) * 1e-3]),
              "equal": np.ones((100, 8)), "few": rng.normal(size=(3, 8))}[kind]
    tree = CoverTree.build(points)
    at = on_sphere(points)[tree.order]
    assert sorted(tree.order) == list(range(len(points)))
    for node in range(len(tree.centre)):
        own = at[tree.start[node]:tree.end[node]]
        assert (np.sqrt(((own - at[tree.centre[node]]) ** 2).sum(1)) <= tree.radius[node]).all()
        some = range(tree.first[node], tree.first[node] + tree.children[node])
        if tree.children[node]:
            assert sum(tree.end[c] - tree.start[c] for c in some) == len(own)
            centres = at[tree.centre[list(some)]]
            apart = np.sqrt(((centres[:, None] - centres) ** 2).sum(2)) + 1e9 * np.eye(len(centres))
            assert apart.min() >= tree.radius[list(some)].max() - 1e-6
        else:
            assert len(own) <= LEAF or tree.radius[node] < 1e-6
    query, seen = rng.normal(size=8), []
    tree.descend(points[tree.order], query, lambda low, high: (high >= 0.5) & (low <= 3), lambda p, s: seen.extend(p.tolist()))
    exact = points[tree.order] @ query
    assert set(np.flatnonzero((exact >= 0.5) & (exact <= 3))) <= set(seen) and len(seen) == len(set(seen))


def neighbours(rows, every, k):
    rows = [(i, v) for i, v in sorted({(i, v) for i, v, _ in usable(rows)}) if any(v)]
    out = []
    for q in sorted({i for i, _ in rows if i % every == 0}):
        scored = sorted((-float((np.array(w, np.float64) * np.array(v, np.float64)).sum()), j)
                        for i, v in rows if i == q for j, w in rows if j != q and len(w) == len(v))
        out += [(q, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize(("shard", "block"), [(16384, 8192), (60, 5)])
def test_nearest_on_small_tables_is_exact(spark, shard, block):
    rows = rows_of(shard) + AWKWARD
    df = smallworld.nearest(vectors(spark, rows), F.col("id") % 20 == 0, k=7, shard_rows=shard, block_rows=block, ask_beam=400)
    have, want = got(df, "query_id", "rank", "vec_id", "score"), order(neighbours(rows, 20, 7))
    assert [h[:3] for h in have] == [w[:3] for w in want]
    assert np.allclose([h[3] for h in have], [w[3] for w in want], rtol=0, atol=1e-12)


def test_nearest_of_no_rows_one_row_and_copies(spark):
    assert smallworld.nearest(vectors(spark, []), F.col("id") % 20 == 0).count() == 0
    assert smallworld.nearest(vectors(spark, [(0, [1.0], 1)]), F.col("id") % 20 == 0).count() == 0
    copies = [(i, [0.5, 0.5], 1) for i in range(500)]
    df = smallworld.nearest(vectors(spark, copies), F.col("id") == 20)
    assert [r.vec_id for r in df.orderBy("rank").collect()] == list(range(20))
    df = smallworld.nearest(vectors(spark, copies), F.col("id") == 3)
    assert [r.vec_id for r in df.orderBy("rank").collect()] == [0, 1, 2, *range(4, 21)]


def test_nearest_recall_with_clusters_and_uneven_norms(spark):
    rng = np.random.default_rng(5)
    spread = rng.normal(size=(2500, 32)) * rng.uniform(0.5, 1.5, size=(2500, 1))
    tight = rng.normal(size=(1, 32)) + rng.normal(size=(700, 32)) * 0.01
    points = np.concatenate([spread, tight]).astype(np.float32)
    rows = [(i, p.tolist(), 0) for i, p in enumerate(points)]
    df = smallworld.nearest(vectors(spark, rows), F.col("id") % 20 == 0, shard_rows=1200)
    have = {}
    for r in df.collect():
        have.setdefault(r.query_id, set()).add(r.vec_id)
    exact = points.astype(np.float64) @ points.astype(np.float64).T
    np.fill_diagonal(exact, -np.inf)
    hits = sum(len(have[q] & set(np.argsort(-exact[q])[:20].tolist())) for q in have)
    assert len(have) == 160 and hits >= 0.95 * 20 * len(have)
