"""Hard-negative mining by cover trees over norm-augmented candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, take
from .covertree import CoverTree
from .vectors import first_ids, flat, is_finite, meet, parts

_NONE = np.iinfo(np.int64).max
#: Candidates of one tree, and anchors that meet it in one task group.
SHARD_ROWS = 8_192
BLOCK_ROWS = 4_096


def mine(rows: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         scale: int = 256, n_positives: int = 5, n_negatives: int = 5, low_percent: int = 80, high_percent: int = 100,
         shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each anchor's best positives with the hardest negatives of each.

    Components become ``floor(scale * x)``; scores are inner products of these integers, higher first, ties by
    smaller id.  Positives are an anchor's ``n_positives`` best other rows of its label.  A positive's negatives are
    the ``n_negatives`` best rows of other labels with ``low_percent * positive <= 100 * negative <= high_percent *
    positive``.  Returns ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.
    ``is_anchor`` is a condition on the column ``id``.

    Every shard of candidates is a cover tree.  Anchors, the stated queries, meet each tree in blocks, first for
    positives, then, with the windows these set, for negatives.  A node's centre score and covering radius bound the
    scores of all its points, so nodes outside the windows, or below what is found already, are skipped; points of
    opened leaves are verified by their exact scores.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part.  Ids count
    as 64-bit integers; rows that agree in all of id, label and vector count once; a row with an anchor's id is never
    its partner; anchors that share an id but not label and vector are answered apart.  Vectors of different lengths are never
    compared.  Scores must fit 64 bits.  Fewer partners than asked give fewer rows, none no row.  Equal vectors of one
    label are one point of a tree with its smallest ids, as many as results can name.  Other columns are not read.
    """
    spark = rows.sparkSession
    taken = take(rows, id=id_col, vector=vector_col, label=label_col)
    whole = taken.withColumn("vector", F.col("vector").cast("array<double>")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & is_finite(F.col("vector")))
    rated = whole.select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"),
                         F.transform("vector", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("vector"))
    names = max(n_positives, n_negatives) + 1
    with Scratch(spark) as scratch:
        points = scratch.put(first_ids(rated, ["label", "vector"], names), "points")
        anchors = scratch.put(rated.where(is_anchor).distinct(), "anchors")
        shards, blocks = parts(points.count(), shard_rows), parts(anchors.count(), block_rows)
        placed = points.withColumn("dims", F.size("vector")).withColumn("shard", F.pmod(F.hash("spot"), F.lit(shards)))
        trees = scratch.put(placed.groupBy("dims", "shard").applyInArrow(_tree, _TREE), "trees")
        spot = F.xxhash64("id", "label", "vector")
        asking = anchors.select(F.col("id").alias("anchor_id"), "label", "vector", F.size("vector").alias("dims"), spot.alias("anchor"),
                                F.pmod(F.hash(spot), F.lit(blocks)).alias("block"))

        def positives(tree: pa.Table, asked: pa.Table) -> pa.Table:
            return _search(tree, asked, lambda shard, row: shard.positives(row, n_positives), _POSITIVE)

        near = meet(trees, asking, shards, blocks, positives, ", ".join(f"{f} long" for f in _POSITIVE))
        best = Window.partitionBy("anchor", "anchor_id").orderBy(F.desc("positive_score"), "positive_id")
        kept = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n_positives)
        ordered = kept.groupBy("anchor", "anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
        windows = ordered.select("anchor", "anchor_id", F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores"))
        windowed = scratch.put(asking.join(windows, ["anchor", "anchor_id"]), "windows")

        def negatives(tree: pa.Table, asked: pa.Table) -> pa.Table:
            return _search(tree, asked, lambda shard, row: shard.negatives(row, n_negatives, low_percent, high_percent), _NEGATIVE)

        far = meet(trees, windowed, shards, blocks, negatives, ", ".join(f"{f} long" for f in _NEGATIVE))
        hard = Window.partitionBy("anchor", "anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
        found = far.withColumn("rank", F.row_number().over(hard)).where(F.col("rank") <= n_negatives)
        return cut(found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


_POSITIVE = ["anchor", "anchor_id", "positive_id", "positive_score"]
_NEGATIVE = ["anchor", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
_TREE = ("dims int, shard int, labels array<string>, vectors array<long>, ids array<long>, n_ids array<int>, order array<int>, "
         "centre array<int>, radius array<double>, first array<int>, children array<int>, start array<int>, end array<int>")


def _tree(rows: pa.Table) -> pa.Table:
    """One row: the tree of a shard, its points in tree order."""
    values, _ = flat(rows.column("vector"))
    points = values.reshape(len(rows), -1)
    tree = CoverTree.build(points)
    rows = rows.take(pa.array(tree.order))
    ids, counts = flat(rows.column("ids"))
    out = {"dims": pa.array([points.shape[1]], pa.int32()), "shard": rows.column("shard").slice(0, 1).combine_chunks().cast(pa.int32()),
           "labels": pa.array([rows.column("label").to_pylist()], pa.list_(pa.string())),
           "vectors": pa.array([points[tree.order].ravel()], pa.list_(pa.int64())), "ids": pa.array([ids], pa.list_(pa.int64())),
           "n_ids": pa.array([counts], pa.list_(pa.int32()))}
    out |= {name: pa.array([getattr(tree, name)], pa.list_(pa.float64() if kind is np.float64 else pa.int32())) for name, kind in CoverTree.ARRAYS.items()}
    return pa.table(out)


def _search(tree: pa.Table, asked: pa.Table, ask, fields: list[str]) -> pa.Table:
    found = []
    if len(tree) and len(asked):
        shard = _Shard(tree)
        for row in asked.to_batches(max_chunksize=256):
            for one in row.to_pylist():
                found += ask(shard, one)
    return pa.table({f: pa.array([r[i] for r in found], pa.int64()) for i, f in enumerate(fields)})


class _Shard:
    """One tree with its points, searched for one anchor after another."""

    def __init__(self, table: pa.Table):
        row = {name: flat(table.column(name))[0] for name in ("vectors", "ids", "n_ids", *CoverTree.ARRAYS)}
        self.tree = CoverTree(**{name: row[name] for name in CoverTree.ARRAYS})
        whole = row["vectors"].reshape(len(row["n_ids"]), -1)
        self.most = int(np.abs(whole).max(initial=0))
        self.whole, self.real = whole, whole.astype(np.float64)
        self.ids = row["ids"]
        self.end = np.cumsum(row["n_ids"])
        begin = self.end - row["n_ids"]
        self.first = self.ids[begin]
        # the id after the first, where there is one
        self.second = np.where(row["n_ids"] > 1, self.ids[np.minimum(begin + 1, len(self.ids) - 1)], _NONE)
        names = table.column("labels").combine_chunks().flatten().to_pylist()
        self.codes = {name: i for i, name in enumerate(dict.fromkeys(names))}
        self.label = np.array([self.codes[name] for name in names])

    def _points(self, vector: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Points and query in doubles where their scores are exact there, else in 64-bit integers."""
        query = np.array(vector, np.int64)
        if len(query) * float(self.most) * float(np.abs(query).max(initial=0)) < 2.0**53:
            return self.real, query.astype(np.float64)
        return self.whole, query

    def _best(self, places: np.ndarray, scores: np.ndarray, own: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The first points by score and lowest id, without those that have the query's own id alone."""
        low = np.where(self.first[places] == own, self.second[places], self.first[places])
        some = np.lexsort((low, -scores))
        some = some[low[some] != _NONE][:most]
        return places[some], scores[some]

    def _named(self, places: np.ndarray, scores: np.ndarray, own: int, most: int) -> list[tuple[int, int]]:
        """The first (score, id) of points, expanded to their ids."""
        pairs = [(-int(s), int(i)) for p, s in zip(places, scores, strict=True)
                 for i in self.ids[self.end[p - 1] if p else 0:self.end[p]] if i != own]
        return [(-s, i) for s, i in sorted(pairs)[:most]]

    def positives(self, row: dict, most: int) -> list[tuple]:
        code = self.codes.get(row["label"])
        if code is None:
            return []
        points, query = self._points(row["vector"])
        places, scores = np.zeros(0, np.int64), np.zeros(0, query.dtype)

        def wanted(_, high):
            # a point of the same score may have a lower id
            return high >= scores[-1] if len(scores) >= most else np.ones(len(high), bool)

        def verify(at, score):
            nonlocal places, scores
            same = self.label[at] == code
            places, scores = self._best(np.concatenate([places, at[same]]), np.concatenate([scores, score[same]]), row["anchor_id"], most)

        self.tree.descend(points, query, wanted, verify)
        return [(row["anchor"], row["anchor_id"], i, s) for s, i in self._named(places, scores.astype(np.int64), row["anchor_id"], most)]

    def negatives(self, row: dict, most: int, low_percent: int, high_percent: int) -> list[tuple]:
        points, query = self._points(row["vector"])
        code = self.codes.get(row["label"], -1)
        bounds = [(-((-low_percent * s) // 100), (high_percent * s) // 100) for s in row["positive_scores"]]
        windows = [w for w in dict.fromkeys(bounds) if w[0] <= w[1]]
        if not windows:
            return []
        low, high = (np.array([w[i] for w in windows], np.int64) for i in (0, 1))
        floor = low.copy()  # below it a window has its results
        none = np.zeros(0, np.int64)
        held = [(none, none)] * len(windows)

        def wanted(least, best):
            return ((least[:, None] <= high) & (best[:, None] >= floor)).any(axis=1)

        def verify(at, score):
            score = score.astype(np.int64)
            some = (self.label[at] != code) & (score >= floor.min()) & (score <= high.max())
            at, score = at[some], score[some]
            for k in range(len(windows)):
                fits = (score >= floor[k]) & (score <= high[k])
                if fits.any():
                    held[k] = self._best(np.concatenate([held[k][0], at[fits]]), np.concatenate([held[k][1], score[fits]]), row["anchor_id"], most)
                    if len(held[k][1]) >= most:
                        floor[k] = max(floor[k], held[k][1][-1])

        self.tree.descend(points, query, wanted, verify)
        named = {w: self._named(*held[k], row["anchor_id"], most) for k, w in enumerate(windows)}
        return [(row["anchor"], row["anchor_id"], place, p, s, i, score)
                for place, (p, s, w) in enumerate(zip(row["positive_ids"], row["positive_scores"], bounds, strict=True), 1)
                for score, i in named.get(w, ())]
