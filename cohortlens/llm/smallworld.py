"""Nearest neighbours by inner product: a hierarchical navigable small-world graph per shard, results merged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, take
from .vectors import first_ids, flat, is_finite, meet, on_sphere, parts, ranges

#: Points of one graph, and queries that meet it in one task group.
SHARD_ROWS = 16_384
BLOCK_ROWS = 8_192
#: Links of a point in the upper layers; the lowest layer has twice as many.
LINKS = 16
#: Width of the search beam while a graph is built, and when it is asked.
BUILD_BEAM = 64
ASK_BEAM = 160
#: Points or queries whose beams advance together, and the points that each opens in one step.
TOGETHER = 256
OPENED = 4


class Graph:
    """Flat neighbour arrays: ``layers[l]`` holds the links of the points of layer ``l``, -1 where there are fewer.

    Points come in descending order of their top layer, so a layer's points are the first ones.  They are added in
    batches: the beams of a batch descend the layers together, and points of one batch are candidates of each other."""

    def __init__(self, points: np.ndarray, layers: list[np.ndarray]):
        self.points, self.layers = points, layers

    @classmethod
    def build(cls, points: np.ndarray, top: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM) -> Graph:
        """``points`` of equal norms (see ``on_sphere``) with their top layers, in descending order."""
        n = len(points)
        sizes = [int(np.searchsorted(-top, -layer, side="right")) for layer in range(int(top[0]) + 1)] if n else [0]
        graph = cls(points, [np.full((size, 2 * links if not layer else links), -1, np.int32) for layer, size in enumerate(sizes)])
        strength = [np.full(a.shape, -np.inf, np.float32) for a in graph.layers]
        a = min(n, 1)
        while a < n:
            own = int(top[a])
            b = min(a + min(a, TOGETHER), n, int(np.searchsorted(-top, -own, side="right")))
            fresh = np.arange(a, b)
            entry = np.zeros((b - a, 1), np.int64)
            for layer in range(len(sizes) - 1, -1, -1):
                if layer > own:
                    entry, _ = graph._beam(points[fresh], entry, 1, layer, a)
                    continue
                near, score = graph._beam(points[fresh], entry, beam, layer, a)
                entry = near
                fellows = points[fresh] @ points[fresh].T
                np.fill_diagonal(fellows, -np.inf)
                near = np.concatenate([near, np.broadcast_to(fresh, fellows.shape)], axis=1)
                score = np.concatenate([score, fellows], axis=1)
                near[~np.isfinite(score)] = -1
                near, score = _best(near, score, beam)
                chosen = _diverse(points, near, score, links)
                near, score = np.where(chosen, near, -1), np.where(chosen, score, -np.inf)
                near, score = _best(near, score, links)
                wide = near.shape[1]
                graph.layers[layer][a:b, :wide], strength[layer][a:b, :wide] = near, score
                graph._answer(layer, strength[layer], fresh, near, score)
            a = b
        return graph

    def _answer(self, layer: int, strength: np.ndarray, fresh: np.ndarray, near: np.ndarray, score: np.ndarray) -> None:
        """Links back to the points of a batch; a full list keeps its most diverse links."""
        held = near >= 0
        target, source, value = near[held], np.broadcast_to(fresh[:, None], near.shape)[held], score[held]
        if not len(target):
            return
        order = np.lexsort((-value, target))
        target, source, value = target[order], source[order], value[order]
        touched, begin, count = np.unique(target, return_index=True, return_counts=True)
        width = self.layers[layer].shape[1]
        rank = ranges(np.zeros(len(count), np.int64), count)
        row = np.repeat(np.arange(len(touched)), count)
        few = rank < width
        new = np.full((len(touched), width), -1, np.int64)
        weight = np.full((len(touched), width), -np.inf, np.float32)
        new[row[few], rank[few]], weight[row[few], rank[few]] = source[few], value[few]
        for lo in range(0, len(touched), TOGETHER):
            at = touched[lo:lo + TOGETHER]
            all_near = np.concatenate([self.layers[layer][at].astype(np.int64), new[lo:lo + TOGETHER]], axis=1)
            all_score = np.concatenate([strength[at], weight[lo:lo + TOGETHER]], axis=1)
            again = np.zeros(all_near.shape, bool)  # fellows may have linked each other already
            by = np.argsort(all_near, axis=1, kind="stable")
            sorted_ = np.take_along_axis(all_near, by, 1)
            np.put_along_axis(again, by[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], 1)
            all_score[again | (all_near < 0)] = -np.inf
            all_near[again] = -1
            kept, value_ = _best(all_near, all_score, int(np.isfinite(all_score).sum(axis=1).max(initial=1)))
            crowded = np.isfinite(value_).sum(axis=1) > width
            if crowded.any():
                chosen = _diverse(self.points, kept[crowded], value_[crowded], width)
                value_[crowded] = np.where(chosen, value_[crowded], -np.inf)
            kept, value_ = _best(np.where(np.isfinite(value_), kept, -1), value_, width)
            self.layers[layer][at, :kept.shape[1]], strength[at, :kept.shape[1]] = kept, value_
            self.layers[layer][at, kept.shape[1]:], strength[at, kept.shape[1]:] = -1, -np.inf

    def _beam(self, queries: np.ndarray, entry: np.ndarray, width: int, layer: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """The best points found from the entries among the first ``known`` points of a layer, and their scores."""
        links = self.layers[layer]
        known = min(known, len(links))
        n = len(queries)
        rows = np.arange(n)
        seen = np.zeros((n, known), bool)
        seen[rows[:, None], np.where(entry >= 0, entry, 0)] = True
        near = entry.astype(np.int64)
        score = np.where(near >= 0, np.einsum("ijk,ik->ij", self.points[near], queries), -np.inf).astype(np.float32)
        near, score = _best(near, score, width)
        open_ = np.isfinite(score)
        while True:
            active = np.flatnonzero(open_.any(axis=1))
            if not len(active):
                return near, score
            waiting = np.where(open_[active], score[active], -np.inf)
            k = min(OPENED, waiting.shape[1])
            pick = np.argpartition(-waiting, k - 1, axis=1)[:, :k] if k < waiting.shape[1] else np.broadcast_to(np.arange(k), (len(active), k))
            real = np.isfinite(np.take_along_axis(waiting, pick, 1))
            opened = np.where(real, near[active[:, None], pick], -1)
            open_[np.repeat(active, k), pick.ravel()] = False
            found = np.where((opened >= 0)[:, :, None], links[opened], -1).reshape(len(active), -1)
            found = np.sort(found, axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            found[found >= known] = -1
            r, c = np.nonzero(found >= 0)
            v = found[r, c]
            new = ~seen[active[r], v]
            r, c, v = r[new], c[new], v[new]
            seen[active[r], v] = True
            if not len(r):
                continue
            # what is new, pushed to the left of a narrow matrix
            count = np.bincount(r, minlength=len(active))
            place = ranges(np.zeros(len(active), np.int64), count)
            got = np.full((len(active), int(count.max())), -1, np.int64)
            value = np.full(got.shape, -np.inf, np.float32)
            got[r, place], value[r, place] = v, np.einsum("ij,ij->i", self.points[v], queries[active[r]])
            joined, values = np.concatenate([near[active], got], axis=1), np.concatenate([score[active], value], axis=1)
            opens = np.concatenate([open_[active], np.isfinite(value)], axis=1)
            if joined.shape[1] > width:
                keep = np.argpartition(-values, width - 1, axis=1)[:, :width]
                joined, values, opens = (np.take_along_axis(x, keep, 1) for x in (joined, values, opens))
            if joined.shape[1] != near.shape[1]:
                wide = joined.shape[1]
                near, score, open_ = (np.pad(x, ((0, 0), (0, wide - x.shape[1])), constant_values=v) if wide > x.shape[1] else x
                                      for x, v in ((near, -1), (score, -np.inf), (open_, False)))
            near[active, :joined.shape[1]], score[active, :joined.shape[1]], open_[active, :joined.shape[1]] = joined, values, opens

    def ask(self, queries: np.ndarray, width: int = ASK_BEAM) -> np.ndarray:
        """The ``width`` best points found for each query, -1 where there are fewer."""
        n = len(self.points)
        out = np.full((len(queries), width), -1, np.int64)
        for lo in range(0, len(queries), TOGETHER):
            some = queries[lo:lo + TOGETHER]
            entry = np.zeros((len(some), 1), np.int64)
            for layer in range(len(self.layers) - 1, 0, -1):
                entry, _ = self._beam(some, entry, 1, layer, n)
            near, _ = self._beam(some, entry, width, 0, n)
            out[lo:lo + TOGETHER, :near.shape[1]] = near
        return out


def _best(near: np.ndarray, score: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` best of each row, best first."""
    order = np.argsort(-score, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(near, order, 1), np.take_along_axis(score, order, 1)


def _diverse(points: np.ndarray, near: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Which candidates, best first, become links: those nearer to the point than to any chosen one, then the best others."""
    at = points[np.where(near >= 0, near, 0)]
    between = at @ at.transpose(0, 2, 1)
    real = np.isfinite(score)
    closest = np.full(score.shape, -np.inf, np.float32)
    chosen = np.zeros(score.shape, bool)
    for j in range(score.shape[1]):
        take_ = real[:, j] & (closest[:, j] <= score[:, j]) & (chosen.sum(axis=1) < most)
        chosen[:, j] = take_
        closest[take_] = np.maximum(closest[take_], between[take_, j])
    spare = most - chosen.sum(axis=1)
    others = real & ~chosen
    return chosen | (others & (np.cumsum(others, axis=1) <= spare[:, None]))


def nearest(rows: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
            shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, links: int = LINKS, build_beam: int = BUILD_BEAM,
            ask_beam: int = ASK_BEAM) -> DataFrame:
    """Each query's ``k`` nearest other rows as ``(query_id, rank, vec_id, score)``.

    ``is_query`` is a condition on the column ``id``.  Scores are inner products of the original vectors in doubles,
    largest first, ties by smaller id.  Every row is indexed: rows are dealt by hash to shards of about
    ``shard_rows``, and each shard's graph, kept as flat neighbour arrays, answers every block of queries; a query's
    results are merged over shards.  The graphs find neighbours approximately (see the README for the recall);
    ``ask_beam`` trades time for recall.  Vectors get one more component that makes their norms equal, so that the nearest
    point in a graph is the one of largest inner product.

    Rows with a null id, or a vector that is null, empty, zero or holds null or non-finite components take no part.
    Ids count as 64-bit integers; rows that agree in id and vector count once; a row with a query's id is never its
    neighbour; queries that share an id but not the vector are answered apart and ranked together, a neighbour of both
    twice.  Vectors of different lengths are never compared.  Equal vectors are one point with its ``k + 1`` smallest ids, as many as results
    can name.  With fewer than ``k`` candidates all that are found are returned.  Other columns are not read.
    """
    spark = rows.sparkSession
    taken = take(rows, id=id_col, vector=vector_col).withColumn("vector", F.col("vector").cast("array<double>"))
    whole = taken.where(F.col("id").isNotNull() & is_finite(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    whole = whole.withColumn("id", F.col("id").cast("long"))
    ask_beam = max(ask_beam, k + 1)
    with Scratch(spark) as scratch:
        points = scratch.put(first_ids(whole, ["vector"], k + 1), "points")
        queries = scratch.put(whole.where(is_query).distinct(), "queries")
        shards, blocks = parts(points.count(), shard_rows), parts(queries.count(), block_rows)
        placed = points.withColumn("dims", F.size("vector")).withColumn("shard", F.pmod(F.hash("spot"), F.lit(shards)))
        graphs = scratch.put(placed.groupBy("dims", "shard").applyInArrow(lambda t: _graph(t, links, build_beam), _GRAPH), "graphs")
        asking = queries.select(F.col("id").alias("query_id"), "vector", F.size("vector").alias("dims"), F.lit(0).alias("shard"),
                                F.pmod(F.hash("id", "vector"), F.lit(blocks)).alias("block"))

        def answer(graph: pa.Table, asked: pa.Table) -> pa.Table:
            return _answers(graph, asked, k, ask_beam)

        near = meet(graphs, asking, shards, blocks, answer, "query_id long, vec_id long, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return cut(ranked.select("query_id", "rank", "vec_id", "score"))


_GRAPH = "dims int, shard int, vectors array<double>, ids array<long>, n_ids array<int>, sizes array<int>, links array<int>"


def _graph(rows: pa.Table, links: int, beam: int) -> pa.Table:
    """One row: the graph of a shard, its points in descending order of their top layer."""
    # points come in the order of a hash, so top layers that follow the position are random
    rows = rows.take(pa.array(np.argsort(rows.column("spot").to_numpy(), kind="stable")))
    n = len(rows)
    lot = np.random.default_rng(n).random(n)
    top = np.minimum(-np.log(np.maximum(lot, 1e-300)) / np.log(links), 30).astype(np.int64)
    order = np.argsort(-top, kind="stable")
    rows, top = rows.take(pa.array(order)), top[order]
    values, _ = flat(rows.column("vector"))
    vectors = values.reshape(n, -1)
    graph = Graph.build(_unit(on_sphere(vectors)), top, links, beam)
    ids, counts = flat(rows.column("ids"))
    return pa.table({
        "dims": pa.array([vectors.shape[1]], pa.int32()), "shard": rows.column("shard").slice(0, 1).combine_chunks().cast(pa.int32()),
        "vectors": pa.array([values], pa.list_(pa.float64())), "ids": pa.array([ids], pa.list_(pa.int64())),
        "n_ids": pa.array([counts], pa.list_(pa.int32())), "sizes": pa.array([[len(x) for x in graph.layers]], pa.list_(pa.int32())),
        "links": pa.array([np.concatenate([x.ravel() for x in graph.layers])], pa.list_(pa.int32()))})


def _unit(points: np.ndarray) -> np.ndarray:
    """Points of equal norms at norm 1, in the precision of the search."""
    most = np.sqrt((points[:1] ** 2).sum()) if len(points) else 1.0
    return (points / most).astype(np.float32)


def _answers(table: pa.Table, asked: pa.Table, k: int, beam: int) -> pa.Table:
    none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not len(table) or not len(asked):
        return none
    row = {name: flat(table.column(name))[0] for name in ("vectors", "ids", "n_ids", "sizes", "links")}
    vectors = row["vectors"].reshape(len(row["n_ids"]), -1)
    layers, at = [], 0
    wide = len(row["links"]) // (2 * row["sizes"][0] + row["sizes"][1:].sum())
    for i, size in enumerate(row["sizes"]):
        width = 2 * wide if not i else wide
        layers.append(row["links"][at:at + size * width].reshape(size, width))
        at += size * width
    graph = Graph(_unit(on_sphere(vectors)), layers)
    end = np.cumsum(row["n_ids"])
    begin = end - row["n_ids"]
    own = asked.column("query_id").to_numpy()
    values, _ = flat(asked.column("vector"))
    queries = values.reshape(len(own), -1)
    norm = np.sqrt((queries**2).sum(axis=1, keepdims=True))
    found = []
    for lo in range(0, len(own), TOGETHER):
        some = queries[lo:lo + TOGETHER]
        scaled = np.column_stack([some / norm[lo:lo + TOGETHER], np.zeros(len(some))]).astype(np.float32)
        near = graph.ask(scaled, beam)
        r, c = np.nonzero(near >= 0)
        v = near[r, c]
        # without points that have the query's own id alone
        other = (row["ids"][begin[v]] != own[lo + r]) | (row["n_ids"][v] > 1)
        r, v = r[other], v[other]
        score = (vectors[v] * some[r]).sum(axis=1)
        low = row["ids"][np.where(row["ids"][begin[v]] == own[lo + r], begin[v] + 1, begin[v])]
        # the first k points of each query by their lowest other id, then their ids, then the first k of these
        order = np.lexsort((low, -score, r))
        r, v, score = _first(r[order], k, r[order], v[order], score[order])
        count = row["n_ids"][v].astype(np.int64)
        ids = row["ids"][ranges(begin[v].astype(np.int64), count)]
        r, score = np.repeat(r, count), np.repeat(score, count)
        other = ids != own[lo + r]
        r, ids, score = r[other], ids[other], score[other]
        order = np.lexsort((ids, -score, r))
        r, ids, score = _first(r[order], k, r[order], ids[order], score[order])
        found.append((own[lo + r], ids, score))
    return pa.table({name: pa.array(np.concatenate([f[i] for f in found]), kind)
                     for i, (name, kind) in enumerate((("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())))})


def _first(group: np.ndarray, most: int, *columns: np.ndarray) -> list[np.ndarray]:
    """The first ``most`` of each run of equal groups."""
    _, count = np.unique(group, return_counts=True)
    keep = ranges(np.zeros(len(count), np.int64), count) < most
    return [c[keep] for c in columns]
