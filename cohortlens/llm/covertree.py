"""A cover tree over the candidates of one shard, searched by inner product."""

from __future__ import annotations

import numpy as np

from .vectors import on_sphere, ranges

#: Nodes with so many points or fewer are leaves.
LEAF = 24
#: Ratio of covering radii of neighbouring levels.
BASE = 1.4
#: Frontier nodes that are opened together.
STEP = 256


class CoverTree:
    """Nodes with a centre point and a covering radius; children cover their parent's points.

    A level's radius is a power of ``BASE``.  Within a node, the points farther than the next level's radius from all
    centres so far become centres themselves, so centres of a level are farther apart than its radius.  ``radius``
    holds the distance of the farthest point of a node from its centre, at most the radius of its level.

    Points are kept in tree order: a node's points are ``start`` to ``end``; children of a node are neighbours."""

    ARRAYS = {"order": np.int32, "centre": np.int32, "radius": np.float64, "first": np.int32, "children": np.int32, "start": np.int32, "end": np.int32}

    def __init__(self, **arrays: np.ndarray):
        for name, kind in self.ARRAYS.items():
            setattr(self, name, np.asarray(arrays[name], kind))

    @classmethod
    def build(cls, points: np.ndarray) -> CoverTree:
        n = len(points)
        at = on_sphere(np.asarray(points, np.float64))
        order = np.arange(n)
        away = np.sqrt(((at - at[0]) ** 2).sum(1)) if n else np.zeros(0)
        centre, start, end, radius, first, children = [0], [0], [n], [0.0], [0], [0]
        k = 0
        while k < len(centre):
            a, b = start[k], end[k]
            far = away[a:b].max(initial=0.0)
            radius[k] = far
            if b - a > LEAF and far > 0:
                level = BASE ** (np.ceil(np.log(far) / np.log(BASE)) - 1)
                level = level if level < far else level / BASE
                mine, dist = order[a:b], away[a:b]
                near = dist <= level
                groups = [(centre[k], mine[near], dist[near])]
                rest, gap = mine[~near], dist[~near]
                while len(rest):
                    c = rest[np.argmax(gap)]
                    d = np.sqrt(np.maximum(((at[rest] - at[c]) ** 2).sum(1), 0.0))
                    d[rest == c] = 0.0
                    near = d <= level
                    groups.append((c, rest[near], d[near]))
                    rest, gap = rest[~near], gap[~near]
                groups = [g for g in groups if len(g[1])]
                first[k], children[k] = len(centre), len(groups)
                x = a
                for c, members, d in groups:
                    order[x:x + len(members)], away[x:x + len(members)] = members, d
                    centre.append(int(c))
                    start.append(x)
                    x += len(members)
                    end.append(x)
                    radius.append(0.0)
                    first.append(0)
                    children.append(0)
            k += 1
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        return cls(order=order, centre=back[centre] if n else np.zeros(1), radius=np.array(radius) * (1 + 1e-9) + 1e-9, first=first,
                   children=children, start=start, end=end)

    def descend(self, points: np.ndarray, query: np.ndarray, wanted, verify) -> None:
        """Best-first descent for one query.

        ``points`` are the shard's points in tree order.  ``wanted(low, high)`` tells which score intervals can still
        hold a result; ``verify(places, scores)`` gets the exact scores of the points of opened leaves."""
        if not len(points):
            return
        reach = float(np.sqrt((np.asarray(query, np.float64) ** 2).sum()))

        def interval(nodes):
            score = (points[self.centre[nodes]] @ query).astype(np.float64)
            slack = reach * self.radius[nodes] + 1e-9 * np.abs(score)
            return score - slack, score + slack

        nodes = np.zeros(1, np.int64)
        low, high = interval(nodes)
        while len(nodes):
            keep = wanted(low, high)
            nodes, low, high = nodes[keep], low[keep], high[keep]
            if len(nodes) > STEP:
                best = np.argpartition(-high, STEP)
                now, later = best[:STEP], best[STEP:]
            else:
                now, later = np.arange(len(nodes)), np.zeros(0, np.int64)
            opened = nodes[now]
            inner = opened[self.children[opened] > 0]
            leaves = opened[self.children[opened] == 0]
            if len(leaves):
                places = ranges(self.start[leaves].astype(np.int64), (self.end[leaves] - self.start[leaves]).astype(np.int64))
                verify(places, points[places] @ query)
            fresh = ranges(self.first[inner].astype(np.int64), self.children[inner].astype(np.int64))
            new_low, new_high = interval(fresh)
            nodes = np.concatenate([nodes[later], fresh])
            low, high = np.concatenate([low[later], new_low]), np.concatenate([high[later], new_high])
