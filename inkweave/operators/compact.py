"""Graph algorithms on arrays, for graphs of a counted size that fit one task.

The distributed operators hand over to these once a graph has at most ``ONE_TASK_EDGES`` edges; the edges go to one executor
task, never to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ONE_TASK_EDGES = 250_000


def in_one_task(df: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` on all rows of ``df`` in a single task; only for tables whose size was counted."""
    names = df.columns

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from run(pa.Table.from_batches(held).select(names)).to_batches()

    return df.repartition(1).mapInArrow(whole, schema)


class Arrays:
    """An undirected graph: sorted node names, and for each node its neighbours (with weights)."""

    def __init__(self, a: list, b: list, w: np.ndarray | None = None):
        n = len(a)
        self.names, at = np.unique(np.array([*a, *b], dtype=object), return_inverse=True)
        u, v = at[:n], at[n:]
        node, other = np.r_[u, v], np.r_[v, u]
        order = np.lexsort((other, node))
        self.other = other[order]
        self.weight = None if w is None else np.r_[w, w][order]
        self.first = np.searchsorted(node[order], np.arange(len(self.names) + 1))

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``nodes``, neighbour) of all edges of some nodes."""
        count = self.first[nodes + 1] - self.first[nodes]
        at = np.repeat(np.arange(len(nodes)), count)
        within = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        return at, self.other[self.first[nodes][at] + within]


def hops(g: Arrays, start: np.ndarray) -> np.ndarray:
    """Edges on the shortest path from the nearest start node, -1 where there is none."""
    far = np.full(len(g.names), -1)
    far[start] = 0
    front, n = np.unique(start), 0
    while len(front):
        n += 1
        near = np.unique(g.of(front)[1])
        front = near[far[near] < 0]
        far[front] = n
    return far


def least_connected(g: Arrays) -> np.ndarray:
    """Each node's least connected node, by number."""
    node = np.repeat(np.arange(len(g.names)), np.diff(g.first))
    root = np.arange(len(g.names))
    while True:
        low = root.copy()
        np.minimum.at(low, node, root[g.other])
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


def betweenness(g: Arrays, sources: np.ndarray) -> np.ndarray:
    """Sums of the sources' dependencies on each node (a source isn't between)."""
    total = np.zeros(len(g.names))
    for s in sources:
        far = np.full(len(g.names), -1)
        paths = np.zeros(len(g.names))
        far[s], paths[s] = 0, 1
        levels = [np.array([s])]
        while len(levels[-1]):
            at, near = g.of(levels[-1])
            new = far[near] < 0
            nxt = np.unique(near[new])
            np.add.at(paths, near[new], paths[levels[-1]][at[new]])
            far[nxt] = len(levels)
            levels.append(nxt)
        owed = np.zeros(len(g.names))
        for level in levels[:0:-1]:
            if not len(level):
                continue
            at, near = g.of(level)
            up = far[near] == far[level[0]] - 1
            share = (1 + owed[level]) / paths[level]
            np.add.at(owed, near[up], paths[near[up]] * share[at[up]])
        owed[s] = 0
        total += owed
    return total


def louvain(g: Arrays, resolution: float) -> np.ndarray:
    """Each node's community by Louvain's moves, nodes in their order, as the least node's number."""
    n = len(g.names)
    member = np.arange(n)
    assert g.weight is not None
    near: list[dict[int, float]] = [{} for _ in range(n)]
    node = np.repeat(np.arange(n), np.diff(g.first))
    loops = [0.0] * n
    for u, v, w in zip(node.tolist(), g.other.tolist(), g.weight.tolist()):
        if u == v:
            loops[u] += w
        else:
            near[u][v] = near[u].get(v, 0.0) + w
    double = float(g.weight.sum())
    while double > 0:
        strength = [sum(d.values()) + l for d, l in zip(near, loops)]
        label, held = list(range(len(near))), strength.copy()
        moved, again = False, True
        while again:
            again = False
            for u, d in enumerate(near):
                own = label[u]
                held[own] -= strength[u]
                to: dict[int, float] = {own: 0.0}
                for v, w in d.items():
                    to[label[v]] = to.get(label[v], 0.0) + w
                gain = {c: round(w - resolution * strength[u] * held[c] / double, 9) for c, w in to.items()}
                best = min(gain, key=lambda c: (-gain[c], c != own, c))
                held[best] += strength[u]
                if best != own:
                    label[u], moved, again = best, True, True
        if not moved:
            break
        names, label_at = np.unique(label, return_inverse=True)
        member = label_at[member]
        grown: list[dict[int, float]] = [{} for _ in names]
        loop = [0.0] * len(names)
        for u, d in enumerate(near):
            a = int(label_at[u])
            loop[a] += loops[u]
            for v, w in d.items():
                b = int(label_at[v])
                if a == b:
                    loop[a] += w
                else:
                    grown[a][b] = grown[a].get(b, 0.0) + w
        near, loops = grown, loop
    least = np.full(member.max() + 1 if n else 0, n)
    np.minimum.at(least, member, np.arange(n))
    return least[member]
