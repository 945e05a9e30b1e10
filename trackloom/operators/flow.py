"""Minimum cuts of small flow networks, and the seam between two overlapping clips.

One network is one group (a pair of frames) and is solved whole; groups run in
parallel, the frames of one clip in turn, since each is bound by the seam
before it.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FAR = 1 << 40


class FlowNetwork:
    """Maximum flow by shortest augmenting levels (Dinic); edges have a capacity each way."""

    def __init__(self, nodes: int) -> None:
        self.n = nodes + 2
        self.source, self.sink = nodes, nodes + 1
        self.out: list[list[int]] = [[] for _ in range(self.n)]
        self.to: list[int] = []
        self.cap: list[float] = []
        self.flow = 0.0
        self.marked: set[int] = set()

    def add_node(self) -> int:
        """One more node; the terminals keep their numbers."""
        self.out.append([])
        self.n += 1
        return self.n - 1

    def add_edge(self, i: int, j: int, cap: float, back: float = 0) -> int:
        self.out[i].append(len(self.to))
        self.out[j].append(len(self.to) + 1)
        self.to += [j, i]
        self.cap += [cap, back]
        return len(self.to) - 2

    def add_terminal(self, i: int, source: float, sink: float) -> None:
        if source:
            self.add_edge(self.source, i, source)
        if sink:
            self.add_edge(i, self.sink, sink)

    def mark(self, i: int) -> None:
        """Note a node whose edges changed; the next run continues from the flow that is there."""
        self.marked.add(i)

    def reset(self) -> None:
        """An empty network with as many nodes."""
        self.__init__(self.n - 2)

    def _levels(self) -> list[int]:
        level = [-1] * self.n
        level[self.source] = 0
        queue = deque([self.source])
        while queue:
            i = queue.popleft()
            for e in self.out[i]:
                j = self.to[e]
                if level[j] < 0 and self.cap[e] > 0:
                    level[j] = level[i] + 1
                    queue.append(j)
        return level

    def solve(self) -> float:
        """The flow's value; what an earlier run has pushed stays."""
        to, cap, out, sink = self.to, self.cap, self.out, self.sink
        while (level := self._levels())[sink] >= 0:
            at = [0] * self.n
            path: list[int] = []
            i = self.source
            while True:
                if i == sink:
                    push = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    self.flow += push
                    first = next(k for k, e in enumerate(path) if cap[e] <= 0)
                    i = to[path[first] ^ 1]
                    del path[first:]
                    continue
                while at[i] < len(out[i]):
                    e = out[i][at[i]]
                    if cap[e] > 0 and level[to[e]] == level[i] + 1:
                        break
                    at[i] += 1
                else:
                    if i == self.source:
                        break
                    level[i] = -1
                    i = to[path.pop() ^ 1]
                    continue
                path.append(e)
                i = to[e]
        self.marked.clear()
        return self.flow

    def source_side(self) -> np.ndarray:
        """True for nodes that the source still reaches: its segment of the minimum cut."""
        return np.array([x >= 0 for x in self._levels()])[: self.n - 2] if self.n == self.sink + 1 else np.array([x >= 0 for k, x in enumerate(self._levels()) if k not in (self.source, self.sink)])


def minimum_cuts(edges: DataFrame, terminals: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, node, source_side, flow`` for groups of ``src, dst, cap, rev_cap`` and ``node, source, sink``."""
    kinds = {f.name: f.dataType.simpleString() for f in terminals.schema}

    def solve(key, e: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted({*e["src"], *e["dst"], *t["node"]})
        number = {v: i for i, v in enumerate(nodes)}
        net = FlowNetwork(len(nodes))
        for r in e.sort_values(["src", "dst"]).itertuples():
            net.add_edge(number[r.src], number[r.dst], r.cap, r.rev_cap)
        for r in t.sort_values("node").itertuples():
            net.add_terminal(number[r.node], r.source, r.sink)
        flow = net.solve()
        side = net.source_side()
        return pd.DataFrame({**{k: [v] * len(nodes) for k, v in zip(keys, key, strict=True)}, "node": nodes, "source_side": side, "flow": float(flow)})

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", node long, source_side boolean, flow double"
    return edges.groupBy(*keys).cogroup(terminals.groupBy(*keys)).applyInPandas(solve, schema)


def colour_gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a.astype(float) - b.astype(float)) ** 2).sum(-1))


def seam(a: np.ndarray, b: np.ndarray, edges_a: np.ndarray, edges_b: np.ndarray, cover_a: np.ndarray, cover_b: np.ndarray, before: np.ndarray | None = None, stable: float = 5.0) -> tuple[np.ndarray, float]:
    """Masks (2, H, W), true where the pixel comes from ``b``, for two successive frames, and the cut.

    ``a``, ``b`` are (2, H, W, 3) clips, ``edges`` their edge maps, ``cover`` where they
    have a picture.  Cutting costs the colour gap plus the edges on both
    sides; changing sides from frame to frame costs the gap across time, times
    0.02 ``stable``.  ``before`` binds the first frame to the seam of the last step.
    """
    _, height, width, _ = a.shape
    size = height * width
    net = FlowNetwork(2 * size)
    cost = colour_gap(a, b) + edges_a + edges_b
    for f in (0, 1):
        for y in range(height):
            for x in range(width):
                i = f * size + y * width + x
                if cover_b[f, y, x] and not cover_a[f, y, x]:
                    net.add_terminal(i, 0, FAR)
                elif cover_a[f, y, x] and not cover_b[f, y, x]:
                    net.add_terminal(i, FAR, 0)
                elif f == 0 and before is not None and (cover_a[0, y, x] or cover_b[0, y, x]):
                    net.add_terminal(i, 0 if before[y, x] else FAR, FAR if before[y, x] else 0)
                for dy, dx in ((0, 1), (1, 0)):
                    if y + dy < height and x + dx < width:
                        w = int(cost[f, y, x] + cost[f, y + dy, x + dx])
                        net.add_edge(i, i + dy * width + dx, w, w)
    ahead = (colour_gap(a[0], b[1]) + edges_a[0] + edges_b[1]) * 0.02 * stable
    back = (colour_gap(a[1], b[0]) + edges_a[1] + edges_b[0]) * 0.02 * stable
    for y in range(height):
        for x in range(width):
            i = y * width + x
            net.add_edge(i, i + size, int(ahead[y, x]), int(back[y, x]))
    flow = net.solve()
    return ~net.source_side().reshape(2, height, width), flow


def seam_clip(frames: list[tuple], stable: float = 5.0) -> list[np.ndarray]:
    """Masks of a whole clip: ``frames`` are (a, b, edges_a, edges_b, cover_a, cover_b) in order.
    Each step cuts two frames, the first bound to the seam before."""
    out: list[np.ndarray] = []
    for now, then in zip(frames, frames[1:], strict=False):
        both = [np.stack([x, y]) for x, y in zip(now, then, strict=True)]
        masks, _ = seam(*both, before=out[-1] if out else None, stable=stable)
        out = [*(out[:-1] if out else []), masks[0], masks[1]]
    return out
