"""Minimum s-t cut of a small labelling problem: terminal capacities and smoothness edges."""

from __future__ import annotations

from collections import deque


def labels(costs: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it is on the source side, so that the sum of costs is least.

    costs: (cost of the source side, cost of the sink side); edges: (a, b, cost
    if a and b differ), none negative. A node whose own preference is worth more
    than all its open edges is settled at once and passes its edges on to its
    neighbours' costs; what is left goes to augmenting paths. Ties go to the sink.
    """
    n = len(costs)
    prefer = [b - a for a, b in costs]  # positive: source
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    bound = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(prefer[i]) > bound[i]:
            side[i] = prefer[i] > 0
            for j, w in near[i].items():
                if side[j] is None:
                    prefer[j] += w if side[i] else -w
                    bound[j] -= w
                    queue.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        reached = source_side(rest, prefer, near, side)
        for i in rest:
            side[i] = i in reached
    return [bool(x) for x in side]


def source_side(nodes: list[int], prefer: list[float], near: list[dict[int, float]], side: list[bool | None]) -> set[int]:
    """Nodes that the source still reaches after a maximum flow.

    Each node that the source feeds looks for the nearest one that can still
    give to the sink. What a node reaches when there is none stays cut off from
    the sink, as no flow enters or leaves it again, and is not searched twice.
    """
    open_nodes, tiny = set(nodes), 1e-12
    spare = {i: prefer[i] for i in nodes}  # what is left of the edge from the source (positive) or to the sink
    cap = {i: {j: w for j, w in near[i].items() if j in open_nodes} for i in nodes}
    cut_off: set[int] = set()
    for source in nodes:
        while spare[source] > tiny and source not in cut_off:
            before: dict[int, int | None] = {source: None}
            queue, end = deque([source]), None
            while queue:
                i = queue.popleft()
                if spare[i] < -tiny:
                    end = i
                    break
                for j, w in cap[i].items():
                    if w > tiny and j not in before and j not in cut_off:
                        before[j] = i
                        queue.append(j)
            if end is None:
                cut_off |= set(before)
                break
            path = [end]
            while before[path[-1]] is not None:
                path.append(before[path[-1]])
            path.reverse()
            flow = min([spare[source], -spare[end], *(cap[a][b] for a, b in zip(path, path[1:]))])
            spare[source] -= flow
            spare[end] += flow
            for a, b in zip(path, path[1:]):
                cap[a][b] -= flow
                cap[b][a] += flow
    return cut_off
