"""Minimum s-t cuts of small labelling graphs, by contraction and augmenting paths."""

from __future__ import annotations

from collections import deque


def min_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels minimising sum(|unary| of nodes labelled against its sign) + sum(weight of edges cut).

    A positive ``unary`` is the capacity from the source (label True), a negative one that to the sink. Nodes whose
    terminal capacity is at least the sum of their edges keep their label in some minimum cut: they are
    contracted into the terminal, which adds to their neighbours' terminal capacities. What is left
    is solved by shortest augmenting paths. Of several minimum cuts the one with most True labels is returned
    within the part that needs flow; a node without any preference is False.
    """
    n = len(unary)
    u = list(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    total = [sum(x.values()) for x in near]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(u[i]) < total[i] - 1e-12:
            continue
        label[i] = u[i] > 0
        for j, w in near[i].items():
            if label[j] is None:
                u[j] += w if label[i] else -w
                total[j] -= w
                todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in _flow(rest, u, near, label).items():
            label[i] = side
    return [bool(x) for x in label]


def _flow(rest: list[int], u: list[float], near: list[dict[int, float]], label: list[bool | None]) -> dict[int, bool]:
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i in rest:
        room[i] = {j: w for j, w in near[i].items() if label[j] is None}
        room[source][i], room[i][source] = max(u[i], 0.0), 0.0
        room[i][sink], room[sink][i] = max(-u[i], 0.0), 0.0
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            a = queue.popleft()
            for b, free in room[a].items():
                if free > 1e-12 and b not in came:
                    came[b] = a
                    queue.append(b)
        if sink not in came:
            break
        path, b = [], sink
        while b != source:
            path.append((came[b], b))
            b = came[b]
        flow = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= flow
            room[b][a] += flow
    # the largest source side: whatever cannot reach the sink any more
    back, queue = {sink}, deque([sink])
    while queue:
        b = queue.popleft()
        for a in room[b]:
            if a not in back and room[a].get(b, 0.0) > 1e-12:
                back.add(a)
                queue.append(a)
    return {i: i not in back for i in rest}
