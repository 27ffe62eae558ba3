"""Leiden in one process, as the slow twin of the distributed one."""

from __future__ import annotations

import random
from collections import defaultdict, deque


def leiden(edges: list[tuple], resolution: float, total: float, seed: int = 42) -> dict[str, str]:
    """Communities of one component, links (a, b) or (a, b, weight), by local moving, refinement and aggregation; named by their least node.

    ``total``: weight of the whole graph (the null model's m).
    """
    rng = random.Random(seed)
    names = sorted({x for e in edges for x in e[:2]})
    number = {n: k for k, n in enumerate(names)}
    graph: list[dict[int, float]] = [defaultdict(float) for _ in names]
    degree = [0.0] * len(names)
    for a, b, *weight in edges:
        x, y, w = number[a], number[b], weight[0] if weight else 1.0
        graph[x][y] += w
        if x != y:
            graph[y][x] += w
        degree[x] += w
        degree[y] += w
    member = list(range(len(names)))  # of original nodes in the current level's nodes
    partition = list(range(len(names)))
    for _ in range(20):
        partition = _move(graph, degree, partition, resolution, total, rng)
        refined = _refine(graph, degree, partition, resolution, total, rng)
        groups = sorted(set(refined))
        if len(groups) == len(graph):
            break
        new = {c: k for k, c in enumerate(groups)}
        bigger: list[dict[int, float]] = [defaultdict(float) for _ in groups]
        weights = [0.0] * len(groups)
        for x, near in enumerate(graph):
            weights[new[refined[x]]] += degree[x]
            for y, w in near.items():
                if x <= y or new[refined[x]] != new[refined[y]]:
                    bigger[new[refined[x]]][new[refined[y]]] += w
        start = [0] * len(groups)
        for x in range(len(graph)):
            start[new[refined[x]]] = partition[x]
        ids = {c: k for k, c in enumerate(dict.fromkeys(start))}
        member = [new[refined[m]] for m in member]
        graph, degree, partition = bigger, weights, [ids[c] for c in start]
    found: dict[int, list[str]] = defaultdict(list)
    for name, m in zip(names, member):
        found[partition[m]].append(name)
    return {n: min(c) for c in found.values() for n in c}


def _move(graph: list[dict[int, float]], degree: list[float], partition: list[int], resolution: float, total: float, rng: random.Random) -> list[int]:
    """Move nodes to the neighbouring community of the largest gain until none gains."""
    part, weight, size = list(partition), [0.0] * len(graph), [0] * len(graph)
    for x, c in enumerate(part):
        weight[c] += degree[x]
        size[c] += 1
    free = [c for c, n in enumerate(size) if not n]
    order = list(range(len(graph)))
    rng.shuffle(order)
    queue, waiting = deque(order), set(order)
    while queue:
        x = queue.popleft()
        waiting.discard(x)
        links: dict[int, float] = defaultdict(float)
        for y, w in graph[x].items():
            if y != x:
                links[part[y]] += w
        old = part[x]
        weight[old] -= degree[x]
        size[old] -= 1
        gain = lambda c: links.get(c, 0.0) - resolution * degree[x] * weight[c] / (2 * total)
        best = max(sorted({*links, old}), key=lambda c: (gain(c), c == old))
        if gain(best) < 0:  # alone is better
            while size[old] and size[free[-1]]:
                free.pop()
            best = free[-1] if size[old] else old
        weight[best] += degree[x]
        size[best] += 1
        if best != old:
            part[x] = best
            if not size[old]:
                free.append(old)
            for y in graph[x]:
                if part[y] != best and y not in waiting:
                    queue.append(y)
                    waiting.add(y)
    return part


def _refine(graph: list[dict[int, float]], degree: list[float], partition: list[int], resolution: float, total: float, rng: random.Random) -> list[int]:
    """Merge nodes, starting alone, only inside their community and only along links that gain: parts stay connected."""
    part, weight, size = list(range(len(graph))), dict(enumerate(degree)), dict.fromkeys(range(len(graph)), 1)
    order = list(range(len(graph)))
    rng.shuffle(order)
    for x in order:
        if size[part[x]] > 1:
            continue
        links: dict[int, float] = defaultdict(float)
        for y, w in graph[x].items():
            if y != x and partition[y] == partition[x]:
                links[part[y]] += w
        gains = {c: w - resolution * degree[x] * weight[c] / (2 * total) for c, w in links.items() if c != part[x]}
        if gains and (best := max(sorted(gains), key=gains.get)) is not None and gains[best] >= 0:
            weight[best] += degree[x]
            weight[part[x]] -= degree[x]
            size[best] += 1
            size[part[x]] -= 1
            part[x] = best
    return part
