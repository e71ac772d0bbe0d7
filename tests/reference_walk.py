"""Brute-force walks over tiny graphs, to hold the set-oriented ones against."""

from collections import deque


def depth_first(edges, start, depth=None, pruned=frozenset()):
    """(path tuple) of every walk in order; edges: {src: [dst, ...]} in order."""
    found = []

    def go(route):
        if depth is not None and len(route) > depth:
            return
        for dst in edges.get(route[-1], []):
            if dst not in route and dst not in pruned:
                found.append((*route, dst))
                go((*route, dst))

    go((start,))
    return found


def breadth_first(edges, start, pruned=frozenset()):
    seen, queue, found = {start}, deque([start]), []
    while queue:
        at = queue.popleft()
        for dst in edges.get(at, []):
            if dst not in seen:
                seen.add(dst)
                if dst not in pruned:
                    found.append(dst)
                    queue.append(dst)
    return found


def promoted(routes, ok):
    """(route, nearest kept route above or None) of the kept ones."""
    kept = [t for t in routes if ok(t[-1])]
    present = set(kept)
    return [(t, next((t[:n] for n in range(len(t) - 1, 1, -1) if t[:n] in present), None)) for t in kept]
