"""Line simplification, convex hulls and resampling on plain point lists, for pandas UDFs and group functions."""

from __future__ import annotations

import math

Point = tuple[float, float]


def simplified(points: list[Point], tolerance: float) -> list[Point]:
    """The fewest points by farthest-point splitting: every left-out point is within tolerance of its chord."""
    if len(points) < 3:
        return list(points)
    keep = {0, len(points) - 1}
    todo = [(0, len(points) - 1)]
    while todo:
        i, j = todo.pop()
        (ax, ay), (bx, by) = points[i], points[j]
        length = math.hypot(bx - ax, by - ay)
        far, at = tolerance, None
        for k in range(i + 1, j):
            px, py = points[k]
            d = abs((bx - ax) * (py - ay) - (by - ay) * (px - ax)) / length if length else math.hypot(px - ax, py - ay)
            if d > far:
                far, at = d, k
        if at is not None:
            keep.add(at)
            todo += [(i, at), (at, j)]
    return [points[k] for k in sorted(keep)]


def hull(points: list[Point]) -> list[Point]:
    """Convex hull, counter-clockwise from the leftmost lowest point, without collinear points."""
    ordered = sorted(set(points))
    if len(ordered) < 3:
        return ordered
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    chains = []
    for side in (ordered, ordered[::-1]):
        chain: list[Point] = []
        for p in side:
            while len(chain) > 1 and turn(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        chains.append(chain[:-1])
    return chains[0] + chains[1]


def at_abscissa(points: list[Point], s: float) -> Point:
    """The point at distance s along a line, its ends beyond."""
    for (ax, ay), (bx, by) in zip(points, points[1:], strict=False):
        d = math.hypot(bx - ax, by - ay)
        if s <= d and d:
            t = max(0.0, s / d)
            return ax + t * (bx - ax), ay + t * (by - ay)
        s -= d
    return points[-1]


def resampled(points: list[Point], step: float) -> list[Point]:
    """Points every step along a line, both ends included."""
    length = sum(math.hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(points, points[1:], strict=False))
    n = max(1, round(length / step))
    return [at_abscissa(points, length * k / n) for k in range(n)] + [points[-1]]


def offset(points: list[Point], d: float) -> list[Point]:
    """A line moved to its left by d, mitred at the vertices."""
    normals = []
    for (ax, ay), (bx, by) in zip(points, points[1:], strict=False):
        l = math.hypot(bx - ax, by - ay) or 1.0  # noqa: E741
        normals.append((-(by - ay) / l, (bx - ax) / l))
    out = []
    for k, (x, y) in enumerate(points):
        a, b = normals[max(0, k - 1)], normals[min(k, len(normals) - 1)]
        m = 1 + a[0] * b[0] + a[1] * b[1]
        f = d / m if m > 0.1 else d / 0.1
        out.append((x + f * (a[0] + b[0]), y + f * (a[1] + b[1])))
    return out
