"""Anchors-hierarchy metric trees over integer vectors, and assignment of their points to entries.

A tree is built middle-out: about sqrt(n) anchors, each new one the point farthest from its anchor,
take over the points nearer to them (points closer to their old anchor than half the distance of the
two anchors are not even looked at); the balls of the anchors are merged pairwise, smallest merged ball first,
up to one root; anchors with many points get a hierarchy of their own below. Every ball caches the sum
and count of its points, which lie side by side.

An assignment descends from the root with the list of all entries. A ball drops an entry when another
is nearer to all of the ball, and hands the rest on to its children. A ball with one entry left is
owned whole: its cached sum and count go to the entry. Points of leaves are compared with what is left of the list.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

LEAF = 24
SLACK = 1e-9  # of the terms compared, and
GRAIN = 1e-14  # of the coordinates: doubles err by less


@dataclass
class Tree:
    """Balls (the root is the last one) and distinct points, each ball's points side by side."""

    left: np.ndarray  # children, -1 for a leaf
    right: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray
    total: np.ndarray
    count: np.ndarray
    points: np.ndarray
    weight: np.ndarray  # rows of each point

    def arrays(self) -> dict[str, np.ndarray]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def _distance(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    gap = points - center
    return np.sqrt(np.einsum("...i,...i->...", gap, gap))


def anchors(points: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the points of each of about sqrt(n) anchors."""
    n = len(points)
    owner = np.zeros(n, int)
    away = _distance(points, points[0])
    places = [0]
    while len(places) < np.ceil(np.sqrt(n)):
        new = int(away.argmax())
        if away[new] == 0:
            break
        to_anchor = _distance(points[places], points[new])
        look = np.flatnonzero(away > to_anchor[owner] / 2)
        d = _distance(points[look], points[new])
        nearer = d < away[look]
        owner[look[nearer]], away[look[nearer]] = len(places), d[nearer]
        places.append(new)
    return [rows for a in range(len(places)) if len(rows := np.flatnonzero(owner == a))]


def build(points: np.ndarray, weight: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """The tree of distinct integer points with their numbers of rows, and the order it puts them in."""
    balls: list[tuple] = []  # left, right, rows of a leaf, pivot, radius, total, count

    exact = points.astype(float)

    def ball(left, right, rows, total, count, below):
        pivot = total / count
        balls.append((left, right, rows, pivot, _distance(exact[below], pivot).max(), total, count))
        return len(balls) - 1

    def grow(rows: np.ndarray) -> int:
        own = anchors(exact[rows]) if len(rows) > leaf else []
        if len(own) < 2:
            total = (points[rows] * weight[rows, None]).sum(axis=0)
            return ball(-1, -1, rows, total, weight[rows].sum(), rows)
        below = [rows[part] for part in own]
        heads = [grow(part) for part in below]
        k = len(heads)
        pivot = np.array([balls[h][3] for h in heads])
        radius = np.array([balls[h][4] for h in heads])
        count = np.array([float(balls[h][6]) for h in heads])

        def bound(a):
            """Of the radius of every ball merged with ball a (or each with each, for a column of all)."""
            share = count / (count + count[a])  # the merged pivot divides the line between both in proportion
            gap = _distance(pivot, pivot[a])
            return np.maximum(radius + gap * (1 - share), radius[a] + gap * share)

        size = bound(np.arange(k)[:, None])
        np.fill_diagonal(size, np.inf)
        for left in range(k - 1, 0, -1):
            a, b = divmod(int(size.argmin()), k)
            below[a] = np.concatenate([below[a], below[b]])
            heads[a] = ball(heads[a], heads[b], None, balls[heads[a]][5] + balls[heads[b]][5],
                            balls[heads[a]][6] + balls[heads[b]][6], below[a])
            size[b], size[:, b] = np.inf, np.inf
            if left == 1:
                return heads[a]
            _, _, _, pivot[a], radius[a], _, count[a] = balls[heads[a]]
            size[a] = size[:, a] = np.where(np.isinf(size[a]), np.inf, bound(a))

    root = grow(np.arange(len(points)))
    begin, end, order, at, stack = np.zeros(len(balls), int), np.zeros(len(balls), int), [], 0, [(root, False)]
    while stack:
        node, done = stack.pop()
        left, right, rows = balls[node][:3]
        if rows is not None:
            order.append(rows)
            begin[node], at = at, at + len(rows)
            end[node] = at
        elif done:
            begin[node], end[node] = begin[left], end[right]
        else:
            stack += [(node, True), (right, False), (left, False)]
    order = np.concatenate(order)
    grain = GRAIN * float(np.abs(points).max(initial=0))
    return Tree(*(np.array([b[i] for b in balls], np.int32) for i in (0, 1)), begin.astype(np.int32), end.astype(np.int32),
                np.array([b[3] for b in balls]), np.array([b[4] for b in balls]) * (1 + SLACK) + grain,
                np.array([b[5] for b in balls], np.int64), np.array([b[6] for b in balls], np.int64),
                points[order], weight[order]), order


def assign(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Nearest entry of every point (ties to the first entry), and what the descent handed out.

    The second part lists (entry, ball) arrays of the balls that were owned whole and, at the end,
    one pair (entry, point) of the points compared one by one.
    """
    first = np.sort(np.unique(entries, axis=0, return_index=True)[1])  # of equal entries only the first can win
    centers = entries[first].astype(float)
    apart = _distance(centers[:, None], centers[None])
    grain = GRAIN * max(float(np.abs(tree.points).max(initial=0)), float(np.abs(centers).max(initial=0)))
    nearest = np.zeros(len(tree.points), int)
    balls, lists = np.array([len(tree.left) - 1]), np.ones((1, len(first)), bool)
    owned, single_points = [], []
    while len(balls):
        gap = tree.pivot[balls][:, None] - centers[None]
        square = np.where(lists, (gap * gap).sum(axis=2), np.inf)
        best = square.argmin(axis=1)
        low = square[np.arange(len(balls)), best][:, None]
        reach = 2 * tree.radius[balls][:, None] * apart[best]
        with np.errstate(invalid="ignore"):
            error = SLACK * (square + low + reach) + grain * (np.sqrt(square) + np.sqrt(low) + tree.radius[balls][:, None] + 1)
            lists &= ~(square - low > reach + error)
        whole = lists.sum(axis=1) == 1
        owned.append((best[whole], balls[whole]))
        for entry, node in zip(best[whole], balls[whole]):
            nearest[tree.begin[node]:tree.end[node]] = first[entry]
        leaf = ~whole & (tree.left[balls] < 0)
        size = (tree.end - tree.begin)[balls[leaf]]
        ball_of = np.repeat(np.flatnonzero(leaf), size)
        point = np.repeat(tree.begin[balls[leaf]] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(len(ball_of)) \
            if len(ball_of) else np.zeros(0, int)
        at, entry = np.nonzero(lists[ball_of])
        if len(at):
            gap = tree.points[point[at]].astype(np.int64) - entries[first[entry]]
            d = (gap * gap).sum(axis=1)
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            least = np.repeat(np.minimum.reduceat(d, starts), np.diff(np.r_[starts, len(d)]))
            hit = np.flatnonzero(d == least)
            hit = hit[np.r_[True, at[hit][1:] != at[hit][:-1]]]  # ties: the first entry
            nearest[point] = first[entry[hit]]
            single_points.append((entry[hit], point))
        go = ~whole & ~leaf
        balls, lists = np.r_[tree.left[balls[go]], tree.right[balls[go]]], np.concatenate([lists[go], lists[go]])
    singles = tuple(np.concatenate(x) for x in zip(*single_points)) if single_points else (np.zeros(0, int),) * 2
    return nearest, [tuple(np.concatenate([first[o[0]] if i == 0 else o[i] for o in owned]) for i in (0, 1)),
                     (first[singles[0]], singles[1])]


def sums(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry the sum and the number of the rows it owns, from cached balls and single points."""
    _, ((ball_entry, ball), (point_entry, point)) = assign(tree, entries)
    total, count = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    np.add.at(total, ball_entry, tree.total[ball])
    np.add.at(count, ball_entry, tree.count[ball])
    np.add.at(total, point_entry, tree.points[point].astype(np.int64) * tree.weight[point, None])
    np.add.at(count, point_entry, tree.weight[point])
    return total, count
