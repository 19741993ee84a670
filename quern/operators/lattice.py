"""Pixels on a lattice within a task: connected components of tiles, and rings of regions, many groups at once as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pixels of whole groups that are held at once, about.
AT_ONCE = 100_000


def whole(parts: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by keys as tables of about AT_ONCE rows that hold whole groups; a group is held whole."""
    held, n = [], 0
    for part in parts:
        if not part.num_rows:
            continue
        held.append(part)
        n += part.num_rows
        if n < AT_ONCE:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = np.logical_and.reduce([pc.equal(t.column(k), t.column(k)[-1]).to_numpy() for k in keys])
        cut = t.num_rows - int(last.sum())
        if cut:
            yield t.slice(0, cut)
        held, n = t.slice(cut).to_batches(), t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def codes(t: pa.Table, *names: str) -> np.ndarray:
    """A number for each combination of values of some columns."""
    out = np.zeros(t.num_rows, np.int64)
    for name in names:
        own = pc.dictionary_encode(t.column(name).combine_chunks()).indices.to_numpy().astype(np.int64)
        out = np.unique(out * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    return out


def neighbours(group: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pixels and of their right neighbours, and of pixels and of their lower ones, within groups."""
    out = []
    for line, along in ((y, x), (x, y)):
        order = np.lexsort((along, line, group))
        a, b = order[:-1], order[1:]
        at = (group[a] == group[b]) & (line[a] == line[b]) & (along[b] - along[a] == 1)
        out.append((a[at], b[at]))
    return out[0], out[1]


def components(tile: np.ndarray, y: np.ndarray, x: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The smallest pixel number (y * 2**31 + x) of the 4-connected component of one class that each pixel is in within its tile."""
    right, down = neighbours(tile, y, x)
    a, b = np.concatenate([right[0], down[0]]), np.concatenate([right[1], down[1]])
    same = cls[a] == cls[b]
    # Pixels by number, so the smallest label of a component is its smallest pixel.
    order = np.lexsort((x, y))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    a, b, label = place[a[same]], place[b[same]], np.arange(len(order))
    while len(a):
        la, lb = label[a], label[b]
        np.minimum.at(label, la, lb)
        np.minimum.at(label, lb, la)
        while not np.array_equal(after := label[label], label):
            label = after
        left = label[a] != label[b]
        a, b = a[left], b[left]
    return (y.astype(np.int64) * 2**31 + x)[order[label]][place]


#: Steps (x, y) of the directions along the top of a pixel, down its right, back along its bottom and up its left; and where those begin.
_DX, _DY = np.array([1, 0, -1, 0]), np.array([0, 1, 0, -1])
_CX, _CY = np.array([0, 1, 1, 0]), np.array([0, 0, 1, 1])


def rings(region: np.ndarray, y: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """Borders of whole regions: for each ring its region, ring (the smallest number of a side), twice its area and its length; and the corners of all rings in order (px, py), with their number a ring."""
    inner = np.zeros((4, len(y)), bool)
    (a, b), (c, d) = neighbours(region, y, x)
    inner[1, a] = inner[3, b] = inner[2, c] = inner[0, d] = True
    d, at = np.nonzero(~inner)
    g, bx, by = region[at], x[at].astype(np.int64) + _CX[d], y[at].astype(np.int64) + _CY[d]
    ex, ey = bx + _DX[d], by + _DY[d]
    n = len(d)
    # Edges begin where others end; at a corner that two pixels of a region touch in two begin, and a border turns right.
    gs, xs, ys = np.concatenate([g, g]), np.concatenate([bx, ex]), np.concatenate([by, ey])
    order = np.lexsort((ys, xs, gs))
    new = np.ones(2 * n, bool)
    new[1:] = (np.diff(gs[order]) != 0) | (np.diff(xs[order]) != 0) | (np.diff(ys[order]) != 0)
    code = np.empty(2 * n, np.int64)
    code[order] = np.cumsum(new) - 1
    begin, end = code[:n], code[n:]
    sort = np.argsort(begin, kind="stable")
    first = np.searchsorted(begin[sort], end)
    one, two = sort[first], sort[np.minimum(first + 1, n - 1)]
    turn = lambda e: (d[e] - d - 1) % 4
    after = np.where((begin[two] == end) & (turn(two) < turn(one)), two, one)
    # Pointers double until no edge learns of a smaller one of its ring, then from the ring's first edge on.
    number = (by * 2**31 + bx) * 4 + d
    ring, to = np.minimum(number, number[after]), after[after]
    while not np.array_equal(less := np.minimum(ring, ring[to]), ring):
        ring, to = less, to[to]
    back = np.empty(n, np.int64)
    back[after] = np.arange(n)
    head = number == ring
    corner = d[back] != d
    to, rank = np.where(head, np.arange(n), back), (~head).astype(np.int64)
    while not head[to].all():
        rank, to = rank + rank[to], to[to]
    order = np.lexsort((rank, ring, g))
    start = np.flatnonzero(head[order])
    twice = np.add.reduceat((bx * ey - ex * by)[order], start) if n else np.zeros(0, np.int64)
    corners = np.add.reduceat(corner[order].astype(np.int64), start) if n else np.zeros(0, np.int64)
    kept = order[corner[order]]
    return {"at": at[order][start], "ring": ring[order][start], "twice": twice, "length": np.diff(np.append(start, n)), "corners": corners, "px": bx[kept].astype(np.float64), "py": by[kept].astype(np.float64)}
