"""All links of a block of sets, up to connectedness, by one walk over their prefix tree."""

from __future__ import annotations

import numpy as np


def links(size: np.ndarray, sequences: list[np.ndarray], percent: int, group: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places that join what is similar in this block.

    sequences: a set's shared elements as ascending integers, in an order that all sets have in common;
    size: how many elements the whole set has; group: equal for sets that are known to be connected.
    Sets are similar if percent * |union| <= 100 * |intersection|. Every similar pair is connected by
    the pairs that are returned, together with the groups.

    The walk keeps, for the path from the root, how many of its elements every set has, so sets with a
    common beginning share that work. A subtree is left out if, for every set of another group, even all
    its remaining elements would not make the overlap that is needed.
    """
    n = len(sequences)
    found: list[tuple[int, int]] = []
    group = np.unique(group, return_inverse=True)[1]
    if n < 2 or group.max() == 0:
        return found
    flat = np.concatenate(sequences)
    owner = np.repeat(np.arange(n), [len(s) for s in sequences])
    _, element, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = count[element] > 1  # an element of one set adds to no overlap
    owner, element = owner[common], element[common]
    by_element = np.argsort(element, kind="stable")
    holders = owner[by_element]
    begin = np.searchsorted(element[by_element], np.arange(len(count) + 1))
    ends = np.searchsorted(owner, np.arange(n), "right")
    starts = np.append(0, ends[:-1])
    paths = [element[a:b] for a, b in zip(starts, ends)]

    order = sorted(range(n), key=lambda i: paths[i].astype(">i8").tobytes())
    paths = [paths[i] for i in order]
    length = np.array([len(p) for p in paths])
    shared = [0] * n  # with the path before
    for i in range(1, n):
        k = min(length[i], length[i - 1])
        differ = np.flatnonzero(paths[i][:k] != paths[i - 1][:k])
        shared[i] = int(differ[0]) if len(differ) else int(k)
    place = np.array(order)
    own_size = size[place]

    def seen(overlap: np.ndarray, elements: np.ndarray) -> np.ndarray:
        if not len(elements):
            return overlap
        had = np.concatenate([holders[begin[e] : begin[e + 1]] for e in elements.tolist()])
        return overlap + np.bincount(had, minlength=n)

    def leaf(i: int, overlap: np.ndarray) -> None:
        own = place[i]
        enough = (overlap > 0) & ((100 + percent) * overlap >= percent * (own_size[i] + size))
        for other in np.flatnonzero(enough & (group != group[own])):
            if group[other] != group[own]:
                found.append((int(own), int(other)))
                group[group == group[other]] = group[own]

    stack = [(0, n - 1, 0, np.zeros(n, np.int64))]
    while stack:
        first, last, depth, overlap = stack.pop()
        members = place[first : last + 1]
        rest = int(length[first : last + 1].max()) - depth
        possible = (100 + percent) * (overlap + rest) >= percent * (own_size[first : last + 1].min() + size)
        inside = group[members]
        if (inside == inside[0]).all():
            possible &= group != inside[0]
        if not possible.any():
            continue
        if first == last:
            leaf(first, seen(overlap, paths[first][depth:]))
            continue
        upto = min(min(shared[first + 1 : last + 1]), int(length[first]))
        overlap = seen(overlap, paths[first][depth:upto])
        at = first
        while at <= last and length[at] == upto:  # sets that end here
            leaf(at, overlap)
            at += 1
        children = [at] + [i for i in range(at + 1, last + 1) if shared[i] == upto]
        for a, b in zip(children, [*children[1:], last + 1]):
            if a < b and a <= last:
                stack.append((a, b - 1, upto, overlap))
    return found
