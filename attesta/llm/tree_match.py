"""Simple tree matching of the block trees of two pages.

The pairs found keep names, parents and order and have the highest score: a pair
with equal texts counts three, others two.  Equal subtrees at both ends of two
lists of children are paired at once, which loses nothing: no other partner
counts more.  The rest is a longest-common-subsequence grid over the children.
Subtrees that differ only in texts that the other page doesn't have at all are of
one kind, and a pair's score depends on the two kinds alone, so it is found once
for each pair of kinds: the rows of a listing have few.  Nothing recurses, so the
depth of the markup doesn't matter; the time grows with the product of the numbers
of kinds in unequal lists of children and, in numpy, of these lists' lengths.
"""

from __future__ import annotations

import numpy as np

#: Lists of up to so many pairs are aligned on a grid in memory; longer ones row by row, of which only some are kept, with the same result.
MOST_PAIRS = 4_000


class Tree:
    """Blocks in order, each before those inside it: the place of the block above, numbers of name and text."""

    __slots__ = ("up", "name", "text", "kids", "size", "whole")

    def __init__(self, up: list[int], name: list[int], text: list[int]):
        n = len(up)
        self.up, self.name, self.text = up, name, text
        self.kids: list[list[int]] = [[] for _ in range(n)]
        self.size = [1] * n
        for i in range(1, n):
            self.kids[up[i]].append(i)
        for i in range(n - 1, 0, -1):
            self.size[up[i]] += self.size[i]
        self.whole = [0] * n  # equal for equal subtrees
        for i in range(n - 1, -1, -1):
            self.whole[i] = hash((name[i], text[i], *[self.whole[k] for k in self.kids[i]]))


def _kinds(tree: Tree, other: set[int], side: str) -> list[int]:
    """For each block the kind of its subtree: its shape and those texts that the ``other`` page has too."""
    out = [hash((name, text if text in other else side)) for name, text in zip(tree.name, tree.text)]
    for i in range(len(out) - 1, -1, -1):
        if kids := tree.kids[i]:
            out[i] = hash((out[i], *[out[k] for k in kids]))
    return out


class _Match:
    def __init__(self, x: Tree, y: Tree):
        self.x, self.y = x, y
        self.scores: dict[tuple[int, int], int] = {}
        self.kx, self.ky = _kinds(x, set(y.text), "x"), _kinds(y, set(x.text), "y")

    def ends(self, i: int, j: int) -> tuple[list[int], list[int], int]:
        """The children of two blocks, and how many equal ones both lists begin and end with: (a, b, first, last)."""
        a, b, wx, wy = self.x.kids[i], self.y.kids[j], self.x.whole, self.y.whole
        most, first, last = min(len(a), len(b)), 0, 0
        while first < most and wx[a[first]] == wy[b[first]]:
            first += 1
        while last < most - first and wx[a[-1 - last]] == wy[b[-1 - last]]:
            last += 1
        return a, b, first, last

    def worth(self, p: int, q: int) -> int:
        x, y = self.x, self.y
        if x.name[p] != y.name[q]:
            return 0
        if x.whole[p] == y.whole[q]:
            return 3 * x.size[p]
        found = self.scores.get((self.kx[p], self.ky[q])) if x.kids[p] and y.kids[q] else None
        return (3 if x.text[p] == y.text[q] else 2) if found is None else found

    def score(self) -> None:
        """Scores of all pairs of kinds of unequal blocks with children whose blocks above may be paired, from below."""
        x, y, kx, ky = self.x, self.y, self.kx, self.ky
        order, known = [(0, 0)], {(kx[0], ky[0])}
        for i, j in order:  # grows while it is read
            a, b, first, last = self.ends(i, j)
            below = {ky[q]: q for q in b[first : len(b) - last] if y.kids[q]}
            for p in {kx[p]: p for p in a[first : len(a) - last] if x.kids[p]}.values() if below else ():
                for q in below.values():
                    if x.name[p] == y.name[q] and x.whole[p] != y.whole[q] and (kx[p], ky[q]) not in known:
                        known.add((kx[p], ky[q]))
                        order.append((p, q))
        # what is inside a block is smaller than it
        for i, j in sorted(order, key=lambda pair: x.size[pair[0]]):
            a, b, first, last = self.ends(i, j)
            ends = [*a[:first], *a[len(a) - last :]]
            a, b = a[first : len(a) - last], b[first : len(b) - last]
            inner = 0
            if a and b:
                inner = self.grid(a, b)[-1][-1] if len(a) * len(b) <= MOST_PAIRS else int(self.last(a, b)[-1])
            self.scores[kx[i], ky[j]] = (3 if x.text[i] == y.text[j] else 2) + 3 * sum(x.size[k] for k in ends) + inner

    def grid(self, a: list[int], b: list[int]) -> list[list[int]]:
        row = [0] * (len(b) + 1)
        grid, xn, yn, worth = [row], self.x.name, [self.y.name[q] for q in b], self.worth
        for p in a:
            new, name = [0], xn[p]
            for k, q in enumerate(b):
                best = row[k + 1] if row[k + 1] >= new[k] else new[k]
                if name == yn[k] and (paired := row[k] + worth(p, q)) > best:
                    best = paired
                new.append(best)
            grid.append(new)
            row = new
        return grid

    def rows(self, row: np.ndarray, a: list[int], b: list[int]):
        """The grid's rows after ``row``, one for each of ``a``."""
        some = {self.ky[q]: q for q in b}
        number = {kind: n for n, kind in enumerate(some)}
        of = np.array([number[self.ky[q]] for q in b], np.int64)
        worths: dict[int, np.ndarray] = {}
        for p in a:
            worth = worths.get(self.kx[p])
            if worth is None:
                worth = worths[self.kx[p]] = np.array([self.worth(p, q) for q in some.values()], np.int64)
            gain = worth[of]
            best = row.copy()
            np.maximum(best[1:], np.where(gain > 0, row[:-1] + gain, 0), out=best[1:])
            row = np.maximum.accumulate(best)
            yield row

    def last(self, a: list[int], b: list[int]) -> np.ndarray:
        row = np.zeros(len(b) + 1, np.int64)
        for row in self.rows(row, a, b):
            pass
        return row

    def paired(self, a: list[int], b: list[int]):
        """The pairs that the grid gives, from the end; a large one is made again piece by piece from rows that were kept."""
        step = max(1, int(len(a) ** 0.5)) if len(a) * len(b) > MOST_PAIRS else len(a) + 1
        kept: list = [np.zeros(len(b) + 1, np.int64)]
        if step <= len(a):
            kept += [row for i, row in enumerate(self.rows(kept[0], a, b), 1) if i % step == 0]
        k = len(b)
        for at in reversed(range(len(kept))):
            piece = a[at * step : (at + 1) * step]
            if not k:
                return
            grid = self.grid(piece, b) if step > len(a) else [kept[at][: k + 1], *self.rows(kept[at][: k + 1], piece, b[:k])]
            i = len(piece)
            while i and k:
                if grid[i][k] == grid[i - 1][k]:
                    i -= 1
                elif grid[i][k] == grid[i][k - 1]:
                    k -= 1
                else:
                    i, k = i - 1, k - 1
                    yield piece[i], b[k]


def align(x: Tree, y: Tree) -> list[int]:
    """For each block of ``x`` the place of its partner in ``y``, or -1."""
    partner = [-1] * len(x.up)
    if x.name[0] != y.name[0]:
        return partner
    if x.whole[0] == y.whole[0]:
        return list(range(len(partner)))
    match = _Match(x, y)
    match.score()
    stack = [(0, 0)]
    while stack:
        i, j = stack.pop()
        if x.whole[i] == y.whole[j]:
            n = x.size[i]
            partner[i : i + n] = range(j, j + n)
            continue
        partner[i] = j
        a, b, first, last = match.ends(i, j)
        stack += zip(a[:first], b[:first])
        stack += zip(a[len(a) - last :], b[len(b) - last :])
        a, b = a[first : len(a) - last], b[first : len(b) - last]
        if a and b:
            stack += match.paired(a, b)
    return partner
