"""Run-length grammars by recompression, and longest common extensions on them.

A sequence is rewritten again and again: a run of one symbol becomes one symbol (block
compression), then symbols are split into left and right ones and each left-right pair
becomes one symbol (pair compression). Equal stretches are rewritten alike but for their
ends, so two places are compared by climbing to the largest symbols that begin at both,
stepping over equal ones, and coming down again where they differ.

All levels lie behind one another in flat arrays; many extensions are followed at once.
"""

from __future__ import annotations

import numpy as np

from bankrec.llm.tokens import mix

_ROUNDS = 48    # each round leaves about three quarters of the symbols, or ends the grammar


class Grammar:
    """Of a sequence that begins and ends with a symbol that occurs nowhere else."""

    def __init__(self, symbols: np.ndarray) -> None:
        levels = _levels(symbols.astype(np.int64))
        sizes = np.array([len(s) for s, _, _ in levels])
        starts = np.concatenate(([0], np.cumsum(sizes)))
        total = int(starts[-1])
        self.symbol = np.concatenate([s for s, _, _ in levels])
        self.words = np.concatenate([w for _, w, _ in levels])     # length of a symbol in the sequence
        self.parent = np.full(total, -1, np.int32)
        # for each direction: whether a symbol opens its parent, the first child met, and how
        # many equal symbols follow, itself included
        self.opens = (np.zeros(total, bool), np.zeros(total, bool))
        self.child = (np.full(total, -1, np.int32), np.full(total, -1, np.int32))
        self.equal = (np.ones(total, np.int32), np.ones(total, np.int32))
        for level, (symbols, _, owner) in enumerate(levels):
            lo, n = int(starts[level]), len(symbols)
            begin = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
            end = np.concatenate((begin[1:], [n]))
            run = np.repeat(np.arange(len(begin)), end - begin)
            self.equal[0][lo:lo + n] = end[run] - np.arange(n)
            self.equal[1][lo:lo + n] = np.arange(n) - begin[run] + 1
            if owner is not None:
                up = int(starts[level + 1])
                first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                last = np.concatenate((first[1:], [n])) - 1
                self.parent[lo:lo + n] = up + owner
                self.opens[0][lo + first] = True
                self.opens[1][lo + last] = True
                self.child[0][up + np.arange(len(first))] = lo + first
                self.child[1][up + np.arange(len(first))] = lo + last

    def common(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """How far the sequence reads the same from ``a`` and from ``b`` on (``a != b``), both
        included; ``back`` reads towards the beginning."""
        way, step = (1, -1) if back else (0, 1)
        opens, child, equal = self.opens[way], self.child[way], self.equal[way]
        out = np.zeros(len(a), np.int64)
        who, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        climbing = np.ones(len(a), bool)
        while len(who):
            same = self.symbol[a] == self.symbol[b]
            up_a, up_b = self.parent[a], self.parent[b]
            climb = climbing & opens[a] & opens[b] & same
            climb &= self.symbol[up_a] == self.symbol[up_b]
            over = same & ~climb
            count = np.minimum(equal[a], equal[b])[over]
            out[who[over]] += count * self.words[a[over]]
            down = ~same
            down_a, down_b = child[a], child[b]
            a = np.where(climb, up_a, np.where(down, down_a, a))
            b = np.where(climb, up_b, np.where(down, down_b, b))
            a[over] += step * count
            b[over] += step * count
            climbing &= ~down
            stay = a >= 0                       # a word that differs has no child
            if not stay.all():
                who, a, b, climbing = who[stay], a[stay], b[stay], climbing[stay]
        return out


def _levels(symbols: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Symbols, their lengths, and the place of each one's parent on the next level."""
    out = []
    words = np.ones(len(symbols), np.int64)
    names = int(symbols.max()) + 1
    for number in range(2 * _ROUNDS):
        split = _blocks(symbols, names) if number % 2 == 0 else _pairs(symbols, names, number)
        if split is None:
            continue
        owner, above, names = split
        out.append((symbols, words, owner))
        words = np.bincount(owner, words).astype(np.int64)
        symbols = above
        if len(symbols) < 4:
            break
    out.append((symbols, words, None))
    return out


def _blocks(symbols: np.ndarray, names: int) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Each run of one symbol becomes one symbol."""
    begins = np.concatenate(([True], symbols[1:] != symbols[:-1]))
    if begins.all():
        return None
    first = np.flatnonzero(begins)
    length = np.diff(np.concatenate((first, [len(symbols)])))
    above = symbols[first]
    long = np.flatnonzero(length > 1)
    pairs, name = np.unique(above[long] * (len(symbols) + 1) + length[long], return_inverse=True)
    above[long] = names + name
    return np.cumsum(begins) - 1, above, names + len(pairs)


def _pairs(symbols: np.ndarray, names: int, number: int) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Each left symbol followed by a right one becomes one symbol with it."""
    left = (mix(symbols.astype(np.uint64) + np.uint64(number << 40)) & np.uint64(1)).astype(bool)
    ahead = left[:-1] & ~left[1:]
    behind = ~left[:-1] & left[1:]
    joins = np.concatenate((ahead if ahead.sum() >= behind.sum() else behind, [False]))
    if not joins.any():
        return None
    second = np.concatenate(([False], joins[:-1]))
    first = np.flatnonzero(~second)
    above = symbols[first]
    double = np.flatnonzero(joins[first])
    at = first[double]
    pairs, name = np.unique(symbols[at] * names + symbols[at + 1], return_inverse=True)
    above[double] = names + name
    return np.cumsum(~second) - 1, above, names + len(pairs)
