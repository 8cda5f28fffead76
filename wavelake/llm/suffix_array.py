"""Suffix arrays by induced sorting, on whole numpy arrays, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The last symbol is the smallest and stands once."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    nxt = np.searchsorted(differs, np.arange(n - 1))
    out = np.ones(n, bool)
    at = differs[np.minimum(nxt, len(differs) - 1)]
    out[:-1] = text[at] < text[at + 1]
    return out


class _Buckets:
    """For each symbol, arrays of positions in the order they came."""

    def __init__(self, symbols: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(symbols)]

    def deal(self, positions: np.ndarray, symbol: np.ndarray) -> None:
        if len(positions) == 0:
            return
        order = np.argsort(symbol, kind="stable")
        positions, symbol = positions[order], symbol[order]
        cuts = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
        for a, b, c in zip(cuts.tolist(), [*cuts[1:].tolist(), len(symbol)], symbol[cuts].tolist(), strict=True):
            self.parts[c].append(positions[a:b])

    def take(self, c: int) -> np.ndarray:
        parts, self.parts[c] = self.parts[c], []
        return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.int64)


def _sweep(text: np.ndarray, small: np.ndarray, buckets: _Buckets, symbols: range, kind: bool, after: list[np.ndarray]) -> list[np.ndarray]:
    """One pass of induction. A symbol's bucket is read front by front: predecessors of the front that belong to the same bucket are its next front, others
    go to buckets that are still to come; then the positions of the other type (after) give theirs. Work is linear in the text."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(after)

    def send(front: np.ndarray, c: int | None) -> np.ndarray:
        before = front[front > 0] - 1
        before = before[small[before] == kind]
        symbol = text[before]
        if c is None:
            buckets.deal(before, symbol)
            return before[:0]
        same = symbol == c
        buckets.deal(before[~same], symbol[~same])
        return before[same]

    for c in symbols:
        front, done = buckets.take(c), []
        while len(front):
            done.append(front)
            front = send(front, c)
        out[c] = np.concatenate(done) if done else front
        if len(after[c]):
            send(after[c], None)
    return out


def induce(text: np.ndarray, small: np.ndarray, symbols: int, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes in order, from leftmost-smaller ones in order (or, to sort their substrings, in any order within a symbol)."""
    start = _Buckets(symbols)
    start.deal(leftmost, text[leftmost])
    given = [start.take(c) for c in range(symbols)]
    large = _sweep(text, small, _Buckets(symbols), range(symbols), False, given)
    buckets = _Buckets(symbols)
    buckets.deal(np.array([len(text) - 1]), text[-1:])
    backwards = [x[::-1] for x in large]
    less = _sweep(text, small, buckets, range(symbols - 1, -1, -1), True, backwards)
    return np.concatenate([x for c in range(symbols) for x in (large[c], less[c][::-1])])


def suffix_array(text: np.ndarray, symbols: int, depth: int | None = None) -> np.ndarray:
    """Positions of all suffixes in order. text ends with symbol 0, which stands nowhere else.

    Suffixes are classified; the substrings between leftmost-smaller positions are sorted by a first induction and named; the names' own suffixes are
    sorted level by level, each level naming pairs of the names before it, so that a name spans twice as much (this takes the place of a recursion on an
    alphabet as large as the text); a second induction sorts all. With depth, suffixes need to be in order of their first depth symbols only.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    small = types(text)
    leftmost = np.flatnonzero(small & np.r_[False, ~small[:-1]])
    order = induce(text, small, symbols, leftmost)
    mark = np.zeros(n, bool)
    mark[leftmost] = True
    order = order[mark[order]]
    where = np.searchsorted(leftmost, order)
    length = np.r_[np.diff(leftmost), 1][where] + 1
    length[where == len(leftmost) - 1] = 1
    new = np.ones(len(order), bool)
    live = np.flatnonzero(length[1:] == length[:-1])
    step = 0
    while len(live):
        same = text[np.minimum(order[live] + step, n - 1)] == text[np.minimum(order[live + 1] + step, n - 1)]
        live = live[same]
        step += 1
        ended = length[live] == step
        new[live[ended] + 1] = False
        live = live[~ended]
    name = np.zeros(len(order), np.int64)
    name[where] = np.cumsum(new)
    span, most = 1, int(name.max())
    while most < len(name) and (depth is None or span < depth):  # a leftmost-smaller substring has two symbols at least
        ahead = np.zeros_like(name)
        ahead[:-span] = name[span:]
        key = name * (most + 1) + ahead
        ranked = np.argsort(key, kind="stable")
        steps = np.r_[1, key[ranked][1:] != key[ranked][:-1]]
        name[ranked] = np.cumsum(steps)
        span, most = 2 * span, int(name.max())
    return induce(text, small, symbols, leftmost[np.argsort(name, kind="stable")])


def common_prefixes(raw: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each position of order, by position, how many bytes (up to most) its suffix shares with that of the one before it."""
    out = np.zeros(len(raw), np.int32)
    a, b = order[1:], order[:-1]
    padded = np.r_[raw, np.zeros(most + 8, np.uint8)]
    word = np.lib.stride_tricks.sliding_window_view(padded, 8)
    live = np.arange(len(a))
    done = 0
    while len(live) and done < most:
        x = np.ascontiguousarray(word[a[live] + done]).view(np.uint64).ravel()
        y = np.ascontiguousarray(word[b[live] + done]).view(np.uint64).ravel()
        odd = x ^ y
        bad = odd != 0
        low = odd[bad] & (~odd[bad] + np.uint64(1))
        out[a[live[bad]]] = done + (np.log2(low.astype(np.float64)).astype(np.int32) >> 3)
        live = live[~bad]
        done += 8
    out[a[live]] = done
    return np.minimum(out, most)
