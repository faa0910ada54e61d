"""Alignment of many token pairs at once.

The cost tables of a block of pairs are filled along their anti-diagonals: a cell needs only the two
anti-diagonals before its own, so that all cells of one anti-diagonal of all pairs are one array. What a
replacement costs is worked out only where a lower bound of it can win. A reordering is found by running
sums: two windows hold the same tokens if the sums of their tokens' random numbers are equal, so a window
that ends in a cell begins where the difference of both sums was the same on the cell's diagonal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np

#: Cells of the padded tables of one block.
CELLS = 1 << 20
MATCH, SUB, INS, DEL = 0, 1, 2, 3
#: Reordering of w tokens is MOVE + w.
MOVE = 2
OPS = "MSID"


def _words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: code points in rows (numbered from 0, -1 behind the end), lengths, and bits of places by number, where they fit."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen, code = np.unique(flat, return_inverse=True)
    width = int(size.max(initial=0))
    rows = np.full((len(texts), width), -1, np.int64)
    start = np.cumsum(size) - size
    place = np.arange(len(flat)) - np.repeat(start, size)
    owner = np.repeat(np.arange(len(texts)), size)
    rows[owner, place] = code
    bits = np.zeros((len(texts), len(seen) + 1), np.uint64)
    fits = place < 64
    np.bitwise_or.at(bits, (owner[fits], code[fits]), np.uint64(1) << place[fits].astype(np.uint64))
    return rows, size, bits


class Texts:
    """Distinct texts, and the likeness of any two of them: 1 - 2 * LCS / (both lengths), taken for many pairs at once."""

    def __init__(self, texts: Sequence[str]) -> None:
        self.texts = list(texts)
        self.rows, self.size, self.bits = _words(self.texts)

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A lower bound of ``distance``, from the lengths."""
        both = self.size[a] + self.size[b]
        return np.abs(self.size[a] - self.size[b]) / np.maximum(both, 1)

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        swap = self.size[a] > self.size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        full = np.where(self.size[a] >= 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(self.size[a], 63).astype(np.uint64)) - np.uint64(1))
        row = full.copy()
        for k in range(int(self.size[b].max(initial=0))):
            on = self.size[b] > k
            hit = row & self.bits[a, self.rows[b, k]]
            row = np.where(on, ((row + hit) | (row - hit)) & full, row)
        common = self.size[a] - np.bitwise_count(row).astype(np.int64)
        for x in np.flatnonzero(self.size[a] > 64).tolist():
            common[x] = _common(self.texts[a[x]], self.texts[b[x]])
        both = self.size[a] + self.size[b]
        return np.where(both == 0, 0.0, 1 - 2 * common / np.maximum(both, 1))


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of any number."""
    places: dict[str, int] = {}
    for k, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def numbered(values: Sequence) -> tuple[list, np.ndarray]:
    """Distinct values in order of appearance, and the number of each value."""
    seen: dict = {}
    at = np.fromiter((seen.setdefault(v, len(seen)) for v in values), np.int64, len(values))
    return list(seen), at


class Costs:
    """Costs of replacing tokens of a vocabulary: what is cheap to know (``least``), and the whole (``cost``).

    ``least`` never exceeds ``cost``; both take arrays of vocabulary numbers.
    """

    def __init__(self, vocabulary: Sequence[tuple]) -> None:
        raise NotImplementedError

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def cost(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        raise NotImplementedError


def _lower_key(token: tuple) -> str:
    return token[0].lower()


def _text_key(token: tuple) -> str:
    return token[0]


def _block(pairs: list[tuple[np.ndarray, np.ndarray]], text: np.ndarray, folded: np.ndarray, costs: Costs | None) -> list[tuple[np.ndarray, ...]]:
    """Steps of each pair of token numbers: kinds and, of both sides, beginnings and ends, in order."""
    count = len(pairs)
    n = np.array([len(s) for s, _ in pairs])
    m = np.array([len(t) for _, t in pairs])
    high, wide = int(n.max()), int(m.max())
    src, tgt = np.zeros((count, high), np.int64), np.zeros((count, wide), np.int64)
    for k, (s, t) in enumerate(pairs):
        src[k, : len(s)], tgt[k, : len(t)] = s, t
    rows = np.arange(count)[:, None]
    cost = np.full((high + wide + 1, count, high + 1), np.inf)  # by anti-diagonal, pair, row
    how = np.zeros((high + wide + 1, count, high + 1), np.int16)
    cost[0, :, 0] = 0.0
    if costs is not None:
        weight = np.random.default_rng(1).integers(0, 1 << 63, int(folded.max(initial=0)) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        sums = [np.concatenate([np.zeros((count, 1), np.uint64), np.cumsum(weight[folded[x]], axis=1, dtype=np.uint64)], axis=1) for x in (src, tgt)]
        first = [_first_seen(folded[x], folded[y], len(y[0])) for x, y in ((src, tgt), (tgt, src))]
        chain = np.zeros((high + wide + 1, count, high + 1), np.int16)  # cells back on the diagonal whose costs all differ from the one before
    for d in range(1, high + wide + 1):
        if d <= wide:
            cost[d, :, 0], how[d, :, 0] = d, INS
        if d <= high:
            cost[d, :, d], how[d, :, d] = d, DEL
        lo, hi = max(1, d - wide), min(high, d - 1)
        if lo > hi:
            continue
        i = np.arange(lo, hi + 1)
        j = d - i
        a, b = src[:, lo - 1 : hi], tgt[:, j - 1]
        before = cost[d - 2, :, lo - 1 : hi] if d > 1 else None
        insert, delete = cost[d - 1, :, lo : hi + 1] + 1, cost[d - 1, :, lo - 1 : hi] + 1
        same = text[a] == text[b]
        other = np.minimum(insert, delete)
        live = ~same & (i[None, :] <= n[:, None]) & (j[None, :] <= m[:, None])
        replaced = np.full(before.shape, np.inf)
        moved = np.full(before.shape, np.inf)
        window = np.zeros(before.shape, np.int16)
        if costs is None:
            replaced = before + 1.0
        else:
            at = np.nonzero(live)
            x, y = a[at], b[at]
            near = before[at] + costs.least(x, y) <= other[at]
            at = tuple(z[near] for z in at)
            if len(at[0]):
                replaced[at] = before[at] + costs.cost(a[at], b[at])
            back = chain[d - 2, :, lo - 1 : hi]
            maybe = live & (back > 0) & (first[0][rows, i - 1] < j - 1) & (first[1][rows, j - 1] < i - 1)
            p, c = np.nonzero(maybe)
            if len(p):
                gap = sums[0][p, i[c]] - sums[1][p, j[c]]
                most = back[p, c].astype(np.int64)
                k = np.ones(len(p), np.int64)
                while len(p):
                    r, q = i[c] - k - 1, j[c] - k - 1
                    hit = (sums[0][p, r] - sums[1][p, q]) == gap
                    if hit.any():
                        moved[p[hit], c[hit]] = cost[(r + q)[hit], p[hit], r[hit]] + k[hit]
                        window[p[hit], c[hit]] = k[hit] + 1
                    on = ~hit & (k < most)
                    p, c, gap, most, k = p[on], c[on], gap[on], most[on], k[on] + 1
        best = np.minimum(np.minimum(moved, replaced), other)
        kind = np.where(moved == best, window + MOVE, np.where(replaced == best, SUB, np.where(insert == best, INS, DEL)))
        best = np.where(same, before, best)
        cost[d, :, lo : hi + 1] = best
        how[d, :, lo : hi + 1] = np.where(same, MATCH, kind)
        if costs is not None:
            chain[d, :, lo : hi + 1] = np.where(best != before, chain[d - 2, :, lo - 1 : hi] + 1, 0)
    return _walk(how, n, m)


def _first_seen(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """For each token of ``a`` its first place in the row of ``b``, or ``size``."""
    order = np.argsort(b, axis=1, kind="stable")
    out = np.full(a.shape, size)
    if not size:
        return out
    for k in range(len(a)):
        row = b[k, order[k]]
        at = np.minimum(np.searchsorted(row, a[k]), size - 1)
        hit = row[at] == a[k]
        out[k, hit] = order[k, at[hit]]
    return out


def _walk(how: np.ndarray, n: np.ndarray, m: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """The steps that lead to each pair's last cell, all pairs a step at a time."""
    i, j = n.copy(), m.copy()
    taken = []
    while (on := np.flatnonzero(i + j)).size:
        kind = how[i[on] + j[on], on, i[on]].astype(np.int64)
        width = np.where(kind > DEL, kind - MOVE, 1)
        s1, t1 = i[on].copy(), j[on].copy()
        i[on] -= np.where(kind == INS, 0, width)
        j[on] -= np.where(kind == DEL, 0, width)
        taken.append((on, kind, i[on].copy(), s1, j[on].copy(), t1))
    if not taken:
        return [tuple(np.zeros(0, np.int64) for _ in range(5)) for _ in n]
    pair = np.concatenate([x[0] for x in taken])
    order = np.argsort(pair, kind="stable")
    ends = np.searchsorted(pair[order], np.arange(len(n) + 1))
    cols = [np.concatenate([x[k] for x in taken])[order] for k in range(1, 6)]
    return [tuple(c[lo:hi][::-1] for c in cols) for lo, hi in zip(ends, ends[1:])]


def align_many(pairs: Sequence[tuple[Sequence[tuple], Sequence[tuple]]], costs: Callable[[Sequence[tuple]], Costs] | None, fold: Callable[[tuple], str] = _lower_key) -> list[tuple[np.ndarray, ...]]:
    """Cheapest alignment of each pair of token lists: arrays of kinds, s0, s1, t0, t1.

    Deleting and inserting cost 1; equal texts match; a run of k + 1 tokens that is a reordering (up to
    ``fold``) of the other side's costs k more than what precedes it. On equal cost a reordering goes before a
    replacement, that before an insertion, that before a deletion. ``costs`` makes the costs of replacements
    from the vocabulary; without it each costs 1 and nothing is reordered.
    """
    flat = [t for s, u in pairs for side in (s, u) for t in side]
    vocabulary, number = numbered(flat)
    size = np.array([(len(s), len(u)) for s, u in pairs], np.int64).reshape(-1, 2)
    end = np.cumsum(size.sum(1))
    numbers = [(number[e - a - b : e - b], number[e - b : e]) for e, (a, b) in zip(end.tolist(), size.tolist())]
    return align_numbered(vocabulary, numbers, costs, fold)


def align_numbered(vocabulary: Sequence[tuple], numbers: Sequence[tuple[np.ndarray, np.ndarray]], costs: Callable[[Sequence[tuple]], Costs] | None, fold: Callable[[tuple], str] = _lower_key) -> list[tuple[np.ndarray, ...]]:
    """``align_many`` of pairs whose tokens are given by their numbers in ``vocabulary``.

    Where both sides end alike the last steps are matches, whatever stands before: a match is taken wherever
    texts are equal, and a cell depends on earlier tokens only. So the tables stop there.
    """
    text = numbered([t[0] for t in vocabulary])[1]
    folded = numbered([fold(t) for t in vocabulary])[1]
    table = costs(vocabulary) if costs is not None and vocabulary else None
    alike = [_common_end(text[s], text[t]) for s, t in numbers]
    numbers = [(s[: len(s) - c], t[: len(t) - c]) for (s, t), c in zip(numbers, alike)]
    size = np.array([(len(s), len(t)) for s, t in numbers], np.int64).reshape(-1, 2)
    order = np.lexsort((size[:, 1], size[:, 0] + size[:, 1]))
    out: list = [None] * len(numbers)
    for part in _blocks(order.tolist(), size):
        for k, steps in zip(part, _block([numbers[k] for k in part], text, folded, table)):
            out[k] = steps
            if alike[k]:
                at = np.arange(alike[k])
                n, m = size[k]
                out[k] = tuple(np.concatenate([x, y]) for x, y in zip(steps, (np.zeros_like(at) + MATCH, n + at, n + at + 1, m + at, m + at + 1)))
    return out


def _common_end(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers ``a`` and ``b`` have in common at their ends."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :] != b[len(b) - n :])
    return n - 1 - int(differ[-1]) if len(differ) else n


def _blocks(order: list[int], size: np.ndarray) -> Iterator[list[int]]:
    """Pairs of about the same length, as many as fit into CELLS cells."""
    part: list[int] = []
    high = wide = 0
    for k in order:
        h, w = max(high, int(size[k, 0])), max(wide, int(size[k, 1]))
        if part and (len(part) + 1) * (h + 1) * (h + w + 1) > CELLS:
            yield part
            part, h, w = [], int(size[k, 0]), int(size[k, 1])
        part.append(k)
        high, wide = h, w
    if part:
        yield part


def op_name(kind: int) -> str:
    return OPS[kind] if kind <= DEL else f"T{kind - MOVE}"
