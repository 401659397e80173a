"""A run-compressed Burrows-Wheeler index of many short texts, and matching statistics against it.

The transform is kept as its runs, with the text position sampled at both ends
of each; rows and their steps are found from run heads alone. Patterns are
streamed from their ends, all in step: inside a run of the wanted byte a row
moves by the run's shift; elsewhere it jumps to the nearer end of a neighbouring
run of that byte, whose sample gives the position of the new match. Ranges of
several rows whose suffixes share ``length`` bytes are kept with the least owner
of their texts; any other row's owner is its text's.
"""

from __future__ import annotations

import numpy as np


def _ranks(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Each key's place among the distinct ones, from 1 on, and their number."""
    order = np.argsort(key)
    by = key[order]
    step = np.cumsum(np.concatenate([[1], by[1:] != by[:-1]]))
    rank = np.empty(len(key), np.int64)
    rank[order] = step
    return rank, int(step[-1])


def suffix_array(text: np.ndarray, room: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The order of all suffixes, which rows share their first ``length`` symbols with the row before, and each place's next symbols in one number, with the bits of one.

    ``text`` has symbols from 1 on, and 0 behind each text; ``room`` counts the
    symbols up to that 0, where a suffix ends. Equal suffixes stand as in the text.
    """
    n, longest = len(text), int(room.max(initial=0)) + 1
    bits = max(2, int(text.max(initial=1)).bit_length())
    k = 63 // bits
    padded = np.concatenate([text.astype(np.int64), np.zeros(k, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(k):
        key = (key << bits) | padded[j : j + n] * (room >= j)
    ahead = key
    rank, distinct = _ranks(key)
    near, width = rank, k
    while k < longest and distinct < n:
        # Three ranks on end sort by three times as many symbols, or two where three don't fit.
        wide = int(n + 1).bit_length()
        times = 3 if 3 * wide <= 63 else 2
        key = rank.copy()
        for j in range(1, times):
            after = np.concatenate([rank[j * k :], np.zeros(min(n, j * k), np.int64)])[:n]
            key = (key << wide) | after * (room >= j * k)
        k *= times
        rank, distinct = _ranks(key)
        if k <= length:
            near, width = rank, k
    order = np.sort((rank << 32) | np.arange(n)) & 0xFFFFFFFF
    same = np.zeros(n, bool)
    a, b = order[:-1], order[1:]
    alike = (room[a] >= length) & (room[b] >= length)
    for j in [*range(0, max(1, length - width), width), max(0, length - width)]:
        x, y = np.minimum(a + j, n - 1), np.minimum(b + j, n - 1)
        alike &= near[x] == near[y]
    if length < width:
        # Ranks of more symbols than ``length``: compared one by one instead.
        alike = (room[a] >= length) & (room[b] >= length)
        for j in range(length):
            alike &= text[np.minimum(a + j, n - 1)] == text[np.minimum(b + j, n - 1)]
    same[1:] = alike
    return order, same, ahead, bits


class RunIndex:
    def __init__(self, texts: list[bytes], owners: np.ndarray, length: int):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.length, self.owners = length, owners
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        n = int(sizes.sum() + len(texts))
        data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
        stop = np.zeros(n, bool)
        stop[self.starts + sizes] = True
        used = np.zeros(256, bool)
        used[data[~stop]] = True
        #: Symbols are the used bytes' ranks from 1 on; 0 stands behind each text.
        self.symbol_of = np.cumsum(used) * used
        text = np.where(stop, 0, self.symbol_of[data]).astype(np.int16)
        self.room = room = np.repeat(self.starts + sizes, sizes + 1) - np.arange(n)
        order, same, self.ahead, self.bits = suffix_array(text, room, length)
        last = text[order - 1]
        self.heads = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        self.symbols = last[self.heads].astype(np.int64)
        lengths = np.diff(np.append(self.heads, n))
        self.tails = self.heads + lengths - 1
        # Sampled run ends: where the suffixes at a run's first and last row begin.
        self.at_head, self.at_tail = order[self.heads], order[self.tails]
        runs = len(self.heads)
        by = np.argsort(self.symbols, kind="stable")
        self.shift = np.empty(runs, np.int64)
        self.shift[by] = np.concatenate([[0], np.cumsum(lengths[by])])[:-1]
        self.sorted_keys, self.sorted_runs = self.symbols[by] * (runs + 1) + by, by
        # Ranges of two rows or more that share ``length`` symbols.
        begins = np.flatnonzero(~same & np.concatenate([same[1:], [False]]))
        ends = np.flatnonzero(same & ~np.concatenate([same[1:], [False]])) + 1
        self.low, self.high = begins, ends
        inside = np.zeros(n + 1, np.int64)
        inside[begins] += 1
        inside[ends] -= 1
        rows = np.flatnonzero(np.cumsum(inside[:-1]))
        owner = owners[np.searchsorted(self.starts, order[rows], side="right") - 1]
        cut = np.concatenate([[0], np.cumsum(ends - begins)])[:-1]
        self.least = np.minimum.reduceat(owner, cut) if len(cut) else owner
        self.start_row, self.start_position = 0, int(order[0])

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal symbols from two places on, up to ``most`` and the ends of texts: as many at a time as a number holds."""
        k, bits = 63 // self.bits, self.bits
        most = np.minimum(most, np.minimum(self.room[a], self.room[b]))
        out, live = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
        while len(live):
            at = out[live]
            x = self.ahead[a[live] + at] ^ self.ahead[b[live] + at]
            # The highest bit alone decides; the one below it is cleared, so that no rounding carries.
            _, top = np.frexp((x & ~(x >> 1)).astype(np.float64))
            out[live] = at + np.where(x == 0, k, (k * bits - top) // bits)
            live = live[(x == 0) & (out[live] < most[live])]
        return np.minimum(out, most)

    def stream(self, patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pattern's each place: the longest match's length, a position of it, and the least owner of its first ``length`` bytes (-1 if it is shorter)."""
        sizes = np.fromiter(map(len, patterns), np.int64, len(patterns))
        begin = np.concatenate([[0], np.cumsum(sizes)])
        data = self.symbol_of[np.frombuffer(b"".join(patterns), np.uint8)]
        match, where, least = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64), np.full(len(data), -1, np.int64)
        live = np.flatnonzero(sizes)
        row, pos, size = (np.full(len(patterns), v, np.int64) for v in (self.start_row, self.start_position, 0))
        runs = len(self.heads)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            live = live[sizes[live] >= step]
            at = begin[live + 1] - step
            want, q, p, s = data[at], row[live], pos[live], size[live]
            run = np.searchsorted(self.heads, q, side="right") - 1
            off = np.flatnonzero(self.symbols[run] != want)
            if len(off):
                i = np.searchsorted(self.sorted_keys, want[off] * (runs + 1) + run[off])
                up, down = self.sorted_runs[np.maximum(i - 1, 0)], self.sorted_runs[np.minimum(i, runs - 1)]
                reach = [np.where(self.symbols[r] == want[off], self._common(p[off], samples[r], s[off]), -1) for r, samples in ((up, self.at_tail), (down, self.at_head))]
                better = reach[0] >= reach[1]
                run[off] = np.where(better, up, down)
                q[off] = np.where(better, self.tails[up], self.heads[down])
                p[off] = np.where(better, self.at_tail[up], self.at_head[down])
                s[off] = np.where(better, reach[0], reach[1])
            # A byte that occurs nowhere: the match is empty, and any row will do.
            lost = (s < 0) | (want == 0)
            q = self.shift[run] + q - self.heads[run]
            p, s = p - 1, s + 1
            q[lost], p[lost], s[lost] = self.start_row, self.start_position, 0
            row[live], pos[live], size[live] = q, p, s
            match[at], where[at] = s, p
            deep = np.flatnonzero(s >= self.length)
            if len(deep):
                owner = self.owners[np.searchsorted(self.starts, p[deep], side="right") - 1]
                if len(self.low):
                    j = np.maximum(np.searchsorted(self.low, q[deep], side="right") - 1, 0)
                    owner = np.where((self.low[j] <= q[deep]) & (q[deep] < self.high[j]), self.least[j], owner)
                least[at[deep]] = owner
        return match, where, least
