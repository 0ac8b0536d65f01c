"""Suffix order and common-prefix values by induced sorting, in memory.

A text of integers is split into runs of falling and rising suffixes. The substrings between left-most rising positions
are named, the text of names is sorted by recursion, and the order of those positions induces that of all falling
suffixes, which induces that of all rising ones. Induction does not walk the text: every suffix is a tuple of the symbols
up to the suffix that induces it and the rank of that suffix. The first keys of the tuples pass through a queue, which
keeps sorted runs on disk once it holds more than its share of memory but is read back whole; later keys, orders and
prefix values are sorted in memory, though long columns of text, codes and ranks are mapped from disk. Common-prefix
values are what neighbouring tuples share, and, where they share all, that and the
least value between the ranks they end in.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: tuples that a queue holds in memory, and bytes of a column from which it lies on disk
IN_MEMORY = 8_000_000
COLUMN_BYTES = 128 << 20


def column(n: int, dtype) -> np.ndarray:
    """A zeroed column in memory, or mapped from an unnamed scratch file if it is long."""
    if n * np.dtype(dtype).itemsize < COLUMN_BYTES:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile() as f:
        f.truncate(n * np.dtype(dtype).itemsize)
        return np.memmap(f, dtype, mode="r+", shape=(n,))


class TupleQueue:
    """Bulk priority queue of (key, tie, item): push runs in any order, then take them all in order, block by block."""

    FORM = np.dtype([("key", "<u8"), ("tie", "<i8"), ("item", "<i8")])

    def __init__(self, most: int = IN_MEMORY):
        self.most, self.held, self.n, self.runs = most, [], 0, []

    def push(self, key: np.ndarray, tie: np.ndarray, item: np.ndarray) -> None:
        self.held.append((key, tie, item))
        self.n += len(key)
        if self.n > self.most:
            self._spill()

    def _sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, tie, item = (np.concatenate(c) for c in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.lexsort((tie, key))
        return key[order], tie[order], item[order]

    def _spill(self) -> None:
        run = np.empty(self.n, self.FORM)
        run["key"], run["tie"], run["item"] = self._sorted()
        f = tempfile.TemporaryFile()
        run.tofile(f)
        f.seek(0)
        self.runs.append(f)
        self.held, self.n = [], 0

    def blocks(self):
        """(key, tie, item) in order; equal (key, tie) may be cut by the end of a block."""
        if not self.runs:
            yield self._sorted()
            return
        if self.n:
            self._spill()
        size = max(1024, self.most // (2 * len(self.runs)))
        heads = [np.fromfile(f, self.FORM, size) for f in self.runs]
        while any(len(h) for h in heads):
            bounds = [(h[-1]["key"], h[-1]["tie"]) for h in heads if len(h)]
            limit = min(bounds)
            taken = []
            for i, h in enumerate(heads):
                if len(h):
                    below = int(np.count_nonzero((h["key"] < limit[0]) | ((h["key"] == limit[0]) & (h["tie"] <= limit[1]))))
                    taken.append(h[:below])
                    heads[i] = h[below:]
                    if not len(heads[i]):
                        heads[i] = np.fromfile(self.runs[i], self.FORM, size)
            x = np.concatenate(taken)
            x = x[np.lexsort((x["tie"], x["key"]))]
            yield x["key"].copy(), x["tie"].copy(), x["item"].copy()
        for f in self.runs:
            f.close()


class RangeMin:
    """Least value between two places of an array, by minima of doubling spans."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        span = 1
        while 2 * span <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-span], last[span:]))
            span *= 2

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Over values[lo:hi], lo < hi."""
        k = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            x = self.levels[level]
            out[at] = np.minimum(x[lo[at]], x[hi[at] - (1 << int(level))])
        return out


def tuple_order(code: np.ndarray, start: np.ndarray, length: np.ndarray, tie: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of tuples (code[start : start + length], tie), and whether each in order differs from the one before in its codes.

    No tuple's codes are a proper prefix of another's, so ties decide only between equal codes.
    """
    n = len(start)
    bits = max(1, int(code.max()).bit_length()) if len(code) else 1
    wide = 63 // bits
    top = len(code) - 1
    group, active, order = np.zeros(n, np.int64), np.arange(n), np.arange(n)
    fresh = np.zeros(n, bool)
    if n:
        fresh[0] = True
    offset = 0
    while len(active):
        # the tuples still tied are re-sorted within their groups, by the next codes and, where they end, by their ties
        left = length[active] - offset
        key = np.zeros(len(active), np.uint64)
        for t in range(wide):
            c = np.where(t < left, code[np.minimum(start[active] + offset + t, top)], 0).astype(np.uint64)
            key = (key << np.uint64(bits)) | c
        ended = left <= wide
        last = np.where(ended, tie[active], 0)
        g = group[active]
        places = np.sort(g) if offset == 0 else g  # active is in order of place after the first round
        if offset == 0:
            queue = TupleQueue(most)
            for lo in range(0, n, most):
                queue.push(key[lo : lo + most], last[lo : lo + most], active[lo : lo + most])
            got = list(queue.blocks())
            key, item = np.concatenate([b[0] for b in got]), np.concatenate([b[2] for b in got])
            places = np.arange(n)
            g = np.zeros(n, np.int64)
        else:
            o = np.lexsort((last, key, g))
            key, item, g = key[o], active[o], g[o]
            places = place
        order[places] = item
        changes = np.concatenate([[True], (key[1:] != key[:-1]) | (g[1:] != g[:-1])])
        fresh[places] |= changes
        first = np.maximum.accumulate(np.where(changes, np.arange(len(places)), 0))
        group[item] = places[first]
        open_item = length[item] > offset + wide
        sizes = np.diff(np.append(np.flatnonzero(changes), len(changes)))
        tied = np.repeat(sizes > 1, sizes)
        keep = open_item & tied
        active, place = item[keep], places[keep]
        offset += wide
    return order, fresh


def shared(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, up to `most`, by comparing symbols."""
    n = len(text)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    t = 0
    while len(live) and t < most:
        x, y = a[live] + t, b[live] + t
        same = (x < n) & (y < n)
        same[same] = text[x[same]] == text[y[same]]
        live = live[same]
        out[live] += 1
        t += 1
    return out


def suffix_order(text: np.ndarray, most: int, memory: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes of a text that ends in its unique least symbol, and the common-prefix value of each with
    the one before it in order (0 for the first), cut at `most`."""
    n = len(text)
    if n <= 2:
        order = np.argsort(text, kind="stable")
        return order, np.zeros(n, np.int32)
    rising = np.empty(n, bool)
    differs = np.flatnonzero(text[1:] != text[:-1])
    rise = np.append(text[differs] < text[differs + 1], True)
    rising[:] = rise[np.searchsorted(differs, np.arange(n))]
    rising[n - 1] = True
    code = column(n, np.int64)
    code[:] = text.astype(np.int64) * 2 + rising
    lms = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    m = len(lms)
    # name the substrings from one such position to the next, and sort the text of names
    end = np.append(lms[1:], n - 1)
    order, fresh = tuple_order(code, lms, end - lms + 1, np.zeros(m, np.int64), memory)
    name = column(m, np.int64)
    name[order] = np.cumsum(fresh) - 1
    if m and fresh.all():
        lms_order = order
        lms_lcp = np.zeros(m, np.int32)
        lms_lcp[1:] = shared(text, lms[order[:-1]], lms[order[1:]], most)
    else:
        lms_order, in_names = suffix_order(name, most, memory)
        a, b = lms_order[:-1], lms_order[1:]
        l = in_names[1:].astype(np.int64)
        gone = np.append(lms, n)
        ahead = gone[np.minimum(a + l, m)] - lms[a]
        lms_lcp = np.zeros(m, np.int32)
        rest = np.flatnonzero(ahead < most)
        ahead[rest] += shared(text, lms[a[rest]] + ahead[rest], lms[b[rest]] + ahead[rest], most)
        lms_lcp[1:] = np.minimum(ahead, most)
    rank = column(n, np.int64)
    rank[lms[lms_order]] = np.arange(m)
    falling_order, falling_lcp = induce(text, code, np.flatnonzero(~rising), rising, rank, lms_lcp, most, memory)
    rank[falling_order] = np.arange(len(falling_order))
    rising_order, rising_lcp = induce(text, code, np.flatnonzero(rising), ~rising, rank, falling_lcp, most, memory)
    both = np.concatenate([falling_order, rising_order])
    place = np.argsort(code[both], kind="stable")
    sa = both[place]
    lcp = np.concatenate([falling_lcp, rising_lcp])[place]
    # where kinds or first symbols change, neighbours are new to each other
    seam = np.flatnonzero(place[1:] != place[:-1] + 1) + 1
    seam = np.append(seam, np.flatnonzero(place == len(falling_order)))
    seam = np.unique(seam[seam > 0])
    lcp[seam] = shared(text, sa[seam - 1], sa[seam], most)
    lcp[0] = 0
    return sa, lcp


def induce(text, code, start, stop, rank, stop_lcp, most, memory):
    """Order of the suffixes `start` of one kind, each induced by the first suffix of the other kind at or after it, and
    their common-prefix values. rank and stop_lcp: of the inducing suffixes."""
    n = len(text)
    stops = np.flatnonzero(stop)
    if not len(start):
        return start, np.zeros(0, np.int32)
    at = np.searchsorted(stops, start)
    till = np.append(stops, n)[at]  # n: the last suffix, which nothing follows
    length = np.minimum(till, n - 1) - start + 1
    tie = np.where(till < n, rank[np.minimum(till, n - 1)], -1)
    order, fresh = tuple_order(code, start, length, tie, memory)
    sa = start[order]
    lcp = np.zeros(len(sa), np.int32)
    new = np.flatnonzero(fresh[1:]) + 1
    lcp[new] = shared(text, sa[new - 1], sa[new], most)
    alike = np.flatnonzero(~fresh)
    if len(alike):
        t = tie[order]
        far = RangeMin(stop_lcp)(t[alike - 1] + 1, t[alike] + 1)
        lcp[alike] = np.minimum(most, (length[order[alike]] - 1) + far)
    return sa, lcp


def joined_text(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of bytes as one text of integers, each closed by a separator of its own; later separators are smaller."""
    m = len(pieces)
    size = np.array([len(p) for p in pieces], np.int64)
    first = np.concatenate([[0], np.cumsum(size + 1)])
    text = column(int(first[-1]), np.int32)
    inner = np.ones(len(text), bool)
    inner[first[1:] - 1] = False
    text[inner] = np.concatenate(pieces).astype(np.int32) + m if m else 0
    text[first[1:] - 1] = np.arange(m - 1, -1, -1)
    return text, first


def repeated(pieces: list[np.ndarray], length: int, memory: int = IN_MEMORY) -> list[np.ndarray]:
    """For each piece, the starts of its strings of `length` bytes that start anywhere else too, in any piece."""
    text, first = joined_text(pieces)
    if not len(text):
        return []
    sa, lcp = suffix_order(text, length, memory)
    long = lcp >= length
    hit = long.copy()
    hit[:-1] |= long[1:]
    at = np.sort(sa[hit])
    cut = np.searchsorted(at, first)
    return [at[cut[i] : cut[i + 1]] - first[i] for i in range(len(pieces))]
