"""The exact scorer behind lexical retrieval, over passages whose tokens are numbers.

A pass over the sources cuts and tokenises each text once, in Python, and keeps of each passage the numbers of those
tokens that spans have at all, in runs of bounded size (blobs). Spans are scored against these, a block of spans at a time.

What a span's best passages in sight reach is a bound for all others: tokens whose weights together stay below it can't
make a passage one of the best, so that only passages with another token of the span are looked at, and their light tokens
are added for those that can still reach the bound. To begin with, a token that `most` passages have bounds the score by
its weight. Bounds follow from passages of the corpus whichever task saw them, so a worker keeps them from task to task:
what a task sends depends on that, but never whether one of the best is sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..config import TokenizerConfig
from ..functions.cutting import chunked, passages, tokenizer

BLOB = "corpus_id string, token string, source_pos long, n long, blob binary"
#: characters of a chunk of texts, passages of a blob
CHARS, PASSAGES = 1_000_000, 20_000
#: cells of a table of sums, and matches that are expanded at once
CELLS, MATCHES = 4_000_000, 2_000_000


def blob_rows(corpus, token, pos, n, blob) -> pa.RecordBatch:
    many = max(len(x) for x in (corpus, pos, n, blob))
    columns = [(corpus, pa.string()), (token, pa.string()), (pos, pa.int64()), (n, pa.int64()), (blob, pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) if len(c) else pa.nulls(many, t) for c, t in columns], names=["corpus_id", "token", "source_pos", "n", "blob"])


def packed(count: np.ndarray, terms: np.ndarray, of: np.ndarray, no: np.ndarray, pos: np.ndarray, src: np.ndarray) -> bytes:
    """A run of passages: how many terms each has and which, in order; the row of pos and src each is of, and its number there."""
    head = np.array([len(count), len(terms), len(pos)], np.int64)
    return b"".join(x.tobytes() for x in (head, pos.astype(np.int64), src.astype(np.int64), count.astype(np.int32), of.astype(np.int32), no.astype(np.int32), terms.astype(np.int32)))


def unpacked(blob) -> tuple[np.ndarray, ...]:
    p, t, s = (int(x) for x in np.frombuffer(blob, np.int64, 3))
    pos, src = np.frombuffer(blob, np.int64, s, 24), np.frombuffer(blob, np.int64, s, 24 + 8 * s)
    at = 24 + 16 * s
    count, of, no = (np.frombuffer(blob, np.int32, p, at + 4 * p * k) for k in range(3))
    return count, np.frombuffer(blob, np.int32, t, at + 12 * p), of, no, pos, src


def encoded(rows, known: dict, n_terms: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """Blobs of rows (corpus_id, pos, src, list of the tokens of each passage), and the terms of all of their passages.
    known: corpus, token: its number, from 1."""
    count, flat, of, no, pos, src = [], [], [], [], [], []

    def flush():
        size = np.array(count, np.int64)
        key = np.unique(np.repeat(np.arange(len(size)), size) * (n_terms + 1) + np.array(flat, np.int64))
        owner, terms = np.divmod(key, n_terms + 1)
        return terms, packed(np.bincount(owner, minlength=len(size)), terms, np.array(of), np.array(no), np.array(pos, np.int64), np.array(src, np.int64))

    for corpus, p, s, lists in rows:
        get = known.get(corpus, {}).get
        for k, tokens in enumerate(lists):
            if len(count) >= PASSAGES:
                yield flush()
                count, flat, of, no, pos, src = [], [], [], [], [], []
            if not pos or pos[-1] != p or src[-1] != s:
                pos.append(p)
                src.append(s)
            found = list(filter(None, map(get, tokens)))
            count.append(len(found))
            flat += found
            of.append(len(pos) - 1)
            no.append(k)
    if count:
        yield flush()


def encoder(known, names, size: int, stride: int, config: TokenizerConfig = TokenizerConfig()):
    """An Arrow function of (corpus_id, source_pos, source_index, text): rows of blobs, of the passages of each source
    (token null), and of how many passages have a token. known, names: broadcasts of encoded()'s numbers, and the (corpus,
    token) of each."""

    def run(source) -> Iterator[pa.RecordBatch]:
        cut, df, some = tokenizer(config), np.zeros(len(names.value) + 1, np.int64), False

        def rows(batch):
            corpus, pos, src = (batch.column(k).to_pylist() for k in range(3))
            for lo, texts in chunked(batch, 3, CHARS):
                for k, text in enumerate(texts, lo):
                    parts = passages(text, size, stride)
                    if parts:
                        sources.append((corpus[k], pos[k], len(parts)))
                        yield corpus[k], pos[k], src[k], cut(text, parts)

        for batch in source:
            sources: list[tuple] = []
            for terms, blob in encoded(rows(batch), known.value, len(names.value)):
                df += np.bincount(terms, minlength=len(df))
                some = True
                yield blob_rows([], [], [], [], [blob])
            if sources:
                c, p, n = (list(x) for x in zip(*sources, strict=True))
                yield blob_rows(c, [], p, n, [])
        if some and df.any():
            found = np.flatnonzero(df)
            yield blob_rows([names.value[k - 1][0] for k in found], [names.value[k - 1][1] for k in found], [], df[found], [])

    return run


def token_counter(size: int = 1, stride: int = 1, config: TokenizerConfig = TokenizerConfig(), most: int = 300_000):
    """An Arrow function of (corpus_id, text): (corpus_id, token, n), in how many passages of these texts a token stands, a
    row for each flush; and (corpus_id, null, n), how many passages there are."""

    def rows(corpus, counts, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([corpus] * (len(counts) + 1), pa.string()), pa.array([None, *counts], pa.string()), pa.array([n, *counts.values()], pa.int64())], names=["corpus_id", "token", "n"])

    def run(source) -> Iterator[pa.RecordBatch]:
        cut, held = tokenizer(config), {}
        for batch in source:
            corpus = batch.column(0).to_pylist()
            for lo, texts in chunked(batch, 1, CHARS):
                for k, text in enumerate(texts, lo):
                    parts = passages(text, size, stride)
                    if not parts:
                        continue
                    counts, n = held.get(corpus[k], ({}, 0))
                    for tokens in cut(text, parts):
                        for t in set(tokens):
                            counts[t] = counts.get(t, 0) + 1
                    held[corpus[k]] = counts, n + len(parts)
                    if len(counts) > most:
                        yield rows(corpus[k], *held.pop(corpus[k]))
        for c, found in held.items():
            yield rows(c, *found)

    return run


class Scorer:
    """The `most` best passages of each of n needles. owner, term, w: the terms of needles, sorted by needle, then weight;
    floor: a bound of the score of each needle's best, 0 where nothing is known; low, edge, due: what an earlier one knew."""

    def __init__(self, most: int, n: int, owner: np.ndarray, term: np.ndarray, w: np.ndarray, floor: np.ndarray, n_terms: int, low: np.ndarray | None = None, edge: np.ndarray | None = None, due: int = 256):
        self.n, self.most, self.owner, self.term, self.w, self.n_terms = n, most, owner, term.astype(np.int64), w, n_terms
        self.by_term = np.argsort(term, kind="stable")
        self.first = np.searchsorted(owner, np.arange(n + 1))
        ahead = np.concatenate([[0], np.cumsum(w)])
        self.below = ahead[1:] - ahead[self.first[owner]]  # of a needle's terms up to this one
        self.exact = bool(len(w) == 0 or np.bincount(owner, weights=w.astype(np.float64)).max() < 2.0**52)
        self.low = (floor if low is None else low).astype(np.int64)
        self.edge = np.full((n, 3), np.iinfo(np.int64).max) if edge is None else edge.copy()
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.held = self.seen = 0
        self.due = due
        self.rebuild()

    def rebuild(self) -> None:
        light = self.below < self.low[self.owner]
        heavy = self.by_term[~light[self.by_term]]
        self.needle, self.weight = self.owner[heavy], self.w[heavy]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(self.term[heavy], minlength=self.n_terms + 1))])
        self.n_light = np.bincount(self.owner[light], minlength=self.n)
        self.spare = self.sums(self.owner[light], self.w[light], self.n)
        self.need = np.maximum(self.low - self.spare, 1)

    def sums(self, key: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
        """Sums of whole weights by key, exact: doubles hold them below 2 ** 53, else halves of them."""
        if self.exact:
            return np.bincount(key, weights=w, minlength=size).astype(np.int64)
        high, low = np.bincount(key, weights=w >> 26, minlength=size), np.bincount(key, weights=w & ((1 << 26) - 1), minlength=size)
        return (high.astype(np.int64) << 26) + low.astype(np.int64)

    def add(self, blob) -> None:
        count, terms, of, no, pos, src = unpacked(blob)
        ends = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        terms = terms.astype(np.int64)
        lo = 0
        while lo < len(count):
            load = np.concatenate([[0], np.cumsum((self.at[1:] - self.at[:-1])[terms[ends[lo] :]])])
            per = load[ends[lo + 1 :] - ends[lo]]  # matches up to each passage
            dense = per[-1] * 16 > self.n * len(per)
            hi = lo + max(1, min(int(np.searchsorted(per, MATCHES)), CELLS // max(1, self.n) if dense else len(per), self.due))
            self.piece(terms[ends[lo] : ends[hi]], count[lo:hi], of[lo:hi], no[lo:hi], pos, src)
            lo = hi
            if self.held > 2 * self.n * self.most + 200_000:
                self.trim()
            if self.seen >= self.due:
                self.trim()
                self.rebuild()
                self.due *= 2

    def piece(self, terms, count, of, no, pos, src) -> None:
        many = len(count)
        self.seen += many
        p = np.repeat(np.arange(many), count)
        load = self.at[terms + 1] - self.at[terms]
        total = int(load.sum())
        if not total:
            return
        at = np.repeat(self.at[terms] - (np.cumsum(load) - load), load) + np.arange(total)
        key = self.needle[at] * many + np.repeat(p, load)
        if self.n * many <= 16 * total:
            part = self.sums(key, self.weight[at], self.n * many).reshape(self.n, many)
            i, j = np.nonzero(part >= self.need[:, None])
            part = part[i, j]
        else:
            key, back = np.unique(key, return_inverse=True)
            part = self.sums(back, self.weight[at], len(key))
            i, j = np.divmod(key, many)
            near = part >= self.need[i]
            i, j, part = i[near], j[near], part[near]
        place = p * (self.n_terms + 1) + terms
        ahead = np.concatenate([[0], np.cumsum(self.n_light[i])])
        lo = 0
        while lo < len(i):
            hi = max(lo + 1, int(np.searchsorted(ahead, ahead[lo] + MATCHES)) - 1)
            self.keep(i[lo:hi], j[lo:hi], self.whole(i[lo:hi], j[lo:hi], part[lo:hi], place), of, no, pos, src)
            lo = hi

    def whole(self, i, j, part, place) -> np.ndarray:
        """part with the light terms of the needles i that the passages j have; place: the passages' terms, in order."""
        n = self.n_light[i]
        total = int(n.sum())
        if not total:
            return part
        pair = np.repeat(np.arange(len(i)), n)
        at = np.repeat(self.first[i] - (np.cumsum(n) - n), n) + np.arange(total)
        want = j[pair] * (self.n_terms + 1) + self.term[at]
        spot = np.minimum(np.searchsorted(place, want), len(place) - 1)
        hit = place[spot] == want
        return part + self.sums(pair[hit], self.w[at[hit]], len(i))

    def keep(self, i, j, part, of, no, pos, src) -> None:
        near = part >= self.low[i]
        i, j, part = i[near], j[near], part[near]
        row = of[j]
        place = np.stack([src[row], pos[row], no[j].astype(np.int64)], axis=1)
        tie = np.flatnonzero(part == self.low[i])
        if len(tie):
            a, b = place[tie], self.edge[i[tie]]
            after = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & ((a[:, 1] > b[:, 1]) | ((a[:, 1] == b[:, 1]) & (a[:, 2] > b[:, 2]))))
            if after.any():
                stays = np.ones(len(i), bool)
                stays[tie[after]] = False
                i, part, place = i[stays], part[stays], place[stays]
        if len(i):
            self.kept.append((i, part, place))
            self.held += len(i)

    def trim(self) -> None:
        if not self.kept:
            return
        i, part, place = (np.concatenate(c) for c in zip(*self.kept, strict=True))
        near = part >= self.low[i]
        i, part, place = i[near], part[near], place[near]
        order = np.lexsort((-part, i))
        at = np.searchsorted(i[order], np.arange(self.n + 1))
        full = np.flatnonzero(np.diff(at) >= self.most)
        least = np.zeros(self.n, np.int64)
        least[full] = part[order[at[full] + self.most - 1]]
        # only rows that can be among the best are put in order by all keys
        near = part >= least[i]
        i, part, place = i[near], part[near], place[near]
        order = np.lexsort((place[:, 2], place[:, 1], place[:, 0], -part, i))
        i, part, place = i[order], part[order], place[order]
        at = np.searchsorted(i, np.arange(self.n + 1))
        keep = np.arange(len(i)) - at[i] < self.most
        last = at[full] + self.most - 1
        rise = part[last] > self.low[full]
        same = part[last] == self.low[full]
        lower = rise | (same & (place[last] != self.edge[full]).any(axis=1))
        self.low[full[lower]], self.edge[full[lower]] = part[last[lower]], place[last[lower]]
        self.kept = [(i[keep], part[keep], place[keep])]
        self.held = int(keep.sum())


def scored(block, most: int):
    """An Arrow function of blobs: (k, source_index, source_pos, passage_no, part) of passages among which are the `most`
    best of each needle k. block: a broadcast of a list of the arguments of a Scorer; a worker adds its bounds to it."""

    def run(source) -> Iterator[pa.RecordBatch]:
        s = Scorer(most, *block.value[:6], *block.value[6:])
        for batch in source:
            for value in batch.column(0):
                s.add(value.as_buffer())
        s.trim()
        block.value[6:] = s.low, s.edge, s.due
        for i, part, place in s.kept:
            for lo in range(0, len(i), 100_000):
                x = place[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(i[lo : lo + 100_000].astype(np.int64)), *(pa.array(np.ascontiguousarray(x[:, c])) for c in range(3)), pa.array(part[lo : lo + 100_000])], names=["k", "source_index", "source_pos", "passage_no", "part"])

    return run
