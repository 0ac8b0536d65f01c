"""Benchmark decontamination by an FM-index for each training shard.

The windows of all benchmark items are the patterns. A shard is a run of documents; of its words only runs of words
that occur in the benchmark, long enough for the shortest pattern, can hold an occurrence, so these runs are its text.
Its suffixes are sorted by prefix doubling, the Burrows-Wheeler transform goes into a wavelet matrix, all patterns are
searched backward at once by its ranks, and occurrences are located from sampled suffix positions. Word positions that
any occurrence covers are merged into removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .kernels import CHUNK_BYTES, U, alnum_table, chunks, lower_table, span_hashes, word_spans
from .runtime import tidy

WINDOW = 10
SHARD_BYTES = 8 * CHUNK_BYTES
#: windows of a block of patterns; a block is broadcast, so its size is bounded by this times 60 bytes and its ids
BLOCK_WINDOWS = 200_000
SAMPLE = 8


class Patterns(NamedTuple):
    """vocab: sorted word hashes (word id: position + 1). pattern: rows of ids, 0 beyond length. items: those of each
    pattern. It is broadcast as a plain tuple, which workers can read without this module."""

    vocab: np.ndarray
    pattern: np.ndarray
    length: np.ndarray
    item_at: np.ndarray
    items: np.ndarray


def words_of(column: pa.Array):
    """(hashes, first word of each document, byte starts and ends within the document) by chunk."""
    for lo, hi, data, off in chunks(column):
        low = lower_table()[data]
        starts, ends, first = word_spans(low, off, alnum_table())
        base = np.repeat(off[:-1], np.diff(first))
        yield lo, hi, span_hashes(low, starts, ends), first, starts - base, ends - base


def pattern_blocks(items: DataFrame, item_id: str, text: str, window: int, most: int = BLOCK_WINDOWS) -> Iterator[Patterns]:
    """The windows of all items, in blocks of about `most` windows. Items come to the driver a few at a time."""
    ids, hashes, windows = [], [], 0
    for row in items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        for _, _, h, first, _, _ in words_of(pa.array([row[1]], pa.string())):
            if len(h):
                ids.append(row[0])
                hashes.append(h)
                windows += max(1, len(h) - window + 1)
        if windows >= most:
            yield block_of(ids, hashes, window)
            ids, hashes, windows = [], [], 0
    if ids:
        yield block_of(ids, hashes, window)


def block_of(ids: list[str], hashes: list[np.ndarray], window: int) -> Patterns:
    vocab = np.unique(np.concatenate(hashes))
    rows, of = [], []
    for i, h in enumerate(hashes):
        w = (np.searchsorted(vocab, h) + 1).astype(np.int32)
        if len(w) < window:
            w = np.pad(w, (0, window - len(w)))[None, :]
        else:
            w = np.lib.stride_tricks.sliding_window_view(w, window)
        rows.append(w)
        of.append(np.full(len(w), i))
    pattern, inverse = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    pairs = np.unique(np.stack([inverse.ravel(), np.concatenate(of)], axis=1), axis=0)
    return Patterns(vocab, pattern, (pattern > 0).sum(axis=1), np.searchsorted(pairs[:, 0], np.arange(len(pattern) + 1)), np.array(ids, object)[pairs[:, 1]])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of an integer text whose zeros separate; of two zeros the earlier is the smaller."""
    n = len(text)
    zero = text == 0
    rank = text.astype(np.int64) + int(zero.sum())
    rank[zero] = np.arange(int(zero.sum()))
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        r = rank[order]
        new = np.concatenate([[0], np.cumsum(r[1:] != r[:-1])]) if step == 1 else None
        if new is not None:
            rank[order] = new
        if rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = (rank << 32) | after
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        step *= 2


class FMIndex:
    """Count and locate patterns of symbols over 0 in an integer text whose zeros separate; the text ends in zero."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        sa = suffix_array(text)
        self.bwt = text[sa - 1]
        top = int(text.max()) if n else 0
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.bits = max(1, top.bit_length())
        self.ones, self.zeros = [], []
        level = self.bwt.copy()
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        begins = np.concatenate([[True], text[:-1] == 0])
        kept = (sa % SAMPLE == 0) | begins[sa]
        self.kept = kept
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.samples = sa[kept]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol c stands in the first i places of the transform."""
        p = np.zeros_like(i)
        i = i.copy()
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[k], self.zeros[k]
            one = ((c >> b) & 1).astype(bool)
            p = np.where(one, zeros + ones[p], p - ones[p])
            i = np.where(one, zeros + ones[i], i - ones[i])
        return i - p

    def search(self, pattern: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of all patterns, from their last symbol to their first."""
        lo = np.zeros(len(pattern), np.int64)
        hi = np.full(len(pattern), len(self.bwt), np.int64)
        for step in range(int(length.max(initial=0))):
            live = np.flatnonzero((step < length) & (lo < hi))
            c = pattern[live, length[live] - 1 - step].astype(np.int64)
            known = c < len(self.start) - 1
            hi[live[~known]] = lo[live[~known]]
            live, c = live[known], c[known]
            lo[live] = self.start[c] + self.rank(c, lo[live])
            hi[live] = self.start[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking back to a sampled one."""
        out = np.zeros(len(rows), np.int64)
        left, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            done = self.kept[at]
            out[left[done]] = self.samples[self.kept_before[at[done]]] + steps
            left, at = left[~done], at[~done]
            c = self.bwt[at].astype(np.int64)
            at = self.start[c] + self.rank(c, at)
            steps += 1
        return out


def occurrences(hashes: np.ndarray, first: np.ndarray, p: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(word position, pattern) of every occurrence in a shard of documents."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(hashes) or not len(p.vocab):
        return none
    pos = np.minimum(np.searchsorted(p.vocab, hashes), len(p.vocab) - 1)
    known = p.vocab[pos] == hashes
    begin = known.copy()
    begin[1:] &= ~known[:-1]
    edge = first[(first > 0) & (first < len(hashes))]
    begin[edge] = known[edge]
    s = np.flatnonzero(begin)
    stop = ~known
    stop[edge] = True
    stops = np.append(np.flatnonzero(stop), len(hashes))
    e = stops[np.searchsorted(stops, s, side="right")]
    long = e - s >= p.length.min()
    s, e = s[long], e[long]
    if not len(s):
        return none
    size = e - s
    place = np.concatenate([[0], np.cumsum(size + 1)])
    source = np.repeat(s - place[:-1], size + 1) + np.arange(int(place[-1]))
    text = np.zeros(int(place[-1]), np.int64)
    inner = np.ones(len(text), bool)
    inner[place[1:] - 1] = False
    text[inner] = pos[source[inner]] + 1
    index = FMIndex(text)
    lo, hi = index.search(p.pattern, p.length)
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    return source[index.locate(rows)], which


RUN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


NEW = ("n_words", "runs", "items")


def search(docs: DataFrame, block, text: str) -> DataFrame:
    """docs with n_words, runs (word and byte bounds of merged hits) and items, for one block of patterns."""
    names = docs.columns
    text_at = names.index(text)

    def shard(columns, words, p: Patterns):
        hashes = np.concatenate([w[0] for w in words])
        sizes = np.concatenate([np.diff(w[1]) for w in words])
        first = np.concatenate([[0], np.cumsum(sizes)])
        at, which = occurrences(hashes, first, p)
        step = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + p.length[which], -1)
        hit = np.cumsum(step[:-1]) > 0
        begin = hit.copy()
        begin[1:] &= ~hit[:-1]
        edge = first[(first > 0) & (first < len(hashes))]
        begin[edge] = hit[edge]
        s = np.flatnonzero(begin)
        stop = ~hit
        stop[edge] = True
        stops = np.append(np.flatnonzero(stop), len(hashes))
        e = stops[np.searchsorted(stops, s, side="right")] if len(s) else s
        byte_s, byte_e = np.concatenate([w[2] for w in words]), np.concatenate([w[3] for w in words])
        runs = [[] for _ in sizes]
        for a, b, d in zip(s.tolist(), e.tolist(), (np.searchsorted(first, s, side="right") - 1).tolist(), strict=True):
            runs[d].append({"first": a - int(first[d]), "last": b - int(first[d]), "start": int(byte_s[a]), "end": int(byte_e[b - 1])})
        items = [set() for _ in sizes]
        pair = np.unique(np.stack([np.searchsorted(first, at, side="right") - 1, which], axis=1), axis=0) if len(at) else []
        for d, k in pair:
            items[d].update(p.items[p.item_at[k] : p.item_at[k + 1]])
        return pa.RecordBatch.from_arrays([*columns, pa.array(sizes), pa.array(runs, RUN), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=[*names, *NEW])

    def run(source) -> Iterator[pa.RecordBatch]:
        p = Patterns(*block.value)
        for batch in source:
            words, begin, held = [], 0, 0
            for lo, hi, h, first, s, e in words_of(batch.column(text_at)):
                words.append((h, first, s, e))
                held += len(h)
                if held * 6 >= SHARD_BYTES:
                    yield shard([c.slice(begin, hi - begin) for c in batch.columns], words, p)
                    words, begin, held = [], hi, 0
            if words:
                yield shard([c.slice(begin) for c in batch.columns], words, p)

    added = StructType.fromDDL("n_words long, runs array<struct<first:long,last:long,start:long,end:long>>, items array<string>")
    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, *added.fields]))


def merged(runs):
    """Sorted runs that overlap or touch become one."""

    ordered = F.array_sort(runs)

    def add(done, x):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (x["first"] <= last["last"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(ordered, F.slice(ordered, 1, 0), add)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs with n_words, runs and items added; of columns of docs that are named like these, these replace them.

    runs: merged hits as word bounds (first, last) and byte bounds (start, end) of the text. items: ids, as strings and
    sorted, of the items with an occurring window. A null or wordless text has no words and no hits; an item without
    words, a null item id or text has no windows. Items repeated under one id count once. Repeated documents stay.
    An empty table of documents gives no rows, one of items no hits. Patterns of any number are searched in blocks of
    bounded size, one pass over the documents for each.
    """
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(tuple(b)) for b in pattern_blocks(benchmark, item_id, item_text, window, block_windows)]
    if not blocks:
        nothing = Patterns(np.zeros(0, U), np.zeros((0, window), np.int32), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, object))
        blocks = [spark.sparkContext.broadcast(tuple(nothing))]
    docs = docs.select(*[c for c in docs.columns if c not in NEW])
    found = [search(docs, b, text) for b in blocks]
    if len(found) == 1:
        return found[0]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    # rows that are alike give alike results, so a set of these is as small as the number of blocks
    one = every.groupBy(*docs.columns).agg(F.first("n_words").alias("n_words"), F.collect_set("runs").alias("r"), F.collect_set("items").alias("i"), (F.count("*") / len(found)).cast("int").alias("times"))
    one = one.select(*docs.columns, "n_words", merged(F.flatten("r")).alias("runs"), F.array_sort(F.array_distinct(F.flatten("i"))).alias("items"), "times")
    return one.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def report(found: DataFrame) -> DataFrame:
    """The digest of contamination(): doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_runs(found: DataFrame, text: str = "text") -> DataFrame:
    """contamination() with the bytes of its runs taken out of the text; a null text stays null."""
    names = found.columns
    text_at, runs_at = names.index(text), names.index("runs")

    def run(source) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = batch.column(text_at)
            out = []
            for t, runs in zip(texts, batch.column(runs_at).to_pylist(), strict=True):
                if not runs or not t.is_valid:
                    out.append(t.as_py())
                    continue
                b, at, kept = t.as_buffer().to_pybytes(), 0, []
                for r in runs:
                    kept.append(b[at : r["start"]])
                    at = r["end"]
                out.append((b"".join(kept) + b[at:]).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == text_at else batch.column(i) for i in range(len(names))], names=names)

    return found.mapInArrow(tidy(run), found.schema)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k
      FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT m FROM p),
g AS (SELECT rn, m, i, array_to_string(w[i : i + m - 1], ' ') AS k
      FROM (SELECT rn, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, l WHERE len(w) >= m)),
o AS (SELECT g.rn, g.i, g.m, p.item_id FROM g JOIN p ON g.m = p.m AND g.k = p.k),
h AS (SELECT rn, count(DISTINCT j) AS n_hit FROM (SELECT rn, unnest(generate_series(i, i + m - 1)) AS j FROM (SELECT DISTINCT rn, i, m FROM o)) GROUP BY rn),
t AS (SELECT rn, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rn, item_id::VARCHAR AS x FROM o) GROUP BY rn)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.rn = h.rn LEFT JOIN t ON d.rn = t.rn
"""
