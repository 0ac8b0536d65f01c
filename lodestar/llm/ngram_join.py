"""N-gram Jaccard self-join by partition-and-enumerate signatures.

Sets fall into size bands, each as wide as the similarity allows, so that similar sets lie in one band or in two
neighbouring ones. For a band, the feature domain is hashed into groups, and each group into three parts. If two sets
differ in at most k features, some group holds at most one of the differing features, and so two of its three parts
agree: the features in two parts make a signature, three signatures a group. There are more groups than k needs, so
that a signature without features, which says nothing, is not sent. The few sets where too many groups could be empty
send the features of their prefix (rare ones first, by hash) as signatures as well, which finds their pairs exactly.

Features that a large share of all sets hold say little and would fill buckets with texts that have a passage in common
but little else. All shingles are counted in a table of cells; those of crowded cells stay out of the groups. What two
sets differ in without them is never more than with them, so the same signatures still meet.

Sets that share a signature are pairs, or, where many share it, a chain of links. A pair's sketches (parities of its
features' cells, which can't differ in more cells than the sets differ in features) tell most of those that only have a
passage in common; without that, chance meetings would join ever more of a growing table. What is left is joined to
clusters. Chains have not seen sketches, and the features that few-worded prefixes share grow in number with the table, so
a cluster that no task can hold is taken apart first: the sketches of all its members of like size are compared, and what
they leave connected makes the clusters. A cluster's sets are compared exactly, many at a time: a feature of few sets adds
to their pairs, features of many are multiplied as a matrix. Equal sets are one vertex throughout.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .blobs import SCHEMA, batches, by_part
from .components import connected_components
from .kernels import CHUNK_BYTES, U, chunks, lower_table, mix, shingle_sets, signed, space_table, span_hashes, word_spans
from .prefilter import hits, id_bitmap
from .runtime import cut, tidy, width

WORDS = 5
PERCENT = 75
FLUSH = 4 * CHUNK_BYTES
#: a task meets its signatures in so many shares
SHARES = 4
#: a signature of up to so many sets makes pairs of them, which their sketches can tell apart
PAIRED = 16
#: rows of a flush at most
FLUSH_ROWS = 50_000
#: shingles are counted in 2 ** bits cells, over 128 a document between these bounds; those of a cell are common beyond
#: LEAST and LOAD times the mean cell
CELL_BITS, MOST_BITS, LEAST, LOAD = 23, 26, 16, 2
#: members and shingles of a block of a cluster; a task compares two blocks at most
BLOCK, BLOCK_SHINGLES = 1500, 2_000_000
#: cells of a chunk of a matrix product
DENSE = 2_000_000


def sets_of(data: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    data = lower_table()[data]
    starts, ends, first = word_spans(data, off, space_table())
    return shingle_sets(span_hashes(data, starts, ends), first, words)


def set_keys(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; equal sets have equal keys. Sets without elements have key 0."""
    sizes = np.diff(bounds)
    keys = np.zeros(len(sizes), U)
    some = sizes > 0
    if some.any():
        with np.errstate(over="ignore"):
            keys[some] = mix(np.add.reduceat(mix(sets ^ U(0x51ED27)), bounds[:-1][some]) + sizes[some].astype(U))
    return keys


def bands(longest: int, percent: int) -> np.ndarray:
    """Largest size of each band; band i holds sizes over that of band i - 1."""
    ends = [0]
    while ends[-1] < longest:
        ends.append(max(ends[-1] + 1, (ends[-1] + 1) * 100 // percent))
    return np.array(ends, np.int64)


def plan(ends: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each band: groups, and differing groups that pairs within it, or across it and the one below, can have at most."""
    k_same = 2 * ends * (100 - percent) // (100 + percent)
    k_cross = np.concatenate([[0], ends[1:] + ends[:-1]]) * (100 - percent) // (100 + percent)
    groups = np.maximum(1, np.maximum(np.ceil(0.6 * k_same), np.ceil(0.7 * k_cross))).astype(np.int64)
    groups = np.maximum(groups, k_same // 2 + 1)
    return groups, k_same // 2, k_cross // 2


def signatures(sets: np.ndarray, bounds: np.ndarray, percent: int, common: tuple[int, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set) of all sets. common: bits and bitmap of the cells of common shingles, which make no groups."""
    sizes = np.diff(bounds)
    if len(sets) == 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    ends = bands(int(sizes.max()) * 2 + 2, percent)
    groups, same, cross = plan(ends, percent)
    band = np.searchsorted(ends, sizes, side="left")
    of_set = np.repeat(np.arange(len(sizes)), sizes)
    frequent = np.zeros(len(sets), bool) if common is None else in_cells(sets, common)
    rare = sets[~frequent]
    of_set = of_set[~frequent]
    h = mix(rare ^ U(0xA0761D6478BD642F))
    out_sig, out_set = [], []
    risky = np.zeros(len(sizes), bool)
    low, high = (h & U(0xFFFFFFFF)).astype(np.float64), (h >> U(32)).astype(np.float64)
    spread = mix(rare ^ U(0xE7037ED1A0B428DB))
    third = (spread % U(3)).astype(np.int64)
    spread = (spread >> U(2)) & U(0xFFFFFFFF)
    for step in (0, 1):
        j = band + step
        g = np.where(sizes > 0, groups[j], 0)
        base = np.concatenate([[0], np.cumsum(g * 3)])
        cell = base[of_set] + 3 * ((spread * g[of_set].astype(U)) >> U(32)).astype(np.int64) + third
        n_cells = int(base[-1])
        a = np.bincount(cell, weights=low, minlength=n_cells).astype(U).reshape(-1, 3)
        b = np.bincount(cell, weights=high, minlength=n_cells).astype(U).reshape(-1, 3)
        count = np.bincount(cell, minlength=n_cells).reshape(-1, 3)
        owner = np.repeat(np.arange(len(sizes)), g)
        number = np.arange(n_cells // 3) - np.repeat(base[:-1] // 3, g)
        with np.errstate(over="ignore"):
            content = mix(a + (b << U(32)) + (b >> U(7)) * U(0x9E3779B97F4A7C15))
            tag = mix(j[owner].astype(U) * U(0x2545F4914F6CDD1D) + number.astype(U))
            weak = np.zeros(len(owner), bool)
            for x, y in ((0, 1), (0, 2), (1, 2)):
                empty = (count[:, x] + count[:, y]) == 0
                weak |= empty
                s = mix(tag + content[:, x] * U(0x8CB92BA72F3D8DD7 + 2 * x) + content[:, y] * U(0xD1B54A32D192ED03 + 2 * y) + U(x * 3 + y))
                out_sig.append(s[~empty])
                out_set.append(owner[~empty])
        weak_of = np.bincount(owner[weak], minlength=len(sizes))
        if step == 0:
            risky |= (sizes > 0) & (weak_of >= g - same[j])
        risky |= (sizes > 0) & (weak_of >= g - cross[j])
    for d in np.flatnonzero(risky):
        n = int(sizes[d])
        prefix = n - (percent * n + 99) // 100 + 1
        s, late = sets[bounds[d] : bounds[d + 1]], frequent[bounds[d] : bounds[d + 1]]
        s = np.concatenate([s[~late], s[late]])[:prefix]
        out_sig.append(mix(s ^ U(0x589965CC75374CC3)))
        out_set.append(np.full(len(s), d))
    return np.concatenate(out_sig), np.concatenate(out_set)


def sketches(sets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set the parities of its elements in cells, a power of two of them and at least one for each element."""
    sizes = np.diff(bounds)
    cells = 1 << np.ceil(np.log2(np.maximum(sizes, 64))).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(cells)])
    at = np.repeat(base[:-1], sizes) + (mix(sets ^ U(0x3C79AC492BA7B653)) & np.repeat(cells - 1, sizes).astype(U)).astype(np.int64)
    odd = np.packbits((np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    ends = (base >> 3).tolist()
    return [odd[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]


def apart(a: bytes, b: bytes) -> int:
    """A number of elements that two sets differ in at least, by their sketches."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n, m = 8 * len(a), 8 * len(b)
    while n > m:
        n >>= 1
        x = (x >> n) ^ (x & ((1 << n) - 1))
    while m > n:
        m >>= 1
        y = (y >> m) ^ (y & ((1 << m) - 1))
    return (x ^ y).bit_count()


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = CELL_BITS) -> DataFrame:
    """(doc_id, set_key, n_shingles, part, cells): a row for each row of docs, in which part is null and set_key is null
    for a set without elements; and what each task counted in each range of cells (up to 255), in rows of which part is
    the range."""
    n_parts = width(docs.sparkSession)
    piece = cell_range(n_parts, bits)

    def rows(ids, keys, sizes, part, cells) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, keys, sizes, part, cells], names=["doc_id", "set_key", "n_shingles", "part", "cells"])

    def run(source) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(piece * n_parts, np.uint8), False
        for batch in source:
            keys, sizes = [], []
            for _, _, data, off in chunks(batch.column(1)):
                sets, bounds = sets_of(data, off, words)
                keys.append(set_keys(sets, bounds))
                sizes.append(np.diff(bounds))
                at, times = np.unique(cells_of(sets, bits), return_counts=True)
                total[at] = np.minimum(total[at] + times, 255)
                some = True
            if keys:
                n = np.concatenate(sizes)
                none = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
                yield rows(batch.column(0), pa.array(signed(np.concatenate(keys)), mask=n == 0), pa.array(n), *none)
        for p in range(n_parts if some else 0):
            c = total[p * piece : (p + 1) * piece]
            if c.any():
                none = [pa.nulls(1, pa.int64())] * 3
                yield rows(*none, pa.array([p], pa.int32()), pa.array([zlib.compress(c.tobytes(), 1)], pa.binary()))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), "doc_id long, set_key long, n_shingles long, part int, cells binary")


def cell_bits(docs: int) -> int:
    """Cells that counts of shingles of so many documents take, as a power of two."""
    return min(MOST_BITS, max(CELL_BITS, docs.bit_length() + 7))


def cell_range(n_parts: int, bits: int) -> int:
    """Cells of each of n_parts ranges, a multiple of 8."""
    return -(-(1 << bits) // (8 * n_parts)) * 8


def cells_of(sets: np.ndarray, bits: int) -> np.ndarray:
    return (mix(sets ^ U(0x27D4EB2F165667C5)) >> U(64 - bits)).astype(np.int64)


def in_cells(sets: np.ndarray, common: tuple[int, np.ndarray]) -> np.ndarray:
    """Which shingles fall into the cells of a bitmap of 2 ** bits cells."""
    at = cells_of(sets, common[0])
    return ((common[1][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)


def common_cells(counted: DataFrame, shingles: int, bits: int = CELL_BITS):
    """Bits and a bitmap of the crowded cells, broadcast, from digest()'s rows of cells and the number of all shingles.
    Each task sums a range, so what reaches the driver is the map itself, of one to eight megabytes."""
    n_parts = width(counted.sparkSession)
    piece, most = cell_range(n_parts, bits), max(LEAST, LOAD * shingles / (1 << bits))

    def run(source) -> Iterator[pa.RecordBatch]:
        for part, blobs in by_part(source):
            total = np.zeros(piece, np.int64)
            for b in blobs:
                total += np.frombuffer(zlib.decompress(b), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(np.packbits(total > most).tobytes(), 1)], pa.binary())], names=["part", "blob"])

    found = counted.select("part", F.col("cells").alias("blob")).repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(tidy(run), SCHEMA)
    whole = np.zeros(piece // 8 * n_parts, np.uint8)
    for r in found.collect():
        whole[r["part"] * (piece // 8) : (r["part"] + 1) * (piece // 8)] = np.frombuffer(zlib.decompress(r["blob"]), np.uint8)
    return counted.sparkSession.sparkContext.broadcast((bits, whole))


def candidates(texts: DataFrame, common=None, only=None, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b): set keys, cut; these rows connect whatever sets share a signature, but for pairs that can't be similar by
    their sketches. texts has doc_id and text; only: a bitmap of the ids that send signatures (rows of a null id do so
    anyway).

    Signatures travel with the number of their set in its flush. A set's name is the sum of that and the flush's name;
    names, with keys, sizes and sketches, travel once. A task meets the signatures of some parts. It sends pairs of sets
    of signatures that few have, and a forest of what the others connect.
    """
    parts = min(65535, width(texts.sparkSession))

    def send(source) -> Iterator[pa.RecordBatch]:
        sigs, idx, keys, sizes, drawn, held, base = [], [], [], [], [], 0, 0
        cells = common.value if common is not None else None

        def flush() -> pa.RecordBatch:
            s, i, table = np.concatenate(sigs), np.concatenate(idx), np.concatenate(keys)
            name = flush_name(table)
            part = ((s >> U(40)) % U(parts)).astype(np.int64)
            order = np.lexsort((i, part))
            rest = s[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]  # 40 bits, beside those of the part
            i, cut_at = i[order], np.searchsorted(part[order], np.arange(parts + 1))
            names, blobs = [int(name % U(parts))], [name_blob(name, table, np.concatenate(sizes), drawn)]
            for p in range(parts):
                lo, hi = cut_at[p], cut_at[p + 1]
                if lo < hi:
                    step = np.diff(i[lo:hi], prepend=0)
                    far = step[step >= 255]
                    names.append(p)
                    blobs.append(b"".join((np.array([hi - lo, len(far)], np.int64).tobytes(), name.tobytes(), far.astype(np.uint32).tobytes(), np.minimum(step, 255).astype(np.uint8).tobytes(), rest[lo:hi].tobytes())))
            return batches(names, blobs)

        for batch in source:
            if only is not None:
                batch = batch.filter(pa.array(hits(batch.column(0), only.value, nulls=True)))
            for _, _, data, off in chunks(batch.column(1)):
                sets, bounds = sets_of(data, off, words)
                s, i = signatures(sets, bounds, percent, cells)
                sigs.append(s)
                idx.append(i + base)
                keys.append(set_keys(sets, bounds))
                sizes.append(np.diff(bounds))
                drawn += sketches(sets, bounds)
                base += len(off) - 1
                held += len(data)
                if held >= FLUSH or base >= FLUSH_ROWS:
                    yield flush()
                    sigs, idx, keys, sizes, drawn, held, base = [], [], [], [], [], 0, 0
        if base:
            yield flush()

    def meet(source) -> Iterator[pa.RecordBatch]:
        low, high, pairs = np.zeros(0, U), np.zeros(0, U), np.zeros((2, 0), U)
        for _, blobs in by_part(source):
            found = []
            for b in blobs:
                if np.frombuffer(b, np.int64, 1)[0] < 0:
                    name, keys, sizes, drawn = named(b)
                    none = pa.nulls(len(keys), pa.bool_())
                    yield rows(name, keys, none, pa.array(sizes), pa.array(drawn, pa.binary()))
                else:
                    found.append(b)
            for share in range(SHARES):  # a share of the signatures at a time, to hold less
                rest, names = [np.zeros(0, np.uint64)], [np.zeros(0, U)]
                for b in found:
                    n, far = (int(x) for x in np.frombuffer(b, np.int64, 2))
                    at = 24 + 4 * far
                    five = np.frombuffer(b, np.uint8, 5 * n, at + n).reshape(n, 5)
                    some = np.flatnonzero(five[:, 0] % SHARES == share)
                    wide = np.zeros((len(some), 8), np.uint8)
                    wide[:, :5] = five[some]
                    step = np.frombuffer(b, np.uint8, n, at).astype(np.int64)
                    step[step == 255] = np.frombuffer(b, np.uint32, far, 24)
                    rest.append(wide.view("<u8")[:, 0])
                    names.append(np.cumsum(step)[some].astype(U) + np.frombuffer(b, U, 1, 16))
                a, b, least, others = meetings(np.concatenate(rest), np.concatenate(names))
                pairs = distinct(np.concatenate([pairs, [a, b]], axis=1))
                low, high = forest(np.concatenate([low, least]), np.concatenate([high, others]))
        a, b = root_of(pairs[0], low, high), root_of(pairs[1], low, high)
        if (a != b).any():  # the others are connected anyway
            yield links(*pairs[:, a != b], False)
        if len(low):
            yield links(low, high, True)

    def rows(*columns) -> pa.RecordBatch:
        a, b, loose, n, sketch = columns
        return pa.RecordBatch.from_arrays([pa.array(signed(a)), pa.array(signed(b)), loose, n, sketch], names=["a", "b", "loose", "n", "sketch"])

    def links(a, b, loose) -> pa.RecordBatch:
        return rows(a, b, pa.array(np.full(len(a), loose)), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary()))

    def possible(source) -> Iterator[pa.RecordBatch]:
        for batch in source:
            a, b, loose, n, m, x, y = (batch.column(k).to_pylist() for k in range(7))
            keep = [a[k] != b[k] and (loose[k] or (100 + percent) * apart(x[k], y[k]) <= (100 - percent) * (n[k] + m[k])) for k in range(len(a))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sent = texts.select("doc_id", "text").mapInArrow(tidy(send), SCHEMA)
    met = cut(sent.repartition(width(texts.sparkSession), "part").sortWithinPartitions("part").mapInArrow(tidy(meet), "a long, b long, loose boolean, n long, sketch binary"))
    of = met.where("loose is null")
    pairs = met.where("loose is not null").groupBy("a", "b").agg(F.max("loose").alias("loose"))
    pairs = pairs.join(of.select("a", F.col("b").alias("ka"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    pairs = pairs.join(of.select(F.col("a").alias("b"), F.col("b").alias("kb"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    pairs = pairs.select(F.col("ka").alias("a"), F.col("kb").alias("b"), "loose", "na", "nb", "sa", "sb")
    return cut(pairs.mapInArrow(tidy(possible), "a long, b long"), met)


def flush_name(keys: np.ndarray) -> np.uint64:
    """A name of a run of sets, which follows from their keys."""
    with np.errstate(over="ignore"):
        return U(mix(np.array([np.sum(mix(keys + np.arange(len(keys)).astype(U)))], U) ^ U(0x8BB84B93962EACC9))[0])


def name_blob(name: np.uint64, keys: np.ndarray, sizes: np.ndarray, drawn: list[bytes]) -> bytes:
    lengths = np.array([len(x) for x in drawn], np.int64)
    return b"".join((np.array([-1, len(keys)], np.int64).tobytes(), name.tobytes(), keys.tobytes(), sizes.astype(np.int64).tobytes(), lengths.tobytes(), *drawn))


def named(b) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Names, keys, sizes and sketches of a name_blob(); without those of sets without elements."""
    m = int(np.frombuffer(b, np.int64, 2)[1])
    keys, sizes, lengths = np.frombuffer(b, U, m, 24), np.frombuffer(b, np.int64, m, 24 + 8 * m), np.frombuffer(b, np.int64, m, 24 + 16 * m)
    ends = (24 + 24 * m + np.concatenate([[0], np.cumsum(lengths)])).tolist()
    some = np.flatnonzero(sizes)
    with np.errstate(over="ignore"):
        names = np.frombuffer(b, U, 1, 16) + some.astype(U)
    view = memoryview(b)
    return names, keys[some], sizes[some], [bytes(view[ends[k] : ends[k + 1]]) for k in some.tolist()]


def meetings(sigs: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) of all pairs of names, a < b, that share a signature of up to PAIRED names; and (least, other) names of each
    signature that more have."""
    order = np.argsort(sigs)
    s, x = sigs[order], names[order]
    same = np.concatenate([[False], s[1:] == s[:-1], [False]])
    some = same[:-1] | same[1:] if len(s) else np.zeros(0, bool)
    s, x = s[some], x[some]
    order = np.lexsort((x, s))
    s, x = s[order], x[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (x[1:] != x[:-1])]) if len(s) else np.zeros(0, bool)
    s, x = s[new], x[new]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(s)))
    pairs = np.zeros((2, 0), U)
    for d in range(2, PAIRED + 1):
        at = first[count == d]
        i, j = np.triu_indices(d, 1)
        step = max(1, DENSE // len(i))
        for lo in range(0, len(at), step):
            of = x[at[lo : lo + step, None] + np.arange(d)]
            pairs = distinct(np.concatenate([pairs, [of[:, i].ravel(), of[:, j].ravel()]], axis=1))
    large = np.repeat(count > PAIRED, count)
    least = np.repeat(x[first], count) if len(x) else x
    large &= least != x
    return *pairs, least[large], x[large]


def distinct(pairs: np.ndarray) -> np.ndarray:
    """The distinct columns of an array of two rows."""
    pairs = pairs[:, np.lexsort(pairs[::-1])]
    return pairs[:, np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)])] if pairs.shape[1] else pairs


def joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row each of n rows is connected with."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect the same keys."""
    keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = joined(len(keys), at[: len(a)], at[len(a) :])
    away = np.flatnonzero(label != np.arange(len(keys)))
    return keys[label[away]], keys[away]


def root_of(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """What a forest(), as (low, high), connects each key with: its smallest."""
    if not len(high):
        return x
    order = np.argsort(high)
    at = np.minimum(np.searchsorted(high[order], x), len(high) - 1)
    return np.where(high[order][at] == x, low[order][at], x)


def similar(sets: np.ndarray, bounds: np.ndarray, percent: int, border: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j: numbers of all similar sets; with a border, of those with i below it and j not."""
    size = np.diff(bounds)
    m = len(size)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(sets, kind="stable")
    x, owner = sets[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    held_by = np.diff(np.append(first, len(x)))
    many = held_by > max(2, 0.08 * m)
    common = np.zeros((m, m), np.float32)
    # features of few sets, by how many: each adds one to its pairs
    for d in np.unique(held_by[~many & (held_by > 1)]).tolist():
        at = first[~many & (held_by == d)]
        i, j = np.triu_indices(d, 1)
        step = max(1, DENSE // len(i))
        for lo in range(0, len(at), step):
            of = owner[at[lo : lo + step, None] + np.arange(d)]
            pair = np.minimum(of[:, i], of[:, j]) * m + np.maximum(of[:, i], of[:, j])
            pair, n = np.unique(pair.ravel(), return_counts=True)
            common.ravel()[pair] += n
    at, n = first[many], held_by[many]
    step = max(1, DENSE // max(1, m))
    for lo in range(0, len(at), step):
        column = np.repeat(np.arange(len(at[lo : lo + step])), n[lo : lo + step])
        place = np.repeat(at[lo : lo + step] - np.concatenate([[0], np.cumsum(n[lo : lo + step])[:-1]]), n[lo : lo + step]) + np.arange(len(column))
        holds = np.zeros((m, len(at[lo : lo + step])), np.float32)
        holds[owner[place], column] = 1
        common += holds @ holds.T
    found = []
    for lo in range(0, m, 256):
        i, j = np.nonzero(common[lo : lo + 256] * (100 + percent) >= ((size[lo : lo + 256, None] + size[None, :]) * percent).astype(np.float32))
        i += lo
        keep = (i < j) & ((i < border) & (j >= border) if border else True)
        i, j = i[keep], j[keep]
        exact = (100 + percent) * common[i, j].astype(np.int64) >= percent * (size[i] + size[j])
        found.append((i[exact], j[exact]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def blocks_of(clusters: DataFrame, percent: int = PERCENT, block: int = BLOCK, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """clusters (cluster, n, ...) with level and g. A cluster that one task can hold has one level. A larger one is dealt
    into levels, each of two neighbouring bands of sizes, as links join no others; and a level into g blocks if need be."""
    many = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / shingles)).cast("int")
    band = F.floor(F.log("n") / (float(np.log(100 / percent)) * 1.0001 if percent < 100 else 1e-9)).cast("int")
    rows = clusters.join(clusters.groupBy("cluster").agg((many > 1).alias("large")), "cluster")
    rows = rows.withColumn("level", F.explode(F.when(F.col("large"), F.array(band, band - 1)).otherwise(F.array(F.lit(-2))))).drop("large")
    return rows.join(rows.groupBy("cluster", "level").agg(many.alias("g")), ["cluster", "level"])


def dealt(clusters: DataFrame, *columns: str) -> DataFrame:
    """(cluster, level, i, j, mine, member, *columns) of clusters (cluster, level, g, member, *columns): a level of g blocks
    has a task for each pair of them, whose rows come together, in order of blocks."""
    rows = clusters.withColumn("mine", F.pmod(F.xxhash64("member"), F.col("g")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.select("cluster", "level", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "member", *columns)
    return rows.repartition(width(clusters.sparkSession), "cluster", "level", "i", "j").sortWithinPartitions("cluster", "level", "i", "j", "mine")


def possible_pairs(sizes: np.ndarray, drawn: list[bytes], side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), a share at a time: numbers of all sets that can be similar by their sizes and sketches, each pair once; of
    different sides only, if there are two."""
    length = np.array([len(x) for x in drawn])
    two = len(np.unique(side)) > 1
    for short in np.unique(length).tolist():
        a = np.flatnonzero(length == short)
        x = np.frombuffer(b"".join(drawn[k] for k in a.tolist()), U).reshape(len(a), -1)
        for long in np.unique(length[length >= short]).tolist():
            b = np.flatnonzero(length == long)
            y = np.frombuffer(b"".join(drawn[k] for k in b.tolist()), U).reshape(len(b), -1)
            while y.shape[1] > x.shape[1]:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            step = max(1, DENSE // y.size)
            for lo in range(0, len(a), step):
                i = a[lo : lo + step, None]
                far = np.bitwise_count(x[lo : lo + step, None] ^ y[None]).sum(axis=2, dtype=np.int64)
                near = (100 + percent) * far <= (100 - percent) * (sizes[i] + sizes[b])
                near &= 100 * np.minimum(sizes[i], sizes[b]) >= percent * np.maximum(sizes[i], sizes[b])
                if short == long:
                    near &= i < b
                if two:
                    near &= side[i] != side[b]
                p, q = np.nonzero(near)
                if len(p):
                    yield i[p, 0], b[q]


def not_apart(clusters: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): forests of the pairs of members of each cluster that can be similar by their sketches, so that these connect
    whatever is similar. clusters: (cluster, level, g, member, n, sketch)."""

    def links(held: dict[int, tuple[int, int, bytes]]) -> pa.RecordBatch:
        member = np.array(list(held), np.int64)
        side, sizes, drawn = (list(x) for x in zip(*held.values(), strict=True))
        low, high = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, j in possible_pairs(np.array(sizes, np.int64), drawn, np.array(side), percent):
            low, high = forest(np.concatenate([low, member[i]]), np.concatenate([high, member[j]]))
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])

    def run(source) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in source:
            for *task, mine, member, n, sketch in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if task != now:
                    if len(held) > 1:
                        yield links(held)
                    now, held = task, {}
                held[member] = mine, n, sketch  # a repeated row has the same
        if len(held) > 1:
            yield links(held)

    return dealt(clusters, "n", "sketch").mapInArrow(tidy(run), "a long, b long")


def links_within(clusters: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(a, b): a forest of the links between members of each cluster. clusters: (cluster, level, g, member, text).

    A level of g blocks has a task for each pair of them.
    """

    def links(now, key, sets) -> pa.RecordBatch:
        mine = np.array([k[0] for k in key])
        member = np.array([k[1] for k in key], np.int64)
        border = int(np.count_nonzero(mine == now[2])) if now[2] != now[3] else 0  # rows come in order of blocks
        i, j = similar(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), percent, border)
        low, high = forest(member[i], member[j])
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])

    def run(source) -> Iterator[pa.RecordBatch]:
        now, key, held, seen = None, [], [], set()
        for batch in source:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for lo, _, data, off in chunks(batch.column(6)):
                sets, bounds = sets_of(data, off, words)
                for d in range(len(off) - 1):
                    task = tuple(columns[k][lo + d] for k in range(4))
                    if task != now:
                        if len(held) > 1:
                            yield links(now, key, held)
                        now, key, held, seen = task, [], [], set()
                    if (columns[4][lo + d], columns[5][lo + d]) in seen:
                        continue  # a repeated row
                    seen.add((columns[4][lo + d], columns[5][lo + d]))
                    key.append((columns[4][lo + d], columns[5][lo + d]))
                    held.append(sets[bounds[d] : bounds[d + 1]].copy())
        if len(held) > 1:
            yield links(now, key, held)

    return dealt(clusters, "text").mapInArrow(tidy(run), "a long, b long")


def with_key(rows: DataFrame, words: int = WORDS, text: str = "text", key: str = "set_key", only=None) -> DataFrame:
    """rows with the key of their sets, null for a set without elements. only: a bitmap of the ids (of doc_id) to keep."""
    at, names = rows.columns.index(text), rows.columns
    id_at = names.index("doc_id") if only is not None else 0

    def run(source) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if only is not None:
                batch = batch.filter(pa.array(hits(batch.column(id_at), only.value)))
            keys = [set_keys(*sets_of(data, off, words)) for _, _, data, off in chunks(batch.column(at))]
            if keys:
                k = np.concatenate(keys)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signed(k), mask=k == 0)], names=[*names, key])

    return rows.mapInArrow(tidy(run), StructType([*rows.schema.fields, StructField(key, LongType())]))


def with_sketch(rows: DataFrame, words: int = WORDS, only=None) -> DataFrame:
    """(doc_id, set_key, sketch) of rows (doc_id, text); set_key is null for a set without elements. only: as in with_key()."""

    def run(source) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if only is not None:
                batch = batch.filter(pa.array(hits(batch.column(0), only.value)))
            for lo, hi, data, off in chunks(batch.column(1)):
                sets, bounds = sets_of(data, off, words)
                k = set_keys(sets, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(signed(k), mask=k == 0), pa.array(sketches(sets, bounds), pa.binary())], names=["doc_id", "set_key", "sketch"])

    return rows.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, set_key long, sketch binary")


def of_members(reps: DataFrame, rows: DataFrame, read, words: int = WORDS) -> DataFrame:
    """reps (rep, set_key, ...) without rep, with what read, with_key() or with_sketch(), makes of their rows. A rep that
    repeats with other texts is told apart by the keys."""
    found = read(rows, words, only=id_bitmap(reps, "rep")).join(reps.where("rep is not null").withColumnRenamed("rep", "doc_id"), ["doc_id", "set_key"]).drop("doc_id")
    if reps.where("rep is null").limit(1).count():
        nameless = read(rows.where("doc_id is null"), words).drop("doc_id").join(reps.where("rep is null").drop("rep"), "set_key")
        found = found.unionByName(nameless)
    return found.withColumnRenamed("set_key", "member")


def ngram_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """ngram_components() with set_key and group, which tell rows and groups of one id apart; null for rows without words."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bits = cell_bits(docs.count())
    digested = cut(digest(docs, doc_id, text, words, bits))
    keys = digested.where("part is null").select("doc_id", "set_key", "n_shingles")
    vertex = cut(keys.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.sum("n_shingles").alias("all")))
    shingles = vertex.agg(F.sum("all")).first()[0] or 0
    common = common_cells(digested.where("part is not null"), shingles, bits)
    # one row of each set sends signatures; a few others whose id hashes alike, or repeats, do no harm
    only = id_bitmap(vertex, "rep")
    near = candidates(rows, common, only, words, percent)
    common.destroy()
    only.destroy()
    clusters = cut(connected_components(near).toDF("set_key", "cluster"), near)
    of_set = vertex.select("set_key", "rep", "n")
    reps = cut(blocks_of(clusters.join(of_set, "set_key"), percent), clusters)
    large = reps.where("level != -2")
    if large.limit(1).count():  # sketches move once for each block, so that fewer texts do
        near = cut(not_apart(of_members(large, rows, with_sketch, words), percent))
        clusters = cut(connected_components(near).toDF("set_key", "cluster"), near)
        reps = cut(reps.where("level = -2").unionByName(blocks_of(clusters.join(of_set, "set_key"), percent)), reps, clusters)
    links = cut(links_within(of_members(reps.drop("n"), rows, with_key, words), percent, words), reps)
    roots = cut(connected_components(links), links)
    group = vertex.join(roots, vertex["set_key"] == roots["node"], "left").select("set_key", "rep", F.coalesce("root", "set_key").alias("root"))
    lowest = group.groupBy("root").agg(F.min("rep").alias("low"), F.count("*").alias("members")).where("members > 1").drop("members")
    # the computed key lets the join deal both sides, so that the part of a large group can be split
    lowest = lowest.select(F.col("root").bitwiseXOR(F.lit(0)).alias("of"), "low")
    of_key = group.join(lowest, F.col("root") == F.col("of"), "left").select("set_key", F.col("root").alias("group"), F.coalesce("low", "rep").alias("component_id"))
    of_key = cut(of_key, roots, vertex)  # so that the caller's step is one join, not all of these at once in the driver
    return keys.join(of_key, "set_key", "left").select("doc_id", "set_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "group")


def ngram_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a text of fewer than `words` words has one shingle; a null
    or wordless text has none and links with nothing, nor does a null doc_id pass on as an id: its row keeps a null or
    its group's smallest. Repeated rows stay repeated. Other columns of docs are not read. Sets are compared by
    64-bit hashes of their shingles.
    """
    return ngram_groups(docs, doc_id, text, words, percent).drop("set_key", "group")
