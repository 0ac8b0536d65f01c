"""Language-model scoring with a hashed maximum-entropy model.

The softmax is factored over classes within classes: a token is reached by choices among four, each a softmax of its own,
so that the whole vocabulary is in the model and a text costs as many steps as its tokens are unlikely. The most frequent
tokens are dealt into classes of like mass, by which frequent ones come first; all others lie behind one class more, dealt
by the digits of their hashes, and those of one last class share it by their counts. Every choice has the log shares of
its classes as a bias and adds hashed weights of three features: the token before, the one before that (skip), and both.

Weights are trained by synchronised gradient updates: in each round a part of the training documents gives, for every
weight, how often its feature and class were seen and how often the model expects them, summed over all tasks; the update
is a damped step along the log of their ratio, the scaled gradient of generalised iterative scaling. Sums don't depend on
how documents are dealt to tasks. Counts of all tokens are exact: tokens that are not in the broadcast head of the
vocabulary are looked up where their counts lie, and the answers return to the batch that asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import by_part, runs
from .kernels import CHUNK_BYTES, U, chunks, lower_table, mix, space_table, span_hashes, word_spans
from .labelled import fold
from .runtime import cut, tidied, tidy, width

END = U(0x0E17D0C5)
#: tokens whose counts and codes are broadcast, 60 bytes each at most
HEAD = 1 << 18
#: classes of a choice, two bits; features of a position; bound of a weight
WAYS, BITS, FEATURES, BOUND = 4, 2, 3, 12
#: hashed rows of weights: a power of two near one for SHARE counted tokens, within bounds (8 bytes a row are broadcast)
LEAST_ROWS, MOST_ROWS, SHARE = 1 << 14, 1 << 19, 1
#: counted tokens of a last class behind the head, and most choices to it (which bounds what is broadcast of them)
LEAF, MOST_STEPS = 8, 10
#: tokens that are worked on at once
STEP = 1 << 17
#: rounds of updates, each over its share of the training documents; damping and smoothing of the updates
ROUNDS, DAMP, SMOOTH = 3, 0.4, 4.0


def sequences(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all documents, each closed by END, and the first token of each document."""
    low = lower_table()[data]
    starts, ends, first = word_spans(low, off, space_table())
    n = len(off) - 1
    out = np.full(len(starts) + n, END)
    at = np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(first))
    out[at] = span_hashes(low, starts, ends)
    return out, first + np.arange(n + 1)


def part_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    return ((tokens >> U(20)) % U(parts)).astype(np.int64)


def token_counts(texts: DataFrame, parts: int) -> DataFrame:
    """(part, blob): distinct tokens in order and their counts, as two int64 runs. texts has the one column."""

    def send(source) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0

        def flush() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(seen), return_counts=True)
            order, at = runs(part_of(tokens, parts), parts)
            tokens, n = tokens[order], n[order].astype(np.uint32)
            use = [p for p in range(parts) if at[p] < at[p + 1]]
            return pa.RecordBatch.from_arrays([pa.array(use, pa.int32()), pa.array([tokens[at[p] : at[p + 1]].tobytes() + n[at[p] : at[p + 1]].tobytes() for p in use], pa.binary())], names=["part", "blob"])

        for batch in source:
            for _, _, data, off in chunks(batch.column(0)):
                seen.append(sequences(data, off)[0])
                held += len(seen[-1])
                if held > 4_000_000:
                    yield flush()
                    seen, held = [], 0
        if held:
            yield flush()

    def add(source) -> Iterator[pa.RecordBatch]:
        for part, blobs in by_part(source):
            n = [len(b) // 12 for b in blobs]
            tokens = np.concatenate([np.frombuffer(b, U, k) for b, k in zip(blobs, n, strict=True)])
            count = np.concatenate([np.frombuffer(b, np.uint32, k, 8 * k) for b, k in zip(blobs, n, strict=True)]).astype(np.int64)
            order = np.argsort(tokens, kind="stable")
            tokens = tokens[order]
            at = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([tokens[at].tobytes() + np.add.reduceat(count[order], at).tobytes()], pa.binary())], names=["part", "blob"])

    return texts.mapInArrow(tidy(send), "part int, blob binary").repartition(width(texts.sparkSession), "part").sortWithinPartitions("part").mapInArrow(tidy(add), "part int, blob binary")


def size_bin(count: np.ndarray) -> np.ndarray:
    """Counts up to 64 apart, then in steps of a sixteenth of their doubling; larger bins hold larger counts."""
    return np.where(count < 64, count, 64 + np.floor(np.log2(np.maximum(count, 1) / 64) * 16)).astype(np.int64)


def vocabulary(counts: DataFrame, head: int = HEAD) -> tuple[np.ndarray, np.ndarray, int, int]:
    """At most `head` most frequent tokens, whole bins of like counts at a time and END, in order; their counts; the number
    of all tokens and of all distinct ones."""

    def bins(source) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for b in batch.column(1):
                x = np.frombuffer(b.as_buffer(), np.int64)
                c = x[len(x) // 2 :]
                k, at = np.unique(size_bin(c), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.bincount(at)), pa.array(np.bincount(at, weights=c).astype(np.int64))], names=["bin", "v", "n"])

    rows = counts.mapInArrow(tidy(bins), "bin long, v long, n long").groupBy("bin").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy(F.desc("bin")).collect()
    n, v = sum(r["n"] for r in rows), sum(r["v"] for r in rows)
    least, taken = 1 << 60, 0
    for r in rows:
        if taken + r["v"] > head:
            break
        least, taken = r["bin"], taken + r["v"]

    def top(source) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for b in batch.column(1):
                x = np.frombuffer(b.as_buffer(), np.int64)
                t, c = x[: len(x) // 2], x[len(x) // 2 :]
                keep = (size_bin(c) >= least) | (t.view(U) == END)
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([t[keep], c[keep]]).tobytes()], pa.binary())], names=["blob"])

    found = [np.frombuffer(r["blob"], np.int64) for r in counts.mapInArrow(tidy(top), "blob binary").collect()]
    tokens = np.concatenate([x[: len(x) // 2] for x in found] or [np.zeros(0, np.int64)]).view(U)
    count = np.concatenate([x[len(x) // 2 :] for x in found] or [np.zeros(0, np.int64)])
    order = np.argsort(tokens)
    return tokens[order], count[order], int(n), int(v)


def digits_of(tokens: np.ndarray, steps: int) -> np.ndarray:
    """The last class of each token behind the head: the leading digits of its hash."""
    return (mix(tokens ^ U(0x5851F42D4C957F2D)) >> U(64 - BITS * steps)).astype(np.int64)


def tail_mass(counts: DataFrame, head: np.ndarray, steps: int) -> np.ndarray:
    """Sums of count + 1 of the tokens behind the head by last class. Each task sums a range of the classes, so what
    reaches the driver is the table, whose size is bounded."""
    spark = counts.sparkSession
    known = spark.sparkContext.broadcast(head)
    ranges = min(width(spark), WAYS**steps)
    piece = -(-(WAYS**steps) // ranges)

    def run(source) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for b in batch.column(1):
                x = np.frombuffer(b.as_buffer(), np.int64)
                t, c = x[: len(x) // 2].view(U), x[len(x) // 2 :]
                rest = ~find(known.value, t)[1]
                leaf, at = np.unique(digits_of(t[rest], steps), return_inverse=True)
                mass = np.bincount(at, weights=c[rest] + 1.0, minlength=len(leaf))
                cut_at = np.searchsorted(leaf, np.arange(ranges + 1) * piece)
                use = [p for p in range(ranges) if cut_at[p] < cut_at[p + 1]]
                if use:
                    yield pa.RecordBatch.from_arrays([pa.array(use, pa.int32()), pa.array([leaf[cut_at[p] : cut_at[p + 1]].tobytes() + mass[cut_at[p] : cut_at[p + 1]].tobytes() for p in use], pa.binary())], names=["part", "blob"])

    def add(source) -> Iterator[pa.RecordBatch]:
        for part, blobs in by_part(source):
            total = np.zeros(piece)
            for b in blobs:
                k = len(b) // 16
                total[np.frombuffer(b, np.int64, k) - part * piece] += np.frombuffer(b, np.float64, k, 8 * k)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["part", "blob"])

    out = np.zeros(piece * ranges, np.float32)
    for r in counts.mapInArrow(tidy(run), "part int, blob binary").repartition(width(spark), "part").sortWithinPartitions("part").mapInArrow(tidy(add), "part int, blob binary").collect():
        out[r["part"] * piece : (r["part"] + 1) * piece] = np.frombuffer(r["blob"], np.float32)
    return out[: WAYS**steps]


def coded(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes within classes over items of these masses. Of each item the bounds of its choices in the next two arrays,
    the node and the class of every choice, and the log shares of each node's classes."""
    order = np.argsort(-mass, kind="stable")
    total = np.concatenate([[0.0], np.cumsum(mass[order])])
    middle = (total[1:] + total[:-1]) / 2
    lo, hi = np.zeros(1, np.int64), np.full(1, len(mass))  # nodes of a step, as ranges of the order
    steps, tables, n_nodes = [], [], 0
    while len(lo):
        size = hi - lo
        item = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        node = np.repeat(np.arange(len(lo)), size)
        whole = total[hi] - total[lo]
        side = np.minimum((WAYS * (middle[item] - total[lo][node]) / whole[node]).astype(np.int64), WAYS - 1)
        # a first item that fills more than a class pushes the rest on; items that would stay together are dealt by number
        rank = item - lo[node]
        stuck = (np.bincount(node * WAYS + side, minlength=len(lo) * WAYS).reshape(-1, WAYS) == size[:, None]).any(axis=1)
        side = np.where(stuck[node], np.minimum(rank * WAYS // size[node], WAYS - 1), side)
        steps.append((item, node + n_nodes, side))
        share = np.bincount(node * WAYS + side, weights=mass[order[item]], minlength=len(lo) * WAYS).reshape(-1, WAYS)
        with np.errstate(divide="ignore"):
            tables.append(np.where(share > 0, np.log(share / whole[:, None]), -60.0))
        n_nodes += len(lo)
        begin = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (side[1:] != side[:-1])]))
        count = np.diff(np.append(begin, len(item)))
        lo, hi = item[begin][count > 1], (item[begin] + count)[count > 1]
    item = np.concatenate([s[0] for s in steps])
    by_item = np.lexsort((np.concatenate([np.full(len(s[0]), k) for k, s in enumerate(steps)]), order[item]))
    first = np.searchsorted(order[item][by_item], np.arange(len(mass) + 1))
    return first, np.concatenate([s[1] for s in steps])[by_item].astype(np.int32), np.concatenate([s[2] for s in steps])[by_item].astype(np.int8), np.concatenate(tables).astype(np.float32)


def model_of(tokens: np.ndarray, counts: np.ndarray, tail: np.ndarray, steps: int) -> tuple:
    """The frame of the model as plain values, so that workers need no class to read them: head tokens and counts; bounds,
    nodes and classes of their choices, the last for all tokens behind the head; log shares; choices and mass behind the
    head; the first node there."""
    mass = np.append(counts + 1.0, tail.sum() + len(tail))
    if len(mass) == 1:
        first, node, side, bias = np.zeros(2, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int8), np.zeros((0, WAYS), np.float32)
    else:
        first, node, side, bias = coded(mass)
    behind, level = [], tail.astype(np.float64) + 1
    for _ in range(steps):
        four = level.reshape(-1, WAYS)
        behind.append(np.log(four / four.sum(axis=1, keepdims=True)).astype(np.float32))
        level = four.sum(axis=1)
    return tokens, counts, first, node, side, np.concatenate([bias, *behind[::-1]]), steps, tail, len(bias)


def fresh(v: int) -> np.ndarray:
    """Zero weights for so many distinct tokens."""
    rows = min(MOST_ROWS, max(LEAST_ROWS, 1 << max(0, v // SHARE).bit_length()))
    return np.zeros((rows, WAYS), np.float32)


def contexts(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of the three features of every position."""
    one, two = np.zeros_like(tokens), np.zeros_like(tokens)
    one[1:], two[2:] = tokens[:-1], tokens[:-2]
    begin = first[:-1]
    one[begin], two[begin] = U(1), U(2)
    second = begin[np.diff(first) > 1] + 1
    two[second] = U(2)
    with np.errstate(over="ignore"):
        return np.stack([mix(one ^ U(0x1F123BB5)), mix(two ^ U(0x7A5E3C91D1)), mix(one * U(0x9E3779B97F4A7C15) + two)])


def find(sorted_tokens: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each token in a sorted table, and whether it is there."""
    if not len(sorted_tokens):
        return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
    u, inverse = np.unique(tokens, return_inverse=True)
    pos = np.minimum(np.searchsorted(sorted_tokens, u), len(sorted_tokens) - 1)
    return pos[inverse], (sorted_tokens[pos] == u)[inverse]


def choices(model: tuple, tokens: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each token its place in the head and whether it is there; for each choice on the way to the tokens: its token's
    number, node and class."""
    head, _, first, node, side, _, steps, _, base = model
    pos, there = find(head, tokens)
    code = np.where(there, pos, len(first) - 2)
    size = first[code + 1] - first[code]
    at = np.repeat(np.arange(len(tokens), dtype=np.int32), size)
    place = np.arange(len(at)) + np.repeat(first[code] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    nodes, sides = node[place], side[place]
    out = np.flatnonzero(~there)
    if len(out) and steps:
        leaf = digits_of(tokens[out], steps)
        down = np.arange(steps)
        far = leaf[:, None] >> (BITS * (steps - down))
        nodes = np.concatenate([nodes, (base + (WAYS**down - 1) // (WAYS - 1) + far).ravel().astype(np.int32)])
        sides = np.concatenate([sides, ((leaf[:, None] >> (BITS * (steps - 1 - down))) & (WAYS - 1)).ravel().astype(np.int8)])
        at = np.concatenate([at, np.repeat(out.astype(np.int32), steps)])
    return pos, there, at, nodes, sides


def weight_rows(ctx: np.ndarray, at: np.ndarray, node: np.ndarray, n: int) -> list[np.ndarray]:
    """Rows of the three features' weights of each choice."""
    out = []
    with np.errstate(over="ignore"):
        own = node.astype(U)
        own *= U(0xD1B54A32D192ED03)
        for c in ctx:
            r = np.take(c, at)
            r ^= own
            r *= U(0x9E3779B97F4A7C15)
            r >>= U(65 - n.bit_length())
            out.append(r.view(np.int64))
    return out


def of_rows(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of a table of four floats, which move as one value each."""
    return np.take(table.view(np.complex128)[:, 0], rows).view(np.float32).reshape(-1, WAYS)


def odds(bias: np.ndarray, weights: np.ndarray, node: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Unnormalised probabilities of the classes of each choice, and their sums. Weights are bounded, so nothing overflows."""
    x = of_rows(bias, node)
    for r in rows:
        x += of_rows(weights, r)
    np.exp(x, out=x)
    total = x[:, 0] + x[:, 1]
    total += x[:, 2]
    total += x[:, 3]
    return x, total


def log_probability(model: tuple, weights: np.ndarray, ctx: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Natural log of the model's probability of each token, or of its last class behind the head; place in the head and
    whether it is there."""
    out, pos, there = np.empty(len(tokens)), np.empty(len(tokens), np.int64), np.empty(len(tokens), bool)
    for lo in range(0, len(tokens), STEP):
        s = slice(lo, min(len(tokens), lo + STEP))
        pos[s], there[s], at, node, side = choices(model, tokens[s])
        x, total = odds(model[5], weights, node, weight_rows(ctx[:, s], at, node, len(weights)))
        y = np.take(x.ravel(), np.arange(0, x.size, WAYS) + side)
        y /= total
        np.log(y, out=y)
        out[s] = np.bincount(at, weights=y, minlength=s.stop - lo)
    return out, pos, there


def seen_and_expected(model: tuple, weights: np.ndarray, ctx: np.ndarray, tokens: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> None:
    """Add what these tokens show (a row of classes after the other) and what the model expects of their contexts (a class
    after the other; the last is what the others leave of what was seen)."""
    for lo in range(0, len(tokens), STEP):
        s = slice(lo, min(len(tokens), lo + STEP))
        _, _, at, node, side = choices(model, tokens[s])
        rows = weight_rows(ctx[:, s], at, node, len(weights))
        x, total = odds(model[5], weights, node, rows)
        seen += np.bincount(np.concatenate(rows) * WAYS + np.tile(side, FEATURES), minlength=len(seen))
        for k in range(WAYS - 1):
            share = (x[:, k] / total).astype(np.float64)
            for r in rows:
                expected[k] += np.bincount(r, weights=share, minlength=len(weights))


def shortened(x: np.ndarray) -> bytes:
    """Floats by their upper 16 bits."""
    return ((np.ascontiguousarray(x, np.float32).view(np.uint32) + np.uint32(0x8000)) >> np.uint32(16)).astype(np.uint16).tobytes()


def lengthened(b, n: int, at: int) -> np.ndarray:
    return (np.frombuffer(b, np.uint16, n, at).astype(np.uint32) << np.uint32(16)).view(np.float32)


def updated(texts: DataFrame, model, w: np.ndarray, damp: float = DAMP, smooth: float = SMOOTH) -> np.ndarray:
    """The weights after one update over all texts. model: broadcast. Tasks send their sums by ranges of weights."""
    spark = texts.sparkSession
    tidied(spark)
    start = spark.sparkContext.broadcast(w.astype(np.float16))
    ranges = min(width(spark), 1024)
    piece = -(-len(w) // ranges)

    def run(source) -> Iterator[pa.RecordBatch]:
        m, weights = model.value, start.value.astype(np.float32)
        seen, expected = np.zeros(weights.size), np.zeros((WAYS - 1, len(weights)))
        some = False
        for batch in source:
            for _, _, data, off in chunks(batch.column(0)):
                tokens, first = sequences(data, off)
                seen_and_expected(m, weights, contexts(tokens, first), tokens, seen, expected)
                some = True
        for p in range(ranges if some else 0):
            lo, hi = p * piece, min(len(weights), (p + 1) * piece)
            if lo < hi:
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([shortened(seen[lo * WAYS : hi * WAYS]) + shortened(expected[:, lo:hi])], pa.binary())], names=["part", "blob"])

    def step(source) -> Iterator[pa.RecordBatch]:
        for part, blobs in by_part(source):
            n = len(blobs[0]) // (2 * (2 * WAYS - 1))
            seen, expected = np.zeros((n, WAYS)), np.zeros((n, WAYS))
            for b in blobs:
                seen += lengthened(b, n * WAYS, 0).reshape(n, WAYS)
                expected[:, :-1] += lengthened(b, n * (WAYS - 1), 2 * n * WAYS).reshape(WAYS - 1, n).T
            expected[:, -1] = np.maximum(seen.sum(axis=1) - expected.sum(axis=1), 0)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([(damp * np.log((seen + smooth) / (expected + smooth))).astype(np.float16).tobytes()], pa.binary())], names=["part", "blob"])

    found = texts.mapInArrow(tidy(run), "part int, blob binary").repartition(width(spark), "part").sortWithinPartitions("part").mapInArrow(tidy(step), "part int, blob binary").collect()
    out = w.copy().ravel()
    for r in found:
        change = np.frombuffer(r["blob"], np.float16)
        out[r["part"] * piece * WAYS : r["part"] * piece * WAYS + len(change)] += change
    start.unpersist()
    return np.clip(out.reshape(w.shape), -BOUND, BOUND)


HOME = np.dtype([("n", "<i8"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")])


def score_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Tokens are words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, then one END; a null text is empty and has END only.
    base_score is the sum of log10((c + 1) / (N + V + 1)); score is the model's log10 probability of the text. Of a last class
    behind the head, whose counted tokens have the counts c, a token has the share (c + 1) / (sum of c + 1 over them, + 1);
    the rest of it is for all tokens that were not counted.
    Rows of a null id are not held out. Repeated rows count again. Without training rows all counts are 0 and the model
    is its prior. An empty table gives no rows. Tokens are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    parts = min(60_000, 2 * width(spark))
    out = F.coalesce(fold(doc_id, folds) == held, F.lit(False))
    learn = docs.where(~out).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counts = cut(token_counts(learn.select("text"), parts))
    tokens, c, n, v = vocabulary(counts, head)
    rest = v - len(tokens)
    steps = min(MOST_STEPS, max(1, (max(1, rest // LEAF).bit_length() + 1) // BITS))
    model = spark.sparkContext.broadcast(model_of(tokens, c, tail_mass(counts, tokens, steps), steps))
    w = fresh(v)
    for k in range(rounds):
        share = learn.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k) if rounds > 1 else learn
        w = updated(share.select("text"), model, w)
    tidied(spark)
    weights = spark.sparkContext.broadcast(w.astype(np.float16))
    rows = docs.select(F.col(doc_id).alias("doc_id"), out.alias("held_out"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    log_all = float(np.log10(n + v + 1))

    def score(source) -> Iterator[pa.RecordBatch]:
        """Rows of two kinds: a batch's documents with what is known of them, and what it asks of each part."""
        from pyspark import TaskContext

        m, w = model.value, weights.value.astype(np.float32)
        log_tail, head_counts = np.log10(m[7].astype(np.float64) + 1), np.append(m[1], 0)
        batch_no = (TaskContext.get().partitionId() << 24) - 1
        for batch in source:
            for lo, hi, data, off in chunks(batch.column(2), 4 * CHUNK_BYTES):
                batch_no += 1
                n_docs = hi - lo
                home = np.zeros(n_docs, HOME)
                asked, asked_doc = [], []
                for a, b, part_data, part_off in slices(data, off):
                    tokens, first = sequences(part_data, part_off)
                    y, pos, there = log_probability(m, w, contexts(tokens, first), tokens)
                    c = np.where(there, head_counts[pos], 0)
                    doc = np.repeat(np.arange(a, b), np.diff(first))
                    here = slice(a, b)
                    add = lambda x, doc=doc: np.bincount(doc - a, weights=x, minlength=b - a)  # noqa: B023, E731
                    home["n"][here] = np.diff(first)
                    home["known"][here] = add(there)
                    home["base"][here] = add(np.log10(c + 1) - log_all)
                    rest = np.flatnonzero(~there)
                    y /= np.log(10)
                    y[rest] -= log_tail[digits_of(tokens[rest], m[6])]
                    home["score"][here] = add(y)
                    asked.append(tokens[rest])
                    asked_doc.append(doc[rest])
                asked, asked_doc = np.concatenate(asked), np.concatenate(asked_doc).astype(np.uint32)
                order, at = runs(part_of(asked, parts), parts)
                use = [p for p in range(parts) if at[p] < at[p + 1]]
                blobs = [asked[order[at[p] : at[p + 1]]].tobytes() + asked_doc[order[at[p] : at[p + 1]]].tobytes() for p in use]
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([("doc_id", batch.schema.field(0).type), ("held_out", pa.bool_())])) as writer:
                    writer.write_batch(pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n_docs), batch.column(1).slice(lo, n_docs)], names=["doc_id", "held_out"]))
                blobs.append(home.tobytes())
                ids = [None] * len(use) + [sink.getvalue().to_pybytes()]
                yield pa.RecordBatch.from_arrays([pa.array([*use, -1], pa.int32()), pa.array([batch_no] * len(blobs), pa.int64()), pa.array(blobs, pa.binary()), pa.array(ids, pa.binary())], names=["part", "batch", "blob", "ids"])

    def answer(source) -> Iterator[pa.RecordBatch]:
        """A part's counts come first; each request gets its documents' sums of log10(c + 1) and of c > 0."""
        now, tokens, count = None, np.zeros(0, U), np.zeros(0, np.int64)
        for batch in source:
            for p, b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                blob = blob.as_buffer()
                if b < 0:
                    x = np.frombuffer(blob, np.int64)
                    now, tokens, count = p, x[: len(x) // 2].view(U), x[len(x) // 2 :]
                    continue
                k = len(blob) // 12
                t, doc = np.frombuffer(blob, U, k), np.frombuffer(blob, np.uint32, k, 8 * k)
                c = np.zeros(k, np.int64)
                if now == p:
                    pos, there = find(tokens, t)
                    c = np.where(there, count[pos], 0)
                docs_in, inverse = np.unique(doc, return_inverse=True)
                sums = np.bincount(inverse, weights=np.log10(c + 1)).astype(np.float64)
                known = np.bincount(inverse, weights=c > 0).astype(np.uint32)
                some = known > 0
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([b], pa.int64()), pa.array([sums[some].tobytes() + docs_in[some].tobytes() + known[some].tobytes()], pa.binary()), pa.array([None], pa.binary())], names=["part", "batch", "blob", "ids"])

    def gather(source) -> Iterator[pa.RecordBatch]:
        """A batch's documents come first (part -1), then its answers."""
        now, home, ids = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids.column(0), ids.column(1), pa.array(home["n"]), pa.array(home["known"]), pa.array(np.full(len(home), v_n), pa.int64()), pa.array(home["base"]), pa.array(home["score"])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for batch in source:
            for p, b, blob, who in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if b != now:
                    if now is not None:
                        yield done()
                    if p != -1:
                        raise RuntimeError("answers came without their batch")
                    now, home = b, np.frombuffer(blob.as_buffer(), HOME).copy()
                    ids = pa.ipc.open_stream(who.as_buffer()).read_next_batch()
                    continue
                blob = blob.as_buffer()
                k = len(blob) // 16
                sums, doc, known = np.frombuffer(blob, np.float64, k), np.frombuffer(blob, np.uint32, k, 8 * k), np.frombuffer(blob, np.uint32, k, 12 * k)
                home["base"][doc] += sums
                home["score"][doc] += sums
                home["known"][doc] += known
        if now is not None:
            yield done()

    v_n = n
    form = "part int, batch long, blob binary, ids binary"
    sent = cut(rows.mapInArrow(tidy(score), form))
    asked = sent.where("part >= 0").unionByName(counts.select("part", F.lit(-1).cast("long").alias("batch"), "blob", F.lit(None).cast("binary").alias("ids")))
    answers = asked.repartition(width(spark), "part").sortWithinPartitions("part", "batch").mapInArrow(tidy(answer), form)
    final = sent.where("part = -1").unionByName(answers).repartition(width(spark), "batch").sortWithinPartitions("batch", "part")
    return final.mapInArrow(tidy(gather), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def slices(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A batch's documents in runs of about a chunk."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK_BYTES, side="right")) - 1))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
