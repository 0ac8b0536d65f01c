"""Removal of every byte under a long string that stands anywhere else too, by suffix sorting of sharded text.

Every string of `length` bytes is keyed by the least hash of the `gram`-byte strings in it, so equal strings have equal
keys. Neighbouring strings of one key make a piece of a document. A key of one piece has nothing that repeats. Pieces
alike in bytes are counted before anything moves: with a copy elsewhere, all their strings repeat. Of keys with
different pieces, one copy of each goes to the shard of its key, where suffix sorting (suffix_sort) gives the strings
whose neighbour in suffix order shares `length` bytes. Only these pieces' texts are shuffled.

Shorter passages that stand in several rows are not removed but counted: of each row the strings that are least by hash
among their neighbours are sent with the pieces, so that two rows with a passage in common have one of its strings in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import SCHEMA, batches, by_part, runs
from .kernels import U, _ODD, _power_of, chunks, mix, text_bytes
from .prefilter import id_bitmap, maybe_in
from .runtime import cut, tidy, width
from .suffix_sort import repeated

LENGTH = 400
GRAM = 120
#: bytes of the strings by which shared passages are counted, and of the shortest passage that surely has one
MARK, PASSAGE = 220, 300
#: bytes of pieces that are sorted at once
SHARD = 400_000
#: a key of more bytes has its pieces keyed again, by the least hash of nearly whole strings
HOT = 600_000
FLUSH = 40_000


def sliding_least(values: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbouring values."""
    n = len(values)
    room = -(-n // w) * w
    x = np.full(room, np.iinfo(np.uint64).max, np.uint64)
    x[:n] = values
    x = x.reshape(-1, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def pieces_of(data: np.ndarray, off: np.ndarray, length: int, gram: int):
    """(key, content hash, document, start in the document, bytes, may repeat in itself) of all pieces."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (U, U, np.int64, np.int64, np.int64, bool))
    with np.errstate(over="ignore"):
        power = np.full(n + 1, U(_ODD))
        power[0] = U(1)
        np.multiply.accumulate(power, out=power)
        total = np.empty(n + 1, U)
        total[0] = 0
        np.cumsum((data.astype(U) + U(1)) * power[n:0:-1], out=total[1:])
        level = _power_of(U(_ODD), (1 << 62) - n)
        h = mix((total[gram:] - total[:-gram]) * power[gram:] * level)
        bits = U(max(1, int(n).bit_length()))
        w = length - gram + 1
        least = sliding_least(((h >> bits) << bits) | np.arange(len(h), dtype=U), w)
        where = (least & ((U(1) << bits) - U(1))).astype(np.int64)
        key = h[where]
        n_docs = len(off) - 1
        doc = np.repeat(np.arange(n_docs), np.diff(off))[: len(key)]
        valid = np.arange(len(key)) + length <= off[1:][doc]
        new = valid.copy()
        new[1:] &= (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
        last = valid.copy()
        last[:-1] &= (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | ~valid[1:]
        s, e = np.flatnonzero(new), np.flatnonzero(last)
        end = e + length
        content = mix(((total[end] - total[s]) * power[end] * level) ^ (mix((end - s).astype(U))))
    return key[s], content, doc[s], s - off[doc[s]], end - s, where[s] != where[e]


def marks_of(data: np.ndarray, off: np.ndarray, mark: int = MARK, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the distinct strings of `mark` bytes that have the least hash among those of some `passage` bytes."""
    n = len(data)
    if n < passage:
        return np.zeros(0, U), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        power = np.full(n + 1, U(_ODD))
        power[0] = U(1)
        np.multiply.accumulate(power, out=power)
        total = np.empty(n + 1, U)
        total[0] = 0
        np.cumsum((data.astype(U) + U(1)) * power[n:0:-1], out=total[1:])
        h = mix((total[mark:] - total[:-mark]) * power[mark:] * _power_of(U(_ODD), (1 << 62) - n) ^ U(0x2127599BF4325C37))
    least = sliding_least(h, passage - mark + 1)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(least)]
    inside = np.arange(len(least)) + passage <= off[1:][doc]
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    h, doc = least[new], doc[new]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    once = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
    return h[once], doc[once]


def text_keys(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hash of each document's bytes."""
    return np.array([int.from_bytes(hashlib.blake2b(data[off[d] : off[d + 1]], digest_size=8).digest(), "little") for d in range(len(off) - 1)], U)


PIECE = np.dtype([("key", "<u8"), ("content", "<u8"), ("id", "<i8"), ("text", "<u8"), ("start", "<i8"), ("size", "<i4"), ("self", "?"), ("pad", "V3")])


SHARED = np.dtype([("hash", "<u8"), ("id", "<i8"), ("text", "<u8")])


def candidates(rows: DataFrame, length: int, gram: int, marks: bool = False) -> DataFrame:
    """(doc_id, text_key, key, content, start, size, whole, sort, marks): the pieces that may hold repeats.

    whole: another piece is alike in all bytes. sort: the piece stands for its like in the suffix sort. With marks there
    are other rows too, in which only doc_id, text_key and marks, the number of strings found in other rows, have values.
    """
    parts = min(60_000, 2 * width(rows.sparkSession))

    def send(source) -> Iterator[pa.RecordBatch]:
        found, shared, held = [], [], 0

        def flush() -> pa.RecordBatch:
            all_pieces = np.concatenate(found)
            order, at = runs((all_pieces["key"] % U(parts)).astype(np.int64), parts)
            all_pieces = all_pieces[order]
            use = [p for p in range(parts) if at[p] < at[p + 1]]
            blobs = [all_pieces[at[p] : at[p + 1]].tobytes() for p in use]
            x = np.concatenate(shared) if shared else np.zeros(0, SHARED)
            order, at = runs((x["hash"] % U(parts)).astype(np.int64), parts)
            x = x[order]
            more = [p for p in range(parts) if at[p] < at[p + 1]]
            return batches([*use, *(parts + p for p in more)], [*blobs, *(x[at[p] : at[p + 1]].tobytes() for p in more)])

        for batch in source:
            ids = np.asarray(batch.column(0))
            for lo, _, data, off in chunks(batch.column(1)):
                key, content, doc, start, size, again = pieces_of(data, off, length, gram)
                x = np.zeros(len(key), PIECE)
                names = text_keys(data, off)
                x["key"], x["content"], x["id"], x["text"], x["start"], x["size"], x["self"] = key, content, ids[lo + doc], names[doc], start, size, again
                found.append(x)
                held += len(x)
                if marks:
                    h, doc = marks_of(data, off)
                    y = np.zeros(len(h), SHARED)
                    y["hash"], y["id"], y["text"] = h, ids[lo + doc], names[doc]
                    shared.append(y)
                    held += len(y)
                if held > FLUSH * 4:
                    yield flush()
                    found, shared, held = [], [], 0
        if held:
            yield flush()

    def meet(source) -> Iterator[pa.RecordBatch]:
        for part, blobs in by_part(source):
            if part >= parts:
                x = np.concatenate([np.frombuffer(b, SHARED) for b in blobs])
                x = x[np.argsort(x["hash"], kind="stable")]
                same = x["hash"][1:] == x["hash"][:-1]
                x = x[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
                if len(x):
                    x = x[np.lexsort((x["text"], x["id"]))]
                    at = np.flatnonzero(np.concatenate([[True], (x["id"][1:] != x["id"][:-1]) | (x["text"][1:] != x["text"][:-1])]))
                    none = [pa.nulls(len(at), k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_())]
                    yield pa.RecordBatch.from_arrays([pa.array(x["id"][at]), pa.array(x["text"][at].view(np.int64)), *none, pa.array(np.diff(np.append(at, len(x))))], names=NAMES)
                continue
            x = np.concatenate([np.frombuffer(b, PIECE) for b in blobs])
            x = x[np.argsort(x["key"], kind="stable")]
            first = np.flatnonzero(np.concatenate([[True], x["key"][1:] != x["key"][:-1]]))
            size = np.diff(np.append(first, len(x)))
            group = np.repeat(np.arange(len(first)), size)
            keep = (size > 1)[group] | x["self"]
            x, group = x[keep], group[keep]
            if not len(x):
                continue
            order = np.lexsort((x["content"], group))
            x, group = x[order], group[order]
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (x["content"][1:] != x["content"][:-1])])
            kind = np.cumsum(new) - 1
            copies = np.bincount(kind)
            kinds = np.bincount(group[new], minlength=len(first))
            whole = (copies > 1)[kind]
            sort = new & ((kinds[group] > 1) | (x["self"] & ~whole))
            for lo in range(0, len(x), 100_000):
                s = slice(lo, lo + 100_000)
                y = x[s]
                yield pa.RecordBatch.from_arrays([pa.array(y["id"]), pa.array(y["text"].view(np.int64) if y["text"].flags.c_contiguous else y["text"].copy().view(np.int64)), pa.array(y["key"].copy().view(np.int64)), pa.array(y["content"].copy().view(np.int64)), pa.array(y["start"]), pa.array(y["size"]), pa.array(whole[s]), pa.array(sort[s]), pa.nulls(len(y), pa.int64())], names=NAMES)

    sent = rows.mapInArrow(tidy(send), SCHEMA)
    return sent.repartition(width(rows.sparkSession), "part").sortWithinPartitions("part").mapInArrow(tidy(meet), "doc_id long, text_key long, key long, content long, start long, size int, whole boolean, sort boolean, marks long")


NAMES = ["doc_id", "text_key", "key", "content", "start", "size", "whole", "sort", "marks"]


def piece_bytes(found: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, content, bytes) of the pieces that are to be sorted, one of each content."""
    wanted = found.where("sort").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "size", "key", "content")).alias("cuts"))
    wanted = cut(wanted)
    near = maybe_in(rows, "doc_id", id_bitmap(wanted, "doc_id")).join(wanted, "doc_id").select("text", "text_key", "cuts")

    def run(source) -> Iterator[pa.RecordBatch]:
        for batch in source:
            raw, off = text_bytes(batch.column(0))
            keys = text_keys(raw, off)
            want = batch.column(1).to_pylist()
            for d, cuts in enumerate(batch.column(2).to_pylist()):
                if int(keys[d : d + 1].view(np.int64)[0]) == want[d]:
                    b = raw[off[d] : off[d + 1]].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([c["key"] for c in cuts], pa.int64()), pa.array([c["content"] for c in cuts], pa.int64()), pa.array([b[c["start"] : c["start"] + c["size"]] for c in cuts], pa.binary())], names=["key", "content", "bytes"])

    return near.mapInArrow(tidy(run), "key long, content long, bytes binary")


def sorted_repeats(pieces: DataFrame, length: int, shard: int = SHARD) -> DataFrame:
    """(key, content, runs): byte ranges of each piece under strings that stand elsewhere among the pieces of its key."""

    def solve(held) -> pa.RecordBatch:
        starts = repeated([np.frombuffer(h[2].as_buffer(), np.uint8) for h in held], length)
        out = []
        for (key, content, _), s in zip(held, starts, strict=True):
            if len(s):
                cuts = np.flatnonzero(np.diff(s) > length)
                first, last = s[np.concatenate([[0], cuts + 1])], s[np.append(cuts, len(s) - 1)] + length
                out.append({"key": key, "content": content, "runs": [{"first": int(a), "last": int(b)} for a, b in zip(first, last, strict=True)]})
        return pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.int64()), ("content", pa.int64()), ("runs", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))]))

    def run(source) -> Iterator[pa.RecordBatch]:
        held, size, now = [], 0, None
        seen: set[int] = set()
        for batch in source:
            for key, content, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if key != now:
                    if size >= shard:
                        yield solve(held)
                        held, size = [], 0
                    now, seen = key, set()
                if content in seen:  # a repeated row gives its pieces again
                    continue
                seen.add(content)
                held.append((key, content, b))
                size += len(b.as_buffer())
        if held:
            yield solve(held)

    return pieces.repartition(width(pieces.sparkSession), "key").sortWithinPartitions("key").mapInArrow(tidy(run), "key long, content long, runs array<struct<first:long,last:long>>")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, marks: bool = False) -> DataFrame:
    """(doc_id, text_key, runs, marks): the byte ranges to remove, unmerged, and the strings shared with other rows, for
    each id and text that has any."""
    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("doc_id"), F.col(text).alias("text"))
    both = cut(candidates(rows, length, gram, marks))
    found = both.where("key is not null")
    finer = length - max(1, length // 25)
    hot = cut(found.where("sort").groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > HOT).select("key"))
    if gram < finer and hot.limit(1).count():
        # what a common passage draws together is told apart by strings that reach beyond it
        cool = sorted_repeats(piece_bytes(found.join(hot, "key", "left_anti"), rows), length)
        pieces = cut(piece_bytes(found.join(hot, "key"), rows).dropDuplicates(["key", "content"]))
        again = repeated_spans(pieces.select(F.xxhash64("key", "content").alias("doc_id"), F.col("bytes").alias("text")), length=length, gram=finer)
        again = again.select(F.col("doc_id").alias("piece"), "runs").join(pieces.select("key", "content", F.xxhash64("key", "content").alias("piece")), "piece")
        spans = cut(cool.unionByName(again.select("key", "content", "runs")))
    else:
        spans = cut(sorted_repeats(piece_bytes(found, rows), length))
    whole = found.where("whole").select("doc_id", "text_key", F.array(F.struct(F.col("start").alias("first"), (F.col("start") + F.col("size")).alias("last"))).alias("runs"))
    part = found.where("not whole").join(spans, ["key", "content"])
    part = part.select("doc_id", "text_key", F.transform("runs", lambda r: F.struct((r["first"] + F.col("start")).alias("first"), (r["last"] + F.col("start")).alias("last"))).alias("runs"))
    ranges = whole.unionByName(part).withColumn("marks", F.lit(0).cast("long"))
    counted = both.where("key is null").groupBy("doc_id", "text_key").agg(F.sum("marks").alias("marks"))
    counted = counted.select("doc_id", "text_key", F.slice(F.array(F.struct(F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"))), 1, 0).alias("runs"), "marks")
    return ranges.unionByName(counted).groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.sum("marks").alias("marks"))


def union_of(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the given ranges; ranges that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted((s["first"], s["last"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared, spans for each row of docs.

    Texts are UTF-8 bytes; a null text is empty. A byte goes if a string of `length` bytes over it starts anywhere else,
    in any row, the same one included; all strings are judged on the input. spans are the maximal removed runs. A
    repeated row is another place, so all its strings repeat. n_shared counts strings of MARK bytes that other rows have too,
    chosen so that every passage of PASSAGE bytes that two rows share is counted at least once. Null ids are allowed. An empty table gives no rows.
    Strings are told apart by 64-bit hashes where whole pieces are alike, and by their bytes otherwise.
    """
    spans = cut(repeated_spans(docs, doc_id, text, length, gram, True)).select(F.col("doc_id").alias("at"), "text_key", "runs", "marks")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("at"), F.col(text).alias("text"))
    bitmap = id_bitmap(spans, "at")
    # an id that repeats with several texts has a row of spans for each; the one of the row's own text counts
    own = spans.groupBy("at").agg(F.collect_list(F.struct("text_key", "runs", "marks")).alias("texts"))
    with_spans = maybe_in(rows, "at", bitmap).join(own, "at", "left").select("doc_id", "text", "texts")
    without = maybe_in(rows, "at", bitmap, inside=False).select("doc_id", "text", F.lit(None).cast(dict(with_spans.dtypes)["texts"]).alias("texts"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(source) -> Iterator[pa.RecordBatch]:
        for batch in source:
            raw, off = text_bytes(batch.column(1))
            n = np.diff(off)
            removed, count, digest, kept_spans, shared = [], [], [], [], []
            for d, texts in enumerate(batch.column(2).to_pylist()):
                b = raw[off[d] : off[d + 1]]
                spans, marks = [], 0
                if texts:
                    key = int(text_keys(b, np.array([0, len(b)])).view(np.int64)[0])
                    spans = union_of([r for t in texts if t["text_key"] == key for r in t["runs"]])
                    marks = sum(t["marks"] for t in texts if t["text_key"] == key)
                shared.append(marks)
                at, h = 0, hashlib.sha256()
                for x, y in spans:
                    h.update(b[at:x])
                    at = y
                h.update(b[at:])
                removed.append(sum(y - x for x, y in spans))
                count.append(len(spans))
                digest.append(h.hexdigest())
                kept_spans.append([{"start": x, "end": y} for x, y in spans])
            span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(shared, pa.int64()), pa.array(kept_spans, span_type)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "spans"])

    form = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long, spans array<struct<start:long,end:long>>"
    return with_spans.mapInArrow(tidy(run), form).unionByName(without.mapInArrow(tidy(run), form))
