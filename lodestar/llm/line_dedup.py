"""Line deduplication by pairwise alignment.

A key is a run of neighbouring lines just long enough to have the words of the shortest run that is deleted: for each
line the shortest such run from it on, and the shortest one up to it. Every line of a block that two documents share is in
a key that both have. The first document (by id) that holds a key owns it, and every later document with the key is
aligned with the owner, so that groups of any size cost one alignment a member and owner instead of one a pair. The alignment is a patience diff over line hashes: lines that are unique on both
sides anchor it by a longest increasing sequence, and the gaps between anchors are aligned likewise. Aligned runs of
enough words are deleted from the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U, chunks, mix, space_table, span_hashes, word_spans
from .prefilter import id_bitmap, maybe_in
from .quality import line_bounds
from .runtime import cut, tidy, width

#: words of the shortest run that is deleted
MIN_WORDS = 10
#: partners of an owner in one task
SPREAD = 2000
#: base of the hashes of runs of lines
BASE = U(0xD1342543DE82EF95)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Blocks (start in a, start in b, length) of a patience diff, in order."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_b: dict[int, int] = {}
        for j in range(b0, b1):
            once_b[b[j]] = -1 if b[j] in once_b else j
        once_a: dict[int, int] = {}
        for i in range(a0, a1):
            if a[i] in once_b:
                once_a[a[i]] = -1 if a[i] in once_a else i
        both = sorted((i, once_b[x]) for x, i in once_a.items() if i >= 0 and once_b[x] >= 0)
        tails, at, link = [], [], [-1] * len(both)
        for n, (_, j) in enumerate(both):
            k = bisect_left(tails, j)
            link[n] = at[k - 1] if k else -1
            if k == len(tails):
                tails.append(j)
                at.append(n)
            else:
                tails[k], at[k] = j, n
        n = at[-1] if at else -1
        ai, bi = a1, b1
        while n >= 0:
            i, j = both[n]
            pairs.append((i, j))
            todo.append((i + 1, ai, j + 1, bi))
            ai, bi, n = i, j, link[n]
        if ai < a1 or bi < b1:
            todo.append((a0, ai, b0, bi))
    blocks: list[tuple[int, int, int]] = []
    for i, j in sorted(pairs):
        if blocks and (i, j) == (blocks[-1][0] + blocks[-1][2], blocks[-1][1] + blocks[-1][2]):
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def line_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and words of every line, and the first line of each document."""
    starts, ends, first = line_bounds(data, off)
    words, _, _ = word_spans(data, off, space_table())
    return mix(span_hashes(data, starts, ends)), np.searchsorted(words, ends) - np.searchsorted(words, starts), first


def short_runs(words: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end lines of all keys: runs of at least so many words that begin and end with a word.

    words: those of each line; first: the first line of each document, and the end.
    """
    total = np.concatenate([[0], np.cumsum(words)])
    at = np.flatnonzero(words > 0)
    doc = np.searchsorted(first, at, side="right") - 1
    end = np.searchsorted(total, total[at] + least)
    start = np.searchsorted(total, total[at + 1] - least, side="right") - 1
    down, up = end <= first[doc + 1], start >= first[doc]
    both = np.unique(np.stack([np.concatenate([at[down], start[up]]), np.concatenate([end[down], at[up] + 1])]), axis=1)
    return both[0], both[1]


def run_hashes(lines: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of lines from the lines' hashes."""
    with np.errstate(over="ignore"):
        power = np.full(len(lines) + 1, BASE)
        back = np.full(len(lines) + 1, U(pow(int(BASE), -1, 1 << 64)))
        power[0] = back[0] = U(1)
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(back, out=back)
        total = np.concatenate([np.zeros(1, U), np.cumsum(lines * power[:-1])])
        return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(U))


def keys_of(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, doc_id): the distinct keys in each row of doc_id and text."""

    def run(source) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids = batch.column(0)
            for lo, _, data, off in chunks(batch.column(1)):
                h, words, first = line_hashes(data, off)
                starts, ends = short_runs(words, first, min_words)
                key, doc = run_hashes(h, starts, ends), np.searchsorted(first, starts, side="right") - 1
                order = np.lexsort((key, doc))
                d, x = doc[order], key[order]
                once = np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])]) if len(order) else np.zeros(0, bool)
                order = order[once]
                yield pa.RecordBatch.from_arrays([pa.array(key[order].view(np.int64)), ids.take(pa.array(lo + doc[order]))], names=["key", "doc_id"])

    return rows.mapInArrow(tidy(run), "key long, doc_id long")


def partners(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(owner, doc_id): later documents and the owners they are aligned with."""
    keys = cut(keys_of(rows, min_words))
    owners = keys.groupBy("key").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last")
    # the owners' key is computed, so that both sides are dealt for the join and the part of a frequent key can be split
    owners = owners.select(F.col("key").bitwiseXOR(F.lit(0)).alias("of"), "owner")
    return keys.join(owners, F.col("key") == F.col("of")).where("doc_id > owner").select("owner", "doc_id").distinct()


def aligned(pairs: DataFrame, texts: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_key, owner, runs): line ranges of each later document that align with an owner.

    texts: (doc_id, text_key, text). An owner's lines stay while its partners stream past; an owner of many partners
    is dealt over several tasks, each with a copy of its text.
    """
    many = pairs.groupBy("owner").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("g"))
    dealt = many.select(F.col("owner").bitwiseXOR(F.lit(0)).alias("of"), "g")
    split = pairs.join(dealt, F.col("owner") == F.col("of")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("g")).cast("int"))
    roles = split.select("owner", "salt", "doc_id", F.lit(1).alias("role")).unionByName(many.select("owner", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("salt"), F.col("owner").alias("doc_id"), F.lit(0).alias("role")))
    rows = roles.join(texts, "doc_id").select("owner", "salt", "role", "doc_id", "text_key", "text")

    def run(source) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in source:
            owner, salt, role, ids, keys = (batch.column(i).to_pylist() for i in range(5))
            for lo, _, data, off in chunks(batch.column(5)):
                h, words, first = line_hashes(data, off)
                out = []
                for d in range(len(off) - 1):
                    r = lo + d
                    b = h[first[d] : first[d + 1]].tolist()
                    if role[r] == 0:
                        now, own = (own_key(now, owner[r], salt[r], own, b))
                        continue
                    w = np.concatenate([[0], np.cumsum(words[first[d] : first[d + 1]])])
                    runs = []
                    for a in own if now == (owner[r], salt[r]) else []:
                        runs += [{"first": j, "last": j + n} for _, j, n in patience(a, b) if w[j + n] - w[j] >= min_words]
                    if runs:
                        out.append({"doc_id": ids[r], "text_key": keys[r], "owner": owner[r], "runs": runs})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=OUT)

    return rows.repartition(width(pairs.sparkSession), "owner", "salt").sortWithinPartitions("owner", "salt", "role", "doc_id").mapInArrow(tidy(run), "doc_id long, text_key long, owner long, runs array<struct<first:int,last:int>>")


OUT = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("owner", pa.int64()), ("runs", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])


def own_key(now, owner: int, salt: int, own: list, lines: list[int]):
    """The texts under one id are all owners."""
    return ((owner, salt), [*own, lines]) if now == (owner, salt) else ((owner, salt), [lines])


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with three columns more: n_lines, n_removed (lines deleted), partner_ids (the owners they align with).

    The text loses the lines of aligned runs of at least min_words words; lines split at newlines only, and equal lines
    are equal in bytes, short ones too. Earlier means a smaller doc_id; rows under one id are not compared with each other, and each
    repeated row loses the same lines. A text may end up empty. A null text stays null, with no lines; a row with a null
    id stays as it is. An empty table gives no rows. All other columns pass through; of columns in docs that are named
    like the new ones, the new ones replace them.
    """
    keyed = F.xxhash64(F.col(text))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "partner_ids")]
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pairs = cut(partners(rows, min_words))
    ids = pairs.select("doc_id").union(pairs.select("owner")).distinct()
    texts = maybe_in(rows, "doc_id", id_bitmap(ids, "doc_id")).join(ids, "doc_id").distinct().withColumn("text_key", F.xxhash64("text"))
    found = aligned(pairs, texts, min_words).groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.collect_set("owner")).alias("partner_ids"))
    found = cut(found).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("runs").alias("__runs"), F.col("partner_ids").alias("__partners"))
    lines = F.split(F.col(text), "\n", -1)
    n_lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    bitmap = id_bitmap(found, "__id")
    base = docs.select(*names).withColumn("__row_id", F.coalesce(F.col(doc_id).cast("long"), F.lit(0)))
    touched = maybe_in(base, "__row_id", bitmap)
    rest = maybe_in(base, "__row_id", bitmap, inside=False)
    kept = F.filter(lines, lambda _, i: ~F.exists("__runs", lambda r: (i >= r["first"]) & (i < r["last"])))
    hit = F.col("__runs").isNotNull()
    joined = touched.withColumn("__row_key", keyed).join(found, (F.col(doc_id).cast("long") == F.col("__id")) & (F.col("__row_key") == F.col("__key")), "left")
    new_text = F.when(hit, F.array_join(kept, "\n")).otherwise(F.col(text))
    removed = F.when(hit, F.size(lines) - F.size(kept)).otherwise(F.lit(0)).cast("long")
    none = F.array().cast("array<long>")
    done = joined.select(*[new_text.alias(text) if c == text else F.col(c) for c in names], n_lines.alias("n_lines"), removed.alias("n_removed"), F.coalesce("__partners", none).alias("partner_ids"))
    same = rest.select(*names, n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), none.alias("partner_ids"))
    return done.unionByName(same)
