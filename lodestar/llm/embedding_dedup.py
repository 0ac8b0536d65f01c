"""Near-duplicate embeddings by cross-polytope hashing.

Vectors are normalised and turned by three rounds of random signs and a fast Hadamard transform; the hash of a turn is
the axis, with its sign, that lies closest. A table joins the hashes of `turns` independent turns. Every vector stands
in its own bucket of each table; it also probes the buckets that its next-best axes give, in the order of what they
lose. Vectors that meet are compared in their bucket, in double precision, by blocks. A pair may meet in several buckets
and counts in the least of them, which both vectors' codes tell, so no pairs leave a bucket: only how many links each vector
has there, and a forest of what they connect.
Equal vectors of a label are one vertex with a count. A bucket too large for one task is dealt into blocks, and every
pair of its blocks is a task of its own, so that nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import U, mix
from .ngram_join import joined
from .runtime import cut, tidy, width

COSINE = 0.98
TABLES = 8
PROBES = 3
SEED = 20_011
#: vectors of a bucket that meet in one task
BLOCK = 4096
#: expected vectors of a label in a bucket, which sets the number of turns a table joins
LOAD = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows of x, their length a power of two, transformed and scaled to keep their norm."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def turned(x: np.ndarray, table: int, turn: int, seed: int = SEED) -> np.ndarray:
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    rng = np.random.default_rng([seed, table, turn])
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], d))
    return y


def hashes(x: np.ndarray, table: int, turns: int, probes: int) -> np.ndarray:
    """Bucket of each row in a table, then those of its probes, best first: axes changed one at a time."""
    best, options, losses = [], [], []
    for t in range(turns):
        y = turned(x, table, t)
        size = np.abs(y)
        take = min(probes + 1, y.shape[1])
        top = np.argpartition(-size, take - 1, axis=1)[:, :take]
        order = np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable")
        top = np.take_along_axis(top, order, 1)
        value = np.take_along_axis(y, top, 1)
        code = (2 * top + (value < 0)).astype(U)
        best.append(code[:, 0])
        options.append(code[:, 1:])
        losses.append(np.abs(value[:, :1]) - np.abs(value[:, 1:]))
    salt = [mix(np.array([table * 1009 + t * 2 + 1], U))[0] for t in range(turns)]
    with np.errstate(over="ignore"):
        terms = [mix(best[t] + salt[t]) for t in range(turns)]
        total = np.sum(terms, axis=0, dtype=U)
        other = np.concatenate([total[:, None] - terms[t][:, None] + mix(options[t] + salt[t]) for t in range(turns)], axis=1)
    loss = np.concatenate(losses, axis=1)
    order = np.argsort(loss, axis=1, kind="stable")[:, :probes]
    return np.concatenate([total[:, None], np.take_along_axis(other, order, 1)], axis=1)


def matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def vertices(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, embedding, count of equal ones): the smallest id of each distinct usable vector and label."""
    e = F.col(embedding)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    rows = vectors.where(F.col(label).isNotNull() & e.isNotNull() & F.coalesce(fine, F.lit(False)) & F.col(vec_id).isNotNull())
    e = F.transform(e.cast("array<double>"), lambda x: x + F.lit(0.0))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), e.alias("embedding")).groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))


def tallies(vertex: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, load: int = LOAD, block: int = BLOCK) -> DataFrame:
    """(a, b, n): from each bucket how many vectors a vertex links with, counting copies, in rows without b; and links
    (a, b) that connect what the bucket's links connect, in rows without n. Links are of one label and length."""
    spark = vertex.sparkSession
    most = vertex.groupBy("label", F.size("embedding").alias("d")).count().agg(F.max("count"), F.max("d")).first()
    if not most[0]:
        return spark.createDataFrame([], "a long, b long, n long")
    axes = 2 * (1 << max(1, (int(most[1]) - 1).bit_length()))
    turns = max(1, round(np.log(max(1.0, most[0] / load)) / np.log(axes)))

    def code(source) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sizes = np.asarray(batch.column(2).value_lengths())
            for d in np.unique(sizes):
                some = np.flatnonzero(sizes == d)
                for lo in range(0, len(some), 2048):
                    rows = batch.take(pa.array(some[lo : lo + 2048]))
                    x = matrix(rows.column(2))
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                    with np.errstate(over="ignore"):
                        keys = np.stack([mix(hashes(x, t, turns, probes) + U(t) * U(0x9E3779B97F4A7C15) + U(int(d))) for t in range(tables)], axis=1)
                    codes = pa.array([k.tobytes() for k in keys], pa.binary())
                    buckets = pa.array([sorted({(int(key), bool(p)) for table in k.view(np.int64) for p, key in enumerate(table)}) for k in keys], pa.list_(pa.struct([("bucket", pa.int64()), ("probe", pa.bool_())])))
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), rows.column(3), codes, buckets], names=["vec_id", "label", "embedding", "copies", "codes", "buckets"])

    kind = dict(vertex.dtypes)["label"]
    coded = vertex.select("vec_id", "label", "embedding", "copies").mapInArrow(tidy(code), f"vec_id long, label {kind}, embedding array<double>, copies long, codes binary, buckets array<struct<bucket:long,probe:boolean>>")
    coded = cut(coded)
    placed = coded.select("label", "vec_id", F.explode("buckets").alias("x")).select("label", "vec_id", "x.bucket", "x.probe")
    # a bucket matters if a vector lives there and another one lives there or probes it
    use = placed.groupBy("label", "bucket").agg(F.count_if(~F.col("probe")).alias("homes"), F.count("*").alias("n")).where("homes > 0 and n > 1")
    split = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int")
    rows = placed.join(use.select("label", "bucket", split.alias("g")), ["label", "bucket"])
    # block i meets every block j: a row goes to the g tasks of its block's pairs
    mine = F.pmod(F.xxhash64("vec_id"), F.col("g")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.select("label", "bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "probe", "vec_id")
    rows = rows.join(coded.select("vec_id", "embedding", "copies", "codes"), "vec_id").select("label", "bucket", "i", "j", "mine", "probe", "vec_id", "embedding", "copies", "codes")

    def here(bucket: int, codes: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which pairs have no lesser bucket in which they meet: one that is home to one and home or probed of the other."""
        least = np.full(len(p), np.iinfo(np.uint64).max, U)
        for t in range(tables):
            a, b = codes[p, t], codes[q, t]
            for home, all_of in ((a[:, 0], b), (b[:, 0], a)):
                least = np.minimum(least, np.where((home[:, None] == all_of).any(axis=1), home, least))
        return least == np.array([bucket], np.int64).view(U)[0]

    def meet(source) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            ids = np.array([h[2] for h in held], np.int64)
            home = np.array([not h[1] for h in held])
            mine, copies = np.array([h[0] for h in held]), np.array([h[4] for h in held], np.int64)
            codes = np.frombuffer(b"".join(h[5] for h in held), U).reshape(len(held), tables, -1)
            x = np.stack([h[3] for h in held])
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            i, j = now[2], now[3]
            left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
            n, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for lo in range(0, len(left), 256):
                a = left[lo : lo + 256]
                near = x[a] @ x[right].T >= cosine
                near &= home[a][:, None] | home[right][None, :]
                if i == j:
                    near &= ids[a][:, None] < ids[right][None, :]  # each pair once, and a row that stands here twice not with itself
                p, q = np.nonzero(near)
                for at in range(0, len(p), 65_536):
                    s, e = a[p[at : at + 65_536]], right[q[at : at + 65_536]]
                    once = here(now[1], codes, s, e)
                    s, e = s[once], e[once]
                    np.add.at(n, s, copies[e])
                    np.add.at(n, e, copies[s])
                    root = joined_more(root, s, e)
            some, away = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(root)))
            none = np.zeros(len(some), bool), np.zeros(len(away), bool)
            a = pa.array(np.concatenate([ids[some], ids[away]]))
            b = pa.array(np.concatenate([ids[some], ids[root[away]]]), mask=np.concatenate([~none[0], none[1]]))
            return pa.RecordBatch.from_arrays([a, b, pa.array(np.concatenate([n[some], np.zeros(len(away), np.int64)]), mask=np.concatenate([none[0], ~none[1]]))], names=["a", "b", "n"])

        for batch in source:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
            mine, probe, ids, copies, codes = (batch.column(c).to_pylist() for c in (4, 5, 6, 8, 9))
            flat, off = np.asarray(batch.column(7).flatten()), np.asarray(batch.column(7).offsets)
            off = off - off[0]
            for r, key in enumerate(keys):
                if key != now:
                    if len(held) > 1:
                        yield done()
                    now, held = key, []
                held.append((mine[r], probe[r], ids[r], flat[off[r] : off[r + 1]].copy(), copies[r], codes[r]))
        if len(held) > 1:
            yield done()

    return rows.repartition(width(spark), "label", "bucket", "i", "j").sortWithinPartitions("label", "bucket", "i", "j").mapInArrow(tidy(meet), "a long, b long, n long")


def joined_more(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected with, after some more links."""
    n = np.arange(len(root))
    return joined(len(root), np.concatenate([n, i]), np.concatenate([root, j])) if len(i) else root


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors.

    Links join vectors of equal, non-null labels and of one length with cosine at or over the threshold; equal vectors
    of a label link. Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null id
    or label, have no links and are their own component. A repeated row counts as another vector. component_id is the
    smallest vec_id reachable. An empty table gives no rows; other columns are not read.
    """
    vertex = cut(vertices(vectors, vec_id, embedding, label))
    found = cut(tallies(vertex, cosine, tables, probes))
    degree = found.where("b is null").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("far"))
    roots = connected_components(found.where("b is not null")).toDF("vec_id", "root")
    found = vertex.join(degree, "vec_id", "left").join(roots, "vec_id", "left").select(
        "label", "embedding", (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id")
    )
    e = F.transform(F.col(embedding).cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), e.alias("embedding"))
    # an equal vector finds its vertex by label and components; a null id never made one
    joined = rows.join(found, ["label", "embedding"], "left")
    n = F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long")
    root = F.when(F.col("vec_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "vec_id"))
    return joined.select("vec_id", n.alias("n_links"), root.alias("component_id"), (F.col("vec_id") == root).alias("kept"))
