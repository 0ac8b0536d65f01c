"""Read only the rows that a distributed id table may name, without shuffling the others: a bounded bitmap of id hashes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U, mix
from .runtime import tidy, width

#: bits of the map, and so the bound of what is broadcast (8 MB); a map that fills up lets more rows through, none less
BITS = 1 << 26


def id_bitmap(ids: DataFrame, column: str, bits: int = BITS):
    """A broadcast bitmap of the hashed ids. Each task owns a range of it, so what reaches the driver is the map itself."""
    n = width(ids.sparkSession)
    piece = -(-bits // (8 * n)) * 8

    def place(source) -> Iterator[pa.RecordBatch]:
        for batch in source:
            at = (mix(np.asarray(batch.column(0)).astype(np.int64).view(U)) % U(bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at // piece).astype(np.int32)), pa.array(at % piece)], names=["part", "at"])

    def run(source) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for batch in source:
            part, at = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for p in np.unique(part).tolist():
                maps.setdefault(p, np.zeros(piece, bool))[at[part == p]] = True
        if maps:
            yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int32()), pa.array([zlib.compress(np.packbits(m).tobytes(), 1) for m in maps.values()], pa.binary())], names=["part", "bits"])

    rows = ids.where(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("id"))
    rows = rows.mapInArrow(tidy(place), "part int, at long").repartition(n, "part").mapInArrow(tidy(run), "part int, bits binary")
    whole = np.zeros(piece // 8 * n, np.uint8)
    for r in rows.collect():
        whole[r["part"] * (piece // 8) : (r["part"] + 1) * (piece // 8)] |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return ids.sparkSession.sparkContext.broadcast(whole)


def hits(column: pa.Array, whole: np.ndarray, bits: int = BITS, nulls: bool = False) -> np.ndarray:
    """Which ids of a column of longs are in the map, or share their hash with one that is; with nulls, null ids too."""
    p = (mix(np.asarray(column.fill_null(0)).astype(np.int64).view(U)) % U(bits)).astype(np.int64)
    hit = ((whole[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).astype(bool)
    if nulls and column.null_count:
        hit |= np.asarray(column.is_null())
    return hit


def maybe_in(rows: DataFrame, column: str, bitmap, bits: int = BITS, inside: bool = True, nulls: bool = False) -> DataFrame:
    """The rows whose id is in the map, and a few more whose hash coincides; or, not inside, all others. column holds longs.
    With nulls, rows of a null id count as in the map."""
    at = rows.columns.index(column)

    def run(source) -> Iterator[pa.RecordBatch]:
        whole = bitmap.value
        for batch in source:
            yield batch.filter(pa.array(hits(batch.column(at), whole, bits, nulls) == inside))

    return rows.mapInArrow(tidy(run), rows.schema)


def without_ids(rows: DataFrame, column: str, ids: DataFrame, id_column: str) -> DataFrame:
    """The rows whose id isn't in ids; only those that the bitmap can't tell are shuffled. Rows of a null id stay."""
    bitmap = id_bitmap(ids, id_column)
    keyed = rows.withColumn("__id", F.col(column).cast("long"))
    rest = maybe_in(keyed, "__id", bitmap, inside=False)
    near = maybe_in(keyed, "__id", bitmap).join(ids.select(F.col(id_column).cast("long").alias("__id")), "__id", "left_anti")
    return rest.unionByName(near).drop("__id")
