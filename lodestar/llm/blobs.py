"""Columnar shuffle: numpy runs travel as a few binary values for each (map flush, part), not as a row for each element."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SCHEMA = "part int, blob binary"


def batches(parts: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])


def runs(part: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by part and the bounds of each part in it."""
    order = np.argsort(part.astype(np.uint16) if n_parts <= 65535 else part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(n_parts + 1))


def by_part(source):
    """(part, [blob, ...]) of a partition that is sorted by part; holds one part at a time."""
    now, held = None, []
    for batch in source:
        for p, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if p != now:
                if held:
                    yield now, held
                now, held = p, []
            held.append(b.as_buffer())
    if held:
        yield now, held
