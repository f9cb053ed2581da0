"""Runs of equal keys inside Arrow batches of sorted partitions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa


def run_starts(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Row numbers at which a new key begins; the first row always does."""
    begins = np.zeros(batch.num_rows, dtype=bool)
    begins[0] = True
    for name in keys:
        codes = batch.column(name).dictionary_encode().indices.fill_null(-1)
        codes = codes.to_numpy(zero_copy_only=False)
        begins[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(begins)


def key_at(batch: pa.RecordBatch, keys: Sequence[str], row: int) -> tuple:
    return tuple(batch.column(name)[row].as_py() for name in keys)
