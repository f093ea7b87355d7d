"""Packed exchanges between blocks of documents and owners of keys.

Blocks ask about their distinct keys; each owner of a part of the key space sees every block's request once, as one
packed row, and answers in the order asked, so keys that are frequent everywhere cost one entry per block.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack(a: np.ndarray, level: int = 1) -> bytes:
    return zlib.compress(np.ascontiguousarray(a).tobytes(), level)


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype)


def dealt(rows: DataFrame, column: str, parts: int) -> DataFrame:
    """Rows by the number of their block or receiver (0 to parts - 1), a task for each.

    By number and not by a hash of it, or some tasks would get several; and not merged by size, as packed rows are short.
    """
    return rows.repartitionById(parts, F.col(column))


def n_blocks(docs: DataFrame, size: Column, block_bytes: int) -> int:
    """Blocks of about block_bytes, at least one: one pass over the column's lengths."""
    return int((docs.agg(F.sum(size)).first()[0] or 0) // block_bytes) + 1


def ordered(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys by (part, key), where each part of them starts (parts + 1 offsets), and each input's place."""
    distinct, at = np.unique(keys, return_inverse=True)
    part = owner(distinct, parts)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], np.searchsorted(part[order], np.arange(parts + 1)), place[at]


def owner(keys: np.ndarray, parts: int) -> np.ndarray:
    h = keys * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
