"""Bloom filters over 64-bit hashes: a fixed number of bits, whatever the number of hashes, so one is safe to broadcast.

They only spare a shuffle what surely has no partner; an exact join follows and drops what they let through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter of very many hashes, such as all endings; filters of words and the like take fewer.
BITS = 1 << 25
_PAGE = 4096
#: Tasks that fill a filter at most, so that what is put together doesn't grow with the input's partitions.
BUILDERS = 256


def mixed(*parts: np.ndarray) -> np.ndarray:
    """One hash of several columns of unsigned hashes."""
    h = np.full(len(parts[0]), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h = h * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


def text_hashes(texts: list[str]) -> np.ndarray:
    """A hash of each text, the same in every process; each distinct text is hashed once."""
    codes, distinct = pd.factorize(np.array(texts, dtype=object))
    return pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False)[codes] if len(texts) else np.zeros(0, np.uint64)


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    g, mask = hashes.view(np.uint64), np.uint64(bits - 1)
    return [g & mask, (g >> np.uint64(20)) & mask, (g >> np.uint64(38)) & mask]


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be among those of the filter."""
    keep = np.ones(len(hashes), bool)
    for at in _places(hashes, len(bits) * 8):
        keep &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return keep


def build(df: DataFrame, *columns: str, size: int = BITS) -> np.ndarray:
    """The filter of all hashes in the named columns: made in every partition, put together page by page."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(size // 8, dtype=np.uint8)
        for pdf in batches:
            for c in columns:
                for at in _places(pdf[c].to_numpy(), size):
                    np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        used = np.flatnonzero(bits.reshape(-1, _PAGE).any(axis=1))
        yield pd.DataFrame({"page": used, "bits": [b.tobytes() for b in bits.reshape(-1, _PAGE)[used]]})

    def both(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"page": pdf["page"].iloc[:1], "bits": [np.bitwise_or.reduce([np.frombuffer(b, dtype=np.uint8) for b in pdf["bits"]]).tobytes()]})

    own = df.select(*(F.col(c) for c in columns)).dropna().coalesce(BUILDERS)
    pages = own.mapInPandas(fill, "page long, bits binary").groupBy("page").applyInPandas(both, "page long, bits binary")
    out = np.zeros((size // 8 // _PAGE, _PAGE), dtype=np.uint8)
    for r in pages.collect():  # size / 8 bytes at most
        out[r["page"]] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out.ravel()
