"""What the two vector operators share: which vectors count, and blocks of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: str) -> Column:
    """Whether a vector is not null, has only finite components and is not all zeros."""
    v = F.col(vec)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit_rows(vectors) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision."""
    x = vectors.astype(np.float64) if isinstance(vectors, np.ndarray) and vectors.ndim == 2 else np.array([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrices(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, vectors as rows) of each length in a column of vectors without nulls."""
    size = pc.list_value_length(col).to_numpy(zero_copy_only=False)
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        own = col if len(at) == len(size) else col.take(pa.array(at))
        yield d, at, own.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def sample(df: DataFrame, rows: int, total: int) -> dict[int, np.ndarray]:
    """At most ``rows`` of the ``total`` vectors of (id, vec), the first by a hash of the id, by dimension and as unit rows.

    Each task would send its first ``rows``, so a bound on the hash drops before that what has no chance.
    """
    got: dict[int, list] = {}
    share = 1.0 if total <= rows else (rows + 6 * rows**0.5 + 50) / total
    first = df.where(F.xxhash64("id") <= int(-(2.0**63) + share * 2.0**64)) if share < 1 else df
    for r in first.orderBy(F.xxhash64("id"), "id").limit(rows).collect():
        got.setdefault(len(r["vec"]), []).append(r["vec"])
    return {d: unit_rows(v) for d, v in got.items()}


def parts(df: DataFrame, raw: str, most: int) -> list[tuple[int, int]]:
    """First and last ``uid`` of each part of a table of (uid, raw) whose ``raw`` has at most ``most`` bytes together."""
    out: list[list[int]] = []
    for uid, size in sorted((r["uid"], r["size"]) for r in df.select("uid", F.length(raw).alias("size")).collect()):
        if out and out[-1][2] + size <= most:
            out[-1] = [out[-1][0], uid, out[-1][2] + size]
        else:
            out.append([uid, uid, size])
    return [(low, high) for low, high, _ in out]
