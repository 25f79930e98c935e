"""What the integer clusterings share: finite vectors, exact floors, and sums of any size that meet through groupBy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest long; figures beyond it are given as this.
MOST = 2**63 - 1
#: Partial sums: key, which 62 bits of the sums, how many rows, the sums of those bits.
SUMS = "key int, limb int, n long, sums array<long>"


def finite(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null and holds neither a null nor a non-finite component; its components as float or double."""
    kind = vectors.schema[vector].dataType.simpleString()
    v = F.col(vector) if kind == "array<float>" else F.col(vector).cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.withColumn(vector, v).where(F.col(vector).isNotNull()).where(good)


def floors(x: np.ndarray, scale: int, most: int) -> np.ndarray:
    """floor(scale * x), exactly, for a scale that is a power of two: int64, or Python's integers where one is beyond most."""
    x = x.astype(np.float64)
    with np.errstate(over="ignore"):
        whole = np.floor(x * scale)
    if np.abs(whole).max(initial=0) <= most:
        return whole.astype(np.int64)
    exact = [int(v) * scale if abs(v) >= 2**52 else math.floor(v * scale) for v in x.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(x.shape)


def longs(values: np.ndarray) -> np.ndarray:
    """values as int64, those beyond it as the largest long."""
    return values if values.dtype == np.int64 else np.array([min(int(v), MOST) for v in values], np.int64)


def sum_rows(counts: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of SUMS for the keys that have a count: sums is (keys, components) of integers of any size."""
    key, limb, n, parts = [], [], [], []
    for k in np.flatnonzero(counts):
        rest, at = [int(v) for v in sums[k]], 0
        while at == 0 or any(rest):
            last = all(-(2**62) <= v < 2**62 for v in rest)
            key.append(int(k))
            limb.append(at)
            n.append(0 if at else int(counts[k]))
            parts.append(rest if last else [v & (2**62 - 1) for v in rest])
            rest, at = [0] * len(rest) if last else [v >> 62 for v in rest], at + 1
    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(limb, pa.int32()), pa.array(n, pa.int64()), pa.array(parts, pa.list_(pa.int64()))], names=["key", "limb", "n", "sums"])


def means(partial: DataFrame, before: np.ndarray, most: int) -> np.ndarray:
    """before, (keys, components), with each key's row replaced by floor(sum / count) of the partial sums; keys without rows stay.

    Only keys times components numbers reach the driver. Sums are added as decimals, so no count of tasks overflows them.
    """
    each = partial.select("key", "limb", "n", F.posexplode("sums").alias("at", "v"))
    rows = each.groupBy("key", "limb", "at").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v"), F.sum("n").alias("n")).collect()
    count: dict[int, int] = {}
    total: dict[tuple[int, int], int] = {}
    for r in rows:
        total[r["key"], r["at"]] = total.get((r["key"], r["at"]), 0) + (int(r["v"]) << (62 * r["limb"]))
        if r["limb"] == 0:
            count[r["key"]] = r["n"]
    after = before.astype(object)
    for (key, at), v in total.items():
        after[key, at] = v // count[key]
    return narrow(after, most)


def narrow(values: np.ndarray, most: int) -> np.ndarray:
    """Python's integers as int64 where none is beyond most, else as they are."""
    return values.astype(np.int64) if all(abs(v) <= most for v in values.ravel().tolist()) else values.astype(object)


def capped_sum(column: str) -> Column:
    """The sum of longs as a long, the largest one where it is beyond."""
    return F.least(F.sum(F.col(column).cast("decimal(20,0)")), F.lit(MOST).cast("decimal(30,0)")).cast("long")
