"""Pairwise alignment kernels and what is counted from their results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import written
from .tables import merged_intervals


def local_score(a: str, b: str, match: int = 2, mismatch: int = -3, gap: int = -4) -> int:
    """The best local alignment's score with a linear gap cost, by anti-diagonals."""
    if not a or not b:
        return 0
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)[::-1]
    n, m = len(x), len(y)
    one, two, best = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), 0
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        i = np.arange(lo, hi + 1)
        same = np.where(x[i - 1] == y[m - (d - i)], match, mismatch)
        new = np.zeros(n + 1, np.int64)
        new[lo : hi + 1] = np.maximum(0, np.maximum(two[lo - 1 : hi] + same, np.maximum(one[lo - 1 : hi], one[lo : hi + 1]) + gap))
        best = max(best, int(new.max()))
        two, one = one, new
    return best


def local_alignment(a: str, b: str, match: int = 2, mismatch: int = -3, gap: int = -4) -> tuple[int, int, int, int, int, int]:
    """Score, the spans [start, end) in both, and the number of equal places of the best local alignment."""
    h = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), h[i - 1, j] + gap, h[i, j - 1] + gap)
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    end, same, score = (int(i), int(j)), 0, int(h.max())
    while h[i, j] > 0:
        if h[i, j] == h[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            same += a[i - 1] == b[j - 1]
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + gap:
            i -= 1
        else:
            j -= 1
    return score, int(i), end[0], int(j), end[1], int(same)


def banded_affine_score(a: str, b: str, diagonal: int = 0, band: int = 8, match: int = 2, mismatch: int = -3, open_: int = -5, extend: int = -1) -> int:
    """The best local score with affine gaps within a band around a diagonal (place in a less place in b)."""
    low = -(10**9)
    h_before: dict[int, int] = {}
    f_before: dict[int, int] = {}
    best = 0
    for i in range(1, len(a) + 1):
        h, f, e, left = {}, {}, low, 0
        for j in range(max(1, i - diagonal - band), min(len(b), i - diagonal + band) + 1):
            e = max(left + open_, e) + extend
            f[j] = max(h_before.get(j, 0) + open_, f_before.get(j, low)) + extend
            h[j] = left = max(0, h_before.get(j - 1, 0) + (match if a[i - 1] == b[j - 1] else mismatch), e, f[j])
            best = max(best, h[j])
        h_before, f_before = h, f
    return best


KERNELS = {"local": local_score, "banded": banded_affine_score, "family": lambda a, b: local_score(a, b, 2, -2, -3)}


def scored_pairs(pairs: DataFrame, kernel: str = "local") -> DataFrame:
    """pairs (a_seq, b_seq, ...) with score, batch by batch."""
    fn = KERNELS[kernel]

    def run(batches):
        for pdf in batches:
            yield pdf.assign(score=[fn(a, b) for a, b in zip(pdf["a_seq"], pdf["b_seq"], strict=True)])

    return pairs.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields) + ", score long")


def scored_on_diagonals(pairs: DataFrame) -> DataFrame:
    """Pairs (a_seq, b_seq, diagonal, ...) with the banded score around each pair's own diagonal, a place in a less one in b."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(score=[banded_affine_score(a, b, d) for a, b, d in zip(pdf["a_seq"], pdf["b_seq"], pdf["diagonal"], strict=True)])

    return pairs.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields) + ", score long")


def best_offsets(seeds: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Of seeds (keys, offset) the n most frequent offsets of each key, ties to the smallest."""
    counted = seeds.groupBy(*keys, "offset").agg(F.count("*").alias("seeds"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seeds"), "offset"))).where(F.col("rank") <= n)


def merged_hsps(hsps: DataFrame) -> DataFrame:
    """The spans of a query's hits on a subject, turned forward, merged, with the longest and the outermost ends."""
    turned = hsps.select("query", "subject", F.least("qstart", "qend").alias("start"), (F.greatest("qstart", "qend") + 1).alias("end"))
    one = merged_intervals(turned, ["query", "subject"])
    return one.groupBy("query", "subject").agg(F.count("*").alias("spans"), F.sum(F.col("end") - F.col("start")).alias("covered"), F.max(F.col("end") - F.col("start")).alias("longest"), F.min("start").alias("first"), F.max("end").alias("last"))


#: Members of equivalence classes, all told, that one task works through; more are worked out by grouped sums.
CLASS_MEMBERS = 2_000_000


def abundance(classes: DataFrame, rounds: int = 64, most: int = CLASS_MEMBERS) -> DataFrame:
    """Rows (target, share) by expectation and maximisation over equivalence classes (targets array, n), from equal shares.

    Where the classes have few members in all, which is counted first, one task goes through all rounds; else every round
    is two grouped sums, written at every eighth.
    """
    classes = classes.where("size(targets) > 0 AND n > 0").select(F.array_distinct("targets").alias("targets"), F.col("n").cast("double").alias("n"))
    members, total = classes.agg(F.sum(F.size("targets")), F.sum("n")).first()
    kind = classes.schema["targets"].dataType.elementType
    schema = f"target {kind.simpleString()}, share double"
    if not members:
        return classes.sparkSession.createDataFrame([], schema)
    if members <= most:

        def run(batches):
            held = pd.concat(list(batches))
            place = np.repeat(np.arange(len(held)), held["targets"].map(len))
            names, of = np.unique(np.concatenate(held["targets"].to_list()), return_inverse=True)
            n, share = held["n"].to_numpy(), np.full(len(names), 1 / len(names))
            for _ in range(rounds):
                z = np.bincount(place, share[of], len(held))
                part = np.where(z[place] > 0, n[place] * share[of] / np.where(z > 0, z, 1)[place], 0)
                share = np.bincount(of, part, len(names)) / total
            yield pd.DataFrame({"target": names, "share": share})

        return classes.coalesce(1).mapInPandas(run, schema)
    rows = written(classes.withColumn("c", F.monotonically_increasing_id()).select("c", "n", F.explode("targets").alias("target")))
    share = rows.select("target").distinct()
    share = share.withColumn("share", F.lit(1.0 / share.count()))
    for r in range(rounds):
        held = rows.join(share, "target")
        z = held.groupBy("c").agg(F.sum("share").alias("z"))
        share = held.join(z, "c").groupBy("target").agg(F.sum(F.expr("CASE WHEN z > 0 THEN n * share / z ELSE 0D END")).alias("s")).select("target", (F.col("s") / total).alias("share"))
        if r % 8 == 7:
            share = written(share)
    return share


def bootstrap_interval(rows: DataFrame, keys: list[str], hits: str, total: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    """Mean and 95 % bounds of a share by a seeded normal bootstrap, the seed drawn from each row's keys."""

    def run(batches):
        import zlib

        for pdf in batches:
            out = []
            for *k, h, t in pdf[[*keys, hits, total]].itertuples(index=False):
                rng = np.random.default_rng([seed, zlib.crc32(repr(k).encode())])
                p = h / t if t else 0.0
                draws = np.clip(rng.normal(p, np.sqrt(p * (1 - p) / t) if t else 0.0, replicates), 0, 1)
                out.append((p, *np.quantile(draws, [0.025, 0.975])))
            yield pdf.assign(**dict(zip(("share", "low", "high"), map(list, zip(*out, strict=True)), strict=True))) if out else pd.DataFrame()

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", share double, low double, high double")
