"""Centroid clustering: plain Lloyd on integers.

The centroids, a parameter's worth of rows, are broadcast; each task takes batches of vectors, works out the integer squared
difference to every centroid, takes the least (the lower number at a tie), and adds up its vectors by centroid. Only these
sums are shuffled, so a round is one pass without a row of data moving, and a cluster that holds most vectors costs no more
than any other. All arithmetic is exact: where components are too large for 64 bits, Python's integers take over.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .integers import MOST, SUMS, capped_sum, finite, floors, longs, means, sum_rows
from .support import read, written

COMPONENTS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every point the number of its nearest centroid and their squared distance; ties go to the lower number."""
    if points.dtype == object or centroids.dtype == object:
        points, centroids = points.astype(object), centroids.astype(object)
    squares = np.stack([((points - c) ** 2).sum(axis=1) for c in centroids])
    at = squares.argmin(axis=0)
    return at, squares[at, np.arange(len(points))]


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest lowercase-hex sha256 of "seed:id", in this order; null ids come last, equal ids by vector."""
    order = rows.select("vector", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h")).orderBy(F.col("h").asc_nulls_last(), "vector")
    return np.array([r["vector"] for r in order.limit(k).collect()], np.float64)


def clustered(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """Rows (id, cluster, distance) of every usable vector, and the final centroids (k, components).

    Usable are vectors of exactly so many components, none null or non-finite; components become floor(scale * x). Repeated
    rows and repeated or null ids all take part, each row by itself. Fewer vectors than k give as many centroids; no vector
    gives no rows. A squared distance beyond a long is given as the largest long (the assignment is still exact).
    """
    spark = vectors.sparkSession
    kept = finite(vectors.select(F.col(id).alias("id"), F.col(vector).alias("vector")), "vector").where(F.size("vector") == components)
    rows = written(kept, "vectors")
    most = math.isqrt(2**60 // components)
    begin = starts(rows, k, seed).reshape(-1, components)
    centroids = floors(begin, scale, most)

    def points(pdf: pd.DataFrame) -> np.ndarray:
        return floors(np.stack(pdf["vector"].to_numpy()), scale, most)

    def add_up(sent):
        def kernel(batches):
            now = sent.value
            counts, sums = np.zeros(len(now), np.int64), np.zeros((len(now), components), object)
            for pdf in batches:
                if len(pdf):
                    x = points(pdf)
                    at, _ = nearest(x, now)
                    for c in np.unique(at):
                        counts[c] += (at == c).sum()
                        sums[c] += x[at == c].sum(axis=0).astype(object)
            for batch in sum_rows(counts, sums):
                yield batch.to_pandas()

        return kernel

    for _ in range(rounds if len(centroids) else 0):
        sent = spark.sparkContext.broadcast(centroids)
        centroids = means(rows.select("vector").mapInPandas(add_up(sent), SUMS), centroids, most)
        sent.destroy()
    last = spark.sparkContext.broadcast(centroids)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                at, square = nearest(points(pdf), last.value)
                yield pd.DataFrame({"id": pdf["id"].to_numpy(), "cluster": at.astype(np.int32), "distance": longs(square)})

    kind = rows.schema["id"].dataType.simpleString()
    return written(rows.mapInPandas(assign, f"id {kind}, cluster int, distance long"), "clustered"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia, inertia and centroid_sha256: one row for each centroid comes to the driver and goes back by broadcast."""
    spark = assigned.sparkSession
    own = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(capped_sum("distance").alias("s")).collect()}
    total = min(sum(own.values()), MOST)
    digest = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, own[c], total, digest[c]) for c in sorted(own)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = clustered(read(spark, sf_dir, "embeddings"))
    return with_inertia(assigned, centroids).select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(components: int = COMPONENTS, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same rows from the rule: a round is two common table expressions."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT rid, j, d FROM (SELECT rid, j, d, row_number() OVER (PARTITION BY rid ORDER BY d, j) AS o FROM "
            f"(SELECT rid, j, sum((points.x - c.x) * (points.x - c.x)) AS d FROM points JOIN c{r} AS c USING (p) GROUP BY rid, j)) WHERE o = 1)"
        )
        if r < rounds:
            steps.append(
                f"c{r + 1} AS MATERIALIZED (SELECT c.j, c.p, CASE WHEN n IS NULL THEN c.x ELSE CAST((s - ((s % n + n) % n)) / n AS BIGINT) END AS x FROM c{r} AS c LEFT JOIN "
                f"(SELECT j, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM points JOIN a{r} USING (rid) GROUP BY j, p) USING (j, p))"
            )
    return f"""
WITH numbered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, embedding FROM embeddings),
spread AS MATERIALIZED (SELECT rid, vec_id, unnest(range(1, len(embedding) + 1)) AS p, unnest(embedding) AS x FROM numbered WHERE len(embedding) = {components}),
kept AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id FROM spread GROUP BY rid HAVING bool_and(x IS NOT NULL AND isfinite(x))),
points AS MATERIALIZED (SELECT rid, p, CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM spread SEMI JOIN kept USING (rid)),
chosen AS (SELECT rid, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, rid) - 1 AS j FROM kept),
c0 AS MATERIALIZED (SELECT j, p, x FROM chosen JOIN points USING (rid) WHERE j < {k}),
{", ".join(steps)},
own AS (SELECT j, sum(d) AS s FROM a{rounds} GROUP BY j),
digest AS (SELECT j, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p)) AS h FROM c{rounds} GROUP BY j)
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(s AS BIGINT) AS cluster_inertia, CAST((SELECT sum(d) FROM a{rounds}) AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN own USING (j) JOIN digest USING (j)
"""
