"""Rounds that double the reads of samples that still change, and leave the others alone."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .closure import canonical_circle
from .graphs import written
from .pair_edges import paired_contigs

#: Names of active samples that a filter lists, so that the scan leaves the folders of the others out; more are joined.
LISTED = 1_000


def stored_by_sample(reads: DataFrame) -> DataFrame:
    """reads (sample, ord, ...) as a table with a folder for each sample under spark.checkpoint.dir, ordered by ord within: a round opens only what it needs."""
    folder = reads.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{folder}/strandframe/reads-{uuid.uuid4().hex}"
    schema = reads.schema
    reads.repartition("sample").sortWithinPartitions("sample", "ord").write.partitionBy("sample").parquet(path)
    return reads.sparkSession.read.schema(schema).parquet(path).select(*schema.names)


def first_reads(stored: DataFrame, active: DataFrame, n_active: int, limit: int) -> DataFrame:
    """The first limit reads of each active sample (sample)."""
    some = stored.where(F.col("ord") < limit)
    if n_active <= LISTED:
        return some.where(F.col("sample").isin([r["sample"] for r in active.collect()]))
    return some.join(active, "sample", "left_semi")


def adaptive(stored: DataFrame, observe: Callable[[DataFrame], DataFrame], initial: int, maximum: int) -> tuple[DataFrame, DataFrame]:
    """Results (sample, status, digest, seq, rounds, reads, settled) and the history (round, reads, sample, status, digest) of stored (sample, ord, ...).

    A round takes the first so many reads of every active sample, twice as many as the round before, and observe gives its
    (sample, status, seq). A sample that is seen as the round before saw it settles with that round's result and is not read
    again. The rounds end when none is active or maximum reads were taken; those still changing then are given as last seen.
    A sample of which observe says nothing has status missing. Each round's result is a table, so a lost executor costs one
    round at most; with maximum below initial nothing is read.
    """
    active = written(stored.select("sample").distinct())
    kind = stored.schema["sample"].dataType.simpleString()
    empty = stored.sparkSession.createDataFrame([], f"sample {kind}, status string, digest string, seq string, round int, reads long, settled boolean")
    results, history, before, limit, number = empty, empty, None, initial, 0
    while limit <= maximum and (n := active.count()):
        got = active.join(observe(first_reads(stored, active, n, limit)), "sample", "left")
        seen = written(got.select("sample", F.coalesce("status", F.lit("missing")).alias("status"), F.sha2(F.coalesce("seq", F.lit("")), 256).alias("digest"), "seq", F.lit(number).alias("round"), F.lit(limit).cast("long").alias("reads")))
        same = F.lit(False) if before is None else F.col("_status").eqNullSafe(F.col("status")) & F.col("_digest").eqNullSafe(F.col("digest"))
        with_last = seen if before is None else seen.join(before.select("sample", F.col("status").alias("_status"), F.col("digest").alias("_digest")), "sample", "left")
        now = written(with_last.withColumn("settled", same).select(*empty.columns))
        history = history.unionByName(now)
        limit_next = min(2 * limit, maximum) if limit < maximum else maximum + 1
        results = results.unionByName(now if limit_next > maximum else now.where("settled"))
        active = written(now.where("NOT settled").select("sample"))
        before, limit, number = now, limit_next, number + 1
    out = results.selectExpr("sample", "status", "digest", "seq", "round + 1 AS rounds", "reads", "settled")
    return out, history.select("round", "reads", "sample", "status", "digest")


def lap(seq: str, least: int) -> str | None:
    """The circle that a sequence goes round, once and at least so many bases more, or several times: its least period; else null."""
    border = [0] * len(seq)
    for i in range(1, len(seq)):
        n = border[i - 1]
        while n and seq[i] != seq[n]:
            n = border[n - 1]
        border[i] = n + (seq[i] == seq[n])
    return seq[: len(seq) - border[-1]] if seq and border[-1] >= least else None


def observed_circles(reference: DataFrame, k: int, **options) -> Callable[[DataFrame], DataFrame]:
    """An observe() of pairs (sample, fragment, seq1, seq2): the contig led by a reference (locus, pos, kmer), closed where it goes round.

    status is circular or linear; a circle is given by its canonical turn, so that it compares with other rounds' circles.
    """

    def judge(batches):
        for pdf in batches:
            rows = []
            for sample, seq in zip(pdf["locus"], pdf["seq"], strict=True):
                circle = lap(seq, k - 1)
                rows.append((sample, "circular" if circle else "linear", canonical_circle(circle) if circle else min(seq, seq.translate(str.maketrans("ACGT", "TGCA"))[::-1])))
            yield pd.DataFrame(rows, columns=["sample", "status", "seq"], dtype=object)

    def observe(reads: DataFrame) -> DataFrame:
        kind = reads.schema["sample"].dataType.simpleString()
        pairs = reads.select(F.col("sample").alias("locus"), "fragment", "seq1", "seq2")
        return paired_contigs(pairs, reference, k, **options).select("locus", "seq").mapInPandas(judge, f"sample {kind}, status string, seq string")

    return observe
