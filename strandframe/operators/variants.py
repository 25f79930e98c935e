"""Genotypes, pileups and consensus sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from .tables import spread_pairs


def masked_genotypes(genotypes: DataFrame, least_dp: int = 5, least_gq: int = 20) -> DataFrame:
    """Genotypes of low depth or quality, and those not called, become null."""
    good = (F.col("dp") >= least_dp) & (F.col("gq") >= least_gq) & F.expr(S.called("gt"))
    return genotypes.withColumn("gt", F.when(good, F.col("gt")))


def site_statistics(genotypes: DataFrame) -> DataFrame:
    """Call rate, median depth and quality of called genotypes, allele counts."""
    ones = F.expr("size(filter(split(gt, '[/|]'), a -> a = '1'))")
    alleles = F.expr("size(split(gt, '[/|]'))")
    return genotypes.groupBy("site").agg(
        F.round(F.count("gt") / F.count("*"), 6).alias("call_rate"), F.median(F.when(F.col("gt").isNotNull(), F.col("dp"))).alias("median_dp"), F.median(F.when(F.col("gt").isNotNull(), F.col("gq"))).alias("median_gq"),
        F.coalesce(F.sum(F.when(F.col("gt").isNotNull(), ones)), F.lit(0)).cast("long").alias("ac"), F.coalesce(F.sum(F.when(F.col("gt").isNotNull(), alleles)), F.lit(0)).cast("long").alias("an"), F.max("qual").alias("qual"),
    )


def passing_sites(sites: DataFrame, qual: float = 20, missing: float = 0.2, least_ac: int = 2) -> DataFrame:
    """P9."""
    return sites.where((F.col("qual") >= qual) & (1 - F.col("call_rate") <= missing) & (F.col("ac") >= least_ac) & (F.col("an") - F.col("ac") >= least_ac))


def one_per_locus(sites: DataFrame, locus: str) -> DataFrame:
    """Call rate, genotype quality, nearness to the locus's median depth, site quality, then the least position."""
    near = sites.withColumn("_m", F.expr(f"median(median_dp) OVER (PARTITION BY {locus})"))
    order = [F.desc("call_rate"), F.desc_nulls_last("median_gq"), F.asc_nulls_last(F.abs(F.col("median_dp") - F.col("_m"))), F.desc("qual"), F.asc("site")]
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(locus).orderBy(*order))).where("_r = 1").drop("_r", "_m")


def inserted_motifs(alignments: DataFrame) -> DataFrame:
    """Rows (ref, pos, motif) of the insertions of mapped, primary records; pos is the place that the motif stands before."""
    kept = alignments.where("(flag & 2308) = 0 AND cigar LIKE '%I%'").withColumn("ops", F.expr(S.cigar_operations("cigar")))
    at = "aggregate(slice(ops, 1, i), {0}, (s, o) -> s + CASE WHEN o.op IN ({1}) THEN o.n ELSE 0 END)"
    found = f"""transform(filter(transform(ops, (o, i) -> struct(o.op AS op, o.n AS n, i AS i)), o -> o.op = 'I'), x -> {S.let("x.i", "i", f"struct({at.format('pos', "'M', 'D', 'N', '=', 'X'")} AS pos, substring(seq, {at.format('1', "'M', 'I', 'S', '=', 'X'")}, x.n) AS motif)")})"""
    return kept.select("ref", F.explode(F.expr(found)).alias("x")).selectExpr("ref", "cast(x.pos AS int) AS pos", "x.motif AS motif")


def pileup(counts: DataFrame) -> DataFrame:
    """Counts by place, from rows (ref, pos, base, n)."""
    n = [F.coalesce(F.sum(F.when(F.col("base") == b, F.col("n"))), F.lit(0)).alias(name) for b, name in (("-", "gap"), ("A", "a"), ("C", "c"), ("G", "g"), ("N", "n"), ("T", "t"))]
    return counts.groupBy("ref", "pos").agg(*n, F.sum("n").alias("depth"))


def consensus_calls(counts: DataFrame, threshold: float, least_depth: int = 2) -> DataFrame:
    """From rows (ref, pos, base, n), bases in groups of equal counts, the most frequent first, until they reach the threshold's share; their IUPAC code, in lower case next to a gap; N below the least depth."""
    counts = counts.where("base IN ('A', 'C', 'G', 'T', '-')").withColumnRenamed("n", "count")
    w = Window.partitionBy("ref", "pos")
    taken = counts.withColumn("depth", F.sum("count").over(w)).withColumn("before", F.coalesce(F.sum("count").over(w.orderBy(F.desc("count")).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    taken = taken.where(F.col("before") < threshold * F.col("depth"))
    sets = taken.groupBy("ref", "pos").agg(F.max("depth").alias("depth"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("base") != "-", F.col("base")))), "").alias("bases"), F.max((F.col("base") == "-").cast("int")).alias("gap"))
    code = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in S.IUPAC_SETS.items()) + ")"
    call = F.expr(f"CASE WHEN depth < {least_depth} THEN 'N' WHEN bases = '' THEN '-' WHEN gap = 1 THEN lower({code}[bases]) ELSE {code}[bases] END")
    return sets.select("ref", "pos", "depth", call.alias("call"))


def insertion_columns(inserted: DataFrame) -> DataFrame:
    """Counts of inserted bases at each place and column of the insertion."""
    motifs = inserted.where("motif IS NOT NULL").select("ref", "pos", F.posexplode(F.split("motif", "")).alias("column", "base"))
    return motifs.groupBy("ref", "pos", "column", "base").agg(F.count("*").alias("n"))


def plurality_consensus(reads: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent base of each column, ties to the least; none if a column's lead is below half; and the observed read nearest to it.

    Rows (keys, id, seq) of one length for each key.
    """
    columns = reads.select(*keys, F.posexplode(F.split("seq", "")).alias("i", "b")).groupBy(*keys, "i", "b").count()
    total = F.sum("count").over(Window.partitionBy(*keys, "i"))
    lead = columns.withColumn("n", total).groupBy(*keys, "i").agg(F.max_by(F.struct("b", "count", "n"), F.struct("count", -F.ascii("b"))).alias("m"))
    whole = lead.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "m.b"))).alias("c"), F.min(F.col("m.count") * 2 >= F.col("m.n")).alias("clear")).select(*keys, F.array_join("c.b", "").alias("consensus"), "clear")
    near = reads.join(whole, keys).withColumn("d", F.expr("size(filter(sequence(1, length(seq)), i -> substring(seq, i, 1) <> substring(consensus, i, 1)))"))
    best = near.groupBy(*keys, "consensus", "clear").agg(F.min(F.struct("d", "id")).alias("b"))
    return best.select(*keys, "consensus", "clear", F.col("b.d").alias("distance"), F.col("b.id").alias("nearest"))


def column_occupancy(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The alignment columns with at least half informative places."""
    c = rows.select(*keys, F.posexplode(F.split("seq", "")).alias("i", "b")).groupBy(*keys, "i").agg(F.count("*").alias("n"), F.count_if(F.expr("b NOT IN ('-', 'N')")).alias("informative"))
    return c.withColumn("kept", F.col("informative") * 2 >= F.col("n"))


def pair_identities(rows: DataFrame, keys: list[str], least: int = 7) -> DataFrame:
    """Identity of every two sequences of a locus over comparable columns; null below the least number of them."""
    a, b = rows.select(*keys, F.col("id").alias("a"), F.col("seq").alias("x")), rows.select(*keys, F.col("id").alias("b"), F.col("seq").alias("y"))
    both = spread_pairs(a, b, keys, "a").where("a < b")

    def kernel(batches):
        for pdf in batches:
            known = pdf["x"].notna() & pdf["y"].notna()
            x, y = (np.array(pdf[c].fillna("").tolist(), "U") for c in ("x", "y"))
            least_length = np.minimum(np.char.str_len(x), np.char.str_len(y)) if len(pdf) else np.zeros(0, int)
            width = int(least_length.max(initial=0))
            x, y = (v.astype(f"U{max(1, width)}").view(np.uint32).reshape(len(pdf), -1)[:, :width] for v in (x, y))
            bases = lambda v: (v != ord("-")) & (v != ord("N"))
            both_bases = bases(x) & bases(y) & (np.arange(width) < least_length[:, None])
            counts = {"n": both_bases.sum(1), "same": (both_bases & (x == y)).sum(1)}
            yield pdf[[*keys, "a", "b"]].assign(**{c: pd.array(v, "Int32") for c, v in counts.items()}).assign(**{c: lambda d, c=c: d[c].where(known.to_numpy()) for c in counts})

    kinds = ", ".join(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in [*keys, "a", "b"])
    counted = both.select(*keys, "a", "b", "x", "y").mapInPandas(kernel, f"{kinds}, n int, same int")
    return counted.withColumn("identity", F.expr(f"CASE WHEN n >= {least} THEN round(same / n, 6) END"))