"""Contigs led by pairs: which fragments pass an edge, which thin k-mers a mate vouches for, and the walk that weighs both.

Joins of tables that k-mers are cut from ask for a merge: the planner knows the compressed size of what they are cut from
alone, takes a fraction of theirs for it and would send them whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from .graphs import WALK_STEPS, assembled, written
from .recruitment import BROADCAST_KMERS


def _either(reference: DataFrame, k: int) -> DataFrame:
    """The k-mers of both strands of a reference (locus, kmer), sent to every executor where a count tells that they are few; else they meet others by a merge join."""
    both = reference.selectExpr("locus", f"explode(array(kmer, {S.reverse_complement('kmer')})) AS kmer").distinct()
    return F.broadcast(both) if 2 * reference.count() <= BROADCAST_KMERS else both.hint("merge")


def anchored_mates(pairs: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """Rows (locus, fragment, mate, seq, own, opposite): the mates of pairs (locus, fragment, seq1, seq2); whether they, and their other mate, have a k-mer of the reference (locus, kmer) on either strand."""
    mates = pairs.selectExpr("locus", "fragment", "inline(array(struct(1 AS mate, seq1 AS seq), struct(2 AS mate, seq2 AS seq)))")
    hits = S.kmers(mates, k).select("locus", "fragment", "mate", "kmer").join(_either(reference, k), ["locus", "kmer"]).select("locus", "fragment", "mate").distinct()
    both = hits.groupBy("locus", "fragment").agg(F.bit_or(F.expr("mate")).alias("_m"))
    return mates.hint("merge").join(both, ["locus", "fragment"], "left").selectExpr("locus", "fragment", "mate", "seq", "coalesce(_m, 0) & mate <> 0 AS own", "coalesce(_m, 0) & (3 - mate) <> 0 AS opposite")


def _strands(mates: DataFrame, k: int) -> DataFrame:
    """The distinct windows of every mate on both strands."""
    cut = S.kmers(mates, k).select("locus", "fragment", "mate", "own", "opposite", F.explode(F.expr(f"array(kmer, {S.reverse_complement('kmer')})")).alias("kmer"))
    return cut.distinct()


def weighed_kmers(mates: DataFrame, reference: DataFrame, k: int, error_limit: int = 2, least_fragments: int = 2) -> DataFrame:
    """G1, P5, A2: rows (locus, kmer, depth, fragments, rescued): the k-mers of a locus's graph, on both strands.

    A k-mer stays if more mates than error_limit have it or the reference has it. A thinner one is rescued if it stands in
    enough fragments in a mate without an anchor whose other mate has one.
    """
    either = _either(reference, k).withColumn("_ref", F.lit(True))
    counted = _strands(mates, k).groupBy("locus", "kmer").agg(F.count("*").alias("depth"), F.count_if(F.expr("opposite AND NOT own")).alias("fragments"))
    known = counted.join(either, ["locus", "kmer"], "left").withColumn("_thin", F.expr(f"_ref IS NULL AND depth <= {error_limit}"))
    return known.where(F.expr(f"NOT _thin OR fragments >= {least_fragments}")).select("locus", "kmer", "depth", "fragments", F.col("_thin").alias("rescued"))


def branch_support(mates: DataFrame, kmers: DataFrame, k: int) -> DataFrame:
    """Rows (locus, edge, fragments): for the edges out of k-mers with several, as texts of k + 1 bases, how many fragments pass them in a mate whose other mate is anchored. Edges without any have 0."""
    left = kmers.selectExpr("locus", "kmer AS a", f"right(kmer, {k - 1}) AS _k")
    edges = left.hint("merge").join(kmers.selectExpr("locus", "right(kmer, 1) AS base", f"left(kmer, {k - 1}) AS _k"), ["locus", "_k"]).select("locus", "a", "base")
    forks = edges.groupBy("locus", "a").agg(F.collect_list("base").alias("bases")).where("size(bases) > 1")
    edge = forks.select("locus", F.explode("bases").alias("base"), "a").selectExpr("locus", "concat(a, base) AS edge")
    passed = _strands(mates.where("opposite"), k + 1).select("locus", "fragment", F.col("kmer").alias("edge")).distinct().hint("merge").join(edge, ["locus", "edge"]).groupBy("locus", "edge").agg(F.count("*").alias("fragments"))
    return edge.hint("merge").join(passed, ["locus", "edge"], "left").na.fill(0, ["fragments"])


def paired_contigs(pairs: DataFrame, reference: DataFrame, k: int = 21, error_limit: int = 2, least_fragments: int = 2, lookahead: int = 24, limit: int = WALK_STEPS, soft_boundary: int | None = None) -> DataFrame:
    """Rows (locus, seq, weight, candidates, truncated): for each locus the contig of the largest weight, walked with pairs.

    pairs (locus, fragment, seq1, seq2), reference (locus, pos, kmer). A locus's k-mers and branch edges meet in one task; the
    error filter bounds them by what several mates share. limit bounds one walk; truncated tells where it did.
    """
    mates = written(anchored_mates(pairs, reference, k))
    kmers = written(weighed_kmers(mates, reference, k, error_limit, least_fragments))
    edges = branch_support(mates, kmers, k).where("fragments > 0")
    graph = kmers.select("locus", "kmer", F.col("depth").alias("n"), "rescued").unionByName(edges.select("locus", F.col("edge").alias("kmer"), F.col("fragments").alias("n"), F.lit(False).alias("rescued")))

    def kernel(name, own: pd.DataFrame, ref: pd.DataFrame) -> pd.DataFrame:
        node = own["kmer"].str.len() == k
        depth = dict(zip(own["kmer"][node], own["n"][node].tolist(), strict=True))
        passed = {(e[:-1], e[1:]): n for e, n in zip(own["kmer"][~node], own["n"][~node].tolist(), strict=True)}
        thin = set(own["kmer"][node & own["rescued"].astype(bool)])
        made = assembled(depth, ref.sort_values("pos")["kmer"].tolist(), lookahead, limit, soft_boundary, passed, thin, error_limit)
        best = sorted(made, key=lambda c: (-c[1], -len(c[0]), c[0]))[:1]
        return pd.DataFrame([(name[0], *c[:2], len(made), c[2]) for c in best], columns=["locus", "seq", "weight", "candidates", "truncated"], dtype=object)

    types = f"locus {pairs.schema['locus'].dataType.simpleString()}, seq string, weight long, candidates int, truncated boolean"
    ref = reference.select(*[F.col(c).alias(c) for c in ("locus", "pos", "kmer")])
    return graph.groupBy("locus").cogroup(ref.groupBy("locus")).applyInPandas(kernel, types)


