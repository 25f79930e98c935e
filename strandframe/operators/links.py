"""Pair hashes, diagonals by seeds, and links between the ends of sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S

# The halves of the 64-bit FNV-1a offset basis, and its prime less 2**40.
BASIS_HIGH, BASIS_LOW, PRIME_REST = 0xCBF29CE4, 0x84222325, 0x1B3


def fnv(first: str, second: str) -> Column:
    """the FNV-1a hash of two texts with byte 255 between them, as a struct (hi, lo) of 32-bit halves, so that no product overflows."""
    codes = lambda s: f"CASE WHEN {s} = '' THEN cast(array() AS array<int>) ELSE transform(sequence(1, length({s})), i -> ascii(substring({s}, i, 1))) END"
    low = "(h.lo ^ b)"
    step = f"named_struct('hi', (h.hi * {PRIME_REST} + shiftright({low} * {PRIME_REST}, 32) + shiftleft({low}, 8)) & 4294967295, 'lo', ({low} * {PRIME_REST}) & 4294967295)"
    return F.expr(f"aggregate(concat({codes(first)}, array(255), {codes(second)}), named_struct('hi', {BASIS_HIGH}L, 'lo', {BASIS_LOW}L), (h, b) -> {step})")


def bounded_stacks(pairs: DataFrame, key: str, n: int = 128) -> DataFrame:
    """Pairs (key, id, seq1, seq2) with hash: the n of each key with the least hash, ties to the least id."""
    held = pairs.withColumn("_h", fnv("seq1", "seq2"))
    ranked = held.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_h.hi", "_h.lo", "id"))).where(F.col("_r") <= n)
    return ranked.withColumn("hash", F.expr("lower(concat(lpad(hex(_h.hi), 8, '0'), lpad(hex(_h.lo), 8, '0')))")).drop("_h", "_r")


def diagonals(fragments: DataFrame, library: DataFrame, k: int, top: int, within: list[str] | None = None) -> DataFrame:
    """Fragments (fragment, seq) and library (locus, seq) at their top offsets by shared k-mers: (fragment, locus, offset, seeds, n, identity, coverage).

    An offset is the place in the library less that in the fragment. The top is taken for each fragment, or for each of
    the columns within; ties to the least locus and offset. n bases lie over each other.
    """
    here = S.kmers(fragments.select("fragment", "seq"), k).select("fragment", "kmer", F.col("pos").alias("at"))
    seeds = here.join(S.kmers(library.select("locus", "seq"), k), "kmer").groupBy("fragment", "locus", (F.col("pos") - F.col("at")).alias("offset")).agg(F.count("*").alias("seeds"))
    best = seeds.withColumn("_r", F.row_number().over(Window.partitionBy(*(within or ["fragment"])).orderBy(F.desc("seeds"), "locus", "offset"))).where(F.col("_r") <= top).drop("_r")
    both = best.join(fragments.select("fragment", F.col("seq").alias("a")), "fragment").join(library.select("locus", F.col("seq").alias("b")), "locus")
    over = both.withColumn("n", F.expr("least(length(a) - greatest(0, -offset), length(b) - greatest(0, offset))"))
    same = "size(filter(sequence(1, n), i -> substring(a, i + greatest(0, -offset), 1) = substring(b, i + greatest(0, offset), 1)))"
    return over.select("fragment", "locus", "offset", "seeds", "n", F.expr(f"CASE WHEN n > 0 THEN {same} / n ELSE 0D END").alias("identity"), F.expr("n / length(a)").alias("coverage"))


def library_hits(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Of diagonals, with classes (locus, class), the best score of each fragment and the best of another class, 0 without one; ties to the least locus and offset."""
    scored = found.join(classes, "locus").withColumn("score", F.col("identity") * F.col("coverage"))
    best = scored.withColumn("_r", F.row_number().over(Window.partitionBy("fragment").orderBy(F.desc("score"), "locus", "offset"))).where("_r = 1").drop("_r")
    other = scored.select("fragment", F.col("class").alias("_class"), F.col("score").alias("_score")).join(best.select("fragment", "class"), "fragment").where("_class <> class").groupBy("fragment").agg(F.max("_score").alias("second"))
    return best.join(other, "fragment", "left").select("fragment", "locus", "class", *[F.round(c, 6).alias(c) for c in ("identity", "coverage", "score")], F.round(F.coalesce("second", F.lit(0.0)), 6).alias("second"))


def anchored(found: DataFrame, k: int, least: float = 0.8) -> DataFrame:
    """Of diagonals with strand 1 or 2 the best of each fragment and locus: enough bases and identity, then most seeds, identity, bases, least offset; of both strands the more identical, the first on ties."""
    good = found.where((F.col("n") >= k) & (F.col("identity") >= least))
    one = good.withColumn("_r", F.row_number().over(Window.partitionBy("fragment", "locus", "strand").orderBy(F.desc("seeds"), F.desc("identity"), F.desc("n"), "offset"))).where("_r = 1").drop("_r")
    return one.withColumn("_r", F.row_number().over(Window.partitionBy("fragment", "locus").orderBy(F.desc("identity"), "strand"))).where("_r = 1").select("fragment", "locus", "strand", F.col("n").alias("aligned"), F.round("identity", 6).alias("identity"))


def end_links(sequences: DataFrame, pairs: DataFrame, k: int, window: int, least: int) -> DataFrame:
    """Rows (a, b, fragments): links between oriented sequences (id, seq), 2 * id on their own strand and one more on the other.

    The left mate must have one best target among the ends of all oriented sequences, the right mate, turned, among the
    begins; a best target has enough hits of the mate's distinct k-mers and more than any other.
    """
    oriented = sequences.selectExpr("2 * id AS target", "seq").unionByName(sequences.selectExpr("2 * id + 1 AS target", f"{S.reverse_complement('seq')} AS seq"))

    def target(mates: DataFrame, ends: DataFrame, name: str) -> DataFrame:
        own = S.kmers(mates, k).select("fragment", "kmer").distinct()
        hits = own.join(S.kmers(ends, k).select("target", "kmer"), "kmer").groupBy("fragment", "target").agg(F.count("*").alias("n"))
        best = hits.groupBy("fragment").agg(F.max("n").alias("most")).where(F.col("most") >= least)
        return hits.join(best, "fragment").where("n = most").groupBy("fragment").agg(F.count("*").alias("c"), F.min("target").alias(name)).where("c = 1").drop("c")

    left = target(pairs.selectExpr("fragment", "seq1 AS seq"), oriented.selectExpr("target", f"right(seq, {window}) AS seq"), "a")
    right = target(pairs.selectExpr("fragment", f"{S.reverse_complement('seq2')} AS seq"), oriented.selectExpr("target", f"left(seq, {window}) AS seq"), "b")
    return left.join(right, "fragment").groupBy("a", "b").agg(F.count("*").alias("fragments"))


def pair_support(hits: DataFrame) -> DataFrame:
    """Hits (fragment, mate, unitig): by unitig the fragments whose mates each have one unitig, and not the same."""
    only = hits.distinct().groupBy("fragment", "mate").agg(F.count("*").alias("n"), F.min("unitig").alias("unitig")).where("n = 1")
    both = only.groupBy("fragment").agg(F.collect_set("unitig").alias("u"), F.count("*").alias("mates")).where("mates = 2 AND size(u) = 2")
    return both.select(F.explode("u").alias("unitig")).groupBy("unitig").agg(F.count("*").alias("fragments"))
