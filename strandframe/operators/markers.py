"""Marker references as coloured k-mers: sets of colours as classes, decoys that absorb reads, support by reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from . import recruitment as R
from .graphs import written
from .packed import CODED, own_codes
from .recruitment import code_sieve

#: The group of every decoy.
DECOY = "DECOY"


def grouped(references: DataFrame, mapping: DataFrame) -> DataFrame:
    """References (ref, seq) with grp from mapping (ref, grp), whose repeated rows must agree and which must name these references and no others.

    A fault is a ValueError that names up to ten of the ids at fault.
    """
    own = mapping.where("ref IS NOT NULL AND grp IS NOT NULL").selectExpr("trim(ref) AS ref", "trim(grp) AS grp").where("ref <> '' AND grp <> ''").distinct()
    faults = {
        "ids of more than one group": own.groupBy("ref").count().where("count > 1"),
        "references without a group": references.join(own, "ref", "left_anti"),
        "groups without a reference": own.join(references, "ref", "left_anti"),
    }
    for fault, rows in faults.items():
        named = [r["ref"] for r in rows.select("ref").distinct().orderBy("ref").limit(10).collect()]
        if named:
            raise ValueError(f"{fault}: {', '.join(named)}")
    return references.join(own, "ref").select("ref", "grp", "seq")


def coloured(references: DataFrame, decoys: DataFrame | None = None) -> DataFrame:
    """Rows (colour, ref, grp, seq): references (ref, grp, seq) numbered from 0 by ref, then decoys (ref, seq) in the same way.

    References without bases have no colour. Rows are dealt by ranges and numbered within these, so no task holds them all.
    """
    both = references.select(F.lit(0).alias("decoy"), "ref", "grp", "seq")
    if decoys is not None:
        both = both.unionByName(decoys.select(F.lit(1).alias("decoy"), "ref", F.lit(DECOY).alias("grp"), "seq"))
    dealt = written(both.where("seq <> ''").repartitionByRange("decoy", "ref").withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").count()
    before = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("decoy", "ref"))
    return dealt.withColumn("_w", within).join(before, "_part").select((F.col("_w") + F.col("_b") - 1).alias("colour"), "ref", "grp", "seq")


def colour_classes(colours: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(kmer, class) for every k-mer of either strand, and (class, colour): k-mers of the same colours share a class, named by its least canonical k-mer.

    Sets are told apart by their size and 128 bits of hashes, which add up before a shuffle, so the colours of a k-mer that
    most references hold are never gathered; the members of a class are those of the k-mer that names it.
    """
    if k > CODED:
        index = written(R.reference_index(colours.select(F.col("colour").alias("locus"), "seq"), k).select("kmer", "canonical", F.col("locus").alias("colour")))
        sets = index.groupBy("kmer", "canonical").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("colour")).alias("h"), F.bit_xor(F.xxhash64("colour", F.lit(1))).alias("g"))
        names = written(sets.groupBy("n", "h", "g").agg(F.min("canonical").alias("class")))
        members = index.where("kmer = canonical").join(names.select("class"), F.col("kmer") == F.col("class")).select("class", "colour")
        return sets.join(names, ["n", "h", "g"]).select("kmer", "class"), members
    sets = _coded_sets(colours, k)
    text = S.from_two_bit("code", k)
    several = sets.where("n > 1")
    names = written(several.groupBy("n", "h", "g").agg(F.min("code").alias("code")).selectExpr("n", "h", "g", f"{text} AS class"))
    alone = written(sets.where("n = 1").groupBy("colour").agg(F.min("code").alias("code")).selectExpr("colour", f"{text} AS class"))
    either = lambda df: df.selectExpr(f"{text} AS own", "class").selectExpr("explode(array_distinct(array(own, " + S.reverse_complement("own") + "))) AS kmer", "class")
    kmers = either(several.hint("merge").join(names, ["n", "h", "g"])).unionByName(either(sets.where("n = 1").hint("merge").join(alone, "colour")))
    named = names.selectExpr(f"explode(array_distinct(array(class, {S.reverse_complement('class')}))) AS kmer", "class")
    held = R.indexed_kmers(colours.select("colour", "seq"), named, names.selectExpr("class AS seq"), k, ("colour",)).select("class", "colour").distinct()
    return kmers, held.unionByName(alone.select("class", "colour"))


def _coded_sets(colours: DataFrame, k: int) -> DataFrame:
    """Rows (code, n, h, g, colour) of the canonical k-mers, whose order as codes is that of texts: how many colours each has, hashes of these where there are several, and the least."""
    index = own_codes(colours, k, ["colour"]).repartition("code")
    sets = index.groupBy("code").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("colour")).alias("h"), F.bit_xor(F.xxhash64("colour", F.lit(1))).alias("g"), F.min("colour").alias("colour"))
    return written(sets.select("code", "n", *[F.when(F.col("n") > 1, F.col(c)).alias(c) for c in ("h", "g")], "colour"))


def _coded_hits(queries: DataFrame, colours: DataFrame, k: int, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, own, class, _c) and (class, colour): the windows of queries by what holds them, the one colour own or the class of several, named by its least code; and the colours of such classes.

    Codes meet, one for both strands, so neither texts nor names of classes go with each k-mer.
    """
    sets = _coded_sets(colours, k)
    several = sets.where("n > 1")
    names = written(several.groupBy("n", "h", "g").agg(F.min("code").alias("class")))
    index = several.hint("merge").join(names.hint("merge"), ["n", "h", "g"]).select("code", F.lit(None).cast(sets.schema["colour"].dataType).alias("own"), "class").unionByName(sets.where("n = 1").selectExpr("code", "colour AS own", "cast(null AS long) AS class"))
    held = own_codes(colours, k, ["colour"], flags=code_sieve(names.select(F.col("class").alias("code")), names.count())).join(names.select("class"), F.col("code") == F.col("class")).select("class", "colour")
    passing = own_codes(queries, k, keys, flags=code_sieve(sets, sets.count()))
    found = passing.hint("merge").join(index.hint("merge"), "code").groupBy(*keys, "own", "class").agg(F.sum("n").alias("_c"))
    return found, held


def pseudoaligned(queries: DataFrame, colours: DataFrame, k: int = 31, share: float = 0.8, relevant: float = 0.5, keys: tuple[str, ...] = ("read_id",)) -> DataFrame:
    """Rows (keys, colour, hits, known, windows): the colours that hold at least share of a query's known windows, where at least relevant of all its windows are known.

    windows counts the unambiguous ones, known those of any colour, decoys included. Windows are added up by class before
    they meet colours, so a query sends a row for each class and not for each k-mer and colour.
    """
    sized = queries.withColumn("_windows", F.expr(f"aggregate({S.valid_runs('seq')}, 0L, (n, r) -> n + greatest(0, length(r) - {k - 1}))"))
    if k > CODED:
        kmers, members = colour_classes(colours, k)
        found = R.indexed_kmers(sized, written(kmers), colours, k, (*keys, "_windows"))
        by_class = found.groupBy(*keys, "_windows", "class").agg(F.count("*").alias("_c"), F.first(F.lit(None).cast(colours.schema["colour"].dataType)).alias("own"))
    else:
        by_class, members = _coded_hits(sized, colours, k, [*keys, "_windows"])
    known = by_class.withColumn("known", F.sum("_c").over(Window.partitionBy(*keys))).where(F.col("known") >= relevant * F.col("_windows"))
    each = known.join(members, "class", "left").withColumn("colour", F.coalesce("own", "colour"))
    return each.groupBy(*keys, "colour").agg(F.sum("_c").alias("hits"), F.max("known").alias("known"), F.max("_windows").alias("windows")).where(F.col("hits") >= share * F.col("known"))


def reference_support(aligned: DataFrame, colours: DataFrame, keys: tuple[str, ...] = ("read_id",)) -> DataFrame:
    """Rows (colour, ref, grp, queries, weight, alone, status) of every reference with a query: a query of n colours counts 1/n for each, and alone where n is 1.

    Decoys take their share like any other colour, so what they absorb is not counted for markers.
    """
    n = F.count("*").over(Window.partitionBy(*keys))
    sums = aligned.withColumn("_n", n).groupBy("colour").agg(F.count("*").alias("queries"), F.sum(1 / F.col("_n")).alias("weight"), F.count_if(F.col("_n") == 1).alias("alone"))
    status = F.expr("CASE WHEN alone > 0 THEN 'has_singleton_support' ELSE 'shared_only' END")
    return colours.drop("seq").join(sums, "colour").select("colour", "ref", "grp", "queries", F.round("weight", 8).alias("weight"), "alone", status.alias("status"))


def marker_quality(queries: DataFrame, aligned: DataFrame, colours: DataFrame, by: str, keys: tuple[str, ...] = ("read_id",)) -> DataFrame:
    """Rows (by, queries, aligned, absorbed): all queries, those with a colour, and those of which every colour is a decoy's."""
    marks = aligned.join(colours.select("colour", (F.col("grp") == DECOY).alias("_d")), "colour").groupBy(*keys).agg(F.bool_and("_d").alias("_d"))
    seen = queries.select(by, *keys).join(marks, list(keys), "left")
    return seen.groupBy(by).agg(F.count("*").alias("queries"), F.count("_d").alias("aligned"), F.count_if("_d").alias("absorbed"))
