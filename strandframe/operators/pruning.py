"""Greedy pruning of linked sites over sliding windows, in rounds, so that no chromosome is the work of one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import discard, written


def ordered_sites(dosage: DataFrame, group: str) -> DataFrame:
    """Rows (group, site, i, maf): the place of every site in its chromosome, from 0, and its minor allele's share.

    Sites are dealt by ranges and numbered within these; the sizes of the ranges before are added, so a chromosome needs no
    task for itself.
    """
    own = dosage.groupBy(group, "site").agg((F.sum("n") / (2 * F.count("*"))).alias("p")).select(group, "site", F.least("p", 1 - F.col("p")).alias("maf"))
    dealt = written(own.repartitionByRange(F.col(group), F.col("site")).withColumn("_part", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy("site"))
    sizes = dealt.groupBy(group, "_part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_w", within).join(sizes.select(group, "_part", before.alias("_b")), [group, "_part"]).select(group, "site", (F.col("_w") + F.col("_b") - 1).alias("i"), "maf")


def linked_pairs(dosage: DataFrame, sites: DataFrame, group: str, window: int, step: int, most: float) -> DataFrame:
    """Rows (group, turn, a, b, loser): pairs of sites that some window holds together and whose dosages have a squared correlation over most.

    Windows begin at every step-th site and hold so many. turn is the first window with both; a < b are places. Of a pair
    the site of the rarer minor allele loses, the later one if they are alike. Samples count that have a call at both.
    """
    placed = dosage.join(sites, [group, "site"]).select(group, "i", "sample", "n")
    # a site meets the sites of its own stretch of places and of the next one, by stretch, sample and distance
    left = placed.select(group, F.col("i").alias("a"), "sample", F.col("n").alias("x"), F.explode(F.expr(f"array(i div {window}, i div {window} + 1)")).alias("_s"))
    right = placed.select(group, F.col("i").alias("b"), "sample", F.col("n").alias("y"), F.expr(f"i div {window}").alias("_s"))
    near = left.join(right, [group, "_s", "sample"]).where(f"a < b AND b < (a div {step}) * {step} + {window}")
    sums = near.groupBy(group, "a", "b").agg(F.count("*").alias("c"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.expr("x * y")).alias("xy"), F.sum(F.expr("x * x")).alias("xx"), F.sum(F.expr("y * y")).alias("yy"))
    linked = sums.where(F.expr(f"(c * xy - x * y) * (c * xy - x * y) > {most} * ((c * xx - x * x) * (c * yy - y * y))")).select(group, "a", "b")
    rare = sites.select(group, F.col("i").alias("a"), F.col("maf").alias("_ma"))
    with_both = linked.join(rare, [group, "a"]).join(rare.select(group, F.col("a").alias("b"), F.col("_ma").alias("_mb")), [group, "b"])
    return with_both.select(group, F.expr(f"greatest(0, cast(ceil((b - {window - 1}) / {step}) AS long))").alias("turn"), "a", "b", F.expr("CASE WHEN _ma < _mb THEN a ELSE b END").alias("loser"))


def pruned(dosage: DataFrame, group: str, window: int = 50, step: int = 5, most: float = 0.2, rounds: int = 10_000) -> DataFrame:
    """Rows (group, site, i, maf, kept): what is left when windows are gone through in order, and of each pair over most that both still stand the loser goes.

    dosage has (group, site, sample, n), one row for each called genotype. A pair waits for the pairs of either site that
    come before it; those that wait for none are decided in one round, all over the genome. A round drops all pairs of the
    sites that it removes, its state is a table of pairs and one of lost sites, and the rounds end when no pair is left.
    """
    sites = written(ordered_sites(dosage, group))
    open_ = written(linked_pairs(dosage, sites, group, window, step, most))
    lost = None
    for _ in range(rounds):
        if open_.isEmpty():
            break
        turn = F.struct("turn", "a", "b")
        ends = open_.select(group, turn.alias("t"), F.explode(F.array("a", "b")).alias("i"))
        first = ends.groupBy(group, "i").agg(F.min("t").alias("first"))
        chosen = open_.withColumn("t", turn).join(first.select(group, F.col("i").alias("a"), F.col("first").alias("_fa")), [group, "a"]).join(first.select(group, F.col("i").alias("b"), F.col("first").alias("_fb")), [group, "b"]).where("t = _fa AND t = _fb")
        gone = written(chosen.select(group, F.col("loser").alias("i")).distinct())
        lost = gone if lost is None else written(lost.unionByName(gone))
        rest = open_.join(gone.select(group, F.col("i").alias("a")), [group, "a"], "left_anti").join(gone.select(group, F.col("i").alias("b")), [group, "b"], "left_anti")
        last, open_ = open_, written(rest.select(group, "turn", "a", "b", "loser"))
        discard(last)
    else:
        raise RuntimeError(f"pruning did not end in {rounds} rounds")
    if lost is None:
        return sites.withColumn("kept", F.lit(True))
    return sites.join(lost.withColumn("_gone", F.lit(True)), [group, "i"], "left").select(group, "site", "i", "maf", F.col("_gone").isNull().alias("kept"))
