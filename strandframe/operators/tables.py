"""Operators over sample by locus tables: states, summaries, matrices, ranking, sampling and sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S


def densified(rows: DataFrame, samples: DataFrame, loci: DataFrame, fill: dict) -> DataFrame:
    """A row for each sample and locus, with fill where rows has none. Both dimensions are small tables of names."""
    return samples.crossJoin(loci).join(rows, ["sample", "locus"], "left").na.fill(fill)


def audit(hits: DataFrame, fragment: str, group: str) -> DataFrame:
    """Fragments of one group only are specific to it, the others ambiguous for each of theirs."""
    sets = hits.groupBy("sample", fragment).agg(F.collect_set(group).alias("groups"))
    rows = sets.select("sample", F.size("groups").alias("n"), F.explode("groups").alias(group))
    return rows.groupBy("sample", group).agg(F.count_if(F.expr("n = 1")).alias("specific"), F.count_if(F.expr("n > 1")).alias("ambiguous"))


def presence(n: str, specific: str, ambiguous: str, least: int = 100, enough: int = 3, share: float = 0.7) -> Column:
    """P10."""
    return F.expr(f"CASE WHEN {n} < {least} THEN 'NA' WHEN {specific} >= {enough} AND {specific} / ({specific} + {ambiguous}) >= {share} THEN 'PRESENT' WHEN {specific} = 0 THEN 'ABSENT' ELSE 'NA' END")


def rejection(rules: dict[str, str]) -> Column:
    """The names of the rules that hold, in order, joined by semicolons."""
    return F.concat_ws(";", *[F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items()])


def accepted(explicit: str, status: str, low_quality: str) -> Column:
    """An explicit answer wins; else success without low quality."""
    return F.expr(f"coalesce(cast(nullif({explicit}, '') AS boolean), {status} = 'success' AND NOT {low_quality})")


def ladder(*rungs: tuple[str, str], otherwise: str) -> Column:
    """The label of the first condition that holds."""
    return F.expr("CASE " + " ".join(f"WHEN {cond} THEN '{label}'" for cond, label in rungs) + f" ELSE '{otherwise}' END")


def merged_intervals(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Half-open intervals that overlap or touch, as one, by a running maximum of ends."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    return marked.withColumn("_island", F.sum("_new").over(w)).groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def support(intervals: DataFrame, keys: list[str], length: Column) -> DataFrame:
    """Supported bases, breadth and the longest gap, those at both ends included."""
    merged = merged_intervals(intervals, keys).withColumn("_n", length)
    w = Window.partitionBy(*keys).orderBy("start")
    gap = F.col("start") - F.coalesce(F.lag("end").over(w), F.lit(0))
    tail = F.when(F.lead("start").over(w).isNull(), F.col("_n") - F.col("end")).otherwise(0)
    return merged.withColumn("_g", F.greatest(gap, tail)).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("supported"), F.max("_g").alias("max_gap"), F.count("*").alias("islands"), F.round(F.sum(F.col("end") - F.col("start")) / F.max("_n"), 6).alias("breadth"))


def order_statistics(counts: DataFrame, keys: list[str], value: str, wanted: dict[str, str]) -> DataFrame:
    """For each key of counts (keys, value, c) its number of values _n, and the values at places of the sorted row of them, from 0; wanted gives each place in terms of _n.

    Only distinct values with their counts are sorted, so a key's memory does not grow with its rows.
    """
    w = Window.partitionBy(*keys)
    placed = counts.withColumn("_n", F.sum("c").over(w)).withColumn("_end", F.sum("c").over(w.orderBy(value)))
    at = [F.max(F.expr(f"CASE WHEN _end - c <= ({place}) AND ({place}) < _end THEN {value} END")).alias(name) for name, place in wanted.items()]
    return placed.groupBy(*keys).agg(F.max("_n").alias("_n"), *at)


def depth_statistics(rows: DataFrame, keys: list[str], depth: str) -> DataFrame:
    """Median, quartiles by halves, outlier cap, variation, peak and stability of depths."""
    counts = rows.where(F.col(depth).isNotNull()).groupBy(*keys, F.col(depth).alias("_v")).agg(F.count("*").alias("c"))
    half = "(_n div 2)"
    places = {"m0": "(_n - 1) div 2", "m1": "_n div 2", "l0": f"({half} - 1) div 2", "l1": f"{half} div 2", "h0": f"_n - {half} + ({half} - 1) div 2", "h1": f"_n - {half} + {half} div 2", "top": "_n - 1"}
    stats = order_statistics(counts, keys, "_v", places).join(counts.groupBy(*keys).agg((F.sum(F.expr("_v * c")) / F.sum("c")).alias("mean")), keys)
    alone = "_n = 1"
    stats = stats.selectExpr(*keys, "mean", "top", "m1 AS upper_median", "(m0 + m1) / 2D AS median", f"CASE WHEN {alone} THEN cast(m0 AS double) ELSE (l0 + l1) / 2D END AS q1", f"CASE WHEN {alone} THEN cast(m0 AS double) ELSE (h0 + h1) / 2D END AS q3")
    far = counts.join(stats.select(*keys, "median", "mean"), keys)
    spread = far.groupBy(*keys).agg(F.sqrt(F.sum(F.expr("c * (_v - mean) * (_v - mean)")) / F.sum("c")).alias("sd"))
    from_median = far.groupBy(*keys, F.expr("abs(_v - median)").alias("_v")).agg(F.sum("c").alias("c"))
    mad = order_statistics(from_median, keys, "_v", {"d0": "(_n - 1) div 2", "d1": "_n div 2"}).selectExpr(*keys, "(d0 + d1) / 2D AS mad")
    held = stats.join(spread, keys).join(mad, keys)
    return held.select(*keys, "median", "q1", "q3", "upper_median", F.expr("q3 + 1.5 * (q3 - q1)").alias("cap"), F.expr("round(sd / mean, 6)").alias("cv"), F.expr("round(top / median, 6)").alias("peak"), F.expr("cast(floor(median * 100 / (mad + 1)) AS long)").alias("stability"))


def ranked(rows: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each key in a total order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def bottom_by_hash(rows: DataFrame, keys: list[str], id: str, n: int) -> DataFrame:
    """A sample that depends on the ids alone: the n rows of the least hash for each key."""
    return ranked(rows, keys, [F.md5(F.col(id).cast("string")), F.col(id)], n)


def thinned(rows: DataFrame, keys: list[str], order: str, interval: int) -> DataFrame:
    """Every interval-th row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_r") % interval == 0).drop("_r")


def evenly(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Up to n rows of each key at even distances."""
    w = Window.partitionBy(*keys)
    r = rows.withColumn("_r", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    return r.where(f"_n <= {n} OR (_r * {n}) div _n <> ((_r - 1) * {n}) div _n OR _r = 0").drop("_r", "_n")


def terminal_quota(rows: DataFrame, per_extension: int, total: int) -> DataFrame:
    """On each side at most so many of one extension length, and so many in all."""
    keys = [F.desc("ext"), F.asc("loci"), F.desc("exact"), F.asc("id")]
    first = ranked(rows, ["locus", "side", "ext"], keys, per_extension, "_e")
    return ranked(first, ["locus", "side"], keys, total).drop("_e")


def bin_quota(rows: DataFrame, quota: int, target: int) -> DataFrame:
    """Up to quota of each bin first, the best before the others; the rest of the target by quality alone."""
    best = [F.desc("exact"), F.asc("loci"), F.asc("id")]
    held = rows.withColumn("in_bin", F.row_number().over(Window.partitionBy("locus", "bin").orderBy(*best)))
    return ranked(held, ["locus"], [(F.col("in_bin") > quota).cast("int"), *best], target).withColumn("pass", F.when(F.col("in_bin") <= quota, 1).otherwise(2)).drop("in_bin")


def adaptive_target(rows: DataFrame, length: str, bases: str) -> DataFrame:
    """Whether a locus is passed through, and how many candidates it keeps.

    Fewer than 512 candidates, depth up to 160 or fewer than 48 covered bins of 64 pass through; else the target is the
    largest of 80-fold depth, 512 and three fifths, never above the number of candidates.
    """
    a = rows.groupBy("locus").agg(F.count("*").alias("n"), F.sum(bases).alias("bases"), F.max(length).alias("length"), F.bit_count(F.bit_or("bins")).alias("covered"))
    depth = F.col("bases") / F.col("length")
    through = (F.col("n") < 512) | (depth <= 160) | (F.col("covered") < 48)
    target = F.least(F.greatest(F.ceil(80 * F.col("length") / (F.col("bases") / F.col("n"))), F.lit(512), F.ceil(F.col("n") * 0.6)), F.col("n"))
    return a.select("locus", "n", "covered", F.round(depth, 6).alias("depth"), through.alias("pass_through"), F.when(through, F.col("n")).otherwise(target).cast("long").alias("target"))


def depth_threshold(rows: DataFrame, keys: list[str], exact: str, weight: str, limit: float) -> DataFrame:
    """The least exact length from which on the weight above it is no more than a limit, from a histogram and its sums from the far end."""
    hist = rows.groupBy(*keys, F.col(exact).alias("k")).agg(F.sum(weight).alias("w"))
    sums = hist.withColumn("above", F.sum("w").over(Window.partitionBy(*keys).orderBy(F.desc("k"))))
    return sums.groupBy(*keys).agg(F.max("k").alias("longest"), F.min(F.when(F.col("above") <= limit, F.col("k"))).alias("threshold"), F.sum("w").alias("weight"))


def candidate_pairs(postings: DataFrame, key: str, id: str, cap: int, least: int) -> DataFrame:
    """Pairs of ids that share at least so many keys, keys with more than cap ids left out: the cap is part of the operator."""
    kept = postings.select(key, id).distinct()
    sizes = kept.groupBy(key).count().where(F.col("count") <= cap).select(key)
    kept = kept.join(sizes, key)
    return kept.withColumnRenamed(id, "a").join(kept.withColumnRenamed(id, "b"), key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def fractional_support(hits: DataFrame, query: str, target: str) -> DataFrame:
    """Hits, the sum of each query's share, and hits of queries with no other target."""
    n = hits.withColumn("_n", F.count("*").over(Window.partitionBy("sample", query)))
    return n.groupBy("sample", target).agg(F.count("*").alias("hits"), F.round(F.sum(1 / F.col("_n")), 6).alias("fraction"), F.count_if(F.expr("_n = 1")).alias("singletons"))


def matrix(rows: DataFrame, row: str, column: str, value: Column, columns: list | None = None) -> DataFrame:
    """K5: a wide table of one row for each row key."""
    return rows.groupBy(row).pivot(column, columns).agg(value)


def concatenated(rows: DataFrame, samples: DataFrame, loci: DataFrame) -> DataFrame:
    """The sequences of each sample one after another in the order of loci, gaps of the locus's length for those it lacks."""
    full = samples.crossJoin(loci).join(rows, ["sample", "locus"], "left").withColumn("seq", F.coalesce("seq", F.expr("repeat('-', width)")))
    joined = full.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("locus", "seq"))).alias("s"))
    return joined.select("sample", F.array_join("s.seq", "").alias("seq"))


def equal_trees(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, repeats counted."""
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("b")))


#: Parts that the left rows of a group are dealt in, so that its pairs are many tasks' work.
PAIR_PARTS = 64


def spread_pairs(a: DataFrame, b: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Every row of a with every row of b of the same keys, evenly over the tasks whatever the sizes of groups and files; by is a column of a that tells its rows apart.

    Pairs grow with the square of the rows, so files too small for several splits may give all the work there is.
    """
    n = max(PAIR_PARTS, int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = a.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(PAIR_PARTS))).repartition(n, *keys, "_part")
    right = b.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PAIR_PARTS - 1).cast("long")))).repartition(n, *keys, "_part")
    return left.hint("merge").join(right, [*keys, "_part"]).drop("_part")
