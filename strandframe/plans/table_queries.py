"""Queries over sample by locus tables: line items as measurements, events as group hits, labels as flags."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import tables as T
from . import bridges as B

EVENT_HITS = "(SELECT user_id % 20 AS sample, event_id // 4 AS fragment, event_type AS grp, event_id, value, ts FROM events)"


def measures(spark, sf):
    li = B.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("locus"))
    return li.agg(F.count("*").alias("reads"), F.sum("l_quantity").alias("support"), F.max("l_extendedprice").alias("length"), F.min("l_discount").alias("lo"), F.max("l_tax").alias("hi"), F.min("l_linestatus").alias("status"))


def event_hits(spark, sf):
    return B.table(spark, sf, "events").selectExpr("user_id % 20 AS sample", "event_id div 4 AS fragment", "event_type AS grp", "event_id", "value", "ts")


def sample_stats(spark, sf):
    """A21, F26."""
    m = measures(spark, sf).groupBy("sample")
    return m.agg(F.count("*").alias("loci"), F.count_if(F.expr("status = 'F'")).alias("success"), *[F.count_if(F.expr(f"support >= 50 * {t}")).alias(f"ge_{int(t * 100)}") for t in (0.25, 0.5, 0.75, 1.5)], F.round(F.avg("support"), 6).alias("mean"), F.round(F.median("support"), 6).alias("median"))


def locus_stats(spark, sf):
    """Occupancy counts by status."""
    n = B.table(spark, sf, "supplier").agg(F.count("*").cast("double").alias("n"))
    m = measures(spark, sf).groupBy("locus").agg(F.count_if(F.expr("status = 'F'")).alias("success"), F.count("*").alias("rows"), F.round(F.avg("length"), 6).alias("mean_length"))
    return m.crossJoin(F.broadcast(n)).select("locus", "success", "rows", "mean_length", F.round(F.col("success") / F.col("n"), 6).alias("occupancy"))


def support_matrix(spark, sf):
    """K5: nations by order priority."""
    o = B.table(spark, sf, "orders").join(B.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    wide = T.matrix(o, "c_nationkey", "o_orderpriority", F.round(F.sum("o_totalprice"), 2), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    return wide.toDF("nation", "p1", "p2", "p3", "p4", "p5")


def densify(spark, sf):
    """Every nation and segment, zero where there is none."""
    c = B.table(spark, sf, "customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("sample"), F.col("c_mktsegment").alias("locus")).agg(F.count("*").alias("n"))
    return T.densified(c, B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("sample")), B.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("locus")).distinct(), {"n": 0})


def pair_audit(spark, sf):
    """Specific and ambiguous fragments, and the state that follows."""
    a = T.audit(event_hits(spark, sf), "fragment", "grp")
    return a.withColumn("state", T.presence("specific + ambiguous", "specific", "ambiguous", least=10, share=0.02))


def divergence_histogram(spark, sf):
    """Percent divergence up to 20, the rest in the last bin."""
    return B.table(spark, sf, "lineitem").groupBy(F.expr("cast(least(floor((1 - (1 - l_discount) * (1 - l_tax)) * 100 + 0.5), 20) AS int)").alias("bin")).agg(F.count("*").alias("n"))


def taxon_matrix(spark, sf):
    """Taxa from their samples: present where at least half of the callable samples are."""
    a = T.audit(event_hits(spark, sf), "fragment", "grp").withColumn("state", T.presence("specific + ambiguous", "specific", "ambiguous", least=10, share=0.02)).withColumn("taxon", F.expr("sample % 5"))
    g = a.where("state <> 'NA'").groupBy("taxon", "grp").agg(F.count("*").alias("callable"), F.count_if(F.expr("state = 'PRESENT'")).alias("present"), F.array_sort(F.collect_list("specific")).alias("v"))
    return g.select("taxon", "grp", "callable", "present", F.expr("v[size(v) div 2]").alias("upper_median"), F.expr("CASE WHEN present * 2 >= callable THEN 'PRESENT' ELSE 'ABSENT' END").alias("state"))


def group_compare(spark, sf):
    """Samples and taxa of each group, and whether it is shared."""
    g = event_hits(spark, sf).groupBy("grp").agg(F.countDistinct("sample").alias("samples"), F.array_join(F.array_sort(F.collect_set(F.expr("sample % 5"))), ",").alias("taxa"), F.count("*").alias("hits"))
    return g.withColumn("shared", F.expr("CASE WHEN samples > 1 THEN 'shared' ELSE 'private' END"))


def fractional_support(spark, sf):
    """A19, A20."""
    return T.fractional_support(event_hits(spark, sf).select("sample", "fragment", "grp").distinct(), "fragment", "grp")


def abundance_rpm(spark, sf):
    """Per million, with a group's share and mean value."""
    e = event_hits(spark, sf).groupBy("sample", "grp").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    total = F.sum("n").over(Window.partitionBy("sample"))
    return e.select("sample", "grp", "n", F.round(F.col("n") * 1e6 / total, 6).alias("rpm"), F.round("mean", 6).alias("mean"))


def linkage(spark, sf):
    """Bridges and transitions between groups of one fragment."""
    e = event_hits(spark, sf)
    step = e.withColumn("next", F.lead("grp").over(Window.partitionBy("sample").orderBy("ts", "event_id"))).where("next IS NOT NULL AND next <> grp")
    pairs = step.groupBy(F.least("grp", "next").alias("a"), F.greatest("grp", "next").alias("b")).agg(F.count("*").alias("transitions"), F.countDistinct("fragment").alias("bridges"))
    return pairs.withColumn("score", F.expr("round(ln(bridges + 1) + ln(transitions + 1), 6)"))


def interval_support(spark, sf):
    """Supported bases of each order's line spans."""
    li = B.table(spark, sf, "lineitem").selectExpr("l_partkey % 500 AS locus", "cast(l_suppkey * 7 % 900 AS long) AS start", "cast(l_suppkey * 7 % 900 + l_quantity AS long) AS end")
    return T.support(li, ["locus"], F.lit(1000))


def depth_statistics(spark, sf):
    """A6, A12, F26 to F29."""
    return T.depth_statistics(B.table(spark, sf, "lineitem").selectExpr("l_partkey % 300 AS locus", "l_quantity AS depth"), ["locus"], "depth")


def rejection_reasons(spark, sf):
    """Reasons, acceptance and class ladders."""
    m = measures(spark, sf)
    m = m.withColumn("reasons", T.rejection({"few_reads": "reads < 2", "low_support": "support < 10", "too_short": "length < 5000", "unbalanced": "hi - lo > 0.05", "no_span": "lo = 0"}))
    m = m.withColumn("ok", T.accepted("CASE WHEN locus % 7 = 0 THEN 'true' WHEN locus % 7 = 1 THEN 'false' ELSE '' END", "CASE WHEN status = 'F' THEN 'success' ELSE 'failed' END", "reasons <> ''"))
    return m.groupBy("reasons", "ok").agg(F.count("*").alias("n"))


def status_ladders(spark, sf):
    """Ladders of states over counts."""
    m = measures(spark, sf)
    m = m.withColumn("curation", T.ladder(("lo < 0.01", "low_complexity"), ("support >= 60 AND hi >= 0.05", "keep"), ("support >= 30", "review"), otherwise="drop"))
    m = m.withColumn("evidence", T.ladder(("hi >= 0.08", "high"), ("hi > 0", "partial"), otherwise="none"))
    m = m.withColumn("panref", T.ladder(("reads = 0", "no_core"), ("support < 10", "low_coverage"), ("lo > 0.08", "complex"), ("length < 10000", "short"), ("reads < 2", "low_sample_support"), otherwise="pass"))
    m = m.withColumn("copies", T.ladder(("reads = 1", "single"), otherwise="multi"))
    return m.groupBy("curation", "evidence", "panref", "copies").agg(F.count("*").alias("n"))


def rescue_rollback(spark, sf):
    """Before and after of a rescue round, and which side stays."""
    s = B.table(spark, sf, "orders").selectExpr("o_custkey AS locus", "o_totalprice", "o_orderkey", "o_orderstatus")
    half = lambda r: s.where(f"o_orderkey % 2 = {r}").groupBy("locus").agg(F.sum("o_totalprice").alias("density"), F.max("o_orderstatus").alias("status"))
    both = half(0).toDF("locus", "density_before", "status_before").join(half(1).toDF("locus", "density_after", "status_after"), "locus", "full")
    back = F.expr("density_after IS NULL OR (density_before IS NOT NULL AND (status_before = 'P' AND status_after <> 'P' OR density_after / density_before < 0.5))")
    return both.select("locus", F.when(back, "before").otherwise("after").alias("kept"), F.round(F.coalesce(F.when(back, F.col("density_before")).otherwise(F.col("density_after")), F.lit(0)), 2).alias("density"))


def terminal_quota(spark, sf):
    """W2."""
    li = B.table(spark, sf, "lineitem").groupBy(F.expr("l_partkey % 50").alias("locus"), F.expr("l_returnflag").alias("side"), F.col("l_orderkey").alias("id")).agg(F.max("l_linenumber").alias("ext"), F.countDistinct("l_suppkey").alias("loci"), F.sum("l_quantity").alias("exact"))
    return T.terminal_quota(li, 4, 12).select("locus", "side", "id", "ext", "rank")


def bin_quota(spark, sf):
    """W3."""
    li = B.table(spark, sf, "lineitem").groupBy(F.expr("l_partkey % 50").alias("locus"), F.col("l_orderkey").alias("id")).agg(F.min(F.expr("l_suppkey % 64")).alias("bin"), F.sum("l_quantity").alias("exact"), F.countDistinct("l_partkey").alias("loci"))
    return T.bin_quota(li, 2, 60).select("locus", "id", "bin", "rank", "pass")


def adaptive_target(spark, sf):
    """W1, A10."""
    li = B.table(spark, sf, "lineitem").selectExpr("l_partkey % 40 AS locus", "shiftleft(1L, cast(l_orderkey % 64 AS int)) AS bins", "l_quantity AS bases", "5000D / (1 + l_partkey % 40) AS length")
    return T.adaptive_target(li, "length", "bases")


def depth_threshold(spark, sf):
    """A9."""
    li = B.table(spark, sf, "lineitem").selectExpr("l_suppkey % 100 AS locus", "cast(l_quantity AS int) AS exact", "cast(l_linenumber AS long) AS w")
    return T.depth_threshold(li, ["locus"], "exact", "w", 500)


def hash_sample(spark, sf):
    """W6, W7."""
    return T.bottom_by_hash(B.table(spark, sf, "orders").selectExpr("o_orderpriority AS sample", "o_orderkey AS id"), ["sample"], "id", 50)


def systematic_thinning(spark, sf):
    """W4."""
    return T.thinned(B.table(spark, sf, "orders").selectExpr("o_orderpriority AS sample", "o_orderkey AS id"), ["sample"], "id", 7)


def even_sample(spark, sf):
    """W13."""
    return T.evenly(B.table(spark, sf, "orders").selectExpr("o_orderpriority AS sample", "o_orderkey AS id"), ["sample"], "id", 40)


def first_reads(spark, sf):
    """A bound on the input's own numbering."""
    return B.table(spark, sf, "orders").where("o_orderkey < 1000").selectExpr("o_orderkey AS id", "o_custkey AS sample")


def capped_groups(spark, sf):
    """Distinct fingerprints first, then a bound for each sample and locus in input order."""
    li = B.table(spark, sf, "lineitem").groupBy(F.expr("l_suppkey % 10").alias("sample"), F.expr("l_partkey % 10").alias("locus"), F.expr("md5(concat(l_orderkey, ':', l_partkey))").alias("fingerprint")).agg(F.min("l_orderkey").alias("ordinal"))
    return T.ranked(li, ["sample", "locus"], [F.asc("ordinal"), F.asc("fingerprint")], 40)


def transitions(spark, sf):
    """W19."""
    e = event_hits(spark, sf).withColumn("prev", F.lag("grp").over(Window.partitionBy("sample").orderBy("ts", "event_id")))
    return e.where("prev IS NOT NULL").groupBy("prev", "grp").agg(F.count("*").alias("n"))


def run_statistics(spark, sf):
    """Longest run, runs and windows of each state along a sample, by gaps and islands."""
    e = event_hits(spark, sf)
    w = Window.partitionBy("sample").orderBy("ts", "event_id")
    g = e.withColumn("island", F.row_number().over(w) - F.row_number().over(Window.partitionBy("sample", "grp").orderBy("ts", "event_id")))
    runs = g.groupBy("sample", "grp", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("sample", "grp").agg(F.max("n").alias("longest"), F.count("*").alias("runs"), F.sum("n").alias("windows"))


def runs_test(spark, sf):
    """The Wald-Wolfowitz statistic of two states along a sample, and its call at 1.96."""
    e = event_hits(spark, sf).withColumn("x", F.expr("value >= 50"))
    w = Window.partitionBy("sample").orderBy("ts", "event_id")
    r = e.withColumn("new", F.when(F.lag("x").over(w).isNull() | (F.lag("x").over(w) != F.col("x")), 1).otherwise(0)).groupBy("sample").agg(F.sum("new").cast("double").alias("runs"), F.count_if("x").cast("double").alias("a"), F.count_if(F.expr("NOT x")).cast("double").alias("b"))
    r = r.where("a > 0 AND b > 0 AND a + b > 2").withColumn("mu", F.expr("2 * a * b / (a + b) + 1")).withColumn("var", F.expr("(mu - 1) * (mu - 2) / (a + b - 1)")).where("var > 0")
    return r.select("sample", "runs", F.expr("round((runs - mu) / sqrt(var), 6)").alias("z"), F.expr("CASE WHEN abs((runs - mu) / sqrt(var)) >= 1.96 THEN 'patterned' ELSE 'random' END").alias("call"))


def candidate_pairs(spark, sf):
    """J13."""
    return T.candidate_pairs(B.table(spark, sf, "lineitem").selectExpr("l_orderkey AS k", "l_suppkey AS id"), "k", "id", 6, 3)


def deny_list(spark, sf):
    """J10, S21."""
    deny = B.table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return B.table(spark, sf, "documents").join(deny, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("reads"), F.sum("n_chars").alias("bases"))


def annotated(spark, sf):
    """Defaults where a part of the annotation is missing."""
    d = B.table(spark, sf, "documents").select("doc_id", "source").join(B.table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("source", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic")).agg(F.count("*").alias("n"))


def coverage_check(spark, sf):
    """What either side lacks of the other."""
    d, la = B.table(spark, sf, "documents").select("doc_id"), B.table(spark, sf, "labels").select("doc_id").distinct()
    return d.join(la, "doc_id", "left_anti").withColumn("missing", F.lit("label")).unionByName(la.join(d, "doc_id", "left_anti").withColumn("missing", F.lit("document"))).groupBy("missing").agg(F.count("*").alias("n"))


def table_difference(spark, sf):
    """Orders with their status, and with urgent ones taken as finished."""
    o = B.table(spark, sf, "orders")
    finished = o.selectExpr("o_custkey", "CASE WHEN o_orderpriority = '1-URGENT' THEN 'F' ELSE o_orderstatus END AS o_orderstatus")
    return T.equal_trees(o.select("o_custkey", "o_orderstatus"), finished).groupBy("only_in", "o_orderstatus").agg(F.count("*").alias("n"))


def equivalence_classes(spark, sf):
    """Copies by key, numbered by key."""
    d = B.table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("key")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    return d.where("copies > 1").select("first", "copies", F.dense_rank().over(Window.partitionBy("copies").orderBy("first")).alias("number"))


def keyed_upsert(spark, sf):
    """New values where there are any, else the old."""
    old = B.table(spark, sf, "customer").selectExpr("c_custkey AS k", "c_acctbal AS v")
    new = B.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("w"))
    return old.join(new, "k", "full").select("k", F.coalesce("w", "v").alias("v"))


def best_by_keys(spark, sf):
    """The best row of each locus by several keys."""
    m = measures(spark, sf)
    return m.groupBy("locus").agg(F.max_by(F.struct("sample", "support"), F.struct("reads", "support", -F.col("sample"))).alias("b")).select("locus", "b.sample", "b.support")


def reference_contribution(spark, sf):
    """Each sample's share of the cohort's chosen loci."""
    b = best_by_keys(spark, sf).groupBy("sample").agg(F.count("*").alias("loci"))
    return b.crossJoin(F.broadcast(b.agg(F.sum("loci").alias("n")))).select("sample", "loci", F.round(F.col("loci") / F.col("n"), 6).alias("share"))


def best_k(spark, sf):
    """The K of the least error."""
    e = B.table(spark, sf, "events").groupBy(F.expr("cast(event_id % 5 + 2 AS int)").alias("k"), F.col("event_type").alias("run")).agg(F.round(F.avg("value"), 6).alias("error"))
    return e.groupBy("run").agg(F.min_by("k", F.struct("error", "k")).alias("k"), F.min("error").alias("error"))


M = f"m AS (SELECT * FROM {B.MEASURES})"
EV = f"e AS (SELECT * FROM {EVENT_HITS})"
AUDIT = f"{EV}, s AS (SELECT sample, fragment, list(DISTINCT grp) AS g FROM e GROUP BY ALL), x AS (SELECT sample, len(g) AS n, unnest(g) AS grp FROM s), a AS (SELECT sample, grp, count(*) FILTER (WHERE n = 1) AS specific, count(*) FILTER (WHERE n > 1) AS ambiguous FROM x GROUP BY ALL), st AS (SELECT *, CASE WHEN specific + ambiguous < 10 THEN 'NA' WHEN specific >= 3 AND specific / (specific + ambiguous) >= 0.02 THEN 'PRESENT' WHEN specific = 0 THEN 'ABSENT' ELSE 'NA' END AS state FROM a)"
REASONS = "concat_ws(';', CASE WHEN reads < 2 THEN 'few_reads' END, CASE WHEN support < 10 THEN 'low_support' END, CASE WHEN length < 5000 THEN 'too_short' END, CASE WHEN hi - lo > 0.05 THEN 'unbalanced' END, CASE WHEN lo = 0 THEN 'no_span' END)"
BEST = f"{M}, b AS (SELECT locus, sample, support FROM (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY reads DESC, support DESC, sample) AS r FROM m) WHERE r = 1)"

QUERIES = {
    "sample_stats": (sample_stats, f"WITH {M} SELECT sample, count(*) AS loci, count(*) FILTER (WHERE status = 'F') AS success, count(*) FILTER (WHERE support >= 12.5) AS ge_25, count(*) FILTER (WHERE support >= 25) AS ge_50, count(*) FILTER (WHERE support >= 37.5) AS ge_75, count(*) FILTER (WHERE support >= 75) AS ge_150, round(avg(support), 6) AS mean, round(median(support), 6) AS median FROM m GROUP BY sample"),
    "locus_stats": (locus_stats, f"WITH {M} SELECT locus, count(*) FILTER (WHERE status = 'F') AS success, count(*) AS rows, round(avg(length), 6) AS mean_length, round(count(*) FILTER (WHERE status = 'F') / (SELECT count(*) FROM supplier), 6) AS occupancy FROM m GROUP BY locus"),
    "support_matrix": (support_matrix, "SELECT c_nationkey AS nation, " + ", ".join(f"round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '{p}'), 2) AS p{i + 1}" for i, p in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))) + " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "densify": (densify, "SELECT n_nationkey AS sample, s.c_mktsegment AS locus, count(c.c_custkey) AS n FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s LEFT JOIN customer c ON c.c_nationkey = n_nationkey AND c.c_mktsegment = s.c_mktsegment AND c.c_acctbal < 0 GROUP BY ALL"),
    "pair_audit": (pair_audit, f"WITH {AUDIT} SELECT * FROM st"),
    "divergence_histogram": (divergence_histogram, "SELECT CAST(least(floor((1 - (1 - l_discount) * (1 - l_tax)) * 100 + 0.5), 20) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1"),
    "taxon_matrix": (taxon_matrix, f"WITH {AUDIT} SELECT sample % 5 AS taxon, grp, count(*) AS callable, count(*) FILTER (WHERE state = 'PRESENT') AS present, list_sort(list(specific))[count(*) // 2 + 1] AS upper_median, CASE WHEN count(*) FILTER (WHERE state = 'PRESENT') * 2 >= count(*) THEN 'PRESENT' ELSE 'ABSENT' END AS state FROM st WHERE state <> 'NA' GROUP BY 1, 2"),
    "group_compare": (group_compare, f"WITH {EV} SELECT grp, count(DISTINCT sample) AS samples, array_to_string(list_sort(list(DISTINCT sample % 5)), ',') AS taxa, count(*) AS hits, CASE WHEN count(DISTINCT sample) > 1 THEN 'shared' ELSE 'private' END AS shared FROM e GROUP BY grp"),
    "fractional_support": (fractional_support, f"WITH {EV}, d AS (SELECT DISTINCT sample, fragment, grp FROM e), n AS (SELECT *, count(*) OVER (PARTITION BY sample, fragment) AS n FROM d) SELECT sample, grp, count(*) AS hits, round(sum(1 / n), 6) AS fraction, count(*) FILTER (WHERE n = 1) AS singletons FROM n GROUP BY ALL"),
    "abundance_rpm": (abundance_rpm, f"WITH {EV}, g AS (SELECT sample, grp, count(*) AS n, avg(value) AS mean FROM e GROUP BY ALL) SELECT sample, grp, n, round(n * 1e6 / sum(n) OVER (PARTITION BY sample), 6) AS rpm, round(mean, 6) AS mean FROM g"),
    "linkage": (linkage, f"WITH {EV}, t AS (SELECT *, lead(grp) OVER (PARTITION BY sample ORDER BY ts, event_id) AS nxt FROM e) SELECT least(grp, nxt) AS a, greatest(grp, nxt) AS b, count(*) AS transitions, count(DISTINCT fragment) AS bridges, round(ln(count(DISTINCT fragment) + 1) + ln(count(*) + 1), 6) AS score FROM t WHERE nxt IS NOT NULL AND nxt <> grp GROUP BY 1, 2"),
    "interval_support": (interval_support, """WITH i AS (SELECT l_partkey % 500 AS locus, l_suppkey * 7 % 900 AS a, CAST(l_suppkey * 7 % 900 + l_quantity AS BIGINT) AS b FROM lineitem),
        p AS (SELECT DISTINCT locus, unnest(range(a, b)) AS x FROM i), g AS (SELECT locus, x, x - lag(x, 1, -1) OVER (PARTITION BY locus ORDER BY x) - 1 AS gap FROM p),
        t AS (SELECT DISTINCT locus, a FROM i UNION SELECT DISTINCT locus, b FROM i), n AS (SELECT locus, count(*) AS islands FROM (SELECT locus, x FROM g WHERE gap > 0 OR x = 0) GROUP BY locus)
        SELECT locus, count(*) AS supported, greatest(max(gap), 999 - max(x)) AS max_gap, any_value(islands) AS islands, round(count(*) / 1000, 6) AS breadth FROM g JOIN n USING (locus) GROUP BY locus"""),
    "depth_statistics": (depth_statistics, """WITH d AS (SELECT l_partkey % 300 AS locus, list_sort(list(l_quantity)) AS v, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS sd, median(l_quantity) AS median FROM lineitem GROUP BY 1),
        q AS (SELECT *, CASE WHEN len(v) = 1 THEN v[1] ELSE list_median(v[1:len(v) // 2]) END AS q1, CASE WHEN len(v) = 1 THEN v[1] ELSE list_median(v[len(v) - len(v) // 2 + 1:]) END AS q3 FROM d)
        SELECT locus, median, q1, q3, v[len(v) // 2 + 1] AS upper_median, q3 + 1.5 * (q3 - q1) AS cap, round(sd / mean, 6) AS cv, round(v[len(v)] / median, 6) AS peak, CAST(floor(median * 100 / (list_median(list_transform(v, lambda x: abs(x - median))) + 1)) AS BIGINT) AS stability FROM q"""),
    "rejection_reasons": (rejection_reasons, f"WITH {M}, r AS (SELECT *, {REASONS} AS reasons FROM m) SELECT reasons, CASE WHEN locus % 7 = 0 THEN true WHEN locus % 7 = 1 THEN false ELSE status = 'F' AND reasons = '' END AS ok, count(*) AS n FROM r GROUP BY 1, 2"),
    "status_ladders": (status_ladders, f"WITH {M} SELECT CASE WHEN lo < 0.01 THEN 'low_complexity' WHEN support >= 60 AND hi >= 0.05 THEN 'keep' WHEN support >= 30 THEN 'review' ELSE 'drop' END AS curation, CASE WHEN hi >= 0.08 THEN 'high' WHEN hi > 0 THEN 'partial' ELSE 'none' END AS evidence, CASE WHEN reads = 0 THEN 'no_core' WHEN support < 10 THEN 'low_coverage' WHEN lo > 0.08 THEN 'complex' WHEN length < 10000 THEN 'short' WHEN reads < 2 THEN 'low_sample_support' ELSE 'pass' END AS panref, CASE WHEN reads = 1 THEN 'single' ELSE 'multi' END AS copies, count(*) AS n FROM m GROUP BY 1, 2, 3, 4"),
    "rescue_rollback": (rescue_rollback, """WITH b AS (SELECT o_custkey AS locus, sum(o_totalprice) AS d, max(o_orderstatus) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), a AS (SELECT o_custkey AS locus, sum(o_totalprice) AS d, max(o_orderstatus) AS s FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1),
        x AS (SELECT coalesce(b.locus, a.locus) AS locus, b.d AS db, a.d AS da, a.d IS NULL OR (b.d IS NOT NULL AND (b.s = 'P' AND a.s <> 'P' OR a.d / b.d < 0.5)) AS back FROM b FULL JOIN a ON a.locus = b.locus)
        SELECT locus, CASE WHEN back THEN 'before' ELSE 'after' END AS kept, round(coalesce(CASE WHEN back THEN db ELSE da END, 0), 2) AS density FROM x"""),
    "terminal_quota": (terminal_quota, "WITH l AS (SELECT l_partkey % 50 AS locus, l_returnflag AS side, l_orderkey AS id, max(l_linenumber) AS ext, count(DISTINCT l_suppkey) AS loci, sum(l_quantity) AS exact FROM lineitem GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY locus, side, ext ORDER BY loci, exact DESC, id) AS e FROM l) SELECT locus, side, id, ext, rank FROM (SELECT *, row_number() OVER (PARTITION BY locus, side ORDER BY ext DESC, loci, exact DESC, id) AS rank FROM f WHERE e <= 4) WHERE rank <= 12"),
    "bin_quota": (bin_quota, "WITH l AS (SELECT l_partkey % 50 AS locus, l_orderkey AS id, min(l_suppkey % 64) AS bin, sum(l_quantity) AS exact, count(DISTINCT l_partkey) AS loci FROM lineitem GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY locus, bin ORDER BY exact DESC, loci, id) AS e FROM l) SELECT locus, id, bin, rank, CASE WHEN e <= 2 THEN 1 ELSE 2 END AS pass FROM (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY e > 2, exact DESC, loci, id) AS rank FROM f) WHERE rank <= 60"),
    "adaptive_target": (adaptive_target, """WITH a AS (SELECT l_partkey % 40 AS locus, count(*) AS n, sum(l_quantity) AS bases, max(5000.0::DOUBLE / (1 + l_partkey % 40)) AS length, count(DISTINCT l_orderkey % 64) AS covered FROM lineitem GROUP BY 1),
        b AS (SELECT *, n < 512 OR bases / length <= 160 OR covered < 48 AS pass_through FROM a) SELECT locus, n, CAST(covered AS INTEGER) AS covered, round(bases / length, 6) AS depth, pass_through, CAST(CASE WHEN pass_through THEN n ELSE least(greatest(ceil(80 * length / (bases / n)), 512, ceil(n * 0.6)), n) END AS BIGINT) AS target FROM b"""),
    "depth_threshold": (depth_threshold, "WITH h AS (SELECT l_suppkey % 100 AS locus, CAST(l_quantity AS INTEGER) AS k, sum(l_linenumber) AS w FROM lineitem GROUP BY ALL), s AS (SELECT *, sum(w) OVER (PARTITION BY locus ORDER BY k DESC) AS above FROM h) SELECT locus, max(k) AS longest, min(k) FILTER (WHERE above <= 500) AS threshold, CAST(sum(w) AS BIGINT) AS weight FROM s GROUP BY locus"),
    "hash_sample": (hash_sample, "SELECT sample, id, rank FROM (SELECT o_orderpriority AS sample, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rank FROM orders) WHERE rank <= 50"),
    "systematic_thinning": (systematic_thinning, "SELECT sample, id FROM (SELECT o_orderpriority AS sample, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r % 7 = 0"),
    "even_sample": (even_sample, "SELECT sample, id FROM (SELECT o_orderpriority AS sample, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE n <= 40 OR r = 0 OR (r * 40) // n <> ((r - 1) * 40) // n"),
    "first_reads": (first_reads, "SELECT o_orderkey AS id, o_custkey AS sample FROM orders WHERE o_orderkey < 1000"),
    "capped_groups": (capped_groups, "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample, locus ORDER BY ordinal, fingerprint) AS rank FROM (SELECT l_suppkey % 10 AS sample, l_partkey % 10 AS locus, md5(l_orderkey || ':' || l_partkey) AS fingerprint, min(l_orderkey) AS ordinal FROM lineitem GROUP BY ALL)) WHERE rank <= 40"),
    "transitions": (transitions, f"WITH {EV} SELECT prev, grp, count(*) AS n FROM (SELECT *, lag(grp) OVER (PARTITION BY sample ORDER BY ts, event_id) AS prev FROM e) WHERE prev IS NOT NULL GROUP BY ALL"),
    "run_statistics": (run_statistics, f"WITH {EV}, g AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY ts, event_id) - row_number() OVER (PARTITION BY sample, grp ORDER BY ts, event_id) AS i FROM e), r AS (SELECT sample, grp, count(*) AS n FROM g GROUP BY sample, grp, i) SELECT sample, grp, max(n) AS longest, count(*) AS runs, CAST(sum(n) AS BIGINT) AS windows FROM r GROUP BY ALL"),
    "runs_test": (runs_test, f"""WITH {EV}, x AS (SELECT *, value >= 50 AS x, lag(value >= 50) OVER (PARTITION BY sample ORDER BY ts, event_id) AS p FROM e), r AS (SELECT sample, CAST(count(*) FILTER (WHERE p IS NULL OR p <> x) AS DOUBLE) AS runs, CAST(count(*) FILTER (WHERE x) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE NOT x) AS DOUBLE) AS b FROM x GROUP BY sample),
        v AS (SELECT *, 2 * a * b / (a + b) + 1 AS mu FROM r WHERE a > 0 AND b > 0 AND a + b > 2), w AS (SELECT *, (mu - 1) * (mu - 2) / (a + b - 1) AS var FROM v) SELECT sample, runs, round((runs - mu) / sqrt(var), 6) AS z, CASE WHEN abs((runs - mu) / sqrt(var)) >= 1.96 THEN 'patterned' ELSE 'random' END AS call FROM w WHERE var > 0"""),
    "candidate_pairs": (candidate_pairs, "WITH d AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS id FROM lineitem), c AS (SELECT * FROM d WHERE k IN (SELECT k FROM d GROUP BY k HAVING count(*) <= 6)) SELECT x.id AS a, y.id AS b, count(*) AS shared FROM c x JOIN c y ON x.k = y.k AND x.id < y.id GROUP BY ALL HAVING count(*) >= 3"),
    "deny_list": (deny_list, "SELECT source, count(*) AS reads, CAST(sum(n_chars) AS BIGINT) AS bases FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source"),
    "annotated": (annotated, "SELECT source, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL"),
    "coverage_check": (coverage_check, "SELECT 'label' AS missing, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) HAVING count(*) > 0 UNION ALL SELECT 'document', count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) HAVING count(*) > 0"),
    "table_difference": (table_difference, "WITH a AS (SELECT o_custkey, o_orderstatus FROM orders), b AS (SELECT o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders) SELECT 'a' AS only_in, o_orderstatus, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL UNION ALL SELECT 'b', o_orderstatus, count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL"),
    "equivalence_classes": (equivalence_classes, "SELECT first, copies, dense_rank() OVER (PARTITION BY copies ORDER BY first) AS number FROM (SELECT min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY sha256(text) HAVING count(*) > 1)"),
    "keyed_upsert": (keyed_upsert, "SELECT coalesce(c_custkey, k) AS k, coalesce(w, c_acctbal) AS v FROM customer FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) AS w FROM orders GROUP BY 1) ON c_custkey = k"),
    "best_by_keys": (best_by_keys, f"WITH {BEST} SELECT * FROM b"),
    "reference_contribution": (reference_contribution, f"WITH {BEST} SELECT sample, count(*) AS loci, round(count(*) / (SELECT count(*) FROM b), 6) AS share FROM b GROUP BY sample"),
    "best_k": (best_k, "WITH e AS (SELECT CAST(event_id % 5 + 2 AS INTEGER) AS k, event_type AS run, round(avg(value), 6) AS error FROM events GROUP BY ALL) SELECT run, k, error FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY error, k) AS r FROM e) WHERE r = 1"),
}
