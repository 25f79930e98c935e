"""Queries over sequences, genotypes, alignments and graphs made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import alignment as A
from ..operators import graphs as G
from ..operators import places as P
from ..operators import recruitment as R
from ..operators import tables as T
from ..operators import variants as V
from . import bridges as B


def genotypes(spark, sf):
    return B.view(spark, sf, "lineitem").sql(f"SELECT * FROM {B.GENOTYPES}")


def masked_genotypes(spark, sf):
    return V.masked_genotypes(genotypes(spark, sf)).groupBy("gt").agg(F.count("*").alias("n"))


def site_statistics(spark, sf):
    return V.site_statistics(V.masked_genotypes(genotypes(spark, sf)))


def site_filter(spark, sf):
    return V.passing_sites(V.site_statistics(V.masked_genotypes(genotypes(spark, sf))), qual=1, missing=0.6, least_ac=1)


def one_snp_per_locus(spark, sf):
    return V.one_per_locus(V.site_statistics(V.masked_genotypes(genotypes(spark, sf))).withColumn("locus", F.expr("site % 100")), "locus").select("locus", "site", "call_rate")


def variant_counts(spark, sf):
    """How many sites are left after each stage."""
    sites = V.site_statistics(V.masked_genotypes(genotypes(spark, sf)))
    stages = (("all", "true"), ("called", "an > 0"), ("quality", "an > 0 AND qual >= 1"), ("alleles", "an > 0 AND qual >= 1 AND ac >= 1 AND an - ac >= 1"))
    return sites.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in stages]).select(F.expr("stack(4, " + ", ".join(f"'{n}', `{n}`" for n, _ in stages) + ") AS (stage, n)"))


def alignments(spark, sf):
    """Loci as references, their shifted copies as aligned reads with one insertion or deletion."""
    li = B.dealt(B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).selectExpr("l_orderkey AS qname", "l_linenumber AS n", "l_partkey % 20 AS ref", "cast(l_suppkey % 50 + 1 AS int) AS pos", "l_partkey AS p", "cast(l_quantity AS int) AS q")
    cigar = "CASE WHEN q % 3 = 0 THEN concat(q + 5, 'M') WHEN q % 3 = 1 THEN concat(q, 'M2I5M') ELSE concat('3S', q, 'M4D', 5, 'M') END"
    return li.selectExpr("qname", "cast(CASE WHEN q = 7 THEN 256 ELSE 0 END AS int) AS flag", "ref", "pos", f"{cigar} AS cigar", "substring(repeat(translate(md5(cast(p % 7 AS string)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 3), 1, 60) AS seq")


ALIGNED = """(SELECT *, CASE WHEN q % 3 = 0 THEN (q + 5) || 'M' WHEN q % 3 = 1 THEN q || 'M2I5M' ELSE '3S' || q || 'M4D5M' END AS cigar FROM (SELECT l_orderkey AS qname, CAST(CASE WHEN CAST(l_quantity AS INT) = 7 THEN 256 ELSE 0 END AS INT) AS flag, l_partkey % 20 AS ref, CAST(l_suppkey % 50 + 1 AS INT) AS pos, CAST(l_quantity AS INT) AS q,
  substr(repeat(translate(md5(CAST(l_partkey % 7 AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 3), 1, 60) AS seq FROM lineitem) WHERE flag & 2308 = 0)"""
#: DuckDB: the aligned places by kind of read, one union branch for each operation.
PLACES = f"""al AS (SELECT * FROM {ALIGNED}), pl AS (
  SELECT ref, pos + i AS pos, substr(seq, CAST(1 + i + CASE WHEN q % 3 = 2 THEN 3 ELSE 0 END AS BIGINT), 1) AS base FROM (SELECT *, unnest(range(0, CASE WHEN q % 3 = 0 THEN q + 5 ELSE q END)) AS i FROM al)
  UNION ALL SELECT ref, pos + q + i, substr(seq, CAST(1 + q + 2 + i AS BIGINT), 1) FROM (SELECT *, unnest(range(0, 5)) AS i FROM al WHERE q % 3 = 1)
  UNION ALL SELECT ref, pos + q + i, '-' FROM (SELECT *, unnest(range(0, 4)) AS i FROM al WHERE q % 3 = 2)
  UNION ALL SELECT ref, pos + q + 4 + i, substr(seq, CAST(1 + 3 + q + i AS BIGINT), 1) FROM (SELECT *, unnest(range(0, 5)) AS i FROM al WHERE q % 3 = 2))"""


def pileup(spark, sf):
    return V.pileup(P.base_counts(alignments(spark, sf)))


def consensus(spark, sf):
    return V.consensus_calls(P.base_counts(alignments(spark, sf)), 0.6)


def consensus_thresholds(spark, sf):
    """The calls at several thresholds, counted by code."""
    bases = P.base_counts(alignments(spark, sf))
    out = None
    for t in (0.25, 0.5, 0.75):
        c = V.consensus_calls(bases, t).groupBy("call").agg(F.count("*").alias("n")).withColumn("threshold", F.lit(t))
        out = c if out is None else out.unionByName(c)
    return out


def insertions(spark, sf):
    return V.insertion_columns(V.inserted_motifs(alignments(spark, sf)))


def mapping_qc(spark, sf):
    """Mean depth, weighted, and breadth."""
    p = V.pileup(P.base_counts(alignments(spark, sf)))
    return p.groupBy("ref").agg(F.count("*").alias("covered"), F.round(F.avg("depth"), 6).alias("mean_depth"), F.round(F.sum(F.col("depth") * F.col("depth")) / F.sum("depth"), 6).alias("weighted_depth"))


def column_reads(spark, sf):
    return B.table(spark, sf, "lineitem").selectExpr("l_partkey % 30 AS locus", "l_orderkey * 10 + l_linenumber AS id", "substring(translate(md5(cast(l_suppkey % 9 AS string)), '0123456789abcdef', 'ACGTACGTACGTAC-N'), 1, 12) AS seq").groupBy("locus", "id").agg(F.min("seq").alias("seq"))


COLUMNS = "(SELECT l_partkey % 30 AS locus, l_orderkey * 10 + l_linenumber AS id, min(substr(translate(md5(CAST(l_suppkey % 9 AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTAC-N'), 1, 12)) AS seq FROM lineitem GROUP BY 1, 2)"


def plurality(spark, sf):
    return V.plurality_consensus(column_reads(spark, sf), ["locus"])


def occupancy(spark, sf):
    return V.column_occupancy(column_reads(spark, sf), ["locus"])


def pair_identity(spark, sf):
    rows = B.table(spark, sf, "supplier").selectExpr("s_nationkey AS locus", "s_suppkey AS id", "substring(translate(md5(cast(s_suppkey AS string)), '0123456789abcdef', 'AACCGGTTACGTAC-N'), 1, 30) AS seq")
    return V.pair_identities(rows, ["locus"])


def concatenation(spark, sf):
    """Sequences of samples and loci from all line items; a third of them is missing."""
    seq = "CASE WHEN min(l_orderkey) % 3 > 0 THEN substring(translate(md5(cast(min(l_orderkey) AS string)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, cast(5 + locus AS int)) END"
    li = B.table(spark, sf, "lineitem").groupBy(F.expr("l_suppkey % 25").alias("sample"), F.expr("l_partkey % 12").alias("locus")).agg(F.expr(seq).alias("seq"))
    loci = spark.range(12).selectExpr("id AS locus", "cast(5 + id AS int) AS width")
    return T.concatenated(li, B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("sample")), loci)


def sequence_functions(spark, sf):
    """F1, F3, F5, F7, F10, F14, F16, F17, F18, F21, F22, F32, F33, F35 over the loci; codes are of tiles of 20 bases, the most of a number."""
    s = B.loci(spark, sf).where("seq <> ''")
    tile = "substring(seq, p, 20)"
    tiles = lambda body: f"transform(sequence(1, length(seq), 20), p -> {body})"
    gapped = f"concat(left({S.protein('seq')}, 3), '-', substring({S.protein('seq')}, 4))"
    return s.selectExpr(
        "locus", f"{S.reverse_complement('seq')} AS rc", f"{S.canonical('seq')} AS canonical", f"array_join({tiles(f'cast({S.two_bit(tile)} AS string)')}, ',') AS code", f"array_join({tiles(S.let(S.two_bit(tile), 'n', S.from_two_bit('n', 'least(20, length(seq) - p + 1)')))}, '') AS decoded",
        f"array_join({S.bottom_sketch('seq', 15, 4)}, ',') AS sketch", f"{S.canonical_motif('seq')} AS motif", f"round({S.pair_entropy('seq')}, 6) AS entropy", f"round({S.inverted_repeat_identity('seq')}, 6) AS inverted", f"round({S.diagonal('seq', S.reverse_complement('seq'), '7')}, 6) AS diagonal",
        f"{S.protein('seq')} AS protein", f"{S.back_translated(gapped, 'seq')} AS codons", "sha2(seq, 256) AS sha", f"{S.circular_slice('seq', '-3', '8')} AS circular", f"{S.short_number('length(seq) / 7')} AS number", f"{S.central_slice('seq', '11')} AS central",
    )


def text_functions(spark, sf):
    """F6, F20, F23, F24, F30, F31 and identifiers of mates (S5) over names and codes."""
    p = B.table(spark, sf, "part").selectExpr("p_partkey", "concat(translate(substring(md5(p_name), 1, 8), '0123456789abcdef', 'ACGTACGTNNNNACGT'), CASE WHEN p_partkey % 2 = 0 THEN 'NNN-N' ELSE '' END, translate(substring(md5(p_name), 9, 8), '0123456789abcdef', 'ACGTACGTACGTACGT')) AS s", "p_name")
    return p.selectExpr("p_partkey", f"{S.arms('s')}.left AS left_arm", f"{S.arms('s')}.right AS right_arm", f"array_join({S.valid_runs('s')}, ',') AS runs", f"{S.overhang_trimmed('s', 'A', 5)} AS trimmed", f"{S.safe_name('p_name')} AS safe", "regexp_replace(concat('r', p_partkey, '/1 x'), '(/[12])?([ ].*)?$', '') AS read_name")


def motif_periods(spark, sf):
    """F13, F15."""
    return B.table(spark, sf, "part").selectExpr("p_partkey", "concat(repeat(translate(substring(md5(p_name), 1, cast(p_partkey % 5 + 2 AS int)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 4), 'A') AS s").selectExpr("p_partkey", f"{S.period('s')} AS period")


def sketch_pairs(spark, sf):
    """Pairs of loci by the Jaccard index of their minimizers."""
    sk = B.loci(spark, sf).selectExpr("locus", f"{S.minimizers('seq', 7, 5)} AS m")
    a, b = sk.toDF("a", "x"), sk.toDF("b", "y")
    keys = lambda d, i, c: d.select(i, F.explode(c).alias("k"))
    near = keys(a, "a", "x").join(keys(b, "b", "y"), "k").where("a < b").select("a", "b").distinct()
    return near.join(a, "a").join(b, "b").select("a", "b", F.expr(f"round({S.jaccard('x', 'y')}, 6)").alias("jaccard"))


def edit_pairs(spark, sf):
    """suppliers of one nation within a bounded edit distance of their keys' digests."""
    s = B.table(spark, sf, "supplier").selectExpr("s_nationkey AS g", "s_suppkey AS id", "left(md5(cast(s_suppkey AS string)), 6) AS t")
    return T.spread_pairs(s.toDF("g", "a", "x"), s.toDF("g", "b", "y"), ["g"], "a").where("a < b").selectExpr("g", "a", "b", "levenshtein(x, y, 4) AS d").where("d >= 0")


def kmer_depths(spark, sf):
    """The most frequent k-mers, ties by k-mer."""
    return G.solid_kmers(B.reads(spark, sf), 9, 1).orderBy(F.desc("depth"), "kmer").limit(2000)


def branching(spark, sf):
    """Edges at branches of the graph of loci."""
    k = 11
    solid = G.solid_kmers(B.loci(spark, sf).withColumnRenamed("locus", "read_id"), k, 1)
    return G.branch_edges(solid, k).select("a", "b", "depth_a", "depth_b")


def unitig_table(spark, sf):
    """Unitigs of each locus's graph."""
    km = S.kmers(B.loci(spark, sf), 13).select("locus", "kmer").distinct()
    return G.unitigs(km, ["locus"])


def component_table(spark, sf):
    """Orders linked to one of the next two, as components. Dealt by ranges, most links are settled within the first tasks."""
    e = B.table(spark, sf, "lineitem").selectExpr("l_orderkey AS a", "l_orderkey + 1 + l_suppkey % 2 AS b")
    return G.components(e.repartitionByRange("a"))


def bridge_table(spark, sf):
    """Edges without which a nation's customer graph falls apart."""
    e = B.table(spark, sf, "customer").selectExpr("c_nationkey AS locus", "c_custkey % 17 AS a", "(c_custkey * 7 + c_nationkey) % 19 + 3 AS b").where("a <> b").select("locus", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return G.bridge_edges(e, ["locus"])


def backbone_table(spark, sf):
    """The heaviest path of each nation's order graph, with its coordinates."""
    c = B.table(spark, sf, "customer").selectExpr("c_nationkey AS locus", "c_custkey % 23 AS a", "(c_custkey * 5) % 23 AS b", "c_acctbal")
    nodes = c.groupBy("locus", F.col("a").alias("node")).agg(F.count("*").alias("weight"))
    edges = c.where("a < b").select("locus", "a", "b").distinct().join(nodes.selectExpr("locus", "node AS b"), ["locus", "b"]).select("locus", "a", "b")
    path = G.backbones(nodes, edges, "locus").join(nodes, ["locus", "node"])
    end = F.expr("sum(weight) OVER (PARTITION BY locus ORDER BY ord)")
    return path.select("locus", "ord", "node", (end - F.col("weight")).alias("start"), end.alias("end"))


def contig_table(spark, sf):
    """Reads recruited to each locus, assembled from its k-mers. Only recruited reads are cut into all their k-mers."""
    k = 21
    loci = B.loci(spark, sf)
    reads = B.reads(spark, sf).select("read_id", "seq")
    found = G.written(R.hits(reads, loci, k).select("read_id", "locus"))
    depth = G.recruited_depths(reads, found, k)
    ref = S.kmers(loci, k).select("locus", "pos", "kmer")
    near = depth.join(ref.select("locus", "kmer").distinct().withColumn("r", F.lit(1)), ["locus", "kmer"], "left").where("depth >= 2 OR r = 1").select("locus", "kmer", "depth")  # P5
    return G.contigs(near, ref, "locus")


def locus_pairs(spark, sf):
    """Ordered pairs of loci that share a window of 9 bases, whole."""
    s = B.loci(spark, sf)
    own = S.kmers(s, 9).select("locus", "kmer").distinct()
    near = own.join(own.withColumnRenamed("locus", "other"), "kmer").where("locus <> other").select("locus", "other").distinct()
    return near.join(s.withColumnRenamed("seq", "a_seq"), "locus").join(s.selectExpr("locus AS other", "seq AS b_seq"), "other")


def alignment_scores(spark, sf):
    """Every two loci that share a window of 9 bases."""
    pairs = locus_pairs(spark, sf).where("locus < other").selectExpr("locus AS a", "other AS b", "a_seq", "b_seq").repartition(spark.sparkContext.defaultParallelism)
    out = A.scored_pairs(pairs, "local").withColumnRenamed("score", "local_score")
    out = A.scored_pairs(out, "family").withColumnRenamed("score", "family_score")
    return A.scored_pairs(out, "banded").withColumnRenamed("score", "banded_score").drop("a_seq", "b_seq")


def best_foreign(spark, sf):
    """Each locus's score against itself and the best against another locus, ties to the smallest; null where no other shares a window of 9 bases."""
    pairs = locus_pairs(spark, sf).repartition(spark.sparkContext.defaultParallelism)
    best = A.scored_pairs(pairs, "local").groupBy("locus").agg(F.max(F.struct("score", (-F.col("other")).alias("o"))).alias("b")).select("locus", (-F.col("b.o")).alias("foreign_locus"), F.col("b.score").alias("foreign_score"))
    return B.loci(spark, sf).selectExpr("locus", "cast(2 * length(seq) AS long) AS own_score").join(best, "locus", "left")


def seed_offsets(spark, sf):
    """The offsets at which a document's k-mers most often meet a locus."""
    there = S.kmers(B.loci(spark, sf), 15).withColumnRenamed("pos", "at")
    here = R.matching_kmers(B.reads(spark, sf), there, B.loci(spark, sf), 15, ("read_id",))
    return A.best_offsets(here.join(R.sized(there, B.loci(spark, sf)), "kmer").selectExpr("read_id", "locus", "pos - at AS offset"), ["read_id", "locus"], 3)


def merged_hsps(spark, sf):
    """D9."""
    li = B.table(spark, sf, "lineitem").selectExpr("l_partkey % 100 AS query", "l_suppkey % 10 AS subject", "cast(l_quantity * 10 AS long) AS qstart", "cast(l_quantity * 10 + l_linenumber * 7 - 20 AS long) AS qend")
    return A.merged_hsps(li)


def em_abundance(spark, sf):
    """A30, X20."""
    classes = B.table(spark, sf, "events").groupBy(F.expr("event_id div 4").alias("f")).agg(F.array_sort(F.collect_set("event_type")).alias("targets")).groupBy("targets").agg(F.count("*").alias("n"))
    return A.abundance(classes)


def bootstrap(spark, sf):
    """A16."""
    t = B.table(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.expr("value >= 50")).alias("hits"), F.count("*").alias("total"))
    return A.bootstrap_interval(t, ["event_type"], "hits", "total")


def core_gate(spark, sf):
    """Pairs of which a mate without ambiguous bases touches a k-mer of at least two loci's core."""
    core = S.kmers(B.loci(spark, sf), 9).groupBy("kmer").agg(F.countDistinct("locus").alias("n")).where("n >= 2").select("kmer")
    return S.kmers(B.mates(spark, sf).where("seq RLIKE '^[ACGT]+$'"), 9).join(core, "kmer", "left_semi").groupBy("fragment").agg(F.countDistinct("mate").alias("mates"))


RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
GT = f"""g AS (SELECT site, dp, gq, qual, CASE WHEN dp >= 5 AND gq >= 20 AND gt NOT LIKE '%.%' THEN gt END AS gt FROM {B.GENOTYPES}),
si AS (SELECT site, round(count(gt) / count(*), 6) AS call_rate, median(dp) FILTER (WHERE gt IS NOT NULL) AS median_dp, median(gq) FILTER (WHERE gt IS NOT NULL) AS median_gq, CAST(coalesce(sum(length(gt) - length(replace(gt, '1', ''))), 0) AS BIGINT) AS ac, 2 * count(gt) AS an, max(qual) AS qual FROM g GROUP BY site)"""
IUPAC = "CASE b " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.IUPAC_SETS.items()) + " END"


def _calls(threshold: float) -> str:
    return f"""(SELECT ref, pos, depth, CASE WHEN depth < 2 THEN 'N' WHEN b IS NULL THEN '-' WHEN gap THEN lower({IUPAC}) ELSE {IUPAC} END AS call FROM (
      SELECT ref, pos, max(depth) AS depth, string_agg(base, '' ORDER BY base) FILTER (WHERE base <> '-') AS b, bool_or(base = '-') AS gap FROM (
        SELECT *, CAST(sum(n) OVER (PARTITION BY ref, pos) AS BIGINT) AS depth, coalesce(sum(n) OVER (PARTITION BY ref, pos ORDER BY n DESC GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
          SELECT ref, pos, base, count(*) AS n FROM pl WHERE base <> 'N' GROUP BY ALL)) WHERE before < {threshold} * depth GROUP BY ref, pos))"""


PROTEIN = "CASE c " + " ".join(f"WHEN '{c}' THEN '{a}'" for c, a in S.codons().items()) + " ELSE 'X' END"

QUERIES = {
    "masked_genotypes": (masked_genotypes, f"WITH {GT} SELECT gt, count(*) AS n FROM g GROUP BY gt"),
    "site_statistics": (site_statistics, f"WITH {GT} SELECT * FROM si"),
    "site_filter": (site_filter, f"WITH {GT} SELECT * FROM si WHERE qual >= 1 AND 1 - call_rate <= 0.6 AND ac >= 1 AND an - ac >= 1"),
    "one_snp_per_locus": (one_snp_per_locus, f"WITH {GT}, m AS (SELECT *, site % 100 AS locus, median(median_dp) OVER (PARTITION BY site % 100) AS m FROM si) SELECT locus, site, call_rate FROM (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY call_rate DESC, median_gq DESC NULLS LAST, abs(median_dp - m) ASC NULLS LAST, qual DESC, site) AS r FROM m) WHERE r = 1"),
    "variant_counts": (variant_counts, f"WITH {GT} SELECT 'all' AS stage, count(*) AS n FROM si UNION ALL SELECT 'called', count(*) FROM si WHERE an > 0 UNION ALL SELECT 'quality', count(*) FROM si WHERE an > 0 AND qual >= 1 UNION ALL SELECT 'alleles', count(*) FROM si WHERE an > 0 AND qual >= 1 AND ac >= 1 AND an - ac >= 1"),
    "pileup": (pileup, f"WITH {PLACES} SELECT ref, CAST(pos AS INTEGER) AS pos, " + ", ".join(f"count(*) FILTER (WHERE base = '{b}') AS {n}" for b, n in (("-", "gap"), ("A", "a"), ("C", "c"), ("G", "g"), ("N", "n"), ("T", "t"))) + ", count(*) AS depth FROM pl GROUP BY ref, pos"),
    "consensus": (consensus, f"WITH {PLACES} SELECT ref, CAST(pos AS INTEGER) AS pos, depth, call FROM {_calls(0.6)}"),
    "consensus_thresholds": (consensus_thresholds, f"WITH {PLACES} " + " UNION ALL ".join(f"SELECT call, count(*) AS n, {t} AS threshold FROM {_calls(t)} GROUP BY call" for t in (0.25, 0.5, 0.75))),
    "insertions": (insertions, f"WITH {PLACES} SELECT ref, CAST(pos + q AS INTEGER) AS pos, CAST(c AS INTEGER) AS \"column\", substr(seq, CAST(q + 1 + c AS BIGINT), 1) AS base, count(*) AS n FROM (SELECT *, unnest(range(0, 2)) AS c FROM al WHERE q % 3 = 1) GROUP BY ALL"),
    "mapping_qc": (mapping_qc, f"WITH {PLACES} SELECT ref, count(*) AS covered, round(avg(d), 6) AS mean_depth, round(sum(d * d) / sum(d), 6) AS weighted_depth FROM (SELECT ref, pos, count(*) AS d FROM pl GROUP BY ALL) GROUP BY ref"),
    "plurality": (plurality, f"""WITH r AS (SELECT * FROM {COLUMNS}), c AS (SELECT locus, i, substr(seq, i, 1) AS b, count(*) AS n FROM (SELECT *, unnest(range(1, 13)) AS i FROM r) GROUP BY ALL), l AS (SELECT *, row_number() OVER (PARTITION BY locus, i ORDER BY n DESC, b) AS k, sum(n) OVER (PARTITION BY locus, i) AS t FROM c),
        w AS (SELECT locus, string_agg(b, '' ORDER BY i) AS consensus, bool_and(n * 2 >= t) AS clear FROM l WHERE k = 1 GROUP BY locus), d AS (SELECT locus, consensus, clear, id, CAST(len(list_filter(range(1, 13), lambda x: substr(seq, x, 1) <> substr(consensus, x, 1))) AS INTEGER) AS distance FROM r JOIN w USING (locus))
        SELECT locus, consensus, clear, distance, id AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY distance, id) AS k FROM d) WHERE k = 1"""),
    "occupancy": (occupancy, f"SELECT locus, CAST(i - 1 AS INTEGER) AS i, count(*) AS n, count(*) FILTER (WHERE substr(seq, i, 1) NOT IN ('-', 'N')) AS informative, count(*) FILTER (WHERE substr(seq, i, 1) NOT IN ('-', 'N')) * 2 >= count(*) AS kept FROM (SELECT *, unnest(range(1, 13)) AS i FROM {COLUMNS}) GROUP BY locus, i"),
    "pair_identity": (pair_identity, """WITH r AS (SELECT s_nationkey AS locus, s_suppkey AS id, substr(translate(md5(CAST(s_suppkey AS VARCHAR)), '0123456789abcdef', 'AACCGGTTACGTAC-N'), 1, 30) AS seq FROM supplier), p AS (SELECT x.locus, x.id AS a, y.id AS b, x.seq AS s, y.seq AS t, unnest(range(1, 31)) AS i FROM r x JOIN r y ON x.locus = y.locus AND x.id < y.id),
        c AS (SELECT locus, a, b, count(*) FILTER (WHERE substr(s, i, 1) NOT IN ('-', 'N') AND substr(t, i, 1) NOT IN ('-', 'N')) AS n, count(*) FILTER (WHERE substr(s, i, 1) NOT IN ('-', 'N') AND substr(s, i, 1) = substr(t, i, 1)) AS same FROM p GROUP BY ALL) SELECT *, CASE WHEN n >= 7 THEN round(same / n, 6) END AS identity FROM c"""),
    "concatenation": (concatenation, """WITH l AS (SELECT l_suppkey % 25 AS sample, l_partkey % 12 AS locus, CASE WHEN min(l_orderkey) % 3 > 0 THEN substr(translate(md5(CAST(min(l_orderkey) AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 5 + l_partkey % 12) END AS seq FROM lineitem GROUP BY 1, 2, l_partkey % 12)
        SELECT n_nationkey AS sample, string_agg(coalesce(seq, repeat('-', 5 + w.range)), '' ORDER BY w.range) AS seq FROM nation CROSS JOIN range(12) w LEFT JOIN l ON l.sample = n_nationkey AND l.locus = w.range GROUP BY 1"""),
    "sequence_functions": (sequence_functions, f"""WITH s AS (SELECT locus, seq, length(seq) AS n, {RC.format('seq')} AS rc FROM {B.LOCI} WHERE seq <> ''), p AS (SELECT *, array_to_string(list_transform(range(1, n - 1, 3), lambda i: {PROTEIN.replace('CASE c', 'CASE substr(seq, i, 3)')}), '') AS protein FROM s)
        SELECT locus, rc, least(seq, rc) AS canonical, array_to_string(list_transform(range(1, n + 1, 20), lambda p: CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(seq, p, 20), ''), lambda b: CASE b WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 0 END)), lambda x, b: x * 4 + b) AS BIGINT)), ',') AS code, seq AS decoded,
        array_to_string(list_sort(list_distinct(list_transform(range(1, n - 13), lambda i: least(substr(seq, i, 15), reverse(translate(substr(seq, i, 15), 'ACGT', 'TGCA'))))))[1:4], ',') AS sketch,
        least(list_min(list_transform(range(1, n + 1), lambda i: substr(seq, i) || substr(seq, 1, i - 1))), list_min(list_transform(range(1, n + 1), lambda i: substr(rc, i) || substr(rc, 1, i - 1)))) AS motif,
        round((SELECT -sum(c / t * log2(c / t)) FROM (SELECT count(*)::DOUBLE AS c, sum(count(*)) OVER ()::DOUBLE AS t FROM (SELECT unnest(list_transform(range(1, n), lambda i: substr(seq, i, 2))) AS p) GROUP BY p)), 6) AS entropy,
        round(len(list_filter(range(1, n + 1), lambda i: substr(seq, i, 1) = substr(rc, i, 1))) / n, 6) AS inverted, round(len(list_filter(range(1, n - 6), lambda i: substr(seq, i + 7, 1) = substr(rc, i, 1))) / (n - 7), 6) AS diagonal,
        protein, left(seq, 9) || '---' || substr(seq, 10, 3 * (n // 3) - 9) AS codons, sha256(seq) AS sha, right(seq, 3) || left(seq, 5) AS circular, rtrim(rtrim(printf('%.3f', n / 7), '0'), '.') AS number, substr(seq, (n - 11) // 2 + 1, 11) AS central FROM p"""),
    "text_functions": (text_functions, """WITH p AS (SELECT p_partkey, p_name, translate(substr(md5(p_name), 1, 8), '0123456789abcdef', 'ACGTACGTNNNNACGT') || CASE WHEN p_partkey % 2 = 0 THEN 'NNN-N' ELSE '' END || translate(substr(md5(p_name), 9, 8), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM part)
        SELECT p_partkey, CASE WHEN contains(s, 'NNN') THEN split_part(s, 'NNN', 1) ELSE s END AS left_arm, CASE WHEN contains(s, 'NNN') THEN ltrim(substr(s, instr(s, 'NNN') + 3), 'N-') ELSE '' END AS right_arm, array_to_string(list_filter(regexp_split_to_array(s, '[^ACGT]+'), lambda x: x <> ''), ',') AS runs,
        CASE WHEN starts_with(s, 'A') AND regexp_full_match(substr(s, 2), '[ACGT]+') AND length(s) - 1 >= 5 THEN substr(s, 2) END AS trimmed, regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g') AS safe, 'r' || p_partkey AS read_name FROM p"""),
    "motif_periods": (motif_periods, """WITH p AS (SELECT p_partkey, repeat(translate(substr(md5(p_name), 1, CAST(p_partkey % 5 + 2 AS BIGINT)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 4) || 'A' AS s FROM part) SELECT p_partkey, CAST(list_filter(range(1, length(s) // 2 + 1), lambda p: len(list_filter(range(1, length(s) + 1), lambda i: substr(s, i, 1) = substr(s, (i - 1) % p + 1, 1))) >= 0.85 * length(s))[1] AS INTEGER) AS period FROM p"""),
    "sketch_pairs": (sketch_pairs, f"""WITH c AS (SELECT locus, pos, least(kmer, {RC.format('kmer')}) AS c FROM (SELECT locus, pos, substr(seq, CAST(pos + 1 AS BIGINT), 7) AS kmer FROM (SELECT *, unnest(range(0, length(seq) - 6)) AS pos FROM {B.LOCI}))),
        m AS (SELECT DISTINCT locus, m FROM (SELECT locus, pos, min(c) OVER (PARTITION BY locus ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS m, count(*) OVER (PARTITION BY locus) AS n FROM c) WHERE pos <= greatest(0, n - 5)), n AS (SELECT locus, count(*) AS n FROM m GROUP BY locus)
        SELECT x.locus AS a, y.locus AS b, round(count(*) / (any_value(p.n) + any_value(q.n) - count(*)), 6) AS jaccard FROM m x JOIN m y ON x.m = y.m AND x.locus < y.locus JOIN n p ON p.locus = x.locus JOIN n q ON q.locus = y.locus GROUP BY 1, 2"""),
    "edit_pairs": (edit_pairs, "WITH s AS (SELECT s_nationkey AS g, s_suppkey AS id, left(md5(CAST(s_suppkey AS VARCHAR)), 6) AS t FROM supplier) SELECT x.g, x.id AS a, y.id AS b, CAST(levenshtein(x.t, y.t) AS INTEGER) AS d FROM s x JOIN s y ON x.g = y.g AND x.id < y.id WHERE levenshtein(x.t, y.t) <= 4"),
    "kmer_depths": (kmer_depths, f"WITH k AS (SELECT DISTINCT read_id, substr(seq, CAST(pos + 1 AS BIGINT), 9) AS kmer FROM (SELECT *, unnest(range(0, length(seq) - 8)) AS pos FROM {B.READS})) SELECT kmer, count(*) AS depth FROM (SELECT read_id, kmer FROM k UNION SELECT read_id, {RC.format('kmer')} FROM k) GROUP BY kmer ORDER BY depth DESC, kmer LIMIT 2000"),
    "branching": (branching, f"""WITH k AS (SELECT DISTINCT locus, substr(seq, CAST(pos + 1 AS BIGINT), 11) AS kmer FROM (SELECT *, unnest(range(0, length(seq) - 10)) AS pos FROM {B.LOCI})), d AS (SELECT kmer, count(*) AS depth FROM (SELECT locus, kmer FROM k UNION SELECT locus, {RC.format('kmer')} FROM k) GROUP BY kmer),
        e AS (SELECT x.kmer AS a, y.kmer AS b, x.depth AS depth_a, y.depth AS depth_b, count(*) OVER (PARTITION BY x.kmer) AS n FROM d x JOIN d y ON right(x.kmer, 10) = left(y.kmer, 10)) SELECT a, b, depth_a, depth_b FROM e WHERE n > 1"""),
    "unitig_table": (unitig_table, None),
    "component_table": (component_table, None),  # recursive SQL over whole chains of orders is too slow
    "bridge_table": (bridge_table, None),
    "backbone_table": (backbone_table, None),
    "contig_table": (contig_table, None),
    "alignment_scores": (alignment_scores, None),
    "best_foreign": (best_foreign, None),
    "seed_offsets": (seed_offsets, f"""WITH k AS (SELECT read_id, pos, substr(seq, CAST(pos + 1 AS BIGINT), 15) AS kmer FROM (SELECT *, unnest(range(0, length(seq) - 14)) AS pos FROM {B.READS})), l AS (SELECT locus, pos AS at, substr(seq, CAST(pos + 1 AS BIGINT), 15) AS kmer FROM (SELECT *, unnest(range(0, length(seq) - 14)) AS pos FROM {B.LOCI})),
        o AS (SELECT read_id, locus, k.pos - l.at AS off, count(*) AS seeds FROM k JOIN l USING (kmer) GROUP BY ALL) SELECT read_id, locus, off AS "offset", seeds, rank FROM (SELECT *, row_number() OVER (PARTITION BY read_id, locus ORDER BY seeds DESC, off) AS rank FROM o) WHERE rank <= 3"""),
    "merged_hsps": (merged_hsps, """WITH h AS (SELECT l_partkey % 100 AS query, l_suppkey % 10 AS subject, CAST(l_quantity * 10 AS BIGINT) AS x, CAST(l_quantity * 10 + l_linenumber * 7 - 20 AS BIGINT) AS y FROM lineitem), p AS (SELECT DISTINCT query, subject, unnest(range(least(x, y), greatest(x, y) + 1)) AS i FROM h),
        g AS (SELECT *, i - row_number() OVER (PARTITION BY query, subject ORDER BY i) AS k FROM p), s AS (SELECT query, subject, min(i) AS a, max(i) + 1 AS b FROM g GROUP BY query, subject, k) SELECT query, subject, count(*) AS spans, CAST(sum(b - a) AS BIGINT) AS covered, max(b - a) AS longest, min(a) AS first, max(b) AS last FROM s GROUP BY ALL"""),
    "em_abundance": (em_abundance, None),
    "bootstrap": (bootstrap, None),
    "core_gate": (core_gate, f"WITH c AS (SELECT substr(seq, CAST(pos + 1 AS BIGINT), 9) AS kmer FROM (SELECT *, unnest(range(0, length(seq) - 8)) AS pos FROM {B.LOCI}) GROUP BY 1 HAVING count(DISTINCT locus) >= 2) SELECT fragment, count(DISTINCT mate) AS mates FROM (SELECT *, substr(seq, CAST(pos + 1 AS BIGINT), 9) AS kmer FROM (SELECT *, unnest(range(0, length(seq) - 8)) AS pos FROM {B.MATES})) SEMI JOIN c USING (kmer) GROUP BY fragment"),
}
