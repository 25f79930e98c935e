"""Queries of whole workflow steps: families, links, tiles, profiles, and grouped assembly kernels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import assembly as Y
from ..operators import graphs as G
from ..operators import recruitment as R
from ..operators.packed import distinct_counts
from . import bridges as B


def gene_family(spark, sf):
    """Calls of each family by sample, and whether it is single-copy: in at least 0.7 of samples once, in none twice."""
    calls = B.table(spark, sf, "lineitem").groupBy(F.expr("l_partkey % 40").alias("family"), F.expr("l_suppkey % 10").alias("sample")).agg(F.countDistinct("l_orderkey").alias("n"))
    calls = calls.withColumn("n", F.expr("n div 40"))
    g = calls.groupBy("family").agg(F.count_if(F.expr("n = 0")).alias("missing"), F.count_if(F.expr("n = 1")).alias("one"), F.count_if(F.expr("n > 1")).alias("many"), F.count("*").alias("samples"))
    return g.withColumn("call", F.expr("CASE WHEN many = 0 AND one >= ceil(0.7 * samples) THEN 'single' WHEN many > 0 THEN 'multi' ELSE 'sparse' END"))


def longest_candidates(spark, sf):
    """Candidates at least a third of the longest and 6 long, one for each sequence on either strand, without strict prefixes of others."""
    c = B.table(spark, sf, "part").selectExpr("p_partkey % 50 AS family", "p_partkey AS id", "substring(translate(md5(cast(p_partkey % 150 AS string)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, cast(p_partkey % 17 + 3 AS int)) AS seq")
    long = c.withColumn("most", F.max(F.length("seq")).over(Window.partitionBy("family"))).where("length(seq) >= greatest(most / 3, 6)")
    one = long.groupBy("family", F.expr(S.canonical("seq")).alias("key")).agg(F.min("id").alias("id"), F.min("seq").alias("seq")).select("family", "id", "seq")
    other = one.select(F.col("family").alias("f"), F.col("seq").alias("longer"))
    return one.join(other, (F.col("family") == F.col("f")) & F.col("longer").startswith(F.col("seq")) & (F.length("longer") > F.length("seq")), "left_anti")


def unique_edges(spark, sf):
    """Adjacency of k-mers where either side has one neighbour only."""
    km = S.kmers(B.loci(spark, sf), 13).select(F.col("kmer").alias("seq")).distinct()
    return G.unique_adjacency(G.adjacency(km, 13))


def mate_links(spark, sf):
    """How many fragments lead from one locus's only k-mers to another's."""
    index = R.reference_index(B.loci(spark, sf), 12)
    single = index.groupBy("kmer").agg(F.countDistinct("locus").alias("n"), F.min("locus").alias("locus")).where("n = 1").select("kmer", "locus")
    found = R.matching_kmers(B.mates(spark, sf), single, B.loci(spark, sf), 12, ("fragment", "mate")).join(R.sized(single, B.loci(spark, sf)), "kmer").select("fragment", "mate", "locus").distinct()
    only = found.groupBy("fragment", "mate").agg(F.count("*").alias("n"), F.min("locus").alias("locus")).where("n = 1")
    left = only.where("mate = 1").select("fragment", F.col("locus").alias("from_locus"))
    right = only.where("mate = 2").select("fragment", F.col("locus").alias("to_locus"))
    return left.join(right, "fragment").where("from_locus <> to_locus").groupBy("from_locus", "to_locus").agg(F.count("*").alias("fragments"))


def path_completeness(spark, sf):
    """Which sources have all, some or none of the nodes of each path."""
    nodes = B.table(spark, sf, "part").selectExpr("p_partkey % 60 AS path", "p_partkey AS node")
    have = B.table(spark, sf, "lineitem").selectExpr("l_suppkey % 20 AS sample", "l_partkey AS node").distinct()
    n = nodes.groupBy("path").agg(F.count("*").alias("nodes"))
    seen = nodes.join(have, "node").groupBy("path", "sample").agg(F.count("*").alias("seen"))
    return seen.join(n, "path").select("path", "sample", "seen", "nodes", F.expr("CASE WHEN seen = nodes THEN 'complete' ELSE 'partial' END").alias("state"))


def tiles(spark, sf):
    """Baits of 60 every 30 round each locus as a circle."""
    return B.loci(spark, sf).where("length(seq) > 0").select("locus", F.posexplode(F.expr("sequence(0, length(seq) - 1, 30)")).alias("tile", "start"), "seq").select("locus", "tile", "start", F.expr(S.circular_slice("seq", "start", "least(60, length(seq))")).alias("bait"))


def first_contigs(spark, sf):
    """The first row of each sample and locus, of accepted ones."""
    ok = B.table(spark, sf, "labels").where("quality = 1").select("doc_id").distinct()
    d = B.table(spark, sf, "documents").join(ok, "doc_id", "left_semi")
    return d.groupBy("source", "lang").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))


def pseudoalign(spark, sf):
    """Loci that hold at least 0.8 of a read's k-mers known to the index, where those are at least a twentieth of all its k-mers."""
    k = 15
    index = R.reference_index(B.loci(spark, sf), k).select("kmer", "canonical", "locus")
    own = B.reads(spark, sf).select("read_id", "seq")
    n = S.kmers(own, k).groupBy("read_id").agg(F.countDistinct(F.expr(S.canonical("kmer"))).alias("n")) if G.repeated(own, ()) else distinct_counts(own, k, "read_id")
    found = R.matching_kmers(B.reads(spark, sf), index, B.loci(spark, sf), k, ("read_id",)).join(R.sized(index, B.loci(spark, sf)), "kmer").select("read_id", "canonical", "locus").distinct()
    known = found.groupBy("read_id").agg(F.countDistinct("canonical").alias("known"))
    return found.groupBy("read_id", "locus").agg(F.count("*").alias("hits")).join(known, "read_id").join(n, "read_id").where("known >= 0.05 * n AND hits >= 0.8 * known").select("read_id", "locus", "hits", "known", "n")


def fragment_kmers(spark, sf):
    """Distinct k-mers and the longest text of each role."""
    m = B.mates(spark, sf)
    return S.kmers(m.select("role", "seq"), 11).groupBy("role").agg(F.countDistinct("kmer").alias("kmers")).join(m.groupBy("role").agg(F.max(F.length("seq")).alias("longest"), F.count("*").alias("records")), "role")


def nation_edges(spark, sf):
    return B.table(spark, sf, "customer").selectExpr("c_nationkey AS locus", "cast(c_custkey % 29 AS string) AS a", "cast((c_custkey * 3 + 1) % 31 AS string) AS b").distinct()


def bubble_table(spark, sf):
    """G11, Y32."""
    return Y.per_group(nation_edges(spark, sf), ["locus"], "begin string, meets string, kind string", lambda p: Y.bubbles(list(zip(p["a"], p["b"], strict=True))))


def shortest_bridges(spark, sf):
    """The only shortest path from node 1 to node 20 of each graph."""
    return Y.per_group(nation_edges(spark, sf), ["locus"], "ord int, node string", lambda p: list(enumerate(Y.only_shortest_path(list(zip(p["a"], p["b"], strict=True)), "1", "20") or [])))


def overlap_collapse(spark, sf):
    """Pieces of each locus put together again."""
    cut = B.loci(spark, sf).select("locus", F.explode(F.expr("transform(sequence(1, length(seq), 60), i -> substring(seq, i, 110))")).alias("piece"))
    return Y.per_group(cut, ["locus"], "seq string", lambda p: [(s,) for s in Y.collapsed(list(p["piece"]), least=25)])


def arm_catalogue(spark, sf):
    """Clusters of arm pairs within each sample."""
    rows = B.table(spark, sf, "part").selectExpr("p_partkey % 20 AS sample", "cast(p_partkey AS string) AS id", "translate(md5(cast(p_partkey % 60 AS string)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS l", "translate(md5(concat('r', p_partkey % 60)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS r")
    return Y.per_group(rows, ["sample"], "id string, cluster int", lambda p: Y.catalogue(list(zip(p["id"], p["l"], p["r"], strict=True))))


RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def _k(source: str, keys: str, k: int) -> str:
    return f"(SELECT {keys}, substr(seq, CAST(pos + 1 AS BIGINT), {k}) AS kmer FROM (SELECT *, unnest(range(0, length(seq) - {k} + 1)) AS pos FROM {source}))"


QUERIES = {
    "gene_family": (gene_family, "WITH c AS (SELECT l_partkey % 40 AS family, l_suppkey % 10 AS sample, count(DISTINCT l_orderkey) // 40 AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT family, count(*) FILTER (WHERE n = 0) AS missing, count(*) FILTER (WHERE n = 1) AS one, count(*) FILTER (WHERE n > 1) AS many, count(*) AS samples FROM c GROUP BY family) SELECT *, CASE WHEN many = 0 AND one >= ceil(0.7 * samples) THEN 'single' WHEN many > 0 THEN 'multi' ELSE 'sparse' END AS call FROM g"),
    "longest_candidates": (longest_candidates, f"""WITH c AS (SELECT p_partkey % 50 AS family, p_partkey AS id, substr(translate(md5(CAST(p_partkey % 150 AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, p_partkey % 17 + 3) AS seq FROM part), l AS (SELECT *, max(length(seq)) OVER (PARTITION BY family) AS most FROM c), o AS (SELECT family, min(id) AS id, min(seq) AS seq FROM l WHERE length(seq) >= greatest(most / 3, 6) GROUP BY family, least(seq, {RC.format('seq')}))
        SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM o p WHERE p.family = o.family AND starts_with(p.seq, o.seq) AND length(p.seq) > length(o.seq))"""),
    "unique_edges": (unique_edges, f"WITH k AS (SELECT DISTINCT kmer FROM {_k(B.LOCI, 'locus', 13)}), e AS (SELECT x.kmer AS a, y.kmer AS b FROM k x JOIN k y ON right(x.kmer, 12) = left(y.kmer, 12)) SELECT a, b FROM (SELECT *, count(*) OVER (PARTITION BY a) AS n, count(*) OVER (PARTITION BY b) AS m FROM e) WHERE n = 1 AND m = 1"),
    "mate_links": (mate_links, f"""WITH i AS (SELECT kmer, min(locus) AS locus FROM (SELECT locus, kmer FROM {_k(B.LOCI, 'locus', 12)} UNION SELECT locus, {RC.format('kmer')} FROM {_k(B.LOCI, 'locus', 12)}) GROUP BY kmer HAVING count(DISTINCT locus) = 1),
        o AS (SELECT fragment, mate, min(locus) AS locus FROM {_k(B.MATES, 'fragment, mate', 12)} JOIN i USING (kmer) GROUP BY fragment, mate HAVING count(DISTINCT locus) = 1) SELECT x.locus AS from_locus, y.locus AS to_locus, count(*) AS fragments FROM o x JOIN o y USING (fragment) WHERE x.mate = 1 AND y.mate = 2 AND x.locus <> y.locus GROUP BY ALL"""),
    "path_completeness": (path_completeness, "WITH n AS (SELECT p_partkey % 60 AS path, p_partkey AS node, count(*) OVER (PARTITION BY p_partkey % 60) AS nodes FROM part) SELECT path, l_suppkey % 20 AS sample, count(DISTINCT node) AS seen, any_value(nodes) AS nodes, CASE WHEN count(DISTINCT node) = any_value(nodes) THEN 'complete' ELSE 'partial' END AS state FROM n JOIN lineitem ON l_partkey = node GROUP BY 1, 2"),
    "tiles": (tiles, f"SELECT locus, CAST(start // 30 AS INTEGER) AS tile, CAST(start AS INTEGER) AS start, substr(seq || seq || seq, CAST(start + 1 AS BIGINT), least(60, length(seq))) AS bait FROM (SELECT *, unnest(range(0, length(seq), 30)) AS start FROM {B.LOCI})"),
    "first_contigs": (first_contigs, "SELECT source, lang, min(doc_id) AS first, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL"),
    "pseudoalign": (pseudoalign, f"""WITH r AS (SELECT DISTINCT read_id, least(kmer, {RC.format('kmer')}) AS c FROM {_k(B.READS, 'read_id', 15)}), i AS (SELECT DISTINCT locus, least(kmer, {RC.format('kmer')}) AS c FROM {_k(B.LOCI, 'locus', 15)}), n AS (SELECT read_id, count(*) AS n, count(*) FILTER (WHERE c IN (SELECT c FROM i)) AS known FROM r GROUP BY read_id)
        SELECT read_id, locus, count(*) AS hits, any_value(known) AS known, any_value(n) AS n FROM r JOIN i USING (c) JOIN n USING (read_id) GROUP BY read_id, locus HAVING any_value(known) >= 0.05 * any_value(n) AND count(*) >= 0.8 * any_value(known)"""),
    "fragment_kmers": (fragment_kmers, f"SELECT role, kmers, longest, records FROM (SELECT role, count(DISTINCT kmer) AS kmers FROM {_k(B.MATES, 'role', 11)} GROUP BY role) JOIN (SELECT role, max(length(seq)) AS longest, count(*) AS records FROM {B.MATES} GROUP BY role) USING (role)"),
    "bubble_table": (bubble_table, None),
    "shortest_bridges": (shortest_bridges, None),
    "overlap_collapse": (overlap_collapse, None),
    "arm_catalogue": (arm_catalogue, None),
}
