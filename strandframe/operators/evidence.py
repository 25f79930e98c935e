"""Evidence for contigs, baits and circles: positions in references, support by read slices, terminals, seams and seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from .packed import own_codes
from .recruitment import matching_kmers, sized


def reference_positions(loci: DataFrame, k: int) -> DataFrame:
    """A5: rows (locus, kmer, depth, position, is_reverse): how often each k-mer of a locus occurs on both strands, and where it is met first.

    The forward windows are visited from the right end, then the others from the left; a position is the number of the
    visit in thousandths of all windows.
    """
    own = S.kmers(loci.selectExpr("locus", "seq", f"cast(length(seq) - {k - 1} AS int) AS total"), k)
    both = own.selectExpr("locus", "kmer", "total", "total - pos AS visit", "false AS is_reverse").unionByName(own.selectExpr("locus", f"{S.reverse_complement('kmer')} AS kmer", "total", "pos + 1 AS visit", "true AS is_reverse"))
    met = both.groupBy("locus", "kmer").agg(F.count("*").alias("depth"), F.min(F.struct("is_reverse", "visit", "total")).alias("m"))
    return met.select("locus", "kmer", "depth", F.expr("cast(floor(m.visit / m.total * 1000) AS int)").alias("position"), "m.is_reverse")


def slice_support(contigs: DataFrame, slices: DataFrame, k: int) -> DataFrame:
    """The support of contigs (locus, seq) by read slices (kmer, n) of k bases.

    A slice that stands once in a contig supports its place; one that stands more often counts as multi-mapping only.
    """
    own = S.kmers(contigs.selectExpr("locus", "seq", "length(seq) AS length"), k)
    found = own.join(slices, "kmer").groupBy("locus", "length", "kmer").agg(F.max("n").alias("n"), F.count("*").alias("places"), F.min("pos").alias("start"))
    sums = found.groupBy("locus").agg(F.sum("n").alias("reads"), F.coalesce(F.sum(F.when(F.col("places") == 1, F.col("n"))), F.lit(0)).alias("unique_reads"), F.coalesce(F.sum(F.when(F.col("places") > 1, F.col("n"))), F.lit(0)).alias("multi_reads"))
    placed = found.where("places = 1").selectExpr("locus", "length", "start", f"start + {k} AS end")
    w = Window.partitionBy("locus").orderBy("start")
    gaps = placed.withColumn("gap", F.col("start") - F.lag("end").over(w))  # slices of one length: an earlier start ends earlier
    spans = gaps.groupBy("locus").agg(F.min("start").alias("left"), F.max("end").alias("right"), F.max("length").alias("length"), F.max(F.coalesce("gap", F.lit(0))).alias("inner"), F.sum(F.expr(f"CASE WHEN gap < 0 THEN {k} + gap ELSE {k} END")).alias("supported"))
    whole = contigs.selectExpr("locus", "cast(length(seq) AS int) AS contig_length").join(sums, "locus").join(spans.drop("length"), "locus", "left")
    flank = "CASE WHEN left IS NULL THEN 0D WHEN left = 0 AND right = contig_length THEN 1D ELSE round(least(left, contig_length - right) / greatest(left, contig_length - right), 6) END"
    return whole.selectExpr(
        "locus", "contig_length", "reads", "unique_reads", "multi_reads", "coalesce(right - left, 0) AS extent", "coalesce(supported, 0) AS supported", "round(coalesce(supported, 0) / contig_length, 6) AS breadth",
        "coalesce(greatest(left, contig_length - right, inner), contig_length) AS max_gap", f"{flank} AS flank_balance",
    )


def terminal_evidence(matches: DataFrame, window: int) -> DataFrame:
    """Matches (read_start, read_end, read_length, ref_start, ref_end, ref_length, strand) with what they say of the reference's ends.

    Places on strand 2 are those of the turned reference. An end is near within the window, or a fifth of the reference
    where that is less, and extended where the read goes on beyond the match.
    """
    turned = matches.withColumn("effective_window", F.expr(f"least({window}, greatest(cast(floor(ref_length / 5) AS int), 1))"))
    turned = turned.withColumn("original_start", F.expr("CASE WHEN strand = 1 THEN ref_start ELSE greatest(ref_length - ref_end, 0) END")).withColumn("original_end", F.expr("CASE WHEN strand = 1 THEN ref_end ELSE greatest(ref_length - ref_start, 0) END"))
    turned = turned.withColumn("left_overhang", F.expr("CASE WHEN strand = 1 THEN read_start ELSE greatest(read_length - read_end, 0) END")).withColumn("right_overhang", F.expr("CASE WHEN strand = 1 THEN greatest(read_length - read_end, 0) ELSE read_start END"))
    near = turned.withColumn("near_left", F.expr("original_start <= effective_window")).withColumn("near_right", F.expr("greatest(ref_length - original_end, 0) <= effective_window"))
    return near.withColumn("extends_left", F.expr("near_left AND left_overhang > 0")).withColumn("extends_right", F.expr("near_right AND right_overhang > 0"))


def side_products(candidates: DataFrame, n: int = 3) -> DataFrame:
    """Candidates (locus, side, id, reads), side left or right: the n best of each side, every left one with every right one."""
    best = candidates.withColumn("_r", F.row_number().over(Window.partitionBy("locus", "side").orderBy(F.desc("reads"), "id"))).where(F.col("_r") <= n)
    side = lambda s: best.where(F.col("side") == s).select("locus", F.col("id").alias(s), F.col("reads").alias(f"{s}_reads"))
    return side("left").join(side("right"), "locus").withColumn("reads", F.col("left_reads") + F.col("right_reads")).drop("left_reads", "right_reads")


def _within_one(a: str, b: str, k: int) -> Column:
    return F.expr(f"size(filter(sequence(1, {k}), i -> substring({a}, i, 1) <> substring({b}, i, 1))) <= 1")


def near_windows(texts: DataFrame, targets: DataFrame, key: str, k: int) -> DataFrame:
    """Rows (key, target columns) where a text has a window of k bases within one mismatch of a target (t, window): one of its halves then stands as it is."""
    half = k // 2
    windows = S.kmers(texts, k).select(key, "kmer")
    out = None
    for begin, length in ((1, half), (half + 1, k - half)):
        a = windows.withColumn("_half", F.expr(f"substring(kmer, {begin}, {length})"))
        b = targets.withColumn("_half", F.expr(f"substring(window, {begin}, {length})"))
        found = a.join(b, "_half").where(_within_one("kmer", "window", k)).drop("_half", "kmer", "window")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def junction_support(circles: DataFrame, reads: DataFrame, k: int, band: int = 3) -> DataFrame:
    """Rows (locus, windows, support): the least number of reads over the windows of k bases that straddle a circle's seam.

    Windows lie up to band bases off the middle; one that also occurs within the linear sequence, one mismatch allowed, is
    no evidence. Reads match with one mismatch on either strand. Without any window the support is 0.
    """
    centre = k // 2
    low, high = max(1, centre - band), min(k - 1, centre + band)
    cut = circles.where(f"length(seq) >= {k}").select("locus", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("t"), "seq").selectExpr("locus", "t", f"concat(right(seq, t), left(seq, {k} - t)) AS window")
    inside = near_windows(circles.select("locus", "seq"), cut.selectExpr("locus AS of", "t", "window"), "locus", k).where("locus = of").select("locus", "t")
    own = cut.join(inside, ["locus", "t"], "left_anti")
    either = own.selectExpr("locus", "t", "window").unionByName(own.selectExpr("locus", "t", f"{S.reverse_complement('window')} AS window"))
    spanning = near_windows(reads, either, "read_id", k).groupBy("locus", "t").agg(F.count_distinct("read_id").alias("n"))
    counted = own.join(spanning, ["locus", "t"], "left").groupBy("locus").agg(F.count("*").alias("windows"), F.min(F.coalesce("n", F.lit(0))).alias("support"))
    return circles.select("locus").join(counted, "locus", "left").selectExpr("locus", "coalesce(windows, 0) AS windows", "coalesce(support, 0) AS support")


def numeric_order(name: str) -> Column:
    """a key that sorts names NN_name by number, then by name; those without a number have 0 and sort by all of the name."""
    number = f"try_cast(CASE WHEN {name} RLIKE '^[+-]?[0-9]+_' THEN split_part({name}, '_', 1) END AS long)"
    return F.expr(f"struct(coalesce({number}, 0) AS number, CASE WHEN {number} IS NULL THEN {name} ELSE substring({name}, instr({name}, '_') + 1) END AS rest)")


def solid_minimizers(reads: DataFrame, keys: tuple[str, ...], k: int, least: int) -> DataFrame:
    """for each read the least canonical k-mer that all reads together have at least so often; reads without one are left out. k is 31 at most.

    K-mers are codes, whose order is that of their texts. A file's size says nothing of its k-mers' number, so neither side of the join may be sent whole.
    """
    own = own_codes(reads, k, list(keys))
    solid = own.groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("code")
    return own.hint("merge").join(solid.hint("merge"), "code").groupBy(*keys).agg(F.min("code").alias("code")).select(*keys, F.expr(S.from_two_bit("code", k)).alias("minimizer"))


def bait_orientation(reads: DataFrame, baits: DataFrame, seed: int = 23, anchor: int = 21) -> DataFrame:
    """rows (read_id, forward, reverse, turned, anchored, best) for reads that meet a bait (locus, seq).

    forward and reverse count the seeds, one every seed bases from the begin of the read or of its other strand, that stand
    in each bait; a read with more of the latter is turned. anchored is the number of baits that share a window of anchor
    bases with the read as it stands, best the most windows that one of them has.
    """
    index = S.kmers(baits.select("locus", "seq"), seed).select("kmer", "locus").distinct()
    flipped = index.selectExpr(f"{S.reverse_complement('kmer')} AS kmer", "locus")
    long = reads.withColumn("_n", F.length("seq"))

    def hits(known: DataFrame, condition: str, name: str) -> DataFrame:
        return matching_kmers(long, known, baits, seed, ("read_id", "_n")).where(condition).join(sized(known, baits), "kmer").groupBy("read_id").agg(F.count("*").alias(name))

    there = S.kmers(baits.select("locus", "seq"), anchor).select("kmer", "locus").distinct()
    by_bait = matching_kmers(reads, there, baits, anchor, ("read_id",)).join(sized(there, baits), "kmer").groupBy("read_id", "locus").agg(F.count("*").alias("n"))
    anchors = by_bait.groupBy("read_id").agg(F.count("*").alias("anchored"), F.max("n").alias("best"))
    forward, reverse = hits(index, f"pos % {seed} = 0", "forward"), hits(flipped, f"(_n - {seed} - pos) % {seed} = 0", "reverse")
    both = forward.join(reverse, "read_id", "full").join(anchors, "read_id", "full").na.fill(0)
    return both.select("read_id", "forward", "reverse", (F.col("reverse") > F.col("forward")).alias("turned"), "anchored", "best")


# Parts of gene names by the order in which they are preferred as the begin of a circle.
ANCHORS = ("phe", "trnf", "cox1", "coi", "co1", "nad1", "rrns", "12s")


def anchor_rank(name: str) -> Column:
    """the place of the first anchor that a name holds; null for none."""
    return F.expr("CASE " + " ".join(f"WHEN contains(lower({name}), '{a}') THEN {i}" for i, a in enumerate(ANCHORS)) + " END")


def gene_sequence(seq: str, segments: str, reverse: str) -> Column:
    """the segments (start, end) of a gene one after another, on its own strand; segments beyond the sequence are left out."""
    joined = f"array_join(transform(filter({segments}, s -> s.start < s.end AND s.end <= length({seq})), s -> substring({seq}, s.start + 1, s.end - s.start)), '')"
    return F.expr(f"CASE WHEN {reverse} THEN {S.reverse_complement(joined)} ELSE {joined} END")


def windows_from_the_right(seqs: DataFrame, k: int, min_start: int = 1) -> DataFrame:
    """Rows (locus, strand, ordinal, kmer): windows from right to left on both strands; min_start 1 leaves out the leftmost of each."""
    own = S.kmers(seqs.selectExpr("locus", "seq", f"length(seq) - {k} AS last"), k)
    forward = own.where(f"pos >= {min_start}").selectExpr("locus", "1 AS strand", "cast(last - pos AS int) AS ordinal", "kmer")
    return forward.unionByName(own.where(f"pos <= last - {min_start}").selectExpr("locus", "2 AS strand", "pos AS ordinal", f"{S.reverse_complement('kmer')} AS kmer"))


def contig_header(prefix: str, fields: tuple[str, ...], supported: str, balance: str) -> Column:
    """The header line of a contig: its figures joined by underscores, balance with three decimals."""
    return F.expr(f"concat('>', {prefix}, '_', concat_ws('_', {', '.join(fields)}), '_supported_', {supported}, '_balance_', format_string('%.3f', cast({balance} AS double)))")


def unitig_paths(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The evidence of unitigs and of edges between them, from hits (sample, read_id, unitig, pos) of reads' own k-mers.

    A read passes a unitig where its hits change to it; two that follow one another in a read are an edge. Gives (unitig,
    samples, reads, depth) and (a, b, reads, samples).
    """
    w = Window.partitionBy("sample", "read_id").orderBy("pos")
    steps = hits.withColumn("_before", F.lag("unitig").over(w))
    nodes = hits.groupBy("unitig").agg(F.count_distinct("sample").alias("samples"), F.count_distinct("read_id").alias("reads"), F.count("*").alias("depth"))
    edges = steps.where("_before <> unitig").groupBy(F.col("_before").alias("a"), F.col("unitig").alias("b")).agg(F.count_distinct("read_id").alias("reads"), F.count_distinct("sample").alias("samples"))
    return nodes, edges


def dosages(genotypes: DataFrame) -> DataFrame:
    """Genotypes with n, the number of alternative alleles; those not called are left out."""
    return genotypes.where("gt IS NOT NULL AND NOT contains(gt, '.')").withColumn("n", F.expr("size(filter(split(gt, '[/|]'), a -> a = '1'))").cast("double"))


def linked_sites(dosage: DataFrame, group: str, window: int, least: float) -> DataFrame:
    """Rows (group, a, b, r2): sites of one group, at most window places apart, whose dosages have a squared correlation of at least so much."""
    places = dosage.select(group, "site").distinct().withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy("site")))
    placed = dosage.join(places, [group, "site"]).select(group, "site", "_i", "sample", "n")
    left = placed.select(group, F.col("site").alias("a"), F.col("_i").alias("_p"), "sample", F.col("n").alias("x")).withColumn("_i", F.explode(F.expr(f"sequence(_p + 1, _p + {window})")))
    both = left.join(placed.withColumnRenamed("site", "b"), [group, "_i", "sample"])
    sums = both.groupBy(group, "a", "b").agg(F.count("*").alias("c"), F.sum("x").alias("x"), F.sum("n").alias("y"), F.sum(F.expr("x * n")).alias("xy"), F.sum(F.expr("x * x")).alias("xx"), F.sum(F.expr("n * n")).alias("yy"))
    r2 = sums.select(group, "a", "b", F.expr("try_divide((c * xy - x * y) * (c * xy - x * y), (c * xx - x * x) * (c * yy - y * y))").alias("r2"))  # null where a site does not vary
    return r2.withColumn("r2", F.round("r2", 6)).where(F.col("r2") >= least)


def shared_alleles(dosage: DataFrame) -> DataFrame:
    """Rows (a, b, sites, ibs): for every two samples the sites that both have called and the mean share of alleles alike. Sites meet by site; samples are a dimension."""
    a, b = dosage.select("site", F.col("sample").alias("a"), F.col("n").alias("x")), dosage.select("site", F.col("sample").alias("b"), F.col("n").alias("y"))
    return a.join(b, "site").where("a < b").groupBy("a", "b").agg(F.count("*").alias("sites"), F.round(F.avg(1 - F.abs(F.col("x") - F.col("y")) / 2), 6).alias("ibs"))


#: Samples whose relations fit the driver (125,000 sums): their number is that of a study, not of its reads.
MOST_SAMPLES = 500


def sample_components(dosage: DataFrame, n: int = 3) -> DataFrame:
    """Rows (component, sample, value, share): the first n principal components of samples over standardised dosages, a sample without a call at a site standing at its mean.

    The relations of all samples are summed up in Spark; only their square reaches the driver, and more than MOST_SAMPLES
    are refused. Of each component the largest value is positive.
    """
    import numpy as np

    sites = dosage.groupBy("site").agg((F.avg("n") / 2).alias("p")).where("p > 0 AND p < 1")
    z = dosage.join(sites, "site").selectExpr("site", "sample", "(n - 2 * p) / sqrt(2 * p * (1 - p)) AS z")
    names = [r["sample"] for r in z.select("sample").distinct().orderBy("sample").limit(MOST_SAMPLES + 1).collect()]
    if len(names) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples")
    place, square = {s: i for i, s in enumerate(names)}, np.zeros((len(names), len(names)))
    a, b = z.selectExpr("site", "sample AS a", "z AS x"), z.selectExpr("site", "sample AS b", "z AS y")
    for r in a.join(b, "site").where("a <= b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("s")).collect():
        square[place[r["a"]], place[r["b"]]] = square[place[r["b"]], place[r["a"]]] = r["s"]
    values, vectors = np.linalg.eigh(square) if names else (np.zeros(0), np.zeros((0, 0)))
    rows = []
    for c, k in enumerate(np.argsort(-values)[:n], 1):
        v = vectors[:, k] * np.sign(vectors[np.abs(vectors[:, k]).argmax(), k])
        rows += [(c, s, float(v[i]), float(values[k] / values.sum())) for s, i in place.items()]
    kind = dosage.schema["sample"].dataType.simpleString()
    return dosage.sparkSession.createDataFrame(rows, f"component int, sample {kind}, value double, share double")
