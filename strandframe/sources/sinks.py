"""Writers; Spark's committer makes each of them all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fasta_lines(df: DataFrame, name: str = "name", seq: str = "seq", width: int = 80) -> DataFrame:
    """K3: one row of text for each record, its sequence in lines of a fixed width."""
    wrapped = f"CASE WHEN {seq} = '' THEN '' ELSE array_join(transform(sequence(1, length({seq}), {width}), i -> substring({seq}, i, {width})), '\\n') END"
    return df.select(F.expr(f"concat('>', {name}, '\\n', {wrapped})").alias("value"))


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    fasta_lines(df, name, seq).write.mode("overwrite").text(path)


def write_by_locus(df: DataFrame, path: str) -> None:
    """K1, K2: a folder for each sample and locus, in input order; a hot locus is spread over files by Spark's size bound on them."""
    df.repartition("sample", "locus").sortWithinPartitions("sample", "locus", "fragment").write.mode("overwrite").partitionBy("sample", "locus").option("maxRecordsPerFile", 1_000_000).parquet(path)


def gfa_lines(segments: DataFrame, links: DataFrame) -> DataFrame:
    """K4: segments (id, seq) and links (a, a_strand, b, b_strand, overlap) as GFA, segments first."""
    s = segments.selectExpr("0 AS o", "concat_ws('\\t', 'S', id, seq) AS value")
    return s.unionByName(links.selectExpr("1 AS o", "concat_ws('\\t', 'L', a, a_strand, b, b_strand, concat(overlap, 'M')) AS value")).orderBy("o", "value").select("value")


def dot_lines(edges: DataFrame) -> DataFrame:
    """K4: edges (a, b) in DOT, without the braces."""
    return edges.selectExpr("concat('  \"', a, '\" -> \"', b, '\";') AS value").orderBy("value")


def write_matrix(df: DataFrame, path: str) -> None:
    """K5."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, sep="\t")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Name, rows and a checksum of each table that does not depend on the order of rows."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("checksum")).select(F.lit(name).alias("name"), "rows", "checksum")
        out = row if out is None else out.unionByName(row)
    return out
