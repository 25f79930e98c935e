"""The driver's tables seen as reads, loci, pairs, measurements, genotypes and alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ALPHABET, BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bases(text: str) -> str:
    """Letters as bases: stripped to A-Z before they are put in upper case, as case changes of other letters differ between engines."""
    return f"translate(upper(regexp_replace({text}, '[^A-Za-z]', '')), '{ALPHABET}', '{BASES}')"


def duck_bases(text: str) -> str:
    return f"translate(upper(regexp_replace({text}, '[^A-Za-z]', '', 'g')), '{ALPHABET}', '{BASES}')"


def dealt(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores dealt evenly; larger ones stay as their splits are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reads."""
    return dealt(table(spark, sf_dir, "documents")).selectExpr("source AS sample", "doc_id AS read_id", f"{bases('text')} AS seq")


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").selectExpr("item_id AS locus", f"{bases('text')} AS seq")


def mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as mates: two in a row make a fragment."""
    return table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn div 2 AS fragment", "cast(turn % 2 + 1 AS int) AS mate", "role", f"{bases('text')} AS seq")


READS = f"(SELECT source AS sample, doc_id AS read_id, {duck_bases('text')} AS seq FROM documents)"
LOCI = f"(SELECT item_id AS locus, {duck_bases('text')} AS seq FROM benchmark)"
MATES = f"(SELECT conv_id * 1000 + turn // 2 AS fragment, CAST(turn % 2 + 1 AS INTEGER) AS mate, role, {duck_bases('text')} AS seq FROM conversations)"

#: Sample by locus measurements, one row for each pair.
MEASURES = """(SELECT l_suppkey AS sample, l_partkey AS locus, count(*) AS reads, sum(l_quantity) AS support, max(l_extendedprice) AS length, min(l_discount) AS lo, max(l_tax) AS hi,
 min(l_linestatus) AS status FROM lineitem GROUP BY l_suppkey, l_partkey)"""

#: Genotypes: a part is a site, a supplier a sample.
GENOTYPES = """(SELECT l_partkey AS site, l_suppkey AS sample, min(l_quantity) AS dp, max(l_quantity) AS gq, min(l_extendedprice) / 1000 AS qual,
 CASE WHEN sum(l_linenumber) % 5 = 0 THEN './.' WHEN min(l_returnflag) = 'A' THEN '0/1' WHEN min(l_returnflag) = 'N' THEN '1/1' ELSE '0/0' END AS gt FROM lineitem GROUP BY l_partkey, l_suppkey)"""


def view(spark: SparkSession, sf_dir: str, *names: str) -> SparkSession:
    """The session, with the driver's tables as temporary views."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
    return spark
