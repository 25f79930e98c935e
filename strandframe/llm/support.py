"""What several operators of this subpackage need: tables written to shared storage, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode, where the driver is the one executor."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="strandframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage is cut, and a lost executor takes nothing with it."""
    path = f"{shared_folder(df.sparkSession)}/strandframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes a table of written() that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes for df to have no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Parts that the rows of one key are dealt to before they meet, so that no task takes all rows of a hot key.
PARTS = 64


def grouped_least(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """df with the column name: the least value among the rows of the same key; rows with a null key are left out.

    Rows meet by key and part, and only one row for each of these by the key alone, so a hot key takes no task for itself.
    """
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(value), F.lit(PARTS)).cast("short"))
    parts = dealt.groupBy(key, "_part").agg(F.min(value).alias(name))
    least = parts.groupBy(key).agg(F.min(name).alias(name))
    return dealt.join(parts.select(key, "_part").join(least, key), [key, "_part"]).drop("_part")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of edges (a, b): root is the smallest node that is reachable.

    Alternating large-star and small-star rounds; each is a least neighbour by node, dealt in parts, so no task gathers a
    component or the neighbours of a star's centre. Each round's edges are written, so a lost executor costs one round at
    most, and removed once the next round stands. Empty edges give no rows; nulls and self-loops are left out.
    """

    def oriented(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        return row["n"], row["x"]

    current = written(oriented(edges.toDF("u", "v")), "edges")
    before = state(current)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = grouped_least(current.union(current.select("v", "u")), "u", "v", "m")
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = grouped_least(large, "u", "v", "m").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        last, current = current, written(oriented(small), "edges")
        discard(last)
        after = state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select("v", "v").distinct())
