"""Every query with SQL of its own must give DuckDB's rows; those without are held to plain versions in test_brute.py."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from strandframe.plans import catalogue
from strandframe.streaming.recruit import run_available, streamed_counts

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df: pd.DataFrame) -> pd.DataFrame:
    """Columns and rows in an order of their own, numbers as floats, the rest as text."""
    df = df.reindex(sorted(df.columns), axis=1)
    for c in df.columns:
        try:
            df[c] = pd.to_numeric(df[c]).astype(float).round(6) if df[c].dtype != bool else df[c].astype(str)
        except (TypeError, ValueError):
            df[c] = df[c].astype(object).where(df[c].notna(), None).astype(str)
    return df.sort_values(list(df.columns), key=lambda c: c.astype(str)).reset_index(drop=True)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    a, b = plain(got.toPandas()), plain(duck.execute(catalogue.oracle_sql()[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        same = np.isclose(a[c], b[c], atol=1e-5, equal_nan=True) if a[c].dtype.kind == "f" and b[c].dtype.kind == "f" else (a[c].astype(str) == b[c].astype(str)).to_numpy()
        assert same.all(), (c, a[c][~same].head(3).tolist(), b[c][~same].head(3).tolist())


def test_streamed_recruitment_equals_batch(spark, tmp_path):
    from strandframe.plans import bridges as B

    reads = B.reads(spark, SF).select("read_id", "seq")
    reads.repartition(3).write.parquet(str(tmp_path / "reads"))
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "reads"))
    got = run_available(streamed_counts(stream, B.loci(spark, SF), 15), str(tmp_path / "counts"), str(tmp_path / "state"))
    want = streamed_counts(reads, B.loci(spark, SF), 15)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
