"""Stages by content: reused where nothing changed, rebuilt where something did or a run died."""

import pytest
from pyspark.sql import functions as F

from strandframe.operators import stages as S


@pytest.fixture
def counted(spark):
    """A stage that says how often it was built."""
    built = []

    def build(rows, factor):
        built.append(factor)
        return rows.select("id", (F.col("x") * factor).alias("y"))

    return build, built


def table(spark, rows, parts=2):
    return spark.createDataFrame(rows, "id long, x long").repartition(parts)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_same_contents_are_built_once(spark, counted):
    build, built = counted
    rows = [(1, 5), (2, None), (2, None), (3, 7)]
    first = S.resumed("same", {"rows": table(spark, rows)}, {"factor": 2}, build)
    again = S.resumed("same", {"rows": table(spark, rows[::-1], 5)}, {"factor": 2}, build)
    assert got(first) == got(again) == got(build(table(spark, rows), 2)) and built == [2, 2]


@pytest.mark.parametrize(
    ("rows", "factor", "version"),
    [([(1, 5)], 2, "1"), ([(1, 5), (2, 6), (2, 6)], 2, "1"), ([(1, 6), (2, 5)], 2, "1"), ([(1, 5), (2, 6)], 3, "1"), ([(1, 5), (2, 6)], 2, "2"), ([], 2, "1")],
)
def test_any_change_is_another_key(spark, counted, rows, factor, version):
    base = S.content_key("change", {"rows": table(spark, [(1, 5), (2, 6)])}, {"factor": 2})
    assert S.content_key("change", {"rows": table(spark, rows)}, {"factor": factor}, version) != base
    assert S.content_key("other", {"rows": table(spark, [(1, 5), (2, 6)])}, {"factor": 2}) != base
    assert S.content_key("change", {"rows": table(spark, [(1, 5), (2, 6)]).withColumnRenamed("x", "z")}, {"factor": 2}) != base


def test_a_run_that_dies_leaves_nothing_and_is_built_again(spark, counted):
    build, built = counted
    rows = table(spark, [(i, i) for i in range(40)], 4)

    def dies(rows, factor):
        built.append("died")
        return rows.select("id", F.expr("CASE WHEN id = 39 THEN raise_error('lost') ELSE x * 2 END").cast("long").alias("y"))

    with pytest.raises(Exception, match="lost"):
        S.resumed("dies", {"rows": rows}, {"factor": 2}, dies).collect()
    assert got(S.resumed("dies", {"rows": rows}, {"factor": 2}, build)) == [(i, 2 * i) for i in range(40)]
    S.resumed("dies", {"rows": rows}, {"factor": 2}, build)
    assert built == ["died", 2]
    key = S.content_key("dies", {"rows": rows}, {"factor": 2})
    assert S.swept(spark, "dies", {key}) == 1  # what the dead run left
    S.resumed("dies", {"rows": rows}, {"factor": 2}, build)
    assert built == ["died", 2]


def test_a_table_lost_after_its_commit_is_built_again(spark, counted):
    build, built = counted
    rows = table(spark, [(1, 5)])
    S.resumed("lost", {"rows": rows}, {"factor": 2}, build)
    folder, key = S._Folder(spark, "lost"), S.content_key("lost", {"rows": rows}, {"factor": 2})
    folder.remove(folder.committed(key))
    assert got(S.resumed("lost", {"rows": rows}, {"factor": 2}, build)) == [(1, 10)] and built == [2, 2]


def test_other_keys_are_swept(spark, counted):
    build, _ = counted
    keep = S.content_key("swept", {"rows": table(spark, [(1, 5)])}, {"factor": 2})
    S.resumed("swept", {"rows": table(spark, [(1, 5)])}, {"factor": 2}, build)
    S.resumed("swept", {"rows": table(spark, [(1, 6)])}, {"factor": 2}, build)
    assert S.swept(spark, "swept", {keep}) == 1 and S.swept(spark, "swept", {keep}) == 0
    assert S._Folder(spark, "swept").committed(keep)


def test_files_tell_themselves_apart(spark, tmp_path):
    table(spark, [(1, 5)]).write.parquet(str(tmp_path / "a"))
    table(spark, [(1, 5)]).write.parquet(str(tmp_path / "b"))
    a, b = (spark.read.parquet(str(tmp_path / x)) for x in "ab")
    assert S.files_digest(a) == S.files_digest(spark.read.parquet(str(tmp_path / "a"))) != S.files_digest(b)
    assert S.rows_digest(a) == S.rows_digest(b)


def test_an_empty_result_is_a_result(spark, counted):
    build, built = counted
    for _ in range(2):
        assert got(S.resumed("empty", {"rows": table(spark, [])}, {"factor": 2}, build)) == []
    assert built == [2]
