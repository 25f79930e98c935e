"""Stages that a later run takes up again: their tables stand under a key of what went in, and count only once they are committed."""

from __future__ import annotations

import functools
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file that names the table of a committed stage.
COMMIT = "_committed"


def rows_digest(df: DataFrame) -> str:
    """A digest of the columns and rows of df, repeats included, whatever their order and partitions: sums and XORs of two hashes, added up before a shuffle."""
    names = sorted(df.columns)
    own = df.select(F.xxhash64(*names).alias("h"), F.xxhash64(F.lit(1), *names).alias("g"))
    sums = own.agg(F.count("*"), F.bit_xor("h"), F.bit_xor("g"), F.sum(F.col("h").cast("decimal(38,0)")), F.sum(F.col("g").cast("decimal(38,0)"))).first()
    schema = [(n, df.schema[n].dataType.simpleString()) for n in names]
    return hashlib.sha256(repr((schema, [str(x) for x in sums])).encode()).hexdigest()


def files_digest(df: DataFrame) -> str:
    """A digest of the names, sizes and times of the files that a plain scan reads, for inputs that are too large to be read for it."""
    own = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    schema = [(f.name, f.dataType.simpleString()) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return hashlib.sha256(repr((schema, rows_digest(own))).encode()).hexdigest()


def content_key(name: str, inputs: dict[str, DataFrame], parameters: dict, version: str = "1", digest: Callable[[DataFrame], str] = rows_digest) -> str:
    """The key of a stage by its name, the version of its code, its parameters (as JSON, in any order) and the digests of its inputs."""
    said = json.dumps([name, version, parameters, {k: digest(v) for k, v in inputs.items()}], sort_keys=True)
    return hashlib.sha256(said.encode()).hexdigest()


@functools.cache
def _local_folder(application: str) -> str:
    """One folder for a local session without spark.checkpoint.dir, as in tests; stages last as long as it does."""
    return tempfile.mkdtemp(prefix="stages-")


class _Folder:
    """The folder of one stage's tables, on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = _local_folder(spark.sparkContext.applicationId)
        self.path = f"{root}/strandframe/stages/{name}"
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def committed(self, key: str) -> str | None:
        """The table that the key's commit names, if it has one and that table stands whole."""
        mark = self._new(f"{self.path}/{key}/{COMMIT}")
        if not self._fs.exists(mark):
            return None
        stream = self._fs.open(mark)
        try:
            table = f"{self.path}/{key}/{bytes(stream.readAllBytes()).decode()}"
        finally:
            stream.close()
        return table if self._fs.exists(self._new(f"{table}/_SUCCESS")) else None

    def commit(self, key: str, table: str) -> None:
        """Names the table in a file of another name, which then is renamed: a run that dies before leaves no commit."""
        draft, mark = self._new(f"{self.path}/{key}/_draft-{uuid.uuid4().hex}"), self._new(f"{self.path}/{key}/{COMMIT}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(table.encode()))
        finally:
            stream.close()
        if self.committed(key) is None and self._fs.exists(mark):
            self._fs.delete(mark, False)
        if not self._fs.rename(draft, mark):  # another run of the same key was first, with the same rows
            self._fs.delete(draft, False)

    def entries(self, path: str) -> list[str]:
        place = self._new(path)
        return [s.getPath().getName() for s in self._fs.listStatus(place)] if self._fs.exists(place) else []

    def remove(self, path: str) -> None:
        self._fs.delete(self._new(path), True)


def resumed(name: str, inputs: dict[str, DataFrame], parameters: dict, build: Callable[..., DataFrame], version: str = "1", digest: Callable[[DataFrame], str] = rows_digest) -> DataFrame:
    """build(**inputs, **parameters) as a table, or the table of an earlier run of the same key.

    The table is written to a folder of its own and committed after it stands whole, so a run that was killed leaves nothing
    that a later one would take for a result; two runs at once each write their own, and the first commit counts. build must
    give the same rows for the same inputs and parameters. inputs must not be empty.
    """
    spark = next(iter(inputs.values())).sparkSession
    folder, key = _Folder(spark, name), content_key(name, inputs, parameters, version, digest)
    table = folder.committed(key)
    if table is None:
        own = f"table-{uuid.uuid4().hex}"
        build(**inputs, **parameters).write.parquet(f"{folder.path}/{key}/{own}")
        folder.commit(key, own)
        table = folder.committed(key)
    return spark.read.parquet(table)


def swept(spark: SparkSession, name: str, keep: set[str]) -> int:
    """Removes the tables of a stage under other keys than those to keep, and what uncommitted runs left under these; how many folders went. Not for use while a run of the stage is going on."""
    folder, gone = _Folder(spark, name), 0
    for key in folder.entries(folder.path):
        table = folder.committed(key)
        if key not in keep or table is None:
            folder.remove(f"{folder.path}/{key}")
            gone += 1
            continue
        for entry in folder.entries(f"{folder.path}/{key}"):
            if entry != COMMIT and not table.endswith("/" + entry):
                folder.remove(f"{folder.path}/{key}/{entry}")
                gone += 1
    return gone
