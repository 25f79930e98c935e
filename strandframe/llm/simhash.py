"""Near-duplicates by SimHash fingerprints and a covering family of bit masks.

A covering family for radius r has 2**(r+1)-1 masks. Bit i gets a vector m(i) over GF(2) of r+1 entries, and the mask of
a non-zero vector v holds the bits with <m(i), v> = 1. For any r bits there is a v orthogonal to all their vectors, so two
fingerprints that differ in at most r bits agree under some mask: every linked pair meets in some table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import PARTS, connected_components, grouped_least, read, unused, written

BITS = 64
SEED = 42
#: Free bits whose values bound a bucket.
VALUE_BITS = 11
#: Shingles whose hashes are held at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> bytes:
    """The 8 bytes of a text's fingerprint, the highest bit first; zero for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    digest = xxhash.xxh64_digest
    counts, total = np.zeros(BITS, np.int64), max(1, len(words) - shingle + 1)
    if len(words) < shingle:
        grams: Iterator[tuple] = iter([tuple(words)])
    else:
        grams = zip(*(words[i:] for i in range(shingle)), strict=False)
    join = b" ".join
    done = 0
    while done < total:
        n = min(CHUNK, total - done)
        hashes = b"".join([digest(join(g), SEED) for _, g in zip(range(n), grams, strict=False)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        done += n
    return np.packbits(counts * 2 > total).tobytes()


def masks(radius: int, within: int = (1 << BITS) - 1) -> list[int]:
    """Covering masks over the bits that are set in within: of any radius of these bits, some mask holds none."""
    kinds = 2 ** (radius + 1) - 1
    places = [i for i in range(BITS) if within >> i & 1]
    return [sum(1 << i for n, i in enumerate(places) if bin((1 + n % kinds) & v).count("1") % 2) for v in range(1, kinds + 1)]


def deeper(held: list[int], radius: int) -> list[int]:
    """For each mask those that also cover the bits it leaves free: the family of one more level, in order of the masks."""
    return [m | more for m in held for more in masks(radius, ~m & ((1 << BITS) - 1))]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _stars(bucket: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links from each fingerprint to the least one of its part of the bucket; parts are joined by linked pairs."""
    label = np.arange(len(bucket))
    block = max(1, (1 << 22) // len(bucket))
    while True:
        new = label.copy()
        for at in range(0, len(bucket), block):
            near = np.bitwise_count(bucket[at : at + block, None] ^ bucket[None, :]) <= radius
            new[at : at + block] = np.where(near, label[None, :], len(bucket)).min(axis=1)
        new = np.minimum(new, label)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    signed = bucket.view(np.int64)
    return [(int(signed[i]), int(signed[j])) for i, j in enumerate(label) if i != j]


def with_fingerprints(df: DataFrame, text: str = "text", shingle: int = 3, name: str = "_fp") -> DataFrame:
    """df with the column name: the fingerprint of each whole text, as a signed 64-bit integer."""
    from pyspark.sql.types import LongType, StructField, StructType

    def kernel(batches):
        for b in batches:
            column = b.column(text)
            prints = b"".join(fingerprint(t.as_py(), shingle) for t in column)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.frombuffer(prints, ">i8").astype(np.int64))], names=[*b.schema.names, name])

    return df.mapInArrow(kernel, StructType([*df.schema.fields, StructField(name, LongType())]))


def linked_classes(prints: DataFrame, radius: int = 3, bucket_rows: int = 2048) -> DataFrame:
    """Rows (a, b): links that join the distinct fingerprints of the column fp into their components.

    A bucket of more than bucket_rows distinct fingerprints is dealt anew under masks that also cover the bits its own
    mask leaves free, and so on, until so few bits are free that their values bound a bucket. For radius 3 at most 32, 16
    and 8 bits are free on the first three levels, so a bucket of the third holds 256 fingerprints at most.
    """
    kinds = 2 ** (radius + 1) - 1

    def kernel(batches):
        for b in batches:
            found = [e for fps in b.column(0) for e in _stars(np.sort(np.array(fps.as_py(), np.int64)).view(np.uint64), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    family, dealt, links = masks(radius), prints.select("fp", F.lit(0).alias("path")), None
    while True:
        listed = F.expr("array(" + ", ".join(f"{_signed(m)}L" for m in family) + ")")
        bounded = max(BITS - m.bit_count() for m in family) <= VALUE_BITS
        keys = dealt.select("fp", F.explode(F.expr(f"sequence(path * {kinds}, path * {kinds} + {kinds - 1})")).alias("path")).withColumn("key", F.col("fp").bitwiseAND(F.get(listed, F.col("path"))))
        sizes = written(keys.groupBy("path", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")
        pairs = sizes.where(f"n = 2 AND bit_count(a ^ b) <= {radius}").select("a", "b")
        known = sizes.where("n > 2").select("path", "key", "n", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
        inside = keys.withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(PARTS)).cast("int")).join(known, ["path", "key", "part"])
        whole = inside.where(F.lit(bounded) | (F.col("n") <= bucket_rows)).groupBy("path", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
        found = pairs.union(whole.mapInArrow(kernel, "a long, b long"))
        links = found if links is None else links.union(found)
        if bounded or sizes.where(F.col("n") > bucket_rows).isEmpty():
            return links.distinct()
        dealt = written(inside.where(F.col("n") > bucket_rows).select("fp", "path"), "crowded")
        family = deeper(family, radius)


def _classified(prints: DataFrame, radius: int) -> DataFrame:
    """prints (id, fp) with root, the least fingerprint of the component, and component_id, its smallest id.

    A fingerprint's rows are dealt in parts by their ids; only one row for each part meets the class's component, so the
    copies of one text take no task for themselves.
    """
    dealt = prints.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("short"))
    parts = written(dealt.groupBy("fp", "part").agg(F.min("id").alias("least")), "classes")
    classes = parts.groupBy("fp").agg(F.min("least").alias("least"))
    found = written(connected_components(linked_classes(classes.select("fp"), radius)), "components").toDF("fp", "root")
    rooted = classes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = grouped_least(rooted, "root", "least", "component_id").select("fp", "root", "component_id")
    return dealt.join(parts.select("fp", "part").join(whole, "fp"), ["fp", "part"]).drop("part")


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """Rows (id, fingerprint, component_id), one for each row of df.

    Null and empty texts, and texts of white space only, have the fingerprint zero and are linked like any other. Copies
    share a fingerprint and take part once, by their smallest id. Repeated rows stay repeated. A null id keeps its row and
    is never a component's id unless all its ids are null. An empty table gives an empty result. Other columns of df are
    not looked at, so their names may clash with anything here.
    """
    prints = written(with_fingerprints(df.select(F.col(id).alias("id"), F.col(text).alias("text")), shingle=shingle, name="fp").select("id", "fp"), "prints")
    return _classified(prints, radius).select(F.col("id").alias(id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(df: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """df with one row of each group of near-duplicates: the row of the smallest id.

    Rows are judged by id and fingerprint together, so a row leaves only if it is linked to the one that stays, whatever
    else has its id. Where several rows of the group have the smallest id, the one of the least fingerprint stays, then
    the one of the least text, then of the least hash of the other columns. Rows with a null id stay, as nothing tells
    which of them comes first.
    """
    fp = unused(df, "_fp")
    kept = df.columns
    held = written(with_fingerprints(df, text, shingle, fp), "fingerprinted")
    prints = held.select(F.col(id).alias("id"), F.col(fp).alias("fp"))
    at_least = _classified(prints, radius).where("id = component_id").groupBy("root", "fp").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    first = written(at_least.groupBy("root").agg(F.min(F.struct("fp", "id", "n")).alias("f")).select("f.*"), "representatives")
    right = first.select(F.struct("id", "fp").alias("_right"), "n")
    key = F.struct(F.col(id).alias("id"), F.col(fp).alias("fp"))
    stays = held.where(F.col(id).isNotNull()).join(right, key == F.col("_right"), "left_semi")
    nameless = held.where(F.col(id).isNull()).select(*kept)
    several = right.where("n > 1")
    if several.isEmpty():
        return stays.select(*kept).unionByName(nameless)
    rest = [c for c in kept if c not in (id, text) and "map" not in df.schema[c].dataType.simpleString() and "variant" not in df.schema[c].dataType.simpleString()]
    rank = F.struct(F.col(text), F.xxhash64(*rest) if rest else F.lit(0))
    one = stays.join(several, key == F.col("_right"), "left_semi").groupBy(key.alias("_right")).agg(F.min_by(F.struct(*kept), rank).alias("_row")).select("_row.*")
    return stays.join(several, key == F.col("_right"), "left_anti").select(*kept).unionByName(one).unionByName(nameless)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
