"""Line deduplication that can be taken back: sharded cuckoo filters backed by exact reference counts.

A line's key is the line without blanks at its ends, A-Z in lower case, and goes by a 128-bit digest. The reference-count
table holds, for every key of the corpus, how many documents have it. Each shard of keys has a cuckoo filter of those that
enough documents have. New documents add to the counts, deleted ones take theirs back; only keys that cross the threshold
are put into or taken out of the filters, so after a deletion lines stay that went before. Counts and filters meet once per
update: the few keys that a filter seems to hold although they are too rare are listed, so what the filters and that list say
of any line of the corpus is exact. Documents are then read in one pass against the filters, without a join or a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import read, unused, written

MIN_DOCS, MIN_CHARS = 10, 1
BLANKS = b" \t\n\x0b\x0c\r"
#: Shards of the key space; a power of two.
SHARDS = 64
#: Fingerprints in one bucket, the share of slots that may be taken when a filter is laid out, and turns of moving before it counts as full.
SLOTS, LOAD, TURNS = 4, 0.8, 500
#: Bytes of filters up to which all of them go to every executor; longer ones meet the lines shard by shard.
BROADCAST_BYTES = 64 << 20
#: Counts that a task holds before it gives them on, and parts that the lines of one shard are dealt to.
HELD, PARTS = 300_000, 16

FILTERS = "shard int, buckets int, n long, table binary"


def keys_of(text: bytes | None) -> list[bytes]:
    """The key of every line of a text in UTF-8; a null or empty text has one empty line."""
    return [line.strip(BLANKS) for line in (text or b"").lower().split(b"\n")]


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    return (high.view(np.uint64) & np.uint64(shards - 1)).astype(np.int64)


class Filters:
    """The cuckoo filters of some shards as one flat table of fingerprints, four in a bucket; zero is an empty slot.

    A key may lie in either of two buckets, each of which follows from the other and the fingerprint, so fingerprints can be
    moved without their keys, and a key that was put in can be taken out.
    """

    def __init__(self, shards: int, buckets: dict[int, int], tables: dict[int, bytes] | None = None):
        self.shards = shards
        self.mask, self.first = np.zeros(shards, np.uint32), np.full(shards, -1, np.int64)
        at = 0
        for s, n in sorted(buckets.items()):
            self.mask[s], self.first[s] = n - 1, at
            at += n
        self.table = np.concatenate([np.frombuffer(tables[s], np.uint32) for s in sorted(buckets)] or [np.zeros(0, np.uint32)]).reshape(-1, SLOTS).copy() if tables is not None else np.zeros((at, SLOTS), np.uint32)

    def places(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shards, fingerprints and both buckets within the shard of some keys; the fingerprint's bits are not those of shard or bucket."""
        shard = shard_of(high, self.shards)
        prints = (low.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        prints[prints == 0] = 1
        one = (high.view(np.uint64) >> np.uint64(24)).astype(np.uint32) & self.mask[shard]
        return shard, prints, one, self.other(shard, prints, one)

    def other(self, shard: np.ndarray, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        mixed = prints * np.uint32(0x9E3779B1)
        return bucket ^ ((mixed ^ (mixed >> np.uint32(15))) & self.mask[shard])

    def holds(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Whether each key may be in: never false for one that is."""
        out = np.zeros(len(high), bool)
        known = np.flatnonzero(self.first[shard_of(high, self.shards)] >= 0)
        if len(known):
            shard, prints, one, two = self.places(high[known], low[known])
            first = self.first[shard]
            out[known] = ((self.table[first + one] == prints[:, None]) | (self.table[first + two] == prints[:, None])).any(axis=1)
        return out

    def put(self, high: np.ndarray, low: np.ndarray) -> bool:
        """Adds keys, all of them at once by turns; false if they don't fit, and then the table is of no more use.

        At a turn every waiting fingerprint looks at one bucket. As many as there are free slots stay there; later on, of the
        rest one for each bucket takes the slot of another fingerprint, which must then move to its other bucket.
        """
        shard, prints, bucket, _ = self.places(high, low)
        for turn in range(TURNS):
            if not len(prints):
                return True
            row = self.first[shard] + bucket
            order = np.argsort(row, kind="stable")
            shard, prints, bucket, row = shard[order], prints[order], bucket[order], row[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            free = self.table[row] == 0
            fits = rank < free.sum(axis=1)
            slot = np.argsort(~free, axis=1, kind="stable")[np.arange(len(row)), np.minimum(rank, SLOTS - 1)]
            self.table[row[fits], slot[fits]] = prints[fits]
            shard, prints, bucket, row, rank = (x[~fits] for x in (shard, prints, bucket, row, rank))
            # once both buckets were tried, the first that is left at a full one takes a slot there; the others try their second one
            if turn >= 2:
                head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])[: len(row)])
                place = (prints[head] + np.uint32(turn)) % SLOTS
                out = self.table[row[head], place].copy()
                self.table[row[head], place] = prints[head]
                prints[head] = out
            bucket = self.other(shard, prints, bucket)
        return not len(prints)

    def take(self, high: np.ndarray, low: np.ndarray) -> None:
        """Takes out keys that were put in, one fingerprint for each."""
        shard, prints, one, two = self.places(high, low)
        for s, p, a, b in zip(shard, prints, one, two, strict=True):
            for bucket in (a, b):
                slot = np.flatnonzero(self.table[self.first[s] + bucket] == p)
                if len(slot):
                    self.table[self.first[s] + bucket, slot[0]] = 0
                    break
            else:
                raise RuntimeError("a key was to be taken out of a filter that does not hold it")


def buckets_for(keys: int) -> int:
    """How many buckets a filter of so many keys begins with: a power of two."""
    return 1 << max(0, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))


@dataclass
class LineIndex:
    """counts (high, low, n): in how many documents each key is; filters: a row for each shard that has a key in at least min_docs documents; mistaken (high, low): rarer keys that a filter seems to hold."""

    counts: DataFrame
    filters: DataFrame
    mistaken: DataFrame
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS
    shards: int = SHARDS


def empty(spark: SparkSession, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shards: int = SHARDS) -> LineIndex:
    """An index of no document."""
    nothing = spark.createDataFrame([], "high long, low long, n long")
    return LineIndex(nothing, spark.createDataFrame([], FILTERS), nothing.select("high", "low"), min_docs, min_chars, shards)


def _pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def key_counts(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """Rows (high, low, n): in how many rows of docs each key is. Each task adds up its own documents before anything is shuffled."""

    def kernel(batches):
        held: dict[bytes, int] = {}

        def out():
            pairs = _pairs(list(held))
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(held.values(), pa.int64())], names=["high", "low", "n"])

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                for key in set(keys_of(t)):
                    if long_enough(key, min_chars):
                        d = digest(key)
                        held[d] = held.get(d, 0) + 1
                if len(held) >= HELD:
                    yield out()
                    held = {}
        yield out()

    return docs.select(text).mapInArrow(kernel, "high long, low long, n long").groupBy("high", "low").agg(F.sum("n").alias("n"))


def inserted(index: LineIndex, docs: DataFrame, text: str = "text") -> LineIndex:
    """The index with the rows of docs as further documents; repeated rows count as often as they stand there."""
    return _changed(index, key_counts(docs, text, index.min_chars))


def deleted(index: LineIndex, docs: DataFrame, text: str = "text") -> LineIndex:
    """The index without the rows of docs, which must have been inserted with these texts; anything else is an error."""
    return _changed(index, key_counts(docs, text, index.min_chars).withColumn("n", -F.col("n")))


def _changed(index: LineIndex, change: DataFrame) -> LineIndex:
    least, shards = index.min_docs, index.shards
    both = index.counts.select("high", "low", "n", F.col("n").alias("before")).unionByName(change.withColumn("before", F.lit(0).cast("long")))
    now = written(both.groupBy("high", "low").agg(F.sum("n").alias("n"), F.sum("before").alias("before")), "line-counts")
    if now.where("n < 0").limit(1).count():
        raise ValueError("documents were to be deleted that the index does not hold")
    shard = F.col("high").bitwiseAND(F.lit(shards - 1)).cast("int").alias("shard")
    crossed = now.where((F.col("n") >= least) != (F.col("before") >= least)).select(shard, "high", "low", (F.col("n") >= least).alias("rose"))

    def update(key, old, moves):
        s = key[0].as_py()
        rose = moves.column("rose").to_numpy()
        high, low = (moves.column(c).to_numpy() for c in ("high", "low"))
        if old.num_rows:
            row = old.to_pylist()[0]
            n, own = row["n"], Filters(shards, {s: row["buckets"]}, {s: row["table"]})
        else:
            n, own = 0, Filters(shards, {s: buckets_for(int(rose.sum()))})
        own.take(high[~rose], low[~rose])
        n += int(rose.sum()) - int((~rose).sum())
        fits = n <= SLOTS * len(own.table) * 0.95 and own.put(high[rose], low[rose])
        return _filter_rows(s, own, n, fits)

    moved = written(index.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(update, FILTERS), "filters")
    full = [r["shard"] for r in moved.where("table IS NULL").select("shard").collect()]  # at most as many as there are shards

    def lay_out(key, keys):
        s, buckets = key[0].as_py(), buckets_for(keys.num_rows)
        while True:
            own = Filters(shards, {s: buckets})
            if own.put(keys.column("high").to_numpy(), keys.column("low").to_numpy()):
                return _filter_rows(s, own, keys.num_rows, True)
            buckets *= 2

    filters = moved.where("n > 0 AND table IS NOT NULL")
    if full:
        often = now.where(F.col("n") >= least).select(shard, "high", "low").where(F.col("shard").isin(full))
        filters = written(filters.unionByName(often.groupBy("shard").applyInArrow(lay_out, FILTERS)), "filters")
    counts = now.where("n > 0").select("high", "low", "n")
    rare = counts.where(F.col("n") < least).select("high", "low")
    return LineIndex(counts, filters, written(_seeming(rare, filters, shards), "mistaken"), least, index.min_chars, shards)


def _filter_rows(shard: int, own: Filters, n: int, fits: bool) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "buckets": pa.array([len(own.table)], pa.int32()), "n": pa.array([n], pa.int64()), "table": pa.array([own.table.tobytes() if fits else None], pa.binary())})


def _small(filters: DataFrame) -> bool:
    return (filters.agg(F.sum(F.length("table"))).first()[0] or 0) <= BROADCAST_BYTES


def _loaded(filters: DataFrame, shards: int) -> Filters:
    """All filters; only where _small() holds."""
    rows = filters.collect()
    return Filters(shards, {r["shard"]: r["buckets"] for r in rows}, {r["shard"]: bytes(r["table"]) for r in rows})


def _seeming(rows: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The rows (high, low, ...) that the filters seem to hold."""
    if not _small(filters):
        return _by_shard(rows, filters, shards)
    sent = rows.sparkSession.sparkContext.broadcast(_loaded(filters, shards))

    def kernel(batches):
        for batch in batches:
            yield batch.filter(pa.array(sent.value.holds(batch.column("high").to_numpy(), batch.column("low").to_numpy())))

    return rows.mapInArrow(kernel, rows.schema)


def _by_shard(rows: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """As _seeming(), for filters of any size: rows go to the filter of their shard, dealt in parts so that no hot key fills a task.

    A task keeps one filter at a time; it stands before its rows, as nulls come first.
    """
    names = rows.columns
    dealt = rows.withColumns({"shard": F.col("high").bitwiseAND(F.lit(shards - 1)).cast("int"), "part": F.pmod(F.xxhash64(*names), F.lit(PARTS)).cast("int"), "buckets": F.lit(None).cast("int"), "table": F.lit(None).cast("binary"), "is_row": F.lit(1)})
    held = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), "buckets", "table", F.lit(0).alias("is_row"))
    both = dealt.unionByName(held, allowMissingColumns=True)
    placed = both.repartition(shards * PARTS, "shard", "part").sortWithinPartitions("shard", "part", "is_row")

    def kernel(batches):
        own, key = None, None
        for batch in batches:
            shard, part, is_row = (batch.column(c).to_numpy() for c in ("shard", "part", "is_row"))
            change = np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0) | (np.diff(is_row) != 0)) + 1
            for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
                if a == b:
                    continue
                if not is_row[a]:
                    own, key = Filters(shards, {int(shard[a]): batch.column("buckets")[a].as_py()}, {int(shard[a]): batch.column("table")[a].as_py()}), (shard[a], part[a])
                elif key == (shard[a], part[a]):
                    span = batch.slice(a, b - a).select(names)
                    yield span.filter(pa.array(own.holds(span.column("high").to_numpy(), span.column("low").to_numpy())))

    return placed.mapInArrow(kernel, rows.schema)


def _cut(text: str | bytes | None, drop: set[int]) -> tuple[bytes, int, int]:
    """A text without the lines at some places, the number of its lines and of those that went."""
    lines = (text or b"").split(b"\n")
    return (b"\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else text or b""), len(lines), len(drop)


def deduplicated(index: LineIndex, docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the lines whose key is in at least min_docs documents of the index, and two columns more: n_lines (before) and n_dropped.

    docs must be among what was inserted (all of it or any rows): for these the result is exact. A null text counts as one
    empty line and becomes empty; empty keys, and keys of fewer code points than min_chars, never go. Other columns stay,
    whatever their names; where docs has n_lines or n_dropped, more underscores go before the new ones, which are the last.
    Texts that lose no line stay byte for byte.
    """
    names, shards, min_chars = docs.columns, index.shards, index.min_chars
    own = [unused(docs, n) for n in ("n_lines", "n_dropped")]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in own]])
    at = names.index(text)
    context = docs.sparkSession.sparkContext
    rare = index.mistaken.limit(1_000_001).collect() if _small(index.filters) else None

    def batch_of(batch: pa.RecordBatch, drops: list[set[int]]) -> pa.RecordBatch:
        cut = [_cut(t, d) for t, d in zip(batch.column(at).cast(pa.binary()).to_pylist(), drops, strict=True)]
        columns = list(batch.columns[: len(names)])
        columns[at] = pa.array([c[0] for c in cut], pa.binary()).cast(batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays([*columns, pa.array([c[1] for c in cut], pa.int64()), pa.array([c[2] for c in cut], pa.int64())], names=schema.fieldNames())

    if rare is not None and len(rare) <= 1_000_000:
        sent = context.broadcast((_loaded(index.filters, shards), frozenset((r["high"], r["low"]) for r in rare)))

        def kernel(batches):
            filters, mistaken = sent.value
            for batch in batches:
                of, places, digests = [], [], []
                for row, t in enumerate(batch.column(at).cast(pa.binary()).to_pylist()):
                    for i, key in enumerate(keys_of(t)):
                        if long_enough(key, min_chars):
                            of.append(row)
                            places.append(i)
                            digests.append(digest(key))
                pairs = _pairs(digests)
                drops: list[set[int]] = [set() for _ in range(batch.num_rows)]
                for j in np.flatnonzero(filters.holds(pairs[:, 0].copy(), pairs[:, 1].copy())).tolist():
                    if not mistaken or (int(pairs[j, 0]), int(pairs[j, 1])) not in mistaken:
                        drops[of[j]].add(places[j])
                yield batch_of(batch, drops)

        return docs.mapInArrow(kernel, schema)
    # beyond what every executor can hold, lines go to the filters: (row, place) by shard, and back to their documents
    row, place = unused(docs, "row"), unused(docs, "place")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")

    def lines(batches):
        for batch in batches:
            of, places, digests = [], [], []
            for r, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for i, key in enumerate(keys_of(t)):
                    if long_enough(key, min_chars):
                        of.append(r)
                        places.append(i)
                        digests.append(digest(key))
            pairs = _pairs(digests)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(of, pa.int64()), pa.array(places, pa.int64())], names=["high", "low", "row", "place"])

    asked = numbered.select(row, text).mapInArrow(lines, "high long, low long, row long, place long")
    found = _by_shard(asked, index.filters, shards).join(index.mistaken, ["high", "low"], "left_anti")
    drop = found.groupBy(F.col("row").alias(row)).agg(F.collect_list("place").alias(place))
    joined = numbered.join(drop, row, "left").select(*names, place)

    def cut(batches):
        for batch in batches:
            yield batch_of(batch, [set(d or ()) for d in batch.column(len(names)).to_pylist()])

    return joined.mapInArrow(cut, schema)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = deduplicated(inserted(empty(spark), docs), docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP12_SQL = rf"""
WITH numbered AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
split AS MATERIALIZED (SELECT rid, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM numbered),
keyed AS MATERIALIZED (SELECT rid, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM split),
often AS (SELECT k FROM (SELECT DISTINCT rid, k FROM keyed WHERE length(k) >= {MIN_CHARS}) GROUP BY k HAVING count(*) >= {MIN_DOCS})
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(often.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE often.k IS NULL), '')) AS kept_sha256
FROM keyed JOIN numbered USING (rid) LEFT JOIN often ON keyed.k = often.k GROUP BY rid
"""
