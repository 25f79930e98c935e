"""Vector code compression: product codes trained by the filtering form of Lloyd's algorithm.

Vectors are cut into parts, and each position of a part has a codebook. Every partition builds kd-trees over its parts, one
tree for each position and block of rows, with the box, sum and count of every node; they are written once and serve all
rounds. To assign, the entries go down the trees: at a node an entry is struck out if no point of the box can be nearest to
it, and where one entry is left the whole subtree is its own, by the node's sum, without a look at its points. A round
shuffles sums by entry only. Ties go to the lower index: an entry that is as near as another at one corner only is kept
unless its index is the higher one, so results are those of comparing each part with every entry.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .integers import MOST, SUMS, capped_sum, finite, floors, longs, means, sum_rows
from .support import PARTS, read, written

PIECES, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that share trees, by the memory of a task, and points of a leaf.
BLOCK_ROWS, LEAF = 8192, 16
#: Nodes that are compared with all entries at once, and points of leaves.
NODES, POINTS = 2048, 8192


def bounds_of(n: int, leaf: int = LEAF) -> list[np.ndarray]:
    """For every level of a tree over n points, where its nodes begin and the last one ends; each level halves the nodes before."""
    out = [np.array([0, n])]
    while np.diff(out[-1]).max() > leaf:
        b = out[-1]
        out.append(np.sort(np.concatenate([b, (b[:-1] + b[1:]) // 2])))
    return out


class Trees:
    """The kd-trees of a block: points (pieces, rows, components) in the order of the leaves, and what is known of every node."""

    def __init__(self, points: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, total: np.ndarray, leaf: int = LEAF):
        self.points, self.order, self.low, self.high, self.total = points, order, low, high, total
        self.levels = bounds_of(points.shape[1], leaf)

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> Trees:
        """Nodes are cut at the middle point along the longest side of their box."""
        pieces, n, _ = points.shape
        order = np.tile(np.arange(n), (pieces, 1))
        levels = bounds_of(n, leaf)
        for b in levels[:-1]:
            node = np.repeat(np.arange(len(b) - 1), np.diff(b))
            side = (np.maximum.reduceat(points, b[:-1], axis=1) - np.minimum.reduceat(points, b[:-1], axis=1)).argmax(axis=2)
            key = np.take_along_axis(points, side[:, node][:, :, None], axis=2)[:, :, 0]
            rank = np.lexsort((key, np.broadcast_to(node, key.shape)), axis=-1)
            points, order = np.take_along_axis(points, rank[:, :, None], axis=1), np.take_along_axis(order, rank, axis=1)
        every = lambda f: np.concatenate([f.reduceat(points, b[:-1], axis=1) for b in levels], axis=1)
        return cls(points, order, every(np.minimum), every(np.maximum), every(np.add), leaf)

    def assign(self, books: np.ndarray, want_codes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Counts (pieces, entries), sums (pieces, entries, components) and, if wanted, the codes (pieces, rows) in the order of the leaves."""
        pieces, n, size = self.points.shape
        entries = books.shape[1]
        counts, sums = np.zeros((pieces, entries), np.int64), np.zeros((pieces, entries, size), np.int64)
        codes = np.zeros((pieces, n), np.uint8 if entries <= 256 else np.int32)
        piece, node, first = np.arange(pieces), np.zeros(pieces, np.int64), 0
        open_ = np.ones((pieces, entries), bool)
        for depth, b in enumerate(self.levels):
            last = depth == len(self.levels) - 1
            for at in range(0, len(piece), NODES):
                part = slice(at, at + NODES)
                open_[part] = _possible(self.low[piece[part], first + node[part]], self.high[piece[part], first + node[part]], books[piece[part]], open_[part])
            alone = open_.sum(axis=1) == 1
            p, owner, i = piece[alone], open_[alone].argmax(axis=1), node[alone]
            np.add.at(counts, (p, owner), b[i + 1] - b[i])
            np.add.at(sums, (p, owner), self.total[p, first + i])
            if want_codes:
                many, place = _places(b[i], b[i + 1])
                codes[np.repeat(p, many), place] = np.repeat(owner, many)
            piece, node, open_ = piece[~alone], node[~alone], open_[~alone]
            if last:
                break
            first += len(b) - 1
            piece, node, open_ = np.repeat(piece, 2), np.stack([2 * node, 2 * node + 1], axis=1).ravel(), np.repeat(open_, 2, axis=0)
        b = self.levels[-1]
        step = max(1, POINTS // max(1, int(np.diff(b).max())))
        for at in range(0, len(piece), step):
            p, i, left = piece[at : at + step], node[at : at + step], open_[at : at + step]
            few = int(left.sum(axis=1).max())
            entry = np.argsort(~left, axis=1, kind="stable")[:, :few]  # those left, in ascending order
            many, place = _places(b[i], b[i + 1])
            of, p = np.repeat(np.arange(len(i)), many), np.repeat(p, many)
            far = ((self.points[p, place][:, None, :].astype(np.int64) - books[p[:, None], entry[of]]) ** 2).sum(axis=2)
            far[~np.take_along_axis(left, entry, axis=1)[of]] = MOST
            code = entry[of, far.argmin(axis=1)]
            np.add.at(counts, (p, code), 1)
            np.add.at(sums, (p, code), self.points[p, place])
            codes[p, place] = code
        return counts, sums, codes if want_codes else None


def _places(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of some spans, and the places in them, one span after the other."""
    many = end - begin
    return many, np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())


def _possible(low: np.ndarray, high: np.ndarray, books: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Which of the open entries of each node can be nearest to a point of its box: low, high (nodes, components), books (nodes, entries, components)."""
    low, high = low[:, None, :].astype(np.int64), high[:, None, :].astype(np.int64)
    middle = ((2 * books - low - high) ** 2).sum(axis=2)
    middle[~open_] = MOST
    best = middle.argmin(axis=1)
    chosen = books[np.arange(len(best)), best][:, None, :]
    corner = np.where(books > chosen, high, low)  # of the box, the farthest towards the entry and away from the chosen one
    own, other = ((books - corner) ** 2).sum(axis=2), ((chosen - corner) ** 2).sum(axis=2)
    return open_ & ((own < other) | ((own == other) & (np.arange(books.shape[1]) <= best[:, None])))


def plain(points: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As assign(), by comparing every part with every entry in Python's integers: for numbers whose squares 64 bits can't hold."""
    points, books = points.astype(object), books.astype(object)
    pieces, n, size = points.shape
    counts, sums, codes = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, object), np.zeros((pieces, n), np.int64)
    for p in range(pieces):
        far = np.stack([((points[p] - e) ** 2).sum(axis=1) for e in books[p]])
        codes[p] = far.argmin(axis=0)
        for c in np.unique(codes[p]):
            counts[p, c], sums[p, c] = (codes[p] == c).sum(), points[p][codes[p] == c].sum(axis=0)
    return counts, sums, codes


def _forest_schema(id: T.DataType, label: T.DataType) -> T.StructType:
    kinds = {"n": T.IntegerType(), "size": T.IntegerType(), "kind": T.StringType(), "ids": T.ArrayType(id), "labels": T.ArrayType(label), **dict.fromkeys(("points", "perm", "low", "high", "total"), T.BinaryType())}
    return T.StructType([T.StructField(n, t) for n, t in kinds.items()])


def forest(rows: DataFrame, pieces: int, scale: int, most: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (id, label, vector) as blocks with their trees, in shared storage: no row moves, each partition cuts its own blocks.

    Vectors with a component beyond most go to blocks of kind "wide", without trees.
    """
    schema = _forest_schema(rows.schema["id"].dataType, rows.schema["label"].dataType)

    def block(table: pa.Table, x: np.ndarray) -> pa.RecordBatch:
        n, size = len(x), x.shape[1] // pieces
        whole = floors(x, scale, most)
        if whole.dtype == object:
            kind, own = "wide", [x.astype("<f8").tobytes(), b"", b"", b"", b""]
        else:
            kind = "<i2" if np.abs(whole).max() < 2**15 else "<i4" if np.abs(whole).max() < 2**31 else "<i8"
            t = Trees.build(np.ascontiguousarray(whole.reshape(n, pieces, size).transpose(1, 0, 2)))
            own = [a.astype(k).tobytes() for a, k in ((t.points, kind), (t.order, "<u4"), (t.low, kind), (t.high, kind), (t.total, "<i8"))]
        held = [table.column(c).combine_chunks() for c in ("id", "label")]
        held = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c) for c in held]
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([size], pa.int32()), pa.array([kind]), *held, *[pa.array([o], pa.binary()) for o in own]], names=schema.fieldNames())

    def blocks(batches) -> Iterator[pa.RecordBatch]:
        waiting: dict[bool, list[pa.Table]] = {False: [], True: []}

        def cut(wide: bool, least: int) -> Iterator[pa.RecordBatch]:
            held = pa.concat_tables(waiting[wide]) if waiting[wide] else None
            while held is not None and held.num_rows >= max(1, least):
                part, held = held.slice(0, block_rows), held.slice(block_rows)
                part = part.combine_chunks()
                vectors = part.column("vector").combine_chunks()
                vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
                yield block(part, vectors.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
            waiting[wide] = [held] if held is not None and held.num_rows else []

        for batch in batches:
            if batch.num_rows:
                x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                wide = np.abs(x.astype(np.float64)).max(axis=1) > (most - 1) / scale
                for kind in (False, True):
                    if (wide == kind).any():
                        waiting[kind].append(pa.Table.from_batches([batch.filter(pa.array(wide == kind))]))
                        if sum(t.num_rows for t in waiting[kind]) >= block_rows:
                            yield from cut(kind, block_rows)
        for kind in (False, True):
            yield from cut(kind, 1)

    return written(rows.select("id", "label", "vector").mapInArrow(blocks, schema), "trees")


def _assigned(row: dict, books: np.ndarray, pieces: int, scale: int, most: int, want_codes: bool) -> tuple:
    """Counts, sums, codes (rows, pieces) and errors (rows) of a block."""
    n, size = row["n"], row["size"]
    if row["kind"] != "wide":
        shape = lambda name, kind: np.frombuffer(row[name], kind).reshape(pieces, -1, size)
        trees = Trees(shape("points", row["kind"]), np.frombuffer(row["perm"], "<u4").reshape(pieces, n), shape("low", row["kind"]), shape("high", row["kind"]), shape("total", "<i8"))
        points, order = trees.points, trees.order
    else:
        points = floors(np.frombuffer(row["points"], "<f8"), scale, most).reshape(n, pieces, size).transpose(1, 0, 2)
        order, trees = np.tile(np.arange(n), (pieces, 1)), None
    easy = trees is not None and books.dtype != object
    counts, sums, codes = trees.assign(books, want_codes) if easy else plain(points, books)
    if not want_codes:
        return counts, sums, None, None
    back, error = np.zeros((n, pieces), np.uint8 if books.shape[1] <= 256 else np.int32), np.zeros(n, np.int64 if easy else object)
    for p in range(pieces):
        back[order[p], p] = codes[p]
        error[order[p]] += ((points[p].astype(np.int64 if easy else object) - books[p][codes[p].astype(np.int64)]) ** 2).sum(axis=1)
    return counts, sums, back, longs(error)


def coded(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", pieces: int = PIECES, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, np.ndarray]:
    """Rows (id, label, code, error, part) of every vector that can be cut, and the final codebooks (pieces, entries, components of a part).

    Vectors that are null or hold a null or non-finite component go, and so do those of another number of components than
    the commonest one among those that can be cut into equal pieces (ties to the larger number): no codebook fits them.
    Components become floor(scale * x). Repeated rows and ids all take part, each row by itself; null ids come last where the
    codebooks start, equal ids in the order of their vectors. Fewer vectors than entries give as many entries; none give no
    rows. Sums and comparisons are exact at any size; an error beyond a long is given as the largest long. entries is 256 at
    most, as a code has two hex digits for each part; part deals the rows of one label.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    spark = vectors.sparkSession
    rows = finite(vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")), "vector")
    common = rows.groupBy(F.size("vector").alias("n")).count().where((F.col("n") > 0) & (F.col("n") % pieces == 0)).orderBy(F.desc("count"), F.desc("n")).first()
    length = common["n"] if common else pieces
    rows = rows.where(F.size("vector") == length)
    size = length // pieces
    most = math.isqrt(2**58 // size)
    begin = np.array([r["vector"] for r in rows.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()], np.float64).reshape(-1, length)
    books = np.ascontiguousarray(floors(begin, scale, most).reshape(-1, pieces, size).transpose(1, 0, 2))
    trees = forest(rows, pieces, scale, most, block_rows)
    n_entries = books.shape[1]

    def sums_with(sent):
        def kernel(batches):
            count, total = np.zeros((pieces, n_entries), np.int64), np.zeros((pieces, n_entries, size), object)
            for batch in batches:
                for i in range(batch.num_rows):
                    c, s, _, _ = _assigned(batch.slice(i, 1).to_pylist()[0], sent.value, pieces, scale, most, False)
                    count, total = count + c, total + s.astype(object)
            yield from sum_rows(count.ravel(), total.reshape(-1, size))

        return kernel

    for _ in range(rounds if n_entries else 0):
        sent = spark.sparkContext.broadcast(books)
        books = means(trees.select("n", "size", "kind", "points", "perm", "low", "high", "total").mapInArrow(sums_with(sent), SUMS), books.reshape(-1, size), most).reshape(books.shape)
        sent.destroy()
    last = spark.sparkContext.broadcast(books)
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("label", rows.schema["label"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("part", T.IntegerType())])

    def assign(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = {c: one.column(c)[0].as_py() for c in ("n", "size", "kind", "points", "perm", "low", "high", "total")}
                _, _, codes, error = _assigned(row, last.value, pieces, scale, most, True)
                n = row["n"]
                code = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(np.arange(0, 2 * pieces * n + 1, 2 * pieces, dtype=np.int32)), pa.py_buffer(codes.tobytes().hex().encode())])
                yield pa.RecordBatch.from_arrays([one.column("ids").flatten(), one.column("labels").flatten(), code, pa.array(error), pa.array(np.arange(n) % PARTS, pa.int32())], names=schema.fieldNames())

    return written(trees.mapInArrow(assign, schema), "coded"), books


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows (id, label, code, error, part) with label_error, error added up over equal labels, nulls together.

    A label's rows meet its sum in parts, and only one row for each part meets the label's own, so a hot label takes no task
    for itself and nothing is broadcast that grows with the number of labels.
    """
    parts = rows.groupBy("label", "part").agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("s"))
    whole = parts.groupBy(F.col("label").alias("_of")).agg(F.least(F.sum("s"), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    known = parts.join(whole, F.col("label").eqNullSafe(F.col("_of"))).select(F.col("label").alias("_of"), F.col("part").alias("_at"), "label_error")
    return rows.join(known, F.col("label").eqNullSafe(F.col("_of")) & (F.col("part") == F.col("_at"))).drop("_of", "_at")


def digest(books: np.ndarray) -> str:
    """The lowercase-hex sha256 of all entries' components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = coded(read(spark, sf_dir, "embeddings"))
    return with_label_error(rows).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(pieces: int = PIECES, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same rows from the rule, every part compared with every entry."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT rid, q, j, d FROM (SELECT rid, q, j, d, row_number() OVER (PARTITION BY rid, q ORDER BY d, j) AS o FROM "
            f"(SELECT rid, q, j, sum((points.x - b.x) * (points.x - b.x)) AS d FROM points JOIN b{r} AS b USING (q, i) GROUP BY rid, q, j)) WHERE o = 1)"
        )
        if r < rounds:
            steps.append(
                f"b{r + 1} AS MATERIALIZED (SELECT b.q, b.j, b.i, CASE WHEN n IS NULL THEN b.x ELSE CAST((s - ((s % n + n) % n)) / n AS BIGINT) END AS x FROM b{r} AS b LEFT JOIN "
                f"(SELECT q, j, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM points JOIN a{r} USING (rid, q) GROUP BY q, j, i) USING (q, j, i))"
            )
    return f"""
WITH numbered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, embedding, len(embedding) AS w FROM embeddings),
spread AS MATERIALIZED (SELECT rid, vec_id, label, w, unnest(range(0, w)) AS p, unnest(embedding) AS x FROM numbered WHERE w % {pieces} = 0),
sound AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(label) AS label, any_value(w) AS w FROM spread GROUP BY rid HAVING bool_and(x IS NOT NULL AND isfinite(x))),
kept AS MATERIALIZED (SELECT rid, vec_id, label FROM sound WHERE w = (SELECT w FROM sound GROUP BY w ORDER BY count(*) DESC, w DESC LIMIT 1)),
points AS MATERIALIZED (SELECT rid, p // (w // {pieces}) AS q, p % (w // {pieces}) AS i, CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM spread SEMI JOIN kept USING (rid)),
chosen AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, rid) - 1 AS j FROM kept),
b0 AS MATERIALIZED (SELECT q, j, i, x FROM chosen JOIN points USING (rid) WHERE j < {entries}),
{", ".join(steps)},
own AS MATERIALIZED (SELECT rid, string_agg(printf('%02x', j), '' ORDER BY q) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY q, j, i)) FROM b{rounds}) AS codebooks_sha256
FROM own JOIN kept USING (rid)
"""
