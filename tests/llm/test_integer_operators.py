"""Vector codes, line deduplication and centroid clustering against plain versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def whole(vector, scale):
    return [int(x) * scale if abs(x) >= 2**52 else math.floor(x * scale) for x in map(float, vector)]


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def settle(points, centres, rounds):
    """Plain Lloyd in Python's integers: the final centres and each point's (number, distance)."""
    near = lambda p: min((square(p, c), j) for j, c in enumerate(centres))
    for r in range(rounds + 1):
        at = [near(p) for p in points]
        if r == rounds:
            return centres, [(j, d) for d, j in at]
        own = {j: [p for p, (_, i) in zip(points, at, strict=True) if i == j] for j in range(len(centres))}
        centres = [[sum(v) // len(own[j]) for v in zip(*own[j], strict=True)] if own[j] else c for j, c in enumerate(centres)]


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_codes(rows, entries=64, rounds=2, pieces=16):
    """{(id, code, error, label error)} counted, and the codebooks' digest."""
    rows = [r for r in rows if good(r[1]) and len(r[1]) and len(r[1]) % pieces == 0]
    if not rows:
        return Counter(), None
    length = max(Counter(len(r[1]) for r in rows).items(), key=lambda t: (t[1], t[0]))[0]
    rows = sorted((r for r in rows if len(r[1]) == length), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size, codes, errors, books = length // pieces, [[] for _ in rows], [0] * len(rows), []
    for p in range(pieces):
        points = [whole(r[1], 256)[p * size : (p + 1) * size] for r in rows]
        centres, at = settle(points, points[:entries], rounds)
        books += [v for c in centres for v in c]
        for i, (j, d) in enumerate(at):
            codes[i].append(f"{j:02x}")
            errors[i] += d
    most = 2**63 - 1
    errors = [min(e, most) for e in errors]
    by = Counter()
    for r, e in zip(rows, errors, strict=True):
        by[r[2]] += e
    return Counter((r[0], "".join(c), e, min(by[r[2]], most)) for r, c, e in zip(rows, codes, errors, strict=True)), hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()


def run_codes(spark, rows, **options):
    from strandframe.llm import vector_codes as V

    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string, part int, id int").repartition(3)
    got, books = V.coded(df, **options)
    return Counter(tuple(r) for r in V.with_label_error(got).select("id", "code", "error", "label_error").collect()), V.digest(books)


def test_codes_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(32)], rng.choice([None, 1, 2, 3]), "x", 9, 9) for i in range(400)]
    rows += [(1000 + i, rows[7][1], 5, None, None, None) for i in range(150)]  # a hot vector
    rows += [(2000 + i, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(32)], 6, None, None, None) for i in range(150)]  # many ties
    rows += [(3, rows[9][1], 1, "", 0, 0)] * 2 + [(None, rows[11][1], None, "", 0, 0)]  # repeated and null ids
    rows += [(4000, None, 1, "", 0, 0), (4001, [None] * 32, 1, "", 0, 0), (4002, [float("nan")] * 32, 1, "", 0, 0), (4003, [float("inf")] * 32, 1, "", 0, 0), (4004, [], 1, "", 0, 0), (4005, [0.5] * 16, 1, "", 0, 0), (4006, [0.5] * 33, 1, "", 0, 0)]
    plain = [r[:3] for r in rows]
    for entries, block in ((64, 8192), (64, 50), (5, 97)):
        assert run_codes(spark, rows, entries=entries, block_rows=block) == brute_codes(plain, entries), (entries, block)


def test_codes_of_huge_and_few_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], i % 2, "", 0, 0) for i in range(60)]
    huge = [(100 + i, [rng.choice([1e12, -3e30, 1e300, 0.25, 7.5e9]) for _ in range(16)], 3, "", 0, 0) for i in range(12)]
    assert run_codes(spark, rows + huge, entries=8) == brute_codes([r[:3] for r in rows + huge], 8)
    early = [(-i - 1, *r[1:]) for i, r in enumerate(huge)]  # where the codebooks start
    assert run_codes(spark, rows + early, entries=8) == brute_codes([r[:3] for r in rows + early], 8)
    assert run_codes(spark, rows[:3]) == brute_codes([r[:3] for r in rows[:3]])
    got, _ = run_codes(spark, [])
    assert not got
    with pytest.raises(ValueError):
        run_codes(spark, rows, entries=257)


@pytest.mark.parametrize("leaf", [1, 3, 16])
def test_trees_hold_sums_and_strike_out_only_losers(leaf):
    from strandframe.llm import vector_codes as V

    rng = np.random.default_rng(leaf)
    points = rng.integers(-6, 7, (3, 500, 2))
    books = rng.integers(-6, 7, (3, 30, 2))
    books[:, 20] = books[:, 4]  # equal entries: the lower one wins
    trees = V.Trees.build(points, leaf)
    counts, sums, codes = trees.assign(books)
    want_counts, want_sums, want = V.plain(points, books)
    back = np.empty_like(want)
    for p in range(3):
        back[p, trees.order[p]] = codes[p]
    assert (back == want).all() and (counts == want_counts).all() and (sums == want_sums.astype(np.int64)).all()
    root = trees.total[:, 0]
    assert (root == points.sum(axis=1)).all() and (trees.low[:, 0] == points.min(axis=1)).all()


def test_whole_subtrees_are_assigned_without_their_points(monkeypatch):
    from strandframe.llm import vector_codes as V

    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(0, 5, (1, 400, 4)), rng.integers(1000, 1005, (1, 400, 4))], axis=1)
    books = np.array([[[2, 2, 2, 2], [1002, 1002, 1002, 1002], [5000, 0, 0, 0]]])
    trees = V.Trees.build(points)
    trees.points = np.full_like(trees.points, 10**6)  # if points were read, the sums would tell
    counts, sums, _ = trees.assign(books)
    assert counts.tolist() == [[400, 400, 0]] and sums[0, 0].tolist() == points[0, :400].sum(axis=0).tolist()


def brute_centroids(rows, k=8, rounds=10):
    rows = [r for r in rows if good(r[1]) and len(r[1]) == 64]
    name = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    rows = sorted(rows, key=name)
    points = [whole(r[1], 1024) for r in rows]
    centres, at = settle(points, points[:k], rounds) if rows else ([], [])
    most = 2**63 - 1
    own = Counter()
    for j, d in at:
        own[j] += min(d, most)
    total = min(sum(min(v, most) for v in own.values()), most)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((r[0], j, min(d, most), min(own[j], most), total, digest[j]) for r, (j, d) in zip(rows, at, strict=True))


def run_centroids(spark, rows):
    from strandframe.llm import centroids as C

    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, distance int").repartition(3)
    return Counter(tuple(r) for r in C.with_inertia(*C.clustered(df)).select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def test_centroids_equal_brute_force(spark):
    rng = random.Random(5)
    vector = lambda: [rng.gauss(0, 0.1) for _ in range(64)]
    rows = [(i, vector(), "x", 1) for i in range(120)]
    rows += [(500 + i, rows[0][1], None, None) for i in range(60)] + [(7, rows[3][1], None, None)] * 2 + [(None, vector(), None, None)]
    rows += [(900, None, "", 0), (901, [0.5] * 63, "", 0), (902, [None] * 64, "", 0), (903, [float("nan")] + [0.0] * 63, "", 0), (904, [float("-inf")] * 64, "", 0), (905, [], "", 0)]
    assert run_centroids(spark, rows) == brute_centroids([r[:2] for r in rows])
    assert run_centroids(spark, rows[:3]) == brute_centroids([r[:2] for r in rows[:3]])
    assert run_centroids(spark, []) == Counter()
    huge = rows[:20] + [(1000 + i, [rng.choice([1e300, -1e12, 0.125]) for _ in range(64)], "", 0) for i in range(12)]
    assert run_centroids(spark, huge) == brute_centroids([r[:2] for r in huge])


def test_partial_sums_beyond_a_long_are_exact(spark):
    from strandframe.llm import integers as I

    sums = np.array([[2**200 + 5, -(2**70) - 1, 3], [1, 2, 3]], dtype=object)
    rows = [r for b in I.sum_rows(np.array([2, 0]), sums) for r in b.to_pylist()] * 2
    df = spark.createDataFrame([tuple(r.values()) for r in rows], I.SUMS)
    assert I.means(df, np.zeros((2, 3), np.int64), 2**20).tolist() == [[(2**200 + 5) // 2, (-(2**70) - 1) // 2, 1], [0, 0, 0]]


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_line_dedup", "op13_centroids"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from strandframe.llm import registry

    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name])
    order = [got.columns.index(c[0]) for c in want.description]
    assert Counter(tuple(r[i] for i in order) for r in got.collect()) == Counter(want.fetchall())


def brute_lines(docs, corpus=None, least=10, min_chars=1):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    counts = Counter(k for t in (docs if corpus is None else corpus) for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or counts[key(x)] < least]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def texts(seed, n):
    rng = random.Random(seed)
    line = lambda: rng.choice(["", " ", "Home", "home\t", "\x0bHOME", "ÄÖ über", "äö über", "x" * rng.randint(1, 3), f"line {rng.randint(0, 40)}", f"only {rng.random()}", "\x85", "a\rb", "é"])
    return ["\n".join(line() for _ in range(rng.randint(0, 12))) for _ in range(n)] + [None, "", "\n", "Home", "word " * 100_000 + "\nHome"]


def frame(spark, own, at=0):
    return spark.createDataFrame([(at + i, t, "a", 1, 2) for i, t in enumerate(own)], "doc_id long, text string, n_lines string, high int, row int").repartition(3)


def lines_of(index, df):
    from strandframe.llm import line_dedup as L

    got = L.deduplicated(index, df)
    assert got.columns == [*df.columns, "_n_lines", "n_dropped"]
    return sorted((r["doc_id"], (r["text"], r["_n_lines"], r["n_dropped"])) for r in got.collect())


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_lines_equal_brute_force_at_every_size_of_filters(spark, monkeypatch, most):
    from strandframe.llm import line_dedup as L

    monkeypatch.setattr(L, "BROADCAST_BYTES", most)
    own = texts(1, 300)
    df = frame(spark, own)
    for least, chars in ((10, 1), (3, 1), (2, 3)):
        index = L.inserted(L.empty(spark, min_docs=least, min_chars=chars, shards=8), df)
        assert lines_of(index, df) == list(enumerate(brute_lines(own, least=least, min_chars=chars)))


def test_deletions_undo_insertions(spark):
    from strandframe.llm import line_dedup as L

    first, second = texts(2, 150), texts(3, 150)
    a, b = frame(spark, first), frame(spark, second, 1000)
    alone = L.inserted(L.empty(spark, min_docs=5, shards=8), a)
    both = L.inserted(alone, b)
    want = brute_lines([*first, *second], least=5)
    assert lines_of(both, a.union(b)) == list(zip([*range(len(first)), *range(1000, 1000 + len(second))], want, strict=True))
    back = L.deleted(both, b)
    assert lines_of(back, a) == list(enumerate(brute_lines(first, least=5)))
    assert sorted(back.counts.collect()) == sorted(alone.counts.collect())
    assert {r["shard"]: r["n"] for r in back.filters.collect()} == {r["shard"]: r["n"] for r in alone.filters.collect()}
    nothing = L.deleted(back, a)
    assert not nothing.counts.count() and not nothing.filters.count()
    with pytest.raises(ValueError):
        L.deleted(alone, frame(spark, ["never seen"]))
    none = frame(spark, [])
    assert not L.deduplicated(L.inserted(L.empty(spark), none), none).count()


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_keys_that_a_filter_only_seems_to_hold_stay(spark, monkeypatch, most):
    from strandframe.llm import line_dedup as L

    monkeypatch.setattr(L, "BROADCAST_BYTES", most)
    own = texts(4, 100)
    df = frame(spark, own)
    loose = L.inserted(L.empty(spark, min_docs=1, shards=4), df)  # its filters hold every key
    mistaken = L._seeming(loose.counts.where("n < 10").select("high", "low"), loose.filters, 4)
    assert mistaken.count() == loose.counts.where("n < 10").count() > 0
    assert lines_of(L.LineIndex(loose.counts, loose.filters, mistaken, 10, 1, 4), df) == list(enumerate(brute_lines(own)))


def test_filters_grow_and_forget():
    from strandframe.llm import line_dedup as L

    rng = np.random.default_rng(0)
    keys = rng.integers(-(2**63), 2**63, (20_000, 2))
    own = L.Filters(1, {0: L.buckets_for(20_000)})
    assert own.put(keys[:, 0].copy(), keys[:, 1].copy()) and own.holds(keys[:, 0].copy(), keys[:, 1].copy()).all()
    assert (own.table != 0).sum() == 20_000
    other = rng.integers(-(2**63), 2**63, (200_000, 2))
    assert own.holds(other[:, 0].copy(), other[:, 1].copy()).mean() < 1e-4
    own.take(keys[:500, 0].copy(), keys[:500, 1].copy())
    assert own.holds(keys[500:, 0].copy(), keys[500:, 1].copy()).all() and (own.table != 0).sum() == 19_500
    assert not L.Filters(1, {0: 1024}).put(keys[:, 0].copy(), keys[:, 1].copy())


def test_a_full_filter_is_laid_out_anew(spark):
    from strandframe.llm import line_dedup as L

    few, many = [f"a{i}" for i in range(4)], [f"b{i}" for i in range(3000)]
    index = L.inserted(L.empty(spark, min_docs=2, shards=2), frame(spark, ["\n".join(few)] * 2))
    before = {r["shard"]: r["buckets"] for r in index.filters.collect()}
    df = frame(spark, ["\n".join([*few, *many, "own"])] * 2 + ["own too"])
    index = L.inserted(index, df)
    after = {r["shard"]: r["buckets"] for r in index.filters.collect()}
    assert sum(after.values()) > 100 * sum(before.values())
    assert [x[1][0] for x in lines_of(index, df)] == ["", "", "own too"]
