"""A quality classifier by co-training: one view of a document is its text, the other its metadata.

Each view has a logistic model. Both begin with a bounded sample of labelled documents. In each round the documents of the
whole table on which one view is confident, and those at either end of its own scores, become training rows of the other,
with the view's calibrated probability as their label; their sums of gradients and curvatures are added up in Spark, so
only a matrix and a histogram a view reach the driver. Each view is then calibrated on labelled documents that were
kept apart, and the calibrated views are combined as independent evidence.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import read, unused, written

#: Labelled documents that the first models are fitted on; of more, a hash of the id draws so many, give or take a few hundredths.
LABELLED_ROWS = 20_000
ROUNDS, STEPS = 2, 2
#: A view is confident of a class from this calibrated probability on, where its odds are also so many times the prior's.
CONFIDENT, LIFT = 0.9, 3.0
#: A view that is never so sure still teaches this share of the documents of each class: those at either end of its scores.
ENDS = 0.25
#: Scores are counted by log odds in steps of 1 / LEVELS from -FARTHEST to FARTHEST.
LEVELS, FARTHEST = 500, 16
#: The weight of all pseudo-labels against that of the labelled documents.
PSEUDO_WEIGHT = 0.5
RIDGE = 1e-2
THRESHOLD = 0.5

_PUNCTUATION = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
_BUCKETS = 24


def text_features(text: str | None) -> list[float]:
    """The text view of one whole document."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * N_TEXT
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digits = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[48:58].sum())
    words = data.split()
    distinct = len(set(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    shout = sum(map(bytes.isupper, words))
    return [
        np.log1p(n),
        upper / max(1, upper + lower),
        shout / max(1, len(words)),
        digits / n,
        int(counts[128:].sum()) / n,
        int(counts[[9, 10, 11, 12, 13, 32]].sum()) / n,
        np.log1p(n / max(1, len(words))),
        distinct / max(1, len(words)),
        np.log1p(distinct),
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words) / max(1, len(lines))),
        len(zlib.compress(data, 1)) / n,
        int(counts[_PUNCTUATION].sum()) / n,
        *np.sqrt(counts[_PUNCTUATION] / n).tolist(),
    ]


N_TEXT = 13 + len(_PUNCTUATION)


def page_features(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """The metadata view of one document."""
    size = np.log1p(max(0, n_chars or 0))
    hashed = [0.0] * _BUCKETS
    for kind, value in (("lang", lang), ("source", source)):
        hashed[zlib.crc32(f"{kind}={value}".encode("utf-8", "surrogatepass")) % _BUCKETS] += 1.0
    return [size, size * size / 10, float(n_chars is None), *hashed]


N_PAGE = 3 + _BUCKETS


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


@dataclass
class View:
    """A logistic model over standardised features, with the scale and shift of its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -8, 8)])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.margin(x) + self.shift

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature at the present weights."""
        d = self.design(x)
        p = _sigmoid(d @ self.weights)
        return d.T @ (y - p), (d * (p * (1 - p))[:, None]).T @ d

    def step(self, gradient: np.ndarray, curvature: np.ndarray, rows: float) -> None:
        ridge = np.full(len(self.weights), RIDGE * max(1.0, rows))
        ridge[0] = 1e-6
        move = np.linalg.solve(curvature + np.diag(ridge + 1e-9), gradient - ridge * self.weights)
        self.weights = self.weights + move * min(1.0, 6.0 / (np.abs(move).max() + 1e-12))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling, drawn towards the view as it is, with a slope that is never negative; unchanged without both classes."""
        if len(set(y.tolist())) < 2:
            return
        m = self.margin(x)
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        ab, d, pull = np.array([1.0, 0.0]), np.stack([m, np.ones_like(m)], axis=1), np.array([1.0, 0.1])
        for _ in range(60):
            p = _sigmoid(d @ ab)
            move = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + np.diag(pull), d.T @ (target - p) - pull * (ab - [1.0, 0.0]))
            ab = ab + np.clip(move, -0.5, 0.5)
        self.slope, self.shift = max(0.0, float(ab[0])), float(ab[1])


@dataclass
class CoTrained:
    """Both views and the share of good documents among the labelled."""

    text: View
    page: View
    prior: float
    #: For each step the numbers of pseudo-labels (text's of bad, of good, page's of bad, of good): what each view was given.
    given: list[tuple[int, ...]] = field(default_factory=list)

    def score(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        return _sigmoid(self.text.calibrated(x) + self.page.calibrated(z) - _logit(self.prior))


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


FEATURES = T.StructType([T.StructField("_text", T.ArrayType(T.DoubleType())), T.StructField("_page", T.ArrayType(T.DoubleType()))])


def _features_of(batch: pa.RecordBatch, names: list[str], text: str, meta: tuple[str, str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a batch. A metadata column that the table lacks counts as null."""
    x = np.array([text_features(t.as_py()) for t in batch.column(names.index(text))], float).reshape(-1, N_TEXT)
    columns = [batch.column(names.index(c)).to_pylist() if c in names else [None] * batch.num_rows for c in meta]
    return x, np.array([page_features(*r) for r in zip(*columns, strict=True)], float).reshape(-1, N_PAGE)


META = ("lang", "source", "n_chars")


def featured(df: DataFrame, id: str = "doc_id", text: str = "text", meta: tuple[str, str, str] = META) -> DataFrame:
    """Rows (id, _text, _page): the features of each document."""
    wanted = df.select(id, text, *[c for c in meta if c in df.columns])
    names = wanted.columns

    def kernel(batches):
        for b in batches:
            x, z = _features_of(b, names, text, meta)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64())) for m in (x, z)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["id", *FEATURES.names])

    return wanted.mapInArrow(kernel, T.StructType([T.StructField("id", df.schema[id].dataType), *FEATURES.fields]))


def score_counts(model: CoTrained, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """How many rows have each level of log odds, by the text view and by the page view, flat."""
    levels = [np.rint(np.clip(v.calibrated(m), -FARTHEST, FARTHEST) * LEVELS).astype(int) + FARTHEST * LEVELS for v, m in ((model.text, x), (model.page, z))]
    return np.concatenate([np.bincount(n, minlength=2 * FARTHEST * LEVELS + 1) for n in levels]).astype(float)


def ends(counts: np.ndarray, prior: float) -> list[tuple[float, float]]:
    """For each view the log odds up to which, and from which on, ENDS of the documents of each class stand by their order."""
    out = []
    for c in np.split(counts, 2):
        below = np.cumsum(c)
        low = int(np.searchsorted(below, max(1.0, ENDS * (1 - prior) * below[-1])))
        high = int(np.searchsorted(below, min(below[-1] - 1, (1 - ENDS * prior) * below[-1]), "right"))
        out.append(((low - FARTHEST * LEVELS) / LEVELS, (high - FARTHEST * LEVELS) / LEVELS))
    return out


def taught(logit: np.ndarray, prior: float, bounds: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """The rows that a view with these log odds teaches as bad and as good; no row is both."""
    sure = [(sign * logit >= _logit(CONFIDENT)) & (sign * (logit - _logit(prior)) >= np.log(LIFT)) for sign in (-1, 1)]
    level = np.rint(np.clip(logit, -FARTHEST, FARTHEST) * LEVELS) / LEVELS
    low, high = bounds
    return sure[0] | (level <= low) & (level < high) & ~sure[1], sure[1] | (level >= high) & (level > low) & ~sure[0]


def pseudo_sums(model: CoTrained, x: np.ndarray, z: np.ndarray, bounds: list[tuple[float, float]]) -> np.ndarray:
    """For each view, and for each class that the other view teaches: gradient, curvature and number of those rows, flat.

    Their labels are the other view's probabilities. A row counts by how far its log odds are from the prior's, and in
    full from LIFT on, so a view that is nearly sure of nothing teaches little. The curvature is that at even odds, its
    bound: where the own view is all but sure, its curvature is near 0, and a step by it would go anywhere.
    """
    made = []
    for view, own, other, theirs, at in ((model.text, x, model.page, z, bounds[1]), (model.page, z, model.text, x, bounds[0])):
        logit = other.calibrated(theirs)
        for rows in taught(logit, model.prior, at):
            d, far = view.design(own[rows]), np.minimum(1.0, np.abs(logit[rows] - _logit(model.prior)) / np.log(LIFT))
            g = d.T @ (far * (_sigmoid(logit[rows]) - _sigmoid(d @ view.weights)))
            made += [g, ((d * (far / 4)[:, None]).T @ d).ravel(), np.array([float(rows.sum())])]
    return np.concatenate(made)


def exchange(model: CoTrained, sums: np.ndarray, own: list[tuple[View, np.ndarray]], y: np.ndarray) -> None:
    """One step of each view on its labelled rows and on what the other view teaches.

    Each class weighs among the pseudo-labels what it weighs among the labels; where no row is of one class, the other still counts.
    """
    at, rows, given = 0, float(len(y)), []
    for v, m in own:
        k = len(v.weights)
        g, h = v.sums(m, y)
        parts = []
        for share in (1 - model.prior, model.prior):
            parts.append((share, sums[at : at + k], sums[at + k : at + k + k * k].reshape(k, k), sums[at + k + k * k]))
            at += k + k * k + 1
        weight = PSEUDO_WEIGHT * min(rows, sum(n for *_, n in parts))
        for share, gradient, curvature, n in parts:
            if n > 0:
                g, h = g + weight * share / n * gradient, h + weight * share / n * curvature
            given.append(int(n))
        v.step(g, h, rows + weight)
    model.given.append(tuple(given))


def _added(features: DataFrame, of) -> np.ndarray:
    """of(text features, page features) over all documents, added up in Spark."""
    n = len(of(np.zeros((0, N_TEXT)), np.zeros((0, N_PAGE))))

    def kernel(batches):
        held = np.zeros(n)
        for b in batches:
            held += of(_matrix(b.column(0), N_TEXT), _matrix(b.column(1), N_PAGE))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some])], names=["k", "v"])

    sums = features.select(*FEATURES.names).mapInArrow(kernel, "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))
    out = np.zeros(n)
    for r in sums.collect():  # as many rows as a model has numbers, or a histogram levels
        out[r["k"]] = r["v"]
    return out


def _pseudo_sums(features: DataFrame, model: CoTrained) -> np.ndarray:
    """pseudo_sums() over all documents, with the ends of each view's scores over all documents."""
    bounds = ends(_added(features, lambda x, z: score_counts(model, x, z)), model.prior)
    return _added(features, lambda x, z: pseudo_sums(model, x, z, bounds))


def fit(features: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality", labelled_rows: int = LABELLED_ROWS) -> CoTrained | None:
    """The co-trained model; None where the labelled documents are not of both classes.

    Repeated labels of a document count once, and documents whose labels differ not at all. Null ids and labels are left out.
    """
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo = hi").select("id", (F.col("lo") > 0).cast("double").alias("y"))
    share = min(1.0, labelled_rows / max(1, known.count()))
    drawn = known.withColumn("h", F.xxhash64("id")).where(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < int(share * 1_000_000))
    # where an id is repeated, the least features are those of the sample, so that the model does not depend on the order of rows
    one = drawn.join(features, "id").groupBy("h", "id").agg(F.min("y").alias("y"), F.min(F.struct("_text", "_page")).alias("f"))
    sample = one.select("h", "id", "y", "f.*").orderBy("h", "id").collect()
    y = np.array([r["y"] for r in sample])
    apart = np.array([r["h"] % 5 == 0 for r in sample], bool)
    if len(sample) < 10 or len(set(y[~apart].tolist())) < 2:
        return None
    x, z = np.array([r["_text"] for r in sample]), np.array([r["_page"] for r in sample])
    views = [View(m[~apart].mean(0), m[~apart].std(0) + 1e-6, np.zeros(m.shape[1] + 1)) for m in (x, z)]
    model = CoTrained(*views, float(np.clip(y.mean(), 1e-3, 1 - 1e-3)))
    own = [(v, m[~apart]) for v, m in zip(views, (x, z), strict=True)]
    rows = float((~apart).sum())
    for v, m in own:
        for _ in range(15):
            v.step(*v.sums(m, y[~apart]), rows)
    for turn in range(ROUNDS * STEPS):
        if turn % STEPS == 0:
            for v, m in zip(views, (x, z), strict=True):
                v.calibrate(m[apart], y[apart])
        exchange(model, _pseudo_sums(features, model), own, y[~apart])
    for v, m in zip(views, (x, z), strict=True):
        v.calibrate(m[apart], y[apart])
    return model


def scored(features: DataFrame, model: CoTrained | None, id: str = "doc_id") -> DataFrame:
    """Rows (id, score): the probability that a document is good; 0.5 for all without a model."""
    if model is None:
        return features.select(F.col("id").alias(id), F.lit(0.5).alias("score"))

    def kernel(batches):
        for b in batches:
            s = model.score(_matrix(b.column(1), N_TEXT), _matrix(b.column(2), N_PAGE))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(s, 6))], names=["id", "score"])

    return features.mapInArrow(kernel, T.StructType([features.schema["id"], T.StructField("score", T.DoubleType())])).withColumnRenamed("id", id)


def classified(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (id, score, keep), one for each row of docs.

    Null and empty texts have all-zero text features; null metadata is a value of its own. Without labels of both classes
    every score is 0.5 and every document is kept. Repeated rows stay repeated. Of docs only the id, the text and the
    metadata columns are read.
    """
    features = written(featured(docs, id, text), "features")
    return scored(features, fit(features, labels, id), id).withColumn("keep", F.col("score") >= threshold)


def kept(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without those whose score is below the threshold. The features of each text are made once and written beside it."""
    names = docs.columns
    own = [unused(docs, c) for c in FEATURES.names]

    def both(batches):
        for b in batches:
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64())) for m in _features_of(b, names, text, META)]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists], names=[*names, *own])

    fields = [T.StructField(n, f.dataType) for n, f in zip(own, FEATURES.fields, strict=True)]
    held = written(docs.mapInArrow(both, T.StructType([*docs.schema.fields, *fields])), "featured")
    model = fit(held.select(F.col(id).alias("id"), *[F.col(n).alias(c) for n, c in zip(own, FEATURES.names, strict=True)]), labels, id)
    if model is None:
        return docs

    def kernel(batches):
        for b in batches:
            x, z = _matrix(b.column(len(names)), N_TEXT), _matrix(b.column(len(names) + 1), N_PAGE)
            yield b.select(names).filter(pa.array(np.round(model.score(x, z), 6) >= threshold))

    return held.mapInArrow(kernel, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
