"""Toxicity by cumulative-link ordinal regression on sparse text features.

Model: P(grade <= k) = sigmoid(threshold_k - w . x) with ordered thresholds and one weight vector for
all of them; the output is the expected grade, sum of P(grade > k). Features: log(1 + count) of words
(A-Z lower-cased, runs of letters and digits) and of the first 4, 5, 6 and 7 letters of longer ones, which
serve as stems; scaled to length one per document.

Grades. The labels table only says yes or no. The operator itself takes any number of grades; the
query derives three: 0 for a no, and 1 or 2 for a yes, split at the median of how densely the document uses features that
the labelled sample ties to a yes (log odds over 2, with a smoothing of 1).

Fitting uses a bounded sample of labelled documents, SAMPLE per label, picked by a hash of the
identifier (behaves alike at every size); features of MIN_DOCS sampled documents or more whose share differs between the labels by MIN_SCORE
standard errors get a weight, however many these are. Everything else covers all documents: scoring reads every whole text once, without an
exchange. The cut-off is chosen on the sample as the least expected grade that rejects at most MAX_FALSE of the sampled no-documents in
cross-validation, and at least MIN_CUT, so that clean documents stay.

Defined cases: null and wordless texts have no features and get the grade of an average empty
document; without any labels, or with one kind only, every document gets grade 0 and stays; null labels are ignored; labels said
twice count once, an identifier with both labels is an example of each, and of rows that share a sampled identifier the least text is the example; very
long texts are scored whole, one at a time; an empty table gives an empty result; further columns are untouched, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, durable, rowwise, slices, texts

SAMPLE = 2500
MIN_DOCS = 4
MAX_FALSE = 0.002
MIN_CUT = 0.05
STEMS = 4, 5, 6, 7
MIN_SCORE = 5.0
FOLDS = 3

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def features(text: bytes) -> Counter:
    words = Counter(WORDS(text.lower().decode("utf-8", "replace")))
    out = Counter(words)
    for w, n in words.items():
        for size in STEMS:
            if len(w) > size:
                out["^" + w[:size]] += n
    return out


@dataclass
class Ordinal:
    """weights by word, and the thresholds between grades."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    cut: float = math.inf

    def expected(self, counts: Counter) -> float:
        if not self.thresholds:
            return 0.0
        log = math.log1p
        norm = math.sqrt(sum(log(n) ** 2 for n in counts.values())) or 1.0
        weights = self.weights
        z = sum(weights[w] * log(counts[w]) for w in weights.keys() & counts.keys()) / norm
        return sum(1.0 / (1.0 + math.exp(min(50.0, max(-50.0, t - z)))) for t in self.thresholds)


class Sparse:
    """Rows of (column, value), for products with vectors."""

    def __init__(self, rows: list[dict[int, float]]):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.fromiter((c for r in rows for c in r), np.int64, len(self.row))
        self.val = np.fromiter((v for r in rows for v in r.values()), np.float64, len(self.row))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.row], size)


def sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -50, 50)))


def loss(p: np.ndarray, x: Sparse, grade: np.ndarray, size: int, ridge: float) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood with its ridge, and its gradient. p: weights, first threshold, logs of the gaps between thresholds."""
    levels = len(p) - size
    w, gaps = p[:size], np.exp(p[size + 1 :])
    theta = p[size] + np.concatenate(([0.0], np.cumsum(gaps)))
    z = x.dot(w)
    cdf = np.concatenate((np.zeros((x.n, 1)), sigmoid(theta[None, :] - z[:, None]), np.ones((x.n, 1))), axis=1)
    slope = cdf * (1 - cdf)
    at = np.arange(x.n)
    prob = np.maximum(cdf[at, grade + 1] - cdf[at, grade], 1e-9)
    dz = (slope[at, grade + 1] - slope[at, grade]) / prob / x.n
    dtheta = np.zeros(levels)
    for k in range(levels):
        sign = (grade == k).astype(float) - (grade == k + 1)
        dtheta[k] = -(sign * slope[:, k + 1] / prob).sum() / x.n
    tail = np.cumsum(dtheta[::-1])[::-1]
    g = np.concatenate((x.back(dz, size) + ridge * w, tail[:1], tail[1:] * gaps))
    return float(-np.log(prob).mean() + ridge * (w @ w) / 2), g


def fit(x: Sparse, grade: np.ndarray, size: int, rounds: int = 150, rate: float = 0.3, ridge: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam."""
    levels = int(grade.max(initial=0))
    share = [np.clip((grade <= k).mean(), 0.01, 0.99) for k in range(levels)]
    start = np.log(np.array(share) / (1 - np.array(share)))
    p = np.concatenate((np.zeros(size), start[:1], np.log(np.maximum(np.diff(start), 0.05))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        _, g = loss(p, x, grade, size, ridge)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return p[:size], p[size] + np.concatenate(([0.0], np.cumsum(np.exp(p[size + 1 :]))))


def train(rows: list[dict[int, float]], grade: np.ndarray, known: list[str]) -> Ordinal:
    """The model of a labelled sample, its cut-off by cross-validation. rows: values by column of known."""
    if not known or len(rows) == 0 or grade.max(initial=0) == 0 or (grade > 0).all():
        return Ordinal()
    fold = np.arange(len(rows)) % FOLDS
    out = np.zeros(len(rows))
    levels = int(grade.max())
    for f in range(FOLDS):
        w, theta = fit(Sparse([r for r, k in zip(rows, fold, strict=True) if k != f]), grade[fold != f], len(known))
        z = Sparse([r for r, k in zip(rows, fold, strict=True) if k == f]).dot(w)
        out[fold == f] = (1 / (1 + np.exp(np.clip(theta[None, :] - z[:, None], -50, 50)))).sum(axis=1)
    clean = np.sort(out[grade == 0])
    cut = max(MIN_CUT * levels, clean[min(len(clean) - 1, int(len(clean) * (1 - MAX_FALSE)))])
    w, theta = fit(Sparse(rows), grade, len(known))
    return Ordinal({t: float(w[k]) for k, t in enumerate(known) if abs(w[k]) > 1e-4}, theta.tolist(), float(cut))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, per_label: int) -> DataFrame:
    """id, y and text of at most per_label labelled documents of each label, the first in the order of a hash."""
    named = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).dropna().distinct()
    here = named.join(docs.select(F.col(id_col).cast("long").alias("id")), "id", "left_semi")
    drawn = [here.filter(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(per_label) for k in (0, 1)]
    found = texts(docs, id_col, text_col).toDF("id", "text").join(F.broadcast(drawn[0].union(drawn[1])), "id")
    return found.groupBy("id", "y").agg(F.min("text").alias("text"))


def informative(counted: DataFrame) -> list[tuple[str, int, int]]:
    """Features whose documents' share differs between the labels by MIN_SCORE standard errors, the strongest first, with their documents by label."""
    m, n = (counted.filter(F.col("y") == k).count() for k in (0, 1))
    if not n or not m:
        return []
    seen = counted.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("k")).filter(F.col("k") >= MIN_DOCS)
    b, share = F.col("k") - F.col("a"), F.col("k") / (n + m)
    strength = F.abs(F.col("a") / n - b / m) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / n + 1 / m))
    top = seen.withColumn("s", strength).filter(F.col("s") >= MIN_SCORE).orderBy(F.col("s").desc(), "w")
    return [(r["w"], r["a"], r["k"] - r["a"]) for r in top.collect()]


def model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Ordinal:
    """Features are counted and picked on the executors; the driver gets the picked ones of the sample only."""
    schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))])

    def count(ids, bodies, ys):
        for i, body, y in zip(ids, bodies, ys, strict=True):
            c = features(body)
            yield i, y, list(c), list(c.values())

    found = sample(docs, labels, label_col, id_col, text_col, SAMPLE).select("id", "text", "y")
    counted = durable(found.mapInArrow(rowwise(count, schema), "id long, y int, words array<string>, counts array<int>"))
    known = informative(counted)
    n, m = (counted.filter(F.col("y") == k).count() for k in (1, 0))
    column = {w: k for k, (w, _, _) in enumerate(known)}
    telling = {k for k, (_, a, b) in enumerate(known) if math.log((a + 1) / (n + 2)) - math.log((b + 1) / (m + 2)) > 2.0}
    picked = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("columns", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("density", pa.float64())])

    def pick(ids, ys, words, counts):
        for i, y, w, c in zip(ids, ys, words, counts, strict=True):
            norm = math.sqrt(sum(math.log1p(k) ** 2 for k in c)) or 1.0
            own = [(column[x], k) for x, k in zip(w, c, strict=True) if x in column]
            yield i, y, [x for x, _ in own], [math.log1p(k) / norm for _, k in own], sum(k for x, k in own if x in telling) / max(1, sum(c))

    rows = counted.mapInArrow(rowwise(pick, picked), "id long, y int, columns array<int>, values array<double>, density double").collect()  # a row a sampled document
    discard(counted)
    rows.sort(key=lambda r: (r["id"], r["y"], r["density"]))
    rows = [rows[k] for k in np.random.default_rng(0).permutation(len(rows))]  # labels mixed over the folds
    yes = np.array([r["y"] == 1 for r in rows], bool)
    density = np.array([r["density"] for r in rows])
    middle = np.median(density[yes]) if yes.any() else 0.0
    grade = np.where(yes, 1 + (density > middle), 0).astype(np.int64)
    return train([dict(zip(r["columns"], r["values"], strict=True)) for r in rows], grade, [w for w, _, _ in known])


def score(docs: DataFrame, fitted: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, expected severity, and rejected, of every row."""
    schema = pa.schema([("id", pa.int64()), ("severity", pa.float64()), ("rejected", pa.bool_())])

    def kernel(ids, bodies):
        for i, body in zip(ids, bodies, strict=True):
            e = fitted.expected(features(body))
            yield i, e, e > fitted.cut

    return texts(docs, id_col, text_col).mapInArrow(rowwise(kernel, schema), "id long, severity double, rejected boolean")


def keep_clean(docs: DataFrame, fitted: Ordinal, text_col: str = "text") -> DataFrame:
    """The rows that are not rejected, with the input's columns. Rows are judged by their text alone, in place."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, 8 << 20):
                mask = [fitted.expected(features(b or b"")) <= fitted.cut for b in piece.column(text_col).cast(pa.binary()).to_pylist()]
                yield piece.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fitted = model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, fitted).select(F.col("id").alias("doc_id"), F.col("severity").alias("expected_severity"), F.col("rejected").alias("toxic"))
