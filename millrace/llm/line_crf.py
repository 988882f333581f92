"""Document quality by a linear-chain conditional random field over lines.

Each line is described by features of itself and of the lines before and behind it; the field labels every line good
or bad, with a weight for each pair of labels of neighbouring lines. The forward-backward marginals of the lines,
weighted by their lengths, give the document's mean, and a logistic curve over that mean and the share of the worst
lines gives its score.

Learning: documents carry labels, lines don't. A line first takes its document's label; after a first fit, lines of
bad documents that look good on their own become good, and the field is fitted again. The fit is on a sample of at
most `DOCS_PER_LABEL` labelled documents of each label, those with the smallest hashes of their ids, with all their
lines; nothing else is sampled, and every line of every text is scored.

Defined results: a text that is null or empty has one empty line and a score like any other; lines of no length weigh
nothing unless all are; very long texts and lines are scored whole; equal texts have equal scores, so repeated rows and
ids have; of several texts of one id that with the least digest teaches, and of ids with equal hashes the least come
first; without labels of both kinds every score is the share of good ones (1 without labels); an empty table gives no
rows; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_column, cut, held_out, span_hashes, table

DOCS_PER_LABEL, LINES_PER_LABEL, THRESHOLD = 2500, 250_000, 0.7

#: Classes of bytes.
UPPER, LOWER, DIGIT, BLANK, SIGN, PIPE, BANG, POINT, HIGH, OTHER, N_CLASSES = range(11)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[128:] = HIGH
for _chars, _kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), (b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"0123456789", DIGIT), (b" \t\r\n\x0b\x0c", BLANK), (b"#$%&*@^~<>{}[]\\=+_`/", SIGN), (b"|", PIPE), (b"!", BANG), (b".,;:?", POINT)):
    CLASS[list(_chars)] = _kind

#: Upper edges of the bins of each feature of a line.
EDGES = [
    ("words", [0.5, 1.5, 4.5, 12.5, 40.5]),
    ("bytes in a word", [2.5, 4.0, 5.5, 7.0, 9.0]),
    ("share of signs", [0.001, 0.02, 0.06, 0.12, 0.25]),
    ("share of bars", [0.001, 0.01, 0.04, 0.1, 0.2]),
    ("share of upper case letters", [0.01, 0.05, 0.2, 0.5, 0.8]),
    ("share of exclamation marks", [0.001, 0.01, 0.04, 0.1, 0.2]),
    ("share of digits", [0.001, 0.02, 0.08, 0.2, 0.4]),
    ("share of words like the one before", [0.001, 0.05, 0.15, 0.4, 0.7]),
    ("share of words like the one before that", [0.001, 0.05, 0.15, 0.4, 0.7]),
    ("share of points", [0.001, 0.01, 0.03, 0.06, 0.15]),
    ("times the line occurs", [1.5, 2.5, 4.5, 8.5, 16.5]),
    ("ends a sentence", [0.5]),
]
BINS, PLACES = 7, 3  # the last bin stands for a line that isn't there
N_FEATURES = len(EDGES)


def described(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of all texts: the bins of their features, their lengths in bytes, and each text's first line."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    first = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([r.count(b"\n") + 1 for r in raw], out=first[1:])
    b = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    n = int(first[-1])
    if not n:
        return np.zeros((0, N_FEATURES), np.uint8), np.zeros(0, np.int64), first
    ends = np.flatnonzero(b == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    length = ends - begins
    kinds = CLASS[b]
    count = np.stack([np.add.reduceat(kinds == c, begins, dtype=np.int64) for c in range(N_CLASSES)], axis=1)
    count[:, BLANK] -= 1  # the line's end
    blank = kinds == BLANK
    edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    start, stop = edge[::2], edge[1::2]  # a line feed ends the last text
    del blank
    word = span_hashes(b, start, stop)
    of = np.searchsorted(begins, start, side="right") - 1
    del edge, start, stop
    words = np.bincount(of, minlength=n)
    again = np.zeros((2, n), np.int64)
    for lag in (1, 2):
        same = (word[lag:] == word[:-lag]) & (of[lag:] == of[:-lag])
        again[lag - 1] = np.bincount(of[lag:][same], minlength=n)
    whole = span_hashes(b, begins, ends)
    doc = np.repeat(np.arange(len(raw)), np.diff(first))
    order = np.lexsort((whole, doc))
    new = np.ones(n, bool)
    new[1:] = (whole[order][1:] != whole[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    group = np.cumsum(new) - 1
    times = np.zeros(n, np.int64)
    times[order] = np.bincount(group)[group]
    times[length == 0] = 1
    size, letters, many = np.maximum(length, 1), np.maximum(count[:, UPPER] + count[:, LOWER] + count[:, HIGH] // 2, 1), np.maximum(words, 1)
    last = kinds[np.maximum(ends - 1, 0)]
    values = [words, (length - count[:, BLANK]) / many, count[:, SIGN] / size, count[:, PIPE] / size, count[:, UPPER] / letters, count[:, BANG] / size, count[:, DIGIT] / size, again[0] / many, again[1] / many, count[:, POINT] / size, times, (length > 0) & ((last == POINT) | (last == BANG))]
    return np.stack([np.digitize(v, edges) for v, (_, edges) in zip(values, EDGES, strict=True)], axis=1).astype(np.uint8), length, first


def indices(bins: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Numbers of the features that hold for each line: its own, and those of the lines before and behind it."""
    n = len(bins)
    absent = np.full((1, N_FEATURES), BINS - 1, np.uint8)
    before, behind = np.concatenate([absent, bins[:-1]]), np.concatenate([bins[1:], absent])
    before[first[:-1]] = BINS - 1
    behind[first[1:] - 1] = BINS - 1
    joined = np.concatenate([bins, before, behind], axis=1).astype(np.int64) if n else np.zeros((0, N_FEATURES * PLACES), np.int64)
    return joined + np.arange(N_FEATURES * PLACES) * BINS


N_WEIGHTS = N_FEATURES * PLACES * BINS


def forward_backward(unary: np.ndarray, pair: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of good for each line, and for each text the expected pairs of labels. unary: log odds of good."""
    lines = np.diff(first)
    order = np.argsort(-lines, kind="stable")
    begin, left = first[:-1][order], lines[order]
    most = int(left[0]) if len(left) else 0
    active = np.searchsorted(-left, -np.arange(most), side="left")
    n = len(unary)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    emit = np.stack([np.zeros(n), unary], axis=1)
    norm = lambda x: x - np.logaddexp(x[:, 0], x[:, 1])[:, None]
    for t in range(most):
        at = begin[: active[t]] + t
        if t:
            was = forward[at - 1]
            forward[at] = norm(emit[at] + np.logaddexp(was[:, :1] + pair[0], was[:, 1:] + pair[1]))
        else:
            forward[at] = norm(emit[at])
    for t in range(most - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        nxt = emit[at + 1] + backward[at + 1]
        backward[at] = norm(np.logaddexp(nxt[:, :1] + pair[:, 0], nxt[:, 1:] + pair[:, 1]))
    both = forward + backward
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
    inner = np.ones(n, bool)
    inner[first[1:] - 1] = False
    at = np.flatnonzero(inner)
    joint = forward[at][:, :, None] + pair[None] + (emit[at + 1] + backward[at + 1])[:, None, :]
    joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
    return good, (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    pair: np.ndarray
    curve: np.ndarray
    prior: float

    def marginals(self, bins: np.ndarray, first: np.ndarray) -> np.ndarray:
        return forward_backward(self.weights[indices(bins, first)].sum(axis=1) + self.bias, self.pair, first)[0]

    def scores(self, good: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(first) - 1, self.prior)
        return 1 / (1 + np.exp(-np.clip(_summary(good, length, first) @ self.curve, -500, 500)))


def _summary(good: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text: 1, the log odds of the mean marginal, weighted by length, and the share of lines held bad."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    weight = length + 1e-6
    total = np.bincount(doc, weight, len(first) - 1)
    mean = np.clip(np.bincount(doc, weight * good, len(first) - 1) / total, 1e-4, 1 - 1e-4)
    bad = np.bincount(doc, weight * (good < 0.5), len(first) - 1) / total
    return np.stack([np.ones(len(total)), np.log(mean / (1 - mean)), bad], axis=1)


def _fit_field(active: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = 120, ridge: float = 2.0) -> tuple[np.ndarray, float, np.ndarray]:
    """Adam over the penalised likelihood of the lines' labels. weight: of each text."""
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inner = np.ones(len(label), bool)
    inner[first[1:] - 1] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[at], label[at + 1]), 1.0)
    total = max(1, len(label))
    x = np.zeros(N_WEIGHTS + 1 + 4)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        w, bias, pair = x[:N_WEIGHTS], x[N_WEIGHTS], x[N_WEIGHTS + 1 :].reshape(2, 2)
        good, pairs = forward_backward(w[active].sum(axis=1) + bias, pair, first)
        off = (label - good) * weight[of]
        gradient = np.concatenate([np.bincount(active.ravel(), np.repeat(off, active.shape[1]), N_WEIGHTS), [off.sum()], (seen - pairs).ravel()])
        gradient = (gradient - ridge * x) / total
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        x = x + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return x[:N_WEIGHTS], float(x[N_WEIGHTS]), x[N_WEIGHTS + 1 :].reshape(2, 2)


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.5 * w)
    return w


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x or "" for x in batch.column("text").to_pylist()]
        bins, length, first = described(texts)
        keep = [slice(first[k], first[k + 1]) for k in range(len(texts))]
        columns = [batch.column("h"), batch.column("good"), pa.array([bins[s].tobytes() for s in keep], pa.binary()), pa.array([length[s].tolist() for s in keep], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["h", "good", "bins", "length"])


def learn(docs: DataFrame, labels: DataFrame, docs_per_label: int = DOCS_PER_LABEL, lines_per_label: int = LINES_PER_LABEL) -> Model:
    """`docs` has doc_id and text, `labels` doc_id and quality (1 good, 0 bad; others teach nothing). A document with
    several labels counts as good if all are. What reaches the driver is bounded by `docs_per_label` and
    `lines_per_label`: the sample's lines stay in executors until the documents that fit are chosen by their sizes."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"))
    marked = marked.withColumn("h", F.xxhash64("doc_id"))
    counts = {r["good"]: r["count"] for r in marked.groupBy("good").count().collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 1.0
    first = [marked.where(F.col("good") == good).orderBy("h", "doc_id").limit(docs_per_label) for good in (0, 1)]
    chosen = first[0].unionByName(first[1])
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # three numbers for each sampled one
    texts = texts.groupBy("doc_id", "good", "h").agg(F.min_by("text", F.md5("text")).alias("text"))
    found = cut(texts.select("h", "good", "text").mapInArrow(_sampled, "h bigint, good int, bins binary, length array<bigint>"))
    left, over = [lines_per_label] * 2, []
    for r in found.groupBy("h", "good").agg(F.sum(F.size("length")).alias("n")).orderBy("h").collect():
        if r["n"] <= left[r["good"]]:
            left[r["good"]] -= r["n"]
        else:
            over.append((r["h"], r["good"]))
    if over:  # sampled documents at most
        found = found.join(F.broadcast(docs.sparkSession.createDataFrame(over, "h bigint, good int")), ["h", "good"], "left_anti")
    rows = found.select("h", "good", "bins", "length").collect()
    rows.sort(key=lambda r: (r["h"], bytes(r["bins"])))
    y = np.array([r["good"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(N_WEIGHTS), 0.0, np.zeros((2, 2)), None, prior)
    first = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r["length"]) for r in rows], out=first[1:])
    bins = np.frombuffer(b"".join(bytes(r["bins"]) for r in rows), np.uint8).reshape(-1, N_FEATURES)
    length = np.array([n for r in rows for n in r["length"]], np.int64)
    # Rates as in the labels, though as many of each are sampled.
    weight = np.where(y == 1, prior / (y == 1).mean(), (1 - prior) / (y == 0).mean())
    active = indices(bins, first)
    even = np.ones(len(rows))
    of = np.repeat(np.arange(len(rows)), np.diff(first))
    label = y[of]
    w, bias, pair = _fit_field(active, first, label, even)
    alone = w[active].sum(axis=1) + bias
    label = np.where((label == 0) & (alone > 1.5), 1, label)
    w, bias, pair = _fit_field(active, first, label, even)
    model = Model(w, bias, pair, None, prior)
    model.curve = _fit_curve(_summary(model.marginals(bins, first), length, first), y, weight)
    return model


def score_column(spark: SparkSession, model: Model) -> callable:
    """A column function from text to struct<score, lines>, lines being each line's marginal of good."""
    held = spark.sparkContext.broadcast(model)  # a few hundred numbers
    kind = pa.struct([("score", pa.float64()), ("lines", pa.list_(pa.float32()))])

    def rows(texts: list[str]) -> pa.Array:
        bins, length, first = described(texts)
        good = held.value.marginals(bins, first) if len(texts) else np.zeros(0)
        scores = held.value.scores(good, length, first)
        lines = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(good.astype(np.float32)))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), lines], fields=list(kind))

    return arrow_column(rows, "struct<score:double,lines:array<float>>")


def score(docs: DataFrame, model: Model, text: str = "text", found: str = "quality_found") -> DataFrame:
    """All columns of `docs` and `found`: struct<score, lines>. A column of that name is replaced."""
    return docs.withColumn(found, score_column(docs.sparkSession, model)(F.col(f"`{text}`").cast("string")))


def trained(spark: SparkSession, sf_dir: str) -> Model:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return learn(docs.select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"))).select("doc_id", "quality"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = score(docs, trained(spark, sf_dir))
    value = F.col("quality_found")["score"]
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score"), (value >= THRESHOLD).cast("int").alias("predicted"))
