"""Severity of toxicity by cumulative-link ordinal regression.

Severity grades are ordered 0 < 1 < ... < K-1. One weight vector over sparse
text features is shared by all K-1 thresholds:

    P(grade <= k) = sigmoid(threshold_k - w . x)

Features are lower-cased letter runs hashed to ``dimensions`` buckets with
value ``1 + log(count)``, divided by the root of how many of the chosen features
the document has, so that a long text's many words do not by themselves mean a
higher grade. The fit uses a bounded sample of labelled documents
(``sample_docs``, chosen by a hash of the id, whole texts) that holds the rarest
grades whole as far as it goes, each row weighted by the documents of its grade
that it stands for. It keeps the ``features`` buckets whose presence separates
the grades best, of those that do so beyond chance, and minimises the penalised
likelihood by full-batch Adam. Scoring covers every document.

A document is flagged toxic from the probability that flags the sample best (by
weighted F1), which label noise moves but does not blur; without a feature that
tells documents apart none is flagged.

Defined cases: NULL or empty text has no features and gets the severity that
the thresholds alone give; without labelled rows, or with one grade only,
severity is that grade (0 without any); NULL grades and ids do not train;
repeated label rows count as often as they occur; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import settle, text_chunks
from strata.llm.hashing import LOWER, runs, span_hashes

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[0x80:] = True


DIMENSIONS = 1 << 22
#: Probability that any word without bearing on the grade becomes a feature.
CHANCE = 0.01


@dataclass(frozen=True)
class OrdinalModel:
    buckets: np.ndarray  # the features kept, ascending
    weights: np.ndarray  # theirs
    thresholds: np.ndarray  # K-1, ascending
    flag_at: float = 0.5  # P(grade > 0) from which a document is flagged


def buckets(data: np.ndarray, offsets: np.ndarray, dimensions: int):
    """Distinct (row, bucket) pairs with their counts, rows ascending."""
    low = LOWER[data]
    starts, ends = runs(_LETTER[low], offsets)
    h = span_hashes(low, starts, ends) & np.uint64(dimensions - 1)
    row = np.searchsorted(offsets, starts, side="right") - 1
    pairs, counts = np.unique(row.astype(np.uint64) * np.uint64(dimensions) + h, return_counts=True)
    return (pairs // np.uint64(dimensions)).astype(np.int64), (pairs % np.uint64(dimensions)).astype(np.int64), counts


def _features(dimensions: int):
    def run(batches):
        for batch in batches:
            ids, values, rows = [], [], []
            for a, b, data, offsets in text_chunks(batch.column(0)):
                row, bucket, count = buckets(data, offsets, dimensions)
                cut = np.searchsorted(row, np.arange(b - a + 1))
                for i in range(b - a):
                    rows.append(a + i)
                    ids.append(bucket[cut[i] : cut[i + 1]].astype("<u4").tobytes())
                    values.append(count[cut[i] : cut[i + 1]].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(rows, pa.int64())), pa.array(ids, pa.binary()), pa.array(values, pa.binary())],
                names=["grade", "ids", "counts"],
            )

    return run


def _select(rows, cols, y, dimensions, keep):
    """Buckets whose documents' grades differ from the sample's beyond chance.

    Of the documents that hold a bucket, the share above each grade is compared
    with that share of all: Chernoff's bound on the binomial tail, which also
    holds for a few documents, corrected for the number of buckets, grades and
    directions. Grades may be sampled unequally, as long as all buckets are
    judged on the same sample."""
    present = np.bincount(cols, minlength=dimensions)
    held = np.flatnonzero(present)
    n, least = present[held], np.zeros(len(held))
    for k in range(int(y.max())):
        all_ = (y > k).mean()
        if not 0 < all_ < 1:
            continue
        own = np.bincount(cols, weights=y[rows] > k, minlength=dimensions)[held] / n
        with np.errstate(divide="ignore", invalid="ignore"):
            above = np.where(own > 0, own * np.log(own / all_), 0.0)
            below = np.where(own < 1, (1 - own) * np.log((1 - own) / (1 - all_)), 0.0)
        least = np.maximum(least, n * (above + below))
    chosen = np.argsort(-least, kind="stable")[:keep]
    tests = 2 * max(1, int(y.max())) * max(1, len(held))
    return np.sort(held[chosen[least[chosen] > np.log(tests / CHANCE)]])


def scaled(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Values divided by the root of how many features their row has."""
    return values / np.sqrt(np.bincount(rows, minlength=n))[rows]


def linear_scores(model: OrdinalModel, rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """w . x of ``n`` rows from their (row, bucket, count) triples."""
    if not len(model.buckets):
        return np.zeros(n)
    at = np.minimum(np.searchsorted(model.buckets, cols), len(model.buckets) - 1)
    kept = model.buckets[at] == cols
    v = scaled(rows[kept], 1 + np.log(counts[kept].astype(float)), n)
    return np.bincount(rows[kept], weights=model.weights[at[kept]] * v, minlength=n)


def fit_rows(
    rows, cols, values, y, dimensions: int, features: int, penalty: float, steps: int, weight: np.ndarray | None = None
) -> OrdinalModel:
    """Fit on sparse triples (row, bucket, value) and grades ``y`` (0..K-1);
    ``weight``: how many labelled documents each row stands for."""
    n_docs = len(y)
    weight = np.ones(n_docs) if weight is None else weight
    total = max(weight.sum(), 1e-9)
    grades = int(y.max()) + 1 if n_docs else 1
    if grades == 1 or len(np.unique(y)) == 1:
        low = int(y[0]) if n_docs else 0
        none = np.empty(0)
        return OrdinalModel(none.astype(np.int64), none, np.concatenate([np.full(low, -40.0), np.full(max(0, grades - 1 - low), 40.0)]))
    chosen = _select(rows, cols, y, dimensions, features)
    place = np.full(dimensions, -1)
    place[chosen] = np.arange(len(chosen))
    inside = place[cols] >= 0
    r, c = rows[inside], place[cols[inside]]
    v = scaled(r, values[inside], n_docs)
    share = np.array([weight[y <= k].sum() / total for k in range(grades - 1)]).clip(1e-6, 1 - 1e-6)
    first = np.log(share[0] / (1 - share[0]))
    gaps = np.log(np.maximum(np.diff(np.log(share / (1 - share))), 1e-2))
    theta = np.concatenate([np.zeros(len(chosen)), [first], gaps])
    n_w = len(chosen)
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, steps + 1):
        w, cuts = theta[:n_w], theta[n_w] + np.concatenate([[0], np.cumsum(np.exp(theta[n_w + 1 :]))])
        score = np.bincount(r, weights=w[c] * v, minlength=n_docs)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        upper = np.where(y == grades - 1, 1.0, sigmoid(edges[np.minimum(y + 1, grades - 1)] - score))
        lower = np.where(y == 0, 0.0, sigmoid(edges[np.maximum(y, 1)] - score))
        p = np.maximum(upper - lower, 1e-9)
        d_up, d_low = weight * upper * (1 - upper) / p, weight * lower * (1 - lower) / p
        d_score = (d_up - d_low) / total  # of the negative log likelihood
        g_w = np.bincount(c, weights=d_score[r] * v, minlength=n_w) + penalty * w
        g_cut = np.array(
            [(d_low[y == k + 1].sum() - d_up[y == k].sum()) / total for k in range(grades - 1)]
        )
        tail = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([g_w, [tail[0]], tail[1:] * np.exp(theta[n_w + 1 :])])
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    model = OrdinalModel(chosen, theta[:n_w], theta[n_w] + np.concatenate([[0], np.cumsum(np.exp(theta[n_w + 1 :]))]))
    if not n_w:  # nothing tells one document from another
        return replace(model, flag_at=np.inf)
    score = np.bincount(r, weights=theta[:n_w][c] * v, minlength=n_docs)
    return replace(model, flag_at=best_flag(1 - grade_probabilities(model, score)[0], y > 0, weight))


def best_flag(p: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> float:
    """The probability from which on flagging has the best F1; half way to the
    next lower one."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum((positive * weight)[order])
    f1 = 2 * hits / (np.cumsum(weight[order]) + (positive * weight).sum())
    last = np.append(np.diff(p[order]) != 0, True)  # equal ones are flagged together
    at = int(np.argmax(np.where(last, f1, -1)))
    below = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float((p[order][at] + below) / 2)


def sampled(sizes: dict[int, int], most: int) -> dict[int, int]:
    """How many documents of each grade to take, ``most`` in all: the rarest
    whole where they fit, the others alike."""
    out, left = {}, most
    for i, (grade, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[grade] = min(n, left // (len(sizes) - i))
        left -= out[grade]
    return out


def fit(
    labelled: DataFrame,
    text: str = "text",
    grade: str = "grade",
    key: str = "doc_id",
    sample_docs: int = 12000,
    dimensions: int = DIMENSIONS,
    features: int = 400,
    penalty: float = 1e-5,
    steps: int = 600,
    docs: DataFrame | None = None,
) -> OrdinalModel:
    """Fit on ``labelled`` (key, grade, text); the texts may be in ``docs``
    instead (key, text), which then is joined with the sampled labels only."""
    known = labelled.select(
        *([F.col(text).alias("text")] if docs is None else []),
        F.col(grade).cast("int").alias("grade"),
        F.col(key).cast("string").alias("key"),
    ).where("grade >= 0 AND key IS NOT NULL")
    counted = known
    if docs is not None:
        texts = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
        counted = known.join(texts.select("key"), "key")
    sizes = {r["grade"]: r["n"] for r in counted.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        none = np.empty(0)
        return OrdinalModel(none.astype(np.int64), none, none)
    shares = F.create_map(*[F.lit(x) for g, n in sampled(sizes, sample_docs).items() for x in (g, n / sizes[g])])
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("key")), F.lit(1_000_000)) / 1_000_000
    sample = known.where(draw < shares[F.col("grade")])
    if docs is not None:
        sample = settle(sample.join(texts.select("key"), "key", "left_semi"), "toxicity-labels")
        sample = texts.join(F.broadcast(sample), "key")  # about sample_docs keys and grades
    rows = sample.select("text", "grade").mapInArrow(_features(dimensions), "grade int, ids binary, counts binary").collect()
    rows.sort(key=lambda r: (r["grade"], bytes(r["ids"]), bytes(r["counts"])))  # any task order, one model
    ids = [np.frombuffer(r["ids"], "<u4") for r in rows]
    counts = [np.frombuffer(r["counts"], "<u4") for r in rows]
    empty = [np.empty(0, "<u4")]
    row = np.repeat(np.arange(len(rows)), [len(x) for x in ids])
    y = np.array([r["grade"] for r in rows], dtype=np.int64)
    drawn = Counter(y.tolist())
    return fit_rows(
        row,
        np.concatenate(ids + empty).astype(np.int64),
        1 + np.log(np.concatenate(counts + empty).astype(float)),
        y,
        dimensions,
        features,
        penalty,
        steps,
        np.array([sizes[g] / drawn[g] for g in y.tolist()], dtype=float),
    )


def grade_probabilities(model: OrdinalModel, scores: np.ndarray) -> np.ndarray:
    """(grades, documents) probabilities."""
    z = np.clip(model.thresholds[:, None] - scores[None, :], -40, 40)
    at_most = np.concatenate([1 / (1 + np.exp(-z)), np.ones((1, len(scores)))])
    return np.diff(at_most, axis=0, prepend=np.zeros((1, len(scores))))


def predict(
    docs: DataFrame,
    model: OrdinalModel,
    text: str = "text",
    key: str = "doc_id",
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """(key, expected_severity, p_toxic, toxic) for every row: the mean grade,
    P(grade > 0), and whether that reaches the model's ``flag_at``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few numbers a feature

    def run(batches):
        for batch in batches:
            parts = [np.empty(0)]
            fitted = shared.value
            for a, b, data, offsets in text_chunks(batch.column(1)):
                row, bucket, count = buckets(data, offsets, dimensions)
                parts.append(linear_scores(fitted, row, bucket, count, b - a))
            p = grade_probabilities(fitted, np.concatenate(parts))
            severity = (p * np.arange(len(p))[:, None]).sum(axis=0)
            p_toxic = 1 - p[0] if len(p) > 1 else np.zeros(p.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(severity), pa.array(p_toxic), pa.array(p_toxic >= fitted.flag_at)],
                names=["key", "expected_severity", "p_toxic", "toxic"],
            )

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, expected_severity double, p_toxic double, toxic boolean"
    )
    return out.withColumnRenamed("key", key)
