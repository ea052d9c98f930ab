"""Toxicity as ordered severity grades by cumulative-link regression.

P(grade > k) = sigmoid(w . x - threshold_k): one weight vector for all ordered
thresholds. Features are the words of a text and their first bytes, present or
absent; only those seen often enough in the training sample have a weight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loometry.llm.arrays import ALNUM, LOWER, U64, mix, span_hashes, text_slices, tidy, words

#: Labelled documents the model is fitted on, at most: those first in hash order.
SAMPLE_ROWS = 6000
#: A feature needs this many sample documents.
MIN_DOCUMENTS = 4
PREFIX_BYTES = 4
#: Bytes of sample text worked on at once. The model depends on it: the features of a
#: slice come in two runs of rows, and are dealt to its documents as if in one.
FIT_SLICE = 1_500_000
#: L1 penalty of the selection.
L1 = 1e-3
STEPS = 150


def features(raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature hash of each word and of each word's first bytes."""
    raw = LOWER[raw]
    starts, ends, cuts = words(raw, borders, ALNUM)
    rows = np.repeat(np.arange(len(borders) - 1), np.diff(cuts))
    whole = span_hashes(raw, starts, ends)
    head = span_hashes(raw, starts, np.minimum(ends, starts + PREFIX_BYTES), 1)
    return np.concatenate([rows, rows]), np.concatenate([whole, head])


def distinct(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, value) once, by row."""
    _, first = np.unique(values ^ mix(rows.astype(U64) + U64(1)), return_index=True)
    first.sort()
    return rows[first], values[first]


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    thresholds: np.ndarray  # increasing, one less than there are grades

    def above(self, raw: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        logit = np.zeros(len(borders) - 1)
        if len(self.vocabulary):
            rows, values = features(raw, borders)
            at = np.minimum(np.searchsorted(self.vocabulary, values), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == values
            rows, values = distinct(rows[known], values[known])
            at = np.searchsorted(self.vocabulary, values)
            logit += np.bincount(rows, self.weights[at], minlength=len(logit))
        return _sigmoid(logit[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _likelihood(logit: np.ndarray, grades: np.ndarray, theta: np.ndarray):
    """Gradients of the mean negative log-likelihood for logits and thresholds."""
    k, n = len(theta), len(grades)
    low = np.where(grades > 0, _sigmoid(logit - theta[np.maximum(grades - 1, 0)]), 1.0)
    high = np.where(grades < k, _sigmoid(logit - theta[np.minimum(grades, k - 1)]), 0.0)
    p = np.maximum(low - high, 1e-12)
    a, b = low * (1 - low) / p, high * (1 - high) / p
    by_theta = np.bincount(np.maximum(grades - 1, 0), np.where(grades > 0, a, 0.0), k)
    by_theta -= np.bincount(np.minimum(grades, k - 1), np.where(grades < k, b, 0.0), k)
    return (b - a) / n, by_theta / n


def _descend(rows: np.ndarray, columns: np.ndarray, m: int, grades: np.ndarray, theta: np.ndarray, l1: float, steps: int):
    """Proximal Adam from zero weights: weights and thresholds."""
    n = len(grades)
    gap = np.log(np.maximum(np.diff(theta), 1e-3))
    weights, theta = np.zeros(m), theta[:1]
    first, second = np.zeros(m + 1 + len(gap)), np.zeros(m + 1 + len(gap))

    def spread():
        return theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(gap))])

    for step in range(1, steps + 1):
        by_logit, by_theta = _likelihood(np.bincount(rows, weights[columns], minlength=n), grades, spread())
        tail = np.cumsum(by_theta[::-1])[::-1]
        gradient = np.concatenate([np.bincount(columns, by_logit[rows], minlength=m), tail[:1], tail[1:] * np.exp(gap)])
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        scale = 0.1 / (np.sqrt(second / (1 - 0.99**step)) + 1e-4)
        move = scale * first / (1 - 0.9**step)
        weights = weights - move[:m]
        weights = np.sign(weights) * np.maximum(np.abs(weights) - scale[:m] * l1, 0)
        theta, gap = theta - move[m], gap - move[m + 1 :]
    return weights, spread()


def fit_arrays(rows: np.ndarray, values: np.ndarray, grades: np.ndarray, *, l1: float = L1, steps: int = STEPS) -> Model:
    """Fit on (row, feature) pairs: an L1 penalty selects the features, a second
    descent without most of it sets their weights."""
    top = int(grades.max()) if len(grades) else 0
    if top == 0:
        return Model(np.zeros(0, U64), np.zeros(0), np.full(1, 30.0))
    vocabulary, columns, counts = np.unique(values, return_inverse=True, return_counts=True)
    often = counts >= MIN_DOCUMENTS
    place = np.cumsum(often) - 1
    held = often[columns]
    rows, columns, vocabulary = rows[held], place[columns[held]], vocabulary[often]
    share = np.clip([(grades > k).mean() for k in range(top)], 1e-4, 1 - 1e-4)
    theta = np.log(1 - share) - np.log(share)
    weights, _ = _descend(rows, columns, len(vocabulary), grades, theta, l1, steps)
    used = weights != 0
    place = np.cumsum(used) - 1
    held = used[columns]
    vocabulary = vocabulary[used]
    weights, theta = _descend(rows[held], place[columns[held]], len(vocabulary), grades, theta, l1 / 5, 2 * steps)
    return Model(vocabulary, weights, theta)


def split_toxic(rows: np.ndarray, values: np.ndarray, grades: np.ndarray, l1: float) -> np.ndarray:
    """Three grades out of two: of the toxic documents, those that a first fit finds
    more toxic than their median become grade 2, the severe ones."""
    model = fit_arrays(rows, values, grades, l1=l1)
    if not len(model.vocabulary):
        return grades
    at = np.minimum(np.searchsorted(model.vocabulary, values), len(model.vocabulary) - 1)
    known = model.vocabulary[at] == values
    logit = np.bincount(rows[known], model.weights[at[known]], minlength=len(grades))
    toxic = grades > 0
    return grades + (toxic & (logit > np.median(logit[toxic])))


def fit(documents: DataFrame, grades: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled documents.

    ``grades`` has ``doc_id`` and ``grade``; the highest grade of an id counts, null
    ids and grades do not. Of several rows of one id, the text with the smallest hash
    counts, so that ``sample_rows`` bounds what comes to the driver. Where the labels only tell toxic (1) from clean (0), the
    toxic ones are graded by ``split_toxic``. Without a graded document, or where all
    are of grade 0, the model holds every text for clean.
    """
    chosen = (
        grades.filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # At most sample_rows short rows: the side that is broadcast is bounded.
    joined = texts.join(F.broadcast(chosen), "doc_id")
    one = joined.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))

    def extract(batches):
        for batch in batches:
            for lo, hi, raw, borders in text_slices(batch.column(2), FIT_SLICE):
                rows, values = distinct(*features(raw, borders))
                cuts = np.searchsorted(rows, np.arange(hi - lo + 1))
                cells = [values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), pa.array(cells, pa.binary())], ["doc_id", "grade", "features"])

    id_type = one.schema["doc_id"].dataType.simpleString()
    # By id, so that the sums of the fit do not depend on how the rows arrive.
    found = one.mapInArrow(tidy(extract), f"doc_id {id_type}, grade int, features binary").toArrow().sort_by("doc_id")
    cells = found.column("features").to_pylist()
    values = np.frombuffer(b"".join(cells), U64)
    rows = np.repeat(np.arange(len(cells)), [len(c) // 8 for c in cells])
    grade = np.array(found.column("grade").to_pylist(), np.int64)
    if len(grade) and grade.max() == 1:
        grade = split_toxic(rows, values, grade, L1)
    return fit_arrays(rows, values, grade)


def score(documents: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """All columns plus ``_toxicity``, a struct of ``severity`` (expected grade),
    ``grade`` (thresholds passed with probability one half or more) and ``rejected``
    (grade of 1 or more). Null and empty texts have no features. Row-local."""
    columns = documents.columns
    # The text goes to Python and back once, in slices.
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns if c != text])
    packed = documents.select(rest.alias("row"), F.col(f"`{text}`").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in batches:
            for lo, hi, raw, borders in text_slices(batch.column(1)):
                above = shared.value.above(raw, borders)
                s, g = above.sum(1), (above >= 0.5).sum(1).astype(np.int32)
                cell = pa.StructArray.from_arrays([pa.array(s), pa.array(g), pa.array(g >= 1)], ["severity", "grade", "rejected"])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), cell], ["row", "text", "found"])

    kinds = {f.name: f.dataType.simpleString() for f in packed.schema}
    schema = f"row {kinds['row']}, text {kinds['text']}, found struct<severity:double,grade:int,rejected:boolean>"
    judged = packed.mapInArrow(tidy(judge), schema)
    return judged.select(*[F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in columns], F.col("found").alias("_toxicity"))


def grades_of(labels: DataFrame) -> DataFrame:
    return labels.filter("toxic IS NOT NULL").select("doc_id", (F.col("toxic") > 0).cast("int").alias("grade"))


def toxicity(documents: DataFrame, labels: DataFrame, *, training: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on the labels of ``training`` (by default ``documents``) and score ``documents``."""
    model = fit(documents if training is None else training, grades_of(labels), sample_rows=sample_rows)
    return score(documents, model)


def remove_toxic(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    return toxicity(documents, labels, **options).filter("NOT _toxicity.rejected").drop("_toxicity")
