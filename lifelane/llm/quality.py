"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, remainder, slices, training_labels

#: Names of the statistics, in the order of statistics().
NAMES = ("log_words", "upper", "symbols", "bars", "exclamations", "variety", "echo", "word_length", "stops", "line_variety", "non_ascii", "digits")

_KINDS = np.zeros(256, dtype=np.intp)
_KINDS[ord("A") : ord("Z") + 1] = 1
_KINDS[ord("a") : ord("z") + 1] = 2
_KINDS[ord("0") : ord("9") + 1] = 3
for _c in b"#$%&*@^~<>{}[]=+_\\/":
    _KINDS[_c] = 4
_KINDS[ord("|")] = 5
_KINDS[ord("!")] = 6
for _c in b".,;:?":
    _KINDS[_c] = 7
_KINDS[128:] = 8


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of a whole text; null counts as empty, and an empty text has finite values too."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    by_byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    kind = np.bincount(_KINDS, weights=by_byte, minlength=9)
    words = raw.split()
    w, distinct = len(words), len(set(words))
    echo = sum(map(operator.eq, words, words[1:]))
    lines = raw.split(b"\n")
    share = lambda x, of: math.log((x + 0.5) / (of + 1.0))
    return np.array(
        [
            math.log1p(w),
            share(kind[1], kind[1] + kind[2]),
            share(kind[4], n),
            share(kind[5], w),
            share(kind[6], w),
            math.log(distinct + 1.0) / math.log(w + 2.0),
            share(echo, w),
            math.log((n + 1.0) / (w + 1.0)),
            share(kind[7], w),
            share(len(set(lines)), len(lines)),
            share(kind[8], n),
            share(kind[3], n),
        ]
    )


@dataclass
class Discriminant:
    """Per class: mean, inverse Cholesky factor of the shrunk covariance and constant of the log-density; [0] and [1]."""

    means: np.ndarray
    whitening: np.ndarray
    constants: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        logs = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.whitening[k].T
            logs.append(self.constants[k] - 0.5 * np.einsum("ij,ij->i", z, z))
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(documents: DataFrame, labels: DataFrame, *, label: str = "quality", max_rows: int = 20_000, shrinkage: float = 0.1, mod: int = 5) -> Discriminant:
    """Fits class means and covariances on at most about max_rows labelled documents outside the held-out fold.

    The covariance of a class is (1 - shrinkage) * S + shrinkage * (diagonal of the pooled S) plus a small ridge.
    Moments are summed on the executors; the driver gets one number for each class and moment. A class without rows
    takes the pooled moments, so empty tables give scores of the prior. Repeated documents count each, null texts as empty.
    """
    d = len(NAMES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
        for batch in slices(batches):
            for text, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = statistics(text)
                total[k] += np.concatenate(([1.0], x, np.outer(x, x).ravel()))
        for k, v in total.items():
            yield pa.RecordBatch.from_pydict({"label": pa.array([k] * len(v), pa.int32()), "pos": pa.array(range(len(v)), pa.int32()), "v": v})

    sample = F.broadcast(training_labels(labels, label, max_rows, mod))
    rows = (
        documents.select("doc_id", "text")
        .join(sample, "doc_id")
        .select("text", "label")
        .mapInArrow(moments, "label int, pos int, v double")
        .groupBy("label", "pos")
        .agg(F.sum("v").alias("v"))
        .collect()
    )
    sums = np.zeros((2, 1 + d + d * d))
    for r in rows:
        sums[r.label, r.pos] = r.v
    pooled = sums.sum(axis=0)
    if pooled[0] == 0:
        pooled = np.concatenate(([1.0], np.zeros(d), np.eye(d).ravel()))
    spread = np.diag(_covariance(pooled)).copy()
    means, whitening, constants = [], [], []
    for k in (0, 1):
        own = sums[k] if sums[k, 0] > 0 else pooled
        cov = (1 - shrinkage) * _covariance(own) + shrinkage * np.diag(spread) + 1e-4 * np.eye(d)
        chol = np.linalg.cholesky(cov)
        means.append(own[1 : 1 + d] / own[0])
        whitening.append(np.linalg.inv(chol))
        constants.append(math.log((sums[k, 0] + 1.0) / (sums[:, 0].sum() + 2.0)) - np.log(np.diag(chol)).sum())
    return Discriminant(np.array(means), np.array(whitening), np.array(constants))


def _covariance(moments: np.ndarray) -> np.ndarray:
    d = len(NAMES)
    mean = moments[1 : 1 + d] / moments[0]
    return moments[1 + d :].reshape(d, d) / moments[0] - np.outer(mean, mean)


def _scores(model: Discriminant, texts: list[str | None]) -> np.ndarray:
    let_go()
    return model.score(np.array([statistics(t) for t in texts])) if texts else np.zeros(0)


def score(documents: DataFrame, model: Discriminant, *, threshold: float = 0.3, mod: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row: repeated ids and null texts (scored as empty) included.

    Other columns of documents are ignored, so clashing names do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = _scores(model, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s, "predicted": pa.array((s >= threshold).astype(np.int32))})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", mod) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, model: Discriminant, *, threshold: float = 0.3) -> DataFrame:
    """The rows of documents, all columns kept, that score at least threshold. Null texts score as empty, repeated rows each."""
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pc.greater_equal(pa.array(_scores(model, batch.column(at).to_pylist())), threshold))

    return documents.mapInArrow(run, documents.schema)


def op7_quality_discriminant(spark, sf_dir: str) -> DataFrame:
    """score() of documents by a model of their labelled rows: a row for each of theirs, null ids and texts and repeated rows too."""
    from .common import let_go, table

    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(documents, table(spark, sf_dir, "labels")))
