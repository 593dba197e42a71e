"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade <= k | x) = logistic(threshold_k - w.x): one vector of weights for all grades, ordered thresholds between them.
The expected grade and the tail probability P(grade >= keep) follow, and a document is kept if the latter is at least
one half. Grades from labels: 0 toxic, 1 of low quality, 2 neither.

The fit takes a bounded sample: the `sample` labelled documents with the smallest hash of doc_id, so it is the same on
every run. Scoring is one pass over the documents with weights of fixed size.

Null and empty texts have no features and get the score of the intercept; unlabelled rows and null labels take no part
in the fit; repeated rows count as often as they come; with no usable labels every document is kept (grade 2).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .shards import give_back

BITS, STYLE, GRADES = 18, 8, 3
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LINE = np.arange(256) == 10
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its distinct hashed words and heads of words, end to end with n + 1 offsets, and STYLE dense measures in [0, 1]."""
    buf, offsets = tb.text_bytes(column)
    words, counts, style = [], [], []
    for a, b in tb.slices(offsets):
        part, own = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        n = b - a
        low = tb.LOWER[part]
        start, end, first = tb.runs(_LETTER[low], own)
        doc = np.repeat(np.arange(n), np.diff(first))
        heads = np.flatnonzero(end - start > 5)  # the first bytes of longer words stand for their inflections
        hashes = np.concatenate([tb.segments(low, start, end), ~tb.segments(low, start[heads], start[heads] + 5)])
        once = np.unique(np.concatenate([doc, doc[heads]]) << BITS | (hashes >> np.uint64(64 - BITS)).astype(np.int64))
        words.append(once & ((1 << BITS) - 1))
        counts.append(np.bincount(once >> BITS, minlength=n))
        size = np.maximum(1, np.diff(own)).astype(float)

        def share(mask, over=size, own=own):
            c = np.concatenate([[0], np.cumsum(mask)])
            return (c[own[1:]] - c[own[:-1]]) / over

        letters = np.maximum(1, share(_LETTER[part], 1.0))
        n_words = np.maximum(1, np.diff(first))
        other = ~(_LETTER | tb.SPACE | _DIGIT)
        style.append(np.column_stack([
            share(other[part]), share(_UPPER[part], 1.0) / letters, share(_LINE[part], n_words / 10.0), counts[-1] / n_words,
            share(_DIGIT[part]), np.minimum(1, letters / n_words / 20), share(part == 124), (np.diff(own) == 0).astype(float),
        ]))
    if not words:
        return np.empty(0, np.int64), np.zeros(1, np.int64), np.empty((0, STYLE))
    return np.concatenate(words), np.concatenate([[0], *counts]).cumsum(), np.concatenate(style)


def _dense(style: np.ndarray) -> np.ndarray:
    """Each measure and indicators of its tenths, so one weight vector can follow a curve."""
    steps = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75])
    return np.concatenate([style, (style[:, :, None] > steps).reshape(len(style), -1).astype(float)], axis=1)


class Ordinal:
    """Cumulative-link regression fitted by Adagrad on mini-batches in a fixed order."""

    def __init__(self, grades: int = GRADES) -> None:
        self.w = np.zeros(1 << BITS)
        self.v = np.zeros(STYLE * 8)
        self.cut = np.linspace(-1.0, 1.0, grades - 1)

    def latent(self, words: np.ndarray, ends: np.ndarray, style: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0.0], np.cumsum(self.w[words])])
        return c[ends[1:]] - c[ends[:-1]] + _dense(style) @ self.v

    def tails(self, latent: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.cut[None, :] - latent[:, None], -40, 40)))

    def fit(self, words: np.ndarray, ends: np.ndarray, style: np.ndarray, grade: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 1e-5) -> Ordinal:
        n = len(grade)
        dense = _dense(style)
        gw, gv, gc = np.full(len(self.w), 1e-2), np.full(len(self.v), 1e-2), np.full(len(self.cut), 1e-2)
        order = np.random.Generator(np.random.PCG64(7))
        k = len(self.cut)
        for _ in range(epochs):
            for rows in np.array_split(order.permutation(n), max(1, n // 64)):
                size = ends[rows + 1] - ends[rows]
                at = words[tb.row_ranges(ends[rows], size)]
                inside = np.repeat(np.arange(len(rows)), size)
                x = np.bincount(inside, self.w[at], len(rows)) + dense[rows] @ self.v
                low = np.concatenate([np.full((len(rows), 1), -40.0), self.cut - x[:, None]], 1) if k else None
                high = np.concatenate([self.cut - x[:, None], np.full((len(rows), 1), 40.0)], 1)
                g, i = grade[rows], np.arange(len(rows))
                f_low, f_high = (1 / (1 + np.exp(-np.clip(z[i, g], -40, 40))) for z in (low, high))
                f_low, f_high = np.where(g == 0, 0.0, f_low), np.where(g == k, 1.0, f_high)
                # d log(F(high) - F(low)): the logistic's density is F (1 - F)
                p = np.maximum(f_high - f_low, 1e-9)
                d_high, d_low = f_high * (1 - f_high) / p, f_low * (1 - f_low) / p
                dx = (d_high - d_low) / len(rows)  # of the negative log-likelihood
                dw = np.bincount(at, dx[inside], len(self.w)) if len(at) > len(self.w) // 8 else None
                cols = np.flatnonzero(dw) if dw is not None else np.unique(at)
                d = dw[cols] if dw is not None else np.bincount(np.searchsorted(cols, at), dx[inside], len(cols))
                d = d + decay * self.w[cols]
                gw[cols] += d * d
                self.w[cols] -= rate * d / np.sqrt(gw[cols])
                d = dense[rows].T @ dx + decay * self.v
                gv += d * d
                self.v -= rate * d / np.sqrt(gv)
                d = np.zeros(k)
                np.add.at(d, g[g < k], -(d_high / len(rows))[g < k])
                np.add.at(d, g[g > 0] - 1, (d_low / len(rows))[g > 0])
                gc += d * d
                self.cut = np.sort(self.cut - rate * d / np.sqrt(gc))
        return self


FEATURES = "grade int, words binary, style binary"


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade of the rows that say enough."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.cast("int").alias("grade")).where("grade is not null and doc_id is not null")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> Ordinal | None:
    """The model of the `sample` labelled documents whose doc_ids hash lowest; None if there are none."""
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")

    def read(batches):
        for batch in batches:
            words, ends, style = features(batch.column(2))
            w = [words[a:b].astype("<i4").tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(w, pa.binary()), pa.array([x.tobytes() for x in style], pa.binary())], names=["doc_id", "grade", "words", "style"])

    got = rows.mapInArrow(read, "doc_id long, " + FEATURES).orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample).toArrow()
    if not got.num_rows:
        return None
    words, offsets = tb.text_bytes(got.column("words"))
    style, _ = tb.text_bytes(got.column("style"))
    style, grade = style.view("<f8").reshape(got.num_rows, -1).copy(), got.column("grade").to_numpy()
    model = Ordinal().fit(words.view("<i4").astype(np.int64), offsets // 4, style, grade.astype(np.int64))
    del got, words, offsets, style, grade
    give_back()  # the driver lives on
    return model


def classify(docs: DataFrame, model: Ordinal | None, keep: int = GRADES - 1, least: float = 0.5) -> DataFrame:
    """docs with expected_grade, p_keep = P(grade >= keep) and accepted = p_keep >= least."""
    new = {"expected_grade": "double", "p_keep": "double", "accepted": "boolean"}
    docs = docs.drop(*new)
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(float(GRADES - 1)), "p_keep": F.lit(1.0), "accepted": F.lit(True)})
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("p_keep", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    state = docs.sparkSession.sparkContext.broadcast((model.w.astype(np.float32), model.v, model.cut))  # 1 MB whatever the input

    def score(batches):
        m = Ordinal()
        w, m.v, m.cut = state.value
        m.w = w.astype(float)
        for batch in batches:
            tails = m.tails(m.latent(*features(batch.column(at))))
            p = tails[:, keep - 1]
            more = [pa.array(tails.sum(1)), pa.array(p), pa.array(p >= least)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *new])

    return docs.mapInArrow(score, schema)


def train_and_classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, fit(docs, labels))
