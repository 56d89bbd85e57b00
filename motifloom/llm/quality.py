"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every token has a sparse random index vector.  A token's word vector is the sum
of the index vectors seen beside it in the training texts, plus its own.  A
document is the weighted mean of the vectors of all its tokens; a two-layer numpy
network scores it, and a temperature fitted on rows that the network was not fitted on
calibrates the probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.llm.common import drawn_share, id_crc, partitions, table, written

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Bounds of a model: labelled documents it is fitted on, tokens with a vector of their own, and the width of a vector.
SAMPLE_DOCS, MAX_TOKENS, WIDTH, HIDDEN, SPARSE = 6000, 16_384, 64, 32, 6
#: Rows that stand for tokens without a vector of their own, by their shape, and for a token that repeats the one before it.
SHAPES = ("<lower>", "<upper>", "<title>", "<mixed>", "<digit>", "<mark>", "<again>")
LOWER, UPPER, TITLE, MIXED, DIGIT, MARK, AGAIN = range(len(SHAPES))
THRESHOLD = 0.3


def shape_of(token: str) -> int:
    if not (token[0].isalnum() or token[0] == "_"):
        return MARK
    if token.isdigit():
        return DIGIT
    if token.islower():
        return LOWER
    if token.isupper():
        return UPPER if len(token) > 1 else TITLE
    return TITLE if token.istitle() else MIXED


def token_rows(text: str, ids: dict[str, int]) -> np.ndarray:
    """Rows of a text's tokens in order, with a row for each repetition after them."""
    get = ids.get
    tokens = TOKEN.findall(text)
    rows = [get(t, -1) for t in tokens]
    if -1 in rows:
        rows = [shape_of(t) if r < 0 else r for t, r in zip(tokens, rows)]
    return np.array(rows, np.int32)


def index_vectors(n: int) -> np.ndarray:
    """Sparse ternary vectors, the same for every run."""
    rng = np.random.default_rng(20_240_229)
    out = np.zeros((n, WIDTH), np.float32)
    for row in out:
        row[rng.choice(WIDTH, SPARSE, replace=False)] = rng.choice((-1.0, 1.0), SPARSE)
    return out


@dataclass
class QualityModel:
    ids: dict[str, int]
    vectors: np.ndarray
    layers: list[np.ndarray]
    centre: np.ndarray
    spread: np.ndarray
    temperature: float
    base: float

    def pool(self, text: str | None) -> np.ndarray:
        return pool(text, self.ids, self.vectors)

    def score(self, pooled: np.ndarray) -> np.ndarray:
        """Probability of quality 1 for rows of pooled vectors."""
        if not self.layers:
            return np.full(len(pooled), self.base)
        logit = forward(self.layers, (pooled - self.centre) / self.spread)[1]
        return 1.0 / (1.0 + np.exp(-np.clip(logit / self.temperature, -50, 50)))


def pool(text: str | None, ids: dict[str, int], vectors: np.ndarray) -> np.ndarray:
    """Mean vector of all tokens, the share of repetitions, and the logarithm of the number of tokens."""
    rows = token_rows(text, ids) if text else np.zeros(0, np.int32)
    if not len(rows):
        return np.zeros(WIDTH + 2, np.float64)
    if len(rows) > 4 * len(vectors):
        total = np.bincount(rows, minlength=len(vectors)).astype(np.float64) @ vectors
    else:
        total = vectors[rows].sum(axis=0, dtype=np.float64)
    again = int((rows[1:] == rows[:-1])[rows[1:] >= len(SHAPES)].sum())
    total = total + again * vectors[AGAIN]
    return np.concatenate([total / len(rows), [again / len(rows), np.log1p(len(rows))]])


def forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden, hidden @ w2 + b2[0]


def fit_network(x: np.ndarray, y: np.ndarray, steps: int = 400, decay: float = 1e-3) -> list[np.ndarray]:
    """Full-batch Adam on the cross entropy."""
    rng = np.random.default_rng(7)
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    for step in range(1, steps + 1):
        hidden, logit = forward(layers, x)
        err = (1.0 / (1.0 + np.exp(-np.clip(logit, -50, 50))) - y) / len(y)
        back = np.outer(err, layers[2]) * (1 - hidden**2)
        grads = [x.T @ back + decay * layers[0], back.sum(axis=0), hidden.T @ err + decay * layers[2], np.array([err.sum()])]
        for p, g, m, v in zip(layers, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return layers


def fit_temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross entropy on rows that the network was not fitted on."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8.0), 60))
    loss = [np.logaddexp(0, -np.where(y > 0, 1, -1) * logit / t).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            counts.update(TOKEN.findall(text.as_py()))
            if len(counts) > 200_000:
                yield flush()
    yield flush()


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_docs: int = SAMPLE_DOCS,
    max_tokens: int = MAX_TOKENS,
) -> QualityModel:
    """Fit on about ``sample_docs`` labelled documents, drawn by a hash of their id.

    Rows with a null id, label or text teach nothing; a repeated label row counts
    once for each distinct label.  Vectors, vocabulary and network are learned from that
    sample, so the model's size does not grow with the corpus.  With fewer than
    two classes every text scores the share of label 1 (0.5 where there is no label).
    """
    marked = labels.select(F.col(doc).alias("doc"), F.col(label).cast("int").alias("label")).where("doc IS NOT NULL AND label IN (0, 1)")
    n = marked.count()
    drawn = marked.where(drawn_share(min(1.0, sample_docs / max(n, 1)), "doc")).distinct()
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    spark = docs.sparkSession
    # the sample is bounded by sample_docs rows of an id and a label
    sample = written(rows.join(F.broadcast(drawn), "doc").repartition(min(8, partitions(spark)), F.xxhash64("doc", "text")), "quality-sample")
    top = sample.select("text").mapInArrow(_count_tokens, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    names = [r["token"] for r in top.orderBy(F.desc("n"), "token").limit(max_tokens).collect()]
    ids = {t: i + len(SHAPES) for i, t in enumerate(names)}
    size = len(ids) + len(SHAPES)
    index = index_vectors(size)
    known = spark.sparkContext.broadcast(ids)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the index vectors within two tokens, and the counts; one matrix a task."""
        total, counts, seen = np.zeros((size, WIDTH), np.float32), np.zeros(size), False
        beside = index_vectors(size)
        for batch in batches:
            for t in batch.column(0):
                r = token_rows(t.as_py(), known.value)
                seen = True
                counts += np.bincount(r, minlength=size)
                for gap in (1, 2):
                    if len(r) > gap:
                        np.add.at(total, r[gap:], beside[r[:-gap]])
                        np.add.at(total, r[:-gap], beside[r[gap:]])
        if seen:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["total", "counts"])

    total, counts = np.zeros((size, WIDTH)), np.zeros(size)
    for got in sample.select("text").mapInArrow(contexts, "total binary, counts binary").toLocalIterator():
        total += np.frombuffer(got["total"], np.float32).reshape(size, WIDTH)
        counts += np.frombuffer(got["counts"])
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    vectors = np.where(norm > 0, total / np.maximum(norm, 1e-9), 0) + index / SPARSE**0.5
    rate = counts / max(counts.sum(), 1)
    vectors = (vectors * (0.02 / (0.02 + rate))[:, None]).astype(np.float32)
    model = QualityModel(ids, vectors, [], np.zeros(WIDTH + 2), np.ones(WIDTH + 2), 1.0, 0.5)
    shared = spark.sparkContext.broadcast(model)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shared.value.pool(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(x, pa.binary()), batch.column(2)], names=["doc", "x", "label"])

    got = sample.select(F.col("doc").cast("string").alias("doc"), "text", "label").mapInArrow(pooled, "doc string, x binary, label int").collect()
    got.sort(key=lambda r: (r["doc"], r["label"], r["x"]))
    y = np.array([r["label"] for r in got], float)
    model.base = float(y.mean()) if len(y) else 0.5
    if len(set(y)) < 2:
        return model
    x = np.array([np.frombuffer(r["x"]) for r in got])
    model.centre, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - model.centre) / model.spread
    aside = np.arange(len(y)) % 5 == 4
    held = aside.any() and len(set(y[~aside])) == 2
    model.layers = fit_network(x[~aside], y[~aside]) if held else fit_network(x, y)
    if held:  # the temperature is that of the very network it is applied to
        model.temperature = fit_temperature(forward(model.layers, x[aside])[1], y[aside])
    return model


def quality_of(spark: SparkSession, model: QualityModel, text: Column) -> Column:
    """Probability of quality 1 for a text column; null and empty texts are scored as texts without tokens."""
    shared = spark.sparkContext.broadcast(model)  # bounded by MAX_TOKENS and WIDTH

    @F.pandas_udf("double")
    def score(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        own = shared.value
        return pd.Series(own.score(np.array([own.pool(t) for t in texts]).reshape(len(texts), WIDTH + 2)))

    return score(text.cast("string"))


def score_quality(df: DataFrame, model: QualityModel, *, text: str = "text", result: str = "quality_score") -> DataFrame:
    """All columns of ``df`` and the column ``result`` (0 to 1); a column of that name is replaced.

    Null and empty texts are scored as texts without tokens, long ones whole; repeated rows score alike; an empty table gives no rows.
    """
    return df.withColumn(result, quality_of(df.sparkSession, model, F.col(text)))


def trained_for_query(docs: DataFrame, labels: DataFrame) -> QualityModel:
    return train_quality(docs, labels.where(id_crc("doc_id") % 5 != 0))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels outside the fold; nulls, ties, repeats, long and empty texts and
    empty tables as in :func:`train_quality` and :func:`score_quality`; a null id is in no fold."""
    docs = table(spark, sf_dir, "documents")
    own = score_quality(docs.select("doc_id", "text"), trained_for_query(docs, table(spark, sf_dir, "labels")))
    return own.select(
        "doc_id",
        F.coalesce(id_crc("doc_id") % 5 == 0, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
