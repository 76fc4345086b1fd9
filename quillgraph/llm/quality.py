"""Quality classification from positive and unlabelled texts.

Trusted positives are documents labelled 1; the unlabelled set is a sample of all texts that may be learned from,
whatever their label. The class prior is estimated from the labels. The model, a small network on features of the
whole text, minimises the non-negative unbiased risk: pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)), with a step against
the gradient of the second term where it goes negative. Both samples are bounded by parameters.

Defined results: a null or empty text is scored like any other (all counts zero); with no trusted positives every
score is the prior's default of 0.5; a document labelled more than once counts once for each label row; rows without
doc_id match no label and are scored; repeated rows are each scored; other columns of the input are ignored by
``scored`` and kept by ``accepted``.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import crc_rest, record, slices, table, text_udf, texts_of

THRESHOLD = 0.3
#: Rows of each sample at most, about.
MAX_POSITIVES = 12_000
MAX_UNLABELLED = 24_000
HIDDEN = 24

_BYTES = {
    "upper": np.arange(65, 91),
    "lower": np.arange(97, 123),
    "digit": np.arange(48, 58),
    "space": np.array([9, 10, 11, 12, 13, 32]),
    "stop": np.array([44, 46]),
    "quote": np.array([34, 39, 40, 41, 45, 58, 59, 63]),
    "mark": np.array([33, 35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126]),
    "high": np.arange(128, 256),
}
_FOLD = np.zeros((256, len(_BYTES)))
for _i, _chars in enumerate(_BYTES.values()):
    _FOLD[_chars, _i] = 1
N_FEATURES = 24
_ZSTD: list[zstandard.ZstdCompressor] = []


def features(text: str) -> np.ndarray:
    """Shares of kinds of characters, repetition of words and lines, compressibility, lengths."""
    if not _ZSTD:
        _ZSTD.append(zstandard.ZstdCompressor(level=1))
    data = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    folded = counts @ _FOLD
    n = max(len(data), 1)
    words = text.split()
    lines = text.split("\n")
    w, k = max(len(words), 1), max(len(lines), 1)
    distinct = len(set(words))
    adjacent = sum(map(operator.eq, words, words[1:]))
    letters = max(folded[0] + folded[1] + folded[7], 1)
    out = np.empty(N_FEATURES)
    out[:8] = folded / n
    out[8] = folded[0] / letters
    out[9] = min(1.0, folded[6] / w)
    out[10] = min(1.0, counts[33] / w)
    out[11] = min(1.0, counts[124] / w)
    out[12] = min(1.0, (counts[35] + counts[36] + counts[37] + counts[38] + counts[42]) / w)
    out[13] = min(1.0, folded[4] / w)
    out[14] = adjacent / w
    out[15] = distinct / w
    out[16] = len(set(lines)) / k
    out[17] = min(3.0, np.log1p(w / k) / 2)
    out[18] = np.log1p(w) / 10
    out[19] = np.log1p(k) / 5
    out[20] = min(2.0, letters / w / 10)
    out[21] = len(_ZSTD[0].compress(data)) / n if data else 0.0
    out[22] = float(not words)
    out[23] = np.sqrt(folded[6] / n)
    return out


def feature_matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(len(texts), N_FEATURES)


@dataclass
class Model:
    prior: float = 0.5
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    first: np.ndarray | None = None
    second: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.first is None:
            return np.full(len(x), 0.5)
        return _sigmoid(_forward((x - self.mean) / self.scale, self.first, self.second)[1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _forward(x: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ first[:-1] + first[-1])
    return h, h @ second[:-1] + second[-1]


def train(positives: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, batch: int = 1024, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the non-negative risk with the logistic loss. Deterministic for a given order of rows."""
    if not len(positives) or not len(unlabelled):
        return Model(prior)
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = (positives - mean) / scale, (unlabelled - mean) / scale
    weights = [np.vstack([rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], HIDDEN)), np.zeros(HIDDEN)]), np.append(rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0)]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    for step in range(1, steps + 1):
        xp, xu = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
        x = np.concatenate([xp, xu])
        h, z = _forward(x, *weights)
        s = _sigmoid(z)
        sp, su = s[:batch], s[batch:]
        # Logistic loss: l(+) has slope s - 1, l(-) has slope s.
        negative = -np.log1p(-su * (1 - 1e-9)).mean() + prior * np.log1p(-sp * (1 - 1e-9)).mean()
        if negative >= 0:
            slope = np.concatenate([prior * (sp - 1) - prior * sp, su]) / batch
        else:
            slope = np.concatenate([prior * sp, -su]) / batch
        back = np.outer(slope, weights[1][:-1]) * (1 - h * h)
        grads = [np.vstack([x.T @ back, back.sum(0)]) + decay * weights[0], np.append(h.T @ slope, slope.sum()) + decay * weights[1]]
        now = rate * (0.1 if step > 0.8 * steps else 1)
        for w, g, m in zip(weights, grads, moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.001 * (g * g - m[1])
            w -= now * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return Model(prior, mean, scale, *weights)


_SAMPLE = pa.schema([("positive", pa.bool_()), ("h", pa.int64()), ("x", pa.list_(pa.float32()))])


def _sampled(batches):
    for batch in slices(batches):
        x = feature_matrix(texts_of(batch)).astype(np.float32)
        yield record(_SAMPLE, positive=batch.column("positive"), h=batch.column("h"), x=pa.array(list(x), pa.list_(pa.float32())))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Sample positives and unlabelled texts by a hash of the text, estimate the prior, train on the driver.

    ``docs`` and ``labels`` hold only rows that may be learned from. What reaches the driver is the features of
    MAX_POSITIVES and MAX_UNLABELLED rows, about.
    """
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", (F.col("quality") == 1).alias("good"))
    n_good, n_known = known.agg(F.sum(F.col("good").cast("long")), F.count("*")).first()
    n_docs = docs.select("doc_id").count()
    if not n_good or not n_docs:
        return Model()
    prior = min(0.99, max(0.01, n_good / n_known))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    rate_p, rate_u = min(1.0, MAX_POSITIVES / n_good), min(1.0, MAX_UNLABELLED / n_docs)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).withColumn("chance", chance)
    trusted = known.where("good").select("doc_id").withColumn("chance", chance).where(F.col("chance") < rate_p)
    positives = rows.where(F.col("chance") < rate_p).drop("chance").join(trusted.select("doc_id"), "doc_id")
    picked = rows.where(F.col("chance") < rate_u).select(F.lit(False).alias("positive"), "h", "text").unionByName(positives.select(F.lit(True).alias("positive"), "h", "text"))
    got = picked.mapInArrow(_sampled, "positive boolean, h long, x array<float>").collect()
    got.sort(key=lambda r: (r.positive, r.h))
    split = [np.array([r.x for r in got if r.positive is side], float).reshape(-1, N_FEATURES) for side in (True, False)]
    return train(*split, prior)


def held_in(docs: DataFrame) -> DataFrame:
    return docs.where(crc_rest("doc_id", 5) != 0)


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: the score of its text, and the prediction."""

    def run(batches):
        for batch in slices(batches):
            yield record(_OUT, doc_id=batch.column("doc_id"), score=model.scores(feature_matrix(texts_of(batch))))

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns as they were."""

    score = text_udf(lambda texts: model.scores(feature_matrix([t or "" for t in texts])).tolist(), "double", pa.float64())
    return docs.where(score("text") >= THRESHOLD)


def op8_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(held_in(docs), held_in(table(spark, sf_dir, "labels")))
    return scored(docs, model).withColumn("held_out", F.coalesce(crc_rest("doc_id", 5) == 0, F.lit(False)))


QUERIES = {"op8_quality_pu": op8_quality_pu}
ORACLES: dict[str, str] = {}
