"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; every other text of the training
fold is unlabelled. A logistic model over the presence of words and word beginnings is trained in numpy
on the risk estimator of Kiryo et al. (2017): with class prior p and the
sigmoid loss, risk = p R+(positives) + max(0, R-(unlabelled) - p R-(positives)),
and where the bracket falls below zero the step is taken on it alone, against
overfitting. The prior is the toxic share among the training fold's labels.

Bounds: at most about ``POSITIVES`` and ``UNLABELLED`` texts are used to fit
(chosen by a hash of the key, whole texts), and ``FEATURES`` words by their
chi-square between the two. Scoring covers every row in one narrow pass.

Defined results: null and empty texts get the model's intercept; a text of any
length is scored whole; repeated texts score alike; with no confirmed toxic
row every score is 0; other columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratabar.llm.common import Scratch, fold

POSITIVES = 6_000
UNLABELLED = 18_000
FEATURES = 1_024
#: Least squared z score of a feature between positives and unlabelled.
SURE = 10.8
PREFIXES = (4, 5)
PUNCT = str.maketrans(".,;:!?\"'()[]{}<>|*_#", " " * 20)


def word_set(text: str | None) -> set[str]:
    """The features of a whole text: its words, and word beginnings marked by a tilde, as inflected insults share those."""
    words = set((text or "").lower().translate(PUNCT).split())
    return words.union(*({w[:k] + "~" for w in words if len(w) > k} for k in PREFIXES))


def emit_words(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(word_set(x)) for x in batch.column(2).to_pylist()], pa.list_(pa.string()))], names=["doc_id", "pos", "words"])


def descent(theta: np.ndarray, cols: np.ndarray, at: np.ndarray, positive: np.ndarray, prior: float, decay: float) -> np.ndarray:
    """Direction of steepest ascent of the non-negative risk at ``theta``, or of the bracket's negative where that is below zero."""
    n_pos, n_unl = max(1, positive.sum()), max(1, (~positive).sum())
    z = theta[-1] + np.bincount(at, theta[cols], minlength=len(positive))
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))  # the loss of calling a text toxic, where it is not
    slope = s * (1 - s)
    negative = s[~positive].sum() / n_unl - prior * s[positive].sum() / n_pos
    # d/dz of each part; the loss of calling a positive clean is 1 - s
    push = np.where(positive, -prior * slope / n_pos, 0.0)
    bracket = np.where(positive, -prior * slope / n_pos, slope / n_unl)
    dz = push + bracket if negative >= 0 else -bracket
    return np.append(np.bincount(cols, dz[at], minlength=len(theta) - 1), dz.sum()) + decay * np.append(theta[:-1], 0.0)


def fit_weights(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float, steps: int = 600, rate: float = 0.1, decay: float = 2e-5) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk; returns weights and intercept."""
    cols = np.concatenate(rows) if len(rows) else np.zeros(0, dtype=np.int64)
    at = np.repeat(np.arange(len(rows)), np.array([len(r) for r in rows], dtype=np.int64))
    theta = np.zeros(n_features + 1)
    theta[-1] = math.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        grad = descent(theta, cols, at, positive, prior, decay)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, held: tuple[int, int] = (4, 2)) -> dict:
    """{'weights': {word: weight}, 'bias': b} from the training fold of docs and labels."""
    scratch = Scratch(spark, "toxicity")
    part = docs.select("doc_id", "text").where(fold("doc_id", held[0]) != held[1])
    toxic = labels.where((fold("doc_id", held[0]) != held[1]) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_pos, n_lab = toxic.agg(F.sum("toxic"), F.count("*")).first()
    n_all = part.count()
    if not n_pos or not n_all:
        return {"weights": {}, "bias": -700.0}
    prior = min(0.9, max(1e-4, n_pos / n_lab))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    pos = part.join(toxic.where("toxic = 1").select("doc_id"), "doc_id", "left_semi").where(draw < min(1.0, POSITIVES / n_pos)).select("doc_id", F.lit(True).alias("pos"), "text")
    unl = part.where(draw < min(1.0, UNLABELLED / n_all)).select("doc_id", F.lit(False).alias("pos"), "text")
    sample = scratch.keep("sample", pos.union(unl).mapInArrow(emit_words, "doc_id long, pos boolean, words array<string>"))
    p, u = sample.agg(F.count_if("pos"), F.count_if(~F.col("pos"))).first()
    if not p or not u:
        return {"weights": {}, "bias": -700.0}
    a, b = F.count_if("pos"), F.count_if(~F.col("pos"))
    df = sample.select("pos", F.explode("words").alias("word")).groupBy("word").agg(a.alias("a"), b.alias("b")).where(f"a + b >= {max(3, (p + u) // 2000)}")
    gap = F.col("a") / p - F.col("b") / u
    pool = (F.col("a") + F.col("b")) / (p + u)
    chosen = df.where(gap * gap >= SURE * pool * (1 - pool) * (1 / p + 1 / u)).select("word", (gap * gap / (F.col("a") / p + F.col("b") / u)).alias("chi")).orderBy(F.desc("chi"), "word").limit(FEATURES).collect()
    words = [r["word"] for r in chosen]
    index = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def design(batches):
        for batch in batches:
            ix = index.value
            rows = [np.array(sorted(ix[w] for w in ws if w in ix), dtype="<u2").tobytes() for ws in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["pos", "cols"])

    # at most 2 * FEATURES bytes a sampled text
    got = sample.select("doc_id", "pos", "words").sort("doc_id", "pos").select("pos", "words").mapInArrow(design, "pos boolean, cols binary").collect()
    rows = [np.frombuffer(bytes(r["cols"]), dtype="<u2").astype(np.int64) for r in got]
    weights, bias = fit_weights(rows, np.array([r["pos"] for r in got], dtype=bool), max(1, len(words)), prior)
    scratch.drop("sample")
    return {"weights": {w: float(x) for w, x in zip(words, weights, strict=False) if abs(x) > 1e-6}, "bias": bias}


def scores(texts: list, model: dict) -> list[float]:
    weights, bias = model["weights"], model["bias"]
    if not weights:
        return [0.0] * len(texts)
    logits = (bias + math.fsum(weights[w] for w in weights.keys() & word_set(x)) for x in texts)
    return [1 / (1 + math.exp(-max(-700.0, min(700.0, z)))) for z in logits]


def keep_below(spark: SparkSession, docs: DataFrame, model: dict, threshold: float) -> DataFrame:
    """Rows of ``docs``, all columns, that score under the threshold."""
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([s < threshold for s in scores(batch.column(at).to_pylist(), sent.value)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score(spark: SparkSession, docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row, whole texts."""
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            out = scores(batch.column(1).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def digest(scored: DataFrame, threshold: float = 0.3) -> DataFrame:
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
