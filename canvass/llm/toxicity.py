"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes ratios (operator 7).

Training, on a bounded sample of labelled rows: tasks count in how many toxic and other texts
each bucket of n-grams occurs, Spark adds the counts; the buckets whose shares differ most
surely are kept, each with its log-count ratio; a logistic regression is fitted over presence
times ratio.  Scoring reads whole texts and needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.ngrams import blocks_of, columns, hashed, held_out, logistic, per_text, sample_of
from canvass.llm.shared import by_text, prepare

ORDERS, BITS = (3, 4, 5), 18
#: Labelled rows that are learnt from, and buckets that are kept.
SAMPLE, FEATURES = 8_000, 1 << 13
SMOOTH, DECAY, ROUNDS, THRESHOLD = 1.0, 2e-5, 300, 0.7

COUNTS = pa.schema([("bucket", pa.int32()), ("toxic", pa.int64()), ("other", pa.int64())])
PRESENT = pa.schema([("label", pa.int32()), ("buckets", pa.list_(pa.int32()))])


@dataclass(frozen=True)
class ToxicityModel:
    """A weight per bucket (0 where the bucket is not used) and the bias."""

    weights: np.ndarray
    bias: float
    bits: int = BITS


def bucket_counts(bits: int):
    def run(batches):
        counts = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            texts, labels = batch.column("text").to_pylist(), batch.column("label").to_pylist()
            for i, j in blocks_of(texts):
                grams, cuts = hashed(texts[i:j], ORDERS, bits)
                for k in range(j - i):
                    counts[1 - labels[i + k]][np.unique(per_text(grams, cuts, k))] += 1
        used = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(c[used]) for c in counts)], schema=COUNTS)

    return run


def present_buckets(kept: np.ndarray, bits: int):
    def run(batches):
        for batch in batches:
            texts, labels, rows = batch.column("text").to_pylist(), batch.column("label").to_pylist(), []
            for i, j in blocks_of(texts):
                grams, cuts = hashed(texts[i:j], ORDERS, bits)
                for k in range(j - i):
                    here = per_text(grams, cuts, k)
                    rows.append((labels[i + k], np.unique(here[kept[here]])))
            yield columns(rows, PRESENT)

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> ToxicityModel:
    """Learn from at most ``sample`` labelled rows, and up to ``ngrams.OF_LABEL`` of each label; NULL labels and texts teach nothing.

    The ``features`` buckets whose share differs most surely between the labels are kept, the others have no weight.

    Without both classes the model is the share of toxic rows, or 0 without any row.
    """
    prepare(docs.sparkSession)
    chosen = labels.filter(F.col("toxic").isNotNull()).select(
        F.col("doc_id").cast("long"), (F.col("toxic") > 0).cast("int").alias("label"))
    rows = sample_of(docs, chosen, sample).select("label", "text")
    sizes = dict(rows.groupBy("label").count().collect())
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return ToxicityModel(np.zeros(1 << BITS), 20.0 if toxic else -20.0)
    counted = rows.mapInArrow(bucket_counts(BITS), "bucket int, toxic long, other long").groupBy("bucket").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    p, q = (F.col("toxic") + SMOOTH) / (toxic + 2 * SMOOTH), (F.col("other") + SMOOTH) / (other + 2 * SMOOTH)
    share = (F.col("toxic") + F.col("other") + 2 * SMOOTH) / (toxic + other + 4 * SMOOTH)
    surely = F.abs(p - q) / F.sqrt(share * (1 - share) * (1 / toxic + 1 / other))
    best = counted.select("bucket", F.log(p / q).alias("ratio"), surely.alias("z")).orderBy(F.desc("z"), "bucket").limit(features).collect()
    ratio = np.zeros(1 << BITS)
    ratio[[r["bucket"] for r in best]] = [r["ratio"] for r in best]
    found = rows.mapInArrow(present_buckets(ratio != 0, BITS), "label int, buckets array<int>")
    # at most ``sample`` rows of ``features`` buckets; one task fits them
    weights = found.repartition(1).mapInArrow(fitted(ratio), "bucket int, weight double").collect()
    out = np.zeros(1 << BITS)
    for r in weights:
        if r["bucket"] >= 0:
            out[r["bucket"]] = r["weight"]
    return ToxicityModel(out, next(r["weight"] for r in weights if r["bucket"] < 0))


def fitted(ratio: np.ndarray):
    def run(batches):
        parts = [(b.column("label").to_numpy(), b.column("buckets").value_lengths().to_numpy(), b.column("buckets").flatten().to_numpy())
                 for b in batches]
        target, size, index = (np.concatenate(x) for x in zip(*parts, strict=True))
        used = np.flatnonzero(ratio)
        place = np.searchsorted(used, index).astype(np.int32)
        del index
        scale, row = ratio[used], np.repeat(np.arange(len(size), dtype=np.int32), size)

        def product(w):
            return np.bincount(row, (scale * w)[place], len(size))

        def transposed(g):
            return scale * np.bincount(place, g[row], len(used))

        weights, bias = logistic(product, transposed, target.astype(float), len(used), DECAY, ROUNDS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(weights * ratio[used], bias))], names=["bucket", "weight"])

    return run


def scores(model: ToxicityModel):
    """A function from texts to scores."""
    table = model.weights.astype(np.float32)

    def score(texts: list[str | None]) -> list[float]:
        out = []
        for i, j in blocks_of(texts):
            grams, cuts = hashed(texts[i:j], ORDERS, model.bits)
            used = [np.flatnonzero(table[g]) for g in grams]
            edges = [np.searchsorted(u, cuts) for u in used]
            for k in range(j - i):
                here = np.concatenate([g[u[e[k]:e[k + 1]]] for g, u, e in zip(grams, used, edges, strict=True)])
                out.append(1 / (1 + np.exp(-np.clip(model.bias + model.weights[np.unique(here)].sum(), -30, 30))))
        return out

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """row (the columns of ``docs``) and value, the score of its text from 0 to 1.

    A NULL text scores as an empty one.  Only the text is scored.
    """
    return by_text(docs, lambda: scores(model), pa.float64(), "double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row.

    Labels whose id has remainder 1 (crc32 of its text, modulo 3) are held out.
    """
    model = train(docs, labels.filter(~held_out(1, 3)))
    scored = score_toxicity(docs.select(F.col("doc_id").cast("long"), "text"), model).select("row.doc_id", F.col("value").alias("score"))
    return scored.select("doc_id", held_out(1, 3).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold; learns like ``toxicity``."""
    model = train(docs, labels.filter(~held_out(1, 3)))
    return score_toxicity(docs, model).filter(F.col("value") < threshold).select("row.*")
