"""Hashed character n-grams of texts, and linear classifiers over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canvass.llm.shared import stored

W = np.uint32
STEP, SPREAD = W(0x01000193), W(0x9E3779B1)  # odd constants with mixed bits
BLOCK = 1 << 19


def blocks_of(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BLOCK`` characters in all."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= BLOCK):
            size += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def hashed(texts: list[str | None], orders: tuple[int, ...], bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of the n-grams at each position of the joined texts, per order, and the cuts.

    Texts are lower-cased and parted by as many blanks as the longest order, so no n-gram holds
    letters of two texts, and words at the borders look like others.
    """
    gap = " " * max(orders)
    parts = [(t or "").lower() for t in texts]
    codes = np.frombuffer((gap + gap.join(parts) + gap).encode("utf-32-le", "surrogatepass"), W)
    cuts = np.cumsum([0, *(len(p) + len(gap) for p in parts)])
    out, running = [], np.full(len(codes), 0x811C9DC5, W)
    for n in range(1, max(orders) + 1):
        running = (running[:len(codes) - n + 1] ^ codes[n - 1:]) * STEP
        if n in orders:
            mixed = (running ^ (running >> W(15))) * SPREAD
            out.append((mixed >> W(32 - bits)).astype(np.int32))
    return out, cuts


def per_text(grams: list[np.ndarray], cuts: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([g[cuts[k]:cuts[k + 1]] for g in grams])


def held_out(part: int, of: int):
    """Whether the crc32 of the id's text has this remainder; rows without id count as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == part, F.lit(True))


#: Rows of each label that a sample holds even if the label is rare.
OF_LABEL = 200


def sample_of(docs: DataFrame, chosen: DataFrame, most: int, of_label: int = OF_LABEL) -> DataFrame:
    """The texts of at most ``most`` rows of ``chosen``(doc_id, label), taken in hash order, and of rare labels up to ``of_label``.

    Only ids that have a text count.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text").filter("text IS NOT NULL")
    ids = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).join(texts.select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    rare = ids.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(*order))).filter(F.col("rank") <= of_label)
    # written, so that Spark knows how small it is
    ids = stored(ids.orderBy(*order).limit(most).unionByName(rare.drop("rank")).distinct(), "sample")
    return texts.join(ids, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def logistic(product: Callable, transposed: Callable, target: np.ndarray, features: int, decay: float, rounds: int):
    """Weights and bias of a logistic regression with quadratic decay, by accelerated gradients."""
    weights, bias = np.zeros(features), 0.0
    ahead, ahead_bias, momentum = weights.copy(), 0.0, 1.0
    vector = np.full(features, 1 / np.sqrt(features))
    for _ in range(8):  # the largest squared singular value bounds the step
        vector = transposed(product(vector))
        norm = np.linalg.norm(vector) or 1.0
        vector = vector / norm
    step = 1 / (1.1 * (norm + len(target)) / (4 * len(target)) + decay)
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(product(ahead) + ahead_bias, -30, 30))) - target) / len(target)
        new, new_bias = ahead - step * (transposed(error) + decay * ahead), ahead_bias - step * error.sum()
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / faster
        ahead, ahead_bias = new + pull * (new - weights), new_bias + pull * (new_bias - bias)
        weights, bias, momentum = new, new_bias, faster
    return weights, bias


def columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    parts = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(parts, schema, strict=True)], schema=schema)
