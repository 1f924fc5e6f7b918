"""Language identification by error-correcting output codes (operator 8).

Each language has a codeword; one binary classifier over hashed character n-grams predicts each
bit.  Decoding adds up, for each language, the logistic losses of its bits, weighted by how
well each classifier did in training, and takes the language of the smallest loss.  Texts whose
best two languages are close are flagged as ambiguous.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.ngrams import blocks_of, columns, hashed, held_out, logistic, per_text, sample_of
from canvass.llm.shared import prepare

ORDERS, BITS = (1, 2, 3), 12
#: Labelled rows that are learnt from.
SAMPLE = 4_000
DECAY, ROUNDS, AMBIGUOUS, UNKNOWN = 1e-5, 60, 0.1, "und"
LETTER = re.compile(r"[^\W\d_]")
VECTOR = pa.schema([("label", pa.string()), ("bucket", pa.list_(pa.int16())), ("value", pa.list_(pa.float32()))])


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    code: np.ndarray     # languages x bits, +1 or -1
    trust: np.ndarray    # weight of each bit, adding up to 1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray


def codewords(many: int) -> np.ndarray:
    """All two-way splits of up to seven languages, else random words that lie far apart."""
    if many <= 7:
        splits = [[1 if language == 0 or s >> (language - 1) & 1 else -1 for s in range(2 ** (many - 1) - 1)] for language in range(many)]
        return np.array(splits)
    bits, best, widest = int(np.ceil(10 * np.log2(many))), None, -1
    for seed in range(50):
        code = np.random.default_rng(seed).choice([-1, 1], (many, bits))
        apart = (bits - code @ code.T) / 2 + bits * np.eye(many)
        if apart.min() > widest and (np.abs(code.sum(axis=0)) < many).all():
            best, widest = code, apart.min()
    return best


def vectors(texts: list[str | None], bits: int = BITS) -> np.ndarray:
    """Square roots of the bucket counts of each text, scaled to length 1."""
    out = np.zeros((len(texts), 1 << bits), np.float32)
    for i, j in blocks_of(texts):
        grams, cuts = hashed(texts[i:j], ORDERS, bits)
        for k in range(j - i):
            out[i + k] = np.sqrt(np.bincount(per_text(grams, cuts, k), minlength=1 << bits))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def vector_rows(batches):
    for batch in batches:
        for part in range(0, batch.num_rows, 256):
            rows = batch.slice(part, 256)
            found = vectors(rows.column("text").to_pylist())
            yield columns([(label, np.flatnonzero(v).astype(np.int16), v[v > 0])
                           for label, v in zip(rows.column("label").to_pylist(), found, strict=True)], VECTOR)


def fitted(batches):
    """All bits' classifiers, from the bounded sample."""
    parts = [(b.column("label").to_pylist(), b.column("bucket").value_lengths().to_numpy(), b.column("bucket").flatten().to_numpy(),
              b.column("value").flatten().to_numpy()) for b in batches]
    labels = np.array([x for p in parts for x in p[0]])
    size, index, value = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    matrix = np.zeros((len(labels), 1 << BITS), np.float32)
    matrix[np.repeat(np.arange(len(size)), size), index] = value
    languages, which = np.unique(labels, return_inverse=True)
    code = codewords(len(languages))
    weights, bias, trust = [], [], []
    for bit in range(code.shape[1]):
        target = (code[which, bit] > 0).astype(float)
        w, b = logistic(lambda x: matrix @ x.astype(np.float32), lambda g: (g.astype(np.float32) @ matrix).astype(float),
                        target, matrix.shape[1], DECAY, ROUNDS)
        right = ((matrix @ w + b > 0) == (target > 0)).mean()
        weights.append(w)
        bias.append(b)
        trust.append(max(2 * right - 1, 1e-6))
    trust = np.array(trust) / sum(trust)
    for bit, (w, b) in enumerate(zip(weights, bias, strict=True)):
        yield pa.RecordBatch.from_arrays(
            [pa.array([bit], pa.int32()), pa.array([code[:, bit]], pa.list_(pa.int32())), pa.array([languages.tolist()], pa.list_(pa.string())),
             pa.array([trust[bit]]), pa.array([w], pa.list_(pa.float64())), pa.array([b])],
            names=["bit", "code", "languages", "trust", "weights", "bias"])


def train(docs: DataFrame, chosen: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Learn from at most ``sample`` rows of ``chosen``(doc_id, label), and up to ``ngrams.OF_LABEL`` of each; one language needs no bits."""
    prepare(docs.sparkSession)
    rows = sample_of(docs, chosen, sample)
    found = rows.mapInArrow(vector_rows, "label string, bucket array<smallint>, value array<float>")
    languages = sorted(r[0] for r in rows.select("label").distinct().collect())
    if len(languages) < 2:
        return LanguageModel(languages, np.ones((len(languages), 0)), np.ones(0), np.zeros((1 << BITS, 0)), np.zeros(0))
    # at most ``sample`` rows of 2**BITS numbers; one task fits them
    fields = "bit int, code array<int>, languages array<string>, trust double, weights array<double>, bias double"
    bits = sorted(found.repartition(1).mapInArrow(fitted, fields).collect())
    return LanguageModel(list(bits[0]["languages"]), *(np.array([b[k] for b in bits]).T for k in ("code", "trust", "weights", "bias")))


def decoded(model: LanguageModel, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the best language, its share among all, and the lead over the second."""
    margin = vectors(texts) @ model.weights + model.bias
    loss = np.logaddexp(0, -margin[:, None, :] * model.code[None]) @ model.trust
    share = np.exp(-loss * max(1, model.code.shape[1]))
    share = share / share.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    ordered = np.sort(loss, axis=1)
    lead = ordered[:, 1] - ordered[:, 0] if loss.shape[1] > 1 else np.full(len(best), np.inf)
    return best, share[np.arange(len(best)), best], lead


def predictions(model: LanguageModel):
    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = batch.slice(part, 256)
                texts = rows.column("text").to_pylist()
                if model.languages:
                    best, share, lead = decoded(model, texts)
                out = []
                for k, text in enumerate(texts):
                    if not model.languages or not text or not LETTER.search(text):
                        out.append((UNKNOWN, 0.0, True))
                    else:
                        out.append((model.languages[best[k]], float(share[k]), bool(lead[k] < AMBIGUOUS)))
                fields = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns(out, fields).columns], names=["doc_id", *fields.names])

    return run


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of each row, from the text alone.

    A text that is NULL or has no letter, or any text if nothing was learnt, is ``und`` with
    score 0 and ambiguous.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(predictions(model), "doc_id long, lang_pred string, score double, ambiguous boolean")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of each row.

    Rows whose id has remainder 2 (crc32 of its text, modulo 4), or without lang, teach nothing.
    """
    chosen = docs.filter(~held_out(2, 4) & F.col("lang").isNotNull()).select(F.col("doc_id").cast("long"), F.col("lang").alias("label"))
    return identify(docs, train(docs, chosen)).select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score", "ambiguous")
