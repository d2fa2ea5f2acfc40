"""Language identification with a sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams of whole texts;
document frequencies come from all training documents. The classifier is
trained with follow-the-regularised-leader (proximal), whose L1 part keeps it
sparse and whose L2 part keeps it small, on a bounded number of documents of
each label. A temperature, fitted on a part of these that training hasn't seen,
turns its scores into calibrated probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitweave.llm.common import bounded_batches, lean

#: Hashed features, and the lengths of n-grams.
BITS, ORDERS = 15, (1, 2, 3)
#: Documents of each label that the classifier is fitted on at most, and labels that it may have.
PER_LABEL, MOST_LABELS = 300, 2000
UNKNOWN = "und"

_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of a whole text's character n-grams; ASCII other than letters counts as one space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    c[(c < 97) | ((c > 122) & (c < 128))] = 32
    codes = []
    total = np.zeros(len(c) + 1, dtype=np.uint64)
    for k in ORDERS:
        if len(c) < k:
            break
        total = total[: len(c) - k + 1] + c[k - 1 :] * _MULTIPLY[k - 1]
        codes.append((total + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS))
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = np.bincount(np.concatenate(codes).astype(np.int64), minlength=1 << BITS)
    found = np.flatnonzero(n)
    return found, n[found]


def tf_idf(found: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of unit length."""
    w = (1 + np.log(n)) * idf[found]
    return w / max(np.sqrt(w @ w), 1e-12)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 4) -> np.ndarray:
    """Weights (features by classes) by FTRL-proximal over (features, weights, class) rows."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))

    def weights(z, n):
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, label = rows[i]
            w = weights(z[at], n[at])
            p = _softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            square = n[at] + g * g
            z[at] += g - (np.sqrt(square) - np.sqrt(n[at])) / alpha * w
            n[at] = square
    return weights(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature, from 0.25 to 20, with the least negative log likelihood, by golden-section search."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-300).mean())

    a, b, r = np.log(0.25), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        if loss(c) <= loss(d):
            b = d
        else:
            a = c
    return float(np.exp((a + b) / 2))


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = PER_LABEL, most_labels: int = MOST_LABELS) -> dict:
    """Fit on documents with a label; those without text or label are left out.

    Returns labels, weights (already times idf), idf and the temperature.
    Without any document there are no labels. The documents to fit on are those
    with the smallest hashes of each label, so they are the same however the
    table is dealt. All labels are learned; as the weights are held by one
    machine, more than most_labels are an error, not a choice among them.
    """
    spark = labelled.sparkSession
    bounded_batches(spark)
    docs = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    docs = docs.withColumn("h", F.xxhash64("id", "text"))

    def frequencies(batches):
        n, total = np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n[term_counts(text)[0]] += 1
                total += 1
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(n[found], total))], names=["k", "n"])

    # at most one row for each feature
    counts = docs.select("text").mapInArrow(lean(frequencies), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros((1 << BITS) + 1, dtype=np.int64)
    df[counts["k"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    chosen = docs.select("lang", "h").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= per_label)
    limits = chosen.groupBy("lang").agg(F.max("h").alias("most"))
    limits = limits.limit(most_labels + 1).collect()
    if len(limits) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    labels = sorted(r["lang"] for r in limits)
    if not labels:
        return {"labels": [], "idf": idf, "weights": np.zeros((1 << BITS, 0)), "temperature": 1.0}
    most = spark.createDataFrame([(r["lang"], r["most"]) for r in limits], "lang string, most long")

    def features(batches):
        for batch in batches:
            found = [term_counts(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0].astype("<i4").tobytes() for f in found], pa.binary()), pa.array([tf_idf(*f, idf).astype("<f4").tobytes() for f in found], pa.binary()), batch.column(1), batch.column(2)], names=["at", "x", "lang", "h"])

    sample = docs.join(F.broadcast(most), "lang").where("h <= most").select("text", "lang", "h").mapInArrow(lean(features), "at binary, x binary, lang string, h long")
    # at most per_label documents of each label, but for equal hashes of equal rows
    rows = sorted(sample.toPandas().itertuples(index=False), key=lambda r: (r.h, r.lang))
    kept: dict[tuple, tuple] = {(r.h, r.lang): (np.frombuffer(r.at, "<i4"), np.frombuffer(r.x, "<f4").astype(float), labels.index(r.lang)) for r in rows}
    every = list(kept.values())
    check, own = every[::4], [x for i, x in enumerate(every) if i % 4]
    weights = train(own or every, len(labels))
    logits = np.array([x @ weights[at] for at, x, _ in check])
    return {"labels": labels, "idf": idf, "weights": weights, "temperature": temperature(logits, np.array([c for _, _, c in check]))}


def identify(docs: DataFrame, model: dict, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with lang_out and score_out (calibrated probability, 0 to 1) in place of any such columns.

    A null text or one without a letter is `und` with score 0, and so is any
    text if the model has no labels. Only the text is looked at. Equal scores
    go to the first label in alphabetical order. Nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast({"labels": model["labels"], "idf": model["idf"], "weights": model["weights"] / model["temperature"]})
    kept = [c for c in docs.columns if c not in (lang_out, score_out)]
    at = kept.index(text_col)

    def run(batches):
        m = shared.value
        for batch in batches:
            label, score = [], np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(at).to_pylist()):
                if not m["labels"] or not has_letter(text):
                    label.append(UNKNOWN)
                    continue
                found, n = term_counts(text)
                p = _softmax(tf_idf(found, n, m["idf"]) @ m["weights"][found])
                k = int(p.argmax())
                label.append(m["labels"][k])
                score[i] = min(1.0, p[k])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label, pa.string()), pa.array(score)], names=[*kept, lang_out, score_out])

    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(lean(run), T.StructType([*(docs.schema[c] for c in kept), T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]))
