"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all training texts, whatever their labels, is unlabelled, a
mixture with the class prior that the labels show. The risk is `prior * R+(positives) + max(0, R-(unlabelled) -
prior * R-(positives))`: the second part is the negatives' risk, corrected for the positives among the
unlabelled texts, and is pushed back up when it turns negative, i.e. when the model overfits. A sparse linear
model over the words and word beginnings that a text holds (each once) is trained by numpy on a bounded sample;
every text is then scored whole, in Arrow batches.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.texts import Kept, bounded_sample, fold, map_texts, runs_of

POSITIVE_ROWS, UNLABELLED_ROWS = 1_500, 7_500
EPOCHS, RATE, RIDGE, LEAST_TEXTS, EVIDENCE = 200, 0.1, 2e-4, 3, 4.0
PREFIXES = (3, 4, 5, 6, 7, 8)
RUN_BYTES = 48 << 20
_WORDS = re.compile(r"[^\W\d_]+")


def features(run: str) -> tuple[int, ...]:
    """Hashed words of a run between white space, and their beginnings."""
    low = run.lower()
    out = []
    for w in (low,) if low.isalpha() else _WORDS.findall(low):
        raw = w.encode()
        out.append(zlib.crc32(b"w" + raw))
        out += [zlib.crc32(b"p" + w[:k].encode()) for k in PREFIXES if len(w) >= k]
    return tuple(out)


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the features (32-bit hashes) that have one, and an intercept; the sample bounds their number."""

    weights: dict[int, float]
    bias: float

    def run_marks(self, runs: list[str]) -> list[tuple[int, ...]]:
        """The features of each run that have a weight; most runs have none."""
        w = self.weights
        return [tuple(f for f in features(run) if f in w) for run in runs]


def text_features(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The carried columns and `features`, a text's different features as little-endian 32-bit integers."""

    def make():
        def compute(texts: list[bytes]) -> list[pa.Array]:
            out = []
            for t in texts:
                found = {f for run in set(t.decode("utf-8").split()) for f in features(run)}
                out.append(np.array(sorted(found), "<u4").tobytes())
            return [pa.array(out, pa.binary())]

        return compute

    return map_texts(docs, make, "features binary", text, carry)


def held(known: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places in sorted `known` of the features that a text has."""
    if not len(known):
        return np.zeros(0, np.int64)
    at = np.searchsorted(known, text)
    return at[known[np.minimum(at, len(known) - 1)] == text]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> ToxicityModel:
    """Full-batch Adam on the non-negative risk, over the features that tell positives from unlabelled texts.

    A feature takes part if at least LEAST_TEXTS positives hold it and their share is above that of the
    unlabelled texts by EVIDENCE standard errors: among millions of features chance gives hardly any.
    """
    found, counts = np.unique(np.concatenate(positive), return_counts=True)
    found, counts = found[counts >= LEAST_TEXTS], counts[counts >= LEAST_TEXTS]
    others = np.zeros(len(found), np.int64)
    for t in unlabelled:
        others[held(found, t)] += 1
    n_p, n_u = len(positive), max(1, len(unlabelled))
    share, base = counts / n_p, (others + 0.5) / (n_u + 1)
    known = found[share - base > EVIDENCE * np.sqrt(base * (1 - np.minimum(base, 0.999)) * (1 / n_p + 1 / n_u))]

    def matrix(texts):
        cols = [held(known, t) for t in texts]
        return np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate(cols) if cols else np.zeros(0, np.int64), max(1, len(cols))

    (rp, cp, n_p), (ru, cu, n_u) = matrix(positive), matrix(unlabelled)
    w, b = np.zeros(len(known)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for t in range(1, EPOCHS + 1):
        fp, fu = np.bincount(rp, w[cp], n_p) + b, np.bincount(ru, w[cu], n_u) + b
        sp, su = 1 / (1 + np.exp(-np.clip(fp, -30, 30))), 1 / (1 + np.exp(-np.clip(fu, -30, 30)))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gp, gu = prior * (sp - 1) / n_p, np.zeros(n_u)
        sign = 1.0 if negative >= 0 else -1.0
        if sign < 0:
            gp = np.zeros(n_p)
        gp = gp - sign * prior * sp / n_p
        gu = gu + sign * su / n_u
        g = np.append(np.bincount(cp, gp[rp], len(w)) + np.bincount(cu, gu[ru], len(w)) + RIDGE * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w, b = w - step[:-1], b - step[-1]
    margins = np.bincount(rp, w[cp], n_p) + b, np.bincount(ru, w[cu], n_u) + b
    b -= cut(*margins, prior)
    some = np.flatnonzero(w)
    return ToxicityModel(dict(zip(known[some].tolist(), w[some].tolist())), float(b))


def cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The margin with the least corrected error, `prior * missed + max(0, taken - prior * found)`; the middle of a tie."""
    at = np.unique(np.concatenate([positive, unlabelled]))
    found = 1 - np.searchsorted(np.sort(positive), at) / len(positive)
    taken = 1 - np.searchsorted(np.sort(unlabelled), at) / max(1, len(unlabelled))
    risk = prior * (1 - found) + np.maximum(0, taken - prior * found)
    best = int(np.flatnonzero(risk <= risk.min() + 1e-12)[0])
    return float((at[best] + at[best - 1]) / 2) if best else float(at[0])


def learn(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
    positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS,
) -> ToxicityModel:
    """Model from about `positive_rows` texts labelled 1 and `unlabelled_rows` of all `docs`.

    The class prior is the share of 1 among the labels of `docs`. A text with several labels is toxic if one
    says so. Without any positive the score is the prior's floor for every text.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    known = docs.select(key, text).join(marks, key, "left")
    share = known.where("_label is not null").agg(F.avg("_label")).first()[0]
    prior = min(max(share or 0.0, 0.001), 0.999)
    # The ids of a bounded sample are joined back, so no text is shuffled.
    ids = known.where("_label = 1").select(key, F.lit("p").alias("_class"))
    chosen = bounded_sample(ids, "_class", positive_rows, key, "toxic").unionByName(
        bounded_sample(known.select(key, F.lit("u").alias("_class")), "_class", unlabelled_rows, key, "unlabelled")
    ).dropDuplicates().limit(2 * (positive_rows + unlabelled_rows))
    sample = text_features(docs.select(key, text).join(F.broadcast(chosen), key), ["_class"], text).toPandas()
    arrays = {c: [np.frombuffer(x, "<u4") for x in g] for c, g in sample.groupby("_class")["features"]}
    if not arrays.get("p"):
        return ToxicityModel({}, float(np.log(prior / (1 - prior))))
    return fit(arrays["p"], arrays.get("u", []), prior)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", carry=None) -> DataFrame:
    """`docs` with `score` (0 to 1, higher: label 1 likelier) and `predicted` (1 from 0.5 on).

    A null or empty text has the intercept's score. Texts are read whole; repeated rows stay; input columns
    with these names are replaced.
    """

    def make():
        kept = Kept(RUN_BYTES)

        def compute(texts: list[bytes]) -> list[pa.Array]:
            runs, codes, edges = runs_of(texts)
            marks = kept.all(runs, model.run_marks, 220)
            some = np.fromiter(map(len, marks), np.int64, len(marks))
            at = np.flatnonzero(some[codes])
            doc = np.searchsorted(edges, at, side="right") - 1
            pairs = np.unique(doc.astype(np.int64) << 32 | codes[at])
            doc = np.repeat(pairs >> 32, some[pairs & 0xFFFFFFFF])
            mark = np.fromiter((f for c in (pairs & 0xFFFFFFFF).tolist() for f in marks[c]), np.int64, len(doc))
            pairs = np.unique(doc << 32 | mark)
            weight = np.fromiter(map(model.weights.__getitem__, (pairs & 0xFFFFFFFF).tolist()), float, len(pairs))
            margin = model.bias + np.bincount(pairs >> 32, weight, len(texts))
            p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            return [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

        return compute

    return map_texts(docs, make, "score double, predicted int", text, carry)


def learning_rows(docs: DataFrame) -> DataFrame:
    """The rows whose labels may be learned from: crc32 of the id modulo 5 is not 0."""
    return docs.where(fold("doc_id", 5) != 0)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = learn(learning_rows(docs), learning_rows(labels))
    return score(docs, model, carry=["doc_id"]).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
