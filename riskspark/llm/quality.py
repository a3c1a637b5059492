"""Document quality by hierarchical empirical Bayes over hosts and paths.

A logistic model over the shapes of a text's runs (long ones in bounded pieces, all of them counted), its repetition and its size, trained by numpy on a bounded
sample of labelled texts, gives each document's evidence. Grouped aggregation then sums evidence (the label
where there is one, else the model's probability) by path and by host. A host's rate is shrunk toward the
global rate and a path's toward its host's, by as many pseudo-documents as the spread between the sites
supports (method of moments), so a site with few documents keeps its prior. The document's own evidence is
taken out of its site's sums before they are combined with it.

A source `host/section/...` has path `section`; without a section the document's language takes its place,
like the first folder of a multilingual site.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.texts import Kept, bounded_sample, map_texts, runs_of
from riskspark.session import materialize

SHAPES = 64
SAMPLE_ROWS = 10_000
STEPS, RIDGE = 25, 1.0
SALT = 32
RUN_BYTES = 60 << 20
#: Runs up to so many characters are remembered with their pieces.
SHORT = 24
_TWICE = re.compile(r"(.)\1+")
#: A piece: up to four groups of one symbol, of 16 characters each.
_PIECE = re.compile(r"(?:(.)\1{0,15}){1,4}", re.DOTALL)


def pattern(s: str) -> str:
    return "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in s)


def pieces(run: str) -> list[str]:
    """A run cut at Unicode white space and after every four symbols of its pattern; at most 64 characters each."""
    if len(run) <= 16 and run.isascii() and run.islower() and run.isalpha():
        return [run]
    out = []
    for part in [run] if run.isascii() else run.split():
        out += [part[m.start() : m.end()] for m in _PIECE.finditer(pattern(part))]
    return out


def shape(piece: str) -> int:
    """Hashed pattern of capitals, small letters, digits and signs of a piece; repeats count once."""
    if piece.isascii() and piece.islower() and piece.isalpha():
        return 0
    return 1 + zlib.crc32(_TWICE.sub(r"\1", pattern(piece))[:4].encode()) % (SHAPES - 1)


def pieces_of(texts: list[bytes], kept: Kept) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """((shape, length) of each different piece, the piece at each place of all texts end to end, where each text begins)."""
    runs, codes, edges = runs_of(texts)
    short = [r for r in runs if len(r) <= SHORT]
    known = dict(zip(short, kept.all(short, lambda new: [[(x, shape(x)) for x in pieces(r)] for r in new], 500)))
    number, shapes, flat, count = {}, [], [], []
    for r in runs:
        found = known[r] if r in known else [(x, None) for x in pieces(r)]
        for x, s in found:
            at = number.setdefault(x, len(number))
            if at == len(shapes):
                shapes.append((shape(x) if s is None else s, len(x)))
            flat.append(at)
        count.append(len(found))
    count = np.array(count, np.int64)
    first = np.cumsum(count) - count
    each = count[codes]
    upto = np.concatenate(([0], np.cumsum(each)))
    places = np.arange(upto[-1]) + np.repeat(first[codes] - upto[:-1], each)
    return np.array(shapes, np.int64).reshape(-1, 2), np.array(flat, np.int64)[places], upto[edges]


def text_signals(texts: list[bytes], kept: Kept) -> np.ndarray:
    """A row of SHAPES + 5 numbers for each text; zeros for an empty one."""
    shapes, codes, edges = pieces_of(texts, kept)
    n = len(texts)
    out = np.zeros((n, SHAPES + 5))
    total = np.diff(edges)
    if not len(codes):
        return out
    of = np.repeat(np.arange(n), total)
    some = np.maximum(total, 1)
    hist = np.bincount(of * SHAPES + shapes[codes, 0], minlength=n * SHAPES).reshape(n, SHAPES)
    out[:, :SHAPES] = np.sqrt(hist / some[:, None])
    pairs, counts = np.unique(of.astype(np.int64) << 32 | codes, return_counts=True)
    out[:, SHAPES] = np.bincount(pairs >> 32, minlength=n) / some
    most = np.zeros(n)
    np.maximum.at(most, pairs >> 32, counts)
    out[:, SHAPES + 1] = most / some
    same = (codes[1:] == codes[:-1]) & (of[1:] == of[:-1])
    out[:, SHAPES + 2] = np.bincount(of[1:][same], minlength=n) / some
    out[:, SHAPES + 3] = np.log1p(total)
    out[:, SHAPES + 4] = np.bincount(of, shapes[codes, 1], n) / some
    return out


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self, signals: np.ndarray) -> np.ndarray:
        x = np.hstack([(signals - self.mean) / self.scale, np.ones((len(signals), 1))])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -12, 12)))


def fit(signals: np.ndarray, labels: np.ndarray) -> QualityModel:
    """Ridge logistic regression by Newton steps. One class alone, or no rows, gives the smoothed share."""
    width = SHAPES + 5
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return QualityModel(np.zeros(width), np.ones(width), np.append(np.zeros(width), np.log(share / (1 - share))))
    mean, scale = signals.mean(axis=0), signals.std(axis=0) + 1e-3
    x = np.hstack([(signals - mean) / scale, np.ones((len(signals), 1))])
    w, ridge = np.zeros(width + 1), RIDGE * np.diag([1.0] * width + [1e-6])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (labels - p) - ridge @ w)
        w = w + step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
    return QualityModel(mean, scale, w)


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Text model from about `sample_rows` labelled texts of each class; several labels of a text: the lowest."""
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).cast("int").alias("_label"))
    chosen = bounded_sample(marks, "_label", sample_rows, key, "quality").limit(8 * sample_rows)

    def make():
        kept = Kept(RUN_BYTES)
        return lambda texts: [pa.array(list(text_signals(texts, kept)), pa.list_(pa.float64()))]

    rows = map_texts(docs.select(key, text).join(F.broadcast(chosen), key), make, "signals array<double>", text, ["_label"]).toPandas()
    return fit(np.array(rows["signals"].tolist()).reshape(-1, SHAPES + 5), rows["_label"].to_numpy(float))


def evidence(docs: DataFrame, model: QualityModel, text: str = "text", carry=None) -> DataFrame:
    """`docs` with `text_score`, the model's probability of good quality (an input column of that name is replaced)."""

    def make():
        kept = Kept(RUN_BYTES)
        return lambda texts: [pa.array(model.probability(text_signals(texts, kept)))]

    return map_texts(docs, make, "text_score double", text, carry)


def site(source: Column, lang: Column) -> tuple[Column, Column]:
    """(host, path) of a source; null or empty parts become an empty name."""
    parts = F.split(F.regexp_replace(F.coalesce(source, F.lit("")), r"^\w+://", ""), "/")
    path = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    return F.lower(F.get(parts, F.lit(0))), F.when(path != "", path).otherwise(F.coalesce(lang, F.lit("")))


def moments(sites: DataFrame, n: str, s: str) -> tuple[float, float]:
    """(overall rate, pseudo-documents of the prior) of groups with `n` documents and evidence `s`."""
    rate = F.col(s) / F.col(n)
    row = sites.agg(F.count("*"), F.sum(n), F.sum(s), F.sum(F.col(n) * F.col(n)), F.sum(F.col(n) * rate * rate), F.sum(F.col(n) * rate * (1 - rate))).first()
    k, total, good = row[0] or 0, float(row[1] or 0), float(row[2] or 0)
    overall = (good + 0.5) / (total + 1)
    if k < 2 or total <= k:
        return overall, 1e6
    between = max(row[4] - good * good / total, 0) / (k - 1)
    within = row[5] / (total - k)
    size = (total - float(row[3]) / total) / (k - 1)
    spread = (between - within) / size if size > 0 else 0.0
    return overall, float(min(max(within / spread if spread > 0 else 1e6, 1.0), 1e6))


def combine(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, host, path, text_score, known) with the rates of their sites and the combined `score`.

    Sums are aggregated map-side, by path and then by host, so a hot host is one row a task. Sites meet the
    documents in a join salted by a hash of the document: a hot site's documents spread over SALT tasks.
    """
    mine = scored.withColumn("_e", F.coalesce(F.col("known").cast("double"), F.col("text_score")))
    paths = mine.groupBy("host", "path").agg(F.count("*").cast("double").alias("_n"), F.sum("_e").alias("_s"))
    paths = materialize(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("_n").alias("_hn"), F.sum("_s").alias("_hs"))
    overall, weight = moments(hosts, "_hn", "_hs")
    _, path_weight = moments(paths, "_n", "_s")
    table = paths.join(hosts, "host").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    mine = mine.withColumn("_salt", F.pmod(F.xxhash64(F.col(key), F.col("text_score")), F.lit(SALT)).cast("int"))
    joined = mine.join(table, ["host", "path", "_salt"])
    odds = lambda p: F.log(p / (1 - p))
    host = (F.col("_hs") - F.col("_e") + weight * overall) / (F.col("_hn") - 1 + weight)
    path = (F.col("_s") - F.col("_e") + path_weight * F.col("host_rate")) / (F.col("_n") - 1 + path_weight)
    inside = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    margin = odds(F.col("text_score")) + odds(F.col("path_rate")) - F.lit(float(np.log(overall / (1 - overall))))
    return (
        joined.withColumn("host_rate", inside(host)).withColumn("path_rate", inside(path))
        .withColumn("score", 1 / (1 + F.exp(-margin)))
        .select(key, "host", "path", "text_score", "host_rate", "path_rate", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    )


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of every document: doc_id, host, path, text_score, host_rate, path_rate, score, predicted.

    A null or empty text has the model's evidence for an empty one; a null source is a host with an empty
    name. A document with several labels counts once, with the lowest; repeated rows stay.
    """
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("known"))
    host, path = site(F.col("source"), F.col("lang"))
    rows = docs.select("doc_id", "text", host.alias("host"), path.alias("path"))
    scored = evidence(rows, learn(docs, labels), carry=["doc_id", "host", "path"])
    return combine(materialize(scored, "evidence").join(marks, "doc_id", "left"))
