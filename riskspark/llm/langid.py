"""Language proportions of a document by expectation-maximisation, and its language set by penalised likelihood.

A model holds smoothed letter-trigram probabilities for each learned language, learned from a bounded sample.
A word's likelihood in a language is the product over its trigrams, word edges included. A document is a
mixture: expectation-maximisation over its words finds the proportions. The set of languages is the nested
set (by proportion) whose log-likelihood, less `PENALTY * log(words)` for every language beyond the first, is
highest; a document whose whole mixture gains less than one such penalty over its best single language can't
gain from a larger set and needs no further fit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.texts import Kept, bounded_sample, fold, map_texts, runs_of

BITS = 15
SAMPLE_ROWS = 3_000
SMOOTHING = 0.5
STEPS, PENALTY = 8, 2.0
UNKNOWN = "und"
RUN_BYTES = 64 << 20
#: Cells (word kind of a document, language) worked on at once; a longer document is a block of its own.
WORK_CELLS = 1 << 18


_NOT_LETTERS = re.compile(r"[^\w\n]|[\d_]")


@cache
def numbers() -> frozenset[str]:
    """Numbers that regular expressions count as word characters and that are no digits: halves, numerals and the like."""
    return frozenset(c for c in map(chr, range(128, 0x110000)) if c.isalnum() and not c.isalpha())


def letters_only(text: str) -> str:
    """The text with a blank for whatever is neither a letter nor a line end."""
    text = _NOT_LETTERS.sub(" ", text)
    found = numbers().intersection(text)
    return text.translate(dict.fromkeys(map(ord, found), " ")) if found else text


def trigrams(runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigram, number of its run) for every letter; a letter's neighbours may be the word's edge."""
    text = letters_only("\n" + "\n".join(runs).lower() + "\n")
    c = np.frombuffer(text.encode("utf-32-le"), "<u4")
    run = np.cumsum(c == 10) - 1
    c = np.where(c == 10, 32, c).astype(np.uint32)
    at = np.flatnonzero(c != 32)
    h = c[at - 1] * np.uint32(0x9E3779B1) + c[at] * np.uint32(0x85EBCA77) + c[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS), run[at]


@dataclass(frozen=True)
class LanguageModel:
    """`log_p[hash, language]`, float32; its size is 2^15 times the number of languages."""

    languages: tuple[str, ...]
    log_p: np.ndarray

    def run_rows(self, runs: list[str]) -> list[bytes]:
        """For each run, as float32: log-likelihood per language, then its number of letters."""
        grams, of = trigrams(runs)
        cols = [np.bincount(of, self.log_p[grams, k], len(runs)) for k in range(len(self.languages))]
        rows = np.stack([*cols, np.bincount(of, minlength=len(runs))], axis=1).astype(np.float32).tobytes()
        step = 4 * (len(self.languages) + 1)
        return [rows[i : i + step] for i in range(0, len(rows), step)]


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Trigram probabilities from about `sample_rows` whole texts of each non-null language of `docs`.

    Trigrams are counted in Spark; at most 2^15 counts a language reach the driver.
    """
    chosen = bounded_sample(docs.where(F.col(text).isNotNull()), lang, sample_rows, key, "language sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = total.setdefault(name, np.zeros(1 << BITS, np.int64))
                h += np.bincount(trigrams([value.replace("\n", " ")])[0], minlength=1 << BITS)
        for name, h in total.items():
            at = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(h[at])], names=["lang", "gram", "n"])

    counts = (
        chosen.select(F.col(lang).cast("string").alias("lang"), text)
        .mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    )
    languages = tuple(sorted(counts["lang"].unique()))
    table = np.full((1 << BITS, len(languages)), SMOOTHING)
    for k, name in enumerate(languages):
        own = counts[counts["lang"] == name]
        table[own["gram"].to_numpy(np.int64), k] += own["n"].to_numpy()
    return LanguageModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def mixtures(
    p: np.ndarray, times: np.ndarray, starts: np.ndarray, kinds: np.ndarray, theta: np.ndarray, steps: int = STEPS
) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of documents. `p[kind, language]` are the likelihoods of a document's different
    words, document after document (`starts`, `kinds` of them); each occurs `times`."""
    of = np.repeat(np.arange(len(starts)), kinds)
    words = np.add.reduceat(times, starts)[:, None]
    w = np.empty_like(p)
    for _ in range(steps):
        np.take(theta, of, axis=0, out=w)
        w *= p
        w *= (times / w.sum(axis=1))[:, None]
        theta = np.add.reduceat(w, starts, axis=0) / words
        theta = np.where(theta > 1e-12, theta, 0)
        theta /= theta.sum(axis=1, keepdims=True)
    np.take(theta, of, axis=0, out=w)
    w *= p
    return theta, np.add.reduceat(np.log(np.maximum(w.sum(axis=1), 1e-300)) * times, starts)


def proportions(log_p: np.ndarray, starts: np.ndarray, kinds: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Proportions over the chosen language set; `log_p[kind, language]`, every document has a word (see `mixtures`)."""
    n, langs = len(starts), log_p.shape[1]
    times = np.ones(len(log_p)) if times is None else times.astype(float)
    p = (log_p - log_p.max(axis=1, keepdims=True)).astype(np.float64)
    single = np.add.reduceat(np.maximum(p, -69) * times[:, None], starts, axis=0)
    p = np.maximum(np.exp(p, out=p), 1e-30, out=p)
    best = single.argmax(axis=1)
    theta, whole = mixtures(p, times, starts, kinds, np.full((n, langs), 1 / langs))
    price = PENALTY * np.log(np.add.reduceat(times, starts) + 1.0)
    out = np.zeros((n, langs))
    out[np.arange(n), best] = 1
    value = single[np.arange(n), best]
    order = np.argsort(-theta, axis=1, kind="stable")
    rest = np.flatnonzero(whole - value > price)
    for k in range(2, langs + 1):
        if not len(rest):
            break
        rows = np.concatenate([np.arange(starts[i], starts[i] + kinds[i]) for i in rest])
        first = np.concatenate(([0], np.cumsum(kinds[rest])[:-1]))
        begin = np.zeros((len(rest), langs))
        np.put_along_axis(begin, order[rest, :k], 1 / k, axis=1)
        fit, gain = mixtures(p[rows], times[rows], first, kinds[rest], begin)
        gain = gain - (k - 1) * price[rest]
        better = gain > value[rest]
        out[rest[better]], value[rest[better]] = fit[better], gain[better]
        rest = rest[whole[rest] - k * price[rest] > value[rest]]
    return out


def blocks(kinds: np.ndarray, cells: int) -> Iterator[slice]:
    """Documents in blocks of at most `cells` kinds of words, or of one document."""
    part = np.cumsum(kinds) // max(1, cells)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(kinds)]
    return (slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", carry=None) -> DataFrame:
    """`docs` with `lang_pred`, `score` (its proportion, 0 to 1) and `lang_mix` (language to proportion).

    `und` and 0 for a null or empty text or one without a letter; ties go to the first language by name. With
    no learned language everything is `und`. Texts are read whole; repeated rows stay. Input columns with
    these names are replaced.
    """

    def make():
        kept, langs = Kept(RUN_BYTES), len(model.languages)

        def compute(texts: list[bytes]) -> list[pa.Array]:
            runs, codes, edges = runs_of(texts)
            found = kept.all(runs, model.run_rows, 240)
            table = np.frombuffer(b"".join(found), np.float32).reshape(len(runs), langs + 1)
            names, scores, mixes = [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
            # The different words of each document, with their counts: a document costs its vocabulary, not its length.
            place = np.flatnonzero((table[:, langs] > 0)[codes]) if langs else np.zeros(0, np.int64)
            doc = np.searchsorted(edges, place, side="right") - 1
            pairs, times = np.unique(doc << 32 | codes[place], return_counts=True)
            docs_with, first, kinds = np.unique(pairs >> 32, return_index=True, return_counts=True)
            for part in blocks(kinds, WORK_CELLS // max(1, langs)):
                rows = slice(first[part][0], first[part][-1] + kinds[part][-1])
                log_p = table[pairs[rows] & 0xFFFFFFFF, :langs]
                shares = proportions(log_p, first[part] - first[part][0], kinds[part], times[rows])
                for i, share in zip(docs_with[part].tolist(), shares):
                    top = int(share.argmax())
                    names[i], scores[i] = model.languages[top], min(float(share[top]), 1.0)
                    mixes[i] = [(model.languages[k], float(share[k])) for k in np.flatnonzero(share).tolist()]
            return [pa.array(names, pa.string()), pa.array(scores), pa.array(mixes, pa.map_(pa.string(), pa.float64()))]

        return compute

    return map_texts(docs, make, "lang_pred string, score double, lang_mix map<string,double>", text, carry)


def learning_rows(docs: DataFrame) -> DataFrame:
    """The rows a language may be learned from: crc32 of the id modulo 3 is not 1, and the language is known."""
    return docs.where((fold("doc_id", 3) != 1) & F.col("lang").isNotNull())


def language_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and lang_mix of every document."""
    found = identify(docs, learn(learning_rows(docs)), carry=["doc_id"])
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "lang_mix")
