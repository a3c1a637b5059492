"""Licence families of paragraphs: a sparse word n-gram logistic model, confirmed against templates.

The model is multinomial logistic regression over the presence of the templates' word pairs and triples that
hold a telling word, i.e. one that isn't among COMMON. It is trained on variants of the templates (each word left
out, each stretch of most of the words) and on a bounded sample of paragraphs of the corpus that resemble no
template, the class `unknown`. A held-out part of both sets the probability from which a family is believed: the
lowest that keeps CALIBRATED of the believed held-out paragraphs right; all others are `unknown`. A believed
family is confirmed by the closest of its templates.

A paragraph without a feature has the score of an empty one, `unknown`. Every feature holds a pair that is a feature
(two neighbouring words, one of them telling), so the paragraphs with such a pair are written out as candidates and
scored by joins with the weights: `the mit` counts, while German `mit` or a lone `by` makes no candidate. All of it is DataFrame functions and Spark's own
learner.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.texts import once
from riskspark.session import materialize

UNKNOWN = "unknown"
SAMPLE_PARAGRAPHS = 4_000
CALIBRATED, OVERLAP = 0.99, 0.6

#: The usual short notices of each family.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("public-domain", "This work has been dedicated to the public domain under CC0 1.0."),
    ("proprietary", "All rights reserved."),
]


#: Words of the templates that any text may hold; no feature is made of them alone.
COMMON = set("a all and any are as at be been binary can copy except file files following for form free has have in is it "
             "may met not obtain of or person program project redistribute source subject terms that the this to under use v version "
             "with without work you 0 1 2 3 4".split())


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def ngrams(words: Column) -> Column:
    """Different pairs and triples of neighbouring words."""
    n = F.size(words)
    of = lambda k: F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.array_distinct(F.concat(*[F.when(n >= k, of(k)).otherwise(F.array().cast("array<string>")) for k in (2, 3)]))


def neighbours(words: Column) -> Column:
    """Pairs of neighbouring words; a last word's is with the empty word. `words` is evaluated once, not for every word."""
    return once(words, lambda ws: F.zip_with(
        ws, F.concat(F.slice(ws, F.lit(2), F.size(ws)), F.array(F.lit(""))), lambda a, b: F.concat_ws(" ", a, b)
    ))


@dataclass(frozen=True)
class LicenceModel:
    """`weights[term][family]`, intercepts, the believed probability; the templates bound all sizes."""

    families: list[str]
    terms: list[str]
    weights: list[list[float]]
    intercepts: list[float]
    believed: float


def templates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(TEMPLATES)], "template int, family string, notice string")
    return rows.withColumn("words", words_of(F.col("notice"))).withColumn("grams", ngrams(F.col("words")))


def telling(known: DataFrame) -> tuple[list[str], list[str]]:
    """(telling words, terms): every term holds a telling word."""
    rows = known.select("words", "grams").collect()
    words = sorted({w for r in rows for w in r["words"]} - COMMON)
    return words, sorted({g for r in rows for g in r["grams"] if not set(g.split()) <= COMMON})


def variants(known: DataFrame) -> DataFrame:
    """(family, words): each template whole (several times), without one word, and in stretches of most of its words."""
    n = F.size("words")
    least = F.greatest(F.lit(3), F.ceil(n * 0.7).cast("int"))
    without = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.slice("words", F.lit(1), i - 1), F.slice("words", i + 1, n)))
    stretches = F.transform(F.sequence(F.lit(1), n - least + 1), lambda i: F.slice("words", i, least))
    return known.select("family", F.explode(F.concat(F.array_repeat(F.col("words"), 8), without, stretches)).alias("words"))


def matches(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(id, template, _f, notice, n_own, n_template, common) for every template that shares n-grams with a row (id, grams)."""
    theirs = known.select("template", F.col("family").alias("_f"), "notice", F.size("grams").alias("n_template"), F.explode("grams").alias("gram"))
    own = rows.select("id", F.size("grams").alias("n_own"), F.explode("grams").alias("gram"))
    return own.join(F.broadcast(theirs), "gram").groupBy("id", "template", "_f", "notice", "n_own", "n_template").agg(F.count("*").alias("common"))


def sample_paragraphs(docs: DataFrame, known: DataFrame, text: str, rows: int) -> DataFrame:
    """About `rows` different paragraphs of the corpus that hold under a third of any template's n-grams."""
    n = docs.count()
    lines = docs.where(F.length(text) > 0).select(F.explode(F.split(text, "\n")).alias("line")).where(F.length("line") > 0)
    chosen = F.pmod(F.xxhash64("line"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, rows / max(1, 4 * n))) + 1)
    some = lines.where(chosen).distinct().limit(4 * rows).select(F.monotonically_increasing_id().alias("id"), words_of(F.col("line")).alias("words"))
    some = materialize(some.withColumn("grams", ngrams(F.col("words"))), "paragraph-sample")
    like = matches(some, known).where(3 * F.col("common") >= F.col("n_template")).select("id").distinct()
    return some.join(F.broadcast(like), "id", "left_anti").select(F.lit(UNKNOWN).alias("family"), "words")


def fit(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_PARAGRAPHS) -> LicenceModel:
    """Model and calibration from the templates and about `sample_rows` paragraphs of `docs`."""
    spark = docs.sparkSession
    known = templates(spark)
    rows = variants(known).unionByName(sample_paragraphs(docs, known, text, sample_rows))
    _, terms = telling(known)
    families = [UNKNOWN, *sorted({f for f, _ in TEMPLATES})]
    label = F.array_position(F.lit(families), F.col("family")).cast("double") - 1
    rows = rows.select(label.alias("label"), ngrams(F.col("words")).alias("grams")).withColumn("fold", F.pmod(F.xxhash64(F.array_join("grams", "|")), F.lit(5)))
    rows = materialize(rows, "licence-rows")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    weight = F.get(F.lit([1.0 / sizes.get(float(k), 1) for k in range(len(families))]), F.col("label").cast("int")) * float(sum(sizes.values()) / len(families))
    counted = CountVectorizerModel.from_vocabulary(terms, inputCol="grams", outputCol="features").setBinary(True)
    vectors = counted.transform(rows.withColumn("weight", weight))
    # Templates are always trained on; only the corpus and the variants beyond a fold are held out.
    train = LogisticRegression(family="multinomial", regParam=3e-4, maxIter=60, standardization=False, weightCol="weight")
    model = train.fit(vectors.where("fold <> 0 or label > 0").coalesce(2))
    top = F.array_max(vector_to_array("probability"))
    held = model.transform(vectors.where("fold = 0")).select((F.col("label") == F.col("prediction")).alias("ok"), F.round(top, 3).alias("top"), "prediction")
    counts = held.where("prediction > 0").groupBy("top").agg(F.count("*").alias("n"), F.count_if("ok").alias("right")).orderBy(F.desc("top")).collect()
    believed, n, right = 0.5, 0, 0
    for r in counts:  # at most a thousand rounded probabilities
        n, right = n + r["n"], right + r["right"]
        if right < CALIBRATED * n:
            break
        believed = max(0.5, r["top"])
    coefficients, width = model.coefficientMatrix.toArray(), len(families)
    return LicenceModel(
        families, terms, [[float(coefficients[k][i]) for k in range(width)] for i in range(len(terms))],
        [float(model.interceptVector[k]) for k in range(width)], min(believed, 0.9),
    )


def scan(docs: DataFrame, model: LicenceModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, paragraph, family, probability, template, overlap, confirmed): every paragraph of a believed family.

    `paragraph` counts lines from 0. `overlap` is the share of the closest template's n-grams that the paragraph
    holds, or of its own that the template holds if that is more; `confirmed` from OVERLAP on. Null and empty
    texts and `unknown` paragraphs give no row; repeated rows repeat. Other columns are left out.
    """
    spark = docs.sparkSession
    known = templates(spark)
    gate, terms = telling(known)
    pairs = [t for t in terms if t.count(" ") == 1]
    lines = docs.where(F.length(text) > 0).select(F.col(key).alias("_key"), F.posexplode(F.split(text, "\n")).alias("paragraph", "line"))
    words = lines.where(F.length("line") > 0).select("_key", "paragraph", words_of(F.col("line")).alias("words"))
    some = words.where(F.arrays_overlap("words", F.lit(gate))).where(F.arrays_overlap(neighbours(F.col("words")), F.lit(pairs))).withColumn("id", F.monotonically_increasing_id())
    some = materialize(some, "licence-candidates")
    some = materialize(some.select("id", "_key", "paragraph", ngrams(F.col("words")).alias("grams")), "licence-grams")
    weights = spark.createDataFrame(list(zip(model.terms, model.weights)), "gram string, w array<double>")
    width = range(len(model.families))
    margins = some.select("id", F.explode("grams").alias("gram")).join(F.broadcast(weights), "gram").groupBy("id").agg(
        *[(F.sum(F.get("w", F.lit(k))) + model.intercepts[k]).alias(f"z{k}") for k in width]
    )
    top = F.greatest(*[F.col(f"z{k}") for k in width])
    odds = margins.withColumn("top", top).select(
        "id", *[F.exp(F.col(f"z{k}") - F.col("top")).alias(f"e{k}") for k in width]
    )
    total = sum((F.col(f"e{k}") for k in width), F.lit(0.0))
    best = F.coalesce(*[F.when(F.col(f"e{k}") == 1.0, F.lit(model.families[k])) for k in width])
    believed = odds.select("id", (1 / total).alias("probability"), best.alias("family")).where((F.col("family") != UNKNOWN) & (F.col("probability") >= model.believed))
    rows = some.join(believed, "id")
    share = F.greatest(F.col("common") / F.col("n_template"), F.col("common") / F.col("n_own"))
    near = matches(rows.select("id", "grams"), known).withColumn("share", share)
    near = near.groupBy("id", "_f").agg(F.max(F.struct("share", F.negative("template").alias("t"), "notice")).alias("near"))
    found = rows.join(near.withColumnRenamed("_f", "family"), ["id", "family"], "left")
    overlap = F.coalesce(F.col("near.share"), F.lit(0.0))
    return found.select(
        F.col("_key").alias(key), F.col("paragraph").cast("long").alias("paragraph"), "family", F.round("probability", 6).alias("probability"),
        F.col("near.notice").alias("template"), F.round(overlap, 6).alias("overlap"), (overlap >= OVERLAP).alias("confirmed"),
    )


def licence_paragraphs(docs: DataFrame) -> DataFrame:
    """Every licence paragraph of the documents."""
    return scan(docs, fit(docs))
