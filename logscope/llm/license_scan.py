"""License scans by a trained paragraph classifier, confirmed by templates.

Paragraphs are runs of neighbouring lines with words, and each such line alone: a notice may be wrapped, or stand in one line
among others. They are turned into lower-case word n-grams of 1 to 3 words. A sparse (L1) multinomial logistic
regression is trained on slices of license notices, one class per family, and on paragraphs of the corpus as class
``unknown``. On slices and paragraphs held out, the margin between the best family and ``unknown`` is calibrated to a
probability; below a half the paragraph stays unknown. The prediction is compared with the templates of its family:
confirmed if the paragraph holds 0.8 or more of a template's five-word shingles (shorter templates: of its words in a row).

All of it is DataFrame operations and Spark's own estimators. The training set is bounded: the templates below, and the
paragraphs of the ``NEGATIVE_DOCS`` documents with the least hash, ``NEGATIVES`` at most. The scan covers all documents:
a document that holds no word of any n-gram in favour of a family cannot be predicted, and is left out first. What is found in
a paragraph are the n-grams of the model it holds, in time linear in its words; their weights are summed per paragraph, by
numbers, so no text is shuffled to be classified and a notice in a third of all documents is no hot key.

A paragraph of several lines gives a row, at its first line, unless one of its lines alone is confirmed for the same family or
resembles a template as much.

Defined results: null and blank texts have no paragraphs; a document without predicted paragraphs gives no row;
repeated rows each give their rows.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from logscope.functions.staged import computed
from logscope.llm import common

#: Common wordings of license notices. Several lines of a family are several templates.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE file in the project root for full license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Released under the BSD License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *dict.fromkeys(f for f, _ in TEMPLATES))
NEGATIVE_DOCS, NEGATIVES = 500, 3000
GRAMS, SHINGLE, SIMILAR = 3, 5, 0.8


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _slices(tokens: Column, n: int) -> Column:
    """The n-grams of a column of words, joined by blanks; none if there are fewer words."""
    last = F.size(tokens) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(
        F.array().cast("array<string>")
    )


def _grams(tokens: Column) -> Column:
    return F.array_distinct(F.concat(*[_slices(tokens, n) for n in range(1, GRAMS + 1)]))


def _templates(spark: SparkSession) -> DataFrame:
    rows = F.inline(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(k).alias("template"), F.lit(t).alias("text")) for k, (f, t) in enumerate(TEMPLATES)]))
    tokens = spark.range(1).select(rows).withColumn("tokens", _tokens(F.col("text")))
    shingles = F.when(F.size("tokens") >= SHINGLE, _slices(F.col("tokens"), SHINGLE)).otherwise(F.array(F.array_join("tokens", " ")))
    return tokens.withColumn("shingles", F.array_distinct(shingles))


def _held(paragraph: Column, shingles: Column) -> Column:
    """The share of shingles that stand in a paragraph of words joined by blanks."""
    padded = F.concat(F.lit(" "), paragraph, F.lit(" "))
    return F.size(F.filter(shingles, lambda s: F.contains(padded, F.concat(F.lit(" "), s, F.lit(" "))))) / F.size(shingles)


def _paragraphs(docs: DataFrame, *keys: str) -> DataFrame:
    lines = docs.select(*keys, F.posexplode(F.split(F.col("text"), "\n")).alias("line_no", "line"))
    return lines.withColumn("tokens", _tokens(F.col("line"))).where(F.size("tokens") > 0).select(
        *keys, "line_no", "tokens", F.array_join("tokens", " ").alias("paragraph")
    )


def _units(docs: DataFrame, words: list[str]) -> DataFrame:
    """(row, doc_id, block, line_no, n_lines, tokens, paragraph): runs of lines with words, where longer than a line, and each line.

    Only those with one of ``words``. ``row`` numbers the rows of ``docs``, ``block`` is the first line of the run. Comment
    marks made of letters are taken off runs; others hold no words.
    """
    rows = computed(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"), lines=F.split("text", "\n")).drop("text")
    rows = computed(rows, said=F.transform("lines", lambda x: F.lower(x).rlike("[a-z0-9]")))
    at = lambda i: F.coalesce(F.get("said", i), F.lit(False))
    places = F.sequence(F.lit(0), F.size("said") - 1)
    rows = computed(rows, start=F.filter(places, lambda i: at(i) & ~at(i - 1)), end=F.filter(places, lambda i: at(i) & ~at(i + 1)))
    runs = rows.select("doc_id", "row", "lines", F.inline(F.arrays_zip("start", "end"))).select(
        "doc_id", "row", F.col("start").alias("block"), F.expr("slice(lines, start + 1, end - start + 1)").alias("lines")
    )
    plain = F.transform("lines", lambda x: F.regexp_replace(x, r"^\s*(?i:rem|dnl)\b", ""))
    whole = F.struct(F.col("block").alias("line_no"), F.size("lines").alias("n_lines"), F.array_join(plain, " ").alias("line"))
    single = F.transform("lines", lambda x, i: F.struct((F.col("block") + i).alias("line_no"), F.lit(1).alias("n_lines"), x.alias("line")))
    units = runs.select("doc_id", "row", "block", F.inline(F.when(F.size("lines") > 1, F.concat(F.array(whole), single)).otherwise(single)))
    units = computed(units, tokens=_tokens(F.col("line"))).drop("line")
    return units.where(F.exists("tokens", lambda t: t.isin(words)))


def _features(units: DataFrame, grams: list[str]) -> DataFrame:
    """``units`` (tokens, ...) with the n-grams of the model that a unit holds.

    Its words are looked up once; n-grams are made of neighbours that are both words of the model, by one pass for each length.
    """
    words = sorted({w for g in grams for w in g.split(" ")})
    units = computed(units, known=F.transform("tokens", lambda t: F.when(t.isin(words), t)))
    made = units
    before = "known"
    for n in range(2, GRAMS + 1):
        behind = F.slice("known", F.lit(n), F.greatest(F.size("known") - (n - 1), F.lit(0)))
        made = computed(made, **{f"known{n}": F.zip_with(before, behind, lambda a, b: F.concat(a, F.lit(" "), b))})
        before = f"known{n}"
    parts = ["known", *[f"known{n}" for n in range(2, GRAMS + 1)]]
    found = F.array_distinct(F.filter(F.concat(*parts), lambda g: g.isin(grams)))
    return computed(made, grams=found).drop(*parts)


def _examples(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(family, tokens, held_out): slices of the templates, and paragraphs of the corpus that no template resembles."""
    n = F.size("tokens")
    cut = F.least(F.lit(3), F.floor(n / 4).cast("int"))
    sliced = templates.select("family", "tokens", n.alias("n"), cut.alias("cut")).select(
        "family", "tokens", "n", "cut", F.explode(F.sequence(F.lit(0), "cut")).alias("front")
    ).select("family", "tokens", "n", "front", F.explode(F.sequence(F.lit(0), "cut")).alias("back"))
    known = sliced.select("family", F.expr("slice(tokens, front + 1, n - front - back)").alias("tokens"), F.expr("(front + 2 * back) % 4 = 3").alias("held_out"))
    some = docs.where("text IS NOT NULL").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(NEGATIVE_DOCS)
    own = _paragraphs(some, "doc_id").select("tokens", "paragraph").distinct().orderBy(F.xxhash64("paragraph")).limit(NEGATIVES)
    alike = own.join(F.broadcast(templates.select("shingles")), _held(F.col("paragraph"), F.col("shingles")) >= 0.5, "left_anti")
    unknown = alike.select(F.lit(UNKNOWN).alias("family"), "tokens", (F.pmod(F.xxhash64("paragraph"), F.lit(4)) == 3).alias("held_out"))
    label = F.element_at(F.create_map(*[x for k, f in enumerate(FAMILIES) for x in (F.lit(f), F.lit(float(k)))]), F.col("family"))
    rows = known.unionByName(unknown).select("family", label.alias("label"), _grams(F.col("tokens")).alias("grams"), "held_out")
    # A few thousand rows: two tasks for each of the many passes of the estimators.
    return common.written(rows.coalesce(2), "examples")


def _scored(units: DataFrame, keys: list[str], weights: DataFrame, intercepts: list[float]) -> DataFrame:
    """``keys`` of ``units`` (keys, grams) with the best family and its margin over unknown. ``weights`` has the model's n-grams alone."""
    each = units.select(*keys, F.explode("grams").alias("gram")).join(F.broadcast(weights), "gram")
    logits = each.groupBy(*keys).agg(*[(F.sum(f"w{k}") + F.lit(b)).alias(f"z{k}") for k, b in enumerate(intercepts)])
    best = F.array_max(F.array(*[F.struct(F.col(f"z{k}").alias("z"), F.lit(f).alias("family")) for k, f in enumerate(FAMILIES) if k]))
    return logits.select(*keys, best.alias("best"), "z0").select(*keys, "best.family", (F.col("best.z") - F.col("z0")).alias("margin"))


def cue_words(weights: list[tuple], intercepts: list[float], least: float, common_words: dict[str, int]) -> list[str]:
    """Words, rare in the corpus, such that no paragraph without any of them can reach the margin ``least``.

    Without cues, a paragraph has n-grams of other words only. A bound of its margin for a family is what all of those add
    in favour of the family; cues are taken, first those that are rarest for what they add, until that is too little for every
    family.
    """
    adds: dict[str, float] = {}
    for g, z in weights:
        for w in set(g.split(" ")):
            adds[w] = adds.get(w, 0.0) + max(0.0, max(z[1:]) - z[0])
    words = sorted(adds, key=lambda w: (common_words.get(w, 0) / (adds[w] + 1e-9), -len(w), w))
    gain = [(set(g.split(" ")), [max(0.0, x - z[0]) for x in z[1:]]) for g, z in weights]
    cues: set[str] = set()
    for word in words:
        reach = [b - intercepts[0] + sum(x[k] for _, x in gain) for k, b in enumerate(intercepts[1:])]
        # What the corpus does not say costs nothing as a cue.
        if common_words.get(word) and max(reach) < least:
            break
        cues.add(word)
        gain = [(own, x) for own, x in gain if word not in own]
    return sorted(cues)


class Classifier:
    """What training yields: weights per n-gram, intercepts, the calibration, and the words without which nothing is predicted."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        self.templates = _templates(spark)
        examples = _examples(docs, self.templates)
        # The features are the n-grams of notices; what else a paragraph of the corpus says is no evidence for a family.
        counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True).fit(examples.where(F.col("label") > 0))
        # Each class weighs the same, as families have few examples and unknown has many.
        sizes = examples.groupBy("label").agg(F.count("*").alias("n"))
        train = counter.transform(examples.where("NOT held_out")).join(F.broadcast(sizes), "label").withColumn("weight", 1 / F.col("n"))
        fitted = LogisticRegression(family="multinomial", weightCol="weight", regParam=1e-4, elasticNetParam=1.0, maxIter=60, tol=1e-4).fit(train)
        matrix, self.intercepts = fitted.coefficientMatrix.toArray(), [float(b) for b in fitted.interceptVector.toArray()]
        rows = [(g, *map(float, matrix[:, j])) for j, g in enumerate(counter.vocabulary) if abs(matrix[:, j]).max() > 1e-6]
        self.grams = [r[0] for r in rows]
        schema = StructType([StructField("gram", StringType()), *[StructField(f"w{k}", DoubleType()) for k in range(len(FAMILIES))]])
        self.weights = common.written(spark.createDataFrame(rows, schema), "weights")
        named = common.written(examples.where("held_out").withColumn("paragraph", F.monotonically_increasing_id()), "held")
        margins = _scored(named, ["paragraph"], self.weights, self.intercepts)
        held = named.join(margins, "paragraph").select((F.col("label") > 0).cast("double").alias("label"), "margin")
        line = LogisticRegression(regParam=1e-3).fit(VectorAssembler(inputCols=["margin"], outputCol="features").transform(held))
        self.slope, self.shift = float(line.coefficients[0]), float(line.intercept)
        seen = examples.where(F.col("label") == 0).select(F.explode("grams").alias("word")).join(self.weights.select(F.col("gram").alias("word")), "word")
        common_words = {r["word"]: r["count"] for r in seen.groupBy("word").count().collect()}
        least = -self.shift / self.slope if self.slope > 0 else float("-inf")
        self.words = cue_words([(r[0], r[1:]) for r in rows], self.intercepts, least, common_words)

    def probability(self, margin: Column) -> Column:
        return 1 / (1 + F.exp(-(margin * self.slope + self.shift)))


def scan(docs: DataFrame, trained_on: DataFrame | None = None) -> DataFrame:
    """(doc_id, line_no, family, probability, template, similarity, confirmed) of each paragraph of ``docs`` predicted to be a license notice."""
    model = Classifier(docs if trained_on is None else trained_on)
    some = docs.select("doc_id", "text").where(F.exists(F.split(F.lower("text"), "[^a-z0-9]+"), lambda t: t.isin(model.words)))
    unit = ["row", "line_no", "n_lines"]
    found = _features(_units(some, model.words), model.grams).where(F.size("grams") > 0)
    found = common.written(found.select(*unit, "doc_id", "block", F.array_join("tokens", " ").alias("paragraph"), "grams"), "paragraphs")
    predicted = _scored(found, unit, model.weights, model.intercepts).withColumn("probability", model.probability(F.col("margin"))).where("probability >= 0.5")
    compared = found.join(predicted, unit).join(F.broadcast(model.templates.select("family", "template", "shingles")), "family").select(
        *unit, "doc_id", "block", "family", "probability", (-F.col("template")).alias("template"), _held(F.col("paragraph"), F.col("shingles")).alias("similarity")
    )
    best = compared.groupBy(*unit, "doc_id", "block", "family", "probability").agg(F.max(F.struct("similarity", "template")).alias("best"))
    notices = best.select(*unit, "doc_id", "block", "family", "probability", (-F.col("best.template")).alias("template"), "best.similarity")
    notices = common.written(notices, "notices").withColumn("confirmed", F.col("similarity") >= SIMILAR)
    lines = notices.where("n_lines = 1").groupBy("row", "block", "family").agg(F.max("similarity").alias("best"))
    known = (F.col("n_lines") > 1) & F.col("best").isNotNull() & ((F.col("best") >= SIMILAR) | (F.col("best") >= F.col("similarity")))
    return notices.join(lines, ["row", "block", "family"], "left").where(~known).select(
        "doc_id", "line_no", "family", "probability", "template", "similarity", "confirmed"
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
