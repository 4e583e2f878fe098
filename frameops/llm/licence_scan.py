"""Licences of texts: an n-gram logistic regression names a paragraph's family, templates confirm it. Built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from frameops.llm.store import stored

UNKNOWN = "unknown"
#: Copies of every template with words dropped and other words put in, and paragraphs of the corpus, that train the classifier.
VARIANTS = 24
MAX_PARAGRAPHS = 4_000
#: Share of the unknown paragraphs of the calibration set that may pass as a licence.
FALSE_ALARMS = 0.005
#: Share of a template's word pairs that a paragraph has to hold to be confirmed, or the share of its own in the template.
AGREEMENT = 0.6
SEED = 17
# fixed values: wording of licence families
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT license. See LICENSE for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        " files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,"
        " publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the"
        " License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        " \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
        " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public"
        " License as published by the Free Software Foundation."),
    "AGPL": ("Licensed under the GNU Affero General Public License, version 3.",),
    "BSD": (
        "Released under the BSD 3-Clause License.", "Licensed under the two-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
        " derived from this software without specific prior written permission."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "Licensed under the Mozilla Public License, version 2.0."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "public-domain": ("Released into the public domain under CC0 1.0.",
                      "This is free and unencumbered software released into the public domain."),
    "proprietary": ("All rights reserved.", "Copyright (c) the authors. All rights reserved.",
                    "No part of this publication may be reproduced without the prior written permission of the publisher."),
}
# fixed values: sentences with the words of licences that license nothing
UNLICENSED = (
    "You need a valid license to drive a car in this state.", "Her fishing license expired in the spring of that year.",
    "The museum is open to the public and all visitors need permission to take pictures.", "All rooms are reserved until Monday.",
    "Civil rights and public law are taught under a general programme.", "Copyright law differs from patent law in most countries.",
    "The software was released in version 2.0 after a long delay.", "The Apache helicopter was seen over the desert.",
    "He studied at MIT before the war.", "The terms of the contract were not met under any conditions.",
    "A general work permit is granted to any person who asks for it.", "The commons are open for grazing without charge.",
)
# fixed values: words too common to tell anything alone
COMMON = ("a", "all", "an", "and", "any", "are", "as", "at", "be", "by", "either", "for", "from", "in", "into", "is", "it", "its", "may", "no",
          "not", "of", "on", "or", "part", "that", "the", "this", "to", "under", "with", "you", "c", "s", "v")
CUE = r"(?i)licen[cs]e|copyright|rights|permission|domain|redistribut|warrant|\bcc\b"


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def grams(words: Column) -> Column:
    """Distinct words and word pairs of a paragraph, common words only in pairs."""
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.size(words)),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(F.array_except(words, F.array(*map(F.lit, COMMON))), pairs))


@dataclass
class Model:
    """Weights per gram and family, divided by the calibrated temperature, and the least probability of a licence."""

    families: list[str]
    vocabulary: list[str]
    weights: DataFrame
    bias: list[float]
    threshold: float
    templates: DataFrame


def _variants(spark: SparkSession) -> DataFrame:
    """Templates with words dropped and foreign words put in, by hashes of their places."""
    rows = [(f, i, t) for f, own in TEMPLATES.items() for i, t in enumerate(own)] + [
        (UNKNOWN, i, t) for i, t in enumerate(UNLICENSED)]
    fillers = F.array(*(F.lit(w) for t in UNLICENSED for w in t.lower().replace(".", "").split()))
    chance = lambda *salt: F.pmod(F.xxhash64("family", "i", "variant", *map(F.lit, salt)), F.lit(1000)) / 1000
    words = word_array(F.col("text"))
    noisy = F.flatten(F.transform(words, lambda w, at: (
        F.when(F.pmod(F.xxhash64("family", "i", "variant", at), F.lit(100)) < F.col("variant") % 6 * 5, F.array().cast("array<string>"))
        .when(F.pmod(F.xxhash64("variant", "family", at, "i"), F.lit(100)) < F.col("variant") % 4 * 4, F.array(
            w, F.element_at(fillers, F.pmod(F.xxhash64(at, "variant", "i"), F.size(fillers)).cast("int") + 1)))
        .otherwise(F.array(w)))))
    return (
        spark.createDataFrame(rows, "family string, i int, text string")
        .withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
        .select("family", grams(noisy).alias("grams"), (chance("fold") < 0.3).alias("held"))
    )


def paragraphs(docs: DataFrame, text_col: str) -> DataFrame:
    """Non-empty lines of every whole text, numbered from 0."""
    return docs.select("*", F.posexplode(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"\n+")).alias(
        "paragraph", "line")).filter(F.trim("line") != "")


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """The classifier: templates with noise are its licences, sentences and paragraphs without licence words the unknown class.

    At most ``MAX_PARAGRAPHS`` paragraphs, the first by a hash, come from ``docs``; an empty table only has the sentences.
    Three tenths are held back: on them the temperature is set that makes the probabilities fit best, and the least
    probability that lets through ``FALSE_ALARMS`` of the unknown paragraphs.
    """
    spark = docs.sparkSession
    plain = (
        paragraphs(docs.select(F.col(text_col).alias("_text")), "_text").filter(~F.rlike("line", F.lit(CUE)))
        .select("line").orderBy(F.xxhash64("line", F.lit(SEED)), "line").limit(MAX_PARAGRAPHS)
        .select(F.lit(UNKNOWN).alias("family"), grams(word_array(F.col("line"))).alias("grams"),
                (F.pmod(F.xxhash64("line"), F.lit(10)) < 3).alias("held"))
    )
    families = [UNKNOWN, *TEMPLATES]
    number = F.create_map(*(x for i, f in enumerate(families) for x in (F.lit(f), F.lit(float(i)))))
    rows = stored(_variants(spark).union(plain).withColumn("label", number[F.col("family")]).coalesce(4))
    vocabulary = sorted(r[0] for r in _template_grams(spark).select("gram").distinct().collect())
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    seen = vectors.transform(rows)
    trained = LogisticRegression(family="multinomial", regParam=0.002, maxIter=60).fit(seen.filter(~F.col("held")))
    # the calibration set is small: the training set is bounded
    held = seen.filter("held").select("features", "label").collect()
    weights, bias = trained.coefficientMatrix.toArray(), trained.interceptVector.toArray()
    if weights.shape[0] < len(families):
        raise ValueError("every family needs a template in the training set")
    logits = np.array([bias + weights @ r["features"].toArray() for r in held])
    labels = np.array([int(r["label"]) for r in held])

    def probabilities(temperature: float) -> np.ndarray:
        x = np.exp((logits - logits.max(1, keepdims=True)) / temperature)
        return x / x.sum(1, keepdims=True)

    temperature = min((t / 10 for t in range(2, 41)), key=lambda t: -np.log(
        probabilities(t)[np.arange(len(labels)), labels] + 1e-12).mean())
    p = probabilities(temperature)
    alarms = np.sort(1 - p[labels == 0, 0])
    threshold = float(max(0.5, alarms[int(np.ceil(len(alarms) * (1 - FALSE_ALARMS))) - 1] if len(alarms) else 0.5))
    table = spark.createDataFrame(
        [(g, [float(x) for x in weights[:, i] / temperature]) for i, g in enumerate(vocabulary)], "gram string, weights array<double>")
    return Model(families, vocabulary, table, [float(b) for b in bias / temperature], min(threshold, 0.95), _template_grams(spark))


def _template_grams(spark: SparkSession) -> DataFrame:
    """``family``, ``template``, ``gram`` and ``size``: the grams of every template."""
    rows = [(f, f"{f}/{i}", t) for f, own in TEMPLATES.items() for i, t in enumerate(own)]
    own = grams(word_array(F.col("text")))
    return spark.createDataFrame(rows, "family string, template string, text string").select(
        "family", "template", F.size(own).alias("size"), F.explode(own).alias("gram"))


def find(docs: DataFrame, model: Model, text_col: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Paragraphs that the model takes for a licence: ``keys``, ``paragraph``, ``family``, ``probability``, ``agreement``, ``confirmed``.

    Scores of a paragraph are the sums of its distinct grams' weights, found by a broadcast join with the vocabulary of the
    templates; a paragraph without any known gram is unknown. The family is confirmed if a template of it shares
    enough grams. Null and empty texts have no paragraphs.
    """
    rows = paragraphs(docs.select(*keys, F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("_text")), "_text")
    own = rows.select("_row", *keys, "paragraph", grams(word_array(F.col("line"))).alias("grams"))
    # only what the templates know leaves the paragraph
    vocabulary = F.array(*map(F.lit, model.vocabulary))
    hits = own.withColumn("grams", F.explode(F.array("grams"))).select(
        "_row", *keys, "paragraph", F.size("grams").alias("own"), F.explode(F.array_intersect("grams", vocabulary)).alias("gram"))
    # bounded by the templates
    known = model.weights.join(
        model.templates.groupBy("gram").agg(F.collect_list(F.struct("template", "family", "size")).alias("templates")), "gram")
    sums = [F.sum(F.col("weights")[i]).alias(f"w{i}") for i in range(len(model.families))]
    n = F.count(F.lit(1))
    scored = hits.join(F.broadcast(known), "gram").groupBy("_row", *keys, "paragraph").agg(
        *sums, F.first("own").alias("own"), n.alias("n"), F.flatten(F.collect_list("templates")).alias("templates"))
    logits = F.array(*(F.col(f"w{i}") + F.lit(b) for i, b in enumerate(model.bias)))
    scored = scored.withColumn("logits", logits)
    top = F.array_max("logits")
    total = F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    place = F.array_position(F.col("logits"), top).cast("int")
    names = F.array(*map(F.lit, model.families))
    scored = scored.withColumns({
        "family": F.element_at(names, place), "probability": 1 / total,
        "licence": 1 - F.exp(F.col("logits")[0] - top) / total})
    taken = scored.filter((F.col("family") != UNKNOWN) & (F.col("licence") >= model.threshold))
    mine = F.filter("templates", lambda t: t["family"] == F.col("family"))
    shares = F.transform(F.array_distinct(mine), lambda t: F.size(F.filter(mine, lambda u: u["template"] == t["template"]))
                         / F.least(t["size"], F.greatest(F.col("own"), F.lit(4))))
    return taken.select("_row", *keys, "paragraph", "family", "probability", F.least(
        F.coalesce(F.array_max(shares), F.lit(0.0)), F.lit(1.0)).alias("agreement")).withColumn(
        "confirmed", F.col("agreement") >= AGREEMENT)


def documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, confirmed ``licences`` by name, ``n_licences``, and ``n_unknown`` paragraphs.

    ``n_unknown`` counts paragraphs like a licence that no template confirms. Rows with null ids, null or empty texts and
    repeated rows give one row each; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"key": F.xxhash64("doc_id", "text"), "check": F.hash("text")})
    found = find(rows, model, "text", ("key", "check")).groupBy("_row", "key", "check").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("licences"),
        F.count_if("confirmed").alias("n_licences"), F.count_if(~F.col("confirmed")).alias("n_unknown"),
    ).dropDuplicates(["key", "check"])
    return rows.select("doc_id", "key", "check").join(found, ["key", "check"], "left").select(
        "doc_id", F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n_licences", F.lit(0)).cast("long").alias("n_licences"),
        F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"))
