"""Licence notices in documents: a trained paragraph classifier, confirmed by templates.

Method: a paragraph (line) is described by its word pairs and triples, as far as templates of
licence notices have them. A multinomial logistic regression over these sparse counts tells the
licence families and an unknown class apart; it is trained on whole, cropped and thinned
templates against the paragraphs of all documents. A threshold on the family's probability, taken
from the same paragraphs, calibrates what stays unknown. Paragraphs that have the same of the templates'
grams are one row with their number, so that fitting on all of them takes what their kinds take.

Scored are bounded windows of words, not whole paragraphs: from each hit of a template as far as
twice the template's length, up to the last of its pairs that is new there. A family counts if a
window has most of the pairs of one of its templates (confirmation) and its probability in that
window passes, so a notice is found in a line of any length and beside other notices; a window
whose pairs all belong to a longer passing window of another family does not count. Lines of
at most ``SHORT`` words are scored whole, too; there it also confirms if the line's own pairs are
mostly one template's.

Notices are wrapped in most files, so windows run over line ends, too: a line's last word makes a pair with the
first word of the next line that has words (comment signs are no words), unless a line without words lies between,
and places are counted through the whole document. A notice over several lines is reported once, with the
line in which it begins, unless windows within a line hold as many of a template's pairs there.

Scoring uses DataFrame functions only: every word pair of every paragraph is looked up in a
broadcast set of the templates' pairs, whose size the templates bound, and only confirmed
windows are scored.

Words are runs of ASCII letters and digits in lower case. Null and empty texts have no
paragraphs. Documents are scanned whole; repeated rows are judged each on its own; every family
that passes is reported once a line; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signbridge.llm.common import gathered, stored

#: Weight of a background paragraph in training, and the documents as which all together weigh at most; share of background
#: that may pass, least confirmation.
BACKGROUND_WEIGHT = 0.1
BACKGROUND_DOCUMENTS = 300
PASSING = 0.001
CONFIRMED = 0.6
#: Words of a line that is scored whole, too (more than any template has); words ahead that a window may reach, in lengths of its template.
SHORT = 64
SPREAD = 2
#: Places in a block: more than a window can reach.
BLOCK = 4096

# Public licence notices and sentences from licence texts, by family.
TEMPLATES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Affero General Public License, version 3.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD License.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "Licensed under the MIT license. See the LICENSE file in the project root for license information.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This document contains confidential and proprietary information and may not be copied or disclosed without written consent.",
    ],
}
# Sentences with words of licences that are none.
OTHERS = [
    "You need a driving license to rent a car here.", "The work is done under the supervision of a licensed engineer.",
    "The software is distributed to all offices of the company.", "This version of the program was released under the old name.",
    "The terms of the agreement are under review by the foundation.", "He was granted permission to use the public library.",
]
UNKNOWN = "unknown"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _plain(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _grams(tokens: list[str]) -> list[str]:
    return [" ".join(tokens[i: i + n]) for n in (2, 3) for i in range(len(tokens) - n + 1)]


def template_table(spark: SparkSession) -> DataFrame:
    """(template, family, gram, size, length): the distinct word pairs of each template, how many it has, and its words."""
    rows = []
    for t, (family, text) in enumerate((f, x) for f, texts in TEMPLATES.items() for x in texts):
        pairs = sorted({g for g in _grams(_plain(text)) if g.count(" ") == 1})
        rows += [(t, family, g, len(pairs), len(_plain(text))) for g in pairs]
    return spark.createDataFrame(rows, "template int, family string, gram string, size int, length int")


def vocabulary() -> list[str]:
    """All pairs and triples of the templates: the features, bounded by the templates."""
    return sorted({g for texts in TEMPLATES.values() for x in texts for g in _grams(_plain(x))})


def _n_grams(token: Column) -> Column:
    """How many different pairs and triples the words have."""
    pairs = F.zip_with(token, F.slice(token, 2, F.size(token)), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    triples = F.zip_with(pairs, F.slice(token, 3, F.size(token)), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    # both end with nulls, which count as one
    return F.when(F.size(token) > 1, F.size(F.array_distinct(pairs)) + F.size(F.array_distinct(triples)) - 2).otherwise(0)


def background(found: DataFrame) -> tuple[DataFrame, int, int, int]:
    """(grams, n), written: the templates' grams in a paragraph, and in how many paragraphs of all documents just these
    are. Then the numbers of paragraphs of several words without any, of those of one word, and of documents.

    Paragraphs that share most of their pairs with the templates may be notices: they teach nothing and are left out."""
    spark = found.sparkSession
    grams = vocabulary()
    known = F.broadcast(spark.createDataFrame(list(enumerate(grams)), "g int, gram string"))
    triple = F.when(F.col("pos") + 2 < F.col("n_words"), F.col("triple"))  # within the line
    each = found.where(F.col("in_line") & F.col("pair").isNotNull())
    each = each.select("_row", "line", "n_grams", F.explode(F.array("pair", triple)).alias("gram")).join(known, "gram")
    own = each.groupBy("_row", "line").agg(F.array_sort(F.collect_list("g")).alias("g"), F.max("n_grams").alias("n_grams"))
    notice = F.size(F.array_distinct("g")) >= 0.3 * F.col("n_grams")
    kinds = stored(own.groupBy("g", notice.alias("notice")).agg(F.count("*").alias("n")), "licence-kinds")
    some = kinds.agg(F.sum("n")).first()[0] or 0
    first = found.where(F.coalesce("pos", F.lit(0)) == 0)
    counts = first.agg(F.count_if(F.col("n_words") > 1), F.count_if(F.col("n_words") == 1), F.count_if(F.col("line") == 0)).first()
    names = F.array(*map(F.lit, grams))
    kinds = gathered(kinds).where(~F.col("notice")).select(F.transform("g", lambda i: F.get(names, i)).alias("grams"), "n")
    return kinds, counts[0] - some, counts[1], counts[2]


def train(docs: DataFrame, found: DataFrame | None = None) -> tuple[list[str], list[tuple[str, list[float]]], list[float], float]:
    """Classes (the last is the unknown one), weights of each gram, intercepts, and the calibrated threshold, learned
    from all rows of ``docs`` (or their ``hits``)."""
    spark = docs.sparkSession
    grams = vocabulary()
    families = [*sorted(TEMPLATES), UNKNOWN]
    rows = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            t = _plain(text)
            half = (len(t) + 1) // 2
            variants = [t, t[:half + 1], t[half - 1:], *([w for i, w in enumerate(t) if i % k != k - 1] for k in (5, 7))]
            rows += [(float(families.index(family)), _grams(v), 1.0) for v in variants]
    rows += [(float(len(families) - 1), _grams(_plain(x)), 1.0) for x in OTHERS]
    made = spark.createDataFrame(rows, "label double, grams array<string>, weight double").coalesce(1)
    kinds, plain, single, documents = background(hits(docs) if found is None else found)
    none = lambda n: spark.createDataFrame([([], n)], "grams array<string>, n long").where("n > 0")
    # all documents weigh as much as so many: else the unknown class would grow with them, and the templates do not
    weight = BACKGROUND_WEIGHT * min(1.0, BACKGROUND_DOCUMENTS / max(1, documents))
    sample = kinds.unionByName(none(plain)).select(F.lit(float(len(families) - 1)).alias("label"), "grams", (F.col("n") * weight).alias("weight"))
    vectors = CountVectorizerModel.from_vocabulary(grams, inputCol="grams", outputCol="features", minTF=1.0)
    data = vectors.transform(made.unionByName(sample)).select("label", "features", "weight").cache()
    fitted = LogisticRegression(family="multinomial", weightCol="weight", regParam=2e-3, elasticNetParam=0.2, standardization=False, maxIter=60).fit(data)
    data.unpersist()
    matrix = fitted.coefficientMatrix.toArray()
    weights = [(g, matrix[:, i].tolist()) for i, g in enumerate(grams)]
    intercepts = fitted.interceptVector.toArray().tolist()
    calibration = fitted.transform(vectors.transform(kinds.unionByName(none(plain + single))))
    best = F.array_max(F.slice(vector_to_array("probability"), 1, len(families) - 1))
    best = F.greatest(F.round(best, 6), F.lit(0.5))  # no lower threshold is taken, and so few values are counted
    level = calibration.agg(F.percentile(best, F.lit(1 - PASSING), F.col("n")).alias("p")).first()["p"]
    return families, weights, intercepts, max(0.5, level or 0.0)


def hits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Written once: _row, _id, line, n_words, n_grams, pos, pair and triple of every template pair, and of each line's first
    place; in_line says that the pair does not run over the line's end."""
    pairs = template_table(docs.sparkSession).select(F.col("gram").alias("pair")).distinct()
    pairs = pairs.select(F.split("pair", " ")[0].alias("first"), F.split("pair", " ")[1].alias("second"), "pair")
    keyed = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    lines = keyed.select("_row", "_id", F.split("_text", "\n").alias("_lines")).withColumn("_lines", F.transform("_lines", words))
    following = F.zip_with("_lines", F.slice("_lines", 2, F.size("_lines")), lambda line, after: F.struct(
        line.alias("words"), F.concat(line, F.slice(F.coalesce(after, F.array().cast("array<string>")), 1, 2)).alias("run")))
    lines = lines.select("_row", "_id", F.posexplode(following).alias("line", "_line"))
    lines = lines.select("_row", "_id", "line", F.col("_line.words").alias("_words"), F.col("_line.run").alias("_run"))
    lines = lines.withColumn("n_grams", _n_grams(F.col("_words")))
    at = lines.select("_row", "_id", "line", "_words", "_run", "n_grams", F.posexplode_outer("_words").alias("pos", "_word"))
    at = at.select("_row", "_id", "line", "pos", F.size("_words").alias("n_words"), "n_grams", F.col("_word").alias("a"),
                   F.get("_run", F.col("pos") + 1).alias("b"), F.get("_run", F.col("pos") + 2).alias("c"))
    at = at.withColumn("key", F.when(F.col("b").isNotNull(), F.xxhash64("a", "b")))
    pairs = F.broadcast(pairs.withColumn("key", F.xxhash64("first", "second")))
    found = at.join(pairs, (at["key"] == pairs["key"]) & (at["a"] == pairs["first"]) & (at["b"] == pairs["second"]), "left")
    first = F.coalesce("pos", F.lit(0)) == 0  # a row for each line, so for each document
    found = found.where(F.col("pair").isNotNull() | first)
    return stored(found.select("_row", "_id", "line", "n_words", "n_grams", "pos", "pair", F.concat_ws(" ", "pair", "c").alias("triple"),
                               (F.col("pos") + 1 < F.col("n_words")).alias("in_line")), "licence-hits")


def _places(found: DataFrame) -> DataFrame:
    """Hits of documents with template pairs, written once: begin is the line's first place in its document, pos the
    pair's. One running sum over a document's lines and hits."""
    some = found.where(F.col("pair").isNotNull()).select("_row").distinct()
    first = F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("n_words")).otherwise(0).cast("long")
    before = Window.partitionBy("_row").orderBy("line", "pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = found.drop("_id", "n_grams").join(some, "_row", "left_semi").withColumn("begin", F.sum(first).over(before) - F.col("n_words"))
    return stored(rows.where(F.col("pair").isNotNull()).withColumn("pos", F.col("begin") + F.col("pos")), "licence-places")


def _spread(own: DataFrame, parts: list[str]) -> DataFrame:
    """Confirmed windows that begin at each of own's hits and reach ahead within ``parts``, as ``_windows`` returns them.

    Places are cut into blocks; hits near a block's begin count in the block before, too, for windows that reach
    over, so that no task holds more of a document than a block and what follows it."""
    block = F.floor(F.col("pos") / BLOCK)
    early = (F.col("pos") - block * BLOCK <= SPREAD * F.col("length")) & (block > 0)
    own = own.withColumn("_block", F.explode(F.when(early, F.array(block, block - 1)).otherwise(F.array(block))))
    ahead = Window.partitionBy(*parts, "template", "_block").orderBy(F.col("pos") / F.col("length")).rangeBetween(0, SPREAD)
    own = own.withColumn("near", F.collect_list(F.struct("pos", "pair", "line", "in_line")).over(ahead)).where(F.col("_block") == block)
    own = own.withColumn("kinds", F.array_distinct("near.pair"))
    last = F.array_position("near.pair", F.element_at("kinds", -1)).cast("int")  # where the last new pair comes first
    own = own.withColumn("_end", F.element_at("near", last)).where(F.size("kinds") >= CONFIRMED * F.col("size"))
    return own.select("_row", "line", F.col("pos").alias("start"), F.col("_end.pos").alias("end"), "family",
                      (F.size("kinds") / F.col("size")).alias("confirmation"), "kinds", F.size("kinds").cast("long").alias("n"),
                      ((F.col("_end.line") > F.col("line")) | ~F.col("_end.in_line")).alias("wrapped"))


def _windows(hits: DataFrame) -> DataFrame:
    """_row, line, start, end, family, confirmation, kinds, n, wrapped: the confirmed windows (places of their first and
    last pairs, line of the first), their template's pairs in them (null for a whole line) and how many, and whether they
    run over a line's end."""
    templates = template_table(hits.sparkSession).withColumnRenamed("gram", "pair")
    within = hits.where("in_line")
    distinct = within.groupBy("_row", "line", "pair").agg(F.max("n_words").alias("n_words"), F.max("begin").alias("begin"))
    cover = distinct.join(F.broadcast(templates), "pair")
    cover = cover.groupBy("_row", "line", "family", "template").agg(F.count("*").alias("c"), F.max("size").alias("size"),
                                                                    F.max("n_words").alias("n_words"), F.max("begin").alias("begin"))
    part = F.greatest(F.col("c") / F.col("size"), F.when(F.col("c") >= 3, F.col("c") / F.greatest(F.col("n_words") - 1, F.lit(1))))
    whole = cover.where(F.col("n_words") <= SHORT).groupBy("_row", "line", "family")
    whole = whole.agg(F.max("n_words").alias("n_words"), F.max("begin").alias("begin"), F.max(part).alias("confirmation"), F.max("c").alias("n"))
    whole = whole.where(F.col("confirmation") >= CONFIRMED)
    whole = whole.select("_row", "line", F.col("begin").alias("start"), (F.col("begin") + F.col("n_words") - 2).alias("end"), "family",
                         "confirmation", F.lit(None).cast("array<string>").alias("kinds"), "n", F.lit(False).alias("wrapped"))
    columns = ["_row", "line", "pos", "pair", "in_line"]
    # a line without most of a template's pairs has no window with them
    able = cover.where(F.col("c") >= CONFIRMED * F.col("size")).select("_row", "line", "template")
    own = within.select(*columns).join(able, ["_row", "line"]).join(F.broadcast(templates), ["template", "pair"])
    # nor has a document; and one whose template pairs all lie within lines has no wrapped window
    all_ = hits.select(*columns).join(F.broadcast(templates), "pair")
    able = all_.groupBy("_row", "template").agg(F.count_distinct("pair").alias("c"), F.max("size").alias("_size"), F.min("in_line").alias("_in"))
    able = able.where((F.col("c") >= CONFIRMED * F.col("_size")) & ~F.col("_in")).select("_row", "template")
    over = _spread(all_.join(able, ["_row", "template"]), ["_row"]).where("wrapped")
    return whole.unionByName(_spread(own, ["_row", "line"])).unionByName(over)


def _notices(passed: DataFrame) -> DataFrame:
    """_row, line, family, p, confirmation. Windows of a family that overlap, one after another, are a group: if one
    that runs over line ends has more of a template's pairs than any within a line, the group is one notice, in its
    first line; else those within a line count, once a line."""
    so_far = Window.partitionBy("_row", "family").orderBy("start", "end", "line")
    reach = F.max("end").over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    passed = passed.withColumn("_new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    passed = passed.withColumn("_group", F.sum("_new").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("_row", "family", "_group")
    most = lambda wrapped: F.coalesce(F.max(F.when(F.col("wrapped") == wrapped, F.col("n"))).over(group), F.lit(0))
    passed = passed.withColumn("_over", most(True) > most(False)).withColumn("line", F.when(F.col("_over"), F.min("line").over(group)).otherwise(F.col("line")))
    return passed.where(F.col("_over") | ~F.col("wrapped")).groupBy("_row", "line", "family").agg(
        F.max("p").alias("p"), F.max("confirmation").alias("confirmation"))


def _probabilities(grams: DataFrame, keys: list[str], model: tuple) -> DataFrame:
    """keys and probabilities: of the model's classes, in their order."""
    families, weights, intercepts = model[:3]
    table = F.broadcast(grams.sparkSession.createDataFrame(weights, "gram string, w array<double>"))
    sums = grams.join(table, "gram").groupBy(*keys).agg(*(F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(families))))
    logits = F.array(*(F.col(f"s{k}") + F.lit(b) for k, b in enumerate(intercepts)))
    sums = sums.select(*keys, logits.alias("l")).withColumn("top", F.array_max("l"))
    powers = sums.select(*keys, F.transform("l", lambda x: F.exp(x - F.col("top"))).alias("e"))
    powers = powers.withColumn("total", F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x))
    return powers.select(*keys, F.transform("e", lambda x: x / F.col("total")).alias("probabilities"))


def scan(docs: DataFrame, model: tuple, doc_id: str = "doc_id", text: str = "text", found: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs`` (or of their ``hits``): doc_id, n_paragraphs, notices (array of line, family, p, confirmation;
    confirmed ones), families."""
    families, least = model[0], model[3]
    found = hits(docs, doc_id, text) if found is None else found
    places = _places(found)
    windows = stored(_windows(places), "licence-windows")
    keys = ["_row", "start", "end"]
    block = lambda place: F.floor(F.col(place) / SHORT)
    spans = windows.select(*keys).distinct().withColumn("block", F.explode(F.sequence(block("start"), block("end"))))
    inside = places.withColumn("block", block("pos")).join(spans, ["_row", "block"]).where(F.col("pos").between(F.col("start"), F.col("end")))
    triple = F.when(F.col("pos") < F.col("end"), F.col("triple"))  # the last pair's ends outside
    scores = _probabilities(inside.select(*keys, F.explode(F.array("pair", triple)).alias("gram")), keys, model)
    place = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("int")
    passed = stored(windows.join(scores, keys).withColumn("p", F.element_at("probabilities", place)).where(F.col("p") >= least), "licence-passed")
    # a window that a longer one of another family explains, pair for pair, says nothing of its own
    outer = passed.where(F.col("kinds").isNotNull()).select(*(F.col(c).alias(f"o_{c}") for c in (*keys, "family", "kinds")))
    outer = outer.withColumn("o_block", F.explode(F.sequence(block("o_start"), block("o_end"))))
    explained = ((F.col("_row") == F.col("o__row")) & (block("start") == F.col("o_block"))
                 & (F.col("o_family") != F.col("family")) & (F.col("o_start") <= F.col("start")) & (F.col("end") <= F.col("o_end"))
                 & (F.size("o_kinds") > F.size("kinds")) & (F.size(F.array_except("kinds", "o_kinds")) == 0))
    passed = _notices(passed.join(outer, explained, "left_anti"))

    notices = passed.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("line", "family", "p", "confirmation"))).alias("notices"))
    rows = found.where(F.col("pos").isNull() | (F.col("pos") == 0)).groupBy("_row", "_id")
    rows = rows.agg(F.sum((F.col("n_words") > 0).cast("long")).alias("n_paragraphs")).join(notices, "_row", "left")
    none = F.array().cast("array<struct<line:int,family:string,p:double,confirmation:double>>")
    rows = rows.withColumn("notices", F.coalesce("notices", none))
    return rows.select(F.col("_id").alias(doc_id), "n_paragraphs", "notices",
                       F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["family"]))).alias("families"))
