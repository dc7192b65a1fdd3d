"""Licence scans: a trained paragraph classifier over sparse word n-grams. DataFrame functions only.

A multinomial logistic regression over the presence of word n-grams (1 to 3 words) is trained
on variations of licence notices and, for the class ``unknown``, on scrambled notices and
near misses, so that single words never decide. A family is predicted only above a probability
calibrated on held-out unknowns. The prediction is confirmed by comparing the paragraph with
the family's templates: the share of a template's word trigrams that the paragraph holds.

The model is a bounded table (n-gram, weights of the classes). Words that no n-gram of the model and
no template holds are masked (null) as soon as a text is split, and n-grams are built only where no
word is masked, which leaves out none that the model knows. Paragraphs without any weighted n-gram
are unknown by construction and give no row.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumspark.session import materialise, shared_dir

#: Notices by family: public, customary wording of licence references and opening paragraphs.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license, see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction.",
        "MIT License", "MIT licence", "under MIT", "License: MIT", "SPDX-License-Identifier: MIT", "https://opensource.org/licenses/MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the software.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind.",
        "Apache License", "Apache License 2.0", "Apache 2.0 license", "under Apache 2.0", "SPDX-License-Identifier: Apache-2.0", "http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Distributed under the GNU General Public License v2 or later.",
        "GNU General Public License", "GNU GPL", "GPL license", "under GPLv3", "under GPLv2", "under the GPL", "GPL-3.0", "GPL-2.0", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "https://www.gnu.org/licenses/gpl-3.0.html", "You should have received a copy of the GNU General Public License along with this program.",
        "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute this library and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "GNU Lesser General Public License", "GNU LGPL", "under LGPLv3", "under the LGPL", "LGPL-2.1", "LGPL-3.0", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "GNU Affero General Public License", "GNU AGPL", "under AGPLv3", "under the AGPL", "AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "BSD License", "BSD 2-Clause", "BSD 3-Clause", "BSD style license", "under BSD", "SPDX-License-Identifier: BSD-2-Clause", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.",
    ],
    "mpl": [
        "This source code form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Mozilla Public License", "MPL 2.0", "under the MPL", "SPDX-License-Identifier: MPL-2.0", "https://mozilla.org/MPL/2.0/",
    ],
    "epl": [
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at the Eclipse Foundation.",
        "Eclipse Public License", "EPL 2.0", "under the EPL", "SPDX-License-Identifier: EPL-2.0",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "ISC License", "under ISC", "SPDX-License-Identifier: ISC",
    ],
    "zlib": [
        "Distributed under the zlib license.",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
        "zlib License", "under zlib", "SPDX-License-Identifier: Zlib",
    ],
    "unlicense": [
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "The Unlicense", "SPDX-License-Identifier: Unlicense", "https://unlicense.org",
    ],
    "artistic": [
        "Licensed under the Artistic License 2.0.",
        "This package is free software; you may redistribute it under the terms of the Artistic License.",
        "Artistic License", "SPDX-License-Identifier: Artistic-2.0",
    ],
    "ofl": [
        "Licensed under the SIL Open Font License, Version 1.1.",
        "This font software is licensed under the SIL Open Font License and may be bundled, redistributed and sold with any software.",
        "SIL Open Font License", "OFL 1.1", "under the OFL", "SPDX-License-Identifier: OFL-1.1",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the software.",
        "Boost Software License", "BSL 1.0", "SPDX-License-Identifier: BSL-1.0",
    ],
    "eupl": [
        "Licensed under the EUPL, Version 1.2 or later.",
        "Licensed under the European Union Public Licence; you may not use this work except in compliance with the Licence.",
        "European Union Public Licence", "EUPL 1.2", "under the EUPL", "SPDX-License-Identifier: EUPL-1.2",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Content is available under the Creative Commons Attribution-ShareAlike License.",
        "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal.",
        "Creative Commons", "CC BY 4.0", "CC BY-SA", "CC BY-NC", "CC Attribution", "under CC0", "CC0 1.0", "SPDX-License-Identifier: CC0-1.0", "SPDX-License-Identifier: CC-BY-4.0", "https://creativecommons.org/licenses/by/4.0/",
    ],
    "reserved": [
        "Copyright 2020 by the authors. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
}
#: Sentences with the same words that license nothing: examples of the class ``unknown``.
NEAR_MISSES = [
    "The general public was free to enter the software fair with a license to serve wine.",
    "Her driving license was released to the public under version 2 of the form.",
    "The apache helicopter landed in the work area without permission.",
    "He attributed the work to common creative forces and reserved a table.",
    "All rights of way are subject to the terms of the contract with the library.",
    "The foundation may publish a later version of the notice.",
    "Source code and binary files are found in the file named license.",
    "We are licensed to sell insurance in all states.",
    "Released under the bridge, the boats were distributed under the trees.",
    "Er kam mit der Lizenz und mit dem Boot unter der Brücke hindurch.",
    "The terms of the contract are available under the table of contents.",
    "Identifier of the file: see the list of conditions in the notice.",
    "The eclipse was visible to the public in the whole union.",
    "An artistic font was used in the boost of the open campaign.",
]
#: Sentences that refer to a licence by name; training puts every short template into each of them.
FRAMES = [
    "{}", "Licensed under the {}.", "Released under {}", "Code released under the terms of the {}", "This program is licensed under the {}.", "Distributed under the terms of {}, see the file COPYING.",
    "See the {} for details.", "This project is available under the {} and its authors.", "You may use it under {} only.", "Copyright by the authors, {}", "The {} applies to all files.",
]
#: The last of these frames are held out to measure recall.
HELD_FRAMES = ["Everything here is published under the {} by its authors.", "Released to everyone, {}."]
UNKNOWN = "unknown"
_STOP = "a an and any are as at be by can for from in is it may no not of on or that the this to under was were with you we he her".split()


def tokens(paragraph: Column) -> Column:
    """Words of a paragraph: letters and digits in small letters, points inside numbers kept."""
    return F.regexp_extract_all(F.lower(paragraph), F.lit(r"[\p{L}\p{N}]+(?:\.[0-9]+)*"), 0)


def _starts(words: Column, n: int) -> Column:
    """The 1-based places of an array of words at which n words stand of which none is null."""
    last = F.size(words) - (n - 1)
    at = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: reduce(and_, [F.get(words, i + (k - 1)).isNotNull() for k in range(n)]))


def n_grams(words: Column, n: int) -> Column:
    """The n-grams of an array of words, joined by spaces; none over a null word, or if there are fewer words."""
    return F.transform(_starts(words, n), lambda i: F.array_join(F.slice(words, i, n), " "))


def _grams(words: Column) -> Column:
    """Distinct 1- to 3-grams."""
    return F.array_distinct(F.concat(n_grams(words, 1), n_grams(words, 2), n_grams(words, 3)))


def _content(gram: Column) -> Column:
    """Whether an n-gram holds a content word."""
    return F.size(F.array_except(F.split(gram, " "), F.array(*[F.lit(w) for w in _STOP]))) > 0


def _features(words: Column) -> Column:
    """Distinct 1- to 3-grams that hold a content word."""
    return F.filter(_grams(words), _content)


def _words(text: str) -> list[str]:
    """The words of a template, as :func:`tokens` gives them."""
    return re.findall(r"[^\W_]+(?:\.[0-9]+)*", text.lower())


def _short(text: str) -> str | None:
    """The words of a template of at most five words; None for a longer one."""
    words = _words(text)
    return " ".join(words) if len(words) <= 5 else None


def _examples(spark: SparkSession, templates: dict[str, list[str]], near: Sequence[str]) -> DataFrame:
    """[family, words, held]: the notices, their parts and variants, names in sentences, and scrambled notices as unknowns."""
    rows = [{"family": f, "text": t, "kind": None} for f, own in templates.items() for t in own] + [{"family": UNKNOWN, "text": t, "kind": None} for t in near]
    names = [(f, t) for f, own in templates.items() for t in own if _short(t) and not re.match(r"(?i)under |spdx|https?:|license:", t)]
    rows += [{"family": f, "text": frame.format(t), "kind": 40 + k} for f, t in names for k, frame in enumerate(FRAMES[1:])]
    rows += [{"family": f, "text": frame.format(t), "kind": 60 + k} for f, t in names for k, frame in enumerate(HELD_FRAMES)]
    # sentences without a name, and with the name of something else
    rows += [{"family": UNKNOWN, "text": frame.format(x), "kind": 40} for frame in FRAMES for x in ("", "committee", "new rules", "old bridge 2.0")]
    given = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<family:string,text:string,kind:int>>")))
    given = given.select("family", "kind", tokens(F.col("text")).alias("w"))
    framed, base = given.where("kind IS NOT NULL").select("family", "kind", F.col("w").alias("words")), given.where("kind IS NULL").drop("kind")
    n = F.size("w")
    tail = F.greatest(F.floor(n * 0.4), F.lit(1)).cast("int")
    cut = n >= 8  # parts of a shorter notice may be those of any
    parts = F.array(
        F.col("w"),
        F.when(cut, F.slice("w", F.lit(1), F.greatest(F.ceil(n * 0.75), F.lit(1)).cast("int"))).otherwise(F.col("w")),
        F.when(cut, F.slice("w", tail, n)).otherwise(F.col("w")),
        F.concat(F.array(*[F.lit(x) for x in "see also the notes below".split()]), F.col("w")),
        F.concat(F.col("w"), F.array(*[F.lit(x) for x in "and more at the end of the page".split()])),
    )
    whole = base.select("family", F.posexplode(parts).alias("kind", "words"))

    def scrambled(seed: int) -> Column:
        keyed = F.transform("w", lambda x: F.struct(F.xxhash64(x, F.lit(seed)).alias("k"), x.alias("x")))
        return F.transform(F.array_sort(keyed), lambda s: s["x"])

    # a scrambled notice in which the words of a name still stand together is no unknown
    kept = sorted({w for own in templates.values() for t in own if (w := _short(t))})
    mixed = base.select(F.lit(UNKNOWN).alias("family"), F.posexplode(F.array(*[scrambled(s) for s in range(1, 17)])).alias("kind", "words"))
    line = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    mixed = mixed.where(~F.exists(F.array(*[F.lit(f" {x} ") for x in kept]), lambda x: F.contains(line, x)))
    # notices with every fourth to seventh word left out, or with a word put in; one of each sort is held out to measure recall
    thinned = [F.expr(f"filter(w, (x, i) -> i % {step} <> {k})") for step, k in [(5, 0), (5, 1), (5, 3), (5, 4), (5, 2), (4, 0), (4, 1), (4, 2), (4, 3), (6, 1), (6, 4), (7, 2), (7, 5)]]
    filled = [F.expr(f"flatten(transform(w, (x, i) -> if(i % {step} = {k}, array(x, 'hereby'), array(x))))") for step, k in [(6, 5), (6, 1), (6, 3), (4, 0), (4, 2), (5, 1), (5, 4)]]
    variants = base.where((F.col("family") != UNKNOWN) & (n >= 6)).select("family", F.posexplode(F.array(*thinned, *filled)).alias("kind", "words")).withColumn("kind", F.col("kind") + 20)
    single = base.select(F.lit(UNKNOWN).alias("family"), F.lit(19).alias("kind"), F.explode(F.transform(n_grams(F.col("w"), 1), lambda x: F.array(x))).alias("words"))
    # the scrambles of the last four seeds are held out to calibrate the class unknown
    every = whole.unionByName(mixed).unionByName(single).unionByName(variants).unionByName(framed)
    return every.withColumn("held", ((F.col("family") == UNKNOWN) & F.col("kind").isin(12, 13, 14, 15)) | ((F.col("family") != UNKNOWN) & F.col("kind").isin(24, 33, 60, 61)))


def train(spark: SparkSession, templates: dict[str, list[str]] | None = None, near: Sequence[str] | None = None) -> dict:
    """{classes, intercepts, weights {n-gram: [..]}, least, templates, recall}, learnt from all n-grams that two examples hold.

    ``recall`` is the share of held-out variants of the notices, and of names in held-out sentences,
    that get their family.
    """
    templates, near = templates or TEMPLATES, near or NEAR_MISSES
    examples = _examples(spark, templates, near).select("family", "held", _features(F.col("words")).alias("grams")).coalesce(1).cache()
    classes = sorted(templates) + [UNKNOWN]
    # the vocabulary is bounded by the templates alone
    counted = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=2**31 - 1, minDF=2).fit(examples)
    label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")) - 1
    table = counted.transform(examples).withColumn("label", label.cast("double"))
    model = LogisticRegression(family="multinomial", maxIter=60, regParam=0.001, elasticNetParam=0.3).fit(table.where("NOT held"))
    matrix, vocabulary = model.coefficientMatrix.toArray(), counted.vocabulary
    weights = {g: [round(float(x), 6) for x in matrix[:, i]] for i, g in enumerate(vocabulary) if abs(matrix[:, i]).max() > 1e-6}
    # calibration: a family needs more than nearly all held-out unknowns reach, and an even chance at least
    best = F.expr(f"array_max(slice(p, 1, {len(classes) - 1}))")
    held = model.transform(table.where("held")).select("family", vector_to_array("probability").alias("p"), "prediction")
    reached = held.where(F.col("family") == UNKNOWN).agg(F.percentile(best, 0.99)).first()[0]
    least = max(0.5, min(0.95, float(reached or 0.0)))
    right = (F.element_at(F.array(*[F.lit(c) for c in classes]), (F.col("prediction") + 1).cast("int")) == F.col("family")) & (best > least)
    recall = held.where(F.col("family") != UNKNOWN).agg(F.avg(right.cast("int"))).first()[0]
    examples.unpersist()
    return {
        "classes": classes,
        "intercepts": [float(x) for x in model.interceptVector.toArray()],
        "weights": weights,
        "least": least,
        "recall": recall,
        "templates": [(c, t) for c in sorted(templates) for t in templates[c]],
    }


def trained(spark: SparkSession) -> dict:
    """The model of the built-in notices: trained once and kept in the shared folder, under a name made from what it was trained on."""
    given = json.dumps([TEMPLATES, NEAR_MISSES, FRAMES, HELD_FRAMES, _STOP, spark.version], sort_keys=True)
    path = f"{shared_dir(spark)}/licence-model-{hashlib.sha256(given.encode()).hexdigest()[:16]}"
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(name):
        found = json.dumps(train(spark), sort_keys=True)
        spark.range(1).select(F.lit(found).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of the model; bounded by its n-grams or templates."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _scored(grams: DataFrame, keys: Sequence[str], model: dict, trigrams: DataFrame) -> DataFrame:
    """[*keys, family, probability, cover] of units from their features [*keys, g], which are read once.

    Units without a weighted feature are left out. ``cover`` is the largest share of a template of
    the family whose trigrams the unit holds.
    """
    classes, k = model["classes"], len(model["classes"])
    weights = _table(grams.sparkSession, [{"g": g, "w": w} for g, w in sorted(model["weights"].items())], "g:string,w:array<double>")
    parts = trigrams.where(_content(F.col("g"))).groupBy("g").agg(F.collect_list(F.struct("family", "t", "m")).alias("parts"))
    # bounded by the templates: the n-grams of the model's examples, and the templates' trigrams
    hits = grams.join(F.broadcast(weights.join(parts, "g", "full_outer")), "g")
    scored = hits.groupBy(*keys).agg(*[F.sum(F.col("w")[i]).alias(f"_s{i}") for i in range(k)], F.flatten(F.collect_list("parts")).alias("_parts"))
    scored = scored.where("_s0 IS NOT NULL")
    z = [F.col(f"_s{i}") + F.lit(b) for i, b in enumerate(model["intercepts"])]
    top = F.greatest(*z)
    total = sum((F.exp(x - top) for x in z[1:]), F.exp(z[0] - top))
    best = F.greatest(*z[:-1])
    family = F.coalesce(*[F.when(x == best, F.lit(c)) for c, x in zip(classes[:-1], z[:-1], strict=True)])
    scored = scored.select(*keys, "_parts", family.alias("_family"), (F.exp(best - top) / total).alias("_chance"))
    known = F.col("_chance") > F.lit(model["least"])
    scored = scored.select(*keys, "_parts", F.when(known, F.col("_family")).otherwise(F.lit(UNKNOWN)).alias("family"), F.when(known, F.col("_chance")).otherwise(1 - F.col("_chance")).alias("probability"))
    scored = scored.withColumn("_parts", F.expr("filter(_parts, p -> p.family = family)"))
    cover = F.expr("coalesce(array_max(transform(_parts, x -> size(filter(_parts, y -> y.t = x.t)) / x.m)), 0D)")
    return scored.select(*keys, "family", "probability", cover.alias("cover"))


def _wrapped(parts: DataFrame, trigrams: DataFrame, model: dict, min_cover: float) -> DataFrame:
    """[doc_id, _row, paragraph, family, probability, cover] of notices that run over several lines, each once, at its first line.

    The template's trigrams that begin in a line, also those that end in the next one, are read in
    order; a notice ends at a line without words, where the template begins anew, or after as
    many lines as the template has trigrams. Its lines are then classified together. ``_last``
    is its last line.
    """
    begin = parts.withColumn("_all", F.concat("_words", "_next"))
    placed = F.transform(_starts(F.col("_all"), 3), lambda i: F.struct((i - 1).alias("_k"), F.array_join(F.slice("_all", i, 3), " ").alias("g")))
    begin = begin.select("doc_id", "_row", "paragraph", F.size("_words").alias("_n"), F.inline(placed))
    hits = begin.join(F.broadcast(trigrams), "g").withColumn("_last", F.col("paragraph") + F.when(F.col("_k") + 2 >= F.col("_n"), 1).otherwise(0))
    hits = materialise(hits.select("doc_id", "_row", "paragraph", "_k", "_last", "family", "t", "m", "o"), "licence-hits")
    empty = parts.where(F.size("_words") == 0).select("_row", "paragraph").join(hits.select("_row").distinct().hint("merge"), "_row", "left_semi")
    both = hits.withColumn("_gap", F.lit(0)).unionByName(empty.withColumn("_gap", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("_part", F.sum("_gap").over(Window.partitionBy("_row").orderBy("paragraph"))).where("_gap = 0")
    order = Window.partitionBy("_row", "_part", "t").orderBy("paragraph", "_k")
    fresh = (F.col("o") <= F.lag("o").over(order)) | (F.col("paragraph") - F.lag("paragraph").over(order) > F.col("m"))
    both = both.withColumn("_fresh", F.coalesce(fresh, F.lit(True)).cast("int"))
    both = both.withColumn("_notice", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = both.groupBy("_row", "_part", "t", "_notice").agg(
        F.first("doc_id").alias("doc_id"), F.first("family").alias("_family"), F.min("paragraph").alias("paragraph"), F.max("_last").alias("_last"), (F.count("*") / F.first("m")).alias("cover"),
    )
    found = materialise(found.where((F.col("cover") >= min_cover) & (F.col("_last") > F.col("paragraph"))).drop("_part", "_notice"), "licence-notices")
    keys = ["_row", "t", "paragraph"]
    text = found.select(*keys, F.explode(F.sequence("paragraph", "_last")).alias("_line")).join(parts.select("_row", F.col("paragraph").alias("_line"), "_words").hint("merge"), ["_row", "_line"])
    text = text.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_line", "_words"))), lambda x: x["_words"])).alias("_words"))
    scored = _scored(text.select(*keys, F.explode(_grams(F.col("_words"))).alias("g")), keys, model, trigrams).drop("cover")
    found = found.join(scored.hint("merge"), keys).where("family = _family").drop("_family")
    found = materialise(found, "licence-wrapped")
    # of overlapping notices of a family the best covered one stays, then the first
    other = found.select(*[F.col(c).alias(f"{c}2") for c in ("_row", "family", "paragraph", "_last", "cover", "t")])
    better = F.expr("_row = _row2 AND family = family2 AND paragraph2 <= _last AND _last2 >= paragraph AND (cover2 > cover OR (cover2 = cover AND (paragraph2 < paragraph OR (paragraph2 = paragraph AND t2 < t))))")
    found = found.join(other.hint("merge"), better, "left_anti")
    best = Window.partitionBy("_row", "paragraph").orderBy(F.desc("cover"), "t")
    return found.withColumn("_b", F.row_number().over(best)).where("_b = 1").select("doc_id", "_row", "paragraph", "_last", "family", "probability", "cover")


def scan(docs: DataFrame, model: dict, separator: str = "\n", min_cover: float = 0.6) -> DataFrame:
    """[doc_id, paragraph, family, probability, cover, confirmed] of every paragraph with a weighted n-gram.

    ``paragraph`` is the 0-based number of the ``separator``-delimited part of the text;
    ``family`` may be ``unknown``; ``cover`` is the best share of a template of the family, and
    ``confirmed`` tells whether it reaches ``min_cover``. A notice wrapped over several parts is
    confirmed once, at the part where it begins.

    Defined cases: null and empty texts, and paragraphs without features, give no row; a null
    doc_id stays null; repeated rows give repeated findings; ties between classes go to the
    first class by name; texts of any length are scanned whole; an empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    if not model["weights"]:
        return docs.select("doc_id", F.lit(0).alias("paragraph"), F.lit(UNKNOWN).alias("family"), F.lit(0.0).alias("probability"), F.lit(0.0).alias("cover"), F.lit(False).alias("confirmed")).limit(0)
    known = {w for g in model["weights"] for w in g.split(" ")}
    vocabulary = sorted(known | {w for _, t in model["templates"] for w in _words(t)})

    def masked(words: Column) -> Column:
        return F.transform(words, lambda w: F.when(w.isin(vocabulary), w))

    parts = docs.where("text IS NOT NULL").select("doc_id", F.monotonically_increasing_id().alias("_row"), F.transform(F.split("text", separator), lambda x: masked(tokens(x))).alias("_lines"))
    # every line with the first two words after it, up to a line without words
    parts = parts.select("doc_id", "_row", F.posexplode(F.expr("arrays_zip(_lines, slice(_lines, 2, size(_lines)), slice(_lines, 3, size(_lines)))")).alias("paragraph", "_z"))
    none = F.array().cast("array<string>")
    one, two = F.coalesce(F.col("_z")["1"], none), F.coalesce(F.col("_z")["2"], none)
    parts = parts.select("doc_id", "_row", "paragraph", F.col("_z")["_lines"].alias("_words"), F.slice(F.concat(one, F.when(F.size(one) == 1, two).otherwise(none)), 1, 2).alias("_next"))
    # every feature holds a content word; a wrapped notice may have lines without any, so these stay if the next words are known
    content = sorted(known - set(_STOP))
    parts = parts.where((F.size("_words") == 0) | F.exists(F.concat("_words", "_next"), lambda w: w.isNotNull() & w.isin(content)))
    parts = materialise(parts.withColumn("_next", F.when(F.size("_words") > 0, F.col("_next")).otherwise(none)), "licence-paragraphs")  # fixes the row numbers, and the texts are read once

    listed = [{"family": f, "t": i, "text": t} for i, (f, t) in enumerate(model["templates"])]
    templates = _table(spark, listed, "family:string,t:int,text:string")
    # a template of one or two words is one gram
    words = tokens(F.col("text"))
    trigrams = templates.select("family", "t", F.array_distinct(F.when(F.size(words) < 3, F.array(F.array_join(words, " "))).otherwise(n_grams(words, 3))).alias("all")).where(F.size("all") > 0)
    trigrams = trigrams.select("family", "t", F.size("all").alias("m"), F.posexplode("all").alias("o", "g"))

    keys = ["doc_id", "_row", "paragraph"]
    scored = _scored(parts.select(*keys, F.explode(_grams(F.col("_words"))).alias("g")), keys, model, trigrams)
    lines = materialise(scored.withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("cover") >= min_cover)), "licence-lines")
    wrapped = materialise(_wrapped(parts, trigrams, model, min_cover).withColumn("confirmed", F.lit(True)), "licence-found")
    # the notice stands for its first line, and for its other lines that are confirmed by themselves (a name, a clause)
    heads = wrapped.select(F.col("_row").alias("_r"), F.col("family").alias("_f"), F.col("paragraph").alias("_p"), F.col("_last").alias("_l"))
    same = (F.col("_row") == F.col("_r")) & ((F.col("paragraph") == F.col("_p")) & (~F.col("confirmed") | (F.col("family") == F.col("_f"))))
    same = same | ((F.col("_row") == F.col("_r")) & F.col("confirmed") & (F.col("family") == F.col("_f")) & F.col("paragraph").between(F.col("_p"), F.col("_l")))
    kept = lines.join(heads.hint("shuffle_hash"), (F.col("_row") == F.col("_r")) & same, "left_anti")
    return kept.unionByName(wrapped.drop("_last")).drop("_row")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence findings in every document, one row a paragraph."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, trained(spark))
