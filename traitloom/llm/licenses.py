"""Licence notices: a paragraph classifier over word n-grams, confirmed against templates.

Column functions and JVM models only. Texts are cut into paragraphs at blank lines and at line
ends behind a sentence. A multinomial logistic regression on hashed one-, two- and three-word
grams names a family. It is trained on shortened and thinned forms of the templates
and, for the class of no licence, on other sentences and on paragraphs of a bounded sample of
documents. Forms kept out of training set the probability below which a paragraph is
``unknown``; a named family also has to share enough two-word grams with one of its templates.
The classifier sees every paragraph with a cue word or one that shares enough two-word grams with any
template, so none that could be named is left out. Words and the grams that occur in a template are
made once per paragraph, as fields of an exploded struct that filters cannot be pushed below.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.llm.common import cut, text_or_empty

WIDTH = 1 << 13
SAMPLE_DOCS = 2000
SAMPLE_PARAGRAPHS = 3000
SIMILAR = 0.5
NONE, UNKNOWN = "none", "unknown"
CUE = r"(?i:licen[cs]|copyright|warrant|redistribut|permission|public domain|spdx|rights reserved|creative commons)"
PARAGRAPH = r"\n[\x20\t\r]*\n\s*|(?<=[.:;!?])[\x20\t\r]*\n"

# Usual notices and opening sentences of public licences, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Distributed under Apache 2.0.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Distributed under BSD 3-Clause.",
        "Released under the BSD 2-Clause terms.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL v3.",
        "Distributed under the GPLv2 or later.",
        "Distributed under the GPLv3.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Released under the LGPL v2.1.",
        "Distributed under the LGPLv3.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Released under the AGPL v3.",
        "Distributed under the AGPLv3.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Distributed under MPL 2.0.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Licensed under CC0 1.0 Universal, dedicated to the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "proprietary": (
        "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "This software is proprietary and confidential.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
    ),
}
# Sentences with the same words that grant or withhold nothing.
OTHERS = (
    "A driving licence has to be shown at the border.",
    "The officer asked for the license plate of the car and for his permission to search it.",
    "The warranty covers parts and labour for two years from the date of purchase.",
    "He asked for permission to leave the room before the lesson was over.",
    "Copyright law differs from country to country, as the lecture explained.",
    "The court issued a warrant for the search of the house in the old town.",
    "The station lost its broadcasting licence after a long dispute with the council.",
    "Fishing licences are sold at the shop by the lake from early May.",
    "The state wants to redistribute the income from the tax to poorer regions.",
    "Poetic licence lets an author bend the rules of grammar.",
    "The land came into the public domain of the city after the flood.",
    "She holds the copyright in both paintings and in the letters.",
    "Pilots must renew their license every five years.",
    "The creative commons room of the library is open to all students.",
    "No permission was needed to enter the park at night.",
)


WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)?")


def words_of(text: Column) -> Column:
    """Lower-case words, numbers with their points, of a paragraph."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD.pattern), F.lit(0))


def grams_of(words: Column, n: int) -> Column:
    """Runs of ``n`` words, joined by blanks; none if there are fewer."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def _features(words: Column) -> Column:
    return F.concat(words, grams_of(words, 2), grams_of(words, 3))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, paragraph (from 0), cue, words and hits (distinct two-word grams of any template) of the non-empty paragraphs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    known = sorted({g for t in _template_grams() for g in t["grams"]})
    firsts, seconds = (sorted({g.split(" ")[i] for g in known}) for i in (0, 1))
    parts = F.transform(F.split("text", PARAGRAPH), lambda p: F.struct(p.rlike(CUE).alias("cue"), words_of(p).alias("words"), (F.trim(p) != "").alias("some")))

    def seen(e: Column) -> Column:
        # A gram is put together only where both words occur in their places in templates.
        words = e["words"]
        starts = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(starts, lambda i: F.get(words, i - 1).isin(firsts) & F.get(words, i).isin(seconds))
        hits = F.transform(starts, lambda i: F.concat(F.get(words, i - 1), F.lit(" "), F.get(words, i)))
        hits = F.array_distinct(F.filter(hits, lambda g: g.isin(known)))
        return F.struct(e["cue"].alias("cue"), e["words"].alias("words"), hits.alias("hits"), e["some"].alias("some"))

    rows = rows.select("doc_id", F.posexplode(F.transform(parts, seen)).alias("paragraph", "e")).where("e.some")
    return rows.select("doc_id", "paragraph", "e.cue", "e.words", "e.hits")


def _forms(spark: SparkSession) -> DataFrame:
    """Training words: each template and other sentence whole, shortened and thinned."""
    entries = [(family, text) for family, texts in TEMPLATES.items() for text in texts] + [(NONE, text) for text in OTHERS]
    rows = spark.range(1).select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("text")) for f, t in entries])).alias("e")
    )
    rows = rows.select("e.family", words_of(F.col("e.text")).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("form"))
    n, form = F.size("w"), F.col("form")
    thin = F.filter("w", lambda x, i: F.pmod(i, F.lit(5)) != form)
    third = F.filter("w", lambda x, i: F.pmod(i, F.lit(3)) != form - 8)
    words = (
        F.when(form < 5, thin).when(form == 5, F.col("w")).when(form == 6, F.slice("w", 1, F.greatest(F.lit(1), F.ceil(n * 0.6).cast("int"))))
        .when(form == 7, F.slice("w", F.floor(n * 0.4).cast("int") + 1, n)).when(form < 11, third)
        .otherwise(F.concat(F.col("w"), F.split(F.lit("as it is stated in the file of this part"), " ")))
    )
    return rows.select("family", "form", words.alias("words"))


def _template_grams() -> list[dict]:
    rows = []
    for name, texts in TEMPLATES.items():
        for text in texts:
            words = WORD.findall(text.lower())
            rows.append({"family": name, "grams": sorted({f"{a} {b}" for a, b in zip(words, words[1:])})})
    return rows


def candidates(rows: DataFrame) -> DataFrame:
    """The paragraphs with a cue word or as much in common with some template as a named family needs.

    Half of the grams of the shortest template, or of a shorter paragraph, have to be hits for that; the exact
    share is asked of these only.
    """
    least = min(len(t["grams"]) for t in _template_grams())
    enough = F.size("hits") >= SIMILAR * F.least(F.size(F.array_distinct(grams_of(F.col("words"), 2))), F.lit(least))
    near = (F.size("hits") > 0) & enough & (_similarity(F.col("words"), F.col("hits")) >= SIMILAR)
    return rows.where(F.col("cue") | near)


@dataclass
class Model:
    regression: LogisticRegressionModel
    families: list[str]
    bar: float


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Regression and the bar of the unknown class.

    Trained on the forms of the templates and about ``SAMPLE_PARAGRAPHS`` paragraphs from about ``SAMPLE_DOCS``
    documents, chosen by hashes of id and place, that have no cue and agree with no template. The bar is the larger of one half and
    the 99th percentile of the best family's probability over held-back forms of no licence.
    """
    spark = docs.sparkSession
    families = [NONE, *TEMPLATES]
    total = max(1, docs.count())

    def chance(*keys) -> Column:
        return F.pmod(F.xxhash64(F.lit("licence"), *keys), F.lit(1 << 20)) / F.lit(float(1 << 20))

    some = docs.where(chance(F.col(id_col)) < min(1.0, SAMPLE_DOCS / total))
    plain = paragraphs(some, id_col, text_col).where(~F.col("cue"))
    plain = cut(plain.where(_similarity(F.col("words"), F.col("hits")) < SIMILAR).select("doc_id", "paragraph", "words"))
    held = max(1, plain.count())
    plain = plain.where(chance("doc_id", "paragraph", F.lit(1)) < min(1.0, SAMPLE_PARAGRAPHS / held))
    plain = plain.select(F.lit(NONE).alias("family"), F.pmod(F.xxhash64("doc_id", "paragraph"), F.lit(12)).cast("int").alias("form"), "words")
    rows = _forms(spark).unionByName(plain).where(F.size("words") > 0)
    number = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    rows = cut(rows.select(number.cast("double").alias("label"), "form", _features(F.col("words")).alias("grams")).coalesce(4))
    tf = HashingTF(numFeatures=WIDTH, binary=True, inputCol="grams", outputCol="features")
    kept_back = F.col("form").isin(4, 9)
    regression = LogisticRegression(family="multinomial", regParam=0.002, maxIter=40, probabilityCol="p").fit(
        tf.transform(rows.where(~kept_back))
    )
    seen = regression.transform(tf.transform(rows.where(kept_back & (F.col("label") == 0))))
    best = F.array_max(F.slice(vector_to_array("p"), 2, len(families) - 1))
    bar = seen.agg(F.percentile(best, F.lit(0.99)).alias("bar")).first()["bar"]
    return Model(regression, families, max(0.5, float(bar or 0.0)))


def _similarity(words: Column, hits: Column, family: Column | None = None) -> Column:
    """Largest share of two-word grams that the paragraph and a template (of the family, if given) have in
    common, against the one with fewer grams."""
    known = F.from_json(F.lit(json.dumps(_template_grams())), "array<struct<family: string, grams: array<string>>>")
    known = known if family is None else F.filter(known, lambda t: t["family"] == family)

    def share(own: Column):
        return lambda t: F.size(F.array_intersect(hits, t["grams"])) / F.greatest(F.least(own, F.size(t["grams"])), F.lit(1))

    # The one element binds the number of grams, so they are counted once.
    own = F.array(F.size(F.array_distinct(grams_of(words, 2))))
    return F.get(F.transform(own, lambda o: F.greatest(F.lit(0.0), F.array_max(F.transform(known, share(o))))), F.lit(0))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph with a cue word or a named family: doc_id, paragraph, family, probability, similarity.

    ``family`` is ``unknown`` where the probability misses the bar or no template agrees, and
    ``none`` where the class of no licence is likeliest; paragraphs of these two have a row only with a
    cue word. Null and empty texts have none. Repeated rows are scanned as often as they come.
    """
    rows = candidates(paragraphs(docs, id_col, text_col))
    rows = rows.withColumn("grams", _features(F.col("words")))
    tf = HashingTF(numFeatures=WIDTH, binary=True, inputCol="grams", outputCol="features")
    seen = model.regression.transform(tf.transform(rows)).withColumn("p", vector_to_array("p"))
    names = F.array(*[F.lit(f) for f in model.families])
    # Fields of an exploded struct again: a filter on them pushed below would score every paragraph.
    best = F.struct(F.get(names, F.col("prediction").cast("int")).alias("named"), F.array_max("p").alias("probability"))
    seen = seen.select("doc_id", "paragraph", "cue", "words", "hits", F.explode(F.array(best)).alias("e"))
    seen = seen.select("doc_id", "paragraph", "cue", "words", "hits", "e.named", "e.probability")
    seen = seen.withColumn("similarity", _similarity(F.col("words"), F.col("hits"), F.col("named")))
    sure = (F.col("probability") >= model.bar) & (F.col("similarity") >= SIMILAR)
    family = F.when(F.col("named") == NONE, F.lit(NONE)).when(sure, F.col("named")).otherwise(F.lit(UNKNOWN))
    seen = seen.where(F.col("cue") | ((F.col("named") != NONE) & sure))
    return seen.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), family.alias("family"), "probability", "similarity")


def learn_and_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return scan(docs, fit(docs, id_col, text_col), id_col, text_col)
