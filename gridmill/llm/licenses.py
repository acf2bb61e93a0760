"""Licence scan with built-in functions: TF-IDF cosine to templates, then inheritance by directory."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm.common import saved

# The notices of common licences, as their authors publish them for use in files: one
# text a paragraph, and the short forms.
NOTICES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-2-Clause", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License. Redistribution and use in source and binary forms are permitted."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("CC-BY-3.0", "Licensed under CC BY 3.0."),
    ("CC-BY-3.0", "Licensed under CC BY 3.0, the Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-3.0", "This work is licensed under the Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-3.0", "Licensed under CC BY-SA 3.0."),
    ("CC-BY-SA-3.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/'),
    ("MPL-1.1", 'Software distributed under the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "No part may be reproduced without permission."),
    ("Proprietary", "All rights reserved. No part may be reproduced without permission."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
# Licences named in tags by more than their name.
SUFFIXED = ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0")
SUFFIXES = ("", "-only", "-or-later")
#: Least cosine of a unit of text and a template that makes it a notice of the licence.
LEAST = 0.75
#: Share of a file's words in its notices from which it is its directory's licence file.
FILE_SHARE = 0.1
#: Words from which a notice is a paragraph of a longer one rather than a short form.
PARAGRAPH = 14

#: What a unit that fits several licences equally well is behind one that fits a single one.
SHARED = 0.15

_TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Terms that number a version.
_VERSION = r"^[0-9]{1,2}(\.[0-9]+)*$"
#: Terms, one blank between them, that deny a licence.
_DENIED = "(^| )(not|never|longer)( [^ ]+){0,2} (licensed|released|available|covered|subject|permitted|granted|under)( |$)"


def templates() -> list[tuple[str, str]]:
    """(license, text): every notice, the paragraphs of each licence together, and its SPDX tags."""
    whole = defaultdict(list)
    for name, text in NOTICES:
        if len(text.split()) >= PARAGRAPH:
            whole[name].append(text)
    names = dict.fromkeys(name for name, _ in NOTICES if name != "Proprietary")
    tags = [(name, f"SPDX-License-Identifier: {name}{end}") for name in names for end in (SUFFIXES if name in SUFFIXED else ("",))]
    return [*NOTICES, *((name, "\n".join(texts)) for name, texts in whole.items() if len(texts) > 1), *tags]


def _idf() -> tuple[dict[str, float], float]:
    """Inverse document frequency of each term over the templates, and that of other terms."""
    n = Counter(t for _, text in templates() for t in {*re.findall(_TERM, text.lower())})
    return {t: math.log((1 + len(templates())) / (1 + c)) + 1 for t, c in n.items()}, math.log(1 + len(templates())) + 1


def _weights(spark: SparkSession) -> DataFrame:
    """Unit weights (template, license, term, weight, numbered, versions) of the templates: fixed, whatever
    the input. numbered: whether the term is one of the template's `versions` version numbers."""
    idf, _ = _idf()
    rows = []
    for i, (name, text) in enumerate(templates()):
        own = {*re.findall(_TERM, text.lower())}
        norm = math.sqrt(sum(idf[t] ** 2 for t in own))
        numbers = {t for t in own if re.match(_VERSION, t)}
        rows += [(i, name, t, idf[t] / norm, t in numbers, len(numbers)) for t in sorted(own)]
    return spark.createDataFrame(rows, "template int, license string, term string, weight double, numbered boolean, versions int")


def _possible(terms: Column, least: float) -> Column:
    """False only where the share of terms that any template has proves a cosine under `least`.

    With k of n distinct terms in templates the cosine is at most the length of those k over the
    whole length, and no template term has a larger idf than `top`."""
    idf, other = _idf()
    top, share = max(idf.values()), max(0.0, least - 1e-6) ** 2
    k = F.size(F.filter(terms, lambda t: t.isin([*idf])))
    return (k > 0) & ((1 - share) * top**2 * k >= share * other**2 * (F.size(terms) - k))


def _units(text: Column) -> Column:
    """What is compared of a text, each with its words and distinct terms: every line, every run of lines that
    lines without a term set apart, and the whole text where it has several such runs.

    Comment marks hold no term, so a commented notice has the terms of a plain one."""
    found = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n"), lambda x: F.regexp_extract_all(x, F.lit(_TERM), F.lit(0)))
    lines = F.transform(found, lambda x: F.struct(F.size(x).alias("words"), F.array_distinct(x).alias("terms"), F.array_join(x, " ").alias("said")))
    words = lambda t: F.aggregate(t, F.lit(0), lambda n, x: n + x["words"])
    unit = lambda level, at, n, terms, said: F.struct(F.lit(level).alias("level"), at.cast("int").alias("at"), n.alias("words"), terms.alias("terms"), said.rlike(_DENIED).alias("denied"))
    joined = lambda level, at, t: unit(level, at, words(t), F.array_distinct(F.flatten(F.transform(t, lambda x: x["terms"]))), F.array_join(F.transform(t, lambda x: x["said"]), " "))

    def of(t: Column) -> Column:
        gaps = F.filter(F.transform(t, lambda x, i: F.when(x["words"] == 0, i)), lambda i: i.isNotNull())
        bounds = F.transform(F.array(F.concat(F.array(F.lit(-1)), gaps, F.array(F.size(t)))), lambda g: F.zip_with(F.slice(g, F.lit(1), F.size(g) - 1), F.slice(g, F.lit(2), F.size(g) - 1), lambda a, z: F.struct(a.alias("a"), z.alias("z"))))[0]
        runs = F.filter(bounds, lambda b: b["z"] - b["a"] > 1)

        def with_runs(r: Column) -> Column:
            long_ = F.filter(r, lambda b: b["z"] - b["a"] > 2)
            several = F.filter(F.array(F.size(r)), lambda n: n > 1)
            return F.concat(
                F.filter(F.transform(t, lambda x, i: unit("line", i, x["words"], x["terms"], x["said"])), lambda u: u["words"] > 0),
                F.transform(long_, lambda b: joined("paragraph", b["a"] + 1, F.slice(t, b["a"] + 2, b["z"] - b["a"] - 1))),
                F.transform(several, lambda _: joined("file", F.lit(0), t)),
            )

        return F.transform(F.array(runs), with_runs)[0]

    # arrays of one bind what is used several times, so that it is computed once
    return F.transform(F.array(lines), lambda t: F.struct(words(t).alias("words"), of(t).alias("units")))[0]


def notices(files: DataFrame, least: float = LEAST) -> DataFrame:
    """Licence of each file by its own text: the template with the largest cosine to any unit of it.

    files: path, text. Every line, every paragraph and the whole of every text is compared; a term
    counts once a unit. Terms outside the templates have the largest idf, so prose around a licence's
    name lowers the cosine. A unit is no notice of a template if each has a version number that the
    other lacks, nor if it denies a licence (`not licensed under` and the like). A unit that fits
    several licences equally well stands for the first by name and counts SHARED less than its cosine
    beside other units. Equal ones go to the line before the paragraph and the file, then to the first
    place, then to the last licence by name.
    Returns path, license, similarity, file_words and notice_words (of its notices of that level that
    has the most); files without a notice are not among the rows."""
    spark = files.sparkSession
    weights = _weights(spark)
    idf, other = _idf()
    made = files.where(F.col("path").isNotNull()).select("path", _units(F.col("text")).alias("u"))
    kept = made.select("path", F.col("u.words").alias("file_words"), F.filter("u.units", lambda x: ~x["denied"] & _possible(x["terms"], least)).alias("units"))
    units = kept.select("path", "file_words", F.explode("units").alias("u")).select("path", "file_words", "u.*", F.xxhash64("u.terms").alias("key"))
    # the only scan of the texts: few units come so far
    units = saved(units.dropDuplicates(["path", "level", "at", "key"]), "units")
    unit = ["path", "level", "at", "key"]
    known = spark.createDataFrame([*idf.items()], "term string, idf double")
    terms = units.select(*unit, F.explode("terms").alias("term"))
    norms = terms.join(F.broadcast(known), "term", "left").groupBy(*unit).agg(F.sqrt(F.sum(F.pow(F.coalesce("idf", F.lit(other)), F.lit(2.0)))).alias("norm"), F.count_if(F.col("term").rlike(_VERSION)).alias("own_versions"))
    dots = terms.join(F.broadcast(known), "term").join(F.broadcast(weights), "term").groupBy(*unit, "template", "license", "versions").agg(F.sum(F.col("idf") * F.col("weight")).alias("dot"), F.count_if("numbered").alias("met"))
    same = (F.col("met") == F.col("versions")) | (F.col("met") == F.col("own_versions"))
    scored = dots.join(norms, unit).where(same).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("similarity") >= least)
    # no more licences than there are templates
    best = scored.groupBy(*unit).agg(F.max("similarity").alias("similarity"), F.collect_set(F.struct("similarity", "license")).alias("all"))
    names = F.array_sort(F.transform(F.filter("all", lambda x: x["similarity"] == F.col("similarity")), lambda x: x["license"]))
    best = best.select(*unit, "similarity", names[0].alias("license"), F.when(F.size(names) > 1, F.col("similarity") - SHARED).otherwise(F.col("similarity")).alias("counted"))
    level = F.when(F.col("level") == "line", 0).when(F.col("level") == "paragraph", 1).otherwise(2)
    rows = best.join(units, unit).select("path", "license", "similarity", "level", "words", "file_words", F.struct("counted", -level, -F.col("at"), "license").alias("order"))
    own = rows.groupBy("path").agg(F.max_by("license", "order").alias("license"), F.max_by("similarity", "order").alias("similarity"), F.max("file_words").alias("file_words"))
    found = rows.groupBy("path", "level").agg(F.sum("words").alias("words")).groupBy("path").agg(F.max("words").alias("notice_words"))
    return own.join(found, "path")


def _above(path: Column) -> Column:
    """The directories above a path, deepest last; '' is the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def scan(files: DataFrame, least: float = LEAST, file_share: float = FILE_SHARE) -> DataFrame:
    """Licence of every file: by its own notice, else from the nearest directory above it.

    files: path (parts joined by '/'), text; other columns are ignored. A file whose notices make up
    `file_share` of its words is a licence file of its directory; of several the one with
    the highest similarity counts, then the smallest path. A null path or text has no licence of its
    own and a null path inherits none; rows that repeat a path count as one file per row, with the
    best notice of all; an empty table gives no rows.
    Returns path, license, similarity, origin ('own', 'inherited' or 'none') and found_in (the
    directory that it came from; null unless inherited)."""
    files = files.select("path", "text")
    own = saved(notices(files, least), "notices")
    folder = F.regexp_replace(F.col("path"), r"/?[^/]*$", "")
    chief = own.where(F.col("notice_words") >= file_share * F.col("file_words"))
    folders = chief.select(folder.alias("found_in"), "path", "license", "similarity").groupBy("found_in").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "path", "license")).alias("m"))
    folders = folders.select("found_in", F.col("m.license").alias("license"), (-F.col("m.s")).alias("similarity"))
    # folders are far fewer than files: each looks up the nearest licensed folder once
    places = files.where(F.col("path").isNotNull()).select(folder.alias("folder")).distinct()
    up = places.select("folder", F.posexplode(_above(F.concat(F.col("folder"), F.lit("/")))).alias("depth", "found_in"))
    near = up.join(folders, "found_in").groupBy("folder").agg(F.max_by(F.struct("found_in", "license", "similarity"), F.col("depth")).alias("near"))
    rows = files.select("path", folder.alias("folder")).join(own.select("path", "license", "similarity"), "path", "left").join(near, "folder", "left")
    return rows.select(
        "path", F.coalesce("license", "near.license").alias("license"), F.coalesce("similarity", "near.similarity").alias("similarity"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("license").isNull(), F.col("near.found_in")).alias("found_in"),
    )
