"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance.

All in DataFrame functions.  Words are lower-case runs of ASCII letters and digits.  Each template is a notice, a
file header or a whole licence text.  Of every whole text, each run of 1 to ``WINDOW`` adjacent lines that are not blank,
each longer block of adjacent lines in which at least ``BLOCK`` of the words are template words, however many they are, and
the text as a whole, is compared if at least ``SHARE`` of its words are template words.  Runs are looked for by the template words
that at most ``RARE`` of all documents have; where the other words of a template could reach ``COSINE`` without them, the
rarest of those are looked for too, so no run that reaches it is left out, however common its licence is.  Words weigh their count times their inverse document frequency over all
documents; a word of no template weighs as one that 1 in 100 documents has.  A document's own licence is the
template of greatest cosine, ``COSINE`` at least, ties by name; a line ``SPDX-License-Identifier: X`` says X.

A document all of whose lines belong to licence runs, or whose name is that of a licence file, speaks for its
directory; documents without a licence of their own take that of the nearest ancestor directory, found by a join on the
exploded ancestors of their path.

Nothing but the runs compared is written or moved, never a text.  Null and empty texts have no licence of their own; a
null path is the root; several licence files in one directory give the least name; repeated rows are kept; a
very long text is read line by line (a line is not split); a null doc_id stays null; empty tables give empty results; extra columns are
ignored.
"""

from __future__ import annotations

import re
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_text, drop_saved, save

# Public notices, file headers and short licence texts.
TEMPLATES = {
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Licensed under the BSD 2-Clause License",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "Licensed under the BSD 3-Clause License",
    ],
    "CC-BY-4.0": ["This work is licensed under the Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "CC-BY-NC-4.0": ["This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "CC-BY-SA-4.0": ["This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Released under CC0 1.0 Universal"],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "Licensed under the GNU GPL v3",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License"],
    "LGPL-3.0": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GNU Lesser General Public License, version 3"],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Mozilla Public License Version 2.0",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
}
SPDX = r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]*[A-Za-z0-9+])"
FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"
COSINE, SHARE, RARE, WINDOW, BLOCK = 0.7, 0.5, 0.05, 4, 0.8


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


VOCABULARY = sorted({w for texts in TEMPLATES.values() for t in texts for w in words(t)})


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _literal(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def frequencies(documents: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those with each word of the templates."""
    found = documents.select(F.explode(F.array_intersect(_words(clean_text()), _literal(VOCABULARY))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return documents.count(), {r.word: r.n for r in found.collect()}  # a row a word of the templates


def search_words(n_docs: int, df: dict[str, int], idf: dict[str, float]) -> list[str]:
    """Words one of which every run of a template's cosine has: the words that are left out hold too little of a
    template's norm, since a run's cosine is at most the norm of the template's part that it shares."""
    found = {w for w in VOCABULARY if df.get(w, 0) <= RARE * n_docs}
    for texts in TEMPLATES.values():
        for text in texts:
            own = words(text)
            power = {w: (own.count(w) * idf[w]) ** 2 for w in sorted(set(own))}
            rest = sum(x for w, x in power.items() if w not in found)
            for w in sorted(power.keys() - found, key=lambda w: (df.get(w, 0), w)):
                if rest < (COSINE - 1e-6) ** 2 * sum(power.values()):
                    break
                found.add(w)
                rest -= power[w]
    return sorted(found)


def _runs(rows: DataFrame, rare: list[str]) -> DataFrame:
    """rows(row, text) -> row, all_lines, start, n (lines), content (its words), spdx."""
    keys, known = _literal(rare), _literal(VOCABULARY)
    able = rows.where(F.contains(clean_text(), F.lit("SPDX-License-Identifier:")) | F.arrays_overlap(_words(clean_text()), keys))
    # An expression that a lambda uses is evaluated at each of its calls; explode binds it to a column first.
    bind = lambda df, name, value: df.select(*df.columns, F.explode(F.array(value)).alias(name))
    bags = bind(able, "lines", F.filter(F.split(clean_text(), "\n"), lambda x: F.trim(x) != "")).select("row", "lines", F.size("lines").alias("all_lines"))
    named = F.transform("lines", lambda x: F.regexp_extract(x, SPDX, 1))
    bags = bind(bind(bind(bags, "bags", F.transform("lines", _words)), "spdx", named), "hit", F.zip_with(F.transform("bags", lambda b: F.arrays_overlap(b, keys)), "spdx", lambda h, x: h | (x != "")))
    share = lambda words, least: F.size(F.filter(words, lambda w: F.array_contains(known, w))) >= least * F.size(words)
    bags = bind(bags, "full", F.transform("bags", lambda b: share(b, BLOCK)))
    bags = bags.withColumn("all", F.sequence(F.lit(0), F.greatest(F.col("all_lines") - 1, F.lit(0))))
    # Runs that start at a line or up to WINDOW - 1 lines before it, if one of their lines is hit.
    size = F.sequence(F.lit(1), F.lit(WINDOW))
    spans = F.flatten(F.transform("all", lambda i: F.transform(size, lambda n: F.struct(i.alias("start"), n.alias("n")))))
    spans = F.filter(spans, lambda s: (s["start"] + s["n"] <= F.col("all_lines")) & F.exists(F.slice("hit", s["start"] + 1, s["n"]), lambda h: h))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("all_lines").alias("n")))
    # Longer blocks from their first lines to their last ones.
    full = lambda i: F.coalesce(F.get("full", i), F.lit(False))
    ends = F.arrays_zip(F.filter("all", lambda i: full(i) & ~full(i - 1)).alias("a"), F.filter("all", lambda i: full(i) & ~full(i + 1)).alias("b"))
    blocks = F.transform(ends, lambda e: F.struct(e["a"].alias("start"), (e["b"] - e["a"] + 1).alias("n")))
    blocks = F.filter(blocks, lambda s: (s["n"] > WINDOW) & (s["n"] < F.col("all_lines")) & F.exists(F.slice("hit", s["start"] + 1, s["n"]), lambda h: h))
    spans = F.when(F.col("all_lines") > WINDOW, F.concat(spans, blocks, whole)).otherwise(spans)
    runs = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"), F.flatten(F.slice("bags", s["start"] + 1, s["n"])).alias("words"), F.when(s["n"] == 1, F.get("spdx", s["start"])).otherwise("").alias("spdx")))
    kept = F.filter(runs, lambda r: (r["spdx"] != "") | share(r["words"], SHARE))
    out = bags.select("row", "all_lines", F.explode(kept).alias("r"))
    return out.select("row", "all_lines", "r.start", "r.n", F.concat_ws(" ", "r.words").alias("content"), "r.spdx")


def own_licenses(rows: DataFrame) -> DataFrame:
    """rows(row, text) -> row, license, cosine, n_lines (lines of licence runs), all_lines."""
    spark = rows.sparkSession
    n_docs, df = frequencies(rows)
    idf = {w: 1 + log((n_docs + 1) / (df.get(w, 0) + 1)) for w in VOCABULARY}
    other = 1 + log((n_docs + 1) / (n_docs / 100 + 1))
    runs = save(_runs(rows, search_words(n_docs, df, idf)), "lic-runs")
    # Equal runs are scored once however many documents share them.
    kinds = runs.where("spdx = ''").select("content").distinct()
    weights = F.broadcast(spark.createDataFrame([(w, idf[w]) for w in VOCABULARY], "word string, idf double"))  # the templates' words
    table = []
    for name, texts in sorted(TEMPLATES.items()):
        for k, text in enumerate(texts):
            own = words(text)
            norm = sum((own.count(w) * idf[w]) ** 2 for w in sorted(set(own))) ** 0.5
            table += [(name, k, w, own.count(w) * idf[w] / norm) for w in sorted(set(own))]
    patterns = F.broadcast(spark.createDataFrame(table, "license string, k int, word string, w double"))  # the templates
    bags = kinds.select("content", F.explode(F.split("content", " ")).alias("word")).groupBy("content", "word").agg(F.count(F.lit(1)).alias("tf"))
    bags = bags.join(weights, "word", "left").select("content", "word", (F.col("tf") * F.coalesce("idf", F.lit(other))).alias("x"))
    norms = bags.groupBy("content").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = bags.join(patterns, "word").groupBy("content", "license", "k").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    scored = dots.join(norms, "content").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= COSINE)
    best = save(scored.groupBy("content").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b")).select("content", "b.license", (-F.col("b.c")).alias("cosine")), "lic-best")
    found = runs.where("spdx = ''").join(best, "content").select("row", "all_lines", "start", "n", "license", "cosine")
    named = runs.where("spdx <> ''").select("row", "all_lines", "start", "n", F.col("spdx").alias("license"), F.lit(1.0).alias("cosine"))
    lines = F.size(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(start, start + n - 1)")))))
    per = found.unionByName(named).groupBy("row", "all_lines").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"), lines.alias("n_lines"))
    return per.select("row", "b.license", (-F.col("b.c")).alias("cosine"), "n_lines", "all_lines")


def scan_licenses(documents: DataFrame, path: Column, key: str = "doc_id") -> DataFrame:
    """doc_id, path, license, cosine, origin (own, inherited, none), from_dir."""
    told = documents.select(F.col(key).alias("doc_id"), F.coalesce(path, F.lit("")).alias("path"), F.col("text"))
    row = F.xxhash64("doc_id", "path", clean_text()).alias("row")
    own = save(own_licenses(told.select(row, "text")), "lic-own")
    docs = save(told.select(row, "doc_id", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("dir")).join(own, "row", "left"), "lic-docs")
    speaks = docs.where(F.col("license").isNotNull() & ((F.col("n_lines") >= F.col("all_lines")) | F.col("path").rlike(FILE)))
    by_dir = speaks.groupBy("dir").agg(F.min("license").alias("dir_license"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda d: F.concat_ws("/", F.slice(parts, 1, d)))
    dirs = docs.select("dir").distinct().select(F.col("dir").alias("of"), F.explode(above).alias("dir"))
    nearest = dirs.join(by_dir, "dir").groupBy("of").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "dir_license")).alias("m"))
    nearest = save(nearest.select(F.col("of").alias("dir"), "m.dir_license", F.col("m.dir").alias("from_dir")), "lic-dirs")
    out = docs.join(nearest, "dir", "left")
    drop_saved(own)
    inherited = F.col("license").isNull() & F.col("dir_license").isNotNull()
    return out.select("doc_id", "path", F.coalesce("license", "dir_license").alias("license"), "cosine", F.when(F.col("license").isNotNull(), "own").when(inherited, "inherited").otherwise("none").alias("origin"), F.when(inherited, F.col("from_dir")).alias("from_dir"))


#: documents has no paths; this rule gives each row one: source, language, folder of 100 ids.
PATH = "concat_ws('/', coalesce(source, ''), coalesce(lang, ''), cast(doc_id div 100 as string), cast(doc_id as string))"


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.expr(PATH))
