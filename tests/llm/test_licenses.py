"""Licence scan against a plain computation, multi-line headers, inheritance, unusual rows."""

from collections import Counter
from math import log, sqrt

from flowscape.llm import licenses

SCHEMA = "doc_id long, text string, path string"
MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.
int main() { return 0; }
"""
ROWS = [
    (1, "Released under the MIT License.", "a/LICENSE"),
    (2, None, "a/b/c.txt"),
    (3, "x y\nLicensed under CC BY-NC 4.0.\nmore words of prose here", "d/e"),
    (4, "plain words\nof prose", "f"),
    (5, MPL, "g/main.c"),
    (6, "# SPDX-License-Identifier: EPL-2.0\nimport os\n", "g/x.py"),
    (7, licenses.TEMPLATES["MIT"][2].replace(", ", ",\n") + "\n", "h/COPYING"),
    (8, "", "h/i/j/k.c"),
    (None, "plain", None),
    (9, "The licence of this text is not said, ask for a license", "f/q"),
    (10, "Licensed under the Apache License, Version 2.0.", "a/b/z.txt"),
    (10, "Licensed under the Apache License, Version 2.0.", "a/b/z.txt"),
]


def _plain(rows):
    """Own licence of each text, by the definition."""
    bags = [set(licenses.words(t or "")) for _, t, _ in rows]
    n = len(rows)
    df = {w: sum(w in b for b in bags) for w in licenses.VOCABULARY}
    idf = lambda w: 1 + log((n + 1) / ((df[w] if w in df else n / 100) + 1))
    rare = {w for w in df if df[w] <= licenses.RARE * n}

    def weights(words):
        return {w: c * idf(w) for w, c in Counter(words).items()}

    out = []
    for _, text, _ in rows:
        lines, best = [x for x in (text or "").split("\n") if x.strip(" ")], None
        for a in range(len(lines)):
            for b in {*range(a + 1, min(a + licenses.WINDOW, len(lines)) + 1), *([len(lines)] if a == 0 else [])}:
                words = [w for x in lines[a:b] for w in licenses.words(x)]
                if "SPDX-License-Identifier: " in lines[a] and b == a + 1:
                    best = min(best or (0, ""), (-1.0, lines[a].split(": ")[1]))
                if not rare & set(words) or sum(w in df for w in words) < licenses.SHARE * len(words):
                    continue
                x = weights(words)
                for name, texts in licenses.TEMPLATES.items():
                    for t in texts:
                        y = weights(licenses.words(t))
                        cos = sum(x[w] * y[w] for w in x if w in y) / sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
                        if cos >= licenses.COSINE:
                            best = min(best or (0, ""), (-round(cos, 6), name))
        out.append(best and best[1])
    return out


def test_equals_the_definition(spark, monkeypatch):
    monkeypatch.setattr(licenses, "RARE", 0.6)  # of a dozen rows one is more than 5 %
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'x' as license", "1 as row", "2.0 as cosine")
    got = licenses.scan_licenses(df, df.path).collect()
    own = Counter((r.doc_id, r.license if r.origin == "own" else None) for r in got)
    assert own == Counter((r[0], x) for r, x in zip(ROWS, _plain(ROWS), strict=True))
    by = {r.doc_id: (r.license, r.origin, r.from_dir) for r in got}
    assert by[5] == ("MPL-2.0", "own", None) and by[6] == ("EPL-2.0", "own", None) and by[7] == ("MIT", "own", None)
    assert by[2] == ("Apache-2.0", "inherited", "a/b") and by[8] == ("MIT", "inherited", "h")
    assert by[3][0] == "CC-BY-NC-4.0" and by[4] == by[9] == by[None] == (None, "none", None)
    assert len(got) == len(ROWS)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert licenses.scan_licenses(df, df.path).count() == 0


def test_a_common_licence_is_found(spark):
    """Every document has the notice, so none of its words is rare; SPDX lines too."""
    rows = [(d, f"prose number {d}\nReleased under the MIT License\nand more", f"a{d}/x") for d in range(30)]
    rows += [(30 + d, f"# SPDX-License-Identifier: EPL-2.0\nlicense {d}", f"b{d}/x") for d in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.license for r in licenses.scan_licenses(df, df.path).collect()}
    assert got == {d: "MIT" if d < 30 else "EPL-2.0" for d in range(60)}


def test_a_long_notice_within_a_text(spark):
    """A notice of many short lines before a program is compared as one block."""
    own = licenses.words(licenses.TEMPLATES["BSD-2-Clause"][0])
    notice = "\n".join("// " + " ".join(own[a : a + 5]) for a in range(0, len(own), 5))
    body = "\n".join(f"x{k} = compute{k}(y{k}) + z{k}" for k in range(40))
    df = spark.createDataFrame([(1, f"#!/bin/x{1}\n{notice}\n{body}", "g/m.c"), *[(k, f"plain prose {k}", f"h{k}/x") for k in range(2, 40)]], SCHEMA)
    found = licenses.own_licenses(df.selectExpr("doc_id as row", "text")).collect()
    assert [(r.row, r.license) for r in found] == [(1, "BSD-2-Clause")] and found[0].cosine > 0.999
    assert found[0].n_lines >= len(notice.split("\n"))
