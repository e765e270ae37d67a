import math
import re
from collections import Counter

import pytest
from conftest import SF0001

from quarry.llm import licenses as li


def terms(s):
    return re.findall(li.TERM, s.lower())


def brute(rows):
    """{position: (license, is file, effective, inherited_from)} from (doc_id, path, text), with exact terms."""
    cut = [[s for s in re.split(li.SENTENCE_END, t or "") if re.search(li.CUE, s)] for _, _, t in rows]
    temps = sorted((n, t) for n, ts in li.TEMPLATES.items() for t in ts)
    bags = [terms(s) for c in cut for s in c] + [terms(t) for _, t in temps]
    df = Counter(w for b in bags for w in set(b))
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in df.items()}

    def vec(s):
        v = {w: n * idf[w] for w, n in Counter(terms(s)).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / norm for w, x in v.items()}

    tv = [(n, vec(t)) for n, t in temps]
    own = []
    for (_, path, text), c in zip(rows, cut):
        best = (0.0, None)
        for s in c:
            v = vec(s)
            for n, t in tv:
                score = sum(x * t.get(w, 0) for w, x in v.items())
                if score > best[0] + 1e-12:
                    best = (score, n)
        name = best[1] if best[0] >= 0.6 else None
        words = len((text or "").split())
        is_file = name is not None and (re.match(li.LICENCE_FILE, (path or "").split("/")[-1]) is not None or 2 * sum(len(s.split()) for s in c) >= words)
        own.append((name, best[0], is_file))
    folder = lambda p: (p or "").rpartition("/")[0]
    dirs = {}
    for (_, path, _), (name, score, is_file) in zip(rows, own):
        if is_file:
            key = (-round(score, 9), path or "")
            if folder(path) not in dirs or key < dirs[folder(path)][0]:
                dirs[folder(path)] = (key, name)
    out = []
    for (_, path, _), (name, _, is_file) in zip(rows, own):
        at = folder(path)
        while at not in dirs and at:
            at = folder(at)
        near = (dirs[at][1], at) if at in dirs else (None, None)
        out.append((name, is_file, name or near[0], None if name else near[1]))
    return out


FILES = [
    (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "words only, nothing else"), (3, "a/b/c/LICENSE.md", "Some head.\nLicensed under the Apache License, Version 2.0."),
    (4, "a/b/c/d/e.txt", None), (5, "a/b/c/d/f.txt", "Long prose here. This work is licensed under the GNU General Public License, version 3. More prose follows here and there and on and on."),
    (6, "z.txt", "prose"), (7, None, ""), (8, "q/COPYING", "no cue at all"), (9, "q/y", "plain"), (10, "a/b/c/COPYING", "licensed under the MIT License"),
    (10, "a/b/c/COPYING", "licensed under the MIT License"), (11, "m/n.txt", "She took licence with the tale of long ago and far away, as they all did."), (None, "a/b2", "prose " * 100_000),
]


def result(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, license string")
    return [tuple(r) for r in li.scan(df).select("doc_id", "path", "license", "is_license_file", "effective", "inherited_from").collect()]


def test_files_against_brute_force(spark):
    want = [(i, p, *b) for (i, p, _), b in zip(FILES, brute(FILES))]
    key = lambda r: str(r)
    assert sorted(result(spark, FILES), key=key) == sorted(want, key=key)
    by_id = {r[0]: r for r in want}
    assert by_id[2][4:] == ("MIT", "a") and by_id[5][2] == "GPL-3.0" and by_id[4][5] == "a/b/c" and by_id[6][4] is None and by_id[11][2] is None


def test_root_licence_covers_everything(spark):
    rows = [(1, "LICENSE", "Licensed under CC BY-NC 4.0."), (2, "x/y/z.txt", "prose"), (3, None, "prose")]
    assert {r[0]: r[4:] for r in result(spark, rows)} == {1: ("CC-BY-NC-4.0", None), 2: ("CC-BY-NC-4.0", ""), 3: ("CC-BY-NC-4.0", "")}


def test_empty_table(spark):
    assert li.scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_query_against_brute_force(spark):
    out = li.op4_license_scan(spark, SF0001).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    want = brute([(r.doc_id, r.path, texts[r.doc_id]) for r in out])
    assert len(out) == len(texts)
    for r, w in zip(out, want):
        assert (r.license, r.is_license_file, r.effective, r.inherited_from) == w
    assert any(r.license for r in out)


@pytest.mark.parametrize("name", sorted(li.TEMPLATES))
def test_every_template_finds_itself(spark, name):
    assert brute([(1, "x", li.TEMPLATES[name][0] + " licence.")])[0][0] is not None


def commented(text, mark=" * "):
    return "/*\n" + "\n".join((mark + line).rstrip() for line in text.split("\n")) + "\n */\nint main() { return 0; }\n"


GPL_HEADER = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


def test_headers_and_licence_files_are_compared_whole(spark):
    title = "                    GNU GENERAL PUBLIC LICENSE\n                       Version {}\n\n Copyright (C) Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n"
    wrap = lambda t: "\n".join(" ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9))
    rows = [
        (1, "a1/x.c", commented(GPL_HEADER.format(2))), (2, "a2/x.c", commented(GPL_HEADER.format(3))), (3, "a3/x.py", "# " + GPL_HEADER.format(2).replace("\n", "\n# ")),
        (4, "a4/COPYING", title.format("3, 29 June 2007")), (5, "a5/COPYING", title.format("2, June 1991")),
        (6, "a6/x.c", "// SPDX-License-Identifier: MIT\nint x;\n"), (7, "a7/x.py", "# SPDX-License-Identifier: Apache-2.0\nx = 1\n"), (8, "a8/x.c", "/* SPDX-License-Identifier: (GPL-2.0-or-later OR MIT) */\n"),
        (9, "a9/notes", "Copyright (c) 2020 A. Writer\n\n" + wrap(li.FULL["BSD-2-Clause"][0])), (10, "b1/notes", "Copyright (c) 2020 A. Writer\n\n" + wrap(li.FULL["BSD-3-Clause"][0])),
        (11, "b2/notes", "Copyright (c) 2020 A. Writer\n\n" + wrap(li.FULL["MIT"][0])), (12, "b3/x", "No part of this work may be copied without permission."), (13, "b4/x.c", "// SPDX-License-Identifier: Unheard-Of\n"),
        (14, "b5/LICENSE", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n"),
    ]
    want = dict(zip(range(1, 15), ["GPL-2.0", "GPL-3.0", "GPL-2.0", "GPL-3.0", "GPL-2.0", "MIT", "Apache-2.0", "GPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "MIT", "Proprietary", None, "Apache-2.0"]))
    got = {r[0]: r[2:4] for r in result(spark, rows)}
    assert {i: name for i, (name, _) in got.items()} == want
    assert all(got[i][1] for i in (4, 5, 9, 10, 11, 14)) and not any(got[i][1] for i in (13,))
    many = [(100 * i + j, f"{i}/{j}", t) for i, _, t in rows for j in range(20)]
    assert all(r[2] == want[r[0] // 100] for r in result(spark, many))


def test_a_long_text_is_compared_whole_whatever_its_name(spark):
    # spread over lines and blocks, so that no block alone is like the licence
    words = li.FULL["BSD-3-Clause"][0].split()
    text = "\n\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12))
    rows = [(1, "d1/notes", text), (2, "d2/notes", "\n\n".join([text] * 6)), (3, "d3/LICENSE", "\n\n".join([text] * 6)), (4, "d2/below.c", "int x;")]
    assert len(rows[1][2].split()) > 1000
    got = {r[0]: r[2:] for r in result(spark, rows)}
    assert got[1][:2] == got[2][:2] == got[3][:2] == ("BSD-3-Clause", True) and got[4][2:] == ("BSD-3-Clause", "d2")
