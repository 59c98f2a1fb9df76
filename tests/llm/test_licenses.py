from daygrid.llm.licenses import license_scan
from daygrid.llm.notices import full_texts


def test_headers_files_and_nearest_directory(spark):
    rows = [("LICENSE", "Released under the MIT License.", True), ("a/LICENSE", "Licensed under CC BY-NC 4.0.", True),
            ("a/b/c/x.py", "plain", False), ("a/b/y.py", "words\nlicensed under the APACHE License, Version 2.0.\nmore", False),
            ("z.py", None, False), ("d/e.py", "a license of some kind, nobody knows which", False), ("d/f.py", "", None),
            (None, "Released under the MIT License.", True), ("a/COPYING", "no notice", True),
            ("x/LICENSE", "Released under the MIT License. Licensed under CC BY-NC 4.0.", True), ("d/f.py", "", None),
            ("y/long.txt", "w " * 20000 + ". This work is licensed under the GNU General Public License, version 3.", False)]
    files = spark.createDataFrame([(*r, "score") for r in rows], "path string, text string, is_license_file boolean, license_ string")
    got = {r["path"]: (r["license"], r["origin"], r["directory"]) for r in license_scan(files).collect()}
    assert got["LICENSE"] == ("MIT", "file", None)
    assert got["a/b/c/x.py"] == ("CC-BY-NC-4.0", "inherited", "a")
    assert got["a/b/y.py"] == ("Apache-2.0", "header", None)
    assert got["z.py"] == got["d/e.py"] == got["d/f.py"] == ("MIT", "inherited", "")
    assert got["x/LICENSE"][0] == "CC-BY-NC-4.0"
    assert got["y/long.txt"][:2] == ("GPL-3.0", "header")
    assert license_scan(files).count() == len(rows)
    assert license_scan(files.limit(0)).count() == 0
    alone = license_scan(files.where("path = 'd/e.py'")).first()
    assert (alone["license"], alone["origin"]) == (None, "none")


def test_whole_notices(spark):
    mit = next(text for name, text in full_texts() if name == "MIT")
    gnu = ("This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by",
           "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version.")
    cases = {
        "tag.py": ("# SPDX-License-Identifier: MIT\nx = 1", "MIT"),
        "tag.c": ("/* SPDX-License-Identifier: (Apache-2.0 OR GPL-2.0-or-later) AND MIT */", "Apache-2.0"),
        "tag.md": ("The line SPDX-License-Identifier: ISC says it and more.", "ISC"),
        "gpl.py": ("#!/bin/sh\n#\n" + "\n".join("# " + line for line in gnu) + "\n#\ncode", "GPL-3.0"),
        "mpl.c": ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n"
                  " * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\nint x;", "MPL-2.0"),
        "bsd.go": ("// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\npackage a", "BSD-3-Clause"),
        "opening": ("Copyright (c) 2020 A. Body\n\n" + mit.split("\n\n")[0], "MIT"),
        "head.js": ("/*\n" + "".join(f" * {line}\n" for line in mit.split("\n")) + " */\n" + "let x = 1;\n" * 500, "MIT"),
        "prose": ("A long story of gardens, with a licence to drive and a copy of the map. " * 50, None),
    }
    cases |= {f"{name}/LICENSE": ("Copyright (c) 2021 Some Body\n\n" + text, name) for name, text in full_texts()}
    files = spark.createDataFrame([(p, t, False) for p, (t, _) in cases.items()], "path string, text string, is_license_file boolean")
    assert {r["path"]: r["license"] for r in license_scan(files).where("origin in ('header', 'none')").collect()} == {p: n for p, (_, n) in cases.items()}


def test_block_comments_take_linear_time():
    import random
    import re
    import time

    from daygrid.llm import notices

    slow = lambda text: ["".join(f) for f in re.findall(r"/\*(.*?)\*/|<!--(.*?)-->|\"\"\"(.*?)\"\"\"|'''(.*?)'''", text, re.S)]
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choices(["/*", "*/", "/", "*", "<!--", "-->", '"', '"""', "'''", "'", "a", "b "], k=rng.randint(0, 14)))
        assert notices.block_comments(text) == [" ".join(notices.MARK.sub("", x) for x in body.split("\n")) for body in slow(text)]
    for text in ("/* open " * 300_000, "<!-- " * 300_000 + "-->", '"" ' * 300_000 + "/*" * 200_000):
        start = time.process_time()
        notices.block_comments(text)
        assert time.process_time() - start < 10
