"""Licences against a plain cosine and a walk up the directories."""

import math
import random
from collections import Counter

from texts import awkward, frame, prose

from graticule.llm import licences

MIT, GPL, CC = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."


def test_cosine_equals_the_plain_formula():
    rng = random.Random(1)
    counts = {w: rng.randint(0, 50) for w in licences.vocabulary(licences.TEMPLATES)}
    matcher = licences.Matcher(60, counts, licences.TEMPLATES)

    def vector(words):
        idf = lambda w: math.log(61 / (1 + counts.get(w, 0))) + 1
        return {w: n * idf(w) for w, n in Counter(words).items()}

    pool = sorted(counts) + ["unknown", "words"]
    for _ in range(300):
        words = [rng.choice(pool) for _ in range(rng.randint(1, 14))]
        mine = vector(words)
        best = (0.0, "")
        for name, notices in licences.TEMPLATES.items():
            for notice in notices:
                other = vector(licences.words_of(notice))
                dot = sum(v * other.get(w, 0) for w, v in mine.items())
                best = max(best, (dot / math.sqrt(sum(v * v for v in mine.values()) * sum(v * v for v in other.values())), name))
        score, name = matcher.closest(words, 0.5)
        assert (abs(score - best[0]) < 1e-6) if best[0] >= 0.5 else name is None


def test_nearest_ancestor(spark):
    filler = prose(random.Random(2), 300)
    files = {
        "LICENSE": MIT, "a/COPYING.txt": f"{filler}\n\n{GPL}", "a/b/c/notes": CC, "a/x.py": filler, "a/b/y.py": filler, "a/b/c/z.py": filler,
        "a/b/c/d/own.py": f"{MIT}\n{filler}", "top.py": filler, "q/r.py": None, "a/b/c/d/none.py": "",
    }
    rows = spark.createDataFrame([(k, p, t, "x") for k, (p, t) in enumerate(files.items())], "id int, path string, text string, dir string")
    found = {r.path: (r.licence, r.origin) for r in licences.licences(rows).collect()}
    assert found == {
        "LICENSE": ("MIT", "own"), "a/COPYING.txt": ("GPL-3.0", "own"), "a/b/c/notes": ("CC-BY-NC-4.0", "own"),
        "a/x.py": ("GPL-3.0", "directory a"), "a/b/y.py": ("GPL-3.0", "directory a"), "a/b/c/z.py": ("CC-BY-NC-4.0", "directory a/b/c"),
        "a/b/c/d/own.py": ("MIT", "own"), "top.py": ("MIT", "directory "), "q/r.py": ("MIT", "directory "),
        "a/b/c/d/none.py": ("CC-BY-NC-4.0", "directory a/b/c"),
    }


def test_awkward_rows(spark):
    pairs = awkward(random.Random(3)) + [(20, prose(random.Random(4), 50) + "\n" + GPL)]
    docs = frame(spark, pairs).withColumn("path", licences.F.lit(None).cast("string"))
    rows = licences.licences(docs, file_id="doc_id").collect()
    assert len(rows) == len(pairs)
    assert [(r.doc_id, r.licence) for r in rows if r.licence] == [(20, "GPL-3.0")]
    assert licences.licences(docs.where("false"), file_id="doc_id").count() == 0


def texts(spark, *given):
    filler = [prose(random.Random(k), 30) for k in range(40)]
    return frame(spark, list(enumerate([*given, *filler]))).withColumn("path", licences.F.concat(licences.F.lit("d"), "doc_id", licences.F.lit("/x")))


def found_in(spark, *given):
    rows = {r.doc_id: r.licence for r in licences.licences(texts(spark, *given), file_id="doc_id").collect()}
    return [rows[k] for k in range(len(given))]


def test_notices_inside_lines(spark):
    long = prose(random.Random(5), 400)
    given = [
        "This file is licensed under the Apache License, Version 2.0.", "This file is released under the MIT License by Acme.",
        "Copyright Acme. Released under the MIT License.", f"{long} {GPL} {long}", "We released it under the name of MIT.",
    ]
    assert found_in(spark, *given) == ["Apache-2.0", "MIT", "MIT", "GPL-3.0", None]


def test_other_words_weigh_by_their_own_count(spark):
    """A line of a notice and words that every text has scores higher than one with words that no other has."""
    rows = [(k, f"d{k}/x", t) for k, t in enumerate(["MIT License common words here", "MIT License zork plugh xyzzy", *["common words here"] * 60])]
    files = spark.createDataFrame(rows, "id int, path string, text string")
    score = {r.id: r.score for r in licences.scan(files, {"MIT": ["MIT License"]}, 0.3).collect()}
    own = math.log(63 / 3) + 1, math.log(63 / 62) + 1, math.log(63 / 2) + 1
    assert abs(score[0] - math.sqrt(2 * own[0] ** 2 / (2 * own[0] ** 2 + 3 * own[1] ** 2))) < 1e-6
    assert abs(score[1] - math.sqrt(2 * own[0] ** 2 / (2 * own[0] ** 2 + 3 * own[2] ** 2))) < 1e-6


def test_notices_wrapped_in_long_paragraphs(spark):
    rng = random.Random(6)
    lines = [f" * {prose(rng, 8)}" for _ in range(30)]
    wrapped = [" * This work is licensed under the GNU", " * General Public License, version 3."]
    other = [" * This work is licensed under the", " * GNU Lesser General Public", " * License, version 3, by Acme"]
    shortened = [" * work licensed under", " * GNU General Public License", " * version 3"]
    given = ["\n".join([*lines[:9], *w, *lines[9:n]]) for w in (wrapped, other, shortened) for n in (10, 30)]
    assert found_in(spark, *given) == ["GPL-3.0", "GPL-3.0", "LGPL-3.0", "LGPL-3.0", "GPL-3.0", "GPL-3.0"]


def test_licence_files_with_the_full_text(spark):
    def file(title, name):
        body = max(licences.TEMPLATES[name], key=len).replace(" IN NO EVENT", "\n\nIN NO EVENT").replace(". ", ".\n")
        return f"{title}\n\nCopyright (c) 2020, 2021 Acme Works and others\n\n{body}\n"

    given = [file("", "MIT"), file("MIT License", "MIT"), file("", "ISC"), file("", "BSD-2-Clause"), file("", "BSD-3-Clause"), file("", "GPL-2.0"), file("", "Apache-2.0")]
    given += ["  GNU GENERAL PUBLIC LICENSE\n    Version 3, 29 June 2007\n\n" + prose(random.Random(7), 300), "MIT License"]
    wanted = ["MIT", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "Apache-2.0", "GPL-3.0", "MIT"]
    assert found_in(spark, *given) == wanted
    rows = [(0, "a/LICENSE", given[0]), (1, "a/b/x.py", "x"), (2, "c/whole", given[3]), (3, "c/y.py", "y"), *[(k, f"z/{k}", prose(random.Random(k), 30)) for k in range(4, 30)]]
    found = {r.id: r.licence for r in licences.licences(spark.createDataFrame(rows, "id int, path string, text string")).collect()}
    assert [found[k] for k in range(5)] == ["MIT", "MIT", "BSD-2-Clause", "BSD-2-Clause", None]


def test_a_title_counts_with_all_its_words():
    matcher = licences.Matcher(1000, {"mit": 400}, {"MIT": ["MIT License"]})
    assert matcher.closest(["license"], 0.75)[1] == "MIT"
    for text, wanted in (("License", None), ("MIT License", "MIT"), ("so we use the MIT License for all of this", None)):
        assert matcher.judge(*matcher.passages(text, 0.75), {}, 0.75)[1] == wanted


def test_a_notice_needs_the_name_it_says():
    matcher = licences.Matcher(1000, {"mit": 800}, {"MIT": ["Licensed under the MIT License."]})
    for text, wanted in (("Licensed under the License", None), ("Licensed under the MIT License", "MIT")):
        assert matcher.judge(*matcher.passages(text, 0.75), {}, 0.75)[1] == wanted


def test_tags_and_short_forms():
    """In a source file, whatever opens the comment; a tag of a licence that is not known is none."""
    given = {
        "SPDX-License-Identifier: MIT": "MIT", "SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "SPDX-License-Identifier: ISC": "ISC",
        "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0", "SPDX-License-Identifier: LGPL-2.1+": "LGPL-2.1",
        "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "SPDX-License-Identifier: BSD-4-Clause": None, "SPDX-License-Identifier: EPL-2.0": None,
        "SPDX-License-Identifier: EUPL-1.2": None, "SPDX-License-Identifier: Unlicense": "Unlicense", "Licensed under GPLv3.": "GPL-3.0",
        "Licensed under the AGPLv3.": "AGPL-3.0", "This is free and unencumbered software released into the public domain.": "Unlicense",
        "The identifier of a license is a word.": None, "Licensed under.": None, "SPDX-License-Identifier:": None,
    }
    for texts, common in ((60, 5), (3_000_000, 900)):
        counts = {w: common for w in licences.vocabulary(licences.TEMPLATES) if w not in ("spdx", "identifier")}
        matcher = licences.Matcher(texts, counts, licences.TEMPLATES)
        for line, wanted in given.items():
            for text in (line, f"// {line}", f"#!/bin/sh\n# {line}\nfor i in a b c; do echo $i; done\n", f"/*\n * {line}\n */\nint main() {{ return 0; }}"):
                assert matcher.judge(*matcher.passages(text, 0.75), {}, 0.75)[1] == wanted, (text, texts)


def test_tags_in_files_and_what_their_directory_gives(spark):
    rng = random.Random(9)
    tagged = f"# SPDX-License-Identifier: Apache-2.0\n{prose(rng, 200)}"
    rows = [
        (0, "a/x.py", tagged), (1, "a/y.py", prose(rng, 30)), (2, "b/LICENSE", "SPDX-License-Identifier: MIT"), (3, "b/c/z.py", prose(rng, 30)),
        (4, "b/c/own.py", tagged), *[(k, f"z/{k}", prose(rng, 30)) for k in range(5, 30)],
    ]
    found = {r.id: (r.licence, r.origin) for r in licences.licences(spark.createDataFrame(rows, "id int, path string, text string")).collect()}
    assert found[0] == ("Apache-2.0", "own") and found[1] == (None, None) and found[4] == ("Apache-2.0", "own")
    assert found[2] == ("MIT", "own") and found[3] == ("MIT", "directory b")
