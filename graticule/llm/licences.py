"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

Every line and paragraph of a file is compared with the templates, every run of lines up to twice as long as a template,
and every window of words as long as one, across line ends too, weighted by how rare a word is in the whole corpus. A file without a licence of its own takes that of its nearest ancestor
directory with a licence file: a file named so, or one whose whole text is a notice.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.llm.common import mapped, small_batches, stored

LEAST_COSINE = 0.75
LEAST_WINDOW = 5  # words of a notice that is also looked for inside lines; shorter ones are titles, compared with whole lines
MOST_COUNTED = 200_000  # words that a task counts at a time
FILE_NAMES = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.\-_].*)?$"

# Notices by SPDX identifier.
TEMPLATES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "Licensed under the simplified BSD License."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Licensed under the new BSD License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 into the public domain.", "Dedicated to the public domain under CC0 1.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "ISC": ["Released under the ISC License."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}

# The words by which headers and licence files give a licence. MIT, ISC and the BSD licences are whole; of the
# long licences, the title block of the file and the header that they ask for.
DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,"
    " BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT"
    " SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL"
    " DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS"
    " INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE"
    " OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
    " conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"
    " in the documentation and/or other materials provided with the distribution.",
)
THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived"
    " from this software without specific prior written permission."
)
GNU_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free"
    " Software Foundation, either version {1} of the License, or (at your option) any later version."
)
TEXTS = {
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", GNU_HEADER.format("Affero General Public License", 3)],
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to"
        " in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY"
        " KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": ["BSD 2-Clause License", " ".join([*BSD, DISCLAIMER])],
    "BSD-3-Clause": ["BSD 3-Clause License", " ".join([*BSD, THIRD, DISCLAIMER])],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal"],
    "GPL-1.0": ["GNU GENERAL PUBLIC LICENSE Version 1, February 1989", GNU_HEADER.format("General Public License", 1)],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", GNU_HEADER.format("General Public License", 2)],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", GNU_HEADER.format("General Public License", 3)],
    "ISC": [
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that"
        " the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR"
        " DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT"
        " SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS"
        " OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH"
        " THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "LGPL-2.0": ["GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991", GNU_HEADER.format("Library General Public License", 2)],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", GNU_HEADER.format("Lesser General Public License", 2.1)],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", GNU_HEADER.format("Lesser General Public License", 3)],
    "MIT": [
        "MIT License", "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the"
        " \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,"
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do"
        " so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,"
        " INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"
        " SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
        " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": [
        "Mozilla Public License Version 2.0 1. Definitions",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with"
        " this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
}
# Fixed value: the one sentence by which it is known.
TEXTS["Unlicense"] = ["This is free and unencumbered software released into the public domain."]
TAG = "SPDX-License-Identifier:"


def short_forms(name: str) -> list[str]:
    """The tag that names a licence, and "Licensed under GPLv3" for the GNU licences."""
    gnu = re.fullmatch(r"([AL]?GPL)-(\d)\.0", name)
    return [f"{TAG} {name}", *([f"{how} {gnu[1]}v{gnu[2]}." for how in ("Licensed under", "Licensed under the")] if gnu else [])]


TEMPLATES = {name: TEMPLATES.get(name, []) + texts + short_forms(name) for name, texts in TEXTS.items()}

WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def vocabulary(templates: dict[str, list[str]]) -> frozenset[str]:
    return frozenset(w for notices in templates.values() for n in notices for w in words_of(n))


def word_counts(files: DataFrame) -> DataFrame:
    """How many texts each word occurs in (word, n), and the number of all texts as that of the word "". Counted within
    each task before the shuffle, ``MOST_COUNTED`` words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = 0, Counter()
        for batch in small_batches(batches, "text"):
            for text in batch.column("text").to_pylist():
                total += 1
                counts.update(set(words_of(text or "")))
                if len(counts) > MOST_COUNTED:
                    yield pa.RecordBatch.from_pydict({"word": [*counts], "n": pa.array(counts.values(), pa.int64())})
                    counts = Counter()
        yield pa.RecordBatch.from_pydict({"word": ["", *counts], "n": pa.array([total, *counts.values()], pa.int64())})

    return mapped(files.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Matcher:
    """Unit TF-IDF vectors of all notices, and the cosine of a text with the closest one.

    ``counts`` are those of the words of the notices. Of another word the weight is between 1, that of a word in every
    text, and ``unknown``, that of a word in no text, until its own count is known.
    """

    def __init__(self, texts: int, counts: dict[str, int], templates: dict[str, list[str]], least: float = LEAST_COSINE) -> None:
        self.texts, self.unknown = texts, math.log(1 + texts) + 1
        self.weight = {w: self.weight_of(counts.get(w, 0)) for w in vocabulary(templates)}
        self.by_word: dict[str, list[tuple[int, float]]] = {}
        self.by_anchor: dict[str, list[int]] = {}
        self.vectors: list[dict[str, float]] = []
        self.lengths: list[int] = []
        self.needed: list[set[str]] = []  # words without which a passage is not this notice, however rare they are
        self.names: list[str] = []
        for name in sorted(templates):
            for notice in templates[name]:
                vector = {w: n * self.weight[w] for w, n in Counter(words_of(notice)).items()}
                norm = math.sqrt(sum(v * v for v in vector.values()))
                vector = {w: v / norm for w, v in vector.items()}
                without = 1.0
                for w, v in sorted(vector.items(), key=lambda x: (-self.weight[x[0]], x[0])):  # the rarest first
                    self.by_word.setdefault(w, []).append((len(self.names), v))
                    if without >= least * least - 1e-6:  # a text without any of the anchors is not as close as that
                        self.by_anchor.setdefault(w, []).append(len(self.names))
                        without -= v * v
                self.vectors.append(vector)
                self.lengths.append(len(words_of(notice)))
                said = self.lengths[-1] >= LEAST_WINDOW and not notice.startswith(TAG)
                self.needed.append(vector.keys() & ({words_of(name)[0]} if said else vector.keys()))
                self.names.append(name)

    def weight_of(self, count: int) -> float:
        return math.log((1 + self.texts) / (1 + count)) + 1

    def closest(
        self, words: list[str], least: float, others: dict[str, int] | None = None, floor: bool = False, titles: bool | None = None
    ) -> tuple[float, str | None]:
        """Cosine and name of the closest notice, the first by name of equal ones; (0.0, None) below ``least``. Words
        outside all notices have their counts in ``others``; with ``floor`` they get the least weight. With
        ``titles`` given, a notice that says the licence's name counts only with it, a tag only with all its words, and a
        title, of fewer words than ``LEAST_WINDOW``, only with all of them, or not at all if ``titles`` is false."""
        counts = Counter(words)
        known = {w: n for w, n in counts.items() if w in self.weight}
        if not known:
            return 0.0, None
        inside = sum((n * self.weight[w]) ** 2 for w, n in known.items())
        norm = inside
        if len(known) < len(counts):
            more = others or {}
            weight = (lambda w: 1.0) if floor else (lambda w: self.weight_of(more.get(w, 0)))
            norm += sum((n * weight(w)) ** 2 for w, n in counts.items() if w not in known)
        if inside < least * least * norm:  # no notice can come closer than all its words together
            return 0.0, None
        dots: dict[int, float] = {}
        for w, n in known.items():
            for k, v in self.by_word[w]:
                if titles is None or (titles or self.lengths[k] >= LEAST_WINDOW) and self.needed[k] <= known.keys():
                    dots[k] = dots.get(k, 0.0) + n * self.weight[w] * v
        if not dots:
            return 0.0, None
        score, k = max((round(d / math.sqrt(norm), 9), -k) for k, d in dots.items())
        return (min(1.0, score), self.names[-k]) if score >= least else (0.0, None)

    def passages(self, text: str, least: float) -> tuple[list[tuple[list[str], bool]], list[str] | None]:
        """The passages that may be the closest to a notice whatever the other words weigh, each with whether it is a
        window of words, and the words of the whole text if that may be a notice."""
        every = words_of(text)
        if self.by_anchor.keys().isdisjoint(every):
            return [], None
        found: list[tuple[float, float, list[str], bool]] = []
        for block in [*re.split(r"\n\s*\n", text), *([text] if re.search(r"\n\s*\n", text) else [])]:  # a licence has several paragraphs
            lines = [w for line in block.split("\n") if (w := words_of(line))]
            words = [w for line in lines for w in line]
            spans: set[tuple[int, int, bool]] = {(0, len(words), False)}
            ends = list(accumulate(map(len, lines)))
            for p in [p for p, w in enumerate(words) if w in self.by_anchor]:
                row = bisect_right(ends, p)
                spans.add((ends[row] - len(lines[row]), ends[row], False))
                for k in self.by_anchor[words[p]]:
                    size = self.lengths[k]
                    near = set(words[max(0, p - 2 * size) : p + 2 * size])
                    if sum(v * v for w, v in self.vectors[k].items() if w in near) < least * least - 1e-6:
                        continue
                    if size >= LEAST_WINDOW:
                        spans.update((a, a + size, True) for a in range(max(0, p - size + 1), min(p, len(words) - size) + 1))
                    for i in range(row, -1, -1):
                        start = ends[i] - len(lines[i])
                        if ends[row] - start > 2 * size:
                            break
                        spans.update((start, end, False) for end in ends[row : bisect_right(ends, start + 2 * size)])
            if len(spans) == 1 and self.by_anchor.keys().isdisjoint(words):
                continue
            for a, b, window in spans:
                part = words[a:b]
                most = self.closest(part, least, floor=True, titles=not window)[0]
                if most:
                    found.append((most, self.closest(part, least, titles=not window)[0], part, window))
        sure = max((x[1] for x in found), default=0.0)
        whole = every if found and self.closest(every, least, floor=True, titles=True)[1] else None
        return [(part, window) for most, _, part, window in found if most >= sure], whole

    def judge(self, passages: list[tuple[list[str], bool]], whole: list[str] | None, others: dict[str, int], least: float) -> tuple[float, str | None, float]:
        """The best of all passages, the first by name of equal ones, and the score of the whole text if it is that notice."""
        scored = [self.closest(p, least, others, titles=not window) for p, window in passages]
        best = min((x for x in scored if x[1]), key=lambda x: (-x[0], x[1]), default=(0.0, None))
        every = self.closest(whole, least, others, titles=True) if whole and best[1] else (0.0, None)
        return (*best, every[0] if every[1] and every[1] == best[1] else 0.0)


def scan(files: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST_COSINE) -> DataFrame:
    """For rows (id, path, text): ``own``, the SPDX identifier of the closest notice, its ``score``, and ``whole``, the
    score of the whole text as that notice.

    One job counts the words of all texts. Passages that may be a notice are then found with bounds on the weights of
    words outside all notices; the counts of these words are joined to their files, and the passages scored with them.
    """
    templates = TEMPLATES if templates is None else templates
    counted = stored(word_counts(files), "licences-words")
    own_words = {r["word"]: r["n"] for r in counted.where(F.col("word").isin("", *sorted(vocabulary(templates)))).collect()}
    matcher = Matcher(own_words.pop("", 0), own_words, templates, least)
    kinds = [files.schema[c].dataType.simpleString() for c in ("id", "path")]
    passage = pa.list_(pa.struct([("words", pa.list_(pa.string())), ("window", pa.bool_())]))
    words = pa.list_(pa.string())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = [matcher.passages(t or "", least) for t in batch.column("text").to_pylist()]
            key = [uuid.uuid4().hex if p else None for p, _ in found]
            held = [[{"words": w, "window": x} for w, x in p] for p, _ in found]
            others = [sorted({w for part in [*(w for w, _ in p), whole or []] for w in part} - matcher.weight.keys()) for p, whole in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("path"), pa.array(key, pa.string()), pa.array(held, passage), pa.array([w for _, w in found], words), pa.array(others, words)],
                ["id", "path", "file", "passages", "words", "others"],
            )

    schema = f"id {kinds[0]}, path {kinds[1]}, file string, passages array<struct<words:array<string>,window:boolean>>, words array<string>, others array<string>"
    found = stored(mapped(files.select("id", "path", "text"), find, schema), "licences-passages")
    wanted = found.where("file is not null").select("file", F.explode("others").alias("word"))
    known = counted.join(wanted.select("word").distinct(), "word", "left_semi")
    given = wanted.join(known, "word").groupBy("file").agg(F.collect_list("word").alias("other"), F.collect_list("n").alias("n"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["passages", "words", "other", "n"]).to_pylist()
            judged = [
                matcher.judge([(p["words"], p["window"]) for p in r["passages"]], r["words"], dict(zip(r["other"] or (), r["n"] or ())), least) for r in rows
            ]
            score, own, whole = zip(*judged) if judged else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("path"), pa.array(own, pa.string()), pa.array(score, pa.float64()), pa.array(whole, pa.float64())],
                ["id", "path", "own", "score", "whole"],
            )

    some = found.where("file is not null").join(given, "file", "left").select("id", "path", "passages", "words", "other", "n")
    none = found.where("file is null").select("id", "path", F.lit(None).cast("string").alias("own"), F.lit(0.0).alias("score"), F.lit(0.0).alias("whole"))
    return mapped(some, judge, f"id {kinds[0]}, path {kinds[1]}, own string, score double, whole double").unionByName(none)


def inherit(scanned: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """Adds ``licence`` and ``origin`` to scanned rows: "own", the directory of the licence file, or NULL.

    A directory's licence is that of its best licence file, the first by name of equal ones. Ancestors are looked up once
    for each directory, not for each file, and the files then take what their directory has.
    """
    rows = scanned.withColumn("parts", F.split(F.coalesce("path", F.lit("")), "/"))
    rows = rows.withColumn("dir", F.array_join(F.slice("parts", F.lit(1), F.greatest(F.size("parts") - 1, F.lit(0))), "/")).withColumn(
        "file_name", F.element_at("parts", -1)
    )
    licensed = rows.where(F.col("own").isNotNull() & (F.col("file_name").rlike(FILE_NAMES) | (F.col("whole") >= least)))
    owners = licensed.groupBy("dir").agg(F.min(F.struct(-F.col("score"), "own")).alias("best")).select(F.col("dir").alias("owner"), F.col("best.own").alias("given"))
    dirs = rows.select("dir").distinct().withColumn("names", F.split("dir", "/"))
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size("names"))).alias("depth"), "names")
    above = above.select("dir", "depth", F.array_join(F.slice("names", F.lit(1), F.col("depth")), "/").alias("owner"))
    nearest = above.join(owners, "owner").groupBy("dir").agg(F.max(F.struct("depth", "owner", "given")).alias("near"))
    given = nearest.select("dir", F.col("near.owner").alias("owner"), F.col("near.given").alias("given"))
    return rows.join(given, "dir", "left").select(
        "id", "path", F.coalesce("own", "given").alias("licence"), "score",
        F.when(F.col("own").isNotNull(), "own").when(F.col("given").isNotNull(), F.concat(F.lit("directory "), "owner")).alias("origin"),
    )


def licences(files: DataFrame, file_id: str = "id", path: str = "path", text: str = "text", least: float = LEAST_COSINE) -> DataFrame:
    """One row per file: the identifier, ``path``, ``licence`` (NULL if none), ``score`` of its own notice, ``origin``.

    A missing or empty text has no licence of its own; a missing path is the root, "" in ``origin``. Directories are the
    parts of the path before its last slash. Repeated rows give repeated results, other columns are ignored, and an empty
    table gives an empty result. The whole of every text is scanned, twice: for word counts and for notices. Several jobs run at once.
    """
    chosen = files.select(F.col(file_id).alias("id"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    found = inherit(stored(scan(chosen, least=least), "licences"), least)
    return found.withColumnsRenamed({"id": file_id, "path": path})
