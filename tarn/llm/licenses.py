"""License scan: TF-IDF cosine of headers and licence files to templates, then inheritance down the directories."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import checkpointed, string_column

#: Notices and title pages by licence (fixed values).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston,
MA 02110-1301 USA."""),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions
of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of
the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions
of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS
PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/."""),
    ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."""),
    ("BSL-1.0", "SPDX-License-Identifier: BSL-1.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
)
#: How templates begin that are title pages of licences, and those that are their terms; all others are notices.
_TITLES = ("Apache License Version", "GNU GENERAL", "GNU LESSER", "GNU AFFERO", "Mozilla Public License", "Eclipse Public License", "Boost Software License", "CC0 1.0 Universal")
_TERMS = ("Permission is hereby", "Redistribution and use", "Permission to use", "This software is provided", "This is free and unencumbered")
_BSD_END = """ IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: How terms go on where the template holds their beginning, which is enough for a header but not for the whole text.
_ENDS = {
    "BSD-3-Clause": _BSD_END,
    "BSD-2-Clause": _BSD_END,
    "ISC": """ IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as
such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """ In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We
make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment
in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE. For more information, please refer to <http://unlicense.org/>""",
}
TITLES = tuple((n, t) for n, t in TEMPLATES if t.startswith(_TITLES))
TERMS = tuple((n, t + _ENDS.get(n, "")) for n, t in TEMPLATES if t.startswith(_TERMS))
#: The cosine to a title page or to terms from which on a text is that licence itself; a copyright line of its own leaves terms above it.
OWN_TEXT = 0.9
FILE_NAMES = r"(?i)^(license|licence|copying|notice|unlicense)(\.[a-z]+)?$"
#: Lines that a title page may be spread over.
TITLE_LINES = 3
_TOKEN = re.compile(r"[^\W_]+(?:\.\d+)?")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


class Index:
    """Templates as sparse TF-IDF vectors of length one, by token."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        counts = [Counter(tokens(t)) for _, t in templates]
        df = Counter(w for c in counts for w in c)
        self.names = [n for n, _ in templates]
        self.rare = math.log(1 + len(templates))
        self.idf = {w: math.log(1 + len(templates) / n) for w, n in df.items()}
        self.by_token: dict[str, list[tuple[int, float]]] = {}
        for k, c in enumerate(counts):
            v = {w: n * self.idf[w] for w, n in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
            for w, x in v.items():
                self.by_token.setdefault(w, []).append((k, x / norm))

    def best(self, words: list[str]) -> tuple[str | None, float]:
        """(licence, cosine) of the nearest template, the first of equals; a word that no template has counts as rare."""
        v = {w: n * self.idf.get(w, self.rare) for w, n in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        dots = [0.0] * len(self.names)
        for w, x in v.items():
            for k, y in self.by_token.get(w, ()):
                dots[k] += x * y
        top = max(range(len(dots)), key=dots.__getitem__, default=None)
        return (None, 0.0) if top is None or not norm or dots[top] <= 0 else (self.names[top], dots[top] / norm)

    def reach(self, words: list[str]) -> float:
        """The largest cosine that the words could have with any template: the share of their length in known words."""
        known = Counter(w for w in words if w in self.idf)
        if not known:
            return 0.0
        other = len(words) - sum(known.values())
        inside = sum((n * self.idf[w]) ** 2 for w, n in known.items())
        # Words that repeat are longer than that together, so this is a bound.
        return math.sqrt(inside / (inside + other * self.rare**2))

    def parts(self, text: str, threshold: float) -> Iterator[list[str]]:
        """The words of all parts that may be a notice: lines, a few lines together, paragraphs of such lines, the file.

        A part is left out only if its words rule out a cosine of ``threshold``; lines that do so end a paragraph.
        """
        run: list[list[str]] = []
        lines = [x for x in map(tokens, text.split("\n")) if x]
        for line in [*lines, []]:
            if line and self.reach(line) >= threshold:
                run.append(line)
                continue
            for size in range(1, min(TITLE_LINES, len(run)) + 1):
                for at in range(len(run) - size + 1):
                    yield [w for x in run[at : at + size] for w in x]
            if len(run) > TITLE_LINES:
                yield [w for x in run for w in x]
            run = []
        if len(lines) > 1:
            whole = [w for x in lines for w in x]
            if self.reach(whole) >= threshold:
                yield whole

    def scan(self, text: str, threshold: float) -> tuple[str | None, float, float]:
        """(licence, cosine, share of the text's words) of the part nearest to a template; of equals the longest."""
        found: tuple[float, int, str | None] = (0.0, 0, None)
        for words in self.parts(text, threshold):
            name, score = self.best(words)
            if name is not None and (score, len(words)) > found[:2]:
                found = (score, len(words), name)
        if found[0] < threshold:
            return None, 0.0, 0.0
        return found[2], found[0], found[1] / max(1, len(tokens(text)))


class LicenceTexts:
    """Tells texts that are a licence itself, by its terms or under its title page, from those that only name one."""

    def __init__(self):
        self.titles, self.terms = Index(TITLES), Index(TERMS)

    def own(self, text: str, name: str) -> bool:
        """Whether the text as a whole is the terms of ``name``, or its first lines hold the title page of ``name``."""
        lines = [x for x in map(tokens, text.split("\n")) if x]
        found = [self.terms.best([w for x in lines for w in x])]
        top = lines[:TITLE_LINES]
        found += [self.titles.best([w for x in top[a:b] for w in x]) for a in range(len(top)) for b in range(a + 1, len(top) + 1)]
        return any(n == name and score >= OWN_TEXT for n, score in found)


def _scanner(templates, threshold: float, own_texts: bool):
    def run(batches):
        index, licences = Index(templates.value), LicenceTexts()
        for batch in batches:
            texts, kept = string_column(batch, "text"), batch.drop_columns(["text"])
            for a in range(0, batch.num_rows, 1000):
                some = texts.slice(a, 1000).to_pylist()
                found = [index.scan(t, threshold) for t in some]
                columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
                own = pa.array([own_texts and x[0] is not None and licences.own(t, x[0]) for t, x in zip(some, found, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*kept.slice(a, 1000).columns, *columns, own], names=[*kept.schema.names, "license", "score", "share", "own"])

    return run


def license_scan(files: DataFrame, *, id_col: str | None = None, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.6, file_share: float | None = None, own_texts: bool = False) -> DataFrame:
    """Per file (path, text): path, license, score, basis, license_from; with ``id_col`` that column first, and from_id.

    Lines, a few lines together, paragraphs and the whole file are compared with the templates; the best of a cosine of
    ``threshold`` or more gives the file its licence (basis header).  A file that is named like a licence file and has a
    licence is its directory's licence file (basis file; of several the smallest path, then id); with ``file_share`` so
    is one whose notice makes up that share of its words, and with ``own_texts`` one that is its licence's own text
    (terms as a whole, or a title page in its first lines; no notice that only names a licence), for trees that keep no
    such names.  A file without a licence takes that of the nearest directory above it that has one (basis inherited),
    license_from being that licence file and from_id its id.  Others get nulls and score 0.

    Inheritance is worked out for the distinct directories, each joined with its ancestors by path; files then join
    their directory.  Null and empty texts have no notice, a null path no directory.  Paths and ids that repeat, and
    repeated rows, are scanned each.  A text of any length is scanned whole, in one task.  Other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    ident = F.col(f"`{id_col}`") if id_col else F.lit(None).cast("long")
    rows = files.select(ident.alias("id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    # Files are scanned once; what the scan gives, a short row a file, is read by all that follows.
    own = checkpointed(rows.mapInArrow(_scanner(files.sparkSession.sparkContext.broadcast(templates), threshold, own_texts), f"id {kind}, path string, license string, score double, share double, own boolean"))
    own = own.withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", "")).withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1))
    mostly = F.lit(False) if file_share is None else F.col("share") >= file_share
    own = own.withColumn("is_file", F.coalesce(F.col("license").isNotNull() & (F.col("name").rlike(FILE_NAMES) | mostly | F.col("own")), F.lit(False)))
    given = own.where("is_file and path is not null").groupBy("dir").agg(F.min(F.struct("path", "id", "license")).alias("f")).select(F.col("dir").alias("above"), F.col("f.path").alias("license_from"), F.col("f.id").alias("from_id"), F.col("f.license").alias("given"))
    dirs = own.where("path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    ups = dirs.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts)))).withColumn("above", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    # The root is the empty path, which also is what no parts make.
    ups = ups.select("dir", "above", "depth").distinct()
    nearest = ups.join(given, "above").groupBy("dir").agg(F.max(F.struct("depth", "given", "license_from", "from_id")).alias("n")).select(F.col("dir").alias("in_dir"), "n.given", "n.license_from", "n.from_id")
    out = own.join(nearest, F.col("dir") == F.col("in_dir"), "left")
    mine = F.col("license").isNotNull()
    return out.select(
        *([F.col("id").alias(id_col)] if id_col else []),
        "path",
        F.coalesce("license", "given").alias("license"),
        F.when(mine, F.col("score")).otherwise(F.lit(0.0)).alias("score"),
        F.when(F.col("is_file"), "file").when(mine, "header").when(F.col("given").isNotNull(), "inherited").alias("basis"),
        F.when(~mine, F.col("license_from")).alias("license_from"),
        *([F.when(~mine, F.col("from_id")).alias("from_id")] if id_col else []),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: a source is a directory, below those that its slashes name, a document a file in it.

    Slashes at its end do not count.  A document with no source, or an empty one, has no path: nobody knows what is
    above or below it.
    """
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown")), F.lit(".txt"))
    place = F.rtrim("source", F.lit("/"))
    return docs.select("doc_id", F.when(place != "", F.concat(place, F.lit("/"), name)).alias("path"), "text")


def page_files(pages: DataFrame) -> DataFrame:
    """Pages as files: page_id, path (host and directories of the address, without query and fragment) and text.

    Tags end lines and are left out; a page at the address of a directory is its index.html.  A null address has no path.
    """
    place = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    named = F.when(place.endswith("/") | ~place.contains("/"), F.concat(F.rtrim(place, F.lit("/")), F.lit("/index.html"))).otherwise(place)
    return pages.select("page_id", named.alias("path"), F.regexp_replace("html", r"<[^>]*>", "\n").alias("text"))
