"""License scan by conditional compression.

Candidate blocks are the paragraphs, lines and sentences of a text with a word that licenses use, the largest first; what a
confirmed block covers is not looked at again.  Each block is compressed with zstandard alone and with every template as raw
dictionary, and the templates are ranked by the reduction in size.  In this order they are aligned with the block, and the first one wins that is
confirmed by the exact differences between its wording and the part of the block that follows it:

* the part holds a run of words that is the template's own: it stands in no other template, names a version if the template's name
  does, is long or says that it is about a license, and disclaims nothing (boilerplate that licenses share confirms none);
* few words differ, and none that decides between licenses (names, versions, elements such as NC or SA, negations), neither inside the part nor beside it;
* no negation stands in the same sentence before or right behind the part.

Templates are a parameter, a table of name and wording.  Defined results: null and blank texts have no blocks; equal savings go to
the first template by name; repeated rows repeat, and a row is known by its id and the hash of its text; offsets count code
points of the text; very long texts count whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import difflib
import functools
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(program: str, name: str, version: str) -> str:
    """The notices of the GNU licenses, which differ in these words."""
    return (
        f"This work is licensed under the GNU {name}, version {version}. {program} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"{program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
        f"You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


def _commons(short: str, long: str, version: str = "4.0") -> str:
    return f"Licensed under CC {short} {version}. This work is licensed under a Creative Commons {long} {version} International License."


# Wordings by which these licenses are granted.
TEMPLATES = {
    "AGPL-3.0": _gnu("This program", "Affero General Public License", "3"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": _BSD + _BSD_END + " Released under the BSD 2-Clause License.",
    "BSD-3-Clause": _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END + " Released under the BSD License. Released under the BSD 3-Clause License.",
    "CC-BY-3.0": _commons("BY", "Attribution", "3.0"),
    "CC-BY-4.0": _commons("BY", "Attribution"),
    "CC-BY-NC-4.0": _commons("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-ND-4.0": _commons("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _commons("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": _commons("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-SA-4.0": _commons("BY-SA", "Attribution-ShareAlike"),
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. Released under CC0 1.0 Universal, dedicated to the public domain.",
    "GPL-2.0": _gnu("This program", "General Public License", "2"),
    "GPL-3.0": _gnu("This program", "General Public License", "3"),
    "ISC": "Released under the ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-2.1": _gnu("This library", "Lesser General Public License", "2.1"),
    "LGPL-3.0": _gnu("This library", "Lesser General Public License", "3"),
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "All-rights-reserved": "All rights reserved. Copyright, all rights reserved. No part of this work may be reproduced without written permission.",
}
#: Words that tell licenses apart; a year is none.
DECISIVE = frozenset("affero lesser library nc nd sa by noncommercial noderivatives noderivs sharealike no not apache mit bsd isc mozilla mpl agpl lgpl gpl cc0 zlib clause documentation eclipse artistic boost academic".split())
#: Words of disclaimers, which grant nothing.
DISCLAIMING = frozenset("warranty warranties liable liability damages".split())
#: Words that turn a sentence around, and words by which a short run is about a license.
NEGATIONS = frozenset("no not never nor neither cannot isn't wasn't aren't doesn't don't unlike instead without except formerly previously".split())
ABOUT = frozenset("license licence licensed licenced cc cc0 commons mpl unencumbered reserved".split())
_VERSION, _YEAR = re.compile(r"v?\d+(?:\.\d+)*"), re.compile(r"(?:19|20)\d\d")
_MARK = re.compile(r"licen[cs]|copyright|all\s+rights\s+reserved|creative\s+commons|public\s+domain|permission\s+is\s+(?:hereby\s+)?granted|redistribut|\bcc0?[\s-](?:by|1\.0)|free\s+software|as[\s-]is\b|warrant", re.I)
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
_NAMED_VERSION, _STOP = re.compile(r"\d+\.\d+"), re.compile(r"[.!?;](?:\s|$)|\n[ \t]*\n")
#: Holds wherever _MARK does, and uses nothing that Java's expressions read in another way.
_MAYBE = r"(?isu)licen|copyright|rights|commons|domain|permission|redistribut|cc0?.(?:by|1)|software|as.is|warrant"
_PARAGRAPH, _LINE, _SENTENCE = re.compile(r"\n[ \t]*\n\s*"), re.compile(r"\n"), re.compile(r"(?<=[.!?])\s+")
#: Share of the compressed size that the winner must save, of a block to be aligned and of the part that follows the
#: template; share of this part's words that must follow, and words at least.
FIRST_SAVING, LEAST_SAVING, LEAST_SAME, LEAST_WORDS = 0.10, 0.25, 0.75, 3
#: Words of a run that is a template's own: at most, and at least where no word of ABOUT is among them (or the whole template).
OWN_MOST, OWN_LEAST = 24, 12


class Scanner:
    """Templates with their words and compressors."""

    def __init__(self, templates: dict[str, str]):
        options = {"level": 12, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.names = sorted(templates)
        self.words = {n: [m.group() for m in _WORD.finditer(templates[n].lower())] for n in self.names}
        self.plain = zstandard.ZstdCompressor(**options)
        self.primed = {n: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(templates[n].lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **options) for n in self.names}
        self.own = {n: self._own_runs(n) for n in self.names}
        self.found: dict[str, tuple | None] = {}

    def _own_runs(self, name: str) -> list[tuple[int, int]]:
        """(begin, end) of the shortest runs of words by which a template is known, one from each word at most."""
        words = self.words[name]
        others = [_spelled(w) for n, w in self.words.items() if n != name and w != words]
        version = _NAMED_VERSION.search(name)
        wanted = {version.group(), version.group().removesuffix(".0")} if version else None
        out = []
        for i in range(len(words)):
            for j in range(i + 1, min(i + OWN_MOST, len(words)) + 1):
                run = words[i:j]
                if run[-1] in DISCLAIMING:
                    break
                about = len(run) >= min(OWN_LEAST, len(words)) or any(p in ABOUT for w in run for p in w.split("-"))
                if about and (wanted is None or any(w.lstrip("v") in wanted for w in run)) and not any(_spelled(run) in o for o in others):
                    out.append((i, j))
                    break
        return out

    def savings(self, block: str, names: list[str] | None = None) -> list[tuple[float, str]]:
        """(share of the compressed size saved, template), the best first and equals by name."""
        raw = " ".join(block.lower().split()).encode()
        alone = len(self.plain.compress(raw))
        return sorted((((alone - len(self.primed[n].compress(raw))) / alone, n) for n in names or self.names), key=lambda x: (-x[0], x[1]))

    def winner(self, block: str) -> tuple[int, int, str, float, int, list[str]] | None:
        """(begin, end, template, saving, words, differences) of the part of a block that follows a confirmed template best."""
        if block in self.found:
            return self.found[block]
        places = [(m.start(), m.end(), m.group().lower()) for m in _WORD.finditer(block)]
        words = [w for *_, w in places]
        known, out = set(words), None
        for saving, name in self.savings(block):
            if saving < FIRST_SAVING:
                break
            template = self.words[name]
            # without a run of the template's own nothing is confirmed, and nothing needs to be aligned
            if not any(known.issuperset(template[i:j]) for i, j in self.own[name]):
                continue
            part = followed(template, words)
            if part is None:
                continue
            first, last, same, diff = part
            begin, end = places[first][0], places[last][1]
            if any(map(decides, diff)) or negated(block, begin, end) or not any(same.issuperset(range(i, j)) for i, j in self.own[name]):
                continue
            share = self.savings(block[begin:end], [name])[0][0]
            if share >= LEAST_SAVING:
                out = begin, end, name, share, last - first + 1, diff
                break
        if len(block) <= 1000:  # notices come again and again
            if len(self.found) >= 5_000:
                self.found.clear()
            self.found[block] = out
        return out


def _spelled(words: list[str]) -> str:
    """Words between bars, so that a run of words is a part of the string."""
    return f"|{'|'.join(words)}|"


def negated(block: str, begin: int, end: int) -> bool:
    """Whether a negation stands before the part in its sentence, or among the three words right behind it."""
    before = _STOP.split(block[:begin])[-1]
    behind = _STOP.split(block[end:], maxsplit=1)[0]
    words = [m.group().lower() for m in _WORD.finditer(before)] + [m.group().lower() for m in _WORD.finditer(behind)][:3]
    return any(w in NEGATIONS for w in words)


def followed(template: list[str], block: list[str]) -> tuple[int, int, set[int], list[str]] | None:
    """(first word, last word, places of the template's words that follow, differences) of the part of ``block`` around its longest common run with ``template``
    that keeps to it.  The part does not grow over differences that decide.

    A difference is ``-word`` of the template or ``+word`` of the block.
    """
    runs = [m for m in difflib.SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not runs:
        return None

    def between(low: int, high: int) -> list[str]:
        out = []
        for x, y in zip(runs[low:high], runs[low + 1 : high + 1]):
            out += [f"-{w}" for w in template[x.a + x.size : y.a]] + [f"+{w}" for w in block[x.b + x.size : y.b]]
        return out

    k = max(range(len(runs)), key=lambda i: runs[i].size)
    low = high = k
    same = runs[k].size
    while True:
        grown = []
        if low > 0:
            grown.append((runs[low - 1].size / (runs[low].b - runs[low - 1].b), low - 1, high))
        if high + 1 < len(runs):
            grown.append((runs[high + 1].size / (runs[high + 1].b + runs[high + 1].size - runs[high].b - runs[high].size), low, high + 1))
        for _, a, b in sorted(grown, reverse=True):
            more = sum(r.size for r in runs[a : b + 1])
            if more >= LEAST_SAME * (runs[b].b + runs[b].size - runs[a].b) and not any(map(decides, between(a, b))):
                low, high, same = a, b, more
                break
        else:
            break
    diff = between(low, high)
    first, last = runs[low].b, runs[high].b + runs[high].size - 1
    # a word that decides may stand right before or behind the part
    diff += [f"+{w}" for w in (block[first - 1 : first] if first else []) + block[last + 1 : last + 2] if decides(f"+{w}")]
    return (first, last, {i for r in runs[low : high + 1] for i in range(r.a, r.a + r.size)}, diff) if same >= LEAST_WORDS else None


def decides(difference: str) -> bool:
    """Whether a difference tells licenses apart: a deciding word, or a version that is not a year."""
    parts = difference[1:].split("-")
    return any(p in DECISIVE or (_VERSION.fullmatch(p) and not _YEAR.fullmatch(p)) for p in parts)


def _pieces(text: str, begin: int, end: int, gap: re.Pattern) -> list[tuple[int, int]]:
    out, at = [], begin
    for m in gap.finditer(text, begin, end):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, end)]


def blocks_of(text: str, scanner: Scanner) -> list[tuple[int, int, str, float, int, list[str]]]:
    """(begin, end, license, saving, words, differences) of the confirmed blocks of a text, in order."""
    found: list[tuple] = []

    def scan(begin: int, end: int, gaps: list[re.Pattern]) -> None:
        if not _MARK.search(text, begin, end):
            return
        best = scanner.winner(text[begin:end])
        if best:
            a, b = begin + best[0], begin + best[1]
            found.append((a, b, *best[2:]))
            rest = [(begin, a), (b, end)]  # may hold another notice
        else:
            rest = [(begin, end)]
        for x, y in rest:
            if gaps and y > x:
                for u, v in _pieces(text, x, y, gaps[0]):
                    if v > u:
                        scan(u, v, gaps[1:])

    for begin, end in _pieces(text, 0, len(text), _PARAGRAPH):
        scan(begin, end, [_LINE, _SENTENCE])
    return sorted(found)


@functools.lru_cache(2)
def _scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(templates))


def license_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row for each confirmed block: doc_id, content (hash of the text), begin, end, license, saving, n_words, differences."""
    table = tuple(sorted(templates.items()))

    def run(batches):
        scanner = _scanner(table)
        for batch in batches:
            out = [(doc_id, content, *b) for doc_id, content, text in zip(*(batch.column(k).to_pylist() for k in range(3))) for b in blocks_of(text or "", scanner)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, kinds)], ["doc_id", "content", "begin", "end", "license", "saving", "n_words", "differences"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("content"), F.col(text_col).alias("text"))
    # most texts have no mark at all and never leave the JVM
    rows = rows.where(F.col("text").rlike(_MAYBE))
    return rows.mapInArrow(run, "doc_id long, content long, begin int, end int, license string, saving double, n_words int, differences array<string>")


def licensed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per document with a confirmed block: doc_id, license (of the block that saves most, then the first), n_blocks, best_saving, n_differences (of that block)."""
    blocks = license_blocks(docs, id_col, text_col, templates).withColumn("o", F.struct(-F.col("saving"), F.col("begin"), F.col("license")))
    return blocks.groupBy("doc_id", "content").agg(
        F.min_by("license", "o").alias("license"), F.countDistinct("begin").alias("n_blocks"),
        F.max("saving").alias("best_saving"), F.min_by(F.size("differences"), "o").alias("n_differences"),
    ).drop("content")
