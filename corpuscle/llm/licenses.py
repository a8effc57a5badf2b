"""Licence texts by canonical digest.

A unit of text - the whole document, each paragraph between blank lines and each line - is brought to
a canonical form: lower case, copyright lines removed, equivalent spellings made one, and everything
but letters and digits turned to single blanks.  Its digest is joined with the digests of the known
texts below, so a unit matches only if its entire text is a known licence or notice.

The known texts are a table (license, text): by default the short fixed list below, and any larger one
(``known_files`` reads a folder of full texts) can be given.  Their digests are broadcast if their number
is checked to be small, else joined by shuffled digests; the texts of the corpus are never shuffled.

Edge cases: a unit that is a known text of several licences is reported for each; very long texts are
digested whole; null and empty texts, and texts that are nothing but copyright lines, match nothing; a text
of one paragraph or line is reported once, for the widest unit; repeated rows are reported each;
null ids are kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence texts as published, without their copyright lines, and customary notices.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS"'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
          "and/or other materials provided with the distribution.")  # fmt: skip
_BSD_3 = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
          "without specific prior written permission.")  # fmt: skip
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
    f"included in all copies or substantial portions of the Software. {_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GNU_3 = "along with this program. If not, see <https://www.gnu.org/licenses/>."
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version "
    "{version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} {rest}"
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
    "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to "
    "the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software "
    "in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and "
    "must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either "
    "in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author "
    "or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large "
    "and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
    "software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please "
    "refer to <https://unlicense.org>"
)
KNOWN = (
    ("MIT", _MIT),
    ("MIT", f"MIT License {_MIT}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0",
     'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
     '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations '
     "under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_TAIL}"),
    ("0BSD", f"{_ISC}. {_ISC_TAIL}"),
    ("BSD-2-Clause", f"{_BSD_HEAD} 1. {_BSD_1} 2. {_BSD_2} {_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} 1. {_BSD_1} 2. {_BSD_2} 3. {_BSD_3} {_BSD_TAIL}"),
    ("MPL-2.0",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
     "http://mozilla.org/MPL/2.0/."),
    ("GPL-3.0-or-later", _GNU.format(name="GNU General Public License", version="3", rest=_GNU_3)),
    ("AGPL-3.0-or-later", _GNU.format(name="GNU Affero General Public License", version="3", rest=_GNU_3)),
    ("LGPL-3.0-or-later", _GNU.format(name="GNU Lesser General Public License", version="3", rest=_GNU_3)),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
)
#: Spellings that count as the same, applied to lower-cased words in this order.
SPELLINGS = (
    (r"\blicence", "license"), (r"\bversion\b|\bver\b", "v"), (r"\bv (?=[0-9])", "v"), (r"\bgnu gpl\b|\bgnu general public license\b", "gpl"),
    (r"\bnon commercial\b|\bnoncommercial\b", "nc"), (r"\bcreative commons\b", "cc"), (r"\bnon infringement\b", "noninfringement"),
    (r"\bsub license", "sublicense"), (r"\bhttps\b", "http"), (r"\bcopyright (?:owner|holder)", "copyright holder"), (r"\band or\b", "and"),
)
#: Every text of ``KNOWN`` holds one of these, and no step of the canonical form makes one from a text without it.
MARKS = ("licen", "permission", "redistribution")
#: Most digests that are broadcast.
BROADCAST_ROWS = 100_000
COPYRIGHT_LINE = r"(?im)^[ \t/*#;%-]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty if nothing remains."""
    s = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, ""))
    s = F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "))
    for pattern, one in SPELLINGS:
        s = F.regexp_replace(s, pattern, one)
    return s


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark) -> DataFrame:
    """(license, text) of the fixed list."""
    return spark.createDataFrame(list(KNOWN), "license string, text string")


def known_files(spark, path: str) -> DataFrame:
    """(license, text) of a folder of full texts, each file named after its licence."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))
    return files.select(F.regexp_replace("name", r"\.(?:txt|md)$", "").alias("license"), "text")


def matches(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, unit, position, license): units whose entire text is a known one; unit is document, paragraph or line.

    ``texts`` (license, text) are the known texts; without it, the fixed list.
    """
    text = F.coalesce("text", F.lit(""))
    marked = lambda c: reduce(or_, [F.lower(c).contains(m) for m in MARKS])
    if texts is None:
        # Texts without any mark hold no text of the fixed list: most of a corpus is spared the canonical form.
        docs, texts, spare = docs.where(marked(text)), known(docs.sparkSession), marked
    else:
        spare = lambda c: F.col(c).rlike(r"[\p{L}\p{N}]")
    nothing = F.sha2(F.lit(""), 256)
    digests = texts.select(digest(F.col("text")).alias("digest"), "license").where(F.col("digest") != nothing).distinct()
    if digests.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        digests = F.broadcast(digests)
    unit = lambda name, parts: F.transform(parts, lambda x, i: F.struct(F.lit(name).alias("unit"), i.alias("position"), x.alias("part")))
    lines, paragraphs = F.split(text, "\n"), F.split(text, r"\n[ \t\r]*\n")
    whole = F.filter(F.array(text), lambda x: x != "")
    units = F.concat(
        unit("document", whole), F.when(F.size(paragraphs) > 1, unit("paragraph", paragraphs)).otherwise(unit("paragraph", F.slice(paragraphs, 1, 0))),
        F.when(F.size(lines) > 1, unit("line", lines)).otherwise(unit("line", F.slice(lines, 1, 0))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(units).alias("u")).select("doc_id", "u.*")
    rows = rows.where(spare("part"))
    found = rows.select("doc_id", "unit", "position", digest(F.col("part")).alias("digest")).join(digests, "digest")
    return found.select("doc_id", "unit", "position", "license")
