"""Licence scan by canonical digests of entire texts (DataFrame functions only)."""

from __future__ import annotations

import re
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Licences by SPDX identifier, with the names that notices use.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache 2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL v3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPL v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL v3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL v3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "Unlicense": ["Unlicense"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}

#: How notices begin and end around a name.
OPENINGS = ["", "This work is", "This document is", "This text is", "This project is", "This software is", "This file is", "This content is", "This page is"]
VERBS = ["licensed under", "released under", "distributed under", "available under", "published under", "provided under"]
ENDINGS = ["", "terms of"]

#: Entire texts of short licences, without their copyright lines.
TEXTS = {
    "MIT": """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}

#: Further entire texts and standard headers, a paragraph a line.
FURTHER = [
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
]

#: Characters and SHA-256 of the canonical forms of long entire texts, as
#: /usr/share/common-licenses of Debian has them (tested where it is there).
LONG = [
    ("Apache-2.0", 9656, "eb65577836dbaf6fc668c3205eab43d61653a725981c74eb4ce26564e0f34ad9"),  # Apache-2.0
    ("Apache-2.0", 8661, "58ba8abc38ad338c3ae494edd8e957cc5924e17885bbeaa3efacf2df69b8c5df"),  # Apache-2.0 without its appendix
    ("GPL-2.0", 17001, "0886c6867cd449196ab18341affc35dce094b9c8b7fa64ba1b034de78e97c5fa"),  # GPL-2
    ("GPL-2.0", 14387, "b2a57a5fd724e6dd823efd60cbba664854088650079e80e36d84f58378921420"),  # GPL-2 without its appendix
    ("GPL-3.0", 33195, "53b811382786d36aeea283f3a0c23e66918762db63c1b606caad95f455c54c0d"),  # GPL-3
    ("GPL-3.0", 33187, "6937d0a59d66957df3ae42f2c63332d8db89d35e71557237106cb4c731838755"),  # GPL-3, as one unit
    ("GPL-3.0", 30796, "1e66dbdb6740c94625f288cddc2fe20286594aec12ea23efc5c841818a52a3d1"),  # GPL-3 without its appendix
    ("GPL-3.0", 30788, "d091bcb3d45f5af49fdf00567740ca4929da8329d996d9f6733470b86b8a7bb1"),  # GPL-3 without its appendix, as one unit
    ("LGPL-2.1", 25010, "29a188aa29f9f8808d3b12bc64ceff346242ce6cf89e584a858434e15254ce09"),  # LGPL-2.1
    ("LGPL-2.1", 23170, "26d04a241c815485612ce53f4565e20b4a53eecd29604597defc21a62fd94ade"),  # LGPL-2.1 without its appendix
    ("LGPL-3.0", 7064, "e508910e034398c9b08367ac47088b1a0416883f955ba95f6b0c2b01ac293de1"),  # LGPL-3
    ("MPL-2.0", 14214, "08c2872fe25b784426e6ff475c02d20c582462e52c619b7b4cbe719c189ca2e3"),  # MPL-2.0
    ("MPL-2.0", 14198, "168829043786a6e7b444b1f65fb506092b310de7ec0c142fafaa6e6cef0aa0fe"),  # MPL-2.0, as one unit
    ("MPL-2.0", 13545, "87ee14d3bf99df59912f27fc9e4d8c6778b536c5612372bfffb47b986d31881d"),  # MPL-2.0 without its appendix
    ("MPL-2.0", 13529, "5eabc95a4fa869147f937a47465008cf9ab3923e9137b4480f38eba819dd9a0c"),  # MPL-2.0 without its appendix, as one unit
    ("CC0-1.0", 6677, "ef4a33a6c8fffde59430b6e2161bee2ed6c65a3881aa24efa5378f7f61eb0869"),  # CC0-1.0
]

#: What the scan looks at closely: every known text holds one of these (tested).
ANCHOR = (
    "(?i)licen[cs]|spdx|permission|redistribution|public domain|without any express or implied warranty"
    "|(released|distributed|available|published|provided)[^0-9a-z]+under"
)

#: Canonical form of a lower-cased text, step by step; patterns mean the same in Java,
#: Python and RE2. Copyright lines go first, while there are lines.
STEPS = [
    (r"(^|\n)[^\n0-9a-z]*(copyright |copyright$|\(c\)|©|all rights reserved)[^\n]*", r"\1"),
    (r"&", " and "),
    (r"licence", "license"),
    (r"https?://(www\.)?", " "),
    (r"[^0-9a-z.]+", " "),
    (r"\.( |$)", " "),
    (r"\.( |$)", " "),
    (r" and or ", " or "),
    (r"(^| )sub license", r"\1sublicense"),
    (r"(^| )non (commercial|infringement)", r"\1non\2"),
    (r"(^| )acknowledgement", r"\1acknowledgment"),
    (r"(^| )recognise", r"\1recognize"),
    (r"(^| )(version |v)([0-9])", r"\1\3"),
    (r"(^| )([0-9]+)\.0( |$)", r"\1\2\3"),
    (r" +", " "),
    (r"^ | $", ""),
]


#: A copyright statement with a notice behind it on its line: only the statement goes.
STATEMENT = (
    r"(^|\n)[^\n0-9a-z]*(copyright |\(c\)|©|all rights reserved)[^\n]*?[^\n0-9a-z](?=(this [a-z]+ is )?(licensed|released|distributed|available|published|provided) under |spdx-license-identifier)"
)


def canonical_text(text: str) -> str:
    text = text.lower()
    for pattern, new in STEPS:
        text = re.sub(pattern, new, text)
    return text


def canonical(text: Column) -> Column:
    out = F.lower(text)
    for pattern, new in STEPS:
        out = F.regexp_replace(out, pattern, new.replace("\\", "$"))
    return out


def known_digests() -> dict[str, str]:
    """SHA-256 of each known canonical text, with the licence it is."""
    found: dict[str, str] = {}
    for spdx, text in TEXTS.items():
        for whole in (text, text.split("\n", 1)[1] if text.split("\n", 1)[0].endswith(" License") else text):
            found[canonical_text(whole)] = spdx
    for spdx, names in NAMES.items():
        found[canonical_text(f"SPDX-License-Identifier: {spdx}")] = spdx
        for name in names:
            for article in ("", "the "):
                for license_word in ("", " license"):
                    if license_word and "License" in name:
                        continue
                    for opening in OPENINGS:
                        for verb in VERBS:
                            for ending in ENDINGS:
                                if ending and not article:
                                    continue
                                words = [opening, verb, "the " + ending if ending else "", article + name + license_word]
                                found[canonical_text(" ".join(w for w in words if w))] = spdx
    return {sha256(text.encode()).hexdigest(): spdx for text, spdx in found.items()}


def whole_texts() -> dict[str, tuple[str, int]]:
    """SHA-256 of the canonical form of each entire text and header, with its licence and
    its characters."""
    found = {digest: (spdx, size) for spdx, size, digest in LONG}
    for spdx, text in [*TEXTS.items(), *FURTHER]:
        first, _, rest = text.partition("\n")
        bare = [rest] if re.search("License$|Version 1.0|Clause", first) else []
        titles = [f"{name}\n{x}" for name in NAMES.get(spdx, []) if "License" in name for x in bare or [text]]
        for whole in (text, *bare, *([] if (spdx, text) in FURTHER[2:] else titles)):
            clean = " ".join(x for x in map(canonical_text, whole.split("\n")) if x)
            found[sha256(clean.encode()).hexdigest()] = (spdx, len(clean))
    return found


def known_licenses(spark: SparkSession) -> DataFrame:
    known = known_digests() | {digest: spdx for digest, (spdx, _) in whole_texts().items()}
    rows = ", ".join(f"('{digest}', '{spdx}')" for digest, spdx in sorted(known.items()))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(digest, license)")


def _held(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Columns that later ones read as values: an explode keeps Spark from putting their
    expressions into each place that names them."""
    row = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("__row")
    return df.select(*keep, row).select(*keep, *[F.col(f"__row.{k}").alias(k) for k in columns])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every entire text that is a known licence or licence notice.

    Texts are the document as a whole, its paragraphs (parted by blank lines) where it
    has several, its lines where they outnumber its paragraphs, and runs of consecutive
    paragraphs that are as long as a known entire text, without runs inside others and
    where the document itself is none. Each is brought to its
    canonical form, digested, and joined by digest with the known ones, whose number
    is fixed. Columns: the id, ``scope`` ('document', 'paragraph', 'line' or 'run'), ``place``
    (number of the paragraph or line from 0, of a run's first paragraph; 0 for a document),
    ``license`` (SPDX), ``digest``. No rows are exchanged: the known digests go to the texts.

    Null, empty and blank texts match nothing; a null id stays; repeated rows match each;
    an empty table gives no rows; other columns are ignored.
    """
    known = F.broadcast(known_licenses(docs.sparkSession))
    whole_known = whole_texts()
    text = F.regexp_replace(F.col(text_col), "\r\n?", "\n")
    doc = docs.select(F.col(id_col).alias("id"), text.alias("text")).filter(F.col("text").rlike(ANCHOR))
    paragraphs, lines = F.split("text", r"\n[ \t]*\n\s*", -1), F.split("text", "\n", -1)

    def units(scope: str, parts: Column, other: Column) -> Column:
        numbered = F.transform(parts, lambda x, i: F.struct(F.lit(scope).alias("scope"), i.cast("int").alias("place"), x.alias("unit")))
        wanted = F.filter(numbered, lambda u: u["unit"].rlike(ANCHOR))
        return F.when(F.size(parts) > F.size(other), wanted).otherwise(F.slice(wanted, 1, 0))

    whole = F.array(F.struct(F.lit("document").alias("scope"), F.lit(0).alias("place"), F.col("text").alias("unit")))
    parts = F.concat(whole, units("paragraph", paragraphs, whole), units("line", lines, paragraphs))
    unit = F.lower("u.unit")
    forms = F.when(unit.rlike(STATEMENT), F.array(unit, F.regexp_replace(unit, STATEMENT, "$1"))).otherwise(F.array(unit))
    each = doc.select("id", F.explode(parts).alias("u")).select("id", "u.scope", "u.place", F.explode(forms).alias("form"))
    each = each.select("id", "scope", "place", F.sha2(canonical(F.col("form")), 256).alias("digest"))

    # Runs: only those as long as a known text are digested. ends[i]: characters of the first
    # i paragraphs, one more each for what parts them.
    sizes = F.array(*[F.lit(n) for n in sorted({n for _, n in whole_known.values()})])
    clean = F.filter(F.transform(paragraphs, lambda x, i: F.struct(i.cast("int").alias("place"), canonical(x).alias("form"))), lambda x: x["form"] != "")
    several = _held(doc.filter(F.size(paragraphs) > 1), ["id", "text"], c=clean).filter(F.size("c") > 1)
    ends = F.aggregate(F.transform("c", lambda x: F.length(x["form"]) + 1), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    several = _held(several, ["id", "text", "c"], ends=ends, i=F.sequence(F.lit(0), F.size("c") - 1))

    def of_start(i: Column) -> Column:
        stops = F.transform(sizes, lambda n: F.struct(i.alias("i"), (F.array_position("ends", F.get("ends", i) + n + 1) - 1).cast("int").alias("end")))
        return F.filter(stops, lambda x: x["end"] - x["i"] >= 2)

    def digested(x: Column) -> Column:
        forms = F.transform(F.slice("c", x["i"] + 1, x["end"] - x["i"]), lambda y: y["form"])
        return F.struct(x["i"].alias("i"), x["end"].alias("end"), F.get("c", x["i"])["place"].alias("place"), F.sha2(F.array_join(forms, " "), 256).alias("digest"))

    several = _held(several, ["id", "text", "c"], tried=F.flatten(F.transform("i", of_start))).filter(F.size("tried") > 0)
    several = _held(several, ["id", "text"], tried=F.transform("tried", digested))
    several = _held(several, ["id", "text"], runs=F.filter("tried", lambda x: x["digest"].isin(*whole_known))).filter(F.size("runs") > 0)
    several = several.filter(~F.sha2(canonical(F.col("text")), 256).isin(*whole_known))

    def inside(x: Column, y: Column) -> Column:
        return (y["i"] <= x["i"]) & (y["end"] >= x["end"]) & (y["end"] - y["i"] > x["end"] - x["i"])

    outer = F.filter("runs", lambda x: ~F.exists("runs", lambda y: inside(x, y)))
    runs = several.select("id", F.explode(outer).alias("r")).select("id", F.lit("run").alias("scope"), "r.place", "r.digest")
    found = each.union(runs)
    return found.join(known, "digest").select(F.col("id").alias(id_col), "scope", "place", "license", "digest")


def scan_sql() -> str:
    """The same scan in DuckDB's SQL."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    canon = "lower(unit)"
    for pattern, new in STEPS:
        spelled = quoted(pattern).replace("\\n", "' || chr(10) || '")
        canon = f"regexp_replace({canon}, {spelled}, {quoted(new)}, 'g')"
    rows = ", ".join(f"('{digest}', '{spdx}')" for digest, spdx in sorted(known_digests().items()))
    anchor = quoted(ANCHOR)
    return f"""
WITH known(digest, license) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM documents),
p AS (SELECT doc_id, text, regexp_split_to_array(text, '\\n[ \\t]*\\n\\s*') AS paragraphs, string_split(text, chr(10)) AS lines
      FROM d WHERE regexp_matches(text, {anchor})),
u AS (SELECT doc_id, 'document' AS scope, 0 AS place, text AS unit FROM p
      UNION ALL SELECT doc_id, 'paragraph', CAST(i - 1 AS INTEGER), paragraphs[i]
      FROM (SELECT *, unnest(range(1, len(paragraphs) + 1)) AS i FROM p WHERE len(paragraphs) > 1)
      UNION ALL SELECT doc_id, 'line', CAST(i - 1 AS INTEGER), lines[i]
      FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM p WHERE len(lines) > len(paragraphs))),
c AS (SELECT doc_id, scope, place, sha256({canon}) AS digest FROM u WHERE regexp_matches(unit, {anchor}))
SELECT doc_id, scope, place, license, digest FROM c JOIN known USING (digest)
"""
