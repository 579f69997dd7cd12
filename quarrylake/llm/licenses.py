"""License scans: canonical digest lookup.

Texts and known licences go through the same canonical form (case, copyright lines, equivalent
spellings, punctuation, white space), and digests of whole canonical texts are joined by hash. It is
JVM-side and map-only while the licence table is small enough to broadcast; a larger one is joined by a
shuffle of the rows that some licence has, hot digests apart. Short licences are known by their text, with
usual titles and without; long ones by the digest of their published text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.llm.cluster import hot_join, hot_limit, materialise

#: (regular expression, replacement) in order, on lower-cased text; valid in Java's and RE2's syntax alike.
#: A line that is a notice: copyright with its sign, a year, a place for one, or who holds it, or only the sign, or
#: all rights reserved. Other lines that begin with the word are text.
COPYRIGHT = (
    r"(?m)^[^\p{L}\p{N}\n]*(copyright[\s:,]*(\(c\)|©|&copy;|[\[{<(]|[0-9]{4}\b|by\b|$|the\b[^\n]{1,60}\b(authors|contributors|developers|foundation|project|team)\b\.?$|[^\n]{1,60}\b(inc|ltd|llc|gmbh)\b\.?$)|\(c\)[\s,]*[0-9\p{L}]|©|&copy;|all rights reserved)[^\n]*$"
)
SPELLINGS: tuple[tuple[str, str], ...] = (
    (r"\b(sub|non)[-‐‑ ](licen|commercial)", "$1$2"),
    (r"\b(un|re|sub)?licence(s|d|e|es|r|rs)?\b", "$1license$2"),
    (r"\b(author|organ|recogn|util|initial|maxim|optim|categor|capital|custom|serial|summar)is(e|ed|es|ing|ation|ations)\b", "$1iz$2"),
    (r"\b(analog|catalog)ue(s|d)?\b", "$1$2"),
    (r"\b(behavi|col|fav|lab|hon)our(s|ed|able|ite)?\b", "$1or$2"),
    (r"\b(acknowledg|judg)ement(s)?\b", "$1ment$2"),
    (r"\bfulfil(s|ment)?\b", "fulfill$1"),
    (r"\b(model|label|signal|cancel)l(ed|ing)\b", "$1$2"),
    (r"\b(of|def)fence(s)?\b", "$1fense$2"),
    (r"\bwhilst\b", "while"),
    (r"\bwilful(l?y)?\b", "willful$1"),
    (r"\bper ?cent\b", "percent"),
    (r"\bcopyright owner(s)?\b", "copyright holder$1"),
    (r"\bhttps?://", "http "),
)
_SPELLED = r"licence|is(e|ed|es|ing|ation|ations)\b|ogue|our(s|ed|able|ite)?\b|gement|fulfil|ll(ed|ing)\b|fence|whilst|wilful|cent\b|owner|https?://|(sub|non)[-‐‑ ]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞĄĆČĎĐĘĚŁŃŇŒŘŚŠŤŮŹŻŽΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"
_LOWER = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþąćčďđęěłńňœřśšťůźżžαβγδεζηθικλμνξοπρστυφχψωабвгдеёжзийклмнопрстуфхцчшщъыьэюя"

#: Whole texts of well-known licences and of one-line notices.
LICENSES: dict[str, str] = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
}
LICENSES["BSD-3-Clause"] = LICENSES["BSD-2-Clause"].replace(
    "\n\nTHIS SOFTWARE",
    "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE",
)

#: Titles that stand before a body in usual files; each is a known text with it and without.
TITLES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"),
    "MIT-0": ("MIT No Attribution", "MIT-0"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD-3-Clause"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License, Version 1.0"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: SHA-256 of the canonical forms of long licences' published texts; "-terms" without what follows the terms.
DIGESTS: dict[str, str] = {
    "Apache-2.0": "4580e5390400d27df89edd0617548ac0e66eaa029f6e07cf98aac9cd100b3a37",
    "Apache-2.0-terms": "0b8c1a9e0ec99ab3b27e123e667fe4843df4dd7e6c667ccdc634dd6878c5dd6c",
    "Artistic-1.0-Perl": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b",
    "GFDL-1.3": "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-1.0-terms": "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-2.0-terms": "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
    "GPL-3.0": "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    "GPL-3.0-terms": "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.0-terms": "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-2.1-terms": "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61",
    "MPL-2.0": "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",
    "MPL-2.0-terms": "2cec6f733aa157c2d0b72e9669f75ca354f332218fcb5a3a885931f385272a04",
}


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text) of all forms that are known by their text."""
    return sorted([*LICENSES.items(), *((k, f"{title}\n\n{LICENSES[k]}") for k, titles in TITLES.items() for title in titles)])


def canonical(text: Column) -> Column:
    """The canonical form: lower case, no copyright lines, one spelling, words joined by single spaces."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    bare = F.when(lower.rlike(r"copyright|\(c\)|©|all rights"), F.regexp_replace(lower, COPYRIGHT, "")).otherwise(lower)
    spelled = bare
    for pattern, to in SPELLINGS:
        spelled = F.regexp_replace(spelled, pattern, to)
    spelled = F.when(bare.rlike(_SPELLED), spelled).otherwise(bare)
    return F.trim(F.regexp_replace(spelled, r"[^\p{L}\p{N}]+", " "))


def license_table(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license_id, text, digest) of known licences: a text, or the digest of its canonical form; of ``texts`` alone, if given."""
    rows = [(k, t, None) for k, t in (sorted(texts.items()) if texts else known_texts())]
    rows += [] if texts else [(k, None, d) for k, d in sorted(DIGESTS.items())]
    return spark.createDataFrame(rows, "license_id string, text string, digest string")


#: Known digests (some 100 bytes each) up to which they are broadcast.
FEW_DIGESTS = 200_000


def license_scan(docs: DataFrame, licenses: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", few: int = FEW_DIGESTS) -> DataFrame:
    """Find the documents that are, as a whole, the text of a known licence.

    Returns per row doc_id, digest (SHA-256 of the canonical text; null if nothing but punctuation and
    copyright notices is left, or the text is null), license_id (null if unknown) and is_license. Of
    licences with one canonical text the smallest id counts; an empty one matches nothing. Very long texts
    are digested whole; repeated rows and null ids are kept as they are; an empty table gives no rows, an
    empty list of licences no licence; columns other than the two, whatever their names, are not read.

    Up to ``few`` digests are broadcast, so no document moves, whatever digest many share. Beyond that
    only rows whose digest some licence has are joined by a shuffle; which have one is told by digests
    counted first, so neither nulls nor a text that many rows hold gather in one task.
    """
    digest = lambda text: F.when(text != "", F.sha2(text, 256))
    has = "digest" in licenses.columns
    known = licenses.select("license_id", canonical(F.col("text")).alias("c"), (F.col("digest") if has else F.lit(None).cast("string")).alias("given"))
    known = known.select("license_id", F.coalesce("given", digest(F.col("c"))).alias("digest")).where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    rows = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col)).alias("c")).select("doc_id", digest(F.col("c")).alias("digest"))
    if known.limit(few + 1).count() <= few:
        named = rows.join(F.broadcast(known), "digest", "left")
    else:
        rows = materialise(rows, "digests")
        counts = rows.where("digest is not null").groupBy("digest").count()
        hits = materialise(known.join(counts, "digest"), "hits")
        n = rows.count()
        found = hot_join(rows.where("digest is not null"), hits, "digest", "count", n)
        without = rows.where("digest is null").unionByName(_without(rows.where("digest is not null"), hits, hot_limit(n)))
        named = found.select("digest", "doc_id", "license_id").unionByName(without.select("digest", "doc_id", F.lit(None).cast("string").alias("license_id")))
    return named.select("doc_id", "digest", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def _without(rows: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """Rows whose digest isn't among ``hits``: hot ones go by a broadcast of few digests, the others by a shuffle."""
    hot = hits.where(F.col("count") > limit).select("digest")
    return rows.join(F.broadcast(hot), "digest", "left_anti").join(hits.where(F.col("count") <= limit).select("digest"), "digest", "left_anti")


def oracle() -> str:
    """The same in DuckDB SQL, from the same licence texts and spelling table."""

    def form(text: str) -> str:
        lower = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
        sql = f"regexp_replace({lower}, '{COPYRIGHT}', '', 'g')"
        for pattern, to in SPELLINGS:
            sql = f"regexp_replace({sql}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
        return f"trim(regexp_replace({sql}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    values = ", ".join(f"('{k}', '{t.replace(chr(39), chr(39) * 2)}')" for k, t in known_texts())
    digests = ", ".join(f"('{k}', '{d}')" for k, d in sorted(DIGESTS.items()))
    return f"""
WITH known AS (
  SELECT digest, min(license_id) AS license_id FROM (
    SELECT license_id, sha256(c) AS digest FROM (SELECT license_id, {form('t')} AS c FROM (VALUES {values}) v(license_id, t)) WHERE c <> ''
    UNION ALL SELECT license_id, digest FROM (VALUES {digests}) w(license_id, digest))
  GROUP BY digest
), rows_ AS (
  SELECT doc_id, CASE WHEN c <> '' THEN sha256(c) END AS digest FROM (SELECT doc_id, {form('text')} AS c FROM documents)
)
SELECT r.doc_id, r.digest, k.license_id, k.license_id IS NOT NULL AS is_license FROM rows_ r LEFT JOIN known k ON r.digest = k.digest
"""
