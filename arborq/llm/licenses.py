"""Licence scan by canonical digests, in Spark expressions only.

A text is normalised (case, spelling variants, copyright notices, punctuation, white space) and its SHA-256
is looked up among the digests of known licence texts. The units looked up are the whole document, each
of its paragraphs (parted by blank lines) and lines, and each run of up to RUN paragraphs, every one as an entire text.
Only units as long as a known text are digested.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.llm.common import table

# Licence texts and standard notices, as published by their stewards.
_MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_ISC_BODY = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
    "USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.\n\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING "
    "IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
    "with the License. You may obtain a copy of the License at\n\n"
    "http://www.apache.org/licenses/LICENSE-2.0\n\n"
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
    'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
    "the specific language governing permissions and limitations under the License."
)
_BSD_BULLETS = _BSD_HEAD.replace("1. ", "* ").replace("2. ", "* ")
_BSD_THIRD_BULLET = _BSD_THIRD.replace("3. ", "* ")
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
    "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
    "interest in the software to the public domain. We make this dedication for the benefit of the public at large and to "
    "the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
    "perpetuity of all present and future rights to this software under copyright law.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
    "liable for any damages arising from the use of this software.\n\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
    "alter it and redistribute it freely, subject to the following restrictions:\n\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
    "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is "
    "not required.\n\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
    "software.\n\n"
    "3. This notice may not be removed or altered from any source distribution."
)
_WTFPL = (
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION "
    "0. You just DO WHAT THE FUCK YOU WANT TO."
)
LICENSES: list[tuple[str, str]] = [
    ("MIT", _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_BODY),
    ("MIT", "MIT License\n\n" + _MIT_BODY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC_BODY),
    ("ISC", "ISC License\n\n" + _ISC_BODY),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-2-Clause", _BSD_BULLETS + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_BULLETS + _BSD_THIRD_BULLET + _BSD_TAIL),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <http://unlicense.org/>"),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Apache-2.0", _APACHE_HEADER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("WTFPL", _WTFPL),
]

# Licences known by the length and the digest of their whole canonical text, with and without what follows their terms.
WHOLE: list[tuple[str, int, str]] = [
    ("Apache-2.0", 9882, "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Apache-2.0", 8866, "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Apache-2.0", 8838, "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a"),
    ("Artistic-1.0-Perl", 5833, "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", 19583, "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", 22018, "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", 11765, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", 9415, "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", 9387, "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-2.0", 17117, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", 14483, "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", 14455, "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-3.0", 33406, "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", 30968, "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", 30940, "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("LGPL-2.0", 24130, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", 22277, "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", 22249, "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.1", 25217, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", 23365, "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", 23337, "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 22447, "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", 14341, "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]

# Equivalent spellings, each written first as met and then as kept.
SPELLINGS: list[tuple[str, str]] = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licencing", "licensing"),
    ("sublicence", "sublicense"),
    ("noninfringment", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("labour", "labor"),
    ("https", "http"),
    ("all rights reserved", ""),
]
# A line is a copyright notice if a sign, a year, a placeholder or a holder after "by" or a colon follows the word.
_COPYRIGHT_LINE = r"(^|\n)[ \t*#/;]*(copyright[ ,]*(\(c\)|©|[0-9<\[{]|:|by )|©|\(c\)[ ,]*(copyright|[0-9<\[{]))[^\n]*"
RUN = 8
_WORDS = r"[^0-9a-z\n]+"


def normalised(text: Column) -> Column:
    """Canonical form: lower case, no copyright lines, runs of other than a-z, 0-9 as one space, one spelling.

    Line ends stay, so that it can be cut into lines after one pass; `joined` makes them spaces.
    """
    out = F.regexp_replace(F.lower(text), "\r\n?", "\n")
    out = F.regexp_replace(out, _COPYRIGHT_LINE, "$1")
    out = F.regexp_replace(out, _WORDS, " ")
    for met, kept in SPELLINGS:
        out = F.replace(out, F.lit(met), F.lit(kept))
    return out


def joined(canonical: Column) -> Column:
    return F.trim(F.regexp_replace(canonical, r"[ \n]+", " "))


def digest_table(spark: SparkSession, licenses: list[tuple[str, str]] | None = None, whole: list[tuple[str, int, str]] | None = None) -> DataFrame:
    """(digest, license, size) of the known texts and of WHOLE; each digest once, the first name given to it."""
    texts = licenses if licenses is not None else LICENSES
    known = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(texts)], "i int, license string, body string")
    canonical = joined(normalised(F.col("body")))
    given = spark.createDataFrame([(len(texts) + i, *w) for i, w in enumerate(WHOLE if whole is None else whole)], "i int, license string, size int, digest string")
    both = known.select("i", "license", F.length(canonical).alias("size"), F.sha2(canonical, 256).alias("digest")).unionByName(given)
    return both.groupBy("digest").agg(F.min_by("license", "i").alias("license"), F.min("size").alias("size"))


def _runs(n: int, fits: Callable[[Column], Column]) -> Column:
    """Runs of n of the `parts` whose length, from the parts' `lengths`, fits."""
    firsts = F.when(F.size("parts") >= n, F.sequence(F.lit(1), F.size("parts") - (n - 1))).otherwise(F.array().cast("array<int>"))
    length = lambda i: F.aggregate(F.slice("lengths", i, F.lit(n)), F.lit(n - 1), lambda a, x: a + x)
    return F.transform(F.filter(firsts, lambda i: fits(length(i))), lambda i: F.array_join(F.slice("parts", i, F.lit(n)), " "))


def _digested(units: Column, entire: bool) -> Column:
    return F.transform(units, lambda x: F.struct(F.lit(entire).alias("entire"), F.sha2(x, 256).alias("digest")))


def scan_licenses(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per key: doc_id, n_units (units that match), whole (the entire text is a licence), licenses (sorted).

    `known` is a table of known texts (digest, license, size), of a few thousand rows at most, as its sizes are part of the plan.
    Null and empty texts match nothing; rows that repeat a key count as one document; a licence met often
    is listed once. Units that differ only in what is normalised have the same digest. An empty table gives an empty result.
    """
    sizes = sorted({r["size"] for r in known.select("size").distinct().collect()})
    fits = lambda n: n.isin(*sizes) if sizes else F.lit(False)
    canonical = normalised(F.coalesce(F.col(text), F.lit("")))
    body = docs.select(F.col(key).alias("doc_id"), canonical.alias("c"))
    kept = lambda parts: F.filter(F.transform(parts, joined), lambda x: x != "")
    none = F.array().cast("array<string>")
    body = body.select(
        "doc_id", joined(F.col("c")).alias("all"), F.when(F.col("c").contains("\n"), kept(F.split("c", r"\n"))).otherwise(none).alias("lines"),
        F.when(F.col("c").rlike(r"\n *\n"), kept(F.split("c", r"\n *\n[ \n]*"))).otherwise(none).alias("parts"),
    )
    body = body.withColumn("lengths", F.transform("parts", lambda x: F.length(x)))
    fitting = lambda parts: F.filter(parts, lambda x: fits(F.length(x)))
    units = [F.filter(F.array(F.col("all")), lambda x: fits(F.length(x)) & (x != "")), fitting(F.col("lines")), fitting(F.col("parts"))]
    units += [_runs(n, fits) for n in range(2, RUN + 1)]
    marked = F.concat(*(_digested(u, k == 0) for k, u in enumerate(units)))
    each = body.select("doc_id", F.explode_outer(marked).alias("u")).select("doc_id", "u.entire", "u.digest")
    return (
        each.join(F.broadcast(known.select("digest", "license")), "digest", "left")
        .groupBy("doc_id")
        .agg(
            F.count("license").alias("n_units"),
            F.coalesce(F.bool_or(F.col("entire") & F.col("license").isNotNull()), F.lit(False)).alias("whole"),
            F.array_sort(F.collect_set("license")).alias("licenses"),
        )
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"), digest_table(spark))
    return found.select("doc_id", "n_units", "whole", F.concat_ws(",", "licenses").alias("licenses"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_normalised(x: str) -> str:
    out = f"regexp_replace(lower({x}), '\\r\\n?', chr(10), 'g')"
    out = f"regexp_replace({out}, '{_COPYRIGHT_LINE}', '\\1', 'g')"
    out = f"regexp_replace({out}, '{_WORDS}', ' ', 'g')"
    for met, kept in SPELLINGS:
        out = f"replace({out}, '{met}', '{kept}')"
    return out


_JOINED = "sha256(trim(regexp_replace(u, '[ \\n]+', ' ', 'g')))"
_RUNS = " UNION ALL ".join(f"SELECT doc_id, false, array_to_string(ps[i:i + {n - 1}], ' ') FROM (SELECT doc_id, ps, unnest(range(1, len(ps) - {n - 2})) AS i FROM parts WHERE len(ps) >= {n})" for n in range(1, RUN + 1))
OP9_SQL = f"""
WITH texts(license, body) AS (VALUES {", ".join(f"({_sql_text(n)}, {_sql_text(t)})" for n, t in LICENSES)}),
known AS (SELECT DISTINCT license, {_JOINED} AS digest FROM (SELECT license, {_sql_normalised("body")} AS u FROM texts)
  UNION SELECT * FROM (VALUES {", ".join(f"('{n}', '{d}')" for n, _, d in WHOLE)})),
body AS (SELECT doc_id, {_sql_normalised("coalesce(text, '')")} AS c FROM documents),
parts AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(c, '\\n *\\n[ \\n]*'), lambda u: trim(regexp_replace(u, '[ \\n]+', ' ', 'g'))), lambda u: u <> '') AS ps
  FROM body WHERE regexp_matches(c, '\\n *\\n')),
cut AS (
  SELECT doc_id, true AS entire, c AS u FROM body
  UNION ALL {_RUNS}
  UNION ALL SELECT doc_id, false, unnest(string_split(c, chr(10))) FROM body WHERE contains(c, chr(10))
),
units AS (SELECT doc_id, entire, {_JOINED} AS digest FROM cut)
SELECT doc_id, count(license) AS n_units, coalesce(bool_or(entire AND license IS NOT NULL), false) AS whole,
  coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses
FROM units LEFT JOIN known USING (digest) GROUP BY doc_id
"""
