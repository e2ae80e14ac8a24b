"""Operator 4 (native): licence scan by canonical digests.

A text's canonical form has A-Z in lower case, no copyright lines, one space
for every run of characters other than letters and digits, and one spelling of
words that have several.  Its SHA-256 is looked up among the digests of the
known texts (``KNOWN``), which go through the same expressions.  Two scopes are
looked up: the whole text, and each line of it that has one of the words of
``NOTICE_WORDS`` (every known text has one, so no other line can match).

Everything is DataFrame expressions.  The known texts are a fixed list of this
module, a few kilobytes, so they are broadcast; the texts are digested where
they are read and only matching notices are shuffled.

Cases: a null or empty text has the digest of the empty text and no licence;
rows of one doc_id share their notices, null ids among each other; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence texts and notices, without their copyright lines.
_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = f"{_PERMISSION}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS}"
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.\n\n"
)
_BSD_3RD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_TAIL = (
    ".\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment "
    "in the product documentation would be appreciated but is not required.\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution."
)
_APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n"
    "http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_CC_NAMES = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_CC_REGION = {"4.0": ("", " International"), "3.0": ("", " Unported"), "2.5": ("", " Generic"), "2.0": ("", " Generic"), "1.0": ("", " Generic")}


def _creative_commons() -> tuple[tuple[str, str], ...]:
    """Notices of the Creative Commons licences, in short and long spellings."""
    found = []
    for (short, long), (version, regions) in itertools.product(_CC_NAMES.items(), _CC_REGION.items()):
        longs = {long, long.replace("NoDerivatives", "NoDerivs")}
        names = [f"CC {short} {version}", f"Creative Commons {short} {version}", *(f"{cc} {name} {version}{region}" for cc in ("CC", "Creative Commons") for name in sorted(longs) for region in regions)]
        for start, article, name, end in itertools.product(("Licensed under", "Released under", "This work is licensed under"), ("", "a ", "the "), names, ("", " License")):
            found.append((f"CC-{short}-{version}", f"{start} {article}{name}{end}."))
    return tuple(found)


#: (licence, text): known whole texts.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", f"MIT License\n\n{_MIT}"),
    ("MIT", f"The MIT License (MIT)\n\n{_MIT}"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_HEAD}{_BSD_TAIL}"),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_3RD + _BSD_TAIL),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_HEAD}{_BSD_3RD}{_BSD_TAIL}"),
    ("ISC", _ISC + _ISC_NOTICE + _ISC_TAIL),
    ("ISC", f"ISC License\n\n{_ISC}{_ISC_NOTICE}{_ISC_TAIL}"),
    ("0BSD", _ISC + _ISC_TAIL),
    ("0BSD", f"BSD Zero Clause License\n\n{_ISC}{_ISC_TAIL}"),
    ("Zlib", _ZLIB),
    ("Zlib", f"zlib License\n\n{_ZLIB}"),
    ("Apache-2.0", _APACHE_NOTICE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    *_creative_commons(),
)
#: (licence, digest) of the canonical forms of standard texts that are too long to stand here, with and without what follows their terms.
KNOWN_DIGESTS = (
    ("Apache-2.0", "d5b6708487fbbbf89cc5abdd972838249d3265d5241105b6bacda1706c4068e6"),
    ("Apache-2.0", "eb436bc873ed1f340784636aa1574ba49c1eaf6a89f2de4eb044f6cfd8c89660"),
    ("Apache-2.0", "f2d7b2c77869a6d9cc2f70ffcc26690237b2cb960366ab506d5d212859dab5e8"),
    ("CC0-1.0", "3e6e368fd02abd67188d1bf25b196ac79f5782b2079e9579134c5e3f71f9ab74"),
    ("GPL-1.0", "3b7c00b08d5c6de2349faf7a31bb6e49ff8a2273a7cfdd16f96859720b00d9ef"),
    ("GPL-1.0", "b5bd3889f3288309a0cfa3c8da4c6abe71e7af97975f7eaa0093fdfc8994be7a"),
    ("GPL-1.0", "f4d5622e8488e9135bbad4562a4dddb47eb06044ce19b0c0d2064503f5933de5"),
    ("GPL-2.0", "9aae015a6322bbdec1a61c624a33b2c7d3b56283db1642e6e18d7820d4957b61"),
    ("GPL-2.0", "46f90fb5923e11bc5b072f6872fe391adbc25dd2046a33fe66ac15c717f3517f"),
    ("GPL-2.0", "3c9f4977ae65ec51dce2737640196c8c2d45aa4ba394ba71168fae3b8a4cc93f"),
    ("GPL-3.0", "ab75edbf73a72121bdba9fb3af792f1b33a1533edb22a286043c7478d958ee63"),
    ("GPL-3.0", "364b9ec532739b053b76aadd8eff2901d097a9b32b2c3b38b47f954a5b5e96b2"),
    ("GPL-3.0", "5d527914d4539f34149cd198edb1e5de52322047d37781b3bd66403f12dc40e1"),
    ("LGPL-2.0", "2f0a8618627c179dd830ddb8fa74635ae037468a5880f3b46a73915ae1990c24"),
    ("LGPL-2.0", "9d13cf53bf2cbeca5b76fbf2816c49e4187ffde010c14909d506a84660773425"),
    ("LGPL-2.0", "d449b5d838ee652333de62d88304ddcf67663cda782f1c7257ee9c9dae33dfb4"),
    ("LGPL-2.1", "56d21d93f6012cbd7f1195b72528da245ccf843598ff833a87101eb36863f95b"),
    ("LGPL-2.1", "d203bc167b87a561b06e0875df37e31508f1030f0b6c56bbfabc2f16acce8c65"),
    ("LGPL-2.1", "a7bd7bcc6f59de5c915482fc3cacdd5a1b6b27c24354df724c2ef3672dce9475"),
    ("LGPL-3.0", "f0cae4b317f4f263dca8e79625f8d9c7618c87e0ca6665c79b0f1c12ac856938"),
    ("MPL-1.1", "724757714a8157908a4262d37330f3ac617800181f14c5bb7ae1773611ef1af5"),
    ("MPL-2.0", "7eb42cd7f8edde0699d303a531b8d604a4370bd579346f5e1d615398ffe83791"),
    ("GFDL-1.2", "763fd67087ee54c1928a00c7e66bd59138dfa48fb7cf636fe42a828b1c489bcd"),
    ("GFDL-1.3", "d76fb8c45f11b761aa1870334672b79fa828bbbd142bbd27f820e7f118b97ad6"),
)
#: (spelling, canonical spelling) of words, between spaces.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("organisation", "organization"),
    ("recognised", "recognized"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
)
#: Words of which every known text has one.
NOTICE_WORDS = "[Ll][Ii][Cc][Ee][Nn][CcSs][Ee]|[Pp][Ee][Rr][Mm][Ii][Ss][Ss][Ii][Oo][Nn]|[Rr][Ee][Dd][Ii][Ss][Tt][Rr][Ii][Bb][Uu][Tt][Ii][Oo][Nn]|[Rr][Ee][Ll][Ee][Aa][Ss][Ee][Dd]"
COPYRIGHT_LINE = r"\n[ \t#*/;-]*(copyright[ \t]*(\(c\)|©|[0-9<\[{])|\(c\)[ \t]*[0-9<\[{]|©|all rights reserved)[^\n]*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """The canonical form: words with one space before, between and behind them. While spellings are replaced each word has spaces of its own."""
    text = F.concat(F.lit("\n"), F.translate(text, _UPPER, _LOWER))
    text = F.regexp_replace(text, COPYRIGHT_LINE, "\n")
    text = F.concat(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for spelling, usual in SPELLINGS:
        text = F.replace(text, F.lit(f" {spelling.replace(' ', '  ')} "), F.lit(f" {usual.replace(' ', '  ')} "))
    return F.regexp_replace(text, " +", " ")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(docs: DataFrame) -> DataFrame:
    known = docs.sparkSession.createDataFrame(list(KNOWN), "license string, text string")
    known = known.select("license", digest(F.col("text")).alias("digest"))
    known = known.unionByName(docs.sparkSession.createDataFrame(list(KNOWN_DIGESTS), "license string, digest string"))
    return known.groupBy("digest").agg(F.min("license").alias("license"))


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``digest``, ``license`` of the whole text (or null) and ``notices`` (licences of lines, with commas, or null)."""
    known = known_digests(docs)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    lines = texts.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike(NOTICE_WORDS))
    notices = lines.select("doc_id", digest(F.col("line")).alias("digest")).join(F.broadcast(known), "digest")
    notices = notices.groupBy(F.col("doc_id").alias("of")).agg(F.concat_ws(",", F.array_sort(F.collect_set("license"))).alias("notices"))
    whole = texts.select("doc_id", digest(F.col("text")).alias("digest")).join(F.broadcast(known), "digest", "left")
    return whole.join(notices, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "digest", "license", "notices")


def oracle_sql() -> str:
    """The same scan as DuckDB SQL over ``documents``."""

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def form(column: str) -> str:
        out = f"regexp_replace(chr(10) || translate({column}, '{_UPPER}', '{_LOWER}'), {text(COPYRIGHT_LINE)}, chr(10), 'g')"
        out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' '"
        for spelling, usual in SPELLINGS:
            out = f"replace({out}, ' {spelling.replace(' ', '  ')} ', ' {usual.replace(' ', '  ')} ')"
        return f"regexp_replace({out}, ' +', ' ', 'g')"

    values = ", ".join(f"({text(name)}, {text(body)})" for name, body in KNOWN)
    digests = ", ".join(f"({text(name)}, {text(value)})" for name, value in KNOWN_DIGESTS)
    return f"""
WITH known AS (
  SELECT digest, min(license) AS license
  FROM (SELECT license, sha256({form("body")}) AS digest FROM (VALUES {values}) v(license, body) UNION ALL SELECT license, digest FROM (VALUES {digests}) w(license, digest)) GROUP BY digest),
whole AS (SELECT doc_id, sha256({form("coalesce(text, '')")}) AS digest FROM documents),
lines AS (
  SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
  WHERE regexp_matches(line, '{NOTICE_WORDS}')),
notices AS (
  SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices
  FROM (SELECT DISTINCT doc_id, license FROM (SELECT doc_id, sha256({form("line")}) AS digest FROM lines) JOIN known USING (digest)) GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.license, n.notices
FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN notices n ON w.doc_id IS NOT DISTINCT FROM n.doc_id
"""
