"""License scans: canonical digest lookup (operator 2).

A text is lower-cased; copyright lines and list marks go; punctuation and white space become separators; equivalent
spellings become one. The SHA-256 of what stays is its canonical digest. Entire texts are hash-joined to the digests
of known licences; each line of a text is looked up in the same way as an entire text of its own, which finds
notices inside other texts.

Known are the licences of LICENSES by their texts, those of DIGESTS by the digests of their published texts, and the
notices that ``notices`` makes of licences' names. Others come as a table of license_id and text.

Edge cases: a null text counts as empty; the digest of an empty text matches nothing; texts of any length are read
whole; repeated rows each give a row; of known licences with one digest the smallest id counts, which decides ties; an
empty table gives an empty result; only the text and key columns are read, so others may have any names. Only
built-in functions are used.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import P

#: Most rows of known licences that are broadcast; with more, the join shuffles.
BROADCAST_ROWS = 10_000

# Spellings that count as equal, variant to canonical word.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "https": "http",
    "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed",
    "licences": "licenses", "licencing": "licensing", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "noncommercial": "non  commercial",
    "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while",
    "wilful": "willful",
}

# Short licences and usual notices, as published.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
LICENSES = {
    "MIT": 'MIT License\nCopyright (c) year holder\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n' + _AS_IS,
    "ISC": "ISC License\nCopyright (c) year holder\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC,
    "0BSD": "BSD Zero Clause License\nCopyright (c) year holder\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC,
    "BSD-2-Clause": "BSD 2-Clause License\nCopyright (c) year holder\n" + _BSD2 + _BSD,
    "BSD-3-Clause": "BSD 3-Clause License\nCopyright (c) year holder\n" + _BSD2 + _BSD3 + _BSD,
    "Zlib": "zlib License\nCopyright (c) year holder\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
}

# Licence names as they are usual in notices.
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3",), "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 License"), "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",), "BSL-1.0": ("Boost Software License, Version 1.0",), "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0",), "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",), "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",), "CC-BY-ND-4.0": ("CC BY-ND 4.0",), "CC-BY-SA-4.0": ("CC BY-SA 4.0",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"), "EPL-2.0": ("Eclipse Public License, version 2.0",), "GPL-2.0": ("GNU General Public License, version 2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPLv3"), "ISC": ("ISC License",), "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",), "MIT": ("MIT License",), "MPL-2.0": ("Mozilla Public License, version 2.0",), "Unlicense": ("Unlicense",), "Zlib": ("zlib License",),
}
SUBJECTS = ("", "This work is ", "This document is ", "This file is ", "This program is ", "This software is ")
VERBS = ("licensed", "released", "distributed", "published", "available")

# Canonical digests of licences as published, as Debian ships them.
DIGESTS = {
    "Apache-2.0": "d7bf6fe6d3ab3959516d9e80311bf9ca45ae44dbad9dafa905f4ded9b6db3e47",
    "Artistic-1.0-Perl": "3088f8cc496d6d0d45c610c6dfefbe927d60c5c8cd039cebb94c51c00d1798b4",
    "BSD-3-Clause-UC": "1fa16c94888f0aed83428199896fabe75e5f3e5e939fbc4333bd874ac87ad2a9",
    "CC0-1.0": "985cde481bccff403d8f38374d0e64bae2eb14d3378a242c075df70491586676",
    "GFDL-1.2": "d5b41bc34f83bf08f0d13fb25e8be7da5e6763d67b1feb337675bbc7ae72a046",
    "GFDL-1.3": "87e6d6e07f98564ffcfb6bd51621c881a95607eb4399b35208b3f21f8465e112",
    "GPL-1.0": "58e0cf9bfe4bba158ae01f2508f71ad72eb01b963655271a99d98de531dc10ec",
    "GPL-2.0": "8fcc6fc7032b76b8dd504a4e0b59366f6f5909073ee44cf49d1a53e82fa27d6e",
    "GPL-3.0": "8b062f1fc8829164c85cdf5554c3937735153bb17c0b40531cf4a7a17eec0981",
    "LGPL-2.0": "dee09b9a30d98943d96bd4686635d4ad379b4ca80114e874d2a7c40017815b4d",
    "LGPL-2.1": "72261dd8021a87d9ebffd36375a4650b9139e5373bb937940fa20f13727bdec0",
    "LGPL-3.0": "d018c7b199681f52bb188e25de97e8bc7539b0ae44f7b7e5d2bc870b25b598bd",
    "MPL-1.1": "61b4961b9898ea41311981c1f361a9d14aeccbf9c0b53068fe41d5b16e613f95",
    "MPL-2.0": "585d080823841c04a767db95488b49669175d4d103792ce6590dc6b5190ef70b",
}


def notices() -> dict[str, str]:
    """Usual notices by what they say: who is under which licence, with and without the article."""
    out = {}
    for license_id, names in NAMES.items():
        for name in names:
            for subject in SUBJECTS:
                for verb in VERBS:
                    for the in ("", "the "):
                        text = f"{subject}{verb} under {the}{name}."
                        out[text[0].upper() + text[1:]] = f"{license_id}-notice"
    return out


def canonical_lines(text: Column) -> Column:
    """The lines of a text in canonical form, words parted by two blanks; lines of which nothing stays are left out."""
    out = F.lower(F.coalesce(text, F.lit("")))
    # copyright lines, then list marks at the start of a line
    out = F.regexp_replace(out, r"(?m)^[^\p{L}\p{N}\p{M}\n]*(?:copyright\b(?: *(?:\(c\)|©|[0-9]| by )| year)|\(c\) |©|all rights reserved)[^\n]*$", "")
    out = F.regexp_replace(out, r"(?m)^[ \t]*\(?(?:[0-9]{1,2}|[a-z])[.)][ \t]", "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\p{M}\n]+", "  ")
    lines = F.transform(F.split(out, "\n", -1), lambda x: F.concat(F.lit(" "), F.trim(x), F.lit(" ")))

    def spelled(line: Column) -> Column:
        for variant, word in SPELLINGS.items():
            line = F.replace(line, F.lit(f" {variant} "), F.lit(f" {word} "))
        return F.trim(line)

    # most lines hold no variant, and one search tells
    search = " (?:" + "|".join(SPELLINGS) + ") "
    return F.filter(F.transform(lines, lambda x: F.when(x.rlike(search), spelled(x)).otherwise(F.trim(x))), lambda x: x != "")


def digest_of(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, "  ").cast("binary"), 256)


def known_digests(spark: SparkSession, licenses: Mapping[str, str] | DataFrame | None = None) -> DataFrame:
    """digest and license_id of licences given as a mapping of ids to texts, or as a table of license_id and text; by
    default of all that this module knows."""
    if isinstance(licenses, DataFrame):
        known = licenses.select("license_id", "text")
    else:
        rows = [*(LICENSES if licenses is None else licenses).items(), *((i, t) for t, i in notices().items() if licenses is None)]
        known = spark.createDataFrame(rows, "license_id string, text string")
    made = known.select("license_id", canonical_lines(F.col("text")).alias("lines")).where(F.size("lines") > 0).select(digest_of(F.col("lines")).alias("digest"), "license_id")
    if licenses is None:
        made = made.unionByName(spark.createDataFrame(list(DIGESTS.items()), "license_id string, digest string"))
    return made.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each row: doc_id, canonical_sha256, license_id of the entire text (or null), line_license_ids (sorted), n_license_lines.

    Entire texts are joined by a broadcast hash, and lines looked up within their row, as long as the known licences are
    at most BROADCAST_ROWS; with more, both are shuffled joins.
    """
    rows = docs.select(F.col(key).alias("doc_id"), canonical_lines(F.col(text)).alias("lines"))
    rows = rows.select("doc_id", digest_of(F.col("lines")).alias("canonical_sha256"), F.transform("lines", lambda x: F.sha2(x.cast("binary"), 256)).alias("lines"))
    few = known.limit(BROADCAST_ROWS + 1).collect()
    if len(few) > BROADCAST_ROWS:
        return _scan_by_shuffle(rows, known)
    # constants: a hash set that is built once
    names = F.str_to_map(F.lit("\n".join(f"{r['digest']}\t{r['license_id']}" for r in few)), F.lit("\n"), F.lit("\t"))
    hits = F.expr(f"filter(lines, d -> d IN ({', '.join(repr(str(r['digest'])) for r in few) or 'NULL'}))")
    rows = rows.select("doc_id", "canonical_sha256", hits.alias("hits"))
    found = rows.join(F.broadcast(known), F.col("canonical_sha256") == F.col("digest"), "left")
    return found.select(
        "doc_id", "canonical_sha256", "license_id", F.array_sort(F.array_distinct(F.transform("hits", lambda d: F.element_at(names, d)))).alias("line_license_ids"),
        F.size("hits").cast("long").alias("n_license_lines"))


def _scan_by_shuffle(rows: DataFrame, known: DataFrame) -> DataFrame:
    rows = rows.withColumn(f"{P}row", F.monotonically_increasing_id())
    unit = lambda digest, whole: F.struct(digest.alias("digest"), F.lit(whole).alias("whole"))
    units = F.concat(F.array(unit(F.col("canonical_sha256"), True)), F.transform("lines", lambda x: unit(x, False)))
    units = rows.select("doc_id", f"{P}row", "canonical_sha256", F.explode(units).alias("u")).select("doc_id", f"{P}row", "canonical_sha256", "u.digest", "u.whole")
    found = units.join(known, "digest", "left")
    on_line = F.when(~F.col("whole"), F.col("license_id"))
    # the join parted a text's rows, so each task sends one row a text at most
    return found.groupBy("doc_id", f"{P}row", "canonical_sha256").agg(
        F.max(F.when(F.col("whole"), F.col("license_id"))).alias("license_id"),
        F.array_sort(F.collect_set(on_line)).alias("line_license_ids"),
        F.count(on_line).alias("n_license_lines"),
    ).drop(f"{P}row")
