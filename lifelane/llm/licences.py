"""License scans: canonical texts hashed and joined to the digests of known licences."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence texts as published, and one-line notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_1 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
#: Whole texts.
TEXTS = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "The MIT License\n\n" + _MIT),
    ("ISC", _ISC + _ISC_END),
    ("ISC", "ISC License\n\n" + _ISC + _ISC_END),
    ("ISC", "The ISC License\n\n" + _ISC + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_1 + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_1 + _BSD_END),
    ("BSD-3-Clause", _BSD_1 + _BSD_3 + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_1 + _BSD_3 + _BSD_END),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("BSL-1.0", _BOOST),
    ("Apache-2.0", _APACHE_HEADER),
]
# Names that notices give to licences, by their SPDX identifiers.
NAMES = {
    "MIT": ["MIT", "MIT License"],
    "ISC": ["ISC License"],
    "0BSD": ["Zero-Clause BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD License", "New BSD License"],
    "BSD": ["BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL v2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL v3", "GPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0"],
    "Unlicense": ["Unlicense"],
    "BSL-1.0": ["Boost Software License, version 1.0"],
    "Zlib": ["zlib License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
}
# How notices begin; the suffixes of identifiers of the GNU licences.
VERBS = ("Licensed", "Released", "Distributed", "Made available", "This work is licensed", "This software is licensed", "This project is licensed", "This file is licensed")
GNU = ("", "-only", "-or-later")


def notices() -> list[tuple[str, str]]:
    """(licence, text) of one-line notices: each way to begin with each name, and the SPDX tags."""
    out = [(k, f"{verb} under {the}{name}") for k, names in NAMES.items() for name in names for verb in VERBS for the in ("", "the ")]
    tags = [(k, k + suffix) for k in NAMES for suffix in (GNU if "GPL" in k else GNU[:1])]
    return out + [(k, f"SPDX-License-Identifier: {tag}") for k, tag in tags]


KNOWN = [*TEXTS, *notices()]
# SHA-256 of canonical forms of published texts too long to state here, whole and up to the end of their
# terms (without the advice on how to apply them). They belong to the rules below; digest_of() makes them.
DIGESTS: dict[str, str] = {
    "7ad91d63c0c1bc0ecf15b7a85957bb6eeef1f59c3a5700da4587b9401ec8fb8e": "Apache-2.0",
    "569702fa8eca81a9d391a35690dfcacf7919eb7c5cb8242c709f798a900febbd": "Apache-2.0",
    "f758f6664c11d912b82de1158296e9ef1bca9ba56aad245c829f9b06cfa93e45": "Apache-2.0",
    "08b5ae7fb88d3c5f8ffbf5d82741879a9a9f91f18ca3419506b64e03454d6b32": "Artistic-1.0",
    "e8daa50c96df2ade9d116da144a66a3e46944a78c9ae7c49064074817a5d8988": "BSD-3-Clause",
    "b096badc0168abbd7a6496f3097d3b3e33b5d3d54dbc0990a1eb8341c549c075": "CC0-1.0",
    "8ae024fa072456a9397fe0d8ceb602ee6646d27d174002b262b7cd7b694f10fc": "GFDL-1.2",
    "5ce6d450db373dceb9291a234aadd7a9b1c01e3c139961f2aa9fb4dfc70484d1": "GFDL-1.2",
    "06335ae6ca5d5f4d101a3efae97393105ae5e76230369dadb296f57777ab7034": "GFDL-1.3",
    "0620c5e936aa4333a286e9e541774dc5daedf79a54a39ea60a065b692af294fd": "GFDL-1.3",
    "3019dc36a2e8898557fd627af32eb8fa898f5e06d269e13341bfea001438b8bd": "GPL-1.0",
    "c26c1f63ee742068fca30c0bade825cfc4c52418119573834a07e73df7587b7c": "GPL-1.0",
    "59eb48daea0a97e9293000097f78c3f0f4c72c44b0c7944f83deb45ce67c2984": "GPL-1.0",
    "22e372d9da4d28ee42a6823124b3873bf29be00647c0f7ff17fe3b007a34fad3": "GPL-2.0",
    "ccae9047ad0878e9ee3719fb7dc1207f896d72a7bf2be468d7318c827e550691": "GPL-2.0",
    "1e27531c3341a155c8d16adafb0c22122415c8b9a62905b9caa7f8673832a5f5": "GPL-2.0",
    "4c3e25b96cfc8f568b5bcf32c98eddd8ad6b82d4b6301087756f043004f5c09c": "GPL-3.0",
    "3fd038b72db3c0f91c2cfdffad248c84aa7f4588c90d80ab7e5cc3e4111e1583": "GPL-3.0",
    "56da6eb8f7e8cda7abc65f64914a4287b4bb2fda9ec0882180115c31ff4a5b0e": "GPL-3.0",
    "33d0ea24b891d2a24ce8500f270e9b8872c53c2f920cc94b193a03f6558dab05": "LGPL-2.0",
    "7f1f7a59776e482bd5b83c10e93703f0209dc9ae6d6930ffa37e91f511a776a5": "LGPL-2.0",
    "093d079382f2508c8dc2c22f31d5be749e35b78c486ee2b3c7f7265de7c4493f": "LGPL-2.0",
    "8b4f1c94f0d27a013a951072cd12a6907b09d12f59ad47558c0355dfa7c905be": "LGPL-2.1",
    "9fe8c3684e1aa3c849c1a6fae60ebc5d75c7a4a0241374041dfc7700709f424b": "LGPL-2.1",
    "3d2b7e71fd1eef60339ce3dbdd19a99ce63fe5d56d640b1471318319f59310f2": "LGPL-2.1",
    "f9971a40b39b55b23a81e443f25bde5afd88dcddc5a97e859f3e234c6409bb34": "LGPL-3.0",
    "53cf2fd0c425211875c24535e3104d0c7330839f6e80ab374bf9140c649c5e0d": "MPL-1.1",
    "9a47e727dc3de1cc062dd92cf79d6f0d281cb447da302e9588b4b8ebb80df8ea": "MPL-1.1",
    "c642e6f5996474595040e74a4b3c4160303762ec6c8537bf183cf85fd58279ff": "MPL-2.0",
    "45e7719ab0a4308ddfffb7d22f0b071b282c13b326bbab62056d5fe3fe2b3977": "MPL-2.0",
}
# Fixed values: (pattern, replacement) in turn; the same rules for known and scanned texts, so over-eager ones do no harm.
#: Where a copyright statement begins: the word must be followed by a sign, a year or a place-holder, as licences use it
#: too; a sign alone by a year, as lists have items (c).
_STATED = r"copyright ?(\(c\)|©|[\[<{]|year |[12][0-9][0-9][0-9])|(\(c\)|©) ?(copyright|<year|[12][0-9][0-9][0-9])"
#: What ends one, and stays; otherwise a paragraph's end, the next statement or 160 characters.
_AFTER = "everyone is permitted|permission|redistribution|licens|licenc|released|distributed|made available| this |spdx|all rights reserved"
RULES = [
    (r"\n[ \t\r#*/;-]*\n", "\x02"),  # the end of a paragraph; all other white space is alike from here on
    (r"[ \t\r\n][ \t\r\n]+|[\t\r\n]", " "),
    (_STATED, "\x01"),
    (rf"\x01[^\x01\x02]{{0,160}}?({_AFTER})", "\x02$1"),
    (r"\x01[^\x01\x02]{0,160}", ""),
    (r"all rights reserved", ""),
    (r"[^\p{L}\p{N}]+", " "),
    (r"licenc", "licens"),
    (r"is(e|ed|es|ing|er|ers|ation|ations)( |$)", "iz$1$2"),
    (r"our( |$)", "or$1"),
    (r"sub licens", "sublicens"),
    (r"non (commercial|infring)", "non$1"),
    (r"copyright (owner|proprietor)", "copyright holder"),
    (r"https ", "http "),
    (r"whilst", "while"),
    (r"acknowledgement", "acknowledgment"),
]


def literals(pattern: str, to: str) -> list[tuple[str, str]]:
    """A rule as plain replacements, none if it needs a pattern: mere letters and spaces, with alternatives at the end at most."""
    found = re.fullmatch(r"([a-z ]+)(?:\(([a-z|]+)\))?", pattern)
    return [(found[1] + end, to.replace("$1", end)) for end in (found[2] or "").split("|")] if found else []


def canonical(text: Column) -> Column:
    """Lower case, without copyright statements and punctuation, with one spelling of words that have several.

    Plain rules search the text's bytes; a pattern takes it through Java's strings and back.
    """
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, to in RULES:
        plain = literals(pattern, to)
        for old, new in plain:
            out = F.replace(out, F.lit(old), F.lit(new))
        if not plain:
            out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def known_digests(spark, known=None, digests=None) -> DataFrame:
    """digest, licence: one row for each canonical form of known (name, text), the first name of several, and for digests."""
    known = KNOWN if known is None else known
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(known)], "i int, licence string, text string")
    rows = rows.select("i", "licence", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    more = spark.createDataFrame([(len(known) + i, name, d) for i, (d, name) in enumerate((DIGESTS if digests is None else digests).items())], "i int, licence string, digest string")
    return rows.unionByName(more).groupBy("digest").agg(F.min_by("licence", "i").alias("licence"))


def scan(documents: DataFrame, known=None) -> DataFrame:
    """doc_id, text_digest, licence, notices, n_notices of every row.

    licence: the known licence that the whole text is, or null. notices: the distinct licences, sorted and joined by
    commas, that single lines of the text are; n_notices: how many such lines. Null texts count as empty; texts that
    are empty once canonical match nothing. Rows with equal ids share their notices; a null id has none. The table of
    known digests is fixed and small, so it is broadcast. Extra columns are ignored.
    """
    digests = F.broadcast(known_digests(documents.sparkSession, known))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).join(digests, "digest", "left")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.sha2(canonical(F.col("line")), 256).alias("digest"))
    found = lines.join(digests, "digest").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"), F.count("*").alias("n_notices"))
    return whole.join(found, "doc_id", "left").select("doc_id", F.col("digest").alias("text_digest"), "licence", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def op5_licence_digests(spark, sf_dir: str) -> DataFrame:
    """scan() of documents: one row for each of its rows, repeated and null ids and null texts too."""
    from .common import table

    return scan(table(spark, sf_dir, "documents"))


def digest_of(text: str) -> str:
    """The digest of an ASCII text's canonical form, as canonical() makes it."""
    out = text.lower()
    for pattern, to in RULES:
        out = re.sub(pattern.replace(r"\p{L}\p{N}", "a-z0-9"), re.sub(r"\$(\d)", r"\\\1", to), out)
    return hashlib.sha256(out.strip(" ").encode()).hexdigest()


def _sql(column: str) -> str:
    out = f"lower(coalesce({column}, ''))"
    for pattern, to in RULES:
        out = f"regexp_replace({out}, '{pattern}', '{re.sub(r'\$(\d)', r'\\\1', to)}', 'g')"
    return f"sha256(trim({out}))"


def op5_sql() -> str:
    rows: dict[str, str] = {}
    for name, text in KNOWN:
        rows.setdefault(digest_of(text), name)
    values = ", ".join(f"('{d}', '{n}')" for d, n in (DIGESTS | rows).items())
    return f"""
WITH known(digest, licence) AS (VALUES {values}),
whole AS (SELECT doc_id, {_sql('text')} AS digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
found AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS n FROM (SELECT doc_id, {_sql('line')} AS digest FROM lines) JOIN known USING (digest) GROUP BY doc_id)
SELECT doc_id, digest AS text_digest, licence, coalesce(notices, '') AS notices, coalesce(n, 0)::BIGINT AS n_notices FROM whole LEFT JOIN known USING (digest) LEFT JOIN found USING (doc_id)
"""
