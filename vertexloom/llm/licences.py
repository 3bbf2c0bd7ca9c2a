"""Licence scans by canonical digests: texts that are a known licence as a whole, up to case, punctuation, white space,
copyright lines and equivalent spellings. DataFrame functions only: one digest a text and a hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts of short public licences, and notices that name one.
KNOWN = {
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
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "notice-MIT": "Released under the MIT License.",
    "notice-Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice-GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice-CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}
# Spellings that count as one.
SPELLINGS = {"licence": "license", "licenced": "licensed", "sublicence": "sublicense", "organisation": "organization", "noninfringement": "non infringement", "favour": "favor", "honour": "honor", "judgement": "judgment", "acknowledgement": "acknowledgment", "whilst": "while", "programme": "program", "analogue": "analog", "copyright owner": "copyright holder", "copyright owners": "copyright holders", "http": "https"}
# Digests of the canonical forms of longer public licences; a second one is of the text up to the end of
# its terms, without what tells how to apply them.
DIGESTS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("3420cffbc5a189344e1877fb60e7273e53d7e783559abf595c291da52ded4de1", "536268a29a0159e67af17c6e67180c66dd3d63b55f1de711e05c122be8002289"),
    "Artistic-1.0-Perl": ("08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",),
    "CC0-1.0": ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",),
    "GFDL-1.2": ("5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71",),
    "GFDL-1.3": ("93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6",),
    "GPL-1.0": ("8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    "GPL-2.0": ("efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    "GPL-3.0": ("a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    "LGPL-2.0": ("61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    "LGPL-2.1": ("4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-1.1": ("fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354",),
    "MPL-2.0": ("3dacd2c104719e7227969cbdcc7d581518827199e830b9379627eec0a32f8ab7",),
}
_HEADING = "^(the )?(mit|isc|0bsd|bsd zero clause|zero clause bsd|(the )?bsd 2 clause|simplified bsd|(the )?bsd 3 clause|new bsd|modified bsd|zlib) license "
_COPYRIGHT = "^[ \\t]*(copyright[ \\t:]*(\\(c\\)|\u00a9|<|\\[|[0-9]{4})|\\(c\\)[ \\t]|\u00a9)[^\\n]*$"
_RESERVED = "^[ \\t]*all rights reserved\\.?[ \\t]*$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: str) -> Column:
    """A text's canonical form: lower case (A-Z), no copyright lines, letters and digits only with single spaces between,
    equivalent spellings as one, no title line of its own."""
    c = F.translate(F.col(text), _UPPER, _LOWER)
    for line in (_COPYRIGHT, _RESERVED):
        c = F.regexp_replace(c, f"(?md){line}", "")
    # Two spaces between words, so that neighbours are replaced alike.
    c = F.concat(F.lit(" "), F.regexp_replace(c, "[^a-z0-9\\x{80}-\\x{10ffff}]+", "  "), F.lit(" "))
    for a, b in SPELLINGS.items():
        c = F.replace(c, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.regexp_replace(F.trim(F.replace(c, F.lit("  "), F.lit(" "))), _HEADING, "")


def canonical_sql(text: str) -> str:
    """The same as SQL."""
    c = f"translate({text}, '{_UPPER}', '{_LOWER}')"
    for line in (_COPYRIGHT, _RESERVED):
        c = f"regexp_replace({c}, '(?m){line}', '', 'g')"
    c = f"' ' || regexp_replace({c}, '[^a-z0-9\\x{{80}}-\\x{{10ffff}}]+', '  ', 'g') || ' '"
    for a, b in SPELLINGS.items():
        c = f"replace({c}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
    return f"regexp_replace(trim(replace({c}, '  ', ' '), ' '), '{_HEADING}', '')"


def scan_sql() -> str:
    """scan_licences of `documents` as SQL."""
    known = " UNION ALL ".join(f"SELECT '{k}' AS licence, '{t.replace(chr(39), chr(39) * 2)}' AS text" for k, t in KNOWN.items())
    more = ", ".join(f"('{d}', '{k}')" for k, ds in DIGESTS.items() for d in ds)
    return f"""
WITH k AS (SELECT digest, min(licence) AS licence FROM (SELECT sha256({canonical_sql("text")}) AS digest, licence FROM ({known}) UNION ALL SELECT * FROM (VALUES {more}) t(digest, licence)) GROUP BY 1),
d AS (SELECT doc_id, sha256({canonical_sql("text")}) AS digest FROM documents)
SELECT doc_id, digest, licence FROM d LEFT JOIN k USING (digest)"""


def known_licences(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(digest, licence) of known texts; by default those of this module."""
    rows = spark.createDataFrame(list((KNOWN if texts is None else texts).items()), "licence string, text string")
    rows = rows.select(F.sha2(canonical("text"), 256).alias("digest"), "licence")
    if texts is None:
        rows = rows.unionByName(spark.createDataFrame([(d, k) for k, ds in DIGESTS.items() for d in ds], "digest string, licence string"))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, digest of the whole text's canonical form, licence (null if it is no known one).

    Null texts have null digests and no licence; the empty canonical form is never a licence. Repeated rows and null ids
    stay; extra columns are ignored; an empty table gives an empty result. The known digests join by hash: Spark
    broadcasts them where they are below its bound and shuffles otherwise."""
    found = docs.select(F.col(id_col), F.sha2(canonical(text_col), 256).alias("digest"))
    known = known_licences(docs.sparkSession) if known is None else known
    known = known.where(F.col("digest") != F.sha2(F.lit(""), 256))
    return found.join(known, "digest", "left").select(id_col, "digest", "licence")
