"""Whole texts that are a known licence, found by the digest of their canonical form.

Null texts get a null digest and no licence; empty ones are a text like others.
Repeated rows each get a result. Other columns are ignored. An empty table gives
no rows. The catalogue is part of the program and so of bounded size; a caller's
own is broadcast up to MAX_BROADCAST_TEXTS texts and joined by a shuffle beyond.
"""

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_TEXTS = 10_000
# Spellings that count as equal, as whole words.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("acknowledgements", "acknowledgments"),
    ("analogue", "analog"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("maximise", "maximize"),
    ("merchantibility", "merchantability"),
    ("modelling", "modeling"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("offence", "offense"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("sub licensing", "sublicensing"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]
# Headings that a licence's text may carry or not, in canonical form.
TITLES = [
    "boost software license version 1 0 august 17th 2003",
    "bsd 2 clause license",
    "bsd 2 clause simplified license",
    "bsd 3 clause license",
    "bsd 3 clause new or revised license",
    "bsd license",
    "bsd zero clause license",
    "isc license",
    "isc license isc",
    "mit license",
    "mit license mit",
    "mit no attribution",
    "modified bsd license",
    "new bsd license",
    "simplified bsd license",
    "the 2 clause bsd license",
    "the 3 clause bsd license",
    "the bsd 2 clause license",
    "the bsd 3 clause license",
    "the bsd license",
    "the isc license",
    "the mit license",
    "the mit license mit",
    "the unlicense",
    "the zlib license",
    "the zlib libpng license",
    "unlicense",
    "zero clause bsd",
    "zlib license",
]
#: A line that is a notice: a copyright mark or a year (or a blank for one) stands right after the word. Lines of a wrapped
#: text that begin with "copyright notice" or "copyright holders" are the licence's own.
COPYRIGHT_LINE = (
    r"(^|\n)[ \t#*/;%!\-]*(portions[ \t]+)?(copyright[ \t]*:?[ \t]*(\(c\)|©|[0-9]{4}|<|\[|\{)|\(c\)[ \t]*(copyright[ \t]*)?([0-9]{4}|<|\[)|©|all rights reserved)[^\n]*"
)
NOT_WORD = r"[^\p{L}\p{N}]+"

# Texts of known licences.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "notice-MIT": "Released under the MIT License.",
    "notice-Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice-GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice-CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}
# MIT without attribution has no second paragraph.
KNOWN["MIT-0"] = "\n\n".join([KNOWN["MIT"].split("\n\n")[0].replace(", subject to the following conditions:", "."), KNOWN["MIT"].split("\n\n")[2]])

# The full texts beside this file, named by their ids; of those with an appendix on use, also the terms alone.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"
for _file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
    KNOWN[_file.stem] = _file.read_text(encoding="utf-8")
    if END_OF_TERMS in KNOWN[_file.stem]:
        KNOWN[f"terms-{_file.stem}"] = KNOWN[_file.stem].split(END_OF_TERMS)[0] + END_OF_TERMS
    if _file.stem.startswith("BSD-"):
        # Conditions as an unnumbered list; what follows # is no part of the id.
        KNOWN[f"{_file.stem}#unnumbered"] = re.sub(r"(?m)^\s*[1-9]\. ", "* ", KNOWN[_file.stem])


def canonical(text: Column) -> Column:
    """Lower case; notices and a known title dropped; words separated by single spaces, in one spelling.

    Words have a space of their own on each side while spellings are replaced, so only whole words are.
    """
    t = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "\n")
    t = F.concat(F.lit(" "), F.btrim(F.regexp_replace(t, NOT_WORD, "  ")), F.lit(" "))
    for other, usual in SPELLINGS:
        t = F.replace(t, F.lit(f" {other.replace(' ', '  ')} "), F.lit(f" {usual.replace(' ', '  ')} "))
    return F.regexp_replace(F.btrim(F.regexp_replace(t, " +", " ")), title_pattern(), "")


def title_pattern() -> str:
    return "^(" + "|".join(sorted(TITLES, key=lambda x: (-len(x), x))) + ") "


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def catalogue(spark, known: dict[str, str] | None = None) -> DataFrame:
    """(license_id, canon_sha256): one row per digest, the first id of texts that are equal in canonical form."""
    rows = spark.createDataFrame(sorted((known or KNOWN).items()), "license_id string, body string")
    name = F.substring_index("license_id", "#", 1)
    return rows.groupBy(digest(F.col("body")).alias("canon_sha256")).agg(F.min(name).alias("license_id"))


def scan(docs: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """doc_id, canon_sha256, license_id: a hash join of whole texts with the catalogue."""
    texts = catalogue(docs.sparkSession, known)
    texts = F.broadcast(texts) if len(known or KNOWN) <= MAX_BROADCAST_TEXTS else texts
    found = docs.select("doc_id", digest(F.col("text")).alias("canon_sha256"))
    return found.join(texts, "canon_sha256", "left").select("doc_id", "canon_sha256", "license_id")
