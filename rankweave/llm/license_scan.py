"""License scans by canonical digest: entire texts, and single lines, against known licence digests.

Two copies of a licence differ in case, punctuation, line breaks, copyright lines and spelling. A canonical form removes
these, so a copy is found by an equi-join on its digest; no text is compared with any other.

Every rule of the form works on a line or on a word, so a line has a form of its own and the form of a text is that of its
lines one after the other: each line is brought into form once, for both purposes. Only whether a line that begins with
"copyright" names a holder depends on its place: in the head of a text it does, and right below a copyright line. Patterns run only over the lines that hold
what they look for, and a line has a digest only if some known text has as many words.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.base import row_key, small_batches
from rankweave.session import cut_lineage

MARKS = r"[ \t#*/;-]*"
#: lines that name a holder or a year with a sign of it, in lower case, also behind comment marks
COPYRIGHT_LINE = rf"(?m)^{MARKS}((portions[ \t]+)?copyright[ \t]*(\(c\)|©|[0-9<\[:])|\(c\)|©|all rights reserved[.]?[ \t\r*/]*$)[^\n]*"
#: a short line that begins like one: it names a holder only in the head of a text or right below a line above
HOLDER_LINE = rf"^{MARKS}(portions[ \t]+)?copyright[ \t]+[^ \t].{{0,60}}$"
#: the head of a text ends before the first line of more words that names no holder: until there only titles stand
TITLE_WORDS = 8
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F“”‘’–—©]+"
# equivalent spellings (fixed values): whole words of the canonical form
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "authorisation": "authorization", "cancelled": "canceled", "centre": "center",
    "favour": "favor", "fulfil": "fulfill", "https": "http", "judgement": "judgment", "labour": "labor", "licence": "license", "licences": "licenses",
    "noncommercial": "non commercial", "organisation": "organization", "organisations": "organizations",
    "percent": "per cent", "programme": "program", "recognised": "recognized", "sublicence": "sublicense", "utilisation": "utilization", "wilful": "willful",
}
# known licence texts and notices (fixed values)
PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
WARRANTY_MIT = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
WARRANTY_ISC = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
UNLICENSE = "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\nFor more information, please refer to <https://unlicense.org/>"


def _whole_texts() -> list[tuple[str, str, str]]:
    """The texts in ``licenses`` by file name, whole and up to the end of their terms, with and without that line."""
    out = []
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        body, end = path.read_text(encoding="utf-8"), "END OF TERMS AND CONDITIONS"
        terms = body.split(end)[0]
        out += [(path.stem, "text", t) for t in dict.fromkeys([body, *([terms, terms + end] if end in body else [])])]
    return out


KNOWN = [
    ("MIT", "text", f"MIT License\n{PERMISSION}\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{WARRANTY_MIT}"),
    ("MIT", "text", f"{PERMISSION}\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{WARRANTY_MIT}"),
    ("ISC", "text", f"ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{WARRANTY_ISC}"),
    ("0BSD", "text", f"BSD Zero Clause License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n{WARRANTY_ISC}"),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "notice", "Licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "notice", "Licensed under CC0 1.0."),
    ("BSD-2-Clause", "text", f"{BSD_HEAD}\n{BSD_WARRANTY}"),
    ("BSD-2-Clause", "text", f"BSD 2-Clause License\n{BSD_HEAD}\n{BSD_WARRANTY}"),
    ("BSD-3-Clause", "text", f"{BSD_HEAD}\n{BSD_NAMES}\n{BSD_WARRANTY}"),
    ("BSD-3-Clause", "text", f"BSD 3-Clause License\n{BSD_HEAD}\n{BSD_NAMES}\n{BSD_WARRANTY}"),
    ("Unlicense", "text", UNLICENSE),
    *_whole_texts(),
]


#: a line without any of these has nothing that names a holder
HINTS = ("copyright", "(c)", "©", "all rights reserved")
VARIANT = " (" + "|".join(map(re.escape, SPELLINGS)) + ") "


def replaced_where(values: pa.Array, where: pa.Array, change) -> pa.Array:
    """``values`` with ``change`` applied to those that ``where`` marks."""
    return pc.replace_with_mask(values, where, change(values.filter(where))) if pc.any(where).as_py() else values


def padded(values: pa.Array) -> pa.Array:
    blank, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    return pc.binary_join_element_wise(blank, values, blank, nothing)


def _respelled(forms: pa.Array) -> pa.Array:
    for variant, form in SPELLINGS.items():
        forms = pc.replace_substring(forms, f" {variant} ", f" {form} ")
    return forms


def line_forms(lines: pa.Array) -> pa.Array:
    """The words of every line in lower case and one spelling, joined by single spaces; nothing of a copyright line."""
    out = pc.ascii_lower(lines)
    hinted = pc.match_substring(out, HINTS[0])
    for hint in HINTS[1:]:
        hinted = pc.or_(hinted, pc.match_substring(out, hint))
    out = replaced_where(out, hinted, lambda x: pc.replace_substring_regex(x, COPYRIGHT_LINE, ""))
    out = pc.ascii_trim(pc.replace_substring_regex(out, NO_WORD, " "), " ")

    def respelled(x):  # two blanks between words, so that neighbours do not share one
        wide = padded(pc.replace_substring(x, " ", "  "))
        return pc.ascii_trim(pc.replace_substring_regex(_respelled(wide), " +", " "), " ")

    return replaced_where(out, pc.match_substring_regex(padded(out), VARIANT), respelled)


def text_forms(texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(forms of the texts, forms of their lines that are not empty, bounds of each text in those)."""
    lists = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), "\n")
    lines = lists.flatten()
    forms = line_forms(lines)
    edge = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    filled = pc.not_equal(forms, "").to_numpy(zero_copy_only=False)
    filled &= ~_holders_by_place(lines, forms, edge)
    bounds = np.concatenate([[0], np.cumsum(filled)])[edge]
    forms = forms.filter(pa.array(filled))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds.astype(np.int64)), forms), pa.scalar(" ", pa.large_string())), forms, bounds


def _holders_by_place(lines: pa.Array, forms: pa.Array, edge: np.ndarray) -> np.ndarray:
    """Which lines name a holder by their place: above the first line of more than TITLE_WORDS words, or below a copyright line."""
    begins = np.flatnonzero(pc.match_substring(forms, "copyright").to_numpy(zero_copy_only=False))
    out = np.zeros(len(lines), bool)
    if len(begins):
        out[begins[pc.match_substring_regex(pc.ascii_lower(lines.take(pa.array(begins))), HOLDER_LINE).to_numpy(zero_copy_only=False)]] = True
        long = np.flatnonzero((pc.count_substring(forms, " ").to_numpy(zero_copy_only=False) >= TITLE_WORDS) & ~out)
        text = np.searchsorted(edge, np.arange(len(lines)), "right") - 1
        after = np.append(long, len(lines))[np.searchsorted(long, edge[text])]  # the first long line from the start of the text on
        head = np.arange(len(lines)) < after
        later = np.flatnonzero(out & ~head)
        if len(later):  # never the first line of a text
            above = pc.ascii_lower(lines.take(pa.array(later - 1)))
            head[later] = pc.match_substring_regex(above, COPYRIGHT_LINE).to_numpy(zero_copy_only=False)
        out &= head
    return out


@F.arrow_udf(T.StringType())
def _canonical(text: pa.Array) -> pa.Array:
    return text_forms(text)[0].cast(pa.string())


def canonical(text: Column) -> Column:
    """Words of the text in lower case, joined by single spaces, without copyright lines and in one spelling."""
    return _canonical(text)


def sha(form: str) -> str:
    return hashlib.sha256(form.encode()).hexdigest()


def digests(docs: DataFrame, ident: str, text: str, word_counts: set[int]) -> DataFrame:
    """(id, k, t, digest, lines): digest of the whole form, and of the lines that have one of ``word_counts`` words."""
    schema = T.StructType([
        T.StructField("id", docs.schema[ident].dataType), T.StructField("k", T.LongType()), T.StructField("t", T.LongType()),
        T.StructField("digest", T.StringType()), T.StructField("lines", T.ArrayType(T.StringType()))])
    counts = np.array(sorted(word_counts), np.int64)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            whole, forms, bounds = text_forms(batch.column(3))
            right = np.isin(pc.count_substring(forms, " ").to_numpy(zero_copy_only=False) + 1, counts)
            marks = [sha(x) for x in forms.filter(pa.array(right)).to_pylist()]
            place = np.concatenate([[0], np.cumsum(right)])[bounds].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(place), pa.array(marks, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([sha(x) for x in whole.to_pylist()]), lists], names=schema.names)

    keys = [c.alias(n) for c, n in zip(row_key(ident, text), ("k", "t"), strict=True)]
    return small_batches(docs).select(F.col(ident).alias("id"), *keys, F.col(text).alias("text")).mapInArrow(run, schema)


def known_digests(spark: SparkSession, known=None) -> DataFrame:
    """(digest, license, n_words), one row per digest."""
    table = spark.createDataFrame([(i, t) for i, _, t in (KNOWN if known is None else known)], "license string, body string")
    formed = cut_lineage(table.select("license", canonical(F.col("body")).alias("form")))
    return formed.groupBy(F.sha2(F.encode("form", "UTF-8"), 256).alias("digest")).agg(F.min("license").alias("license"), F.max(F.size(F.split("form", " "))).alias("n_words"))


def scan_licenses(docs: DataFrame, known: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, license, n_license_lines, line_licenses), one row per row of ``docs``.

    ``license``: the entire text is a known licence, else null. The lines (at \\n) that are known notices are counted, their
    licences listed once each, sorted and joined by commas. A null, empty or all-punctuation text has the digest of the
    empty form and no licence. Equal rows get equal answers; empty tables stay empty; other columns are not read. The driver
    sees the distinct word counts of the known texts.
    """
    known = cut_lineage(known)
    word_counts = {r["n_words"] for r in known.select("n_words").distinct().collect()}
    names = known.select("digest", "license")
    rows = cut_lineage(digests(docs, ident, text, word_counts))
    lines = rows.where(F.size("lines") > 0).select("k", "t", F.posexplode("lines").alias("pos", "digest"))
    found = lines.join(names, "digest").groupBy("k", "t").agg(F.count_distinct("pos").alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("names"))
    whole = rows.select("id", "k", "t", "digest").join(names, "digest", "left")
    return whole.join(cut_lineage(found), ["k", "t"], "left").select(
        "id", "digest", "license", F.coalesce("n", F.lit(0).cast("long")).alias("n_license_lines"), F.coalesce("names", F.lit("")).alias("line_licenses"))
