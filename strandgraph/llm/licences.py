"""Licence scan by canonical digest: texts, normalised, are hash-joined to known licences' digests.

Whole texts are equal to a licence if they differ in case, punctuation, white space, list marks, copyright lines, a title or
equivalent spellings only. Lines of a text are looked up by the same digest among one-line notices. Digests are chains of
SQL functions; texts never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, each with what stands for it, in canonical words.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("whilst", "while"),
    ("favour", "favor"),
    ("programme", "program"),
    ("per cent", "percent"),
    ("https", "http"),
)
# Notices of one line, and the licences that they name.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
_BSD_1 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_2 = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission.\n"
)
_BSD_4 = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# Licence names and the texts that they go by.
KNOWN = (
    *NOTICES,
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("BSD-2-Clause", _BSD_1 + _BSD_2 + _BSD_4),
    ("BSD-3-Clause", _BSD_1 + _BSD_2 + _BSD_3 + _BSD_4),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software.\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions:\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use "
        "this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n"
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means.\n"
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
        "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our "
        "heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future "
        "rights to this software under copyright law.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n"
        "For more information, please refer to <https://unlicense.org/>",
    ),
    (
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003\n"
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the '
        "Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do "
        "so, all subject to the following:\n"
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the "
        "following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the "
        "Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source "
        "language processor.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR "
        "ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
)
# Digests of canonical() of longer licences' published texts.
DIGESTS = (
    ("Apache-2.0", "f86c45fc72b043272de5d765793567a95363a0016be29aaee3c6a6d8b0ca5532"),
    ("Artistic-1.0-Perl", "4834e699353522cfb463bd8b374752ecf02156bb3f5dfb53d0edb502a112a651"),
    ("CC0-1.0", "51c4bf27767d074bdefc84db7420b4c55e27827dac6d8de3ef0d37b2042fb6fa"),
    ("GFDL-1.2", "7bd3a9b625b0b9c72d575e34948a31aa1d9a92600e54323c0abd84a9844ce82d"),
    ("GFDL-1.3", "3e03599855be6f5154c1bba1c4189768a3518f5863527559438fa78fa2262af5"),
    ("GPL-1.0", "fe80ccaae90d81557cc6613b788c47dd1819c7a5ae034f77e7d60bb6b879677e"),
    ("GPL-2.0", "9c942f6942a3d44037aa20b92138b7de02aafd88adea708e7c93f34a145aeaa1"),
    ("GPL-3.0", "3695e90f7fe4b461853cec533de5675ab2b6b1fcafcb504d6c64ded76f675d64"),
    ("LGPL-2.0", "76e95bde887e452fdbf364b6e132f70904f43582182b76e0f71d88a2d8911ef7"),
    ("LGPL-2.1", "3c172029ca14deedef915e5d03e83bcc73647736d10c2be07d384571ca06b440"),
    ("LGPL-3.0", "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45"),
    ("MPL-1.1", "16081ee9a65186f454426c45c57a9975d16e58534051db8dad1cf32de973647f"),
    ("MPL-2.0", "1b1ad9103975e4267620e04f6a9cd315e74377c35271f5ff48fbc6ebb9f1e8a9"),
)

#: Words that go on with a sentence: a wrapped line of a licence's body may start with "copyright notice".
BODY_WORDS = "act|also|and|as|claims?|contributors?|disclaimers?|each|for|from|grants?|has|holders?|if|in|infringement|interests?|is|it|law|laws|licen[cs]es?|licensors?|management|materials?|may|means|must|notices?|of|on|or|owners?|ownership|permissions?|protected|protection|rights?|shall|statements?|status|terms?|that|this|to|treat(?:y|ies)|under|which|will|with|works?|you|your"
#: What may stand before the first word of a line.
MARKS = r"[ \t#*/;%-]*"
#: Lines that name a copyright; "(c)" does so with a year, else it is a clause's letter.
NOTICE = rf"{MARKS}(?:copyright(?:[ \t(©\r]|$)|©|all rights reserved|\(c\)[ \t].*(?:19|20)[0-9][0-9])"
#: Lines among them that go on with a sentence.
SENTENCE = rf"{MARKS}copyright[ \t]+(?:{BODY_WORDS})(?:[^0-9a-z]|$)"
#: Titles on lines of their own before anything else of a text. With one more + the repetition is possessive: it takes the same, and
#: Java's engine doesn't nest calls for it.
TITLES = r"^(?:[ \t\r\n#*/;%=-]*(?:the[ \t]+)?(?:(?:new|modified|simplified|[023]-clause)[ \t]+)?(?:mit|expat|isc|x11|zlib|bsd)(?:[ \t]+[023]-clause)?[ \t]+licen[cs]e(?:[ \t]*\((?:mit|expat|isc|x11|zlib)\))?[ \t:.#*/;%=-]*\r?(?:\n|$))+"
#: The mark of a list's entry, at a line's start or after a sentence's end.
LIST_MARK = rf"(\n{MARKS}|[.:;][ \t\r\n*#/-]+)\(?(?:[0-9][0-9]?|[a-z])[.)][ \t\r\n]+"
#: What stands between the words of a canonical text, but for line breaks.
BETWEEN = r"[^0-9a-z\n\x{80}-\x{10FFFF}]+"


def _words(text: Column) -> Column:
    """Lower case, copyright lines, titles and list marks out, words of letters and digits with one spelling each, blanks and
    line breaks between them."""
    s = F.concat(F.lit("\n"), F.lower(F.coalesce(text.cast("string"), F.lit(""))))
    s = F.regexp_replace(s, rf"(?m)\n(?!{SENTENCE})(?:{NOTICE})[^\n]*", "")
    s = F.regexp_replace(F.substring(s, 2, 2**31 - 1), TITLES + "+", "")
    s = F.regexp_replace(F.concat(F.lit("\n"), s), LIST_MARK, "$1\n")
    s = F.concat(F.lit(" "), F.replace(F.regexp_replace(s, BETWEEN, " "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    # Two blanks, so that neighbours don't share one.
    s = F.replace(s, F.lit(" "), F.lit("  "))
    for a, b in SPELLINGS:
        s = F.replace(s, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.replace(s, F.lit("  "), F.lit(" "))


def _one_line(words: Column) -> Column:
    return F.trim(F.regexp_replace(words, "[ \n]+", " "))


def canonical(text: Column) -> Column:
    """The words of a text, joined by one space, without copyright lines, titles and list marks."""
    return _one_line(_words(text))


def known_licences(spark: SparkSession) -> DataFrame:
    """license, canonical_sha256 of KNOWN and DIGESTS."""
    texts = spark.createDataFrame(list(KNOWN), "license string, text string").select("license", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"))
    return texts.unionByName(spark.createDataFrame(list(DIGESTS), "license string, canonical_sha256 string"))


def known_notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOTICES), "license string, text string").select("license", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"))


EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
#: Notices are a literal of the plan: so many at most.
MOST_NOTICES = 10_000


def scanned(docs: DataFrame, known: DataFrame, notices: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text", small: int = 100_000) -> DataFrame:
    """Each row of docs with canonical_sha256, license (the name of the known text with that digest, else null) and notices
    (names of the notices that one of its lines is, in order; an empty array without any).

    known and notices: license, canonical_sha256. Of several known texts with one digest the first name in order counts.
    Texts without a canonical word, null ones included, match nothing. Null ids and repeated rows stay rows. Known digests
    are broadcast up to `small` of them and shuffled beyond; more than MOST_NOTICES notices are an error. Other columns
    aren't read.
    """
    table = known.filter(F.col("canonical_sha256") != EMPTY).groupBy("canonical_sha256").agg(F.min("license").alias("license"))
    if table.limit(small + 1).count() <= small:
        table = F.broadcast(table)
    names: dict[str, str] = {}
    if notices is not None:
        rows = notices.filter(F.col("canonical_sha256") != EMPTY).select("license", "canonical_sha256").distinct().orderBy(F.desc("license")).limit(MOST_NOTICES + 1).collect()
        if len(rows) > MOST_NOTICES:
            raise ValueError(f"more than {MOST_NOTICES} notices")
        names = {r.canonical_sha256: r.license for r in rows}
    digests = F.array(*map(F.lit, sorted(names))) if names else F.array().cast("array<string>")
    pairs = F.create_map(*(F.lit(x) for p in sorted(names.items()) for x in p)) if names else None
    words = docs.select(F.col(id_column).alias("doc_id"), _words(F.col(text_column)).alias("w"))
    lines = F.transform(F.split("w", " *\n *"), lambda x: F.sha2(F.trim(x), 256)) if names else F.array().cast("array<string>")
    rows = words.select("doc_id", F.sha2(_one_line(F.col("w")), 256).alias("canonical_sha256"), F.array_intersect(lines, digests).alias("hits"))
    named = F.array_sort(F.array_distinct(F.transform("hits", lambda x: F.element_at(pairs, x)))) if names else F.col("hits")
    return rows.join(table, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license", named.alias("notices"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the built-in licences and notices."""
    found = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"), known_licences(spark), known_notices(spark))
    return found.withColumn("notices", F.array_join("notices", ","))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_words(text: str) -> str:
    notice, sentence = _sql_text("^" + NOTICE), _sql_text("^" + SENTENCE)
    s = f"array_to_string(list_filter(string_split(lower(coalesce({text}, '')), chr(10)), lambda x: NOT regexp_matches(x, {notice}) OR regexp_matches(x, {sentence})), chr(10))"
    s = f"regexp_replace({s}, {_sql_text(TITLES)}, '')"
    s = f"regexp_replace(chr(10) || {s}, {_sql_text(LIST_MARK)}, '\\1' || chr(10), 'g')"
    s = f"' ' || replace(regexp_replace({s}, {_sql_text(BETWEEN)}, ' ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
    s = f"replace({s}, ' ', '  ')"
    for a, b in SPELLINGS:
        s = f"replace({s}, {_sql_text(f' {a} ')}, {_sql_text(f' {b} ')})"
    return f"replace({s}, '  ', ' ')"


def _sql_canonical(words: str) -> str:
    return f"trim(regexp_replace({words}, '[ ' || chr(10) || ']+', ' ', 'g'), ' ')"


def _sql_values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(_sql_text, r)) + ")" for r in rows)


ORACLE_SQL = f"""
WITH texts(license, text) AS ({_sql_values(KNOWN)}), short(license, text) AS ({_sql_values(NOTICES)}),
long(license, canonical_sha256) AS ({_sql_values(DIGESTS)}),
digests AS (SELECT canonical_sha256, min(license) AS license FROM (SELECT license, sha256({_sql_canonical(_sql_words("text"))}) AS canonical_sha256 FROM texts UNION ALL SELECT * FROM long) GROUP BY 1),
lines AS (SELECT sha256({_sql_canonical(_sql_words("text"))}) AS canonical_sha256, min(license) AS license FROM short GROUP BY 1),
w AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents),
hits AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices FROM (SELECT DISTINCT doc_id, lines.license FROM (SELECT doc_id, sha256(trim(unnest(string_split(w, chr(10))), ' ')) AS h FROM w) JOIN lines ON h = canonical_sha256) GROUP BY 1)
SELECT w.doc_id, sha256({_sql_canonical("w")}) AS canonical_sha256, digests.license, coalesce(notices, '') AS notices
FROM w LEFT JOIN digests ON digests.canonical_sha256 = sha256({_sql_canonical("w")}) LEFT JOIN hits ON hits.doc_id = w.doc_id
"""
