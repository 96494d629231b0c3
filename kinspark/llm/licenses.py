"""Licence recognition by sentences, in DataFrame operations only: normalised sentences are looked up in a table of known
licence sentences; the sequence of their identifiers is then matched against ordered rules.

A text is read twice: line by line, and with wrapped lines joined up to the next blank line. Comment marks at the beginning of lines,
list numbers and copyright notices are passed over; names of holders and programs inside licence sentences are brought to one
form. Any other sentence, licence-like or not, breaks a sequence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: known licence sentences, normalised (lower case; anything but letters, digits and . + - as one space;
# no full stop at the end), with their identifiers
SENTENCES = {
    "this work is licensed under the gnu general public license version 3": "gpl3-work",
    "this work is licensed under the gnu general public license version 2": "gpl2-work",
    "licensed under the gnu general public license version 3": "gpl3-work",
    "licensed under the gnu general public license version 2": "gpl2-work",
    "gnu general public license version 3 29 june 2007": "gpl3-text",
    "gnu general public license version 2 june 1991": "gpl2-text",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3-text",
    "gnu lesser general public license version 2.1 february 1999": "lgpl2.1-text",
    "gnu affero general public license version 3 19 november 2007": "agpl3-text",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "fsf-verbatim",
    "this program is free software": "free-software",
    "either version 3 of the license or at your option any later version": "or-later-3",
    "either version 2 of the license or at your option any later version": "or-later-2",
    "either version 2.1 of the license or at your option any later version": "or-later-2.1",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-warranty",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-implied",
    "licensed under the apache license version 2.0": "apache2",
    "licensed under the apache license version 2.0 the license": "apache2",
    "apache license version 2.0 january 2004 http www.apache.org licenses": "apache2-text",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "you may obtain a copy of the license at http www.apache.org licenses license-2.0": "apache-copy",
    "you may obtain a copy of the license at http www.apache.org licenses license-2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache-language",
    "released under the mit license": "mit-name",
    "licensed under the mit license": "mit-name",
    "this project is licensed under the mit license": "mit-name",
    "mit license": "mit-name",
    "the mit license": "mit-name",
    "the mit license mit": "mit-name",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "in no event shall the holder be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this software is provided by the holder as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-as-is",
    "licensed under cc by 4.0": "cc-by",
    "licensed under cc by-sa 4.0": "cc-by-sa",
    "licensed under cc by-nc 4.0": "cc-by-nc",
    "licensed under cc by-nd 4.0": "cc-by-nd",
    "licensed under cc by-nc-sa 4.0": "cc-by-nc-sa",
    "licensed under cc by-nc-nd 4.0": "cc-by-nc-nd",
    "licensed under cc0 1.0": "cc0",
    "mozilla public license version 2.0": "mpl2-text",
    "this source code form is subject to the terms of the mozilla public license v.2.0": "mpl2",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0": "mpl2-copy",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "all rights reserved": "all-rights",
}
FAMILIES = (("gpl", "GPL", "general"), ("lgpl", "LGPL", "lesser general"), ("agpl", "AGPL", "affero general"))
VERSIONS = ("2", "2.1", "3")
for _id, _, _name in FAMILIES:  # the usual notice, whose parts are set off by semicolons or by commas
    _terms = f"you can redistribute it and or modify it under the terms of the gnu {_name} public license as published by the free software foundation"
    SENTENCES[_terms] = f"{_id}-terms"
    SENTENCES[f"see the gnu {_name} public license for more details"] = f"{_id}-details"
    for _v in VERSIONS:
        SENTENCES[f"{_terms} either version {_v} of the license or at your option any later version"] = f"{_id}{_v}-later"
        SENTENCES[f"{_terms} version {_v} of the license"] = SENTENCES[f"{_terms} version {_v}"] = f"{_id}{_v}-only"
# fixed values: rules in the order in which they are tried, longer sequences before what they contain; a sentence serves one rule
RULES = [
    *[(f"free-software {i}-terms or-later-{v}", f"{n}-{v if '.' in v else v + '.0'}-or-later") for i, n, _ in FAMILIES for v in reversed(VERSIONS)],
    *[(f"free-software {i}{v}-{how}", f"{n}-{v if '.' in v else v + '.0'}-{'or-later' if how == 'later' else 'only'}") for how in ("later", "only") for i, n, _ in FAMILIES for v in reversed(VERSIONS)],
    ("bsd-grant bsd-source bsd-binary bsd-names", "BSD-3-Clause"),
    ("bsd-grant bsd-source bsd-binary", "BSD-2-Clause"),
    ("apache2 apache-compliance apache-copy", "Apache-2.0"),
    ("apache2", "Apache-2.0"),
    ("apache2-text", "Apache-2.0"),
    ("mit-grant mit-notice mit-as-is", "MIT"),
    ("mit-notice mit-as-is", "MIT"),
    ("mit-name", "MIT"),
    ("isc-grant", "ISC"),
    ("gpl3-work", "GPL-3.0-only"),
    ("gpl2-work", "GPL-2.0-only"),
    ("gpl3-text", "GPL-3.0-only"),
    ("gpl2-text", "GPL-2.0-only"),
    ("lgpl3-text", "LGPL-3.0-only"),
    ("lgpl2.1-text", "LGPL-2.1-only"),
    ("agpl3-text", "AGPL-3.0-only"),
    ("mpl2", "MPL-2.0"),
    ("mpl2-text", "MPL-2.0"),
    ("unlicense", "Unlicense"),
    ("cc-by-nc-nd", "CC-BY-NC-ND-4.0"),
    ("cc-by-nc-sa", "CC-BY-NC-SA-4.0"),
    ("cc-by-nc", "CC-BY-NC-4.0"),
    ("cc-by-nd", "CC-BY-ND-4.0"),
    ("cc-by-sa", "CC-BY-SA-4.0"),
    ("cc-by", "CC-BY-4.0"),
    ("cc0", "CC0-1.0"),
    ("all-rights", "all-rights-reserved"),
]
HINT = "licen|rights reserved|redistribut|free software|warrant|permission|permitted|public domain|version [23]|as is|the name of|liable|public"  # what every known sentence or one like it holds
BLANK = r"[ \t\x0B\f\r]"
MARKS = r"(?m)^[ \t]*(?://+|/\*+|\*+/?|#+|;;+|--+|%+|<!--)+"
ENDS = r"([.!?;:])[ \t\n\x0B\f\r]+"
#: rewrites of a sentence: one form of spaces and marks, then of what varies
REWRITES = [
    (r"[^a-z0-9.+-]+", " "),
    (r"^[ .-]+|[ .-]+$", ""),
    (r"^(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})[.]? ", ""),
    (r"^neither the name of .+ nor the names of (?:its|their|other) contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (r"^this software is provided by .+ as is and", "this software is provided by the holder as is and"),
    (r"^in no event shall .+ be liable for", "in no event shall the holder be liable for"),
    (r"^[a-z0-9.+-]+(?: [a-z0-9.+-]+){0,4} is free software", "this program is free software"),
    (r"^[a-z0-9.+-]+(?: [a-z0-9.+-]+){0,4} is distributed in the hope", "this program is distributed in the hope"),
    (r"^copyright .+ (licensed under the apache license)", "$1"),
    (r"(^| )mozilla public license v[.] ?2[.]0", "$1mozilla public license v.2.0"),
]
PASSED = r"^(?:[0-9]{0,2}|[a-z]|[ivx]{1,4}|copyright .*|c [12][0-9]{3} .*|spdx-license-identifier.*)$"  # sentences that neither count nor break


def readings(text: Column) -> tuple[Column, Column]:
    """Sentences of a text, in order: line by line, and with wrapped lines joined. Sentences end at a line feed, or at . ! ? ; : before
    white space."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), MARKS, ""), r"v[.] 2[.]0", "v.2.0")
    joined = F.translate(F.regexp_replace(plain, rf"\n{BLANK}*(?:\n{BLANK}*)+", "\x01"), "\n\x01", " \n")
    return tuple(F.split(F.regexp_replace(x, ENDS, "$1\n"), "\n") for x in (plain, joined))


def identifiers(sentences: Column) -> Column:
    """Identifier of each sentence: ~ for one like a licence sentence that isn't known, ? for any other; none for those passed over."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])

    def one(s: Column) -> Column:
        return F.when(s.rlike(HINT), reduce(lambda x, r: F.regexp_replace(x, *r), REWRITES, s)).when(s.rlike("[a-z0-9]{3}"), F.lit("?")).otherwise(F.lit(""))

    def name(s: Column) -> Column:
        return F.when(s == "?", s).when(s.rlike(PASSED), F.lit("")).otherwise(F.coalesce(F.element_at(known, s), F.lit("~")))

    return F.filter(F.transform(F.transform(sentences, one), name), lambda i: i != "")


def scan_licences(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, licences (names in the order of the rules, joined by commas; each once), n_sentences (known
    licence sentences), n_unknown (sentences like one that aren't known), sequence (identifiers in order, joined by spaces, ? where
    other sentences stand between). Rules are tried on both readings of a text; the last three columns are those of the reading with
    more known sentences, line by line if both have as many. Null and empty texts have none. Rows that repeat stay; other
    columns are ignored. One pass, without a shuffle."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), *[r.alias(n) for n, r in zip("ab", readings(F.coalesce(F.col(text), F.lit(""))), strict=True)])
    rows = rows.select("doc_id", *[identifiers(F.col(n)).alias(n) for n in "ab"])
    is_known = lambda i: ~i.isin("?", "~")
    x = rows.select("doc_id", *[c for n in "ab" for c in (
        F.size(F.filter(n, is_known)).cast("long").alias(f"known_{n}"), F.size(F.filter(n, lambda i: i == "~")).cast("long").alias(f"unknown_{n}"),
        F.regexp_replace(F.array_join(n, " "), "[?~](?: [?~])*", "?").alias(f"sequence_{n}"))])
    for n in "ab":  # each sentence between two spaces of its own, so that runs of the same rule can't overlap
        x = x.withColumn(f"left_{n}", F.concat(F.lit("  "), F.replace(f"sequence_{n}", F.lit(" "), F.lit("  ")), F.lit("  ")))
    for i, (rule, _) in enumerate(RULES):
        pattern = F.lit(" " + rule.replace(" ", "  ") + " ")
        for n in "ab":
            x = x.withColumn(f"{n}{i}", F.col(f"left_{n}").contains(pattern)).withColumn(f"left_{n}", F.replace(f"left_{n}", pattern, F.lit(" | ")))
    names = [n for _, n in RULES]
    three, two = names.index("BSD-3-Clause"), names.index("BSD-2-Clause")
    hits = [F.col(f"a{i}") | F.col(f"b{i}") if i != two else (F.col(f"a{i}") & ~F.col(f"b{three}")) | F.col(f"b{i}") for i in range(len(RULES))]
    found = F.array_distinct(F.array_compact(F.array(*[F.when(h, F.lit(n)) for h, n in zip(hits, names, strict=True)])))
    better = F.col("known_b") > F.col("known_a")
    pick = lambda c: F.when(better, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a"))
    return x.select("doc_id", F.array_join(found, ",").alias("licences"), pick("known").alias("n_sentences"), pick("unknown").alias("n_unknown"), pick("sequence").alias("sequence"))


def oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    table = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in SENTENCES.items())
    rewritten = reduce(lambda x, r: f"regexp_replace({x}, {quoted(r[0])}, {quoted(r[1].replace('$1', chr(92) + '1'))}, 'g')", REWRITES, "s")
    steps = []
    for n in "ab":
        prev = f"base_{n}"
        for i, (rule, _) in enumerate(RULES):
            pattern = " " + rule.replace(" ", "  ") + " "
            steps.append(f"{n}{i}_ AS (SELECT * EXCLUDE (rest), contains(rest, '{pattern}') AS {n}{i}, replace(rest, '{pattern}', ' | ') AS rest FROM {prev})")
            prev = f"{n}{i}_"
    names = [n for _, n in RULES]
    three, two = names.index("BSD-3-Clause"), names.index("BSD-2-Clause")
    hits = [f"(a{i} OR b{i})" if i != two else f"((a{i} AND NOT b{three}) OR b{i})" for i in range(len(RULES))]
    found = ", ".join(f"CASE WHEN {h} THEN '{n}' END" for h, n in zip(hits, names, strict=True))
    reading = lambda n, source: rf"""
        flat_{n} AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace({source}, '{ENDS}', '\1' || chr(10), 'g'), chr(10)) AS l FROM plain)),
        one_{n} AS (SELECT doc_id, i, CASE WHEN regexp_matches(s, '{HINT}') THEN {rewritten} WHEN regexp_matches(s, '[a-z0-9]{{3}}') THEN '?' ELSE '' END AS s FROM flat_{n}),
        id_{n} AS (SELECT doc_id, i, CASE WHEN s = '?' THEN '?' WHEN regexp_matches(s, '{PASSED}') THEN '' ELSE coalesce(id, '~') END AS id FROM one_{n} LEFT JOIN known ON sentence = s),
        sum_{n} AS (SELECT doc_id, string_agg(id, ' ' ORDER BY i) AS q, count(*) FILTER (id NOT IN ('?', '~')) AS k, count(*) FILTER (id = '~') AS u FROM id_{n} WHERE id <> '' GROUP BY doc_id),
        base_{n} AS (SELECT d.doc_id, coalesce(k, 0) AS known_{n}, coalesce(u, 0) AS unknown_{n}, regexp_replace(coalesce(q, ''), '[?~](?: [?~])*', '?', 'g') AS sequence_{n},
                     '  ' || replace(regexp_replace(coalesce(q, ''), '[?~](?: [?~])*', '?', 'g'), ' ', '  ') || '  ' AS rest FROM documents d LEFT JOIN sum_{n} USING (doc_id)),"""  # noqa: E731
    last = len(RULES) - 1
    return rf"""
        WITH known(sentence, id) AS (VALUES {table}),
        plain AS (SELECT doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '{MARKS}', '', 'g'), 'v[.] 2[.]0', 'v.2.0', 'g') AS p FROM documents),
        {reading("a", "p")} {reading("b", rf"translate(regexp_replace(p, '\n{BLANK}*(?:\n{BLANK}*)+', chr(1), 'g'), chr(10) || chr(1), ' ' || chr(10))")}
        {", ".join(steps)}
        SELECT doc_id, array_to_string(list_filter(list_distinct_in_order, lambda x: x IS NOT NULL), ',') AS licences,
               CASE WHEN known_b > known_a THEN known_b ELSE known_a END AS n_sentences, CASE WHEN known_b > known_a THEN unknown_b ELSE unknown_a END AS n_unknown,
               CASE WHEN known_b > known_a THEN sequence_b ELSE sequence_a END AS sequence
        FROM (SELECT *, list_filter([{found}], lambda x, i: x IS NOT NULL AND list_position([{found}], x) = i) AS list_distinct_in_order FROM a{last}_ JOIN b{last}_ USING (doc_id))"""
