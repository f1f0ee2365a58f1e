"""Licence scans: sentences to identifiers, identifier sequences to ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of well-known licence texts and notices.
SENTENCES = {
    1: "released under the mit license",
    2: "licensed under the mit license",
    3: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    4: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    5: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    10: "licensed under the apache license version 2 0",
    11: "licensed under the apache license version 2 0 the license",
    12: "you may not use this file except in compliance with the license",
    13: "you may obtain a copy of the license at",
    14: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    20: "this work is licensed under the gnu general public license version 3",
    21: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    22: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    23: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    30: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    31: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    32: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    33: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    40: "licensed under cc by nc 4 0",
    41: "licensed under cc by 4 0",
    42: "licensed under cc by sa 4 0",
    43: "this work is licensed under a creative commons attribution 4 0 international license",
    50: "this source code form is subject to the terms of the mozilla public license v 2 0",
    60: "all rights reserved",
    70: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    71: "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    72: "this is free and unencumbered software released into the public domain",
    73: "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    74: "distributed under the boost software license version 1 0",
    75: "this software is provided as is without any express or implied warranty",
    76: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    80: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    81: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    82: "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    83: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    84: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
}
#: Rule, licence, identifiers that must follow one another (other sentences may lie between).
RULES = [
    ("mit-notice", "MIT", [1]), ("mit-notice-2", "MIT", [2]), ("mit-text", "MIT", [3, 4, 5]),
    ("apache-notice", "Apache-2.0", [10]), ("apache-header", "Apache-2.0", [11, 12, 13, 14]),
    ("gpl-3-notice", "GPL-3.0", [20]), ("gpl-3-header", "GPL-3.0-or-later", [21, 22]), ("gpl-2-header", "GPL-2.0-or-later", [23, 22]),
    ("bsd-2-text", "BSD-2-Clause", [30, 31, 32]), ("bsd-3-text", "BSD-3-Clause", [30, 31, 32, 33]),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", [40]), ("cc-by-notice", "CC-BY-4.0", [41]), ("cc-by-sa-notice", "CC-BY-SA-4.0", [42]), ("cc-by-text", "CC-BY-4.0", [43]),
    ("mpl-notice", "MPL-2.0", [50]), ("reserved", "LicenseRef-all-rights-reserved", [60]),
    ("isc-text", "ISC", [70, 71]), ("unlicense-text", "Unlicense", [72, 73]), ("bsl-notice", "BSL-1.0", [74]), ("zlib-text", "Zlib", [75, 76]),
    ("agpl-3-header", "AGPL-3.0-or-later", [80, 22]), ("lgpl-2.1-header", "LGPL-2.1-or-later", [81, 82]), ("epl-notice", "EPL-2.0", [83]), ("cc-by-sa-text", "CC-BY-SA-4.0", [84]),
]
#: A text without any of these, in any case, holds no known sentence.
HINTS = ["licen", "permission", "above copyright notice", "rights reserved", "provided", "redistribut", "warranty", "except in compliance", "unencumbered", "anyone is free", "disclaims all warranties"]


#: A full stop after one of these doesn't end a sentence.
ABBREVIATIONS = ["v", "ver", "no", "inc", "co", "corp", "ltd", "etc"]


def _cuts(text: Column) -> Column:
    """Words of lower-cased texts, one blank between them, with H at cuts and S where a sentence may also go on."""
    short = "".join(rf"(?<![^a-z0-9]{a}\.)" for a in ABBREVIATIONS)
    for pattern, to in (
        (r"\n[^a-z0-9\n]*+\n[^a-z0-9]*+", "H"),
        (r"\n[^a-z0-9\nH]++", "\n"),  # comment marks and margins
        (rf"(?<=[.!?]){short}[ \t\r\n]+", "H"),
        (r"\n|(?<=[.!?:;])[ \t\r]+", "S"),
        ("[^a-z0-9HS]+", " "),
    ):
        text = F.regexp_replace(text, pattern, to)
    return text


def _pattern(sentences) -> str:
    """Any of the sentences, whole, in a text of _cuts."""
    longest = sorted(sentences, key=len, reverse=True)
    return "(?:(?<=[HS])|(?<=[HS] )|(?<=^)|(?<=^ ))(?:" + "|".join(s.replace(" ", "[ S]++") for s in longest) + ")(?= ?(?:[HS]|$))"


def _occurrence(ids: list[int], longer: list[list[int]]) -> str:
    """Pattern of ids, one after another, in a path ",1,2,3,", but not where they are a part of a longer sequence."""
    text = lambda seq: "".join(f"{i}," for i in seq)
    inside = [(o[:k], o[k + len(ids) :]) for o in longer for k in range(len(o) - len(ids) + 1) if o[k : k + len(ids)] == ids]
    return "(?<=,)" + "".join("(?!" + (f"(?<=,{text(a)})" if a else "") + text(ids) + text(b) + ")" for a, b in inside) + text(ids)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[int, str] | None = None, rules: list | None = None, hints: list[str] | None = None) -> DataFrame:
    """Licences that every text names.

    A text is cut at blank lines (lines of comment marks only are blank) and after . ! or ?
    before a blank or a line end. Other line ends, : or ; before a blank, and the full stop of an
    abbreviation may end a sentence or lie inside it: both readings are tried, the longest known
    sentence first, so that wrapped texts and one-line notices are found alike. A sentence is
    lower-cased and its runs of other characters than a-z and 0-9 become one blank. Known
    sentences make the text's identifier sequence, in order; a rule matches where
    its identifiers follow one another in that sequence. An occurrence that lies inside one of a
    longer rule gives way to it; a rule is named if an occurrence of it is left. Null and empty
    texts have none; texts of any length are read whole, an empty table gives no rows, and other
    columns are ignored. Rows are judged one by one, so repeated rows and ids get equal results.

    :return: one row per row of `docs`: id_col, n_sentences (known ones), sentence_ids, rules,
        licences (comma-joined; the last two sorted and distinct), n_licences.

    Built-in expressions in one narrow pass; texts without any of the hints skip the splitting.
    """
    sentences, rules, hints = sentences or SENTENCES, rules or RULES, HINTS if hints is None else hints
    if any(not any(h in s for h in hints) for s in sentences.values()):
        raise ValueError("every sentence must hold a hint")
    known = F.create_map(*(F.lit(x) for i, s in sentences.items() for x in (s, str(i))))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    likely = F.lower(text).rlike("|".join(h.replace(" ", "[^a-z0-9]+") for h in hints))
    found = F.transform(F.regexp_extract_all(_cuts(F.lower(text)), F.lit(_pattern(sentences.values())), 0), lambda s: F.regexp_replace(s, "[ S]+", " "))
    ids = F.transform(F.when(likely, found), lambda s: known[s])
    df = docs.select(F.col(id_col).alias("own_id"), F.coalesce(ids, F.array().cast("array<string>")).alias("ids"))
    df = df.withColumn("sentence_ids", F.concat_ws(",", "ids"))
    path = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    found = {name: path.rlike(_occurrence(seq, [o for _, _, o in rules if len(o) > len(seq)])) for name, _, seq in rules}
    hits = F.filter(F.array(*(F.when(found[name], F.struct(F.lit(name).alias("rule"), F.lit(licence).alias("licence"))) for name, licence, _ in rules)), lambda x: x.isNotNull())
    df = df.withColumn("hits", hits)
    return df.select(
        F.col("own_id").alias(id_col), F.size("ids").cast("long").alias("n_sentences"), "sentence_ids",
        F.concat_ws(",", F.array_sort(F.array_distinct("hits.rule"))).alias("rules"), F.concat_ws(",", F.array_sort(F.array_distinct("hits.licence"))).alias("licences"),
        F.size(F.array_distinct("hits.licence")).cast("long").alias("n_licences"),
    )


def oracle() -> str:
    """SQL that gives the rows of scan() over `documents`."""
    values = ", ".join(f"('{s}', {i})" for i, s in SENTENCES.items())
    rules = ", ".join(f"('{name}', '{licence}', {seq})" for name, licence, seq in RULES)
    return f"""
WITH known(sentence, id) AS (VALUES {values}),
line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
cut AS (SELECT doc_id, i, unnest(string_split(regexp_replace(l, '([.!?:])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10))) AS s,
        unnest(range(len(string_split(regexp_replace(l, '([.!?:])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10))))) AS j FROM line),
hit AS (SELECT doc_id, i, j, id FROM cut JOIN known ON trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) = sentence),
s AS (SELECT doc_id, count(*) AS n, list(id ORDER BY i, j) AS ids FROM hit GROUP BY doc_id),
rule(rule, licence, seq) AS (VALUES {rules}),
place AS (SELECT doc_id, ids, unnest(range(1, len(ids) + 1)) AS a FROM s),
o AS (SELECT doc_id, rule, licence, a, a + len(seq) - 1 AS b FROM place, rule WHERE a + len(seq) - 1 <= len(ids) AND ids[a:a + len(seq) - 1] = seq),
r AS (SELECT doc_id, rule, licence FROM o WHERE NOT EXISTS (SELECT 1 FROM o AS l WHERE l.doc_id = o.doc_id AND l.a <= o.a AND l.b >= o.b AND l.b - l.a > o.b - o.a)),
g AS (SELECT doc_id, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, count(DISTINCT licence) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_sentences, coalesce(array_to_string(s.ids, ','), '') AS sentence_ids, coalesce(g.rules, '') AS rules, coalesce(g.licences, '') AS licences, coalesce(g.n, 0) AS n_licences
FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN g USING (doc_id)
"""
