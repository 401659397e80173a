"""Licence scans: known sentences in order.

A text is cut into sentences, each is normalised (ASCII lower case, letters and
digits only, single blanks) and looked up among known licence sentences. The
identifiers found, in order, are matched against ordered licence rules: a rule
holds where its sentences follow one another, with no other known sentence
between; from left to right the longest rule takes its sentences, so that one
whose sentences begin another's gives way to it.
A known sentence may also run on over line breaks, indents and comment marks, as
published licences do, where no stop or blank line comes between; a longer known
sentence goes before a shorter one that begins it. The number of sentences
counts lines as the SQL does; the SQL finds no sentence over such a break.

Defined results: a null or empty text has no sentences; rules and licences are
listed once each, in order of number and name; repeated rows are scanned each on its own; further
columns are ignored. Texts are scanned in their own row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licences and notices, by identifier.
SENTENCES = {
    1: "released under the mit license",
    2: "licensed under the mit license",
    3: "this work is licensed under the gnu general public license version 3",
    4: "licensed under the apache license version 2 0",
    5: "licensed under cc by nc 4 0",
    6: "all rights reserved",
    7: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    8: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    9: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    10: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    11: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    12: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    13: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    14: "licensed under the apache license version 2 0 the license",
    15: "you may not use this file except in compliance with the license",
    16: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    17: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    18: "this is free and unencumbered software released into the public domain",
    19: "licensed under cc by 4 0",
    20: "licensed under cc by sa 4 0",
    21: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    22: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    23: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    24: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    25: "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    26: "this source code form is subject to the terms of the mozilla public license v",
    27: "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    28: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    29: "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    30: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    31: "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    32: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    33: "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    34: "this work is licensed under a creative commons attribution 4 0 international license",
    35: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    36: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    37: "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    38: "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    39: "licensed under cc by nc sa 4 0",
    40: "licensed under cc by nd 4 0",
    41: "creative commons legal code cc0 1 0 universal",
    42: "gnu general public license version 3 29 june 2007",
    43: "gnu general public license version 2 june 1991",
    44: "gnu lesser general public license version 3 29 june 2007",
    45: "gnu lesser general public license version 2 1 february 1999",
    46: "gnu affero general public license version 3 19 november 2007",
    47: "apache license version 2 0 january 2004 http www apache org licenses",
    48: "mozilla public license version 2 0",
    49: "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    50: "this software is provided as is without any express or implied warranty",
    51: "in no event will the authors be held liable for any damages arising from the use of this software",
    52: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    53: "boost software license version 1 0 august 17th 2003",
}
# Fixed values: (rule, licence, sentences in order). Where one rule's sentences begin another's, the longer holds.
RULES = (
    (1, "MIT", (1,)),
    (2, "MIT", (2,)),
    (3, "MIT", (7, 8, 9)),
    (4, "GPL-3.0", (3,)),
    (5, "GPL-3.0-or-later", (16, 17)),
    (6, "Apache-2.0", (4,)),
    (7, "Apache-2.0", (14, 15)),
    (8, "BSD-3-Clause", (10, 11, 12, 13)),
    (9, "BSD-2-Clause", (10, 11, 12)),
    (10, "CC-BY-NC-4.0", (5,)),
    (11, "CC-BY-4.0", (19,)),
    (12, "CC-BY-SA-4.0", (20,)),
    (13, "Unlicense", (18,)),
    (14, "LicenseRef-all-rights-reserved", (6,)),
    (15, "GPL-2.0-or-later", (21, 17)),
    (16, "LGPL-2.1-or-later", (22, 25)),
    (17, "LGPL-3.0-or-later", (23, 25)),
    (18, "AGPL-3.0-or-later", (24, 17)),
    (19, "MPL-2.0", (26,)),
    (20, "MPL-2.0", (26, 27)),
    (21, "ISC", (28, 31)),
    (22, "ISC", (29, 31)),
    (23, "0BSD", (30, 31)),
    (24, "BSD-3-Clause", (10, 11, 12, 32)),
    (25, "BSD-2-Clause", (10, 11, 12, 33)),
    (26, "BSD-3-Clause", (10, 11, 12, 13, 33)),
    (27, "CC-BY-4.0", (34,)),
    (28, "CC-BY-SA-4.0", (35,)),
    (29, "CC-BY-NC-4.0", (36,)),
    (30, "CC-BY-NC-SA-4.0", (37,)),
    (31, "CC-BY-ND-4.0", (38,)),
    (32, "CC-BY-NC-SA-4.0", (39,)),
    (33, "CC-BY-ND-4.0", (40,)),
    (34, "CC0-1.0", (41,)),
    (35, "GPL-3.0", (42,)),
    (36, "GPL-2.0", (43,)),
    (37, "LGPL-3.0", (44,)),
    (38, "LGPL-2.1", (45,)),
    (39, "AGPL-3.0", (46,)),
    (40, "Apache-2.0", (47,)),
    (41, "MPL-2.0", (48,)),
    (42, "Unlicense", (18, 49)),
    (43, "Zlib", (50, 51, 52)),
    (44, "BSL-1.0", (53,)),
    (45, "LGPL-2.1-or-later", (22,)),
    (46, "GPL-2.0-or-later", (21,)),
    (47, "GPL-3.0-or-later", (16,)),
    (48, "LGPL-3.0-or-later", (23,)),
    (49, "AGPL-3.0-or-later", (24,)),
)
_END = r"[.!?]+([ \t]|\z)|[\r\n]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Line breaks that end no sentence.
_WRAP = r"([a-z,])\r?\n([a-z])"


def sentences(text: Column) -> Column:
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), _WRAP, "$1 $2")
    cut = F.split(F.regexp_replace(whole, _END, "\n"), "\n")
    plain = F.transform(cut, lambda s: F.trim(F.regexp_replace(F.translate(s, _UPPER, _LOWER), "[^a-z0-9]+", " ")))
    return F.filter(plain, lambda s: s != "")


#: Marks of an end of a sentence, and of a line break that may be one or a blank.
_STOP, _BREAK = "\x01", "\x02"
_KNOWN = "|".join(s.replace(" ", f"[ {_BREAK}]") for s in sorted(SENTENCES.values(), key=len, reverse=True))


def known_sentences(text: Column) -> Column:
    """The known sentences of a text, in order."""
    out = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), _WRAP, "$1 $2"), _STOP + _BREAK, "  ")
    out = F.regexp_replace(out, r"\r\n?", "\n")
    # Stops, also before a line's end, and lines with no letter or digit.
    out = F.regexp_replace(out, r"[.!?]+([ \t]|\z)|[.!?][\"')\]]*[ \t]*\n|\n(?=[^A-Za-z0-9\n]*\n)", _STOP)
    out = F.regexp_replace(F.translate(out, _UPPER + "\n", _LOWER + _BREAK), f"[^a-z0-9{_STOP}{_BREAK}]+", " ")
    out = F.regexp_replace(out, f" ?([{_STOP}{_BREAK}]) ?", "$1")
    found = F.regexp_extract_all(F.trim(out), F.lit(f"(?<![a-z0-9 ])(?:{_KNOWN})(?![a-z0-9 ])"), F.lit(0))
    return F.transform(found, lambda s: F.translate(s, _BREAK, " "))


def _marked(seq: tuple[int, ...]) -> str:
    return "".join(f"<{i}>" for i in seq)


#: The rules' sequences; at each place the longest is tried first, and what follows it begins a new one.
_SEQUENCES = "|".join(sorted((_marked(seq) for _, _, seq in RULES), key=lambda s: (-s.count("<"), s)))


def scan(docs: DataFrame) -> DataFrame:
    known = F.create_map(*(x for i, s in SENTENCES.items() for x in (F.lit(s), F.lit(i))))
    split = docs.select("doc_id", sentences(F.col("text")).alias("s"), known_sentences(F.col("text")).alias("k"))
    found = split.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.transform("k", lambda s: F.try_element_at(known, s)).alias("ids"))
    joined = found.withColumn("sentence_ids", F.array_join(F.col("ids").cast("array<string>"), ","))
    marked = F.concat_ws("", F.transform("ids", lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))))
    held = F.regexp_extract_all(marked, F.lit(_SEQUENCES), F.lit(0))
    rule_of = F.create_map(*(F.lit(x) for r, _, seq in RULES for x in (_marked(seq), r)))
    name_of = F.create_map(*(F.lit(x) for _, name, seq in RULES for x in (_marked(seq), name)))
    rules = F.array_sort(F.array_distinct(F.transform(held, lambda h: F.try_element_at(rule_of, h))))
    names = F.array_sort(F.array_distinct(F.transform(held, lambda h: F.try_element_at(name_of, h))))
    return joined.select("doc_id", "n_sentences", F.size("ids").cast("long").alias("n_known"), "sentence_ids", F.array_join(rules.cast("array<string>"), ",").alias("rule_ids"), F.array_join(names, ",").alias("licences"))


def oracle() -> str:
    known = ", ".join(f"('{s}', {i})" for i, s in SENTENCES.items())
    rules = ", ".join(f"('{_marked(seq)}', {r}, '{name}')" for r, name, seq in RULES)
    end, wrap = _END.replace("\\z", "$"), _WRAP
    return f"""
WITH known(s, id) AS (VALUES {known}),
parts AS (SELECT doc_id, row_number() OVER () AS r, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '{wrap}', '\\1 \\2', 'g'), '{end}', chr(10), 'g'), chr(10)) AS p FROM documents),
plain AS (SELECT doc_id, r, list_filter(list_transform(p, lambda s: trim(regexp_replace(translate(s, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS s FROM parts),
each AS (SELECT r, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM plain),
ids AS (SELECT r, string_agg(id::VARCHAR, ',' ORDER BY i) AS sentence_ids, count(*) AS n_known FROM each JOIN known USING (s) GROUP BY r),
joined AS (SELECT r, doc_id, len(s) AS n_sentences, coalesce(n_known, 0) AS n_known, coalesce(sentence_ids, '') AS sentence_ids FROM plain LEFT JOIN ids USING (r))
, rules(seq, rule, name) AS (VALUES {rules}),
found AS (SELECT r, unnest(regexp_extract_all(CASE WHEN sentence_ids = '' THEN '' ELSE '<' || replace(sentence_ids, ',', '><') || '>' END, '{_SEQUENCES}')) AS seq FROM joined),
held AS (SELECT r, list_sort(list_distinct(list(rule))) AS rs, list_sort(list_distinct(list(name))) AS ns FROM found JOIN rules USING (seq) GROUP BY r)
SELECT doc_id, n_sentences, n_known, sentence_ids, coalesce(array_to_string(rs, ','), '') AS rule_ids, coalesce(array_to_string(ns, ','), '') AS licences
FROM joined LEFT JOIN held USING (r)
"""
