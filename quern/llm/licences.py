"""Licence scans by sentence rules.

A text is cut into sentences twice: once with line ends as blanks (licence texts
are wrapped) and once with each line end as a boundary (licence lines stand
alone).  Normalised sentences are looked up in a fixed table of known licence
sentences; the identifiers found, in order, form a sequence.  Ordered rules, the
longest first, are matched against that sequence; what a rule has matched is
taken out before the next one looks; matches do not overlap.  A sentence that talks of licences but is
not in the table counts as unknown and separates its neighbours.

All of it is one projection of built-in expressions: no shuffle, and texts
without a trigger word are not cut at all.

Defined results: null and empty texts hold no sentence and no licence; texts of
any length are read whole; repeated rows are judged one by one; an empty table
gives an empty table; columns other than id and text are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# Known licence sentences in normalised form (lower case, letters, digits and . + - / only).
SENTENCES = {
    "mit-name": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "this software is released under the mit license", "mit license", "the mit license", "the mit license mit"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "as-is-no-liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "apache-2-name": ["licensed under the apache license version 2.0", "this project is licensed under the apache license version 2.0", "released under the apache license version 2.0", "licensed under the apache license version 2.0 the license"],
    "apache-2-comply": ["you may not use this file except in compliance with the license"],
    "apache-2-copy": ["you may obtain a copy of the license at http //www.apache.org/licenses/license-2.0", "you may obtain a copy of the license at https //www.apache.org/licenses/license-2.0"],
    "apache-2-as-is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "gpl-free": ["this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2-free": ["this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl-no-warranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-3-name": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "gpl-2-name": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2"],
    "lgpl-3-name": ["this work is licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 3"],
    "agpl-3-name": ["this work is licensed under the gnu affero general public license version 3", "licensed under the gnu affero general public license version 3"],
    "mpl-2-terms": ["this source code form is subject to the terms of the mozilla public license v. 2.0"],
    "mpl-2-copy": ["if a copy of the mpl was not distributed with this file you can obtain one at https //mozilla.org/mpl/2.0/", "if a copy of the mpl was not distributed with this file you can obtain one at http //mozilla.org/mpl/2.0/"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-no-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc-grant": ["permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "cc-by-4-name": ["licensed under cc by 4.0", "this work is licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa-4-name": ["licensed under cc by-sa 4.0", "this work is licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "cc-by-nc-4-name": ["licensed under cc by-nc 4.0", "this work is licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "cc-by-nd-4-name": ["licensed under cc by-nd 4.0", "this work is licensed under cc by-nd 4.0", "this work is licensed under a creative commons attribution-noderivatives 4.0 international license"],
    "cc0-name": ["licensed under cc0 1.0", "this work is licensed under cc0 1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "unlicense-name": ["this is free and unencumbered software released into the public domain", "released into the public domain under the unlicense"],
    "boost-name": ["distributed under the boost software license version 1.0", "licensed under the boost software license version 1.0"],
    "rights-reserved": ["all rights reserved under license"],
}

# Ordered rules, (licence, sentence identifiers in a row); the first that fits takes its sentences.
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-no-endorse")),
    ("Apache-2.0", ("apache-2-name", "apache-2-comply", "apache-2-copy", "apache-2-as-is")),
    ("MIT", ("mit-name", "mit-grant", "mit-notice", "as-is", "as-is-no-liability")),
    ("MIT", ("mit-grant", "mit-notice", "as-is", "as-is-no-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache-2-name", "apache-2-comply")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-no-warranty")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-no-warranty")),
    ("MPL-2.0", ("mpl-2-terms", "mpl-2-copy")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("MPL-2.0", ("mpl-2-terms",)),
    ("ISC", ("isc-grant",)),
    ("MIT", ("mit-name",)),
    ("Apache-2.0", ("apache-2-name",)),
    ("GPL-3.0-only", ("gpl-3-name",)),
    ("GPL-2.0-only", ("gpl-2-name",)),
    ("LGPL-3.0-only", ("lgpl-3-name",)),
    ("AGPL-3.0-only", ("agpl-3-name",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-name",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-name",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4-name",)),
    ("CC-BY-4.0", ("cc-by-4-name",)),
    ("CC0-1.0", ("cc0-name",)),
    ("Unlicense", ("unlicense-name",)),
    ("BSL-1.0", ("boost-name",)),
)

#: Every known sentence holds one of these; a sentence without them is of no interest.
TRIGGER = "licen[sc]e|permi|redistribut|warrant|liab|copyright|free software|unencumbered|cc0|copy of the mpl"
UNKNOWN = "unknown"
_DROP = r"[^a-z0-9.+/\-]+"
_END = r"[.!?;:]+( |$)"
_VERSION = r"\bv\.[ \t\n\r]+([0-9])"  # 'v. 2.0' is one word

TABLE = {s: key for key, known in SENTENCES.items() for s in known}
if not all(any(t in s for t in TRIGGER.replace("licen[sc]e", "license|licence").split("|")) for s in TABLE):
    raise AssertionError("a known sentence has no trigger word")

_TERMS = "it under the terms of the GNU General Public License as published by the Free Software Foundation"
_LATER = "of the License, or (at your option) any later version."
_HOPE = (
    " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
    " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
_MPL_COPY = " If a copy of the MPL was not distributed with this file, You can obtain one at {}://mozilla.org/MPL/2.0/."
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
    " You may obtain a copy of the License at {}://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in"
    ' writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,'
    " either express or implied."
)
#: Published notices, as printed: the cut parts some of them inside what the table above holds as one sentence.
NOTICES = tuple(
    (f"GPL-{v}.0-or-later", f"This program is free software{a} you can redistribute it and/or modify {_TERMS}{b} either version {v} {_LATER}{more}")
    for v in (3, 2) for a in ":;," for b in ",;" for more in (_HOPE, "")
) + tuple(("MPL-2.0", _MPL + more) for more in (_MPL_COPY.format("https"), _MPL_COPY.format("http"), "")) + tuple(
    ("Apache-2.0", _APACHE.format(scheme)) for scheme in ("http", "https")
)


def cut(text: str) -> list[str]:
    """Normalised sentences of a text with a trigger word, its line ends as blanks; what ``_sequence`` does."""
    text = re.sub(_VERSION, r"v \1", text.lower().replace("://", " //"))
    told = [re.sub(_DROP, " ", s).strip(" .") for s in re.split(r"[.!?;:]+(?:[ \t\n\r]|$)", text)]
    return [s for s in told if re.search(TRIGGER, s)]


def _with_notices() -> tuple[dict[str, str], tuple[tuple[str, tuple[str, ...]], ...]]:
    """The table and the rules, together with the sentences of ``NOTICES`` and a rule for each."""
    known, rules = dict(TABLE), {}
    for name, notice in NOTICES:
        ids = tuple(known.setdefault(s, f"notice-{len(known) - len(TABLE)}") for s in cut(notice))
        rules.setdefault((name, ids))
    return known, tuple(sorted(rules, key=lambda r: -len(r[1]))) + RULES


KNOWN, ALL_RULES = _with_notices()


def _sequence(text: Column, by_line: bool) -> Column:
    """Identifiers of the licence sentences of a lower-cased text, in order, as ',a,,b,': neighbours share no comma."""
    if by_line:
        text = F.regexp_replace(text, r"[\n\r]+", ". ")
    # Colons and semicolons end sentences only before a blank, so 'http://' becomes 'http //'.
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"://", " //"), _VERSION, "v $1"), r"[.!?;:]+([ \t\n\r]|$)", "\u0001")
    sentences = F.transform(F.split(marked, "\u0001"), lambda s: F.btrim(F.regexp_replace(s, _DROP, " "), F.lit(" .")))
    told = F.filter(sentences, lambda s: s.rlike(TRIGGER))
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    ids = F.transform(told, lambda s: F.coalesce(F.try_element_at(known, s), F.lit(UNKNOWN)))
    return F.array_join(F.transform(ids, lambda i: F.concat(F.lit(","), i, F.lit(","))), "")


def _licences(sequence: Column) -> Column:
    """Licences whose rules fit, in the order of the rules."""
    rules = F.array(*[F.struct(F.lit(n).alias("n"), F.lit("".join(f",{i}," for i in ids)).alias("p")) for n, ids in ALL_RULES])
    start = F.struct(sequence.alias("s"), F.array().cast("array<string>").alias("found"))
    step = lambda acc, r: F.struct(
        F.replace(acc["s"], r["p"], F.lit(",|,")).alias("s"),
        F.when(F.contains(acc["s"], r["p"]), F.array_append(acc["found"], r["n"])).otherwise(acc["found"]).alias("found"),
    )
    return F.aggregate(rules, start, step, lambda acc: acc["found"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``licences`` (sorted, distinct), the sentence identifiers of both cuts, and counts."""
    low = docs.select(F.col(id_col), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    told = low.withColumn("told", F.col("t").rlike(TRIGGER))
    cut = told.select(
        id_col,
        F.when(F.col("told"), _sequence(F.col("t"), False)).otherwise("").alias("wrapped"),
        F.when(F.col("told"), _sequence(F.col("t"), True)).otherwise("").alias("lines"),
    )
    found = cut.withColumn(
        "licences",
        F.when(
            (F.col("wrapped") == "") & (F.col("lines") == ""), F.array().cast("array<string>")
        ).otherwise(F.array_sort(F.array_distinct(F.concat(_licences(F.col("wrapped")), _licences(F.col("lines")))))),
    )
    return found.select(
        id_col,
        "licences",
        F.replace(F.btrim("wrapped", F.lit(",")), F.lit(",,"), F.lit(",")).alias("wrapped_sentences"),
        F.replace(F.btrim("lines", F.lit(",")), F.lit(",,"), F.lit(",")).alias("line_sentences"),
        F.regexp_count("lines", F.lit(r"[a-z0-9\-]+")).cast("long").alias("n_sentences"),
        F.regexp_count("lines", F.lit(UNKNOWN)).cast("long").alias("n_unknown"),
    )


def op3_licence_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents")).withColumn("licences", F.array_join("licences", ","))


def _twin() -> str:
    """The same result reached otherwise: sentences as rows that are joined to the table, a sequence as a string with one
    character per sentence, and rules as such strings."""
    names = list(dict.fromkeys(KNOWN.values()))
    letter = {name: chr(0xE000 + k) for k, name in enumerate(names)}
    # Some rules name the same sentences; the first of them takes them all.
    rules = ", ".join(f"{{'n': '{name}', 'p': '{''.join(letter[i] for i in ids)}'}}" for name, ids in ALL_RULES)
    table_ = ", ".join(f"('{s}', '{k}', '{letter[k]}')" for s, k in KNOWN.items())
    return f"""
with known(sentence, id, letter) as (values {table_}),
low as (select row_number() over () r, doc_id, lower(coalesce(text, '')) t from documents),
both_cuts as (select r, 1 way, t from low union all select r, 2, regexp_replace(t, '[\\n\\r]+', '. ', 'g') from low),
prepared as (select r, way, regexp_replace(replace(t, '://', ' //'), '\\bv\\.[ \\t\\n\\r]+([0-9])', 'v \\1', 'g') t from both_cuts where regexp_matches(t, '{TRIGGER}')),
cut as (select r, way, unnest(regexp_split_to_array(t, '[.!?;:]+(?:[ \\t\\n\\r]|$)')) s, generate_subscripts(regexp_split_to_array(t, '[.!?;:]+(?:[ \\t\\n\\r]|$)'), 1) k from prepared),
told as (select r, way, k, trim(regexp_replace(s, '[^a-z0-9.+/\\-]+', ' ', 'g'), ' .') s from cut),
named as (select r, way, string_agg(coalesce(letter, '?'), '' order by k) letters, string_agg(coalesce(id, '{UNKNOWN}'), ',' order by k) ids,
  count(*) n, count(*) filter (id is null) u from told left join known on s = sentence where regexp_matches(s, '{TRIGGER}') group by r, way),
matched as (select r, way, ids, n, u, list_reduce(list_prepend({{'n': '', 'p': letters}}, [{rules}]),
  lambda a, x: {{'n': case when contains(a.p, x.p) then a.n || x.n || ',' else a.n end, 'p': replace(a.p, x.p, '|')}}).n found from named)
select doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split(coalesce(w.found, '') || coalesce(l.found, ''), ','), lambda x: x <> ''))), ',') licences,
  coalesce(w.ids, '') wrapped_sentences, coalesce(l.ids, '') line_sentences, coalesce(l.n, 0) n_sentences, coalesce(l.u, 0) n_unknown
from low left join matched w on w.r = low.r and w.way = 1 left join matched l on l.r = low.r and l.way = 2
"""


OP3_SQL = _twin()
