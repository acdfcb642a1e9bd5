"""Licence scans: known licence sentences, then ordered rules over their identifiers. DataFrame functions only."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curator.llm.common import narrow

#: Sentences of public licences and of the usual references to them, as `normalised` writes them, and
#: the identifier of each. A sentence ends at a full stop, semicolon or colon before white space. It may end, or go on,
#: at any line end that the next line does not continue in lower case or with a bracket, at a blank line, and at the
#: mark of a list item or comment; it may be followed by a URL.
SENTENCES = {
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
    "licensed under the apache license version 2 0": "apache-2-ref",
    "licensed under the apache license version 2 0 the license": "apache-2-head",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-basis",
    "this work is licensed under the gnu general public license version 3": "gpl-3-ref",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-plus",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-plus",
    "licensed under cc by nc 4 0": "cc-by-nc-4-ref",
    "this work is licensed under cc by 4 0": "cc-by-4-ref",
    "licensed under cc by 4 0": "cc-by-4-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4-ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "all rights reserved": "reserved",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "either version 2 of the license or at your option any later version": "version-2-plus",
    "this library is free software": "lgpl-free",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-terms",
    "either version 2 1 of the license or at your option any later version": "version-2-1-plus",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3-plus",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl-3-plus",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-head",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl-copy",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "this is free and unencumbered software released into the public domain": "unlicense-head",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-grant",
    "this software is distributed without any warranty": "cc0-basis",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4-ref",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at": "epl-2-head",
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "distributed under the boost software license version 1 0": "bsl-1-ref",
}

#: Licence, and the identifiers that must follow each other in this order. Other identifiers may stand
#: between those of a rule. Of rules that start at one identifier the first listed that holds decides.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-ref",)),
    ("Apache-2.0", ("apache-2-head", "apache-comply", "apache-copy", "apache-basis")),
    ("Apache-2.0", ("apache-2-ref",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-3-plus")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-2-plus")),
    ("GPL-3.0", ("gpl-3-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-ref",)),
    ("CC-BY-4.0", ("cc-by-4-ref",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("LicenseRef-all-rights-reserved", ("reserved",)),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-terms", "version-2-plus")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-terms", "version-2-1-plus")),
    ("LGPL-3.0-or-later", ("lgpl-3-plus",)),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl-3-plus")),
    ("MPL-2.0", ("mpl-head", "mpl-copy")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("Unlicense", ("unlicense-head", "unlicense-grant")),
    ("CC0-1.0", ("cc0-grant", "cc0-basis")),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-ref",)),
    ("EPL-2.0", ("epl-2-head",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", ("bsl-1-ref",)),
)

#: Rules of headings, a line by themselves; the SQL twin doesn't have them.
TITLES = (("MIT", ("mit-title",)),)

#: A rule that another one completes: where the longer one holds, the shorter one is not reported.
COVERED = {"BSD-2-Clause": "BSD-3-Clause"}

#: A sentence can only be known if it holds one of these parts of a single word, so texts without any are passed over.
HINTS = (
    "licens", "licenc", "permission", "redistribut", "software", "warrant", "reserved", "copyright", "neither", "obtain",
    "domain", "purpose", "unencumbered",
)

#: Marks in a text that is being scanned: a sentence must end here, or may.
_HARD, _SOFT = "\x01", "\x02"

#: Replaced one after the other: marks of list items and comments with letters or numbers, ends of sentences, line ends.
_BREAKS = (
    (r"(?i)\s*\n(?:[\s#*/;%>-]*(?:\(?(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})\)|(?:dnl|rem)(?=\s))[ \t]*)+", _SOFT),
    (r"[.;:]+\s+", _HARD),
    (r"\s*\n\s*(?![a-z(\s])|\s*\n\s*\n\s*", _SOFT),
)


def marked(text: Column) -> Column:
    """The text as `normalised` writes it, with a mark wherever a sentence ends or may end."""
    out = F.translate(text, _HARD + _SOFT, "  ")
    for pattern, mark in _BREAKS:
        out = F.regexp_replace(out, pattern, mark)
    out = F.regexp_replace(_lower(out), f"[^a-z0-9{_HARD}{_SOFT}]+", " ")
    out = F.regexp_replace(out, f"[ {_SOFT}]*{_HARD}[ {_HARD}{_SOFT}]*", _HARD)
    return F.trim(F.regexp_replace(out, f" ?{_SOFT}[ {_SOFT}]*", _SOFT))


def _sentence() -> str:
    """A known sentence between two marks, the longest that fits; lines inside it may be cut anywhere."""
    known = "|".join(s.replace(" ", f"[ {_SOFT}]") for s in sorted(SENTENCES, key=len, reverse=True))
    return f"(?<![^{_HARD}{_SOFT}])(?:{known})(?=[{_HARD}{_SOFT}]|$| (?:https?|www) )"


def normalised(sentence: Column) -> Column:
    """ASCII lower case, runs of other characters one space."""
    return F.trim(F.regexp_replace(_lower(sentence), "[^a-z0-9]+", " "))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hinted(text: Column) -> Column:
    lower = F.lower(text)
    return functools.reduce(operator.or_, [F.contains(lower, F.lit(h)) for h in HINTS])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, identifiers, licenses) of every row, with no shuffle and no Python.

    identifiers are those of all known sentences in order; licenses are the names of all rules that match the sequence,
    in the order of RULES. A text is searched only if it holds a hint. Null and empty texts have neither.
    """
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    matches = F.regexp_extract_all(marked(F.col("text")), F.lit(_sentence()), F.lit(0))
    found = F.when(hinted(F.col("text")), F.transform(matches, lambda s: known[F.translate(s, _SOFT, " ")]))
    rows = narrow(docs, id_col, text_col).select("doc_id", F.coalesce(found, F.array().cast("array<string>")).alias("identifiers"))
    line = F.concat(F.lit(" "), F.array_join("identifiers", " "), F.lit(" "))
    holds: dict[str, Column] = {}
    for name, ids in (*RULES, *TITLES):
        match = line.rlike(_rule(ids))
        holds[name] = holds[name] | match if name in holds else match
    names = [F.when(hit & ~holds[COVERED[n]] if n in COVERED else hit, F.lit(n)) for n, hit in holds.items()]
    return rows.select(
        "doc_id", F.size("identifiers").cast("bigint").alias("n_sentences"), "identifiers",
        F.array_compact(F.array(*names)).alias("licenses"))


def _rule(ids: tuple[str, ...]) -> str:
    return " (.* )?".join([f" {ids[0]}", *(f"{i}" for i in ids[1:])]) + " "


def oracle(table: str = "documents") -> str:
    """The scan in DuckDB SQL, sentence by sentence, with the matching identifiers joined from a table. It cuts at every
    line end that the next line does not continue in lower case or with a bracket, so it misses sentences that `scan`
    joins there."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in SENTENCES.items())
    by: dict[str, str] = {}
    for name, ids in RULES:
        hit = f"regexp_matches(line, {quote(_rule(ids))})"
        by[name] = f"({by[name]} or {hit})" if name in by else hit
    cases = [f"case when {hit + (f' and not {by[COVERED[n]]}' if n in COVERED else '')} then {quote(n)} end" for n, hit in by.items()]
    return f"""
with known(sentence, identifier) as (values {known}),
-- A line that goes on in lower case or with a bracket is joined to the one before; RE2 has no look-ahead.
cut as (
  select doc_id, unnest(string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''),
    '\\s*\\n\\s*([a-z(])', ' \\1', 'g'), '\\s*\\n\\s*', chr(10), 'g'), '[.;:]+\\s+|\\n')) as s,
    generate_subscripts(string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''),
    '\\s*\\n\\s*([a-z(])', ' \\1', 'g'), '\\s*\\n\\s*', chr(10), 'g'), '[.;:]+\\s+|\\n'), 1) as i
  from {table}),
hits as (
  select doc_id, i, identifier from cut join known
  on trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) = sentence),
lines as (
  select d.doc_id, count(h.i) as n_sentences, coalesce(string_agg(identifier, ' ' order by i), '') as ids
  from {table} d left join hits h using (doc_id) group by d.doc_id),
padded as (select *, ' ' || ids || ' ' as line from lines)
select doc_id, n_sentences, ids as identifiers, concat_ws(',', {', '.join(cases)}) as licenses from padded"""
